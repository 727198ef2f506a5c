"""Near-duplicates by b-bit MinHash.

A document's set is its distinct 5-word shingles. Documents of equal sets are one class. For each class
250 minima are taken: 50 bands of 5 give the buckets in which classes meet, and the low 4 bits of all
minima, packed, give by bit counts an estimate of the similarity, corrected for chance agreement. Pairs
in a bucket with an estimate of 0.58 or more are confirmed on the full sets. A pair with similarity 0.75
meets in no band with probability 1e-6, and falls below the estimate's limit, six deviations away, less often.

No pairs are emitted: a bucket's task only names the members that have a candidate there, their sets
follow, and a second task confirms candidates, best estimate first, skips those that are connected
already and emits a star for each connected part, so a bucket of m classes gives at most m - 1 links.
A pair is confirmed in the first band that it shares.

A bucket of up to TILE classes is one task. In a larger one each class is first compared with the bucket's
least class, TILE of them in a task; after that only classes without a link to it are compared with the
rest of the bucket, in tiles. A group of m copies near the leader so takes about m comparisons, not
m * m / 2, and no pair of unconnected classes is left out. Bucket sizes are counted by partial aggregates and joined back, so
no task holds a whole bucket.

Defined results. Null, empty and blank texts have an empty set, link with nothing and are kept. Texts of
under five words are one shingle, the whole sequence. Repeated rows are copies like any other. A null
doc_id is never a component's id unless the component has no other. Empty tables give empty tables.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from .common import BLOCK, SPACES, free_name, slices, written

WORDS, BANDS, ROWS, LOW_BITS = 5, 50, 5, 4
MINIMA = BANDS * ROWS
#: Similarity of a link, in hundredths, and the estimate from which a pair is confirmed.
LINK, CANDIDATE = 75, 0.58
TILE = 1024
#: Edges of all nodes beyond which a node's least neighbour comes from a table, not an aggregate: Spark splits a node of very
#: many edges over tasks only in joins of two plain exchanges.
NODE_EDGES = 1_000_000

_ODD = np.uint64(0x9E3779B97F4A7C15)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_rng = np.random.default_rng(20240607)
_MASKS = _rng.integers(0, 2**32, MINIMA, dtype=np.uint32)
_FACTORS = _rng.integers(0, 2**31, MINIMA, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_PLACES = _rng.integers(0, 2**63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A permutation of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of an odd number and of its inverse modulo 2**64; those up to about BLOCK stay, longer ones are made anew."""

    def __init__(self) -> None:
        self.held = (np.ones(1, np.uint64),) * 2

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.held[0]) < n:
            made = []
            for base in (_ODD, np.uint64(pow(int(_ODD), -1, 2**64))):
                x = np.full(n if n > BLOCK + 4096 else BLOCK + 4096, base, np.uint64)
                x[0] = 1
                made.append(np.multiply.accumulate(x))
            if n > BLOCK + 4096:
                return made[0], made[1]
            self.held = (made[0], made[1])
        return self.held[0][:n], self.held[1][:n]


powers = Powers()


def lower_bytes(raw: bytes) -> np.ndarray:
    """A-Z lower-cased."""
    return _LOWER[np.frombuffer(raw, np.uint8)]


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of each word of `data` (lower-cased bytes that end in a blank), in parts of about BLOCK bytes cut at blanks."""
    starts_of, hashes = [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
    at = 0
    while at < len(data):
        size = BLOCK
        while True:
            part = data[at : at + size]
            blank = (part == 32) | ((part >= 9) & (part <= 13))
            cut = len(part) if at + size >= len(data) else len(part) - int(blank[::-1].argmax()) if blank.any() else 0
            if cut:
                break
            size *= 2
        part, blank = part[:cut], blank[:cut]
        edge = np.flatnonzero(np.diff(np.concatenate(([True], blank))))  # starts and ends of words in turn
        starts, stops = edge[0::2], edge[1::2]
        up, down = powers.of(len(part) + 1)
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up[:-1], out=total[1:])
        hashes.append(mix((total[stops] - total[starts]) * down[starts] + (stops - starts).astype(np.uint64)))
        starts_of.append(starts + at)
        at += cut
    return np.concatenate(starts_of), np.concatenate(hashes)


def shingles(texts: list[str | None]) -> list[np.ndarray]:
    """The sorted set of each text's shingle hashes."""
    raw = [(t or "").encode() for t in texts]
    ends = np.cumsum([len(r) + 1 for r in raw])
    starts, word = word_hashes(lower_bytes(b"\n".join(raw) + b"\n"))
    bounds = np.concatenate(([0], np.searchsorted(starts, ends)))
    n = len(word)
    five = np.zeros(max(0, n - WORDS + 1), np.uint64)
    for k in range(WORDS if len(five) else 0):
        five += word[k : n - WORDS + 1 + k] * _PLACES[k]
    five = mix(five)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= WORDS:
            out.append(np.unique(five[a : b - WORDS + 1]))
        elif b > a:
            short = (word[a:b] * _PLACES[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
            out.append(mix(np.array([short], np.uint64)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def signatures(sets: list[np.ndarray]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Of nonempty sets: a 128-bit name of the set, the packed low bits of its minima, and its bands' hashes."""
    flat = np.concatenate(sets)
    at = np.concatenate(([0], np.cumsum([len(s) for s in sets])[:-1]))
    names = np.stack([np.add.reduceat(mix(flat), at), np.add.reduceat(mix(flat + _ODD), at)], 1)
    short = (flat >> np.uint64(16)).astype(np.uint32)
    minima = np.empty((MINIMA, len(sets)), np.uint32)
    for k in range(MINIMA):
        minima[k] = np.minimum.reduceat((short ^ _MASKS[k]) * _FACTORS[k], at)
    low = (minima & np.uint32(2**LOW_BITS - 1)).astype(np.uint8)
    packed = (low[0::2] << 4 | low[1::2]).T
    bands = np.zeros((len(sets), BANDS), np.uint64)
    for k in range(ROWS):
        bands = mix(bands + minima[k::ROWS].T.astype(np.uint64) + np.uint64(k))
    bands = mix(bands + np.arange(BANDS, dtype=np.uint64))
    return [x.tobytes() for x in names], np.ascontiguousarray(packed), bands.view(np.int64)


SIGNED = "doc_id long, n_shingles long, cls binary, sig binary, bands array<long>"


def signed(docs: DataFrame) -> DataFrame:
    """SIGNED for every row of docs(doc_id, text); cls, sig and bands are null for an empty set. A column `digest` (binary) is carried along."""
    carried = ["digest"] if "digest" in docs.columns else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = shingles(batch["text"].to_pylist())
            full = [i for i, s in enumerate(sets) if len(s)]
            cls: list = [None] * len(sets)
            sig: list = [None] * len(sets)
            bands: list = [None] * len(sets)
            if full:
                names, packed, hashed = signatures([sets[i] for i in full])
                for j, i in enumerate(full):
                    cls[i], sig[i], bands[i] = names[j], packed[j].tobytes(), hashed[j]
            yield pa.RecordBatch.from_arrays(
                [
                    batch["doc_id"],
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(cls, pa.binary()),
                    pa.array(sig, pa.binary()),
                    pa.array(bands, pa.list_(pa.int64())),
                    *(batch[c] for c in carried),
                ],
                ["doc_id", "n_shingles", "cls", "sig", "bands", *carried],
            )

    schema = ", ".join([SIGNED, *(f"{c} binary" for c in carried)])
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *carried).mapInArrow(run, schema)


def by_group(batches: Iterator[pa.RecordBatch], keys: list[str], size: int = 4 << 20) -> Iterator[pa.Table]:
    """Tables of whole groups from batches sorted by `keys`: small groups together up to about `size` bytes, a larger group alone."""
    held: list[pa.RecordBatch] = []
    n = 0

    def last_start(t: pa.Table) -> int:
        change = np.zeros(t.num_rows, bool)
        for k in keys:
            x = t[k].to_numpy()
            change[1:] |= x[1:] != x[:-1]
        at = np.flatnonzero(change)
        return int(at[-1]) if len(at) else 0

    for whole in batches:
        step = max(1, whole.num_rows * size // max(1, whole.nbytes))
        for k in range(0, whole.num_rows, step):
            held.append(whole.slice(k, step))
            n += held[-1].nbytes
            if n >= size:
                t = pa.Table.from_batches(held)
                cut = last_start(t)
                if cut:
                    yield t.slice(0, cut)
                    held = t.slice(cut).combine_chunks().to_batches()
                    n = sum(x.nbytes for x in held)
                size = max(size, 2 * n)
    if n:
        yield pa.Table.from_batches(held)
    pa.default_memory_pool().release_unused()


def starts_of(t: pa.Table, keys: list[str]) -> list[int]:
    change = np.zeros(t.num_rows, bool)
    change[:1] = True
    for k in keys:
        x = t[k].to_numpy()
        change[1:] |= x[1:] != x[:-1]
    return [*np.flatnonzero(change).tolist(), t.num_rows]


def matrix(column: pa.ChunkedArray, kind: type = np.uint8) -> np.ndarray:
    """Binary values of one length as rows."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


_BITS = 0x1111111111111111


def estimates(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated similarity of each of `a` with each of `b` (packed low bits): agreement less what chance gives."""
    wide = [np.pad(x, ((0, 0), (0, -x.shape[1] % 8))).view(np.uint64) for x in (a, b)]
    agree = np.full((len(a), len(b)), -(wide[0].shape[1] * 16 - MINIMA), np.int64)
    for k in range(wide[0].shape[1]):
        x = wide[0][:, k, None] ^ wide[1][None, :, k]
        x |= x >> np.uint64(2)
        x |= x >> np.uint64(1)
        agree += 16 - np.bitwise_count(x & np.uint64(_BITS))
    chance = 1 / 2**LOW_BITS
    return (agree / MINIMA - chance) / (1 - chance)


def candidates(sig: np.ndarray, digest: np.ndarray, side: np.ndarray, band: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (i < j), of a tile's two sides where it has two, with estimates of CANDIDATE or more whose first common band is `band` (any if negative)."""
    two = side.max() != side.min()
    found = []
    for k in range(0, len(sig), 256):
        e = estimates(sig[k : k + 256], sig)
        i, j = np.nonzero(e >= CANDIDATE)
        v = e[i, j]
        i += k
        ok = (i < j) & ((side[i] != side[j]) if two else True)
        found.append((i[ok], j[ok], v[ok]))
    i, j, v = (np.concatenate(x) for x in zip(*found, strict=True))
    if band < 0:
        return i, j, v
    first = np.empty(len(i), np.int64)
    for k in range(0, len(i), 100_000):
        first[k : k + 100_000] = (digest[i[k : k + 100_000]] == digest[j[k : k + 100_000]]).argmax(1)
    ok = first == band
    return i[ok], j[ok], v[ok]


KEYS = ["bucket", "ti", "tj"]


TILED = [*KEYS, "cls", "side", "band"]


def one_tile(met: DataFrame) -> DataFrame:
    """Buckets of at most TILE classes: each is one tile."""
    zero = F.lit(0)
    return met.select("bucket", zero.alias("ti"), zero.alias("tj"), "cls", zero.alias("side"), "band")


def leader_tiles(big: DataFrame, heads: DataFrame) -> DataFrame:
    """Each bucket's leader (`heads`: bucket, leader) beside all others, TILE of them to a tile; a pair that meets in several bands goes once."""
    led = written(big.join(heads, "bucket").filter("cls != leader").select("leader", "cls").distinct(), "led")
    parts = written(led.groupBy("leader").agg(F.ceil(F.count("*") / TILE).cast("int").alias("parts")), "parts")
    bucket, none, no_band = F.xxhash64("leader").alias("bucket"), F.lit(-1).alias("tj"), F.lit(-1).alias("band")
    members = led.join(parts, "leader").select(
        bucket, F.pmod(F.xxhash64("cls"), "parts").cast("int").alias("ti"), none, "cls", F.lit(0).alias("side"), no_band
    )
    leaders = parts.select(bucket, F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("ti"), none, F.col("leader").alias("cls"), F.lit(1).alias("side"), no_band)
    return members.unionByName(leaders)


def rest_tiles(big: DataFrame, heads: DataFrame, links: DataFrame) -> DataFrame:
    """What leaders leave to compare: the classes of a bucket that no link (a, b) joins to its leader with all of the bucket.

    Two classes that link to the leader are connected already. A bucket in which all do gives no tile.
    """
    linked = links.select(F.col("a").alias("leader"), F.col("b").alias("cls"), F.lit(False).alias("other")).distinct()
    joined = big.join(heads, "bucket").join(linked, ["leader", "cls"], "left")
    joined = written(joined.withColumn("other", F.coalesce("other", F.col("cls") != F.col("leader"))).select("bucket", "band", "cls", "m", "other"), "rest")
    others = written(joined.groupBy("bucket").agg(F.count_if("other").alias("others")).filter("others > 0"), "others")
    dealt = joined.join(others, "bucket").select(
        "bucket", "band", "cls", "other", F.xxhash64("cls").alias("h"), F.ceil(F.col("m") / TILE).cast("int").alias("p"), F.ceil(F.col("others") / TILE).cast("int").alias("q")
    )
    every = dealt.withColumn("tj", F.explode(F.sequence(F.lit(0), F.col("q") - 1))).select(
        "bucket", F.pmod("h", "p").cast("int").alias("ti"), "tj", "cls", F.lit(0).alias("side"), "band"
    )
    other = dealt.filter("other").withColumn("ti", F.explode(F.sequence(F.lit(0), F.col("p") - 1))).select(
        "bucket", "ti", F.pmod("h", "q").cast("int").alias("tj"), "cls", F.lit(1).alias("side"), "band"
    )
    return every.unionByName(other)


def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The members of each tile that have a candidate in it."""
    for t in by_group(batches, KEYS):
        sig, digest = matrix(t["sig"]), matrix(t["digest"], np.uint32)
        side, band = t["side"].to_numpy(), t["band"].to_numpy()
        cut = starts_of(t, KEYS)
        keep = []
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            if b - a > 1:
                i, j, _ = candidates(sig[a:b], digest[a:b], side[a:b], int(band[a]))
                keep.append(a + np.union1d(i, j))
        if keep:
            out = t.select(["bucket", "ti", "tj", "cls", "side", "band", "sig", "digest"]).take(pa.array(np.concatenate(keep).astype(np.int64)))
            yield from out.combine_chunks().to_batches()


def confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b) of each part of a tile's members that confirmed pairs connect: from its least name to all others."""
    for t in by_group(batches, KEYS):
        sig, digest = matrix(t["sig"]), matrix(t["digest"], np.uint32)
        side, band, names = t["side"].to_numpy(), t["band"].to_numpy(), t["cls"].to_pylist()
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in t["set"]]
        cut = starts_of(t, KEYS)
        links: list[tuple[bytes, bytes]] = []
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            if b - a < 2:
                continue
            joined = False
            i, j, v = candidates(sig[a:b], digest[a:b], side[a:b], int(band[a]))
            root = list(range(b - a))

            def top(x: int, root: list[int] = root) -> int:
                while root[x] != x:
                    root[x] = x = root[root[x]]
                return x

            for k in np.argsort(-v, kind="stable").tolist():
                x, y = int(i[k]), int(j[k])
                if top(x) == top(y):
                    continue
                p, q = sets[a + x], sets[a + y]
                if 100 * min(len(p), len(q)) < LINK * max(len(p), len(q)):
                    continue
                both = len(np.intersect1d(p, q, assume_unique=True))
                if 100 * both >= LINK * (len(p) + len(q) - both):
                    root[top(x)] = top(y)
                    joined = True
            if joined:
                parts: dict[int, set[bytes]] = {}
                for x in range(b - a):
                    parts.setdefault(top(x), set()).add(names[a + x])
                for part in parts.values():
                    least, *others = sorted(part)
                    links += [(least, x) for x in others]
        if links:
            a, b = zip(*links, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of links(a, b), by alternating large and small stars until nothing changes."""

    def star(edges: DataFrame, large: bool, split: bool) -> DataFrame:
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both if large else both.filter("b < a")
        least = near.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        least = written(least, "least") if split else least
        moved = near.join(least, "a")
        if large:
            out = moved.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            out = moved.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        return out.filter("a != b").distinct()

    def kept(edges: DataFrame, label: str) -> tuple[DataFrame, tuple]:
        """The edges as a table, and what tells one set of edges from another, counted while writing."""
        seen = Observation()
        out = written(edges.observe(seen, F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")), label)
        return out, (seen.get["n"], seen.get["x"])

    edges, now = kept(links.filter("a != b").distinct(), "links")
    while True:
        split = now[0] > NODE_EDGES
        edges, after = kept(star(star(edges, True, split), False, split), "stars")
        now, before = after, now
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            )


def sets_of(docs: DataFrame) -> DataFrame:
    """cls and the sorted set of each row of docs(text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [s for s in shingles(batch["text"].to_pylist()) if len(s)]
            if sets:
                flat = np.concatenate(sets)
                at = np.concatenate(([0], np.cumsum([len(s) for s in sets])[:-1]))
                names = np.stack([np.add.reduceat(mix(flat), at), np.add.reduceat(mix(flat + _ODD), at)], 1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x.tobytes() for x in names], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())],
                    ["cls", "set"],
                )

    return docs.select("text").mapInArrow(run, "cls binary, set binary")


def rooted(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The signed rows of docs(doc_id long, text string), and their classes: cls, rep (the least doc_id) and the component's root.

    Where docs has a `digest` of the text, the classes have `row` too: their least row by doc_id, nulls last, and digest.
    """
    by_row = "digest" in docs.columns
    all_signed = written(signed(docs), "signed")
    least = [F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "digest")).alias("row")] if by_row else []
    classes = written(
        all_signed.filter("cls IS NOT NULL")
        .groupBy("cls")
        .agg(F.min("doc_id").alias("rep"), F.first("sig").alias("sig"), F.first("bands").alias("bands"), *least),
        "classes",
    )
    exploded = classes.select("cls", F.posexplode("bands").alias("band", "bucket"))
    sizes = written(exploded.groupBy("bucket").agg(F.count("*").alias("m")).filter("m > 1"), "sizes")
    met = written(exploded.join(sizes, "bucket"), "met")
    digest = F.transform("bands", lambda b: F.lpad(F.hex(b.bitwiseAND(F.lit(2**32 - 1))), 8, "0"))
    kinds = classes.select("cls", "sig", F.unhex(F.array_join(digest, "")).alias("digest"))

    def linked(dealt: DataFrame) -> DataFrame:
        """Confirmed links of the tiles in `dealt`."""
        near = dealt.join(kinds, "cls").repartition(*KEYS).sortWithinPartitions(*KEYS)
        chosen = written(
            near.select(*TILED, "sig", "digest").mapInArrow(named, "bucket long, ti int, tj int, cls binary, side int, band int, sig binary, digest binary"),
            "chosen",
        )
        wanted = chosen.select("cls").distinct().join(classes, "cls")
        if by_row:
            texts = docs.join(*matching(docs, wanted.select("row.doc_id", "row.digest")), "left_semi")
        else:
            wanted = wanted.select(F.col("rep").alias("doc_id"))
            texts = docs.join(wanted.distinct(), docs["doc_id"].eqNullSafe(wanted["doc_id"]), "left_semi")
        sets = sets_of(texts).groupBy("cls").agg(F.min("set").alias("set"))
        return chosen.join(sets, "cls").repartition(*KEYS).sortWithinPartitions(*KEYS).mapInArrow(confirmed, "a binary, b binary")

    big = met.filter(F.col("m") > TILE)
    small = one_tile(met.filter(F.col("m") <= TILE))
    if big.isEmpty():
        links = linked(small)
    else:
        heads = written(big.groupBy("bucket").agg(F.min("cls").alias("leader")), "leaders")
        links = written(linked(small.unionByName(leader_tiles(big, heads))), "links")
        links = links.unionByName(linked(rest_tiles(big, heads, links)))
    roots = written(components(links), "roots")
    carried = ["cls", "rep", *(["row"] if by_row else [])]
    return all_signed, classes.select(*carried).join(roots, F.col("cls") == F.col("node"), "left").select(*carried, F.coalesce("root", "cls").alias("root"))


def matching(docs: DataFrame, rows: DataFrame, digest: str = "digest") -> tuple[DataFrame, Column]:
    """`rows` (doc_id, digest) and the condition that a row of `docs` is one of them."""
    rows = rows.select(F.col("doc_id").alias("_row_id"), F.col("digest").alias("_row_digest"))
    return rows, docs["doc_id"].cast("long").eqNullSafe(rows["_row_id"]) & (docs[digest] == rows["_row_digest"])


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id (long), kept (boolean) for every row of docs(doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    all_signed, named_roots = rooted(docs)
    members = all_signed.select("doc_id", "n_shingles", "cls")
    named_roots = written(named_roots, "named")
    least = written(named_roots.groupBy("root").agg(F.min("rep").alias("component")), "component")
    component = named_roots.join(least, "root").select("cls", "component")
    return (
        members.join(component, "cls", "left")
        .withColumn("component_id", F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("component")))
        .select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
    )


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of each component, all columns, and every row with an empty set.

    It is the component's row with the least doc_id, nulls last; of several with that id, or without any, the one with the least
    digest of its text. Rows equal in id and text are one. Ids need not be unique: other texts under the same id, or under none, stay.
    """
    text, digest = F.col("text").cast("string"), free_name(docs, "_digest")
    hashed = F.unhex(F.md5(text))
    empty = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES)) == ""
    all_signed, classes = rooted(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), hashed.alias("digest")))
    first = classes.groupBy("root").agg(F.min("row").alias("row")).select("row.doc_id", "row.digest")
    full = docs.filter(~empty).withColumn(digest, hashed)
    out = full.join(*matching(full, first, digest), "left_semi")
    if not all_signed.filter("cls IS NOT NULL").groupBy("doc_id", "digest").count().filter("count > 1").isEmpty():
        out = out.dropDuplicates(["doc_id", digest])
    return out.drop(digest).unionByName(docs.filter(empty))

