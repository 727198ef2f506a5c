"""Suffix-array dedup of passages that repeat anywhere in a corpus.

A text is a row of symbols: its bytes, or its words as 64-bit hashes. Every window of `length` symbols is dealt by its anchor, the string of
`anchor_size(length)` symbols in it with the least hash, so that equal windows of any two texts meet under one key, at one distance from the
anchor. Only anchors that occur at least twice travel with their symbols.

For the windows of one key a task builds the suffix order distance by distance: the order of the suffixes
that start l symbols before the anchor follows from the symbol there and the order at l - 1. In suffix order the previous and the next
position that are smaller in the corpus give the longest previous factor; it is `length` or more where one of them lies in the
same run of neighbours that share `length` symbols. With keep="first" those windows, the later copies, go and the first stays; with
keep="none" every window in a run of two or more goes, the first included. Neighbours are found by hashes and confirmed on the symbols.

Equal texts are one text with a number of copies, and occurrences of an anchor whose windows span equal
bytes are one context with a number of occurrences; only contexts of anchors with two or more of them
travel with their bytes. How often a key occurs is counted by partial aggregates and joined back. A group of
over HOT contexts is not gathered: its distances are parted into PARTS, all windows of a part share the bytes
around the anchor, and the hash of these deals the contexts to smaller groups, again and again while a group is
too large. Windows of one last distance that still are too many for a task go singly: there suffix order is
equality, and Spark's aggregation, which has no group in memory, finds the run's size and first position.

Words are runs of characters other than SPACES; a removed run of words goes with the white space up to the next word.

Defined results. Null and empty texts have no bytes and nothing is removed. Texts under `length` symbols
are left alone. Repeated rows are copies: with keep="none" all go; with keep="first" the row with the
least doc_id (null last) keeps its text, among rows with one doc_id and text every one does.
Text positions are ordered by doc_id, then text digest, then offset. Columns of the input keep their values.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import BLOCK, SPACES, free_name, shuffles_dropped, slices, written
from .minhash import by_group, mix, powers

LENGTH = 400
#: Words of a window, for passages of over 50 words.
PASSAGE_WORDS = 51
#: Contexts of a group beyond which it is parted, and into how many parts.
HOT, PARTS = 4_000, 4


def anchor_size(length: int) -> int:
    return max(1, length * 8 // 25)


_BLANK = np.isin(np.arange(256), list(SPACES.encode()))


def word_bounds(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of a text start and end."""
    edge = np.diff(np.concatenate(([True], _BLANK[np.frombuffer(raw, np.uint8)], [True])).astype(np.int8))
    return np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)


def word_symbols(raw: bytes) -> np.ndarray:
    """A 64-bit hash of each word."""
    data, (starts, ends) = np.frombuffer(raw, np.uint8), word_bounds(raw)
    out, at = np.empty(len(starts), np.uint64), 0
    while at < len(starts):  # as many words at a time as BLOCK bytes hold, one at least
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + BLOCK, "right")))
        first = starts[at]
        total = _sums(data[first : ends[to - 1]])
        out[at:to] = mix((total[ends[at:to] - first] - total[starts[at:to] - first]) * powers.of(len(total))[1][starts[at:to] - first])
        at = to
    return out


def symbols(raw: bytes, words: bool) -> np.ndarray:
    return word_symbols(raw) if words else np.frombuffer(raw, np.uint8)


def _sums(data: np.ndarray) -> np.ndarray:
    """Running sums of bytes by powers: differences of them give the hash of any string of `data`."""
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers.of(len(data))[0], out=total[1:])
    return total


def _hashes(total: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all strings of `size` bytes."""
    n = len(total) - size
    return mix((total[size:] - total[:-size]) * powers.of(n)[1])


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` neighbours."""
    m, k = len(x) - width + 1, 1
    while 2 * k <= width:
        x = np.minimum(x[:-k], x[k:])
        k *= 2
    return np.minimum(x[:m], x[width - k : width - k + m])


def anchors(total: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, first window, last window, anchor) for the runs of windows with one anchor; the leftmost of equal anchors."""
    size = anchor_size(length)
    width = length - size + 1
    h = _hashes(total, size)
    least = _least(h, width)
    # A place is an anchor of some window where the greatest minimum of the windows around it is its own hash.
    around = np.full(len(least) + 2 * (width - 1), 0, np.uint64)
    around[width - 1 : width - 1 + len(least)] = least
    places = np.flatnonzero(~_least(~around, width) == h)
    places = places[np.argsort(h[places], kind="stable")]
    ranked = h[places]
    change = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
    ends = np.concatenate((change[1:], [len(least)])) - 1
    value = least[change]
    left, right = np.searchsorted(ranked, value, "left"), np.searchsorted(ranked, value, "right")
    one = right - left == 1
    keys, lo, hi, at = [value[one]], [change[one]], [ends[one]], [places[left[one]]]
    for k in np.flatnonzero(~one).tolist():  # the string occurs again: each window has its first occurrence
        a, b = int(change[k]), int(ends[k])
        for p in places[left[k] : right[k]].tolist():
            to = min(b, p)
            if a <= to and p < a + width:
                for column, x in zip((keys, lo, hi, at), (value[k], a, to, p), strict=True):
                    column.append(np.array([x]))
                a = to + 1
    return tuple(np.concatenate(x) for x in (keys, lo, hi, at))


FOUND = "tid binary, key long, context long, place long"


def _find(length: int, words: bool):
    """Anchors of each text: the anchor's and the context's hash, and the place: first window, windows - 1, symbols before the anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()  # saves work on copies in one task; what it misses is made distinct later
        for batch in slices(batches):
            out: list[list] = [[], [], [], []]
            for tid, text in zip(batch["tid"].to_pylist(), batch["text"].to_pylist(), strict=True):
                if not text or len(text) * 4 < length or tid in seen:
                    continue
                if len(seen) < 100_000:
                    seen.add(tid)
                data = symbols(text.encode(), words)
                for base in range(0, len(data) - length + 1, BLOCK):
                    total = _sums(data[base : base + BLOCK + length - 1])
                    k, lo, hi, at = anchors(total, length)
                    whole = (total[hi + length] - total[lo]) * powers.of(len(total))[1][lo]
                    place = (lo + base) << 20 | (hi - lo) << 10 | (at - lo)
                    out[0] += [tid] * len(k)
                    for column, x in zip(out[1:], (k, mix(whole + mix((place & 0xFFFFF).astype(np.uint64))), place), strict=True):
                        column.append(x.view(np.int64))
            if out[0]:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out[0], pa.binary()), *(pa.array(np.concatenate(c)) for c in out[1:])], ["tid", "key", "context", "place"]
                )

    return run


LO, COUNT, LEAD = "shiftright({0}, 20)", "(shiftright({0}, 10) & 1023) + 1", "{0} & 1023"
#: Contexts on the way to their group: part, the distances `near` to `far` that the group compares, and `skip`, the bytes cut off in front.
CONTEXT = "key long, context long, doc long, tid binary, place long, weight long, part long, near int, far int, skip int, bytes binary"
COLUMNS = [x.split()[0] for x in CONTEXT.split(", ")]
KINDS = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary())


def _contexts(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), KINDS, strict=True)], COLUMNS)


def _cut(length: int, words: bool):
    """The symbols of each context's windows, from the text that holds its first occurrence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        far = length - anchor_size(length)
        for batch in slices(batches):
            rows: list[tuple] = []
            for doc, tid, text, wanted in zip(*(batch[c].to_pylist() for c in ("doc", "tid", "text", "wanted")), strict=True):
                held = symbols(text.encode(), words)
                for w in wanted:
                    lo, more = w["place"] >> 20, w["place"] >> 10 & 1023
                    rows.append((w["key"], w["context"], doc, tid, w["place"], w["weight"], w["key"], 0, far, 0, held[lo : lo + more + length].tobytes()))
            if rows:
                yield _contexts(rows)

    return run


def _parted(length: int, words: bool):
    """Contexts of too large groups, once for each part of the distances that they have windows in, dealt by the bytes that the part's windows share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wide = 8 if words else 1
        for batch in slices(batches, "bytes"):
            rows: list[tuple] = []
            for row in zip(*(batch[c].to_pylist() for c in COLUMNS), strict=True):
                key, context, doc, tid, place, weight, part, near, far, skip, raw = row
                lo, count, lead = place >> 20, (place >> 10 & 1023) + 1, place & 1023
                step = -(-(far - near + 1) // PARTS)
                for a in range(near, far + 1, step):
                    b = min(a + step - 1, far)
                    first, last = max(a, lead - count + 1), min(b, lead)
                    if first > last:
                        continue
                    cut = lead - last
                    core = hashlib.blake2b(raw[(lead - a) * wide : (lead - b + length) * wide], digest_size=8, key=b"%d %d %d" % (part, a, b)).digest()
                    where = (lo + cut) << 20 | (last - first) << 10 | last
                    rows.append((key, context, doc, tid, where, weight, int.from_bytes(core, "big", signed=True), a, b, skip + cut, raw[cut * wide : (lead - first + length) * wide]))
            if rows:
                yield _contexts(rows)

    return run


SPANS = "key long, context long, start int, stop int"


def earlier(position: np.ndarray, run: np.ndarray) -> np.ndarray:
    """Where the longest previous factor reaches the run: the previous or the next smaller position is a member of the same run.

    `position` in suffix order, `run` the number of each one's run, ascending.
    """
    step = int(position.max(initial=0)) + 1

    def before(v: np.ndarray, r: np.ndarray) -> np.ndarray:
        """A smaller position comes before it within its run: falling offsets let the running minimum start anew."""
        low = v + (r.max(initial=0) - r) * step
        out = np.zeros(len(v), bool)
        out[1:] = (r[1:] == r[:-1]) & (np.minimum.accumulate(low)[:-1] < low[1:])
        return out

    back = run.max(initial=0) - run[::-1]
    return before(position, run) | before(position[::-1], back)[::-1]


def repeated(
    group: np.ndarray, contexts: list[bytes], lead: np.ndarray, count: np.ndarray, position: np.ndarray, weight: np.ndarray, length: int, first: bool, words: bool, exact: bool = False
) -> list[tuple[int, np.ndarray]]:
    """For each distance l from the anchor: l, and the rows whose window there is a copy to remove.

    Rows: group (of one anchor), context, lead (symbols before the anchor), count (of windows), position (rank of the
    context's first occurrence in the corpus) and weight (its occurrences). Windows are compared by hashes, which `confirmed` checks; with
    `exact` by their symbols alone.
    """
    n, wide = len(contexts), 8 if words else 1
    size = np.array([len(c) // wide for c in contexts])
    at = np.cumsum(size) - size + lead  # the anchor in all contexts joined
    data = np.frombuffer(b"".join(contexts), np.uint64 if words else np.uint8)
    total, down = _sums(data), powers.of(len(data) + 1)[1]
    symbol = np.unique(data, return_inverse=True)[1] if words else data
    right = [c[x * wide :] for c, x in zip(contexts, lead.tolist(), strict=True)]
    rank = np.empty(n, np.int64)
    rank[sorted(range(n), key=right.__getitem__)] = np.arange(n)
    rows = np.arange(n)
    bits, bits_of_symbol = n.bit_length(), int(symbol.max()).bit_length()
    found, pairs = [], []
    for l in range(int(lead.max()) + 1):
        rows = rows[lead[rows] >= l]
        before = symbol[at[rows] - l].astype(np.int64) if l else np.zeros(len(rows), np.int64)
        packed = 2 * bits + bits_of_symbol < 63
        order = np.argsort((group[rows] << bits_of_symbol | before) << bits | rank[rows]) if packed else np.lexsort((rank[rows], before, group[rows]))
        rank[rows[order]] = np.arange(len(rows))
        due = rows[order]
        due = due[lead[due] - l < count[due]]  # a window of this row starts here
        if not len(due):
            continue
        start = at[due] - l
        if exact:
            window = np.unique([data[a : a + length].tobytes() for a in start.tolist()], return_inverse=True)[1]
        else:
            window = (total[start + length] - total[start]) * down[start]
        same = (window[1:] == window[:-1]) & (group[due][1:] == group[due][:-1])
        run = np.cumsum(np.concatenate(([False], ~same)))
        if first:
            gone = due[earlier(position[due], run)]
        else:
            gone = due[np.bincount(run, weight[due])[run] > 1]
        if len(gone):
            found.append((l, gone))
        pairs.append((due[:-1][same], due[1:][same], l))
    if not exact and not confirmed(contexts, lead, pairs, length, wide):
        return repeated(group, contexts, lead, count, position, weight, length, first, words, exact=True)
    return found


def confirmed(contexts: list[bytes], lead: np.ndarray, pairs: list[tuple[np.ndarray, np.ndarray, int]], length: int, wide: int) -> bool:
    """Whether windows with one hash have the same symbols. The windows of a pair of contexts overlap, and are compared as one stretch."""
    a, b, l = (np.concatenate(x) for x in zip(*((a, b, np.full(len(a), l)) for a, b, l in pairs), strict=True)) if pairs else (np.empty(0, int),) * 3
    if not len(a):
        return True
    order = np.lexsort((l, b, a))
    a, b, l = a[order], b[order], l[order]
    heads = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))))
    tails = np.concatenate((heads[1:], [len(a)])) - 1
    for x, y, low, high in zip(a[heads].tolist(), b[heads].tolist(), l[heads].tolist(), l[tails].tolist(), strict=True):
        i, j = (int(lead[x]) - high) * wide, (int(lead[y]) - high) * wide
        n = (high - low + length) * wide
        if contexts[x][i : i + n] != contexts[y][j : j + n]:
            return False
    return True


def _spans(length: int, first: bool, words: bool):
    """Spans to remove, from the start of each context, at its first occurrence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in by_group(batches, ["part"], 2 << 20):
            # Rows that repeat doc_id and text bring a context more than once.
            same = np.zeros(t.num_rows, bool)
            part, key, context = (t[c].to_numpy() for c in ("part", "key", "context"))
            same[1:] = (part[1:] == part[:-1]) & (key[1:] == key[:-1]) & (context[1:] == context[:-1])
            t = t.filter(pa.array(~same))
            part, key, context, place, weight, skip = (t[c].to_numpy() for c in ("part", "key", "context", "place", "weight", "skip"))
            group = np.cumsum(np.concatenate(([0], part[1:] != part[:-1])))
            tid, doc = t["tid"].to_pylist(), t["doc"].to_pylist()
            positions = [(d is None, d or 0, x, a) for d, x, a in zip(doc, tid, (place >> 20).tolist(), strict=True)]
            position = np.empty(len(tid), np.int64)
            position[sorted(range(len(tid)), key=positions.__getitem__)] = np.arange(len(tid))
            lead, count = place & 1023, (place >> 10 & 1023) + 1
            found = [(rows, lead[rows] - l) for l, rows in repeated(group, t["bytes"].to_pylist(), lead, count, position, weight, length, first, words)]
            if found:
                rows, starts = (np.concatenate(x) for x in zip(*found, strict=True))
                sort = np.lexsort((starts, rows))
                rows, starts = rows[sort], starts[sort]
                a = np.flatnonzero(np.concatenate(([True], (rows[1:] != rows[:-1]) | (starts[1:] > starts[:-1] + length))))
                b = np.concatenate((a[1:], [len(rows)])) - 1
                cut = skip[rows[a]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key[rows[a]]), pa.array(context[rows[a]]), pa.array((starts[a] + cut).astype(np.int32)), pa.array((starts[b] + length + cut).astype(np.int32))],
                    ["key", "context", "start", "stop"],
                )

    return run


def _windows(length: int):
    """Single windows of the last distance: a 128-bit name of the window, and where it is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "bytes"):
            names = [int.from_bytes(hashlib.blake2b(x.as_py(), digest_size=8, person=b"%d" % k).digest(), "big", signed=True) for k in (1, 2) for x in batch["bytes"]]
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [pa.array(names[:n], pa.int64()), pa.array(names[n:], pa.int64()), *(batch[c] for c in ("skip", *COLUMNS[:6]))], ["w1", "w2", "start", *COLUMNS[:6]]
            )

    return run


def _gathered(cut: DataFrame, hot: DataFrame, length: int, first: bool, words: bool) -> DataFrame:
    """SPANS of the contexts in `cut`; the groups of over HOT contexts (`hot`: part, wide) are parted until they are not."""
    gather = lambda df: df.repartition("part").sortWithinPartitions("part", "key", "context").mapInArrow(_spans(length, first, words), SPANS)
    large = lambda df: written(df.groupBy("part").agg(F.count("*").alias("n"), F.max(F.col("far") - F.col("near")).alias("wide")).filter(F.col("n") > HOT), "hot")
    if hot.isEmpty():
        return gather(cut)
    cut = written(cut, "bytes")
    spans = gather(cut.join(hot, "part", "left_anti"))
    while True:
        last = cut.join(hot.filter("wide = 0").select("part"), "part", "left_semi").select(*COLUMNS)
        single = last.mapInArrow(_windows(length), f"w1 long, w2 long, start int, {CONTEXT.split(', part')[0]}").dropDuplicates(["key", "context", "start"])
        at = F.struct(F.col("doc").isNull().alias("none"), "doc", "tid", F.expr(LO.format("place")).alias("at"))
        known = written(single.groupBy("w1", "w2").agg(F.sum("weight").alias("total"), F.min(at).alias("least")), "windows")
        gone = single.join(known, ["w1", "w2"]).filter(at != F.col("least") if first else F.col("total") > 1)
        spans = spans.unionByName(gone.select("key", "context", "start", (F.col("start") + length).alias("stop")))
        wide = hot.filter("wide > 0").select("part")
        if wide.isEmpty():
            return spans
        cut = written(cut.join(wide, "part", "left_semi").select(*COLUMNS).mapInArrow(_parted(length, words), CONTEXT), "parted")
        hot = large(cut)
        spans = spans.unionByName(gather(cut.join(hot, "part", "left_anti")))


def find_spans(docs: DataFrame, length: int = LENGTH, first: bool = False, words: bool = False) -> tuple[DataFrame, DataFrame]:
    """(texts, spans): doc_id, text and tid of every row, and tid, spans (sorted [start, stop)) to remove, in bytes or words.

    With first=True the spans are those of a text's first row.
    """
    # tid is never null, and says so: joins then add no filter to one of the two that read the texts, and share their exchange.
    texts = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    ).withColumn("tid", F.coalesce(F.unhex(F.md5("text")), F.lit(b"")))
    kinds = written(texts.groupBy("tid").agg(F.min("doc_id").alias("doc"), F.count("*").alias("copies")), "texts")
    places = written(texts.select("tid", "text").mapInArrow(_find(length, words), FOUND), "places")
    # An anchor in one text only, once, has no repeated window unless the text has copies, which go whole.
    # Keys with two places are a table, not an aggregate: Spark splits a skewed side only in joins of two plain exchanges.
    one = F.xxhash64("tid", "place")
    keys = written(places.groupBy("key").agg(F.min(one).alias("a"), F.max(one).alias("b")).filter("a != b").select("key"), "keys")
    found = places.join(keys, "key", "left_semi").join(kinds, "tid")
    found = written(found.dropDuplicates(["tid", "key", "context", "place"]), "anchors")
    where = F.struct(F.col("doc").isNull().alias("none"), "doc", "tid", "place")
    contexts = written(
        found.groupBy("key", "context").agg(F.sum("copies").alias("weight"), F.count("*").alias("seen"), F.min(where).alias("least")),
        "contexts",
    )
    shared = written(contexts.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "shared")
    hot = shared.filter(F.col("n") > HOT).select(F.col("key").alias("part"), F.lit(length - anchor_size(length)).alias("wide"))
    wanted = contexts.join(shared, "key", "left_semi").groupBy(F.col("least.tid").alias("tid"), F.col("least.doc").alias("doc")).agg(
        F.collect_list(F.struct("key", "context", F.col("least.place").alias("place"), "weight")).alias("wanted")
    )
    # Of the rows of one text the first; as a difference, so that the join's key stays tid alone.
    least_id = F.lit(-(2**63))
    first_row = F.coalesce("doc_id", least_id).bitwiseXOR(F.coalesce("doc", least_id)) == 0
    held = texts.join(wanted, "tid").filter(first_row)
    parts = _gathered(held.select("doc", "tid", "text", "wanted").mapInArrow(_cut(length, words), CONTEXT), hot, length, first, words)
    # All of a context is repeated where it occurs again: everywhere, or at all but its first occurrence; else what `parts` has of it.
    cuts = parts.groupBy("key", "context").agg(F.collect_list(F.struct("start", "stop")).alias("cuts"))
    known = contexts.join(cuts, ["key", "context"], "left").filter("weight > 1 OR cuts IS NOT NULL")
    known = written(known.select("key", "context", "least", "weight", "cuts"), "known")
    again = (where != F.col("least")) if first else F.col("weight") > 1
    lo, count = F.expr(LO.format("place")).cast("int"), F.expr(COUNT.format("place")).cast("int")
    whole = F.array(F.struct(lo.alias("start"), (lo + count + (length - 1)).alias("stop")))
    some = F.transform("cuts", lambda c: F.struct((lo + c["start"]).alias("start"), (lo + c["stop"]).alias("stop")))
    spans = found.join(known, ["key", "context"]).select("tid", F.inline(F.when(again, whole).otherwise(some)))
    if not first:
        # A text of several rows goes whole: each of its windows starts in another row too.
        whole = texts.filter(F.octet_length("text") >= length).join(kinds.filter("copies > 1"), "tid", "left_semi")
        spans = spans.unionByName(whole.select("tid", F.lit(0).alias("start"), F.octet_length("text").alias("stop")).distinct())
    # Spans that touch are one before they are gathered: a periodic text has a span for each of its anchors.
    line = Window.partitionBy("tid").orderBy("start", "stop")
    reach = F.max("stop").over(line.rowsBetween(Window.unboundedPreceding, -1))
    islands = spans.withColumn("new", F.coalesce((F.col("start") > reach).cast("int"), F.lit(1))).withColumn("island", F.sum("new").over(line))
    runs = islands.groupBy("tid", "island").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    return texts, runs.groupBy("tid").agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("spans"))


def kept_parts(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    at, parts = 0, []
    for a, b in spans:
        parts.append(raw[at:a])
        at = b
    return b"".join([*parts, raw[at:]])


def word_stretches(raw: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Bytes of runs of words [start, stop), each up to the next word or the text's end."""
    starts = np.concatenate((word_bounds(raw)[0], [len(raw)])).tolist()
    return [(starts[a], starts[min(b, len(starts) - 1)]) for a, b in spans]


DIGEST = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string"


def digest(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """DIGEST of every row with all repeated windows removed. kept_text leaves out the bytes of characters that are cut in part."""
    with shuffles_dropped(docs.sparkSession):
        texts, spans = find_spans(docs, length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for doc, text, found in zip(*(batch[c].to_pylist() for c in ("doc_id", "text", "spans")), strict=True):
                raw, gone = text.encode(), [(x["start"], x["stop"]) for x in found or []]
                kept = kept_parts(raw, gone)
                rows.append((doc, len(raw), len(raw) - len(kept), len(gone), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore")))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"],
            )

    return texts.join(spans, "tid", "left").select("doc_id", "text", "spans").mapInArrow(run, DIGEST)


def remove_copies(docs: DataFrame, length: int = PASSAGE_WORDS, words: bool = True) -> DataFrame:
    """`docs` with later copies of repeated passages cut from `text` and the first kept; same columns and rows.

    What goes: every run of words (or, without `words`, of bytes) that windows of `length` of them with an earlier copy cover. n_chars,
    where the input has it, counts the new text. Bytes of a character that is cut in part go with it.
    """
    _, spans = find_spans(docs, length, first=True, words=words)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    tid, doc, gone = (free_name(docs, c) for c in ("tid_of", "doc_of", "spans_of"))
    whole = docs.withColumn(tid, F.unhex(F.md5(text)))
    ids = whole.groupBy(tid).agg(F.min(F.col("doc_id").cast("long")).alias(doc))
    facts = written(ids.join(spans.select(F.col("tid").alias(tid), F.col("spans").alias(gone)), tid, "left"), "facts")
    later = ~F.col("doc_id").cast("long").eqNullSafe(F.col(doc)) & (F.octet_length(text) >= length)
    # A later row of a text is one run from end to end, if it is long enough.
    end = F.lit(2**31 - 1)
    spans = F.when(later, F.array(F.struct(F.lit(0).alias("start"), end.alias("stop")))).otherwise(F.col(gone))
    joined = whole.join(facts, tid).withColumn(gone, spans)

    @F.arrow_udf("string")
    def cut(texts: pa.Array, spans: pa.Array) -> pa.Array:
        out = []
        for t, g in zip(texts, spans, strict=True):
            raw = t.as_py().encode()
            runs = [(x["start"], x["stop"]) for x in g.as_py()]
            if words:
                n = len(word_bounds(raw)[0])
                runs = word_stretches(raw, [(a, min(b, n)) for a, b in runs if min(b, n) - a >= length])
            out.append(kept_parts(raw, [(a, min(b, len(raw))) for a, b in runs]).decode("utf-8", "ignore"))
        return pa.array(out, pa.string())

    touched = F.col(gone).isNotNull() & (text != "")
    out = joined.filter(~touched).unionByName(joined.filter(touched).withColumn("text", cut(text, F.col(gone))))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length(F.coalesce("text", F.lit(""))).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
