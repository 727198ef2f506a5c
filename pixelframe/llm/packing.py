"""Best-fit packing of token pieces into sequences of fixed room.

Pieces of one length are interchangeable, so the instance is its histogram of lengths: at most
`room` counts, however many documents there are. `reduce_instance` fixes the sets that dominate
all alternatives (Martello and Toth's criterion: a piece alone if nothing fits beside it, two
that fill the room exactly, a piece with the longest partner where no three fit) and `best_fit`
packs the rest; both work on counts and give patterns with multiplicities. Spark then ranks the
pieces within each length and deals them to the patterns' places.

Defined results. Null and empty texts are one piece: the end mark. Repeated rows are packed as
often as they come. Null ids stay null. An empty table gives an empty table.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import slices, slots, written

ROOM = 1024
END_ID = 2
VOCABULARY = "byte_bpe_50k"
#: Size up to which the plan's places are broadcast.
BROADCAST_BYTES = 32 << 20
#: Cached words a Python worker holds at most; the cache is then emptied.
CACHE_WORDS = 150_000


class Encoder:
    """Ids of a byte-level BPE, by `tiktoken` over the ranks of the same vocabulary, word by word with a cache: the ids that
    `tokenizers` gives for the vocabulary's .json file, which tests compare on hostile white space and special tokens.

    Pre-tokens never span a blank that has a character other than white space on both sides, so a
    text is the concatenation of its blank-parted words, each encoded with the blank before it.
    Texts with other runs of white space next to blanks are encoded whole; texts with the special
    token's string by `tokenizers`, which reads it as that token.
    """

    SPECIAL = "<|endoftext|>"

    def __init__(self, name: str = VOCABULARY) -> None:
        import base64

        import public_tokenizers
        import tiktoken

        with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bpe = tiktoken.Encoding(
            name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
        )
        self.json = public_tokenizers.path(f"{name}.json")
        self.first: dict[str, bytes] = {}
        self.later: dict[str, bytes] = {}

    def _new(self, cache: dict[str, bytes], key: str, text: str) -> bytes:
        if len(cache) >= CACHE_WORDS:
            cache.clear()
        cache[key] = out = np.array(self.bpe.encode_ordinary(text), "<u4").tobytes()
        return out

    def __call__(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if self.SPECIAL in text:
            return np.array(special_tokenizer(self.json).encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        head, *tail = text.split(" ")
        if any(not w or w[0].isspace() for w in tail):
            return np.array(self.bpe.encode_ordinary(text), "<u4").tobytes()
        known, new = self.later, self._new
        out = [self.first.get(head) or new(self.first, head, head)] if head else []
        out += [known.get(w) or new(known, w, " " + w) for w in tail]
        return b"".join(out)


@lru_cache(1)
def encoder(name: str) -> Encoder:
    return Encoder(name)


@lru_cache(1)
def special_tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, room: int = ROOM, name: str = VOCABULARY) -> DataFrame:
    """PIECES of every document: ids and END_ID, cut to `room` from the end, so that only a first piece may be shorter."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(name), np.array([END_ID], "<u4").tobytes()
        for batch in slices(batches):
            rows: list[tuple] = []
            for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                ids = encode(text or "") + end
                total = len(ids) // 4
                at = 0
                for k in range(-(-total // room)):
                    to = at + ((total % room or room) if k == 0 else room)
                    rows.append((doc, k, at, to - at, zlib.crc32(ids[4 * at : 4 * to])))
                    at = to
            columns = list(zip(*rows, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, PIECES)


Pattern = tuple[tuple[int, ...], int]


def reduce_instance(counts: dict[int, int], room: int) -> tuple[list[Pattern], dict[int, int]]:
    """Dominating sets as patterns (lengths, how often), and the counts left over."""
    left = {k: n for k, n in counts.items() if n > 0}
    fixed: list[Pattern] = []

    def fix(lengths: tuple[int, ...], times: int) -> None:
        fixed.append((lengths, times))
        for x in lengths:
            left[x] -= times
            if not left[x]:
                del left[x]

    for x in sorted(left, reverse=True):
        y = room - x
        if x not in left:
            continue
        if y == 0:
            fix((x,), left[x])
        elif y == x:
            if left[x] > 1:
                fix((x, x), left[x] // 2)
        elif y < x and y in left:
            fix((x, y), min(left[x], left[y]))
    while left:
        sizes = sorted(left)
        x, free = sizes[-1], room - sizes[-1]
        least = sizes[0]
        if 2 * x > room and least > free:
            fix((x,), left[x])
            continue
        second = least if left[least] > 1 else sizes[1] if len(sizes) > 1 else room
        if 2 * x <= room or least + second <= free:
            break
        y = sizes[bisect_right(sizes, free) - 1]
        fix((x, y), min(left[x], left[y]))
    return fixed, left


def best_fit(counts: dict[int, int], room: int) -> list[Pattern]:
    """Best-fit decreasing on counts: bins that hold the same lengths are kept as one pattern with a multiplicity."""
    open_bins: list[tuple[int, tuple[int, ...], int]] = []  # free room ascending
    done: list[Pattern] = []
    for x in sorted(counts, reverse=True):
        n = counts[x]
        while n:
            at = bisect_right(open_bins, (x - 1, (room + 1,), 0))
            if at == len(open_bins):
                per = room // x
                full, rest = divmod(n, per)
                for size, times in ((per, full), (rest, 1)):
                    if size and times:
                        insort(open_bins, (room - size * x, (x,) * size, times))
                n = 0
                continue
            free, held, times = open_bins.pop(at)
            per = free // x
            use = min(times, n // per)
            if use:
                insort(open_bins, (free - per * x, held + (x,) * per, use))
                n -= use * per
                if times > use:
                    insort(open_bins, (free, held, times - use))
            else:
                insort(open_bins, (free - n * x, held + (x,) * n, 1))
                if times > 1:
                    insort(open_bins, (free, held, times - 1))
                n = 0
    done += [(held, times) for _, held, times in open_bins]
    return done


def plan(counts: dict[int, int], room: int = ROOM) -> list[Pattern]:
    fixed, left = reduce_instance(counts, room)
    return fixed + best_fit(left, room)


def pack(parts: DataFrame, room: int = ROOM) -> DataFrame:
    """`parts` (PIECES, each of at most `room`) with sequence_id and offset (long).

    The histogram of at most `room` rows is all that the driver sees. Ranks within a length come
    from counts by (length, slice) and row numbers within a slice, so a length that many pieces
    share is spread over all slices.
    """
    spark = parts.sparkSession
    n = slots(spark)
    parts = parts.withColumn("slice", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(n)).cast("int"))
    by_slice = parts.groupBy("length", "slice").agg(F.count("*").alias("n"))
    counts = {r["length"]: r["n"] for r in by_slice.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    # A place: pieces of this length with ranks from `lo` to below `hi` go to sequences `first` and on, at `offset`.
    places, sequence, used = [], 0, dict.fromkeys(counts, 0)
    for lengths, times in plan(counts, room):
        offset = 0
        for x in lengths:
            places.append((x, used[x], used[x] + times, sequence, offset))
            used[x] += times
            offset += x
        sequence += times
    runs: dict[int, list] = {}
    for x, lo, hi, first, offset in places:
        runs.setdefault(x, []).append((lo, hi, first, offset))
    table = spark.createDataFrame(
        [(x, v) for x, v in runs.items()],
        "length long, places array<struct<lo:long,hi:long,first:long,offset:long>>",
    )
    # A place takes some 40 bytes; a table beyond the bound is joined by its key.
    if 40 * len(places) <= BROADCAST_BYTES:
        table = F.broadcast(table)
    before = Window.partitionBy("length").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    bases = by_slice.select("length", "slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("length", "slice").orderBy("doc_id", "piece", "ids_crc32")
    ranked = (
        parts.withColumn("inside", F.row_number().over(inside) - 1)
        .join(bases, ["length", "slice"])
        .join(table, "length")
        .withColumn("rank", F.col("base") + F.col("inside"))
    )
    place = F.get(F.filter("places", lambda p: (p["lo"] <= F.col("rank")) & (F.col("rank") < p["hi"])), F.lit(0))
    return (
        ranked.withColumn("place", place)
        .withColumn("sequence_id", F.col("place.first") + F.col("rank") - F.col("place.lo"))
        .withColumn("offset", F.col("place.offset"))
        .select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
    )


def pack_documents(docs: DataFrame, room: int = ROOM, name: str = VOCABULARY) -> DataFrame:
    """Tokenizes once, into a table of pieces in the shared folder, and packs that."""
    return pack(written(pieces(docs, room, name), "pieces"), room)
