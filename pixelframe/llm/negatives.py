"""Hard negatives by shared candidate lists of anchor clusters (MAXIMUS-style maximum inner product search).

Anchors are clustered by direction. For a cluster whose members lie within the angle t of its centroid, no member's product with
a candidate exceeds |member| |candidate| cos(max(0, a - t)), where a is the candidate's angle to the centroid. A task sorts its
candidates once for each cluster by that bound; every member walks the list in blocks and stops
where the bound falls below what it still looks for: its fifth best positive, then the least of what its positives' bands can still take.
What ends a walk is a proof, so results are exact whatever the clusters are; these only set how far members walk.

Candidates are dealt to groups of GROUP_BYTES and meet the anchors there in tiles (group of candidates by group of
clusters): an anchor travels once for each group of candidates, a candidate to at most SPREAD tiles. A cluster of over MEMBERS anchors is parted. A
tile's results are the best few of each anchor, merged by a ranking window whose limit Spark applies before the exchange.
Centroids are fitted on the SAMPLE anchors of least hash; every anchor is assigned.

Defined results. Rows with a null id, label or vector, or with a component that is null or not finite, take no part. Of vectors of different
length the shorter counts as padded with zeros; a vector of zeros has the product 0 with all. Rows that
repeat an id are different rows: each is an anchor of its own, and of equal scores and ids one row
comes first, by its place in a written table. Fewer rows than asked for give fewer; an empty table gives an empty table. Products beyond 64 bits raise.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import slots, written
from .minhash import by_group, starts_of

#: Bytes of the candidates' components in one task; anchors of one list; tiles that a candidate goes to at most.
GROUP_BYTES, MEMBERS, SPREAD = 32 << 20, 512, 8
#: Anchors that the centroids are fitted on, how many centroids, and rounds.
SAMPLE, CLUSTERS, ROUNDS = 4096, 16, 8
#: Candidates of a list that members look at in one step.
STEP = 512
#: Slack for rounding in bounds.
SLACK = 1e-9

LEAST = np.iinfo(np.int64).min


def integer_vectors(rows: DataFrame) -> DataFrame:
    """row, vec_id, label, v (array<long>, floor(256 x)) of the rows that take part; `row` tells rows apart."""
    odd = F.exists("embedding", lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    kept = rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()).filter(~F.coalesce(odd, F.lit(True)))
    vector = F.transform("embedding", lambda x: F.floor(x.cast("double") * 256).cast("long"))
    return written(
        kept.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("int").alias("label"), vector.alias("v")),
        "vectors",
    )


def matrix(lists: pa.ChunkedArray, width: int) -> np.ndarray:
    """Lists as rows of `width`, padded with zeros."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    size = np.asarray(lists.value_lengths())
    flat = np.asarray(lists.flatten())
    if (size == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(size), width), np.int64)
    out[np.arange(width)[None, :] < size[:, None]] = flat
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    most = a.shape[1] * max(abs(int(a.max())), abs(int(a.min()))) * max(abs(int(b.max())), abs(int(b.min())))
    if most < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if most < 1 << 63:
        return a @ b.T
    return (a.astype(object) @ b.astype(object).T).astype(np.int64)  # raises beyond 64 bits


def centroids(anchors: DataFrame, width: int) -> np.ndarray:
    """Unit vectors by spherical k-means over the SAMPLE anchors of least hash."""
    sample = anchors.orderBy(F.xxhash64("vec_id", "row"), "row").limit(SAMPLE).select("v").toArrow()
    x = matrix(sample["v"], width).astype(np.float64)
    x = x[np.linalg.norm(x, axis=1) > 0] if len(x) else x
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    out = x[: min(CLUSTERS, len(x))].copy()
    for _ in range(ROUNDS):
        best = np.argmax(x @ out.T, axis=1) if len(x) else np.zeros(0, int)
        for k in range(len(out)):
            total = x[best == k].sum(axis=0)
            if np.linalg.norm(total) > 0:
                out[k] = total / np.linalg.norm(total)
    return out if len(out) else np.zeros((1, width))


def _assigned(centers: np.ndarray):
    width = centers.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch["v"], width).astype(np.float64)
            yield batch.append_column("cluster", pa.array(np.argmax(x @ centers.T, axis=1).astype(np.int32)))

    return run


class Candidates:
    """One task's candidates and the list of them for one cluster after the other."""

    def __init__(self, t: pa.Table, width: int):
        self.row, self.id, self.label = (t[c].to_numpy() for c in ("row", "vec_id", "label"))
        self.v = matrix(t["v"], width)
        self.exact = self.v.astype(np.float64)
        self.norm = np.linalg.norm(self.exact, axis=1)

    def sorted_for(self, center: np.ndarray, spread: float) -> tuple[np.ndarray, np.ndarray]:
        """(order, bound by unit member length), the greatest bound first."""
        cosine = np.divide(self.exact @ center, self.norm, out=np.ones(len(self.norm)), where=self.norm > 0)
        angle = np.arccos(np.clip(cosine, -1, 1))
        bound = self.norm * (np.cos(np.maximum(0, angle - spread)) + SLACK)
        order = np.argsort(-bound, kind="stable")
        return order, bound[order]


class Best:
    """The first `n` by falling score, then id, then row, of the offers seen so far that lie in [low, high]."""

    __slots__ = ("found", "high", "low", "n")

    def __init__(self, n: int, low: int = LEAST, high: int | None = None):
        self.n, self.low, self.high, self.found = n, low, high, []

    def offer(self, scores: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        fit = scores >= self.low
        if self.high is not None:
            fit &= scores <= self.high
        if not fit.any():
            return
        new = sorted(zip((-scores[fit]).tolist(), ids[fit].tolist(), rows[fit].tolist(), strict=True))[: self.n]
        self.found = sorted(self.found + new)[: self.n]
        if len(self.found) == self.n:
            self.low = max(self.low, -self.found[-1][0])


def _walk(c: Candidates, members: np.ndarray, center: np.ndarray, wants: list[list[Best]], fits: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> None:
    """Every member walks the cluster's list until no candidate left can enter what it wants."""
    x = members.astype(np.float64)
    length = np.linalg.norm(x, axis=1)
    cosine = np.divide(x @ center, length, out=np.ones(len(x)), where=length > 0)
    order, bound = c.sorted_for(center, float(np.arccos(np.clip(cosine, -1, 1)).max()) + SLACK)
    top = np.iinfo(np.int64).max
    low = np.array([min((b.low for b in w), default=top) for w in wants], np.int64)
    high = np.array([max((top if b.high is None else b.high for b in w), default=LEAST) for w in wants], np.int64)
    for at in range(0, len(order), STEP):
        going = np.flatnonzero((length * bound[at] + 1 >= low) & (high >= low))
        if not len(going):
            return
        there = order[at : at + STEP]
        scores = products(members[going], c.v[there])
        hit = (scores >= low[going, None]) & (scores <= high[going, None]) & fits(going, there)
        for k in np.flatnonzero(hit.any(axis=1)).tolist():
            m, which = int(going[k]), np.flatnonzero(hit[k])
            for b in wants[m]:
                b.offer(scores[k, which], c.id[there[which]], c.row[there[which]])
            low[m] = min(b.low for b in wants[m])


def _tiles(vectors: DataFrame, anchors: DataFrame, centers: np.ndarray, n: int) -> DataFrame:
    """Candidates (kind 0) and anchors (kind 1) of all tiles, sorted by tile, kind, cluster and part."""
    width = centers.shape[1]
    groups = max(1, -(-n * width * 8 // GROUP_BYTES))
    spread = max(1, min(SPREAD, -(-slots(vectors.sparkSession) // groups)))
    sizes = {r["cluster"]: r["n"] for r in anchors.groupBy("cluster").agg(F.count("*").alias("n")).collect()}
    parts = F.element_at(F.create_map(*(F.lit(x) for k in range(len(centers)) for x in (k, -(-sizes.get(k, 1) // MEMBERS)))), F.col("cluster"))
    tile = lambda g, h: (g * spread + h).cast("long").alias("tile")
    extra = [c for c in anchors.columns if c not in ("row", "vec_id", "label", "v", "cluster")]
    g = F.pmod(F.xxhash64("row"), F.lit(groups))
    left = vectors.select("*", g.alias("g"), F.explode(F.sequence(F.lit(0), F.lit(spread - 1))).alias("h")).select(
        tile(F.col("g"), F.col("h")), F.lit(0).alias("kind"), "row", "vec_id", "label", "v", F.lit(-1).alias("cluster"), F.lit(-1).cast("long").alias("part"),
        *(F.lit(None).cast(anchors.schema[c].dataType).alias(c) for c in extra),
    )
    placed = anchors.withColumn("part", F.pmod(F.xxhash64("row"), parts).cast("long"))
    placed = placed.select("*", F.pmod(F.xxhash64("cluster", "part"), F.lit(spread)).alias("h"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"))
    right = placed.select(tile(F.col("g"), F.col("h")), F.lit(1).alias("kind"), "row", "vec_id", "label", "v", "cluster", "part", *extra)
    return left.unionByName(right).repartition("tile").sortWithinPartitions("tile", "kind", "cluster", "part")


KEYS = ["tile", "kind", "cluster", "part"]


def _groups(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[Candidates, pa.Table]]:
    """Each anchor group with its tile's candidates."""
    candidates, of = None, None
    for t in by_group(batches, KEYS):
        starts = starts_of(t, KEYS)
        for a, b in zip(starts, starts[1:], strict=False):
            part = t.slice(a, b - a)
            tile, kind = part["tile"][0].as_py(), part["kind"][0].as_py()
            if kind == 0:
                candidates, of = Candidates(part, width), tile
            elif of == tile:
                yield candidates, part


def _positives(centers: np.ndarray, most: int):
    width = centers.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c, t in _groups(batches, width):
            label, row = t["label"].to_numpy(), t["row"].to_numpy()
            wants = [[Best(most)] for _ in range(t.num_rows)]
            _walk(c, matrix(t["v"], width), centers[t["cluster"][0].as_py()], wants, lambda m, k: (label[m, None] == c.label[k]) & (row[m, None] != c.row[k]))
            out = [(r, -s, i, w) for r, (b,) in zip(row.tolist(), wants, strict=True) for s, i, w in b.found]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], ["anchor", "score", "id", "other"])

    return run


def _negatives(centers: np.ndarray, most: int, low: int, high: int):
    width = centers.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c, t in _groups(batches, width):
            label, row = t["label"].to_numpy(), t["row"].to_numpy()
            positives = t["positives"].to_pylist()
            bands = [[(p["rank"], -(-low * p["score"] // 100), high * p["score"] // 100) for p in ps or []] for ps in positives]
            kept = [[(k, Best(most, a, b)) for k, a, b in band if a <= b] for band in bands]
            _walk(c, matrix(t["v"], width), centers[t["cluster"][0].as_py()], [[b for _, b in x] for x in kept], lambda m, k: label[m, None] != c.label[k])
            out = [(r, k, -s, i, w) for r, x in zip(row.tolist(), kept, strict=True) for k, b in x for s, i, w in b.found]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], ["anchor", "of", "score", "id", "other"])

    return run


def mine(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    vectors: row, vec_id, label, v as `integer_vectors` makes them. An anchor's positives are its best `positives` other rows of its
    label; for each, the best `negatives` rows of other labels with low * p <= 100 * score <= high * p.
    """
    size = vectors.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("v")), F.lit(0)).alias("width")).head()
    width = max(1, size["width"])
    anchors = vectors.filter(is_anchor)
    centers = centroids(anchors, width)
    kinds = "row long, vec_id long, label int, v array<bigint>, cluster int"
    anchors = written(anchors.mapInArrow(_assigned(centers), kinds), "anchors")
    best = _tiles(vectors, anchors, centers, size["n"]).mapInArrow(_positives(centers, positives), "anchor long, score long, id long, other long")
    order = [F.col("score").desc(), "id", "other"]
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("anchor").orderBy(*order))).filter(F.col("rank") <= positives)
    found = written(ranked, "positives")
    lists = found.groupBy(F.col("anchor").alias("row")).agg(F.collect_list(F.struct("rank", "score")).alias("positives"))
    hard = _tiles(vectors, anchors.join(lists, "row"), centers, size["n"]).mapInArrow(_negatives(centers, negatives, low, high), "anchor long, of long, score long, id long, other long")
    hard = hard.withColumn("place", F.row_number().over(Window.partitionBy("anchor", "of").orderBy(*order))).filter(F.col("place") <= negatives)
    named = found.join(anchors.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id")), "anchor").select(
        "anchor", "anchor_id", F.col("rank").cast("long").alias("of"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")
    )
    return hard.join(named, ["anchor", "of"]).select(
        "anchor_id", "positive_id", F.col("place").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )


def relabelled(rows: DataFrame) -> DataFrame:
    """Every seventh id with the next of ten labels."""
    return rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
