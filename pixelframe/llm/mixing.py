"""Mixing sources to target weights by iterative proportional fitting.

Token weights are summed into cells of (source, lang, topic). Each round scales the cells so that the
sums by source, then by language, then by topic meet their targets, until no marginal is off by more
than `tolerance` or `rounds` are done. A cell's calibrated weight over its share of the tokens is its rate. Documents are
sampled with probabilities in proportion to their cell's rate, 1 at most; 1 stands for the rate that cells with `SLACK`
of all tokens exceed, so that a tiny cell does not thin out the whole sample, and marginals are short of their
targets by no more than those cells. A document is kept if a hash of its id, text and the seed falls below its
cell's probability: the decision does not depend on partitions or on reruns. No document is drawn twice.
`kept_share` gives what a mix leaves of the corpus.

Targets come from a table (dimension, value, share). Values that it does not name have tempered shares,
n ** temper over their sum, scaled to what the named ones leave.

Topics are those of a model: k-means over hashed words (log counts by inverse document frequency, unit length, less the
mean of the document's language, so that topics are not languages), fitted on all documents: each round adds up sums of fixed
size over them, in whole numbers, so that the model does not depend on partitions. Languages have their means by LANGS hash
values, null one of its own. The model is a few matrices of fixed size; every document is assigned by it.

Skew: rows are aggregated to cells before any exchange; rounds work on cells, in Spark.

Defined results. Null source or lang is a value of its own. Documents without words have weight 0, topic `none`
and their cell's probability; a cell without any words has probability 1. Repeated rows share a decision.
An empty table gives an empty table. `sampled` keeps all columns as they are, whatever their names.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from .common import BLOCK, free_name, slices, written
from .minhash import lower_bytes, word_hashes

DIMENSIONS = ("source", "lang", "topic")
TEMPER, ROUNDS, TOLERANCE, SEED = 0.9, 50, 1e-6, 17
#: Share of the tokens in cells whose rate may exceed the one that stands for probability 1.
SLACK = 0.02
#: Hashed-word features, slots of hashed languages, topics, rounds of k-means and planes that they begin with.
FEATURES, LANGS, TOPICS, FITS, PLANES = 256, 256, 6, 15, 6
#: Features are whole numbers of this part of 1; rows of a step.
SCALE, ROWS = 4096, 2048
#: Target shares of the query and the pipeline: (dimension, value, share).
TARGETS = [("lang", "en", 0.57), ("lang", "fr", 0.16), ("lang", "de", 0.16), ("lang", "es", 0.11)]


def word_counts(texts: list[str | None]) -> np.ndarray:
    """Words of each text by FEATURES hash values."""
    raw = [(t or "").encode() for t in texts]
    ends = np.cumsum([len(r) + 1 for r in raw])
    starts, word = word_hashes(lower_bytes(b"\n".join(raw) + b"\n"))
    at = np.searchsorted(ends, starts, "right") * FEATURES + (word % np.uint64(FEATURES)).astype(np.int64)
    return np.bincount(at, minlength=len(raw) * FEATURES).reshape(len(raw), FEATURES)


def slots_of(langs: list[str | None]) -> np.ndarray:
    """The slot of each language's name, the last one for null."""
    slot = {lang: LANGS if lang is None else crc32(lang.encode()) % LANGS for lang in set(langs)}
    return np.array([slot[lang] for lang in langs], np.int64)


def directions_of(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Weighted log counts of unit length, in whole SCALE-ths: their sums are exact, whatever the partitions."""
    x = np.log1p(counts) * idf
    return np.rint(x * (SCALE / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-12)))


@dataclass(frozen=True)
class Topics:
    """A fitted model: weights of the features, means by slot of languages and centres, the most frequent first. Means and centres are whole numbers."""

    idf: np.ndarray
    means: np.ndarray
    centres: np.ndarray

    def assign(self, counts: np.ndarray, langs: list[str | None]) -> list[str]:
        near = nearest(directions_of(counts, self.idf) - self.means[slots_of(langs)], self.centres)
        return [f"t{k}" if n else "none" for k, n in zip(near.tolist(), counts.sum(1).tolist(), strict=True)]


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest centre of each row; products of whole numbers below 2**53 are exact, so batches of other sizes decide alike."""
    return (x @ centres.T - (centres**2).sum(1) / 2).argmax(1)


def added(x: np.ndarray, groups: np.ndarray, n: int) -> np.ndarray:
    """Sums of the rows of each of n groups, with their number as a last column."""
    out = np.zeros((n, x.shape[1] + 1), np.int64)
    for k in np.unique(groups):
        out[k] = [*x[groups == k].sum(0), (groups == k).sum()]
    return out


def means_of(sums: np.ndarray) -> np.ndarray:
    """Mean of each group of `added`, rounded; 0 for one without rows."""
    return np.rint(sums[:, :-1] / np.maximum(sums[:, -1:], 1))


#: Of (rows, slots) the sums of a pass over all documents.
Step = Callable[[np.ndarray, np.ndarray], np.ndarray]


def idf_of(present: np.ndarray) -> np.ndarray:
    """Weights by the number of documents with each feature, and of all as a last value."""
    return np.log((1 + present[-1]) / (1 + present[:-1])) + 0.1


def presence(counts: np.ndarray, slots: np.ndarray) -> np.ndarray:
    return added((counts > 0).astype(np.int64), np.zeros(len(counts), np.int64), 1)


def clustered(summed: Callable[[Step, int], np.ndarray], topics: int) -> tuple[np.ndarray, np.ndarray]:
    """Means by slot and centres by k-means, where `summed` adds up what a step makes of all directions_of documents.

    Rounds begin at means of documents that are on one side of PLANES fixed planes: the largest one first, then the one that is
    farthest from those before, by distance times documents. A centre without documents stays where it is.
    """
    by_slot = summed(lambda x, slots: added(x, slots, LANGS + 1), LANGS + 1)
    means = np.where(by_slot[:, -1:] > 0, means_of(by_slot), means_of(by_slot.sum(0, keepdims=True))).astype(np.int16)
    planes = np.random.RandomState(SEED).choice([-1.0, 1.0], (FEATURES, PLANES))
    sides = 2 ** np.arange(PLANES)
    cells = summed(lambda x, slots: added(y := x - means[slots], (y @ planes > 0) @ sides, 2**PLANES), 2**PLANES)
    cells = cells[cells[:, -1] > 0]
    starts = means_of(cells)
    centres = starts[cells[:, -1].argmax()][None] if len(cells) else np.zeros((1, FEATURES))
    while len(centres) < min(topics, len(cells)):
        away = np.min([((starts - c) ** 2).sum(1) for c in centres], axis=0) * cells[:, -1]
        centres = np.vstack([centres, starts[away.argmax()]])
    for _ in range(FITS):
        sums = summed(lambda x, slots, at=centres: added(y := x - means[slots], nearest(y, at), len(at)), len(centres))
        before, centres = centres, np.where(sums[:, -1:] > 0, means_of(sums), centres)
        if (before == centres).all():
            break
    return means, centres[np.argsort(-sums[:, -1], kind="stable")]


def fit(counts: np.ndarray, langs: list[str | None], topics: int = TOPICS) -> Topics:
    """The model of documents given as arrays."""
    slots = slots_of(langs)
    idf = idf_of(presence(counts, slots)[0])
    x = directions_of(counts, idf)
    return Topics(idf, *clustered(lambda step, n: step(x, slots), topics))


def _blocks(texts: pa.Array) -> list[tuple[int, int]]:
    """Ranges of rows of about BLOCK bytes of text."""
    out, at, size = [], 0, 0
    for k, t in enumerate(texts):
        size += len(t.as_buffer() or b"")
        if size >= BLOCK:
            out.append((at, k + 1))
            at, size = k + 1, 0
    return [*out, (at, len(texts))] if at < len(texts) else out


def _summed(rows: DataFrame, kind: str, step: Step, n: int) -> np.ndarray:
    """What `step` makes of all rows(slot, x), x being the bytes of FEATURES numbers: added up in each task, then by cell in Spark."""

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((n, FEATURES + 1), np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                x = np.frombuffer(b"".join(part["x"].to_pylist()), kind).reshape(-1, FEATURES).astype(np.float64)
                total += step(x, part["slot"].to_numpy())
        cells = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(total.ravel()[cells])], ["cell", "value"])

    out = np.zeros(n * (FEATURES + 1), np.int64)
    for r in rows.select("slot", "x").mapInArrow(tasks, "cell long, value long").groupBy("cell").agg(F.sum("value").alias("value")).collect():
        out[r["cell"]] = r["value"]
    return out.reshape(n, FEATURES + 1)


def fitted_topics(docs: DataFrame, topics: int = TOPICS) -> Topics:
    """The topic model of all docs(text, lang). Each pass over them sends the driver sums of fixed size, at most (LANGS + 1) * (FEATURES + 1)."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            counts = word_counts(batch["text"].to_pylist()).astype("<u4")
            yield pa.RecordBatch.from_arrays([pa.array(slots_of(batch["lang"].to_pylist())), pa.array([c.tobytes() for c in counts], pa.binary())], ["slot", "x"])

    texts = docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    counts = written(texts.mapInArrow(counted, "slot long, x binary"), "word-counts")
    idf = idf_of(_summed(counts, "<u4", presence, 1)[0])

    def directed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.frombuffer(b"".join(batch["x"].to_pylist()), "<u4").reshape(-1, FEATURES)
            for at in range(0, len(x), ROWS):
                made = directions_of(x[at : at + ROWS], idf).astype("<i2")
                yield pa.RecordBatch.from_arrays([batch["slot"].slice(at, ROWS), pa.array([v.tobytes() for v in made], pa.binary())], ["slot", "x"])

    rows = written(counts.mapInArrow(directed, "slot long, x binary"), "directions")
    return Topics(idf, *clustered(lambda step, n: _summed(rows, "<i2", step, n), topics))


def measure(model: Topics) -> Callable[[Column, Column], Column]:
    """(text, lang) to struct n_tokens, topic."""
    kind = pa.struct([("n_tokens", pa.int64()), ("topic", pa.string())])

    @F.arrow_udf("n_tokens long, topic string")
    def measured(texts: pa.Array, langs: pa.Array) -> pa.Array:
        n, topic = [], []
        for a, b in _blocks(texts):
            counts = word_counts(texts[a:b].to_pylist())
            n += counts.sum(1).tolist()
            topic += model.assign(counts, langs[a:b].to_pylist())
        return pa.array([{"n_tokens": x, "topic": t} for x, t in zip(n, topic, strict=True)], kind)

    return lambda text, lang: measured(text.cast("string"), lang.cast("string"))


def chance(doc_id: Column, text: Column, seed: int = SEED) -> Column:
    """A number in [0, 1) that depends on the document and the seed alone."""
    return F.shiftrightunsigned(F.xxhash64(doc_id, text, F.lit(seed)), 11) / F.lit(float(2**53))


def cells_of(facts: DataFrame) -> DataFrame:
    return facts.groupBy(*DIMENSIONS).agg(F.sum("n_tokens").cast("double").alias("tokens"))


def tempered(cells: DataFrame, dimension: str, temper: float = TEMPER) -> DataFrame:
    """value and share of one marginal, n ** temper over their sum."""
    sums = cells.groupBy(F.col(dimension).alias("value")).agg(F.sum("tokens").alias("n")).filter("n > 0")
    total = sums.agg(F.sum(F.pow("n", F.lit(temper)))).head()[0] or 1.0
    return sums.select("value", (F.pow("n", F.lit(temper)) / F.lit(total)).alias("share"))


def with_named(shares: DataFrame, named: DataFrame) -> DataFrame:
    """`shares` with those of `named`(value, share) in place; the rest is scaled to what they leave. Without a rest the named ones that
    occur are scaled to 1."""
    both = shares.join(named.select(F.col("value").alias("v"), F.col("share").alias("s")), F.col("value").eqNullSafe(F.col("v")), "left")
    fixed, rest = both.agg(F.sum("s"), F.sum(F.when(F.col("s").isNull(), F.col("share")))).head()
    scale = max(0.0, 1 - (fixed or 0.0)) / rest if rest else 1.0
    total = (fixed or 0.0) + scale * (rest or 0.0) or 1.0
    return both.select("value", (F.coalesce("s", F.col("share") * F.lit(scale)) / F.lit(total)).alias("share"))


def rake(cells: DataFrame, targets: dict[str, DataFrame], rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    """`cells` with `weight`: shares of the whole whose marginals meet the targets (value, share) by dimension.

    `marginal_error` is what remains after the last round; more than `tolerance` warns.
    """
    total = cells.agg(F.sum("tokens")).head()[0] or 1.0
    now = cells.filter("tokens > 0").withColumn("weight", F.col("tokens") / F.lit(total))
    for name, target in targets.items():
        goal = target.select(F.col("value").alias("v"), F.col("share").alias(f"share_{name}"))
        now = now.join(goal, F.col(name).eqNullSafe(F.col("v"))).drop("v")
    now = written(now, "cells")
    before = float("inf")
    for _ in range(rounds):
        off = F.lit(0.0)
        for name in targets:
            factor = now.groupBy(F.col(name).alias("v")).agg((F.max(f"share_{name}") / F.sum("weight")).alias("f"))
            now = now.join(factor, F.col(name).eqNullSafe(F.col("v"))).withColumn("weight", F.col("weight") * F.col("f"))
            now = now.withColumn("off", F.greatest(off, F.abs(F.col("f") - 1))).drop("v", "f")
            off = F.col("off")
        seen = Observation()
        now = written(now.observe(seen, F.max("off").alias("off")), "raked").drop("off")
        worst = seen.get["off"]
        # Targets that contradict each other stop improving.
        if worst is None or worst <= tolerance or worst > 0.999 * before:
            break
        before = worst
    now = now.drop(*(f"share_{name}" for name in targets))
    error = marginal_error(now, targets)
    if error > tolerance:
        warnings.warn(f"marginals miss their targets by up to {error:.3g} after {rounds} rounds", RuntimeWarning, stacklevel=2)
    return now.withColumn("marginal_error", F.lit(error))


def marginal_error(cells: DataFrame, targets: dict[str, DataFrame]) -> float:
    """The greatest difference of a marginal's weight from its target, relative to the target; 1 for a target without cells."""
    worst = 0.0
    for name, target in targets.items():
        sums = cells.groupBy(F.col(name).alias("v")).agg(F.sum("weight").alias("s"))
        miss = F.abs(F.coalesce("s", F.lit(0.0)) / F.col("share") - 1)
        worst = max(worst, target.filter("share > 0").join(sums, F.col("v").eqNullSafe(F.col("value")), "left").agg(F.max(miss)).head()[0] or 0.0)
    return worst


def probabilities(cells: DataFrame, slack: float = SLACK) -> DataFrame:
    """Cells with `rate` (calibrated weight over share of tokens), `probability` and `marginal_error`."""
    total = cells.agg(F.sum("tokens")).head()[0] or 1.0
    rated = written(cells.withColumn("rate", F.col("weight") / F.col("tokens") * F.lit(total)), "rates")
    # The rate that cells with a share `slack` of the tokens exceed: sums above 64 bounds, twice, and no order of all cells.
    low, top = 0.0, rated.agg(F.max("rate")).head()[0] or 1.0
    for _ in range(2):
        bounds = [low + (top - low) * k / 64 for k in range(65)]
        above = rated.agg(*(F.sum(F.when(F.col("rate") > b, F.col("tokens")).otherwise(0.0)) for b in bounds[1:-1])).head()
        k = next((k for k, n in enumerate(above, 1) if (n or 0.0) <= slack * total), 64)
        low, top = bounds[k - 1], bounds[k]
    return rated.select(*DIMENSIONS, "rate", F.least(F.lit(1.0), F.col("rate") / F.lit(top)).alias("probability"), "marginal_error")


def targets_of(spark_rows: DataFrame | None) -> dict[str, DataFrame]:
    """Named shares (value, share) by dimension, of a table (dimension, value, share)."""
    if spark_rows is None:
        return {}
    return {d: spark_rows.filter(F.col("dimension") == d).select("value", "share") for d in DIMENSIONS}


def calibrated(facts: DataFrame, targets: DataFrame | None = None, temper: float = TEMPER) -> DataFrame:
    """DIMENSIONS, rate, probability and marginal_error of every cell of facts(source, lang, topic, n_tokens)."""
    cells = written(cells_of(facts), "counts")
    named, goals = targets_of(targets), {}
    for name in DIMENSIONS:
        goals[name] = tempered(cells, name, temper)
        if name in named:
            goals[name] = with_named(goals[name], named[name])
        goals[name] = written(goals[name], "target")
    return written(probabilities(rake(cells, goals)), "probabilities")


def mix(docs: DataFrame, targets: DataFrame | None = None, temper: float = TEMPER) -> DataFrame:
    """doc_id, source, lang, topic, n_tokens, rate, probability and kept for every row of docs(doc_id, text, source, lang)."""
    measured = measure(fitted_topics(docs))
    keys = [F.col(c).cast("string").alias(c) for c in ("source", "lang")]
    u = chance(F.col("doc_id"), F.col("text")).alias("u")
    facts = written(docs.select("doc_id", *keys, u, measured(F.col("text"), F.col("lang")).alias("m")).select("doc_id", "source", "lang", "u", "m.*"), "facts")
    found = calibrated(facts, targets, temper).select(*(F.col(c).alias(f"of_{c}") for c in DIMENSIONS), F.col("rate").alias("r"), F.col("probability").alias("p"))
    on = [F.col(c).eqNullSafe(F.col(f"of_{c}")) for c in DIMENSIONS]
    p = F.coalesce("p", F.lit(1.0))
    return facts.join(found, on[0] & on[1] & on[2], "left").select(
        "doc_id", *DIMENSIONS, "n_tokens", F.coalesce("r", F.lit(0.0)).alias("rate"), p.alias("probability"), (F.col("u") < p).alias("kept")
    )


def sampled(docs: DataFrame, targets: DataFrame | None = None, temper: float = TEMPER) -> DataFrame:
    """The rows of `docs` that `mix` keeps, columns as they were."""
    measured = measure(fitted_topics(docs))
    m = free_name(docs, "measured")
    held = {c: free_name(docs, f"of_{c}") for c in (*DIMENSIONS, "probability")}
    keyed = docs.withColumn(m, measured(F.col("text"), F.col("lang")))
    keys = {"source": F.col("source").cast("string"), "lang": F.col("lang").cast("string"), "topic": F.col(m)["topic"]}
    found = calibrated(keyed.select(*(k.alias(c) for c, k in keys.items()), F.col(m)["n_tokens"].alias("n_tokens")), targets, temper)
    found = found.select(*(F.col(c).alias(name) for c, name in held.items()))
    on = [keys[c].eqNullSafe(F.col(held[c])) for c in DIMENSIONS]
    out = keyed.join(found, on[0] & on[1] & on[2], "left")
    return out.filter(chance(F.col("doc_id"), F.col("text")) < F.coalesce(held["probability"], F.lit(1.0))).select(*docs.columns)


def kept_share(mixed: DataFrame) -> DataFrame:
    """Of the result of `mix`: documents, kept_documents, and the expected shares of documents and of tokens that are kept."""
    return mixed.agg(
        F.count("*").alias("documents"), F.count_if("kept").alias("kept_documents"), F.avg("probability").alias("expected_documents"),
        (F.sum(F.col("probability") * F.col("n_tokens")) / F.sum("n_tokens")).alias("expected_tokens"),
    )
