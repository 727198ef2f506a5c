"""What the text operators share: table paths, let-bindings, free names, and batches cut by bytes for Python workers."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.durable import written as written

#: The white space that parts words: blank, tab, line feed, vertical tab, form feed, carriage return.
SPACES = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with `value` computed once, however often the body names it.

    Catalyst copies an aliased expression into every place that names it, lambdas included,
    where it would run again for each element. A lambda's argument is never copied.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def without(text: Column, letters: str) -> Column:
    """`text` less the given ASCII characters. A search for each beats `translate`, which looks every character up."""
    for x in letters:
        text = F.replace(text, F.lit(x), F.lit(""))
    return text


def words(text: Column) -> Column:
    """The runs of characters other than SPACES, in order; none for null or blank text."""
    flat = F.coalesce(text, F.lit(""))
    for x in SPACES[1:]:
        flat = F.replace(flat, F.lit(x), F.lit(" "))
    return F.array_remove(F.split(flat, " "), "")


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that `df` does not have yet, in any letter case."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem = f"_{stem}"
    return stem


def slots(spark: SparkSession) -> int:
    """How many parts to split a hot group into: the session's shuffle partitions."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Inside, Spark deletes the shuffle files of a table when the table is written, not when the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


#: Bytes of text that a Python worker turns into arrays at a time; a single longer text is a batch of its own.
BLOCK = 1 << 20


def slices(batches: Iterator[pa.RecordBatch], by: str = "text", size: int = BLOCK) -> Iterator[pa.RecordBatch]:
    """The batches in parts of about `size` bytes of column `by`, so that what is made of texts does not pile up. Memory goes back at the end."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch[by]), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, "right")))
            yield batch.slice(at, to - at)
            at = to
    pa.default_memory_pool().release_unused()
