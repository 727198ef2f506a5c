"""Readers and writers: frames as files and tables, timestamps, summed series; resuming."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.keys import key_prefix
from ..functions.scalars import parse_timestamp


def list_frames(spark: SparkSession, path: str, extensions: list[str]) -> DataFrame:
    """path, modificationTime, length of files with an extension in any case; contents are not read. A missing folder has no files."""
    try:
        files = spark.read.format("binaryFile").load(path).select("path", "modificationTime", "length")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        files = spark.createDataFrame([], "path string, modificationTime timestamp, length long")
    return files.filter(F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1)).isin([e.lower().lstrip(".") for e in extensions])).orderBy("path")


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    """8-bit images: frame_id, height, width, bit_depth, data. The image source keeps a byte of each value, so a 16-bit PNG raises: such
    frames must come as tables.

    Color images come as luminance, 0.299 r + 0.587 g + 0.114 b, rounded in 16-bit fixed point; alpha is ignored.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[pP][nN][gG]").load(path)
    png = F.hex(F.substring("content", 1, 4)) == "89504E47"
    deep = files.filter(png & (F.hex(F.substring("content", 25, 1)) == "10")).select("path").head(1)
    if deep:
        raise ValueError(f"16-bit image: {deep[0][0]}")
    images = spark.read.format("image").load(path).select("image.*").select("origin", "height", "width", "nChannels", "data")
    return images.mapInArrow(_gray, "frame_id string, height int, width int, bit_depth int, data array<int>")


def _gray(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each image's bytes as gray values, an image at a time: Spark cuts the batches by bytes."""
    for batch in batches:
        for k in range(batch.num_rows):
            height, width, channels = (batch[c][k].as_py() for c in ("height", "width", "nChannels"))
            if channels not in (1, 3, 4):
                raise ValueError(f"channels not handled: {channels}")
            v = np.frombuffer(batch["data"][k].as_buffer(), np.uint8).reshape(-1, channels).astype(np.int32)
            if channels > 1:  # blue, green, red, alpha
                v = (v[:, 2] * 19595 + v[:, 1] * 38470 + v[:, 0] * 7471 + 0x8000) >> 16
            data = pa.ListArray.from_arrays(pa.array([0, height * width], pa.int32()), pa.array(v.ravel()))
            yield pa.RecordBatch.from_arrays(
                [batch["origin"].slice(k, 1), *(pa.array([x], pa.int32()) for x in (height, width, 8)), data], ["frame_id", "height", "width", "bit_depth", "data"]
            )


def read_frame_table(spark: SparkSession, path: str) -> DataFrame:
    """Parquet frames; a row whose data does not fill height * width raises."""
    f = spark.read.parquet(path)
    ok = F.size("data") == F.col("height") * F.col("width")
    return f.withColumn("data", F.when(ok, F.col("data")).otherwise(F.raise_error(F.lit("data does not fit height * width"))))


def write_frames(frames: DataFrame, path: str, partition_by: str = "stack_id") -> None:
    if frames.isEmpty():
        raise ValueError("no frames to write")
    frames.write.partitionBy(partition_by).parquet(path)


def read_timestamps(spark: SparkSession, path: str) -> DataFrame:
    """N, actual_time; rows without a number N are skipped, the last of a repeated N stays."""
    raw = spark.read.option("header", True).csv(path)
    if not {"N", "actual_time"} <= set(raw.columns):
        raise ValueError("columns N and actual_time are required")
    t = raw.select(F.col("N").try_cast("int").alias("N"), "actual_time", F.monotonically_increasing_id().alias("_i")).filter("N IS NOT NULL")
    return t.groupBy("N").agg(F.max_by("actual_time", "_i").alias("actual_time"))


def read_sum_series(spark: SparkSession, path: str, brightfield: bool = False) -> DataFrame:
    """idx, value (truncated), ts of a summed series; rows without a number are skipped."""
    raw = spark.read.option("header", True).csv(path)
    value = F.col("sum_optical_density" if brightfield else "sum_brightness").try_cast("double").cast("long")
    ts = parse_timestamp(F.col("actual_time")) if "actual_time" in raw.columns else F.lit(None).cast("timestamp")
    return raw.select(F.col("index").try_cast("int").alias("idx"), value.alias("value"), ts.alias("ts")).filter("idx IS NOT NULL AND value IS NOT NULL")


def write_csv(df: DataFrame, path: str, columns: list[str] | None = None) -> None:
    (df.select(*columns) if columns else df).write.option("header", True).csv(path)


def format_waveform(waveform: DataFrame) -> DataFrame:
    """Fixed columns with fixed digits, as text."""
    digits = {"time_s": "%.5f", "value": "%.6f", "detrended": "%.6f", "wave": "%.6f"}
    return waveform.select("series_id", "idx", *(F.format_string(f, c).alias(c) for c, f in digits.items()), F.col("is_peak").cast("int").alias("is_pulse_peak"))


def skip_existing(source: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return source.join(done.select(key), key, "left_anti")


def resume_from(files: DataFrame, prefix: str, name_col: str = "filename") -> DataFrame:
    """Files from the group `prefix` on: numeric prefixes first, in numeric order, then text; none if no file has the prefix."""
    p = key_prefix(F.col(name_col))
    rank = lambda c: F.struct(c.try_cast("int").isNull().alias("t"), F.coalesce(c.try_cast("int"), F.lit(0)).alias("n"), c.alias("s"))
    if files.filter(p == prefix).isEmpty():
        return files.limit(0)
    return files.filter(rank(p) >= rank(F.lit(prefix)))


def map_frames(frames: DataFrame, fn, schema: str, on_error: str = "raise") -> DataFrame:  # noqa: ANN001
    """`fn` (a dict of a frame to a dict of the result) over all frames; with on_error="null" a failure gives nulls and its text in `error`."""
    import pandas as pd

    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches):  # noqa: ANN001, ANN202
        for pdf in batches:
            rows = []
            for row in pdf.to_dict("records"):
                try:
                    rows.append(fn(row) | {"error": None})
                except Exception as e:
                    if on_error == "raise":
                        raise
                    rows.append({"frame_id": row.get("frame_id"), "error": str(e)})
            yield pd.DataFrame(rows, columns=[*names, "error"])

    return frames.mapInPandas(run, f"{schema}, error string")


def map_stacks(frames: DataFrame, fn, schema: str) -> DataFrame:  # noqa: ANN001
    """`fn` (a pandas table of a stack's frames in order of z to a pandas table) over all stacks."""
    return frames.groupBy("stack_id").applyInPandas(lambda pdf: fn(pdf.sort_values("z")), schema)


def latest(df: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))
    return df.withColumn("_k", rank).filter("_k = 1").drop("_k")
