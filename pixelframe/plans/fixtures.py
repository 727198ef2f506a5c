"""Frames, pixels and series that plain SQL derives from the given tables, for Spark and DuckDB alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _px(spark: SparkSession, sf_dir: str, bits: int) -> DataFrame:
    """8 by 8 frames of the embeddings' values; a stack for each label."""
    top = 2**bits - 1
    z = F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("frame_id"), F.col("label").alias("stack_id"), z.alias("z"), "embedding")
    e = e.select("frame_id", "stack_id", "z", F.posexplode("embedding").alias("i", "e"))
    v = F.least(F.lit(float(top)), F.greatest(F.lit(0.0), F.rint((F.col("e").cast("double") + 1) * (top / 2)))).cast("int")
    return e.select("frame_id", "stack_id", "z", F.floor(F.col("i") / 8).cast("int").alias("y"), (F.col("i") % 8).cast("int").alias("x"), v.alias("v"), F.lit(bits).alias("bit_depth"))


def px8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _px(spark, sf_dir, 8)


def px16(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _px(spark, sf_dir, 16)


def li_raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """16 frames of 32 by 32 with summed quantities."""
    keys = [(F.col(c) % n).cast("int").alias(a) for c, n, a in (("l_suppkey", 16, "frame_id"), ("l_partkey", 32, "y"), ("l_orderkey", 32, "x"))]
    return table(spark, sf_dir, "lineitem").groupBy(*keys).agg(F.sum("l_quantity").cast("int").alias("v"))


def li_frames(spark: SparkSession, sf_dir: str, size: int = 256, frames: int = 8) -> DataFrame:
    """Dense frames of size by size with summed quantities, in two stacks; a place without a line item is 0."""
    keys = [(F.col(c) % n).cast("int").alias(a) for c, n, a in (("l_suppkey", frames, "frame_id"), ("l_partkey", size, "y"), ("l_orderkey", size, "x"))]
    found = table(spark, sf_dir, "lineitem").groupBy(*keys).agg((F.sum("l_quantity").cast("int") % 256).alias("v"))
    every = found.select("frame_id").distinct().withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(size - 1)))).withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(size - 1))))
    dense = every.join(found, ["frame_id", "y", "x"], "left").withColumn("v", F.coalesce("v", F.lit(0)))
    z = F.floor(F.col("frame_id") / 2).cast("int")
    return dense.select("frame_id", (F.col("frame_id") % 2).alias("stack_id"), z.alias("z"), "y", "x", "v", F.lit(8).alias("bit_depth"))


def ev_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily sums by event type, in whole cents: series_id, idx, ts, value."""
    cents = F.sum(F.round(F.col("value") * 100).cast("long"))
    h = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("series_id"), F.date_trunc("day", "ts").cast("timestamp").alias("ts")).agg(
        (cents / 100).alias("value")
    )
    return h.withColumn("idx", F.row_number().over(Window.partitionBy("series_id").orderBy("ts")))


def ev_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumns({"series_id": (F.col("user_id") % 10).cast("int"), "timepoint": F.dayofmonth("ts")})
    return e.groupBy("series_id", "timepoint").agg(
        F.count("*").alias("area_pixels"),
        (F.sum(F.round(F.col("value") * 100).cast("long")).cast("double") / F.count("*") / 100).alias("average_darkness"),
        (F.max("value") > 150).alias("contour_found"),
    )


def names_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat((F.col("o_custkey") % 200).cast("string"), F.lit("_zs+"), (F.col("o_orderkey") % 7).cast("string"), F.lit(".png"))
    return table(spark, sf_dir, "orders").select(name.alias("filename"), F.col("o_orderdate").cast("timestamp").alias("mtime"))


def names_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    size, key = F.col("p_size").cast("string"), F.col("p_partkey")
    kind = key % 5
    name = (
        F.when(kind == 0, F.concat(F.lit("stack_"), size, F.lit("_edf.tif")))
        .when(kind == 1, F.concat(size, F.lit("_-"), (key % 9).cast("string"), F.lit(".png")))
        .when(kind == 2, F.concat(F.lit("img_"), size, F.lit("_z.TIFF")))
        .when(kind == 3, F.concat(F.lit("T"), size, F.lit("b.tif")))
        .otherwise(F.concat("p_brand", F.lit(".jpg")))
    )
    return table(spark, sf_dir, "part").select("p_partkey", name.alias("filename"))


def meta_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = F.element_at(F.array(*map(F.lit, ("nm", "um", "mm", "furlong"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    xml = F.concat(F.lit('<Pixels PhysicalSizeX="'), F.col("p_size").cast("string"), F.lit('.5" PhysicalSizeXUnit="'), unit, F.lit('">'))
    return table(spark, sf_dir, "part").select("p_partkey", xml.alias("ome_xml"), (F.col("p_partkey") % 4).alias("unit"), F.col("p_size").alias("xres"), (F.col("p_size") + 1).alias("yres"))


def mask8(spark: SparkSession) -> DataFrame:
    """255 inside rows and columns 2 to 5 of 8 by 8."""
    cells = spark.range(64).select((F.col("id") / 8).cast("int").alias("y"), (F.col("id") % 8).cast("int").alias("x"))
    return cells.withColumn("m", F.when(F.col("y").between(2, 5) & F.col("x").between(2, 5), 255.0).otherwise(0.0))


def rois8(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("a", 0, 0, 4, 4), ("b", 4, 4, 8, 8), ("full field", 0, 0, 8, 8)], "roi string, x0 int, y0 int, x1 int, y1 int")


def regions8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set pixels of px8: values of 128 or more."""
    return px8(spark, sf_dir).filter("v >= 128").select("frame_id", "y", "x")


def _px_sql(top: int) -> str:
    return f"""
SELECT vec_id AS frame_id, label AS stack_id, CAST(z AS INT) AS z, CAST(i // 8 AS INT) AS y, CAST(i % 8 AS INT) AS x,
  CAST(least({top}, greatest(0, round_even((CAST(e AS DOUBLE) + 1) * {top / 2}, 0))) AS INT) AS v
FROM (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS z, unnest(embedding) AS e,
  generate_subscripts(embedding, 1) - 1 AS i FROM embeddings)"""


SQL = {
    "px8": _px_sql(255),
    "px16": _px_sql(65535),
    "li": "SELECT CAST(l_suppkey % 16 AS INT) AS frame_id, CAST(l_partkey % 32 AS INT) AS y, CAST(l_orderkey % 32 AS INT) AS x, CAST(sum(l_quantity) AS INT) AS v FROM lineitem GROUP BY 1, 2, 3",
    "evs": """
SELECT series_id, CAST(row_number() OVER (PARTITION BY series_id ORDER BY ts) AS INT) AS idx, ts, value FROM (
  SELECT event_type AS series_id, date_trunc('day', ts) AS ts, sum(CAST(round(value * 100) AS BIGINT)) / 100 AS value FROM events GROUP BY 1, 2)""",
    "trk": """
SELECT CAST(user_id % 10 AS INT) AS series_id, CAST(extract(day FROM ts) AS INT) AS timepoint, count(*) AS area_pixels,
  CAST(sum(CAST(round(value * 100) AS BIGINT)) AS DOUBLE) / count(*) / 100 AS average_darkness, max(value) > 150 AS contour_found
FROM events GROUP BY 1, 2""",
    "ord": "SELECT concat(CAST(o_custkey % 200 AS VARCHAR), '_zs+', CAST(o_orderkey % 7 AS VARCHAR), '.png') AS filename, o_orderdate AS mtime FROM orders",
    "nam": """
SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN concat('stack_', CAST(p_size AS VARCHAR), '_edf.tif')
  WHEN 1 THEN concat(CAST(p_size AS VARCHAR), '_-', CAST(p_partkey % 9 AS VARCHAR), '.png') WHEN 2 THEN concat('img_', CAST(p_size AS VARCHAR), '_z.TIFF')
  WHEN 3 THEN concat('T', CAST(p_size AS VARCHAR), 'b.tif') ELSE concat(p_brand, '.jpg') END AS filename FROM part""",
    "met": """
SELECT p_partkey, concat('<Pixels PhysicalSizeX="', CAST(p_size AS VARCHAR), '.5" PhysicalSizeXUnit="',
  CASE p_partkey % 4 WHEN 0 THEN 'nm' WHEN 1 THEN 'um' WHEN 2 THEN 'mm' ELSE 'furlong' END, '">') AS ome_xml,
  p_partkey % 4 AS unit, p_size AS xres, p_size + 1 AS yres FROM part""",
    "mask8": "SELECT CAST(i // 8 AS INT) AS y, CAST(i % 8 AS INT) AS x, CASE WHEN i // 8 BETWEEN 2 AND 5 AND i % 8 BETWEEN 2 AND 5 THEN 255 ELSE 0 END AS m FROM range(64) t(i)",
    "rois8": "SELECT * FROM (VALUES ('a', 0, 0, 4, 4), ('b', 4, 4, 8, 8), ('full field', 0, 0, 8, 8)) t(roi, x0, y0, x1, y1)",
}
SQL["reg8"] = f"SELECT frame_id, y, x FROM ({SQL['px8']}) WHERE v >= 128"


def with_fixtures(sql: str) -> str:
    """`sql` with a CTE for each fixture that it names."""
    import re

    used = [k for k in SQL if re.search(rf"\b{k}\b", sql)]
    recursive = "RECURSIVE " if sql.lstrip().upper().startswith("WITH RECURSIVE") else ""
    body = re.sub(r"^\s*WITH\s+(RECURSIVE\s+)?", "", sql, count=1) if sql.lstrip().upper().startswith("WITH") else None
    head = ", ".join(f"{k} AS ({SQL[k]})" for k in used)
    if body is not None:
        return f"WITH {recursive}{head}, {body}" if head else sql
    return f"WITH {head} {sql}" if head else sql
