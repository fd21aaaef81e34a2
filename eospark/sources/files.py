"""Readers and writers of example tables, statistics, lookups, images and metrics."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eospark.operators.global_order import global_index


def examples(spark: SparkSession, path: str, keep: list[str] | None = None) -> DataFrame:
    """A table of examples; only the columns kept are read."""
    df = spark.read.parquet(path)
    return df.select(*keep) if keep else df


def globs(spark: SparkSession, patterns: str, fmt: str = "parquet") -> DataFrame:
    """Comma-separated patterns; Spark raises where one matches nothing."""
    return spark.read.format(fmt).load([p.strip() for p in patterns.split(",") if p.strip()])


def band_stats_json(spark: SparkSession, pattern: str, drop_support: bool = True) -> DataFrame:
    """``var, band, stat, value`` from JSON files of statistics by variable; the band is in the name ``.._band_<i>.json``.

    Keys with a tilde are support values and are dropped, or keep their name with an underscore.
    """
    df = spark.read.text(pattern, wholetext=True).select("value", F.regexp_extract("_metadata.file_name", r"_band_(\d+)\.json$", 1).alias("b"))
    parsed = F.from_json("value", "map<string,map<string,double>>")
    rows = df.select("b", F.explode(parsed).alias("var", "stats")).select("var", "b", F.explode("stats").alias("stat", "value"))
    rows = rows.where(~F.col("stat").contains("~")) if drop_support else rows.withColumn("stat", F.regexp_replace("stat", "~", "_"))
    return rows.select("var", F.when(F.col("b") != "", F.col("b").cast("int")).alias("band"), "stat", "value")


def lookup_file(spark: SparkSession, path: str, sep: str | None = None) -> DataFrame:
    """``key, val``: the line number of each line, or ``key<sep>int`` lines."""
    df = spark.read.text(path)
    if sep is not None:
        parts = F.split("value", re.escape(sep), 2)
        return df.select(parts[0].alias("key"), parts[1].cast("int").alias("val"))
    placed = df.select("value", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i"))
    return global_index(placed, [F.col("f"), F.col("b"), F.col("i")], "val").select(F.col("value").alias("key"), F.col("val").cast("int").alias("val"))


def images(spark: SparkSession, path: str) -> DataFrame:
    """``path, height, width, channels, data``: decoded on the JVM; channels in the order red, green, blue."""
    df = spark.read.format("image").option("dropInvalid", True).load(path).select("image.*")
    n = F.col("nChannels")

    def flip(_: Column, i: Column) -> Column:
        at = F.when(n >= 3, F.when(i % n < 3, i - i % n + 2 - i % n).otherwise(i)).otherwise(i)
        return F.conv(F.hex(F.substring("data", at + 1, F.lit(1))), 16, 10).cast("smallint")

    values = F.transform(F.sequence(F.lit(0), F.col("height") * F.col("width") * n - 1), lambda i: flip(i, i))
    return df.select(F.col("origin").alias("path"), "height", "width", n.alias("channels"), values.alias("data"))


#: Steps in a folder of saved metrics.
STEPS = 10_000


def save_metrics(df: DataFrame, path: str) -> None:
    """Long metrics (``run, step, metric, value``), in a folder a range of steps, as long logs have very many steps."""
    df.withColumn("steps", F.floor(F.col("step") / STEPS)).write.mode("append").partitionBy("steps").parquet(path)


def metric_log_rows(df: DataFrame, metrics: list[str]) -> DataFrame:
    """One row a run and step with a column a metric, as it goes to a JSON-lines log."""
    return df.groupBy("run", "step").pivot("metric", metrics).agg(F.first("value"))


def append_metric_log(df: DataFrame, path: str, metrics: list[str]) -> None:
    metric_log_rows(df, metrics).write.mode("append").json(path)


def write_png(df: DataFrame, path: str, height: int, width: int) -> None:
    """One RGB image a row from ``pixels`` (an array of three numbers each); readers ignore the line end after it."""
    import pyarrow as pa

    def run(batches):
        import struct
        import zlib

        def chunk(kind: bytes, data: bytes) -> bytes:
            return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

        head = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0))
        for batch in batches:
            out = []
            for pixels in batch.column(0).to_pylist():
                raw = b"".join(b"\0" + bytes(v for p in pixels[y * width : (y + 1) * width] for v in p) for y in range(height))
                out.append(head + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))
            yield pa.record_batch([pa.array(out, pa.binary())], ["value"])

    rows = df.select("pixels").mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value"))
    rows.write.option("maxRecordsPerFile", 1).text(path)
