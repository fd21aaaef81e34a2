"""Row numbers and running sums over a whole table without a window over one partition.

Rows are range-partitioned and sorted; each partition's totals (one row a partition) give the offsets of the next ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eospark.functions.storage import staged


def ordered(df: DataFrame, keys: list[Column], partitions: int | None = None) -> DataFrame:
    """``df`` in ranges of ``keys``, written once, with ``_part`` (ascending with the ranges) and ``_pos`` within it."""
    dealt = df.repartitionByRange(partitions, *keys) if partitions else df.repartitionByRange(*keys)
    row = F.monotonically_increasing_id()
    dealt = dealt.sortWithinPartitions(*keys).withColumn("_row", row)
    # Written once, so that the totals and the rows come from one and the same ordering.
    dealt = dealt.withColumn("_part", F.shiftright("_row", 33)).withColumn("_pos", F.col("_row").bitwiseAND((1 << 33) - 1))
    return staged(dealt.drop("_row"), "ordered")


def global_index(df: DataFrame, keys: list[Column], name: str = "idx", partitions: int | None = None) -> DataFrame:
    """Add ``name``: the row's place (from 0, gapless) in the order of ``keys``.

    Ties get distinct places in an arbitrary but stable order; an empty table gives an empty table.
    The broadcast side has one row a partition.
    """
    rows = ordered(df, keys, partitions)
    parts = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    return rows.join(F.broadcast(parts), "_part").withColumn(name, F.col("_off") + F.col("_pos")).drop("_part", "_pos", "_off")


def global_cumsum(df: DataFrame, keys: list[Column], sums: dict[str, str], partitions: int | None = None) -> DataFrame:
    """Add running sums (inclusive) in the order of ``keys``; ``sums`` maps a new column to the summed column.

    ``keys`` should order rows totally, or rows that tie get sums in an arbitrary order.
    """
    rows = ordered(df, keys, partitions)
    parts = rows.groupBy("_part").agg(*[F.sum(c).alias(f"_t_{n}") for n, c in sums.items()])
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("_part", *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in sums])
    inside = Window.partitionBy("_part").orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0)
    out = rows.join(F.broadcast(parts), "_part").select(
        *rows.columns, *[(F.col(f"_o_{n}") + F.sum(c).over(inside)).alias(n) for n, c in sums.items()]
    )
    return out.drop("_part", "_pos")


def few(df: DataFrame, name: str, rows: int = 1_000_000) -> DataFrame:
    """``df`` written, and marked for broadcast if its rows were counted to be at most so many."""
    df = staged(df, name)
    return F.broadcast(df) if df.count() <= rows else df


def running_max(df: DataFrame, by: list[str], order: list[str], what: Column, name: str, inclusive: bool = True) -> DataFrame:
    """Add ``name``: the largest ``what`` so far (or before the row) among rows equal in ``by``, in the order of ``order``.

    A group may span many partitions: windows run within a range partition, and each partition's maximum of a group (one
    row) is carried over to the later ones. Partition and place are kept as ``_part, _pos``.
    """
    rows = ordered(df.withColumn("_x", what), [F.col(c) for c in (*by, *order)], None)
    inside = Window.partitionBy("_part", *by).orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    parts = rows.groupBy(*by, "_part").agg(F.max("_x").alias("_most"))
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    carry = parts.select(*by, "_part", F.max("_most").over(before).alias("_carry")).where("_carry is not null")
    rows = rows.withColumn(name, F.max("_x").over(inside)).join(few(carry, "carry"), [*by, "_part"], "left")
    return rows.withColumn(name, F.greatest(name, "_carry")).drop("_x", "_carry")


def group_index(df: DataFrame, by: list[str], order: list[str], name: str) -> DataFrame:
    """Add ``name``: the row's place (from 0) within its group, in the order of ``order``; a group may span many partitions."""
    rows = global_index(df, [F.col(c) for c in (*by, *order)], "_at")
    first = few(rows.groupBy(*by).agg(F.min("_at").alias("_first")), "firsts")
    return rows.join(first, by).withColumn(name, F.col("_at") - F.col("_first")).drop("_at", "_first")
