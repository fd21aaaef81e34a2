"""Rows as such: told apart by id and text, as ids may repeat or be null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def row_key(id_: Column, text_key: Column) -> Column:
    """A key of 256 bits that is never null, from an id (which may be) and a binary hash of a text."""
    return F.unhex(F.sha2(F.concat_ws("|", F.coalesce(id_.cast("string"), F.lit("")), id_.isNull().cast("string"), F.hex(text_key)), 256))


def one_of_each(docs: DataFrame, key: Column, gone: DataFrame) -> DataFrame:
    """``docs`` without the rows whose key is in ``gone`` (``_key``), and with one of the rows that share a key.

    Rows travel once, packed, so that names of columns cannot clash; repeats are dropped before they travel. Which of the
    rows that share a key stays is arbitrary.
    """
    packed = docs.select(key.alias("_key"), F.struct(*[docs[c] for c in docs.columns]).alias("_doc"))
    one = packed.groupBy("_key").agg(F.first("_doc").alias("_doc"))
    return one.join(gone.select("_key").distinct(), "_key", "left_anti").select("_doc.*")
