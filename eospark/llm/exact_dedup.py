"""Exact deduplication by content-defined chunk recipes.

Each text is cut where a hash of the last eight bytes says so, hence equal passages are cut alike. Distinct chunks
travel once a map task, are compared byte by byte, and get verified identifiers; after that documents are compared by
their ordered identifier lists alone, so a long text never moves as a whole.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eospark.functions.storage import staged
from eospark.llm.rows import one_of_each, row_key

#: Runs of white space other than a lone space; the contract's class is [\x20\x09-\x0D].
_RUNS = re.compile(r"[\t-\r][\t-\r ]*| [\t-\r ]+")
MIN_CHUNK, MEAN_BITS, MAX_CHUNK = 256, 11, 8192
_MIX = np.uint64(0x9E3779B97F4A7C15)


def normalise(text: str | None) -> bytes:
    """Each run of ASCII white space becomes one space; null is empty."""
    return _RUNS.sub(" ", text or "").encode("utf-8", "surrogatepass")


def cut_points(data: bytes) -> np.ndarray:
    """Candidate ends of chunks: where the hash of the eight bytes before has ``MEAN_BITS`` leading zeros."""
    b = np.frombuffer(data, np.uint8)
    if len(b) < 8:
        return np.zeros(0, np.int64)
    x = b.astype(np.uint64)
    for width in (1, 2, 4):
        x = x[:-width] | (x[width:] << np.uint64(8 * width))
    return np.flatnonzero((x * _MIX) >> np.uint64(64 - MEAN_BITS) == 0) + 8


def chunks(data: bytes) -> Iterator[bytes]:
    """The chunks of one text, in order; together they are the text."""
    start = 0
    for end in [*cut_points(data).tolist(), len(data)]:
        while end - start > MAX_CHUNK:
            yield data[start : start + MAX_CHUNK]
            start += MAX_CHUNK
        if end - start >= MIN_CHUNK or end == len(data) > start:
            yield data[start:end]
            start = end


def _digest(chunk: bytes, bits: int) -> int:
    h = xxhash.xxh3_64_intdigest(chunk) >> (64 - bits)
    return h - (1 << 64) if h >= 1 << 63 else h


def _recipes(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            recipes, shas = [], []
            for text in batch.column(1).to_pylist():
                data = normalise(text)
                recipes.append([_digest(c, bits) for c in chunks(data)])
                shas.append(hashlib.sha256(data).digest())
            yield pa.record_batch(
                [batch.column(0), pa.array(recipes, pa.list_(pa.int64())), pa.array(shas, pa.binary())], ["id", "recipe", "sha"]
            )

    return run


def _contents(bits: int, with_place: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict = {}
            for text in batch.column(0).to_pylist():
                data = normalise(text)
                key = hashlib.sha256(data).digest() if with_place else None
                for place, c in enumerate(chunks(data)):
                    seen[(c, key, place) if with_place else c] = _digest(c, bits)
            cols = [pa.array(seen.values(), pa.int64()), pa.array([k[0] if with_place else k for k in seen], pa.binary())]
            names = ["chunk", "bytes"]
            if with_place:
                cols += [pa.array([k[1] for k in seen], pa.binary()), pa.array([k[2] for k in seen], pa.int32())]
                names += ["sha", "place"]
            yield pa.record_batch(cols, names)

    return run


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hash_bits: int = 64) -> DataFrame:
    """One row a document: ``id_col, keep_id, group_size, kept, text_sha256``.

    Texts are equal when identical after white-space normalisation; null counts as empty, and empty texts are equal.
    The smallest id of a group stays. Rows that repeat both id and text are counted each, and are kept or dropped
    together; a null id never is the smallest unless all are null. Other columns are ignored, whatever their names.
    ``hash_bits`` below 64 only serves tests, which force chunk hashes to clash.
    """
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    id_type = src.schema["id"].dataType.simpleString()
    rows = staged(src.mapInArrow(_recipes(hash_bits), f"id {id_type}, recipe array<bigint>, sha binary"), "recipes")
    # Verification: a chunk hash with more than one content is no identifier yet.
    contents = src.select("text").mapInArrow(_contents(hash_bits, False), "chunk bigint, bytes binary").distinct()
    clashing = contents.groupBy("chunk").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("chunk")
    clashing = staged(clashing, "clashing")
    if clashing.isEmpty():
        rows = rows.withColumn("ranks", F.array().cast("array<int>"))
    else:
        rows = _with_ranks(src, rows, contents, clashing, hash_bits)
    keys = ["recipe", "ranks"]
    groups = rows.groupBy(*keys).agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    # Written first, so that both sides of the join are plain exchanges and Spark can split a hot group.
    groups = staged(groups, "groups")
    return rows.join(groups, keys).select(
        F.col("id").alias(id_col),
        "keep_id",
        "group_size",
        F.coalesce(F.col("id") == F.col("keep_id"), F.col("keep_id").isNull()).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def _with_ranks(src: DataFrame, rows: DataFrame, contents: DataFrame, clashing: DataFrame, bits: int) -> DataFrame:
    """Tell chunks of one hash apart by the rank of their bytes, and add the ranks to the recipes they are in.

    Chunks are looked up by the hash of their whole text, as ids may repeat.
    """
    w = Window.partitionBy("chunk").orderBy("bytes")
    ranked = contents.join(clashing, "chunk").withColumn("rank", F.row_number().over(w))
    places = src.select("text").mapInArrow(_contents(bits, True), "chunk bigint, bytes binary, sha binary, place int").distinct()
    ranks = places.join(ranked, ["chunk", "bytes"]).groupBy("sha").agg(
        F.transform(F.array_sort(F.collect_set(F.struct("place", "rank"))), lambda x: x["rank"]).alias("ranks")
    )
    return rows.join(ranks, "sha", "left").withColumn("ranks", F.coalesce("ranks", F.array().cast("array<int>")))


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of equal texts, that with the smallest id; all columns stay.

    Equal, null ids and empty tables: see ``exact_groups``. Rows that share an id are told apart by their texts; of rows
    that repeat both, one stays at most.
    """
    groups = exact_groups(docs, id_col, text_col).where(~F.col("kept"))
    gone = groups.select(row_key(F.col(id_col), F.unhex("text_sha256")).alias("_key"))
    # The pattern is the contract's class.
    text = F.regexp_replace(F.coalesce(F.col(text_col).cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", " ")
    return one_of_each(docs, row_key(docs[id_col], F.unhex(F.sha2(text, 256))), gone)
