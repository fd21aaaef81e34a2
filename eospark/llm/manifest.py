"""Merkle manifest of a table: a binary hash tree over rows of each group, and one over the groups' roots, with witnesses.

Leaves are appended in order. A stack holds the open subtrees; each leaf of one carries a partial witness, the digests beside
its path so far. When an appended leaf completes a sibling, both subtrees' witnesses are extended and the two become one.
Spark deals leaves out in aligned blocks of 2^``BITS``, which are appended independently; the blocks' roots are appended in
the same way, level by level, until one root a group is left, and the groups' roots once more.

A digest is the lower-case hex SHA-256 of what it covers, digests as text. A node without sibling is hashed alone.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eospark.functions.storage import staged
from eospark.operators.global_order import global_index

#: Leaves of a block: 2^BITS.
BITS = 12
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def leaf(values: list[Column]) -> Column:
    """Digest of a row: each value as its count of UTF-8 bytes, a colon and itself; a null as a dash."""
    parts = [F.coalesce(F.concat(F.octet_length(v.cast("string")).cast("string"), F.lit(":"), v.cast("string")), F.lit("-")) for v in values]
    return F.sha2(F.concat(*parts), 256)


def _digest(*parts: str) -> str:
    return sha256("".join(parts).encode()).hexdigest()


class OpenTree:
    """Appends leaves to a binary tree of at most 2^``bits`` leaves and keeps the witnesses of all of them."""

    def __init__(self, size: int, bits: int):
        self.beside = np.zeros((size, bits, 32), np.uint8)
        self.has = np.zeros((size, bits), bool)
        self.open: list[tuple[int, int, int, str]] = []  # height, first leaf, leaf after the last, digest

    def _extend(self, first: int, end: int, height: int, digest: str) -> None:
        self.beside[first:end, height] = np.frombuffer(bytes.fromhex(digest), np.uint8)
        self.has[first:end, height] = True

    def _join(self) -> None:
        """The last two open subtrees are siblings: each one's witnesses get the other's digest."""
        height, first, middle, a = self.open[-2]
        _, _, end, b = self.open.pop()
        self._extend(first, middle, height, b)
        self._extend(middle, end, height, a)
        self.open[-1] = (height + 1, first, end, _digest(a, b))

    def append(self, digest: str) -> None:
        at = self.open[-1][2] if self.open else 0
        self.open.append((0, at, at + 1, digest))
        while len(self.open) > 1 and self.open[-2][0] == self.open[-1][0]:
            self._join()

    def close(self, height: int = 0) -> str:
        """No leaf follows: what has no sibling is hashed alone, up to ``height`` at least. The root's digest."""
        while len(self.open) > 1 or self.open[0][0] < height:
            last = self.open[-1]
            if len(self.open) > 1 and self.open[-2][0] == last[0]:
                self._join()
            else:
                self.open[-1] = (last[0] + 1, last[1], last[2], _digest(last[3]))
        return self.open[0][3]

    def witness(self, i: int) -> bytes:
        return self.beside[i][self.has[i]].tobytes()


def _appended(rows: DataFrame, bits: int) -> DataFrame:
    """``rows`` (``_key, _idx, _n, _hash``, others) with ``_block``, the root of that block (``_root``) and ``_witness`` within it.

    Groups of rows are blocks, so none has more than 2^bits rows.
    """
    rows = rows.withColumn("_block", F.expr(f"shiftright(_idx, {bits})"))
    schema = T.StructType([*rows.schema.fields, T.StructField("_root", T.StringType()), T.StructField("_witness", T.BinaryType())])

    def run(block: pa.Table) -> pa.Table:
        block = block.sort_by("_idx")
        tree = OpenTree(block.num_rows, bits)
        for digest in block.column("_hash").to_pylist():
            tree.append(digest)
        root = tree.close(bits if block.column("_n")[0].as_py() > 1 << bits else 0)
        own = pa.array([tree.witness(i) for i in range(block.num_rows)], pa.binary())
        return block.append_column("_root", pa.array([root] * block.num_rows)).append_column("_witness", own)

    return rows.groupBy("_key", "_block").applyInArrow(run, schema)


def _trees(rows: DataFrame, bits: int) -> DataFrame:
    """``rows`` (``_key``, ``_idx`` from 0 without gaps, ``_n`` rows a key, ``_hash``, others) with ``_root`` and ``_witness``
    of whole trees: each round appends the blocks of the one before."""
    levels = []
    while True:
        levels.append(staged(_appended(rows, bits), "appended"))
        first = levels[-1].where(F.expr(f"_idx & {(1 << bits) - 1} = 0"))
        up = F.expr(f"shiftright(_n + {(1 << bits) - 1}, {bits})")
        rows = first.select("_key", F.col("_block").alias("_idx"), up.alias("_n"), F.col("_root").alias("_hash"))
        if (rows.agg(F.max("_n")).first()[0] or 0) <= 1:
            break
    out = levels.pop()
    while levels:
        above = out.select("_key", F.col("_idx").alias("_block"), F.col("_root").alias("_top"), F.col("_witness").alias("_more"))
        low = levels.pop()
        out = low.join(above, ["_key", "_block"]).withColumns({"_root": F.col("_top"), "_witness": F.concat("_witness", "_more")})
        out = out.select(*low.columns)
    return out.drop("_block")


def _sides(idx: Column, n: Column) -> Column:
    """From the leaf up: whether the sibling stands left (L), right (R) or is missing (-)."""
    height = F.when(n > 1, F.length(F.bin(n - 1))).otherwise(0)

    def side(level: Column) -> Column:
        at, last = F.call_function("shiftright", idx, level), F.call_function("shiftright", n - 1, level)
        return F.when(at % 2 == 1, "L").when(at < last, "R").otherwise("-")

    return F.when(height > 0, F.array_join(F.transform(F.sequence(F.lit(0), height - 1), side), "")).otherwise("")


def manifest(
    docs: DataFrame, id_col: str = "doc_id", group: str = "lang", fields: list[str] = FIELDS, carry: dict[str, Column] | None = None, bits: int = BITS
) -> DataFrame:
    """``id_col, leaf, subroot, root, witness, sides`` and the ``carry`` columns: each row's digest, the roots above it, the
    digests beside its path (hex, one after the other, from the leaf up to the root) and on which side they stand.

    Rows of a group ascend by id (null first), then by leaf; groups ascend bytewise, null first. A null value is a dash in its
    leaf, an empty text a text of no bytes. Rows that are equal are leaves of their own, with equal leaves. An empty table
    gives an empty table. Columns that are not in ``fields`` have no influence. A group of any size is appended in blocks.
    """
    key = F.coalesce(F.concat(F.lit("1"), F.col(group).cast("string")), F.lit("0"))
    rows = docs.select(
        F.col(id_col).alias("_id"), key.alias("_key"), leaf([F.col(c) for c in fields]).alias("_hash"), *[c.alias(n) for n, c in (carry or {}).items()]
    )
    # Written, so that texts are hashed once and the sampling of ranges reads digests alone.
    rows = global_index(staged(rows, "leaves"), [F.col("_key"), F.col("_id"), F.col("_hash")], "_at")
    first = rows.groupBy("_key").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    # Written, so that the join has two plain sides and a large group can be split.
    rows, first = staged(rows, "ordered"), staged(first, "groups")
    rows = rows.join(first, "_key").withColumn("_idx", F.col("_at") - F.col("_first")).drop("_at", "_first")
    low = _trees(rows, bits)
    tops = low.where("_idx = 0").select("_key", F.col("_root").alias("_hash"))
    tops = global_index(tops.withColumnRenamed("_key", "_name"), [F.col("_name")], "_idx")
    tops = tops.withColumns({"_key": F.lit(""), "_n": F.lit(first.count()).cast("bigint")})
    tops = _trees(tops, bits).select(
        F.col("_name").alias("_key"), F.col("_root").alias("_top"), F.col("_witness").alias("_more"), _sides(F.col("_idx"), F.col("_n")).alias("_up")
    )
    out = low.join(staged(tops, "roots"), "_key")
    return out.select(
        F.col("_id").alias(id_col),
        F.col("_hash").alias("leaf"),
        F.col("_root").alias("subroot"),
        F.col("_top").alias("root"),
        F.lower(F.hex(F.concat("_witness", "_more"))).alias("witness"),
        F.concat(_sides(F.col("_idx"), F.col("_n")), F.col("_up")).alias("sides"),
        *(carry or {}),
    )


def folded(leaf_: Column, witness: Column, sides: Column) -> Column:
    """The root that a leaf and its witness give."""

    def up(state: Column, level: Column) -> Column:
        side, digest = F.substr(sides, level, F.lit(1)), state["digest"]
        sibling = F.substr(witness, state["used"] * 64 + 1, F.lit(64))
        joined = F.when(side == "L", F.concat(sibling, digest)).when(side == "R", F.concat(digest, sibling)).otherwise(digest)
        return F.struct(F.sha2(joined, 256).alias("digest"), (state["used"] + F.when(side == "-", 0).otherwise(1)).alias("used"))

    levels = F.when(F.length(sides) > 0, F.sequence(F.lit(1), F.length(sides))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(levels, F.struct(leaf_.alias("digest"), F.lit(0).alias("used")), up, lambda s: s["digest"])


def verify(docs: DataFrame, tampered: Column, changed: dict[str, Column], bits: int = BITS) -> DataFrame:
    """Fold each row's leaf, where ``tampered`` holds that of the row with ``changed`` values, along its witness.

    ``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified``: the last says whether the fold gives the root. A null
    ``tampered`` counts as false. Nulls, equal rows and empty tables: as in ``manifest``.
    """
    other = leaf([changed.get(c, F.col(c)) for c in FIELDS])
    out = manifest(docs, carry={"_other": F.when(tampered, other)}, bits=bits)
    fold = folded(F.coalesce("_other", "leaf"), F.col("witness"), F.col("sides"))
    out = out.select("doc_id", "leaf", "subroot", "root", F.sha2("witness", 256).alias("proof_sha256"), fold.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
