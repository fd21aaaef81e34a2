"""Temperature mixing of sources.

A source with share p of all tokens gets weight p**a / sum(p**a). The exponent a between 0 (all sources alike) and 1
(natural shares) is found by bisection on a target entropy or on a repetition limit. Weights become token budgets, and
a budget is realised as permutations of the source's blocks: whole passes, each in an order of its own, then the part of
a further pass that the budget still pays for.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eospark.functions.storage import staged

BLOCKS = 1024
#: A plan has one row for each source and block; up to so many rows it is broadcast, beyond that it is joined by key.
BROADCAST_ROWS = 100_000
_SECTIONS, _ROUNDS = 16, 7


def words(text: Column) -> Column:
    """The token measure of this module: runs of anything but ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def _measure(shares: DataFrame, exponents: list[float], budget_share: float | None) -> list[tuple[float, float]]:
    """For each exponent, the weights' entropy and the passes over the source that is repeated most."""
    aggs = []
    for j, a in enumerate(exponents):
        power = F.pow("p", F.lit(a))
        aggs += [F.sum(power).alias(f"s{j}"), F.sum(power * F.log("p")).alias(f"l{j}"), F.max(power / F.col("p")).alias(f"m{j}")]
        aggs.append(F.max("p").alias("largest"))
    row = shares.agg(*{str(x): x for x in aggs}.values()).first()
    out = []
    for j, a in enumerate(exponents):
        s, most = row[f"s{j}"], row[f"m{j}"]
        passes = most * row["largest"] ** (1 - a) if budget_share is None else most * budget_share / s
        out.append((math.log(s) - a * row[f"l{j}"] / s, passes))
    return out


def exponent(
    shares: DataFrame, target_entropy: float | None = None, repetition_limit: float | None = None, budget_share: float | None = None
) -> float:
    """The smallest exponent in [0, 1] whose entropy is at most ``target_entropy`` (nats) and whose most repeated source
    is passed over at most ``repetition_limit`` times. ``shares`` has a column ``p``; the sums run on Spark, as there
    may be very many sources. If none in [0, 1] will do, 1 is returned."""
    lo, hi = 0.0, 1.0
    for _ in range(_ROUNDS):
        grid = [lo + (hi - lo) * j / _SECTIONS for j in range(_SECTIONS + 1)]
        ok = [
            (target_entropy is None or h <= target_entropy + 1e-12) and (repetition_limit is None or r <= repetition_limit + 1e-12)
            for h, r in _measure(shares, grid, budget_share)
        ]
        at = ok.index(True) if True in ok else _SECTIONS
        if at == 0:
            return lo
        lo, hi = grid[at - 1], grid[at]
    return hi


def plan(
    docs: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    target_entropy: float | None = None,
    repetition_limit: float | None = 2.0,
    budget_tokens: int | None = None,
    blocks: int = BLOCKS,
    seed: int = 0,
) -> DataFrame:
    """``source, block, budget, passes array<struct<epoch, before, tokens>>``: which blocks are used, and how often.

    Without ``budget_tokens`` the budget is what uses the largest source exactly once, so nothing is left out and smaller
    sources are repeated. With one, larger sources may be used in part. Every budget is met to within a block, which is
    about 1/``blocks`` of its source. Null is a source of its own; a source without tokens is used once.
    """
    slim = docs.select(
        F.col(source_col).cast("string").alias("source"), _block(F.col(id_col), blocks, seed).alias("block"), words(F.col(text_col)).alias("tokens")
    )
    by_block = staged(slim.groupBy("source", "block").agg(F.sum("tokens").alias("tokens")), "blocks")
    totals = by_block.groupBy("source").agg(F.sum("tokens").alias("total"))
    all_tokens = totals.agg(F.sum("total")).first()[0]
    once = F.array(F.struct(F.lit(0).alias("epoch"), F.lit(0).cast("bigint").alias("before"), F.col("tokens")))
    if not all_tokens:
        return by_block.select("source", "block", F.lit(0).cast("bigint").alias("budget"), once.alias("passes"))
    shares = staged(totals.withColumn("p", F.col("total") / F.lit(all_tokens)), "shares")
    weighed = shares.where("total > 0")
    budget_share = None if budget_tokens is None else budget_tokens / all_tokens
    a = exponent(weighed, target_entropy, repetition_limit, budget_share)
    norm = weighed.agg(F.sum(F.pow("p", F.lit(a))), F.max("p")).first()
    budget = all_tokens * norm[0] * norm[1] ** (1 - a) if budget_tokens is None else budget_tokens
    budgets = weighed.select("source", "total", F.round(F.pow("p", F.lit(a)) / F.lit(norm[0]) * F.lit(budget)).cast("bigint").alias("budget"))
    budgets = budgets.withColumn("epochs", F.expr("budget div total").cast("int"))
    rows = by_block.alias("b").join(budgets.alias("s"), F.expr("b.source <=> s.source"), "left").select(
        "b.source", "b.block", "b.tokens", "s.total", "s.budget", "s.epochs"
    )
    rows = rows.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.coalesce("epochs", F.lit(0)))))
    turn = Window.partitionBy("source", "epoch").orderBy(F.xxhash64("block", "epoch", F.lit(seed)), "block")
    rows = rows.withColumn("before", F.sum("tokens").over(turn.rowsBetween(Window.unboundedPreceding, 0)) - F.col("tokens"))
    rest = F.col("budget") - F.col("epochs") * F.col("total")
    used = F.col("budget").isNull() | (F.col("epoch") < F.col("epochs")) | (F.col("before") + F.col("tokens") <= rest)
    # Blocks without tokens cost nothing and are used as often as whole passes are.
    used &= F.col("budget").isNull() | (F.col("tokens") > 0) | (F.col("epoch") < F.greatest("epochs", F.lit(1)))
    passes = F.array_sort(F.collect_list(F.struct("epoch", (F.col("before") + F.col("epoch") * F.coalesce("total", F.lit(0))).alias("before"), "tokens")))
    return rows.where(used).groupBy("source", "block").agg(F.max(F.coalesce("budget", F.lit(0))).alias("budget"), passes.alias("passes"))


def _block(key: Column, blocks: int, seed: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(blocks)).cast("int")


def mix(
    docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", blocks: int = BLOCKS, seed: int = 0, **target
) -> DataFrame:
    """``docs`` with a row for each use of a document, and ``_epoch``, ``_block``, ``_mix_key``.

    All columns stay, but for any of these three names, which are replaced. Rows sorted by ``_mix_key`` (from 0 to 1) give
    the mixture: each source is spread evenly over it. Repeated rows are rows of their own; a null id has a block too; a
    null or empty text has no tokens and costs nothing; long texts count whole; an empty table gives an empty table. For
    the targets see ``plan``.
    """
    uses = staged(plan(docs, id_col, source_col, text_col, blocks=blocks, seed=seed, **target), "plan")
    uses = uses.select(F.col("source").alias("_s"), F.col("block").alias("_b"), F.col("budget").alias("_budget"), "passes")
    if uses.count() <= BROADCAST_ROWS:
        uses = F.broadcast(uses)
    # The row travels packed, so that names of columns cannot clash.
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_doc"), docs[id_col].alias("_id"), docs[source_col].cast("string").alias("_source"))
    rows = rows.withColumn("_block", _block(F.col("_id"), blocks, seed))
    rows = rows.join(uses, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_block") == F.col("_b")))
    rows = rows.withColumn("_use", F.explode("passes"))
    u = F.pmod(F.xxhash64(F.col("_id"), "_use.epoch", F.lit(seed + 1)), F.lit(1 << 20)) / F.lit(float(1 << 20))
    key = (F.col("_use.before") + u * F.col("_use.tokens")) / F.greatest("_budget", F.lit(1))
    kept = [F.col("_doc")[c].alias(c) for c in docs.columns if c not in ("_epoch", "_block", "_mix_key")]
    return rows.select(*kept, F.col("_use.epoch").alias("_epoch"), "_block", F.least(key, F.lit(1.0)).alias("_mix_key"))
