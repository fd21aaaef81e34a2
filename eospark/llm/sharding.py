"""Shards of equal row counts that keep linked documents together, by balanced label propagation.

Documents of equal text are linked. As those of one group in one shard are interchangeable, the labels are counts: how
many documents of a group are in a shard. Labels begin dealt in turn. In every round a group's smaller counts ask to move
to the shards of its larger ones. What is admitted keeps every shard within its size: requests that form cycles of shards
are exchanged, the others follow free quota, which the documents without links leave. Where neighbours' shards have no
room, whole groups ask for an open shard. Documents without links then fill the shards up. All of it is joins and
aggregates on short rows; texts are read once.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eospark.functions.storage import staged
from eospark.operators.global_order import global_cumsum, global_index

#: Rounds without an admitted move, each with other ties, after which propagation has settled.
PATIENCE = 3


def _sizes(n: int, shards: int) -> list[int]:
    return [n // shards + (s < n % shards) for s in range(shards)]


def admitted(asked: dict[tuple[int, int], int], free: list[int]) -> dict[tuple[int, int], int]:
    """How many of the rows that ask to move from shard to shard may do so, all at once, with no shard beyond its quota.

    Cycles of requests are exchanges and need no quota. What is left has no cycles, so a pass from its ends backwards lets
    free quota travel from where rows go to where they come from. At most shards^2 numbers, on the driver.
    """
    left, out = {k: n for k, n in asked.items() if n > 0}, defaultdict(int)

    def move(edges: list[tuple[int, int]], n: int) -> None:
        for e in edges:
            out[e] += n
            left[e] -= n
            if not left[e]:
                del left[e]

    for s, t in sorted(left):
        if s < t and (n := min(left.get((s, t), 0), left.get((t, s), 0))):
            move([(s, t), (t, s)], n)
    ordered: list[int] = []
    while True:
        after = defaultdict(list)
        for s, t in sorted(left):
            after[s].append(t)
        ordered, done, cycle = [], set(), None
        for root in sorted(after):
            stack, on = [(root, iter(after[root]))] if root not in done else [], [root]
            while stack and not cycle:
                node, rest = stack[-1]
                t = next((t for t in rest if t not in done), None)
                if t is None:
                    done.add(node)
                    ordered.append(node)
                    stack.pop()
                    on.pop()
                elif t in on:
                    path = on[on.index(t) :]
                    cycle = list(zip(path, [*path[1:], t], strict=True))
                else:
                    stack.append((t, iter(after[t])))
                    on.append(t)
            if cycle:
                break
        if not cycle:
            break
        move(cycle, min(left[e] for e in cycle))
    free = list(free)
    for t in ordered:
        for s, _ in sorted(e for e in left if e[1] == t):
            if n := min(left[s, t], free[t]):
                move([(s, t)], n)
                free[t] -= n
                free[s] += n
    return dict(out)


def _to_neighbours(cells: DataFrame, free: list[int], seed: int) -> DataFrame | None:
    """``cells`` after the admitted moves of a group's smaller counts to the shards of its larger ones; None if there are none."""
    tie = F.xxhash64("grp", "shard", F.lit(seed))
    # At most as many elements as there are shards.
    held = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("minus"), tie.alias("tie"), "shard")))
    groups = cells.groupBy("grp").agg(held.alias("held")).withColumn("half", F.expr("(size(held) + 1) div 2"))
    rows = groups.select("grp", "held", "half", F.posexplode("held").alias("place", "cell"))
    target = F.when(F.col("place") >= F.col("half"), F.get("held", F.col("place") - F.col("half"))["shard"])
    rows = staged(rows.select("grp", F.col("cell.shard").alias("shard"), (-F.col("cell.minus")).alias("n"), target.alias("target")), "requests")
    asking = rows.where("target is not null")
    asked = {(r["shard"], r["target"]): r["n"] for r in asking.groupBy("shard", "target").agg(F.sum("n").alias("n")).collect()}
    grant, base, plan = admitted(asked, free), 0, []
    for s, t in sorted(asked):
        plan.append((s, t, base, grant.get((s, t), 0)))
        base += asked[s, t]
    if not grant:
        return None
    # Which rows of a request move is settled by a running sum, so exactly as many move as were admitted.
    asking = global_cumsum(asking, [F.col("shard"), F.col("target"), F.xxhash64("grp", F.lit(seed)), F.col("grp")], {"through": "n"})
    quota = cells.sparkSession.createDataFrame(plan, "shard int, target int, base bigint, grant bigint")
    asking = asking.join(F.broadcast(quota), ["shard", "target"])  # at most shards^2 rows
    moved = F.least("n", F.greatest(F.lit(0), F.col("grant") - (F.col("through") - F.col("n") - F.col("base")))).cast("bigint")
    asking = asking.select("grp", "shard", "target", "n", moved.alias("moved"))
    parts = F.array(F.struct("shard", (F.col("n") - F.col("moved")).alias("n")), F.struct(F.col("target").alias("shard"), F.col("moved").alias("n")))
    after = asking.select("grp", F.inline(parts)).where("n > 0").unionByName(rows.where("target is null").select("grp", "shard", "n"))
    return after.groupBy("grp", "shard").agg(F.sum("n").alias("n"))


def _to_open_shards(cells: DataFrame, free: list[int], seed: int) -> DataFrame | None:
    """``cells`` after whole groups that lie in several shards have moved to a shard with room for all of them."""
    split = cells.groupBy("grp").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("shards")).where("shards > 1")
    room = [(i, f) for i, f in enumerate(free) if f > 1]
    if not room:
        return None
    shards = F.array(*[F.lit(i) for i, _ in room])
    target = F.element_at(shards, (F.pmod(F.xxhash64("grp", F.lit(seed)), F.lit(len(room))) + 1).cast("int")).cast("int")
    asked = split.select("grp", "n", target.alias("target")).join(
        F.broadcast(cells.sparkSession.createDataFrame(room, "target int, quota bigint")),  # a row a shard
        "target",
    )
    asked = staged(asked.where("n <= quota"), "asked")
    total, bases = {r["target"]: r["n"] for r in asked.groupBy("target").agg(F.sum("n").alias("n")).collect()}, {}
    if not total:
        return None
    for t in sorted(total):
        bases[t] = sum(total[u] for u in total if u < t)
    # Small groups first; what fits by the running sum is admitted.
    asked = global_cumsum(asked, [F.col("target"), F.col("n"), F.col("grp")], {"through": "n"})
    base = F.create_map(*[F.lit(x) for t in bases for x in (t, bases[t])])
    gone = staged(asked.where(F.col("through") - base[F.col("target")] <= F.col("quota")).select("grp", F.col("target").alias("shard"), "n"), "moved")
    return cells.join(gone.select("grp"), "grp", "left_anti").unionByName(gone.select("grp", "shard", "n"))


def propagate(cells: DataFrame, sizes: list[int], log: list[int] | None = None) -> DataFrame:
    """``grp, shard, n`` after label propagation; ``n`` summed over a shard never exceeds its entry of ``sizes``.

    Each move makes the squares of a group's counts sum to more, so moves come to an end. ``log`` gets the cut links before
    each round.
    """
    cells, idle, seed = staged(cells, "cells"), 0, 0
    while idle < PATIENCE:
        load = {r["shard"]: r["n"] for r in cells.groupBy("shard").agg(F.sum("n").alias("n")).collect()}
        free = [s - load.get(i, 0) for i, s in enumerate(sizes)]
        cuts = cut_links(cells)
        if log is not None:
            log.append(cuts)
        if not cuts:
            break
        moved = _to_neighbours(cells, free, seed)
        if moved is None:
            moved = _to_open_shards(cells, free, seed)
        idle, seed = (idle + 1 if moved is None else 0), seed + 1
        cells = cells if moved is None else staged(moved, "cells")
    return cells


def cut_links(cells: DataFrame) -> int:
    """Links between shards, where the copies of a text form a chain: the shards of each group less one."""
    return cells.groupBy("grp").agg((F.count(F.lit(1)) - 1).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def assign_shards(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text", log: list[int] | None = None) -> DataFrame:
    """``id_col, size, text_crc32, shard, slot``: shard sizes in rows differ by one at most; slots have no gaps.

    ``size`` is the text's UTF-8 bytes plus 16. A null text counts as empty, and empty texts are linked like any other.
    Repeated rows get a place each; among rows that tie in id and text it is arbitrary which gets which. Groups larger
    than a shard fill some shards and spill into others. An empty table gives an empty table. ``log`` gets the cut links of
    each round.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    slim = docs.select(
        F.col(id_col).alias("id"),
        (F.octet_length(text) + 16).cast("bigint").alias("size"),
        F.crc32(text).cast("bigint").alias("crc"),
        F.unhex(F.sha2(text, 256)).alias("grp"),
    )
    slim = staged(slim, "slim")
    # Written first, so that both sides of the join are plain exchanges and Spark can split a hot group.
    groups = staged(slim.groupBy("grp").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1"), "groups")
    slim = staged(slim.join(groups, "grp", "left"), "tagged")
    linked = global_index(slim.where("copies is not null").drop("copies"), [F.col("grp"), F.col("id")])
    single = global_index(slim.where("copies is null").drop("grp", "copies"), [F.col("id")])
    n_linked, n_single = linked.count(), single.count()
    sizes = _sizes(n_linked + n_single, shards)
    # Dealt in turn, a shard has no more linked rows than its size.
    cells = linked.groupBy("grp", F.pmod("idx", F.lit(shards)).cast("int").alias("shard")).agg(F.count(F.lit(1)).alias("n"))
    cells = propagate(cells, sizes, log)
    inside = Window.partitionBy("grp").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)
    ranges = global_cumsum(cells, [F.col("shard"), F.col("grp")], {"through": "n"})
    load = {r["shard"]: r["n"] for r in cells.groupBy("shard").agg(F.sum("n").alias("n")).collect()}
    loads = [load.get(s, 0) for s in range(shards)]
    before = F.array(*[F.lit(sum(loads[:s])).cast("bigint") for s in range(shards)])
    ranges = ranges.select(
        "grp",
        "shard",
        "n",
        (F.sum("n").over(inside) - F.col("n")).alias("lo"),
        (F.col("through") - F.col("n") - F.element_at(before, F.col("shard") + 1)).alias("base"),
    )
    starts = linked.groupBy("grp").agg(F.min("idx").alias("start"))
    ranges = staged(ranges.join(starts, "grp").withColumn("lo", F.col("lo") + F.col("start")).drop("start"), "ranges")
    at = (F.col("l.idx") >= F.col("r.lo")) & (F.col("l.idx") < F.col("r.lo") + F.col("r.n"))
    placed = linked.alias("l").join(ranges.alias("r"), (F.col("l.grp") == F.col("r.grp")) & at).select(
        "l.id", "l.size", "l.crc", "r.shard", (F.col("r.base") + F.col("l.idx") - F.col("r.lo")).alias("slot")
    )
    gaps = [s - x for s, x in zip(sizes, loads, strict=True)]
    bounds = [sum(gaps[:s]) for s in range(shards)]
    shard = sum(((F.col("idx") >= b).cast("int") for b in bounds[1:]), F.lit(0))
    fill = F.array(*[F.lit(x - b).cast("bigint") for x, b in zip(loads, bounds, strict=True)])
    filled = single.withColumn("shard", shard).select("id", "size", "crc", "shard", (F.col("idx") + F.element_at(fill, F.col("shard") + 1)).alias("slot"))
    both = placed.unionByName(filled)
    return both.select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "shard", F.col("slot").cast("bigint").alias("slot"))
