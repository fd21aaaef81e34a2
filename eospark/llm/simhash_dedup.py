"""Near-duplicate groups by SimHash and multi-index hashing.

A fingerprint is cut into segments. If two fingerprints differ in at most r bits, some segment differs in no more bits
than its share of r, so the other one is found in the segment's table at a key in a small Hamming ball around its own.
What shares a key is compared as a whole. Only distinct fingerprints take part; a bucket gives out the links of a
spanning forest, not all its pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eospark.functions.storage import staged
from eospark.llm.components import component_labels
from eospark.llm.rows import one_of_each, row_key

SEED = 42
#: A bucket of more rows is compared in blocks of so many, by as many tasks as there are pairs of blocks.
BLOCK = 4096
_PAIRS = 1 << 21
#: Members and shingles in a block of whole sets, about; larger groups are settled by two blocks at a time.
SET_BLOCK, SET_SHINGLES = 1024, 1 << 18
_ODD = np.array([xxhash.xxh64_intdigest(i.to_bytes(2, "little"), SEED) | 1 for i in range(1024)], np.uint64)


def shingles(text: str | None, size: int) -> list[bytes]:
    """All runs of ``size`` words, lower-cased A-Z, joined by a space; a shorter text is one run, an empty one none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= size:
        return [joined]
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    return [joined[a:b] for a, b in zip(starts[: 1 - size or None].tolist(), ends[size - 1 :].tolist(), strict=True)]


def fingerprint(text: str | None, size: int = 4) -> int:
    """The 64-bit SimHash of a text's shingles: a bit is set if it is in over half of the hashes."""
    runs = shingles(text, size)
    hash_of = xxhash.xxh64_intdigest
    hashes = np.array([hash_of(x, SEED) for x in runs], "<u8")
    votes = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        part = hashes[at : at + (1 << 15)].view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(hashes), bitorder="little").view("<u8")[0])


def set_hashes(text: str | None, size: int) -> np.ndarray:
    """The distinct 64-bit hashes of a text's shingles, sorted."""
    return np.unique(np.array([xxhash.xxh3_64_intdigest(x, SEED) for x in shingles(text, size)], np.uint64))


def long_fingerprint(hashes: np.ndarray, words: int) -> np.ndarray:
    """A SimHash of ``words`` times 64 bits of a set of hashes; each 64 bits come from scrambling the hashes anew."""
    votes = np.zeros(64 * words, np.int64)
    for at in range(0, len(hashes), 240):  # counts up to 255 fit a byte
        x = hashes[at : at + 240, None] * _ODD[None, :words]
        x ^= x >> np.uint64(32)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(29)
        votes += np.add.reduce(np.unpackbits(x.view(np.uint8).reshape(len(x), -1), axis=1, bitorder="little"), axis=0, dtype=np.uint8)
    return np.packbits(2 * votes > len(hashes), bitorder="little").view("<u8")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4) -> DataFrame:
    """``id, fp`` (the fingerprint's bits as a long). Null is empty, and empty texts have fingerprint zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                fps = np.array([fingerprint(t, size) for t in batch.column(1).to_pylist()], np.uint64)
                yield pa.record_batch([batch.column(0), pa.array(fps.view(np.int64))], ["id", "fp"])

    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(run, f"id {src.schema['id'].dataType.simpleString()}, fp bigint")


def set_prints(docs: DataFrame, id_col: str, text_col: str, size: int, words: int) -> DataFrame:
    """``id, text_key`` (of the text's bytes), ``s1, s2`` (a hash of the set of shingles), ``n`` (their number) and
    ``words``, a fingerprint of ``words`` longs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                sets = [set_hashes(t, size) for t in batch.column(1).to_pylist()]
                wholes = np.frombuffer(b"".join(xxhash.xxh3_128_digest(x.tobytes(), SEED) for x in sets), np.int64).reshape(-1, 2)
                fps = np.array([long_fingerprint(x, words) for x in sets], np.uint64).view(np.int64)
                made = pa.ListArray.from_arrays(np.arange(len(sets) + 1, dtype=np.int32) * words, pa.array(fps.ravel()))
                cols = [batch.column(0), batch.column(2), pa.array(wholes[:, 0]), pa.array(wholes[:, 1]), pa.array([len(x) for x in sets], pa.int64()), made]
                yield pa.record_batch(cols, ["id", "text_key", "s1", "s2", "n", "words"])

    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), _text_key(text_col).alias("text_key"))
    return src.mapInArrow(run, f"id {src.schema['id'].dataType.simpleString()}, text_key binary, s1 bigint, s2 bigint, n bigint, words array<bigint>")


def segments(distinct: int, radius: int) -> list[tuple[int, int, int, int]]:
    """(word, first bit, width, ball radius) of each segment of a 64-bit fingerprint.

    Radii add up to ``radius`` - segments + 1, so that not every segment can differ in more bits than its radius. Up to
    radius 6 there are three segments of 21 or 22 bits as long as there are fewer than 2**28 fingerprints, and two beyond
    that, so that a key keeps few chance matches. Larger radii take a segment for each two bits, or balls would become
    very large. Whatever the segments, all links are found.
    """
    m = radius // 2 if radius > 6 else 3 if distinct < 1 << 28 else 2
    spare = max(radius - m + 1, 0)
    ends = [64 * (i + 1) // m for i in range(m)]
    starts = [0, *ends[:-1]]
    return [(0, a, b - a, spare // m + (i >= m - spare % m)) for i, (a, b) in enumerate(zip(starts, ends, strict=True))]


def differing(similarity: float) -> float:
    """The share of bits in which SimHashes of sets of that Jaccard similarity differ, on average: their angle over pi."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def similar_segments(count: int, similarity: float, recall: float = 0.99) -> list[tuple[int, int, int, int]]:
    """(word, first bit, width, ball radius) of segments that find a pair of just ``similarity`` with chance ``recall``.

    Segments are ``SHARED`` bits narrower than the count of texts, so that a key holds at most 2**SHARED chance matches on
    average at any size: comparing those costs less than the rows of the further tables that wider segments would need.
    The number of segments follows from the chance that one differs in no more bits than its ball. A ball of radius one
    finds two to four times as many pairs as a lone key, for about ten keys: the first segments have one, the others get
    by without.
    """
    width, p = min(max(8, count.bit_length() - SHARED), 32), differing(similarity)
    alone = (1 - p) ** width
    ball = alone + width * p * (1 - p) ** (width - 1)
    rest = math.log(1 - recall) - BALLS * math.log(1 - ball)
    radii = [1] * BALLS + [0] * max(0, math.ceil(rest / math.log(1 - alone)))
    return [(i // (64 // width), i % (64 // width) * width, width, r) for i, r in enumerate(radii)]


def _ball(width: int, radius: int) -> np.ndarray:
    """Bit masks of 1 to ``radius`` bits within ``width``."""
    found, last = [], [0]
    for _ in range(radius):
        last = [x | 1 << i for x in last for i in range(width) if x >> i == 0]
        found += last
    return np.array(found, np.uint64)


def _table_rows(plan: list[tuple[int, int, int, int]]):
    """Per fingerprint: a row of role 0 for its own key in each table, and rows of role 1 for the keys to be looked up.

    Of two fingerprints that differ within a segment, the one whose lowest differing bit is unset looks the other up, so
    that a pair meets once. The first column holds the fingerprints' words; the other columns are repeated in each row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                part = whole.slice(at, 4096)
                words = part.column(0).flatten().to_numpy().view(np.uint64).reshape(part.num_rows, -1)
                everyone = np.arange(part.num_rows)
                keys, rows, roles = [], [], []
                for i, (word, shift, width, radius) in enumerate(plan):
                    own = (words[:, word] >> np.uint64(shift)) & np.uint64((1 << width) - 1)
                    tag = np.uint64(i << 40)
                    keys.append(own | tag)
                    rows.append(everyone)
                    roles.append(np.zeros(len(own), np.int8))
                    for mask in _ball(width, radius):
                        low = mask & (~mask + np.uint64(1))
                        ask = np.flatnonzero((own & low) == 0)
                        keys.append((own[ask] ^ mask) | tag)
                        rows.append(ask)
                        roles.append(np.ones(len(ask), np.int8))
                take = pa.array(np.concatenate(rows))
                cols = [pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(roles))]
                yield pa.record_batch([*cols, *(c.take(take) for c in part.columns[1:])], ["k", "role", *part.schema.names[1:]])

    return run


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that join the same nodes as the given ones, one less than nodes in each component."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        x, y = root[i], root[j]
        differ = x != y
        if not differ.any():
            break
        i, j, x, y = i[differ], j[differ], x[differ], y[differ]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    moved = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[moved], nodes[root[moved]]


def _near(words: list[np.ndarray], radii: list[int], row: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Those of the pairs whose first words differ in at most the first radius, the first two in at most the second, etc."""
    differ = np.zeros(len(row), np.int64)
    for word, radius in zip(words, radii, strict=True):
        differ += np.bitwise_count(word[row] ^ word[other])
        near = differ <= radius
        row, other, differ = row[near], other[near], differ[near]
    return row, other


def _bucket_links(key: np.ndarray, role: np.ndarray, words: list[np.ndarray], radii: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of linked rows within the buckets of rows that are sorted by key and role: what is near a bucket's first row
    is linked to it, and then all pairs are compared but those of two such rows."""
    n = len(key)
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    bucket = np.repeat(np.arange(len(first)), np.diff(np.concatenate([first, [n]])))
    members = np.add.reduceat((role == 0).astype(np.int64), first)
    every = np.flatnonzero((members[bucket] > 0) & (np.arange(n) != first[bucket]))
    row, lead = _near(words, radii, every, first[bucket[every]])
    if len(row):
        yield row, lead
    joined = np.zeros(n, bool)
    joined[row] = True
    joined[first] = members > 0
    # Within a bucket: members that are not joined, then those that are, then lookups. Partners are the first rows of it.
    order = np.lexsort((joined, role, bucket))
    joined, lookup = joined[order], role[order] != 0
    rest = np.add.reduceat((~joined & ~lookup).astype(np.int64), first)
    place = np.arange(n) - first[bucket]
    partners = np.where(joined, rest[bucket], np.where(lookup, members[bucket], place))
    ends = np.cumsum(partners)
    at = 0
    while at < n:
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _PAIRS, side="right")))
        count = partners[at:stop]
        total = int(count.sum())
        if total:
            row = np.repeat(np.arange(at, stop), count)
            other = first[bucket[row]] + np.arange(total) - np.repeat(np.cumsum(count) - count, count)
            row, other = _near(words, radii, order[row], order[other])
            if len(row):
                yield row, other
        at = stop


def _compare(radii: list[int]):
    """Links of the rows ``k, role, fp[, fp2], node``, as a forest over the nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        links: list[tuple[np.ndarray, np.ndarray]] = []

        def work(rows: list) -> None:
            key, role, *words, node = (np.concatenate(x) for x in zip(*rows, strict=True))
            words = [w.view(np.uint64) for w in words]
            for i, j in _bucket_links(key, role, words, radii):
                links.append((node[i], node[j]))
                if sum(len(x[0]) for x in links) > _PAIRS:
                    links[:] = [_forest(*(np.concatenate(x) for x in zip(*links, strict=True)))]

        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            last = int(np.searchsorted(cols[0], cols[0][-1], side="left"))
            if last:
                work([*held, [c[:last] for c in cols]])
                held = []
            elif held and held[-1][0][-1] != cols[0][-1]:
                work(held)
                held = []
            held.append([c[last:] for c in cols])
        if held:
            work(held)
        if links:
            a, b = _forest(*(np.concatenate(x) for x in zip(*links, strict=True)))
            yield pa.record_batch([pa.array(a), pa.array(b)], ["a", "b"])

    return run


def _dealt(rows: DataFrame, group: str, name: str) -> DataFrame:
    """The rows of each ``group`` in keys ``k`` of two blocks each, so that any two rows meet but those of the ``core``.

    ``rest`` and ``cores`` say how many blocks the group's rows outside and inside the core are dealt to. Groups that are
    all core are gone; a row is repeated for each block that its own has to meet.
    """
    every = F.col("rest") + F.col("cores")
    own = F.when(F.col("core"), F.col("rest") + F.pmod(F.xxhash64(name), F.col("cores"))).otherwise(F.pmod(F.xxhash64(name), F.col("rest"))).cast("int")
    other = F.when(F.col("core"), F.sequence(F.lit(0), F.col("rest") - 1)).otherwise(
        F.when(every == 1, F.array(F.lit(0))).otherwise(F.filter(F.sequence(F.lit(0), every - 1), lambda x: x != F.col("_i")))
    )
    rows = rows.where("rest > 0").withColumn("_i", own).withColumn("_j", F.explode(other))
    return rows.withColumn("k", F.xxhash64(group, F.least("_i", "_j"), F.greatest("_i", "_j")))


def links(nodes: DataFrame, plan: list[tuple[int, int, int, int]], radii: list[int], block: int = BLOCK) -> DataFrame:
    """``a, b``: links that join exactly those nodes (``node, words``) that chains of near fingerprints join.

    Nodes are compared if they meet in a table of ``plan``. Near means at most ``radii[0]`` differing bits of the first
    word, at most ``radii[1]`` of the first two, and so on. Rows of a key that are near its first one are linked to it and
    not compared with each other. Keys of more than ``block`` rows get the same in parts: see ``_dealt``.
    """
    words = [f"w{i}" for i in range(len(radii))]
    names = [*words, "node"]
    schema = "k bigint, role byte, " + ", ".join(f"{n} bigint" for n in names)
    carried = nodes.select("words", *[F.get("words", F.lit(i)).alias(w) for i, w in enumerate(words)], "node")
    rows = carried.mapInArrow(_table_rows(plan), schema)
    # Keys that may have more than ``block`` rows, by the rows of one node in ``share``, so that counting moves few rows; a key
    # is then counted whole. One that were missed would be compared in one task, with the same links.
    share = max(1, min(16, block // 64))
    some = carried.where(F.pmod(F.xxhash64("node"), F.lit(share)) == 0).mapInArrow(_table_rows(plan), schema)
    some = some.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block // (2 * share))
    some = staged(some.select(F.col("k").alias("key")), "maybe-hot")
    hot = out = None
    if not some.isEmpty():
        hot = rows.join(some, F.col("k") == F.col("key"))
        hot = hot.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("role", *names)).alias("first"))
        hot = staged(hot.where((F.col("n") > block) & (F.col("first.role") == 0)).select("key", "first"), "hot")
    if hot is not None and not hot.isEmpty():
        near, differ = F.lit(True), F.lit(0)
        for w, radius in zip(words, radii, strict=True):
            differ = differ + F.bit_count(F.col(w).bitwiseXOR(F.col("first")[w]))
            near &= differ <= radius
        split = staged(rows.join(hot, F.col("k") == F.col("key")).select("key", "role", *names, F.col("first.node").alias("lead"), near.alias("core")), "hot-rows")
        count = lambda of: F.ceil(F.sum(of.cast("int")) / block).cast("int")
        sizes = staged(split.groupBy("key").agg(count(~F.col("core")).alias("rest"), count(F.col("core")).alias("cores")), "hot-sizes")
        out = split.where("core and lead <> node").select(F.col("lead").alias("a"), F.col("node").alias("b"))
        dealt = _dealt(split.join(sizes, "key"), "key", "node").select("k", "role", *names)
        rows = rows.join(hot, F.col("k") == F.col("key"), "left_anti").unionByName(dealt)
    met = rows.repartition("k").sortWithinPartitions("k", "role").mapInArrow(_compare(radii), "a bigint, b bigint")
    return met.unionByName(out) if out else met


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4, radius: int = 4, block: int = BLOCK) -> DataFrame:
    """One row a document: ``id_col, fingerprint`` (16 hex digits) and ``component_id``, the smallest linked id.

    Null and empty texts have fingerprint zero and are linked like any other. Rows that repeat an id are rows of their
    own. Null ids are never the smallest unless all are. An empty table gives an empty table.
    """
    prints = staged(fingerprints(docs, id_col, text_col, size).withColumn("node", F.col("fp")), "prints")
    nodes = staged(prints.groupBy("node").agg(F.min("id").alias("least"), F.array(F.col("node")).alias("words")), "nodes")
    near = links(nodes, segments(nodes.count(), radius), [radius], block)
    labels = component_labels(near).withColumnRenamed("node", "_node")
    nodes = nodes.join(labels, F.col("node") == F.col("_node"), "left").select("node", "least", F.coalesce("label", "node").alias("label"))
    nodes = staged(nodes, "labelled")
    # Written first, so that both sides of the join are plain exchanges and Spark can split a hot component.
    groups = staged(nodes.groupBy("label").agg(F.min("least").alias("component_id")), "groups")
    nodes = staged(nodes.join(groups, "label").select("node", "component_id"), "components")
    return prints.join(nodes, "node").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def set_links(sets: list[np.ndarray], joint: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Places of alike pairs, as a forest that joins what all alike pairs join; equal ``joint`` are joined already.

    Sets that are alike share one of their rarest elements (prefix filter), here by counts among ``sets``. What is joined
    already is not compared again.
    """
    size = np.array([len(x) for x in sets], np.int64)
    ends = np.cumsum(size)
    starts = ends - size
    _, token, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    order = np.argsort(count, kind="stable")
    rank = np.empty_like(order)
    rank[order] = np.arange(len(order))
    token, count = rank[token], count[order]
    heads = []
    for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
        token[a:b].sort()
        # An alike set holds at least this share of the set, less what floats may lose.
        head = token[a : b - int(np.ceil(similarity * (b - a) - 1e-9)) + 1] if b > a else token[a:a]
        heads.append(head[count[head] > 1])
    where = np.repeat(np.arange(len(sets)), [len(h) for h in heads])
    flat = np.concatenate(heads)
    by = np.argsort(flat, kind="stable")
    where = where[by]
    begin = np.searchsorted(flat[by], np.arange(len(count) + 1))
    root = np.unique(joint, return_inverse=True)[1]
    mark, near = np.zeros(len(count), bool), np.zeros(len(sets), bool)
    links: list[tuple[int, int]] = []
    for i in range(1, len(sets)):
        near[:] = False
        for t in heads[i].tolist():
            near[where[begin[t] : begin[t + 1]]] = True
        others = np.flatnonzero(near[:i] & (root[:i] != root[i]))
        others = others[np.minimum(size[others], size[i]) >= similarity * np.maximum(size[others], size[i]) - 1e-9]
        if not len(others):
            continue
        mark[token[starts[i] : ends[i]]] = True
        # First one of each component, as most often that settles all of it.
        first = np.unique(root[others], return_index=True)[1]
        step = max(1, (1 << 21) // int(size[others].max()))
        rest = np.delete(others, first)
        for part in (others[first], *(rest[k : k + step] for k in range(0, len(rest), step))):
            part = part[root[part] != root[i]]
            if not len(part):
                continue
            at = np.cumsum(size[part]) - size[part]
            place = np.arange(int(size[part].sum())) + np.repeat(starts[part] - at, size[part])
            shared = np.add.reduceat(mark[token[place]].astype(np.int64), at)
            for j in part[shared / (size[part] + size[i] - shared) >= similarity].tolist():
                if root[j] != root[i]:
                    links.append((i, j))
                    root[root == root[j]] = root[i]
        mark[token[starts[i] : ends[i]]] = False
    return links


def _settle(similarity: float):
    """Links of the rows ``k, joint, node, hashes``, sorted by k: all pairs under a key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def found() -> list[tuple[int, int]]:
            rows = pa.Table.from_batches(held)
            node, joint = rows["node"].to_numpy(), rows["joint"].to_numpy()
            sets = [x.values.to_numpy() for part in rows["hashes"].chunks for x in part]
            return [(int(node[i]), int(node[j])) for i, j in set_links(sets, joint, similarity)]

        def table(links: list[tuple[int, int]]) -> pa.RecordBatch:
            return pa.record_batch([pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            key, links = batch.column(0).to_numpy(), []
            cuts = [0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), len(key)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if held and held[-1].column(0)[0].as_py() != key[a]:
                    links += found()
                    held.clear()
                held.append(batch.slice(a, b - a))
            yield table(links)
        if held:
            yield table(found())

    return run


def _text_key(text_col: str):
    return F.unhex(F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")), 256))


def whole_sets(docs: DataFrame, wanted: DataFrame, text_col: str, size: int) -> DataFrame:
    """``text_key, hashes``: the distinct shingle hashes, of 64 bits, of the texts whose keys are in ``wanted``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                sets = [set_hashes(t, size).view(np.int64) for t in batch.column(1).to_pylist()]
                yield pa.record_batch([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], ["text_key", "hashes"])

    rows = docs.select(_text_key(text_col).alias("text_key"), F.col(text_col).cast("string").alias("text"))
    rows = rows.join(wanted.select("text_key").distinct(), "text_key", "left_semi").groupBy("text_key").agg(F.first("text").alias("text"))
    return rows.select("text_key", "text").mapInArrow(run, "text_key binary, hashes array<bigint>")


def exact_links(members: DataFrame, similarity: float) -> DataFrame:
    """``a, b``: a forest of the alike pairs within groups (``label, node, joint, core, n, hashes``), by whole sets.

    Each group is dealt to blocks, and each two blocks are compared by one task. Pairs within the core, which is joined
    already, are left out; a group that is all core costs nothing.
    """

    def blocks(of) -> F.Column:
        need = F.greatest(F.sum(F.when(of, 1).otherwise(0)) / SET_BLOCK, F.sum(F.when(of, F.col("n")).otherwise(0)) / SET_SHINGLES)
        return F.ceil(need).cast("int")

    plan = members.groupBy("label").agg(blocks(~F.col("core")).alias("rest"), blocks(F.col("core")).alias("cores"))
    members = members.join(staged(plan, "blocks"), "label")
    rows = _dealt(members, "label", "node")
    return rows.select("k", "joint", "node", "hashes").repartition("k").sortWithinPartitions("k").mapInArrow(_settle(similarity), "a bigint, b bigint")


def verified_links(members: DataFrame, similarity: float) -> DataFrame:
    """``a, b``: links that join what all alike pairs within candidate groups (``label, node, word, n, hashes``) join.

    Every member is compared with its group's centre, the one whose ``word`` of fingerprint is nearest to the majority.
    What is like the centre is the group's core; all pairs but those within the core are then compared. Both times whole
    sets are compared. One rule holds for groups of any size: where all are like the centre, as copies of one text are,
    the work grows with the group, and else with the members outside the core times the group, in bounded tasks.
    """
    members = staged(members, "members")
    half = F.count(F.lit(1)) / 2
    majority = F.lit(0).cast("bigint")
    for k in range(64):
        ones = F.sum(F.shiftrightunsigned("word", k).bitwiseAND(1))
        majority = majority.bitwiseOR(F.when(ones > half, F.shiftleft(F.lit(1).cast("bigint"), k)).otherwise(0))
    majority = staged(members.groupBy("label").agg(majority.alias("majority")), "majority")
    off = F.bit_count(F.col("word").bitwiseXOR(F.col("majority")))
    centre = members.join(majority, "label").groupBy("label").agg(F.min(F.struct(off, "node")).alias("x")).select("label", F.col("x.node").alias("a"))
    sets = members.select(F.col("label").alias("_l"), F.col("node").alias("a"), F.col("n").alias("size"), F.col("hashes").alias("own"))
    # Written first, so that both sides of the join are plain exchanges and Spark can split a hot group.
    centre = staged(centre.join(sets, (F.col("label") == F.col("_l")) & (centre["a"] == sets["a"])).select("label", centre["a"], "size", "own"), "centres")
    shared = F.size(F.array_intersect("hashes", "own"))
    core = (F.col("node") == F.col("a")) | (shared / (F.col("n") + F.col("size") - shared) >= similarity)
    judged = members.join(centre, "label").select("label", "node", "n", "hashes", "a", core.alias("core"))
    judged = staged(judged.withColumn("joint", F.when(F.col("core"), F.col("a")).otherwise(F.col("node"))), "judged")
    return judged.where("core and a <> node").select("a", F.col("node").alias("b")).unionByName(exact_links(judged, similarity))


#: Shingles alike to 0.8 (Jaccard) differ in about 0.15 of their fingerprints' bits. Of segments with a ball there are so
#: many; candidates differ in at most so many of 128 bits, four standard errors more than expected, and are then verified.
#: Texts that share a key by chance are 2**SHARED at most, on average.
SIMILARITY, BALLS, WIDE_RADIUS, SHARED = 0.8, 2, 36, 6


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, similarity: float = SIMILARITY) -> DataFrame:
    """``id_col, component_id``: groups linked by pairs of texts whose runs of ``size`` words are alike (Jaccard).

    Candidates come from fingerprints, hence a pair may be missed that chance holds apart (see ``similar_segments``); what
    is linked is verified by whole sets, also if fingerprints are equal. Texts of equal sets of runs are one node. Null
    and empty texts are alike. Rows that repeat an id are rows of their own; a null id is never the smallest unless all
    are. Texts of any length count whole. An empty table gives an empty table; other columns are ignored.
    """
    prints, nodes = _similar(docs, id_col, text_col, size, similarity)
    return prints.join(nodes, ["s1", "s2"]).select(F.col("id").alias(id_col), F.col("least.id").alias("component_id"))


def _similar(docs: DataFrame, id_col: str, text_col: str, size: int, similarity: float) -> tuple[DataFrame, DataFrame]:
    """``id, s1, s2, text_key`` of all rows, and ``s1, s2, least`` (the group's first row) of all sets of shingles."""
    plan = similar_segments(docs.count(), similarity)
    prints = staged(set_prints(docs, id_col, text_col, size, max(2, plan[-1][0] + 1)), "prints")
    row = F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("text_key").alias("text_key"))
    nodes = prints.groupBy("s1", "s2").agg(F.min(row).alias("least"), F.first("n").alias("n"), F.first("words").alias("words"))
    nodes = staged(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    near = links(nodes, plan, [64, WIDE_RADIUS])
    labels = staged(component_labels(near), "candidates")
    both = labels.unionByName(labels.select(F.col("label").alias("node"), "label")).distinct()
    own = staged(nodes.join(both, "node").select("label", "node", F.get("words", F.lit(0)).alias("word"), "n", F.col("least.text_key").alias("text_key")), "grouped")
    own = own.join(whole_sets(docs, own, text_col, size), "text_key").select("label", "node", "word", "n", "hashes")
    final = component_labels(verified_links(own, similarity)).withColumnRenamed("node", "_node")
    nodes = nodes.join(final, F.col("node") == F.col("_node"), "left").select("s1", "s2", "least", F.coalesce("label", "node").alias("label"))
    nodes = staged(nodes, "labelled")
    # Written first, so that both sides of the join are plain exchanges and Spark can split a hot component.
    groups = staged(nodes.groupBy("label").agg(F.min("least").alias("least")), "groups")
    nodes = staged(nodes.drop("least").join(groups, "label").select("s1", "s2", "least"), "components")
    return prints.select("id", "s1", "s2", "text_key"), nodes


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with one row of each group of near duplicates, that with the smallest id; all columns stay.

    Groups: see ``similar_groups``. Rows that share an id are told apart by their texts; of rows that repeat both, one
    stays at most.
    """
    prints, nodes = _similar(docs, id_col, text_col, size, similarity)
    same = F.col("id").eqNullSafe(F.col("least.id")) & (F.col("text_key") == F.col("least.text_key"))
    gone = prints.join(nodes, ["s1", "s2"]).where(~same).select(row_key(F.col("id"), F.col("text_key")).alias("_key"))
    return one_of_each(docs, row_key(docs[id_col], _text_key(text_col)), gone)
