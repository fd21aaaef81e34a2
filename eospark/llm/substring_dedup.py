"""Removal of passages that occur more than once, by a hash-compared suffix sort.

Of the hashes of all 64-byte strings within a 400-byte window the least is the window's anchor, so equal windows have the
same anchor at the same place. Windows are handled in runs that share an anchor, and runs whose anchors have equal hashes
form a group. Runs of one group meet with their bytes: equal ones are told by their bytes, and the suffixes at the anchors
of different ones are mergesorted, and so are the reversed prefixes before them. Comparisons find the common extension by
binary search on prefix polynomial hashes, and the extensions of neighbours are verified byte by byte. Two windows are
equal where both extensions reach far enough. Hashes only bring runs together; bytes decide.

A group of very many runs does not meet in one task: its runs are counted by their bytes, and if still too many different
ones are left, each is cut in two by the anchor's place in the window. All windows of a part share a longer string, which
makes the part's group. In the end a part is one window, and a group one string.

The same is done with words in place of bytes, to find passages of more than 50 words that other documents hold too.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eospark.functions.storage import staged

LENGTH, GRAM = 400, 64
#: Passages have at least so many words; their anchors so many.
PASSAGE, WORD_GRAM = 51, 8
#: Runs, or different runs, that one task sorts; larger groups are split.
GROUP = 4096
_BASE = 0x9E3779B97F4A7C15
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BYTES = np.array([xxhash.xxh64_intdigest(bytes([b]), 7) | 1 for b in range(256)], np.uint64)
_POWERS: dict[int, np.ndarray] = {}


class Unit(NamedTuple):
    """What texts are made of: bytes (tag 0) or words (tag 1), and how many make a window and an anchor."""

    tag: int
    length: int
    gram: int

    def split(self, data: bytes) -> bytes | list[bytes]:
        return data.split() if self.tag else data

    def join(self, part: bytes | list[bytes]) -> bytes:
        return b" ".join(part) if self.tag else part

    def values(self, whole: bytes | list[bytes]) -> np.ndarray:
        """A hash of each byte or word."""
        if self.tag:
            return np.array([xxhash.xxh3_64_intdigest(w) for w in whole], np.uint64)
        return _BYTES[np.frombuffer(whole, np.uint8)]


def powers(n: int, base: int = _BASE) -> np.ndarray:
    """The first ``n`` powers of ``base``, modulo 2**64."""
    have = _POWERS.get(base, np.ones(1, np.uint64))
    while len(have) < n:
        have = np.concatenate([have, have * np.uint64(pow(base, len(have), 1 << 64))])
        _POWERS[base] = have
    return have[:n]


def prefix_hashes(values: np.ndarray) -> np.ndarray:
    """Polynomial hashes of all prefixes: entry i is of the first i values, the first one with the lowest power."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(len(values)), out=out[1:])
    return out


def mixed(x: np.ndarray) -> np.ndarray:
    """Scrambled bits: polynomial hashes modulo 2**64 are weak in their low ones."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


_INVERSE = pow(_BASE, -1, 1 << 64)


def gram_hashes(prefix: np.ndarray, size: int) -> np.ndarray:
    """A scrambled hash of the ``size`` values from each position on."""
    n = len(prefix) - size
    if n <= 0:
        return np.zeros(0, np.uint64)
    return mixed((prefix[size:] - prefix[:-size]) * powers(n, _INVERSE))


_PLACE = np.uint64((1 << 24) - 1)


def window_anchors(grams: np.ndarray, width: int) -> np.ndarray:
    """For each run of ``width`` grams, the position of its least one (by all but 24 bits), the last of them if several are."""
    n = len(grams) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    if n + width > 1 << 24:  # positions have 24 bits
        step = (1 << 24) - 2 * width
        return np.concatenate([window_anchors(grams[at : at + step + width - 1], width) + at for at in range(0, n, step)])
    # Sliding minimum from running minima within blocks of ``width``, forwards and backwards.
    places = (grams & ~_PLACE) | (_PLACE - np.arange(len(grams), dtype=np.uint64))
    pad = -len(grams) % width
    blocks = np.concatenate([places, np.full(pad, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return (_PLACE - (np.minimum(back[:n], ahead[width - 1 : width - 1 + n]) & _PLACE)).astype(np.int64)


def runs(whole: bytes | list[bytes], values: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Of each run of windows: anchor hash, first window, windows, distance from the last window to the anchor, and how many
    more windows follow in runs that equal it. Such runs, of periodic text, are one here."""
    if len(values) < length:
        return (np.zeros(0, np.int64),) * 5
    prefix = prefix_hashes(values)
    grams = gram_hashes(prefix, gram)
    anchors = window_anchors(grams, length - gram + 1)
    first = np.flatnonzero(np.concatenate([[True], anchors[1:] != anchors[:-1]]))
    end = np.concatenate([first[1:], [len(anchors)]])
    at, run = anchors[first], end - first
    g, off = grams[at].view(np.int64), anchors[first] - end + 1
    all_ = (prefix[end - 1 + length] - prefix[first]) * powers(len(values) + 1, _INVERSE)[first]
    same = (g[1:] == g[:-1]) & (run[1:] == run[:-1]) & (off[1:] == off[:-1]) & (all_[1:] == all_[:-1])
    more = np.zeros(len(g), np.int64)
    if same.any():
        edges = np.flatnonzero(np.diff(np.concatenate([[0], same.astype(np.int8), [0]])))
        keep = np.ones(len(g), bool)
        for i, j in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            lo, hi, step = int(first[i]), int(end[j]) - 1 + length, int(run[i])
            if whole[lo : hi - step] == whole[lo + step : hi]:  # not just by their hashes
                more[i], keep[i + 1 : j + 1] = (j - i) * step, False
        g, first, run, off, more = (x[keep] for x in (g, first, run, off, more))
    return g, first, run, off, more


def _pack(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _run_rows(units: list[Unit], bits: int):
    """The runs of each text."""
    kinds = {"unit": np.int8, "g": np.int64, "start": np.int32, "run": np.int32, "off": np.int32, "more": np.int32}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                parts: dict[str, list] = {k: [] for k in kinds}
                place = []
                for i, text in enumerate(batch.column(2).to_pylist()):
                    data = _pack(text)
                    for unit in units:
                        whole_ = unit.split(data)
                        g, *own = runs(whole_, unit.values(whole_), unit.length, unit.gram)
                        n, own = len(g), (g >> (64 - bits), *own)
                        for k, x in zip(kinds, (np.full(n, unit.tag), *own), strict=True):
                            parts[k].append(x.astype(kinds[k]))
                        place.append(np.full(n, i))
                take = pa.array(np.concatenate(place))
                cols = [pa.array(np.concatenate(x)) for x in parts.values()]
                if len(take):
                    yield pa.record_batch([batch.column(0).take(take), batch.column(1).take(take), *cols], ["id", "h", *kinds])

    return run


class Suffixes:
    """Strings of integers that begin at places of one array, each with a length; sorted within groups by vectorised mergesort."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, group: np.ndarray):
        self.data, self.starts, self.lengths, self.group = data, starts, lengths, group
        self.prefix, self.power = prefix_hashes(mixed(data.astype(np.uint64) + np.uint64(1))), powers(len(data) + 1)

    def extension(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Common first bytes of strings ``i`` and ``j``, by binary search on prefix hashes."""
        a, b = self.starts[i], self.starts[j]
        lo, hi = np.zeros(len(i), np.int64), np.minimum(self.lengths[i], self.lengths[j])
        pa_, pb, wa, wb = self.prefix[a], self.prefix[b], self.power[b], self.power[a]
        for _ in range(int(hi.max(initial=0)).bit_length()):
            mid = (lo + hi + 1) // 2
            same = (self.prefix[a + mid] - pa_) * wa == (self.prefix[b + mid] - pb) * wb
            lo, hi = np.where(same, mid, lo), np.where(same, hi, mid - 1)
        return lo

    def less(self, i: np.ndarray, j: np.ndarray, ties: np.ndarray) -> np.ndarray:
        """Whether string ``i`` sorts before ``j``; ``ties`` says so for equal ones."""
        n = self.extension(i, j)
        end_i, end_j = n >= self.lengths[i], n >= self.lengths[j]
        last = len(self.data) - 1
        x = np.where(end_i, -1, self.data[np.minimum(self.starts[i] + n, last)].astype(np.int64))
        y = np.where(end_j, -1, self.data[np.minimum(self.starts[j] + n, last)].astype(np.int64))
        return np.where(x == y, ties, x < y)

    def order(self) -> np.ndarray:
        """Sorted order; ``group`` must be ascending and comes first."""
        n = len(self.starts)
        order = np.arange(n)
        begin = np.flatnonzero(np.concatenate([[True], self.group[1:] != self.group[:-1]])) if n else np.zeros(0, np.int64)
        size = np.diff(np.concatenate([begin, [n]]))
        first, count = np.repeat(begin, size), np.repeat(size, size)
        width = 1
        while width < size.max(initial=0):
            at = np.flatnonzero(count > width)
            block = first[at] + (at - first[at]) // (2 * width) * (2 * width)
            middle = np.minimum(block + width, first[at] + count[at])
            end = np.minimum(block + 2 * width, first[at] + count[at])
            left = at < middle
            lo, hi = np.where(left, middle, block), np.where(left, end, middle)
            base = lo.copy()
            for _ in range(width.bit_length()):
                open_ = np.flatnonzero(lo < hi)
                if not len(open_):
                    break
                mid = (lo[open_] + hi[open_]) // 2
                # Equal strings keep their order: those of the left run come first.
                before = self.less(order[mid], order[at[open_]], ~left[open_])
                lo[open_] = np.where(before, mid + 1, lo[open_])
                hi[open_] = np.where(before, hi[open_], mid)
            own = at - np.where(left, block, middle)
            merged = order.copy()
            merged[block + own + (lo - base)] = order[at]
            order = merged
            width *= 2
        return order

    def sorted_with_extensions(self) -> tuple[np.ndarray, np.ndarray]:
        """The order, and each string's verified extension with the one before it (-1 at a group's start)."""
        order = self.order()
        ext = np.full(len(order), -1, np.int64)
        at = np.flatnonzero(self.group[order[1:]] == self.group[order[:-1]]) + 1
        ext[at] = self.extension(order[at - 1], order[at])
        if not self._verified(order, ext, at):  # hashes have clashed: compare bytes instead
            text = self.data.astype(">u8").tobytes()
            key = lambda i: (self.group[i], text[8 * self.starts[i] : 8 * (self.starts[i] + self.lengths[i])])
            order = np.array(sorted(range(len(order)), key=key), np.int64)
            for k in range(1, len(order)):
                i, j = order[k - 1], order[k]
                n = min(self.lengths[i], self.lengths[j])
                other = np.flatnonzero(self.data[self.starts[i] : self.starts[i] + n] != self.data[self.starts[j] : self.starts[j] + n])
                ext[k] = -1 if self.group[i] != self.group[j] else other[0] if len(other) else n
        return order, ext

    def _verified(self, order: np.ndarray, ext: np.ndarray, at: np.ndarray) -> bool:
        """Whether each extension holds byte by byte and ends at a difference, in the right order."""
        if not len(at):
            return True
        i, j, n = order[at - 1], order[at], ext[at]
        most = int(n.max(initial=0))
        for k in range(0, len(at), max(1, (1 << 22) // max(most, 1))):
            part = slice(k, k + max(1, (1 << 22) // max(most, 1)))
            m = n[part]
            step = np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m)
            if (self.data[np.repeat(self.starts[i[part]], m) + step] != self.data[np.repeat(self.starts[j[part]], m) + step]).any():
                return False
        inner = (n < self.lengths[i]) & (n < self.lengths[j])
        x, y = self.data[self.starts[i[inner]] + n[inner]], self.data[self.starts[j[inner]] + n[inner]]
        return bool((x < y).all() and (self.lengths[i[~inner]] == n[~inner]).all())


def repeated_windows(
    group: np.ndarray, strings: list[np.ndarray], low: np.ndarray, high: np.ndarray, run: np.ndarray, off: np.ndarray, length: int = LENGTH
) -> tuple[np.ndarray, np.ndarray]:
    """For runs of windows (group ascending; each with its string, its least and greatest owner, how many windows, and the
    distance from its last window to the anchor): the least and the greatest distance to the anchor of its windows that
    another owner in the group has too (greatest < least if none does)."""
    data = np.concatenate(strings)
    sizes = np.fromiter(map(len, strings), np.int64, len(strings))
    begin = np.cumsum(sizes) - sizes
    far = off + run - 1
    anchor = begin + far
    least, most = np.full(len(run), 1 << 30), np.full(len(run), -1)
    right, right_ext = Suffixes(data, anchor, begin + sizes - anchor, group).sorted_with_extensions()
    left, left_ext = Suffixes(np.ascontiguousarray(data[::-1]), len(data) - anchor, far, group).sorted_with_extensions()
    place_r, place_l = np.empty_like(right), np.empty_like(left)
    place_r[right], place_l[left] = np.arange(len(right)), np.arange(len(left))
    for d in range(int(off.min(initial=0)), int(far.max(initial=-1)) + 1):
        own = np.flatnonzero((off <= d) & (d <= far))
        if not len(own):
            continue
        ahead = np.cumsum(right_ext < length - d)[place_r[own]]
        behind = np.cumsum(left_ext < d)[place_l[own]]
        _, kind = np.unique(ahead * (len(run) + 1) + behind, return_inverse=True)
        first, last = np.full(len(own), np.iinfo(np.int64).max), np.full(len(own), np.iinfo(np.int64).min)
        np.minimum.at(first, kind, low[own])
        np.maximum.at(last, kind, high[own])
        again = own[(first != last)[kind]]
        least[again] = np.minimum(least[again], d)
        most[again] = d
    return least, most


def _symbols(unit: Unit, texts: list[bytes]) -> list[np.ndarray]:
    """Integers that are equal where bytes or words are."""
    if not unit.tag:
        return [np.frombuffer(t, np.uint8) for t in texts]
    known: dict[bytes, int] = {}
    return [np.array([known.setdefault(w, len(known)) for w in t.split()], np.int64) for t in texts]


def _settled(unit: Unit, table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """``repeated_windows`` of a table sorted by group; runs of equal bytes are settled together."""
    g, low, high, run, off = (table.column(c).to_numpy().astype(np.int64) for c in ("g", "low", "high", "run", "off"))
    kinds: dict[tuple, int] = {}
    kind = np.array([kinds.setdefault(x, len(kinds)) for x in zip(g.tolist(), run.tolist(), off.tolist(), table.column("bytes").to_pylist(), strict=True)])
    n = len(kinds)
    first, last = np.full(n, np.iinfo(np.int64).max), np.full(n, np.iinfo(np.int64).min)
    np.minimum.at(first, kind, low)
    np.maximum.at(last, kind, high)
    keys = list(kinds)
    group, runs_, offs = (np.array([k[i] for k in keys], np.int64) for i in range(3))
    again = first != last
    least, most = np.where(again, offs, 1 << 30), np.where(again, offs + runs_ - 1, -1)
    same = group[1:] == group[:-1]
    several = np.flatnonzero(np.concatenate([[False], same]) | np.concatenate([same, [False]]))
    if len(several):
        ids = np.cumsum(np.concatenate([[0], group[several][1:] != group[several][:-1]]))
        strings = _symbols(unit, [keys[i][3] for i in several])
        least[several], most[several] = repeated_windows(ids, strings, first[several], last[several], runs_[several], offs[several], unit.length)
    return least[kind], most[kind]


def _group_spans(units: list[Unit], held_rows: int = GROUP):
    """``least, most`` (see ``repeated_windows``) of rows sorted by unit and group; rows without a repeated window are gone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def work(table: pa.Table) -> Iterator[pa.RecordBatch]:
            tags = table.column("unit").to_numpy()
            for unit in units:
                own = table.filter(pa.array(tags == unit.tag))
                if own.num_rows:
                    least, most = _settled(unit, own)
                    keep = pa.array(most >= least)
                    own = own.append_column("least", pa.array(least.astype(np.int32))).append_column("most", pa.array(most.astype(np.int32)))
                    yield from own.filter(keep).combine_chunks().to_batches()

        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            rows += batch.num_rows
            if rows >= 4 * held_rows:
                table = pa.Table.from_batches(held)
                g, tag = table.column("g").to_numpy(), table.column("unit").to_numpy()
                other = np.flatnonzero((g != g[-1]) | (tag != tag[-1]))
                last = int(other[-1]) + 1 if len(other) else 0
                if last:
                    yield from work(table.slice(0, last).combine_chunks())
                held = table.slice(last).combine_chunks().to_batches()
                rows = table.num_rows - last
        if held:
            yield from work(pa.Table.from_batches(held).combine_chunks())

    return run


def _cut_out(units: list[Unit]):
    """The bytes of the wanted runs of each text; words are joined by one space."""
    by_tag = {u.tag: u for u in units}
    names = ["unit", "g", "start", "run", "off", "more", "large"]
    kinds = [pa.int8(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                rows, place = [], []
                for i, (text, wanted) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                    data = _pack(text)
                    parts = {tag: by_tag[tag].split(data) for tag in {w["unit"] for w in wanted}}
                    for w in wanted:
                        unit = by_tag[w["unit"]]
                        cut = unit.join(parts[unit.tag][w["start"] : w["start"] + w["run"] - 1 + unit.length])
                        rows.append((w["unit"], w["g"], w["start"], w["run"], w["off"], w["more"], w["large"], cut))
                        place.append(i)
                if rows:
                    cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
                    take = pa.array(place)
                    yield pa.record_batch([batch.column(0).take(take), batch.column(1).take(take), *cols], ["id", "h", *names, "bytes"])

    return run


def _width(unit: Unit, level: int) -> int:
    """Places of the anchor in a part of ``2**level``."""
    return -(-(unit.length - unit.gram + 1) // (1 << level))


def _bands(units: list[Unit], level: int, bits: int):
    """Runs cut at places of the anchor that are the same in all runs, ``2**level`` parts of a window's span of places.

    All windows of a part share the string around the anchor that the part's places leave; its hash makes the new group.
    """
    by_tag = {u.tag: u for u in units}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                out, place = [], []
                for i, r in enumerate(batch.select(["unit", "g", "start", "run", "off", "bytes"]).to_pylist()):
                    unit = by_tag[r["unit"]]
                    width = _width(unit, level)
                    parts, far = unit.split(r["bytes"]), r["off"] + r["run"] - 1
                    for band in range(r["off"] // width, far // width + 1):
                        near, off = band * width, max(r["off"], band * width)
                        last = min(far, near + width - 1)
                        core = unit.join(parts[far - near : far + unit.length - near - width + 1])
                        g = xxhash.xxh3_64_intdigest(core, seed=(r["g"] + band) & ((1 << 64) - 1)) >> (64 - bits)
                        cut = unit.join(parts[far - last : far - off + unit.length])
                        out.append((g - (1 << 64) if g >> 63 else g, r["start"] + far - last, last - off + 1, off, cut))
                        place.append(i)
                if out:
                    took = batch.take(pa.array(place))
                    fresh = dict(zip(("g", "start", "run", "off", "bytes"), zip(*out, strict=True), strict=True))
                    cols = [pa.array(fresh[n], took.schema.field(n).type) if n in fresh else took.column(n) for n in took.schema.names]
                    yield pa.record_batch(cols, took.schema.names)

    return run


def _key(left: DataFrame, right: DataFrame) -> Column:
    return left["id"].eqNullSafe(right["_id"]) & (left["h"] == right["_h"])


def _renamed(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({"id": "_id", "h": "_h"})


def _spans(rows: DataFrame, units: list[Unit]) -> DataFrame:
    """``id, h, unit, a, b`` of rows with ``least`` and ``most``."""
    length = F.element_at(F.create_map(*[F.lit(x) for u in units for x in (u.tag, u.length)]), F.col("unit").cast("int"))
    anchor = F.col("start") + F.col("off") + F.col("run") - 1
    return rows.select("id", "h", "unit", (anchor - F.col("most")).alias("a"), (anchor - F.col("least") + length + F.col("more")).alias("b"))


def _of_large_groups(rows: DataFrame, units: list[Unit], group: int, bits: int) -> DataFrame:
    """``id, h, unit, a, b`` of rows (see ``_cut_out``) whose groups are larger than ``group``."""
    keys = ["unit", "g"]
    same = [*keys, "run", "off", "bytes"]
    spans: list[DataFrame] = []
    for level in range(1, 64):  # the first one takes runs as they are
        kinds = staged(rows.groupBy(*same).agg(F.min("low").alias("low"), F.max("high").alias("high")), "kinds")
        if all(_width(u, level - 1) == 1 for u in units):  # a run is a window, a kind a string
            own = kinds.where("low <> high").select(*same, F.col("off").alias("least"), F.col("off").alias("most"))
            spans.append(_spans(rows.join(staged(own, "settled"), same), units))
            break
        many = staged(kinds.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("low").alias("l"), F.max("high").alias("h")).where("l <> h"), "many")
        few = kinds.join(many.where(F.col("n") <= group).select(*keys), keys)
        few = few.repartition(*keys).sortWithinPartitions(*keys).select(*same, "low", "high")
        few = few.mapInArrow(_group_spans(units, group), ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in few.schema) + ", least int, most int")
        # Written first, so that both sides of the join are plain exchanges and Spark can split hot ones.
        spans.append(_spans(rows.join(staged(few.drop("low", "high"), "settled"), same), units))
        left = staged(rows.join(many.where(F.col("n") > group).select(*keys), keys, "left_semi").select(*rows.columns), "left")
        if left.isEmpty():
            break
        schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
        rows = staged(left.mapInArrow(_bands(units, level, bits), schema), "bands")
    out = spans[0]
    for more in spans[1:]:
        out = out.unionByName(more)
    return out


def _owner(last: bool = False) -> Column:
    """Who holds a run: a place in a text, or for words a text. Copies of a text are one and the same here; runs that more
    equal ones follow have a first and a last place."""
    return F.when(F.col("unit") == 1, F.col("h")).otherwise(F.xxhash64("h", F.col("start") + F.col("more") if last else F.col("start")))


def repeated_spans(docs: DataFrame, units: list[Unit], group: int = GROUP, hash_bits: int = 64) -> DataFrame:
    """``id, h, unit, a, b`` for ``docs`` (``id, h, text``; h a hash of the text): ranges of bytes that together cover
    exactly what a window covers that also starts elsewhere, and of words what another document holds too.

    Texts that have copies repeat as a whole: all their rows get a range of unit 2. One row of each such text still meets
    the other texts.
    """
    kind = docs.schema["id"].dataType.simpleString()
    slim = staged(docs.select("id", "h", F.unhex(F.sha2("text", 256)).alias("sha")), "slim")
    # Written first, so that both sides of the join are plain exchanges and Spark can split a hot text.
    copied = staged(slim.groupBy("sha").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first")).where("n > 1"), "copied")
    copies = slim.join(copied, "sha").groupBy("id", "h").agg(F.first("first").alias("first"))
    copies = staged(copies, "copies")
    others = _renamed(copies.where(~F.col("id").eqNullSafe(F.col("first"))).drop("first"))
    found = docs.select("id", "h", "text").mapInArrow(_run_rows(units, hash_bits), f"id {kind}, h bigint, unit byte, g bigint, start int, run int, off int, more int")
    found = staged(found, "runs")
    several = found.groupBy("unit", "g").agg(F.count(F.lit(1)).alias("n"), F.min(F.least(_owner(), _owner(True))).alias("l"), F.max(F.greatest(_owner(), _owner(True))).alias("h"))
    several = staged(several.where("l <> h").select("unit", "g", "n"), "several")

    # Merged at any size: a broadcast of the groups would end as they grow.
    asked = found.join(several.withColumn("large", F.col("n") > group).hint("merge"), ["unit", "g"])
    asked = asked.groupBy("id", "h").agg(F.collect_set(F.struct("unit", "g", "start", "run", "off", "more", "large")).alias("asked"))
    asked = _renamed(asked.join(others, _key(asked, others), "left_anti"))
    rows = docs.join(asked, _key(docs, asked)).select("id", "h", "text", "asked")
    rows = rows.mapInArrow(
        _cut_out(units), f"id {kind}, h bigint, unit byte, g bigint, start int, run int, off int, more int, large boolean, bytes binary"
    )
    low, high = F.least(_owner(), _owner(True)), F.greatest(_owner(), _owner(True))
    # Written at any size, so that small and large groups read texts once.
    cuts = staged(rows.select("id", "h", "unit", "g", low.alias("low"), high.alias("high"), "start", "run", "off", "more", "bytes", "large"), "cuts")

    rows = cuts.where(~F.col("large")).drop("large").repartition("unit", "g").sortWithinPartitions("unit", "g")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    spans = _spans(rows.mapInArrow(_group_spans(units, group), schema + ", least int, most int"), units)
    spans = spans.unionByName(copies.select("id", "h", F.lit(2).cast("byte").alias("unit"), F.lit(0).alias("a"), F.lit(0).alias("b")))
    if several.where(F.col("n") > group).isEmpty():
        return spans
    return spans.unionByName(_of_large_groups(cuts.where("large").drop("large"), units, group, hash_bits))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs that the ranges cover."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def without_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, passage: int = PASSAGE,
    word_gram: int = WORD_GRAM, group: int = GROUP, hash_bits: int = 64,
) -> DataFrame:
    """One row a document: ``id_col, n_bytes, n_removed, n_spans, kept`` (the remaining bytes) and ``passage_words``.

    Every byte goes that lies in a string of ``length`` bytes which also starts anywhere else, be it in the same document.
    Texts are UTF-8; null is empty; texts shorter than ``length`` stay whole. Rows that repeat each other count as
    occurrences each. An empty table gives an empty table. ``passage_words`` counts the words that lie in passages of at
    least ``passage`` words (runs of anything but ASCII white space) which another document holds too; rows are documents
    of their own even if they share an id, and such words are counted only, not removed. Other columns are ignored.
    ``hash_bits`` below 64 only serves tests, which force anchors to clash.
    """
    units = [Unit(0, length, gram), Unit(1, passage, word_gram)]
    src = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).select("id", F.xxhash64("text").alias("h"), "text")
    kind = src.schema["id"].dataType.simpleString()
    spans = repeated_spans(src, units, group, hash_bits).groupBy("id", "h").agg(F.collect_list(F.struct("unit", "a", "b")).alias("spans"))
    spans = _renamed(spans)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                rows = []
                for text, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                    data = _pack(text)
                    gone, held = (merged([(s["a"], s["b"]) for s in found or [] if s["unit"] == u.tag]) for u in units)
                    if any(s["unit"] == 2 for s in found or []):  # the text has copies
                        gone, held = ([(0, n)] if n >= u.length else [] for u, n in ((u, len(u.split(data))) for u in units))
                    edges = [0, *[x for s in gone for x in s], len(data)]
                    kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                    rows.append((len(data), len(data) - len(kept), len(gone), kept, sum(b - a for a, b in held)))
                cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64()), strict=True)]
                yield pa.record_batch([batch.column(0), *cols], ["id", "n_bytes", "n_removed", "n_spans", "kept", "passage_words"])

    joined = src.join(spans, _key(src, spans), "left").select("id", "text", "spans")
    out = joined.mapInArrow(run, f"id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary, passage_words bigint")
    return out.withColumnRenamed("id", id_col)
