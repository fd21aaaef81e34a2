"""Periodic runs of words, found online by catchers over completed blocks whose sizes are powers of two.

A catcher stands on each block of ``s`` words, ``s`` a power of two, as soon as the block is complete. Words that are
appended advance the comparison of the last ``s`` words with the catchers within reach of that size; a word that completes
an equal suffix at distance ``p`` reports a square (or a part of a long stretch) of period ``p``. Each period has one size:
the largest of which an aligned block lies in any run of that period. Reports of a period by neighbouring blocks are one
stretch, which is extended by less than a block to either side; a stretch that a smaller period fills too is left out.

Words appended together advance a size together, as arrays. Equality is judged by hashes first; in the end every run is
compared word by word, and should one not hold all is done again with other hashes, so results are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A run has this many words at least.
MIN_LENGTH = 12
#: Words that are appended together.
CHUNK = 1 << 17
#: Words that a task works on at a time; a longer text is worked on alone.
BATCH = 1 << 19
#: Separators of words.
BLANKS = r"[\x20\x09-\x0D]+"
PRIMES = (2147483647, 2147483629)


def _size(period: np.ndarray, least: int) -> np.ndarray:
    """The block size of each period: a run's equal part has max(period, least - period) words at least, and any stretch of
    2s - 1 words holds an aligned block of s."""
    s = np.ones(len(period), np.int64)
    while (more := 4 * s - 1 <= np.maximum(period, least - period)).any():
        s = np.where(more, 2 * s, s)
    return s


class Catchers:
    """A growing sequence of words (numbers), and the catchers on its blocks."""

    def __init__(self, least: int = MIN_LENGTH, seed: int = 1):
        self.least, self.n = least, 0
        rng = np.random.default_rng(seed)
        self.mix = rng.integers(1, 1 << 62, 2, np.uint64) * np.uint64(2) + np.uint64(1)
        self.base = [int(b) for b in rng.integers(1 << 20, 1 << 30, 2)]
        self.words = np.zeros(1024, np.int64)
        # Hashes of all prefixes, powers of the base and of its inverse, for either prime.
        self.prefix = np.zeros((2, 1025), np.int64)
        self.power = np.ones((2, 2, 1), np.int64)
        self.done: dict[int, int] = {}
        self.caught: list[tuple[np.ndarray, np.ndarray]] = []

    def _powers(self, n: int) -> None:
        while (m := self.power.shape[2]) < n:
            more = np.empty_like(self.power)
            for k, prime in enumerate(PRIMES):
                for inverse in (0, 1):
                    more[inverse, k] = self.power[inverse, k] * pow(self.base[k], -m if inverse else m, prime) % prime
            self.power = np.concatenate([self.power, more], axis=2)

    def _hash(self, at: np.ndarray | slice, to: np.ndarray | slice, k: int) -> np.ndarray:
        """Hashes of words from each place in ``at`` up to that in ``to``."""
        p = self.prefix[k]
        return (p[to] - p[at]) % PRIMES[k] * self.power[1, k][at] % PRIMES[k]

    def _same(self, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
        return (self._hash(a, a + n, 0) == self._hash(b, b + n, 0)) & (self._hash(a, a + n, 1) == self._hash(b, b + n, 1))

    def append(self, words: np.ndarray, reach: dict[int, int] | None = None) -> None:
        """Append words; ``reach`` may say for a size up to where words count (as texts too short for it follow)."""
        for at in range(0, len(words), CHUNK):
            part = words[at : at + CHUNK]
            n, end = self.n, self.n + len(part)
            while len(self.words) < end:
                self.words = np.concatenate([self.words, np.zeros_like(self.words)])
                self.prefix = np.concatenate([self.prefix, np.zeros((2, len(self.words) + 1 - self.prefix.shape[1]), np.int64)], axis=1)
            self._powers(end + 1)
            self.words[n:end] = part
            for k, prime in enumerate(PRIMES):
                mixed = part.astype(np.uint64) * self.mix[k]
                mixed = ((mixed ^ mixed >> np.uint64(31)) * self.mix[k] >> np.uint64(33)).astype(np.int64) % prime
                sums = np.cumsum(mixed * self.power[0, k, n:end] % prime)
                self.prefix[k, n + 1 : end + 1] = (self.prefix[k, n] + sums) % prime
            self.n = end
            self._advance(False, reach)

    def _advance(self, last: bool, reach: dict[int, int] | None) -> None:
        """Compare suffixes that are complete with the catchers in reach, size by size."""
        s = 1
        while s <= max(self.n, 1):
            upto = min(self.n, (reach or {}).get(s, self.n))
            whole = min(self.n - s + 1, upto)  # suffixes may begin before here
            first, stop = self.done.get(s, 0), -(-max(whole, 0) // s) if last else max(whole, 0) // s
            if stop > first:
                self._catch(s, first, stop)
                self.done[s] = stop
            s *= 2

    def _catch(self, s: int, first: int, stop: int) -> None:
        """Suffixes that begin in rows ``first`` to ``stop`` of ``s`` words each, against blocks up to three rows before."""
        low = max(0, first - 3)
        a, b = low * s, min(stop * s, self.n - s + 1)
        own = np.full((stop - low) * s, -1, np.int64)
        own[: b - a] = self._hash(slice(a, b), slice(a + s, b + s), 0)
        own = own.reshape(-1, s)
        for back in range(4):
            periods = back * s + np.arange(s)
            mine = np.flatnonzero((periods > 0) & (_size(np.maximum(periods, 1), self.least) == s))
            rows = np.arange(max(first, back), stop) - low
            if not len(mine) or not len(rows):
                continue
            lo, hi = int(mine[0]), int(mine[-1]) + 1
            row, col = np.nonzero(own[rows[0] : rows[-1] + 1, lo:hi] == own[rows[0] - back : rows[-1] + 1 - back, :1])
            col += lo
            keep = np.isin(col, mine) if len(mine) < hi - lo else slice(None)
            block, period = (row[keep] + rows[0] + low - back) * s, periods[col[keep]]
            keep = self._hash(block, block + s, 1) == self._hash(block + period, block + period + s, 1)
            self.caught.append((block[keep], period[keep]))

    def _extent(self, a: np.ndarray, b: np.ndarray, most: np.ndarray, way: int) -> np.ndarray:
        """How many words after (or before) ``a`` and ``b`` are equal, up to ``most``, by binary search."""
        low, high = np.zeros_like(most), most
        while (low < high).any():
            mid = (low + high + 1) // 2
            same = self._same(a, b, mid) if way > 0 else self._same(a - mid, b - mid, mid)
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low

    def runs(self, reach: dict[int, int] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``start, end, period`` of all runs in what has been appended, by start and period; none if a hash misled."""
        self._advance(True, reach)
        block, period = (np.concatenate([c[i] for c in self.caught]) if self.caught else np.zeros(0, np.int64) for i in (0, 1))
        order = np.lexsort((block, period))
        block, period = block[order], period[order]
        s = _size(period, self.least)
        new = np.ones(len(block), bool)
        new[1:] = (period[1:] != period[:-1]) | (block[1:] != block[:-1] + s[:-1])
        end = np.flatnonzero(np.append(new[1:], True)) if len(block) else np.zeros(0, np.int64)
        first, last, period, s = block[new], block[end] + s[end], period[new], s[new]
        start = first - self._extent(first, first + period, np.minimum(s - 1, first), -1)
        stop = last + period + self._extent(last, last + period, np.clip(self.n - last - period, 0, s - 1), 1)
        keep = stop - start >= np.maximum(self.least, 2 * period)
        start, stop, period = start[keep], stop[keep], period[keep]
        order = np.lexsort((period, stop, start))
        start, stop, period = start[order], stop[order], period[order]
        keep = np.ones(len(start), bool)
        keep[1:] = (start[1:] != start[:-1]) | (stop[1:] != stop[:-1])
        start, stop, period = start[keep], stop[keep], period[keep]
        order = np.lexsort((period, start))
        return start[order], stop[order], period[order]

    def holds(self, runs: tuple[np.ndarray, np.ndarray, np.ndarray]) -> bool:
        """Whether each run has its period, word by word."""
        return all(np.array_equal(self.words[a : b - p], self.words[a + p : b]) for a, b, p in zip(*(x.tolist() for x in runs), strict=True))


def find_runs(texts: list[np.ndarray], least: int = MIN_LENGTH) -> list[list[tuple[int, int, int]]]:
    """``start, length, period`` of the runs of each text, given as numbers of its words (not negative)."""
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))  # large blocks matter to the long ones in front only
    lengths = np.array([len(texts[i]) for i in order], np.int64)
    starts = np.concatenate([[0], np.cumsum(lengths + 1)])
    joined = np.empty(int(starts[-1]), np.int64)
    for k, i in enumerate(order):
        joined[starts[k] : starts[k + 1] - 1] = texts[i]
        joined[starts[k + 1] - 1] = -1 - k  # unlike any other, so that nothing reaches across
    reach, s = {}, 1
    while s <= max(len(joined), 1):
        shortest = least if 2 * s <= least else max(least, 4 * s - 2)  # no shorter text has a run that this size catches
        reach[s] = int(starts[np.searchsorted(-lengths, -shortest, side="right")])
        s *= 2
    seed = 1
    while True:
        catchers = Catchers(least, seed)
        catchers.append(joined, reach)
        found = catchers.runs(reach)
        if catchers.holds(found):
            break
        seed += 1
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    where = np.searchsorted(starts, found[0], side="right") - 1
    for k, a, b, p in zip(where.tolist(), *(x.tolist() for x in found), strict=True):
        out[order[k]].append((a - int(starts[k]), b - a, p))
    return out


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = MIN_LENGTH) -> DataFrame:
    """``id_col, runs array<struct<start,length,period>>, collapsed``: the periodic runs of words of each whole text, by start
    and period, and its words without those that repeat a run's first period, joined by one space.

    A run is a stretch with smallest period ``period`` of max(least, 2 * period) words at least that no neighbouring word
    extends. Words are separated by ASCII blanks. A null, empty or blank text has no runs and collapses to nothing. Rows are
    worked on where they are, without a shuffle: repeated rows and null ids are rows of their own, an empty table gives an
    empty table and other columns are ignored. A text of any length is worked on whole, with memory in proportion to it.
    """
    run_type = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> str:
        if runs:
            gone = np.zeros(len(words) + 1, np.int64)
            for a, n, p in runs:
                gone[a + p] += 1
                gone[a + n] -= 1
            words = [words[i] for i in np.flatnonzero(np.cumsum(gone[:-1]) == 0).tolist()]
        return b" ".join(words).decode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                words, size, first = [], 0, at
                while at < batch.num_rows and (size < BATCH or not words):
                    words.append((batch.column(1)[at].as_py() or b"").split())  # of bytes: at ASCII blanks
                    size += len(words[-1])
                    at += 1
                numbers = np.asarray(pa.array([w for own in words for w in own], pa.binary()).dictionary_encode().indices, np.int64)
                found = find_runs(np.split(numbers, np.cumsum([len(own) for own in words])[:-1]), least)
                runs = pa.array([[dict(zip(("start", "length", "period"), r, strict=True)) for r in own] for own in found], pa.list_(run_type))
                text = pa.array([collapsed(w, r) for w, r in zip(words, found, strict=True)], pa.string())
                yield pa.record_batch([batch.column(0).slice(first, at - first), runs, text], ["id", "runs", "collapsed"])

    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    kind = src.schema["id"].dataType.simpleString()
    out = src.mapInArrow(run, f"id {kind}, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")
    return out.withColumnRenamed("id", id_col)


def with_periodic_tails(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, text_col``, where one text in ten (by a hash of its id; none with a null id) gets a periodic end.

    With ``h`` the CRC-32 of the decimal id and ``g = h div 10``, words from ``a = g mod n`` on repeat the ``p = 1 + (n - a) div
    (3 + g mod 8)`` first of them.
    """
    words = F.filter(F.split(F.col(text_col).cast("string"), BLANKS), lambda w: w != "")
    h = F.crc32(F.col(id_col).cast("string").cast("binary"))
    src = docs.select(F.col(id_col), F.col(text_col), F.when(h % 10 == 0, words).alias("w"), F.floor(h / 10).alias("g"))
    src = src.withColumn("n", F.size("w")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    src = src.withColumn("p", F.lit(1) + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    word = lambda i: F.col("w")[F.when(i < F.col("a"), i).otherwise(F.col("a") + F.pmod(i - F.col("a"), F.col("p"))).cast("int")]
    edited = F.array_join(F.transform(F.sequence(F.lit(0), F.col("n") - 1), word), " ")
    return src.select(id_col, F.when(F.col("n") > 0, edited).otherwise(F.col(text_col).cast("string")).alias(text_col))


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Of ``periodic_runs``: the number of runs, the longest one (ties: least start, then period), hashes of runs and text."""
    line: Column = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    lines = F.concat(F.array_join(line, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("a"), (-r["period"]).alias("p"))))
    src = found.withColumn("_best", best)
    length, start, period = F.col("_best.length"), -F.col("_best.a"), -F.col("_best.p")
    return src.select(
        id_col,
        F.size("runs").cast("bigint").alias("n_runs"),
        start.alias("start"),
        length.alias("length"),
        period.alias("period"),
        F.floor(1000 * length / period).alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
