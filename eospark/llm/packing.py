"""Best-two-fit packing of token pieces into sequences of a fixed capacity.

Only lengths decide how bins are filled, and there are at most ``capacity`` different ones. So the plan is made from
the histogram of lengths, which has a fixed size however many documents there are; it says which ranks of each length
go to which sequence. Spark then ranks the pieces by length and looks their places up.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eospark.functions.storage import staged
from eospark.operators.global_order import global_index

CAPACITY = 2048
VOCABULARY = "byte_bpe_50k.json"
#: Encoded words that a worker keeps; when full it starts anew.
CACHE_WORDS = 800_000
#: A space with no white space on either side: byte-level BPE always starts a new word there.
_BETWEEN = re.compile(r"(?<=\S) (?=\S)")
_SPACE, _DOUBLE = re.compile(r"\s"), re.compile(r"\s\s")


def vocabulary_path(name: str = VOCABULARY) -> str:
    """Where the public vocabulary file is on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _same_merges(path: str):
    """The file's merges in ``tiktoken``, which is four times as fast on words not seen before.

    That gives the same ids if ids were handed out in the order of the merges, as is checked here; else there is none.
    Words that hold a special token's characters never get here through it alone: see ``WordEncoder``.
    """
    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model = spec["model"]
    merges = [m if isinstance(m, str) else " ".join(m) for m in model.get("merges", [])]
    vocab = model.get("vocab", {})
    if spec.get("normalizer") or any(vocab.get(m.replace(" ", "")) != 256 + i for i, m in enumerate(merges)):
        return None
    # Byte-level BPE writes each byte as a printable character: itself, or the next free one from 256 on.
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shown = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(plain)))}
    special = {t["content"] for t in spec.get("added_tokens", [])}
    ranks = {bytes(shown[c] for c in token): i for token, i in vocab.items() if token not in special}
    return tiktoken.Encoding("words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


class WordEncoder:
    """``tokenizers`` over whole texts, one word at a time: words repeat, so most come from a bounded cache.

    Byte-level BPE starts a new word at a space between two other characters, at and after a lone line end, and before
    the punctuation that closes a word, so the ids of the parts are the ids of the text.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.fast = _same_merges(path)
        self.heads: dict[str, bytes] = {}
        self.cache: dict[str, bytes] = {}
        self.marks = {m: self._ids(m) for m in ".,;:!?"}
        self.line_end = self._ids("\n")
        self.line_id = int(np.frombuffer(self.line_end, "<u4")[0])

    def _ids(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _encode_words(self, words: list[str], before: str) -> list[bytes]:
        """Ids of many words at once: each in a line of its own, as the line end's id parts them again."""
        out: list[bytes] = []
        for at in range(0, len(words), 4096):
            part = words[at : at + 4096]
            text = "\n" + before + ("\n" + before).join(part)
            ids = np.array(self.fast.encode_ordinary(text) if self.fast else self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")
            ends = np.flatnonzero(ids == self.line_id).tolist()[1:] + [len(ids)]
            if len(ends) != len(part):
                raise ValueError("the vocabulary joins line ends with words")
            data, start = ids.tobytes(), 1
            for end in ends:
                out.append(data[4 * start : 4 * end])
                start = end + 1
        return out

    def _fill(self, words: set[str], cache: dict[str, bytes], before: str) -> None:
        """Add the ids of words that are not cached yet."""
        marks = self.marks
        new = words.difference(cache)
        # Words with white space of their own, or with what may be a special token, go to ``tokenizers`` as they are.
        odd = [w for w in new if not w or "<|" in w or _SPACE.search(w)]
        for w in odd:
            cache[w] = self._ids(before + w)
        new.difference_update(odd)
        closed = [w for w in new if w[-1] in marks and w[-2:-1].isalpha()]
        new.difference_update(closed)
        plain = list(new.union([w[:-1] for w in closed]).difference(cache))
        cache.update(zip(plain, self._encode_words(plain, before), strict=True))
        for w in closed:
            cache[w] = cache[w[:-1]] + marks[w[-1]]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        for cache in (self.heads, self.cache):
            if len(cache) > CACHE_WORDS:
                cache.clear()
        split: list[list[list[str]]] = []
        for text in texts:
            if _DOUBLE.search(text) or text[:1].isspace() or text[-1:].isspace():
                split.append([_BETWEEN.split(text)])
            else:
                split.append([line.split(" ") for line in text.split("\n")])
        # Only a word that follows a space is encoded with one.
        words: set[str] = set()
        for lines in split:
            words.update(*lines)
        self._fill(words, self.cache, " ")
        self._fill({line[0] for lines in split for line in lines}, self.heads, "")
        get, head = self.cache.__getitem__, self.heads
        return [self.line_end.join([head[line[0]] + b"".join(map(get, line[1:])) for line in lines]) for lines in split]


_ENCODERS: dict[str, WordEncoder] = {}


def _pieces(path: str | None, capacity: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file = path or vocabulary_path()
        if file not in _ENCODERS:
            _ENCODERS[file] = WordEncoder(file)
        encoder = _ENCODERS[file]
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                rows: list[tuple] = []
                for row, ids in enumerate(encoder.encode([t or "" for t in batch.column(1).to_pylist()])):
                    ids += b"\0\0\0\0"
                    n = len(ids) // 4
                    start, end = 0, (n - 1) % capacity + 1
                    piece = 0
                    while start < n:
                        part = ids[4 * start : 4 * end]
                        rows.append((row, piece, start, end - start, zlib.crc32(part), part))
                        piece, start, end = piece + 1, end, end + capacity
                row, piece, start, length, crc, part = zip(*rows, strict=True)
                cols = [batch.column(0).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start, pa.int64())]
                cols += [pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                names = ["id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    cols.append(pa.array([np.frombuffer(p, "<u4").astype(np.int32) for p in part], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.record_batch(cols, names)

    return run


def token_pieces(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    tokenizer_path: str | None = None,
    with_ids: bool = False,
) -> DataFrame:
    """``id_col, piece, start, length, ids_crc32[, ids]``: each text's ids and a closing 0, cut into pieces.

    Only texts of more than ``capacity`` ids are cut; all pieces but the first are full. A null text is empty and gives
    one piece of length 1. Repeated rows are packed each. ``tokenizer_path`` must be readable on the executors.
    """
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = f"id {src.schema['id'].dataType.simpleString()}, piece int, start bigint, length bigint, ids_crc32 bigint"
    schema += ", ids array<int>" if with_ids else ""
    return src.mapInArrow(_pieces(tokenizer_path, capacity, with_ids), schema).withColumnRenamed("id", id_col)


def plan_bins(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[int]]]:
    """Bins as (how many, lengths in them), from how often each length occurs.

    A bin starts with the longest piece left and takes the longest that fits until none does. Then its smallest piece
    gives way to the two unpacked pieces that together fill its place and the gap best, if they fill more than it did.
    The bin is repeated as often as the pieces last.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    lengths = sorted(left)
    bins: list[tuple[int, list[int]]] = []
    while lengths:
        used: dict[int, int] = {}
        held: list[int] = []
        gap = capacity
        at = len(lengths) - 1
        while at >= 0:
            n = lengths[at]
            if n > gap:
                at = bisect_right(lengths, gap, 0, at) - 1
                continue
            take = min(gap // n, left[n])
            held += [n] * take
            used[n] = take
            gap -= take * n
            at -= 1
        if gap and held:
            small = held[-1]
            pair = _best_pair(lengths, left, used, gap + small)
            if pair and sum(pair) > small:
                used[held.pop()] -= 1
                for n in pair:
                    used[n] = used.get(n, 0) + 1
                    held.append(n)
        times = min(left[n] // u for n, u in used.items() if u)
        bins.append((times, sorted(held, reverse=True)))
        for n, u in used.items():
            left[n] -= times * u
        if any(left[n] == 0 for n in used):
            lengths = [n for n in lengths if left[n]]
    return bins


def _best_pair(lengths: list[int], left: dict[int, int], used: dict[int, int], room: int) -> tuple[int, int] | None:
    """The two unpacked lengths with the largest sum of at most ``room``."""
    free = np.array([n for n in lengths if left[n] > used.get(n, 0) and n < room])
    if not len(free):
        return None
    # The partner is the largest length that is no longer than the first and fits beside it.
    partner = np.searchsorted(free, np.minimum(room - free, free), side="right") - 1
    single = np.array([left[int(n)] - used.get(int(n), 0) < 2 for n in free])
    partner = np.where((partner == np.arange(len(free))) & single, partner - 1, partner)
    ok = partner >= 0
    if not ok.any():
        return None
    total = np.where(ok, free + free[partner], -1)
    best = int(total.argmax())
    return int(free[best]), int(free[partner[best]])


def _slots(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Rows (first rank, length, copies in a bin, first sequence, offset), by rank in the order of lengths."""
    first = dict(zip(sorted(counts), np.cumsum([0, *[counts[n] for n in sorted(counts)]])[:-1].tolist(), strict=True))
    rows, sequence = [], 0
    for times, held in plan_bins(counts, capacity):
        offset = 0
        for n in dict.fromkeys(held):
            copies = held.count(n)
            rows.append((first[n], n, copies, sequence, offset))
            first[n] += times * copies
            offset += n * copies
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def best_two_fit(pieces: DataFrame, id_col: str = "doc_id", capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``; ``length`` must be from 1 to ``capacity``.

    Sequences are filled without gaps from offset 0. Pieces of one length are interchangeable; which of them goes where
    follows from ``id_col`` and ``piece``. An empty table gives an empty table.
    """
    names = pieces.columns
    ranked = global_index(pieces, [F.col("length"), F.col(id_col), F.col("piece")], "_rank")
    counts = {r["length"]: r["n"] for r in ranked.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    slots = _slots(counts, capacity)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rank = batch.column("_rank").to_numpy()
            start, length, copies, sequence, offset = slots[np.searchsorted(slots[:, 0], rank, side="right") - 1].T
            turn = rank - start
            cols = [batch.column(n) for n in names] + [pa.array(sequence + turn // copies), pa.array(offset + turn % copies * length)]
            yield pa.record_batch(cols, [*names, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return ranked.mapInArrow(place, f"{schema}, sequence_id bigint, offset bigint")


def pack(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, tokenizer_path: str | None = None
) -> DataFrame:
    """Where each piece of each document goes: one row a piece. Nulls, empty and long texts: see ``token_pieces``."""
    # Written first, as dealing out by ranges reads its input twice.
    pieces = staged(token_pieces(docs, id_col, text_col, capacity, tokenizer_path), "pieces")
    return best_two_fit(pieces, id_col, capacity)


def sequences(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, tokenizer_path: str | None = None
) -> DataFrame:
    """The packed sequences themselves: ``sequence_id, ids, doc_ids``; a group is at most ``capacity`` ids."""
    pieces = staged(token_pieces(docs, id_col, text_col, capacity, tokenizer_path, with_ids=True), "pieces")
    packed = best_two_fit(pieces, id_col, capacity)
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids", F.col(id_col).alias("id"))))
    return packed.groupBy("sequence_id").agg(parts.alias("p")).select(
        "sequence_id", F.flatten("p.ids").alias("ids"), F.col("p.id").alias("doc_ids")
    )
