"""Token counts by finite-state transducers that are compiled from a tokenizer's file; no text is tokenized.

Two deterministic transducers in cascade. The *word transducer* reads classes of characters and emits where words begin.
Its texts are cut in chunks: a chunk's state map says, for each state it may begin in, the state it ends in; maps compose
by a parallel prefix scan, after which each chunk knows its own first state. The *token transducer* reads the bytes of a
word and emits on each transition by how much the number of tokens of what was read changes (a merge makes it fall). Its
states are compiled from the table of merges when they are first entered; beyond a number of states only those in use are kept.

Why a finite state is enough: a sequence of tokens is what the merges make of its bytes if and only if each two neighbours
are, so the last token of a prefix depends on the last tokens of those shorter prefixes that some token may still reach back to.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The rules of the tokenizer files that are understood here.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMALIZERS = ["NFC", "Replace", "Lowercase"]
# Classes of characters: gap; s, t, m, d; r; v; l; e; other letters; numbers; apostrophe; the rest; not known to this Python.
GAP, ENDS, R, V, L, E, LETTER, NUMBER, APOSTROPHE, OTHER, ASK = range(11)
# States of the word transducer: the next character that is no gap begins a word; within letters; within other characters;
# after an apostrophe that begins a word; after such an apostrophe with r, v or l.
FREE, LETTERS, OTHERS, QUOTE, QUOTE_R, QUOTE_V, QUOTE_L = range(7)
STATES = 7
#: Emissions: a word begins here; a word began one character before.
HERE, BEFORE = 1, 2
#: Characters of a chunk, and of what is worked on at a time unless there is no gap to cut at.
CHUNK, BLOCK = 256, 1 << 20
#: Compiled states of the token transducer that are kept at most.
MAX_STATES = 1 << 18
UNKNOWN = -128


def word_transducer() -> tuple[np.ndarray, np.ndarray]:
    """``next, emits`` by state and class, of ``PATTERN``."""
    step, emit = np.zeros((STATES, ASK), np.uint8), np.zeros((STATES, ASK), np.uint8)
    letters = (ENDS, R, V, L, E, LETTER)
    for state in range(STATES):
        for c in range(1, ASK):
            step[state, c] = LETTERS if c in letters else QUOTE if c == APOSTROPHE else OTHERS if c == OTHER else FREE
            emit[state, c] = HERE
    for c in letters:
        emit[LETTERS, c] = 0
    for state in (OTHERS, QUOTE):
        for c in (APOSTROPHE, OTHER):
            step[state, c], emit[state, c] = OTHERS, 0
    for c, to in ((ENDS, FREE), (R, QUOTE_R), (V, QUOTE_V), (L, QUOTE_L)):
        step[QUOTE, c], emit[QUOTE, c] = to, 0
    for state, last in ((QUOTE_R, E), (QUOTE_V, E), (QUOTE_L, L)):
        # If the ending is not completed, the letter before began a word of letters.
        step[state], emit[state] = step[LETTERS], emit[LETTERS] | BEFORE
        step[state, last], emit[state, last] = FREE, 0
    return step, emit


STEP, EMIT = word_transducer()


def scan(maps: np.ndarray) -> np.ndarray:
    """The composition of all maps up to each, in logarithmically many rounds; ``maps[k, s]`` is the state after chunk ``k``
    begun in ``s``."""
    out, reach = maps.copy(), 1
    while reach < len(out):
        out[reach:] = np.take_along_axis(out[reach:], out[:-reach].astype(np.intp), axis=1)
        reach *= 2
    return out


def word_starts(classes: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
    """Whether a word begins at each character."""
    n = len(classes)
    lanes = np.zeros((-(-(n + 1) // chunk), chunk), np.uint8)  # one gap at least follows the last character
    lanes.reshape(-1)[:n] = classes
    lanes = np.ascontiguousarray(lanes.T)
    flat_step, flat_emit = STEP.reshape(-1), EMIT.reshape(-1)
    maps = np.repeat(np.arange(STATES, dtype=np.uint8)[None, :], lanes.shape[1], axis=0)
    for row in lanes:
        maps = flat_step[maps * np.uint8(ASK) + row[:, None]]
    state = np.concatenate([[np.uint8(FREE)], scan(maps)[:-1, FREE]])
    emitted = np.empty_like(lanes)
    for k, row in enumerate(lanes):
        at = state * np.uint8(ASK) + row
        emitted[k], state = flat_emit[at], flat_step[at]
    emitted = np.ascontiguousarray(emitted.T).reshape(-1)
    starts = emitted & HERE > 0
    starts[:-1] |= emitted[1:] & BEFORE > 0
    return starts[:n]


class TokenTransducer:
    """Counts the tokens that merges make of words, byte by byte. Symbols are bytes, plus 256 for the last byte of a word."""

    def __init__(self, merges: list[tuple[str, str]], vocab: list[str], byte_of: dict[str, int], suffix: str, max_states: int = MAX_STATES):
        self.max_states, inf = max_states, 1 << 30
        made = {a + b for a, b in merges}
        ids: dict[str, int] = {}
        spelled: list[tuple[int, ...]] = []
        # For each token, what stands at its right and left edge in the course of its merges, and when each is merged.
        right: list[list[tuple[int, int]]] = []
        left: list[list[tuple[int, int]]] = []

        def add(name: str, symbols: tuple[int, ...], r: list, s: list) -> int:
            ids[name] = t = len(spelled)
            spelled.append(symbols)
            right.append([*r, (t, inf)])
            left.append([*s, (t, inf)])
            return t

        for name in vocab:
            if name not in made:
                bare = name.removesuffix(suffix) if len(name) > 1 else name
                add(name, (byte_of[bare] + (256 if bare != name else 0),), [], [])
        self.rank: dict[tuple[int, int], int] = {}
        self.right, self.left = right, left
        stands = [True] * len(spelled)  # whether a token's own bytes become that token
        for rank, (a, b) in enumerate(merges):
            x, y = ids[a], ids[b]
            self.rank[x, y] = rank
            add(a + b, spelled[x] + spelled[y], [*right[y][:-1], (y, rank)], [*left[x][:-1], (x, rank)])
            stands.append(stands[x] and stands[y] and not self._crossed(x, y, rank))
        self.child: dict[int, int] = {}
        self.token, inner = [-1], [False]
        for t, symbols in enumerate(spelled):
            if stands[t]:
                node = 0
                for s in symbols:
                    inner[node] = True
                    node = self.child.setdefault(node << 9 | s, len(self.token))
                    if node == len(self.token):
                        self.token.append(-1)
                        inner.append(False)
                self.token[node] = t
        self.inner, self.pairs = inner, {}
        self._clear()

    def _crossed(self, a: int, b: int, before: int) -> bool:
        """Whether a merge joins the end of token ``a`` with the beginning of ``b`` before the given rank, while both are made.

        Of equal merges that overlap, the left one comes first.
        """
        i = j = 0
        right, left = self.right[a], self.left[b]
        while True:
            (x, x_ends), (y, y_ends) = right[i], left[j]
            rank = self.rank.get((x, y), before)
            if rank < before and rank < x_ends and rank <= y_ends:
                return True
            if x_ends <= y_ends:
                if i + 1 == len(right):
                    return False
                i += 1
            else:
                j += 1

    def _clear(self) -> None:
        self.states: list[tuple] = []
        self.number: dict[tuple, int] = {}
        # A column for each byte that occurs: where to, what a byte emits, and what a last byte emits.
        self.column, self.columns = np.full(256, -1), 0
        self.next = np.full((1024, 32), -1, np.int32)
        self.emit, self.last = np.full((1024, 32), UNKNOWN, np.int8), np.full((1024, 32), UNKNOWN, np.int8)
        self._state((-1, ()))

    def _state(self, state: tuple) -> int:
        if (k := self.number.get(state)) is None:
            k = self.number[state] = len(self.states)
            self.states.append(state)
            if k == len(self.next):
                self._grow(0)
        return k

    def _grow(self, axis: int) -> None:
        self.next = np.concatenate([self.next, np.full_like(self.next, -1)], axis)
        self.emit = np.concatenate([self.emit, np.full_like(self.emit, UNKNOWN)], axis)
        self.last = np.concatenate([self.last, np.full_like(self.last, UNKNOWN)], axis)

    def _columns(self, data: np.ndarray) -> np.ndarray:
        for b in np.flatnonzero(np.bincount(data, minlength=256)).tolist():
            if self.column[b] < 0:
                if self.columns == self.next.shape[1]:
                    self._grow(1)
                self.column[b], self.columns = self.columns, self.columns + 1
        return self.column[data]

    def _compile(self, k: int, symbol: int) -> None:
        """The transition of state ``k`` on ``symbol``.

        A state is the last token, and for each earlier place from which a token may still reach beyond the end: the path in
        the trie from there, the last token before it, and how many tokens fewer there are up to it.
        """
        last, open_ = self.states[k]
        found, change, paths = -1, 0, []
        for path, token, fewer in (*open_, (0, last, 0)):  # the longest first
            node = self.child.get(path << 9 | symbol)
            if node is None:
                continue
            t = self.token[node]
            if found < 0 <= t:
                ok = token < 0
                if not ok and (ok := self.pairs.get((token, t))) is None:
                    if len(self.pairs) > 1 << 18:
                        self.pairs.clear()
                    ok = self.pairs[token, t] = not self._crossed(token, t, 1 << 30)
                if ok:
                    found, change = t, fewer + 1
            if self.inner[node]:
                paths.append((node, token, fewer))
        column = self.column[symbol & 255]
        if symbol < 256:
            to = self._state((found, tuple((node, token, fewer - change) for node, token, fewer in paths)))
            self.next[k, column], self.emit[k, column] = to, change
        else:
            self.last[k, column] = change

    def counts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Tokens of each word, ``data[offsets[i]:offsets[i + 1]]``; all words advance together, a byte at a time."""
        lengths = np.diff(offsets)
        order = np.argsort(-lengths, kind="stable")
        at, left = offsets[:-1][order], lengths[order]
        out, state = np.zeros(len(order), np.int64), np.zeros(len(order), np.int32)
        columns = self._columns(data)
        for k in range(int(left[0]) if len(left) else 0):
            n = int(np.searchsorted(-left, -k, side="left"))  # words that have a byte k
            m = int(np.searchsorted(-left, -k - 1, side="left"))  # and of these, those for which it isn't the last
            if len(self.states) > self.max_states:
                used, inverse = np.unique(state[:n], return_inverse=True)
                kept = [self.states[s] for s in used.tolist()]
                self._clear()
                columns = self._columns(data)
                state[:n] = np.array([self._state(s) for s in kept], np.int32)[inverse]
            where = at[:n] + k
            column = columns[where]
            for lo, hi, final in ((0, m, 0), (m, n, 256)):
                own, own_column = state[lo:hi], column[lo:hi]
                change = (self.last if final else self.emit)[own, own_column]
                if (new := change == UNKNOWN).any():
                    for key in np.unique(own[new].astype(np.int64) << 9 | data[where[lo:hi][new]] | final).tolist():
                        self._compile(key >> 9, key & 511)
                    change = (self.last if final else self.emit)[own, own_column]
                out[lo:hi] += change
            state[:m] = self.next[state[:m], column[:m]]
        counts = np.empty_like(out)
        counts[order] = out
        return counts


class TokenCounter:
    """Both transducers of a tokenizer file."""

    def __init__(self, path: str, max_states: int = MAX_STATES):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, cut = spec["model"], (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
        known = (
            [x["type"] for x in (spec["normalizer"] or {}).get("normalizers", [])] == NORMALIZERS
            and len(cut) == 2
            and (cut[0]["type"], cut[0]["pattern"], cut[1]["type"]) == ("Split", {"Regex": PATTERN}, "ByteLevel")
            and model["type"] == "BPE"
            and model["end_of_word_suffix"]
            and not (model["dropout"] or model["continuing_subword_prefix"] or model["ignore_merges"])
            and not any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"])
        )
        if not known:
            raise ValueError(f"rules of {path} that are not compiled here")
        self.path = path
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        # The byte level alphabet: printable bytes are themselves, the others follow from 256 on.
        plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
        self.special = re.compile("|".join(re.escape(t["content"]) for t in sorted(spec["added_tokens"], key=lambda t: -len(t["content"]))) or "(?!)")
        added = {t["content"] for t in spec["added_tokens"]}
        self.tokens = TokenTransducer(merges, [v for v in model["vocab"] if v not in added], byte_of, model["end_of_word_suffix"], max_states)
        self.classes = np.full(0x110000, OTHER, np.uint8)
        for c in range(0x110000):
            kind = unicodedata.category(chr(c))
            if kind[0] in "LN":
                self.classes[c] = LETTER if kind[0] == "L" else NUMBER
            elif kind == "Cn":
                self.classes[c] = ASK
            elif chr(c).isspace() and not 0x1C <= c <= 0x1F:
                self.classes[c] = GAP
        for chars, c in (("stmd", ENDS), ("r", R), ("v", V), ("l", L), ("e", E), ("'", APOSTROPHE)):
            self.classes[[ord(x) for x in chars]] = c

    @property
    @lru_cache  # noqa: B019
    def library(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def _ask(self, codes: list[int]) -> None:
        """Classes of characters newer than this Python: those that the library itself gives them."""
        words = lambda s: len(self.library.pre_tokenizer.pre_tokenize_str(s))
        for c in codes:
            x = chr(c)
            self.classes[c] = GAP if not words(x) else LETTER if words(f"a{x}a") == 1 else OTHER if words(f"!{x}!") == 1 else NUMBER

    def _normal(self, text: str) -> str:
        if not text.isascii():
            if (self.classes[np.frombuffer(text.encode("utf-32-le"), np.uint32)] == ASK).any():
                return self.library.normalizer.normalize_str(text)
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # no final sigma
        return text.lower()

    def counts(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text."""
        totals, parts, owner = np.zeros(len(texts), np.int64), [], []
        for i, text in enumerate(texts):
            text, found = self.special.subn("\n", text)  # a gap, which nothing reaches across
            totals[i] = found
            parts += [self._normal(text), "\n"]
            owner.append(len(parts[-2]) + 1)
        ends = np.cumsum(owner)
        joined = "".join(parts)
        codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        classes = self.classes[codes]
        if (classes == ASK).any():
            self._ask(np.unique(codes[classes == ASK]).tolist())
            classes = self.classes[codes]
        at = np.flatnonzero(word_starts(classes))
        if not len(at):
            return totals
        data = np.frombuffer(joined.encode("utf-8"), np.uint8)
        width = 1 + (codes >= 0x80).astype(np.int64) + (codes >= 0x800) + (codes >= 0x10000)
        solid = classes != GAP
        if not solid.all():
            data = data[solid if len(data) == len(codes) else np.repeat(solid, width)]
        before = np.cumsum(np.where(solid, width, 0))
        offsets = np.concatenate([before[at] - width[at], before[-1:]]).astype(np.int64)
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
        each = words.dictionary
        base = np.frombuffer(each.buffers()[1], np.int64)[each.offset : each.offset + len(each) + 1]
        per_word = self.tokens.counts(np.frombuffer(each.buffers()[2], np.uint8), base)[np.asarray(words.indices)]
        totals += np.bincount(np.searchsorted(ends, at, side="right"), per_word, len(texts)).astype(np.int64)
        return totals


@lru_cache(2)
def compiled(path: str) -> TokenCounter:
    """Once a Python worker and file."""
    return TokenCounter(path)


def pieces(text: str, block: int = BLOCK) -> Iterator[str]:
    """Parts of about ``block`` characters, cut before line ends and blanks; without any, the rest is one part."""
    at = 0
    while len(text) - at > block and (m := re.compile(r"[\n ]").search(text, at + block)):
        yield text[at : m.start()]
        at = m.start()
    yield text[at:]


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """``id_col, n_bytes, n_tokens``: UTF-8 bytes and tokens of each whole text, as the library of the file ``path`` gives them
    without begin and end.

    The strings of special tokens within a text count one each. A null text is empty and has no tokens. Rows are worked on
    where they are, without a shuffle: repeated rows and null ids are rows of their own, an empty table gives an empty table
    and other columns are ignored. About ``block`` characters are worked on at a time; longer texts are cut at blanks, so only
    a text without any is held at once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = compiled(path)
        for batch in batches:
            totals = np.zeros(batch.num_rows, np.int64)
            rows, parts, size = [], [], 0

            def flush() -> None:
                np.add.at(totals, rows, counter.counts(parts))  # noqa: B023
                rows.clear()  # noqa: B023
                parts.clear()  # noqa: B023

            for i, value in enumerate(batch.column(2)):
                for part in pieces(value.as_py() or "", block):
                    rows.append(i)
                    parts.append(part)
                    size += len(part)
                    if size >= block:
                        flush()
                        size = 0
            flush()
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(totals)], ["id", "n_bytes", "n_tokens"])

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    src = docs.select(F.col(id_col).alias("id"), F.octet_length(text).cast("bigint").alias("n_bytes"), text.alias("text"))
    kind = src.schema["id"].dataType.simpleString()
    return src.mapInArrow(run, f"id {kind}, n_bytes bigint, n_tokens bigint").withColumnRenamed("id", id_col)
