"""Personal data in texts: patterns, and a character-level BiLSTM-CRF that adds what patterns miss.

Patterns give the base spans, which always stay. They are also labels that the tagger learns from, together with made-up
spans of the same kinds in other formats (spelled-out addresses, other separators) and look-alikes that are none. Every
text is decoded whole, in overlapping windows, whose tags are reconciled over the whole text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
#: The tagger is fitted on windows of at most so many texts, in the order of a hash, and on so many windows of them:
#: half of them with a base span, as far as there are any.
MAX_TEXTS = 1500
MAX_WINDOWS = 3000
#: Characters in a window that is learnt from, and in one that is decoded; decoded windows overlap by ``OVERLAP``.
WINDOW, SPAN, OVERLAP = 80, 768, 32
EMBED, HIDDEN, STEPS, BATCH = 12, 14, 600, 64

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A match always begins where a run of digits does, as the part before took the whole of an earlier run.
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_TRIGGER = re.compile(r"[0-9@]")


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return re.sub(r"[^0-9]", "", text)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the patterns' matches, by kind and then start; ends are exclusive."""
    spans: list[tuple[str, int, int]] = []
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            end = m.end()
            spans.append(("email", start, end))
        at = text.find("@", max(at + 1, end))
    if not _TRIGGER.search(text):
        return spans
    for m in _IP.finditer(text):
        parts = m.group().split(".")
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in parts):
            spans.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        if 13 <= len(m.group()) <= 37 and 13 <= len(d := _digits(m.group())) <= 19 and _luhn(d):
            spans.append(("card", m.start(), m.end()))
    for m in _PHONE.finditer(text):
        if 9 <= len(_digits(m.group())) <= 15:
            spans.append(("phone", m.start(), m.end()))
    return spans


# --- The tagger: tags are 0 for outside, then begin and inside of each kind.
TAGS = 1 + 2 * len(KINDS)
_CHARS = "abcdefghijklmnopqrstuvwxyz0123456789@.+-()_%: \n,;/=\"'"
_CODE = {c: i + 2 for i, c in enumerate(_CHARS)}
_TABLE = np.ones(128, np.int64)
for _c, _i in _CODE.items():
    _TABLE[ord(_c)] = _i
    _TABLE[ord(_c.upper())] = _i
VOCAB = len(_CHARS) + 2


def _codes(text: str) -> np.ndarray:
    """Character classes: 0 pads, 1 is any other character."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return np.where(points < 128, _TABLE[np.minimum(points, 127)], 1)


def new_model(seed: int = 0) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    w = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape)
    model = {"embed": w(VOCAB, EMBED), "out": w(2 * HIDDEN, TAGS), "out_b": np.zeros(TAGS), "trans": np.zeros((TAGS, TAGS))}
    for way in "fb":
        model |= {f"{way}_in": w(EMBED, 4 * HIDDEN), f"{way}_rec": w(HIDDEN, 4 * HIDDEN), f"{way}_b": np.zeros(4 * HIDDEN)}
    return model


def _gate(x: np.ndarray) -> np.ndarray:
    """A logistic-like curve without exponentials, which took half of the time of decoding."""
    return 0.5 + 0.5 * x / (1 + np.abs(x))


def _gate_slope(y: np.ndarray) -> np.ndarray:
    """The gate's derivative, from its value."""
    return 0.5 * (1 - np.abs(2 * y - 1)) ** 2


def _lstm(model: dict, way: str, x: np.ndarray) -> tuple[np.ndarray, list]:
    """Hidden states (time, batch, hidden) of embedded input (time, batch, embed), and what the gradient needs."""
    steps, n, _ = x.shape
    pre = x @ model[f"{way}_in"] + model[f"{way}_b"]
    h = c = np.zeros((n, HIDDEN), x.dtype)
    hs, saved = np.empty((steps, n, HIDDEN), x.dtype), []
    for t in range(steps):
        z = pre[t] + h @ model[f"{way}_rec"]
        i, f, o = (_gate(z[:, k * HIDDEN : (k + 1) * HIDDEN] + (k == 1)) for k in range(3))
        g = np.tanh(z[:, 3 * HIDDEN :])
        before, last = c, h
        c = f * c + i * g
        tc = np.tanh(c)
        h = o * tc
        hs[t] = h
        saved.append((i, f, o, g, before, last, tc))
    return hs, saved


def _lstm_gradient(model: dict, way: str, x: np.ndarray, saved: list, dhs: np.ndarray, grads: dict) -> np.ndarray:
    dz = np.empty((*dhs.shape[:2], 4 * HIDDEN), x.dtype)
    dh = dc = np.zeros(dhs.shape[1:], x.dtype)
    for t in range(len(x) - 1, -1, -1):
        i, f, o, g, before, last, tc = saved[t]
        dh = dh + dhs[t]
        dc = dc + dh * o * (1 - tc * tc)
        dz[t] = np.concatenate([dc * g * _gate_slope(i), dc * before * _gate_slope(f), dh * tc * _gate_slope(o), dc * i * (1 - g * g)], axis=1)
        grads[f"{way}_rec"] += last.T @ dz[t]
        dh = dz[t] @ model[f"{way}_rec"].T
        dc = dc * f
    grads[f"{way}_in"] += np.einsum("tne,tnk->ek", x, dz)
    grads[f"{way}_b"] += dz.sum(axis=(0, 1))
    return dz @ model[f"{way}_in"].T


def _emissions(model: dict, codes: np.ndarray) -> tuple:
    x = model["embed"][codes.T]
    hf, sf = _lstm(model, "f", x)
    hb, sb = _lstm(model, "b", x[::-1])
    h = np.concatenate([hf, hb[::-1]], axis=2)
    return h @ model["out"] + model["out_b"], h, x, sf, sb


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis=axis, keepdims=True)
    return np.squeeze(m, axis) + np.log(np.exp(x - m).sum(axis=axis))


def gradient(model: dict, codes: np.ndarray, tags: np.ndarray) -> tuple[float, dict]:
    """The CRF's mean negative log-likelihood of (batch, time) windows, and its gradient."""
    e, h, x, sf, sb = _emissions(model, codes)
    steps, n, _ = e.shape
    trans, y = model["trans"], tags.T
    alpha, beta = np.empty_like(e), np.zeros_like(e)
    alpha[0] = e[0]
    for t in range(1, steps):
        alpha[t] = e[t] + _logsum(alpha[t - 1][:, :, None] + trans, 1)
    for t in range(steps - 2, -1, -1):
        beta[t] = _logsum(trans + (e[t + 1] + beta[t + 1])[:, None, :], 2)
    log_z = _logsum(alpha[-1], 1)
    rows = np.arange(n)
    gold = sum(e[t][rows, y[t]] for t in range(steps)) + sum(trans[y[t - 1], y[t]] for t in range(1, steps))
    de = np.exp(alpha + beta - log_z[None, :, None])
    dtrans = np.zeros_like(trans)
    for t in range(1, steps):
        pair = alpha[t - 1][:, :, None] + trans + (e[t] + beta[t])[:, None, :] - log_z[:, None, None]
        dtrans += np.exp(pair).sum(axis=0)
        np.add.at(dtrans, (y[t - 1], y[t]), -1)
    for t in range(steps):
        de[t][rows, y[t]] -= 1
    de, dtrans = de / n, dtrans / n
    grads = {k: np.zeros_like(v) for k, v in model.items()} | {"trans": dtrans}
    grads["out"] = np.einsum("tnh,tnk->hk", h, de)
    grads["out_b"] = de.sum(axis=(0, 1))
    dh = de @ model["out"].T
    dx = _lstm_gradient(model, "f", x, sf, dh[:, :, :HIDDEN], grads)
    dx = dx + _lstm_gradient(model, "b", x[::-1], sb, dh[::-1, :, HIDDEN:], grads)[::-1]
    np.add.at(grads["embed"], codes.T, dx)
    return float((log_z - gold).mean()), grads


def fit(codes: np.ndarray, tags: np.ndarray, steps: int = STEPS, seed: int = 0) -> dict[str, np.ndarray]:
    """A model from (windows, WINDOW) character classes and tags, by Adam."""
    model, rng = {k: v.astype(np.float32) for k, v in new_model(seed).items()}, np.random.default_rng(seed)
    m = {k: np.zeros_like(v) for k, v in model.items()}
    v = {k: np.zeros_like(x) for k, x in model.items()}
    for step in range(1, steps + 1):
        at = rng.integers(0, len(codes), min(BATCH, len(codes)))
        _, grads = gradient(model, codes[at], tags[at])
        norm = sum(float((g * g).sum()) for g in grads.values()) ** 0.5
        for k, g in grads.items():
            g = g * min(1.0, 5 / (norm + 1e-9))
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.999 * v[k] + 0.001 * g * g
            rate = 0.015 * min(1.0, 2 * (1 - step / (steps + 1)))
            model[k] = model[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return model


def _hidden_emissions(model: dict, codes: np.ndarray) -> np.ndarray:
    """Emissions (time, tags, batch) without what a gradient needs, in single precision.

    A character's share of the gates is looked up. Each gate has an array of its own, so that all operations run over
    memory in one piece. Gates and states are kept doubled, and tanh(x) = 2 / (1 + exp(-2x)) - 1.
    """
    steps, n, h_ = codes.shape[1], len(codes), HIDDEN
    out = np.empty((steps, TAGS, n), np.float32)
    out[:] = model["out_b"][:, None]
    by_gate = lambda x: np.ascontiguousarray(x.reshape(len(x), 4, h_).transpose(1, 0, 2), np.float32)
    scale = np.r_[np.ones(3 * h_), np.full(h_, -2.0)]
    z, c, h, t = (np.empty(shape, np.float32) for shape in ((4, n, h_), (n, h_), (n, h_), (n, h_)))
    g = z[3]
    share, by_time = np.empty((TAGS, n), np.float32), np.ascontiguousarray(codes.T)
    for way in "fb":
        bias = model[f"{way}_b"] + np.r_[np.zeros(h_), np.ones(h_), np.zeros(2 * h_)]  # as in training
        table = by_gate((model["embed"] @ model[f"{way}_in"] + bias) * scale)
        rec = by_gate(model[f"{way}_rec"] * scale / 2)
        own = np.ascontiguousarray((model["out"][:h_] if way == "f" else model["out"][h_:]).T / 2, np.float32)
        c[:], h[:] = 0, 0
        for k in range(steps) if way == "f" else range(steps - 1, -1, -1):
            for q in range(4):
                x = z[q]
                table[q].take(by_time[k], axis=0, out=x, mode="clip")
                x += np.matmul(h, rec[q], out=t)
                if q < 3:
                    np.abs(x, out=t)
                    t += 1
                    x /= t
                    x += 1
            np.exp(g, out=g)
            g += 1
            np.divide(2, g, out=g)
            g -= 1
            g *= z[0]
            c *= 0.5
            c *= z[1]
            c += g
            np.negative(c, out=t)
            np.exp(t, out=t)
            t += 1
            np.divide(2, t, out=h)
            h -= 1
            h *= z[2]
            out[k] += np.matmul(own, h.T, out=share)
    return out


def _viterbi(e: np.ndarray, trans: np.ndarray, lengths: np.ndarray, inner: np.ndarray, ended: np.ndarray) -> np.ndarray:
    """The most likely tags of runs (time, tags, runs), of which the first ``lengths`` steps count.

    What is ``inner`` comes after an outside character, and what is ``ended`` before one; others are at a window's edge.
    """
    steps, _, n = e.shape
    best, tags = np.empty_like(e), np.empty((steps, n), np.int64)
    best[0] = e[0] + trans[0][:, None] * inner
    for t in range(1, steps):
        new = (best[t - 1][:, None] + trans[:, :, None]).max(axis=0) + e[t]
        best[t] = np.where(lengths > t, new, best[t - 1])
    tags[-1] = (best[-1] + trans[:, :1] * ended).argmax(axis=0)
    for t in range(steps - 1, 0, -1):
        tags[t - 1] = np.where(lengths > t, (best[t - 1] + trans[:, tags[t]]).argmax(axis=0), tags[t])
    return tags.T


def decode(model: dict, codes: np.ndarray) -> np.ndarray:
    """The most likely tags of each window (Viterbi).

    A bound on what any stay in other tags could gain over "outside", with all other tags taken as one, says for most
    characters that no stay over them is worth it, so that the best path is outside there; the runs of characters between
    them are searched.
    """
    with np.errstate(over="ignore"):  # exp to infinity, whose reciprocal is zero
        e = _hidden_emissions(model, codes)
    steps, _, n = e.shape
    trans = model["trans"].astype(np.float32)
    outside = e[:, 0] + trans[0, 0]
    enter = (e[:, 1:] + trans[0, 1:, None]).max(axis=1) - outside
    go_on = (e[:, 1:] + trans[1:, 1:].max(axis=0)[:, None]).max(axis=1) - outside
    enter[0] = e[0, 1:].max(axis=0) - e[0, 0]
    leave = max(0.0, float((trans[1:, 0] - trans[0, 0]).max()))
    upto, after = enter.copy(), np.zeros((steps, n), np.float32)
    for t in range(1, steps):
        np.maximum(enter[t], upto[t - 1] + go_on[t], out=upto[t])
        # What a stay still gains behind a step, at best; its leaving counts in any case.
        np.maximum(0, after[steps - t] + go_on[steps - t], out=after[steps - t - 1])
    upto += after
    open_ = np.zeros((n, steps + 2), np.int8)
    open_[:, 1:-1] = (upto > -leave).T
    tags = np.zeros(codes.shape, np.int64)
    edges = np.diff(open_, axis=1)
    (row, start), (_, stop) = np.nonzero(edges == 1), np.nonzero(edges == -1)
    order = np.argsort(stop - start, kind="stable")
    for k in range(0, len(order), 512):  # of like lengths
        own = order[k : k + 512]
        r, a, b = row[own], start[own], stop[own]
        at = np.minimum(a + np.arange((b - a).max())[:, None], steps - 1)
        found = _viterbi(np.ascontiguousarray(e[at, :, r].transpose(0, 2, 1)), trans, b - a, a > 0, b < steps)
        inside = np.arange(len(at)) < (b - a)[:, None]
        tags[np.broadcast_to(r[:, None], inside.shape)[inside], at.T[inside]] = found[inside]
    return tags


def windows(n: int) -> list[int]:
    """Starts of overlapping windows that together cover ``n`` characters."""
    return [0, *range(SPAN - OVERLAP, n - OVERLAP, SPAN - OVERLAP)] if n else []


def _tags_of(text: str, spans: list[tuple[str, int, int]]) -> np.ndarray:
    tags = np.zeros(len(text), np.int64)
    for kind, a, b in spans:
        k = 1 + 2 * KINDS.index(kind)
        if not tags[a:b].any():
            tags[a], tags[a + 1 : b] = k, k + 1
    return tags


def _pad(x: np.ndarray, n: int = WINDOW) -> np.ndarray:
    return np.pad(x, (0, n - len(x)))


def _card(rng: np.random.Generator) -> str:
    """Sixteen digits that pass Luhn."""
    digits = "".join(map(str, rng.integers(0, 10, 15)))
    return digits + next(str(d) for d in range(10) if _luhn(digits + str(d)))


def _variants(count: int, seed: int, contexts: list[str] | None = None) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Made-up spans in formats that the patterns do not know, and look-alikes that are none, amid ``contexts`` and words."""
    rng = np.random.default_rng(seed)
    pick = lambda xs: xs[int(rng.integers(0, len(xs)))]
    word = lambda: "".join(rng.choice(list("abcdefghijklmnoprstuvwz"), int(rng.integers(2, 9))))
    num = lambda n: "".join(map(str, rng.integers(0, 10, n)))

    def email() -> str:
        user = word() + pick(["", num(2), pick([".", "_"]) + word(), " dot " + word()])
        at = pick([" at ", " [at] ", "[at]", "(at)", " (at) ", " AT ", " @ "])
        dot = pick([" dot ", " DOT ", "[.]", " [dot] ", "(dot)", "."]) if at != "@" else pick([" dot ", "[.]", "[dot]"])
        if dot == "." and at in (" at ", " AT "):
            dot = " dot "
        return user + at + word() + dot + pick(["com", "org", "net", "de", "io", "co"])

    def phone() -> str:
        return pick([f"({num(3)}) {num(3)}-{num(4)}", f"00{num(2)} {num(3)} {num(3)} {num(4)}", f"{num(3)}-{num(3)}-{num(4)}", f"{num(3)}.{num(3)}.{num(4)}"])

    def ip() -> str:
        return pick([" . ", "[.]", " [.] ", "(.)"]).join(str(x) for x in rng.integers(0, 256, 4))

    def card() -> str:
        d = _card(rng)
        return pick([".", "/", "_", "  ", " - "]).join(d[i : i + 4] for i in range(0, 16, 4))

    def alike() -> str:
        return pick(
            [f"{num(3)}-{num(2)}-{num(4)}", f"{num(2)}/{num(2)}/{num(4)}", f"20{num(2)}-0{num(1)}-1{num(1)} {num(2)}:{num(2)}", f"${num(2)},{num(3)}.{num(2)}",
             f"v{num(1)}.{num(1)}.{num(2)}", f"section {num(1)}.{num(1)}", f"no. {num(9)}", f"{num(2)},{num(3)},{num(3)}", f"ref {num(4)}-{num(6)}", f"id {num(12)}",
             "look at the dot on it", f"met at {word()} and", f"dot {word()} at {num(2)}", f"pages {num(3)}-{num(3)}", f"@{word()} {word()}", f"{num(4)} {num(4)}", f"{word()} at {word()} ."]
        )

    make = {"email": email, "phone": phone, "ip": ip, "card": card}
    out = []
    for _ in range(count):
        kind = pick([*KINDS, "email", None, None])
        span = make[kind]() if kind else alike()
        around = pick(contexts) if contexts and rng.random() < 0.6 else " ".join(word() for _ in range(16))
        cut = int(rng.integers(0, max(1, min(len(around), 40))))
        before, after = around[:cut] + pick([" ", " ", ": ", " (", ", "]) if cut else "", pick([" ", " ", ". ", ", ", ") "]) + around[cut:]
        text = before + span + after
        # A context may hold base spans of its own.
        spans = [x for x in base_spans(text) if x[2] <= len(before) or x[1] >= len(before) + len(span)]
        out.append((text, spans + ([(kind, len(before), len(before) + len(span))] if kind else [])))
    return out


def training_windows(pieces: list[str], seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Character classes and tags of the pieces, of at most ``WINDOW`` characters, and of as many variants amid them."""
    made = [(t, base_spans(t)) for t in pieces] + _variants(max(1500, len(pieces)), seed, [t for t in pieces if len(t) > 20])
    codes = np.array([_pad(_codes(t)[:WINDOW]) for t, _ in made])
    return codes, np.array([_pad(_tags_of(t, spans)[:WINDOW]) for t, spans in made])


def train(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_texts: int = MAX_TEXTS, max_windows: int = MAX_WINDOWS, steps: int = STEPS
) -> dict:
    """Fit on at most ``max_windows`` windows of at most ``max_texts`` texts, half of the windows with a base span as far as
    there are any, all picked by a hash of what they hold; only these windows reach the driver. An empty table leaves the
    made-up variants to learn from."""
    text = F.col(text_col).cast("string")
    ids = docs.where(text.rlike("[0-9@]")).select(F.xxhash64(text).alias("_h")).distinct().orderBy(F.xxhash64("_h", F.lit(1)), "_h").limit(max_texts)
    # At most ``max_texts`` keys of eight bytes.
    src = docs.select(text.alias("text"), F.xxhash64(text).alias("_h")).join(F.broadcast(ids), "_h", "left_semi").select("text")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0).to_pylist():
                spans, at, out, held = base_spans(text), 0, [], []
                ends = sorted((a, b) for _, a, b in spans)
                while at < len(text):
                    stop = min(len(text), at + WINDOW)
                    for a, b in ends:  # a window that would cut a span begins or ends beside it
                        if a < stop < b:
                            stop = a if a > at else min(b, at + WINDOW)
                    out.append(text[at:stop])
                    held.append(any(a >= at and b <= stop for a, b in ends))
                    at = stop
                yield pa.record_batch([pa.array(out, pa.string()), pa.array(held, pa.bool_())], ["piece", "held"])

    found = src.mapInArrow(pieces, "piece string, held boolean").distinct()
    some = lambda held: found.where(F.col("held") == held).orderBy(F.xxhash64("piece"), "piece").limit(max_windows // 2).collect()
    return fit(*training_windows([r["piece"] for held in (True, False) for r in some(held)]), steps=steps)


_AT, _DOT = re.compile(r"@|\bat\b|[\[(]at[\])]", re.IGNORECASE), re.compile(r"\.|\bdot\b|[\[(]dot[\])]", re.IGNORECASE)
_LETTER = re.compile(r"[^\W\d_]")
_SHAPE = {
    "email": lambda s: bool((m := _AT.search(s)) and m.start() and _DOT.search(s, m.end()) and s[-1].isalpha()),
    "ip": lambda s: len(x := re.findall(r"[0-9]+", s)) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in x) and not _LETTER.search(s),
    "card": lambda s: 13 <= len(_digits(s)) <= 19 and _luhn(_digits(s)) and not _LETTER.search(s),
    "phone": lambda s: 9 <= len(_digits(s)) <= 15 and not _LETTER.search(s) and not re.fullmatch(r"[0-9]{3}-[0-9]{2}-[0-9]{4}", s),
}


def added_spans(model: dict, texts: list[str], base: list[list[tuple[str, int, int]]]) -> list[list[tuple[str, int, int]]]:
    """What the tagger finds beside the base spans.

    Of overlapping windows each character takes its tag from the one whose edges are farther; tags are then read as spans
    over the whole text. Spans that touch a base span or lack the shape of their kind are left out.
    """
    codes = [_codes(t) for t in texts]
    # Shortest first, so that few windows are padded, and those little.
    jobs = sorted(((i, a) for i, c in enumerate(codes) for a in windows(len(c))), key=lambda x: min(SPAN, len(codes[x[0]]) - x[1]))
    tags: dict[int, np.ndarray] = {}
    half = OVERLAP // 2
    for k in range(0, len(jobs), 1024):
        part = jobs[k : k + 1024]
        coded = np.zeros((len(part), min(SPAN, len(codes[part[-1][0]]) - part[-1][1])), np.int64)
        for row, (i, a) in enumerate(part):
            own = codes[i][a : a + SPAN]
            coded[row, : len(own)] = own
        found = decode(model, coded)
        for row in np.flatnonzero(found.any(axis=1)).tolist():
            i, a = part[row]
            own = tags.setdefault(i, np.zeros(len(codes[i]), np.int64))
            lo, hi = a + half if a else 0, min(len(own), a + SPAN - half if a + SPAN < len(own) else a + SPAN)
            own[lo:hi] = found[row, lo - a : hi - a]
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    for i, y in tags.items():
        taken = np.zeros(len(y) + 1, bool)
        for _, a, b in base[i]:
            taken[max(0, a - 1) : b + 1] = True
        at = np.flatnonzero((y > 0) & (y % 2 == 1)).tolist()
        for a in at:
            kind, b = KINDS[(int(y[a]) - 1) // 2], a + 1
            while b < len(y) and y[b] == y[a] + 1:
                b += 1
            if not taken[a:b].any() and _SHAPE[kind](texts[i][a:b]):
                out[i].append((kind, a, b))
    return out


def find(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, text_key, spans array<struct<kind,start,end,base>>`` of every whole text; offsets are code points.

    A null text is empty and has no spans. Repeated rows are rows of their own and ids may be null; ``text_key`` (a hash)
    tells rows of one id apart. Texts of any length are decoded whole, window by window. An empty table gives an empty
    table; other columns are ignored.
    """
    span = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                texts = [t or "" for t in batch.column(2).to_pylist()]
                base = [base_spans(t) for t in texts]
                more = added_spans(model, texts, base)
                rows = [
                    [{"kind": k, "start": a, "end": b, "base": own} for spans, own in ((x, True), (y, False)) for k, a, b in spans]
                    for x, y in zip(base, more, strict=True)
                ]
                yield pa.record_batch([batch.column(0), batch.column(1), pa.array(rows, pa.list_(span))], ["id", "text_key", "spans"])

    text = F.col(text_col).cast("string")
    src = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("text_key"), text.alias("text"))
    kind = src.schema["id"].dataType.simpleString()
    out = src.mapInArrow(run, f"id {kind}, text_key bigint, spans array<struct<kind:string,start:int,end:int,base:boolean>>")
    return out.withColumnRenamed("id", id_col)


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts of base spans by kind, a hash of the base spans, and all spans as text."""
    rank = lambda s: F.when(s["kind"] == "email", 0).when(s["kind"] == "ip", 1).when(s["kind"] == "card", 2).otherwise(3)

    def joined(spans):
        keyed = F.array_sort(F.transform(spans, lambda s: F.struct(rank(s).alias("r"), s["start"].alias("a"), s["end"].alias("b"), s["kind"].alias("k"))))
        return F.array_join(F.transform(keyed, lambda s: F.concat_ws(":", s["k"], s["a"].cast("string"), s["b"].cast("string"))), ",")

    base = F.filter("spans", lambda s: s["base"])
    count = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("bigint")
    counts = [count(k).alias(f"n_{k}") for k in KINDS]
    return found.select(id_col, *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with each span replaced by its kind in brackets; all columns stay, whatever their names.

    Rows meet their spans by id and text, so ids may repeat or be null. A null text stays null.
    """
    spans = found.groupBy(F.col(id_col).alias("_id"), F.col("text_key").alias("_key")).agg(F.first("spans").alias("_spans"))

    @F.pandas_udf("string")
    def cover(texts, spans):
        import pandas as pd

        out = []
        for text, own in zip(texts, spans, strict=True):
            own = sorted(own if own is not None else [], key=lambda s: (s["start"], -s["end"]))
            parts, at = [], 0
            for s in own:
                if s["start"] >= at:
                    parts += [text[at : s["start"]], f"[{s['kind']}]"]
                    at = s["end"]
            out.append(None if text is None else "".join(parts) + text[at:])
        return pd.Series(out, dtype="object")

    packed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_doc"), F.xxhash64(docs[text_col].cast("string")).alias("_h"))
    same = F.col(f"_doc.{id_col}").eqNullSafe(F.col("_id")) & (F.col("_h") == F.col("_key"))
    text = cover(F.col(f"_doc.{text_col}").cast("string"), "_spans")
    return packed.join(spans, same, "left").select(*[text.alias(c) if c == text_col else F.col("_doc")[c].alias(c) for c in docs.columns])
