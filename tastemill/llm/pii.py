"""Operator 6: personal data, by patterns and a character-level bidirectional LSTM with a CRF.

The patterns give the base spans. The model is trained in numpy from labelled spans: the base spans
in a bounded sample of documents, and the same kinds written in other ways, put into texts of that
sample. Whole texts are cut into overlapping windows; each window is decoded by Viterbi, and of two
windows that overlap the one where a character lies deeper decides it, so that the labels of a text
are one sequence. Found spans that do not touch a base span are added.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tastemill.llm.common import map_texts, received, share
from tastemill.session import stage

KINDS = ("email", "ip", "card", "phone")
#: Window size and the step between windows, in characters.
WINDOW, STRIDE = 96, 64
HIDDEN, EMBED = 16, 12
#: Documents and windows of the training sample, passes over it and its batches.
SAMPLE_DOCS, SAMPLE_WINDOWS, EPOCHS, BATCH = 400, 3000, 6, 32
#: Windows that are decoded together; bounds a task's memory.
TOGETHER = 2048

# -- base spans ------------------------------------------------------------------------------------

_AT = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A match cannot start inside a run of digits, so the search skips there: long runs stay linear.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def emails(text: str):
    """Leftmost matches of the pattern, found from each @ outwards in linear time."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        found = _AT.match(text, at + 1) if start < at else None
        if found:
            end = found.end()
            yield start, end
        else:
            end = max(end, at)  # no match has this sign; nothing before it can matter again
        at = text.find("@", at + 1)


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all base spans in order; kinds by their place in KINDS."""
    out = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum("0" <= c <= "9" for c in m.group()) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


# -- characters and labels ---------------------------------------------------------------------------

#: Character classes: ASCII as it is, then other letters, other digits, other white space, the rest.
CLASSES = 132
OUTSIDE = 0
LABELS = 1 + 2 * len(KINDS)  # outside; then begin and inside of each kind


def codes(text: str) -> np.ndarray:
    """Class of each character."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    out = np.minimum(points, 128).astype(np.int16)
    for c in np.unique(points[points > 127]):
        char = chr(c)
        out[points == c] = 128 if char.isalpha() else 129 if char.isdigit() else 130 if char.isspace() else 131
    return out


def labels(size: int, spans: list[tuple[int, int, int]]) -> np.ndarray:
    out = np.zeros(size, np.int8)
    for start, kind, end in spans:
        if not out[start:end].any():
            out[start], out[start + 1 : end] = 1 + 2 * kind, 2 + 2 * kind
    return out


def allowed() -> np.ndarray:
    """Penalty of each transition: inside a kind only after its begin or inside."""
    out = np.zeros((LABELS, LABELS), np.float32)
    for kind in range(len(KINDS)):
        out[:, 2 + 2 * kind] = -1e4
        out[[1 + 2 * kind, 2 + 2 * kind], 2 + 2 * kind] = 0
    return out


# -- the model -----------------------------------------------------------------------------------------


def _sigmoid(x):
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Tagger:
    """Embedding, an LSTM each way, a linear layer and a CRF; float32 numpy throughout."""

    def __init__(self, seed: int = 7):
        draw = np.random.default_rng(seed)
        scale = lambda *s: (draw.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.p = {"embed": scale(CLASSES, EMBED) * 3, "out": scale(2 * HIDDEN, LABELS), "bias": np.zeros(LABELS, np.float32)}
        self.p |= {"move": np.zeros((LABELS, LABELS), np.float32), "first": np.zeros(LABELS, np.float32)}
        for way in ("f", "b"):
            self.p |= {f"x{way}": scale(EMBED, 4 * HIDDEN), f"h{way}": scale(HIDDEN, 4 * HIDDEN), f"c{way}": np.zeros(4 * HIDDEN, np.float32)}
            self.p[f"c{way}"][HIDDEN : 2 * HIDDEN] = 1.0  # remember at first

    def _run(self, x: np.ndarray, mask: np.ndarray, way: str, keep: list | None = None) -> np.ndarray:
        """Hidden states (time, row, HIDDEN); x holds classes (row, time)."""
        rows, size = x.shape
        by_class = self.p["embed"] @ self.p[f"x{way}"] + self.p[f"c{way}"]
        h = c = np.zeros((rows, HIDDEN), np.float32)
        out = np.zeros((size, rows, HIDDEN), np.float32)
        for t in range(size) if way == "f" else range(size - 1, -1, -1):
            z = by_class[x[:, t]] + h @ self.p[f"h{way}"]
            s = _sigmoid(z[:, : 3 * HIDDEN])
            i, f, o, g = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :], np.tanh(z[:, 3 * HIDDEN :])
            m = mask[:, t, None]
            new = (f * c + i * g) * m
            squashed = np.tanh(new)
            if keep is not None:
                keep.append((t, i, f, o, g, c, h, squashed, m))
            h, c = o * squashed * m, new
            out[t] = h
        return out

    def _back(self, x: np.ndarray, way: str, kept: list, d_out: np.ndarray, grads: dict) -> None:
        rows = x.shape[0]
        dh = dc = np.zeros((rows, HIDDEN), np.float32)
        by_class = np.zeros((CLASSES, 4 * HIDDEN), np.float32)
        for t, i, f, o, g, c, h, squashed, m in reversed(kept):
            dh = (dh + d_out[t]) * m
            dc = (dc + dh * o * (1 - squashed * squashed)) * m
            dz = np.concatenate([dc * g * i * (1 - i), dc * c * f * (1 - f), dh * squashed * o * (1 - o), dc * i * (1 - g * g)], axis=1)
            np.add.at(by_class, x[:, t], dz)
            grads[f"h{way}"] += h.T @ dz
            dh, dc = dz @ self.p[f"h{way}"].T, dc * f
        grads[f"c{way}"] += by_class.sum(axis=0)
        grads[f"x{way}"] += self.p["embed"].T @ by_class
        grads["embed"] += by_class @ self.p[f"x{way}"].T

    def _scores(self, hidden_f, hidden_b):
        return hidden_f @ self.p["out"][:HIDDEN] + hidden_b @ self.p["out"][HIDDEN:] + self.p["bias"]

    def step(self, x: np.ndarray, y: np.ndarray, mask: np.ndarray) -> tuple[float, dict]:
        """Negative log likelihood for each character, and its gradients."""
        rows, size = x.shape
        grads = {k: np.zeros_like(v) for k, v in self.p.items()}
        kept: dict[str, list] = {"f": [], "b": []}
        hidden = {way: self._run(x, mask, way, kept[way]) for way in "fb"}
        e = self._scores(hidden["f"], hidden["b"]).astype(np.float64)
        move = self.p["move"].astype(np.float64) + allowed()
        many = mask.T[:, :, None]  # (time, row, 1)
        alpha, beta = np.zeros_like(e), np.zeros_like(e)
        alpha[0] = self.p["first"] + e[0]

        def total(v, axis):
            top = v.max(axis=axis, keepdims=True)
            return (np.log(np.exp(v - top).sum(axis=axis, keepdims=True)) + top).squeeze(axis)

        for t in range(1, size):
            new = total(alpha[t - 1][:, :, None] + move, 1) + e[t]
            alpha[t] = np.where(many[t], new, alpha[t - 1])
        for t in range(size - 2, -1, -1):
            new = total(move + (e[t + 1] + beta[t + 1])[:, None, :], 2)
            beta[t] = np.where(many[t + 1], new, beta[t + 1])
        z = total(alpha[-1], 1)
        p = np.exp(alpha + beta - z[None, :, None]) * many
        each, at = np.arange(rows), y.astype(np.int64)
        loss = float(z.sum()) - float((self.p["first"][at[:, 0]] + e[0, each, at[:, 0]]).sum())
        d = p.copy()
        for t in range(size):
            d[t, each, at[:, t]] -= many[t, :, 0]
            if t:
                on = many[t, :, 0]
                loss -= float((on * (e[t, each, at[:, t]] + move[at[:, t - 1], at[:, t]])).sum())
                pair = np.exp(alpha[t - 1][:, :, None] + move + (e[t] + beta[t])[:, None, :] - z[:, None, None]) * on[:, None, None]
                grads["move"] += pair.sum(axis=0).astype(np.float32)
                np.add.at(grads["move"], (at[:, t - 1], at[:, t]), -on.astype(np.float32))
        grads["first"] += d[0].sum(axis=0).astype(np.float32)
        d = d.astype(np.float32)
        for way, part in (("f", slice(0, HIDDEN)), ("b", slice(HIDDEN, 2 * HIDDEN))):
            grads["out"][part] += np.einsum("trh,trl->hl", hidden[way], d)
            self._back(x, way, kept[way], d @ self.p["out"][part].T, grads)
        grads["bias"] += d.sum(axis=(0, 1))
        n = mask.sum()
        return loss / n, {k: v / n * 16 for k, v in grads.items()}

    def fit(self, x: np.ndarray, y: np.ndarray, mask: np.ndarray, epochs: int = EPOCHS, batch: int = BATCH, rate: float = 0.02, seed: int = 7) -> list[float]:
        """Adam over shuffled batches; returns the mean loss of each pass."""
        draw = np.random.default_rng(seed)
        first, second, n, losses = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2)), None, 0, []
        first, second = first
        for epoch in range(epochs):
            order, total = draw.permutation(len(x)), 0.0
            own = rate * (1 - epoch / epochs) + rate / 20
            for a in range(0, len(x), batch):
                rows = order[a : a + batch]
                loss, grads = self.step(x[rows], y[rows], mask[rows])
                total += loss * len(rows)
                n += 1
                for k, g in grads.items():
                    g = np.clip(g, -1, 1)
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.99 * second[k] + 0.01 * g * g
                    self.p[k] = (self.p[k] - own * first[k] / (1 - 0.9**n) / (np.sqrt(second[k] / (1 - 0.99**n)) + 1e-6)).astype(np.float32)
            losses.append(total / max(1, len(x)))
        return losses

    def decode(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """Best label sequence of each row (Viterbi); outside where the mask ends."""
        rows, size = x.shape
        e = self._scores(self._run(x, mask, "f"), self._run(x, mask, "b"))
        move = self.p["move"] + allowed()
        best, back = self.p["first"] + e[0], np.zeros((size, rows, LABELS), np.int8)
        best[:, [2 + 2 * k for k in range(len(KINDS))]] += np.float32(0)  # a window may begin inside a span
        for t in range(1, size):
            options = best[:, :, None] + move
            back[t] = options.argmax(axis=1)
            new = options.max(axis=1) + e[t]
            best = np.where(mask[:, t, None], new, best)
            back[t][~mask[:, t]] = np.arange(LABELS)
        out = np.zeros((rows, size), np.int8)
        at = best.argmax(axis=1)
        for t in range(size - 1, -1, -1):
            out[:, t] = at
            at = back[t][np.arange(rows), at]
        return np.where(mask, out, OUTSIDE)


# -- training ------------------------------------------------------------------------------------------


def _variants(draw) -> tuple[str, int]:
    """A made-up value of a kind, in a form that the base patterns may miss, and its kind."""
    digits = lambda n: "".join(map(str, draw.integers(0, 10, n)))
    word = lambda n: "".join(chr(97 + k) for k in draw.integers(0, 26, n))
    kind = int(draw.choice([0, 0, 1, 2, 3]))  # addresses have the most forms
    if kind == 0:
        at, dot = [("@", "."), (" [at] ", "."), (" (at) ", " (dot) "), ("[at]", "[dot]"), (" at ", " dot "), (" @ ", ".")][draw.integers(0, 6)]
        more = draw.choice(['.', '_', '']) + digits(draw.integers(1, 4)) if draw.random() < 0.5 else draw.choice(['', '.', '_'])
        more += word(draw.integers(3, 9)) if more in ('.', '_') else ''
        return f"{word(draw.integers(3, 9))}{more}{at}{word(draw.integers(4, 9))}{dot}{draw.choice(['com', 'org', 'net', 'example', 'de'])}", 0
    if kind == 1:
        dot = draw.choice([".", ".", "[.]", " . "])
        return dot.join(str(k) for k in draw.integers(1, 256, 4)), 1
    if kind == 2:
        plain, gap = digits(15), draw.choice(["", " ", "-", "."])
        plain += next(d for d in "0123456789" if luhn(plain + d))
        return gap.join(plain[k : k + 4] for k in range(0, 16, 4)) if gap else plain, 2
    area, mid, last = digits(3), digits(3), digits(4)
    return [f"({area}) {mid}-{last}", f"{area}-{mid}-{last}", f"{area}.{mid}.{last}", f"+{digits(2)} {area} {mid} {last}", f"+{digits(1)} ({area}) {mid}-{last}", f"00{digits(2)} {area} {mid}{last}"][draw.integers(0, 6)], 3


def training_windows(texts: list[str], limit: int = SAMPLE_WINDOWS, seed: int = 11) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Classes, labels and mask of windows: around base spans, with put-in values, and plain ones.

    Distractors (plain numbers, times, versions, long hexadecimal strings) stay outside.
    """
    draw, rows = np.random.default_rng(seed), []
    texts = [t for t in texts if len(t) >= 8] or ["no personal data here, only words"]
    for text in texts:
        for start, _, end in base_spans(text)[:4]:
            a = max(0, start - int(draw.integers(0, WINDOW - 40)))
            piece = text[a : a + WINDOW]
            rows.append((piece, base_spans(piece)))
    rows = [rows[k] for k in draw.permutation(len(rows))[: limit // 3]]
    while len(rows) < limit:
        text = texts[draw.integers(0, len(texts))]
        a = int(draw.integers(0, max(1, len(text) - WINDOW)))
        piece = text[a : a + WINDOW]
        spans = base_spans(piece)
        what = draw.random()
        cut = piece.find(" ", int(draw.integers(0, 50)))
        if what < 0.45 and cut >= 0:
            value, kind = _variants(draw)
            piece = piece[: cut + 1] + value + piece[cut:]
            spans = [s for s in base_spans(piece) if s[2] <= cut + 1 or s[0] > cut + len(value)] + [(cut + 1, kind, cut + 1 + len(value))]
            spans = [s for s in spans if s[2] <= WINDOW]
            piece = piece[:WINDOW] if cut + 1 + len(value) <= WINDOW else piece[: cut + 1]
        elif what < 0.75 and cut >= 0:
            digits = lambda n: "".join(map(str, draw.integers(0, 10, n)))
            other = [digits(int(draw.integers(1, 9))), f"{digits(1)}.{digits(1)}", f"{digits(2)}:{digits(2)}", digits(4), f"{digits(4)}-{digits(2)}-{digits(2)}", f"{digits(3)},{digits(3)}", "".join(draw.choice(list("0123456789abcdef"), 32)), "".join(draw.choice(list("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"), 20)), f"v{digits(1)}.{digits(2)}.{digits(1)}", digits(int(draw.integers(20, 30)))][draw.integers(0, 10)]
            if not base_spans(other):
                piece = (piece[: cut + 1] + other + piece[cut:])[:WINDOW]
                spans = base_spans(piece)
        rows.append((piece, spans))
    x, y, mask = np.zeros((len(rows), WINDOW), np.int16), np.zeros((len(rows), WINDOW), np.int8), np.zeros((len(rows), WINDOW), bool)
    for k, (piece, spans) in enumerate(rows):
        n = len(piece)
        x[k, :n], y[k, :n], mask[k, :n] = codes(piece), labels(n, sorted(spans)), True
    return x, y, mask


def learn(docs: DataFrame, text: str = "text", sample_docs: int | None = None, windows: int | None = None, epochs: int | None = None) -> Tagger:
    """Train on at most ``windows`` windows of at most ``sample_docs`` texts, chosen by a hash.

    They are ``SAMPLE_DOCS``, ``SAMPLE_WINDOWS`` and ``EPOCHS`` unless given.

    A hash of the text orders the documents, so the choice does not depend on the partitions. From
    each of them come bounded pieces around its base spans and from its beginning, middle and end.
    """
    sample_docs, windows, epochs = sample_docs or SAMPLE_DOCS, windows or SAMPLE_WINDOWS, epochs or EPOCHS
    chosen = stage(docs.where(F.col(text).isNotNull()).select(F.xxhash64(text).alias("h")).distinct().orderBy("h").limit(sample_docs), "pii-sample")

    def cut(batches):
        for batch in batches:
            out = []
            for value in batch.column("text").to_pylist():
                marks = [0, len(value) // 2, max(0, len(value) - 256), *(max(0, a - 100) for a, _, _ in base_spans(value)[:4])]
                out += [value[a : a + 256] for a in marks]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["piece"])

    texts = docs.where(F.col(text).isNotNull()).select(F.xxhash64(text).alias("h"), F.col(f"`{text}`").alias("text"))
    pieces = texts.join(F.broadcast(chosen), "h", "left_semi").select("text").mapInArrow(cut, "piece string").distinct().orderBy("piece")
    model = Tagger()
    model.losses = model.fit(*training_windows([r["piece"] for r in pieces.limit(16 * sample_docs).collect()], windows), epochs)
    return model


# -- whole texts -----------------------------------------------------------------------------------------


def has_mark(x: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Which characters a span must have one of: a digit, @ or a letter of the words at and dot.

    ``begin`` holds the places where texts begin; the words may stand in brackets or not.
    """
    mark = (x >= 0x30) & (x <= 0x39) | (x == 0x40)
    inside = np.zeros(CLASSES, bool)
    inside[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), 128, 129]] = True
    before, after = np.ones(len(x) + 1, bool), np.ones(len(x) + 1, bool)  # a word can begin, end at this place
    before[1:] = after[:-1] = ~inside[x]
    before[begin] = after[begin] = True
    low = np.where((x >= 0x41) & (x <= 0x5A), x + 0x20, x)
    for word in (b"at", b"dot"):
        n = len(word)
        if len(x) >= n:
            at = before[: len(x) - n + 1] & after[n:]
            for k, c in enumerate(word):
                at = at & (low[k : len(x) - n + 1 + k] == c)
            for k in range(n):
                mark[k : len(x) - n + 1 + k] |= at
    return mark


def tag(texts: list[str], model: Tagger) -> list[list[tuple[int, int, int]]]:
    """Model spans of whole texts.

    A span counts only if it has a digit, @ or one of the words at and dot, as all that is plausible
    does. Windows without one are decoded if a neighbour has one; the others could only give a span
    that reaches more than STRIDE characters beyond its last mark.
    """
    lengths = [len(t) for t in texts]
    x = codes("".join(texts))
    begin = np.concatenate([[0], np.cumsum(lengths)])
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    marks = np.concatenate([[0], np.cumsum(has_mark(x, begin))])
    starts, ends = [], []
    for r, n in enumerate(lengths):
        at = np.arange(0, max(1, n - WINDOW + STRIDE), STRIDE)
        a, b = begin[r] + at, begin[r] + np.minimum(at + WINDOW, n)
        some = marks[np.minimum(b + STRIDE, begin[r] + n)] > marks[np.maximum(a - STRIDE, begin[r])]
        starts.append(a[some])
        ends.append(b[some])
    starts, ends = np.concatenate([np.zeros(0, np.int64), *starts]), np.concatenate([np.zeros(0, np.int64), *ends])
    if not len(starts):
        return out
    found, depth = np.zeros(len(x), np.int8), np.zeros(len(x), np.int16)
    ramp = np.arange(WINDOW)
    for a in range(0, len(starts), TOGETHER):
        s, e = starts[a : a + TOGETHER], ends[a : a + TOGETHER]
        at = s[:, None] + ramp
        mask = at < e[:, None]
        at = np.minimum(at, len(x) - 1)
        y = model.decode(np.where(mask, x[at], 0), mask)
        deep = np.minimum(ramp + 1, (e - s)[:, None] - ramp).astype(np.int16)
        row = np.searchsorted(begin, s, side="right") - 1
        deep = deep + np.int16(WINDOW) * ((ramp < WINDOW // 2) & (s == begin[row])[:, None] | (ramp >= WINDOW // 2) & (e == begin[row + 1])[:, None])
        for odd in (0, 1):  # neighbours overlap, every second one does not
            some = ((s - begin[row]) // STRIDE) % 2 == odd
            here = mask[some] & (deep[some] > depth[at[some]])
            found[at[some][here]], depth[at[some][here]] = y[some][here], deep[some][here]
    kind, first = (found - 1) // 2, (found % 2 == 1)
    inside = found > 0
    edge = np.zeros(len(x) + 1, bool)
    edge[begin] = True
    start = inside & (first | edge[:-1] | np.concatenate([[True], ~inside[:-1] | (kind[1:] != kind[:-1])]))
    stop = inside & np.concatenate([~inside[1:] | start[1:] | edge[1:-1], [True]])
    for a, b in zip(np.flatnonzero(start).tolist(), (np.flatnonzero(stop) + 1).tolist()):
        if marks[b] > marks[a]:
            r = int(np.searchsorted(begin, a, side="right")) - 1
            out[r].append((a - int(begin[r]), int(kind[a]), b - int(begin[r])))
    return out


#: An address without @ and digits, its signs in words: name (at) host dot com, name[at]host.com.
_SPELT = re.compile(
    r"[\w.%+-]+\s*[\[({<]?\s*\bat\b\s*[\])}>]?\s*[\w-]+(?:(?:\.|\s*[\[({<]?\s*\bdot\b\s*[\])}>]?\s*)[\w-]+)+", re.IGNORECASE
)
#: Least and most digits of a model span by kind, and least other requirement; others are noise.
_DIGITS = {1: (4, 12), 2: (12, 19), 3: (7, 15)}


def plausible(text: str, span: tuple[int, int, int]) -> bool:
    """A span of the right shape: whole words, and as many digits as its kind has."""
    start, kind, end = span
    if start and text[start - 1].isalnum() or end < len(text) and text[end].isalnum():
        return False
    part = text[start:end]
    digits = sum("0" <= c <= "9" for c in part)
    if kind == 0:
        if not digits and "@" not in part:
            return _SPELT.fullmatch(part) is not None
        return any(c.isalpha() for c in part) and re.search(r"@|\bat\b", part) is not None and re.search(r"\.|\bdot\b", part) is not None
    low, high = _DIGITS[kind]
    return low <= digits <= high and not any(c.isalpha() for c in part) and (kind != 2 or luhn(re.sub(r"[^0-9]", "", part)))


def both(text: str, base: list, found: list) -> list[tuple[int, int, int]]:
    """Base spans and the model's spans that are plausible and touch no base span."""
    extra, k = [], 0
    ends = np.maximum.accumulate([b for _, _, b in base]) if base else []
    starts = [a for a, _, _ in base]
    for a, kind, b in found:
        k = int(np.searchsorted(starts, b)) if base else 0
        if not (k and ends[k - 1] > a) and plausible(text, (a, kind, b)):
            extra.append((a, kind, b))
    return sorted(base + extra)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def find(docs: DataFrame, model: Tagger, text: str = "text", carry: list[str] | None = None, masked: str | None = None) -> DataFrame:
    """Add the counts and the list of base spans, and ``spans``: all spans with the model's.

    Spans are ``kind:start:end`` in code points, by start and kind. With ``masked`` a column of that
    name holds the text with each span replaced by its kind in angle brackets (overlaps as one).
    Null texts count as empty (their masked text stays null); a row depends on its text alone, so
    repeated rows and null ids need no care; an input column named like an output gives way to it.
    """
    shared = share(docs.sparkSession, model)  # fixed size

    def work():
        own = received(shared)

        def step(batch):
            values = batch.column(text).to_pylist()
            texts = [v or "" for v in values]
            base = [base_spans(t) for t in texts]
            spans = [both(t, b, f) for t, b, f in zip(texts, base, tag(texts, own))]
            out = {f"n_{k}": [sum(s[1] == i for s in b) for b in base] for i, k in enumerate(KINDS)}
            out |= {"base": [joined(b) for b in base], "spans": [joined(s) for s in spans]}
            if masked:
                out[masked] = [None if v is None else mask_text(v, s) for v, s in zip(values, spans)]
            return out

        return step

    schema = "n_email long, n_ip long, n_card long, n_phone long, base string, spans string"
    return map_texts(docs, work, schema + (f", `{masked}` string" if masked else ""), text, carry)


def mask_text(text: str, spans: list[tuple[int, int, int]]) -> str:
    out, end = [], 0
    for a, kind, b in spans:
        if a >= end:
            out += [text[end:a], f"<{KINDS[kind]}>"]
        end = max(end, b)
    return "".join(out) + text[end:]


def verdicts(docs: DataFrame) -> DataFrame:
    found = find(docs, learn(docs), carry=["doc_id"])
    counts = [f"n_{k}" for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans")
