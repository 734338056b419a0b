"""Personal data: patterns, and a character-level bidirectional LSTM with CRF transitions.

Patterns give the base spans (email, ip, card, phone). The tagger adds spans that patterns miss, such
as telephone numbers without a country code. It reads character classes, not characters; its labels
are begin and inside of each kind. Windows of ``WIDTH`` characters that overlap by half lie over the
whole text and are decoded by Viterbi; every character takes the label of the window in whose middle it
lies most, so spans come from one global sequence. A span has to hold what its kind can't do without
(see ``plausible``), and one that touches a base span gives way to it.

Every kind needs a digit or an @. So of the windows only those are decoded in whose middle one lies,
and then, as long as a label goes on beyond a decoded middle, the windows beside it; a span in the
others could hold neither. The spans are those of decoding every window, however long they are.

Weights are trained in numpy, by default from sentences with labelled spans that a seeded generator
writes, once in a driver's life; ``train`` takes any labelled texts.

Positions are code points, the end exclusive. Defined results: a null text counts as empty; texts
without matches have no spans; texts of any length are read whole; repeated rows get a row each; an
empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
TAGS = 1 + 2 * len(KINDS)  # none, then begin and inside of each kind
WIDTH = 96
STRIDE = WIDTH // 2
EMBED, HIDDEN = 10, 16
STEPS, BATCH, TRAIN_WIDTH, SAMPLES = 260, 48, 64, 3000
#: The base patterns. Where a run can only match from its start, the pattern says so.
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
SIGN = re.compile(r"[0-9@]")
CLASSES = "@.-_+()%,:'\"/"
PAD, LOWER, UPPER, LETTER, DIGIT, SPACE, CONTROL, PUNCT, OTHER = range(9)
ALPHABET = 9 + len(CLASSES)

Span = tuple[int, int, int]  # start, rank of kind, end


def luhn(digits: str) -> bool:
    values = [int(d) for d in reversed(digits)]
    return (sum(values[::2]) + sum(sum(divmod(2 * d, 10)) for d in values[1::2])) % 10 == 0


def only_digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each kind that meet its rule, in order."""
    if not SIGN.search(text):
        return []
    found, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL_CHARS:
            start -= 1
        match = DOMAIN.match(text, at + 1) if start < at else None
        if match:
            found.append((start, 0, match.end()))
            last = match.end()
        at = text.find("@", max(at + 1, last))
    found += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))]
    found += [(m.start(), 2, m.end()) for m in CARD.finditer(text) if 12 <= len(d := only_digits(m[0])) <= 19 and luhn(d)]
    found += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(only_digits(m[0])) <= 15]
    return sorted(found)


def class_of(c: str) -> int:
    if c in CLASSES:
        return 9 + CLASSES.index(c)
    if "a" <= c <= "z":
        return LOWER
    if "A" <= c <= "Z":
        return UPPER
    if "0" <= c <= "9":
        return DIGIT
    if c == " ":
        return SPACE
    if ord(c) < 128:
        return CONTROL if ord(c) < 32 or c == "\x7f" else PUNCT
    return LETTER if c.isalpha() else OTHER


ASCII_CLASSES = np.array([class_of(chr(k)) for k in range(128)], np.int64)


def encode(text: str) -> np.ndarray:
    """The class of each code point."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    out = ASCII_CLASSES[np.minimum(points, 127)]
    beyond = np.flatnonzero(points > 127)
    out[beyond] = [class_of(chr(p)) for p in points[beyond].tolist()]
    return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def lstm(x: np.ndarray, w: np.ndarray, u: np.ndarray, b: np.ndarray, keep: bool = False):
    """States (time, row, HIDDEN) of inputs (time, row, EMBED); with keep, what going back needs too."""
    steps, n, _ = x.shape
    h, c = np.zeros((n, HIDDEN), x.dtype), np.zeros((n, HIDDEN), x.dtype)
    inputs, out, kept = x @ w + b, np.empty((steps, n, HIDDEN), x.dtype), []
    for t in range(steps):
        z = inputs[t] + h @ u
        gates = sigmoid(z[:, : 3 * HIDDEN])
        i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
        g = np.tanh(z[:, 3 * HIDDEN :])
        before, c = (h, c), f * c + i * g
        h = o * np.tanh(c)
        out[t] = h
        if keep:
            kept.append((*before, i, f, o, g, c))
    return (out, kept) if keep else out


def lstm_back(x, w, u, kept, d_out):
    """Gradients of inputs and weights."""
    d_x, d_w, d_u, d_b = np.zeros_like(x), np.zeros_like(w), np.zeros_like(u), np.zeros(w.shape[1], x.dtype)
    d_h, d_c = np.zeros_like(d_out[0]), np.zeros_like(d_out[0])
    for t in reversed(range(len(x))):
        h0, c0, i, f, o, g, c = kept[t]
        d_h = d_h + d_out[t]
        tc = np.tanh(c)
        d_c = d_c + d_h * o * (1 - tc * tc)
        d_z = np.concatenate([d_c * g * i * (1 - i), d_c * c0 * f * (1 - f), d_h * tc * o * (1 - o), d_c * i * (1 - g * g)], 1)
        d_x[t], d_w, d_u, d_b = d_z @ w.T, d_w + x[t].T @ d_z, d_u + h0.T @ d_z, d_b + d_z.sum(0)
        d_h, d_c = d_z @ u.T, d_c * f
    return d_x, d_w, d_u, d_b


def log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis))


def crf_gradient(scores: np.ndarray, moves: np.ndarray, tags: np.ndarray):
    """Mean negative log-likelihood of tags (time, row), and its gradients by scores and by moves."""
    steps, n, k = scores.shape
    ahead, back = np.empty_like(scores), np.zeros_like(scores)
    ahead[0] = scores[0]
    for t in range(1, steps):
        ahead[t] = scores[t] + log_sum(ahead[t - 1][:, :, None] + moves, 1)
    for t in range(steps - 2, -1, -1):
        back[t] = log_sum(moves + (scores[t + 1] + back[t + 1])[:, None, :], 2)
    total = log_sum(ahead[-1], 1)
    d_scores = np.exp(ahead + back - total[:, None])
    rows = np.arange(n)
    loss, d_moves = total - scores[0, rows, tags[0]], np.zeros_like(moves)
    d_scores[0, rows, tags[0]] -= 1
    for t in range(1, steps):
        pair = np.exp(ahead[t - 1][:, :, None] + moves + (scores[t] + back[t])[:, None, :] - total[:, None, None])
        d_moves += pair.sum(0)
        np.add.at(d_moves, (tags[t - 1], tags[t]), -1)
        d_scores[t, rows, tags[t]] -= 1
        loss = loss - scores[t, rows, tags[t]] - moves[tags[t - 1], tags[t]]
    return loss.mean(), d_scores / n, d_moves / n


def new_weights(seed: int) -> dict[str, np.ndarray]:
    r = np.random.default_rng(seed)
    draw = lambda *s: (r.standard_normal(s) / np.sqrt(s[0])).astype(np.float64)
    out = {"embed": draw(ALPHABET, EMBED), "out": draw(2 * HIDDEN, TAGS), "bias": np.zeros(TAGS), "moves": np.zeros((TAGS, TAGS))}
    for way in ("fore", "rear"):
        out |= {f"{way}_w": draw(EMBED, 4 * HIDDEN), f"{way}_u": draw(HIDDEN, 4 * HIDDEN), f"{way}_b": np.repeat([0.0, 1.0, 0.0, 0.0], HIDDEN)}
    return out


def emissions(m: dict[str, np.ndarray], codes: np.ndarray) -> np.ndarray:
    """Tag scores (time, row, tag) of windows (row, time)."""
    x = m["embed"][codes.T]
    fore = lstm(x, m["fore_w"], m["fore_u"], m["fore_b"])
    rear = lstm(x[::-1], m["rear_w"], m["rear_u"], m["rear_b"])[::-1]
    return np.concatenate([fore, rear], 2) @ m["out"] + m["bias"]


def gradient(m: dict[str, np.ndarray], codes: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    x = m["embed"][codes.T]
    fore, fore_kept = lstm(x, m["fore_w"], m["fore_u"], m["fore_b"], True)
    rear, rear_kept = lstm(x[::-1], m["rear_w"], m["rear_u"], m["rear_b"], True)
    both = np.concatenate([fore, rear[::-1]], 2)
    loss, d_scores, d_moves = crf_gradient(both @ m["out"] + m["bias"], m["moves"], tags.T)
    d = {"moves": d_moves, "bias": d_scores.sum((0, 1)), "out": np.einsum("tnh,tnk->hk", both, d_scores)}
    d_both = d_scores @ m["out"].T
    d_x, d["fore_w"], d["fore_u"], d["fore_b"] = lstm_back(x, m["fore_w"], m["fore_u"], fore_kept, d_both[:, :, :HIDDEN])
    d_r, d["rear_w"], d["rear_u"], d["rear_b"] = lstm_back(x[::-1], m["rear_w"], m["rear_u"], rear_kept, d_both[::-1, :, HIDDEN:])
    d["embed"] = np.zeros_like(m["embed"])
    np.add.at(d["embed"], codes.T, d_x + d_r[::-1])
    return loss, d


def labelled_samples(n: int = SAMPLES, seed: int = 7) -> list[tuple[str, list[Span]]]:
    """Sentences of made-up words with labelled personal data and with numbers that are none."""
    r = np.random.default_rng(seed)
    pick = lambda xs: xs[int(r.integers(len(xs)))]
    digits = lambda k: "".join(str(d) for d in r.integers(0, 10, k))
    letters = "abcdefghijklmnopqrstuvwxyzéüñç"
    word = lambda: "".join(pick(letters) for _ in range(int(r.integers(2, 11))))
    plain = lambda: "".join(pick(letters[:26]) for _ in range(int(r.integers(2, 9))))

    def card() -> str:
        body = "4" + digits(14)
        body += next(d for d in "0123456789" if luhn(body + d))
        sep = pick(["", "", " ", "-"])
        return sep.join(body[k : k + 4] for k in range(0, 16, 4))

    def phone() -> str:
        a, b, c = digits(3), digits(3), digits(4)
        return pick([f"+{pick('1234')} ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"+{digits(2)} {a} {b}{c}", f"{a}.{b}.{c}"])

    makers = [
        lambda: f"{plain()}{pick(['.', '_', '', '+'])}{pick([plain(), digits(2)])}@{plain()}{pick(['', digits(1)])}.{pick(['com', 'org', 'example.com', 'net'])}",
        lambda: ".".join(str(v) for v in r.integers(0, 256, 4)),
        card,
        phone,
    ]
    others = [lambda: digits(int(r.integers(1, 7))), lambda: f"{digits(1)}.{digits(1)}.", lambda: f"{digits(4)}-{digits(2)}-{digits(2)}", lambda: f"{digits(2)}:{digits(2)}", lambda: f"v{digits(1)}.{digits(2)}.{digits(1)}", lambda: f"@{plain()}", lambda: digits(int(r.integers(20, 30))), lambda: f"{digits(3)},{digits(3)}", lambda: f"0x{digits(6)}"]
    out = []
    for _ in range(n):
        text, spans = "", []
        for _ in range(int(r.integers(4, 14))):
            roll = r.random()
            if roll < 0.22:
                kind = int(r.integers(len(KINDS)))
                made = makers[kind]()
                spans.append((len(text), kind, len(text) + len(made)))
                text += made
            else:
                text += pick(others)() if roll < 0.4 else word()
            text += pick([" ", " ", " ", ", ", ". ", "\n", " | ", "!! ", ": "])
        out.append((text, spans))
    return out


def tags_of(length: int, spans: list[Span]) -> np.ndarray:
    tags = np.zeros(length, np.int64)
    for start, kind, end in spans:
        tags[start:end] = 2 + 2 * kind
        tags[start] = 1 + 2 * kind
    return tags


def train(samples: list[tuple[str, list[Span]]], steps: int = STEPS, seed: int = 1) -> dict[str, np.ndarray]:
    """Weights from labelled texts, by Adam over random windows."""
    r = np.random.default_rng(seed)
    data = [(np.append(encode(t), np.zeros(TRAIN_WIDTH, np.int64)), np.append(tags_of(len(t), s), np.zeros(TRAIN_WIDTH, np.int64)), len(t)) for t, s in samples if t]
    m = new_weights(seed)
    mean, square = ({k: np.zeros_like(v) for k, v in m.items()} for _ in range(2))
    for step in range(1, steps + 1):
        codes, tags = np.empty((BATCH, TRAIN_WIDTH), np.int64), np.empty((BATCH, TRAIN_WIDTH), np.int64)
        for k in range(BATCH):
            c, y, n = data[int(r.integers(len(data)))]
            at = int(r.integers(0, max(1, n - TRAIN_WIDTH // 2)))
            codes[k], tags[k] = c[at : at + TRAIN_WIDTH], y[at : at + TRAIN_WIDTH]
        _, d = gradient(m, codes, tags)
        rate = 0.02 * min(1, 2 * (1 - step / (steps + 1)))
        for k in m:
            g = np.clip(d[k], -5, 5)
            mean[k], square[k] = 0.9 * mean[k] + 0.1 * g, 0.99 * square[k] + 0.01 * g * g
            m[k] = m[k] - rate * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-8)
    return {k: v.astype(np.float32) for k, v in m.items()}


@lru_cache(maxsize=1)
def default_model() -> dict[str, np.ndarray]:
    return train(labelled_samples())


def decode(m: dict[str, np.ndarray], codes: np.ndarray) -> np.ndarray:
    """The best tag sequence of each window."""
    scores, moves = emissions(m, codes), m["moves"]
    best, came = scores[0], []
    for t in range(1, len(scores)):
        reach = best[:, :, None] + moves
        came.append(reach.argmax(1))
        best = reach.max(1) + scores[t]
    tags = np.empty(codes.shape, np.int64)
    tags[:, -1] = best.argmax(1)
    for t in range(len(came) - 1, -1, -1):
        tags[:, t] = came[t][np.arange(len(tags)), tags[:, t + 1]]
    return tags


class Windows:
    """The windows over a text of some length, and the middles for whose characters they speak."""

    def __init__(self, length: int):
        self.length, self.count = length, max(1, -(-(length - STRIDE) // STRIDE))

    def owner(self, at: int) -> int:
        """The window in whose middle a place lies."""
        return min(max(at - WIDTH // 4, 0) // STRIDE, self.count - 1)

    def middle(self, k: int) -> tuple[int, int]:
        return (k * STRIDE + WIDTH // 4 if k else 0), (self.length if k == self.count - 1 else (k + 1) * STRIDE + WIDTH // 4)


def label_line(m: dict[str, np.ndarray], texts: list[str], every: bool = False) -> list[np.ndarray | None]:
    """The label of each character of each text, 0 where no window had to be decoded; of all windows, if asked."""
    lines: list[np.ndarray | None] = [None] * len(texts)
    windows = [Windows(len(t)) for t in texts]
    todo = {(k, w) for k, t in enumerate(texts) if t for w in (range(windows[k].count) if every else {windows[k].owner(x.start()) for x in SIGN.finditer(t)})}
    done: set[tuple[int, int]] = set()
    while todo:
        now, todo = sorted(todo), set()
        done.update(now)
        for at in range(0, len(now), 512):
            part = now[at : at + 512]
            codes = np.zeros((len(part), WIDTH), np.int64)
            for row, (k, w) in enumerate(part):
                code = encode(texts[k][w * STRIDE : w * STRIDE + WIDTH])
                codes[row, : len(code)] = code
            for (k, w), tags in zip(part, decode(m, codes), strict=True):
                low, high = windows[k].middle(w)
                if lines[k] is None:
                    lines[k] = np.zeros(len(texts[k]), np.int8)
                lines[k][low:high] = tags[low - w * STRIDE : high - w * STRIDE]
                if w and tags[low - w * STRIDE] and tags[low - w * STRIDE] % 2 == 0 and (k, w - 1) not in done:
                    todo.add((k, w - 1))  # a span goes on to the left
                if w < windows[k].count - 1 and tags[high - 1 - w * STRIDE] and (k, w + 1) not in done:
                    todo.add((k, w + 1))
        todo -= done
    return lines


def plausible(kind: int, text: str) -> bool:
    """What a span of a kind can't do without."""
    if kind == 0:
        local, at, domain = text.partition("@")
        return bool(at and local and "." in domain.strip(".") and "@" not in domain) and not any(map(str.isspace, text))
    if kind == 1:
        parts = text.split(".")
        return len(parts) == 4 and all(p.isascii() and p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in parts)
    digits = only_digits(text)
    if kind == 2:
        return 12 <= len(digits) <= 19 and luhn(digits)
    return 9 <= len(digits) <= 15 and all(c in "+() .-0123456789" for c in text) and len(text) > len(digits)


def tagged_spans(m: dict[str, np.ndarray], texts: list[str], bases: list[list[Span]], every: bool = False) -> list[list[Span]]:
    """The tagger's spans of each text, apart from its base spans; windows of all texts are decoded together."""
    out: list[list[Span]] = [[] for _ in texts]
    for k, (text, line) in enumerate(zip(texts, label_line(m, texts, every), strict=True)):
        if line is None:
            continue
        places = np.flatnonzero(line)
        labels = line[places].tolist()
        start, kind, last = -1, -1, -2

        def close() -> None:
            x, z = start, last + 1
            while z > x and text[z - 1] in " .-(,":
                z -= 1
            if plausible(kind, text[x:z]) and not any(s < z and x < e for s, _, e in bases[k]):
                out[k].append((x, kind, z))

        for at, y in zip(places.tolist(), labels, strict=True):
            if start >= 0 and not (at == last + 1 and y % 2 == 0 and (y - 1) // 2 == kind):
                close()
                start = -1
            if y % 2 == 1:
                start, kind = at, (y - 1) // 2
            last = at
        if start >= 0:
            close()
    return out


def listed(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in sorted(spans))


def find(documents: DataFrame, model: dict[str, np.ndarray] | None = None) -> DataFrame:
    """Per document row: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans."""
    model = model if model is not None else default_model()

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = [t or "" for t in part.column(1).to_pylist()]
                bases = [base_spans(t) for t in texts]
                added = tagged_spans(model, texts, bases)
                counts = [pa.array([sum(s[1] == k for s in b) for b in bases], pa.int64()) for k in range(len(KINDS))]
                sums = pa.array([hashlib.sha256(listed(b).encode()).hexdigest() for b in bases])
                spans = pa.array([listed(b + a) for b, a in zip(bases, added, strict=True)])
                yield pa.RecordBatch.from_arrays([part.column(0), *counts, sums, spans], ["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans"])

    schema = "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string"
    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(scanned, schema)
