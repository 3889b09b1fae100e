"""Personal data: a character-level bidirectional LSTM with CRF transitions beside exact base patterns.

Base spans come from exact patterns, matched in linear time. The network is trained in numpy from labelled spans: the
base spans of a bounded sample of documents, and generated spans in further spellings put into their texts. It reads
overlapping windows; emissions of a character from two windows are averaged with weights that fall towards a window's
ends, and one Viterbi pass over each stretch of windows decides globally, so no span is cut by a window.

A span of the network must satisfy the exact check of its kind (`plausible`). It asks for digits, or in an email of at most
`LONGEST` characters for '@', or for the word "at" before a dot that ends no sentence. Windows that hold one of these, and
those that overlap them, make the stretches; no span outside of them can pass the check. `everywhere` runs all windows
instead, which is dearer by far; spans can then differ only by what the network reads beyond a stretch. Spans of the network
that meet a base span are dropped.

Defined results: a null text is empty and has no span. Texts of any length are read whole, in linear time, with some ten
bytes of memory a character of the longest stretch. Equal texts get equal spans. Offsets are code points, ends exclusive.
Repeated rows get equal results; an empty table gives an empty one. Other columns are ignored."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, bounded_sample, small_batches

KINDS = ("email", "ip", "card", "phone")
# Outside, then begin and inside of each kind.
TAGS = 1 + 2 * len(KINDS)
WINDOW, STRIDE = 96, 48
#: Characters of an email of the network at most, and windows that are in memory at once.
LONGEST, HELD = 96, 2048

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# A match can only begin where a run of digits begins, so looking behind changes nothing but the time taken.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9@]")
# A dot in a host: followed by a letter, between blanks, or the word.
_DOT = r"(?:\.(?=[A-Za-z])|\s\.\s|\bdot\b)"
_SPELLED = re.compile(rf"[A-Za-z0-9].*(?:@|\bat\b).*[A-Za-z0-9]\s?{_DOT}\s?[A-Za-z]", re.DOTALL)
# Every span that `plausible` accepts holds one of these.
_TRIGGER = re.compile(rf"[0-9@]+|\bat\b(?=.{{0,{LONGEST}}}?{_DOT})", re.DOTALL)
_DIGITS = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        total += n if i % 2 == 0 else (2 * n - 9 if n > 4 else 2 * n)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """All base spans, by kind as listed and then by start."""
    if not _DIGIT.search(text):
        return []
    out, done = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            out.append(("email", start, m.end()))
            done = m.end()
        else:
            done = at + 1
        at = text.find("@", done)
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.group().split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        digits = _DIGITS.sub("", m.group())
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    for m in _PHONE.finditer(text):
        if 8 <= sum(m.group().count(d) for d in "0123456789") <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


def plausible(kind: str, span: str) -> bool:
    """The exact check of a span of the network."""
    digits = _DIGITS.sub("", span)
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits) and not re.search(r"[A-Za-z]", span)
    if kind == "phone":
        return 8 <= len(digits) <= 15 and not re.search(r"[A-Za-z]", span)
    if kind == "ip":
        parts = re.findall(r"[0-9]+", span)
        return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts) and not re.search(r"[A-Za-z]", span)
    return len(span) <= LONGEST and bool(_SPELLED.search(span))


# --- the network -------------------------------------------------------------------------------------------------


def classes(text: str) -> np.ndarray:
    """Each character's input class: printable ASCII by itself, line ends, other letters, other characters."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    out = np.where((points >= 32) & (points < 127), points - 31, 96).astype(np.int64)
    out[(points == 10) | (points == 13) | (points == 9)] = 97
    out[points >= 192] = 98
    return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def lstm(x: np.ndarray, w: np.ndarray, u: np.ndarray, b: np.ndarray, keep: bool = False):
    """x: (time, batch, in). Returns hidden states (time, batch, out), with what the way back needs if `keep`."""
    steps, batch, _ = x.shape
    size = u.shape[0]
    drive = x @ w + b
    h, c = np.zeros((batch, size), np.float32), np.zeros((batch, size), np.float32)
    hidden = np.empty((steps, batch, size), np.float32)
    saved = []
    for t in range(steps):
        z = drive[t] + h @ u
        gates = sigmoid(z[:, : 3 * size])
        i, f, o = gates[:, :size], gates[:, size : 2 * size], gates[:, 2 * size :]
        g = np.tanh(z[:, 3 * size :])
        before, c = c, f * c + i * g
        tc = np.tanh(c)
        if keep:
            saved.append((h, before, i, f, o, g, tc))
        h = o * tc
        hidden[t] = h
    return (hidden, saved) if keep else hidden


def lstm_back(x, w, u, saved, dh_all):
    """Gradients of w, u, b and x for the gradients of the hidden states."""
    steps, batch, _ = x.shape
    size = u.shape[0]
    dz_all = np.empty((steps, batch, 4 * size), np.float32)
    du = np.zeros_like(u)
    dh, dc = np.zeros((batch, size), np.float32), np.zeros((batch, size), np.float32)
    for t in range(steps - 1, -1, -1):
        h, before, i, f, o, g, tc = saved[t]
        dh = dh + dh_all[t]
        dc = dc + dh * o * (1 - tc * tc)
        dz = dz_all[t]
        dz[:, :size] = dc * g * i * (1 - i)
        dz[:, size : 2 * size] = dc * before * f * (1 - f)
        dz[:, 2 * size : 3 * size] = dh * tc * o * (1 - o)
        dz[:, 3 * size :] = dc * i * (1 - g * g)
        dc = dc * f
        du += h.T @ dz
        dh = dz @ u.T
    flat = dz_all.reshape(-1, 4 * size)
    return x.reshape(-1, x.shape[2]).T @ flat, du, flat.sum(0), dz_all @ w.T


def allowed() -> np.ndarray:
    """Transitions that tags permit: inside only after begin or inside of the same kind."""
    ok = np.ones((TAGS, TAGS), bool)
    for kind in range(len(KINDS)):
        ok[:, 2 + 2 * kind] = False
        ok[1 + 2 * kind, 2 + 2 * kind] = ok[2 + 2 * kind, 2 + 2 * kind] = True
    return ok


def logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis, keepdims=True))).squeeze(axis)


def crf(emit: np.ndarray, trans: np.ndarray, tags: np.ndarray):
    """Negative log likelihood of tags (time, batch), and the gradients of emissions and transitions."""
    steps, batch, k = emit.shape
    alpha, beta = np.empty_like(emit), np.zeros_like(emit)
    alpha[0] = emit[0]
    for t in range(1, steps):
        alpha[t] = logsumexp(alpha[t - 1][:, :, None] + trans, 1) + emit[t]
    for t in range(steps - 2, -1, -1):
        beta[t] = logsumexp(trans + (emit[t + 1] + beta[t + 1])[:, None, :], 2)
    log_z = logsumexp(alpha[-1], 1)
    d_emit = np.exp(alpha + beta - log_z[:, None])
    pair = np.exp(alpha[:-1, :, :, None] + trans + (emit[1:] + beta[1:])[:, :, None, :] - log_z[:, None, None])
    d_trans = pair.sum((0, 1))
    rows, cols = np.arange(steps)[:, None], np.arange(batch)
    gold = emit[rows, cols, tags].sum(0) + trans[tags[:-1], tags[1:]].sum(0)
    d_emit[rows, cols, tags] -= 1
    np.subtract.at(d_trans, (tags[:-1], tags[1:]), 1)
    return float((log_z - gold).sum()), d_emit, d_trans


@dataclass
class PiiModel:
    weights: dict[str, np.ndarray]

    def emissions(self, ids: np.ndarray) -> np.ndarray:
        """ids: (time, batch)."""
        p = self.weights
        x = p["embed"][ids]
        ahead = lstm(x, p["w1"], p["u1"], p["b1"])
        behind = lstm(x[::-1], p["w2"], p["u2"], p["b2"])[::-1]
        return np.concatenate([ahead, behind], 2) @ p["out"] + p["ob"]

    def spans(self, text: str) -> list[tuple[str, int, int]]:
        """Spans of the network over the whole text."""
        return self.many([text])[0]

    def many(self, texts: list[str], everywhere: bool = False, batch: int = 512) -> list[list[tuple[str, int, int]]]:
        """Spans of every text."""
        out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
        runs = [(number, *run) for number, text in enumerate(texts) for run in ([(0, -(-len(text) // STRIDE))] if everywhere and text else stretches(text))]
        runs.sort(key=lambda r: r[1] - r[2])  # stretches of about the same length are decided together
        at = 0
        while at < len(runs):
            end = at + 1
            while end < len(runs) and (end - at) * (runs[at][2] - runs[at][1]) < HELD:
                end += 1
            group, at = runs[at:end], end
            for (number, first, _), tags in zip(group, self.tags(texts, group, batch)):
                out[number] += found(texts[number], first * STRIDE, tags)
        return [sorted(spans, key=lambda s: s[1]) for spans in out]

    def tags(self, texts: list[str], group: list[tuple[int, int, int]], batch: int) -> list[np.ndarray]:
        """The best tags of stretches, longest first, which go on from one part of HELD windows to the next together."""
        fade = np.minimum(np.arange(1, WINDOW + 1), np.arange(WINDOW, 0, -1)).astype(np.float32)[:, None]
        ahead, behind = fade[:STRIDE], fade[STRIDE:]
        sizes = [min(len(texts[n]), last * STRIDE + STRIDE) - first * STRIDE for n, first, last in group]
        longest = group[0][2] - group[0][1]
        step = max(1, HELD // len(group))
        before = np.zeros((len(group), STRIDE, TAGS), np.float32)
        score, backs = None, []
        for at in range(0, longest + 1, step):
            blocks = min(step, longest + 1 - at)  # the last block is the second half of the last window
            windows = [(g, k) for g, (_, first, last) in enumerate(group) for k in range(at, min(at + blocks, last - first))]
            emit = np.zeros((len(group), blocks + 1, STRIDE, TAGS), np.float32)
            weight = np.zeros((len(group), blocks + 1, STRIDE, 1), np.float32)
            emit[:, 0] += before
            weight[:, 0] += behind * (at > 0)
            for begin in range(0, len(windows), batch):
                part = windows[begin : begin + batch]
                ids = np.zeros((WINDOW, len(part)), np.int64)
                for j, (g, k) in enumerate(part):
                    number, first, _ = group[g]
                    c = classes(texts[number][(first + k) * STRIDE : (first + k) * STRIDE + WINDOW])
                    ids[: len(c), j] = c
                e = self.emissions(ids).transpose(1, 0, 2) * fade
                g, k = (np.array(x) for x in zip(*part))
                emit[g, k - at] += e[:, :STRIDE]
                weight[g, k - at] += ahead
                emit[g, k - at + 1] += e[:, STRIDE:]
                weight[g, k - at + 1] += behind
            before = emit[:, blocks]
            mean = (emit[:, :blocks] / np.maximum(weight[:, :blocks], 1e-6)).reshape(len(group), blocks * STRIDE, TAGS).transpose(1, 0, 2)
            back, score = self.forward(mean, [n - at * STRIDE for n in sizes], score)
            backs.append(back)
        back = np.concatenate(backs)
        tag, path = score.argmax(1), np.zeros(back.shape[:2], np.int8)
        live = np.searchsorted(-np.array(sizes), -np.arange(1, len(back) + 1), side="right")  # stretches that long
        rows = np.arange(len(group))
        for t in range(len(back) - 1, -1, -1):
            n = live[t]
            path[t, :n] = tag[:n]
            tag[:n] = back[t, rows[:n], tag[:n]]
        return [path[:n, g] for g, n in enumerate(sizes)]

    def forward(self, emit: np.ndarray, left: list[int], score: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Back pointers and last scores of (time, stretch, tag); a stretch stops after the characters that it has left."""
        trans = np.where(allowed(), self.weights["trans"], -1e4).astype(np.float32)
        back = np.zeros(emit.shape, np.int8)
        live = np.searchsorted(-np.array(left), -np.arange(1, len(emit) + 1), side="right")
        start = 0
        if score is None:
            score, start = emit[0].copy(), 1
            score[:, 2::2] = -1e4
        for t in range(start, len(emit)):
            n = int(live[t])
            if not n:
                break
            step = score[:n, :, None] + trans
            score[:n] = step.max(1) + emit[t, :n]
            back[t, :n] = step.argmax(1)
        return back, score


def stretches(text: str) -> list[tuple[int, int]]:
    """Runs of windows (first, behind the last) that hold a trigger or overlap one that does."""
    out: list[list[int]] = []
    most = (len(text) - 1) // STRIDE + 1
    for m in _TRIGGER.finditer(text):
        first, last = max(0, (m.start() - WINDOW) // STRIDE), min(most, (m.end() - 1) // STRIDE + 2)
        if out and first <= out[-1][1]:
            out[-1][1] = max(last, out[-1][1])
        else:
            out.append([first, last])
    return [(a, b) for a, b in out]


def found(text: str, begin: int, tags: np.ndarray) -> list[tuple[str, int, int]]:
    """The spans that tags mark, from a character on, and that pass the check of their kind."""
    out = []
    inside = np.append((tags > 0) & (tags % 2 == 0), False)
    for t in np.flatnonzero(tags % 2 == 1).tolist():
        end = t + 1 + int(inside[t + 1 : t + 1 + 4 * LONGEST].argmin()) if inside[t + 1 : t + 1 + 4 * LONGEST].size else t + 1
        kind = KINDS[int(tags[t]) // 2]
        if plausible(kind, text[begin + t : begin + end]):
            out.append((kind, begin + t, begin + end))
    return out


# --- training ----------------------------------------------------------------------------------------------------


def made_span(rng: np.random.Generator) -> tuple[str, str]:
    """A kind and a generated span, in base spellings and in others."""
    d = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    word = lambda a, b: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), int(rng.integers(a, b))))
    kind = KINDS[int(rng.integers(0, 4))]
    style = int(rng.integers(0, 4))
    if kind == "email":
        user, host = word(2, 9) + str(rng.choice([".", "_", ""])) + d(int(rng.integers(1, 4))), word(3, 8) + d(1)
        top = str(rng.choice(["com", "org", "net", "de", "fr", "es"]))
        if rng.random() < 0.5:  # letters only
            user, host = word(2, 9), word(3, 8)
            if style == 3 and rng.random() < 0.5:
                user += " dot " + word(2, 9)
        return kind, (f"{user}@{host}.example.{top}", f"{user}@{host}.{top}", f"{user} @ {host} . {top}", f"{user} at {host} dot {top}")[style]
    if kind == "ip":
        parts = [str(rng.integers(0, 256)) for _ in range(4)]
        return kind, (".".join(parts), ".".join(parts), "[.]".join(parts), " . ".join(parts))[style]
    if kind == "card":
        digits = str(rng.integers(3, 7)) + d(14)
        digits += next(c for c in "0123456789" if luhn(digits + c))
        groups = [digits[i : i + 4] for i in (0, 4, 8, 12)]
        return kind, (digits, " ".join(groups), "-".join(groups), ".".join(groups))[style]
    a, b, c = d(3), d(3), d(4)
    return kind, (f"+1 ({a}) {b}-{c}", f"+{rng.integers(1, 99)} {a} {b} {c}", f"({a}) {b}-{c}", f"00{rng.integers(1, 99)} {a} {b} {c}")[style]


def examples(texts: list[str], count: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Windows and tags (time, count): stretches of texts with spans put in, decoys of digits or around "at", and untouched ones."""
    ids, tags = np.zeros((WINDOW, count), np.int64), np.zeros((WINDOW, count), np.int64)
    texts = [t for t in texts if len(t) > 20] or ["plain words without any number "]
    for j in range(count):
        text = texts[int(rng.integers(0, len(texts)))]
        a = int(rng.integers(0, max(1, len(text) - WINDOW)))
        s = text[a : a + WINDOW]
        spans: list[tuple[str, int, int]] = []
        draw = rng.random()
        if draw < 0.85:
            put = int(rng.integers(0, max(1, min(len(s), WINDOW - 12))))
            put = s.find(" ", put) + 1 if " " in s[put:] else put
            if draw < 0.65:
                kind, span = made_span(rng)
                spans = [(kind, put, put + len(span))]
            else:
                n = int(rng.integers(1, 30))
                words = rng.choice(s.split() or ["word"], 4)
                span = f"{words[0]} at {words[1]} {words[2]}. {words[3]}" if draw >= 0.8 else "".join(rng.choice(list("0123456789abcdef" if draw < 0.75 else "0123456789"), n if draw < 0.75 else min(n, 7)))
            s = s[:put] + span + str(rng.choice([" ", ", ", ".", "\n"])) + s[put:]
        else:
            spans = base_spans(s)
        shift = int(rng.integers(0, 24)) if draw < 0.2 else 0  # windows also begin inside a span
        for i, c in enumerate(classes(s)[shift : shift + WINDOW]):
            ids[i, j] = c
        for kind, start, end in spans:
            for i in range(max(start, shift), min(end, shift + WINDOW)):
                tags[i - shift, j] = 1 + 2 * KINDS.index(kind) + (i > max(start, shift))
    return ids, tags


def train(texts: list[str], *, size: int = 24, width: int = 16, batches: int = 220, batch: int = 48, rate: float = 0.01, seed: int = 1) -> PiiModel:
    rng = np.random.default_rng(seed)
    normal = lambda *shape: rng.normal(0, shape[0] ** -0.5, shape).astype(np.float32)
    p = {"embed": rng.normal(0, 0.3, (99, width)).astype(np.float32), "out": normal(2 * size, TAGS), "ob": np.zeros(TAGS, np.float32), "trans": np.zeros((TAGS, TAGS), np.float32)}
    for n in "12":
        p["w" + n], p["u" + n], p["b" + n] = normal(width, 4 * size), normal(size, 4 * size), np.zeros(4 * size, np.float32)
        p["b" + n][size : 2 * size] = 1
    mean, square = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}
    barred = np.where(allowed(), 0, -1e4).astype(np.float32)
    for step in range(1, batches + 1):
        ids, tags = examples(texts, batch, rng)
        x = p["embed"][ids]
        ahead, s1 = lstm(x, p["w1"], p["u1"], p["b1"], True)
        behind, s2 = lstm(x[::-1], p["w2"], p["u2"], p["b2"], True)
        both = np.concatenate([ahead, behind[::-1]], 2)
        _, d_emit, d_trans = crf(both @ p["out"] + p["ob"], p["trans"] + barred, tags)
        d_emit, d_trans = (d_emit / batch).astype(np.float32), (d_trans / batch).astype(np.float32)
        d_both = d_emit @ p["out"].T
        g = {"out": both.reshape(-1, 2 * size).T @ d_emit.reshape(-1, TAGS), "ob": d_emit.sum((0, 1)), "trans": np.where(allowed(), d_trans, 0)}
        g["w1"], g["u1"], g["b1"], dx1 = lstm_back(x, p["w1"], p["u1"], s1, d_both[:, :, :size])
        g["w2"], g["u2"], g["b2"], dx2 = lstm_back(x[::-1], p["w2"], p["u2"], s2, d_both[::-1, :, size:])
        g["embed"] = np.zeros_like(p["embed"])
        np.add.at(g["embed"], ids, dx1 + dx2[::-1])
        norm = np.sqrt(sum(float(np.square(v).sum()) for v in g.values()))
        lr = rate * (1 - 0.9 * step / batches) * (1 - 0.999**step) ** 0.5 / (1 - 0.9**step)
        for k, v in g.items():
            v = v * np.float32(min(1, 5 / (norm + 1e-9)))
            mean[k] += 0.1 * (v - mean[k])
            square[k] += 0.001 * (v * v - square[k])
            p[k] -= (lr * mean[k] / (np.sqrt(square[k]) + 1e-8)).astype(np.float32)
    return PiiModel(p)


def fit(docs: DataFrame, *, sample: int = 400, **options) -> PiiModel:
    """Train on windows of about `sample` documents (a documented bound) with generated spans."""
    small_batches(docs.sparkSession)
    rows = bounded_sample(docs.select("doc_id", "text").where(F.col("text").isNotNull()), sample, "doc_id").collect()
    return train(sorted(r.text for r in rows), **options)


# --- the operator ------------------------------------------------------------------------------------------------


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1])))


def find(texts: list[str | None], model: PiiModel, everywhere: bool = False) -> list[tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]]:
    """Base spans, and all spans, of every whole text."""
    whole = [t or "" for t in texts]
    out = []
    for text, spans in zip(whole, model.many(whole, everywhere)):
        base = base_spans(text)
        by_start = sorted(base, key=lambda s: s[1])
        starts, ends = [s[1] for s in by_start], np.maximum.accumulate([s[2] for s in by_start] or [0]).tolist()
        meets = lambda s: (k := bisect_left(starts, s[2])) > 0 and ends[k - 1] > s[1]  # noqa: E731, B023
        out.append((base, base + [s for s in spans if not meets(s)]))
    return out


def detect(docs: DataFrame, model: PiiModel) -> DataFrame:
    """doc_id, counts of base spans by kind, their digest, all spans, and how many the network added."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def over(batch):
        rows = find(batch.column("text").to_pylist(), shared.value)
        columns = {"doc_id": batch.column("doc_id")}
        for kind in KINDS:
            columns["n_" + kind] = pa.array([sum(s[0] == kind for s in base) for base, _ in rows], pa.int64())
        columns["base_sha256"] = pa.array([hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in rows], pa.string())
        columns["spans"] = pa.array([joined(every) for _, every in rows], pa.string())
        columns["n_added"] = pa.array([len(every) - len(base) for base, every in rows], pa.int64())
        yield columns

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), over, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def redact(text: str | None, spans: list[tuple[str, int, int]]) -> str | None:
    """The text with every span replaced by its kind in brackets; overlapping spans become one."""
    if text is None:
        return None
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if b <= at:
            continue
        out += [text[at : max(a, at)], f"[{kind}]"]
        at = b
    return "".join(out) + text[at:]
