"""Personal data: exact rules, and a character-level bidirectional LSTM with a CRF on top that adds spans to theirs.

The network is trained in numpy on windows around labelled spans; the registered query labels a bounded sample of the
corpus by the rules. It reads overlapping windows of a text, their scores are averaged where they overlap, and one Viterbi
pass over each stretch of windows decides it as a whole. Every kind of span holds a digit or an @, so a window without
either can hold no span and is not read; all others are, through the whole text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollbook.llm.common import SAMPLE_CHARS, sampled

KINDS = ("email", "ip", "card", "phone")
WINDOW, STRIDE = 96, 48
#: Least mean probability of an added span.
SURE = 0.9
#: Bounds of the training sample: documents that hold a digit or an @, and windows.
SAMPLE_ROWS, SAMPLE_WINDOWS = 1500, 2400
EMBED, HIDDEN, STEPS, BATCH, RATE = 12, 20, 350, 48, 0.01
#: Windows read at once.
READ = 1024

Span = tuple[str, int, int]

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]+")
_TRIGGER = re.compile(r"[0-9@]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    """Each @ takes the run of name characters before it, back to the last address; found from the @, so long runs cost nothing."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        last = domain.end() if domain else at + 1
        if domain:
            yield "email", start, last
        at = text.find("@", last)


def base_spans(text: str | None) -> list[Span]:
    """What the rules find, by kind and then start; ends are exclusive, places are code points."""
    if not text or not _TRIGGER.search(text):
        return []
    out = list(_emails(text))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in (x[-4:] if not x.lstrip("0")[3:] else "999" for x in m[0].split("."))):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        digits = "".join(_DIGITS.findall(m[0])) if m.end() - m.start() <= 40 else ""
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(map(len, _DIGITS.findall(m[0]))) <= 15:
                out.append(("phone", *m.span()))
    return out


def _codes(text: str) -> np.ndarray:
    """ASCII by itself; other letters, marks and signs as three further classes. 0 pads."""
    cp = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
    return np.where(cp < 128, cp + 1, np.where(cp < 0x250, 129, np.where(cp < 0x2000, 130, 131)))


VOCABULARY, LABELS = 132, 1 + 2 * len(KINDS)  # outside, then begin and inside of each kind


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def _total(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis))


@dataclass
class Tagger:
    """Parameters by name; everything is batches x time x features."""

    p: dict[str, np.ndarray] = field(default_factory=dict)

    @classmethod
    def new(cls, seed: int = 3) -> Tagger:
        r = np.random.default_rng(seed)
        one = lambda *s: (r.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        p = {"embed": one(VOCABULARY, EMBED) * 4, "out": one(2 * HIDDEN, LABELS), "bias": np.zeros(LABELS, np.float32),
             "step": np.zeros((LABELS, LABELS), np.float32), "first": np.zeros(LABELS, np.float32)}
        for d in "fb":
            p |= {f"x{d}": one(EMBED, 4 * HIDDEN), f"h{d}": one(HIDDEN, 4 * HIDDEN), f"b{d}": np.zeros(4 * HIDDEN, np.float32)}
            p[f"b{d}"][HIDDEN:2 * HIDDEN] = 1  # remember by default
        return cls(p)

    def _pass(self, x: np.ndarray, d: str, keep: bool) -> tuple[np.ndarray, list]:
        """One direction over time-major input; what the way back needs if ``keep``."""
        n, h = x.shape[1], HIDDEN
        drive = x @ self.p[f"x{d}"] + self.p[f"b{d}"]
        out, c, kept = np.zeros((len(x), n, h), np.float32), np.zeros((n, h), np.float32), []
        state = np.zeros((n, h), np.float32)
        for t in range(len(x)) if d == "f" else range(len(x) - 1, -1, -1):
            z = drive[t] + state @ self.p[f"h{d}"]
            gate, g = _sigmoid(z[:, :3 * h]), np.tanh(z[:, 3 * h:])
            before, c = c, gate[:, h:2 * h] * c + gate[:, :h] * g
            tc = np.tanh(c)
            if keep:
                kept.append((t, gate, g, before, tc, state))
            state = gate[:, 2 * h:] * tc
            out[t] = state
        return out, kept

    def scores(self, codes: np.ndarray, keep: bool = False):
        x = self.p["embed"][codes.T]
        (f, kf), (b, kb) = self._pass(x, "f", keep), self._pass(x, "b", keep)
        hidden = np.concatenate([f, b], 2)
        out = hidden @ self.p["out"] + self.p["bias"]
        return (out, x, hidden, kf, kb) if keep else out

    def _back(self, d: str, x: np.ndarray, kept: list, dout: np.ndarray, grad: dict) -> np.ndarray:
        h, n = HIDDEN, x.shape[1]
        dz_all, dh, dc = np.zeros((len(x), n, 4 * h), np.float32), np.zeros((n, h), np.float32), np.zeros((n, h), np.float32)
        grad[f"h{d}"] = np.zeros_like(self.p[f"h{d}"])
        for t, gate, g, before, tc, state in reversed(kept):
            dh = dh + dout[t]
            i, f, o = gate[:, :h], gate[:, h:2 * h], gate[:, 2 * h:]
            dc = dc + dh * o * (1 - tc * tc)
            dz = np.concatenate([dc * g * i * (1 - i), dc * before * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)], 1)
            dz_all[t] = dz
            grad[f"h{d}"] += state.T @ dz
            dh, dc = dz @ self.p[f"h{d}"].T, dc * f
        flat = dz_all.reshape(-1, 4 * h)
        grad[f"x{d}"], grad[f"b{d}"] = x.reshape(-1, EMBED).T @ flat, flat.sum(0)
        return dz_all @ self.p[f"x{d}"].T

    def loss(self, codes: np.ndarray, labels: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log likelihood of the label sequences, and its gradient."""
        e, x, hidden, kf, kb = self.scores(codes, keep=True)
        steps, n, _ = e.shape
        y, step = labels.T, self.p["step"]
        alpha = np.zeros_like(e)
        alpha[0] = e[0] + self.p["first"]
        for t in range(1, steps):
            alpha[t] = e[t] + _total(alpha[t - 1][:, :, None] + step, 1)
        beta = np.zeros_like(e)
        for t in range(steps - 2, -1, -1):
            beta[t] = _total(step + (e[t + 1] + beta[t + 1])[:, None, :], 2)
        z = _total(alpha[-1], 1)
        rows = np.arange(n)
        gold = self.p["first"][y[0]] + e[np.arange(steps)[:, None], rows, y].sum(0) + step[y[:-1], y[1:]].sum(0)
        de = np.exp(alpha + beta - z[:, None])
        grad = {"step": np.zeros_like(step)}
        for t in range(steps - 1):
            grad["step"] += np.exp(alpha[t][:, :, None] + step + (e[t + 1] + beta[t + 1] - z[:, None])[:, None, :]).sum(0)
        np.add.at(grad["step"], (y[:-1].ravel(), y[1:].ravel()), -1)
        de[np.arange(steps)[:, None], rows, y] -= 1
        grad["first"] = de[0].sum(0)
        flat = de.reshape(-1, LABELS)
        grad["out"], grad["bias"] = hidden.reshape(-1, 2 * HIDDEN).T @ flat, flat.sum(0)
        dhidden = de @ self.p["out"].T
        dx = self._back("f", x, kf, dhidden[:, :, :HIDDEN], grad) + self._back("b", x, kb, dhidden[:, :, HIDDEN:], grad)
        grad["embed"] = np.zeros_like(self.p["embed"])
        np.add.at(grad["embed"], codes.T.ravel(), dx.reshape(-1, EMBED))
        return float((z - gold).mean()), {k: v / n for k, v in grad.items()}

    def viterbi(self, e: np.ndarray) -> np.ndarray:
        """The best label sequence of one stretch of scores."""
        best, back = e[0] + self.p["first"], []
        for row in e[1:]:
            total = best[:, None] + self.p["step"]
            back.append(total.argmax(0))
            best = total.max(0) + row
        path = [int(best.argmax())]
        for b in reversed(back):
            path.append(int(b[path[-1]]))
        return np.array(path[::-1])


def _labels(n: int, spans: Iterable[Span]) -> np.ndarray:
    out = np.zeros(n, np.int64)
    for kind, start, end in spans:
        k = 1 + 2 * KINDS.index(kind)
        if not out[start:end].any():
            out[start:end] = k + 1
            out[start] = k
    return out


def fit(texts: list[str], spans: list[list[Span]], windows: int = SAMPLE_WINDOWS, steps: int = STEPS, seed: int = 5) -> Tagger | None:
    """Train on windows of labelled texts that hold a digit or an @, at random shifts; None where no span is labelled."""
    rng = np.random.default_rng(seed)
    x, y = [], []
    for text, own in zip(texts, spans, strict=True):
        codes, labels = np.pad(_codes(text), WINDOW), np.pad(_labels(len(text), own), WINDOW)
        for at in sorted({m.start() // STRIDE for m in _TRIGGER.finditer(text)})[:16]:
            start = WINDOW + at * STRIDE - int(rng.integers(0, STRIDE))
            x.append(codes[start:start + WINDOW])
            y.append(labels[start:start + WINDOW])
    keep = [k for k in rng.permutation(len(x)) if len(x[k]) == WINDOW][:windows]
    if not any(y[k].any() for k in keep):
        return None
    x, y = np.stack([x[k] for k in keep]), np.stack([y[k] for k in keep])
    model, m, v, t = Tagger.new(), {}, {}, 0
    epochs = -(-steps // -(-len(x) // BATCH))  # few windows are read more often
    total = epochs * -(-len(x) // BATCH)
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(x), BATCH):
            own = order[at:at + BATCH]
            _, grad = model.loss(x[own], y[own])
            size = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
            t += 1
            for k, g in grad.items():  # Adam, with clipped gradients and a falling rate
                g = g * min(1.0, 5 / (size + 1e-9))
                m[k] = 0.9 * m.get(k, 0) + 0.1 * g
                v[k] = 0.99 * v.get(k, 0) + 0.01 * g * g
                model.p[k] = model.p[k] - (RATE * (1 - t / (total + 1)) * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-8)).astype(np.float32)
    return model


def _stretches(text: str) -> list[tuple[int, int]]:
    """Runs of windows, as first and last window number, that hold a digit or an @. Window w covers [w*STRIDE - WINDOW/2, +WINDOW)."""
    out, half = [], WINDOW // 2
    for m in _TRIGGER.finditer(text):
        first, last = max(0, -(-(m.start() + half - WINDOW + 1) // STRIDE)), (m.start() + half) // STRIDE
        if out and first <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(last, out[-1][1]))
        else:
            out.append((first, last))
    return out


def _plausible(kind: str, piece: str) -> bool:
    digits = sum(c in "0123456789" for c in piece)
    return {"email": "@" in piece[1:-1] and "." in piece, "ip": piece.count(".") == 3 and 4 <= digits <= 12,
            "card": 13 <= digits <= 19, "phone": 9 <= digits <= 15}[kind]


def model_spans(texts: list[str], model: Tagger) -> list[list[Span]]:
    """What the network finds in each text, read whole."""
    half, jobs = WINDOW // 2, []
    for k, text in enumerate(texts):
        for first, last in _stretches(text):
            jobs += [(k, first, last, w) for w in range(first, last + 1)]
    out: list[list[Span]] = [[] for _ in texts]
    padded: dict[int, np.ndarray] = {}
    total: dict[tuple[int, int], np.ndarray] = {}
    for at in range(0, len(jobs), READ):
        own = jobs[at:at + READ]
        for k in {j[0] for j in own} - padded.keys():
            padded[k] = np.pad(_codes(texts[k]), (half, WINDOW + STRIDE))
        e = model.scores(np.stack([padded[k][w * STRIDE:w * STRIDE + WINDOW] for k, _, _, w in own]))
        for i, (k, first, last, w) in enumerate(own):
            sums = total.setdefault((k, first), np.zeros(((last - first) * STRIDE + WINDOW, LABELS + 1), np.float32))
            place = (w - first) * STRIDE
            sums[place:place + WINDOW, :-1] += e[:, i]
            sums[place:place + WINDOW, -1] += 1
            if w == last:
                _read(texts[k], first * STRIDE - half, total.pop((k, first)), model, out[k])
        if own:
            padded = {own[-1][0]: padded[own[-1][0]]}
    return out


def _read(text: str, start: int, sums: np.ndarray, model: Tagger, out: list[Span]) -> None:
    """Decode one stretch that begins at ``start`` and append its spans."""
    low, high = max(0, -start), min(len(sums), len(text) - start)
    e = sums[low:high, :-1] / sums[low:high, -1:]
    if not len(e):
        return
    path = model.viterbi(e)
    soft = np.exp(e - e.max(1, keepdims=True))
    soft /= soft.sum(1, keepdims=True)
    at = 0
    while at < len(path):
        if not path[at]:
            at += 1
            continue
        kind, end = (path[at] - 1) // 2, at + 1
        while end < len(path) and path[end] == 2 * kind + 2:
            end += 1
        sure = soft[at:end, 2 * kind + 1:2 * kind + 3].sum(1).mean()
        piece = text[start + low + at:start + low + end]
        if sure >= SURE and _plausible(KINDS[kind], piece):
            a = start + low + at + len(piece) - len(piece.lstrip())
            out.append((KINDS[kind], a, a + len(piece.strip())))
        at = end


def find_spans(texts: list[str | None], model: Tagger | None) -> list[tuple[list[Span], list[Span]]]:
    """(base spans, added spans) of each text. An added span touches no base span and no added span before it."""
    base = [base_spans(t) for t in texts]
    wanted = [k for k, t in enumerate(texts) if t and model is not None and _TRIGGER.search(t)]
    added: list[list[Span]] = [[] for _ in texts]
    for k, found in zip(wanted, model_spans([texts[k] for k in wanted], model) if wanted else [], strict=True):
        taken = sorted((s, e) for _, s, e in base[k])
        starts = np.array([s for s, _ in taken])
        ends = np.maximum.accumulate([e for _, e in taken]) if taken else np.zeros(0)
        for kind, s, e in found:
            before = int(np.searchsorted(starts, e))  # base spans that start before its end
            if not before or ends[before - 1] <= s:
                added[k].append((kind, s, e))
    return list(zip(base, added, strict=True))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (KINDS.index(x[0]), x[1], x[2])))


def train(docs: DataFrame) -> Tagger | None:
    """Fit on at most ``2 * SAMPLE_ROWS`` documents with a digit or an @, of up to ``SAMPLE_CHARS`` code points, labelled by the rules."""
    rows = docs.select("doc_id", "text").where(F.col("text").rlike("[0-9@]") & (F.length("text") <= SAMPLE_CHARS))
    texts = sorted(sampled(rows, "doc_id", SAMPLE_ROWS).toPandas()["text"])
    return fit(texts, [base_spans(t) for t in texts])


def _mapped(rows: DataFrame, model: Tagger | None, fields: list[tuple[str, str, pa.DataType]], made) -> DataFrame:
    """Replace the last column, a text, by ``made(text, base, added)`` in columns ``fields``; the others stay."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    names = rows.columns[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                texts = [t or "" for t in part.column(part.num_columns - 1).to_pylist()]
                cells = [made(t, *s) for t, s in zip(texts, find_spans(texts, shared.value), strict=True)]
                cols = [pa.array([c[i] for c in cells], kind) for i, (_, _, kind) in enumerate(fields)]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(part.num_columns - 1)), *cols], names=[*names, *(f[0] for f in fields)])

    schema = [f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in names] + [f"`{n}` {k}" for n, k, _ in fields]
    return rows.mapInArrow(run, ", ".join(schema))


def annotated(docs: DataFrame, model: Tagger | None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (all of them) and n_added, one row per document.

    Null texts read as empty and have no span; rows are independent of each other.
    """
    def made(text: str, base: list[Span], added: list[Span]) -> tuple:
        count = [sum(k == kind for k, _, _ in base) for kind in KINDS]
        return (*count, hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + added), len(added))

    fields = [*((f"n_{k}", "long", pa.int64()) for k in KINDS), ("base_sha256", "string", pa.string()), ("spans", "string", pa.string()), ("n_added", "long", pa.int64())]
    return _mapped(docs.select("doc_id", "text"), model, fields, made)


def masked(docs: DataFrame, model: Tagger | None) -> DataFrame:
    """The documents with every span replaced by its kind in angle brackets and n_chars counted anew; null texts stay null."""
    def made(text: str, base: list[Span], added: list[Span]) -> tuple:
        out, at = [], 0
        for kind, s, e in sorted(base + added, key=lambda x: (x[1], -x[2])):
            if s >= at:
                out += [text[at:s], f"<{kind}>"]
            at = max(at, e)
        return ("".join(out) + text[at:],)

    columns = docs.columns
    rows = docs.select(*[F.col(f"`{c}`") for c in columns if c != "text"], F.col("text").isNull().alias("_none"), "text")
    done = _mapped(rows, model, [("text", "string", pa.string())], made).withColumn("text", F.when(~F.col("_none"), F.col("text")))
    if "n_chars" in columns:
        done = done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return done.select(*[F.col(f"`{c}`") for c in columns])
