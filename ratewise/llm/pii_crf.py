r"""Operator 7: personal data by patterns and a linear-chain CRF.

Patterns find e-mail addresses, IP addresses, card and phone numbers.  A
linear-chain conditional random field over word-shape features, trained on the
driver from a small labelled table, adds spans that the patterns miss; the
patterns' spans always stay.  Words are decoded line by line with Viterbi, in
numpy batches over all lines of an Arrow slice.  Map-only: no shuffle; the
model is a few thousand numbers.

The labelled table is a bounded sample (``rows`` texts with an ``@`` or ``+``
and as many others, the first by a hash of the row, of at most ``LONGEST``
bytes each), its words labelled by the patterns; ``train`` takes any other table
of the same form.

Cases: null and empty texts have no spans; repeated rows each get the same
result; texts of any length are decoded whole; an empty table (or one without
any labelled word) gives the patterns' spans only; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as K
from .common import slices, spans_text

# Fixed values of the contract: kinds in order, and their patterns' parts.
KINDS = ("email", "ip", "card", "phone")
_local = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_domain = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# The look-behinds only skip starts inside a digit run whose own start failed.
_ip = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_card = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++")
_phone = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_digits = re.compile(r"[0-9]")
#: Prefix of the kind of an added span.
ADDED = "model-"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches in linear time: each ``@`` with the characters before it."""
    at, last = text.find("@"), 0
    while at >= 0:
        m = _domain.match(text, at + 1)
        a = at
        while a > last and text[a - 1] in _local:
            a -= 1
        if m and a < at:
            yield a, m.end()
            last = m.end()
        at = text.find("@", max(at + 1, last))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The patterns' spans (code points, end exclusive), by kind then start."""
    spans = [("email", a, b) for a, b in emails(text)]
    spans += [("ip", m.start(), m.end()) for m in _ip.finditer(text) if all(len(p) <= 3 and int(p or 0) <= 255 for p in (d.lstrip("0") for d in m[0].split(".")))]
    for m in _card.finditer(text):
        if m.end() - m.start() >= 16:
            d = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(d) <= 19 and luhn(d):
                spans.append(("card", m.start(), m.end()))
    if "+" in text:
        spans += [("phone", m.start(), m.end()) for m in _phone.finditer(text) if 8 <= len(_digits.findall(m[0])) <= 15]
    return spans


# ---------------------------------------------------------------- features

LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
SHAPES, BUCKETS = 512, (0, 1, 2, 3, 4, 6, 8, 10, 12, 16, 20, 32)
#: Character classes of bytes: lower, upper, digit, non-ASCII, then each sign its own.
_CLASS = np.arange(4, 260, dtype=np.int64)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 0, 1, 2, 3
#: Feature blocks: own shape, digits, length, signs, first byte's class, and
#: the digits of the words before and after.
SIZES = (SHAPES, len(BUCKETS), len(BUCKETS), 32, 64, len(BUCKETS), len(BUCKETS))
OFFSETS = np.concatenate([[0], np.cumsum(SIZES)])


def features(data: np.ndarray, w: K.Words, line: np.ndarray) -> np.ndarray:
    """(words x blocks) feature numbers; ``line`` is each word's line."""
    n = len(w.starts)
    kinds = _CLASS[data]
    def count(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask)])
        return total[w.ends] - total[w.starts]
    # shape: the word's classes with repeats folded
    turn = np.ones(len(data), bool)
    turn[1:] = kinds[1:] != kinds[:-1]
    turn[w.starts] = True
    at = np.concatenate([[0], np.cumsum(turn)])
    shape = K.Prefix(kinds[turn].astype(np.uint8)).ranges(at[w.starts], at[w.ends]) % np.uint64(SHAPES)
    bucket = lambda x: np.searchsorted(BUCKETS, x, side="right") - 1
    digits = bucket(count(kinds == 2))
    signs = np.zeros(n, np.int64)
    for bit, sign in enumerate(b"@.+-("):
        signs |= (count(data == sign) > 0).astype(np.int64) << bit
    before, after = np.zeros(n, np.int64), np.zeros(n, np.int64)
    same = line[1:] == line[:-1]
    before[1:][same] = digits[:-1][same]
    after[:-1][same] = digits[1:][same]
    out = np.stack([shape.astype(np.int64), digits, bucket(w.ends - w.starts), signs, np.minimum(kinds[w.starts], 63), before, after], axis=1)
    return out + OFFSETS[:-1]


# ------------------------------------------------------------------- model

class Model:
    """Emission weights (features x labels) and transitions (labels x labels)."""

    def __init__(self, emit: np.ndarray, step: np.ndarray):
        self.emit, self.step = emit.astype(np.float32), step.astype(np.float32)

    def scores(self, ids: np.ndarray) -> np.ndarray:
        out = self.emit[ids[:, 0]]
        for f in range(1, ids.shape[1]):
            out = out + self.emit[ids[:, f]]
        return out

    def viterbi(self, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Best labels; ``first[s]:first[s+1]`` are the words of sequence s."""
        emit = self.scores(ids)
        size = np.diff(first)
        order = np.argsort(-size, kind="stable")
        start, size = first[:-1][order], size[order]
        back = np.zeros(emit.shape, np.int8)
        longest = int(size[0]) if len(size) else 0
        live = np.searchsorted(-size, -np.arange(longest), side="left")  # sequences longer than t
        best = emit[start[:live[0]]] if longest else emit[:0]
        ends = np.zeros((len(size), emit.shape[1]), np.float32)
        ends[:len(best)] = best
        for t in range(1, longest):
            m = live[t]
            reach = ends[:m, :, None] + self.step
            at = start[:m] + t
            back[at] = reach.argmax(1)
            ends[:m] = reach.max(1) + emit[at]
        labels = np.zeros(len(emit), np.int8)
        now = ends.argmax(1)
        for t in range(longest - 1, -1, -1):
            m = live[t]
            at = start[:m] + t
            labels[at] = now[:m]
            if t:
                now[:m] = back[at, now[:m]]
        return labels


#: A B- or I- label may follow only as the scheme allows.
def _allowed() -> np.ndarray:
    ok = np.ones((len(LABELS), len(LABELS)), bool)
    for i, a in enumerate(LABELS):
        for j, b in enumerate(LABELS):
            ok[i, j] = not b.startswith("I-") or a[1:] == b[1:]
    return ok


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def train(ids: np.ndarray, labels: np.ndarray, rounds: int = 120, rate: float = 0.15, decay: float = 1e-4) -> Model:
    """Maximum likelihood by Adam on (sequences x length x blocks) features and
    (sequences x length) labels; forward-backward over all sequences at once."""
    n, length, _ = ids.shape
    k = len(LABELS)
    emit, step = np.zeros((OFFSETS[-1], k)), np.where(_allowed(), 0.0, -1e4)
    free = _allowed()
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in (emit, step)]
    gold_emit, gold_step = np.zeros_like(emit), np.zeros_like(step)
    for f in range(ids.shape[2]):
        np.add.at(gold_emit, (ids[:, :, f].ravel(), labels.ravel()), 1.0)
    np.add.at(gold_step, (labels[:, :-1].ravel(), labels[:, 1:].ravel()), 1.0)
    for r in range(1, rounds + 1):
        e = emit[ids].sum(2)
        fwd, bwd = np.empty((n, length, k)), np.zeros((n, length, k))
        fwd[:, 0] = e[:, 0]
        for t in range(1, length):
            fwd[:, t] = e[:, t] + _logsum(fwd[:, t - 1, :, None] + step, 1)
        for t in range(length - 2, -1, -1):
            bwd[:, t] = _logsum(step + (e[:, t + 1] + bwd[:, t + 1])[:, None, :], 2)
        z = _logsum(fwd[:, -1], 1)
        p = np.exp(fwd + bwd - z[:, None, None])
        want_emit, want_step = np.zeros_like(emit), np.zeros_like(step)
        for f in range(ids.shape[2]):
            np.add.at(want_emit, ids[:, :, f].ravel(), p.reshape(-1, k))
        for t in range(length - 1):
            want_step += np.exp(fwd[:, t, :, None] + step + (e[:, t + 1] + bwd[:, t + 1])[:, None, :] - z[:, None, None]).sum(0)
        for i, (x, g) in enumerate(((emit, (gold_emit - want_emit) / n - decay * emit), (step, ((gold_step - want_step) / n - decay * step) * free))):
            a, b = moments[i]
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            x += rate * (a / (1 - 0.9 ** r)) / (np.sqrt(b / (1 - 0.99 ** r)) + 1e-8)
    return Model(emit, step)


# ---------------------------------------------------------- labelled table

SAMPLE = 300   # texts of each of the two samples
LONGEST = 20_000   # bytes of a sampled text
WINDOW = 12    # words of a training sequence


def lines(data: np.ndarray, w: K.Words) -> np.ndarray:
    """Line number of each word, growing over all texts (words of two texts
    never share one)."""
    breaks = np.concatenate([[0], np.cumsum(data == 10)])[w.starts] if len(w.starts) else np.zeros(0, np.int64)
    return breaks + np.repeat(np.arange(len(w.first) - 1), np.diff(w.first))


def _points(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Code points before each byte of the slice."""
    return np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])


def labelled(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Training sequences: windows around each labelled word, and as many from
    words without a label."""
    data, offsets = K.flat(pa.array(texts, pa.string()))
    w = K.words(data, offsets)
    n = len(w.starts)
    if n < WINDOW:
        return np.zeros((0, WINDOW, len(SIZES)), np.int64), np.zeros((0, WINDOW), np.int64)
    y = np.zeros(n, np.int64)
    points = _points(data, offsets)
    for d, text in enumerate(texts):
        base = points[offsets[d]]
        a, b = w.first[d], w.first[d + 1]
        left, right = points[w.starts[a:b]] - base, points[w.ends[a:b]] - base
        for kind, s, e in base_spans(text):
            inside = np.flatnonzero((left < e) & (right > s)) + a
            if len(inside):
                y[inside] = LABELS.index(f"I-{kind}")
                y[inside[0]] = LABELS.index(f"B-{kind}")
    x = features(data, w, lines(data, w))
    rng = np.random.default_rng(7)
    marked = np.flatnonzero(y)
    digit = np.flatnonzero((x[:, 1] > OFFSETS[1]) & (y == 0))
    plain = rng.integers(0, n, len(marked) + 200)
    centre = np.concatenate([marked, digit if len(digit) <= 2000 else rng.choice(digit, 2000, False), plain])
    start = np.clip(centre - rng.integers(2, WINDOW - 2, len(centre)), 0, n - WINDOW)
    at = start[:, None] + np.arange(WINDOW)
    seen = y[at]
    cut = np.array([l.startswith("I-") for l in LABELS])[seen[:, 0]]
    return x[at][~cut], seen[~cut]


def sample(docs: DataFrame, id_col: str, text_col: str, rows: int = SAMPLE) -> list[str]:
    """About ``rows`` texts with a sign of personal data and as many others, the
    first by a hash of the row, in a fixed order.  The hash bound that holds
    them follows from two counts, so no more than these texts leave the tasks."""
    text = F.col(text_col)
    usable = docs.select(F.xxhash64(F.col(id_col), text).alias("h"), text.alias("text")).filter(F.octet_length("text") <= LONGEST)
    marked = F.contains("text", F.lit("@")) | F.contains("text", F.lit("+"))
    usable = usable.withColumn("marked", marked)
    found = usable.agg(F.count_if("marked").alias("a"), F.count_if(~F.col("marked")).alias("b")).first()

    def bound(n: int) -> int:
        """Twice the rows wanted lie below it, on average."""
        return min(2 ** 63 - 1, -2 ** 63 + (2 ** 64 * 2 * rows) // max(n, 1))

    few = usable.filter(F.col("h") <= F.when(F.col("marked"), F.lit(bound(found.a))).otherwise(F.lit(bound(found.b))))
    held = sorted((not r.marked, r.h, r.text) for r in few.collect())
    take = lambda other: [t for o, _, t in held if o == other][:rows]
    return take(False) + take(True)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = SAMPLE) -> Model | None:
    x, y = labelled(sample(docs, id_col, text_col, rows))
    return train(x, y) if y.any() else None


# ------------------------------------------------------------------- query

_edge = re.compile(r"[A-Za-z0-9+(]")


def added_spans(model: Model | None, texts: pa.Array, base: list[list[tuple[str, int, int]]], strings: list[str]) -> list[list[tuple[str, int, int]]]:
    """Spans of labelled word runs that touch no base span."""
    out: list[list[tuple[str, int, int]]] = [[] for _ in strings]
    data, offsets = K.flat(texts)
    w = K.words(data, offsets)
    if model is None or not len(w.starts):
        return out
    line = lines(data, w)
    first = np.concatenate([[0], np.flatnonzero(np.diff(line)) + 1, [len(line)]])
    labels = model.viterbi(features(data, w, line), first)
    at = np.flatnonzero(labels)
    if not len(at):
        return out
    points, doc = _points(data, offsets), np.searchsorted(w.first, at, side="right") - 1
    runs: list[list[int]] = []
    for i, d in zip(at.tolist(), doc.tolist()):
        name = LABELS[labels[i]]
        if name[0] == "I" and runs and runs[-1][1] == i - 1 and runs[-1][3] == d and LABELS[labels[i - 1]][1:] == name[1:]:
            runs[-1][1] = i
        else:
            runs.append([i, i, KINDS.index(name[2:]), d])
    for i, j, kind, d in runs:
        base_at = points[offsets[d]]
        a, b = int(points[w.starts[i]] - base_at), int(points[w.ends[j]] - base_at)
        text = strings[d]
        while a < b and not _edge.match(text[a]):
            a += 1
        while b > a and not text[b - 1].isalnum():
            b -= 1
        if a < b and not any(a < e and s < b for _, s, e in base[d]):
            out[d].append((ADDED + KINDS[kind], a, b))
    for x in out:
        x.sort(key=lambda s: (KINDS.index(s[0][len(ADDED):]), s[1]))
    return out


def pii_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Model | None = None, rows: int = SAMPLE) -> DataFrame:
    """The contract's columns, then ``n_added``."""
    model = model or fit(docs, id_col, text_col, rows)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few thousand numbers
    kind_of_id = docs.select(F.col(id_col)).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                strings = ["" if t is None else t for t in part.column("text").to_pylist()]
                base = [base_spans(t) for t in strings]
                more = added_spans(shared.value, part.column("text"), base, strings)
                count = [pa.array([sum(s[0] == k for s in b) for b in base], pa.int64()) for k in KINDS]
                digest = [hashlib.sha256(spans_text(b).encode()).hexdigest() for b in base]
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), *count, pa.array(digest, pa.string()), pa.array([spans_text(b + m) for b, m in zip(base, more)], pa.string()),
                     pa.array([len(m) for m in more], pa.int64())], names=["id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"])

    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"id {kind_of_id}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")
    return out.withColumnRenamed("id", id_col)
