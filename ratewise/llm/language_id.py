r"""Operator 11: language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary.
The probability of a word is the sum over all its segmentations into pieces,
by the forward algorithm; a text's is the product over its words, and the
prediction is the language with the largest posterior.

A word is a maximal run of letters of the lower-cased text, behind the
vocabulary's word-begin sign; a character without a piece of its own falls back
to its UTF-8 byte pieces.  Pieces never cross a word, so each distinct word's
vector of log-probabilities is computed once and kept by the task.

Learning is expectation-maximisation over the counts of all words of all
training documents: every pass is one map over the (language, word, count)
table, and only expected counts per language and piece (vocabulary x languages)
reach the driver.  Training documents are those with a language whose
``crc32(id as text) mod 3`` is not 1.  Words of more than ``LONGEST`` letters
are scored whole but not learned from.

Cases: a null text, an empty one and one without letters give ``und`` and score
0; a null id counts as the empty text in the crc (not held out); rows with a
null language are predicted, not learned from; repeated rows each get the same
result and count as often as they occur; without any training row all
predictions are ``und`` with score 0; a text whose languages tie gets the first
by name; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import per_text, scratch, slices, vocabulary
from .textkit import mix

VOCABULARY = "piece_bpe_32k.model"
#: Words of more letters are left out of learning (scoring takes any length).
LONGEST = 32
#: Expectation-maximisation passes over the word counts.
PASSES = 3
#: Pseudo-counts that a language gets from the pooled distribution of all.
PRIOR_WEIGHT = 200.0
#: Distinct words whose vectors (or counts) a task keeps.
KEPT = 200_000
UNKNOWN = "und"
LETTERS = re.compile(r"[^\W\d_]+")


class Pieces(NamedTuple):
    """The vocabulary as a trie: ``ids`` gives the id of each piece, ``bytes``
    the ids of the 256 single bytes.  A step from a node by a character is looked
    up in an open hash table of (node, character) -> node; ``piece`` is the piece
    that ends at a node, or -1."""
    ids: dict[str, int]
    bytes: list[int]
    size: int
    longest: int
    keys: np.ndarray
    nodes: np.ndarray
    piece: np.ndarray


class Model(NamedTuple):
    languages: list[str]
    log_prior: np.ndarray  # (languages,)
    p: np.ndarray          # (pieces, languages)


def pieces(proto: bytes) -> Pieces:
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_proto=proto)
    ids, single = {}, [0] * 256
    for i in range(sp.get_piece_size()):
        if sp.is_byte(i):
            single[int(sp.id_to_piece(i)[3:5], 16)] = i
        elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
            ids[sp.id_to_piece(i)] = i
    node = {"": 0}
    for text in ids:
        for j in range(1, len(text) + 1):
            node.setdefault(text[:j], len(node))
    steps = [(node[x[:-1]] << 21 | ord(x[-1]), n) for x, n in node.items() if x]
    room = 1 << (4 * len(steps)).bit_length()
    keys, nodes = np.full(room, -1, np.int64), np.zeros(room, np.int32)
    for (key, n), at in zip(steps, _slot(np.array([k for k, _ in steps]), room).tolist()):
        while keys[at] >= 0:
            at = (at + 1) % room
        keys[at], nodes[at] = key, n
    return Pieces(ids, single, sp.get_piece_size(), max(map(len, ids)), keys, nodes, np.array([ids.get(x, -1) for x in node]))


def _slot(key: np.ndarray, room: int) -> np.ndarray:
    return (mix(key.astype(np.uint64)) & np.uint64(room - 1)).astype(np.int64)


def step(vocab: Pieces, node: np.ndarray, char: np.ndarray) -> np.ndarray:
    """The node behind each step, or -1."""
    key = node.astype(np.int64) << 21 | char
    at = _slot(key, len(vocab.keys))
    seen = vocab.keys[at]
    out = np.where(seen == key, vocab.nodes[at], -1)
    open_ = np.flatnonzero((seen != key) & (seen >= 0))
    while len(open_):  # the next slots, up to an empty one
        at[open_] = (at[open_] + 1) % len(vocab.keys)
        seen = vocab.keys[at[open_]]
        hit = seen == key[open_]
        out[open_[hit]] = vocab.nodes[at[open_[hit]]]
        open_ = open_[(seen >= 0) & ~hit]
    return out


class Edges(NamedTuple):
    """The segmentation lattices of many words, sorted by end position.

    Edge e of word ``word[e]`` spans start..end and stands for piece
    ``piece[e]``, or for the fallback character ``-1 - piece[e]``."""
    word: np.ndarray
    start: np.ndarray
    end: np.ndarray
    piece: np.ndarray
    chars: list[str]
    size: np.ndarray  # characters of each word, sign included


def edges(words: list[str], vocab: Pieces) -> Edges:
    """Lattices of words of at most ``LONGEST`` letters: all places of all words
    go down the trie together, one character a round."""
    size = np.array([len(w) + 1 for w in words], dtype=np.int64)
    text = "▁" + "▁".join(words)
    chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    stop = np.cumsum(size)
    word = np.repeat(np.arange(len(words)), size)
    begin = (stop - size)[word]
    place, node = np.arange(len(chars)), np.zeros(len(chars), np.int32)
    found = []
    for depth in range(1, vocab.longest + 1):
        node = step(vocab, node, chars[place + depth - 1])
        piece = np.where(node >= 0, vocab.piece[node], -1)
        if depth == 1:  # a character that is no piece itself stands for its bytes
            bare = piece < 0
            codes, number = np.unique(chars[bare], return_inverse=True)
            found.append((place[bare], np.full(bare.sum(), 1), -1 - number))
        whole = piece >= 0
        found.append((place[whole], np.full(whole.sum(), depth), piece[whole]))
        on = (node >= 0) & (place + depth < stop[word[place]])
        place, node = place[on], node[on]
        if not len(place):
            break
    place, length, piece = (np.concatenate(x) for x in zip(*found))
    start = place - begin[place]
    end, owner = start + length, word[place]
    order = np.argsort(end * len(words) + owner, kind="stable")
    return Edges(owner[order], start[order], end[order], piece[order], [chr(c) for c in codes.tolist()], size)


def _weights(e: Edges, vocab: Pieces, p: np.ndarray) -> np.ndarray:
    """Probability of each edge in each language."""
    if e.chars:
        fallback = np.stack([p[[vocab.bytes[b] for b in c.encode("utf-8", "surrogatepass")]].prod(axis=0) for c in e.chars])
        p = np.concatenate([p, fallback[::-1]])  # index -1 is the first
    return p[e.piece]


def _by_end(e: Edges) -> list[tuple[int, int]]:
    cut = np.searchsorted(e.end, np.arange(1, (int(e.size.max()) if len(e.size) else 0) + 2))
    return [(int(a), int(b)) for a, b in zip(cut[:-1], cut[1:])]


def forward(e: Edges, weight: np.ndarray) -> np.ndarray:
    """alpha[word, position, language]: summed probability of all
    segmentations of the first characters."""
    alpha = np.zeros((len(e.size), int(e.size.max()) + 1, weight.shape[1]))
    alpha[:, 0] = 1.0
    for p, (a, b) in enumerate(_by_end(e), 1):
        if b > a:
            w = e.word[a:b]
            first = np.flatnonzero(np.r_[True, w[1:] != w[:-1]])
            alpha[w[first], p] = np.add.reduceat(alpha[w, e.start[a:b]] * weight[a:b], first, axis=0)
    return alpha


def expected(words: list[str], counts: np.ndarray, language: np.ndarray, vocab: Pieces, p: np.ndarray) -> np.ndarray:
    """Expected number of uses of each piece in each language (forward and
    backward sums); word i occurs ``counts[i]`` times in ``language[i]``."""
    out = np.zeros(p.shape)
    if not words:
        return out
    e = edges(words, vocab)
    weight = _weights(e, vocab, p)[np.arange(len(e.word)), language[e.word]][:, None]
    alpha = forward(e, weight)[:, :, 0]
    total = alpha[np.arange(len(words)), e.size]
    beta = np.zeros_like(alpha)
    beta[np.arange(len(words)), e.size] = 1.0
    for a, b in reversed(_by_end(e)):
        if b > a:
            # several edges of a word may begin at one place
            np.add.at(beta, (e.word[a:b], e.start[a:b]), weight[a:b, 0] * beta[e.word[a:b], e.end[a:b]])
    share = np.where(total > 0, counts / np.where(total > 0, total, 1.0), 0.0)
    use = alpha[e.word, e.start] * weight[:, 0] * beta[e.word, e.end] * share[e.word]
    flat = out.reshape(-1)
    whole = e.piece >= 0
    flat += np.bincount(e.piece[whole] * p.shape[1] + language[e.word[whole]], use[whole], len(flat))
    for k, c in enumerate(e.chars):
        here = e.piece == -1 - k
        per = np.bincount(language[e.word[here]], use[here], p.shape[1])
        for b in c.encode("utf-8", "surrogatepass"):
            out[vocab.bytes[b]] += per
    return out


def _long_word(word: str, vocab: Pieces, p: np.ndarray) -> np.ndarray:
    """Log-probability of one word of any length, rescaled at every position."""
    w = "▁" + word
    reach = vocab.longest
    alpha = np.zeros((reach + 1, p.shape[1]))  # ring of the last positions
    alpha[0] = 1.0
    log = np.zeros(p.shape[1])
    for j in range(1, len(w) + 1):
        total = np.zeros(p.shape[1])
        for i in range(max(0, j - reach), j):
            k = vocab.ids.get(w[i:j], -1)
            if k >= 0:
                total += alpha[i % (reach + 1)] * p[k]
            elif i == j - 1:
                total += alpha[i % (reach + 1)] * p[[vocab.bytes[b] for b in w[i].encode("utf-8", "surrogatepass")]].prod(axis=0)
        # the ring stays in scale: every kept position is divided alike
        alpha /= total
        log += np.log(total)
        alpha[j % (reach + 1)] = 1.0
    return log


def word_scores(words: list[str], vocab: Pieces, p: np.ndarray) -> np.ndarray:
    """log P(word) in each language, summed over all segmentations."""
    out = np.empty((len(words), p.shape[1]))
    short = [i for i, w in enumerate(words) if len(w) <= LONGEST]
    rest = [i for i, w in enumerate(words) if len(w) > LONGEST]
    if short:
        e = edges([words[i] for i in short], vocab)
        total = forward(e, _weights(e, vocab, p))[np.arange(len(short)), e.size]
        small = (total < 1e-250).any(axis=1)
        out[short] = np.log(np.where(total > 0, total, 1.0))
        rest += [short[i] for i in np.flatnonzero(small)]
    for i in rest:
        out[i] = _long_word(words[i], vocab, p)
    return out


# ------------------------------------------------------------------ learning

def held_out(id_col: str) -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, word, n) over all training documents.  Tasks count in a bounded
    table before the exchange, so a hot language or word is a few rows a task."""
    train = docs.filter(~held_out(id_col) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    train = train.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, table in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(table)), pa.array(table.keys(), pa.string()), pa.array(table.values(), pa.int64())],
                                                 names=["lang", "word", "n"])
            held.clear()

        for batch in batches:
            for part in slices(batch, "text"):
                for lang, text in zip(part.column("lang").to_pylist(), part.column("text").to_pylist()):
                    held.setdefault(lang, Counter()).update(w for w in LETTERS.findall(text.lower()) if len(w) <= LONGEST)
                if sum(map(len, held.values())) > KEPT:
                    yield from flush()
        yield from flush()

    return train.mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def _pass(counts: DataFrame, languages: list[str], vocab: Pieces, p: np.ndarray) -> np.ndarray:
    """One expectation step over the whole word table."""
    index = {x: i for i, x in enumerate(languages)}
    shared = counts.sparkSession.sparkContext.broadcast((vocab, p))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, p = shared.value
        total = np.zeros(p.shape)
        for batch in batches:
            for i in range(0, batch.num_rows, 5000):
                part = batch.slice(i, 5000)
                lang = np.array([index[x] for x in part.column("lang").to_pylist()], dtype=np.int64)
                total += expected(part.column("word").to_pylist(), part.column("n").to_numpy().astype(float), lang, vocab, p)
        row, col = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(row.astype(np.int32)), pa.array(col.astype(np.int32)), pa.array(total[row, col])], names=["piece", "language", "uses"])

    out = np.zeros(p.shape)
    sums = counts.mapInArrow(run, "piece int, language int, uses double").groupBy("piece", "language").agg(F.sum("uses").alias("uses"))
    for r in sums.collect():  # at most vocabulary x languages rows
        out[r.piece, r.language] = r.uses
    shared.unpersist()
    return out


def learn(docs: DataFrame, proto: bytes, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", passes: int = PASSES) -> Model:
    """Fit the piece probabilities of every language of the training documents."""
    counts = scratch(word_counts(docs, id_col, text_col, lang_col), "language-words")
    seen = sorted((r.lang, r.n) for r in docs.filter(~held_out(id_col) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
                  .groupBy(F.col(lang_col).cast("string").alias("lang")).agg(F.count("*").alias("n")).collect())
    languages = [x for x, _ in seen]
    vocab = pieces(proto)
    # begin alike in all languages: pieces weighted by their rank in the file
    p = np.repeat((1.0 / np.arange(1, vocab.size + 1))[:, None], len(languages), axis=1)
    p /= p.sum(axis=0)
    floor = 0.01 / vocab.size
    for _ in range(passes if languages else 0):
        uses = _pass(counts, languages, vocab, p)
        pooled = uses.sum(axis=1, keepdims=True)
        pooled = pooled / max(pooled.sum(), 1.0) * 0.99 + floor
        p = uses + PRIOR_WEIGHT * pooled
        p /= p.sum(axis=0)
    n = np.array([n for _, n in seen], dtype=float)
    return Model(languages, np.log(n / n.sum()) if len(n) else n, p)


# ---------------------------------------------------------------- prediction

def scorer(vocab: Pieces, model: Model) -> Callable[[list[str]], list[pa.Array]]:
    """Function from texts to predictions, with a bounded table of word scores."""
    index: dict[str, int] = {}
    known = np.zeros((0, len(model.languages)))

    def predict(texts: list[str]) -> list[pa.Array]:
        nonlocal known
        if not model.languages:
            return [pa.array([UNKNOWN] * len(texts)), pa.array([0.0] * len(texts))]
        found = [LETTERS.findall(t.lower()) for t in texts]
        size = np.array([len(w) for w in found], dtype=np.int64)
        if len(index) > KEPT:
            index.clear()
            known = known[:0]
        new = list({w for ws in found for w in ws if w not in index})
        step = max(1, 20_000 // len(model.languages))
        known = np.concatenate([known, *(word_scores(new[i:i + step], vocab, model.p) for i in range(0, len(new), step))])
        index.update(zip(new, range(len(index), len(index) + len(new))))
        total = np.zeros((len(texts), len(model.languages)))
        full = np.flatnonzero(size)
        if len(full):
            at = np.fromiter((index[w] for ws in found for w in ws), dtype=np.int64, count=int(size.sum()))
            total[full] = np.add.reduceat(known[at], np.r_[0, np.cumsum(size[full])[:-1]], axis=0)
        total += model.log_prior
        best = total.argmax(axis=1)
        posterior = 1.0 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
        names = [model.languages[b] if n else UNKNOWN for b, n in zip(best.tolist(), size.tolist())]
        return [pa.array(names, pa.string()), pa.array(np.where(size > 0, posterior, 0.0))]

    return predict


def predict(docs: DataFrame, model: Model, proto: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred, score of every row, map-only."""
    shared = docs.sparkSession.sparkContext.broadcast((pieces(proto), model))
    return per_text(docs, id_col, text_col, lambda: scorer(*shared.value), "lang_pred string, score double")


def language_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                  vocabulary_file: str | None = None) -> DataFrame:
    """The contract's columns: learned from the training third pair, predicted for all."""
    with open(vocabulary_file or vocabulary(VOCABULARY), "rb") as f:
        proto = f.read()
    model = learn(docs, proto, id_col, text_col, lang_col)
    out = predict(docs, model, proto, id_col, text_col)
    return out.select(id_col, held_out(id_col).alias("held_out"), "lang_pred", "score")
