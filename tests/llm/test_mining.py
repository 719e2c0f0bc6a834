"""Language identification, collocations and hard negatives against brute
force, with odd rows: nulls, empty and long texts, ties, repeated rows."""

from __future__ import annotations

import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from ratewise.llm import collocations, hard_negatives, language_id
from ratewise.llm.common import vocabulary


# ------------------------------------------------------------------ op 11

@pytest.fixture(scope="module")
def vocab():
    with open(vocabulary(language_id.VOCABULARY), "rb") as f:
        return language_id.pieces(f.read())


def segmentations(word, vocab):
    """Every way to cut a word into pieces (lists of piece ids)."""
    if not word:
        yield []
        return
    for j in range(1, len(word) + 1):
        k = vocab.ids.get(word[:j], -1)
        head = [k] if k >= 0 else [vocab.bytes[b] for b in word[:1].encode()] if j == 1 else None
        if head:
            for rest in segmentations(word[j:], vocab):
                yield head + rest


def some_model(vocab, languages=3):
    p = np.random.default_rng(1).random((vocab.size, languages)) + 0.01
    return p / p.sum(axis=0)


WORDS = ["the", "stadt", "ción", "ß", "日本", "ꙮab", "onering", "ñ", "aaaa"]


def test_words_sum_over_all_segmentations(vocab):
    p = some_model(vocab)
    got = language_id.word_scores(WORDS, vocab, p)
    for w, row in zip(WORDS, got):
        every = list(segmentations("▁" + w, vocab))
        expect = [math.log(sum(math.prod(p[k, c] for k in cut) for cut in every)) for c in range(3)]
        assert np.allclose(row, expect)
        assert np.allclose(language_id._long_word(w, vocab, p), expect)


def test_expected_uses_of_pieces(vocab):
    p = some_model(vocab)
    n = np.arange(1.0, len(WORDS) + 1)
    lang = np.arange(len(WORDS)) % 3
    expect = np.zeros(p.shape)
    for w, f, c in zip(WORDS, n, lang):
        weights = [(cut, math.prod(p[k, c] for k in cut)) for cut in segmentations("▁" + w, vocab)]
        total = sum(x for _, x in weights)
        for cut, x in weights:
            for k in cut:
                expect[k, c] += f * x / total
    assert np.allclose(language_id.expected(WORDS, n, lang, vocab, p), expect)


LANG_NAMES = "doc_id long, text string, lang string, score string, word string, source string"


def test_languages(spark, vocab):
    rng = random.Random(4)
    make = {"xx": "ka lo mi sua tre".split(), "yy": "gro vent ost ach und".split()}
    rows = [(i, " ".join(rng.choices(make[l], k=30)), l, None, "w", "s") for i, l in zip(range(120), itertools.cycle(make))]
    odd = [(200, None, "xx"), (201, "", "yy"), (202, "123 !? 4", "xx"), (203, "ka lo mi " * 4000, None), (204, "gro" * 20 + " vent ost" * 300, "yy"),
           (None, "ka lo mi", "xx"), (206, "KA LO MI", None)]
    rows += [(i, t, l, None, None, None) for i, t, l in odd]
    rows += [rows[0], rows[-3]]
    docs = spark.createDataFrame(rows, LANG_NAMES).repartition(3)
    got = language_id.language_rows(docs).collect()
    assert len(got) == len(rows)
    want = {r[0]: r for r in rows}
    for r in got:
        _, text, lang, *_ = want[r.doc_id]
        assert r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 3 == 1)
        assert 0 <= r.score <= 1
        if not text or not re.search(r"[^\W\d_]", text):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        else:
            assert r.lang_pred == (lang or "xx")
    # the languages of held-out rows are never used
    swapped = [(i, t, "zz" if zlib.crc32(str(i).encode()) % 3 == 1 and i is not None else l, *x) for i, t, l, *x in rows]
    again = language_id.language_rows(spark.createDataFrame(swapped, LANG_NAMES).repartition(3)).collect()
    key = lambda r: (str(r.doc_id), r.lang_pred, round(r.score, 9))
    assert sorted(map(key, got)) == sorted(map(key, again))
    nothing = language_id.language_rows(docs.limit(0))
    assert nothing.count() == 0
    unlabelled = language_id.language_rows(docs.selectExpr("doc_id", "text", "cast(null as string) as lang")).collect()
    assert {(r.lang_pred, r.score) for r in unlabelled} == {("und", 0.0)}


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = language_id.language_rows(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out")
    right, n = out.selectExpr("avg(cast(lang = lang_pred as int))", "count(*)").first()
    assert n > 200 and right >= 0.99


# ------------------------------------------------------------------ op 12

def mined(rows, least, cover, top):
    """(lang, rank, phrase, a, l, r, n, score), straight from the contract."""
    lower = {c: c + 32 for c in range(65, 91)}
    f, total = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", (text or "").translate(lower)):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            f.update((lang, tuple(w[i:i + k])) for k in range(1, 6) for i in range(len(w) - k + 1))
    f = {k: v for k, v in f.items() if v >= least}
    out = []
    for (lang, w), a in f.items():
        if len(w) < 2:
            continue
        cuts = []
        for k in range(1, len(w)):
            l, r = f[lang, w[:k]], f[lang, w[k:]]
            cuts.append((1000 * a * total[lang] // (l * r), k, l, r))
        score, _, l, r = min(cuts)
        held = any(g == lang and len(v) > len(w) and 100 * b >= cover * a and any(v[i:i + len(w)] == w for i in range(len(v)))
                   for (g, v), b in f.items())
        if not held:
            out.append((lang, -score, -a, " ".join(w).encode(), l, r, total[lang]))
    out.sort()
    rank = Counter()
    for lang, score, a, phrase, l, r, n in out:
        rank[lang] += 1
        if rank[lang] <= top:
            yield lang, rank[lang], phrase.decode(), -a, l, r, n, -score


@pytest.mark.parametrize("least, cover, top", [(3, 100, 2000), (2, 60, 15)])
def test_collocations(spark, least, cover, top):
    rng = random.Random(8)
    few = ["a", "b", "c", "ñu", "|", "#d"]
    rows = [(rng.choice(["en", "fr", None]), " ".join(rng.choice(few) + rng.choice(["", "", "", ",", ".\n", "\t", "  ", "\x0b"]) for _ in range(rng.randrange(25))))
            for _ in range(40)]
    rows += [("en", None), ("en", ""), (None, " ... \t"), ("fr", "New York CITY is big"), ("fr", "new york city was new york"), ("fr", "new york city"),
             ("en", "x " * 3000), rows[0], rows[0], ("de", "one two"), ("é", "ü ü ü ü ü ü ü ü")]
    docs = spark.createDataFrame([(i, t, l, 1, "p") for i, (l, t) in enumerate(rows)], "doc_id long, text string, lang string, f long, phrase string").repartition(3)
    out = collocations.collocations(docs, least=least, cover=cover, top=top)
    assert out.schema.names == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, out.collect())) == sorted(mined(rows, least, cover, top))
    if top == 15:
        assert collocations.collocations(docs.limit(0)).count() == 0
        assert collocations.collocations(docs, least=10 ** 6).count() == 0


def test_scores_pass_64_bits(spark):
    """The score's products are decimals: 1000 * a * n here is about 1e21."""
    big = 10 ** 9
    got = spark.range(1).selectExpr(f"(1000 * (cast({big} as decimal(18, 0)) * cast({big * 1000} as decimal(18, 0)))) div "
                                    f"(cast({big} as decimal(18, 0)) * cast({big} as decimal(18, 0))) as s").first().s
    assert got == 1000 * big * big * 1000 // (big * big)


def test_colliding_hashes_are_told_apart():
    import pyarrow as pa
    w = collocations.words(pa.array(["b a b c a b"]), ["x"])
    w.keys[0] = 7  # the first hash alone sees one word
    at, f = collocations.counted(w, np.arange(6), 1, np.zeros(1, np.uint64))
    assert {collocations.phrase_texts(w, at[i:i + 1], 1)[0].as_py(): int(f[i]) for i in range(len(at))} == {"x\na": 2, "x\nb": 3, "x\nc": 1}


# ------------------------------------------------------------------ op 13

def negatives(rows, is_anchor, positives, count, low, high):
    clean = [(i, l, [math.floor(256 * x) for x in v]) for i, l, v in rows
             if i is not None and l is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    for i, l, v in {(i, l, tuple(v)) for i, l, v in clean if is_anchor(i)}:
        dot = [(-sum(x * y for x, y in zip(v, w)), j, m) for j, m, w in clean if j != i]
        for s, j, _ in sorted(x for x in dot if x[2] == l)[:positives]:
            found = sorted(x for x in dot if x[2] != l and low * -s <= 100 * -x[0] <= high * -s)[:count]
            yield from ((i, j, r, n, -s, -t) for r, (t, n, _) in enumerate(found, 1))


@pytest.mark.parametrize("per_round", [20_000, 3])
def test_hard_negatives(spark, per_round):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(4, 20))
    rows = []
    for i in range(400):
        label = int(rng.integers(4))
        rows.append((i, label, [float(x) for x in np.float32(centres[label] + rng.normal(size=20))]))
    rows += [(500, None, [1.0] * 20), (None, 1, [1.0] * 20), (501, 1, None), (502, 1, [None] * 20), (503, 2, [float("nan")] * 20),
             (504, 2, [float("inf")] * 20), (505, 3, []), (506, 3, [2.0, -1.5]), (520, 3, [3.0] * 20), (540, 9, [1.0] * 20), (560, 0, [0.0] * 20)]
    rows += [(700 + i, 1, rows[17][2]) for i in range(60)]  # one vector many times: ties
    rows += [rows[20], rows[21], rows[21]]
    table = spark.createDataFrame([(*r, "x", 0) for r in rows], "vec_id long, label int, embedding array<float>, a string, id int").repartition(3)
    vectors = hard_negatives.vectors(table)
    got = hard_negatives.mine(vectors, vectors.vec_id % 20 == 0, per_round=per_round)
    expect = sorted(negatives(rows, lambda i: i % 20 == 0, 5, 10, 30, 90))
    assert len(expect) > 500
    assert sorted(map(tuple, got.collect())) == expect
    assert hard_negatives.negative_rows(table.limit(0)).count() == 0
    assert hard_negatives.negative_rows(table.filter("vec_id = 505")).count() == 0


def test_large_components_are_exact(spark):
    rows = [(100, 1, [3.0e5, 1.0]), (1, 1, [3.0e5, 2.0]), (2, 2, [2.5e5, 1.0]), (3, 2, [2.5e5, 3.0]), (4, 2, [1.0, 1.0])]
    table = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    vectors = hard_negatives.vectors(table)
    got = hard_negatives.mine(vectors, vectors.vec_id == 100)
    assert sorted(map(tuple, got.collect())) == sorted(negatives(rows, lambda i: i == 100, 5, 10, 30, 90))


def test_bounds_hold_and_refine():
    rng = np.random.default_rng(9)
    for dims in (1, 3, 20, 64):
        x, y = (np.floor(rng.normal(loc=m, size=(30, dims)) * 50) for m in (0.5, 0.2))
        exact = x @ y.T
        last = None
        for level in hard_negatives.LEVELS:
            (a, b), (c, d) = hard_negatives.summaries(x, level), hard_negatives.summaries(y, level)
            middle, spread = a @ c.T, b @ d.T
            assert (middle - spread <= exact + 1e-6).all() and (exact <= middle + spread + 1e-6).all()
            assert last is None or dims not in (64,) or (middle + spread <= last + 1e-6).all()
            last = middle + spread
