"""Sentence boundaries: statistics by hand, spans against a plain version."""

import math
import random
import re

import pytest

from ratewise.operators import sentences


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(6)
    names = ["Smith", "Jones", "Brown", "Alba", "Kerr", "Lowe", "Marsh", "Nash", "Orr", "Pike"]
    verbs = ["walked", "slept", "sang", "ate", "ran"]
    rows = []
    for i in range(120):
        parts = []
        for _ in range(rng.randrange(1, 8)):
            who = rng.choice(["dr.", "Mr.", "Dr."]) + " " + rng.choice(names) if rng.random() < 0.6 else "the " + rng.choice(["dog", "cat", "judge", "bird"])
            start = rng.choice(["The day was long and", "Then", "In the e.g. small town", "The"]) + " " + who
            parts.append(f"{start} {rng.choice(verbs)} home or away and late or often and {rng.choice(verbs)} {rng.choice(['home', 'away', 'often', 'late'])}{rng.choice(['.', '.', '!', '?', '.)'])}")
        rows.append((i, rng.choice([" ", "\n", "  "]).join(parts)))
    rows += [(500, None), (501, ""), (502, " \t\n"), (503, "\n Dr. The end"), (504, "one\x01two. Then three"), (505, "a" * 3000 + ". Then b"), (505, "a" * 3000 + ". Then b"),
             (506, "é. ñu... Wait...what?! (Yes.) \"No.\" 3.5 p.m. The x")]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


def plain(rows, abbreviations, starters):
    """Spans token by token."""
    def core(t):
        return re.sub(r"""["')\]]+$""", "", re.sub(r"""^["'(\[]+""", "", t))

    def kind(c):
        w = re.sub(r"\.$", "", c).translate({x: x + 32 for x in range(65, 91)})
        return w if re.fullmatch(r"[^\W\d_](?:[^\W\d_]|\.)*", w) else None
    for i, text in rows:
        found = list(re.finditer(r"([^ \t-\r]+)([ \t-\r]*)", text or ""))
        n, start = 0, None
        for j, m in enumerate(found):
            start = m.start() if start is None else start
            c, after = core(m[1]), core(found[j + 1][1]) if j + 1 < len(found) else None
            stop = "\n" in m[2] or c[-1:] in ("!", "?")
            if c.endswith(".") and not stop:
                goes_on = kind(c) in abbreviations and not (after and after[0].isupper() and kind(after) in starters)
                stop = not goes_on
            if stop or j + 1 == len(found):
                yield i, n, start, m.end(1)
                n, start = n + 1, None


def test_abbreviations_and_starters(docs):
    stats = sentences.statistics(docs)
    chosen = {r.type for r in stats.types.filter("is_abbreviation").collect()}
    assert {"dr", "mr", "e.g"} <= chosen and not chosen & {"home", "away", "often", "late"}
    starters = {r.type for r in stats.starters.collect()}
    assert "the" in starters and "then" in starters and not starters & {"smith", "jones", "dog"}


def test_scores_by_hand(docs):
    stats = sentences.statistics(docs)
    tokens = [m for r in docs.collect() for m in re.findall(r"[^ \t-\r]+", r.text or "")]
    cores = [re.sub(r"""["')\]]+$""", "", re.sub(r"""^["'(\[]+""", "", t)) for t in tokens]
    share = sum(c.endswith(".") for c in cores) / len(cores)
    for r in stats.types.filter("type in ('dr', 'home', 'e.g')").collect():
        k, n = r.c_period, r.c_plain
        assert k == sum(c.lower() == r.type + "." for c in cores) and n == sum(c.lower() == r.type for c in cores)
        likely = 2 * (k * math.log(0.99) + n * math.log(0.01) - k * math.log(share) - n * math.log(1 - share))
        letters, inner = len(r.type.replace(".", "")), r.type.count(".")
        assert abs(r.score - likely * math.exp(-letters) * (inner + 1) * letters ** -n) < 1e-9 * max(1, abs(r.score))


def test_spans(spark, docs):
    stats = sentences.statistics(docs)
    abbreviations = {r.type for r in stats.types.filter("is_abbreviation").collect()}
    starters = {r.type for r in stats.starters.collect()}
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = sorted(map(tuple, sentences.sentences(docs, stats=stats).collect()))
    assert got == sorted(plain(rows, abbreviations, starters))
    smith = {(i, t[a:b]) for i, n, a, b in got for j, t in rows if i == j}
    assert not any(t.endswith(("dr.", "Dr.", "Mr.")) for i, t in smith if i < 500)
    assert sentences.sentences(docs.limit(0), stats=stats).count() == 0


def test_documents_move_only_where_they_hold_an_abbreviation(docs):
    plan = sentences.inner_periods(docs, sentences.statistics(docs), ["doc_id"])._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan


def test_a_text_of_many_sentences_takes_linear_time(spark, docs):
    import time
    stats = sentences.statistics(docs)
    one = spark.createDataFrame([(1, "Ab cd. Ef? gh dr. Smith!\n" * 8000)], "doc_id long, text string")
    t = time.time()
    got = sorted(map(tuple, sentences.sentences(one, stats=stats).collect()))
    assert time.time() - t < 15
    assert len(got) == 24_000 and got[:3] == [(1, 0, 0, 6), (1, 1, 7, 10), (1, 2, 11, 24)] and got[-1] == (1, 23_999, 7999 * 25 + 11, 8000 * 25 - 1)


def test_separators_of_unicode_belong_to_the_word(spark):
    """As in the SQL, where only the end of the word counts as its end."""
    rows = [(1, "an end.\u2028 The end. He said \"no.\"\u2028 what!\x85 then go."), (2, "end. end end")]
    stats = sentences.statistics(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {(r.type, r.c_period, r.c_plain) for r in stats.types.collect()} == {("end", 2, 2), ("go", 1, 0)}


def test_different_words_are_looked_at_once(spark):
    docs = spark.createDataFrame([(i, "the dog ran home. The dog") for i in range(50)], "doc_id long, text string")
    counted = sentences._counted_tokens(docs, "text").collect()
    assert {(r.token, r.next, r.n) for r in counted} == {("the", None, 50), ("dog", None, 100), ("ran", None, 50), ("home.", "The", 50), ("The", None, 50)}


@pytest.mark.parametrize("counted, held", [(4_000_000, 500_000), (40, 6)])
def test_tokens_are_counted_by_slices(spark, monkeypatch, counted, held):
    """Equal to a count token by token; a line's last token has none behind it."""
    import collections
    monkeypatch.setattr(sentences, "COUNTED", counted)
    monkeypatch.setattr(sentences, "HELD", held)
    rng = random.Random(4)
    pieces = ["The", "the", "end.", "end.\")", "Ab.c", "x!", "(y?')", "\"'.", "...", "é.", "\x1c", "a\x85b", " .", " ", "\t", "\x0b", "\r", "\n", "\n\n"]
    texts = ["".join(rng.choice(pieces) + rng.choice([" ", " ", "", "\x0c"]) for _ in range(rng.randrange(40))) for _ in range(150)] + [None, "", "\n"]
    expect = collections.Counter()
    for text in texts:
        for line in (text or "").split("\n"):
            tokens = re.findall(r"[^ \t-\r]+", line)
            expect.update((t, after if re.search(r"""[.!?]["')\]]*\Z""", t) else None) for t, after in zip(tokens, [*tokens[1:], None]))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    assert {(r.token, r.next): r.n for r in sentences._counted_tokens(docs, "text").collect()} == dict(expect)
