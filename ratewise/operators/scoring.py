"""Scoring of cleaned text into four probabilities.

A *scorer* is a function ``Column (cleaned text) -> Column`` returning
ARRAY<DOUBLE> (or ARRAY<FLOAT>) of length 4 in label order
(sexual, violence, substance, language).  Two kinds ship:

* ``LexiconScorer`` (M10, ours): a weighted word list plus a bias gives one
  logit per label, then a sigmoid.  Small lexicons compile to native
  expressions (an ``IN`` list per weight tier, which Catalyst turns into a
  hash set above 10 terms): map-only, no shuffle.
  A lexicon that is a table, of any size, goes through
  ``lexicon_scores_join`` (explode + join + aggregate).
* ``model_scorer`` (M4 / U3): a user model behind an iterator pandas UDF,
  loaded once per Python worker, fed Arrow batches, never called on empty
  texts, and marked non-deterministic so Catalyst never evaluates it twice.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ratewise.constants import LABEL_ORDER, SCALING_METHOD
from ratewise.functions import severity as V
from ratewise.functions import text as X

# Our stand-in lexicon: (term, weight) per label, and the bias of every
# logit.  Weights are binary fractions so sums are exact in double.
DEFAULT_BIAS = -3.0
DEFAULT_LEXICON: dict[str, list[tuple[str, float]]] = {
    "sexual": [
        ("sex", 1.5), ("sexy", 1.5), ("naked", 1.5), ("nude", 1.5), ("seduce", 1.5),
        ("lust", 0.75), ("kiss", 0.75), ("bed", 0.75), ("body", 0.75), ("strip", 0.75),
    ],
    "violence": [
        ("kill", 1.5), ("killed", 1.5), ("murder", 1.5), ("gun", 1.5), ("guns", 1.5),
        ("shoot", 1.5), ("stab", 1.5),
        ("blood", 0.75), ("fight", 0.75), ("die", 0.75), ("dead", 0.75), ("war", 0.75),
        ("knife", 0.75), ("punch", 0.75),
    ],
    "substance": [
        ("cocaine", 1.5), ("heroin", 1.5), ("meth", 1.5), ("weed", 1.5), ("drug", 1.5),
        ("drugs", 1.5),
        ("pills", 0.75), ("beer", 0.75), ("wine", 0.75), ("whiskey", 0.75), ("vodka", 0.75),
        ("drunk", 0.75), ("high", 0.75), ("smoke", 0.75),
    ],
    "language": [
        ("trash", 1.5), ("idiot", 1.5), ("scum", 1.5), ("worthless", 1.5), ("moron", 1.5),
        ("clown", 0.75), ("pathetic", 0.75), ("loser", 0.75), ("stupid", 0.75),
        ("disgusting", 0.75), ("damn", 0.75), ("hell", 0.75), ("crap", 0.75),
    ],
}

def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _member_of(terms: list[str]):
    """One-argument predicate for ``F.filter`` (a second parameter would be
    bound to the element index)."""
    def pred(t: Column) -> Column:
        return t.isin(terms)
    return pred


@dataclass
class LexiconScorer:
    """Weighted bag-of-words logit per label, then sigmoid (M5)."""

    lexicon: dict[str, list[tuple[str, float]]] = field(default_factory=lambda: DEFAULT_LEXICON)
    bias: float = DEFAULT_BIAS

    def __post_init__(self) -> None:
        unknown = set(self.lexicon) - set(LABEL_ORDER)
        if unknown:
            raise ValueError(f"unknown labels {sorted(unknown)}")

    def tiers(self, label: str) -> list[tuple[float, list[str]]]:
        by_weight: dict[float, list[str]] = {}
        for term, w in self.lexicon.get(label, []):
            by_weight.setdefault(float(w), []).append(term)
        return sorted(by_weight.items())

    def hits(self, tokens: Column) -> Column:
        """The tokens that the lexicon holds: one hashed look-up each, so that
        the weight tiers go over a handful of words instead of a text."""
        return F.filter(tokens, _member_of(sorted({t for terms in self.lexicon.values() for t, _ in terms})))

    def logit(self, tokens: Column, label: str) -> Column:
        z = F.lit(float(self.bias))
        for w, terms in self.tiers(label):
            z = z + F.size(F.filter(tokens, _member_of(terms))).cast("double") * F.lit(w)
        return z

    def probabilities(self, hits: Column) -> Column:
        return F.array(*[V.sigmoid(self.logit(hits, lab)) for lab in LABEL_ORDER])

    def __call__(self, cleaned) -> Column:
        # a lambda over one element: array filters do not share a common argument
        hits = self.hits(F.split(_c(cleaned), " "))
        return F.transform(F.array(hits), lambda h: self.probabilities(h))[0]

    def score_frame(self, df: DataFrame, cleaned: str, out: str) -> DataFrame:
        """Same as ``__call__`` but with the words found as their own column, so
        the interpreted array filters share one short array per row."""
        tok = df.withColumn("__hits", self.hits(F.split(F.col(cleaned), " ")))
        return tok.withColumn(out, self.probabilities(F.col("__hits"))).drop("__hits")

    def table(self, spark) -> DataFrame:
        rows = [(t, lab, float(w)) for lab, terms in self.lexicon.items() for t, w in terms]
        return spark.createDataFrame(rows, "term string, label string, weight double")


_DEFAULT: list = []


def set_default_scorer(scorer) -> None:
    """Make ``scorer`` (a ``TrainedScorer``, say) the one that jobs use when
    they are given none; ``None`` goes back to the word list."""
    _DEFAULT[:] = [] if scorer is None else [scorer]


def default_scorer():
    """The scorer of jobs that are given none."""
    return _DEFAULT[0] if _DEFAULT else LexiconScorer()


def lexicon_scores_join(df: DataFrame, key: str, cleaned: str, lexicon: DataFrame,
                        bias: float = DEFAULT_BIAS) -> DataFrame:
    """M10 for a lexicon table (term, label, weight) of any size: explode the
    tokens, keep those in the lexicon, sum the weights per key in one
    aggregation (a document's hits meet in its own task first), and give
    documents without a hit the bias by one left join of the keys.  ``key``
    must identify a row.  Returns (key, probs)."""
    tokens = df.select(key, F.explode(F.split(F.col(cleaned), " ")).alias("term"))
    weight = lambda lab: F.sum(F.when(F.col("label") == lab, F.col("weight"))).alias(lab)
    hits = tokens.join(lexicon, "term").groupBy(key).agg(*[weight(lab) for lab in LABEL_ORDER])
    probs = F.array(*[V.sigmoid(F.lit(float(bias)) + F.coalesce(F.col(lab), F.lit(0.0)))
                      for lab in LABEL_ORDER])
    return df.select(key).join(hits, key, "left").select(key, probs.alias("probs"))


# ---------------------------------------------------------------------------
# Model plug-in
# ---------------------------------------------------------------------------

_MODEL_CACHE: dict[tuple, object] = {}


@dataclass
class ModelSpec:
    """How to get a model inside a Python worker.

    ``loader(path)`` returns a callable ``list[str] -> array (n, 4)`` of
    probabilities (or logits when ``outputs_logits``).  ``path`` must be a
    location every executor can read, on any file system the loader knows;
    ``exists`` may test it on the driver, so that a missing model fails the job
    at start.  ``version`` tells apart models of one name and path."""

    name: str
    loader: Callable[[str | None], Callable[[list[str]], Sequence]]
    path: str | None = None
    outputs_logits: bool = False
    version: str = ""
    exists: Callable[[str], bool] | None = None

    def check(self) -> None:
        if self.path is not None and self.exists is not None and not self.exists(self.path):
            raise FileNotFoundError(f"model {self.name!r}: {self.path} not found")

    def load(self):
        loader = f"{getattr(self.loader, '__module__', '')}.{getattr(self.loader, '__qualname__', repr(self.loader))}"
        key = (self.name, self.path, self.version, loader)
        model = _MODEL_CACHE.get(key)
        if model is None:
            model = self.loader(self.path)
            _MODEL_CACHE[key] = model
        return model


def model_scorer(spec: ModelSpec, max_batch: int = 64) -> Callable[[Column], Column]:
    """Scorer backed by ``spec`` through an iterator pandas UDF.

    Arrow hands the UDF batches of rows; inside, texts are sent to the
    model in chunks of ``max_batch`` sorted by length (less padding).  Empty
    texts get zeros without touching the model (M1).  Output is checked to
    have four columns."""
    spec.check()
    from ratewise.session import ship_package
    ship_package()  # workers unpickle the loader from this package

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def _score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = spec.load()
        for texts in batches:
            values = texts.fillna("").tolist()
            out = np.zeros((len(values), 4), dtype=np.float32)
            todo = [i for i, t in enumerate(values) if t]
            todo.sort(key=lambda i: len(values[i]))
            for start in range(0, len(todo), max_batch):
                chunk = todo[start:start + max_batch]
                res = np.asarray(model([values[i] for i in chunk]), dtype=np.float64)
                if res.ndim != 2 or res.shape != (len(chunk), 4):
                    raise ValueError(f"model {spec.name!r} returned shape {res.shape}, "
                                     f"expected ({len(chunk)}, 4)")
                if spec.outputs_logits:
                    res = 1.0 / (1.0 + np.exp(-res))
                if not ((res >= 0) & (res <= 1)).all():  # also catches NaN
                    raise ValueError(f"model {spec.name!r} returned values that are not probabilities")
                out[chunk] = res.astype(np.float32)
            yield pd.Series(list(out))

    udf = _score.asNondeterministic()

    def scorer(cleaned) -> Column:
        return udf(_c(cleaned))

    return scorer


# ---------------------------------------------------------------------------
# Text -> analysis result (M1, M8)
# ---------------------------------------------------------------------------

def _zero_probs() -> Column:
    return F.array(*[F.lit(0.0)] * 4)


def apply_scorer(df: DataFrame, scorer, cleaned: str, out: str) -> DataFrame:
    """Add the scorer's probabilities of ``cleaned`` as column ``out``."""
    if hasattr(scorer, "score_frame"):
        return scorer.score_frame(df, cleaned, out)
    return df.withColumn(out, scorer(F.col(cleaned)))


def with_analysis(df: DataFrame, probs: str, words: Column, empty: Column) -> DataFrame:
    """M1 + M8 as staged projections: the (zeroed when empty) probability
    array first, then the rescaled categories from it."""
    p = F.when(empty, _zero_probs()).otherwise(F.col(probs).cast("array<double>"))
    stage = df.withColumns({"__p": p, "__empty": empty, "total_words": words})
    cats = V.category_percentages("__p")
    out = stage.withColumns({name: F.when(F.col("__empty"), F.lit(0.0)).otherwise(col)
                             for name, col in cats.items()})
    out = out.withColumns({
        "raw_probabilities": F.col("__p"),
        "confidence_scores": F.col("__p"),
        "scaling_method": F.when(F.col("__empty"), F.lit(None).cast("string")).otherwise(F.lit(SCALING_METHOD)),
        # Text with no ASCII letters cleans to '' and rates M-E; flag it
        "cleaned_empty": F.col("__empty"),
    })
    return out.drop("__p", "__empty")


def lexicon_model_loader(path: str | None = None, lexicon=None, bias: float = DEFAULT_BIAS):
    """Stand-in model for the plug-in contract: the lexicon scorer written
    as a per-batch Python callable ``list[str] -> (n, 4) probabilities``.
    Used to check that the plug-in path and the native path agree."""
    import math

    lex = lexicon or DEFAULT_LEXICON
    weights = {lab: dict(terms) for lab, terms in lex.items()}

    def predict(texts: list[str]):
        out = []
        for t in texts:
            toks = t.split(" ")
            row = []
            for lab in LABEL_ORDER:
                w = weights.get(lab, {})
                z = bias + sum(w.get(tok, 0.0) for tok in toks)
                row.append(1.0 / (1.0 + math.exp(-z)))
            out.append(row)
        return out

    return predict


# ---------------------------------------------------------------------------
# Long texts: overlapping windows, pooled
# ---------------------------------------------------------------------------


@dataclass
class WindowedScorer:
    """Scores whole texts by overlapping windows of ``width`` words, ``stride``
    words apart; a text's probability of a label is the largest of its windows.

    A model with a bounded input thus sees every word of a text.  A text of up
    to ``width`` words is one window.  Windows are rows of their own, so a long
    text is spread over batches (which ``model_scorer`` packs by length) and its
    windows' maxima meet in its task before the exchange of (row, maxima).
    Rows are written once under the shared folder, so batch tables only."""

    scorer: object
    width: int = 1024
    stride: int = 512

    def __post_init__(self) -> None:
        if not 0 < self.stride <= self.width:
            raise ValueError("a stride of 1 to width words covers every word")

    def _last(self, words: Column) -> Column:
        return F.greatest(F.lit(0), F.ceil((F.size(words) - self.width) / F.lit(self.stride))).cast("int")

    def n_windows(self, cleaned: Column) -> Column:
        """How many windows a cleaned text has."""
        return self._last(F.split(cleaned, " ")) + 1

    def windows(self, cleaned: Column) -> Column:
        """The windows of a cleaned text, as texts; the last one ends with it."""
        # a lambda over one element, for else every window would split the text anew
        return F.transform(F.array(F.split(cleaned, " ")), lambda words: F.transform(
            F.sequence(F.lit(0), self._last(words)), lambda i: F.array_join(F.slice(words, i * self.stride + 1, F.lit(self.width)), " ")))[0]

    def score_frame(self, df: DataFrame, cleaned: str, out: str) -> DataFrame:
        from ratewise.session import write_table
        rows = write_table(df.withColumn("__row", F.monotonically_increasing_id()), "windowed")
        parts = rows.select("__row", F.explode(self.windows(F.col(cleaned))).alias("__window"))
        scored = apply_scorer(parts, self.scorer, "__window", "__p")
        best = scored.groupBy("__row").agg(*[F.max(F.col("__p")[i]).alias(f"__p{i}") for i in range(len(LABEL_ORDER))])
        best = best.select("__row", F.array(*[F.col(f"__p{i}").cast("double") for i in range(len(LABEL_ORDER))]).alias(out))
        return rows.join(best, "__row").drop("__row")
