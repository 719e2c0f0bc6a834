"""Batch rating of a score table.

All of it is a projection: one map-only, whole-stage-codegen stage, no
shuffle and no Python per row, however large the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratewise.constants import DEFAULT_SCORE_COLUMNS, EXPORT_COLUMNS
from ratewise.functions import rating as R
from ratewise.functions.scores import clean_score, clip01
from ratewise.operators.index import with_row_index

CATEGORIES = ["violence", "sexual", "language", "substance"]


class MissingColumnsError(ValueError):
    """S3: required score columns are absent."""


def score_columns(violence_col: str | None = None, sexual_col: str | None = None,
                  language_col: str | None = None, substance_col: str | None = None) -> dict[str, str]:
    names = dict(DEFAULT_SCORE_COLUMNS)
    for cat, given in zip(CATEGORIES, (violence_col, sexual_col, language_col, substance_col)):
        if given:
            names[cat] = given
    return names


def require_columns(df: DataFrame, required: list[str]) -> None:
    """S3: fail at analysis time, naming missing and available columns."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise MissingColumnsError(
            f"Missing columns: {missing}; available columns: {list(df.columns)}")


def clean_scores(df: DataFrame, cols: list[str]) -> DataFrame:
    """P1-P3 in place: coerce, fill missing with 0, clip to [0, 1]."""
    types = {f.name: f.dataType for f in df.schema.fields}
    return df.withColumns({c: clean_score(c, types[c]) for c in cols})


def rate_scores(df: DataFrame, violence_col: str | None = None, sexual_col: str | None = None,
                language_col: str | None = None, substance_col: str | None = None,
                prefix: str = "MCR_", clean: bool = True) -> DataFrame:
    """Clean the four score columns and add (or overwrite, P5) the six
    ``MCR_*`` result columns."""
    names = score_columns(violence_col, sexual_col, language_col, substance_col)
    cols = [names[c] for c in CATEGORIES]
    require_columns(df, cols)
    out = clean_scores(df, cols) if clean else df
    return with_rating(out, *cols, prefix=prefix, clipped=clean)


_TMP = ["__v", "__s", "__l", "__d", "__max", "__descs"]


def with_rating(df: DataFrame, v: str, s: str, l: str, d: str, prefix: str = "MCR_",
                clipped: bool = False) -> DataFrame:
    """R20 as staged projections: clipped scores -> max, rating and
    descriptor list -> texts.  Each stage refers to the previous one's
    columns, so no output column re-inlines the whole rule set and every
    projection stays inside whole-stage codegen."""
    if clipped:
        stage0 = df.withColumns({t: F.col(c) for t, c in zip(_TMP[:4], (v, s, l, d))})
    else:
        stage0 = df.withColumns({t: clip01(c) for t, c in zip(_TMP[:4], (v, s, l, d))})
    cs = [F.col(t) for t in _TMP[:4]]
    stage1 = stage0.withColumns({
        "__max": F.greatest(*cs),
        "__descs": R.descriptor_list(R.tier_descriptors(*cs)),
        f"{prefix}rating": R.rating_of_clipped(*cs),
    })
    r, ds, m = F.col(f"{prefix}rating"), F.col("__descs"), F.col("__max")
    stage2 = stage1.withColumns({
        f"{prefix}descriptors": R.descriptor_text_from(r, ds),
        f"{prefix}max_score": m,
        f"{prefix}highest_concern": R.concern_of_clipped(*cs, m),
        f"{prefix}recommendation": R.recommendation(r),
    })
    stage3 = stage2.withColumn(f"{prefix}final_rating",
                               R.final_rating_from(r, ds, F.col(f"{prefix}descriptors")))
    return stage3.drop(*_TMP)


def export_frame(rated: DataFrame, names: dict[str, str] | None = None) -> DataFrame:
    """P6 + P7: the 18 export columns in order.  Scores rated under custom
    names are exported under the default names; absent pass-through columns
    become ''."""
    names = names or dict(DEFAULT_SCORE_COLUMNS)
    renamed: dict[str, Column] = {}
    for cat in CATEGORIES:
        default, given = DEFAULT_SCORE_COLUMNS[cat], names[cat]
        if given != default:
            renamed[default] = F.col(given)
    out = rated.withColumns(renamed) if renamed else rated
    exprs = [F.col(c) if c in out.columns else F.lit("").alias(c) for c in EXPORT_COLUMNS]
    return out.select(*exprs)


def rate_table(df: DataFrame, violence_col: str | None = None, sexual_col: str | None = None,
               language_col: str | None = None, substance_col: str | None = None) -> DataFrame:
    """U4: whole batch rating: index if absent (S2), check, clean, rate,
    shape to the 18-column export."""
    names = score_columns(violence_col, sexual_col, language_col, substance_col)
    require_columns(df, [names[c] for c in CATEGORIES])
    if "song_index" not in df.columns:
        df = with_row_index(df, "song_index")
    rated = rate_scores(df, names["violence"], names["sexual"], names["language"], names["substance"])
    return export_frame(rated, names)
