"""Jobs: CSV round trip (J1), row index (S2), model plug-in (U3), dedup
(J2), streaming (J3/J4) and the driver contract."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from ratewise.constants import EXPORT_COLUMNS
from ratewise.operators import rate
from ratewise.operators.index import with_row_index
from ratewise.operators.scoring import LexiconScorer, ModelSpec, lexicon_model_loader, model_scorer
from ratewise.plans import jobs
from ratewise.sources import tables


def _write(path, text):
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)


CSV = ('song,text,violence_score,sexual_score,language_score,substance_score,explicit_edit\n'
       'NA,"line one\nline ""two""",0.96,0,0,0,yes\n'
       'b,plain,abc,0.5,NA,0.1,\n'
       'c,,1.7,,0.3,-1,no\n'
       'd,x,0.06,0,0,0,no\n')


def test_rate_catalogue_csv_round_trip(spark):
    d = tempfile.mkdtemp(prefix="rw-j1-")
    src = os.path.join(d, "songs.csv")
    _write(src, CSV)
    res = jobs.rate_catalogue(spark, src)
    assert res.path == os.path.join(d, "songs_MCR_rated.csv")
    out = res.frame
    assert out.columns == EXPORT_COLUMNS
    rows = {r.song_index: r for r in out.collect()}
    assert sorted(rows) == ["0", "1", "2", "3"]
    assert rows["0"].song == "NA" and rows["0"].text == 'line one\nline "two"'
    assert rows["0"].MCR_final_rating == "M-AO: Graphic Violence"
    assert rows["1"].MCR_rating == "M-T" and rows["1"].sexual_score == "0.5"
    assert rows["2"].MCR_rating == "M-AO" and rows["2"].substance_score == "0.0"
    assert rows["3"].MCR_descriptors == "Parental Guidance Suggested"
    assert rows["3"].sexual in ("", None) and rows["3"].explicit_edit == "no"
    q, s = res.stats["quality"], res.stats["ratings"]
    assert q["n_rows"] == 4
    assert (q["violence_score_non_numeric"], q["violence_score_out_of_range"]) == (1, 1)
    assert (q["language_score_missing"], q["sexual_score_missing"]) == (1, 1)
    assert s["rating:M-AO"] == 2 and s["rating:M-T"] == 1 and s["rating:M-P"] == 1
    summary = jobs.rating_summary(res.stats)
    assert summary["rows"] == 4 and summary["pct"]["M-AO"] == 50.0


def test_missing_columns_error(spark):
    df = spark.createDataFrame([(1.0,)], "violence_score double")
    with pytest.raises(rate.MissingColumnsError) as e:
        rate.rate_table(df)
    assert "sexual_score" in str(e.value) and "violence_score" in str(e.value)


def test_custom_names_exported_under_defaults(spark):
    df = spark.createDataFrame([(0.5, 0.0, 0.0, 0.0)], "v double, s double, l double, d double")
    out = rate.rate_table(df, "v", "s", "l", "d").first()
    assert out.violence_score == 0.5 and out.MCR_rating == "M-T" and out.song_index == 0


def test_row_index_is_dense_and_ordered(spark):
    df = spark.range(0, 1000, numPartitions=7).select((F.col("id") * 3).alias("x"))
    out = sorted(with_row_index(df, "song_index").collect(), key=lambda r: r.song_index)  # a table has no row order
    assert [r.song_index for r in out] == list(range(1000))
    assert [r.x for r in out] == [i * 3 for i in range(1000)]


def test_model_plugin_equals_native_and_runs_once(spark):
    docs = tables.table(spark, SF_SMALL, "documents").select("doc_id", "text")
    spec = ModelSpec("lexicon-twin", lexicon_model_loader)
    plug = jobs.score_and_rate(docs, "text", scorer=model_scorer(spec, max_batch=16))
    plan = plug._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    filtered = plug.filter(F.col("severity") > 0)
    assert filtered._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    native = jobs.score_and_rate(docs, "text")
    cols = ["doc_id", "mcr_rating", "safety_level", "kid_safe"]
    a = sorted(tuple(r) for r in plug.select(*cols, F.round("severity", 4)).collect())
    b = sorted(tuple(r) for r in native.select(*cols, F.round("severity", 4)).collect())
    assert a == b


def test_model_missing_fails_at_start():
    with pytest.raises(FileNotFoundError):
        model_scorer(ModelSpec("absent", lexicon_model_loader, path="/nonexistent/model", exists=os.path.exists))


def test_two_models_of_one_name_are_two_models():
    a = ModelSpec("same", lambda path: "first", path="a").load()
    b = ModelSpec("same", lambda path: "second", path="b").load()
    assert (a, b) == ("first", "second")


def test_model_output_must_be_probabilities(spark):
    scorer = model_scorer(ModelSpec("nan", lambda path: lambda texts: [[float("nan")] * 4 for _ in texts]))
    df = spark.createDataFrame([("x",)], "t string")
    with pytest.raises(Exception, match="not probabilities"):
        df.select(scorer(F.col("t"))).collect()


def test_dedup_equals_plain_with_hot_keys_salted(spark):
    docs = tables.table(spark, SF_SMALL, "documents").select("doc_id", "text")
    # one text repeated a thousand times: the hot key
    hot = spark.range(10_000, 11_000).select(F.col("id").alias("doc_id"), F.lit("You idiot, trash scum!").alias("text"))
    allrows = docs.unionByName(hot)
    plain = jobs.score_and_rate(allrows, "text")
    dedup = jobs.dedup_score_and_rate(allrows, "doc_id", "text", rows_per_task=100)
    cols = ["doc_id", "mcr_rating", "total_words", "kid_safe", "scaling_method"]
    a = sorted(tuple(r) for r in plain.select(*cols, F.round("severity", 6)).collect())
    b = sorted(tuple(r) for r in dedup.select(*cols, F.round("severity", 6)).collect())
    assert a == b and len(a) == docs.count() + 1000


def test_lexicon_table_path_equals_inline(spark):
    from ratewise.functions import text as X
    from ratewise.operators.scoring import lexicon_scores_join
    d = tables.table(spark, SF_SMALL, "documents").select("doc_id", X.clean_text("text").alias("cleaned"))
    inline = d.select("doc_id", LexiconScorer()(F.col("cleaned")).alias("p"))
    joined = lexicon_scores_join(d, "doc_id", "cleaned", LexiconScorer().table(spark))
    a = {r.doc_id: [round(x, 12) for x in r.p] for r in inline.collect()}
    b = {r.doc_id: [round(x, 12) for x in r.probs] for r in joined.collect()}
    assert a == b


def test_stream_equals_batch(spark):
    from ratewise.streaming import rate_stream
    batch = rate_stream.rating_stream(tables.table(spark, SF_SMALL, "events"))
    out = rate_stream.run_to_parquet(rate_stream.rating_stream(rate_stream.event_stream(spark, SF_SMALL)), rate_stream.new_base(spark, "t_stream"))
    s = spark.read.parquet(out)
    cols = ["event_id", "MCR_rating", "MCR_descriptors"]
    assert sorted(tuple(r) for r in s.select(*cols).collect()) == sorted(tuple(r) for r in batch.select(*cols).collect())


def test_windowed_stream_emits_closed_windows_only(spark):
    from ratewise.streaming import rate_stream
    counts = rate_stream.windowed_rating_counts(rate_stream.event_stream(spark, SF_SMALL))
    got = spark.read.parquet(rate_stream.run_to_parquet(counts, rate_stream.new_base(spark, "t_window")))
    ev = tables.table(spark, SF_SMALL, "events")
    batch = (rate_stream.rating_stream(ev).groupBy(tables.utc_date(F.col("ts")).alias("window_start"), "MCR_rating")
             .agg(F.count(F.lit(1)).alias("n")))
    last = ev.agg(F.max(F.to_date("ts"))).first()[0]
    exp = sorted(tuple(r) for r in batch.filter(F.col("window_start") < F.lit(last)).collect())
    assert sorted(tuple(r) for r in got.select("window_start", "MCR_rating", "n").collect()) == exp


def test_single_song(spark):
    r = jobs.rate_single_song(spark, 0.2, 0.5, 0.5, 0.1).first()
    assert r.final_rating == "M-T: Strong Language; Suggestive Themes"
    assert r.result.details.highest_concern == "sexual"


def test_entry_contract(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.columns == ["rating", "n", "pct"]
    assert [f.dataType.simpleString() for f in df.schema.fields] == ["string", "bigint", "double"]
    assert df.count() > 0
    qs, sql = E.queries(), E.oracle_sql()
    from ratewise.plans import catalog
    # every query of the library has its DuckDB SQL, but for the iterative fit (tests/test_trained.py)
    assert set(catalog.QUERIES) - {"trained_scorer_metrics", "trained_score_and_rate"} <= set(sql) <= set(qs)
    assert len(qs) >= 30 and all(callable(f) for f in qs.values())


def test_late_events_behind_watermark_are_dropped(spark):
    import datetime as dt
    import time
    from ratewise.streaming import rate_stream
    d = tempfile.mkdtemp(prefix="rw-late-")
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    day = dt.datetime(2024, 1, 1)
    first = [(i, day + dt.timedelta(hours=i), 0, "view", 1.0, "") for i in range(60)]  # up to day 3 11:00
    spark.createDataFrame(first, schema).coalesce(1).write.parquet(os.path.join(d, "b1"))
    stream = (spark.readStream.schema(schema).option("maxFilesPerTrigger", 1)
              .parquet(os.path.join(d, "b*")))
    counts = rate_stream.windowed_rating_counts(stream)
    base = os.path.join(d, "run")
    out_q = (counts.writeStream.format("parquet").outputMode("append")
             .option("path", os.path.join(base, "out")).option("checkpointLocation", os.path.join(base, "ck"))
             .start())
    try:
        out_q.processAllAvailable()
        time.sleep(1)
        # second batch: one late row for day 1 (behind the watermark) and rows
        # on day 4 that push the watermark past day 3
        second = [(1000, day + dt.timedelta(hours=5), 0, "view", 1.0, "")] + \
                 [(2000 + i, day + dt.timedelta(days=3, hours=i), 0, "view", 1.0, "") for i in range(3)] + \
                 [(3000, day + dt.timedelta(days=5, hours=2), 0, "view", 1.0, "")]
        spark.createDataFrame(second, schema).coalesce(1).write.parquet(os.path.join(d, "b2"))
        out_q.processAllAvailable()
        out_q.processAllAvailable()
    finally:
        out_q.stop()
    got = spark.read.parquet(os.path.join(base, "out"))
    per_day = {r.window_start: r.n for r in got.groupBy("window_start").agg(F.sum("n").alias("n")).collect()}
    assert per_day[dt.date(2024, 1, 1)] == 24       # the late row did not count
    assert per_day[dt.date(2024, 1, 4)] == 3        # closed by the later watermark
    assert dt.date(2024, 1, 6) not in per_day       # still open when input ended


def test_rate_catalogue_parquet_without_index(spark):
    d = tempfile.mkdtemp(prefix="rw-j1p-")
    src = os.path.join(d, "scores.parquet")
    tables.order_scores(spark, SF_SMALL).drop("song_index").coalesce(1).write.parquet(src)
    res = jobs.rate_catalogue(spark, src, os.path.join(d, "out"), output_format="parquet")
    out = res.frame
    assert out.columns == EXPORT_COLUMNS
    n = out.count()
    assert sorted(r.song_index for r in out.select("song_index").collect()) == list(range(n))
    assert res.stats["ratings"]["rows"] == n == res.stats["quality"]["n_rows"]
    assert sum(v for k, v in res.stats["ratings"].items() if k.startswith("rating:")) == n


def test_quality_table_long_form(spark):
    from ratewise.operators.quality import quality_table
    df = spark.createDataFrame([("x", "0.5"), (None, "2"), ("NA", "abc")], "a string, b string")
    got = {r.column: (r.non_numeric, r.missing, r.out_of_range) for r in quality_table(df, ["a", "b"]).collect()}
    assert got == {"a": (1, 2, 0), "b": (1, 0, 1)}


def test_lexicon_join_shuffle_path(spark):
    from ratewise.functions import text as X
    from ratewise.operators.scoring import lexicon_scores_join
    d = tables.table(spark, SF_SMALL, "documents").select("doc_id", X.clean_text("text").alias("cleaned"))
    a = {r.doc_id: r.probs for r in lexicon_scores_join(d, "doc_id", "cleaned", LexiconScorer().table(spark).repartition(3)).collect()}
    b = {r.doc_id: list(r.p) for r in d.select("doc_id", LexiconScorer()(F.col("cleaned")).alias("p")).collect()}
    assert a.keys() == b.keys() and all(abs(x - y) < 1e-12 for k in a for x, y in zip(a[k], b[k]))


def test_row_index_empty_input(spark):
    df = spark.createDataFrame([], "x double")
    assert with_row_index(df).count() == 0


def test_summary_and_quality_numbers(spark):
    d = tempfile.mkdtemp(prefix="rw-fmt-")
    src = os.path.join(d, "s.csv")
    _write(src, CSV)
    res = jobs.rate_catalogue(spark, src)
    summary = jobs.rating_summary(res.stats)
    assert summary["ratings"] == {"M-AO": 2, "M-P": 1, "M-T": 1} and summary["pct"]["M-AO"] == 50.0
    # rows 0 and 2 (1.7 clips to 1.0) are both Graphic Violence
    assert summary["top_descriptors"][0] == ("Graphic Violence", 2)
    q = res.stats["quality"]
    assert (q["violence_score_non_numeric"], q["violence_score_out_of_range"], q["substance_score_out_of_range"], q["sexual_score_missing"]) == (1, 1, 1, 1)


def test_long_rows_raise_and_short_rows_are_padded(spark):
    from ratewise.sources import csv_io
    d = tempfile.mkdtemp(prefix="rw-csv-")
    ok, bad = os.path.join(d, "ok.csv"), os.path.join(d, "bad.csv")
    _write(ok, 'a,b,c\n1,"x, ""y""\nz",3\n4\n')
    _write(bad, "a,b,c\n1,2,3\n4,5,6,7\n")
    for many in (True, False):
        rows = [tuple(r) for r in csv_io.read_score_csv(spark, ok, True).collect()]
        assert rows == [("1", 'x, "y"\nz', "3"), ("4", None, None)]
        with pytest.raises(Exception, match="more than 3 fields"):
            csv_io.read_score_csv(spark, bad, many).select("b").collect()
        with pytest.raises(Exception, match="more than 3 fields"):
            csv_io.read_score_csv(spark, bad, many).count()


def test_a_stream_started_again_goes_on(spark):
    from ratewise.streaming import rate_stream
    d = tempfile.mkdtemp(prefix="rw-again-")
    base = os.path.join(d, "run")
    day = spark.range(30).select(F.col("id").alias("event_id"), F.lit("2024-01-01").cast("timestamp_ntz").alias("ts"), F.lit("view").alias("event_type"))
    day.coalesce(1).write.parquet(os.path.join(d, "in", "b1"))
    go = lambda: rate_stream.run_to_parquet(rate_stream.rating_stream(
        spark.readStream.schema(day.schema).parquet(os.path.join(d, "in", "b*"))), base)
    assert spark.read.parquet(go()).count() == 30
    assert spark.read.parquet(go()).count() == 30
    day.withColumn("event_id", F.col("event_id") + 30).coalesce(1).write.parquet(os.path.join(d, "in", "b2"))
    out = spark.read.parquet(go())
    assert sorted(r.event_id for r in out.collect()) == list(range(60))


def test_cluster_without_shared_folder_is_an_error():
    from ratewise.session import ensure_checkpoint_dir

    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return Conf()

    class Session:
        sparkContext, conf = Context(), Conf()
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(Session())


def test_null_and_nan_probabilities_count_as_zero(spark):
    from ratewise.functions import severity as V
    df = spark.createDataFrame([(None,), ([float("nan")] * 4,), ([None] * 4,)], "p array<double>")
    out = df.select(*[c.alias(n) for n, c in V.category_percentages("p").items()], V.csi_probability("p").alias("csi"))
    assert all(tuple(r) == (0.0,) * 5 for r in out.collect())


def test_tables_are_removed(spark):
    from ratewise import session
    df = session.write_table(spark.range(5), "gone")
    path = df.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    assert os.path.isdir(path) and session.remove_tables(spark) >= 1 and not os.path.exists(path)


def test_oracle_imports_nothing_under_test():
    import re
    from ratewise.plans import oracle, oracle_rules
    for module in (oracle, oracle_rules):
        with open(module.__file__) as f:
            assert set(re.findall(r"^(?:from|import) (ratewise\S*)", f.read(), re.M)) <= {"ratewise.plans"}
