r"""Operator 10: benchmark decontamination (DataFrame functions only).

Words are ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` of the text with A-Z lower-cased.
A benchmark item's windows are its runs of ``width`` words, or all its words
if it has fewer.  The distinct window hashes form a hash set that is broadcast
after its size has been checked; beyond the bound the same join shuffles the
window hashes of the documents and builds its tables from the benchmark's side.

One pass tokenises the documents: it explodes a row's window hashes, keeps
those found in the set and one mark per row (its id and word count), and
writes both as a table of small rows.  Only keys, positions and hashes are
exploded, never the words.  The texts of rows with a found hash are read again
and each hit is confirmed word by word.

Cases: null and empty texts have no words and no hits; items without words have
no windows; repeated rows each get the same result; rows are told apart by id
and text, so a repeated id does no harm; an empty table or benchmark gives no
hits; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import once, row_key, scratch

WIDTH = 10
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TOKEN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Largest window set that is broadcast; three numbers a window.
MAX_BROADCAST_WINDOWS = 200_000


def token_array(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(TOKEN), F.lit(0))


def _window_hash(words: str, start: str, width: int) -> str:
    return "xxhash64(" + ", ".join(f"{words}[{start} + {j}]" for j in range(width)) + ")"


def _windows(words: str, n: str, width: int) -> str:
    """Hash of each run of ``width`` words."""
    return (f"case when {n} < {width} then cast(array() as array<bigint>) else "
            f"transform(sequence(0, {n} - {width}), i -> {_window_hash(words, 'i', width)}) end")


def item_windows(benchmark: DataFrame, width: int = WIDTH, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, k, h, words): every window of every item."""
    items = benchmark.select(F.col(id_col).alias("item"), token_array(F.col(text_col)).alias("w")).filter("size(w) > 0")
    short = " ".join(f"when {k} then {_window_hash('w', '0', k)}" for k in range(1, width))
    whole = items.filter(f"size(w) < {width}").select("item", F.size("w").alias("k"), F.expr(f"case size(w) {short} end").alias("h"), F.col("w").alias("words"))
    runs = (items.filter(f"size(w) >= {width}")
            .select("item", "w", F.posexplode(F.expr(f"transform(sequence(0, size(w) - {width}), i -> {_window_hash('w', 'i', width)})")).alias("i", "h"))
            .select("item", F.lit(width).alias("k"), "h", F.slice("w", F.col("i") + 1, width).alias("words")))
    return whole.unionByName(runs)


def window_table(benchmark: DataFrame, width: int = WIDTH, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, k, h, wid, words), written once; ``wid`` names the window."""
    return scratch(item_windows(benchmark, width, id_col, text_col).select("item", "k", "h", F.xxhash64("k", "words").alias("wid"), "words"),
                   "benchmark-windows")


def scan(docs: DataFrame, windows: DataFrame, id_col: str = "doc_id", text_col: str = "text", marks: bool = False,
         max_broadcast: int = MAX_BROADCAST_WINDOWS) -> DataFrame:
    """(id, k1, k2, n, at, k, wid), written once: every place ``at`` of a row of
    ``n`` words whose window hash is in the set.  With ``marks``, one more row
    for each input row, with a null ``wid``."""
    known = windows.groupBy("h", "k", "wid").agg(F.lit(True).alias("__found"))
    lengths = sorted(r.k for r in windows.select("k").distinct().collect())  # at most ``width`` numbers
    small = known.limit(max_broadcast + 1).count() <= max_broadcast
    known = F.broadcast(known) if small else known.hint("shuffle_hash")
    texts = (docs.select(F.col(id_col).alias("id"), *row_key(F.col(id_col), F.col(text_col)), once(token_array(F.col(text_col))).alias("w"))
             .withColumn("n", F.size("w")))
    # the hashes of all window lengths one after the other, then the row's mark
    parts = [_windows("w", "n", k) for k in lengths] + (["array(cast(null as bigint))"] if marks else [])
    hashes = f"concat({', '.join(parts)})" if parts else "cast(array() as array<bigint>)"
    # posexplode_outer: the plain form would add a filter that hashes every window a second time
    runs = (texts.select("id", "k1", "k2", "n", F.expr(hashes).alias("hs"))
            .select("id", "k1", "k2", "n", F.posexplode_outer("hs").alias("pos", "h")))
    found = runs.join(known, "h", "left").filter(F.col("__found") | (F.col("h").isNull() & F.col("pos").isNotNull()))
    before = "".join(f" when {k} then {' + '.join([f'greatest(n - {j} + 1, 0)' for j in lengths if j < k] or ['0'])}" for k in lengths)
    at = F.expr(f"cast(pos - case k{before} end as int)") if lengths else F.lit(None).cast("int")
    out = found.select("id", "k1", "k2", "n", at.alias("at"), "k", "wid")
    # a hash that meets one of another length stands outside its own places
    return scratch(out.filter("wid is null or (at >= 0 and at <= n - k)"), "benchmark-hits")


def confirmed(docs: DataFrame, windows: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per distinct row with a confirmed hit: k1, k2, spans (word positions),
    wids (windows).  A row has as many spans as words at most."""
    names = windows.groupBy("wid", "k", "words").agg(F.lit(1).alias("__one")).drop("__one")
    places = (found.filter("wid is not null").select("k1", "k2", "at", "wid").join(names, "wid")
              .groupBy("k1", "k2").agg(F.collect_set(F.struct("at", "k", "wid", "words")).alias("places")))
    keys = found.filter("wid is not null").select("k1", "k2").distinct()
    # the keys are few unless the corpus is contaminated throughout: Spark takes the join by their size
    texts = (docs.select(*row_key(F.col(id_col), F.col(text_col)), F.col(text_col).alias("__text")).join(keys, ["k1", "k2"], "left_semi")
             .groupBy("k1", "k2").agg(F.first("__text").alias("__text")))
    same = "filter(places, x -> slice(w, x.at + 1, x.k) = x.words)"
    return (places.join(texts, ["k1", "k2"]).withColumn("w", once(token_array(F.col("__text"))))
            .select("k1", "k2", once(F.expr(same)).alias("hits"))
            .select("k1", "k2", F.expr("array_distinct(transform(hits, x -> struct(x.at as pos, x.k as k)))").alias("spans"),
                    F.expr("array_distinct(transform(hits, x -> x.wid))").alias("wids"))
            .filter(F.size("spans") > 0))


def contaminated_rows(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text",
                      item_col: str = "item_id", item_text: str = "text", max_broadcast: int = MAX_BROADCAST_WINDOWS) -> DataFrame:
    """``confirmed`` of one scan."""
    windows = window_table(benchmark, width, item_col, item_text)
    return confirmed(docs, windows, scan(docs, windows, id_col, text_col, False, max_broadcast), id_col, text_col)


COVERED = "array_distinct(flatten(transform(spans, s -> sequence(s.pos, s.pos + s.k - 1))))"


def decontamination_rows(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text",
                         item_col: str = "item_id", item_text: str = "text", max_broadcast: int = MAX_BROADCAST_WINDOWS) -> DataFrame:
    """The contract's columns: one row per document."""
    windows = window_table(benchmark, width, item_col, item_text)
    found = scan(docs, windows, id_col, text_col, True, max_broadcast)
    bad = scratch(confirmed(docs, windows, found, id_col, text_col), "contaminated")
    owners = windows.select("wid", F.col("item").cast("string").alias("item")).distinct()
    items = (bad.select("k1", "k2", F.explode("wids").alias("wid")).join(owners, "wid")
             .groupBy("k1", "k2").agg(F.sort_array(F.collect_set("item")).alias("items")))
    # positions are covered at most ``width`` times each
    bad = bad.select("k1", "k2", F.expr(f"cast(size({COVERED}) as bigint)").alias("n_hit")).join(items, ["k1", "k2"])
    out = found.filter("wid is null").select("id", "k1", "k2", "n").join(bad, ["k1", "k2"], "left")
    return out.select(
        F.col("id").alias(id_col), F.col("n").cast("long").alias("n_words"), F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("items_sha256"),
        F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, **names: str) -> DataFrame:
    """The documents without any hit, all columns kept (the row travels as one
    struct, so none can clash)."""
    id_col, text_col = names.get("id_col", "doc_id"), names.get("text_col", "text")
    bad = contaminated_rows(docs, benchmark, width, **names).select("k1", "k2")
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), *row_key(F.col(id_col), F.col(text_col)))
    return packed.join(bad, ["k1", "k2"], "left_anti").select("__row.*")


def remove_spans(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, **names: str) -> DataFrame:
    """id and ``text`` as its words without those inside a hit, joined by one
    space (the normalised words: the span form for n-gram counting)."""
    id_col, text_col = names.get("id_col", "doc_id"), names.get("text_col", "text")
    bad = contaminated_rows(docs, benchmark, width, **names).select("k1", "k2", F.expr(COVERED).alias("cut"))
    every = docs.select(F.col(id_col).alias("__id"), *row_key(F.col(id_col), F.col(text_col)), token_array(F.col(text_col)).alias("w"))
    left = F.expr("transform(array_except(sequence(0, size(w)), array_union(cut, array(size(w)))), i -> w[i])")
    return (every.join(bad, ["k1", "k2"], "left")
            .select(F.col("__id").alias(id_col), F.array_join(F.when(F.col("cut").isNull(), F.col("w")).otherwise(left), " ").alias("text")))
