r"""Operator 6: near-duplicates by min-max hashing.

Words ``[^\x20\x09-\x0D]+`` of the text with A-Z lower-cased; a document's set
is its distinct ``WIDTH``-word shingles.  Documents with
100 * intersection >= 80 * union are linked; a component of links is a group.

1. One Arrow pass gives each row its set's size and fingerprint and, under each
   of ``PERMUTATIONS`` permutations, both the minimum and the maximum: two
   signature values per hash evaluation.
2. Rows with equal sets form a class; only its representative goes on.
3. Signatures are banded.  Each bucket's smallest class is its hub; bucket
   members are compared with the hub on their full sets (links are confirmed,
   never estimated), and the links give components.
4. Buckets that still hold several components are compared completely, block
   against block in bounded blocks, so no link is lost to the choice of hub.
   Pairs are made and confirmed inside a task; only links leave it.

At similarity 0.8 a pair shares no bucket with probability
(1 - 0.8**4)**32 = 5e-8, and falls below the signature cut with 1e-8.

Cases: null and empty texts and texts without words have no shingle and are
linked with nothing; a text of fewer words than a shingle is one shingle;
equal rows are one class; ids are integers that name a document, and a row
without id is in its texts' group but never gives the group its name; of a
group without any id the rows of the smallest row key are kept; an empty
table gives no rows; other columns are ignored (``drop_copies`` carries them).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as K
from .common import pack, row_key, scratch, slices, unpack
from .graph import components

WIDTH = 4
PERCENT = 80
PERMUTATIONS = 64
BANDS, ROWS = 32, 4           # 2 * PERMUTATIONS values
CUT = 0.6                     # least share of equal signature bytes of a compared pair
BLOCK = 256                   # classes of a block in step 4
#: Node numbers of classes whose rows all lack an id lie above this.
NAMELESS = 1 << 62

_rng = np.random.default_rng(20_240_601)
_MULTIPLY = _rng.integers(1, 1 << 63, PERMUTATIONS, dtype=np.uint64) | np.uint64(1)
_ADD = _rng.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64)


def shingle_sets(texts: pa.Array, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first): hashes[first[d]:first[d+1]] is text d's set, ascending."""
    data, offsets = K.flat(texts)
    data = K.lower_ascii(data)
    w = K.words(data, offsets)
    count = np.diff(w.first)
    h = K.Prefix(data).ranges(w.starts, w.ends)
    runs = K.chain(h, width)
    doc = np.repeat(np.arange(len(count)), count)
    # a shingle belongs to a text if its last word does
    whole = doc[:len(runs)] == doc[width - 1:] if len(runs) else np.zeros(0, bool)
    hashes, owner = [runs[whole]], [doc[:len(runs)][whole]]
    for m in range(1, width):  # shorter texts: the whole sequence
        short = np.flatnonzero(count == m)
        if len(short):
            at = w.first[:-1][short]
            acc = h[at]
            for j in range(1, m):
                acc = K.mix(acc * np.uint64(K._BASE) + h[at + j])
            hashes.append(K.mix(acc + np.uint64(m)))
            owner.append(short)
    flat, doc = np.concatenate(hashes), np.concatenate(owner)
    order = np.lexsort((flat, doc))
    flat, doc = flat[order], doc[order]
    if len(flat):
        new = np.ones(len(flat), bool)
        new[1:] = (flat[1:] != flat[:-1]) | (doc[1:] != doc[:-1])
        flat, doc = flat[new], doc[new]
    return flat, np.searchsorted(doc, np.arange(len(count) + 1))


def signatures(flat: np.ndarray, first: np.ndarray) -> np.ndarray:
    """(texts with a shingle) x (2 * PERMUTATIONS): minimum and maximum of the
    set under each permutation."""
    starts = first[:-1][np.diff(first) > 0]
    out = np.empty((len(starts), 2 * PERMUTATIONS), np.uint64)
    for p in range(PERMUTATIONS):
        x = flat * _MULTIPLY[p] + _ADD[p]
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        out[:, 2 * p] = np.minimum.reduceat(x, starts)
        out[:, 2 * p + 1] = np.maximum.reduceat(x, starts)
    return out


def _sign(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    names = ["id", "k1", "k2", "n", "f1", "f2", "bands", "sig"]
    for batch in batches:
        for part in slices(batch, "text"):
            flat, first = shingle_sets(part.column("text"), width)
            n = np.diff(first)
            some = n > 0
            f1, f2 = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
            bands, sig = np.zeros((len(n), BANDS), np.uint64), np.zeros((len(n), 2 * PERMUTATIONS), np.uint8)
            if some.any():
                starts = first[:-1][some]
                f1[some] = np.add.reduceat(K.mix(flat), starts)
                f2[some] = np.bitwise_xor.reduceat(K.mix(flat * np.uint64(0x9FB21C651E98DF25)), starts)
                values = signatures(flat, first)
                # a band mixes minima and maxima of different permutations
                rows = values.reshape(len(values), ROWS, BANDS).transpose(0, 2, 1)
                acc = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), rows.shape[:2])
                for r in range(ROWS):
                    acc = K.mix(acc * np.uint64(K._BASE) + rows[:, :, r])
                bands[some] = acc
                sig[some] = (K.mix(values) & np.uint64(255)).astype(np.uint8)
            lists = pa.ListArray.from_arrays(np.arange(0, BANDS * len(n) + 1, BANDS, dtype=np.int32), pa.array(bands.reshape(-1).view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), part.column("k1"), part.column("k2"), pa.array(n.astype(np.int64)), pa.array(f1.view(np.int64)),
                 pa.array(f2.view(np.int64)), lists, pa.array([r.tobytes() for r in sig], pa.binary())], names=names)


def _sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            flat, first = shingle_sets(part.column("text"), width)
            sets = [flat[a:b].tobytes() for a, b in zip(first[:-1], first[1:])]
            yield pa.RecordBatch.from_arrays([part.column("c"), pa.array(sets, pa.binary())], names=["c", "set"])


def _linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if 100 * len(a) < percent * len(b):
        return False
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    both = int((b[at] == a).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u, v = batch.column("u").to_pylist(), batch.column("v").to_pylist()
            a, b = batch.column("a"), batch.column("b")
            yes = [i for i in range(len(u)) if _linked(np.frombuffer(a[i].as_buffer(), np.uint64), np.frombuffer(b[i].as_buffer(), np.uint64), percent)]
            yield pa.RecordBatch.from_arrays([pa.array([u[i] for i in yes], pa.int64()), pa.array([v[i] for i in yes], pa.int64())], names=["u", "v"])
    return run


def _near(cut: float):
    """Keep the pairs whose signatures agree in a share of ``cut`` or more."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.frombuffer(b"".join(batch.column("s").to_pylist()), np.uint8).reshape(batch.num_rows, -1)
            y = np.frombuffer(b"".join(batch.column("t").to_pylist()), np.uint8).reshape(batch.num_rows, -1)
            keep = (x == y).mean(1) >= cut
            yield batch.select(["u", "v"]).filter(pa.array(keep))
    return run


def groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of complete key groups from batches sorted by ``key``: each table
    ends where a key ends, so a group is never torn."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        turns = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        if held and keys[0] != held[-1].column(key)[-1].as_py():
            yield pa.Table.from_batches(held)
            held = []
        if not len(turns):
            held.append(batch)
            continue
        last = int(turns[-1])
        yield pa.Table.from_batches([*held, batch.slice(0, last)])
        held = [batch.slice(last)]
    if held:
        yield pa.Table.from_batches(held)


def _blocks(percent: int, cut: float):
    """Complete comparison inside each block pair: links of different
    components, between the two sides (or inside the one, side 2)."""
    def links(side, comp, n, sig, sets) -> Iterator[tuple[int, int]]:
        for i in range(len(n) - 1):
            j = np.arange(i + 1, len(n))
            ok = (comp[j] != comp[i]) & ((side[j] != side[i]) | (side[i] == 2))
            ok &= 100 * np.minimum(n[j], n[i]) >= percent * np.maximum(n[j], n[i])
            j = j[ok]
            if len(j):
                j = j[(sig[j] == sig[i]).mean(1) >= cut]
            if not len(j):
                continue
            mine, sizes = sets[i], n[j]
            others = np.concatenate([sets[x] for x in j])
            at = np.searchsorted(mine, others)
            at[at == len(mine)] = 0
            both = np.add.reduceat((mine[at] == others).astype(np.int64), np.concatenate([[0], np.cumsum(sizes)[:-1]]))
            for x in j[100 * both >= percent * (n[i] + sizes - both)]:
                yield i, int(x)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, "pair"):
            key = table.column("pair").to_numpy()
            c, comp = table.column("c").to_numpy(), table.column("comp").to_numpy()
            side, n = table.column("side").to_numpy(), table.column("n").to_numpy()
            sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint8).reshape(len(c), -1)
            raw = table.column("set").to_pylist()
            u, v = [], []
            ends = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]])
            for a, b in zip(ends[:-1], ends[1:]):
                sets = [np.frombuffer(x, np.uint64) for x in raw[a:b]]
                for i, j in links(side[a:b], comp[a:b], n[a:b], sig[a:b], sets):
                    u.append(int(c[a + i]))
                    v.append(int(c[a + j]))
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])
    return run


def _signed(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    text = F.col(text_col)
    source = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), *row_key(F.col(id_col), text))
    return source.mapInArrow(lambda batches: _sign(batches, width), "id long, k1 long, k2 long, n long, f1 long, f2 long, bands array<long>, sig binary")


def _rest(members: DataFrame, comps: DataFrame, classes: DataFrame, sets: DataFrame, percent: int, cut: float, block: int) -> DataFrame:
    """Step 4: links between different components that share a bucket's hub."""
    m = members.join(comps.withColumnRenamed("node", "c"), "c", "left").select("hub", "c", F.coalesce("comp", "c").alias("comp"))
    open_hubs = m.groupBy("hub").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).filter("x < y").select("hub")
    m = scratch(m.join(open_hubs, "hub"), "open")
    # large components have blocks of their own, small ones share blocks
    sizes = m.groupBy("hub", "comp").agg(F.count("*").alias("rows")).withColumn("own", F.col("rows") > block)
    shared = sizes.filter("not own").groupBy("hub").agg(F.ceil(F.sum("rows") / block).cast("long").alias("parts"))
    place = (sizes.join(shared, "hub", "left").select(
        "hub", "comp", F.when(F.col("own"), F.col("comp")).alias("alone"),
        F.when(F.col("own"), F.ceil(F.col("rows") / block).cast("long")).otherwise(F.col("parts")).alias("parts")))
    dealt = m.join(place, ["hub", "comp"]).select(
        "hub", "c", "comp", "alone",
        F.pmod(F.when(F.col("alone").isNull(), F.xxhash64("comp")).otherwise(F.xxhash64("c")), F.col("parts")).alias("slot"))
    dealt = dealt.withColumn("block", F.xxhash64("hub", F.coalesce("alone", F.lit(-1)), "slot", F.col("alone").isNull()))
    blocks = dealt.groupBy("hub", "block").agg(F.first("alone").alias("alone"))
    a, b = blocks.alias("a"), blocks.alias("b")
    # pairs of blocks, not of rows; two blocks of one component need no check
    pairs = a.join(b, F.col("a.hub") == F.col("b.hub")).filter(
        (F.col("a.block") <= F.col("b.block")) & ~F.coalesce(F.col("a.alone") == F.col("b.alone"), F.lit(False)))
    pairs = pairs.select(F.xxhash64("a.block", "b.block").alias("pair"), F.explode(F.when(
        F.col("a.block") == F.col("b.block"), F.array(F.struct(F.col("a.block").alias("block"), F.lit(2).alias("side"))))
        .otherwise(F.array(F.struct(F.col("a.block").alias("block"), F.lit(0).alias("side")),
                           F.struct(F.col("b.block").alias("block"), F.lit(1).alias("side"))))).alias("x")).select("pair", "x.*")
    rows = (dealt.select("block", "c", "comp").join(pairs, "block")
            .join(classes.select("c", "n", "sig"), "c").join(sets, "c")
            .select("pair", "side", "c", "comp", "n", "sig", "set"))
    return rows.repartition("pair").sortWithinPartitions("pair").mapInArrow(_blocks(percent, cut), "u long, v long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT,
                    cut: float = CUT, block: int = BLOCK) -> DataFrame:
    """One row per document: id, n_shingles, component_id (smallest id of the
    group), kept, and the row key k1, k2.  The bands and the signature cut are
    made for a ``percent`` of ``PERCENT`` or more; a lower one is an error."""
    if percent < PERCENT:
        raise ValueError(f"the bands find pairs of {PERCENT} percent or more, not {percent}")
    signed = scratch(_signed(docs, id_col, text_col, width), "signed")
    # partial aggregation folds a class of any size before the exchange
    classes = scratch(
        signed.filter("n > 0").groupBy("f1", "f2", "n").agg(
            F.min("id").alias("low"), F.count("*").alias("rows"), F.min(F.struct("k1", "k2")).alias("key"),
            F.first("bands").alias("bands"), F.first("sig").alias("sig"))
        .select("f1", "f2", "n", "rows", "key.*", "bands", "sig",
                F.coalesce("low", F.shiftrightunsigned(F.xxhash64("f1", "f2", "n"), 2).bitwiseOR(F.lit(NAMELESS))).alias("c")), "classes")
    in_band = classes.select("c", F.explode("bands").alias("h"))
    hubs = in_band.groupBy("h").agg(F.min("c").alias("hub"), F.max("c").alias("top")).filter("hub < top").select("h", "hub")
    members = scratch(in_band.join(hubs, "h").groupBy("hub", "c").agg(F.lit(1).alias("x")).select("hub", "c"), "members")

    # full sets of the classes that share any bucket, from their texts
    wanted = members.select("c").distinct().join(classes.select("c", "k1", "k2"), "c")
    texts = docs.select(*row_key(F.col(id_col), F.col(text_col)), F.col(text_col).alias("text"))
    texts = texts.join(wanted, ["k1", "k2"]).groupBy("k1", "k2").agg(F.first("c").alias("c"), F.first("text").alias("text"))
    sets = scratch(texts.select("c", "text").mapInArrow(lambda batches: _sets(batches, width), "c long, set binary"), "sets")

    measure = classes.select("c", "n", "sig")
    pairs = (members.filter("hub <> c").select(F.col("hub").alias("u"), F.col("c").alias("v"))
             .join(measure.toDF("u", "n1", "s"), "u").join(measure.toDF("v", "n2", "t"), "v")
             .filter(100 * F.least("n1", "n2") >= percent * F.greatest("n1", "n2"))
             .select("u", "v", "s", "t").mapInArrow(_near(cut), "u long, v long"))
    links = (pairs.join(sets.toDF("v", "b"), "v").join(sets.toDF("u", "a"), "u")
             .select("u", "v", "a", "b").mapInArrow(_confirm(percent), "u long, v long"))
    comps = scratch(components(links), "components")

    more = scratch(_rest(members, comps, classes, sets, percent, cut, block).distinct(), "more-links")
    name = lambda side: comps.select(F.col("node").alias(side), F.col("comp").alias(f"{side}c"))
    more = (more.join(name("u"), "u", "left").join(name("v"), "v", "left")
            .select(F.coalesce("uc", "u").alias("u"), F.coalesce("vc", "v").alias("v")))
    joined = components(more)
    groups_ = (classes.select("f1", "f2", "n", "c", "rows", "k1", "k2").join(comps.withColumnRenamed("node", "c"), "c", "left")
               .withColumn("comp", F.coalesce("comp", "c"))
               .join(joined.select(F.col("node").alias("comp"), F.col("comp").alias("last")), "comp", "left")
               .select("f1", "f2", "n", "c", "rows", "k1", "k2", F.coalesce("last", "comp").alias("g")))
    # a class of one row that is its own group needs no lookup if it has an id
    groups_ = scratch(groups_.filter(f"rows > 1 or g <> c or g >= {NAMELESS}"), "groups")
    # a group without any id is kept by its smallest row key
    nameless = groups_.filter(F.col("g") >= NAMELESS)
    low = scratch(nameless.groupBy("g").agg(F.min(F.struct("k1", "k2")).alias("low")), "nameless")
    groups_ = (nameless.join(low, "g").select("f1", "f2", "n", "g", "low")
               .unionByName(groups_.filter(F.col("g") < NAMELESS).select("f1", "f2", "n", "g"), allowMissingColumns=True))
    out = signed.select("id", "k1", "k2", "n", "f1", "f2").join(groups_, ["f1", "f2", "n"], "left")
    group = F.when(F.col("g") >= NAMELESS, F.lit(None)).otherwise(F.coalesce("g", "id"))
    kept = F.when(F.col("low").isNotNull(), F.struct("k1", "k2") == F.col("low")).otherwise(F.col("id").eqNullSafe(group))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), group.alias("component_id"),
                      kept.alias("kept"), "k1", "k2")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One document of each group, with all its columns: the one whose id names
    the group, or the smallest row key if no row of the group has an id.  Of
    rows with the same id and text one stays."""
    gone = near_duplicates(docs, id_col, text_col, **options).filter("not kept").select("k1", "k2").distinct()
    keyed = pack(docs, text_col).select("*", *row_key(F.col(f"__row.`{id_col}`"), F.col("__text0"))).drop("__text0")
    left = keyed.join(gone, ["k1", "k2"], "left_anti").groupBy("k1", "k2").agg(F.first("__row").alias("__row"))
    return unpack(left)
