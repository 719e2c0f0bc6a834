"""Operator 1: token counts of whole texts by a map-side two-tier lookup.

A text is cut where the vocabulary's own pre-tokenizer must cut: before a
space that leads a run of other characters, and around white-space runs.  The
token count of such a pre-token does not depend on its neighbours.

Tier 1 is a broadcast table (pre-token -> length) of the most frequent
pre-tokens, at most ``table_size`` of them, from counts over all texts: each
task keeps one bounded list of its most frequent ones, and whole lists are
merged, group of tasks by group of tasks, until ``FAN`` are left.  Tier 2 is a
bounded cache in each worker; its misses are encoded in batches by the
tokenizers library.  No exchange is keyed by pre-tokens, and the tables change
speed only: every length comes from the library.

Cases: null and empty texts have 0 bytes and 0 tokens; the special string
inside a text is one token, as the library has it; a pre-token of any length
is encoded whole (long ones are not cached); repeated rows each get their
count; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import per_text, slices, vocabulary

LIMIT = 512
TABLE_SIZE = 65_536     # entries of tier 1
PER_TASK = 8_192        # entries a task proposes for it
FAN = 32                # lists merged at once
COUNTED = 400_000       # distinct pre-tokens a task counts before it drops the rare ones
CACHED = 400_000        # entries of tier 2 in a worker
LONGEST = 64            # characters of a pre-token that either table holds

#: White space as the tokenizers library has it (Unicode White_Space).
WHITE = "\t-\r \x85\xa0  -     　"
PRE_TOKEN = re.compile(f" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")


def special_strings(tokenizer_json: str) -> list[str]:
    return sorted((t["content"] for t in json.loads(tokenizer_json).get("added_tokens", [])), key=len, reverse=True)


def splitter(specials: list[str]) -> Callable[[str], tuple[list[str], int]]:
    """text -> (its pre-tokens, number of special strings in it)."""
    find = PRE_TOKEN.findall
    if not specials:
        return lambda text: (find(text), 0)
    cut = re.compile("|".join(map(re.escape, specials)))

    def split(text: str) -> tuple[list[str], int]:
        if not cut.search(text):
            return find(text), 0
        parts = cut.split(text)
        return [p for part in parts for p in find(part)], len(parts) - 1
    return split


def frequent(docs: DataFrame, text_col: str, specials: list[str], table_size: int = TABLE_SIZE) -> list[str]:
    """The most frequent pre-tokens of all texts (each task's own list is cut
    at ``PER_TASK``, a merged one at ``table_size``, so the sums are close lower
    bounds)."""
    split = splitter(specials)

    def row(part: int, top: list[tuple[str, int]]) -> dict[str, pa.Array]:
        return {"part": pa.array([part], pa.int32()), "p": pa.array([[k for k, _ in top]], pa.list_(pa.string())),
                "n": pa.array([[n for _, n in top]], pa.list_(pa.int64()))}

    def merged(table: pa.Table) -> pa.Table:
        total: Counter[str] = Counter()
        for keys, counts in zip(table.column("p").to_pylist(), table.column("n").to_pylist()):
            total.update(dict(zip(keys, counts)))
        return pa.table(row(table.column("part")[0].as_py(), sorted(total.items(), key=lambda x: (-x[1], x[0]))[:table_size]))

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        for batch in batches:
            for part in slices(batch, "__text"):
                for text in part.column("__text").to_pylist():
                    if text:
                        seen.update(split(text)[0])
                if len(seen) > COUNTED:
                    seen = Counter({k: n for k, n in seen.items() if n > 1} if len(seen) < 4 * COUNTED else dict(seen.most_common(COUNTED)))
        top = [(k, n) for k, n in seen.most_common(PER_TASK) if n > 1 and len(k) <= LONGEST]
        yield pa.RecordBatch.from_pydict(row(TaskContext.get().partitionId(), top))

    schema, source = "part int, p array<string>, n array<long>", docs.select(F.col(text_col).alias("__text"))
    lists, left = source.mapInArrow(heads, schema), source.rdd.getNumPartitions()
    while left > FAN:
        lists = lists.withColumn("part", (F.col("part") / FAN).cast("int")).groupBy("part").applyInArrow(lambda t: merged(t), schema)
        left = -(-left // FAN)
    held = lists.toArrow()  # at most FAN lists
    return merged(held).column("p")[0].as_py() if held.num_rows else []


def lengths(tokenizer_json: str, specials_counted: bool = True) -> Callable[[list[str]], list[int]]:
    """Batch encoder: token counts of pre-tokens, in this thread."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_str(tokenizer_json)
    tokenizer.no_padding()
    tokenizer.no_truncation()
    return lambda strings: [len(e) for e in tokenizer.encode_batch_fast(strings, add_special_tokens=False)]


def token_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None,
               limit: int = LIMIT, table_size: int = TABLE_SIZE) -> DataFrame:
    """id, n_bytes, n_tokens, over_limit."""
    with open(path or vocabulary("byte_bpe_50k.json"), encoding="utf-8") as f:
        tokenizer_json = f.read()
    specials = special_strings(tokenizer_json)
    keys = frequent(docs, text_col, specials, table_size)
    table = dict(zip(keys, lengths(tokenizer_json)(keys) if keys else []))
    sc = docs.sparkSession.sparkContext
    # at most table_size strings of LONGEST characters, and one vocabulary file
    shared_table, shared_json = sc.broadcast(table), sc.broadcast(tokenizer_json)

    def factory() -> Callable[[list[str]], list[pa.Array]]:
        encode, split = lengths(shared_json.value), splitter(specials)
        known = dict(shared_table.value)  # tier 1, then tier 2 behind it
        tier1 = len(known)

        def work(texts: list[str]) -> list[pa.Array]:
            nonlocal known
            cut = [split(t) for t in texts]
            missing = list(set().union(*[c for c, _ in cut]).difference(known)) if cut else []
            known.update(zip(missing, encode(missing)) if missing else ())
            get = known.__getitem__
            counts = [sum(map(get, c)) + n for c, n in cut]
            if len(known) > tier1 + CACHED:
                known = dict(shared_table.value)
            else:
                for p in missing:
                    if len(p) > LONGEST:
                        del known[p]
            return [pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(counts, pa.int64()),
                    pa.array([n > limit for n in counts], pa.bool_())]
        return work

    return per_text(docs, id_col, text_col, factory, "n_bytes long, n_tokens long, over_limit boolean")
