"""Operator 4: secret scan with a token-efficiency test.

Pattern kinds (``assign``, ``access``, ``hex``) find secrets with a known
shape.  The test finds those without one: a vocabulary learned from natural
text packs a word into few tokens and a random string into many, so a run of
credential characters with few characters per token is flagged (``random``).
Runs that are known digests or identifiers are not tested, and what a base span
covers is not tested again: the rest of its run is.  Map-only: one Arrow pass,
no shuffle; the vocabulary is a fixed file.

Cases: null and empty texts have no spans; repeated rows each get the same
result; texts of any length are scanned whole; an empty table gives no rows;
other columns are ignored by ``secret_rows`` and carried by ``redact``.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pack, per_text, spans_text, unpack, vocabulary

# Fixed values of the contract: kinds in order, patterns, least lengths.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 12, 18, 16

#: The method's parameters: least length of a tested run, and the highest
#: characters-per-token ratio that counts as random: the stricter one for runs
#: shorter than SHORT or without a digit (or a letter), among which words lie.
RANDOM_LEAST = 16
RANDOM_RATIO = 2.0
STRICT_RATIO = 1.7
SHORT = 20
DIGEST_LENGTHS = (32, 40, 48, 56, 64, 96, 128)

_assign = re.compile(ASSIGN)
_run = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
_access = re.compile(r"AKIA[A-Z0-9]{%d,}" % (ACCESS_LEAST - 4))
_hex = re.compile(r"[0-9a-f]{%d,}" % HEX_LEAST)
_digest = re.compile(r"(?:[0-9a-f]+|[0-9A-F]+)=*")
_uuid = re.compile(r"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
_part = re.compile(r"[A-Za-z]+|[0-9]+")
_join, _named = re.compile(r"[-_/+=]+"), re.compile(r"[A-Za-z]*[0-9]*")
_digit, _letter = re.compile(r"[0-9]"), re.compile(r"[A-Za-z]")


def known(run: str, count_tokens: Callable[[list[str]], list[int]], ratio: float = STRICT_RATIO) -> bool:
    """Digests, UUIDs, and identifiers: words and numbers joined by - _ / + =
    that have more than ``ratio`` characters a token themselves."""
    run = run.strip("-_/+=")
    if _uuid.fullmatch(run) or (_digest.fullmatch(run) and len(run) in DIGEST_LENGTHS):
        return True
    joined = _join.split(run)
    if len(joined) == 1:
        return not run
    if not all(_named.fullmatch(p) for p in joined):
        return False
    # a single character is a token whatever it is part of
    parts = [p for p in _part.findall(run) if len(p) > 1]
    return sum(map(len, parts)) > ratio * sum(count_tokens(parts)) if parts else True


def pieces(a: int, b: int, spans: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """What the spans (start, kind, end) leave of [a, b)."""
    out = []
    for s, _, e in sorted(spans):
        if s > a:
            out.append((a, min(s, b)))
        a = max(a, e)
    return [p for p in [*out, (a, b)] if p[0] < p[1]]


def tiktoken_encoder(vocabulary_text: str) -> Callable[[list[str]], list[int]]:
    """Token counts of strings under a tiktoken rank file's content."""
    import public_tokenizers
    import tiktoken
    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in vocabulary_text.splitlines() if line)}
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return lambda strings: [len(encoding.encode_ordinary(s)) for s in strings]


def scan(text: str, count_tokens: Callable[[list[str]], list[int]],
         ratio: float = RANDOM_RATIO, least: int = RANDOM_LEAST) -> list[tuple[str, int, int]]:
    """All spans of a text (code points, end exclusive), by start then kind."""
    spans: list[tuple[int, int, int]] = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        spans += [(m.start(), 0, m.end()) for m in _assign.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    runs = []
    # every other kind lies inside a run of credential characters
    for m in _run.finditer(text):
        a, run = m.start(), m[0]
        spans += [(a + x.start(), 1, a + x.end()) for x in _access.finditer(run)]
        spans += [(a + x.start(), 2, a + x.end()) for x in _hex.finditer(run)]
        runs.append((a, m.end()))
    tested = []
    for a, b in runs:
        if b - a < least or known(text[a:b], count_tokens):
            continue
        touching = [s for s in spans if a < s[2] and s[0] < b]
        for x, y in pieces(a, b, touching):
            # the sign that joins the rest to a span is not part of it
            x += x > a and bool(_join.match(text[x]))
            y -= y < b and y > x and bool(_join.match(text[y - 1]))
            if y - x >= least and not (touching and known(text[x:y], count_tokens)):
                tested.append((x, y, text[x:y]))
    if tested:
        for (a, b, run), n in zip(tested, count_tokens([t[2] for t in tested])):
            strict = len(run) < SHORT or not (_digit.search(run) and _letter.search(run))
            if len(run) <= (min(ratio, STRICT_RATIO) if strict else ratio) * n:
                spans.append((a, 3, b))
    return [(KINDS[k], a, b) for a, k, b in sorted(spans)]


def base_digest(spans: list[tuple[str, int, int]]) -> str:
    return hashlib.sha256(spans_text([s for s in spans if s[0] != "random"]).encode()).hexdigest()


def _scanner(docs: DataFrame, path: str | None, ratio: float, least: int) -> Callable:
    with open(path or vocabulary("byte_bpe_50k.tiktoken")) as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())  # one fixed file, under 1 MB

    def factory() -> Callable[[list[str]], list[list[tuple[str, int, int]]]]:
        made: list[Callable] = []

        def count(strings: list[str]) -> list[int]:
            if not made:  # built at the first candidate of a task
                made.append(tiktoken_encoder(shared.value))
            return made[0](strings)

        return lambda texts: [scan(t, count, ratio, least) for t in texts]

    return factory


def secret_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None,
                ratio: float = RANDOM_RATIO, least: int = RANDOM_LEAST) -> DataFrame:
    """The contract's columns, then ``n_random``."""
    scanner = _scanner(docs, path, ratio, least)

    def factory() -> Callable[[list[str]], list[pa.Array]]:
        find = scanner()

        def work(texts: list[str]) -> list[pa.Array]:
            found = find(texts)
            count = lambda kind: pa.array([sum(s[0] == kind for s in f) for f in found], pa.int64())
            return [count("assign"), count("access"), count("hex"), pa.array(map(base_digest, found), pa.string()),
                    pa.array(map(spans_text, found), pa.string()), count("random")]
        return work

    return per_text(docs, id_col, text_col, factory,
                    "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_random long")


def masked(text: str, spans: list[tuple[str, int, int]], mark: str) -> str:
    out, at = [], 0
    for _, a, b in spans:
        if b <= at:
            continue
        if a >= at:
            out += [text[at:a], mark]
        at = b
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, text_col: str = "text", length_col: str = "n_chars", mark: str = "[SECRET]",
           path: str | None = None, ratio: float = RANDOM_RATIO, least: int = RANDOM_LEAST) -> DataFrame:
    """``docs`` with every span replaced by ``mark`` and the length column, if
    there is one, set anew for changed texts; null texts stay null."""
    scanner = _scanner(docs, path, ratio, least)

    def factory() -> Callable[[list[str]], list[pa.Array]]:
        find = scanner()
        return lambda texts: [pa.array([masked(t, f, mark) if f else None for t, f in zip(texts, find(texts))], pa.string())]

    new = per_text(pack(docs, text_col), "__row", "__text0", factory, "__new string")
    replaced = {text_col: F.coalesce("__new", F.col(f"__row.`{text_col}`"))}
    if length_col in docs.columns:
        kind = docs.schema[length_col].dataType
        replaced[length_col] = F.when(F.col("__new").isNull(), F.col(f"__row.`{length_col}`")).otherwise(F.length("__new").cast(kind))
    return unpack(new, replaced)
