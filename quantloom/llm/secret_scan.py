"""Secret scans with a trigram index.

Each rule's pattern is parsed into a Boolean query over trigrams of lower-cased bytes that every
match must contain. For each run of documents an inverted index lists, for every trigram that
some query names, the documents that hold it; the lists are intersected and united as the query
says, and only the documents that remain are searched with the pattern. A rule whose query is
"anything" (it has no mandatory trigram) searches all documents.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import tidy
from .text import _LOWER, runs

try:  # the parser behind re, under its name since Python 3.11
    from re import _constants as _c
    from re import _parser as _p
except ImportError:  # pragma: no cover
    import sre_constants as _c
    import sre_parse as _p

#: A Boolean query: ("any",), ("none",), ("tri", bytes), ("and", frozenset), ("or", frozenset).
Query = tuple
ANY: Query = ("any",)
NONE: Query = ("none",)
#: Sets of exact strings larger than this are given up for the trigrams they imply.
MOST_STRINGS = 24


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches of ``pattern``, leftmost and not overlapping, whose ``group`` has ``least`` characters at least; other matches are dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1

    @cached_property
    def compiled(self) -> re.Pattern:
        return re.compile(self.pattern, re.ASCII)

    @cached_property
    def query(self) -> Query:
        return trigram_query(self.pattern)

    def spans(self, text: str) -> Iterator[tuple[int, int]]:
        for m in self.compiled.finditer(text):
            if len(m.group(self.group)) >= self.least:
                yield m.span()


#: The base kinds, in their order.
BASE = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""", group=2, least=12),
    Rule("access", r"AKIA[A-Z0-9]+", least=18),
    Rule("hex", r"(?<![0-9a-f])[0-9a-f]{16,}", least=16),  # the maximal runs of [0-9a-f]+ with 16 characters or more
)
#: Further kinds, by the published shapes of such keys.
MORE = (
    Rule(  # to the END line of the same label; a key that is cut off before it, as far as its headers and body go
        "private_key",
        r"-----BEGIN ([A-Z0-9 ]*)PRIVATE KEY-----(?:(?:(?!-----BEGIN )[\s\S])*?-----END \1PRIVATE KEY-----"
        r"|(?:[ \t\r]*\n(?:Proc-Type|DEK-Info|Content-Domain|Comment|Version):[^\n]*)*[A-Za-z0-9+/=\s]*)",
    ),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
RULES = BASE + MORE


def _and(*parts: Query) -> Query:
    flat: set[Query] = set()
    for q in parts:
        if q == NONE:
            return NONE
        if q != ANY:
            flat |= q[1] if q[0] == "and" else {q}
    return ANY if not flat else next(iter(flat)) if len(flat) == 1 else ("and", frozenset(flat))


def _or(*parts: Query) -> Query:
    flat: set[Query] = set()
    for q in parts:
        if q == ANY:
            return ANY
        if q != NONE:
            flat |= q[1] if q[0] == "or" else {q}
    return NONE if not flat else next(iter(flat)) if len(flat) == 1 else ("or", frozenset(flat))


def _of_string(s: bytes) -> Query:
    return _and(*[("tri", s[k : k + 3]) for k in range(len(s) - 2)])


@dataclass
class _Info:
    """What is known of a part of a pattern: all strings it can match, or else the possible beginnings and ends of a match; and a query that holds for every match."""

    exact: set[bytes] | None = None
    prefix: set[bytes] = field(default_factory=lambda: {b""})
    suffix: set[bytes] = field(default_factory=lambda: {b""})
    query: Query = ANY

    @property
    def starts(self) -> set[bytes]:
        return self.exact if self.exact is not None else self.prefix

    @property
    def ends(self) -> set[bytes]:
        return self.exact if self.exact is not None else self.suffix


def _cut(strings: set[bytes], front: bool) -> set[bytes]:
    cut = {s[:2] if front else s[-2:] for s in strings}
    return cut if len(cut) <= MOST_STRINGS else {b""}


def _given_up(info: _Info) -> _Info:
    if info.exact is None:
        return info
    implied = _or(*[_of_string(s) for s in info.exact])
    return _Info(None, _cut(info.exact, True), _cut(info.exact, False), _and(info.query, implied))


def _join(a: _Info, b: _Info) -> _Info:
    if a.exact is not None and b.exact is not None and len(a.exact) * len(b.exact) <= MOST_STRINGS:
        return _Info({x + y for x in a.exact for y in b.exact}, query=_and(a.query, b.query))
    ends, starts = a.ends, b.starts
    across = ANY
    if len(ends) * len(starts) <= MOST_STRINGS**2:
        across = _or(*[_of_string(x[-2:] + y[:2]) for x in ends for y in starts])
    left, right = _given_up(a), _given_up(b)
    prefix = {x + y for x in a.exact for y in starts} if a.exact is not None else left.prefix
    suffix = {x + y for x in ends for y in b.exact} if b.exact is not None else right.suffix
    return _Info(None, _cut(prefix, True), _cut(suffix, False), _and(left.query, right.query, across))


def _either(a: _Info, b: _Info) -> _Info:
    if a.exact is not None and b.exact is not None and len(a.exact | b.exact) <= MOST_STRINGS:
        return _Info(a.exact | b.exact, query=_or(a.query, b.query) if ANY not in (a.query, b.query) else ANY)
    a, b = _given_up(a), _given_up(b)
    return _Info(None, _cut(a.prefix | b.prefix, True), _cut(a.suffix | b.suffix, False), _or(a.query, b.query))


_EMPTY, _UNKNOWN = _Info({b""}), _Info()


def _low(code: int) -> bytes:
    return chr(code).encode().lower()


def _parsed(parts: Iterable) -> _Info:
    out = _EMPTY
    for op, value in parts:
        if op is _c.LITERAL:
            info = _Info({_low(value)})
        elif op is _c.IN and all(x[0] is _c.LITERAL for x in value):
            info = _Info({_low(x[1]) for x in value})
            info = info if len(info.exact) <= MOST_STRINGS else _UNKNOWN
        elif op is _c.SUBPATTERN:
            info = _parsed(value[-1])
        elif op is _c.BRANCH:
            options = [_parsed(x) for x in value[1]]
            info = options[0]
            for x in options[1:]:
                info = _either(info, x)
        elif op in (_c.MAX_REPEAT, _c.MIN_REPEAT, getattr(_c, "POSSESSIVE_REPEAT", None)):
            least, most, body = value
            inner = _parsed(body)
            if (least, most) == (0, 1):
                info = _either(inner, _EMPTY)
            elif least == 0:
                info = _UNKNOWN
            else:
                info = inner
                for _ in range(min(least, 4) - 1):
                    info = _join(info, inner)
                if most != least or least > 4:
                    info = _given_up(info)
                    info = _Info(None, info.prefix, _given_up(inner).suffix, info.query)
        elif op is _c.AT or op in (_c.ASSERT, _c.ASSERT_NOT):
            info = _EMPTY
        else:
            info = _UNKNOWN
        out = _join(out, info)
    return out


def trigram_query(pattern: str) -> Query:
    """A query over trigrams of the lower-cased text's bytes that every text with a match satisfies."""
    return _given_up(_parsed(_p.parse(pattern))).query


def _named(query: Query) -> set[bytes]:
    return {query[1]} if query[0] == "tri" else set().union(*map(_named, query[1])) if query[0] in ("and", "or") else set()


class Index:
    """Postings of the trigrams that some rule names, for one run of documents at a time."""

    def __init__(self, rules: Iterable[Rule]):
        self.codes = sorted({int.from_bytes(t, "big") for r in rules for t in _named(r.query)})
        self.wanted = np.zeros(1 << 24, bool)
        self.wanted[self.codes] = True

    def postings(self, data: np.ndarray, bounds: np.ndarray) -> dict[bytes, np.ndarray]:
        """Trigram: sorted numbers of the documents in ``data`` that hold it."""
        low = _LOWER[data].astype(np.uint32)
        if len(low) < 3:
            return {}
        code = (low[:-2] << 16) | (low[1:-1] << 8) | low[2:]
        at = np.flatnonzero(self.wanted[code])
        doc = np.searchsorted(bounds, at, side="right") - 1
        whole = at + 3 <= bounds[doc + 1]
        pair = np.unique((code[at[whole]].astype(np.uint64) << np.uint64(32)) | doc[whole].astype(np.uint64))
        own, doc = (pair >> np.uint64(32)).astype(np.int64), (pair & np.uint64(0xFFFFFFFF)).astype(np.int64)
        cuts = np.flatnonzero(np.diff(own)) + 1
        return {int(c[0]).to_bytes(3, "big"): d for c, d in zip(np.split(own, cuts), np.split(doc, cuts), strict=True) if len(c)}


def candidates(query: Query, postings: dict[bytes, np.ndarray], n: int) -> np.ndarray:
    """Documents among 0..n-1 that satisfy the query."""
    none = np.zeros(0, np.int64)
    if query == ANY:
        return np.arange(n)
    if query[0] == "tri":
        return postings.get(query[1], none)
    if query[0] == "none":
        return none
    lists = sorted((candidates(q, postings, n) for q in query[1]), key=len)
    out = lists[0]
    for more in lists[1:]:
        if query[0] == "and" and not len(out):
            break
        out = np.intersect1d(out, more, assume_unique=True) if query[0] == "and" else np.union1d(out, more)
    return out


def scan(texts: pa.Array, rules: tuple[Rule, ...] = RULES, index: Index | None = None) -> list[list[tuple[int, int, str]]]:
    """Per text its spans (start, end, kind), in code points, by start and then in the rules' order; null counts as empty."""
    index = index or Index(rules)
    found: list[list[tuple[int, int, int]]] = [[] for _ in range(len(texts))]
    for first, last, data, bounds in runs(texts):
        postings = index.postings(data, bounds)
        decoded: dict[int, str] = {}
        for order, rule in enumerate(rules):
            for k in candidates(rule.query, postings, last - first):
                if k not in decoded:
                    decoded[k] = data[bounds[k] : bounds[k + 1]].tobytes().decode("utf-8", "replace")
                found[first + k] += [(start, end, order) for start, end in rule.spans(decoded[k])]
    return [[(s, e, rules[o].kind) for s, e, o in sorted(x, key=lambda y: (y[0], y[2]))] for x in found]


SPANS = "array<struct<start:bigint,end:bigint,kind:string>>"


def secret_spans(documents: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``documents`` with ``spans``, an array of (start, end, kind); a column of that name is replaced.

    Every text is searched whole, however long; null and empty texts have no spans; repeated rows
    are searched each for itself; an empty table gives an empty result. Other columns are carried.
    """
    kept = documents.drop("spans")
    schema = kept.withColumn("spans", F.lit(None).cast(SPANS)).schema
    at = kept.columns.index("text")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(rules)
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))
        for batch in batches:
            spans = [[{"start": s, "end": e, "kind": k} for s, e, k in x] for x in scan(batch.column(at), rules, index)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(spans, kind)], names=[*batch.schema.names, "spans"])

    return kept.mapInArrow(tidy(search), schema)


def redacted(documents: DataFrame, rules: tuple[Rule, ...] = RULES, mark: str = "[SECRET]") -> DataFrame:
    """``documents`` with each stretch of secrets in ``text`` replaced by ``mark``; overlapping spans are one stretch.

    Texts without secrets, null and empty ones too, are left as they are; other columns are carried.
    """
    at = documents.columns.index("text")

    def replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(rules)
        for batch in batches:
            texts, spans = batch.column(at).to_pylist(), scan(batch.column(at), rules, index)
            for k, found in enumerate(spans):
                if found:
                    parts, end = [], 0
                    for s, e, _ in found:
                        if s >= end:
                            parts += [texts[k][end:s], mark]
                        end = max(end, e)
                    texts[k] = "".join(parts) + texts[k][end:]
            columns = list(batch.columns)
            columns[at] = pa.array(texts, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return documents.mapInArrow(tidy(replace), documents.schema)
