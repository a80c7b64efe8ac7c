"""Secret scans over a trigram inverted index.

Each rule's regular expression is turned into a Boolean query over trigrams
that every match must contain. A block of documents gets an inverted index
(trigram -> documents) of the trigrams that some query mentions; a rule's
candidates are the union of the intersections of its postings, and only they
are verified with the expression. A rule without a mandatory trigram (long hex
runs) scans every document of the block.

Blocks are independent, so nothing is shuffled and a hot source changes
nothing; a lost task is simply run again. NULL and empty texts have no spans.
Repeated rows give repeated results.
Texts are scanned whole, however long; one expression goes back over a long run that almost fits, which takes the
square of the run's length. An empty table gives no rows. Only the id and the text are read (`redact` keeps all
columns and replaces the text), so other columns cannot clash.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import product
from re import _constants as sre
from re import _parser as parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlark.llm.common import claim, narrow, pieces

BLOCK_BYTES = 4_000_000
#: Alternatives that a derived query may have; a larger one is weakened, never wrong.
MAX_TERMS = 64


@dataclass(frozen=True)
class Rule:
    """A kind of secret. Matches of `pattern` shorter than the lengths given are dropped.

    scan: an expression with the same remaining matches that is faster to search.
    """

    kind: str
    pattern: str
    least: int = 0
    least_group: tuple[int, int] | None = None
    scan: str | None = None
    compiled: re.Pattern = field(init=False, compare=False, repr=False)

    def __post_init__(self) -> None:
        object.__setattr__(self, "compiled", re.compile(self.scan or self.pattern))

    def spans(self, text: str) -> list[tuple[int, int]]:
        found = []
        for m in self.compiled.finditer(text):
            if m.end() - m.start() < self.least:
                continue
            if self.least_group and len(m[self.least_group[0]]) < self.least_group[1]:
                continue
            found.append(m.span())
        return found


#: The three kinds every scan reports, in this order.
BASE_RULES = (
    Rule("assign", r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", least_group=(2, 8)),
    Rule("access", r"AKIA[A-Z0-9]+", least=16),
    Rule("hex", r"[0-9a-f]+", least=32, scan=r"[0-9a-f]{32,}"),
)
#: Public formats of well-known credentials.
MORE_RULES = (
    Rule("pem", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
    Rule("github", r"gh[oprsu]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abeoprs]-[0-9A-Za-z-]{10,}"),
    Rule("stripe", r"(?:sk|rk)_live_[0-9A-Za-z]{16,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("jwt", r"eyJ[0-9A-Za-z_-]{8,}\.eyJ[0-9A-Za-z_-]{8,}\.[0-9A-Za-z_-]{8,}"),
    Rule("login", r"\b[a-z][a-z0-9+.-]{1,15}://[^\s/:@]+:[^\s/:@]{3,}@"),
)
RULES = BASE_RULES + MORE_RULES

#: A query is a set of terms; a document fits if it has all trigrams of some term. ALWAYS fits every document.
Query = frozenset
ALWAYS: Query = frozenset([frozenset()])


def either(queries: list[Query]) -> Query:
    joined = frozenset().union(*queries)
    return ALWAYS if frozenset() in joined or len(joined) > MAX_TERMS else joined


def both(a: Query, b: Query) -> Query:
    if len(a) * len(b) > MAX_TERMS:
        return min(a, b, key=lambda q: (frozenset() in q, len(q)))
    return frozenset(x | y for x, y in product(a, b))


def of_literals(words: frozenset[str]) -> Query:
    return either([frozenset([frozenset(w[i : i + 3] for i in range(len(w) - 2))]) for w in words]) if words else ALWAYS


def derive(pattern: str) -> Query:
    """The trigram query that every match of the pattern satisfies, in lower case."""

    def walk(node) -> tuple[frozenset[str] | None, Query]:
        """All strings of the node if they are few, and its query."""
        whole, query = frozenset([""]), ALWAYS
        run: frozenset[str] = whole
        exact = True
        for op, arg in node:
            words, inner = step(op, arg)
            if words is not None and len(run) * len(words) <= MAX_TERMS:
                run = frozenset(a + b for a, b in product(run, words))
                continue
            exact = False
            query, run = both(query, of_literals(run)), frozenset([""])
            if words is not None:
                run = words
            else:
                query = both(query, inner)
        return (run, of_literals(run)) if exact else (None, both(query, of_literals(run)))

    def step(op, arg) -> tuple[frozenset[str] | None, Query]:
        if op is sre.LITERAL:
            return (frozenset([chr(arg).lower()]), ALWAYS) if arg < 128 else (None, ALWAYS)
        if op is sre.IN:
            chars: set[str] = set()
            for kind, value in arg:
                if kind is sre.LITERAL and value < 128:
                    chars.add(chr(value).lower())
                elif kind is sre.RANGE and value[1] - value[0] < 8 and value[1] < 128:
                    chars |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
                else:
                    return None, ALWAYS
            return (frozenset(chars), ALWAYS) if len(chars) <= 8 else (None, ALWAYS)
        if op is sre.SUBPATTERN:
            return walk(arg[-1])
        if op is sre.BRANCH:
            made = [walk(branch) for branch in arg[1]]
            if all(words is not None for words, _ in made):
                joined = frozenset().union(*(words for words, _ in made))
                if len(joined) <= MAX_TERMS:
                    return joined, of_literals(joined)
            return None, either([query for _, query in made])
        if op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            low, high, body = arg
            words, query = walk(body)
            if words is not None and (low, high) == (0, 1):
                return words | {""}, ALWAYS
            if words is not None and low == high and len(words) ** min(low, 9) <= MAX_TERMS:
                return frozenset("".join(x) for x in product(words, repeat=low)), ALWAYS
            return None, query if low else ALWAYS
        if op is sre.AT:
            return frozenset([""]), ALWAYS
        return None, ALWAYS

    return walk(parser.parse(pattern))[1]


class Index:
    """The rules' queries with numbered trigrams and the table that finds those in bytes."""

    def __init__(self, rules: tuple[Rule, ...]) -> None:
        self.rules = rules
        self.queries = [derive(rule.pattern) for rule in rules]
        names = sorted({t for query in self.queries for term in query for t in term})
        self.number = {t: i for i, t in enumerate(names)}
        self.table = np.zeros(1 << 24, np.uint8 if len(names) < 255 else np.uint16)
        for t, i in self.number.items():
            a, b, c = t.encode()
            self.table[a << 16 | b << 8 | c] = i + 1

    def postings(self, texts: list[bytes]) -> dict[int, np.ndarray]:
        """Documents (positions in the block, ascending) by trigram number."""
        joined = np.frombuffer(b"\0".join(texts).lower() + b"\0\0", np.uint8)
        ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
        wide = joined.astype(np.uint32)
        found = self.table[(wide[:-2] << 16) | (wide[1:-1] << 8) | wide[2:]]
        at = np.flatnonzero(found)
        doc = np.searchsorted(ends, at, side="right")
        pairs = np.unique(found[at].astype(np.int64) * (len(texts) + 1) + doc)
        which, docs = np.divmod(pairs, len(texts) + 1)
        cuts = np.flatnonzero(np.diff(which)) + 1
        return {int(w[0]) - 1: d for w, d in zip(np.split(which, cuts), np.split(docs, cuts)) if len(w)}

    def candidates(self, query: Query, postings: dict[int, np.ndarray], n: int) -> np.ndarray:
        """Positions of the documents that fit the query."""
        if frozenset() in query:
            return np.arange(n)
        fits = np.zeros(n, bool)
        for term in query:
            lists = sorted((postings.get(self.number[t], np.zeros(0, np.int64)) for t in term), key=len)
            docs = lists[0]
            for other in lists[1:]:
                docs = docs[np.isin(docs, other, assume_unique=True)]
            fits[docs] = True
        return np.flatnonzero(fits)

    def scan(self, texts: list[str]) -> list[list[tuple[int, int, int]]]:
        """(start, rule number, end) of all spans of each text, in that order."""
        out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        postings = self.postings([t.encode("utf-8", "replace") for t in texts]) if texts else {}
        for number, (rule, query) in enumerate(zip(self.rules, self.queries)):
            for doc in self.candidates(query, postings, len(texts)).tolist():
                out[doc].extend((a, number, b) for a, b in rule.spans(texts[doc]))
        for spans in out:
            spans.sort()
        return out


@lru_cache(maxsize=1)
def _index(rules: tuple[Rule, ...]) -> Index:
    return Index(rules)


def index_of(rules: tuple[Rule, ...]) -> Index:
    claim("secrets", _index.cache_clear)
    return _index(rules)


def find(df: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and spans array<struct<kind, start, end>> (code points, end exclusive) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = index_of(rules)
        for block in pieces(batches, "text", BLOCK_BYTES):
            spans = index.scan([t or "" for t in block["text"].to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [block["doc_id"], pa.array([[{"kind": rules[k].kind, "start": a, "end": b} for a, k, b in s] for s in spans], kind)],
                ["doc_id", "spans"],
            )

    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    return narrow(df, id_col, text_col).mapInArrow(run, "doc_id long, spans array<struct<kind:string,start:int,end:int>>")


def redact(df: DataFrame, rules: tuple[Rule, ...] = RULES, mark: str = "[secret]", text_col: str = "text") -> DataFrame:
    """The same rows and columns; every span, overlapping ones joined, is replaced by the mark."""
    where = df.columns.index(text_col)

    def cut(text: str, spans: list[tuple[int, int, int]]) -> str:
        made, last = [], 0
        for a, _, b in spans:
            if a >= last:
                made += [text[last:a], mark]
            last = max(last, b)
        return "".join(made) + text[last:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = index_of(rules)
        for block in pieces(batches, text_col, BLOCK_BYTES):
            texts = block[text_col].to_pylist()
            spans = index.scan([t or "" for t in texts])
            columns = list(block.columns)
            columns[where] = pa.array([cut(t, s) if s else t for t, s in zip(texts, spans)], pa.string())
            yield pa.RecordBatch.from_arrays(columns, list(block.schema.names))

    return df.mapInArrow(run, df.schema)


def summary(df: DataFrame) -> DataFrame:
    """Counts, digest of the base kinds and the list of all spans, from find()'s rows."""
    base = [rule.kind for rule in BASE_RULES]
    show = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")
    only = lambda kind: F.filter("spans", lambda s: s.kind == kind)
    return df.select(
        "doc_id",
        *(F.size(only(kind)).cast("long").alias(f"n_{kind}") for kind in base),
        F.sha2(show(F.filter("spans", lambda s: s.kind.isin(base))).cast("binary"), 256).alias("base_sha256"),
        show(F.col("spans")).alias("spans"),
    )


def brute_spans(text: str | None, rules: tuple[Rule, ...] = RULES) -> str:
    """What summary() lists, by every expression on the whole text; for tests."""
    spans = sorted((m.start(), k, m.end()) for k, r in enumerate(rules) for m in re.finditer(r.pattern, text or "")
                   if m.end() - m.start() >= r.least and not (r.least_group and len(m[r.least_group[0]]) < r.least_group[1]))
    return ",".join(f"{rules[k].kind}:{a}:{b}" for a, k, b in spans)


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _oracle() -> str:
    """Positions come from the lengths of what lies between the matches."""

    def matches(number: int, rule: Rule) -> str:
        pattern = (rule.scan or rule.pattern).replace("'", "''")
        # The engine folds more than ASCII letters, so the keywords are spelled out.
        pattern = re.sub(r"\(\?ai:(.*?)\)", lambda m: "(?:" + re.sub("[a-z]", lambda c: f"[{c[0].upper()}{c[0]}]", m[1]) + ")", pattern)
        group = f" AND length(regexp_extract(f[i], '{pattern}', {rule.least_group[0]})) >= {rule.least_group[1]}" if rule.least_group else ""
        return f"""SELECT doc_id, {number} AS o, '{rule.kind}' AS kind, f[i] AS s,
  (list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(f[1:i-1], lambda x: length(x))), 0))::BIGINT AS a
FROM (SELECT doc_id, string_split_regex(t, '{pattern}') AS p, regexp_extract_all(t, '{pattern}') AS f, unnest(range(1, len(regexp_extract_all(t, '{pattern}')) + 1)) AS i FROM d)
WHERE length(f[i]) >= {rule.least}{group}"""

    every = "\nUNION ALL ".join(matches(n, r) for n, r in enumerate(RULES))
    base = ", ".join(f"'{r.kind}'" for r in BASE_RULES)
    counts = ", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in BASE_RULES)
    zeros = ", ".join(f"coalesce(n_{r.kind}, 0)::BIGINT AS n_{r.kind}" for r in BASE_RULES)
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS ({every}),
g AS (SELECT doc_id, {counts}, string_agg(kind || ':' || a || ':' || (a + length(s)), ',' ORDER BY a, o) FILTER (kind IN ({base})) AS base,
  string_agg(kind || ':' || a || ':' || (a + length(s)), ',' ORDER BY a, o) AS spans FROM m GROUP BY doc_id)
SELECT doc_id, {zeros}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (doc_id)"""


ORACLE = _oracle()
