"""Secret scans by a trigram inverted index.

Each rule's regular expression is turned into a Boolean query over trigrams
that any match must hold.  Every batch of documents gets an inverted index of
those trigrams (a document-partitioned index: no posting leaves its task);
postings are intersected, and only the candidates are verified by the
expression itself.  A rule without a mandatory trigram scans every text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product
from re import _constants as K
from re import _parser as sre

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from .common import in_batches


@dataclass(frozen=True)
class Rule:
    """kind; expression; the group whose length must reach least (0: the whole match)."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


#: The three base rules, in the order in which kinds are listed.
BASE = (
    Rule("assign", r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24),
)
#: Further kinds, all of which open with a fixed string.
EXTRA = (
    Rule("pem", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----", 0, 1),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 0, 20),
)
#: More alternatives than this make a part of an expression count as unknown.
MOST_STRINGS = 64
#: Bytes of text that one inverted index covers.
INDEX_BYTES = 4 << 20

Query = frozenset  # of frozensets of trigrams: any of them wholly present


def _exact(items) -> set[str] | None:
    """All strings that a sequence of parsed items matches, or None if they are many or unknown."""
    found = {""}
    for op, value in items:
        if op is K.LITERAL:
            part = {chr(value)}
        elif op is K.IN and all(o in (K.LITERAL, K.RANGE) for o, _ in value):
            codes = [c for o, v in value for c in ([v] if o is K.LITERAL else range(v[0], v[1] + 1))]
            part = {chr(c) for c in codes} if len(codes) <= 8 else None
        elif op is K.SUBPATTERN:
            part = _exact(value[3])
        elif op is K.BRANCH:
            parts = [_exact(x) for x in value[1]]
            part = None if None in parts else set().union(*parts)
        elif op is K.MAX_REPEAT and value[1] == 1:
            part = _exact(value[2])
            part = part if part is None or value[0] else part | {""}
        else:
            part = None
        if part is None or len(found) * len(part) > MOST_STRINGS:
            return None
        found = {a + b for a, b in product(found, part)}
    return found


def _of_strings(strings: set[str]) -> Query | None:
    """The trigrams of any of the strings; None if one is too short to have any."""
    sets = [frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in map(_fold, strings)]
    return _least(sets) if all(sets) else None


def _least(sets) -> Query:
    return Query(s for s in sets if not any(t < s for t in sets))


def _fold(s: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def _both(a: Query | None, b: Query | None) -> Query | None:
    return b if a is None else a if b is None else _least({x | y for x, y in product(a, b)})


def trigram_query(pattern: str) -> Query | None:
    """Alternatives of ASCII-folded trigrams, one of which every match of the expression holds; None if nothing is mandatory."""

    def of(items) -> Query | None:
        query, run = None, {""}
        for item in items:
            part = _exact([item])
            if part is not None and len(run) * len(part) <= MOST_STRINGS:
                run = {a + b for a, b in product(run, part)}
                continue
            query, run = _both(query, _of_strings(run)), {""} if part is None else part
            op, value = item
            if part is not None:
                continue
            if op is K.SUBPATTERN:
                query = _both(query, of(value[3]))
            elif op is K.BRANCH:
                parts = [of(x) for x in value[1]]
                query = _both(query, None if None in parts else _least(frozenset().union(*parts)))
            elif op is K.MAX_REPEAT and value[0] > 0:
                query = _both(query, of(value[2]))
        return _both(query, _of_strings(run))

    return of(list(sre.parse(pattern)))


class TrigramIndex:
    """Postings (row numbers) of wanted trigrams over a batch of texts, ASCII letters folded."""

    def __init__(self, texts: pa.Array, wanted: set[str]):
        codes = {t: int.from_bytes(t.encode(), "big") for t in wanted if len(t.encode()) == 3}
        raw = texts.cast(pa.large_string())
        offsets = np.frombuffer(raw.buffers()[1], np.int64, len(raw) + 1, raw.offset * 8)
        first, last = int(offsets[0]), int(offsets[-1])
        data = np.frombuffer(raw.buffers()[2], np.uint8, last) if last else np.empty(0, np.uint8)
        data = data[first:]
        self.rows = len(raw)
        self.postings = dict.fromkeys(codes, np.empty(0, np.int64))
        if len(data) < 3:
            return
        fold = np.arange(256, dtype=np.uint8)
        fold[65:91] += 32
        b = fold[data]
        # The first two bytes of a wanted trigram pick the places to look at.
        pairs = np.zeros(1 << 16, bool)
        pairs[[c >> 8 for c in codes.values()]] = True
        pair = b[:-1].astype(np.uint16) << 8
        pair |= b[1:]
        at = np.flatnonzero(pairs[pair[:-1]])
        code = (pair[at].astype(np.int32) << 8) | b[at + 2]
        row = np.searchsorted(offsets - first, at, side="right") - 1
        inside = at + 3 <= (offsets - first)[row + 1]
        code, row = code[inside], row[inside]
        for t, c in codes.items():
            self.postings[t] = np.unique(row[code == c])

    def candidates(self, query: Query | None) -> np.ndarray:
        """Rows for which the query holds: intersected postings of any alternative; all rows without a query."""
        if query is None:
            return np.arange(self.rows)
        found = []
        for alternative in query:
            rows = None
            for t in sorted((t for t in alternative if t in self.postings), key=lambda t: len(self.postings[t])):
                rows = self.postings[t] if rows is None else np.intersect1d(rows, self.postings[t], assume_unique=True)
                if not len(rows):
                    break
            found.append(np.arange(self.rows) if rows is None else rows)
        return np.unique(np.concatenate(found))


def _quick(rule: Rule) -> re.Pattern:
    """For a rule that is one repeated class: the same class at least as often as the length asks for, which has the same matches left."""
    m = re.fullmatch(r"(\[[^\]]+\])\+", rule.pattern)
    return re.compile(rf"{m[1]}{{{rule.least},}}" if m and not rule.group else rule.pattern)


def find_secrets(texts: pa.Array, rules: tuple[Rule, ...]) -> list[list[tuple[int, int, int]]]:
    """For each text the spans (start, end, number of the rule), sorted by start and rule; code points, ends exclusive. Null: empty."""
    queries = [trigram_query(r.pattern) for r in rules]
    index = TrigramIndex(texts, {t for q in queries if q for s in q for t in s})
    found: list[list[tuple[int, int, int]]] = [[] for _ in range(len(texts))]
    strings: dict[int, str] = {}
    whole = texts.to_pylist() if None in queries else None
    for n, (rule, query) in enumerate(zip(rules, queries, strict=True)):
        search = _quick(rule)
        for row in index.candidates(query).tolist():
            text = whole[row] if whole else strings.get(row) or strings.setdefault(row, texts[row].as_py())
            for m in search.finditer(text or ""):
                if m.end(rule.group) - m.start(rule.group) >= rule.least:
                    found[row].append((m.start(), m.end(), n))
    for spans in found:
        spans.sort(key=lambda s: (s[0], s[2]))
    return found


def secret_spans(docs: DataFrame, rules: tuple[Rule, ...] = BASE + EXTRA) -> DataFrame:
    """Adds _spans array<struct<start,end,kind>> to documents with doc_id and text; other columns stay.

    Null and empty texts have no spans; repeated rows and ids are scanned each
    for itself; an empty table gives an empty table.
    """

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        spans = find_secrets(batch.column("text"), rules)
        value = pa.array([[{"start": s, "end": e, "kind": rules[n].kind} for s, e, n in x] for x in spans], kind)
        return pa.RecordBatch.from_arrays([*batch.columns, value], names=[*batch.schema.names, "_spans"])

    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return in_batches(batches, work, INDEX_BYTES)

    spans = ArrayType(StructType([StructField("start", IntegerType()), StructField("end", IntegerType()), StructField("kind", StringType())]))
    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField("_spans", spans)]))


def span_digest(docs: DataFrame, rules: tuple[Rule, ...] = BASE + EXTRA) -> DataFrame:
    """doc_id, n_<kind> of the base rules, base_sha256 and all spans as text, for each row.

    Null texts count as empty and have no spans; repeated rows and null ids
    stay; an empty table gives none; other columns are ignored.
    """
    base = [r.kind for r in BASE]

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = find_secrets(batch.column("text"), rules)
        named = [[(rules[n].kind, f"{rules[n].kind}:{s}:{e}") for s, e, n in x] for x in found]
        counts = [pa.array([sum(k == b for k, _ in x) for x in named], pa.int64()) for b in base]
        digests = [hashlib.sha256(",".join(t for k, t in x if k in base).encode()).hexdigest() for x in named]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *counts, pa.array(digests, pa.string()), pa.array([",".join(t for _, t in x) for x in named], pa.string())], names=names)

    names = ["doc_id", *(f"n_{b}" for b in base), "base_sha256", "spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return in_batches(batches, work, INDEX_BYTES)

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id long, {', '.join(f'n_{b} long' for b in base)}, base_sha256 string, spans string")


def mask_secrets(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """Replaces every span of every kind in text by a mark (overlapping spans by one); all columns and rows stay, and n_chars, if there, is counted anew.

    Null and empty texts stay as they are, and so do repeated rows; an empty
    table gives none.
    """

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column("text")
        hit = [(i, x) for i, x in enumerate(find_secrets(texts, BASE + EXTRA)) if x]
        if not hit:
            return batch
        out = texts.to_pylist()
        for i, spans in hit:
            parts, at, until = [], 0, -1
            for s, e, _ in spans:
                if s >= until:
                    parts += [out[i][at:s], mark]
                until = max(until, e)
                at = until
            out[i] = "".join([*parts, out[i][at:]])
        k = batch.schema.get_field_index("text")
        return batch.set_column(k, batch.schema.field(k), pa.array(out, batch.schema.field(k).type))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return in_batches(batches, work, INDEX_BYTES)

    masked = docs.mapInArrow(run, docs.schema)
    if "n_chars" in docs.columns:
        masked = masked.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return masked
