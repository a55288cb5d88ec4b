"""Toxicity by a weighted finite-state pattern grammar.

Words become symbols (insult, threat, target, negation, reported speech, other).
Small transducers say over a clause which words stand in the scope of a
negation, of reported speech, of a target before them or of a target behind
them.  They are composed into one machine for each direction, and what the two
say of an insult or threat are its marks.  A clause is worth the sum of its
marked insults and threats, each times the weight of its marks, which may be
negative; a document's score is a logistic function of what its matched clauses
add up to and of how densely they stand.  Insults and weights are learned from
labelled documents.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import in_batches, stash

#: Labelled rows that the lexicon and the weights are fitted on at most, by the hash of doc_id.
SAMPLE = 24_000
#: Weight of a unit at least: it is ten times likelier in toxic contexts.
LEAST = math.log(10)
#: Letters of the beginnings of words that may be units.
BEGINNINGS = (3, 4, 5, 6, 7)
#: A document is predicted toxic from this score on.
CUT = 0.7

#: Closed word classes in the four languages.
TARGET = set("you your yours yourself u they them he she him du dich dir dein deine ihr euch tu toi te vous votre ton ta usted ustedes tú ti".split())
NEGATION = set("not no never without isn aren wasn don doesn didn nicht kein keine keinen nie ohne ne pas jamais sans nunca sin ningún ninguna".split())
REPORTED = set("said says saying wrote writes quoted called claimed reported according sagte sagt schrieb laut dit disait selon dijo dice según".split())
THREAT = set("kill murder hurt shoot stab strangle burn destroy töten umbringen erschießen verletzen tuer frapper brûler matar golpear quemar".split())

_WORD = re.compile(r"[^\W\d_]+")
_STOP = re.compile(r"[.!?;:\n]")
#: Words that a negation or a target reaches.
SCOPE = 3
SYMBOLS = "IHTNRO"
MARKS = ("negated", "reported", "targeted")
#: What the weights stand for: all insults, those with each mark, the same of threats, and how densely insults and threats stand.
KINDS = (*(" ".join((kind, *mark)) for kind in ("insult", "threat") for mark in ((), *((m,) for m in MARKS))), "density")
#: What the weights are without a reason in the data to differ.
PRIOR = (2.0, -1.0, -1.0, 0.5, 1.0, -1.0, -1.0, 0.5, 1.0)


@dataclass(frozen=True)
class Transducer:
    """States from 0 on, the next state for each state and symbol, and the mark that a state puts on the word read in it (None: none)."""

    step: tuple[dict[str, int], ...]
    marks: tuple[frozenset[str], ...]


def scope(opens: str, reach: int | None, mark: str) -> Transducer:
    """Marks the next `reach` words behind each symbol `opens`, or all of them (None)."""
    n = 1 if reach is None else reach
    down = lambda q: q if reach is None else max(0, q - 1)
    step = tuple({s: n if s == opens else down(q) for s in SYMBOLS} for q in range(n + 1))
    return Transducer(step, tuple(frozenset({mark} if q else ()) for q in range(n + 1)))


def compose(*parts: Transducer) -> Transducer:
    """One transducer that does what all do, one behind the other: its states are the reachable tuples of theirs."""
    number = {(0,) * len(parts): 0}
    todo, step = list(number), []
    for state in todo:
        row = {}
        for s in SYMBOLS:
            to = tuple(t.step[q][s] for t, q in zip(parts, state, strict=True))
            if to not in number:
                number[to] = len(number)
                todo.append(to)
            row[s] = number[to]
        step.append(row)
    return Transducer(tuple(step), tuple(frozenset().union(*(t.marks[q] for t, q in zip(parts, state, strict=True))) for state in todo))


#: The machine that reads a clause forwards, the one that reads it backwards, and the numbers of the marks for each pair of their states.
FORWARD = compose(scope("N", SCOPE, "negated"), scope("R", None, "reported"), scope("T", SCOPE, "targeted"))
BACKWARD = compose(scope("T", SCOPE, "targeted"))
_MARKED = [[tuple(i + 1 for i, m in enumerate(MARKS) if m in a | b) for b in BACKWARD.marks] for a in FORWARD.marks]


def parse(symbols: list[str]) -> list[tuple[int, ...]]:
    """For each symbol of a clause the numbers of its marks, from 1 on."""
    before, q = [], 0
    for s in symbols:
        before.append(q)
        q = FORWARD.step[q][s]
    out, q = [], 0
    for s, f in zip(reversed(symbols), reversed(before), strict=True):
        out.append(_MARKED[f][q])
        q = BACKWARD.step[q][s]
    return out[::-1]


@dataclass
class Model:
    """units: insults with their weights, a trailing * for a word's beginning; coefficients for KINDS; intercept."""

    units: dict[str, float] = field(default_factory=dict)
    coefficients: list[float] = field(default_factory=lambda: list(PRIOR))
    intercept: float = -3.0

    def automaton(self):
        import ahocorasick

        found = ahocorasick.Automaton()
        for unit, weight in {**dict.fromkeys(THREAT, 1.0), **self.units}.items():
            word = unit.rstrip("*")
            old = found.get(word, (len(word), 0.0, 0.0, "I"))
            kind = "I" if unit in self.units else "H"
            found.add_word(word, (len(word), max(old[1], weight) if unit.endswith("*") else old[1], old[2] if unit.endswith("*") else max(old[2], weight), kind))
        found.make_automaton()
        return found


def clauses(low: str, hits: dict[int, tuple[str, float]]) -> Iterator[np.ndarray]:
    """What each clause with a hit adds to KINDS but density; hits: symbol and weight by place."""
    starts, until = iter(sorted(hits)), 0
    at = next(starts, None)
    while at is not None:
        begin = max(until, *(low.rfind(c, until, at) + 1 for c in ".!?;:\n"))
        stop = _STOP.search(low, at)
        until = stop.end() if stop else len(low)
        words = [(m.start(), m[0]) for m in _WORD.finditer(low, begin, until)]
        symbols = [hits[i][0] if i in hits else "N" if w in NEGATION else "R" if w in REPORTED else "T" if w in TARGET else "O" for i, w in words]
        sums = np.zeros(len(KINDS) - 1)
        for (i, _), s, marks in zip(words, symbols, parse(symbols), strict=True):
            if i in hits:
                base = 0 if s == "I" else 1 + len(MARKS)
                for k in (0, *marks):
                    sums[base + k] += hits[i][1]
        yield sums
        at = next((x for x in starts if x >= until), None)


def clause_sums(text: str, automaton) -> np.ndarray | None:
    """KINDS summed over a text's matched clauses, and their density in a thousand words; None without a match."""
    low = text.lower()
    hits: dict[int, tuple[str, float]] = {}
    for end, (size, prefix, word, kind) in automaton.iter(low):
        start = end - size + 1
        if start and low[start - 1].isalpha():
            continue
        weight = prefix if end + 1 < len(low) and low[end + 1].isalpha() else max(prefix, word)
        if weight > hits.get(start, ("", 0.0))[1]:
            hits[start] = kind, weight
    if not hits:
        return None
    sums = np.sum(list(clauses(low, hits)), axis=0)
    words = sum(1 for _ in _WORD.finditer(low))
    return np.append(sums, 1000 * (sums[0] + sums[1 + len(MARKS)]) / words)


def features(sums: np.ndarray) -> np.ndarray:
    """Each sum flattened, so that one clear clause counts much and the hundredth little."""
    return np.log1p(sums)


def score(model: Model, sums: np.ndarray | None) -> float:
    z = model.intercept + (0.0 if sums is None else float(features(sums) @ np.array(model.coefficients)))
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def _contexts(rows: DataFrame) -> DataFrame:
    """toxic, half and each different word of a text with the words beside it in its clause (context: before, word, after, with a space between)."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        found: set[tuple[int, int, str]] = set()
        for toxic, half, text in zip(*(batch.column(k).to_pylist() for k in ("toxic", "half", "text")), strict=True):
            for clause in _STOP.split(text.lower()):
                words = ["", *_WORD.findall(clause), ""]
                found.update((toxic, half, " ".join(three)) for three in zip(words, words[1:], words[2:]))
        toxic, half, context = zip(*found, strict=True) if found else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(toxic, pa.int32()), pa.array(half, pa.int32()), pa.array(context, pa.string())], names=["toxic", "half", "context"])

    return rows.select(F.col("toxic").cast("int").alias("toxic"), "half", "text").mapInArrow(lambda batches: in_batches(batches, work, 1 << 20), "toxic int, half int, context string")


def _units(word: Column) -> Column:
    """A word and its beginnings."""
    return F.array_compact(F.array(word, *[F.when(F.length(word) > n, F.concat(F.substring(word, 1, n), F.lit("*"))) for n in BEGINNINGS]))


def _gain(bad: Column, rows: Column, toxic: int, total: int) -> Column:
    """Likelihood-ratio statistic of a unit's being commoner in toxic documents; 0 if it isn't."""
    rate, part = toxic / total, lambda n, of, base: F.when(n > 0, n * F.log(n / of / base)).otherwise(0.0)
    good, without, clean = rows - bad, total - rows, total - toxic - rows + bad
    sides = part(bad, rows, rate) + part(good, rows, 1 - rate) + part(toxic - bad, without, rate) + part(clean, without, 1 - rate)
    return F.when((rows > 0) & (bad > rows * rate), 2 * sides).otherwise(0.0)


def gain(bad: float, rows: float, toxic: int, total: int) -> float:
    """The same of numbers."""
    if rows <= 0 or bad <= rows * toxic / total:
        return 0.0
    part = lambda n, of, base: n * math.log(n / of / base) if n > 0 else 0.0
    rate, without = toxic / total, total - rows
    return 2 * (part(bad, rows, rate) + part(rows - bad, rows, 1 - rate) + part(toxic - bad, without, rate) + part(without - toxic + bad, without, 1 - rate))


def lexicon(counts: list[tuple[str, int, int]], toxic: int, total: int, chance: float) -> dict[str, float]:
    """Weights (log odds, shrunk) of units given as (unit, toxic contexts, contexts).

    From the longest on, each unit that is better attested than chance takes its
    contexts; a word's beginning is judged by what the longer ones leave of it.
    """
    taken: dict[str, tuple[int, int]] = {}
    out = {}
    for unit, bad, rows in sorted(counts, key=lambda c: (-len(c[0].rstrip("*")), c[0].endswith("*"), c[0])):
        own = unit.rstrip("*")
        a, b = taken.get(unit, (0, 0))
        if gain(bad - a, rows - b, toxic, total) <= chance:
            continue
        weight = math.log((bad - a + 0.5) / (toxic + 1) * (total - toxic + 1) / (rows - b - bad + a + 0.5))
        if weight < LEAST:
            continue
        out[unit] = weight
        for n in (n for n in BEGINNINGS if n < len(own)):
            c, d = taken.get(own[:n] + "*", (0, 0))
            taken[own[:n] + "*"] = c + bad - a, d + rows - b
    return out


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from labelled documents whose crc32(doc_id) mod 3 is not 1.

    At most `sample` labelled rows are used, those of the smallest hashes; only
    text and toxic are read of them; equal texts are one, toxic if any is, and
    in the half of the smallest doc_id, so that the order of rows has no say.
    A unit is taken when its likelihood ratio
    is higher than the best of as many units by chance would be.  The weights
    are fitted on hits that the other half's insults find, the insults of the
    model are those of both halves.  Without labels of both kinds the model
    finds nothing but threats.
    """
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # At most `sample` pairs of numbers go to every executor.
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(known), "doc_id")
    rows = rows.groupBy("text").agg(F.min("doc_id").alias("doc_id"), F.max("toxic").alias("toxic"))
    rows = stash(rows.withColumn("half", (F.crc32(F.col("doc_id").cast("string")) % 3 == 0).cast("int")), "labelled")
    sums = [f(F.when(F.col("half") == h, v)).alias(f"{n}{h}") for h in (0, 1) for f, n, v in ((F.sum, "bad", F.col("toxic")), (F.count, "all", F.lit(1)))]
    whole = [F.coalesce(F.col(f"{n}{h}"), F.lit(0)).alias(f"{n}{h}") for h in (0, 1) for n in ("bad", "all")]
    # Copies of a document bring no evidence of their own: words are counted in different contexts.
    seen = _contexts(rows).groupBy("context").agg(F.min("toxic").alias("toxic"), F.min("half").alias("half"))
    words = seen.groupBy(F.get(F.split("context", " "), F.lit(1)).alias("word")).agg(*sums).select("word", *whole)
    words = stash(words, "words")
    counts = words.select(F.explode(_units(F.col("word"))).alias("unit"), "bad0", "all0", "bad1", "all1").groupBy("unit").agg(*(F.sum(f"{n}{h}").alias(f"{n}{h}") for h in (0, 1) for n in ("bad", "all")))
    totals = words.agg(*(F.coalesce(F.sum(f"{n}{h}"), F.lit(0)).alias(f"{n}{h}") for h in (0, 1) for n in ("bad", "all"))).first()
    halves = [(totals[f"bad{h}"], totals[f"all{h}"]) for h in (0, 1)]
    halves.append(tuple(map(sum, zip(*halves))))
    if not 0 < halves[2][0] < halves[2][1]:
        return Model()
    counts = stash(counts, "units")
    chance = 2 * math.log(max(2, counts.count()))
    columns = [("bad0", "all0"), ("bad1", "all1"), ("bad0 + bad1", "all0 + all1")]
    gains = [_gain(F.expr(b), F.expr(a), *t) if 0 < t[0] < t[1] else F.lit(0.0) for (b, a), t in zip(columns, halves, strict=True)]
    named = counts.withColumns({f"gain{i}": g for i, g in enumerate(gains)})
    # The labelled sample bounds the units that are better attested than chance: each needs toxic contexts of its own.
    best = [named.filter(F.col(f"gain{i}") > chance).select("unit", F.expr(b).alias("bad"), F.expr(a).alias("rows")) for i, (b, a) in enumerate(columns)]
    units = [lexicon([tuple(r) for r in part.collect()], *t, chance) for part, t in zip(best, halves, strict=True)]
    found = [sorted(map(tuple, _sums(rows.filter(F.col("half") == h), Model(units[1 - h])).select("sums", "toxic").collect())) for h in (0, 1)]
    x, y = ([r[k] for part in found for r in part] for k in (0, 1))
    coefficients, intercept = _logistic(features(np.array(x, float)), np.array(y, float))
    return Model(units[2], coefficients, intercept)


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[list[float], float]:
    """Weights of any sign, by Newton steps on the likelihood with a normal prior of variance one about PRIOR."""
    x = np.column_stack((x, np.ones(len(x))))
    w = np.array([*PRIOR, -3.0])
    prior, penalty = w.copy(), np.append(np.ones(len(PRIOR)), 1e-6)
    loss = lambda w: np.logaddexp(0, x @ w).sum() - y @ (x @ w) + 0.5 * penalty @ (w - prior) ** 2
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (p - y) + penalty * (w - prior))
        size = 1.0
        while size > 1e-6 and loss(w - size * step) > loss(w):
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-7:
            break
    return w[:-1].tolist(), float(w[-1])


_AUTOMATA: dict[int, tuple] = {}


def _of_worker(model: Model):
    key = hash((tuple(sorted(model.units.items()))))
    if key not in _AUTOMATA:
        _AUTOMATA.clear()
        _AUTOMATA[key] = (model.automaton(),)
    return _AUTOMATA[key][0]


def _sums(rows: DataFrame, model: Model) -> DataFrame:
    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        automaton = _of_worker(model)
        sums = [s if s is not None else np.zeros(len(KINDS)) for s in (clause_sums(t or "", automaton) for t in batch.column("text").to_pylist())]
        return pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(sums, pa.list_(pa.float64()))], names=["toxic", "sums"])

    return rows.mapInArrow(lambda batches: in_batches(batches, work, 4 << 20), f"toxic {rows.schema['toxic'].dataType.simpleString()}, sums array<double>")


def scored(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """All columns of documents and their score, 0 to 1.

    Null and empty texts are scored as texts without a match; repeated rows
    stay; an empty table gives none; a column of that name must not be there.
    """

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        automaton = _of_worker(model)
        scores = [score(model, clause_sums(t, automaton) if t else None) for t in batch.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=[*batch.schema.names, name])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return in_batches(batches, work, 4 << 20)

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, DoubleType())]))


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score and predicted of each row; rows that repeat stay, a null doc_id isn't held out, an empty table gives none."""
    model = fit(docs, labels, sample)
    rows = scored(docs.select("doc_id", "text"), model)
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= CUT, 1).otherwise(0).alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The documents under the cut, with all their columns."""
    name = "_score_of_tallgrass"  # stands beside columns of any names
    return scored(docs, fit(docs, labels, sample), name).filter(F.col(name) < CUT).drop(name)
