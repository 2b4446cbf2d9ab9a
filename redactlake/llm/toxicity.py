"""Toxicity by a weighted finite-state grammar over clauses.

Every word is a symbol: insult, threat, target, negation, reporting verb, passive
verb, or none of these; punctuation ends a clause.  Small transducers, each a
table of states and symbols, are composed into one table of transitions, which
reads a text once:

* negation: an insult or threat within three words after a negation is *denied*;
* report: after a reporting verb everything in the clause is *reported*;
* threat: a threat that is not denied, with a target after it, or before it and a
  passive verb between them;
* target: a person word in the clause of an insult raises it.

An insult's weight goes to the lane of its marks as it is read; a clause's end adds
what its state says.  Insults are stems with learned weights and a few fixed words.

Affirmed, denied and reported matches are summed apart; a logistic model
fitted on labelled rows turns the three sums into a score, so that the labels
decide how much a denied or reported insult counts.

Learning uses a bounded sample (``sample_rows``) of labelled rows outside the
held-out fifth, those with the smallest hash of their id.  A prefix, or a whole word
of any length, is learned if toxic texts hold it far more often than chance would
have it; near copies count as one text.  A stem is the most specific prefix that
keeps 95 % of the support of a significant one.  The score of a document depends on
its text alone.

Defined cases: null text counts as empty; empty texts get the score of no
match; null ids are scored and not held out, labels without id or toxic are ignored, of several
labels of one document the larger counts; without usable labels the fixed words
and default coefficients remain; other columns are kept or, when named like a
result, replaced; repeated rows score equally.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from redactlake.llm.near import shingle_set
from redactlake.llm.tables import replace_columns, small_batches, tidied

SAMPLE_ROWS = 20_000
_SHORTEST, _LONGEST = 4, 12
_SURPRISE = 18.0
_MOST_STEMS = 2_000
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?|[.!?;\n]")

# Words of the grammar in the languages of the corpus.
INSULTS = ("idiot", "moron", "imbecile", "stupid", "scum", "scumbag", "bastard", "asshole", "loser", "worthless", "pathetic", "disgusting", "trash", "dumb", "dumbass")
THREATS = (
    "kill", "murder", "hurt", "destroy", "burn", "shoot", "stab", "strangle", "töten", "umbringen", "tuer", "matar",
    "killed", "murdered", "destroyed", "burned", "shot", "stabbed", "strangled", "getötet", "umgebracht", "tué", "matado",
)
TARGETS = ("you", "your", "yours", "he", "she", "him", "her", "they", "them", "their", "people", "du", "dich", "dir", "ihr", "euch", "tu", "toi", "vous", "te", "ustedes", "vosotros")
NEGATIONS = (
    "not", "no", "never", "isn't", "aren't", "wasn't", "don't", "doesn't", "cannot", "can't", "won't", "nobody", "none", "nothing", "neither", "nor", "hardly", "barely",
    "scarcely", "nicht", "kein", "keine", "nie", "niemand", "kaum", "pas", "jamais", "personne", "nunca", "ni", "nadie", "apenas",
)
REPORTS = ("said", "says", "called", "calls", "wrote", "quoted", "quote", "claimed", "reported", "sagte", "nannte", "schrieb", "dit", "appelé", "écrit", "dijo", "llamó", "escribió")
PASSIVES = ("be", "being", "been", "get", "gets", "got", "werden", "wirst", "wird", "werdet", "sera", "seras", "serez", "seront", "será", "serás", "serán")

_NEGATION_REACH = 3
_TARGET_BONUS, _THREAT_WEIGHT, _FIXED_WEIGHT = 1.25, 6.0, 3.0


@dataclass(frozen=True)
class Grammar:
    """The learned part: stems with weights and the coefficients of the score."""

    stems: dict[str, float] = field(default_factory=dict)
    words: dict[str, float] = field(default_factory=lambda: dict.fromkeys(INSULTS, _FIXED_WEIGHT))
    coefficients: tuple[float, float, float, float] = (-3.0, 3.0, 0.5, 1.0)

    def insult(self, word: str) -> float:
        weight = self.words.get(word, 0.0)
        for size in range(_SHORTEST, min(len(word), _LONGEST) + 1):
            weight = max(weight, self.stems.get(word[:size], 0.0))
        return weight


# --- transducers ---------------------------------------------------------------
OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, PASSIVE, END = range(8)
SYMBOLS = range(END)
DENIED, REPORTED = 1, 2  # marks that a word is given
AFFIRMED_LANE, DENIED_LANE, REPORTED_LANE = range(3)

#: A transducer's table: for each state and symbol the next state and the marks of the word.
Table = list[list[tuple[int, int]]]


def negation_table(reach: int = _NEGATION_REACH) -> Table:
    """The state counts the words that a negation still reaches."""
    return [[(reach if x == NEGATION else max(state - 1, 0), DENIED if state and x in (INSULT, THREAT) else 0) for x in SYMBOLS] for state in range(reach + 1)]


def report_table() -> Table:
    return [[(int(state or x == REPORT), REPORTED if state else 0) for x in SYMBOLS] for state in (0, 1)]


def target_table() -> Table:
    return [[(int(state or x == TARGET), 0) for x in SYMBOLS] for state in (0, 1)]


#: States of the threat by what has been read in this order; a target after a threat completes it, so does a threat after target and passive.
NOTHING, THREATENED, AIMED, AIMED_PASSIVE, AIMED_THREATENED, AIMED_THREATENED_PASSIVE, COMPLETE = range(7)
_THREAT_MOVES = {
    (NOTHING, THREAT): THREATENED, (NOTHING, TARGET): AIMED, (THREATENED, TARGET): COMPLETE,
    (AIMED, PASSIVE): AIMED_PASSIVE, (AIMED, THREAT): AIMED_THREATENED, (AIMED_PASSIVE, THREAT): COMPLETE,
    (AIMED_THREATENED, TARGET): COMPLETE, (AIMED_THREATENED, PASSIVE): AIMED_THREATENED_PASSIVE,
    (AIMED_THREATENED_PASSIVE, TARGET): COMPLETE, (AIMED_THREATENED_PASSIVE, THREAT): COMPLETE,
}


def threat_table() -> Table:
    return [[(_THREAT_MOVES.get((state, x), state), 0) for x in SYMBOLS] for state in range(COMPLETE + 1)]


def composed(first: Table, second: Table, hides: bool = False) -> Table:
    """Both transducers side by side: states are pairs, numbered ``first * size + second``, and marks add up.

    With ``hides`` the second one does not see threats that the first one marks as denied.
    """
    size, out = len(second), []
    for i in range(len(first) * size):
        a, b = divmod(i, size)
        row = []
        for x in SYMBOLS:
            to_a, marks_a = first[a][x]
            to_b, marks_b = second[b][OTHER if hides and x == THREAT and marks_a & DENIED else x]
            row.append((to_a * size + to_b, marks_a | marks_b))
        out.append(row)
    return out


def grammar_table() -> tuple[Table, list[tuple[bool, bool, bool]]]:
    """All transducers in one table, and for each of its states whether a report, a complete threat and a target have been read."""
    table = composed(composed(composed(negation_table(), threat_table(), hides=True), report_table()), target_table())
    states = []
    for i in range(len(table)):
        rest, target = divmod(i, 2)
        rest, report = divmod(rest, 2)
        states.append((bool(report), rest % (COMPLETE + 1) == COMPLETE, bool(target)))
    return table, states


class Automaton:
    """Runs the composed table over one text."""

    def __init__(self, grammar: Grammar):
        self.grammar = grammar
        self.table, self.states = grammar_table()
        self.fixed: dict[str, tuple[int, float]] = {}
        for symbol, words in ((PASSIVE, PASSIVES), (REPORT, REPORTS), (NEGATION, NEGATIONS), (TARGET, TARGETS), (THREAT, THREATS), (END, ".!?;\n")):
            self.fixed |= dict.fromkeys(words, (symbol, 0.0))
        self.cache: dict[str, tuple[int, float]] = dict(self.fixed)

    def symbol(self, word: str) -> tuple[int, float]:
        found = self.cache.get(word)
        if found is None:
            weight = self.grammar.insult(word)
            found = (INSULT, weight) if weight else (OTHER, 0.0)
            if len(self.cache) > 200_000:
                self.cache = dict(self.fixed)
            self.cache[word] = found
        return found

    def features(self, text: str | None) -> tuple[float, float, float]:
        """Affirmed, denied and reported weight of the matched clauses."""
        total, clause, state = [0.0, 0.0, 0.0], [0.0, 0.0, 0.0], 0
        for word in [*_WORD.findall((text or "").lower()), "."]:
            symbol, weight = self.symbol(word)
            if symbol != END:
                state, marks = self.table[state][symbol]
                if symbol == INSULT:
                    clause[REPORTED_LANE if marks & REPORTED else DENIED_LANE if marks & DENIED else AFFIRMED_LANE] += weight
                continue
            if state:
                report, threat, target = self.states[state]
                if threat:
                    clause[REPORTED_LANE if report else AFFIRMED_LANE] += _THREAT_WEIGHT
                if target:
                    clause = [_TARGET_BONUS * w for w in clause]
                state = 0
            if any(clause):
                total = [t + w for t, w in zip(total, clause, strict=True)]
                clause = [0.0, 0.0, 0.0]
        return total[0], total[1], total[2]

    def score(self, text: str | None) -> float:
        b = self.grammar.coefficients
        x = np.log1p(np.array(self.features(text)))
        return float(1 / (1 + np.exp(-np.clip(b[0] + x @ np.array(b[1:]), -30, 30))))


def held_out(ident: Column) -> Column:
    """The fifth of the rows that learning never sees."""
    return F.coalesce(F.crc32(ident.cast("string")) % 5 == 0, F.lit(False))


# --- learning ------------------------------------------------------------------
def _sample(docs: DataFrame, labels: DataFrame, text: str, ident: str, rows: int) -> DataFrame:
    """At most ``rows`` labelled rows outside the held-out fifth: text and toxic."""
    usable = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    chosen = usable.groupBy(F.col("doc_id").alias("_id")).agg(F.max("toxic").cast("int").alias("_toxic"))
    chosen = chosen.orderBy(F.xxhash64("_id"), "_id").limit(rows)
    texts = docs.select(F.col(ident).alias("_doc"), F.col(text).alias("_text"))
    # bounded by ``rows``; each doc once, so a repeated id counts once
    return texts.join(F.broadcast(chosen), F.col("_doc") == F.col("_id")).groupBy("_doc").agg(
        F.min("_text").alias("text"), F.max("_toxic").alias("toxic")
    )


def _prefix_counts(sample: DataFrame) -> DataFrame:
    """Documents of either label in which a word prefix occurs; near copies, which share their least shingle, count once."""

    def key(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            sets = map(shingle_set, batch.column(0).to_pylist())
            least = pa.array([int(x[0]) - (1 << 63) if len(x) else 0 for x in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([least, *batch.columns], names=["h", "text", "toxic"])

    keyed = small_batches(sample.select("text", "toxic")).mapInArrow(tidied(key), "h long, text string, toxic int")
    distinct = keyed.groupBy("h").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))

    def count(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, Counter] = {0: Counter(), 1: Counter()}

        def out() -> pa.RecordBatch:
            keys = list(sums[0].keys() | sums[1].keys())
            return pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.string()), *(pa.array([sums[k][x] for x in keys], pa.int64()) for k in (1, 0))],
                names=["prefix", "pos", "neg"],
            )

        for batch in source:
            for text, toxic in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                words = set(_WORD.findall((text or "").lower()))
                found = {w[:k] for w in words for k in range(_SHORTEST, min(len(w), _LONGEST) + 1)}
                sums[int(bool(toxic))].update(found | {"$" + w for w in words})
                if len(sums[0]) + len(sums[1]) > 300_000:
                    yield out()
                    sums = {0: Counter(), 1: Counter()}
        yield out()

    parts = small_batches(distinct).mapInArrow(tidied(count), "prefix string, pos long, neg long")
    return parts.groupBy("prefix").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def _stems(counts: list[tuple[str, int, int]], positives: int, negatives: int) -> dict[str, float]:
    """Most specific prefixes among the significant ones; ``$word`` stands for a whole word."""
    by = {p: (a, b) for p, a, b in counts}
    longer: dict[str, list[str]] = {}
    for p in by:
        if not p.startswith("$") and len(p) > _SHORTEST:
            longer.setdefault(p[:-1], []).append(p)
        elif p.startswith("$") and len(p) > _SHORTEST:
            longer.setdefault(p[1 : 1 + _LONGEST], []).append(p)
    chosen: dict[str, float] = {}
    for p in by:
        if len(p) > _SHORTEST if p.startswith("$") else p[:-1] in by:
            continue  # reached from a shorter one, if at all; words too short for a prefix stand for themselves
        heads = [p]
        while heads:
            q = heads.pop()
            children = longer.get(q, [])
            same = [c for c in children if by[c][0] >= 0.95 * by[q][0]]
            if same:
                heads.append(max(same, key=lambda c: by[c][0]))
            else:
                a, b = by[q]
                chosen[q] = float(np.log((a + 0.5) / (positives + 1) / ((b + 0.5) / (negatives + 1))))
    return chosen


def _fit(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, rounds: int = 30) -> np.ndarray:
    """Logistic regression by Newton steps."""
    a = np.column_stack([np.ones(len(x)), x])
    b = np.zeros(a.shape[1])
    penalty = np.eye(len(b)) * ridge
    penalty[0, 0] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ b, -30, 30)))
        step = np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + penalty, a.T @ (y - p) - penalty @ b)
        b = b + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return b


def learn(docs: DataFrame, labels: DataFrame, text: str = "text", ident: str = "doc_id", sample_rows: int = SAMPLE_ROWS) -> Grammar:
    """Stems and coefficients from at most ``sample_rows`` labelled rows.

    The driver receives significant prefixes (at most a fixed number) and three
    numbers a sample row.
    """
    sample = _sample(docs, labels, text, ident, sample_rows).persist()
    try:
        sizes = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
        positives, negatives = sizes.get(1, 0), sizes.get(0, 0)
        if not positives or not negatives:
            return Grammar()
        odds = F.log((F.col("pos") + 0.5) / (positives + 1) / ((F.col("neg") + 0.5) / (negatives + 1)))
        # how far beyond chance: a bound of the logarithm of the probability to see as many in toxic texts
        chance = (F.col("pos") + F.col("neg")) * (positives / (positives + negatives))
        surprise = F.col("pos") * F.log(F.col("pos") / chance) - F.col("pos") + chance
        strong = _prefix_counts(sample).filter((F.col("pos") > 0) & (odds >= 3.0) & (surprise >= _SURPRISE))
        strong = strong.orderBy(F.desc("pos"), "prefix").limit(_MOST_STEMS * 10)
        stems = _stems([tuple(r) for r in strong.collect()], positives, negatives)
        whole = {p[1:]: w for p, w in stems.items() if p.startswith("$")}
        best = dict(sorted(((p, w) for p, w in stems.items() if not p.startswith("$")), key=lambda x: (-x[1], x[0]))[:_MOST_STEMS])
        words = dict.fromkeys(INSULTS, _FIXED_WEIGHT) | whole
        unfitted = Grammar(best, words)
        rows = _apply(sample, unfitted, "text", {"a": 0, "d": 1, "r": 2}).select("a", "d", "r", "toxic").toPandas()
        x = np.log1p(rows[["a", "d", "r"]].to_numpy(float))
        b = _fit(x, rows["toxic"].to_numpy(float))
        return Grammar(best, words, (float(b[0]), *(max(0.0, float(v)) for v in b[1:])))
    finally:
        sample.unpersist()


# --- scoring -------------------------------------------------------------------
_automata: dict[int, Automaton] = {}


def _apply(df: DataFrame, grammar: Grammar, text: str, results: dict[str, int | None]) -> DataFrame:
    """Adds a column for each result: the feature of that number, or the score for None."""
    keep = replace_columns(df, list(results))
    shared = df.sparkSession.sparkContext.broadcast(grammar)
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in keep or [text]]).alias("row"), F.col(f"`{text}`").alias("t"))
    schema = T.StructType([rows.schema["row"]] + [T.StructField(r, T.DoubleType()) for r in results])

    def work(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(shared.value)
        for batch in source:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            if set(results.values()) == {None}:
                made = [[automaton.score(t) for t in texts]]
            else:
                made = list(zip(*map(automaton.features, texts), strict=True)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(list(m), pa.float64()) for m in made)], names=schema.names)

    made = small_batches(rows).mapInArrow(tidied(work), schema)
    return made.select(*[F.col("row")[c].alias(c) for c in keep], *results)


def score_toxicity(df: DataFrame, grammar: Grammar, text: str = "text") -> DataFrame:
    """``df`` with ``score`` (0 to 1) and ``predicted``."""
    scored = _apply(df.select(*[f"`{c}`" for c in replace_columns(df, ["predicted"])]), grammar, text, {"score": None})
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_clean(df: DataFrame, grammar: Grammar, text: str = "text") -> DataFrame:
    """The rows of ``df`` with a score below one half, with their columns."""
    at = df.columns.index(text)
    shared = df.sparkSession.sparkContext.broadcast(grammar)

    def work(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(shared.value)
        for batch in source:
            yield batch.filter(pa.array([automaton.score(t) < 0.5 for t in batch.column(at).to_pylist()], pa.bool_()))

    return small_batches(df).mapInArrow(tidied(work), df.schema)
