"""Toxicity: a weighted finite-state pattern grammar over the clauses of a text."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed word lists of the grammar's closed classes (English, German, French, Spanish).
THREAT = "kill hurt destroy beat murder shoot stab burn strangle crush umbringen töten schlagen vernichten verprügeln tuer frapper détruire brûler matar golpear destruir quemar".split()
TARGET = "you your yours u he she they him her them those these people du dich dir dein ihr euch sie er tu te toi vous votre il elle ils elles tú ti usted ustedes él ella ellos ellas".split()
NEGATION = "not no never none cannot don't isn't wasn't aren't nicht kein keine keinen nie niemals ne pas jamais aucun nunca jamás tampoco".split()
REPORT = "said says say called calls wrote writes claimed claims quoted according allegedly sagte sagt schrieb nannte angeblich dit disait écrit appelé selon dijo dice escribió llamó según".split()

OTHER, INSULT, THREATS, TARGETS, NEGATIONS, REPORTS = range(6)
_CLASS = {w: c for c, words in ((THREATS, THREAT), (TARGETS, TARGET), (NEGATIONS, NEGATION), (REPORTS, REPORT)) for w in words}
WORD = regex.compile(r"[\p{L}\p{M}]+(?:['’][\p{L}]+)*")
CLAUSE = regex.compile(r"[.!?;:,\n\r]+")
MARKS = ("plain", "targeted", "negated", "reported", "threat")
STEMS = (4, 5, 6, 7, 8)


class Transducer:
    """A deterministic transducer over word classes: ``table[state][class]`` is the next state, ``out[state]`` its mark."""

    def __init__(self, table: list[list[int]], out: list[frozenset]):
        self.table, self.out = table, out

    def __and__(self, other: Transducer) -> Transducer:
        """Both at once: states are pairs, marks are joined."""
        width, right = len(self.table[0]), len(other.table)
        table = [[a[c] * right + b[c] for c in range(width)] for a in self.table for b in other.table]
        return Transducer(table, [x | y for x in self.out for y in other.out])

    def run(self, classes: list[int]) -> list[frozenset]:
        state, marks = 0, []
        for c in classes:
            state = self.table[state][c]
            marks.append(self.out[state])
        return marks


def scope(opener: int, reach: int, mark: str) -> Transducer:
    """Marks the ``reach`` words from an opener on, the opener included."""
    rows = [[reach if c == opener else max(0, s - 1) for c in range(6)] for s in range(reach + 1)]
    return Transducer(rows, [frozenset((mark,)) if s else frozenset() for s in range(reach + 1)])


#: What a word's surroundings in its clause say: negated within three words, reported until the clause ends
#: (forty words at most), a target within five words on either side.
AHEAD = scope(NEGATIONS, 4, "negated") & scope(REPORTS, 40, "reported") & scope(TARGETS, 6, "targeted")
BEHIND = scope(TARGETS, 6, "targeted")


class Grammar:
    """The composed grammar with its learned insult weights (whole words and stems) and its logistic weights."""

    def __init__(self, words: dict[str, float], stems: dict[str, float]):
        self.learn(words, stems)
        self.weights: np.ndarray | None = None  # nothing learned: every score is 0

    def learn(self, words: dict[str, float], stems: dict[str, float]) -> Grammar:
        """Takes the insult weights; a word with another beginning than all of them is passed by."""
        self.words, self.stems = words, stems
        self.heads = {t[:STEMS[0]] for t in (*words, *stems)}
        return self

    def insult(self, word: str) -> float:
        if word[:STEMS[0]] not in self.heads:
            return 0.0
        got = self.words.get(word, 0.0)
        for n in STEMS:
            if len(word) >= n:
                got = max(got, self.stems.get(word[:n], 0.0))
        return got

    def clauses(self, text: str) -> Iterator[dict[str, float]]:
        """Marked weights of every clause that holds an insult or a threat."""
        text = text.lower()
        known = {w for w in set(WORD.findall(text)) if self.insult(w) or _CLASS.get(w) == THREATS}
        if not known:
            return
        at, pieces = 0, []
        for m in CLAUSE.finditer(text):
            pieces.append(text[at:m.start()])
            at = m.end()
        pieces.append(text[at:])
        for piece in pieces:
            words = WORD.findall(piece)
            if known.isdisjoint(words):
                continue
            weight = [self.insult(w) if w in known else 0.0 for w in words]
            classes = [INSULT if g else _CLASS.get(w, OTHER) for w, g in zip(words, weight)]
            ahead, behind = AHEAD.run(classes), BEHIND.run(classes[::-1])[::-1]
            score = dict.fromkeys(MARKS, 0.0)
            for c, g, a, b in zip(classes, weight, ahead, behind):
                marks = a | b
                if c == THREATS and "targeted" in marks:
                    score["threat"] += 0.5 if marks & {"negated", "reported"} else 1.0
                elif c == INSULT:
                    # one path a word: negation and report outrank the target
                    score[next((m for m in ("negated", "reported", "targeted") if m in marks), "plain")] += g
            yield score

    def features(self, text: str) -> np.ndarray:
        """Clause scores of a text: the sum of each mark on a log scale, the strongest clause, and any match."""
        out = np.zeros(len(MARKS) + 3)
        out[0], best = 1.0, 0.0
        sums = np.zeros(len(MARKS))
        for score in self.clauses(text):
            row = np.array([score[m] for m in MARKS])
            sums += row
            best = max(best, float(row.sum()))
        out[1:1 + len(MARKS)] = np.log1p(sums)
        out[-2], out[-1] = math.log1p(best), float(best > 0)
        return out

    def score(self, text: str) -> float:
        if self.weights is None:
            return 0.0
        return 1.0 / (1.0 + math.exp(-float(np.clip(self.features(text) @ self.weights, -30, 30))))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1, steps: int = 30) -> np.ndarray:
    """Ridge logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (p - y) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _evidence(toxic: int, clean: int, all_toxic: int, all_clean: int) -> tuple[float, float]:
    """(log odds, likelihood ratio statistic) of a term seen in so many toxic and clean texts."""
    odds = math.log((toxic + 0.5) / (all_toxic + 1)) - math.log((clean + 0.5) / (all_clean + 1))
    share, seen = all_toxic / (all_toxic + all_clean), toxic + clean
    g = 2 * sum(k * math.log(k / (seen * s)) for k, s in ((toxic, share), (clean, 1 - share)) if k)
    return odds, g


def fit(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "toxic",
        use: Column | None = None, sample: int = 12_000, lexicon: int = 4000, min_odds: float = 3.5,
        min_evidence: float = 25.0, seed: int = 5) -> Grammar:
    """The grammar with weights from labelled texts.

    At most ``sample`` labelled ids, those of the smallest hashes, are used:
    the ids are chosen from the labels alone, and their texts found by a join
    with that bounded list, one text (the smallest) for each id. The insult transducer's words and stems are those whose document counts
    by label, summed by Spark, are evidence enough, at most ``lexicon`` of each. The
    logistic weights of the clause scores are fitted to the same texts.
    An id labelled more than once is toxic if any label says so; null ids and labels are left out. With no toxic or
    no clean text nothing is learned and every score is 0."""
    ids = labels.select(F.col(f"`{doc_id}`").cast("long").alias("id"), F.col(f"`{label}`").cast("int").alias("y"))
    ids = ids.where("id IS NOT NULL AND y IS NOT NULL").groupBy("id").agg((F.max("y") > 0).cast("int").alias("y"))
    if use is not None:
        ids = ids.withColumnRenamed("id", doc_id).where(use).withColumnRenamed(doc_id, "id")
    chosen = ids.orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(sample)
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    # one text an id, the smallest, however many rows repeat the id
    rows = rows.join(F.broadcast(chosen), "id").where("text IS NOT NULL").groupBy("id", "y").agg(F.min("text").alias("text")).select("text", "y")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: Counter = Counter()
            for t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = set(WORD.findall(t.lower()))
                terms = {("w", w) for w in words} | {("s", w[:n]) for w in words for n in STEMS if len(w) >= n} | {("n", "")}
                seen.update((k, w, y) for k, w in terms)
            keys = list(seen)
            yield pa.record_batch([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()),
                                   pa.array([seen[k] if k[2] else 0 for k in keys], pa.int64()),
                                   pa.array([0 if k[2] else seen[k] for k in keys], pa.int64())],
                                  names=["kind", "term", "toxic", "clean"])

    counts = rows.mapInArrow(count, "kind string, term string, toxic long, clean long").groupBy("kind", "term").agg(
        F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    seen = counts.where("kind = 'n' OR toxic >= 5").orderBy(F.desc(F.col("toxic") - F.col("clean")), "kind", "term")
    found = seen.limit(2 * lexicon).collect()
    total = counts.where("kind = 'n'").first()
    grammar = Grammar({}, {})
    if total is None or not total["toxic"] or not total["clean"]:
        return grammar
    words, stems = {}, {}
    for r in found:
        odds, evidence = _evidence(r["toxic"], r["clean"], total["toxic"], total["clean"])
        if r["kind"] != "n" and odds >= min_odds and evidence >= min_evidence and r["term"] not in _CLASS:
            (words if r["kind"] == "w" else stems)[r["term"]] = odds
    grammar.learn(words, stems)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [grammar.features(t).tolist() for t in batch.column(0).to_pylist()]
            yield pa.record_batch([pa.array(x, pa.list_(pa.float64())), batch.column(1)], names=["x", "y"])

    fitted = rows.mapInArrow(describe, "x array<double>, y int").groupBy("x", "y").count().collect()  # at most ``sample`` rows
    x = np.array([r["x"] for r in fitted for _ in range(r["count"])])
    grammar.weights = _logistic(x, np.array([r["y"] for r in fitted for _ in range(r["count"])], float))
    return grammar


def score(docs: DataFrame, grammar: Grammar, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score) of every whole text; null texts score as empty ones, which match no clause.

    Row by row without a shuffle, so repeated rows score alike; other columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [grammar.score(t or "") for t in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(got, pa.float64())], names=["doc_id", "score"])

    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, score double")
