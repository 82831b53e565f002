"""Toxicity by a weighted finite-state pattern grammar (operator 1).

Words become symbols (insult, threat verb, intent, target, negation, reporting
verb, quote, plain).  Five small transducers read the symbols of a clause:

* insult: an insult word gives its learned weight;
* threat: intent followed, within the clause, by a threat verb gives that verb's weight;
* target: a person addressed or named in the clause raises what is given;
* negation: a negator damps what follows within a few words;
* reported speech: a reporting verb or an open quote damps what it introduces.

They are composed into one machine (its states are tuples of theirs, its factors
the products of theirs), which is run over every clause that holds an insult or a
threat verb; what counts is the matched clause's score, not the word.  A
document's features (best clause, sum over clauses, sum by length) go through a
logistic function.

Insult weights and the logistic function are learned from labelled rows: at most
SAMPLE_TOXIC toxic and SAMPLE_CLEAN other rows (those with the smallest hash of
doc_id), and only rows whose crc32(doc_id) mod 5 is not 0.  Words and word
beginnings are weighed by the log odds of the toxic texts that use them (or of their
distinct contexts there, if those are fewer: copies of a text count once) against the
other texts that do; at most LEXICON of them are kept.

Defined results: null and empty texts have no clause and get the score of a
document without matches; repeated rows are scored alike; a null doc_id is not
held out and never learned from; several labels of one doc_id count as toxic if
any does; without usable labels the starting lexicon and a fixed logistic function hold.  Extra
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.scratch import save

#: Bounds of what is learned from.
SAMPLE_TOXIC, SAMPLE_CLEAN, CANDIDATES, LEXICON = 3000, 6000, 20000, 600
#: Least log odds, documents and part of the toxic documents of a learned form; lengths of word beginnings.
MIN_WEIGHT, MIN_USES, MIN_PART, STEMS = 2.0, 5, 0.02, (4, 5, 6, 7, 8)
START_WEIGHT = 3.0
#: Factors of the grammar.
TARGET_UP, NEGATED, REPORTED, THREAT_WEIGHT, REACH = 1.25, 0.35, 0.5, 4.0, 3

# Starting lexicon: general English; learned weights take its place where there are labels.
INSULTS = "idiot moron stupid dumb fool loser scum trash garbage pathetic worthless disgusting clown jerk liar coward creep filth vermin imbecile".split()
THREATS = "kill hurt destroy beat punch stab shoot crush murder attack ruin".split()
INTENTS = "will gonna shall going must should".split()
TARGETS = "you your yours he she him her they them their we us people everyone someone women men".split()
NEGATORS = "not no never none neither nor isn't aren't wasn't don't doesn't didn't without hardly".split()
REPORTERS = "said says say told tells wrote writes claimed claims called calls quoted reported according".split()

PLAIN, INSULT, THREAT, INTENT, TARGET, NEGATOR, REPORTER, QUOTE = range(8)
_CLASSES = {w: c for ws, c in ((INTENTS, INTENT), (TARGETS, TARGET), (NEGATORS, NEGATOR), (REPORTERS, REPORTER)) for w in ws}

_WORD = r"[^\W\d_]+(?:['’][^\W\d_]+)?"
_TOKEN = re.compile(_WORD + r"|[\"“”«»]")
_BREAK = re.compile(r"[.!?;:\n]")


class Transducer:
    """Deterministic: ``step(state, symbol) -> (state, factor)``; state 0 begins a clause."""

    def __init__(self, states: int, step):
        self.states = states
        self.table = [[step(s, x) for x in range(8)] for s in range(states)]

    def compose(self, other: Transducer) -> Transducer:
        """Both read the same symbols; factors multiply."""
        n = other.states

        def step(s: int, x: int):
            (a, f), (b, g) = self.table[s // n][x], other.table[s % n][x]
            return a * n + b, f * g
        return Transducer(self.states * n, step)


def grammar() -> Transducer:
    gives = Transducer(2, lambda s, x: (1 if x == INTENT else s, 1.0 if x == INSULT or (x == THREAT and s) else 0.0))  # insult and threat
    target = Transducer(2, lambda s, x: (1 if x == TARGET else s, TARGET_UP if s else 1.0))
    negation = Transducer(REACH + 1, lambda s, x: (REACH if x == NEGATOR else max(0, s - 1), NEGATED if s else 1.0))
    reported = Transducer(3, lambda s, x: ({REPORTER: max(s, 1), QUOTE: 0 if s == 2 else 2}.get(x, s), REPORTED if s else 1.0))
    return gives.compose(target).compose(negation).compose(reported)


class Scorer:
    def __init__(self, insults: dict[str, float]):
        self.words = {w: v for w, v in insults.items() if w[-1] != "*"}
        self.stems = {w[:-1]: v for w, v in insults.items() if w[-1] == "*"}
        self.machine = grammar().table
        whole = "|".join(map(re.escape, sorted([*self.words, *THREATS])))
        stems = "|".join(map(re.escape, sorted(self.stems)))
        self.trigger = re.compile(rf"(?<![^\W_])(?:(?:{whole})(?![^\W_])" + (rf"|(?:{stems})" if stems else "") + ")")

    def symbol(self, w: str) -> tuple[int, float]:
        x = _CLASSES.get(w)
        if x is not None:
            return x, 0.0
        if w in THREATS:
            return THREAT, THREAT_WEIGHT
        weight = max(self.words.get(w, 0.0), *(self.stems.get(w[:k], 0.0) for k in STEMS))
        return (INSULT, weight) if weight else (PLAIN if w[0].isalpha() else QUOTE, 0.0)

    def clause(self, text: str) -> float:
        """The score of one clause (lower case)."""
        state, total, later = 0, 0.0, 1.0
        for w in _TOKEN.findall(text):
            x, weight = self.symbol(w)
            state, factor = self.machine[state][x]
            if weight:
                total += factor * weight
            elif x == TARGET and total:
                later = TARGET_UP
        return total * later

    def features(self, text: str | None) -> tuple[float, float, float]:
        if not text:
            return 0.0, 0.0, 0.0
        low = text.lower()
        best = total = 0.0
        upto = 0
        for m in self.trigger.finditer(low):
            if m.start() < upto:
                continue  # in a clause that has been scored
            start = max(upto, *(low.rfind(c, upto, m.start()) + 1 for c in ".!?;:\n"))
            end = _BREAK.search(low, m.end())
            upto = end.start() if end else len(low)
            s = self.clause(low[start:upto])
            best, total = max(best, s), total + s
        return best, float(np.log1p(total)), 100.0 * total / (100.0 + len(low))


def _held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def _forms(word: str) -> list[str]:
    """What a word can be known by: itself, or one of its beginnings (marked by a star)."""
    return [word, *(word[:k] + "*" for k in STEMS if len(word) > k)]


def _uses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(form, doc_id, mark) of toxic texts: every form and what stands around it."""
    find = re.compile(_WORD).findall
    for b in batches:
        out: list[tuple] = []
        for d, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
            w = find((t or "").lower())
            out += {(f, d, zlib.crc32(f"{p} {x} {n}".encode())) for p, x, n in zip(["", *w], w, [*w[1:], ""], strict=False) for f in _forms(x)}
        cols = list(zip(*out, strict=True)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64())], names=["form", "doc_id", "mark"])


def learn_lexicon(sample: DataFrame) -> dict[str, float]:
    """Weights of insult words and word beginnings from (doc_id, text, toxic)."""
    n = {r.toxic: r.n for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not n.get(1) or not n.get(0):
        return dict.fromkeys(INSULTS, START_WEIGHT)
    uses = sample.where("toxic = 1").mapInArrow(_uses, "form string, doc_id long, mark long")
    t = (uses.groupBy("form").agg(F.least(F.countDistinct("doc_id"), F.countDistinct("mark")).alias("t"))
         .where((F.col("t") >= max(MIN_USES, MIN_PART * n[1])) & (F.length("form") > 2)).orderBy(F.desc("t"), "form").limit(CANDIDATES).collect())
    toxic = {r.form: r.t for r in t}
    wanted = set(toxic) | set(INSULTS)
    find = re.compile(_WORD).findall

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [f for t in b.column("text").to_pylist() for f in wanted.intersection(f for x in set(find((t or "").lower())) for f in _forms(x))]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["form"])

    c = {r.form: r.c for r in sample.where("toxic = 0").mapInArrow(clean, "form string").groupBy("form").agg(F.count("*").alias("c")).collect()}
    found = {f: float(np.log(((toxic.get(f, 0) + 0.5) / n[1]) / ((c.get(f, 0) + 0.5) / n[0]))) for f in wanted}
    best = sorted((f for f in toxic if found[f] >= MIN_WEIGHT and f not in _CLASSES and f not in THREATS), key=lambda f: (-found[f] * np.log1p(toxic[f]), f))[:LEXICON]
    start = {w: START_WEIGHT for w in INSULTS if w not in toxic and not c.get(w)}
    return start | {f: min(found[f], 8.0) for f in best}


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 30) -> np.ndarray:
    """Newton's method with a ridge penalty; classes weigh alike."""
    a = np.column_stack([np.ones(len(x)), x])
    w = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
    beta = np.zeros(a.shape[1])
    pen = ridge * np.eye(len(beta)) * len(y)
    pen[0, 0] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -30, 30)))
        h = (a * (w * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ a + pen
        beta = beta + np.linalg.solve(h, a.T @ (w * (y - p)) - pen @ beta)
    return beta


#: Used without labels: one plain insult of the starting weight is just under 0.5.
DEFAULT_BETA = (-3.0, 0.6, 0.8, 0.0)


def fit(docs: DataFrame, labels: DataFrame) -> tuple[dict[str, float], tuple[float, ...]]:
    """(lexicon, logistic coefficients) from the labelled rows that aren't held out."""
    known = (labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
             .where(~_held_out()).join(docs.select("doc_id").distinct(), "doc_id", "left_semi"))
    draw = [F.xxhash64("doc_id"), F.col("doc_id")]
    ids = (known.where("toxic > 0").orderBy(*draw).limit(SAMPLE_TOXIC).select("doc_id", F.lit(1).alias("toxic"))
           .unionByName(known.where("toxic = 0").orderBy(*draw).limit(SAMPLE_CLEAN).select("doc_id", F.lit(0).alias("toxic"))))
    sample = save(docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").dropDuplicates(["doc_id"]))  # at most SAMPLE_TOXIC + SAMPLE_CLEAN rows
    lexicon = learn_lexicon(sample)
    scorer = Scorer(lexicon)

    def facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f = [scorer.features(t) for t in b.column("text").to_pylist()]
            cols = [pa.array([r[k] for r in f], pa.float64()) for k in range(3)]
            yield pa.RecordBatch.from_arrays([*cols, b.column("toxic")], names=["a", "b", "c", "toxic"])

    got = sample.mapInArrow(facts, "a double, b double, c double, toxic int").toArrow()
    y = got.column("toxic").to_numpy()
    if not (y == 1).any() or not (y == 0).any():
        return lexicon, DEFAULT_BETA
    x = np.column_stack([got.column(k).to_numpy() for k in "abc"])
    return lexicon, tuple(float(v) for v in fit_logistic(x, y))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``."""
    docs = docs.select("doc_id", "text")
    lexicon, beta = fit(docs, labels)
    made: list[Scorer] = []

    def score(texts: pa.Array) -> pa.Array:
        if not made:
            made.append(Scorer(lexicon))
        x = np.array([made[0].features(t) for t in texts.to_pylist()], np.float64).reshape(-1, 3)
        return pa.array(1 / (1 + np.exp(-np.clip(beta[0] + x @ np.array(beta[1:]), -30, 30))))

    out = docs.select("doc_id", _held_out().alias("held_out"), F.arrow_udf(score, "double")("text").alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
