"""Toxicity by a weighted finite-state pattern grammar.

A lexical transducer turns words into classes (insult, threat, target,
negation, reported speech).  Over the classes of a clause run three transducers
composed into one: negation reaches a few words on, a reporting verb covers what
follows up to a comma or conjunction, a target sharpens what stands in its clause.  The composed
machine gives weighted events; a logistic model over an event's kinds scores a
document.  Insults are learned: word forms and stems that mark labelled rows.
"""

from __future__ import annotations

import json
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, unfold, with_row
from .shingles import settle

WORD = re.compile(r"[^\W\d_]+")
CLAUSE = re.compile(r"[.!?;:|\n]+")
TOKEN = re.compile(r"[^\W\d_]+|,")
#: Words of the grammar that labels need not teach.
SEEDS = {
    "insult": "idiot idiots moron morons imbecile imbécile dumbass bastard scumbag asshole loser losers stupid pathetic worthless dummkopf arschloch abruti connard idiota imbécil estúpido",
    "threat": "kill hurt destroy strangle stab shoot beat smash töten umbringen tuer frapper matar golpear",
    "target": "you your yourself u him her them he she they du dich ihr euch tu toi vous te usted ustedes",
    "negation": "not never no nobody isn aren wasn don doesn nicht nie kein keine pas jamais aucun nunca jamás tampoco",
    "report": "said says told claimed called wrote quoted reported sagte schrieb nannte dit disait écrit dijo escribió llamó",
    "break": ", and but or und aber oder et mais ou y pero o",
}
CLASSES = ("insult", "threat", "target", "negation", "report", "break", "other")
EVENTS = tuple(f"{kind}{neg}{rep}{tgt}" for kind in ("insult", "threat") for neg in ("", "-not") for rep in ("", "-said") for tgt in ("", "-at"))


class Transducer:
    """A deterministic weighted transducer; arcs[state][symbol] = (state, output, weight), "*" for any other symbol (copied)."""

    def __init__(self, arcs: dict, start=0):
        self.arcs, self.start = arcs, start

    def step(self, state, symbol: str):
        arc = self.arcs[state].get(symbol) or self.arcs[state]["*"]
        return arc[0], symbol if arc[1] is None else arc[1], arc[2]

    def compose(self, other: Transducer, symbols) -> Transducer:
        """Both in a row as one machine over `symbols`; weights add."""
        start, arcs = (self.start, other.start), {}
        todo = [start]
        while todo:
            if (state := todo.pop()) in arcs:
                continue
            arcs[state] = {}
            for symbol in symbols:
                a, middle, w = self.step(state[0], symbol)
                b, out, v = other.step(state[1], middle)
                arcs[state][symbol] = ((a, b), out, w + v)
                todo.append((a, b))
        return Transducer(arcs, start)


SEEN = ("insult", "threat", "insult-not", "threat-not")


def aimed() -> Transducer:
    """Marks the insults and threats after a target; run backwards, those before one."""
    said = [f"{k}{s}" for k in SEEN for s in ("", "-said")]
    return Transducer({0: {"target": (1, None, 0.0), "*": (0, None, 0.0)}, 1: {"*": (1, None, 0.0)} | {k: (1, f"{k}-at", 0.3) for k in said}})


def grammar(reach: int = 3) -> Transducer:
    """Negation, reported speech and target composed: classes of a clause in, events out.

    A comma or conjunction ends the reach of a negation and of a reporting verb.
    The machine reads a clause from left to right; aimed() then reads its output
    from right to left, for a target may follow what is aimed at it.
    """
    negation = {}
    for left in range(reach + 1):
        after = max(left - 1, 0)
        negation[left] = {"negation": (reach, None, 0.0), "break": (0, None, 0.0), "*": (after, None, 0.0)}
        if left:
            negation[left] |= {k: (after, f"{k}-not", -0.5) for k in ("insult", "threat")}
    report = {0: {"report": (1, None, 0.0), "*": (0, None, 0.0)}, 1: {"break": (0, None, 0.0), "*": (1, None, 0.0)} | {k: (1, f"{k}-said", -0.3) for k in SEEN}}
    return Transducer(negation).compose(Transducer(report), CLASSES).compose(aimed(), CLASSES)


class Scorer:
    """A fitted model: lexicon {form or stem*: weight} and the logistic weights of the events."""

    def __init__(self, model: dict):
        self.forms = {w: (k, 1.0) for k, ws in SEEDS.items() for w in ws.split()}
        self.stems = {}
        for entry, weight in model["lexicon"].items():
            (self.stems if entry[-1] == "*" else self.forms)[entry.rstrip("*")] = ("insult", weight)
        self.lengths = sorted({len(s) for s in self.stems})
        self.machine, self.back, self.memo = grammar(), aimed(), {}
        self.bias, self.beta = model["bias"], np.array(model["beta"])

    def kind(self, word: str):
        if word not in self.memo:
            if len(self.memo) > 200_000:
                self.memo.clear()
            found = self.forms.get(word)
            for n in self.lengths:
                found = found or (self.stems.get(word[:n]) if len(word) >= n else None)
            self.memo[word] = found
        return self.memo[word]

    def events(self, text: str) -> np.ndarray:
        """Summed weights of a text's events by kind, and how many words it has."""
        out = np.zeros(len(EVENTS) + 1)
        low = text.lower()
        words = WORD.findall(low)
        memo, kind = self.memo, self.kind
        strong = {w for w in set(words) if (c := memo[w] if w in memo else kind(w)) and c[0] in ("insult", "threat")}
        out[-1] = len(words)
        if strong:
            for clause in CLAUSE.split(low):
                inside = TOKEN.findall(clause)
                if strong.isdisjoint(inside):
                    continue
                classes = [self.kind(w) or ("other", 0.0) for w in inside]
                state, found = self.machine.start, []
                for name, weight in classes:
                    state, event, extra = self.machine.step(state, name)
                    found.append((event, weight + extra))
                state = self.back.start
                for name, weight in reversed(found):
                    state, event, extra = self.back.step(state, name)
                    if event in _EVENT_AT:
                        out[_EVENT_AT[event]] += max(weight + extra, 0.1)
        return out

    def score(self, text: str | None) -> float:
        x = features(self.events(text or ""))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.bias + float(x @ self.beta)))))


_EVENT_AT = {e: k for k, e in enumerate(EVENTS)}


def features(events: np.ndarray) -> np.ndarray:
    sums = events[:-1]
    return np.concatenate((np.log1p(sums), [math.log1p(sums.sum()), float(sums[:8].sum() > 0), 100 * sums.sum() / (100 + events[-1])]))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 60) -> tuple[float, list[float]]:
    """Newton steps on the ridge-penalised likelihood."""
    design = np.column_stack((np.ones(len(x)), x))
    beta = np.zeros(design.shape[1])
    penalty = np.eye(len(beta)) * ridge * len(x)
    penalty[0, 0] = 1e-6 * len(x)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        step = np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + penalty, design.T @ (y - p) - penalty @ beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return float(beta[0]), beta[1:].tolist()


def _entries(word: str, stems: tuple[int, ...]) -> list[str]:
    return [word, *[f"{word[:n]}*" for n in stems if len(word) > n]]


def learn(rows: list[tuple[str, int]], stems: tuple[int, ...] = (4, 5, 6), least_odds: float = 3.0, size: int = 2000) -> dict:
    """Lexicon and logistic weights from (text, toxic) rows; the seeds alone where a label is missing.

    Toxic texts that share their smallest word hashes count once, so a group of
    copies teaches no word of its own.
    """
    clean, held, toxic = sum(not label for _, label in rows), set(), []
    for k, (text, label) in enumerate(rows):
        if label:
            copy = tuple(sorted({zlib.crc32(w.encode()) for w in WORD.findall(text.lower())})[:3])
            if copy not in held:
                held.add(copy)
                toxic.append(k)
    lexicon: dict[str, float] = {}
    if toxic and clean:
        # entries are counted by hash first, so that the many rare ones are never held as strings
        entries = lambda text: {e for w in set(WORD.findall(text.lower())) for e in _entries(w, stems)}
        hashes, n = np.unique(np.concatenate([np.unique(np.array([zlib.crc32(e.encode()) for e in entries(rows[k][0])], np.uint32)) for k in toxic]), return_counts=True)
        least = max(4, 0.003 * len(toxic))
        often = set(hashes[n >= least].tolist())
        hits = Counter(e for k in toxic for e in entries(rows[k][0]) if zlib.crc32(e.encode()) in often)
        hits = {e: n for e, n in hits.items() if n >= least}
        misses: Counter[str] = Counter()
        for text, label in rows:  # one text's words at a time
            if not label:
                misses.update(e for e in entries(text) if e in hits)
        odds = {e: math.log((n + 0.5) / (len(toxic) + 1)) - math.log((misses[e] + 0.5) / (clean + 1)) for e, n in hits.items()}
        best = sorted((e for e in odds if odds[e] >= least_odds), key=lambda e: (-odds[e] * hits[e], e))[:size]
        lexicon = {e: round(min(odds[e], 8.0) / 4, 4) for e in best}
    model = {"lexicon": lexicon, "bias": -2.0, "beta": [1.0] * len(EVENTS) + [1.0, 2.0, 0.0]}
    if toxic and clean:
        scorer = Scorer(model)
        x = np.array([features(scorer.events(text)) for text, _ in rows])
        model["bias"], model["beta"] = _logistic(x, np.array([y for _, y in rows], float), ridge=1e-4)
    return model


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_rows: int = 12_000) -> dict:
    """Learn from at most `max_rows` labelled rows, those of the smallest id hashes whose crc32(id) mod 4 is not 2.

    Rows whose id or label is null teach nothing; of a repeated id the smallest
    text and the largest label count.  The bounded sample is fitted in one task.
    """
    known = labels.select(column(id_col).alias("i"), column(label_col).cast("int").alias("y")).where("i is not null and y is not null")
    known = known.where(~held_out(F.col("i"))).groupBy("i").agg(F.max("y").alias("y")).orderBy(F.xxhash64("i"), "i").limit(max_rows)
    rows = docs.select(column(id_col).alias("i"), column(text_col).alias("t")).join(F.broadcast(known), "i")
    rows = rows.groupBy("i").agg(F.min("t").alias("t"), F.max("y").alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = sorted((i, t or "", y) for b in batches for i, t, y in zip(*(c.to_pylist() for c in b.columns), strict=True))
        yield pa.RecordBatch.from_arrays([pa.array([json.dumps(learn([x[1:] for x in found]))])], names=["model"])
        del found
        settle()

    found = rows.select("i", "t", "y").repartition(1).mapInArrow(run, "model string").first()  # no task without rows
    return json.loads(found[0]) if found else learn([])


def score(docs: DataFrame, model: dict, text_col: str = "text") -> DataFrame:
    """The input's columns, then score (double, 0 to 1; null and empty texts get that of no event)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most `size` entries

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(shared.value)
        for texts in batches:
            yield pd.Series([scorer.score(t) for t in texts], dtype="float64")
        settle()

    rows = with_row(docs, __text=text_col)
    return unfold(rows, docs.columns, score=run("__text"))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3, max_rows: int = 12_000) -> DataFrame:
    """The input's columns with held_out, score and predicted (1 from `threshold` on).

    Columns of those names in the input are replaced.  Every row is scored, null
    and empty texts too; repeated rows get equal scores; an empty table or one
    without labels is scored by the seeds alone.
    """
    scored = score(docs, fit(docs, labels, id_col, text_col, max_rows=max_rows), text_col)
    held = held_out(column(id_col))
    return scored.withColumns({"held_out": held, "predicted": (F.col("score") >= threshold).cast("int")})
