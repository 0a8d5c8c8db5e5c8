"""Toxicity by a weighted lexicon, matched in one Aho-Corasick pass over folded text.

Folding undoes disguises: look-alike letters of other scripts, digits and signs inside words.
The lexicon (word stems, anchored at the start of a word), the exception phrases and the
weights of the final score are learnt from labelled rows.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymesh.llm.common import held_out, id_and_text, map_rows
from waymesh.session import cut, retire

# Look-alikes of other scripts, and digits and signs that stand for letters.
HOMOGLYPHS = {
    "а": "a", "в": "b", "е": "e", "ё": "e", "з": "3", "і": "i", "ї": "i", "ј": "j", "к": "k", "м": "m", "н": "h",
    "о": "o", "р": "p", "с": "c", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ԁ": "d", "ԛ": "q", "ԝ": "w", "һ": "h",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u",
    "χ": "x", "γ": "y", "ı": "i", "ɑ": "a", "ɡ": "g", "ո": "n", "օ": "o", "ս": "u",
}
SUBSTITUTES = {"0": "o", "1": "i", "l": "i", "|": "i", "!": "i", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "€": "e"}
INVISIBLE = "­​‌‍⁠﻿"
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "class clown", "clown fish", "sore loser", "stupid simple")

TOKEN = re.compile(r"[^\W_]+(?:[@$!|€][^\W_]+)*")
_EARLY = str.maketrans(HOMOGLYPHS | dict.fromkeys(INVISIBLE, ""))
_INNER = str.maketrans(SUBSTITUTES)

STEMS = range(3, 9)
#: About so many labelled rows of either label are used to fit.
FIT_ROWS = 10_000
#: A stem enters the lexicon, and a phrase the exceptions, if the lower end of its share's
#: interval (Wilson, this many deviations) is above one half.
DEVIATIONS = 2.5
REMEMBERED = 300_000


def fold_word(token: str) -> str:
    """``token`` with digits and signs read as letters, if it has a letter; l, I and 1 look alike."""
    return token.translate(_INNER) if any(c.isalpha() for c in token) else token


class Folded(dict):
    """Tokens already folded."""

    def __missing__(self, token: str) -> str:
        self[token] = folded = fold_word(token)
        return folded

    def words(self, text: str) -> list[str]:
        if not text.isascii() and not unicodedata.is_normalized("NFKC", text):
            text = unicodedata.normalize("NFKC", text)
        text = text.lower()
        if not text.isascii():
            text = text.translate(_EARLY)
        words = list(map(self.__getitem__, TOKEN.findall(text)))
        if len(self) > REMEMBERED:
            self.clear()
        return words


def lower_share(part: float, whole: float, deviations: float = DEVIATIONS) -> float:
    """The lower end of the Wilson interval of ``part / whole``."""
    if whole <= 0:
        return 0.0
    p, z = part / whole, deviations * deviations
    return (p + z / (2 * whole) - deviations * math.sqrt(p * (1 - p) / whole + z / (4 * whole * whole))) / (1 + z / whole)


@dataclass
class Lexicon:
    """Weights of word stems, benign phrases, and the weights of the score: constant, total, density."""

    stems: dict[str, float]
    phrases: list[str]
    weights: tuple[float, float, float] = (-4.0, 0.0, 0.0)

    def automaton(self) -> ahocorasick.Automaton | None:
        machine = ahocorasick.Automaton()
        for stem, weight in self.stems.items():
            machine.add_word(" " + stem, (len(stem) + 1, weight))
        for phrase in self.phrases:
            folded = " " + " ".join(fold_word(w) for w in phrase.split()) + " "
            machine.add_word(folded, (len(folded), None))
        if not len(machine):
            return None
        machine.make_automaton()
        return machine


def hits_of(words: list[str], machine: ahocorasick.Automaton | None) -> dict[int, float]:
    """Start of each word that a stem matches -> weight; words inside exception phrases don't count."""
    if machine is None or not words:
        return {}
    hits: dict[int, float] = {}
    spared: list[tuple[int, int]] = []
    for last, (size, weight) in machine.iter(f" {' '.join(words)} "):
        start = last - size + 1
        if weight is None:
            spared.append((start, last))
        else:
            hits[start] = max(weight, hits.get(start, 0.0))
    return {s: w for s, w in hits.items() if not any(a <= s < b for a, b in spared)}


def features(words: list[str], machine: ahocorasick.Automaton | None) -> tuple[float, float]:
    """Total weight, and weight for a hundred words, both damped."""
    total = sum(hits_of(words, machine).values())
    return math.log1p(total), math.log1p(100 * total / max(1, len(words)))


def _counted(rows: DataFrame, units, columns: str = "unit string, toxic int, n long") -> DataFrame:
    """In how many rows of either label each of ``units(words)`` occurs, counted on the cluster."""

    def make():
        fold, found = Folded(), units()

        def work(batch: pd.DataFrame) -> pd.DataFrame:
            made = {0: Counter(), 1: Counter()}
            for text, toxic in zip(batch["text"], batch["toxic"], strict=True):
                made[toxic].update(found(fold.words(text)))
            return pd.DataFrame([(u, t, n) for t in made for u, n in made[t].items()], columns=["unit", "toxic", "n"])

        return work

    return (
        map_rows(rows, make, columns)
        .groupBy("unit")
        .agg(F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("bad"), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("good"))
    )


def sample(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> tuple[DataFrame, float]:
    """``(text, toxic)`` of about ``fit_rows`` labelled documents of each label, written once.

    The second value is by how much benign rows were thinned more than toxic ones. Documents
    with several labels are toxic if one says so. The ids that are drawn, never more than about
    twice ``fit_rows``, are sent to the tasks, so texts are not shuffled.
    """
    known = labels.where("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    sizes = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    share = [min(1.0, fit_rows / max(1, sizes.get(label, 0))) for label in (0, 1)]
    lot = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000))
    drawn = known.where(lot < F.when(F.col("toxic") == 1, math.ceil(1e6 * share[1])).otherwise(math.ceil(1e6 * share[0])))
    return cut(docs.join(F.broadcast(drawn), "doc_id").where("text is not null").select("text", "toxic"), "labelled"), share[1] / share[0]


def fit(chosen: DataFrame, grow: float = 1.0) -> Lexicon:
    """A lexicon from ``chosen(text, toxic)``; ``grow`` is how many rows a benign row stands for."""
    sizes = {r["toxic"]: r["count"] for r in chosen.groupBy("toxic").count().collect()}
    if not sizes.get(0) or not sizes.get(1):
        return Lexicon({}, [])

    def stems():
        return lambda words: {w[:n] for w in set(words) for n in STEMS if len(w) >= n} | {w for w in set(words) if len(w) > STEMS[-1]}

    counts = _counted(chosen, stems).where("bad >= 4").where(F.col("bad") > F.col("good") * grow).toPandas()
    stems_found: dict[str, float] = {}
    for row in sorted(counts.itertuples(), key=lambda r: (len(r.unit), r.unit)):
        if any(row.unit[:n] in stems_found for n in range(1, len(row.unit))):
            continue
        if lower_share(row.bad, row.bad + row.good * grow) > 0.5:
            bad, good = (row.bad + 0.5) / (sizes[1] + 1), (row.good + 0.5) / (sizes[0] + 1)
            stems_found[row.unit] = max(0.1, math.log(bad / good))
    lexicon = Lexicon(stems_found, list(EXCEPTIONS))

    def phrases():
        machine = Lexicon(stems_found, []).automaton()

        def found(words: list[str]) -> set[str]:
            starts, at = {}, 0
            for i, w in enumerate(words):
                starts[at] = i
                at += len(w) + 1
            out = set()
            for start in hits_of(words, machine):
                i = starts[start]
                out |= {" ".join(words[a : a + 2]) for a in (i - 1, i) if a >= 0 and a + 2 <= len(words)}
            return out

        return found

    if stems_found:
        benign = _counted(chosen, phrases).where("good >= 4").where(F.col("good") * grow > F.col("bad")).toPandas()
        lexicon.phrases += sorted(r.unit for r in benign.itertuples() if lower_share(r.good * grow, r.good * grow + r.bad) > 0.5)

    def measure():
        machine, fold = lexicon.automaton(), Folded()

        def work(batch: pd.DataFrame) -> pd.DataFrame:
            rows = [(*features(fold.words(t), machine), y) for t, y in zip(batch["text"], batch["toxic"], strict=True)]
            return pd.DataFrame(rows, columns=["total", "density", "toxic"])

        return work

    measured = map_rows(chosen, measure, "total double, density double, toxic int").toPandas()
    x = np.column_stack([np.ones(len(measured)), measured["total"], measured["density"]])
    y = measured["toxic"].to_numpy(dtype=np.float64)
    weight = np.where(y == 1, 1.0, grow)
    lexicon.weights = tuple(logistic(x, y, weight))
    return lexicon


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    """Weights of a logistic regression, by Newton's method; ``ridge`` keeps them finite."""
    beta = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        slope = x.T @ (weight * (y - p)) - ridge * beta
        bend = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1])
        step = np.linalg.solve(bend, slope)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def score_toxicity(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, score, predicted, n_hits``.

    Null and empty texts have no hits and get the score of no hits. Repeated rows and null ids
    keep their rows; an empty table gives none; further columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def make():
        machine, fold, (constant, by_total, by_density) = shared.value.automaton(), Folded(), shared.value.weights

        def work(batch: pd.DataFrame) -> pd.DataFrame:
            rows = []
            for text in batch["text"]:
                words = fold.words(text) if text else []
                total, density = features(words, machine)
                score = 1 / (1 + math.exp(-max(-30.0, min(30.0, constant + by_total * total + by_density * density))))
                rows.append((score, int(score >= 0.5), len(hits_of(words, machine)) if total else 0))
            out = pd.DataFrame(rows, columns=["score", "predicted", "n_hits"])
            out.insert(0, "doc_id", batch["doc_id"].to_numpy(dtype=object))
            return out

        return work

    return map_rows(id_and_text(docs, id_col, text_col), make, "doc_id long, score double, predicted int, n_hits int")


def predict_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Fit on labelled rows that are not held out, score all: ``doc_id, held_out, score, predicted, n_hits``."""
    kept_back = held_out(F.col("doc_id"), 5, 0)
    chosen, grow = sample(id_and_text(docs), labels.select("doc_id", "toxic").where(~kept_back))
    lexicon = fit(chosen, grow)
    retire(chosen)
    return score_toxicity(docs, lexicon).select("doc_id", kept_back.alias("held_out"), "score", "predicted", "n_hits")
