"""Language identification by known words first, then shorter and shorter character n-grams.

A word of the model adds its log frequency in every language. An unseen word is covered from
the left by the longest known n-gram that fits, down to single characters.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymesh.llm.common import held_out, id_and_text, map_rows
from waymesh.session import cut, retire

#: Fractions, powers, numbered signs and the like, which count as word characters but are no letters.
NUMBER_SIGNS = "".join(c for c in map(chr, range(0x20000)) if c.isnumeric() and not c.isalpha() and not c.isdecimal())
#: Signs are taken out beforehand: beside ``\W`` in one class, or beyond the basic plane, each would be tried for every letter.
SIGN = re.compile("[" + "".join(c for c in NUMBER_SIGNS if c <= "\uffff") + "]")
HIGH = re.compile("[\U00010000-\U0010ffff]")
HIGH_SIGN = re.compile("[" + "".join(c for c in NUMBER_SIGNS if c > "\uffff") + "]")
WORD = re.compile(r"[^\W\d_]+")
UNDETERMINED = "und"
LONGEST_GRAM = 5
#: The model is fitted on about so many labelled rows of each language, picked by a hash of the id.
FIT_ROWS = 2000
#: A word or n-gram is known from so many occurrences on.
LEAST_COUNT = 3
#: Unseen words a task remembers before it forgets them all.
REMEMBERED = 150_000


def words_of(text: str) -> list[str]:
    """Runs of letters, in lower case."""
    text = text.lower()
    if not text.isascii():
        text = SIGN.sub(" ", text)
        if HIGH.search(text):
            text = HIGH_SIGN.sub(" ", text)
    return WORD.findall(text)


@dataclass
class LanguageModel:
    """Log frequencies: one row of ``vectors`` for each word, then each n-gram."""

    languages: list[str]
    words: dict[str, int]
    grams: dict[str, int]
    vectors: np.ndarray

    def backed_off(self, word: str) -> np.ndarray:
        """The longest known n-grams from left to right; unknown characters say nothing."""
        padded, at, total = f"_{word}_", 0, np.zeros(len(self.languages), dtype=np.float32)
        while at < len(padded):
            for n in range(min(LONGEST_GRAM, len(padded) - at), 0, -1):
                row = self.grams.get(padded[at : at + n])
                if row is not None:
                    total += self.vectors[row]
                    at += n
                    break
            else:
                at += 1
        return total


class WordRows(dict):
    """Word to row of ``table``; unseen words get a row when they first turn up."""

    def __init__(self, model: LanguageModel):
        super().__init__(model.words)
        self.model = model
        self.fixed = len(model.words)
        self.table = np.zeros((self.fixed + 4096, len(model.languages)), dtype=np.float32)
        self.table[: self.fixed] = model.vectors[: self.fixed]
        self.rows = self.fixed

    def __missing__(self, word: str) -> int:
        if self.rows == len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        self.table[self.rows] = self.model.backed_off(word)
        self[word] = self.rows
        self.rows += 1
        return self.rows - 1

    def forget(self) -> None:
        if self.rows - self.fixed > REMEMBERED:
            self.clear()
            self.update(self.model.words)
            self.rows = self.fixed

    def score(self, text: str | None) -> tuple[str, float]:
        """The likeliest language and its share; evidence counts with the root of the word count."""
        words = words_of(text) if text else []
        if not words or not self.model.languages:
            return UNDETERMINED, 0.0
        rows = np.fromiter(map(self.__getitem__, words), dtype=np.int64, count=len(words))
        evidence = self.table[rows].sum(axis=0, dtype=np.float64) / math.sqrt(len(words))
        self.forget()
        share = np.exp(evidence - evidence.max())
        best = int(share.argmax())
        return self.model.languages[best], float(share[best] / share.sum())


def fit(labelled: DataFrame, fit_rows: int = FIT_ROWS) -> LanguageModel:
    """A model from ``labelled(doc_id, text, lang)``.

    Counts are made on the cluster over at most about ``fit_rows`` rows of each language, so
    what comes to the driver and is sent to the tasks has a bound that the corpus does not move.
    """
    known = labelled.where("lang is not null and text is not null")
    sizes = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    languages = sorted(sizes)
    if not languages:
        return LanguageModel([], {}, {}, np.zeros((0, 0), dtype=np.float32))
    lot = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000))
    chosen = F.lit(False)
    for lang in languages:
        chosen = chosen | ((F.col("lang") == lang) & (lot < math.ceil(1e6 * min(1, fit_rows / sizes[lang]))))

    def count():
        def work(batch: pd.DataFrame) -> pd.DataFrame:
            made = []
            for lang, texts in batch.groupby("lang")["text"]:
                words = Counter()
                for text in texts:
                    words.update(words_of(text))
                made += [(languages.index(lang), w, n) for w, n in words.items()]
            return pd.DataFrame(made, columns=["lang", "word", "n"])

        return work

    each = [str(i) for i in range(len(languages))]  # a column for each language, named by number
    words = cut(
        map_rows(known.where(chosen).select("lang", "text"), count, "lang int, word string, n long")
        .groupBy("word")
        .pivot("lang", list(range(len(languages))))
        .agg(F.sum("n"))
        .na.fill(0),
        "words",
    )
    sums = [F.sum(f"`{x}`").alias(x) for x in each]
    grams = (
        words.withColumn("padded", F.concat(F.lit("_"), "word", F.lit("_")))
        .withColumn("size", F.explode(F.sequence(F.lit(1), F.least(F.length("padded"), F.lit(LONGEST_GRAM)))))
        .withColumn("at", F.explode(F.expr("sequence(1, length(padded) - size + 1)")))
        .groupBy(F.expr("substring(padded, at, size)").alias("unit"))
        .agg(*sums)
    )
    often = sum((F.col(f"`{x}`") for x in each), F.lit(0)) >= LEAST_COUNT
    counts = (
        words.select(F.lit(True).alias("whole"), F.col("word").alias("unit"), *[f"`{x}`" for x in each])
        .unionByName(grams.withColumn("whole", F.lit(False)))
        .where(often)
        .orderBy(F.desc("whole"), "unit")
        .toPandas()
    )
    retire(words)
    numbers = counts[each].to_numpy(dtype=np.float64)
    kind = np.where(counts["whole"], 0, counts["unit"].str.len()) if len(counts) else np.zeros(0)
    vectors = np.zeros(numbers.shape, dtype=np.float32)
    for k in np.unique(kind):  # frequencies among words, and among n-grams of one length
        own = kind == k
        vectors[own] = np.log((numbers[own] + 0.5) / (numbers[own].sum(axis=0) + 0.5 * own.sum()))
    units = list(counts["unit"])
    whole = int((kind == 0).sum())
    return LanguageModel(languages, dict(zip(units[:whole], range(whole), strict=True)), dict(zip(units[whole:], range(whole, len(units)), strict=True)), vectors)


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, lang_pred, score``.

    A null text, or one without a letter, is ``und`` with score 0, as is every text if nothing
    was learnt. Ties go to the first language in order. Repeated rows and null ids keep their
    rows; an empty table gives none; further columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        rows = WordRows(shared.value)

        def work(batch: pd.DataFrame) -> pd.DataFrame:
            out = pd.DataFrame([rows.score(t) for t in batch["text"]], columns=["lang_pred", "score"])
            out.insert(0, "doc_id", batch["doc_id"].to_numpy(dtype=object))
            return out

        return work

    return map_rows(id_and_text(docs, id_col, text_col), make, "doc_id long, lang_pred string, score double")


def predict_languages(docs: DataFrame) -> DataFrame:
    """Fit on the rows that are not held out, predict all: ``doc_id, held_out, lang_pred, score``."""
    kept_back = held_out(F.col("doc_id"), 4, 2)
    model = fit(id_and_text(docs, "doc_id", "text", "lang").where(~kept_back))
    return identify(docs, model).select("doc_id", kept_back.alias("held_out"), "lang_pred", "score")
