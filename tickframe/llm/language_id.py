"""Language ID by string kernels: n-gram presence, Nystroem landmarks, kernel ridge regression.

The kernel of two texts counts the character n-grams of 1 to SPAN characters that both hold, over the root
of the product of their own counts (blended spectrum, presence only; n-grams are those of the landmarks).
Landmarks are a few training texts per language. Every text is mapped to its kernel values with them,
whitened by the landmarks' own kernel matrix, and one ridge regression per language scores the result.

Training takes a bounded sample: PER_LANGUAGE distinct texts per language, by the hash of their text; of a text
longer than SAMPLE_CHARS that many characters, in PIECES spread over it. Prediction reads whole texts in Arrow batches: n-grams are hashed and looked up by
array operations, and a block of texts is scored by two matrix products. No shuffle but of the sample.

Edge cases: null texts, empty ones and those without a letter are ``und`` with score 0. A null lang is
not learned from. Without any training text everything is ``und``. Texts that share no n-gram with a
landmark score alike for all languages and take the first by name. Rows without doc_id are not held out.
Repeated rows are predicted alike. Extra columns are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickframe.llm.common import remainder

UNKNOWN = "und"
SPAN = 3              # longest n-gram, in characters
PER_LANGUAGE = 300    # training texts of a language
LANDMARKS = 40        # of them, landmarks
SAMPLE_CHARS = 20_000
PIECES = 20           # of a longer text
RIDGE = 0.1
TABLE_BITS = 22       # of the table that finds an n-gram's number by its hash
SCALE = 1_000_000_000 # of the shares by which the sample is thinned out
ROWS = 128            # texts of a block of matrix products


def gram_slots(text: str) -> np.ndarray:
    """Table slots of all n-grams of a text, lower-cased."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    out, run = [], np.zeros(len(points), np.uint64)
    for n in range(1, SPAN + 1):
        if len(points) < n:
            break
        run = run[: len(points) - n + 1] * np.uint64(0x100000001B3) + points[n - 1:] + np.uint64(n)
        out.append((run * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - TABLE_BITS))
    return np.concatenate(out).astype(np.int64) if out else np.zeros(0, np.int64)


class Classifier:
    """Fitted on (text, language) pairs; ``landmarks`` texts per language, the first of each."""

    def __init__(self, texts: list[str], languages: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE):
        self.names = sorted(set(languages))
        if not self.names:
            return
        taken: dict[str, int] = {}
        chosen = [t for t, name in zip(texts, languages)
                  if taken.setdefault(name, 0) < landmarks and not taken.update({name: taken[name] + 1})]
        grams = np.unique(np.concatenate([gram_slots(t) for t in chosen]))
        self.grams = grams
        self._index()
        held = self.presence(chosen)
        self.landmarks = held.T / np.sqrt(np.maximum(held.sum(axis=1), 1))
        own = self.kernel(held).astype(np.float64)
        values, vectors = np.linalg.eigh(own)
        good = values > 1e-6 * max(values.max(), 1e-12)
        whiten = vectors[:, good] / np.sqrt(values[good])
        mapped = np.concatenate([
            self.kernel(self.presence(texts[a:a + ROWS])) for a in range(0, len(texts), ROWS)]).astype(np.float64) @ whiten
        target = np.where(np.array(languages)[:, None] == np.array(self.names)[None, :], 1.0, -1.0)
        weights = np.linalg.solve(mapped.T @ mapped + ridge * np.eye(mapped.shape[1]), mapped.T @ target)
        self.weights = (whiten @ weights).astype(np.float32)

    def _index(self) -> None:
        self._numbers = np.full(1 << TABLE_BITS, -1, np.int32)
        self._numbers[self.grams] = np.arange(len(self.grams))

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_numbers"}  # rebuilt where it is used

    def __setstate__(self, state: dict) -> None:
        self.__dict__ |= state
        if self.names:
            self._index()

    def presence(self, texts: list[str]) -> np.ndarray:
        held = np.zeros((len(texts), len(self.grams)), np.float32)
        for row, text in zip(held, texts):
            found = self._numbers[gram_slots(text)]
            row[found[found >= 0]] = 1
        return held

    def kernel(self, held: np.ndarray) -> np.ndarray:
        """Kernel values of texts (rows of presence) with the landmarks."""
        return (held @ self.landmarks) / np.sqrt(np.maximum(held.sum(axis=1), 1))[:, None]

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        able = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))] if self.names else []
        for a in range(0, len(able), ROWS):
            block = able[a:a + ROWS]
            values = self.kernel(self.presence([texts[i] for i in block])) @ self.weights
            best = values.argmax(axis=1)
            for i, b, v in zip(block, best, values.max(axis=1)):
                names[i], scores[i] = self.names[b], float(min(max((v + 1) / 2, 0), 1))
        return names, scores


def excerpt(text: Column) -> Column:
    """The text, or PIECES of it spread from its start to its end if it is longer than SAMPLE_CHARS."""
    size = SAMPLE_CHARS // PIECES
    pieces = F.transform(F.sequence(F.lit(0), F.lit(PIECES - 1)), lambda k: F.substring(
        text, (F.lit(1) + F.floor(k * (F.length(text) - size) / (PIECES - 1))).cast("int"), F.lit(size)))
    return F.when(F.length(text) <= SAMPLE_CHARS, text).otherwise(F.array_join(pieces, " "))


def fit(labelled: DataFrame, per_language: int = PER_LANGUAGE) -> Classifier:
    """A classifier from columns text and lang, on a bounded sample per language."""
    named = labelled.filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select(
        "lang", "text", F.xxhash64("text").alias("hash"))
    # Copies count once, here and below: a text is one text however often a language repeats it.
    counts = {r["lang"]: r["n"] for r in named.select("lang", "hash").distinct().groupBy("lang").agg(
        F.count("*").alias("n")).collect()}
    # Thin out by hash before the ranking, to some eight times the texts asked for, however many there are.
    share = {lang: min(SCALE, 8 * per_language * SCALE // n + 1) for lang, n in counts.items()}
    thin = F.pmod("hash", F.lit(SCALE)) < F.element_at(F.from_json(F.lit(json.dumps(share)), "map<string, long>"), F.col("lang"))
    distinct = named.filter(thin).groupBy("lang", "hash").agg(F.min(excerpt(F.col("text"))).alias("text"))
    # The same order as that of the thinning, so that it changes nothing about which texts come first.
    order = Window.partitionBy("lang").orderBy(F.pmod("hash", F.lit(SCALE)), "hash")
    sample = distinct.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= per_language)
    rows = sorted((r["lang"], r["place"], r["text"]) for r in sample.collect())
    return Classifier([r[2] for r in rows], [r[0] for r in rows])


def predict(docs: DataFrame, modulus: int = 4, held: int = 2) -> DataFrame:
    """doc_id, held_out, lang_pred and score; learned from the documents that are not held out."""
    marked = docs.select("doc_id", "text", "lang", (remainder(F.col("doc_id"), modulus) == held).alias("held_out"))
    model = fit(marked.filter(~F.col("held_out")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            names, scores = model.predict(batch["text"].to_list())
            yield batch[["id", "held_out"]].assign(lang_pred=names, score=scores)

    # Ids go through pandas as text, since a batch with a null would turn them to floats.
    made = marked.select(F.col("doc_id").cast("string").alias("id"), "held_out", "text").mapInPandas(
        run, "id string, held_out boolean, lang_pred string, score double")
    return made.select(F.col("id").cast(docs.schema["doc_id"].dataType).alias("doc_id"), "held_out", "lang_pred", "score")
