"""Language identification with string kernels.

Two texts are compared by the blended-spectrum presence kernel: the number of distinct character n-grams (n = 1, 2, 3)
they share, divided by the root of the product of how many each has. ``Model.fit`` takes Nyström landmarks from
labelled texts, maps a text to ``K(x, L) K(L, L)^-1/2`` and fits one ridge regression per language against the rest.
Texts are scored in batches: a 0/1 matrix of the batch's n-grams times that of the landmarks, times the coefficients.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollbook.llm.common import SAMPLE_CHARS, held_out, stratified

#: Letters are told apart in so many classes; 0 stands for anything that is no letter.
ALPHABET = 64
SPACE = ALPHABET + ALPHABET**2 + ALPHABET**3
UNKNOWN = "und"
#: Texts scored by one matrix product.
BATCH = 64
#: Bounds of the training sample: rows and landmarks per language.
ROWS_PER_LANGUAGE = 400
LANDMARKS_PER_LANGUAGE = 32
RIDGE = 1e-3
SHARPNESS = 8.0


@cache
def letter_classes() -> np.ndarray:
    """Class of every code point: a-z by themselves, other letters spread over the rest of the alphabet."""
    table = np.zeros(0x110000, np.uint8)
    for cp in range(0x110000):
        c = chr(cp)
        if not unicodedata.category(c).startswith("L"):
            continue
        low = ord(c.lower()[0])
        table[cp] = low - 96 if 97 <= low <= 122 else 27 + low % 37
    return table


def grams(text: str) -> np.ndarray:
    """Codes of all 1-, 2- and 3-grams of a text, with repeats."""
    a = letter_classes()[np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)].astype(np.int32)
    two = a[:-1] * ALPHABET + a[1:]
    three = two[:-1] * ALPHABET + a[2:]
    return np.concatenate([a, two + ALPHABET, three + (ALPHABET + ALPHABET**2)])


@dataclass
class Model:
    languages: list[str]
    column: np.ndarray  # code -> column of the landmark matrix, or its width for codes that no landmark has
    landmarks: np.ndarray  # n-grams x landmarks, 0/1, scaled by the landmarks' norms
    weights: np.ndarray  # landmarks x languages: K(L, L)^-1/2 times the ridge coefficients
    bias: np.ndarray

    @classmethod
    def fit(cls, texts: list[str], labels: list[str], per_language: int = LANDMARKS_PER_LANGUAGE) -> Model:
        languages = sorted(set(labels))
        if not languages:
            return cls([], np.zeros(SPACE, np.int32), np.zeros((1, 0), np.float32), np.zeros((0, 0), np.float32), np.zeros(0, np.float32))
        y = np.array([languages.index(x) for x in labels])
        chosen = np.concatenate([np.flatnonzero(y == k)[:per_language] for k in range(len(languages))])
        present = [np.unique(grams(texts[i])) for i in chosen]
        used = np.unique(np.concatenate(present))
        column = np.full(SPACE, len(used), np.int32)
        column[used] = np.arange(len(used))
        matrix = np.zeros((len(used) + 1, len(chosen)), np.float32)
        for j, p in enumerate(present):
            matrix[column[p], j] = 1 / np.sqrt(max(1, len(p)))
        model = cls(languages, column, matrix, np.eye(len(chosen), dtype=np.float32), np.zeros(len(chosen), np.float32))
        kernel = model.kernel([texts[i] for i in chosen]).astype(np.float64)
        value, vector = np.linalg.eigh((kernel + kernel.T) / 2)
        keep = value > 1e-6 * max(value.max(), 1e-12)
        root = vector[:, keep] / np.sqrt(value[keep])
        x = np.concatenate([model.kernel(texts[i:i + BATCH]) for i in range(0, len(texts), BATCH)]).astype(np.float64) @ root
        target = np.where(y[:, None] == np.arange(len(languages)), 1.0, -1.0)
        share = np.bincount(y, minlength=len(languages))[y][:, None]  # every language weighs the same
        w = 1 / share
        centre, level = (w * x).sum(0) / w.sum(), (w * target).sum(0) / w.sum()
        xc = x - centre
        beta = np.linalg.solve(xc.T @ (w * xc) + RIDGE * np.eye(x.shape[1]), xc.T @ (w * (target - level)))
        model.weights = (root @ beta).astype(np.float32)
        model.bias = (level - centre @ beta).astype(np.float32)
        return model

    def kernel(self, texts: list[str]) -> np.ndarray:
        """K(x, L) for a batch of texts."""
        rows = np.zeros((len(texts), len(self.landmarks)), np.float32)
        seen = np.zeros(SPACE, bool)
        for i, text in enumerate(texts):
            codes = grams(text)
            seen[codes] = True
            size = np.count_nonzero(seen)
            seen[codes] = False
            rows[i, self.column[codes]] = 1 / np.sqrt(max(1, size))
        rows[:, -1] = 0  # n-grams of no landmark
        return rows @ self.landmarks

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and score of each text; ``und`` and 0 where there is no letter or nothing was learned."""
        names, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
        with_letters = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))] if self.languages else []
        for at in range(0, len(with_letters), BATCH):
            own = with_letters[at:at + BATCH]
            raw = (self.kernel([texts[i] for i in own]) @ self.weights + self.bias).astype(np.float64)
            soft = np.exp(SHARPNESS * (raw - raw.max(1, keepdims=True)))
            soft /= soft.sum(1, keepdims=True)
            for i, k, s in zip(own, raw.argmax(1), soft.max(1), strict=True):
                names[i], score[i] = self.languages[k], s
        return names, score


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> Model:
    """Fit on at most ``2 * ROWS_PER_LANGUAGE`` rows a language from outside the held-out fold, with texts of up to
    ``SAMPLE_CHARS`` code points. Rows without a language or a text teach nothing."""
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    rows = rows.where(~held_out(F.col("id")) & F.col("text").isNotNull() & (F.length("text") <= SAMPLE_CHARS))
    got = stratified(rows, "lang", "id", ROWS_PER_LANGUAGE).select("id", "text", "lang").toPandas()
    got = got.sort_values(["id", "lang", "text"])
    return Model.fit(list(got["text"]), list(got["lang"]))


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Add lang_pred and score, from the whole text alone; all other columns are kept, ties go to the first language by name."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    clash = {"lang_pred", "score"}
    kept = docs.drop(*[c for c in docs.columns if c in clash and c != text])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, score = shared.value.predict(batch.column(batch.schema.get_field_index("_text")).to_pylist())
            cols = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(names, pa.string()), pa.array(score, pa.float64())],
                                             names=[*batch.schema.names[:-1], "lang_pred", "score"])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields if f.name != text]
    narrow = kept.select(*[F.col(f"`{c}`") for c in kept.columns if c != text], F.col(text).alias("_text"))
    return narrow.mapInArrow(run, ", ".join([*fields, "lang_pred string", "score double"]))


def languages(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document; a null id is not held out, an empty table gives no rows."""
    model = fit(docs)
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return predict(rows, model).select("doc_id", "held_out", "lang_pred", "score")


def accuracy(predicted: DataFrame, docs: DataFrame) -> pd.DataFrame:
    """Rows and share of right predictions by fold and language."""
    both = predicted.join(docs.select("doc_id", "lang"), "doc_id").where(F.col("lang").isNotNull())
    return both.groupBy("held_out", "lang").agg(F.count("*").alias("rows"), F.avg((F.col("lang_pred") == F.col("lang")).cast("int")).alias("right")).toPandas()
