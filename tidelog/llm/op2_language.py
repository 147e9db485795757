"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

A text's lower-cased code points, with a space at either end, give n-grams of one to three, hashed into 2^BITS
features. A feature's value is its share of the text's n-grams times its inverse document frequency. The weights
are fitted by follow-the-regularised-leader with elastic-net penalties (L1 keeps most weights at zero), on a
documented sample of labelled rows (PER_CLASS a language, SAMPLE at most, of all languages alike); a temperature, fitted on a fifth of the
sample that the weights don't see, calibrates the probabilities.

As values are linear in the counts, a text's score is a sum of table lookups over its whole length, in segments that
carry two characters over, and needs no counts of its own: very long texts are scored as they would be in one piece.

Defined cases: null text, or one without a letter (Unicode category L), is `und` with score 0; without labelled rows every text is;
of equally likely languages the first by name is given; repeated rows and null ids are predicted as they are; an empty table gives an empty
result; columns named lang_pred or score are replaced, all others are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import fold, labelled_sample, table

NAME = "op2_language"
BITS, ORDERS, SCALE = 18, 3, 100.0
PER_CLASS, SAMPLE, EPOCHS = 700, 4_000, 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.05
SEGMENT = 1 << 18
_LETTER = regex.compile(r"\p{L}")


def features(text: str) -> Iterator[list[np.ndarray]]:
    """For each segment of the lower-cased text, and in it for each order, the features of the n-grams that begin there."""
    whole = f" {text.lower()} "
    for at in range(0, len(whole), SEGMENT):
        points = np.frombuffer(whole[at : at + SEGMENT + ORDERS - 1].encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        out, gram = [], points * np.uint32(0x9E3779B1)
        for n in range(1, ORDERS + 1):
            if n > 1:
                gram = (gram[:-1] ^ np.uint32(n)) * np.uint32(0x85EBCA6B) + points[n - 1 :] * np.uint32(0xC2B2AE35)
            mixed = gram[:SEGMENT] ^ (gram[:SEGMENT] >> np.uint32(15))
            out.append((mixed * np.uint32(0x27D4EB2F)) >> np.uint32(32 - BITS))
        yield out


class Model:
    """weights: features x languages, idf already in it."""

    def __init__(self, languages: list[str], weights: np.ndarray, level: np.ndarray, temperature: float):
        self.languages, self.level, self.temperature = languages, level, temperature
        self.used = np.flatnonzero(np.any(weights != 0, axis=1)).astype(np.int32)
        self.weights = weights[self.used].astype(np.float32)
        self._tables: list[np.ndarray] = []

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_tables": []}

    def logits(self, text: str) -> np.ndarray:
        if not self._tables:
            for k in range(len(self.languages)):
                self._tables.append(np.zeros(1 << BITS, dtype=np.float32))
                self._tables[-1][self.used] = self.weights[:, k]
        total, sums = 0, np.zeros(len(self.languages))
        for segment in features(text):
            for grams in segment:
                total += len(grams)
                for k, t in enumerate(self._tables):
                    sums[k] += t[grams].sum(dtype=np.float64)
        return self.level + sums * (SCALE / total)

    def predict(self, text: str | None) -> tuple[str, float]:
        if text is None or not self.languages or not _LETTER.search(text):
            return "und", 0.0
        p = _softmax(self.logits(text) / self.temperature)
        best = int(p.argmax())
        return self.languages[best], float(p[best])


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit(texts: list[str], langs: list[str], epochs: int = EPOCHS, seed: int = 5) -> Model:
    languages = sorted(set(langs))
    if not languages:
        return Model([], np.zeros((1 << BITS, 0)), np.zeros(0), 1.0)
    random = np.random.default_rng(seed)
    target = np.array([languages.index(x) for x in langs])
    counted = []
    for text in texts:
        kind, count = np.unique(np.concatenate([x for segment in features(text) for x in segment]), return_counts=True)
        counted.append((kind, count / count.sum()))
    order = random.permutation(len(texts))
    held, seen = order[: len(order) // 5], order[len(order) // 5 :]
    often = np.zeros(1 << BITS)
    for d in seen:
        often[counted[d][0]] += 1
    idf = np.log((len(seen) + 1) / (often + 1)) + 1.0
    idf[often == 0] = 0.0
    values = [(k, (SCALE * idf[k] * v)) for k, v in counted]
    width = len(languages)
    z, n = np.zeros(((1 << BITS) + 1, width)), np.zeros(((1 << BITS) + 1, width))
    bias = 1 << BITS

    def weights(rows: np.ndarray) -> np.ndarray:
        zz = z[rows]
        penalty = np.where(rows == bias, 0.0, L1)[:, None]
        return np.where(np.abs(zz) <= penalty, 0.0, -(zz - np.sign(zz) * penalty) / ((BETA + np.sqrt(n[rows])) / ALPHA + L2))

    for _ in range(epochs):
        for d in random.permutation(seen):
            rows, x = np.append(values[d][0].astype(np.int64), bias), np.append(values[d][1], 1.0)
            w = weights(rows)
            p = _softmax(x @ w)
            p[target[d]] -= 1
            g = x[:, None] * p[None, :]
            z[rows] += g - (np.sqrt(n[rows] + g * g) - np.sqrt(n[rows])) / ALPHA * w
            n[rows] += g * g
    final = np.concatenate([weights(np.arange(a, min(a + 65_536, bias + 1))) for a in range(0, bias + 1, 65_536)])
    table_, level = final[:bias] * idf[:, None], final[bias]
    model = Model(languages, table_, level, 1.0)
    if len(held):
        logits = np.stack([level + (values[d][1] / np.where(idf[values[d][0]] == 0, 1, idf[values[d][0]])) @ table_[values[d][0]] for d in held])
        tries = np.exp(np.linspace(np.log(0.2), np.log(20), 200))
        loss = [-np.log(np.maximum(_softmax(logits / t)[np.arange(len(held)), target[held]], 1e-12)).mean() for t in tries]
        model.temperature = float(tries[int(np.argmin(loss))])
    return model


def train(documents: DataFrame, per_class: int = PER_CLASS, most: int = SAMPLE) -> Model:
    """documents: doc_id, text and lang of the rows that may be learned from."""
    rows = labelled_sample(documents.select("doc_id", "lang"), documents, "lang", per_class, most)
    return fit([r[1] for r in rows], [r[2] for r in rows])


def identified(documents: DataFrame, model: Model) -> DataFrame:
    """documents with the columns lang_pred and score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.predict(x.as_py()) for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], names=[*batch.schema.names, "lang_pred", "score"])

    frame = documents.drop("lang_pred", "score")
    return frame.mapInArrow(run, StructType(list(frame.schema.fields)).add("lang_pred", "string").add("score", "double"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = table(spark, sf_dir, "documents", "doc_id", "text", "lang").where((fold("doc_id", 4) != 2) & F.col("lang").isNotNull())
    out = identified(table(spark, sf_dir, "documents", "doc_id", "text"), train(seen))
    return out.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


ORACLE_SQL = None
