"""Quality classifier: a byte-level convolutional network in numpy.

A text's UTF-8 bytes are embedded and cut into chunks of 2 * HALF bytes every HALF bytes, over the whole text.
Learned filters run over every chunk, each filter's largest response in the text is kept, and a logistic layer
combines them into one probability. Long texts are gone through in segments that overlap by half a chunk, with a
running maximum, so memory doesn't grow with the text.

Fitting: Adam on the logistic loss, over a documented sample of labelled rows (PER_CLASS of each class, SAMPLE at
most), on the driver. The largest response has one chunk as its source, so gradients flow to that chunk alone.

Defined cases: null text is scored as empty; an empty text is one chunk of padding; without labelled rows of both
classes the score is the labelled share of 1 (0.5 without any); repeated rows and null ids are scored as they are;
a text of any length is scored whole; an empty table gives an empty result; a column of the score's name is replaced, all others are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import fold, free, labelled_sample, table

NAME = "op1_quality"
HALF, DIMS, FILTERS = 16, 6, 32
PER_CLASS, SAMPLE, EPOCHS, BATCH, RATE = 1_200, 2_400, 10, 16, 0.004
SEGMENT = 1 << 19


def blocks(text: bytes) -> np.ndarray:
    """Rows of HALF bytes, zero-padded, one row of padding at the end; neighbouring rows make a chunk."""
    rows = max(1, -(-len(text) // HALF)) + 1
    out = np.zeros(rows * HALF, dtype=np.uint8)
    out[: len(text)] = np.frombuffer(text, dtype=np.uint8)
    return out.reshape(rows, HALF)


class Network:
    def __init__(self, seed: int = 7, level: float = 0.0):
        random = np.random.default_rng(seed)
        self.embed = random.normal(0, 0.5, (256, DIMS)).astype(np.float32)
        self.filters = random.normal(0, (2 * HALF * DIMS) ** -0.5, (2, HALF * DIMS, FILTERS)).astype(np.float32)
        self.shift = np.zeros(FILTERS, dtype=np.float32)
        self.out = random.normal(0, FILTERS**-0.5, FILTERS).astype(np.float32)
        self.level = np.array([level], dtype=np.float32)

    def responses(self, rows: np.ndarray) -> np.ndarray:
        """Of every filter to every chunk, before the shift: a chunk is rows i and i + 1."""
        flat = self.embed[rows].reshape(len(rows), -1)
        return (flat @ self.filters[0])[:-1] + (flat @ self.filters[1])[1:]

    def pooled(self, texts: list[bytes]) -> np.ndarray:
        out = np.full((len(texts), FILTERS), -np.inf, dtype=np.float32)
        some: list[np.ndarray] = []
        which: list[int] = []

        def settle() -> None:
            if not some:
                return
            sizes = np.array([len(x) for x in some])
            start = np.append(0, np.cumsum(sizes)[:-1])
            found = self.responses(np.concatenate(some))
            for at, n, k in zip(start, sizes - 1, which, strict=True):
                np.maximum(out[k], found[at : at + n].max(axis=0), out=out[k])
            some.clear(), which.clear()

        step, held = SEGMENT // HALF, 0
        for k, text in enumerate(texts):
            rows = blocks(text)
            for at in range(0, len(rows) - 1, step):
                part = rows[at : at + step + 1]
                some.append(part), which.append(k)
                held += len(part)
                if held >= step:
                    settle()
                    held = 0
        settle()
        return out

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        return _sigmoid(np.maximum(self.pooled(texts) + self.shift, 0).astype(np.float64) @ self.out.astype(np.float64) + float(self.level[0]))

    def fit(self, texts: list[bytes], labels: np.ndarray, epochs: int = EPOCHS, seed: int = 7) -> Network:
        random = np.random.default_rng(seed)
        rows = [blocks(x) for x in texts]
        weights = np.where(labels == 1, 0.5 / max(labels.mean(), 1e-9), 0.5 / max(1 - labels.mean(), 1e-9))
        names = ("embed", "filters", "shift", "out", "level")
        first, second, turn = {k: 0.0 for k in names}, {k: 0.0 for k in names}, 0
        total = max(1, epochs * -(-len(rows) // BATCH))
        for _ in range(epochs):
            order = random.permutation(len(rows))
            for at in range(0, len(order), BATCH):
                part = order[at : at + BATCH]
                best = np.empty((len(part), FILTERS), dtype=np.float32)
                chunks = np.empty((len(part), FILTERS, 2 * HALF), dtype=np.uint8)
                for k, d in enumerate(part):
                    found = self.responses(rows[d])
                    top = found.argmax(axis=0)
                    best[k] = found[top, np.arange(FILTERS)]
                    chunks[k] = np.concatenate([rows[d][top], rows[d][top + 1]], axis=1)
                shifted = best + self.shift
                hidden = np.maximum(shifted, 0)
                wrong = ((_sigmoid(hidden @ self.out + self.level[0]) - labels[part]) * weights[part] / len(part)).astype(np.float32)
                back = (wrong[:, None] * self.out[None, :]) * (shifted > 0)
                seen = self.embed[chunks].reshape(len(part), FILTERS, 2, HALF * DIMS)
                grads = {
                    "out": hidden.T @ wrong,
                    "level": np.array([wrong.sum()], dtype=np.float32),
                    "shift": back.sum(axis=0),
                    "filters": np.einsum("df,dfhx->hxf", back, seen),
                }
                into = np.einsum("df,hxf->dfhx", back, self.filters).reshape(-1, DIMS)
                flat = chunks.reshape(-1)
                grads["embed"] = np.stack([np.bincount(flat, weights=into[:, i], minlength=256) for i in range(DIMS)], axis=1).astype(np.float32)
                turn += 1
                rate = RATE * (1 - 0.9 * turn / total)
                for name in names:
                    g = grads[name] + 1e-4 * getattr(self, name) * (name in ("filters", "out"))
                    first[name] = 0.9 * first[name] + 0.1 * g
                    second[name] = 0.999 * second[name] + 0.001 * g * g
                    move = first[name] / (1 - 0.9**turn) / (np.sqrt(second[name] / (1 - 0.999**turn)) + 1e-8)
                    setattr(self, name, (getattr(self, name) - rate * move).astype(np.float32))
        return self


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def train(documents: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = PER_CLASS, most: int = SAMPLE) -> Network:
    """documents: doc_id and text; labels: doc_id and `label` of the rows that may be learned from."""
    rows = labelled_sample(labels, documents, label, per_class, most)
    target = np.array([float(r[2]) for r in rows])
    share = (target.sum() + 1) / (len(target) + 2)
    network = Network(level=float(np.log(share / (1 - share))))
    if len(set(target)) < 2:
        network.out[:] = 0
        return network
    return network.fit([r[1].encode("utf-8", "surrogatepass") for r in rows], target)


def scored(documents: DataFrame, network: Network, column: str = "score") -> DataFrame:
    """documents with a column of scores, 0 to 1, in place of any of that name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 1_000):
                batch = whole.slice(at, 1_000)
                texts = [(x or "").encode("utf-8", "surrogatepass") for x in batch.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(network.scores(texts), pa.float64())], names=[*batch.schema.names, column])

    frame = documents.drop(column)
    return frame.mapInArrow(run, StructType(list(frame.schema.fields)).add(column, "double"))


def model(spark: SparkSession, sf_dir: str) -> Network:
    labels = table(spark, sf_dir, "labels", "doc_id", "quality").where(fold("doc_id", 3) != 1)
    return train(table(spark, sf_dir, "documents", "doc_id", "text"), labels)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    network = model(spark, sf_dir)
    out = scored(table(spark, sf_dir, "documents", "doc_id", "text"), network)
    return out.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(documents: DataFrame, network: Network) -> DataFrame:
    """The documents that score 0.5 or more, with their columns."""
    (name,) = free(documents, "score")
    return scored(documents, network, name).where(F.col(name) >= 0.5).select(*[F.col(f"`{c}`") for c in documents.columns])


ORACLE_SQL = None
