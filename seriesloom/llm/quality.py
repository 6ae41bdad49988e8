"""Quality by nearest-neighbour voting in a latent semantic space.

Terms of a text are the shapes of its words (letters by case, digits and punctuation as they are), marks for words that repeat their
predecessor, and the words themselves, hashed to a fixed number of columns. The term-document matrix of labelled rows,
weighted by log counts and inverse document frequency, gives the latent space by its leading singular vectors.
Every document is projected and compared with all labelled vectors by blocked exact cosine products. The labels of the
nearest ones vote with weights that grow with the similarity.

The labelled rows are a sample of at most ``most_labels``, chosen by a hash of the id, so the broadcast model has at
most ``most_labels * dims + terms * dims`` numbers. All documents are scored, over their whole texts.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.llm.tables import batches_of, crc_of_id, slim

SHAPES, WORDS = 1536, 512
TERMS = SHAPES + WORDS
REPEATED = 0


def shape(word: str) -> str:
    """Runs of upper-case letters as A, of other letters as a, of digits as 0; the rest as it is."""
    kinds = ["A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c for c in word]
    return "".join(k for i, k in enumerate(kinds) if k not in "Aa0" or i == 0 or kinds[i - 1] != k)


class Terms:
    """Column numbers of words, remembered up to a number of words."""

    def __init__(self, most: int = 200_000):
        self.known, self.most = {}, most

    def of(self, word: str) -> tuple[int, int]:
        body = "".join(filter(str.isalnum, word)).lower()
        return 1 + zlib.crc32(shape(word).encode()) % (SHAPES - 1), SHAPES + zlib.crc32(body.encode()) % WORDS

    def counts(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """(columns, counts) of a text."""
        words = text.split()
        if not words:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        known = self.known
        if len(known) > self.most:
            known.clear()
        for word in set(words):
            if word not in known:
                known[word] = self.of(word)
        pairs = np.array([known[w] for w in words], np.int64)
        full = np.bincount(pairs.ravel(), minlength=TERMS)
        full[REPEATED] = sum(a == b for a, b in zip(words, words[1:]))
        at = np.flatnonzero(full)
        return at, full[at]


@dataclass
class Model:
    weight: np.ndarray  # of each term
    basis: np.ndarray  # terms x dims
    vectors: np.ndarray  # labelled rows x dims, of length one
    labels: np.ndarray
    nearest: int
    power: float

    def latent(self, counted: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        out = np.zeros((len(counted), self.basis.shape[1]), np.float32)
        for i, (at, n) in enumerate(counted):
            if len(at):
                out[i] = weighted(at, n, self.weight) @ self.basis[at]
        return unit(out)

    def scores(self, latent: np.ndarray, block: int = 512) -> np.ndarray:
        """Share of the label-one votes; the share of the labelled rows where nothing is similar."""
        base = float(self.labels.mean()) if len(self.labels) else 0.5
        out = np.full(len(latent), base)
        k = min(self.nearest, len(self.labels))
        if k == 0:
            return out
        for a in range(0, len(latent), block):
            cosine = latent[a : a + block] @ self.vectors.T
            near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
            votes = np.maximum(np.take_along_axis(cosine, near, 1), 0).astype(np.float64) ** self.power
            total = votes.sum(axis=1)
            ones = (votes * self.labels[near]).sum(axis=1)
            out[a : a + block] = np.where(total > 0, (ones + base * 1e-3) / (total + 1e-3), base)
        return np.clip(out, 0, 1)


def unit(rows: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.where(length > 0, rows / np.maximum(length, 1e-12), 0).astype(np.float32)


def weighted(at: np.ndarray, n: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Log counts by inverse document frequency; shapes and words each of length one, words at a third."""
    v = np.log1p(n) * weight[at]
    words = at >= SHAPES
    for mask, share in ((~words, 1.0), (words, 0.3)):
        length = np.sqrt((v[mask] ** 2).sum())
        if length > 0:
            v[mask] *= share / length
    return v.astype(np.float32)


def fit(rows: list[tuple], dims: int, nearest: int, power: float) -> Model:
    """Model of (label, columns, counts) rows."""
    counted = [(np.asarray(at, np.int64), np.asarray(n, np.int64)) for _, at, n in rows]
    labels = np.array([float(r[0]) for r in rows])
    frequency = np.zeros(TERMS)
    for at, _ in counted:
        frequency[at] += 1
    weight = np.log((1 + len(rows)) / (1 + frequency)) + 0.1
    gram = np.zeros((TERMS, TERMS))
    for a in range(0, len(counted), 500):
        dense = np.zeros((len(counted[a : a + 500]), TERMS))
        for i, (at, n) in enumerate(counted[a : a + 500]):
            if len(at):
                dense[i, at] = weighted(at, n, weight)
        gram += dense.T @ dense
    basis = np.linalg.eigh(gram)[1][:, ::-1][:, :dims].astype(np.float32) if len(rows) else np.zeros((TERMS, 1), np.float32)
    model = Model(weight, np.ascontiguousarray(basis), np.zeros((0, basis.shape[1]), np.float32), labels, nearest, power)
    model.vectors = model.latent(counted)
    return model


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 5, held_fold: int = 0, most_labels: int = 5000, dims: int = 48, nearest: int = 15, power: float = 8.0, doc_id: str = "doc_id", text: str = "text") -> Model:
    """Fit on a sample of at most ``most_labels`` labelled rows outside the held-out fold.

    Rows without a label or id are left out; of an id with several labels the smallest counts, of an id with several texts
    the first in order. Without any labelled row, every score is 0.5.
    """
    usable = slim(labels, doc_id=doc_id, label=label).where(F.col("doc_id").isNotNull() & F.col("label").isNotNull())
    usable = usable.where(F.pmod(crc_of_id(F.col("doc_id")), F.lit(folds)) != held_fold).groupBy("doc_id").agg(F.min("label").cast("double").alias("label"))
    sample = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_labels)
    known = {r.doc_id: r.label for r in sample.collect()}
    ids = np.array(sorted(known), np.int64)
    shared = docs.sparkSession.sparkContext.broadcast((ids, known))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, (ids, known) = Terms(), shared.value
        for batch in batches:
            mine = np.isin(np.array([-1 if d is None else d for d in batch.column("doc_id").to_pylist()], np.int64), ids)
            picked = batch.filter(pa.array(mine & np.array([d is not None for d in batch.column("doc_id").to_pylist()], bool)))
            if picked.num_rows:
                got = [terms.counts(t or "") for t in picked.column("text").to_pylist()]
                names = picked.column("doc_id").to_pylist()
                yield pa.record_batch(
                    {
                        "doc_id": pa.array(names, pa.int64()),
                        "label": pa.array([known[d] for d in names], pa.float64()),
                        "at": pa.array([g[0].astype(np.int32).tobytes() for g in got], pa.binary()),
                        "n": pa.array([g[1].astype(np.int32).tobytes() for g in got], pa.binary()),
                    }
                )

    own = slim(docs, doc_id=doc_id, text=text).withColumn("doc_id", F.col("doc_id").cast("long"))
    # at most most_labels rows of term counts, one for each id
    rows = own.mapInArrow(count, "doc_id long, label double, at binary, n binary").groupBy("doc_id").agg(F.min(F.struct("at", "n", "label")).alias("r")).collect()
    rows = [(r.r.label, np.frombuffer(r.r.at, np.int32), np.frombuffer(r.r.n, np.int32)) for r in sorted(rows, key=lambda r: r.doc_id)]
    return fit(rows, dims, nearest, power)


def score(docs: DataFrame, model: Model, name: str = "score", text: str = "text", at_least: float | None = None) -> DataFrame:
    """``docs`` with a score column, over whole texts; with ``at_least``, only the rows of such a score, without the column.

    Null and empty texts, and texts of which no term is known, get the share of good rows among the labelled.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, model = Terms(), shared.value
        for batch in batches_of(batches, text):
            got = model.scores(model.latent([terms.counts(t or "") for t in batch.column(text).to_pylist()]))
            if at_least is None:
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, pa.float64())], names=[*batch.schema.names, name])
            else:
                yield batch.filter(pa.array(got >= at_least))

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema] + [f"`{name}` double"] * (at_least is None)
    return docs.mapInArrow(run, ", ".join(fields))


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, folds: int = 5, held_fold: int = 0, **options) -> DataFrame:
    """doc_id, held_out, score and predicted for each row."""
    model = train(docs, labels, folds=folds, held_fold=held_fold, **options)
    scored = score(slim(docs, doc_id="doc_id", text="text"), model)
    held = F.pmod(crc_of_id(F.col("doc_id")), F.lit(folds)) == held_fold
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """The rows whose score reaches the threshold."""
    return score(docs, model, at_least=threshold)
