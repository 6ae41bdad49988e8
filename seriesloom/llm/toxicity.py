"""Toxicity by class-conditional Kneser-Ney models over the letters of words.

Two models give the likelihood of a word, letter by letter, after up to four letters before it in the word: one with counts of
toxic rows, one with counts of ordinary rows. Both back off to the same lower orders, whose counts are Kneser-Ney continuation
counts over the whole corpus: how many different letters precede a sequence. Rare and new expressions are so
smoothed alike in both models, and only what a class has shown by itself tells them apart. A text's evidence is the
difference of its log-likelihoods in the two models, normalised by its length and, for toxic passages
in long texts, that of its highest stretches of a few words. A logistic curve, fitted on labelled rows that the counts leave
out, turns them into a score.

Counts are sums of Spark over all rows, and no sequence is left out for being rare. The model that is broadcast holds every sequence
that a labelled class has seen, which the sample of labelled rows bounds. After a context that neither class has seen both models
back off to the same number, so that such letters are no evidence; of the lower orders the broadcast model therefore holds the
counts after suffixes of the classes' contexts, and these are counted over the whole corpus.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.llm.tables import batches_of, crc_of_id, slim, stage

WORD = re.compile(r"[^\W\d_]+")
ORDER, BITS, END = 5, 12, 4095
STRETCHES = (1, 3, 12)
DISCOUNT = 0.75


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def gram_keys(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(word number, key) of each letter and of each word's end: the letter with up to four before it, 12 bits each.

    Places before a word are 0. Letters above 4094 share numbers.
    """
    size = np.fromiter(map(len, words), np.int64, len(words)) + 1
    text = np.frombuffer("".join(w + "\0" for w in words).encode("utf-32-le"), np.uint32).astype(np.int64)
    symbol = np.where(text == 0, END, np.where(text < END, text, 1 + text % (END - 1)))
    owner = np.repeat(np.arange(len(words)), size)
    place = np.arange(len(text)) - np.repeat(np.cumsum(size) - size, size)
    key = symbol.copy()
    for back in range(1, ORDER):
        before = np.zeros_like(symbol)
        before[back:] = symbol[:-back]
        key |= np.where(place >= back, before, 0) << (BITS * back)
    return owner, key


def suffix(key: np.ndarray, order: int) -> np.ndarray:
    """The last ``order`` symbols of a key."""
    return key & ((1 << (BITS * order)) - 1)


def context(key: np.ndarray) -> np.ndarray:
    return key >> BITS


class Table:
    """Numbers by sorted key; 0 where a key is not there."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order]

    @classmethod
    def sums(cls, keys: np.ndarray, values: np.ndarray) -> Table:
        at, place = np.unique(keys, return_inverse=True)
        return cls(at, np.bincount(place, weights=values, minlength=len(at)))

    def __getitem__(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(keys))
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.values[at], 0.0)


class Counts:
    """A class's counts of full sequences, of their contexts, and of the kinds that follow a context."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        seen = counts > 0
        keys, counts = keys[seen], counts[seen].astype(float)
        self.full, self.context = Table(keys, counts), Table.sums(context(keys), counts)
        self.kinds = Table.sums(context(keys), np.ones(len(keys)))

    def smoothed(self, keys: np.ndarray, lower: np.ndarray) -> np.ndarray:
        own, total = context(keys), self.context[context(keys)]
        found = (np.maximum(self.full[keys] - DISCOUNT, 0) + DISCOUNT * self.kinds[own] * lower) / np.maximum(total, 1)
        return np.where(total > 0, found, lower)


class Shared:
    """Lower orders from continuation counts of all rows."""

    def __init__(self, keys: np.ndarray):
        found = []
        distinct = np.unique(keys)
        for order in range(ORDER - 1, 0, -1):
            # each distinct longer sequence is one letter that precedes its suffix
            found.append(np.unique(suffix(distinct, order), return_counts=True))
            distinct = found[-1][0]
        self._hold(found)

    @classmethod
    def counted(cls, found: list[tuple[np.ndarray, np.ndarray]]) -> Shared:
        """Of (keys, continuation counts) of the orders, from the longest down to single letters.

        A context has all of its letters or none; single letters are all there.
        """
        own = cls.__new__(cls)
        own._hold(found)
        return own

    def _hold(self, found: list[tuple[np.ndarray, np.ndarray]]) -> None:
        self.orders = [Counts(*one) for one in found]
        self.uniform = 1 / max(2, len(found[-1][0]) + 1)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        p = np.full(len(keys), self.uniform)
        for order, counts in zip(range(1, ORDER), reversed(self.orders)):
            p = counts.smoothed(suffix(keys, order), p)
        return p


@dataclass
class Model:
    toxic: Counts
    ordinary: Counts
    shared: Shared
    curve: np.ndarray | None = None
    base: float = 0.5

    def of_words(self, words: list[str]) -> np.ndarray:
        """Toxic minus ordinary log-likelihood of each word."""
        if not words:
            return np.zeros(0)
        owner, keys = gram_keys(words)
        lower = self.shared(keys)
        ratio = np.log(self.toxic.smoothed(keys, lower)) - np.log(self.ordinary.smoothed(keys, lower))
        return np.bincount(owner, weights=ratio, minlength=len(words))

    def score(self, evidence: np.ndarray) -> np.ndarray:
        if self.curve is None:
            return np.full(len(evidence), self.base)
        return 1 / (1 + np.exp(-np.clip(shaped(evidence) @ self.curve, -40, 40)))


def shaped(evidence: np.ndarray) -> np.ndarray:
    mean, words, tops = evidence[:, 0], np.log1p(evidence[:, 1]), evidence[:, 2:]
    return np.column_stack([np.ones(len(mean)), mean, mean * words, words, tops])


class Reader:
    """Evidence of texts; words are remembered."""

    def __init__(self, model: Model, most: int = 400_000):
        self.model, self.most, self.known = model, most, {}

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        """(mean by word, words, highest means of stretches) of each text; zeros without words."""
        split = [words_of(t) for t in texts]
        if len(self.known) > self.most:
            self.known.clear()
        new = list({w for one in split for w in one} - self.known.keys())
        for a in range(0, len(new), 50_000):
            some = new[a : a + 50_000]
            self.known.update(zip(some, self.model.of_words(some).tolist()))
        out = np.zeros((len(texts), 2 + len(STRETCHES)))
        for i, words in enumerate(split):
            if words:
                ratio = np.fromiter(map(self.known.__getitem__, words), float, len(words))
                total = np.concatenate([[0], np.cumsum(ratio)])
                out[i, :2] = ratio.mean(), len(words)
                for k, n in enumerate(STRETCHES, 2):
                    n = min(n, len(words))
                    out[i, k] = (total[n:] - total[:-n]).max() / n
        return out


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 50) -> np.ndarray:
    """Weights by Newton's method, on centred and scaled columns."""
    centre, scale = x[:, 1:].mean(axis=0), np.maximum(x[:, 1:].std(axis=0), 1e-9)
    z = np.concatenate([x[:, :1], (x[:, 1:] - centre) / scale], axis=1)
    w = np.zeros(z.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -40, 40)))
        step = np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + ridge * len(y) * np.eye(len(w)), z.T @ (y - p) - ridge * len(y) * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    own = w.copy()
    own[1:] = w[1:] / scale
    own[0] = w[0] - (w[1:] * centre / scale).sum()
    return own


def lower_orders(grams: DataFrame, seen: np.ndarray) -> Shared:
    """Continuation counts of all ``grams``, of each letter that follows a suffix of a context in ``seen``."""
    spark = grams.sparkSession
    wanted = spark.sparkContext.broadcast([np.unique(suffix(context(seen), order - 1)) for order in range(1, ORDER)])

    def after_seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, order = batch.column("gram").to_numpy(), batch.column("order").to_numpy()
            kept = order == 1  # their number is that of all letters
            for k in range(2, ORDER):
                kept |= (order == k) & np.isin(context(key), wanted.value[k - 1])
            yield batch.filter(pa.array(kept))

    longer, orders = grams.select("gram"), []
    for order in range(ORDER - 1, 0, -1):
        # each distinct longer sequence is one letter that precedes its suffix
        longer = stage(longer.groupBy(F.col("gram").bitwiseAND(F.lit((1 << (BITS * order)) - 1)).alias("gram")).agg(F.count(F.lit(1)).alias("n")))
        orders.append(longer.select("gram", "n", F.lit(order).alias("order")))
        longer = longer.select("gram")
    every = orders[0]
    for one in orders[1:]:
        every = every.unionAll(one)
    got = every.mapInArrow(after_seen, "gram long, n long, order int").toArrow()
    keys, n, order = (got.column(c).to_numpy() for c in ("gram", "n", "order"))
    return Shared.counted([(keys[order == k], n[order == k]) for k in range(ORDER - 1, 0, -1)])


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 3, held_fold: int = 1, most_labels: int = 100_000, most_calibrate: int = 10_000, doc_id: str = "doc_id", text: str = "text") -> Model:
    """Count all documents, by class where they are labelled, and fit the curve.

    At most ``most_labels`` labelled rows outside the held-out fold, by a hash of the id, give class counts, but for a fifth of them
    (at most ``most_calibrate``) that fit the curve. Rows without a label or id are left out, of several labels of an id the largest counts.
    With one class only, every score is that class's share.
    """
    usable = slim(labels, doc_id=doc_id, label=label).where(F.col("doc_id").isNotNull() & F.col("label").isNotNull())
    usable = usable.where(F.pmod(crc_of_id(F.col("doc_id")), F.lit(folds)) != held_fold).groupBy("doc_id").agg(F.max("label").cast("int").alias("label"))
    sample = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_labels).collect()
    calibrate = sample[: min(most_calibrate, len(sample) // 5)]
    spark = docs.sparkSession
    classes = spark.sparkContext.broadcast({r.doc_id: r.label for r in sample[len(calibrate) :]})
    own = slim(docs, doc_id=doc_id, text=text).withColumn("doc_id", F.col("doc_id").cast("long"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = [Counter(), Counter(), Counter()]  # ordinary, toxic, without a label

        def sums() -> pa.RecordBatch:
            keys, counts = [], []
            for kind, words in enumerate(seen):
                names = list(words)
                if names:
                    owner, key = gram_keys(names)
                    n = np.zeros((len(key), 3), np.int64)
                    n[:, kind] = np.fromiter(words.values(), np.int64, len(names))[owner]
                    keys.append(key)
                    counts.append(n)
                words.clear()
            at, place = np.unique(np.concatenate(keys), return_inverse=True)
            n = np.concatenate(counts)
            total = [np.bincount(place, weights=n[:, k], minlength=len(at)).astype(np.int64) for k in range(3)]
            return pa.record_batch({"gram": pa.array(at), "ordinary": pa.array(total[0]), "toxic": pa.array(total[1]), "other": pa.array(total[2])})

        for batch in batches_of(batches, "text"):
            for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                seen[classes.value.get(i, 2)].update(words_of(t))
            if sum(map(len, seen)) > 300_000:
                yield sums()
        if any(seen):
            yield sums()

    parts = own.mapInArrow(count, "gram long, ordinary long, toxic long, other long")
    grams = stage(parts.groupBy("gram").agg(F.sum("ordinary").alias("ordinary"), F.sum("toxic").alias("toxic"), F.sum("other").alias("other")))
    got = grams.where(F.col("ordinary") + F.col("toxic") > 0).select("gram", "ordinary", "toxic").toArrow()
    keys = got.column("gram").to_numpy()
    model = Model(Counts(keys, got.column("toxic").to_numpy()), Counts(keys, got.column("ordinary").to_numpy()), lower_orders(grams, keys))
    ones = [r.label for r in sample]
    model.base = sum(ones) / len(ones) if ones else 0.5
    if calibrate:
        rows = evidence(own.join(F.broadcast(spark.createDataFrame([(r.doc_id, r.label) for r in calibrate], "doc_id long, label int")), "doc_id"), model, ["label"]).collect()
        x, y = np.array([r.evidence for r in rows]), np.array([r.label for r in rows], float)
        if 0 < y.sum() < len(y):
            order = np.lexsort(x.T)  # rows come in any order; sums should not
            model.curve = logistic(shaped(x[order]), y[order])
    return model


def evidence(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """Evidence and score of each row's whole text, with the columns of ``keep``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = Reader(shared.value)
        for batch in batches_of(batches, "text"):
            got = read(batch.column("text").to_pylist())
            yield pa.record_batch({c: batch.column(c) for c in keep} | {"evidence": pa.array(got.tolist(), pa.list_(pa.float64())), "score": pa.array(shared.value.score(got))})

    kinds = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(*keep, "text").mapInArrow(run, f"{kinds}, evidence array<double>, score double")


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, folds: int = 3, held_fold: int = 1, **options) -> DataFrame:
    """doc_id, held_out, score and predicted for each row. Null and empty texts are texts without words."""
    model = train(docs, labels, folds=folds, held_fold=held_fold, **options)
    scored = evidence(slim(docs, doc_id="doc_id", text="text"), model, ["doc_id"])
    held = F.pmod(crc_of_id(F.col("doc_id")), F.lit(folds)) == held_fold
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
