"""Benchmark passages in documents: CGK embeddings of item-sized windows, bit-sampling LSH, exact edit distance.

Texts are sequences of words (letters and digits, lower case). A document holds an item when some window is within
an edit distance of a fifth of the item's words. The CGK embedding walks over a word sequence and
writes the current word at each step; a random bit of step and word decides whether it moves on. Two sequences
within a small edit distance soon walk in step, so their walks differ in few places. A table samples a few places of
a walk as its key, and a window is looked up in the tables of the items of its length: an item with a key in common is a
candidate, which the exact edit distance confirms. Walks agree less as items grow, so the numbers of tables and places
come from the agreement measured for the length, and from ``target_recall``.

Windows are embedded where they can matter only: by the q-gram lemma, a window within k edits of an item of n words shares
at least n - q + 1 - k * q of its q-grams, along diagonals that differ by k at most. Windows whose diagonals hold
fewer cannot be within the distance, so leaving them out loses nothing.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.llm.tables import batches_of, slim

WORD = re.compile(r"[^\W_]+")
#: no part of any word
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
MOST_TABLES = 96
_U = np.uint64


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def edits(n: int, share: float) -> int:
    return int(n * share + 1e-9)


def gram_size(n: int, k: int) -> int:
    """Longest q of at most three words for which the lemma still asks for a shared q-gram."""
    for q in (3, 2):
        if n - q + 1 - k * q >= 1:
            return q
    return 1


def walks(windows: np.ndarray, lengths: np.ndarray, tables: int) -> Iterator[np.ndarray]:
    """The symbols (rows x tables) that the CGK walks write at each of the first 2 n steps; 2^64 - 1 after a window's end."""
    rows, n = windows.shape
    table = np.arange(tables, dtype=np.uint64)[None, :]
    at = np.zeros((rows, tables), np.int64)
    row = np.arange(rows)[:, None]
    padded = np.concatenate([windows, np.full((rows, 1), -1)], axis=1).astype(np.int64)
    ends = lengths[:, None]
    for t in range(2 * n):
        symbol = padded[row, np.minimum(at, np.minimum(ends, n))]
        symbol = np.where(at >= ends, -1, symbol).astype(np.uint64)
        yield symbol
        bit = _mix(symbol * _U(0xD6E8FEB86659FD93) + table * _U(0xA24BAED4963EE407) + _U(t + 1)) & _U(1)
        at += bit.astype(np.int64)


def cgk_keys(windows: np.ndarray, lengths: np.ndarray, tables: int, sampled: int, seed: int = 1) -> np.ndarray:
    """Keys (rows x tables) of the ``sampled`` places that each table takes of its own walk.

    ``windows`` holds word numbers, padded to the items' length n; equal calls give equal places among the first 2 n.
    """
    rows, n = windows.shape
    places = np.random.default_rng([seed, n]).integers(0, 2 * n, (tables, sampled))
    keys = np.zeros((rows, tables), np.uint64) + np.arange(tables, dtype=np.uint64)[None, :]
    last = int(places.max())
    for t, symbol in enumerate(walks(windows, lengths, tables)):
        hit = (places == t).any(axis=1)
        if hit.any():
            keys[:, hit] = _mix(keys[:, hit] * _U(0x9E3779B97F4A7C15) + symbol[:, hit] + _U(1))
        if t == last:
            break
    return keys


def length_class(n: int) -> int:
    """Least power of two, or one and a half times one, from n words on."""
    size = 4
    while size < n:
        size = size * 3 // 2 if size & (size - 1) == 0 else size * 4 // 3
    return size


@functools.lru_cache(maxsize=None)
def agreement(n: int, k: int, pairs: int = 32, tables: int = 32) -> np.ndarray:
    """Measured share of places (pairs x tables) at which the walks of two sequences of n words agree, k random edits apart."""
    rng = np.random.default_rng([n, k])
    both = np.zeros((2 * pairs, n), np.int64)
    for i in range(pairs):
        one = rng.integers(1, 4 * n + 2, n).tolist()
        other = list(one)
        for _ in range(k):
            place, kind = int(rng.integers(0, len(other))), int(rng.integers(0, 3))
            fresh = int(rng.integers(4 * n + 2, 8 * n + 4))
            other[place : place + (kind != 1)] = [] if kind == 2 and len(other) > 1 else [fresh]
        both[i] = one
        both[pairs + i, : len(other)] = other[:n]
        both[pairs + i, len(other) :] = -1
    same = np.zeros((pairs, tables))
    for symbol in walks(both, (both >= 0).sum(axis=1), tables):
        same += symbol[:pairs] == symbol[pairs:]
    return same / (2 * n)


def tables_for(n: int, share: float, target_recall: float) -> tuple[int, int]:
    """(tables, sampled places) with which one window at the full number of edits meets its item with ``target_recall``.

    The most places a key that need no more than MOST_TABLES tables; one place, with as many tables as it takes, where
    none does. The rate is measured for the class of the length.
    """
    size = length_class(n)
    same = agreement(size, edits(size, share))
    for sampled in (3, 2, 1):
        missed = 1 - (same**sampled).mean(axis=1)
        tables = 1
        while tables < (MOST_TABLES if sampled > 1 else 1 << 16) and 1 - (missed**tables).mean() < target_recall:
            tables += 1
        if 1 - (missed**tables).mean() >= target_recall:
            break
    return tables, sampled


def edit_distance(item: np.ndarray, window: np.ndarray) -> tuple[int, int]:
    """(distance, end) of the item against the best prefix of the window that starts at its first word."""
    width = np.arange(len(window) + 1)
    row = width.copy()
    for i, word in enumerate(item, 1):
        step = np.empty_like(row)
        step[0] = i
        step[1:] = np.minimum(row[1:] + 1, row[:-1] + (window != word))
        row = np.minimum.accumulate(step - width) + width
    end = int(row.argmin())
    return int(row[end]), end


def start_distances(item: np.ndarray, region: np.ndarray) -> np.ndarray:
    """For each place of ``region`` and its end, the least edit distance of the item to a stretch that begins there.

    One recursion from the ends of both: a stretch may end anywhere, so the first row is zero.
    """
    text = region[::-1]
    width = np.arange(len(text) + 1)
    row = np.zeros(len(text) + 1, np.int64)
    for i, word in enumerate(item[::-1], 1):
        step = np.empty_like(row)
        step[0] = i
        step[1:] = np.minimum(row[1:] + 1, row[:-1] + (text != word))
        row = np.minimum.accumulate(step - width) + width
    return row[::-1]


class Items:
    """Benchmark items as word numbers, with their q-grams, and the LSH tables of each length."""

    def __init__(self, rows: list[tuple[int, str]], share: float, target_recall: float = 0.99):
        self.number: dict[str, int] = {}
        self.ids, self.words, self.most, self.q, self.need = [], [], [], [], []
        grams: dict[int, list[tuple[int, int, int]]] = {1: [], 2: [], 3: []}
        for item_id, text in rows:
            words = words_of(text)
            if not words:
                continue
            coded = np.array([self.number.setdefault(w, len(self.number) + 1) for w in words], np.int64)
            n, k = len(coded), edits(len(coded), share)
            q, index = gram_size(n, k), len(self.ids)
            self.ids.append(item_id)
            self.words.append(coded)
            self.most.append(k)
            self.q.append(q)
            self.need.append(max(1, n - q + 1 - k * q))
            for place, gram in enumerate(self.grams(coded, q)):
                grams[q].append((int(gram), index, place))
        self.tables = {}
        for q, found in grams.items():
            if found:
                array = np.array(sorted(found), np.int64)
                self.tables[q] = (array[:, 0], array[:, 1], array[:, 2])
        self.vocabulary = pa.array(list(self.number), pa.string())
        # for each length: tables, places a key, and the keys of its items in order with their items
        self.classes: dict[int, tuple[int, int, np.ndarray, np.ndarray]] = {}
        lengths = np.array([len(w) for w in self.words])
        for n in np.unique(lengths).tolist():
            own = np.flatnonzero(lengths == n)
            count, sampled = tables_for(n, share, target_recall)
            keys = cgk_keys(np.stack([self.words[i] for i in own]), np.full(len(own), n), count, sampled).ravel()
            order = np.argsort(keys, kind="stable")
            self.classes[n] = (count, sampled, keys[order], np.repeat(own, count)[order])

    def grams(self, coded: np.ndarray, q: int) -> np.ndarray:
        """Numbers of the q-grams; words outside the items' vocabulary are 0 and make the gram 0."""
        m = len(coded) - q + 1
        if m < 1:
            return np.zeros(0, np.int64)
        out, known = np.zeros(m, np.int64), np.ones(m, bool)
        for k in range(q):
            out = out * 2_097_152 + coded[k : k + m]  # vocabularies below 2 ** 21 words
            known &= coded[k : k + m] > 0
        return np.where(known, out, 0)

    def find(self, coded: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(item, distance, start, words) of each item that one document holds; its best window."""
        return [hit for _, *hit in self.find_all(coded, np.array([0, len(coded)]))]

    def find_all(self, coded: np.ndarray, edges: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(document, item, distance, start, words) for documents that follow each other in ``coded``, cut at ``edges``."""
        likely: dict[tuple[int, int], list[tuple[int, np.ndarray]]] = {}
        for q, (gram, index, place) in self.tables.items():
            own = self.grams(coded, q)
            at = np.flatnonzero(own)
            at = at[np.isin(own[at], gram)]
            doc = np.searchsorted(edges, at, "right") - 1
            inside = at + q <= edges[doc + 1]  # no gram lies across two documents
            at, doc = at[inside], doc[inside]
            if not len(at):
                continue
            low, high = np.searchsorted(gram, own[at], "left"), np.searchsorted(gram, own[at], "right")
            n = high - low
            row = np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            diagonal, item, doc = np.repeat(at - edges[doc], n) - place[row], index[row], np.repeat(doc, n)
            order = np.lexsort((diagonal, item, doc))
            diagonal, item, doc = diagonal[order], item[order], doc[order]
            cuts = np.flatnonzero(np.r_[True, (item[1:] != item[:-1]) | (doc[1:] != doc[:-1]), True])
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                if b - a >= self.need[item[a]]:
                    likely.setdefault((int(doc[a]), len(self.words[item[a]])), []).append((int(item[a]), diagonal[a:b]))
        found = []
        for (d, n), some in sorted(likely.items(), key=lambda pair: pair[0]):
            found += [(d, *hit) for hit in self.best(coded[edges[d] : edges[d + 1]], n, some)]
        return found

    def regions(self, item: int, diagonals: np.ndarray, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Runs of neighbouring starts, and their shared q-grams, at which the item's lemma allows a window."""
        k, need = self.most[item], self.need[item]
        starts = np.unique(np.concatenate([np.arange(d - k, d + k + 1) for d in np.unique(diagonals)]))
        count = np.searchsorted(diagonals, starts + k, "right") - np.searchsorted(diagonals, starts - k, "left")
        likely = count >= need
        inside = likely & (starts >= 0) & (starts < size)
        if (likely & (starts < 0)).any():  # windows that would begin before the text begin with it
            if 0 not in starts:
                starts, count, inside = np.r_[0, starts], np.r_[need, count], np.r_[True, inside]
            inside |= starts == 0
        starts, count = starts[inside], count[inside]
        order = np.argsort(starts, kind="stable")
        starts, count = starts[order], count[order]
        for part in np.split(np.arange(len(starts)), np.flatnonzero(np.diff(starts) > 1) + 1):
            if len(part):
                yield starts[part], count[part]

    def best(self, coded: np.ndarray, n: int, likely: list[tuple[int, np.ndarray]]) -> list[tuple[int, int, int, int]]:
        """Items of n words that the document holds, among those with enough shared q-grams.

        Windows are looked up in the tables of the length, those that share the most q-grams first. The
        first one that meets an item settles its whole region of starts by the exact distance.
        """
        count, sampled, keys, owners = self.classes[n]
        open_at: dict[int, dict[int, int]] = {}  # item -> start -> region, for regions not settled
        regions, rank = [], {}
        for item, diagonals in likely:
            for starts, shared in self.regions(item, diagonals, len(coded)):
                for s, c in zip(starts.tolist(), shared.tolist()):
                    open_at.setdefault(item, {})[s] = len(regions)
                    rank[s] = max(rank.get(s, 0), c)
                regions.append((item, starts))
        settled, best = set(), {}
        todo = sorted(rank, key=lambda s: (-rank[s], s))
        for a in range(0, len(todo), 16):
            some = np.array([s for s in todo[a : a + 16] if any(at.get(s, -1) not in settled and s in at for at in open_at.values())], np.int64)
            if not len(some):
                continue
            where = some[:, None] + np.arange(n)[None, :]
            windows = np.where(where < len(coded), coded[np.minimum(where, len(coded) - 1)], -1)
            found = cgk_keys(windows, np.minimum(n, len(coded) - some), count, sampled)
            low, high = np.searchsorted(keys, found, "left"), np.searchsorted(keys, found, "right")
            for i, t in zip(*np.nonzero(high > low)):
                for item in owners[low[i, t] : high[i, t]].tolist():
                    region = open_at.get(item, {}).get(int(some[i]))
                    if region is not None and region not in settled:
                        settled.add(region)
                        hit = self.settle(coded, *regions[region])
                        if hit and (item not in best or hit[1:3] < best[item][1:3]):
                            best[item] = hit
        return [best[item] for item in sorted(best)]

    def settle(self, coded: np.ndarray, item: int, starts: np.ndarray) -> tuple[int, int, int, int] | None:
        words, k, first = self.words[item], self.most[item], int(starts[0])
        distance = start_distances(words, coded[first : int(starts[-1]) + len(words) + k])[starts - first]
        at = int(distance.argmin())
        if distance[at] > k:
            return None
        start = int(starts[at])
        return item, int(distance[at]), start, edit_distance(words, coded[start : start + len(words) + k])[1]


def _items(benchmark: DataFrame, share: float, target_recall: float, slices: int, k: int) -> Items:
    rows = benchmark.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(slices)) == k).collect()
    return Items(sorted((r.item_id, r.text) for r in rows if r.text is not None and r.item_id is not None), share, target_recall)


def _coded(texts: pa.Array, known: Items) -> tuple[np.ndarray, np.ndarray]:
    """The word numbers of the texts, one after the other (0 for a word of no item), and the edges of the texts.

    Arrow cuts the texts at white space and numbers the distinct pieces; pieces of ASCII letters and digits, but for marks around them, are words.
    """
    cut = pc.utf8_split_whitespace(pc.fill_null(texts.cast(pa.string()), ""))
    pieces = cut.flatten().dictionary_encode()
    distinct, at = pieces.dictionary, pieces.indices.to_numpy(zero_copy_only=False)
    bare = pc.ascii_trim(distinct, characters=MARKS)
    number = pc.fill_null(pc.index_in(pc.ascii_lower(bare), value_set=known.vocabulary), -1).to_numpy(zero_copy_only=False).astype(np.int64) + 1
    odd = np.flatnonzero(~pc.ascii_is_alnum(bare).to_numpy(zero_copy_only=False))
    size = np.ones(len(distinct), np.int64)
    first = np.arange(len(distinct))
    more: list[int] = []
    for i, piece in zip(odd.tolist(), distinct.take(pa.array(odd)).to_pylist()):
        words = words_of(piece)
        size[i], first[i] = len(words), len(distinct) + len(more)
        more += [known.number.get(w, 0) for w in words]
    flat = np.concatenate([number, np.array(more, np.int64)])
    each = size[at]
    ends = np.concatenate([[0], np.cumsum(each)])
    coded = flat[np.repeat(first[at] - ends[:-1], each) + np.arange(ends[-1])]
    lists = np.concatenate([[0], np.cumsum(pc.list_value_length(cut).to_numpy(zero_copy_only=False))]).astype(np.int64)
    return coded, ends[lists]


def find_items(docs: DataFrame, benchmark: DataFrame, share: float = 0.2, target_recall: float = 0.99, most_items: int = 20_000, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, item_id, distance, start and n_words: one row for each document and item that it holds.

    ``start`` counts words from 0; of several windows the one of the least distance, then the first, is given. Null and empty texts hold
    nothing, and items without words or id are held by none. Rows that repeat a document give a row each. Items are broadcast
    in slices of about ``most_items``, each with a pass of its own over the documents. ``target_recall`` is for a single window at the
    full number of edits; the windows beside it add to it. Texts of any length are read whole; an empty table gives no rows.
    """
    own = slim(docs, doc_id=doc_id, text=text).where(F.col("text").isNotNull())
    items = slim(benchmark, item_id="item_id", text="text")
    slices = max(1, -(-items.count() // most_items))
    spark, out = docs.sparkSession, None
    kind = own.schema["doc_id"].dataType.simpleString()
    for k in range(slices):
        shared = spark.sparkContext.broadcast(_items(items, share, target_recall, slices, k))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            known = shared.value
            for batch in batches_of(batches, "text"):
                rows = known.find_all(*_coded(batch.column("text"), known))
                if rows:
                    at, item, distance, start, size = zip(*rows)
                    yield pa.record_batch(
                        {
                            "doc_id": batch.column("doc_id").take(pa.array(at)),
                            "item_id": pa.array([known.ids[i] for i in item], pa.int64()),
                            "distance": pa.array(distance, pa.int32()),
                            "start": pa.array(start, pa.int64()),
                            "n_words": pa.array(size, pa.int32()),
                        }
                    )

        part = own.mapInArrow(run, f"doc_id {kind}, item_id long, distance int, start long, n_words int")
        out = part if out is None else out.unionAll(part)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, share: float = 0.2, target_recall: float = 0.99, most_items: int = 20_000, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no item, with all their columns, however named; rows of null or empty text stay, repeated rows share one verdict."""
    items = slim(benchmark, item_id="item_id", text="text")
    slices = max(1, -(-items.count() // most_items))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    for k in range(slices):
        shared = docs.sparkSession.sparkContext.broadcast(_items(items, share, target_recall, slices, k))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            known = shared.value
            for batch in batches_of(batches, text):
                clean = np.ones(batch.num_rows, bool)
                clean[[d for d, *_ in known.find_all(*_coded(batch.column(text), known))]] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(run, schema)
    return docs
