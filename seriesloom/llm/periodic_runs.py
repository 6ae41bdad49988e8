"""Maximal runs of repeated words in each text, and texts with the repeats taken out.

A run is a stretch of words with smallest period q and at least ``max(24, 3 q)`` words that no neighbouring word extends.

Recompression: words are compressed level by level, first each block of equal symbols into one, then pairs of a left and a
right symbol, which together give a run-length grammar of the texts of a batch. Equal stretches are compressed alike but for
their ends, so the length of a common extension is found by climbing from two positions while they agree and coming down
where they differ, a few symbols on each level. A period q is tried on the grid 0, q, 2q, ..: a run covers three grid
points, and from one of them the extensions to the right and to the left give the whole stretch with period q.

Every eight words of a run come again within it, so only stretches of words in which each eight words repeat are compressed
and have grids; grid points whose next eight words differ from those a period later are passed over. Hashes only choose
candidates; all extensions are exact.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.llm.tables import batches_of, slim

LEAST, TIMES, GRAM = 24, 3, 8


# --- grammar


class Grammar:
    """Levels of a text whose first and last symbols occur once.

    ``symbols[t]`` are the symbols of a level, ``first[t]`` their first child one level below and ``up[t]`` their parent's
    place; ``equal[t]`` counts equal symbols from a place on, where the next level joins blocks, and is None elsewhere.
    """

    def __init__(self, text: np.ndarray, least: int = 2, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.symbols, self.first, self.up, self.equal = [text], [None], [], []
        idle = 0
        while len(self.symbols[-1]) > least and idle < 12:
            before = len(self.symbols[-1])
            now = self.symbols[-1]
            change = np.concatenate([[True], now[1:] != now[:-1]])
            if not change.all():
                starts = np.nonzero(change)[0]
                length = np.diff(np.append(starts, len(now)))
                block = np.cumsum(change) - 1
                self.equal.append(starts[block] + length[block] - np.arange(len(now)))
                self._level(now[starts] * (length.max() + 1) + length, starts, block)
            now = self.symbols[-1]
            side = rng.integers(0, 2, int(now.max()) + 1).astype(bool)[now]
            # the orientation that joins more pairs
            joins = max((~side[:-1] & side[1:], side[:-1] & ~side[1:]), key=np.count_nonzero)
            if joins.any():
                second = np.concatenate([[False], joins])
                starts = np.nonzero(~second)[0]
                mate = np.where(np.append(joins, False), np.append(now[1:], 0) + 1, 0)
                self.equal.append(None)
                self._level(now[starts] * (now.max() + 2) + mate[starts], starts, np.cumsum(~second) - 1)
            idle = 0 if len(self.symbols[-1]) < before else idle + 1

    def _level(self, names: np.ndarray, starts: np.ndarray, parent: np.ndarray) -> None:
        self.symbols.append(np.unique(names, return_inverse=True)[1].astype(np.int64))
        self.first.append(starts)
        self.up.append(parent)

    def mirrored(self) -> Grammar:
        """The same grammar, read from right to left."""
        out = Grammar.__new__(Grammar)
        sizes = [len(s) for s in self.symbols]
        out.symbols = [s[::-1] for s in self.symbols]
        out.up = [sizes[t + 1] - 1 - up[::-1] for t, up in enumerate(self.up)]
        out.first = [None] + [(sizes[t - 1] - np.append(self.first[t][1:], sizes[t - 1]))[::-1] for t in range(1, len(sizes))]
        out.equal = []
        for t, equal in enumerate(self.equal):
            if equal is None:
                out.equal.append(None)
                continue
            # from the left, the place within its block counts
            first = self.first[t + 1][self.up[t]]
            out.equal.append((np.arange(sizes[t]) - first + 1)[::-1])
        return out

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Number of equal symbols of the text from the places ``a`` and ``b`` (a != b) on."""
        start, a, b, top = a, a.copy(), b.copy(), len(self.symbols) - 1
        stop = np.full(len(a), top)
        climbing = np.arange(len(a))
        for t in range(top):
            first, up = self.first[t + 1], self.up[t]
            inside = climbing
            while len(inside):
                x, y = a[inside], b[inside]
                inside = inside[(first[up[x]] != x) | (first[up[y]] != y)]
                inside = self._pass(t, a, b, inside, stop)
            climbing = climbing[stop[climbing] > t]
            if not len(climbing):
                break
            a[climbing], b[climbing] = up[a[climbing]], up[b[climbing]]
        for t in range(top, -1, -1):
            inside = here = np.nonzero(stop >= t)[0]
            while len(inside):
                inside = self._pass(t, a, b, inside)
            if t:
                a[here], b[here] = self.first[t][a[here]], self.first[t][b[here]]
        return a - start

    def _pass(self, t: int, a: np.ndarray, b: np.ndarray, inside: np.ndarray, stop: np.ndarray | None = None) -> np.ndarray:
        """Step over equal symbols of level t; those that differ are marked in ``stop``. Returns the ones that stepped."""
        x, y = a[inside], b[inside]
        same = self.symbols[t][x] == self.symbols[t][y]
        if stop is not None:
            stop[inside[~same]] = t
        inside, x, y = inside[same], x[same], y[same]
        equal = self.equal[t] if t < len(self.equal) else None
        step = 1 if equal is None else np.minimum(equal[x], equal[y])
        a[inside], b[inside] = x + step, y + step
        return inside


# --- candidates


def gram_hashes(words: np.ndarray) -> np.ndarray:
    """A hash of the eight words from each place on; the last seven places have none of their own."""
    with np.errstate(over="ignore"):
        h = words.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for step, by in ((1, 0xBF58476D1CE4E5B9), (2, 0x94D049BB133111EB), (4, 0xD6E8FEB86659FD93)):
            h ^= h >> np.uint64(29)
            out = h * np.uint64(by)
            out[: max(0, len(h) - step)] += h[step:]
            h = out
        return h ^ (h >> np.uint64(32))


def stretches(on: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of stretches of True of at least that length."""
    edge = np.diff(np.concatenate([[0], on.astype(np.int8), [0]]))
    start, end = np.nonzero(edge == 1)[0], np.nonzero(edge == -1)[0]
    keep = end - start >= least
    return start[keep], end[keep]


def repeating(hashes: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per text, stretches of places whose eight words come again in it (or seem to); ``hashes`` is changed.

    The texts stand one after the other, with ``size`` words each. A run has at least 24 words, so 17 such places in a row.
    """
    ends = np.cumsum(size)
    text = np.repeat(np.arange(len(size)), size)
    with np.errstate(over="ignore"):
        hashes ^= (text.astype(np.uint64) + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F)
    whole = np.arange(len(hashes)) + GRAM <= ends[text]
    bits = max(10, int(len(hashes)).bit_length() + 2)
    slot = (hashes >> np.uint64(64 - bits)).astype(np.int64)
    seen = np.bincount(slot[whole], minlength=1 << bits)
    start, end = stretches(whole & (seen[slot] > 1), LEAST - GRAM + 1)
    return text[start], start, end


def grid(hashes: np.ndarray, start: int, end: int) -> Iterator[tuple[int, np.ndarray]]:
    """Periods with the grid points whose eight words are those of a period later."""
    words = end - start + GRAM - 1
    for q in range(1, words // TIMES + 1):
        here = hashes[start : end - q : q] == hashes[start + q : end : q]
        if here.any():
            yield q, np.nonzero(here)[0] * q


def runs_of(words: np.ndarray, hashes: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start in the text, length, period) of all runs of all texts, by text, start and period.

    ``words`` are exact numbers of the words of all texts, one text after the other.
    """
    none = tuple(np.zeros(0, np.int64) for _ in range(4))
    texts, starts, ends = repeating(hashes, size)
    found, pieces, at = [], [], 1
    origin = np.cumsum(size) - size
    for k, (a, b) in enumerate(zip(starts.tolist(), ends.tolist())):
        points = [(q, p) for q, p in grid(hashes, a, b)]
        if points:
            found += [(k, q, at, p) for q, p in points]
            pieces.append((a, b + GRAM - 1, at))
            at += b + GRAM - 1 - a + 1
    if not found:
        return none
    # the stretches one after the other, each after a symbol that occurs once
    text = np.zeros(at, np.int64)
    marks = words.max() + 1 + np.arange(len(pieces) + 1)
    text[0] = marks[0]
    for (a, b, to), mark in zip(pieces, marks[1:]):
        text[to : to + b - a], text[to + b - a] = words[a:b], mark
    text = np.unique(text, return_inverse=True)[1].astype(np.int64)
    right = Grammar(text, least=2 * len(pieces) + 1)
    left = right.mirrored()
    # all grid points as one sorted list; each round takes the first of a period that no found stretch covers
    groups = [len(p) for *_, p in found]
    piece = np.array([k for k, *_ in found])
    period, base = np.array([q for _, q, _, _ in found]), np.array([to for _, _, to, _ in found])
    keys = np.concatenate([g * len(text) + to + p for g, (_, _, to, p) in enumerate(found)])
    end = np.cumsum(groups)
    at, active, rows = end - groups, np.arange(len(groups)), []
    while len(active):
        i, q = keys[at[active]] - active * len(text), period[active]
        after = right.common(i, i + q)
        before = left.common(len(text) - i, len(text) - i - q)
        first, stop = i - before, i + q + after
        long = stop - first >= np.maximum(LEAST, TIMES * q)
        rows.append(np.stack([piece[active][long], first[long] - base[active][long], stop[long] - first[long], q[long]]))
        at[active] = np.searchsorted(keys, active * len(text) + np.maximum(i + 1, stop - q))
        active = active[at[active] < end[active]]
    piece, first, length, q = np.concatenate(rows, axis=1)
    text, first = texts[piece], first + starts[piece] - origin[texts[piece]]
    # one stretch has the multiples of its smallest period as well
    order = np.lexsort([q, length, first, text])
    text, first, length, q = text[order], first[order], length[order], q[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (first[1:] != first[:-1]) | (length[1:] != length[:-1])
    text, first, length, q = text[new], first[new], length[new], q[new]
    order = np.lexsort([q, first, text])
    return text[order], first[order], length[order], q[order]


# --- texts


def planted(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """For a tenth of the ids, chosen by their crc32, the words from some place on repeat with some period."""
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    unit = words[a : a + p]
    return words[:a] + (unit * ((n - a) // p + 1))[: n - a]


def batch_runs(texts: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """The runs (start, length, period) of each text, by start and period."""
    size = np.array([len(t) for t in texts], np.int64)
    # hashes of words find the texts that may have runs; only those get exact numbers
    hashes = gram_hashes(np.fromiter((hash(w) for t in texts for w in t), np.int64, int(size.sum())))
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    some = np.unique(repeating(hashes.copy(), size)[0])
    if not len(some):
        return out
    number: dict[bytes, int] = {}
    words = np.fromiter((number.setdefault(w, len(number)) for k in some.tolist() for w in texts[k]), np.int64, int(size[some].sum()))
    inside = np.zeros(len(texts), bool)
    inside[some] = True
    found = runs_of(words, hashes[np.repeat(inside, size)], size[some])
    for k, *run in zip(*(x.tolist() for x in found)):
        out[some[k]].append(tuple(run))
    return out


def kept_words(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without the repeats: of a run, what comes after its first period goes."""
    if not runs:
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return [words[i] for i in np.nonzero(np.cumsum(edge)[:-1] == 0)[0].tolist()]


def best_of(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of the greatest length / period; of equal ones, the first, then the one of the shorter period."""
    best = None
    for run in runs:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


COLUMNS = {"doc_id": pa.int64(), "n_runs": pa.int64(), "start": pa.int64(), "length": pa.int64(), "period": pa.int64(), "exponent_milli": pa.int64(), "runs": pa.list_(pa.list_(pa.int64())), "runs_sha256": pa.string(), "collapsed": pa.string(), "collapsed_sha256": pa.string()}
SCHEMA = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs array<array<long>>, runs_sha256 string, collapsed string, collapsed_sha256 string"


def find_runs(docs: DataFrame, plant: bool = False, texts: bool = True, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: n_runs, the best run, all runs as (start, length, period), the text without repeats, and sha256 of both.

    Words are the stretches of bytes other than space, tab and line breaks, numbered from 0; the whole text counts, however
    long. Null and empty texts and texts of white space have no words, no run and the empty text as result. A null id stays
    null (and counts as the empty text for ``plant``). Repeated rows give a row each, an empty table none; equal ratios of
    length and period go to the first run. Other columns are neither read nor kept, so their names cannot clash. With
    ``plant``, a tenth of the ids get a tail that repeats. Without ``texts``, the columns runs and collapsed are left out.
    """
    names = [c for c in COLUMNS if texts or c not in ("runs", "collapsed")]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(batches, "text"):
            ids = batch.column("doc_id").to_pylist()
            words = [(t or "").encode().split() for t in batch.column("text").to_pylist()]
            if plant:
                words = [planted(w, d) for w, d in zip(words, ids)]
            out: dict[str, list] = {c: [] for c in COLUMNS}
            for d, w, runs in zip(ids, words, batch_runs(words)):
                best = best_of(runs)
                collapsed = b" ".join(kept_words(w, runs))
                row = (d, len(runs), *(best or (None, None, None)), best and 1000 * best[1] // best[2])
                listed = "".join(f"{a},{n},{q}\n" for a, n, q in runs).encode()
                row += (runs, hashlib.sha256(listed).hexdigest(), collapsed.decode() if texts else None, hashlib.sha256(collapsed).hexdigest())
                for c, v in zip(COLUMNS, row):
                    out[c].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[c], COLUMNS[c]) for c in names], names)

    schema = ", ".join(c for c in SCHEMA.split(", ") if c.split(" ")[0] in names)
    own = slim(docs, doc_id=doc_id, text=text)
    return own.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(rows, schema)
