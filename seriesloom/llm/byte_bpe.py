"""Byte-level BPE with DuckDB inside the tasks.

Each task cuts its texts into the words of the pattern and keeps the distinct ones. A recursive query holds them as
token-position rows: every step joins neighbouring tokens with the merge table, takes each word's leftmost pair of the
lowest rank and contracts it, until no word has a pair left. An ordered aggregation over the vocabulary turns the
ids back into bytes. A text's ids and bytes are those of its words in order.

The merge table lists every way in which a token of the vocabulary is two tokens of the vocabulary, since that is what
rank files mean. The recursion needs a step for each merge of the longest word, so words of more than
``LONG_WORD`` bytes (runs without a break, such as encoded data) are contracted by the same rule with a heap.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.llm.tables import batches_of, slim

LONG_WORD = 400
WORDS_AT_ONCE = 40_000

#: A row is a token: its first byte, the byte after it, its id and the id of the token after it. A contraction keeps the row
#: of the right token, which takes over the left one's first byte, and tells the row before it. Rank and places are packed in one number.
CONTRACT = """
CREATE OR REPLACE TEMP TABLE contracted AS
WITH RECURSIVE state(word, pos, stop, id, next, step) AS (
    SELECT word, pos, stop, id, next, 0 FROM starts
    UNION ALL
    SELECT s.word, CASE WHEN s.pos = b.stop THEN b.pos ELSE s.pos END, s.stop,
           CASE WHEN s.pos = b.stop THEN b.rank ELSE s.id END, CASE WHEN s.stop = b.pos THEN b.rank ELSE s.next END, s.step + 1
    FROM state s
    JOIN (
        SELECT word, (best // 1048576)::INTEGER AS rank, (best // 1024 % 1024)::INTEGER AS pos, (best % 1024)::INTEGER AS stop
        FROM (
            SELECT t.word, min((m.rank::BIGINT * 1024 + t.pos) * 1024 + t.stop) AS best
            FROM state t JOIN merges m ON m.left_id = t.id AND m.right_id = t.next GROUP BY t.word
        )
    ) b ON b.word = s.word
    WHERE s.pos <> b.pos
)
SELECT word, pos, id FROM state JOIN (SELECT word, max(step) AS step FROM state GROUP BY word) USING (word, step)
"""

DECODE = """
SELECT word, list(id ORDER BY pos) AS ids, string_agg(hex, '' ORDER BY pos) AS hex
FROM contracted JOIN vocabulary USING (id) GROUP BY word
"""


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def merge_rows(ranks: dict[bytes, int]) -> pa.Table:
    rows = [(ranks[t[:i]], ranks[t[i:]], rank) for t, rank in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
    left, right, rank = zip(*rows) if rows else ((), (), ())
    return pa.table({"left_id": pa.array(left, pa.int32()), "right_id": pa.array(right, pa.int32()), "rank": pa.array(rank, pa.int32())})


def contract_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same contraction for one long word: leftmost pair of the lowest rank first."""
    parts, after, before = [word[i : i + 1] for i in range(len(word))], list(range(1, len(word) + 1)), list(range(-1, len(word) - 1))
    heap = []

    def offer(i: int) -> None:
        if i >= 0 and after[i] < len(parts) and (rank := ranks.get(parts[i] + parts[after[i]])) is not None:
            heapq.heappush(heap, (rank, i, parts[i], parts[after[i]]))

    for i in range(len(parts)):
        offer(i)
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = after[i]
        if parts[i] != a or j >= len(parts) or parts[j] != b:
            continue
        parts[i], parts[j] = a + b, None
        after[i] = after[j]
        if after[j] < len(parts):
            before[after[j]] = i
        offer(before[i])
        offer(i)
    return [ranks[p] for p in parts if p is not None]


class WordTable:
    """Words with their ids (little-endian unsigned 32-bit) and decoded bytes, in a task's DuckDB.

    Words are remembered in two generations of at most ``most`` each, so that frequent ones stay.
    """

    def __init__(self, path: str, most: int = 200_000):
        import duckdb

        self.ranks = read_ranks(path)
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.first = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": "400MB"})
        merges = merge_rows(self.ranks)  # noqa: F841  DuckDB reads it by its name
        self.con.execute("CREATE TABLE merges AS SELECT * FROM merges")
        words = pa.table({"id": pa.array(self.tokens.keys(), pa.int32()), "hex": pa.array([t.hex() for t in self.tokens.values()])})  # noqa: F841
        self.con.execute("CREATE TABLE vocabulary AS SELECT * FROM words")
        self.most, self.young, self.old = most, {}, {}

    def learn(self, words: set[str]) -> None:
        """Make sure that all ``words`` are remembered in the young generation."""
        if len(self.young) > self.most:
            self.old, self.young = self.young, {}
        missing = words - self.young.keys()
        again = missing & self.old.keys()
        self.young.update((w, self.old[w]) for w in again)
        new = list(missing - again)
        coded = [w.encode() for w in new]
        short = [i for i, c in enumerate(coded) if len(c) <= LONG_WORD]
        for k in range(0, len(short), WORDS_AT_ONCE):
            some = short[k : k + WORDS_AT_ONCE]
            for i, entry in zip(some, self.contract([coded[i] for i in some])):
                self.young[new[i]] = entry
        for word, code in zip(new, coded):
            if len(code) > LONG_WORD:
                ids = contract_long(code, self.ranks)
                self.young[word] = (np.array(ids, "<u4").tobytes(), b"".join(self.tokens[i] for i in ids))

    def contract(self, words: list[bytes]) -> list[tuple[bytes, bytes]]:
        if not words:
            return []
        size = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(size)
        first = self.first[np.frombuffer(b"".join(words), np.uint8)]
        place = (np.arange(ends[-1]) - np.repeat(ends - size, size)).astype(np.int32)
        after = np.append(first[1:], -1).astype(np.int32)
        after[ends - 1] = -1
        starts = pa.table({"word": np.repeat(np.arange(len(words), dtype=np.int32), size), "pos": place, "stop": place + 1, "id": first, "next": after})  # noqa: F841
        self.con.execute(CONTRACT)
        got = self.con.sql(DECODE).to_arrow_table()
        ids, offsets = got.column("ids").combine_chunks(), None
        flat = ids.flatten().to_numpy().astype("<u4")
        offsets = np.concatenate([[0], np.cumsum(ids.value_lengths().to_numpy())])
        out: list = [None] * len(words)
        for row, (word, text) in enumerate(zip(got.column("word").to_pylist(), got.column("hex").to_pylist())):
            out[word] = (flat[offsets[row] : offsets[row + 1]].tobytes(), bytes.fromhex(text))
        return out


def encode_decode(docs: DataFrame, ranks: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ids (binary, little-endian unsigned 32-bit) and decoded (binary) for each row.

    ``ranks`` is the path of a rank file that every executor has, ``pattern`` the expression that cuts texts into words.
    Special tokens in a text are ordinary text. A null text counts as empty and has no ids; ids of documents play no
    part, so null and repeated ones are kept as they are. An empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        cut, known = regex.compile(pattern), WordTable(ranks)
        for batch in batches_of(batches, "text"):
            words = [cut.findall(t or "") for t in batch.column("text").to_pylist()]
            known.learn(set().union(*words))
            got = [[known.young[w] for w in one] for one in words]
            yield pa.record_batch(
                {
                    "doc_id": batch.column("doc_id"),
                    "ids": pa.array([b"".join([g[0] for g in one]) for one in got], pa.binary()),
                    "decoded": pa.array([b"".join([g[1] for g in one]) for one in got], pa.binary()),
                }
            )

    own = slim(docs, doc_id=doc_id, text=text)
    return own.mapInArrow(run, f"doc_id {own.schema['doc_id'].dataType.simpleString()}, ids binary, decoded binary")


def digests(coded: DataFrame) -> DataFrame:
    """Length and digests of ``encode_decode``'s rows."""
    return coded.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )
