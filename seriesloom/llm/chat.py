"""Chat transcripts to canonical turns: a hidden Markov model over lines, decoded by Viterbi.

The hidden state of a line is its speaker: system, user or assistant. A line shows a speaker marker (the role given for its row
on the row's first line, or a name with a colon at its start) and features of its text: length, question
mark, list or code, first of its row. Emission and transition counts come from the rows whose role is given, summed over
the whole table; markers are trusted but for ``MARKER_ERROR``. The most likely sequence of speakers is rendered as turns.

A conversation may be of any length: it is cut into chunks of ``CHUNK`` turn numbers. A chunk's best scores between all pairs of states
are a small matrix, and such matrices combine by max-plus products. They are combined upwards in groups of
``FAN``, then each chunk is told the best scores before and after it and is decoded on its own. Scores
are integers (millionths of a nat), so that this gives the same total as a walk over the whole conversation;
only between equally likely paths may two chunks choose differently.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from seriesloom.llm.tables import slim, sorted_runs, stage

STATES = ("system", "user", "assistant")
NAMES = {
    "system": 0, "sys": 0, "instruction": 0, "instructions": 0, "developer": 0,
    "user": 1, "human": 1, "customer": 1, "prompter": 1, "question": 1, "q": 1,
    "assistant": 2, "bot": 2, "ai": 2, "model": 2, "gpt": 2, "agent": 2, "answer": 2, "a": 2,
}
#: q and a name a speaker only together with a colon
MARKER = re.compile(r"^\s*(?:\*\*|#+\s*|\[|<\|?)?\s*(" + "|".join(sorted(NAMES, key=len, reverse=True)) + r")\s*(?:\*\*|\]|\|?>)?\s*:(?:\*\*)?\s*", re.IGNORECASE)
MARKER_ERROR = 0.02
FEATURES = 5 * 2 * 2 * 2
CHUNK, FAN = 256, 64
NEVER = -(10**15)


def given_role(role: str | None) -> int:
    return NAMES.get((role or "").strip().strip(":").lower(), -1)


def feature(line: str, first: bool) -> int:
    """Number of a line's combination of features."""
    size = min(4, len(line).bit_length() // 2)
    listed = bool(re.match(r"\s*(?:[-*•]|\d+[.)]|```|\|)\s?", line))
    return ((size * 2 + ("?" in line)) * 2 + listed) * 2 + first


def lines_of(role: str | None, text: str | None) -> list[tuple[str, int, int, bool]]:
    """(line without marker, marker or -1, feature, first of the row) of a row."""
    out = []
    for i, line in enumerate((text or "").split("\n")):
        match = MARKER.match(line)
        marker = NAMES[match[1].lower()] if match else given_role(role) if i == 0 else -1
        body = line[match.end() :] if match else line
        out.append((body, marker, feature(body, i == 0), i == 0))
    return out


@dataclass
class Speakers:
    """Integer log-probabilities: of the first state, of moves between rows and inside a row, of features, of markers."""

    first: np.ndarray
    rows: np.ndarray
    inside: np.ndarray
    shown: np.ndarray

    def emission(self, marker: int, feature: int) -> np.ndarray:
        out = self.shown[:, feature].copy()
        if marker >= 0:
            out += np.where(np.arange(len(STATES)) == marker, whole_log(1 - MARKER_ERROR), whole_log(MARKER_ERROR / (len(STATES) - 1)))
        return out

    def move(self, first: bool, marker: int) -> np.ndarray:
        """Between rows, and into a marked line, speakers change as between rows; other lines mostly go on."""
        return self.rows if first or marker >= 0 else self.inside


def whole_log(p) -> np.ndarray:
    return np.rint(np.log(p) * 1e6).astype(np.int64)


def normal(counts: np.ndarray) -> np.ndarray:
    """Log-probabilities of counts with one added to each."""
    counts = np.asarray(counts, float) + 1
    return whole_log(counts / counts.sum(axis=-1, keepdims=True))


def learn(rows: DataFrame) -> Speakers:
    """Counts over ``rows`` (conv, chunk, turn, role, text; no two equal): of features by role, and of roles that follow each other.

    Features are counted where the rows are read; only roles are brought together by conversation, and of each chunk its
    first and last role, for the moves between chunks.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shown = np.zeros((len(STATES), FEATURES), np.int64)
        for batch in batches:
            for role, text in zip(batch.column("role").to_pylist(), batch.column("text").to_pylist()):
                if (state := given_role(role)) >= 0:
                    for _, _, kind, _ in lines_of(role, text):
                        shown[state, kind] += 1
        yield counted(shown=shown)

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        moves = np.zeros((len(STATES), len(STATES)), np.int64)
        for table in sorted_runs(batches, ["conv", "chunk"]):
            edges: list[list[int]] = []  # conv, chunk, first and last state
            for conv, chunk, role in zip(*(table.column(c).to_pylist() for c in ("conv", "chunk", "role"))):
                state = given_role(role)
                if not edges or edges[-1][:2] != [conv, chunk]:
                    edges.append([conv, chunk, state, state])
                    continue
                if state >= 0 and edges[-1][3] >= 0:
                    moves[edges[-1][3], state] += 1
                edges[-1][3] = state
            yield pa.record_batch({"name": pa.array(["edge"] * len(edges)), "counts": pa.array(edges, pa.list_(pa.int64()))})
        yield counted(moves=moves)

    def counted(**sums: np.ndarray) -> pa.RecordBatch:
        return pa.record_batch({"name": pa.array(list(sums)), "counts": pa.array([x.ravel().tolist() for x in sums.values()], pa.list_(pa.int64()))})

    schema = "name string, counts array<long>"
    roles = rows.select("conv", "chunk", "turn", "role").repartition("conv", "chunk").sortWithinPartitions("conv", "chunk", F.col("turn").asc_nulls_last(), "role")
    parts = stage(rows.select("role", "text").mapInArrow(count, schema).unionAll(roles.mapInArrow(follow, schema)))
    edges = parts.where("name = 'edge'").select(*[F.col("counts")[i].alias(c) for i, c in enumerate(("conv", "chunk", "start", "end"))])
    numbered = _number(edges)
    # the first chunk's first role, and moves from a chunk's last role to the first of the next
    firsts = numbered.where("idx = 0 AND start >= 0").groupBy("start").count().collect()
    nexts = numbered.select("conv", (F.col("idx") - 1).alias("idx"), F.col("start").alias("to")).where("to >= 0 AND idx >= 0")
    borders = numbered.where("end >= 0").join(nexts, ["conv", "idx"]).groupBy("end", "to").count().collect()
    # one row of at most a few hundred sums for each name and place
    sums = parts.where("name <> 'edge'").select("name", F.posexplode("counts").alias("at", "n")).groupBy("name", "at").agg(F.sum("n").alias("n")).collect()
    found = {"shown": np.zeros(len(STATES) * FEATURES), "moves": np.zeros(len(STATES) ** 2), "first": np.zeros(len(STATES))}
    for r in sums:
        found[r.name][r["at"]] = r.n
    for r in firsts:
        found["first"][r["start"]] = r["count"]
    for r in borders:
        found["moves"][r["end"] * len(STATES) + r["to"]] += r["count"]
    stay = np.full((len(STATES), len(STATES)), 0.02 / (len(STATES) - 1))
    np.fill_diagonal(stay, 0.98)
    return Speakers(normal(found["first"]), normal(found["moves"].reshape(len(STATES), -1)), whole_log(stay), normal(found["shown"].reshape(len(STATES), -1)))


def best(scores: np.ndarray, move: np.ndarray) -> np.ndarray:
    """Max-plus product."""
    return (scores[..., :, None] + move).max(axis=-2)


def summary(model: Speakers, lines: list[tuple]) -> np.ndarray:
    """Rows: best scores to each end state, from each state before the lines, and last from the start of a conversation."""
    out = None
    for _, marker, kind, first in lines:
        shown, move = model.emission(marker, kind), model.move(first, marker)
        if out is None:
            out = np.concatenate([move, model.first[None, :]]) + shown
        else:
            out = best(out, move) + shown
    return out


def decode(model: Speakers, lines: list[tuple], before: np.ndarray | None, after: np.ndarray | None) -> list[int]:
    """Most likely states, given best scores of the states before and after the lines."""
    score, back = None, []
    for _, marker, kind, first in lines:
        shown, move = model.emission(marker, kind), model.move(first, marker)
        if score is None:
            score = (model.first if before is None else best(before, move)) + shown
        else:
            steps = score[:, None] + move
            back.append(steps.argmax(axis=0))
            score = steps.max(axis=0) + shown
    state = int((score if after is None else score + after).argmax())
    out = [state]
    for step in reversed(back):
        state = int(step[state])
        out.append(state)
    return out[::-1]


def _pack(x: np.ndarray) -> bytes:
    return np.asarray(x, "<i8").tobytes()


def _matrix(x: bytes) -> np.ndarray:
    return np.frombuffer(x, "<i8").reshape(-1, len(STATES))


def _chunks(rows: DataFrame, work, schema: str) -> DataFrame:
    """Apply ``work(conv, chunk, table)`` to each chunk of rows that are sorted by conversation, chunk and turn."""

    kinds = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in sorted_runs(batches, ["conv", "chunk"]):
            names = list(zip(table.column("conv").to_pylist(), table.column("chunk").to_pylist()))
            edges = [i for i in range(len(names)) if i == 0 or names[i] != names[i - 1]] + [len(names)]
            out = [row for a, b in zip(edges[:-1], edges[1:]) for row in work(*names[a], table.slice(a, b - a))]
            if out:
                yield from pa.Table.from_pylist(out, kinds).to_batches()

    return rows.mapInArrow(run, schema)


def _boundaries(nodes: DataFrame, levels: int) -> DataFrame:
    """conv, idx, before, after of each chunk of the conversations with several chunks.

    ``nodes``: conv, idx, scores (from ``summary``). Works upwards by groups of FAN, then downwards.
    """
    ladder = [nodes]
    group = "conv long, idx long, scores binary"
    for _ in range(levels):

        def up(key, table):
            table = table.sort_by("idx")
            scores = [_matrix(x) for x in table.column("scores").to_pylist()]
            total = scores[0]
            for own in scores[1:]:
                total = best(total, own[: len(STATES)])
            return pa.table({"conv": [key[0].as_py()], "idx": [key[1].as_py()], "scores": [_pack(total)]})

        grouped = ladder[-1].withColumn("up", F.floor(F.col("idx") / FAN)).groupBy("conv", "up")
        ladder.append(stage(grouped.applyInArrow(up, group)))
    found = ladder[-1].select("conv", "idx", F.lit(None).cast("binary").alias("before"), F.lit(None).cast("binary").alias("after"))
    for level in reversed(ladder[:-1]):

        def down(key, table):
            table = table.sort_by("idx")
            scores = [_matrix(x) for x in table.column("scores").to_pylist()]
            first, last = table.column("before")[0].as_py(), table.column("after")[0].as_py()
            before, now = [], None if first is None else _matrix(first)[0]
            for own in scores:
                before.append(now)
                now = own[len(STATES)] if now is None else best(now, own[: len(STATES)])
            after, now = [], None if last is None else _matrix(last)[0]
            for own in reversed(scores):
                after.append(now)
                now = (own[: len(STATES)] + (0 if now is None else now)).max(axis=1)
            pack = lambda xs: pa.array([None if x is None else _pack(x) for x in xs], pa.binary())
            return pa.table({"conv": table.column("conv"), "idx": table.column("idx"), "before": pack(before), "after": pack(after[::-1])})

        above = found.select("conv", F.col("idx").alias("up"), "before", "after")
        joined = level.withColumn("up", F.floor(F.col("idx") / FAN)).join(above, ["conv", "up"])
        found = stage(joined.groupBy("conv", "up").applyInArrow(down, "conv long, idx long, before binary, after binary"))
    return found


def plain(text: str) -> str:
    """Text in which no part can be taken for a mark of the rendering."""
    return text.replace("<|", "< |").replace("|>", "| >")


def render(turns: list[tuple[int, list[str]]]) -> tuple[list[str], list[str], str]:
    """(roles, texts, canonical text) of (state, lines) turns."""
    roles, texts = [STATES[s] for s, _ in turns], ["\n".join(lines).strip() for _, lines in turns]
    return roles, texts, "".join(f"<|im_start|>{r}\n{plain(t)}<|im_end|>\n" for r, t in zip(roles, texts))


def format_turns(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", distinct: bool = True) -> DataFrame:
    """conv_id, turn, given_role, roles, texts and rendered for each row.

    A row gives one turn, or several where its text changes speaker; a row's ``rendered`` texts in order of turn are the
    conversation. Rows that are equal in all four columns count once in what is learnt and decoded; with ``distinct`` they also give
    one result, else as many as there are rows. Equal turns are ordered by role and text, a null turn comes
    last, rows of a null conversation are conversations of their own. A null or empty text is an empty line. Roles that are null or
    unknown are left to the model. An empty table gives no rows.
    """
    own = slim(rows, conv_id=conv_id, turn=turn, role=role, text=text)
    kinds = {f.name: f.dataType.simpleString() for f in own.schema}
    # conversations as longs, so that ids of any type work; a null one is named by its row
    own = own.withColumn("conv", F.when(F.col("conv_id").isNull(), F.xxhash64("turn", "role", "text", F.lit(1))).otherwise(F.xxhash64("conv_id")))
    # chunks by the turn's number, null turns in one of their own at the end
    own = own.withColumn("chunk", F.floor(F.coalesce(F.col("turn").cast("long"), F.lit(2**62)) / CHUNK))
    # equal rows are one row with their number, whatever files and batches they lie in
    dealt = stage(own.groupBy(*own.columns).agg(F.count(F.lit(1)).alias("n")))
    order = [F.col("conv"), F.col("chunk"), F.col("turn").asc_nulls_last(), F.col("role"), F.col("text")]
    together = lambda df: df.repartition("conv", "chunk").sortWithinPartitions(*order)
    model = learn(dealt)
    shared = rows.sparkSession.sparkContext.broadcast(model)

    sizes = dealt.select("conv", "chunk").distinct().groupBy("conv").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    long = stage(sizes)
    biggest = long.agg(F.max("n")).first()[0]
    framed = dealt.withColumn("before", F.lit(None).cast("binary")).withColumn("after", F.lit(None).cast("binary"))
    if biggest:
        parted = together(dealt.join(long.select("conv"), "conv", "left_semi"))

        def one(conv, chunk, table):
            lines = [x for r, t in zip(table.column("role").to_pylist(), table.column("text").to_pylist()) for x in lines_of(r, t)]
            yield {"conv": conv, "chunk": chunk, "scores": _pack(summary(shared.value, lines))}

        nodes = _chunks(parted, one, "conv long, chunk long, scores binary")
        # chunks without rows have no node: number those that are there
        numbered = stage(nodes)
        levels, reach = 0, biggest
        while reach > 1:
            levels, reach = levels + 1, -(-reach // FAN)
        ranked = _number(numbered)
        bounds = _boundaries(ranked.select("conv", "idx", "scores"), levels).join(ranked.select("conv", "idx", "chunk"), ["conv", "idx"]).select("conv", "chunk", "before", "after")
        framed = dealt.join(bounds, ["conv", "chunk"], "left")

    def turns(conv, chunk, table):
        rows = [table.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "n")]
        lines = [lines_of(r, t) for r, t in zip(rows[2], rows[3])]
        ends = [None if x is None else _matrix(x)[0] for x in (table.column("before")[0].as_py(), table.column("after")[0].as_py())]
        states = decode(shared.value, [x for one in lines for x in one], *ends)
        at = 0
        for conv_id, turn, role, n, own in zip(rows[0], rows[1], rows[2], rows[4], lines):
            spoken: list[tuple[int, list[str]]] = []
            for line, marker, _, _ in own:
                if spoken and spoken[-1][0] == states[at] and (marker < 0 or not spoken[-1][1]):
                    spoken[-1][1].append(line)
                else:
                    spoken.append((states[at], [line]))
                at += 1
            roles, texts, rendered = render(spoken)
            yield {"conv_id": conv_id, "turn": turn, "given_role": role, "roles": roles, "texts": texts, "rendered": rendered, "n": n}

    schema = f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, given_role string, roles array<string>, texts array<string>, rendered string"
    found = _chunks(together(framed), turns, schema + ", n long")
    return found.drop("n") if distinct else found.mapInArrow(_repeated, schema)


def _repeated(batches: Iterator[pa.RecordBatch], most: int = 256) -> Iterator[pa.RecordBatch]:
    """Each row ``n`` times, a few at once, without ``n``."""
    for batch in batches:
        ends = np.cumsum(batch.column("n").to_numpy())
        own = batch.select([c for c in batch.schema.names if c != "n"])
        if len(ends) and ends[-1] == len(ends):
            yield own
            continue
        for start in range(0, int(ends[-1]) if len(ends) else 0, most):
            yield own.take(pa.array(np.searchsorted(ends, np.arange(start, min(start + most, ends[-1])), side="right")))


def _number(nodes: DataFrame) -> DataFrame:
    """``idx``: gapless numbers of a conversation's chunks, counted by blocks of chunks so that no task holds a long conversation."""
    from pyspark.sql import Window

    blocked = nodes.withColumn("block", F.floor(F.col("chunk") / 10_000))
    counts = blocked.groupBy("conv", "block").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("conv", "block", F.coalesce(before, F.lit(0)).alias("earlier"))
    inside = F.row_number().over(Window.partitionBy("conv", "block").orderBy("chunk")) - 1
    return stage(blocked.withColumn("inside", inside).join(starts, ["conv", "block"]).select("conv", "chunk", (F.col("earlier") + F.col("inside")).cast("long").alias("idx"), *[c for c in nodes.columns if c not in ("conv", "chunk")]))
