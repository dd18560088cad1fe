"""Chat formatting: roles recovered from plain transcripts, then canonical rendering.

A hidden Markov model runs over the lines of a conversation, of which a row may hold one turn or
a whole transcript. A state is a role and whether the line opens a turn or goes on with it; what
is seen of a line is its speaker marker, whether it begins a row, its length, a closing question
mark, and whether it is the first. Emissions and transitions are counted on labelled
conversations, as they are and once more as transcripts with markers of which some are missing
and some wrong; so a marker is strong evidence but no proof. Viterbi finds the likeliest
states. Conversations are handled in blocks of BLOCK turn numbers: each block gives a matrix of
best scores between states, the matrices of a conversation are chained, and the blocks are then
decoded between the states so fixed. So the result is the exact best path, and no task holds a
whole long conversation.

Edge cases: null and empty texts are one empty line; every row opens a turn; rows with the same
turn come in the order of their texts; rows without a conversation or without a turn number stand
alone, each a conversation of its own; without labelled rows the smoothing decides, that is the
markers; a very long text is decoded by one task; tables without rows give none; other columns are
ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.llm.common import written

ROLES = ("system", "user", "assistant")
STATES = 2 * len(ROLES)  # role k: state 2k opens a turn, 2k + 1 goes on
BLOCK = 256
#: Speaker markers at the start of a line, by role (fixed values).
MARKERS = [
    regex.compile(r"\s*(?:<\|system\|>|\[system\]|#+\s*system|\**(?:system|instructions?)\**\s*[:>])\s*", regex.I),
    regex.compile(r"\s*(?:<\|user\|>|\[user\]|\[INST\]|#+\s*(?:user|human|question)|\**(?:user|human|customer|question|q|me)\**\s*[:>])\s*", regex.I),
    regex.compile(r"\s*(?:<\|assistant\|>|\[assistant\]|\[/INST\]|#+\s*(?:assistant|response|answer)|\**(?:assistant|ai|bot|agent|answer|a|model)\**\s*[:>])\s*", regex.I),
]
#: How many values each feature has: marker, place, length, question, first line.
WIDTHS = (len(ROLES) + 1, 3, 5, 2, 2)
#: A line's place: inside a transcript that is one row, at the beginning of a row, inside one of several rows.
INSIDE, BEGINS, WITHIN = range(3)
SMOOTHING, LEAST_SHARE = 0.5, 0.05
#: Of 20 openings of a made transcript, so many have the right marker, a wrong one and none.
RIGHT, WRONG, NONE = 14, 2, 4
MARKER_WEIGHT = 10  # how often these 20 count as smoothing


def marker_of(line: str) -> tuple[int, int]:
    """1 + the role that the line's marker names (0: none), and the marker's length."""
    for k, pattern in enumerate(MARKERS):
        if m := pattern.match(line):
            return k + 1, m.end()
    return 0, 0


def seen(line: str, place: int, first: bool) -> tuple[int, ...]:
    size = len(line.split())
    return marker_of(line)[0], place, 0 if size == 0 else 1 if size < 8 else 2 if size < 25 else 3 if size < 60 else 4, int(line.rstrip().endswith("?")), int(first)


def made_marker(conv: int, turn: int, role: int) -> int:
    """The marker (as marker_of gives it) of a turn in a made transcript: the role's own, another one or none."""
    draw = zlib.crc32(f"{conv}:{turn}".encode())
    place = draw % (RIGHT + WRONG + NONE)
    return role if place < RIGHT else 0 if place < RIGHT + NONE else (role - 1 + 1 + draw // 32 % (len(ROLES) - 1)) % len(ROLES) + 1


class RoleModel:
    """Log probabilities of emissions, starts and transitions."""

    def __init__(self, emitted: dict[tuple[int, int, int], float], opened: dict[int, float], followed: dict[tuple[int, int], float], lines: dict[int, tuple[float, float]]):
        self.emission = []
        for f, width in enumerate(WIDTHS):
            n = np.full((STATES, width), SMOOTHING)
            for (state, feature, value), c in emitted.items():
                if feature == f:
                    n[state, value] += c
            if f == 0:
                for k in range(len(ROLES)):
                    n[2 * k] += MARKER_WEIGHT * np.array([NONE, *(RIGHT if j == k else WRONG / 2 for j in range(len(ROLES)))])
                    n[2 * k + 1, 0] += MARKER_WEIGHT * (RIGHT + WRONG + NONE)
            if f == 1:
                n[1::2, BEGINS] = SMOOTHING * 1e-3  # a line that begins a row opens a turn
                n[::2, WITHIN] += 0.01 * n[::2].sum(axis=1)  # inside one of several rows only a marker opens one
            if f in (2, 3):  # length and question mark alone never outweigh a marker
                n += LEAST_SHARE * n.sum(axis=1, keepdims=True)
            if f == 4:
                n[1::2, 1] = SMOOTHING * 1e-3
            self.emission.append(np.log(n / n.sum(axis=1, keepdims=True)))
        start = np.array([opened.get(k, 0.0) + SMOOTHING for k in range(len(ROLES))])
        self.start = np.full(STATES, -1e9)
        self.start[::2] = np.log(start / start.sum())
        turn = np.array([[followed.get((a, b), 0.0) + SMOOTHING * (0.1 if a == b else 1) for b in range(len(ROLES))] for a in range(len(ROLES))])
        turn /= turn.sum(axis=1, keepdims=True)
        self.step = np.full((STATES, STATES), -1e9)
        for a in range(len(ROLES)):
            ends, goes = lines.get(a, (1.0, 1.0))
            stay = np.clip((goes + SMOOTHING) / (ends + goes + 2 * SMOOTHING), 0.05, 0.95)
            for s in (2 * a, 2 * a + 1):
                self.step[s, 2 * a + 1] = np.log(stay)
                self.step[s, ::2] = np.log((1 - stay) * turn[a])

    def emissions(self, features: np.ndarray) -> np.ndarray:
        """Lines x states."""
        return sum(self.emission[f][:, features[:, f]].T for f in range(len(WIDTHS)))

    def matrix(self, e: np.ndarray, first: bool) -> np.ndarray:
        """Best score from each state before these lines to each state at the last; the first block has one row for all."""
        m = np.full((STATES, STATES), -1e18)
        if first:
            m[:] = self.start + e[0]
        else:
            m = self.step + e[0]
        for row in e[1:]:
            m = (m[:, :, None] + self.step[None]).max(axis=1) + row
        return m

    def path(self, e: np.ndarray, before: int | None, last: int | None) -> np.ndarray:
        """The best states, after `before` (None: at the start) and with `last` at the end (None: any); the lower state of equals."""
        score = (self.start if before is None else self.step[before]) + e[0]
        back = np.zeros((len(e), STATES), int)
        for t in range(1, len(e)):
            total = score[:, None] + self.step
            back[t] = total.argmax(axis=0)
            score = total.max(axis=0) + e[t]
        s = int(score.argmax()) if last is None else last
        out = np.zeros(len(e), int)
        for t in range(len(e) - 1, -1, -1):
            out[t] = s
            s = int(back[t, s])
        return out


def fit_roles(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> RoleModel:
    """Count emissions and transitions over labelled rows; what comes to the driver is a fixed number of counts."""
    known = rows.select(F.col(conv_col).cast("long").alias("c"), F.col(turn_col).cast("long").alias("t"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.array_position(F.array(*map(F.lit, ROLES)), F.col(role_col)).cast("int").alias("role")).where("role > 0 and c is not null and t is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[str, int, int, int], int] = {}
        for batch in batches:
            for conv, turn, text, role in zip(batch.column("c").to_pylist(), batch.column("t").to_pylist(), batch.column("text").to_pylist(), batch.column("role").to_pylist()):
                lines = text.split("\n")
                made = made_marker(conv, turn, role)
                for k, line in enumerate(lines):
                    first, plain = k == 0 and turn == 0, seen(line, WITHIN if k else BEGINS, k == 0 and turn == 0)
                    in_text = (made if k == 0 else plain[0], BEGINS if first else INSIDE, *plain[2:])
                    for f, v in [*enumerate(plain), *enumerate(in_text)]:
                        key = ("e", 2 * (role - 1) + (k > 0), f, v)
                        counts[key] = counts.get(key, 0) + 1
                for key, n in ((("l", role - 1, 0, 0), 1), (("l", role - 1, 1, 0), len(lines) - 1), (("s", role - 1, 0, 0), int(turn == 0))):
                    counts[key] = counts.get(key, 0) + n
        keys = list(counts)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), *(pa.array([k[i] for k in keys], pa.int32()) for i in (1, 2, 3)), pa.array([counts[k] for k in keys], pa.int64())], names=["kind", "a", "b", "d", "n"])

    own = known.mapInArrow(run, "kind string, a int, b int, d int, n long")
    pairs = known.alias("x").join(known.alias("y"), (F.col("x.c") == F.col("y.c")) & (F.col("x.t") + 1 == F.col("y.t"))).groupBy(F.lit("t").alias("kind"), (F.col("x.role") - 1).alias("a"), (F.col("y.role") - 1).alias("b"), F.lit(0).alias("d")).agg(F.count("*").alias("n"))
    got = own.union(pairs).groupBy("kind", "a", "b", "d").agg(F.sum("n").alias("n")).collect()
    pick = lambda kind: {(r["a"], r["b"], r["d"]): float(r["n"]) for r in got if r["kind"] == kind}
    lines = pick("l")
    return RoleModel(pick("e"), {a: n for (a, _, _), n in pick("s").items()}, {(a, b): n for (a, b, _), n in pick("t").items()}, {a: (lines.get((a, 0, 0), 0.0), lines.get((a, 1, 0), 0.0)) for a in range(len(ROLES))})


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """Rows of one conversation and block after another; they come sorted. Rows that stand alone have no block."""
    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and (row["block"] is None or (held[-1]["c"], held[-1]["block"]) != (row["c"], row["block"])):
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _lines(rows: list[dict], first: bool, several: bool) -> tuple[list[tuple[int, str]], np.ndarray]:
    lines = [(k, line) for k, r in enumerate(rows) for line in r["text"].split("\n")]
    inside = WITHIN if several else INSIDE
    return lines, np.array([seen(line, BEGINS if i == 0 or lines[i - 1][0] != k else inside, first and i == 0) for i, (k, line) in enumerate(lines)])


def parse_transcripts(spark: SparkSession, rows: DataFrame, model: RoleModel, conv_col: str = "conv_id", turn_col: str = "turn", text_col: str = "text") -> DataFrame:
    """conv_id, turn, part, role, content: each recovered turn. A row of the input gives one part or more."""
    base = rows.select(F.col(conv_col).cast("long").alias("c"), F.col(turn_col).cast("long").alias("t"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    base = base.withColumn("block", F.when(F.col("c").isNotNull(), F.floor(F.col("t") / BLOCK)))
    spans = base.where("block is not null").groupBy("c", "block").agg(F.lit(1)).groupBy("c").agg(F.min("block").alias("low"), F.max("block").alias("high"))
    many = written(spans.where("low < high").select("c", "low"), spark, "chat-long")

    def dealt(df: DataFrame) -> DataFrame:
        alone = F.when(F.col("block").isNull(), F.xxhash64("text", "c"))  # these needn't meet
        return df.withColumn("alone", alone).repartition("c", "block", "alone").sortWithinPartitions("c", "block", "t", "text")

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches):
            first = group[0]["block"] == group[0]["low"]
            m = model.matrix(model.emissions(_lines(group, first, True)[1]), first)
            yield pa.RecordBatch.from_arrays([pa.array([group[0]["c"]], pa.int64()), pa.array([group[0]["block"]], pa.int64()), pa.array([m.ravel().tolist()], pa.list_(pa.float64()))], names=["c", "block", "m"])

    def chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each block of a conversation, the state before it and the state at its end."""

        def done(blocks: list[int], ms: list[np.ndarray], c: int | None) -> pa.RecordBatch:
            score, back = ms[0][0], []
            for m in ms[1:]:
                total = score[:, None] + m
                back.append(total.argmax(axis=0))
                score = total.max(axis=0)
            last = [int(score.argmax())]
            for b in reversed(back):
                last.append(int(b[last[-1]]))
            last = last[::-1]
            return pa.RecordBatch.from_arrays([pa.array([c] * len(blocks), pa.int64()), pa.array(blocks, pa.int64()), pa.array([-1, *last[:-1]], pa.int32()), pa.array(last, pa.int32())], names=["c", "block", "before", "last"])

        held: tuple[list[int], list[np.ndarray], int | None] | None = None
        for batch in batches:
            for r in batch.to_pylist():
                if held is not None and held[2] != r["c"]:
                    yield done(*held)
                    held = None
                held = held or ([], [], r["c"])
                held[0].append(r["block"])
                held[1].append(np.array(r["m"]).reshape(STATES, STATES))
        if held is not None:
            yield done(*held)

    long_rows = base.join(many, "c").where("block is not null").select("c", "t", "text", "block", "low")
    scores = dealt(long_rows).mapInArrow(matrices, "c long, block long, m array<double>")
    fixed = written(scores.repartition("c").sortWithinPartitions("c", "block").mapInArrow(chained, "c long, block long, before int, last int"), spark, "chat-chained")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches):
            before, last = group[0]["before"], group[0]["last"]
            first = before is None or before < 0
            lines, features = _lines(group, first, before is not None or len(group) > 1)
            states = model.path(model.emissions(features), None if first else before, last)
            out: list[list] = []
            for (k, line), s in zip(lines, states.tolist()):
                cut = marker_of(line)[1] if s % 2 == 0 else 0
                if out and out[-1][0] == k and s % 2 == 1:
                    out[-1][3].append(line)
                else:
                    out.append([k, out[-1][1] + 1 if out and out[-1][0] == k else 0, ROLES[s // 2], [line[cut:]]])
            yield pa.RecordBatch.from_arrays([pa.array([group[0]["c"]] * len(out), pa.int64()), pa.array([group[o[0]]["t"] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int32()), pa.array([o[2] for o in out], pa.string()), pa.array(["\n".join(o[3]).strip() for o in out], pa.string())], names=["conv_id", "turn", "part", "role", "content"])

    return dealt(base.join(fixed, ["c", "block"], "left").select("c", "t", "text", "block", "before", "last")).mapInArrow(decode, "conv_id long, turn long, part int, role string, content string")


def rendered(turns: DataFrame) -> DataFrame:
    """turns with `rendered`: the canonical form of each turn. A "<|" of the content becomes "<||", so that no content passes for a marker; "<||" back to "<|" restores it."""
    content = F.replace("content", F.lit("<|"), F.lit("<||"))
    return turns.withColumn("rendered", F.concat(F.lit("<|"), F.col("role"), F.lit("|>\n"), content, F.lit("\n<|end|>\n")))
