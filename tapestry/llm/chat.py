"""Chat formatting: transcript lines to roles by a hidden Markov model.

The hidden state of a line is its speaker's role.  A text may hold a whole
transcript: a speaker marker at a line's front ("User:", "Assistant >",
"### System:", ...) opens a turn, and the lines after it without a marker are of
the same speaker (within a text the state changes at markers only), so such a
run of lines is one step of the model.  What is seen of a run are its marker,
its length and whether its first line asks a question; transitions say which
role follows which, with one table to the next run of a text and another to the
next text.  The model is counted from texts whose role is known: it is their
first run's, and their later runs are of the role that the marker names.  The
roles of a transcript are the most likely path (Viterbi), and each run is then
rendered as a turn in a canonical form.

A conversation may hold any number of runs, so no conversation is decoded in
one task: it is cut into pieces of ``PIECE`` runs.  A piece first gives its
max-plus transfer matrix (the best score from any role before it to any role at
its end), the few matrices of a conversation give the roles at the pieces'
borders, and each piece is then decoded between its borders.  That is the exact
Viterbi path.  Border rows are ROLES * ROLES numbers for PIECE runs.

Edge cases: NULL texts are empty lines; blank lines in front of a text's first
marker open no turn; NULL roles do not train; rows are ordered by (turn, text
hash), so repeated turns follow one another; rows with a NULL conversation are
one conversation of their own key; ties go to the first role in ``ROLES``; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapestry.llm.common import stage

ROLES = ("system", "user", "assistant")
#: Speaker names that mark a line, by role.
NAMES = {"system": ("system", "instruction", "instructions"), "user": ("user", "human", "customer", "question", "q"), "assistant": ("assistant", "bot", "ai", "agent", "answer", "a")}
FRONT = r"(?:#{1,4}[^\S\n]*|<\|?|\[|\*\*)?(" + "|".join(sorted((n for v in NAMES.values() for n in v), key=len, reverse=True)) + r")(?:\|?>|\]|\*\*)?[^\S\n]*(?::|>|-)"
MARKER = re.compile(r"^\s*" + FRONT + r"\s*", re.IGNORECASE)
#: The end of a line before one that a marker opens.
BREAK = re.compile(r"\n(?=[^\S\n]*" + FRONT + ")", re.IGNORECASE)
ROLE_OF = {n: r for r, v in NAMES.items() for n in v}
PIECE = 512
MARKED, PLAIN = 0.98, 1e-3
LENGTHS = (40, 80, 160, 320, 640, 1280)
#: Share of even odds in the steps inside a text, so that a marker outweighs them.
EVEN = 0.1


def runs_of(text: str | None) -> list[str]:
    """A text's lines, cut before each line that a marker opens."""
    text = text or ""
    front = len(text) - len(text.lstrip())
    cuts = [m.start() for m in BREAK.finditer(text) if m.start() > front]
    return [text[a:b] for a, b in zip([0, *(c + 1 for c in cuts)], [*cuts, len(text)], strict=True)]


def signs_of(text: str | None) -> tuple[str | None, int]:
    """(role that a marker names, feature class of the rest)."""
    text = text or ""
    m = MARKER.match(text)
    body = text[m.end() :] if m else text
    first = body.split("\n", 1)[0]
    size = sum(len(body) > n for n in LENGTHS)
    return (ROLE_OF[m.group(1).lower()] if m else None), size * 2 + ("?" in first)


FEATURES = 2 * (len(LENGTHS) + 1)


class Model:
    """Log probabilities: start, step[from, to] to the next text, line[from, to]
    to the next run of a text, and seen[role, feature]."""

    def __init__(self, start: np.ndarray, step: np.ndarray, seen: np.ndarray, line: np.ndarray | None = None):
        norm = lambda x: np.log((x + 0.5) / (x + 0.5).sum(axis=-1, keepdims=True))
        self.start, self.step, self.seen = norm(start), norm(step), norm(seen)
        line = np.zeros_like(step) if line is None else line
        self.line = np.log((1 - EVEN) * np.exp(norm(line)) + EVEN / len(ROLES))

    def emit(self, texts: list[str | None]) -> np.ndarray:
        """Log likelihood of each text under each role."""
        out = np.empty((len(texts), len(ROLES)))
        for i, t in enumerate(texts):
            named, feature = signs_of(t)
            out[i] = self.seen[:, feature]
            if named:
                out[i] += [math.log(MARKED if r == named else PLAIN) for r in ROLES]
        return out

    def steps(self, inside: np.ndarray) -> np.ndarray:
        """[run, from, to]: the transitions to runs that are ``inside`` a text or
        open one."""
        return np.where(inside[:, None, None], self.line, self.step)

    def transfer(self, emit: np.ndarray, inside: np.ndarray) -> np.ndarray:
        """[from, to]: the best score of the piece's runs after role ``from``
        that ends in role ``to``."""
        steps = self.steps(inside)
        out = steps[0] + emit[0]
        for e, step in zip(emit[1:], steps[1:], strict=True):
            out = (out[:, :, None] + step[None]).max(axis=1) + e
        return out

    def path(self, emit: np.ndarray, inside: np.ndarray, before: int, last: int) -> list[int]:
        """The best roles of a piece between the role before it (-1: it begins
        the conversation) and the role it ends in."""
        steps = self.steps(inside)
        score, back = (self.start if before < 0 else steps[0][before]) + emit[0], []
        for e, step in zip(emit[1:], steps[1:], strict=True):
            ways = score[:, None] + step
            back.append(ways.argmax(axis=0))
            score = ways.max(axis=0) + e
        roles = [last]
        for b in reversed(back):
            roles.append(int(b[roles[-1]]))
        return roles[::-1]


def learn(rows: DataFrame) -> Model:
    """Count starts, steps and features over the runs of texts with a known role
    (as ``run_rows`` gives them).  Steps are read from (conversation, turn)
    neighbours by a join, not by gathering a conversation."""
    runs = rows.where(F.col("role").isin(*ROLES))
    known = runs.where("run = 0").select("conv", "turn", "role", "ends")

    def classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen = [signs_of(t)[1] for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("said"), pa.array(seen, pa.int32())], names=["said", "feature"])

    number = {r: k for k, r in enumerate(ROLES)}
    n = len(ROLES)
    start, step, line, seen = np.zeros(n), np.zeros((n, n)), np.zeros((n, n)), np.zeros((n, FEATURES))
    texts = runs.select("said", "text").mapInArrow(classes, "said string, feature int")
    for r, f, k in texts.groupBy("said", "feature").count().collect():
        seen[number[r], f] += k
    for a, b, k in runs.where("run > 0").groupBy("after", "said").count().collect():
        line[number[a], number[b]] += k
    after = known.select("conv", (F.col("turn") - 1).alias("turn"), F.col("role").alias("next"))
    for a, b, k in known.join(after, ["conv", "turn"]).groupBy("ends", "next").count().collect():
        step[number[a], number[b]] += k
    first = rows.groupBy("conv").agg(F.min("turn").alias("turn"))
    for r, k in known.join(first, ["conv", "turn"]).groupBy("role").count().collect():
        start[number[r]] += k
    return Model(start, step, seen, line)


def borders(pieces: DataFrame, model: Model) -> DataFrame:
    """(conv, piece, before, last): the best path's role before each piece (-1
    for the first) and at its end.  A conversation's matrices, one for PIECE
    turns, are walked in order."""

    def walk(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("piece").to_numpy())
        n = len(ROLES)
        grids = [np.frombuffer(table.column("matrix")[int(i)].as_buffer(), "<f8").reshape(n + 1, n) for i in order]
        score, back = grids[0][n], []  # row n: the piece begins the conversation
        for g in grids[1:]:
            ways = score[:, None] + g[:n]
            back.append(ways.argmax(axis=0))
            score = ways.max(axis=0)
        last = [int(score.argmax())]
        for b in reversed(back):
            last.append(int(b[last[-1]]))
        last = last[::-1]
        return pa.table({
            "conv": table.column("conv").take(pa.array(order)), "piece": table.column("piece").take(pa.array(order)),
            "before": pa.array([-1, *last[:-1]], pa.int32()), "last": pa.array(last, pa.int32()),
        })

    return pieces.groupBy("conv").applyInArrow(walk, "conv long, piece int, before int, last int")


def ordered(table: pa.Table) -> pa.Table:
    return table.sort_by([("at", "ascending")])


def render(role: str, text: str | None) -> str:
    """A turn in canonical form, without the marker it had."""
    text = text or ""
    m = MARKER.match(text)
    return f"<|{role}|>\n{(text[m.end() :] if m else text).strip()}\n<|end|>"


def format_chats(conversations: DataFrame, model: Model | None = None, piece: int = PIECE) -> DataFrame:
    """One row per turn that the texts hold: conv_id, turn (of its text), at (its
    place in the conversation), role (recovered from the lines alone),
    given_role and rendered."""
    turns = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.coalesce(F.col("conv_id").cast("long"), F.lit(-(1 << 62))).alias("conv"),
        F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"),
    )
    rows = run_rows(turns).withColumn("piece", F.floor(F.col("at") / piece).cast("int"))
    rows = stage(rows, "turns")
    model = model or learn(rows)
    rows = rows.drop("said", "after", "ends")

    def inside(table: pa.Table) -> np.ndarray:
        return table.column("run").to_numpy() > 0

    def transfer(table: pa.Table) -> pa.Table:
        table = ordered(table)
        emit = model.emit(table.column("text").to_pylist())
        began = model.start + emit[0]
        for e, step in zip(emit[1:], model.steps(inside(table))[1:], strict=True):
            began = (began[:, None] + step).max(axis=0) + e
        matrix = np.vstack([model.transfer(emit, inside(table)), began]).astype("<f8").tobytes()
        return pa.table({"conv": table.column("conv")[:1], "piece": table.column("piece")[:1], "matrix": pa.array([matrix], pa.binary())})

    def decode(table: pa.Table, border: pa.Table) -> pa.Table:
        table = ordered(table)
        texts = table.column("text").to_pylist()
        before, last = border.column("before")[0].as_py(), border.column("last")[0].as_py()
        roles = [ROLES[k] for k in model.path(model.emit(texts), inside(table), before, last)]
        return pa.table({
            "conv_id": table.column("conv_id"), "turn": table.column("turn"), "at": table.column("at"), "role": roles, "given_role": table.column("role"),
            "rendered": [render(r, t) for r, t in zip(roles, texts, strict=True)],
        })

    keys = ("conv", "piece")
    grids = rows.groupBy(*keys).applyInArrow(transfer, "conv long, piece int, matrix binary")
    out = "conv_id long, turn long, at long, role string, given_role string, rendered string"
    return rows.groupBy(*keys).cogroup(borders(grids, model).groupBy(*keys)).applyInArrow(decode, out)


def run_rows(turns: DataFrame) -> DataFrame:
    """One row per run of a text's lines: conv_id, conv, turn, role (of the text),
    run (its number in the text), text, at (its place in the conversation), and
    for training said (the run's role by the text's role and the markers), after
    (the same of the run before it) and ends (of the text's last run)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            runs = [runs_of(t) for t in b.column("text").to_pylist()]
            named = [[r, *(signs_of(x)[0] for x in x[1:])] for r, x in zip(b.column("role").to_pylist(), runs, strict=True)]
            new = [pa.array(runs, pa.list_(pa.string())), pa.array(named, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), *new], names=[*kept, "runs", "named"])

    kept = ("conv_id", "conv", "turn", "role", "tie")
    rows = turns.withColumn("tie", F.xxhash64("text")).mapInArrow(cut, "conv_id long, conv long, turn long, role string, tie long, runs array<string>, named array<string>")
    rows = numbered(rows.withColumn("n", F.size("runs")))
    rows = rows.select("conv_id", "conv", "turn", "role", "named", "at", F.posexplode("runs").alias("run", "text"))
    return rows.select(
        "conv_id", "conv", "turn", "role", "run", "text", (F.col("at") + F.col("run")).alias("at"),
        F.get("named", F.col("run")).alias("said"), F.get("named", F.col("run") - 1).alias("after"), F.get("named", F.size("named") - 1).alias("ends"),
    )


def numbered(rows: DataFrame) -> DataFrame:
    """Add ``at``, the place of a row's first run in its conversation, without
    gathering one: the runs (``n`` of a row) are counted by (conversation, span
    of turn numbers) first, and only those counts are summed along a
    conversation."""
    from pyspark.sql import Window

    span = F.floor(F.coalesce("turn", F.lit(-1)) / PIECE)
    rows = rows.withColumn("span", span)
    counts = rows.groupBy("conv", "span").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("conv").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("conv", "span", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("before"))
    within = Window.partitionBy("conv", "span").orderBy("turn", "tie", "role").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("k", F.coalesce(F.sum("n").over(within), F.lit(0))).join(before, ["conv", "span"]).withColumn("at", F.col("before") + F.col("k")).drop("span", "k", "before", "tie")
