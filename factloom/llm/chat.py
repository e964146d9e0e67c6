"""Chat formatting: transcripts to canonical turns, roles by Viterbi over a hidden Markov model.

A row is a piece of a transcript: its conversation, its place (turn), a speaker's label (role) if there is one, and
text. Lines that open with a speaker marker start a new unit. A unit's features are its marker, else the row's label,
its length, lines, question marks and whether it opens the transcript; their likelihoods are counted over all labelled
rows. Viterbi's best sequence of roles then decides, so a missing, unknown or odd label is filled from its neighbours.

Rows meet by conversation and block of SPAN turns. Where a conversation has more blocks, each is first reduced to its
max-plus matrix (the best score from any role before it to any role at its end), the matrices of a conversation give
the roles at the blocks' borders, and the blocks are decoded on their own: the result is that of one sequence, though
no task holds more than a block.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type
from pyspark.sql.types import StructType

from factloom.llm.shared import table

ROLES = ("system", "user", "assistant")
SPAN = 1024
#: Names of speakers, by role.
NAMES = {"system": ("system", "instructions", "context"), "user": ("user", "human", "customer", "question", "q", "prompter"), "assistant": ("assistant", "ai", "bot", "gpt", "model", "answer", "a", "agent")}
_OF = {n: r for r, ns in enumerate(NAMES[x] for x in ROLES) for n in ns}
_MARKER = re.compile(r"^[ \t]*(?:<\|(?:im_start\|>)?(?P<a>\w+)(?:\|>)?[ \t]*$|\[(?P<b>\w+)\][ \t]*:?|#{2,4}[ \t]*(?P<c>\w+)[ \t]*:|\**(?P<d>\w+)\**[ \t]*:)[ \t]*\n?", re.I | re.M)
_TURN = np.log(np.array([[0.05, 0.9, 0.05], [0.01, 0.09, 0.9], [0.01, 0.9, 0.09]]))
_FIRST = np.log(np.array([0.15, 0.8, 0.05]))
_SURE = np.log(np.array([0.02, 0.96]))


def units(label: str | None, text: str | None) -> list[tuple[int, str]]:
    """(role that a marker or the label names, or -1; text without the marker); one at least."""
    text = text or ""
    named = _OF.get((label or "").strip().lower(), -1)
    out, at = [], 0
    for m in _MARKER.finditer(text):
        role = _OF.get((m["a"] or m["b"] or m["c"] or m["d"]).lower(), -1)
        if role >= 0:
            if text[at : m.start()].strip():
                out.append((named, text[at : m.start()]))
            named, at = role, m.end()
    return [*out, (named, text[at:])]


def features(text: str, opens: bool) -> tuple[int, int, int, int]:
    return min(12, len(text).bit_length()), min(4, text.count("\n")), min(1, text.count("?")), int(opens)


_SIZES = (13, 5, 2, 2)


def likelihoods(rows: DataFrame) -> list[np.ndarray]:
    """Logarithms of each feature's share by role, over all rows whose label names a role."""
    role = F.create_map(*(F.lit(x) for pair in _OF.items() for x in pair))[F.lower(F.trim("role"))]
    text = F.coalesce("text", F.lit(""))
    size = F.least(F.lit(12), F.when(F.length(text) == 0, 0).otherwise(F.floor(F.log2(F.length(text)) + 1e-9) + 1).cast("int"))
    lines = F.least(F.lit(4), F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))))
    counted = rows.select(role.alias("r"), size.alias("f0"), lines.alias("f1"), text.contains("?").cast("int").alias("f2"), (F.coalesce("turn", F.lit(1)) == 0).cast("int").alias("f3")).filter("r IS NOT NULL").groupBy("r", "f0", "f1", "f2", "f3").count()
    out = [np.ones((3, k)) for k in _SIZES]
    for r in counted.collect():
        for k in range(4):
            out[k][r.r, r[f"f{k}"]] += r["count"]
    return [np.log(x / x.sum(1, keepdims=True)) for x in out]


def emission(role: int, text: str, opens: bool, shares: list[np.ndarray]) -> np.ndarray:
    e = sum(s[:, f] for s, f in zip(shares, features(text, opens), strict=True)) * 0.5
    if role >= 0:
        e = e + np.where(np.arange(3) == role, *_SURE[::-1])
    return e


def viterbi(e: np.ndarray, before: np.ndarray, after: int | None = None) -> list[int]:
    """Best roles for emissions e, given scores of the first role, and the last role if it is known."""
    score, back = before + e[0], []
    for x in e[1:]:
        via = score[:, None] + _TURN
        back.append(via.argmax(0))
        score = via.max(0) + x
    path = [int(score.argmax()) if after is None else after]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1]


def matrix(e: np.ndarray) -> np.ndarray:
    """Best scores of the block from each role just before it to each role at its end."""
    m = _TURN + e[0]
    for x in e[1:]:
        m = (m[:, :, None] + _TURN[None]).max(1) + x
    return m


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[dict]]]:
    """Runs of rows with equal conversation and block."""
    key, held = None, []
    for batch in batches:
        for r in batch.to_pylist():
            k = (r["conv_id"], r["__block"])
            if held and k != key:
                yield key, held
                held = []
            key = k
            held.append(r)
    if held:
        yield key, held


def _emissions(rows: list[dict], shares: list[np.ndarray], opens: bool) -> tuple[list[list[tuple[int, str]]], np.ndarray]:
    us = [units(r["role"], r["text"]) for r in rows]
    flat = [(i, j, u) for i, x in enumerate(us) for j, u in enumerate(x)]
    return us, np.array([emission(role, text, opens and i == j == 0, shares) for i, j, (role, text) in flat])


def render(role: str, text: str) -> str:
    return f"<|{role}|>\n{text.strip()}\n<|end|>\n"


def format_turns(rows: DataFrame, span: int = SPAN) -> DataFrame:
    """(conv_id, turn, part, role, text, rendered): every row's turns. Neighbouring units of a row and role are one.

    Rows follow by turn (null last), then label and text; a repeated row is a turn of its own. A null or empty text is
    an empty turn; rows without a conv_id are one conversation. Other columns don't matter.
    """
    spark = rows.sparkSession
    rows = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    shares = spark.sparkContext.broadcast(likelihoods(rows))
    keyed = rows.withColumn("__block", F.coalesce(F.floor(F.col("turn") / span), F.lit((1 << 62))).cast("long"))
    ends = keyed.agg(F.min("__block"), F.max("__block")).first()
    one = ends[0] == ends[1]
    dealt = keyed.repartition("conv_id", "__block").sortWithinPartitions("conv_id", "__block", F.col("turn").asc_nulls_last(), "role", "text")
    if not one:
        field = pa.field("conv_id", to_arrow_type(rows.schema["conv_id"].dataType))

        def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for (conv, block), held in _groups(batches):
                _, e = _emissions(held, shares.value, False)
                _, f = _emissions(held, shares.value, True)
                opening = np.concatenate([f[:1], e[1:]])
                score = _FIRST + opening[0]
                for x in opening[1:]:
                    score = (score[:, None] + _TURN).max(0) + x
                yield pa.RecordBatch.from_pylist([{"conv_id": conv, "__block": block, "m": matrix(e).ravel().tolist(), "start": score.tolist()}], pa.schema([field, ("__block", pa.int64()), ("m", pa.list_(pa.float64())), ("start", pa.list_(pa.float64()))]))

        def borders(frame: pd.DataFrame) -> pd.DataFrame:
            frame = frame.sort_values("__block")
            score, back = np.array(frame["start"].iloc[0]), []
            for m in frame["m"].iloc[1:]:
                via = score[:, None] + np.array(m).reshape(3, 3)
                back.append(via.argmax(0))
                score = via.max(0)
            path = [int(score.argmax())]
            for b in reversed(back):
                path.append(int(b[path[-1]]))
            path = path[::-1]
            return pd.DataFrame({"conv_id": frame["conv_id"], "__block": frame["__block"], "__in": [-1, *path[:-1]], "__out": path})

        small = StructType([*rows.select("conv_id").schema.fields, *StructType.fromDDL("__block long, m array<double>, start array<double>").fields])
        out = StructType([*rows.select("conv_id").schema.fields, *StructType.fromDDL("__block long, __in int, __out int").fields])
        found = dealt.mapInArrow(reduce, small).groupBy("conv_id").applyInPandas(borders, out)
        found = found.withColumnRenamed("conv_id", "__c").withColumnRenamed("__block", "__b")
        keyed = keyed.join(found, F.col("conv_id").eqNullSafe(F.col("__c")) & (F.col("__block") == F.col("__b"))).drop("__c", "__b")
        dealt = keyed.repartition("conv_id", "__block").sortWithinPartitions("conv_id", "__block", F.col("turn").asc_nulls_last(), "role", "text")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for _, held in _groups(batches):
            enter, leave = (-1, None) if one else (held[0]["__in"], held[0]["__out"])
            us, e = _emissions(held, shares.value, enter < 0)
            roles = iter(viterbi(e, _FIRST if enter < 0 else _TURN[enter], leave))
            for r, parts in zip(held, us, strict=True):
                turns: list[list] = []
                for _, text in parts:
                    role = ROLES[next(roles)]
                    if turns and turns[-1][0] == role:
                        turns[-1][1] += "\n" + text
                    else:
                        turns.append([role, text])
                out += [{"conv_id": r["conv_id"], "turn": r["turn"], "part": k, "role": role, "text": text.strip(), "rendered": render(role, text)} for k, (role, text) in enumerate(turns)]
            if len(out) > 2000:
                yield pa.RecordBatch.from_pylist(out, schema)
                out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    result = StructType([*rows.select("conv_id").schema.fields, *StructType.fromDDL("turn long, part int, role string, text string, rendered string").fields])
    schema = to_arrow_schema(result)
    return dealt.mapInArrow(decode, result)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_turns(table(spark, sf_dir, "conversations"))
