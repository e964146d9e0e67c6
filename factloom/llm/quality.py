"""Quality rules: a hashed word and character n-gram logistic regression, calibrated, against fixed thresholds.

The regression is fitted on a bounded sample of labelled rows (SAMPLE_ROWS, whole texts): executors turn each text
into hashed counts, the driver gets those sparse rows alone. Every text is then scored whole, in Arrow batches,
without a shuffle, beside exact rule counts. One fifth of the sample fits the calibration only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import words as W
from factloom.llm.shared import bounded_sample, table

SAMPLE_ROWS = 4000
BITS = 16
EPOCHS = 60
_TOGETHER = 250
#: Fixed thresholds: the least words, the most repeated words in a hundred, the least probability of good quality.
MIN_WORDS, MAX_REPEAT_PCT, MIN_QUALITY = 20, 30, 0.4
REPEAT_WINDOW = 8
SYMBOLS = np.zeros(256, bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True
SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, quality double, kept boolean"


def _sums(x: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Sum of x over each [start, end); a row's sum doesn't depend on its neighbours."""
    if not len(start):
        return np.zeros(0)
    end = np.maximum(start, end)
    at = np.stack([start, end], 1).ravel()
    return np.where(end > start, np.add.reduceat(np.append(x, 0.0), at)[::2], 0.0)


def _grams(buf: np.ndarray, offs: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(features, start, end by row) of word unigrams, word bigrams and byte trigrams, each hashed to BITS bits."""
    low = W.LOWER[buf]
    start, end, first = W.spans(low, offs, W.SPACED)
    h = W.word_hashes(low, start, end)
    shift = np.uint64(64 - BITS)
    out = [((h >> shift).astype(np.int64), first[:-1], first[1:])]
    out.append(((W.window_hashes(h, 2) >> shift).astype(np.int64), np.minimum(first[:-1], max(0, len(h) - 1)), first[1:] - 1))
    x = buf.astype(np.uint32)
    code = (x[:-2] | x[1:-1] << np.uint32(8) | x[2:] << np.uint32(16)) * np.uint32(0x9E3779B1) if len(x) > 2 else x[:0]
    out.append(((code >> np.uint32(32 - BITS)).astype(np.int64), np.minimum(offs[:-1], len(code)), offs[1:] - 2))
    return [(f + k * (1 << BITS), np.minimum(s, len(f)), np.clip(e, np.minimum(s, len(f)), len(f))) for k, (f, s, e) in enumerate(out)]


def _sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ys = batch.column("label").to_pylist()
        for r0, _, buf, offs in W.slices(batch.column("text")):
            grams = _grams(buf, offs)
            for i in range(len(offs) - 1):
                idx, val = [], []
                for f, s, e in grams:
                    if e[i] > s[i]:
                        u, n = np.unique(f[s[i] : e[i]], return_counts=True)
                        idx.append(u)
                        val.append(n / n.sum())
                idx = np.concatenate(idx) if idx else np.zeros(0, np.int64)
                val = np.concatenate(val) if val else np.zeros(0)
                yield pa.RecordBatch.from_pydict({"label": pa.array([ys[r0 + i]], pa.int32()), "idx": pa.array([idx.astype(np.int32)], pa.list_(pa.int32())), "val": pa.array([val.astype(np.float32)], pa.list_(pa.float32()))})


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> dict:
    """Weights, bias and calibration. Without labels of both kinds every text gets the smoothed share of label 1."""
    sample = bounded_sample(labels.filter("doc_id IS NOT NULL AND quality IN (0, 1)").select("doc_id", F.col("quality").cast("int").alias("label")).distinct(), rows, "doc_id", "label")
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("text", "label")
    got = texts.mapInArrow(_sparse, "label int, idx array<int>, val array<float>").toArrow()
    y = got["label"].to_numpy().astype(float)
    size = 3 << BITS
    prior = (y.sum() + 1) / (len(y) + 1) if len(y) else 1.0
    model = {"w": np.zeros(size, np.float32), "b": 0.0, "scale": 0.0, "shift": float(np.log(prior / max(1e-9, 1 - prior))) if prior < 1 else 35.0, "rows": len(y)}
    if len(set(y)) < 2:
        return model
    lens = pc.list_value_length(got["idx"]).to_numpy()
    idx = got["idx"].combine_chunks().flatten().to_numpy()
    val = got["val"].combine_chunks().flatten().to_numpy()
    del got
    W.release()
    bounds = np.append(0, np.cumsum(lens))
    #: Runs of rows that are worked on together, so that the driver holds the sparse rows and little else.
    parts = [(a, min(a + _TOGETHER, len(y))) for a in range(0, len(y), _TOGETHER)]
    inner = lambda w, a, b: _sums(w[idx[bounds[a] : bounds[b]]] * val[bounds[a] : bounds[b]], bounds[a:b] - bounds[a], bounds[a + 1 : b + 1] - bounds[a])
    content = np.concatenate([inner(np.arange(size, dtype=float), a, b) for a, b in parts])
    order = np.argsort(W.mix((1e3 * content + y).astype(np.uint64)), kind="stable")  # by content, not by place
    fold = np.zeros(len(y), bool)
    fold[order[::5]] = True
    weight = np.where(y == 1, 0.5 / max(1, y[~fold].sum()), 0.5 / max(1, (1 - y[~fold]).sum())) * (~fold)
    w, b, seen, seen_b = np.zeros(size), 0.0, np.full(size, 1e-8), 1e-8
    for _ in range(EPOCHS):
        gw, gb = 1e-5 * w, 0.0
        for i, j in parts:
            g = (_sigmoid(b + 50 * inner(w, i, j)) - y[i:j]) * weight[i:j]
            gw += 50 * np.bincount(idx[bounds[i] : bounds[j]], val[bounds[i] : bounds[j]] * np.repeat(g, lens[i:j]), size)
            gb += g.sum()
        seen += gw * gw
        seen_b += gb**2
        w -= 0.1 * gw / np.sqrt(seen)
        b -= 0.1 * gb / np.sqrt(seen_b)
    z = np.concatenate([b + 50 * inner(w, i, j) for i, j in parts])
    z1, y1 = (z[fold], y[fold]) if len(set(y[fold])) == 2 else (z, y)
    a, c = _platt(z1, y1)
    del idx, val, z
    W.release()  # the driver lives on
    return model | {"w": (50 * w).astype(np.float32), "b": float(b), "scale": float(a), "shift": float(c)}


def _platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of Platt's scaling, by Newton's method with halved steps."""
    t = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    spread = float(z.std()) or 1.0
    x = np.stack([z / spread, np.ones(len(z))], 1)
    loss = lambda v: float((np.logaddexp(0, x @ v) - t * (x @ v)).sum() + 1e-3 * (v @ v))
    v = np.zeros(2)
    for _ in range(100):
        p = _sigmoid(x @ v)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 2e-3 * np.eye(2), x.T @ (p - t) + 2e-3 * v)
        size = 1.0
        while size > 1e-6 and loss(v - size * step) > loss(v):
            size /= 2
        v = v - size * step
        if np.abs(size * step).max() < 1e-8:
            break
    return float(v[0] / spread), float(v[1])


def _repeated(text: bytes) -> int:
    """Words in windows that the text has twice or more, by comparing the words themselves."""
    ws = text.split()
    n, at = REPEAT_WINDOW, {}
    hit = np.zeros(len(ws), bool)
    for i in range(len(ws) - n + 1):
        key = b" ".join(ws[i : i + n])
        if (j := at.setdefault(key, i)) != i:
            hit[i : i + n] = hit[j : j + n] = True
    return int(hit.sum())


def measure(buf: np.ndarray, offs: np.ndarray, model: dict) -> dict[str, np.ndarray]:
    rows = len(offs) - 1
    start, end, first = W.spans(buf, offs, W.SPACED)
    out = {"n_words": np.diff(first), "word_chars": W.per_row(W.SPACED[buf] & ((buf & 0xC0) != 0x80), offs), "n_symbols": W.per_row(SYMBOLS[buf], offs)}
    dup, repeat = np.zeros(rows, np.int64), np.zeros(rows, np.int64)
    for i in np.flatnonzero(W.per_row(buf == 10, offs)):
        lines = [x for x in buf[offs[i] : offs[i + 1]].tobytes().split(b"\n") if x.strip()]
        dup[i] = len(lines) - len(set(lines))
    h = W.window_hashes(W.word_hashes(buf, start, end), REPEAT_WINDOW)
    row = W.rows_of(first)[: len(h)]
    key = W.mix(h ^ (row.astype(np.uint64) << np.uint64(40)))[W.whole_windows(first, REPEAT_WINDOW, len(start))]
    s = np.sort(key)
    if len(twice := s[1:][s[1:] == s[:-1]]):
        whole = row[W.whole_windows(first, REPEAT_WINDOW, len(start))]
        for i in np.unique(whole[np.isin(key, twice)]):
            repeat[i] = _repeated(buf[offs[i] : offs[i + 1]].tobytes())
    out |= {"n_dup_lines": dup, "n_repeat_words": repeat}
    z = np.full(rows, model["b"])
    if model["scale"]:
        for f, s, e in _grams(buf, offs):
            z += _sums(model["w"][f].astype(np.float64), s, e) / np.maximum(1, e - s)
    out["quality"] = _sigmoid(model["scale"] * z + model["shift"])
    out["base_failed"] = (out["n_words"] < MIN_WORDS) | (100 * repeat > MAX_REPEAT_PCT * out["n_words"])
    out["kept"] = ~out["base_failed"] & (out["quality"] >= MIN_QUALITY)
    return out


def apply(docs: DataFrame, labels: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """docs' columns `keep` (default: all) and the columns of SCHEMA, replacing any of the same name.

    A null text has no words and fails the rules; a null or repeated doc_id is scored as any other row. Without
    labels of both kinds only the counted rules decide.
    """
    spark = docs.sparkSession
    names = [n.split()[0] for n in SCHEMA.split(", ")]
    keep = [c for c in (docs.columns if keep is None else keep) if c not in names]
    model = spark.sparkContext.broadcast(fit(docs, labels))
    cols = [*keep, *(["text"] if "text" not in keep else [])]

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r0, r1, buf, offs in W.slices(batch.column("text")):
                got = measure(buf, offs, model.value)
                yield pa.RecordBatch.from_arrays([*(batch.column(c)[r0:r1] for c in keep), *(pa.array(got[n]) for n in names)], [*keep, *names])

    from pyspark.sql.types import StructType

    schema = StructType([*docs.select(*keep).schema.fields, *StructType.fromDDL(SCHEMA).fields])
    return docs.select(*cols).mapInArrow(scored, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ["doc_id"])


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return apply(docs, table(spark, sf_dir, "labels")).filter("kept").select(*docs.columns)
