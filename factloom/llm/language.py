"""Language ID: a bidirectional gated recurrent network over bytes, trained here by backpropagation through time.

Every text is cut into segments of STEPS bytes, all of which run side by side; each position gets a distribution over
the learned languages from the states of both directions, and a document's probabilities are the mean over all of its
positions. The network is fitted on a bounded sample: SAMPLE_ROWS rows with a language, SEGMENTS segments of each at
evenly spread places. Texts are scored whole, in Arrow batches, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from factloom.llm import words as W
from factloom.llm.shared import bounded_sample, bucket, table

SAMPLE_ROWS = 3000
SEGMENTS = 4
STEPS = 64
HIDDEN = 8
ROUNDS = 350
BATCH = 256
RATE = 0.02
UNKNOWN = "und"
_LETTERS = np.zeros(256, bool)
_LETTERS[0x41:0x5B] = _LETTERS[0x61:0x7B] = True
_PAD = 0x20
_SIDE = 4096


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return np.tanh(x * np.float32(0.5)) * np.float32(0.5) + np.float32(0.5)


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(-1, keepdims=True))
    return x / x.sum(-1, keepdims=True)


def _states(table_: np.ndarray, u: np.ndarray, x: np.ndarray, trace: list | None = None) -> np.ndarray:
    """Hidden states (steps, side, hidden) for bytes x (steps, side); trace gets what backpropagation needs."""
    n = u.shape[0]
    h = np.zeros((x.shape[1], n), np.float32)
    out = np.empty((*x.shape, n), np.float32)
    for t in range(len(x)):
        a, g = table_[x[t]], h @ u
        zr = _sigmoid(a[:, : 2 * n] + g[:, : 2 * n])
        z, r = zr[:, :n], zr[:, n:]
        c = np.tanh(a[:, 2 * n :] + r * g[:, 2 * n :])
        if trace is not None:
            trace.append((h, z, r, c, g[:, 2 * n :]))
        h = c + z * (h - c)
        out[t] = h
    return out


def _gradients(u: np.ndarray, trace: list, dout: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of u and of the inputs' rows (steps, side, 3 hidden)."""
    du, da = np.zeros_like(u), np.empty((*dout.shape[:2], u.shape[1]), np.float32)
    dh = np.zeros_like(dout[0])
    for t in range(len(dout) - 1, -1, -1):
        h, z, r, c, gc = trace[t]
        dh = dh + dout[t]
        dz = dh * (h - c) * z * (1 - z)
        dc = dh * (1 - z) * (1 - c * c)
        dr = dc * gc * r * (1 - r)
        da[t] = np.concatenate([dz, dr, dc], 1)
        dg = np.concatenate([dz, dr, dc * r], 1)
        du += h.T @ dg
        dh = dh * z + dg @ u.T
    return du, da


def positions(net: dict, x: np.ndarray) -> np.ndarray:
    """A distribution over the languages for every position of x (steps, side)."""
    f = _states(net["tf"], net["uf"], x)
    b = _states(net["tb"], net["ub"], x[::-1])[::-1]
    return _softmax(f @ net["of"] + b @ net["ob"] + net["bias"])


def train(x: np.ndarray, y: np.ndarray, kinds: int, rounds: int = ROUNDS, seed: int = 7) -> dict:
    """x: (segments, STEPS) bytes; y: their languages. Kinds weigh alike whatever their share."""
    rng = np.random.default_rng(seed)
    n = HIDDEN
    init = lambda *s: rng.normal(0, 0.3, s).astype(np.float32)
    net = {"tf": init(256, 3 * n), "tb": init(256, 3 * n), "uf": init(n, 3 * n), "ub": init(n, 3 * n), "of": init(n, kinds), "ob": init(n, kinds), "bias": np.zeros(kinds, np.float32)}
    net["tf"][:, :n] += 1  # keep more of the state at first
    net["tb"][:, :n] += 1
    m = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.items()}
    share = np.bincount(y, minlength=kinds)
    chance = (1 / np.maximum(share, 1))[y]
    chance = 0.5 * chance / chance.sum() + 0.5 / len(y)
    for i in range(rounds):
        at = rng.choice(len(y), BATCH, p=chance)
        xs, ys = x[at].T, y[at]
        tf, tb = [], []
        f = _states(net["tf"], net["uf"], xs, tf)
        b = _states(net["tb"], net["ub"], xs[::-1], tb)
        d = _softmax(f @ net["of"] + b[::-1] @ net["ob"] + net["bias"])
        d[:, np.arange(len(ys)), ys] -= 1
        d /= d.shape[0] * d.shape[1]
        flat = d.reshape(-1, kinds)
        grad = {"of": f.reshape(-1, n).T @ flat, "ob": b[::-1].reshape(-1, n).T @ flat, "bias": flat.sum(0)}
        grad["uf"], daf = _gradients(net["uf"], tf, d @ net["of"].T)
        grad["ub"], dab = _gradients(net["ub"], tb, (d @ net["ob"].T)[::-1])
        for k, da, order in (("tf", daf, xs), ("tb", dab, xs[::-1])):
            one = np.zeros((order.size, 256), np.float32)
            one[np.arange(order.size), order.ravel()] = 1
            grad[k] = one.T @ da.reshape(-1, 3 * n)
        rate = RATE * (1 - i / rounds) + 1e-4
        size = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
        for k, g in grad.items():
            g = g / max(1.0, size)
            a, v = m[k]
            a += 0.1 * (g - a)
            v += 0.01 * (g * g - v)
            net[k] -= rate * (a / (1 - 0.9 ** (i + 1))) / (np.sqrt(v / (1 - 0.99 ** (i + 1))) + 1e-8)
    return net


def pooled(net: dict, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Mean of the positions' probabilities for each row (rows, kinds); 0 for an empty one."""
    rows, kinds = len(offs) - 1, len(net["bias"])
    total = np.zeros((rows, kinds))
    low = W.LOWER[buf]
    n = -(-np.diff(offs) // STEPS)
    row = np.repeat(np.arange(rows), n)
    begin = offs[row] + STEPS * (np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n))
    left = np.minimum(STEPS, offs[row + 1] - begin)
    for k in range(0, len(row), _SIDE):
        b, l = begin[k : k + _SIDE], left[k : k + _SIDE]
        at = b + np.arange(STEPS)[:, None]
        valid = np.arange(STEPS)[:, None] < l
        x = np.where(valid, low[np.minimum(at, len(low) - 1)], _PAD)
        p = (positions(net, x) * valid[..., None]).sum(0)
        for j in range(kinds):
            total[:, j] += np.bincount(row[k : k + _SIDE], p[:, j], rows)
    return total / np.maximum(1, np.diff(offs))[:, None]


def fit(docs: DataFrame, learn: Column, rows: int = SAMPLE_ROWS) -> tuple[dict | None, list[str]]:
    """The network and its languages, from docs' text and lang where learn holds."""
    sample = bounded_sample(docs.filter(learn & F.col("lang").isNotNull() & (F.octet_length("text") > 0)).select("doc_id", "lang"), rows, "doc_id", "lang").distinct()
    texts = docs.select("doc_id", "text", "lang").join(F.broadcast(sample.select(F.col("doc_id").alias("id"), F.col("lang").alias("of"))), F.expr("doc_id = id AND lang = of")).select("text", "lang")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, out, names = batch.column("lang").to_pylist(), [], []
            for r0, _, buf, offs in W.slices(batch.column("text")):
                low = W.LOWER[buf].tobytes()
                for i in range(len(offs) - 1):
                    n = int(offs[i + 1] - offs[i])
                    for a in np.unique(np.linspace(0, max(0, n - STEPS), SEGMENTS).astype(int)).tolist():
                        out.append(low[offs[i] + a : min(offs[i + 1], offs[i] + a + STEPS)].ljust(STEPS))
                        names.append(langs[r0 + i])
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(out, pa.binary())], ["lang", "segment"])

    got = texts.mapInArrow(cut, "lang string, segment binary").toPandas()
    if got.empty:
        return None, []
    got = got.sort_values(["lang", "segment"], kind="stable")
    langs = sorted(set(got["lang"]))
    x = np.frombuffer(b"".join(map(bytes, got["segment"])), np.uint8).reshape(-1, STEPS)
    return train(x, np.searchsorted(langs, got["lang"].to_numpy().astype(str)), len(langs)), langs


def apply(docs: DataFrame, learn: Column, keep: list[str] | None = None) -> DataFrame:
    """docs' columns `keep` (default: all), lang_pred (string) and score (double), replacing any of these names.

    A null text, or one without a letter, is "und" with score 0, as is every text where no row can be learnt from.
    Equal probabilities go to the language that sorts first. Repeated rows get equal results.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("lang_pred", "score")]
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, learn))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, langs = model.value
        for batch in batches:
            for r0, r1, buf, offs in W.slices(batch.column("text"), 1 << 20):
                known = W.per_row(_LETTERS[buf], offs) > 0
                for i in np.flatnonzero(~known):
                    known[i] = any(c.isalpha() for c in buf[offs[i] : offs[i + 1]].tobytes().decode())
                if net is None:
                    known[:] = False
                p = pooled(net, buf, offs) if known.any() else np.zeros((r1 - r0, 1))
                best = p.argmax(1)
                yield pa.RecordBatch.from_arrays([*(batch.column(c)[r0:r1] for c in keep), pa.array([langs[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)], pa.string()), pa.array(np.where(known, np.minimum(1.0, p.max(1)), 0.0))], [*keep, "lang_pred", "score"])

    cols = list(dict.fromkeys([*keep, "text"]))
    schema = StructType([*docs.select(*keep).schema.fields, *StructType.fromDDL("lang_pred string, score double").fields])
    return docs.select(*cols).mapInArrow(predict, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    got = apply(docs, bucket("doc_id", 4) != 2, ["doc_id"])
    return got.select("doc_id", F.coalesce(bucket("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
