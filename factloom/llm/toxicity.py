"""Toxicity: exact nearest labelled examples by TF-IDF cosine, from a block-max inverted index.

The index holds a bounded sample of labelled rows (EXAMPLES), and its vocabulary is all of their words. A vector is
(1 + ln tf) * idf over these, times 1 + chi-square of the term and the label over the examples, so that a text's length
or subject doesn't drown the few terms that go with the label; no term is left out. Words that no example has don't weigh. A
query visits the blocks of examples in the order of their upper bounds, sums of its weights times each term's greatest
weight in the block, and stops where no bound reaches the k-th best cosine: the neighbours are exactly those of a full
scan. Votes weigh by cosine and are calibrated on the examples, each asked without itself. A text without any word of
the examples has no neighbour and gets the smoothed share of its like. Words count as equal if their 64-bit hashes are.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from factloom.llm import words as W
from factloom.llm.quality import _platt, _sigmoid
from factloom.llm.shared import bounded_sample, bucket, table

EXAMPLES = 4000
NEIGHBOURS = 15
BLOCK = 64
#: Terms of a text that are returned.
SHOWN = 10
THRESHOLD = 0.7
#: Blocks of a query's first visit; each further visit takes twice as many.
_VISIT = 8


class Index:
    """Postings by term, in the order of examples. Those of one term in one block of BLOCK examples are a run, with their greatest weight."""

    def __init__(self, vectors: Iterable[tuple[np.ndarray, np.ndarray] | dict[int, float]], terms: int) -> None:
        """vectors: by example its terms and weights."""
        got = [_pair(v) for v in vectors]
        self.size = len(got)
        self.blocks = -(-self.size // BLOCK)
        term = np.concatenate([t for t, _ in got] or [np.empty(0, np.int64)])
        example = np.repeat(np.arange(self.size), [len(t) for t, _ in got])
        order = np.argsort(term, kind="stable")
        self.ids, self.weights = example[order], np.concatenate([w for _, w in got] or [np.empty(0)])[order]
        run = term[order] * max(1, self.blocks) + self.ids // BLOCK
        self.start = np.append(np.flatnonzero(np.diff(run, prepend=-1)), len(run))
        run = run[self.start[:-1]]
        self.block = (run % max(1, self.blocks)).astype(np.int32)
        self.most = np.maximum.reduceat(self.weights, self.start[:-1]) if len(run) else np.empty(0)
        self.first = np.searchsorted(run // max(1, self.blocks), np.arange(terms + 1))

    def nearest(self, q: tuple[np.ndarray, np.ndarray] | dict[int, float], k: int, without: int = -1) -> list[tuple[float, int]]:
        """The k greatest cosines above 0 and their examples, the earlier example first where they are equal."""
        terms, weights = _pair(q)
        lo = self.first[terms]
        n = self.first[terms + 1] - lo
        runs = _ranges(lo, n)
        block, weight = self.block[runs], np.repeat(weights, n)
        bound = np.bincount(block, weight * self.most[runs], self.blocks)
        order = np.argsort(-bound, kind="stable")
        order = order[bound[order] > 0]
        best: list[tuple[float, int]] = []
        at, size = 0, _VISIT
        while at < len(order) and not (len(best) == k and bound[order[at]] < best[-1][0] - 1e-9):
            chosen = np.zeros(self.blocks, bool)
            chosen[order[at : at + size]] = True
            some = np.flatnonzero(chosen[block])
            begin = self.start[runs[some]]
            n = self.start[runs[some] + 1] - begin
            postings = _ranges(begin, n)
            total = np.bincount(self.ids.take(postings), np.repeat(weight[some], n) * self.weights.take(postings), self.size)
            if without >= 0:
                total[without] = 0
            hits = np.flatnonzero(total > 0)
            if len(hits) > k:
                hits = hits[total[hits] >= np.partition(total[hits], len(hits) - k)[len(hits) - k] - 1e-9]
            best += [(round(float(total[i]), 12), i) for i in hits.tolist()]
            best = sorted(best, key=lambda x: (-x[0], x[1]))[:k]
            at, size = at + size, 2 * size
        return best


def _pair(v: tuple[np.ndarray, np.ndarray] | dict[int, float]) -> tuple[np.ndarray, np.ndarray]:
    """A vector's terms in their order, and their weights."""
    if isinstance(v, dict):
        v = np.array(sorted(v), np.int64), np.array([v[t] for t in sorted(v)], float)
    return v


def _ranges(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The numbers from each start on, n of them."""
    end = np.cumsum(n)
    return np.arange(end[-1] if len(end) else 0) + np.repeat(start - (end - n), n)


def _vote(best: list[tuple[float, int]], y: np.ndarray) -> float:
    return sum(s * y[e] for s, e in best) / sum(s for s, _ in best)


class Model:
    def __init__(self, examples: list[tuple[int, int, dict[bytes, int]]]) -> None:
        """examples: id, label, counts of words."""
        y = np.array([e[1] for e in examples], float)
        n, positive = len(y), float(y.sum())
        in_all, in_positive = Counter(), Counter()
        for _, label, counts in examples:
            in_all.update(counts.keys())
            if label:
                in_positive.update(counts.keys())
        words = sorted(in_all)
        df, hits = (np.array([c[w] for w in words], float) for c in (in_all, in_positive))
        chance = df * (n - df) * positive * (n - positive)
        chi = np.divide(n * (hits * (n - df - positive + hits) - (df - hits) * (positive - hits)) ** 2, chance, out=np.zeros(len(df)), where=chance > 0)
        buf = np.frombuffer(b" ".join(words), np.uint8)
        start, end, _ = W.spans(buf, np.array([0, len(buf)]), W.ALNUM)
        hashes = W.word_hashes(buf, start, end)
        order = np.argsort(hashes)
        #: Terms are numbered by their words' hashes, whatever comes behind them is no term.
        self.hashes, self.words = np.append(hashes[order], np.uint64(2**64 - 1)), [words[i] for i in order.tolist()]
        self.weights = (np.log((n + 1) / (df + 0.5)) * (1 + chi))[order]
        number = {w: i for i, w in enumerate(self.words)}
        some = [i for i, (_, _, counts) in enumerate(examples) if counts]
        vectors = [self.vector(np.array(sorted((number[w], c) for w, c in examples[i][2].items()), np.int64).T) for i in some]
        self.index = Index(vectors, len(words))
        self.y, self.ids = y[some], [examples[i][0] for i in some]
        none = n - len(some)
        self.without = (positive - float(self.y.sum()) + positive / n) / (none + 1) if n else 0.0
        votes, labels = [], []
        for j, i in enumerate(some):
            if best := self.index.nearest(vectors[j], NEIGHBOURS, j):
                votes.append(_vote(best, self.y))
                labels.append(y[i])
        self.scale, self.shift = _platt(np.array(votes), np.array(labels)) if votes else (0.0, 0.0)

    def vector(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Terms and weights of unit length; counts: terms in their order and how often the text has each."""
        w = (1 + np.log(counts[1])) * self.weights[counts[0]]
        return counts[0], w / np.sqrt((w * w).sum())

    def score(self, counts: np.ndarray) -> tuple[float, list[tuple[float, int]]]:
        if not counts.size or not (best := self.index.nearest(self.vector(counts), NEIGHBOURS)):
            return float(self.without), []
        return float(_sigmoid(np.array(self.scale * _vote(best, self.y) + self.shift))), best

    def counts(self, buf: np.ndarray, offs: np.ndarray) -> list[np.ndarray]:
        """By row its terms in their order and how often it has each."""
        low = W.LOWER[buf]
        start, end, first = W.spans(low, offs, W.ALNUM)
        h = W.word_hashes(low, start, end)
        term = np.searchsorted(self.hashes[:-1], h)
        row = np.repeat(np.arange(len(offs) - 1), np.diff(first))
        known = self.hashes[term] == h if len(self.words) else np.zeros(len(h), bool)
        pairs, n = np.unique(row[known] * max(1, len(self.words)) + term[known], return_counts=True)
        row, term = np.divmod(pairs, max(1, len(self.words)))
        bounds = np.searchsorted(row, np.arange(len(offs)))
        both = np.stack([term, n])
        return [both[:, a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]


def _examples(docs: DataFrame, labels: DataFrame, learn: Column, rows: int) -> list[tuple[int, int, dict[bytes, int]]]:
    sample = bounded_sample(labels.filter(learn & F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).select("doc_id", F.col("toxic").cast("int").alias("toxic")).distinct(), rows, "doc_id", "toxic")
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ws, ns = [], []
            for _, _, buf, offs in W.slices(batch.column("text")):
                low = W.LOWER[buf]
                start, end, first = W.spans(low, offs, W.ALNUM)
                for i in range(len(offs) - 1):
                    c = Counter(low[s:e].tobytes() for s, e in zip(start[first[i] : first[i + 1]], end[first[i] : first[i + 1]], strict=True))
                    ws.append(list(c))
                    ns.append(list(c.values()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), pa.array(ws, pa.list_(pa.binary())), pa.array(ns, pa.list_(pa.int64()))], ["doc_id", "toxic", "words", "n"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    got = texts.mapInArrow(count, f"doc_id {kind}, toxic int, words array<binary>, n array<long>").toArrow().to_pylist()
    return sorted(((r["doc_id"], r["toxic"], dict(zip(r["words"], r["n"], strict=True))) for r in got), key=lambda r: (r[0], r[1], sorted(r[2].items())))


def apply(docs: DataFrame, labels: DataFrame, learn: Column | None = None, keep: list[str] | None = None, rows: int = EXAMPLES) -> DataFrame:
    """docs' columns `keep` (default: all), score (double), predicted (int), evidence (the nearest examples' doc_ids and
    cosines) and terms (array<string>: the SHOWN that weigh most in the text), replacing any of these names.

    A null or empty text has no term; without examples every score is 0, and an empty table gives no rows. Repeated rows get equal results, and ids of any
    type are carried as they are. A very long text is read whole; of examples that are as near the earlier by id counts first.
    """
    names = ("score", "predicted", "evidence", "terms")
    keep = [c for c in (docs.columns if keep is None else keep) if c not in names]
    kind = docs.schema["doc_id"].dataType
    arrow = to_arrow_type(kind)
    model = docs.sparkSession.sparkContext.broadcast(Model(_examples(docs, labels, F.lit(True) if learn is None else learn, rows)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        known: dict[bytes, tuple] = {}
        for batch in batches:
            for r0, r1, buf, offs in W.slices(batch.column("text")):
                scores, evidence, terms = [], [], []
                for own in m.counts(buf, offs):
                    key = hashlib.sha256(own.tobytes()).digest()
                    if key not in known:
                        if len(known) > 20_000:
                            known.clear()
                        #: The terms that weigh most come first.
                        ranked = own[0][np.argsort(-m.vector(own)[1], kind="stable")][:SHOWN].tolist() if own.size else []
                        known[key] = *m.score(own), [m.words[t].decode(errors="replace") for t in ranked]
                    score, best, shown = known[key]
                    scores.append(score)
                    evidence.append([{"doc_id": m.ids[e], "cosine": s} for s, e in best])
                    terms.append(shown)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c)[r0:r1] for c in keep), pa.array(scores, pa.float64()), pa.array([int(s >= THRESHOLD) for s in scores], pa.int32()), pa.array(evidence, pa.list_(pa.struct([("doc_id", arrow), ("cosine", pa.float64())]))), pa.array(terms, pa.list_(pa.string()))],
                    [*keep, *names],
                )

    cols = list(dict.fromkeys([*keep, "text"]))
    schema = StructType([*docs.select(*keep).schema.fields, *StructType.fromDDL(f"score double, predicted int, evidence array<struct<doc_id:{kind.simpleString()},cosine:double>>, terms array<string>").fields])
    return docs.select(*cols).mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = apply(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), bucket("doc_id", 3) != 1, ["doc_id"])
    return got.select("doc_id", F.coalesce(bucket("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "score", "predicted", "evidence", "terms")
