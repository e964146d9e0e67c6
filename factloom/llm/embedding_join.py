"""Embedding near-dedup: pairs of one label whose cosine is THRESHOLD at least, and what they connect.

1. Equal vectors of a label are one class with a count (aggregated on the map side), so that copies, however many, cost
   one vector and no pair.
2. Classes of a label are dealt to tiles of about TILE by a hash of their content, and every two tiles of a label meet
   in one task, which holds no more than them. Vectors are quantised to int8 there; the product of two blocks of codes is
   exact, and a vector's quantisation error (its length is known exactly) bounds the cosine from both sides. Pairs
   certainly below the threshold go, pairs certainly above it are links, and only those between are computed
   anew in double precision.
3. A task returns for each class the number of vectors it links with, and the smallest id of its part of the graph: a
   row a class and task, never a row a pair. Connected components over those rows are the result's.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.components import components
from factloom.llm.shared import spent, table, written
from factloom.llm.whitening import usable

THRESHOLD = 0.93
TILE = 4096
BLOCK = 512
#: Sums of products of int8 codes are exact in single precision up to so many dimensions, and are summed in runs beyond.
_EXACT = 1024
#: Above every rounding error of the bounds, which are found in single precision.
_SLACK = 2e-5


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Unit vectors (double), their int8 codes, the codes' steps, and the length of what the codes lose."""
    unit = x / np.abs(x).max(1, keepdims=True)
    unit /= np.sqrt((unit * unit).sum(1, keepdims=True))
    step = np.abs(unit).max(1) / 127
    codes = np.rint(unit / step[:, None]).astype(np.int8)
    return unit, codes, step, np.sqrt(((unit - codes * step[:, None]) ** 2).sum(1))


def product(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The exact products of rows of codes."""
    out = np.zeros((len(p), len(q)), np.float32 if p.shape[1] <= _EXACT else np.float64)
    for d in range(0, p.shape[1], _EXACT):
        out += p[:, d : d + _EXACT].astype(np.float32) @ q[:, d : d + _EXACT].astype(np.float32).T
    return out


def linked(a: tuple, b: tuple, threshold: float) -> tuple[np.ndarray, int]:
    """Which rows of a link with which of b, and how many pairs had to be computed in full precision."""
    (u, p, s, e), (v, q, t, f) = a, b
    near = product(p, q) * np.outer(s, t).astype(np.float32)
    off = (np.outer(1 + e, f) + np.outer(e, 1 + f) + np.outer(e, f)).astype(np.float32) + np.float32(_SLACK)
    yes = near - off >= threshold
    i, j = np.nonzero((near + off >= threshold) & ~yes)
    for at in range(0, len(i), 1 << 15):
        ii, jj = i[at : at + (1 << 15)], j[at : at + (1 << 15)]
        yes[ii, jj] = np.einsum("ij,ij->i", u[ii], v[jj]) >= threshold
    return yes, len(i)


def joined(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the classes of a[i] and b[i], each named by its smallest member, in place."""
    while True:
        x, y = root[a], root[b]
        if (x == y).all():
            return
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root[:] = root[root]


def _tiles(threshold: float):
    def links(t: pa.Table) -> pa.Table:
        t = t.sort_by("side").combine_chunks()
        ids, k1, k2, size = t["id"], t["k1"], t["k2"], t["m"].to_numpy()
        n, cut = len(t), int(np.searchsorted(t["side"].to_numpy(), 1))
        x = t["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)
        made = quantised(x)
        whole = cut == n  # a tile with itself
        #: Classes by the order of their ids, so that a part's root is its smallest id.
        order = np.array(pc.sort_indices(ids)).astype(np.int64)
        rank = np.empty(n, np.int64)
        rank[order] = np.arange(n)
        root, count = np.arange(n), np.zeros(n, np.int64)
        for i in range(0, cut, BLOCK):
            i1 = min(i + BLOCK, cut)
            a = tuple(m[i:i1] for m in made)
            for j in range(i if whole else cut, n, BLOCK):
                j1 = min(j + BLOCK, n)
                yes, _ = linked(a, tuple(m[j:j1] for m in made), threshold)
                if whole and i == j:
                    np.fill_diagonal(yes, False)
                    yes = np.triu(yes)
                if not yes.any():
                    continue
                count[i:i1] += yes @ size[j:j1]
                count[j:j1] += size[i:i1] @ yes
                r, c = np.nonzero(yes)
                joined(root, rank[i + r], rank[j + c])
        at = np.flatnonzero(count)
        top = order[root[rank[at]]]
        return pa.table({"k1": k1.take(pa.array(at)), "k2": k2.take(pa.array(at)), "n": pa.array(count[at]), "a": ids.take(pa.array(at)), "b": ids.take(pa.array(top)), "kb": k1.take(pa.array(top))})

    return links


def join(vectors: DataFrame, threshold: float = THRESHOLD, tile: int = TILE, column: str = "embedding", key: str = "vec_id", label: str = "label") -> DataFrame:
    """One row for each row of vectors: key, n_links, component_id, kept.

    Vectors link where labels are equal and not null and lengths are equal; a vector that is null, zero, empty or holds null or
    non-finite entries, or whose key is null, links with nothing: n_links 0, component_id its own key, kept true (null and
    false for a null key). Equal vectors link with each other. Rows that share a key are vectors of their own, and
    link with each other only if their vectors do. Without rows the result is empty. Other columns, of whatever name, aren't kept. The work is
    the square of a label's different vectors, in tasks of two tiles; no pair leaves a task.
    """
    kind = vectors.schema[key].dataType.simpleString()
    rows = vectors.select(F.col(key).alias("id"), F.col(label).cast("string").alias("label"), F.col(column).alias("v"))
    good = usable(rows, "v").filter("id IS NOT NULL AND label IS NOT NULL AND exists(__v, c -> c <> 0)")
    good = good.withColumn("k1", F.xxhash64("label", "__v")).withColumn("k2", F.xxhash64(F.lit(7), "label", "__v"))
    classes = written(good.groupBy("k1", "k2").agg(F.first("label").alias("label"), F.first("v").alias("v"), F.min("id").alias("id"), F.count("*").alias("m")), "vector-classes")
    sizes = classes.groupBy("label", F.size("v").alias("dims")).agg(F.ceil(F.count("*") / tile).cast("int").alias("tiles"))
    own = classes.withColumn("dims", F.size("v")).join(sizes, ["label", "dims"]).withColumn("tile", F.pmod("k2", "tiles").cast("int"))
    sent = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    sent = sent.select("label", "dims", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), (F.col("tile") > F.col("other")).cast("int").alias("side"), "k1", "k2", "id", "m", "v")
    found = written(sent.groupBy("label", "dims", "i", "j").applyInArrow(_tiles(threshold), f"k1 long, k2 long, n long, a {kind}, b {kind}, kb long"), "vector-links")
    parts = components(found.select(F.struct(F.col("a").alias("id"), F.col("k1").alias("k")).alias("a"), F.struct(F.col("b").alias("id"), F.col("kb").alias("k")).alias("b")))
    links = classes.join(found.groupBy("k1", "k2").agg(F.sum("n").alias("n")), ["k1", "k2"], "left").filter("n IS NOT NULL OR m > 1")
    links = links.join(parts.select(F.col("id.id").alias("id"), F.col("id.k").alias("k1"), F.col("component.id").alias("top")), ["id", "k1"], "left")
    links = written(links.select("k1", "k2", (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.coalesce("top", "id").alias("component_id")), "vector-parts")
    spent(classes, found, parts)
    #: Rows that can't link have keys of their own, so that they don't meet in one task.
    usable_ = F.col("label").isNotNull() & F.col("id").isNotNull() & F.col("v").isNotNull()
    v = F.col("v").cast("array<double>")
    asked = rows.select("id", F.when(usable_, F.xxhash64("label", v)).otherwise(F.xxhash64("id")).alias("k1"), F.when(usable_, F.xxhash64(F.lit(7), "label", v)).alias("k2"))
    out = asked.join(links, ["k1", "k2"], "left")
    return out.select(F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"), F.coalesce(F.col("id") == F.coalesce("component_id", "id"), F.lit(False)).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "embeddings"))


SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, [c::DOUBLE FOR c IN embedding] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([c FOR c IN embedding IF c IS NULL OR NOT isfinite(c)]) = 0 AND len([c FOR c IN embedding IF c <> 0]) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.93),
reach(id, r) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT l.b, r.r FROM reach r JOIN links l ON l.a = r.id AND r.r < l.b)
SELECT e.vec_id, (SELECT count(*) FROM links WHERE a = e.vec_id)::BIGINT AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e JOIN (SELECT id, min(r) AS component_id FROM reach GROUP BY id) c ON c.id = e.vec_id
"""
