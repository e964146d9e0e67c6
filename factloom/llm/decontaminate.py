"""Benchmark decontamination: a broadcast hash set of the items' word windows, held against every text's windows.

The set is broadcast in blocks of about BLOCK_BYTES of item text, one scan a block. A block's set takes about 130 times its
text in memory. A window that a hash finds is verified by its words before it counts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from factloom.llm import words as W
from factloom.llm.shared import table, written

N = 10
BLOCK_BYTES = 2 << 20
_FILTER_BITS = 20
NAMES = ("n_words", "n_hit", "items", "spans")
SCHEMA = "n_words long, n_hit long, items array<string>, spans array<struct<start:long,end:long>>"


class Windows:
    """Windows of a block of items: by number of words, sorted hashes, a bit filter, and item ids by words."""

    def __init__(self, items: list[tuple[str, str]], n: int) -> None:
        self.ids: dict[bytes, set[str]] = {}
        by_size: dict[int, set[bytes]] = {}
        for item, text in items:
            buf = W.LOWER[np.frombuffer((text or "").encode(), np.uint8)]
            start, end, _ = W.spans(buf, np.array([0, len(buf)]), W.ALNUM)
            ws = [buf[s:e].tobytes() for s, e in zip(start, end, strict=True)]
            size = min(n, len(ws))
            for i in range(len(ws) - size + 1 if size else 0):
                key = b" ".join(ws[i : i + size])
                self.ids.setdefault(key, set()).add(item or "")
                by_size.setdefault(size, set()).add(key)
        self.sizes: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for size, keys in by_size.items():
            buf = np.frombuffer(b" ".join(sorted(keys)), np.uint8)
            start, end, _ = W.spans(buf, np.array([0, len(buf)]), W.ALNUM)
            hashes = np.unique(W.window_hashes(W.word_hashes(buf, start, end), size)[::size])
            bits = np.zeros(1 << _FILTER_BITS, bool)
            bits[hashes >> np.uint64(64 - _FILTER_BITS)] = True
            self.sizes[size] = hashes, bits

    def hits(self, low: np.ndarray, start: np.ndarray, end: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int, set[str]]]:
        """(index of the first word, number of words, item ids) of every window that some item has."""
        h = W.word_hashes(low, start, end)
        for size, (hashes, bits) in self.sizes.items():
            w = W.window_hashes(h, size)
            at = np.flatnonzero(bits[w >> np.uint64(64 - _FILTER_BITS)])
            at = at[W.whole_windows(first, size, len(h))[at]]
            found = np.searchsorted(hashes, w[at])
            for i in at[(found < len(hashes)) & (hashes[np.minimum(found, len(hashes) - 1)] == w[at])].tolist():
                if ids := self.ids.get(b" ".join(low[start[j] : end[j]].tobytes() for j in range(i, i + size))):
                    yield i, size, ids


def _scan(docs: DataFrame, windows, n: int) -> DataFrame:
    """Adds the columns of SCHEMA; spans are byte spans of runs of hit words. Spans and items there already are kept."""
    keep = [c for c in docs.columns if c not in NAMES]
    again = "spans" in docs.columns

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r0, r1, buf, offs in W.slices(batch.column("text")):
                low = W.LOWER[buf]
                start, end, first = W.spans(low, offs, W.ALNUM)
                step, items = np.zeros(len(start) + 1, np.int64), {}
                for i, size, ids in windows.value.hits(low, start, end, first):
                    step[i] += 1
                    step[i + size] -= 1
                    items.setdefault(int(np.searchsorted(first, i, "right")) - 1, set()).update(ids)
                hit = np.cumsum(step[:-1]) > 0
                if again:
                    for i, (was, spans) in enumerate(zip(batch.column("items")[r0:r1].to_pylist(), batch.column("spans")[r0:r1].to_pylist(), strict=True)):
                        if was:
                            items.setdefault(i, set()).update(was)
                        for x in spans:
                            hit[np.searchsorted(start, offs[i] + x["start"]) : np.searchsorted(start, offs[i] + x["end"])] = True
                out = []
                for i in range(len(offs) - 1):
                    own = np.flatnonzero(np.diff(np.concatenate([[False], hit[first[i] : first[i + 1]], [False]]).astype(np.int8))) if i in items else []
                    out.append([{"start": int(start[first[i] + a] - offs[i]), "end": int(end[first[i] + b - 1] - offs[i])} for a, b in zip(own[::2], own[1::2], strict=True)])
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c)[r0:r1] for c in keep), pa.array(np.diff(first)), pa.array(W.per_row(hit, first)), pa.array([sorted(items.get(i, ())) for i in range(len(offs) - 1)], pa.list_(pa.string())), pa.array(out, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))],
                    [*keep, *NAMES],
                )

    return docs.mapInArrow(find, StructType([*docs.select(*keep).schema.fields, *StructType.fromDDL(SCHEMA).fields]))


def find(docs: DataFrame, items: DataFrame, n: int = N, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs' columns and n_words, n_hit (long), items (ids, sorted) and spans (bytes of runs of hit words).

    A null text has no words; a null item id counts as "". Repeated items and rows count as they stand. Columns of
    these names are replaced. Without items nothing is hit.
    """
    spark = docs.sparkSession
    docs = docs.drop(*NAMES)
    rows = items.select(F.col("item_id").cast("string").alias("id"), "text").filter("text IS NOT NULL")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(size / block_bytes))
    for k in range(blocks):
        part = rows if blocks == 1 else rows.filter(F.pmod(F.xxhash64("text"), F.lit(blocks)) == k)
        docs = _scan(docs, spark.sparkContext.broadcast(Windows([tuple(r) for r in part.collect()], n)), n)
        if k < blocks - 1:
            docs = written(docs, "decontaminate")
    return docs


def remove(docs: DataFrame, items: DataFrame, mode: str = "documents", n: int = N) -> DataFrame:
    """docs without the documents that an item's window occurs in, or ("spans") without those windows' bytes."""
    clash = [c for c in docs.columns if c in NAMES]
    for c in clash:
        docs = docs.withColumnRenamed(c, f"__{c}")
    found = find(docs, items, n)
    back = lambda df: df.select(*(F.col(c).alias(c.removeprefix("__") if c.removeprefix("__") in clash else c) for c in docs.columns))
    if mode == "documents":
        return back(found.filter("n_hit = 0"))
    if mode != "spans":
        raise ValueError(f"mode is documents or spans, not {mode}")

    names = docs.columns

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, spans in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("spans").to_pylist(), strict=True):
                if spans:
                    ends = [0, *(x["end"] for x in spans)]
                    text = b"".join(text[a:b] for a, b in zip(ends, [*(x["start"] for x in spans), len(text)], strict=True))
                out.append(text)
            at = batch.schema.get_field_index("text")
            yield batch.set_column(at, "text", pa.array(out, pa.binary()).cast(pa.string())).select(names)

    return back(found.select(*names, "spans").mapInArrow(cut, docs.schema))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = find(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return got.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return remove(docs, table(spark, sf_dir, "benchmark"))


SQL = r"""
WITH words AS (
  SELECT doc_id, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM (
    SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents)),
items AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
starts AS (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS s FROM items WHERE len(w) > 0),
keys AS (SELECT DISTINCT item_id, n, array_to_string(w[s:s + n - 1], ' ') AS k FROM starts),
sizes AS (SELECT DISTINCT n FROM keys),
docs AS (SELECT doc_id, list(w ORDER BY i) AS w FROM words GROUP BY doc_id),
runs AS (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS s FROM docs, sizes WHERE len(w) >= n),
hits AS (SELECT DISTINCT doc_id, s, r.n, item_id FROM (SELECT doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') AS k FROM runs) r JOIN keys USING (n, k)),
hit_words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hits) GROUP BY doc_id),
hit_items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM hits) GROUP BY doc_id)
SELECT d.doc_id, coalesce(len(w.w), 0)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM documents d LEFT JOIN docs w USING (doc_id) LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)
"""
