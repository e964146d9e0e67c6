"""Substring dedup: words that repeat, in runs of WINDOW, what a document with a smaller doc_id has already.

1. Sketch: each window is stood for by the least of its GRAM-word hashes, so that consecutive windows mostly share
   one fingerprint. Every task fills a count-min sketch of its fingerprints, and the partitions' sketches are merged. A
   merged counter is never below a fingerprint's true count, so a window whose estimate is 1 stands in one place only
   and is dropped without loss.
2. Exact: the windows estimated repeated, and only those, are shuffled by their fingerprint, a run of adjacent windows
   with one fingerprint as one row with a 64-bit key for each window. Where fingerprint and key are equal, all but the
   smallest doc_id lose their words. Windows of hot fingerprints are aggregated on the map side instead, by 128-bit
   keys, and their owners broadcast, up to BROADCAST_KEYS of them, or else joined back: a passage in a third of all rows
   isn't one task's work.

What is sent of a sketch, and the three bitmaps that are broadcast, have a fixed size, whatever the input. Where far
more fingerprints than cells come in, more windows go through and the second pass does more; results are the same.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from factloom.llm import sketch
from factloom.llm import words as W
from factloom.llm.shared import table, written

WINDOW = 13
GRAM = 6
CELL_BITS, DEPTH = 27, 2
HOT = 1000
BROADCAST_KEYS = 500_000


def _fingerprints(h: np.ndarray, window: int) -> np.ndarray:
    """The least gram hash of each window."""
    grams = W.window_hashes(h, GRAM)
    n = len(h) - window + 1
    out = grams[:n].copy()
    for j in range(1, window - GRAM + 1):
        np.minimum(out, grams[j : n + j], out=out)
    return out


def _windows(buf: np.ndarray, offs: np.ndarray, window: int):
    """Words' starts and ends, rows' first words, hashes, and of the whole windows: index, row, fingerprint."""
    start, end, first = W.spans(buf, offs, W.SPACED)
    h = W.word_hashes(buf, start, end)
    at = np.flatnonzero(W.whole_windows(first, window, len(h)))
    row = W.rows_of(first)[at]
    return start, end, first, h, at, row, _fingerprints(h, window)[at] if len(at) else np.empty(0, np.uint64)


def repeats(docs: DataFrame, window: int = WINDOW, bits: int = CELL_BITS) -> DataFrame:
    """(doc_id, at, n): runs of n adjacent windows that a document with a smaller doc_id has too; at is 31 bits of the
    text's crc32 and the index of the first word, in the high and low 32 bits."""
    texts = docs.select("doc_id", "text").filter("doc_id IS NOT NULL AND text IS NOT NULL")
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()

    def fingerprints(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
        *_, row, fp = _windows(buf, offs, window)
        return fp[np.append(True, (fp[1:] != fp[:-1]) | (row[1:] != row[:-1]))] if len(fp) else fp

    counted = spark.sparkContext.broadcast(sketch.count(texts.select("text"), fingerprints, bits, DEPTH, HOT))

    def keys(buf, start, end, h, at) -> tuple[np.ndarray, np.ndarray]:
        second = W.window_hashes(W.word_hashes(buf, start, end, 1), window, 1)
        return W.window_hashes(h, window)[at].view(np.int64), second[at].view(np.int64)

    def hot_ones(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The smallest and the greatest doc_id of each hot window in the task."""
        hot, held = np.frombuffer(counted.value[1], np.uint8), pd.DataFrame()
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            for r0, _, buf, offs in W.slices(batch.column("text")):
                start, end, first, h, at, row, fp = _windows(buf, offs, window)
                if (ok := sketch.is_hot(hot, fp)).any():
                    k1, k2 = keys(buf, start, end, h, at[ok])
                    d = ids[r0 + row[ok]]
                    held = pd.concat([held, pd.DataFrame({"k1": k1, "k2": k2, "owner": d, "last": d})]).groupby(["k1", "k2"], as_index=False).agg({"owner": "min", "last": "max"})
            if len(held) > 500_000:
                yield pa.RecordBatch.from_pandas(held, preserve_index=False)
                held = pd.DataFrame()
        if len(held):
            yield pa.RecordBatch.from_pandas(held, preserve_index=False)

    owners, table_ = None, None
    if counted.value[1].strip(b"\0"):
        owners = written(texts.mapInArrow(hot_ones, f"k1 long, k2 long, owner {kind}, last {kind}").groupBy("k1", "k2").agg(F.min("owner").alias("owner"), F.max("last").alias("last")), "owners")
        if owners.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS:
            table_ = owners.toPandas().sort_values(["k1", "k2"])
    apart = owners is not None and table_ is None
    known = spark.sparkContext.broadcast(None if table_ is None else tuple(table_[c].to_numpy() for c in ("k1", "k2", "owner", "last")))

    def marks(buf, offs, first, at, row) -> np.ndarray:
        data = buf.tobytes()
        crc = np.array([zlib.crc32(data[offs[i] : offs[i + 1]]) >> 1 for i in range(len(offs) - 1)], np.int64)
        return (crc[row] << 32) | (at - first[row])

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Runs of windows estimated repeated, with their keys; and, without keys, runs of hot windows that are to go."""
        twice, hot = (np.frombuffer(x, np.uint8) for x in counted.value)
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            for r0, _, buf, offs in W.slices(batch.column("text")):
                start, end, first, h, at, row, fp = _windows(buf, offs, window)
                warm = sketch.is_hot(hot, fp) if len(hot) else np.zeros(len(fp), bool)
                cold = sketch.repeated(twice, fp, bits, DEPTH) & ~warm
                gone = np.zeros(len(fp), bool)
                if known.value is not None and warm.any():
                    k1, k2 = keys(buf, start, end, h, at[warm])
                    gone[warm] = ids[r0 + row[warm]] > _owner(known.value, k1, k2)
                for ok, one in ((cold, fp), (gone, np.zeros(len(fp), np.uint64))):
                    if not ok.any():
                        continue
                    a, r, f = at[ok], row[ok], one[ok]
                    new = np.flatnonzero(np.append(True, (a[1:] != a[:-1] + 1) | (r[1:] != r[:-1]) | (f[1:] != f[:-1])))
                    sizes = np.diff(np.append(new, len(a)))
                    where = marks(buf, offs, first, a[new], r[new])
                    if ok is cold:
                        k = W.window_hashes(h, window)[a]
                        ends = np.append(0, 8 * np.cumsum(sizes)).astype(np.int32)
                        sent = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(k)])
                        f = f[new]
                    else:
                        sent, f = pa.nulls(len(sizes), pa.binary()), W.mix(where.astype(np.uint64))  # spread over the tasks
                    yield pa.RecordBatch.from_arrays([pa.array(f.view(np.int64)), batch.column("doc_id").take(pa.array(r0 + r[new])), pa.array(where), pa.array(sizes.astype(np.int32)), sent], ["fp", "doc_id", "at", "n", "keys"])

    def later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail = None
        for batch in batches:
            done = batch.column("keys").is_null()
            if done.true_count:
                yield batch.filter(done).select(["doc_id", "at", "n"])
                batch = batch.filter(pc.invert(done))
            if not len(batch):
                continue
            held = pa.Table.from_batches([batch] if tail is None else [*tail.to_batches(), batch]).combine_chunks()
            fp = held.column("fp").to_numpy()
            whole = int(np.searchsorted(fp, fp[-1]))  # the last fingerprint may go on
            tail = held.slice(whole)
            if whole:
                yield from decided(held.slice(0, whole))
        if tail is not None:
            yield from decided(tail)

    row = f"fp long, doc_id {kind}, at long, n int, keys binary"
    cold = texts.mapInArrow(runs, row).repartition("fp").sortWithinPartitions("fp", "doc_id").mapInArrow(later, f"doc_id {kind}, at long, n int")
    if not apart:
        return cold

    def hot_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = np.frombuffer(counted.value[1], np.uint8)
        for batch in batches:
            for r0, _, buf, offs in W.slices(batch.column("text")):
                start, end, first, h, at, r, fp = _windows(buf, offs, window)
                if (ok := sketch.is_hot(hot, fp)).any():
                    k1, k2 = keys(buf, start, end, h, at[ok])
                    yield pa.RecordBatch.from_arrays([pa.array(k1), pa.array(k2), batch.column("doc_id").take(pa.array(r0 + r[ok])), pa.array(marks(buf, offs, first, at[ok], r[ok]))], ["k1", "k2", "doc_id", "at"])

    rest = texts.mapInArrow(hot_windows, f"k1 long, k2 long, doc_id {kind}, at long").join(owners.filter("owner < last"), ["k1", "k2"])
    return cold.unionByName(rest.filter("doc_id > owner").select("doc_id", "at", F.lit(1).alias("n")))


def decided(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    """Runs (doc_id, at, n) of the windows that a smaller doc_id has too; rows: whole fingerprints, by fp and doc_id."""
    n = rows.column("n").to_numpy().astype(np.int64)
    of = np.repeat(np.arange(len(n)), n)
    ids = rows.column("doc_id").combine_chunks()
    place = np.append(0, np.cumsum((ids.to_numpy(zero_copy_only=False)[1:] != ids.to_numpy(zero_copy_only=False)[:-1])))[of] if len(n) else of
    key = np.concatenate([np.frombuffer(x.as_buffer(), np.int64) for x in rows.column("keys").combine_chunks()])
    fp = rows.column("fp").to_numpy()[of]
    order = np.lexsort((key, fp))  # stable: places stay in order
    k, f, p = key[order], fp[order], place[order]
    new = np.append(True, (k[1:] != k[:-1]) | (f[1:] != f[:-1]))
    owner = p[np.maximum.accumulate(np.where(new, np.arange(len(k)), 0))]
    gone = np.zeros(len(k), bool)
    gone[order] = p > owner
    if not gone.any():
        return
    first = np.cumsum(n) - n
    at = np.flatnonzero(gone)
    begin = np.flatnonzero(np.append(True, (at[1:] != at[:-1] + 1) | (of[at[1:]] != of[at[:-1]])))
    sizes = np.diff(np.append(begin, len(at)))
    at, of = at[begin], of[at[begin]]
    where = rows.column("at").to_numpy()[of] + (at - first[of])
    yield pa.RecordBatch.from_arrays([ids.take(pa.array(of)), pa.array(where), pa.array(sizes.astype(np.int32))], ["doc_id", "at", "n"])


def _owner(hot: tuple[np.ndarray, ...], k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
    """The smallest doc_id of each hot window; every window asked for is in the table."""
    keys = np.empty(len(hot[0]), [("a", np.int64), ("b", np.int64)])
    keys["a"], keys["b"] = hot[0], hot[1]
    ask = np.empty(len(k1), keys.dtype)
    ask["a"], ask["b"] = k1, k2
    lo = np.searchsorted(hot[0], k1)
    same = keys[np.minimum(lo, len(keys) - 1)] == ask
    if not same.all():  # first keys that are equal while second ones aren't
        lo[~same] = np.searchsorted(keys, ask[~same])
    return hot[2][lo]


def apply(docs: DataFrame, window: int = WINDOW, bits: int = CELL_BITS) -> DataFrame:
    """docs' columns and n_words, n_removed (long) and kept_text (string): the words that stay, joined by one space.

    A null or empty text has no words and "" stays. Rows without a doc_id neither lose words nor take any from
    others; rows that share a doc_id don't take words from each other. Columns of the three names are replaced.
    """
    keep = [c for c in docs.columns if c not in ("n_words", "n_removed", "kept_text")]
    found = written(repeats(docs, window, bits), "repeats").groupBy("doc_id").agg(F.collect_list(F.struct("at", "n")).alias("__at")).withColumnRenamed("doc_id", "__id")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, removed, kept = [], [], []
            for text, at in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("__at"), strict=True):
                ws = (text or b"").split()
                words.append(len(ws))
                if at.is_valid and text is not None:
                    at, n = (at.values.field(c).to_numpy() for c in ("at", "n"))
                    own = at >> 32 == zlib.crc32(text) >> 1
                    at, n = at[own] & 0xFFFFFFFF, n[own].astype(np.int64)
                    step = np.zeros(len(ws) + 1, np.int64)
                    np.add.at(step, at, 1)
                    np.add.at(step, at + n + window - 1, -1)
                    stay = np.cumsum(step[:-1]) <= 0
                    ws = [w for w, s in zip(ws, stay.tolist(), strict=True) if s]
                removed.append(words[-1] - len(ws))
                kept.append(b" ".join(ws))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(words, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], [*keep, "n_words", "n_removed", "kept_text"])

    cols = list(dict.fromkeys([*keep, "text"]))
    schema = StructType([*docs.select(*keep).schema.fields, *StructType.fromDDL("n_words long, n_removed long, kept_text string").fields])
    base = docs.select(*cols)
    return base.join(found, base["doc_id"] == found["__id"], "left").select(*cols, "__at").mapInArrow(cut, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return apply(docs).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


SQL = r"""
WITH docs AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
runs AS (SELECT doc_id, s, array_to_string(w[s:s + 12], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS s FROM docs WHERE len(w) >= 13)),
owners AS (SELECT k, min(doc_id) AS owner FROM runs GROUP BY k HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 13)) AS i FROM runs JOIN owners USING (k) WHERE owner < doc_id),
kept AS (
  SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS t, count(*) AS n FROM (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM docs) ANTI JOIN gone USING (doc_id, i)
  GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, (len(d.w) - coalesce(k.n, 0))::BIGINT AS n_removed, sha256(coalesce(k.t, '')) AS kept_sha256
FROM docs d LEFT JOIN kept k USING (doc_id)
"""
