"""Periodic run detection: stretches of words that repeat with a period, found in linear time and collapsed.

Kolpakov and Kucherov's algorithm, with a least exponent E in place of 2. The words are factorised by a suffix automaton
(each factor is the longest prefix of the rest that starts somewhere before, or a new word). By Main's theorem a run that touches or
crosses the border of two factors of lengths a and c and ends in the second has a period below (a + c) / (E - 1), and
starts less than a + period before the border: two Z-functions find those. Every other run lies strictly inside a factor and
is copied from the factor's earlier occurrence.

A run of LEAST words at least holds only 5-grams that its text has twice, so each text is first cut, in numpy, into the
maximal stretches of such 5-grams: a run never crosses a stretch's end, and plain prose has none. Texts are worked on where
they stand, whole, with no shuffle. Memory of a task: a slice of texts, and about 600 bytes a word of the longest repetitive stretch.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from factloom.llm import words as W
from factloom.llm.shared import table

LEAST, EXPONENT = 6, 4
_GRAM = 5
_FIELDS = "n_words long, n_runs long, start long, length long, period long, exponent_milli long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
_NEW = ("n_words", "n_runs", "start", "length", "period", "exponent_milli", "runs", "collapsed")


def automaton(w: list[int]) -> tuple[list[dict[int, int]], list[int]]:
    """The suffix automaton of w: each state's transitions, and the place of the last letter of its first occurrence."""
    nexts: list[dict[int, int]] = [{}]
    link, length, ends = [-1], [0], [-1]
    last = 0
    for i, c in enumerate(w):
        cur = len(nexts)
        nexts.append({})
        link.append(0)
        length.append(i + 1)
        ends.append(i)
        p = last
        while p != -1 and c not in nexts[p]:
            nexts[p][c] = cur
            p = link[p]
        if p != -1:
            q = nexts[p][c]
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                twin = len(nexts)
                nexts.append(nexts[q].copy())
                link.append(link[q])
                length.append(length[p] + 1)
                ends.append(ends[q])
                link[q] = link[cur] = twin
                while p != -1 and nexts[p].get(c) == q:
                    nexts[p][c] = twin
                    p = link[p]
        last = cur
    return nexts, ends


def factors(w: list[int]) -> list[tuple[int, int, int]]:
    """(start, length, start of the first occurrence) of the factors of w; a new letter's occurrence is its own."""
    nexts, ends = automaton(w)
    out, i, n = [], 0, len(w)
    while i < n:
        state, size = 0, 0
        while i + size < n:
            after = nexts[state][w[i + size]]
            if ends[after] >= i + size:  # its first occurrence is this one
                break
            state, size = after, size + 1
        out.append((i, size, ends[state] - size + 1) if size else (i, 1, i))
        i += max(1, size)
    return out


def z_function(x: list[int]) -> list[int]:
    """For each place, how many letters from there on agree with the beginning."""
    n = len(x)
    z = [0] * n
    if n:
        z[0] = n
    left = right = 0
    for i in range(1, n):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and x[k] == x[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def _squares(z: list[int], most: int) -> list[int]:
    """The primitive q up to most with two periods of q at the beginning."""
    out: list[int] = []
    for q in range(1, min(most, len(z) // 2) + 1):
        if z[q] >= q and not any(q % p == 0 and z[p] >= q - p for p in out):
            out.append(q)
    return out


def runs(w: list[int], least: int = LEAST, exponent: int = EXPONENT) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of w: maximal, of length >= max(least, exponent * period), by start, then period.

    exponent is 4 at least: one side of a border then holds two periods of each run that touches it.
    """
    n = len(w)
    if n < least:
        return []
    found: dict[int, dict[int, int]] = {}  # by start: the ends by period

    def add(s: int, e: int, q: int) -> None:
        if e - s >= max(least, exponent * q):
            found.setdefault(s, {})[q] = e

    before = 0
    for at, size, source in [*factors(w), (n, 0, n)]:
        far = at + size
        most = (before + size - 1) // (exponent - 1) if size else before // exponent
        if at and most > 0:
            z = z_function(w[at : far + 1])
            for q in _squares(z, most):  # two periods after the border
                e = at + q + z[q]
                s, low = at, max(0, at - before - most - 1)
                while s > low and w[s - 1] == w[s - 1 + q]:
                    s -= 1
                if e <= far and (s > low or s == 0):
                    add(s, e, q)
            low = max(0, at - before - most - 1)
            z = z_function(w[low:at][::-1])
            for q in _squares(z, most):  # two periods before it
                s = at - q - z[q]
                e = at
                while e < n and e <= far and w[e] == w[e - q]:
                    e += 1
                if e <= far and (s > low or s == 0):
                    add(s, e, q)
        if size >= least + 2:
            shift = at - source
            for i in range(at + 1, far - least):
                if (there := found.get(i - shift)) is not None:
                    for q, e in list(there.items()):
                        if e + shift < far:
                            add(i, e + shift, q)
        before = size
    return [(s, e - s, q) for s in sorted(found) for q, e in sorted(found[s].items())]


def stretches(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends, in words, of the maximal stretches of 5-grams that their text has at least twice."""
    if len(h) < _GRAM:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    whole = W.whole_windows(first, _GRAM, len(h))
    row = W.rows_of(first)[: len(whole)]
    at = np.flatnonzero(whole)
    keys = W.mix(W.window_hashes(h, _GRAM)[at] + (row[at].astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    at = at[twice]
    if not len(at):
        return at, at
    new = np.flatnonzero(np.append(True, (at[1:] != at[:-1] + 1) | (row[at[1:]] != row[at[:-1]])))
    return at[new], at[np.append(new[1:], len(at)) - 1] + _GRAM


def found_runs(h: np.ndarray, first: np.ndarray, least: int, exponent: int) -> list[tuple[int, int, int]]:
    """The runs of every row's words, by their hashes; places count from the slice's first word."""
    out = []
    for a, b in zip(*stretches(h, first), strict=True):
        if b - a >= least:
            letters = np.unique(h[a:b], return_inverse=True)[1].tolist()
            out += [(int(a) + s, n, q) for s, n, q in runs(letters, least, exponent)]
    return out


def joined_words(buf: np.ndarray, start: np.ndarray, end: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's words joined by one space: bytes and offsets."""
    sizes = end - start + 1
    sizes[first[1:][np.diff(first) > 0] - 1] -= 1  # none after a row's last
    to = np.append(0, np.cumsum(sizes))
    out = np.full(to[-1], 0x20, np.uint8)
    cuts = np.unique(np.append(np.searchsorted(to, np.arange(0, to[-1], W.SLICE_BYTES)), len(start)))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        moved = np.arange(to[a], to[b]) + np.repeat(start[a:b] - to[a:b], sizes[a:b])
        word = moved < np.repeat(end[a:b], sizes[a:b])
        out[to[a] : to[b]][word] = buf[moved[word]]
    return out, to[first]


def collapse(docs: DataFrame, least: int = LEAST, exponent: int = EXPONENT, text: str = "text", woven=None) -> DataFrame:
    """docs' columns and n_words, n_runs, the longest run's start, length, period and exponent_milli (ties: the smallest start,
    then period; without runs null), `runs` by start and period, and `collapsed`: the words that stay, joined by one space.

    A word goes if a run holds it after that run's first period. A null, empty or blank text has no words and no runs; null or
    repeated keys change nothing, as each row is worked on by itself; an empty table gives an empty one. Texts are read
    whole, however long. Columns of the eight names are replaced. Words count as equal if their 64-bit hashes are.
    `woven(row's batch, row, n)` may give the places that take the words' part: (a, p) makes word i >= a word a + (i - a) % p.
    """
    keep = [c for c in docs.columns if c not in _NEW]
    cols = list(dict.fromkeys([*keep, text]))
    schema = StructType([*docs.select(*keep).schema.fields, *StructType.fromDDL(_FIELDS).fields])
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r0, r1, buf, offs in W.slices(batch.column(text)):
                start, end, first = W.spans(buf, offs, W.SPACED)
                counts = np.diff(first)
                if woven is not None:
                    at = np.arange(len(start))
                    for r in range(r1 - r0):
                        if counts[r] and (how := woven(batch, r0 + r, int(counts[r]))):
                            a, p = first[r] + how[0], how[1]
                            at[a : first[r + 1]] = a + np.arange(first[r + 1] - a) % p
                    start, end = start[at], end[at]
                    hashes = W.word_hashes(buf, *W.spans(buf, offs, W.SPACED)[:2])[at]
                else:
                    hashes = W.word_hashes(buf, start, end)
                got = np.array(found_runs(hashes, first, least, exponent), np.int64).reshape(-1, 3)
                stay = np.zeros(len(start) + 1, np.int64)
                np.add.at(stay, got[:, 0] + got[:, 2], 1)
                np.add.at(stay, got[:, 0] + got[:, 1], -1)
                stay = np.cumsum(stay[:-1]) == 0
                left = np.append(0, np.cumsum(stay))[first]
                data, to = joined_words(buf, start[stay], end[stay], left)
                row = np.searchsorted(first, got[:, 0], "right") - 1
                got[:, 0] -= first[row]
                order = np.lexsort((got[:, 2], got[:, 0], -got[:, 1], row))
                best = order[np.flatnonzero(np.append(True, row[order][1:] != row[order][:-1]))] if len(order) else order
                number = np.bincount(row, minlength=r1 - r0)
                top = np.zeros((r1 - r0, 3), np.int64)
                top[row[best]] = got[best]
                none = number == 0
                long = lambda x, m=None: pa.array(np.ascontiguousarray(x, np.int64), mask=m)
                listed = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(number)).astype(np.int32)), pa.StructArray.from_arrays([long(got[:, k]) for k in range(3)], ["start", "length", "period"]))
                words = pa.Array.from_buffers(pa.large_string(), r1 - r0, [None, pa.py_buffer(to.astype(np.int64)), pa.py_buffer(data)]).cast(pa.string())
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(r0, r1 - r0) for c in keep), long(counts), long(number), *(long(top[:, k], none) for k in range(3)), long(1000 * top[:, 1] // np.maximum(top[:, 2], 1), none), listed.cast(kind), words],
                    [*keep, *_NEW],
                )

    return docs.select(*cols).mapInArrow(cut, schema)


def _weave(batch: pa.RecordBatch, row: int, n: int) -> tuple[int, int] | None:
    """The contract's repetition: (a, p) for every tenth document by the checksum of its id, none for a null id."""
    if (d := batch.column("doc_id")[row].as_py()) is None:
        return None
    h = zlib.crc32(str(d).encode())
    g = h // 10
    a = g % n
    return (a, 1 + (n - a) // (3 + g % 8)) if h % 10 == 0 else None


def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs and texts as digests."""
    for batch in batches:
        listed, texts = batch.column("runs"), batch.column("collapsed").cast(pa.binary())
        flat, offs = [f.to_numpy().tolist() for f in listed.flatten().flatten()], listed.offsets.to_numpy() - listed.offsets[0].as_py()
        sums = []
        for r in range(batch.num_rows):
            sums.append(hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in zip(*(f[offs[r] : offs[r + 1]] for f in flat), strict=True)).encode()).hexdigest())
        texts = [hashlib.sha256(t.as_buffer()).hexdigest() for t in texts]
        names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(sums), pa.array(texts)], [*names, "runs_sha256", "collapsed_sha256"])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return collapse(docs, woven=_weave).mapInArrow(digest, f"doc_id {kind}, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string")
