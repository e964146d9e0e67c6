"""Count-min sketches: each task fills a sketch of fixed size, and the tasks' sketches are merged by addition.

A task's sketch is `depth` rows of 2**bits counters. Only "twice or more" is asked, so a counter stops at 2: it is a bit
in each of two bitmaps. It is sent block by block of 2**16 cells: a block with few entries as their addresses, any other
as its two bitmaps. So a task holds and sends at most its sketch, however many rows it has read. The merged counters come
back as bitmaps of cells with two entries or more.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from factloom.llm import words as W

HOT_BITS = 20
_PLAIN = 50
_BLOCK = 16
_PENDING = 1 << 19


def cells(fp: np.ndarray, bits: int, row: int) -> np.ndarray:
    return (W.mix(fp, row + 1) >> np.uint64(64 - bits)).astype(np.int64)


class Sketch:
    """Counters of 2**bits cells by row, up to 2; a counter is never below a fingerprint's true count, up to 2."""

    def __init__(self, bits: int, depth: int) -> None:
        self.bits, self.depth = bits, depth
        self.once, self.twice = np.zeros((2, depth << (bits - 3)), np.uint8)
        self.pending: list[np.ndarray] = []
        self.held = 0

    def add(self, fp: np.ndarray) -> None:
        self.pending.append(fp)
        self.held += len(fp)
        if self.held > _PENDING:
            self.settle()

    def settle(self) -> None:
        if not self.held:
            return
        fp = np.concatenate(self.pending)
        self.pending, self.held = [], 0
        for k in range(self.depth):
            at = np.sort(cells(fp, self.bits, k)) + (k << self.bits)
            mask = np.uint8(128) >> (at & 7).astype(np.uint8)
            again = np.where(np.append(False, at[1:] == at[:-1]), mask, np.uint8(0))
            at >>= 3
            starts = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
            at, mask, again = at[starts], np.bitwise_or.reduceat(mask, starts), np.bitwise_or.reduceat(again, starts)
            self.twice[at] |= self.once[at] & mask | again
            self.once[at] |= mask

    def parts(self) -> Iterator[tuple[int, bytes, bool]]:
        """(block, its entries, whether they are bitmaps) of the blocks that have any."""
        self.settle()
        size = 1 << (_BLOCK - 3)
        for block in range(len(self.once) // size):
            once, twice = (x[block * size : (block + 1) * size] for x in (self.once, self.twice))
            if not once.any():
                continue
            at = np.concatenate([np.flatnonzero(np.unpackbits(x)) for x in (once, twice)]).astype(np.uint16)
            yield (block, at.tobytes(), False) if len(at) < size else (block, once.tobytes() + twice.tobytes(), True)


def merged(total: np.ndarray, part: bytes, whole: bool) -> None:
    """Add a task's block to total."""
    if whole:
        total += np.unpackbits(np.frombuffer(part, np.uint8)).reshape(2, -1).sum(0, dtype=np.int64)
    else:
        total += np.bincount(np.frombuffer(part, np.uint16), minlength=1 << _BLOCK)


def count(texts: DataFrame, fingerprints: Callable[[np.ndarray, np.ndarray], np.ndarray], bits: int, depth: int, hot: int = 0) -> tuple[bytes, bytes]:
    """(bits of the cells with two entries or more, row by row; bits of the hot cells) over the fingerprints of all
    texts (one column, text). Hot are the cells, of 2**HOT_BITS plain counters that each task adds up besides where hot
    is given, with so many entries and eight times the mean."""
    blocks = depth << (bits - _BLOCK)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, plain = Sketch(bits, depth), np.zeros(1 << HOT_BITS if hot else 0, np.int64)
        for batch in batches:
            for _, _, buf, offs in W.slices(batch.column("text")):
                fp = fingerprints(buf, offs)
                sketch.add(fp)
                if hot:
                    plain += np.bincount(cells(fp, HOT_BITS, _PLAIN), minlength=1 << HOT_BITS)
        held, size = [], 0
        record = lambda: pa.RecordBatch.from_arrays([pa.array([x[0] for x in held], pa.int32()), pa.array([x[1] for x in held], pa.binary()), pa.array([x[2] for x in held], pa.bool_())], ["block", "part", "whole"])
        counters = ((blocks + k, p.astype(np.min_scalar_type(int(p.max()))).tobytes(), True) for k, p in enumerate(plain.reshape(-1, 1 << _BLOCK)) if p.any())
        for part in chain(sketch.parts(), counters):
            held.append(part)
            size += len(part[1])
            if size > 4 << 20:
                yield record()
                held, size = [], 0
        if held:
            yield record()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, total = None, np.zeros(1 << _BLOCK, np.int64)
        out = lambda: pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([np.packbits(total >= 2).tobytes() if block < blocks else total.tobytes()], pa.binary())], ["block", "got"])
        for batch in batches:
            for b, part, whole in zip(*(batch.column(c).to_pylist() for c in ("block", "part", "whole")), strict=True):
                if b != block:
                    if block is not None:
                        yield out()
                    block, total = b, np.zeros(1 << _BLOCK, np.int64)
                if b < blocks:
                    merged(total, part, whole)
                else:
                    total += np.frombuffer(part, f"u{len(part) >> _BLOCK}").astype(np.int64)
        if block is not None:
            yield out()

    got = texts.mapInArrow(fill, "block int, part binary, whole boolean").repartition("block").sortWithinPartitions("block").mapInArrow(merge, "block int, got binary")
    size = 1 << (_BLOCK - 3)
    twice, plain = bytearray(blocks * size), np.zeros(1 << HOT_BITS, np.int64)
    for r in got.toLocalIterator():
        if r.block < blocks:
            twice[r.block * size : (r.block + 1) * size] = r.got
        else:
            plain[(r.block - blocks) << _BLOCK :][: 1 << _BLOCK] = np.frombuffer(r.got, np.int64)
    return bytes(twice), np.packbits(plain >= max(hot, 8 * plain.mean())).tobytes() if hot else b""


def is_hot(hot: np.ndarray, fp: np.ndarray) -> np.ndarray:
    return _bits(hot, cells(fp, HOT_BITS, _PLAIN))


def _bits(packed: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (packed[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 > 0


def repeated(twice: np.ndarray, fp: np.ndarray, bits: int, depth: int) -> np.ndarray:
    """Which fingerprints may have come twice or more; none that has is missing."""
    ok = np.ones(len(fp), bool)
    for k in range(depth):
        ok &= _bits(twice, cells(fp, bits, k) + (k << bits))
    return ok
