"""LM scoring by online logistic context mixing.

A text is its tokens and one end. A token is coded by binary decisions along a Huffman tree of the HEAD most frequent
training words, the end and an escape; an escaped word is spelled by a Huffman tree of bytes, up to a closing space.
Words that training has once are spelled too, so the escape and the spelling are learnt from words that are as rare as
unseen ones. Each decision gets a prediction from hashed contexts of two kinds:

* of the corpus, TABLES of them (words: the last very frequent word, the last known word; bytes: the two and four before), with counts from all training documents. Their number of slots follows the training tokens, from
  2**MIN_BITS to 2**MAX_BITS. Training documents fall into two halves by a hash of their doc_id and are scored by the
  other half's counts, so no text is scored by its own;
* of the text itself, one (words: none; bytes: the two before), which starts empty.

The logits are mixed by weights that a gate picks by the contexts' confidence. A text starts from weights that are
learnt on all training documents, task by task, and averaged; its weights and its own counts are refined online, after each of its first
runs of RUN tokens and then as often as it has grown by an eighth. So a text's score is a log10 probability of all of its
decisions, whatever stands in other rows.

Word counts are exact and grouped over the corpus; the base score joins each rare word with its count, while the HEAD
words' counts are broadcast.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import words as W
from factloom.llm.shared import spent, table, written

HEAD = 1 << 18
MIN_BITS, MAX_BITS = 16, 21
RUN, GROWTH = 8, 8
TABLES, OWN_BITS = 2, 12
FREQUENT = 128
#: Of a text's refinement, its greatest step, and of learning the weights it starts from.
RATE, STEP, LEARN = 0.01, 0.1, 0.02
END, ESCAPE = 0, 1
INPUTS = TABLES + 2
_GATES = 16
_START = 0xFFFFFFF
_SLICE, _TOGETHER = 1536 << 10, 8 << 20
#: Tokens whose decisions are counted at a time.
_PIECE = 1 << 12
_BIAS = np.float32(0.3)


def slot_bits(tokens: int) -> int:
    return min(MAX_BITS, max(MIN_BITS, max(1, tokens).bit_length() + 2))


def huffman(counts: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each symbol its path: offsets into nodes (inner nodes, from the root) and bits."""
    n = len(counts)
    leaves = np.argsort(np.array(counts), kind="stable").tolist()
    up, bit = np.full(2 * n - 1, -1, np.int32), np.zeros(2 * n - 1, np.uint8)
    weights: list[int] = []
    i = j = 0
    for k in range(n - 1):
        total = 0
        for b in (0, 1):
            if j >= len(weights) or i < n and counts[leaves[i]] <= weights[j]:
                x, w, i = leaves[i], counts[leaves[i]], i + 1
            else:
                x, w, j = n + j, weights[j], j + 1
            up[x], bit[x] = n + k, b
            total += w
        weights.append(total)
    at, nodes, bits = np.arange(n), [], []
    while (up[at] >= 0).any():
        inside = up[at] >= 0
        nodes.append(np.where(inside, up[at] - n, -1))
        bits.append(bit[at])
        at = np.where(inside, up[at], at)
    nodes, bits = (np.array(x[::-1]).T.reshape(n, -1) for x in (nodes, bits))  # from the root
    some = nodes >= 0
    return np.append(0, np.cumsum(some.sum(1))).astype(np.int64), nodes[some].astype(np.int32), bits[some].astype(np.uint8)


def ends_of_runs(tokens: int) -> np.ndarray:
    """The places after which a text of so many tokens is refined, the last one at its end or beyond."""
    out = [RUN]
    while out[-1] < tokens:
        out.append(out[-1] + max(RUN, out[-1] // GROWTH))
    return np.array(out)


class Coder:
    """Tokens to decisions. head: training words and their counts, most frequent first; rest: other training tokens."""

    def __init__(self, head: list[tuple[bytes, int]], docs: int, rest: int) -> None:
        self.head = b" ".join(w for w, _ in head)
        self.count = np.array([docs, 0, *(c for _, c in head)], np.int64)
        self.bits = slot_bits(int(self.count.sum()) + rest)
        letters = np.bincount(np.frombuffer(self.head + b" ", np.uint8), minlength=256)
        #: A tree's paths: offsets, hashes of the nodes, bits. The two trees' nodes are different contexts.
        self.words, self.letters = (
            (offsets, _mixed((nodes.astype(np.uint32) + np.uint32(1)) * np.uint32(0x9E3779B1) + np.uint32(k)), bits)
            for k, (offsets, nodes, bits) in enumerate((huffman([docs + 1, rest + 1, *(c + 1 for _, c in head)]), huffman((letters + 1).tolist())))
        )
        self.known = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"known": None}

    def symbols(self, h: np.ndarray) -> np.ndarray:
        """The symbols of words by their hashes; ESCAPE for words that aren't of the head."""
        if self.known is None:
            buf = np.frombuffer(self.head, np.uint8)
            own = W.word_hashes(buf, *W.spans(buf, np.array([0, len(buf)]), W.SPACED)[:2])
            order = np.argsort(own)
            own = own[order]
            self.known = np.append(own, np.uint64(0)), np.append(order + 2, ESCAPE).astype(np.int32), np.searchsorted(own, np.arange(1 << 18, dtype=np.uint64) << np.uint64(46)).astype(np.int32)
        own, symbols, first = self.known
        at = first.take((h >> np.uint64(46)).astype(np.int32))
        out = np.full(len(h), ESCAPE, np.int32)
        todo = np.arange(len(h))
        while len(todo):
            got, want = own.take(at), h.take(todo)
            hit = got == want
            out[todo[hit]] = symbols.take(at[hit])
            on = (got < want) & (at < len(own) - 1)
            todo, at = todo[on], at[on] + 1
        return out

    def tokens(self, buf: np.ndarray, offs: np.ndarray) -> Tokens:
        low = W.LOWER[buf]
        start, end, first = W.spans(low, offs, W.SPACED)
        rows = len(offs) - 1
        n = np.diff(first) + 1
        row = np.repeat(np.arange(rows, dtype=np.int32), n)
        begin = np.cumsum(n) - n
        sym = np.full(len(row), END, np.int32)
        inner = np.ones(len(row), bool)
        inner[begin + n - 1] = False
        sym[inner] = self.symbols(W.word_hashes(low, start, end))
        first = np.repeat(begin.astype(np.int32), n)
        last = [_last(sym, ok, first) for ok in ((sym > ESCAPE) & (sym < 2 + FREQUENT), sym > ESCAPE)]
        terms = [_mixed(x.astype(np.uint32) * np.uint32(p)) for x, p in zip(last, (0x2C1B3C6D, 0x297A2D39), strict=True)]
        return Tokens(low, start, end, sym, row, np.arange(len(row), dtype=np.int32) - first, n, np.cumsum(inner) - 1, terms)

    def decisions(self, t: Tokens, order: np.ndarray | None = None):
        """For the words and then the bytes of the tokens: (slots by table, slots of the text's own context, bits, and
        the decisions' tokens), in the tokens' order or the one given."""
        order = np.arange(len(t.sym)) if order is None else order
        sym = _at(t.sym, order)
        slots, own, bits, of = self._paths(self.words, sym, [_at(x, order) for x in t.terms], None)
        yield slots, own, bits, _at(order, of)
        at = order[sym == ESCAPE]
        word = t.word.take(at)
        sizes = t.end.take(word) - t.start.take(word) + 1
        text = np.full(int(sizes.sum()), 0x20, np.uint8)
        begin = np.cumsum(sizes) - sizes
        inside = np.arange(len(text)) - np.repeat(begin, sizes)
        letter = np.repeat(sizes - 1, sizes) > inside
        text[letter] = t.low.take((np.repeat(t.start.take(word), sizes) + inside)[letter])
        context, terms = np.full(len(text), 7, np.uint32), []
        for k in range(1, 5):
            before = np.full(len(text), 0x20, np.uint32)
            before[k:] = text[:-k]
            before[inside < k] = 0x20
            context = (context + before) * np.uint32(0x01000193)
            if k % 2 == 0:
                terms.append(_mixed(context + np.uint32(k)))
        slots, own, bits, of = self._paths(self.letters, text, terms, terms[0])
        yield slots, own, bits, _at(np.repeat(at, sizes), of)

    def _paths(self, tree: tuple, sym: np.ndarray, corpus: list[np.ndarray], own: np.ndarray | None):
        """(slots by table, slots of the text's own context, bits, indexes of symbols) along each symbol's path; corpus, own: contexts' hashes."""
        offsets, nodes, bits = tree
        sym = sym.astype(np.int64)
        begin = _at(offsets, sym)
        n = _at(offsets, sym + 1) - begin
        of = np.repeat(np.arange(len(sym)), n)
        at = np.repeat(begin - (np.cumsum(n) - n), n)
        at += np.arange(len(of))
        node = _at(nodes, at)
        slots = [self._slots(node, np.repeat(t, n), self.bits) for t in corpus]
        own = (node >> np.uint32(32 - OWN_BITS)).astype(np.int64) if own is None else self._slots(node, np.repeat(own * np.uint32(3), n), OWN_BITS)
        return slots, own, _at(bits, at), of

    @staticmethod
    def _slots(node: np.ndarray, context: np.ndarray, bits: int) -> np.ndarray:
        """Both are hashes, so one product spreads them. context is written over."""
        context ^= node
        context *= np.uint32(0x85EBCA6B)
        context >>= np.uint32(32 - bits)
        return context.astype(np.int64)


class Tokens(NamedTuple):
    """Tokens of texts in order: symbols, rows, places within the row; n: tokens by row; word: the token's index among the words, whose bytes are low[start:end]; terms: hashes of the words' contexts, by table."""

    low: np.ndarray
    start: np.ndarray
    end: np.ndarray
    sym: np.ndarray
    row: np.ndarray
    place: np.ndarray
    n: np.ndarray
    word: np.ndarray
    terms: list[np.ndarray]


def _at(x: np.ndarray, i: np.ndarray) -> np.ndarray:
    """x.take(i) for indexes that are known to be within x, without the slow check of them."""
    return x.take(i, mode="clip")


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x * np.uint32(0x85EBCA6B)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0xC2B2AE35)
    return x


def _last(s: np.ndarray, ok: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each token the last one before it in its text (which begins at first) that is ok."""
    at = np.maximum.accumulate(np.where(ok, np.arange(len(s), dtype=np.int32), np.int32(-1)))
    at = np.append(np.int32(-1), at[:-1])
    return np.where(at >= first, s.take(at), np.int32(_START))


def read(zero: np.ndarray, one: np.ndarray) -> np.ndarray:
    """Counts as 16 bits, so that a look-up touches little memory: the logit in steps of 1 / 512, then the confidence, 0 to 3."""
    zero, one = zero.astype(np.float32), one.astype(np.float32)
    n = zero + one
    sure = (n >= 1).astype(np.int16) + (n >= 4) + (n >= 32)
    return np.rint(np.log((one + np.float32(0.4)) / (zero + np.float32(0.4))) * 512).astype(np.int16) << 2 | sure


#: By the counts of a text's own context, each up to 31.
_OWN_LOGITS = read(*(x.ravel() for x in np.divmod(np.arange(1024), 32)))


def first_weights() -> np.ndarray:
    """By kind of decision (words, bytes), gate and input."""
    return np.tile(np.array([0.4] * (TABLES + 1) + [0.0]), (2, _GATES, 1))


class Mixer:
    """Gated mixing of the contexts' logits. packed: by table, logits by half (0 and 1: without the documents of the
    half; 2: all) and slot, as read() gives them."""

    def __init__(self, packed: np.ndarray, weights: np.ndarray | None = None) -> None:
        self.packed = packed
        self.weights = first_weights() if weights is None else weights

    def run(self, t: Tokens, halves: np.ndarray, coder: Coder, grads: list | None = None) -> np.ndarray:
        """Natural-log probability of each row; or, with grads, no probabilities but each refinement's gradients by kind."""
        rank = np.empty(len(t.n), np.int32)
        longest = np.argsort(-t.n, kind="stable")  # so that the rows that go on are the first ones
        rank[longest] = np.arange(len(t.n))
        sizes = t.n[longest]
        runs = ends_of_runs(int(sizes[0]))
        step = np.repeat(np.arange(len(runs)), np.diff(runs, prepend=0)).take(t.place)
        on = np.searchsorted(-sizes, -runs, "left").tolist()
        offset = (halves.astype(np.int64) << coder.bits).take(t.row)
        row = _at(rank, t.row).astype(np.int64)
        order = np.argsort(step * len(t.n) + row, kind="stable")
        ends = np.cumsum(np.bincount(step, minlength=len(runs))).tolist()
        total = np.zeros(len(t.n))
        states = [self._start(kind, len(t.n)) for kind in range(2)]
        for a, b, some in zip([0, *ends], ends, on, strict=False):  # a run at a time, so that its arrays stay in the core's cache
            for kind, (slots, own, bits, of) in enumerate(coder.decisions(t, order[a:b])):
                half = _at(offset, of)
                self._code([_at(p, s + half) for p, s in zip(self.packed, slots, strict=True)], own, bits, _at(row, of), [len(bits)], [some], kind, total, grads, states[kind])
        return total[rank]

    def _start(self, kind: int, rows: int) -> tuple[list[np.ndarray], np.ndarray]:
        """Weights by input, row and gate, and the rows' own counts (the low half those of bit 1, the high half those of 0)."""
        return [np.tile(w, rows) for w in self.weights[kind].T.astype(np.float32)], np.zeros(rows << OWN_BITS, np.int32)

    def _code(self, raw, own, bits, rows, ends, on, kind, total, grads, state=None) -> None:
        """Adds the log probabilities of decisions to total. ends: by refinement where its decisions end, whose rows
        ascend; on: how many rows go on after it; state: of _start(), refined."""
        weights, seen = state or self._start(kind, len(total))
        for a, b, some in zip([0, *ends], ends, on, strict=False):
            if a == b:
                continue
            row = rows[a:b].astype(np.int64, copy=False)
            first, second = (r[a:b] for r in raw)
            at = row << 4
            at |= (first & 3) << 2 | second & 3
            place = (row << OWN_BITS) + own[a:b]
            v = np.minimum(_at(seen, place).view(np.uint16), 31).view(np.int32)
            inputs = [(v >> 2) * np.float32(1 / 512) for v in (first, second, _at(_OWN_LOGITS, (v >> 11 | v) & 1023))]
            sign = (bits[a:b].view(np.int8) * 2 - 1).astype(np.float32)
            x = _at(weights[-1], at)
            x *= _BIAS
            for w, v in zip(weights, inputs, strict=False):
                x += _at(w, at) * v
            np.clip(x, -20, 20, out=x)
            x *= -sign
            e = np.exp(x, out=x)  # the other bit's odds
            odds = e + 1
            if grads is not None:
                some = len(total)
            else:
                starts = np.append(0, np.flatnonzero(row[1:] != row[:-1]) + 1)
                total[row.take(starts)] -= np.add.reduceat(np.log(odds), starts)
                if not some:
                    continue
            error = e
            error /= odds
            error *= sign
            if (m := int(np.searchsorted(row, some))) < len(row):
                at, error, inputs, place = at[:m], error[:m], [v[:m] for v in inputs], place[:m]
            change = [np.bincount(at, error * v, some * _GATES).astype(np.float32) for v in inputs] + [np.bincount(at, error, some * _GATES).astype(np.float32) * _BIAS]
            if grads is not None:
                grads.append((kind, np.stack([g.reshape(-1, _GATES).sum(0) for g in change], 1)))
            for w, g in zip(weights, change, strict=True):
                w[: len(g)] += np.clip(np.float32(RATE) * g, -STEP, STEP)
            np.add.at(seen, place, np.int32(1 << 16) - bits[a : a + m] * np.int32(0xFFFF))

    def learn(self, t: Tokens, halves: np.ndarray, coder: Coder, seen: np.ndarray) -> None:
        """Refine the weights that texts start from. seen: squares of the gradients so far."""
        grads: list = []
        self.run(t, halves, coder, grads)
        for kind, g in grads:
            seen[kind] += g * g
            self.weights[kind] += LEARN * g / np.sqrt(seen[kind])


def _crc(doc_id) -> int:
    return zlib.crc32(str(doc_id).encode())


def _half(doc_id) -> int:
    """0 or 1 for a training document, 2 for any other."""
    return 2 if doc_id is None or _crc(doc_id) % 7 == 2 else _crc(doc_id) // 7 % 2


def _rows(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    """(doc_ids, halves, bytes, offsets) of runs of rows."""
    ids = batch.column("doc_id")
    for r0, r1, buf, offs in W.slices(batch.column("text"), _SLICE):
        yield ids[r0:r1], np.array([_half(i) for i in ids[r0:r1].to_pylist()], np.int8), buf, offs


def word_counts(docs: DataFrame) -> DataFrame:
    """(word: binary, c: long) over the training documents' words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def out() -> pa.RecordBatch:
            low, start, end, h = (np.concatenate(x) for x in zip(*held, strict=True))
            at = np.append(0, np.cumsum([len(x[0]) for x in held]))[np.repeat(np.arange(len(held)), [len(x[1]) for x in held])]
            order = np.argsort(h)
            h = h[order]
            new = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
            one, n = order[new], np.diff(new, append=len(h))
            data = low.tobytes()
            words = [data[a:b] for a, b in zip((start + at)[one].tolist(), (end + at)[one].tolist(), strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(n.astype(np.int64))], ["word", "c"])

        for batch in batches:
            for _, halves, buf, offs in _rows(batch):
                low = W.LOWER[buf]
                start, end, first = W.spans(low, offs, W.SPACED)
                some = np.repeat(halves < 2, np.diff(first))
                start, end = start[some], end[some]
                if len(start):
                    held.append((low, start, end, W.word_hashes(low, start, end)))
                    size += len(low)
                if size > _TOGETHER:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    return docs.mapInArrow(count, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def _tables(docs: DataFrame, coder, bits: int) -> np.ndarray:
    """Logits (table, half and slot) over all training documents, as Mixer has them.

    Two tasks a core hold and send their counters, whatever the number of rows.
    """
    size, block = 1 << bits, 1 << 15
    tasks = max(2, 2 * docs.sparkSession.sparkContext.defaultParallelism)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, one = np.zeros((TABLES, 4 * size), np.uint32), np.uint32(1)  # by slot: half and bit
        for batch in batches:
            for _, halves, buf, offs in _rows(batch):
                t = coder.value.tokens(buf, offs)
                low = (2 * halves.astype(np.int32)).take(t.row)
                learnt = np.flatnonzero(low < 4)
                for a in range(0, len(learnt), _PIECE):
                    for slots, _, bit, of in coder.value.decisions(t, learnt[a : a + _PIECE]):
                        which = _at(low, of) + bit
                        for k, x in enumerate(slots):
                            np.add.at(total[k], x * 4 + which, one)
        for k, part in enumerate(total.reshape(-1, 4 * block)):
            if part.any():
                yield pa.RecordBatch.from_pydict({"block": pa.array([k], pa.int32()), "counts": pa.array([part.astype(np.min_scalar_type(int(part.max()))).tobytes()], pa.binary())})

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A block's counts by the halves' absence: 0 has those of half 1, 1 those of half 0, 2 both."""
        key, held = None, np.zeros(4 * block, np.int64)

        def out() -> pa.RecordBatch:
            n = held.reshape(-1, 2, 2)
            return pa.RecordBatch.from_pydict({"block": pa.array([key], pa.int32()), "logits": pa.array([np.stack([read(x[:, 0], x[:, 1]) for x in (n[:, 1], n[:, 0], n.sum(1))]).tobytes()], pa.binary())})

        for batch in batches:
            for b, c in zip(batch.column("block").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                if b != key:
                    if key is not None:
                        yield out()
                    key, held = b, np.zeros(4 * block, np.int64)
                held += np.frombuffer(c, f"u{len(c) // (4 * block)}").astype(np.int64)
        if key is not None:
            yield out()

    packed = np.zeros((TABLES, 3, size), np.int16)
    for r in docs.coalesce(tasks).mapInArrow(count, "block int, counts binary").repartition("block").sortWithinPartitions("block").mapInArrow(merge, "block int, logits binary").toLocalIterator():
        t, k = divmod(r.block * block, size)
        packed[t, :, k : k + block] = np.frombuffer(r.logits, np.int16).reshape(3, -1)
    return packed.reshape(TABLES, -1)


def _weights(learnt: DataFrame, coder, tables) -> np.ndarray | None:
    """The weights that texts start from: each task refines them along all of its documents, and the tasks' weights are
    averaged by their numbers of documents. None without any."""

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mixer, seen, n = Mixer(tables.value), np.full((2, _GATES, INPUTS), 1e-6), 0
        for batch in batches:
            for ids, halves, buf, offs in _rows(batch):
                mixer.learn(coder.value.tokens(buf, offs), halves, coder.value, seen)
                n += len(ids)
        if n:
            yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64()), "weights": pa.array([mixer.weights.ravel()], pa.list_(pa.float64()))})

    got = learnt.mapInArrow(weigh, "n long, weights array<double>").collect()
    return np.average([r.weights for r in got], 0, [r.n for r in got]).reshape(2, _GATES, INPUTS) if got else None


def score(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) for every row.

    A null text counts as empty: its one token is the end. A row without a doc_id is scored, but neither learnt from
    nor held out. Repeated rows are learnt from as often as they stand, and get equal results. Without training
    documents the base is 0 and the mixer spells every word. A very long text is one task's work at a time. Words that
    are as frequent rank by their bytes. An empty table gives no rows; columns other than doc_id and text don't matter.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    counts = written(word_counts(docs), "counts")
    n_words, kinds = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    n_docs = docs.filter(crc % 7 != 2).count()
    total, distinct = n_words + n_docs, kinds + (n_docs > 0)
    head = counts.filter("c > 1").orderBy(F.desc("c"), "word").limit(HEAD).toArrow()
    head = list(zip(head.column("word").to_pylist(), head.column("c").to_pylist(), strict=True))
    coder = Coder(head, n_docs, n_words - sum(c for _, c in head))
    bits = coder.bits
    coder = spark.sparkContext.broadcast(coder)
    tables = spark.sparkContext.broadcast(_tables(docs, coder, bits))

    weights = spark.sparkContext.broadcast(_weights(docs.filter(crc % 7 != 2), coder, tables))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mixer, c = Mixer(tables.value, weights.value), coder.value
        logs = np.log10(c.count + 1.0)
        for batch in batches:
            for ids, halves, buf, offs in _rows(batch):
                t = c.tokens(buf, offs)
                p = mixer.run(t, halves, c) / math.log(10)
                rows = len(offs) - 1
                common = np.flatnonzero(t.sym != ESCAPE)
                row, sym = t.row.take(common), t.sym.take(common)
                rare = np.flatnonzero(t.sym == ESCAPE)
                word = t.word.take(rare)
                data = t.low.tobytes()
                words = pa.array([data[a:b] for a, b in zip(t.start.take(word).tolist(), t.end.take(word).tolist(), strict=True)], pa.binary())
                bounds = np.append(0, np.cumsum(np.bincount(t.row.take(rare), minlength=rows))).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(t.n.astype(np.int64)), pa.array(np.bincount(row, c.count.take(sym) > 0, rows).astype(np.int64)), pa.array(np.bincount(row, logs.take(sym), rows)), pa.array(p), pa.array(np.diff(offs)), pa.ListArray.from_arrays(pa.array(bounds), words)],
                    ["doc_id", "n_tokens", "known", "base", "score", "size", "words"],
                )

    scored = docs.mapInArrow(run, f"doc_id {kind}, n_tokens long, known long, base double, score double, size long, words array<binary>")
    scored = written(scored.withColumn("row", F.monotonically_increasing_id()), "scored")
    rare = scored.select("row", F.explode("words").alias("word"))
    rare = written(rare.join(counts, "word").groupBy("row").agg(F.count("*").alias("more"), F.sum(F.log10(F.col("c") + 1)).alias("plus")), "rare")
    spent(counts)
    out = scored.drop("words").join(rare, "row", "left")
    return out.select(
        "doc_id",
        F.coalesce(crc % 7 == 2, F.lit(False)).alias("held_out"),
        "n_tokens",
        (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("plus", F.lit(0.0)) - F.col("n_tokens") * F.lit(math.log10(total + distinct + 1))).alias("base_score"),
        "score",
        (-F.col("score") * F.lit(math.log2(10)) / F.greatest(F.lit(1), F.col("size"))).alias("bits_per_byte"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
