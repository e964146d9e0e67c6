"""BPE encoding and decoding with content-defined chunk reuse.

A rolling hash over the last SPAN bytes cuts every text where its low bits are nil, so that equal passages fall into
equal chunks whatever stands before them. Chunks that documents share are encoded once: the SHARED most frequent ones
over all documents by one task each, their codes are broadcast (SHARED bounds them), and the others once a task, in a
dictionary that is emptied at CACHE_BYTES; so is that of pieces at PIECE_BYTES (`cached`). A cut may fall within a word. So each join is repaired: the pieces on both
sides are glued and encoded anew with a neighbour on either side; where the neighbours' codes don't agree with those that
the chunks hold, the whole text is encoded instead. A chunk's inside is put together from its pieces' codes.

Pieces are what ASCII spaces and line feeds part. The tokenizer's words never reach across these, and its normaliser
never composes across them, so the codes of a text are those of its pieces in order.
"""

from __future__ import annotations

import hashlib
import os
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from factloom.llm import words as W
from factloom.llm.shared import table

SPAN = 16
CHUNK_BITS = 11
SHARED = 4096
CACHE_BYTES = 24 << 20
PIECE_BYTES = 72 << 20
#: The pipeline's stage, whose workers share an executor with what other stages have left, keeps less of both, for some more time.
STAGE_BYTES = (6 << 20, 16 << 20)
_TOGETHER, _SLICE = 4096, 1 << 20
_PLAIN = 512
#: ASCII signs but the apostrophe, which contractions have.
SIGNS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def cuts(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Ends of chunks by the rolling hash, within rows and between code points; rows' own ends aren't among them."""
    h = buf.astype(np.uint32) * np.uint32(0x9E3779B1) + np.uint32(0x85EBCA6B)
    h ^= h >> np.uint32(15)
    step, factor = 1, 0x2C1B3C6D
    while step < SPAN:
        rolled = h.copy()
        rolled[step:] += h[:-step] * np.uint32(factor)
        h, step, factor = rolled, step * 2, factor * factor & 0xFFFFFFFF
    h ^= h >> np.uint32(16)
    h *= np.uint32(0x7FEB352D)
    at = np.flatnonzero(h[:-1] >> np.uint32(32 - CHUNK_BITS) == 0) + 1 if len(h) else np.zeros(0, np.int64)
    at = at[(buf[at] & 0xC0) != 0x80]
    row = np.searchsorted(offs, at, "right") - 1
    return at[at - offs[row] >= SPAN]


def chunks(buf: np.ndarray, offs: np.ndarray) -> Iterator[list[bytes]]:
    """The chunks of each row."""
    at = cuts(buf, offs)
    bounds = np.searchsorted(at, offs)
    data = buf.tobytes()
    at = at.tolist()
    for i in range(len(offs) - 1):
        a, out = int(offs[i]), []
        for b in (*(x for x in at[bounds[i] : bounds[i + 1]] if x > a), int(offs[i + 1])):
            out.append(data[a:b])
            a = b
        yield out


def digest(chunk: bytes) -> bytes:
    return hashlib.blake2b(chunk, digest_size=16).digest()


def least_words(piece: bytes) -> int:
    """1 for letters, 2 for letters with signs behind them, and 0 where nothing is known."""
    text = piece.decode()
    if text.isalpha():
        return 1
    return 2 if text.rstrip(SIGNS).isalpha() else 0


class Coder:
    """Codes of pieces, chunks and texts. A code is the ids as little-endian 32-bit numbers; what they decode to is put together
    from the vocabulary where a text is whole."""

    def __init__(self, path: str, shared: dict[bytes, tuple], most: tuple[int, int] = (CACHE_BYTES, PIECE_BYTES)) -> None:
        self.most = most
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        vocabulary_ = self.tokenizer.get_vocab()
        self.spelled = [b""] * (max(vocabulary_.values(), default=-1) + 1)
        for token, i in vocabulary_.items():
            self.spelled[i] = token.encode()
        del vocabulary_
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        #: Tokens that end a word, where the vocabulary marks them and letters are words apart from signs.
        self.ends = np.array([t.endswith(suffix.encode()) for t in self.spelled]) if suffix else None
        if suffix and self.ends[np.frombuffer(self.library([b"a, b"])[0], "<u4")].sum() != 3:
            self.ends = None
        self.shared, self.own, self.own_bytes = shared, {}, 0
        self.pieces: dict[bytes, bytes] = {b"": b""}
        self.piece_bytes = 0

    def library(self, texts: list[bytes]) -> list[bytes]:
        return [struct.pack(f"<{len(x)}I", *x.ids) for x in self.tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)]

    def words(self, pieces: list[bytes], each: int) -> list[bytes]:
        """Codes of pieces of at least `each` words: encoded as one text and cut behind each word's last token. There are as many
        words as that only if each piece has no more; else every piece is encoded by itself."""
        (whole,) = self.library([b" ".join(pieces)])
        at = 4 * np.flatnonzero(self.ends[np.frombuffer(whole, "<u4")]) + 4
        if len(at) != each * len(pieces):
            return self.library(pieces)
        at = at[each - 1 :: each].tolist()
        return [whole[a:b] for a, b in zip([0, *at], at, strict=False)]

    def decoded(self, code: bytes) -> bytes:
        ids = np.frombuffer(code, "<u4").tolist()
        if self.tokenizer.decoder is not None:
            return self.tokenizer.decode(ids, skip_special_tokens=False).encode()
        return b" ".join([self.spelled[i] for i in ids])

    def learn(self, pieces: set[bytes]) -> None:
        if new := [p for p in pieces if p not in self.pieces]:
            if self.piece_bytes > self.most[1]:
                self.pieces = {p: self.pieces[p] for p in pieces if p in self.pieces} | {b"": b""}
                self.piece_bytes = sum(200 + len(p) + len(c) for p, c in self.pieces.items())
            kinds: tuple[list[bytes], ...] = ([], [], [])
            for p in new:
                kinds[least_words(p) if self.ends is not None else 0].append(p)
            for each, ps in enumerate(kinds):
                run = _PLAIN if each else _TOGETHER
                for k in range(0, len(ps), run):  # the library's own objects are large
                    part = ps[k : k + run]
                    codes = self.words(part, each) if each else self.library(part)
                    self.pieces.update(zip(part, codes, strict=True))
                    self.piece_bytes += sum(map(len, codes)) + sum(map(len, part)) + 200 * len(codes)

    def piece(self, p: bytes) -> bytes:
        if (got := self.pieces.get(p)) is None:
            got = self.pieces[p] = self.library([p])[0]
            self.piece_bytes += 200 + len(p) + len(got)
        return got

    def chunk(self, pieces: list[bytes]) -> tuple:
        """(first piece, code of the inner ones, last piece, the inner ones' first and last); one piece alone: (it,)."""
        if len(pieces) == 1:
            return (pieces[0],)
        inner = [p for p in pieces[1:-1] if p]
        known = self.pieces
        return pieces[0], b"".join([known[p] for p in inner]), pieces[-1], inner[0] if inner else b"", inner[-1] if inner else b""

    def encode(self, texts: list[list[bytes]]) -> Iterator[tuple[int, bytes, bytes]]:
        """Number of tokens, code and decoded bytes of texts given as their chunks."""
        for code in self.codes(texts):
            yield len(code) // 4, code, self.decoded(code)

    def codes(self, texts: list[list[bytes]]) -> list[bytes]:
        keys = [[digest(c) if len(c) > SPAN else c for c in t] for t in texts]
        split = {k: c.replace(b"\n", b" ").split(b" ") for t, ks in zip(texts, keys, strict=True) for c, k in zip(t, ks, strict=True) if k not in self.shared and k not in self.own}
        self.learn({p for ps in split.values() for p in ps[1:-1]})
        if self.own_bytes > self.most[0]:
            self.own, self.own_bytes = {k: self.own[k] for ks in keys for k in ks if k in self.own}, 0
        for k, ps in split.items():
            self.own[k] = got = self.chunk(ps)
            self.own_bytes += 250 + len(got[1] if len(got) > 1 else got[0])
        out, joins, of = [], [], []
        for i, ks in enumerate(keys):
            codes, carry, left = [], b"", b""
            for k in ks:
                c = self.shared.get(k) or self.own[k]
                carry += c[0]
                if len(c) > 1:
                    if codes:
                        joins.append((left, carry, c[3]))
                        of.append(i)
                    codes += [self.piece(carry), c[1]]
                    left, carry = c[4] or carry, c[2]
            out.append(b"".join([*codes, self.piece(carry)]))
        for i in {i for i, ok in zip(of, self.agree(joins), strict=True) if not ok}:
            out[i] = self.library([b"".join(texts[i])])[0]
        return out

    def agree(self, joins: list[tuple[bytes, bytes, bytes]]) -> list[bool]:
        """Whether repaired joins (left neighbour, glued piece, right neighbour), encoded with their neighbours, have the codes that these have
        apart. The window of one neighbour on each side is the widest short of the whole text that can differ, as no code reaches across a
        space."""
        anew = [code for k in range(0, len(joins), _TOGETHER) for code in self.library([b" ".join(j) for j in joins[k : k + _TOGETHER]])]
        return [code == b"".join([self.piece(p) for p in j]) for code, j in zip(anew, joins, strict=True)]


def shared_codes(docs: DataFrame, path: str, most: int = SHARED) -> dict[bytes, tuple]:
    """Codes of the `most` chunks that occur most often over all documents, of those that occur twice or more."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: dict[bytes, int] = {}
        out = lambda: pa.RecordBatch.from_arrays([pa.array(list(n), pa.binary()), pa.array(list(n.values()), pa.int64())], ["digest", "n"])
        for batch in batches:
            for _, _, buf, offs in W.slices(batch.column("text")):
                for row in chunks(buf, offs):
                    for c in row:
                        if len(c) > SPAN:
                            k = digest(c)
                            n[k] = n.get(k, 0) + 1
            if len(n) > 150_000:
                yield out()
                n.clear()
        if n:
            yield out()

    top = docs.select("text").mapInArrow(count, "digest binary, n long").groupBy("digest").agg(F.sum("n").alias("n")).filter("n > 1")
    wanted = frozenset(bytes(r.digest) for r in top.orderBy(F.desc("n"), "digest").limit(most).collect())
    if not wanted:
        return {}

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: set[bytes] = set()
        for batch in batches:
            new: dict[bytes, bytes] = {}
            for _, _, buf, offs in W.slices(batch.column("text")):
                for row in chunks(buf, offs):
                    new |= {k: c for c in row if len(c) > SPAN and (k := digest(c)) in wanted and k not in found}
            found |= new.keys()
            yield pa.RecordBatch.from_arrays([pa.array(list(new), pa.binary()), pa.array(list(new.values()), pa.binary())], ["digest", "chunk"])

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(path, {})
        for batch in batches:
            split = [c.replace(b"\n", b" ").split(b" ") for c in batch.column("chunk").to_pylist()]
            coder.learn({p for ps in split for p in ps[1:-1]})
            got = [dict(zip(("first", "ids", "last", "left", "right"), coder.chunk(ps), strict=False)) for ps in split]
            kind = pa.struct([(x, pa.binary()) for x in ("first", "ids", "last", "left", "right")])
            yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array(got, kind)], ["digest", "code"])

    texts = docs.select("text").mapInArrow(find, "digest binary, chunk binary").groupBy("digest").agg(F.min("chunk").alias("chunk"))
    out = {}
    for r in texts.mapInArrow(code, "digest binary, code struct<first:binary,ids:binary,last:binary,left:binary,right:binary>").collect():
        out[bytes(r.digest)] = tuple(bytes(x) for x in r.code if x is not None)
    return out


def encode(docs: DataFrame, path: str | None = None, digests: bool = False, most: int = SHARED, cached: tuple[int, int] = (CACHE_BYTES, PIECE_BYTES)) -> DataFrame:
    """docs' columns and n_tokens (long) with ids (array<int>) and decoded (string); or, with digests, ids_sha256 and
    decoded_sha256. A null text counts as empty and has no tokens. Columns of these names are replaced. A very long text
    is one task's work at a time. Of chunks that are as frequent the first by digest are shared, which no result depends
    on; repeated rows get equal results, and an empty table gives no rows.
    """
    path = path or vocabulary()
    names = ["n_tokens", *(("ids_sha256", "decoded_sha256") if digests else ("ids", "decoded"))]
    keep = [c for c in docs.columns if c not in names]
    shared = docs.sparkSession.sparkContext.broadcast(shared_codes(docs, path, most))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, codes, n, rest = Coder(path, shared.value, cached), None, None, None
        for batch in batches:
            for r0, r1, buf, offs in W.slices(batch.column("text"), _SLICE):
                codes = coder.codes(list(chunks(buf, offs)))
                n = pa.array([len(c) // 4 for c in codes], pa.int64())
                if digests:
                    rest = [pa.array([hashlib.sha256(x).hexdigest() for x in (f(c) for c in codes)]) for f in (bytes, coder.decoded)]
                else:
                    ids = np.frombuffer(b"".join(codes), "<u4").astype(np.int32)
                    rest = [pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum([len(c) // 4 for c in codes])).astype(np.int32)), pa.array(ids)), pa.array([coder.decoded(c) for c in codes], pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays([*(batch.column(c)[r0:r1] for c in keep), n, *rest], [*keep, *names])
        del coder, codes, n, rest
        W.release()

    cols = list(dict.fromkeys([*keep, "text"]))
    more = "n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "n_tokens long, ids array<int>, decoded string"
    base = docs.select(*cols)
    return base.mapInArrow(run, StructType([*docs.select(*keep).schema.fields, *StructType.fromDDL(more).fields]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode(docs, digests=True).drop("text")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return encode(docs, cached=STAGE_BYTES).drop("decoded")
