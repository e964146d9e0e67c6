"""N-gram Jaccard join by prefix filters under several global token orders, intersected before verification.

A document's set is its distinct 5-word shingles. Equal sets are one class from the start. A set that reaches the
threshold with another one has most of its tokens in common with it, so:

1. A set of whose tokens fewer than the threshold's share stand in other sets has no partner. A count-min sketch,
   which takes no repeated token for a single one, drops most such sets; the tokens of the others are counted exactly,
   which drops the rest.
2. All orders put frequent tokens last (by the logarithm of the exact count) and differ in the permutation of tokens
   that are as frequent. Linked sets share a token within the first n - ceil(t n) + 1 under every order. The shorter
   one has it within the first n - ceil(2 t n / (1 + t)) + 1 even, so a bucket of the first order pairs the short
   prefixes with the long ones, and the places of a pair's first common token must leave room for the overlap that it
   needs. What is left must share prefix tokens under all other orders too, by their prefixes in 32 bits a token. Only
   then are whole sets moved and compared.
3. In each bucket all classes are first held against one, so a group of near copies falls together without its
   pairs. Then come all pairs across components: in each bucket the classes outside its largest component against all,
   a large bucket dealt out in blocks. No link between components is lost.

Work grows with the classes outside the largest component of a bucket times its size, so it is quadratic where a
passage fills the short prefixes of many sets that don't link. The sketch grows with the tokens of the different sets,
which are counted before, up to 2**MOST_CELL_BITS cells; where more tokens come in, it lets more sets through and the
exact counts take over.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import sketch
from factloom.llm import words as W
from factloom.llm.components import components
from factloom.llm.shared import spent, table, written

SHINGLE = 5
PERCENT = 80
ORDERS = 3
#: The sketch has more cells than there are tokens, between 2**CELL_BITS and 2**MOST_CELL_BITS.
CELL_BITS, MOST_CELL_BITS = 27, 30
BLOCK = 1024
BROADCAST_IDS = 1_000_000


def shingles(buf: np.ndarray, offs: np.ndarray, k: int = SHINGLE) -> list[np.ndarray]:
    """Each row's distinct shingles as sorted 64-bit hashes; with fewer than k words the whole sequence is one."""
    low = W.LOWER[buf]
    start, end, first = W.spans(low, offs, W.SPACED)
    h = W.word_hashes(low, start, end)
    whole = W.window_hashes(h, k)
    short = {n: W.window_hashes(h, n) for n in range(1, k)}
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        out.append(np.unique(whole[a : b - k + 1]) if b - a >= k else short[b - a][a : a + 1] if b > a else np.empty(0, np.uint64))
    return out


def least_overlap(a, b, percent: int = PERCENT):
    """The least intersection at which sets of sizes a and b reach percent of their union."""
    return -(-percent * (a + b) // (100 + percent))


def prefix_length(n: int, percent: int = PERCENT) -> int:
    return n - -(-percent * n // 100) + 1


def cell_bits(tokens: int) -> int:
    return min(max(CELL_BITS, MOST_CELL_BITS), max(CELL_BITS, tokens.bit_length()))


def ordered(tokens: np.ndarray, levels: np.ndarray, order: int) -> np.ndarray:
    """Indexes of tokens by level and, within one, by a permutation of the order's own."""
    return np.argsort((levels.astype(np.uint64) << np.uint64(56)) | (W.mix(tokens.view(np.uint64), 1000 + order) >> np.uint64(8)))


def _key(s: np.ndarray) -> tuple[int, int]:
    return tuple(int(W.mix(s, salt).sum(dtype=np.uint64).view(np.int64)) for salt in (11, 13))


def _only(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, text) of the documents named by ids (rep, distinct), by broadcast up to BROADCAST_IDS of them."""
    picked = docs.select("doc_id", "text")
    if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        return picked.join(F.broadcast(ids), F.col("doc_id") == F.col("rep"), "left_semi")
    return picked.join(ids, F.col("doc_id") == F.col("rep"), "left_semi")


def linked(a: pa.Buffer, b: pa.Buffer, percent: int = PERCENT) -> bool:
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    return len(np.intersect1d(x, y, True)) >= least_overlap(len(x), len(y), percent)


def _signed(texts: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, k1, k2): the size and the 128-bit key of every row's set."""
    kind = texts.schema["doc_id"].dataType.simpleString()

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r0, r1, buf, offs in W.slices(batch.column("text")):
                s = shingles(buf, offs)
                k = [_key(x) for x in s]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[r0:r1], pa.array([len(x) for x in s], pa.int64()), pa.array([x[0] for x in k], pa.int64()), pa.array([x[1] for x in k], pa.int64())], ["doc_id", "n_shingles", "k1", "k2"])

    return texts.mapInArrow(sign, f"doc_id {kind}, n_shingles long, k1 long, k2 long")


def _sets(texts: DataFrame, percent: int, tokens_in_all: int) -> DataFrame:
    """(rep, n, tokens: binary): the sets that may have a partner, by a sketch for so many tokens."""
    kind, cells = texts.schema["doc_id"].dataType.simpleString(), cell_bits(tokens_in_all)
    tokens = lambda buf, offs: np.concatenate([np.empty(0, np.uint64), *shingles(buf, offs)])
    twice = texts.sparkSession.sparkContext.broadcast(sketch.count(texts.select("text"), tokens, cells, 1)[0])

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(twice.value, np.uint8)
        for batch in batches:
            for r0, _, buf, offs in W.slices(batch.column("text")):
                some = [(i, s) for i, s in enumerate(shingles(buf, offs), r0) if len(s)]
                if not some:
                    continue
                ends = np.cumsum([len(x) for _, x in some])
                hits = np.add.reduceat(sketch.repeated(bits, np.concatenate([x for _, x in some]), cells, 1), np.append(0, ends[:-1]), dtype=np.int64)
                some = [x for x, h in zip(some, hits.tolist(), strict=True) if 100 * h >= percent * len(x[1])]
                if some:
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array([i for i, _ in some])), pa.array([len(x) for _, x in some], pa.int64()), pa.array([x.tobytes() for _, x in some], pa.binary())], ["rep", "n", "tokens"])

    return texts.mapInArrow(keep, f"rep {kind}, n long, tokens binary")


def _prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """(rep, n, own, first, others) of the sets with enough tokens that other sets have too. first: (token, pos) of the
    prefix under order 0, others: 32 bits of the tokens of the prefixes under each other order; tokens that no other
    set has are left out, own is their share."""
    kind = sets.schema["rep"].dataType.simpleString()

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (rep, n) in enumerate(zip(batch.column("rep"), batch.column("n").to_pylist(), strict=True)):
                tokens = np.frombuffer(batch.column("tokens")[i].as_buffer(), np.int64)
                for k in range(0, n, 1 << 18):
                    part = tokens[k : k + (1 << 18)]
                    yield pa.RecordBatch.from_arrays([pa.array(part), pa.repeat(rep, len(part)), pa.repeat(pa.scalar(n, pa.int64()), len(part))], ["token", "rep", "n"])

    rows = sets.mapInArrow(explode, f"token long, rep {kind}, n long")
    counts = rows.groupBy("token").agg(F.count("*").alias("c")).filter("c > 1").select("token", F.floor(F.log2("c") * 2).cast("int").alias("level"))
    known = rows.join(counts, "token").groupBy("rep", "n").agg(F.collect_list("token").alias("tokens"), F.collect_list("level").alias("levels"))
    known = known.filter(f"100 * size(tokens) >= {percent} * n")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, first, others = [], [], []
            for i, n in enumerate(batch.column("n").to_pylist()):
                tokens, at = np.unique(batch.column("tokens")[i].values.to_numpy(), return_index=True)
                levels = batch.column("levels")[i].values.to_numpy()[at]
                alone = max(0, n - len(tokens))
                p = max(0, prefix_length(n, percent) - alone)
                own.append(alone / n)
                first.append([{"token": t, "pos": alone + k} for k, t in enumerate(tokens[ordered(tokens, levels, 0)[:p]].tolist())])
                others.append([(tokens[ordered(tokens, levels, o)[:p]] >> 32).astype(np.int32).tolist() for o in range(1, ORDERS)])
            yield pa.RecordBatch.from_arrays(
                [batch.column("rep"), batch.column("n"), pa.array(own, pa.float64()), pa.array(first, pa.list_(pa.struct([("token", pa.int64()), ("pos", pa.int32())]))), pa.array(others, pa.list_(pa.list_(pa.int32())))],
                ["rep", "n", "own", "first", "others"],
            )

    return known.mapInArrow(cut, f"rep {kind}, n long, own double, first array<struct<token:long,pos:int>>, others array<array<int>>").filter("size(first) > 0")


def join(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row: the size of its set, and the smallest doc_id that it reaches
    by links, itself included. doc_id may be of any type with an order.

    A null or empty text has no shingle and links with nothing. A null doc_id links with nothing and its component is
    null. Ids should be unique, but for repeated rows, which get equal results. A very long text is one set, held by
    one task at a time. Of equal sizes the smaller id counts as the shorter side, which no result depends on. An empty
    table gives no rows, and columns other than doc_id and text don't matter, whatever their names.
    """
    texts = docs.select("doc_id", "text")
    members = written(_signed(texts), "members")
    classes = written(members.filter("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n")), "classes")
    usable = _only(texts, classes.select("rep").distinct())
    sets = written(_sets(usable, percent, classes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]), "sets")
    prefixes = written(_prefixes(sets, percent), "prefixes")
    links = _links(sets, prefixes, percent)
    found = components(links)
    spent(links, sets, prefixes)
    reps = classes.join(found, F.col("rep") == F.col("id"), "left").select("k1", "k2", F.coalesce("component", "rep").alias("component"))
    return members.join(reps, ["k1", "k2"], "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNull(), None).when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component")).alias("component_id"))


def _links(sets: DataFrame, prefixes: DataFrame, percent: int) -> DataFrame:
    """(a, b): links whose components are those of all links."""
    rows = prefixes.select("rep", "n", "own", F.explode("first").alias("x")).select(F.col("x.token").alias("token"), "rep", "n", "own", F.col("x.pos").alias("pos"))
    mixed = _mixed(rows.withColumn("brief", _brief(percent)), None)
    # of each bucket the class with the fewest tokens of its own, against all others
    one = mixed.groupBy("token").agg(F.min_by(F.struct("rep", "n", "pos", "comp", "brief"), F.struct("own", "rep")).alias("l")).select("token", "l.*")
    links = _verified(sets, prefixes, _pairs(one, mixed, percent, False), percent)
    # and what is left across components
    rest = _mixed(mixed.drop("comp", "major", "size"), links)
    spent(mixed)
    more = _verified(sets, prefixes, _pairs(rest.filter("comp <> major"), rest, percent, True), percent)
    both = written(links.unionByName(more), "links")
    spent(rest, links, more)
    return both


def _mixed(rows: DataFrame, links: DataFrame | None) -> DataFrame:
    """The rows of buckets that hold several components and a brief place, with their component (comp), the bucket's
    largest one (major) and its number of rows (size)."""
    if links is None:
        rows = rows.withColumn("comp", F.col("rep"))
    else:
        comps = components(links)
        rows = rows.join(comps, F.col("rep") == F.col("id"), "left").withColumn("comp", F.coalesce("component", "rep")).drop("id", "component")
    sizes = rows.groupBy("token", "comp").agg(F.count("*").alias("c"), F.max("brief").alias("brief"))
    some = sizes.groupBy("token").agg(F.max_by("comp", F.struct("c", "comp")).alias("major"), F.sum("c").alias("size"), F.count("*").alias("comps"), F.max("brief").alias("some")).filter("comps > 1 AND some")
    out = written(rows.join(some.select("token", "major", "size"), "token"), "mixed")
    if links is not None:
        spent(comps)
    return out


def _brief(percent: int) -> Column:
    """Whether a place is within the prefix that the shorter set of a pair has the first common token in."""
    return F.expr(f"(100 + {percent}) * (n - pos) >= 2 * {percent} * n")


def _pairs(left: DataFrame, right: DataFrame, percent: int, blocks: bool) -> DataFrame:
    """(a, b) across components, a the shorter, of rows with a common token whose sizes and whose first common token's
    places leave room for the overlap that they need. blocks: right's large buckets are dealt out, left's repeated."""
    key = ["token"]
    if blocks:
        count = F.ceil(F.col("size") / BLOCK).cast("int")
        left = left.withColumn("block", F.explode(F.sequence(F.lit(0), count - 1)))
        right = right.withColumn("block", F.pmod(F.xxhash64("rep"), count).cast("int"))
        key = ["token", "block"]
    side = lambda df, x: df.select(*key, F.struct("n", "rep", "pos", "brief", "comp").alias(x))
    met = side(left, "x").join(side(right, "y"), key).filter("x.comp <> y.comp").select(F.least("x", "y").alias("s"), F.greatest("x", "y").alias("l"))
    # a pair's first common token is one of those that it meets by, and must pass
    met = met.filter(f"s.brief AND 100 * s.n >= {percent} * l.n AND (100 + {percent}) * least(s.n - s.pos, l.n - l.pos) >= {percent} * (s.n + l.n)")
    return met.select(F.col("s.rep").alias("a"), F.col("l.rep").alias("b")).distinct()


def _verified(sets: DataFrame, prefixes: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """(a, b) of the pairs that share prefix tokens under all other orders and that link."""
    side = lambda df, x, c: df.select(F.col("rep").alias(x), F.col(c).alias(f"s{x}"))
    shared = " AND ".join(f"arrays_overlap(sa[{k}], sb[{k}])" for k in range(ORDERS - 1))
    pairs = pairs.join(side(prefixes, "a", "others"), "a").join(side(prefixes, "b", "others"), "b").filter(shared).select("a", "b")
    pairs = written(pairs, "pairs")
    ids = pairs.select(F.col("a").alias("rep")).union(pairs.select("b")).distinct()
    some = sets.join(ids, "rep", "left_semi")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            take = [linked(a.as_buffer(), b.as_buffer(), percent) for a, b in zip(batch.column("sa"), batch.column("sb"), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(take, pa.bool_()))

    kind = sets.schema["rep"].dataType.simpleString()
    both = pairs.join(side(some, "a", "tokens"), "a").join(side(some, "b", "tokens"), "b")
    links = written(both.select("a", "b", "sa", "sb").mapInArrow(keep, f"a {kind}, b {kind}"), "links")
    spent(pairs)
    return links


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: the one with the smallest doc_id. Rows without a doc_id stay; of rows that
    share one, the first by text stays."""
    found = written(join(docs).filter("doc_id IS NOT NULL"), "found")
    again = found.filter("doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id")
    gone = written(found.filter("doc_id <> component_id").select("doc_id").union(again).distinct().withColumnRenamed("doc_id", "__id"), "gone")
    few = gone.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    ids = lambda df: F.broadcast(df) if few else df
    out = docs.join(ids(gone), F.col("doc_id") == F.col("__id"), "left_anti")
    if again.isEmpty():
        return out
    once = docs.join(ids(again.withColumnRenamed("doc_id", "__id")), F.col("doc_id") == F.col("__id"), "left_semi")
    once = once.groupBy(F.col("doc_id").alias("__id")).agg(F.min_by(F.struct(*docs.columns), F.struct(F.col("text").isNull(), "text")).alias("__row"))
    return out.unionByName(once.select("__row.*"))


SQL = r"""
WITH RECURSIVE docs AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[s:s + 4], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS s FROM docs WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY ALL),
links AS MATERIALIZED (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
both_ways AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT a AS id, a AS r FROM both_ways UNION SELECT e.b, r FROM reach JOIN both_ways e ON e.a = reach.id),
comp AS (SELECT id, min(r) AS c FROM reach GROUP BY id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(c.c, d.doc_id)::BIGINT AS component_id
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN comp c ON c.id = d.doc_id
"""
