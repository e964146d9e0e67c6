"""Idioms and noun groups: several words of a text become one.

phrases: (phrase: array<string>), words in lower case. A text is read from the left; where phrases begin, the longest is taken and reading goes on
behind it. A small list of phrases is broadcast as a trie of words; beyond PHRASE_WORDS, counted before anything is collected, texts
and phrases meet in a join. Both give the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.plans.closure import cut

PHRASE_WORDS = 200_000


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("[A-Za-z0-9]+"), F.lit(0))


def trie(phrases: list[list[str]]) -> dict:
    """Nested dictionaries by word; the empty word marks the end of a phrase."""
    root: dict = {}
    for phrase in phrases:
        at = root
        for w in phrase:
            at = at.setdefault(w, {})
        at[""] = {}
    return root


def longest(found: dict, ws: list[str], at: int) -> int:
    """The length of the longest phrase that begins at a word, or 0."""
    best, n = 0, 0
    while at + n < len(ws) and (found := found.get(ws[at + n])) is not None:
        n += 1
        if "" in found:
            best = n
    return best


def spans(ws: list[str], found: dict) -> list[tuple[int, int]]:
    """(first word, number of words) of the phrases taken."""
    out, at = [], 0
    while at < len(ws):
        n = longest(found, ws, at)
        if n:
            out.append((at, n))
        at += n or 1
    return out


def _by_trie(texts: DataFrame, found: dict) -> DataFrame:
    shared = texts.sparkSession.sparkContext.broadcast(found)

    def taken(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [[{"at": a, "n": n} for a, n in spans([w.lower() for w in ws], shared.value)] for ws in b["words"]]
            yield pd.DataFrame({"k1": b["k1"], "k2": b["k2"], "words": b["words"], "taken": got})

    return texts.mapInPandas(taken, "k1 long, k2 long, words array<string>, taken array<struct<at:int,n:int>>")


def _by_join(texts: DataFrame, phrases: DataFrame) -> DataFrame:
    """Every run of words that is as long as some phrase meets the phrases by 128 bits of hash: a place has one row a length at most."""
    sizes = sorted(r["n"] for r in phrases.select(F.size("phrase").alias("n")).distinct().collect())  # no more than the longest phrase has words
    both = lambda ws: f"xxhash64({ws}) AS h1, xxhash64(1, {ws}) AS h2"
    listed = phrases.select(F.size("phrase").alias("n"), *(F.expr(x) for x in ("xxhash64(phrase) AS h1", "xxhash64(1, phrase) AS h2")))
    low = texts.select("k1", "k2", F.transform("words", F.lower).alias("low")).filter("size(low) > 0")
    begins = low.select("k1", "k2", F.explode(F.expr(f"flatten(transform(sequence(0, size(low) - 1), i -> transform(filter(array({', '.join(map(str, sizes))}), n -> i + n <= size(low)), n -> struct(i AS at, n, {both('slice(low, i + 1, n)')}))))")).alias("s"))
    hits = begins.select("k1", "k2", "s.*").join(listed, ["n", "h1", "h2"], "left_semi").groupBy("k1", "k2").agg(F.array_sort(F.collect_list(F.struct("at", (-F.col("n")).alias("n")))).alias("hits"))
    none = "CAST(array() AS array<struct<at:int,n:int>>)"
    walk = f"aggregate(hits, struct(0 AS free, {none} AS taken), (s, h) -> IF(h.at >= s.free, struct(h.at - h.n AS free, array_append(s.taken, struct(h.at, -h.n AS n)) AS taken), s)).taken"
    return texts.join(hits, ["k1", "k2"], "left").withColumn("taken", F.coalesce(F.expr(walk), F.expr(none))).drop("hits")


def grouped(docs: DataFrame, phrases: DataFrame, text: str = "text", most: int = PHRASE_WORDS) -> DataFrame:
    """docs' columns and phrases (int), grouped (string): how many phrases were taken, and the text's words joined by one space, each phrase as one
    word, its words joined with the later ones' first letter in capitals.

    Words are runs of ASCII letters and digits, compared without case. A null or empty text has no words. Equal texts are read once.
    """
    listed = phrases.filter("size(phrase) > 0").select("phrase").distinct()
    keyed = docs.withColumn("k1", F.xxhash64(text)).withColumn("k2", F.xxhash64(F.lit(1), text))
    texts = keyed.groupBy("k1", "k2").agg(F.first(text).alias("t")).select("k1", "k2", words(F.col("t")).alias("words"))
    size = listed.agg(F.sum(F.size("phrase")).alias("n")).first()["n"] or 0
    if size <= most:
        found = _by_trie(texts, trie([list(r["phrase"]) for r in listed.collect()]))
    else:
        found = _by_join(cut(texts), listed)
    joined = "concat(words[s.at], array_join(transform(slice(words, s.at + 2, s.n - 1), w -> concat(upper(substr(w, 1, 1)), substr(w, 2))), ''))"
    word = f"CASE WHEN size(filter(taken, s -> s.at = i)) > 0 THEN element_at(transform(filter(taken, s -> s.at = i), s -> {joined}), 1) WHEN exists(taken, s -> s.at < i AND i < s.at + s.n) THEN NULL ELSE w END"
    made = F.when(F.size("taken") == 0, F.array_join("words", " ")).otherwise(F.expr(f"array_join(transform(words, (w, i) -> {word}), ' ')"))
    shown = found.select("k1", "k2", F.size("taken").alias("phrases"), made.alias("grouped"))
    keep = [c for c in docs.columns if c not in ("phrases", "grouped")]
    return keyed.select(*keep, "k1", "k2").join(shown, ["k1", "k2"]).select(*keep, "phrases", "grouped")


def noun_groups(literals: DataFrame) -> DataFrame:
    """(sent_id, word, merged): each word of a compound, as word-place, with the compound's words joined in the order of
    their places and the first place: nn(buy-3, out-2) gives outbuy-2 for both.

    literals: (sent_id, pred, arg1, arg2). A word that modifies several roots is merged with all of them; a sentence fits a row.
    """
    nn = literals.filter("pred = 'nn' AND arg1 RLIKE '-[0-9]+$' AND arg2 RLIKE '-[0-9]+$'").select("sent_id", "arg1", "arg2").distinct()
    own = nn.select("sent_id", F.col("arg1").alias("root"), F.col("arg2").alias("part")).union(nn.select("sent_id", "arg1", "arg1")).distinct()
    others = own.filter("root <> part").select("sent_id", F.col("part").alias("word"), "root").join(own, ["sent_id", "root"]).select("sent_id", "word", "part")
    groups = own.select("sent_id", F.col("root").alias("word"), "part").union(others).distinct()
    at = F.struct(F.regexp_extract("part", "-([0-9]+)$", 1).cast("int").alias("i"), F.regexp_extract("part", "^(.*)-[0-9]+$", 1).alias("w"))
    got = groups.groupBy("sent_id", "word").agg(F.array_sort(F.collect_list(at)).alias("g"))
    return got.select("sent_id", "word", F.expr("concat(array_join(transform(g, x -> x.w), ''), '-', g[0].i)").alias("merged"))
