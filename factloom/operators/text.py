"""Text analytics: term weights, retrieval, sentiment, word senses, coherence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.strings import tokens
from factloom.plans.closure import cut, small


def term_counts(docs: DataFrame, key: str, text: str = "text", stop: tuple[str, ...] = ()) -> DataFrame:
    """(key, term, tf); texts are dealt out by their key, so their words are counted where they are."""
    out = docs.select(key, text).repartition(key).select(key, F.explode(tokens(F.col(text))).alias("term"))
    if stop:
        out = out.filter(~F.col("term").isin(*stop))
    return out.groupBy(key, "term").agg(F.count("*").alias("tf"))


#: Most frequent terms whose counts are broadcast.
COMMON = 50_000


def frequencies(tf: DataFrame) -> DataFrame:
    """(term, df)"""
    return cut(tf.groupBy("term").agg(F.count("*").alias("df")))


def weights(tf: DataFrame, key: str, n: Column | int, df: DataFrame | None = None) -> DataFrame:
    """(key, term, tf, df, w): w = tf * log10(n / df), df: frequencies, where they are known. The COMMON most frequent terms, which most rows have, get
    theirs by a broadcast, and only the rows of the others are moved."""
    df = frequencies(tf) if df is None else df
    few = small(df)
    if few is not df:
        out = tf.join(few, "term")
    else:
        common = cut(df.orderBy(F.desc("df"), "term").limit(COMMON))
        known = tf.join(F.broadcast(common), "term", "left")
        rare = known.filter("df IS NULL").drop("df").join(df, "term")
        out = known.filter("df IS NOT NULL").unionByName(rare)
    return out.select(key, "term", "tf", "df", (F.col("tf") * F.log10(F.lit(n) / F.col("df"))).alias("w"))


def norms(w: DataFrame, key: str) -> DataFrame:
    return w.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))


def cosines(w: DataFrame, key: str, queries: DataFrame, query_key: str, asked: DataFrame | None = None) -> DataFrame:
    """(query_key, key, score) of weighted queries (query_key, term, w) against weighted documents; pairs that share a
    term of weight. The queries' side is what a user asks, not the corpus. asked: the documents' weights of the queries' terms, where that is less to read."""
    q = queries.select(query_key, "term", F.col("w").alias("qw"))
    qn, dn = norms(queries, query_key).withColumnRenamed("norm", "qn"), norms(w, key).withColumnRenamed("norm", "dn")
    dot = (w if asked is None else asked).select(key, "term", "w").join(q, "term").groupBy(query_key, key).agg(F.sum(F.col("w") * F.col("qw")).alias("dot"))
    return dot.join(qn, query_key).join(dn, key).filter("qn > 0 AND dn > 0").select(query_key, key, (F.col("dot") / (F.col("qn") * F.col("dn"))).alias("score"))


def top(scored: DataFrame, by: str, order: list[Column], k: int) -> DataFrame:
    w = Window.partitionBy(by).orderBy(*order)
    return scored.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)


def polarity(strength: Column, sign: Column) -> Column:
    """Weak 1, strong 5, by their sign; neutral 0."""
    return F.when(sign == "neutral", 0).otherwise(F.when(strength == "strong", 5).otherwise(1) * F.when(sign == "negative", -1).otherwise(1))


def sentiment(docs: DataFrame, key: str, lexicon: DataFrame) -> DataFrame:
    """(key, score): summed polarity (word, polarity) of the words; 0 without any."""
    words = docs.select(key, F.explode(tokens(F.col("text"))).alias("word"))
    scored = words.join(small(lexicon), "word").groupBy(key).agg(F.sum("polarity").alias("score"))
    return docs.select(key).join(scored, key, "left").select(key, F.coalesce("score", F.lit(0)).alias("score"))


def concept_sentiment(docs: DataFrame, key: str, lexicon: DataFrame, concepts: DataFrame) -> DataFrame:
    """(concept, score, sentences): the scores of the lines that name a concept (word, concept), summed."""
    lines = docs.select(key, F.posexplode(F.split("text", "\n")).alias("line", "text")).filter("trim(text) <> ''")
    lines = lines.withColumn("sid", F.concat_ws(":", key, "line")).select("sid", "text")
    words = lines.select("sid", F.explode(F.array_distinct(tokens(F.col("text")))).alias("word"))
    named = words.join(small(concepts), "word").select("sid", "concept").distinct()
    return named.join(sentiment(lines, "sid", lexicon), "sid").groupBy("concept").agg(F.sum("score").alias("score"), F.count("*").alias("sentences"))


def best_sense(words: DataFrame, key: str, senses: DataFrame, least: int = 5) -> DataFrame:
    """(key, word, sense, total): for each word with senses, the sense whose companions (word, sense, sense_order,
    companion, n) occur most in its text, the first of equals, if they come to more than `least`."""
    other = words.select(key, F.col("word").alias("companion"), F.col("tf"))
    scored = words.select(key, "word").join(senses, "word").join(other, [key, "companion"]).groupBy(key, "word", "sense", "sense_order").agg(F.sum("n").alias("total"))
    w = Window.partitionBy(key, "word").orderBy(F.desc("total"), "sense_order")
    return scored.withColumn("place", F.row_number().over(w)).filter((F.col("place") == 1) & (F.col("total") > least)).select(key, "word", "sense", "total")


def coherence(searches: DataFrame, user: str, order: list[str], text: str) -> DataFrame:
    """(user, mean): per user the mean distance of consecutive searches, equal ones left out, without its fraction."""
    w = Window.partitionBy(user).orderBy(*order)
    d = searches.withColumn("__d", F.levenshtein(F.col(text), F.lag(text).over(w)))
    return d.filter("__d > 0").groupBy(user).agg(F.floor(F.avg("__d")).alias("mean"))


def concept_histogram(tf: DataFrame, concepts: DataFrame, stop: list[str], k: int) -> DataFrame:
    """(concept, n, place): the k concepts (word, concept) that words name most often over all texts, but those to be
    left out; by name where they are equal."""
    counted = tf.join(small(concepts), tf["term"] == concepts["word"]).filter(~F.col("concept").isin(*stop)).groupBy("concept").agg(F.sum("tf").alias("n"))
    top_ = counted.orderBy(F.desc("n"), "concept").limit(k)
    return top_.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "concept")))  # k rows


def best_across_kinds(words: DataFrame, key: str, senses: DataFrame, least: int = 5) -> DataFrame:
    """(key, word, sense, kind, total): as best_sense for each kind of word (senses: with kind), then the kind whose best
    sense has the most, the last of equals."""
    other = words.select(key, F.col("word").alias("companion"))
    scored = words.select(key, "word").join(senses, "word").join(other, [key, "companion"]).groupBy(key, "word", "kind", "sense", "sense_order").agg(F.sum("n").alias("total"))
    w = Window.partitionBy(key, "word").orderBy(F.desc("total"), F.desc("kind"), "sense_order")
    return scored.withColumn("__p", F.row_number().over(w)).filter((F.col("__p") == 1) & (F.col("total") > least)).select(key, "word", "sense", "kind", "total")


def above_floor(scored: DataFrame, by: str, floor: float) -> DataFrame:
    """All best answers of each query: those as good as its best one, if that reaches the floor."""
    best = scored.groupBy(by).agg(F.max("score").alias("__best")).filter(F.col("__best") >= floor)
    return scored.join(best, by).filter(F.col("score") == F.col("__best")).drop("__best")
