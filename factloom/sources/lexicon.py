"""Lexicon and sheet readers: synset files, sense counts, multilingual tab files, continued CSV sheets, DIF."""

from __future__ import annotations

import csv
import io

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def synsets(lines: DataFrame) -> DataFrame:
    """(synset, pos, words, pointers, gloss, term, mapping) of the lines (value) of a WordNet data file whose glosses
    may end in &%Term and a sign. Lines that don't start with an offset are left out."""
    head = F.regexp_extract("value", r"^(\d{8}) \d\d ([nvasr]) ([0-9a-f]{2}) (.*?) (\d{3}) (.*?)\| (.*)$", 1)
    part = lambda k: F.regexp_extract("value", r"^(\d{8}) \d\d ([nvasr]) ([0-9a-f]{2}) (.*?) (\d{3}) (.*?)\| (.*)$", k)
    words = F.transform(F.filter(F.split(part(4), " "), lambda _, i: i % 2 == 0), lambda w: F.lower(w))
    pointers = F.regexp_extract_all(part(6), F.lit(r"[!@~#%=+;\-*>^$&<\\]\S? \d{8} [nvasr]"), F.lit(0))
    return lines.filter(head != "").select(
        head.alias("synset"),
        part(2).alias("pos"),
        words.alias("words"),
        F.transform(pointers, lambda p: F.struct(F.split(p, " ")[0].alias("kind"), F.split(p, " ")[1].alias("to"))).alias("pointers"),
        F.trim(F.regexp_replace(part(7), r"&%\S+\s*$", "")).alias("gloss"),
        F.regexp_extract(part(7), r"&%(\w+)([=+@\[\]:])\s*$", 1).alias("term"),
        F.regexp_extract(part(7), r"&%(\w+)([=+@\[\]:])\s*$", 2).alias("mapping"),
    )


def hypernyms(found: DataFrame) -> DataFrame:
    """(child, parent) by the @ pointers."""
    return found.select(F.col("synset").alias("child"), F.explode("pointers").alias("p")).filter("p.kind LIKE '@%'").select("child", F.col("p.to").alias("parent"))


def sense_index(lines: DataFrame) -> DataFrame:
    """(word, pos, key, synset, n) of lines word%n:..:.. offset number count."""
    take = lambda k: F.regexp_extract("value", r"^([^%\s]+)%(\d)(\S*) (\d{8}) (\d+) (\d+)", k)
    return lines.filter(take(1) != "").select(take(1).alias("word"), take(2).cast("int").alias("pos"), F.concat(take(1), F.lit("%"), take(2), take(3)).alias("key"), take(4).alias("synset"), take(6).cast("int").alias("n"))


def companions(lines: DataFrame) -> DataFrame:
    """(sense, companion, n) of lines: sense, then word_count pairs up to a marker with a colon."""
    cells = F.split("value", r"\s+")
    pairs = F.slice(cells, F.lit(2), F.greatest(F.lit(0), F.size(cells) - 1))
    long = lines.select(cells[0].alias("sense"), F.posexplode(pairs).alias("i", "c"), F.array_position(F.transform(pairs, lambda x: x.endswith(":")), F.lit(True)).alias("stop"))
    long = long.filter((F.col("stop") == 0) | (F.col("i") + 1 < F.col("stop"))).filter(F.col("c").rlike(r"^.+_\d+$"))
    return long.select("sense", F.regexp_extract("c", r"^(.+)_(\d+)$", 1).alias("companion"), F.regexp_extract("c", r"^(.+)_(\d+)$", 2).cast("int").alias("n"))


def multilingual(lines: DataFrame) -> DataFrame:
    """(synset, pos, language, word) of tab-separated lines: offset-pos, lang:lemma, word."""
    c = F.split("value", "\t")
    return lines.filter(~F.col("value").startswith("#") & (F.size(c) >= 3)).select(F.split(c[0], "-")[0].alias("synset"), F.split(c[0], "-")[1].alias("pos"), F.split(c[1], ":")[0].alias("language"), c[2].alias("word"))


def noun_root(words: DataFrame, exceptions: DataFrame, known: DataFrame) -> DataFrame:
    """(word, root): the exception's root, else the word itself if known, else the first known form by the rules."""
    rules = F.array(*(F.struct(F.lit(a).alias("end"), F.lit(b).alias("by"), F.lit(i).alias("i")) for i, (a, b) in enumerate([("s", ""), ("ses", "s"), ("xes", "x"), ("zes", "z"), ("ches", "ch"), ("shes", "sh"), ("men", "man"), ("ies", "y")])))
    tried = words.select("word", F.explode(rules).alias("r")).filter(F.expr("endswith(word, r.end)"))
    tried = tried.select("word", F.expr("concat(left(word, length(word) - length(r.end)), r.by)").alias("root"), F.col("r.i").alias("i"))
    tried = tried.unionByName(words.select("word", F.col("word").alias("root"), F.lit(-1).alias("i")))
    best = tried.join(known.select(F.col("word").alias("root")).distinct(), "root", "left_semi").groupBy("word").agg(F.min_by("root", "i").alias("r"))
    return words.join(exceptions.select(F.col("form").alias("word"), F.col("root").alias("x")), "word", "left").join(best, "word", "left").select("word", F.coalesce("x", "r").alias("root"))


def sheet(text: str, starts: tuple[str, ...] = (), quote: str = '"', delimiter: str = ",") -> list[list[str]]:
    """Rows of a sheet: leading lines that are blank or start with ; are left out; where starts are given, a line that
    doesn't begin with one of them goes on with the line before. Cells lose outer blanks; rows may differ in length."""
    lines = text.splitlines()
    while lines and (not lines[0].strip() or lines[0].startswith(";")):
        lines.pop(0)
    joined: list[str] = []
    for line in lines:
        if starts and joined and not line.startswith(starts):
            joined[-1] += " " + line
        else:
            joined.append(line)
    return [[c.strip() for c in r] for r in csv.reader(io.StringIO("\n".join(joined)), quotechar=quote, delimiter=delimiter)]


def interchange(text: str) -> list[list[str]]:
    """Rows of a DIF file's data section."""
    lines = text.splitlines()
    at = next((i for i, x in enumerate(lines) if x.strip() == "DATA"), len(lines)) + 3
    rows: list[list[str]] = []
    while at + 1 < len(lines):
        kind, _, number = lines[at].strip().partition(",")
        value = lines[at + 1].strip()
        at += 2
        if kind == "-1":
            if value == "BOT":
                rows.append([])
            elif value == "EOD":
                break
        elif rows:
            rows[-1].append(value.strip('"') if kind == "1" else number)
    return rows


def verb_root(words: DataFrame, exceptions: DataFrame, known: DataFrame) -> DataFrame:
    """(word, root): the exception's root, else the first known form by the rules, else the word itself if it is known."""
    ends = [("s", ""), ("es", ""), ("ies", "y"), ("ed", ""), ("ed", "e"), ("ing", "e"), ("ing", ""), ("", "")]
    rules = F.array(*(F.struct(F.lit(a).alias("end"), F.lit(b).alias("by"), F.lit(i).alias("i")) for i, (a, b) in enumerate(ends)))
    tried = words.select("word", F.explode(rules).alias("r")).filter(F.expr("endswith(word, r.end)"))
    tried = tried.select("word", F.expr("concat(left(word, length(word) - length(r.end)), r.by)").alias("root"), F.col("r.i").alias("i"))
    best = tried.join(known.select(F.col("word").alias("root")).distinct(), "root", "left_semi").groupBy("word").agg(F.min_by("root", "i").alias("r"))
    return words.join(exceptions.select(F.col("form").alias("word"), F.col("root").alias("x")), "word", "left").join(best, "word", "left").select("word", F.coalesce("x", "r").alias("root"))


def json_pairs(lines: DataFrame, key: str, text: str) -> DataFrame:
    """(key, name, value): the members of JSON objects, one a row; text that is no object has none."""
    pairs = F.from_json(text, "map<string,string>")
    return lines.select(key, F.explode(pairs).alias("name", "value"))
