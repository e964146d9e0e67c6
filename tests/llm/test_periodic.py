"""Periodic runs against brute force over every period and place."""

import hashlib
import random
import re
import zlib

import pytest

from factloom.llm import periodic
from factloom.llm import words as W

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def _brute(w, least=6, exponent=4):
    out, n = [], len(w)
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            s = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            e = i + q
            if e - s >= max(least, exponent * q) and not any(q % p == 0 and w[s : e - p] == w[s + p : e] for p in range(1, q)):
                out.append((s, e - s, q))
            i += 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def _words(rng):
    w = [str(rng.randrange(rng.choice([1, 2, 3, 10, 10**6]))) for _ in range(rng.randint(0, 60))]
    for _ in range(rng.randint(0, 4)):
        if w:
            a, p = rng.randrange(len(w)), rng.randint(1, max(1, len(w) // 5))
            w = w[:a] + w[a : a + p] * rng.randint(2, 7) + w[a : a + rng.randint(0, p)] + w[a + rng.randint(0, p) :]
            w = (w[rng.randrange(len(w)) :] + w)[:300] if w and rng.random() < 0.3 else w[:300]
    return w


def test_runs():
    rng = random.Random(1)
    for _ in range(1500):
        w = _words(rng)
        letters = [hash(x) for x in w]
        assert periodic.runs(letters) == _brute(w), w
        assert periodic.runs(letters, 8, 5) == _brute(w, 8, 5)


def test_factors():
    rng = random.Random(2)
    for _ in range(300):
        w, i = [rng.randrange(3) for _ in range(rng.randint(0, 40))], 0
        for at, size, source in periodic.factors(w):
            longest = max((m for j in range(at) for m in range(len(w) - at + 1) if w[j : j + m] == w[at : at + m]), default=0)
            assert at == i and size == max(1, longest) and (not longest or (source < at and w[source : source + size] == w[at : at + size]))
            i += size
        assert i == len(w)


def test_long_runs_are_linear():
    for w in ([0] * 60_000, [i % 7 for i in range(60_000)], [i % 15_000 for i in range(60_001)]):
        (found,) = periodic.runs(w)
        assert found == (0, len(w), len(set(w)))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    out = [rng.choice([" ", "\n", "\t \x0b"]).join(_words(rng)) for _ in range(120)]
    out += [None, "", " \n", "a", "x " * 70_000, " ".join(f"w{i % 4000}" for i in range(24_000)), "a b " * 4, "a b " * 3, "A a " * 4, "é\x1cü " * 5, "no run here at all"]
    return out


def _want(words):
    found = _brute(words) if len(words) < 400 else [(0, len(words), len(set(words)))]
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    top = (None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])
    return found, top, " ".join(x for i, x in enumerate(words) if i not in gone)


def test_op13(spark, texts, monkeypatch):
    rows = [(None if i == 3 else i // 2, t, "p", "r") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, period string, runs string").repartition(3)
    got = periodic.collapse(docs.withColumnRenamed("text", "body"), text="body").collect()
    key = lambda r: (r["doc_id"] is None, r["doc_id"], r["body"] or "")
    assert len(got) == len(rows)
    for r, (d, t, *_) in zip(sorted(got, key=key), sorted(rows, key=lambda r: (r[0] is None, r[0], r[1] or "")), strict=True):
        words = SPACE.findall(t or "")
        found, top, left = _want(words)
        assert (r["doc_id"], r["body"], r["n_words"], r["n_runs"], (r["start"], r["length"], r["period"], r["exponent_milli"]), r["collapsed"]) == (d, t, len(words), len(found), top, left)
        assert [tuple(x) for x in r["runs"]] == found
    assert periodic.collapse(docs.limit(0)).collect() == []


def test_op13_query(spark, texts, tmp_path):
    """Documents of which every tenth, by its id's checksum, gets the contract's repetition."""
    rows = [(None if i % 50 == 7 else i, " ".join((t or "").split(" ")[:80]) if i % 3 else t and t[:700]) for i, t in enumerate(texts * 2)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(2).write.parquet(f"{tmp_path}/documents.parquet")
    want, woven = [], 0
    for d, t in rows:
        words = SPACE.findall(t or "")
        h = zlib.crc32(str(d).encode()) if d is not None else 1
        g, n = h // 10, len(words)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
            woven += 1
        found, top, left = _want(words)
        want.append((d, len(found), *top, hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in found).encode()).hexdigest(), hashlib.sha256(left.encode()).hexdigest()))
    assert woven > 10
    assert sorted(map(tuple, periodic.query(spark, str(tmp_path)).collect()), key=repr) == sorted(want, key=repr)


def test_stretches_hold_every_run():
    import pyarrow as pa

    rng = random.Random(9)
    texts = [" ".join(_words(rng)) for _ in range(200)]
    for r0, _, buf, offs in W.slices(pa.array(texts)):
        start, end, first = W.spans(buf, offs, W.SPACED)
        got = periodic.found_runs(W.word_hashes(buf, start, end), first, 6, 4)
        want = [(int(first[i]) + s, n, q) for i in range(len(offs) - 1) for s, n, q in _brute(texts[r0 + i].split())]
        assert sorted(got) == sorted(want)
