"""The ten operators against brute force, on a table with nulls, empty and very long texts, ties, repeated rows and
columns whose names clash."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from factloom.llm import bpe, chat, components, decontaminate, jaccard, language, lm, pii, quality, sketch, substring, toxicity
from factloom.llm import words as W
from factloom.llm.shared import bucket

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words string, score string, kept string, ids string"
SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def _docs():
    rng = random.Random(5)
    syllables = {"en": ["th", "er", "ing", "an", "on"], "de": ["sch", "ung", "ein", "zu", "ß"], "fr": ["eau", "ê", "ment", "oi", "ç"]}
    word = lambda lang: "".join(rng.choice(syllables[lang]) for _ in range(rng.randint(1, 3)))
    text = lambda n, lang="en": " ".join(word(lang) for _ in range(n)) + "."
    rows = [text(rng.randint(25, 120), lang) for lang in ("en", "de", "fr") for _ in range(14)]
    base = text(100)
    near = base.split()
    near[3] = "changed"
    passage = " ".join(text(20).split())
    rows += [base, base, " ".join(near), "", None, " \t\n\x0b", "a b c", "A b C", "one two three", "日本語 テスト の文 é́", "x" * 5000, text(6000)]
    rows += ["\n".join(["same line of text here again and again"] * 9), passage + " " + text(40), text(30) + " " + passage, "### *** |||| $$$ %%%", "<|endoftext|> It's THE end", "\x1c\x1d\x85   words"]
    rows += [f"{text(30)} idiot {text(3)} scum {text(3)} moron" for _ in range(12)]
    out = [(i, t, None if i % 17 == 0 or i >= 42 else ("en", "de", "fr")[i // 14], "s", None, "x", "y", "z", "w") for i, t in enumerate(rows)]
    return [*out, out[3], (None, rows[5], "en", None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(_docs(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(r[0], None if r[0] % 19 == 0 else int("#" not in (r[1] or "")), int("scum" in (r[1] or ""))) for r in _docs() if r[0] is not None]
    return spark.createDataFrame([*rows, (None, 1, 1), (3, 1, 0)], "doc_id long, quality int, toxic int")


def _key(r):
    return (r[0] is None, r[0], r[1] or "")


def _by_text(got, *names):
    """Rows as tuples, sorted."""
    return sorted((tuple(r[n] for n in names) for r in got), key=repr)


def test_word_hashes_tell_words_apart():
    texts = ["a ab b\tab", "", "ab", "é ab\nç"]
    import pyarrow as pa

    for r0, r1, buf, offs in W.slices(pa.array(texts), 5):
        start, end, first = W.spans(buf, offs, W.SPACED)
        h = W.word_hashes(buf, start, end)
        words = [x for t in texts[r0:r1] for x in SPACE.findall(t)]
        assert [buf[s:e].tobytes().decode() for s, e in zip(start, end, strict=True)] == words
        assert len(set(h.tolist())) == len(set(words))
        assert np.diff(first).tolist() == [len(SPACE.findall(t)) for t in texts[r0:r1]]


def test_op1(docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.vocabulary())
    got = bpe.encode(docs.select("doc_id", "text"), digests=True, most=3).collect()
    want = []
    for d, x, *_ in _docs():
        ids = t.encode(x or "", add_special_tokens=False).ids
        want.append((d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert _by_text(got, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=repr)
    whole = bpe.encode(docs)
    assert "ids" in whole.columns and dict(whole.dtypes)["ids"] == "array<int>"
    r = whole.filter("doc_id = 0").first()
    assert r.ids == t.encode(r.text, add_special_tokens=False).ids
    assert bpe.encode(docs.limit(0)).count() == 0


def test_op1_cuts_anywhere(monkeypatch):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.vocabulary())
    coder = bpe.Coder(bpe.vocabulary(), {})
    rng = random.Random(1)
    texts = [x for _, x, *_ in _docs() if x][:60]
    cut = []
    for x in texts:
        at = sorted(rng.randint(0, len(x)) for _ in range(8))
        cut.append([x[a:b].encode() for a, b in zip([0, *at], [*at, len(x)], strict=True) if b > a])
    for x, (n, ids, _) in zip(texts, coder.encode(cut), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == t.encode(x, add_special_tokens=False).ids and n == len(ids) // 4


def _runs(words, n):
    return [(i, tuple(words[i : i + n])) for i in range(len(words) - n + 1)]


def test_op2(spark, docs):
    rows = _docs()
    items = [(1, " ".join(rows[0][1].split()[3:20]).upper()), (20, "one, TWO"), (3, rows[15][1]), (4, None), (5, "--"), (6, rows[0][1])]
    table = spark.createDataFrame(items, "item_id long, text string")
    find = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = lambda s: find.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s or ""))
    want = []
    for d, x, *_ in rows:
        ws, hit, ids = low(x), set(), set()
        for i, t in items:
            w = low(t)
            n = min(10, len(w))
            have = {k for _, k in _runs(w, n)} if n else set()
            for j, k in _runs(ws, n) if n else []:
                if k in have:
                    hit |= set(range(j, j + n))
                    ids.add(str(i))
        want.append((d, len(ws), len(hit), sorted(ids)))
    for block in (1 << 20, 40):
        got = decontaminate.find(docs, table, block_bytes=block).collect()
        assert _by_text(got, "doc_id", "n_words", "n_hit", "items") == sorted(want, key=repr)
    assert decontaminate.find(docs, table.limit(0)).filter("n_hit > 0").count() == 0
    assert decontaminate.remove(docs, table).count() == sum(w[2] == 0 for w in want)
    spans = {r.doc_id: r.text for r in decontaminate.remove(docs, table, "spans").collect()}
    assert low(spans[0]) == [] and spans[4] == rows[4][1]


def test_op3(spark):
    rows = [(1, 0, None, "System: be kind\nUser: hello?\nAssistant: Hi there, how can I help you today?\nmore lines"), (1, 1, "human", "thanks"), (1, 2, None, "You are welcome. " * 20), (2, None, "user", None), (2, None, "user", None), (None, 3, "odd", "")]
    rows += [(3, i, ("user", "assistant")[i % 2], "short?" if i % 2 == 0 else "a long answer\n" * 9) for i in range(40)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("part", chat.F.lit("clash"))
    one = sorted(map(repr, chat.format_turns(table, span=1000).collect()))
    many = sorted(map(repr, chat.format_turns(table, span=4).collect()))
    assert one == many
    got = [(r.role, r.text) for r in sorted(chat.format_turns(table).filter("conv_id = 1").collect(), key=lambda r: (r.turn, r.part))]
    assert [g[0] for g in got] == ["system", "user", "assistant", "user", "assistant"] and got[0][1] == "be kind"
    assert len(one) == len(rows) + 2
    assert chat.format_turns(table.limit(0)).count() == 0


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(0)
    e = rng.normal(size=(6, 3))
    import itertools

    score = lambda p: chat._FIRST[p[0]] + e[0, p[0]] + sum(chat._TURN[a, b] + e[i, b] for i, (a, b) in enumerate(zip(p, p[1:], strict=False), 1))
    assert tuple(chat.viterbi(e, chat._FIRST)) == max(itertools.product(range(3), repeat=6), key=score)


def _luhn(s):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(s))) % 10 == 0


def test_op4(spark, docs):
    values = ["4111111111111111", "4111 1111 1111 1111", "4111111111111112", "+1 (743) 555-3824", "743-555-3824", "123-45-6789", "666-45-6789", "10.0.255.1", "300.1.1.1", "2024-02-29", "2023-02-29", "31.12.1999", "12/31/1999", "jane.doe7@example.com", "version 1.2.3", "$12.50"]
    rows = [(i, f"see {v}, or ({v})!") for i, v in enumerate(values)] + [(90, None), (91, ""), (92, "clean text 2024 and 12 words"), (90, None)]
    got = {r.doc_id: r for r in pii.pseudonymise(spark.createDataFrame(rows, "doc_id long, text string"), pii.TEST_KEY).collect()}
    new = {v: re.fullmatch(r"see (.*), or \((.*)\)!", got[i].text, re.S).groups() for i, v in enumerate(values)}
    assert all(a == b for a, b in new.values())
    new = {v: a for v, (a, _) in new.items()}
    same = {v for v in values if new[v] == v}
    assert same == {"4111111111111112", "666-45-6789", "300.1.1.1", "2023-02-29", "version 1.2.3", "$12.50"}
    shape = lambda s: re.sub("[a-z]", "a", re.sub("[0-9]", "9", s))
    assert all(shape(new[v]) == shape(v) for v in values if "." not in v or "@" in v or "/" in v)
    assert _luhn(new["4111111111111111"]) and new["4111 1111 1111 1111"].replace(" ", "") == new["4111111111111111"]
    assert re.sub(r"\D", "", new["+1 (743) 555-3824"])[1:] == re.sub(r"\D", "", new["743-555-3824"])
    assert all(int(x) < 256 for x in new["10.0.255.1"].split("."))
    assert (got[90].text, got[91].text, got[92].text, got[0].n_found, got[92].n_found) == (None, "", rows[-2][1], 2, 0)
    plain = pii.pseudonymise(docs, pii.TEST_KEY)
    assert plain.columns == [*docs.columns, "n_found"] and plain.count() == len(_docs())
    assert pii.pseudonymise(docs.limit(0), pii.TEST_KEY).count() == 0


def test_op4_is_a_permutation(spark):
    days = spark.range(3000).selectExpr("date_format(date_add(date'1995-01-01', cast(id AS int)), 'yyyy-MM-dd') AS text")
    cards = spark.range(2000).selectExpr("concat(lpad(cast(id AS string), 3, '0'), '-12-', lpad(cast(id + 1 AS string), 4, '0')) AS text").filter("text NOT LIKE '666%' AND text NOT LIKE '000%' AND length(text) = 11")
    for t in (days, cards):
        got = pii.pseudonymise(t, pii.TEST_KEY)
        assert got.select("text").distinct().count() == t.count() == got.filter("n_found <= 1").count()


def test_op4_phones_of_all_codes_and_countries(spark):
    values = ["+1 (017) 555-7713", "+1 (132) 555-1352", "017-155-7713", "+10175557713", "+44 20 7946 0958", "+442079460958", "+44 (0)20 7946 0958", "+49 30 1234567", "+353 1 234 5678", "+1 17 12"]
    got = pii.pseudonymise(spark.createDataFrame([(i, f"call {v}, or ({v})!") for i, v in enumerate(values)], "doc_id long, text string"), pii.TEST_KEY).collect()
    new = {values[r.doc_id]: re.fullmatch(r"call (.*), or \((.*)\)!", r.text).groups() for r in got}
    assert all(a == b for a, b in new.values())
    new = {v: a for v, (a, _) in new.items()}
    assert {v for v in values if new[v] == v} == {"+1 17 12"}
    assert all(re.sub("[0-9]", "9", new[v]) == re.sub("[0-9]", "9", v) for v in values)
    digits = {v: re.sub(r"\D", "", new[v]) for v in values}
    assert digits["+1 (017) 555-7713"] == digits["+10175557713"] and digits["+44 20 7946 0958"] == digits["+442079460958"]
    assert [digits[v][:n] for v, n in (("+44 20 7946 0958", 2), ("+49 30 1234567", 2), ("+353 1 234 5678", 3))] == ["44", "49", "353"]
    area = spark.range(1000).selectExpr("concat(lpad(cast(id AS string), 3, '0'), '-155-7713') AS text")
    assert pii.pseudonymise(area, pii.TEST_KEY).filter("n_found <= 1").select("text").distinct().count() == 1000


def test_op4_cards_beside_other_numbers(spark):
    card, other = "4111 1111 1111 1111", "5500 0000 0000 0004"
    forms = ["{} 12/25", "{} 123", "7 {}", "{} 2024-02-29", "{} 123-45-6789", "{} 212 555 0123", "12 {} 12 34", "1234 {} 12", "{} " + other]
    rows = [(i, "pay " + f.format(card)) for i, f in enumerate(forms)] + [(20, card), (21, "41 11 11 11 11 11 11 11"), (22, "1 2 " * 2_000), (23, "1" * 50_000), (24, other), (25, "pay 1 2 3 4 5 6 7 8 9 1 2 3")]
    got = {r.doc_id: r for r in pii.pseudonymise(spark.createDataFrame(rows, "doc_id long, text string"), pii.TEST_KEY).collect()}
    new = got[20].text
    assert new != card and _luhn(new.replace(" ", "")) and got[21].text.replace(" ", "") == new.replace(" ", "")
    for i, f in enumerate(forms):
        before, after = ("pay " + f).split("{}")
        if i in (3, 4, 5):
            assert got[i].text.startswith(f"pay {new} ") and got[i].text[len(before + new) :] != after and got[i].n_found == 2
        elif i == 8:
            assert (got[i].text, got[i].n_found) == (f"pay {new} {got[24].text}", 2)
        else:
            assert (got[i].text, got[i].n_found) == (before + new + after, 1)
    assert got[23].text == rows[-3][1] and got[25].text == rows[-1][1] and len(got[22].text) == 8_000


def test_op5(docs):
    got = language.apply(docs, bucket("doc_id", 4) != 2).collect()
    assert len(got) == len(_docs())
    by = {(r.doc_id, r.text): r for r in got}
    assert by[45, ""].lang_pred == by[46, None].lang_pred == "und" and by[47, " \t\n\x0b"].score == 0
    some = [r for r in got if r.doc_id is not None and r.doc_id < 42]
    assert sum(r.lang_pred == ("en", "de", "fr")[r.doc_id // 14] for r in some) > 0.9 * len(some)
    assert all(0 <= r.score <= 1 for r in got)
    assert {r.lang_pred for r in language.apply(docs, language.F.lit(False)).collect()} == {"und"}
    assert language.apply(docs.limit(0), language.F.lit(True)).count() == 0


def test_op5_gradients():
    rng = np.random.default_rng(1)
    n, x = 3, rng.integers(0, 5, (4, 2))
    t, u, out = rng.normal(size=(5, 3 * n)), rng.normal(size=(n, 3 * n)), rng.normal(size=(4, 2, n))
    loss = lambda t, u: float((language._states(t, u, x) * out).sum())
    trace = []
    language._states(t.astype(np.float32), u.astype(np.float32), x, trace)
    du, _ = language._gradients(u.astype(np.float32), trace, out.astype(np.float32))
    for i, j in ((0, 0), (1, 4), (2, 8)):
        step = np.zeros_like(u)
        step[i, j] = 1e-2
        assert abs((loss(t, u + step) - loss(t, u - step)) / 2e-2 - du[i, j]) < 2e-2


def test_op6(docs, labels):
    got = toxicity.apply(docs, labels).collect()
    assert len(got) == len(_docs()) and all(0 <= r.score <= 1 for r in got)
    assert {r.doc_id for r in got if r.predicted} == {r[0] for r in _docs() if "scum" in (r[1] or "")}
    assert all(r.predicted == 0 for r in toxicity.apply(docs, labels.limit(0)).collect())
    assert toxicity.apply(docs.limit(0), labels).count() == 0


def test_op6_neighbours_are_exact():
    rng = np.random.default_rng(2)
    vectors = []
    for _ in range(700):
        v = {int(t): float(rng.random() + 0.1) for t in rng.choice(30, rng.integers(1, 6), replace=False)}
        norm = math.sqrt(sum(w * w for w in v.values()))
        vectors.append({t: w / norm for t, w in v.items()})
    ix = toxicity.Index(vectors, 30)
    for q in vectors[:40]:
        cos = [(round(sum(w * v.get(t, 0) for t, w in sorted(q.items())), 9), -i) for i, v in enumerate(vectors)]
        want = sorted((c for c in cos if c[0] > 0), reverse=True)[:15]
        assert [round(s, 9) for s, _ in ix.nearest(q, 15)] == [c[0] for c in want]


def test_op6_all_words_weigh():
    """Scores, neighbours and cosines against a loop over all words of the examples, also those that don't go with the label."""
    rng = random.Random(3)
    examples = []
    for i in range(150):
        words = [f"w{rng.randrange(60)}" for _ in range(rng.randint(0, 12))] + ["scum"] * (i % 5 == 0) + ["moron"] * (i % 10 == 0)
        examples.append((i, int(i % 5 == 0), {w.encode(): words.count(w) for w in words}))
    model = toxicity.Model(examples)
    n, positive = len(examples), sum(y for _, y, _ in examples)
    weight = {}
    for w in {w for _, _, c in examples for w in c}:
        df, a = sum(w in c for _, _, c in examples), sum(w in c and y for _, y, c in examples)
        chi = n * (a * (n - df - positive + a) - (df - a) * (positive - a)) ** 2 / (df * (n - df) * positive * (n - positive))
        weight[w] = math.log((n + 1) / (df + 0.5)) * (1 + chi)
    assert set(model.words) == set(weight) and min(weight.values()) > 0
    unit = lambda v: {w: x / math.sqrt(sum(y * y for y in v.values())) for w, x in v.items()}
    vectors = [unit({w: (1 + math.log(k)) * weight[w] for w, k in c.items()}) for _, _, c in examples]
    for text in ("w1 w2 w2 w3", "w4 scum other", "other", "", "w5 W6"):
        buf = np.frombuffer(text.encode(), np.uint8)
        score, best = model.score(model.counts(buf, np.array([0, len(buf)]))[0])
        words = [w.encode() for w in text.lower().split() if w.encode() in weight]
        q = unit({w: (1 + math.log(words.count(w))) * weight[w] for w in words})
        want = sorted(((-sum(x * v.get(w, 0) for w, x in q.items()), i) for i, v in enumerate(vectors)))[:15] if q else []
        want = [(-c, i) for c, i in want if c < 0]
        assert [round(c, 9) for c, _ in best] == [round(c, 9) for c, _ in want] and bool(best) == bool(words)
        if best:
            vote = sum(c * examples[model.ids[e]][1] for c, e in best) / sum(c for c, _ in best)
            assert abs(score - 1 / (1 + math.exp(-model.scale * vote - model.shift))) < 1e-9
        else:
            assert score == model.without


def _components(rows):
    low = lambda s: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s or "")
    sets = []
    for d, x, *_ in rows:
        w = SPACE.findall(low(x))
        sets.append((d, {k for _, k in _runs(w, 5)} if len(w) >= 5 else {tuple(w)} if w else set()))
    up = {d: d for d, _ in sets}

    def root(d):
        while up[d] != d:
            d = up[d]
        return d

    for i, (a, s) in enumerate(sets):
        for b, t in sets[:i]:
            if None not in (a, b) and s and t and 100 * len(s & t) >= 80 * len(s | t) and root(a) != root(b):
                lo, hi = sorted((root(a), root(b)))
                up[hi] = lo
    return [(d, len(s), None if d is None else root(d)) for d, s in sets]


@pytest.mark.parametrize("block", [1024, 3])
def test_op7(spark, docs, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rng = random.Random(3)
    rows = [r[:2] for r in _docs()]
    words = [f"w{i}" for i in range(60)]
    for i in range(30):  # a group about the threshold, linked by its base or by each other
        w = list(words)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(60)] = f"x{rng.randrange(99)}"
        rows.append((200 + i, " ".join(w)))
    got = jaccard.join(spark.createDataFrame(rows, "doc_id long, text string").withColumn("token", jaccard.F.lit(1))).collect()
    assert _by_text(got, "doc_id", "n_shingles", "component_id") == sorted(_components(rows), key=repr)
    assert jaccard.join(docs.limit(0)).count() == 0


def test_op7_stage_keeps_one_row_of_each_group(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(1, text), (1, text), (2, text), (3, text + " more"), (7, "alone here"), (7, "alone here"), (8, None), (8, ""), (None, text), (None, text)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("__n", jaccard.F.lit(1))
    got = jaccard.stage(spark, docs, "")
    assert got.columns == docs.columns
    assert _by_text(got.collect(), "doc_id", "text") == sorted([(1, text), (7, "alone here"), (8, ""), (None, text), (None, text)], key=repr)


def test_op7_template_without_links(spark, monkeypatch):
    """Texts of 200 shared words and 33 own ones don't link, and their bucket is dropped before it makes a pair."""
    shared = " ".join(f"s{i}" for i in range(200))
    rows = [(i, " ".join(f"o{i}x{j}" for j in range(33)) + " " + shared) for i in range(300)]
    made = []
    monkeypatch.setattr(jaccard, "_pairs", lambda *x, f=jaccard._pairs: made.append(f(*x).count()) or f(*x))
    got = jaccard.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(r.doc_id == r.component_id for r in got) and made == [0, 0]


def test_op7_sketch_grows_with_the_tokens(spark, monkeypatch):
    """200,000 tokens fill the 2**16 cells three times; in cells by their number texts without a partner still go."""
    monkeypatch.setattr(jaccard, "CELL_BITS", 16)
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(500))) for i in range(400)]
    kept = []
    monkeypatch.setattr(jaccard, "_prefixes", lambda sets, *x, f=jaccard._prefixes: kept.append(sets.count()) or f(sets, *x))
    got = jaccard.join(spark.createDataFrame([*rows, (400, rows[7][1] + " more")], "doc_id long, text string")).collect()
    assert {r.doc_id for r in got if r.doc_id != r.component_id} == {400} and kept[0] < 20


def test_op7_takes_ids_of_any_type(spark):
    text = " ".join(f"w{i}" for i in range(40))
    got = jaccard.join(spark.createDataFrame([("b", text), ("a", text + " more"), ("c", "else")], "doc_id string, text string")).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [("a", "a"), ("b", "a"), ("c", "c")]


def test_components(spark):
    links = [(1, 2), (2, 3), (5, 4), (9, 8), (8, 7), (7, 3), (20, 20)] + [(100 + i, 101 + i) for i in range(40)]
    got = {r.id: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 7: 1, 8: 1, 9: 1, 4: 4, 5: 4} | {100 + i: 100 for i in range(41)}


def test_op8(docs):
    rows = _docs()
    got = lm.score(docs).collect()
    train = [r for r in rows if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 != 2]
    low = lambda s: (s or "").encode().lower().split()
    c = collections.Counter(w for r in train for w in low(r[1]))
    n, v = sum(c.values()) + len(train), len(c) + 1
    base = lambda x: sum(math.log10((c[w] + 1) / (n + v + 1)) for w in low(x)) + math.log10((len(train) + 1) / (n + v + 1))
    want = sorted(((d, len(low(x)) + 1, sum(c[w] > 0 for w in low(x)) + 1, n, round(base(x), 6)) for d, x, *_ in rows), key=repr)
    assert sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got), key=repr) == want
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)
    assert lm.score(docs.limit(0)).count() == 0
    alone = lm.score(docs.filter("doc_id IS NULL")).first()
    assert (alone.train_tokens, alone.base_score, alone.held_out) == (0, 0.0, False)


def _small_mixer(seed=2):
    rng = np.random.default_rng(seed)
    coder = lm.Coder([(b"a", 50), (b"b", 30), (b"c", 20)], 4, 9)
    n = rng.integers(0, 9, (2, lm.TABLES, 3 << coder.bits))
    weights = lm.first_weights() + rng.normal(0, 0.1, lm.first_weights().shape)
    return coder, lm.Mixer(lm.read(n[0], n[1]), weights), rng


def _tokens(coder, texts):
    return coder.tokens(np.frombuffer(b"".join(texts), np.uint8), np.append(0, np.cumsum([len(t) for t in texts])))


def test_op8_mixes_as_decision_by_decision(monkeypatch):
    """run() against a plain loop over single decisions, with dictionaries for weights and a text's own counts."""
    coder, mixer, rng = _small_mixer()
    texts = [b" ".join(rng.choice([b"a", b"b", b"c", b"xy", b"zed"], n)) for n in (60, 3, 300, 0, 700)]
    halves = np.array([0, 1, 2, 2, 0], np.int8)
    got = mixer.run(_tokens(coder, texts), halves, coder)
    want = []
    for text, half in zip(texts, halves.tolist(), strict=True):
        t = _tokens(coder, [text])
        runs, total = lm.ends_of_runs(len(t.sym)).tolist(), 0.0
        for kind, (slots, own, bits, of) in enumerate(coder.decisions(t)):
            weights, seen = mixer.weights[kind].copy(), collections.defaultdict(lambda: [0, 0])
            place = t.place[of].tolist()
            for lo, hi in zip([0, *runs], runs, strict=False):
                change, later = np.zeros_like(weights), []
                for i in [i for i, x in enumerate(place) if lo <= x < hi]:
                    raw = [int(mixer.packed[k][slots[k][i] + (half << coder.bits)]) for k in range(lm.TABLES)]
                    n = [min(31, x) for x in seen[int(own[i])]]
                    x = np.array([*(v >> 2 for v in raw), round(math.log((n[1] + 0.4) / (n[0] + 0.4)) * 512), 0.3 * 512]) / 512
                    gate = (raw[0] & 3) * 4 + (raw[1] & 3)
                    p = 1 / (1 + math.exp(-float(weights[gate] @ x)))
                    total += math.log(p if bits[i] else 1 - p)
                    change[gate] += (float(bits[i]) - p) * x
                    later.append((int(own[i]), int(bits[i])))
                weights += np.clip(lm.RATE * change, -lm.STEP, lm.STEP)
                for s, b in later:
                    seen[s][b] += 1
        want.append(total)
    assert np.allclose(got, want, rtol=1e-4)
    monkeypatch.setattr(lm, "RATE", 0)
    frozen = mixer.run(_tokens(coder, texts), halves, coder)
    assert [abs(a - b) > 1e-6 for a, b in zip(got, frozen, strict=True)] == [True, False, True, False, True]


def test_op8_makes_the_decisions_of_one_run_at_a_time(monkeypatch):
    coder, mixer, _ = _small_mixer()
    t, at_once = _tokens(coder, [b"a b xy " * 100, b"c a", b"b " * 40]), []
    decisions = lm.Coder.decisions
    monkeypatch.setattr(lm.Coder, "decisions", lambda self, t, order=None: at_once.append(len(t.sym) if order is None else len(order)) or decisions(self, t, order))
    mixer.run(t, np.array([0, 1, 2], np.int8), coder)
    assert sum(at_once) == len(t.sym) and max(at_once) <= max(3 * lm.RUN, 301 // lm.GROWTH)


def test_op8_starts_from_weights_of_all_documents(spark):
    coder, mixer, _ = _small_mixer()
    held = lambda x: type("Held", (), {"value": x})()
    rows = [(i, " ".join(f"w{i * k % 40}" for k in range(3 + i % 9))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = lm._weights(docs, held(coder), held(mixer.packed))
    want, by_task = np.zeros_like(got), collections.defaultdict(list)
    for r in docs.withColumn("task", jaccard.F.spark_partition_id()).collect():
        by_task[r.task].append((r.doc_id, r.text))
    for some in by_task.values():
        data = [t.encode() for _, t in some]
        own = lm.Mixer(mixer.packed)
        own.learn(coder.tokens(np.frombuffer(b"".join(data), np.uint8), np.append(0, np.cumsum([len(x) for x in data]))), np.array([lm._half(i) for i, _ in some], np.int8), coder, np.full(own.weights.shape, 1e-6))
        want += own.weights * len(some) / len(rows)
    assert np.allclose(got, want) and not np.allclose(got, lm.first_weights())
    assert lm._weights(docs.limit(0), held(coder), held(mixer.packed)) is None


def test_op8_symbols_and_places():
    coder, _, _ = _small_mixer()
    t = _tokens(coder, [b"A b  xy\nc", b"", b"c"])
    assert t.sym.tolist() == [2, 3, lm.ESCAPE, 4, lm.END, lm.END, 4, lm.END]
    assert (t.row.tolist(), t.place.tolist(), t.n.tolist()) == ([0] * 5 + [1] + [2, 2], [0, 1, 2, 3, 4, 0, 0, 1], [5, 1, 2])
    runs = lm.ends_of_runs(5000)
    assert runs[0] == lm.RUN and runs[-1] >= 5000 and (np.diff(runs) <= np.maximum(lm.RUN, runs[:-1] / 8)).all()


def test_op8_huffman_is_least():
    import heapq

    rng = random.Random(0)
    for _ in range(100):
        c = [rng.randint(0, 9) for _ in range(rng.randint(2, 40))]
        offsets, nodes, bits = lm.huffman(c)
        codes = [tuple(bits[a:b].tolist()) for a, b in zip(offsets, offsets[1:], strict=False)]
        heap, total = list(c), 0
        heapq.heapify(heap)
        while len(heap) > 1:
            x = heapq.heappop(heap) + heapq.heappop(heap)
            total += x
            heapq.heappush(heap, x)
        assert len(set(codes)) == len(c) and sum(2.0 ** -len(x) for x in codes) == 1 and total == sum(len(x) * n for x, n in zip(codes, c, strict=True))


def test_op8_is_a_distribution():
    """Over all words of the head, the end and the escape, and over all bytes, the model's probabilities sum to one."""
    coder, mixer, _ = _small_mixer()
    for kind, tree in enumerate((coder.words, coder.letters)):
        total = 0.0
        for s in range(len(tree[0]) - 1):
            slots, own, bits, _ = coder._paths(tree, np.array([s]), [np.array([5], np.uint32)] * 2, np.array([6], np.uint32) if kind else None)
            out = np.zeros(1)
            mixer._code([p.take(x) for p, x in zip(mixer.packed, slots, strict=True)], own, bits, np.zeros(len(bits), np.int32), [len(bits)], [0], kind, out, None)
            total += math.exp(out[0])
        assert abs(total - 1) < 1e-4


def _substrings(rows):
    first = {}
    for d, x, *_ in rows:
        if d is not None:
            for _, k in _runs(SPACE.findall(x or ""), 13):
                first[k] = min(d, first.get(k, d))
    out = []
    for d, x, *_ in rows:
        w = SPACE.findall(x or "")
        gone = {j for i, k in _runs(w, 13) if d is not None and first[k] < d for j in range(i, i + 13)}
        out.append((d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


@pytest.mark.parametrize(("hot", "keys"), [(1000, 500_000), (2, 500_000), (2, 0)])
def test_op9(docs, monkeypatch, hot, keys):
    monkeypatch.setattr(substring, "HOT", hot)
    monkeypatch.setattr(substring, "BROADCAST_KEYS", keys)
    got = substring.apply(docs, bits=18).collect()
    assert _by_text(got, "doc_id", "n_words", "n_removed", "kept_text") == sorted(_substrings(_docs()), key=repr)
    assert substring.apply(docs.limit(0), bits=18).count() == 0


def test_sketch_loses_nothing(docs):
    fp = lambda buf, offs: W.word_hashes(buf, *W.spans(buf, offs, W.SPACED)[:2])
    twice, hot = sketch.count(docs.select("text"), fp, 17, 2, 40)
    c = collections.Counter(w for _, x, *_ in _docs() for w in SPACE.findall(x or ""))
    h = np.array([fp(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w.encode())]))[0] for w in c])
    n = np.array(list(c.values()))
    assert sketch.repeated(np.frombuffer(twice, np.uint8), h, 17, 2)[n > 1].all()
    assert sketch.is_hot(np.frombuffer(hot, np.uint8), h).tolist() == (n >= 40).tolist()


def test_partition_sketches_add_up():
    """Whatever the partitions, their sketches merge to the counters of all, and none is larger than a sketch."""
    rng = np.random.default_rng(4)
    fp = rng.integers(0, 1 << 62, 120_000).astype(np.uint64)
    fp[40_000:60_000] = fp[:20_000]
    total = np.zeros(2 << 17, np.int64)
    for part in np.array_split(fp, 3):
        sk = sketch.Sketch(17, 2)
        for x in np.array_split(part, 5):
            sk.add(x)
            sk.settle()
        got = list(sk.parts())
        assert sum(len(p) for _, p, _ in got) <= 2 * (2 << 17) // 8
        for b, p, whole in got:
            sketch.merged(total[b << 16 : (b + 1) << 16], p, whole)
    for k in range(2):
        cells = sketch.cells(fp, 17, k)
        want = sum(np.minimum(2, np.bincount(x, minlength=1 << 17)) for x in np.array_split(cells, 3))
        assert (total[k << 17 : (k + 1) << 17] == want).all()


def test_op10(docs, labels):
    got = quality.apply(docs, labels).collect()
    want = []
    for d, x, *_ in _docs():
        w = SPACE.findall(x or "")
        lines = [y for y in (x or "").split("\n") if SPACE.search(y)]
        n = collections.Counter(k for _, k in _runs(w, 8))
        rep = {j for i, k in _runs(w, 8) if n[k] > 1 for j in range(i, i + 8)}
        want.append((d, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", x or "")), len(lines) - len(set(lines)), len(rep), len(w) < 20 or 100 * len(rep) > 30 * len(w)))
    assert _by_text(got, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == sorted(want, key=repr)
    assert not any(r.kept and r.base_failed for r in got) and any(r.kept for r in got)
    none = quality.apply(docs, labels.limit(0)).collect()
    assert all(r.kept != r.base_failed for r in none)
    assert quality.apply(docs.limit(0), labels).count() == 0


def test_pipeline(spark, docs, labels, tmp_path):
    import corpus_pipeline

    table = docs.withColumn("n_chars", docs["doc_id"])
    table.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    item = _docs()[1][1]
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    kept = {(r.doc_id, r.text) for r in quality.apply(docs, labels).filter("kept").select("doc_id", "text").collect()}
    comp = {c[0]: c[2] for c in _components(sorted(kept, key=repr))}
    want = {d for d, x in kept if d is None or comp[d] == d}
    want = {d for d in want if d != 1}
    assert {r.doc_id for r in got} == want
    assert all(len(r.ids) == r.n_tokens for r in got)


