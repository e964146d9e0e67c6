"""PII: format-preserving pseudonyms by keyed Feistel networks, in SQL expressions only.

Validated values (payment cards by Luhn's sum, North American phone numbers, others behind a + and their country code, social security numbers, IPv4 addresses,
calendar dates, and e-mail addresses by their form) are permuted within their own format: a Feistel network over two
coordinates whose ranges multiply to the number of valid values, so that every result is valid too, and different
values stay different. The pseudonym depends on the value and the key alone, not on punctuation, so equal values stay
linked across documents. What looks like a value but isn't valid is left alone.

One regular expression finds all candidates; the text is split at them and put together again with pseudonyms. There
is no shuffle and nothing is broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.shared import table

#: Of the registered queries over the test tables. Whoever knows a key can undo its pseudonyms: callers choose their own.
TEST_KEY = "factloom"
ROUNDS = 6

#: Fixed forms, in the order in which they are tried at a place.
FORMS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9])",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])",
    "date": r"(?<![0-9./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}([./])[0-9]{1,2}\1[0-9]{4})(?![0-9]|[./-][0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9]|-[0-9])",
    "phone": r"(?<![0-9+.-])(?:\+?1[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9]|-[0-9])",
    "abroad": r"(?<![A-Za-z0-9+.-])\+[1-9](?:[ .-]?[(]?[0-9][)]?){6,14}(?![0-9]|-[0-9])",
}
#: Where a run of digits ends, as another form begins; a group that only ends in a phone's leading 1 doesn't count.
_OTHER = "|".join(FORMS[k] for k in ("ip", "date", "ssn", "phone")).replace(r"\1", "[./]").replace(r"(?:\+?1[ .-]?)?", "(?:1[ .-])?")
#: A run of groups of digits; the cards in it are found by Luhn's sum.
FORMS["card"] = rf"(?<![0-9])[0-9](?:(?:[ -](?!{_OTHER}))?[0-9]){{12,}}+"
_ANY = "(?:" + "|".join(FORMS.values()) + ")"
#: Country codes; none begins another one. Codes of three digits are the others.
_COUNTRY = "1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[2-9][0-9]{2}"
_DAYS = 73049  # 1900-01-01 to 2099-12-31, 17 * 4297


def _quoted(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _feistel(kind: str, key: str, left: str, right: str, a: str, b: str) -> str:
    """SQL for struct(l, r): a bijection of [0, a) x [0, b). left, right, a and b are SQL of bigint."""
    word = lambda tag, other: f"cast(conv(substr(sha2(concat({_quoted(f'{key}|{kind}|{tag}')}, i, '|', {other}), 256), 1, 12), 16, 10) AS bigint)"
    half = f"named_struct('l', pmod(s.l + {word('l', 's.r')}, {a}), 'r', s.r)"
    return (
        f"aggregate(sequence(1, {ROUNDS}), named_struct('l', cast({left} AS bigint), 'r', cast({right} AS bigint)), "
        f"(s, i) -> aggregate(array({half}), s, (z, y) -> named_struct('l', y.l, 'r', pmod(y.r + {word('r', 'y.l')}, {b}))))"
    )


def _luhn(d: str) -> str:
    """SQL for Luhn's sum of a digit string, the last digit counting once."""
    at = f"substr({d}, length({d}) - i + 1, 1)"
    #: The digits in the order of what they count doubled, 0 to 9.
    return f"aggregate(sequence(1, length({d})), 0, (s, i) -> s + IF(i % 2 = 1, ascii({at}) - 48, instr('0516273849', {at}) - 1))"


def _digits_back(m: str, d: str) -> str:
    """SQL: m with its digits replaced by those of d in order."""
    return f"array_join(transform(split({m}, ''), (c, j) -> IF(c rlike '[0-9]', substr({d}, length(regexp_replace(substr({m}, 1, j + 1), '[^0-9]', '')), 1), c)), '')"


def _let(value: str, name: str, body: str) -> str:
    """SQL: body with name bound to value, which is evaluated once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _cards(g: str) -> str:
    """SQL for the cards [struct(i, k, d)] among groups g of digits: k groups from the i-th, digits d. They don't overlap: from the left,
    the longest that begins at a group is taken, and the next is looked for behind it. A group begins 19 runs at most, so the time grows with the groups."""
    runs = f"transform(sequence(least(19, size({g}) - i + 1), 1, -1), k -> named_struct('i', i, 'k', k, 'd', array_join(slice({g}, i, k), '')))"
    valid = f"length(w.d) BETWEEN 13 AND 19 AND w.d rlike '[1-9]' AND {_luhn('w.d')} % 10 = 0"
    taken = _let(f"get(filter({runs}, w -> {valid}), 0)", "c", "IF(c IS NULL, s, named_struct('free', c.i + c.k, 'out', array_append(s.out, c)))")
    return f"aggregate(sequence(1, size({g})), named_struct('free', 1, 'out', cast(array() AS array<struct<i: int, k: int, d: string>>)), (s, i) -> IF(i < s.free, s, {taken})).out"


def _groups(m: str) -> str:
    return f"regexp_extract_all({m}, '[0-9]+', 0)"


def _card(m: str, key: str, counted: bool = False) -> str:
    """Of each card the first digit and the length stay; the last digit is Luhn's again. Other groups of the run stay."""
    half = "cast((length(d) - 2) div 2 AS int)"
    made = _feistel("card", key, f"substr(d, 2, {half})", f"substr(d, 2 + {half}, length(d) - 2 - {half})", f"cast(pow(10, {half}) AS bigint)", f"cast(pow(10, length(d) - 2 - {half}) AS bigint)")
    body = f"concat(substr(d, 1, 1), lpad(cast(f.l AS string), {half}, '0'), lpad(cast(f.r AS string), length(d) - 2 - {half}, '0'))"
    whole = _let(body, "e", f"concat(e, cast(pmod(10 - {_luhn('concat(e, 0)')} % 10, 10) AS string))")
    new = f"transform(cs, o -> named_struct('i', o.i, 'k', o.k, 'e', {_let('o.d', 'd', _let(made, 'f', whole))}))"
    renewed = "transform(sequence(0, o.k - 1), q -> substr(o.e, 1 + length(array_join(slice(g, o.i, q), '')), length(g[o.i - 1 + q])))"
    pieces = f"transform(ns, (o, j) -> concat({_let('IF(j = 0, 1, get(ns, j - 1).i + get(ns, j - 1).k)', 'b', 'slice(g, b, o.i - b)')}, {renewed}))"
    groups = f"concat(flatten({pieces}), slice(g, ns[size(ns) - 1].i + ns[size(ns) - 1].k, size(g)))"
    joined = f"array_join(flatten(zip_with({groups}, regexp_extract_all({m}, '[ -]', 0), (x, y) -> array(x, coalesce(y, '')))), '')"
    made = f"IF(size(cs) = 0, {m}, {_let(new, 'ns', joined)})"
    return _let(_groups(m), "g", _let(_cards("g"), "cs", f"named_struct('p', {made}, 'n', size(cs))" if counted else made))


def _phone(m: str, key: str) -> str:
    """Any three digits are an area or exchange code; a leading 1 stays."""
    made = _feistel("phone", key, "cast(substr(d, 1, 3) AS bigint)", "cast(substr(d, 4, 7) AS bigint)", "1000", "10000000")
    body = "concat(lpad(cast(f.l AS string), 3, '0'), lpad(cast(f.r AS string), 7, '0'))"
    return _let(f"regexp_replace({m}, '[^0-9]', '')", "w", _let("right(w, 10)", "d", _let(made, "f", _let(f"concat(left(w, length(w) - 10), {body})", "g", _digits_back(m, "g")))))


def _abroad(m: str, key: str) -> str:
    """Numbers of seven to fifteen digits behind a +; the country code stays, and +1 and ten digits is a phone as above."""
    half = "cast(length(d) div 2 AS int)"
    made = _feistel("abroad", key, f"substr(d, 1, {half})", f"substr(d, 1 + {half})", f"cast(pow(10, {half}) AS bigint)", f"cast(pow(10, length(d) - {half}) AS bigint)")
    body = f"concat(c, lpad(cast(f.l AS string), {half}, '0'), lpad(cast(f.r AS string), length(d) - {half}, '0'))"
    other = _let(f"regexp_extract(w, '^({_COUNTRY})', 1)", "c", _let("substr(w, 1 + length(c))", "d", _let(made, "f", _let(body, "g", _digits_back(m, "g")))))
    return _let(f"regexp_replace({m}, '[^0-9]', '')", "w", f"IF(w rlike '^1[0-9]{{10}}$', {_phone(m, key)}, {other})")


def _ssn(m: str, key: str) -> str:
    """Areas 001 to 899 but 666, groups 01 to 99, serials 0001 to 9999; others aren't valid."""
    area = "cast(substr(d, 1, 3) AS bigint)"
    made = _feistel("ssn", key, f"{area} - 1 - IF({area} > 666, 1, 0)", "(cast(substr(d, 4, 2) AS bigint) - 1) * 9999 + cast(substr(d, 6, 4) AS bigint) - 1", "898", "989901")
    body = "concat(lpad(cast(f.l + 1 + IF(f.l >= 665, 1, 0) AS string), 3, '0'), lpad(cast(f.r div 9999 + 1 AS string), 2, '0'), lpad(cast(f.r % 9999 + 1 AS string), 4, '0'))"
    valid = f"{area} BETWEEN 1 AND 899 AND {area} <> 666 AND substr(d, 4, 2) <> '00' AND substr(d, 6, 4) <> '0000'"
    return _let(f"regexp_replace({m}, '[^0-9]', '')", "d", f"IF({valid}, {_let(made, 'f', _let(body, 'g', _digits_back(m, 'g')))}, {m})")


def _ip(m: str, key: str) -> str:
    made = _feistel("ip", key, "o[0] * 256 + o[1]", "o[2] * 256 + o[3]", "65536", "65536")
    body = "concat_ws('.', f.l div 256, f.l % 256, f.r div 256, f.r % 256)"
    return _let(f"transform(split({m}, '[.]'), x -> cast(x AS bigint))", "o", f"IF(forall(o, x -> x <= 255), {_let(made, 'f', body)}, {m})")


def _date(m: str, key: str) -> str:
    """Days of 1900 to 2099. Of d/m/y and m/d/y the one that is a date, the first of them where both are."""
    made = _feistel("date", key, "n div 4297", "n % 4297", "17", "4297")
    day = "date_add(date'1900-01-01', cast(f.l * 4297 + f.r AS int))"
    iso = f"{m} rlike '^[0-9]{{4}}-'"
    part = lambda k: f"lpad(regexp_extract({m}, '^([0-9]+)[./]([0-9]+)[./]([0-9]+)$', {k}), {4 if k == 3 else 2}, '0')"
    first = f"try_to_timestamp(concat({part(3)}, '-', {part(2)}, '-', {part(1)}), 'yyyy-MM-dd')"
    second = f"try_to_timestamp(concat({part(3)}, '-', {part(1)}, '-', {part(2)}), 'yyyy-MM-dd')"
    value = f"CASE WHEN {iso} THEN try_to_timestamp({m}, 'yyyy-MM-dd') ELSE coalesce({first}, {second}) END"
    mark = f"regexp_extract({m}, '([./])', 1)"
    shown = f"CASE WHEN {iso} THEN date_format({day}, 'yyyy-MM-dd') WHEN {first} IS NOT NULL THEN date_format({day}, concat('dd', {mark}, 'MM', {mark}, 'yyyy')) ELSE date_format({day}, concat('MM', {mark}, 'dd', {mark}, 'yyyy')) END"
    return _let(f"datediff(to_date({value}), date'1900-01-01')", "n", f"IF(n BETWEEN 0 AND {_DAYS - 1}, {_let(made, 'f', shown)}, {m})")


def _email(m: str, key: str) -> str:
    """The local part's letters and digits move within their class, one half by the other in turn; the rest stays."""
    shift = lambda text, by: (
        f"array_join(transform(split({text}, ''), (c, j) -> "
        + _let(
            f"cast(conv(substr(sha2(concat({_quoted(key + '|email|')}, i, '|', j div 16, '|', {by}), 256), 1 + 4 * (j % 16), 4), 16, 10) AS int)",
            "k",
            "CASE WHEN c rlike '[0-9]' THEN cast((cast(c AS int) + k) % 10 AS string) WHEN c rlike '[a-z]' THEN chr(97 + (ascii(c) - 97 + k) % 26) WHEN c rlike '[A-Z]' THEN chr(65 + (ascii(c) - 65 + k) % 26) ELSE c END",
        )
        + "), '')"
    )
    start = "named_struct('l', substr(u, 1, cast(length(u) div 2 AS int)), 'r', substr(u, 1 + cast(length(u) div 2 AS int)))"
    step = f"(s, i) -> IF(i % 2 = 1, named_struct('l', s.l, 'r', IF(s.r = '', '', {shift('s.r', 's.l')})), named_struct('l', IF(s.l = '', '', {shift('s.l', 's.r')}), 'r', s.r))"
    return _let(f"substring_index({m}, '@', 1)", "u", f"concat({_let(f'aggregate(sequence(1, {ROUNDS}), {start}, {step})', 'f', 'concat(f.l, f.r)')}, substr({m}, 1 + length(u)))")


_MAKERS = {"email": _email, "ip": _ip, "date": _date, "ssn": _ssn, "phone": _phone, "abroad": _abroad, "card": _card}


def kind(match: str, name: str) -> str:
    """SQL: whether a found value is of the form and of none that is tried before."""
    whole = {k: _quoted("^(?:" + f.replace(r"(?<![A-Za-z0-9._%+-])", "") + ")$") for k, f in FORMS.items()}
    before = list(FORMS)[: list(FORMS).index(name)]
    return " AND ".join([f"{match} rlike {whole[name]}", *(f"NOT {match} rlike {whole[k]}" for k in before)])


def pseudonym(match: str, key: str) -> str:
    """SQL for the pseudonym of a found value; itself if it isn't valid."""
    whole = {k: _quoted("^" + f.replace(r"(?<![A-Za-z0-9._%+-])", "") + "$") for k, f in FORMS.items()}
    cases = " ".join(f"WHEN {match} rlike {whole[k]} THEN {make(match, key)}" for k, make in _MAKERS.items())
    return f"CASE {cases} ELSE {match} END"


def counted(match: str, key: str) -> str:
    """SQL for struct(p, n): a found value's pseudonym, and how many values that replaces."""
    return f"IF({kind(match, 'card')}, {_card(match, key, True)}, {_let(pseudonym(match, key), 'z', f'named_struct(\'p\', z, \'n\', IF(z = {match}, 0, 1))')})"


def pseudonymise(docs: DataFrame, key: str) -> DataFrame:
    """docs with text's personal values replaced, and n_found (long: values replaced).

    A null text stays null and an empty one empty, with n_found 0; so does any text without a value. Other columns
    and repeated rows pass as they are; a column n_found is replaced.
    """
    text = F.col("text")
    some = text.rlike("[0-9]{3}|@|[0-9][ ./-][0-9]|[+][1-9]")
    found = docs.withColumn("__m", F.when(some, F.expr(f"regexp_extract_all(text, {_quoted(_ANY)}, 0)")).otherwise(F.array().cast("array<string>")))
    found = found.withColumn("__p", F.expr(f"transform(__m, m -> {counted('m', key)})"))
    parts: Column = F.expr(f"split(text, {_quoted(_ANY)}, -1)")
    joined = F.concat_ws("", F.flatten(F.zip_with(parts, F.concat(F.col("__p.p"), F.array(F.lit(""))), lambda a, b: F.array(a, b))))
    out = found.withColumn("text", F.when(F.size("__m") > 0, joined).otherwise(text))
    out = out.withColumn("n_found", F.coalesce(F.expr("aggregate(__p.n, 0, (n, x) -> n + x)"), F.lit(0)).cast("long"))
    return out.drop("__m", "__p").select(*docs.drop("n_found").columns, "n_found")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), TEST_KEY)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str, key: str | None = None) -> DataFrame:
    """docs under the given key, or the one in spark.factloom.pii.key; without either nothing is written, as anyone could undo a published key."""
    if not (key := key or spark.conf.get("spark.factloom.pii.key", None)):
        raise ValueError("set spark.factloom.pii.key to a secret of your own")
    return pseudonymise(docs, key).select(*docs.columns)
