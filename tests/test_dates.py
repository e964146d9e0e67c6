"""Dates, durations and measures in text against a plain loop over the words."""

import datetime
import random
import re

from factloom.operators import dates as D


def _spans(text):
    words = re.findall(D.TOKEN, text or "", re.ASCII)
    units = D._units()
    low = [w.lower() for w in words]
    out, parts, wholes = [], [], []

    def real(v):
        try:
            return datetime.date.fromisoformat(v)
        except ValueError:
            return None

    relative = []
    for i, w in enumerate(words):
        unit = units.get(low[i + 1]) if i + 1 < len(words) else None
        western = re.fullmatch(r"(\d{1,2})[/.-](\d{1,2})[/.-](\d{4})", w)
        day = re.fullmatch(r"(\d{1,2})(?:st|nd|rd|th)?", w)
        month = next((k for k, m in enumerate(D.MONTHS, 1) if low[i] in (m, m[:3])), None)
        if re.fullmatch(r"\d+(\.\d+)?", w) and unit:
            if i + 2 < len(words) and low[i + 2] == "ago" and unit in ("day", "week", "month", "year") and "." not in w:
                relative.append((i, 3, -float(w), unit))
            else:
                out.append(("duration" if unit in D.DURATIONS else "measure", i, 2, None, float(w), unit))
        elif re.fullmatch(r"\d{4}-\d\d-\d\d", w) and real(w):
            out.append(("date", i, 1, w, None, None))
            wholes.append((i, w))
        elif western and real(v := f"{western[3]}-{int(western[1]):02}-{int(western[2]):02}"):
            out.append(("date", i, 1, v, None, None))
            wholes.append((i, v))
        elif re.fullmatch(r"\d{4}-\d{4}", w):
            out.append(("years", i, 1, w.replace("-", "/"), None, None))
        elif re.fullmatch(r"([01]?\d|2[0-3]):[0-5]\d(:[0-5]\d)?", w):
            t = w.zfill(5) if w.count(":") == 1 else w.zfill(8)
            out.append(("time", i, 1, t + ":00" if t.count(":") == 1 else t, None, None))
        elif low[i] in D.RELATIVE:
            relative.append((i, 1, float(D.RELATIVE[low[i]]), "day"))
        elif low[i] in D.WEEKDAYS:
            out.append(("weekday", i, 1, low[i], None, None))
        elif month or re.fullmatch(r"\d{4}", w) or (day and 1 <= int(day[1]) <= 31):
            parts.append((i, "M", f"{month:02}") if month else (i, "Y", w) if len(w) == 4 and w.isdigit() else (i, "D", f"{int(day[1]):02}"))
    groups = []
    for i, t, v in parts:
        if groups and i - groups[-1][-1][0] <= D.APART and t not in [x[1] for x in groups[-1]]:
            groups[-1].append((i, t, v))
        else:
            groups.append([(i, t, v)])
    for g in groups:
        have = {t: v for _, t, v in g}
        if "M" in have or "Y" in have:
            v = f"{have.get('Y', 'XXXX')}-{have.get('M', 'XX')}-{have.get('D', 'XX')}"
            out.append(("date", g[0][0], g[-1][0] - g[0][0] + 1, v, None, None))
            wholes.append((g[0][0], v))
    base = next((real(v) for _, v in sorted(wholes) if "X" not in v and real(v)), None)
    for i, n, a, unit in relative:
        day = None
        if base and unit in ("day", "week"):
            day = base + datetime.timedelta(days=int(a) * (7 if unit == "week" else 1))
        elif base:
            months = base.year * 12 + base.month - 1 + int(a) * (12 if unit == "year" else 1)
            y, m = divmod(months, 12)
            last = (datetime.date(y + (m == 11), m % 12 + 1 if m < 11 else 1, 1) - datetime.timedelta(1)) if m < 11 else datetime.date(y, 12, 31)
            last = (datetime.date(y, m + 2, 1) if m < 11 else datetime.date(y + 1, 1, 1)) - datetime.timedelta(1)
            day = datetime.date(y, m + 1, min(base.day, last.day))
        out.append(("relative", i, n, day.isoformat() if day else None, a, unit))
    return sorted(out, key=lambda r: r[1])


def test_spans(spark):
    rng = random.Random(11)
    some = ["3", "14th", "31", "1998", "2004", "0", "32", "May", "oct", "December", "Friday", "9:05", "23:59:01", "24:00", "1990-1995", "2/29/2000", "2/29/2001", "12.31.1999", "2001-02-03", "2001-13-01", "days", "week", "ago", "months", "kg", "2.5", "km", "today", "Yesterday", "of", "the", "word", "years", ",", "5kg", "é", "year"]
    texts = [rng.choice([" ", ", "]).join(rng.choice(some) for _ in range(rng.randint(0, 40))) for _ in range(150)]
    texts += [None, "", "3 October 1998", "October 3, 1998; 5 days ago", "Jan 31 2001, 1 month ago", "3 months ago since 2000-05-31", "5 2001 " * 3000, "1 " * 9000]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "id int, body string, kind string")
    got = {}
    for r in D.spans(docs, "body").collect():
        got.setdefault(r["id"], []).append(tuple(r[c] for c in ("kind", "at", "n", "value", "amount", "unit")))
    want = {i: s for i, t in enumerate(texts) if (s := _spans(t))}
    assert {i: sorted(s, key=lambda r: r[1]) for i, s in got.items()} == want
    assert {s[0] for x in want.values() for s in x} == {"date", "time", "weekday", "years", "duration", "measure", "relative"}
