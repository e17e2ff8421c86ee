"""Feistel pseudonyms: permutation of each format, against a plain version, edge rows."""

import datetime as dt
import hashlib
import re

from carrisk.llm import pii
from carrisk.llm.queries import QUERIES
from pyspark.sql import functions as F
from tests.conftest import SF001


def noise(kind, i, half, below):
    d = hashlib.sha256(f"{pii.SAMPLE_KEY}|{kind}|{i}|{half}".encode()).hexdigest()
    return int(d[:15], 16) % below


def plain_feistel(l, r, a, b, kind):
    for i in range(1, pii.ROUNDS + 1):
        if i % 2:
            l = (l + noise(kind, i, r, a)) % a
        else:
            r = (r + noise(kind, i, l, b)) % b
    return l, r


def plain_permute(s, radix, kind):
    h = len(s) // 2
    alphabet = "0123456789abcdefghijklmnopqrstuvwxyz"
    moved = plain_feistel(int(s[:h] or "0", radix), int(s[h:], radix), radix ** h, radix ** (len(s) - h), f"{kind}{radix}")

    def show(n, size):
        out = ""
        for _ in range(size):
            n, d = divmod(n, radix)
            out = alphabet[d] + out
        return out
    return show(moved[0], h) + show(moved[1], len(s) - h)


def luhn(s):
    return sum(d if i % 2 == 0 else 2 * d - 9 * (d > 4) for i, d in enumerate(map(int, reversed(s)))) % 10 == 0


def refill(value, chars, slots):
    it = iter(chars)
    return "".join(next(it) if re.match(slots, c) else c for c in value)


def plain(value):
    """Pseudonym of a whole candidate value, or None where it does not validate."""
    digits = re.sub("[^0-9]", "", value)
    if "@" in value:
        local, at, domain = value.lower().partition("@")
        chars = re.sub("[^a-z0-9]", "", local)
        pieces = [plain_permute(chars[k:k + 22], 36, "email" if k == 0 else f"email/{k // 22}") for k in range(0, len(chars), 22)]
        return refill(local, "".join(pieces), "[a-z0-9]") + at + domain if chars else None
    for shape, form in (("[0-9]{4}-[0-9]{2}-[0-9]{2}", "%Y-%m-%d"), (r"[0-9]{2}\.[0-9]{2}\.[0-9]{4}", "%d.%m.%Y"), ("[0-9]{2}/[0-9]{2}/[0-9]{4}", "%d/%m/%Y")):
        if re.fullmatch(shape, value):
            try:
                n = (dt.datetime.strptime(value, form).date() - dt.date(1800, 1, 1)).days
            except ValueError:
                return None
            l, r = plain_feistel(n // 773, n % 773, 189, 773, "date")
            return (dt.date(1800, 1, 1) + dt.timedelta(l * 773 + r)).strftime(form) if 0 <= n < pii.DAYS else None
    if re.fullmatch(r"(?:\d+\.){3}\d+", value):
        o = list(map(int, value.split(".")))
        l, r = plain_feistel(o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536, "ipv4")
        return f"{l >> 8}.{l & 255}.{r >> 8}.{r & 255}" if max(o) < 256 else None
    if re.fullmatch(r"\d{3}-\d{2}-\d{4}", value):
        return refill(value, plain_permute(digits, 10, "ssn"), "[0-9]") if not re.search("^(?:000|666|9..)|-00-|-0000$", value) else None
    if re.match(r"\+|\(|\d{3}([.-])\d{3}\1\d{4}$", value):
        code = re.match(r"\+1|\+[0-9]{2}|", value).group()
        return code + refill(value[len(code):], plain_permute(re.sub("[^0-9]", "", value[len(code):]), 10, "phone"), "[0-9]")
    if not luhn(digits) or len(set(digits)) == 1:
        return None
    new = plain_permute(digits[:-1], 10, "card")
    return refill(value, new + next(c for c in "0123456789" if luhn(new + c)), "[0-9]")


JAVA = re.compile(pii.CANDIDATE)


def plain_text(text):
    return JAVA.sub(lambda m: plain(m.group()) or m.group(), text)


def test_query_against_plain_version(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()}
    rows = QUERIES["op4_pii_feistel"](spark, SF001).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts) and sum(r.n_found for r in rows) > 20
    for r in rows:
        assert r.text == plain_text(texts[r.doc_id])
        for f in r.found:
            assert f.pseudonym in r.text
    plan = QUERIES["op4_pii_feistel"](spark, SF001)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|Exchange", plan)


CASES = ["call +1 (988) 555-2485 orthen 4041894974608795 and 4111 1111 1111 1111, x bosbt.42@mail8.example.com.",
         "at 70.123.182.155 on 2024-02-29, 31.12.1999 or 30/02/2001, 1799-12-31, ssn 123-45-6789 or 000-12-1234.",
         "CC BY-NC 4.0. 999.1.1.1 +44 20 7946 0958 (212) 555-1212 212.555.1212 4111 1111 1111 1112 0000000000000000",
         "A" * 300 + "@x.com " + "abcdefghijklmnopqrstuvwxyz0123@y.org ._@z.de X.Y@Z.DE x.y@z.de", "9" * 30_000, "w" * 30_000 + " 1.2.3.4", "4041894974608795"]


def test_formats_links_and_edges(spark):
    rows = [(i, t, "k") for i, t in enumerate([*CASES, CASES[-1], None, ""])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, pseudonym string")
    out = {r.doc_id: r for r in pii.pseudonymise(docs, pii.SAMPLE_KEY).collect()}
    assert len(out) == len(rows) and pii.pseudonymise(docs, pii.SAMPLE_KEY).columns == [*docs.columns, "found"]
    for i, t, _ in rows:
        assert out[i].text == (None if t is None else plain_text(t)), t
        assert bool(out[i].found) == (t is not None and out[i].text != t)
    new = out[len(CASES) - 1].text
    assert new != CASES[-1] and luhn(new) and new in out[0].text and out[len(CASES)].text == new  # linked across texts
    assert out[3].text.split()[-1] == out[3].text.split()[-2]
    assert pii.pseudonymise(docs.limit(0), pii.SAMPLE_KEY).count() == 0
    assert pii.pseudonymise(docs.withColumn("FOUND", F.lit(1)), pii.SAMPLE_KEY).columns == [*docs.columns, "found"]


def test_permutation(spark):
    for n, radix in ((1, 10), (2, 10), (3, 10), (2, 36)):
        got = (spark.range(radix ** n).select(F.lpad(F.lower(F.conv(F.col("id").cast("string"), 10, radix)), n, "0").alias("s"))
               .select(pii.permute(F.col("s"), radix, "key", "test").alias("p")).distinct().count())
        assert got == radix ** n
    a, b = F.lit(189).cast("bigint"), F.lit(773).cast("bigint")
    days = spark.range(pii.DAYS).select(pii.feistel(F.floor(F.col("id") / 773), F.col("id") % 773, a, b, "key", "date").alias("m"))
    assert days.distinct().count() == pii.DAYS and days.where("m.l < 0 or m.l >= 189 or m.r < 0 or m.r >= 773").count() == 0


def test_month_first_dates(spark):
    """Slash dates that are none with the day first: a permutation of all days after the 12th of a month."""
    first = dt.date(1800, 1, 1)
    days = [d.strftime("%m/%d/%Y") for d in (first + dt.timedelta(k) for k in range(pii.DAYS)) if d.day > 12]
    assert len(days) == pii.LATE_DAYS
    docs = spark.createDataFrame([(d,) for d in days], "text string").repartition(8)
    moved = [r.text for r in pii.pseudonymise(docs, pii.SAMPLE_KEY).select("text").collect()]
    assert sorted(moved) == sorted(days)
    text = "from 03/25/2024 to 03/25/2024, not 13/32/2024, 02/30/2024 or 12/31/1799"
    out = pii.pseudonymise(spark.createDataFrame([(text,)], "text string"), pii.SAMPLE_KEY).first()
    assert [f.kind for f in out.found] == ["date", "date"] and out.found[0].pseudonym == out.found[1].pseudonym != "03/25/2024"
    assert out.text == text.replace("03/25/2024", out.found[0].pseudonym)


def test_long_names_leave_no_clear_text(spark):
    """Names of any length are found and permuted to their end; equal names stay linked."""
    names = ["a" * 23, "firstname.middlename.lastname.secretname", "x1" * 50, "q" * 5000]
    docs = spark.createDataFrame([(f"to {n}@example.com and {n.upper()}@Example.com.",) for n in names], "text string")
    for r, n in zip(pii.pseudonymise(docs, "other key").collect(), names):
        first, second = (f.pseudonym for f in r.found)
        assert first == second and len(first) == len(n) + len("@example.com") and r.text.count(first) == 2
        local, letters = first.split("@")[0], re.sub("[^a-z0-9]", "", n)
        moved = re.sub("[^a-z0-9]", "", local)
        assert all(moved[k:k + 22] != letters[k:k + 22] for k in range(0, len(letters), 22)) and "secretname" not in r.text.lower()


def test_a_key_is_required(spark):
    import pytest
    with pytest.raises(TypeError):
        pii.pseudonymise(spark.range(1))
    assert pii.session_key(spark) == pii.SAMPLE_KEY
    spark.conf.set(pii.KEY_SETTING, "mine")
    try:
        assert pii.session_key(spark) == "mine"
    finally:
        spark.conf.unset(pii.KEY_SETTING)
