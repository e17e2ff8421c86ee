"""Operator 4 [native]: format-preserving Feistel pseudonyms.

One pattern finds candidate numbers, dates and mail addresses in a whole text;
each is validated (Luhn sum, octets, calendar, number ranges) and, where
valid, replaced by a keyed permutation of its own format's value set:

* card: all digits but the last, which is the Luhn digit of the new ones;
* phone: the national digits (a country code stays);  ssn: nine digits;
* ipv4: the 2**32 addresses;
* date: the 146097 days of the Gregorian years 1800 to 2199, so a date
  becomes a valid date in the same notation; day first with slashes, and
  where that is no date month first, by a permutation of its own of the 88497
  days that only this reading has (those after the 12th of a month);
* email: the letters and digits of the local part, of any length, in lower
  case, in pieces of ``MAX_CHARS`` permuted under their place; the domain stays.

A value is split in two halves, a number below ``a`` and one below ``b``, and
``ROUNDS`` rounds add ``SHA-256(key, kind, round, other half)`` to one of
them modulo its size.  Each round can be undone, so the map is a permutation:
equal values stay equal across documents, different ones different, with no
table of values, no shuffle and no state.  Separators stay in place.  What
does not validate is left as it was.  The key is the caller's; a date written in
two notations with the day first or last gets one pseudonym, a month-first date of
a late day one of its own.

DataFrame functions only, within the row.

Defined cases: null text gives null text and 0 found; an empty text stays;
every input row gives one row, repeats included; an empty table gives none;
an input column with the name of ``found_col`` is replaced by it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from carrisk.llm.common import not_replaced, query, table

ROUNDS = 10
MAX_CHARS = 22
KEY_SETTING = "spark.carrisk.pseudonymKey"  # session setting that the query and the pipeline take their key from
SAMPLE_KEY = "carrisk pseudonyms, change me"  # theirs where it is not set: for given tables of invented data only
DAYS = 146_097  # days of 400 Gregorian years, 189 * 773
LATE_DAYS = 88_497  # of these, the days after the 12th of their month, 9 * 9833

EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@(?:[A-Za-z0-9-]{1,63}+\.){1,8}[A-Za-z]{2,24}(?![A-Za-z])"
DATE = r"(?<![0-9./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}([./])[0-9]{2}\1[0-9]{4})(?![0-9/-])"
IPV4 = r"(?<![0-9.])(?:[0-9]{1,3}+\.){3}[0-9]{1,3}+(?!\.[0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
PHONE = (r"(?<![0-9+])(?:\+1[ .-]?(?:\([0-9]{3}\)|[0-9]{3})[ .-]?[0-9]{3}[ .-]?[0-9]{4}"
         r"|\+[2-9][0-9]{0,2}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,3}"
         r"|\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}([.-])[0-9]{3}\2[0-9]{4})(?![0-9])")
CARD = r"(?<![0-9.+-])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])"
CANDIDATE = "|".join((EMAIL, DATE, IPV4, SSN, PHONE, CARD))

_POWERS = {radix: [radix ** k for k in range(MAX_CHARS // 2 + 1)] for radix in (10, 36)}


def feistel(left: Column, right: Column, a: Column, b: Column, key: str, kind: str | Column) -> Column:
    """struct(l, r): a keyed permutation of the pairs with l < a, r < b."""
    def noise(i: Column, half: Column, below: Column) -> Column:
        digest = F.sha2(F.concat_ws("|", F.lit(key), kind if isinstance(kind, Column) else F.lit(kind), i.cast("string"), half.cast("string")), 256)
        return F.conv(F.substring(digest, 1, 15), 16, 10).try_cast("bigint") % below

    def turn(acc: Column, i: Column) -> Column:
        odd = i % 2 == 1
        return F.struct(F.when(odd, (acc["l"] + noise(i, acc["r"], a)) % a).otherwise(acc["l"]).alias("l"),
                        F.when(odd, acc["r"]).otherwise((acc["r"] + noise(i, acc["l"], b)) % b).alias("r"))

    start = F.struct(left.try_cast("bigint").alias("l"), right.try_cast("bigint").alias("r"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn)


def permute(chars: Column, radix: int, key: str, kind: str | Column) -> Column:
    """A string of 1 to ``MAX_CHARS`` digits of ``radix`` -> another of its length."""
    n = F.length(chars)
    h = F.floor(n / 2).cast("int")
    powers = F.array(*(F.lit(p).cast("bigint") for p in _POWERS[radix]))
    number = lambda s: F.coalesce(F.conv(F.when(s != "", s), radix, 10), F.lit("0"))
    moved = feistel(number(F.substring(chars, F.lit(1), h)), number(F.substring(chars, h + 1, n - h)),
                    F.try_element_at(powers, h + 1), F.try_element_at(powers, n - h + 1), key, F.concat(kind, F.lit(str(radix))) if isinstance(kind, Column) else f"{kind}{radix}")
    text = lambda half, size: F.lpad(F.lower(F.conv(half.cast("string"), 10, radix)), size, F.lit("0"))
    return F.transform(F.array(moved), lambda m: F.concat(text(m["l"], h), text(m["r"], n - h)))[0]


def _refill(value: Column, chars: Column, slots: str) -> Column:
    """``value`` with its characters of class ``slots`` replaced, in order, by ``chars`` (worked out once a value)."""
    def fill(both: Column) -> Column:
        def at(i: Column) -> Column:
            c = F.substring(both["value"], i, F.lit(1))
            k = F.length(F.regexp_replace(F.substring(both["value"], F.lit(1), i), f"[^{slots}]", ""))
            return F.when(c.rlike(f"[{slots}]"), F.substring(both["chars"], k, F.lit(1))).otherwise(c)
        return F.array_join(F.transform(F.sequence(F.lit(1), F.length(both["value"])), at), "")
    return F.transform(F.array(F.struct(value.alias("value"), chars.alias("chars"))), fill)[0]


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn_digit(payload: Column) -> Column:
    """The digit that makes ``payload`` + digit pass the Luhn test."""
    back = F.reverse(payload)

    def add(acc: Column, i: Column) -> Column:
        d = F.substring(back, i, F.lit(1)).try_cast("int")
        twice = 2 * d - F.when(d > 4, 9).otherwise(0)
        return acc + F.when(i % 2 == 1, twice).otherwise(d)
    return ((10 - F.aggregate(F.sequence(F.lit(1), F.length(payload)), F.lit(0), add) % 10) % 10).cast("string")


def _card(value: Column, key: str) -> Column:
    digits = _digits(value)
    payload = F.substring(digits, F.lit(1), F.length(digits) - 1)
    valid = (F.substring(digits, -1, 1) == luhn_digit(payload)) & ~digits.rlike("^(.)\\1*$")
    new = F.transform(F.array(permute(payload, 10, key, "card")), lambda p: F.concat(p, luhn_digit(p)))[0]
    return F.when(valid, _refill(value, new, "0-9"))


def _ipv4(value: Column, key: str) -> Column:
    octets = F.transform(F.split(value, r"\."), lambda o: o.try_cast("int"))
    half = lambda i: octets[i] * 256 + octets[i + 1]
    size = F.lit(65_536).cast("bigint")
    moved = feistel(half(0), half(2), size, size, key, "ipv4")
    show = lambda n: F.concat((F.shiftright(n, 8)).cast("string"), F.lit("."), (n % 256).cast("string"))
    return F.when(F.forall(octets, lambda o: o <= 255),
                  F.transform(F.array(moved), lambda m: F.concat(show(m["l"]), F.lit("."), show(m["r"])))[0])


def _date(value: Column, key: str) -> Column:
    iso = value.rlike("^[0-9]{4}-")
    sep = F.substring(value, 3, 1)
    pattern = [(iso, "yyyy-MM-dd"), (sep == ".", "dd.MM.yyyy"), (sep == "/", "dd/MM/yyyy")]
    day = F.coalesce(*(F.when(is_it, F.try_to_timestamp(value, F.lit(p)).cast("date")) for is_it, p in pattern))
    number = F.date_diff(day, F.lit("1800-01-01").cast("date"))
    moved = feistel(F.floor(number / 773), number % 773, F.lit(189).cast("bigint"), F.lit(773).cast("bigint"), key, "date")
    new = F.date_add(F.lit("1800-01-01").cast("date"), (moved["l"] * 773 + moved["r"]).cast("int"))
    shown = F.coalesce(*(F.when(is_it, F.date_format(new, p)) for is_it, p in pattern))
    late = F.when((sep == "/") & day.isNull(), _late_date(value, key))
    return F.when((number >= 0) & (number < DAYS), shown).otherwise(late)


def _late_date(value: Column, key: str) -> Column:
    """A date in MM/dd/yyyy whose day is over 12, moved among the days of that kind."""
    first = F.lit("1800-01-01").cast("date")
    before = lambda month: F.date_diff(F.add_months(first, month), first) - 12 * month  # noqa: E731  late days before a month
    day = F.try_to_timestamp(value, F.lit("MM/dd/yyyy")).cast("date")
    month = (F.year(day) - 1800) * 12 + F.month(day) - 1
    rank = before(month) + F.dayofmonth(day) - 13
    moved = feistel(F.floor(rank / 9833), rank % 9833, F.lit(9).cast("bigint"), F.lit(9833).cast("bigint"), key, "date-late")

    def shown(m: Column) -> Column:
        new = (m["l"] * 9833 + m["r"]).cast("int")
        near = F.floor(new * F.lit(4800.0) / LATE_DAYS).cast("int")
        at = F.array_max(F.filter(F.sequence(F.greatest(near - 3, F.lit(0)), F.least(near + 3, F.lit(4799))), lambda i: before(i) <= new))
        return F.transform(F.array(at), lambda i: F.date_format(F.date_add(F.add_months(first, i), new - before(i) + 12), "MM/dd/yyyy"))[0]
    return F.when((F.year(day) >= 1800) & (F.year(day) < 2200), F.transform(F.array(moved), shown)[0])


def _phone(value: Column, key: str) -> Column:
    code = F.regexp_extract(value, r"^\+1|^\+[0-9]{2}", 0)  # stays
    rest = F.substring(value, F.length(code) + 1, F.length(value))
    return F.concat(code, _refill(rest, permute(_digits(rest), 10, key, "phone"), "0-9"))


def _ssn(value: Column, key: str) -> Column:
    real = ~value.rlike("^(?:000|666|9..)|-00-|-0000$")
    return F.when(real, _refill(value, permute(_digits(value), 10, key, "ssn"), "0-9"))


def _email(value: Column, key: str) -> Column:
    at = F.instr(value, "@")
    local = F.lower(F.substring(value, F.lit(1), at - 1))
    chars = F.regexp_replace(local, "[^a-z0-9]", "")
    # pieces of MAX_CHARS, each permuted under its place: the first one is keyed "email", the others "email/1", ...
    places = F.sequence(F.lit(0), F.floor((F.length(chars) - 1) / MAX_CHARS).cast("int"))
    kind = lambda i: F.when(i == 0, F.lit("email")).otherwise(F.concat(F.lit("email/"), i.cast("string")))
    new = F.array_join(F.transform(places, lambda i: permute(F.substring(chars, i * MAX_CHARS + 1, F.lit(MAX_CHARS)), 36, key, kind(i))), "")
    return F.when(chars != "", F.concat(_refill(local, new, "a-z0-9"), F.lower(F.substring(value, at, F.length(value)))))


KINDS = (("email", "@", _email), ("date", r"^(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}([./])[0-9]{2}\1[0-9]{4})$", _date),
         ("ipv4", r"^(?:[0-9]{1,3}\.){3}[0-9]{1,3}$", _ipv4), ("ssn", "^[0-9]{3}-[0-9]{2}-[0-9]{4}$", _ssn),
         ("phone", r"^\+|^\(|^[0-9]{3}([.-])[0-9]{3}\1[0-9]{4}$", _phone), ("card", "^[0-9]", _card))


def session_key(spark: SparkSession) -> str:
    return spark.conf.get(KEY_SETTING, SAMPLE_KEY)


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text", found_col: str = "found") -> DataFrame:
    """``docs`` with new ``text_col`` and ``found_col``: array of (kind, start, old_length, pseudonym), start 0-based in the old text."""
    docs = docs.select(*[F.col(f"`{c}`") for c in not_replaced(docs.columns, [found_col])])
    text = F.col(text_col)
    parts, matches = F.split(text, CANDIDATE, -1), F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0))

    def one(value: Column) -> Column:
        kind, new = F, F
        for name, shape, move in KINDS:
            hit = value.rlike(shape)
            kind, new = kind.when(hit, F.lit(name)), new.when(hit, move(value, key))
        return F.struct(kind.alias("kind"), value.alias("value"), F.coalesce(new, value).alias("pseudonym"), new.isNotNull().alias("valid"))

    moved = docs.withColumn("__parts", parts).withColumn("__moved", F.transform(matches, one))
    glued = F.array_join(F.zip_with("__parts", "__moved", lambda p, m: F.concat(p, F.coalesce(m["pseudonym"], F.lit("")))), "")
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<kind:string,start:int,old_length:int,pseudonym:string>>").alias("out"))

    def walk(acc: Column, pair: Column) -> Column:
        m = pair["__moved"]
        here = acc["at"] + F.length(pair["__parts"])
        item = F.struct(m["kind"].alias("kind"), here.alias("start"), F.length(m["value"]).alias("old_length"), m["pseudonym"].alias("pseudonym"))
        return F.struct((here + F.coalesce(F.length(m["value"]), F.lit(0))).alias("at"),
                        F.when(m["valid"], F.concat(acc["out"], F.array(item))).otherwise(acc["out"]).alias("out"))
    found = F.aggregate(F.arrays_zip("__parts", "__moved"), start, walk, lambda acc: acc["out"])
    none = F.size("__moved") <= 0
    columns = [F.when(none, text).otherwise(glued).alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns]
    return moved.select(*columns, F.when(none | text.isNull(), start["out"]).otherwise(found).alias(found_col))


@query("op4_pii_feistel")
def op4_pii_feistel(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), session_key(spark))
    return docs.select("doc_id", F.size("found").cast("long").alias("n_found"), "found", "text")
