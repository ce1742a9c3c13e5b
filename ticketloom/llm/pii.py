"""Format-preserving pseudonyms for personal data.

Values are found by pattern and validated (Luhn digit, calendar, number ranges). A valid
value is permuted inside its own format by a Feistel network whose rounds are keyed with
SHA-256, so equal values get equal pseudonyms in all documents, and different values
different ones. Separators stay where they are and do not change the pseudonym.

* card numbers: the digits permuted, the Luhn digit computed anew;
* North American phone numbers, with +1, an area code in parentheses, or separated as
  415-555-2671 with or without a leading 1: area and exchange keep a first digit of 2 to 9;
* social security numbers: permuted among the valid ones;
* IPv4 addresses: permuted among all addresses;
* dates from 1900 to 2099, year first or day first, with hyphens, strokes or full stops:
  permuted among the days of that span, written in the form found. A date is read month
  first only where it cannot be day first (12/31/2024); it is permuted among such dates,
  so its pseudonym is read the same way;
* mail addresses: letters and digits before the last full stop keep their kind;
* access keys, and values behind password, secret, token or api key: letters and digits
  keep their kind.

A value that fails its check stays. Null text stays null, and a text without values
stays as it is. The work is row by row: equal rows give equal rows, and other columns
are not touched.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ticketloom.llm.common import let, pinned

#: The key of the permutations; give your own and keep it secret.
KEY = "replace-this-key"
ROUNDS = 8

DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"

#: Patterns by kind, in the order in which they are tried.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "ip": rf"(?<![0-9.]){_OCTET}(?:\.{_OCTET}){{3}}(?![0-9]|\.[0-9])",
    "phone": r"(?<![0-9+])(?:\+1[ .-]?\(?[2-9][0-9]{2}\)?|\([2-9][0-9]{2}\))[ .-]?[2-9][0-9]{2}[ .-]?[0-9]{4}(?![0-9])"
             r"|(?<![0-9+]|[0-9][.-])(?:1[ .-])?[2-9][0-9]{2}[ .-][2-9][0-9]{2}[ .-][0-9]{4}(?![0-9]|[.-][0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "date": r"(?<![0-9/-]|[0-9]\.)(?:[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}|[0-9]{4}/[0-9]{1,2}/[0-9]{1,2}|[0-9]{4}\.[0-9]{1,2}\.[0-9]{1,2}"
            r"|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}|[0-9]{1,2}-[0-9]{1,2}-[0-9]{4})(?![0-9/-]|\.[0-9])",
    "card": r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])",
    "key": r"(?<![0-9A-Za-z])AKIA[0-9A-Z]{16}(?![0-9A-Za-z])",
    "secret": r"(?i:password|passwd|secret|token|api[_-]?key)[ ]{0,3}[=:][ ]{0,3}[\"']?[0-9A-Za-z+/_-]{8,}",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: A text without any of these holds no value.
_HINT = "[0-9@]|(?i:password|passwd|secret|token|api[_-]?key)"

_DAYS_BEFORE, _DAYS = -25567, 73049  # 1900-01-01 from 1970-01-01; days to 2099-12-31


def _draw(*parts: Column) -> Column:
    """A keyed pseudo-random number below 2**60."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", *(p.cast("string") for p in parts)), 256), 1, 15), 16, 10).cast("bigint")


def feistel_characters(value: Column, alphabets: Column, key: str = KEY, inverse: bool = False) -> Column:
    """Permute the strings of one format: character i stays inside ``alphabets[i]``."""
    n = F.length(value)
    half = F.floor(n / 2).cast("int")
    start = F.transform(alphabets, lambda a, i: F.position(F.substr(value, i + 1, F.lit(1)), a) - 1)
    rounds = F.sequence(F.lit(ROUNDS - 1), F.lit(0), F.lit(-1)) if inverse else F.sequence(F.lit(0), F.lit(ROUNDS - 1))
    sign = -1 if inverse else 1

    def one(d: Column, r: Column) -> Column:
        left = r % 2 == 0
        other = F.when(left, F.slice(d, half + 1, n - half)).otherwise(F.slice(d, F.lit(1), half))
        return let(F.concat_ws("|", F.lit(key), r.cast("string"), n.cast("string"),
                               F.array_join(F.transform(other, lambda x: x.cast("string")), ",")),
                   lambda seed: F.transform(d, lambda x, i: F.when(
                       (i < half) == left,
                       F.pmod(x + sign * _draw(seed, i), F.length(F.get(alphabets, i))).cast("int")).otherwise(x)))

    return let(F.aggregate(rounds, start, one), lambda d: F.array_join(F.transform(
        d, lambda x, i: F.substr(F.get(alphabets, i), x + 1, F.lit(1))), ""))


def feistel_pair(a: Column, b: Column, m: int, n: int, tag: str, key: str = KEY, inverse: bool = False) -> Column:
    """Permute the pairs (a, b) with 0 <= a < m and 0 <= b < n."""
    rounds = F.sequence(F.lit(ROUNDS - 1), F.lit(0), F.lit(-1)) if inverse else F.sequence(F.lit(0), F.lit(ROUNDS - 1))
    sign = -1 if inverse else 1
    pair = lambda x, y: F.struct(x.cast("bigint").alias("a"), y.cast("bigint").alias("b"))
    seed = F.lit(f"{key}|{tag}")
    return F.aggregate(rounds, pair(a, b), lambda s, r: F.when(
        r % 2 == 0, pair(F.pmod(s["a"] + sign * _draw(seed, r, s["b"]), F.lit(m)), s["b"])).otherwise(
        pair(s["a"], F.pmod(s["b"] + sign * _draw(seed, r, s["a"]), F.lit(n)))))


def luhn_sum(digits: Column) -> Column:
    """Sum of the Luhn check over a string of digits; 0 modulo 10 if it is valid."""
    one = lambda x, i: F.when(i % 2 == 0, x).when(x > 4, 2 * x - 9).otherwise(2 * x)
    return let(F.transform(F.split(F.reverse(digits), ""), lambda c: F.coalesce(c.try_cast("int"), F.lit(0))),
               lambda d: F.aggregate(F.transform(d, one), F.lit(0), lambda s, x: s + x))


def _same_kind(value: Column) -> Column:
    """The alphabet of each letter or digit of a string: its own kind."""
    return F.transform(F.split(value, ""), lambda c: F.when(c.rlike("[0-9]"), F.lit(DIGITS)).when(
        c.rlike("[a-z]"), F.lit(LOWER)).otherwise(F.lit(UPPER)))


def _plain(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9A-Za-z]", "")


def _refilled(value: Column, plain: Column) -> Column:
    """Letters and digits of a value replaced in order; everything else stays."""
    return F.array_join(F.transform(F.split(value, ""), lambda c, i: F.when(c.rlike("[0-9A-Za-z]"), F.substr(
        plain, F.length(_plain(F.substr(value, F.lit(1), i))) + 1, F.lit(1))).otherwise(c)), "")


def _characters(value: Column, key: str) -> Column:
    return let(_plain(value), lambda p: _refilled(value, feistel_characters(p, _same_kind(p), key)))


def _card(value: Column, key: str) -> Column:
    def valid(p: Column) -> Column:
        body = F.substr(p, F.lit(1), F.length(p) - 1)
        new = let(feistel_characters(body, _same_kind(body), key), lambda b: F.concat(
            b, F.pmod(10 - F.pmod(luhn_sum(F.concat(b, F.lit("0"))), F.lit(10)), F.lit(10)).cast("string")))
        return F.when(luhn_sum(p) % 10 == 0, _refilled(value, new)).otherwise(value)

    return let(_plain(value), valid)


def _phone(value: Column, key: str) -> Column:
    country = F.regexp_extract(value, "^[+]?1", 0)
    alphabets = F.array(*(F.lit(DIGITS[2:] if i in (0, 3) else DIGITS) for i in range(10)))
    return let(F.substr(value, F.length(country) + 1), lambda rest: F.concat(
        country, _refilled(rest, feistel_characters(_plain(rest), alphabets, key))))


def _ip(value: Column, key: str) -> Column:
    o = lambda i: F.get(F.split(value, "[.]"), F.lit(i)).try_cast("bigint")
    new = feistel_pair(o(0) * 256 + o(1), o(2) * 256 + o(3), 65536, 65536, "ip", key)
    return let(new, lambda p: F.concat_ws(".", *(x.cast("string") for h in (p["a"], p["b"])
                                                 for x in (F.shiftright(h, 8), h.bitwiseAND(255)))))


def _ssn(value: Column, key: str) -> Column:
    part = lambda i: F.get(F.split(value, "-"), F.lit(i)).try_cast("bigint")
    area, group, serial = part(0), part(1), part(2)
    new = feistel_pair(area - 1 - (area > 666).cast("int"), (group - 1) * 9999 + serial - 1, 898, 99 * 9999, "ssn", key)
    text = let(new, lambda p: F.concat_ws(
        "-", F.lpad((p["a"] + 1 + (p["a"] >= 665).cast("int")).cast("string"), 3, "0"),
        F.lpad((F.floor(p["b"] / 9999) + 1).cast("string"), 2, "0"),
        F.lpad((p["b"] % 9999 + 1).cast("string"), 4, "0")))
    ok = (area > 0) & (area != 666) & (area < 900) & (group > 0) & (serial > 0)
    return F.when(ok, text).otherwise(value)


def permuted_day(day: Column, key: str = KEY) -> Column:
    """A day of 1900 to 2099, as days since 1970, permuted among them by walking the cycle."""
    once = lambda d: let(feistel_pair(F.floor(d / 270), d % 270, 271, 270, "date", key),
                         lambda p: p["a"] * 270 + p["b"])
    inside = F.aggregate(F.sequence(F.lit(1), F.lit(30)), once(day - _DAYS_BEFORE),
                         lambda d, _: F.when(d < _DAYS, d).otherwise(once(d)))
    return inside + _DAYS_BEFORE


def _date(value: Column, key: str) -> Column:
    sign = F.regexp_extract(value, "[/.-]", 0)
    p = lambda i: F.get(F.split(value, "[/.-]"), F.lit(i)).try_cast("int")
    first = F.length(F.get(F.split(value, "[/.-]"), F.lit(0))) == 4
    month_first = ~first & (p(0) <= 12) & (p(1) > 12)
    year, month = F.when(first, p(0)).otherwise(p(2)), F.when(month_first, p(0)).otherwise(p(1))
    day = F.when(first, p(2)).when(month_first, p(1)).otherwise(p(0))
    found = F.when(year.between(1900, 2099), F.to_date(F.try_to_timestamp(
        F.format_string("%04d-%02d-%02d", year, month, day), F.lit("yyyy-MM-dd"))))
    past = lambda d: F.dayofmonth(F.date_from_unix_date(d.cast("int"))) > 12
    once = permuted_day(F.unix_date(found).cast("bigint"), key)
    # Walks the cycle until the date cannot be day first either.
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(80)), once, lambda d, _: F.when(past(d), d).otherwise(permuted_day(d, key)))
    new = F.date_from_unix_date(F.when(month_first, walked).otherwise(once).cast("int"))
    wide = F.length(value) == 10

    def written_as(d: Column) -> Column:
        one = lambda x: F.when(wide, F.lpad(x.cast("string"), 2, "0")).otherwise(x.cast("string"))
        y, m, n = F.lpad(F.year(d).cast("string"), 4, "0"), one(F.month(d)), one(F.dayofmonth(d))
        return F.when(first, F.concat(y, sign, m, sign, n)).when(month_first, F.concat(m, sign, n, sign, y)).otherwise(
            F.concat(n, sign, m, sign, y))

    return F.coalesce(F.when(found.isNotNull(), let(new, written_as)), value)


def _email(value: Column, key: str) -> Column:
    return let(F.regexp_extract(value, r"^(.*)\.[^.]*$", 1), lambda head: F.concat(
        _characters(head, key), F.substr(value, F.length(head) + 1)))


def _secret(value: Column, key: str) -> Column:
    return let(F.regexp_extract(value, r"^[^=:]*[=:][ ]*[\"']?", 0), lambda head: F.concat(
        head, _characters(F.substr(value, F.length(head) + 1), key)))


_MAKERS = {"email": _email, "ip": _ip, "phone": _phone, "ssn": _ssn, "date": _date, "card": _card,
           "key": lambda v, key: F.concat(F.lit("AKIA"), _characters(F.substr(v, F.lit(5)), key)), "secret": _secret}


def kind_of(value: Column) -> Column:
    return reduce(lambda c, k: c.when(value.rlike(f"^(?:{PATTERNS[k]})$"), F.lit(k)), list(PATTERNS)[1:],
                  F.when(value.rlike(f"^(?:{PATTERNS['email']})$"), F.lit("email")))


def pseudonym(value: Column, kind: Column, key: str = KEY) -> Column:
    """The pseudonym of a value of a kind; the value itself where its check fails."""
    out = F.lit(None).cast("string")
    for k, make in _MAKERS.items():
        out = F.when(kind == k, make(value, key)).otherwise(out)
    return F.coalesce(out, value)


def replaced(docs: DataFrame, key: str = KEY) -> DataFrame:
    """A struct ``doc`` with all columns, ``values`` (kind, found, put) and the new ``text``."""
    packed = docs.select(F.struct("*").alias("doc"), F.col("text").alias("old"))
    text = F.col("old")
    none = F.array().cast("array<string>")
    hits = F.when(text.rlike(_HINT), F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).otherwise(none)
    held = pinned(packed, "doc", "old", hits=F.coalesce(hits, none))
    held = pinned(held, "doc", "old", values=F.transform("hits", lambda h: let(kind_of(h), lambda k: F.struct(
        k.alias("kind"), h.alias("found"), pseudonym(h, k, key).alias("put")))))
    gaps = F.split(text, ANY, -1)
    new = let(gaps, lambda g: F.array_join(F.transform(g, lambda x, i: F.concat(
        x, F.coalesce(F.get("values", i)["put"], F.lit("")))), ""))
    return held.select("doc", "values", F.when(F.size("values") > 0, new).otherwise(text).alias("text"))


def pseudonymised(docs: DataFrame, key: str = KEY) -> DataFrame:
    """The documents with pseudonyms in their texts, columns as given."""
    out = replaced(docs, key)
    changed = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.size("values") == 0, F.col("doc.n_chars")).otherwise(
            F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*(changed.get(c, F.col(f"doc.`{c}`")).alias(c) for c in docs.columns))


def pii_digest(docs: DataFrame, key: str = KEY) -> DataFrame:
    """Every document with its new text, the number of values replaced, and their kinds."""
    put = F.filter("values", lambda v: v["found"] != v["put"])
    return replaced(docs, key).select(
        "doc.doc_id", "text", F.size(put).cast("bigint").alias("n_replaced"),
        F.array_sort(F.array_distinct(F.transform(put, lambda v: v["kind"]))).alias("kinds"))
