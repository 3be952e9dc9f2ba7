"""Format-preserving Feistel pseudonyms for personal data, in DataFrame functions alone.

Found: card numbers (13 to 19 digits, bare or in groups of four, with a valid check digit), account numbers (IBAN, with valid check
digits), phone numbers, IPv4 addresses (parts up to 255), IPv6 addresses, social security numbers in a valid range, dates that exist
(2020-12-31, 31/12/2020, 31.12.2020), e-mail addresses, access keys (AKIA or ASIA and 16 signs) and secrets of 20 to 128 signs in quotes
after a word such as token. Left as they are: what does not validate, dates whose month comes first, and secrets without quotes or such a word.

Numbers, dates and addresses are permuted by a keyed Feistel network over exactly the set of valid values of their format, so the result
is valid again, has the same layout, and equal values stay equal in all documents. E-mail addresses and secrets, which have no
such set, get a keyed digest of the same shape. There is no key in the code: who has the key can take the pseudonyms back.
"""

from __future__ import annotations

import secrets

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Patterns by kind, in the order in which they are tried at a place.
KINDS = {
    "email": r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]++@[A-Za-z0-9\-]++(?:\.[A-Za-z0-9\-]++)*(?<=\.[A-Za-z]{2,24})",
    "secret": r"(?i:token|secret|passw(?:or)?d|api[_-]?key) ?[=:] ?[\"'][0-9A-Za-z_/+=\-]{20,128}[\"']",
    "key": r"(?<![0-9A-Za-z])A[KS]IA[0-9A-Z]{16}(?![0-9A-Za-z])",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}\d{2}(?:(?: [0-9A-Z]{4}){2,7}(?: [0-9A-Z]{1,3})?|[0-9A-Z]{11,30})(?![0-9A-Za-z])",
    "ssn": r"(?<![\w.\-])\d{3}-\d{2}-\d{4}(?![\w\-])",
    "date": r"(?<![\w.\-])\d{4}-\d{2}-\d{2}(?![\w\-])|(?<![\w./\-])(?:\d{2}/\d{2}/\d{4}|\d{2}\.\d{2}\.\d{4})(?![\w/\-]|\.\d)",
    "ip6": r"(?<![\w:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?=[A-Fa-f]{0,3}\d)(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![\w:]|\.\d)",
    "phone": r"(?:(?<![\w+(])\+\d{1,3} ?)?(?<![\w(])\(\d{3}\) ?\d{3}[-. ]\d{4}(?!\w)|(?<![\w.\-+(])(?:\+\d{1,3}[ .\-])?\d{3}[.\-]\d{3}[.\-]\d{4}(?![\w\-])",
    "ip": r"(?<![\w.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\.?\w)",
    "card": r"(?<![\w.\-])(?:\d{13,19}|\d{4}(?:-\d{4}){3}(?:-\d{1,3})?|\d{4}(?: \d{4}){3})(?![\w\-])",
}
ANY = "|".join(f"(?:{p})" for p in KINDS.values())
#: A text without any of these has nothing to find.
HINT = r"[0-9@]|A[KS]IA|(?i:token|secret|passw|api[_-]?key)"
ROUNDS = 8
#: The session's setting that holds the key: Spark hides settings whose names hold this word from its log and user interface.
KEY_SETTING = "podium.pii.secret"
#: Dates from FIRST_DAY, so many days: 365 x 200.
FIRST_DAY, YEAR_PART, YEARS = "1900-01-01", 365, 200
#: All other dates from EARLIEST to 9999-12-31 are a domain of their own: 3,579,059 days = 1331 x 2689; so many are before FIRST_DAY.
EARLIEST, OTHER_A, OTHER_B, BEFORE = "0001-01-01", 1331, 2689, 693_595


def key_of(spark: SparkSession) -> str:
    """The session's key; a session that has none gets one at random, and its pseudonyms cannot be linked with another's."""
    found = spark.conf.get(KEY_SETTING, None)
    if not found:
        found = secrets.token_hex(32)
        spark.conf.set(KEY_SETTING, found)
    return found


def _digest(key: Column | str, kind: str, value: Column, tweak: Column, most: Column) -> Column:
    """A keyed whole number below `most`."""
    whole = F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), tweak.cast("string"), value.cast("string")), 256)
    return F.pmod(F.conv(F.substring(whole, 1, 15), 16, 10).cast("long"), most)


def feistel(key: Column | str, kind: str, a: Column, b: Column, most_a: Column, most_b: Column) -> Column:
    """A permutation of the pairs (a, b), a below most_a and b below most_b, both longs: a struct of a and b."""
    start = F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))

    def turn(s: Column, i: Column) -> Column:
        even = i % 2 == 0
        new_a = F.when(even, F.pmod(s["a"] + _digest(key, kind, s["b"], i, most_a), most_a)).otherwise(s["a"])
        new_b = F.when(even, s["b"]).otherwise(F.pmod(s["b"] + _digest(key, kind, s["a"], i, most_b), most_b))
        return F.struct(new_a.alias("a"), new_b.alias("b"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn)


def _power(n: Column) -> Column:
    return F.element_at(F.array(*(F.lit(10**i).cast("long") for i in range(19))), (n + 1).cast("int"))


def _digits(key: Column | str, kind: str, digits: Column) -> Column:
    """Digits of the same number, permuted."""
    n = F.length(digits)
    h = F.floor(n / 2).cast("int")
    s = feistel(key, kind, F.substring(digits, F.lit(1), h).cast("long"), F.substring(digits, h + 1, n - h).cast("long"), _power(h), _power(n - h))
    return _let(s, lambda x: F.concat(F.lpad(x["a"].cast("string"), h, "0"), F.lpad(x["b"].cast("string"), n - h, "0")))


def _let(value: Column, use) -> Column:
    """use(value), with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _only_digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _laid_out(m: Column, digits: Column) -> Column:
    """m with its digits replaced in a row."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("k"))

    def put(s: Column, c: Column) -> Column:
        is_digit = c.rlike("^[0-9]$")
        return F.struct(F.concat(s["out"], F.when(is_digit, F.substring(digits, s["k"] + 1, F.lit(1))).otherwise(c)).alias("out"), (s["k"] + is_digit.cast("int")).alias("k"))

    return F.aggregate(F.split(m, ""), start, put, lambda s: s["out"])


def _luhn(digits: Column, odd_from_right: int) -> Column:
    """The sum of the check: digits at places of that parity from the right (from 0) are doubled."""
    rows = F.transform(F.reverse(F.split(digits, "")), lambda c, i: _let(c.cast("int") * F.when(i % 2 == odd_from_right, 2).otherwise(1), lambda v: F.when(v > 9, v - 9).otherwise(v)))
    return F.aggregate(rows, F.lit(0), lambda a, b: a + b)


def _card(key: Column | str, m: Column) -> Column:
    def new(d: Column) -> Column:
        body = _digits(key, "card", F.substring(d, F.lit(1), F.length(d) - 1))
        return _let(body, lambda b: F.concat(b, F.pmod(10 - F.pmod(_luhn(b, 0), F.lit(10)), F.lit(10)).cast("string")))

    return _let(_only_digits(m), lambda d: F.when(F.pmod(_luhn(d, 1), F.lit(10)) == 0, _let(new(d), lambda x: _laid_out(m, x))))


def _phone(key: Column | str, m: Column) -> Column:
    prefix = F.regexp_extract(m, r"^(\+\d{1,3}[ .\-]?)?", 0)
    rest = F.substring(m, F.length(prefix) + 1, F.length(m))
    return F.concat(prefix, _let(_digits(key, "phone", _only_digits(rest)), lambda x: _laid_out(rest, x)))


def _ip(key: Column | str, m: Column) -> Column:
    def new(p: Column) -> Column:
        at = lambda i: F.get(p, F.lit(i))
        s = feistel(key, "ip", at(0) * 256 + at(1), at(2) * 256 + at(3), F.lit(65536).cast("long"), F.lit(65536).cast("long"))
        parts = lambda v: [F.floor(v / 256).cast("string"), F.pmod(v, F.lit(256)).cast("string")]
        return F.when(F.array_max(p) <= 255, _let(s, lambda x: F.concat_ws(".", *parts(x["a"]), *parts(x["b"]))))

    return _let(F.transform(F.split(m, r"\."), lambda x: x.cast("int")), new)


def _ip6(key: Column | str, m: Column) -> Column:
    """The groups that are written are permuted, halves by turns; where groups are left out stays as it is."""

    def words(i: Column, other: Column) -> Column:
        whole = F.sha2(F.concat_ws("|", F.lit(key), F.lit("ip6"), i.cast("string"), F.array_join(other.cast("array<string>"), ":")), 256)
        return F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.conv(F.substring(whole, k * 4 + 1, F.lit(4)), 16, 10).cast("int"))

    def half(own: Column, other: Column, i: Column) -> Column:
        return F.zip_with(own, F.slice(words(i, other), F.lit(1), F.size(own)), lambda x, y: x.bitwiseXOR(y))

    def turn(s: Column, i: Column) -> Column:
        even = i % 2 == 0
        return F.struct(F.when(even, half(s["a"], s["b"], i)).otherwise(s["a"]).alias("a"), F.when(even, s["b"]).otherwise(half(s["b"], s["a"], i)).alias("b"))

    def new(parts: Column) -> Column:
        there = F.transform(F.filter(parts, lambda x: x != ""), lambda x: F.conv(x, 16, 10).cast("int"))
        n = F.floor(F.size(there) / 2).cast("int")
        start = F.struct(F.slice(there, F.lit(1), n).alias("a"), F.slice(there, n + 1, F.size(there) - n).alias("b"))
        return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn, lambda s: F.transform(F.concat(s["a"], s["b"]), lambda x: F.lower(F.hex(x))))

    def show(parts: Column, groups: Column) -> Column:
        behind = F.transform(parts, lambda x, i: F.size(F.filter(F.slice(parts, F.lit(1), i + 1), lambda y: y != "")))
        return F.array_join(F.zip_with(parts, behind, lambda x, k: F.when(x == "", F.lit("")).otherwise(F.get(groups, k - 1))), ":")

    return _let(F.split(m, ":", -1), lambda p: _let(new(p), lambda g: F.when(m.rlike("[A-F]"), F.upper(show(p, g))).otherwise(show(p, g))))


def _mod97(signs: Column) -> Column:
    """The remainder by 97 of a number written with digits and capitals (10 to 35)."""
    value = lambda c: F.when(c.rlike("^[0-9]$"), c.cast("int")).otherwise(F.ascii(c) - 55)
    return F.aggregate(F.split(signs, ""), F.lit(0), lambda r, c: F.pmod(r * F.when(c.rlike("^[0-9]$"), 10).otherwise(100) + F.when(c == "", 0).otherwise(value(c)), F.lit(97)).cast("int"))


def _iban(key: Column | str, m: Column) -> Column:
    """The digits behind the check digits are permuted, letters stay, and the check digits are made anew."""
    plain = F.replace(m, F.lit(" "), F.lit(""))

    def new(p: Column) -> Column:
        country, rest = F.substring(p, 1, 2), F.substring(p, F.lit(5), F.length(p))
        number = _only_digits(rest)
        body = F.when(F.length(number) >= 2, _laid_out(rest, _digits(key, "iban", number))).otherwise(rest)
        check = lambda x: F.lpad((98 - _mod97(F.concat(x, country, F.lit("00")))).cast("string"), 2, "0")
        signs = lambda x: F.concat(country, check(x), x)
        fine = _mod97(F.concat(rest, F.substring(p, 1, 4))) == 1
        return F.when(fine, _let(body, lambda x: _let(signs(x), lambda y: _spaced(m, y))))

    return _let(plain, new)


def _spaced(m: Column, signs: Column) -> Column:
    """signs with the spaces of m."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("k"))

    def put(s: Column, c: Column) -> Column:
        return F.struct(F.concat(s["out"], F.when(c == " ", c).otherwise(F.substring(signs, s["k"] + 1, F.lit(1)))).alias("out"), (s["k"] + (c != " ").cast("int")).alias("k"))

    return F.aggregate(F.split(m, ""), start, put, lambda s: s["out"])


def _ssn(key: Column | str, m: Column) -> Column:
    """Areas 001 to 899 but 666, groups from 01, serials from 0001."""
    area, group, serial = (F.substring(m, a, n).cast("long") for a, n in ((1, 3), (5, 2), (8, 4)))
    fine = (area > 0) & (area != 666) & (area < 900) & (group > 0) & (serial > 0)
    s = feistel(key, "ssn", (area - 1 - (area > 666).cast("int")) * 99 + group - 1, serial - 1, F.lit(898 * 99).cast("long"), F.lit(9999).cast("long"))

    def show(x: Column) -> Column:
        place = F.floor(x["a"] / 99)
        return F.concat_ws("-", F.lpad((place + 1 + (place >= 665).cast("int")).cast("string"), 3, "0"), F.lpad((F.pmod(x["a"], F.lit(99)) + 1).cast("string"), 2, "0"), F.lpad((x["b"] + 1).cast("string"), 4, "0"))

    return F.when(fine, _let(s, show))


def _date(key: Column | str, m: Column) -> Column:
    """Dates of the 200 years stay in them, the others outside. A date has the same pseudonym in every layout."""
    year_last = ~m.contains("-")
    iso = F.when(year_last, F.concat_ws("-", F.substring(m, 7, 4), F.substring(m, 4, 2), F.substring(m, 1, 2))).otherwise(m)
    day = F.date_diff(F.try_to_timestamp(iso, F.lit("yyyy-MM-dd")).cast("date"), F.to_date(F.lit(FIRST_DAY)))
    laid_out = lambda x: F.when(year_last, F.concat(F.substring(x, 9, 2), F.substring(m, 3, 1), F.substring(x, 6, 2), F.substring(m, 3, 1), F.substring(x, 1, 4))).otherwise(x)
    inside = YEARS * YEAR_PART

    def permuted(kind: str, d: Column, most_a: int, most_b: int, first: str, skip) -> Column:
        s = feistel(key, kind, F.floor(d / most_b), F.pmod(d, F.lit(most_b)), F.lit(most_a).cast("long"), F.lit(most_b).cast("long"))
        return _let(s, lambda x: F.date_add(F.to_date(F.lit(first)), skip(x["a"] * most_b + x["b"]).cast("int")).cast("string"))

    def new(d: Column) -> Column:
        near = permuted("date", d, YEARS, YEAR_PART, FIRST_DAY, lambda i: i)
        far = permuted("far date", F.when(d < 0, d + BEFORE).otherwise(d + BEFORE - inside), OTHER_A, OTHER_B, EARLIEST, lambda i: F.when(i < BEFORE, i).otherwise(i + inside))
        return F.when((d >= 0) & (d < inside), near).when(d >= -BEFORE, far)  # Spark knows a year 0000

    return _let(_let(day, new), laid_out)


def _email(key: Column | str, m: Column) -> Column:
    return F.concat(F.lit("u"), F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit("email"), F.lower(m)), 256), 1, 12), F.lit("@example.invalid"))


def _shaped(key: Column | str, value: Column) -> Column:
    """A keyed digest of the same length: hexadecimal digits where all are, else a digit for a digit, a letter for a letter of its case."""
    digest = lambda k: F.sha2(F.concat_ws("|", F.lit(key), F.lit("secret"), F.lit(k), value), 256)

    def new(signs: Column) -> Column:
        number = lambda i: F.conv(F.substring(signs, i * 2 + 1, F.lit(2)), 16, 10).cast("int")
        letter = lambda i, first: F.chr(F.pmod(number(i), F.lit(26)) + first)
        sign = lambda c, i: F.when(c.rlike("^[0-9]$"), F.pmod(number(i), F.lit(10)).cast("string")).when(c.rlike("^[a-z]$"), letter(i, 97)).when(c.rlike("^[A-Z]$"), letter(i, 65)).otherwise(c)
        hexed = F.substring(signs, F.lit(1), F.length(value))
        return F.when(value.rlike("^[0-9a-f]+$"), hexed).when(value.rlike("^[0-9A-F]+$"), F.upper(hexed)).otherwise(F.array_join(F.transform(F.split(value, ""), sign), ""))

    return _let(F.concat(*map(digest, "abcd")), new)  # 256 signs, two for each of 128


def _secret(key: Column | str, m: Column) -> Column:
    value = F.regexp_extract(m, "[\"']([^\"']+)[\"']$", 1)
    return _let(value, lambda v: F.concat(F.substring(m, F.lit(1), F.length(m) - F.length(v) - 1), _shaped(key, v), F.substring(m, -1, 1)))


def _access_key(key: Column | str, m: Column) -> Column:
    return F.concat(F.substring(m, 1, 4), _let(F.substring(m, 5, 16), lambda v: _shaped(key, v)))


_NEW = {"email": _email, "secret": _secret, "key": _access_key, "iban": _iban, "ssn": _ssn, "date": _date, "ip6": _ip6, "phone": _phone, "ip": _ip, "card": _card}


def _kind(m: Column) -> Column:
    """Which pattern a match is of: the patterns' looks are told apart by their signs."""
    digits = F.length(_only_digits(m))
    return (
        F.when(m.contains("@"), "email").when(m.rlike("[\"']"), "secret").when(m.contains(":"), "ip6").when(m.rlike("^A[KS]IA[0-9A-Z]{16}$"), "key").when(m.rlike("^[A-Z]"), "iban")
        .when(m.rlike(r"^\d{3}-\d{2}-\d{4}$"), "ssn").when(m.rlike(r"^(?:\d{4}-\d{2}-\d{2}|\d{2}[/.]\d{2}[/.]\d{4})$"), "date")
        .when(m.rlike(r"^\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}$"), "ip").when((digits >= 13) & ~m.rlike(r"[+(.]"), "card").otherwise("phone")
    )


def _keyed(df: DataFrame, key: str) -> DataFrame:
    """df with _key, from a table of one row: a plan's text, which goes to logs, names the column and not the key, as it would a literal."""
    row = df.sparkSession.createDataFrame(pa.table({"_key": [key]}))
    return df.crossJoin(F.broadcast(row))


def with_pseudonyms(df: DataFrame, text: str, key: str) -> DataFrame:
    """df with `text` rewritten (null stays null) and _found, an array of the kinds replaced, in order (null where nothing is searched)."""
    t = F.col(text)
    df, key = _keyed(df, key), F.col("_key")
    df = df.withColumn("_hits", F.when(t.rlike(HINT), F.regexp_extract_all(t, F.lit(ANY), F.lit(0))))

    def new(m: Column) -> Column:
        out = F.lit(None).cast("string")
        kind = _kind(m)
        for k, f in _NEW.items():
            out = F.when(kind == k, f(key, m)).otherwise(out)
        return F.struct(kind.alias("kind"), m.alias("old"), out.alias("new"))

    df = df.withColumn("_hits", F.when(F.size("_hits") > 0, F.transform("_hits", new)))
    parts = F.split(t, ANY, -1)
    glued = F.array_join(F.zip_with(parts, F.transform("_hits", lambda h: F.coalesce(h["new"], h["old"])), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    return df.withColumn("_found", F.transform(F.filter("_hits", lambda h: h["new"].isNotNull()), lambda h: h["kind"])).withColumn(text, F.when(F.size("_hits") > 0, glued).otherwise(t)).drop("_hits", "_key")


def pseudonymise(docs: DataFrame, key: str) -> DataFrame:
    """The documents with their texts rewritten, all columns as they are, whatever further ones there are.

    A null text stays null, an empty one empty; equal rows get equal texts; an empty table stays empty.
    """
    row = docs.select(F.struct("*").alias("_row"), F.col("text").alias("_text"))
    return with_pseudonyms(row, "_text", key).select(*(F.col("_text").alias("text") if c == "text" else F.col(f"_row.`{c}`").alias(c) for c in docs.columns))


def _is(kind: str):
    return lambda x: x == kind


def report(docs: DataFrame, key: str) -> DataFrame:
    """doc_id, text (rewritten), n_found and the number of each kind, of every document.

    A null text stays null and has none, as an empty one; equal rows get equal results; an empty table gives no rows; other columns are ignored.
    """
    out = with_pseudonyms(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "text", key)
    return out.select("doc_id", "text", F.coalesce(F.size("_found"), F.lit(0)).cast("long").alias("n_found"), *(F.coalesce(F.size(F.filter("_found", _is(k))), F.lit(0)).cast("long").alias(f"n_{k}") for k in KINDS))
