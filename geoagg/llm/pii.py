"""Format-preserving pseudonyms for personal data (native).

A text is cut at every match of one pattern; matches that are valid for their kind are replaced, the rest of the text is kept
as it is. A value is permuted with a keyed, ten-round Feistel network over its own digits or letters, so equal values get
equal pseudonyms in all documents and different values different ones, and the format stays:

* card: 13-19 digits with a valid Luhn sum; all digits but the last are permuted, the last is the Luhn digit again;
* ssn: ddd-dd-dddd that can be one (area not 000 or 666, group not 00, serial not 0000); the nine digits are permuted within
  these, by walking the cycle until it is inside;
* phone: ``+1 (ddd) ddd-dddd`` and the like; the last seven digits are permuted, the rest is kept. There is no check digit, and
  a numbering plan is not asked for: it would leave real numbers of other plans in clear;
* ip: four numbers up to 255; the address is permuted within 0 .. 2**32 - 1;
* date: yyyy-mm-dd, dd.mm.yyyy or mm/dd/yyyy that is a day of the calendar in 1900-2099; the day's number is permuted in that
  range, by walking the cycle until it is inside;
* email: every run of letters and of digits of the part before ``@`` is permuted within its alphabet; capitals stay capitals,
  and names that differ in case only have pseudonyms that do.

The round function is SHA-256 over (key, kind, round, length, half). The key is the caller's; who has it can undo the permutation.

Defined results: a null text stays null with no counts; a text without matches is unchanged; the cost of a text is linear
in its length; equal texts have equal results; empty tables give empty results; extra columns pass through, whatever their
names, and columns of the input named like an added one are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import carried, let, restored

ROUNDS = 10
DAYS = 73049  # 1900-01-01 .. 2099-12-31
#: The key of the registered query, which shows the operator on made data.
QUERY_KEY = "demo-key"
KINDS = ("card", "ssn", "phone", "ip", "date", "email")

#: The format of each kind, in the order in which they are tried at a place of the text.
PATTERNS = {
    "email": r"[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,8}",
    "date": r"(?<![\d.-])(?:\d{4}-\d{2}-\d{2}|\d{2}\.\d{2}\.\d{4}|\d{2}/\d{2}/\d{4})(?![\d-])",
    "ip": r"(?<![\d.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?![\d]|\.\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "card": r"(?<!\d)(?:\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{1,7}|\d{4}[ -]\d{6}[ -]\d{5}|\d{13,19})(?!\d)",
    "phone": r"(?<![\d+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\d)",
}
ANY = "|".join(PATTERNS.values())


def _number(half: Column, radix: int) -> Column:
    """The value of a digit string; letters a-z count as digits 0-25. Exact up to 12 letters or 17 digits."""
    if radix == 10:
        return half.cast("decimal(20,0)")
    return F.conv(F.translate(half, "abcdefghijklmnopqrstuvwxyz", "0123456789abcdefghijklmnop"), 26, 10).cast("decimal(20,0)")


def _string(value: Column, length: Column, radix: int) -> Column:
    if radix == 10:
        return F.lpad(value.cast("decimal(20,0)").cast("string"), length, "0")
    digits = F.lower(F.conv(value.cast("decimal(20,0)").cast("string"), 10, 26))
    return F.lpad(F.translate(digits, "0123456789abcdefghijklmnop", "abcdefghijklmnopqrstuvwxyz"), length, "a")


def _hash(key: str, kind: Column, r: Column, length: Column, half: Column) -> Column:
    """A number below 2**60 from the key, the kind, the round and the other half."""
    return F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(key), kind, r.cast("string"), length.cast("string"), half), 256), 1, 15), 16, 10).cast("decimal(20,0)")


def feistel(value: Column, kind: Column, key: str, radix: int = 10) -> Column:
    """A keyed permutation of the strings of the length of ``value`` over digits or a-z."""
    length = F.length(value)
    left = F.floor(length / 2).cast("int")
    start = F.struct(F.substring(value, F.lit(1), left).alias("a"), F.substring(value, left + 1, length).alias("b"))

    def step(s: Column, r: Column) -> Column:
        size = F.length(s["a"])
        space = F.pow(F.lit(float(radix)), size).cast("decimal(20,0)")
        mixed = (F.coalesce(_number(s["a"], radix), F.lit(0).cast("decimal(20,0)")) + _hash(key, kind, r, length, s["b"])) % space
        return F.struct(s["b"].alias("a"), F.when(size > 0, _string(mixed, size, radix)).otherwise("").alias("b"))

    done = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step, lambda s: F.concat(s["a"], s["b"]))
    # one character has no second half: it is shifted by the key
    shifted = _string((_number(value, radix) + _hash(key, kind, F.lit(0), length, F.lit(""))) % F.lit(radix), length, radix)
    return F.when(length == 1, shifted).otherwise(done)


def _binary_feistel(value: Column, bits: int, kind: str, key: str) -> Column:
    """A keyed permutation of 0 .. 2**bits - 1, ``bits`` even."""
    half = bits // 2
    size = 1 << half
    start = F.struct(F.floor(value / size).cast("long").alias("a"), (value % size).cast("long").alias("b"))
    step = lambda s, r: F.struct(s["b"].alias("a"), ((s["a"] + _hash(key, F.lit(kind), r, F.lit(bits), s["b"].cast("string"))) % size).cast("long").alias("b"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step, lambda s: s["a"] * size + s["b"])


def luhn_sum(digits: Column) -> Column:
    """Sum of the digits with every second one from the right, from the last but one, doubled and cast out."""
    n = F.length(digits)
    each = F.transform(F.split(digits, ""), lambda c, i: F.when(F.pmod(n - i, F.lit(2)) == 0, _doubled(c.cast("int"))).otherwise(c.cast("int")))
    return F.aggregate(F.filter(each, lambda x: x.isNotNull()), F.lit(0), lambda a, x: a + x)


def _doubled(d: Column) -> Column:
    return F.when(d > 4, d * 2 - 9).otherwise(d * 2)


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _formatted(match: Column, digits: Column) -> Column:
    """``digits`` in the places of the digits of ``match``."""
    marks = F.split(match, "")
    put = lambda c, i: F.when(c.rlike("^[0-9]$"), F.substring(digits, F.length(_digits(F.substring(match, F.lit(1), i + 1))), F.lit(1))).otherwise(c)
    return F.array_join(F.transform(marks, put), "")


def _card(match: Column, key: str) -> Column:
    def renumbered(d: Column) -> Column:
        body = feistel(F.substring(d, F.lit(1), F.length(d) - 1), F.lit("card"), key)
        return let(body, lambda b: F.concat(b, F.pmod(-luhn_sum(F.concat(b, F.lit("0"))), F.lit(10)).cast("string")))

    return _formatted(match, let(_digits(match), renumbered))


def _can_be_ssn(digits: Column) -> Column:
    return ~digits.rlike("^(?:000|666|...00|.....0000)")


def _ssn(match: Column, key: str) -> Column:
    # one of 80 numbers is outside: 32 steps miss with a chance of 1e-60
    once = lambda v: feistel(v, F.lit("ssn"), key)
    walk = F.aggregate(F.sequence(F.lit(1), F.lit(32)), once(_digits(match)), lambda v, i: F.when(_can_be_ssn(v), v).otherwise(once(v)))
    return _formatted(match, walk)


def _phone(match: Column, key: str) -> Column:
    return _formatted(match, let(_digits(match), lambda d: F.concat(F.substring(d, F.lit(1), F.length(d) - 7), feistel(F.substring(d, F.length(d) - 6, F.lit(7)), F.lit("phone"), key))))


def _ip(match: Column, key: str) -> Column:
    parts = F.transform(F.split(match, r"\."), lambda x: x.cast("long"))
    value = let(parts, lambda p: ((F.get(p, F.lit(0)) * 256 + F.get(p, F.lit(1))) * 256 + F.get(p, F.lit(2))) * 256 + F.get(p, F.lit(3)))
    octet = lambda v, k: (F.floor(v / (1 << k)) % 256).cast("long").cast("string")
    return let(_binary_feistel(value, 32, "ip", key), lambda v: F.concat_ws(".", *[octet(v, k) for k in (24, 16, 8, 0)]))


def _day(match: Column) -> Column:
    """The day's number from 1900-01-01, null if the text is no day in 1900-2099."""
    iso = F.when(match.rlike(r"^\d{4}-"), match).when(match.contains("."), F.concat_ws("-", F.substring(match, 7, 4), F.substring(match, 4, 2), F.substring(match, 1, 2)))
    iso = iso.otherwise(F.concat_ws("-", F.substring(match, 7, 4), F.substring(match, 1, 2), F.substring(match, 4, 2)))
    day = F.datediff(F.call_function("try_to_date", iso, F.lit("yyyy-MM-dd")), F.lit("1900-01-01").cast("date"))
    return F.when((day >= 0) & (day < DAYS), day.cast("long"))


def _date(match: Column, key: str) -> Column:
    # 18 bits hold the range 3.6 times: walk the cycle until inside; 256 steps miss with a chance of 1e-36
    walk = F.aggregate(
        F.sequence(F.lit(1), F.lit(256)),
        _binary_feistel(_day(match), 18, "date", key),
        lambda v, i: F.when(v < DAYS, v).otherwise(_binary_feistel(v, 18, "date", key)),
    )

    def written(d: Column) -> Column:
        day = F.date_add(F.lit("1900-01-01").cast("date"), d.cast("int"))
        return F.when(match.rlike(r"^\d{4}-"), F.date_format(day, "yyyy-MM-dd")).when(match.contains("."), F.date_format(day, "dd.MM.yyyy")).otherwise(F.date_format(day, "MM/dd/yyyy"))

    return let(walk, written)


def _email(match: Column, key: str) -> Column:
    local = F.lower(F.substring_index(match, "@", 1))
    runs = F.regexp_extract_all(local, F.lit("([a-z]{1,20}|[0-9]{1,20}|[^a-z0-9]+)"), F.lit(1))
    one = lambda r: F.when(r.rlike("^[a-z]"), feistel(r, F.lit("email"), key, 26)).when(r.rlike("^[0-9]"), feistel(r, F.lit("email"), key)).otherwise(r)
    cased = lambda made: F.array_join(F.transform(F.split(F.substring_index(match, "@", 1), ""), lambda c, i: F.when(c.rlike("^[A-Z]$"), F.upper(F.substring(made, i + 1, F.lit(1)))).otherwise(F.substring(made, i + 1, F.lit(1)))), "")
    return F.concat(let(F.array_join(F.transform(runs, one), ""), cased), F.lit("@"), F.substring_index(match, "@", -1))


def kind_of(match: Column) -> Column:
    """The kind of a match if it is valid for it, else null."""
    full = {k: f"^(?:{p})$" for k, p in PATTERNS.items()}
    octets = F.transform(F.split(match, r"\."), lambda x: x.cast("int"))
    digits = _digits(match)
    return (
        F.when(match.contains("@"), "email")
        .when(match.rlike(full["date"]) & _day(match).isNotNull(), "date")
        .when(match.rlike(full["ip"]) & F.forall(octets, lambda x: x < 256), "ip")
        .when(match.rlike(full["ssn"]) & _can_be_ssn(digits), "ssn")
        .when(match.rlike(full["card"]) & (F.length(digits) >= 13) & (F.length(digits) <= 19) & (luhn_sum(digits) % 10 == 0), "card")
        .when(match.rlike(full["phone"]), "phone")
    )


def replaced(match: Column, kind: Column, key: str) -> Column:
    make = {"card": _card, "ssn": _ssn, "phone": _phone, "ip": _ip, "date": _date, "email": _email}
    out = F.when(kind.isNull(), match)
    for k in KINDS:
        out = out.when(kind == k, make[k](match, key))
    return out


def pseudonymize(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` with ``text`` rewritten and ``findings``: array of (kind, value, pseudonym) in the order of the text.

    ``value`` is the personal datum itself: drop it where the result leaves the trusted side.
    """
    text = F.col("text")
    matches = F.regexp_extract_all(text, F.lit(f"({ANY})"), F.lit(1))
    kinds = F.transform(F.col("m"), lambda m: F.struct(kind_of(m).alias("kind"), m.alias("value")))
    found = F.transform(F.col("k"), lambda x: F.struct(x["kind"].alias("kind"), x["value"].alias("value"), replaced(x["value"], x["kind"], key).alias("pseudonym")))
    # between the matches lie one part more than matches
    parts = F.split(text, ANY, -1)
    joined = F.array_join(F.flatten(F.zip_with(parts, F.col("f"), lambda p, f: F.array(p, F.coalesce(f["pseudonym"], F.lit(""))))), "")
    out = docs.select(carried(docs, "text", "findings"), text)
    out = out.withColumn("m", F.when(text.rlike("[0-9@]"), matches).otherwise(F.array().cast("array<string>")))
    out = out.withColumn("k", kinds).withColumn("f", found)
    return restored(out, F.when(F.size("m") > 0, joined).otherwise(text).alias("text"), F.filter(F.col("f"), lambda f: f["kind"].isNotNull()).alias("findings"))


def op3_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = pseudonymize(docs, QUERY_KEY)
    n = lambda k: F.size(F.filter("findings", lambda f: f["kind"] == k)).cast("long").alias(f"n_{k}")
    return out.select("doc_id", "text", F.coalesce(F.size("findings"), F.lit(0)).cast("long").alias("n_found"), *[n(k) for k in KINDS])


QUERIES = {"op3_pseudonyms": op3_pseudonyms}
ORACLE: dict[str, str] = {}
