"""Format-preserving pseudonyms for personal data, by keyed Feistel networks.

Validated values are replaced by other valid values of the same format under a secret key, so that equal
values stay equal in all documents and nothing else is learnt from them:

- payment card numbers with a right Luhn digit: all digits but the last are permuted, the Luhn digit follows;
- phone numbers with a country code and 8 to 15 digits, however grouped: the digits after the country code are
  permuted; without one, only the form (555) 123-4567, of which all digits are;
- bank account numbers (IBAN) with right check digits: the part after them is permuted, the check digits follow;
- IPv4 addresses: a permutation of the 2^32 addresses;
- dates (2021-03-04 or 04.03.2021, with - / or . between, also before a time) in 1800 to 2199: a permutation of the
  146,097 days;
- e-mail addresses: the letters and digits before the @ are permuted within their class;
- hexadecimal keys of 32, 40 or 64 digits: digits within digits, letters a-f within a-f, case kept.

Dates that can only be read month first, and days or months of one digit, are left: their new values could not be
told from other formats when they are read back.

The network on characters splits them in two halves; in each round one half is shifted, character by
character within its class, by the keyed SHA-256 of the other. With ten rounds both halves are back in place.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placestat.llm.common import let

ROUNDS = 10
DAYS = 146_097
#: DAYS = 189 * 773, so a Feistel network on pairs permutes the days without walking out of them.
DAY_A, DAY_B = 189, 773
EPOCH = "1800-01-01"

CARD = r"(?<![0-9A-Za-z.+-])[0-9](?:[ -]?[0-9]){12,18}(?![0-9A-Za-z-])"
PHONE = (
    r"(?<![0-9A-Za-z])(?:\+[0-9]{8,15}|\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[ .-]?[0-9]{2,4}){2,5}|\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4})(?![0-9A-Za-z])"
)
# Country codes of one and two digits; all others have three.
COUNTRY = r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"
IPV4 = r"(?<![0-9A-Za-z.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9A-Za-z]|\.[0-9])"
DAY = "(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{4}/[0-9]{2}/[0-9]{2}|[0-9]{4}[.][0-9]{2}[.][0-9]{2}|[0-9]{2}-[0-9]{2}-[0-9]{4}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}[.][0-9]{2}[.][0-9]{4})"
DATE = rf"(?<![0-9A-Za-z./-]){DAY}(?=T[0-9]{{2}}:|(?![0-9A-Za-z]|[./-][0-9]))"
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+"
HEX = "(?<![0-9A-Za-z])(?:[0-9A-Fa-f]{64}|[0-9A-Fa-f]{40}|[0-9A-Fa-f]{32})(?![0-9A-Za-z])"
IBAN = "(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]{4}){2,7}(?: ?[0-9A-Z]{1,3})?(?![0-9A-Za-z])"
ANY = "|".join((PHONE, IPV4, DATE, CARD, EMAIL, HEX, IBAN))


def _byte(key: str, kind: str, r: Column, i: Column, other: Column) -> Column:
    """Keyed pseudo-random byte for character i (from 0) in round r."""
    digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), r.cast("string"), F.floor(i / 32).cast("string"), other), 256)
    return F.conv(F.substring(digest, (2 * (i % 32) + 1).cast("int"), F.lit(2)), 16, 10).cast("int")


def _shift(s: Column, by: Callable[[Column], Column], letters: int) -> Column:
    """Each digit, small letter and capital of ``s`` moved within its class; other characters stay."""

    def one(c: Column, i: Column) -> Column:
        a = F.ascii(c)
        moved = lambda base, n: F.char((F.pmod(a - base + by(i), F.lit(n)) + base).cast("long"))
        return F.when(a.between(48, 57), moved(48, 10)).when(a.between(97, 122), moved(97, letters)).when(a.between(65, 90), moved(65, letters)).otherwise(c)

    return F.array_join(F.transform(F.filter(F.split(s, ""), lambda c: c != ""), one), "")


def feistel_chars(s: Column, key: str, kind: str, letters: int = 26, inverse: bool = False) -> Column:
    """Keyed permutation of strings that keeps the class of every character; ``inverse`` undoes it."""
    half = F.floor(F.length(s) / 2).cast("int")
    start = F.struct(F.substring(s, F.lit(1), half).alias("a"), F.substring(s, half + 1, F.length(s)).alias("b"))

    def step(acc: Column, r: Column) -> Column:
        return F.struct(acc["b"].alias("a"), _shift(acc["a"], lambda i: _byte(key, kind, r, i, acc["b"]), letters).alias("b"))

    def back(acc: Column, r: Column) -> Column:
        return F.struct(_shift(acc["b"], lambda i: -_byte(key, kind, r, i, acc["a"]), letters).alias("a"), acc["a"].alias("b"))

    rounds = F.sequence(F.lit(1), F.lit(ROUNDS)) if not inverse else F.sequence(F.lit(ROUNDS), F.lit(1))
    return F.aggregate(rounds, start, back if inverse else step, lambda acc: F.concat(acc["a"], acc["b"]))


def feistel_pair(a: Column, b: Column, n_a: int, n_b: int, key: str, kind: str, inverse: bool = False) -> Column:
    """Keyed permutation of the pairs (a, b) with 0 <= a < n_a and 0 <= b < n_b, as a struct."""

    def f(r: Column, x: Column) -> Column:
        return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), r.cast("string"), x.cast("string")), 256), 1, 12), 16, 10).cast("long")

    sign = -1 if inverse else 1

    def step(acc: Column, r: Column) -> Column:
        first = F.pmod(acc["a"] + sign * f(r, acc["b"]), F.lit(n_a)).cast("long")
        second = F.pmod(acc["b"] + sign * f(r, acc["a"]), F.lit(n_b)).cast("long")
        odd = r % 2 == 1
        return F.struct(F.when(odd, first).otherwise(acc["a"]).alias("a"), F.when(odd, acc["b"]).otherwise(second).alias("b"))

    rounds = F.sequence(F.lit(1), F.lit(ROUNDS)) if not inverse else F.sequence(F.lit(ROUNDS), F.lit(1))
    return F.aggregate(rounds, F.struct(a.cast("long").alias("a"), b.cast("long").alias("b")), step)


def luhn_sum(digits: Column) -> Column:
    """Luhn sum of a digit string, its last digit counted once."""
    ds = F.filter(F.split(F.reverse(digits), ""), lambda c: c != "")
    weighted = F.transform(ds, lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(2 * c.cast("int") - F.when(c.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(weighted, F.lit(0), lambda a, x: a + x)


def _lay(value: Column, chars: Column) -> Column:
    """``value`` with its letters and digits replaced in order by those of ``chars``."""
    seen = lambda i: F.length(F.regexp_replace(F.substring(value, F.lit(1), i), "[^0-9A-Za-z]", ""))
    put = lambda c, i: F.when(c.rlike("[0-9A-Za-z]"), F.substring(chars, seen(i + 1), F.lit(1))).otherwise(c)
    return F.array_join(F.transform(F.filter(F.split(value, ""), lambda c: c != ""), put), "")


def _card(v: Column, key: str, inverse: bool) -> Column:
    digits = F.regexp_replace(v, "[^0-9]", "")
    body = feistel_chars(F.substring(digits, F.lit(1), F.length(digits) - 1), key, "card", inverse=inverse)
    return let(body, lambda b: _lay(v, F.concat(b, F.pmod(10 - luhn_sum(F.concat(b, F.lit("0"))) % 10, F.lit(10)).cast("string"))))


def _phone(v: Column, key: str, inverse: bool) -> Column:
    head = F.regexp_extract(v, COUNTRY, 0)
    rest = F.substring(v, F.length(head) + 1, F.length(v))
    return F.concat(head, _lay(rest, feistel_chars(F.regexp_replace(rest, "[^0-9]", ""), key, "phone", inverse=inverse)))


def mod97(s: Column) -> Column:
    """Remainder by 97 of a string of digits and capitals, A counted as 10 to Z as 35."""
    chars = F.filter(F.split(s, ""), lambda c: c != "")
    add = lambda acc, c: F.when(F.ascii(c) < 58, (acc * 10 + F.ascii(c) - 48) % 97).otherwise((acc * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(chars, F.lit(0), add)


def _iban(v: Column, key: str, inverse: bool) -> Column:
    country, rest = F.substring(v, 1, 2), F.replace(F.substring(v, F.lit(5), F.length(v)), F.lit(" "), F.lit(""))
    return let(
        feistel_chars(rest, key, "iban", inverse=inverse),
        lambda b: _lay(v, F.concat(country, F.lpad((98 - mod97(F.concat(b, country, F.lit("00")))).cast("string"), 2, "0"), b)),
    )


def _ipv4(v: Column, key: str, inverse: bool) -> Column:
    o = F.transform(F.split(v, r"\."), lambda x: x.cast("int"))
    pair = feistel_pair(o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536, key, "ipv4", inverse)
    return let(pair, lambda p: F.concat_ws(".", *[F.floor(x).cast("string") for x in (p["a"] / 256, p["a"] % 256, p["b"] / 256, p["b"] % 256)]))


def _year_first(v: Column) -> Column:
    return F.substring(v, 5, 1).isin("-", "/", ".")


def _iso(v: Column) -> Column:
    first = F.concat_ws("-", F.substring(v, 1, 4), F.substring(v, 6, 2), F.substring(v, 9, 2))
    return F.when(_year_first(v), first).otherwise(F.concat_ws("-", F.substring(v, 7, 4), F.substring(v, 4, 2), F.substring(v, 1, 2)))


def _date(v: Column, key: str, inverse: bool) -> Column:
    day = F.datediff(F.try_to_date(_iso(v), "yyyy-MM-dd"), F.lit(EPOCH).cast("date"))
    pair = feistel_pair(F.floor(day / DAY_B), day % DAY_B, DAY_A, DAY_B, key, "date", inverse)
    new = lambda p: F.date_add(F.lit(EPOCH).cast("date"), (p["a"] * DAY_B + p["b"]).cast("int"))
    mark = F.when(_year_first(v), F.substring(v, 5, 1)).otherwise(F.substring(v, 3, 1))
    return let(
        pair,
        lambda p: F.when(_year_first(v), F.concat(F.date_format(new(p), "yyyy"), mark, F.date_format(new(p), "MM"), mark, F.date_format(new(p), "dd"))).otherwise(
            F.concat(F.date_format(new(p), "dd"), mark, F.date_format(new(p), "MM"), mark, F.date_format(new(p), "yyyy"))
        ),
    )


def _email(v: Column, key: str, inverse: bool) -> Column:
    local = F.substring_index(v, "@", 1)
    return F.concat(_lay(local, feistel_chars(F.regexp_replace(local, "[^0-9A-Za-z]", ""), key, "email", inverse=inverse)), F.lit("@"), F.substring_index(v, "@", -1))


def kind_of(v: Column) -> Column:
    """Kind of a matched string, or null if it isn't valid."""
    digits = F.regexp_replace(v, "[^0-9]", "")
    valid_ip = ~F.exists(F.split(v, r"\."), lambda x: (x.cast("int") > 255) | (F.length(x) != F.length(x.cast("int").cast("string"))))
    day = F.datediff(F.try_to_date(_iso(v), "yyyy-MM-dd"), F.lit(EPOCH).cast("date"))
    bare = F.replace(v, F.lit(" "), F.lit(""))
    valid_iban = F.length(bare).between(15, 34) & F.substring(v, 3, 2).between("02", "98") & (mod97(F.concat(F.substring(bare, F.lit(5), F.length(bare)), F.substring(bare, 1, 4))) == 1)
    return (
        F.when(v.contains("@"), "email")
        .when(v.startswith("+"), F.when(F.length(digits).between(8, 15), "phone"))
        .when(v.startswith("("), "phone")
        .when(v.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$"), F.when(valid_ip, "ipv4"))
        .when(v.rlike(f"^{DAY}$"), F.when(day.between(0, DAYS - 1), "date"))
        .when(v.rlike("^([0-9A-Fa-f]{32}|[0-9A-Fa-f]{40}|[0-9A-Fa-f]{64})$"), "key")
        .when(v.rlike("^[0-9][0-9 -]*$") & F.length(digits).between(13, 19), F.when(luhn_sum(digits) % 10 == 0, "card"))
        .when(v.rlike("^[A-Z]{2}[0-9]{2}"), F.when(valid_iban, "iban"))
    )


def pseudonym(v: Column, kind: Column, key: str, inverse: bool = False) -> Column:
    """The value that stands for ``v``; ``inverse`` gives the original back."""
    return (
        F.when(kind == "card", _card(v, key, inverse))
        .when(kind == "phone", _phone(v, key, inverse))
        .when(kind == "ipv4", _ipv4(v, key, inverse))
        .when(kind == "date", _date(v, key, inverse))
        .when(kind == "iban", _iban(v, key, inverse))
        .when(kind == "email", _email(v, key, inverse))
        .when(kind == "key", feistel_chars(v, key, "key", letters=6, inverse=inverse))
        .otherwise(v)
    )


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text", inverse: bool = False) -> DataFrame:
    """``docs`` with personal data in the text replaced, and found: an array of (kind, start) of what was.

    ``start`` is the character position (from 0) in the input text; formats keep lengths, but for IPv4
    addresses, whose octets may gain or lose digits. Invalid look-alikes (wrong Luhn digit, octet over 255,
    no such day) stay. Null texts stay null with an empty array. All rows and columns stay; an input column
    ``found`` is replaced. Works within the row, so partitions, skew and repeated rows don't matter.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    empty = F.array().cast("array<struct<piece:string,value:string,kind:string>>")

    def parts(pieces: Column, values: Column) -> Column:
        return F.transform(pieces, lambda p, i: let(F.get(values, i), lambda v: F.struct(p.alias("piece"), v.alias("value"), kind_of(v).alias("kind"))))

    split = let(F.split(text, ANY, -1), lambda p: let(F.regexp_extract_all(text, F.lit(f"({ANY})"), F.lit(1)), lambda v: parts(p, v)))
    marked = docs.withColumn("__parts", F.when(text.rlike(ANY), split).otherwise(empty))
    joined = F.array_join(
        F.transform("__parts", lambda x: F.concat(x["piece"], F.coalesce(pseudonym(x["value"], x["kind"], key, inverse), F.lit("")))), ""
    )
    walk = F.aggregate(
        "__parts",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<kind:string,start:int>>").alias("found")),
        lambda acc, x: F.struct(
            (acc["at"] + F.length(x["piece"]) + F.coalesce(F.length(x["value"]), F.lit(0))).alias("at"),
            F.when(x["kind"].isNotNull(), F.concat(acc["found"], F.array(F.struct(x["kind"].alias("kind"), (acc["at"] + F.length(x["piece"])).alias("start"))))).otherwise(acc["found"]).alias("found"),
        ),
        lambda acc: acc["found"],
    )
    return marked.withColumn("found", walk).withColumn(text_col, F.when(F.size("__parts") > 0, joined).otherwise(F.col(text_col))).drop("__parts")
