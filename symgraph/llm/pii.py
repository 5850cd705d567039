"""PII: format-preserving Feistel pseudonyms, by DataFrame functions only.

Found and validated: payment card numbers (13 to 19 digits, Luhn), phone numbers (a country code that exists and 8 to 15
digits, or the North American forms), social security and international bank account numbers (mod 97; whole or in groups
of four), IPv4 addresses, calendar dates, mail addresses (the local part), and three forms of credentials. A value's
characters are permuted by a keyed Feistel network over their own alphabet; separators and length stay, a card's check
digit is made anew, an address stays four octets, a date stays a date of its century, a phone keeps its country code. The
same value gets the same pseudonym in every document and whatever its separators, different values different ones. A
string that fails validation is left alone.

The key is the caller's; the queries read it from the session's KEY_SETTING. Null text stays null, empty text empty; other
text around values is untouched whatever its length; all other columns pass through, but for an n_values of the input,
which the result's replaces; repeated rows get equal results; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, table

#: The session's setting that holds the key, and what the queries take where it is unset.
KEY_SETTING, DEMO_KEY = "spark.symgraph.pii.key", "symgraph-demo-key"
ROUNDS = 10
_CARD = r"(?<![A-Za-z0-9])(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{4}|\d{4}[ -]\d{6}[ -]\d{5})(?![A-Za-z0-9])"
_PHONE = (
    r"(?<![A-Za-z0-9+])(?:\+1[ .-]?(?:\(\d{3}\)|\d{3})[ .-]?\d{3}[ .-]?\d{4}|\+\d{2,3}[ .-]\d{1,3}(?:[ .-]\d{2}){3,4}"
    r"|\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})[ .-]?\d{3,4}[ .-]?\d{3,4}|\+\d{1,3}[ .-]\d{2,5}[ .-]\d{4,9}|\+\d{1,3}[ .-]\d{5,12}|\+\d{8,15}"
    r"|\(\d{3}\) ?\d{3}-\d{4}|\d{3}-\d{3}-\d{4})(?![A-Za-z0-9])"
)
#: How many digits country calling codes have.
_COUNTRY = "^(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[2-9][0-9][0-9])"
_IP = r"(?<![A-Za-z0-9.])(?:\d{1,3}\.){3}\d{1,3}(?![A-Za-z0-9]|\.\d)"
_SSN = r"(?<![A-Za-z0-9-])(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}(?![A-Za-z0-9]|-\d)"
_IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![A-Za-z0-9])"
_DATE = r"(?<![A-Za-z0-9])(?:\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{2}[/.]\d{2}[/.]\d{4})(?![A-Za-z0-9])"
_MAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@(?:[A-Za-z0-9-]{1,63}\.)+[A-Za-z]{2,24}(?![A-Za-z0-9])"
_CREDENTIAL = r"(?<![A-Z0-9])AKIA[A-Z0-9]{16}(?![A-Z0-9])|token = \"[0-9a-f]{40}\"|password=[A-Za-z0-9]{8,64}"
PATTERN = "|".join((_MAIL, _CARD, _PHONE, _SSN, _IBAN, _IP, _DATE, _CREDENTIAL))
#: Every match of PATTERN has one of these; the credentials need no digit.
_SIGN = r"[0-9@]|AKIA|token = \"|password="
_DIGITS, _HEX, _LOWER, _UPPER = "0123456789", "0123456789abcdef", "0123456789abcdefghijklmnopqrstuvwxyz", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def let(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def _count_to(n: Column) -> Column:
    return F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))


def feistel(s: Column, alphabet: str, kind: str, key: str) -> Column:
    """A keyed permutation of the strings over alphabet with s's length."""
    base, letters = len(alphabet), F.lit(alphabet)
    half = F.floor(F.char_length(s) / 2).cast("int")
    start = F.struct(F.substring(s, F.lit(1), half).alias("l"), F.substring(s, half + 1, F.char_length(s)).alias("r"))

    def mixed(left: Column, digest: Column) -> Column:
        def one(i: Column) -> Column:
            add = F.conv(F.substring(digest, (i - 1) % 32 * 2 + 1, F.lit(2)), 16, 10).cast("int")
            return F.substring(letters, (F.instr(letters, F.substring(left, i, F.lit(1))) - 1 + add) % base + 1, F.lit(1))

        return F.array_join(F.transform(_count_to(F.char_length(left)), one), "")

    def step(a: Column, i: Column) -> Column:
        digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), i.cast("string"), F.char_length(a["l"]).cast("string"), a["r"]), 256)
        return F.struct(a["r"].alias("l"), let(digest, lambda d: mixed(a["l"], d)).alias("r"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step, lambda a: F.concat(a["l"], a["r"]))


def only(m: Column, outside: str) -> Column:
    return F.regexp_replace(m, outside, "")


def refill(m: Column, chars: Column, inside: str) -> Column:
    """m with its characters that match inside replaced, in order, by chars."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("k"))

    def step(a: Column, i: Column) -> Column:
        c = F.substring(m, i, F.lit(1))
        return F.when(c.rlike(inside), F.struct(F.concat(a["out"], F.substring(chars, a["k"], F.lit(1))).alias("out"), (a["k"] + 1).alias("k"))).otherwise(F.struct(F.concat(a["out"], c).alias("out"), a["k"].alias("k")))

    return F.aggregate(_count_to(F.char_length(m)), start, step, lambda a: a["out"])


def _luhn(digits: Column, shift: int) -> Column:
    """Luhn sum; shift 0 if the last digit is the check digit, 1 if the check digit is still to come."""

    def worth(i: Column) -> Column:
        d = F.substring(digits, F.char_length(digits) - i + 1, F.lit(1)).cast("int")
        return F.when((i + shift) % 2 == 0, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)

    return F.aggregate(_count_to(F.char_length(digits)), F.lit(0), lambda a, i: a + worth(i))


def card(m: Column, key: str) -> Column:
    def new(d: Column) -> Column:
        body = let(feistel(F.substring(d, F.lit(1), F.char_length(d) - 1), _DIGITS, "card", key), lambda b: F.concat(b, F.pmod(-_luhn(b, 1), F.lit(10)).cast("string")))
        return F.when(_luhn(d, 0) % 10 == 0, let(body, lambda b: refill(m, b, "[0-9]"))).otherwise(m)

    return let(only(m, "[^0-9]"), new)


def phone(m: Column, key: str) -> Column:
    def new(d: Column) -> Column:
        code = F.when(m.startswith("+"), F.regexp_extract(d, _COUNTRY, 0)).otherwise("")
        fine = ~m.startswith("+") | ((F.char_length(code) > 0) & F.char_length(d).between(8, 15))
        own = F.substring(d, F.char_length(code) + 1, F.char_length(d))
        return F.when(fine, let(F.concat(code, feistel(own, _DIGITS, "phone", key)), lambda n: refill(m, n, "[0-9]"))).otherwise(m)

    return let(only(m, "[^0-9]"), new)


def address(m: Column, key: str) -> Column:
    parts = F.transform(F.split(m, r"\."), lambda p: p.cast("int"))
    as_hex = lambda p: F.array_join(F.transform(p, lambda x: F.lower(F.lpad(F.conv(x.cast("string"), 10, 16), 2, "0"))), "")
    back = lambda h: F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.conv(F.substring(h, 2 * i + 1, F.lit(2)), 16, 10)), ".")
    return let(parts, lambda p: F.when(F.forall(p, lambda x: x < 256), let(feistel(as_hex(p), _HEX, "ip", key), back)).otherwise(m))


#: Days of a century as a product of two numbers, for a Feistel network on the two digits of that mixed base.
_CENTURY = {36524: (92, 397), 36525: (75, 487)}


def date(m: Column, key: str) -> Column:
    """ISO, or day first with / or ., or month first where day first is no date; years 1000 to 9999."""
    formats = [(r"^\d{4}-", "yyyy-MM-dd"), (r"^\d{4}/", "yyyy/MM/dd"), (r"^\d\d/\d\d/", "dd/MM/yyyy"), (r"^\d\d\.\d\d\.", "dd.MM.yyyy"), (r"^\d\d/\d\d/", "MM/dd/yyyy")]

    def moved(day: Column) -> Column:
        first = F.make_date(F.floor(F.year(day) / 100).cast("int") * 100, F.lit(1), F.lit(1))
        after = F.make_date(F.floor(F.year(day) / 100).cast("int") * 100 + 100, F.lit(1), F.lit(1))

        def within(a: int, b: int, base: Column) -> Column:
            x = F.datediff(day, base)
            start = F.struct(F.floor(x / b).cast("int").alias("l"), (x % b).cast("int").alias("r"))

            def step(s: Column, i: Column) -> Column:
                f = lambda part: F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit("date"), i.cast("string"), part.cast("string")), 256), 1, 12), 16, 10).cast("long")
                return F.when(i % 2 == 0, F.struct(F.pmod(s["l"] + f(s["r"]), F.lit(a)).cast("int").alias("l"), s["r"].alias("r"))).otherwise(F.struct(s["l"].alias("l"), F.pmod(s["r"] + f(s["l"]), F.lit(b)).cast("int").alias("r")))

            return F.date_add(base, F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step, lambda s: s["l"] * b + s["r"]))

        return let(first, lambda base: F.when(F.datediff(after, base) == 36524, within(*_CENTURY[36524], base)).otherwise(within(*_CENTURY[36525], base)))

    def shown(form: str):
        return lambda d: F.date_format(moved(d), form)

    out = m
    for start, form in reversed(formats):
        day = F.try_to_timestamp(m, F.lit(form)).cast("date")
        out = F.when(m.rlike(start) & day.isNotNull() & (F.year(day) >= 1000) & (F.year(day) <= 9999), let(day, shown(form))).otherwise(out)
    return out


def social(m: Column, key: str) -> Column:
    """A social security number; the network is walked on until its result is a valid number again."""
    fine = lambda d: d.rlike(r"^(?!000|666|9)\d{3}(?!00)\d{2}(?!0000)\d{4}$")
    once = lambda d: feistel(d, _DIGITS, "ssn", key)
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(64)), once(only(m, "[^0-9]")), lambda d, _: F.when(fine(d), d).otherwise(once(d)))
    return let(walked, lambda d: refill(m, d, "[0-9]"))


def _mod97(s: Column) -> Column:
    def add(a: Column, c: Column) -> Column:
        return F.when(c.rlike("[0-9]"), (a * 10 + F.ascii(c) - 48) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)

    return F.aggregate(_count_to(F.char_length(s)), F.lit(0), lambda a, i: add(a, F.substring(s, i, F.lit(1))))


def iban(m: Column, key: str) -> Column:
    """The account part's digits are permuted and the check digits made anew; country, letters and spaces stay."""

    def of(v: Column) -> Column:
        country, account = F.substring(v, 1, 2), F.substring(v, F.lit(5), F.char_length(v))
        checked = lambda a: F.concat(country, F.lpad((98 - _mod97(F.concat(a, country, F.lit("00")))).cast("string"), 2, "0"), a)
        return let(let(feistel(only(account, "[^0-9]"), _DIGITS, "iban", key), lambda d: refill(account, d, "[0-9]")), checked)

    def valid(part: Column) -> Column:
        return let(only(part, " "), lambda v: F.char_length(v).between(15, 34) & (_mod97(F.concat(F.substring(v, F.lit(5), F.char_length(v)), F.substring(v, 1, 4))) == 1))

    # a word in capitals after the last group may look like one
    parts = F.array(m, F.regexp_replace(m, " [A-Z0-9]+$", ""), F.regexp_replace(m, "(?: [A-Z0-9]+){2}$", ""))
    found = F.get(F.filter(parts, valid), F.lit(0))
    return let(found, lambda part: F.when(part.isNull(), m).otherwise(F.concat(let(of(only(part, " ")), lambda v: refill(part, v, "[A-Z0-9]")), F.substring(m, F.char_length(part) + 1, F.char_length(m)))))


def mail(m: Column, key: str) -> Column:
    name, rest = F.substring_index(m, "@", 1), F.concat(F.lit("@"), F.substring_index(m, "@", -1))
    return F.concat(let(F.lower(name), lambda n: let(feistel(only(n, "[^a-z0-9]"), _LOWER, "mail", key), lambda d: refill(n, d, "[a-z0-9]"))), rest)


def credential(m: Column, key: str) -> Column:
    head = F.regexp_extract(m, r"^(AKIA|token = \"|password=)", 1)

    def new(h: Column) -> Column:
        body = F.substring(m, F.char_length(h) + 1, F.char_length(m))
        return (
            F.when(h == "AKIA", F.concat(h, feistel(body, _UPPER, "akia", key)))
            .when(h == "password=", F.concat(h, feistel(F.lower(body), _LOWER, "password", key)))
            .otherwise(F.concat(h, feistel(F.regexp_replace(body, '"', ""), _HEX, "token", key), F.lit('"')))
        )

    return let(head, new)


def pseudonym(m: Column, key: str) -> Column:
    """The pseudonym of one match of PATTERN."""
    whole = lambda p: m.rlike("^(?:" + p + ")$")
    return (
        F.when(m.contains("@"), mail(m, key))
        .when(m.startswith("AKIA") | m.startswith("token") | m.startswith("password"), credential(m, key))
        .when(whole(_CARD), card(m, key))
        .when(whole(_SSN), social(m, key))
        .when(whole(_IBAN), iban(m, key))
        .when(whole(_IP), address(m, key))
        .when(whole(_DATE), date(m, key))
        .otherwise(phone(m, key))
    )


def pseudonymise(docs: DataFrame, key: str, column: str = "text") -> DataFrame:
    """docs with column rewritten and n_values, the number of values replaced."""
    text, found, new = F.col(column), fresh(docs, "_found"), fresh(docs, "_new")
    likely = text.rlike(_SIGN) & text.rlike(PATTERN)
    values = docs.withColumn(found, F.when(likely, F.regexp_extract_all(text, F.lit(PATTERN), 0)).otherwise(F.array().cast("array<string>")))
    values = values.withColumn(new, F.transform(found, lambda m: pseudonym(m, key)))
    pieces = F.split(text, PATTERN, -1)
    joined = let(pieces, lambda p: F.array_join(F.concat(F.flatten(F.zip_with(F.slice(p, F.lit(1), F.size(new)), F.col(new), lambda a, b: F.array(a, b))), F.slice(p, -1, 1)), ""))
    out = F.when(F.size(new) > 0, joined).otherwise(text)
    n = F.coalesce(F.aggregate(F.zip_with(found, new, lambda a, b: (a != b).cast("int")), F.lit(0), lambda a, x: a + x), F.lit(0))
    return values.withColumns({column: out, "n_values": n}).drop(found, new)


def key_of(spark: SparkSession) -> str:
    return spark.conf.get(KEY_SETTING, None) or DEMO_KEY


def op6_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), key_of(spark))
