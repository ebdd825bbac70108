"""PII: format-preserving Feistel pseudonyms for validated numbers, dates and addresses. DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.llm.tables import column, spread, unused

ROUNDS = 8

#: Patterns by kind, in order of precedence; a match that its kind's check rejects stays as it is.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "date": r"(?<![0-9./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{4}/[0-9]{2}/[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})(?![0-9]|[./-][0-9])",
    "ssn": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z]|-[0-9])",
    "ip": r"(?<![0-9A-Za-z.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9A-Za-z]|\.[0-9])",
    "card": r"(?<![0-9A-Za-z])(?:[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}|[0-9]{4}([ -])[0-9]{6}\2[0-9]{5})(?![0-9A-Za-z])",
    "phone": r"(?<![0-9A-Za-z+])(?:\+1[ .-]?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}|(?:\([2-9][0-9]{2}\) ?|[2-9][0-9]{2}[ .-])[2-9][0-9]{2}[ .-][0-9]{4}|\+[2-9][0-9]{0,2}(?:[ .-]?\(?[0-9]{1,4}\)?){2,5})(?![0-9])",
}
ANY = "|".join(f"(?:{x})" for x in PATTERNS.values())
#: Days from 1000-01-01 in cycles of 400 years, each 146,097 = 189 * 773 days.
FIRST_DAY, CYCLE, DATE_PARTS = "1000-01-01", 146_097, (189, 773)


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def feistel(values: Column, radixes: Column, key: str, tweak: Column) -> Column:
    """A keyed permutation of integer vectors with 0 <= values[i] < radixes[i]: each round adds to the values at
    places of one parity, modulo their radix, a stream that a SHA-256 of key, tweak, round and the other values seeds."""

    def one_round(state: Column, turn: Column) -> Column:
        others = F.array_join(F.transform(F.filter(state, lambda x, i: i % 2 != turn % 2), lambda x: x.cast("string")), ",")
        seed = F.sha2(F.concat_ws("|", F.lit(key), tweak, turn.cast("string"), others), 256)
        return bind(seed, lambda s: F.transform(state, lambda x, i: F.when(i % 2 == turn % 2, added(x, F.xxhash64(s, i), F.get(radixes, i))).otherwise(x)))

    def added(x: Column, stream: Column, radix: Column) -> Column:
        return F.pmod(x + F.pmod(stream, radix.cast("long")), radix.cast("long")).cast("int")

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), values, one_round)


def numbers(text: Column, pattern: str = "([0-9])") -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), lambda x: x.cast("int"))


def refill(text: Column, pattern: str, symbols: Column) -> Column:
    """text with its characters that match the pattern replaced in order."""
    chars = F.regexp_extract_all(text, F.lit("(?s)(.)"), F.lit(1))
    at = F.filter(F.sequence(F.lit(1), F.length(text)), lambda i: F.substring(text, i, F.lit(1)).rlike(pattern))
    return bind(at, lambda at: F.array_join(F.transform(chars, lambda c, i: F.coalesce(F.get(symbols, (F.array_position(at, i + 1) - 1).cast("int")), c)), ""))


def luhn_sum(digits: Column) -> Column:
    n = F.size(digits)
    doubled = F.transform(digits, lambda d, i: F.when((n - i) % 2 == 0, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d))
    return F.aggregate(doubled, F.lit(0), lambda a, b: a + b)


def strings(values: Column) -> Column:
    return F.transform(values, lambda x: x.cast("string"))


def new_card(text: Column, key: str) -> Column:
    """All digits but the first, which names the issuer's kind, and the last, which checks the others."""

    def permuted(d: Column) -> Column:
        body = F.slice(d, 2, F.size(d) - 2)
        inner = feistel(body, F.transform(body, lambda _: F.lit(10)), key, F.concat_ws("-", F.lit("card"), F.size(d).cast("string"), F.get(d, F.lit(0)).cast("string")))
        return bind(F.concat(F.slice(d, 1, 1), inner, F.array(F.lit(0))), lambda x: F.concat(F.slice(x, 1, F.size(x) - 1), F.array((10 - luhn_sum(x) % 10) % 10)))

    return bind(numbers(text), lambda d: F.when(luhn_sum(d) % 10 == 0, refill(text, "[0-9]", strings(permuted(d)))).otherwise(text))


def new_phone(text: Column, key: str) -> Column:
    """North American numbers keep +1, and an area or exchange that begins with 2 to 9 goes on doing so; others keep two
    digits."""
    american = ~text.startswith("+") | text.startswith("+1")

    def permuted(d: Column) -> Column:
        lead = F.when(american, F.size(d) - 10).otherwise(F.lit(2))
        body = F.slice(d, lead + 1, F.size(d) - lead)
        least = F.transform(body, lambda x, i: F.when(american & i.isin(0, 3) & (x > 1), 2).otherwise(0))
        radix = F.transform(body, lambda x, i: F.when(american & i.isin(0, 3), F.when(x > 1, 8).otherwise(2)).otherwise(10))
        shifted = F.zip_with(body, least, lambda x, y: x - y)
        inner = feistel(shifted, radix, key, F.concat_ws("-", F.lit("phone"), F.when(american, "1").otherwise(F.array_join(F.slice(strings(d), 1, 2), ""))))
        return F.concat(F.slice(d, F.lit(1), lead), F.zip_with(inner, least, lambda x, y: x + y))

    size = lambda d: F.when(american, F.size(d).isin(10, 11)).otherwise(F.size(d).between(8, 15))
    return bind(numbers(text), lambda d: F.when(size(d), refill(text, "[0-9]", strings(permuted(d)))).otherwise(text))


def new_ip(text: Column, key: str) -> Column:
    parts = numbers(text, "([0-9]+)")
    return bind(parts, lambda p: F.when(F.forall(p, lambda x: x < 256), F.array_join(strings(feistel(p, F.transform(p, lambda _: F.lit(256)), key, F.lit("ip"))), ".")).otherwise(text))


def new_ssn(text: Column, key: str) -> Column:
    """Area 001 to 899 but 666, group 01 to 99, serial 0001 to 9999."""

    def permuted(p: Column) -> Column:
        area, group, serial = (F.get(p, F.lit(i)) for i in range(3))
        valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
        inner = feistel(F.array(area - 1 - (area > 666).cast("int"), group - 1, serial - 1), F.array(F.lit(898), F.lit(99), F.lit(9999)), key, F.lit("ssn"))
        made = bind(inner, lambda x: F.format_string("%03d-%02d-%04d", F.get(x, F.lit(0)) + 1 + (F.get(x, F.lit(0)) >= 665).cast("int"), F.get(x, F.lit(1)) + 1, F.get(x, F.lit(2)) + 1))
        return F.when(valid, made).otherwise(text)

    return bind(numbers(text, "([0-9]+)"), permuted)


def new_date(text: Column, key: str) -> Column:
    """Y-m-d, Y/m/d, m/d/Y (or d/m/Y where only that is a date) and d.m.Y; the same day gets the same new day in all."""
    point, slash_end = text.contains("."), text.rlike("/[0-9]{4}$")

    def permuted(p: Column) -> Column:
        a, b, c = (F.get(p, F.lit(i)) for i in range(3))
        last = point | slash_end
        year = F.when(last, c).otherwise(a)
        flipped = slash_end & (a > 12)
        month = F.when(point | flipped, b).when(slash_end, a).otherwise(b)
        day = F.when(point | flipped, a).when(slash_end, b).otherwise(c)
        return bind(F.struct(year.alias("y"), month.alias("m"), day.alias("d"), flipped.alias("f")), dated)

    def dated(x: Column) -> Column:
        fits = x.y.between(1000, 9799) & x.m.between(1, 12) & (x.d >= 1)
        within = F.when(fits, x.d <= F.day(F.last_day(F.make_date(x.y, x.m, F.lit(1))))).otherwise(F.lit(False))
        return F.when(within, bind(F.date_diff(F.make_date(x.y, x.m, x.d), F.lit(FIRST_DAY).cast("date")), lambda n: moved(x, n))).otherwise(text)

    def moved(x: Column, n: Column) -> Column:
        rest = n % CYCLE
        parts = feistel(F.array(F.floor(rest / DATE_PARTS[1]).cast("int"), rest % DATE_PARTS[1]), F.array(*map(F.lit, DATE_PARTS)), key, F.concat_ws("-", F.lit("date"), (n - rest).cast("string")))
        day = bind(parts, lambda v: F.date_add(F.lit(FIRST_DAY).cast("date"), n - rest + F.get(v, F.lit(0)) * DATE_PARTS[1] + F.get(v, F.lit(1))))
        shown = F.when(point, "dd.MM.yyyy").when(slash_end & x.f, "dd/MM/yyyy").when(slash_end, "MM/dd/yyyy").when(text.contains("/"), "yyyy/MM/dd").otherwise("yyyy-MM-dd")
        y, m, d = (lambda v: F.year(v)), (lambda v: F.month(v)), (lambda v: F.day(v))
        return bind(F.struct(day.alias("day"), shown.alias("shown")), lambda v: F.when(v.shown == "dd.MM.yyyy", F.format_string("%02d.%02d.%04d", d(v.day), m(v.day), y(v.day)))
            .when(v.shown == "dd/MM/yyyy", F.format_string("%02d/%02d/%04d", d(v.day), m(v.day), y(v.day)))
            .when(v.shown == "MM/dd/yyyy", F.format_string("%02d/%02d/%04d", m(v.day), d(v.day), y(v.day)))
            .when(v.shown == "yyyy/MM/dd", F.format_string("%04d/%02d/%02d", y(v.day), m(v.day), d(v.day)))
            .otherwise(F.format_string("%04d-%02d-%02d", y(v.day), m(v.day), d(v.day))))

    return bind(numbers(text, "([0-9]+)"), permuted)


def new_email(text: Column, key: str) -> Column:
    """Letters and digits before the @, each within its class."""

    def permuted(name: Column) -> Column:
        codes = F.transform(F.regexp_extract_all(name, F.lit("([A-Za-z0-9])"), F.lit(1)), F.ascii)
        least = F.transform(codes, lambda c: F.when(c < 58, 48).when(c < 91, 65).otherwise(97))
        radix = F.transform(least, lambda c: F.when(c == 48, 10).otherwise(26))
        made = bind(radix, lambda r: feistel(F.zip_with(codes, least, lambda x, y: x - y), r, key, F.concat_ws("-", F.lit("email"), F.substring_index(text, "@", -1))))
        return refill(name, "[A-Za-z0-9]", F.zip_with(made, least, lambda x, y: F.char(x + y)))

    return F.concat(bind(F.substring_index(text, "@", 1), permuted), F.lit("@"), F.substring_index(text, "@", -1))


MAKERS = {"email": new_email, "date": new_date, "ssn": new_ssn, "ip": new_ip, "card": new_card, "phone": new_phone}


def kind_of(match: Column) -> Column:
    """The first kind whose whole pattern the match fits."""
    out = None
    for kind, pattern in PATTERNS.items():
        fits = match.rlike(rf"\A(?:{pattern})\z")
        out = F.when(fits, kind) if out is None else out.when(fits, kind)
    return out


def pseudonymise(docs: DataFrame, key: str, text: str = "text", into: str = "pseudonyms") -> DataFrame:
    """Adds the struct column `into`: text (with pseudonyms), found (kind and number of changed values of each kind).

    Card numbers (Luhn), phone numbers (ten digits in North American groups; 8 to 15 digits after +), IPv4 addresses (octets under
    256), social security numbers, calendar dates of the years 1000 to 9799 and the local parts of e-mail addresses
    are replaced under a keyed permutation of their own format: separators, lengths, check digits and validity stay, and
    one value has one pseudonym in every document, whatever its separators. A value may now and then be its own
    image, as in any permutation. What fails its check stays. Null texts give null; empty, long and repeated
    ones are ordinary; other columns, of any name, pass through, one named `into` is replaced.

    A projection without Python, and without a shuffle unless the table is very small (tables.spread()). Texts without a digit or @ skip the patterns; the work for a match is
    an expression over a few dozen characters."""
    docs, given = docs.drop(into), column(text)
    match_at, gap_at, new_at = unused([*docs.columns, into], "match", "gap", "new")
    body = F.when(given.rlike("[0-9@]"), given)
    split = spread(docs).withColumn(match_at, F.regexp_extract_all(body, F.lit(ANY), F.lit(0))).withColumn(gap_at, F.when(F.size(match_at) > 0, F.split(given, ANY, -1)))

    def changed(match: Column) -> Column:
        def of(kind: Column) -> Column:
            made = None
            for name, maker in MAKERS.items():
                value = maker(match, key)
                made = F.when(kind == name, value) if made is None else made.when(kind == name, value)
            return F.struct(kind.alias("kind"), F.coalesce(made, match).alias("text"))

        return bind(kind_of(match), of)

    new = split.withColumn(new_at, F.when(F.size(match_at) > 0, F.transform(match_at, changed)))
    joined = F.array_join(F.flatten(F.zip_with(gap_at, F.concat(F.transform(new_at, lambda x: x.text), F.array(F.lit(""))), lambda g, m: F.array(g, m))), "")
    moved = F.filter(F.zip_with(match_at, new_at, lambda m, x: F.when(m != x.text, x.kind)), lambda k: k.isNotNull())
    kinds = F.array(*map(F.lit, PATTERNS))
    found = bind(F.coalesce(moved, F.array().cast("array<string>")), lambda own: F.transform(kinds, lambda k: F.struct(k.alias("kind"), F.size(F.filter(own, lambda x: x == k)).cast("long").alias("n"))))
    out = F.struct(F.coalesce(joined, given).alias("text"), found.alias("found"))
    return new.withColumn(into, out).drop(match_at, gap_at, new_at)
