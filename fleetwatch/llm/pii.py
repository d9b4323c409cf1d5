"""Private data: validated numbers, dates and addresses become format-preserving keyed pseudonyms."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, functions as F

from .common import row_of

ROUNDS = 8

#: How each kind is written, in the order in which they are tried.
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@(?:[A-Za-z0-9-]{1,63}\.){1,126}[A-Za-z]{2,63}"
IP = r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?!\.?[0-9])"
YMD = r"(?<![0-9./-])(?:[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}|[0-9]{4}/[0-9]{1,2}/[0-9]{1,2}|[0-9]{4}\.[0-9]{1,2}\.[0-9]{1,2})(?![0-9])"
DMY = r"(?<![0-9./-])(?:[0-9]{1,2}-[0-9]{1,2}-[0-9]{4}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4})(?![0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
NANP = r"(?:\+1[ .-]?)?(?:\([0-9]{3}\) ?|(?<![0-9])[0-9]{3}[.-])[0-9]{3}[ .-][0-9]{4}(?![0-9])|(?<![0-9])(?<![0-9][ -])[2-9][0-9]{2} [2-9][0-9]{2} [0-9]{4}(?![ -]?[0-9])|\+1[ .-]?[0-9]{3}[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![0-9])"
#: Up to five groups where no more than 15 digits follow one another, else up to three: these never have more.
PHONE = r"\+(?:(?!(?:[ .-]?\(?[0-9]\)?){16})[2-9][0-9]{0,2}(?:[ .-]?\(?[0-9]{1,4}\)?){2,5}|[2-9][0-9]{0,2}(?:[ .-]?\(?[0-9]{1,4}\)?){2,3})(?![0-9])"
#: Calling codes of one and of two digits; all others have three.
ONE_DIGIT, TWO_DIGITS = r"^\+[17]", r"^\+(?:2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
CARD = r"(?<![0-9A-Za-z])[0-9](?:[ -]?[0-9]){12,18}(?![0-9A-Za-z])"
ANY = "|".join((EMAIL, IP, YMD, DMY, SSN, NANP, PHONE, CARD))
#: Groups of digits that a card may stand in, after a phone too, up to where another form begins; possessive, as a text may be one long run.
RUN = rf"(?<![0-9A-Za-z])(?:(?=[0-9](?:[ -]?[0-9]){{12}})|\+(?=[2-9](?:[ -]?[0-9]){{15}}))[0-9]++(?![A-Za-z])(?:(?:-|\x20(?!{EMAIL}|{IP}|{YMD}|{DMY}|{SSN}|{NANP}))[0-9]++(?![A-Za-z]))*+"
FIRST = "|".join((EMAIL, IP, YMD, DMY, SSN, NANP, RUN, PHONE))
#: How cards are grouped, as lengths; of those that begin at one place the first with a valid sum is taken.
SHAPES = ["4 4 4 4 3", "4 4 4 4", "4 3 3 3", "4 6 5", "4 6 4", "4 4 5", "6 13", *map(str, range(19, 12, -1))]

#: Dates permute within the 400 years from here: 146097 = 189 * 773 days.
FIRST_DAY, DAYS_LEFT, DAYS_RIGHT = "1800-01-01", 189, 773


def _let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x) with x evaluated once."""
    return F.get(F.transform(F.array(x), lambda y: f(y)), 0)


def _int(x: Column) -> Column:
    return x.try_cast("int")


def feistel(symbols: Column, radices: Column, key: str, tag: str) -> Column:
    """Keyed permutation of an array of ints, each below its radix: halves take turns in shifting each other."""

    def run(x: Column) -> Column:
        n = F.size(x["s"])
        h = F.floor(n / 2).cast("int")
        cut = lambda a: (F.slice(a, F.lit(1), h), F.slice(a, h + 1, n - h))
        (left, right), (left_radix, right_radix) = cut(x["s"]), cut(x["r"])

        def shifted(a, radix, other, r):
            mask = F.sha2(F.concat_ws("|", F.lit(key), F.lit(tag), r.cast("string"), n.cast("string"), F.array_join(other.cast("array<string>"), ",")), 512)
            part = lambda i: F.conv(mask.substr(F.pmod(i, F.lit(32)) * 4 + 1, F.lit(4)), 16, 10).cast("int")
            return F.transform(a, lambda v, i: F.pmod(v + part(i), F.get(radix, i)))

        step = lambda acc, r: F.when(r % 2 == 0, F.struct(shifted(acc["l"], left_radix, acc["r"], r).alias("l"), acc["r"].alias("r"))).otherwise(
            F.struct(acc["l"].alias("l"), shifted(acc["r"], right_radix, acc["l"], r).alias("r")))
        return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), F.struct(left.alias("l"), right.alias("r")), step, lambda acc: F.concat(acc["l"], acc["r"]))

    return _let(F.struct(symbols.alias("s"), radices.alias("r")), run)


def _digits(m: Column) -> Column:
    """Digits of a string as ints."""
    return F.transform(F.split(F.regexp_replace(m, "[^0-9]", ""), ""), lambda c: _int(c))


def _luhn(digits: Column) -> Column:
    """Sum by Luhn's rule, the last digit undoubled."""
    doubled = lambda d, i: F.when(i % 2 == 1, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)
    return F.aggregate(F.transform(F.reverse(digits), doubled), F.lit(0), lambda a, d: a + d)


def _written(m: Column, digits: Column) -> Column:
    """m with its digits replaced in turn."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("i"))
    return _let(digits, lambda ds: F.aggregate(F.split(m, ""), start, lambda acc, c: F.when(
        c.rlike("[0-9]"), F.struct(F.concat(acc["out"], F.get(ds, acc["i"]).cast("string")).alias("out"), (acc["i"] + 1).alias("i"))).otherwise(
        F.struct(F.concat(acc["out"], c).alias("out"), acc["i"].alias("i"))), lambda acc: acc["out"]))


def _card(m: Column, key: str) -> Column:
    def run(d):
        n = F.size(d)
        body = F.slice(d, F.lit(1), n - 1)
        fixed = F.transform(body, lambda v, i: F.when(i == 0, 0).otherwise(v))
        radix = F.transform(body, lambda v, i: F.when(i == 0, 1).otherwise(10))
        moved = F.transform(feistel(fixed, radix, key, "card"), lambda v, i: F.when(i == 0, F.get(d, 0)).otherwise(v))
        full = _let(moved, lambda p: F.concat(p, F.array(F.pmod(10 - _luhn(F.concat(p, F.array(F.lit(0)))) % 10, F.lit(10)))))
        return F.when((_luhn(d) % 10 == 0) & (F.aggregate(d, F.lit(0), lambda a, v: a + v) > 0), _written(m, full)).otherwise(m)

    return _let(_digits(m), run)


def _phone(m: Column, key: str, kept: Column) -> Column:
    """Digits after the first ``kept``; those from 2 stay so and the first two ones and zeros too, as area codes need."""
    def run(d):
        low = lambda v, i: F.when(i < kept, v).when((i == kept) & (v >= 2), F.lit(2)).otherwise(F.lit(0))
        radix = F.transform(d, lambda v, i: F.when(i < kept, 1).when((i == kept) & (v >= 2), 8).when(i == kept, 2).otherwise(10))
        moved = feistel(F.transform(d, lambda v, i: v - low(v, i)), radix, key, "phone")
        ok = (F.size(d) >= 8) & (F.size(d) <= 15)
        return F.when(ok, _written(m, F.transform(moved, lambda v, i: v + low(F.get(d, i), i)))).otherwise(m)

    return _let(_digits(m), run)


def _ip(m: Column, key: str) -> Column:
    def run(o):
        moved = feistel(o, F.array_repeat(F.lit(256), 4), key, "ip")
        return F.when(F.forall(o, lambda v: v < 256), F.array_join(moved.cast("array<string>"), ".")).otherwise(m)

    return _let(F.transform(F.split(m, r"\."), _int), run)


def _ssn(m: Column, key: str) -> Column:
    def run(p):
        area, group, serial = (F.get(p, i) for i in range(3))
        ok = (area > 0) & (area < 900) & (area != 666) & (group > 0) & (serial > 0)
        symbols = F.array(area - 1 - F.when(area > 666, 1).otherwise(0), group - 1, serial - 1)
        moved = feistel(symbols, F.array(F.lit(898), F.lit(99), F.lit(9999)), key, "ssn")
        text = _let(moved, lambda q: F.format_string("%03d-%02d-%04d", F.get(q, 0) + 1 + F.when(F.get(q, 0) >= 665, 1).otherwise(0), F.get(q, 1) + 1, F.get(q, 2) + 1))
        return F.when(ok, text).otherwise(m)

    return _let(F.transform(F.split(m, "-"), _int), run)


def _date(m: Column, key: str, year_first: bool) -> Column:
    """Year, month, day; day, month, year; or month, day, year where only that is a date. Widths and marks stay where they can."""
    def moved(parts, mark, field, day):
        n = F.date_diff(day, F.lit(FIRST_DAY).cast("date"))
        pair = feistel(F.array(F.floor(n / DAYS_RIGHT).cast("int"), F.pmod(n, F.lit(DAYS_RIGHT))), F.array(F.lit(DAYS_LEFT), F.lit(DAYS_RIGHT)), key, "date")
        new = _let(pair, lambda q: F.date_add(F.lit(FIRST_DAY).cast("date"), F.get(q, 0) * DAYS_RIGHT + F.get(q, 1)))

        def text(x):
            padded = lambda i: F.lpad(field[i](x).cast("string"), 4 if field[i] is F.year else 2, "0")
            a, b, c = (F.when(F.length(parts[i]) > 1, padded(i)).otherwise(field[i](x).cast("string")) for i in range(3))
            return F.concat(a, mark, b, mark, c)

        return F.when((n >= 0) & (n < DAYS_LEFT * DAYS_RIGHT), _let(new, text)).otherwise(m)

    def run(p):
        parts = [F.get(p, i) for i in range(3)]
        date = lambda y, mo, d: F.try_to_date(F.concat_ws("-", F.lpad(y, 4, "0"), F.lpad(mo, 2, "0"), F.lpad(d, 2, "0")), "yyyy-MM-dd")
        orders = [(0, 1, 2)] if year_first else [(2, 1, 0), (2, 0, 1)]
        out = m
        mark = F.regexp_extract(m, "[-/.]", 0)
        for y, mo, d in reversed(orders):
            day = date(parts[y], parts[mo], parts[d])
            out = F.when(day.isNotNull(), _let(day, partial(moved, parts, mark, {y: F.year, mo: F.month, d: F.day}))).otherwise(out)
        return out

    return _let(F.split(m, "[-/.]"), run)


def _email(m: Column, key: str) -> Column:
    def run(c):
        base = lambda v: F.when(v.between(97, 122), 97).when(v.between(65, 90), 65).when(v.between(48, 57), 48).otherwise(v)
        radix = lambda v: F.when(v.between(97, 122) | v.between(65, 90), 26).when(v.between(48, 57), 10).otherwise(1)
        moved = feistel(F.transform(c, lambda v: v - base(v)), F.transform(c, radix), key, "email")
        return F.concat(F.array_join(F.transform(moved, lambda v, i: F.char(v + base(F.get(c, i)))), ""), F.lit("@"), F.substring_index(m, "@", -1))

    return _let(F.transform(F.split(F.substring_index(m, "@", 1), ""), F.ascii), run)


TOKEN = "array<struct<t:string,form:boolean>>"


def _token(t: Column, form: bool) -> Column:
    return F.array(F.struct(t.alias("t"), F.lit(form).alias("form")))


def _tokens(text: Column, pattern: str, each: Callable[[Column], Column]) -> Column:
    """The text between the pattern's places, as it is, and what ``each`` makes of those places, in turn."""
    between, found = F.split(text, F.lit(pattern), -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = F.zip_with(between, F.transform(found, each), lambda a, b: F.concat(_token(a, False), F.coalesce(b, F.array().cast(TOKEN))))
    return F.flatten(parts)


def _cards(m: Column) -> Column:
    """Tokens of a run of digit groups: cards of the usual shapes with a valid sum; what is left is searched by ANY."""
    def run(g):
        def groups_at(i):  # of the first shape that fits and has a valid sum
            def fits(shape):
                n = len(shape.split())
                here = F.slice(g, i + 1, F.lit(n))
                lengths = F.array_join(F.transform(here, lambda x: F.length(x).cast("string")), " ")
                return (lengths == shape) & _let(_digits(F.array_join(here, "")), lambda d: (_luhn(d) % 10 == 0) & F.exists(d, lambda v: v > 0))

            shape = F.filter(F.array(*(F.when(fits(x), len(x.split())) for x in SHAPES)), lambda n: n.isNotNull())
            return F.when(F.length(F.get(g, i)).isin(4, 6, *range(13, 20)), F.coalesce(F.get(shape, F.lit(0)), F.lit(0))).otherwise(0)

        def step(acc, i):
            def placed(n):
                size = F.aggregate(F.slice(g, i + 1, n), n - 1, lambda a, x: a + F.length(x))
                taken = F.concat(acc["out"], _token(F.substring(m, acc["done"] + 1, acc["at"] - acc["done"]), False), _token(F.substring(m, acc["at"] + 1, size), True))
                return F.struct(F.when(n > 0, taken).otherwise(acc["out"]).alias("out"), F.when(n > 0, acc["at"] + size).otherwise(acc["done"]).alias("done"),
                                F.when(n > 0, i + n).otherwise(acc["next"]).alias("next"), (acc["at"] + F.length(F.get(g, i)) + 1).alias("at"))

            return _let(F.when(i < acc["next"], 0).otherwise(groups_at(i)), placed)

        start = F.struct(F.array().cast(TOKEN).alias("out"), F.lit(0).alias("done"), F.lit(0).alias("next"), F.lit(0).alias("at"))
        return F.aggregate(F.sequence(F.lit(0), F.size(g) - 1), start, step, lambda acc: F.concat(acc["out"], _token(F.substring(m, acc["done"] + 1, F.length(m)), False)))

    shaped = "|".join(" ".join(f"[0-9]{{{n}}}" for n in x.split()).replace(" ", "[ -]") for x in SHAPES)
    pieces = F.when(m.rlike(f"(?<![0-9])(?:{shaped})(?![0-9])"), _let(F.split(m, "[ -]"), run)).otherwise(_token(m, False))
    return F.flatten(F.transform(pieces, lambda p: F.when(p["form"], F.array(p)).otherwise(_tokens(p["t"], ANY, lambda x: _token(x, True)))))


def pseudonym(m: Column, key: str) -> Column:
    """The pseudonym of one found string; itself where it isn't valid."""
    whole = lambda p: m.rlike(f"^(?:{p})$")
    nanp = F.when(m.startswith("+"), 1).otherwise(0)
    return (F.when(m.contains("@"), _email(m, key)).when(whole(IP), _ip(m, key)).when(whole(YMD), _date(m, key, True)).when(whole(DMY), _date(m, key, False))
            .when(whole(SSN), _ssn(m, key)).when(whole(NANP), _phone(m, key, nanp)).when(whole(PHONE), _phone(m, key, F.when(m.rlike(ONE_DIGIT), 1).when(m.rlike(TWO_DIGITS), 2).otherwise(3))).otherwise(_card(m, key)))


def pseudonymize(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """Replace private numbers, dates and addresses in every whole text.

    Returns ``row`` (all input columns), ``safe_text``, ``n_found`` (strings of
    a known form) and ``n_replaced`` (those valid and changed), one row per
    input row. A value becomes the same pseudonym wherever it stands and in
    whatever grouping, and no two values of a form share one: cards keep their
    first digit, length and check sum, phones their calling code, addresses their
    range, dates are days of 1800 to 2199, mail keeps its domain. Forms that
    fail their check (sum, range, calendar) stay. Null stays null, empty stays
    empty; repeated rows are treated alike; an empty table gives an empty
    result; other columns pass through under any name.

    Mail domains have up to 126 labels of up to 63 characters before the last.
    Work grows with the text however it is written: no rule repeats a group
    without bound or looks back over a run of characters.

    The key is a literal of the plan: keep event logs private.
    """
    out = docs.select(row_of(docs).alias("row"), F.col(f"`{text_col}`").alias("text"))
    each = lambda m: F.when(m.rlike(r"^(?:[0-9][0-9 -]*|\+(?:[ -]?[0-9]){16}[0-9 -]*)$"), _cards(m)).otherwise(_token(m, True))
    out = out.withColumn("tokens", F.when(F.col("text").rlike("[0-9@]"), _tokens(F.col("text"), FIRST, each)))
    out = out.withColumn("some", F.exists(F.coalesce("tokens", F.array().cast(TOKEN)), lambda x: x["form"]))
    out = out.withColumn("new", F.when(F.col("some"), F.transform("tokens", lambda x: F.when(x["form"], pseudonym(x["t"], key)).otherwise(x["t"]))))
    found = F.size(F.filter("tokens", lambda x: x["form"]))
    changed = F.size(F.filter(F.zip_with("tokens", "new", lambda a, b: a["t"] != b), lambda x: x))
    return out.select("row", F.when(F.col("some"), F.array_join("new", "")).otherwise(F.col("text")).alias("safe_text"),
                      F.when(F.col("some"), found).otherwise(0).cast("long").alias("n_found"),
                      F.when(F.col("some"), changed).otherwise(0).cast("long").alias("n_replaced"))
