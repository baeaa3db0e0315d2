"""Format-preserving pseudonyms of personal data, with DataFrame functions only.

A value that passes the validation of its kind becomes two numbers (left,
right) of a product domain that holds exactly the valid values of its format.
A keyed Feistel network of ten rounds permutes that domain, and the result is
poured back into the format. The key alone decides, so equal values get equal
pseudonyms in all documents, whatever their separators.

==========  =============================================  ==========================
kind        validation                                     domain
==========  =============================================  ==========================
card        13 to 19 digits, Luhn; where all of a run do   all digits but the last,
            not pass, its longest start up to a separator  which is recomputed
phone       North American, area and exchange from 200;    800 x 8,000,000; of others
            or + and 8 to 15 digits                        all digits but the first two
ssn         no 000, 666, 9xx area, 00 group, 0000 serial   898 * 99 x 9,999
ipv4        four numbers to 255                            65,536 x 65,536
iban        mod 97, check digits 02 to 98                  letters and digits behind
                                                           the check digits, which are
                                                           recomputed
date        a day of the Gregorian calendar, years 1800    see below
            to 2199; y-m-d, d.m.y, m/d/y or else d/m/y
email       a local part, @ and a domain name              letters and digits of the
                                                           local part, each in its
                                                           class
secret      AKIA key ids; values after names that end in   as email
            password, passwd, token, api_key, secret_key
            or access_key and = or :, after secret and =,
            after authorization: bearer or basic, in any
            case, of any length, quoted or not
==========  =============================================  ==========================

Dates with two digits for day and month share one network over the 146,097
days of a Gregorian cycle, so y-m-d, d.m.y and m/d/y of a day stay linked.
A slash date that reads day first only, whose day is over 12, moves among such
dates, and a date with one digit for day or month among those with as many
digits; there a 29 February becomes one of another leap year. So two texts of
one format never get the same pseudonym. A named secret that is all of another
kind, such as an e-mail address, is treated as that kind.

Numbers that fail their validation stay as they are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.llm.shared import plain_names

ROUNDS = 10
OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
NAME = r"""(?i:password|passwd|token|(?:api|secret|access)[_-]?key|secret(?=["']?[ \t]*+=))"""
NAMED = rf"""{NAME}["']?[ \t]*+[:=]"""
HEAD = rf"""(?:{NAMED}[ \t]*+["']?|(?i:authorization)["']?[ \t]*+[:=][ \t]*+["']?(?i:bearer|basic)[ \t]++|AKIA(?=[A-Z0-9]{16}$))"""
VALUE = rf"""{NAMED}[ \t]*+(?:"[^"\r\n]++(?=")|'[^'\r\n]++(?=')|["']?[^\s"'=,;][^\s"',;]*+)"""
BEARER = r"""(?i:authorization)["']?[ \t]*+[:=][ \t]*+["']?(?i:bearer|basic)[ \t]++[A-Za-z0-9._~+/=-]++"""
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9](?:[A-Za-z0-9-]{0,62}\.)+[A-Za-z]{2,24}",
    "secret": rf"(?<![A-Za-z0-9])AKIA[A-Z0-9]{{16}}(?![A-Za-z0-9])|{VALUE}|{BEARER}",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ipv4": rf"(?<![\d.])(?:{OCTET}\.){{3}}{OCTET}(?!\d|\.\d)",
    "date": r"(?<![\d./-])(?:\d{4}-\d{2}-\d{2}|\d{1,2}\.\d{1,2}\.\d{4}|\d{1,2}/\d{1,2}/\d{4})(?![\d/-]|\.\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "phone": r"(?<![\d(+])(?:\+?1[ .-]?)?(?:\([2-9]\d{2}\) ?|[2-9]\d{2}[ .-])[2-9]\d{2}[ .-]\d{4}(?!\d)|(?<![\d+])\+\d(?:[ .()-]{0,2}\d){7,14}(?!\d)",
    "card": r"(?<![\d.])\d(?:[ -]?\d){12,18}(?![\d]|\.\d)",
}
NUMBERS = ("ipv4", "date", "ssn", "phone", "card")
#: One look at a character tells whether a number can begin there.
ANY = "|".join([*(f"(?:{PATTERNS[k]})" for k in ("email", "secret", "iban")), rf"(?=[\d(+])(?:{'|'.join(f'(?:{PATTERNS[k]})' for k in NUMBERS)})"])
MARK, ESCAPED = "\x01\x02", "\x01\x03"
MONTH_DAYS = (31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31)
LEAP_YEARS = tuple(y for y in range(1800, 2200) if y % 4 == 0 and (y % 100 or y % 400 == 0))
ORIGIN = "1800-01-01"  # first of the 146,097 days of a Gregorian cycle


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, r"\D", "")


Key = str | Column


def _keyed(key: Key, *parts: Column, bits: int = 256) -> Column:
    return F.sha2(F.concat_ws("|", key if isinstance(key, Column) else F.lit(key), *parts), bits)


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def _numbers(values: Iterable[int]) -> Column:
    return F.expr(f"array({', '.join(map(str, values))})")


def _number(hexadecimal: Column) -> Column:
    return F.conv(hexadecimal, 16, 10).cast("bigint")


def feistel(key: Key, tweak: Column, left: Column, right: Column, a: Column, b: Column) -> Column:
    """A keyed permutation of the pairs (left < a, right < b), as a struct of l and r."""

    def turn(acc: Column, i: Column) -> Column:
        odd = i % 2 == 1
        other = F.when(odd, acc["r"]).otherwise(acc["l"])
        noise = _number(F.substring(_keyed(key, tweak, i.cast("string"), other.cast("string")), 1, 15))
        return F.struct(
            F.when(odd, (acc["l"] + noise) % a).otherwise(acc["l"]).cast("bigint").alias("l"),
            F.when(odd, acc["r"]).otherwise((acc["r"] + noise) % b).cast("bigint").alias("r"),
        )

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), F.struct(left.cast("bigint").alias("l"), right.cast("bigint").alias("r")), turn)


def feistel_text(key: Key, value: Column) -> Column:
    """Letters and digits of a text moved within their class by the same kind of network; other characters stay."""

    def shifted(half: Column, noise: Column) -> Column:
        def one(c: Column, p: Column) -> Column:
            code = F.ascii(c)
            k = F.conv(F.element_at(noise, F.floor(p / 32).cast("int") + 1).substr(p % 32 * 4 + 1, F.lit(4)), 16, 10).cast("int")
            moved = (
                F.when(code.between(48, 57), (code - 48 + k) % 10 + 48)
                .when(code.between(65, 90), (code - 65 + k) % 26 + 65)
                .when(code.between(97, 122), (code - 97 + k) % 26 + 97)
            )
            return F.when(moved.isNull(), c).otherwise(F.char(moved))

        return F.when(F.length(half) > 0, F.array_join(F.transform(F.split(half, ""), one), "")).otherwise(F.lit(""))

    def moved(i: Column, half: Column, other: Column) -> Column:
        blocks = F.sequence(F.lit(0), F.greatest(F.floor((F.length(half) - 1) / 32), F.lit(0)).cast("int"))  # 32 characters each
        seed = _keyed(key, F.lit("text"), i.cast("string"), other, bits=512)
        noise = _once(seed, lambda z: F.transform(blocks, lambda b: F.sha2(F.concat_ws("|", z, b.cast("string")), 512)))
        return _once(noise, lambda z: shifted(half, z))

    def turn(acc: Column, i: Column) -> Column:
        odd = i % 2 == 1
        return F.struct(F.when(odd, moved(i, acc["l"], acc["r"])).otherwise(acc["l"]).alias("l"), F.when(odd, acc["r"]).otherwise(moved(i, acc["r"], acc["l"])).alias("r"))

    middle = (F.length(value) / 2).cast("int")
    halves = F.struct(F.substring(value, F.lit(1), middle).alias("l"), value.substr(middle + 1, F.length(value)).alias("r"))
    done = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), halves, turn)
    return F.concat(done["l"], done["r"])


def luhn_digit(payload: Column) -> Column:
    """The check digit that makes payload + digit pass the Luhn test."""

    def weighed(p: Column) -> Column:
        d = F.reverse(payload).substr(p, F.lit(1)).cast("int")
        return F.when(p % 2 == 1, F.when(d > 4, d * 2 - 9).otherwise(d * 2)).otherwise(d)

    total = F.aggregate(F.transform(F.sequence(F.lit(1), F.length(payload)), weighed), F.lit(0), lambda s, d: s + d)
    return ((10 - total % 10) % 10).cast("string")


def pour(digits: Column, format_: Column) -> Column:
    """The format with its digits replaced, in order, by the given digits."""

    def one(p: Column) -> Column:
        c = format_.substr(p, F.lit(1))
        return F.when(c.between("0", "9"), digits.substr(F.length(_digits(format_.substr(F.lit(1), p))), F.lit(1))).otherwise(c)

    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(format_)), one), "")


def _power(n: Column) -> Column:
    return F.rpad(F.lit("1"), n + 1, "0").cast("bigint")


# A kind of number has a domain, as a struct or null where the value is not valid, and writes a moved place of it.


def _place(tweak: Column | str, left: Column, right: Column, a, b, note: Column | None = None) -> Column:
    named = {"tweak": F.lit(tweak) if isinstance(tweak, str) else tweak, "note": F.lit(None).cast("string") if note is None else note}
    numbers = {k: (F.lit(v) if isinstance(v, int) else v).cast("bigint") for k, v in (("l", left), ("r", right), ("a", a), ("b", b))}
    return F.struct(*(c.alias(k) for k, c in (named | numbers).items()))


def _halves(tweak: str, digits: Column, note: Column) -> Column:
    """The domain of all numbers of as many digits."""
    n = F.length(digits)
    u = (n / 2).cast("int")
    return _place(F.concat(F.lit(tweak), n.cast("string")), F.left(digits, u), F.right(digits, n - u), _power(u), _power(n - u), note)


def _padded(at: Column) -> Column:
    """The digits of a place of such a domain."""
    return F.concat(F.lpad(at["l"].cast("string"), F.length(at["a"].cast("string")) - 1, "0"), F.lpad(at["r"].cast("string"), F.length(at["b"].cast("string")) - 1, "0"))


def _card(m: Column) -> Column:
    def passes(start: Column) -> Column:
        return _once(_digits(start), lambda d: F.length(d).between(13, 19) & (luhn_digit(d.substr(F.lit(1), F.length(d) - 1)) == F.right(d, F.lit(1))))

    ends = F.filter(F.sequence(F.length(m), F.lit(13), F.lit(-1)), lambda p: (p == F.length(m)) | m.substr(p + 1, F.lit(1)).isin(" ", "-"))
    start = F.get(F.filter(F.transform(ends, lambda p: m.substr(F.lit(1), p)), passes), F.lit(0))
    return _once(start, lambda s: F.when(s.isNotNull(), _once(_digits(s), lambda d: _halves("card", d.substr(F.lit(1), F.length(d) - 1), s))))


def _card_text(m: Column, at: Column) -> Column:
    return F.concat(_once(_padded(at), lambda d: pour(F.concat(d, luhn_digit(d)), at["note"])), m.substr(F.length(at["note"]) + 1, F.length(m)))


def _phone(m: Column) -> Column:
    def place(digits: Column) -> Column:
        ten = F.right(digits, F.lit(10))
        here = _place("phone", F.left(ten, F.lit(3)).cast("bigint") - 200, F.right(ten, F.lit(7)).cast("bigint") - 2_000_000, 800, 8_000_000, F.left(digits, F.length(digits) - 10))
        abroad = F.left(digits, F.lit(2))
        is_here = digits.rlike("^1?[2-9][0-9]{2}[2-9][0-9]{6}$") & (~m.startswith("+") | digits.startswith("1"))
        # a +1 that no North American number follows stays
        return F.when(is_here, here).when(~digits.startswith("1"), _once(F.right(digits, F.length(digits) - 2), lambda d: _halves("phone abroad", d, abroad).withField("tweak", F.concat(F.lit("phone "), abroad, F.length(d).cast("string")))))

    return _once(_digits(m), place)


def _phone_text(m: Column, at: Column) -> Column:
    here = F.concat((at["l"] + 200).cast("string"), (at["r"] + 2_000_000).cast("string"))
    return pour(F.concat(at["note"], F.when(at["tweak"] == "phone", here).otherwise(_padded(at))), m)


def _ssn(m: Column) -> Column:
    area, group, serial = (F.substring(m, a, n).cast("bigint") for a, n in ((1, 3), (5, 2), (8, 4)))
    place = area - F.when(area > 666, 2).otherwise(1)
    return F.when(area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0), _place("ssn", place * 99 + group - 1, serial - 1, 898 * 99, 9999))


def _ssn_text(m: Column, at: Column) -> Column:
    area = F.floor(at["l"] / 99) + 1
    area = area + F.when(area >= 666, 1).otherwise(0)
    return F.concat_ws("-", *(F.lpad(x.cast("string"), n, "0") for x, n in ((area, 3), (at["l"] % 99 + 1, 2), (at["r"] + 1, 4))))


def _ipv4(m: Column) -> Column:
    part = [F.split(m, r"\.")[k].cast("bigint") for k in range(4)]
    return _place("ipv4", part[0] * 256 + part[1], part[2] * 256 + part[3], 65536, 65536)


def _ipv4_text(m: Column, at: Column) -> Column:
    return F.concat_ws(".", *(x.cast("string") for half in ("l", "r") for x in (F.floor(at[half] / 256), at[half] % 256)))


#: Formats of dates other than two digits for day and month: months up to, days from, days to.
DATE_CLASSES = {"late 2": (12, 13, 31), "late 1": (9, 13, 31), "2 1": (12, 1, 9), "1 1": (9, 1, 9), "1 2": (9, 1, 31)}


def _days(which: Column) -> Column:
    """The days of a class, without 29 February, as month * 100 + day."""
    chosen = None
    for name, (months, low, high) in DATE_CLASSES.items():
        days = _numbers(a * 100 + b for a in range(1, months + 1) for b in range(low, min(high, MONTH_DAYS[a - 1]) + 1))
        chosen = (F if chosen is None else chosen).when(which == name, days)
    return chosen


def _date(m: Column) -> Column:
    def read(part: Column) -> Column:
        iso, dotted = m.contains("-"), m.contains(".")
        late = ~iso & ~dotted & (part[0].cast("int") > 12)
        day, month = F.when(iso, part[2]).when(dotted | late, part[0]).otherwise(part[1]), F.when(iso | dotted | late, part[1]).otherwise(part[0])
        year = F.when(iso, part[0]).otherwise(part[2])
        digits = F.concat(F.length(month).cast("string"), F.lit(" "), F.length(day).cast("string"))
        which = F.when(late, F.concat(F.lit("late "), F.length(month).cast("string"))).when(digits == "2 2", "any").otherwise(digits)
        return F.struct(year.cast("int").alias("y"), month.cast("int").alias("m"), day.cast("int").alias("d"), which.alias("which"), F.when(dotted, ".").otherwise("/").alias("sign"))

    def place(t: Column) -> Column:
        y, month, d = t["y"], t["m"], t["d"]
        leap_day = (month == 2) & (d == 29)
        longest = F.element_at(_numbers(MONTH_DAYS), F.when(month.between(1, 12), month).otherwise(1))
        valid = y.between(1800, 2199) & month.between(1, 12) & (d >= 1) & ((d <= longest) | (leap_day & F.array_contains(_numbers(LEAP_YEARS), y)))
        iso = F.concat_ws("-", F.lpad(y.cast("string"), 4, "0"), F.lpad(month.cast("string"), 2, "0"), F.lpad(d.cast("string"), 2, "0"))
        any_day = _once(F.datediff(F.try_to_date(iso, "yyyy-MM-dd"), F.lit(ORIGIN).cast("date")), lambda nth: _place("date", F.floor(nth / 773), nth % 773, 189, 773, t["which"]))
        leap = _place("leap day", F.array_position(_numbers(LEAP_YEARS), y) - 1, F.lit(0), len(LEAP_YEARS), 1, F.lit("leap day"))
        same = _once(_days(t["which"]), lambda days: _place(F.concat_ws(" ", F.lit("date"), t["which"], t["sign"]), F.array_position(days, month * 100 + d) - 1, y - 1800, F.size(days), 400, t["which"]))
        return F.when(valid, F.when(t["which"] == "any", any_day).when(leap_day, leap).otherwise(same))

    return _once(_once(F.split(m, "[-./]"), read), place)


def _date_text(m: Column, at: Column) -> Column:
    """Day, month and year in the order and with the digits of ``m``."""
    day = F.date_add(F.lit(ORIGIN).cast("date"), (at["l"] * 773 + at["r"]).cast("int"))
    any_day = F.struct(F.year(day).alias("y"), F.month(day).alias("m"), F.day(day).alias("d"))
    leap = F.struct(F.element_at(_numbers(LEAP_YEARS), (at["l"] + 1).cast("int")).alias("y"), F.lit(2).alias("m"), F.lit(29).alias("d"))
    same = _once(F.element_at(_days(at["note"]), (at["l"] + 1).cast("int")), lambda md: F.struct((at["r"] + 1800).cast("int").alias("y"), F.floor(md / 100).cast("int").alias("m"), (md % 100).alias("d")))

    def written(t: Column, part: Column) -> Column:
        iso, dotted = m.contains("-"), m.contains(".")
        day_first = dotted | (part[0].cast("int") > 12)
        sign = F.when(iso, "-").when(dotted, ".").otherwise("/")
        numbers = F.when(iso, F.array(t["y"], t["m"], t["d"])).when(day_first, F.array(t["d"], t["m"], t["y"])).otherwise(F.array(t["m"], t["d"], t["y"]))
        return F.concat_ws("", *(x for k in range(3) for x in ([sign] if k else []) + [F.lpad(numbers[k].cast("string"), F.length(part[k]), "0")]))

    return _once(F.when(at["note"] == "any", any_day).when(at["note"] == "leap day", leap).otherwise(same), lambda t: _once(F.split(m, "[-./]"), lambda part: written(t, part)))


#: Kinds of numbers: the domain of a value, and its text at another place.
NUMBER_KINDS = {"card": (_card, _card_text), "phone": (_phone, _phone_text), "ssn": (_ssn, _ssn_text), "ipv4": (_ipv4, _ipv4_text), "date": (_date, _date_text)}


def iban_rest(body: Column, country: Column, check: Column) -> Column:
    """The remainder by 97 of the number that the rearranged IBAN stands for; 1 for a right one."""

    def more(r: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code < 65, (r * 10 + code - 48) % 97).otherwise((r * 100 + code - 55) % 97).cast("int")

    return F.aggregate(F.split(F.concat(body, country, check), ""), F.lit(0), more)


def _text_part(m: Column, which: Column) -> Column:
    """What moves of an e-mail address, IBAN or secret; null where it is not valid."""

    def iban(compact: Column) -> Column:
        check, body = compact.substr(F.lit(3), F.lit(2)), compact.substr(F.lit(5), F.length(compact))
        return F.when(check.between("02", "98") & (iban_rest(body, F.left(compact, F.lit(2)), check) == 1), body)

    return F.when(which == "email", F.substring_index(m, "@", 1)).when(which == "iban", _once(F.replace(m, F.lit(" ")), iban)).when(which == "secret", m)


def _with_text(m: Column, which: Column, new: Column) -> Column:
    """The value with that part replaced."""
    country = F.left(m, F.lit(2))
    check = F.lpad((98 - iban_rest(new, country, F.lit("00"))).cast("string"), 2, "0")

    def spaced(compact: Column) -> Column:
        def one(p: Column) -> Column:
            return F.when(m.substr(p, F.lit(1)) == " ", " ").otherwise(compact.substr(F.length(F.replace(m.substr(F.lit(1), p), F.lit(" "))), F.lit(1)))

        return F.array_join(F.transform(F.sequence(F.lit(1), F.length(m)), one), "")

    return F.when(which == "email", F.concat(new, F.lit("@"), F.substring_index(m, "@", -1))).when(which == "iban", _once(F.concat(country, check, new), spaced)).otherwise(new)


def kind(m: Column) -> Column:
    """The kind of a match or value, by the first pattern that covers all of it."""
    found = F.lit(None).cast("string")
    for name in ("card", "phone", "ssn", "date", "ipv4", "iban", "email"):
        # look-arounds have been met in the text; here the match stands alone
        found = F.when(m.rlike(rf"^(?:{PATTERNS[name]})$"), F.lit(name)).otherwise(found)
    return F.coalesce(found, F.lit("secret"))


def _chosen(which: Column, of: Callable[[str], Column]) -> Column:
    chosen = None
    for name in NUMBER_KINDS:
        chosen = (F if chosen is None else chosen).when(which == name, of(name))
    return chosen


def pseudonymise(docs: DataFrame, key: str | DataFrame, text_col: str = "text") -> DataFrame:
    """``docs``, every column, with the text's personal data replaced, and ``_n_replaced``.

    A key given as text is a literal of the plan, which logs show. A key in a
    table of one row and one column, such as one read from a protected file,
    is not; another number of rows is an error.
    A null text stays null and counts 0. Rows are independent: repeated rows
    give repeated results, and an empty table an empty one.
    """
    plain, names, at = plain_names(docs, ("_n_replaced",))
    text = F.col(at[text_col]).cast("string")
    likely = text.rlike(r"[0-9][0-9 .()/-]{6}") | text.rlike(rf"{NAMED}|(?i:authorization)")
    for sign in ("@", "AKIA", "+"):
        likely = likely | text.contains(sign)
    if isinstance(key, DataFrame):
        (column,) = key.columns
        one = F.when(F.count(F.lit(1)) == 1, F.first(F.col(f"`{column}`").cast("string"))).otherwise(F.raise_error(F.lit("one key is needed")))
        key, keyed = F.col("_key"), plain.crossJoin(F.broadcast(key.agg(one.alias("_key"))))  # one row
    else:
        keyed = plain
    # one column a step, so that no step is worked out twice; one pass of the patterns marks both ends of every match
    escaped = F.when(text.contains("\x01"), F.replace(text, F.lit("\x01"), F.lit(ESCAPED))).otherwise(text)
    parts = F.split(F.regexp_replace(escaped, ANY, f"{MARK}$0{MARK}"), MARK, -1)
    out = keyed.withColumn("_parts", F.when(likely, parts)).withColumn("_parts", F.when(F.size("_parts") > 1, F.transform("_parts", lambda x: F.replace(x, F.lit(ESCAPED), F.lit("\x01")))))
    out = out.withColumn("_head", F.transform("_parts", lambda x, k: F.when(k % 2 == 1, F.regexp_extract(x, f"^{HEAD}", 0))))
    out = out.withColumn("_value", F.zip_with("_parts", "_head", lambda x, h: F.when(h.isNotNull(), x.substr(F.length(h) + 1, F.length(x)))))
    out = out.withColumn("_kind", F.zip_with("_value", "_head", lambda v, h: F.when(h == "AKIA", "secret").when(v.isNotNull(), kind(v))))
    places = F.zip_with("_value", "_kind", lambda v, which: F.when(v.isNotNull(), _chosen(which, lambda name: NUMBER_KINDS[name][0](v))))
    out = out.withColumn("_place", places)
    moved = F.transform("_place", lambda t: F.when(t.isNotNull(), _once(feistel(key, t["tweak"], t["l"], t["r"], t["a"], t["b"]), lambda n: t.withField("l", n["l"]).withField("r", n["r"]))))
    out = out.withColumn("_moved", moved)
    parts = F.transform(F.zip_with("_value", "_kind", lambda v, which: F.when(v.isNotNull(), _text_part(v, which))), lambda t: F.when(t.isNotNull(), feistel_text(key, t)))
    out = out.withColumn("_text", parts)
    kinds = F.arrays_zip("_value", "_kind", "_moved", "_text")

    def fresh(x: Column) -> Column:
        number = _chosen(x["_kind"], lambda name: NUMBER_KINDS[name][1](x["_value"], x["_moved"]))
        return F.coalesce(F.when(x["_moved"].isNotNull(), number).when(x["_text"].isNotNull(), _with_text(x["_value"], x["_kind"], x["_text"])), x["_value"])

    out = out.withColumn("_fresh", F.transform(kinds, fresh))
    whole = F.zip_with("_parts", F.zip_with("_head", "_fresh", lambda h, f: F.concat(h, f)), lambda x, f: F.coalesce(f, x))
    changed = F.size(F.filter(F.zip_with("_value", "_fresh", lambda v, f: f != v), lambda x: x))
    replaced = F.when(F.col("_parts").isNull(), text).otherwise(F.array_join(whole, ""))
    count = F.when(F.col("_parts").isNull(), F.lit(0)).otherwise(changed)
    return out.withColumns({at[text_col]: replaced, "_n_replaced": count}).select(*plain.columns, "_n_replaced").toDF(*names, "_n_replaced")
