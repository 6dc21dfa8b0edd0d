"""Format-preserving pseudonyms for private values in text.

A value is found by its format and replaced only if it is valid: payment cards
and bank accounts by their check digits, telephone and social security numbers
and network addresses by their ranges, dates by the calendar, also in a time stamp.  Its digits are
taken as a pair of numbers and permuted by a keyed Feistel network, in which
each round adds a keyed digest of one half to the other half, modulo that
half's range.  So the permutation stays inside the format: the pseudonym is
valid again, has the same punctuation, and equal values get equal pseudonyms
in every document, however they are punctuated.  The letters and digits of the
local part of a mail address are permuted the same way, each within its
alphabet; letters of alphabets that ALPHABETS does not list stay.  Not looked
for are national telephone numbers outside the American plan, addresses of
IP version 6 and mail domains of more than 127 labels or other than ASCII.

Every place where a format starts is looked at from left to right: the first
format with a valid value there, the longest of several, is replaced and the
search goes on behind it.  What is not valid is passed over by its first
character only, so values that stand next to each other do not hide each other.

Everything is an expression on one row, and nothing is shuffled.  A null text
stays null, an empty text empty, an empty table gives no rows.  Invalid
look-alikes and all other text stay as they are.  Texts are read whole, however
long; the formats have bounded repetitions, so that no text is too deep for
them.  Repeated rows get equal results, and working columns get names that the
table does not have.  The key is a literal of the plan, so plans
and event logs must be kept as the key is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shopgrain.llm.columns import let, named, own

ROUNDS = 10

# The formats, in the order in which they are tried.
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
FORMATS = {
    "mail": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}][\p{L}\p{N}._%+-]{0,63}@(?:[A-Za-z0-9-]{1,63}\.){1,126}[A-Za-z]{2,24}",
    "iban": r"(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
    "address": rf"(?<![\p{{L}}\p{{N}}.]){_OCTET}(?:\.{_OCTET}){{3}}(?![\p{{L}}\p{{N}}])(?!\.\d)",
    "date": r"(?<![\p{L}\p{N}/.-])(?:\d{4}-\d{2}-\d{2}(?=T\d{2}:)|"
            r"(?:\d{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}\.\d{1,2}\.\d{4})(?![\p{L}\p{N}]|[/.-]\d))",
    "social": r"(?<![\p{L}\p{N}-])\d{3}-\d{2}-\d{4}(?![\p{L}\p{N}]|-\d)",
    "card": r"(?<![\p{L}\p{N}])(?:\d{4}(?<cardgap>[ -])\d{4}\k<cardgap>\d{4}\k<cardgap>\d{1,7}|\d{4}[ -]\d{6}[ -]\d{5}|\d{13,19})(?![\p{L}\p{N}])",
    "phone": r"(?<![\p{L}\p{N}])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,12}(?:[ .-]\d{2,8}){0,4}"
             r"|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}(?<phonegap>[.-])\d{3}\k<phonegap>\d{4})(?![\p{L}\p{N}])",
}
ANY = "|".join(FORMATS.values())

# What a telephone number with a country code does not run into: addresses and dates, and if it is valid without them
# the other numbers too.
_MONTH, _DAY = r"(?:0?[1-9]|1[0-2])", r"(?:0?[1-9]|[12]\d|3[01])"
_STOPS = (
    rf"{_OCTET}(?:\.{_OCTET}){{3}}(?![\p{{L}}\p{{N}}])(?!\.\d)|\d{{4}}-{_MONTH}-{_DAY}(?=T\d{{2}}:)|(?:\d{{4}}-{_MONTH}-{_DAY}"
    rf"|(?:{_MONTH}/{_DAY}|{_DAY}/{_MONTH}|{_DAY}\.{_MONTH}|{_MONTH}\.{_DAY})[/.]\d{{4}})(?![\p{{L}}\p{{N}}]|[/.-]\d)"
)
_NUMBERS = (
    r"(?:\d{3}-\d{2}-\d{4}|\d{4} \d{4} \d{4} \d{1,7}|\d{4}-\d{4}-\d{4}-\d{1,7}|\d{4}[ -]\d{6}[ -]\d{5}"
    r"|\(?\d{3}\)?[ .-]?\d{3}[.-]\d{4})(?![\p{L}\p{N}])"
)


def _numbers(stops: str) -> list[str]:
    """Formats of numbers with a country code from four further groups down to none."""
    return [
        r"\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,12}"
        rf"(?:[ .-](?!{stops})\d{{2,8}}){{{n}}}(?![\p{{L}}\p{{N}}])" for n in range(4, -1, -1)
    ]


#: Of a format with several possible ends, the formats of one end each, in the order in which they are tried.
ENDS = {
    "iban": [
        rf"[A-Z]{{2}}\d{{2}}(?: ?[A-Z0-9]{{4}}){{{k}}}" + (rf" ?[A-Z0-9]{{{r}}}" if r else "") + r"(?![\p{L}\p{N}])"
        for k in range(7, 1, -1) for r in (3, 2, 1, 0)
    ],
    "phone": [
        r"\+1[ .-]?(?:\(\d{3}\)[ .-]?\d{3}|\d{3}[ .-]?\d{3})[ .-]?\d{4}(?![\p{L}\p{N}])",
        *_numbers(f"{_STOPS}|{_NUMBERS}"), *_numbers(_STOPS), r"(?!\+)" + FORMATS["phone"],
    ],
}

#: Length of an account number by its country.
IBAN_LENGTHS = {
    c: n for n, countries in {
        15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
        22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
        25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV",
        29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
    }.items() for c in countries.split()
}

#: Places one character before a value, which the text behind is cut at; the group is the longest that a value can
#: reach, a mail address in full.
REACH = 96
STARTS = rf"(?=(?s:.)(?:{ANY}))(?=((?s:.)(?:{FORMATS['mail']}|(?s:.{{1,{REACH}}}))))"
_REACH_GROUP = 3  # behind the two groups for gaps
#: Pieces of a text that are put together at a time.
PIECES = 128


def keyed_number(key: str, kind: Column | str, i: Column, value: Column) -> Column:
    """60 bits that depend on the key and on all arguments: a digest within a digest, each keyed."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    inner = F.sha2(F.concat_ws("|", F.lit(key), F.lit("inner"), kind, i.cast("string"), value.cast("string")), 256)
    outer = F.sha2(F.concat_ws("|", F.lit(key), F.lit("outer"), inner), 256)
    return F.conv(F.substring(outer, 1, 15), 16, 10).cast("bigint")


def permuted(key: str, kind: Column | str, a: Column, b: Column, m: Column, n: Column) -> Column:
    """A permutation of the pairs (a, b) with 0 <= a < m and 0 <= b < n, as a struct."""
    def step(s: Column, i: Column) -> Column:
        first = i % 2 == 0
        number = keyed_number(key, kind, i, F.when(first, s["b"]).otherwise(s["a"]))
        return F.struct(
            F.when(first, F.pmod(s["a"] + number % m, m)).otherwise(s["a"]).alias("a"),
            F.when(first, s["b"]).otherwise(F.pmod(s["b"] + number % n, n)).alias("b"),
        )

    start = F.struct(a.cast("bigint").alias("a"), b.cast("bigint").alias("b"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step)


def _chars(s: Column) -> Column:
    return F.filter(F.split(s, ""), lambda c: c != "")


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, r"\D", "")


def _part(s: Column, start: Column | int, length: Column | int) -> Column:
    start, length = (F.lit(x) if isinstance(x, int) else x for x in (start, length))
    return F.substring(s, start, length)


def refilled(value: Column, digits: Column) -> Column:
    """``value`` with its digits replaced in turn."""
    start = F.struct(F.lit("").alias("text"), F.lit(1).alias("at"))
    return F.aggregate(_chars(value), start, lambda s, c: F.when(
        c.rlike(r"\d"), F.struct(F.concat(s["text"], _part(digits, s["at"], 1)).alias("text"), (s["at"] + 1).alias("at"))
    ).otherwise(F.struct(F.concat(s["text"], c).alias("text"), s["at"].alias("at"))))["text"]


def permuted_digits(key: str, kind: str, digits: Column) -> Column:
    """A permutation of the digit strings of this length, up to 36 digits."""
    left = F.floor(F.length(digits) / 2).cast("int")
    right = F.length(digits) - left
    a, b = _part(digits, 1, left), F.substring(digits, left + 1, right)
    ten = F.lit(10).cast("double")

    def join(p: Column) -> Column:
        return F.concat(
            F.when(left > 0, F.lpad(p["a"].cast("string"), left, "0")).otherwise(""),
            F.lpad(p["b"].cast("string"), right, "0"),
        )

    kind_and_length = F.concat(F.lit(kind), F.length(digits).cast("string"))
    number = F.when(left > 0, a.try_cast("bigint")).otherwise(F.lit(0).cast("bigint"))
    return let(permuted(
        key, kind_and_length, number, b.try_cast("bigint"),
        F.pow(ten, left).cast("bigint"), F.pow(ten, right).cast("bigint"),
    ), join)


def luhn_sum(digits: Column) -> Column:
    """Check sum of a digit string whose last digit is the check digit."""
    turned = F.split(F.reverse(digits), "")

    def add(s: Column, c: Column) -> Column:
        d = c.try_cast("int")
        twice = F.when(s["odd"], d * 2).otherwise(d)
        return F.struct((s["sum"] + F.when(twice > 9, twice - 9).otherwise(twice)).alias("sum"), (~s["odd"]).alias("odd"))

    start = F.struct(F.lit(0).alias("sum"), F.lit(False).alias("odd"))
    return F.aggregate(F.filter(turned, lambda c: c != ""), start, add)["sum"]


def card(key: str, value: Column) -> Column:
    """Null unless the check digit is right; else a card number with a right check digit."""
    def make(d: Column) -> Column:
        body = permuted_digits(key, "card", _part(d, 1, F.length(d) - 1))
        full = let(body, lambda x: F.concat(
            x, ((10 - luhn_sum(F.concat(x, F.lit("0"))) % 10) % 10).cast("string")
        ))
        return F.when(luhn_sum(d) % 10 == 0, refilled(value, full))

    return let(_digits(value), make)


def iban_rest(text: Column) -> Column:
    """Remainder by 97 of a bank account number, its first four characters moved to the end."""
    moved = F.concat(F.substring(text, F.lit(5), F.length(text)), _part(text, 1, 4))

    def add(rest: Column, c: Column) -> Column:
        letter = F.ascii(c) - 55
        return F.when(c.rlike(r"\d"), rest * 10 + c.try_cast("int")).otherwise(rest * 100 + letter) % 97

    return F.aggregate(_chars(moved), F.lit(0), add)


def iban(key: str, value: Column) -> Column:
    """Null unless its check digits are right; the country and all letters stay."""
    def make(text: Column) -> Column:
        own_digits = _digits(F.substring(text, F.lit(5), F.length(text)))

        def check(new: Column) -> Column:
            plain = refilled(text, F.concat(F.lit("00"), new))
            return refilled(value, F.concat(F.lpad((98 - iban_rest(plain)).cast("string"), 2, "0"), new))

        valid = (iban_rest(text) == 1) & (F.length(own_digits) >= 4)
        return F.when(valid, let(permuted_digits(key, "iban", own_digits), check))

    return let(F.replace(value, F.lit(" "), F.lit("")), make)


def address(key: str, value: Column) -> Column:
    def make(o: Column) -> Column:
        n = [o[i].try_cast("bigint") for i in range(4)]
        size = F.lit(65536).cast("bigint")
        return let(permuted(key, "address", n[0] * 256 + n[1], n[2] * 256 + n[3], size, size), lambda p: F.concat_ws(
            ".", *[F.floor(p[h] / 256).cast("string") if top else (p[h] % 256).cast("string")
                   for h in ("a", "b") for top in (True, False)]
        ))

    return let(F.split(value, r"\."), make)


def social(key: str, value: Column) -> Column:
    """Areas 001-899 but 666, groups 01-99, serials 0001-9999."""
    def make(d: Column) -> Column:
        area, group, serial = (_part(d, *x).try_cast("bigint") for x in ((1, 3), (4, 2), (6, 4)))
        valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
        a = area - 1 - (area > 666).cast("bigint")

        def write(p: Column) -> Column:
            new = p["a"] + 1 + (p["a"] >= 665).cast("bigint")
            parts = ((new, 3), (F.floor(p["b"] / 9999) + 1, 2), (p["b"] % 9999 + 1, 4))
            return refilled(value, F.concat(*[F.lpad(x.cast("string"), n, "0") for x, n in parts]))

        sizes = [F.lit(898).cast("bigint"), F.lit(99 * 9999).cast("bigint")]
        return F.when(valid, let(permuted(key, "social", a, (group - 1) * 9999 + serial - 1, *sizes), write))

    return let(_digits(value), make)


#: Days of the 400 years from 1800 on, 189 x 773 of them.
_FIRST_DAY, _DAYS = "1800-01-01", (189, 773)


def date(key: str, value: Column) -> Column:
    """A valid date of the years 1800-2199 to another one, in the same notation.

    Between slashes or dots the day comes first; where it can only come second
    the pseudonym's day is one that can only come second too.
    """
    first = F.to_date(F.lit(_FIRST_DAY))
    sizes = [F.lit(x).cast("bigint") for x in _DAYS]

    def move(day: Column) -> Column:
        return let(permuted(key, "date", F.floor(day / _DAYS[1]), day % _DAYS[1], *sizes),
                   lambda p: p["a"] * _DAYS[1] + p["b"])

    def make(parts: Column) -> Column:
        iso = value.rlike(r"^\d{4}-")
        y, a, b = (F.when(iso, parts[i]).otherwise(parts[j]) for i, j in ((0, 2), (1, 1), (2, 0)))
        swapped = ~iso & (a.try_cast("int") > 12)
        month, day = F.when(swapped, b).otherwise(a), F.when(swapped, a).otherwise(b)
        at = F.try_to_timestamp(F.concat_ws("-", y, month, day), F.lit("y-M-d")).cast("date")
        number = F.datediff(at, first).cast("bigint")
        valid = at.isNotNull() & number.between(0, _DAYS[0] * _DAYS[1] - 1)

        def of(n: Column) -> Column:
            return F.date_add(first, n.cast("int"))

        # Walk on along the cycle until the day fits its place again.
        walk = F.aggregate(F.sequence(F.lit(1), F.lit(200)), move(number), lambda n, _: F.when(
            F.dayofmonth(of(n)) > 12, n).otherwise(move(n)))

        def write(n: Column) -> Column:
            d = of(n)
            two = [F.lpad(x(d).cast("string"), 2, "0") for x in (F.month, F.dayofmonth)]
            year = F.lpad(F.year(d).cast("string"), 4, "0")
            mark = F.when(value.contains("/"), "/").otherwise(".")
            return F.when(iso, F.concat_ws("-", year, *two)).otherwise(F.concat(
                F.when(swapped, two[0]).otherwise(two[1]), mark, F.when(swapped, two[1]).otherwise(two[0]), mark, year))

        return F.when(valid & swapped, let(walk, write)).when(valid, let(move(number), write))

    return let(F.split(value, "[-/.]"), make)


def phone(key: str, value: Column) -> Column:
    """8 to 15 digits; a country code stays; ten digits of the American plan stay in the plan."""
    code = F.when(
        value.startswith("+"), F.when(value.rlike(r"^\+1"), "1").otherwise(
            F.coalesce(F.nullif(F.regexp_extract(value, r"^\+(\d{1,3})(?=\D)", 1), F.lit("")), F.substring(value, 2, 2)))
    ).otherwise("")

    def make(s: Column) -> Column:
        cc, own_digits = s["cc"], s["own"]
        area, office, line = (_part(own_digits, *x).try_cast("bigint") for x in ((1, 3), (4, 3), (7, 4)))
        ten = cc.isin("", "1") & (F.length(own_digits) == 10)

        def in_plan(d: Column) -> Column:
            return d.rlike("^[2-9]..[2-9]")

        sizes = [F.lit(640_000).cast("bigint"), F.lit(10_000).cast("bigint")]

        def write(p: Column) -> Column:
            parts = ((F.floor(p["a"] / 800) + 200, 3), (p["a"] % 800 + 200, 3), (p["b"], 4))
            return F.concat(cc, *[F.lpad(x.cast("string"), n, "0") for x, n in parts])

        plan = let(permuted(key, "american", (area - 200) * 800 + office - 200, line, *sizes), write)
        moved = permuted_digits(key, "phone", own_digits)
        # Ten digits outside the plan walk on until they are outside again.
        walk = F.aggregate(F.sequence(F.lit(1), F.lit(200)), moved, lambda d, _: F.when(
            in_plan(d), permuted_digits(key, "phone", d)).otherwise(d))
        other = F.concat(cc, F.when(ten, walk).otherwise(moved))
        n = F.length(cc) + F.length(own_digits)
        valid = n.between(8, 15) & (F.length(own_digits) >= 4)
        return F.when(ten & in_plan(own_digits), refilled(value, plan)).when(valid, refilled(value, other))

    own_digits = F.substring(_digits(value), F.length(code) + 1, F.lit(20))
    return let(F.struct(code.alias("cc"), own_digits.alias("own")), make)


# Alphabets of letters and digits, first code point and length.
ALPHABETS = (
    (0x30, 10), (0x41, 26), (0x61, 26), (0xC0, 23), (0xD8, 7), (0xDF, 24), (0xF8, 8), (0x100, 128), (0x3B1, 25),
    (0x410, 32), (0x430, 32), (0x5D0, 27), (0x621, 26), (0x905, 53), (0x3041, 86), (0x30A1, 90), (0x4E00, 20902),
    (0xAC00, 11172),
)


def mail(key: str, value: Column) -> Column:
    """The local part: even and odd places are the halves, each place moves within its own alphabet."""
    alphabets = F.array(*[F.struct(F.lit(a).alias("base"), F.lit(n).alias("size")) for a, n in ALPHABETS])

    def place(c: Column) -> Column:
        def within(code: Column) -> Column:
            found = F.filter(alphabets, lambda a: (code >= a["base"]) & (code < a["base"] + a["size"]))
            return let(F.get(found, F.lit(0)), lambda a: F.struct(
                (code - F.coalesce(a["base"], code)).alias("v"), F.coalesce(a["base"], code).alias("base"),
                F.coalesce(a["size"], F.lit(1)).alias("size"), c.alias("c"),
            ))

        return let(F.ascii(c), within)

    def turn(s: Column, i: Column) -> Column:
        still = F.array_join(F.transform(F.filter(s, lambda x, j: j % 2 != i % 2), lambda x: x["v"].cast("string")), ",")
        inner = F.sha2(F.concat_ws("|", F.lit(key), F.lit("mail"), i.cast("string"), F.size(s).cast("string"), still), 256)

        def add(h: Column) -> Column:
            def moved(x: Column, j: Column) -> Column:
                number = F.conv(F.substring(h, (F.floor(j / 2) * 4 + 1).cast("int"), F.lit(4)), 16, 10).cast("int")
                v = F.when(j % 2 == i % 2, (x["v"] + number) % x["size"]).otherwise(x["v"])
                return F.struct(v.cast("int").alias("v"), x["base"].alias("base"), x["size"].alias("size"), x["c"].alias("c"))

            return F.transform(s, moved)

        return let(F.sha2(F.concat_ws("|", F.lit(key), F.lit("outer"), inner), 512), add)

    local = F.substring_index(value, "@", 1)
    turned = F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), F.transform(_chars(local), place), turn)
    text = F.array_join(F.transform(turned, lambda x: F.when(x["size"] == 1, x["c"]).otherwise(
        F.decode(F.unhex(F.lpad(F.hex(x["base"] + x["v"]), 4, "0")), "UTF-16BE")
    )), "")
    return F.concat(text, F.substring(value, F.length(local) + 1, F.length(value)))


MAKERS = {
    "mail": mail, "iban": iban, "address": address, "date": date, "social": social, "card": card, "phone": phone,
}


def candidates(kind: str, reach: Column) -> Column:
    """The texts behind the first character of ``reach`` that a format fits, in the order in which they are tried."""
    found = [F.regexp_extract(reach, f"^(?s:.)({end})", 1) for end in ENDS.get(kind, [FORMATS[kind]])]
    fit = F.filter(F.array(*found), lambda c: c != "")
    return let(fit, own_length_first) if kind == "iban" else fit


def own_length_first(fit: Column) -> Column:
    """Of accounts with different ends: that of the country's length, then the longest; all if the country is not known."""
    lengths = F.create_map(*[F.lit(x) for pair in IBAN_LENGTHS.items() for x in pair])
    want = F.try_element_at(lengths, _part(F.get(fit, F.lit(0)), 1, 2))
    right = F.filter(fit, lambda c: F.length(F.replace(c, F.lit(" "), F.lit(""))) == want)
    return F.when(want.isNull(), fit).otherwise(F.concat(right, F.slice(fit, 1, 1)))


def pseudonym(key: str, reach: Column) -> Column:
    """The first valid value behind the first character of ``reach`` and its pseudonym, null if there is none."""
    none = F.lit(None).cast("struct<old:string,new:string>")

    def first(kind: str) -> Column:
        def attempt(old: Column) -> Column:
            return let(MAKERS[kind](key, old), lambda new: F.when(
                new.isNotNull(), F.struct(old.alias("old"), new.alias("new"))
            ))

        return F.aggregate(candidates(kind, reach), none, lambda s, old: F.coalesce(s, attempt(old)))

    return F.coalesce(*[F.when(reach.rlike(f"^(?s:.)(?:{FORMATS[kind]})"), first(kind)) for kind in MAKERS])


def put_together(items: Column) -> Column:
    """Pieces of a text with their values replaced, and the number of these, from structs (piece, found).

    A value may reach into the pieces behind its own; those characters are left out there.
    """
    def add(s: Column, x: Column) -> Column:
        taken = (s["over"] == 0) & x["found"].isNotNull()
        over = F.when(taken, F.length(x["found"]["old"]) + 1).otherwise(s["over"])
        new = F.when(taken, F.concat(_part(x["piece"], 1, 1), x["found"]["new"])).otherwise("")
        return F.struct(
            F.greatest(over - F.length(x["piece"]), F.lit(0)).alias("over"),
            (s["n"] + taken.cast("int")).alias("n"),
            F.concat(s["text"], new, F.substring(x["piece"], over + 1, F.length(x["piece"]))).alias("text"),
        )

    def start(over: Column, n: Column) -> Column:
        return F.struct(over.alias("over"), n.alias("n"), F.lit("").alias("text"))

    def add_some(s: Column, i: Column) -> Column:
        some = F.aggregate(F.slice(items, i * PIECES + 1, F.lit(PIECES)), start(s["over"], s["n"]), add)
        return let(some, lambda x: F.struct(x["over"].alias("over"), x["n"].alias("n"),
                                            F.concat(s["text"], x["text"]).alias("text")))

    # Long texts grow by some pieces at a time and not by each.
    last = F.floor((F.size(items) - 1) / PIECES).cast("int")
    return F.aggregate(F.sequence(F.lit(0), last), start(F.lit(0), F.lit(0)), add_some)


def pseudonymised(docs: DataFrame, key: str, text_column: str = "text", count: str = "n_pseudonyms") -> DataFrame:
    """``docs`` with the text's valid private values replaced, and a count of them in a column ``count``."""
    found, out, count = own(docs, "found", "whole", count)
    text = named(text_column)
    # Every value has a character before it, and the text is never cut before its first character.
    fenced = F.concat(F.lit("\n\n"), text)
    rows = docs.withColumn(found, F.when(text.rlike(r"@|\d"), F.transform(
        F.regexp_extract_all(fenced, F.lit(STARTS), _REACH_GROUP), lambda r: pseudonym(key, r)
    )))
    some = F.exists(F.col(found), lambda f: f.isNotNull())
    none = F.lit(None).cast("struct<old:string,new:string>")
    items = F.zip_with(F.split(fenced, STARTS, -1), F.concat(F.array(none), F.col(found)),
                       lambda piece, f: F.struct(piece.alias("piece"), f.alias("found")))
    rows = rows.withColumn(out, F.when(some, let(items, put_together)))
    whole_text = F.when(F.col(out).isNull(), text).otherwise(F.substring(F.col(out)["text"], F.lit(3), F.length(F.col(out)["text"])))
    kept = [whole_text.alias(c) if c == text_column else named(c) for c in docs.columns]
    return rows.select(*kept, F.coalesce(F.col(out)["n"], F.lit(0)).cast("long").alias(count))
