"""PII: format-preserving Feistel pseudonyms, in DataFrame operations only.

Found values are replaced by values of the same format that a keyed permutation gives, so equal values get equal
pseudonyms in all documents, different ones different pseudonyms, and who holds the key can reverse them:

* payment cards: 13 to 19 digits, alone or in groups joined by single spaces or by single hyphens, that pass the Luhn check. All
  digits but the last are permuted as one number and the check digit is made anew, so the result passes as well.
* phone numbers ``+C (AAA) BBB-DDDD`` and the like: ``+`` and 8 to 15 digits with single separators, or ``(AAA) BBB-DDDD``
  and ``AAA-BBB-DDDD``. The digits after the country code are permuted, separators stay.
* US social security numbers ``AAA-GG-SSSS`` with a valid area, group and serial: the nine digits are permuted as one
  number, again and again until the result is valid too (cycle walking keeps it a permutation).
* IPv4 addresses with four octets up to 255: permuted among the addresses whose octets have the same numbers of digits.
* Dates ``YYYY-MM-DD``, ``DD.MM.YYYY`` and ``MM/DD/YYYY`` of the years 1900 to 2099: permuted as a day number, by cycle
  walking in the range, and printed in the format found. Other date-like strings stay as they are.
* IBANs (a country's length, ISO 13616 check digits valid): digits of the account part are permuted, check digits are made anew.
* E-mail addresses have no numeric format: the local part is permuted letter for letter and digit for digit (each class
  as one number per block of 12 characters), the domain's letters likewise but for its last two labels.

Where validation decides (cards, dates, IBANs), a text's matches at all places are checked first, and then only valid
values are looked for, so a match that fails takes nothing from another value.

The network is a balanced or near-balanced Feistel network over the decimal halves of a number (eight rounds; the round
function is SHA-256 of key, kind, length, round and half). Numbers of one digit are permuted by a keyed shift.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
#: Numbers are handled in parts of at most so many digits, which a long holds with room for sums.
PART = 18
EMAIL = r"[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63})*\.[A-Za-z]{2,24}(?![A-Za-z0-9-])"
#: Characters of an IBAN by country (ISO 13616 registry, and the countries that use the format without being in it).
IBAN_SIZES = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "AO CV GW LY MZ PT ST", 26: "DZ IR IS TR", 27: "BI CF CG CM DJ FR GA GQ GR IT KM MC MG MR SM TD",
    28: "AL AZ BF BJ BY CI CY DO GT HN HU LB MA ML NE NI PL SN SV TG", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
IBAN = r"(?<![A-Za-z0-9])(?:" + "|".join(rf"(?:{c.replace(' ', '|')})[0-9]{{2}}(?: ?[A-Z0-9]){{{n - 4}}}" for n, c in IBAN_SIZES.items()) + r")(?![A-Za-z0-9])"
DATE = r"(?<![0-9])(?:(?:19|20)[0-9]{2}-[01][0-9]-[0-3][0-9]|[0-3][0-9]\.[01][0-9]\.(?:19|20)[0-9]{2}|[01][0-9]/[0-3][0-9]/(?:19|20)[0-9]{2})(?![0-9])"
IP = r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?![0-9]|\.[0-9])"
SSN = r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9]|-[0-9])"
PHONE = r"(?<![0-9+])\+[1-9][0-9]{0,2}(?:[ .-]?\([0-9]{1,4}\))?(?:[ .-]?[0-9]){6,13}(?![0-9])|(?<![0-9])\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}(?![0-9])|(?<![0-9-])[2-9][0-9]{2}-[0-9]{3}-[0-9]{4}(?![0-9]|-[0-9])"
CARD = r"(?<![0-9+])(?:[0-9](?: ?[0-9]){12,18}|[0-9](?:-?[0-9]){12,18})(?![0-9])"
#: Groupings that cards are printed in; a valid one goes before others that would take a part of it.
USUAL = r"^(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})$"
#: Kinds in the order of preference where two patterns match at one place.
PATTERNS = {"email": EMAIL, "iban": IBAN, "date": DATE, "ip": IP, "ssn": SSN, "phone": PHONE, "card": CARD}
#: What may hold a value: texts without a match are not looked at any further.
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
FIRST_DAY, DAYS = "1900-01-01", 73049  # up to 2099-12-31


def let(names: dict[str, Column], then) -> Column:
    """``then`` over a struct of named values, each of which is computed once."""
    return F.element_at(F.transform(F.array(F.struct(*[c.alias(k) for k, c in names.items()])), then), 1)


def power(digits: Column) -> Column:
    return F.pow(F.lit(10.0), digits).cast("long")


def mixed(key: str, tweak: Column, round_: Column, half: Column, modulus: Column) -> Column:
    """Round function: 60 bits of SHA-256, reduced."""
    digest = F.sha2(F.concat_ws("|", F.lit(key), tweak, round_.cast("string"), half.cast("string")), 256)
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long") % modulus


def feistel(value: Column, left: Column, right: Column, key: str, tweak: Column) -> Column:
    """Permutes ``value`` in [0, left * right); ``left`` and ``right`` are the sizes of the halves."""

    def run(v: Column) -> Column:
        start = F.struct(F.floor(v["x"] / v["r"]).cast("long").alias("a"), (v["x"] % v["r"]).alias("b"))

        def step(s: Column, i: Column) -> Column:
            even = i % 2 == 0  # the halves take turns, so that each keeps its size
            a = F.when(even, (s["a"] + mixed(key, v["t"], i, s["b"], v["l"])) % v["l"]).otherwise(s["a"])
            b = F.when(even, s["b"]).otherwise((s["b"] + mixed(key, v["t"], i, s["a"], v["r"])) % v["r"])
            return F.struct(a.alias("a"), b.alias("b"))

        return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda s: s["a"] * v["r"] + s["b"])

    return let({"x": value, "l": left, "r": right, "t": tweak}, run)


def permuted(digits: Column, key: str, kind: str) -> Column:
    """A digit string of 1 to 36 digits, permuted among those of its length, in parts of at most 18 digits.

    The second part's network is tweaked with the first part's digits, so that equal tails of different values differ.
    """

    def part(text: Column, tweak: Column) -> Column:
        def run(v: Column) -> Column:
            low = F.floor((v["n"] + 1) / 2).cast("long")
            out = feistel(v["s"].cast("long"), power(v["n"] - low), power(low), key, v["t"])
            return F.lpad(out.cast("string"), F.lit(40), "0").substr(F.lit(41) - v["n"].cast("int"), v["n"].cast("int"))

        n = F.length(text)
        return F.when(n == 0, F.lit("")).otherwise(let({"s": text, "n": n, "t": F.concat_ws(":", F.lit(kind), n.cast("string"), tweak)}, run))

    head, tail = F.substring(digits, 1, PART), F.substring(digits, PART + 1, 40)
    return F.concat(part(head, F.lit("")), part(tail, head))


def only_digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def filled(shape: Column, digits: Column, skip: Column) -> Column:
    """``shape`` with its digits, after the first ``skip`` characters, replaced in order."""

    def run(v: Column) -> Column:
        step = lambda s, c: F.when(c.rlike("[0-9]"), F.struct((s["i"] + 1).alias("i"), F.concat(s["out"], F.substring(v["d"], s["i"] + 1, F.lit(1))).alias("out"))).otherwise(F.struct(s["i"].alias("i"), F.concat(s["out"], c).alias("out")))
        body = F.substring(v["s"], v["k"] + 1, F.lit(1000))
        return F.aggregate(F.split(body, ""), F.struct(F.lit(0).alias("i"), F.substring(v["s"], F.lit(1), v["k"]).alias("out")), step, lambda s: s["out"])

    return let({"s": shape, "d": digits, "k": skip.cast("int")}, run)


def luhn_sum(digits: Column, odd: int) -> Column:
    """Luhn sum of a digit string; every second digit counted from the right, from place ``odd`` on, is doubled."""
    places = F.split(F.reverse(digits), "")
    twice = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    values = F.transform(places, lambda c, i: F.when(i % 2 == odd, twice(c.cast("int"))).otherwise(c.cast("int")))
    return F.aggregate(values, F.lit(0), lambda s, v: s + v)


def card(text: Column, key: str) -> Column:
    """Null where the Luhn check fails."""

    def run(v: Column) -> Column:
        body = let({"p": permuted(F.substring(v["d"], F.lit(1), v["n"] - 1), key, "card")}, lambda y: F.concat(y["p"], ((10 - luhn_sum(y["p"], 0) % 10) % 10).cast("string")))
        return F.when(luhn_sum(v["d"], 1) % 10 == 0, filled(v["s"], body, F.lit(0)))

    digits = only_digits(text)
    return let({"s": text, "d": digits, "n": F.length(digits)}, run)


def phone(text: Column, key: str) -> Column:
    """The country code, up to the first separator or three digits, stays; so does the digit count."""
    code = F.length(F.regexp_extract(text, r"^(\+[0-9]{1,3}(?=[^0-9])|\+[0-9]|)", 1))
    return let({"s": text, "k": code}, lambda v: filled(v["s"], permuted(only_digits(F.substring(v["s"], v["k"] + 1, F.lit(100))), key, "phone"), v["k"]))


def ssn(text: Column, key: str) -> Column:
    def run(v: Column) -> Column:
        walk = F.aggregate(F.sequence(F.lit(1), F.lit(24)), F.struct(v["d"].alias("d"), F.lit(False).alias("ok")), lambda s, _: F.when(s["ok"], s).otherwise(let({"d": permuted(s["d"], key, "ssn")}, lambda y: F.struct(y["d"].alias("d"), y["d"].rlike("^(?!000|666|9)...(?!00)..(?!0000)....$").alias("ok")))))
        return filled(v["s"], walk["d"], F.lit(0))

    return let({"s": text, "d": only_digits(text)}, run)


def ip(text: Column, key: str) -> Column:
    """Octets keep their numbers of digits: the address is a mixed-radix number over the octets of those lengths."""

    def run(v: Column) -> Column:
        size = lambda i: F.element_at(v["size"], i)
        digit = lambda i: F.element_at(v["octet"], i) - F.element_at(v["low"], i)
        value = ((digit(1) * size(2) + digit(2)) * size(3) + digit(3)) * size(4) + digit(4)
        out = feistel(value, size(1) * size(2), size(3) * size(4), key, F.concat_ws(":", F.lit("ip"), F.array_join(v["low"].cast("array<string>"), ".")))
        return let({"x": out, "size": v["size"], "low": v["low"]}, spell)

    def spell(v: Column) -> Column:
        size = lambda i: F.element_at(v["size"], i)
        below = {4: F.lit(1).cast("long"), 3: size(4), 2: size(3) * size(4), 1: size(2) * size(3) * size(4)}
        return F.concat_ws(".", *[(F.floor(v["x"] / below[i]).cast("long") % size(i) + F.element_at(v["low"], i)).cast("string") for i in (1, 2, 3, 4)])

    by_length = lambda one, two, three: F.transform(F.split(text, r"\."), lambda p: F.when(F.length(p) == 1, one).when(F.length(p) == 2, two).otherwise(three).cast("long"))
    return let({"octet": F.transform(F.split(text, r"\."), lambda p: p.cast("long")), "size": by_length(10, 90, 156), "low": by_length(0, 10, 100)}, run)


DATE_FORMS = (("yyyy-MM-dd", r"^\d{4}-"), ("dd.MM.yyyy", r"^\d\d\."), ("MM/dd/yyyy", r"^\d\d/"))


def date_of(text: Column) -> Column:
    return F.coalesce(*[F.when(text.rlike(p), F.try_to_date(text, f)) for f, p in DATE_FORMS])


def date(text: Column, key: str) -> Column:
    """Null where the date does not exist."""

    def run(v: Column) -> Column:
        walk = F.aggregate(F.sequence(F.lit(1), F.lit(64)), F.struct(v["n"].alias("n"), F.lit(False).alias("ok")), lambda s, _: F.when(s["ok"], s).otherwise(let({"n": feistel(s["n"], F.lit(271).cast("long"), F.lit(271).cast("long"), key, F.lit("date"))}, lambda y: F.struct(y["n"].alias("n"), (y["n"] < DAYS).alias("ok")))))
        out = let({"d": F.date_add(F.lit(FIRST_DAY).cast("date"), walk["n"].cast("int"))}, lambda y: F.coalesce(*[F.when(v["s"].rlike(p), F.date_format(y["d"], f)) for f, p in DATE_FORMS]))
        return F.when(v["n"].isNotNull(), out)

    return let({"s": text, "n": F.datediff(date_of(text), F.lit(FIRST_DAY).cast("date")).cast("long")}, run)


def _mod97(text: Column) -> Column:
    """An alphanumeric string, letters as 10 to 35, modulo 97."""
    value = lambda c: F.conv(c, 36, 10).cast("long")
    return F.aggregate(F.split(text, ""), F.lit(0).cast("long"), lambda s, c: (s * F.when(c.rlike("[0-9]"), 10).otherwise(100) + value(c)) % 97)


def iban(text: Column, key: str) -> Column:
    """Null where the check digits are wrong."""

    def run(v: Column) -> Column:
        country, rest = F.substring(v["c"], 1, 2), F.substring(v["c"], 5, 40)
        tail = filled(rest, permuted(only_digits(rest), key, "iban"), F.lit(0))
        made = let({"r": tail, "c": country}, lambda y: F.concat(y["c"], F.lpad((98 - _mod97(F.concat(y["r"], y["c"], F.lit("00")))).cast("string"), 2, "0"), y["r"]))
        valid = _mod97(F.concat(rest, F.substring(v["c"], 1, 4))) == 1
        return F.when(valid, let({"m": made, "s": v["s"]}, _respaced))

    return let({"s": text, "c": F.replace(text, F.lit(" "), F.lit(""))}, run)


def _respaced(v: Column) -> Column:
    step = lambda s, c: F.when(c == " ", F.struct(s["i"].alias("i"), F.concat(s["out"], c).alias("out"))).otherwise(F.struct((s["i"] + 1).alias("i"), F.concat(s["out"], F.substring(v["m"], s["i"] + 1, F.lit(1))).alias("out")))
    return F.aggregate(F.split(v["s"], ""), F.struct(F.lit(0).alias("i"), F.lit("").alias("out")), step, lambda s: s["out"])


def letters(text: Column, key: str, kind: str) -> Column:
    """Letters and digits of a string, permuted within their classes in blocks of 12 characters; other characters stay.

    A block's digits are one number and its letters, case aside, another in base 26; both are tweaked with the block's
    shape and with all that precedes the block. Case and place of every class stay.
    """

    def block(s: Column, piece: Column) -> Column:
        def run(v: Column) -> Column:
            low = F.lower(F.regexp_replace(v["p"], "[^A-Za-z]", ""))
            n = F.length(low)
            number = F.aggregate(F.split(low, ""), F.lit(0).cast("long"), lambda a, c: a * 26 + F.ascii(c) - 97)
            size = lambda k: F.pow(F.lit(26.0), k).cast("long")
            out = F.when(n > 0, feistel(number, size(n - F.floor((n + 1) / 2)), size(F.floor((n + 1) / 2)), key, F.concat_ws(":", F.lit(kind), v["t"])))
            digits = only_digits(v["p"])
            tail = F.when(F.length(digits) > 0, permuted(digits, key, kind)).otherwise(F.lit(""))
            return let({"p": v["p"], "x": F.coalesce(out, F.lit(0).cast("long")), "d": tail, "n": n}, _lettered)

        shape = F.regexp_replace(F.regexp_replace(piece, "[A-Za-z]", "a"), "[0-9]", "9")
        return let({"p": piece, "t": F.concat_ws("/", s["before"], shape)}, run)

    pieces = F.transform(F.sequence(F.lit(0), F.floor((F.length(text) - 1) / 12).cast("int")), lambda i: F.substring(text, i * 12 + 1, F.lit(12)))
    start = F.struct(F.lit("").alias("before"), F.lit("").alias("out"))
    return F.aggregate(pieces, start, lambda s, p: F.struct(F.concat(s["before"], p).alias("before"), F.concat(s["out"], block(s, p)).alias("out")), lambda s: s["out"])


def _lettered(v: Column) -> Column:
    """Characters of ``p`` with letters from the base-26 number ``x`` (first letter most significant) and digits ``d``."""

    def step(s: Column, c: Column) -> Column:
        letter = F.floor(v["x"] / F.pow(F.lit(26.0), v["n"] - 1 - s["a"]).cast("long")).cast("long") % 26
        letter = F.char(letter + F.when(c.rlike("[a-z]"), 97).otherwise(65))
        return (
            F.when(c.rlike("[A-Za-z]"), F.struct((s["a"] + 1).alias("a"), s["i"].alias("i"), F.concat(s["out"], letter).alias("out")))
            .when(c.rlike("[0-9]"), F.struct(s["a"].alias("a"), (s["i"] + 1).alias("i"), F.concat(s["out"], F.substring(v["d"], s["i"] + 1, F.lit(1))).alias("out")))
            .otherwise(F.struct(s["a"].alias("a"), s["i"].alias("i"), F.concat(s["out"], c).alias("out")))
        )

    return F.aggregate(F.split(v["p"], ""), F.struct(F.lit(0).alias("a"), F.lit(0).alias("i"), F.lit("").alias("out")), step, lambda s: s["out"])


def email(text: Column, key: str) -> Column:
    """Local part and leading domain labels are permuted; the last two labels stay."""
    at = F.instr(text, "@")
    local, domain = F.substring(text, F.lit(1), at - 1), F.substring(text, at + 1, F.length(text))
    keep = F.regexp_extract(domain, r"((?:^|\.)[^.]*\.[^.]*)$", 1)
    return let({"l": local, "h": F.substring(domain, F.lit(1), F.length(domain) - F.length(keep)), "k": keep}, lambda v: F.concat(letters(v["l"], key, "local"), F.lit("@"), F.when(F.length(v["h"]) > 0, letters(v["h"], key, "host")).otherwise(F.lit("")), v["k"]))


MAKERS = {"email": email, "iban": iban, "date": date, "ip": ip, "ssn": ssn, "phone": phone, "card": card}


def candidates(text: Column, pattern: str) -> Column:
    """Distinct matches of ``pattern`` at *every* place, overlapping ones too: one that fails validation hides no other."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?=({pattern}))"), F.lit(1)))


def valid_cards(text: Column) -> Column:
    """All groupings of 13 to 19 digits that pass the Luhn check, but for those that take a part of a usual one."""
    every = F.flatten(F.array(*[candidates(text, CARD.replace("12,18", str(n - 1))) for n in range(19, 12, -1)]))
    good = F.filter(every, lambda c: luhn_sum(only_digits(c), 1) % 10 == 0)
    group = lambda c: F.regexp_extract(c, "^[0-9]+[ -]?", 0)

    def kept(v: Column) -> Column:
        usual = F.filter(v["good"], lambda c: c.rlike(USUAL))
        return let({"good": v["good"], "usual": usual}, lambda w: F.filter(w["good"], lambda c: c.rlike(USUAL) | ~F.exists(w["usual"], lambda u: F.contains(c, group(u)) & ~F.contains(c, u))))

    return F.when(text.rlike(CARD), let({"good": good}, kept)).otherwise(F.array().cast("array<string>"))


def valid(text: Column) -> Column:
    """``(iban, date, card)``: the values of a text in which validation decides, each kind an array."""
    compact = lambda c: F.replace(c, F.lit(" "), F.lit(""))
    ibans = F.filter(candidates(text, IBAN), lambda c: _mod97(F.concat(F.substring(compact(c), 5, 40), F.substring(compact(c), 1, 4))) == 1)
    dates = F.filter(candidates(text, DATE), lambda c: date_of(c).isNotNull())
    return F.struct(ibans.alias("iban"), dates.alias("date"), valid_cards(text).alias("card"))


def pattern_of(found: Column) -> Column:
    """One pattern of a text's valid values and the kinds that need no validation, in the order of ``PATTERNS``."""
    none = F.lit("(?!)")
    one = lambda kind: F.when(F.size(found[kind]) > 0, F.array_join(F.transform(found[kind], lambda c: F.replace(c, F.lit("."), F.lit("[.]"))), "|")).otherwise(none)
    around = {"iban": (r"(?<![A-Za-z0-9])(?:", r")(?![A-Za-z0-9])"), "date": (r"(?<![0-9])(?:", r")(?![0-9])"), "card": (r"(?<![0-9+])(?:", r")(?![0-9])")}
    parts = [F.concat(F.lit(around[k][0]), one(k), F.lit(around[k][1])) if k in around else F.lit(f"(?:{p})") for k, p in PATTERNS.items()]
    return F.concat_ws("|", *parts)


def replaced(match: Column, found: Column, key: str) -> Column:
    """``(kind, out)`` of one match."""

    def made(kind: str) -> Column:
        return let({"m": MAKERS[kind](match, key), "s": match}, lambda v: F.struct(F.when(v["m"].isNotNull(), F.lit(kind)).alias("kind"), F.coalesce(v["m"], v["s"]).alias("out")))

    out = F.struct(F.lit(None).cast("string").alias("kind"), match.alias("out"))
    for kind, pattern in reversed(PATTERNS.items()):
        out = F.when(F.array_contains(found[kind], match) if kind in ("iban", "date", "card") else match.rlike(f"^(?:{pattern})$"), made(kind)).otherwise(out)
    return out


def pseudonymize(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """The columns of ``docs``, the text with PII replaced, and ``pii``, an array of ``(kind, start, end)``.

    Positions are code points, end exclusive; no pseudonym is longer or shorter than its value, so they hold in both texts.
    Equal values with an equal key give equal pseudonyms wherever they stand.
    Where patterns match at one place, the first kind of ``PATTERNS`` wins, and of one kind the longest valid card. Null
    texts stay null and empty ones empty, with no ``pii``; a column ``pii`` of ``docs`` gives way. Rows, repeated ones too,
    are treated one by one, without a shuffle; texts of any length are read whole, those without a match by one pattern.
    """
    columns = docs.columns
    docs = docs.toDF(*[f"c{i}" for i in range(len(columns))])  # no name can clash below
    text = F.col(f"c{columns.index(text_col)}")

    def parts_of(v: Column) -> Column:
        matches = F.transform(F.regexp_extract_all(v["s"], v["any"], F.lit(0)), lambda m: replaced(m, v["found"], key))
        return F.arrays_zip(F.split(v["s"], v["any"], -1).alias("gap"), matches.alias("match"))

    parts = let({"s": text, "found": valid(text)}, lambda v: let({"s": v["s"], "found": v["found"], "any": pattern_of(v["found"])}, parts_of))
    nothing = F.array().cast("array<struct<kind:string,start:bigint,end:bigint>>")
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"), nothing.alias("pii"))

    def step(s: Column, p: Column) -> Column:
        a = s["at"] + F.length(p["gap"])
        made = F.coalesce(p["match"]["out"], F.lit(""))
        b = a + F.length(made)
        pii = F.when(p["match"]["kind"].isNotNull(), F.concat(s["pii"], F.array(F.struct(p["match"]["kind"].alias("kind"), a.alias("start"), b.alias("end"))))).otherwise(s["pii"])
        return F.struct(b.alias("at"), F.lit("").alias("out"), pii.alias("pii"))

    done = let({"parts": parts}, lambda v: F.struct(F.array_join(F.transform(v["parts"], lambda p: F.concat(p["gap"], F.coalesce(p["match"]["out"], F.lit("")))), "").alias("text"), F.aggregate(v["parts"], start, step)["pii"].alias("pii")))
    whole = F.when(text.rlike(ANY), done).otherwise(F.struct(text.alias("text"), nothing.alias("pii")))
    out = docs.withColumn("done", whole)
    names = [(f"c{i}" if c != text_col else "done.text", c) for i, c in enumerate(columns) if c.lower() != "pii"]
    return out.select(*[F.col(own).alias(c) for own, c in names], F.col("done.pii").alias("pii"))
