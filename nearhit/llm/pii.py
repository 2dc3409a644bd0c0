"""PII: format-preserving Feistel pseudonyms, in SQL expressions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Lengths of IBANs by country: printed in groups of four, only the length tells where one ends.
IBAN_LENGTHS = {15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
                22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
                26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA",
                30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU"}


def _grouped(length: int, countries: str) -> str:
    """Pattern of an IBAN of this length in groups of four, the last of one to four."""
    last = (length - 1) % 4 + 1
    return f"(?:{countries.replace(' ', '|')})[0-9]{{2}}(?: [A-Z0-9]{{4}}){{{(length - last) // 4 - 1}}} [A-Z0-9]{{{last}}}"


#: What is looked for, in the order in which alternatives are tried. Patterns start only where a token can start
#: and use possessive repeats, so that a scan stays linear on very long tokens.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)*+(?<=\.[A-Za-z]{2,20})",
    "secret": r"(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![0-9A-Za-z])|(?<=password=)([A-Za-z0-9]{8,64}+)"
              r"|(?<![0-9A-Za-z])(?=[a-f]*+[0-9])(?=[0-9]*+[a-f])[0-9a-f]{32,64}+(?![0-9A-Za-z])",
    "iban": r"(?<![A-Za-z0-9])(?:[A-Z]{2}[0-9]{2}[A-Z0-9]{10,30}+|" + "|".join(_grouped(*x) for x in IBAN_LENGTHS.items()) + ")(?![A-Za-z0-9])",
    "date": r"(?<![0-9A-Za-z./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}(?=T[0-9])|"
            r"(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}\.[0-9]{2}\.[0-9]{4}|[0-9]{2}/[0-9]{2}/[0-9]{4})(?![0-9A-Za-z/-]|\.[0-9]))",
    "ip": r"(?<![0-9A-Za-z.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9A-Za-z]|\.[0-9])",
    "ssn": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "phone": r"(?<![0-9A-Za-z])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\)[ .-]?|[0-9]{3}[.-])[0-9]{3}[ .-]?[0-9]{4}(?![0-9A-Za-z])"
             r"|(?<![0-9A-Za-z])\+[0-9]{1,3}(?:[ .-]?\(?[0-9]{1,5}\)?){2,6}(?![0-9A-Za-z])",
    "card": r"(?<![0-9A-Za-z])[0-9](?:[ -]?[0-9]){12,18}+(?![0-9A-Za-z])",
}
PATTERN = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: The only group of the pattern: a password, which its letters alone do not tell from other kinds.
PASSWORD = 1
#: A text without any of these cannot hold a value of the patterns.
HINT = "[@0-9]|password=|AKIA"
#: 400 Gregorian years are 146097 = 189 * 773 days; the first day counted is 1600-03-01.
CYCLE, HIGH, LOW, EPOCH = 146097, 189, 773, "DATE'1600-03-01'"


def _let(name: str, value: str, body: str) -> str:
    """``body`` with ``name`` bound to ``value``, computed once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _feistel(vals: str, rads: str, kind: str, key: str, rounds: int = 8) -> str:
    """Keyed permutation of a list of integers, each below its radix: the halves are added to in turn.

    Each half is shifted, position by position and modulo its radix, by a
    keyed SHA-512 of the other half, so every list maps to one list of the
    same radices and no two lists to the same."""
    half = "CAST(ceil(size(fv) / 2.0) AS INT)"
    stream = f"sha2(concat_ws('|', '{key}', '{kind}', CAST(fr AS STRING), array_join(transform({{other}}, y -> CAST(y AS STRING)), ',')), 512)"

    def shifted(mine: str, other: str, radix: str) -> str:
        add = "CAST(conv(substr(fk, 1 + 8 * (fi % 16), 8), 16, 10) AS BIGINT)"
        return _let("fk", stream.format(other=other),
                    f"transform({mine}, (fx, fi) -> pmod(fx + {add}, {radix}))")

    start = "named_struct('a', slice(fv, 1, fh), 'b', slice(fv, fh + 1, size(fv)))"
    step = ("IF(fr % 2 = 1, named_struct('a', " + shifted("fs.a", "fs.b", "fm[fi]") + ", 'b', fs.b), "
            "named_struct('a', fs.a, 'b', " + shifted("fs.b", "fs.a", "fm[fh + fi]") + "))")
    walk = f"aggregate(sequence(1, {rounds}), {start}, (fs, fr) -> {step}, fs -> concat(fs.a, fs.b))"
    return _let("fv", vals, _let("fm", rads, _let("fh", half, walk)))


def _digits(text: str) -> str:
    return f"transform(filter(split(regexp_replace({text}, '[^0-9]', ''), ''), c -> c <> ''), c -> CAST(c AS BIGINT))"


def _into(text: str, digits: str) -> str:
    """The digits of ``text`` replaced, in order, by a list of as many; all else stays."""
    return _let("gap", f"split({text}, '[0-9]', -1)",
                _let("new", digits, "concat(array_join(transform(new, (d, i) -> concat(gap[i], CAST(d AS STRING))), ''), element_at(gap, -1))"))


def _luhn(digits: str) -> str:
    """Luhn sum of a digit list whose last digit is the check digit."""
    return (f"aggregate(reverse({digits}), named_struct('s', 0L, 'i', 0), (s, d) -> named_struct('s', "
            "s.s + IF(s.i % 2 = 0, d, IF(d * 2 > 9, d * 2 - 9, d * 2)), 'i', s.i + 1), s -> s.s)")


def _mod97(text: str) -> str:
    """Remainder by 97 of a string of digits and letters (A = 10 ...)."""
    return (f"aggregate(filter(split({text}, ''), c -> c <> ''), 0L, (s, c) -> IF(c BETWEEN '0' AND '9', "
            "(s * 10 + ascii(c) - 48) % 97, (s * 100 + ascii(c) - 55) % 97))")


def _same_class(text: str, kind: str, key: str, hexadecimal: str = "false") -> str:
    """Letters stay letters of their case and digits digits; other characters stay."""
    lower = f"IF({hexadecimal}, 6L, 26L)"
    chars = f"filter(split({text}, ''), c -> c <> '')"
    base = "CASE WHEN c BETWEEN '0' AND '9' THEN 48 WHEN c BETWEEN 'a' AND 'z' THEN 97 WHEN c BETWEEN 'A' AND 'Z' THEN 65 ELSE -1 END"
    radix = f"CASE WHEN c BETWEEN '0' AND '9' THEN 10L WHEN c BETWEEN 'a' AND 'z' THEN {lower} WHEN c BETWEEN 'A' AND 'Z' THEN 26L ELSE 1L END"
    vals = f"transform(cs, c -> IF(({base}) < 0, 0L, CAST(ascii(c) - ({base}) AS BIGINT)))"
    fed = _feistel(vals, f"transform(cs, c -> {radix})", kind, key)
    return _let("cs", chars, _let("pv", fed, "array_join(transform(cs, (c, i) -> IF((" + base + ") < 0, c, chr((" + base + ") + pv[i]))), '')"))


def _date(parsed: str, shown: str, key: str, day_first: bool = False) -> str:
    """A valid date to another of the same 400 years, shown in its format; others are left as they are.

    ``day_first``: for dates that only read as day before month, that is of a
    day above 12. The permutation is walked on until it meets such a date again."""
    part = f"pmod(dd, {CYCLE}L)"
    fed = _feistel(f"array({part} div {LOW}, {part} % {LOW})", f"array({HIGH}L, {LOW}L)", "date", key)
    step = _let("dv", fed, f"dd - {part} + dv[0] * {LOW} + dv[1]")
    start = f"CAST(datediff({parsed}, {EPOCH}) AS BIGINT)"
    if day_first:
        # a walk of 64 steps that meets none has a chance below 1e-25
        moved = (f"aggregate(sequence(1, 64), {start}, (dd, di) -> IF(di > 1 AND day(date_add({EPOCH}, CAST(dd AS INT))) > 12, dd, {step}))")
    else:
        moved = _let("dd", start, step)
    # a year below 1000 or above 9999 would change the format; the cycles 1600-2399 hold no such date
    return (f"IF({parsed} IS NULL OR {parsed} NOT BETWEEN {EPOCH} AND DATE'2400-02-29', m, "
            f"date_format(date_add({EPOCH}, CAST({moved} AS INT)), '{shown}'))")


def pseudonym(key: str) -> str:
    """SQL for the pseudonym of a match ``m``, a password if ``p`` is not empty; a value that does not validate stays as it is."""
    if not key or not all(c.isalnum() or c in "-_." for c in key):
        raise ValueError("the key must be of letters, digits, '-', '_' and '.'")
    # all but the top-level domain: a short name alone has too few others to hide among
    email = "concat(" + _same_class("regexp_extract(m, '^(.*)[.][^.]*$', 1)", "email", key) + ", regexp_extract(m, '([.][^.]*)$', 1))"
    secret = f"IF(m LIKE 'AKIA%', concat('AKIA', {_same_class('substr(m, 5)', 'secret', key)}), " + _same_class(
        "m", "secret", key, "m RLIKE '^[0-9a-f]+$'") + ")"
    fed = _feistel("slice(cd, 2, size(cd) - 2)", "transform(sequence(1, size(cd) - 2), z -> 10L)", "card", key)
    paid = f"concat(slice(cd, 1, 1), {fed})"
    card = _let("cd", _digits("m"), f"IF({_luhn('cd')} % 10 <> 0, m, " + _into("m", _let(
        "pay", paid, f"concat(pay, array(pmod(-{_luhn('concat(pay, array(0L))')}, 10L)))")) + ")")
    # the letters that begin the account (a bank's name) stay; blanks are taken out and set again after every four
    body = "regexp_extract(s, '^....([A-Z]*)', 1)"
    check = "lpad(CAST(98 - " + _mod97("concat(nb, substr(s, 1, 2), '00')") + " AS STRING), 2, '0')"
    number = _let("nb", f"concat({body}, " + _same_class(f"substr(s, 5 + length({body}))", "iban", key) + ")", f"concat(substr(s, 1, 2), {check}, nb)")
    # in groups of four that are no IBAN there can be a card
    inside = "regexp_extract(f, '(?<![0-9A-Z])[0-9](?: ?[0-9]){12,18}+(?![0-9A-Z])', 0)"
    other = _let("f", "m", _let("m", inside, f"IF(m = '', f, replace(f, m, {card}))"))
    iban = _let("s", "replace(m, ' ', '')", f"CASE WHEN {_mod97('concat(substr(s, 5), substr(s, 1, 4))')} = 1 THEN "
                + _let("ib", number, "IF(instr(m, ' ') > 0, trim(regexp_replace(ib, '(.{4})', '$1 ')), ib)")
                + f" WHEN instr(m, ' ') > 0 THEN {other} ELSE m END")
    date = ("CASE WHEN m RLIKE '^....-' THEN " + _date("try_to_date(m, 'yyyy-MM-dd')", "yyyy-MM-dd", key)
            + " WHEN m LIKE '%/%' AND substr(m, 1, 2) > '12' THEN " + _date("try_to_date(m, 'dd/MM/yyyy')", "dd/MM/yyyy", key, day_first=True)
            + " WHEN m LIKE '%/%' THEN " + _date("try_to_date(m, 'MM/dd/yyyy')", "MM/dd/yyyy", key)
            + " ELSE " + _date("try_to_date(m, 'dd.MM.yyyy')", "dd.MM.yyyy", key) + " END")
    octets = "transform(split(m, '[.]'), o -> CAST(o AS BIGINT))"
    ip = (f"IF(exists({octets}, o -> o > 255) OR m RLIKE '(^|[.])0[0-9]', m, array_join(transform("
          + _feistel(octets, "array(256L, 256L, 256L, 256L)", "ip", key) + ", x -> CAST(x AS STRING)), '.'))")
    area, group, serial = (f"CAST(substr(m, {a}, {n}) AS BIGINT)" for a, n in ((1, 3), (5, 2), (8, 4)))
    fed = _feistel(f"array({area} - IF({area} > 666, 2L, 1L), {group} - 1, {serial} - 1)", "array(898L, 99L, 9999L)", "ssn", key)
    ssn = (f"IF({area} IN (0, 666) OR {area} >= 900 OR {group} = 0 OR {serial} = 0, m, " + _let(
        "sv", fed, "concat_ws('-', lpad(CAST(sv[0] + IF(sv[0] >= 665, 2, 1) AS STRING), 3, '0'), "
        "lpad(CAST(sv[1] + 1 AS STRING), 2, '0'), lpad(CAST(sv[2] + 1 AS STRING), 4, '0'))") + ")")
    # a country code stays: the digits up to the first separator after a plus sign, or what ten digits leave over. A
    # national number of ten digits keeps its first digit within 2-9 or within 0-1.
    count = ("IF(m LIKE '+%', IF(m RLIKE '^[+][0-9]{1,3}[^0-9]', size(pd) - length(regexp_extract(m, '^[+]([0-9]+)', 1)), "
             "least(10, size(pd) - 1)), size(pd))")
    first = "IF(pn = 10 AND pd[size(pd) - 10] > 1, 2L, 0L)"
    fed = _feistel("transform(slice(pd, -pn, pn), (x, i) -> IF(i = 0, x - pf, x))",
                   "transform(sequence(1, pn), i -> IF(i = 1 AND pn = 10, IF(pf = 2, 8L, 2L), 10L))", "phone", key)
    moved = f"concat(slice(pd, 1, size(pd) - pn), transform({fed}, (x, i) -> IF(i = 0, x + pf, x)))"
    phone = _let("pd", _digits("m"), "IF(size(pd) < 8 OR size(pd) > 15, m, " + _let("pn", count, _let("pf", first, _into("m", moved))) + ")")
    shown = {"email": email, "secret": secret, "iban": iban, "date": date, "ip": ip, "ssn": ssn, "phone": phone, "card": card}
    cases = " ".join(f"WHEN {kind_is(k)} THEN {shown[k]}" for k in PATTERNS)
    return f"CASE {cases} ELSE m END"


def kind_is(kind: str) -> str:
    """SQL test of a match ``m`` for a kind, given that the kinds before it have been tested; ``p`` is the match if it was found as a password, else empty."""
    return {
        "email": "instr(m, '@') > 0",
        "secret": "p <> '' OR m RLIKE '^(AKIA[0-9A-Z]{16}|(?=.*[0-9])(?=.*[a-z])[0-9a-f]{32,64})$'",
        "iban": "m RLIKE '^[A-Z]{2}[0-9]{2}'",
        "date": "m RLIKE '^([0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}[.][0-9]{2}[.][0-9]{4}|[0-9]{2}/[0-9]{2}/[0-9]{4})$'",
        "ip": "m RLIKE '^[0-9]+[.][0-9]+[.][0-9]+[.][0-9]+$' AND length(m) < 16 AND m NOT RLIKE '[0-9]{4}'",
        "ssn": "m RLIKE '^[0-9]{3}-[0-9]{2}-[0-9]{4}$'",
        "phone": "m RLIKE '^([(+]|[0-9]{3}[.-][0-9]{3}[ .-]?[0-9]{4}$)'",
        "card": "m RLIKE '^[0-9][0-9 -]+$'",
    }[kind]


def pseudonymise(docs: DataFrame, *, key: str, text: str = "text", count: str | None = None) -> DataFrame:
    """``docs`` with the column ``text`` pseudonymised in place; all other columns and all rows stay.

    Cards (Luhn), IBANs (mod 97), social security numbers, IP addresses,
    phone numbers and dates are validated and permuted among the valid values
    of their format by a keyed Feistel network; e-mail addresses (but for the
    top-level domain) and secrets are permuted letter by letter within their classes. The permutation depends on ``key`` and kind
    only, so equal values get equal pseudonyms in all documents and different
    values different ones. IBANs are found in one piece, and in groups of four if their country is in
    ``IBAN_LENGTHS``; other blanks and dashes in them, small letters, and dates with month names or single figures are not looked
    for. What does not validate stays as it is.

    ``count`` names a column to add with the number of values replaced. Null
    and empty texts stay; texts without a digit, an at sign, ``password=`` and
    ``AKIA`` are not searched. No join, shuffle or Python: each row is worked on alone."""
    t = f"`{text.replace('`', '``')}`"
    pattern = PATTERN.replace("\\", "\\\\").replace("'", "\\'")
    pieces = f"split({t}, '{pattern}', -1)"
    matches = f"regexp_extract_all({t}, '{pattern}', 0)"
    joined = _let("found", matches, _let(
        "gaps", pieces, "_let_named"))
    body = ("named_struct('t', concat(array_join(transform(news, (n, j) -> concat(gaps[j], n)), ''), element_at(gaps, -1)), "
            "'n', size(filter(zip_with(news, found, (n, f) -> n <> f), x -> x)))")
    passwords = f"IF(instr({t}, 'password=') > 0, regexp_extract_all({t}, '{pattern}', {PASSWORD}), transform(found, m -> ''))"
    joined = joined.replace("_let_named", _let("news", f"zip_with(found, {passwords}, (m, p) -> {pseudonym(key)})", body))
    same = f"named_struct('t', {t}, 'n', 0)"
    work = f"IF({t} RLIKE '{HINT}', {joined}, {same})"
    # the whole row travels as one struct, so no column of it can clash;
    # explode of the one-element list keeps the rewrite from being computed once for each column that reads it
    made = docs.select(F.struct("*").alias("row"), F.explode(F.array(F.expr(work))).alias("made"))
    out = [(F.col("made.t") if c == text else F.col("row").getField(c)).alias(c) for c in docs.columns]
    extra = [] if count is None else [F.coalesce("made.n", F.lit(0)).cast("long").alias(count)]
    return made.select(*out, *extra)
