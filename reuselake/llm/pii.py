"""Personal data: format-preserving Feistel pseudonyms, in DataFrame operations only.

Numbers and dates that pass their validity test are permuted under a key within their own format, so that a pseudonym is as valid as the value
and equal values stay equal across documents; without the key it cannot be undone. Numbers that fail the test are left alone.

A value is two parts (a, b) of sizes (A, B); rounds add a keyed hash of one part to the other, modulo its size. That is a
permutation of A * B values whatever the hash is. Digit strings take powers of ten; dates of the 400-year calendar cycle
1800 to 2199 are 146,097 = 189 * 773 days, whatever form a date is written in; addresses are 65,536 * 65,536. Local parts of mail addresses are replaced by a keyed name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reuselake.llm.common import empty_if_null, let

ROUNDS = 8
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
_MONTH = "(?i:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)"
_YEAR = "(?:1[89]|2[01])[0-9]{2}"
#: Characters of an account number after country and check digits.
IBAN = {
    11: "NO", 12: "BE", 14: "DK FI FO GL NL FK SD", 15: "MK SI", 16: "AT BA EE KZ LT LU XK MN", 17: "CH CR HR LI LV", 18: "BG BH DE GB GE IE ME RS VA", 19: "AE GI IL IQ OM TL SO",
    20: "AD CZ ES MD PK RO SA SE SK TN VG", 21: "LY PT ST", 22: "IS TR", 23: "FR GR IT MC MR SM BI DJ", 24: "AL AZ BY CY DO GT HU LB NI PL SV", 25: "BR EG PS QA UA", 26: "JO KW MU YE", 27: "MT SC", 28: "LC", 29: "RU",
}
#: Forms of personal data, tried from the top at every place of a text.
FORMS = {
    "email": r"[A-Za-z0-9À-ɏ._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,8}",
    "secret": r"(?<![0-9A-Za-z])(?:[0-9a-f]{8}){4,8}(?![0-9A-Za-z])",
    "date": rf"(?<![0-9/.-]){_YEAR}-[0-9]{{2}}-[0-9]{{2}}(?![0-9-])|(?<![0-9/.-])[0-9]{{1,2}}(?:\.[0-9]{{1,2}}\.|/[0-9]{{1,2}}/|-[0-9]{{1,2}}-){_YEAR}(?![0-9/-]|\.[0-9])"
    rf"|(?<![0-9/.-])[0-9]{{1,2}} {_MONTH}\.?,? {_YEAR}(?![0-9])|(?<![A-Za-z]){_MONTH}\.? [0-9]{{1,2}},? {_YEAR}(?![0-9])",
    "phone": r"(?<![0-9A-Za-z])\+[0-9]{1,3} ?\([0-9]{3}\) ?[0-9]{3}[- ]?[0-9]{4}(?![0-9])|(?<![0-9A-Za-z])\+[1-9][0-9]{0,2}(?:[ .-]?\(?[0-9]{1,4}\)?){2,6}(?![0-9])"
    r"|(?<![0-9A-Za-z.-])(?:\([0-9]{3}\) ?[0-9]{3}[-. ]|[0-9]{3}-[0-9]{3}-|[0-9]{3}\.[0-9]{3}\.)[0-9]{4}(?![-.]?[0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9.]*[0-9])",
    "iban": "(?<![0-9A-Za-z])(?:" + "|".join(rf"(?:{c.replace(' ', '|')})[0-9]{{2}}(?: ?[A-Z0-9]){{{n}}}" for n, c in IBAN.items()) + ")(?![0-9A-Za-z])",
}
#: A whole run of digit groups, up to where another form begins; the cards in it are found by their check sums.
FORMS["card"] = rf"(?<![0-9])(?=(?:[ -]?[0-9]){{13}})[0-9]++(?:[ -](?!{'|'.join(FORMS.values())})[0-9]++)*+"
ANY = "|".join(f"(?:{p})" for p in FORMS.values())
_EMPTY_DAY = "1800-01-01"
_A_DAYS, _B_DAYS = 189, 773


def _noise(key: str, tag: str, i: Column, other: Column) -> Column:
    """Keyed 56-bit number."""
    return F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(key), F.lit(tag), i, other), 256), 1, 14), 16, 10).cast("long")


def feistel(a: Column, b: Column, size_a: Column, size_b: Column, key: str, tag: str) -> Column:
    """Struct (a, b) permuted; parts are longs below their sizes."""
    def turn(state: Column, i: Column) -> Column:
        new_a = F.pmod(state["a"] + F.pmod(_noise(key, tag, i, state["b"]), size_a), size_a)
        new_b = F.pmod(state["b"] + F.pmod(_noise(key, tag, i, state["a"]), size_b), size_b)
        return F.struct(F.when(i % 2 == 0, new_a).otherwise(state["a"]).alias("a"), F.when(i % 2 == 1, new_b).otherwise(state["b"]).alias("b"))

    start = F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn)


def _digits(digits: Column, key: str, tag: str) -> Column:
    """Permuted digit string of the same length (2 to 36)."""
    half = F.floor(F.length(digits) / 2).cast("int")
    rest = F.length(digits) - half
    size = lambda n: F.rpad(F.lit("1"), n + 1, "0").cast("long")
    a, b = F.substring(digits, F.lit(1), half), F.substring(digits, half + 1, rest)
    mixed = feistel(a, b, size(half), size(rest), key, tag)
    return let(mixed, lambda m: F.concat(F.lpad(m["a"].cast("string"), half, "0"), F.lpad(m["b"].cast("string"), rest, "0")))


def _in_place(form: Column, digits: Column) -> Column:
    """``form`` with its digits replaced in order; all other characters stay."""
    def step(acc: Column, ch: Column) -> Column:
        is_digit = ch.rlike("[0-9]")
        return F.struct(
            F.concat(acc["s"], F.when(is_digit, F.substring(digits, acc["i"], F.lit(1))).otherwise(ch)).alias("s"), (acc["i"] + F.when(is_digit, 1).otherwise(0)).alias("i"),
        )
    return F.aggregate(F.split(form, ""), F.struct(F.lit("").alias("s"), F.lit(1).alias("i")), step, lambda acc: acc["s"])


def _check_sum(digits: Column, doubled_first: bool) -> Column:
    """Sum of the card check rule, read from the end; ``doubled_first``: the last digit counts double."""
    reverse = F.split(F.reverse(digits), "")
    def value(ch: Column, i: Column) -> Column:
        d = ch.cast("int")
        double = F.when(2 * d > 9, 2 * d - 9).otherwise(2 * d)
        return F.when(i % 2 == (0 if doubled_first else 1), double).otherwise(d)
    return F.aggregate(F.transform(F.filter(reverse, lambda c: c != ""), value), F.lit(0), lambda acc, v: acc + v)


def _only_digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _rest_97(chars: Column) -> Column:
    """Remainder by 97 of letters and digits, letters counting 10 to 35."""
    def step(acc: Column, ch: Column) -> Column:
        n = F.conv(ch, 36, 10).cast("long")
        return (acc * F.when(n > 9, 100).otherwise(10) + n) % 97
    return F.aggregate(F.filter(F.split(chars, ""), lambda c: c != ""), F.lit(0).cast("long"), step)


def _date_parts(value: Column) -> tuple[Column, Column, Column]:
    """(is year first, is day first, day or null) of a date in any of its forms."""
    numbers = F.regexp_extract_all(value, F.lit("[0-9]+"), F.lit(0))
    number = lambda i: F.get(numbers, F.lit(i))
    name = F.substring(F.lower(F.regexp_extract(value, "[A-Za-z]+", 0)), 1, 3)
    named, iso = name != "", value.rlike("^[0-9]{4}")
    # with slashes the month comes first unless it cannot be one
    day_first = F.when(value.contains("/"), number(0).cast("int") > 12).otherwise(~iso)
    month = F.when(named, F.array_position(F.array(*map(F.lit, MONTHS)), name).cast("string")).when(iso | day_first, number(1)).otherwise(number(0))
    day = F.when(named, number(0)).when(iso, number(2)).when(day_first, number(0)).otherwise(number(1))
    year = F.when(named, number(1)).when(iso, number(0)).otherwise(number(2))
    return iso, day_first, F.try_to_date(F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0")), "yyyy-MM-dd")


def _like(value: Column, date: Column) -> Column:
    """``date`` written as ``value`` is: order, separators, zeros in front, length of the month's name."""
    iso, day_first, _ = _date_parts(value)
    zeros = value.rlike("^(?:[A-Za-z.]+ )?[0-9]{2}(?:[./-][0-9]{2}[./-]| )") | value.rlike("^[A-Za-z.]+ [0-9]{2},? ")
    number = lambda n: F.when(zeros, F.lpad(n.cast("string"), 2, "0")).otherwise(n.cast("string"))
    day, month, year = number(F.dayofmonth(date)), number(F.month(date)), F.lpad(F.year(date).cast("string"), 4, "0")
    name = F.regexp_extract(value, "[A-Za-z]+", 0)
    long_names = F.array(*(F.lit(x) for x in ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")))
    full = F.get(long_names, F.month(date) - 1)
    word = F.when(F.length(name) > 4, full).otherwise(F.substring(full, 1, 3))
    sep = F.regexp_extract(value, "[./-]", 0)
    tail = F.when(value.contains(","), ", ").otherwise(" ")
    return (
        F.when(iso, date.cast("string"))
        .when(value.rlike("^[A-Za-z]"), F.concat(word, F.lit(" "), day, tail, year))
        .when(name != "", F.concat(day, F.lit(" "), word, tail, year))
        .when(day_first, F.concat(day, sep, month, sep, year)).otherwise(F.concat(month, sep, day, sep, year))
    )


def valid(kind: str, value: Column) -> Column:
    digits = _only_digits(value)
    if kind == "card":
        return _check_sum(digits, False) % 10 == 0
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda x: x.cast("int") <= 255)
    if kind == "date":
        return _date_parts(value)[2].isNotNull()
    if kind == "phone":
        return F.length(digits).between(8, 15)
    if kind == "iban":
        chars = F.replace(value, F.lit(" "), F.lit(""))
        return _rest_97(F.concat(F.substring(chars, F.lit(5), F.length(chars)), F.substring(chars, 1, 4))) == 1
    if kind == "ssn":
        return ~F.substring(digits, 1, 3).isin("000", "666") & (F.substring(digits, 1, 1) != "9") & (F.substring(digits, 4, 2) != "00") & (F.substring(digits, 6, 4) != "0000")
    return F.lit(True)


def pseudonym(kind: str, value: Column, key: str) -> Column:
    digits = _only_digits(value)
    if kind == "email":
        name = F.concat(F.lit("u"), F.substring(F.sha2(F.concat_ws(":", F.lit(key), F.lit(kind), F.lower(value)), 256), 1, 15))
        return F.concat(name, F.lit("@example.com"))
    if kind == "secret":
        def block(i: Column) -> Column:
            part = lambda at: F.conv(F.substring(value, 8 * i + at, F.lit(4)), 16, 10)
            mixed = feistel(part(1), part(5), F.lit(1 << 16), F.lit(1 << 16), key, kind)
            four = lambda x: F.lpad(F.lower(F.conv(x.cast("string"), 10, 16)), 4, "0")
            return let(mixed, lambda m: F.concat(four(m["a"]), four(m["b"])))
        return F.array_join(F.transform(F.sequence(F.lit(0), F.floor(F.length(value) / 8).cast("int") - 1), block), "")
    if kind == "date":
        day = F.datediff(_date_parts(value)[2], F.lit(_EMPTY_DAY).cast("date"))
        mixed = feistel(F.floor(day / _B_DAYS), day % _B_DAYS, F.lit(_A_DAYS), F.lit(_B_DAYS), key, kind)
        return let(mixed, lambda m: let(F.date_add(F.lit(_EMPTY_DAY).cast("date"), (m["a"] * _B_DAYS + m["b"]).cast("int")), lambda d: _like(value, d)))
    if kind == "ip":
        part = lambda i: F.get(F.split(value, r"\."), F.lit(i)).cast("long")
        mixed = feistel(256 * part(0) + part(1), 256 * part(2) + part(3), F.lit(1 << 16), F.lit(1 << 16), key, kind)
        whole = lambda x: [F.floor(x / 256), x % 256]
        return let(mixed, lambda m: F.concat_ws(".", *(x.cast("string") for x in (*whole(m["a"]), *whole(m["b"])))))
    if kind == "card":  # all but the check digit is permuted, the check digit follows
        body = _digits(F.substring(digits, F.lit(1), F.length(digits) - 1), key, kind)
        return let(body, lambda x: _in_place(value, F.concat(x, ((10 - _check_sum(x, True) % 10) % 10).cast("string"))))
    if kind == "phone":  # the country code stays
        apart = F.regexp_extract(value, r"^\+([0-9]{1,3})(?![0-9])", 1)
        kept = F.when(~value.startswith("+"), 0).when(apart != "", F.length(apart)).when(digits.rlike("^[17]"), 1).otherwise(2)
        number = _digits(F.substring(digits, kept + 1, F.length(digits) - kept), key, kind)
        return let(number, lambda x: _in_place(value, F.concat(F.substring(digits, F.lit(1), kept), x)))
    if kind == "iban":  # country and letters stay, the check digits follow
        new = let(_digits(F.substring(digits, F.lit(3), F.length(digits) - 2), key, kind), lambda x: _in_place(value, F.concat(F.lit("00"), x)))
        def checked(x: Column) -> Column:
            chars = F.replace(x, F.lit(" "), F.lit(""))
            check = 98 - _rest_97(F.concat(F.substring(chars, F.lit(5), F.length(chars)), F.substring(chars, 1, 4)))
            return F.concat(F.substring(x, 1, 2), F.lpad(check.cast("string"), 2, "0"), F.substring(x, F.lit(5), F.length(x)))
        return let(new, checked)
    # ssn: group and serial, which must not be zero, and the area, which has forbidden values, stay valid: only non-zero group and serial move
    a, b = F.substring(digits, 4, 2).cast("long") - 1, F.substring(digits, 6, 4).cast("long") - 1
    mixed = feistel(a, b, F.lit(99), F.lit(9999), key, kind)
    return let(mixed, lambda m: F.concat(F.substring(digits, 1, 3), F.lit("-"), F.lpad((m["a"] + 1).cast("string"), 2, "0"), F.lit("-"), F.lpad((m["b"] + 1).cast("string"), 4, "0")))


def _cards(run: Column, key: str) -> Column:
    """Struct (kind, text, n) of a run of digit groups: spans of whole groups of 13 to 19 digits that pass the sum are cards. Of spans that
    overlap the longest counts, of equally long ones the first."""
    def spans(groups: Column) -> Column:  # per group the number of groups of the longest card that begins there, and its digits
        def at(i: Column) -> Column:
            def longer(best: Column, j: Column) -> Column:
                digits = _only_digits(F.array_join(F.slice(groups, i + 1, j), ""))
                return F.when(F.length(digits).between(13, 19) & (_check_sum(digits, False) % 10 == 0), F.struct(j.alias("m"), F.length(digits).alias("d"))).otherwise(best)
            most = F.least(F.lit(19), F.size(groups) - i)
            return F.aggregate(F.sequence(F.lit(1), most), F.struct(F.lit(0).alias("m"), F.lit(0).alias("d")), longer)
        return F.transform(F.sequence(F.lit(0), F.size(groups) - 1), at)

    def chosen(found: Column) -> Column:  # per group: it begins a card of m groups (m), is inside one (-1) or stays (0)
        def step(acc: Column, i: Column) -> Column:
            own = F.get(found, i)
            beaten = F.exists(F.slice(found, i + 2, F.greatest(own["m"] - 1, F.lit(0))), lambda x: x["d"] > own["d"])
            takes = (i >= acc["next"]) & (own["m"] > 0) & ~beaten
            state = F.when(i < acc["next"], -1).when(takes, own["m"]).otherwise(0)
            return F.struct(F.concat(acc["out"], F.array(state)).alias("out"), F.when(takes, i + own["m"]).otherwise(acc["next"]).alias("next"))
        start = F.struct(F.array().cast("array<int>").alias("out"), F.lit(0).alias("next"))
        return F.aggregate(F.sequence(F.lit(0), F.size(found) - 1), start, step, lambda acc: acc["out"])

    def text(groups: Column, marks: Column) -> Column:
        def piece(m: Column, i: Column) -> Column:
            span = F.array_join(F.slice(groups, i + 1, F.greatest(m, F.lit(1))), "")
            return F.when(m == 0, F.get(groups, i)).when(m < 0, F.lit("")).otherwise(pseudonym("card", span, key))
        n = F.size(F.filter(marks, lambda m: m > 0))
        return F.struct(F.when(n > 0, "card").alias("kind"), F.array_join(F.transform(marks, piece), "").alias("text"), n.alias("n"))

    groups = F.regexp_extract_all(run, F.lit("[ -]?[0-9]+"), F.lit(0))
    return let(groups, lambda g: let(spans(g), lambda f: let(chosen(f), lambda m: text(g, m))))


def _replaced(value: Column, key: str) -> Column:
    """Struct (kind, text, n) of one match; kind is null and the text unchanged if nothing in it is valid."""
    same = F.struct(F.lit(None).cast("string").alias("kind"), value.alias("text"), F.lit(0).alias("n"))
    # a run of digits may have ended where another form begins: it is told by its characters
    out = F.when(value.rlike("^[0-9][0-9 -]*$") & (F.length(_only_digits(value)) > 12) & ~F.regexp_like(value, F.lit(f"^(?:{FORMS['secret']})$")), _cards(value, key))
    for kind, form in FORMS.items():
        if kind != "card":
            # the match was found in its place; alone it is told from the others by its whole form
            new = F.when(valid(kind, value), F.struct(F.lit(kind).alias("kind"), pseudonym(kind, value, key).alias("text"), F.lit(1).alias("n"))).otherwise(same)
            out = out.when(F.regexp_like(value, F.lit(f"^(?:{form})$")), new)
    return out.otherwise(same)


def pseudonymized(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` with pseudonyms in ``text`` and the struct ``_found`` of counts per kind. Null texts stay null, with zero counts."""
    t = empty_if_null()
    matches = F.transform(F.regexp_extract_all(t, F.lit(ANY), F.lit(0)), lambda m: _replaced(m, key))
    some = F.when(t.rlike("[0-9@]"), matches).otherwise(F.array().cast("array<struct<kind:string,text:string,n:int>>"))
    gaps = F.split(t, ANY, -1)
    marked = docs.withColumn("_m", some)
    sewn = F.array_join(F.flatten(F.zip_with(gaps, F.col("_m"), lambda g, m: F.array(g, F.coalesce(m["text"], F.lit(""))))), "")
    count = lambda kind: F.aggregate("_m", F.lit(0), lambda n, m: n + F.when(m["kind"] == kind, m["n"]).otherwise(0)).cast("long")
    text = F.when(F.exists("_m", lambda m: m["kind"].isNotNull()), sewn).otherwise(F.col("text"))
    return marked.select(*(text.alias("text") if c == "text" else F.col(c) for c in docs.columns), F.struct(*(count(k).alias(k) for k in FORMS)).alias("_found"))


def digest(docs: DataFrame, key: str) -> DataFrame:
    out = pseudonymized(docs.select("doc_id", "text"), key)
    return out.select("doc_id", "text", *(F.col(f"_found.{k}").alias(f"n_{k}") for k in FORMS))
