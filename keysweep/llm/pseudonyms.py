"""Format-preserving pseudonyms: validated numbers and dates go through keyed Feistel networks within their format.

All is done by built-in expressions. Equal values get equal pseudonyms in all documents under the same key, different values of a
format get different ones, and each pseudonym passes the check that its original passed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Even, so that the parts of unequal sizes come back to their places.
ROUNDS = 10

EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)++"
IPV4 = r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?![\d]|\.\d)"
ISO_DATE = r"(?<![\d-])(?:19|20)\d{2}-\d{2}-\d{2}(?![\d-])"
DAY_FIRST = r"(?<![\d./])\d{2}([./])\d{2}\1(?:19|20)\d{2}(?![\d]|[./]\d)"
SOCIAL = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
PHONE = r"\+\d(?:[ ()-]{0,2}\d){7,14}(?!\d)"
#: Plain, or in groups of four, or of 4, 6 and 4 to 5.
CARD = r"(?<![\d+.-])(?:\d{13,19}|\d{4}([ -])\d{4}\3\d{4}\3\d{1,7}|\d{4}([ -])\d{6}\4\d{4,5})(?![\d]|[.-]\d)"
#: What every value holds; most texts do not.
_GATE = r"@|[0-9][0-9 ()./-]{5,}[0-9]"
#: In the order in which they are tried at a place.
VALUES = "|".join((EMAIL, IPV4, ISO_DATE, DAY_FIRST.replace(r"\1", r"\2"), SOCIAL, PHONE, CARD))
_PATTERN = f"({VALUES})"

#: Days from 1900-01-01 to 2099-12-31: 73,049 = 17 * 4,297.
_DAYS = (17, 4297)


def _mix(key: str, kind: str, step: Column, x: Column) -> Column:
    """60 keyed bits that depend on format, round and number."""
    digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), step.cast("string"), x.cast("string"), F.lit(key)), 256)
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def feistel(a: Column, b: Column, size_a: Column, size_b: Column, key: str, kind: str) -> Column:
    """A permutation of the pairs ``a < size_a, b < size_b``: each round adds a keyed function of one part to the other."""
    start = F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))

    def step(acc: Column, i: Column) -> Column:
        even = i % 2 == 0
        return F.struct(
            F.when(even, F.pmod(acc["a"] + _mix(key, kind, i, acc["b"]), size_a)).otherwise(acc["a"]).cast("long").alias("a"),
            F.when(even, acc["b"]).otherwise(F.pmod(acc["b"] + _mix(key, kind, i, acc["a"]), size_b)).cast("long").alias("b"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step)


def _power(n: Column) -> Column:
    return F.rpad(F.lit("1"), n + 1, "0").cast("long")


def _permuted_digits(digits: Column, key: str, kind: str) -> Column:
    """2 to 36 digits as so many other digits."""
    n = F.length(digits)
    left = F.floor(n / 2).cast("int")
    right = n - left
    a, b = F.substring(digits, F.lit(1), left).cast("long"), F.substring(digits, left + 1, right).cast("long")
    out = feistel(a, b, _power(left), _power(right), key, kind)
    return _let(out, lambda p: F.concat(F.lpad(p["a"].cast("string"), left, "0"), F.lpad(p["b"].cast("string"), right, "0")))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def luhn_sum(digits: Column) -> Column:
    """Sum of the Luhn check, the last digit being the check digit."""
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when((n - i) % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add)


def _laid_over(value: Column, digits: Column) -> Column:
    """``digits`` in the places of the digits of ``value``, whose other characters stay."""
    marks = F.split(value, "")
    at = F.length(F.regexp_replace(value, "[^0-9]", ""))

    def place(acc: Column, c: Column) -> Column:
        is_digit = c.rlike("[0-9]")
        return F.struct(F.concat(acc["s"], F.when(is_digit, F.substring(digits, acc["i"], F.lit(1))).otherwise(c)).alias("s"),
                        (acc["i"] + F.when(is_digit, 1).otherwise(0)).alias("i"))

    first = F.struct(F.lit("").alias("s"), F.lit(1).alias("i"))
    return F.when(at > 0, F.aggregate(marks, first, place)["s"]).otherwise(value)


def _card(value: Column, key: str) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    body = F.substring(digits, F.lit(1), F.length(digits) - 1)
    changed = _let(_permuted_digits(body, key, "card"), lambda b: F.concat(
        b, F.pmod(10 - luhn_sum(F.concat(b, F.lit("0"))) % 10, F.lit(10)).cast("string")))
    return F.when(luhn_sum(digits) % 10 == 0, _let(changed, lambda d: _laid_over(value, d)))


def _phone(value: Column, key: str) -> Column:
    """The first three digits (country) stay."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    changed = F.concat(F.left(digits, F.lit(3)), _permuted_digits(F.substring(digits, F.lit(4), F.length(digits)), key, "phone"))
    return _let(changed, lambda d: _laid_over(value, d))


def _ip(value: Column, key: str) -> Column:
    parts = F.split(value, "\\.")
    valid = F.forall(parts, lambda p: (p.cast("int") <= 255) & (p.cast("int").cast("string") == p))
    at = lambda i: F.element_at(parts, i).cast("long")
    two = F.lit(65536).cast("long")
    new = feistel(at(1) * 256 + at(2), at(3) * 256 + at(4), two, two, key, "ip")
    shown = lambda p: F.concat_ws(".", *(x.cast("string") for h in ("a", "b") for x in (F.shiftright(p[h], 8), p[h] % 256)))
    return F.when(valid, _let(new, shown))


def _date(value: Column, form: str, key: str) -> Column:
    first = F.lit("1900-01-01").cast("date")
    iso = value if form == "yyyy-MM-dd" else F.concat_ws("-", F.substring(value, 7, 4), F.substring(value, 4, 2), F.substring(value, 1, 2))
    day = iso.try_cast("date")
    n = F.date_diff(day, first).cast("long")
    a, b = (F.lit(s).cast("long") for s in _DAYS)
    new = feistel(F.floor(n / _DAYS[1]), n % _DAYS[1], a, b, key, "date")
    back = lambda p: F.date_add(first, (p["a"] * _DAYS[1] + p["b"]).cast("int"))
    shown = _let(new, lambda p: F.date_format(back(p), "yyyy-MM-dd"))
    if form != "yyyy-MM-dd":
        mark = F.substring(value, 3, 1)
        shown = _let(shown, lambda s: F.concat(F.substring(s, 9, 2), mark, F.substring(s, 6, 2), mark, F.substring(s, 1, 4)))
    return F.when(day.isNotNull(), shown)


def _social(value: Column, key: str) -> Column:
    """Areas 001 to 899 but 666, groups 01 to 99, serials 0001 to 9999."""
    area, group, serial = (F.substring(value, i, n).cast("long") for i, n in ((1, 3), (5, 2), (8, 4)))
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    index = (area - F.when(area > 666, 2).otherwise(1)) * 99 + group - 1
    new = feistel(index, serial - 1, F.lit(898 * 99).cast("long"), F.lit(9999).cast("long"), key, "social")

    def shown(p: Column) -> Column:
        area = F.floor(p["a"] / 99) + 1
        area = area + F.when(area >= 666, 1).otherwise(0)
        pad = lambda x, n: F.lpad(x.cast("string"), n, "0")
        return F.concat_ws("-", pad(area, 3), pad(p["a"] % 99 + 1, 2), pad(p["b"] + 1, 4))

    return F.when(valid, _let(new, shown))


def _email(value: Column, key: str) -> Column:
    """The name before the at sign as so many letters of a keyed digest, at least 12; the domain stays."""
    name = F.substring_index(value, "@", 1)
    digest = F.translate(F.sha2(F.concat_ws("|", F.lit(key), F.lit("mail"), F.lower(value), F.lit(key)), 256), "0123456789abcdef", "ghijklmnopqrstuv")
    return F.concat(F.left(digest, F.least(F.lit(64), F.greatest(F.lit(12), F.length(name)))), F.lit("@"), F.substring_index(value, "@", -1))


def pseudonym(value: Column, key: str) -> Column:
    """The pseudonym of one value; null if the value is not valid in any format."""
    full = lambda p: value.rlike(f"^(?:{p})$")
    kinds = F.when(F.contains(value, F.lit("@")), _email(value, key)) \
        .when(full(r"\d{1,3}(?:\.\d{1,3}){3}"), _ip(value, key)) \
        .when(full(r"\d{4}-\d{2}-\d{2}"), _date(value, "yyyy-MM-dd", key)) \
        .when(full(r"\d{2}[./]\d{2}[./]\d{4}"), _date(value, "dd/MM/yyyy", key)) \
        .when(full(r"\d{3}-\d{2}-\d{4}"), _social(value, key)) \
        .when(F.startswith(value, F.lit("+")), _phone(value, key))
    return kinds.otherwise(_card(value, key))


def pseudonymise(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``id, text, n_values``, with every validated value of the text replaced.

    Values are card numbers (13 to 19 digits that pass the Luhn check, with single blanks or hyphens), IPv4 addresses, dates from 1900 to
    2099 (``yyyy-mm-dd``, or day first with points or slashes), US social security numbers, and telephone numbers with a plus sign. What
    looks like one but is not valid stays. Addresses of mail have no number format: their names become a keyed
    digest. ``n_values`` counts what was replaced. Whole texts are read; null stays null, with 0 values, empty texts stay empty.
    Repeated rows and null ids are kept as they are. Only the two columns are read; nothing is shuffled.
    Who holds ``key`` can undo the permutations: keep it like a password.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"))
    found = F.when(F.col("t").rlike(_GATE), F.regexp_extract_all("t", F.lit(_PATTERN), F.lit(1)))
    rows = rows.withColumn("found", F.coalesce(found, F.array().cast("array<string>")))
    changed = F.transform("found", lambda v: F.struct(v.alias("old"), pseudonym(v, key).alias("new")))
    rows = rows.withColumn("new", F.when(F.size("found") > 0, changed).otherwise(F.array().cast("array<struct<old:string,new:string>>")))
    pieces = F.zip_with(F.split("t", _PATTERN, -1), "new", lambda rest, v: F.concat(
        rest, F.coalesce(v["new"], v["old"], F.lit(""))))
    text = F.when(F.size("new") > 0, F.array_join(pieces, "")).otherwise(F.col("t"))
    return rows.select("id", text.alias("text"), F.size(F.filter("new", lambda v: v["new"].isNotNull())).cast("long").alias("n_values"))
