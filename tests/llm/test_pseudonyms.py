import datetime
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from keysweep.llm import pseudonyms as P


def brute(a, b, size_a, size_b, key, kind):
    def mix(step, x):
        return int(hashlib.sha256(f"{key}|{kind}|{step}|{x}|{key}".encode()).hexdigest()[:15], 16)
    for i in range(P.ROUNDS):
        if i % 2 == 0:
            a = (a + mix(i, b)) % size_a
        else:
            b = (b + mix(i, a)) % size_b
    return a, b


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def swap(make_docs, texts, key="k"):
    rows = P.pseudonymise(make_docs(list(enumerate(texts))), key).collect()
    return [(r["text"], r["n_values"]) for r in sorted(rows, key=lambda r: r["id"])]


def test_against_brute_force(make_docs):
    got = swap(make_docs, ["1.2.3.4", "2020-02-29"])
    a, b = brute(1 * 256 + 2, 3 * 256 + 4, 65536, 65536, "k", "ip")
    assert got[0][0] == f"{a >> 8}.{a % 256}.{b >> 8}.{b % 256}"
    n = (datetime.date(2020, 2, 29) - datetime.date(1900, 1, 1)).days
    a, b = brute(n // 4297, n % 4297, 17, 4297, "k", "date")
    assert got[1][0] == str(datetime.date(1900, 1, 1) + datetime.timedelta(a * 4297 + b))


def test_values_keep_their_format_and_links(make_docs):
    got = swap(make_docs, [
        "a 4532015112830366, 4532-0151-1283-0366 4532015112830366 1.2.3.4", "4532015112830367 300.1.1.1 2021-02-29 31/02/2001 000-12-3456",
        "05/06/2001 123-45-6789 x@a.example.com +49 170 1234567", "05/06/2001\n123-45-6789 x@a.example.com +49 170 1234567"])
    text, n = got[0]
    one, two, three, _ = text.removeprefix("a ").replace(",", "").split()
    assert n == 4 and one == three == two.replace("-", "") != "4532015112830366" and luhn(one)
    assert got[1] == ("4532015112830367 300.1.1.1 2021-02-29 31/02/2001 000-12-3456", 0)
    assert got[2][1] == 4 and got[2][0].split() == got[3][0].split() and got[2][0] != "05/06/2001 123-45-6789 x@a.example.com +49 170 1234567"
    assert datetime.datetime.strptime(got[2][0].split()[0], "%d/%m/%Y")


def test_is_a_permutation(spark):
    pairs = spark.range(0, 17 * 4297).select((F.col("id") / 4297).cast("long").alias("a"), (F.col("id") % 4297).alias("b"))
    out = pairs.select(P.feistel(F.col("a"), F.col("b"), F.lit(17).cast("long"), F.lit(4297).cast("long"), "k", "t").alias("p"))
    assert out.distinct().count() == 17 * 4297 == out.where("p.a between 0 and 16 and p.b between 0 and 4296").count()


@pytest.mark.parametrize("rows", [[], [(1, None), (2, ""), (None, "1.2.3.4"), (3, "x" * 500_000), (3, "x" * 500_000)]])
def test_edges(make_docs, rows):
    got = P.pseudonymise(make_docs(rows), "k").collect()
    assert len(got) == len(rows)
    assert sorted((r["id"], r["text"]) for r in got if r["id"] and r["text"]) == [(i, t) for i, t in rows if i and t]


def test_addresses_of_very_many_labels(make_docs):
    labels = "b." * 1_000_000
    (text, n), = swap(make_docs, ["x a@" + labels + "com y"])
    assert n == 1 and text.endswith("@" + labels + "com y") and text.startswith("x ") and not text.startswith("x a@")


def expected(value, key):
    """The pseudonym of a value by the definition, in plain Python; None if it is not valid."""
    def digits(text, kind):
        left = len(text) // 2
        a, b = brute(int(text[:left]), int(text[left:]), 10 ** left, 10 ** (len(text) - left), key, kind)
        return f"{a:0{left}}{b:0{len(text) - left}}"

    def over(new):
        new = iter(new)
        return "".join(next(new) if c.isdigit() else c for c in value)

    def day(text, show):
        try:
            n = (datetime.date.fromisoformat(text) - datetime.date(1900, 1, 1)).days
        except ValueError:
            return None
        a, b = brute(n // 4297, n % 4297, 17, 4297, key, "date")
        return show(datetime.date(1900, 1, 1) + datetime.timedelta(a * 4297 + b))

    plain = "".join(c for c in value if c.isdigit())
    if "@" in value:
        name, domain = value.split("@")
        digest = hashlib.sha256(f"{key}|mail|{value.lower()}|{key}".encode()).hexdigest().translate(str.maketrans("0123456789abcdef", "ghijklmnopqrstuv"))
        return digest[:min(64, max(12, len(name)))] + "@" + domain
    if value.count(".") == 3:
        parts = value.split(".")
        if any(int(p) > 255 or str(int(p)) != p for p in parts):
            return None
        a, b = brute(int(parts[0]) * 256 + int(parts[1]), int(parts[2]) * 256 + int(parts[3]), 65536, 65536, key, "ip")
        return f"{a >> 8}.{a % 256}.{b >> 8}.{b % 256}"
    if len(value) == 10 and value[4] == value[7] == "-":
        return day(value, str)
    if len(value) == 10 and value[2] == value[5] and value[2] in "./":
        return day(f"{value[6:]}-{value[3:5]}-{value[:2]}", lambda d: d.strftime(f"%d{value[2]}%m{value[2]}%Y"))
    if len(value) == 11 and value[3] == value[6] == "-":
        area, group, serial = int(value[:3]), int(value[4:6]), int(value[7:])
        if not 1 <= area <= 899 or area == 666 or not group or not serial:
            return None
        a, b = brute((area - (2 if area > 666 else 1)) * 99 + group - 1, serial - 1, 898 * 99, 9999, key, "social")
        area = a // 99 + 1
        return f"{area + (area >= 666):03}-{a % 99 + 1:02}-{b + 1:04}"
    if value[0] == "+":
        return over(plain[:3] + digits(plain[3:], "phone"))
    if not luhn(plain):
        return None
    body = digits(plain[:-1], "card")
    return over(body + next(c for c in "0123456789" if luhn(body + c)))


def test_every_kind_against_brute_force(make_docs):
    rng = random.Random(11)
    number = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    values = [f"{rng.randrange(300)}.{rng.randrange(260)}.{rng.randrange(256)}.{rng.randrange(256)}" for _ in range(30)]
    for _ in range(30):
        y, m, d = rng.randint(1900, 2099), rng.randint(1, 13), rng.randint(1, 31)
        mark = rng.choice("./")
        values += [f"{y}-{m:02}-{d:02}", f"{d:02}{mark}{m:02}{mark}{y}", f"{rng.randrange(1000):03}-{rng.randrange(100):02}-{rng.randrange(10000):04}",
                   f"+{rng.randint(1, 9)}{number(rng.randint(7, 12))}", f"+49 {number(3)} {number(7)}", f"{rng.choice('abXY')}{number(rng.randrange(20))}@{rng.choice('pq')}.Example.com"]
        for n in (13, 15, 16, 19):
            body = number(n - 1)
            whole = body + next(c for c in "0123456789" if luhn(body + c))
            values += [whole, body + rng.choice("0123456789")]
            if n == 16:
                gap = rng.choice(" -")
                values.append(gap.join(whole[i:i + 4] for i in range(0, 16, 4)))
            if n == 15:
                values.append("-".join((whole[:4], whole[4:10], whole[10:])))
    values += ["2000-02-29", "1900-02-29", "000-12-3456", "666-12-3456", "665-01-0001", "667-99-9999", "899-99-9999", "900-01-0001", "255.255.255.255", "0.0.0.0", "01.2.3.4"]
    got = swap(make_docs, [f"x {v} y" for v in values], key="other")
    want = [expected(v, "other") for v in values]
    assert got == [(f"x {w or v} y", int(w is not None)) for v, w in zip(values, want)]
    assert 60 < sum(w is None for w in want) < len(want) - 200
