"""Pseudonyms against the same networks in plain Python, with empty tables, repeated rows and keys in tables."""

import datetime
import hashlib
import random

import pytest

from marginalia.llm import pseudonyms

KEY, LETTERS = "s3cret", "abcdefghijklmnopqrstuvwxyz"


def digest(*parts, kind=hashlib.sha256):
    return kind("|".join(map(str, parts)).encode()).hexdigest()


def feistel(tweak, left, right, a, b):
    for i in range(1, 11):
        noise = int(digest(KEY, tweak, i, right if i % 2 else left)[:15], 16)
        left, right = ((left + noise) % a, right) if i % 2 else (left, (right + noise) % b)
    return left, right


def text(value):
    m = len(value) // 2
    halves = [value[:m], value[m:]]
    for i in range(1, 11):
        half, other = (0, 1) if i % 2 else (1, 0)
        seed = digest(KEY, "text", i, halves[other], kind=hashlib.sha512)
        noise = "".join(digest(seed, b, kind=hashlib.sha512) for b in range(len(halves[half]) // 32 + 1))
        new = ""
        for p, c in enumerate(halves[half]):
            k = int(noise[4 * p : 4 * p + 4], 16)
            group = next((g for g in ("0123456789", LETTERS, LETTERS.upper()) if c in g), None)
            new += group[(group.index(c) + k) % len(group)] if group else c
        halves[half] = new
    return "".join(halves)


def card(value):
    body = value[:-1]
    u = len(body) // 2
    a, b = feistel(f"card{len(body)}", int(body[:u]), int(body[u:]), 10**u, 10 ** (len(body) - u))
    new = f"{a:0{u}d}{b:0{len(body) - u}d}"
    return new + check(new)


def check(body):
    total = sum(sum(divmod(int(c) * (2 - k % 2), 10)) for k, c in enumerate(reversed(body)))
    return str(-total % 10)


def phone(value):
    a, b = feistel("phone", int(value[:3]) - 200, int(value[4:7] + value[8:]) - 2_000_000, 800, 8_000_000)
    return f"{a + 200}-{str(b + 2_000_000)[:3]}-{str(b + 2_000_000)[3:]}"


def ssn(value):
    area, group, serial = map(int, value.split("-"))
    a, b = feistel("ssn", (area - (2 if area > 666 else 1)) * 99 + group - 1, serial - 1, 898 * 99, 9999)
    new = a // 99 + 1
    return f"{new + (new >= 666):03d}-{a % 99 + 1:02d}-{b + 1:04d}"


def ipv4(value):
    p = list(map(int, value.split(".")))
    a, b = feistel("ipv4", p[0] * 256 + p[1], p[2] * 256 + p[3], 65536, 65536)
    return f"{a // 256}.{a % 256}.{b // 256}.{b % 256}"


def date(value):
    first = datetime.date(1800, 1, 1)
    nth = (datetime.date.fromisoformat(value) - first).days
    a, b = feistel("date", nth // 773, nth % 773, 189, 773)
    return (first + datetime.timedelta(a * 773 + b)).isoformat()


def values(rng):
    body = str(rng.randrange(1, 10)) + "".join(rng.choices("0123456789", k=rng.randrange(12, 18)))
    area = rng.choice([x for x in range(1, 900) if x != 666])
    yield card, body + check(body)
    yield phone, f"{rng.randrange(200, 1000)}-{rng.randrange(200, 1000)}-{rng.randrange(10000):04d}"
    yield ssn, f"{area:03d}-{rng.randrange(1, 100):02d}-{rng.randrange(1, 10000):04d}"
    yield ipv4, ".".join(str(rng.randrange(256)) for _ in range(4))
    yield date, (datetime.date(1800, 1, 1) + datetime.timedelta(rng.randrange(146_097))).isoformat()
    yield (lambda v: text(v.split("@")[0]) + "@" + v.split("@")[1]), "".join(rng.choices(LETTERS + "0123456789.", k=rng.randrange(1, 30))).strip(".") + "a@mail.example.com"
    secret = "".join(rng.choices(LETTERS + LETTERS.upper() + "0123456789", k=rng.choice([1, 2, 20, 65, 200])))
    yield (lambda v: "token=" + text(v[6:])), "token=" + secret


def test_the_same_pseudonyms(spark):
    rng = random.Random(9)
    pairs = [(v, make(v)) for _ in range(40) for make, v in values(rng)]
    docs = spark.createDataFrame([(k, f"see {v} here") for k, (v, _) in enumerate(pairs)], "doc_id long, text string")
    by_text = {r.doc_id: r for r in pseudonyms.pseudonymise(docs, KEY).collect()}
    for k, (_, expected) in enumerate(pairs):
        assert by_text[k].text == f"see {expected} here"
    keys = spark.createDataFrame([(KEY,)], "`my key` string")
    by_table = pseudonyms.pseudonymise(docs, keys)
    assert {r.doc_id: r for r in by_table.collect()} == by_text
    assert KEY not in by_table._jdf.queryExecution().toString()


def test_long_values_have_no_period(spark):
    docs = spark.createDataFrame([(1, "password=" + "a" * 2000)], "doc_id long, text string")
    new = pseudonyms.pseudonymise(docs, KEY).first().text[9:]
    assert len(new) == 2000 and new == text("a" * 2000)
    assert len({new[k : k + 31] for k in range(0, 1000, 31)}) > 30


def test_repeated_rows_empty_tables_and_other_keys(spark):
    rows = [(1, "mail bob.42@mail.example.com", "k")] * 3 + [(None, "mail bob.42@mail.example.com", "k"), (2, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _key string")
    got = pseudonyms.pseudonymise(docs, spark.createDataFrame([(KEY,)], "key string"))
    assert got.columns == ["doc_id", "text", "_key", "_n_replaced"]
    found = got.collect()
    assert len(found) == 5 and len({r.text for r in found if r.text}) == 1 and {r._key for r in found} == {"k", None}
    assert pseudonyms.pseudonymise(docs.limit(0), KEY).count() == 0
    with pytest.raises(Exception, match="one key"):
        pseudonyms.pseudonymise(docs, spark.createDataFrame([("a",), ("b",)], "key string")).collect()
