"""Operator 6 against planted entities of known places, kinds and values."""

import random
import re

import pytest

from astroloom.llm import surrogates
from astroloom.llm.common import settle

SCHEMA = "doc_id long, text string"
KEY = "key"


def luhn_ok(text):
    digits = [int(c) for c in text if c.isdigit()]
    return sum(sum(divmod(2 * d, 10)) if k % 2 else d for k, d in enumerate(reversed(digits))) % 10 == 0


def iban_ok(text):
    plain = text.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def card(rng, sep=""):
    body = "4" + "".join(rng.choice("0123456789") for _ in range(14))
    last = next(c for c in "0123456789" if luhn_ok(body + c))
    return sep.join(re.findall(".{4}", body + last))


def iban(rng):
    rest = "".join(rng.choice("0123456789") for _ in range(18))
    return next(x for k in range(2, 99) if iban_ok(x := f"DE{k:02d}{rest}"))


def planted(rng):
    """(kind, value, pattern that the surrogate has to match whole)"""
    n = rng.randint(0, 40)
    kinds = [
        ("email", f"user.{n}@mail{n % 9}.example.com", r"[a-z]{4}\.\d+@[a-z]{4}\d\.[a-z]{7}\.com"),
        ("email", f"{'very-long-' * 30}{n}@example.org", r"(?:[a-z]{4}-[a-z]{4}-){30}\d+@[a-z]{7}\.org"),
        ("email", f"o'neil{n}@пример.рф", r"[a-z]'[a-z]{4}\d+@[а-я]{6}\.рф"),
        ("phone", f"+1 (41{n % 10}) 555-{1500 + n}", r"\+1 \(\d{3}\) \d{3}-\d{4}"),
        ("phone", f"020 7946 {1000 + n}", r"\d{3} \d{4} \d{4}"),
        ("phone", f"555 123 {4000 + n}", r"\d{3} \d{3} \d{4}"),
        ("ip", f"42.14.{n}.254", r"\d+\.\d+\.\d+\.\d+"),
        ("ipv6", f"2001:db8::8a2e:{n + 1000:x}:7334", r"[0-9a-f]{4}:[0-9a-f]{3}::[0-9a-f]{4}:[0-9a-f]+:[0-9a-f]{4}"),
        ("ipv6", f"fe80::{n + 1:x}", r"[0-9a-f]{4}::[0-9a-f]+"),
        ("ssn", f"123-45-{6000 + n}", r"\d{3}-\d{2}-\d{4}"),
        ("card", card(random.Random(n)), r"4\d{15}"),
        ("card", card(random.Random(n), " "), r"4\d{3}(?: \d{4}){3}"),
        ("iban", iban(random.Random(n)), r"DE\d{20}"),
        ("credential", f"password={'xY7' * 60}{n}", r"password=[A-Za-z0-9]+"),
        ("credential", f'token = "{n:040x}', r'token = "[0-9a-f]{40}'),
        ("credential", f"secret: p@ss!w0rd#{n}x", r"secret: [a-z]@[a-z]{2}![a-z]\d[a-z]{2}#\d+[a-z]"),
        ("name", "Wei Zhang", r"\w+ \w+"),
        ("name", "Priya Patel", r"\w+ \w+"),
        ("name", "José García-Márquez", r"\w+ \w+"),
        ("name", "Mr O'Brien", r"Mr \w+"),
        ("name", "Dr Kovács", r"Dr \w+"),
        ("name", "Mrs McDonald", r"Mrs \w+"),
        ("name", "Jan van der Berg", r"\w+ van der \w+"),
        ("name", "Mary J. Jones", r"\w+ [A-Z]\. \w+"),
        ("name", "Мария Петрова", r"[А-Я][а-я]+ [А-Я][а-я]+"),
        ("name", "السيدة هند", r"السيدة [ء-ي]+"),
        ("name", "王小明", r"[一-鿿]{3}"),
    ]
    return rng.choice(kinds)


CLEAN = [
    "nothing to see at 12:30 on 2020-01-01, pi is 3.14159",
    "order 9739312764672899 of version 1.2.3.4, v10.0.0.1",
    "std::vector a::b and the AB12 CDEF GHIJ KLMN 0000 code",
    "the token: see below, the secret is out; don't",
    "1234567890123 rows, 555-12 left",
    "здесь ничего нет, 这里什么都没有",
]


def test_planted_entities(spark):
    rng = random.Random(6)
    rows, plans = [], []
    for i in range(160):
        plan = []
        for _ in range(rng.randint(0, 4)):
            plan += [(None, rng.choice(CLEAN), None), planted(rng)]
        plan.append((None, rng.choice(CLEAN), None))
        text = " ; ".join(v + "先生" if v == "王小明" else v for _, v, _ in plan)
        rows.append((i, text))
        plans.append(plan)
    got = {r.doc_id: r for r in surrogates.pseudonymise(spark.createDataFrame(rows, SCHEMA), KEY).collect()}
    seen, back = {}, {}
    originals = {(k, v) for plan in plans for k, v, _ in plan if k}
    for (i, _), plan in zip(rows, plans, strict=True):
        pieces = got[i].text.split(" ; ")
        assert len(pieces) == len(plan), (plan, got[i].text)
        assert got[i].n_entities == sum(k is not None for k, _, _ in plan)
        assert got[i].kinds == ",".join(sorted({k for k, _, _ in plan if k}))
        for (kind, value, pattern), new in zip(plan, pieces, strict=True):
            new = new.removesuffix("先生")
            if kind is None:
                assert new == value
                continue
            assert re.fullmatch(pattern, new) and new != value, (value, new)
            assert seen.setdefault((kind, value), new) == new  # one value, one surrogate
            assert back.setdefault((kind, new), value) == value  # distinct
            assert (kind, new) not in originals
            assert kind != "card" or luhn_ok(new)
            assert kind != "iban" or iban_ok(new)
    names = {v: n.split() for (k, v), n in seen.items() if k == "name"}
    for v, kind in (("Wei Zhang", "latin_m"), ("Priya Patel", "latin_f"), ("Mary J. Jones", "latin_f"), ("Мария Петрова", "cyrillic_f")):
        assert v not in names or names[v][0] in surrogates.GIVEN[kind].split()


def test_a_format_without_free_values(spark):
    """Nine of ten one-digit values: distinct all the same, and the job ends."""
    values = [("ssn", str(d)) for d in range(9)] + [("surname", "Smith")]
    df = spark.createDataFrame(values, "kind string, value string")
    found = {(r.kind, r.value): r.surrogate for r in surrogates.assign(df, KEY, rounds=2).collect()}
    assert set(found) == set(values)
    assert len({s for (k, _), s in found.items() if k == "ssn"}) == 9
    assert all(s == "9" or re.fullmatch("ssn-[0-9a-f]{32}", s) for (k, _), s in found.items() if k == "ssn")
    assert re.fullmatch("[A-Z][a-z]+", found["surname", "Smith"])


def test_the_key_decides(spark):
    names = surrogates.GIVEN["latin_m"].split()
    one, two = surrogates.cycle(names, "a", "latin_m"), surrogates.cycle(names, "b", "latin_m")
    assert one != two and set(one) == set(one.values()) == set(names) and all(k != v for k, v in one.items())
    for key in ("", None):
        with pytest.raises(ValueError, match="key"):
            surrogates.pseudonymise(spark.createDataFrame([], SCHEMA), key)


def test_hot_values(spark, monkeypatch):
    monkeypatch.setattr(surrogates, "HOT_PART", 3)
    rows = [(i, "all mail bob@x.org") for i in range(60)] + [(100 + i, f"or u{i}@y.org") for i in range(20)]
    got = surrogates.pseudonymise(spark.createDataFrame(rows, SCHEMA), KEY).collect()
    assert len(got) == 80 and all(r.n_entities == 1 for r in got)
    assert len({r.text for r in got}) == 21 and not any("bob" in r.text for r in got)


def test_long_runs(spark):
    """Long runs of name and address characters neither fail nor take long."""
    rows = [(1, "a." * 100_000), (2, "x" * 200_000), (3, "Ab" * 50_000), (4, "1:" * 50_000), (5, "a@" + "b." * 50_000), (6, "O'" * 50_000), (7, "12 " * 50_000)]
    got = {r.doc_id: r for r in surrogates.pseudonymise(spark.createDataFrame(rows, SCHEMA), KEY).collect()}
    assert len(got) == 7 and all(got[i].text == t for i, t in rows[:4])


def test_all_stages_are_native(spark, monkeypatch):
    """Also what a checkpoint cuts off the plan."""
    plans = []

    def noted(df):
        plans.append(df._jdf.queryExecution().toString())
        return settle(df)

    monkeypatch.setattr(surrogates, "settle", noted)
    out = surrogates.pseudonymise(spark.createDataFrame([(1, "Mail bob@x.org")], SCHEMA), KEY)
    plans.append(out._jdf.queryExecution().toString())
    assert len(plans) > 3
    assert not any(w in p for p in plans for w in ("Python", "Pandas", "MapInArrow", "ArrowEval"))
