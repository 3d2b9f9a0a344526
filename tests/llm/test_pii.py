import random
import re
from datetime import date

import pytest

from kinelytics.llm import pii as P

from . import plain_pii as plain

R = random.Random(8)


def luhn(digits):
    total = sum(int(c) if i % 2 == 0 else (2 * int(c) - 9 if int(c) > 4 else 2 * int(c)) for i, c in enumerate(reversed(digits)))
    return total % 10 == 0


def card(n):
    body = "".join(R.choice("0123456789") for _ in range(n - 1))
    return next(body + c for c in "0123456789" if luhn(body + c))


def iban(country, bban):
    value = int("".join(str(int(c, 36)) for c in bban + country + "00"))
    return f"{country}{98 - value % 97:02d}{bban}"


def run(spark, texts, key="k1"):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, PII string")
    found = sorted(P.pseudonymize(docs, key).collect())
    assert [r.doc_id for r in found] == list(range(len(texts)))
    return found


VALUES = {
    "card": [card(n) for n in range(13, 20) for _ in range(20)],
    "ip": [".".join(str(R.randint(0, 255)) for _ in range(4)) for _ in range(60)] + ["0.0.0.0", "255.255.255.255"] + [f"1.2.3.{i}" for i in range(10)],
    "phone": [f"+1 ({R.randint(200, 999)}) 555-{R.randint(0, 9999):04d}" for _ in range(40)] + ["(212) 555-0100", "212-555-0100", "+442079460958", "+49 30 901820"],
    "ssn": [f"{R.randint(1, 665):03d}-{R.randint(1, 99):02d}-{R.randint(1, 9999):04d}" for _ in range(40)],
    "date": [f"{R.randint(1900, 2099)}-{R.randint(1, 12):02d}-{R.randint(1, 28):02d}" for _ in range(60)] + ["2024-02-29", "29.02.2000", "12/31/1999"],
    "iban": [iban("DE", "".join(R.choice("0123456789") for _ in range(18))) for _ in range(10)] + [iban("GB", "NWBK60161331926819")],
    "email": [f"{''.join(R.choice('abcXYZ019._-') for _ in range(R.randint(1, 30)))}q@mail{i}.example.com" for i in range(40)] + ["a@x.org"],
}


@pytest.mark.parametrize("kind", list(VALUES))
def test_format_link_and_permutation(spark, kind):
    values = sorted(set(VALUES[kind]))
    if kind == "email":
        values = [v for v in values if re.fullmatch(P.EMAIL, v)]
    texts = [f"Ö see: {v}, end" for v in values] + [f"<{v}>\n{v}" for v in values]
    found = run(spark, texts)
    new = [r.text[len("Ö see: ") : -len(", end")] for r in found[: len(values)]]
    assert len(set(new)) == len(values)  # a permutation keeps different values different
    assert sum(a == b for a, b in zip(values, new)) <= max(1, len(values) // 10)
    for v, n, r, twice in zip(values, new, found, found[len(values) :]):
        assert len(v) == len(n) and [tuple(p) for p in r.pii] == [(kind, 7, 7 + len(v))], (v, n)
        assert twice.text == f"<{n}>\n{n}" and len(twice.pii) == 2  # linked across documents and places
        if kind == "email":
            assert re.fullmatch(P.EMAIL, n) and n.split(".")[-2:] == v.split(".")[-2:]
        assert re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub("[0-9]", "9", v))) == re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub("[0-9]", "9", n)))
        if kind == "card":
            assert luhn(n)
        if kind == "ip":
            assert all(str(int(o)) == o and int(o) < 256 for o in n.split("."))
        if kind == "ssn":
            assert re.fullmatch(P.SSN, n)
        if kind == "date":
            y, m, d = (n.split("-") if "-" in n else n.split(".")[::-1] if "." in n else [n[6:], n[:2], n[3:5]])
            assert 1900 <= date(int(y), int(m), int(d)).year <= 2099
        if kind == "iban":
            assert int("".join(str(int(c, 36)) for c in n[4:] + n[:4])) % 97 == 1
    other = run(spark, texts[: len(values)], "k2")
    assert sum(a.text != b.text for a, b in zip(found, other)) >= len(values) * 0.8


def test_small_domains_are_permuted_exactly(spark):
    """All 3-digit numbers map onto all 3-digit numbers, all one-digit octets onto themselves as a set."""
    from pyspark.sql import functions as F

    got = spark.range(1000).select(P.permuted(F.lpad(F.col("id").cast("string"), 3, "0"), "k", "t").alias("x")).collect()
    assert sorted(r.x for r in got) == [f"{i:03d}" for i in range(1000)]
    got = spark.range(10).select(P.permuted(F.col("id").cast("string"), "k", "t").alias("x")).collect()
    assert sorted(r.x for r in got) == [str(i) for i in range(10)]


def test_invalid_values_and_edge_cases_stay(spark):
    texts = [None, "", "plain words", "card 4785380592391138", "256.1.1.1 1.2.3.4.5", "2023-02-30 99.99.1999", "000-12-3456 666-12-3456", "DE00370400440532013000", "n@x", "🙂 " * 30000]
    found = run(spark, texts)
    assert [r.text for r in found] == texts and all(r.pii == [] for r in found)
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert P.pseudonymize(docs, "k").count() == 0


def test_long_text_and_plan(spark):
    value = "that.92@mail2.example.com"
    found = run(spark, [f"x{value} " * 3000 + "y" * 100000])[0]
    assert len(found.pii) == 3000 and len(set(found.text.split()[:3000])) == 1 and value not in found.text
    plan = P.pseudonymize(spark.createDataFrame([(1, "x")], "doc_id long, text string"), "k")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


HIDDEN = [
    ("DE89 3704 0044 0532 0130 00 BIC COBADEFFXXX", "DE89 3704 0044 0532 0130 00", "iban"),
    ("DE89370400440532013000 2021-05-03", "DE89370400440532013000", "iban"),
    ("DE89370400440532013000 EUR 50", "DE89370400440532013000", "iban"),
    ("AT12 3456 DE89 3704 0044 0532 0130 00", "DE89 3704 0044 0532 0130 00", "iban"),
    ("ID12 4111 1111 1111 1111", "4111 1111 1111 1111", "card"),
    ("AT12 3456 4111 1111 1111 1111", "4111 1111 1111 1111", "card"),
    ("41 11 11 11 11 11 11 11", "41 11 11 11 11 11 11 11", "card"),
    ("4111-111111-111111", "4111-111111-111111", "card"),
    ("77 4111 1111 1111 1111", "4111 1111 1111 1111", "card"),
    ("2023-02-30 4111111111111111", "4111111111111111", "card"),
]


def test_a_match_that_fails_hides_no_value(spark):
    for (text, value, kind), row in zip(HIDDEN, run(spark, [f"see {x[0]}, end" for x in HIDDEN])):
        check_hidden(text, value, kind, row)


def check_hidden(text, value, kind, row):
    assert kind in [p.kind for p in row.pii] and value not in row.text and len(row.text) == len(text) + 9
    at = row.pii[[p.kind for p in row.pii].index(kind)]
    assert (at.start, at.end) == (4 + text.index(value), 4 + text.index(value) + len(value))


def test_long_domain_keeps_its_length(spark):
    text = "to someone@" + "mail." * 150 + "example.org, end"
    row = run(spark, [text])[0]
    assert len(row.text) == len(text) and row.text.endswith(".example.org, end") and row.pii[0].end == len(text) - 5


def mixtures(n=150):
    """Values of all kinds, some broken, joined by what may confuse a detector."""
    r = random.Random(21)
    pool = [v for values in VALUES.values() for v in values] + [x[0] for x in HIDDEN]
    glue = [" ", "", "-", ".", ",", "+", " x ", "\n", "@", "12 ", " 3", ": ", "/", "É", "٣"]
    out = []
    for _ in range(n):
        parts = []
        for _ in range(r.randint(1, 6)):
            v = r.choice(pool)
            if r.random() < 0.3:
                at = r.randrange(len(v))
                v = v[:at] + r.choice(["", "0", "9", "A", " ", "-"]) + v[at + 1 :]
            parts += [v, r.choice(glue)]
        out.append("".join(parts))
    return out


def test_mixtures_against_a_plain_detector_and_network(spark):
    texts = mixtures()
    for text, row in zip(texts, run(spark, texts, "k9")):
        want, found = plain.replaced(text, "k9")
        assert ([tuple(p) for p in row.pii], row.text) == (found, want), text


def test_documents_against_a_plain_detector_and_network(spark):
    from kinelytics.llm.queries import PII_KEY, op3_pii

    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    got = op3_pii(spark, "/root/testdata/sf0.01").collect()
    assert len(got) == len(docs) and sum(r.n_pii > 0 for r in got) > 20
    for r in got:
        want, found = plain.replaced(docs[r.doc_id] or "", PII_KEY)
        assert (r.spans, r.text or "") == (",".join(f"{k}:{a}:{b}" for k, a, b in found), want), r.doc_id
