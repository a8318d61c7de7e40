import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from helpers import empty, table
from tidemark.llm import pii

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    s = [int(c) for c in reversed(d)]
    return sum(s[::2]) % 10 + sum(sum(divmod(2 * v, 10)) for v in s[1::2]) % 10 in (0, 10)


def plain(text):
    out = []
    for kind, p in PLAIN.items():
        for m in re.finditer(p, text):
            d = re.sub(r"[^0-9]", "", m[0])
            if kind == "ip" and max(map(int, m[0].split("."))) > 255 or kind == "card" and not (13 <= len(d) <= 19 and luhn(d)) \
                    or kind == "phone" and not 9 <= len(d) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


def found(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id BIGINT, text STRING")
    return {r.doc_id: [tuple(s)[:3] for s in r.pii] for r in pii.find(df).collect()}


TEXTS = ["a@b.com.x@y.com and é𝄞 q_w@x-1.org, a@b", "x@b.com_x@y.com", "1.2.3.4.5.6.7.8 999.1.1.1 0000255.1.1.1 1.2.3", "4111 1111 1111 1111, 4111-1111-1111-1112 4",
         "+1 (743) 555-3824 +12 +1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 7 +1+23456789012", "7" * 20_000, "a" * 50_000 + "@", "1 " * 20_000, "1." * 9000, "", " "]


def test_base_spans(spark):
    got = found(spark, TEXTS)
    for i, t in enumerate(TEXTS):
        assert [s for s in got[i] if s[0] in PLAIN] == plain(t), t[:80]


@settings(max_examples=3, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text("01234567.@+- ()ab_é𝄞", max_size=60), min_size=80, max_size=80))
def test_random_texts(spark, texts):
    got = found(spark, texts)
    assert all([s for s in got[i] if s[0] in PLAIN] == plain(t) for i, t in enumerate(texts))


def test_added_spans(spark):
    texts = ["IBAN DE89 3704 0044 0532 0130 00.", "DE88 3704 0044 0532 0130 00", "my ssn 123-45-6789", "no 123-45-6789", "call 212-555-0187 x", "212-555-0187",
             "call +1 212-555-0187"]
    assert [[s[0] for s in v] for v in found(spark, texts).values()] == [["iban"], [], ["ssn"], [], ["tel"], [], ["phone"]]


def test_redact_and_odd_rows(spark):
    df = table(spark)
    out = pii.redact(df)
    assert out.columns == df.columns and out.dtypes == df.dtypes
    assert sorted(map(str, out.filter("text IS NULL").collect())) == sorted(map(str, df.filter("text IS NULL").collect()))
    one = spark.createDataFrame([(1, "é a@b.co, +1 (743) 555-3824!", 27)], "doc_id BIGINT, text STRING, n_chars BIGINT")
    assert pii.redact(one).first()[1:] == ("é <EMAIL>, <PHONE>!", 19)
    assert pii.find(empty(spark)).count() == 0 and pii.find(df).count() == df.count()


@pytest.mark.parametrize("name", ["pii", "t", "doc", "email"])
def test_clashing_names(spark, name):
    df = spark.createDataFrame([(1, "a@b.co", "v")], f"doc_id BIGINT, text STRING, {name} STRING")
    assert pii.find(df).first()["pii"][0]["kind"] == "email"
