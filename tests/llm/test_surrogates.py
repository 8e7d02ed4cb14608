"""Surrogates: format, coreference, distinctness, very long texts, and a plain scan of the edge rows."""

import time

import regex
from pyspark.sql import functions as F

from tests.llm.test_operators import EDGES
from typeloom.llm import pii

ANY = regex.compile(pii.ANY.replace("&&", ""))  # the intersections are in the alphabets only


def replaced(spark, rows, **more):
    out = pii.replace_entities(spark.createDataFrame(rows, "doc_id long, text string"), **more).collect()
    return {r.doc_id: r for r in out}


def luhn(digits):
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def mod97(iban):
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def test_against_a_plain_scan(spark):
    """Entities, kinds and gaps are those of a scan by another regex engine; the mapping is one to one."""
    more = [
        (101, "a.b@x.org, A.B@X.ORG and token: 'abcdefgh12' 10.0.0.1 Mr. Doe"), (102, "+1 504 555 2652 4111 1111 1111 1111 c@x.org"), (103, "Herr Max Muster, 030 12345678; GB82 WEST 1234 5698 7654 32"),
        (104, "fe80:0:0:0:1:2:3:4 and 2001:db8::1:2"), (105, "ünïcode@bücher.de, 用户@example.com, łódź@example.pl"),
    ]
    rows = [*EDGES, *more]
    out, seen = replaced(spark, rows), {}
    for key, text in rows:
        entities = [m[0] for m in ANY.finditer(text or "")]
        assert out[key].n_entities == len(entities), (key, entities, out[key])
        if not entities:
            assert out[key].text == text
        gaps, at, new = ANY.split(text or ""), 0, out[key].text
        for gap, entity, after in zip(gaps, entities, gaps[1:]):
            assert new.startswith(gap, at)
            start = at + len(gap)
            at = new.index(after, start) if after else len(new)
            assert seen.setdefault(entity, new[start:at]) == new[start:at] != entity
    assert len(set(seen.values())) == len(seen)


def test_formats(spark):
    text = "Card 4111 1111 1111 1111, GB82 WEST 1234 5698 7654 32, Mixed.Case@Mail.Org, API_KEY=Abcd1234EFgh, \"token\": \"Zz9Zz9Zz9Zz9\", 用户@example.com, łódź@example.pl, password: hunter2222"
    new = replaced(spark, [(1, text)])[1].text
    card = regex.search(r"Card (\d{4} \d{4} \d{4} \d{4}),", new)[1].replace(" ", "")
    iban = regex.search(r"GB\d\d [A-Z]{4} \d{4} \d{4} \d{4} \d\d", new)[0].replace(" ", "")
    assert luhn(card) and card[0] == "4" and mod97(iban)
    assert regex.search(r" [A-Z][a-z]{4}\.[A-Z][a-z]{3}@[A-Z][a-z]{3}\.Org,", new)
    assert regex.search(r"API_KEY=[A-Z][a-z]{3}\d{4}[A-Z]{2}[a-z]{2},", new) and regex.search(r'"token": "([A-Z][a-z]\d){4}"', new)
    assert regex.search(r"\p{Han}{2}@[a-z]{7}\.com", new) and regex.search(r"\p{Latin}{4}@[a-z]{7}\.pl", new)
    for old in ("用", "户", "ł", "ó", "ź", "hunter", "Mixed", "Abcd"):
        assert old not in new


def test_coreference(spark):
    rows = [(1, "Mrs. Jane Doe met Mrs. Doe. Later Doe and Jane Doe left."), (2, "+1 504 555 2652 or 504 555 2652, +49 30 12345678 or 030 12345678"), (3, "Dr. Anna Berg, Herr Berg, Г-жа Анна Иванова, Г-н Иванова")]
    out = replaced(spark, rows)
    given, family = regex.match(r"Mrs\. (\w+) (\w+) met", out[1].text).groups()
    assert out[1].text == f"Mrs. {given} {family} met Mrs. {family}. Later {family} and {given} {family} left."
    assert given in pii.NAMES["f", "latin"] and "Doe" not in out[1].text
    a, b, c, d = [regex.sub(r"\D", "", x) for x in regex.split(" or |, ", out[2].text)]
    assert a[-10:] == b and c[-9:] == d[-9:] and a[0] == "1" and c[:2] == "49" and "5552652" not in a
    people = regex.findall(r"(?:Dr\.|Herr|Г-жа|Г-н) ([\w-]+)(?: ([\w-]+))?", out[3].text)
    assert people[0][0] in pii.NAMES["f", "latin"] and people[0][1] == people[1][0]
    assert people[2][0] in pii.NAMES["f", "cyrillic"] and people[2][1] == people[3][0]


def test_long_texts_are_linear(spark):
    dots = "x@" + "a." * 500_000 + "b"
    rows = [(1, dots), (2, "a" * 1_000_000), (3, "1 " * 400_000), (4, "token='" * 100_000), (5, "a@" * 300_000), (6, "." * 500_000 + "@"), (7, "Mr. Ab" * 100_000)]
    began = time.time()
    out = replaced(spark, rows)
    assert out[1].n_entities == 1 and out[2].n_entities == 0 and out[2].text == rows[1][1]
    assert time.time() - began < 120


def test_numbers_keep_their_length_in_a_crowded_space(spark):
    own = spark.range(3000).select(F.lit("phone").alias("kind"), F.lpad(F.col("id").cast("string"), 4, "0").alias("normal"), F.lit(False).alias("female"))
    out = pii.surrogates(own).collect()
    real = {r.normal for r in out}
    assert len(real) == 3000 == len({r.surrogate for r in out}) and all(len(r.surrogate) == 4 for r in out)
    assert not real & {r.surrogate for r in out}


def test_one_entity_in_most_documents(spark, monkeypatch):
    from typeloom.plans import skew

    monkeypatch.setattr(skew, "FLOOR", 5)
    out = replaced(spark, [(k, f"write to sales@shop.example.com or {'abcdefghij'[k % 10]}@b.org") for k in range(60)])
    assert len({regex.search(r"to (\S+) or", r.text)[1] for r in out.values()}) == 1 and len({r.text for r in out.values()}) == 10
