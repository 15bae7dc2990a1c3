"""Fake values: shape, consistency, types."""

import datetime
import re

import pytest
from pyspark.sql import functions as F

from incognita import operators as op
from incognita.functions import GENERATORS, PreserveRules, fake, register_type

SHAPES = {
    "first_name": r"[A-ZÄ][a-zäöü]+",
    "last_name": r"[A-Z][a-zü]+",
    "full_name": r"\S+ \S+",
    "email": r"[a-z0-9._-]+@example\.(test|invalid|local)",
    "phone": r"\+49 \d{3} \d{7}",
    "street": r"[A-Z][a-zß]+",
    "house_number": r"[1-9]\d{0,2}",
    "postcode": r"\d{5}",
    "city": r"[A-Z][a-zöü]+",
    "country": r"[A-ZÖ][a-zäö]+",
    "birthdate": r"\d{4}-\d{2}-\d{2}",
    "age": r"\d{2}",
    "iban": r"DE\d{20}",
    "bic": r"[A-P]{4}DE[A-P]{2}XXX",
    "bank": r"\S+ .+",
    "company": r"\S+ .+",
    "username": r"[a-z0-9._-]+",
    "password": r"\S{12,20}",
    "ip": r"\d{1,3}(\.\d{1,3}){3}",
    "ipv6": r"[0-9a-f]{4}(:[0-9a-f]{4}){7}",
    "mac": r"[0-9A-F]{2}(:[0-9A-F]{2}){5}",
    "domain": r"[a-z]+\.(example|test|invalid)",
    "url": r"https://[a-z]+\.(example|test|invalid)",
    "ssn": r"[1-9]\d{8}",
    "tax_id": r"[1-9]\d{10}",
    "uuid": r"[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}",
    "word": r"[a-z]+",
}


@pytest.fixture(scope="module")
def made(spark):
    """All types on 300 originals."""
    df = spark.range(300).selectExpr("concat('original ', id) AS v")
    return df.select("v", *[fake(k, F.col("v")).alias(k) for k in SHAPES]).collect()


@pytest.mark.parametrize("kind", sorted(SHAPES))
def test_shape(made, kind):
    for r in made:
        assert re.fullmatch(SHAPES[kind], r[kind]), r[kind]
    distinct = len({r[kind] for r in made})
    assert distinct > {"country": 15, "age": 40, "word": 20, "first_name": 25, "domain": 40, "url": 40}.get(kind, 60)


def test_every_type_has_a_shape():
    assert set(SHAPES) == set(GENERATORS)


def test_ranges(made):
    assert all(18 <= int(r["age"]) <= 80 for r in made)
    assert all(1 <= int(r["postcode"]) <= 99999 for r in made)
    assert all(int(part) <= 255 for r in made for part in r["ip"].split("."))


def test_iban_check_digits(made):
    for r in made:
        number = r["iban"][4:] + "1314" + r["iban"][2:4]
        assert int(number) % 97 == 1


def test_birthdate_keeps_format_and_moves_30_to_365_days(spark):
    days = [datetime.date(1950, 1, 1) + datetime.timedelta(days=i * 97) for i in range(200)]
    rows = [(d.strftime("%Y-%m-%d"), d.strftime("%d.%m.%Y"), f"{d} 10:30:00") for d in days]
    df = spark.createDataFrame(rows, "iso string, german string, stamp string")
    for r in df.select("*", *[fake("birthdate", F.col(c)).alias("f_" + c) for c in df.columns]).collect():
        iso = datetime.date.fromisoformat(r["iso"])
        for got, form in ((r["f_iso"], "%Y-%m-%d"), (r["f_german"], "%d.%m.%Y"), (r["f_stamp"], "%Y-%m-%d")):
            moved = abs((datetime.datetime.strptime(got, form).date() - iso).days)
            assert 30 <= moved <= 365


def test_unparseable_birthdate_becomes_a_date(spark):
    df = spark.createDataFrame([("soon",), ("99.99.2020",), ("",)], "v string")
    for r in df.select(fake("birthdate", F.col("v"))).collect():
        datetime.date.fromisoformat(r[0])


def test_same_input_same_fake_everywhere(spark):
    df = spark.range(1000).selectExpr("id", "concat('v', id % 50) AS v")
    one = {(r["v"], r["f"]) for r in df.select("v", fake("email", F.col("v")).alias("f")).collect()}
    two = {(r["v"], r["f"]) for r in df.repartition(7, "id").select("v", fake("email", F.col("v")).alias("f")).collect()}
    assert one == two and len(one) == 50


def test_type_and_seed_matter(spark):
    df = spark.range(50).selectExpr("concat('v', id) AS v")
    cols = df.select(
        fake("city", F.col("v")).alias("a"),
        fake("city", F.col("v"), seed="x").alias("b"),
        fake("city", F.col("v"), seed="x").alias("c"),
    ).collect()
    assert [r["b"] for r in cols] == [r["c"] for r in cols] != [r["a"] for r in cols]


def test_null_and_preserved_stay(spark):
    df = spark.createDataFrame([(None,), ("ADMIN",), ("else",)], "v string")
    got = [r[0] for r in df.select(fake("word", F.col("v"), preserve=PreserveRules.defaults())).collect()]
    assert got[:2] == [None, "ADMIN"] and got[2] in re.findall(r"\w+", " ".join(got[2:])) and got[2] != "else"


def test_register_type(spark):
    register_type("badge", lambda value, key: F.concat(F.lit("B-"), F.left(key, F.lit(4)), F.length(value).cast("string")))
    try:
        df = spark.createDataFrame([("abc",)], "v string")
        assert re.fullmatch(r"B-[0-9a-f]{4}3", df.select(fake("badge", F.col("v"))).first()[0])
        out = op.pseudonymize_table(df, {"v": "badge"}).first()["v"]
        assert re.fullmatch(r"B-[0-9a-f]{4}3", out)
    finally:
        del GENERATORS["badge"]


def test_unknown_type_gives_a_word(spark):
    df = spark.createDataFrame([("abc",)], "v string")
    assert re.fullmatch(r"[a-z]+", df.select(fake("no such type", F.col("v"))).first()[0])
