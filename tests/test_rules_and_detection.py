"""Rule data, detection by name and by value."""

import re
from collections import Counter

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from incognita import operators as op
from incognita import rules as R
from incognita.functions import detect_value, normalize_name, preview, score_band


def people(spark):
    return spark.createDataFrame(
        [
            (1, "Jörn", "Krüger", "joern@probe.example", 30),
            (2, "Anke", "Lohse", "anke@probe.example", 40),
            (3, None, "Ruhnau", "r@probe.example", 50),
        ],
        "id long, firstname string, lastname string, email string, age int",
    )


def test_rule_data():
    assert len(R.COLUMN_RULES) == 73 and len({r.name for r in R.COLUMN_RULES}) == 73
    assert len({r.type for r in R.COLUMN_RULES}) == 25
    assert [p.type for p in R.STANDARD_PATTERNS] == (
        "email phone_de iban ipv4 ipv6 url uuid postcode_de date_iso date_de".split()
    )
    assert len(R.TABLE_CONTEXT) == 14 and len(R.DEFAULT_PRESERVE_WORDS) == 21
    assert [p.type for p in R.DOCUMENT_PATTERNS] == "email phone iban ipv4 url uuid".split()


def test_needed_parts_occur_in_every_match():
    samples = {
        "email": "a@b.de",
        "phone_de": "0123456",
        "phone": "0123456",
        "iban": "DE89370400440532013000, DE89 3704 0044 0532 0130 00AB 12",
        "ipv4": "10.0.0.1",
        "ipv6": "1:2:3:4:5:6:7:8",
        "url": "http://a.b",
        "uuid": "00000000-0000-0000-0000-000000000000",
        "postcode_de": "12345",
        "date_iso": "2020-01-01",
        "date_de": "01.01.2020",
    }
    for p in [*R.STANDARD_PATTERNS, *R.DOCUMENT_PATTERNS, *R.corrected_patterns()]:
        match = re.search(p.regex, "x " + samples[p.type] + " x", re.ASCII)
        assert match and re.search(p.needs, match.group(0)), p.type


def test_columns_of_a_table(spark):
    found = op.detect_columns(op.table_columns(spark, {"users": people(spark)}))
    rows = {r["column"]: r for r in found.collect()}
    assert (rows["firstname"]["type"], rows["firstname"]["score"]) == ("first_name", 15.0)
    assert (rows["lastname"]["type"], rows["email"]["type"]) == ("last_name", "email")
    assert rows["age"]["score"] == 7.5 and rows["age"]["action"] == "pseudonymize"
    assert rows["id"]["detected"] is False and rows["id"]["score"] == 0.0 and rows["id"]["action"] == "keep"
    assert rows["id"]["type"] is None and rows["id"]["method"] is None


def test_csv_columns_all_match(spark):
    header = "firstname lastname email phone birthdate street city zip company".split()
    catalog = spark.createDataFrame([("csv", c) for c in header], "table string, column string")
    rows = op.detect_columns(catalog).collect()
    assert all(r["detected"] for r in rows)
    assert {r["column"]: r["score"] for r in rows}["company"] == 8.0


def test_every_rule_and_spelling(spark):
    spelled = [(r.name.upper().replace("_", "-"), r.type, r.weight) for r in R.COLUMN_RULES]
    catalog = spark.createDataFrame([("T", n) for n, _, _ in spelled], "table string, column string")
    got = Counter((r["column"], r["type"], r["score"]) for r in op.detect_columns(catalog).collect())
    assert got == Counter((n, t, float(w)) for n, t, w in spelled)


@pytest.mark.parametrize("table,factor", sorted(R.TABLE_CONTEXT.items()))
def test_context(spark, table, factor):
    catalog = spark.createDataFrame([(table.title(), "E Mail")], "table string, column string")
    assert op.detect_columns(catalog).first()["score"] == round(10 * factor, 1)


def test_custom_rules_and_context(spark):
    rules = [R.ColumnRule("badge", "uuid", "uuid", 4)]
    catalog = spark.createDataFrame([("staff", "Badge"), ("staff", "email")], "table string, column string")
    rows = {r["column"]: r for r in op.detect_columns(catalog, rules, {"staff": 2.0}).collect()}
    assert rows["Badge"]["score"] == 8.0 and not rows["email"]["detected"]


def test_available_types_last_rule_wins(spark):
    got = {r["type"]: r["faker_method"] for r in op.available_types(spark).collect()}
    assert len(got) == 25
    assert got["street"] == "streetAddress" and got["ip"] == "ipv6" and got["email"] == "safeEmail"


def test_normalise_preview_band(spark):
    df = spark.createDataFrame([("E-Mail Adresse", 9.0), ("x" * 31, 6.0), ("y" * 30, 5.9)], "s string, n double")
    rows = df.select(
        normalize_name(F.col("s")).alias("norm"), preview(F.col("s")).alias("p"), score_band(F.col("n")).alias("b")
    ).collect()
    assert rows[0]["norm"] == "e_mail_adresse"
    assert rows[1]["p"] == "x" * 30 + "..." and rows[2]["p"] == "y" * 30
    assert [r["b"] for r in rows] == ["high", "medium", "low"]


def test_detect_value_first_pattern_decides(spark):
    samples = [
        ("mail a.b@c.de", "email"),
        ("+49 211 123456", "phone_de"),
        ("DE89 3704 0044 0532 0130 00AB 12", "phone_de"),
        ("AB12CDEFGHIJKLMNPQRSTUVWXYZA", "iban"),
        ("192.168.1.100", "ipv4"),
        ("fe8:a:b:c:d:e:f:1", "ipv6"),
        ("see https://www.probe.example", "url"),
        ("abcdefab-1111-4111-8111-abcdefabcdef", "uuid"),
        ("41515 Ort", "postcode_de"),
        ("ü41515ß", "postcode_de"),
        ("x41515", None),
        ("1999-12-31", "date_iso"),
        ("31.12.1999", "date_de"),
        ("nothing", None),
        ("", None),
        (None, None),
    ]
    df = spark.createDataFrame(samples, "value string, want string")
    for r in df.select("value", "want", detect_value(F.col("value")).alias("v")).collect():
        assert (r["v"] and r["v"]["type"]) == r["want"], r
        if r["v"]:
            assert r["v"]["method"] == "regex"


def test_analyze_schema(spark):
    other = spark.createDataFrame([(1, "x")], "order_no int, state string")
    found = op.analyze_schema(spark, {"users": people(spark), "misc": other}).collect()
    assert {r["table"] for r in found} == {"users"}
    assert {r["column"] for r in found} == {"firstname", "lastname", "email", "age"}
    assert {r["row_count"] for r in found} == {3}
    assert op.analyze_schema(spark, {"misc": other}).count() == 0


def test_catalog_and_keys(spark):
    columns = op.table_columns(spark, {"users": people(spark)}, {"users": ["id"]})
    assert op.primary_keys(columns).collect() == [Row(table="users", column="id", ordinal=1)]
    assert [r["dtype"] for r in columns.orderBy("ordinal").collect()] == ["bigint", "string", "string", "string", "int"]


def test_list_tables(spark):
    for name in ("zz_probe", "aa_probe"):
        people(spark).createOrReplaceTempView(name)
    names = [r["name"] for r in op.list_tables(spark).collect()]
    assert names == sorted(names) and {"aa_probe", "zz_probe"} <= set(names)
    for name in ("zz_probe", "aa_probe"):
        spark.catalog.dropTempView(name)


def test_sheets(spark):
    sheet = spark.createDataFrame(
        [(1, "Max", "m@probe.example", 5), (2, "", None, 6)], "nr int, firstname string, ` ` string, n int"
    )
    profile = op.profile_sheets(spark, {"Sheet1": sheet}).collect()
    assert [(r["sheet"], r["column"], r["row_count"]) for r in profile] == [("Sheet1", "firstname", 2)]
    cells = op.scan_cells(sheet.toDF("nr", "firstname", "Column3", "n"), "Sheet1", "nr").collect()
    assert [(c["row"], c["column"], c["type"]) for c in cells] == [(1, "Column3", "email")]
    out = op.pseudonymize_sheets({"Sheet1": sheet}, {"Sheet1": {"firstname": "first_name", "n": "age"}})
    rows = {r["nr"]: r for r in out["Sheet1"].collect()}
    assert rows[1]["firstname"] != "Max" and rows[2]["firstname"] == "" and rows[1]["n"] == 5
