"""Preserve rules, as an expression and as a join."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from incognita import operators as op
from incognita.operators.preserve import _grams, contained_pairs
from incognita.functions import PreserveRules, parse_rules

CASES = [
    (None, False, "admin", False),
    ("admin,root,system", False, "root", True),
    ("admin,root,system", False, "other", False),
    ("Admin,ROOT", False, "ADMIN", True),
    ("Admin", True, "admin", False),
    ("admin", False, "super_admin", True),
    ('["admin","root","system"]', False, "root", True),
    ("a@probe.example,b@probe.example", False, "other@probe.example", False),
    ("admin\nroot\r\nsystem", False, "system", True),
    ("admin", False, "", True),
    ("admin", False, "min", True),
    ("admin", False, None, False),
]


@pytest.mark.parametrize("rules,case,value,want", CASES)
def test_table(spark, rules, case, value, want):
    df = spark.createDataFrame([(value,)], "v string")
    assert df.select(PreserveRules.parse(rules, case).matches(F.col("v"))).first()[0] is want


def test_parse():
    assert parse_rules('{"a": ["x", {"b": "y"}], "c": "z", "d": 5, "e": ""}') == ["x", "y", "z"]
    assert parse_rules(" a , b\n\nc ,") == ["a", "b", "c"]
    assert parse_rules("[broken, list") == ["[broken", "list"]
    assert parse_rules("") == [] and parse_rules("  ") == []


def test_edit():
    rules = PreserveRules().add(" a ").add("a").add("b").add(" ")
    assert rules.get() == ["a", "b"]
    assert rules.remove("a").get() == ["b"] and rules.get() == ["a", "b"]
    assert len(PreserveRules.defaults().get()) == 21


def test_strict_and_glob(spark):
    df = spark.createDataFrame([("min",), ("x@vdi.probe",), ("noreply@a",), ("xadmin",)], "v string")

    def hits(rules):
        return [r[0] for r in df.select(rules.matches(F.col("v"))).collect()]

    assert hits(PreserveRules(("admin",), mode="strict")) == [False, False, False, True]
    assert hits(PreserveRules(("*@vdi.probe", "noreply@*"), glob=True)) == [False, True, True, False]
    assert hits(PreserveRules(("*@vdi.probe",))) == [False, False, False, False]


WORD = st.text(alphabet="abAB. \u0000", max_size=4)


@settings(max_examples=15, deadline=None)
@given(rules=st.lists(WORD.filter(bool), max_size=4), values=st.lists(WORD, min_size=1, max_size=8))
def test_expression_and_join_agree_with_plain_python(spark, rules, values):
    def want(v):
        v = v.lower()
        return any(r.lower() in v or v in r.lower() for r in rules)

    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    inline = {r[0]: r[1] for r in df.select("i", PreserveRules(tuple(rules)).matches(F.col("v"))).collect()}
    assert inline == {i: want(v) for i, v in enumerate(values)}
    frame = spark.createDataFrame([(r,) for r in rules], "rule string")
    joined = {r["i"]: r["preserved"] for r in op.mark_preserved(df, "v", frame).collect()}
    assert joined == inline


def test_join_keeps_every_row_with_a_hot_value(spark):
    df = spark.range(3000).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 'Root' WHEN id % 3 = 1 THEN NULL ELSE concat('u', id) END AS v")
    rules = spark.createDataFrame([("root",), ("u10",)], "rule string")
    got = op.mark_preserved(df, "v", rules)
    assert got.count() == 3000
    want = df.select("id", "v", PreserveRules(("root", "u10")).matches(F.col("v")).alias("preserved"))
    assert got.exceptAll(want).count() == 0


def test_long_lists_answer_like_short_ones(spark):
    words = [f"rule{i}x" for i in range(1500)]
    df = spark.createDataFrame([("Rule7x",), ("a rule1499x b",), ("le12",), ("",), ("other",), (None,)], "v string")
    for mode in ("compat", "strict"):
        rules = PreserveRules(tuple(words), mode=mode)
        got = [r[0] for r in df.select(rules.matches(F.col("v"))).collect()]
        assert got == [True, True, mode == "compat", mode == "compat", False, False]
        marked = op.mark_preserved(df, "v", spark.createDataFrame([(w,) for w in words], "rule string"), mode=mode)
        assert {r.v: r.preserved for r in marked.collect()} == dict(zip([r.v for r in df.collect()], got))


def test_a_short_rule_does_not_make_all_pairs(spark):
    """2,000 rules and one of a single character over 3,000 values: few pairs are looked at."""
    rules = spark.range(2000).selectExpr("concat('common prefix ', lpad(id * 37, 7, '0'), ' end') AS small").unionByName(spark.createDataFrame([("z",)], "small string"))
    values = spark.range(3000).selectExpr("concat('a common prefix ', lpad(id * 11, 7, '0'), IF(id % 5 = 0, ' z', ' end'), ' tail') AS large")
    pairs = contained_pairs(rules, values)
    joins = pairs._jdf.queryExecution()
    rows = {(r.small, r.large) for r in pairs.collect()}
    small, large = [r.small for r in rules.collect()], [r.large for r in values.collect()]
    assert rows == {(s, v) for v in large for s in small if s in v}
    assert joins.optimizedPlan().toString().count("Cartesian") == 0
    grams = values.select("large", F.explode(F.flatten(F.array(_grams(F.col("large"), 8), _grams(F.col("large"), 1)))).alias("gram"))
    seen = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("length(gram) = 8")
    own = rules.where("small <> 'z'").select("small", F.explode(_grams(F.col("small"), 8)).alias("gram")).join(seen, "gram", "left")
    rarest = own.groupBy("small").agg(F.min("n").alias("n"), F.max(F.col("n").isNull()).alias("lacks one")).where("NOT `lacks one`")
    looked = rarest.agg(F.sum("n")).first()[0]
    assert len(rows) <= looked + 600 < 2 * 3000


@pytest.mark.parametrize("mode", ["strict", "compat"])
def test_long_lists_test_a_value_once(spark, mode):
    """Not once per rule: a long list is one regular expression, with the same answers."""
    odd = ["a.b", "a.b+", "(x", "ü😀", "é", "\\d", "a b", "n\nm", "$", "[q]", "zz" * 30]
    rules = [f"{7 * i:05d}" for i in range(1, 400)] + odd + ["x" * i + "y" for i in range(1, 120)]
    keep = PreserveRules(tuple(rules), mode=mode, case_sensitive=True)
    values = ["00007", "900078", "0000", "axb", "a.b", "wa.b+w", "(", "(x", "ü😀!", "e", "é", "5", "\\d", "n\nm", "z", "Q", "[q", "", "\u0000", "xxxy", "xxx", None]
    df = spark.createDataFrame([(v,) for v in values], "v string").select("v", keep.matches(F.col("v")).alias("m"))
    inside = [] if mode == "strict" else rules
    want = {v: v is not None and (any(r in v for r in rules) or any(v in r for r in inside)) for v in values}
    assert {r["v"]: r["m"] for r in df.collect()} == want
    assert "exists(" not in df._jdf.queryExecution().optimizedPlan().toString()
