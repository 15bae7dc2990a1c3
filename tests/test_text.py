"""Pattern search and replacement against a plain per-text reading of the rules."""

import datetime
import random
import re
import sys
from dataclasses import replace

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from incognita import functions as fn
from incognita import operators as op
from incognita import rules as R
from incognita.functions.search import cut_in, found_in, scanner
from incognita.rules import PATTERN_SETS, Pattern

# Fragments that match, nearly match or touch each other.
FRAGMENTS = st.sampled_from(
    [
        "a.b@c.de", "x@y", "q@w.org_r@t.eu", "@", "+49 30 123456", "0123456", "0", "40210", "ü40210ß", "x40210",
        "2024-01-15", "15.01.2024", "1.2.3.4", "256.1.1.1", "10.0.0.1.5", "https://www.a.de/x?y=1", "http://a.b",
        "DE89 3704 0044 0532 0130 00AB 12", "DE89370400440532013000", "1:2:3:4:5:6:7:8",
        "abcdefab-1111-4111-8111-abcdefabcdef", " ", "\n", "-", ".", "é", "a", "_", "7", "\u0002", "\u0003", "😀",
    ]
)
TEXT = st.lists(FRAGMENTS, max_size=14).map("".join)


def plain_findings(text, patterns):
    found = [
        (m.start(), i, m.end(), p.type, m.group(0), p.weight)
        for i, p in enumerate(patterns)
        for m in re.finditer(p.regex, text, re.ASCII)
    ]
    return sorted(found)


def plain_survivors(found):
    kept = []
    for f in sorted(found, key=lambda f: (-f[0], f[1])):
        if all(f[2] <= k[0] or f[0] >= k[2] for k in kept):
            kept.append(f)
    return sorted(kept)


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "id int, text string")


@settings(max_examples=6, deadline=None)
@given(texts=st.lists(TEXT, min_size=20, max_size=80))
@pytest.mark.parametrize("name", ["standard", "document", "corrected"])
def test_findings_agree(spark, name, texts):
    patterns = R.patterns_for(name)
    rows = op.findings(frame(spark, texts), patterns=name).collect()
    got = sorted((r["id"], r["start"], r["end"], r["type"], r["value"], r["score"]) for r in rows)
    want = sorted((i, f[0], f[2], f[3], f[4], f[5]) for i, t in enumerate(texts) for f in plain_findings(t, patterns))
    assert got == want


@settings(max_examples=6, deadline=None)
@given(texts=st.lists(TEXT, min_size=20, max_size=80))
def test_replacement_agrees(spark, texts):
    patterns = R.STANDARD_PATTERNS
    df = frame(spark, texts)
    planned = df.select("id", F.inline(fn.planned_replacements(F.col("text")))).collect()
    fakes = {(r["id"], r["start"]): r for r in planned}
    out = {r["id"]: r["t"] for r in df.select("id", fn.pseudonymize_text(F.col("text")).alias("t")).collect()}
    for i, text in enumerate(texts):
        kept = plain_survivors(plain_findings(text, patterns))
        assert [(i, k[0]) for k in kept] == sorted(key for key in fakes if key[0] == i)
        built, position = "", 0
        for start, _, end, kind, value, _ in kept:
            r = fakes[i, start]
            assert (r["end"], r["type"], r["value"]) == (end, kind, value)
            built += text[position:start] + r["fake"]
            position = end
        assert out[i] == built + text[position:]


def test_fakes_in_text_equal_fakes_in_columns(spark):
    df = spark.createDataFrame([("a@b.de 1.2.3.4",)], "text string")
    row = df.select(
        fn.pseudonymize_text(F.col("text")).alias("t"),
        fn.fake("email", F.lit("a@b.de")).alias("e"),
        fn.fake("ip", F.lit("1.2.3.4")).alias("i"),
    ).first()
    assert row["t"] == f"{row['e']} {row['i']}"


def test_null_empty_and_no_types(spark):
    df = frame(spark, [None, "", "nothing here", "a@b.de"])
    got = [r[0] for r in df.orderBy("id").select(fn.pseudonymize_text(F.col("text"), types=["ipv4"])).collect()]
    assert got == [None, "", "nothing here", "a@b.de"]
    none = [r[0] for r in df.orderBy("id").select(fn.pseudonymize_text(F.col("text"), types=[])).collect()]
    assert none == got
    sizes = [r[0] for r in df.orderBy("id").select(F.size(fn.find_all(F.col("text")))).collect()]
    assert sizes == [0, 0, 0, 1]


def test_many_matches_in_one_text(spark):
    """Far beyond the look-up limit and the block size of the running sum."""
    text = " ".join(f"user{i}@probe{i % 7}.example ü{10000 + i}" for i in range(3000))
    df = spark.createDataFrame([(text,)], "text string")
    rows = op.findings(df, types=["email", "postcode_de"]).collect()
    patterns = R.patterns_for("standard", ["email", "postcode_de"])
    assert [(r["start"], r["end"], r["value"]) for r in rows] == [
        (f[0], f[2], f[4]) for f in plain_findings(text, patterns)
    ]
    out = df.select(fn.pseudonymize_text(F.col("text"), types=["email", "postcode_de"])).first()[0]
    assert "probe" not in out and out.count("@example.") == 3000


def test_long_unbroken_run_is_linear(spark):
    """A megabyte without a blank, as in encoded attachments."""
    df = spark.createDataFrame([("A" * 1_000_000 + " a@b.de",)], "text string")
    assert op.findings(df, types=["email"]).first()["start"] == 1_000_001


def test_order_of_types_breaks_ties(spark):
    df = spark.createDataFrame([("2001:0:0:0:0:0:0:12345",)], "text string")
    text = "1234-56-78901"
    one = spark.createDataFrame([(text,)], "text string")
    a = R.Pattern("a", r"\d{4}", 1, "word")
    b = R.Pattern("b", r"\d{4}-\d{2}", 2, "uuid")
    first = one.select(F.inline(fn.planned_replacements(F.col("text"), [a, b]))).collect()
    second = one.select(F.inline(fn.planned_replacements(F.col("text"), [b, a]))).collect()
    assert [r["type"] for r in first] == ["a", "a"] and [r["type"] for r in second] == ["b", "a"]
    assert op.findings(df, types=["ipv6"]).count() == 1


def test_preserved_match_still_wins_overlaps(spark):
    df = spark.createDataFrame([("2024-01-15 10",)], "text string")
    keep = fn.PreserveRules(("024-01",), mode="strict")
    assert df.select(fn.pseudonymize_text(F.col("text"), preserve=keep)).first()[0] == "2024-01-15 10"


def test_sample_letter(spark):
    """The stated patterns read a compact German IBAN as a phone number and let it
    and other numbers swallow the line break; the corrected set does not."""
    text = "Tel: +49 211 5550123\nGeboren: 12.04.1985\nIBAN: DE02120300000000202051\nAm 2024-01-15 10:30\n"
    df = spark.createDataFrame([(text,)], "text string")
    got = [(r["type"], r["value"]) for r in op.findings(df).collect()]
    assert ("phone_de", "+49 211 5550123\n") in got and ("phone_de", "024-01-15 10") in got
    assert not any(t == "iban" for t, _ in got)
    mended = [(r["type"], r["value"]) for r in op.findings(df, patterns="corrected").collect()]
    assert ("phone_de", "+49 211 5550123") in mended
    assert ("iban", "DE02120300000000202051") in mended
    assert [v for t, v in mended if t == "phone_de"] == ["+49 211 5550123"]
    out = df.select(fn.pseudonymize_text(F.col("text"), patterns="corrected")).first()[0]
    assert out.count("\n") == 4 and "12.04.1985" not in out and "2024-01-15" not in out


def test_document_types_run_one_after_the_other(spark):
    text = "Erika Probe\nerika@probe.example\nTel: 0123 456789"
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    found = {r["type"]: r for r in op.document_findings(df).collect()}
    assert set(found) == {"email", "phone"}
    assert found["email"]["method"] == "regex" and found["email"]["position"] == 12
    profile = op.document_profile(df).first()
    assert (profile["total_findings"], profile["text_length"]) == (2, len(text))
    out = df.select(fn.redact_document(F.col("text"), ["email"])).first()[0]
    assert "erika@probe" not in out and "0123 456789" in out and out.startswith("Erika Probe\n")
    # The second rule sees what the first one wrote.
    chain = df.select(fn.redact_document(F.lit("http://a.probe.example x@y.de"), ["email", "url"])).first()[0]
    assert re.fullmatch(r"https://\w+\.\w+ [a-z.]+@example\.\w+", chain)


@settings(max_examples=6, deadline=None)
@given(texts=st.lists(TEXT, min_size=10, max_size=60))
def test_document_replacement_agrees(spark, texts):
    types = ["email", "ipv4", "uuid"]
    df = frame(spark, texts)
    got = {r["id"]: r["t"] for r in df.select("id", fn.redact_document(F.col("text"), types).alias("t")).collect()}
    matches = {t: set() for t in types}
    current = dict(enumerate(texts))
    for p in R.patterns_for("document", types):
        values = sorted({m.group(0) for t in current.values() for m in re.finditer(p.regex, t, re.ASCII)})
        if values:
            fakes = spark.createDataFrame([(v,) for v in values], "v string").select(
                "v", fn.fake(p.fake_type, F.col("v")).alias("f")
            )
            table = {r["v"]: r["f"] for r in fakes.collect()}
            current = {
                i: re.sub(p.regex, lambda m: table[m.group(0)], t, flags=re.ASCII) for i, t in current.items()
            }
        matches[p.type] = values
    assert got == current


def test_distinct_findings(spark):
    long = "a" * 40 + "@probe.example"
    df = frame(spark, [f"{long} {long}", long, "x@y.de"])
    rows = {r["value"]: r for r in op.distinct_findings(op.findings(df, types=["email"])).collect()}
    assert len(rows) == 2 and rows[long]["display"] == "a" * 30 + "..." and rows["x@y.de"]["band"] == "high"


def test_preserved_flag(spark):
    df = frame(spark, ["info@probe.example x@y.de"])
    rows = op.findings(df, types=["email"], preserve=fn.PreserveRules(("info",), mode="strict")).collect()
    assert [(r["value"], r["preserved"]) for r in rows] == [("info@probe.example", True), ("x@y.de", False)]


def test_own_pattern_under_a_built_in_name(spark):
    own = [Pattern("email", r"\w+ at \w+", 5, "email"), Pattern("iban", r"\bx\d", 5, "iban")]
    df = spark.createDataFrame([("ann at home",), ("a@b.de",), ("x1 éx2",)], "text string")
    got = [[(m.type, m.value) for m in r[0]] for r in df.select(fn.find_all(F.col("text"), own)).collect()]
    assert got == [[("email", "ann at home")], [], [("iban", "x1"), ("iban", "x2")]]
    assert df.select(fn.detect_value(F.col("text"), own)["type"]).collect() == [("email",), (None,), ("iban",)]


def test_names_with_dots_and_clashes(spark):
    df = spark.createDataFrame([(1, "mail a@b.de", "x")], "`k.1` int, `the text` string, `a.b` string")
    found = op.findings(df, "the text").collect()
    assert found[0]["k.1"] == 1 and found[0]["a.b"] == "x" and found[0]["value"] == "a@b.de"
    assert op.document_findings(df, "the text").first()["position"] == 5
    assert op.document_profile(df, "the text").first()["total_findings"] == 1
    with pytest.raises(ValueError, match="rename"):
        op.findings(df.withColumnRenamed("a.b", "Value"), "the text")


def test_sheet_without_strings_has_no_findings(spark):
    df = spark.createDataFrame([(1, 2.5)], "id int, amount double")
    out = op.scan_cells(df, "s", "id")
    assert out.collect() == [] and out.columns == ["sheet", "row", "column", "type", "value", "score"]


def test_only_full_dates_are_moved(spark):
    df = spark.createDataFrame([("2024",), ("2024-1",), ("2024-01-01",)], "v string")
    a, b, c = (r[0] for r in df.select(fn.fake("birthdate", F.col("v"))).collect())
    far = [abs((datetime.date.fromisoformat(x) - datetime.date(2024, 1, 1)).days) for x in (a, b, c)]
    assert far[2] <= 365 and all(datetime.date(1970, 1, 1) <= datetime.date.fromisoformat(x) < datetime.date(2025, 1, 1) for x in (a, b))


_PARTS = "a@b.de x.y+z@p.example.org ++49 0 1234567 DE89 3704 0044 0532 0130 00AB 12 10.13.27.7 256.1.1.1 1.2.3.4.5 fe80:0:0:0:7cf0:0:0:1 1:2:3:4:5:6:7:8:9 https://www.ex.com/o/2?a=1 7cf0ce3b-4236-4000-8000-59f8c013f132 40210 2024-01-15 20.02.1999 1999-02-2000-01-01 20.02.19991.02.2000 ü ß _ @ @@ - . | 😀 0 + %".split() + [" ", "\n", "\u0002"]


def _random_texts(n: int) -> list[str]:
    rnd = random.Random(7)
    return ["".join(rnd.choice(_PARTS) for _ in range(rnd.randint(0, 12))) for _ in range(n)]


@pytest.mark.parametrize("patterns", sorted(PATTERN_SETS))
def test_searched_spellings_equal_the_stated_patterns(patterns):
    for text in _random_texts(2000):
        for p in PATTERN_SETS[patterns]:
            want = [m.span() for m in re.compile(p.regex, re.ASCII).finditer(text)]
            assert list(scanner(p)(text)) == want, (p.type, text)
            assert not want or not p.needs or re.search(p.needs, text)


def test_built_in_patterns_are_searched_once_in_arrow(spark):
    """One pass for all patterns, with the same matches as one pass of Spark's functions for each."""
    df = spark.createDataFrame([(t,) for t in _random_texts(300)] + [(None,)], "text string").coalesce(1)
    own = [replace(p, edges=(*p.edges, "", False, False)[:3]) for p in PATTERN_SETS["standard"]]
    own = [replace(p, needs=p.needs and f"(?:{p.needs})") for p in own]  # equal in meaning, not built in
    for make in (lambda p: fn.find_all(F.col("text"), p), lambda p: fn.planned_replacements(F.col("text"), p)):
        out = df.select(make("standard").alias("new"), make(own).alias("old"))
        assert out.where("NOT (new <=> old)").count() == 0
    plan = df.select(fn.find_all(F.col("text")))._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "regexp_replace" not in plan
    many = "0 1.2.3.4 a@b.de " * 5000 + "@" * 50_000 + "x" * 100_000
    assert spark.createDataFrame([(many,)], "text string").select(F.size(fn.find_all(F.col("text"), types=["email", "ipv4"]))).first()[0] == 10_000


def test_redacting_is_a_chain(spark):
    """Six types, the text of each step used once; odd texts stay whole."""
    types = ["email", "phone", "iban", "ipv4", "url", "uuid"]
    df = spark.createDataFrame([("",), (None,), ("ü\u0002 ok",), ("1.2.3.4 \u0002 a@b.de",)], "text string")
    out = [r[0] for r in df.coalesce(1).select(fn.redact_document(F.col("text"), types)).collect()]
    assert out[:3] == ["", None, "ü\u0002 ok"] and " \u0002 " in out[3] and "a@b.de" not in out[3]
    plan = df.select(fn.redact_document(F.col("text"), types))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 6


def _calls(run) -> int:
    """Calls of functions, of Python's and of its libraries', while something runs."""
    calls = [0]
    before = sys.getprofile()
    sys.setprofile(lambda _, event, __: calls.__setitem__(0, calls[0] + (event in ("call", "c_call"))))
    try:
        run()
    finally:
        sys.setprofile(before)
    return calls[0]


def test_texts_of_a_batch_are_searched_together():
    """What a text without possible matches costs does not depend on the number of patterns."""
    patterns = tuple(PATTERN_SETS["standard"])
    texts = pa.array([f"am 7. des {i % 9}. Monats - ohne alles: 12/3" for i in range(3000)])
    found_in(texts, patterns, False)
    assert _calls(lambda: found_in(texts, patterns, False)) < 2 * len(texts)


@pytest.mark.parametrize("name", sorted(PATTERN_SETS))
def test_texts_in_a_row_do_not_touch(name):
    """Halves of matches in neighbouring texts, zero bytes, NULLs, slices; pieces of any size."""
    texts = [t for whole in _random_texts(60) for t in (whole[: len(whole) // 2], whole[len(whole) // 2 :], None, f"\0{whole}\0")]
    column = pa.array(["0123456", *texts]).slice(1)
    patterns = tuple(PATTERN_SETS[name])
    got = found_in(column, patterns, False).to_pylist()
    assert [[(m["start"], m["end"], m["type"], m["value"], m["score"]) for m in row] for row in got] == [
        [(a, b, kind, value, score) for a, _, b, kind, value, score in plain_findings(t or "", patterns)] for t in texts
    ]
    for p in patterns:
        cut = [None if t is None else re.split(f"({p.regex})", t, flags=re.ASCII) for t in texts]
        assert cut_in(column, p).to_pylist() == cut, p.type
