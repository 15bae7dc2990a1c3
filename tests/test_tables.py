"""Replacing columns, mappings, summaries, streams, plans."""

import contextlib
import io
import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from incognita import operators as op
from incognita import streaming
from incognita.functions import PreserveRules, fake
from incognita.functions import fakes as fk
from incognita.operators import json_docs
from incognita.operators.mapping import RANGES, permuted, sides
from incognita.operators.skew import hot_values, salted_left_join
from incognita.rules import COLUMN_RULES
from incognita.session import shared_dir

RULES = {"firstname": "first_name", "email": "email", "age": "age"}


@pytest.fixture(scope="module")
def users(spark):
    return spark.createDataFrame(
        [
            (1, "Jörn", "joern@probe.example", 30),
            (2, "Anke", "admin@probe.example", 40),
            (3, None, None, None),
            (4, "", "x@probe.example", 50),
            (5, "0", "x@probe.example", 50),
        ],
        "id long, firstname string, email string, age int",
    )


def test_replace_keep_null_and_types(spark, users):
    out = op.pseudonymize_table(users, RULES, preserve=PreserveRules(("admin",), mode="strict"))
    assert out.schema == users.schema or [f.dataType for f in out.schema] == [f.dataType for f in users.schema]
    rows = {r["id"]: r for r in out.collect()}
    assert rows[1]["firstname"] != "Jörn" and rows[1]["email"].split("@")[1].startswith("example.")
    assert rows[2]["email"] == "admin@probe.example"
    assert rows[3]["firstname"] is None and rows[3]["email"] is None and rows[3]["age"] is None
    assert rows[4]["email"] == rows[5]["email"] != "x@probe.example"
    assert rows[4]["firstname"] != "" and rows[5]["firstname"] != "0"
    kept = {r["id"]: r for r in op.pseudonymize_table(users, RULES, keep_empty=True).collect()}
    assert kept[4]["firstname"] == "" and kept[5]["firstname"] == "0"


def test_compat_rules_preserve_the_empty_string(users):
    rows = {r["id"]: r for r in op.pseudonymize_table(users, RULES, preserve=PreserveRules.defaults()).collect()}
    assert rows[4]["firstname"] == ""


def test_no_target_is_a_no_op(users):
    assert op.pseudonymize_table(users, {"email": {"action": "keep", "type": "email"}}) is users
    assert op.pseudonymize_table(users, {"absent": "email"}) is users


def test_date_columns_stay_dates(spark):
    df = spark.sql("SELECT DATE '1990-08-23' AS birthdate, TIMESTAMP '1990-08-23 10:00:00' AS dob, 7 AS zip, 1.5D AS iban")
    out = op.pseudonymize_table(df, op.suggest_rules("t", df))
    assert dict(out.dtypes) == {"birthdate": "date", "dob": "timestamp", "zip": "int", "iban": "string"}
    row = out.first()
    assert 30 <= abs((row["birthdate"] - datetime(1990, 8, 23).date()).days) <= 365


def test_odd_column_names(spark):
    df = spark.createDataFrame([("a", "b")], "`E-Mail` string, `x.y` string")
    out = op.pseudonymize_table(df, {"E-Mail": "email", "x.y": "city"})
    assert out.columns == ["E-Mail", "x.y"] and "@example." in out.first()[0]


def test_one_seed_links_tables(spark, users):
    orders = users.select("id", F.col("email").alias("contact_email"))
    out = op.pseudonymize_tables(
        {"users": users, "orders": orders}, {"users": RULES, "orders": {"contact_email": "email"}}
    )
    joined = out["users"].join(out["orders"], "id").where("email <> contact_email")
    assert joined.count() == 0
    other = op.pseudonymize_table(users, RULES, seed="another").first()
    assert other["email"] != out["users"].first()["email"]


def test_repartitioning_changes_nothing(spark, users):
    one = op.pseudonymize_table(users, RULES)
    two = op.pseudonymize_table(users.repartition(5, "id"), RULES)
    assert one.exceptAll(two).count() == 0 and two.exceptAll(one).count() == 0


def test_summary_and_progress(spark, users):
    keep = PreserveRules(("admin", "x@"), mode="strict")
    rows = {
        r["table"]: r
        for r in op.run_summary(
            {"users": users, "none": users}, {"users": {"email": "email"}}, preserve=keep
        ).collect()
    }
    assert (rows["users"]["processed"], rows["users"]["updated"]) == (5, 1)
    assert (rows["none"]["processed"], rows["(all)"]["processed"], rows["(all)"]["errors"]) == (0, 5, 0)
    counted, watch = op.with_progress(users, "users", {"email": "email"}, preserve=keep)
    op.pseudonymize_table(counted, {"email": "email"}, preserve=keep).collect()
    assert watch.get == {"processed": 5, "updated": 1}


def test_rules_from_frame(spark, users):
    frame = spark.createDataFrame(
        [("users", "email", "email", "pseudonymize"), ("users", "age", "age", "keep")],
        "table string, column string, type string, action string",
    )
    rules = op.rules_from_frame(frame)
    row = op.pseudonymize_table(users, rules["users"]).first()
    assert "@example." in row["email"] and row["age"] == 30


def test_mapping_matches_the_run(spark, users):
    mapping = op.build_mapping({"users": users}, {"users": RULES})
    table = {(r["type"], r["original"]): r["fake"] for r in mapping.collect()}
    assert len(table) == mapping.count()
    for before, after in zip(users.orderBy("id").collect(), op.pseudonymize_table(users, RULES).orderBy("id").collect()):
        if before["email"] is not None:
            assert table["email", before["email"]] == after["email"]
            assert table["age", str(before["age"])] == str(after["age"])


def test_mapping_stats(spark, users):
    pairs = op.originals({"users": users}, {"users": {"email": "email", "age": "age"}})
    assert op.mapping_stats(pairs).first().asDict() == {
        "hits": 2,
        "misses": 6,
        "total": 8,
        "hit_rate": 25.0,
        "mapping_size": 6,
    }
    assert op.mapping_stats(pairs.where("false")).first().asDict() == {
        "hits": 0,
        "misses": 0,
        "total": 0,
        "hit_rate": 0.0,
        "mapping_size": 0,
    }


def test_unique_mapping_is_injective_and_repeatable(spark):
    df = spark.range(5000).selectExpr("concat('p', id) AS name", "concat('m', id, '@probe.example') AS email")
    args = ({"t": df}, {"t": {"name": "first_name", "email": "email"}})
    one = op.build_mapping(*args, unique=True)
    assert one.count() == 10_000
    assert one.groupBy("type", "fake").count().where("count > 1").count() == 0
    assert one.where("type = 'email' AND NOT fake rlike '^[^@]+-[0-9]+@example[.](test|invalid|local)$'").count() == 0
    two = op.build_mapping({"t": df.repartition(9)}, args[1], unique=True)
    assert one.exceptAll(two).count() == 0


def test_apply_mapping_with_a_hot_value(spark):
    """A third of the rows share one value, a third have none."""
    df = spark.range(6000).selectExpr(
        "id", "CASE id % 3 WHEN 0 THEN 'hot' WHEN 1 THEN NULL ELSE concat('v', id % 100) END AS city", "id % 5 AS n"
    )
    known = spark.createDataFrame(
        [("city", "hot", "H"), ("city", "v2", "V2"), ("other", "v5", "no")], "type string, original string, fake string"
    )
    keep = PreserveRules(("v8",), mode="strict")
    got = op.apply_mapping(df, known, {"city": "city"}, preserve=keep)
    assert got.columns == df.columns and got.count() == 6000
    want = df.withColumn(
        "city",
        F.when(F.col("city") == "hot", "H")
        .when(F.col("city") == "v2", "V2")
        .when(F.col("city").startswith("v8"), F.col("city"))
        .otherwise(fake("city", F.col("city"))),
    )
    assert got.exceptAll(want).count() == 0
    assert next(iter(hot_values(df, "city").items())) == ("hot", 8)  # half of the values: four of eight partitions, twice as many for it


def test_salted_join_equals_plain_join(spark):
    left = spark.range(500).selectExpr("id", "CASE WHEN id % 2 = 0 THEN 'a' WHEN id % 7 = 0 THEN NULL ELSE concat('k', id % 9) END AS key")
    right = spark.createDataFrame([("a", 1), ("k1", 2), ("k1", 3), ("zz", 4)], "key string, n int")
    got = salted_left_join(left, right, "key", {"a": 5, "it's": 2}).select("id", "key", "n")
    want = left.join(right, "key", "left").select("id", "key", "n")
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_drop_expired(spark):
    df = spark.sql("SELECT explode(sequence(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-03', INTERVAL 12 HOURS)) AS ts")
    assert op.drop_expired(df, "ts", timedelta(hours=24), datetime(2024, 1, 3)).count() == 3


def test_stream_equals_batch(spark, users):
    source, target, state = (shared_dir(spark, p) for p in ("src", "out", "state"))
    users.write.parquet(source)
    stream = spark.readStream.schema(users.schema).parquet(source)
    for _ in range(2):  # the second start finds nothing new
        out = streaming.pseudonymize_stream(stream, RULES)
        streaming.start_available(out, target, state).awaitTermination()
    got = spark.read.parquet(target)
    want = op.pseudonymize_table(users, RULES)
    assert got.count() == 5 and got.exceptAll(want).count() == 0
    with pytest.raises(ValueError):
        streaming.pseudonymize_stream(users, RULES)


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def test_plans(spark, users, tmp_path):
    """Replacing neither shuffles nor leaves the JVM, reads what it needs, and the
    retention filter reaches the scan."""
    path = str(tmp_path / "t")
    users.withColumn("ts", F.current_timestamp()).write.parquet(path)
    df = spark.read.parquet(path)
    text = plan(op.pseudonymize_table(df, RULES).select("email"))
    assert "Exchange" not in text and "Python" not in text
    assert "ReadSchema: struct<email:string>" in text
    text = plan(op.findings(df.select("id", F.col("email").alias("text"))))
    assert "Exchange" not in text and "Python" not in text
    text = plan(op.drop_expired(df, "ts", timedelta(days=1), datetime(2024, 1, 1)))
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts" in text
    text = plan(op.detect_columns(df.select(F.lit("users").alias("table"), F.col("email").alias("column"))))
    assert "BroadcastHashJoin" in text and "Exchange hashpartitioning" not in text
    text = plan(op.build_mapping({"t": df}, {"t": RULES}))
    assert text.count("HashAggregate") >= 2  # duplicates are merged before the shuffle


def test_shared_dir_follows_the_setting(spark):
    root = spark.conf.get("spark.checkpoint.dir")
    assert shared_dir(spark, "x").startswith(root + "/x-")


@pytest.mark.parametrize("kind", ["age", "house_number", "birthdate", "postcode"])
def test_unique_fakes_fill_their_range(spark, kind):
    size = min(RANGES[kind], 80_000)
    df = spark.range(size).selectExpr("concat('x', id) AS v")
    made = op.build_mapping({"t": df}, {"t": {"v": kind}}, unique=True).cache()
    assert made.count() == made.select("fake").distinct().count() == size
    if size == RANGES[kind]:
        low, high = made.agg(F.min("fake"), F.max("fake")).first()
        assert (low, high) == {"age": ("18", "80"), "house_number": ("1", "99"), "birthdate": ("1900-01-01", "2099-12-31")}[kind]
        more = spark.range(size + 1).selectExpr("concat('x', id) AS v")
        with pytest.raises(Exception, match="than it has different fakes"):
            op.build_mapping({"t": more}, {"t": {"v": kind}}, unique=True).collect()
    made.unpersist()


@pytest.mark.parametrize("kind", sorted(RANGES))
def test_permuted_numbers(spark, kind):
    a, b = sides(RANGES[kind])
    assert min(a, b) > 1 and 0 <= a * b - RANGES[kind] < 5
    n = min(RANGES[kind], 3000)
    rows = spark.range(n).select(permuted(F.col("id"), kind, "s").alias("x"), permuted(F.lit(RANGES[kind] - 1) - F.col("id"), kind, "s").alias("y"))
    out = rows.agg(F.countDistinct("x").alias("x"), F.countDistinct("y").alias("y"), F.min("x").alias("low"), F.max("x").alias("high")).first()
    assert (out.x, out.y) == (n, n) and 0 <= out.low and out.high < RANGES[kind]


def test_a_unique_mapping_goes_on(spark):
    def table(n):
        return {"t": spark.range(n).selectExpr("concat('p', id) AS name", "CAST(id % 40 AS TINYINT) AS age")}

    rules = {"t": {"name": "last_name", "age": "age"}}
    one = op.build_mapping(table(500), rules, unique=True)
    two = op.build_mapping(table(2000), rules, unique=True, earlier=one)
    three = op.build_mapping(table(3000), rules, unique=True, earlier=two)
    assert one.exceptAll(two).count() == 0 and two.exceptAll(three).count() == 0 and three.count() == 3040
    assert three.groupBy("type", "fake").count().where("count > 1").count() == 0
    people = table(100)["t"]
    out = op.apply_mapping(people, three, rules["t"])
    assert out.schema["age"].dataType.simpleString() == "tinyint" and out.where("age BETWEEN 18 AND 80").count() == 100


def test_apply_mapping_looks_all_columns_up_in_one_join(spark):
    """One eager job and two joins whatever the number of columns; same rows as column by column."""
    names = ["a", "b", "c", "d", "e"]
    df = spark.range(300).select("id", *[F.when(F.col("id") % (i + 2) == 0, F.concat(F.lit("v"), (F.col("id") % 7).cast("string"))).alias(c) for i, c in enumerate(names)])
    known = spark.range(4).select(F.lit("city").alias("type"), F.concat(F.lit("v"), "id").alias("original"), F.concat(F.lit("K"), "id").alias("fake"))
    rules = {"a": "city", "b": "street", "c": "city", "d": "last_name", "e": "city"}
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("apply", "apply")
    out = op.apply_mapping(df, known, rules)
    assert len(tracker.getJobIdsForGroup("apply")) <= 3  # one action, with the stages of its shuffle
    spark.sparkContext.setJobGroup("rest", "rest")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 2
    want = df
    for c, kind in rules.items():
        hit = F.col(c).isin("v0", "v1", "v2", "v3") & F.lit(kind == "city")
        want = want.withColumn(c, F.when(F.col(c).isNull(), None).when(hit, F.concat(F.lit("K"), F.substring(c, 2, 9))).otherwise(fake(kind, F.col(c))))
    assert out.exceptAll(want).count() == 0 and out.count() == 300


def test_listed_json_keys_are_found_by_their_prefix_tree(spark):
    """Each name of the column rules in other spellings, beside keys that only begin or end like one;
    the same pairs as by one alternative per name."""
    names = [r.name for r in COLUMN_RULES]
    keys = [*names, *(n.upper().replace("_", "-") for n in names), *(n.title().replace("_", " ") for n in names)]
    keys += [n + "x" for n in names] + ["x" + n for n in names] + [n[:-1] for n in names if len(n) > 1]
    values = ['"a b"', '"q\\"u, \\"name\\": 1"', "12", "-1.50E3", "true", "null", '""', '"\\u00e4"', "[1]"]
    docs = ["{" + ", ".join(f'"{k}" : {v}' for k in keys[i::7]) + "}" for i in range(7) for v in values]
    old = "(?iu)" + json_docs._pair_regex("|".join(json_docs._regex_literal(n).replace("_", "[-_ ]") for n in names))
    df = spark.createDataFrame([(d,) for d in docs], "doc string").coalesce(1)
    pairs = [F.regexp_extract_all("doc", F.lit(r), F.lit(0)) for r in (old, json_docs._listed_pair_regex(names))]
    found = df.select(pairs[0].alias("old"), pairs[1].alias("new")).collect()
    assert all(r["old"] == r["new"] for r in found) and sum(len(r["new"]) for r in found) > 1000
    one = spark.createDataFrame([('{"Name" : "q\\"u\\\\", "mail": -1.50E3, "xname": "n", "PLZ":"\\u00e4"}',)], "doc string")
    got = json.loads(op.pseudonymize_json_text(one, "doc", seed="s").first()[0])
    text = '{"v": -1.50E3}'
    number = one.select(F.get_json_object(F.lit(text), "$.v")).first()[0]
    wants = {"Name": ("full_name", 'q"u\\'), "mail": ("email", number), "PLZ": ("postcode", "ä")}
    want = one.select(*[fk.fake(t, F.lit(v), "s").alias(k) for k, (t, v) in wants.items()]).first().asDict()
    assert got == {**want, "xname": "n"}
