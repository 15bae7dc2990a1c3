"""CSV, JSON, text files, databases."""

import json

import pytest
from pyspark.sql import functions as F

from incognita import functions as fn
from incognita import operators as op
from incognita import sources as src
from incognita.operators.json_docs import schema_keys

HEADER = "firstname lastname email phone birthdate street city zip company".split()
ROW = ["Jörn", "Größer", "j@probe.example", "+49 89 5550123", "1978-12-05", "Alter Weg 7", "München", "80331", "G & Co"]


@pytest.mark.parametrize(
    "header,want",
    [("a,b,c", ","), ("a;b,c;d", ";"), ("a\tb", "\t"), ("a|b|c,d", "|"), ("a", ","), ("a,b;c", ","), ("a;b|c", ";")],
)
def test_delimiter(header, want):
    assert src.detect_delimiter(header) == want


@pytest.mark.parametrize("sep", [",", ";", "\t", "|"])
def test_csv_read_replace_write(spark, tmp_path, sep):
    source, target = str(tmp_path / "in.csv"), str(tmp_path / "out")
    with open(source, "w", encoding="utf-8") as f:
        f.write(sep.join(HEADER) + "\n" + sep.join(ROW) + "\n\n" + sep.join(["Anna", "", *ROW[2:]]) + "\n")
    layout = src.sniff_csv(spark, source)
    assert (layout.delimiter, layout.columns) == (sep, HEADER) and layout.sample[0] == sep.join(ROW)
    assert src.pseudonymize_csv(spark, source, target).delimiter == sep
    out = src.read_csv_sniffed(spark, target)
    rows = out.collect()
    assert out.columns == HEADER and len(rows) == 2
    assert all(a != b for a, b in zip(rows[0], ROW))
    assert rows[0]["email"] == rows[1]["email"] and rows[0]["birthdate"][4] == "-"


def test_csv_quotes_blanks_and_empty(spark, tmp_path):
    df = spark.createDataFrame([('say "hi", ok', " pad ", ""), ("back\\slash", "", "x")], "a string, b string, c string")
    path = str(tmp_path / "q")
    src.write_csv(df, path)
    assert {tuple(r) for r in src.read_csv_sniffed(spark, path).collect()} == {tuple(r) for r in df.collect()}


def test_csv_keep_rule(spark, tmp_path):
    source, target = str(tmp_path / "in.csv"), str(tmp_path / "out")
    with open(source, "w", encoding="utf-8") as f:
        f.write("email,city\na@b.de,Ort\n")
    src.pseudonymize_csv(spark, source, target, {"email": {"action": "keep", "type": "email"}, "city": "city"})
    row = src.read_csv_sniffed(spark, target).first()
    assert row["email"] == "a@b.de" and row["city"] != "Ort"


DOC = {
    "users": [
        {
            "id": 1,
            "firstname": "Jörn",
            "email": "j@probe.example",
            "birthdate": "1985-04-12",
            "address": {"street": "Weg 1", "zip": "40210"},
            "phone": ["1", "2"],
            "login": True,
        },
        {"id": 2, "firstname": "Anke", "email": "j@probe.example", "address": {"street": None, "zip": "10115"}},
    ],
    "company": "Probe GmbH",
    "account": 12345,
    "contact_email": None,
}


def test_json_structure_and_rules(spark, tmp_path):
    path = tmp_path / "doc.json"
    path.write_text(json.dumps(DOC, ensure_ascii=False, indent=1), encoding="utf-8")
    df = src.read_json(spark, str(path), multi_line=True)
    assert set(schema_keys(df.schema)) == (
        {"users", "id", "firstname", "email", "birthdate", "address", "street", "zip", "phone", "login"}
        | {"company", "account", "contact_email"}
    )
    out = str(tmp_path / "out")
    src.write_json(op.pseudonymize_json(df), out)
    text = "".join(p.read_text(encoding="utf-8") for p in (tmp_path / "out").glob("part-*"))
    new = json.loads(text)
    assert new["users"][0]["id"] == 1 and new["users"][0]["login"] is True
    assert new["users"][0]["firstname"] != "Jörn" and new["users"][0]["address"]["zip"] != "40210"
    assert new["users"][0]["email"] == new["users"][1]["email"] != "j@probe.example"
    assert new["users"][0]["phone"] == ["1", "2"]  # scalars in an array have no key
    assert new["users"][1]["address"]["street"] is None and new["contact_email"] is None
    assert new["account"].startswith("DE") and new["company"] != "Probe GmbH"


def test_json_keep_and_maps(spark):
    df = spark.createDataFrame([({"email": "a@b.de", "x": "y"}, "Ort")], "m map<string,string>, city string")
    row = op.pseudonymize_json(df, {"email": "email", "city": {"action": "keep", "type": "city"}}).first()
    assert row["city"] == "Ort" and row["m"]["x"] == "y" and "@example." in row["m"]["email"]


def test_invalid_json_is_an_error(spark, tmp_path):
    path = tmp_path / "bad.json"
    path.write_text('{"a": 1}\n{"a": \n')
    with pytest.raises(Exception):
        src.read_json(spark, str(path)).collect()
    df = spark.createDataFrame([("{broken",)], "doc string")
    with pytest.raises(Exception):
        op.json_keys(df, "doc").collect()


def test_json_keys_first_element_only(spark):
    docs = ['{"users":[{"a":1,"b":null},{"c":2}],"x":{"y":{"a":3}}}', '{"x":{},"mail":["s"]}']
    df = spark.createDataFrame([(d,) for d in docs], "doc string")
    got = {r["key"]: r["documents"] for r in op.json_keys(df, "doc").collect()}
    assert got == {"users": 1, "a": 1, "b": 1, "x": 2, "y": 1, "mail": 1}
    verdict = {r["column"]: r["type"] for r in op.detect_json_keys(df, "doc").collect()}
    assert verdict["mail"] == "email" and verdict["x"] is None


def test_json_text_column_is_changed_in_place(spark):
    docs = [
        '{ "u" : {"E-Mail": "a@b.de", "n":1, "gone": null}, "z": true }',
        '{"k":[1,2],"phone":["1"]}',
        None,
        '[{"zip": 40210}, {"zip": -1.5e3}, {"zip":"say \\"zip\\": 5"}, ["x", ": 5"], {"city":null}]',
        '{"say \\"city": "stays", "note": "\\"city\\": \\"x\\"", "CITY": "Ort"}',
        '{"email":"a@b.de"}',
    ]
    df = spark.createDataFrame(list(enumerate(docs)), "id int, doc string")
    rows = {r["id"]: r["doc"] for r in op.pseudonymize_json_text(df, "doc").collect()}
    email = df.select(fn.fake("email", F.lit("a@b.de"))).first()[0]
    assert rows[0] == docs[0].replace("a@b.de", email)
    assert rows[1] == docs[1] and rows[2] is None and rows[5] == '{"email":"%s"}' % email
    want = spark.range(1).select(
        *[fn.fake("postcode", F.lit(v)) for v in ("40210", "-1500.0", 'say "zip": 5')]
    ).first()
    new = json.loads(rows[3])
    assert new[0]["zip"] == want[0] and new[2]["zip"] == want[2] and new[3:] == json.loads(docs[3])[3:]
    assert json.loads(rows[4])['say "city'] == "stays" and '"note": "\\"city\\": \\"x\\""' in rows[4]
    assert json.loads(rows[4])["CITY"] != "Ort"
    some = op.pseudonymize_json_text(df, "doc", {"zip": "uuid"}, preserve=fn.PreserveRules(("402",), mode="strict"))
    kept = {r["id"]: r["doc"] for r in some.collect()}
    assert kept[0] == docs[0] and '{"zip": 40210}' in kept[3] and "-1.5e3" not in kept[3]
    with pytest.raises(Exception):
        op.pseudonymize_json_text(spark.createDataFrame([("{oops",)], "doc string"), "doc").collect()


def test_json_preview(spark):
    deep = {"a": {"b": {"c": {"d": {"e": 1}}}}, "n": 5, "s": "x" * 60, "l": [1, 2], "e": []}
    df = spark.read.json(spark.sparkContext.parallelize([json.dumps(deep)]))
    got = json.loads(op.preview_rows(df).first()[0])
    assert got["a"] == {"b": {"c": {"d": ["..."]}}} and got["n"] == 5
    assert got["s"] == "x" * 50 + "..." and got["l"] == ["[array mit 2 Elementen]"] and got["e"] == []
    wide = spark.sql("SELECT 1 a, 2 b, 3 c, 4 d, 5 e, 6 f")
    assert json.loads(op.preview_rows(wide).first()[0]) == {"a": 1, "b": 2, "c": 3, "d": 4, "e": 5, "...": "..."}


def test_text_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\ntwo", encoding="utf-8")
    (tmp_path / "b.txt").write_text("ü" * 600, encoding="utf-8")
    rows = src.read_text(spark, str(tmp_path)).select(op.text_sample(F.col("text")).alias("s")).collect()
    assert sorted(len(r["s"]) for r in rows) == [7, 500]
    target = str(tmp_path / "records")
    df = spark.createDataFrame([("x\ny",), ("",), ("z",)], "text string")
    src.write_text(df, "text", target)
    back = src.read_text(spark, target, record_end="\u001e").select("text")
    assert sorted(r["text"] for r in back.collect()) == ["", "x\ny", "z"]


def test_database_options():
    db = src.Database("pgsql", host="db", database="app", user="u", password="p")
    assert db.url == "jdbc:postgresql://db:5432/app"
    assert db.options() == {"url": db.url, "driver": "org.postgresql.Driver", "user": "u", "password": "p"}
    assert "password" not in repr(db) and "'p'" not in repr(db)
    assert src.Database("mysql", port=3307, database="x").url == "jdbc:mysql://localhost:3307/x"
    assert src.Database(path="/data/a.db").url == "jdbc:sqlite:/data/a.db"
    with pytest.raises(ValueError):
        src.Database("oracle")


def test_pages(spark):
    df = spark.range(100).selectExpr("99 - id AS k", "id AS v")
    page = src.fetch_batch(df, ["k"], "k", 10, 5).collect()
    assert [r["k"] for r in page] == [10, 11, 12, 13, 14]
    assert [r["k"] for r in src.fetch_after(df, ["k"], "k", 14, 2).collect()] == [15, 16]
    assert [r["k"] for r in src.fetch_after(df, ["k"], "k", None, 1).collect()] == [0]
    assert src.count_rows(df).first()["row_count"] == 100


def test_write_table(spark, tmp_path):
    df = spark.range(10).selectExpr("id", "id % 2 AS part")
    src.write_table(df, str(tmp_path / "t"), partition_by=["part"])
    assert spark.read.parquet(str(tmp_path / "t")).count() == 10


def test_json_keys_of_wide_and_deep_data(spark):
    many = [('{"u%d": {"it\'s a.key \\"%d": 1, "same": {"same": [[{"x": null}]]}}}' % (i, i % 3),) for i in range(2000)]
    got = {r["key"]: r["documents"] for r in op.json_keys(spark.createDataFrame(many, "doc string"), "doc").collect()}
    assert len(got) == 2005 and got["same"] == got["x"] == 2000 and got["u7"] == 1
    assert sum(n for k, n in got.items() if k.startswith("it's")) == 2000
    assert op.json_keys(spark.createDataFrame([(None,)], "doc string"), "doc").collect() == []


def test_map_without_rules_stays(spark):
    df = spark.createDataFrame([({"a": 1},)], "m map<string,int>")
    assert op.pseudonymize_json(df, {}).schema == df.schema


def test_json_keys_of_long_numbers_deep_and_repeated(spark):
    texts = ['{"n":' + "9" * 5000 + ',"m":1e999,"n":2}', '{"a":' * 1500 + "1" + "}" * 1500, "[" * 1500 + '{"z":1}' + "]" * 1500]
    got = {r["key"]: r["documents"] for r in op.json_keys(spark.createDataFrame([(t,) for t in texts], "doc string"), "doc").collect()}
    assert got == {"n": 1, "m": 1, "a": 1, "z": 1}


def test_json_text_with_spelt_keys(spark):
    docs = ['{"na\\u006de":"Bob","e":1}', '{"NA\\u006DE" : "Bob", "x\\u006d": "Bob"}', '{"x":"\\u0041","name":"Bob"}', '{"a\\/b":"Bob"}', '{"v":"na\\u006de: 1"}']
    df = spark.createDataFrame([(i, d) for i, d in enumerate(docs)], "i int, doc string")
    by_rule = {r.i: r.doc for r in op.pseudonymize_json_text(df, "doc", {"name": "full_name", "a/b": "city"}).collect()}
    detected = {r.i: r.doc for r in op.pseudonymize_json_text(df, "doc").collect()}
    assert "Bob" not in by_rule[0] + by_rule[2] + by_rule[3] and by_rule[1] == docs[1] and by_rule[4] == docs[4]
    assert '"x\\u006d": "Bob"' in detected[1] and detected[1].count("Bob") == 1 and "Bob" not in detected[0] + detected[2]
    assert by_rule[0].startswith('{"na\\u006de":"') and by_rule[0].endswith('","e":1}') and detected[3] == docs[3]
