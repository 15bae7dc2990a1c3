"""Records over several lines, on files of many splits."""

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from incognita import sources as src
from incognita.sources.csv_files import write_csv
from incognita.sources.dump import parse_inserts, pseudonymize_insert_dump, read_insert_dump
from incognita.sources.records import CSV_LEXER, DUMP_LEXER, read_records


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def plain_statements(text):
    """Statements by one walk over the characters."""
    out, now, quote, i = [], "", "", 0
    while i < len(text):
        c, two = text[i], text[i : i + 2]
        size = 1
        if quote in ("'", '"'):
            if c == "\\":
                size = 2
            elif c == quote:
                quote = ""
        elif quote == "`":
            quote = "" if c == "`" else quote
        elif quote == "/*":
            if two == "*/":
                quote, size = "", 2
        elif quote == "\n":
            quote = "" if c == "\n" else quote
        elif two == "/*":
            quote, size = two, 2
        elif two == "--" or c == "#":
            quote = "\n"
        elif c in "'\"`":
            quote = c
        if c == "\n" and not quote and now.rstrip(" \t\r").endswith(";"):
            out.append(now)
            now = ""
        else:
            now += text[i : i + size]
        i += size
    return [*out, now] if now else out


def dump_text(seed, n):
    rng = random.Random(seed)
    parts = ["'a;\nb'", "'it''s'", "'x\\';\ny'", '"q;\n"', "`c;\nd`", "/* c ' ;\n more */", "-- don't ;\n", "# it's\n", " 1 - 2 / 3 ", "\n", "(NULL)", "'\\\\'", "x" * 90, "'" + "long;\n" * 40 + "'", ";\r\n", ";\n", ";\n", "\n\n"]
    return "".join(rng.choice(parts) + " " * rng.randrange(2) for _ in range(n))


@pytest.mark.parametrize("seed", range(4))
def test_statements_of_many_splits(spark, tmp_path, small_splits, seed):
    texts = [dump_text(seed, 500), dump_text(seed + 50, 300) + "INSERT INTO last", ""]
    for i, text in enumerate(texts):
        (tmp_path / f"{i}.sql").write_bytes(text.encode())
    found = read_records(spark, str(tmp_path), DUMP_LEXER)
    rows = found.orderBy("file", "block", "id").collect()
    got = {}
    for r in rows:
        got.setdefault(r.file, []).append(r.record)
        assert r.first == (len(got[r.file]) == 1)
    assert sorted(got.values()) == sorted(plain_statements(t) for t in texts if t)
    assert len({r.block for r in rows}) > 10


@pytest.mark.parametrize("quoted", [0.0, 0.5])
def test_csv_of_many_splits(spark, tmp_path, small_splits, quoted):
    rng = random.Random(7)
    cells = ["", "plain", 'say "hi"', "a,b", "two\nlines", "\n", 'x"\n\n"y', " pad ", "long\n" * 300]
    rows = [[str(i), rng.choice(cells) if rng.random() < quoted else "word", rng.choice(["", "z", "name,note"])] for i in range(900)]
    rows[500] = ["id", "note", "last"]  # a line like the header is data
    for k in range(2):
        out = io.StringIO()
        csv.writer(out, lineterminator="\n").writerows([["id", "note", "last"], *rows[k * 450 : k * 450 + 450]])
        (tmp_path / f"{k}.csv").write_text(out.getvalue())
    df = src.read_csv_sniffed(spark, str(tmp_path), multi_line=True)
    assert df.columns == ["id", "note", "last"]
    assert sorted(map(tuple, df.collect())) == sorted(map(tuple, rows))
    assert read_records(spark, str(tmp_path), CSV_LEXER).rdd.getNumPartitions() > 4
    if not quoted:
        assert sorted(map(tuple, src.read_csv_sniffed(spark, str(tmp_path)).collect())) == sorted(map(tuple, rows))
    target = str(tmp_path / "again")
    write_csv(df, target)
    again = src.read_csv_sniffed(spark, target, multi_line=True)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, rows))


def test_line_like_the_header_is_data(spark, tmp_path):
    path = tmp_path / "one.csv"
    path.write_text('name,email\nBob,a@b.de\nname,email\n\nx"y,\\"z\n')
    want = [("Bob", "a@b.de"), ("name", "email"), ('x"y', '\\"z')]
    for multi in (False, True):
        assert [tuple(r) for r in src.read_csv_sniffed(spark, str(path)).collect()] == want or multi
    assert {tuple(r) for r in src.read_csv_sniffed(spark, str(tmp_path)).collect()} == set(want)


def test_lines_with_any_character_come_back_whole(spark, tmp_path):
    rows = [("a\ufffeb", "1"), ("\u0000x\u0000", "2"), ("x\ufdd0y", "3"), (" z ", "4"), ("\\", "5"), ("#c", "6")]
    (tmp_path / "x.csv").write_text("v,n\n" + "".join(f"{v},{n}\n" for v, n in rows), encoding="utf-8")
    assert [tuple(r) for r in src.read_csv_sniffed(spark, str(tmp_path / "x.csv")).collect()] == rows


def test_odd_files(spark, tmp_path):
    (tmp_path / "empty.csv").write_text("")
    assert src.read_csv_sniffed(spark, str(tmp_path / "empty.csv"), multi_line=True).count() == 0
    (tmp_path / "head.csv").write_text("a,b")
    for multi in (True, False):
        assert src.read_csv_sniffed(spark, str(tmp_path / "head.csv"), multi_line=multi).collect() == []
    (tmp_path / "crlf.csv").write_bytes(b'a,b\r\n1,"x\r\ny"\r\n\r\n2,z\r\n')
    rows = src.read_csv_sniffed(spark, str(tmp_path / "crlf.csv"), multi_line=True).collect()
    assert sorted((r[0], r[1].replace("\r", "")) for r in rows) == [("1", "x\ny"), ("2", "z")]


def test_dump_with_ends_in_literals_keeps_every_character(spark, tmp_path, small_splits):
    statements = [f"INSERT INTO users (id, name, note) VALUES ({i}, 'Bob;\n{i}', 'it''s; \\\\'),\n ({i}, \"Eve;\n\", NULL)" for i in range(200)]
    statements += ["-- a comment; don't\nCREATE TABLE x (a int)", "/* ;\n */ INSERT INTO other (a) VALUES ('Bob;\n')"]
    path = tmp_path / "d.sql"
    path.write_text(";\n".join(statements) + ";\n")
    dump = read_insert_dump(spark, str(path))
    assert sorted(r.statement for r in dump.collect()) == sorted(statements)
    rules = {"users": {"name": "last_name"}}
    given = spark.createDataFrame([(s,) for s in statements], "statement string")
    want = pseudonymize_insert_dump(parse_inserts(given), rules)
    assert sorted(r.statement for r in pseudonymize_insert_dump(dump, rules).collect()) == sorted(r.statement for r in want.collect())


def test_another_split_is_an_error_and_not_a_loss(spark, tmp_path, small_splits):
    (tmp_path / "a.csv").write_text("x,y\n" + 'word,"a\nb"\n' * 500)
    df = read_records(spark, str(tmp_path), CSV_LEXER)
    assert df.count() == 501
    spark.conf.set("spark.sql.files.maxPartitionBytes", "333")
    with pytest.raises(Exception, match="in another way"):
        df.select(F.length("record").alias("n")).count()
