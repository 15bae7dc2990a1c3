"""SQL dumps: INSERT statements in, rows or rewritten statements out.

Only the INSERT shape is taken apart, by regular expressions inside Spark; other
statements pass through as text. A statement is cut into head, values and rest, the
values into tuples and what stands between them; what is not replaced is given back as
it was, and an INSERT that can't be cut completely raises an error where its table is to be
changed or read. All quantifiers over groups are possessive, so that long literals
neither backtrack nor grow the regex engine's stack.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from incognita.functions import fakes as fk
from incognita.functions.arrays import bind
from incognita.functions.preserve import PreserveRules, should_preserve
from incognita.operators.tables import ColumnRules, quoted
from incognita.sources.records import DUMP_LEXER, read_records

STATEMENT_END = ";\n"
ROWS_PER_INSERT = 1000  # fixed value

_SINGLE = r"'[^'\\]*+(?:(?:\\.|'')[^'\\]*+)*+'"
_DOUBLE = r'"[^"\\]*+(?:(?:\\.|"")[^"\\]*+)*+"'
_DEPTH = 6  # brackets within brackets that a value may hold


def _nested(depth: int) -> str:
    inner = rf"|{_nested(depth - 1)}" if depth else ""
    return rf"\((?:[^'\"()]++|{_SINGLE}|{_DOUBLE}{inner})*+\)"


_CALL = _nested(_DEPTH - 1)
_PIECE = rf"(?:{_SINGLE}|{_DOUBLE}|{_CALL})"
_TUPLE_BODY = rf"\((?:[^'\"()]++|{_PIECE})*+\)"
_TUPLE = rf"(?s){_TUPLE_BODY}"
_VALUE = rf"(?s)(?:[^,'\"()]++|{_PIECE})++"
# the tuples of a statement and the commas between them
_LIST = rf"(?s)^({_TUPLE_BODY}(?:\s*+,\s*+{_TUPLE_BODY})*+)"
_TOKEN = rf"(?s){_TUPLE_BODY}|[^(]++"
# blanks and comments, then INSERT [IGNORE] INTO [database.]name (columns) VALUES
_LEAD = r"(?:\s++|(?:--|#)[^\n]*+(?:\n|$)|/\*(?:[^*]++|\*(?!/))*+\*/)*+"
_NAME = r"(?:`[^`]*+`|\"[^\"]*+\"|[\w$]++)"
_WORDS = r"(?:insert|replace)(?:\s++(?:ignore|low_priority|delayed|high_priority))*+(?:\s++into)?+"
_START = rf"(?is)^{_LEAD}{_WORDS}\s*+(?:{_NAME}\s*+\.\s*+)?+({_NAME})"
_HEAD = rf"(?is)^({_LEAD}{_WORDS}\s*+(?:{_NAME}\s*+\.\s*+)?+({_NAME})\s*+(?:\(([^)]*+)\)\s*+)?+values?\s*+)"
_NUMBER = r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?$"


def read_insert_dump(spark: SparkSession, path: str, statement_end: str | None = None) -> DataFrame:
    """One row per statement: statement, head, table, columns, tuples, values, rest (the last six
    NULL or empty for anything but an INSERT).

    A statement ends where a line ends in ``;`` outside quotes and comments of several lines.
    Large dumps are read in parallel: what a split begins with is told by ``read_records``. With a
    ``statement_end`` given, every occurrence of it ends a statement.
    """
    text = F.col("statement")
    if statement_end:
        statements = spark.read.text(path, lineSep=statement_end).select(F.col("value").alias("statement"))
    else:
        ended = F.regexp_replace("record", r";[ \t\r]*+$", "")
        statements = read_records(spark, path, DUMP_LEXER).select(ended.alias("statement"))
    return parse_inserts(statements.where(F.trim(text, F.lit(" \t\r\n")) != ""))


def parse_inserts(df: DataFrame, column: str = "statement") -> DataFrame:
    """The INSERT parts of a column of statements (without their ``;``)."""
    text = F.col(quoted(column))
    # The head is cut out once; table and columns are read from that short text.
    headed = df.withColumn("head", F.nullif(F.regexp_extract(text, _HEAD, 1), F.lit("")))
    head = F.col("head")
    named = F.coalesce(head, F.regexp_extract(text, _START, 0))
    body = F.substring(text, F.length(head) + 1, F.length(text))
    names = F.split(F.regexp_extract(head, _HEAD, 3), ",")
    cut = headed.select(
        "*",
        F.nullif(_bare(F.regexp_extract(named, _START, 1)), F.lit("")).alias("table"),
        F.transform(names, lambda c: F.trim(c, F.lit(" \t\r\n`\"'"))).alias("columns"),
        F.regexp_extract(body, _LIST, 1).alias("values"),
    )
    return cut.select(
        "*",
        F.regexp_extract_all("values", F.lit(_TUPLE), F.lit(0)).alias("tuples"),
        F.substring(text, F.length(head) + F.length("values") + 1, F.length(text)).alias("rest"),
    )


def _bare(name: Column) -> Column:
    return F.trim(name, F.lit('`"'))


# What may follow the tuples without holding a row of its own.
_REST = r"(?is)^\s*+(?:;\s*+)?+(?:(?:on\s++(?:duplicate|conflict)|returning|as\s)\b?.*+)?+$"


def _complete() -> Column:
    """Whether an INSERT has been cut into head, values and a rest that holds no row."""
    return F.col("head").isNotNull() & (F.col("values") != "") & F.col("rest").rlike(_REST)


def _or_error(test: Column, value: Column, message: str) -> Column:
    """The value, or an error that shows the statement's start."""
    error = F.raise_error(F.concat(F.lit(message + ": "), F.left("statement", F.lit(200))))
    return F.when(test, value).otherwise(error.cast("array<string>"))


def _values(row: Column) -> Column:
    inner = F.substring(row, F.lit(2), F.length(row) - 2)
    return F.transform(F.regexp_extract_all(inner, F.lit(_VALUE), F.lit(0)), lambda v: F.trim(v, F.lit(" \t\r\n")))


def _is_quoted(literal: Column) -> Column:
    return literal.rlike("(?s)^(?:'.*'|\".*\")$")


def unquote(literal: Column) -> Column:
    """Content of a quoted literal, escapes resolved."""
    inner = F.substring(literal, F.lit(2), F.length(literal) - 2)
    doubled = F.when(F.startswith(literal, F.lit("'")), F.replace(inner, F.lit("''"), F.lit("'"))).otherwise(
        F.replace(inner, F.lit('""'), F.lit('"'))
    )
    # escapes with a meaning of their own, between doubled backslashes set aside
    parts = F.split(doubled, r"\\\\", -1)

    def resolved(part: Column) -> Column:
        for sign, meant in (("n", "\n"), ("r", "\r"), ("t", "\t"), ("0", "\u0000")):
            part = F.replace(part, F.lit("\\" + sign), F.lit(meant))
        return F.regexp_replace(part, r"(?s)\\(.)", "$1")

    escaped = F.array_join(F.transform(parts, resolved), "\\")
    return F.when(F.contains(doubled, F.lit("\\")), escaped).otherwise(doubled)


def value_kind(literal: Column) -> Column:
    return (
        F.when(F.upper(literal) == "NULL", "null")
        .when(literal.rlike(_NUMBER), "number")
        .when(_is_quoted(literal), "string")
        .otherwise("raw")
    )


def dump_rows(dump: DataFrame) -> DataFrame:
    """One row per value tuple: table, columns, literals."""
    inserts = dump.where("table IS NOT NULL")
    tuples = _or_error(_complete(), F.col("tuples"), "an INSERT that can't be taken apart")
    rows = inserts.select("table", "columns", F.explode(tuples).alias("row"))
    return rows.select("table", "columns", _values(F.col("row")).alias("literals"))


def dump_schema(dump: DataFrame) -> DataFrame:
    """(table, column) of every INSERT in the dump."""
    named = dump.where("table IS NOT NULL").select("table", F.explode("columns").alias("column"))
    return named.where("column <> ''").distinct()


def dump_table(dump: DataFrame, table: str, columns: list[str]) -> DataFrame:
    """The rows of one table as string columns, bound by the names each INSERT
    states; an INSERT without a column list is bound by position."""
    rows = dump_rows(dump.where(F.col("table") == table))
    stated = F.filter("columns", lambda c: c != "")
    order = F.when(F.size(stated) > 0, stated).otherwise(F.array(*[F.lit(c) for c in columns]))
    cells = rows.select(F.map_from_arrays(order, "literals").alias("cell"))

    def cell(c: str) -> Column:
        literal = F.try_element_at("cell", F.lit(c))
        kind = value_kind(literal)
        return (
            F.when(kind == "null", None).when(kind == "string", unquote(literal)).otherwise(literal).alias(c)
        )

    return cells.select(*[cell(c) for c in columns])


def pseudonymize_insert_dump(
    dump: DataFrame,
    rules: dict[str, ColumnRules],
    seed: str = fk.DEFAULT_SEED,
    preserve: PreserveRules | None = None,
    layouts: dict[str, list[str]] | None = None,
    keep: list[str] | None = None,
) -> DataFrame:
    """The statements (and the columns named in ``keep``) with the quoted literals of the rule columns replaced in their
    own quotes. NULL, numbers and function calls stay, and so does every other character:
    blanks, comments, what follows the tuples, statements that are no INSERT. One row per
    statement, nothing is shuffled.

    ``layouts`` gives the columns of tables whose INSERTs state none. An INSERT into a rule table
    that can't be taken apart, or whose columns are not known, raises an error.
    """
    types: dict[tuple[str, str], str] = {}
    for table, columns in rules.items():
        for column, rule in columns.items():
            rule = {"type": rule} if isinstance(rule, str) else rule
            if rule.get("action", "pseudonymize") == "pseudonymize":
                types[table, column] = rule["type"]
    if not types:
        return dump.select(*(keep or []), "statement")

    def type_of(table: Column, column: Column) -> Column:
        out = F.lit(None).cast("string")
        for (t, c), kind in types.items():
            out = F.when((table == t) & (column == c), kind).otherwise(out)
        return out

    concerned = F.col("table").isin(sorted({t for t, _ in types}))
    stated = F.filter("columns", lambda c: c != "")
    order = F.when(F.size(stated) > 0, stated)
    for table, columns in (layouts or {}).items():
        order = order.when(F.col("table") == table, F.array(*[F.lit(c) for c in columns]))
    usable = _complete() & order.isNotNull()
    order = _or_error(usable, order, "an INSERT into a table with rules can't be taken apart, or states no columns")
    kinds = F.when(concerned, F.transform(order, lambda c: type_of(F.col("table"), c)))

    def new_literal(literal: Column, kind: Column) -> Column:
        replaced = bind(unquote(literal), lambda content: new_content(literal, content, kind))
        return F.when(_is_quoted(literal), replaced).otherwise(literal)

    def new_content(literal: Column, content: Column, kind: Column) -> Column:
        quote = F.left(literal, F.lit(1))
        made = bind(
            fk.digest(kind, content, seed),
            lambda key: fk.generate_by(kind, sorted(set(types.values())), content, key),
        )
        escaped = F.replace(made, F.lit("\\"), F.lit("\\\\"))
        escaped = F.replace(escaped, quote, F.concat(F.lit("\\"), quote))
        replaced = F.concat(quote, escaped, quote)
        return replaced if preserve is None else F.when(should_preserve(content, preserve), literal).otherwise(replaced)

    def new_cell(cell: Column, kind: Column) -> Column:
        """A cell with the blanks around its literal; without a rule it stays as it is."""
        lead = F.length(cell) - F.length(F.ltrim(cell, F.lit(" \t\r\n")))

        def renewed(literal: Column) -> Column:
            tail = F.substring(cell, lead + F.length(literal) + 1, F.length(cell))
            return F.concat(F.left(cell, lead), new_literal(literal, kind), tail)

        return F.when(kind.isNull(), cell).otherwise(bind(F.trim(cell, F.lit(" \t\r\n")), renewed))

    def new_tuple(row: Column) -> Column:
        inner = F.substring(row, F.lit(2), F.length(row) - 2)
        cells = F.regexp_extract_all(inner, F.lit(_VALUE), F.lit(0))
        changed = F.zip_with(
            cells, F.col("kinds"), lambda cell, kind: F.when(cell.isNotNull(), new_cell(cell, kind))
        )
        return F.concat(F.lit("("), F.array_join(F.filter(changed, lambda c: c.isNotNull()), ","), F.lit(")"))

    with_kinds = dump.withColumn("kinds", kinds)
    affected = F.exists("kinds", lambda k: k.isNotNull())
    tokens = F.regexp_extract_all("values", F.lit(_TOKEN), F.lit(0))
    changed = F.transform(tokens, lambda t: F.when(F.startswith(t, F.lit("(")), new_tuple(t)).otherwise(t))
    rebuilt = F.concat(F.col("head"), F.array_join(changed, ""), F.col("rest"))
    return with_kinds.select(
        *(keep or []),
        F.when(F.coalesce(affected, F.lit(False)), rebuilt).otherwise(F.col("statement")).alias("statement")
    )


def sql_literal(value: Column) -> Column:
    """NULL, or the value as a string literal with backslash escapes, line breaks among them."""
    text = value.cast("string")
    escaped = F.regexp_replace(text, r"(['\"\\])", r"\\$1")
    for sign, written in (("\u0000", "\\0"), ("\n", "\\n"), ("\r", "\\r")):
        escaped = F.replace(escaped, F.lit(sign), F.lit(written))
    return F.when(text.isNull(), "NULL").otherwise(F.concat(F.lit("'"), escaped, F.lit("'")))


def insert_tuples(df: DataFrame) -> Column:
    cells = [sql_literal(F.col(quoted(c))) for c in df.columns]
    return F.concat(F.lit("("), F.concat_ws(", ", *cells), F.lit(")"))


def to_insert_statements(
    df: DataFrame, table: str, rows_per_insert: int = ROWS_PER_INSERT
) -> DataFrame:
    """The frame as multi-row INSERT statements (without their ``;``), at most
    ``rows_per_insert`` rows each, rows in the order of their partition.

    The literals are built by Spark expressions. Cutting a partition into runs of
    rows is the one thing that needs a look at the row stream, so finished tuples
    pass a small Python iterator; no shuffle, never more than one run in memory.
    """
    head = f"INSERT INTO {table} ({', '.join(df.columns)}) VALUES \n"

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting: list[str] = []
        for batch in batches:
            waiting.extend(batch["row"])
            full = len(waiting) // rows_per_insert * rows_per_insert
            runs = [waiting[i : i + rows_per_insert] for i in range(0, full, rows_per_insert)]
            waiting = waiting[full:]
            yield pd.DataFrame({"statement": [head + ",\n".join(run) for run in runs]}, dtype=object)
        if waiting:
            yield pd.DataFrame({"statement": [head + ",\n".join(waiting)]})

    return df.select(insert_tuples(df).alias("row")).mapInPandas(pack, "statement string")


def write_insert_dump(
    statements: DataFrame, path: str, statement_end: str = STATEMENT_END, mode: str = "errorifexists"
) -> None:
    statements.select("statement").write.mode(mode).text(path, lineSep=statement_end)


def export_table(df: DataFrame, table: str, path: str, mode: str = "errorifexists") -> None:
    """INSERT statements behind comment lines with the table name and row count. The comment is
    a row of its own in front, so it is there in any layout and for an empty table."""
    comment = F.concat(F.lit(f"-- Export: {table}\n-- Rows: "), F.count(F.lit(1)).cast("string"), F.lit("\n-- "))
    header = df.agg(comment.alias("statement"))
    write_insert_dump(header.unionByName(to_insert_statements(df, table)), path, mode=mode)
