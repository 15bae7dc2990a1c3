"""CSV with a sniffed delimiter."""

from __future__ import annotations

import csv
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from incognita.sources.records import CSV_LEXER, read_records

DELIMITERS = [",", ";", "\t", "|"]  # fixed order: decides ties
QUOTE, ESCAPE = '"', "\\"
# stand for a quote behind a backslash while a line is taken apart
_QUOTED, _SIGN = "\ue000", "\ue001"
TABLE_LABEL = "csv"


@dataclass(frozen=True)
class CsvLayout:
    delimiter: str
    columns: list[str]
    sample: list[str]
    header: str = ""


def detect_delimiter(header: str) -> str:
    """The candidate that occurs most often, at a tie the first."""
    return max(DELIMITERS, key=header.count)


def sniff_csv(spark: SparkSession, path: str) -> CsvLayout:
    """Delimiter, columns and up to three sample lines, from the first four lines."""
    lines = [row["value"] for row in spark.read.text(path).head(4)]
    header = lines[0] if lines else ""
    delimiter = detect_delimiter(header)
    columns = next(csv.reader([header], delimiter=delimiter, quotechar=QUOTE, doublequote=True), [])
    return CsvLayout(delimiter, columns, lines[1:], header)


def _apart(text: Column) -> Column:
    """The text with \\" behind a stand-in; the stand-in's own characters are spelt out first, so
    that ``_together`` gives back any text."""
    text = F.replace(text, F.lit(_SIGN), F.lit(_SIGN + "a"))
    text = F.replace(text, F.lit(_QUOTED), F.lit(_SIGN + "b"))
    return F.replace(text, F.lit(ESCAPE + QUOTE), F.lit(_QUOTED))


def _together(text: Column) -> Column:
    text = F.replace(text, F.lit(_QUOTED), F.lit(ESCAPE + QUOTE))
    text = F.replace(text, F.lit(_SIGN + "b"), F.lit(_QUOTED))
    return F.replace(text, F.lit(_SIGN + "a"), F.lit(_SIGN))


def _lines_below_header(spark: SparkSession, path: str) -> DataFrame:
    """The lines of all files but the first one of each, which is its header; blank ones left out."""
    # read as one column: delimiter and quote are no characters of a text; a line that holds the
    # delimiter all the same has too many cells and comes back whole as a corrupt record
    options = {"sep": "\ufffe", "quote": "\ufdd0", "escape": "\ufdd0", "header": True, "maxCharsPerColumn": -1, "emptyValue": "", "nullValue": "\ufdd0"}
    blanks = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False, "columnNameOfCorruptRecord": "raw"}
    lines = spark.read.schema("value string, raw string").options(**options, **blanks).csv(path)
    return lines.select(F.coalesce("raw", "value").alias("value")).where(F.trim("value") != "")


def read_csv_sniffed(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """All columns as strings, bound by header; an empty cell is an empty string, not
    NULL. A doubled quote in a quoted cell is one quote; a quote behind a backslash does not
    end the cell, and both characters stay.

    Files stay splittable. The first line of each file is its header, however often a line like it
    comes again. Lines are taken apart one by one; ``multi_line`` is for line breaks in quotes: records
    are then put together across lines and splits first (``read_records``).
    """
    layout = sniff_csv(spark, path)
    names = list(layout.columns)
    if not names:
        return spark.read.text(path).limit(0).select()
    if multi_line:
        lines = read_records(spark, path, CSV_LEXER).where(~F.col("first"))
        lines = lines.select(F.rtrim("record", F.lit("\r")).alias("value")).where(F.trim("value") != "")
    else:
        lines = _lines_below_header(spark, path)
    plain = ", ".join(f"c{i} string" for i in range(len(names)))
    options = {"sep": layout.delimiter, "quote": QUOTE, "escape": QUOTE, "mode": "PERMISSIVE", "maxCharsPerColumn": "-1"}
    if multi_line:
        options["lineSep"] = "\ufffe"  # line breaks are characters of a cell like others
    # few lines hold a backslash; only those need the stand-ins. One lambda serves all columns, so the
    # expressions stay small however wide the file is
    slash = F.contains("value", F.lit(ESCAPE))
    text = F.when(slash, _apart(F.col("value"))).otherwise(F.col("value"))
    split = lines.select(slash.alias("slash"), F.from_csv(text, plain, options).alias("cell"))
    cells = F.array(*[F.coalesce(F.col(f"cell.c{i}"), F.lit("")) for i in range(len(names))])
    whole = split.select(F.when(F.col("slash"), F.transform(cells, _together)).otherwise(cells).alias("cells"))
    return whole.select(*[F.col("cells")[i].alias(name) for i, name in enumerate(names)])


def csv_cell(value: Column, delimiter: str) -> Column:
    """A cell as it is written: in quotes where it holds the delimiter, a quote, a line break or
    blanks at its ends. A quoted cell can't end with a backslash, as that would take the closing
    quote; such a value raises an error rather than being written as something else."""

    text = F.coalesce(value.cast("string"), F.lit(""))
    doubled = F.replace(text, F.lit(QUOTE), F.lit(QUOTE + QUOTE))
    slashed = _together(F.replace(_apart(text), F.lit(QUOTE), F.lit(QUOTE + QUOTE)))
    inner = F.when(F.contains(text, F.lit(ESCAPE)), slashed).otherwise(doubled)
    error = F.raise_error(F.concat(F.lit("a quoted CSV cell can't end with a backslash: "), text)).cast("string")
    whole = F.when(F.endswith(text, F.lit(ESCAPE)), error).otherwise(F.concat(F.lit(QUOTE), inner, F.lit(QUOTE)))
    return F.when(text.rlike(f'[{re.escape(delimiter)}"\\n\\r]|^ | $'), whole).otherwise(text)


def _name_cell(name: str, delimiter: str) -> str:
    """A column's name as ``csv_cell`` writes it."""
    if not re.search(f'[{re.escape(delimiter)}"\\n\\r]|^ | $', name):
        return name
    if name.endswith(ESCAPE):
        raise ValueError(f"a quoted CSV cell can't end with a backslash: {name}")
    return QUOTE + re.sub(r'(\\?)"', lambda m: m[0] if m[1] else '""', name) + QUOTE


def write_csv(df: DataFrame, path: str, delimiter: str = ",", mode: str = "errorifexists") -> None:
    """Lines as ``read_csv_sniffed`` takes them, with the header in front of every file; an
    empty frame gives a file with the header alone."""
    named = F.lit(delimiter.join(_name_cell(c, delimiter) for c in df.columns))
    cells = F.array(*[F.coalesce(F.col("`" + c.replace("`", "``") + "`").cast("string"), F.lit("")) for c in df.columns])
    line = F.array_join(F.transform(cells, lambda c: csv_cell(c, delimiter)), delimiter)
    # the id counts the rows of a partition in its lower bits
    first = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0
    lines = df.select(F.explode(F.when(first, F.array(named, line)).otherwise(F.array(line))).alias("value"))
    header = df.sparkSession.range(1).select(named.alias("value"))
    header.unionByName(lines).write.mode(mode).text(path)


def pseudonymize_csv(
    spark: SparkSession, source: str, target: str, rules: dict | None = None, **options
) -> CsvLayout:
    """Read, replace by column rules (default: the detected ones), write with the
    same delimiter."""
    from incognita.operators.catalog import suggest_rules
    from incognita.operators.tables import pseudonymize_table

    layout = sniff_csv(spark, source)
    df = read_csv_sniffed(spark, source)
    chosen = suggest_rules(TABLE_LABEL, df) if rules is None else rules
    write_csv(pseudonymize_table(df, chosen, **options), target, layout.delimiter)
    return layout
