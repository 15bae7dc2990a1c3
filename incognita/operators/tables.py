"""Replacing the personal columns of tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from incognita.functions import fakes as fk
from incognita.functions.preserve import PreserveRules, should_preserve

# column -> {"action": "pseudonymize" | "keep", "type": ...}; a bare type name
# is short for pseudonymize.
ColumnRules = dict[str, dict | str]

_KEY = "__key_"
RULES_AT_MOST = 100_000


def rules_from_frame(rules: DataFrame) -> dict[str, ColumnRules]:
    """Confirmed rules (table, column, type, action) as {table: {column: rule}}.
    A rule frame is a reviewed list of columns; one of more than RULES_AT_MOST rows is an error."""
    out: dict[str, ColumnRules] = {}
    rows = rules.select("table", "column", "type", "action").head(RULES_AT_MOST + 1)
    if len(rows) > RULES_AT_MOST:
        raise ValueError(f"more than {RULES_AT_MOST} rules: this is no reviewed list of columns")
    for r in rows:
        out.setdefault(r["table"], {})[r["column"]] = {"action": r["action"], "type": r["type"]}
    return out


def targets(df: DataFrame, rules: ColumnRules) -> dict[str, str]:
    """Columns of the frame to be replaced, with their types."""
    out = {}
    for column, rule in rules.items():
        rule = {"type": rule} if isinstance(rule, str) else rule
        if rule.get("action", "pseudonymize") == "pseudonymize" and column in df.columns:
            out[column] = rule["type"]
    return out


def quoted(column: str) -> str:
    return "`" + column.replace("`", "``") + "`"


def replaceable(value: Column, preserve: PreserveRules | None, keep_empty: bool) -> Column:
    """Whether a cell is replaced at all: not NULL, not preserved and, on request,
    not empty (where "0" counts as empty, too)."""
    yes = value.isNotNull() & ~should_preserve(value, preserve)
    return yes & ~value.isin("", "0") if keep_empty else yes


def pseudonymize_table(
    df: DataFrame,
    rules: ColumnRules,
    seed: str = fk.DEFAULT_SEED,
    preserve: PreserveRules | None = None,
    keep_empty: bool = False,
) -> DataFrame:
    """The frame with every target column replaced; others, NULLs and preserved
    values stay. A column keeps its type where all fakes fit it, else it
    becomes a string. Works on batch and streaming frames alike.

    Two projections: the first computes one digest per cell to be replaced (NULL
    means "leave it"), the second cuts the fake from it, so that a digest used in
    several places of a fake is computed once.
    """
    chosen = targets(df, rules)
    if not chosen:
        return df
    text = {c: F.col(quoted(c)).cast("string") for c in chosen}
    keys = {
        _KEY + c: F.when(replaceable(text[c], preserve, keep_empty), fk.digest(t, text[c], seed))
        for c, t in chosen.items()
    }
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}

    def replaced(c: str) -> Column:
        key = F.col(quoted(_KEY + c))
        new = F.when(key.isNull(), text[c]).otherwise(fk.generate(chosen[c], text[c], key))
        if types[c] in fk.NATIVE_TYPES.get(chosen[c], set()):
            new = new.try_cast(types[c])
        return new.alias(c)

    return df.withColumns(keys).select(
        *[replaced(c) if c in chosen else F.col(quoted(c)) for c in df.columns]
    )


def pseudonymize_tables(
    tables: dict[str, DataFrame], rules: dict[str, ColumnRules], **options
) -> dict[str, DataFrame]:
    """Several tables with one seed: equal values of one type get equal fakes in
    every table, without a shared mapping."""
    return {t: pseudonymize_table(df, rules.get(t, {}), **options) for t, df in tables.items()}


def _updated(df: DataFrame, chosen: dict[str, str], preserve, keep_empty: bool) -> Column:
    cells = [replaceable(F.col(quoted(c)).cast("string"), preserve, keep_empty) for c in chosen]
    return reduce(Column.__or__, cells)


def table_summary(
    table: str,
    df: DataFrame,
    rules: ColumnRules,
    preserve: PreserveRules | None = None,
    keep_empty: bool = False,
) -> DataFrame:
    """Rows processed and rows with at least one replaced cell; a table without
    targets is not processed. ``errors`` is there for symmetry: a failing
    expression fails the job."""
    chosen = targets(df, rules)
    if chosen:
        counts = df.agg(
            F.count(F.lit(1)).alias("processed"),
            F.count_if(_updated(df, chosen, preserve, keep_empty)).alias("updated"),
        )
    else:
        zero = F.lit(0).cast("bigint")
        counts = df.sparkSession.range(1).select(zero.alias("processed"), zero.alias("updated"))
    return counts.select(
        F.lit(table).alias("table"), "processed", "updated", F.lit(0).cast("bigint").alias("errors")
    )


def run_summary(
    tables: dict[str, DataFrame], rules: dict[str, ColumnRules], total: str = "(all)", **options
) -> DataFrame:
    """One row per table plus one with the totals (a rollup of the small rows)."""
    per_table = reduce(
        DataFrame.unionByName,
        [table_summary(t, df, rules.get(t, {}), **options) for t, df in tables.items()],
    )
    return per_table.rollup("table").agg(
        *[F.sum(c).alias(c) for c in ("processed", "updated", "errors")]
    ).withColumn("table", F.coalesce("table", F.lit(total)))


def with_progress(
    df: DataFrame,
    table: str,
    rules: ColumnRules,
    preserve: PreserveRules | None = None,
    keep_empty: bool = False,
) -> tuple[DataFrame, Observation | None]:
    """The input frame with counters of rows ``processed`` and ``updated``, without a second scan.
    After a batch run ``observation.get`` holds them; for a stream, where there is no such object,
    ``StreamProgress`` adds them up."""
    chosen = targets(df, rules)
    updated = _updated(df, chosen, preserve, keep_empty) if chosen else F.lit(False)
    watch = None if df.isStreaming else Observation(table)
    counts = F.count(F.lit(1)).alias("processed"), F.count_if(updated).alias("updated")
    return df.observe(watch or table, *counts), watch


class StreamProgress:
    """Counters of streams whose inputs went through ``with_progress``, added up over micro-batches
    while they run. Poll ``update`` (or let ``follow`` do it); no listener, so nothing calls back.

    Spark keeps the last ``spark.sql.streaming.numRecentProgressUpdates`` batches (100). A batch that
    fell out between two polls is an error, not a number too small.
    """

    def __init__(self) -> None:
        self.tables: dict[str, dict[str, int]] = {}
        self._seen: dict[str, int] = {}  # last batch of each run

    def update(self, query: StreamingQuery) -> dict[str, dict[str, int]]:
        run = str(query.runId)
        for p in query.recentProgress:
            last = self._seen.get(run)
            if not p.observedMetrics or (last is not None and p.batchId <= last):
                continue
            if last is not None and p.batchId > last + 1:
                raise RuntimeError(f"the progress of batches {last + 1} to {p.batchId - 1} is no longer kept")
            self._seen[run] = p.batchId
            for table, row in p.observedMetrics.items():
                counts = self.tables.setdefault(table, {})
                for name, n in row.asDict().items():
                    counts[name] = counts.get(name, 0) + n
        return self.tables

    def follow(self, query: StreamingQuery, callback: Callable[[dict], None] | None = None, seconds: float = 1.0) -> dict[str, dict[str, int]]:
        """Until the query ends; ``callback`` gets the counters after each poll."""
        ended = False
        while not ended:
            ended = bool(query.awaitTermination(seconds))
            self.update(query)
            if callback:
                callback(self.tables)
        return self.tables
