"""Preserve check against rule lists too long for an expression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from incognita.operators.skew import hot_values, salted_left_join
from incognita.operators.tables import quoted


def _grams(text: Column, size: int) -> Column:
    """Distinct substrings of this length, at most one per character."""
    starts = F.sequence(F.lit(1), F.length(text) - (size - 1))
    grams = F.array_distinct(F.transform(starts, lambda at: F.substring(text, at, F.lit(size))))
    return F.when(F.length(text) >= size, grams).otherwise(F.array().cast("array<string>"))


GRAM = 8  # characters of the substrings by which long texts are sought


def contained_pairs(small: DataFrame, large: DataFrame) -> DataFrame:
    """(small, large) for every text of ``small`` that a text of ``large`` contains; texts are
    distinct and not empty.

    Containment is turned into equality of grams. A short text is one gram itself. A longer one is
    sought by that of its grams of GRAM characters that the fewest texts of ``large`` hold, and not
    at all if they lack one. Each text of ``large`` gives its grams of the lengths that are needed, at
    most eight per character; so a single short text does not make the grams of the others short.
    """
    size = F.length("small")
    lengths = [r[0] for r in small.select(F.least(size, F.lit(GRAM)).alias("n")).distinct().collect()]
    if not lengths:
        return small.limit(0).select("small", F.col("small").alias("large"))
    every = F.flatten(F.array(*[_grams(F.col("large"), n) for n in sorted(lengths)]))
    grams = large.select("large", F.explode(every).alias("gram"))
    out = grams.join(small.where(size <= GRAM).select("small", F.col("small").alias("gram")), "gram").select("small", "large")
    if GRAM in lengths:
        own = _grams(F.col("small"), GRAM)
        seen = grams.where(F.length("gram") == GRAM).groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
        tried = small.where(size > GRAM).select("small", F.size(own).alias("all"), F.explode(own).alias("gram")).join(seen, "gram")
        keys = tried.groupBy("small", "all").agg(F.min(F.struct("n", "gram")).alias("rarest"), F.count(F.lit(1)).alias("found"))
        keys = keys.where(F.col("found") == F.col("all")).select("small", F.col("rarest")["gram"].alias("gram"))
        long = grams.join(keys, "gram").where("contains(large, small)")
        out = out.unionByName(long.select("small", "large"))
    return out


def mark_preserved(
    df: DataFrame,
    column: str,
    rules: DataFrame,
    rule_column: str = "rule",
    case_sensitive: bool = False,
    mode: str = "compat",
) -> DataFrame:
    """Adds ``preserved``: does a rule equal the value, occur in it or (compat)
    contain it? Same meaning as ``PreserveRules.matches`` for any number of rules.

    Distinct values and rules are paired by rare common substrings (``contained_pairs``), either way
    round. Neither side is broadcast by hint; a value with very many rows is salted by its count.
    """

    def fold(c: Column) -> Column:
        return c if case_sensitive else F.lower(c)

    wanted = rules.select(fold(F.col(rule_column)).alias("rule")).where("rule <> ''").distinct()
    folded = df.withColumn("__value", fold(F.col(quoted(column)).cast("string")))
    values = folded.select("__value").where("__value <> ''").distinct()
    rule, value = wanted.select(F.col("rule").alias("small")), values.select(F.col("__value").alias("large"))
    kept = contained_pairs(rule, value).select(F.col("large").alias("__value"))
    if mode == "compat":
        inside = contained_pairs(value.withColumnRenamed("large", "small"), rule.withColumnRenamed("small", "large"))
        kept = kept.unionByName(inside.select(F.col("small").alias("__value")))
        kept = kept.unionByName(wanted.limit(1).select(F.lit("").alias("__value")))
    flags = kept.distinct().withColumn("__hit", F.lit(True))
    return (
        salted_left_join(folded, flags, "__value", hot_values(folded, "__value"))
        .withColumn("preserved", F.coalesce("__hit", F.lit(False)))
        .select(*[F.col(quoted(c)) for c in df.columns], "preserved")
    )
