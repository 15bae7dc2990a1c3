"""Mapping frames original -> fake: audit, reuse, statistics, uniqueness.

Nothing here is kept by the library: a mapping holds originals, so it exists only
as the lazy frame the caller asked for.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import partial, reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from incognita.functions import fakes as fk
from incognita.functions.arrays import bind
from incognita.functions.preserve import PreserveRules
from incognita.operators.skew import hot_values, salted_left_join
from incognita.operators.tables import ColumnRules, quoted, replaceable, targets


def originals(
    tables: dict[str, DataFrame],
    rules: dict[str, ColumnRules],
    preserve: PreserveRules | None = None,
    keep_empty: bool = False,
) -> DataFrame:
    """(type, original) of every cell that a run would replace: one scan per table,
    however many columns."""
    parts = []
    for table, df in tables.items():
        chosen = targets(df, rules.get(table, {}))
        if not chosen:
            continue
        cells = F.array(
            *[
                F.struct(F.lit(t).alias("type"), F.col(quoted(c)).cast("string").alias("original"))
                for c, t in chosen.items()
            ]
        )
        parts.append(df.select(F.inline(cells)))
    if not parts:
        raise ValueError("no column to replace")
    every = reduce(DataFrame.unionByName, parts)
    return every.where(replaceable(F.col("original"), preserve, keep_empty))


def _types(rules: dict[str, ColumnRules]) -> list[str]:
    named = [r if isinstance(r, str) else r["type"] for t in rules.values() for r in t.values()]
    return list(dict.fromkeys(named))


def with_fake(pairs: DataFrame, types: list[str], seed: str = fk.DEFAULT_SEED) -> DataFrame:
    """Adds ``fake`` to (type, original); ``types`` lists the types that occur."""
    keyed = pairs.withColumn("__key", fk.digest(F.col("type"), F.col("original"), seed))
    made = fk.generate_by(F.col("type"), types, F.col("original"), F.col("__key"))
    return keyed.withColumn("fake", made).drop("__key")


def build_mapping(
    tables: dict[str, DataFrame],
    rules: dict[str, ColumnRules],
    seed: str = fk.DEFAULT_SEED,
    preserve: PreserveRules | None = None,
    unique: bool = False,
    earlier: DataFrame | None = None,
) -> DataFrame:
    """(type, original, fake), one row per distinct pair. Duplicates are merged
    map-side before the one shuffle, so a value that fills a third of the rows
    costs one row per task. ``unique`` gives distinct originals distinct fakes.

    ``earlier`` is a mapping this function made before with the same seed and ``unique``: its rows
    come back as they are, and only originals it lacks are added, so that no fake comes twice.
    """
    pairs = originals(tables, rules, preserve).distinct()
    if earlier is not None:
        pairs = pairs.join(earlier.select("type", "original"), ["type", "original"], "left_anti")
    mapping = with_fake(pairs, _types(rules), seed)
    if unique:
        mapping = make_unique(mapping, seed, earlier=earlier)
    return mapping if earlier is None else earlier.select("type", "original", "fake").unionByName(mapping)


def make_unique(
    mapping: DataFrame, seed: str = fk.DEFAULT_SEED, buckets: int = 4096, earlier: DataFrame | None = None
) -> DataFrame:
    """Makes the fakes of a type distinct, by a number per type that no two originals share.

    A global rank would sort a whole type in one task. Instead originals are dealt into hash
    buckets and ranked within; a prefix sum over the buckets' counts makes the numbers run from 0
    without a gap, the same in every run on the same set of originals. Behind an ``earlier`` unique
    mapping they go on where its numbers end.
    """
    bucket = fk.pick(fk.digest(F.lit("bucket"), F.col("original"), seed), 0, buckets)
    dealt = mapping.withColumn("__bucket", bucket)
    counts = dealt.groupBy("type", "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("type").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    if earlier is not None:
        marks = earlier.groupBy("type").agg(F.count(F.lit(1)).alias("__mark"))
        offsets = offsets.join(marks, "type", "left")
        offsets = offsets.withColumn("__before", F.col("__before") + F.coalesce("__mark", F.lit(0))).drop("__mark")
    within = Window.partitionBy("type", "__bucket").orderBy("original")
    ranked = dealt.withColumn("__rank", F.row_number().over(within) - 1)
    # at most ``buckets`` rows for each of the few types: small enough to broadcast
    numbered = ranked.join(F.broadcast(offsets), ["type", "__bucket"])
    number = F.col("__before") + F.col("__rank")
    return numbered.select(
        *[F.col(quoted(c)) for c in mapping.columns if c != "fake"],
        _distinct(F.col("type"), F.col("fake"), F.col("original"), number, seed).alias("fake"),
    ).select(*mapping.columns)


# how many different fakes a type with a format of its own has
RANGES = {
    "age": 63,
    "house_number": 199,
    "postcode": 99_999,
    "ssn": 900_000_000,
    "tax_id": 90_000_000_000,
    "birthdate": 73_049,  # days of 1900 to 2099
    "iban": 10**18,
    "uuid": 1 << 48,
}


def sides(n: int) -> tuple[int, int]:
    """Two factors of like size whose product is ``n`` or little more."""
    root = math.isqrt(n - 1) + 1
    tried = range(root, max(2, root // 4, root - 200) - 1, -1)
    return min(((a, -(-n // a)) for a in tried), key=lambda p: p[0] * p[1])


def permuted(number: Column, kind: str, seed: str, rounds: int = 4) -> Column:
    """A keyed permutation of 0 ... RANGES[kind] - 1: a Feistel network over two factors. Where their
    product exceeds the range, a number that falls outside is sent on until it is inside."""
    n = RANGES[kind]
    a, b = sides(n)

    def once(x: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            key = fk.digest(f"permuted {kind}", F.concat_ws(":", i.cast("string"), acc["y"].cast("string")), seed)
            side = F.when(i % 2 == 0, F.lit(a)).otherwise(F.lit(b)).cast("long")
            drawn = F.conv(F.substring(key, 1, 8), 16, 10).cast("long")
            return F.struct(acc["y"].alias("x"), F.pmod(acc["x"] + drawn, side).alias("y"))

        whole = F.lit(b).cast("long")
        start = F.struct(F.call_function("div", x, whole).alias("x"), F.pmod(x, whole).alias("y"))
        return F.aggregate(F.sequence(F.lit(0), F.lit(rounds - 1)), start, step, lambda acc: acc["x"] * b + acc["y"])

    if a * b == n:
        return once(number)
    again = F.sequence(F.lit(1), F.lit(a * b - n))
    return F.aggregate(again, once(number), lambda acc, _: F.when(acc < n, acc).otherwise(once(acc)))


def _distinct(kind: Column, fake: Column, original: Column, number: Column, seed: str) -> Column:
    """The fake made distinct by the number. Types with a format of their own get a value of their
    range, the same number the same one: an age of 18 to 80, a day of 1900 to 2099, an IBAN with valid
    check digits; more originals than the range has values are an error. Other fakes get the number
    appended."""

    def within(name: str, form: Callable[[Column], Column]) -> Column:
        error = F.raise_error(F.lit(f"more originals of type {name} than it has different fakes: {RANGES[name]}"))
        return F.when(number >= RANGES[name], error.cast("string")).otherwise(bind(permuted(number, name, seed), form))

    def birthdate(x: Column) -> Column:
        day = F.date_add(F.lit("1900-01-01").cast("date"), x.cast("int"))
        german = original.rlike(r"^\d{2}\.\d{2}\.\d{4}$")
        return F.when(german, F.date_format(day, "dd.MM.yyyy")).otherwise(day.cast("string"))

    def iban(x: Column) -> Column:
        left, right = F.call_function("div", x, F.lit(10**9).cast("long")), F.pmod(x, F.lit(10**9).cast("long"))
        rest = F.pmod(left * (10**15 % 97) + right * (10**6 % 97) + 131400 % 97, F.lit(97))
        check = F.lpad((F.lit(98) - rest).cast("string"), 2, "0")
        return F.concat(F.lit("DE"), check, F.lpad(left.cast("string"), 9, "0"), F.lpad(right.cast("string"), 9, "0"))

    forms: dict[str, Callable[[Column], Column]] = {
        "age": lambda x: (x + 18).cast("string"),
        "house_number": lambda x: (x + 1).cast("string"),
        "postcode": lambda x: F.lpad((x + 1).cast("string"), 5, "0"),
        "ssn": lambda x: (x + 100_000_000).cast("string"),
        "tax_id": lambda x: (x + 10_000_000_000).cast("string"),
        "birthdate": birthdate,
        "iban": iban,
        "uuid": lambda x: F.concat(F.substring(fake, 1, 24), F.lpad(F.lower(F.hex(x)), 12, "0")),
    }
    out = None
    for name, form in forms.items():
        out = F.when(kind == name, within(name, form)) if out is None else out.when(kind == name, within(name, form))
    return out.otherwise(_numbered(fake, number.cast("string")))


def _numbered(fake: Column, number: Column) -> Column:
    """Number before the @ of an address, else at the end."""
    at = F.instr(fake, "@")
    split_at = F.when(at > 0, at).otherwise(F.length(fake) + 1)
    return F.concat(
        F.substring(fake, F.lit(1), split_at - 1),
        F.lit("-"),
        number,
        F.substring(fake, split_at, F.length(fake)),
    )


def apply_mapping(
    df: DataFrame,
    mapping: DataFrame,
    rules: ColumnRules,
    seed: str = fk.DEFAULT_SEED,
    preserve: PreserveRules | None = None,
    keep_empty: bool = False,
) -> DataFrame:
    """Replaces with the fakes of an earlier mapping; values it lacks get the fake
    of the seed. Of several mapping rows for one (type, original) the least fake
    counts, so rows never multiply. A column keeps its type where its fakes fit;
    a fake of the mapping that does not fit raises an error instead of becoming NULL.

    However many columns: rows that want the same cells share one digest of them, each different
    set of cells is looked up once, in one join of all its cells with the mapping, and the answers
    come back in one join by digest. The mapping may be as large as the data, so nothing is
    broadcast by hint; one sketch over digests and cells tells what is salted, and how far.
    """
    chosen = targets(df, rules)
    if not chosen:
        return df
    wanted = [F.when(replaceable(F.col(quoted(c)).cast("string"), preserve, keep_empty), F.col(quoted(c)).cast("string")) for c in chosen]
    asks = reduce(lambda a, b: a | b, [w.isNotNull() for w in wanted])
    spelt = F.concat(*[F.concat(F.coalesce(F.length(w), F.lit(-1)).cast("string"), F.lit(":"), F.coalesce(w, F.lit(""))) for w in wanted])
    keyed = df.withColumn("__key", F.when(asks, F.md5(spelt)))
    cell = [F.concat(F.lit(kind + "|"), w) for kind, w in zip(chosen.values(), wanted, strict=True)]
    listed = F.array(*[F.struct(F.lit(i).alias("at"), c.alias("__cell")) for i, c in enumerate(cell)])

    once = keyed.where("__key IS NOT NULL").select("__key", listed.alias("cells")).dropDuplicates(["__key"])
    asked = once.select("__key", F.inline("cells")).where("__cell IS NOT NULL")
    known = mapping.where(F.col("type").isin(sorted(set(chosen.values())))).groupBy(F.concat("type", F.lit("|"), "original").alias("__cell")).agg(F.min("fake").alias("known"))
    # a digest names rows, a cell sets of cells; cells of many sets are cells of many rows
    hot = hot_values(keyed.select(F.explode(F.concat(F.array("__key"), F.array(*cell))).alias("__item")), "__item")
    answers = salted_left_join(asked, known, "__cell", hot).where("known IS NOT NULL")
    answers = answers.groupBy("__key").agg(F.map_from_entries(F.collect_list(F.struct("at", "known"))).alias("__answers"))
    joined = salted_left_join(keyed, answers, "__key", hot)

    out = {}
    for i, (c, kind) in enumerate(chosen.items()):
        text = F.col(quoted(c)).cast("string")
        made = bind(fk.digest(kind, text, seed), partial(fk.generate, kind, text))
        new = F.when(wanted[i].isNull(), text).otherwise(F.coalesce(F.try_element_at("__answers", F.lit(i)), made))
        dtype = df.schema[c].dataType.simpleString()
        if dtype in fk.NATIVE_TYPES.get(kind, set()):
            fitting = new.try_cast(dtype)
            misfit = F.concat(F.lit(f"column {c}: a mapped value is no {dtype}: "), new)
            new = F.when(new.isNotNull() & fitting.isNull(), F.raise_error(misfit).cast(dtype)).otherwise(fitting)
        out[c] = new
    return joined.select(*[out[c].alias(c) if c in out else F.col(quoted(c)) for c in df.columns])


def mapping_stats(pairs: DataFrame) -> DataFrame:
    """One row: lookups in total, misses (distinct pairs, which need a new fake),
    hits (repeats), hit rate in percent and mapping size. Counts per pair first,
    so repeats are merged map-side and no row-wise distinct is shuffled."""
    per_pair = pairs.groupBy("type", "original").agg(F.count(F.lit(1)).alias("n"))
    totals = per_pair.agg(
        F.coalesce(F.sum("n"), F.lit(0).cast("bigint")).alias("total"),
        F.count(F.lit(1)).alias("misses"),
    )
    hits = F.col("total") - F.col("misses")
    rate = F.when(F.col("total") > 0, F.round(hits / F.col("total") * 100, 2)).otherwise(0.0)
    return totals.select(
        hits.alias("hits"), "misses", "total", rate.alias("hit_rate"), F.col("misses").alias("mapping_size")
    )
