"""Fakes made in Arrow batches against the expressions that state them."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from incognita import functions as fn
from incognita.functions import fakes_in_batches as fb
from incognita.rules import PATTERN_SETS


def originals(kind):
    rnd = random.Random(5)
    if kind != "birthdate":
        return [rnd.choice(["", "é", "a|b"]) + str(rnd.random()) for _ in range(2000)]
    years = (0, 1, 2, 4, 1582, 1900, 1999, 2000, 2024, 9998, 9999)
    days = [f"{y:04}-{m:02}-{d:02}" for y in years for m in range(14) for d in (0, 1, 28, 29, 30, 31, 32, 99)]
    return days + [f"{d[8:]}.{d[5:7]}.{d[:4]}" for d in days]


@pytest.mark.parametrize("seed", ["incognita", "ß|x"])
def test_same_fakes_as_the_expressions(spark, seed):
    for kind in fb._MAKERS:
        values = originals(kind)
        df = spark.createDataFrame([(v,) for v in values], "v string")
        want = [r[0] for r in df.select(fn.fake(kind, F.col("v"), seed)).collect()]
        cells = [v.encode() for v in values]
        assert fb.fakes_of(cells, [kind], np.zeros(len(cells), np.int64), seed).to_pylist() == want, kind


def test_types_in_turn_and_none(spark):
    kinds = ["ip", "email", "ip"]
    which = np.array([2, 1, 0, 1, 2])
    values = [str(i).encode() for i in which]
    got = fb.fakes_of(values, kinds, which, "s").to_pylist()
    one = [fb.fakes_of([v], [kinds[w]], np.zeros(1, np.int64), "s").to_pylist()[0] for v, w in zip(values, which)]
    assert got == one and got[0] == got[4] and got[1] == got[3]
    assert fb.fakes_of([], kinds, np.zeros(0, np.int64), "s").to_pylist() == []


@pytest.mark.parametrize("patterns", sorted(PATTERN_SETS))
def test_fakes_of_matches_are_not_interpreted(spark, patterns):
    """They come from the search itself, not from an expression for each match."""
    df = spark.createDataFrame([("a@b.de 1.2.3.4 2024-01-15",), ("",), (None,)], "text string")
    out = df.select(fn.planned_replacements(F.col("text"), patterns).alias("r"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "md5" not in plan
    first, *rest = (r["r"] for r in out.collect())
    assert all(r["fake"] for r in first) and rest == [[], []]
    keep = fn.PreserveRules(("a@b.de",), mode="strict")
    kept = df.select(F.inline(fn.planned_replacements(F.col("text"), patterns, preserve=keep))).collect()
    assert [r["fake"] for r in kept] == [None, *(r["fake"] for r in first[1:])]


def test_another_generator_for_a_stated_type_is_used(spark):
    stated = fn.GENERATORS["email"]
    fn.register_type("email", lambda value, key: F.lit("hidden"))
    try:
        df = spark.createDataFrame([("a@b.de 1.2.3.4",)], "text string")
        made = df.select(F.inline(fn.planned_replacements(F.col("text")))).collect()
        assert made[0]["fake"] == "hidden" and made[1]["fake"].count(".") == 3
    finally:
        fn.register_type("email", stated)
