"""Near duplicates by MinHash: an inverted join over signature coordinates.

Every distinct set of shingles has a signature of K coordinates. Posted under each pair of
coordinate and value, it collides with a set of Jaccard similarity J on about J * K of them, so
pairs are sought that collide on at least T. Two such sets share one of the K - T + 1 pairs that
are rarest in the corpus (ties by the pair's hash), whichever T they share: each set posts only
this prefix, and skips the long lists of common text behind it. The collisions of a pair are not
counted: all that share a pair of their prefixes are candidates, with T collisions or fewer, and
the full sets decide.

Links are transitive, so no list is expanded into all its pairs. First every set is held against
one partner, the member of most of its lists whose own pairs are the commonest (in a group of
edited copies, the one closest to all); what this links is joined to components. Then all that
share a partner are compared across components, and last those in a list that do not share one,
so that a pair is not met again in each of its lists. Both go block by block inside tasks, where
the largest component (or those with the commonest partner) need not be compared within. Tasks
confirm on full sets and return only links that join components.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from incognita.llm.common import LOWER, mix, pieces, powers, prefix_hash, small_batches, span_hash, table, word_spans, written
from incognita.llm.components import connected_components

COORDINATES = 32  # K
MISSED = 4e-6  # chance, at most, that a pair just at the threshold collides on fewer than T
BLOCK = 256
SEED = 20_240_607


def _constants() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(SEED))
    return rng.integers(0, 2**63, COORDINATES, np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(
        0, 2**63, COORDINATES, np.uint64
    )


def collisions(percent: int) -> int:
    """T: the most coordinates that pairs at ``percent`` share but for a chance of MISSED; closer
    pairs miss it less often. 17 at 85 % (3.5 in a million)."""
    j, chance = percent / 100, 0.0
    for t in range(COORDINATES):
        chance += comb(COORDINATES, t) * j**t * (1 - j) ** (COORDINATES - t)
        if chance > MISSED:
            return max(t, 1)
    return COORDINATES


def shingle_sets(data: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of the distinct shingles of every row, sorted by row, then hash.

    A row with fewer than ``width`` words has its whole sequence as its only shingle, one
    without words has none.
    """
    start, end, row = word_spans(data, at)
    words = span_hash(prefix_hash(LOWER[data]), start, end)
    n_words = np.bincount(row, minlength=len(at) - 1)
    n = len(words)
    if not n:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    factor, _ = powers(width + 1)
    acc = np.zeros(n, np.uint64)
    whole = np.zeros(n, bool)
    first = np.searchsorted(row, row, "left")
    place = np.arange(n) - first
    left = n_words[row] - place  # words from here to the end of the row
    for i in range(width):
        shifted = np.zeros(n, np.uint64)
        shifted[: n - i] = words[i:]
        acc += np.where(left > i, shifted * factor[i + 1], np.uint64(0))
    whole = (left >= width) | (place == 0)
    value = mix(acc + np.minimum(left, width).astype(np.uint64))[whole]
    owner = row[whole]
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    return value[new], owner[new]


def _signatures(width: int):
    mul, add = _constants()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, at in pieces(batch.column("text")):
                value, owner = shingle_sets(data, at, width)
                size = np.bincount(owner, minlength=b - a)
                full = np.flatnonzero(size)
                starts = np.concatenate([[0], np.cumsum(size)])[full]
                d1, d2 = np.zeros(b - a, np.uint64), np.zeros(b - a, np.uint64)
                keys = np.zeros((b - a, COORDINATES), np.uint64)
                if len(full):
                    d1[full] = np.add.reduceat(mix(value + np.uint64(1)), starts)
                    d2[full] = np.add.reduceat(mix(value ^ np.uint64(0x5555555555555555)), starts)
                    for k in range(COORDINATES):
                        least = np.minimum.reduceat((value * mul[k] + add[k]) >> np.uint64(16), starts)
                        keys[full, k] = mix(least * np.uint64(64) + np.uint64(k))
                lists = pa.ListArray.from_arrays(
                    pa.array(np.arange(b - a + 1, dtype=np.int32) * COORDINATES), pa.array(keys.reshape(-1).view(np.int64))
                )
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, b - a), pa.array(size.astype(np.int64)), pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64)), lists],
                    ["doc_id", "n_shingles", "d1", "d2", "keys"],
                )

    return run


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, at in pieces(batch.column("text")):
                value, owner = shingle_sets(data, at, width)
                ends = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=b - a))])
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(value.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), lists], ["node", "shingles"])

    return run


def held_against(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b, linked): whether 100 * intersection >= percent * union of the full sets."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    linked = 100 * both >= percent * (F.size("sa") + F.size("sb") - both)
    # written before the sums, so that Spark can split the pairs of one partner
    held = written(pairs.join(left, "a").join(right, "b").select("a", "b", linked.alias("linked")), "held")
    # an id that is repeated with other texts has several sets
    return held.groupBy("a", "b").agg(F.max("linked").alias("linked"))


def common_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Size of the intersection of every left set with every right one, by matrix products."""
    every = np.concatenate([*left, *right])
    _, place, often = np.unique(every, return_inverse=True, return_counts=True)
    shared = often[place] > 1
    number = np.cumsum(often > 1) - 1
    owner = np.repeat(np.arange(len(left) + len(right)), [len(x) for x in (*left, *right)])[shared]
    place = number[place[shared]]
    out = np.zeros((len(left), len(right)), np.float32)
    for a in range(0, int(number[-1]) + 1 if len(number) else 0, 1 << 13):
        now = (place >= a) & (place < a + (1 << 13))
        grid = np.zeros((len(left) + len(right), 1 << 13), np.float32)
        grid[owner[now], place[now] - a] = 1
        out += grid[: len(left)] @ grid[len(left) :].T
    return out.astype(np.int64)


def _across(percent: int):
    """Links between different components, of two blocks of list members; enough to join these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while root.setdefault(x, x) != x:
                root[x] = x = root[root[x]]
            return x

        for batch in batches:
            lists = batch.column("members")
            ends = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            members = lists.flatten()
            side, rep, component, part = (
                members.field(c).to_numpy() for c in ("side", "rep", "component", "part")
            )
            sets = members.field("shingles")
            at = sets.offsets.to_numpy() - sets.offsets[0].as_py()
            flat = sets.flatten().to_numpy()
            found: list[tuple[int, int]] = []
            for a, b, inside in zip(ends, ends[1:], batch.column("inside").to_pylist(), strict=False):
                left = np.flatnonzero(side[a:b] == 0) + a
                right = left if inside else np.flatnonzero(side[a:b] == 1) + a
                if not len(left) or not len(right):
                    continue
                both = common_counts(*([flat[at[i] : at[i + 1]] for i in x] for x in (left, right)))
                size = np.diff(at)
                union = size[left][:, None] + size[right][None, :] - both
                linked = (100 * both >= percent * union) & (part[left][:, None] != part[right][None, :])
                for x, y in zip(*np.nonzero(linked), strict=True):
                    i, j = left[x], right[y]
                    p, q = find(int(component[i])), find(int(component[j]))
                    if p != q:
                        root[max(p, q)] = min(p, q)
                        found.append((int(rep[i]), int(rep[j])))
            yield pa.RecordBatch.from_pydict(
                {"a": [p for p, _ in found], "b": [q for _, q in found]},
                schema=pa.schema([("a", pa.int64()), ("b", pa.int64())]),
            )

    return run


def prefix_lists(reps: DataFrame, least: int) -> DataFrame:
    """(key, rep, score): each signature under the rarest K - T + 1 of its coordinate-value pairs
    (T: ``least``), where another one has that pair in its prefix, too; ``score``: how common its pairs are.

    Pairs that no other signature has can't collide and are dropped after the count; they come
    first in the order, so what is left of the prefix is shorter by their number.
    """
    posts = reps.select("rep", F.explode("keys").alias("key"))
    shared = posts.groupBy("key").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    ranked = (
        posts.join(shared, "key")
        .groupBy("rep")
        .agg(F.sort_array(F.collect_list(F.struct("df", "key"))).alias("posts"), F.sum("df").alias("score"))
        .filter(F.size("posts") >= least)
    )
    head = F.slice("posts", F.lit(1), F.size("posts") - (least - 1))
    lists = ranked.select("rep", "score", F.explode(head).alias("post"))
    lists = written(lists.select(F.col("post.key").alias("key"), "rep", "score"), "lists")
    more = lists.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key")
    return lists.join(more, "key")


def mixed_blocks(placed: DataFrame, sets: DataFrame) -> DataFrame:
    """Blocks of members to be compared, of lists (key, rep, component, part) that have members of
    several components and several parts; within one part nothing has to be compared.

    The largest part of each list lies in blocks of its own; the others' blocks meet these and
    each other.
    """
    parts = placed.groupBy("key", "part").agg(
        F.count(F.lit(1)).alias("n"), F.min("component").alias("c0"), F.max("component").alias("c1")
    )
    lists = parts.groupBy("key").agg(
        F.max(F.struct("n", "part")).alias("top"),
        F.sum("n").alias("n"),
        F.count(F.lit(1)).alias("parts"),
        F.min("c0").alias("c0"),
        F.max("c1").alias("c1"),
    )
    lists = lists.filter("parts > 1 AND c0 <> c1").select(
        "key",
        F.col("top.part").alias("main"),
        F.ceil(F.col("top.n") / BLOCK).cast("int").alias("main_blocks"),
        F.ceil((F.col("n") - F.col("top.n")) / BLOCK).cast("int").alias("rest_blocks"),
    )
    cut = placed.join(written(lists, "mixed"), "key")
    in_main = F.col("part") == F.col("main")
    rest = F.sequence(F.lit(0), F.col("rest_blocks") - 1)
    own = F.when(in_main, F.pmod(F.xxhash64("rep"), F.col("main_blocks"))).otherwise(
        F.pmod(F.xxhash64("rep"), F.col("rest_blocks"))
    )
    cut = cut.withColumn("own", own.cast("int")).withColumn("in_main", in_main)
    # pairs of blocks (i of the rest, j of the rest, or -1 - j of the largest part)
    meets = F.when(
        F.col("in_main"), F.transform(rest, lambda i: F.struct(i.alias("i"), (-1 - F.col("own")).alias("j")))
    ).otherwise(
        F.concat(
            F.transform(
                F.sequence(F.lit(0), F.col("main_blocks") - 1),
                lambda j: F.struct(F.col("own").alias("i"), (-1 - j).alias("j")),
            ),
            F.transform(rest, lambda j: F.struct(F.least("own", j).alias("i"), F.greatest("own", j).alias("j"))),
        )
    )
    cut = cut.select("key", "rep", "component", "part", "own", "in_main", F.explode(meets).alias("at"))
    side = F.col("in_main") | ((F.col("at.j") >= 0) & (F.col("own") == F.col("at.j")) & (F.col("at.i") != F.col("at.j")))
    cut = cut.select("key", "at.i", "at.j", side.cast("int").alias("side"), "rep", "component", "part")
    cut = cut.join(sets.withColumnRenamed("node", "rep"), "rep")
    held = cut.groupBy("key", "i", "j").agg(F.collect_list(F.struct("side", "rep", "component", "part", "shingles")).alias("members"))
    return held.select((F.col("i") == F.col("j")).alias("inside"), "members")


def near_duplicates(docs: DataFrame, width: int = 3, percent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for documents (doc_id, text).

    A NULL or blank text has an empty set and no links. Rows that repeat a doc_id count as one
    document: it is linked with whatever any of its rows is linked with. A row without a doc_id
    has no component and is kept. An empty table gives no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select("doc_id", "text")
    features = written(
        docs.mapInArrow(_signatures(width), "doc_id long, n_shingles long, d1 long, d2 long, keys array<long>"), "signatures"
    )
    linked = features.filter("doc_id IS NOT NULL AND n_shingles > 0")
    # every set once, by its least document; all copies have the same signature
    least = linked.groupBy("d1", "d2", "n_shingles").agg(F.min(F.struct("doc_id", "keys")).alias("m"))
    known = written(least.select("d1", "d2", "n_shingles", F.col("m.doc_id").alias("rep"), "m.keys"), "reps")
    groups, reps = known.drop("keys"), known.select("rep", "keys")
    lists = written(prefix_lists(reps, collisions(percent)), "lists")
    ids = lists.select(F.col("rep").alias("doc_id")).distinct()
    sets = written(docs.join(ids, "doc_id", "left_semi").mapInArrow(_sets(width), "node long, shingles array<long>"), "sets")

    # one partner each: the member of most of a signature's lists that is closest to all
    heads = lists.groupBy("key").agg(F.max(F.struct("score", (-F.col("rep")).alias("least"))).alias("top"))
    heads = written(heads.select("key", (-F.col("top.least")).alias("b")), "heads")
    partner = (
        lists.join(heads, "key")
        .filter("rep <> b")
        .groupBy(F.col("rep").alias("a"), "b")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("r", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("n"), "b")))
        .filter("r = 1")
        .select("a", "b")
    )
    tested = written(held_against(written(partner, "pairs"), sets, percent), "links")
    links = tested.filter("linked").select("a", "b")

    # rows that repeat a document's id tie their sets together
    copies = linked.join(groups, ["d1", "d2", "n_shingles"]).select("doc_id", "n_shingles", "rep")
    members = written(copies, "members")
    ties = members.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).filter("a <> z").select("doc_id", "a")
    ties = members.join(ties, "doc_id").select("a", F.col("rep").alias("b")).filter("a <> b")

    # all that share a partner, where those linked with it are one component
    home = tested.select(
        F.col("b").alias("key"), F.col("a").alias("rep"), F.when(F.col("linked"), F.col("b")).otherwise(F.col("a")).alias("component")
    )
    centres = tested.select(F.col("b").alias("key"), F.col("b").alias("rep"), F.col("b").alias("component")).distinct()
    homes = written(home.unionByName(centres), "groups")
    grouped = homes.withColumn("part", F.col("component"))
    more = written(mixed_blocks(grouped, sets).mapInArrow(_across(percent), "a long, b long"), "links")
    links = links.unionByName(more)

    # members of one list that do not share a partner; a partner of others stands for its own
    own = homes.withColumn("first", F.when(F.col("key") == F.col("rep"), 0).otherwise(1)).groupBy("rep")
    own = own.agg(F.min(F.struct("first", "key", "component")).alias("o")).select("rep", "o.key", "o.component")
    own = own.withColumnsRenamed({"rep": "node", "key": "part", "component": "found"})
    listed = lists.join(own, lists["rep"] == own["node"], "left").select(
        "key", "rep", F.coalesce("found", "rep").alias("component"), F.coalesce("part", "rep").alias("part")
    )
    more = mixed_blocks(written(listed, "lists"), sets).mapInArrow(_across(percent), "a long, b long")
    links = links.unionByName(written(more, "links")).unionByName(ties)
    final = connected_components(links)

    known = members.select("doc_id", "n_shingles", "rep")
    joined = known.join(final, known["rep"] == final["node"], "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id")
    )
    bare = features.filter("doc_id IS NULL OR n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    # a blank row of a document that has other rows belongs to it
    if bare.filter("doc_id IS NOT NULL").join(joined.select("doc_id"), "doc_id", "left_semi").take(1):
        named = joined.groupBy("doc_id").agg(F.min("component_id").alias("c"))
        bare = bare.join(named, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("c", "component_id").alias("component_id"))
    return joined.unionByName(bare).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op4_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents linked at 85 % of three-word shingles."""
    return near_duplicates(table(spark, sf_dir, "documents"))


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), s AS (
  SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS g
  FROM w
), d AS (SELECT DISTINCT doc_id, g FROM s), n AS (SELECT doc_id, count(*) AS n FROM d GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM d a JOIN d b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)
), reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
least AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, w.doc_id = component_id AS kept
FROM w LEFT JOIN n USING (doc_id) JOIN least USING (doc_id)
"""
