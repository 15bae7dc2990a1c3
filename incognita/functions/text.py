"""Pattern search and replacement inside text columns.

Everything here is one expression per row: no shuffle, whole texts. Built-in patterns are
searched in Arrow batches (see ``search``), patterns of one's own by Spark's functions.
Positions count characters from 0, ``end`` is exclusive.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from incognita.functions import fakes as fk
from incognita.functions.arrays import BLOCK, bind, blocks, empty_array, literal_array, running_starts
from incognita.functions.fakes_in_batches import can_make
from incognita.functions.preserve import PreserveRules
from incognita.functions.search import cut_in, found_in
from incognita.rules import DIGIT, PATTERN_SETS, Pattern, patterns_for

# A match. Its end is start + length(value), its type the ordinal-th pattern. Natural
# struct order is "by position, then by pattern order".
_MATCH = "struct<start:int,ordinal:int,value:string>"
_REPLACEMENT = "struct<start:int,end:int,type:string,value:string,fake:string>"
_FOUND = "array<struct<start:int,end:int,type:string,value:string,score:int>>"
_PLANNED = "array<struct<start:int,end:int,type:string,value:string,ordinal:int>>"
_BUILT_IN = frozenset(p for patterns in PATTERN_SETS.values() for p in patterns)

# Up to about this many matches of a pattern are located one by one.
_FEW = 32

# Control characters that mark the cuts; see _unmarked.
_MARK, _STAND_IN = "\u0002", "\u0003"

Patterns = str | list[Pattern]


def detect_value(value: Column, patterns: Patterns = "standard") -> Column:
    """struct(type, score, method) of the first pattern that occurs in the value,
    NULL if none does."""
    out = None
    for p in patterns_for(patterns):
        verdict = F.struct(
            F.lit(p.type).alias("type"),
            F.lit(p.weight).alias("score"),
            F.lit("regex").alias("method"),
        )
        test = _may_occur(value, p) & value.rlike(p.spark_regex)
        out = F.when(test, verdict) if out is None else out.when(test, verdict)
    return out


def _may_occur(text: Column, p: Pattern, has_digit: Column | None = None) -> Column:
    """A cheap necessary condition for a match."""
    if p.needs == DIGIT and has_digit is not None:
        return has_digit
    return text.rlike(p.needs) if p.needs else F.lit(True)


def _marked(text: Column, regex: str) -> Column:
    """The text with a mark before and after every match."""
    return F.regexp_replace(text, F.lit(regex), F.lit(f"{_MARK}$0{_MARK}"))


def cut_at_matches(text: Column, regex: str) -> Column:
    """The text as gap, match, gap, ..., gap. A text that holds the mark itself is
    searched and split by the regex instead, which costs a second pass."""
    pairs = F.zip_with(
        F.split(text, regex, -1),
        F.regexp_extract_all(text, F.lit(regex), F.lit(0)),
        lambda gap, match: F.when(match.isNull(), F.array(gap)).otherwise(F.array(gap, match)),
    )
    return F.when(F.contains(text, F.lit(_MARK)), F.flatten(pairs)).otherwise(
        F.split(_marked(text, regex), _MARK, -1)
    )


def _unmarked(text: Column) -> Column:
    """The same text without the control character used as mark, for searching only.
    Positions stay, and no pattern of the rule sets tells control characters apart,
    so no match changes; patterns of one's own must not either."""
    return F.when(F.contains(text, F.lit(_MARK)), F.translate(text, _MARK, _STAND_IN)).otherwise(text)


def _located(marked: Column, ordinal: Column) -> Column:
    """The matches of a marked text as array<struct<start,ordinal,value>>.

    A split at the marks (a plain character search) gives gaps and matches in turn.
    A few matches get their start from the length of what stands before their
    mark; for many the running sum of all lengths is cheaper.
    """

    def matches(parts: Column, start_of) -> Column:
        return F.transform(
            F.sequence(F.lit(1), F.size(parts) - 1, F.lit(2)),
            lambda i: F.struct(
                start_of(i).alias("start"), ordinal.alias("ordinal"), F.get(parts, i).alias("value")
            ),
        )

    def before_mark(i: Column) -> Column:
        return F.length(F.call_function("substring_index", marked, F.lit(_MARK), i)) - i + 1

    def summed_up(parts: Column) -> Column:
        starts = bind(F.transform(parts, F.length), running_starts)
        return bind(starts, lambda s: matches(parts, lambda i: F.get(s, i)))

    return bind(
        F.split(marked, _MARK, -1),
        lambda parts: F.when(F.size(parts) == 1, empty_array(_MATCH))
        .when(F.size(parts) <= 2 * _FEW, matches(parts, before_mark))
        .otherwise(summed_up(parts)),
    )


def _matches(text: Column, patterns: list[Pattern]) -> Column:
    """Matches of all patterns, sorted by position; an empty array for NULL text.

    Each pattern that can occur at all costs one regex pass, which marks its matches
    in a copy of the text; what follows is the same for all copies.
    """
    if not patterns:
        return empty_array(_MATCH)

    def marked_copies(doc: Column) -> Column:
        return F.array(
            *[
                F.when(_may_occur(doc["text"], p, doc["digit"]), _marked(doc["text"], p.spark_regex))
                for p in patterns
            ]
        )

    copies = bind(F.struct(_unmarked(text).alias("text"), text.rlike(DIGIT).alias("digit")), marked_copies)
    found = F.transform(
        copies,
        lambda marked, i: F.when(marked.isNull(), empty_array(_MATCH)).otherwise(_located(marked, i)),
    )
    return F.array_sort(F.flatten(found))


def _end(match: Column) -> Column:
    return match["start"] + F.length(match["value"])


def _of_pattern(values: list, match: Column) -> Column:
    """The entry of a per-pattern list that belongs to a match."""
    return F.get(literal_array(values), match["ordinal"])


def _searched(text: Column, patterns: list[Pattern], returned: str, resolve: bool = False, seed: str = "") -> Column:
    """Matches of built-in patterns, on request without overlaps; an empty array for NULL text."""
    chosen = tuple(patterns)
    last = returned.rpartition(",")[2].partition(":")[0]
    found = F.arrow_udf(lambda texts: found_in(texts, chosen, resolve, last, seed), returned)
    return found(text.cast("string"))


def find_all(text: Column, patterns: Patterns = "standard", types: list[str] | None = None) -> Column:
    """array<struct<start,end,type,value,score>>, sorted by start."""
    chosen = patterns_for(patterns, types)
    if chosen and _BUILT_IN.issuperset(chosen):
        return _searched(text, chosen, _FOUND)
    kinds, scores = [p.type for p in chosen], [p.weight for p in chosen]
    return F.transform(
        _matches(text, chosen),
        lambda m: F.struct(
            m["start"].alias("start"),
            _end(m).alias("end"),
            _of_pattern(kinds, m).alias("type"),
            m["value"].alias("value"),
            _of_pattern(scores, m).alias("score"),
        ),
    )


def resolve_overlaps(matches: Column) -> Column:
    """Keep the right-most of overlapping matches (at equal starts the earlier
    pattern), in ascending order.

    Going from right to left every kept match starts at or after the current
    one, so it is enough to compare with the start of the match kept last.
    """

    def from_right(m: Column) -> Column:
        return F.struct((-m["start"]).alias("back"), m["ordinal"].alias("ordinal"), m["value"].alias("value"))

    def step(acc: Column, m: Column) -> Column:
        fits = F.length(m["value"]) - m["back"] <= acc["last"]
        return F.struct(
            F.when(fits, -m["back"]).otherwise(acc["last"]).alias("last"),
            F.concat(acc["flags"], F.when(fits, "1").otherwise("0")).alias("flags"),
        )

    def keep(ordered: Column) -> Column:
        # One character per match is all the fold carries along.
        nothing = F.struct(F.lit(2**31 - 1).alias("last"), F.lit("").alias("flags"))
        flags = F.aggregate(ordered, nothing, step, lambda acc: F.split(acc["flags"], "", -1))
        return bind(flags, lambda f: F.filter(ordered, lambda _, i: F.get(f, i) == "1"))

    def forward(m: Column) -> Column:
        return F.struct((-m["back"]).alias("start"), m["ordinal"].alias("ordinal"), m["value"].alias("value"))

    def walk(several: Column) -> Column:
        ordered = F.array_sort(F.transform(several, from_right))
        return F.reverse(F.transform(bind(ordered, keep), forward))

    return bind(matches, lambda m: F.when(F.size(m) > 1, walk(m)).otherwise(m))


def splice(text: Column, replacements: Column) -> Column:
    """Put ``fake`` in place of [start, end) for each element; elements must be
    ascending and free of overlaps, a NULL fake leaves its span as it is."""

    def end_before(i: Column) -> Column:
        return F.when(i == 0, 0).otherwise(F.get(replacements, i - 1)["end"])

    # A position in a string is found by walking there. So each block of
    # replacements gets its own stretch of the text to be cut from.
    def block(part: Column, b: Column) -> Column:
        first = b * BLOCK
        start = end_before(first)
        stretch = F.substring(text, start + 1, F.element_at(part, -1)["end"] - start)

        def piece(r: Column, i: Column, inner: Column) -> Column:
            before = end_before(first + i)
            gap = F.substring(inner, before - start + 1, r["start"] - before)
            return F.concat(gap, F.coalesce(r["fake"], r["value"]))

        return bind(
            stretch,
            lambda inner: F.array_join(F.transform(part, lambda r, i: piece(r, i, inner)), ""),
        )

    rest = F.substring(text, F.element_at(replacements, -1)["end"] + 1, F.length(text))
    return F.concat(F.array_join(F.transform(blocks(replacements), block), ""), rest)


def planned_replacements(
    text: Column,
    patterns: Patterns = "standard",
    types: list[str] | None = None,
    seed: str = fk.DEFAULT_SEED,
    preserve: PreserveRules | None = None,
) -> Column:
    """The matches that survive overlap resolution, each with its fake (NULL
    where the value is preserved). Preserved matches still win overlaps."""
    chosen = patterns_for(patterns, types)
    if not chosen:
        return empty_array(_REPLACEMENT)
    kinds, targets = [p.type for p in chosen], [p.fake_type for p in chosen]
    built_in = _BUILT_IN.issuperset(chosen)
    if built_in and can_make(targets):
        plan = _searched(text, chosen, f"array<{_REPLACEMENT}>", True, seed)
        if preserve is None:
            return plan
        return F.transform(
            plan,
            lambda m: F.struct(
                *[m[c].alias(c) for c in ("start", "end", "type", "value")],
                F.when(~preserve.matches(m["value"]), m["fake"]).alias("fake"),
            ),
        )

    def fake_of(m: Column) -> Column:
        key = fk.digest(_of_pattern(targets, m), m["value"], seed)

        def choose(k: Column) -> Column:
            out = None
            for target in dict.fromkeys(targets):
                # IN is slow where Spark interprets it, as it does inside transform
                own = reduce(Column.__or__, [m["ordinal"] == i for i, t in enumerate(targets) if t == target])
                made = fk.generate(target, m["value"], k)
                out = F.when(own, made) if out is None else out.when(own, made)
            return out

        made = bind(key, choose)
        return made if preserve is None else F.when(~preserve.matches(m["value"]), made)

    if built_in:
        return F.transform(
            _searched(text, chosen, _PLANNED, resolve=True),
            lambda m: F.struct(*[m[c].alias(c) for c in ("start", "end", "type", "value")], fake_of(m).alias("fake")),
        )
    return F.transform(
        resolve_overlaps(_matches(text, chosen)),
        lambda m: F.struct(
            m["start"].alias("start"),
            _end(m).alias("end"),
            _of_pattern(kinds, m).alias("type"),
            m["value"].alias("value"),
            fake_of(m).alias("fake"),
        ),
    )


def pseudonymize_text(
    text: Column,
    types: list[str] | None = None,
    patterns: Patterns = "standard",
    seed: str = fk.DEFAULT_SEED,
    preserve: PreserveRules | None = None,
) -> Column:
    """The text with every match of the enabled types replaced; NULL stays NULL."""
    plan = planned_replacements(text, patterns, types, seed, preserve)
    return bind(plan, lambda r: F.when(F.size(r) > 0, splice(text, r)).otherwise(text))


def redact_document(
    text: Column,
    types: list[str],
    seed: str = fk.DEFAULT_SEED,
    preserve: PreserveRules | None = None,
) -> Column:
    """Document variant: the types are applied one after the other, each to the
    text the ones before it left, with the word-bounded document patterns."""
    out = text
    for p in patterns_for("document", types):
        out = _replace_each(out, p, seed, preserve)
    return out


def _replace_each(text: Column, p: Pattern, seed: str, preserve: PreserveRules | None) -> Column:
    def replacement(value: Column) -> Column:
        made = bind(fk.digest(p.fake_type, value, seed), lambda key: fk.generate(p.fake_type, value, key))
        return made if preserve is None else F.when(preserve.matches(value), value).otherwise(made)

    # The text itself is used once, so that a chain of replacements stays a chain.
    parts = F.arrow_udf(lambda texts: cut_in(texts, p), "array<string>")(text.cast("string"))
    changed = F.transform(parts, lambda part, i: F.when(i % 2 == 1, replacement(part)).otherwise(part))
    return F.array_join(changed, "")
