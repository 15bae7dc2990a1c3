"""Keys and values of nested (JSON) data."""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from incognita import rules as R
from incognita.functions import fakes as fk
from incognita.functions.arrays import bind, literal_map
from incognita.functions.names import normalize_name
from incognita.functions.preserve import PreserveRules, prefix_tree, should_preserve
from incognita.functions.text import cut_at_matches
from incognita.operators.catalog import detect_columns
from incognita.operators.tables import ColumnRules, quoted

TABLE_LABEL = "json"


def schema_keys(schema: T.DataType) -> list[str]:
    """Distinct keys at every depth, in the order they are met."""
    keys: dict[str, None] = {}

    def walk(node: T.DataType) -> None:
        if isinstance(node, T.StructType):
            for f in node.fields:
                keys[f.name] = None
                walk(f.dataType)
        elif isinstance(node, T.ArrayType):
            walk(node.elementType)
        elif isinstance(node, T.MapType):
            walk(node.valueType)

    walk(schema)
    return list(keys)


def key_rules(keys: list[str]) -> dict[str, dict]:
    """Detection by key name in the form the apply operators take."""
    found = {k: R.column_rule(k) for k in keys}
    return {k: {"action": "pseudonymize", "type": r.type} for k, r in found.items() if r}


def _types(rules: ColumnRules) -> dict[str, str]:
    full = {k: {"type": r} if isinstance(r, str) else r for k, r in rules.items()}
    return {k: r["type"] for k, r in full.items() if r.get("action", "pseudonymize") == "pseudonymize"}


def _is_scalar(dtype: T.DataType) -> bool:
    """Strings and numbers are replaced; booleans, nulls and dates are not."""
    return isinstance(dtype, (T.StringType, T.NumericType))


def _touches(dtype: T.DataType, types: dict[str, str]) -> bool:
    """Whether some rule applies inside; untouched subtrees are passed through."""
    if not types:
        return False
    if isinstance(dtype, T.StructType):
        return any(
            (f.name in types and _is_scalar(f.dataType)) or _touches(f.dataType, types)
            for f in dtype.fields
        )
    if isinstance(dtype, T.ArrayType):
        return _touches(dtype.elementType, types)
    if isinstance(dtype, T.MapType):
        return _is_scalar(dtype.valueType) or _touches(dtype.valueType, types)
    return False


def _replace_scalar(value: Column, kind: str, seed: str, preserve: PreserveRules | None) -> Column:
    text = value.cast("string")
    made = bind(fk.digest(kind, text, seed), lambda key: fk.generate(kind, text, key))
    return F.when(text.isNull() | should_preserve(text, preserve), text).otherwise(made)


def replace_nested(
    value: Column,
    dtype: T.DataType,
    types: dict[str, str],
    seed: str = fk.DEFAULT_SEED,
    preserve: PreserveRules | None = None,
) -> Column:
    """Rebuilds a nested value with every scalar under a listed key replaced, at any
    depth. Scalars that stand in an array have an index, not a key, and stay."""
    if not _touches(dtype, types):
        return value
    if isinstance(dtype, T.StructType):
        fields = []
        for f in dtype.fields:
            child = value.getField(f.name)
            if f.name in types and _is_scalar(f.dataType):
                child = _replace_scalar(child, types[f.name], seed, preserve)
            else:
                child = replace_nested(child, f.dataType, types, seed, preserve)
            fields.append(child.alias(f.name))
        return F.when(value.isNotNull(), F.struct(*fields))
    if isinstance(dtype, T.ArrayType):
        return F.transform(value, lambda x: replace_nested(x, dtype.elementType, types, seed, preserve))
    if not _is_scalar(dtype.valueType):
        return F.transform_values(
            value, lambda _, x: replace_nested(x, dtype.valueType, types, seed, preserve)
        )

    def by_key(key: Column, x: Column) -> Column:
        out = x.cast("string")
        for name, kind in types.items():
            out = F.when(key == name, _replace_scalar(x, kind, seed, preserve)).otherwise(out)
        return out

    return F.transform_values(value, by_key)


def pseudonymize_json(
    df: DataFrame,
    rules: ColumnRules | None = None,
    seed: str = fk.DEFAULT_SEED,
    preserve: PreserveRules | None = None,
) -> DataFrame:
    """Key rules (default: the detected ones) on a frame of nested columns. Numbers
    under a rule become strings; the structure stays."""
    types = _types(key_rules(schema_keys(df.schema)) if rules is None else rules)
    out = []
    for f in df.schema.fields:
        c = F.col(quoted(f.name))
        if f.name in types and _is_scalar(f.dataType):
            c = _replace_scalar(c, types[f.name], seed, preserve)
        else:
            c = replace_nested(c, f.dataType, types, seed, preserve)
        out.append(c.alias(f.name))
    return df.select(*out)


_STRING = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
_NUMBER = r"-?\d++(?:\.\d++)?(?:[eE][+-]?\d++)?"


_KEY = r'[^"\\]*+(?:\\.[^"\\]*+)*+'
_ESCAPED_KEY = r'(?s)\\[u/][^"]*+"\s*+:'


def _pair_regex(keys: str) -> str:
    """One of the keys with the string or number behind it. In valid JSON a quote
    before a letter that no backslash precedes opens a string, and a string before
    a colon is a key, so nothing inside a value is taken for a pair."""
    return rf'(?s)(?<!\\)"({keys})"\s*+:\s*+({_STRING}|{_NUMBER})'


# A pair as it was found, taken apart.
_FOUND_PAIR = rf'(?s)^"({_KEY})"\s*+:\s*+(.*)$'


def _listed_pair_regex(names: list[str]) -> str:
    """The pairs of all listed names in any case, with blanks and hyphens for underscores. The names are
    tested as a prefix tree: a key is compared with few of them, not with each."""
    tree = prefix_tree([n + '"' for n in names]).replace(r"\_", "[-_ ]")
    return rf'(?s)(?<!\\)"(?=(?iu:{tree}))({_KEY})"\s*+:\s*+({_STRING}|{_NUMBER})'


def _regex_literal(text: str) -> str:
    return "".join(c if c.isalnum() or c == "_" else "\\" + c for c in text)


def pseudonymize_json_text(
    df: DataFrame,
    column: str,
    rules: ColumnRules | None = None,
    seed: str = fk.DEFAULT_SEED,
    preserve: PreserveRules | None = None,
) -> DataFrame:
    """The same for a column of JSON texts, in place: strings and numbers behind a
    rule's key are exchanged, at any depth, and every other character stays. No
    schema is needed, so texts may differ as they like. Without ``rules`` all
    column rules apply to the normalised keys. Invalid JSON fails the job.
    """
    if rules is None:
        types = {r.name: r.type for r in R.COLUMN_RULES}
        regex = _listed_pair_regex(list(types))
    else:
        types = _types(rules)
        regex = _pair_regex("|".join(_regex_literal(n) for n in types))
    if not types:
        return df
    text = F.col(quoted(column))
    kind_of = literal_map(types)

    def string(literal: Column) -> Column:
        plain = F.startswith(literal, F.lit('"')) & ~F.contains(literal, F.lit("\\"))
        read = F.get_json_object(F.concat(F.lit('{"v":'), literal, F.lit("}")), "$.v")
        return F.when(plain, F.substring(literal, F.lit(2), F.length(literal) - 2)).otherwise(read)

    def renewed(pair: Column, spelt: bool) -> Column:
        return bind(
            F.struct(*[F.regexp_extract(pair, _FOUND_PAIR, g).alias(n) for g, n in ((1, "key"), (2, "literal"))]),
            lambda cut: described(pair, cut["key"], cut["literal"], spelt),
        )

    def described(pair: Column, key: Column, literal: Column, spelt: bool) -> Column:
        name = string(F.concat(F.lit('"'), key, F.lit('"'))) if spelt else key
        return F.struct(
            pair.alias("pair"),
            F.left(pair, F.length(pair) - F.length(literal)).alias("before"),
            string(literal).alias("value"),
            F.try_element_at(kind_of, normalize_name(name) if rules is None else name).alias("kind"),
            literal.alias("literal"),
        )

    def replaced(part: Column) -> Column:
        made = bind(
            fk.digest(part["kind"], part["value"], seed),
            lambda key: fk.generate_by(part["kind"], sorted(set(types.values())), part["value"], key),
        )
        escaped = F.replace(F.replace(made, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
        new = F.concat(F.lit('"'), escaped, F.lit('"'))
        keep = should_preserve(part["value"], preserve)
        changed = F.concat(part["before"], F.when(keep, part["literal"]).otherwise(new))
        return F.when(part["kind"].isNull(), part["pair"]).otherwise(changed)

    def rebuilt(regex: str, spelt: bool) -> Column:
        def rebuild(parts: Column) -> Column:
            return F.array_join(
                F.transform(
                    parts,
                    lambda part, i: F.when(i % 2 == 1, bind(renewed(part, spelt), replaced)).otherwise(part),
                ),
                "",
            )

        return bind(
            cut_at_matches(text, regex),
            lambda parts: F.when(F.size(parts) > 1, rebuild(parts)).otherwise(text),
        )

    # keys may be spelt with escapes; in texts that have some, every key is read before it is looked up
    out = F.when(text.rlike(_ESCAPED_KEY), rebuilt(_pair_regex(_KEY), True)).otherwise(rebuilt(regex, False))
    checked = F.when(F.try_parse_json(text).isNotNull(), out).when(
        text.isNotNull(), F.raise_error(F.lit("invalid JSON"))
    )
    return df.withColumn(column, checked)


def _keys(text: str) -> set[str]:
    """Keys at all depths; arrays are looked into through their first element."""

    def refused(name: str) -> None:
        raise ValueError(f"{name} is no JSON")

    found: set[str] = set()
    # numbers are not read: the parser refuses to make integers of very many digits
    open_nodes = [json.loads(text, parse_constant=refused, parse_int=len, parse_float=len)]
    while open_nodes:
        node = open_nodes.pop()
        if isinstance(node, dict):
            found.update(node)
            open_nodes.extend(node.values())
        elif isinstance(node, list) and node:
            open_nodes.append(node[0])
    return found


def json_keys(df: DataFrame, column: str) -> DataFrame:
    """Distinct keys at all depths of a JSON text column, of arrays of objects only
    those of the first element; with the number of texts that hold the key.

    Each text gives its keys once, counts are merged in each task, then shuffled by key: any
    number of keys, under any number of parents, and nothing in the driver. A text that is no
    JSON raises an error; NULL has no keys.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: Counter[str] = Counter()
            for text in batch.column(0).to_pylist():
                if text is not None:
                    counts.update(_keys(text))
            yield pa.RecordBatch.from_pydict(
                {"key": list(counts), "n": list(counts.values())},
                schema=pa.schema([("key", pa.string()), ("n", pa.int64())]),
            )

    found = df.select(F.col(quoted(column)).cast("string")).mapInArrow(run, "key string, n long")
    return found.groupBy("key").agg(F.sum("n").alias("documents"))


def detect_json_keys(df: DataFrame, column: str) -> DataFrame:
    """The keys with their verdicts."""
    keys = json_keys(df, column)
    return detect_columns(keys.select(F.lit(TABLE_LABEL).alias("table"), F.col("key").alias("column")))


# Fixed values of the preview: depth, keys per object, string width, array text.
PREVIEW_DEPTH, PREVIEW_KEYS, PREVIEW_WIDTH = 3, 5, 50
ARRAY_PREVIEW = ("[array mit ", " Elementen]")


def json_preview(value: Column, dtype: T.DataType, depth: int = 0) -> Column:
    """A short nested picture of a document: at most five keys per object down to
    depth three, strings cut at 50 characters, arrays as their element count."""
    if isinstance(dtype, T.ArrayType):
        text = F.concat(F.lit(ARRAY_PREVIEW[0]), F.size(value).cast("string"), F.lit(ARRAY_PREVIEW[1]))
        return F.when(F.size(value) > 0, F.array(text)).when(
            value.isNotNull(), F.array().cast("array<string>")
        )
    if isinstance(dtype, T.StructType):
        if depth > PREVIEW_DEPTH:
            return F.when(value.isNotNull(), F.array(F.lit("...")))
        parts = [
            json_preview(value.getField(f.name), f.dataType, depth + 1).alias(f.name)
            for f in dtype.fields[:PREVIEW_KEYS]
        ]
        if len(dtype.fields) > PREVIEW_KEYS:
            parts.append(F.lit("...").alias("..."))
        return F.when(value.isNotNull(), F.struct(*parts))
    if isinstance(dtype, T.StringType):
        cut = F.concat(F.substring(value, 1, PREVIEW_WIDTH), F.lit("..."))
        return F.when(F.length(value) > PREVIEW_WIDTH, cut).otherwise(value)
    return value


def preview_rows(df: DataFrame) -> DataFrame:
    """One JSON text per row with the preview of its columns."""
    whole = F.struct(*[F.col(quoted(c)) for c in df.columns])
    return df.select(F.to_json(json_preview(whole, df.schema)).alias("preview"))
