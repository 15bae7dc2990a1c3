"""The registered queries: each callable takes (spark, sf_dir) and returns a frame."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from incognita import functions as fn
from incognita import operators as op
from incognita import sources as src
from incognita import streaming
from incognita.functions.fakes import GENERATORS
from incognita.plans import inputs as inp
from incognita.rules import Pattern

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}

CUSTOMER_RULES = {
    "name": "full_name",
    "email": "email",
    "phone": "phone",
    "birthdate": "birthdate",
    "city": "city",
    "zip": "postcode",
    "age": "age",
}
SUPPLIER_RULES = {"company": "company", "city": "city", "name": "full_name"}
KEEP_ADMIN = fn.PreserveRules(("admin", "City 7", "ENTERPRISE-unknown"))


def query(function: Query) -> Query:
    REGISTRY[function.__name__] = function
    return function


# --- sources and sinks ----------------------------------------------------


@query
def list_tables(spark, sf):
    return op.row_counts(inp.all_tables(spark, sf)).withColumnRenamed("table", "name")


@query
def table_columns(spark, sf):
    """Catalogue with the number of filled cells per column."""
    tables = inp.all_tables(spark, sf)
    catalog = op.table_columns(spark, tables, {"orders": ["o_orderkey"], "customer": ["c_custkey"]})
    filled = None
    for name, df in tables.items():
        one = df.agg(
            F.array(
                *[F.struct(F.lit(c).alias("column"), F.count(F.col(c)).alias("filled")) for c in df.columns]
            ).alias("x")
        ).select(F.lit(name).alias("table"), F.inline("x"))
        filled = one if filled is None else filled.unionByName(one)
    joined = catalog.join(filled, ["table", "column"])
    return joined.select("table", "column", "ordinal", "primary", "filled")


@query
def read_csv_sniffed(spark, sf):
    path = inp.folder(spark, "csv")
    src.write_csv(inp.customers(spark, sf), path, ";")
    return src.read_csv_sniffed(spark, path)


@query
def write_csv(spark, sf):
    """The written lines themselves."""
    path = inp.folder(spark, "csv")
    note = F.concat(F.lit('say "'), F.col("segment"), F.lit('" | '), F.col("city"))
    df = inp.customers(spark, sf).select("id", "name", note.alias("note"), "phone")
    src.write_csv(df, path, "|")
    return spark.read.text(path).where("value <> 'id|name|note|phone'").select(F.col("value").alias("line"))


@query
def read_json(spark, sf):
    path = inp.folder(spark, "json")
    src.write_json(inp.nested_orders(spark, sf), path)
    df = src.read_json(spark, path)
    return df.select(
        "order_id",
        "company",
        F.col("customer.email").alias("email"),
        F.col("customer.address.zip").alias("zip"),
        F.col("contacts")[1]["phone"].alias("phone"),
        F.size("mail").alias("mails"),
    )


@query
def write_json(spark, sf):
    """The written lines themselves: nulls spelled out, umlauts as they are."""
    path = inp.folder(spark, "json")
    df = inp.customers(spark, sf).select(
        "id", "email", F.struct(F.concat(F.lit("Straße "), "city").alias("straße"), "age").alias("address")
    )
    src.write_json(df, path)
    return spark.read.text(path).select(F.col("value").alias("line"))


@query
def read_insert_dump(spark, sf):
    """Whole orders out to a dump and back in."""
    path = inp.folder(spark, "dump")
    df = inp.table(spark, sf, "orders").select(
        "o_orderkey",
        F.when(F.col("o_custkey") % 9 != 0, F.col("o_custkey")).alias("o_custkey"),
        F.concat(F.lit("it's; ("), "o_orderpriority", F.lit(') "\\')).alias("note"),
    )
    src.write_insert_dump(src.to_insert_statements(df, "orders"), path)
    return src.dump_table(src.read_insert_dump(spark, path), "orders", df.columns)


@query
def to_insert_statements(spark, sf):
    """The value tuples as they stand in the export."""
    df = inp.customers(spark, sf).select("id", "name", "email", "age", "balance")
    statements = src.parse_inserts(src.to_insert_statements(df, "users"))
    return statements.select("table", F.explode("tuples").alias("tuple"))


@query
def read_text(spark, sf):
    path = inp.folder(spark, "text")
    src.write_text(inp.table(spark, sf, "documents"), "text", path)
    texts = src.read_text(spark, path, record_end="\u001e")
    return texts.select(op.text_sample(F.col("text")).alias("sample"), F.length("text").alias("chars"))


@query
def write_table(spark, sf):
    path = inp.folder(spark, "table")
    out = op.pseudonymize_table(inp.customers(spark, sf), {"name": "full_name", "age": "age"})
    src.write_table(out, path)
    return spark.read.parquet(path).select("id", "name", "age", "balance")


@query
def count_rows(spark, sf):
    return src.count_rows(inp.table(spark, sf, "lineitem"))


@query
def fetch_batch(spark, sf):
    return src.fetch_batch(
        inp.table(spark, sf, "orders"), ["o_orderkey", "o_custkey"], "o_orderkey", offset=100, limit=50
    )


@query
def fetch_after(spark, sf):
    return src.fetch_after(
        inp.table(spark, sf, "orders"), ["o_orderkey", "o_orderstatus"], "o_orderkey", last=500, limit=50
    )


# --- detection ------------------------------------------------------------


@query
def normalize_name(spark, sf):
    names = inp.named_cells(spark, sf)
    return names.select("key", fn.normalize_name(F.concat_ws("-", "table", "column")).alias("normalized"))


@query
def detect_columns(spark, sf):
    return op.detect_columns(inp.named_cells(spark, sf)).drop("table")


@query
def context_score(spark, sf):
    """Highest score per table label and column label."""
    judged = op.detect_columns(inp.named_cells(spark, sf))
    return judged.groupBy("table", "column").agg(
        F.max("score").alias("score"), F.count(F.lit(1)).alias("n")
    )


@query
def detect_value(spark, sf):
    lines = inp.documents(spark, sf).select(
        "doc_id", F.posexplode(F.split("text", "\n")).alias("line", "value")
    )
    verdict = fn.detect_value(F.col("value"))
    found = lines.select("doc_id", "line", verdict.alias("v")).where("v IS NOT NULL")
    return found.select("doc_id", "line", "v.type", "v.score", "v.method")


@query
def available_types(spark, sf):
    """Types with their generator and the number of cells detected as such."""
    judged = op.detect_columns(inp.named_cells(spark, sf)).where("detected")
    cells = judged.groupBy("type").agg(F.count(F.lit(1)).alias("cells"))
    types = op.available_types(spark)
    return types.join(cells, "type", "left").select(
        "type", "faker_method", F.coalesce("cells", F.lit(0)).alias("cells")
    )


@query
def analyze_schema(spark, sf):
    tables = {
        "customers": inp.customers(spark, sf),
        "supplier": inp.suppliers(spark, sf),
        "pages": inp.table(spark, sf, "pages"),
        "lineitem": inp.table(spark, sf, "lineitem"),
    }
    found = op.analyze_schema(spark, tables)
    return found.select("table", "column", "type", "faker_method", "score", "method", "action", "row_count")


@query
def find_all(spark, sf):
    return op.findings(inp.documents(spark, sf))


@query
def find_all_enriched(spark, sf):
    return op.findings(inp.enriched_text(spark, sf))


@query
def find_all_pages(spark, sf):
    pages = op.spread(inp.table(spark, sf, "pages").select("page_id", F.concat_ws(" ", "url", "html").alias("text")))
    return op.findings(pages)


@query
def find_all_corrected(spark, sf):
    return op.findings(inp.enriched_text(spark, sf), patterns="corrected", types=["phone_de", "iban", "date_iso"])


@query
def findings_by_type(spark, sf):
    """Flagship: how much of what there is in all documents."""
    found = op.findings(inp.documents(spark, sf))
    return found.groupBy("type").agg(
        F.count(F.lit(1)).alias("findings"),
        F.count_distinct("doc_id").alias("documents"),
        F.max("score").alias("score"),
    )


@query
def distinct_findings(spark, sf):
    return op.distinct_findings(op.findings(inp.enriched_text(spark, sf)))


@query
def score_band(spark, sf):
    judged = op.detect_columns(inp.named_cells(spark, sf))
    return judged.select("key", "score", fn.score_band(F.col("score")).alias("band"))


@query
def preserved_findings(spark, sf):
    rules = fn.PreserveRules(("mail1.example.com", "10.", "0"), mode="strict")
    return op.findings(inp.documents(spark, sf), preserve=rules)


@query
def scan_cells(spark, sf):
    return op.scan_cells(inp.customers(spark, sf), "customers", "id")


@query
def profile_sheet(spark, sf):
    sheets = {"Customers": inp.customers(spark, sf), "Suppliers": inp.suppliers(spark, sf)}
    found = op.profile_sheets(spark, sheets)
    return found.select("sheet", "column", "type", "score", "row_count")


@query
def doc_pattern_findings(spark, sf):
    return op.document_findings(inp.enriched_text(spark, sf))


@query
def document_profile(spark, sf):
    return op.document_profile(inp.documents(spark, sf))


@query
def json_keys(spark, sf):
    docs = inp.nested_orders(spark, sf)
    texts = docs.select(F.to_json(F.struct(*docs.columns)).alias("doc"))
    return op.json_keys(texts, "doc")


@query
def json_keys_events(spark, sf):
    return op.json_keys(inp.table(spark, sf, "events"), "props")


@query
def detect_json_keys(spark, sf):
    docs = inp.nested_orders(spark, sf)
    texts = docs.select(F.to_json(F.struct(*docs.columns)).alias("doc"))
    return op.detect_json_keys(texts, "doc").select("column", "detected", "type", "score", "action")


@query
def json_preview(spark, sf):
    docs = inp.nested_orders(spark, sf)
    long = F.repeat("company", 8).alias("long")
    return op.preview_rows(docs.select("order_id", long, "customer", "contacts", "mail", "company"))


# --- preserve rules -------------------------------------------------------


def _labels(spark, sf):
    key = F.col("key")
    value = (
        F.when(key % 10 == 0, "Admin")
        .when(key % 10 == 1, "")
        .when(key % 10 == 2, None)
        .when(key % 10 == 3, F.concat(F.lit("no-reply+"), key.cast("string")))
        .when(key % 10 == 4, "min")
        .when(key % 10 == 5, F.concat(F.lit("TEST"), key.cast("string")))
        .otherwise(F.concat("table", F.lit("/"), "column"))
    )
    return inp.named_cells(spark, sf).select("key", value.alias("value"))


@query
def parse_preserve_rules(spark, sf):
    as_json = fn.PreserveRules.parse('{"a": ["root", ["LEADS/age"]], "b": {"c": "orders"}}')
    as_list = fn.PreserveRules.parse(" root,LEADS/age \n\n orders ,")
    v = F.col("value")
    return _labels(spark, sf).select(
        "key", as_json.matches(v).alias("by_json"), as_list.matches(v).alias("by_list")
    )


@query
def should_preserve(spark, sf):
    rules = ("Admin", "orders/", "no-reply")
    v = F.col("value")
    return _labels(spark, sf).select(
        "key",
        fn.PreserveRules(rules).matches(v).alias("compat"),
        fn.PreserveRules(rules, mode="strict").matches(v).alias("strict"),
        fn.PreserveRules(rules, case_sensitive=True).matches(v).alias("exact_case"),
        fn.PreserveRules(("*/age", "test*5"), glob=True, mode="strict").matches(v).alias("glob"),
        fn.PreserveRules().matches(v).alias("no_rules"),
    )


@query
def edit_preserve_rules(spark, sf):
    rules = fn.PreserveRules().add(" test ").add("test").add("orders").add("x1").remove("orders")
    return _labels(spark, sf).select("key", rules.matches(F.col("value")).alias("kept"))


@query
def default_preserve_rules(spark, sf):
    return _labels(spark, sf).select("key", fn.PreserveRules.defaults().matches(F.col("value")).alias("kept"))


@query
def mark_preserved(spark, sf):
    """Rules that are a table: every distinct word of the part names."""
    parts = inp.table(spark, sf, "part")
    rules = parts.select(F.explode(F.split("p_name", " ")).alias("rule"))
    values = parts.select(
        "p_partkey",
        F.when(F.col("p_partkey") % 3 == 0, F.upper(F.substring("p_name", 2, 3)))
        .when(F.col("p_partkey") % 3 == 1, F.col("p_type"))
        .otherwise(F.concat("p_type", F.lit(" "), "p_name"))
        .alias("value"),
    )
    return op.mark_preserved(values, "value", rules)


# --- fakes ----------------------------------------------------------------


def _fake_query(kind: str) -> Query:
    def run(spark, sf):
        people = inp.customers(spark, sf)
        source = F.col("birthdate") if kind == "birthdate" else F.col("name")
        return people.select("id", fn.fake(kind, source).alias("fake"))

    return run


for _kind in GENERATORS:
    REGISTRY[f"fake_{_kind}"] = _fake_query(_kind)


@query
def fake_unknown_type(spark, sf):
    return inp.customers(spark, sf).select("id", fn.fake("shoe_size", F.col("name")).alias("fake"))


@query
def fake_preserved(spark, sf):
    """NULL and preserved values pass, others get their fake."""
    people = inp.customers(spark, sf)
    return people.select("id", fn.fake("email", F.col("email"), preserve=KEEP_ADMIN).alias("email"))


@query
def fake_seeded(spark, sf):
    people = inp.customers(spark, sf)
    return people.select(
        "id",
        fn.fake("city", F.col("city"), seed="one").alias("one"),
        fn.fake("city", F.col("city"), seed="two").alias("two"),
    )


def _two_tables(spark, sf):
    return (
        {"customers": inp.customers(spark, sf), "suppliers": inp.suppliers(spark, sf)},
        {"customers": CUSTOMER_RULES, "suppliers": SUPPLIER_RULES},
    )


@query
def build_mapping(spark, sf):
    tables, rules = _two_tables(spark, sf)
    return op.build_mapping(tables, rules, preserve=KEEP_ADMIN)


@query
def build_mapping_unique(spark, sf):
    tables = {"orders": inp.table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")}
    rules = {"orders": {"o_orderkey": "email", "o_custkey": "last_name", "o_orderpriority": "last_name"}}
    return op.build_mapping(tables, rules, unique=True)


@query
def build_mapping_continued(spark, sf):
    """A unique mapping of some orders' values, then of all: the first fakes stay, none comes twice."""
    orders = inp.table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    rules = {"orders": {"o_orderkey": "email", "o_custkey": "iban", "o_orderpriority": "last_name"}}
    first = op.build_mapping({"orders": orders.where("o_custkey % 3 = 0")}, rules, unique=True)
    path = inp.folder(spark, "mapping")
    src.write_table(first, path)
    return op.build_mapping({"orders": orders}, rules, unique=True, earlier=spark.read.parquet(path))


@query
def preserve_one_character(spark, sf):
    """Long rules beside one of a single character."""
    parts = inp.table(spark, sf, "part")
    rules = parts.select(F.col("p_name").alias("rule")).unionByName(parts.select(F.lit("#").alias("rule")))
    sign = F.when(F.col("p_partkey") % 4 == 0, "#").otherwise("+")
    values = parts.select(
        "p_partkey",
        F.when(F.col("p_partkey") % 2 == 0, F.concat("p_type", sign)).otherwise(F.substring("p_name", 3, 12)).alias("value"),
    )
    return op.mark_preserved(values, "value", rules)


@query
def apply_mapping(spark, sf):
    """An earlier mapping (of the suppliers, another seed) reused on the customers."""
    earlier = op.build_mapping(
        {"suppliers": inp.suppliers(spark, sf)}, {"suppliers": SUPPLIER_RULES}, seed="earlier"
    )
    people = inp.customers(spark, sf).select("id", "name", "city", "age", "phone")
    rules = {"name": "full_name", "city": "city", "age": "age"}
    return op.apply_mapping(people, earlier, rules, preserve=KEEP_ADMIN)


@query
def mapping_stats(spark, sf):
    tables, rules = _two_tables(spark, sf)
    return op.mapping_stats(op.originals(tables, rules, preserve=KEEP_ADMIN))


@query
def mapping_stats_lineitem(spark, sf):
    """Columns with few values over many rows."""
    lines = inp.table(spark, sf, "lineitem")
    rules = {"l_suppkey": "company", "l_returnflag": "word", "l_linestatus": "word"}
    return op.mapping_stats(op.originals({"lineitem": lines}, {"lineitem": rules}))


# --- applying -------------------------------------------------------------


@query
def pseudonymize_table(spark, sf):
    return op.pseudonymize_table(inp.customers(spark, sf), CUSTOMER_RULES, preserve=KEEP_ADMIN)


@query
def pseudonymize_lineitem(spark, sf):
    lines = inp.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey")
    lines = op.spread(lines)
    return op.pseudonymize_table(lines, {"l_suppkey": "company", "l_partkey": "iban"})


@query
def pseudonymize_tables(spark, sf):
    """Equal cities and names of both tables get equal fakes."""
    tables, rules = _two_tables(spark, sf)
    out = op.pseudonymize_tables(tables, rules)
    parts = [df.select(F.lit(t).alias("table"), "id", "name", "city") for t, df in out.items()]
    return parts[0].unionByName(parts[1])


@query
def run_summary(spark, sf):
    tables, rules = _two_tables(spark, sf)
    tables["lineitem"] = inp.table(spark, sf, "lineitem")
    narrow = {"customers": {"email": "email"}, "suppliers": rules["suppliers"]}
    return op.run_summary(tables, narrow, preserve=KEEP_ADMIN)


@query
def keep_rule(spark, sf):
    rules = {
        "name": {"action": "keep", "type": "full_name"},
        "city": {"action": "pseudonymize", "type": "city"},
    }
    return op.pseudonymize_table(inp.customers(spark, sf).select("id", "name", "city"), rules)


@query
def progress(spark, sf):
    """Counters observed while the replaced table is written, as a one-row frame next
    to the number of rows read back."""
    path = inp.folder(spark, "progress")
    rules = {"email": "email"}
    counted, watch = op.with_progress(inp.customers(spark, sf), "customers", rules, preserve=KEEP_ADMIN)
    src.write_table(op.pseudonymize_table(counted, rules, preserve=KEEP_ADMIN), path)
    seen = watch.get
    return spark.read.parquet(path).agg(F.count(F.lit(1)).alias("written")).select(
        F.lit(seen["processed"]).alias("processed"), F.lit(seen["updated"]).alias("updated"), "written"
    )


@query
def pseudonymize_csv(spark, sf):
    source, target = inp.folder(spark, "csv"), inp.folder(spark, "csv")
    src.write_csv(inp.customers(spark, sf), source, "\t")
    src.pseudonymize_csv(spark, source, target, preserve=KEEP_ADMIN)
    return src.read_csv_sniffed(spark, target)


@query
def pseudonymize_json(spark, sf):
    out = op.pseudonymize_json(inp.nested_orders(spark, sf))
    return out.select(
        "order_id",
        "company",
        F.col("customer.id").alias("id"),
        F.col("customer.name").alias("name"),
        F.col("customer.email").alias("email"),
        F.col("customer.login").alias("login"),
        F.col("customer.address.street").alias("street"),
        F.col("customer.address.zip").alias("zip"),
        F.col("contacts")[0]["status"].alias("status"),
        F.col("contacts")[0]["phone"].alias("phone"),
        F.col("contacts")[1]["phone"].alias("phone2"),
        F.array_join("mail", "+").alias("mail"),
    )


@query
def pseudonymize_json_text(spark, sf):
    events = inp.table(spark, sf, "events").select("event_id", "user_id", "props")
    return op.pseudonymize_json_text(events, "props", {"k": "username"})


@query
def pseudonymize_json_documents(spark, sf):
    """Whole nested orders as texts, changed in place, some fields read back."""
    docs = inp.nested_orders(spark, sf)
    texts = docs.select("order_id", F.to_json(F.struct(*docs.columns)).alias("doc"))
    out = op.pseudonymize_json_text(texts, "doc")
    paths = {
        "company": "$.company",
        "name": "$.customer.name",
        "email": "$.customer.email",
        "street": "$.customer.address.street",
        "zip": "$.customer.address.zip",
        "status": "$.contacts[0].status",
        "phone": "$.contacts[0].phone",
        "phone2": "$.contacts[1].phone",
        "mail": "$.mail[0]",
    }
    return out.select("order_id", *[F.get_json_object("doc", p).alias(n) for n, p in paths.items()])


@query
def pseudonymize_insert_dump(spark, sf):
    df = inp.customers(spark, sf).select("id", "name", "email", "city")
    path, target = inp.folder(spark, "dump"), inp.folder(spark, "dump")
    src.write_insert_dump(src.to_insert_statements(df, "users"), path)
    rules = {"users": {"name": "full_name", "email": "email", "city": "city"}}
    dump = src.read_insert_dump(spark, path)
    src.write_insert_dump(src.pseudonymize_insert_dump(dump, rules, preserve=KEEP_ADMIN), target)
    return src.dump_table(src.read_insert_dump(spark, target), "users", df.columns)


@query
def pseudonymize_text(spark, sf):
    docs = inp.documents(spark, sf)
    return docs.select("doc_id", fn.pseudonymize_text(F.col("text")).alias("text"))


@query
def pseudonymize_text_enriched(spark, sf):
    rules = fn.PreserveRules(("@shop-3.example.com",), mode="strict")
    orders = inp.enriched_text(spark, sf)
    return orders.select("id", fn.pseudonymize_text(F.col("text"), preserve=rules).alias("text"))


@query
def resolve_overlaps(spark, sf):
    """The matches that survive, without their fakes."""
    orders = inp.enriched_text(spark, sf)
    plan = fn.planned_replacements(F.col("text"))
    return orders.select("id", F.inline(plan)).drop("fake")


@query
def pattern_to_type(spark, sf):
    """How the surviving matches of the document texts are replaced."""
    docs = inp.documents(spark, sf)
    plan = fn.planned_replacements(F.col("text"))
    return docs.select("doc_id", F.inline(plan)).select("doc_id", "start", "type", "fake")


@query
def splice_replacements(spark, sf):
    """Two enabled types only, in the order that decides ties."""
    orders = inp.enriched_text(spark, sf)
    types = ["date_iso", "email"]
    return orders.select("id", fn.pseudonymize_text(F.col("text"), types=types).alias("text"))


@query
def redact_document(spark, sf):
    types = ["email", "phone", "iban", "ipv4", "url", "uuid"]
    orders = inp.enriched_text(spark, sf)
    return orders.select("id", fn.redact_document(F.col("text"), types).alias("text"))


@query
def pseudonymize_sheets(spark, sf):
    """Empty cells stay, numbers stay."""
    rules = {"Customers": {"phone": "phone", "city": "city", "age": "age"}}
    out = op.pseudonymize_sheets({"Customers": inp.customers(spark, sf)}, rules, preserve=KEEP_ADMIN)
    return out["Customers"].select("id", "phone", "city", "age")


@query
def pseudonymize_stream(spark, sf):
    """The customers as a stream of files, worked off and read back."""
    source, target, state = (inp.folder(spark, p) for p in ("source", "stream", "state"))
    people = inp.customers(spark, sf)
    src.write_table(people, source)
    stream = spark.readStream.schema(people.schema).parquet(source)
    out = streaming.pseudonymize_stream(stream, CUSTOMER_RULES, preserve=KEEP_ADMIN)
    streaming.start_available(out, target, state).awaitTermination()
    return spark.read.parquet(target)


@query
def pseudonymize_text_stream(spark, sf):
    """Document texts as a stream."""
    target, state = inp.folder(spark, "stream"), inp.folder(spark, "state")
    stream = inp.table_stream(spark, sf, "documents").select("doc_id", "text")
    out = streaming.pseudonymize_text_stream(stream, types=["email", "ipv4"])
    streaming.start_available(out, target, state).awaitTermination()
    return spark.read.schema(out.schema).parquet(target)


@query
def drop_expired(spark, sf):
    events = inp.table(spark, sf, "events")
    kept = op.drop_expired(events, "ts", timedelta(hours=36), datetime(2024, 1, 4))
    return kept.select("event_id", "user_id", "event_type")


@query
def fetch_page(spark, sf):
    """The fourth page of 100 orders by way of a directory."""
    orders = inp.table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    index = src.write_page_index(orders, "o_orderkey", inp.folder(spark, "pages"))
    return src.fetch_page(index, ["o_orderkey", "o_custkey"], 3, 100)


@query
def stream_progress(spark, sf):
    """Counters of a stream of several micro-batches."""
    source = inp.folder(spark, "stream")
    people = inp.customers(spark, sf)
    people.repartition(4).write.parquet(source)
    stream = spark.readStream.schema(people.schema).option("maxFilesPerTrigger", 1).parquet(source)
    rules = {"name": "full_name", "email": "email"}
    counted, _ = op.with_progress(stream, "customers", {"email": "email"}, preserve=KEEP_ADMIN)
    run = streaming.start_available(streaming.pseudonymize_stream(counted, rules), inp.folder(spark, "out"), inp.folder(spark, "checkpoint"))
    seen = op.StreamProgress().follow(run)["customers"]
    return spark.range(1).select(F.lit(seen["processed"]).alias("processed"), F.lit(seen["updated"]).alias("updated"))


@query
def write_table_resumed(spark, sf):
    """A table written in two runs, the first of which was stopped."""
    path = inp.folder(spark, "table")
    orders = inp.table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_custkey")
    src.write_table_resumed(orders.where("o_orderpriority < '3'"), path, "o_orderpriority", 1)
    src.write_table_resumed(orders, path, "o_orderpriority", 2)
    return spark.read.parquet(path)


# --- hard inputs ----------------------------------------------------------


def hard_statements(spark, sf):
    """Statements with comments over lines, a qualified name, nested calls, quotes and line ends
    in literals and a tail, one per order."""
    key, cust = F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")
    statement = F.concat(
        F.lit("/* order\n it's "),
        key,
        F.lit(" */\n-- don't\nINSERT IGNORE INTO `db`.`users` (`id`, `name`, `note`) VALUES\n(f(g("),
        key,
        F.lit(", ')'), h()), '"),
        F.col("o_orderpriority"),
        F.lit("'';\\nx', NULL),\n  ( "),
        cust,
        F.lit(' , "('),
        cust,
        F.lit(') \\", \\\\" , \'x;\' ) ON DUPLICATE KEY UPDATE name = VALUES(name)'),
    )
    return inp.table(spark, sf, "orders").select("o_orderkey", statement.alias("statement"))


@query
def rewrite_hard_dump(spark, sf):
    """Hard statements, one per order; every character of what comes out."""
    rules = {"users": {"name": "last_name"}}
    return src.pseudonymize_insert_dump(src.parse_inserts(hard_statements(spark, sf)), rules, keep=["o_orderkey"])


@query
def rewrite_dump_file(spark, sf):
    """The same statements written to files, where a ; at a line end stands in literals, and read back."""
    path = inp.folder(spark, "dump")
    src.write_insert_dump(hard_statements(spark, sf), path)
    return src.pseudonymize_insert_dump(src.read_insert_dump(spark, path), {"users": {"name": "last_name"}})


@query
def read_csv_multi_line(spark, sf):
    """Line breaks, blank lines, doubled quotes and delimiters in quotes; a record like the header is data."""
    path = inp.folder(spark, "csv")
    key = F.col("c_custkey").cast("string")
    record = F.concat(key, F.lit(';"first\n\n""'), key, F.lit('"";\nlast";'), F.col("c_mktsegment"))
    header = F.lit("id;note;segment")
    again = F.when(F.col("c_custkey") % 5 == 0, F.array(record, header)).otherwise(F.array(record))
    first = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0
    records = inp.table(spark, sf, "customer").select(F.explode(F.when(first, F.concat(F.array(header), again)).otherwise(again)).alias("value"))
    records.write.text(path)
    return src.read_csv_sniffed(spark, path, multi_line=True)


@query
def pseudonymize_json_spelt_keys(spark, sf):
    """Keys spelt with escapes, beside keys that only look like them."""
    doc = F.concat(F.lit('{"na\\u006de": "'), F.col("c_name"), F.lit('", "x\\u006de": "name", "a": [{"n\\u0061me" : "'), F.col("c_mktsegment"), F.lit('"}]}'))
    docs = inp.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), doc.alias("doc"))
    return op.pseudonymize_json_text(docs, "doc", {"name": "full_name"})


@query
def read_csv_by_hand(spark, sf):
    """A file whose lines are written by hand: doubled quotes, quotes behind backslashes,
    delimiters in quotes, empty cells, blanks."""
    path = inp.folder(spark, "csv")
    customers = inp.table(spark, sf, "customer")
    key = F.col("c_custkey").cast("string")
    line = F.concat(
        key,
        F.lit(';"say ""hi"", '),
        key,
        F.lit('; ok";;"a\\"b '),
        F.col("c_nationkey").cast("string"),
        F.lit('"; '),
        F.col("c_name"),
        F.lit(" ;"),
        F.when(F.col("c_custkey") % 3 == 0, "").otherwise(F.col("c_mktsegment")),
    )
    first = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0
    header = F.lit("id;note;blank;kept;name;last")
    lines = customers.select(F.explode(F.when(first, F.array(header, line)).otherwise(F.array(line))).alias("value"))
    lines.write.text(path)
    return src.read_csv_sniffed(spark, path)


@query
def dump_analysis(spark, sf):
    """Tables and columns of a dump with their verdicts and the number of statements."""
    path = inp.folder(spark, "dump")
    users = src.to_insert_statements(inp.customers(spark, sf).select("id", "name", "email", "city"), "users", 1)
    firms = src.to_insert_statements(inp.suppliers(spark, sf).select("id", "company"), "firms", 1)
    src.write_insert_dump(users.unionByName(firms), path)
    dump = src.read_insert_dump(spark, path)
    verdicts = op.detect_columns(src.dump_schema(dump))
    counts = dump.where("table IS NOT NULL").groupBy("table").agg(F.count(F.lit(1)).alias("statements"))
    return verdicts.join(counts, "table").select("table", "column", "detected", "type", "statements")


@query
def export_tables(spark, sf):
    """Exports with header of two tables: comment lines, and rows counted."""
    out = None
    for name in ("customer", "nation"):
        path = inp.folder(spark, "dump")
        src.export_table(inp.table(spark, sf, name), name, path)
        dump = src.read_insert_dump(spark, path)
        comments = dump.where("table IS NULL").select(F.explode(F.split("statement", "\n")).alias("line"))
        comments = comments.where(F.length("line") > 3)
        rows = src.dump_rows(dump).select(F.lit("row").alias("line"))
        one = comments.unionByName(rows).groupBy("line").agg(F.count(F.lit(1)).alias("n"))
        one = one.select(F.lit(name).alias("table"), "line", "n")
        out = one if out is None else out.unionByName(one)
    return out


@query
def rules_from_frame(spark, sf):
    """Confirmed rules read from a frame and applied."""
    rows = [
        ("people", "name", "full_name", "pseudonymize"),
        ("people", "city", "city", "keep"),
        ("people", "phone", "phone", "pseudonymize"),
    ]
    rules = op.rules_from_frame(spark.createDataFrame(rows, "table string, column string, type string, action string"))
    people = inp.customers(spark, sf).select("id", "name", "city", "phone")
    return op.pseudonymize_tables({"people": people}, rules)["people"]


@query
def session_tables(spark, sf):
    """The tables a session lists, with their counts."""
    tables = inp.all_tables(spark, sf)
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    listed = op.list_tables(spark).where(F.col("name").isin(list(tables)))
    counts = op.row_counts(tables).withColumnRenamed("table", "name")
    return listed.join(counts, "name").select("name", "row_count")


@query
def detect_own_pattern(spark, sf):
    """An own pattern under the name of a built-in type."""
    own = [Pattern("email", r"\w+ at home", 5, "email")]
    place = F.when(F.col("c_custkey") % 2 == 0, "at home").otherwise("at work")
    texts = inp.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"), F.concat_ws(" ", F.lit("x"), "c_mktsegment", place).alias("text")
    )
    found = fn.find_all(F.col("text"), own)
    verdict = fn.detect_value(F.col("text"), own)
    return texts.select("id", verdict.isNotNull().alias("found"), F.get(found, F.lit(0))["value"].alias("value"))


@query
def apply_mapping_repeated(spark, sf):
    """A mapping that holds two fakes for each original."""
    firms = {"suppliers": inp.suppliers(spark, sf)}
    rules = {"suppliers": {"city": "city"}}
    twice = op.build_mapping(firms, rules, seed="one").unionByName(op.build_mapping(firms, rules, seed="two"))
    return op.apply_mapping(inp.customers(spark, sf).select("id", "city"), twice, {"city": "city"})


@query
def apply_mapping_unique(spark, sf):
    """Unique fakes on columns of numbers and dates."""
    born = F.date_add(F.lit("1950-01-01").cast("date"), (F.col("id") % 9000).cast("int"))
    age = (F.col("id") % 63 + 18).cast("tinyint")  # as many ages as there are fakes
    people = inp.customers(spark, sf).select("id", age.alias("age"), born.alias("born"))
    rules = {"age": "age", "born": "birthdate"}
    mapping = op.build_mapping({"people": people}, {"people": rules}, unique=True)
    return op.apply_mapping(people, mapping, rules)


@query
def preserve_many_rules(spark, sf):
    """More rules than fit an expression each."""
    keep = fn.PreserveRules(tuple(f"{7 * i:09d}" for i in range(1, 1501)), mode="strict")
    people = inp.customers(spark, sf).select("id", "name")
    return op.pseudonymize_table(people, {"name": "full_name"}, preserve=keep)
