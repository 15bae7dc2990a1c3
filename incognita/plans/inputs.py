"""Views over the given tables that the registered queries share.

The given tables hold few personal columns, so these select whole tables under
names the rules know and derive further columns from what is there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from incognita.operators.layout import spread
from incognita.session import shared_dir

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def table_stream(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A table as a stream of its files, whether it is one file or a folder of them. A pattern for a
    path gives both; a plain path must be a folder, a filter on names sees only the files in it."""
    schema = table(spark, sf, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf}/[{name[0]}]{name[1:]}.parquet")


def all_tables(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    return {name: table(spark, sf, name) for name in TABLES}


def folder(spark: SparkSession, purpose: str) -> str:
    return shared_dir(spark, purpose)


def documents(spark: SparkSession, sf: str) -> DataFrame:
    """Every document whole, on all cores."""
    return spread(table(spark, sf, "documents").select("doc_id", "text"))


def customers(spark: SparkSession, sf: str) -> DataFrame:
    """Every customer as a person: NULLs, empty strings, preserved words, repeated
    values and both date formats occur."""
    key = F.col("c_custkey")
    day = F.date_add(F.lit("1940-01-01").cast("date"), (key * 37 % 25_000).cast("int"))
    nation = F.col("c_nationkey")
    return table(spark, sf, "customer").select(
        key.alias("id"),
        F.col("c_name").alias("name"),
        F.when(key % 7 == 0, None)
        .when(key % 11 == 0, "admin@example.com")
        .otherwise(F.concat(F.lower(F.replace("c_name", F.lit("#"), F.lit("."))), F.lit("@mail.example.com")))
        .alias("email"),
        F.when(key % 5 == 0, "")
        .otherwise(F.concat(F.lit("+49 "), (nation + 100).cast("string"), F.lit(" "), (key + 100_000).cast("string")))
        .alias("phone"),
        F.when(key % 2 == 0, F.date_format(day, "yyyy-MM-dd"))
        .when(key % 13 == 0, "unknown")
        .otherwise(F.date_format(day, "dd.MM.yyyy"))
        .alias("birthdate"),
        F.concat(F.lit("City "), nation.cast("string")).alias("city"),
        F.lpad((key * 7919 % 99_999).cast("string"), 5, "0").alias("zip"),
        (F.lit(18) + key % 70).cast("int").alias("age"),
        F.col("c_mktsegment").alias("segment"),
        F.col("c_acctbal").alias("balance"),
    )


def suppliers(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers under names the rules know; cities occur among customers, too."""
    key = F.col("s_suppkey")
    return table(spark, sf, "supplier").select(
        key.alias("id"),
        F.col("s_name").alias("company"),
        F.concat(F.lit("City "), F.col("s_nationkey").cast("string")).alias("city"),
        F.concat(F.lit("Customer#"), F.lpad(key.cast("string"), 9, "0")).alias("name"),
    )


def enriched_text(spark: SparkSession, sf: str) -> DataFrame:
    """Whole orders as short texts that hold every kind of pattern, with overlaps,
    umlauts at word borders and line breaks."""
    key = F.col("o_orderkey")
    h = F.md5(key.cast("string"))
    text = F.concat_ws(
        "",
        F.lit("Bestellung vom "),
        F.date_format("o_orderdate", "dd.MM.yyyy"),
        F.lit(" bzw. "),
        F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"),
        F.lit(", ü"),
        F.lpad((key % 100_000).cast("string"), 5, "0"),
        F.lit(" Ort, Tel: +49 30-"),
        (key + 1_000_000).cast("string"),
        F.lit(" \n Kunde"),
        F.col("o_custkey").cast("string"),
        F.lit("@shop-"),
        (F.col("o_custkey") % 10).cast("string"),
        F.lit(".example.com von 10."),
        (key % 256).cast("string"),
        F.lit("."),
        (key % 300).cast("string"),
        F.lit(".7 https://www.example.com/o/"),
        key.cast("string"),
        F.lit("?a=1 IBAN DE89 3704 0044 0532 0130 00AB 12 "),
        F.substring(h, 1, 8),
        F.lit("-"),
        F.substring(h, 9, 4),
        F.lit("-4000-8000-"),
        F.substring(h, 13, 12),
        F.lit(" fe80:0:0:0:"),
        F.substring(h, 1, 4),
        F.lit(":0:0:1 ende"),
    )
    return spread(table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate")).select(
        key.alias("id"), text.alias("text")
    )


def nested_orders(spark: SparkSession, sf: str) -> DataFrame:
    """One nested document per order."""
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    email = F.when(key % 7 != 0, F.concat(F.lit("c"), cust.cast("string"), F.lit("@example.com")))
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    return spread(orders).select(
        F.struct(
            key.alias("id"),
            F.concat(F.lit("Name "), cust.cast("string")).alias("name"),
            email.alias("email"),
            F.struct(
                F.concat(F.lit("Weg "), (cust % 90).cast("string")).alias("street"),
                (cust % 90_000 + 10_000).alias("zip"),
            ).alias("address"),
            (key % 2 == 0).alias("login"),
        ).alias("customer"),
        F.array(
            F.struct(F.col("o_orderstatus").alias("status"), (cust + 1).cast("string").alias("phone")),
            F.struct(F.col("o_orderpriority").alias("status"), (cust + 2).cast("string").alias("phone")),
        ).alias("contacts"),
        F.array(F.col("o_orderpriority"), F.lit("x")).alias("mail"),
        F.concat(F.lit("Firma "), (cust % 50).cast("string")).alias("company"),
        key.alias("order_id"),
    )


def named_cells(spark: SparkSession, sf: str) -> DataFrame:
    """(key, table, column): a label pair per customer, spelled in many ways."""
    tables = ["Users", "customers", "orders", "Accounts", "clients", "misc", "LEADS"]
    columns = [
        "First Name",
        "E-Mail",
        "PLZ",
        "c_name",
        "Tax-ID",
        "geburtsdatum",
        "age",
        "Alter",
        "IP Address",
        "customer_id",
        "konto",
    ]

    def choose(words: list[str], n: Column) -> Column:
        return F.element_at(F.array(*[F.lit(w) for w in words]), (n % len(words) + 1).cast("int"))

    return table(spark, sf, "customer").select(
        F.col("c_custkey").alias("key"),
        choose(tables, F.col("c_nationkey")).alias("table"),
        choose(columns, F.col("c_custkey")).alias("column"),
    )
