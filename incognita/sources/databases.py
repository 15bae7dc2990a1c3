"""Database tables over JDBC: partitioned reads, whole-table writes."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# Default ports and the catalogue query of each database.
DEFAULT_PORTS = {"mysql": 3306, "pgsql": 5432}
TABLE_QUERIES = {
    "sqlite": "SELECT name FROM sqlite_master WHERE type='table' AND name NOT LIKE 'sqlite_%'",
    "mysql": "SELECT table_name AS name FROM information_schema.tables WHERE table_schema = DATABASE()",
    "pgsql": "SELECT tablename AS name FROM pg_tables WHERE schemaname = 'public'",
}
DRIVER_CLASSES = {
    "sqlite": "org.sqlite.JDBC",
    "mysql": "com.mysql.cj.jdbc.Driver",
    "pgsql": "org.postgresql.Driver",
}


@dataclass(frozen=True)
class Database:
    """Where a database is. The JDBC driver jar must be on Spark's class path."""

    driver: str = "sqlite"
    path: str = ":memory:"
    host: str = "localhost"
    port: int | None = None
    database: str = ""
    user: str | None = None
    password: str | None = field(default=None, repr=False)

    def __post_init__(self) -> None:
        if self.driver not in DRIVER_CLASSES:
            raise ValueError(f"unknown driver: {self.driver}")

    @property
    def url(self) -> str:
        if self.driver == "sqlite":
            return f"jdbc:sqlite:{self.path}"
        scheme = {"mysql": "mysql", "pgsql": "postgresql"}[self.driver]
        return f"jdbc:{scheme}://{self.host}:{self.port or DEFAULT_PORTS[self.driver]}/{self.database}"

    def options(self) -> dict[str, str]:
        out = {"url": self.url, "driver": DRIVER_CLASSES[self.driver]}
        if self.user is not None:
            out["user"] = self.user
        if self.password is not None:
            out["password"] = self.password
        return out


def read_table_jdbc(
    spark: SparkSession,
    db: Database,
    table: str,
    partition_column: str | None = None,
    partitions: int = 64,
    fetch_size: int = 10_000,
) -> DataFrame:
    """A table as a frame. With a numeric or date ``partition_column`` it is read in
    ``partitions`` ranges between the column's bounds (one aggregate the database
    answers); without one, in a single task."""
    reader = spark.read.format("jdbc").options(**db.options()).option("dbtable", table)
    reader = reader.option("fetchsize", fetch_size)
    if partition_column is None:
        return reader.load()
    c = F.col(partition_column)
    low, high = reader.load().agg(F.min(c), F.max(c)).first()
    if low is None:
        return reader.load()
    return (
        reader.option("partitionColumn", partition_column)
        .option("lowerBound", str(low))
        .option("upperBound", str(high))
        .option("numPartitions", partitions)
        .load()
    )


def list_tables_jdbc(spark: SparkSession, db: Database) -> DataFrame:
    reader = spark.read.format("jdbc").options(**db.options())
    return reader.option("query", TABLE_QUERIES[db.driver]).load().orderBy("name")


def write_table_jdbc(
    df: DataFrame, db: Database, table: str, batch_size: int = 1000, mode: str = "errorifexists"
) -> None:
    """Writes to a table of its own; rows are never updated in place."""
    writer = df.write.format("jdbc").options(**db.options()).option("dbtable", table)
    writer.option("batchsize", batch_size).mode(mode).save()


def write_table(
    df: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "errorifexists"
) -> None:
    """The replaced table as a new parquet table."""
    df.write.mode(mode).parquet(path, partitionBy=partition_by)


def count_rows(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("row_count"))


def fetch_batch(
    df: DataFrame, columns: list[str], key: str | list[str], offset: int, limit: int
) -> DataFrame:
    """One page in key order. Each page costs offset + limit rows; to walk a whole
    table use :func:`fetch_after`, or rather no pages at all."""
    keys = [key] if isinstance(key, str) else key
    return df.orderBy(*keys).offset(offset).limit(limit).select(*columns)


def fetch_after(df: DataFrame, columns: list[str], key: str, last: object, limit: int) -> DataFrame:
    """The page behind key value ``last``: a filter the scan can push down, and a
    top-k instead of a sort."""
    rest = df if last is None else df.where(F.col(key) > F.lit(last))
    return rest.orderBy(key).limit(limit).select(*columns)


@dataclass(frozen=True)
class PageIndex:
    """A table in key order with a directory of its parts."""

    spark: SparkSession
    path: str
    schema: StructType  # of the rows


def write_page_index(df: DataFrame, key: str | list[str], path: str, parts: int | None = None) -> PageIndex:
    """Writes ``df`` in key order, cut into range partitions, and a directory that says how many rows
    lie before each: one sort for any number of pages. Rows with equal keys are in any, but a fixed order."""
    spark = df.sparkSession
    keys = [key] if isinstance(key, str) else key
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    place = F.monotonically_increasing_id()
    ordered = df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    ordered = ordered.withColumn("__part", F.shiftright(place, 33).cast("int")).withColumn("__at", place.bitwiseAND(F.lit((1 << 33) - 1)))
    ordered.write.partitionBy("__part").parquet(f"{path}/rows")
    index = PageIndex(spark, path, ordered.schema)
    counts = spark.read.schema(index.schema).parquet(f"{path}/rows").groupBy("__part").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.orderBy("__part")) - F.col("n")  # one row a part
    counts.select("__part", "n", before.alias("before")).coalesce(1).write.parquet(f"{path}/directory")
    return index


def fetch_page(index: PageIndex, columns: list[str], page: int, size: int) -> DataFrame:
    """The rows page * size ... in key order, read from the parts that hold them and from no others."""
    low, high = page * size, page * size + size
    listed = index.spark.read.parquet(f"{index.path}/directory")
    found = listed.where((F.col("before") < high) & (F.col("before") + F.col("n") > low)).collect()
    rows = index.spark.read.schema(index.schema).parquet(f"{index.path}/rows")
    start = F.lit(None).cast("long")
    for r in found:
        start = F.when(F.col("__part") == r["__part"], r["before"]).otherwise(start)
    place = start + F.col("__at")
    kept = rows.where(F.col("__part").isin([r["__part"] for r in found])).where((place >= low) & (place < high))
    return kept.orderBy("__part", "__at").select(*columns)


def write_table_resumed(df: DataFrame, path: str, partition_by: str, at_once: int = 100) -> int:
    """Writes a table partition by partition value, ``at_once`` values a job, and notes finished ones in
    a manifest beside it; a run that was stopped goes on behind what is noted. A group of values that was
    half written is overwritten, so no row comes twice. Returns the number of values written now.

    The values of ``partition_by`` are collected: one for each folder of the table.
    """
    spark = df.sparkSession
    manifest = f"{path.rstrip('/')}_finished"
    name = F.col("`" + partition_by.replace("`", "``") + "`")
    values = {r[0] for r in df.select(name.cast("string")).distinct().collect()}
    try:
        done = {r["value"] for r in spark.read.schema("value string").parquet(manifest).collect()}
    except AnalysisException:  # nothing was finished yet
        done = set()
    waiting = sorted(values - done, key=lambda v: (v is None, v or ""))
    for i in range(0, len(waiting), at_once):
        group = waiting[i : i + at_once]
        text = name.cast("string")
        some = df.where(text.isin([v for v in group if v is not None]) | (text.isNull() if None in group else F.lit(False)))
        some.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition_by).parquet(path)
        spark.createDataFrame([(v,) for v in group], "value string").coalesce(1).write.mode("append").parquet(manifest)
    return len(waiting)
