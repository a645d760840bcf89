"""Bronze ingest and sinks.

A bronze row is one raw NDJSON line plus four derived columns:
raw_json, resource_id, resource_type, _source_file, _ingested_at.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BRONZE_SCHEMA = T.StructType(
    [
        T.StructField("raw_json", T.StringType()),
        T.StructField("resource_id", T.StringType()),
        T.StructField("resource_type", T.StringType()),
        T.StructField("_source_file", T.StringType()),
        T.StructField("_ingested_at", T.TimestampType()),
    ]
)

RESOURCES = ["Organization", "Practitioner", "Patient", "Encounter", "Condition", "Observation", "Procedure", "Claim"]

MANIFEST_COLUMNS = ["resourceType", "resource_id", "anomaly_type", "detail"]


def with_bronze_columns(raw: DataFrame) -> DataFrame:
    """raw_json (+ _source_file, _ingested_at) -> the 5 bronze columns."""
    # json_tuple reads both top-level fields in one parse of the line
    return raw.select(
        F.col("raw_json"),
        F.json_tuple("raw_json", "id", "resourceType").alias("resource_id", "resource_type"),
        F.col("_source_file"),
        F.col("_ingested_at").cast("timestamp"),
    )


def read_ndjson(spark: SparkSession, path: str) -> DataFrame:
    """NDJSON text files -> bronze rows, one for each line, blank ones too.
    Splittable line reads; the JSON is kept as text and parsed later against a
    fixed schema."""
    raw = spark.read.text(path).select(
        F.col("value").alias("raw_json"),
        F.col("_metadata.file_path").alias("_source_file"),
        F.current_timestamp().alias("_ingested_at"),
    )
    return with_bronze_columns(raw)


def table_name(catalog_schema: str | None, resource: str) -> str:
    name = resource.lower()
    return f"{catalog_schema}.{name}" if catalog_schema else name


def write_table(df: DataFrame, name: str, fmt: str = "parquet", mode: str = "overwrite", merge_schema: bool = False, compression: str | None = None) -> None:
    """Overwrite (S3/S6) or append with additive schema evolution."""
    writer = df.write.format(fmt).mode(mode)
    if compression:
        writer = writer.option("compression", compression)
    if mode == "overwrite":
        writer = writer.option("overwriteSchema", "true")
    if merge_schema:
        writer = writer.option("mergeSchema", "true")
    writer.saveAsTable(name)


def append_evolving(spark: SparkSession, df: DataFrame, name: str, fmt: str = "parquet") -> None:
    """Append rows whose schema may add columns (S7): the table's schema is widened in the catalog, then the
    rows are appended. Files already written stay; their rows read null in the new columns."""
    if not spark.catalog.tableExists(name):
        write_table(df, name, fmt=fmt)
        return
    existing = spark.table(name)
    new = [f for f in df.schema.fields if f.name not in existing.columns]
    if new and fmt != "delta":
        spark.sql(f"ALTER TABLE {name} ADD COLUMNS ({', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in new)})")
    aligned = df.unionByName(existing.limit(0), allowMissingColumns=True).select(*existing.columns, *[f.name for f in new])
    write_table(aligned, name, fmt=fmt, mode="append", merge_schema=fmt == "delta")


def load_resources(spark: SparkSession, landing_dir: str, schema: str | None = None, fmt: str = "parquet") -> dict[str, int]:
    """Multi-resource load loop (S2): one bronze table for each resource file; rows by table (S14), which
    columnar files answer from their footers. The loads don't depend on each other and are submitted together."""
    if schema:
        spark.sql(f"CREATE SCHEMA IF NOT EXISTS {schema}")

    def load(resource: str) -> tuple[str, int]:
        target = table_name(schema, resource)
        # JSON lines are mostly names that repeat: zstd keeps them in a part of what snappy needs
        write_table(read_ndjson(spark, f"{landing_dir.rstrip('/')}/{resource}.ndjson"), target, fmt=fmt, compression="zstd")
        return target, spark.table(target).count()

    with ThreadPoolExecutor(max_workers=len(RESOURCES)) as pool:
        return dict(pool.map(load, RESOURCES))


def bronze_counts(bronze: dict[str, DataFrame]) -> DataFrame:
    """Rows per resource type over all bronze tables."""
    frames = [df.select("resource_type") for df in bronze.values()]
    unioned = frames[0]
    for f in frames[1:]:
        unioned = unioned.unionByName(f)
    return unioned.groupBy("resource_type").agg(F.count(F.lit(1)).alias("row_count"))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Anomaly manifest CSV, header row, all-string schema."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in MANIFEST_COLUMNS])
    return spark.read.option("header", True).schema(schema).csv(path)


def list_tables(spark: SparkSession, schema: str | None = None) -> DataFrame:
    """Tables of a schema ordered by name."""
    rows = [(t.name, t.database, t.tableType) for t in spark.catalog.listTables(schema) if not t.isTemporary]
    return spark.createDataFrame(rows, "table_name string, table_schema string, table_type string").orderBy("table_name")


def table_exists(spark: SparkSession, name: str) -> bool:
    """Existence probe."""
    return spark.catalog.tableExists(name)


def preview(df: DataFrame, order_by: list[str], n: int = 10) -> DataFrame:
    """Deterministic preview: a top-n by an explicit order."""
    return df.orderBy(*order_by).limit(n)
