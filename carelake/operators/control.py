"""Control-data operators.

They work on tables of control payloads -- lineage API responses, request
specs, append-only run logs -- as DataFrame jobs: one ``from_json`` per
payload, arrays flattened in one projection, catalog membership by anti-join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from carelake.operators.dedup import latest_per_key
from carelake.sources.bronze import append_evolving

S = T.StringType()
_NB = T.ArrayType(T.StructType([T.StructField("notebook_id", S), T.StructField("url", S)]))
_PL = T.ArrayType(T.StructType([T.StructField("pipeline_id", S), T.StructField("pipeline_name", S)]))
_JB = T.ArrayType(T.StructType([T.StructField("job_id", S), T.StructField("job_name", S)]))
_FI = T.StructType([T.StructField("path", S), T.StructField("securable_type", S)])
_NODE = T.ArrayType(
    T.StructType(
        [T.StructField("notebookInfos", _NB), T.StructField("fileInfo", _FI), T.StructField("pipelineInfos", _PL),
         T.StructField("jobInfos", _JB)]
    )
)
LINEAGE_SCHEMA = T.StructType([T.StructField("upstreams", _NODE), T.StructField("downstreams", _NODE)])


def lineage_edges(payloads: DataFrame, table_col: str = "table_fqn", json_col: str = "payload") -> DataFrame:
    """Lineage payloads -> (table, role, kind, id, label) edges, where role
    is writer / source (upstream) or consumer (downstream)."""
    parsed = payloads.select(F.col(table_col).alias("table_fqn"), F.from_json(F.col(json_col), LINEAGE_SCHEMA).alias("j"))
    ends = F.array(
        F.struct(F.lit("writer").alias("role"), F.col("j.upstreams").alias("nodes")),
        F.struct(F.lit("consumer").alias("role"), F.col("j.downstreams").alias("nodes")),
    )
    nodes = parsed.select("table_fqn", F.inline(ends)).select("table_fqn", "role", F.explode("nodes").alias("node"))

    def things(role, kind: str, ids, labels):
        return F.struct(role.alias("role"), F.lit(kind).alias("kind"), ids.alias("ids"), labels.alias("labels"))

    role = F.col("role")
    # only an upstream file is an edge; its role is its own
    file = F.when(role == "writer", F.col("node.fileInfo"))
    kinds = F.array(
        things(role, "notebook", F.col("node.notebookInfos.notebook_id"), F.col("node.notebookInfos.url")),
        things(role, "pipeline", F.col("node.pipelineInfos.pipeline_id"), F.col("node.pipelineInfos.pipeline_name")),
        things(role, "job", F.col("node.jobInfos.job_id"), F.col("node.jobInfos.job_name")),
        things(F.lit("source"), "file", F.when(file.isNotNull(), F.array(file["path"])), F.when(file.isNotNull(), F.array(file["securable_type"]))),
    )
    listed = nodes.select("table_fqn", F.inline(kinds))
    return listed.select("table_fqn", "role", "kind", F.explode(F.arrays_zip("ids", "labels")).alias("e")).select(
        "table_fqn", "role", "kind", F.col("e.ids").alias("id"), F.col("e.labels").alias("label")
    )


def unique_writers(edges: DataFrame, kind: str = "notebook") -> DataFrame:
    """Distinct upstream writers of one kind."""
    return edges.where((F.col("role") == "writer") & (F.col("kind") == kind)).select("id").distinct()


SPEC_SCHEMA = "map<string,string>"


def spec_violations(
    specs: DataFrame,
    known_tables: DataFrame,
    required_keys: Sequence[str],
    target_prefix: str,
    id_col: str = "request_id",
    json_col: str = "spec",
) -> DataFrame:
    """Per request spec (JSON object): missing required keys, target
    outside the prefix, referenced source tables that do not exist, and a
    missing target without an open question about it. One row per finding."""
    s = specs.select(F.col(id_col).alias("request_id"), F.from_json(F.col(json_col), SPEC_SCHEMA).alias("m"))
    missing = s.select(
        "request_id",
        F.explode(F.array_compact(F.array(*[F.when(~F.map_contains_key("m", k), F.lit(k)) for k in required_keys]))).alias("detail"),
    ).withColumn("violation", F.lit("missing_key"))
    target = F.col("m")["target_table"]
    bad_target = s.where(target.isNotNull() & (target != "") & ~target.startswith(target_prefix)).select(
        "request_id", F.lit("target_prefix").alias("violation"), target.alias("detail")
    )
    questions = F.lower(F.coalesce(F.col("m")["open_questions"], F.lit("")))
    no_target = s.where((target.isNull() | (target == "")) & ~(questions.contains("target") | questions.contains("gold"))).select(
        "request_id", F.lit("target_missing_without_question").alias("violation"), F.lit(None).cast("string").alias("detail")
    )
    srcs = s.select(
        "request_id",
        F.explode(F.from_json(F.col("m")["bronze_sources"], T.ArrayType(S))).alias("source"),
    )
    unknown = srcs.join(known_tables.select(F.col("table_name").alias("source")), "source", "left_anti").select(
        "request_id", F.lit("unknown_source").alias("violation"), F.col("source").alias("detail")
    )
    cols = ["request_id", "violation", "detail"]
    return missing.select(*cols).unionByName(bad_target.select(*cols)).unionByName(no_target.select(*cols)).unionByName(unknown.select(*cols))


def latest_per_request(log: DataFrame, key: str = "request_id", ts: str = "processed_at", ties: Sequence[str] = ()) -> DataFrame:
    """The latest control row per request (set-wise, not orderBy().first()); rows of equal time by ``ties``, latest first."""
    return latest_per_key(log, [key], [ts, *ties])


def append_control_row(spark: SparkSession, table: str, row: dict, schema: T.StructType) -> None:
    """Append one typed row to a control log; new columns evolve the table."""
    df = spark.createDataFrame([tuple(row.get(f.name) for f in schema.fields)], schema)
    append_evolving(spark, df, table)
