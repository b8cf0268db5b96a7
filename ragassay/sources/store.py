"""Tables of a corpus folder: plain Parquet, partitioned by load.

``root/<table>/load=<id>`` holds the rows of one load and is written once. The small table
``root/versions``, partitioned by version, says which loads of which tables a version adds,
and which tables it starts anew; its rows are written last, so that what a failed job has
left is not seen. Readers join the loads of their version. Most loads only add rows.
Retiring a document adds its id to ``retired_documents`` instead of rewriting chunk files:
the flag is joined in when the tables are read. A folder has one writer at a time; a second
one that starts from the same version is refused.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragassay.schemas import TABLES

# tables whose rows follow the life of their document
OWNED_BY_DOCUMENT = ("documents", "document_topics", "document_chunks")
RETIRED = "retired_documents"

_VERSIONS = "table_name string, load string, starts_anew boolean, version int"


def versions(spark: SparkSession, root: str) -> DataFrame:
    """table_name, load, starts_anew, version: what each version has added."""
    try:
        return spark.read.schema(_VERSIONS).parquet(f"{root}/versions")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _VERSIONS)


def current_version(spark: SparkSession, root: str) -> int:
    """Newest completely written version; 0 for an empty folder."""
    return versions(spark, root).agg(F.max("version")).first()[0] or 0


def conform(df: DataFrame, table: str, by: str) -> DataFrame:
    """Columns of the table in order; audit columns are filled in."""
    filled = {
        "created_by": F.lit(by),
        "created_at": F.localtimestamp(),
        "updated_at": F.localtimestamp(),
        "is_deleted": F.lit(False),
    }
    have = set(df.columns)
    schema = df.sparkSession.createDataFrame([], TABLES[table]).schema
    columns = []
    for field in schema:
        value = F.col(field.name) if field.name in have else filled.get(field.name, F.lit(None))
        columns.append(value.cast(field.dataType).alias(field.name))
    return df.select(*columns)


def write_part(df: DataFrame, root: str, table: str, by: str, load: str | None = None) -> str:
    """Write rows as a load; it stays invisible until a version lists it.

    A load with a given name overwrites what an earlier try has left of it.
    """
    load = load or str(uuid.uuid4())
    conform(df, table, by).write.mode("overwrite").parquet(f"{root}/{table}/load={load}")
    return load


def read_part(spark: SparkSession, root: str, table: str, loads: DataFrame) -> DataFrame:
    """Rows of the given loads (column load) of a table."""
    rows = spark.read.schema(f"{TABLES[table]}, load string").parquet(f"{root}/{table}")
    return rows.join(loads.select("load"), "load", "left_semi").drop("load")


def _loads(spark: SparkSession, root: str, table: str, version: int) -> DataFrame:
    """Loads that make up a table as of a version."""
    mine = versions(spark, root).filter((F.col("table_name") == table) & (F.col("version") <= version))
    since = mine.filter("starts_anew").agg(F.max("version")).first()[0] or 0
    return mine.filter((F.col("version") >= since) & F.col("load").isNotNull()).select("load")


def read(
    spark: SparkSession, root: str, table: str, version: int | None = None, own_flag: bool = False
) -> DataFrame:
    """A table as of a version, by default the newest.

    ``own_flag`` skips the join with the retired ids. It is for readers that
    join the documents table anyway, where retired documents drop out.
    """
    at = current_version(spark, root) if version is None else version
    loads = _loads(spark, root, table, at)
    if loads.isEmpty():
        return spark.createDataFrame([], TABLES[table])
    rows = read_part(spark, root, table, loads)
    if own_flag or table not in OWNED_BY_DOCUMENT:
        return rows
    retired = _loads(spark, root, RETIRED, at)
    if retired.isEmpty():
        return rows
    gone = (
        read_part(spark, root, RETIRED, retired)
        .groupBy("doc_id")
        .agg(F.min("created_at").alias("_at"), F.min_by("created_by", "created_at").alias("_by"))
    )
    # a retired document was active until then, so only active rows change
    now = F.col("_at").isNotNull() & (F.col("is_deleted") == F.lit(False))
    return (
        rows.join(gone, "doc_id", "left")
        .withColumns(
            {
                "updated_by": F.when(now, F.col("_by")).otherwise(F.col("updated_by")),
                "updated_at": F.when(now, F.col("_at")).otherwise(F.col("updated_at")),
                "is_deleted": F.when(now, True).otherwise(F.col("is_deleted")),
            }
        )
        .select(*rows.columns)
    )


def compact(spark: SparkSession, root: str, by: str = "compaction") -> int:
    """Fold the retired ids into the rows of the tables they concern."""
    base = current_version(spark, root)
    parts = {
        table: [write_part(read(spark, root, table, base), root, table, by)]
        for table in OWNED_BY_DOCUMENT
    }
    return publish(spark, root, base, replace={**parts, RETIRED: []})


def publish(
    spark: SparkSession,
    root: str,
    base: int,
    append: dict[str, list[str]] | None = None,
    replace: dict[str, list[str]] | None = None,
) -> int:
    """Make written loads visible as the version after ``base``.

    Tables of ``replace`` start anew with the given loads, which may be none. Fails when
    somebody else published that version meanwhile.
    """
    added = [(table, load, False) for table, loads in (append or {}).items() for load in loads]
    anew = [(table, load, True) for table, loads in (replace or {}).items() for load in loads or [None]]
    version = base + 1
    if current_version(spark, root) >= version:
        raise FileExistsError(f"version {version} was published by somebody else")
    listed = spark.createDataFrame(added + anew or [(None, None, False)], _VERSIONS.rsplit(",", 1)[0])
    # a folder without rows is what a failed writer left
    listed.coalesce(1).write.mode("overwrite").parquet(f"{root}/versions/version={version}")
    return version
