"""Document files as rows: binary files for fingerprints, text files as pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragassay.operators.ingest import fingerprint

PAGE_BREAK = "\f"


def read_documents(
    spark: SparkSession, path: str, pattern: str = "*.txt", page_break: str = PAGE_BREAK
) -> DataFrame:
    """UTF-8 text documents under a path: name, MD5 of the bytes, pages.

    A missing path raises when the read is planned.
    """
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", "true")
        .load(path)
    )
    pages = F.split(F.decode("content", "utf-8"), page_break)
    return fingerprint(files.select("path", "content", pages.alias("pages"))).select(
        "document_name",
        F.col("path").alias("file_path"),
        "md5_hash",
        F.size("pages").alias("total_pages"),
        "pages",
    )
