"""Where the operators keep tables that cut lineage, and keys for rows whose ids cannot tell them apart."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.sources.storage import new_path, partitions, shared_dir, written

__all__ = ["deleted", "keyed", "new_path", "partitions", "shared_dir", "written"]


def deleted(spark: SparkSession, path: str) -> None:
    """Delete a table of the shared folder that no result reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def keyed(docs: DataFrame, key: str) -> tuple[DataFrame, bool]:
    """``docs (doc_id, ...)`` with one more column, ``key``: a long of its own for every row; and whether that is the doc_id in all.

    It is the doc_id where that is neither null nor repeated. All other rows are
    written once with numbers above every doc_id, so that later reads agree on them.
    """
    own = F.col("doc_id").cast("long")
    counts = written(docs.where("doc_id is not null").groupBy(own.alias("repeated_id")).agg(F.count("*").alias("n")).where("n > 1").select("repeated_id"), "repeated-ids")
    some = docs.agg(F.max(own).alias("top"), F.sum(F.col("doc_id").isNull().cast("long")).alias("nulls")).first()
    if counts.isEmpty() and not some.nulls:
        return docs.withColumn(key, own), True
    again = docs.where("doc_id is not null").join(counts, own == F.col("repeated_id"), "left_semi")
    number = F.monotonically_increasing_id() + F.lit(max(0, some.top or 0) + 1)
    odd = written(docs.where("doc_id is null").union(again).withColumn(key, number), "odd-rows")
    return docs.where("doc_id is not null").join(counts, own == F.col("repeated_id"), "left_anti").withColumn(key, own).union(odd), False
