"""Keyed tables: resume, upsert, delete, slices, appends and the text report."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from basketry.functions.text import display_price
from basketry.sources.storage import partitions, written

#: Tasks that write the rows of a bucket.
SHARES = 8


def read_csv_catalog(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A catalog CSV with a header; all columns are text, so no pass over the data infers types."""
    return spark.read.csv(path, header=True, schema=", ".join(f"`{c}` string" for c in columns), multiLine=True, escape='"')


def read_table_jdbc(spark: SparkSession, url: str, table: str, key: str, low: int, high: int, parts: int, **options: str) -> DataFrame:
    """A keyed table of a database, read in ``parts`` ranges of its key at once."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, partitionColumn=key, lowerBound=str(low), upperBound=str(high),
        numPartitions=str(parts), **options).load()


def first_rows(df: DataFrame, key: str, n: int) -> DataFrame:
    return df.orderBy(key).limit(n)


def row_range(df: DataFrame, key: str, start: int, count: int) -> DataFrame:
    """Rows ``start`` (from 0) to ``start + count`` in order of the key; rows with equal keys in any order among themselves.

    Only keys are counted: how many rows lie in each of the sorted key ranges says
    which ranges hold the slice, so no place ever holds the rows before it.
    """
    keys = df.select(F.col(key).alias("_key")).groupBy("_key").agg(F.count("*").alias("n"))
    ranged = written(keys.repartitionByRange("_key").withColumn("part", F.spark_partition_id()), "key-ranges")
    parts = ranged.groupBy("part").agg(F.sum("n").alias("n")).withColumn("base", F.sum("n").over(Window.orderBy("part")) - F.col("n"))
    open_ = ranged.join(F.broadcast(parts.where((F.col("base") < start + count) & (F.col("base") + F.col("n") > start)).select("part", "base")), "part")
    over = Window.partitionBy("part").orderBy("_key")
    before = open_.withColumn("_before", F.col("base") + F.sum("n").over(over) - F.col("n"))
    wanted = before.where((F.col("_before") < start + count) & (F.col("_before") + F.col("n") > start)).select("_key", "_before")
    rows = df.join(wanted, F.col(key).eqNullSafe(F.col("_key")))
    place = F.col("_before") + F.row_number().over(Window.partitionBy("_key").orderBy(F.lit(1))) - 1
    return rows.withColumn("_place", place).where(F.col("_place").between(start, start + count - 1)).select(*[f"`{c}`" for c in df.columns])


def not_done(df: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key the output table does not hold yet."""
    return df.join(done.select(key).distinct(), key, "left_anti")


def upsert(old: DataFrame, new: DataFrame, key: str | list[str], seq: str) -> DataFrame:
    """The table after ``new`` rows replaced those with their key; of several the one with the greatest ``seq``."""
    keys = [key] if isinstance(key, str) else key
    rows = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    last = Window.partitionBy(*keys).orderBy(F.desc("_new"), F.desc(seq))
    return rows.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n", "_new")


class KeyedTable:
    """A stored table with one row for each key, in buckets of keys; a merge rewrites the buckets that it touches and no other file.

    A version of the table is a small file that names the folder of each bucket.
    Readers see the last version that was committed, whole, whatever a merge has written so far; files
    of earlier versions stay until ``vacuum``. One driver merges at a time: a second
    one that began from the same version fails at its commit.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str, seq: str, buckets: int = 64):
        self.spark, self.path, self.schema, self.key, self.seq, self.buckets = spark, path, schema, key, seq, buckets

    def _versions(self) -> list[str]:
        files, name = _files(self.spark, self.path)
        folder = name(f"{self.path}/_versions")
        return sorted(n for n in (x.getPath().getName() for x in files.listStatus(folder)) if n[:1].isdigit()) if files.exists(folder) else []

    def _places(self, version: str | None = None) -> dict[int, str]:
        """The folder of each bucket that has rows."""
        versions = [version] if version else self._versions()
        if not versions:
            return {}
        text = self.spark.read.text(f"{self.path}/_versions/{versions[-1]}", wholetext=True).first().value
        return {int(bucket): folder for bucket, folder in json.loads(text).items()}

    def _read(self, places: dict[int, str], buckets: Iterable[int]) -> DataFrame:
        folders = sorted(f"{self.path}/{places[b]}" for b in buckets if b in places)
        return self.spark.read.schema(self.schema).parquet(*folders) if folders else self.spark.createDataFrame([], self.schema)

    def read(self) -> DataFrame:
        places = self._places()
        return self._read(places, places)

    def merge(self, new: DataFrame) -> set[int]:
        """Put ``new`` rows in place of those with their key, of several the one with the greatest ``seq``; the buckets that were rewritten."""
        begun = self._versions()
        places = self._places(begun[-1] if begun else None)
        bucket = F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")
        touched = {r[0] for r in new.select(bucket).distinct().collect()}  # numbers of buckets
        if not touched:
            return touched
        merged = upsert(self._read(places, touched), new, self.key, self.seq).withColumn("_bucket", bucket)
        folder = uuid.uuid4().hex
        share = F.pmod(F.xxhash64(F.lit("share"), self.key), F.lit(SHARES))  # a bucket is as many files, so that no task holds it whole
        merged.repartition(SHARES * partitions(self.spark), "_bucket", share).write.partitionBy("_bucket").parquet(f"{self.path}/{folder}")
        places |= {b: f"{folder}/_bucket={b}" for b in touched}
        files, name = _files(self.spark, self.path)
        files.mkdirs(name(f"{self.path}/_versions"))
        draft, version = name(f"{self.path}/_versions/_{folder}"), int(begun[-1]) + 1 if begun else 0
        out = files.create(draft, True)
        out.write(bytearray(json.dumps(places).encode()))
        out.close()
        place = name(f"{self.path}/_versions/{version:010d}")
        if files.exists(place) or not files.rename(draft, place):
            raise OSError(f"{self.path} has been merged into by another run")
        return touched

    def vacuum(self) -> None:
        """Delete the folders that the last version has no bucket in."""
        files, name = _files(self.spark, self.path)
        kept = {folder.split("/")[0] for folder in self._places().values()}
        for found in files.listStatus(name(self.path)):
            if not found.getPath().getName().startswith("_") and found.getPath().getName() not in kept:
                files.delete(found.getPath(), True)


def delete_keys(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return df.join(keys.select(key).distinct(), key, "left_anti")


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def _files(spark: SparkSession, path: str) -> tuple[Any, Callable[[str], Any]]:
    """The file system of a path, and how it names one."""
    name = spark._jvm.org.apache.hadoop.fs.Path
    return name(path).getFileSystem(spark._jsc.hadoopConfiguration()), name


def committed_batches(spark: SparkSession, path: str) -> dict[int, str]:
    """The numbers of the batches that a table of batches holds, with the folder of each."""
    files, name = _files(spark, path)
    if not files.exists(name(f"{path}/_commits")):
        return {}
    found = (x.getPath().getName().split("-", 1) for x in files.listStatus(name(f"{path}/_commits")) if x.getPath().getName()[:1].isdigit())
    return {int(number): folder for number, folder in found}


def append_batch(df: DataFrame, path: str, batch: int) -> bool:
    """Append ``df`` as batch number ``batch`` once; false if the table has that batch already, and then nothing is written.

    The rows go to a folder of their own, which becomes part of the table when a file that names it is
    renamed to the place of the batch's commit. A run that fails before leaves a folder that no reader sees, and is
    repeated under the same number. Batches are written one after the other by one driver.
    """
    spark = df.sparkSession
    if batch < 0:
        raise ValueError("batches are numbered from 0")
    if batch in committed_batches(spark, path):
        return False
    folder = uuid.uuid4().hex
    df.write.parquet(f"{path}/{folder}")
    files, name = _files(spark, path)
    files.mkdirs(name(f"{path}/_commits"))
    files.create(name(f"{path}/_commits/_{folder}"), True).close()
    if not files.rename(name(f"{path}/_commits/_{folder}"), name(f"{path}/_commits/{batch:010d}-{folder}")):
        raise OSError(f"batch {batch} of {path} could not be committed")
    return True


def read_batches(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of all committed batches, whole batches only."""
    folders = sorted(committed_batches(spark, path).values())
    if not folders:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{path}/{folder}" for folder in folders])


def report_lines(matches: DataFrame) -> DataFrame:
    """``(recipe_id, line_no, text)`` of a match report: a header for each recipe, a line for each of its items."""
    title: Column = F.format_string("=== %s ===", "title")
    heads = matches.select("recipe_id", title.alias("text"), F.lit("").alias("raw"), F.lit(0).alias("match_rank")).distinct()
    hit = F.format_string("%s -> [%s] %s | %s | %.2f", "raw", "store", "name", display_price("price", zero_is_missing=True), "score")
    items = matches.select("recipe_id", F.when(F.col("name").isNull(), F.concat("raw", F.lit(" -> No match found"))).otherwise(hit).alias("text"),
        "raw", F.coalesce("match_rank", F.lit(1)).alias("match_rank"))
    order = Window.partitionBy("recipe_id").orderBy("raw", "match_rank", "text")
    return heads.unionByName(items).select("recipe_id", (F.row_number().over(order) - 1).alias("line_no"), "text")


def write_report(matches: DataFrame, path: str) -> None:
    """The report as text files; a recipe's lines stay together and in order."""
    report_lines(matches).repartitionByRange("recipe_id").sortWithinPartitions("recipe_id", "line_no").select("text").write.text(path)


def split_report(found: DataFrame) -> DataFrame:
    """``(recipe_id, line_no, text)``: the report of ``found (recipe_id, title, line_id, line, part_no, n_parts, part, state, match_rank, brand, description, min_price, score)``.

    A header for each recipe, then its lines: the text with its matches below, or
    with ``No match found``. A line of several parts is headed ``[split]`` and has
    its matched parts indented below; if none matched it has no match. Skipped
    lines are left out, and so are skipped and unmatched parts.
    """
    place = "recipe_id", "line_id"
    titles = found.select("recipe_id", F.lit(None).cast(dict(found.dtypes)["line_id"]).alias("line_id"), F.lit(-1).alias("part_no"),
        F.lit(-3).alias("rank"), F.format_string("Recipe: %s", "title").alias("text")).distinct()
    order = Window.partitionBy("recipe_id").orderBy(F.asc_nulls_first("line_id"), "part_no", "rank")
    return titles.union(_said(found, *place)).select("recipe_id", (F.row_number().over(order) - 1).alias("line_no"), "text")


def _said(found: DataFrame, *place: str) -> DataFrame:
    """``(*place, part_no, rank, text)``: what a report says of each line, which ``place`` names."""
    text = F.col("line")
    single, hit = F.col("n_parts") == 1, F.col("state") == "matched"
    matched = F.max(hit.cast("int")).over(Window.partitionBy(*place)) == 1
    rows = found.withColumn("matched", matched).where(~((F.col("n_parts") <= 1) & (F.col("state") == "skipped")))
    own = F.when(single, F.col("part")).otherwise(text)
    tail = F.when(~single & F.col("matched"), "  [split]").otherwise("")
    head = F.concat(F.lit("Ingredient: "), own, tail)
    price = F.when(F.coalesce("min_price", F.lit(0.0)) == 0, "price N/A").otherwise(F.format_string("$%.2f", "min_price"))
    shown = F.concat(F.lit("-> ["), F.coalesce("brand", F.lit("")), F.lit("] "), "description", F.lit(" | "), price, F.lit(" | score: "),
        F.format_string("%.2f", "score"))
    heads = rows.select(*place, F.lit(-1).alias("part_no"), F.lit(-2).alias("rank"), head.alias("text")).distinct()
    none = rows.where(~F.col("matched")).select(*place, F.lit(-1).alias("part_no"), F.lit(-1).alias("rank"), F.lit("  No match found").alias("text")).distinct()
    parts = rows.where(~single & hit).select(*place, "part_no", F.lit(-1).alias("rank"), F.concat(F.lit("  Ingredient: "), "part").alias("text")).distinct()
    hits = rows.where(hit).select(*place, "part_no", F.col("match_rank").alias("rank"), F.concat(F.when(single, "  ").otherwise("    "), shown).alias("text"))
    return heads.union(none).union(parts).union(hits)


def split_report_of_texts(lines: DataFrame, found: DataFrame) -> DataFrame:
    """``split_report`` of ``lines (recipe_id, title, line_id, raw)``, with ``found`` (without recipe, title and line_id) of each text ``raw``.

    What a text has to say is put together once. Lines are dealt by recipe, and
    their places are sums of the numbers of text lines; texts come in after that.
    """
    said = F.array_sort(F.collect_list(F.struct("part_no", "rank", "text"))).alias("said")
    texts = written(_said(found, "raw").groupBy(F.col("raw").alias("known_raw")).agg(said), "report-texts")
    rows = lines.select("recipe_id", "title", "line_id", "raw").repartition("recipe_id").distinct()
    rows = rows.join(texts, F.col("raw").eqNullSafe(F.col("known_raw")), "left").withColumn("said", F.coalesce("said.text", F.array().cast("array<string>")))
    order = Window.partitionBy("recipe_id").orderBy(F.asc_nulls_first("line_id"))
    n = F.size("said")
    before = F.sum(n).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - n
    rows = rows.select("recipe_id", "title", "said", before.alias("before"), (F.row_number().over(order) == 1).alias("first"))
    title = F.when(F.col("first"), F.array(F.struct(F.lit(0).cast("long").alias("line_no"), F.format_string("Recipe: %s", "title").alias("text"))))
    own = F.transform("said", lambda x, i: F.struct((F.col("before") + i + 1).cast("long").alias("line_no"), x.alias("text")))
    shown = F.concat(F.coalesce(title, F.array().cast("array<struct<line_no:bigint,text:string>>")), own)
    return rows.select("recipe_id", F.explode(shown).alias("x")).select("recipe_id", "x.line_no", "x.text")
