"""Substring search over a stored index of letter grams, with pages that go on where the last one ended."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.sources.storage import partitions

#: Letters of a gram, runs that texts are dealt to, folders that runs are dealt to, and tasks that share a run.
GRAM, RUNS, PARTS, SHARES = 3, 4096, 64, 8


def _grams(text: Column) -> Column:
    """The distinct grams of one to three letters of a text in lower case."""
    starts = F.sequence(F.lit(1), F.length(text))
    every = F.flatten(F.transform(starts, lambda i: F.transform(F.array(*map(F.lit, range(1, GRAM + 1))), lambda n: F.substring(text, i, n))))
    return F.when(F.length(text) > 0, F.array_distinct(every)).otherwise(F.array().cast("array<string>"))


def write_index(offers: DataFrame, path: str) -> None:
    """Store ``offers (offer_id, name, taxonomy, store, price)`` for ``search`` under ``path``.

    Every offer is stored once, with all that a page shows. Offers of equal texts lie in one of ``RUNS`` runs,
    sorted, and runs in ``PARTS`` folders; a long run is spread over several files of its folder by its offers. Grams of up to three letters are taken
    from distinct texts alone, and each leads to the runs that hold it.
    """
    rows = offers.select("offer_id", "name", "taxonomy", "store", "price").withColumn("run", F.pmod(F.xxhash64("name", "taxonomy"), F.lit(RUNS)).cast("int"))
    rows = rows.repartition(partitions(offers.sparkSession), "run", F.pmod(F.xxhash64("offer_id"), F.lit(SHARES)))
    rows = rows.withColumn("part", F.col("run") % PARTS).sortWithinPartitions("part", "run", F.asc_nulls_last("price"), "offer_id")
    rows.write.mode("overwrite").partitionBy("part").parquet(f"{path}/offers")
    texts = _stored(offers.sparkSession, path).select("run", "name", "taxonomy").distinct()
    lower = [F.lower(F.coalesce(c, F.lit(""))) for c in ("name", "taxonomy")]
    grams = texts.select(F.explode(F.array_union(*map(_grams, lower))).alias("gram"), "run").distinct()
    grams.repartitionByRange("gram", "run").sortWithinPartitions("gram", "run").write.mode("overwrite").parquet(f"{path}/grams")


def _stored(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("offer_id long, name string, taxonomy string, store string, price double, run int, part int").parquet(f"{path}/offers")


def _in_runs(runs: list[int]) -> Column:
    """Does a row lie in one of the runs? Few of them are tested one by one: of a list of over ten, readers of Parquet look only at its least and greatest."""
    own = [F.col("run") == r for r in runs]
    if not 0 < len(own) <= 256:
        return F.col("run").isin(runs)
    while len(own) > 1:
        own = [reduce(Column.__or__, own[i : i + 2]) for i in range(0, len(own), 2)]
    return own[0]


def search(spark: SparkSession, path: str, text: str, store: str | None = None, limit: int = 50, after: tuple[float | None, int] | None = None) -> DataFrame:
    """A page of the stored offers whose name or taxonomy holds ``text`` without case, the cheapest first, unpriced last, then by offer_id.

    ``after`` is price and offer_id of the last row of the page before. The runs that
    hold all of the text's grams are read, and each of their offers is looked at in
    full; their folders and places in the sorted files are found by their statistics. An empty text is in every
    offer and has no gram: it is an error.
    """
    wanted = text.lower()
    if not wanted:
        raise ValueError("an empty text is in every offer")
    n = min(GRAM, len(wanted))
    grams = sorted({wanted[i : i + n] for i in range(len(wanted) - n + 1)})
    held = spark.read.schema("gram string, run int").parquet(f"{path}/grams").where(F.col("gram").isin(grams))
    runs = sorted(r.run for r in held.groupBy("run").agg(F.count("*").alias("n")).where(F.col("n") == len(grams)).collect())  # RUNS at most
    rows = _stored(spark, path).where(F.col("part").isNotNull() & F.col("part").isin(sorted({r % PARTS for r in runs})) & _in_runs(runs))
    rows = rows.where(F.contains(F.lower(F.coalesce("name", F.lit(""))), F.lit(wanted)) | F.contains(F.lower(F.coalesce("taxonomy", F.lit(""))), F.lit(wanted)))
    if store is not None:
        rows = rows.where(F.col("store") == store)
    if after is not None:
        price, offer = after
        same = (F.col("price") == F.lit(price)) if price is not None else F.col("price").isNull()
        later = same & (F.col("offer_id") > offer)
        rows = rows.where(later | (F.col("price") > price) | F.col("price").isNull() if price is not None else later)
    return rows.orderBy(F.asc_nulls_last("price"), "offer_id").limit(limit).select("offer_id", "name", "taxonomy", "store", "price")
