"""Serving queries: offer and recipe search with stable pages, preference filter, nearby stores, chains."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.functions import lexicon as lx
from basketry.functions import text as tx
from basketry.functions.text import let


def contains_ci(x: Column | str, part: str) -> Column:
    """Substring test without case; ``%`` and ``_`` in ``part`` are ordinary characters."""
    return F.contains(F.lower(x), F.lit(part.lower()))


def price_compare(offers: DataFrame, term: str, limit: int = 50) -> DataFrame:
    """The cheapest offers of one taxonomy term, unpriced last."""
    return offers.where(F.col("taxonomy") == term).orderBy(F.asc_nulls_last("price"), "offer_id").limit(limit)


def offer_search(offers: DataFrame, text: str, store: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of the offers whose name or taxonomy holds ``text``; offer_id breaks ties, so pages never overlap."""
    rows = offers.where(contains_ci("name", text) | contains_ci("taxonomy", text))
    if store is not None:
        rows = rows.where(F.col("store") == store)
    return rows.orderBy(F.asc_nulls_last("price"), "offer_id").offset(offset).limit(limit)


def recipe_search(recipes: DataFrame, text: str, limit: int = 20, offset: int = 0) -> DataFrame:
    return recipes.where(contains_ci("title", text)).orderBy("recipe_id").offset(offset).limit(limit)


def food_phrases(spark: SparkSession, foods: Mapping[str, str] = lx.FOOD_PHRASES, not_foods: Mapping[str, str] = lx.NOT_FOOD_PHRASES) -> DataFrame:
    """``(phrase, food_group, exempt)``: the words of lexicons of comma-separated phrases."""
    rows = [(" ".join(p.split()), group, exempt) for lists, exempt in ((foods, False), (not_foods, True)) for group, text in lists.items() for p in text.split(",")]
    return spark.createDataFrame(rows, "phrase string, food_group string, exempt boolean")


def food_groups(texts: DataFrame, phrases: DataFrame) -> DataFrame:
    """``(text, food_group)`` of distinct ``texts (text)``: the groups of which a text holds a phrase, word for word.

    Words are singular and in lower case. A phrase does not count where it lies
    within an exempt one of its group: "coconut milk" is no dairy, "coconut milk and
    milk" is. Runs of words meet phrases by equality, so a text costs its words
    times the most words of a phrase, however many phrases there are.
    """
    most = phrases.agg(F.max(F.size(F.split("phrase", " ")))).first()[0] or 0
    words = F.filter(F.split(tx.normalize_catalog("text"), "[^\\p{L}\\p{N}]+"), lambda w: w != "")
    rows = texts.where("text is not null").select("text").distinct().withColumn("w", words).where(F.size("w") > 0)
    if not most:
        return rows.select("text", F.lit("").alias("food_group")).limit(0)
    starts = F.sequence(F.lit(0), F.size("w") - 1)
    sizes = F.array(*[F.lit(n) for n in range(1, most + 1)])
    runs = F.flatten(F.transform(starts, lambda i: F.transform(F.filter(sizes, lambda n: i + n <= F.size("w")), lambda n: F.struct(i.alias("begin"),
        (i + n).alias("end"), F.array_join(F.slice("w", i + 1, n), " ").alias("phrase")))))
    hits = rows.select("text", F.explode(runs).alias("r")).select("text", "r.*").join(phrases, "phrase")
    span = F.struct("begin", "end")
    lists = hits.groupBy("text", "food_group").agg(F.collect_list(F.when(~F.col("exempt"), span)).alias("said"), F.collect_list(F.when(F.col("exempt"), span)).alias("free"))
    counts = F.exists("said", lambda s: ~F.exists("free", lambda e: (e["begin"] <= s["begin"]) & (s["end"] <= e["end"])))
    return lists.where(counts).select("text", "food_group")


def preference_filter(recipes: DataFrame, items: DataFrame, preferences: DataFrame, phrases: DataFrame) -> DataFrame:
    """``(user_id, recipe_id)`` of ``recipes (user_id, recipe_id)`` without those that go against the user's ``preferences (user_id, diets, allergies)``.

    A recipe goes if one of its ``items (recipe_id, text)`` belongs to a food group
    that a diet of the user leaves out, or that the user is allergic to. Unknown
    names of diets and allergens ban nothing; users without preferences keep all.
    Each distinct ingredient text is looked at once.
    """

    def groups(column: str, table: Mapping[str, Sequence[str]]) -> Column:
        known = F.create_map(*[x for name, own in table.items() for x in (F.lit(name), F.array(*map(F.lit, own)))])
        named = F.transform(F.coalesce(column, F.array().cast("array<string>")), lambda d: F.coalesce(F.try_element_at(known, d), F.array().cast("array<string>")))
        return F.flatten(named)

    both = F.concat(groups("diets", lx.DIET_GROUPS), groups("allergies", lx.ALLERGEN_GROUPS))
    banned = preferences.select("user_id", F.explode(both).alias("food_group")).distinct()
    found = food_groups(items.select("text"), phrases)
    held = items.select("recipe_id", "text").distinct().join(found, "text").select("recipe_id", "food_group").distinct()
    hit = recipes.join(held, "recipe_id").join(banned, ["user_id", "food_group"]).select("user_id", "recipe_id").distinct()
    return recipes.select("user_id", "recipe_id").join(hit, ["user_id", "recipe_id"], "left_anti")


def user_preferences(preferences: DataFrame, user: int) -> DataFrame:
    """The user's preferences; of several rows the least, column by column."""
    return preferences.where(F.col("user_id") == user).orderBy(*preferences.columns).limit(1)


def match_lookup(matches: DataFrame, recipes: DataFrame | int) -> DataFrame:
    """The matches of one recipe, or of all in ``recipes (recipe_id)``, in order of line and rank, then of recipe."""
    found = matches.where(F.col("match_rank").isNotNull())
    one = isinstance(recipes, int)
    found = found.where(F.col("recipe_id") == recipes) if one else found.join(recipes.select("recipe_id").distinct(), "recipe_id", "left_semi")
    return found.orderBy("raw", "match_rank", "recipe_id")


def title_filter(rows: DataFrame, text: str) -> DataFrame:
    return rows.where(contains_ci("title", text)) if text else rows


def distance_miles(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance on a sphere of 6371.0088 km, in miles of 1609.34 m."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * 6371008.8 / 1609.34) * F.asin(F.sqrt(a))


def nearby_stores(stores: DataFrame, lat: float, lon: float, box: float = 0.2, limit: int = 50) -> DataFrame:
    """The nearest ``stores (store_id, chain, lat, lon)`` within the box. Stores are ranked before the limit; those without coordinates are left out."""
    near = stores.where(F.col("lat").between(lat - box, lat + box) & F.col("lon").between(lon - box, lon + box))
    miles = distance_miles(F.lit(lat), F.lit(lon), F.col("lat"), F.col("lon"))
    return near.withColumn("miles", miles).orderBy("miles", "store_id").limit(limit)


def chain_key(name: Column | str, aliases: Mapping[str, Sequence[str]] = lx.STORE_ALIASES) -> Column:
    """The chain a store's spelling belongs to, or null."""
    pairs = [F.lit(v) for key, names in aliases.items() for n in names for v in (n, key)]
    return let(F.create_map(*pairs), lambda m: F.try_element_at(m, F.col(name) if isinstance(name, str) else name))


def chain_counts(stores: DataFrame) -> DataFrame:
    return stores.groupBy("chain").agg(F.count("*").alias("stores"))
