"""Product catalogs: four input formats to one schema, with the normalised texts that matching reads."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.functions import lexicon as lx
from basketry.functions import text as tx

REQUIRED = ("description", "categories", "classifier", "search_keyword", "brand", "productId")
TEXTS = ("description", "brand", "categories", "classifier", "search_keyword")
_FORMATS = (
    ("labels", {"name", "classifiers", "store_id"}),
    ("lists", {"name", "classifier", "store_ids", "upc"}),
    ("offers", {"taxonomy", "store", "name"}),
)


def detect_format(columns: list[str]) -> str:
    """``labels``, ``lists``, ``offers`` or ``plain``, by the columns present."""
    for name, needed in _FORMATS:
        if needed <= set(columns):
            return name
    return "plain"


def _text(name: str, have: set[str]):
    return F.coalesce(F.col(name).cast("string"), F.lit("")) if name in have else F.lit("")


def adapt_labels(df: DataFrame, table: Mapping[str, str] = lx.CLASSIFIER_CATEGORIES) -> DataFrame:
    """A catalog whose ``classifiers`` is a JSON array of labels: mapped ones become the categories, the first the classifier."""
    have = set(df.columns)
    labels = F.coalesce(F.from_json("classifiers", "array<string>"), F.array().cast("array<string>"))
    names = F.create_map(*[F.lit(v) for item in table.items() for v in item])
    known = F.filter(F.transform(labels, lambda x: F.try_element_at(names, x)), lambda x: x.isNotNull())
    return df.select(
        F.col("id").cast("string").alias("productId"), _text("name", have).alias("description"), _text("brand", have).alias("brand"),
        F.array_join(known, "; ").alias("categories"), F.coalesce(F.get(labels, F.lit(0)), F.lit("")).alias("classifier"),
            tx.search_keyword("name").alias("search_keyword"),
        _text("price", have).alias("price"), _text("size", have).alias("size"), _text("image", have).alias("image_url"),
            _text("store_id", have).alias("store_ids"),
    )


def adapt_lists(df: DataFrame) -> DataFrame:
    """A catalog with prices and stores as lists joined by ``;``."""
    have = set(df.columns)
    names = {"productId": "productId", "description": "name", "brand": "brand", "categories": "categories", "classifier": "classifier",
        "search_keyword": "search_keyword", "price": "price", "size": "size", "image_url": "image_url", "store_ids": "store_ids", "upc": "upc"}
    return df.select(*[_text(old, have).alias(new) for new, old in names.items()])


def adapt_offers(df: DataFrame) -> DataFrame:
    """Scraped offers: the store is the brand, the taxonomy term category, classifier and keyword."""
    have = set(df.columns)
    term, store = _text("taxonomy", have), _text("store", have)
    return df.select(
        _text("id", have).alias("productId"), _text("name", have).alias("description"), store.alias("brand"), term.alias("categories"),
            term.alias("classifier"), term.alias("search_keyword"),
        _text("price", have).alias("price"), F.col("price").try_cast("double").alias("min_price"), _text("quantity", have).alias("size"),
            _text("image_url", have).alias("image_url"), store.alias("store_ids"),
    )


def adapt(df: DataFrame) -> DataFrame:
    """Any of the formats to catalog columns; a plain catalog stays as it is."""
    return {"labels": adapt_labels, "lists": adapt_lists, "offers": adapt_offers, "plain": lambda x: x}[detect_format(df.columns)](df)


def fill_required(df: DataFrame) -> DataFrame:
    """Add missing text columns as empty and turn their nulls to empty."""
    have = set(df.columns)
    return df.withColumns({c: _text(c, have) for c in REQUIRED})


def normalized(df: DataFrame) -> DataFrame:
    """The catalog with ``<text>_norm`` columns and ``combined_text`` of all of them."""
    df = fill_required(df)
    df = df.withColumns({c: tx.fix_mojibake(c) for c in ("description", "brand", "categories", "search_keyword")})
    df = df.withColumns({f"{c}_norm": tx.normalize_catalog(c) for c in TEXTS})
    return df.withColumn("combined_text", tx.normalize_spaces(F.concat_ws(" ", *[f"{c}_norm" for c in TEXTS])))
