import pytest
from pyspark.sql import functions as F

from basketry.functions import text as tx


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


LINES = {
    "2 cups flour, chopped": ("2 cups flour, chopped", "", "flour"),
    "1/2 cup (1 stick) unsalted butter, room temperature": ("1/2 cup (1 stick) unsalted butter, room temperature", "", "unsalted butter"),
    "garnish: lemon wheels": ("lemon wheels", "garnish fragment", "lemon"),
    "2 russet potatoes": ("2 russet potatoes", "cookware/container phrase", "russet potato"),
    "hot water": ("hot water", "non-ingredient fragment", "hot water"),
    "plus 2 tbsp. oil": ("", "empty", ""),
    "bourbon or aged rum": ("bourbon", "", "bourbon"),
    "1 round Italian loaf": ("1 round Italian loaf", "", "italian bread"),
    "Scotch bonnet pepper": ("Scotch bonnet pepper", "", "scotch bonnet pepper"),
    "1 oz. scotch": ("1 oz. scotch", "", "whiskey"),
    "masoor dal": ("masoor dal", "", "red lentils"),
    "large": ("large", "bare adjective fragment", ""),
}


def test_lines(spark):
    rows = spark.createDataFrame([(k,) for k in LINES], "l string").select("l", tx.preprocess("l"), tx.skip_reason("l"), tx.normalize_ingredient("l")).collect()
    assert {r[0]: tuple(r[1:]) for r in rows} == LINES


def test_null_and_empty(spark):
    rows = spark.createDataFrame([(None,), ("",), ("  \t ",)], "l string")
    for f, want in ((tx.preprocess, ""), (tx.skip_reason, "empty"), (tx.normalize_ingredient, ""), (tx.basic_clean, ""), (tx.display_key, "")):
        assert [r[0] for r in rows.select(f("l")).collect()] == [want] * 3
    assert [r[0] for r in rows.select(tx.split_alternatives("l")).collect()] == [[], [], []]


@pytest.mark.parametrize(("text", "want"), [("1.49;1.49;2.49", 1.49), ("", None), ("nan", None), ("0", None), ("$3.99", None), (None, None), ("x; 2 ;-1", 2.0)])
def test_min_price(spark, text, want):
    assert one(spark, tx.parse_min_price(F.lit(text).cast("string"))) == want


@pytest.mark.parametrize(("word", "want"), [("tomatoes", "tomato"), ("berries", "berry"), ("cookies", "cooky"), ("glass", "glass"), ("egg", "egg"),
    ("gas", "gas")])
def test_singular(spark, word, want):
    assert one(spark, tx.singularize(F.lit(word))) == want


def test_lists(spark):
    text = F.lit("['a (b', 'c) d', 'sharp cheddar', 'shredded', 'salt, divided', 'eggs', 'orange juice']")
    assert one(spark, tx.parse_list_string(text)) == ["a (b, c) d", "sharp cheddar, shredded", "salt, divided", "eggs, orange juice"]
    assert one(spark, tx.quoted_items(F.lit('["x", " y "]'))) == ["x", "y"]
    assert one(spark, tx.quoted_items(F.lit("[x, y]"))) == ["x", "y"]
    assert one(spark, tx.instruction_steps(F.lit("Mix. Bake! Eat?"))) == ["Mix", "Bake", "Eat"]
    assert one(spark, tx.split_alternatives(F.lit("chopped or sliced onions"))) == ["chopped", "sliced onions"]
    assert one(spark, tx.split_compound(F.lit("Kosher salt and black pepper"))) == ["Kosher salt", "black pepper"]


def test_small_ones(spark):
    assert one(spark, tx.search_keyword(F.lit("Kraft Shredded Mild Cheddar Cheese 8oz bag"))) == "mild cheddar cheese"
    assert one(spark, tx.display_price(F.lit(1.005))) in ("$1.00", "$1.01")
    assert one(spark, tx.display_price(F.lit(None).cast("double"))) == "Price N/A"
    assert one(spark, tx.to_price(F.lit("$1,003.99 /lb"))) == 1003.99
    assert one(spark, tx.dedupe_adjacent(F.array(*map(F.lit, "aaba")))) == ["a", "b", "a"]
    assert one(spark, tx.word_in("2%", F.lit("milk 2% fat")))
    assert not one(spark, tx.is_cookware(F.lit("2 russet potatoes"), whole_words=True))
