"""Registered queries of sources, sinks and small serving reads, each with its checking SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.operators import basket, catalog, search, serving
from basketry.plans.fixtures import table
from basketry.plans.registry import register
from basketry.sources import tables
from basketry.sources.storage import new_path

_NAME = """concat(p_name, case when p_partkey % 3 = 0 then ', "best" of' else '' end, case when p_partkey % 5 = 0 then chr(10) || 'new' else '' end)"""


@register(f"""
    select p_partkey::varchar as "productId", {_NAME} as description, case when p_partkey % 4 = 0 then null else p_brand end as brand, p_retailprice::double as price
    from {{part}}""")
def csv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalog written as CSV, with quotes and line breaks in its texts, and scanned again."""
    name = F.expr(_NAME.replace("chr(10) || 'new'", "concat(char(10), 'new')"))
    rows = table(spark, sf_dir, "part").select(
        F.col("p_partkey").cast("string").alias("productId"), name.alias("description"), F.expr("if(p_partkey % 4 = 0, null, p_brand)").alias("brand"),
        F.col("p_retailprice").cast("double").cast("string").alias("price"),
    )
    path = new_path(spark, "catalog-csv")
    rows.write.csv(path, header=True, escape='"')
    return tables.read_csv_catalog(spark, path, rows.columns).withColumn("price", F.col("price").cast("double"))


@register("""
    select p_partkey::varchar as "productId", p_name as description, coalesce(case when p_size % 2 = 0 then p_brand end, '') as brand, p_type as categories,
           case when p_size % 3 = 0 then 'PRODUCE' else '' end as classifier, p_name as search_keyword, concat(p_size, '.5;', p_size, '.25') as price,
           concat('s', p_size % 7, ';s', p_size % 5) as store_ids, concat('00', p_partkey) as upc
    from {part}""")
def adapt_list_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("productId"), F.col("p_name").alias("name"), F.expr("if(p_size % 2 = 0, p_brand, null)").alias("brand"),
            F.col("p_type").alias("categories"),
        F.expr("if(p_size % 3 = 0, 'PRODUCE', null)").alias("classifier"), F.col("p_name").alias("search_keyword"),
            F.expr("concat(p_size, '.5;', p_size, '.25')").alias("price"),
        F.expr("concat('s', p_size % 7, ';s', p_size % 5)").alias("store_ids"), F.concat(F.lit("00"), "p_partkey").alias("upc"),
    )
    return catalog.adapt(source).drop("size", "image_url")


@register("select c_custkey, c_acctbal from {customer} order by c_custkey limit 40")
def first_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.first_rows(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), "c_custkey", 40)


@register("select o_orderkey, o_totalprice, 1 as batch from {orders} union all select o_orderkey, -o_totalprice, 2 from {orders} where o_orderkey % 2 = 0")
def append_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two batches of orders; the second comes twice, as after a lost answer, and counts once."""
    orders, path = table(spark, sf_dir, "orders"), new_path(spark, "appended")
    tables.append_batch(orders.select("o_orderkey", "o_totalprice", F.lit(1).alias("batch")), path, 1)
    second = orders.where("o_orderkey % 2 = 0").select("o_orderkey", (-F.col("o_totalprice")).alias("o_totalprice"), F.lit(2).alias("batch"))
    for _ in range(2):
        tables.append_batch(second, path, 2)
    return tables.read_batches(spark, path, "o_orderkey long, o_totalprice double, batch int")


_FOUND = """select offer_id, name, price from {{offers}} where ({0}) order by price asc nulls last, offer_id limit {1} offset {2}"""


@register(_FOUND.format("contains(lower(name), 'd gear') or contains(lower(taxonomy), 'd gear')", 40, 60).replace("{{", "{").replace("}}", "}"))
def search_next_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The offers after the first sixty that hold a text, from a stored index, by price and id of the last one seen."""
    path = new_path(spark, "search-index")
    search.write_index(table(spark, sf_dir, "offers"), path)
    seen = search.search(spark, path, "D Gear", limit=60).collect()[-1]
    return search.search(spark, path, "D Gear", limit=40, after=(seen.price, seen.offer_id)).select("offer_id", "name", "price")


@register(_FOUND.format("(contains(lower(name), 'ri') or contains(lower(taxonomy), 'ri')) and store = 'Supplier#000000003'", 1000, 0).replace("{{", "{").replace("}}", "}"))
def search_in_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The offers of one store that hold a text of two letters."""
    path = new_path(spark, "search-index")
    search.write_index(table(spark, sf_dir, "offers"), path)
    return search.search(spark, path, "RI", store="Supplier#000000003", limit=1000).select("offer_id", "name", "price")


@register("select user_id, diet, allergy from {preferences} where user_id = (select min(user_id) from {preferences} where diet = 'BUILDING')")
def user_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    preferences = table(spark, sf_dir, "preferences")
    user = preferences.where("diet = 'BUILDING'").agg(F.min("user_id")).first()[0]
    return serving.user_preferences(preferences.select("user_id", "diet", "allergy"), user)


@register("select recipe_id, title from (select distinct recipe_id, title from {recipe_matches}) where contains(lower(title), 'urgent')")
def title_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serving.title_filter(table(spark, sf_dir, "recipe_matches").select("recipe_id", "title").distinct(), "Urgent")


@register("select line_id, group_id, quantity from {cart_lines} where group_id is distinct from (select max(group_id) from {cart_lines})")
def drop_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "cart_lines").select("line_id", "group_id", "quantity")
    return basket.drop_group(lines, lines.agg(F.max("group_id")).first()[0])
