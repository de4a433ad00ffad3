"""Inputs of the registered queries, derived from the given tables by SQL that both engines read alike."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from basketry.operators.basket import tasks

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark",
    "labels", "conversations")

VIEWS = {
    "offers": """
        select l_partkey * 1000000 + l_suppkey as offer_id, p_name as name, p_brand as brand, p_type as taxonomy, s_name as store,
               case when l_partkey % 17 = 0 then null else floor(min(l_extendedprice / l_quantity) * 100 + 0.5) / 100 end as price,
               l_partkey % 11 = 0 as out_of_stock, l_partkey as part_id, l_suppkey as store_id
        from {lineitem} join {part} on l_partkey = p_partkey join {supplier} on l_suppkey = s_suppkey
        group by l_partkey, l_suppkey, p_name, p_brand, p_type, s_name""",
    "shopping_lines": """
        select concat(l_orderkey, '-', l_linenumber, '-', l_partkey, '-', l_suppkey) as line_id, l_orderkey as recipe_id, l_linenumber as line_no,
               case when l_partkey % 23 = 1 then 'divided' when l_partkey % 23 = 2 then 'hot water' when l_partkey % 23 = 3 then '1 baking dish'
                    when l_partkey % 23 = 4 then 'Kosher salt and black pepper' when l_partkey % 23 = 5 then concat('chopped or sliced ', p_name)
                    when l_partkey % 23 = 6 then concat(p_name, ', for serving') when l_partkey % 23 = 7 then concat('Garnish: ', p_name, ' wedges')
                    when l_linenumber % 4 = 0 then concat('2 cups ', p_name, ', chopped') when l_linenumber % 4 = 1 then concat('1 large ', p_name)
                    when l_linenumber % 4 = 2 then concat(p_name, ' or ', p_brand) else concat('1/2 lb. ', p_name, 's (optional)') end as raw
        from {lineitem} join {part} on l_partkey = p_partkey""",
    "catalog_source": """
        select p_partkey as pos, cast(p_partkey as string) as "productId", p_name as description, p_brand as brand, p_type as categories,
               case when p_size % 3 = 0 then 'PRODUCE' else p_type end as classifier,
               case when p_partkey % 9 = 0 then '' else concat(split_part(p_name, ' ', 2), ' ', p_brand) end as search_keyword,
               cast(floor(p_retailprice * 100 + 0.5) / 100 as double) as min_price
        from {part}""",
    "stores": """
        select s_suppkey as store_id, s_name as store, n_name as chain,
               case when s_suppkey % 13 = 0 then null else 33.5 + (s_suppkey * 37 % 100) / 100.0 end as lat,
               case when s_suppkey % 13 = 0 then null else -118.0 + (s_suppkey * 61 % 100) / 100.0 end as lon
        from {supplier} join {nation} on s_nationkey = n_nationkey""",
    "recipe_matches": """
        select o_orderkey as recipe_id, o_orderpriority as title,
               row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) as seq, concat(l_linenumber % 3 + 1, ' cups ', p_name) as raw,
               s_name as store, case when l_partkey % 17 = 0 then null else floor(l_extendedprice / l_quantity * 100 + 0.5) / 100 end as price,
               concat(p_name, ' ', p_brand) as name
        from {lineitem} join {orders} on l_orderkey = o_orderkey join {part} on l_partkey = p_partkey join {supplier} on l_suppkey = s_suppkey""",
    "cart_lines": """
        select concat(o_orderkey, '::', p_name, '-', l_partkey, '-', l_suppkey) as line_id, o_custkey as cart_id,
               case when o_orderkey % 5 = 0 then null when o_orderkey % 7 = 0 then '' else cast(o_orderkey as string) end as group_id,
               case when o_orderkey % 3 = 0 then null else o_orderpriority end as group_title,
               case when l_suppkey % 9 = 0 then '  ' when l_suppkey % 10 = 0 then null else concat(' ', s_name, ' ') end as store,
               floor(l_extendedprice / l_quantity * 100 + 0.5) / 100 as price, cast(l_quantity as int) as quantity
        from {lineitem} join {orders} on l_orderkey = o_orderkey join {part} on l_partkey = p_partkey join {supplier} on l_suppkey = s_suppkey""",
    "cards": """
        select part_id - part_id % 8 as page_id, store, concat('item_list_item_', offer_id) as card_id, store_id % 14 as carousel_page, offer_id as seq, part_id,
               offer_id, price, out_of_stock, name as bare_name,
               concat(name, ' & Co.', case when part_id % 5 = 0 then ' 12-count 8 oz' when part_id % 5 = 1 then ' 16 fl oz' else '' end) as name,
               case when part_id % 29 = 0 then null else concat(
                 case part_id % 3 when 0 then '<div role="dialog" class="dlg" aria-label="item details">'
                   when 1 then '<DIV class=dlg tabindex=0 aria-label="item details" Role=dialog>'
                   else '<section data-x="a>b" aria-label="item details" role="dialog">' end,
                 '<!-- <span>$0.01</span> --><script>var a = "<span>$0.02</span>";</script><header><h2 class="hd" id=n1><b>', name, '</b> &amp; Co.',
                 case when part_id % 5 = 0 then ' 12-count 8 oz' when part_id % 5 = 1 then ' 16 fl oz' else '' end, '</h2></header>',
                 case when out_of_stock then '<div><h2 class="oos x">Out <i>of</i> stock</h2></div>' else '' end,
                 case when price is null then '' else concat(
                   case when part_id % 2 = 0 then '<div class=d id="item_details"><p>Was <span>$0.03</span> <span>old</span><p>new</div>' else '' end,
                   '<div class="pr">', case when part_id % 2 = 0 then concat('<span class="sr">Current price: $', price, ' each</span>') else '' end,
                   '<span class="p" data-a="1">&#36;', price,
                   case offer_id % 3 when 0 then ' /lb</span> <em>or</em> <span class=u>per lb</span>' when 1 then '</span><span class="u">18&nbsp;ct</span>'
                     else '</span> <span>each</span>' end, '</div>') end,
                 '<img alt="logo" class="l" src="http://i/missing-item.png"',
                 case part_id % 4 when 0 then '>' when 1 then ' hidden/>'
                   else concat('><div class="a ic-image-zoomer b"><a href=#><img src="http://i/', part_id, '.png?a=1&amp;b=2" alt=""></a></div>') end,
                 '<div class="box" tabindex="-1"><ul><li>one<li>two</ul><div><h2><span>Details</span></h2></div><p class="t">About ', name,
                 ' &lt;new&gt;<br> line</p></div><p>After', case part_id % 3 when 2 then '</section>' else '</div>' end) end as dialog
        from {offers}""",
    "cart_events": """
        select user_id as cart_id, cast(regexp_extract(props, '([0-9]+)', 1) as bigint) as item, concat(cast(ts as string), '-', lpad(cast(event_id as string), 12, '0')) as seq,
               case event_type when 'purchase' then 'add' when 'view' then 'increment' when 'click' then 'decrement' when 'error' then 'remove' else 'clear' end as action,
               value as price, concat('item ', regexp_extract(props, '([0-9]+)', 1)) as name
        from {events}""",
    "preferences": """
        select c_custkey as user_id, c_mktsegment as diet, case c_custkey % 8 when 0 then 'anvil' when 1 then 'bolt' when 2 then 'gear' when 3 then 'gizmo' when 4 then 'plate' when 5 then 'ring' when 6 then 'rod' else 'widget' end as allergy
        from {customer}""",
}


def _needs(sql: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"\{(\w+)\}", sql)))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table or a view over them."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spark_sql(spark, sf_dir, VIEWS[name].replace('"productId"', "`productId`"))


def view_of(spark: SparkSession, name: str, **inputs: DataFrame) -> DataFrame:
    """A view over other rows of its inputs."""
    return spark.sql(VIEWS[name], **inputs)


def recipe_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the view ``recipe_matches``, joined to their recipe last: they lie by recipe, in the tasks of ``group_matches``, and need not move again."""
    price = F.expr("case when l_partkey % 17 = 0 then null else floor(l_extendedprice / l_quantity * 100 + 0.5) / 100 end").alias("price")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", price)
    named = lines.join(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand"), F.expr("l_partkey = p_partkey"))
    named = named.join(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), F.expr("l_suppkey = s_suppkey"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    rows = named.select(F.col("l_orderkey").alias("recipe_id"), "l_linenumber", "l_partkey", "l_suppkey", "price", "p_name", "p_brand", F.col("s_name").alias("store"))
    rows = rows.repartition(tasks(spark), "recipe_id").join(orders, F.expr("recipe_id = o_orderkey"))
    seq = F.row_number().over(Window.partitionBy("recipe_id").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    return rows.select("recipe_id", F.col("o_orderpriority").alias("title"), seq.alias("seq"), F.expr("concat(l_linenumber % 3 + 1, ' cups ', p_name)").alias("raw"), "store",
        "price", F.expr("concat(p_name, ' ', p_brand)").alias("name"))


def spark_sql(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Run SQL whose ``{names}`` are tables or views."""
    return spark.sql(sql, **{n: table(spark, sf_dir, n) for n in _needs(sql)})


def duck_sql(sql: str) -> str:
    """The same SQL for DuckDB, the views as common table expressions."""
    order: list[str] = []

    def visit(text: str) -> None:
        for n in _needs(text):
            if n in VIEWS and n not in order:
                visit(VIEWS[n])
                order.append(n)

    visit(sql)
    text = re.sub(r"\{(\w+)\}", r"\1", sql)
    views = ", ".join(f"{n} as ({re.sub(r'{(\w+)}', r'\1', VIEWS[n])})" for n in order)
    if not views:
        return text
    stripped = text.strip()
    return f"with {views}, {stripped[5:]}" if stripped.lower().startswith("with ") else f"with {views} {stripped}"
