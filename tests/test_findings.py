"""What reviews of whole jobs and of larger tables have found."""

import threading

import pytest
from compare import SF, agrees
from pyspark.sql import functions as F

from basketry.operators import basket, blocking, search
from basketry.plans import QUERIES, SQL, fixtures
from basketry.sources import tables


def test_match_lookup_of_many_recipes(spark):
    """A thousandth of all recipes is looked up, not one."""
    want = spark.read.parquet(f"{SF}/lineitem.parquet").where("l_orderkey % 1000 = 7")
    assert want.select("l_orderkey").distinct().count() > 1
    assert agrees(spark, QUERIES["match_lookup"], SQL["match_lookup"]) == want.count()


def many_parts(spark, path):
    """200,000 parts of three names and two types, half of one size: over 10^10 pairs of rows, 24 of texts."""
    name = "element_at(array('red bolt', 'hot gear', 'old ring'), cast(id % 3 + 1 as int)) as p_name"
    spark.range(200_000).selectExpr("id as p_partkey", name, "if(id % 4 < 2, 'SMALL', 'PROMO') as p_type", "cast(if(id % 2 = 0, 1, id % 50) as int) as p_size").write.parquet(f"{path}/part.parquet")
    return str(path)


def within(spark, seconds, run):
    """The rows of a run, which is cancelled and fails if it takes longer."""
    spark.sparkContext.addJobTag("within")
    timer = threading.Timer(seconds, lambda: spark.sparkContext.cancelJobsWithTag("within"))
    timer.start()
    try:
        return run().collect()
    finally:
        timer.cancel()
        spark.sparkContext.removeJobTag("within")


def test_indel_ratio_of_many_parts(spark, tmp_path):
    rows = within(spark, 40, lambda: QUERIES["indel_ratio"](spark, many_parts(spark, tmp_path)))
    assert len(rows) == 18 and {r.ratio for r in rows if r.b.startswith(r.a)} == {72.73}


def test_partial_ratio_of_many_parts(spark, tmp_path):
    rows = within(spark, 40, lambda: QUERIES["partial_ratio"](spark, many_parts(spark, tmp_path)))
    assert len(rows) == 18 and {r.partial for r in rows if r.b.startswith(r.a)} == {100.0}


def test_search_index_holds_an_offer_once(spark, tmp_path):
    """The index has a row for each offer, however many letters it has, and no more runs of a gram than texts."""
    offers = spark.range(5000).selectExpr("id as offer_id", "concat('coloured garden gear ', id % 3) as name", "'PROMO' as taxonomy", "concat('s', id % 7) as store",
        "if(id % 10 = 0, null, double(id % 90)) as price")
    search.write_index(offers, str(tmp_path / "index"))
    stored = spark.read.option("recursiveFileLookup", "true").parquet(str(tmp_path / "index"))
    assert stored.count() < 5000 + 3 * 100
    found = search.search(spark, str(tmp_path / "index"), "gear 1", store="s2", limit=1000).collect()
    want = [(i, i % 90) for i in range(5000) if i % 3 == 1 and i % 7 == 2]
    assert [r.offer_id for r in found] == [i for i, p in sorted(want, key=lambda x: (x[0] % 10 == 0, x[1] if x[0] % 10 else 0, x[0]))]


def test_guard_counts_what_a_group_stands_for(spark):
    """A group of equal products counts as all of them, and is opened up to them last."""
    catalog = spark.createDataFrame([(i, "red bolt" if i < 15 else "red nut", i >= 15) for i in range(20)], "pos long, combined_text string, bad boolean")
    groups, members = blocking.text_groups(catalog, F.col("combined_text"), F.col("bad"))
    assert sorted((r.pos, r.n, int(r.pos_sum)) for r in groups.collect()) == [(0, 15, 105), (15, 5, 85)]
    pairs = groups.select(F.lit("red").alias("ing"), "pos", "bad", "n")
    for keep, want in ((15, range(15)), (16, range(20))):
        assert sorted(r.pos for r in blocking.opened(blocking.guard_categories(pairs, keep), members).collect()) == list(want)


def test_recipes_are_dealt_to_many_tasks(spark):
    """Recipes are sorted in several times as many tasks as there are shuffle partitions, and stay there for plans."""
    rows = spark.range(3000).selectExpr("id % 900 as recipe_id", "id as seq", "concat(id % 7, ' cups rice') as raw", "concat('s', id % 5) as store", "1.0D as price", "'n' as name")
    grouped = basket.group_matches(rows)
    least = 8 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert grouped.rdd.getNumPartitions() >= least and basket.value_plan(grouped).rdd.getNumPartitions() >= least
    items = grouped.select("recipe_id", F.lit("t").alias("title"), "item").distinct()
    none = items.select("recipe_id", "item").limit(0)
    assert basket.recipe_to_cart(items, grouped, none, none.withColumn("idx", F.lit(0))).rdd.getNumPartitions() >= least


def moves(df):
    """How often rows are shuffled in the plan of a result, broadcasts left out."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return sum(x.lstrip(" :+-*()0123456789").startswith("Exchange hashpartitioning") for x in plan.splitlines())


def test_cart_lines_move_once(spark):
    """The lines of recipes are shuffled once on their way to a cart, not once for each table that the cart is made of; chosen and excluded by tables or Columns it is the same cart."""
    assert moves(QUERIES["recipe_to_cart"](spark, SF)) == 1
    rows = spark.range(300).selectExpr("id % 40 as recipe_id", "id as seq", "concat(id % 7, ' cups ', if(id % 3 = 0, 'rice', 'oats')) as raw", "concat('s', id % 5) as store",
        "if(id % 11 = 0, null, double(id % 9)) as price", "concat('n', id) as name", "concat('t', id % 2) as title")
    grouped = basket.group_matches(rows)
    items = grouped.select("recipe_id", "title", "item").distinct().union(grouped.selectExpr("recipe_id", "title", "'salt'").distinct())
    excluded, idx = F.expr("recipe_id = 5 and item <> 'salt'"), F.length("item") % 4 - 1
    want = basket.recipe_to_cart(items, grouped, items.where(excluded), items.withColumn("idx", idx))
    got = basket.grouped_to_cart(grouped, ["salt"], excluded, idx)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.where("recipe_id = 5").count() == 1 < want.count()


def test_recipes_are_assigned_as_they_come_by(spark):
    """An item's match is that of the plan, also where recipes are too long for one task, and lines are shuffled once for both."""
    rows = spark.range(2000).selectExpr("if(id % 5 = 0, 7, id % 90) as recipe_id", "id as seq", "concat(id % 13, ' x', id % 17) as raw",
        "if(id % 19 = 0, null, concat('s', id % 23)) as store", "if(id % 11 = 0, null, double(id % 9)) as price", "concat('n', id) as name")
    grouped = basket.group_matches(rows).select("recipe_id", "item", "alt", "store", "price")
    plan = basket.fewest_stops(grouped)
    want = sorted(map(str, basket.plan_assignment(grouped, plan).collect()))
    for most in (0, 30, 100_000):
        assert sorted(map(str, basket.fewest_stops(grouped, most).collect())) == sorted(map(str, plan.collect()))
        assert sorted(map(str, basket.plan_assignment(grouped, most=most).collect())) == want
    assert len(want) == grouped.select("recipe_id", "item").distinct().count() and basket.plan_assignment(grouped.limit(0)).count() == 0
    assert moves(basket._by_recipe(basket.group_matches(fixtures.recipe_rows(spark, SF)), "recipe_id", "item", "store", "price")) == 1


def test_bucket_is_written_by_several_tasks(spark, tmp_path):
    stored = tables.KeyedTable(spark, str(tmp_path / "t"), "id long, v long", "id", "v", buckets=1)
    stored.merge(spark.range(1000).selectExpr("id", "id as v"))
    assert stored.read().count() == 1000 and len(stored.read().inputFiles()) > 1


def test_report_of_texts(spark):
    """What texts have to say is put together once, and gives the report that lines give."""
    text = "raw string, line string, part_no long, n_parts long, part string, state string, match_rank int, brand string, description string, min_price double, score double"
    rows = [("a or b", "a or b", 0, 2, "a", "matched", 1, "B", "aa", 1.5, 70.0), ("a or b", "a or b", 0, 2, "a", "matched", 2, "B", "ab", None, 69.0),
        ("a or b", "a or b", 1, 2, "b", "unmatched", None, None, None, None, None), ("c", "c", 0, 1, "c", "unmatched", None, None, None, None, None),
        ("d", "d", 0, 1, "d", "matched", 1, None, "dd", 0.0, 61.0), ("salt", "salt", 0, 1, "salt", "skipped", None, None, None, None, None),
        (None, "", None, 0, None, "skipped", None, None, None, None, None)]
    lines = [(i % 3, f"No. {i % 3}", f"l{i}", raw) for i, raw in enumerate(["a or b", "c", None, "d", "a or b", "salt", "c", "d"])] + [(9, "No. 9", "l9", "salt")]
    lines = spark.createDataFrame(lines, "recipe_id int, title string, line_id string, raw string")
    found = spark.createDataFrame(rows, text)
    want = tables.split_report(lines.join(found.withColumnRenamed("raw", "r"), F.col("raw").eqNullSafe(F.col("r"))).drop("raw", "r"))
    got = tables.split_report_of_texts(lines.union(lines), found)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() == 4 + 4 * 2 + 2 * 2 + 2 * 2


def test_pipeline_predicts_languages(spark):
    """The first stage goes by the prototypes of operator 1: what they give no language goes, whatever trigrams are known."""
    language = pytest.importorskip("basketry.llm.language")
    docs = spark.createDataFrame([(1, "the red river", "en"), (2, "the red maple", "en"), (3, "12 !", None)], "doc_id long, text string, lang string")
    seen, profiles = language.seen_trigrams(docs), language.learn_profiles(docs)
    assert sorted(r.doc_id for r in language.kept_rows(docs, profiles, seen, 0.0).collect()) == [1, 2]
    assert language.kept_rows(docs, language.learn_profiles(docs.limit(0)), seen, 0.0).count() == 0


def test_pipeline_goes_by_the_predicted_language(spark):
    """A text stays if labelled texts of the very language that operator 1 gives it hold its trigrams; what others hold does not count."""
    language = pytest.importorskip("basketry.llm.language")
    own = {"en": "alpha bravo charlie", "fr": "hotel juliett quebec", "de": "sierra uniform whiskey"}
    rows = [(10 * i + k, text, lang) for i, (lang, text) in enumerate(own.items()) for k in range(3)]
    mixed = "alpha bravo hotel juliett sierra uniform"
    docs = spark.createDataFrame([*rows, (90, mixed, None), (91, "charlie alpha", None), (92, "charlie alpha", "fr")], "doc_id long, text string, lang string")
    seen, profiles = language.seen_trigrams(docs), language.learn_profiles(docs)
    named = {r.doc_id: r.lang_pred for r in language.identify(docs, profiles).collect()}
    assert named[90] in own and named[91] == named[92] == "en"
    kept = sorted(r.doc_id for r in language.kept_rows(docs, profiles, seen, 0.5).collect())
    assert kept == [*(r[0] for r in rows), 91, 92]
    codes = set(seen.tables["de"][0])
    assert codes and not codes & set(seen.tables["en"][0])


def test_what_a_clear_ends_does_not_wait():
    """Of a thousand events of a part, only the latest clear and what follows it are written to the state, one call each; the rest changes nothing, late or repeated."""
    from test_baskets_pages import At, FakeHandle, events_of

    from basketry.streaming import cart

    part, handle = cart.CartPart(), FakeHandle()
    part.init(handle)
    rows = [(f"{i:04d}", i, i % 9, "clear" if i in (300, 990) else "add", float(i), "x") for i in range(1000)]
    out = list(part.handleInputRows((1, 0), events_of(*rows), At(0)))
    waiting = handle.maps["waiting"]
    assert len(out) == 9 and set(waiting.held) == {(f"{i:04d}",) for i in range(990, 1000)} and len(waiting.used) == 10
    assert list(part.handleInputRows((1, 0), events_of(*rows[:50], ("0500x", 500, 77, "add", 1.0, "late")), At(0))) == [] and len(waiting.used) == 10
    out = list(part.handleInputRows((1, 0), events_of(("1000", 1000, None, "clear", None, None)), At(0)))
    assert {(r["item"], r.quantity) for r in out} == {(i, 0) for i in range(9)} and set(waiting.held) == {("1000",)}
    assert list(part.handleExpiredTimer((1, 0), At(2000), None)) == []
    assert not waiting.held and not handle.maps["lines"].held and not handle.value.exists()


def test_tags_are_read_once():
    """Equal tags of a page and of others are read once, those remembered are bounded, and open elements are ended as before."""
    from basketry.functions import html as h

    one, two = h.Page('<ul><li class="c" id=a>x<li class="c" id=a>y</ul>'), h.Page('<li class="c" id=a>')
    assert [n.parent for n in one.nodes] == [-1, 0, 0] and one.nodes[1].attrs is one.nodes[2].attrs is two.nodes[0].attrs and two.nodes[0].attrs == {"class": "c", "id": "a"}
    long = h.Page("".join(f'<a id="{i}">' for i in range(h.TAGS + 50)) + f'<b title="{"x" * 1000}">')
    assert long.nodes[-1].attrs["title"] == "x" * 1000 and long.nodes[h.TAGS + 49].attrs == {"id": str(h.TAGS + 49)} and len(h._TAGS) <= h.TAGS
    drawn = h.Page("<svg><script/>var a;</script><path/></svg><p>t")
    assert [(n.tag, n.parent) for n in drawn.nodes] == [("svg", -1), ("script", 0), ("path", 0), ("p", -1)]


def test_equal_runs_are_read_once(monkeypatch):
    """A run of tags that comes again is not built again, and what is read is what the whole tree says: of ordinary pages, of broken ones, of dialogs that show cards."""
    import random

    from test_baskets_pages import PAGE

    from basketry.functions import html as h
    from basketry.operators import pages

    def whole(source):
        page = h.Page(source)
        return [(store, card, pages.dialog_details(page, dialog)) for store, card, dialog in pages.page_cards(page)]

    def shop(n, cards):
        card = '<li><a data-testid=item_list_item_{0}>x</a><div role=dialog aria-label="item details"><h2>N{0} &amp; Co</h2><span>${0}.5</span><img alt src="{0}.png"></div>'
        row = '<section data-testid="CrossRetailerResultRowWrapper"><h3> S{0}</h3><ul>{1}</ul></section>'
        return "<html>" + "".join(row.format(r, "".join(card.format(100 * n + 10 * r + i) for i in range(cards))) for r in range(3))

    pages._RUNS.forget()
    assert pages.page_items(shop(1, 4)) == whole(shop(1, 4)) and len(whole(shop(1, 4))) == 12
    want, built = [whole(shop(n, n)) for n in range(2, 9)], []
    monkeypatch.setattr(h, "Page", lambda source, made=h.Page: built.append(source) or made(source))
    assert [pages.page_items(shop(n, n)) for n in range(2, 9)] == want and not built
    assert want[0][1] == ("S0", "item_list_item_201", ("N201 & Co", "$201.5", "", "$201.5", "201.png", None, False))
    assert pages.page_items(PAGE) == whole(PAGE) and built
    rnd = random.Random(4)
    pieces = h._PIECES.split(PAGE) + h._PIECES.split(shop(9, 2)) + ["<SCRIPT x='>'>a&amp;<p></script >", "<title>&lt;</title>", "<!--", "<a 'b>", "<p tabindex=-1>"]
    for i in range(1500):
        source = list(pieces)
        for _ in range(rnd.randint(1, 5)):
            at = rnd.randrange(len(source))
            source[at : at + rnd.randint(0, 4)] = rnd.choices(pieces, k=rnd.randint(0, 3))
        source = "".join(source if i % 2 else rnd.choices(pieces, k=rnd.randint(5, 90)))
        assert [m[0] for m in h._TOKEN.finditer(source)] == h._PIECES.split(source)[1::2]
        assert pages.page_items(source) == whole(source)


def test_sources_of_pages_are_not_shuffled(spark):
    """Offers go to the task of their page, where its source is made and read; what was read is dealt once more to be told apart."""
    assert moves(QUERIES["page_cards"](spark, SF)) == 3
