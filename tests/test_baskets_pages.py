import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from basketry.functions import html as h
from basketry.operators import basket, pages, search, serving
from basketry.sources import tables
from basketry.streaming import cart


def test_fewest_stops_ties(spark):
    rows = [(1, 1, "a", "B", 1.0), (1, 2, "b", "B", 5.0), (1, 3, "a", "A", 2.0), (1, 4, "b", "A", 3.0), (1, 5, "c", "C", 1.0), (2, 1, "x", "Z", 1.0),
        (2, 2, "x", "Y", 1.0), (3, 1, "q", "S", None)]
    grouped = basket.group_matches(spark.createDataFrame(rows, "recipe_id int, seq int, raw string, store string, price double"))
    plan = {(r.recipe_id, r.stop): r.store for r in basket.fewest_stops(grouped).collect()}
    assert plan == {(1, 1): "A", (1, 2): "C", (2, 1): "Y", (3, 1): "S"}
    chosen = {(r.recipe_id, r["item"]): r.store for r in basket.plan_assignment(grouped, basket.fewest_stops(grouped)).collect()}
    assert chosen[1, "a"] == "A" and chosen[1, "c"] == "C" and chosen[2, "x"] == "Y"


EVENTS = [(1, "add", 2.0), (2, "add", 9.0), (3, "decrement", 0.0), (4, "decrement", 0.0), (5, "decrement", 0.0), (6, "add", 3.0),
    (7, "increment", 0.0), (8, "remove", 0.0), (9, "increment", 0.0), (10, "add", 4.0)]


@pytest.mark.parametrize("n", range(1, len(EVENTS) + 1))
def test_cart_fold_agrees_with_stream_step(spark, n):
    state = (0, None, None)
    for _, action, price in EVENTS[:n]:
        state = cart.fold_line(state, action, price, "i")
    if n in (1, 3, 4, 7, 10):
        rows = spark.createDataFrame([(1, 1, f"{s:03d}", a, p, "i") for s, a, p in EVENTS[:n]],
            "cart_id long, item long, seq string, action string, price double, name string")
        got = [(r.quantity, r.price, r.name) for r in basket.cart_fold(rows).collect()]
        assert got == ([state] if state[0] else [])


def fold_plainly(events):
    lines = {}
    for cart_id, item, _, action, price, name in sorted(events, key=lambda e: e[2]):
        if action == "clear":
            lines = {k: v for k, v in lines.items() if k[0] != cart_id}
        else:
            lines[cart_id, item] = cart.fold_line(lines.get((cart_id, item), (0, None, None)), action, price, name)
    return sorted(((*k, *v) for k, v in lines.items() if v[0] > 0), key=repr)


@pytest.mark.parametrize("records", [3, 64, 10_000])
def test_long_lines_are_folded_in_slices(spark, records):
    """A line of many thousand events, short ones beside it, null items, prices and unknown actions; few lines come in more than one row of a slice."""
    rnd = random.Random(records)
    actions = ["add"] * 5 + ["increment"] * 4 + ["decrement"] * 10 + ["other"]
    many = 20_000 if records > 3 else 900
    events = [(1, 7, f"{i:09d}", rnd.choice(actions) if i % 4000 > 2500 else rnd.choice(actions[:9]), rnd.choice([None, 1.5, float(i)]), rnd.choice([None, f"n{i}"]))
        for i in range(many)]
    for i in range(1500):
        events.append((rnd.randrange(4), rnd.choice([None, 1, 2, 3]), f"{i * 3:09d}x", rnd.choice([*actions, "remove"] if i % 50 else ["clear"]), float(i), f"m{i}"))
    rnd.shuffle(events)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", records)
    try:
        table = spark.createDataFrame(events, "cart_id long, item long, seq string, action string, price double, name string").repartition(5)
        got = sorted(map(tuple, basket.cart_fold(table).collect()), key=repr)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == fold_plainly(events) and len(got) > 3


def test_runs_join_in_any_grouping():
    rnd = random.Random(1)
    for _ in range(300):
        actions = rnd.choices(["add", "increment", "decrement", "decrement", "remove"], weights=[4, 3, 5, 5, 0.3], k=rnd.randrange(1, 12))
        each = basket.Effects.of(pa.array(actions))
        whole = each.runs(np.arange(len(actions)) == 0)
        left = each.at(np.array([0]))
        for i in range(1, len(actions)):
            left = left.then(each.at(np.array([i])))
        for quantity in range(14):
            state = (quantity, -5, None) if quantity else (0, None, None)
            for i, action in enumerate(actions):
                state = cart.fold_line(state, action, i, None)
            for f in (whole, left):
                lives = quantity and quantity >= f.least[0]
                assert state[:2] == ((quantity + f.more[0], -5) if lives else (f.left[0], f.source[0] if f.left[0] else None))


def test_cart_clear(spark):
    rows = spark.createDataFrame([(1, 1, "1", "add", 1.0, "a"), (1, 2, "2", "clear", 0.0, ""), (1, 3, "3", "add", 2.0, "c")],
        "cart_id long, item long, seq string, action string, price double, name string")
    assert [r["item"] for r in basket.cart_fold(rows).collect()] == [3]


def test_plans_at_once_and_in_rounds(spark):
    """The same plan whichever way a recipe is planned."""
    import random

    rnd = random.Random(5)
    rows = [(r, i, f"i{i % 9}", f"S{rnd.randrange(6)}", rnd.choice([None, 1.0, 2.5, 3.25])) for r in range(12) for i in range(rnd.randint(1, 30))]
    grouped = basket.group_matches(spark.createDataFrame(rows, "recipe_id int, seq int, raw string, store string, price double"))
    plans = [sorted(map(tuple, basket.fewest_stops(grouped, most).collect())) for most in (0, 12, 100_000)]
    assert plans[0] == plans[1] == plans[2] and len(plans[0]) > 24
    assert basket.fewest_stops(grouped.limit(0)).count() == 0


def test_cart_stream_in_any_order(spark, tmp_path):
    """Files that arrive out of order and twice give what the batch fold gives."""
    import random

    rnd = random.Random(7)
    actions = ["add", "add", "add", "increment", "decrement", "remove", "clear"]
    rows = [(1_700_000_000 + 10 * i, rnd.randrange(3), rnd.choice([1, 2, 3, None]), f"{i:05d}", rnd.choice(actions), float(i), f"n{i}") for i in range(400)]
    schema = "t long, cart_id long, item long, seq string, action string, price double, name string"
    frame = spark.createDataFrame(rows, schema)
    want = sorted(map(tuple, basket.cart_fold(frame.drop("t")).collect()), key=repr)
    shuffled = [rows[i : i + 80] for i in range(0, 400, 80)]
    for i, part in enumerate(shuffled):
        late = part[:60] + (shuffled[i - 1][60:] if i else []) + part[10:20]  # the last of a file come with the next, some come twice
        late += shuffled[i][60:] if i == 4 else []
        rnd.shuffle(late)
        spark.createDataFrame(late, schema).coalesce(1).write.parquet(str(tmp_path / f"in{i}"))
    import shutil

    (tmp_path / "all").mkdir()
    for i in range(5):
        (one,) = (tmp_path / f"in{i}").glob("*.parquet")
        shutil.copy(one, tmp_path / "all" / f"{i}.parquet")
        import os

        os.utime(tmp_path / "all" / f"{i}.parquet", (1_000_000 + i, 1_000_000 + i))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "all")).withColumn("ts", F.timestamp_seconds("t"))
    got = sorted(map(tuple, cart.run_to_table(spark, stream, "30 minutes").collect()), key=repr)
    assert got == want and len(want) > 2


class FakeMap:
    """A map state that says which keys were read and written."""

    def __init__(self):
        self.held, self.used = {}, []

    def getValue(self, key):
        self.used.append(key)
        return self.held.get(key)

    def containsKey(self, key):
        return key in self.held

    def updateValue(self, key, value):
        self.used.append(key)
        self.held[key] = value

    def removeKey(self, key):
        self.used.append(key)
        self.held.pop(key, None)

    def iterator(self):
        return iter(list(self.held.items()))

    def keys(self):
        return iter(list(self.held))

    def clear(self):
        self.held.clear()


class FakeValue:
    value = None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def clear(self):
        self.value = None


class FakeHandle:
    def __init__(self):
        self.maps, self.value, self.timers = {}, FakeValue(), set()

    def getMapState(self, name, *_):
        return self.maps.setdefault(name, FakeMap())

    def getValueState(self, *_):
        return self.value

    def listTimers(self):
        return iter(self.timers)

    def registerTimer(self, at):
        self.timers.add(at)


class At:
    def __init__(self, mark):
        self.mark = mark

    def getCurrentWatermarkInMs(self):
        return self.mark


def events_of(*rows):
    return iter([Row(seq=s, at=at, item=i, action=a, price=p, name=n) for s, at, i, a, p, n in rows])


def test_state_is_forgotten():
    """Waiting events are folded for good behind the watermark, and an empty part of a cart keeps no state."""
    part, handle = cart.CartPart(), FakeHandle()
    part.init(handle)
    out = list(part.handleInputRows((1, 0), events_of(("1", 10, 5, "add", 2.0, "x"), ("2", 20, 5, "remove", None, None)), At(0)))
    assert out == [] and handle.timers == {21} and len(handle.maps["waiting"].held) == 2
    assert list(part.handleExpiredTimer((1, 0), At(50), None)) == []
    assert not handle.maps["waiting"].held and not handle.maps["lines"].held and not handle.value.exists()


def test_state_is_read_and_written_by_touched_line():
    part, handle = cart.CartPart(), FakeHandle()
    part.init(handle)
    many = [(f"{i:03d}", i, i, "add", float(i), "x") for i in range(100)]
    assert len(list(part.handleInputRows((1, 0), events_of(*many), At(1000)))) == 100
    lines = handle.maps["lines"]
    assert len(lines.held) == 100 and not handle.maps["waiting"].held
    lines.used.clear()
    out = list(part.handleInputRows((1, 0), events_of(("200", 200, 7, "increment", None, None), ("050", 50, 8, "add", 1.0, "late")), At(1000)))
    assert [(r["item"], r.quantity, r.price) for r in out] == [(7, 2, 7.0)] and set(lines.used) == {("7",)}
    out = list(part.handleInputRows((1, 0), events_of(("300", 300, None, "clear", None, None), ("301", 2000, 9, "add", 5.0, "y")), At(1000)))
    assert {(r["item"], r.quantity) for r in out} == {(i, 1 if i == 9 else 0) for i in range(100)} and not lines.held
    assert handle.timers == {2001}


CASES = [("$1.99 /lb", "per lb", "x", ("lb", None)), ("$3.99", "18 ct", "x", (None, "18 ct")), ("$9.07", "each", "x", (None, None)),
    ("$9.07", "each", "soda 12-count 8 oz", (None, "12-count")), ("$2", "", "milk 16 fl oz", (None, "16 fl oz")),
    ("$2 /3 lb", "", "x", (None, "3 lb")), ("$2 /foo", "", "x", (None, None)), ("$2", "per oz", "x", ("oz", None))]


def test_unit_or_quantity(spark):
    rows = spark.createDataFrame([(p, u, n) for p, u, n, _ in CASES], "p string, u string, n string")
    got = rows.select(pages.unit_or_quantity(F.col("p"), F.col("u"), F.col("n")).alias("s")).select("s.*").collect()
    assert [tuple(r) for r in got] == [c[3] for c in CASES]


PAGE = """<!DOCTYPE html><html><head><title>Milk &lt; cream</title><style>h2 { color: red }</style></head>
<body class=shop><nav><a data-testid="item_list_item_77">no row around it</a></nav>
<div class="row" data-testid='CrossRetailerResultRowWrapper' hidden><img src="logo.png">
  <div><b> Best <i>Foods</i></b></div>Delivery by 5
  <ul><li data-x="1>0"><a data-testid=item_list_item_1 href="/a?b=1&amp;c=2">Whole milk</a>
  <div aria-label="item details" class='d' role="dialog"><h2 class=n>Whole&nbsp;<b>milk</b> &amp; cream 12 oz&nbsp;</h2>
    <h2>Out <em>of</em> stock</h2>
    <div id=item_details><p>Old price <span>$9.99</span> <span>a lb</span><p>Second</div>
    <span><span>1$</span>nested</span><span><b>$7</b></span>
    <section><span class="sr">Current price: $2.50 each</span><span style="a:b">&#36;2.50 / lb</span><em>x</em> <span>per&nbsp;lb</span></section>
    <img src="first.png"><div class="big ic-image-zoomer"><a><img alt src="zoom.png?a=1&amp;b=2"></a></div>
    <div tabindex="-1"><div><h2> Details </h2></div><ul><li>one<li>two</ul><p>Good <b>milk</b>.<br>Fresh<p>More</div>
    <ul><li><a data-testid="item_list_item_1b">shown in the dialog</a></ul></div>
  <li><a data-testid="item_list_item_2">Bread</a> <!-- <div role="dialog" aria-label="item details"></div> -->
  <li><a data-testid="item_list_item_1">Whole milk</a></ul></div>
<script>document.write('<div data-testid="CrossRetailerResultRowWrapper"><a data-testid="item_list_item_9">')</script>
<SECTION DATA-TESTID="CrossRetailerResultRowWrapper"><p>&nbsp;</p><A data-testid="item_list_item_3">Rice</A>
  <div role=dialog aria-label="item details"><h2>Rice 2 lb</h2><span>about $3</span><span>$4.75</span><span>18 ct</span><img alt="none" src="http://i/missing-item.png"></div></SECTION>"""


def test_cards_of_a_page(spark):
    """Attributes in any order and quotes, nesting, entities, comments, scripts, unclosed elements, a decoy price, a card without a dialog."""
    frame = spark.createDataFrame([(1, 1, PAGE), (1, 2, PAGE), (1, 12, PAGE), (2, 1, None), (3, 1, ""), (4, 1, "no < tags > at all")], "page_id long, carousel_page int, html string")
    cards = pages.cut_cards(frame)
    found = [(r.store, r.card_id, r.html is not None) for r in cards.where("page_id = 1 and carousel_page = 1").orderBy("seq").collect()]
    assert found == [("Best Foods", "item_list_item_1", True), ("Best Foods", "item_list_item_2", False), ("Best Foods", "item_list_item_1", False),
        ("Rice", "item_list_item_3", True)]
    assert cards.where("page_id > 1").count() == 0
    rows = {r.id: r for r in pages.parse_cards(pages.dedupe_cards(cards)).collect()}
    assert rows == {r.id: r for r in pages.parse_cards(pages.dedupe_cards(pages.read_cards(frame))).collect()}
    assert set(rows) == {"1", "2", "3"}
    got = {k: tuple(r)[4:] for k, r in rows.items()}
    assert got["1"] == ("Whole\u00a0milk & cream 12 oz", "$2.50", "lb", None, "zoom.png?a=1&b=2", "Good milk.Fresh", True)
    assert got["2"] == (None, None, None, None, None, None, False) and rows["2"].store == "Best Foods"
    assert got["3"] == ("Rice 2 lb", "$4.75", None, "18 ct", None, None, False)


def test_trees():
    html = '<p>a<div>b<br>c</div><ul><li>x<li>y<ul><li>z</ul></ul><table><tr><td>1<td>2<tr><td>3</table><svg><path d="M"/><g/></svg></nope><input value=v>t<b>&amp;'
    tree = h.Page(html)
    shape = [(n.tag, n.parent, n.last, tree.text[n.begin : n.end]) for n in tree.nodes]
    assert tree.text == "abcxyz123t&"
    assert shape == [("p", -1, 0, "a"), ("div", -1, 2, "bc"), ("br", 1, 2, ""), ("ul", -1, 7, "xyz"), ("li", 3, 4, "x"), ("li", 3, 7, "yz"), ("ul", 5, 7, "z"),
        ("li", 6, 7, "z"), ("table", -1, 13, "123"), ("tr", 8, 11, "12"), ("td", 9, 10, "1"), ("td", 9, 11, "2"), ("tr", 8, 13, "3"), ("td", 12, 13, "3"),
        ("svg", -1, 16, ""), ("path", 14, 15, ""), ("g", 14, 16, ""), ("input", -1, 17, ""), ("b", -1, 18, "&")]
    assert [n.kids for n in tree.nodes if n.tag in ("ul", "tr", "svg")] == [2, 1, 2, 1, 2]
    assert tree.nodes[17].attrs == {"value": "v"} and html[tree.nodes[1].src : tree.nodes[1].src_end] == "<div>b<br>c</div>"


def test_page_pieces(spark):
    html = F.lit('<div aria-modal="true"><input type="email"></div>')
    row = spark.range(1).select(pages.gates(html)["login_wall"], pages.store_name(F.lit("\n \n A \nB")), *pages.taxonomy_term(F.lit("cabbage, red"))).first()
    assert tuple(row) == (True, "A", "cabbage, red", "red")


def test_food_groups(spark):
    """Phrases word for word, plurals, exempt phrases that cover and that only stand beside, null and empty texts, own lexicons."""
    texts = {"2 cups whole Milk": {"dairy"}, "coconut milk": set(), "coconut milk and milk": {"dairy"}, "Eggplants": set(), "3 eggs, beaten": {"egg"},
        "buttermilk": {"dairy"}, "peanut butter": {"peanut"}, "half and half": {"dairy"}, "oyster mushrooms": set(), "smoked salmon; tofu": {"fish", "soy"},
        "almond flour": {"tree nut"}, "wheat flour": {"wheat"}, "": set(), "1/2": set()}
    frame = spark.createDataFrame([(t,) for t in [*texts, None, "coconut milk"]], "text string")
    got = {}
    for r in serving.food_groups(frame, serving.food_phrases(spark)).collect():
        got.setdefault(r.text, set()).add(r.food_group)
    assert got == {t: g for t, g in texts.items() if g}
    assert serving.food_groups(frame, serving.food_phrases(spark).limit(0)).count() == 0
    own = serving.food_phrases(spark, {"a b": "x y z, x"}, {"a b": "x q"})
    rows = serving.food_groups(spark.createDataFrame([("x q",), ("x q x",), ("x y z",)], "text string"), own).collect()
    assert sorted(map(tuple, rows)) == [("x q x", "a b"), ("x y z", "a b")]


def test_preferences(spark):
    recipes = spark.createDataFrame([(u, r) for u in (1, 2, 3, 4) for r in (10, 11, 12)] + [(1, 10)], "user_id int, recipe_id int")
    items = spark.createDataFrame([(10, "2 eggs"), (10, "milk"), (11, "bacon"), (11, None), (12, "rice")], "recipe_id int, text string")
    wishes = spark.createDataFrame([(1, ["Vegan"], None), (2, [], ["Egg", "?"]), (3, None, None), (3, ["Vegetarian", None], [None])], "user_id int, diets array<string>, allergies array<string>")
    got = {tuple(r) for r in serving.preference_filter(recipes, items, wishes, serving.food_phrases(spark)).collect()}
    assert got == {(1, 12), (2, 11), (2, 12), (3, 10), (3, 12), (4, 10), (4, 11), (4, 12)}
    rows = spark.createDataFrame([(1, "b"), (1, "a"), (2, "c")], "user_id int, diet string")
    assert [tuple(r) for r in serving.user_preferences(rows, 1).collect()] == [(1, "a")]


def test_serving(spark):
    offers = spark.createDataFrame([(i, f"Thing 5{'%' if i == 3 else 'x'}", "t", "s", None if i == 0 else 1.0) for i in range(6)],
        "offer_id int, name string, taxonomy string, store string, price double")
    assert [r.offer_id for r in serving.offer_search(offers, "5%").collect()] == [3]
    pages_ = [[r.offer_id for r in serving.offer_search(offers, "thing", limit=3, offset=o).collect()] for o in (0, 3)]
    assert pages_ == [[1, 2, 3], [4, 5, 0]]
    assert spark.range(1).select(serving.distance_miles(F.lit(34.0), F.lit(-118.0), F.lit(34.0), F.lit(-118.0))).first()[0] == 0
    assert spark.range(1).select(serving.chain_key(F.lit("Food 4 Less")), serving.chain_key(F.lit("?"))).first()[:] == ("food4less", None)


def test_upsert_and_report(spark, tmp_path):
    old = spark.createDataFrame([(1, 1.0, 5), (2, 1.0, 5)], "id int, v double, seq int")
    new = spark.createDataFrame([(2, 2.0, 1), (2, 3.0, 2), (3, 4.0, 1)], "id int, v double, seq int")
    assert {(r.id, r.v) for r in tables.upsert(old, new, "id", "seq").collect()} == {(1, 1.0), (2, 3.0), (3, 4.0)}
    rows = spark.createDataFrame([(1, "T", "b", 1, "S", "n", 2.0, 50.0), (1, "T", "a", None, None, None, None, None)],
        "recipe_id int, title string, raw string, match_rank int, store string, name string, price double, score double")
    tables.write_report(rows, str(tmp_path / "report"))
    assert [r.value for r in spark.read.text(str(tmp_path / "report")).collect()] == ["=== T ===", "a -> No match found", "b -> [S] n | $2.00 | 50.00"]


def test_row_range(spark):
    """Slices of a table with repeated keys, wherever they begin."""
    rows = [(i // 3, i) for i in range(100)]
    frame = spark.createDataFrame(rows, "k long, v long").repartition(5)
    for start, count in ((0, 7), (5, 20), (97, 10), (200, 5)):
        got = [r.k for r in tables.row_range(frame, "k", start, count).collect()]
        assert sorted(got) == [k for k, _ in rows[start : start + count]]
    assert sorted(tables.row_range(frame.limit(0), "k", 0, 5).collect()) == []


def test_keyed_scan(spark, tmp_path):
    """A database table read in ranges of its key."""
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    rows = spark.createDataFrame([(i, f"n{i}") for i in range(50)], "id long, name string")
    rows.write.jdbc(url, "items", properties={"driver": "org.apache.derby.jdbc.EmbeddedDriver"})
    got = tables.read_table_jdbc(spark, url, "items", "id", 0, 50, 4, driver="org.apache.derby.jdbc.EmbeddedDriver")
    assert got.rdd.getNumPartitions() == 4 and sorted(map(tuple, got.collect())) == [(i, f"n{i}") for i in range(50)]


def test_search_index(spark, tmp_path):
    """Pages of a stored index are those of the whole table, one after the other; the plan of a page reads one run's folder and no table."""
    rnd = random.Random(4)
    letters = "aAbB %_é"
    rows = [(i, "".join(rnd.choices(letters, k=rnd.randint(0, 9))) or None, "".join(rnd.choices("ab", k=rnd.randint(0, 4))), rnd.choice("XY"), rnd.choice([None, 1.0, 2.0, 3.5]))
        for i in range(400)]
    offers = spark.createDataFrame(rows, "offer_id long, name string, taxonomy string, store string, price double")
    path = str(tmp_path / "index")
    search.write_index(offers, path)
    for text, store in (("a", None), ("AB", "X"), ("ab%", None), ("aab ", "X"), ("é", None), ("zz", None), ("abq", None)):
        want = [r[0] for r in sorted(rows, key=lambda r: (r[4] is None, r[4] or 0, r[0])) if any(text.lower() in (c or "").lower() for c in r[1:3]) and store in (None, r[3])]
        assert [r.offer_id for r in search.search(spark, path, text, store, 14).collect()] == want[:14]
    got, after = [], None
    while page := search.search(spark, path, "b", None, 50, after).collect():  # through all prices to the unpriced
        got += [r.offer_id for r in page]
        after = page[-1].price, page[-1].offer_id
    assert len(got) == len(set(got)) == sum("b" in ((r[1] or "") + r[2]).lower() for r in rows)
    plan = search.search(spark, path, "aab")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(part" in plan and "EqualTo(run," in plan and plan.count("FileScan") == 1
    with pytest.raises(ValueError):
        search.search(spark, path, "")


def test_batches_are_whole_and_counted_once(spark, tmp_path):
    path, schema = str(tmp_path / "batches"), "a long, b long"
    assert tables.read_batches(spark, path, schema).count() == 0

    def batch(n, fails=False):
        rows = spark.range(100, numPartitions=4).select(F.col("id").alias("a"), F.lit(n).cast("long").alias("b"))
        return rows.where(F.when((F.col("a") == 99) & F.lit(fails), F.raise_error(F.lit("lost")).cast("boolean")).otherwise(F.lit(True)))

    assert tables.append_batch(batch(0), path, 0)
    with pytest.raises(Exception, match="lost"):
        tables.append_batch(batch(1, fails=True), path, 1)
    assert {r.b for r in tables.read_batches(spark, path, schema).collect()} == {0}
    written = [tables.append_batch(batch(n), path, n) for n in (0, 1, 2, 1)]  # the run begins again from the start
    assert written == [False, True, True, False]
    got = tables.read_batches(spark, path, schema).groupBy("b").count().collect()
    assert sorted(map(tuple, got)) == [(0, 100), (1, 100), (2, 100)]
    left = tables.not_done(batch(2).union(batch(3)), tables.read_batches(spark, path, schema).select("b"), "b")
    assert {r.b for r in left.collect()} == {3}
    with pytest.raises(ValueError):
        tables.append_batch(batch(1), path, -1)


def test_merge_rewrites_what_it_touches(spark, tmp_path):
    """Untouched buckets keep their files; readers see whole versions; two merges from one version do not both commit."""
    path, schema = str(tmp_path / "keyed"), "id long, price double, version long"
    stored = tables.KeyedTable(spark, path, schema, "id", "version", buckets=8)
    assert stored.read().count() == 0 and stored.merge(spark.createDataFrame([], schema)) == set()
    old = spark.createDataFrame([(i, float(i), 0) for i in range(200)], schema)
    assert stored.merge(old) == set(range(8))
    files = set(stored.read().inputFiles())
    new = spark.createDataFrame([(3, 30.0, 1), (3, 31.0, 2), (500, 5.0, 1), (3, 32.0, 0)], schema)
    touched = stored.merge(new)
    rows = {r.id: (r.price, r.version) for r in stored.read().collect()}
    assert len(rows) == 201 and rows[3] == (31.0, 2) and rows[500] == (5.0, 1) and rows[4] == (4.0, 0)
    kept = files & set(stored.read().inputFiles())
    assert len(touched) <= 2 and len(kept) >= 8 - len(touched) and all(f"_bucket={b}/" not in f for f in kept for b in touched)
    stored.vacuum()
    assert stored.read().count() == 201
    lost = spark.createDataFrame([(7, 1.0, 9)], schema).withColumn("price", F.raise_error(F.lit("lost")).cast("double"))
    with pytest.raises(Exception, match="lost"):
        stored.merge(lost)
    assert {r.id: (r.price, r.version) for r in stored.read().collect()} == rows
    other = tables.KeyedTable(spark, path, schema, "id", "version", buckets=8)
    begun = stored._versions()
    other._versions = lambda: begun  # as another run saw it
    stored.merge(new.limit(1))
    with pytest.raises(OSError):
        other.merge(new.limit(1))
