import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from basketry.functions import similarity as sim
from basketry.functions import text as tx
from basketry.operators import blocking, catalog, matching
from basketry.operators import rules as rl
from basketry.sources import storage, tables


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        diag = 0
        for j, y in enumerate(b, 1):
            diag, row[j] = row[j], diag + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def plain_ratio(a, b):
    return 100.0 if a == b else 200.0 * plain_lcs(a, b) / (len(a) + len(b)) if a and b else 0.0


def plain_partial(a, b):
    small, large = sorted((a, b), key=len)
    windows = [large[max(0, i) : i + len(small)] for i in range(1 - len(small), len(large))]
    return max(200.0 * plain_lcs(small, w) / (len(small) + len(w)) for w in windows) if small else 0.0 if large else 100.0


@pytest.mark.parametrize("lanes", [7, 1 << 14])
def test_similarity_kernels(monkeypatch, lanes):
    """Texts around the 64-bit words, equal and empty ones, any letters; many pairs at once and few at a time."""
    monkeypatch.setattr(sim, "LANES", lanes)
    rnd = random.Random(3)
    sizes = [0, 0, 1, 2, 5, 12, 30, 63, 64, 65, 127, 128, 129, 150]
    a, b = (["".join(rnd.choices("abcé 中😀", k=rnd.choice(sizes))) for _ in range(250)] for _ in "ab")
    b[:20] = a[:20]
    texts, (x, y), known = sim._interned((pa.array([*a, None, "a"]), pa.array([*b, "a", None])))
    assert known.tolist() == [True] * 250 + [False] * 2
    assert sim.indel(texts, x, y).tolist()[:250] == [plain_ratio(p, q) for p, q in zip(a, b, strict=True)]
    assert sim.partial(texts, x, y).tolist()[:250] == [plain_partial(p, q) for p, q in zip(a, b, strict=True)]
    in_order = [" ".join(sorted(p.split())) for p in a], [" ".join(sorted(q.split())) for q in b]
    assert sim.sorted_indel(texts, x, y).tolist()[:250] == [plain_ratio(p, q) for p, q in zip(*in_order, strict=True)]


PRODUCTS = [
    (0, "Peanut Butter", "Nutty", "Pantry", "PANTRY", "peanut butter", "2.50"),
    (1, "Unsalted Butter", "Farm", "Dairy", "DAIRY", "butter", "4.00"),
    (2, "Salted Butter", "Farm", "Dairy", "DAIRY", "butter", "3.00;3.50"),
    (3, "Shampoo with Butter", "Glow", "Beauty", "BEAUTY", "shampoo", "1.00"),
    (4, "Red Onion", "Field", "Produce", "PRODUCE", "onion", None),
    (5, "Red Onion", "field", "Produce", "PRODUCE", "onion", "0.50"),
]


@pytest.fixture(scope="module")
def products(spark):
    df = spark.createDataFrame(PRODUCTS,
        "pos long, description string, brand string, categories string, classifier string, search_keyword string, price string")
    return catalog.normalized(df.withColumn("productId", F.col("pos").cast("string")))


def test_rules_and_scores(spark, products):
    ings = spark.createDataFrame([("unsalted butter",)], "ing string")
    rows = {r.pos: r for r in matching.score_pairs(blocking.candidates(ings, products), products).collect()}
    assert set(rows) == {0, 1, 2, 3}
    assert rows[1].category_part == 4 + 8 + 8 + 10  # good class, dairy hint in category and class, dairy butter
    assert rows[0].penalty_part == 40  # a compound butter
    assert rows[2].penalty_part == 45  # the opposite modifier
    assert rows[3].penalty_part >= 50 + 45 + 25 + 200
    for r in rows.values():
        whole = 0.2 * r["ratio"] + 0.25 * r.partial + 0.25 * r.sorted_desc + 0.15 * r.sorted_combined + 0.15 * r.sorted_keyword + r.overlap_part + r.phrase_part + r.category_part + r.form_part - r.penalty_part
        assert r.total == pytest.approx(whole)


def test_match_lines(spark, products):
    lines = spark.createDataFrame([("a", "1 cup unsalted butter, melted"), ("b", "divided"), ("c", "2 red onions"), ("d", "zzzz")],
        "line_id string, raw string")
    rows = matching.match_table(lines, products).orderBy("line_id", "match_rank").collect()
    got = [(r.line_id, r.match_rank, r.productId) for r in rows]
    assert ("a", 1, "1") in got and not [g for g in got if g[0] == "b"]
    assert [g for g in got if g[0] == "c"] == [("c", 1, "4")]  # one of the doubled description and brand
    assert ("d", None, None) in got


def test_price_pool_and_decisions(spark):
    rows = [("x", i, f"d{i}", "b", s, p, i + 1) for i, (s, p) in enumerate([(120.0, 5.0), (118.0, None), (100.0, 1.0), (70.0, 0.1)])] + [("y", 0, "d",
        "b", 62.0, 2.0, 1), ("y", 1, "e", "b", 61.0, 1.0, 2)]
    ranked = spark.createDataFrame(rows, "ing string, pos long, description string, brand string, score double, min_price double, rank int")
    cfg = matching.MatchConfig(top_k=3)
    picked = [(r.ing, r.pos) for r in matching.cheapest_of_best(ranked, cfg).orderBy("ing", "match_rank").collect()]
    assert picked == [("x", 2), ("x", 0), ("x", 1), ("y", 0)]
    decisions = spark.createDataFrame([("x", 2, "why"), ("y", None, "none fits")], "ing string, choice int, reason string")
    first = matching.apply_decisions(ranked, decisions).orderBy("rank").collect()
    assert [(r.ing, r.pos) for r in first] == [("x", 2), ("x", 0), ("x", 1), ("x", 3)]
    assert first[0].reranker_choice and first[0].reranker_reason == "why"


def test_default_rules_are_separable(spark):
    rules = rl.default_rules()
    n = spark.range(1).select(rl.ingredient_side(rules, F.lit("potato"))).first()[0]
    assert {rules[i].name for i in n} >= {"R02", "R04", "R30", "R39"}


def holds_plainly(test, text):
    def word(w):
        return w in text if re.search(r"[^a-zA-Z\s]", w) else bool(re.search(rf"\b{w}\b", text))

    return ((not test.eq or text in test.eq) and (not test.any or any(t in text for t in test.any)) and all(t in text for t in test.all)
        and not any(t in text for t in test.none) and (not test.token or bool(set(text.split(" ")) & set(test.token))) and (not test.word or any(map(word, test.word)))
        and not any(map(word, test.no_word)) and text.endswith(test.end))


def test_automaton_says_what_each_rule_says(spark):
    """All default rules on random texts of their own words and others, each condition tested by itself."""
    rnd = random.Random(8)
    rules = rl.default_rules()
    words = sorted({w for side in (rl.Side([(0, {"N": r.n}) for r in rules]), rl.Side([(0, dict(zip("DCK", (t for _, t in r.p)))) for r in rules])) for t in side.terms for w in [t, *t.split()]})
    texts = ["", "potato", *(rnd.choice(["", " ", "x"]).join(rnd.choices(words, k=1)) for _ in range(50)), *(" ".join(rnd.choices(words, k=rnd.randint(1, 5))) for _ in range(250))]
    rows = [(rnd.choice([*texts, None]), *(rnd.choice([*texts, None]) for _ in "DCK")) for _ in range(400)]
    frame = spark.createDataFrame(rows, "n string, d string, c string, k string")
    got = frame.select("*", rl.ingredient_side(rules, F.col("n")).alias("on_n"), rl.product_side(rules, {"D": F.col("d"), "C": F.col("c"), "K": F.col("k")}).alias("on_p")).collect()
    empty = rl.Test()
    for r in got:
        assert r.on_n == [i for i, x in enumerate(rules) if x.n == empty or (r.n is not None and holds_plainly(x.n, r.n))]
        field = {"D": r.d, "C": r.c, "K": r.k}
        assert r.on_p == [i for i, x in enumerate(rules) if all(any(field[f] is not None and holds_plainly(t, field[f]) for f in name) for name, t in x.p)]


def test_empty_tables(spark, products):
    none = spark.createDataFrame([], "ing string")
    assert matching.match_ingredients(none, products).count() == 0
    ings = spark.createDataFrame([("butter",)], "ing string")
    assert matching.match_ingredients(ings, products.limit(0)).count() == 0


def test_states_of_lines(spark, products):
    """A line is skipped with its reason, unmatched with its name, or matched with its breakdown."""
    lines = spark.createDataFrame([("a", "1 cup unsalted butter, melted"), ("b", "divided"), ("d", "zzzz"), ("e", None),
        ("f", "1 cup unsalted butter")], "line_id string, raw string")
    rows = matching.match_lines(lines, products).collect()
    states = {r.line_id: r.state for r in rows}
    assert states == {"a": "matched", "b": "skipped", "d": "unmatched", "e": "skipped", "f": "matched"}
    assert {r.skip for r in rows if r.line_id == "b"} == {"non-ingredient fragment"} and {r.ing for r in rows if r.line_id == "d"} == {"zzzz"}
    for r in rows:
        assert (r.breakdown is None) == (r.state != "matched")
        assert r.state != "matched" or abs(r.breakdown.final_score - r.score) < 0.011


def test_parts_of_lines(spark, products):
    """The parts of a line are matched one by one; a line without parts is kept."""
    lines = spark.createDataFrame([("a", "salted butter and pepper zzzz"), ("b", "2 red onions"), ("c", ""), ("d", "1 or 2"),
        ("e", "divided or melted")], "line_id string, raw string")
    found = matching.match_parts(lines, products)
    rows = {(r.line_id, r.part_no, r.match_rank): r for r in found.collect()}
    assert {k[:2]: r.state for k, r in rows.items() if k[0] == "a"} == {("a", 0): "matched", ("a", 1): "unmatched"}
    assert rows["a", 0, 1].productId == "2" and rows["b", 0, 1].n_parts == 1
    assert rows["c", None, None].skip == "empty after preprocessing" and rows["c", None, None].n_parts == 0
    nested = {r.line_id: r for r in matching.nested_results(found).collect()}
    assert [p.state for p in nested["a"].alternatives] == ["matched", "unmatched"] and nested["a"].matches == []
    assert nested["b"].alternatives is None and nested["b"].matches[0].productId == "4"
    about = spark.createDataFrame([(x, 1, "T") for x in "abcde"], "line_id string, recipe_id int, title string")
    report = [r.text for r in tables.split_report(found.join(about, "line_id")).orderBy("line_no").collect()]
    assert report[0] == "Recipe: T" and report[1].endswith("  [split]") and report[2].startswith("  Ingredient: salted butter") and report[3].startswith("    -> [Farm] Salted Butter | $3.00 | score: ")


def test_blocking_is_that_of_all_products(spark):
    """Blocking over distinct texts takes the products that ranking every product would take."""
    rnd = random.Random(2)
    words = ["red", "hot", "rod", "bolt", "gear", "cap"]
    rows = [(i, " ".join(rnd.choices(words, k=2)), "b", rnd.choice(["Pet", "Tools"]), "X", "", None) for i in range(300)]
    products = catalog.normalized(spark.createDataFrame(rows,
        "pos long, description string, brand string, categories string, classifier string, search_keyword string, price string").withColumn("productId", F.col("pos").cast("string")))
    texts = {r.pos: r for r in products.collect()}
    ings = ["red rod", "bolt", "hot hot cap", "boltx", "qqqq"]
    got = {}
    for r in blocking.candidates(spark.createDataFrame([(x,) for x in ings], "ing string"), products, top=40, keep=15).collect():
        got.setdefault(r.ing, {})[r.block_rank] = (r.pos, r.overlap)
    for ing in ings:
        tokens = set(ing.split())
        have = {t for r in texts.values() for t in r.combined_text.split()}
        found = {}
        for pos, r in texts.items():
            own = set(r.combined_text.split())
            overlap = len(tokens & own)
            prefixed = any(len(t) >= 4 and t not in have and any(len(w) >= 4 and w[:4] == t[:4] for w in own) for t in tokens)
            if overlap or prefixed:
                found[pos] = overlap
        found = found or dict.fromkeys(texts, 0)
        good = [p for p in found if "pet" not in texts[p].categories_norm]
        pool = good if len(good) >= 15 else list(found)
        order = sorted(pool, key=lambda p: (-found[p], texts[p].description_norm, p))[:40]
        assert got[ing] == {i + 1: (p, found[p]) for i, p in enumerate(order)}


def test_scratch_tables_go(spark):
    """Tables of a scope are there within it and gone after it; others stay."""
    outer = storage.written(spark.range(3), "stays")
    with storage.scratch(spark):
        inner = storage.written(spark.range(5), "goes")
        with storage.scratch(spark):
            deepest = storage.written(spark.range(7), "goes")
            assert deepest.count() == 7
        assert inner.count() == 5
    assert outer.count() == 3
    for gone in (inner, deepest):
        path = spark._jvm.org.apache.hadoop.fs.Path(gone.inputFiles()[0]).getParent()
        assert not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def test_bounds_spare_comparisons(spark, monkeypatch):
    """Matches are those of all pairs compared; fewer are compared, and no score exceeds its bound."""
    rnd = random.Random(5)
    words = "red onion butter salted milk flour rice corn apple tart dried fresh soup green bean oil long pie".split()
    rows = []
    for i in range(900):
        name = " ".join(rnd.sample(words, rnd.randint(1, 5)))
        rows.append((i, name.title(), rnd.choice("ABC"), rnd.choice(["Produce", "Dairy", "Small Kitchen"]), rnd.choice(["PRODUCE", "DAIRY", "X"]),
            rnd.choice(["", name, "onion"]), rnd.choice([None, "1.50", "2;3"])))
    catalog_ = catalog.normalized(spark.createDataFrame(rows, "pos long, description string, brand string, categories string, classifier string, search_keyword string, price string").withColumn(
        "productId", F.col("pos").cast("string"))).cache()
    ings = spark.createDataFrame([(" ".join(rnd.sample(words, k)),) for k in (1, 1, 1, 2, 2, 2, 3, 3, 4)] + [("zzyzx",), ("onions red",)], "ing string").distinct().cache()
    compared = []
    real = matching.compare_texts
    monkeypatch.setattr(matching, "compare_texts", lambda pairs: compared.append(storage.written(pairs, "counted")) or real(compared[-1]))
    for cfg in (matching.MatchConfig(top_k=3), matching.MatchConfig(top_k=5), matching.MatchConfig(top_k=1, pool=2, pool_gap=5.0)):
        known = matching.prepare_pairs(blocking.candidates(ings, catalog_, cfg.block, cfg.keep), catalog_, cfg)
        every = matching.compare_texts(known.pairs).join(known.pairs.select("ing", "text_id", "overlap", "bound"), ["ing", "text_id", "overlap"])
        assert every.where("total > bound + 1e-6").count() == 0
        compared.clear()
        got = matching.match_ingredients(ings, catalog_, cfg)
        some = sum(c.count() for c in compared)
        n_all = known.pairs.count()
        scored = matching.score_pairs(blocking.candidates(ings, catalog_, cfg.block, cfg.keep), catalog_, cfg)
        about = catalog_.withColumn("min_price", tx.parse_min_price("price")).select("pos", "productId", "description", "brand", "min_price")
        want = matching.cheapest_of_best(matching.accept(matching.rank_matches(scored.join(about, "pos"), cfg.floor), cfg.accept), cfg)
        columns = ["ing", "pos", "score", "match_rank"]
        assert sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, want.select(columns).collect()))
        assert got.count() > 5 and some < 0.8 * n_all
