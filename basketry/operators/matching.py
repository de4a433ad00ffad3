"""Scores of (ingredient, product) pairs, selection of matches, and whole match runs."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketry.functions import similarity as sim
from basketry.functions import text as tx
from basketry.functions.text import round2
from basketry.operators import blocking
from basketry.operators import rules as rl
from basketry.sources.storage import partitions, written


@dataclass(frozen=True)
class MatchConfig:
    """Limits of a match run. ``top_k`` matches come from a pool of ``max(3 * top_k, pool)`` candidates."""

    top_k: int = 5
    floor: float = 35.0
    accept: float = 60.0
    pool: int = 15
    pool_gap: float = 40.0
    pool_floor: float = 65.0
    block: int = blocking.TOP
    keep: int = blocking.KEEP
    rules: Sequence[rl.Rule] = field(default_factory=rl.default_rules)


def overlap_score(overlap: Column, tokens: Column) -> Column:
    """Shared tokens, with diminishing returns; of several tokens also the share that is covered."""
    n = F.greatest(tokens, F.lit(1))
    return F.when(n == 1, F.log1p(overlap) * 12.0).otherwise(overlap / n * 18.0 + F.log1p(overlap) * 6.0)


def phrase_boost(ing: Column, desc: Column, combined: Column) -> Column:
    return F.when(ing == desc, 25.0).when(desc.contains(ing), 18.0).when(combined.contains(ing), 10.0).otherwise(0.0)


def confidence(score: Column) -> Column:
    return F.when(score >= 130, "high").when(score >= 100, "medium").otherwise("low")


@dataclass(frozen=True)
class Prepared:
    """Candidate pairs with all that costs little.

    ``rows`` are the pairs of ingredients and products, each with its ``text_id``; ``pairs`` are
    the distinct pairs of texts with the parts of the score that need no comparison and ``bound``, which no score exceeds.
    """

    rows: DataFrame
    pairs: DataFrame


_PARTS = ("overlap_part", "phrase_part", "category_part", "form_part", "penalty_part")
_LIKENESS = "0.20 * ratio + 0.25 * partial + 0.25 * sorted_desc + 0.15 * sorted_combined + 0.15 * sorted_keyword"


def likeness_bound(ing: Column, desc: Column, combined: Column, keyword: Column) -> Column:
    """What the five similarities can add up to at most, by the texts' lengths: an LCS is no longer than the shorter text.

    Words in order may lose white space at the ends or between them, so their
    lengths are those of the joined words. A partial ratio can always be 100.
    """

    def joined(x: Column) -> Column:
        return F.length(F.array_join(F.filter(F.split(x, r"\s+"), lambda w: w != ""), " "))

    def most(x: Column, y: Column) -> Column:
        return F.when((x == 0) & (y == 0), 100.0).otherwise(200.0 * F.least(x, y) / F.greatest(x + y, F.lit(1)))

    own = joined(ing)
    keyworded = F.when(F.length(keyword) > 0, most(own, joined(keyword))).otherwise(0.0)
    return 0.20 * most(F.length(ing), F.length(desc)) + 25.0 + 0.25 * most(own, joined(desc)) + 0.15 * most(own, joined(combined)) + 0.15 * keyworded


def prepare_pairs(pairs: DataFrame, catalog: DataFrame, cfg: MatchConfig = MatchConfig()) -> Prepared:
    """What is known of ``pairs (ing, pos, overlap, ...)`` before texts are compared; both tables are written.

    Products with equal texts score alike, so rules are evaluated once for each
    text and parts once for each pair of distinct texts.
    """
    texts = ["description_norm", "combined_text", "search_keyword_norm", "categories_norm", "classifier_norm", "classifier"]
    product = catalog.select("pos", *texts)
    kinds = product.groupBy(*texts).agg(F.min("pos").alias("text_id"))
    side = rl.product_side(cfg.rules, {"D": F.col("description_norm"), "C": F.col("categories_norm"), "K": F.col("classifier_norm")})
    good = F.when(F.upper("classifier").isin(*rl.GOOD_CLASSIFIERS), 4.0).otherwise(0.0).alias("good")
    names = F.col("description_norm").alias("desc"), F.col("combined_text").alias("combined"), F.col("search_keyword_norm").alias("keyword")
    sided = written(kinds.select("text_id", *texts, *names, side.alias("p_rules"), good), "product-texts")
    same = [F.col(f"p.{c}").eqNullSafe(F.col(f"k.{c}")) for c in texts]
    named = product.alias("p").join(sided.alias("k"), same).select("pos", "text_id")
    rows = written(pairs.join(named, "pos"), "pairs")
    n_tokens = F.size(tx.important_tokens("ing")).alias("n_tokens")
    ings = rows.select("ing").distinct().select("ing", n_tokens, rl.ingredient_side(cfg.rules, F.col("ing")).alias("n_rules"))
    distinct = rows.groupBy("ing", "text_id", "overlap").agg(F.count("*").alias("n_products")).join(sided.drop(*texts), "text_id").join(ings, "ing")
    n, p = F.col("n_rules"), F.col("p_rules")
    known = distinct.withColumns({
        "overlap_part": overlap_score(F.col("overlap"), F.col("n_tokens")),
        "phrase_part": phrase_boost(F.col("ing"), F.col("desc"), F.col("combined")),
        "category_part": F.col("good") + rl.channel_sum(cfg.rules, "category")(n, p),
        "form_part": rl.channel_sum(cfg.rules, "form")(n, p),
        "penalty_part": rl.channel_sum(cfg.rules, "penalty")(n, p),
    })
    others = F.coalesce("overlap_part", F.lit(0.0)) + F.col("phrase_part") + F.col("category_part") + F.col("form_part") - F.col("penalty_part")
    bound = others + likeness_bound(*[F.coalesce(c, F.lit("")) for c in ("ing", "desc", "combined", "keyword")])
    known = known.withColumn("bound", F.coalesce(bound, F.lit(float("inf")))).drop("p_rules", "n_rules", "good", "n_tokens")
    return Prepared(rows, written(known, "text-pairs"))


def compare_texts(pairs: DataFrame) -> DataFrame:
    """``pairs`` of texts with their similarities and ``total``, dealt evenly first, since they are few bytes but much work."""
    dealt = pairs.repartition(partitions(pairs.sparkSession), "ing", "text_id")
    scored = dealt.withColumn("alike", sim.scores(*[F.coalesce(c, F.lit("")) for c in ("ing", "desc", "combined", "keyword")]))
    scored = scored.select("*", *[F.col(f"alike.{n}").alias(n) for n in sim.SCORES]).drop("alike")
    total = F.expr(f"{_LIKENESS} + overlap_part + phrase_part + category_part + form_part - penalty_part")
    return scored.withColumn("total", total.cast("double")).select("ing", "text_id", "overlap", *_PARTS, *sim.SCORES, "total")


def score_pairs(pairs: DataFrame, catalog: DataFrame, cfg: MatchConfig = MatchConfig()) -> DataFrame:
    """``pairs (ing, pos, overlap, ...)`` with ``total`` and the parts it is made of; similarities once for each pair of distinct texts."""
    known = prepare_pairs(pairs, catalog, cfg)
    return known.rows.join(compare_texts(known.pairs), ["ing", "text_id", "overlap"]).drop("text_id")


#: Scores are compared after rounding to two decimals.
_SLACK = 0.02


def pairs_that_count(known: Prepared, about: DataFrame, cfg: MatchConfig) -> DataFrame:
    """The scored pairs of texts that can be among an ingredient's best: ``(ing, text_id, overlap, parts, total)``.

    First the pairs of the greatest bounds are compared, as many as make twice the
    pool of distinct products. Their scores say what a candidate must reach: the first one's less the gap,
    the pool's floor, and the score of the pool's last place. A pair whose bound
    is under that can change neither the first candidate nor the pool, so it is
    not compared; nor is one under the floor.
    """
    pool = max(3 * cfg.top_k, cfg.pool)
    order = Window.partitionBy("ing").orderBy(F.desc("bound"), "text_id", "overlap")
    ranked = known.pairs.where(F.col("bound") >= cfg.floor - _SLACK).withColumn("before", F.sum("n_products").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    ranked = ranked.fillna(0, ["before"])
    is_first = F.col("before") < 2 * pool
    first = written(compare_texts(ranked.where(is_first)), "first-scores")
    named = known.rows.join(first.select("ing", "text_id", "overlap", "total"), ["ing", "text_id", "overlap"]).join(about, "pos")
    once = named.groupBy("ing", F.lower("description").alias("d"), F.lower("brand").alias("b")).agg(F.max("total").alias("total"))
    once = once.withColumn("place", F.row_number().over(Window.partitionBy("ing").orderBy(F.desc("total")))).where(F.col("place") <= pool)
    reach = once.groupBy("ing").agg(F.max("total").alias("best"), F.max(F.when(F.col("place") == pool, F.col("total"))).alias("last"))
    least = F.when(F.col("best") >= cfg.pool_floor, F.greatest(F.col("best") - cfg.pool_gap, F.lit(cfg.pool_floor))).otherwise(F.col("best"))
    least = F.greatest(least, F.coalesce("last", F.lit(cfg.floor)), F.lit(cfg.floor)) - _SLACK
    rest = ranked.where(~is_first).join(reach.select("ing", least.alias("least")), "ing").where("bound >= least")
    return first.union(compare_texts(rest))


def breakdown() -> Column:
    """The parts of a score, two decimals each, as one struct."""
    parts = {
        "score_desc_ratio": "ratio", "score_desc_partial": "partial", "score_desc_token": "sorted_desc", "score_combined": "sorted_combined",
            "score_keyword": "sorted_keyword",
        "overlap_score": "overlap_part", "exact_phrase_boost": "phrase_part", "category_boost": "category_part", "form_boost": "form_part",
            "penalty": "penalty_part", "final_score": "total",
    }
    return F.struct(*[round2(F.col(old)).alias(new) for new, old in parts.items()])


def rank_matches(scored: DataFrame, floor: float) -> DataFrame:
    """Candidates over the floor in order of the rounded score, each description and brand once, as ``rank``."""
    rows = scored.where(F.col("total") >= floor).withColumn("score", round2(F.col("total")))
    order = [F.desc("score"), F.col("block_rank")]
    once = Window.partitionBy("ing", F.lower("description"), F.lower("brand")).orderBy(*order)
    rows = rows.withColumn("again", F.row_number().over(once)).where("again = 1").drop("again")
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("ing").orderBy(*order)))


def accept(ranked: DataFrame, least: float) -> DataFrame:
    """Without the ingredients whose best score is under ``least``."""
    best = F.max("score").over(Window.partitionBy("ing"))
    return ranked.withColumn("best", best).where(F.col("best") >= least).drop("best")


def cheapest_of_best(ranked: DataFrame, cfg: MatchConfig) -> DataFrame:
    """The ``top_k`` cheapest of the leading candidates, unpriced last, as ``match_rank``.

    Leading are the first ``max(3 * top_k, pool)`` within ``pool_gap`` of the
    first and not under ``pool_floor``; if none is, the first alone.
    """
    top = F.max(F.when(F.col("rank") == 1, F.col("score"))).over(Window.partitionBy("ing"))
    rows = ranked.withColumn("lead", (F.col("rank") <= max(3 * cfg.top_k, cfg.pool)) & (F.col("score") >= F.greatest(top - cfg.pool_gap,
        F.lit(cfg.pool_floor))))
    some = F.max("lead").over(Window.partitionBy("ing"))
    rows = rows.withColumn("some", some).where(F.col("lead") | (~F.col("some") & (F.col("rank") == 1))).drop("lead", "some")
    order = Window.partitionBy("ing").orderBy(F.asc_nulls_last("min_price"), "rank")
    return rows.withColumn("match_rank", F.row_number().over(order)).where(F.col("match_rank") <= cfg.top_k)


def apply_decisions(ranked: DataFrame, decisions: DataFrame) -> DataFrame:
    """Apply ``decisions (ing, choice, reason)`` to ranked candidates.

    A null choice clears an ingredient's candidates, a choice (from 0) of no
    candidate leaves them as they are, any other goes first and is tagged.
    """
    count = F.count("*").over(Window.partitionBy("ing"))
    rows = ranked.withColumn("n", count).join(decisions.select("ing", "choice", "reason", F.lit(True).alias("decided")), "ing", "left")
    rows = rows.where(F.col("decided").isNull() | F.col("choice").isNotNull())
    valid = F.coalesce((F.col("choice") >= 0) & (F.col("choice") < F.col("n")), F.lit(False))
    chosen = valid & (F.col("rank") == F.col("choice") + 1)
    order = Window.partitionBy("ing").orderBy(F.when(chosen, 0).otherwise(1), "rank")
    return rows.select(*[c for c in ranked.columns if c != "rank"], F.row_number().over(order).alias("rank"),
        F.when(valid, chosen).alias("reranker_choice"), F.when(chosen, F.col("reason")).alias("reranker_reason"))


def match_ingredients(ingredients: DataFrame, catalog: DataFrame, cfg: MatchConfig = MatchConfig(), decisions: DataFrame | None = None) -> DataFrame:
    """Matches of distinct normalised ``ingredients (ing)`` in a normalised ``catalog`` with ``pos``: ``match_rank`` from 1."""
    found = blocking.candidates(ingredients, catalog, cfg.block, cfg.keep)
    known = prepare_pairs(found, catalog, cfg)
    have = set(catalog.columns)
    price = F.col("min_price") if "min_price" in have else tx.parse_min_price("price") if "price" in have else F.lit(None).cast("double")
    about = catalog.withColumn("min_price", price).select("pos", "productId", "description", "brand", "min_price",
        *[c for c in ("size", "image_url", "store_ids") if c in have])
    # decisions name candidates by rank, so that all of them must be scored
    texts = pairs_that_count(known, about.select("pos", "description", "brand"), cfg) if decisions is None else compare_texts(known.pairs.where(F.col("bound") >= cfg.floor - _SLACK))
    scored = known.rows.join(texts, ["ing", "text_id", "overlap"]).drop("text_id")
    ranked = rank_matches(scored.join(about, "pos"), cfg.floor)
    ranked = accept(ranked, cfg.accept) if decisions is None else apply_decisions(ranked, decisions)
    return cheapest_of_best(ranked, cfg).withColumn("confidence", confidence(F.col("total")))


def normalized_lines(lines: DataFrame) -> DataFrame:
    """``lines (line_id, raw)`` with ``line`` (pre-processed), ``skip`` (the reason, empty to keep) and ``ing``.

    Each distinct text is worked on once. A kept line whose name is empty is
    skipped as ``empty after normalization``.
    """
    raws = lines.select("raw").distinct()
    raws = raws.withColumns({"line": tx.preprocess("raw"), "skip": tx.skip_reason("raw"), "ing": tx.normalize_ingredient("raw")})
    raws = raws.withColumn("skip", F.when((F.col("skip") == "") & (F.col("ing") == ""), "empty after normalization").otherwise(F.col("skip")))
    raws = raws.withColumn("ing", F.when(F.col("skip") == "", F.col("ing")).otherwise(""))
    known = raws.withColumnRenamed("raw", "known_raw")
    return lines.join(known, F.col("raw").eqNullSafe(F.col("known_raw")), "left").drop("known_raw")


#: What a match says of its product.
MATCH = ("match_rank", "productId", "description", "brand", "min_price", "score", "confidence")


def match_lines(lines: DataFrame, catalog: DataFrame, cfg: MatchConfig = MatchConfig(), decisions: DataFrame | None = None) -> DataFrame:
    """Every line of ``lines (line_id, raw, ...)`` in its state, once for each match.

    ``state`` is ``skipped`` (with the reason in ``skip``), ``unmatched`` (with the
    name in ``ing``) or ``matched``; only then the columns of ``MATCH`` and
    ``breakdown`` are set. Ingredients that repeat are matched once. A null line
    is skipped as empty. Columns of ``lines`` are kept.
    """
    clean = normalized_lines(lines)
    matches = match_ingredients(clean.where("skip = ''").select("ing").distinct(), catalog, cfg, decisions)
    found = clean.join(matches.select("ing", *MATCH, breakdown().alias("breakdown")), "ing", "left")
    state = F.when(F.col("skip") != "", "skipped").when(F.col("match_rank").isNull(), "unmatched").otherwise("matched")
    return found.select(*lines.columns, "line", "skip", "ing", state.alias("state"), *MATCH, "breakdown")


def match_parts(lines: DataFrame, catalog: DataFrame, cfg: MatchConfig = MatchConfig(top_k=3)) -> DataFrame:
    """The parts of every line of ``lines (line_id, raw)``, each in its state, once for each match.

    A line of one part has ``n_parts`` 1. Alternatives ("a or b") and compounds are
    parts of their own, numbered by ``part_no`` from 0, all under ``line``, the
    pre-processed text. A line that is empty then comes as one skipped row of 0
    parts, one whose parts are all empty as one unmatched row of 0 parts. Equal
    parts are matched once in all lines.
    """
    whole = lines.select("line_id", "raw").distinct()
    return with_texts(whole, text_parts(whole.select("raw"), catalog, cfg)).drop("raw")


def text_parts(lines: DataFrame, catalog: DataFrame, cfg: MatchConfig = MatchConfig(top_k=3)) -> DataFrame:
    """``match_parts`` of each distinct text of ``lines (raw)``, written: it is as small as the texts are few."""
    texts = written(lines.select("raw").distinct(), "line-texts")
    parts = written(line_parts(texts.select(F.col("raw").alias("line_id"), "raw")).withColumnRenamed("line_id", "raw"), "line-parts")
    found = match_lines(parts.select(F.col("part").alias("raw")).distinct(), catalog, cfg).drop("line").withColumnRenamed("raw", "part")
    rows = texts.withColumn("line", tx.preprocess("raw")).join(parts, "raw", "left").join(found, "part", "left")
    empty = F.col("n_parts").isNull()
    skip = F.when(empty, F.when(F.col("line") == "", "empty after preprocessing").otherwise("")).otherwise(F.col("skip"))
    state = F.when(empty, F.when(F.col("line") == "", "skipped").otherwise("unmatched")).otherwise(F.col("state"))
    return written(rows.select("raw", "line", "part_no", F.coalesce("n_parts", F.lit(0).cast("long")).alias("n_parts"), "part", skip.alias("skip"), "ing",
        state.alias("state"), *MATCH, "breakdown"), "text-parts")


def with_texts(lines: DataFrame, texts: DataFrame, how: str = "inner") -> DataFrame:
    """``lines (raw, ...)`` with what is known of their texts in ``texts (raw, ...)``: one join, and lines are not moved if texts are few."""
    known = texts.withColumnRenamed("raw", "known_raw")
    return lines.join(known, F.col("raw").eqNullSafe(F.col("known_raw")), how).drop("known_raw")


def nested_results(found: DataFrame) -> DataFrame:
    """``match_parts`` as one row a line: ``matches`` of a line of one part; else ``alternatives``, each with its own, and no matches.

    A part's ``matches`` are in order of rank, ``alternatives`` in that of parts;
    both are as short as ``top_k`` and a line's text make them.
    """
    hits = F.array_sort(F.collect_list(F.when(F.col("match_rank").isNotNull(), F.struct(*MATCH)))).alias("matches")
    parts = found.groupBy("line_id", "line", "part_no", "n_parts", "part", "skip", "ing", "state").agg(hits)
    part = F.struct("part_no", "part", "ing", "state", "skip", "matches")
    lines = parts.groupBy("line_id", "line", "n_parts").agg(F.array_sort(F.collect_list(part)).alias("parts"))
    single = F.col("n_parts") == 1
    first = F.element_at("parts", 1)
    none = F.filter(first["matches"], lambda m: F.lit(False))
    return lines.select(
        "line_id", "line",
        F.when(single, first["ing"]).otherwise("").alias("ing"),
        F.when(F.col("n_parts") <= 1, first["skip"]).otherwise("").alias("skip"),
        F.when(single, first["matches"]).otherwise(none).alias("matches"),
        F.when(F.col("n_parts") > 1, F.col("parts")).alias("alternatives"),
    )


def nested_lines(lines: DataFrame, catalog: DataFrame, cfg: MatchConfig = MatchConfig(top_k=3)) -> DataFrame:
    """``nested_results`` of the parts of ``lines (line_id, raw)``, worked out once for each distinct text."""
    whole = lines.select("line_id", "raw").distinct()
    nested = nested_results(text_parts(whole.select("raw"), catalog, cfg).withColumnRenamed("raw", "line_id")).withColumnRenamed("line_id", "raw")
    return with_texts(whole, written(nested, "nested-texts")).drop("raw")


def line_parts(lines: DataFrame) -> DataFrame:
    """``(line_id, part_no, n_parts, part)``: the alternatives and compounds of each line, each cleaned key once."""
    texts = lines.select("raw").distinct().withColumn("line", tx.preprocess("raw"))
    alts = texts.select("raw", F.posexplode(tx.split_alternatives("line")).alias("a", "alt"))
    parts = alts.select("raw", "a", F.posexplode(tx.split_compound("alt")).alias("b", "part")).withColumn("key", tx.basic_clean("part")).where("key <> ''")
    first = Window.partitionBy("raw", "key").orderBy("a", "b")
    parts = parts.withColumn("again", F.row_number().over(first)).where("again = 1")
    parts = parts.withColumn("part_no", F.row_number().over(Window.partitionBy("raw").orderBy("a", "b")) - 1).withColumn("n_parts",
        F.count("*").over(Window.partitionBy("raw")))
    return lines.select("line_id", "raw").join(parts.select("raw", "part_no", "n_parts", "part"), "raw").drop("raw")


def match_table(lines: DataFrame, catalog: DataFrame, cfg: MatchConfig = MatchConfig(top_k=3)) -> DataFrame:
    """One row per match of each line of ``lines (line_id, raw, ...)``, or one row of nulls if it has none.

    A line_id stands for one text; its rows may repeat. Lines with one part are
    matched; skipped ones give no row. A line of several parts, or of none, is kept
    as a row without a match.
    """
    texts = written(lines.select("raw").distinct(), "line-texts")
    parts = line_parts(texts.select(F.col("raw").alias("line_id"), "raw"))
    single = parts.where("n_parts = 1").select(F.col("line_id").alias("whole"), F.col("part").alias("raw"))
    clean = written(normalized_lines(single), "clean-texts")
    matches = match_ingredients(clean.where("skip = ''").select("ing").distinct(), catalog, cfg)
    skipped = clean.where("skip <> ''").select("whole").union(texts.where(tx.preprocess("raw") == "").select("raw"))
    hits = clean.where("skip = ''").select("whole", "ing").join(matches.select("ing", *MATCH), "ing")
    kept = texts.join(skipped, F.col("raw").eqNullSafe(F.col("whole")), "left_anti").join(hits.withColumnRenamed("whole", "raw"), "raw", "left")
    return with_texts(lines, written(kept, "text-matches")).select(*lines.columns, "ing", *MATCH)


def run_counters(table: DataFrame) -> DataFrame:
    """How many lines a match table holds, and how many have no match."""
    return table.agg(F.countDistinct("line_id").alias("lines"), F.count(F.when(F.col("match_rank").isNull(), 1)).alias("no_match"),
        F.count("match_rank").alias("matches"))
