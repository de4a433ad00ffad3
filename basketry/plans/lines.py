"""Registered queries on whole shopping lines and on the grocery rules, each with its checking SQL."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.functions import lexicon as lx
from basketry.operators import matching
from basketry.operators import rules as rl
from basketry.plans import duck as dk
from basketry.plans import queries as core
from basketry.plans.fixtures import spark_sql, table
from basketry.plans.registry import register
from basketry.sources import tables

# --- grocery rules ----------------------------------------------------------


def test_sql(test: rl.Test, x: str) -> str:
    """A rule's test on a text, as a condition."""

    def word(w: str) -> str:
        return f"contains({x}, {dk.q(w)})" if re.search(r"[^a-zA-Z\s]", w) else dk.has(rf"\b{w}\b", x)

    out = []
    if test.eq:
        out.append(f"{x} in ({', '.join(map(dk.q, test.eq))})")
    if test.any:
        out.append(dk.any_of(x, test.any))
    out += [f"contains({x}, {dk.q(w)})" for w in test.all]
    if test.none:
        out.append(f"not {dk.any_of(x, test.none)}")
    if test.token:
        out.append(f"list_has_any(string_split({x}, ' '), {dk.words_list(test.token)})")
    if test.word:
        out.append("(" + " or ".join(map(word, test.word)) + ")")
    if test.no_word:
        out.append("not (" + " or ".join(map(word, test.no_word)) + ")")
    if test.end:
        out.append(f"ends_with({x}, {dk.q(test.end)})")
    return " and ".join(out) or "true"


def rule_sql(rule: rl.Rule) -> str:
    """Does a rule hold for ``ing`` and a product's ``description_norm``, ``categories_norm`` and ``classifier_norm``?"""
    fields = {"D": "description_norm", "C": "categories_norm", "K": "classifier_norm"}
    sides = [test_sql(rule.n, "ing")]
    sides += ["(" + " or ".join(f"({test_sql(test, fields[one])})" for one in name) + ")" for name, test in rule.p]
    return " and ".join(f"({x})" for x in sides)


def channel_sql(rules: Sequence[rl.Rule], channel: str) -> str:
    return " + ".join(["0.0", *(f"case when {rule_sql(r)} then {float(r.weight)} else 0.0 end" for r in rules if r.channel == channel)])


def _example(test: rl.Test, turn: int) -> str:
    """A text that passes the test, by another of its words each turn."""

    def one(words: Sequence[str]) -> list[str]:
        return [words[turn % len(words)]] if words else []

    if test.eq:
        return one(test.eq)[0]
    parts = [*test.all, *one(test.any), *one(test.token), *one(test.word)]
    return ("plain" + test.end if test.end else " ".join(parts)) or "plain thing"


@cache
def _examples() -> str:
    """Texts for both sides of each rule, as rows ``(i, e_ing, e_desc, e_cat, e_class)``."""
    rows = []
    for turn in range(3):
        for rule in rl.default_rules():
            fields = dict.fromkeys("DCK", "")
            for name, test in rule.p:
                fields[name[turn % len(name)]] = _example(test, turn)
            rows.append((_example(rule.n, turn), fields["D"] or "plain thing", fields["C"], fields["K"]))
    listed = ", ".join(f"({i}, {', '.join(map(dk.q, row))})" for i, row in enumerate(rows))
    return f"select * from (values {listed}) as t(i, e_ing, e_desc, e_cat, e_class)"


def _grocery_pairs() -> str:
    """Each part as a pair of an ingredient and a product, of one rule's words or of two; every other product has the part's name too."""
    n = len(rl.default_rules()) * 3
    return f"""
        select p_partkey, a.e_ing as ing, case when p_size % 2 = 0 then b.e_desc else concat(b.e_desc, ' ', p_name) end as description_norm,
               b.e_cat as categories_norm, b.e_class as classifier_norm
        from {{part}} join ({_examples()}) a on a.i = p_partkey % {n}
        join ({_examples()}) b on b.i = case when p_size % 3 = 0 then (p_partkey * 7 + p_size) % {n} else p_partkey % {n} end"""


_RULES = rl.default_rules()
_NAMES = sorted({r.name for r in _RULES})
_FIRED = ", ".join(f"case when {' or '.join(rule_sql(r) for r in _RULES if r.name == name)} then '{name}' end" for name in _NAMES)


@register(f"""
    with pairs as ({_grocery_pairs()})
    select p_partkey, ing, description_norm, {', '.join(f'({channel_sql(_RULES, c)})::double as {c}' for c in rl.CHANNELS)},
           array_to_string(list_filter([{_FIRED}], lambda x: x is not null), ',') as fired
    from pairs""")
def grocery_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the default rules say of pairs of texts, each rule's own words among them."""
    pairs = spark_sql(spark, sf_dir, _grocery_pairs())
    side = rl.product_side(_RULES, {"D": F.col("description_norm"), "C": F.col("categories_norm"), "K": F.col("classifier_norm")})
    sided = pairs.withColumn("n", rl.ingredient_side(_RULES, F.col("ing"))).withColumn("p", side)
    sums = [rl.channel_sum(_RULES, c)(F.col("n"), F.col("p")).alias(c) for c in rl.CHANNELS]
    names = F.array(*[F.lit(r.name) for r in _RULES])
    fired = F.array_join(F.array_sort(F.array_distinct(F.transform(F.array_intersect("n", "p"), lambda i: F.get(names, i)))), ",")
    return sided.select("p_partkey", "ing", "description_norm", *sums, fired.alias("fired"))


_SHELF = """
    select p_partkey, case p_partkey % 14 when 0 then 'olive oil' when 1 then 'cheddar cheese' when 2 then 'salted butter' when 3 then 'peanut butter' when 4 then 'garlic'
             when 5 then 'red onion' when 6 then 'pearl onion' when 7 then 'lime' when 8 then 'rosemary' when 9 then 'sage' when 10 then 'thyme' when 11 then 'celery'
             when 12 then 'chicken breast' else 'baby spinach' end as ing,
           concat(p_name, ' ', case p_size % 17 when 0 then 'body oil' when 1 then 'cheese snack sticks' when 2 then 'shea butter' when 3 then 'butter' when 4 then 'garlic paste'
             when 5 then 'green onion' when 6 then 'pearls' when 7 then 'leek soup' when 8 then 'lime juice sauce' when 9 then 'rosemary crackers' when 10 then 'glazed carrot'
             when 11 then 'celery root' when 12 then 'celery seed' when 13 then 'celery seed stalks' when 14 then 'chicken tenders' when 15 then 'spinach dip'
             else 'leeks and shampoo' end) as description_norm,
           case p_partkey % 5 when 0 then 'produce' when 1 then 'pantry baking' when 2 then 'dairy meat' when 3 then 'beauty' else 'spices' end as categories_norm,
           case p_size % 4 when 0 then 'dairy' when 1 then 'produce' else '' end as classifier_norm
    from {part}"""


def _says(text: str, *terms: str) -> str:
    return "(" + " or ".join(f"contains({text}, '{t}')" for t in terms) + ")"


def _worth(when: str, points: int) -> str:
    return f"case when {when} then {points}.0::double else 0.0::double end"


_D, _C, _K = "description_norm", "categories_norm", "classifier_norm"
# written out by hand from what each rule is to do, not from the table of rules
_OIL, _CHEESE, _PLAIN_BUTTER = _says("ing", "olive oil"), _says("ing", "cheese"), f"{_says('ing', 'butter')} and not {_says('ing', 'peanut', 'almond', 'cashew', 'apple')}"
_PLAIN_ONION = f"{_says('ing', 'onion')} and not {_says('ing', 'pearl')}"
_HAND = {
    "penalty": [
        (f"{_OIL} and {_says(_C, 'beauty', 'personal care')}", 50), (f"{_OIL} and {_says(_D, 'soap', 'hair', 'skin', 'body')}", 50),
        (f"{_CHEESE} and {_says(_D, 'cracker', 'dip', 'snack', 'stick')}", 24), (f"{_PLAIN_BUTTER} and {_says(_D, 'shea butter', 'nut butter', 'body butter')}", 40),
        (f"{_PLAIN_BUTTER} and {_says(_D, 'shampoo')}", 50), (f"ing = 'garlic' and {_says(_D, 'paste', 'stir in')}", 8),
        (f"{_PLAIN_ONION} and {_says(_D, 'green onion', 'scallion')}", 20), (f"{_PLAIN_ONION} and {_says(_D, 'pearl')}", 35),
        (f"{_PLAIN_ONION} and list_has_any(string_split({_D}, ' '), ['leek', 'leeks'])", 30), (f"ing = 'lime' and {_says(_D, 'juice')}", 18),
        (f"ing = 'lime' and {_says(_D, 'sauce')}", 20), (f"ing = 'rosemary' and {_says(_D, 'crisps', 'cracker', 'snack')}", 25),
        (f"ing = 'sage' and {_says(_D, 'sausage', 'carrot', 'glazed', 'snack')}", 14), (f"ing = 'celery' and {_says(_D, 'root', 'celeriac')}", 40),
        (f"ing = 'celery' and {_says(_D, 'seed')} and not {_says(_D, 'stalk')}", 30), (f"ing = 'chicken breast' and {_says(_D, 'nugget', 'tender', 'patty', 'breaded')}", 30),
        (f"ing = 'baby spinach' and {_says(_D, 'dip', 'kit')}", 20),
    ],
    "category": [
        (f"{_OIL} and {_says(_C, 'pantry', 'baking')}", 6), (f"{_CHEESE} and {_says(_C, 'dairy')}", 10), (f"{_PLAIN_BUTTER} and ({_says(_C, 'dairy')} or {_says(_K, 'dairy')})", 10),
        (f"ing = 'garlic' and {_says(_C, 'produce')}", 10), (f"{_PLAIN_ONION} and {_says(_C, 'produce')}", 12), (f"ing = 'lime' and {_says(_C, 'produce')}", 14),
        (f"ing = 'rosemary' and {_says(_C, 'produce', 'spices')}", 10), (f"ing in ('sage', 'thyme') and {_says(_C, 'produce', 'spices')}", 8),
        (f"ing in ('celery', 'baby spinach') and {_says(_C, 'produce')}", 8), (f"ing = 'chicken breast' and {_says(_C, 'meat', 'seafood')}", 8),
    ],
    "form": [(f"{_OIL} and {_says(_D, 'oil')}", 8)],
}
_TWELVE = [f"R{i}" for i in range(10, 22)]


@register(f"""with shelf as ({_SHELF}) select p_partkey, ing, description_norm,
    {', '.join(f"{' + '.join(_worth(*x) for x in own)} as {channel}" for channel, own in _HAND.items())} from shelf""")
def twelve_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve of the default rules on groceries that were not made from them."""
    own = [r for r in _RULES if r.name in _TWELVE]
    pairs = spark_sql(spark, sf_dir, _SHELF)
    side = rl.product_side(own, {"D": F.col(_D), "C": F.col(_C), "K": F.col(_K)})
    sided = pairs.withColumn("n", rl.ingredient_side(own, F.col("ing"))).withColumn("p", side)
    return sided.select("p_partkey", "ing", "description_norm", *[rl.channel_sum(own, c)(F.col("n"), F.col("p")).alias(c) for c in _HAND])


# --- lines, parts and their matches -------------------------------------------

_SIMPLE = dk.spaces(dk.numbers(dk.basic_clean("garn")))
_OR = f"list_filter(list_transform(string_split_regex(simple, '(?i)\\s+(?:and/or|or)\\s+'), lambda p: {dk.rep('p', '^[ ,]+|[ ,]+$', '')}), lambda p: length(p) > 1)"
_OR_NAMES = f"""list_transform(alts, lambda p: case when {dk.any_of('p', ('jasmine rice', 'long grain rice'))} then 'rice'
    when contains(p, 'giblet stock') then 'chicken broth' when contains(p, 'dal') then 'lentils' else p end)"""
_AND = f"list_filter(list_transform(string_split_regex(line, '(?i)\\s+and\\s+'), lambda p: {dk.rep('p', '^[ ,]+|[ ,]+$', '')}), lambda p: p <> '')"
_PARTS = f"""
    pre as materialized ({dk.chain("select distinct raw from {shopping_lines}", dk.preprocess_steps(), "select raw, line from last")}),
    alt as ({dk.chain(
        "select distinct line as raw from pre",
        [*dk.preprocess_steps(), *dk.normalize_steps()[:3], ("simple", _SIMPLE), ("alts", _OR), ("named", _OR_NAMES)],
        '''select raw as whole, case when line = '' then [] when contains(simple, ' or ') and len(named) > 0
           then list_filter(named, lambda p, i: list_position(named, p) = i) else [garn] end as options from last''',
    )}),
    opened as (select whole, unnest(options) as option, unnest(range(0, len(options))) as a from alt),
    compound as ({dk.chain(
        "select distinct option as raw from opened", [*dk.preprocess_steps(), ("lc", dk.basic_clean("line"))],
        f'''select raw as option, case when line = '' then [] when contains(lc, 'salt') and contains(lc, 'pepper') and contains(lc, ' and ')
           then {_AND} else [line] end as pieces from last''',
    )}),
    piece as (select whole, a, unnest(pieces) as part, unnest(range(0, len(pieces))) as b from opened join compound using (option)),
    keyed as (select *, {dk.basic_clean('part')} as key from piece),
    first_part as (select * from (select *, row_number() over (partition by whole, key order by a, b) as again from keyed where key <> '') where again = 1),
    parts as materialized (
      select whole, part, row_number() over (partition by whole order by a, b) - 1 as part_no, count(*) over (partition by whole) as n_parts from first_part),
    named as ({dk.chain(
        "select distinct part as raw from parts", [*dk.preprocess_steps(), *dk.skip_steps(), *dk.normalize_steps()],
        "select raw as part, case when skip = '' and ing = '' then 'empty after normalization' else skip end as skip, case when skip = '' then ing else '' end as ing from last",
    )}),
    ings as materialized (select distinct ing from named where skip = '')"""
_BAD = dk.has("|".join(lx.BAD_CATEGORY_WORDS), "categories_norm")
_FOUND = f"{_PARTS}, {core.score_sql(core._RULE_SQL, _BAD)}, {core._RANK}, {core._BEST}, {core._PICK.format(src='good')}"
_MATCH = 'match_rank, "productId", description, brand, min_price, score'
_CONFIDENCE = "case when total >= 130 then 'high' when total >= 100 then 'medium' when total is not null then 'low' end as confidence"
_TABLE = f"""
    with {_FOUND},
    about as (select whole, max(n_parts) as n_parts, max(case when n_parts = 1 then skip end) as skip, max(case when n_parts = 1 then ing end) as ing from parts join named using (part) group by whole)
    select line_id, recipe_id, raw, p.ing as ing, {_MATCH}, {_CONFIDENCE}
    from {{shopping_lines}} join pre using (raw) left join about on whole = line left join picked p on p.ing = about.ing and about.skip = ''
    where line <> '' and not (coalesce(n_parts, 0) = 1 and skip <> '')"""


@register(_TABLE)
def match_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "shopping_lines").select("line_id", "recipe_id", "raw")
    found = matching.match_table(lines, core._catalog(spark, sf_dir), core.CONFIG)
    return found.withColumn("match_rank", F.col("match_rank").cast("long")).withColumn("score", F.col("score").cast("double"))


@register(f"select count(distinct line_id) as lines, count(case when match_rank is null then 1 end) as no_match, count(match_rank) as matches from ({_TABLE})")
def match_run_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.run_counters(match_table(spark, sf_dir))


_BREAKDOWN = {
    "score_desc_ratio": "ratio", "score_desc_partial": "partial", "score_desc_token": "sorted_desc", "score_combined": "sorted_combined",
        "score_keyword": "sorted_keyword",
    "overlap_score": "overlap_part", "exact_phrase_boost": "phrase_part", "category_boost": "category_part", "form_boost": "form_part",
        "penalty": "penalty_part", "final_score": "total",
}
_LINE_PARTS = f"""
    with {_FOUND},
    rows as (
      select line_id, recipe_id, line, part_no, coalesce(n_parts, 0) as n_parts, part,
             case when n_parts is null then case when line = '' then 'empty after preprocessing' else '' end else skip end as skip, named.ing as ing,
             case when n_parts is null then case when line = '' then 'skipped' else 'unmatched' end when skip <> '' then 'skipped'
                  when p.match_rank is null then 'unmatched' else 'matched' end as state,
             {_MATCH}, {_CONFIDENCE}, {', '.join(f'{dk.round2(old)} as {new}' for new, old in _BREAKDOWN.items())}
      from (select distinct line_id, recipe_id, raw from {{shopping_lines}}) l join pre using (raw) left join parts on whole = line left join named using (part) left join picked p on p.ing = named.ing and skip = '')"""


def _found_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.match_parts(table(spark, sf_dir, "shopping_lines"), core._catalog(spark, sf_dir), core.CONFIG)


@register(f"{_LINE_PARTS} select * exclude (recipe_id) from rows")
def match_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part of every line in its state, with its matches and what their scores are made of."""
    found = _found_parts(spark, sf_dir)
    whole = {c: F.col(c).cast("long") for c in ("part_no", "n_parts", "match_rank")}
    parts = [F.col(f"breakdown.{n}").cast("double").alias(n) for n in _BREAKDOWN]
    return found.withColumns(whole).withColumn("score", F.col("score").cast("double")).select("*", *parts).drop("breakdown")


@register(f"""{_LINE_PARTS},
    each as (select line_id, line, n_parts, part_no, part, state, count(match_rank) as hits from rows group by all)
    select line_id, line, case when n_parts = 1 then sum(hits) else 0 end::bigint as matches,
           case when n_parts > 1 then string_agg(concat(part, '=', state, ':', hits), '; ' order by part_no) end as alternatives
    from each group by line_id, line, n_parts""")
def nested_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a line: its matches, or its alternatives with theirs."""
    found = matching.nested_lines(table(spark, sf_dir, "shopping_lines"), core._catalog(spark, sf_dir), core.CONFIG)
    shown = F.transform("alternatives", lambda p: F.concat(p["part"], F.lit("="), p["state"], F.lit(":"), F.size(p["matches"]).cast("string")))
    return found.select("line_id", "line", F.size("matches").cast("long").alias("matches"), F.array_join(shown, "; ").alias("alternatives"))


_PRICE = "case when coalesce(min_price, 0) = 0 then 'price N/A' else printf('$%.2f', min_price) end"


@register(f"""{_LINE_PARTS},
    shown as (select *, max(case when state = 'matched' then 1 else 0 end) over (partition by recipe_id, line_id) = 1 as any_match from rows where not (n_parts <= 1 and state = 'skipped')),
    texts as (
      select distinct recipe_id, null as line_id, -1 as part_no, -3 as rank, concat('Recipe: ', 'No. ', recipe_id) as text from rows
      union all
      select distinct recipe_id, line_id, -1, -2, concat('Ingredient: ', case when n_parts = 1 then part else line end, case when n_parts <> 1 and any_match then '  [split]' else '' end) from shown
      union all
      select distinct recipe_id, line_id, -1, -1, '  No match found' from shown where not any_match
      union all
      select distinct recipe_id, line_id, part_no, -1, concat('  Ingredient: ', part) from shown where n_parts <> 1 and state = 'matched'
      union all
      select recipe_id, line_id, part_no, match_rank, concat(case when n_parts = 1 then '  ' else '    ' end, '-> [', brand, '] ', description, ' | ', {_PRICE}, ' | score: ', printf('%.2f', score))
      from shown where state = 'matched')
    select recipe_id, row_number() over (partition by recipe_id order by line_id nulls first, part_no, rank) - 1 as line_no, text from texts""")
def split_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of a run, with the parts of split lines under them."""
    lines = table(spark, sf_dir, "shopping_lines").select("line_id", "recipe_id", F.concat(F.lit("No. "), "recipe_id").alias("title"), "raw")
    found = matching.text_parts(lines, core._catalog(spark, sf_dir), core.CONFIG).withColumn("score", F.col("score").cast("double"))
    return tables.split_report_of_texts(lines, found)
