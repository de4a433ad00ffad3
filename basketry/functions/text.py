"""Text operators on single values: every function takes and returns Columns.

Patterns stay in the part of regular-expression syntax that Java and RE2 share.
Null text counts as empty unless a docstring says otherwise.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from basketry.functions import lexicon as lx

NUMBER = r"^\s*[0-9]+(\.[0-9]+)?\s*$"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _words(x: Column) -> Column:
    """Non-empty words of a text."""
    return F.filter(F.split(x, r"\s+"), lambda w: w != "")


def _any(x: Column, parts: Sequence[str]) -> Column:
    """Whether any part is a substring."""
    return x.rlike("|".join(re.escape(p) for p in parts)) if parts else F.lit(False)


def _array(words: Sequence[str]) -> Column:
    return F.array(*[F.lit(w) for w in words]) if words else F.array().cast("array<string>")


def _lookup(table: Mapping[str, str], key: Column) -> Column:
    """The key's entry, or null."""
    if not table:
        return F.lit(None).cast("string")
    return F.try_element_at(F.create_map(*[F.lit(v) for item in table.items() for v in item]), key)


def strip(x: Column | str) -> Column:
    return F.regexp_replace(_col(x), r"^\s+|\s+$", "")


def safe_str(x: Column | str) -> Column:
    """Null is empty; the rest is trimmed text."""
    return strip(F.coalesce(_col(x).cast("string"), F.lit("")))


def to_price(x: Column | str) -> Column:
    """The first plain decimal of a price text such as ``$3.99``; null without one."""
    number = F.regexp_extract(F.replace(_col(x), F.lit(","), F.lit("")), r"([0-9]+(\.[0-9]+)?)", 1)
    return F.nullif(number, F.lit("")).try_cast("double")


def parse_min_price(x: Column | str) -> Column:
    """Least positive number of a list joined by ``;``. Only plain decimals count."""
    numbers = F.transform(F.filter(F.split(F.coalesce(_col(x), F.lit("")), ";"), lambda p: p.rlike(NUMBER)), lambda p: strip(p).try_cast("double"))
    return F.array_min(F.filter(numbers, lambda v: v > 0))


def normalize_spaces(x: Column | str) -> Column:
    return strip(F.regexp_replace(_col(x), r"\s+", " "))


def strip_brackets(x: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(_col(x), r"\([^)]*\)", " "), r"\[[^\]]*\]", " ")


def remove_numbers(x: Column | str) -> Column:
    """Drop ranges with fractions, fractions and numbers, in this order."""
    out = _col(x)
    for pattern in (r"\b\d+\s*-\s*\d+/\d+\b", r"\b\d+/\d+\b", r"\b\d+(?:\.\d+)?\b"):
        out = F.regexp_replace(out, pattern, " ")
    return out


def basic_clean(x: Column | str) -> Column:
    """Lower case, without brackets; only ASCII letters and single spaces stay."""
    out = strip_brackets(F.lower(safe_str(x)))
    out = F.regexp_replace(out, "&", " and ")
    return normalize_spaces(F.regexp_replace(out, r"[^a-zA-Z\s]", " "))


def singularize(w: Column) -> Column:
    n = F.length(w)
    return (
        F.when(n <= 3, w)
        .when(w.endswith("ies") & (n > 4), F.concat(w.substr(F.lit(1), n - 3), F.lit("y")))
        .when(w.endswith("oes") & (n > 4), w.substr(F.lit(1), n - 2))
        .when(w.endswith("s") & ~w.endswith("ss"), w.substr(F.lit(1), n - 1))
        .otherwise(w)
    )


def dedupe_adjacent(words: Column | str) -> Column:
    """An array without elements equal to the one before."""
    words = _col(words)
    return F.filter(words, lambda x, i: (i == 0) | (x != F.get(words, i - 1)))


def preprocess(x: Column | str, prep: Sequence[str] = lx.PREP_WORDS) -> Column:
    """A shopping line without garnish mark, serving notes and alternatives; empty for ``plus 2 ...``.

    Of a comma list the first item stays, unless the rest is preparation words only.
    Text from the first `` or `` on goes, unless the word before it is one of them.
    """
    text = safe_str(x)
    text = F.regexp_replace(text, r"(?i)^\s*garnish\s*:\s*", "")
    for note in ("plus more", "optional", "for finishing", "for serving"):
        text = F.regexp_replace(text, rf"(?i),\s*{note}.*$", "")
    prep_words = _array(prep)

    def first_item(t: Column) -> Column:
        rest = F.lower(F.regexp_extract(t, r"^[^,]+,\s*(.+)$", 1))
        listed = t.rlike(r"^[^,]+,\s*.+$") & ~F.forall(_words(rest), lambda w: F.array_contains(prep_words, w))
        return F.when(listed, strip(F.regexp_extract(t, r"^([^,]+),", 1))).otherwise(t)

    def first_choice(t: Column) -> Column:
        before = F.regexp_extract(t, r"(?i)^(.*?)\s+or\s+", 1)
        last = F.lower(F.regexp_extract(before, r"(\S+)\s*$", 1))
        return F.when(t.rlike(r"(?i)\s+or\s+") & ~F.array_contains(prep_words, last), strip(before)).otherwise(t)

    text = let(F.regexp_replace(let(text, first_item), r"\(\s*or\s+[^)]+\)", ""), first_choice)
    return let(text, lambda t: F.when(t.rlike(r"(?i)^\s*plus\s+\d+.*$"), F.lit("")).otherwise(strip(t)))


def is_cookware(x: Column | str, hints: Sequence[str] = lx.COOKWARE, whole_words: bool = False) -> Column:
    """Whether the cleaned text names a vessel. Hints count inside other words too ("potato"), unless ``whole_words``."""
    clean = basic_clean(x)
    if not whole_words:
        return _any(clean, hints)
    return clean.rlike(r"\b(" + "|".join(re.escape(h) for h in hints) + r")\b")


def strip_quantity(x: Column | str) -> Column:
    return normalize_spaces(remove_numbers(basic_clean(x)))


def skip_reason(x: Column | str, whole_words: bool = False) -> Column:
    """Why a line is no ingredient; empty if it is one. The first reason that holds counts."""

    def reason(t: Column) -> Column:
        bare = strip_quantity(t)
        words = _words(t)
        return (
            F.when(t == "", "empty")
            .when(t.isin(*lx.SKIP_EXACT), "non-ingredient fragment")
            .when(is_cookware(t, whole_words=whole_words), "cookware/container phrase")
            .when(t.isin(*lx.SKIP_PHRASES), "non-ingredient fragment")
            .when((F.size(words) > 0) & F.forall(words, lambda w: w.isin(*lx.PREP_ONLY)), "prep-only fragment")
            .when(bare.isin(*lx.BARE_ADJECTIVES), "bare adjective fragment")
            .when(_any(t, ("plus more", "for serving", "for finishing")), "serving note")
            .when(_any(t, lx.SKIP_CONTAINS), "prep instruction fragment")
            .when(t.startswith("plus ") & _any(t, ("room temperature", "optional")), "leftover modifier fragment")
            .when(bare.isin("hot water", "warm water", "cold water", "water"), "skip water")
            .when(bare.contains("lemon wheel"), "garnish fragment")
            .otherwise("")
        )

    return let(basic_clean(preprocess(x)), reason)


def garnish_core(x: Column | str) -> Column:
    """What a garnish line is about; other lines stay as they are."""

    def core(text: Column) -> Column:
        def named(rest: Column) -> Column:
            return F.when(rest.contains("cinnamon"), "cinnamon").when(rest.contains("peppercorn"), "peppercorns").when(rest.contains("lemon"),
                "lemon").when(rest.contains("orange"), "orange").otherwise(rest)

        return let(basic_clean(text), lambda clean: F.when(clean.startswith("garnish"),
            let(strip(F.regexp_replace(clean, r"^garnish\s*", "")), named)).otherwise(text))

    return let(safe_str(x), core)


def split_alternatives(x: Column | str) -> Column:
    """The alternatives of a line as an array, each cleaned key once, in order; empty for an empty line."""
    none = F.array().cast("array<string>")

    def parts_of(simple: Column) -> Column:
        parts = F.transform(F.split(simple, r"(?i)\s+(?:and/or|or)\s+"), lambda p: F.regexp_replace(p, r"^[ ,]+|[ ,]+$", ""))
        parts = F.filter(parts, lambda p: F.length(p) > 1)
        parts = F.transform(parts, lambda p: F.when(_any(p, ("jasmine rice", "long grain rice")), "rice").when(p.contains("giblet stock"),
            "chicken broth").when(p.contains("dal"), "lentils").otherwise(p))
        return F.when(simple.contains(" or "), F.array_distinct(parts)).otherwise(none)

    def split(line: Column) -> Column:
        text = garnish_core(line)
        return F.when(line == "", none).otherwise(let(let(strip_quantity(text), parts_of), lambda p: F.when(F.size(p) > 0, p).otherwise(F.array(text))))

    return let(preprocess(x), split)


def split_compound(x: Column | str) -> Column:
    """Salt-and-pepper lines as two parts, others as one; empty for an empty line."""

    def split(text: Column) -> Column:
        parts = F.filter(F.transform(F.split(text, r"(?i)\s+and\s+"), lambda p: F.regexp_replace(p, r"^[ ,]+|[ ,]+$", "")), lambda p: p != "")
        both = let(basic_clean(text), lambda c: c.contains("salt") & c.contains("pepper") & c.contains(" and "))
        return F.when(text == "", F.array().cast("array<string>")).when(both, parts).otherwise(F.array(text))

    return let(preprocess(x), split)


def normalize_ingredient(x: Column | str, units: Sequence[str] = lx.UNITS, prep: Sequence[str] = lx.PREP_WORDS,
    synonyms: Mapping[str, str] = lx.SYNONYMS) -> Column:
    """The canonical name of a shopping line's ingredient."""
    drop = _array([*units, *prep])

    def canonical(raw: Column) -> Column:
        text = remove_numbers(raw)
        for phrase in lx.TAIL_PHRASES:
            text = F.regexp_replace(text, rf"\b{phrase}\b.*$", " ")
        text = F.regexp_replace(text, r"^garnish\s*", " ")
        for pattern, name in _REWRITES:
            text = F.regexp_replace(text, pattern, name)
        no_spirit = _any(raw, ("bonnet", "pepper", "chile", "chili"))

        def token(w: Column) -> Column:
            return let(singularize(w), lambda one: F.when((one == "scotch") & no_spirit, one).otherwise(F.coalesce(_lookup(lx.SPIRIT_SYNONYMS, one), one)))

        words = F.filter(_words(text), lambda w: ~F.array_contains(drop, w))
        out = F.array_join(F.filter(F.transform(words, token), lambda w: w != "of"), " ")
        out = let(out, lambda o: F.coalesce(_lookup(synonyms, o), o))
        out = F.array_join(let(_words(out), dedupe_adjacent), " ")
        out = let(out, lambda o: F.when(o.contains("round italian loaf"), "italian bread").when(o.endswith(" loaf"),
            F.replace(o, F.lit(" loaf"), F.lit(" bread"))).otherwise(o))
        out = let(out, lambda o: F.when(o.rlike(" (wheel|wedge|twist)$"), F.regexp_extract(o, r"^(\S+)", 1)).otherwise(o))

        def override(o: Column) -> Column:
            return (
                F.when(raw.contains("dal") & raw.contains("masoor"), "red lentils")
                .when(raw.contains("dal"), "lentils")
                .when(raw.contains("giblet stock"), "chicken broth")
                .when(_any(raw, ("jasmine rice", "long grain rice")), "rice")
                .when(raw.contains("new potato"), "potato")
                .when(raw.contains("acorn") & raw.contains("squash"), "acorn squash")
                .when(_any(raw, ("pink lady", "gala")) & (o.contains("apple") | raw.contains("apple")), "apple")
                .otherwise(normalize_spaces(o))
            )

        return let(out, override)

    return let(basic_clean(garnish_core(preprocess(x, prep))), canonical)


#: Rewrites of flake and sugar names, in this order.
_REWRITES = (
    (r"\bchile flakes\b", "crushed red pepper"),
    (r"\bchili flakes\b", "crushed red pepper"),
    (r"\bred pepper flakes\b", "crushed red pepper"),
    (r"\bpepper flakes\b", "crushed red pepper"),
    (r"\bwhite sugar\b", "granulated sugar"),
    (r"\bsugar\s*\(?\s*white\b", "granulated sugar"),
    (r"\bcane sugar\b", "granulated sugar"),
)


def normalize_catalog(x: Column | str) -> Column:
    return F.array_join(F.transform(_words(basic_clean(x)), singularize), " ")


def important_tokens(normalized: Column | str, stop: Sequence[str] = lx.STOP_TOKENS) -> Column:
    """Tokens of a normalised ingredient without stop words and single letters; repeats stay."""
    return F.filter(_words(_col(normalized)), lambda w: ~w.isin(*stop) & (F.length(w) > 1))


def rejoin_fragments(items: Column | str) -> Column:
    """Put back together items that a comma split: open brackets, continuation words, short preparation notes."""
    more = r"(?i)^(" + "|".join(lx.CONTINUATION_WORDS) + ")"
    prep = r"(?i)^(" + "|".join(lx.PREP_FRAGMENTS) + ")"

    def opened(s: Column) -> Column:
        return F.length(F.regexp_replace(s, r"[^(]", "")) > F.length(F.regexp_replace(s, r"[^)]", ""))

    def step(done: Column, item: Column) -> Column:
        last = F.element_at(done, -1)
        glue = opened(last) | item.rlike(more) | (item.rlike(prep) & (F.size(_words(item)) <= 4))
        joined = F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(F.concat(last, F.lit(", "), item)))
        return F.when(F.size(done) == 0, F.array(item)).when(glue, joined).otherwise(F.concat(done, F.array(item)))

    return F.aggregate(_col(items), F.array().cast("array<string>"), step)


def parse_list_string(x: Column | str) -> Column:
    """Items of a text such as ``['a', 'b, c']``, with split fragments put back together."""
    text = strip(F.regexp_replace(safe_str(x), r"^[\[\]]+|[\[\]]+$", ""))
    parts = F.transform(F.split(text, r"['\"]\s*,\s*['\"]"), lambda p: F.regexp_replace(p, r"^['\" \t\n]+|['\" \t\n]+$", ""))
    return rejoin_fragments(F.filter(parts, lambda p: p != ""))


def word_in(phrase: str, text: Column) -> Column:
    """Whole-word test; a phrase with other than letters and spaces is looked for as it is."""
    if re.search(r"[^a-zA-Z\s]", phrase):
        return text.contains(phrase)
    return text.rlike(rf"\b{phrase}\b")


def quoted_items(x: Column | str) -> Column:
    """Items in single quotes, else in double quotes, else between commas; blank ones go."""
    text = safe_str(x)

    def found(pattern: str) -> Column:
        return F.filter(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), strip), lambda p: p != "")

    plain = F.filter(F.transform(F.split(F.regexp_replace(text, r"^[\[\]]+|[\[\]]+$", ""), ","), strip), lambda p: p != "")
    single, double = found("'([^']*)'"), found('"([^"]*)"')
    return F.when(F.size(single) > 0, single).when(F.size(double) > 0, double).otherwise(plain)


def instruction_steps(x: Column | str) -> Column:
    """Paragraphs if there are two or more, else sentences."""
    text = F.regexp_replace(F.coalesce(_col(x), F.lit("")), r"\r\n|\r", "\n")
    lines = F.filter(F.transform(F.split(text, "\n"), strip), lambda p: p != "")
    sentences = F.filter(F.transform(F.split(text, "[.!?]"), strip), lambda p: p != "")
    return F.when(F.size(lines) >= 2, lines).otherwise(sentences)


DISPLAY_QUANTITY = r"^[0-9¼½¾⅓⅔⅛⅜⅝⅞/.\s]+(tsp\.?|tbsp\.?|cups?|oz\.?|lbs?\.?|g|ml|l|pinch|dash|cloves?|slices?|pieces?)?\s*"


def display_key(x: Column | str) -> Column:
    """Grouping key of a line: lower case, without leading quantity and unit, up to the first comma."""
    text = F.regexp_replace(F.lower(safe_str(x)), DISPLAY_QUANTITY, "")
    return strip(F.regexp_replace(text, r",[\s\S]*$", ""))


def display_price(price: Column | str, zero_is_missing: bool = False) -> Column:
    price = _col(price)
    missing = price.isNull() | ((price == 0) if zero_is_missing else F.lit(False))
    return F.when(missing, "Price N/A").otherwise(F.format_string("$%.2f", F.floor(price * 100 + 0.5) / 100))


def join_address(*parts: Column | str) -> Column:
    return F.concat_ws(", ", *[F.nullif(safe_str(p), F.lit("")) for p in parts])


def fix_mojibake(x: Column | str, pairs: Sequence[tuple[str, str]] = lx.MOJIBAKE) -> Column:
    out = _col(x)
    for bad, good in pairs:
        out = F.replace(out, F.lit(bad), F.lit(good))
    return out


def search_keyword(name: Column | str, stop: Sequence[str] = lx.KEYWORD_STOPWORDS) -> Column:
    """The last three content words of a product name."""
    text = F.regexp_replace(F.lower(safe_str(name)), r"[®™°–]", " ")
    text = F.regexp_replace(text, r"\([^)]*\)", " ")
    text = F.regexp_replace(text, r"[0-9]+[0-9./]*\s*(?:oz|lb|lbs|g|kg|ml|fl|ct|pk|ea)", " ")
    text = normalize_spaces(F.regexp_replace(text, r"[^a-z\s]", " "))
    text = strip(F.regexp_replace(F.concat(F.lit(" "), text), r"( (" + "|".join(stop) + r"))+$", ""))
    words = _words(text)
    return F.array_join(F.when(F.size(words) > 3, F.slice(words, -3, 3)).otherwise(words), " ")


def round2(x: Column) -> Column:
    """Two decimals by the floor form, which engines agree on."""
    return F.floor(x * 100 + 0.5) / 100
