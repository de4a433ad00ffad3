"""DuckDB expressions of the text operators, for the checking SQL."""

from __future__ import annotations

from collections.abc import Sequence

from basketry.functions import lexicon as lx
from basketry.functions import text as tx


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def words_list(words: Sequence[str]) -> str:
    return "[" + ", ".join(q(w) for w in words) + "]"


def rep(x: str, pattern: str, to: str = " ") -> str:
    return f"regexp_replace({x}, {q(pattern)}, {q(to)}, 'g')"


def strip(x: str) -> str:
    return rep(x, r"^\s+|\s+$", "")


def spaces(x: str) -> str:
    return strip(rep(x, r"\s+", " "))


def words(x: str) -> str:
    return f"list_filter(string_split_regex({x}, '\\s+'), lambda w: w <> '')"


def basic_clean(x: str) -> str:
    out = rep(rep(f"lower({strip(f"coalesce({x}, '')")})", r"\([^)]*\)"), r"\[[^\]]*\]")
    return spaces(rep(rep(out, "&", " and "), r"[^a-zA-Z\s]"))


def numbers(x: str) -> str:
    return rep(rep(rep(x, r"\b\d+\s*-\s*\d+/\d+\b"), r"\b\d+/\d+\b"), r"\b\d+(?:\.\d+)?\b")


def singular(w: str) -> str:
    return f"""case when length({w}) <= 3 then {w} when {w} like '%ies' and length({w}) > 4 then concat(substr({w}, 1, length({w}) - 3), 'y')
        when {w} like '%oes' and length({w}) > 4 then substr({w}, 1, length({w}) - 2)
        when {w} like '%s' and {w} not like '%ss' then substr({w}, 1, length({w}) - 1) else {w} end"""


def any_of(x: str, parts: Sequence[str]) -> str:
    return "(" + " or ".join(f"contains({x}, {q(p)})" for p in parts) + ")"


def has(pattern: str, x: str) -> str:
    return f"regexp_matches({x}, {q(pattern)})"


def chain(source: str, steps: Sequence[tuple[str, str]], final: str) -> str:
    """Each step adds a column; ``final`` selects from ``last``."""
    ctes, before = [f"s0 as ({source})"], "s0"
    for i, (name, expr) in enumerate(steps, 1):
        ctes.append(f"s{i} as (select *, {expr} as {name} from {before})")
        before = f"s{i}"
    return "with " + ", ".join(ctes) + f", last as (select * from {before}) {final}"


PREP = words_list(lx.PREP_WORDS)


def preprocess_steps(raw: str = "raw") -> list[tuple[str, str]]:
    """Steps to ``line``."""
    text = f"regexp_replace({strip(f"coalesce({raw}, '')")}, '(?i)^\\s*garnish\\s*:\\s*', '')"
    for note in ("plus more", "optional", "for finishing", "for serving"):
        text = f"regexp_replace({text}, '(?i),\\s*{note}.*$', '')"
    return [
        ("p1", text),
        ("p2", f"case when {has('^[^,]+,\\s*.+$', 'p1')} and len(list_filter({words("lower(regexp_extract(p1, '^[^,]+,\\s*(.+)$', 1))")}, lambda w: not list_contains({PREP}, w))) > 0 then {strip("regexp_extract(p1, '^([^,]+),', 1)")} else p1 end"),
        ("p3", rep("p2", r"\(\s*or\s+[^)]+\)", "")),
        ("p4", "regexp_extract(p3, '(?i)^(.*?)\\s+or\\s+', 1)"),
        ("p5", f"case when {has('(?i)\\s+or\\s+', 'p3')} and not list_contains({PREP}, lower(regexp_extract(p4, '(\\S+)\\s*$', 1))) then {strip('p4')} else p3 end"),
        ("line", f"case when {has('(?i)^\\s*plus\\s+\\d+.*$', 'p5')} then '' else {strip('p5')} end"),
    ]


def skip_steps() -> list[tuple[str, str]]:
    """Steps from ``line`` to ``skip``."""
    return [
        ("t", basic_clean("line")),
        ("bare", spaces(numbers("t"))),
        ("tw", words("t")),
        (
            "skip",
            f"""case when t = '' then 'empty' when list_contains({words_list(lx.SKIP_EXACT)}, t) then 'non-ingredient fragment'
            when {any_of('t', lx.COOKWARE)} then 'cookware/container phrase' when list_contains({words_list(lx.SKIP_PHRASES)}, t) then 'non-ingredient fragment'
            when len(tw) > 0 and len(list_filter(tw, lambda w: not list_contains({words_list(lx.PREP_ONLY)}, w))) = 0 then 'prep-only fragment'
            when list_contains({words_list(lx.BARE_ADJECTIVES)}, bare) then 'bare adjective fragment'
            when {any_of('t', ('plus more', 'for serving', 'for finishing'))} then 'serving note'
            when {any_of('t', lx.SKIP_CONTAINS)} then 'prep instruction fragment'
            when t like 'plus %' and {any_of('t', ('room temperature', 'optional'))} then 'leftover modifier fragment'
            when bare in ('hot water', 'warm water', 'cold water', 'water') then 'skip water' when contains(bare,
              'lemon wheel') then 'garnish fragment' else '' end""",
        ),
    ]


def normalize_steps() -> list[tuple[str, str]]:
    """Steps from ``line`` to ``ing``."""
    text = numbers("rc")
    for phrase in lx.TAIL_PHRASES:
        text = rep(text, rf"\b{phrase}\b.*$", " ")
    text = rep(text, r"^garnish\s*", " ")
    for pattern, name in tx._REWRITES:
        text = rep(text, pattern, name)
    spirits = " ".join(f"when {q(k)} then {q(v)}" for k, v in lx.SPIRIT_SYNONYMS.items())
    synonyms = " ".join(f"when {q(k)} then {q(v)}" for k, v in lx.SYNONYMS.items())
    return [
        ("g0", basic_clean("line")),
        ("g1", strip(rep("g0", r"^garnish\s*", ""))),
        ("garn", "case when g0 like 'garnish%' then case when contains(g1, 'cinnamon') then 'cinnamon' when contains(g1, 'peppercorn') then 'peppercorns' when contains(g1, 'lemon') then 'lemon' when contains(g1, 'orange') then 'orange' else g1 end else line end"),
        ("rc", basic_clean("garn")),
        ("n1", text),
        ("n2", f"list_transform(list_filter({words('n1')}, lambda w: not list_contains({words_list([*lx.UNITS, *lx.PREP_WORDS])}, w)), lambda w: {singular('w')})"),
        ("n3", f"array_to_string(list_filter(list_transform(n2, lambda w: case when w = 'scotch' and {any_of('rc', ('bonnet', 'pepper', 'chile', 'chili'))} then w else case w {spirits} else w end end), lambda w: w <> 'of'), ' ')"),
        ("n4", f"case n3 {synonyms} else n3 end"),
        ("n5", f"{words('n4')}"),
        ("n6", "array_to_string(list_filter(n5, lambda w, i: i = 1 or w <> n5[i - 1]), ' ')"),
        ("n7", "case when contains(n6, 'round italian loaf') then 'italian bread' when n6 like '% loaf' then replace(n6, ' loaf', ' bread') else n6 end"),
        ("n8", f"case when {has(' (wheel|wedge|twist)$', 'n7')} then regexp_extract(n7, '^(\\S+)', 1) else n7 end"),
        (
            "ing",
            f"""case when contains(rc, 'dal') and contains(rc, 'masoor') then 'red lentils' when contains(rc, 'dal') then 'lentils' when contains(rc,
    'giblet stock') then 'chicken broth'
            when {any_of('rc', ('jasmine rice', 'long grain rice'))} then 'rice' when contains(rc, 'new potato') then 'potato' when contains(rc,
              'acorn') and contains(rc, 'squash') then 'acorn squash'
            when {any_of('rc', ('pink lady', 'gala'))} and (contains(n8, 'apple') or contains(rc, 'apple')) then 'apple' else {spaces('n8')} end""",
        ),
    ]


def catalog_norm(x: str) -> str:
    return f"array_to_string(list_transform({words(basic_clean(x))}, lambda w: {singular('w')}), ' ')"


def lcs(a: str, b: str) -> str:
    """LCS length, the shorter text as bits."""
    small, large = f"case when length({a}) <= length({b}) then {a} else {b} end", f"case when length({a}) <= length({b}) then {b} else {a} end"
    n, full = f"length({small})", f"((1::bigint << length({small})) - 1)"
    mask = f"list_reduce(list_transform(range(1, {n} + 1), lambda i: case when substr({small}, i, 1) = c then 1::bigint << (i - 1)::int else 0::bigint end), lambda x, y: x | y)"
    fold = f"list_reduce(list_transform(string_split({large}, ''), lambda c: {mask}), lambda s, m: ((s + (s & m)) | (s - (s & m))) & {full}, {full})"
    return f"case when {n} = 0 then 0 else {n} - bit_count({fold}) end"


def ratio(a: str, b: str) -> str:
    return f"case when length({a}) + length({b}) = 0 or {a} = {b} then 100.0::double else 200.0::double * ({lcs(a, b)}) / (length({a}) + length({b})) end"


def token_sort(x: str) -> str:
    return f"array_to_string(list_sort({words(x)}), ' ')"


def round2(x: str) -> str:
    return f"floor(({x}) * 100 + 0.5) / 100"
