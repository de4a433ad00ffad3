"""Registered queries of the training-data operators, with the SQL that checks those it can express."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.llm import bpe, centroids, decontaminate, divergence, exact_dedup, language, licenses, mixing, near_dedup, substring_dedup
from basketry.llm import token_store, tool_calls, url_filter

TOKENIZER, BYTE_TOKENIZER = "word_bpe_49k.json", "byte_bpe_50k.json"
END_ID = 1
WEIGHTS = (5.0, 2.0, 1.0)
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
SCHEMAS = {
    "answer": {
        "type": "object",
        "properties": {"text": {"type": "string", "minLength": 1}, "words": {"type": "integer", "minimum": 1, "maximum": 200},
            "after": {"type": ["array", "null"], "items": {"type": "string"}}},
        "required": ["text", "words"],
        "additionalProperties": False,
    }
}


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").withColumn("held_out", F.crc32(F.col("doc_id").cast("string")) % 4 == 2)
    profiles = language.learn_profiles(docs.where("not held_out"))
    return language.identify(docs, profiles, ("doc_id", "held_out"))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"), k=4, percent=80)


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(_table(spark, sf_dir, "documents"))


def op3_live_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which texts the index still holds once every hundredth document has been deleted from it."""
    return exact_dedup.live_texts(_table(spark, sf_dir, "documents"), F.col("doc_id") % 100 == 0)


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(_table(spark, sf_dir, "pages"), RULES)


def op4_linked_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for pages that link to others: those at a half and a third of their number, and for every fifth page a base at a seventh."""
    pages = _table(spark, sf_dir, "pages")

    def at(part: int) -> DataFrame:
        return pages.select(F.col("page_id").alias(f"id{part}"), F.col("url").alias(f"url{part}"))

    linked = pages
    for part in (2, 3, 7):
        linked = linked.join(at(part), F.expr(f"page_id div {part}") == F.col(f"id{part}"), "left")
    to = F.concat(F.lit('<a href="'), "url2", F.lit('"><a class=x HREF='), "url3", F.lit(">"))
    base = F.concat(F.lit('<base href="'), "url7", F.lit('">'))
    html = F.concat("html", to, F.when(F.expr("page_id % 5 = 0"), base).otherwise(""))
    return url_filter.judge_urls(linked.select("page_id", "url", html.alias("html")), RULES)


def op5_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every assistant turn is a call of the tool ``answer``, the turn after it its result; all other turns are rows of their own.

    In conversations of even number a call comes after those at a half and a third
    of its turn, in odd ones after those at twice its turn and one more: references
    run both ways, and those that name no call are ignored.
    """
    chat = _table(spark, sf_dir, "conversations")
    words = F.regexp_count("text", F.lit("[^\\x20\\x09-\\x0D]+"))

    def name(turn: str) -> Column:  # concat: a turn without a number or conversation has no identifier
        return F.concat(F.col("conv_id").cast("string"), F.lit("-"), F.expr(turn).cast("string"))

    back, ahead = F.array(name("turn div 2"), name("turn div 3")), F.array(name("turn * 2"), name("turn * 2 + 1"))
    after = F.when(F.col("turn") > 1, F.when(F.expr("conv_id % 2 = 0"), back).otherwise(ahead))
    args = F.to_json(F.struct("text", words.alias("words"), after.alias("after")))
    group, pos = F.col("conv_id").alias("group_id"), F.col("turn").alias("pos")
    calls = chat.where("role = 'assistant'").select(group, name("turn").alias("call_id"), pos, F.lit("answer").alias("name"), args.alias("arguments"))
    others = chat.where("role is null or role <> 'assistant'")
    others = others.select(group, name("turn - 1").alias("call_id"), pos, F.col("text").alias("result"), F.coalesce("role", F.lit("no role")).alias("kind"))
    return tool_calls.link_chat(calls, others, SCHEMAS)


def op5_chat_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns of ``op5_tool_calls`` in short: what each became, and the length of its text or message."""
    turns = op5_tool_calls(spark, sf_dir)
    size = F.length(F.coalesce("json", "text", F.lit(""))).cast("long")
    return turns.select("group_id", "pos", "kind", "level", size.alias("n_chars"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(_table(spark, sf_dir, "documents"), size=13).drop("repeats")


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.drop("items", "spans")


def op8_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.tokenized(_table(spark, sf_dir, "documents"), tokenizer_path(), END_ID)


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").withColumn("memberships", F.array("source"))
    return mixing.mix(docs, WEIGHTS, share=1.5, cap=2.0).drop("passes")


def op9_mix_overlapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same mix where a document also belongs to its language, so that sources overlap and the flow shares documents out."""
    docs = _table(spark, sf_dir, "documents").withColumn("memberships", F.array("source", F.concat(F.lit("in "), F.coalesce("lang", F.lit("none")))))
    return mixing.mix(docs, WEIGHTS, share=0.8, cap=2.0)


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return licenses.license_families(docs, licenses.train(docs)).withColumn("families", F.array_join("families", ",")).drop("found")


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(_table(spark, sf_dir, "documents"), least_docs=30, top=50)


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_path(BYTE_TOKENIZER)
    ids = bpe.encoded(_table(spark, sf_dir, "documents").select("doc_id", "text"), path)
    digits = F.array_join(F.col("ids").cast("array<string>"), ",")
    return bpe.decoded(ids, path).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(digits, 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"))


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.clusters(_table(spark, sf_dir, "embeddings"), k=40, rounds=5, dims=64, scale=256, seed="2:")


QUERIES = {f.__name__: f for f in (op1_language_id, op2_near_dedup, op3_exact_dedup, op3_live_texts, op4_url_filter, op4_linked_pages, op5_tool_calls,
    op5_chat_turns, op6_substring_dedup, op7_decontaminate, op8_token_output, op9_mix_sources, op9_mix_overlapping, op10_license_scan, op11_source_divergence,
    op12_byte_bpe, op13_centroids)}

_WORDS = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"
_LOWER = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PLAIN = r"regexp_extract_all({0}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"



def _url_sql(pages: str) -> str:
    """Rules by length, then the two walks: how much each step brings to each host, added up to the step where Spark stops."""
    rules = sorted(RULES, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
    cases = [(v, h, p, f"(host = '{h}' or host like '%.{h}') and path like '{p}%'") for v, h, p in rules]
    rule = "case " + " ".join(f"when {c} then '{h + p}'" for _, h, p, c in cases) + " end"
    ruled = "case " + " ".join(f"when {c} then '{v}'" for v, _, _, c in cases) + " end"
    lower = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    host = lower.format("coalesce(regexp_extract({0}, '(?s)^.*?://([^/?#]*)', 1), '')")
    href = r"""\s[^>]*?href\s*=\s*["'']?([^"''\s>]+)"""
    absolute = "'(?i)^([a-z][a-z0-9+.-]*:)?//'"
    target = host.replace("{0}", "case when {0} like '//%' then concat('http:', {0}) else {0} end")
    parts = [
        f"""p as (
          select page_id, {host.format('url')} as host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path, html
          from {pages})""",
        f"judged as (select page_id, host, path, {rule} as rule, {ruled} as ruled from p)",
        f"""links as (
          select host as src, regexp_extract(html, '(?i)<base{href}', 1) as base, unnest(regexp_extract_all(html, '(?i)<a{href}', 1)) as link
          from p where host <> '' and html is not null)""",
        f"""aimed as (
          select src, case when regexp_matches(link, {absolute}) then {target.format('link')}
            when not regexp_matches(link, '(?i)^[a-z][a-z0-9+.-]*:') and regexp_matches(base, {absolute}) then {target.format('base')} end as dst
          from links)""",
        "edges as (select src, dst, count(*) as n from aimed where dst <> '' and src <> dst group by src, dst)",
    ]
    for name, seed, a, b in (("trust", "allow", "src", "dst"), ("distrust", "block", "dst", "src")):
        parts += [
            f"{name}_step as (select {a} as x, {b} as y, n::double / sum(n) over (partition by {a}) * 0.85 as p from edges)",
            f"{name}_seed as (select host, count(*)::double / sum(count(*)) over () * 0.15 as r from judged where ruled = '{seed}' group by host)",
            f"""{name}_walk as (
              select 0 as k, host, r from {name}_seed
              union all
              select k + 1, y, sum(p * r) from {name}_walk join {name}_step on host = x where k < 120 group by k, y)""",
            f"{name}_mass as (select s.k, coalesce(sum(r), 0) as m from range(0, 121) s(k) left join {name}_walk w on w.k = s.k group by s.k)",
            f"""{name}_upto as (select k, sum(m) over (order by k) as m from {name}_mass),
            {name}_end as (
              select min(e.k) as k from {name}_upto e left join {name}_upto w on w.k = e.k - 4 and w.k > 0
              where e.k % 4 = 0 and e.k > 0 and e.m - coalesce(w.m, 0) < 1e-3)""",
            f"{name}_sum as (select host, sum(r) as r from {name}_walk where k <= (select coalesce(k, 120) from {name}_end) group by host)",
            f"{name}_rank as (select host, floor(r / sum(r) over () * 1e9 + 0.5) / 1e9 as r from {name}_sum)",
        ]
    parts.append("hosts as (select coalesce(t.host, d.host) as host, coalesce(t.r, 0) as trust, coalesce(d.r, 0) as distrust from trust_rank t full join distrust_rank d on d.host = t.host)")
    return f"""with recursive {", ".join(parts)}
        select page_id, j.host, path, rule, coalesce(ruled, case when distrust > 0.5 * (trust + distrust) then 'block' else 'allow' end) as verdict,
               coalesce(trust, 0.0) as trust, coalesce(distrust, 0.0) as distrust
        from judged j left join hosts h on h.host = j.host"""


_LINKED_PAGES = """(
    select p.page_id, p.url, concat(p.html, '<a href="', a.url, '"><a class=x HREF=', b.url, '>',
      case when p.page_id % 5 = 0 then concat('<base href="', c.url, '">') end) as html
    from pages p left join pages a on a.page_id = p.page_id // 2 left join pages b on b.page_id = p.page_id // 3 left join pages c
      on c.page_id = p.page_id // 7)"""


def _chat_sql() -> str:
    """Calls with the turn after each, levels by walking all chains of references, and the turns that are in no call."""
    return r"""
        with recursive
        a as (
          select conv_id, turn, text, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) as words,
                 case when turn > 1 and conv_id % 2 = 0 then [turn // 2, turn // 3] when turn > 1 then [turn * 2, turn * 2 + 1] end as refs
          from conversations where role = 'assistant'),
        edge as (
          select distinct x.conv_id, x.turn, y.turn as ref
          from (select conv_id, turn, unnest(refs) as ref from a) x join a y on y.conv_id = x.conv_id and y.turn = x.ref),
        way as (
          select conv_id, turn, 0 as level from a
          union select e.conv_id, e.turn, way.level + 1 from way join edge e on e.conv_id = way.conv_id and e.ref = way.turn),
        depth as (select conv_id, turn, max(level) as level from way group by conv_id, turn),
        r as (select conv_id, turn - 1 as turn, text as result from conversations where role <> 'assistant' or role is null),
        called as (
          select a.conv_id, a.turn, r.turn is not null as answered, level, result, text, words,
                 case when refs is not null then concat('"after":', to_json(list_transform(refs, lambda x: concat(a.conv_id, '-', x))),
                   ',') else '' end as after,
                 nullif(concat_ws('; ',
                   case when length(text) < 1 then '$.text: too short' end,
                   case when words < 1 then '$.words: under minimum' end,
                   case when words > 200 then '$.words: over maximum' end), '') as errors
          from a join depth using (conv_id, turn) left join r on r.conv_id = a.conv_id and r.turn = a.turn)
        select conv_id as group_id, concat(conv_id, '-', turn) as call_id, turn as pos, 'call' as kind, 'answer' as name, answered, level,
               cast(null as varchar) as text, errors is null as args_valid, errors,
               concat('{"call":{"arguments":{', after, '"text":', to_json(text), ',"words":', words, '},"id":"', conv_id, '-', turn,
                      '","name":"answer"},"result":', coalesce(to_json(result)::varchar, 'null'), '}') as json
        from called
        union all
        select c.conv_id, concat(c.conv_id, '-', c.turn - 1), c.turn, coalesce(role, 'no role'), null, null, null, c.text, null, null, null
        from conversations c left join a on a.conv_id = c.conv_id and a.turn = c.turn - 1
        where (role is null or role <> 'assistant') and a.turn is null"""


def _divergence_sql() -> str:
    """All kept terms of a language against each two of its sources, one by one."""
    share = "1 + (1000000000::hugeint * (coalesce({0}, 0) + 5)) // greatest({1} + 5 * v, 1)"
    return rf"""
        with d as (
          select row_number() over () as id, coalesce(lang, '') as lang, coalesce(source, '') as source,
                 regexp_extract_all({_LOWER.format('text')}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as w
          from documents),
        t as (select id, lang, source, unnest(w) as term from d),
        kept as (select lang, term, count(*) as n from t group by lang, term having count(distinct id) >= 30),
        langs as (select lang, count(kept.term) as v, coalesce(sum(kept.n), 0) as size from (select distinct lang from d) left join kept using (lang) group by lang),
        cell as (select lang, source, term, count(*) as n from t join kept using (lang, term) group by lang, source, term),
        grp as (
          select g.lang, g.source, coalesce(s.size, 0) as size, v, langs.size as size_lang
          from (select distinct lang, source from d) g join langs using (lang)
          left join (select lang, source, sum(n) as size from cell group by lang, source) s on s.lang = g.lang and s.source = g.source),
        p as (
          select g.lang, g.source, k.term, c.n, {share.format('c.n', 'g.size')} as p, {share.format('k.n', 'size_lang')} as q
          from grp g join kept k using (lang) left join cell c on c.lang = g.lang and c.source = g.source and c.term = k.term),
        apart as (
          select a.lang, a.source, b.source as item, sum(abs(a.p - b.p)) as value
          from p a join p b on b.lang = a.lang and b.term = a.term and b.source <> a.source group by a.lang, a.source, b.source),
        found as (
          select a.lang, a.source, 'pair' as part, b.source as item, coalesce(x.value, 0)::bigint as value
          from grp a join grp b on b.lang = a.lang and b.source <> a.source
          left join apart x on x.lang = a.lang and x.source = a.source and x.item = b.source
          union all select lang, source, 'term', term, (p - q)::bigint from p where n > 0 and p > q)
        select * from (select *, row_number() over (partition by lang, source, part order by value desc, item)::int as rank from found)
        where part = 'pair' or rank <= 50"""


def _centroids_sql(k: int = 40, rounds: int = 5) -> str:
    """Every round as three tables: all distances, the nearest, and the means."""
    parts = [
        """x as materialized (
          select row_number() over () as id, vec_id, list_transform(embedding, lambda e: floor(256 * e::double)::bigint) as x from embeddings
          where len(embedding) = 64 and len(list_filter(embedding, lambda e: e is null or not isfinite(e))) = 0)""",
        f"c0 as materialized (select (row_number() over (order by sha256(concat('2:', vec_id)), x) - 1)::int as cluster, x as c from x order by cluster limit {k})",
    ]
    for r in range(rounds + 1):
        parts.append(f"""a{r} as materialized (
          select id, vec_id, x, arg_min(cluster, (d, cluster)) as cluster, min(d) as d
          from (select id, vec_id, x, cluster, list_sum(list_transform(list_zip(x, c), lambda e: (e[1] - e[2]) * (e[1] - e[2])))::bigint as d from x, c{r})
          group by id, vec_id, x)""")
        parts.append(f"""c{r + 1} as materialized (
          select c{r}.cluster, coalesce(m.c, c{r}.c) as c from c{r} left join (
            select cluster, list(v order by i) as c from (
              select cluster, i, ((sum(e) - ((sum(e) % count(*)) + count(*)) % count(*)) // count(*))::bigint as v
              from (select cluster, unnest(x) as e, unnest(range(1, 65)) as i from a{r}) group by cluster, i) group by cluster) m using (cluster))""")
    return f"""with {", ".join(parts[:-1])}
        select vec_id, cluster, d as distance, sum(d) over (partition by cluster)::bigint as cluster_inertia, sum(d) over ()::bigint as inertia,
               sha256(array_to_string(c, ',')) as centroid_sha256
        from a{rounds} join c{rounds} using (cluster)"""


SQL: dict[str, str] = {
    "op11_source_divergence": _divergence_sql(),
    "op13_centroids": _centroids_sql(),
    "op4_url_filter": _url_sql("pages"),
    "op4_linked_pages": _url_sql(_LINKED_PAGES),
    "op2_near_dedup": f"""
        with recursive d as (select doc_id, {_WORDS.format(_LOWER.format('text'))} as w from documents),
        sh as (select distinct doc_id, s from (select doc_id, unnest(case when len(w) >= 4 then list_transform(range(1, len(w) - 2),
          lambda i: array_to_string(w[i:i + 3], ' ')) when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as s from d)),
        n as (select doc_id, count(*) as n from sh group by doc_id),
        pairs as (select a.doc_id as a, b.doc_id as b, count(*) as same from sh a join sh b on a.s = b.s and a.doc_id < b.doc_id group by a.doc_id, b.doc_id),
        link as (select a, b from pairs join n x on x.doc_id = a join n y on y.doc_id = b where 100 * same >= 80 * (x.n + y.n - same)),
        way as (select a, b from link union all select b, a from link),
        reach as (select doc_id, doc_id as r from documents union select reach.doc_id, way.b from reach join way on way.a = reach.r),
        comp as (select doc_id, min(r) as component_id from reach group by doc_id)
        select d.doc_id, coalesce(n.n, 0) as n_shingles, component_id, d.doc_id = component_id as kept from d left join n on n.doc_id = d.doc_id
          join comp on comp.doc_id = d.doc_id""",
    "op3_exact_dedup": r"""
        with d as (select doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) as text_sha256 from documents)
        select doc_id, min(doc_id) over (partition by text_sha256) as keep_id, count(*) over (partition by text_sha256) as group_size,
               doc_id = min(doc_id) over (partition by text_sha256) as kept, text_sha256 from d""",
    "op3_live_texts": r"""
        with d as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as t from documents),
        live as (select t, count(*) as n from d where doc_id % 100 <> 0 group by t)
        select doc_id, n is not null as live, coalesce(n, 0) as n_live from d left join live using (t)""",
    "op5_tool_calls": _chat_sql(),
    "op5_chat_turns": f"""select group_id, pos, kind, level, coalesce(length(coalesce(json, text)), 0) as n_chars from ({_chat_sql()})""",
    "op6_substring_dedup": f"""
        with d as (select doc_id, {_WORDS.format("coalesce(text, '')")} as w from documents),
        win as (select doc_id, i, array_to_string(w[i:i + 12], ' ') as k from (select doc_id, w, unnest(range(1, len(w) - 11)) as i from d where len(w) >= 13)),
        hit as (select doc_id, i from (select doc_id, i, min(doc_id) over (partition by k) as f from win) where f < doc_id),
        gone as (select distinct doc_id, p from (select doc_id, unnest(range(i, i + 13)) as p from hit)),
        word as (select doc_id, unnest(w) as x, unnest(range(1, len(w) + 1)) as p from d),
        kept as (select word.doc_id, string_agg(x, ' ' order by word.p) as t, count(*) as n from word left join gone
          on gone.doc_id = word.doc_id and gone.p = word.p where gone.p is null group by word.doc_id)
        select d.doc_id, len(w) as n_words, len(w) - coalesce(kept.n, 0) as n_removed, sha256(coalesce(t, '')) as kept_sha256 from d left join kept
          on kept.doc_id = d.doc_id""",
    "op7_decontaminate": f"""
        with d as (select doc_id, {_PLAIN.format(_LOWER.format('text'))} as w from documents),
        b as (select item_id, {_PLAIN.format(_LOWER.format('text'))} as w from benchmark),
        iw as (select distinct item_id, least(len(w), 13) as n, array_to_string(w[i:i + 12], ' ') as k from (select item_id, w, unnest(range(1,
          greatest(len(w) - 11, 2))) as i from b where len(w) > 0)),
        dw as (select doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') as k from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i
          from d, (select distinct n from iw) where len(w) >= n)),
        hit as (select doc_id, item_id, i, dw.n as n from dw join iw on iw.k = dw.k and iw.n = dw.n),
        words as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from hit) group by doc_id),
        items as (select doc_id, count(*) as n_items, string_agg(id, ',' order by id) as ids from (select distinct doc_id, item_id::varchar as id
          from hit) group by doc_id)
        select d.doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(ids, '')) as items_sha256,
               coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
        from d left join words on words.doc_id = d.doc_id left join items on items.doc_id = d.doc_id""",
}
