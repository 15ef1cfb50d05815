"""The queries of the reference's operators over the driver's tables, and their SQL for DuckDB.

The tables stand in for decoded containers: a document is a topic, its source the file, the
running number of characters its offset; words of part names are keywords and line items their
postings; links of pages are hotspots; conversations are browse sequences.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions.text import context_hash, fold, html_escape, label, rtf_escape, safe_name
from folioscope.operators import relational as R
from folioscope.operators import search as S
from folioscope.operators.intervals import covering, in_rectangles

def registry():
    """A table of queries, one of SQL, and a decorator that enters a query and its SQL (or None) in them."""
    queries, oracle = {}, {}

    def query(sql: str | None):
        def register(f):
            queries[f.__name__] = f
            if sql:
                oracle[f.__name__] = sql
            return f

        return register

    return queries, oracle, query


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]]
QUERIES, ORACLE_SQL, query = registry()


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents laid out in the address space of their file."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    return R.running_total(docs, ["source"], "doc_id", "n_chars", "topic_offset", 1024)


TOPICS_SQL = "select doc_id, source, n_chars, cast(coalesce(sum(n_chars) over (partition by source order by doc_id rows between unbounded preceding and 1 preceding), 0) as bigint) topic_offset from documents"


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All-terms search over topics, with titles and offsets."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text").where(S.all_terms(F.col("text"), "th er"))
    title = label(F.substring_index("text", "\n", 1), F.col("doc_id"))
    return docs.select("doc_id", title.alias("title")).join(topics(spark, sf_dir).select("doc_id", "topic_offset"), "doc_id")


@query("""select doc_id, source from documents where contains(replace(lower(text), 'ß', 'ss'), 'the') and contains(replace(lower(text), 'ß', 'ss'), 'tion')""")
def topic_search_all_terms(spark, sf_dir):
    return read(spark, sf_dir, "documents").where(S.all_terms(F.col("text"), "The TION")).select("doc_id", "source")


@query(f"{TOPICS_SQL}")
def topic_offsets_running(spark, sf_dir):
    return topics(spark, sf_dir).select("doc_id", "source", "n_chars", "topic_offset")


@query(f"""with t as ({TOPICS_SQL}), p as (select doc_id, source, topic_offset * 3 // 2 as pos from t)
select p.doc_id, p.source, p.pos, t.doc_id topic from p asof left join t on p.source = t.source and p.pos >= t.topic_offset""")
def asof_topic_lookup(spark, sf_dir):
    t = topics(spark, sf_dir)
    probes = t.select("doc_id", "source", F.expr("topic_offset * 3 div 2").alias("pos"))
    starts = t.select("source", "topic_offset", F.col("doc_id").alias("topic"))
    return R.asof_join(probes, starts, ["source"], "pos", "topic_offset", ["topic"])


@query(f"""with t as ({TOPICS_SQL}) select doc_id, source, topic_offset, lead(topic_offset) over (partition by source order by topic_offset, doc_id) next_offset from t""")
def topic_ranges(spark, sf_dir):
    near = R.neighbours(topics(spark, sf_dir), ["source"], "topic_offset", "topic_offset", ties=["doc_id"])
    return near.select("doc_id", "source", "topic_offset", F.col("next").alias("next_offset"))


#: Overlapping ranges, one a nation, that together cover all ids: each 1.5 times as wide as its step.
RANGES_SQL = "with s as (select max(doc_id) // 25 + 1 as step from documents), r as (select n_nationkey, n_nationkey * step as low, n_nationkey * step + step * 3 // 2 as high from nation, s)"


@query(f"""{RANGES_SQL} select doc_id, max(n_nationkey) as group_no from documents left join r on doc_id between low and high group by doc_id""")
def interval_group_join(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id")
    step = (docs.agg(F.max("doc_id")).first()[0] or 0) // 25 + 1
    low = (F.col("n_nationkey") * step).cast("long")
    ranges = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("group_no"), low.alias("low"), (low + step * 3 // 2).alias("high"))
    return covering(docs, ranges.withColumn("_order", F.col("low")), [], "doc_id", "low", "high", "group_no", "_order")


@query(f"""{RANGES_SQL} select group_no, count(*) as topics from (select doc_id, max(n_nationkey) as group_no from documents join r on doc_id between low and high group by doc_id) group by group_no""")
def topics_in_groups(spark, sf_dir):
    return interval_group_join(spark, sf_dir).where("group_no is not null").groupBy("group_no").agg(F.count("*").alias("topics"))


def keyword_index(spark, sf_dir) -> DataFrame:
    return S.inverted_index(read(spark, sf_dir, "part"), "p_partkey", F.split(fold(F.col("p_name")), " "))


KEYWORDS_SQL = "select distinct p_partkey, unnest(string_split(replace(lower(p_name), 'ß', 'ss'), ' ')) keyword from part"


@query(f"""select keyword, p_partkey // 4096 as block, count(*) n, string_agg(cast(p_partkey as varchar), ',' order by p_partkey) keys from ({KEYWORDS_SQL}) group by all""")
def keyword_inverted_index(spark, sf_dir):
    return S.postings(keyword_index(spark, sf_dir), "p_partkey")


@query(f"""select keyword, l_orderkey, l_linenumber from ({KEYWORDS_SQL}) join lineitem on l_partkey = p_partkey where keyword = 'anvil'""")
def keyword_postings_lookup(spark, sf_dir):
    found = keyword_index(spark, sf_dir).where("keyword = 'anvil'")
    items = read(spark, sf_dir, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber")
    return found.join(items, F.col("l_partkey") == F.col("p_partkey")).select("keyword", "l_orderkey", "l_linenumber")


@query("""with e as (select distinct replace(p_name, ' ', ',') keyword from part union select distinct split_part(p_name, ' ', 1) from part where length(split_part(p_name, ' ', 1)) > 4),
own as (select keyword, case when contains(keyword, ',') then 1 else 0 end as level, false as made from e)
select * from own union all select distinct trim(split_part(keyword, ',', 1)), 0, true from e where contains(keyword, ',') and trim(split_part(keyword, ',', 1)) not in (select keyword from e)""")
def keyword_heading_synthesis(spark, sf_dir):
    part = read(spark, sf_dir, "part")
    entries = part.select(F.replace("p_name", F.lit(" "), F.lit(",")).alias("keyword"))
    alone = part.select(F.split_part("p_name", F.lit(" "), F.lit(1)).alias("keyword")).where(F.length("keyword") > 4)
    return S.headings(entries.union(alone).distinct())


@query("""select p_brand, count(*) total, count(distinct p_name) uniq, round(avg(length(p_name)), 6) avg_len, max(length(p_name)) max_len, min(length(p_name)) min_len,
arg_min(p_name, (-length(p_name), p_partkey)) longest, arg_min(p_name, (length(p_name), p_partkey)) shortest from part group by rollup(p_brand)""")
def keyword_stats_rollup(spark, sf_dir):
    return S.keyword_stats(read(spark, sf_dir, "part"), "p_brand", "p_name", "p_partkey")


@query("""with p as (select case when l_linenumber = 1 then -1 else l_partkey end off from lineitem)
select count(*) total, count(distinct off) uniq, count(*) filter (where off = -1) macros, count(*) filter (where off <> -1) valid, min(off) filter (where off <> -1) low, max(off) filter (where off <> -1) high from p""")
def postings_stats(spark, sf_dir):
    off = F.when(F.col("l_linenumber") == 1, -1).otherwise(F.col("l_partkey"))
    p = read(spark, sf_dir, "lineitem").select(off.alias("off"))
    real = F.when(F.col("off") != -1, F.col("off"))
    return p.agg(F.count("*").alias("total"), F.count_distinct("off").alias("uniq"), F.count_if(F.col("off") == -1).alias("macros"), F.count(real).alias("valid"), F.min(real).alias("low"), F.max(real).alias("high"))


@query("""select cast(case when l_linenumber > 3 then 'index' else 'search' end as varchar) as kind, count(distinct l_partkey) as uniq, count(*) as refs, min(l_partkey) as low, max(l_partkey) as high, round(count(*) / count(distinct l_partkey), 6) as per_page from lineitem group by rollup(1)""".replace("rollup(1)", "rollup(case when l_linenumber > 3 then 'index' else 'search' end)"))
def page_map_stats(spark, sf_dir):
    kind = F.when(F.col("l_linenumber") > 3, "index").otherwise("search")
    t = read(spark, sf_dir, "lineitem").select(kind.alias("kind"), "l_partkey")
    n, u = F.count("*"), F.count_distinct("l_partkey")
    return t.rollup("kind").agg(u.alias("uniq"), n.alias("refs"), F.min("l_partkey").alias("low"), F.max("l_partkey").alias("high"), F.round(n / u, 6).alias("per_page"))


HASH_SQL = """case when {0} = '' then 1 else list_reduce(list_prepend(0::bigint, [cast(case unicode(c) when 0 then 0 when 33 then 11 when 46 then 12 when 48 then 10 when 95 then 13 when 180 then 11
else case when unicode(c) <= 90 then unicode(c) - 48 when unicode(c) <= 127 then unicode(c) - 80 when unicode(c) <= 175 then unicode(c) - 48 else unicode(c) - 304 end end as bigint) for c in string_split({0}, '') if unicode(c) < 256]),
lambda a, b: ((a * 43 + b) % 4294967296 + 4294967296) % 4294967296) end"""


@query(f"select p_partkey, p_name, {HASH_SQL.format('p_name')} as hash from part")
def context_hashes(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", "p_name", context_hash(F.col("p_name")).alias("hash"))


@query(f"""with names as (select p_name as name, 0 as prio, p_partkey as ord from part union all select s_name, 1, s_suppkey from supplier),
hashed as (select {HASH_SQL.format('name')} as hash, name, prio, ord from names),
cand as (select hash, arg_min(name, (prio, ord)) as name from hashed group by hash),
wanted as (select p_partkey as k, {HASH_SQL.format('p_name')} as hash from part union all select 1000000 + n_nationkey, {HASH_SQL.format('n_name')} from nation)
select k, hash, coalesce(name, 'CTX_' || lpad(upper(to_hex(hash)), 8, '0')) as name from wanted left join cand using (hash)""")
def context_name_resolution(spark, sf_dir):
    part = read(spark, sf_dir, "part")
    names = part.select(F.col("p_name").alias("name"), F.lit(0).alias("prio"), F.col("p_partkey").alias("ord"))
    names = names.unionByName(read(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"), F.lit(1).alias("prio"), F.col("s_suppkey").alias("ord")))
    known = R.first_wins(names.withColumn("hash", context_hash(F.col("name"))), ["hash"], "name", F.struct("prio", "ord"))
    wanted = part.select(F.col("p_partkey").alias("k"), context_hash(F.col("p_name")).alias("hash"))
    wanted = wanted.union(read(spark, sf_dir, "nation").select((F.col("n_nationkey") + 1_000_000).cast("long"), context_hash(F.col("n_name"))))
    made = F.concat(F.lit("CTX_"), F.lpad(F.hex("hash"), 8, "0"))
    return wanted.join(known, "hash", "left").select("k", "hash", F.coalesce("name", made).alias("name"))


@query("""select page_id, cast(ord - 1 as integer) as ord, target from (select page_id, unnest(l) as target, generate_subscripts(l, 1) as ord from (select page_id, regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1) l from pages))""")
def links_extract(spark, sf_dir):
    return S.links(read(spark, sf_dir, "pages"), "page_id", "html")


TARGETS = "case l_linenumber % 6 when 0 then 'macro:JumpID(`a`,`b`)' when 1 then 'topic:TOPIC' || l_partkey when 2 then 'popup:' || lower(hex_) when 3 then 'ctx_' || l_partkey || '>main@other.hlp' when 4 then 'topic_offset:' || l_partkey else 'idh_' || l_partkey || '>w' end"


def _targets(spark, sf_dir) -> DataFrame:
    items = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return items.withColumn("hex_", F.lpad(F.hex("l_partkey"), 8, "0")).select("l_orderkey", "l_linenumber", F.expr(TARGETS).alias("target"))


@query(f"""with t as (select l_orderkey, l_linenumber, {TARGETS} as target from (select *, lpad(to_hex(l_partkey), 8, '0') as hex_ from lineitem))
select l_orderkey, l_linenumber, case when starts_with(target, 'macro:') then 'macro' when contains(target, '@') or regexp_matches(target, '^(file|window|https?):') then 'external'
when regexp_full_match(target, '(topic|popup):TOPIC[0-9]+') then 'topic' when regexp_full_match(target, '(topic|popup):[0-9A-Fa-f]{{1,8}}') then 'hash' when regexp_full_match(target, 'topic_offset:[0-9]+') then 'offset' else 'context' end as kind,
regexp_extract(target, '^([^>@]*)(?:>([^@]*))?(?:@(.*))?$', 1) as context, regexp_extract(target, '^([^>@]*)(?:>([^@]*))?(?:@(.*))?$', 2) as win, regexp_extract(target, '^([^>@]*)(?:>([^@]*))?(?:@(.*))?$', 3) as file from t""")
def link_resolution(spark, sf_dir):
    t = _targets(spark, sf_dir)
    context, window, file = S.split_reference(F.col("target"))
    return t.select("l_orderkey", "l_linenumber", S.resolved(F.col("target")).alias("kind"), context.alias("context"), window.alias("win"), file.alias("file"))


@query("""with l as (select page_id, unnest(regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1)) as target from pages), k as (select distinct '/' || split_part(text, ' ', 1) as target from documents)
select page_id, target from l where target not in (select target from k)""")
def dangling_links_anti(spark, sf_dir):
    known = read(spark, sf_dir, "documents").select(F.concat(F.lit("/"), F.split_part("text", F.lit(" "), F.lit(1))).alias("target"))
    return S.dangling(S.links(read(spark, sf_dir, "pages"), "page_id", "html"), known, "target").select("page_id", "target")


@query("""select target, count(*) as refs, count(distinct page_id) as pages from (select page_id, unnest(regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1)) as target from pages) group by target""")
def external_reference_rollup(spark, sf_dir):
    found = S.links(read(spark, sf_dir, "pages"), "page_id", "html")
    return found.groupBy("target").agg(F.count("*").alias("refs"), F.count_distinct("page_id").alias("pages"))


@query("""select conv_id, turn, lag(turn) over w as prev, lead(turn) over w as next from conversations window w as (partition by conv_id order by turn)""")
def browse_prev_next(spark, sf_dir):
    c = read(spark, sf_dir, "conversations").select("conv_id", "turn")
    return R.neighbours(c, ["conv_id"], "turn", "turn")


@query("""select doc_id, source, quality, toxic, (labels.doc_id is not null) as annotated from documents left join labels using (doc_id)""")
def annotations_attach(spark, sf_dir):
    notes = read(spark, sf_dir, "labels").select("doc_id", "quality", "toxic", F.lit(True).alias("annotated"))
    docs = read(spark, sf_dir, "documents").select("doc_id", "source")
    return docs.join(notes, "doc_id", "left").withColumn("annotated", F.coalesce("annotated", F.lit(False)))


@query("""with e as (select r_regionkey * 1000 as ord, 0 as level, r_name as name from region union all select n_regionkey * 1000 + n_nationkey + 1, 1, n_name from nation)
select cast(ord as bigint) as ord, level, name, cast(case when level = 1 then (select max(p.ord) from e p where p.level = 0 and p.ord < e.ord) end as bigint) as parent from e""")
def contents_tree(spark, sf_dir):
    books = read(spark, sf_dir, "region").select((F.col("r_regionkey") * 1000).cast("long").alias("ord"), F.lit(0).alias("level"), F.col("r_name").alias("name"))
    pages = read(spark, sf_dir, "nation").select((F.col("n_regionkey") * 1000 + F.col("n_nationkey") + 1).cast("long"), F.lit(1), "n_name")
    return S.contents_parent(books.union(pages), [], "ord", "level")


@query("""with r as (select p_partkey, p_name, case when starts_with(lower(p_name), 'old') then 1 when contains(lower(p_name), 'old') then 2 end as kind from part)
select p_partkey, p_name from r where kind = (select min(kind) from r) order by lower(p_name), p_partkey limit 400""")
def index_prefix_then_contains(spark, sf_dir):
    part = read(spark, sf_dir, "part").select("p_partkey", "p_name").withColumn("_f", fold(F.col("p_name")))
    return S.prefix_else_contains(part, "p_name", "old", 400, "_f", "p_partkey").drop("_f")


@query("""select p_brand, arg_min(p_partkey, (abs(p_size - 24), p_partkey)) as picture from part group by p_brand""")
def nearest_picture(spark, sf_dir):
    return read(spark, sf_dir, "part").groupBy("p_brand").agg(F.min_by("p_partkey", F.struct(F.abs(F.col("p_size") - 24).alias("d"), F.col("p_partkey").alias("k"))).alias("picture"))


@query("""select event_type, arg_min(event_id, (ts, event_id)) as event_id from events group by event_type""")
def first_wins_dedup(spark, sf_dir):
    return R.first_wins(read(spark, sf_dir, "events"), ["event_type"], "event_id", F.struct("ts", F.col("event_id").alias("e")))


@query("""select event_type, user_id, arg_max(event_id, (ts, event_id)) as event_id from events group by event_type, user_id""")
def last_wins_dedup(spark, sf_dir):
    return R.last_wins(read(spark, sf_dir, "events"), ["event_type", "user_id"], "event_id", F.struct("ts", F.col("event_id").alias("e")))


@query("""select event_id, event_type, cast(json_extract_string(props, '$.k') as integer) as k from events""")
def tlv_payload_project(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", "event_type", F.get_json_object("props", "$.k").cast("int").alias("k"))


@query("""select signature, count(*) as n, min(event_id) as example from (select event_id, event_type || ':' || json_extract_string(props, '$.k') as signature from events) group by signature order by n desc, signature limit 20""")
def error_signature_topk(spark, sf_dir):
    sig = F.concat_ws(":", "event_type", F.get_json_object("props", "$.k"))
    t = read(spark, sf_dir, "events").select("event_id", sig.alias("signature"))
    return t.groupBy("signature").agg(F.count("*").alias("n"), F.min("event_id").alias("example")).orderBy(F.desc("n"), "signature").limit(20)


@query(f"""with t as ({TOPICS_SQL}) select doc_id, case when doc_id % 4 = 0 or topic_offset + n_chars // 2 <= topic_offset then 'scroll' when topic_offset % 1000 < 300 then 'fixed' else 'scroll' end as region from t""")
def layout_split(spark, sf_dir):
    whole = (F.col("doc_id") % 4 == 0) | F.expr("topic_offset + n_chars div 2 <= topic_offset")
    region = F.when(whole, "scroll").when(F.col("topic_offset") % 1000 < 300, "fixed").otherwise("scroll")
    return topics(spark, sf_dir).select("doc_id", region.alias("region"))


@query("""select conv_id, string_agg(text, chr(10) || chr(10) order by turn) as text from conversations where trim(text) <> '' group by conv_id""")
def plain_text_export(spark, sf_dir):
    turns = read(spark, sf_dir, "conversations").where("trim(text) <> ''")
    parts = F.sort_array(F.collect_list(F.struct("turn", "text")))
    return turns.groupBy("conv_id").agg(F.array_join(F.transform(parts, lambda x: x["text"]), "\n\n").alias("text"))


@query("""select kind, name from (select 'union' as kind, * from (select split_part(p_name, ' ', 1) as name from part union select split_part(p_name, ' ', 2) from part)
union all select 'except', * from (select split_part(p_name, ' ', 1) from part except select p_type from part)
union all select 'distinct', * from (select distinct p_brand from part))""")
def set_ops(spark, sf_dir):
    part = read(spark, sf_dir, "part")
    word = lambda k: part.select(F.split_part("p_name", F.lit(" "), F.lit(k)).alias("name"))
    named = lambda kind, df: df.select(F.lit(kind).alias("kind"), "name")
    out = named("union", word(1).union(word(2)).distinct())
    out = out.union(named("except", word(1).distinct().join(part.select(F.col("p_type").alias("name")).distinct(), "name", "left_anti")))
    return out.union(named("distinct", part.select(F.col("p_brand").alias("name")).distinct()))


@query("""select p_partkey, n_nationkey from part join nation on p_partkey % 100 >= n_nationkey * 4 and p_partkey % 100 < n_nationkey * 4 + 6 and p_size >= n_regionkey * 10 and p_size < n_regionkey * 10 + 10""")
def point_in_rect(spark, sf_dir):
    key = F.col("n_nationkey")
    boxes = read(spark, sf_dir, "nation").select(key, (key * 4).alias("x0"), (key * 4 + 5).alias("x1"), (F.col("n_regionkey") * 10).alias("y0"), (F.col("n_regionkey") * 10 + 9).alias("y1"))
    points = read(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % 100).alias("x"), F.col("p_size").alias("y"))
    return in_rectangles(points, boxes, "x", "y", "x0", "x1", "y0", "y1").select("p_partkey", "n_nationkey")


@query("""select o_orderkey, json_extract_string(j, '$.o_orderstatus') as status, cast(json_extract_string(j, '$.o_custkey') as bigint) as custkey from (select o_orderkey, to_json({'o_custkey': o_custkey, 'o_orderstatus': o_orderstatus}) as j from orders)""")
def json_export(spark, sf_dir):
    orders = read(spark, sf_dir, "orders").select("o_orderkey", F.to_json(F.struct("o_custkey", "o_orderstatus")).alias("j"))
    return orders.select("o_orderkey", F.get_json_object("j", "$.o_orderstatus").alias("status"), F.get_json_object("j", "$.o_custkey").cast("long").alias("custkey"))


@query("""select doc_id, '<section id="topic-' || doc_id || '"><h2>' || coalesce(nullif(split_part(text, chr(10), 1), ''), 'Topic ' || doc_id) || '</h2><p>' ||
replace(replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), chr(39), '&#x27;'), chr(10), '<br>') || '</p></section>' as html from documents""")
def html_export(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    body = F.replace(html_escape(F.col("text")), F.lit("\n"), F.lit("<br>"))
    title = label(F.substring_index("text", "\n", 1), F.col("doc_id"))
    return docs.select("doc_id", F.concat(F.lit('<section id="topic-'), F.col("doc_id"), F.lit('"><h2>'), title, F.lit("</h2><p>"), body, F.lit("</p></section>")).alias("html"))


@query("""select conv_id, turn, '{\\pard ' || replace(replace(replace(text, chr(92), chr(92) || chr(92)), '{', chr(92) || '{'), '}', chr(92) || '}') || '\\par}' as rtf from conversations""")
def rtf_export(spark, sf_dir):
    body = F.concat(F.lit("{\\pard "), rtf_escape(F.col("text")), F.lit("\\par}"))
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", body.alias("rtf"))


@query("""select l_suppkey as file, l_partkey as hash, count(*) as refs from lineitem where l_partkey not in (select p_partkey from part where p_size > 10) group by all""")
def external_reference_check(spark, sf_dir):
    refs = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("file"), F.col("l_partkey").alias("hash"))
    known = read(spark, sf_dir, "part").where("p_size > 10").select(F.col("p_partkey").alias("hash"))
    return S.dangling(refs, known, "hash").groupBy("file", "hash").agg(F.count("*").alias("refs"))


@query("""select p_brand || ' ' || p_type as alias, count(*) as n, min(p_partkey) as first from part group by 1 having count(*) > 1""")
def alias_list(spark, sf_dir):
    name = F.concat_ws(" ", "p_brand", "p_type")
    return read(spark, sf_dir, "part").groupBy(name.alias("alias")).agg(F.count("*").alias("n"), F.min("p_partkey").alias("first")).where("n > 1")


@query("""with w as (select l_orderkey, p_name from lineitem join part on l_partkey = p_partkey where contains(p_name, 'hot') or contains(p_name, 'gizmo'))
select l_orderkey, count(distinct p_name) as n, case when count(distinct p_name) = 1 then 'topic' else 'choice' end as kind from w group by l_orderkey""")
def keyword_link_choice(spark, sf_dir):
    wanted = read(spark, sf_dir, "part").where(F.contains("p_name", F.lit("hot")) | F.contains("p_name", F.lit("gizmo"))).select("p_partkey", "p_name")
    items = read(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_partkey").alias("p_partkey"))
    n = F.count_distinct("p_name")
    return items.join(wanted, "p_partkey").groupBy("l_orderkey").agg(n.alias("n"), F.when(n == 1, "topic").otherwise("choice").alias("kind"))


@query("""select c_custkey, c_name, n_name, r_name from customer left join nation on c_nationkey = n_nationkey left join region on n_regionkey = r_regionkey""")
def font_dimension_join(spark, sf_dir):
    customer = read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")
    nation = read(spark, sf_dir, "nation")
    region = read(spark, sf_dir, "region")
    # nation and region are of fixed size, as a file's font table is
    out = customer.join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return out.join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey"), "left").select("c_custkey", "c_name", "n_name", "r_name")


@query("""select source, count(*) as topics, cast(sum(n_chars) as bigint) as chars, count(distinct lang) as langs, max(n_chars) as longest, count(quality) as annotated from documents left join labels using (doc_id) group by source""")
def file_profile(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars")
    notes = read(spark, sf_dir, "labels").select("doc_id", "quality")
    own = docs.join(notes, "doc_id", "left").groupBy("source")
    return own.agg(F.count("*").alias("topics"), F.sum("n_chars").alias("chars"), F.count_distinct("lang").alias("langs"), F.max("n_chars").alias("longest"), F.count("quality").alias("annotated"))


@query("""select page_id, regexp_replace(split_part(url, '/', 3), '[^A-Za-z0-9._-]', '_', 'g') as name from pages""")
def file_names(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", safe_name(F.split_part("url", F.lit("/"), F.lit(3))).alias("name"))
