"""Queries over the relations of containers, and their SQL over the documents that they are made of.

A container is a set of relations: topics with the position where each begins, spans of text, links,
context hashes, keywords with their slice of the postings, annotations, groups, windows, contents
entries. ``relations`` takes them from documents and labels by DataFrame operations, files of at
most ``TOPICS`` documents each; ``sources.container.tables`` has those of decoded files under the
same names. What follows joins them: positions to topics, hashes to names, keywords to slices of
postings, links to targets.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscope.functions.text import context_hash, html_escape
from folioscope.operators import relational as R
from folioscope.operators import search as S
from folioscope.operators.intervals import covering
from folioscope.operators.resolve import resolve
from folioscope.sources import contents

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
TOPICS = 64

#: Topics by file; keywords; links to the next topic of the file (the last leads to the first), every fourth to nothing.
DOCS = """with d as (select doc_id, source || '-' || (doc_id // 64) as file, cast(row_number() over (partition by source, doc_id // 64 order by doc_id) - 1 as bigint) as ord,
count(*) over (partition by source, doc_id // 64) as n_topics, 'T' || doc_id || ' ' || lang as title, coalesce(text, '') as text, lang, quality from documents left join labels using (doc_id)),
w as (select file, ord, title, doc_id, unnest([lang, 'k' || (doc_id % 7), 'both, k' || (doc_id % 3)]) as keyword from d),
l as (select d.file, d.ord, t.ord as target from d left join d t on d.file = t.file and d.doc_id % 4 > 0 and t.ord = (d.ord + 1) % d.n_topics)
"""


def query(sql: str):
    def register(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(corpus(spark, sf_dir))
        ORACLE_SQL[f.__name__] = DOCS + sql
        return f

    return register


def relations(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The relations of the files that the documents are laid out in, by the names that ``container.tables`` uses.

    A topic takes its characters and 16 more positions; contexts, postings, notes and windows point
    into it at different places.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").join(spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality"), "doc_id", "left")
    file = F.concat("source", F.lit("-"), F.expr("doc_id div 64").cast("string"))
    inside = Window.partitionBy("file").orderBy("doc_id")  # at most TOPICS rows
    every = Window.partitionBy("file")
    text = F.coalesce("text", F.lit(""))
    doc = F.col("doc_id").cast("string")
    whole = docs.select(file.alias("file"), "doc_id", "lang", "quality", text.alias("text"), F.length(text).cast("long").alias("_n"))
    whole = whole.select("*", (F.row_number().over(inside) - 1).cast("long").alias("ord"), F.count("*").over(every).alias("_topics"), F.coalesce(F.sum(F.col("_n") + 16).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("topic_offset"), F.coalesce(F.lead("doc_id").over(inside), F.min("doc_id").over(every)).alias("_next"))
    at = lambda more: (F.col("topic_offset") + more).cast("long").alias("topic_offset")
    title = F.concat(F.lit("T"), doc, F.lit(" "), "lang")
    name = F.concat(F.lit("doc_"), doc)
    names = F.when(F.col("doc_id") % 5 == 0, F.array(name, F.concat(F.lit("also_"), doc))).otherwise(F.array(name))
    wanted = F.when(F.col("doc_id") % 4 > 0, F.concat(F.lit("doc_"), F.col("_next").cast("string"))).otherwise(F.concat(F.lit("nowhere_"), doc))
    target = F.concat(F.lit("topic:"), F.lpad(F.hex(context_hash(wanted)), 8, "0"))
    span = lambda k, words, link: F.struct(F.lit(k).alias("ord"), words.alias("text"), link.alias("link"))
    spans = whole.select("file", F.col("ord").alias("topic"), F.inline(F.array(span(0, F.col("text"), F.lit(None).cast("string")), span(1, F.lit("next"), target))))
    words = F.array("lang", F.concat(F.lit("k"), (F.col("doc_id") % 7).cast("string")), F.concat(F.lit("both, k"), (F.col("doc_id") % 3).cast("string")))
    hits = whole.select("file", F.explode(words).alias("keyword"), at(F.expr("_n div 3")))
    macros = whole.where("doc_id % 11 = 0").select("file", F.col("lang").alias("keyword"), F.lit(-1).cast("long").alias("topic_offset"))
    slices = Window.partitionBy("file").orderBy("keyword", "topic_offset")  # at most four rows a topic
    posting = hits.union(macros).select("file", F.lit("kw").alias("type"), "keyword", "topic_offset", (4 * (F.row_number().over(slices) - 1)).cast("long").alias("data_offset"))
    keyword = posting.groupBy("file", "type", "keyword").agg(F.count("*").cast("int").alias("count"), F.min("data_offset").alias("data_offset"))
    half = F.expr("count(*) div 2")
    groups = whole.groupBy("file").agg(F.count("*").alias("_topics"), half.alias("_half"))
    group = groups.select("file", F.inline(F.array(F.struct(F.lit(0).cast("long").alias("low"), (F.col("_topics") - 1).alias("high"), F.lit("2").alias("group_no"), F.lit(0).alias("ord")), F.struct(F.lit(0).cast("long").alias("low"), F.col("_half").alias("high"), F.lit("1").alias("group_no"), F.lit(1).alias("ord")))))
    return {
        "topic": whole.select("file", "ord", title.alias("title"), "topic_offset"),
        "title": whole.select("file", title.alias("title"), "topic_offset"),
        "span": spans,
        "link": spans.where("link is not null").select("file", "topic", F.col("link").alias("target")),
        "context": whole.select("file", F.explode(names).alias("name"), at(F.expr("_n div 2"))).select("file", context_hash(F.col("name")).alias("hash"), "topic_offset"),
        "keyword": keyword,
        "posting": posting.drop("keyword"),
        "annotation": whole.where("quality is not null").select("file", at(F.col("_n")), F.concat(F.lit("quality "), F.col("quality").cast("string")).alias("text")),
        "group": group,
        "window_of": whole.where("doc_id % 3 = 0").select("file", at(F.lit(15)), (F.col("doc_id") % 4).alias("window")),
        "contents": whole.where("doc_id % 10 = 5").select("file", "ord", F.concat(F.lit("also_"), doc).alias("reference")),
        "names": whole.select(F.explode(names).alias("name")).distinct().select("name", context_hash(F.col("name")).alias("hash")),
    }


class Corpus:
    """The relations of a corpus of containers, and their joins."""

    def __init__(self, view: dict[str, DataFrame]):
        self.view, self.names = view, view["names"]

    def topics(self) -> DataFrame:
        return self.view["topic"].select("file", "ord", "title", "topic_offset")

    def texts(self) -> DataFrame:
        """(file, ord, text): a topic's spans in order; a topic is one row anyway."""
        listed = F.sort_array(F.collect_list(F.struct("ord", "text")))
        return self.view["span"].groupBy("file", F.col("topic").alias("_topic")).agg(F.array_join(F.transform(listed, lambda x: x["text"]), "").alias("text")).withColumnRenamed("_topic", "ord")

    def placed(self, view: DataFrame, *carry: str) -> DataFrame:
        """Rows of (file, topic_offset, ...) with columns of the topic that holds their offset."""
        topics = self.topics().select("file", F.col("topic_offset").alias("_at"), *(F.col(c).alias(f"topic_{c}") for c in carry))
        return R.asof_join(view, topics, ["file"], "topic_offset", "_at", [f"topic_{c}" for c in carry])

    def postings(self) -> DataFrame:
        """(file, keyword, topic_offset): each keyword's slice of the postings, as an equi-join of positions; those of macros (-1) lead nowhere."""
        at = F.explode(F.transform(F.sequence(F.lit(0), F.col("count") - 1), lambda k: F.col("data_offset") + 4 * k))
        each = self.view["keyword"].where("count > 0").select("file", "type", "keyword", at.alias("data_offset"))
        return each.join(self.view["posting"].select("file", "type", "data_offset", "topic_offset"), ["file", "type", "data_offset"]).where("topic_offset >= 0").select("file", "keyword", "topic_offset")

    def targets(self) -> DataFrame:
        """(file, ord, hash, target): each link's topic, its hash and the number of the topic that this leads to, null if none."""
        hash_ = F.conv(F.regexp_extract("target", "^(?:topic|popup):([0-9A-F]{8})$", 1), 16, 10).cast("long")
        links = self.view["link"].select("file", F.col("topic").alias("ord"), hash_.alias("hash"))
        known = self.placed(self.view["context"].select("file", "hash", "topic_offset"), "ord").select("file", "hash", F.col("topic_ord").alias("target"))
        return links.join(known, ["file", "hash"], "left")


def corpus(spark: SparkSession, sf_dir: str) -> Corpus:
    return Corpus(relations(spark, sf_dir))


@query("select file, ord, title, md5(text || 'next') as digest from d")
def container_topics(c):
    return c.topics().join(c.texts(), ["file", "ord"], "left").select("file", "ord", "title", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("digest"))


@query("""select file, ord, string_agg(name, ',' order by name) as names from (select file, ord, 'doc_' || doc_id as name from d union all select file, ord, 'also_' || doc_id from d where doc_id % 5 = 0) group by all""")
def container_context_names(c):
    found = c.placed(c.view["context"].select("file", "hash", "topic_offset"), "ord").join(c.names, "hash", "left")
    name = F.coalesce("name", F.concat(F.lit("CTX_"), F.lpad(F.hex("hash"), 8, "0")))
    return found.groupBy("file", F.col("topic_ord").alias("ord")).agg(F.array_join(F.array_sort(F.collect_list(name)), ",").alias("names"))


@query("select file, keyword, ord from w")
def container_keyword_topics(c):
    return c.placed(c.postings(), "ord").select("file", "keyword", F.col("topic_ord").alias("ord"))


@query("select distinct file, title from w where contains(lower(keyword), 'k3')")
def container_keyword_search(c):
    found = c.postings().where(F.contains(F.lower("keyword"), F.lit("k3")))
    return c.placed(found, "title").select("file", F.col("topic_title").alias("title")).distinct()


@query("select file, ord, lag(title) over (partition by file order by ord) as prev, lead(title) over (partition by file order by ord) as next from d")
def container_browse(c):
    return R.neighbours(c.topics(), ["file"], "topic_offset", "title").select("file", "ord", "prev", "next")


@query("select file, ord, case when quality is not null then 'quality ' || quality end as note from d")
def container_annotations(c):
    notes = c.placed(c.view["annotation"].select("file", "topic_offset", "text"), "ord").select("file", F.col("topic_ord").alias("ord"), F.col("text").alias("note"))
    return c.topics().select("file", "ord").join(notes, ["file", "ord"], "left")


@query("select file, ord, target, target is null as dangling from l")
def container_links(c):
    return c.targets().select("file", "ord", "target", F.col("target").isNull().alias("dangling"))


@query("""select file, target as ord, count(*) as back from l where target is not null group by all""")
def container_links_to_topics(c):
    return c.targets().where("target is not null").groupBy("file", F.col("target").alias("ord")).agg(F.count("*").alias("back"))


@query("""select file, group_no, count(*) as topics from (select d.file, case when ord <= n // 2 then '1' else '2' end as group_no from d join (select file, count(*) as n from d group by file) using (file)) group by all""")
def container_groups(c):
    """Topics by group; where ranges overlap the later one counts."""
    ranges = c.view["group"].select("file", "low", "high", "group_no", F.col("ord").alias("_last"))
    found = covering(c.topics().select("file", "ord"), ranges, ["file"], "ord", "low", "high", "group_no", "_last")
    return found.groupBy("file", "group_no").agg(F.count("*").alias("topics"))


@query("""select file, keyword, level, made, topics from (
select file, keyword, case when contains(keyword, ',') then 1 else 0 end as level, false as made, count(*) as topics from w group by all
union all select distinct file, 'both', 0, true, 0 from w)""")
def container_index(c):
    entries = c.placed(c.postings(), "ord").groupBy("file", "keyword").agg(F.count_distinct("topic_ord").alias("topics"))
    child, parent = F.contains("keyword", F.lit(",")), F.trim(F.split_part("keyword", F.lit(","), F.lit(1)))
    own = entries.select("file", "keyword", F.when(child, 1).otherwise(0).alias("level"), F.lit(False).alias("made"), "topics")
    parents = entries.where(child).select("file", parent.alias("keyword")).distinct().join(entries.select("file", "keyword"), ["file", "keyword"], "left_anti")
    return own.unionByName(parents.select("file", "keyword", F.lit(0).alias("level"), F.lit(True).alias("made"), F.lit(0).cast("long").alias("topics")))


@query("select file, ord, cast(case when doc_id % 3 = 0 then doc_id % 4 end as bigint) as win from d")
def container_windows(c):
    own = c.placed(c.view["window_of"].select("file", "topic_offset", "window"), "ord").select("file", F.col("topic_ord").alias("ord"), F.col("window").alias("win"))
    return c.topics().select("file", "ord").join(own, ["file", "ord"], "left")


@query("""select file, count(*) as topics, cast(sum(length(text) + 4) as bigint) as chars, count(*) as links, cast(count(*) + count(*) filter (doc_id % 5 = 0) as bigint) as contexts, 3 * count(*) + count(*) filter (doc_id % 11 = 0) as postings,
(select count(distinct keyword) from w where w.file = d.file) as keywords, count(quality) as notes from d group by file""")
def container_profile(c):
    chars = c.view["span"].groupBy("file").agg(F.sum(F.length("text")).cast("long").alias("chars"))
    names = {"topic": "topics", "link": "links", "context": "contexts", "posting": "postings", "keyword": "keywords", "annotation": "notes"}
    rows = counted(c, *names)
    counts = rows.groupBy("file").agg(*(F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("n"))), F.lit(0)).cast("long").alias(n) for k, n in names.items()))
    return counts.join(chars, "file")


def counted(c: Corpus, *kinds: str) -> DataFrame:
    """(file, kind, n): the rows that each file has in some relations, counted before they meet."""
    each = [c.view[k].groupBy("file").agg(F.count("*").alias("n")).select("file", F.lit(k).alias("kind"), "n") for k in kinds]
    out = each[0]
    for more in each[1:]:
        out = out.union(more)
    return out


@query("""select file, ord, title, cast(length(text) + 4 as bigint) as chars, 1 as links, 3 as keywords, case when doc_id % 5 = 0 then 2 else 1 end as names from d""")
def container_topic_profile(c):
    own = lambda view, n: c.placed(view, "ord").groupBy("file", F.col("topic_ord").alias("ord")).agg(F.count("*").cast("int").alias(n))
    chars = c.view["span"].groupBy("file", F.col("topic").alias("ord")).agg(F.sum(F.length("text")).cast("long").alias("chars"))
    links = c.view["link"].groupBy("file", F.col("topic").alias("ord")).agg(F.count("*").cast("int").alias("links"))
    out = c.topics().select("file", "ord", "title").join(chars, ["file", "ord"]).join(links, ["file", "ord"])
    return out.join(own(c.postings(), "keywords"), ["file", "ord"]).join(own(c.view["context"].select("file", "topic_offset"), "names"), ["file", "ord"])


@query("""select d.file, d.ord, md5('<section id="topic-' || d.ord || '"><h2>' || title || '</h2><p>' || replace(replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), chr(39), '&#x27;'), chr(10), '<br>')
|| case when target is null then '<span class="dangling">next</span>' else '<a href="#topic-' || target || '">next</a>' end || '</p></section>') as digest from d join l on d.file = l.file and d.ord = l.ord""")
def container_html(c):
    return html(c).select("file", "ord", F.md5(F.col("html").cast("binary")).alias("digest"))


def html(c: Corpus) -> DataFrame:
    """A section of HTML a topic: spans in order, links to the section of their topic, dangling ones marked."""
    targets = c.targets().select("file", F.col("ord").alias("topic"), "hash", "target").distinct()
    hash_ = F.conv(F.regexp_extract("link", "^(?:topic|popup):([0-9A-F]{8})$", 1), 16, 10).cast("long")
    spans = c.view["span"].select("file", "topic", "ord", "text", "link", hash_.alias("hash")).join(targets, ["file", "topic", "hash"], "left")
    body = F.replace(html_escape(F.col("text")), F.lit("\n"), F.lit("<br>"))
    anchored = F.concat(F.lit('<a href="#topic-'), F.col("target").cast("string"), F.lit('">'), body, F.lit("</a>"))
    part = F.when(F.col("link").isNull(), body).when(F.col("target").isNull(), F.concat(F.lit('<span class="dangling">'), body, F.lit("</span>"))).otherwise(anchored)
    joined = spans.groupBy("file", "topic").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", part.alias("p")))), lambda x: x["p"]), "").alias("body"))
    topics = c.topics().join(joined.withColumnRenamed("topic", "ord"), ["file", "ord"], "left")
    pieces = [F.lit('<section id="topic-'), F.col("ord").cast("string"), F.lit('"><h2>'), html_escape(F.col("title")), F.lit("</h2><p>"), F.coalesce("body", F.lit("")), F.lit("</p></section>")]
    return topics.select("file", "ord", F.concat(*pieces).alias("html"))


@query("""select kind, count(*) as rows, count(distinct file) as files from (select 'title' as kind, file from d union all select 'topic', file from d union all select 'keyword', file from (select distinct file, keyword from w)
union all select 'annotation', file from d where quality is not null union all select 'window_of', file from d where doc_id % 3 = 0 union all select 'group', file from (select distinct file, unnest([1, 2]) from d)) group by rollup(kind)""")
def container_statistics(c):
    some = counted(c, "title", "topic", "keyword", "annotation", "window_of", "group")
    return some.rollup("kind").agg(F.sum("n").alias("rows"), F.count_distinct("file").alias("files"))


@query("select file, title, cast(length(title) as bigint) as n from d where length(title) = (select max(length(title)) from d x where x.file = d.file)")
def container_longest_titles(c):
    t = c.view["title"].select("file", "title", F.length("title").cast("long").alias("n"))
    return t.join(t.groupBy("file").agg(F.max("n").alias("n")), ["file", "n"]).select("file", "title", "n")


@query("select file, ord, title from d where doc_id = 7 or doc_id = 300")
def container_topic_by_name(c):
    wanted = c.view["context"].join(c.names.where("name in ('doc_7', 'doc_300')"), "hash").select("file", "topic_offset")
    return c.placed(wanted, "ord", "title").select("file", F.col("topic_ord").alias("ord"), F.col("topic_title").alias("title"))


@query("select file, title, text || 'next' as text from d where ord = 3")
def container_topic_by_number(c):
    return c.topics().where("ord = 3").join(c.texts().where("ord = 3"), ["file", "ord"]).select("file", "title", "text")


@query("select file, ord, title from d where contains(lower(text), 'the') and contains(lower(title), 'en')")
def container_search(c):
    found = c.topics().where(F.contains(F.lower("title"), F.lit("en"))).join(c.texts(), ["file", "ord"])
    return found.where(F.contains(F.lower("text"), F.lit("the"))).select("file", "ord", "title")


@query("select file, coalesce(min(ord) filter (doc_id % 10 = 5), min(ord)) as ord from d group by file")
def container_initial_topic(c):
    """The topic of the first contents entry that leads to one, else the first topic."""
    known = c.placed(c.view["context"].select("file", "hash", "topic_offset"), "ord").select("file", "hash", F.col("topic_ord").alias("_target"))
    entries = c.view["contents"].select("file", "ord", context_hash(F.col("reference")).alias("hash")).join(known, ["file", "hash"])
    authored = entries.groupBy("file").agg(F.min_by("_target", "ord").alias("_authored"))
    first = c.topics().groupBy("file").agg(F.min("ord").alias("_first"))
    return first.join(authored, "file", "left").select("file", F.coalesce("_authored", "_first").alias("ord"))


@query("""select d.file, count(*) filter (target is null) as errors, 8 + max((doc_id % 3 = 0)::int) + max((doc_id % 10 = 5)::int) + count(quality) as parts from d join l on d.file = l.file and d.ord = l.ord group by d.file""")
def container_parts(c):
    """Of each file the parts that it has, a relation each and each annotation one of its own, and its links that lead nowhere."""
    kinds = counted(c, "topic", "title", "span", "link", "context", "keyword", "posting", "group", "annotation", "window_of", "contents")
    parts = kinds.groupBy("file").agg(F.sum(F.when(F.col("kind") == "annotation", F.col("n")).otherwise(1)).alias("parts"))
    broken = c.targets().groupBy("file").agg(F.count_if(F.col("target").isNull()).alias("errors"))
    return parts.join(broken, "file").select("file", "errors", "parts")


@query("select file, ord, 'also_' || doc_id as reference, case when doc_id % 5 = 0 then ord end as target from d")
def container_contents_to_topics(c):
    """Contents entries to topics: the name's hash, the hash's offset, the offset's topic."""
    number = F.regexp_extract("title", "^T([0-9]+) ", 1)
    entries = c.topics().select("file", "ord", F.concat(F.lit("also_"), number).alias("reference"))
    known = c.placed(c.view["context"].select("file", "hash", "topic_offset"), "ord").select("file", "hash", F.col("topic_ord").alias("target"))
    return entries.withColumn("hash", context_hash(F.col("reference"))).join(known, ["file", "hash"], "left").select("file", "ord", "reference", "target")


@query("select file, upper(file) as wanted, ord, title from d")
def container_external_topics(c):
    """Links into sibling files: the file by its name whatever the case, then the hash, then the topic."""
    number = F.regexp_extract("title", "^T([0-9]+) ", 1)
    links = c.topics().select(F.upper("file").alias("wanted"), context_hash(F.concat(F.lit("doc_"), number)).alias("hash"))
    files = c.view["topic"].select("file").distinct().select("file", F.lower("file").alias("name"))
    placed = c.placed(c.view["context"].select("file", "hash", "topic_offset"), "ord", "title")
    found = links.join(files, F.lower("wanted") == F.col("name")).select("file", "wanted", "hash").join(placed, ["file", "hash"])
    return found.select("file", "wanted", F.col("topic_ord").alias("ord"), F.col("topic_title").alias("title"))


@query("select d.file, d.ord from d where not exists (select 1 from l where l.file = d.file and l.target = d.ord)")
def container_entry_points(c):
    """Topics that no link of their file leads to."""
    led = c.targets().where("target is not null").select("file", F.col("target").alias("ord")).distinct()
    return c.topics().select("file", "ord").join(led, ["file", "ord"], "left_anti")


@query("""select file, count(quality) as notes, max(length('quality ' || quality)) as longest, count(distinct quality) as texts from d where quality is not null group by rollup(file)""")
def container_note_statistics(c):
    return c.view["annotation"].rollup("file").agg(F.count("*").alias("notes"), F.max(F.length("text")).cast("long").alias("longest"), F.count_distinct("text").alias("texts"))


@query("select kind, cast(count(*) as bigint) as n from (select 'valid' as kind from w union all select 'macro' from d where doc_id % 11 = 0) group by kind")
def container_postings_validity(c):
    p = c.view["posting"].select(F.when(F.col("topic_offset") == -1, "macro").otherwise("valid").alias("kind"))
    return p.groupBy("kind").agg(F.count("*").alias("n"))


@query("""select file, form, kind, ord, choices from (
select d.file, 'number' as form, 'topic' as kind, ord, 0 as choices from d
union all select file, 'hash', 'popup', ord, 0 from d
union all select file, 'name', 'topic', ord, 0 from d
union all select file, 'name in a file', 'external', null, 0 from d
union all select file, 'offset', 'external', null, 0 from d
union all select file, 'other macro', 'macro', null, 0 from d
union all select file, 'nothing', 'unresolved', null, 0 from d
union all select d.file, 'keyword', case when n = 1 then 'topic' else 'choice' end, low, n from d join (select file, k, count(distinct ord) as n, min(ord) as low from (select file, ord, doc_id % 7 as k from d union all select file, ord, doc_id % 3 from d) group by all) g on d.file = g.file and d.doc_id % 7 = k)""")
def container_resolution(c):
    """Each topic sought in eight ways: one operator resolves all of them."""
    name = F.concat(F.lit("doc_"), F.regexp_extract("title", "^T([0-9]+) ", 1))
    quoted = F.concat(F.lit('"'), name, F.lit('"'))
    forms = {
        "number": F.concat(F.lit("topic:TOPIC"), F.col("ord").cast("string")),
        "hash": F.concat(F.lit("popup:"), F.hex(context_hash(name))),
        "name": F.concat(F.lit("macro:JumpID("), quoted, F.lit(")")),
        "name in a file": F.concat(F.lit('macro:JumpID("other.hlp", '), quoted, F.lit(")")),
        "offset": F.concat(F.lit("topic_offset:"), F.col("topic_offset").cast("string")),
        "other macro": F.lit('macro:ExecFile("calc.exe")'),
        "nothing": F.lit("idh_unknown"),
        "keyword": F.concat(F.lit("macro:KLink(\"K"), (F.regexp_extract("title", "^T([0-9]+) ", 1).cast("long") % 7).cast("string"), F.lit("; no such word\")")),
    }
    asked = c.topics().select("file", F.explode(F.array(*(F.struct(F.lit(k).alias("form"), t.alias("target")) for k, t in forms.items()))).alias("f")).select("file", "f.*")
    index = c.placed(c.postings(), "ord").select("file", "keyword", F.col("topic_ord").alias("ord"))
    found = resolve(asked, c.topics().select("file", "ord", "topic_offset"), c.view["context"].select("file", "hash", "topic_offset"), index)
    return found.select("file", "form", "kind", "ord", "choices")


@query("""select file, ord, title from d where contains(lower(text || ' ' || title || ' doc_' || doc_id || ' ' || lang || ' k' || (doc_id % 7) || ' both, k' || (doc_id % 3)), 'k5') and contains(lower(text || ' ' || title || ' doc_' || doc_id || ' ' || lang), 'the')""")
def container_search_everywhere(c):
    """All terms, in title, text, context names or keywords of a topic."""
    key = ["file", "ord"]
    texts = c.texts()
    words = c.placed(c.postings(), "ord").groupBy("file", F.col("topic_ord").alias("ord")).agg(F.array_join(F.collect_list("keyword"), " ").alias("words"))
    named = c.placed(c.view["context"].select("file", "hash", "topic_offset"), "ord").join(c.names, "hash").groupBy("file", F.col("topic_ord").alias("ord")).agg(F.array_join(F.collect_list("name"), " ").alias("named"))
    whole = c.topics().join(texts, key, "left").join(words, key, "left").join(named, key, "left")
    return whole.where(S.all_terms(F.concat_ws(" ", "text", "title", "named", "words"), "THE k5")).select("file", "ord", "title")


LINES_SQL = "select file, ord, '1 ' || title || '=' || case when doc_id % 5 = 0 then 'also_' else 'doc_' end || doc_id || case when doc_id % 3 = 0 then '>' || (doc_id % 4) else '' end as line from d"


def contents_lines(c: Corpus) -> DataFrame:
    """A contents file made from titles, the first name of each topic and its window."""
    starts = c.topics().select("file", "ord", F.col("topic_offset").alias("_start"))
    begun = lambda df: df.join(starts, (df["file"] == starts["file"]) & (df["topic_ord"] == starts["ord"])).select(df["file"], F.col("_start").alias("topic_offset"), *(df[k] for k in df.columns if k not in ("file", "topic_offset", "topic_ord")))
    names = begun(c.placed(c.view["context"].select("file", "hash", "topic_offset"), "ord").join(c.names, "hash"))
    windows = begun(c.placed(c.view["window_of"], "ord"))
    lines = contents.write_lines(c.view["title"], names, windows)
    return lines.join(starts, (lines["file"] == starts["file"]) & (lines["topic_offset"] == starts["_start"])).select(lines["file"], "ord", "line")


@query(LINES_SQL)
def container_contents_lines(c):
    return contents_lines(c)


@query(f"select file, ord, 'topic' as kind, 0 as level, regexp_extract(line, '^1 (.*)=', 1) as label, regexp_extract(line, '=(.*)$', 1) as reference from ({LINES_SQL})")
def container_contents_parsed(c):
    """The lines read again: kind, level, label and reference of each."""
    return contents.parsed(contents_lines(c))
