"""Further queries over the driver's tables: filters, lookups, orders, fallbacks and labels, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions.text import context_hash, html_escape, names_from_titles, reverse_hashes
from folioscope.operators import relational as R
from folioscope.operators.cover import cover_in_rounds
from folioscope.queries import HASH_SQL, TARGETS, _targets, read, registry

QUERIES, ORACLE_SQL, query = registry()

SPOTS_SQL = f"select l_orderkey, l_linenumber, target, case when starts_with(target, 'macro:') then 'macro' when starts_with(target, 'popup:') then 'popup' when contains(target, '@') then 'external' else 'jump' end as type from (select l_orderkey, l_linenumber, {TARGETS} as target from (select *, lpad(to_hex(l_partkey), 8, '0') as hex_ from lineitem))"


def hotspots(spark, sf_dir) -> DataFrame:
    """Targets of line items as hotspots with their type."""
    kind = F.when(F.startswith("target", F.lit("macro:")), "macro").when(F.startswith("target", F.lit("popup:")), "popup").when(F.contains("target", F.lit("@")), "external").otherwise("jump")
    return _targets(spark, sf_dir).select("l_orderkey", "l_linenumber", "target", kind.alias("type"))


@query(f"""select * from ({SPOTS_SQL}) where type = 'popup'""")
def hotspots_by_type(spark, sf_dir):
    return hotspots(spark, sf_dir).where("type = 'popup'")


@query(f"""select * from ({SPOTS_SQL}) where type in ('jump', 'popup', 'external')""")
def hyperlinks(spark, sf_dir):
    """Hotspots that lead to a place: all but macros."""
    return hotspots(spark, sf_dir).where(F.col("type").isin("jump", "popup", "external"))


@query("""with m as (select event_id, event_type || case when value < 50 then ':left:bm' else ':right:bm' end || user_id as marker from events)
select event_id, regexp_extract(marker, '^([^:]*):([^:]*):(.*)$', 1) as kind, regexp_extract(marker, '^([^:]*):([^:]*):(.*)$', 2) as align, regexp_extract(marker, '^([^:]*):([^:]*):(.*)$', 3) as name from m where contains(marker, ':')""")
def embedded_resources(spark, sf_dir):
    """Markers of embedded pictures taken apart: each event has one."""
    marker = F.concat("event_type", F.when(F.col("value") < 50, F.lit(":left:bm")).otherwise(F.lit(":right:bm")), F.col("user_id").cast("string"))
    marked = read(spark, sf_dir, "events").select("event_id", marker.alias("marker")).where(F.contains("marker", F.lit(":")))
    part = lambda k: F.regexp_extract("marker", "^([^:]*):([^:]*):(.*)$", k)
    return marked.select("event_id", part(1).alias("kind"), part(2).alias("align"), part(3).alias("name"))


@query("""select c_custkey, 'bm' || n_nationkey as picture, n_name as title from customer join nation on 'bm' || c_nationkey = 'bm' || n_nationkey""")
def images_to_pictures(spark, sf_dir):
    """Images to the pictures that they name, by name."""
    images = read(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("bm"), F.col("c_nationkey").cast("string")).alias("picture"))
    pictures = read(spark, sf_dir, "nation").select(F.concat(F.lit("bm"), F.col("n_nationkey").cast("string")).alias("picture"), F.col("n_name").alias("title"))
    return images.join(pictures, "picture").select("c_custkey", "picture", "title")


@query("""select l_partkey as keyword_no, count(*) as entries from lineitem where l_linenumber = 3 group by all""")
def keyword_page_filter(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").where("l_linenumber = 3").groupBy(F.col("l_partkey").alias("keyword_no")).agg(F.count("*").alias("entries"))


@query("""with r as (select c_custkey, case when c_custkey % 2 = 0 then cast(c_nationkey as varchar) when c_custkey % 3 = 0 then upper(n_name) else 'none' end as win from customer join nation on c_nationkey = n_nationkey)
select c_custkey, win, coalesce(a.n_name, b.n_name) as caption from r left join nation a on cast(a.n_nationkey as varchar) = win left join nation b on lower(b.n_name) = lower(win)""")
def window_captions(spark, sf_dir):
    """A window by its number or by its name: two equi-joins, not one with OR."""
    nation = read(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    own = read(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    ref = F.when(F.col("c_custkey") % 2 == 0, F.col("c_nationkey").cast("string")).when(F.col("c_custkey") % 3 == 0, F.upper("n_name")).otherwise("none")
    own = own.select("c_custkey", ref.alias("win"))
    number = nation.select(F.col("n_nationkey").cast("string").alias("win"), F.col("n_name").alias("_a"))
    name = nation.select(F.lower("n_name").alias("_key"), F.col("n_name").alias("_b"))
    found = own.join(number, "win", "left").join(name, F.lower("win") == F.col("_key"), "left")
    return found.select("c_custkey", "win", F.coalesce("_a", "_b").alias("caption"))


@query("""select d.doc_id, d.doc_id || '!0' as part, quality from documents d join (select doc_id || '!0' as part, quality from labels) n on d.doc_id || '!0' = n.part""")
def annotation_parts(spark, sf_dir):
    links = read(spark, sf_dir, "documents").select("doc_id", F.concat(F.col("doc_id").cast("string"), F.lit("!0")).alias("part"))
    files = read(spark, sf_dir, "labels").select(F.concat(F.col("doc_id").cast("string"), F.lit("!0")).alias("part"), "quality")
    return links.join(files, "part").select("doc_id", "part", "quality")


@query("""select p_partkey, row_number() over (order by lower(p_name), p_partkey) - 1 as place from part""")
def sorted_keywords(spark, sf_dir):
    part = read(spark, sf_dir, "part").select("p_partkey", F.lower("p_name").alias("_name"))
    return R.numbered(part, ["_name", "p_partkey"], "place").select("p_partkey", "place")


@query("""select p_brand, array_to_string(list_sort(list_distinct(list(p_type)))[1:6], ',') as names from part group by p_brand""")
def first_six_names(spark, sf_dir):
    # a limit by group: no task keeps more than six names of a brand
    kinds = read(spark, sf_dir, "part").select("p_brand", "p_type").distinct()
    first = kinds.withColumn("_k", F.row_number().over(Window.partitionBy("p_brand").orderBy("p_type"))).where("_k <= 6")
    return first.groupBy("p_brand").agg(F.array_join(F.sort_array(F.collect_list("p_type")), ",").alias("names"))


@query("""with own as (select n_regionkey, n_name, 'authored' as origin from nation where length(n_name) > 8) select * from own
union all select n_regionkey, n_name, 'derived' from nation where n_regionkey not in (select n_regionkey from own)""")
def fallback_entries(spark, sf_dir):
    nation = read(spark, sf_dir, "nation").select("n_regionkey", "n_name")
    own = nation.where("length(n_name) > 8").withColumn("origin", F.lit("authored"))
    return own.union(nation.join(own, "n_regionkey", "left_anti").select("n_regionkey", "n_name", F.lit("derived")))


@query("""with e as (select n_regionkey, 0 as prio, n_name as label from nation where length(n_name) > 9 union all select n_regionkey, 1, n_name from nation where length(n_name) > 7 union all select n_regionkey, 2, n_name from nation)
select n_regionkey, prio, label from e where prio = (select min(prio) from e x where x.n_regionkey = e.n_regionkey)""")
def contents_by_priority(spark, sf_dir):
    nation = read(spark, sf_dir, "nation").select("n_regionkey", F.col("n_name").alias("label"), F.length("n_name").alias("_n"))
    entries = nation.withColumn("prio", F.explode(F.array(*map(F.lit, range(3))))).where((F.col("prio") == 2) | (F.col("_n") > F.when(F.col("prio") == 0, 9).otherwise(7)))
    best = entries.groupBy("n_regionkey").agg(F.min("prio").alias("prio"))
    return entries.join(best, ["n_regionkey", "prio"]).select("n_regionkey", "prio", "label")


@query("""select conv_id, string_agg(role, ',' order by first) as roles from (select conv_id, role, min(turn) as first from conversations group by all) group by conv_id""")
def ordered_distinct(spark, sf_dir):
    firsts = read(spark, sf_dir, "conversations").groupBy("conv_id", "role").agg(F.min("turn").alias("first"))
    listed = F.transform(F.sort_array(F.collect_list(F.struct("first", "role"))), lambda x: x["role"])
    return firsts.groupBy("conv_id").agg(F.array_join(listed, ",").alias("roles"))


@query("""select doc_id, cast(pos - 1 as integer) as pos from (select doc_id, unnest(ws) as word, generate_subscripts(ws, 1) as pos from (select doc_id, string_split(text, ' ') as ws from documents)) where word = 'the'""")
def positions_of_value(spark, sf_dir):
    words = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", " ")).alias("pos", "word"))
    return words.where("word = 'the'").select("doc_id", "pos")


@query("""select event_id, user_id, event_type from (select *, lag(event_type) over (partition by user_id order by event_id) as before from events) where event_type is distinct from before""")
def navigation_visits(spark, sf_dir):
    """A visit of the page that one is on leaves no trace in the history."""
    seen = R.neighbours(read(spark, sf_dir, "events").select("event_id", "user_id", "event_type"), ["user_id"], "event_id", "event_type")
    return seen.where(~F.col("event_type").eqNullSafe(F.col("prev"))).select("event_id", "user_id", "event_type")


@query("""select p_partkey, case when p_size < 16 then '3.0' when p_size <= 21 then '3.1' when p_size = 27 then 'MediaView' when p_size >= 33 then '95' else 'unknown' end as version from part""")
def version_labels(spark, sf_dir):
    size = F.col("p_size")
    version = F.when(size < 16, "3.0").when(size <= 21, "3.1").when(size == 27, "MediaView").when(size >= 33, "95").otherwise("unknown")
    return read(spark, sf_dir, "part").select("p_partkey", version.alias("version"))


@query("""select o_orderkey, translate(cast(o_orderkey as varchar), '0123456789', '⁰¹²³⁴⁵⁶⁷⁸⁹') as raised, translate(cast(o_orderkey as varchar), '0123456789', '₀₁₂₃₄₅₆₇₈₉') as lowered, upper(o_orderpriority) as capitals from orders""")
def raised_and_lowered(spark, sf_dir):
    number = F.col("o_orderkey").cast("string")
    orders = read(spark, sf_dir, "orders")
    return orders.select("o_orderkey", F.translate(number, "0123456789", "⁰¹²³⁴⁵⁶⁷⁸⁹").alias("raised"), F.translate(number, "0123456789", "₀₁₂₃₄₅₆₇₈₉").alias("lowered"), F.upper("o_orderpriority").alias("capitals"))


MACRO = r"^\s*[A-Za-z]\w*\s*\(\s*(?:(?:`[^`]*`|\"[^\"]*\"|[-\w.]+)\s*(?:,\s*(?:`[^`]*`|\"[^\"]*\"|[-\w.]+)\s*)*)?\)\s*$"


@query(f"""with t as (select l_orderkey, l_linenumber, {TARGETS} as target from (select *, lpad(to_hex(l_partkey), 8, '0') as hex_ from lineitem)) select l_orderkey, l_linenumber, regexp_matches(replace(target, 'macro:', ''), '{MACRO}') as valid from t""")
def macro_syntax(spark, sf_dir):
    return _targets(spark, sf_dir).select("l_orderkey", "l_linenumber", F.replace("target", F.lit("macro:"), F.lit("")).rlike(MACRO).alias("valid"))


#: A hash written in base 43, for each of 43 lost high words: the first whose digits all are letters of names.
INVERTED_SQL = f"""h as (select distinct {HASH_SQL.format("p_name")} as hash from part),
digits as (select hash, high, list_transform(range(9), lambda i: cast((cast(high as hugeint) * 4294967296 + hash) // cast(power(43, i) as hugeint) % 43 as integer)) as low_first, cast(high as hugeint) * 4294967296 + hash as x from h, (select unnest(range(43)) as high)),
used as (select hash, high, low_first[1 : (select count(*) from range(9) r(i) where power(43, i) <= x)] as ds from digits where x > 0),
spelt as (select hash, high, list_reduce(list_prepend('', list_transform(ds, lambda d: case when d between 1 and 9 then chr(48 + d) when d = 10 then '0' when d = 12 then '.' when d = 13 then '_' when d between 17 and 42 then chr(48 + d) else ' ' end)), lambda a, b: b || a) as name from used),
inverted as (select hash, arg_min(name, high) as name from spelt where not contains(name, ' ') and name <> '' group by hash)"""


@query(f"""with {INVERTED_SQL} select p_partkey, hash, case when hash = 1 then '' else coalesce(name, 'CTX_' || lpad(upper(to_hex(hash)), 8, '0')) end as name from (select p_partkey, {HASH_SQL.format("p_name")} as hash from part) left join inverted using (hash)""")
def reversed_hashes(spark, sf_dir):
    """A name for each hash, made without a dictionary; the SQL inverts the hash by itself."""
    wanted = read(spark, sf_dir, "part").select("p_partkey", context_hash(F.col("p_name")).alias("hash"))
    return reverse_hashes(wanted, "hash", "name").select("p_partkey", "hash", "name")


@query("""select p_partkey, 'idh_' || replace(p_name, ' ', '_') as name from part""")
def names_of_titles(spark, sf_dir):
    named = F.concat(F.lit("idh_"), F.replace("p_name", F.lit(" "), F.lit("_")))
    titles = read(spark, sf_dir, "part").select("p_partkey", "p_name", context_hash(named).alias("hash"))
    return names_from_titles(titles, "hash", "p_name", "name").select("p_partkey", "name")


@query("""select distinct 'f' || substr(p_brand, 7) || case when p_size > 25 then 'b' else '' end as class, case when p_size > 25 then 'bold' else 'normal' end as weight from part""")
def font_classes(spark, sf_dir):
    bold = F.col("p_size") > 25
    name = F.concat(F.lit("f"), F.substring("p_brand", 7, 100), F.when(bold, "b").otherwise(""))
    return read(spark, sf_dir, "part").select(name.alias("class"), F.when(bold, "bold").otherwise("normal").alias("weight")).distinct()


@query("""select n_regionkey, '<table>' || string_agg('<tr><td>' || n_nationkey || '</td><td align="left">' || n_name || '</td></tr>', '' order by n_nationkey) || '</table>' as html from nation group by n_regionkey""")
def html_tables(spark, sf_dir):
    cells = F.concat(F.lit("<tr><td>"), F.col("n_nationkey").cast("string"), F.lit('</td><td align="left">'), html_escape(F.col("n_name")), F.lit("</td></tr>"))
    rows = F.transform(F.sort_array(F.collect_list(F.struct("n_nationkey", cells.alias("c")))), lambda x: x["c"])
    return read(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.concat(F.lit("<table>"), F.array_join(rows, ""), F.lit("</table>")).alias("html"))


FILES_SQL = """with f as (select page_id, regexp_extract(url, '^([^?#]*/)', 1) as dir, regexp_extract(url, '^[^?#]*/([^/?#]*)', 1) as name from pages)"""


#: Pages of a folder are listed, and get their siblings, so many at a time.
SIDE_BY_SIDE = 1024


@query(f"""{FILES_SQL}, s as (select *, list(page_id) over (partition by dir order by page_id rows between unbounded preceding and unbounded following) as all_ids from f)
select page_id, dir, name, count(*) over (partition by dir) - 1 as siblings, (row_number() over (partition by dir order by page_id) - 1) // 32 as part,
array_to_string(list_filter(all_ids, lambda x: x <> page_id), ',') as sibling_ids from s""")
def sibling_files(spark, sf_dir):
    """Each page with its folder, the number of its siblings there, its part of 32, and all its siblings by page_id: every pair of pages of a folder."""
    by = ["_d0", "_d1"]  # pages without an url are siblings too
    files = _files(spark, sf_dir).withColumns({"_d0": F.col("dir").isNull(), "_d1": F.coalesce("dir", F.lit(""))})
    placed = R.running_total(files.withColumn("_one", F.lit(1)), by, "page_id", "_one", "_place").withColumn("_block", F.expr(f"_place div {SIDE_BY_SIDE}"))
    listed = placed.groupBy(*by, "_block").agg(F.sort_array(F.collect_list("page_id")).alias("_ids"))
    whole = listed.groupBy(*by).agg(F.flatten(F.sort_array(F.collect_list(F.struct("_block", "_ids")))["_ids"]).alias("_ids"), F.collect_list("_block").alias("_blocks"))
    # a folder's list goes to each block of its pages, so that a large folder is no single task; what is small here is large once
    # written, so the number of tasks is given and adaptive execution doesn't join them
    dealt = int(spark.conf.get("spark.sql.shuffle.partitions")), *by, "_block"
    each = placed.repartition(*dealt).join(whole.select(*by, "_ids", F.explode("_blocks").alias("_block")).repartition(*dealt), [*by, "_block"])
    others = F.array_join(F.filter("_ids", lambda x: x != F.col("page_id")).cast("array<string>"), ",")
    return each.select("page_id", "dir", "name", (F.size("_ids") - 1).cast("long").alias("siblings"), F.expr("_place div 32").alias("part"), others.alias("sibling_ids"))


def _files(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "^([^?#]*/)", 1).alias("dir"), F.regexp_extract("url", "^[^?#]*/([^/?#]*)", 1).alias("name"))


@query(f"""{FILES_SQL}, w as (select page_id, regexp_extract(dir, '^(https?://[^/]*/)', 1) || 'en/' as dir, lower(name) as wanted from f), k as (select dir, lower(name) as wanted, min(page_id) as sibling from f group by all)
select w.page_id, w.wanted, sibling from w left join k using (dir, wanted)""")
def sibling_by_name(spark, sf_dir):
    """The file of a wanted name in a folder, whatever the case, the first of several; null where there is none."""
    files = _files(spark, sf_dir)
    wanted = files.select("page_id", F.concat(F.regexp_extract("dir", "^(https?://[^/]*/)", 1), F.lit("en/")).alias("dir"), F.lower("name").alias("wanted"))
    known = files.groupBy("dir", F.lower("name").alias("wanted")).agg(F.min("page_id").alias("sibling"))
    return wanted.join(known, ["dir", "wanted"], "left").select("page_id", "wanted", "sibling")


@query(None)
def cover_of_signatures(spark, sf_dir):
    """Files (suppliers) that together have all signatures that any has (kinds of parts by line and status), chosen by new ones a byte, in few rounds."""
    part = read(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type")
    items = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("key"), F.col("l_partkey").alias("p_partkey"), "l_linenumber", "l_returnflag")
    pairs = items.join(part, "p_partkey").select("key", F.concat_ws(" ", "p_brand", "p_type", F.col("l_linenumber").cast("string"), "l_returnflag").alias("item"))
    return cover_in_rounds(pairs.distinct(), items.groupBy("key").agg(F.count("*").alias("cost")))
