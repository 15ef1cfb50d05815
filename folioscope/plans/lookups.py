"""Queries of indexes, intervals, histories, chains, covers and exports over the driver's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.functions import nested
from folioscope.functions.text import context_hash, fold
from folioscope.operators import names as N
from folioscope.operators import relational as R
from folioscope.operators import search as S
from folioscope.operators import sequences as Q
from folioscope.operators import trigrams
from folioscope.operators.cover import having_all
from folioscope.operators.intervals import covering, in_rectangles
from folioscope.operators.navigation import replay
from folioscope.queries import HASH_SQL, TARGETS, _targets, read, registry

QUERIES, ORACLE_SQL, query = registry()

_FOLDED = "replace(lower({0}), 'ß', 'ss')"


@query(f"""with q as (select doc_id as query_id, list_distinct(list_filter(string_split_regex({_FOLDED.format("array_to_string(string_split_regex(text, '\\s+')[1:3], ' ')")}, '\\s+'), lambda t: t <> '')) as terms from documents where doc_id % 100 = 0),
t as (select doc_id, {_FOLDED.format("text")} as folded from documents where text is not null)
select query_id, doc_id from q join t on len(list_filter(terms, lambda x: not contains(folded, x))) = 0""")
def topic_search_indexed(spark, sf_dir):
    """All-terms searches by trigrams: the first three words of every hundredth text, sought in all texts."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    asked = docs.where("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), F.upper(F.array_join(F.slice(F.split("text", r"\s+"), 1, 3), " ")).alias("query"))
    return trigrams.search(trigrams.build(docs, "doc_id", "text"), asked, "query_id", "query")


MOVES_SQL = "select event_id, user_id, case event_type when 'error' then 'back' when 'signup' then 'forward' else 'visit' end as move, event_type as page, row_number() over (partition by user_id order by event_id) as n from events"


@query(f"""with recursive e as ({MOVES_SQL}),
r as (select cast(null as bigint) as event_id, user_id, cast(0 as bigint) as n, cast([] as varchar[]) as h, 0 as i from (select distinct user_id from events)
union all select e.event_id, e.user_id, e.n, case when e.move = 'visit' and (i = 0 or h[i] <> e.page) then list_append(h[1:i], e.page) else h end,
case when e.move = 'back' then greatest(i - 1, least(i, 1)) when e.move = 'forward' then least(i + 1, len(h)) when i = 0 or h[i] <> e.page then i + 1 else i end
from r join e on e.user_id = r.user_id and e.n = r.n + 1)
select event_id, user_id, case when i > 0 then h[i] end as shown, cast(i as bigint) as depth from r where event_id is not null""")
def navigation_replay(spark, sf_dir):
    """Each event of a user's history with the page that it shows; errors go back, sign-ups go forward."""
    move = F.when(F.col("event_type") == "error", "back").when(F.col("event_type") == "signup", "forward").otherwise("visit")
    events = read(spark, sf_dir, "events").select("event_id", "user_id", move.alias("move"), F.col("event_type").alias("page"))
    return replay(events, "user_id", "event_id", "move", "page").select("event_id", "user_id", "shown", "depth")


WIDE_SQL = "select c_custkey, (c_custkey * 7919) % (m + 1) as low, (c_custkey * 7919) % (m + 1) + (c_custkey * c_custkey) % (m + 1) as high from customer, (select max(o_orderkey) as m from orders)"


@query(f"""with r as ({WIDE_SQL}) select o_orderkey, max(c_custkey) as owner from orders left join r on o_orderkey between low and high group by o_orderkey""")
def nested_ranges(spark, sf_dir):
    """Ranges up to as wide as the table, nested and overlapping: the last one that holds a key owns it."""
    orders = read(spark, sf_dir, "orders").select("o_orderkey")
    most = orders.agg(F.max("o_orderkey")).first()[0] or 0
    key = F.col("c_custkey")
    low = (key * 7919) % (most + 1)
    ranges = read(spark, sf_dir, "customer").select(low.alias("low"), (low + (key * key) % (most + 1)).alias("high"), key.alias("owner"), key.alias("_order"))
    return covering(orders, ranges, [], "o_orderkey", "low", "high", "owner", "_order")


@query("""with p as (select first, max(page) as page from (select l_suppkey as page, min(l_partkey) + l_suppkey as first from lineitem group by l_suppkey) group by first)
select p_partkey, page from part asof left join p on p_partkey >= first""")
def keyword_number_pages(spark, sf_dir):
    """The page of each keyword number: that of the greatest first number up to it."""
    pages = read(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("page")).agg((F.min("l_partkey") + F.col("page")).alias("first"))
    return R.asof_join(read(spark, sf_dir, "part").select("p_partkey"), pages, [], "p_partkey", "first", ["page"])


BOXES_SQL = "select s_suppkey, (s_suppkey * 13) % 1900 as x0, (s_suppkey * 13) % 1900 + (s_suppkey * s_suppkey) % 211 as x1, s_suppkey % 50 as y0, s_suppkey % 50 + s_nationkey * 3 as y1 from supplier"


@query(f"""select l_orderkey, l_linenumber, s_suppkey from lineitem join ({BOXES_SQL}) on l_partkey between x0 and x1 and l_suppkey between y0 and y1""")
def points_in_boxes(spark, sf_dir):
    """Points in rectangles of any size and place, by cells of two levels in Z-order."""
    key = F.col("s_suppkey")
    left, low = (key * 13) % 1900, key % 50
    boxes = read(spark, sf_dir, "supplier").select(key, left.alias("x0"), (left + (key * key) % 211).alias("x1"), low.alias("y0"), (low + F.col("s_nationkey") * 3).alias("y1"))
    points = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return in_rectangles(points, boxes, "l_partkey", "l_suppkey", "x0", "x1", "y0", "y1").select("l_orderkey", "l_linenumber", "s_suppkey")


@query(f"""with c as (select {HASH_SQL.format('p_name')} as hash, min(p_partkey) as topic, min(p_name) as name from part where p_size > 10 group by 1),
h as (select l_orderkey, l_linenumber, l_partkey % 640 as x, l_suppkey % 480 as y, {HASH_SQL.format('p_name')} as hash from lineitem join part on l_partkey = p_partkey)
select l_orderkey, l_linenumber, x as region_left, y as region_top, x + 16 as region_right, y + 12 as region_bottom, topic, coalesce(name, 'CTX_' || lpad(upper(to_hex(hash)), 8, '0')) as name from h left join c using (hash)""")
def picture_hotspots(spark, sf_dir):
    """Regions of pictures with the topics and names that their hashes lead to; hashes are kept signed or unsigned."""
    part = read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")
    hashed = part.select("p_partkey", "p_name", "p_size", context_hash(F.col("p_name")).alias("hash"))
    contexts = hashed.where("p_size > 10").groupBy("hash").agg(F.min("p_partkey").alias("topic"), F.min("p_name").alias("_name"))
    items = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("p_partkey"), "l_suppkey").join(hashed, "p_partkey")
    signed = F.when((F.col("l_linenumber") % 2 == 1) & (F.col("hash") >= 1 << 31), F.col("hash") - (1 << 32)).otherwise(F.col("hash"))
    x, y = F.col("p_partkey") % 640, F.col("l_suppkey") % 480
    spots = items.select("l_orderkey", "l_linenumber", x.alias("region_left"), y.alias("region_top"), (x + 16).alias("region_right"), (y + 12).alias("region_bottom"), F.pmod(signed, F.lit(1 << 32)).alias("hash"))
    made = F.concat(F.lit("CTX_"), F.lpad(F.hex("hash"), 8, "0"))
    return spots.join(contexts, "hash", "left").select("l_orderkey", "l_linenumber", "region_left", "region_top", "region_right", "region_bottom", "topic", F.coalesce("_name", made).alias("name"))


@query("""select p_partkey, 'idh_' || split_part(p_name, ' ', 1) || '_' || p_type as name from part""")
def names_by_ending(spark, sf_dir):
    """Names whose ending is no part of the title, found from the hash: beginnings from titles, endings from a list."""
    part = read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type")
    begin = F.concat(F.lit("idh_"), F.split_part("p_name", F.lit(" "), F.lit(1)))
    wanted = part.select("p_partkey", begin.alias("begin"), context_hash(F.concat(begin, F.lit("_"), "p_type")).alias("hash"))
    endings = part.select(F.concat(F.lit("_"), "p_type").alias("ending")).distinct()
    return N.names_by_ending(wanted, endings, "p_partkey", "hash", "begin", "ending", "name")


@query("""with recursive e as (select o_orderkey as node, o_custkey * 13 as next from orders),
inn as (select next as node, min(node) as prev from e where next in (select node from e) and next <> node group by next),
walk as (select node, node as place_of, cast(0 as bigint) as steps from e union all select walk.node, prev, steps + 1 from walk join inn on inn.node = place_of where prev <> walk.node),
ends as (select node, max(steps) as steps, min(place_of) as least from walk group by node),
looped as (select ends.node, least from ends join walk on walk.node = ends.node and walk.steps = ends.steps join inn on inn.node = place_of where prev = ends.node),
placed as (select walk.node, place_of as first, walk.steps as place from walk join ends on walk.node = ends.node and walk.steps = ends.steps where walk.node not in (select node from looped)
union all select walk.node, least, walk.steps from walk join looped on walk.node = looped.node and place_of = least)
select node, dense_rank() over (order by first) - 1 as chain, place from placed""")
def browse_sequences(spark, sf_dir):
    """Chains of links that merge, break off and go round in circles: each node's chain and its place there."""
    links = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("node"), (F.col("o_custkey") * 13).alias("next"))
    return Q.browse_sequences(links)


@query("""with w as (select distinct p_type from part), had as (select distinct l_suppkey, p_type from lineitem join part on l_partkey = p_partkey where l_linenumber < 3)
select s.l_suppkey, count(h.p_type) as n_had, count(h.p_type) = count(w.p_type) as complete, coalesce(string_agg(w.p_type, ',' order by w.p_type) filter (h.p_type is null), '') as missing
from (select distinct l_suppkey from lineitem) s cross join w left join had h on h.l_suppkey = s.l_suppkey and h.p_type = w.p_type group by s.l_suppkey""")
def suppliers_of_all_types(spark, sf_dir):
    """Sets of which all members have to be there: suppliers of all types of parts in the first lines of orders, and what the others lack."""
    part = read(spark, sf_dir, "part").select("p_partkey", "p_type")
    items = read(spark, sf_dir, "lineitem").select("l_suppkey", "l_linenumber", F.col("l_partkey").alias("p_partkey")).join(part, "p_partkey")
    kind = F.when(F.col("l_linenumber") < 3, F.col("p_type"))
    found = having_all(items.select("l_suppkey", kind.alias("p_type")), part.select("p_type"), "l_suppkey", "p_type")
    return found.select("l_suppkey", "n_had", "complete", F.array_join("missing", ",").alias("missing"))


NAMED_SQL = "select p_partkey, case when p_size > 25 then 'b' else 'b_' || substr(p_brand, 7) end as name from part"


@query(f"""with n as ({NAMED_SQL}), r as (select *, row_number() over (partition by name order by p_partkey) - 1 as k from n),
taken as (select base, number, row_number() over (partition by base order by number) as i from (select distinct regexp_extract(name, '^(.*)_([1-9][0-9]*)$', 1) as base, try_cast(regexp_extract(name, '^(.*)_([1-9][0-9]*)$', 2) as bigint) as number from n) where number >= 2)
select p_partkey, name, case when k = 0 then name else name || '_' || (k + 1 + (select count(*) from taken where base = name and number - 1 - i < k)) end as unique_name from r""")
def names_without_collisions(spark, sf_dir):
    """Names made unique by numbers that no name has yet."""
    name = F.when(F.col("p_size") > 25, "b").otherwise(F.concat(F.lit("b_"), F.substring("p_brand", 7, 9)))
    return N.without_collisions(read(spark, sf_dir, "part").select("p_partkey", name.alias("name")), "name", "p_partkey", "unique_name")


def _with_raw(order):
    """An order with the raw bytes of its status and of its parts' names, made where no shuffle carries them."""
    raw = lambda c: F.encode(c, "utf-8")
    part = lambda p: F.struct(p["key"].alias("key"), p["name"].alias("name"), raw(p["name"]).alias("raw"), p["tags"].alias("tags"))
    item = lambda i: F.struct(i["line"].alias("line"), part(i["part"]).alias("part"), F.array(raw(i["part"]["name"])).alias("raws"))
    return F.struct(order["order"].alias("order"), raw(order["status"]).alias("raw"), order["status"].alias("status"), F.transform(order["items"], item).alias("items"))


@query("""with i as (select l_orderkey, list({'line': l_linenumber, 'part': {'key': l_partkey, 'name': p_name, 'tags': [p_brand, p_type]}} order by l_linenumber, l_partkey) as items from lineitem join part on l_partkey = p_partkey group by l_orderkey),
o as (select o_custkey, (row_number() over (partition by o_custkey order by o_orderkey) - 1) as place, {'order': o_orderkey, 'status': o_orderstatus, 'items': items} as doc from orders join i on l_orderkey = o_orderkey)
select o_custkey, place // 4 as part, cast(to_json({'customer': o_custkey, 'part': place // 4, 'orders': list(doc order by place)}) as varchar) as json from o group by o_custkey, place // 4""")
def nested_export(spark, sf_dir):
    """Customers with their orders, items and parts as nested JSON without raw bytes, four orders a row."""
    part = read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type")
    inner = F.struct(F.col("p_partkey").alias("key"), F.col("p_name").alias("name"), F.array("p_brand", "p_type").alias("tags"))
    items = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").join(part, F.col("l_partkey") == F.col("p_partkey"))
    # places are given before items join, so that these are shuffled to their order and to their row only
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus").join(items.select("l_orderkey").distinct(), F.col("o_orderkey") == F.col("l_orderkey"), "left_semi")
    orders = R.running_total(orders.withColumn("_one", F.lit(1)), ["o_custkey"], "o_orderkey", "_one", "_place")
    items = items.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct(F.col("l_linenumber").alias("line"), inner.alias("part")))).alias("items"))
    orders = orders.join(items, F.col("o_orderkey") == F.col("l_orderkey"))
    doc = F.struct(F.col("o_orderkey").alias("order"), F.col("o_orderstatus").alias("status"), "items")
    whole = nested.in_parts(orders, ["o_custkey"], "_place", doc, 4, "orders").withColumn("orders", F.transform("orders", _with_raw))
    bare = nested.strip_bytes(whole)
    return bare.select("o_custkey", "part", nested.to_json(F.struct(F.col("o_custkey").alias("customer"), "part", "orders")).alias("json"))


@query("""select event_id, user_id, last_value(case when event_type = 'purchase' then cast(json_extract_string(props, '$.k') as integer) end ignore nulls) over (partition by user_id order by event_id rows between unbounded preceding and current row) as last_purchase from events""")
def filled_forward(spark, sf_dir):
    """What the last purchase of the user was, carried forward to each later event."""
    k = F.when(F.col("event_type") == "purchase", F.get_json_object("props", "$.k").cast("int"))
    return Q.fill_forward(read(spark, sf_dir, "events").select("event_id", "user_id", k.alias("_k")), ["user_id"], "event_id", "_k", "last_purchase").drop("_k")


@query("""with e as (select event_id, user_id, cast(json_extract_string(props, '$.k') as bigint) as k, event_type = 'purchase' as m from events),
g as (select *, count(*) filter (m) over (partition by user_id order by event_id) as part from e)
select event_id, user_id, case when part = 0 then null else cast(coalesce(sum(case when not m then k end) over (partition by user_id, part order by event_id), 0) as bigint) end as since from g""")
def running_base(spark, sf_dir):
    """Running sums that begin anew at each purchase of the user."""
    rows = read(spark, sf_dir, "events").select("event_id", "user_id", F.get_json_object("props", "$.k").cast("long").alias("_k"), (F.col("event_type") == "purchase").alias("_m"))
    return Q.running_base(rows, ["user_id"], "event_id", "_k", "_m", "since").select("event_id", "user_id", "since")


@query("""with w as (select distinct p_type as kind, unnest([p_name, split_part(p_name, ' ', 1)]) as target from part)
select kind, target, row_number() over (order by kind, lower(target), case when contains(target, ' ') then 1 else 0 end) - 1 as place from w""")
def index_in_order(spark, sf_dir):
    """Index entries in the order of type, folded target and level."""
    part = read(spark, sf_dir, "part").select(F.col("p_type").alias("kind"), F.explode(F.array("p_name", F.split_part("p_name", F.lit(" "), F.lit(1)))).alias("target")).distinct()
    level = F.contains("target", F.lit(" ")).cast("int")
    return R.numbered(part.select("kind", "target", fold(F.col("target")).alias("_f"), level.alias("_level")), ["kind", "_f", "_level"], "place").select("kind", "target", "place")


@query("""with t as (select doc_id, source, source || '-' || doc_id as id from documents)
select source, count(*) as total, count(distinct id) as uniq, round(avg(length(id)), 6) as avg_len, max(length(id)) as max_len, min(length(id)) as min_len, arg_min(id, (-length(id), doc_id)) as longest, arg_min(id, (length(id), doc_id)) as shortest from t group by rollup(source)""")
def topic_id_statistics(spark, sf_dir):
    ids = read(spark, sf_dir, "documents").select("doc_id", "source", F.concat_ws("-", "source", F.col("doc_id").cast("string")).alias("id"))
    return S.keyword_stats(ids, "source", "id", "doc_id")


_MACROS_SQL = f"(select l_suppkey, l_orderkey, l_linenumber, {TARGETS} as target from (select *, lpad(to_hex(l_partkey), 8, '0') as hex_ from lineitem))"


@query(f"""with m as (select substr(target, 7) as macro, l_orderkey from {_MACROS_SQL} where starts_with(target, 'macro:'))
select regexp_extract(macro, '^\\s*(\\w+)', 1) as name, count(*) as total, count(distinct macro) as uniq, max(length(macro)) as longest, min(l_orderkey) as first from m group by 1""")
def macro_statistics(spark, sf_dir):
    macros = _targets(spark, sf_dir).where(F.startswith("target", F.lit("macro:"))).select(F.expr("substr(target, 7)").alias("macro"), "l_orderkey")
    own = macros.groupBy(F.regexp_extract("macro", r"^\s*(\w+)", 1).alias("name"))
    return own.agg(F.count("*").alias("total"), F.count_distinct("macro").alias("uniq"), F.max(F.length("macro")).cast("long").alias("longest"), F.min("l_orderkey").alias("first"))


@query("""select l_linenumber as config_no, count(*) as macros, count(distinct l_returnflag || l_linestatus) as uniq, cast(sum(l_partkey % 97) as bigint) as length from lineitem group by rollup(l_linenumber)""")
def config_macro_statistics(spark, sf_dir):
    """Macros of numbered configurations, each and in total."""
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("config_no"), F.concat("l_returnflag", "l_linestatus").alias("_m"), (F.col("l_partkey") % 97).alias("_n"))
    return rows.rollup("config_no").agg(F.count("*").alias("macros"), F.count_distinct("_m").alias("uniq"), F.sum("_n").cast("long").alias("length"))


#: What files of the formats begin with.
MAGIC = {"<!DOCTYPE": "page", "<html": "page", "{": "json", "[": "json", "%PDF": "pdf", "BM": "bitmap"}


@query("""select 'pages' as origin, page_id as id, case when starts_with(html, '<!DOCTYPE') or starts_with(html, '<html') then 'page' when starts_with(html, '{') or starts_with(html, '[') then 'json' when starts_with(html, '%PDF') then 'pdf' when starts_with(html, 'BM') then 'bitmap' else 'unknown' end as format from pages
union all select 'events', event_id, case when starts_with(props, '{') then 'json' else 'unknown' end from events
union all select 'documents', doc_id, case when starts_with(text, 'BM') then 'bitmap' when starts_with(text, '{') or starts_with(text, '[') then 'json' when starts_with(text, '<!DOCTYPE') or starts_with(text, '<html') then 'page' when starts_with(text, '%PDF') then 'pdf' else 'unknown' end from documents""")
def formats_by_magic(spark, sf_dir):
    """The format of each content by its first bytes."""
    each = [read(spark, sf_dir, t).select(F.lit(t).alias("origin"), F.col(k).alias("id"), F.substring(F.encode(c, "utf-8"), 1, 16).alias("_head")) for t, k, c in (("pages", "page_id", "html"), ("events", "event_id", "props"), ("documents", "doc_id", "text"))]
    kind = F.lit(None).cast("string")
    for magic, name in reversed(MAGIC.items()):
        kind = F.when(F.startswith("_head", F.lit(magic.encode())), name).otherwise(kind)
    return each[0].union(each[1]).union(each[2]).select("origin", "id", F.coalesce(kind, F.lit("unknown")).alias("format"))


@query("""select l_orderkey, l_linenumber, l_partkey // 120 as indent, greatest(l_suppkey // 24, 1) as rows_above, cast(ceil(l_extendedprice / 120) as bigint) as width from lineitem""")
def paragraph_layout(spark, sf_dir):
    """Twips as columns of 120 and rows of 24."""
    items = read(spark, sf_dir, "lineitem")
    return items.select("l_orderkey", "l_linenumber", F.expr("l_partkey div 120").alias("indent"), F.greatest(F.expr("l_suppkey div 24"), F.lit(1)).alias("rows_above"), F.ceil(F.col("l_extendedprice") / 120).cast("long").alias("width"))


@query("""with u as (select conv_id, turn // 2 as ord, length(text) as asked from conversations where turn % 2 = 0), a as (select conv_id, turn // 2 as ord, length(text) as answered from conversations where turn % 2 = 1)
select conv_id, ord, asked, answered from u left join a using (conv_id, ord)""")
def zipped_lists(spark, sf_dir):
    """Two lists side by side by position; where the second is shorter it is null."""
    turns = read(spark, sf_dir, "conversations").select("conv_id", F.expr("turn div 2").alias("ord"), (F.col("turn") % 2).alias("_side"), F.length("text").cast("long").alias("n"))
    side = lambda k, name: turns.where(F.col("_side") == k).select("conv_id", "ord", F.col("n").alias(name))
    return R.zip_by_position(side(0, "asked"), side(1, "answered"), ["conv_id", "ord"])


@query("""select p_partkey, to_base64(encode(p_name)) as name64 from part""")
def base64_fields(spark, sf_dir):
    """Raw bytes as base64, as the export encodes them."""
    raw = read(spark, sf_dir, "part").select("p_partkey", F.encode("p_name", "utf-8").alias("name64"))
    return nested.strip_bytes(raw, encode=True)
