"""Histories of visits with back and forward, replayed for all users at once.

A history is a list of pages and a place in it. A visit drops what is after the place and appends its
page; back and forward move the place; a visit of the page that is shown, back at the first page and
forward at the last one do nothing.

Users of at most ``ALONE`` events are replayed in one pass over rows sorted by user and order, which
holds the pages of one history at a time. Users of more events are no single task, but replayed in
parallel:

* Between two visits, back opens and forward closes a bracket; a forward without an open bracket does
  nothing. Which are open follows from a sum and its least value so far.
* The place is a sum too, with a floor at the first page.
* The page at a place is that of the last visit that led there: an as-of lookup by place.

What did nothing is known only once the pages are, and a back that did nothing opens no bracket. So
what does nothing is first supposed (nothing), then replayed, and supposed anew until it agrees with
the replay. Each round is right at least up to the first event where it differs from the one before,
so what agrees is the history; a wrong supposition ends at the next visit to the first page, so what
differs shrinks by about half each round. Users whose replay agrees take no part in later rounds.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from folioscope.operators.relational import WIDTH, asof_join, neighbours, running_total
from folioscope.operators.sequences import walk
from folioscope.sources.scratch import stash

#: Users of at most so many events are replayed in order, each in one task.
ALONE = 1 << 20
_BY = ["_u0", "_u1"]


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by user and order with the page shown after each and the place of that page."""
    user, pages, place = None, [], 0
    for batch in batches:
        shown, depth = [], []
        for u0, u1, visit, back, page in zip(*(batch.column(c).to_pylist() for c in ("_u0", "_u1", "_visit", "_back", "_page")), strict=True):
            if (u0, u1) != user:
                user, pages, place = (u0, u1), [], 0
            if visit:
                now = pages[place - 1] if place else None
                if not place or (now != page and (now == now or page == page)):  # what isn't a number is one page
                    del pages[place:]
                    pages.append(page)
                    place += 1
            elif back:
                place = max(place - 1, min(place, 1))
            else:
                place = min(place + 1, len(pages))
            shown.append(pages[place - 1] if place else None)
            depth.append(place)
        page = batch.schema.field("_page").type
        yield pa.RecordBatch.from_arrays([batch.column("_own"), pa.array(shown, page), pa.array(depth, pa.int64())], ["_own", "shown", "depth"])


def _alone(rows: DataFrame, events: DataFrame, page: str) -> DataFrame:
    ordered = rows.repartition(*_BY).sortWithinPartitions(*_BY, "_at")
    asked = ordered.select("_own", *_BY, "_visit", F.coalesce("_back", F.lit(False)).alias("_back"), F.col("_page.p").alias("_page"))
    kinds = StructType([asked.schema["_own"], StructField("shown", events.select(page).schema[0].dataType), StructField("depth", LongType())])
    return asked.mapInArrow(_in_order, kinds).select("_own.*", "shown", "depth")


def replay(events: DataFrame, user: str, order: str, move: str, page: str, width: int = WIDTH, alone: int = ALONE) -> DataFrame:
    """``events`` with the page ``shown`` after each and its ``depth`` (1 for the first page; null and 0 before any visit).

    ``move`` is "back", "forward" or anything else, null too, for a visit of ``page`` (a null page
    is a page); ``order`` is a whole number that no other event of the user has. A null user is a
    user of its own.
    """
    visit = ~F.coalesce(F.col(move).isin("back", "forward"), F.lit(False))
    one = lambda c: F.when(c, 1).otherwise(0)
    rows = events.select(F.struct(*events.columns).alias("_own"), F.col(user).isNull().alias("_u0"), F.coalesce(F.col(user).cast("string"), F.lit("")).alias("_u1"), F.col(order).cast("long").alias("_at"), visit.alias("_visit"), (F.col(move) == "back").alias("_back"), F.struct(F.col(page).alias("p")).alias("_page"))
    by = _BY
    many = stash(rows.groupBy(*by).agg(F.count("*").alias("_n")).where(F.col("_n") > alone).select(*by), "many")
    if not many.limit(1).count():
        return _alone(rows, events, page)
    few = _alone(rows.join(many, by, "left_anti"), events, page)
    rows = rows.join(many, by, "left_semi")
    # at first: a visit right after one of the same page does nothing
    last = neighbours(rows.withColumn("_key", F.struct("_visit", "_page")), by, "_at", "_key", width=width)
    same = F.col("_visit") & F.col("prev._visit") & F.col("prev._page").eqNullSafe(F.col("_page"))
    now = stash(last.select("_own", *by, "_at", "_visit", F.coalesce("_back", F.lit(False)).alias("_back"), "_page", F.coalesce(same, F.lit(False)).alias("_idle")), "replay")
    settled = []
    while True:
        goes = F.col("_visit") & ~F.col("_idle")
        counted = running_total(now.withColumn("_one", one(goes)), by, "_at", "_one", "_before", width)
        counted = counted.withColumn("_part", F.col("_before") + F.col("_one")).drop("_one", "_before")
        # brackets between visits
        opens = F.when(goes | F.col("_visit"), 0).when(F.col("_back"), one(~F.col("_idle"))).otherwise(-1)
        marked = walk(counted.withColumn("_step", opens), [*by, "_part"], "_at", "_step", width)
        useless = ~F.col("_visit") & ~F.col("_back") & (F.col("_sum") < F.col("_low"))
        marked = marked.withColumn("_useless", useless).drop("_step", "_sum", "_low")
        # the place, 0 at the first page; what comes before any visit counts nothing
        moves = F.when(F.col("_part") == 0, 0).when(goes, one(F.col("_part") > 1)).when(F.col("_visit") | F.col("_useless"), 0).when(F.col("_back"), -1).otherwise(1)
        placed = walk(marked.withColumn("_step", moves), by, "_at", "_step", width)
        stuck = F.col("_back") & ((F.col("_sum") < F.col("_low")) | (F.col("_part") == 0))
        depth = F.when(F.col("_part") == 0, 0).otherwise(1 + F.col("_sum") - F.least("_low", "_sum"))
        ahead = F.when(F.col("_part") - one(goes) == 0, 0).otherwise(1 + F.col("_sum") - F.col("_step") - F.col("_low"))
        placed = placed.select("_own", *by, "_at", "_visit", "_back", "_page", "_idle", depth.cast("long").alias("_depth"), ahead.cast("long").alias("_ahead"), stuck.alias("_stuck"))
        placed = stash(placed, "replay")
        led = placed.where("_visit and not _idle").select(*by, F.col("_depth").alias("_place"), F.col("_at").alias("_start"), F.col("_page").alias("_there"))
        asked = placed.select("*", F.col("_ahead").alias("_place"), (F.col("_at") - 1).alias("_just"))
        seen = asof_join(asked.where("_visit"), led, [*by, "_place"], "_just", "_start", ["_there"], width)
        again = seen.withColumn("_now", F.coalesce(F.col("_there") == F.col("_page"), F.lit(False)) | (F.col("_there").isNotNull() & F.col("_there.p").isNull() & F.col("_page.p").isNull()))
        supposed = again.drop("_place", "_just", "_there").unionByName(placed.where("not _visit").withColumn("_now", F.col("_stuck")))
        supposed = stash(supposed, "replay")
        differs = supposed.where("_now <> _idle").select(*by).distinct()
        if not differs.limit(1).count():
            settled.append(supposed)
            break
        settled.append(stash(supposed.join(differs, by, "left_anti"), "settled"))
        now = stash(supposed.join(differs, by, "left_semi").select("_own", *by, "_at", "_visit", "_back", "_page", F.col("_now").alias("_idle")), "replay")
    whole = settled[0]
    for more in settled[1:]:
        whole = whole.unionByName(more)
    led = whole.where("_visit and not _idle").select(*by, F.col("_depth").alias("_place"), F.col("_at").alias("_start"), F.col("_page").alias("_there"))
    shown = asof_join(whole.withColumn("_place", F.col("_depth")), led, [*by, "_place"], "_at", "_start", ["_there"], width)
    return few.unionByName(shown.select("_own.*", F.col("_there.p").alias("shown"), F.col("_depth").alias("depth")))
