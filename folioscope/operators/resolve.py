"""Targets of links to topics: by number, hash, offset, name, or keyword, one join for each kind."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions.text import context_hash, fold
from folioscope.operators.relational import asof_join
from folioscope.sources.scratch import stash

#: The macros that navigate, and what begins a reference into another file or window.
NAVIGATION = ("jumpid", "popupid", "jumpcontext", "alink", "klink")
ELSEWHERE = "^(topic_offset|file|window|window_number):"
#: A macro's name, and all between its first and its last bracket.
NAME, BRACKETS = r"^\s*(\w+)\s*\(", r"(?s)\((.*)\)"


def arguments(text: Column) -> Column:
    """The arguments of a macro: cut at commas outside double quotes, which are taken off; a doubled quote inside is one.

    Between two quotes stands every second piece; U+0001 outside quotes counts as a comma.
    """
    pieces = F.split(text, '"')
    marked = F.transform(pieces, lambda p, k: F.when(k % 2 == 0, F.replace(p, F.lit(","), F.lit("\1"))).otherwise(p))
    cut = F.transform(F.split(F.array_join(marked, '"'), "\1"), lambda a: F.trim(a))  # noqa: PLW0108 (trim takes a second argument)
    bare = F.transform(cut, lambda a: F.when(F.startswith(a, F.lit('"')), F.replace(F.regexp_replace(a, '^"|"$', ""), F.lit('""'), F.lit('"'))).otherwise(a))
    return F.filter(bare, lambda a, k: (a != "") | (k < F.size(bare) - 1))


def resolve(targets: DataFrame, topics: DataFrame, contexts: DataFrame, index: DataFrame) -> DataFrame:
    """Each row of ``targets`` (file, target, ...) with ``kind``, ``ord`` and ``choices``.

    ``topics``: (file, ord, topic_offset); ``contexts``: (file, hash, topic_offset); ``index``: (file,
    keyword, ord). A keyword is matched as a whole or, of "parent, label", by its label. A hash that no
    context has counts as an offset. Kinds: topic or popup (one topic),
    choice (keyword links with several topics, counted in ``choices``, ``ord`` the least), external
    (another file, window or offset), macro (any macro that doesn't navigate; none is ever run) and
    unresolved (null and unknown targets too). Rows that are equal are resolved alike, each its own.
    """
    # numbered and written once: every branch below has to see the same numbers
    rows = stash(targets.withColumn("_row", F.monotonically_increasing_id()), "targets")
    macro = F.when(F.startswith("target", F.lit("macro:")), F.expr("substr(target, 7)"))
    name = F.lower(F.regexp_extract(macro, NAME, 1))
    rows = rows.select("*", F.when(name.isin(*NAVIGATION), name).otherwise(F.when(macro.isNotNull(), "other")).alias("_macro"), arguments(F.regexp_extract(macro, BRACKETS, 1)).alias("_args"))
    two = F.size("_args") > 1
    file, context = F.when(two, F.col("_args")[0]).otherwise(""), F.when(two, F.get("_args", F.lit(1))).otherwise(F.get("_args", F.lit(0)))
    jump = F.col("_macro").isin("jumpid", "popupid") & (F.size("_args") > 0)
    prefix = F.regexp_extract("target", "^(topic|popup):", 1)
    reference = F.when(prefix != "", F.regexp_extract("target", "(?s)^(?:topic|popup):(.*)$", 1))
    number = F.regexp_extract(reference, "(?i)^TOPIC([0-9]{1,9})$", 1)
    code = F.conv(F.regexp_extract(reference, "^([0-9A-Fa-f]{1,8})$", 1), 16, 10).try_cast("long")
    rows = rows.select("*", F.nullif(prefix, F.lit("")).alias("_prefix"), number.try_cast("int").alias("_number"), F.coalesce(code, F.when(jump & (file == ""), context_hash(context))).alias("_hash"), code.alias("_code"), (jump & (file != "")).alias("_away"))
    # by hash, else the hash as an offset
    known = rows.where("_hash is not null").join(contexts.select("file", F.col("hash").alias("_hash"), F.col("topic_offset").alias("_at")), ["file", "_hash"], "left")
    known = known.select("file", "_row", F.coalesce("_at", "_code").alias("_at")).where("_at is not null")
    starts = topics.select("file", F.col("topic_offset").alias("_start"), F.col("ord").alias("_ord"))
    placed = asof_join(known, starts, ["file"], "_at", "_start", ["_ord"]).groupBy("_row").agg(F.min("_ord").alias("_placed"))
    counted = rows.where("_number is not null").select("file", "_row", F.col("_number").alias("ord")).join(topics.select("file", "ord"), ["file", "ord"]).select("_row", F.col("ord").alias("_counted"))
    wanted = rows.where(F.col("_macro").isin("alink", "klink")).select("file", "_row", F.explode(F.array_distinct(F.transform(F.split(F.get("_args", F.lit(0)), ";"), lambda w: fold(F.trim(w))))).alias("_word")).where("_word <> ''")
    whole = fold(F.col("keyword"))
    spelled = F.array_distinct(F.array(whole, F.trim(F.regexp_extract(whole, "(?s)^[^,]*,(.*)$", 1))))
    entries = index.select("file", F.explode(spelled).alias("_word"), "ord").where("_word <> ''")
    linked = wanted.join(entries, ["file", "_word"]).groupBy("_row").agg(F.count_distinct("ord").alias("_n"), F.min("ord").alias("_linked"))
    out = rows.join(placed, "_row", "left").join(counted, "_row", "left").join(linked, "_row", "left")
    found = F.coalesce("_counted", "_placed", "_linked")
    kind = (
        F.when(F.col("_macro").isin("alink", "klink"), F.when(F.col("_n") > 1, "choice").when(F.col("_n") == 1, "topic").otherwise("unresolved"))
        .when(jump, F.when(F.col("_placed").isNotNull() & ~F.col("_away"), F.when(F.col("_macro") == "popupid", "popup").otherwise("topic")).otherwise("external"))
        .when((F.col("_macro") == "jumpcontext") & (F.size("_args") > 0), "external")
        .when(F.col("_macro").isNotNull(), "macro")
        .when(F.col("target").rlike(ELSEWHERE), "external")
        .when(F.col("_prefix").isNotNull() & found.isNotNull(), F.col("_prefix"))
        .otherwise("unresolved")
    )
    return out.select(*targets.columns, kind.alias("kind"), F.when(kind.isin("topic", "popup", "choice"), found).alias("ord"), F.coalesce("_n", F.lit(0).cast("long")).alias("choices"))
