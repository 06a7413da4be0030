"""Repair of proposed topics, so that they cover a chunk of a recording in order.

A proposal names ranges of rows by ids. Where it nearly fits, it is mended: overlaps are trimmed, ranges widened to anchors in free
space, misplaced anchors dropped, nested topics merged, and gaps filled. Every step looks at neighbours only, so each is a window over
a chunk's topics; what a chain of merges or widenings decides in sequence has a closed form (see the steps). Only references travel
to the rows that they name, and gaps to the rows that they hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import normal_space

#: Longest gap and overlap that need no repair, shortest nested topic that is merged (seconds), topics of a chunk, longest
#: merged title and summary, anchors of a topic into which a gap was folded.
GAP, NESTED, MOST_TOPICS, MOST_TITLE, MOST_SUMMARY, MOST_FOLDED = 30.0, 30.0, 8, 120, 800, 4
#: A topic that fills a gap.
FILLER_TITLE, FILLER_SUMMARY = "Intermediate operational discussion", "Intermediate source discussion preserved for global semantic review."
SUBSTANTIVE, TRANSITIONAL = "substantive", "transitional"

_CHANGE = "array<struct<step:int,at:int,sub:int,code:string>>"


def _change(step: int, at: Column, sub: Column, *code: Column | str) -> Column:
    text = F.concat(*[F.lit(c) if isinstance(c, str) else c.cast("string") for c in code])
    return F.struct(F.lit(step).alias("step"), at.cast("int").alias("at"), sub.cast("int").alias("sub"), text.alias("code"))


def _one(holds: Column, change: Column) -> Column:
    return F.when(holds, F.array(change)).otherwise(F.array().cast(_CHANGE))


def located(topics: DataFrame, records: DataFrame, by: list[str]) -> DataFrame:
    """Each topic in one struct, and refs: of its start, its end and its anchors, in order, what is known of the rows they name (id, pos, start,
    end, and before: the end of the row before)."""
    own = Window.partitionBy("rec").orderBy("pos")
    rows = records.select("rec", F.col("id").alias("ref"), "pos", F.col("start").cast("double").alias("start"), F.col("end").cast("double").alias("end"), F.lag(F.col("end").cast("double")).over(own).alias("before"))
    anchors = F.coalesce("anchors", F.array().cast("array<string>"))
    named = F.transform(F.concat(F.array("start_id", "end_id"), anchors), lambda x: normal_space(F.coalesce(x, F.lit(""))))
    out = topics.select(*by, "k", F.struct("title", "summary", "importance", "start_id", "end_id", anchors.alias("anchors")).alias("topic"), F.posexplode(named).alias("i", "ref"))
    out = out.join(rows, ["rec", "ref"], "left")
    ref = F.struct("i", F.col("ref").alias("id"), F.col("pos").cast("long").alias("pos"), "start", "end", "before")
    return out.groupBy(*by, "k").agg(F.first("topic").alias("topic"), F.array_sort(F.collect_list(ref)).alias("refs"))


def normalized(topics: DataFrame, records: DataFrame, chunks: DataFrame) -> DataFrame:
    """rec, chunk, topics (array of title, summary, importance, start_id, end_id, anchors, in order), changes (array of codes, in order).

    topics: rec, chunk, k (order), title, summary, importance, start_id, end_id, anchors. records: rec, pos (from 0), id (unique in a
    recording), start, end (seconds), text. chunks: rec, chunk, core_from, core_to (positions). A chunk's topics come back as they are, without
    changes, if one of them names an unknown row or ends before it starts; and if more than ``MOST_TOPICS`` are left, with the code of
    that. Null anchors are none; chunks without topics give no row."""
    by = ["rec", "chunk"]
    all_, order = Window.partitionBy(*by), Window.partitionBy(*by).orderBy("k")
    t = located(topics, records, by).join(chunks.select(*by, "core_from", "core_to"), by)
    s, e = F.col("refs")[0], F.col("refs")[1]
    t = t.select(*by, F.row_number().over(order).alias("k"), "topic", "core_from", "core_to", s["pos"].alias("s"), e["pos"].alias("e"), s["start"].alias("s_time"), e["end"].alias("e_time"), s["before"].alias("s_before"), F.slice("refs", F.lit(3), F.size("refs")).alias("anchors"))
    t = t.withColumn("usable", F.bool_and(F.coalesce(F.col("s") <= F.col("e"), F.lit(False))).over(all_)).withColumn("given", F.array_sort(F.collect_list(F.struct("k", "topic")).over(all_)))

    # 1: an end that the next start lies before; each end is judged by the proposal as it came
    nxt, nxt_e, over = F.lead("s").over(order), F.lead("e").over(order), F.col("e_time") - F.lead("s_time").over(order)
    meets, crosses = nxt <= F.col("e"), F.col("e") < nxt_e
    trim = F.coalesce(meets & (nxt - 1 >= F.col("s")) & ((over <= GAP) | crosses), F.lit(False))
    code = F.when(crosses & (over > GAP), F.lit("partitioned_crossing_overlap_before:")).otherwise(F.lit("trimmed_overlap_before:"))
    t = t.withColumns({"trim": trim, "next_s": nxt, "next_before": F.lead("s_before").over(order), "c1": _one(trim, _change(1, F.col("k"), F.lit(0), code, F.col("k") + 1))})
    t = t.withColumns({"e": F.when(F.col("trim"), F.col("next_s") - 1).otherwise(F.col("e")), "e_time": F.when(F.col("trim"), F.col("next_before")).otherwise(F.col("e_time"))})

    # 2: anchors outside widen a topic into free space. A start waits for the widened end before it, an end for the next start as it was: so
    # all ends first, then all starts; of a topic's anchors each that reaches further than those before it is a change
    in_core = lambda x: (x["pos"] >= F.col("core_from")) & (x["pos"] <= F.col("core_to"))
    room_after = F.coalesce(F.col("next_s"), F.col("core_to") + 1)
    after = F.filter("anchors", lambda x: in_core(x) & (x["pos"] > F.col("e")) & (x["pos"] < room_after))
    t = t.withColumn("after", after)
    t = t.withColumns({"e2": F.greatest("e", F.array_max(F.transform("after", lambda x: x["pos"]))), "e2_time": F.coalesce(F.array_max(F.transform("after", lambda x: F.struct(x["pos"], x["end"])))["end"], F.col("e_time"))})
    t = t.withColumn("room_before", F.coalesce(F.lag("e2").over(order), F.col("core_from") - 1))
    before = F.filter("anchors", lambda x: in_core(x) & (x["pos"] < F.col("s")) & (x["pos"] > F.col("room_before")))
    t = t.withColumn("ahead", before)
    t = t.withColumns({"s2": F.least("s", F.array_min(F.transform("ahead", lambda x: x["pos"]))), "s2_time": F.coalesce(F.array_min(F.transform("ahead", lambda x: F.struct(x["pos"], x["start"])))["start"], F.col("s_time"))})
    first = lambda x, xs, further: ~F.exists(xs, lambda y: (y["i"] < x["i"]) & further(y["pos"], x["pos"]))
    up = F.filter("after", lambda x: first(x, F.col("after"), lambda a, b: a >= b))
    down = F.filter("ahead", lambda x: first(x, F.col("ahead"), lambda a, b: a <= b))
    told = lambda xs, side: F.transform(xs, lambda x: _change(2, F.col("k"), x["i"], "topic:", F.col("k"), f":expanded_{side}_for_anchor:", x["id"]))
    t = t.withColumn("c2", F.concat(told(up, "end"), told(down, "start")))

    # 3: anchors outside their topic that lie outside the chunk or in another topic
    t = t.withColumn("ranges", F.collect_list(F.struct("k", "s2", "e2")).over(all_))
    elsewhere = lambda x: F.exists("ranges", lambda r: (r["k"] != F.col("k")) & (r["s2"] <= x["pos"]) & (x["pos"] <= r["e2"]))
    outside = lambda x: ~((x["pos"] >= F.col("s2")) & (x["pos"] <= F.col("e2")))
    gone = lambda x: x["pos"].isNotNull() & outside(x) & (~in_core(x) | elsewhere(x))
    t = t.withColumns({"c3": F.transform(F.filter("anchors", gone), lambda x: _change(3, F.col("k"), x["i"], "topic:", F.col("k"), ":dropped_misplaced_anchor:", x["id"])), "anchors": F.filter("anchors", lambda x: ~gone(x))})

    # 4: a topic inside the one before it is merged into that. A merge takes two, so that of a run of topics each of which would merge with
    # its next one, the first, third, fifth ... links count
    title, summary = normal_space(F.coalesce("topic.title", F.lit(""))), normal_space(F.coalesce("topic.summary", F.lit("")))
    t = t.withColumns({"title": title, "summary": summary, "importance": F.col("topic.importance"), "known": F.forall("anchors", lambda x: x["pos"].isNotNull())})
    n = {c: F.lead(c).over(order) for c in ("s2", "e2", "s2_time", "e2_time", "title", "summary", "importance", "known", "anchors")}
    both_title = F.concat_ws(" / ", "title", n["title"])
    both_summary = F.concat(F.lit("["), "title", F.lit("] "), "summary", F.lit("\n["), n["title"], F.lit("] "), n["summary"])
    link = (F.col("s2") <= n["s2"]) & (n["e2"] <= F.col("e2")) & (F.col("importance") == SUBSTANTIVE) & (n["importance"] == SUBSTANTIVE) & (n["e2_time"] - n["s2_time"] >= NESTED)
    link &= (F.length(both_title) <= MOST_TITLE) & (F.length(both_summary) <= MOST_SUMMARY) & F.col("known") & n["known"]
    t = t.withColumns({"link": F.coalesce(link, F.lit(False)), "both_title": both_title, "both_summary": both_summary, "next_anchors": n["anchors"]})
    t = t.withColumn("run", F.col("k") - F.coalesce(F.max(F.when(~F.col("link"), F.col("k"))).over(order), F.lit(0)))
    t = t.withColumn("merges", F.col("link") & (F.col("run") % 2 == 1))
    t = t.withColumn("merged", F.coalesce(F.lag("merges").over(order), F.lit(False)))
    places = F.transform(F.array_sort(F.array_distinct(F.transform(F.concat("anchors", "next_anchors"), lambda x: F.struct(x["pos"], x["id"])))), lambda x: x["id"])
    ids = F.transform("anchors", lambda x: x["id"])
    start_id = F.coalesce(F.get(F.transform(F.filter("ahead", lambda x: x["pos"] == F.col("s2")), lambda x: x["id"]), F.lit(0)), F.col("topic.start_id"))
    end_id = F.coalesce(F.get(F.transform(F.filter("after", lambda x: x["pos"] == F.col("e2")), lambda x: x["id"]), F.lit(0)), F.when(~F.col("trim"), F.col("topic.end_id")))
    t = t.withColumns({"c4": _one(F.col("merges"), _change(4, F.col("k"), F.lit(0), "merged_nested_topics:", F.col("k"), ":", F.col("k") + 1)), "start_id": start_id, "end_id": end_id})
    t = t.withColumns({"title": F.when(F.col("merges"), F.col("both_title")).otherwise(F.col("topic.title")), "summary": F.when(F.col("merges"), F.col("both_summary")).otherwise(F.col("topic.summary")), "ids": F.when(F.col("merges"), places).otherwise(ids)})
    t = t.withColumn("before4", F.flatten(F.collect_list(F.concat("c1", "c2", "c3", "c4")).over(all_)))
    t = t.where(~F.col("merged"))

    # 5: what no topic covers, at the ends in any case, between topics where the silence is long
    t = t.withColumn("i", F.row_number().over(order)).withColumns({"prev_e": F.lag("e2").over(order), "prev_time": F.lag("e2_time").over(order), "last": F.lead("k").over(order).isNull()})
    inner = (F.col("s2") > F.col("prev_e") + 1) & (F.col("s2_time") - F.col("prev_time") > GAP)
    filler = lambda holds, place, a, b, change: F.when(holds, F.struct(place.cast("int").alias("place"), a.cast("long").alias("a"), b.cast("long").alias("b"), change.alias("change")))
    at = F.col("i")
    gaps = F.array_compact(F.array(
        filler((at == 1) & (F.col("s2") > F.col("core_from")), 2 * at - 1, F.col("core_from"), F.col("s2") - 1, _change(5, at, F.lit(0), "inserted_start_coverage_topic")),
        filler((at > 1) & inner, 2 * at - 1, F.col("prev_e") + 1, F.col("s2") - 1, _change(5, at, F.lit(1), "inserted_gap_topic_before:", at)),
        filler(F.col("last") & (F.col("e2") < F.col("core_to")), 2 * at + 1, F.col("e2") + 1, F.col("core_to"), _change(5, at, F.lit(2), "inserted_end_coverage_topic")),
    ))
    # a gap is named by the rows that it holds, a trimmed end by its row; all else is named already
    proposed = F.struct("title", "summary", "importance", "start_id", "end_id", F.col("ids").alias("anchors"))
    fill = F.struct(F.lit(FILLER_TITLE).alias("title"), F.lit(FILLER_SUMMARY).alias("summary"), F.lit(TRANSITIONAL).alias("importance"), F.lit(None).cast("string").alias("start_id"), F.lit(None).cast("string").alias("end_id"), F.array().cast("array<string>").alias("anchors"))
    none = F.array().cast("array<bigint>")
    entry = lambda place, x, c5, held: F.struct(place.cast("int").alias("place"), x.alias("x"), c5.alias("c5"), held.alias("held"))
    own = entry(2 * at, proposed, F.array().cast(_CHANGE), F.when(F.col("end_id").isNull(), F.array("e2")).otherwise(none))
    fills = F.transform(gaps, lambda g: entry(g["place"], fill, F.array(g["change"]), F.sequence(g["a"], g["b"])))
    rows = t.select(*by, "usable", "given", "before4", F.explode(F.concat(F.array(own), F.when(F.col("usable"), fills).otherwise(F.array()))).alias("y"))
    rows = rows.select(*by, "usable", "given", "before4", "y.place", "y.x", "y.c5", F.explode_outer("y.held").alias("pos"))
    rows = rows.join(records.select("rec", F.col("pos").cast("long").alias("pos"), "id", F.col("start").cast("double").alias("start"), F.length("text").alias("size")), ["rec", "pos"], "left")
    best = F.max_by("id", F.struct(F.coalesce("size", F.lit(0)), -F.col("start"), -F.col("pos")))
    rows = rows.groupBy(*by, "place").agg(*[F.first(c).alias(c) for c in ("usable", "given", "before4", "x", "c5")], F.min_by("id", "pos").alias("first_id"), F.max_by("id", "pos").alias("last_id"), best.alias("anchor"))
    is_fill = F.size("c5") > 0
    named = F.struct("x.title", "x.summary", "x.importance", F.when(is_fill, F.col("first_id")).otherwise(F.col("x.start_id")).alias("start_id"), F.coalesce("x.end_id", "last_id").alias("end_id"), F.when(is_fill, F.array("anchor")).otherwise(F.col("x.anchors")).alias("anchors"))
    rows = rows.select(*by, "place", "usable", "given", "before4", "c5", named.alias("x"))

    # 6: too many topics: fillers go into what follows, or at the end into what comes before
    along = Window.partitionBy(*by).orderBy("place")
    rows = rows.withColumns({"n": F.count("*").over(all_), "fill": F.coalesce((F.col("x.title") == FILLER_TITLE) & (F.col("x.summary") == FILLER_SUMMARY), F.lit(False))})
    rows = rows.withColumns({"crowded": F.col("n") > MOST_TOPICS, "ahead": F.lag(F.when(F.col("fill"), F.col("x"))).over(along), "end": F.last("x").over(all_.orderBy("place").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), "end_fill": F.last("fill").over(all_.orderBy("place").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), "is_last": F.col("place") == F.max(F.when(~F.col("fill"), F.col("place"))).over(all_)})
    into, back = F.col("crowded") & F.col("ahead").isNotNull(), F.col("crowded") & F.col("is_last") & F.col("end_fill")
    some = lambda xs: F.slice(F.array_distinct(xs), 1, MOST_FOLDED)
    anchors = F.when(into, some(F.concat("ahead.anchors", "x.anchors"))).otherwise(F.col("x.anchors"))
    anchors = F.when(back, some(F.concat(anchors, "end.anchors"))).otherwise(anchors)
    mended = F.struct("x.title", "x.summary", "x.importance", F.when(into, F.col("ahead.start_id")).otherwise(F.col("x.start_id")).alias("start_id"), F.when(back, F.col("end.end_id")).otherwise(F.col("x.end_id")).alias("end_id"), anchors.alias("anchors"))
    stays = ~(F.col("crowded") & F.col("fill"))
    c6 = F.concat(_one(into & stays, _change(6, F.col("place"), F.lit(0), "folded_gap_into_following_topic")), _one(back & stays, _change(7, F.col("place"), F.lit(0), "folded_end_gap_into_previous_topic")))
    rows = rows.withColumns({"y": F.when(stays, F.struct("place", mended.alias("x"))), "c6": c6})
    out = rows.groupBy(*by).agg(F.first("usable").alias("usable"), F.first("given").alias("given"), F.array_sort(F.collect_list("y")).alias("y"), F.first("before4").alias("c"), F.flatten(F.collect_list(F.concat("c5", "c6"))).alias("d"))
    changes = F.transform(F.array_sort(F.concat("c", "d")), lambda x: x["code"])
    full, no_code = F.size("y") > MOST_TOPICS, F.array().cast("array<string>")
    given = F.transform("given", lambda g: g["topic"])
    outcome = F.when(full | ~F.col("usable"), given).otherwise(F.transform("y", lambda y: y["x"]))
    told = F.when(~F.col("usable"), no_code).when(full, F.concat(changes, F.array(F.lit("coverage_normalization_topic_limit")))).otherwise(changes)
    return out.select(*by, outcome.alias("topics"), told.alias("changes"))
