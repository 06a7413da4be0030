"""The contract of written minutes: required sections in order, timed topics that cover the recording, tables of updates and actions.

A document's rules see nothing but that document, so all are column expressions over its lines: no shuffle, one row a breach."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import seconds

#: What ends a line; seconds that a topic may leave before the next, and that one topic covers; spare seconds at the end.
BREAKS = "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
GAP, COVER, SPARE = 2700, 1800, 0.5
#: Headings that minutes must not have, in any language.
FORBIDDEN = ("## 基本信息", "## 身份边界", "## 风险与待确认", "## 证据", "## 关键帧", "## Source", "## Speaker Coverage", "## Key Frames", "## Basic Information", "## Identity Boundaries", "## Risks and Open Questions", "## Evidence")
#: A stretch of time; labels of nobody; an owner with a date.
RANGE = r"^(\d{2}:\d{2}(?::\d{2})?)-(\d{2}:\d{2}(?::\d{2})?)$"
NOBODY = r"(?i)(?:^|[\s（(])(?:speaker(?:[_\s-]*\d+)?|说话人(?:[_\s-]*\d+)?|unknown|unresolved|unassigned|未确认|未知|未实名)(?:$|[\s）)])|未知|未实名|未确认"
DATED = r"(?i)[（(][^）)]*(?:今天|明天|当天|本周|下周|周末|月底|本月|day|week|month|today|tomorrow)[^）)]*[）)]"


@dataclass(frozen=True)
class Wording:
    """A language's fixed values. headings: title, topics, updates, decisions, actions; topic: a heading with two groups, its times;
    body: what a topic must state; a table is its head, the rule below it and the line that stands for no rows."""

    headings: tuple[str, str, str, str, str]
    topic: str
    body: tuple[tuple[str, str], ...]
    updates: tuple[str, str, str]
    actions: tuple[str, str, str]
    unassigned: str


CHINESE = Wording(
    ("# 会议纪要", "## 议题与结论", "## 项目进展", "## 已确认决定", "## 行动项"),
    r"^###\s+\d+\.\s+.+（(\d{2}:\d{2}(?::\d{2})?)-(\d{2}:\d{2}(?::\d{2})?)）\s*$",
    (("- 现状：", "topic_missing_current_state"), ("- 讨论结果：", "topic_missing_discussion_result")),
    ("| 时间点 | 参与者 | 项目 | 进展 |", "| --- | --- | --- | --- |", "- 本次未出现可发布的项目进展。"),
    ("| 时间点 | 事项 | 负责人 |", "| --- | --- | --- |", "- 本次未出现可发布的明确行动项。"),
    "待确认",
)


def _stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def _count(lines: str, line: str) -> Column:
    return F.size(F.filter(lines, lambda x: x == line))


def _holds(lines: Column, piece: str) -> Column:
    return F.exists(lines, lambda x: F.contains(x, F.lit(piece)))


def _breach(holds: Column, reason: str, place: Column | None = None, detail: Column | None = None) -> Column:
    null = F.lit(None)
    return F.when(holds, F.struct(F.lit(reason).alias("reason"), (null if place is None else place).cast("long").alias("place"), (null if detail is None else detail).cast("string").alias("detail")))


def _each(items: Column, rules: Callable[[Column, Column], list[Column]]) -> Column:
    """Breaches of all items; rules(item, place from 1) gives some columns, null where the rule is kept."""
    return F.flatten(F.transform(items, lambda x, i: F.array(*rules(x, i + 1))))


def _section(j: int) -> Column:
    """Lines below heading j, up to the next required one."""
    first = F.col("at")[j]
    last = F.coalesce(F.array_min(F.filter("at", lambda p: p > first)), F.size("lines") + 1)
    return F.slice("lines", (first + 1).cast("int"), (last - first - 1).cast("int"))


def _times(start: Column, end: Column, name: str, place: Column) -> list[Column]:
    """Of a stretch whose ends are known: it must go forward and lie within the duration."""
    d = F.col("d")
    return [_breach(end <= start, "topic_invalid_range" if name == "topic" else f"{name}_time_range_invalid", place), _breach((d > 0) & ((start >= d) | (end > d + SPARE)), "topic_range_out_of_bounds" if name == "topic" else f"{name}_time_range_out_of_bounds", place)]


def _parsed(rows: str, width: int) -> Column:
    """Rows of a table below its two first lines: place n, framed, cells, and start and end where the row is whole and they can be read."""

    def row(line: Column, i: Column) -> Column:
        framed = line.startswith("|") & line.endswith("|")
        cells = F.transform(F.split(F.substring(line, F.lit(2), F.greatest(F.length(line) - 2, F.lit(0))), r"\|", -1), _stripped)
        return F.struct((i + 1).alias("n"), framed.alias("framed"), cells.alias("cells"))

    def timed(x: Column) -> Column:
        time = F.when(x["framed"] & (F.size(x["cells"]) == width), x["cells"][0])
        return F.struct(x["n"].alias("n"), x["framed"].alias("framed"), x["cells"].alias("cells"), seconds(F.regexp_extract(time, RANGE, 1)).alias("start"), seconds(F.regexp_extract(time, RANGE, 2)).alias("end"))

    below = F.slice(F.col(rows), F.lit(3), F.greatest(F.size(rows), F.lit(1)))
    return F.transform(F.transform(below, row), timed)


def _known(items: str) -> Column:
    return F.filter(items, lambda x: x["start"].isNotNull() & x["end"].isNotNull())


def _table(rows: str, name: str, words: tuple[str, str, str], width: int, marker: str, more: Callable[[Column, Column], list[Column]]) -> Column:
    """Breaches of a section that is a table of ``width`` columns, the first a stretch of time, or one line that stands for none."""
    c, head = F.col(rows), F.get(F.col(rows), F.lit(0))

    def rules(x: Column, n: Column) -> list[Column]:
        whole, timed = x["framed"] & (F.size(x["cells"]) == width), x["start"].isNotNull() & x["end"].isNotNull()
        found = [_breach(~x["framed"], f"{name}_row_not_table", n), _breach(x["framed"] & ~whole, f"{name}_row_column_count", n, F.size(x["cells"])), _breach(whole & F.exists(x["cells"], lambda y: y == ""), f"{name}_row_empty_cell", n), _breach(whole & ~timed, f"{name}_time_range_invalid", n)]
        return found + [F.when(timed, b) for b in _times(x["start"], x["end"], name, n)] + [F.when(whole, b) for b in more(x["cells"], n)]

    full = F.concat(F.array(_breach(head != words[0], f"{name}_table_header_invalid"), _breach(F.get(c, F.lit(1)) != words[1], f"{name}_table_separator_invalid")), _each(F.col(f"{rows}_rows"), rules))
    return (F.when(F.size(c) == 0, F.array(_breach(F.lit(True), f"{name}_section_empty")))
            .when(head == words[2], F.array(_breach(F.size(c) > 1, marker)))
            .when(F.size(c) < 3, F.array(_breach(F.lit(True), f"{name}_table_incomplete"))).otherwise(full))


def breaches(docs: DataFrame, key: str, text: str, duration: str, words: Wording = CHINESE) -> DataFrame:
    """key, reason, place, detail: every rule that a document breaks; place is the topic's, row's or line's number from 1.

    duration: seconds; null or none above 0: what depends on it is not judged. Topics are judged only where every heading stands once,
    tables only where some topic's times can be read. A null text is an empty one; a repeated key's rows are judged one by one."""
    h = words.headings
    d = docs.select(key, F.coalesce(F.col(duration).cast("double"), F.lit(0.0)).alias("d"), F.transform(F.split(F.coalesce(F.col(text), F.lit("")), BREAKS, -1), _stripped).alias("lines"))
    d = d.withColumns({"n": F.array(*[_count("lines", x) for x in h]), "at": F.array(*[F.array_position("lines", x) for x in h])})
    d = d.withColumn("sound", F.forall("n", lambda n: n == 1)).withColumns({name: _section(j) for j, name in enumerate(("topics", "updates", "decisions", "actions"), 1)})
    d = d.withColumns({name: F.filter(name, lambda x: x != "") for name in ("updates", "decisions", "actions")})
    heads = F.filter(F.transform("topics", lambda x, i: F.when(x.rlike(words.topic), F.struct(i.alias("i"), seconds(F.regexp_extract(x, words.topic, 1)).alias("start"), seconds(F.regexp_extract(x, words.topic, 2)).alias("end")))), lambda x: x.isNotNull())
    d = d.withColumn("heads", F.when(F.col("sound"), heads).otherwise(F.slice(heads, 1, 0)))
    d = d.withColumns({"ranges": _known("heads"), "updates_rows": _parsed("updates", 4), "actions_rows": _parsed("actions", 3)}).withColumn("updates_timed", _known("updates_rows"))

    frame = [_breach(F.col("n")[j] != 1, "required_heading_count", None, F.concat(F.lit(f"{x}:"), F.col("n")[j])) for j, x in enumerate(h)]
    frame += [_breach(F.col("n")[2] == 0, "contract_version_mismatch", None, F.lit("project_updates_v4_required")), _breach(F.col("sound") & (F.array_sort("at") != F.col("at")), "required_headings_out_of_order")]
    frame += [_breach(F.array_contains("lines", x), "forbidden_heading", None, F.lit(x)) for x in FORBIDDEN]
    strange = F.transform(F.filter("lines", lambda x: x.rlike(r"^#{1,2}\s+") & ~x.isin(*h)), lambda x: _breach(F.lit(True), "unexpected_top_level_heading", None, x))
    untimed = _each(F.col("topics"), lambda x, n: [_breach(F.col("sound") & x.startswith("###") & ~x.rlike(words.topic), "topic_heading_invalid", n)])

    def topic(x: Column, n: Column) -> list[Column]:
        after = F.coalesce(F.get(F.col("heads"), n)["i"], F.size("topics"))
        body = F.slice("topics", x["i"] + 2, after - x["i"] - 1)
        known = x["start"].isNotNull() & x["end"].isNotNull()
        return [_breach(~_holds(body, m), reason, n) for m, reason in words.body] + [_breach(~known, "topic_timestamp_invalid", n)] + [F.when(known, b) for b in _times(x["start"], x["end"], "topic", n)]

    def follows(x: Column, n: Column) -> list[Column]:
        last = F.get(F.col("ranges"), n - 2)  # null before the first
        return [_breach(x["start"] < last["start"], "topic_not_chronological", n), _breach(x["start"] - last["end"] > GAP, "topic_gap_too_large", n)]

    def in_order(x: Column, n: Column) -> list[Column]:
        return [_breach(x["start"] < F.get(F.col("updates_timed"), n - 2)["start"], "project_updates_not_chronological", x["n"])]

    size, least, ends = F.size("ranges"), F.greatest(F.lit(1), F.ceil(F.col("d") / COVER)), F.col("ranges")
    covered = [_breach(size < least, "topic_coverage_too_sparse", None, F.concat(size, F.lit("<"), least)), _breach(F.get(ends, F.lit(0))["start"] > COVER, "opening_coverage_missing"), _breach(F.get(ends, size - 1)["end"] < F.col("d") - COVER, "closing_coverage_missing")]
    who = lambda c, n: [_breach(c[1].rlike(NOBODY), "project_updates_participant_unresolved", n)]
    owner = lambda c, n: [_breach(c[2].rlike(NOBODY) & (c[2] != words.unassigned), "action_items_owner_unresolved", n), _breach(c[2].rlike(DATED), "action_items_owner_contains_schedule", n)]
    none = F.slice(strange, 1, 0)
    late = F.when(F.get(F.col("updates"), F.lit(0)) != words.updates[2], _each(F.col("updates_timed"), in_order)).otherwise(none)
    tables = F.concat(_table("updates", "project_updates", words.updates, 4, "no_project_updates_marker_mixed_with_rows", who), late, F.array(_breach(F.size("decisions") == 0, "decisions_section_empty")), _table("actions", "action_items", words.actions, 3, "no_actions_marker_mixed_with_rows", owner))
    found = F.concat(F.array(*frame), strange, untimed, F.array(_breach(F.col("sound") & (F.size("heads") == 0), "no_timed_topics")), _each(F.col("heads"), topic), _each(F.col("ranges"), follows),
                     F.when((size > 0) & (F.col("d") > 0), F.array(*covered)).otherwise(none), F.when(size > 0, tables).otherwise(none))
    return d.select(key, F.explode(F.array_compact(found)).alias("x")).select(key, "x.*")
