"""Column functions: time, text, identity, similarity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Substrings that mark a segment as worth a frame.
KEYWORDS = ("price", "plan", "risk", "date", "owner", "test", "the", "error", "release", "review")
ANONYMOUS = r"(?i)^\s*(speaker\b.*|unknown|unresolved|unassigned)?\s*$"


def overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return F.greatest(F.lit(0), F.least(a1, b1) - F.greatest(a0, b0))


def gap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Between two intervals; 0 where they touch or overlap."""
    return F.greatest(F.lit(0), b0 - a1, a0 - b1)


def clock(seconds: Column) -> Column:
    """mm:ss, or hh:mm:ss from an hour on; halves round to even."""
    s = F.bround(seconds, 0).cast("long")
    h, m, r = F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60
    return F.when(h > 0, F.format_string("%02d:%02d:%02d", h, m, r)).otherwise(F.format_string("%02d:%02d", m, r))


def one_decimal(x: Column) -> Column:
    """A double with one decimal, rounded from its exact value, exact halves to even (as C's and Python's %.1f). ``format_string`` rounds the shortest
    decimals that name it instead: 549.15 is a little less than they say, and ends in 1, not 2. From 2**53 on there is no fraction to round."""

    def rounded(v: Column) -> Column:
        units = F.floor((F.abs(v) - F.floor(F.abs(v))) * 2.0**58) * 20  # twentieths, in 2**-58: exact wherever a half is near
        at, rest = F.shiftright(units, 58), units.bitwiseAND(F.lit(2**58 - 1))
        n = F.shiftright(at, 1) + F.when((at % 2 == 1) & ((rest > 0) | (at % 4 == 3)), 1).otherwise(0)
        return F.concat(F.when(v < 0, "-").otherwise(""), (F.floor(F.abs(v)) + F.floor(n / 10)).cast("string"), F.lit("."), (n % 10).cast("string"))

    return F.get(F.transform(F.array(x), lambda v: F.when(F.abs(v) < 2.0**53, rounded(v)).when(v.isNotNull(), F.format_string("%.1f", v))), F.lit(0))


def seconds(text: Column) -> Column:
    """Of mm:ss or hh:mm:ss; null for anything else, also for minutes or seconds beyond 59 after the first part."""
    parts = F.split(F.trim(text), ":")
    number = F.aggregate(parts, F.lit(0).cast("long"), lambda a, p: a * 60 + p.cast("long"))
    return F.when(F.trim(text).rlike(r"^\d+(:[0-5]\d){1,2}$"), number)


def normal_space(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def bigrams(text: Column) -> Column:
    """Distinct pairs of neighbouring characters."""
    n = F.length(text)
    pairs = F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.substring(text, i, F.lit(2)))
    return F.when(n >= 2, F.array_distinct(pairs)).otherwise(F.array().cast("array<string>"))


def bigram_share(a: Column, b: Column) -> tuple[Column, Column]:
    """Sizes of the intersection and the union of two texts' bigram sets; 0 and 1 if either has under 4 characters."""
    short = F.least(F.length(a), F.length(b)) < 4
    x, y = bigrams(a), bigrams(b)
    return F.when(short, 0).otherwise(F.size(F.array_intersect(x, y))), F.when(short, 1).otherwise(F.size(F.array_union(x, y)))


def wilson(good: Column, n: Column, z: float = 1.96) -> Column:
    """Lower bound of a share's confidence interval; 0 without observations."""
    p = good / n
    return F.when(n > 0, (p + z * z / (2 * n) - z * F.sqrt((p * (1 - p) + z * z / (4 * n)) / n)) / (1 + z * z / n)).otherwise(0.0)


def stable_id(prefix: str, *fields: Column) -> Column:
    return F.concat(F.lit(prefix + "-"), F.substring(F.sha2(F.concat_ws("\x1f", *fields), 256), 1, 16))


def is_named(name: Column) -> Column:
    return F.coalesce(~name.rlike(ANONYMOUS), F.lit(False))


def has_keyword(text: Column, words: tuple[str, ...] = KEYWORDS) -> Column:
    low = F.lower(text)
    return F.coalesce(F.exists(F.array(*map(F.lit, words)), lambda k: F.contains(low, k)), F.lit(False))


def top_char_share(text: Column) -> tuple[Column, Column]:
    """Count of the most frequent character, white space aside, and of all; 0 where there is none. Sorted, equal characters are runs."""
    plain = F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", "")
    runs = F.regexp_extract_all(F.array_join(F.array_sort(F.split(plain, "")), ""), F.lit(r"(?s)(.)\1*"), F.lit(0))
    return F.coalesce(F.array_max(F.transform(runs, F.length)), F.lit(0)), F.length(plain)


def whole(vector: Column, scale: int = 64) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0).cast("long"), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Of two double vectors; -1 where one has no length."""

    def product(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, v: s + v)

    size = F.sqrt(product(a, a) * product(b, b))
    return F.when(size > 0, product(a, b) / size).otherwise(-1.0)
