"""Column functions: buckets, labels, keys and small conversions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def blank(c: Column) -> Column:
    return c.isNull() | (F.trim(c) == "")


def null_label(c: Column) -> Column:
    return F.coalesce(c, F.lit("<NULL>"))


def days_before(day: Column, cutoff: str) -> Column:
    return F.datediff(F.lit(cutoff).cast("date"), day)


def within_days(day: Column, cutoff: str, days: int) -> Column:
    """The ``days`` days that end with the cutoff."""
    end = F.lit(cutoff).cast("date")
    return (day <= end) & (day >= F.date_sub(end, days - 1))


def decay(day: Column, cutoff: str, half_life: float) -> Column:
    import math

    return F.exp(F.lit(-math.log(2.0) / half_life) * days_before(day, cutoff))


def history_bucket(n: Column) -> Column:
    return F.when(n == 0, "0").when(n <= 2, "1-2").when(n <= 5, "3-5").when(n <= 10, "6-10").when(n <= 20, "11-20").otherwise("20+")


def tertile(value: Column, low: Column, high: Column, unknown: bool = False) -> Column:
    named = F.when(value <= low, "long_tail").when(value <= high, "medium").otherwise("head")
    return F.when(value.isNull(), "unknown").otherwise(named) if unknown else named


def novelty(times_bought: Column, type_affinity: Column, garment_affinity: Column | None = None) -> Column:
    out = F.when(times_bought > 0, "exact_repeat").when(type_affinity > 0, "same_product_type")
    if garment_affinity is not None:
        out = out.when(garment_affinity > 0, "same_garment_group")
    return out.otherwise("novel")


def source_count(n: Column) -> Column:
    return F.when(n >= 4, "4+").otherwise(F.greatest(n.cast("int"), F.lit(0)).cast("string"))


def primary_source(flags: Sequence[tuple[str, Column]]) -> Column:
    total = sum((c for _, c in flags[1:]), flags[0][1])
    out = F.when(total > 1, "multi_source")
    for name, c in flags:
        out = out.when(c > 0, name)
    return out.otherwise("none")


def section_family(section: Column) -> Column:
    """The family that a section's name tells. Names are matched anywhere in the text, so "Complements" is Menswear."""
    s = F.lower(F.coalesce(section, F.lit("")))
    has = lambda *words: F.array_contains(F.array(*[s.contains(w) for w in words]), True)
    out = F.when(has("baby"), "Baby").when(has("kid", "boy", "girl", "children"), "Kids")
    out = out.when(has("men") & ~has("women"), "Menswear").when(has("ladies", "women"), "Womenswear")
    return out.when(has("divided"), "Divided").otherwise("")


def image_path(article: Column) -> Column:
    a = article.cast("string")
    return F.concat(F.lit("images/"), F.substring(a, 1, 3), F.lit("/"), a, F.lit(".jpg"))


def search_text(columns: Sequence[str]) -> Column:
    """The non-blank fields, space-joined."""
    return F.concat_ws(" ", *[F.when(~blank(F.col(c)), F.trim(F.col(c))) for c in columns])


def padded_keys(article: Column, width: int = 10) -> Column:
    """Ways to write an article's number, best first: as given, zero-padded, without leading zeros."""
    a = F.trim(article.cast("string"))
    return F.array_distinct(F.array(a, F.lpad(a, width, "0"), F.regexp_replace(a, "^0+", "")))


def rrf(rank: Column, k: int = 60) -> Column:
    return 1.0 / (F.lit(float(k)) + rank)


def log1p_positive(c: Column) -> Column:
    return F.log1p(F.greatest(c.cast("double"), F.lit(0.0)))


def pair_code(query: Column, article: Column) -> Column:
    """Ten upper-case digits that name a candidate without showing it."""
    return F.upper(F.substring(F.sha2(F.concat_ws(":", F.lit("candidate"), query, article.cast("string")), 256), 1, 10))


def blind_key(query: Column, article: Column) -> Column:
    return F.sha2(F.concat_ws(":", query, article.cast("string")), 256)


def route_template(path: Column) -> Column:
    return F.regexp_replace(path, r"/(recommendations|articles)/[^/]+", "/$1/{id}")


def ranked9(score: Column) -> Column:
    """Scores are ordered by nine decimals, then by identifier, so engines and reruns agree."""
    return F.round(score, 9)
