"""Mixing sources to target weights by Efraimidis-Spirakis sampling, with DataFrame functions only.

Targets: the sources share the total by weight; a source stops at ``repeats`` times its own size and
the excess is shared by weight among the others until none is above. A source's target is met by
complete epochs over it first and then by a weighted sample without replacement: each document draws
u from a digest of its identifier, its key is -ln(u) / quality, and documents are taken in the order of
their keys, prefix-summed, until the words left of the target are used up. The last document is taken
in part, so a source's words meet the target to within one word.

Prefix sums without a task per source: keys are mapped to ``bins`` bins per source, bins are summed with
partial aggregation, and only the bin in which the target falls is split into ``bins`` finer ones and
summed again. The rows of the one fine bin that the target falls into, a share of about 1 / bins**2 of a
source unless keys are tied, are sorted into ranges; each range is summed on its own and shifted by those
before it, so rows that share an identifier, or have none, don't meet in one task however many they are.

Defined results: null text has size 0 and takes 0; the null source is a source of its own, last in order;
quality that is null, not finite or below ``floor`` counts as ``floor``; rows with a null identifier draw by
their text; ties of keys are settled by identifier, size, a hash of the text, and last by place in the staged table (rows alike in
all of these are interchangeable); rows that share an identifier are separate documents; sources without words
get a target of 0; an empty table gives an empty table. Columns of ``docs`` are kept, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm.common import WORD, partitions, stage

WEIGHTS = (5.0, 2.0, 1.0)
REPEATS = 3.0
BINS = 1024
FLOOR = 0.05


def word_count(text: Column) -> Column:
    """Number of runs without white space (space, \\t to \\r); 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def text_quality(text: Column, size: Column) -> Column:
    """A weight from 0.05 to 1: the share of words that aren't accompanied by a symbol of ``#*$%&|<>``."""
    marks = F.regexp_count(text, F.lit("[#*$%&|<>]"))
    return F.when(size > 0, F.greatest(F.lit(FLOOR), F.lit(1.0) - F.least(F.lit(1.0), marks / size))).otherwise(F.lit(FLOOR))


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, repeats: float = REPEATS) -> DataFrame:
    """(source, source_size) to (source, source_size, target), by sharing and capping in closed form.

    In the order of cap / weight a prefix of the sources is capped: source k is, if its fair share of
    what the earlier ones leave exceeds its cap. One sorted pass over the sources therefore settles all.
    """
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), F.pmod(F.col("_rank") - 1, F.lit(len(weights))).cast("int") + 1)
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("_rank", F.row_number().over(by_name)).withColumn("_w", w).withColumn("_cap", F.col("source_size") * F.lit(float(repeats)))
    order = Window.orderBy(F.col("_cap") / F.col("_w"), "_rank")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    here_on = order.rowsBetween(0, Window.unboundedFollowing)
    total = F.sum("source_size").over(Window.partitionBy())
    shared = ranked.withColumn("_left", total - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))).withColumn("_level", F.col("_left") / F.sum("_w").over(here_on))
    capped = shared.withColumn("_open", F.col("_level") * F.col("_w") < F.col("_cap"))
    level = F.first(F.when(F.col("_open"), F.col("_level")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return capped.select("source", "source_size", F.least(F.col("_cap"), F.coalesce(level * F.col("_w"), F.col("_cap"))).alias("target"))


def draw(identifier: Column, seed: int, otherwise: Column | None = None) -> Column:
    """Uniform in (0, 1) from the first 52 bits of an MD5 digest of the identifier, or of ``otherwise`` where that is null."""
    name = F.coalesce(identifier.cast("string"), F.concat(F.lit("~"), otherwise.cast("string")) if otherwise is not None else F.lit(""))
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), name).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long").cast("double") + 0.5) / F.lit(float(2**52))


def _bin(lo: Column, width: Column, bins: int) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor((F.col("_g") - lo) / width * bins))).cast("int")


def _cross(table: DataFrame, budget: str, group: list[str], by: str) -> DataFrame:
    """Running sum over the bins of a source: ``_before`` each bin, and whether the budget falls into it."""
    w = Window.partitionBy(*group).orderBy(by)
    return table.withColumn("_before", F.sum("_words").over(w) - F.col("_words")).withColumn(
        "_at", (F.col("_before") < F.col(budget)) & (F.col("_before") + F.col("_words") >= F.col(budget))
    )


def sample_to_targets(
    docs: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    quality: Column | None = None,
    weights: tuple[float, ...] = WEIGHTS,
    repeats: float = REPEATS,
    bins: int = BINS,
    seed: int = 11,
    carry: bool = False,
) -> DataFrame:
    """Each row with its size, source_size, target, whole epochs taken (``epochs``) and words ``taken``."""
    text = F.col(f"`{text_col}`")
    rows = docs.select(
        F.col(f"`{id_col}`").alias("_id"),
        F.col(f"`{source_col}`").alias("_source"),
        word_count(text).alias("_size"),
        (quality if quality is not None else F.lit(None).cast("double")).alias("_given"),
        F.coalesce(text, F.lit("")).alias("_text"),
        *([F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")] if carry else []),
    )
    weight = F.col("_given") if quality is not None else text_quality(F.col("_text"), F.col("_size"))
    rows = rows.withColumn("_q", F.when(F.isnan(weight) | weight.isNull() | (weight < FLOOR), F.lit(FLOOR)).otherwise(weight))
    rows = rows.withColumn("_hash", F.xxhash64("_text")).withColumn("_key", -F.log(draw(F.col("_id"), seed, F.col("_hash"))) / F.col("_q"))
    rows = rows.withColumn("_g", F.col("_key") / (1 + F.col("_key"))).withColumn("_n", F.monotonically_increasing_id())
    rows = stage(rows.drop("_given", "_text", "_q"), "mix-rows")

    b1 = _bin(F.lit(0.0), F.lit(1.0), bins)
    order = F.struct("_key", "_id", "_size", "_hash", "_n")
    lean = rows.select(order.alias("_at"), "_source", "_size", "_g", b1.alias("_b1"))
    hist = stage(lean.groupBy("_source", "_b1").agg(F.sum("_size").alias("_words")), "mix-bins")
    goal = targets(hist.groupBy(F.col("_source").alias("source")).agg(F.sum("_words").alias("source_size")), weights, repeats)
    goal = goal.select(
        F.col("source").alias("_s"),
        "source_size",
        "target",
        F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long").alias("epochs"),
    ).withColumn("_budget", F.round(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long"))
    goal = stage(goal, "mix-targets")

    coarse = _cross(hist.join(goal, F.col("_source").eqNullSafe(F.col("_s"))).drop("_s"), "_budget", ["_source"], "_b1")
    edge1 = coarse.filter("_at").select(F.col("_source").alias("_s1"), F.col("_b1").alias("_e1"), F.col("_before").alias("_base1"), (F.col("_budget") - F.col("_before")).alias("_rest1"))
    edge1 = stage(edge1, "mix-edge")
    b2 = _bin(F.col("_b1") / bins, F.lit(1.0 / bins), bins)
    inner = lean.join(edge1, F.col("_source").eqNullSafe(F.col("_s1")) & (F.col("_b1") == F.col("_e1"))).withColumn("_b2", b2)
    fine = _cross(inner.groupBy("_source", "_rest1", "_b2").agg(F.sum("_size").alias("_words")), "_rest1", ["_source"], "_b2")
    edge2 = fine.filter("_at").select(F.col("_source").alias("_s2"), F.col("_b2").alias("_e2"), (F.col("_rest1") - F.col("_before")).alias("_rest2"))
    last = inner.join(edge2, F.col("_source").eqNullSafe(F.col("_s2")) & (F.col("_b2") == F.col("_e2"))).select("_source", "_at", "_size", "_rest2")
    last = last.repartitionByRange(partitions(docs.sparkSession), "_source", "_at").withColumn("_range", F.spark_partition_id())
    last = stage(last, "mix-last")
    in_order = Window.partitionBy("_source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = last.groupBy("_source", "_range").agg(F.sum("_size").alias("_words"))
    ranges = ranges.select(F.col("_source").alias("_s4"), F.col("_range").alias("_r4"), F.coalesce(F.sum("_words").over(in_order), F.lit(0)).alias("_base"))
    w = Window.partitionBy("_source", "_range").orderBy("_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = last.withColumn("_sum", F.sum("_size").over(w)).join(ranges, F.col("_source").eqNullSafe(F.col("_s4")) & (F.col("_range") == F.col("_r4")))
    last = last.withColumn("_sum", F.col("_sum") + F.col("_base"))
    # A line per source: the document on the edge and how much of it is taken.
    edge3 = last.filter((F.col("_sum") - F.col("_size") < F.col("_rest2")) & (F.col("_sum") >= F.col("_rest2"))).select(
        F.col("_source").alias("_s3"), F.col("_at").alias("_edge"), (F.col("_rest2") - F.col("_sum") + F.col("_size")).alias("_part")
    )
    plan = goal.join(edge3, F.col("_s").eqNullSafe(F.col("_s3")), "left").drop("_s3")

    first = order < F.col("_edge")
    part = F.when(F.col("_budget") <= 0, F.lit(0)).when(F.col("_edge").isNull(), F.col("_size")).when(F.col("_n") == F.col("_edge._n"), F.col("_part")).when(first, F.col("_size")).otherwise(F.lit(0))
    out = rows.join(F.broadcast(plan) if _few(goal) else plan, F.col("_source").eqNullSafe(F.col("_s")))
    return out.select(
        F.col("_id").alias(id_col),
        F.col("_size").alias("size"),
        F.col("source_size").cast("long").alias("source_size"),
        F.col("target").cast("double").alias("target"),
        F.when(F.col("_size") > 0, F.col("epochs")).otherwise(F.lit(0)).alias("epochs"),
        (F.col("epochs") * F.col("_size") + F.when(F.col("_size") > 0, part).otherwise(F.lit(0))).cast("long").alias("taken"),
        *(["_row"] if carry else []),
    )


def _few(goal: DataFrame, most: int = 100_000) -> bool:
    """A broadcast needs a size bound: the number of sources is counted first; beyond ``most`` the join shuffles."""
    return goal.count() <= most


def mix_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The mixture itself: each row once per whole copy, and the edge document's last copy cut after its words.

    A cut copy has single spaces between words. Rows without words take no part.
    """
    mixed = sample_to_targets(docs, id_col=id_col, text_col=text_col, carry=True, **options)
    whole = (F.col("taken") / F.col("size")).cast("long")
    rest = (F.col("taken") - whole * F.col("size")).cast("int")
    flat = F.col(f"_row.`{text_col}`")
    cut = F.array_join(F.slice(F.filter(F.split(flat, r"[\x20\x09-\x0D]+"), lambda x: x != ""), 1, F.col("_words")), " ")
    copies = mixed.filter("taken > 0").select(
        "_row", F.explode(F.concat(F.array_repeat(F.lit(-1), whole.cast("int")), F.when(rest > 0, F.array(rest)).otherwise(F.array().cast("array<int>")))).alias("_words")
    )
    text = F.when(F.col("_words") < 0, flat).otherwise(cut)
    return copies.select(*[text.alias(c) if c == text_col else F.col(f"_row.`{c}`").alias(c) for c in docs.columns])
