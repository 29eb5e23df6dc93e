"""Mixing sources to target weights along a time-varying curriculum.

For every mix, source s has a target share p_s and a weight schedule w_s(t) = p_s (1 + a_s (1 - 2 t)) over training time
t in [0, 1].  Its integral over the whole time is p_s, so the shares are those of the table, while a positive slope a_s
brings a source early and a negative one late.  Slopes come from a table of schedules, or else from the sources' mean
document lengths (short documents first); they are centred so that the weights of all sources add to the same rate at any
time, and flattened alike where one would leave (-1, 1).

1. Demand: a mix has the total size of its sources (or ``total``); source s should give p_s of it.
2. Supply: at most ``max_repeats`` passes over its documents; a source that is short, or has no documents, gives what it
   has, and the report shows the share it really reached.
3. Order: within a source, documents follow a hash; pass after pass, each copy covers an interval of the source's
   cumulative tokens.  The prefix sums are built in two levels (hash buckets, then within each), so no task holds a source.
4. Position: the cumulative demand W_s(t) = t + a_s (t - t^2) is inverted at the middle of each copy's interval; that
   time, times the size of the mix, is the copy's training position.
5. The copies are range-sorted by mix and position.

Defined cases: documents without text, tokens or source take part in no mix; a document's copies get numbers from 0; a
source listed twice in a mix counts with both its shares and the larger max_repeats; target shares that are null or not
above 0 and max_repeats below 1 give nothing; the last copy is taken if more than half of it is still in demand.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def mix_plan(sizes: DataFrame, targets: DataFrame, total: int | None = None, schedules: DataFrame | None = None) -> DataFrame:
    """One row per mix and source: available and wanted tokens, what is taken, slope.  Bounded by the table of targets.

    schedules: mix_name, source, slope; what it does not list, or lists without a slope, has the slope 0.
    """
    have = sizes.groupBy("source").agg(F.sum("n_tokens").alias("available"), F.count("*").alias("documents"))
    want = (
        targets.filter((F.col("target_share") > 0) & F.col("mix_name").isNotNull() & F.col("source").isNotNull())
        .groupBy("mix_name", "source")
        .agg(F.sum("target_share").alias("target_share"), F.greatest(F.max("max_repeats"), F.lit(0)).alias("max_repeats"))
    )
    plan = want.join(have, "source", "left").fillna(0, ["available", "documents"])
    mix = Window.partitionBy("mix_name")
    size = F.lit(total).cast("double") if total is not None else F.sum("available").over(mix).cast("double")
    plan = plan.withColumn("mix_tokens", size).withColumn("wanted", F.col("target_share") * F.col("mix_tokens"))
    supply = F.col("available") * F.coalesce(F.col("max_repeats"), F.lit(1))
    plan = plan.withColumn("taken", F.least(F.col("wanted"), supply.cast("double")))
    if schedules is None:
        # place of the source in the order of mean lengths
        mean = F.col("available") / F.greatest(F.col("documents"), F.lit(1))
        by_length = Window.partitionBy("mix_name").orderBy(mean, "source")
        plan = plan.withColumn("told", -0.9 * F.percent_rank().over(by_length))
    else:
        told = schedules.groupBy("mix_name", "source").agg(F.max("slope").cast("double").alias("told"))
        plan = plan.join(told, ["mix_name", "source"], "left").withColumn("told", F.when(F.isnan("told"), 0.0).otherwise(F.coalesce("told", F.lit(0.0))))
    centre = F.sum(F.col("told") * F.col("taken")).over(mix) / F.greatest(F.sum("taken").over(mix), F.lit(1.0))
    plan = plan.withColumn("told", F.col("told") - centre)
    steepest = F.max(F.when(F.col("taken") > 0, F.abs("told")).otherwise(0.0)).over(mix)
    return plan.withColumn("slope", F.round(F.col("told") * F.least(F.lit(1.0), 0.95 / F.greatest(steepest, F.lit(1e-9))), 9)).drop("told")


def prefix_tokens(sizes: DataFrame, buckets: int = 4096) -> DataFrame:
    """sizes (doc_id, source, n_tokens) with ``upto``: tokens of the source before the document, in hash order."""
    h = F.xxhash64("doc_id", F.lit(7))
    rows = sizes.select("doc_id", "source", "n_tokens", h.alias("h"), F.pmod(h, F.lit(buckets)).alias("bucket"))
    sums = rows.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("tokens"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("source", "bucket", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("source", "bucket").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inner", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    return rows.join(sums, ["source", "bucket"]).select("doc_id", "source", "n_tokens", (F.col("base") + F.col("inner")).alias("upto"))


def mix(sizes: DataFrame, targets: DataFrame, total: int | None = None, schedules: DataFrame | None = None) -> DataFrame:
    """(mix_name, position, doc_id, copy_no, source, n_tokens), range-sorted by mix and position."""
    sizes = sizes.filter(F.col("source").isNotNull() & (F.col("n_tokens") > 0))
    plan = mix_plan(sizes, targets, total, schedules).filter(F.col("taken") > 0)
    # the plan has at most as many rows as the fixed table of targets
    rows = prefix_tokens(sizes).join(F.broadcast(plan), "source")
    passes = F.ceil(F.col("taken") / F.col("available")).cast("int")
    rows = rows.withColumn("copy_no", F.explode(F.sequence(F.lit(0), passes - 1)))
    middle = F.col("copy_no") * F.col("available") + F.col("upto") + F.col("n_tokens") / 2
    rows = rows.withColumn("u", middle / F.col("taken")).filter(F.col("u") <= 1)
    a = F.col("slope")
    t = 2 * F.col("u") / ((1 + a) + F.sqrt((1 + a) * (1 + a) - 4 * a * F.col("u")))
    given = F.round(t * F.col("mix_tokens"), 3)
    rows = rows.select("mix_name", given.alias("position"), "doc_id", "copy_no", "source", "n_tokens")
    order = ["mix_name", "position", "doc_id", "copy_no"]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order)


def shares(sizes: DataFrame, targets: DataFrame, total: int | None = None, schedules: DataFrame | None = None) -> DataFrame:
    """What each source of each mix really gives: target and actual share, tokens, copies, documents, passes."""
    known = sizes.filter(F.col("source").isNotNull() & (F.col("n_tokens") > 0))
    plan = mix_plan(known, targets, total, schedules)
    got = mix(sizes, targets, total, schedules).groupBy("mix_name", "source").agg(
        F.sum("n_tokens").alias("tokens"), F.count("*").alias("copies"), (F.max("copy_no") + 1).alias("passes")
    )
    every = plan.join(got, ["mix_name", "source"], "left").fillna(0, ["tokens", "copies", "passes"])
    whole = F.sum("tokens").over(Window.partitionBy("mix_name"))
    actual = F.round(F.col("tokens") / F.greatest(whole, F.lit(1)), 6)
    cols = ["mix_name", "source", "target_share", actual.alias("actual_share"), "tokens", "copies", "passes", "documents", "available", "max_repeats"]
    return every.select(*cols)
