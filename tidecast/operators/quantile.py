"""Exact figures of a value's distribution (quantiles, whiskers, histograms) in two reads of the rows.

Spark's exact ``percentile`` keeps every distinct value of a group in one buffer; for an unbounded group (the whole
fact, or one store holding a third of all rows) that buffer lands in a single task. Here:

1. the first read counts rows in order-preserving *log-scale* buckets: a value's binary exponent and the top bits of
   its mantissa (``SUB_BUCKETS`` per power of two, some 0.02 % wide, whatever the data's range or skew), with each
   bucket's least and greatest value. That table is small and is written to the checkpoint folder;
2. it tells which buckets matter: those that hold a wanted rank, and those across which a fence or a bin's edge may
   fall. The second read takes the distinct values of these alone, with how often each stands.

A bucket of more than ``RANK_VALUES`` distinct values is not ranked in one task: it is cut into ``FAN`` equal ranges
between its own least and greatest value, only the range that holds the rank is kept, and so on until it is small
enough. This works on the second read's values; the rows are not read again. The answer is exact, buckets only say
where to look.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.attach import attach_row
from ..session import cut_lineage

SUB_BUCKETS = 4096                 # per power of two
_OFFSET = 1100 * SUB_BUCKETS       # lifts every positive bucket above 0 (binary exponents are ≥ -1074)
RANK_VALUES = 1 << 18
FAN = 1024


def log_bucket(v: Column) -> Column:
    """Monotone bucket id: v < w ⇒ bucket(v) ≤ bucket(w); negatives < 0 < positives.

    For |v| in [2^e, 2^(e+1)): S·e + floor(S·|v|/2^e) - S (+ offset). Division by a power
    of two is exact, and an exponent off by one from ``log2`` rounding near a power of
    two lands on the same id, so the ordering holds exactly.
    """
    endless = F.abs(v) == float("inf")
    a = F.when((v != 0) & ~endless, F.abs(v)).otherwise(F.lit(1.0))  # 0 and infinities have ids of their own; keep log2 finite (ANSI)
    e = F.floor(F.log2(a))
    g = F.floor((a / F.pow(F.lit(2.0), e)) * F.lit(float(SUB_BUCKETS))) + F.lit(SUB_BUCKETS) * (e - 1) + F.lit(_OFFSET)
    g = F.when(endless, F.lit(1 << 40)).otherwise(g)
    return F.when(v > 0, g).when(v < 0, -g).otherwise(F.lit(0)).cast("long")


def tagged(df: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """keys, v, bucket of the rows that hold a value."""
    rows = df.select(*keys, F.col(value).cast("double").alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
    return rows.withColumn("bucket", log_bucket(F.col("v")))


def bucket_table(df: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """First read: keys, bucket, c (rows), least, most."""
    return cut_lineage(tagged(df, value, keys).groupBy(*keys, "bucket").agg(F.count(F.lit(1)).alias("c"), F.min("v").alias("least"), F.max("v").alias("most")))


def bucket_values(df: DataFrame, value: str, needed: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Second read: keys, bucket, v, m (rows) of the needed buckets."""
    keys = list(keys)
    held = tagged(df, value, keys).join(needed.select(*keys, "bucket").distinct(), keys + ["bucket"], "left_semi")
    return cut_lineage(held.groupBy(*keys, "bucket", "v").agg(F.count(F.lit(1)).alias("m")))


def _started(buckets: DataFrame, keys: Sequence[str], by: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(by) if keys else Window.orderBy(by)
    return buckets.withColumn("start", F.sum("c").over(w) - F.col("c"))


def rank_targets(buckets: DataFrame, probs: Sequence[float], keys: Sequence[str] = ()) -> DataFrame:
    """keys, qi, lo, hi (0-based ranks floor and ceil of (n-1)p), frac."""
    n = buckets.groupBy(*keys).agg(F.sum("c").alias("n")).where("n > 0")
    rank = lambda p: (F.col("n") - 1) * p
    each = [F.struct(F.lit(i).alias("qi"), F.floor(rank(p)).alias("lo"), F.ceil(rank(p)).alias("hi"), (rank(p) - F.floor(rank(p))).alias("frac")) for i, p in enumerate(probs)]
    return n.select(*keys, F.inline(F.array(*each)))


def locate(buckets: DataFrame, ranks: DataFrame, keys: Sequence[str], by: str) -> DataFrame:
    """keys, ``by``, r (the rank within the bucket), rank: the bucket that holds each of ``ranks`` (keys, r, rank)."""
    wanted = ranks.groupBy(*keys).agg(F.collect_set(F.struct("r", "rank")).alias("ranks"))
    placed = attach_row(_started(buckets, keys, by), wanted, list(keys))
    inside = F.filter("ranks", lambda x: (x["r"] >= F.col("start")) & (x["r"] < F.col("start") + F.col("c")))
    return placed.select(*keys, by, "start", F.explode(inside).alias("x")).select(*keys, by, (F.col("x.r") - F.col("start")).alias("r"), F.col("x.rank").alias("rank"))


def values_at(values: DataFrame, located: DataFrame, keys: Sequence[str] = (), rank_values: int | None = None, fan: int = FAN) -> DataFrame:
    """keys, rank, v: the value at each located rank of its bucket; over-full buckets are cut until they are small."""
    keys, limit = list(keys), RANK_VALUES if rank_values is None else rank_values
    inner = [*keys, "path"]
    at = located.withColumn("path", F.array("bucket")).drop("bucket")
    held = values.withColumn("path", F.array("bucket")).drop("bucket")
    while True:
        held = held.join(at.select(*inner).distinct(), inner, "left_semi")
        spans = held.groupBy(*inner).agg(F.count(F.lit(1)).alias("values"), F.min("v").alias("from"), F.max("v").alias("to"))
        if (spans.agg(F.max("values")).first()[0] or 0) <= limit:
            break
        # a bucket that is small enough stays one range
        wide = F.col("values") > limit
        part = F.when(wide & (F.col("to") > F.col("from")), F.least(F.floor((F.col("v") - F.col("from")) / (F.col("to") - F.col("from")) * fan), F.lit(fan - 1))).otherwise(F.lit(0))
        cut = held.join(spans, inner).select(*inner, "v", "m", part.cast("long").alias("part"))
        sizes = cut.groupBy(*inner, "part").agg(F.sum("m").alias("c"))
        found = locate(sizes, at.select(*inner, "r", "rank"), inner, "part")
        deeper = F.concat("path", F.array("part")).alias("path")
        at = cut_lineage(found.select(*keys, deeper, "r", "rank"))
        held = cut_lineage(cut.select(*keys, deeper, "v", "m"))
    w = Window.partitionBy(*inner).orderBy("v")
    ranked = held.withColumn("upto", F.sum("m").over(w))
    hit = (F.col("r") < F.col("upto")) & (F.col("r") >= F.col("upto") - F.col("m"))
    return at.join(ranked, inner).where(hit).select(*keys, "rank", "v")


def solve(targets: DataFrame, found: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    """One row per key: each quantile between the values at its two ranks."""
    keys = list(keys)
    lo = found.select(*keys, F.col("rank").alias("lo"), F.col("v").alias("v_lo"))
    hi = found.select(*keys, F.col("rank").alias("hi"), F.col("v").alias("v_hi"))
    solved = targets.join(lo, keys + ["lo"]).join(hi, keys + ["hi"]).select(*keys, "qi", (F.col("v_lo") + F.col("frac") * (F.col("v_hi") - F.col("v_lo"))).alias("q"))
    return solved.groupBy(*keys).agg(*[F.max(F.when(F.col("qi") == i, F.col("q"))).alias(nm) for i, nm in enumerate(names)])


def both_ranks(targets: DataFrame, keys: Sequence[str]) -> DataFrame:
    return targets.select(*keys, F.explode(F.array("lo", "hi")).alias("r")).distinct().withColumn("rank", F.col("r"))


def exact_quantiles(
    df: DataFrame,
    value: str,
    probs: Sequence[float],
    keys: Sequence[str] = (),
    names: Sequence[str] | None = None,
    buckets: DataFrame | None = None,
) -> DataFrame:
    """One row per group with one column per probability (``q_<p>`` or ``names``).

    ``buckets``: the first read's table where the caller has it already.
    """
    keys = list(keys)
    names = list(names) if names else [f"q_{str(p).replace('.', '_')}" for p in probs]
    buckets = bucket_table(df, value, keys) if buckets is None else buckets
    targets = rank_targets(buckets, probs, keys)
    located = cut_lineage(locate(buckets, both_ranks(targets, keys), keys, "bucket"))
    return solve(targets, values_at(bucket_values(df, value, located, keys), located, keys), keys, names)


def distribution(df: DataFrame, value: str, keys: Sequence[str] = (), bins: int = 50, buckets: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Box-plot figures and the equal-width histogram of each group, from two reads in all.

    Box: q1, median, q3, iqr, lower_whisker, upper_whisker (most extreme values within 1.5 iqr of the quartiles),
    outliers. Histogram: bin, bin_start, bin_end, count, empty bins included.
    """
    keys = list(keys)
    buckets = bucket_table(df, value, keys) if buckets is None else buckets
    targets = rank_targets(buckets, [0.25, 0.5, 0.75], keys)
    located = cut_lineage(locate(buckets, both_ranks(targets, keys), keys, "bucket"))
    span = buckets.groupBy(*keys).agg(F.min("least").alias("from"), F.max("most").alias("to"))
    binned = attach_row(buckets, span, keys)
    crossing = binned.where(_bin(F.col("least"), bins) != _bin(F.col("most"), bins)).select(*keys, "bucket")
    needed = located.select(*keys, "bucket").unionByName(crossing).unionByName(_fence_buckets(buckets, targets, located, keys))
    needed = cut_lineage(needed.distinct())
    values = bucket_values(df, value, needed, keys)
    quartiles = solve(targets, values_at(values, located, keys), keys, ["q1", "median", "q3"]).withColumn("iqr", F.col("q3") - F.col("q1"))

    # whole buckets where nothing falls across them, single values of the others
    whole = buckets.join(needed, keys + ["bucket"], "left_anti").select(*keys, F.col("least").alias("a"), F.col("most").alias("b"), "c")
    every = whole.unionByName(values.select(*keys, F.col("v").alias("a"), F.col("v").alias("b"), F.col("m").alias("c")))
    low, high = F.col("q1") - 1.5 * F.col("iqr"), F.col("q3") + 1.5 * F.col("iqr")
    inside = (F.col("a") >= low) & (F.col("b") <= high)
    box = attach_row(every, quartiles, keys).groupBy(*keys, "q1", "median", "q3", "iqr").agg(
        F.min(F.when(inside, F.col("a"))).alias("lower_whisker"),
        F.max(F.when(inside, F.col("b"))).alias("upper_whisker"),
        F.coalesce(F.sum(F.when(~inside, F.col("c"))), F.lit(0)).cast("long").alias("outliers"),
    )
    counts = attach_row(every, span, keys).groupBy(*keys, _bin(F.col("a"), bins).alias("bin")).agg(F.sum("c").alias("count"))
    grid = span.where(F.col("from").isNotNull()).select(*keys, "from", "to", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    edge = lambda k: F.col("from") + k * (F.col("to") - F.col("from")) / bins
    histogram = grid.join(counts, [*keys, "bin"], "left").fillna({"count": 0}).select(*keys, "bin", edge(F.col("bin")).alias("bin_start"), edge(F.col("bin") + 1).alias("bin_end"), "count")
    return box, histogram


def _bin(v: Column, bins: int) -> Column:
    """Equal-width bin between ``from`` and ``to``; the greatest value is in the last."""
    width = (F.col("to") - F.col("from")) / bins
    return F.when(width == 0, F.lit(0)).otherwise(F.least(F.floor((v - F.col("from")) / F.when(width != 0, width)), F.lit(bins - 1))).cast("int")


def _fence_buckets(buckets: DataFrame, targets: DataFrame, located: DataFrame, keys: list[str]) -> DataFrame:
    """Buckets across which a fence may fall: quartiles lie between the least and the greatest value of their ranks' buckets."""
    spans = located.join(buckets, keys + ["bucket"]).select(*keys, "rank", "least", "most")
    ends = targets.where("qi <> 1").select(*keys, "qi", F.explode(F.array("lo", "hi")).alias("rank")).join(spans, keys + ["rank"])
    first, third = F.col("qi") == 0, F.col("qi") == 2
    reach = ends.groupBy(*keys).agg(
        F.min(F.when(first, F.col("least"))).alias("q1_least"),
        F.max(F.when(first, F.col("most"))).alias("q1_most"),
        F.min(F.when(third, F.col("least"))).alias("q3_least"),
        F.max(F.when(third, F.col("most"))).alias("q3_most"),
    )
    # fences by the widest and the narrowest range that the quartiles leave
    low_from, low_to = 2.5 * F.col("q1_least") - 1.5 * F.col("q3_most"), 2.5 * F.col("q1_most") - 1.5 * F.col("q3_least")
    high_from, high_to = 2.5 * F.col("q3_least") - 1.5 * F.col("q1_most"), 2.5 * F.col("q3_most") - 1.5 * F.col("q1_least")
    slack = 1e-9 * (F.abs("q1_least") + F.abs("q3_most"))  # these sums round otherwise than the fences'
    meets = lambda a, b: (F.col("most") >= a - slack) & (F.col("least") <= b + slack)
    return attach_row(buckets, reach, keys).where(meets(low_from, low_to) | meets(high_from, high_to)).select(*keys, "bucket")
