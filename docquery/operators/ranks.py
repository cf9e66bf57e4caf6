"""Exact medians and percentiles of groups of any size in bounded passes: brackets by a sketch, counts, then the value."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from docquery.functions.fields import numeric, spare
from docquery.session import kept

#: Entries of the sketch that brackets a rank: it is wrong by at most one in so many. Distinct values of a group that one task
#: puts in order. How many of the sketch's errors are left on either side of a rank.
ACCURACY, IN_ORDER, MARGIN = 10_000, 100_000, 2


def percentiles(df: DataFrame, keys: list[str], field: str, percents: dict[str, float], in_order: int = IN_ORDER, accuracy: int = ACCURACY) -> DataFrame:
    """keys and a column for each name, the percentile by linear interpolation, equal to Spark's own exact one; 0 without numbers.

    Text that is no number, nulls and NaN are skipped, and rows without a key; a percentage beyond 0 to 100 counts as 50, as for metric(). A sketch
    of bounded size for each group brackets every rank, rows below a bracket are counted, and only what is within is counted
    by value, until no bracket has more than in_order distinct values. Only these are put in order in one task, so no group,
    however large, is one task's, and what is shuffled is what brackets hold. A rank that its bracket misses has the whole
    group's values.
    """
    if not keys:
        one = spare("_g", df)
        return percentiles(df.withColumn(one, F.lit(0)), [one], field, percents, in_order, accuracy).drop(one)
    x, n = spare("_x", df), spare("_n", df)
    number = numeric(F.col(field))
    rows = df.where(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])).select(*keys, F.when(~F.isnan(number), number).alias(x))
    places = [(name, (p if 0 < p <= 100 else 50) / 100) for name, p in percents.items()]
    ends = [min(max(p + side * MARGIN / accuracy, 0.0), 1.0) for _, p in places for side in (-1, 1)]
    groups = kept(rows.groupBy(*keys).agg(F.count(x).alias("total"), F.percentile_approx(x, ends, accuracy).alias("ends")), "groups")
    # A row for each group and rank that is wanted: the places, from 0, of the values on both sides of each percentile.
    exact = lambda p: (F.col("total") - 1) * F.lit(p)
    sides = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(side).alias("side"), round_(exact(p)).cast("long").alias("rank"), (exact(p) - F.floor(exact(p))).alias("part")) for name, p in places for side, round_ in (("low", F.floor), ("high", F.ceil))])
    wanted = groups.where("total > 0").select(*keys, F.explode(sides).alias("w")).select(*keys, "w.*")
    # A small group is bracketed whole. First all brackets of a group as columns: rows in none of them go no further.
    whole = F.col("total") <= max(in_order, 2 * MARGIN * accuracy)
    brackets = [(name, F.when(~whole, F.col("ends")[2 * i]), F.when(~whole, F.col("ends")[2 * i + 1])) for i, (name, _) in enumerate(places)]
    bounded = groups.select(*keys, *[c.alias(f"{end}{i}") for i, (_, low, high) in enumerate(brackets) for end, c in (("low", low), ("high", high))])
    valid = rows.where(F.col(x).isNotNull()).join(bounded, keys)
    within = [F.coalesce((F.col(x) >= F.col(f"low{i}")) & (F.col(x) <= F.col(f"high{i}")), F.lit(True)) for i in range(len(places))]
    under = valid.groupBy(*keys).agg(*[F.count_if(F.col(x) < F.col(f"low{i}")).alias(f"under{i}") for i in range(len(places))])
    under = under.select(*keys, F.explode(F.array(*[F.struct(F.lit(name).alias("name"), F.col(f"under{i}").alias("below")) for i, (name, _) in enumerate(places)])).alias("u")).select(*keys, "u.*")
    names = F.array_compact(F.array(*[F.when(c, F.lit(name)) for c, (name, _) in zip(within, places, strict=True)]))
    values = valid.where(reduce(lambda a, b: a | b, within)).groupBy(*keys, x, names.alias("names")).agg(F.count("*").alias(n))
    inside = kept(values.select(*keys, F.explode("names").alias("name"), x, n), "inside")
    met = under.join(inside.groupBy(*keys, "name").agg(F.sum(n).alias("m")), [*keys, "name"], "left")
    ranks = kept(wanted.select(*keys, "name", "rank").distinct().join(met, [*keys, "name"]).withColumn("met", F.expr("rank >= below and rank < below + coalesce(m, 0)")), "ranks")
    found: DataFrame | None = None
    # Open brackets: the values from low to high hold the rank, below is how many are smaller than low.
    held = ranks.where("met").select(*keys, "name", "rank", "below").join(inside, [*keys, "name"])
    missed = ranks.where("not met").select(*keys, "name", "rank", F.lit(0).cast("long").alias("below"))
    if not missed.isEmpty():
        counts = rows.where(F.col(x).isNotNull()).join(missed.select(*keys).distinct(), keys, "left_semi").groupBy(*keys, x).agg(F.count("*").alias(n))
        held = kept(held.unionByName(missed.join(counts, keys)), "held")
    by = [*keys, "name", "rank"]
    while True:
        sizes = held.groupBy(*by).agg(F.count("*").alias("values"), F.sum(n).alias("rows"))
        large = kept(sizes.where(F.col("values") > in_order), "large")
        small = held.join(large, by, "left_anti")
        upto = F.sum(n).over(Window.partitionBy(*by).orderBy(x))
        ordered = small.withColumn("upto", F.col("below") + upto).where((F.col("upto") > F.col("rank")) & (F.col("upto") - F.col(n) <= F.col("rank"))).select(*by, F.col(x).alias("value"))
        found = ordered if found is None else found.unionByName(ordered)
        if large.isEmpty():
            break
        open_ = held.join(large.select(*by), by, "left_semi")
        at = _brackets(open_, by, x, n, accuracy)
        narrowed = open_.join(at, by)
        below = narrowed.groupBy(*by).agg((F.first("below") + F.coalesce(F.sum(F.when(F.col(x) < F.col("low"), F.col(n))), F.lit(0))).alias("under"))
        inside = narrowed.where((F.col(x) >= F.col("low")) & (F.col(x) <= F.col("high"))).join(below, by)
        held = kept(inside.select(*by, F.col("under").alias("below"), x, n), "inside")
    values = wanted.join(found, by)
    side = lambda s: F.max(F.when(F.col("side") == s, F.col("value")))
    made = values.groupBy(*keys, "name").agg((side("low") + (side("high") - side("low")) * F.max("part")).alias("p"))
    out = made.groupBy(*keys).agg(*[F.max(F.when(F.col("name") == name, F.col("p"))).alias(name) for name in percents])
    return groups.select(*keys).join(out, keys, "left").withColumns({name: F.coalesce(name, F.lit(0.0)) for name in percents})


def _brackets(rows: DataFrame, by: list[str], x: str, n: str, accuracy: int) -> DataFrame:
    """(by, low, high): values between which the rank lies. A sketch cuts distinct values into ranges, whose counts say in which."""
    cuts = rows.groupBy(*by).agg(F.percentile_approx(x, [i / 64 for i in range(65)], accuracy).alias("cuts"))
    placed = rows.join(cuts, by).withColumn("cell", F.size(F.filter("cuts", lambda c: c <= F.col(x))))
    cells = placed.groupBy(*by, "cell").agg(F.sum(n).alias("m"), F.min(x).alias("low"), F.max(x).alias("high"), F.first("below").alias("below"))
    upto = F.col("below") + F.sum("m").over(Window.partitionBy(*by).orderBy("cell"))
    return cells.withColumn("upto", upto).where((F.col("upto") > F.col("rank")) & (F.col("upto") - F.col("m") <= F.col("rank"))).select(*by, "low", "high")
