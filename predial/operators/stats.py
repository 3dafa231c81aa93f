"""Group statistics, funnels, rank tests and resampling."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from predial.functions.numeric import chi2_tail, fold_of, lgamma, two_sided
from predial.operators.clean import truth
from predial.operators.store import unwritten, written


#: Rank error of the sketches that enclose an exact quantile, as a share of the rows.
SKETCH_ERROR = 1e-4


def exact_quantiles(rows: DataFrame, value: str, ps: list[float], error: float = SKETCH_ERROR) -> DataFrame:
    """One row with q: exact quantiles of value over all rows, interpolated, nulls left out; null without values. See
    group_quantiles(); nothing reaches the driver."""
    values = rows.select(F.col(value).cast("double").alias("_v")).filter("_v is not null and not isnan(_v)")
    bounds = values.agg(_enclosing(ps, error))  # one row
    found = _ranked_values(values.crossJoin(F.broadcast(bounds)), [], ps)
    return found.agg(F.array(*_picked(ps)).alias("q"))


def _enclosing(ps: list[float], error: float) -> Column:
    sides = [x for p in ps for x in (max(p - 2 * error, 0.0), min(p + 2 * error, 1.0))]
    return F.percentile_approx("_v", F.array(*map(F.lit, sides)), F.lit(int(1 / error))).alias("_e")


def _ranked_values(joined: DataFrame, by: list[str], ps: list[float]) -> DataFrame:
    """Values within their group's bounds _e by value, and each run of values between bounds as one row with its ends; _upto
    rows of the group come no later, of _n in all."""
    v, low, high = F.col("_v"), (lambda i: F.col("_e")[2 * i]), (lambda i: F.col("_e")[2 * i + 1])
    run = reduce(lambda a, b: a + b, ((v >= low(i)).cast("int") + (v > high(i)).cast("int") for i in range(len(ps))))
    inside = reduce(lambda a, b: a | b, (v.between(low(i), high(i)) for i in range(len(ps))))
    counts = joined.groupBy(*by, run.alias("_run"), F.when(inside, v).alias("_in")).agg(F.count("*").alias("_c"), F.min("_v").alias("_min"), F.max("_v").alias("_max"))
    whole = Window.partitionBy(*by)
    return counts.withColumns({"_upto": F.sum("_c").over(whole.orderBy("_run", "_in")), "_n": F.sum("_c").over(whole)})


def _picked(ps: list[float]) -> list[Column]:
    """Aggregates that interpolate between the values at the ranks around each p. A rank just outside of the bounds is an end of
    the run beside them."""
    out = []
    for p in ps:
        place, rank = (F.max("_n") - 1) * p, (F.col("_n") - 1) * p
        low, high = (F.min(F.when(F.col("_upto") > at, F.struct("_upto", F.when(F.col("_upto") - F.col("_c") == at, F.col("_min")).otherwise(F.col("_max")).alias("v"))))["v"] for at in (F.floor(rank), F.ceil(rank)))
        out.append(low + (high - low) * (place - F.floor(place)))
    return out


#: How far from a wanted share the values lie that cut a group into buckets; the sets of subset_quantiles() seldom differ by more.
RUNGS = (0.0005, 0.002, 0.008, 0.03, 0.12)
#: Rank error of the sketches that find those values. Any would do, as rows are counted exactly.
RUNG_ERROR = 2e-4


def _rungs(ps: list[float], error: float = RUNG_ERROR) -> tuple[Column, int]:
    shares = sorted({min(max(p + side * d, 0.0), 1.0) for p in ps for d in RUNGS for side in (-1, 1)})
    return F.percentile_approx("_v", F.array(*map(F.lit, shares)), F.lit(int(1 / error))), len(shares)


def _ranks(ps: list[float]) -> list[tuple[Column, Column, Column]]:
    """For each p the ranks below and above it among _n rows, and how far it lies between them."""
    return [(F.floor((F.col("_n") - 1) * p), F.ceil((F.col("_n") - 1) * p), (F.col("_n") - 1) * p - F.floor((F.col("_n") - 1) * p)) for p in ps]


def subset_quantiles(rows: DataFrame, value: str, by: list[str], ps: list[float], cell: Column | None = None, sets: dict[int, list[int]] | None = None, copies: Callable[[DataFrame], DataFrame] | None = None, error: float = RUNG_ERROR) -> DataFrame:
    """Exact interpolated quantiles of value for each group and each set of cells: (by, _set, q, n); null keys are groups, null values
    and NaN left out. Sets may overlap, as training sets of folds do; rows are not repeated for them. Without cells there is one
    set, 0.

    copies: in place of sets, repeats rows, which have cell as _cell, for the sets that they are in, with the columns _set and _c:
    how often the row counts there. No task holds a group:
    approximate values around the wanted ranks cut each group into buckets, rows are counted exactly by group, bucket and cell,
    and only rows of the buckets that hold a wanted rank are counted by value. The result is a written table, small where groups
    are few, so that joins with it broadcast it.
    """
    key = F.struct(*(F.col(c) for c in by)) if by else F.struct(F.lit(0).alias("_all"))
    inside = F.lit(0) if cell is None else cell if copies is not None else cell.cast("int")
    values = rows.select(key.alias("_k"), F.col(value).cast("double").alias("_v"), inside.alias("_cell")).filter("_v is not null and not isnan(_v)")
    cuts, many = _rungs(ps, error)
    edges = written(values.groupBy("_k").agg(cuts.alias("_e")))
    bucket = reduce(lambda a, b: a + b, ((F.col("_v") > F.col("_e")[i]).cast("int") for i in range(many)))
    placed = values.join(edges, "_k").select("_k", "_v", "_cell", bucket.alias("_b"))
    if copies is not None:
        counts = copies(placed).groupBy("_k", "_set", "_b").agg(F.sum("_c").alias("_c"))
    else:
        sets = {0: [0]} if sets is None else sets
        of = F.create_map(*(x for c in sorted({c for s in sets.values() for c in s}) for x in (F.lit(c), F.array(*(F.lit(i) for i, s in sets.items() if c in s)))))
        counted = lambda df: df.select("*", F.explode(F.element_at(of, F.col("_cell"))).alias("_set"))
        counts = counted(placed.groupBy("_k", "_b", "_cell").agg(F.count("*").alias("_c"))).groupBy("_k", "_set", "_b").agg(F.sum("_c").alias("_c"))
    whole = Window.partitionBy("_k", "_set")
    counts = counts.withColumns({"_upto": F.sum("_c").over(whole.orderBy("_b")), "_n": F.sum("_c").over(whole)})
    ends = [r for low, high, _ in _ranks(ps) for r in (low, high)]
    holds = reduce(lambda a, b: a | b, ((F.col("_upto") > r) & (F.col("_upto") - F.col("_c") <= r) for r in ends))
    wanted = written(counts.filter(holds).select("_k", "_set", "_b", (F.col("_upto") - F.col("_c")).alias("_before"), "_n"))
    some = placed.join(wanted.select("_k", "_b").distinct(), ["_k", "_b"], "left_semi")
    if copies is not None:
        some = copies(some).groupBy("_k", "_b", "_set", "_v").agg(F.sum("_c").alias("_c"))
    else:
        some = counted(some.groupBy("_k", "_b", "_cell", "_v").agg(F.count("*").alias("_c"))).groupBy("_k", "_b", "_set", "_v").agg(F.sum("_c").alias("_c"))
    some = some.join(wanted, ["_k", "_b", "_set"])
    upto = F.col("_before") + F.sum("_c").over(Window.partitionBy("_k", "_set", "_b").orderBy("_v"))
    at = lambda rank: F.min(F.when(F.col("_upto") > rank, F.col("_v")))
    some = some.withColumn("_upto", upto)
    picked = some.groupBy("_k", "_set").agg(F.max("_n").alias("_n"), *(at(r).alias(f"_r{i}") for i, r in enumerate(ends)))
    q = [F.col(f"_r{2 * i}") + (F.col(f"_r{2 * i + 1}") - F.col(f"_r{2 * i}")) * part for i, (_, _, part) in enumerate(_ranks(ps))]
    out = written(picked.select(*(F.col(f"_k.{c}").alias(c) for c in by), "_set", F.array(*q).alias("q"), F.col("_n").alias("n")))
    unwritten(edges, wanted)
    return out


def group_quantiles(rows: DataFrame, value: str, by: list[str], ps: list[float], error: float = RUNG_ERROR) -> DataFrame:
    """Exact interpolated quantiles of value for each group: (by, q, n); see subset_quantiles()."""
    return subset_quantiles(rows, value, by, ps, error=error).drop("_set")


def fold_quantiles(rows: DataFrame, value: str, by: list[str], fold: str, ps: list[float], k: int = 5) -> DataFrame:
    """(fold, by, q, n): for each group and fold the exact quantiles of value over the other folds."""
    others = {f: [g for g in range(k) if g != f] for f in range(k)}
    return subset_quantiles(rows, value, by, ps, F.col(fold), others).withColumnRenamed("_set", fold)


def with_quantiles(rows: DataFrame, by: list[str], aggregates: list[Column], wanted: dict[str, tuple[str, list[float]]]) -> DataFrame:
    """(by, aggregates, and for each name of wanted an array of the exact quantiles of (column, shares)) by group; null where a
    group has no value. Groups should be few: they are joined by key."""
    out = written(rows.groupBy(*by).agg(*aggregates))
    shares = sorted({p for _, ps in wanted.values() for p in ps})
    stack = F.explode(F.array(*(F.struct(F.lit(name).alias("_what"), F.col(value).cast("double").alias("_x")) for name, (value, _) in wanted.items())))
    found = group_quantiles(rows.select(*by, stack.alias("_s")).select(*by, "_s.*"), "_x", [*by, "_what"], shares)
    keys = {c: f"_by_{i}" for i, c in enumerate(by)}
    for name, (_, ps) in wanted.items():
        q = F.array(*(F.col("q")[shares.index(p)] for p in ps)).alias(name)
        one = found.filter(F.col("_what") == name).select(*(F.col(c).alias(k) for c, k in keys.items()), q)
        same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(k)) for c, k in keys.items()), F.lit(True))
        out = out.join(F.broadcast(one) if not by else one, same, "left").drop(*keys.values())
    return out


def binomial_tail(one: DataFrame, share: float = 0.5) -> DataFrame:
    """one row (k, n) with p: the probability of k or more of n (I8); the terms are added up on the executors."""
    r = one.first()
    if not r.n:
        return one.withColumn("p", F.lit(1.0))
    spark, i = one.sparkSession, F.col("id").cast("double")
    log = F.lit(math.lgamma(r.n + 1)) - lgamma(i + 1) - lgamma(F.lit(float(r.n)) - i + 1) + i * math.log(share) + (r.n - i) * math.log(1 - share)
    total = spark.range(r.k, r.n + 1).agg(F.least(F.lit(1.0), F.sum(F.exp(log))).alias("p"))
    return one.crossJoin(F.broadcast(total))


def iqr_outliers(rows: DataFrame, value: str, group: str, k: float = 1.5, least: int = 10, limits_of: DataFrame | None = None) -> DataFrame:
    """rows with atipico: outside k interquartile ranges of a group with at least `least` values (W3), of rows or of
    limits_of."""
    known = (rows if limits_of is None else limits_of).filter(F.col(group).isNotNull())
    limits = group_quantiles(known, value, [group], [0.25, 0.75]).withColumnsRenamed({"q": "_q", "n": "_n"})
    span = F.col("_q")[1] - F.col("_q")[0]
    out = (F.col(value) < F.col("_q")[0] - k * span) | (F.col(value) > F.col("_q")[1] + k * span)
    return rows.join(limits, group, "left").withColumn("atipico", truth(out & (F.col("_n") >= least))).drop("_q", "_n")


def numeric_summary(rows: DataFrame, value: str, *by: str) -> DataFrame:
    """Count, mean, median, deviation, bias-corrected skew and four percentiles."""
    n = F.count(value)
    p = F.percentile(value, F.array(*map(F.lit, (0.05, 0.25, 0.75, 0.95))))
    out = rows.groupBy(*by).agg(
        n.alias("n"), F.avg(value).alias("media"), F.median(value).alias("mediana"), F.stddev_samp(value).alias("desvio"),
        (F.sqrt(n * (n - 1)) / (n - 2) * F.skewness(value)).alias("asimetria"), p.alias("_p"),
    )
    return out.select(*by, "n", "media", "mediana", "desvio", "asimetria", *(F.col("_p")[i].alias(x) for i, x in enumerate(("p05", "p25", "p75", "p95"))))


def quantile_bins(rows: DataFrame, value: str, k: int, name: str) -> DataFrame:
    """rows with the number (1 to k) of the right-closed quantile interval of value (W13). The k-1 edges are one row."""
    edges = exact_quantiles(rows, value, [i / k for i in range(1, k)]).withColumnRenamed("q", "_edges")
    bin_ = 1 + F.size(F.filter("_edges", lambda e: e < F.col(value)))
    return rows.crossJoin(F.broadcast(edges)).withColumn(name, F.when(F.col(value).isNotNull(), bin_)).drop("_edges")


def within_group_contrast(rows: DataFrame, value: str, flag: Column, group: str, least: int = 10) -> DataFrame:
    """The median over groups of the ratio of medians with and without a flag, in percent."""
    per = rows.filter(F.col(group).isNotNull()).groupBy(group).agg(
        F.median(F.when(flag, F.col(value))).alias("con"), F.median(F.when(~flag, F.col(value))).alias("sin"),
        F.count_if(flag).alias("n_con"), F.count_if(~flag).alias("n_sin"),
    )
    per = per.filter((F.col("n_con") >= least) & (F.col("n_sin") >= least))
    return per.agg(F.median((F.col("con") / F.col("sin") - 1) * 100).alias("diferencia_pct"), F.count("*").alias("grupos"))


def unit_contrast(rows: DataFrame, value: str, flag: Column, unit: str) -> DataFrame:
    """Medians of units' medians by a flag, without units whose rows disagree on it (A10)."""
    units = rows.withColumn("_f", flag).groupBy(unit).agg(F.median(value).alias("v"), F.count_distinct("_f").alias("n"), F.min("_f").alias("marca"))
    return units.filter("n = 1").groupBy("marca").agg(F.median("v").alias("mediana"), F.count("*").alias("unidades"))


def group_thresholds(rows: DataFrame, gap: str, group: str, times: float | None, least: int, threshold: float | None = None, gaps: DataFrame | None = None) -> DataFrame:
    """rows with umbral: times the median absolute gap of the group, or of all rows for small groups (W10). With a threshold
    (a gap, under 0) and times None, times is how often the median of all rows goes into it, and the column veces tells it.
    gaps: the rows' (group, gap), if they are there more narrowly: their medians read them several times."""
    gaps = rows if gaps is None else gaps
    middle = exact_quantiles(gaps.select(F.abs(gap).alias("_g")), "_g", [0.5]).select(F.col("q")[0].alias("_all"))
    factor = F.lit(times) if threshold is None else F.lit(-threshold) / F.col("_all")
    per = group_quantiles(gaps.select(group, F.abs(gap).alias("_g")), "_g", [group], [0.5]).select(group, F.col("q")[0].alias("_own"), F.col("n").alias("_n"))
    out = rows.join(per, group, "left").crossJoin(F.broadcast(middle))
    out = out.withColumn("umbral", factor * F.when(F.col("_n") >= least, F.col("_own")).otherwise(F.col("_all")))
    return (out if threshold is None else out.withColumn("veces", factor)).drop("_own", "_n", "_all")


def funnel(rows: DataFrame, steps: list[tuple[str, Column]], unit: str) -> DataFrame:
    """Rows and units that pass the steps so far, with percent of the step before (A12). One pass over rows."""
    passed, ads = F.lit(True), []
    for i, (_, condition) in enumerate(steps):
        passed = passed & truth(condition)
        ads.append(F.count_if(passed).alias(f"a{i}"))
    # A unit passes if one of its rows does: units are dealt once for all steps, not once for each.
    per = rows.groupBy(unit).agg(*ads)
    one = per.agg(*(c for i in range(len(steps)) for c in (F.coalesce(F.sum(f"a{i}"), F.lit(0)).alias(f"a{i}"), F.count_if((F.col(f"a{i}") > 0) & F.col(unit).isNotNull()).alias(f"u{i}"))))
    stack = F.explode(F.array(*(F.struct(F.lit(i).alias("paso"), F.lit(s).alias("filtro"), F.col(f"a{i}").alias("avisos"), F.col(f"u{i}").alias("unidades")) for i, (s, _) in enumerate(steps))))
    long = one.select(stack.alias("s")).select("s.*")
    before = lambda c: F.lag(c).over(Window.orderBy("paso"))  # noqa: E731  a row per step
    return long.withColumns({f"{c}_pct": 100 * F.try_divide(F.col(c), before(c)) for c in ("avisos", "unidades")})


def roll_up(rows: DataFrame, unit: str, step: str, price: str, gap: str, key: str, flags: dict[str, Column]) -> DataFrame:
    """One row per unit (A13, W5): a representative ad (highest step, lowest price, lowest gap), sizes and any-flags."""
    best = F.min_by(key, F.struct(-F.col(step), F.col(price), F.col(gap), F.col(key)))
    return rows.groupBy(unit).agg(
        best.alias("representante"), F.count("*").alias("avisos"), F.min(gap).alias("brecha_min"), F.max(gap).alias("brecha_max"),
        *(F.bool_or(truth(c)).alias(n) for n, c in flags.items()), truth(F.min(step) < F.max(step)).alias("discordante"),
    )


def out_of_fold_group_error(rows: DataFrame, value: str, group: str, unit: str, k: int = 5, least: int = 10) -> DataFrame:
    """rows with vuelta and error: how far value lies from the median of its group in the other folds (LM1, LM2).

    Rows are neither repeated nor shuffled where groups are few; see subset_quantiles().
    """
    return group_error(rows.withColumn("vuelta", fold_of(F.col(unit), k)), value, group, "vuelta", k, least)


def group_error(rows: DataFrame, value: str, group: str, fold: str, k: int = 5, least: int = 10) -> DataFrame:
    """out_of_fold_group_error() of rows that have their fold."""
    medians = fold_quantiles(rows.filter(F.col(group).isNotNull()), value, [group], fold, [0.5], k)
    medians = medians.filter(F.col("n") >= least).select(fold, group, F.col("q")[0].alias("_m"))
    error = F.abs(F.col(value) / F.col("_m") - 1)
    return rows.join(medians, [fold, group], "left").withColumn("error", error).drop("_m")


def conformal_limits(rows: DataFrame, residual: str, group: str, fold: str, k: int = 5, level: float = 0.8, least: int = 50) -> DataFrame:
    """(fold, group, low, high): quantiles of the other folds' residuals, of all groups where a group has few (LM12)."""
    ends = [(1 - level) / 2, (1 + level) / 2]
    own = fold_quantiles(rows, residual, [group], fold, ends, k).withColumnsRenamed({"q": "_q", "n": "_n"})
    city = fold_quantiles(rows, residual, [], fold, ends, k).select(fold, F.col("q").alias("_c"))
    pick = lambda i: F.when(F.col("_n") >= least, F.col("_q")[i]).otherwise(F.col("_c")[i])
    return own.join(city, fold).select(fold, group, pick(0).alias("limite_inf"), pick(1).alias("limite_sup"))


def average_rank(value: str, *by: str) -> Column:
    """Ranks with ties averaged (W12), over the whole of by."""
    return F.rank().over(Window.partitionBy(*by).orderBy(value)) + (F.count("*").over(Window.partitionBy(*by, value)) - 1) / 2


def ranked(rows: DataFrame, value: str, name: str = "rango") -> DataFrame:
    """Average ranks over all rows without one task seeing all: values are counted, and the counts below are summed over
    buckets of the value range."""
    counts = rows.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("_n"))
    edges = rows.approxQuantile(value, [i / 32 for i in range(1, 32)], 0.005)
    bucket = F.size(F.filter(F.array(*map(F.lit, sorted(set(edges)))).cast("array<double>"), lambda e: e < F.col(value)))
    counts = counts.withColumn("_b", bucket)
    below = counts.groupBy("_b").agg(F.sum("_n").alias("_t")).withColumn("_before", F.coalesce(F.sum("_t").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = F.coalesce(F.sum("_n").over(Window.partitionBy("_b").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.join(F.broadcast(below.select("_b", "_before")), "_b").withColumn(name, F.col("_before") + inside + (F.col("_n") + 1) / 2)
    return rows.join(counts.select(value, name), value, "left")


def kruskal(rows: DataFrame, value: str, group: str) -> DataFrame:
    """The Kruskal-Wallis statistic with tie correction, and its p value."""
    rows = ranked(rows.filter(F.col(value).isNotNull() & F.col(group).isNotNull()).select(value, group), value)
    sums = rows.groupBy(group).agg(F.sum("rango").alias("r"), F.count("*").alias("m"))
    one = sums.agg(F.sum(F.col("r") * F.col("r") / F.col("m")).alias("s"), F.sum("m").alias("n"), F.count("*").alias("k"))
    ties = rows.groupBy(value).count().agg(F.sum(F.col("count").cast("double") * (F.col("count") * F.col("count") - 1)).alias("t"))
    n = F.col("n").cast("double")
    h = (12 / (n * (n + 1)) * F.col("s") - 3 * (n + 1)) / (1 - F.col("t") / (n * (n * n - 1)))
    return one.crossJoin(F.broadcast(ties)).select(h.alias("h"), "k", "n").withColumn("p", chi2_tail(F.col("h"), F.col("k") - 1))


def wilcoxon(rows: DataFrame, value: str, *by: str) -> DataFrame:
    """Signed-rank sums, and z with tie correction and its two-sided p value, by group (I11). Zeros are dropped."""
    rows = rows.filter((F.col(value) != 0) & F.col(value).isNotNull()).select(F.struct(*(F.col(c) for c in by)).alias("_k"), F.abs(value).alias("_a"), (F.col(value) > 0).alias("_up"))
    # Ranks come from counts of distinct sizes, which are ordered in buckets of each group.
    counts = written(rows.groupBy("_k", "_a").agg(F.count("*").alias("_t"), F.count_if("_up").alias("_mas")))
    cuts = 31
    edges = written(counts.groupBy("_k").agg(F.percentile_approx("_a", F.array(*(F.lit(i / (cuts + 1)) for i in range(1, cuts + 1))), F.lit(1000)).alias("_e")))
    placed = counts.join(edges, "_k").withColumn("_b", reduce(lambda x, y: x + y, ((F.col("_a") > F.col("_e")[i]).cast("int") for i in range(cuts)))).drop("_e")
    below = placed.groupBy("_k", "_b").agg(F.sum("_t").alias("_in"))
    below = written(below.withColumn("_before", F.sum("_in").over(Window.partitionBy("_k").orderBy("_b")) - F.col("_in")).drop("_in"))
    inside = F.sum("_t").over(Window.partitionBy("_k", "_b").orderBy("_a").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_t")
    placed = placed.withColumn("_r", inside).join(below, ["_k", "_b"]).withColumn("_r", F.col("_before") + F.col("_r") + (F.col("_t") + 1) / 2)
    t = F.col("_t").cast("double")
    out = placed.groupBy("_k").agg(F.sum(F.col("_mas") * F.col("_r")).alias("w_mas"), F.sum("_t").alias("n"), F.sum(t * (t * t - 1)).alias("_ties"))
    out = out.select(*(F.col(f"_k.{c}").alias(c) for c in by), "w_mas", "n", "_ties")
    n = F.col("n").cast("double")
    z = (F.col("w_mas") - n * (n + 1) / 4) / F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("_ties") / 48)
    return out.select(*by, "n", "w_mas", z.alias("z")).withColumn("p", two_sided(F.col("z")))


def holm(tests: DataFrame, p: str) -> DataFrame:
    """tests with p_holm (I6, W15): a handful of rows."""
    order = Window.orderBy(p, *(c for c in tests.columns if c != p))
    m = F.count("*").over(Window.partitionBy())
    step = (m - F.row_number().over(order) + 1) * F.col(p)
    tests = tests.withColumn("_step", step)
    return tests.withColumn("p_holm", F.least(F.lit(1.0), F.max("_step").over(order.rowsBetween(Window.unboundedPreceding, 0)))).drop("_step")


def spearman_within(rows: DataFrame, x: str, y: str, group: str) -> DataFrame:
    """Spearman's rho after group means are taken out."""
    rows = rows.filter(F.col(x).isNotNull() & F.col(y).isNotNull() & F.col(group).isNotNull())
    w = Window.partitionBy(group)
    rows = rows.select(F.round(F.col(x) - F.avg(x).over(w), 9).alias("_x"), F.round(F.col(y) - F.avg(y).over(w), 9).alias("_y"))
    rows = ranked(ranked(rows, "_x", "rx"), "_y", "ry")
    return rows.agg(F.corr("rx", "ry").alias("rho"), F.count("*").alias("n"))


def adjusted_rand(rows: DataFrame, a: str, b: str) -> DataFrame:
    """The adjusted Rand index of two labelings."""
    pairs = lambda c: F.col(c).cast("double") * (F.col(c) - 1) / 2
    cells = rows.groupBy(a, b).agg(F.count("*").alias("n"))
    both = cells.agg(F.sum(pairs("n")).alias("s"), F.sum("n").alias("n"))
    left = cells.groupBy(a).agg(F.sum("n").alias("m")).agg(F.sum(pairs("m")).alias("sa"))
    right = cells.groupBy(b).agg(F.sum("n").alias("m")).agg(F.sum(pairs("m")).alias("sb"))
    one = both.crossJoin(left).crossJoin(right)
    expected = F.col("sa") * F.col("sb") / pairs("n")
    return one.select(((F.col("s") - expected) / ((F.col("sa") + F.col("sb")) / 2 - expected)).alias("ari"))


def winsor_z(rows: DataFrame, columns: list[str], low: float = 0.01, high: float = 0.99) -> DataFrame:
    """z-scores (population deviation) of columns clipped to two percentiles (C3), as z_<column>."""
    wide = rows
    for c in columns:  # each column's limits from the rows as they came
        wide = wide.crossJoin(F.broadcast(exact_quantiles(rows, c, [low, high]).withColumnRenamed("q", f"_{c}")))
    clipped = wide.withColumns({f"_c_{c}": F.when(F.col(c).isNotNull(), F.least(F.greatest(F.col(c), F.col(f"_{c}")[0]), F.col(f"_{c}")[1])) for c in columns})
    moments = clipped.agg(*(x for c in columns for x in (F.avg(f"_c_{c}").alias(f"_m_{c}"), F.stddev_pop(f"_c_{c}").alias(f"_s_{c}"))))
    out = clipped.crossJoin(F.broadcast(moments))
    out = out.withColumns({f"z_{c}": F.try_divide(F.col(f"_c_{c}") - F.col(f"_m_{c}"), F.col(f"_s_{c}")) for c in columns})
    return out.drop(*(f"{p}{c}" for c in columns for p in ("_", "_c_", "_m_", "_s_")))


def drawn(units: DataFrame, unit: str, reps: int, first: int = 1, most: int = 8) -> DataFrame:
    """units for each replicate from first to reps, with _w: how often the unit is drawn, a Poisson(1) number from the MD5 of
    (replicate, unit), at most `most`."""
    rows = units.withColumn("rep", F.explode(F.sequence(F.lit(first), F.lit(reps))))
    # A column of its own, so that the digest is formed once. Its first eight digits are a number u of 2**32; digests compare as
    # texts with the least u that each weight needs.
    rows = rows.withColumn("_u", F.md5(F.concat_ws("|", F.col("rep").cast("string"), F.col(unit))))
    cdf = term = 0.36787944117144233
    weight = F.when(F.col("_u") < f"{math.ceil(cdf * 4294967296.0):08x}", 0)
    for k in range(1, most):
        term = term / k
        cdf += term
        weight = weight.when(F.col("_u") < f"{math.ceil(cdf * 4294967296.0):08x}", k)
    return rows.withColumn("_w", weight.otherwise(most)).drop("_u")


def spread(units: DataFrame) -> DataFrame:
    """units as a table in enough parts for all cores: they are few bytes, but each is drawn for every replicate."""
    return written(units.repartition(2 * units.sparkSession.sparkContext.defaultParallelism))


def _drawn_medians(units: DataFrame, value: str, unit: str, reps: int, by: list[str]) -> DataFrame:
    """(by, rep, m): the median of value by replicate; units are neither sorted nor shuffled by replicate."""
    found = subset_quantiles(units, value, by, [0.5], F.col(unit), copies=lambda df: drawn(df, "_cell", reps).withColumnsRenamed({"rep": "_set", "_w": "_c"}))
    return found.select(*by, F.col("_set").alias("rep"), F.col("q")[0].alias("m"))


def cluster_bootstrap(rows: DataFrame, value: str, unit: str, reps: int = 300, level: float = 0.95, by: tuple[str, ...] = (), median: bool = False) -> DataFrame:
    """A confidence interval of the mean of value, or of the median of the units' medians, units resampled with replacement,
    by group (BS1): inferior, superior, repeticiones.

    Units get a Poisson(1) weight in each replicate, from the MD5 of (replicate, unit): the usual distributed form of
    resampling, which needs no list of units. Sums and counts by unit are formed first, so rows are read once.
    """
    rows = rows.filter(F.col(value).isNotNull()).groupBy(*by, unit)
    units = rows.agg(F.median(value).alias("_m")) if median else rows.agg(F.sum(value).alias("_s"), F.count("*").alias("_n"))
    units = spread(units)
    if median:
        found = _drawn_medians(units, "_m", unit, reps, [*by])
    else:
        found = drawn(units, unit, reps).groupBy(*by, "rep").agg(F.try_divide(F.sum(F.col("_w") * F.col("_s")), F.sum(F.col("_w") * F.col("_n"))).alias("m"))
    ends = F.percentile("m", F.array(F.lit((1 - level) / 2), F.lit((1 + level) / 2)))
    return found.groupBy(*by).agg(ends.alias("_e"), F.count("*").alias("repeticiones")).select(*by, F.col("_e")[0].alias("inferior"), F.col("_e")[1].alias("superior"), "repeticiones")


def bootstrap_median_difference(rows: DataFrame, a: str, b: str, unit: str, reps: int = 100, level: float = 0.95) -> DataFrame:
    """A confidence interval of median(a) - median(b) over the same resampled units, by their medians (BS2)."""
    units = spread(rows.dropna(subset=[a, b]).groupBy(unit).agg(F.median(a).alias("_a"), F.median(b).alias("_b")))
    first, second = (_drawn_medians(units, c, unit, reps, []).withColumnRenamed("m", c) for c in ("_a", "_b"))
    ends = F.percentile("m", F.array(F.lit((1 - level) / 2), F.lit((1 + level) / 2)))
    found = first.join(second, "rep").withColumn("m", F.col("_a") - F.col("_b"))
    return found.agg(ends.alias("_e"), F.count("*").alias("repeticiones")).select(F.col("_e")[0].alias("inferior"), F.col("_e")[1].alias("superior"), "repeticiones")
