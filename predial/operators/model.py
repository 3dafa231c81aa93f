"""Expected prices out of sample: zone effects and least squares on sums formed by Spark."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from predial.functions.numeric import fold_of
from predial.operators.stats import fold_quantiles, group_quantiles, subset_quantiles
from predial.operators.store import unwritten, written

K = 5


def zone_choice(rows: DataFrame, value: str, outer: str, barrio: str, subzona: str, unit: str, k: int = K, least: int = 10) -> DataFrame:
    """(outer fold, barrio, usa_subzona): where medians of subzones beat those of neighbourhoods (LM3, LM5).

    For each outer fold only its training rows are used, cross-validated by inner folds. Medians are found for all pairs of
    folds at once, without repeating rows; only a row's errors, one for each outer fold, are.
    """
    inner = fold_of(F.concat(F.col(unit), F.lit("#")), k)
    base = written(rows.select(barrio, subzona, F.col(value).cast("double").alias("_value"), F.col(outer).cast("int").alias("_in"), inner.cast("int").alias("_inner")))
    pairs = {o * k + i: [a * k + b for a in range(k) for b in range(k) if a != o and b != i] for o in range(k) for i in range(k)}
    errors = base
    for name, keys in (("e_barrio", [barrio]), ("e_subzona", [barrio, subzona])):
        known = base.filter(F.col(keys[-1]).isNotNull())
        medians = subset_quantiles(known, "_value", keys, [0.5], F.col("_in") * k + F.col("_inner"), pairs).filter(F.col("n") >= least)
        medians = medians.groupBy(*keys, (F.col("_set") % k).cast("int").alias("_inner")).agg(F.map_from_entries(F.collect_list(F.struct(F.floor(F.col("_set") / k).cast("int"), F.col("q")[0]))).alias(name))
        errors = errors.join(written(medians), [*keys, "_inner"], "left")
    each = [F.struct(F.lit(o).alias(outer), *(F.abs(F.col("_value") / F.try_element_at(e, F.lit(o)) - 1).alias(e) for e in ("e_barrio", "e_subzona"))) for o in range(k)]
    both = errors.filter("e_barrio is not null and e_subzona is not null").select(barrio, "_in", F.explode(F.array(*each)).alias("_e")).select(barrio, "_in", "_e.*")
    both = written(both.filter((F.col("_in") != F.col(outer)) & F.col("e_barrio").isNotNull() & F.col("e_subzona").isNotNull()).select(outer, barrio, "e_barrio", "e_subzona"))
    eb, es = (subset_quantiles(both, e, [outer, barrio], [0.5]).select(outer, barrio, F.col("q")[0].alias(e)) for e in ("e_barrio", "e_subzona"))
    out = written(eb.join(es, [outer, barrio]).select(outer, barrio, (F.col("e_subzona") < F.col("e_barrio")).alias("usa_subzona")))
    unwritten(base, both)
    return out


def training_rows(rows: DataFrame, fold: str, k: int = K) -> DataFrame:
    """rows repeated for each fold that they are not in, as `para`."""
    return rows.withColumn("para", F.explode(F.array(*map(F.lit, range(k))))).filter(F.col("para") != F.col(fold))


def zone_medians(rows: DataFrame, value: str, zone: str, fold: str, k: int = K) -> DataFrame:
    """rows with esperado: the training median of the zone, or of all where the zone has no training row (LM7)."""
    per = fold_quantiles(rows, value, [zone], fold, [0.5], k).select(fold, zone, F.col("q")[0].alias("_z"))
    city = fold_quantiles(rows, value, [], fold, [0.5], k).select(fold, F.col("q")[0].alias("_c"))
    return rows.join(per, [fold, zone], "left").join(F.broadcast(city), fold).withColumn("esperado", F.coalesce("_z", "_c")).drop("_z", "_c")


def gram(rows: DataFrame, y: str, xs: list[str], *by: str) -> DataFrame:
    """Sums of products of xs and y by group: all that least squares needs (one pass, partial sums)."""
    names = [*xs, y]
    products = [F.sum(F.col(a) * F.col(b)).alias(f"{a}*{b}") for i, a in enumerate(names) for b in names[i:]]
    return rows.groupBy(*by).agg(F.count("*").alias("n"), *(F.sum(a).alias(a) for a in names), *products)


def moments(rows: DataFrame, names: list[str], by: list[str]) -> DataFrame:
    """(by, m): for each group the sums of products of (1, names) as an array, row by row; m[0] counts, the rest of the first
    row are sums. Batches multiply matrices, so that many columns cost no more aggregates; partial matrices are added up by
    group. names are numbers without nulls."""
    width = len(names) + 1
    keys = rows.select(*by).schema
    out = T.StructType([*keys.fields, T.StructField("m", T.ArrayType(T.DoubleType()))])
    out_names = [*by, "m"]

    def flushed(held, kinds):
        columns = [pa.array(c, t) for c, t in zip(zip(*held, strict=True), kinds, strict=True)]
        return pa.RecordBatch.from_arrays([*columns, pa.array([m.ravel() for m in held.values()], pa.list_(pa.float64()))], out_names)

    def part(batches):
        held: dict[tuple, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            kinds = [batch.schema.field(c).type for c in by]
            x = np.column_stack([np.ones(batch.num_rows), *(batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in names)]).astype(float)
            coded = [batch.column(batch.schema.get_field_index(c)).dictionary_encode() for c in by]
            place = np.zeros(batch.num_rows, np.int64)
            for c in coded:
                place = place * (len(c.dictionary) + 1) + pc.fill_null(c.indices, len(c.dictionary)).to_numpy(zero_copy_only=False)
            order = np.argsort(place, kind="stable")
            begins = np.flatnonzero(np.concatenate(([True], np.diff(place[order]) != 0)))
            for i, j in zip(begins.tolist(), [*begins[1:].tolist(), len(order)], strict=True):
                mine = x[order[i:j]]
                key = tuple(batch.column(batch.schema.get_field_index(c))[int(order[i])].as_py() for c in by)
                held[key] = held.get(key, 0) + mine.T @ mine
            if len(held) * width * width > 1 << 24:
                yield flushed(held, kinds)
                held = {}
        if held:
            yield flushed(held, kinds)

    def added(key, table):
        total = table.column("m").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, width * width).sum(axis=0)
        one = table.select(by).slice(0, 1)
        return one.append_column("m", pa.array([total], pa.list_(pa.float64())))

    return rows.select(*by, *(F.col(c).cast("double").alias(c) for c in names)).mapInArrow(part, out).groupBy(*by).applyInArrow(added, out)


def within(per: DataFrame, fold: str, width: int) -> dict[int, np.ndarray]:
    """Sums of products within zones by fold, from moments by fold and zone. One matrix for each fold reaches the driver."""

    def added(key, table):
        m = table.column("m").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, width + 1, width + 1)
        inside = (m[:, 1:, 1:] - m[:, :1, 1:] * m[:, 1:, :1] / m[:, :1, :1]).sum(axis=0)
        return pa.table({"fold": pa.array([key[0].as_py()], pa.int32()), "m": pa.array([inside.ravel()], pa.list_(pa.float64()))})

    slim = per.select(F.col(fold).cast("int").alias("fold"), "m")
    return {r.fold: np.array(r.m).reshape(width, width) for r in slim.groupBy("fold").applyInArrow(added, "fold int, m array<double>").collect()}


def solved(matrices: dict[int, np.ndarray], names: list[str], xs: list[str], y: str, ridge: float = 0.0) -> dict[int, np.ndarray]:
    """Coefficients of xs by fold, from the parts of matrices (over names) that belong to xs and y."""
    at, target = [names.index(x) for x in xs], names.index(y)
    return {f: np.linalg.pinv(m[np.ix_(at, at)] + ridge * np.eye(len(at)), hermitian=True) @ m[at, target] for f, m in matrices.items()}


def zone_means(per: DataFrame, names: list[str], *keys: str) -> DataFrame:
    return per.select(*keys, *((F.col("m")[i + 1] / F.col("m")[0]).alias(f"_mean_{c}") for i, c in enumerate(names)))


def fit_within(rows: DataFrame, y: str, xs: list[str], zone: str, fold: str, k: int = K, ridge: float = 0.0) -> tuple[dict[int, np.ndarray], DataFrame]:
    """Least squares with zone effects for each fold's training rows (LM6): coefficients by fold, and zone means.

    Rows are read once: sums of products are formed by their own fold and zone, and a fold's training sums are those of the
    other folds. Zone effects are absorbed: products within zones are sums less the products of means. Only one matrix for
    each fold reaches the driver.
    """
    names = [*xs, y]
    own = written(moments(rows.select(*names, zone, fold).dropna(), names, [fold, zone]))
    train = training_rows(own, fold, k).drop(fold).withColumnRenamed("para", fold)
    sums = written(_added(train, fold, zone))
    return solved(within(sums, fold, len(names)), names, xs, y, ridge), zone_means(sums, names, fold, zone)


def _added(rows: DataFrame, *by: str) -> DataFrame:
    """The arrays m of each group added up."""

    def run(key, table):
        m = table.column("m").combine_chunks()
        return table.select(list(by)).slice(0, 1).append_column("m", pa.array([m.flatten().to_numpy(zero_copy_only=False).reshape(len(m), -1).sum(axis=0)], pa.list_(pa.float64())))

    some = rows.select(*by, "m")
    return some.groupBy(*by).applyInArrow(run, some.schema)


def _by_fold(fold: str, betas: dict[int, np.ndarray], i: int) -> Column:
    return reduce(lambda out, f: out.when(F.col(fold) == f, float(betas[f][i])), sorted(betas), F.when(F.lit(False), 0.0))


def predict_within(rows: DataFrame, y: str, xs: list[str], zone: str, fold: str, betas: dict[int, np.ndarray], means: DataFrame, name: str = "prediccion") -> DataFrame:
    """rows with prediccion (or another name): the zone's training mean plus coefficients times what each x is off its zone mean. A zone
    without training rows takes the mean over the fold's zones."""
    names = [*xs, y]
    city = means.groupBy(fold).agg(*(F.avg(f"_mean_{c}").alias(f"_city_{c}") for c in names))
    rows = rows.join(means, [fold, zone], "left").join(F.broadcast(city), fold, "left")
    mean = lambda c: F.coalesce(f"_mean_{c}", f"_city_{c}")
    terms = [_by_fold(fold, betas, i) * (F.col(x) - mean(x)) for i, x in enumerate(xs)]
    rows = rows.withColumn(name, reduce(lambda a, b: a + b, terms, mean(y)))
    return rows.drop(*(f"_mean_{c}" for c in names), *(f"_city_{c}" for c in names))


def explanation(rows: DataFrame, key: str, y: str, xs: dict[str, str], zone: str, fold: str, betas: dict[int, np.ndarray], means: DataFrame, more: tuple[str, ...] = ()) -> DataFrame:
    """Contributions of groups of variables to each prediction (LM13): (key, more, variable, aporte); base is the zone's mean.

    xs maps each x to the variable that it counts for. The contributions of a key and its base add up to its prediction; a
    zone without training rows takes the means of the fold's zones, as there. Each row is told by itself, nothing is dealt by key:
    keys must not repeat. more: further columns of rows to keep.
    """
    rows, shares, base = _contributions(rows, y, xs, zone, fold, betas, means)
    parts = [F.struct(F.lit(v).alias("variable"), a.alias("aporte")) for v, a in (("base", base), *_by_variable(shares).items())]
    return rows.select(key, *more, F.explode(F.array(*parts)).alias("p")).select(key, *more, "p.*")


def _by_variable(shares: list[tuple[str, Column]]) -> dict[str, Column]:
    """The contributions of each variable added up; nulls don't count, null if all are."""
    by: dict[str, list[Column]] = {}
    for v, a in shares:
        by.setdefault(v, []).append(a)
    total = lambda parts: F.when(reduce(lambda a, b: a | b, (p.isNotNull() for p in parts)), reduce(lambda a, b: a + b, (F.coalesce(p, F.lit(0.0)) for p in parts)))
    return {v: total(parts) for v, parts in by.items()}


def _contributions(rows: DataFrame, y: str, xs: dict[str, str], zone: str, fold: str, betas: dict[int, np.ndarray], means: DataFrame) -> tuple[DataFrame, list[tuple[str, Column]], Column]:
    """rows with the means of their zone and fold, each x's variable and contribution, and the base."""
    city = means.groupBy(fold).agg(*(F.avg(f"_mean_{c}").alias(f"_city_{c}") for c in (*xs, y)))
    rows = rows.join(means, [fold, zone], "left").join(F.broadcast(city), fold, "left")
    mean = lambda c: F.coalesce(f"_mean_{c}", f"_city_{c}")
    return rows, [(v, _by_fold(fold, betas, i) * (F.col(x) - mean(x))) for i, (x, v) in enumerate(xs.items())], mean(y)


def top_contributions(rows: DataFrame, key: str, y: str, xs: dict[str, str], zone: str, fold: str, betas: dict[int, np.ndarray], means: DataFrame, n: int = 2) -> DataFrame:
    """(key, sube_1, ..., baja_1, ..., resto): the n variables of explanation() that raise each prediction most, the n that lower
    it most, and the effect of the rest (W14). Each row of rows is told by itself, nothing is dealt by key: keys must not repeat.
    A contribution that is null comes last among those that lower."""
    rows, shares, _ = _contributions(rows, y, xs, zone, fold, betas, means)
    by = _by_variable(shares)
    rows = rows.select(key, F.array(*(F.struct(F.lit(v).alias("variable"), a.alias("aporte")) for v, a in by.items())).alias("_p"))
    raises = lambda x: F.coalesce(x["aporte"] >= 0, F.lit(False))
    ordered = lambda a: F.array_sort(F.transform(a, lambda x: F.struct(x["aporte"].isNull().alias("a"), (-F.abs(x["aporte"])).alias("b"), x["variable"].alias("variable"), x["aporte"].alias("aporte"))))
    rows = rows.withColumns({"sube": ordered(F.filter("_p", raises)), "baja": ordered(F.filter("_p", lambda x: ~raises(x)))})
    rest = lambda side: F.aggregate(F.slice(side, n + 1, len(by)), F.lit(0.0), lambda s, x: s + F.coalesce(x["aporte"], F.lit(0.0)))
    named = [F.get(F.col(side), F.lit(i))["variable"].alias(f"{side}_{i + 1}") for side in ("sube", "baja") for i in range(n)]
    return rows.select(key, *named, (F.exp(rest("sube") + rest("baja")) - 1).alias("resto"))


def zone_of(rows: DataFrame, choice: DataFrame, fold: str, barrio: str, subzona: str, counts: DataFrame | None = None, least: int = 10) -> DataFrame:
    """rows with zona: the subzone where it is chosen, known and has `least` training rows in the fold, else the neighbourhood
    (LM4). choice: (fold, barrio, usa_subzona); counts: (fold, subzona, n) of training rows, else those of rows."""
    if counts is None:
        counts = rows.filter(F.col(subzona).isNotNull()).groupBy(fold, subzona).agg(F.count("*").alias("_n"))
    out = rows.join(choice, [fold, barrio], "left").join(counts.withColumnRenamed("n", "_n"), [fold, subzona], "left")
    use = F.col("usa_subzona") & F.col(subzona).isNotNull() & (F.col("_n") >= least)
    return out.withColumn("zona", F.when(F.coalesce(use, F.lit(False)), F.col(subzona)).otherwise(F.col(barrio))).drop("usa_subzona", "_n")


@dataclass
class Fit:
    """Linear models of all folds. rows: all rows with zona, what their fold's training rows tell of it, and prediccion; train:
    (fold, features) for each fold that learns from a row; xs: the features, those made within folds too."""

    rows: DataFrame
    train: DataFrame
    xs: list[str]
    betas: dict[int, np.ndarray]
    means: DataFrame
    matrices: dict[int, np.ndarray]

    def variant(self, y: str, xs: list[str], fold: str, name: str, rows: DataFrame | None = None) -> tuple[dict[int, np.ndarray], DataFrame]:
        """Coefficients with some of the columns only, from the sums that are there, and rows (else all) with that prediction."""
        betas = solved(self.matrices, [*self.xs, y], xs, y)
        out = predict_within(self.rows if rows is None else rows, y, xs, "zona", fold, betas, self.means.select(fold, "zona", *(f"_mean_{c}" for c in (*xs, y))), name)
        return betas, out


def leak_free_fit(
    rows: DataFrame, y: str, xs: list[str], barrio: str, subzona: str, unit: str, fold: str, excluded: DataFrame | None = None, expenses: str | None = None,
    more: tuple[str, ...] = (), k: int = K, least: int = 10, in_logs: bool = True, also: Callable[[DataFrame, DataFrame], tuple[DataFrame, DataFrame]] | None = None, extra: tuple[str, ...] = (),
) -> Fit:
    """Linear models where nothing of a fold is known to its own (LM5, LM6): for each fold, zones are chosen on its training
    rows, and outliers of those (y by zone, 1.5 interquartile ranges) are left out of the fit.

    y: logarithms. excluded: neighbourhoods (a column named as barrio) that never use subzones. expenses: a column of
    logarithms, which counts as the difference from its zone's training median, 0 where it is unknown, with a mark
    (gasto_rel, gasto_falta; LM8). rows also get zona_log_mediana, the logarithm of the zone's median training value (null for
    a zone without training rows), and log_mediana, that or the city's (LM7). more: further columns that train keeps. in_logs:
    whether outliers are looked for among logarithms or values. also: takes (train, rows), both with fold and zona, and returns
    them with the columns extra, which it learns from train alone; they are columns of the model too.
    """
    value = rows.filter(F.col(subzona).isNotNull()).withColumn("_value", F.exp(y))
    choice = zone_choice(value, "_value", fold, barrio, subzona, unit, k, least)
    if excluded is not None:
        names = excluded.select(barrio).distinct().withColumn("_never", F.lit(True))
        choice = choice.join(names, barrio, "left").withColumn("usa_subzona", F.col("usa_subzona") & F.col("_never").isNull()).drop("_never")
    choice = written(choice)
    kept = dict.fromkeys([*xs, *more, y, barrio, subzona, fold, *([expenses] if expenses else [])])
    long = training_rows(rows.select(*kept).dropna(subset=[*xs, y]), fold, k).drop(fold).withColumnRenamed("para", fold)
    counts = written(long.filter(F.col(subzona).isNotNull()).groupBy(fold, subzona).agg(F.count("*").alias("n")))
    long = zone_of(long, choice, fold, barrio, subzona, counts, least)
    scale = F.col(y) if in_logs else F.exp(y)
    narrow = written(long.select(fold, "zona", y, *([expenses] if expenses else [])))  # each quantile reads its rows several times
    limits = group_quantiles(narrow.select(fold, "zona", scale.alias("_v")), "_v", [fold, "zona"], [0.25, 0.75]).withColumnsRenamed({"q": "_q", "n": "_m"})
    span = F.col("_q")[1] - F.col("_q")[0]
    inside = scale.between(F.col("_q")[0] - 1.5 * span, F.col("_q")[1] + 1.5 * span) | (F.col("_m") < least)
    train = long.join(limits, [fold, "zona"]).filter(inside).drop("_q", "_m")
    slim = written(narrow.join(limits, [fold, "zona"]).filter(inside).select(fold, "zona", F.exp(y).alias("_value"), *([expenses] if expenses else [])))
    unwritten(narrow)
    zones = group_quantiles(slim, "_value", [fold, "zona"], [0.5]).select(fold, "zona", F.log(F.col("q")[0]).alias("zona_log_mediana"))
    if expenses:
        spent = group_quantiles(slim, expenses, [fold, "zona"], [0.5]).select(fold, "zona", F.col("q")[0].alias("_g"))
        zones = written(zones.join(spent, [fold, "zona"], "left"))
    city = written(group_quantiles(slim, "_value", [fold], [0.5]).select(fold, F.log(F.col("q")[0]).alias("_c")))
    unwritten(slim)

    def placed(some: DataFrame) -> DataFrame:
        out = some.join(zones, [fold, "zona"], "left").join(F.broadcast(city), fold, "left").withColumn("log_mediana", F.coalesce("zona_log_mediana", "_c")).drop("_c")
        if expenses is None:
            return out
        return out.withColumns({"gasto_rel": F.coalesce(F.col(expenses) - F.col("_g"), F.lit(0.0)), "gasto_falta": F.col(expenses).isNull().cast("double")}).drop("_g")

    names = [*xs, *(("gasto_rel", "gasto_falta") if expenses else ()), *extra]
    train, rows = placed(train), placed(zone_of(rows, choice, fold, barrio, subzona, counts, least))
    if also is not None:
        train, rows = also(train, rows)
        train = written(train)
    sums = written(moments(train, [*names, y], [fold, "zona"]))
    matrices = within(sums, fold, len(names) + 1)
    betas, means = solved(matrices, [*names, y], names, y), written(zone_means(sums, [*names, y], fold, "zona"))
    out = predict_within(rows, y, names, "zona", fold, betas, means)
    return Fit(out, train, names, betas, means, matrices)


def leak_free(rows: DataFrame, y: str, xs: list[str], barrio: str, subzona: str, unit: str, fold: str, excluded: DataFrame | None = None, k: int = K) -> tuple[DataFrame, dict[int, np.ndarray], DataFrame]:
    """rows with zona and prediccion, coefficients by fold and zone means of leak_free_fit()."""
    fit = leak_free_fit(rows, y, xs, barrio, subzona, unit, fold, excluded, k=k)
    return fit.rows.drop("zona_log_mediana", "log_mediana"), fit.betas, fit.means


def premiums(betas: dict[int, np.ndarray], xs: list[str], prefix: str) -> dict[str, float]:
    """The mean coefficient over folds of each x whose name begins with prefix, by the rest of the name (R2)."""
    return {x[len(prefix) :]: float(np.mean([b[i] for b in betas.values()])) for i, x in enumerate(xs) if x.startswith(prefix)}


def check_explanation(contributions: DataFrame, predictions: DataFrame, key: str, prediction: str, tolerance: float = 1e-8) -> None:
    """Raise if the contributions of a key don't add up to its prediction."""
    sums = contributions.groupBy(key).agg(F.sum("aporte").alias("_s"))
    off = sums.join(predictions.select(key, prediction), key).agg(F.max(F.abs(F.col("_s") - F.col(prediction))).alias("d")).first().d
    if off is not None and off > tolerance:
        raise RuntimeError(f"an explanation is {off} off its prediction")


def explanation_table(contributions: DataFrame, key: str, n: int = 3) -> DataFrame:
    """One row per key (W14): the reference and expected value, the n variables that raise it most and the n that lower it most
    with their effects in percent, and the effect of the rest; reference x (1 + effects) = expected value.

    contributions: key, variable, aporte, with the variable base; a key has as many rows as there are variables.
    """
    pair = F.struct(F.col("aporte").alias("aporte"), F.col("variable").alias("variable"))
    per = contributions.groupBy(key).agg(F.max(F.when(F.col("variable") == "base", F.col("aporte"))).alias("_base"), F.array_sort(F.collect_list(F.when(F.col("variable") != "base", pair))).alias("_p"))
    up = F.slice(F.reverse(F.filter("_p", lambda x: x["aporte"] > 0)), 1, n)
    down = F.slice(F.filter("_p", lambda x: x["aporte"] < 0), 1, n)
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x["aporte"])
    percent = lambda x: 100 * (F.exp(x) - 1)
    per = per.withColumns({"_up": up, "_down": down})
    shown = [c for side, a in (("sube", "_up"), ("baja", "_down")) for i in range(n) for c in (F.get(F.col(a), F.lit(i))["variable"].alias(f"{side}_{i + 1}"), percent(F.get(F.col(a), F.lit(i))["aporte"]).alias(f"{side}_{i + 1}_pct"))]
    return per.select(key, F.exp("_base").alias("precio_m2_referencia_zona"), F.exp(F.col("_base") + total(F.col("_p"))).alias("precio_m2_esperado"), *shown, percent(total(F.col("_p")) - total(F.col("_up")) - total(F.col("_down"))).alias("resto_pct"))


def fold_relative(rows: DataFrame, value: str, zone: str, fold: str, name: str, k: int = K) -> DataFrame:
    """rows with name: log(value) less its zone's training median of it, 0 where either is missing, and name_falta (LM8)."""
    middle = fold_quantiles(rows.select(F.log(value).alias("_l"), zone, fold), "_l", [zone], fold, [0.5], k).select(fold, zone, F.col("q")[0].alias("_m"))
    found = F.log(value) - F.col("_m")
    return rows.join(middle, [fold, zone], "left").withColumns({name: F.coalesce(found, F.lit(0.0)), f"{name}_falta": found.isNull().cast("double")}).drop("_m")


def block_importance(contributions: DataFrame, key: str, fold: str) -> tuple[DataFrame, DataFrame]:
    """Importance of each variable, the mean size of its contribution, and the rank correlation of importances between folds
    (LM15). contributions: key, fold, variable, aporte."""
    per = contributions.filter("variable != 'base'").groupBy(fold, "variable").agg(F.avg(F.abs("aporte")).alias("v"))
    every = contributions.filter("variable != 'base'").groupBy("variable").agg(F.avg(F.abs("aporte")).alias("importancia"))
    ranks = per.withColumn("r", F.rank().over(Window.partitionBy(fold).orderBy("v")))  # a row per variable and fold
    pairs = ranks.alias("a").join(ranks.alias("b"), "variable").filter(F.col(f"a.{fold}") < F.col(f"b.{fold}"))
    stable = pairs.groupBy(F.col(f"a.{fold}").alias("vuelta_a"), F.col(f"b.{fold}").alias("vuelta_b")).agg(F.corr("a.r", "b.r").alias("rho"))
    return every, stable
