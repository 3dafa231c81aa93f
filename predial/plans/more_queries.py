"""Further summaries over listings: names, samples, exports, resampled differences and rank checks."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from predial.functions import numeric, text
from predial.operators import clean, model, stats
from predial.plans.listing_queries import _SURVEYS, _poisson_sql, _UNIT, r6, surveys, with_unit
from predial.plans.other_queries import _XS, hedonic_fit
from predial.sources.listings import LISTINGS_SQL, listings, tables

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, view: bool = True):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = f"with {LISTINGS_SQL}{sql}" if view else sql
        return f

    return add


@query()
def top_contributions(spark, sf):
    """The two variables that raise and the two that lower each prediction most, and the product of the rest."""
    rows, betas, means = hedonic_fit(spark, sf)
    return model.top_contributions(rows, "id_aviso", "y", _XS, "barrio", "vuelta", betas, means)


@query(""", e as (select n_name as nombre, n_name as oficial from nation union all select 'NATION_1', 'NATION_2' union all select 'NATION_3', 'NATION_4'),
  p as (select barrio, 'NATION_' || (partkey % 25) as oficial, partkey % 10 = 0 as falta from listings)
  select barrio, count(*) filter (where not falta and exists (select 1 from e where e.nombre = p.barrio and e.oficial = p.oficial)) as coinciden, count(*) filter (where falta) as sin_oficial, count(*) as n from p group by 1""")
def name_equivalence(spark, sf):
    """Names that match an official one, or one that is equivalent (J22); null where there is no official name."""
    (nation,) = tables(spark, sf, "nation")
    known = nation.select(F.col("n_name").alias("nombre"), F.col("n_name").alias("oficial"))
    known = known.unionByName(spark.createDataFrame([("NATION_1", "NATION_2"), ("NATION_3", "NATION_4")], "nombre string, oficial string"))
    known = known.select(text.match_key(F.col("nombre")).alias("k"), text.match_key(F.col("oficial")).alias("o")).distinct().withColumn("igual", F.lit(True))
    official = F.when(F.col("partkey") % 10 != 0, F.concat(F.lit("nation-"), (F.col("partkey") % 25).cast("string")))
    rows = listings(spark, sf).select("barrio", text.match_key(F.col("barrio")).alias("k"), text.match_key(official).alias("o"))
    rows = rows.join(known, ["k", "o"], "left")
    return rows.groupBy("barrio").agg(F.count_if("igual").alias("coinciden"), F.count_if(F.col("o").isNull()).alias("sin_oficial"), F.count("*").alias("n"))


@query(f""", n as (select {_UNIT} as unidad, median(precio_m2_usd) as a, median(precio_m2_usd * (1 + linenumber / 20.0::double)) as b from listings group by 1),
  d as (select rep, a, b, ('0x' || substr(md5(rep || '|' || unidad), 1, 8))::ubigint::double / 4294967296.0 as u from n, range(1, 101) r(rep)),
  w as (select rep, a, b, unnest(range({_poisson_sql('u')})) from d), m as (select rep, median(b) - median(a) as m from w group by 1)
  select round(quantile_cont(m, 0.025), 6) as inferior, round(quantile_cont(m, 0.975), 6) as superior, count(*) as repeticiones from m""")
def bootstrap_difference(spark, sf):
    """A confidence interval of the difference of two columns' medians over the same resampled units (BS2)."""
    rows = with_unit(spark, sf).withColumn("otro", F.col("precio_m2_usd") * (1 + F.col("linenumber") / 20.0))
    out = stats.bootstrap_median_difference(rows, "otro", "precio_m2_usd", "unidad")
    return out.select(r6("inferior").alias("inferior"), r6("superior").alias("superior"), "repeticiones")


@query(f"""{_SURVEYS}, x as (select length(clave_unidad) % 3 as grupo, clave_unidad, ((case when same is not null then 'sigue' when again is not null then 'republicado' else 'salio' end) = 'salio')::int::double as v from j),
  n as (select grupo, clave_unidad, sum(v) as s, count(*) as n from x group by 1, 2), d as (select grupo, rep, s, n, ('0x' || substr(md5(rep || '|' || clave_unidad), 1, 8))::ubigint::double / 4294967296.0 as u from n, range(1, 301) r(rep)),
  m as (select grupo, rep, sum(({_poisson_sql('u')}) * s) / sum(({_poisson_sql('u')}) * n) as m from d group by 1, 2)
  select grupo::int as grupo, round(quantile_cont(m, 0.025), 6) as inferior, round(quantile_cont(m, 0.975), 6) as superior, count(*) as repeticiones from m group by 1""")
def exit_rate_limits(spark, sf):
    """Limits of exit rates by group, units resampled."""
    rows = clean.snapshot_diff(*surveys(spark, sf)).filter("clave_unidad is not null")
    rows = rows.select("clave_unidad", (F.length("clave_unidad") % 3).alias("grupo"), (F.col("estado") == "salio").cast("double").alias("v"))
    return stats.cluster_bootstrap(rows, "v", "clave_unidad", by=("grupo",)).select("grupo", r6("inferior").alias("inferior"), r6("superior").alias("superior"), "repeticiones")


@query(""", s as (select distinct id_aviso from listings order by md5(id_aviso || '42'), id_aviso limit 500) select * from s""")
def seeded_sample(spark, sf):
    """500 ids drawn by hash (T6): the sample is the feature."""
    ids = listings(spark, sf).select("id_aviso").distinct()
    return ids.orderBy(F.md5(F.concat("id_aviso", F.lit("42"))), "id_aviso").limit(500)


@query(""" , b as (select barrio, dense_rank() over (order by barrio) - 1 as codigo from (select distinct barrio from listings))
  select codigo::int as codigo, round_even(lat, 4) as lat, round_even(lon, 4) as lon, count(*) as n from listings join b using (barrio) group by 1, 2, 3""")
def map_background(spark, sf):
    """Points with dictionary-encoded neighbourhoods and rounded coordinates (SNK5)."""
    rows = listings(spark, sf).select("barrio", F.bround("lat", 4).alias("lat"), F.bround("lon", 4).alias("lon"))
    codes = rows.select("barrio").distinct().withColumn("codigo", F.dense_rank().over(Window.orderBy("barrio")) - 1)  # one row per neighbourhood
    return rows.join(codes, "barrio").groupBy("codigo", "lat", "lon").agg(F.count("*").alias("n"))


@query(f"""{_SURVEYS}, x as (select case when same is not null then 'sigue' when again is not null then 'republicado' else 'salio' end as estado, length(clave_unidad) % 3 as g from j),
  t as (select g, avg((estado = 'salio')::int::double) as tasa from x group by 1) select x.g::int as grupo, count(*) as n, round(any_value(tasa), 6) as tasa from x join t using (g) group by 1""")
def exit_rate_by_group(spark, sf):
    """Exit rates by group, mapped back to rows."""
    rows = clean.snapshot_diff(*surveys(spark, sf)).withColumn("grupo", F.length("clave_unidad") % 3)
    rate = rows.groupBy("grupo").agg(F.avg((F.col("estado") == "salio").cast("double")).alias("tasa"))
    return rows.join(rate, "grupo").groupBy("grupo").agg(F.count("*").alias("n"), r6(F.first("tasa")).alias("tasa"))


@query(""", t as (select unnest(string_split(titulo, ' ')) as palabra from listings) select palabra, count(*) as n from t group by 1""")
def label_counts(spark, sf):
    """Counts of the words of a text column."""
    return listings(spark, sf).select(F.explode(F.split("titulo", " ")).alias("palabra")).groupBy("palabra").agg(F.count("*").alias("n"))


@query(""" select barrio, subzona, count(*) as n from listings where subzona is not null group by 1, 2 order by n desc, barrio, subzona limit 20""")
def pair_counts_top(spark, sf):
    """The 20 most frequent pairs (A28): the limit is the feature."""
    return listings(spark, sf).filter("subzona is not null").groupBy("barrio", "subzona").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "barrio", "subzona").limit(20)


_PHI = "case when {z} >= 0 then 1 - {u} else {u} end"
_TAIL = "exp(-{z} * {z} / 2) / sqrt(2 * pi()) * (t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429)))))"


@query(f""", l as (select ln(precio_m2_usd) as v from listings), m as (select avg(v) as m, stddev_samp(v) as s from l), z as (select round((v - m) / s, 9) as z from l, m),
  r as (select z, 1 / (1 + 0.2316419 * abs(z)) as t, rank() over (order by z) - 1 as below, rank() over (order by z) - 1 + count(*) over (partition by z) as upto, count(*) over () as n from z),
  f as (select {_PHI.format(z='z', u='(' + _TAIL.format(z='z') + ')')} as phi, below, upto, n from r)
  select round(max(greatest(phi - below::double / n, upto::double / n - phi)), 6) as d, any_value(n) as n from f""")
def ks_normal(spark, sf):
    """The Kolmogorov-Smirnov distance of standardised log prices from the normal."""
    rows = listings(spark, sf).select(F.log("precio_m2_usd").alias("v"))
    moments = rows.agg(F.avg("v").alias("m"), F.stddev_samp("v").alias("s"), F.count("v").alias("n"))  # one row
    z = rows.crossJoin(F.broadcast(moments)).select(F.round((F.col("v") - F.col("m")) / F.col("s"), 9).alias("z"), "n")
    counts = stats.ranked(z, "z").groupBy("z", "n").agg(F.first("rango").alias("r"), F.count("*").alias("c"))
    phi, below = numeric.normal_cdf(F.col("z")), F.col("r") - (F.col("c") + 1) / 2
    gap = F.greatest(phi - below / F.col("n"), (below + F.col("c")) / F.col("n") - phi)
    return counts.agg(r6(F.max(gap)).alias("d"), F.first("n").alias("n"))


def aligned_labels(rows: DataFrame, labels: str, reference: str, k: int) -> DataFrame:
    """(label, name): the renaming of k (at most 8) labels that agrees with a reference most often.

    Counts are formed on Spark; all k! renamings are a small table.
    """
    if k > 8:
        raise ValueError("at most 8 labels")
    spark = rows.sparkSession
    cells = rows.groupBy(F.col(labels).cast("int").alias("a"), F.col(reference).cast("int").alias("b")).agg(F.count("*").alias("n"))
    names = spark.createDataFrame([(i, a, b) for i, p in enumerate(permutations(range(k))) for a, b in enumerate(p)], "orden int, a int, b int")
    hits = names.join(F.broadcast(cells), ["a", "b"]).groupBy("orden").agg(F.sum("n").alias("n"))
    best = hits.orderBy(F.desc("n"), "orden").limit(1)
    return names.join(F.broadcast(best), "orden").select(F.col("a").alias("etiqueta"), F.col("b").alias("nombre"))


@query(""", c as (select ambientes::int - 1 as a, (ambientes::int + 1) % 6 as b from listings) select distinct a as etiqueta, b as nombre from c""")
def label_alignment(spark, sf):
    """Labels that a shift has renamed, aligned again."""
    rows = listings(spark, sf).select((F.col("ambientes").cast("int") - 1).alias("a"), ((F.col("ambientes").cast("int") + 1) % 6).alias("b"))
    return aligned_labels(rows, "a", "b", 6)
