"""Queries over pages, documents, events and embeddings, and the modelling queries over listings."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Window
from pyspark.sql import functions as F

from predial.functions import numeric, text
from predial.operators import clean, cluster, learn, model, stats
from predial.operators.clean import truth
from predial.plans.listing_queries import _DEDUP, _FOLD, _reason, _REASON, _UNIT, QUERIES as _listed, r6, surveys as _surveys, with_unit
from predial.sources.listings import LISTINGS_SQL, listings, tables
from predial.streaming.dedup import windowed_counts

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, view: bool = True):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = f"with {LISTINGS_SQL}{sql}" if view else sql
        return f

    return add


_DOTS = "case when {n} >= 1000 then ({n} // 1000) || '.' || lpad(({n} % 1000)::varchar, 3, '0') else {n}::varchar end"


def _dots(n):
    return F.when(n >= 1000, F.concat(F.floor(n / 1000).cast("string"), F.lit("."), F.lpad((n % 1000).cast("string"), 3, "0"))).otherwise(n.cast("string"))


@query(f""", t as (select orderkey, partkey, floor(precio_usd)::bigint as n from listings), x as (select *, case when partkey % 4 = 0 and n >= 20 then n + 1000 end as antes from t)
  select n::double as precio, case when antes is not null then antes::double end as precio_anterior, antes is not null as bajo, round(case when antes is not null then 100 * (1 - n::double / antes) end, 6) as baja_pct,
  count(*) as filas from x group by 1, 2, 3, 4""")
def price_text_parse(spark, sf):
    rows = listings(spark, sf).select("partkey", F.floor("precio_usd").alias("n"))
    before = F.when((F.col("partkey") % 4 == 0) & (F.col("n") >= 20), F.concat(F.lit("US$"), _dots(F.col("n") + 1000)))
    shown = F.concat(F.coalesce(before, F.lit("")), F.lit("US$ "), _dots(F.col("n")), F.when(before.isNotNull(), " BAJÓ DE PRECIO").otherwise(""))
    parsed = rows.select(shown.alias("t")).select(*(v.alias(k) for k, v in text.price_parts(F.col("t")).items()))
    parsed = parsed.withColumns({"bajo": F.coalesce("bajo", F.lit(False)), "baja_pct": r6("baja_pct")})
    return parsed.groupBy("precio", "precio_anterior", "bajo", "baja_pct").agg(F.count("*").alias("filas"))


@query(""", t as (select partkey, suppkey, linenumber from listings) select case when partkey % 7 <> 0 then (partkey % 900 + 0.5)::double end as m2, case when partkey % 200 between 151 and 199 then null else (partkey % 200)::double end as edad,
  case when suppkey % 3 = 0 then null when suppkey % 3 = 1 then (suppkey * 100)::double else (10 + linenumber) * 1500.0::double end as expensas, count(*) as n from t group by 1, 2, 3""")
def surface_age_expenses(spark, sf):
    p, s, n = F.col("partkey"), F.col("suppkey"), F.col("linenumber")
    rows = listings(spark, sf).select(
        F.concat((p % 900).cast("string"), F.when(p % 7 != 0, ",5 m²").otherwise(",5 ha")).alias("sup"),
        F.concat((p % 200).cast("string"), F.lit(" años")).alias("edad"),
        F.when(s % 3 == 0, "0 ARS").when(s % 3 == 1, F.concat((s * 100).cast("string"), F.lit(" ARS"))).otherwise(F.concat((10 + n).cast("string"), F.lit(" USD"))).alias("exp"),
    )
    out = rows.select(text.surface(F.col("sup")).alias("m2"), text.age(F.col("edad"))["antiguedad"].alias("edad"), text.expenses(F.col("exp"), 1500.0).alias("expensas"))
    return out.groupBy("m2", "edad", "expensas").agg(F.count("*").alias("n"))


@query(r"""select case when regexp_matches(text, '(?i)idiot|moron|stupid') then 'insulto' when regexp_matches(text, '(?i)all rights reserved|license') then 'licencia' when contains(text, ' | ') then 'tabla' else 'sin_marca' end as estado,
  lang, count(*) as n, count(*) filter (where regexp_matches(text, '[0-9]')) as con_digitos, sum(length(text))::bigint as caracteres from documents group by 1, 2""", view=False)
def text_rules(spark, sf):
    (docs,) = tables(spark, sf, "documents")
    rules = [("insulto", "(?i)idiot|moron|stupid"), ("licencia", "(?i)all rights reserved|license"), ("tabla", r" \| ")]
    return docs.groupBy(text.first_rule(F.col("text"), rules, "sin_marca").alias("estado"), "lang").agg(F.count("*").alias("n"), F.count_if(F.col("text").rlike("[0-9]")).alias("con_digitos"), F.sum(F.length("text")).alias("caracteres"))


@query(r"""select page_id, split_part(split_part(url, '#', 1), '?', 1) as url_base, nullif(regexp_extract(html, '<title>([^<]*)</title>', 1), '') as titulo, len(regexp_extract_all(html, '<a [^>]*href'))::int as enlaces,
  len(regexp_extract_all(html, '<p[ >]'))::int as parrafos from pages""", view=False)
def page_fields(spark, sf):
    (pages,) = tables(spark, sf, "pages")
    found = lambda pattern: F.size(F.regexp_extract_all("html", F.lit(pattern), F.lit(0)))
    return pages.select("page_id", text.url_base(F.col("url")).alias("url_base"), text.null_if_empty(F.regexp_extract("html", "<title>([^<]*)</title>", 1)).alias("titulo"), found("<a [^>]*href").alias("enlaces"), found("<p[ >]").alias("parrafos"))


@query(r"""with t as (select unnest(regexp_extract_all(html, '<([a-z][a-z0-9]*)[ >]', 1)) as etiqueta from pages) select etiqueta, count(*) as n from t group by 1""", view=False)
def page_tags(spark, sf):
    (pages,) = tables(spark, sf, "pages")
    return pages.select(F.explode(F.regexp_extract_all("html", F.lit("<([a-z][a-z0-9]*)[ >]"), F.lit(1))).alias("etiqueta")).groupBy("etiqueta").agg(F.count("*").alias("n"))


@query(r"""select event_type, count(*) as n, count(*) filter (where value > 50) as ok, round_even(100 * avg((value > 50)::int::double), 2) as tasa, count(distinct user_id) as usuarios from events group by 1""", view=False)
def event_rates(spark, sf):
    (events,) = tables(spark, sf, "events")
    ok = F.col("value") > 50
    return events.groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(ok).alias("ok"), F.bround(100 * F.avg(ok.cast("double")), 2).alias("tasa"), F.count_distinct("user_id").alias("usuarios"))


@query("""select time_bucket(interval 1 hour, ts) as inicio, event_type, count(*) as n, round(sum(value), 4) as suma from events group by 1, 2""", view=False)
def event_windows(spark, sf):
    (events,) = tables(spark, sf, "events")
    out = windowed_counts(events, "ts", "event_type")
    return out.select(F.col("ventana.start").alias("inicio"), "event_type", "n", F.round("suma", 4).alias("suma"))


@query("""with a as (select *, lag(ts) over (partition by user_id order by ts, event_id) as antes from events), s as (select user_id, ts, sum(case when antes is null or ts - antes > interval 30 minute then 1 else 0 end) over (partition by user_id order by ts, event_id) as sesion, value from a)
  select sesiones, count(*) as usuarios from (select user_id, max(sesion)::bigint as sesiones from s group by 1) group by 1""", view=False)
def event_sessions(spark, sf):
    (events,) = tables(spark, sf, "events")
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.lag("ts").over(order)
    new = (gap.isNull() | (F.col("ts") > gap + F.expr("interval 30 minutes"))).cast("long")
    return events.select("user_id", new.alias("nueva")).groupBy("user_id").agg(F.sum("nueva").alias("sesiones")).groupBy("sesiones").agg(F.count("*").alias("usuarios"))


@query(""" , r as (select id_aviso, count(*) as n, count(distinct barrio) as b, count(distinct precio_usd) as p from listings group by 1)
  select count(*) filter (where n > 1) as repetidos, count(*) filter (where b > 1) as en_dos_barrios, count(*) filter (where p > 1) as con_otro_precio, count(*) as ids from r""")
def duplicate_diagnosis(spark, sf):
    per = listings(spark, sf).groupBy("id_aviso").agg(F.count("*").alias("n"), F.count_distinct("barrio").alias("b"), F.count_distinct("precio_usd").alias("p"))
    return per.agg(F.count_if(F.col("n") > 1).alias("repetidos"), F.count_if(F.col("b") > 1).alias("en_dos_barrios"), F.count_if(F.col("p") > 1).alias("con_otro_precio"), F.count("*").alias("ids"))


@query(""" select 'dormitorios' as control, count(*) filter (where dormitorios >= ambientes and ambientes > 1) as n from listings union all select 'piso', count(*) filter (where pisos_edificio >= 3 and piso > pisos_edificio) from listings
  union all select 'sin_banos', count(*) filter (where banos is null) from listings union all select 'm2_bajo', count(*) filter (where m2_final < 15) from listings""")
def incoherence_counts(spark, sf):
    rows = clean.incoherences(listings(spark, sf))
    one = rows.agg(F.count_if("incoherencia_ambientes").alias("dormitorios"), F.count_if("incoherencia_piso").alias("piso"), F.count_if(F.col("banos").isNull()).alias("sin_banos"), F.count_if(F.col("m2_final") < 15).alias("m2_bajo"))
    return one.unpivot([], ["dormitorios", "piso", "sin_banos", "m2_bajo"], "control", "n")


@query(""", c as (select unnest(['apto_credito', 'balcon', 'pileta', 'gimnasio']) as rasgo, unnest([apto_credito, balcon, pileta, gimnasio]) as v, barrio, precio_m2_usd from listings),
  g as (select rasgo, barrio, median(precio_m2_usd) filter (where v = 'Sí') as con, median(precio_m2_usd) filter (where v = 'No') as sin, count(*) filter (where v = 'Sí') as a, count(*) filter (where v = 'No') as b from c where v is not null group by 1, 2)
  select rasgo, sum(a)::double / sum(a + b) as proporcion, round(median((con / sin - 1) * 100) filter (where a >= 10 and b >= 10), 6) as prima_pct, count(*) filter (where a >= 10 and b >= 10) as zonas from g group by 1""")
def characteristic_contrasts(spark, sf):
    names = ["apto_credito", "balcon", "pileta", "gimnasio"]
    long = listings(spark, sf).select("barrio", "precio_m2_usd", *names).unpivot(["barrio", "precio_m2_usd"], names, "rasgo", "v").filter("v is not null")
    yes, no = F.col("v") == "Sí", F.col("v") == "No"
    per = long.groupBy("rasgo", "barrio").agg(F.median(F.when(yes, F.col("precio_m2_usd"))).alias("con"), F.median(F.when(no, F.col("precio_m2_usd"))).alias("sin"), F.count_if(yes).alias("a"), F.count_if(no).alias("b"))
    both = (F.col("a") >= 10) & (F.col("b") >= 10)
    return per.groupBy("rasgo").agg((F.sum("a").cast("double") / F.sum(F.col("a") + F.col("b"))).alias("proporcion"), r6(F.median(F.when(both, (F.col("con") / F.col("sin") - 1) * 100))).alias("prima_pct"), F.count_if(both).alias("zonas"))


@query(""" select barrio, count(*) as n, round(median(precio_m2_usd), 6) as mediana, round(100 * (quantile_cont(precio_m2_usd, 0.75) - quantile_cont(precio_m2_usd, 0.25)) / median(precio_m2_usd), 6) as iqr_pct,
  avg(case when antiguedad is not null then (antiguedad <= 15)::int::double end) as recientes from listings group by 1 having count(*) >= 100""")
def barrio_distribution(spark, sf):
    v = "precio_m2_usd"
    spread = 100 * (F.percentile(v, F.lit(0.75)) - F.percentile(v, F.lit(0.25))) / F.median(v)
    out = listings(spark, sf).groupBy("barrio").agg(F.count("*").alias("n"), r6(F.median(v)).alias("mediana"), r6(spread).alias("iqr_pct"), F.avg((F.col("antiguedad") <= 15).cast("double")).alias("recientes"))
    return out.filter("n >= 100")


@query(""", h as (select (linenumber > 3) as x, (partkey % 3 = 0) as y, count(*)::double as n from listings group by 1, 2), m as (select x, sum(n) as a from h group by 1), k as (select y, sum(n) as b from h group by 1), t as (select sum(n) as t from h)
  select round(sum(pow(greatest(abs(n - a * b / t) - 0.5, 0), 2) / (a * b / t)), 6) as chi2, sum(n)::bigint as n from h join m using (x) join k using (y), t""")
def chi2_yates(spark, sf):
    cells = listings(spark, sf).groupBy((F.col("linenumber") > 3).alias("x"), (F.col("partkey") % 3 == 0).alias("y")).agg(F.count("*").cast("double").alias("n"))
    whole = lambda *by: F.sum("n").over(Window.partitionBy(*by))  # noqa: E731  four cells
    cells = cells.withColumn("e", whole("x") * whole("y") / whole())
    return cells.agg(r6(F.sum(F.pow(F.greatest(F.abs(F.col("n") - F.col("e")) - 0.5, F.lit(0.0)), 2) / F.col("e"))).alias("chi2"), F.sum("n").cast("long").alias("n"))


#: The two-sided tail of Student's t, by Simpson's rule over a power of a cosine.
_T_BEYOND = """abs(round(1 - 2 * exp(lgamma(({df} + 1) / 2.0::double) - lgamma({df} / 2.0::double)) / sqrt(pi()) * (select sum(case when i in (0, 20000) then 1 when i % 2 = 1 then 4 else 2 end
  * pow(cos(atan(abs({t}) / sqrt({df})) * i / 20000), {df} - 1)) * atan(abs({t}) / sqrt({df})) / 60000 from range(20001) r(i)), 6))"""


@query(f""", u as (select {_UNIT} as unidad, avg(ln(precio_m2_usd)) as v from listings group by 1), m as (select avg(v) as m, stddev_samp(v) as s, count(*) as n, median(v) as med from u)
  select round(m / (s / sqrt(n)), 4) as t, n, round(1.4826 * (select median(abs(v - med)) from u, m), 6) as mad, {_T_BEYOND.format(t='m / (s / sqrt(n))', df='(n - 1)')} as p from m""")
def unit_t_and_mad(spark, sf):
    # Written once, one number a unit: both medians read it several times, and no task holds its numbers.
    units = cluster.written(with_unit(spark, sf).groupBy("unidad").agg(F.avg(F.log("precio_m2_usd")).alias("v")).select("v"))
    one = units.agg(F.avg("v").alias("m"), F.stddev_samp("v").alias("s"), F.count("*").alias("n"))
    middle = cluster.written(stats.exact_quantiles(units, "v", [0.5]).select(F.col("q")[0].alias("med")))
    off = units.crossJoin(F.broadcast(middle)).select(F.abs(F.col("v") - F.col("med")).alias("d"))
    mad = stats.exact_quantiles(off, "d", [0.5]).select((1.4826 * F.col("q")[0]).alias("mad"))
    t = F.col("m") / (F.col("s") / F.sqrt("n"))
    p = numeric.student_two_sided(t, F.col("n") - 1)
    return one.crossJoin(F.broadcast(mad)).select(F.round(t, 4).alias("t"), "n", r6("mad").alias("mad"), F.abs(r6(p)).alias("p"))


_ZONES = f""", b as (select barrio, subzona, precio_m2_usd as v, {_FOLD.format(u=_UNIT)} as vuelta, {_FOLD.format(u=_UNIT + " || '#'")} as inner_ from listings),
  t as (select o.o as outer_, b.* from b, range(5) o(o) where o.o <> vuelta), f as (select t.*, i.i as para from t, range(5) i(i) where i.i <> inner_),
  mb as (select outer_, para, barrio, median(v) as m from f group by 1, 2, 3 having count(v) >= 10), ms as (select outer_, para, barrio, subzona, median(v) as m from f where subzona is not null group by 1, 2, 3, 4 having count(v) >= 10),
  e as (select t.outer_, t.barrio, abs(t.v / mb.m - 1) as eb, abs(t.v / ms.m - 1) as es from t join mb on mb.outer_ = t.outer_ and mb.para = t.inner_ and mb.barrio = t.barrio join ms on ms.outer_ = t.outer_ and ms.para = t.inner_ and ms.barrio = t.barrio and ms.subzona = t.subzona)
  select outer_::int as vuelta, barrio, median(es) < median(eb) as usa_subzona from e group by 1, 2"""


@query(_ZONES)
def leak_free_zones(spark, sf):
    rows = with_unit(spark, sf).withColumn("vuelta", numeric.fold_of(F.col("unidad")))
    return model.zone_choice(rows, "precio_m2_usd", "vuelta", "barrio", "subzona", "unidad")


_XS = {"f_log_m2": "tamano", "f_ambientes": "ambientes", "f_banos": "banos", "f_banos_falta": "banos", "f_piso": "piso", "f_cochera": "cochera", "f_apto_credito": "credito"}


def _model_rows(spark, sf):
    rows = clean.features(clean.keep_one(with_unit(spark, sf), ["id_aviso"], [F.col("link")]))
    return rows.withColumns({"vuelta": numeric.fold_of(F.col("unidad")), "y": F.log("precio_m2_usd")})


@query(f""", d as (select *, row_number() over (partition by id_aviso order by link) as n from listings), x as (select {_FOLD.format(u=_UNIT)} as vuelta, ln(precio_m2_usd) as y, ln(m2_final) as a, least(coalesce(ambientes, dormitorios + 1), 6) as b from d where n = 1)
  select k.k::int as para, count(*) as n, round(sum(a), 4) as a, round(sum(b), 4) as b, round(sum(y), 4) as y, round(sum(a * a), 4) as aa, round(sum(a * b), 4) as ab, round(sum(a * y), 4) as ay, round(sum(b * y), 4) as by_ from x, range(5) k(k) where k.k <> vuelta group by 1""")
def gram_sums(spark, sf):
    rows = model.training_rows(_model_rows(spark, sf).select("vuelta", "y", F.col("f_log_m2").alias("a"), F.col("f_ambientes").alias("b")), "vuelta")
    g = model.gram(rows, "y", ["a", "b"], "para")
    names = {"a": "a", "b": "b", "y": "y", "a*a": "aa", "a*b": "ab", "a*y": "ay", "b*y": "by_"}
    return g.select("para", "n", *(F.round(F.col(f"`{k}`"), 4).alias(v) for k, v in names.items()))


@query()
def hedonic_ols(spark, sf):
    """Out-of-fold expected price, gap and interval flag by least squares with zone effects (LM6, LM12, LM19)."""
    from predial.plans.model_queries import FEATURES, model_rows

    rows = model_rows(spark, sf)
    out, _, _ = model.leak_free(rows, "y", FEATURES, "barrio", "subzona", "unidad", "vuelta")
    out = cluster.written(out.withColumn("residuo", F.col("y") - F.col("prediccion")).select("id_aviso", "barrio", "vuelta", "precio_m2_usd", "prediccion", "residuo"))
    limits = stats.conformal_limits(out, "residuo", "barrio", "vuelta")
    out = out.join(limits, ["vuelta", "barrio"], "left")
    return out.select("id_aviso", "vuelta", F.exp("prediccion").alias("precio_m2_esperado"), (F.col("precio_m2_usd") / F.exp("prediccion") - 1).alias("brecha"), truth(F.col("residuo") < F.col("limite_inf")).alias("bajo_intervalo"))


def hedonic_fit(spark, sf):
    """Rows, written once with the columns that the model reads, and each fold's coefficients and zone means."""
    rows = cluster.written(_model_rows(spark, sf).select("id_aviso", "barrio", "vuelta", "y", *_XS))
    return rows, *model.fit_within(rows, "y", list(_XS), "barrio", "vuelta")


@query()
def hedonic_explanation(spark, sf):
    """What each group of variables adds to each prediction (LM13)."""
    rows, betas, means = hedonic_fit(spark, sf)
    return model.explanation(rows, "id_aviso", "y", _XS, "barrio", "vuelta", betas, means)


@query()
def kmeans_subzones(spark, sf):
    """Subzones by k-means within each neighbourhood, over distinct coordinates."""
    points = listings(spark, sf).select("barrio", F.col("lon").alias("x"), F.col("lat").alias("y")).distinct().withColumn("punto", F.concat_ws("|", F.col("x").cast("string"), F.col("y").cast("string"), "barrio"))
    return cluster.group_kmeans(points, "barrio", "punto")


@query()
def mca_index(spark, sf):
    """An equipment index from yes/no answers."""
    rows = clean.keep_one(listings(spark, sf), ["id_aviso"], [F.col("link")])
    return cluster.correspondence_scores(rows, "id_aviso", ["apto_credito", "balcon", "pileta", "gimnasio", "parrilla", "ascensor"])


@query()
def embedding_segments(spark, sf):
    """K-means segments of embeddings (C4)."""
    (rows,) = tables(spark, sf, "embeddings")
    rows = rows.select("vec_id", "label", array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    fitted = KMeans(k=8, seed=42, maxIter=15).fit(rows)
    return fitted.transform(rows).select("vec_id", "label", F.col("prediction").alias("segmento"))


@query()
def nested_units(spark, sf):
    """One JSON document per unit with arrays and structs (SNK3, R7)."""
    rows = _listed["net_gap_rule"](spark, sf).join(_listed["dedup_by_id_priority"](spark, sf).filter("kept").select("id_aviso", "link"), "id_aviso")
    body = F.struct("id_aviso", text.url_base(F.col("link")).alias("url"), F.struct("costo_entrada", "costo_refaccion").alias("costos"), F.struct(F.col("nivel").alias("nombre"), F.col("estado_titulo").alias("estado")).alias("nivel_refaccion"), F.bround("brecha_neta", 2).alias("brecha_neta"))
    return rows.select("id_aviso", F.to_json(body, {"ignoreNullFields": "false"}).alias("documento"))


@query(f"""{_DEDUP} select id_aviso, link, barrio, row_number() over (order by precio_m2_usd, id_aviso) as posicion from d where n = 1 and {_REASON} is null order by precio_m2_usd, id_aviso limit 60""")
def cheapest_ranking(spark, sf):
    """The 60 cheapest listings by square metre with their place (SNK2, T2, T3, T5)."""
    rows = clean.deduplicate(listings(spark, sf), "id_aviso", F.col("barrio_oficial"), "link").filter("kept")
    rows = rows.filter(_reason().isNull())
    top = rows.select("id_aviso", "link", "barrio", "precio_m2_usd").orderBy("precio_m2_usd", "id_aviso").limit(60)
    return top.withColumn("posicion", F.row_number().over(Window.orderBy("precio_m2_usd", "id_aviso")).cast("long")).drop("precio_m2_usd")


@query(""", b as (select barrio, median(precio_m2_usd) as m from listings group by 1), t as (select barrio, arg_min(id_aviso, (abs(precio_m2_usd - m), id_aviso)) as id_aviso from listings join b using (barrio) group by 1) select * from t""")
def closest_to_median(spark, sf):
    """The listing nearest to each neighbourhood's median (T4)."""
    rows = listings(spark, sf).select("barrio", "id_aviso", "precio_m2_usd")
    middle = rows.groupBy("barrio").agg(F.median("precio_m2_usd").alias("m"))
    return rows.join(middle, "barrio").groupBy("barrio").agg(F.min_by("id_aviso", F.struct(F.abs(F.col("precio_m2_usd") - F.col("m")), "id_aviso")).alias("id_aviso"))


@query(""", a as (select distinct id_aviso from listings where precio_m2_usd < 1500), b as (select distinct id_aviso from listings where ambientes >= 4)
  select 'interseccion' as conjunto, count(*) as n from (select * from a intersect select * from b) union all select 'union', count(*) from (select * from a union select * from b) union all select 'solo_a', count(*) from (select * from a except select * from b)""")
def flag_sets(spark, sf):
    """Intersection, union and difference of flagged ids."""
    rows = listings(spark, sf)
    a, b = (rows.filter(c).select("id_aviso").distinct() for c in (F.col("precio_m2_usd") < 1500, F.col("ambientes") >= 4))
    named = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("conjunto"), "n")
    return named(a.intersect(b), "interseccion").unionByName(named(a.union(b).distinct(), "union")).unionByName(named(a.subtract(b), "solo_a"))


@query()
def model_comparison(spark, sf):
    """Zone median, least squares, ridge and boosted trees on the same folds (LM9, LM10, A18)."""
    xs = list(_XS)
    # Written once and narrow: sums, six passes for medians and the predictions read it.
    rows = cluster.written(_model_rows(spark, sf).filter("f_log_m2 is not null").select("id_aviso", "barrio", "vuelta", "y", "precio_m2_usd", *xs, "lat", "lon"))
    betas, means = model.fit_within(rows, "y", xs, "barrio", "vuelta")
    out = model.predict_within(rows, "y", xs, "barrio", "vuelta", betas, means).withColumnRenamed("prediccion", "lineal")
    out = model.zone_medians(out, "precio_m2_usd", "barrio", "vuelta").withColumn("mediana_zona", F.log("esperado"))
    # Written once: each fold of each learner reads these few columns again.
    out = cluster.written(out.select("vuelta", "y", *xs, "lineal", "mediana_zona", "lat", "lon"))
    out = cluster.written(learn.ridge(out, xs, "y", "vuelta").withColumnRenamed("prediccion_ridge", "ridge"))
    out = learn.boosted(out, [*xs, "lat", "lon", "mediana_zona"], "y", "vuelta", trees=20).withColumnRenamed("prediccion_gbm", "gbm")
    return learn.model_metrics(out, "y", ["mediana_zona", "lineal", "ridge", "gbm"])


@query()
def exit_probability(spark, sf):
    """Out-of-fold probability that a listing leaves, and its log loss (LM16, F27)."""
    first, second = _surveys(spark, sf, once=True)
    state = clean.snapshot_diff(first, second).select("id_aviso", (F.col("estado") == "salio").cast("double").alias("salio"))
    rows = first.join(state, "id_aviso").select("salio", numeric.fold_of(F.col("clave_unidad")).alias("vuelta"), F.log("precio_usd").alias("lp"))
    out = learn.logistic(cluster.written(rows), ["lp"], "salio", "vuelta")
    return out.groupBy("vuelta").agg(F.count("*").alias("n"), F.avg("salio").alias("tasa"), F.avg(numeric.log_loss(F.col("salio"), F.col("probabilidad"))).alias("perdida"))
