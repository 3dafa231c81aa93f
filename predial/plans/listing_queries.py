"""Queries over listings, each with the DuckDB SQL that must give the same rows."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from predial.functions import numeric, text
from predial.operators import clean, cluster, quality, rule, spatial, stats
from predial.operators.store import unwritten
from predial.sources.listings import LISTINGS_SQL, listings, tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name; sql follows the listings view."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = f"with {LISTINGS_SQL}{sql}"
        return f

    return add


def r6(x):
    return F.round(x, 6)


_SIZE = "case when m2_final between 15 and 1000 then m2_final when superficie_total between 15 and 1000 then superficie_total end"
_REASON = f"""case when moneda is distinct from 'USD' then 'precio_en_pesos' when en_construccion then 'en_pozo'
  when precio_usd < 20000 then 'precio_menor_a_minimo' when ({_SIZE}) is null then 'superficie_invalida'
  when precio_usd / ({_SIZE}) > 50000 then 'precio_imposible' when regexp_matches(lower(titulo), '^\\s*(?:compro|compramos)\\b') then 'no_es_venta' end"""


def _reason():
    size, _ = clean.surface_choice(F.col("m2_final"), F.col("superficie_total"))
    return clean.exclusion_reason(F.col("precio_usd"), F.col("moneda"), size, F.col("titulo"), F.col("en_construccion"))


@query(f" select coalesce({_REASON}, 'en_alcance') as motivo, count(*) as n from listings group by 1")
def scope_filter_reasons(spark, sf):
    return listings(spark, sf).groupBy(F.coalesce(_reason(), F.lit("en_alcance")).alias("motivo")).agg(F.count("*").alias("n"))


_DEDUP = """, d as (select *, row_number() over (partition by id_aviso order by case when barrio_oficial then 0 else 1 end, link) as n,
  max(barrio_oficial::int) over (partition by id_aviso) = 1 as any_ok, min(link) over (partition by id_aviso) as first_pos from listings)"""


@query(f"""{_DEDUP} select id_aviso, link, n = 1 as kept, first_pos,
  case when n > 1 then case when any_ok and not barrio_oficial then 'duplicado_barrio_no_oficial' else 'duplicado' end end as reason from d""")
def dedup_by_id_priority(spark, sf):
    rows = listings(spark, sf).select("id_aviso", "link", "barrio_oficial")
    return clean.deduplicate(rows, "id_aviso", F.col("barrio_oficial"), "link").select("id_aviso", "link", "kept", "first_pos", "reason")


@query(f"""{_DEDUP} select 'duplicado' as origen, motivo, count(*) as n from (select case when any_ok and not barrio_oficial then 'duplicado_barrio_no_oficial'
  else 'duplicado' end as motivo from d where n > 1) group by 2 union all
  select 'alcance', {_REASON}, count(*) from d where n = 1 and {_REASON} is not null group by 2""")
def audit_log_union(spark, sf):
    rows = clean.deduplicate(listings(spark, sf), "id_aviso", F.col("barrio_oficial"), "link")
    lost = rows.filter(~F.col("kept")).select(F.lit("duplicado").alias("origen"), F.col("reason").alias("motivo"))
    out = rows.filter("kept").select(F.lit("alcance").alias("origen"), _reason().alias("motivo")).filter("motivo is not null")
    return lost.unionByName(out).groupBy("origen", "motivo").agg(F.count("*").alias("n"))


@query(" select barrio, count(*) filter (where dup) as n from (select barrio, count(*) over (partition by dir_limpia, m2_final, ambientes) > 1 as dup from listings) group by 1")
def possible_duplicates(spark, sf):
    rows = listings(spark, sf).select("barrio", clean.duplicate_groups(None, ["dir_limpia", "m2_final", "ambientes"], "dir_limpia").alias("dup"))
    return rows.groupBy("barrio").agg(F.count_if("dup").alias("n"))


@query(" select barrio, round(avg(rel), 6) as media, round(min(rel), 6) as minimo, round(max(rel), 6) as maximo from (select barrio, ln(precio_m2_usd) - avg(ln(precio_m2_usd)) over (partition by barrio) as rel from listings) group by 1")
def relative_price(spark, sf):
    rel = F.log("precio_m2_usd") - F.avg(F.log("precio_m2_usd")).over(Window.partitionBy("barrio"))
    rows = listings(spark, sf).select("barrio", rel.alias("rel"))
    return rows.groupBy("barrio").agg((r6(F.avg("rel")) + 0.0).alias("media"), r6(F.min("rel")).alias("minimo"), r6(F.max("rel")).alias("maximo"))


_IQR = """, q as (select subzona, quantile_cont(precio_m2_usd, 0.25) as a, quantile_cont(precio_m2_usd, 0.75) as b, count(precio_m2_usd) as n
  from listings where subzona is not null group by 1),
  o as (select l.*, coalesce((precio_m2_usd < a - 1.5 * (b - a) or precio_m2_usd > b + 1.5 * (b - a)) and n >= 10, false) as atipico
  from listings l left join q on l.subzona = q.subzona)"""


@query(f"{_IQR} select barrio, count(*) filter (where atipico) as atipicos, count(*) as n from o group by 1")
def iqr_outliers(spark, sf):
    rows = stats.iqr_outliers(listings(spark, sf).select("barrio", "subzona", "precio_m2_usd"), "precio_m2_usd", "subzona")
    return rows.groupBy("barrio").agg(F.count_if("atipico").alias("atipicos"), F.count("*").alias("n"))


@query(""" select barrio, count(*) as n, round(avg(precio_m2_usd), 6) as media, round(median(precio_m2_usd), 6) as mediana, round(stddev_samp(precio_m2_usd), 4) as desvio,
  round(skewness(precio_m2_usd), 6) as asimetria, round(quantile_cont(precio_m2_usd, 0.05), 6) as p05, round(quantile_cont(precio_m2_usd, 0.25), 6) as p25,
  round(quantile_cont(precio_m2_usd, 0.75), 6) as p75, round(quantile_cont(precio_m2_usd, 0.95), 6) as p95 from listings group by 1""")
def numeric_summary(spark, sf):
    out = stats.numeric_summary(listings(spark, sf), "precio_m2_usd", "barrio")
    return out.select("barrio", "n", *(r6(c).alias(c) for c in ("media", "mediana")), F.round("desvio", 4).alias("desvio"), *(r6(c).alias(c) for c in ("asimetria", "p05", "p25", "p75", "p95")))


@query(""" select case when antiguedad > -1 and antiguedad <= 15 then '0-15' when antiguedad > 15 and antiguedad <= 40 then '16-40' when antiguedad > 40 and antiguedad <= 70 then '41-70' end as tramo,
  count(*) as n, round(quantile_cont(precio_m2_usd, 0.25), 6) as p25, round(median(precio_m2_usd), 6) as mediana, round(quantile_cont(precio_m2_usd, 0.75), 6) as p75
  from listings group by 1 having tramo is not null""")
def cut_band_medians(spark, sf):
    band = numeric.right_closed(F.col("antiguedad"), [-1, 15, 40, 70], ["0-15", "16-40", "41-70"])
    rows = listings(spark, sf).select(band.alias("tramo"), "precio_m2_usd").filter("tramo is not null")
    out = stats.with_quantiles(rows, ["tramo"], [F.count("*").alias("n")], {"_q": ("precio_m2_usd", [0.25, 0.5, 0.75])})
    return out.select("tramo", "n", *(r6(F.col("_q")[i]).alias(c) for i, c in enumerate(("p25", "mediana", "p75"))))


@query(""", e as (select quantile_cont(precio_m2_usd, [0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9]) as q from listings)
  select (1 + len(list_filter(q, lambda x: x < precio_m2_usd)))::int as decil, count(*) as n, round(min(precio_m2_usd), 6) as minimo, round(median(precio_m2_usd), 6) as mediana, round(max(precio_m2_usd), 6) as maximo
  from listings, e group by 1""")
def decile_table(spark, sf):
    rows = stats.quantile_bins(listings(spark, sf).select("precio_m2_usd"), "precio_m2_usd", 10, "decil")
    v = "precio_m2_usd"
    return rows.groupBy("decil").agg(F.count("*").alias("n"), r6(F.min(v)).alias("minimo"), r6(F.median(v)).alias("mediana"), r6(F.max(v)).alias("maximo"))


@query(""", g as (select subzona, median(precio_m2_usd) filter (where apto_credito = 'Sí') as con, median(precio_m2_usd) filter (where apto_credito = 'No') as sin,
  count(*) filter (where apto_credito = 'Sí') as n1, count(*) filter (where apto_credito = 'No') as n0 from listings where subzona is not null group by 1)
  select round(median((con / sin - 1) * 100), 6) as diferencia_pct, count(*) as grupos from g where n1 >= 3 and n0 >= 3""")
def within_group_contrast(spark, sf):
    rows = listings(spark, sf).filter(F.col("apto_credito").isNotNull())
    out = stats.within_group_contrast(rows, "precio_m2_usd", F.col("apto_credito") == "Sí", "subzona", 3)
    return out.select(r6("diferencia_pct").alias("diferencia_pct"), "grupos")


@query(""", u as (select dir_limpia || '|' || m2_final::bigint as unidad, median(precio_m2_usd) as v, count(distinct linenumber > 2) as n, min(linenumber > 2) as marca from listings group by 1)
  select marca, round(median(v), 6) as mediana, count(*) as unidades from u where n = 1 group by 1""")
def unit_contrast(spark, sf):
    rows = listings(spark, sf).withColumn("unidad", F.concat_ws("|", "dir_limpia", F.col("m2_final").cast("long").cast("string")))
    out = stats.unit_contrast(rows, "precio_m2_usd", F.col("linenumber") > 2, "unidad")
    return out.select("marca", r6("mediana").alias("mediana"), "unidades")


_GAP = f"""{_DEDUP}, s as (select * from d where n = 1 and {_REASON} is null),
  z as (select barrio, median(precio_m2_usd) as zona from s group by 1),
  p as (select s.* exclude (n, any_ok), zona, precio_m2_usd / zona - 1 as brecha from s join z using (barrio)),
  t as (select barrio, 1.5 * median(abs(brecha)) as own, count(*) as m from p group by 1),
  f as (select p.*, dir_limpia || '|' || m2_final::bigint as unidad, case when m >= 50 then own else (select 1.5 * median(abs(brecha)) from p) end as umbral from p join t using (barrio))"""


def in_scope(spark, sf):
    """Listings in scope, once each. The scope is judged before the rows are dealt, so that they go without what it reads."""
    rows = listings(spark, sf).withColumn("_in", _reason().isNull())
    return clean.deduplicate(rows, "id_aviso", F.col("barrio_oficial"), "link").filter("kept and _in").drop("_in")


def gaps(spark, sf, low=False, only: tuple[str, ...] | None = None):
    """Deduplicated listings in scope with their gap to the neighbourhood's median (low: first quartile) price and its
    threshold. They are written once: the quantiles and the result read them again. only: the columns that are wanted besides
    those of place, price, size and address; others are then neither dealt nor written."""
    rows = in_scope(spark, sf)
    rows = cluster.written(rows if only is None else rows.select(*dict.fromkeys(["barrio", "precio_m2_usd", "dir_limpia", "m2_final", *only])))
    zone = stats.group_quantiles(rows, "precio_m2_usd", ["barrio"], [0.25 if low else 0.5]).select("barrio", F.col("q")[0].alias("zona"))
    rows = rows.join(zone, "barrio").withColumn("brecha", F.col("precio_m2_usd") / F.col("zona") - 1)
    rows = stats.group_thresholds(rows, "brecha", "barrio", 1.5, 50)
    return rows.withColumn("unidad", F.concat_ws("|", "dir_limpia", F.col("m2_final").cast("long").cast("string")))


@query(f"{_GAP} select barrio, round(any_value(umbral), 6) as umbral, count(*) filter (where brecha < -umbral) as marcados, count(*) as n from f group by 1")
def barrio_thresholds(spark, sf):
    return gaps(spark, sf, only=()).groupBy("barrio").agg(r6(F.first("umbral")).alias("umbral"), F.count_if(F.col("brecha") < -F.col("umbral")).alias("marcados"), F.count("*").alias("n"))


_FUNNEL_SQL = f"""{_GAP}, c as (select *, brecha < -0.25 as s1, brecha < -0.25 and brecha < -umbral as s2, brecha < -0.25 and brecha < -umbral and ambientes >= 3 as s3 from f),
  k as (select 0 as paso, 'analizados' as filtro, count(*) as avisos, count(distinct unidad) as unidades from c
  union all select 1, 'marcado', count(*) filter (where s1), count(distinct unidad) filter (where s1) from c
  union all select 2, 'marcado_barrio', count(*) filter (where s2), count(distinct unidad) filter (where s2) from c
  union all select 3, 'candidato', count(*) filter (where s3), count(distinct unidad) filter (where s3) from c)
  select paso, filtro, avisos, unidades, round(100.0::double * avisos / nullif(lag(avisos) over (order by paso), 0), 6) as avisos_pct,
  round(100.0::double * unidades / nullif(lag(unidades) over (order by paso), 0), 6) as unidades_pct from k"""


@query(_FUNNEL_SQL)
def funnel(spark, sf):
    steps = [("analizados", F.lit(True)), ("marcado", F.col("brecha") < -0.25), ("marcado_barrio", F.col("brecha") < -F.col("umbral")), ("candidato", F.col("ambientes") >= 3)]
    out = stats.funnel(gaps(spark, sf, only=("ambientes",)), steps, "unidad")
    return out.select("paso", "filtro", "avisos", "unidades", r6("avisos_pct").alias("avisos_pct"), r6("unidades_pct").alias("unidades_pct"))


@query(f"""{_GAP} , r as (select *, (case when brecha < -0.25 then 1 else 0 end + case when brecha < -umbral then 1 else 0 end) as paso from f)
  select unidad, arg_min(id_aviso, (-paso, precio_usd, brecha, id_aviso)) as representante, count(*) as avisos, round(min(brecha), 6) as brecha_min, round(max(brecha), 6) as brecha_max,
  bool_or(brecha < -0.25) as marcado, count(distinct paso) > 1 as discordante from r group by 1""")
def unit_representative(spark, sf):
    step = (F.col("brecha") < -0.25).cast("int") + (F.col("brecha") < -F.col("umbral")).cast("int")
    out = stats.roll_up(gaps(spark, sf, only=("precio_usd", "id_aviso")).withColumn("paso", step), "unidad", "paso", "precio_usd", "brecha", "id_aviso", {"marcado": F.col("brecha") < -0.25})
    return out.withColumns({"brecha_min": r6("brecha_min"), "brecha_max": r6("brecha_max")})


_SURVEYS = """, b as (select 'A' || partkey || '-' || (orderkey // 4 % 50) as id_aviso, orderkey % 2 as r, dir_limpia || '|' || m2_final::bigint as clave_unidad, precio_usd, link from listings),
  u as (select * from (select *, row_number() over (partition by r, id_aviso order by link) as n from b) where n = 1),
  r1 as (select * from u where r = 1), r2 as (select * from u where r = 0),
  again as (select clave_unidad, min(precio_usd) as p from r2 where id_aviso not in (select id_aviso from r1) group by 1),
  j as (select r1.id_aviso, r1.clave_unidad, r1.precio_usd, r2.precio_usd as same, again.p as again from r1 left join r2 using (id_aviso) left join again on r1.clave_unidad = again.clave_unidad)"""


def surveys(spark, sf, once: bool = False, rooms: bool = False):
    """Two snapshots of listings, by odd and even order keys; once: written, for queries that read them several times; rooms: with
    ambientes."""
    rows = listings(spark, sf).select(
        F.concat(F.lit("A"), F.col("partkey").cast("string"), F.lit("-"), (F.floor(F.col("orderkey") / 4) % 50).cast("string")).alias("id_aviso"),
        (F.col("orderkey") % 2).alias("r"), F.concat_ws("|", "dir_limpia", F.col("m2_final").cast("long").cast("string")).alias("clave_unidad"), "precio_usd", "link",
        *([F.coalesce("ambientes", F.col("dormitorios") + 1).alias("ambientes")] if rooms else []),
    )
    rows = clean.keep_one(rows, ["r", "id_aviso"], [F.col("link")]).drop("link")
    rows = cluster.written(rows) if once else rows
    return tuple(rows.filter(F.col("r") == r).drop("r") for r in (1, 0))


@query(f"""{_SURVEYS} select case when same is not null then 'sigue' when again is not null then 'republicado' else 'salio' end as estado, count(*) as n,
  count(*) filter (where coalesce(same, again) / precio_usd - 1 < -0.005) as bajaron, count(*) filter (where coalesce(same, again) / precio_usd - 1 > 0.005) as subieron,
  round(median(coalesce(same, again) / precio_usd - 1), 6) as cambio_mediano from j group by 1""")
def snapshot_diff(spark, sf):
    out = clean.snapshot_diff(*surveys(spark, sf))
    return out.groupBy("estado").agg(F.count("*").alias("n"), F.count_if("bajo_en_r2").alias("bajaron"), F.count_if("subio_en_r2").alias("subieron"), r6(F.median("cambio_precio")).alias("cambio_mediano"))


@query(f"""{_SURVEYS}, a as (select clave_unidad, count(*) as n1 from r1 group by 1), c as (select clave_unidad, count(*) as n2 from r2 group by 1)
  select greatest(coalesce(n1, 0), coalesce(n2, 0)) as maximo, count(*) as unidades from a full join c using (clave_unidad) group by 1""")
def survey_counts_outer(spark, sf):
    first, second = (s.groupBy("clave_unidad").agg(F.count("*").alias(n)) for s, n in zip(surveys(spark, sf), ("n1", "n2"), strict=True))
    most = F.greatest(F.coalesce("n1", F.lit(0)), F.coalesce("n2", F.lit(0)))
    return first.join(second, "clave_unidad", "full_outer").groupBy(most.alias("maximo")).agg(F.count("*").alias("unidades"))


_COMPARE = f"""{_GAP}, lim as (select barrio, quantile_cont(precio_m2_usd, 0.25) as a, quantile_cont(precio_m2_usd, 0.75) as b from f group by 1),
  c as (select f.* from f join lim using (barrio) where antiguedad is not null and precio_m2_usd between a - 1.5 * (b - a) and b + 1.5 * (b - a)), q as (select * from f where brecha < -umbral)
  select q.id_aviso, count(o.id_aviso) as comparables, round(median(o.precio_m2_usd), 9) as mediana from q left join c o on o.barrio = q.barrio and o.unidad <> q.unidad
  and abs(o.ambientes - q.ambientes) <= 1 and abs(o.m2_final / q.m2_final - 1) <= 0.30 and abs(o.antiguedad - q.antiguedad) <= 15 group by 1"""


#: What makes rows comparable, besides being of another unit.
_TRAITS = ["barrio", "ambientes", "m2_final", "antiguedad"]
#: A neighbourhood's prices are cut into so many buckets, and each of them into as many again.
_BUCKETS = 32


def _alike(q: str, o: str):
    """Whether a row o is like a row q of its neighbourhood: rooms differ by at most one, sizes by 30 %, ages by 15 years."""
    of = lambda side, c: F.col(f"{side}{c}")
    rooms = reduce(lambda a, b: a | b, (of(o, "ambientes") == of(q, "ambientes") + d for d in (-1.0, 0.0, 1.0)))
    return rooms & (F.abs(of(o, "m2_final") / of(q, "m2_final") - 1) <= 0.30) & (F.abs(of(o, "antiguedad") - of(q, "antiguedad")) <= 15)


def _alike_kinds(kinds: DataFrame) -> DataFrame:
    """(_p, _k): for each kind of row that is asked for, the kinds of given rows that are like it. It looks into three rooms' and
    three sizes' groups, so that the join has three equal keys."""
    kinds = kinds.withColumn("_s", F.floor(F.log("m2_final") / math.log(1 / 0.7)))
    given = kinds.filter("n > 0").select(F.col("_id").alias("_k"), *(F.col(c).alias(f"o_{c}") for c in _TRAITS), F.col("_s").alias("o_s"))
    around = lambda *x: F.explode(F.array(*map(F.lit, x)))
    q = kinds.filter("asked").select(F.col("_id").alias("_p"), *(F.col(c).alias(f"q_{c}") for c in _TRAITS), "_s", around(-1.0, 0.0, 1.0).alias("_d")).withColumn("_t", around(-1, 0, 1))
    same = (F.col("o_barrio") == F.col("q_barrio")) & (F.col("o_ambientes") == F.col("q_ambientes") + F.col("_d")) & (F.col("o_s") == F.col("_s") + F.col("_t"))
    return q.join(given, same & _alike("q_", "o_")).select("_p", "_k")


def comparables(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """(id_aviso, comparables, mediana) for each of asked, whose ids are unique: how many rows are like it, of another unit, and their
    median price (J12, A21); 0 and null for none, also where its rooms or age are unknown.

    Pairs of rows are never formed. Rows of equal traits are one kind; kinds are paired, and numbers of rows by kind and price bucket
    are added up over the pairs, first for coarse buckets, then for fine ones of those that hold the middle; rows are only read
    for the fine bucket that is left. The asked unit's own rows are counted off at the end, as they shift the rank.
    """
    known = reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in [*_TRAITS, "unidad"]))
    given = rows.filter(known).select(*_TRAITS, "unidad", F.col("precio_m2_usd").alias("_v"))
    asked = asked.select("id_aviso", "unidad", *_TRAITS)
    both = given.select(*_TRAITS, F.lit(1).alias("_n"), F.col("_v").isNotNull().cast("int").alias("_nv"), F.lit(False).alias("_q"))
    both = both.unionByName(asked.filter(known).select(*_TRAITS, F.lit(0).alias("_n"), F.lit(0).alias("_nv"), F.lit(True).alias("_q")))
    kinds = both.groupBy(*_TRAITS).agg(F.sum("_n").alias("n"), F.sum("_nv").alias("nv"), F.bool_or("_q").alias("asked"))
    kinds = cluster.written(kinds.withColumn("_id", F.monotonically_increasing_id()))
    pairs = cluster.written(_alike_kinds(kinds))
    sizes = pairs.join(kinds.select(F.col("_id").alias("_k"), "n", "nv"), "_k").groupBy("_p").agg(F.sum("n").alias("n"), F.sum("nv").alias("nv"))

    # Questions: a kind and the unit that is left out. The ranks that they want, among all rows like them, lie from _low to _high.
    questions = asked.join(kinds.select(*_TRAITS, F.col("_id").alias("_p")), _TRAITS).filter("unidad is not null").select("_p", "unidad", *_TRAITS).distinct()
    named = lambda df, side: df.select(*(F.col(c).alias(c if c in ("_p", "_v", "unidad", "barrio") else side + c) for c in df.columns))
    own = named(questions, "q_").join(named(given, "o_"), ["barrio", "unidad"]).filter(_alike("q_", "o_")).select("_p", "unidad", "_v")
    own = cluster.written(own)
    left = own.groupBy("_p", "unidad").agg(F.count("*").alias("_own"), F.count("_v").alias("_mine"))
    questions = questions.select("_p", "unidad").join(sizes, "_p").join(left, ["_p", "unidad"], "left").fillna(0, ["_own", "_mine"])
    middle = (F.col("nv") - F.col("_mine") - 1) / 2
    questions = questions.withColumns({"_low": F.floor(middle), "_high": F.ceil(middle)})
    questions = cluster.written(questions.select("_p", "unidad", (F.col("n") - F.col("_own")).alias("comparables"), (F.col("nv") - F.col("_mine")).alias("_nv"), "_mine", "_low", "_high"))
    ranges = cluster.written(questions.filter("_nv > 0").groupBy("_p").agg(F.min("_low").alias("_from"), F.max(F.col("_high") + F.col("_mine")).alias("_to")))

    many = _BUCKETS * _BUCKETS
    edges = cluster.written(given.groupBy("barrio").agg(F.percentile_approx("_v", F.array(*(F.lit(i / many) for i in range(1, many))), F.lit(10 * many)).alias("_e")))
    over = lambda at: reduce(lambda a, b: a + b, ((F.col("_v") > F.col("_e")[at(i)]).cast("int") for i in range(1, _BUCKETS)))
    placed = given.filter("_v is not null").join(edges, "barrio").join(kinds.select(*_TRAITS, F.col("_id").alias("_k")), _TRAITS)
    placed = placed.withColumn("_b", over(lambda i: i * _BUCKETS - 1)).withColumn("_f", over(lambda i: F.col("_b") * _BUCKETS + (i - 1)))
    placed = cluster.written(placed.select("_k", "_b", "_f", "_v"))

    def holding(counts: DataFrame, by: list[str], start) -> DataFrame:
        """Buckets _i of counts (by, _c0, ...), which begin at the rank start, that hold a rank of their kind's range."""
        before = [start]
        for i in range(_BUCKETS):
            before.append(before[-1] + F.col(f"_c{i}"))
        cells = F.array(*(F.struct(F.lit(i).alias("_i"), before[i].alias("_start"), F.col(f"_c{i}").alias("_c")) for i in range(_BUCKETS)))
        found = counts.join(ranges, "_p").select(*by, "_from", "_to", F.explode(cells).alias("_x")).select(*by, "_from", "_to", "_x.*")
        return found.filter("_c > 0 and _start <= _to and _start + _c > _from").select(*by, "_i", "_start")

    counted = lambda c: [F.count_if(F.col(c) == i).alias(f"_c{i}") for i in range(_BUCKETS)]
    added = [F.sum(f"_c{i}").alias(f"_c{i}") for i in range(_BUCKETS)]
    coarse = pairs.join(placed.groupBy("_k").agg(*counted("_b")), "_k").groupBy("_p").agg(*added)
    coarse = cluster.written(holding(coarse, ["_p"], F.lit(0).cast("long")).withColumnRenamed("_i", "_b"))
    wanted = pairs.join(coarse, "_p")
    inside = placed.join(wanted.select("_k", "_b").distinct(), ["_k", "_b"], "left_semi").groupBy("_k", "_b").agg(*counted("_f"))
    fine = wanted.join(inside, ["_k", "_b"]).groupBy("_p", "_b").agg(*added, F.min("_start").alias("_at"))
    fine = cluster.written(holding(fine, ["_p", "_b"], F.col("_at")).withColumnRenamed("_i", "_f"))
    values = pairs.join(fine, "_p").join(placed, ["_k", "_b", "_f"]).groupBy("_p", "_b", "_f", "_v").agg(F.count("*").alias("_c"), F.min("_start").alias("_start"))
    upto = F.col("_start") + F.sum("_c").over(Window.partitionBy("_p", "_b", "_f").orderBy("_v"))
    values = values.withColumn("_upto", upto).select("_p", "_v", "_c", "_upto")

    # Each question's values around its middle, and its own rows, which count off.
    near = questions.filter("_nv > 0").join(values, "_p").filter("_upto > _low and _upto - _c <= _high + _mine")
    near = near.select("_p", "unidad", "_v", "_c", (F.col("_upto") - F.col("_c")).alias("_before"))
    off = own.filter("_v is not null").select("_p", "unidad", "_v", F.lit(-1).cast("long").alias("_c"), F.lit(None).cast("long").alias("_before"))
    whole = Window.partitionBy("_p", "unidad")
    rest = near.unionByName(off).withColumn("_upto", F.min("_before").over(whole) + F.sum("_c").over(whole.orderBy("_v")))
    rest = rest.join(questions.select("_p", "unidad", "_low", "_high"), ["_p", "unidad"])
    at = lambda rank: F.min(F.when((F.col("_c") > 0) & (F.col("_upto") > F.col(rank)), F.col("_v")))
    medians = rest.groupBy("_p", "unidad").agg(((at("_low") + at("_high")) / 2).alias("mediana"))
    answers = questions.select("_p", "unidad", "comparables").join(medians, ["_p", "unidad"], "left").join(kinds.select(*_TRAITS, F.col("_id").alias("_p")), "_p").drop("_p")
    out = cluster.written(asked.join(answers, [*_TRAITS, "unidad"], "left").select("id_aviso", F.coalesce("comparables", F.lit(0).cast("long")).alias("comparables"), "mediana"))
    unwritten(kinds, pairs, own, questions, ranges, edges, placed, coarse, fine)
    return out


@query(_COMPARE)
def comparables_band_join(spark, sf):
    """Comparables of every ad that is flagged."""
    rows = gaps(spark, sf, only=("id_aviso", "ambientes", "antiguedad"))
    given = stats.iqr_outliers(rows.filter("antiguedad is not null"), "precio_m2_usd", "barrio", limits_of=rows).filter(~F.col("atipico"))
    return comparables(given, rows.filter(F.col("brecha") < -F.col("umbral"))).withColumn("mediana", F.round("mediana", 9))


_HAV = "2 * 6371000.0 * asin(sqrt(least(1.0, pow(sin(radians({b}.lat - {a}.lat) / 2), 2) + cos(radians({a}.lat)) * cos(radians({b}.lat)) * pow(sin(radians({b}.lon - {a}.lon) / 2), 2))))"
_PLACES = """, pts as (select distinct lat, lon from listings),
  est as (select distinct -34.695::double + 0.011::double * (s_suppkey % 13) as lat, -58.515::double + 0.013::double * (s_suppkey % 17) as lon from supplier)"""


def stations(spark, sf):
    (supplier,) = tables(spark, sf, "supplier")
    return supplier.select((F.lit(-34.695) + 0.011 * (F.col("s_suppkey") % 13)).alias("lat"), (F.lit(-58.515) + 0.013 * (F.col("s_suppkey") % 17)).alias("lon")).distinct()


@query(f"{_PLACES} select round(pts.lat, 6) as lat, round(pts.lon, 6) as lon, round(min({_HAV.format(a='pts', b='est')}), 3) as dist_m from pts, est group by pts.lat, pts.lon")
def nearest_station(spark, sf):
    out = spatial.nearest(spatial.distinct_points(listings(spark, sf)), stations(spark, sf), "dist_m")
    return out.select(r6("lat").alias("lat"), r6("lon").alias("lon"), F.round("dist_m", 3).alias("dist_m"))


@query(f"{_PLACES} select round(pts.lat, 6) as lat, round(pts.lon, 6) as lon, count(est.lat) as n from pts left join est on {_HAV.format(a='pts', b='est')} < 900 group by pts.lat, pts.lon")
def radius_count(spark, sf):
    out = spatial.radius_count(spatial.distinct_points(listings(spark, sf)), stations(spark, sf), 900.0, "n")
    return out.select(r6("lat").alias("lat"), r6("lon").alias("lon"), "n")


_SQUARES = """, pts as (select distinct 100.0::double * (suppkey % 37) + 7 as x, 100.0::double * (partkey % 41) + 3 as y from listings),
  sq as (select n_nationkey as poly_id, 700.0::double * (n_nationkey % 5) as xa, 850.0::double * (n_nationkey // 5) as ya, 760.0::double as w from nation)"""


def squares(spark, sf):
    """Edges of overlapping squares, one for each nation, and points on a plane."""
    (nation,) = tables(spark, sf, "nation")
    box = nation.select(F.col("n_nationkey").alias("poly_id"), (700.0 * (F.col("n_nationkey") % 5)).alias("xa"), (850.0 * F.floor(F.col("n_nationkey") / 5)).alias("ya"), F.lit(760.0).alias("w"))
    corner = lambda i, j: (F.col("xa") + i * F.col("w"), F.col("ya") + j * F.col("w"))
    ring = [(0, 0), (1, 0), (1, 1), (0, 1), (0, 0)]
    edges = F.array(*(F.struct(*(v.alias(n) for n, v in zip(("x1", "y1", "x2", "y2"), (*corner(*a), *corner(*b)), strict=True))) for a, b in zip(ring[:-1], ring[1:], strict=True)))
    points = listings(spark, sf).select((100.0 * (F.col("suppkey") % 37) + 7).alias("x"), (100.0 * (F.col("partkey") % 41) + 3).alias("y")).distinct()
    return points, box.select("poly_id", F.explode(edges).alias("e")).select("poly_id", "e.*")


@query(f"""{_SQUARES} select x, y, arg_min(poly_id, (-poly_id, poly_id)) as poly_id, count(poly_id) as n_poligonos from pts left join sq on x >= xa and x < xa + w and y >= ya and y < ya + w group by 1, 2""")
def point_in_polygon(spark, sf):
    points, edges = squares(spark, sf)
    priority = edges.select("poly_id").distinct().withColumn("orden", -F.col("poly_id"))
    return spatial.assign_polygon(points, edges, priority, 500.0).select("x", "y", "poly_id", "n_poligonos")


@query(f"""{_SQUARES} select x, y, round(min(sqrt(pow(greatest(xa - x, x - xa - w, 0), 2) + pow(greatest(ya - y, y - ya - w, 0), 2))), 6) as dist from pts, sq group by 1, 2""")
def dist_polygon(spark, sf):
    points, edges = squares(spark, sf)
    return spatial.polygon_distance(points, edges, 500.0, "dist").select("x", "y", r6("dist").alias("dist"))


@query(f"{_SQUARES} select poly_id % 5 as clase, sum(w * w) as area, count(*) as n from sq group by 1")
def polygon_areas(spark, sf):
    _, edges = squares(spark, sf)
    per = spatial.polygon_areas(edges, "poly_id")
    return per.groupBy((F.col("poly_id") % 5).alias("clase")).agg(F.sum("area").alias("area"), F.count("*").alias("n"))


@query(f"""{_SQUARES}, g as (select distinct 40.0::double * (i + 0.5) as gx, 40.0::double * (j + 0.5) as gy from sq, range(0, 110) a(i), range(0, 110) b(j)
  where 40 * (i + 0.5) >= xa and 40 * (i + 0.5) < xa + w and 40 * (j + 0.5) >= ya and 40 * (j + 0.5) < ya + w)
  select x, y, round(count(gx) * 1600 / 10000.0::double, 6) as ha from pts left join g on pow(x - gx, 2) + pow(y - gy, 2) <= 250000 group by 1, 2""")
def covered_area(spark, sf):
    points, edges = squares(spark, sf)
    return spatial.covered_area(points, edges, 500.0, 40.0, "ha").select("x", "y", r6("ha").alias("ha"))


_FOLD = "(('0x' || substr(md5({u}), 1, 8))::ubigint % 5)::int"
_UNIT = "dir_limpia || '|' || m2_final::bigint"


def with_unit(spark, sf):
    return listings(spark, sf).withColumn("unidad", F.concat_ws("|", "dir_limpia", F.col("m2_final").cast("long").cast("string")))


_OOF = f""", u as (select *, {_FOLD.format(u=_UNIT)} as vuelta from listings),
  m as (select k.k as vuelta, barrio, median(precio_m2_usd) as m, count(*) as n from u, range(5) k(k) where k.k <> vuelta group by 1, 2),
  e as (select u.barrio, u.vuelta, abs(precio_m2_usd / m.m - 1) as error, ln(precio_m2_usd) - ln(m.m) as residuo from u left join m on m.vuelta = u.vuelta and m.barrio = u.barrio and m.n >= 10)"""


@query(f"{_OOF} select barrio, vuelta, round(median(error), 6) as error, count(error) as n from e group by 1, 2")
def oof_group_error(spark, sf):
    out = stats.out_of_fold_group_error(with_unit(spark, sf), "precio_m2_usd", "barrio", "unidad")
    out = stats.with_quantiles(out.select("barrio", "vuelta", "error"), ["barrio", "vuelta"], [F.count("error").alias("n")], {"_q": ("error", [0.5])})
    return out.select("barrio", "vuelta", r6(F.col("_q")[0]).alias("error"), "n")


@query(f"""{_OOF}, o as (select k.k as vuelta, barrio, quantile_cont(residuo, 0.1) as a, quantile_cont(residuo, 0.9) as b, count(*) as n from e, range(5) k(k) where k.k <> vuelta and residuo is not null group by 1, 2),
  c as (select k.k as vuelta, quantile_cont(residuo, 0.1) as a, quantile_cont(residuo, 0.9) as b from e, range(5) k(k) where k.k <> vuelta and residuo is not null group by 1)
  select o.vuelta::int as vuelta, barrio, round(case when n >= 1500 then o.a else c.a end, 6) as limite_inf, round(case when n >= 1500 then o.b else c.b end, 6) as limite_sup from o join c on o.vuelta = c.vuelta""")
def conformal_limits(spark, sf):
    from predial.operators.model import zone_medians

    # Rows and residuals are read six times each.
    rows = cluster.written(with_unit(spark, sf).select("barrio", "precio_m2_usd", numeric.fold_of(F.col("unidad")).alias("vuelta")))
    rows = zone_medians(rows, "precio_m2_usd", "barrio", "vuelta")
    rows = cluster.written(rows.select("barrio", "vuelta", (F.log("precio_m2_usd") - F.log("esperado")).alias("residuo")))
    out = stats.conformal_limits(rows, "residuo", "barrio", "vuelta", least=1500)
    return out.select("vuelta", "barrio", r6("limite_inf").alias("limite_inf"), r6("limite_sup").alias("limite_sup"))


_STATE = "case " + " ".join(f"when regexp_matches(lower(titulo), '{pattern}') then '{name}'" for name, pattern in text.STATES) + " else 'sin_marca' end"
#: The second library has no look-behind: what the first one finds by it is "ocupad" not within "desocupad".
_RISK = {name: f"regexp_matches(lower(titulo), '{pattern}')" if "(?<" not in pattern else "regexp_matches(replace(lower(titulo), 'desocupad', ''), 'ocupad')" for name, pattern, _ in text.RISKS}
_DISCARD = "(" + " or ".join(_RISK[name] for name, _, discards in text.RISKS if discards) + ")"


def _rule_sql(names: list[str]) -> str:
    """The rule in SQL for some scenarios, from the same parameters."""
    rows = []
    for s in rule.SCENARIOS:
        if s.name in names:
            for state, levels in rule.LEVELS.items():
                numbers = ", ".join(f"{getattr(s, f)}::double as {f}" for f in list(rule.Scenario.__dataclass_fields__)[1:-1])
                rows.append(f"select '{s.name}' as name, {numbers}, '{state}' as estado_titulo, '{levels[s.variant]}' as nivel")
    stamp = f"{{p}} * case when {{p}} <= {rule.STAMP_LIMIT} then {rule.STAMP_LOW} else {rule.STAMP_HIGH} end"
    return f""", esc as ({" union all ".join(rows)}),
  x as (select f.*, zona as esperado, {_STATE} as estado_titulo from f),
  y as (select x.*, esc.* exclude (estado_titulo), greatest(notary * precio_usd, {rule.NOTARY_LEAST}) + buyer_stamp * ({stamp.format(p='precio_usd')}) + (buyer_fee + other_entry) * precio_usd as costo_entrada,
    case nivel when 'liviana' then light * m2_final when 'media' then light * m2_final + {rule.KITCHEN_BATH} when 'integral' then integral * m2_final else 0 end as costo_refaccion,
    esperado * m2_final * case when nivel in ('media', 'integral') then exp(0.1) else 1 end * (1 - negotiation) as venta from x join esc on x.estado_titulo = esc.estado_titulo),
  w as (select *, venta - (venta * (seller_fee + certificates) + seller_stamp * ({stamp.format(p='venta')})) - (precio_usd + costo_entrada + costo_refaccion) as ganancia from y),
  v as (select *, (ganancia - income_tax * greatest(ganancia, 0)) / (precio_usd + costo_entrada + costo_refaccion) as brecha_neta from w)"""


def ruled(spark, sf, which=None, low=False):
    rows = gaps(spark, sf, low).withColumn("estado_titulo", text.first_rule(F.col("titulo"), text.STATES, "sin_marca"))
    rows = rows.join(F.broadcast(rule.scenarios(spark, which)), "estado_titulo")  # scenarios x states rows
    return rule.net_gap(rows, "zona", F.lit(-0.1))


@query(f"{_GAP}{_rule_sql(['base'])} select id_aviso, estado_titulo, nivel, round(costo_entrada, 6) as costo_entrada, round(costo_refaccion, 6) as costo_refaccion, round(brecha_neta, 6) as brecha_neta from v")
def net_gap_rule(spark, sf):
    out = ruled(spark, sf, [rule.BASE])
    return out.select("id_aviso", "estado_titulo", "nivel", r6("costo_entrada").alias("costo_entrada"), r6("costo_refaccion").alias("costo_refaccion"), r6("brecha_neta").alias("brecha_neta"))


@query(f"{_GAP}{_rule_sql([s.name for s in rule.SCENARIOS])} select name as escenario, count(distinct unidad) filter (where brecha_neta >= 0.10) as unidades, count(*) as avisos from v group by 1")
def sensitivity_grid(spark, sf):
    return ruled(spark, sf).groupBy(F.col("name").alias("escenario")).agg(F.count_distinct(F.when(F.col("brecha_neta") >= 0.10, F.col("unidad"))).alias("unidades"), F.count("*").alias("avisos"))


@query(f"""{_GAP}{_rule_sql(['base'])}, l as (select *, brecha < -0.25 as regla, round(brecha_neta, 9) >= 0.10 as pasa, {_DISCARD} as riesgo from v)
  select case when regla and pasa and not riesgo then 'candidato' when regla then 'senal' else '' end as nivel_decision,
  case when regla and riesgo then 'riesgo legal' when regla and not pasa then 'brecha neta ' || round_even(round(100 * brecha_neta, 7), 0)::int || '% < 10%' end as motivo, count(*) as n from l group by 1, 2""")
def decision_levels(spark, sf):
    rows = ruled(spark, sf, [rule.BASE])
    discard = reduce(lambda a, b: a | b, (text.risk_flags(F.col("titulo"))[f"riesgo_{name}"] for name, _, d in text.RISKS if d))
    found, reason = rule.level(F.col("brecha") < -0.25, F.round("brecha_neta", 9), discard)
    return rows.groupBy(found.alias("nivel_decision"), reason.alias("motivo")).agg(F.count("*").alias("n"))


@query(""" select barrio, coalesce(ambientes::bigint, -1) as ambientes, count(*) as n from listings group by rollup(barrio, ambientes::bigint)""".replace("coalesce(ambientes::bigint, -1)", "case when grouping(ambientes::bigint) = 1 then -1 else ambientes::bigint end").replace("select barrio,", "select case when grouping(barrio) = 1 then 'total' else barrio end as barrio,"))
def crosstab_margins(spark, sf):
    rows = listings(spark, sf).select("barrio", F.col("ambientes").cast("long").alias("a"))
    out = rows.rollup("barrio", "a").agg(F.count("*").alias("n"), F.grouping("barrio").alias("gb"), F.grouping("a").alias("ga"))
    return out.select(F.when(F.col("gb") == 1, "total").otherwise(F.col("barrio")).alias("barrio"), F.when(F.col("ga") == 1, -1).otherwise(F.col("a")).alias("ambientes"), "n")


@query(""" select barrio, round(median(precio_m2_usd) filter (where ambientes <= 2), 6) as chico, round(median(precio_m2_usd) filter (where ambientes in (3, 4)), 6) as medio, round(median(precio_m2_usd) filter (where ambientes > 4), 6) as grande from listings group by 1""")
def pivot_medians(spark, sf):
    size = F.when(F.col("ambientes") <= 2, "chico").when(F.col("ambientes") <= 4, "medio").otherwise("grande")
    return listings(spark, sf).withColumn("t", size).groupBy("barrio").pivot("t", ["chico", "medio", "grande"]).agg(r6(F.median("precio_m2_usd")))


_QC = """ select 'filas' as metrica, count(*)::double as valor from listings union all select 'duplicados', (count(*) - count(distinct id_aviso))::double from listings
  union all select 'nulos_banos', count(*) filter (where banos is null)::double from listings union all select 'nulos_piso', count(*) filter (where piso is null)::double from listings
  union all select 'nulos_subzona', count(*) filter (where subzona is null)::double from listings
  union all select 'tasa_ok', round_even(100 * avg(barrio_oficial::int::double), 2) from listings"""


@query(_QC)
def qc_report(spark, sf):
    return quality.report(listings(spark, sf), "id_aviso", ["banos", "piso", "subzona"], F.col("barrio_oficial"))


@query(""", c as (select count(*) filter (where not (precio_usd > 0)) as a, count(*) filter (where not coalesce(dormitorios < ambientes, false)) as b, count(*) filter (where link not like 'https://%') as c from listings)
  select 'precio_positivo' as control, a = 0 as ok, a as fallas from c union all select 'dormitorios_menos', b = 0, b from c union all select 'link_https', c = 0, c from c""")
def verify_table(spark, sf):
    return quality.checks(listings(spark, sf), {"precio_positivo": F.col("precio_usd") > 0, "dormitorios_menos": F.col("dormitorios") < F.col("ambientes"), "link_https": F.col("link").startswith("https://")})


@query(""", a as (select id_aviso, precio_usd, ambientes from (select *, row_number() over (partition by id_aviso order by link) as n from listings) where n = 1),
  b as (select id_aviso, case when precio_usd > 50000 then precio_usd + 1 else precio_usd end as precio_usd, ambientes from a where right(id_aviso, 1) <> '7')
  select 'precio_usd' as columna, count(*) filter (where b.id_aviso is null or a.precio_usd is distinct from b.precio_usd) as diferencias from a full join b on a.id_aviso = b.id_aviso
  union all select 'ambientes', count(*) filter (where b.id_aviso is null or a.ambientes is distinct from b.ambientes) from a full join b on a.id_aviso = b.id_aviso""")
def table_differences(spark, sf):
    a = clean.keep_one(listings(spark, sf), ["id_aviso"], [F.col("link")]).select("id_aviso", "precio_usd", "ambientes")
    b = a.filter(F.substring("id_aviso", -1, 1) != "7").withColumn("precio_usd", F.when(F.col("precio_usd") > 50000, F.col("precio_usd") + 1).otherwise(F.col("precio_usd")))
    return quality.compare(a, b, "id_aviso")


#: Twice the upper tail of the normal, by the same approximation as numeric.normal_cdf().
_TWO_SIDED = """2 * exp(-z * z / 2) / sqrt(2 * pi()) * (1 / (1 + 0.2316419 * abs(z))) * (0.319381530 + (1 / (1 + 0.2316419 * abs(z))) * (-0.356563782
  + (1 / (1 + 0.2316419 * abs(z))) * (1.781477937 + (1 / (1 + 0.2316419 * abs(z))) * (-1.821255978 + (1 / (1 + 0.2316419 * abs(z))) * 1.330274429))))"""


#: The chi-square tail with k - 1 >= 4 degrees of freedom, by Simpson's rule over its density.
_CHI2_ABOVE = """1 - (select sum(case when i in (0, 4000) then 1 when i % 2 = 1 then 4 else 2 end * case when i = 0 then 0 else
  exp(((k - 1) / 2.0::double - 1) * ln(h * i / 4000) - h * i / 8000 - lgamma((k - 1) / 2.0::double) - (k - 1) / 2.0::double * ln(2::double)) end) * h / 12000 from range(4001) r(i))"""
_RANKS = """, r as (select barrio, antiguedad as g, rank() over (order by precio_usd) + (count(*) over (partition by precio_usd) - 1) / 2.0::double as rk, precio_usd from listings)"""


@query(f"""{_RANKS}, s as (select barrio, sum(rk) as r, count(*) as m from r group by 1), o as (select sum(r * r / m) as s, sum(m)::double as n, count(*) as k from s),
  t as (select sum(c::double * (c * c - 1)) as t from (select count(*) as c from r group by precio_usd)),
  h as (select (12 / (n * (n + 1)) * s - 3 * (n + 1)) / (1 - t / (n * (n * n - 1))) as h, k, n from o, t)
  select round(h, 4) as h, k, n::bigint as n, round({_CHI2_ABOVE}, 6) as p from h""")
def kruskal_by_barrio(spark, sf):
    out = stats.kruskal(listings(spark, sf), "precio_usd", "barrio")
    return out.select(F.round("h", 4).alias("h"), "k", F.col("n").cast("long").alias("n"), r6("p").alias("p"))


_WILCOX = """, d as (select barrio, precio_m2_usd - median(precio_m2_usd) over () as d from listings), z as (select barrio, round(d, 4) as d, abs(round(d, 4)) as a from d where round(d, 4) <> 0),
  k as (select *, rank() over (partition by barrio order by a) + (count(*) over (partition by barrio, a) - 1) / 2.0::double as r, count(*) over (partition by barrio, a) as t from z)
  select barrio, count(*) as n, sum(case when d > 0 then r else 0 end) as w_mas,
  round((sum(case when d > 0 then r else 0 end) - count(*)::double * (count(*) + 1) / 4) / sqrt(count(*)::double * (count(*) + 1) * (2 * count(*) + 1) / 24 - sum((t * t - 1)::double) / 48), 6) as z from k group by 1"""


@query(f"{_WILCOX.replace('select barrio, count(*) as n, sum(case', ', y as (select barrio, count(*) as n, sum(case')}) select *, round({_TWO_SIDED}, 6) as p from y".replace("from z)\n  , y", "from z), y"))
def wilcoxon_by_barrio(spark, sf):
    rows = listings(spark, sf).select("barrio", "precio_m2_usd")
    middle = stats.exact_quantiles(rows, "precio_m2_usd", [0.5]).select(F.col("q")[0].alias("_m"))  # one row
    rows = rows.crossJoin(F.broadcast(middle)).select("barrio", F.round(F.col("precio_m2_usd") - F.col("_m"), 4).alias("d"))
    return stats.wilcoxon(rows, "d", "barrio").withColumn("z", r6("z")).withColumn("p", r6(numeric.two_sided(F.col("z"))))


@query(f"""{_WILCOX.rsplit('select barrio, count(*) as n', 1)[0]}, w as (select barrio, count(*) as n, sum(case when d > 0 then r else 0 end) as w_mas, sum((t * t - 1)::double) as ties from k group by 1),
  p as (select barrio, round((w_mas - n::double * (n + 1) / 4) / sqrt(n::double * (n + 1) * (2 * n + 1) / 24 - ties / 48), 6) as z from w),
  q as (select barrio, round({_TWO_SIDED}, 7) as p from p),
  s as (select *, (count(*) over () - row_number() over (order by p, barrio) + 1) * p as step, row_number() over (order by p, barrio) as i from q)
  select barrio, p, least(1.0, max(step) over (order by i)) as p_holm from s""")
def holm_by_barrio(spark, sf):
    rows = listings(spark, sf).select("barrio", "precio_m2_usd")
    middle = stats.exact_quantiles(rows, "precio_m2_usd", [0.5]).select(F.col("q")[0].alias("_m"))
    rows = rows.crossJoin(F.broadcast(middle)).select("barrio", F.round(F.col("precio_m2_usd") - F.col("_m"), 4).alias("d"))
    tests = stats.wilcoxon(rows, "d", "barrio").select("barrio", F.round(numeric.two_sided(F.round("z", 6)), 7).alias("p"))
    return stats.holm(tests, "p")


@query(""", w as (select round(antiguedad - avg(antiguedad) over (partition by barrio), 9) as x, round(precio_m2_usd - avg(precio_m2_usd) over (partition by barrio), 9) as y from listings where antiguedad is not null),
  r as (select rank() over (order by x) + (count(*) over (partition by x) - 1) / 2.0::double as rx, rank() over (order by y) + (count(*) over (partition by y) - 1) / 2.0::double as ry from w)
  select round(corr(rx, ry), 4) as rho, count(*) as n from r""")
def spearman_within(spark, sf):
    out = stats.spearman_within(listings(spark, sf), "antiguedad", "precio_m2_usd", "barrio")
    return out.select(F.round("rho", 4).alias("rho"), "n")


@query(""", c as (select ambientes, antiguedad, count(*)::double as n from listings where antiguedad is not null group by 1, 2), b as (select sum(n * (n - 1) / 2) as s, sum(n) as n from c),
  a as (select sum(m * (m - 1) / 2) as sa from (select sum(n) as m from c group by ambientes)), d as (select sum(m * (m - 1) / 2) as sb from (select sum(n) as m from c group by antiguedad))
  select round((s - sa * sb / (n * (n - 1) / 2)) / ((sa + sb) / 2 - sa * sb / (n * (n - 1) / 2)), 6) as ari from a, b, d""")
def ari_contingency(spark, sf):
    return stats.adjusted_rand(listings(spark, sf).filter("antiguedad is not null"), "ambientes", "antiguedad").select(r6("ari").alias("ari"))


@query(""", l as (select quantile_cont(precio_m2_usd, 0.01) as a, quantile_cont(precio_m2_usd, 0.99) as b from listings), c as (select barrio, least(greatest(precio_m2_usd, a), b) as v from listings, l),
  m as (select avg(v) as m, stddev_pop(v) as s from c) select barrio, round(avg((v - m) / s), 6) as z, round(max((v - m) / s), 6) as z_max from c, m group by 1""")
def winsor_zscore(spark, sf):
    rows = stats.winsor_z(listings(spark, sf).select("barrio", "precio_m2_usd"), ["precio_m2_usd"])
    return rows.groupBy("barrio").agg(r6(F.avg("z_precio_m2_usd")).alias("z"), r6(F.max("z_precio_m2_usd")).alias("z_max"))


def _poisson_sql(u: str) -> str:
    out = []
    term = 0.36787944117144233
    cdf = term
    for k in range(1, 9):
        out.append(f"case when {u} >= {cdf!r} then 1 else 0 end")
        term = term / k
        cdf += term
    return " + ".join(out)


@query(f""", n as (select {_UNIT} as unidad, sum(precio_m2_usd) as s, count(*) as n from listings group by 1),
  d as (select rep, s, n, ('0x' || substr(md5(rep || '|' || unidad), 1, 8))::ubigint::double / 4294967296.0 as u from n, range(1, 301) r(rep)),
  m as (select rep, sum(({_poisson_sql('u')}) * s) / sum(({_poisson_sql('u')}) * n) as m from d group by 1)
  select round(quantile_cont(m, 0.025), 6) as inferior, round(quantile_cont(m, 0.975), 6) as superior, count(*) as repeticiones from m""")
def cluster_bootstrap(spark, sf):
    out = stats.cluster_bootstrap(with_unit(spark, sf), "precio_m2_usd", "unidad", 300)
    return out.select(r6("inferior").alias("inferior"), r6("superior").alias("superior"), "repeticiones")
