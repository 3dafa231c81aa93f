"""Cleaning, profile and summary queries over listings, each with the DuckDB SQL that must give the same rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from predial.functions import numeric, text
from predial.operators import clean, cluster, pages, profile, rule, spatial, stats
from predial.plans.listing_queries import _DEDUP, _FOLD, _GAP, _HAV, _PLACES, _REASON, _RISK, _rule_sql, _SIZE, _SURVEYS, _UNIT, _reason, gaps, r6, stations, surveys, with_unit
from predial.sources.listings import LISTINGS_SQL, YES_NO, listings, tables

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, view: bool = True):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = f"with {LISTINGS_SQL}{sql}" if view else sql
        return f

    return add


def r4(x):
    return F.round(x, 4)


def pct(x, digits: int = 4):
    return F.round(100 * x, digits)


# --- values and scope ------------------------------------------------------------------------------------------------


@query(""", x as (select case partkey % 4 when 0 then '24 horas' when 1 then '24 horas' when 2 then 'Penthouse' end as etiqueta, case when partkey % 23 = 5 then null else piso end as piso,
  nullif(ambientes - 1, 0) as ambientes, banos from listings) select etiqueta, count(*) as n, count(piso) as con_piso, count(ambientes) as con_ambientes, count(banos) as con_banos from x group by 1""")
def sentinels_and_labels(spark, sf):
    """Numbers that stand for a missing one, and labels with two spellings."""
    p = F.col("partkey")
    raw = F.when(p % 4 == 0, "24 hs").when(p % 4 == 1, "24 horas").when(p % 4 == 2, "Penthhouse")
    rows = listings(spark, sf).select(raw.alias("etiqueta"), F.when(p % 23 == 5, 99.0).otherwise(F.col("piso")).alias("piso"), (F.col("ambientes") - 1).alias("ambientes"), "banos")
    rows = clean.without_sentinels(rows).withColumn("etiqueta", clean.unified(F.col("etiqueta")))
    return rows.groupBy("etiqueta").agg(F.count("*").alias("n"), F.count("piso").alias("con_piso"), F.count("ambientes").alias("con_ambientes"), F.count("banos").alias("con_banos"))


@query(f" select case when {_REASON} is null then 'incluido' else 'excluido' end as grupo, count(*) as n, round(sum(precio_usd), 2) as precio, count(distinct barrio) as barrios from listings group by 1")
def kept_and_excluded(spark, sf):
    """The split into kept and excluded ads (P5)."""
    size, _ = clean.surface_choice(F.col("m2_final"), F.col("superficie_total"))
    reason = clean.exclusion_reason(F.col("precio_usd"), F.col("moneda"), size, F.col("titulo"), F.col("en_construccion"))
    rows = listings(spark, sf).withColumn("grupo", F.when(reason.isNull(), "incluido").otherwise("excluido"))
    return rows.groupBy("grupo").agg(F.count("*").alias("n"), F.round(F.sum("precio_usd"), 2).alias("precio"), F.count_distinct("barrio").alias("barrios"))


@query(f""", x as (select case when partkey % 10 = 0 then m2_final * 100 else m2_final end as m2_final, superficie_total from listings)
  select case when m2_final between 15 and 1000 then 'listado' when superficie_total between 15 and 1000 then 'recuperada_de_total' else 'invalida' end as origen, count(*) as n, round(sum({_SIZE}), 4) as m2 from x group by 1""")
def surface_origins(spark, sf):
    """The surface to use and where it comes from."""
    rows = listings(spark, sf).select(F.when(F.col("partkey") % 10 == 0, F.col("m2_final") * 100).otherwise(F.col("m2_final")).alias("a"), F.col("superficie_total").alias("b"))
    value, origin = clean.surface_choice(F.col("a"), F.col("b"))
    return rows.groupBy(origin.alias("origen")).agg(F.count("*").alias("n"), r4(F.sum(value)).alias("m2"))


@query(""", x as (select (suppkey * 13)::double as c from listings) select case when c < 100 then c else floor(c / 100) end as piso, count(*) as n from x group by 1""")
def floors_from_unit_numbers(spark, sf):
    """Floors given as unit numbers."""
    rows = listings(spark, sf).select((F.col("suppkey") * 13).cast("double").alias("c"))
    return rows.groupBy(clean.floor_number(F.col("c")).alias("piso")).agg(F.count("*").alias("n"))


_YES = lambda c: f"(coalesce({c} = 'Sí', false))::int"
_BANDS = {f"f_edad_{a}_{b}": f"(coalesce(antiguedad between {a} and {b}, false))::int" for a, b in clean.AGE_BANDS}
_FEATURES = {
    "f_log_m2": "ln(m2_final)", "f_ambientes": "least(coalesce(ambientes, dormitorios + 1), 6)", "f_banos": "least(coalesce(banos, 1), 4)",
    "f_banos_falta": "(banos is null)::int", "f_cochera": "(coalesce(cocheras > 0, false))::int", **_BANDS, "f_edad_falta": "(antiguedad is null)::int",
    "f_piso": "case when piso is null then 0 else least(piso, 20) end", "f_piso_falta": "(piso is null)::int",
    "f_contrafrente": "(coalesce(disposicion = 'Contrafrente', false))::int", **{f"f_{c}": _YES(c) for c in YES_NO},
    "f_estado_a_estrenar": "(estado = 'a_estrenar')::int", "f_estado_a_reciclar": "(estado = 'a_reciclar')::int",
    "f_estado_ya_reformado": "(estado = 'ya_reformado')::int", "f_titulo_tipo_casa": "(regexp_matches(lower(titulo), 'tipo casa'))::int",
    "f_inquilino": f"({_RISK['con_inquilino']})::int", **{f"f_m2_x{k[1:]}": f"ln(m2_final) * {v}" for k, v in _BANDS.items()},
}
_STATE_SQL = "case " + " ".join(f"when regexp_matches(lower(titulo), '{p}') then '{n}'" for n, p in text.STATES) + " else 'sin_marca' end"


@query(f""", x as (select *, {_STATE_SQL} as estado from listings), y as (select barrio, {", ".join(f"{v} as {k}" for k, v in _FEATURES.items())} from x)
  select barrio, rasgo, round(sum(v), 2) as suma from (unpivot (select barrio, {", ".join(f"{k}::double as {k}" for k in _FEATURES)} from y) on columns(* exclude (barrio)) into name rasgo value v) group by 1, 2""")
def feature_sums(spark, sf):
    """Sums of the models' features by neighbourhood, all in one pass."""
    rows = clean.extended_features(listings(spark, sf))
    one = rows.groupBy("barrio").agg(*(F.sum(F.col(c).cast("double")).alias(c) for c in _FEATURES))
    return one.unpivot(["barrio"], list(_FEATURES), "rasgo", "suma").withColumn("suma", F.round("suma", 2))


_SIGNS = f""", o as (select *, {_SIZE} as m2, case when m2_final between 15 and 1000 then 'listado' when superficie_total between 15 and 1000 then 'recuperada_de_total' else 'invalida' end as m2_origen,
  coalesce(ambientes, dormitorios + 1) as amb from (select * replace (case when partkey % 9 = 0 then null else ambientes end as ambientes, case when partkey % 18 = 0 then null else dormitorios end as dormitorios) from listings)),
  q as (select quantile_cont(m2_final / greatest(amb, 1), 0.01) as a, quantile_cont(m2_final / greatest(amb, 1), 0.99) as b from o where amb is not null),
  s as (select barrio, not coalesce(m2_final / greatest(amb, 1) between a and b and amb is not null, false) as por_ambiente, m2_origen = 'recuperada_de_total' as recuperada,
    coalesce(dormitorios >= ambientes and ambientes > 1, false) as dormitorios, coalesce(pisos_edificio >= 3 and piso > pisos_edificio, false) as piso, contains(lower(titulo), 'alquil') as alquiler from o, q)"""


@query(f"""{_SIGNS} select barrio, count(*) filter (where por_ambiente) as por_ambiente, count(*) filter (where recuperada) as recuperada, count(*) filter (where dormitorios) as dormitorios,
  count(*) filter (where piso) as piso, count(*) filter (where alquiler) as alquiler, count(*) filter (where por_ambiente or recuperada or dormitorios or piso or alquiler) as alguna from s group by 1""")
def entry_error_signals(spark, sf):
    """Signs of wrong entries by neighbourhood."""
    rows = listings(spark, sf).withColumns({
        "ambientes": F.when(F.col("partkey") % 9 != 0, F.col("ambientes")), "dormitorios": F.when(F.col("partkey") % 18 != 0, F.col("dormitorios")),
        "m2_origen": clean.surface_choice(F.col("m2_final"), F.col("superficie_total"))[1],
    })
    rows = clean.incoherences(rows)
    limits = stats.exact_quantiles(rows.select(clean.m2_per_room().alias("v")), "v", [0.01, 0.99])
    rows = clean.entry_errors(rows.crossJoin(F.broadcast(limits)), (F.col("q")[0], F.col("q")[1]))
    short = {"por_ambiente": "m2_por_ambiente", "recuperada": "superficie_recuperada", "dormitorios": "dormitorios", "piso": "piso", "alquiler": "alquiler", "alguna": "error_carga"}
    return rows.groupBy("barrio").agg(*(F.count_if(f"senal_{v}").alias(k) for k, v in short.items()))


_CONSENSUS = f"""{_GAP}, z2 as (select coalesce(subzona, barrio) as zz, median(precio_m2_usd) as z2 from f group by 1),
  c as (select f.*, precio_m2_usd / z2 - 1 as otra from f join z2 on z2.zz = coalesce(subzona, barrio)), m as (select *, brecha < -0.25 as a, otra < -0.25 as b from c)"""


def consensus(spark, sf):
    rows = gaps(spark, sf, only=("subzona",)).withColumn("zona2", F.coalesce("subzona", "barrio"))
    other = rows.groupBy("zona2").agg(F.median("precio_m2_usd").alias("m2z"))
    rows = rows.join(other, "zona2").withColumn("otra", F.col("precio_m2_usd") / F.col("m2z") - 1)
    return rows.withColumns({"a": F.col("brecha") < -0.25, "b": F.col("otra") < -0.25})


@query(f"""{_CONSENSUS} select barrio, count(*) filter (where a and b) as consenso, count(*) filter (where a <> b) as una_sola, count(*) filter (where a <> b and brecha between -0.30 and -0.20) as cerca_del_umbral,
  round(count(*) filter (where a and b)::double / nullif(count(*) filter (where a or b), 0), 6) as jaccard from m group by 1""")
def flag_consensus(spark, sf):
    """Flags of two models: by both, by one, by one near the threshold, and their Jaccard ratio."""
    both, some, one = F.col("a") & F.col("b"), F.col("a") | F.col("b"), F.col("a") != F.col("b")
    return consensus(spark, sf).groupBy("barrio").agg(
        F.count_if(both).alias("consenso"), F.count_if(one).alias("una_sola"), F.count_if(one & F.col("brecha").between(-0.30, -0.20)).alias("cerca_del_umbral"),
        r6(F.try_divide(F.count_if(both), F.count_if(some))).alias("jaccard"),
    )


@query("""select event_type, count(*) as n, count(distinct user_id) as usuarios from events where ts >= timestamp '2024-01-12' - interval 3 month and ts < timestamp '2024-01-12' and event_type in ('click', 'purchase', 'error') group by 1""", view=False)
def permits_in_window(spark, sf):
    """Records of some kinds within months before a date."""
    (events,) = tables(spark, sf, "events")
    rows = clean.in_window(events, "ts", "2024-01-12", 3, "event_type", ["click", "purchase", "error"])
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("usuarios"))


@query(f"""{_GAP} select barrio, count(*) as n, round(min(precio_usd), 4) as minimo from f where ambientes >= 5 and precio_usd <= 60000 and m2_final between 20 and 45 and brecha < -0.10 group by 1""")
def facet_search(spark, sf):
    """A search by several optional facets."""
    rows = profile.search(gaps(spark, sf), rooms=5, most_price=60_000, size=(20, 45), gap_under=-0.10)
    return rows.groupBy("barrio").agg(F.count("*").alias("n"), r4(F.min("precio_usd")).alias("minimo"))


_PLACE_SQL = "(select count(*) from nation k where contains(lower(titulo), lower(k.n_name)) and not contains(lower(titulo), 'calle ' || lower(k.n_name)) and lower(k.n_name) <> lower(barrio) and not contains(lower(barrio), lower(k.n_name)) and not contains(lower(k.n_name), lower(barrio))) > 0 and not contains(lower(titulo), lower(barrio))"
_EXCLUDED = f"""{_GAP}, x as (select *, case when suppkey % 5 <> 0 then lat end as lat_, case when suppkey % 11 = 0 then 300.0 end as popular from f),
  e as (select id_aviso, list_filter([case when contains(lower(titulo), 'villa 31') then 'barrio popular' end, case when not contains(lower(titulo), 'villa 31') and popular < 500 then 'a menos de 500 m de un barrio popular' end,
    case when contains(lower(titulo), 'tipo casa') then 'casa' end, case when regexp_matches(lower(titulo), '\\bph\\b') then 'PH' end, case when regexp_matches(lower(titulo), 'comercial|oficina') then 'uso comercial u oficina' end,
    case when lat_ is null and {_PLACE_SQL} then 'barrio dudoso' end, case when contains(lower(titulo), 'en block') then 'posible venta de varias unidades' end,
    case when contains(lower(titulo), 'anticipo') then 'precio posiblemente con financiación' end, case when contains(lower(titulo), 'en pozo') then 'en pozo: precio no comparable con usados' end,
    case when partkey % 50 = 7 then 'revisión manual: foto de otra unidad' end], lambda y: y is not null) as e from x)"""


@query(f"{_EXCLUDED} select motivo, count(*) as n from (select unnest(case when len(e) = 0 then ['destacado'] else e end) as motivo from e) group by 1")
def highlight_exclusions(spark, sf):
    """Why ads are not shown among the best, manual reviews included, and how many are (P19, P20, SRC14, F14, F15)."""
    (nation,) = tables(spark, sf, "nation")
    places = sorted(r.n_name.lower() for r in nation.select("n_name").collect())  # the names of places, a short list
    rows = gaps(spark, sf, only=("id_aviso", "titulo", "suppkey", "partkey", "lat")).withColumns({"lat": F.when(F.col("suppkey") % 5 != 0, F.col("lat")), "en_barrio_popular": F.lit(False), "dist_barrio_popular_m": F.when(F.col("suppkey") % 11 == 0, 300.0)})
    manual = rows.filter("partkey % 50 = 7").select("id_aviso", F.lit("foto de otra unidad").alias("motivo_manual"))
    found = clean.exclusions(rows, places).join(manual, "id_aviso", "left")
    found = found.select(F.array_compact(F.concat("exclusiones", F.array(F.concat(F.lit("revisión manual: "), "motivo_manual")))).alias("e"))
    return found.select(F.explode(F.when(F.size("e") == 0, F.array(F.lit("destacado"))).otherwise(F.col("e"))).alias("motivo")).groupBy("motivo").agg(F.count("*").alias("n"))


_LABELS = lambda discards: ", ".join(f"case when {_RISK[n]} then '{n.replace('_', ' ')}' end" for n, _, d in text.RISKS if d == discards)


@query(f" select concat_ws(', ', {_LABELS(True)}) as descartar, concat_ws(', ', {_LABELS(False)}) as revisar, count(*) as n from listings group by 1, 2")
def legal_labels(spark, sf):
    """Labels of legal risk in titles, by what they ask for."""
    t = F.col("titulo")
    return listings(spark, sf).groupBy(text.risk_labels(t, True).alias("descartar"), text.risk_labels(t, False).alias("revisar")).agg(F.count("*").alias("n"))


_FLAG_SQL = {
    "no_es_venta": r"regexp_matches(lower(titulo), '^\s*(?:compro|compramos)\b')", "menciona_alquiler": "contains(lower(titulo), 'alquil')", "titulo_barrio_popular": "contains(lower(titulo), 'villa 31')",
    "titulo_tipo_casa": "contains(lower(titulo), 'tipo casa')", "titulo_a_refaccionar": "regexp_matches(lower(titulo), 'refacc|a reciclar')", "titulo_reciclado": "regexp_matches(lower(titulo), 'reciclad') and not regexp_matches(lower(titulo), 'refacc|a reciclar')",
    "titulo_a_estrenar": "contains(lower(titulo), 'estrenar')", "titulo_con_renta": "contains(lower(titulo), 'renta')", "ph": r"regexp_matches(lower(titulo), '\bph\b')", "otro_uso": "regexp_matches(lower(titulo), 'oficina|comercial')",
    "con_financiacion": "contains(lower(titulo), 'anticipo')", "varias_unidades": "contains(lower(titulo), 'en block')",
}


@query(" union all ".join(f"select '{k}' as marca, count(*) filter (where {v}) as n, round(median(precio_m2_usd) filter (where {v}), 6) as con, round(median(precio_m2_usd) filter (where not ({v})), 6) as sin from listings" for k, v in _FLAG_SQL.items()).join((" ", "")))
def title_flag_table(spark, sf):
    """How often titles say something, and median prices with and without it."""
    t = F.col("titulo")
    flags = {k: v for k, v in (text.title_flags(t) | text.use_flags(t)).items() if k in _FLAG_SQL}
    rows = listings(spark, sf).select("precio_m2_usd", *(v.alias(k) for k, v in flags.items())).unpivot(["precio_m2_usd"], list(flags), "marca", "hay")
    rows = rows.select("marca", "hay", *(F.when(F.col("hay") == h, F.col("precio_m2_usd")).alias(c) for c, h in (("con", True), ("sin", False))))
    out = stats.with_quantiles(rows, ["marca"], [F.count_if("hay").alias("n")], {"_con": ("con", [0.5]), "_sin": ("sin", [0.5])})
    return out.select("marca", "n", *(r6(F.col(f"_{c}")[0]).alias(c) for c in ("con", "sin")))


_MAIN = ["antiguedad", "cocheras", "piso", "pisos_edificio", "disposicion", "expensas_usd", "superficie_total", *YES_NO]


@query(f""", x as (select barrio, ({" + ".join(f"({c} is not null)::int" for c in _MAIN)})::double / {len(_MAIN)} as v from listings) select barrio, round(avg(v), 6) as media, round(min(v), 6) as minimo, round(max(v), 6) as maximo from x group by 1""")
def completeness_by_barrio(spark, sf):
    """How complete ads are."""
    rows = listings(spark, sf).select("barrio", clean.completeness(_MAIN).alias("v"))
    return rows.groupBy("barrio").agg(r6(F.avg("v")).alias("media"), r6(F.min("v")).alias("minimo"), r6(F.max("v")).alias("maximo"))


_PROFILED = ["barrio", "banos", "piso", "disposicion", "apto_credito", "pileta", "moneda", "solo_si", "constante"]


@query(", x as (select barrio, banos::varchar as banos, piso::varchar as piso, disposicion, apto_credito, pileta, moneda, case when pileta = 'Sí' then 'Sí' end as solo_si, 'x' as constante from listings) " + " union all ".join(
    f"select '{c}' as columna, count(distinct {c}) as distintos, round(100 * avg(({c} is null)::int::double), 4) as nulos_pct, count(distinct {c}) <= 1 as constante, case when bool_and({c} = 'Sí') then 'solo_si' when bool_or({c} = 'Sí') and bool_or({c} = 'No') then 'si_no' else 'otro' end as clase from x" for c in _PROFILED))
def data_profile(spark, sf):
    """Distinct values, nulls and kind of each column, in one pass."""
    number = lambda c: F.when(F.col(c).isNotNull(), F.format_string("%.1f", F.col(c))).alias(c)
    rows = listings(spark, sf).select("barrio", number("banos"), number("piso"), "disposicion", "apto_credito", "pileta", "moneda", F.when(F.col("pileta") == "Sí", "Sí").alias("solo_si"), F.lit("x").alias("constante"))
    return profile.columns(rows)


# --- joins -----------------------------------------------------------------------------------------------------------


@query(""", o as (select distinct id_aviso, true as ok from listings where suppkey % 3 = 0) select barrio, count(*) filter (where coalesce(o.ok, false)) as coinciden, count(*) as n from listings left join o using (id_aviso) group by 1""")
def official_flag_filled(spark, sf):
    """A flag from another table, false where it is missing."""
    rows = listings(spark, sf)
    official = rows.filter("suppkey % 3 = 0").select("id_aviso").distinct().withColumn("ok", F.lit(True))
    return clean.with_flag(rows.select("id_aviso", "barrio"), official, "id_aviso", "ok").groupBy("barrio").agg(F.count_if("ok").alias("coinciden"), F.count("*").alias("n"))


@query(", g as (select barrio from listings group by 1 having median(precio_m2_usd) > (select median(precio_m2_usd) from listings)) select barrio, count(*) as n, count(distinct subzona) as subzonas from listings where barrio in (select barrio from g) group by 1")
def members_of_dear_places(spark, sf):
    """Ads of the neighbourhoods dearer than the city."""
    # Written once, narrow: the medians and the result read them again, without the listings' joins.
    rows = cluster.written(listings(spark, sf).select("barrio", "subzona", "precio_m2_usd"))
    city = stats.exact_quantiles(rows, "precio_m2_usd", [0.5]).select(F.col("q")[0].alias("c"))
    dear = stats.group_quantiles(rows, "precio_m2_usd", ["barrio"], [0.5]).crossJoin(F.broadcast(city)).filter("q[0] > c").select("barrio")
    return rows.join(dear, "barrio", "left_semi").groupBy("barrio").agg(F.count("*").alias("n"), F.count_distinct("subzona").alias("subzonas"))


_CACHE = """, c as (select 'calle ' || p_partkey as dir_limpia, case when p_partkey % 6 <> 1 then -34.6 - (p_partkey % 100) / 1000.0::double end as lat, case when p_partkey % 6 = 1 then 'SIN_RESULTADO' else 'OK' end as estado from part where p_partkey % 7 <> 2),
  g as (select barrio, case when partkey % 9 = 0 then 'NO_GEOCODIFICABLE' else coalesce(estado, 'PENDIENTE') end as estado, case when partkey % 9 <> 0 then c.lat end as lat from listings l left join c on c.dir_limpia = l.dir_limpia)"""


@query(f"{_CACHE} select estado, count(*) as n, count(lat) as con_lat, round(sum(lat), 4) as suma from g group by 1")
def geocode_cache(spark, sf):
    """Stored coordinates by address (J19, S2): an ad without address can't be placed."""
    return geocoded(spark, sf).groupBy("estado").agg(F.count("*").alias("n"), F.count("lat").alias("con_lat"), r4(F.sum("lat")).alias("suma"))


def geocoded(spark, sf) -> DataFrame:
    (part,) = tables(spark, sf, "part")
    key = F.col("p_partkey")
    known = part.filter(key % 7 != 2).select(
        F.concat(F.lit("calle "), key.cast("string")).alias("dir_limpia"), F.when(key % 6 != 1, -34.6 - (key % 100) / 1000.0).alias("lat"),
        F.lit(None).cast("double").alias("lon"), F.when(key % 6 == 1, "SIN_RESULTADO").otherwise("OK").alias("estado"),
    )
    rows = listings(spark, sf).drop("lat", "lon").withColumn("dir_limpia", F.when(F.col("partkey") % 9 != 0, F.col("dir_limpia")))
    return clean.from_cache(rows, known, "dir_limpia")


@query(f"""{_CACHE}, r as (select barrio, count(*) as n, 100 * avg((estado = 'OK')::int::double) as tasa from g group by 1) select barrio, n, round_even(round(tasa, 7), 2) as tasa, n >= (select quantile_cont(n, 0.8) from r) as en_el_tope from r""")
def geocoding_rates(spark, sf):
    """How many ads are placed in each neighbourhood, and which neighbourhoods have most ads."""
    per = geocoded(spark, sf).groupBy("barrio").agg(F.count("*").alias("n"), F.avg((F.col("estado") == "OK").cast("double")).alias("t"))
    cap = per.agg(F.percentile("n", F.lit(0.8)).alias("cap"))  # one row of a row per neighbourhood
    return per.crossJoin(F.broadcast(cap)).select("barrio", "n", F.bround(F.round(100 * F.col("t"), 7), 2).alias("tasa"), (F.col("n") >= F.col("cap")).alias("en_el_tope"))


@query(f"""{_PLACES}, met as (select distinct -34.71::double + 0.017::double * (n_nationkey % 5) as lat, -58.50::double + 0.019::double * (n_nationkey % 7) as lon from nation),
  a as (select pts.lat, pts.lon, min({_HAV.format(a='pts', b='est')}) as d1 from pts, est group by 1, 2), b as (select pts.lat, pts.lon, min({_HAV.format(a='pts', b='met')}) as d2 from pts, met group by 1, 2)
  select round(a.lat, 6) as lat, round(a.lon, 6) as lon, round(least(d1, d2), 3) as dist_m, case when d1 <= d2 then 'estacion' else 'metrobus' end as modo from a join b on a.lat = b.lat and a.lon = b.lon""")
def nearest_of_layers(spark, sf):
    """The least of the distances to several layers, nulls passed over, and which layer it is."""
    (nation,) = tables(spark, sf, "nation")
    metro = nation.select((F.lit(-34.71) + 0.017 * (F.col("n_nationkey") % 5)).alias("lat"), (F.lit(-58.50) + 0.019 * (F.col("n_nationkey") % 7)).alias("lon")).distinct()
    points = spatial.distinct_points(listings(spark, sf))
    both = spatial.nearest(points, stations(spark, sf), "d1").join(spatial.nearest(points, metro, "d2"), ["lat", "lon"])
    return both.select(r6("lat").alias("lat"), r6("lon").alias("lon"), F.round(F.least("d1", "d2"), 3).alias("dist_m"), F.when(F.col("d1") <= F.col("d2"), "estacion").otherwise("metrobus").alias("modo"))


@query(f"""{_PLACES}, far as (select * from est where lon > -58.40), a as (select pts.lat, pts.lon, min({_HAV.format(a='pts', b='est')}) as d1 from pts, est group by 1, 2),
  c as (select pts.lat, pts.lon, min({_HAV.format(a='pts', b='est')}) as d2 from pts, (select * from est where not lon > -58.40) est group by 1, 2)
  select count(*) as puntos, count(*) filter (where d1 < d2) as con_borde, round(median(d2 - d1) filter (where d1 < d2), 3) as diferencia_mediana, round(max(d2 - d1), 3) as diferencia_max from a join c on a.lat = c.lat and a.lon = c.lon""")
def border_effect(spark, sf):
    """Nearest stations with and without those beyond a border."""
    points, all_ = spatial.distinct_points(listings(spark, sf)), stations(spark, sf)
    both = spatial.nearest(points, all_, "d1").join(spatial.nearest(points, all_.filter("not lon > -58.40"), "d2"), ["lat", "lon"])
    d, hit = F.col("d2") - F.col("d1"), F.col("d1") < F.col("d2")
    return both.agg(F.count("*").alias("puntos"), F.count_if(hit).alias("con_borde"), F.round(F.median(F.when(hit, d)), 3).alias("diferencia_mediana"), F.round(F.max(d), 3).alias("diferencia_max"))


@query(f"""{_GAP}, u as (select id_aviso, brecha, barrio from f where brecha < -0.25), sg as (select distinct id_aviso, case when ambientes >= 4 then 'amplio' else 'chico' end as segmento from f where suppkey % 4 <> 1),
  r as (select distinct id_aviso, 'nota' as nota from f where partkey % 50 = 7) select barrio, coalesce(segmento, 'sin_segmento') as segmento, count(*) as n, count(nota) as revisados, round(avg(brecha), 6) as brecha from u left join sg using (id_aviso) left join r using (id_aviso) group by 1, 2""")
def export_join(spark, sf):
    """The ranking with all that is known of its ads: a chain of left joins on the id, each of one row per ad."""
    rows = gaps(spark, sf)
    ranking = rows.filter(F.col("brecha") < -0.25).select("id_aviso", "brecha", "barrio")
    segments = rows.filter("suppkey % 4 != 1").select("id_aviso", F.when(F.col("ambientes") >= 4, "amplio").otherwise("chico").alias("segmento")).distinct()
    notes = rows.filter("partkey % 50 = 7").select("id_aviso", F.lit("nota").alias("nota")).distinct()
    out = profile.chained(ranking, "id_aviso", [segments, notes, None])
    return out.groupBy("barrio", F.coalesce("segmento", F.lit("sin_segmento")).alias("segmento")).agg(F.count("*").alias("n"), F.count("nota").alias("revisados"), r6(F.avg("brecha")).alias("brecha"))


# --- aggregates ------------------------------------------------------------------------------------------------------


@query(", s as (select barrio, subzona, median(precio_m2_usd) as m, count(*) as n from listings where subzona is not null group by 1, 2 having count(*) >= 10) select barrio, count(*) as subzonas, round(min(m), 6) as minimo, round(max(m), 6) as maximo, round(max(m) / min(m) - 1, 6) as amplitud from s group by 1")
def subzone_extremes(spark, sf):
    """The cheapest and the dearest subzone of each neighbourhood."""
    per = listings(spark, sf).filter("subzona is not null").groupBy("barrio", "subzona").agg(F.median("precio_m2_usd").alias("m"), F.count("*").alias("n")).filter("n >= 10")
    return per.groupBy("barrio").agg(F.count("*").alias("subzonas"), r6(F.min("m")).alias("minimo"), r6(F.max("m")).alias("maximo"), r6(F.max("m") / F.min("m") - 1).alias("amplitud"))


@query(f"""{_GAP}, pb as (select barrio, count(*) as avisos, count(distinct unidad) as unidades, median(precio_m2_usd) as m, 100 * median(abs(brecha)) as e, count(lat) as c from f group by 1),
  l as (select barrio, count(*) as senales, count(*) filter (where ambientes >= 3) as candidatos, 100 * median(brecha) as b from f where brecha < -0.25 group by 1)
  select barrio, avisos, unidades, c as con_coordenadas, coalesce(senales, 0) as senales, coalesce(candidatos, 0) as candidatos, round_even(m, 0) as precio_m2_mediano, round_even(round(e, 8), 1) as error_mediano_pct, round_even(round(b, 8), 2) as brecha_mediana_pct from pb left join l using (barrio)""")
def barrio_summary(spark, sf):
    """One row per neighbourhood from ads and from the list, zeros where nothing is listed."""
    return profile.summary(gaps(spark, sf), F.col("brecha") < -0.25, F.col("ambientes") >= 3)


@query(" select coalesce(barrio, 'total') as barrio, count(*) as n, round(median(precio_m2_usd), 6) as precio, round(median(m2_final), 6) as m2, round(median(antiguedad), 6) as antiguedad, round(median(expensas_usd), 6) as expensas from listings group by rollup(barrio)")
def barrio_medians_with_total(spark, sf):
    """Medians of several metrics by neighbourhood and in all."""
    rows = cluster.written(listings(spark, sf).select("barrio", "precio_m2_usd", "m2_final", "antiguedad", "expensas_usd"))
    medians = {"precio": ("precio_m2_usd", [0.5]), "m2": ("m2_final", [0.5]), "antiguedad": ("antiguedad", [0.5]), "expensas": ("expensas_usd", [0.5])}
    out = stats.with_quantiles(rows, ["barrio"], [F.count("*").alias("n")], medians).unionByName(stats.with_quantiles(rows, [], [F.count("*").alias("n")], medians).withColumn("barrio", F.lit(None).cast("string")))
    return out.select(F.coalesce("barrio", F.lit("total")).alias("barrio"), "n", *(r6(F.col(c)[0]).alias(c) for c in medians))


@query(", r as (select partkey % 4 = 0 as bajo, ln(precio_m2_usd) - avg(ln(precio_m2_usd)) over (partition by barrio) as rel from listings), q as (select quantile_cont(rel, 0.05) as c from r) select rel <= c as barato, count(*) as n, round(100 * avg(bajo::int::double), 6) as bajaron_pct from r, q group by 1")
def cheapest_twentieth(spark, sf):
    """Price drops among the cheapest twentieth, relative to the neighbourhood, and the rest."""
    rel = F.log("precio_m2_usd") - F.avg(F.log("precio_m2_usd")).over(Window.partitionBy("barrio"))
    rows = listings(spark, sf).select((F.col("partkey") % 4 == 0).alias("bajo"), rel.alias("rel"))
    cut = stats.exact_quantiles(rows, "rel", [0.05])
    return rows.crossJoin(F.broadcast(cut)).groupBy((F.col("rel") <= F.col("q")[0]).alias("barato")).agg(F.count("*").alias("n"), r6(100 * F.avg(F.col("bajo").cast("double"))).alias("bajaron_pct"))


@query(", s as (select case when ambientes >= 5 then 'familiar' when ambientes >= 3 then 'medio' else 'chico' end as segmento, m2_final, antiguedad from listings) select segmento, count(*) as n, round(100 * count(*)::double / sum(count(*)) over (), 6) as proporcion_pct, round(median(m2_final), 6) as m2, round(median(antiguedad), 6) as antiguedad from s group by 1")
def segment_profile(spark, sf):
    """Share and medians of each segment."""
    segment = F.when(F.col("ambientes") >= 5, "familiar").when(F.col("ambientes") >= 3, "medio").otherwise("chico")
    per = listings(spark, sf).groupBy(segment.alias("segmento")).agg(F.count("*").alias("n"), r6(F.median("m2_final")).alias("m2"), r6(F.median("antiguedad")).alias("antiguedad"))
    return per.withColumn("proporcion_pct", r6(100 * F.col("n") / F.sum("n").over(Window.partitionBy())))  # three rows


@query(f"{_DEDUP} select 'antes' as conjunto, count(*) as n, count(distinct id_aviso) as ids, round(median(precio_m2_usd), 6) as mediana, round(max(precio_m2_usd), 6) as maximo from listings union all select 'despues', count(*), count(distinct id_aviso), round(median(precio_m2_usd), 6), round(max(precio_m2_usd), 6) from d where n = 1 and {_REASON} is null")
def before_and_after(spark, sf):
    """The table before and after cleaning."""
    rows = listings(spark, sf).withColumn("_in", _reason().isNull())
    rows = clean.deduplicate(rows, "id_aviso", F.col("barrio_oficial"), "link")
    # One row of each id is kept, so those are counted in place of distinct ids. Rows are dealt once, and written narrow.
    rows = cluster.written(rows.select("precio_m2_usd", "kept", (F.col("kept") & F.col("_in")).alias("_in"), (F.col("kept") & F.col("id_aviso").isNotNull()).alias("_id")))
    sets = F.when(F.col("_in"), F.array(F.lit("antes"), F.lit("despues"))).otherwise(F.array(F.lit("antes")))
    rows = rows.select(F.explode(sets).alias("conjunto"), "precio_m2_usd", "_id")
    totals = [F.count("*").alias("n"), F.count_if("_id").alias("ids"), r6(F.max("precio_m2_usd")).alias("maximo")]
    out = stats.with_quantiles(rows, ["conjunto"], totals, {"_q": ("precio_m2_usd", [0.5])})
    names = spark.createDataFrame([("antes",), ("despues",)], "conjunto string")  # a set without rows has a row, too
    out = names.join(out, "conjunto", "left").fillna(0, ["n", "ids"])
    return out.select("n", "ids", r6(F.col("_q")[0]).alias("mediana"), "maximo", "conjunto")


@query(", b as (select case when antiguedad > -1 and antiguedad <= 20 then '0-20' when antiguedad > 20 and antiguedad <= 60 then '21-60' when antiguedad > 60 then '61+' end as tramo, ln(precio_m2_usd) as v from listings) select tramo, count(*) as n, round(avg(v), 6) as media, round(avg(v) - 1.96 * stddev_samp(v) / sqrt(count(*)), 6) as inferior, round(avg(v) + 1.96 * stddev_samp(v) / sqrt(count(*)), 6) as superior from b where tramo is not null group by 1")
def means_with_errors(spark, sf):
    """Means by band with 1.96 standard errors."""
    band = numeric.right_closed(F.col("antiguedad"), [-1, 20, 60, 1e9], ["0-20", "21-60", "61+"])
    rows = listings(spark, sf).select(band.alias("tramo"), F.log("precio_m2_usd").alias("v")).filter("tramo is not null")
    half = 1.96 * F.stddev_samp("v") / F.sqrt(F.count("v"))
    return rows.groupBy("tramo").agg(F.count("*").alias("n"), r6(F.avg("v")).alias("media"), r6(F.avg("v") - half).alias("inferior"), r6(F.avg("v") + half).alias("superior"))


@query(f""", x as (select subzona, expensas_usd / m2_final as e from listings where subzona is not null and expensas_usd is not null), m as (select subzona, median(ln(e)) as m from x group by 1)
  select subzona, count(*) as n, round(avg(ln(e) - m), 6) as media, round(quantile_cont(ln(e) - m, 0.9), 6) as p90 from x join m using (subzona) group by 1""")
def expenses_against_zone(spark, sf):
    """Monthly expenses per square metre against the zone's median."""
    rows = listings(spark, sf).filter("subzona is not null and expensas_usd is not null").select("subzona", F.log(F.col("expensas_usd") / F.col("m2_final")).alias("e"))
    middle = rows.groupBy("subzona").agg(F.median("e").alias("m"))
    rows = rows.join(middle, "subzona").withColumn("d", F.col("e") - F.col("m"))
    return rows.groupBy("subzona").agg(F.count("*").alias("n"), (r6(F.avg("d")) + 0.0).alias("media"), r6(F.percentile("d", F.lit(0.9))).alias("p90"))


@query(f""", x as (select {_UNIT} as unidad, case when linenumber % 2 = 0 then piso end as p from listings), u as (select unidad, p, min(p) over (partition by unidad) as a, max(p) over (partition by unidad) as b from x)
  select coalesce(p, case when a = b then a end) as piso, count(*) as n, count(*) filter (where p is null and a = b) as heredados from u group by 1""")
def inherited_floors(spark, sf):
    """Floors, inherited where a unit's other ads give only one."""
    rows = with_unit(spark, sf).select("unidad", F.when(F.col("linenumber") % 2 == 0, F.col("piso")).alias("p"))
    rows = clean.effective_floor(rows, "unidad", "p", "efectivo")
    return rows.groupBy(F.col("efectivo").alias("piso")).agg(F.count("*").alias("n"), F.count_if(F.col("p").isNull() & F.col("efectivo").isNotNull()).alias("heredados"))


# --- analysis notebooks ----------------------------------------------------------------------------------------------


@query(""", q as (select subzona, quantile_cont(precio_m2_usd, 0.25) as a, quantile_cont(precio_m2_usd, 0.75) as b, quantile_cont(ln(precio_m2_usd), 0.25) as c, quantile_cont(ln(precio_m2_usd), 0.75) as d, median(precio_m2_usd) as m from listings where subzona is not null group by 1 having count(*) >= 10),
  o as (select precio_m2_usd < a - 1.5 * (b - a) or precio_m2_usd > b + 1.5 * (b - a) as lineal, ln(precio_m2_usd) < c - 1.5 * (d - c) or ln(precio_m2_usd) > d + 1.5 * (d - c) as logaritmica, precio_m2_usd < m as bajo from listings join q using (subzona))
  select 'lineal' as escala, count(*) filter (where lineal) as atipicos, round(avg(bajo::int::double) filter (where lineal), 6) as bajo_la_mediana from o union all select 'logaritmica', count(*) filter (where logaritmica), round(avg(bajo::int::double) filter (where logaritmica), 6) from o""")
def outliers_by_scale(spark, sf):
    """Outliers on the linear and the log scale, and how many lie under the zone's median."""
    # Written once and narrow: each reading of listings sends the tables that are joined there through the driver again.
    rows = cluster.written(listings(spark, sf).filter("subzona is not null").select("subzona", "precio_m2_usd"))
    linear = stats.group_quantiles(rows, "precio_m2_usd", ["subzona"], [0.25, 0.5, 0.75])
    logs = stats.group_quantiles(rows.select("subzona", F.log("precio_m2_usd").alias("l")), "l", ["subzona"], [0.25, 0.75])
    limits = linear.join(logs.select("subzona", F.col("q").alias("_l")), "subzona").filter("n >= 10")
    rows = rows.join(limits, "subzona", "left").withColumn("l", F.log("precio_m2_usd"))

    def beyond(value, low, high):
        return clean.truth((F.col(value) < low - 1.5 * (high - low)) | (F.col(value) > high + 1.5 * (high - low)))

    q, l = F.col("q"), F.col("_l")
    rows = rows.select((F.col("precio_m2_usd") < q[1]).cast("double").alias("bajo"), beyond("precio_m2_usd", q[0], q[2]).alias("lineal"), beyond("l", l[0], l[1]).alias("logaritmica"))
    long = rows.unpivot(["bajo"], ["lineal", "logaritmica"], "escala", "atipico")
    return long.groupBy("escala").agg(F.count_if("atipico").alias("atipicos"), r6(F.avg(F.when(F.col("atipico"), F.col("bajo")))).alias("bajo_la_mediana"))


_OOF2 = f""", u as (select *, {_FOLD.format(u=_UNIT)} as vuelta from listings),
  mb as (select k.k as vuelta, barrio, median(precio_m2_usd) as m from u, range(5) k(k) where k.k <> vuelta group by 1, 2 having count(*) >= 10),
  ms as (select k.k as vuelta, subzona, median(precio_m2_usd) as m from u, range(5) k(k) where k.k <> vuelta and subzona is not null group by 1, 2 having count(*) >= 10),
  e as (select u.*, abs(precio_m2_usd / mb.m - 1) as eb, abs(precio_m2_usd / ms.m - 1) as es from u left join mb on mb.vuelta = u.vuelta and mb.barrio = u.barrio left join ms on ms.vuelta = u.vuelta and ms.subzona = u.subzona)"""


def two_errors(spark, sf) -> DataFrame:
    """Listings with vuelta and their errors eb and es. They are read from a narrow table that is written once: each reading of
    listings sends the tables that are joined there through the driver again."""
    rows = cluster.written(with_unit(spark, sf).select("barrio", "subzona", "precio_m2_usd", numeric.fold_of(F.col("unidad")).alias("vuelta")))
    for group, name in (("barrio", "eb"), ("subzona", "es")):
        rows = stats.group_error(rows, "precio_m2_usd", group, "vuelta").withColumnRenamed("error", name)
    return rows


@query(f"{_OOF2} select barrio, count(distinct subzona) as subzonas, round(median(eb), 6) as error_barrio, round(median(es), 6) as error_subzona, median(es) < median(eb) as mejora from e where eb is not null and es is not null group by 1 having count(distinct subzona) > 1")
def subzone_against_barrio(spark, sf):
    """Out-of-fold errors of both kinds of zone where there are several subzones."""
    rows = cluster.written(two_errors(spark, sf).filter("eb is not null and es is not null").select("barrio", "subzona", "eb", "es"))
    out = stats.with_quantiles(rows, ["barrio"], [F.count_distinct("subzona").alias("subzonas")], {"_b": ("eb", [0.5]), "_s": ("es", [0.5])}).filter("subzonas > 1")
    out = out.select("barrio", "subzonas", F.col("_b")[0].alias("b"), F.col("_s")[0].alias("s"))
    return out.select("barrio", "subzonas", r6("b").alias("error_barrio"), r6("s").alias("error_subzona"), (F.col("s") < F.col("b")).alias("mejora"))


@query(f"{_OOF2} select modelo, round(quantile_cont(v, 0.25), 6) as q1, round(median(v), 6) as q2, round(quantile_cont(v, 0.75), 6) as q3, count(v) as n from (select 'barrio' as modelo, eb as v from e union all select 'subzona', es from e) group by 1")
def error_quartiles(spark, sf):
    """Quartiles of two models' errors."""
    long = two_errors(spark, sf).select("eb", "es").unpivot([], ["eb", "es"], "m", "v").withColumn("modelo", F.when(F.col("m") == "eb", "barrio").otherwise("subzona"))
    out = stats.with_quantiles(cluster.written(long.select("modelo", "v")), ["modelo"], [F.count("v").alias("n")], {"_q": ("v", [0.25, 0.5, 0.75])})
    return out.select("modelo", *(r6(F.col("_q")[i]).alias(f"q{i + 1}") for i in range(3)), "n")


_TERCILES = "case when m <= (select quantile_cont(m, 1/3::double) from b) then 'barato' when m <= (select quantile_cont(m, 2/3::double) from b) then 'medio' else 'caro' end"


@query(f"{_OOF2}, b as (select barrio, median(precio_m2_usd) as m from listings group by 1), t as (select barrio, {_TERCILES} as tercil from b) select tercil, count(distinct barrio) as barrios, round(median(eb), 6) as error from e join t using (barrio) group by 1")
def error_by_price_tercile(spark, sf):
    """Errors of cheap, middling and dear neighbourhoods."""
    rows = stats.out_of_fold_group_error(with_unit(spark, sf), "precio_m2_usd", "barrio", "unidad")
    rows = rows.select("barrio", "error").join(F.broadcast(terciles(listings(spark, sf))), "barrio")
    out = stats.with_quantiles(rows, ["tercil"], [F.count_distinct("barrio").alias("barrios")], {"_q": ("error", [0.5])})
    return out.select("tercil", "barrios", r6(F.col("_q")[0]).alias("error"))


def terciles(rows: DataFrame) -> DataFrame:
    """(barrio, tercil): one row per neighbourhood."""
    per = stats.group_quantiles(rows, "precio_m2_usd", ["barrio"], [0.5]).select("barrio", F.col("q")[0].alias("m"))
    edges = per.agg(F.percentile("m", F.array(F.lit(1 / 3), F.lit(2 / 3))).alias("q"))
    kind = F.when(F.col("m") <= F.col("q")[0], "barato").when(F.col("m") <= F.col("q")[1], "medio").otherwise("caro")
    return per.crossJoin(F.broadcast(edges)).select("barrio", kind.alias("tercil"))


_BANDS_SQL = "case when d > -1 and d <= 300 then '0-300' when d > 300 and d <= 600 then '300-600' when d > 600 and d <= 1000 then '600-1000' else '1000+' end"
_DISTANCE = f"""{_PLACES}, n as (select pts.lat, pts.lon, min({_HAV.format(a='pts', b='est')}) as d from pts, est group by 1, 2), l as (select listings.*, round(d, 3) as d from listings join n using (lat, lon)),
  r as (select barrio, d, {_BANDS_SQL} as tramo, antiguedad, ln(precio_m2_usd) - avg(ln(precio_m2_usd)) over (partition by barrio) as rel, ln(precio_m2_usd) - avg(ln(precio_m2_usd)) over (partition by barrio, antiguedad > 30) as rel2 from l)"""


@query(f"{_DISTANCE} select tramo, count(*) as n, round(median(rel), 6) as por_barrio, round(median(rel2), 6) as por_barrio_y_edad, round(avg((tramo = '0-300')::int::double), 6) as cerca from r group by 1")
def distance_bands(spark, sf):
    """Relative prices by distance to a station, within neighbourhoods and within neighbourhoods and ages."""
    rows = listings(spark, sf).select("barrio", "lat", "lon", "antiguedad", "precio_m2_usd")
    near = spatial.nearest(spatial.distinct_points(rows), stations(spark, sf), "d").withColumn("d", F.round("d", 3))
    rows = rows.join(near, ["lat", "lon"])
    band = F.coalesce(numeric.right_closed(F.col("d"), [-1, 300, 600, 1000], ["0-300", "300-600", "600-1000"]), F.lit("1000+"))
    age = F.coalesce((F.col("antiguedad") > 30).cast("int"), F.lit(-1))  # unknown ages are a group
    rows = cluster.written(rows.select(band.alias("tramo"), "barrio", age.alias("_edad"), F.log("precio_m2_usd").alias("_l")))
    rows = rows.join(cluster.written(rows.groupBy("barrio").agg(F.avg("_l").alias("_m1"))), "barrio").join(cluster.written(rows.groupBy("barrio", "_edad").agg(F.avg("_l").alias("_m2"))), ["barrio", "_edad"])
    rows = rows.select("tramo", (F.col("_l") - F.col("_m1")).alias("a"), (F.col("_l") - F.col("_m2")).alias("b"))
    out = stats.with_quantiles(rows, ["tramo"], [F.count("*").alias("n")], {"_a": ("a", [0.5]), "_b": ("b", [0.5])})
    return out.select("tramo", "n", r6(F.col("_a")[0]).alias("por_barrio"), r6(F.col("_b")[0]).alias("por_barrio_y_edad"), (F.col("tramo") == "0-300").cast("double").alias("cerca"))


@query(""", a as (select case when antiguedad <= 30 then 'nuevo' else 'viejo' end as edad, barrio, gimnasio, precio_m2_usd from listings where antiguedad is not null and gimnasio is not null),
  g as (select edad, barrio, median(precio_m2_usd) filter (where gimnasio = 'Sí') / median(precio_m2_usd) filter (where gimnasio = 'No') - 1 as p from a group by 1, 2 having count(*) filter (where gimnasio = 'Sí') >= 5 and count(*) filter (where gimnasio = 'No') >= 5)
  select edad, round((select 100 * avg((gimnasio = 'Sí')::int::double) from a b where b.edad = g.edad), 6) as con_pct, round(100 * median(p), 6) as prima_pct, count(*) as zonas from g group by 1""")
def amenity_by_age(spark, sf):
    """How many have an amenity, and its premium, by age."""
    age = F.when(F.col("antiguedad") <= 30, "nuevo").otherwise("viejo").alias("edad")
    rows = listings(spark, sf).filter("antiguedad is not null and gimnasio is not null").select(age, "barrio", (F.col("gimnasio") == "Sí").alias("con"), "precio_m2_usd")
    share = rows.groupBy("edad").agg(r6(100 * F.avg(F.col("con").cast("double"))).alias("con_pct"))
    per = rows.groupBy("edad", "barrio").agg(F.median(F.when(F.col("con"), F.col("precio_m2_usd"))).alias("a"), F.median(F.when(~F.col("con"), F.col("precio_m2_usd"))).alias("b"), F.count_if("con").alias("n1"), F.count_if(~F.col("con")).alias("n0"))
    per = per.filter("n1 >= 5 and n0 >= 5").groupBy("edad").agg(r6(100 * F.median(F.col("a") / F.col("b") - 1)).alias("prima_pct"), F.count("*").alias("zonas"))
    return share.join(per, "edad")


@query(f"""{_DEDUP}, a as (select barrio, median(precio_m2_usd) as m from listings group by 1), b as (select barrio, median(precio_m2_usd) as m from d where n = 1 group by 1)
  select count(*) as barrios, round(max(abs(b.m / a.m - 1)), 6) as cambio_max, round(median(abs(b.m / a.m - 1)), 6) as cambio_mediano from a join b using (barrio)""")
def sensitivity_to_duplicates(spark, sf):
    """How much medians change without duplicates."""
    rows = clean.deduplicate(listings(spark, sf).select("id_aviso", "link", "barrio", "barrio_oficial", "precio_m2_usd"), "id_aviso", F.col("barrio_oficial"), "link")
    per = rows.groupBy("barrio").agg(F.median("precio_m2_usd").alias("a"), F.median(F.when(F.col("kept"), F.col("precio_m2_usd"))).alias("b")).filter("b is not null")
    change = F.abs(F.col("b") / F.col("a") - 1)
    return per.agg(F.count("*").alias("barrios"), r6(F.max(change)).alias("cambio_max"), r6(F.median(change)).alias("cambio_mediano"))


@query(" select barrio, count(*) as n, round(100 * avg((partkey % 4 = 0)::int::double), 6) as bajaron_pct, round(median(100 * (1 - precio_usd / (precio_usd + 1000))) filter (where partkey % 4 = 0), 6) as baja_mediana from listings group by 1 having count(*) >= 100")
def price_drops_by_barrio(spark, sf):
    """Shares and sizes of price drops."""
    dropped = F.col("partkey") % 4 == 0
    cut = 100 * (1 - F.col("precio_usd") / (F.col("precio_usd") + 1000))
    out = listings(spark, sf).groupBy("barrio").agg(F.count("*").alias("n"), r6(100 * F.avg(dropped.cast("double"))).alias("bajaron_pct"), r6(F.median(F.when(dropped, cut))).alias("baja_mediana"))
    return out.filter("n >= 100")


@query(f"""{_GAP}, m as (select *, brecha < -0.25 as marcado, partkey % 4 = 0 as bajo, suppkey % 5 <> 0 as con_coordenadas from f)
  select corte, valor, count(*) as n, round(100 * avg(marcado::int::double), 6) as marcados_pct, round(median(brecha), 6) as brecha from (select 'bajo' as corte, bajo as valor, marcado, brecha from m union all select 'coordenadas', con_coordenadas, marcado, brecha from m) group by 1, 2""")
def flag_rates(spark, sf):
    """Flag rates and gaps by price drop and by having coordinates."""
    rows = gaps(spark, sf, only=("partkey", "suppkey")).select("brecha", (F.col("partkey") % 4 == 0).alias("bajo"), (F.col("suppkey") % 5 != 0).alias("coordenadas")).unpivot(["brecha"], ["bajo", "coordenadas"], "corte", "valor")
    return rows.groupBy("corte", "valor").agg(F.count("*").alias("n"), r6(100 * F.avg((F.col("brecha") < -0.25).cast("double"))).alias("marcados_pct"), (r6(F.median("brecha")) + 0.0).alias("brecha"))


@query(f"""{_GAP}, b as (select barrio, avg((brecha < -0.25)::int::double) as tasa, median(abs(brecha)) as error from f group by 1 having count(*) >= 20),
  r as (select rank() over (order by tasa) + (count(*) over (partition by tasa) - 1) / 2.0::double as a, rank() over (order by error) + (count(*) over (partition by error) - 1) / 2.0::double as b from b) select count(*) as barrios, round(corr(a, b), 6) as rho from r""")
def flag_rate_against_error(spark, sf):
    """Rank correlation of flag rate and error over neighbourhoods."""
    per = gaps(spark, sf, only=()).groupBy("barrio").agg(F.avg((F.col("brecha") < -0.25).cast("double")).alias("t"), F.median(F.abs("brecha")).alias("e"), F.count("*").alias("n")).filter("n >= 20")
    ranks = per.select(stats.average_rank("t").alias("a"), stats.average_rank("e").alias("b"))  # one row per neighbourhood
    return ranks.agg(F.count("*").alias("barrios"), r6(F.corr("a", "b")).alias("rho"))


@query(f"""{_GAP}, c as (select barrio, brecha < (select -1.5 * median(abs(brecha)) from f) as ciudad, brecha < -umbral as propio from f)
  select barrio, count(*) as n, count(*) filter (where ciudad) as por_ciudad, count(*) filter (where propio) as por_barrio, count(*) filter (where ciudad and not propio) as salen, count(*) filter (where propio and not ciudad) as entran from c group by 1""")
def thresholds_compared(spark, sf):
    """Flags by the city's threshold and by the neighbourhood's own."""
    rows = gaps(spark, sf, only=())
    city = stats.exact_quantiles(rows.select(F.abs("brecha").alias("_g")), "_g", [0.5]).select((1.5 * F.col("q")[0]).alias("ciudad"))  # one row
    rows = rows.crossJoin(F.broadcast(city)).select("barrio", (F.col("brecha") < -F.col("ciudad")).alias("c"), (F.col("brecha") < -F.col("umbral")).alias("p"))
    return rows.groupBy("barrio").agg(F.count("*").alias("n"), F.count_if("c").alias("por_ciudad"), F.count_if("p").alias("por_barrio"), F.count_if(F.col("c") & ~F.col("p")).alias("salen"), F.count_if(F.col("p") & ~F.col("c")).alias("entran"))


@query(f"""{_GAP}, e as (select quantile_cont(expensas_usd, [0.25, 0.5, 0.75]) as q from f where expensas_usd is not null), c as (select 1 + len(list_filter(q, lambda x: x < expensas_usd)) as cuartil, brecha from f, e where expensas_usd is not null)
  select cuartil::int as cuartil, count(*) as n, round(100 * avg((brecha < -0.25)::int::double), 6) as marcados_pct from c group by 1""")
def flags_by_expense_quartile(spark, sf):
    """Flag rates by quartile of expenses."""
    rows = stats.quantile_bins(gaps(spark, sf, only=("expensas_usd",)).filter("expensas_usd is not null").select("expensas_usd", "brecha"), "expensas_usd", 4, "cuartil")
    return rows.groupBy("cuartil").agg(F.count("*").alias("n"), r6(100 * F.avg((F.col("brecha") < -0.25).cast("double"))).alias("marcados_pct"))


@query(f"""{_GAP}{_rule_sql(['base'])} select nivel, ambientes::int as ambientes, count(*) as n, round(median(brecha_neta), 6) as brecha_neta, count(*) filter (where brecha_neta >= 0.10) as pasan from v group by 1, 2""")
def net_gap_by_level(spark, sf):
    """Net gaps by refurbishment level and rooms."""
    from predial.plans.listing_queries import ruled

    return ruled(spark, sf, [rule.BASE]).groupBy("nivel", F.col("ambientes").cast("int").alias("ambientes")).agg(F.count("*").alias("n"), r6(F.median("brecha_neta")).alias("brecha_neta"), F.count_if(F.col("brecha_neta") >= 0.10).alias("pasan"))


@query(f"""{_GAP.replace("median(precio_m2_usd) as zona", "quantile_cont(precio_m2_usd, 0.25) as zona")}{_rule_sql(['base'])} select barrio, count(distinct unidad) filter (where brecha_neta >= 0.10 and brecha < -0.25) as firmes, count(distinct unidad) as unidades from v group by 1""")
def firm_units(spark, sf):
    """Units that pass the rule even at a low expected price."""
    from predial.plans.listing_queries import ruled

    rows = ruled(spark, sf, [rule.BASE], low=True)
    passes = (F.col("brecha_neta") >= 0.10) & (F.col("brecha") < -0.25)
    return rows.groupBy("barrio").agg(F.count_distinct(F.when(passes, F.col("unidad"))).alias("firmes"), F.count_distinct("unidad").alias("unidades"))


@query(f"""{_GAP}, i as (select count(*) as avisos, count(distinct unidad) as unidades, count(*) filter (where brecha < -0.25) as marcados, count(lat) as con_lat, median(abs(brecha)) as error, avg((partkey % 4 = 0)::int::double) filter (where brecha < -0.25) as a, avg((partkey % 4 = 0)::int::double) filter (where not brecha < -0.25) as b from f)
  select 'avisos' as indicador, avisos::double as valor from i union all select 'unidades', unidades from i union all select 'marcados', marcados from i union all select 'cobertura_pct', round(100.0 * con_lat / avisos, 6) from i union all select 'error_mediano_pct', round(100 * error, 6) from i
  union all select 'bajaron_marcados_pct', round(100 * a, 6) from i union all select 'bajaron_resto_pct', round(100 * b, 6) from i""")
def indicators(spark, sf):
    """The block of indicators."""
    rows, flagged, drop = gaps(spark, sf, only=("lat", "partkey")), F.col("brecha") < -0.25, (F.col("partkey") % 4 == 0).cast("double")
    one = rows.agg(
        F.count("*").cast("double").alias("avisos"), F.count_distinct("unidad").cast("double").alias("unidades"), F.count_if(flagged).cast("double").alias("marcados"), r6(100 * F.count("lat") / F.count("*")).alias("cobertura_pct"),
        r6(100 * F.median(F.abs("brecha"))).alias("error_mediano_pct"), r6(100 * F.avg(F.when(flagged, drop))).alias("bajaron_marcados_pct"), r6(100 * F.avg(F.when(~flagged, drop))).alias("bajaron_resto_pct"),
    )
    return one.unpivot([], one.columns, "indicador", "valor")


# --- inference -------------------------------------------------------------------------------------------------------


@query(f"""{_GAP} , b as (select count(*) filter (where brecha < -0.25) as k, count(*) filter (where brecha < -0.25 or brecha > 0.25) as n from f), tt as (select exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2)) as p from b, range(0, 100000000) r(i) where i >= k and i <= n)
  select any_value(b.k) as debajo, any_value(b.n) - any_value(b.k) as encima, round(any_value(x.p), 6) as p from b, (select sum(p) as p from tt) x""".replace("range(0, 100000000) r(i) where i >= k and i <= n", "(select unnest(range(k, n + 1)) as i from b) r where true"))
def tail_binomial(spark, sf):
    """Are gaps below as frequent as gaps above? The exact one-sided binomial tail (I8)."""
    rows = gaps(spark, sf, only=()).agg(F.count_if(F.col("brecha") < -0.25).alias("k"), F.count_if(F.abs("brecha") > 0.25).alias("n"))
    return stats.binomial_tail(rows).select(F.col("k").alias("debajo"), (F.col("n") - F.col("k")).alias("encima"), r6("p").alias("p"))


@query(f"""{_GAP}, e as (select quantile_cont(precio_m2_usd, [1/3::double, 2/3::double]) as q from f), m as (select median(ln(1 + brecha)) as med from f), sd as (select 1.4826 * median(abs(ln(1 + brecha) - med)) as s, any_value(med) as med from f, m),
  x as (select 1 + len(list_filter(q, lambda y: y < precio_m2_usd)) as tercil, ln(1 + brecha) as g from f, e), u as (select unnest([0.1, 0.2, 0.3]::double[]) as t)
  select tercil::int as tercil, t as umbral, round(avg((g < -t)::int::double), 6) as debajo, round(avg((g > t)::int::double), 6) as encima, count(*) as n, round(any_value(-t / s), 6) as z from x, u, sd group by 1, 2""")
def tail_asymmetry(spark, sf):
    """Shares beyond thresholds on either side, by price tercile, and the threshold in robust deviations."""
    rows = stats.quantile_bins(gaps(spark, sf, only=()).select("precio_m2_usd", F.log(1 + F.col("brecha")).alias("g")), "precio_m2_usd", 3, "tercil")
    middle = rows.agg(F.median("g").alias("med"))
    spread = rows.crossJoin(F.broadcast(middle)).agg((1.4826 * F.median(F.abs(F.col("g") - F.col("med")))).alias("s"))
    rows = rows.crossJoin(F.broadcast(spread)).withColumn("umbral", F.explode(F.array(F.lit(0.1), F.lit(0.2), F.lit(0.3))))
    g, t = F.col("g"), F.col("umbral")
    return rows.groupBy("tercil", "umbral").agg(r6(F.avg((g < -t).cast("double"))).alias("debajo"), r6(F.avg((g > t).cast("double"))).alias("encima"), F.count("*").alias("n"), r6(F.first(-t / F.col("s"))).alias("z"))


@query(f"""{_SURVEYS}, c as (select length(clave_unidad) % 2 = 0 as marcado, coalesce(same, again) / precio_usd - 1 as cambio from j where coalesce(same, again) is not null)
  select marcado, count(*) as n, round(100 * avg((cambio < -0.005)::int::double), 6) as bajaron_pct, round(100 * avg((cambio > 0.005)::int::double), 6) as subieron_pct, round(median(cambio), 6) as mediana, round(avg(cambio), 6) as media from c group by 1""")
def price_change_by_flag(spark, sf):
    """Price changes between surveys by a flag."""
    rows = clean.snapshot_diff(*surveys(spark, sf)).filter("cambio_precio is not null").withColumn("marcado", F.length("clave_unidad") % 2 == 0)
    share = lambda c: r6(100 * F.avg(F.col(c).cast("double")))
    return rows.groupBy("marcado").agg(F.count("*").alias("n"), share("bajo_en_r2").alias("bajaron_pct"), share("subio_en_r2").alias("subieron_pct"), r6(F.median("cambio_precio")).alias("mediana"), r6(F.avg("cambio_precio")).alias("media"))


# --- pages and exports -----------------------------------------------------------------------------------------------


def cards(spark, sf) -> DataFrame:
    """Listings as the cards of result pages, one page for each subzone."""
    rows = listings(spark, sf).filter("subzona is not null")
    card = F.concat(
        F.lit('<li class="ui-search-layout__item"><a class="poly-component__title" href="'), "link", F.lit('">  '), "titulo", F.lit(' </a><div class="poly-component__price">'),
        F.when(F.col("partkey") % 3 == 0, F.lit("Desde ")).otherwise(""), F.lit("US$ "), F.floor("precio_usd").cast("string"), F.lit('</div><div class="poly-component__attributes-list"><ul><li>'),
        F.col("ambientes").cast("int").cast("string"), F.lit(" ambs.</li><li> 2 a 3 baños</li><li>"), F.col("m2_final").cast("int").cast("string"), F.lit(" - 999 m²</li></ul></div></li>"),
    )
    return rows.groupBy(F.concat("subzona", F.lit("-"), (F.col("orderkey") % 97).cast("string")).alias("page_id")).agg(F.concat_ws("", F.lit("<html><ol>"), F.collect_list(card), F.lit("</ol></html>")).alias("html"))


@query(""" select link, 'USD' as moneda, floor(precio_usd)::double as monto, partkey % 3 = 0 as desde, ambientes, 2::double as banos, floor(m2_final)::double as m2, trim(regexp_replace(titulo, '\\s+', ' ', 'g')) as titulo from listings where subzona is not null""")
def page_cards(spark, sf):
    """Ads read from the cards of result pages (SRC15, F3, F4, F9)."""
    return pages.cards(cards(spark, sf), "html").select("link", "moneda", "monto", "desde", "ambientes", "banos", "m2", "titulo")


@query(""" select link, 'superficie_total' as caracteristica, (superficie_total::bigint)::varchar || ' m²' as valor from listings where superficie_total is not null union all
  select link, 'antiguedad', (antiguedad::bigint)::varchar || ' años' from listings where antiguedad is not null union all select link, 'disposicion', disposicion from listings where disposicion is not null""")
def page_characteristics(spark, sf):
    """Characteristics read from the tables of detail pages, as label and value (SRC16, F10)."""
    return pages.characteristics(details(spark, sf), "link", "html")


def details(spark, sf) -> DataFrame:
    line = lambda label, value: F.when(value.isNotNull(), F.concat(F.lit(f'<tr class="andes-table__row"><th><div class="andes-table__header__container">{label}</div></th><td><span class="andes-table__column--value">'), value, F.lit("</span></td></tr>")))
    whole = lambda c, unit: F.concat(F.col(c).cast("long").cast("string"), F.lit(unit))
    body = F.concat_ws("", line("Superficie total", whole("superficie_total", " m²")), line("Antigüedad", whole("antiguedad", "&nbsp;años")), line("Disposición", F.col("disposicion")))
    return listings(spark, sf).select("link", F.concat(F.lit("<table>"), body, F.lit("</table>")).alias("html"))


@query(f"""{_PLACES}, l as (select 'estacion' as capa, lat, lon from est union all select 'aviso', lat, lon from pts where lat > -34.65) select capa, count(*) as n, round(sum(round_even(lat, 4)), 4) as lat, round(sum(round_even(lon, 4)), 4) as lon from l group by 1""")
def layered_points(spark, sf):
    """Points of several layers with rounded coordinates, one JSON list for each layer (SNK6), read back."""
    points = spatial.distinct_points(listings(spark, sf)).filter("lat > -34.65")
    layers = profile.layers({"estacion": stations(spark, sf), "aviso": points})
    back = layers.select("capa", F.explode(F.from_json("puntos", "array<struct<lat:double,lon:double>>")).alias("p"))
    return back.groupBy("capa").agg(F.count("*").alias("n"), r4(F.sum("p.lat")).alias("lat"), r4(F.sum("p.lon")).alias("lon"))


@query(f"""{_GAP}, u as (select unidad, count(*) as avisos, round_even(round(min(brecha), 9), 2) as brecha_min, min(id_aviso) as primero from f group by 1) select unidad, avisos, brecha_min, primero from u""")
def unit_documents(spark, sf):
    """One JSON document per unit with its ads as an array (SNK3, R7), read back."""
    documents = profile.unit_documents(gaps(spark, sf))
    shape = "struct<unidad:string,brecha_min:double,avisos:array<struct<id_aviso:string,url:string,precio_usd:double>>>"
    back = documents.select(F.from_json("documento", shape).alias("d")).select("d.*")
    return back.select("unidad", F.size("avisos").cast("long").alias("avisos"), "brecha_min", F.array_min("avisos.id_aviso").alias("primero"))


@query(f"""{_GAP}, m as (select unidad, arg_min(id_aviso, (precio_m2_usd, id_aviso)) as id_aviso, min(brecha) as b from f group by 1), o as (select id_aviso, round_even(round(100 * b, 8), 1) as brecha_pct, row_number() over (order by b, id_aviso) as posicion from m where b < -0.25) select posicion, id_aviso, brecha_pct from o""")
def official_list(spark, sf):
    """The official list: flagged units by gap, with place and rounded percentages (SNK2, T2)."""
    units = gaps(spark, sf).groupBy("unidad").agg(F.min_by("id_aviso", F.struct("precio_m2_usd", "id_aviso")).alias("id_aviso"), F.min("brecha").alias("brecha"))
    return profile.official(units.filter(F.col("brecha") < -0.25), "brecha", "id_aviso", percent=["brecha"]).select(F.col("posicion").cast("long"), "id_aviso", "brecha_pct")


@query(f"""{_GAP}, m as (select barrio, median(precio_m2_usd) as m, count(*) as n from f group by 1) select 'avisos' as clave, (select count(*) from f)::double as valor union all select 'barrios', count(*) from m union all select 'max_mediana', round_even(max(m), 2) from m union all select 'embudo_0', (select count(*) from f) union all select 'embudo_1', (select count(*) from f where brecha < -0.25)""")
def summary_document(spark, sf):
    """The summary as one JSON document of indicators, funnel and neighbourhoods (SNK4, SNK7), read back."""
    document = profile.summary_document(gaps(spark, sf), [("analizados", F.lit(True)), ("marcado", F.col("brecha") < -0.25)])
    shape = "struct<avisos:long,embudo:array<struct<paso:string,avisos:long>>,barrios:array<struct<barrio:string,mediana:double>>>"
    d = document.select(F.from_json("documento", shape).alias("d")).select("d.*")
    named = {"avisos": F.col("avisos"), "barrios": F.size("barrios"), "max_mediana": F.array_max("barrios.mediana"), **{f"embudo_{i}": F.col("embudo")[i]["avisos"] for i in range(2)}}
    rows = F.array(*(F.struct(F.lit(k).alias("clave"), v.cast("double").alias("valor")) for k, v in named.items()))
    return d.select(F.explode(rows).alias("r")).select("r.*")
