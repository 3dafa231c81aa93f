"""Profiles, searches and documents made from listings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from predial.functions import text
from predial.operators.clean import join_one_to_one, truth


def columns(rows: DataFrame) -> DataFrame:
    """(columna, distintos, nulos_pct, constante, clase) for each text column, in one pass."""
    measures = []
    for c in rows.columns:
        v = F.col(c)
        only, yes, no = F.bool_and(v == "Sí"), F.bool_or(v == "Sí"), F.bool_or(v == "No")
        kind = F.when(truth(only), "solo_si").when(truth(yes) & truth(no), "si_no").otherwise("otro")
        n = F.count_distinct(v)
        measures.append(F.struct(F.lit(c).alias("columna"), n.alias("distintos"), F.round(100 * F.avg(v.isNull().cast("double")), 4).alias("nulos_pct"), (n <= 1).alias("constante"), kind.alias("clase")).alias(c))
    one = rows.agg(*measures)
    return one.select(F.explode(F.array(*one.columns)).alias("m")).select("m.*")


def search(
    rows: DataFrame, place: str | None = None, kind: str | None = None, rooms: int | None = None, most_price: float | None = None, size: tuple | None = None, state: str | None = None,
    level: str | None = None, without_risk: bool = False, gap_under: float | None = None,
) -> DataFrame:
    """rows that meet all given facets (P18); five rooms mean five or more."""
    asked = {
        place: lambda: F.col("barrio") == place, kind: lambda: F.col("tipo") == kind, state: lambda: text.first_rule(F.col("titulo"), text.STATES, "sin_marca") == state,
        level: lambda: F.col("nivel_decision") == level,
    }
    found = [condition() for value, condition in asked.items() if value is not None]
    if rooms is not None:
        found.append(F.col("ambientes") >= 5 if rooms >= 5 else F.col("ambientes") == rooms)
    if most_price is not None:
        found.append(F.col("precio_usd") <= most_price)
    if size is not None:
        found.append(F.col("m2_final").between(*size))
    if gap_under is not None:
        found.append(F.col("brecha") < gap_under)
    if without_risk:
        found.append(text.risk_labels(F.col("titulo"), True) == "")
    return rows.filter(reduce(lambda a, b: a & b, found)) if found else rows


def chained(rows: DataFrame, key: str, others: list[DataFrame | None]) -> DataFrame:
    """rows with the columns of several tables of at most one row per key (J18); tables that are not there are left out
    (SRC11)."""
    return reduce(lambda a, b: join_one_to_one(a, b, key), (o for o in others if o is not None), rows)


def summary(rows: DataFrame, listed: Column, candidate: Column) -> DataFrame:
    """One row per neighbourhood of all ads and of the listed ones."""
    part = F.when(listed, F.col("brecha"))
    out = rows.groupBy("barrio").agg(
        F.count("*").alias("avisos"), F.count_distinct("unidad").alias("unidades"), F.count("lat").alias("con_coordenadas"), F.count_if(listed).alias("senales"), F.count_if(listed & candidate).alias("candidatos"),
        F.bround(F.median("precio_m2_usd"), 0).alias("precio_m2_mediano"), F.bround(F.round(100 * F.median(F.abs("brecha")), 8), 1).alias("error_mediano_pct"), F.bround(F.round(100 * F.median(part), 8), 2).alias("brecha_mediana_pct"),
    )
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("senales", "candidatos")})


def safe(value: Column, digits: int = 2) -> Column:
    """A number for JSON: NaN becomes null, others are rounded half to even (SNK7)."""
    return F.bround(F.when(~F.isnan(value), value), digits)


def layers(points: dict[str, DataFrame], digits: int = 4) -> DataFrame:
    """(capa, puntos): each layer's points as one JSON list (SNK6). Layers are for a map and small."""
    one = [p.select(F.lit(name).alias("capa"), F.struct(safe(F.col("lat"), digits).alias("lat"), safe(F.col("lon"), digits).alias("lon")).alias("p")) for name, p in points.items()]
    return reduce(DataFrame.unionByName, one).groupBy("capa").agg(F.to_json(F.sort_array(F.collect_list("p"))).alias("puntos"))


def unit_documents(rows: DataFrame) -> DataFrame:
    """(unidad, documento): a JSON document per unit with an array of its ads (SNK3)."""
    ad = F.struct("id_aviso", text.url_base(F.col("link")).alias("url"), safe(F.col("precio_usd")).alias("precio_usd"))
    out = rows.groupBy("unidad").agg(safe(F.round(F.min("brecha"), 9)).alias("brecha_min"), F.sort_array(F.collect_list(ad)).alias("avisos"))
    return out.select("unidad", F.to_json(F.struct("unidad", "brecha_min", "avisos"), {"ignoreNullFields": "false"}).alias("documento"))


def official(units: DataFrame, gap: str, key: str, percent: list[str]) -> DataFrame:
    """units by gap with their place from 1 and shares as percentages of one digit (SNK2). A final list, of some thousand
    rows: its places are counted in one task."""
    out = units.withColumns({f"{c}_pct": F.bround(F.round(100 * F.col(c), 8), 1) for c in percent})
    return out.withColumn("posicion", F.row_number().over(Window.orderBy(gap, key)))


def summary_document(rows: DataFrame, steps: list[tuple[str, Column]]) -> DataFrame:
    """One row with a JSON document: ads, funnel and neighbourhoods (SNK4)."""
    passed, counts = F.lit(True), []
    for name, condition in steps:
        passed = passed & truth(condition)
        counts.append(F.struct(F.lit(name).alias("paso"), F.count_if(passed).alias("avisos")))
    one = rows.agg(F.count("*").alias("avisos"), F.array(*counts).alias("embudo"))
    places = rows.groupBy("barrio").agg(safe(F.median("precio_m2_usd")).alias("mediana")).agg(F.sort_array(F.collect_list(F.struct("barrio", "mediana"))).alias("barrios"))
    return one.crossJoin(F.broadcast(places)).select(F.to_json(F.struct("avisos", "embudo", "barrios"), {"ignoreNullFields": "false"}).alias("documento"))
