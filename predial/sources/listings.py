"""Listings: flat priced records, read from files or derived from the star schema."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TITLE_MARKS = (
    " a reciclar", " a estrenar", " con renta", " en pozo", " a refaccionar", " reciclado a nuevo", " compro urgente", " ideal refacción",
    " en alquiler", " oficina comercial", " tipo casa", " deptos unidos", " unidades en block", " anticipo y cuotas", " boleto", " ocupado",
    " villa 31", " PH al frente", " calle Nation_7", " junto a Nation_11",
)
YES_NO = ("apto_credito", "balcon", "pileta", "gimnasio", "parrilla", "ascensor")


def tables(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    return [spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in names]


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per line item, seen as a listing: its supplier's nation is the neighbourhood, quantity the size.

    The dimension tables are joined on their keys; Spark broadcasts those that are small enough and prunes the columns
    that a query does not use.
    """
    line, orders, part, supplier, nation = tables(spark, sf_dir, "lineitem", "orders", "part", "supplier", "nation")
    rows = (
        line.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(part, F.col("l_partkey") == F.col("p_partkey"))
        .join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    )
    number = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    double = lambda x: x.cast("double")
    unless = lambda key, n, value: F.when(F.col(key) % n != 0, value)
    mark = F.lit("")
    for i, words in enumerate(TITLE_MARKS):
        mark = F.when(F.col("l_orderkey") % 29 == i, words).otherwise(mark)
    title = F.concat(F.when(F.col("l_orderkey") % 29 == 25, "Compro ").otherwise(""), "p_name", mark)
    yes_no = {
        name: F.when(F.col("l_partkey") % (3 + i) == 0, "Sí").when(F.col("l_partkey") % (3 + i) == 1, "No")
        for i, name in enumerate(YES_NO)
    }
    return rows.select(
        F.concat(F.lit("MLA"), number.cast("string")).alias("id_aviso"),
        F.concat(F.lit("https://x.example/MLA-"), number.cast("string"), F.lit("?s="), F.col("l_suppkey").cast("string"), F.lit("&p="), F.col("l_partkey").cast("string")).alias("link"),
        F.col("n_name").alias("barrio"),
        unless("l_suppkey", 7, F.concat("n_name", F.lit("_"), (F.col("l_partkey") % 3).cast("string"))).alias("subzona"),
        F.col("l_extendedprice").alias("precio_usd"),
        F.col("l_quantity").alias("m2_final"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("precio_m2_usd"),
        F.concat(F.lit("calle "), F.col("l_partkey").cast("string")).alias("dir_limpia"),
        double(1 + F.col("p_size") % 6).alias("ambientes"),
        double(F.col("p_size") % 5).alias("dormitorios"),
        unless("l_partkey", 4, double(1 + F.col("l_linenumber") % 3)).alias("banos"),
        double(F.col("l_linenumber") % 2).alias("cocheras"),
        unless("l_suppkey", 3, double(F.col("l_partkey") % 23)).alias("piso"),
        double(F.col("l_suppkey") % 19).alias("pisos_edificio"),
        unless("l_partkey", 5, double(F.col("p_size") * 2)).alias("antiguedad"),
        unless("l_partkey", 6, double(20 + F.col("l_orderkey") % 180)).alias("expensas_usd"),
        *(expr.alias(name) for name, expr in yes_no.items()),
        title.alias("titulo"),
        (F.col("l_orderkey") % 17 == 3).alias("en_construccion"),
        F.when(F.col("l_partkey") % 3 == 0, "Frente").when(F.col("l_partkey") % 3 == 1, "Contrafrente").alias("disposicion"),
        F.when(F.col("l_suppkey") % 2 == 0, double(F.col("l_quantity") + 12)).alias("superficie_total"),
        F.when(F.col("l_linenumber") == 7, "$").when(F.col("l_linenumber") < 6, "USD").alias("moneda"),
        double(F.lit(-34.70) + 0.004 * (F.col("l_suppkey") % 37)).alias("lat"),
        double(F.lit(-58.52) + 0.004 * (F.col("l_partkey") % 41)).alias("lon"),
        (F.col("l_suppkey") % 2 == 0).alias("barrio_oficial"),
        F.col("l_orderkey").alias("orderkey"),
        F.col("l_partkey").alias("partkey"),
        F.col("l_suppkey").alias("suppkey"),
        F.col("l_linenumber").alias("linenumber"),
    )


_MARKS = " ".join(f"when {i} then '{x}'" for i, x in enumerate(TITLE_MARKS))
_YES_NO = ", ".join(f"case l_partkey % {3 + i} when 0 then 'Sí' when 1 then 'No' end as {x}" for i, x in enumerate(YES_NO))
#: The same view for DuckDB.
LISTINGS_SQL = f"""listings as (
  select 'MLA' || (l_orderkey * 10 + l_linenumber) as id_aviso,
    'https://x.example/MLA-' || (l_orderkey * 10 + l_linenumber) || '?s=' || l_suppkey || '&p=' || l_partkey as link,
    n_name as barrio, case when l_suppkey % 7 <> 0 then n_name || '_' || (l_partkey % 3) end as subzona,
    l_extendedprice as precio_usd, l_quantity as m2_final, l_extendedprice / l_quantity as precio_m2_usd,
    'calle ' || l_partkey as dir_limpia, (1 + p_size % 6)::double as ambientes, (p_size % 5)::double as dormitorios,
    case when l_partkey % 4 <> 0 then (1 + l_linenumber % 3)::double end as banos, (l_linenumber % 2)::double as cocheras,
    case when l_suppkey % 3 <> 0 then (l_partkey % 23)::double end as piso, (l_suppkey % 19)::double as pisos_edificio,
    case when l_partkey % 5 <> 0 then (p_size * 2)::double end as antiguedad,
    case when l_partkey % 6 <> 0 then (20 + l_orderkey % 180)::double end as expensas_usd, {_YES_NO},
    case l_orderkey % 29 when 25 then 'Compro ' else '' end || p_name || case l_orderkey % 29 {_MARKS} else '' end as titulo,
    l_orderkey % 17 = 3 as en_construccion, case l_partkey % 3 when 0 then 'Frente' when 1 then 'Contrafrente' end as disposicion,
    case when l_suppkey % 2 = 0 then (l_quantity + 12)::double end as superficie_total,
    case when l_linenumber = 7 then '$' when l_linenumber < 6 then 'USD' end as moneda,
    -34.70::double + 0.004::double * (l_suppkey % 37) as lat, -58.52::double + 0.004::double * (l_partkey % 41) as lon,
    l_suppkey % 2 = 0 as barrio_oficial, l_orderkey as orderkey, l_partkey as partkey, l_suppkey as suppkey,
    l_linenumber as linenumber
  from lineitem join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey
    join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey)"""


def read_tsv(spark: SparkSession, path: str, glob: str = "*.tsv", exclude: str | None = "parcial", schema: T.StructType | None = None) -> DataFrame:
    """Tab-separated files of a folder (SRC1-SRC4): every column text unless schema says otherwise, with pos.

    Files whose name holds exclude are left out; files with other columns are united by name. pos orders rows by file name
    and place in the file.
    """
    reader = spark.read.option("sep", "\t").option("header", True).option("pathGlobFilter", glob)
    if schema is not None:
        rows = reader.schema(schema).csv(path)
        return _with_pos(rows, exclude)
    names = reader.csv(path).select(F.input_file_name().alias("f")).distinct()
    files = sorted(r.f for r in names.collect())  # one name per file
    parts = [spark.read.option("sep", "\t").option("header", True).csv(f) for f in files if not exclude or exclude not in f.rsplit("/", 1)[-1]]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (_with_pos(p, None) for p in parts))


def _with_pos(rows: DataFrame, exclude: str | None) -> DataFrame:
    rows = rows.withColumn("pos", F.struct(F.col("_metadata.file_name").alias("file"), F.monotonically_increasing_id().alias("row")))
    return rows.filter(~F.col("pos.file").contains(exclude)) if exclude else rows


def read_permits(spark: SparkSession, path: str) -> DataFrame:
    """Semicolon CSV with a byte order mark, day-first times and WKT points (SRC5, F20)."""
    rows = spark.read.option("sep", ";").option("header", True).csv(path)
    rows = rows.toDF(*(c.lstrip("﻿") for c in rows.columns))
    point = lambda i: F.nullif(F.regexp_extract("wkt_2", r"POINT\s*\((-?[\d.]+) (-?[\d.]+)\)", i), F.lit("")).cast("double")
    return rows.withColumns({"fecha": F.to_timestamp("fecha", "dd/MM/yyyy HH:mm"), "lat": point(2), "lon": point(1)})


_GEOMETRY = "features array<struct<geometry:struct<type:string,coordinates:string>,properties:map<string,string>>>"


def read_points(spark: SparkSession, path: str, exclude: tuple[str, str] | None = None) -> DataFrame:
    """Points of a GeoJSON file as (properties, lat, lon) (SRC6, SRC8): other shapes are ignored; exclude: (property, regex)."""
    found = spark.read.schema(_GEOMETRY).option("multiLine", True).json(path).select(F.explode("features").alias("f"))
    found = found.filter(F.col("f.geometry.type") == "Point")
    pair = F.from_json("f.geometry.coordinates", "array<double>")
    found = found.filter(F.size(pair) >= 2).select("f.properties", pair[1].alias("lat"), pair[0].alias("lon"))
    if exclude:
        found = found.filter(~F.coalesce(F.col("properties")[exclude[0]].rlike(exclude[1]), F.lit(False)))
    return found


def check_bounds(points: DataFrame, lat: tuple[float, float], lon: tuple[float, float]) -> DataFrame:
    """points, after making sure that all lie within the bounds (SRC9)."""
    inside = F.col("lat").between(*lat) & F.col("lon").between(*lon)
    outside = points.filter(~F.coalesce(inside, F.lit(False))).limit(1).count()
    if outside:
        raise ValueError("points lie outside the region")
    return points


def read_polygon_edges(spark: SparkSession, path: str) -> DataFrame:
    """Edges of a GeoJSON file's polygons (SRC7): properties, poly_id, ring, x1, y1, x2, y2 in the file's coordinates."""
    found = spark.read.schema(_GEOMETRY).option("multiLine", True).json(path).select(F.posexplode("features").alias("poly_id", "f"))
    one = F.array(F.from_json("f.geometry.coordinates", "array<array<array<double>>>"))
    many = F.from_json("f.geometry.coordinates", "array<array<array<array<double>>>>")
    shape = F.when(F.col("f.geometry.type") == "Polygon", one).when(F.col("f.geometry.type") == "MultiPolygon", many)
    rings = found.select("poly_id", "f.properties", F.posexplode(F.flatten(shape)).alias("ring", "points"))
    n = F.size("points")
    edges = F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.struct(F.element_at("points", i).alias("a"), F.element_at("points", i + 1).alias("b")))
    edges = rings.filter(n > 1).select("poly_id", "properties", "ring", F.explode(edges).alias("e"))
    return edges.select("poly_id", "properties", "ring", *(F.col(f"e.{p}")[i].alias(f"{x}{1 if p == 'a' else 2}") for p in "ab" for i, x in enumerate("xy")))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of records (SRC13)."""
    return spark.read.option("multiLine", True).json(path)
