"""Cleaning: deduplication, scope, flags."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from predial.functions import text

def truth(condition: Column) -> Column:
    """A condition with null as false."""
    return F.coalesce(condition, F.lit(False))


def deduplicate(rows: DataFrame, key: str, preferred: Column, pos: str) -> DataFrame:
    """Every row with kept, first_pos and reason.

    Of rows with equal key the first preferred one (else the first) is kept, at the place where the key first appears; a
    dropped row that was not preferred while the kept one was is marked as such.
    """
    order = Window.partitionBy(key).orderBy(F.when(truth(preferred), 0).otherwise(1), pos)
    whole = Window.partitionBy(key)
    rows = rows.withColumns({"_ok": truth(preferred), "_n": F.row_number().over(order), "first_pos": F.min(pos).over(whole)})
    rows = rows.withColumn("_any", F.max(F.col("_ok").cast("int")).over(whole) == 1)
    reason = F.when(F.col("_n") > 1, F.when(F.col("_any") & ~F.col("_ok"), "duplicado_barrio_no_oficial").otherwise("duplicado"))
    return rows.withColumns({"kept": F.col("_n") == 1, "reason": reason}).drop("_n", "_ok", "_any")


#: Limits of what is in scope.
MIN_PRICE, MAX_PRICE_M2, M2 = 20_000, 50_000, (15, 1000)


def exclusion_reason(price: Column, currency: Column, size: Column, title: Column, unbuilt: Column, min_price: float = MIN_PRICE, max_price_m2: float = MAX_PRICE_M2) -> Column:
    """Why a row is out of scope, the first reason that holds; null if it is in (P4). A null currency is not USD; size: that
    of surface_choice(), null where there is no usable one."""
    return (
        F.when(~currency.eqNullSafe("USD"), "precio_en_pesos")
        .when(truth(unbuilt), "en_pozo")
        .when(price < min_price, "precio_menor_a_minimo")
        .when(size.isNull(), "superficie_invalida")
        .when(price / size > max_price_m2, "precio_imposible")
        .when(F.lower(F.coalesce(title, F.lit(""))).rlike(text.NOT_A_SALE), "no_es_venta")
    )


def surface_choice(listed: Column, total: Column, m2: tuple = M2) -> tuple[Column, Column]:
    """The surface to use and where it comes from."""
    value = F.when(listed.between(*m2), listed).when(total.between(*m2), total)
    origin = F.when(listed.between(*m2), "listado").when(total.between(*m2), "recuperada_de_total").otherwise("invalida")
    return value, origin


#: Numbers that stand for a missing one, by column, and labels with two spellings.
SENTINELS = {"departamentos_por_piso": 99.0, "piso": 99.0, "ambientes": 0.0, "banos": 0.0}
LABELS = {"24 hs": "24 horas", "Penthhouse": "Penthouse"}


def without_sentinels(rows: DataFrame, sentinels: dict[str, float] = SENTINELS) -> DataFrame:
    """Numbers that stand for a missing one become null."""
    return rows.withColumns({c: F.nullif(F.col(c), F.lit(v)) for c, v in sentinels.items() if c in rows.columns})


def unified(label: Column, labels: dict[str, str] = LABELS) -> Column:
    """One spelling for each label."""
    known = F.create_map(*(F.lit(x) for pair in labels.items() for x in pair))
    return F.coalesce(known[label], label)


def floor_number(c: Column) -> Column:
    """A floor given as a unit number: 1204 is floor 12."""
    return F.when(c < 100, c).otherwise(F.floor(c / 100).cast("double"))


def incoherences(rows: DataFrame) -> DataFrame:
    """Flags of columns that contradict each other."""
    rooms = truth((F.col("dormitorios") >= F.col("ambientes")) & (F.col("ambientes") > 1))
    floor = truth((F.col("pisos_edificio") >= 3) & (F.col("piso") > F.col("pisos_edificio")))
    return rows.withColumns({"incoherencia_ambientes": rooms, "incoherencia_piso": floor})


#: Age bands, and the yes/no columns that count as features.
AGE_BANDS = ((0, 5), (6, 15), (16, 30), (31, 50), (51, 70))
EXTRAS = ("balcon", "pileta", "gimnasio", "parrilla", "ascensor", "terraza", "seguridad", "sum", "jardin", "lavadero", "baulera")


def features(rows: DataFrame) -> DataFrame:
    """Model features: clipped and filled numbers with indicators, age bands, yes/no as 1/0 (P11). Names begin with f_; yes/no
    columns that rows lack are left out."""
    age, rooms = F.col("antiguedad"), F.coalesce("ambientes", F.col("dormitorios") + 1)
    yes = lambda c: truth(F.col(c) == "Sí").cast("double")
    return rows.withColumns(
        {
            "f_log_m2": F.log("m2_final"),
            # least() passes nulls over, so they are looked at first.
            "f_ambientes": F.when(rooms.isNotNull(), F.least(rooms, F.lit(6.0))),
            "f_banos": F.least(F.coalesce("banos", F.lit(1.0)), F.lit(4.0)),
            "f_banos_falta": F.col("banos").isNull().cast("double"),
            "f_cochera": truth(F.col("cocheras") > 0).cast("double"),
            **{f"f_edad_{a}_{b}": truth(age.between(a, b)).cast("double") for a, b in AGE_BANDS},
            "f_edad_falta": age.isNull().cast("double"),
            "f_piso": F.when(F.col("piso").isNull(), 0.0).otherwise(F.least("piso", F.lit(20.0))),
            "f_piso_falta": F.col("piso").isNull().cast("double"),
            "f_contrafrente": truth(F.col("disposicion") == "Contrafrente").cast("double"),
            **{f"f_{c}": yes(c) for c in (*EXTRAS, "apto_credito") if c in rows.columns},
        }
    )


def extended_features(rows: DataFrame) -> DataFrame:
    """features() and what the title says (P12): its state (none is the base), a tenant, houses; and log size by age."""
    flags, state = text.title_flags(F.col("titulo")), text.first_rule(F.col("titulo"), text.STATES, "sin_marca")
    more = {f"f_estado_{name}": (state == name).cast("double") for name, _ in text.STATES}
    more |= {f"f_{c}": flags[c].cast("double") for c in ("titulo_casa", "titulo_tipo_casa")}
    more["f_inquilino"] = text.risk_flags(F.col("titulo"))["riesgo_con_inquilino"].cast("double")
    rows = features(rows).withColumns(more)
    return rows.withColumns({f"f_m2_x_edad_{a}_{b}": F.col("f_log_m2") * F.col(f"f_edad_{a}_{b}") for a, b in AGE_BANDS})


def entry_errors(rows: DataFrame, limits: tuple[Column, Column]) -> DataFrame:
    """Signs that an ad's data were entered wrongly (P14): senal_*, and senal_error_carga for any. limits: the first and last
    percentile of the size per room; a size per room that is null counts as outside."""
    rooms = F.greatest(F.coalesce("ambientes", F.col("dormitorios") + 1), F.lit(1.0))
    rooms = F.when(F.coalesce("ambientes", F.col("dormitorios") + 1).isNotNull(), rooms)
    signs = {
        "senal_m2_por_ambiente": ~truth((F.col("m2_final") / rooms).between(*limits)),
        "senal_superficie_recuperada": truth(F.col("m2_origen") == "recuperada_de_total"),
        "senal_dormitorios": truth(F.col("incoherencia_ambientes")), "senal_piso": truth(F.col("incoherencia_piso")),
        "senal_alquiler": text.title_flags(F.col("titulo"))["menciona_alquiler"],
    }
    rows = rows.withColumns(signs)
    return rows.withColumn("senal_error_carga", reduce(lambda a, b: a | b, map(F.col, signs)))


def m2_per_room() -> Column:
    """Size per room, null without rooms and bedrooms."""
    rooms = F.coalesce("ambientes", F.col("dormitorios") + 1)
    return F.when(rooms.isNotNull(), F.col("m2_final") / F.greatest(rooms, F.lit(1.0)))


def exclusions(rows: DataFrame, places: list[str], manual: DataFrame | None = None) -> DataFrame:
    """rows with exclusiones: why an ad is not shown among the best, in order; empty if it is (P20, SRC14).

    manual: id_aviso, motivo_manual, a small list of reviewed ads. A place is doubtful where an ad without coordinates
    names another one.
    """
    t, use = text.title_flags(F.col("titulo")), text.use_flags(F.col("titulo"))
    popular = t["titulo_barrio_popular"] | truth(F.col("en_barrio_popular"))
    doubtful = F.col("lat").isNull() & (F.size(text.other_names(F.col("titulo"), F.col("barrio"), places)) > 0)
    reasons = [
        ("barrio popular", popular), ("a menos de 500 m de un barrio popular", ~popular & truth(F.col("dist_barrio_popular_m") < 500)),
        ("casa", t["titulo_casa"] | t["titulo_tipo_casa"]), ("PH", use["ph"]), ("uso comercial u oficina", use["otro_uso"]),
        ("barrio dudoso", doubtful), ("posible venta de varias unidades", use["varias_unidades"]),
        ("precio posiblemente con financiación", use["con_financiacion"]),
        ("en pozo: precio no comparable con usados", text.risk_flags(F.col("titulo"))["riesgo_en_pozo"]),
    ]
    found = [F.when(c, F.lit(name)) for name, c in reasons]
    if manual is not None:
        rows = rows.join(F.broadcast(manual.select("id_aviso", "motivo_manual")), "id_aviso", "left")
        found.append(F.concat(F.lit("revisión manual: "), F.col("motivo_manual")))
    rows = rows.withColumn("exclusiones", F.array_compact(F.array(*found)))
    return rows.drop("motivo_manual")


def completeness(columns: list[str]) -> Column:
    """The share of columns that are not null."""
    return reduce(lambda a, b: a + b, (F.col(c).isNotNull().cast("int") for c in columns)) / len(columns)


def effective_floor(rows: DataFrame, unit: str, floor: str, name: str) -> DataFrame:
    """rows with the floor, or where it is null the only one that the unit's other rows give."""
    whole = Window.partitionBy(unit)
    only = F.when(F.min(floor).over(whole) == F.max(floor).over(whole), F.min(floor).over(whole))
    return rows.withColumn(name, F.coalesce(F.col(floor), only))


def without_doubtful_geocodes(rows: DataFrame, doubtful: Column, prefixes: tuple[str, ...] = ("dist_", "area_verde", "permisos_obra")) -> DataFrame:
    """Coordinates, subzone and every spatial column to null where the geocode is doubtful."""
    names = [c for c in rows.columns if c in ("lat", "lon", "subzona") or c.startswith(prefixes)]
    return rows.withColumns({c: F.when(~truth(doubtful), F.col(c)) for c in names})


def keep_one(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in an order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")


def duplicate_groups(rows: DataFrame, keys: list[str], needed: str) -> Column:
    """True for all members of groups with equal keys, nulls equal, where needed is not null."""
    return F.col(needed).isNotNull() & (F.count("*").over(Window.partitionBy(*keys)) > 1)


def snapshot_diff(first: DataFrame, second: DataFrame, dead_band: float = 0.005, more: tuple[str, ...] = ()) -> DataFrame:
    """What became of each ad of the first survey in the second (J5, J6): sigue, republicado or salio, and its price change.

    Both: id_aviso, clave_unidad, precio_usd, one row per id. Only new ads of the second survey count as republications. more:
    further columns of the first survey to keep.
    """
    same = second.select("id_aviso", F.col("precio_usd").alias("_same"))
    new = second.join(first.select("id_aviso"), "id_aviso", "left_anti").filter(F.col("clave_unidad").isNotNull())
    again = new.groupBy("clave_unidad").agg(F.min("precio_usd").alias("_again"))
    rows = first.join(same, "id_aviso", "left").join(again, "clave_unidad", "left")
    state = F.when(F.col("_same").isNotNull(), "sigue").when(F.col("_again").isNotNull(), "republicado").otherwise("salio")
    price = F.coalesce("_same", "_again")
    change = price / F.col("precio_usd") - 1
    return rows.select(
        "id_aviso", "clave_unidad", state.alias("estado"), price.alias("precio_r2"), change.alias("cambio_precio"),
        truth(change < -dead_band).alias("bajo_en_r2"), truth(change > dead_band).alias("subio_en_r2"), *more,
    )


def join_one_to_one(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """A left join that fails if either side has a key twice."""
    for name, side in (("left", left), ("right", right)):
        if not side.groupBy(key).count().filter("count > 1").isEmpty():
            raise ValueError(f"{name} has a {key} twice")
    return left.join(right, key, "left")


def with_flag(rows: DataFrame, flags: DataFrame, key: str, flag: str) -> DataFrame:
    """rows with a flag of another table, false for keys that it lacks."""
    return rows.join(flags.select(key, flag), key, "left").withColumn(flag, truth(F.col(flag)))


def in_window(rows: DataFrame, time: str, date: str, months: int, kind: str, kinds: list[str]) -> DataFrame:
    """rows of some kinds from months before a date up to, not including, it."""
    end = F.to_date(F.lit(date))
    return rows.filter((F.col(time) >= F.add_months(end, -months)) & (F.col(time) < end) & F.col(kind).isin(kinds))


def from_cache(rows: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """rows with lat, lon and estado of a table of known addresses (J19): one row per address; a row without an address can't
    be placed, one with an unknown address is pending."""
    known = keep_one(known.select(key, "lat", "lon", "estado"), [key], [F.when(F.col("estado") == "OK", 0).otherwise(1), F.col("lat"), F.col("lon")])
    out = rows.join(known, key, "left")
    return out.withColumn("estado", F.when(F.col(key).isNull(), "NO_GEOCODIFICABLE").otherwise(F.coalesce("estado", F.lit("PENDIENTE"))))
