"""Text parsers as Column expressions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_ACCENTED, _PLAIN = "áàäâãéèëêíìïîóòöôõúùüûñçÁÀÄÂÃÉÈËÊÍÌÏÎÓÒÖÔÕÚÙÜÛÑÇ", "aaaaaeeeeiiiiooooouuuuncAAAAAEEEEIIIIOOOOOUUUUNC"


def null_if_empty(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def without_accents(text: Column) -> Column:
    return F.translate(text, _ACCENTED, _PLAIN)


def ad_id(link: Column) -> Column:
    """The id of an ad, from its link (F1)."""
    return F.replace(null_if_empty(F.regexp_extract(link, r"(MLA-?\d+)", 1)), F.lit("-"))


def price_parts(text: Column) -> dict[str, Column]:
    """Current price, previous price, drop flag and drop in percent of a price text (F2)."""
    amounts = F.transform(
        F.regexp_extract_all(text, F.lit(r"(US\$|\$)\s?([\d\.]+)"), F.lit(2)), lambda x: F.replace(x, F.lit(".")).try_cast("double")
    )
    dropped = F.contains(F.upper(text), F.lit("BAJÓ DE PRECIO")) & (F.size(amounts) >= 2)
    now, before = F.try_element_at(amounts, F.lit(-1)), F.when(dropped, F.try_element_at(amounts, F.lit(1)))
    return {"precio": now, "precio_anterior": before, "bajo": dropped, "baja_pct": 100 * (1 - now / before)}


def card_price(text: Column) -> dict[str, Column]:
    """Currency, amount and "from" flag of a card's price."""
    currency = F.when(F.lower(text).contains("u$s") | text.contains("US$"), "USD").when(text.contains("$"), "ARS")
    amount = null_if_empty(F.regexp_replace(text, r"\D", "")).try_cast("double")
    return {"moneda": currency, "monto": amount, "desde": F.lower(text).contains("desde")}


#: Patterns of the numbers in an attributes text, the first of a range.
ATTRIBUTES = {
    "ambientes": r"(\d+)\s*amb", "dormitorios": r"(\d+)\s*dormitorio", "banos": r"(\d+)(?:\s*a\s*\d+)?\s*ba[ñn]o",
    "m2": r"(\d+)(?:\s*-\s*\d+)?\s*m²",
}


def attributes(text: Column) -> dict[str, Column]:
    """Rooms, bedrooms, baths and size of an attributes text, the first number of a range."""
    return {name: null_if_empty(F.regexp_extract(F.lower(text), pattern, 1)).try_cast("double") for name, pattern in ATTRIBUTES.items()}


def surface(text: Column) -> Column:
    """"103,71 m²" as a number; another unit, or dots that could be thousands, give null."""
    body = F.regexp_replace(text, r" m²$", "")
    number = F.replace(body, F.lit(","), F.lit(".")).try_cast("double")
    return F.when(text.endswith(" m²") & ~body.rlike(r"^\d{1,3}(\.\d{3})+$"), number)


def age(text: Column, year: int = 2026, most: int = 150) -> dict[str, Column]:
    """Age in years and an "under construction" flag (F6): years from 1800 on are building years, negatives unbuilt."""
    n = F.replace(F.regexp_replace(text, r"\s*años?$", ""), F.lit(".")).try_cast("double")
    years = F.when(n >= 1800, F.lit(year) - n).otherwise(n)
    return {
        "antiguedad": F.when(years < 0, 0.0).when(years <= most, years),
        "en_construccion": F.coalesce(years < 0, F.lit(False)),
    }


def expenses(text: Column, fx: float, most: float = 10_000_000) -> Column:
    """Monthly expenses in ARS (F7): small USD amounts are noise, large ones were meant in ARS."""
    n = F.replace(F.regexp_replace(text, r"\s(ARS|USD)$", ""), F.lit(".")).try_cast("double")
    ars = F.when((n > 0) & (n <= most), n)
    usd = F.when(n >= 10_000, F.when(n <= most, n)).when(n >= 10, n * fx)
    return F.when(text.endswith(" ARS"), ars).when(text.endswith(" USD"), usd)


def address(text: Column) -> Column:
    """A street address fit for geocoding, null unless it has a number or a corner (F8)."""
    out = F.split_part(text, F.lit(","), F.lit(1))
    out = F.regexp_replace(out, r"\bAv\.\s*|\bAv\s+", "Avenida ")
    out = F.split_part(out, F.lit(". "), F.lit(1))
    out = F.trim(F.regexp_replace(F.replace(out, F.lit(" Al "), F.lit(" ")), r"\s+", " "))
    return F.when(out.rlike(r"\d") | F.contains(F.upper(out), F.lit(" Y ")), out)


def cleaned(text: Column) -> Column:
    """White space squeezed; empty becomes N/A."""
    return F.coalesce(null_if_empty(F.trim(F.regexp_replace(F.translate(text, " ", " "), r"\s+", " "))), F.lit("N/A"))


def column_name(label: Column) -> Column:
    """A label as a column name."""
    return F.regexp_replace(F.regexp_replace(without_accents(F.lower(label)), r"[^a-z0-9]+", "_"), r"^_+|_+$", "")


def match_key(text: Column, words: dict[str, str] | None = None) -> Column:
    """Text for comparisons of names (F11): no accents, upper case, marks as spaces, abbreviations replaced; null if empty."""
    plain = F.trim(F.regexp_replace(F.translate(F.upper(without_accents(text)), "-_.", "   "), r"\s+", " "))
    if words:
        pairs = F.create_map(*(F.lit(x) for pair in words.items() for x in pair))
        plain = F.array_join(F.transform(F.split(plain, " "), lambda x: F.coalesce(pairs[x], x)), " ")
    return null_if_empty(plain)


#: Patterns over lower-case titles.
NOT_A_SALE = r"^\s*(?:compro|compramos)\b"
RENT = "alquil"
POPULAR_AREA = "rodrigo bueno|barrio mugica|padre mugica|villa 31"
HOUSE_TYPE = r"tipo casa|t/ ?casa|como (?:una )?casa|estilo casa|casa en altura|depto casa|alma de casa"
HOUSE = (
    r"^(?:venta |vendo |se vende )?casas?\b|\bcasa (?:en|con|al|lote|multifamiliar|de \d|\d)"
    r"|venta de casa|lote ?/ ?casa|casa ?/ ?(?:lote|ph)|ph ?/ ?casa|-casa\b"
)
TO_RENOVATE, RENOVATED, NEW, TENANT = "refacc|a reciclar|para reciclar", "reciclad", "estrenar", "renta|inquilin"
PH, OTHER_USE = r"\bph\b", r"\boficinas?\b|comercial|\blocal(?:es)?\b|\bhotel(?:es)?\b|\bhostel\b|apart\s*-?\s*hotel"
FINANCED = "financ|anticipo|cuotas"
SEVERAL_UNITS, ONE_UNIT = r"\ben\s+block\b|\bunidades\b|\bdepartamentos\b|\bd(?:e)?ptos\.?\b", r"\bunid[oa]s\b|\bunificad[oa]s\b"
#: State of the property, the first pattern that a lower-case title meets.
STATES = [
    ("a_reciclar", "reciclar|reciclaje|recicl[aá]lo"),
    ("a_refaccionar", r"refaccionar|\ba refacc\b|refacc\.|refacc-|\ben refacci|ideal (?:para )?refacci"),
    ("ya_reformado", "refaccionad|reciclad|recicl a nuevo|refacci[oó]n (?:total|premium|completa)|refacc nuevo"),
    ("a_estrenar", "estrenar"),
]
#: Signs of legal risk in a lower-case title, each with whether it discards the ad.
RISKS = [
    ("nuda_propiedad", "nuda propiedad|usufruct", True),
    ("sucesion", "suces|tracto abreviado", False),
    ("con_inquilino", r"con renta|c/ ?renta|inquilin|alquilad[oa]|contrato vigente|renta activa|rentad[oa]|renta (?:vigente|inmediata|\d)|(?:y|\+|c/exc\.?) ?renta\b", False),
    ("ocupado", "(?<!des)ocupad", True),
    ("sin_escritura", r"sin escritura|boleto|\bcesi[oó]n", True),
    ("subasta", "subasta|remate|judicial", False),
    ("credito_pendiente", "(?:con|tiene) hipoteca|cr[eé]dito pendiente|embarg|inhibi", False),
    ("parte_indivisa", "indivis|porcentaje indiviso", True),
    ("en_pozo", r"\bpozo\b|fideicom|en construcci|preventa", True),
    ("con_financiacion", "financ|cuotas|anticipo", False),
    ("no_apto_credito", r"\bno apto (?:para )?cr", False),
]


def _lower(title: Column) -> Column:
    return F.lower(F.coalesce(title, F.lit("")))


def title_flags(title: Column) -> dict[str, Column]:
    """What a title says (F12); null titles say nothing."""
    t = _lower(title)
    renovate, house_type = t.rlike(TO_RENOVATE), t.rlike(HOUSE_TYPE)
    return {
        "no_es_venta": t.rlike(NOT_A_SALE), "menciona_alquiler": t.rlike(RENT), "titulo_barrio_popular": t.rlike(POPULAR_AREA),
        "titulo_tipo_casa": house_type, "titulo_casa": t.rlike(HOUSE) & ~house_type,
        "titulo_a_refaccionar": renovate, "titulo_reciclado": t.rlike(RENOVATED) & ~renovate,
        "titulo_a_estrenar": t.rlike(NEW), "titulo_con_renta": t.rlike(TENANT),
    }


def risk_flags(title: Column) -> dict[str, Column]:
    """One flag for each sign of legal risk."""
    return {f"riesgo_{name}": _lower(title).rlike(pattern) for name, pattern, _ in RISKS}


def risk_labels(title: Column, discards: bool) -> Column:
    """The names of the signs that discard an ad, or of the others, joined by commas."""
    return F.concat_ws(", ", *(F.when(_lower(title).rlike(pattern), F.lit(name.replace("_", " "))) for name, pattern, d in RISKS if d == discards))


def use_flags(title: Column) -> dict[str, Column]:
    """Row houses, other uses, financing and sales of several units (F14); "unidos" and the like make one unit of several."""
    t = F.lower(without_accents(F.coalesce(title, F.lit(""))))
    return {
        "ph": t.rlike(PH), "otro_uso": t.rlike(OTHER_USE), "con_financiacion": t.rlike(FINANCED),
        "varias_unidades": t.rlike(SEVERAL_UNITS) & ~t.rlike(ONE_UNIT),
    }


def other_names(title: Column, own: Column, names: list[str]) -> Column:
    """Names of places other than the own one that a title names (F15), in the order of names.

    names: lower case, without accents. A title that names the own place names no other. A name after "av.", "calle" and
    the like is a street's, and so is one before "y" and a word that begins no name: those don't count.
    """
    plain = lambda c: F.lower(without_accents(F.coalesce(c, F.lit(""))))
    t, mine = plain(title), plain(own)
    street = r"(?<!\bav\.? {0,3})(?<!\bavenida {1,3})(?<!\bcalle {1,3})(?<!\bpasaje {1,3})(?<!\bpje\.? {0,3})"
    pattern = lambda n: r"(?<![a-z])" + re.escape(n).replace(r"\ ", r"\s+") + r"(?![a-z])"
    starts = sorted({n for name in names for n in (name[:i] for i in range(1, len(name) + 1))})
    corner = lambda: r"(?!\s+y\s+(?!(?:" + "|".join(map(re.escape, starts)) + r")(?![a-z]))[a-z])"
    own_named = reduce(lambda a, b: a | b, ((mine == n) & t.rlike(pattern(n)) for n in names))
    found = [F.when(~mine.contains(n) & ((mine == "") | ~F.contains(F.lit(n), mine)) & t.rlike(street + pattern(n) + corner()), F.lit(n)) for n in names]
    return F.when(own_named, F.array().cast("array<string>")).otherwise(F.array_compact(F.array(*found)))


def first_rule(text: Column, rules: list[tuple[str, str]], default: str) -> Column:
    """The state of the first rule (state, regex) that the lower-case text meets."""
    text = _lower(text)
    return F.coalesce(*(F.when(text.rlike(pattern), F.lit(state)) for state, pattern in rules), F.lit(default))


def url_base(url: Column) -> Column:
    """A URL without query and fragment (F16)."""
    return F.split_part(F.split_part(url, F.lit("#"), F.lit(1)), F.lit("?"), F.lit(1))


def display_name(slug: Column, accents: dict[str, str] | None = None) -> Column:
    """A slug as a title."""
    known = F.lit(None).cast("string")
    if accents:
        known = F.create_map(*(F.lit(x) for pair in accents.items() for x in pair))[slug]
    return F.coalesce(known, F.initcap(F.replace(slug, F.lit("-"), F.lit(" "))))


def unit_key(address_: Column, size: Column, rooms: Column) -> Column:
    """What identifies a unit that is published again."""
    return F.when(address_.isNotNull(), F.concat_ws("|", F.upper(F.trim(address_)), F.bround(size).cast("long").cast("string"), rooms.cast("long").cast("string")))
