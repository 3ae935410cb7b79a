"""Geographic code and key column functions (town / station codes, event keys, labels)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from votepanel.functions.text import _col, strip_ws


def digits(c: Column | str) -> Column:
    """Trimmed text without a ``.0`` float suffix and without non-digits."""
    v = F.regexp_replace(strip_ws(_col(c).cast("string")), r"\.0$", "")
    return F.regexp_replace(v, r"\D", "")


def normalise_insee(c: Column | str) -> Column:
    """Town code to 5 digits: first 5 digits when longer, zero-padded when shorter, null when empty."""
    d = digits(c)
    return F.when(d == "", F.lit(None).cast("string")).when(F.length(d) >= 5, F.substring(d, 1, 5)).otherwise(F.lpad(d, 5, "0"))


def normalise_geo_codes(dept: Column | str, town: Column | str, station: Column | str) -> tuple[Column, Column, Column, Column]:
    """Department (2), town (5: a 3-digit town is prefixed by its department), station (4) and the
    9-character station key."""
    d = F.lpad(digits(dept), 2, "0")
    t = digits(town)
    t5 = F.when(F.length(t) == 5, t).when(F.length(t) <= 3, F.concat(d, F.lpad(t, 3, "0"))).otherwise(F.lpad(t, 5, "0"))
    s = F.lpad(digits(station), 4, "0")
    return d, t5, s, F.concat(t5, s)


def split_key(c: Column | str) -> tuple[Column, Column]:
    """Town = text before the first ``-``; station = text after it."""
    v = _col(c).cast("string")
    return F.substring_index(v, "-", 1), F.regexp_replace(v, r"^[^-]*-", "")


def extract_station_number(c: Column | str) -> Column:
    """First integer of a label (null when none)."""
    m = F.regexp_extract(_col(c), r"(\d+)", 1)
    return F.when(m == "", F.lit(None).cast("int")).otherwise(m.try_cast("int"))


def station_code_candidates(town: Column | str, number: Column) -> tuple[Column, Column]:
    """Key forms a station number may take: ``town-NNNN`` and ``town-NNN`` (joined on either); longer numbers stay whole."""
    n = number.cast("string")

    def form(width):
        return F.concat(_col(town), F.lit("-"), F.lpad(n, F.greatest(F.length(n), F.lit(width)), "0"))

    return form(4), form(3)


def event_key(etype: Column | str, year: Column | str, rnd: Column | str) -> Column:
    """``type|year|round`` election key."""
    return F.concat_ws("|", F.lower(strip_ws(_col(etype))), _col(year).cast("string"), _col(rnd).cast("string"))


def parse_event_key(c: Column | str) -> tuple[Column, Column, Column]:
    p = F.split(_col(c), r"\|")
    return p[0], p[1].try_cast("int"), p[2].try_cast("int")


def format_delta(c: Column | str, decimals: int = 1) -> Column:
    """``+`` for values >= 0, then the value rounded to ``decimals`` (half-even); a negative value that
    rounds to zero keeps its sign (``-0.0``); ``N/A`` for null. Text only at the sink."""
    v = _col(c)
    r = F.bround(v, decimals)
    num = F.when((v < 0) & (r == 0), F.lit("-0." + "0" * decimals)).otherwise(r.cast("string"))
    return F.when(v.isNull() | F.isnan(v), F.lit("N/A")).otherwise(F.concat(F.when(v >= 0, F.lit("+")).otherwise(F.lit("")), num))
