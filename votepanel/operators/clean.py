"""Projection / schema-harmonising operators of the long table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from votepanel.functions.text import normalise_code, strip_ws


def _num(df: DataFrame, c: str):
    if c not in df.columns:
        return F.lit(None).cast("double")
    return F.expr(f"try_cast(`{c}` as double)") if dict(df.dtypes)[c] == "string" else F.col(c).cast("double")


def prepare_long(df: DataFrame, *, commune_code: str | None = None) -> DataFrame:
    """Harmonised long table -> typed table used by the panel (``read_long_table`` semantics).

    * ``election_year`` = ``annee`` or year(date); ``round`` = ``tour``; type lower-cased;
    * measures coerced to double (bad values -> null), party codes trimmed/upper-cased, textual nulls -> null;
    * ``commune_code`` = ``code_commune`` without a trailing ``.0``, else the key part before ``-``;
    * optional town filter (pushed down to the scan by Catalyst).
    """
    year = F.coalesce(F.expr("try_cast(annee as int)") if "annee" in df.columns else F.lit(None).cast("int"), F.year("date_scrutin"))
    if "code_commune" in df.columns:
        town = F.regexp_replace(strip_ws(F.col("code_commune").cast("string")), r"\.0$", "")
    else:
        town = F.substring_index(F.col("code_bv").cast("string"), "-", 1)
    cols = [
        town.alias("commune_code"),
        F.col("code_bv"),
        F.lower(F.col("type_scrutin")).alias("election_type"),
        year.cast("int").alias("election_year"),
        F.expr("try_cast(tour as int)").alias("round"),
        F.col("date_scrutin").cast("date").alias("date_scrutin"),
        normalise_code("code_candidature").alias("code_candidature"),
        (F.col("nom_candidature") if "nom_candidature" in df.columns else F.lit(None).cast("string")).alias("nom_candidature"),
    ]
    cols += [_num(df, c).alias(c) for c in ("voix", "exprimes", "votants", "inscrits", "blancs", "nuls")]
    out = df.select(*cols)
    if commune_code is not None:
        out = out.where(F.col("commune_code") == F.lit(str(commune_code)))
    return out


def filter_department(df: DataFrame, dept: str) -> DataFrame:
    """Rows of one department: its ``dept`` column, or where that is null or missing, the start of the town code."""
    start = F.substring("commune_code", 1, 2)
    return df.where((F.coalesce("dept", start) if "dept" in df.columns else start) == F.lit(dept))


def clean_history(df: DataFrame, categories: tuple[str, ...] | None = None) -> DataFrame:
    """History clean-up: trimmed / lower-cased keys, round null -> 1, shares and turnout clipped to
    [0, 1], rows with a missing key dropped, unknown categories dropped."""
    from votepanel.constants import CATEGORIES

    cats = categories or CATEGORIES
    clip = lambda c: F.least(F.greatest(F.col(c), F.lit(0.0)), F.lit(1.0))
    out = df.select(
        F.trim("code_bv").alias("code_bv"),
        F.lower(F.trim("election_type")).alias("election_type"),
        F.col("election_year").cast("int").alias("election_year"),
        F.coalesce(F.col("round").cast("int"), F.lit(1)).alias("round"),
        "date_scrutin",
        F.lower(F.trim("category")).alias("category"),
        *[clip(c).alias(c) for c in ("share", "share_nat", "turnout_pct") if c in df.columns],
    )
    for k in ("code_bv", "election_type", "election_year", "category"):
        out = out.where(F.col(k).isNotNull())
    return out.where(F.col("category").isin(*cats))
