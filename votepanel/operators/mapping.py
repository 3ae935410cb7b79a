"""Candidate -> category mapping operators (join, equal split of votes, overrides, unmapped codes)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from votepanel.functions.categories import category_from_list, category_from_name, normalise_bloc, normalise_category
from votepanel.functions.text import normalise_code

BLOC_COLS = ("bloc_1", "bloc_2", "bloc_3")
EXPANDED_COLS = (
    "commune_code",
    "code_bv",
    "election_type",
    "election_year",
    "round",
    "date_scrutin",
    "category",
    "voix_cat",
    "exprimes",
    "votants",
    "inscrits",
    "blancs",
    "nuls",
)


def normalise_mapping(mapping: DataFrame, *, lenient: bool = False, compat_centre_fill: bool = False) -> DataFrame:
    """Upper/trim codes (always, Q33) and normalise bloc labels.

    ``lenient=False``: unknown labels -> null (strict normaliser). ``lenient=True``: unknown -> centre;
    empty blocs stay null unless ``compat_centre_fill`` (Q10: the original turns them into centre).
    """
    cols = [normalise_code("code_candidature").alias("code_candidature")]
    if "nom_candidature" in mapping.columns:
        cols.append(F.col("nom_candidature"))
    else:
        cols.append(F.lit(None).cast("string").alias("nom_candidature"))
    for b in BLOC_COLS:
        raw = F.col(b) if b in mapping.columns else F.lit(None).cast("string")
        if not lenient:
            cols.append(normalise_category(raw).alias(b))
        elif compat_centre_fill:
            cols.append(normalise_bloc(raw).alias(b))
        else:
            empty = raw.isNull() | (F.trim(raw) == "")
            cols.append(F.when(empty, F.lit(None).cast("string")).otherwise(normalise_bloc(raw)).alias(b))
    return mapping.select(*cols)


def join_mapping(long_df: DataFrame, mapping: DataFrame, *, broadcast: bool | None = None) -> DataFrame:
    """Left join of the long table with the (small, checked) mapping on the normalised party code."""
    m = mapping
    if "nom_candidature" in long_df.columns:
        m = m.withColumnRenamed("nom_candidature", "nom_candidature_map")
    if broadcast is None:
        m = (m)
    elif broadcast:
        m = F.broadcast(m)
    return long_df.join(m, on="code_candidature", how="left")


def expand_by_category(
    long_df: DataFrame,
    mapping: DataFrame,
    *,
    fallback: str = "centre",
    name_fallback: bool = True,
    broadcast: bool | None = None,
) -> DataFrame:
    """Split each candidate's votes equally among its mapped blocs (one output row per bloc).

    ``long_df`` is a prepared long table (``prepare_long``); ``mapping`` is normalised
    (``normalise_mapping``). Unmapped codes try the presidential-name / European-list rules, then
    ``fallback`` (Q11, Q12). A bloc listed twice counts twice (Q13).

    Besides ``voix_cat`` the output carries ``voix_sixths`` = votes x 6 / n_blocs, an integer-valued
    double (n_blocs <= 3 divides 6) so that downstream sums are exact whatever the partitioning.
    """
    joined = join_mapping(long_df, mapping, broadcast=broadcast)
    blocs = F.filter(F.array(*[F.col(b) for b in BLOC_COLS]), lambda x: x.isNotNull())
    if name_fallback and "nom_candidature" in joined.columns:
        name = F.col("nom_candidature")
        by_name = (
            F.when(F.col("election_type") == "presidentielles", category_from_name(name))
            .when(F.col("election_type") == "europeennes", category_from_list(name))
        )
        blocs = F.when(F.size(blocs) > 0, blocs).when(by_name.isNotNull(), F.array(by_name)).otherwise(F.array(F.lit(fallback)))
    else:
        blocs = F.when(F.size(blocs) > 0, blocs).otherwise(F.array(F.lit(fallback)))
    n = F.size("_blocs")
    out = joined.withColumn("_blocs", blocs).select(
        F.col("commune_code"),
        "code_bv",
        "election_type",
        "election_year",
        "round",
        "date_scrutin",
        F.explode("_blocs").alias("category"),
        (F.col("voix") / n).alias("voix_cat"),
        "exprimes",
        "votants",
        "inscrits",
        "blancs",
        "nuls",
        (F.col("voix") * (F.lit(6) / n).cast("int")).alias("voix_sixths"),
    )
    return out


def expand_by_bloc(long_df: DataFrame, mapping: DataFrame, *, broadcast: bool | None = None) -> DataFrame:
    """Older variant (``elections_blocs`` path): lenient normaliser, no name rules, per-row rates.

    ``mapping`` must be normalised with ``lenient=True`` (pass ``compat_centre_fill=True`` for Q10).
    Votes: null -> 0 before the split.
    """
    joined = join_mapping(long_df.withColumn("voix", F.coalesce(F.col("voix"), F.lit(0.0))), mapping, broadcast=broadcast)
    arr = F.filter(F.array(*[F.col(b) for b in BLOC_COLS]), lambda x: x.isNotNull())
    arr = F.when(F.size(arr) > 0, arr).otherwise(F.array(F.lit("centre")))
    n = F.size("_blocs")
    base_ins = F.when(F.col("inscrits") != 0, F.col("inscrits"))
    return joined.withColumn("_blocs", arr).select(
        "code_bv",
        "date_scrutin",
        F.col("election_year").alias("annee"),
        F.col("election_type").alias("type_scrutin"),
        F.col("round").alias("tour"),
        F.explode("_blocs").alias("bloc"),
        (F.col("voix") / n).alias("voix_bloc"),
        "exprimes",
        "inscrits",
        "votants",
        "blancs",
        "nuls",
    ).select(
        "*",
        (F.col("voix_bloc") / F.when(F.col("exprimes") != 0, F.col("exprimes"))).alias("part_bloc"),
        (F.col("votants") / base_ins).alias("taux_participation_bv"),
        (F.col("blancs") / base_ins).alias("taux_blancs_bv"),
        (F.col("nuls") / base_ins).alias("taux_nuls_bv"),
    )


def mapping_override(base: DataFrame, overrides: DataFrame) -> DataFrame:
    """Apply overrides to a mapping: matching codes take the override's non-null fields, new codes are appended.

    ``overrides`` may use ``code``/``nom`` aliases and a ``blocs`` array instead of ``bloc_1..3``.
    """
    ov = overrides
    if "code_candidature" not in ov.columns and "code" in ov.columns:
        ov = ov.withColumnRenamed("code", "code_candidature")
    if "nom_candidature" not in ov.columns and "nom" in ov.columns:
        ov = ov.withColumnRenamed("nom", "nom_candidature")
    if "blocs" in ov.columns:
        ov = ov.select("*", *[F.get(F.col("blocs"), i).alias(b) for i, b in enumerate(BLOC_COLS)]).drop("blocs")
    cols = ["nom_candidature", *BLOC_COLS]
    ov = ov.select(
        normalise_code("code_candidature").alias("code_candidature"),
        *[(F.col(c) if c in ov.columns else F.lit(None).cast("string")).alias(f"_o_{c}") for c in cols],
    ).where(F.col("code_candidature").isNotNull())
    b = base.select(normalise_code("code_candidature").alias("code_candidature"), *[F.col(c) for c in cols])
    merged = b.join(ov, on="code_candidature", how="full_outer")
    return merged.select("code_candidature", *[F.coalesce(F.col(f"_o_{c}"), F.col(c)).alias(c) for c in cols])


def unmapped_codes(long_df: DataFrame, mapping: DataFrame) -> DataFrame:
    """Party codes of the long table absent from the mapping, with row and vote counts (Q28)."""
    codes = long_df.where(F.col("code_candidature").isNotNull())
    missing = codes.join(mapping.select("code_candidature").distinct(), on="code_candidature", how="left_anti")
    return missing.groupBy("code_candidature").agg(
        F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.sum("voix"), F.lit(0.0)).alias("voix")
    )
