"""Reshape operators: pivots with fixed value lists, unpivots (melt), candidate blocks to long."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from votepanel.constants import CATEGORIES


def pivot_category(
    df: DataFrame,
    keys: list[str] | tuple[str, ...],
    features: list[tuple[str, str]] | tuple[tuple[str, str], ...],
    *,
    categories: tuple[str, ...] = CATEGORIES,
    agg: str = "avg",
    extra: list[Column] | None = None,
    pivot_col: str = "category",
) -> DataFrame:
    """One column ``{prefix}{category}`` per (prefix, value column) and category, in ONE aggregation.

    Equivalent to ``groupBy(keys).pivot(category, categories)`` with several aggregates, but written as
    conditional aggregates so extra non-pivoted aggregates (``extra``) share the same pass and the
    output names need no renaming. The value list is fixed: no extra job to discover it.
    """
    fn = {"avg": F.avg, "sum": F.sum, "max": F.max, "min": F.min, "first": lambda c: F.max(c)}[agg]
    cols = []
    for prefix, value in features:
        for c in categories:
            cols.append(fn(F.when(F.col(pivot_col) == c, F.col(value))).alias(f"{prefix}{c}"))
    return df.groupBy(*keys).agg(*cols, *(extra or []))


def melt(df: DataFrame, ids: list[str], value_cols: list[str], var_name: str, value_name: str, *, strip_prefix: str = "") -> DataFrame:
    """Wide -> long (``unpivot``); optional prefix removed from the variable names."""
    out = df.unpivot(ids, value_cols, var_name, value_name)
    if strip_prefix:
        out = out.withColumn(var_name, F.regexp_replace(F.col(var_name), "^" + strip_prefix, ""))
    return out


def unpivot_numbered(
    df: DataFrame,
    base_cols: list[str],
    indexed: dict[int, dict[str, str]],
    *,
    positive_only: bool = True,
) -> DataFrame:
    """Numbered candidate fields -> long rows.

    ``indexed`` maps a candidate index to ``{"voix": col, "code_candidature": col, "nom_candidature": col}``
    (missing entries are null). One ``explode`` of an array of structs: a single pass, no union per index.
    """
    structs = []
    for idx in sorted(indexed):
        spec = indexed[idx]

        def pick(name, cast="string"):
            c = spec.get(name)
            return (F.col(f"`{c}`") if c else F.lit(None)).cast(cast).alias(name)

        structs.append(F.struct(F.lit(idx).alias("cand_idx"), pick("voix", "double"), pick("code_candidature"), pick("nom_candidature")))
    out = df.select(*[F.col(f"`{c}`") for c in base_cols], F.explode(F.array(*structs)).alias("_c")).select(*[F.col(f"`{c}`") for c in base_cols], "_c.*")
    if positive_only:
        out = out.where(F.col("voix").isNotNull() & (F.col("voix") > 0))
    return out


def unpivot_candidates_mixed(df: DataFrame, base_cols: list[str], indexed: dict[int, dict[str, str]], *,
                             unsuffixed: dict[str, str] | None = None) -> DataFrame:
    """Mixed file: rows carrying any numbered vote are unpivoted (positive votes only); the other rows
    keep one candidate, filled from the unsuffixed columns (``voix`` <- ``Voix`` when missing or 0,
    code <- ``Code Nuance`` then ``Nuance``). Both parts come from one scan and are unioned by name."""
    unsuffixed = unsuffixed or {}
    # one expression, whatever the width: a chain of "or" makes the optimizer's filter inference grow with it
    any_wide = F.coalesce(*[F.col(f"`{spec['voix']}`") for spec in indexed.values()]).isNotNull() if indexed else F.lit(False)
    wide = unpivot_numbered(df.where(any_wide), base_cols, indexed, positive_only=True).drop("cand_idx")

    def col(name):
        c = unsuffixed.get(name)
        return F.col(f"`{c}`") if c and c in df.columns else F.lit(None)

    voix = F.col("voix").cast("double") if "voix" in df.columns else F.lit(None).cast("double")
    voix = F.when(voix.isNull() | (voix == 0), col("Voix").cast("double")).otherwise(voix)
    code = F.coalesce(F.col("code_candidature") if "code_candidature" in df.columns else F.lit(None).cast("string"), col("Code Nuance").cast("string"), col("Nuance").cast("string"))
    name = F.col("nom_candidature") if "nom_candidature" in df.columns else F.lit(None).cast("string")
    long_ = df.where(~any_wide).select(*[F.col(f"`{c}`") for c in base_cols], voix.alias("voix"), code.alias("code_candidature"), name.cast("string").alias("nom_candidature"))
    return long_.unionByName(wide)


def fill_presidential_code(df: DataFrame, *, presidential: str = "presidentielles") -> DataFrame:
    """Presidential rows without a party code take an upper-case, accent-free code built from the name."""
    from votepanel.functions.text import code_key

    cond = (F.col("type_scrutin") == presidential) & F.col("code_candidature").isNull() & F.col("nom_candidature").isNotNull()
    key = F.regexp_replace(code_key(F.regexp_replace(F.col("nom_candidature"), "[^A-Za-zÀ-ÿ ]+", " ")), r"\s+", " ")
    return df.withColumn("code_candidature", F.when(cond, key).otherwise(F.col("code_candidature")))
