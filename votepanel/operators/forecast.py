"""No-ML forecast operators, all stations at once.

The per-station loop of the original becomes grouped aggregates: the history is hash-partitioned on
``code_bv`` once, and every statistic below (share trends per station x category, rate trends per
station, allocation of counts) is keyed by ``code_bv`` plus more columns, so no further exchange is
needed. Least-squares lines come from sums per group and year.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from votepanel.constants import DISPLAY_ORDER, EXTRA_ROWS
from votepanel.functions.categories import normalise_bloc

# ordering of rows inside a station history (date, then type, then round: deterministic ties)
HIST_ORDER = ("date_scrutin", "election_type", "round")


def clip01(c: Column) -> Column:
    return F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))


def _order_key() -> Column:
    return F.struct(*[F.col(c) for c in HIST_ORDER])


def infer_exprimes(hist: DataFrame, votes: str = "voix_cat") -> DataFrame:
    """Missing or zero valid votes <- sum of the votes of the station-event (window over the station)."""
    w = Window.partitionBy("code_bv", "date_scrutin")
    s = F.sum(votes).over(w)
    e = F.col("exprimes")
    return hist.withColumn("exprimes", F.when(e.isNull() | (e == 0), s).otherwise(e))


def prepare_history(local: DataFrame, *, target_year: int | None = None) -> DataFrame:
    """Event-category table -> forecast history: lenient bloc labels, inferred valid votes, share <= 1,
    rows of the target year and later removed, one exchange on the station key."""
    h = local
    if target_year is not None:
        h = h.where(F.col("election_year") < target_year)
    h = h.repartition("code_bv")
    h = h.withColumn("category", normalise_bloc("category")).withColumn("election_type", F.lower(F.trim("election_type")))
    h = infer_exprimes(h)
    # share given per row; a station without any share gets votes / valid votes
    w = Window.partitionBy("code_bv")
    any_share = F.max(F.col("share").isNotNull().cast("int")).over(w)
    derived = F.col("voix_cat") / F.when(F.col("exprimes") != 0, F.col("exprimes"))
    share = F.when(any_share == 1, F.col("share")).otherwise(derived)
    return h.withColumn("share", F.least(share, F.lit(1.0)))


#: Years are counted from here in sums, so that their squares stay small.
ORIGIN = 2000


def trend_statistics(rows: DataFrame, keys: tuple[str, ...], values: dict[str, Column], order: Column, year: str = "election_year", latest: dict[str, Column] | None = None) -> DataFrame:
    """What a least-squares line over the years needs, per group: for each value ``{name}_n, _ny`` (distinct years), ``_slope, _mx, _my,
    _last`` (by ``order``), ``_min, _max``; and the last non-null of each of ``latest``.

    A value is null in rows outside its scope. Rows are first summed per group and year, where the year is a constant: number, sum, extremes and
    last of the values are all that is needed, and a year with values counts once. The line's sums follow from those."""
    at = F.col("_order")
    rows = rows.select(*keys, F.col(year).alias("_year"), order.alias("_order"), *[F.when(F.col(year).isNotNull(), v).alias(f"_v_{n}") for n, v in values.items()], *[v.alias(f"_l_{n}") for n, v in (latest or {}).items()])
    aggs = []
    for n in values:
        v = F.col(f"_v_{n}")
        here = F.when(v.isNotNull(), at)
        aggs += [F.count(v).alias(f"_n_{n}"), F.sum(v).alias(f"_s_{n}"), F.min(v).alias(f"_min_{n}"), F.max(v).alias(f"_max_{n}"), F.max_by(v, here).alias(f"_last_{n}"), F.max(here).alias(f"_at_{n}")]
    for n in latest or {}:
        here = F.when(F.col(f"_l_{n}").isNotNull(), at)
        aggs += [F.max_by(F.col(f"_l_{n}"), here).alias(f"_l_{n}"), F.max(here).alias(f"_lat_{n}")]
    by_year = rows.groupBy(*keys, "_year").agg(*aggs)
    x = F.col("_year").cast("double") - ORIGIN
    aggs = []
    for n in values:
        k, total = F.col(f"_n_{n}"), F.col(f"_s_{n}")
        aggs += [F.sum(k).alias(f"{n}_n"), F.count(F.when(k > 0, 1)).alias(f"{n}_ny"), F.sum(k * x).alias(f"_sx_{n}"), F.sum(k * x * x).alias(f"_sxx_{n}"), F.sum(total).alias(f"_sv_{n}"), F.sum(total * x).alias(f"_sxv_{n}")]
        aggs += [F.min(f"_min_{n}").alias(f"{n}_min"), F.max(f"_max_{n}").alias(f"{n}_max"), F.max_by(f"_last_{n}", f"_at_{n}").alias(f"{n}_last")]
    aggs += [F.max_by(f"_l_{n}", f"_lat_{n}").alias(n) for n in latest or {}]
    g = by_year.groupBy(*keys).agg(*aggs)
    out = []
    for n in values:
        k, sx, sv = F.col(f"{n}_n"), F.col(f"_sx_{n}"), F.col(f"_sv_{n}")
        spread = k * F.col(f"_sxx_{n}") - sx * sx
        positive = F.when(k > 0, k)
        out += [f"{n}_n", f"{n}_ny", f"{n}_min", f"{n}_max", f"{n}_last", ((k * F.col(f"_sxv_{n}") - sx * sv) / F.when(spread > 0, spread)).alias(f"{n}_slope"), (sx / positive + ORIGIN).alias(f"{n}_mx"), (sv / positive).alias(f"{n}_my")]
    return g.select(*keys, *out, *(latest or {}))


def _projected(name: str, target_year: int, min_points: int, clamp: bool) -> Column:
    p = {k: F.col(f"{name}_{k}") for k in ("n", "ny", "slope", "mx", "my", "last", "min", "max")}
    val = _line_at(p["n"], p["ny"], p["slope"], p["mx"], p["my"], p["last"], target_year, min_points)
    return clip01(F.least(F.greatest(val, p["min"]), p["max"]) if clamp else val)


def _line_at(n: Column, ny: Column, slope: Column, mx: Column, my: Column, last: Column, target_year: int, min_points: int) -> Column:
    trend = my + slope * (F.lit(float(target_year)) - mx)
    return F.when(n == 0, F.lit(None).cast("double")).when((n >= min_points) & (ny >= min_points) & slope.isNotNull(), trend).otherwise(last)


def project_shares(hist: DataFrame, target_type: str, target_year: int) -> DataFrame:
    """Per station x category: least-squares share at ``target_year`` over the target type's history
    when the category has any row of that type, else over all types; last value if fewer than 2 years;
    falls back to the last known share; clipped to [0, 1] (``project_share``)."""
    is_t = F.col("election_type") == F.lit(target_type)
    w = Window.partitionBy("code_bv", "category")
    rows = hist.withColumns({"_no": F.row_number().over(w.orderBy(*HIST_ORDER)), "_has_t": F.max(is_t.cast("int")).over(w)})
    in_scope = is_t | (F.coalesce(F.col("_has_t"), F.lit(0)) == 0)
    g = trend_statistics(rows, ("code_bv", "category"), {"share": F.when(in_scope, F.col("share"))}, F.col("_no"), latest={"last_overall": F.col("share")})
    raw = clip01(F.coalesce(_projected("share", target_year, 2, False), F.col("last_overall"), F.lit(0.0)))
    return g.select("code_bv", "category", raw.alias("raw_share"))


def station_events(hist: DataFrame) -> DataFrame:
    """One row per station-event with max totals and rates over registered (zero -> null)."""
    ev = hist.groupBy("code_bv", "date_scrutin", "election_type", "round", "election_year").agg(
        F.max("inscrits").alias("inscrits"),
        F.max("votants").alias("votants"),
        F.max("blancs").alias("blancs"),
        F.max("nuls").alias("nuls"),
    )
    base = F.when(F.col("inscrits") != 0, F.col("inscrits"))
    return ev.select(
        "*",
        (F.col("votants") / base).alias("taux_participation"),
        (F.col("blancs") / base).alias("taux_blancs"),
        (F.col("nuls") / base).alias("taux_nuls"),
    )


def project_rates(events: DataFrame, target_type: str, target_year: int, *, min_points: int = 3, clamp: bool = True) -> DataFrame:
    """Per station: turnout / blank / void rate at ``target_year`` (``project_rate``).

    Scope = round-1 events when the station has any, then the target type's events when present in
    that scope. Trend only with >= ``min_points`` points and distinct years, else the last value;
    clamped to the observed range, then to [0, 1]. Also returns the last known registered count.
    """
    w = Window.partitionBy("code_bv")
    rows = events.withColumns({"_no": F.row_number().over(w.orderBy(*HIST_ORDER)), **{k: F.max(c.cast("int")).over(w) for k, c in _scope_flags(target_type).items()}})
    g = trend_statistics(rows, ("code_bv",), {r: F.when(_in_scope(target_type), F.col(r)) for r in STATION_RATES}, F.col("_no"), latest={"last_inscrits": F.col("inscrits")})
    return g.select("code_bv", "last_inscrits", *[_projected(r, target_year, min_points, clamp).alias(r) for r in STATION_RATES])


STATION_RATES = ("taux_participation", "taux_blancs", "taux_nuls")


def _scope_flags(target_type: str) -> dict[str, Column]:
    r1, is_t = F.col("round") == 1, F.col("election_type") == F.lit(target_type)
    return {"_has_r1": r1, "_has_r1_t": r1 & is_t, "_has_t": is_t}


def _in_scope(target_type: str) -> Column:
    """First rounds where the group has any, and of those (or of all) the target type's rows where there are any."""
    f = _scope_flags(target_type)
    has = {k: F.coalesce(F.col(k), F.lit(0)) == 1 for k in f}
    r1, is_t = F.coalesce(f["_has_r1"], F.lit(False)), F.coalesce(f["_has_t"], F.lit(False))
    return F.when(has["_has_r1"], r1 & (is_t | ~has["_has_r1_t"])).otherwise(is_t | ~has["_has_t"])


def head_counts(rates: DataFrame, *, inscrits_col: str = "last_inscrits") -> DataFrame:
    """Registered x rates -> turnout, blank, void, valid, abstention counts (half-even rounding).

    Missing rates count as 0; blank + void are scaled down when they exceed turnout (rates, then counts).
    """
    p = F.coalesce(F.col("taux_participation"), F.lit(0.0))
    b = F.coalesce(F.col("taux_blancs"), F.lit(0.0))
    n = F.coalesce(F.col("taux_nuls"), F.lit(0.0))
    over = ((b + n) > p) & ((b + n) > 0)
    scale = p / F.when(b + n != 0, b + n)
    b2 = F.when(over, b * scale).otherwise(b)
    n2 = F.when(over, n * scale).otherwise(n)
    ins = F.bround(F.col(inscrits_col), 0).cast("long")
    df = rates.select("*", ins.alias("inscrits_total"), p.alias("_p"), b2.alias("_b"), n2.alias("_n"))
    df = df.select(
        "*",
        F.bround(F.col("inscrits_total") * F.col("_p"), 0).cast("long").alias("votants_total"),
        F.bround(F.col("inscrits_total") * F.col("_b"), 0).cast("long").alias("_bt"),
        F.bround(F.col("inscrits_total") * F.col("_n"), 0).cast("long").alias("_nt"),
    )
    bn = F.col("_bt") + F.col("_nt")
    over2 = (bn > F.col("votants_total")) & (bn > 0)
    sc = F.col("votants_total") / F.when(bn != 0, bn).cast("double")
    df = df.select(
        "*",
        F.when(over2, F.bround(F.col("_bt") * sc, 0).cast("long")).otherwise(F.col("_bt")).alias("blancs_total"),
        F.when(over2, F.bround(F.col("_nt") * sc, 0).cast("long")).otherwise(F.col("_nt")).alias("nuls_total"),
    )
    df = df.select(
        "*",
        F.greatest(F.col("votants_total") - F.col("blancs_total") - F.col("nuls_total"), F.lit(0)).alias("exprimes_total"),
        F.greatest(F.col("inscrits_total") - F.col("votants_total"), F.lit(0)).alias("abstention_total"),
    )
    return df.drop("_p", "_b", "_n", "_bt", "_nt")


def display_index(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return (F.array_position(F.array(*[F.lit(x) for x in DISPLAY_ORDER]), c) - 1).cast("int")


def allocate_counts(df: DataFrame, *, keys: tuple[str, ...], share_col: str, total_col: str, order_col: str) -> DataFrame:
    """Largest-remainder allocation of an integer total over the rows of each group (``allocate_counts``).

    Shares are clipped at 0 and renormalised; floors first, then one more unit to the largest
    remainders (ties -> smaller ``order_col``). Totals <= 0 or all-zero shares give 0 everywhere.
    """
    w = Window.partitionBy(*keys)
    s = F.greatest(F.coalesce(F.col(share_col), F.lit(0.0)), F.lit(0.0))
    df = df.withColumn("_s", s).withColumn("_ssum", F.sum("_s").over(w))
    ok = (F.col(total_col) > 0) & (F.col("_ssum") > 0)
    raw = F.col("_s") / F.when(F.col("_ssum") != 0, F.col("_ssum")) * F.col(total_col)
    df = df.withColumn("_raw", F.when(ok, raw).otherwise(F.lit(0.0))).withColumn("_fl", F.floor("_raw"))
    df = df.withColumn("_rem", F.when(ok, F.col(total_col) - F.sum("_fl").over(w)).otherwise(F.lit(0)))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy((F.col("_raw") - F.col("_fl")).desc(), F.col(order_col).asc()))
    df = df.withColumn("_rk", rank)
    cnt = F.col("_fl") + F.when(F.col("_rk") <= F.col("_rem"), F.lit(1)).otherwise(F.lit(0))
    return df.withColumn("count", cnt.cast("long")).drop("_s", "_ssum", "_raw", "_fl", "_rem", "_rk")


def _trend_parts(local: DataFrame, target_type: str, target_year: int) -> tuple[DataFrame, DataFrame]:
    target_type = target_type.strip().lower()
    # the history feeds three branches (share trends, rate trends, head counts): written once to the
    # shared checkpoint folder, then one hash exchange on the station key serves every aggregate below
    from votepanel.session import cut_lineage

    hist = cut_lineage(prepare_history(local, target_year=target_year), "forecast_history").repartition("code_bv")
    shares = project_shares(hist, target_type, target_year)
    # every station gets the 7 categories (missing ones project to 0) without a join on a scaffold:
    # gather the (at most 7) projections of a station in a map, then explode the fixed category list
    per_station = shares.groupBy("code_bv").agg(
        F.map_from_entries(F.collect_list(F.struct("category", "raw_share"))).alias("_m")
    )
    cats = F.array(*[F.lit(c) for c in DISPLAY_ORDER])
    rows = per_station.select("code_bv", F.posexplode(cats).alias("position", "categorie"), "_m").select(
        "code_bv", "position", "categorie", F.coalesce(F.try_element_at(F.col("_m"), F.col("categorie")), F.lit(0.0)).alias("raw_share")
    )
    w = Window.partitionBy("code_bv")
    tot = F.sum("raw_share").over(w)
    rows = rows.withColumn("predicted_share", F.when(tot > 0, F.col("raw_share") / tot).otherwise(F.lit(0.0)))
    counts = head_counts(project_rates(station_events(hist), target_type, target_year)).where(F.col("inscrits_total").isNotNull())
    joined = rows.join(counts.select("code_bv", "exprimes_total"), on="code_bv", how="inner")
    alloc = allocate_counts(joined, keys=("code_bv",), share_col="predicted_share", total_col="exprimes_total", order_col="position")
    return alloc.select("code_bv", "categorie", "position", "predicted_share", F.col("count").alias("nombre")), counts


def trend_forecast(local: DataFrame, target_type: str, target_year: int) -> DataFrame:
    """Trend forecast for every station: 7 category rows then blank, void and abstention rows.

    Output: code_bv, categorie, position (display order), predicted_share (null for extra rows), nombre.
    """
    blocs, counts = _trend_parts(local, target_type, target_year)
    extra = counts.select(
        "code_bv",
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(name).alias("categorie"), F.lit(len(DISPLAY_ORDER) + i).alias("position"), F.col(col).alias("nombre"))
                    for i, (name, col) in enumerate(zip(EXTRA_ROWS, ("blancs_total", "nuls_total", "abstention_total")))
                ]
            )
        ).alias("_e"),
    ).select("code_bv", "_e.categorie", "_e.position", F.lit(None).cast("double").alias("predicted_share"), "_e.nombre")
    return blocs.unionByName(extra)


def trend_forecast_wide(local: DataFrame, target_type: str, target_year: int) -> DataFrame:
    """One row per station: ``share_{c}``, ``count_{c}`` for the 7 categories and the head counts."""
    blocs, counts = _trend_parts(local, target_type, target_year)
    aggs = []
    for c in DISPLAY_ORDER:
        aggs.append(F.max(F.when(F.col("categorie") == c, F.col("predicted_share"))).alias(f"share_{c}"))
        aggs.append(F.max(F.when(F.col("categorie") == c, F.col("nombre"))).alias(f"count_{c}"))
    wide = blocs.groupBy("code_bv").agg(*aggs)
    extra = [F.col(c).alias(f"count_{n}") for n, c in zip(EXTRA_ROWS, ("blancs_total", "nuls_total", "abstention_total"))]
    return wide.join(counts.select("*", *extra), on="code_bv", how="inner")


def pick_rates(station_stats: DataFrame, town_stats: DataFrame, defaults: DataFrame, target_type: str, target_year: int) -> DataFrame:
    """Rate choice per town (all stations of a town share one pool, as in the original):
    pooled station-events of the town (first rounds when any; target type when present) -> town totals
    (first rounds; target type when present, else all) -> type default -> overall default.

    ``station_stats``: code_commune, code_bv, election_type, election_year, round, date_scrutin, turnout_pct,
    blancs_pct, nuls_pct; ``town_stats``: the same per town; ``defaults``: election_type (null = all) +
    medians."""
    rates = ("turnout_pct", "blancs_pct", "nuls_pct")

    def pool(df: DataFrame, sfx: str) -> DataFrame:
        """Statistics of the towns' pools, and whether the target type is in scope."""
        flags = df.groupBy("code_commune").agg(*[F.max(c.cast("int")).alias(k) for k, c in _scope_flags(target_type).items()])
        order = F.struct("date_scrutin", "code_bv")
        g = trend_statistics(df.join(flags, "code_commune"), ("code_commune",), {f"{r}{sfx}": F.when(_in_scope(target_type), F.col(r)) for r in rates}, order)
        has_t = F.when(F.col("_has_r1") == 1, F.col("_has_r1_t")).otherwise(F.col("_has_t"))
        return g.join(flags.select("code_commune", has_t.alias(f"has_t{sfx}")), "code_commune")

    j = pool(station_stats, "_st").join(pool(town_stats.withColumn("code_bv", F.lit("")), "_tw"), on="code_commune", how="full_outer")
    # one row: the medians of the target type and of all types
    of_type = F.col("election_type") == target_type
    medians = defaults.agg(*[F.max(F.when(c, F.col(r))).alias(f"{n}_{r}") for r in rates for n, c in (("t", of_type), ("d", F.col("election_type").isNull()))])
    j = j.join(F.broadcast(medians), how="cross")
    out = [F.col("code_commune")]
    for r in rates:
        val = F.when(F.col("has_t_st") == 1, _projected(f"{r}_st", target_year, 3, True)).when(F.col("has_t_tw").isNotNull(), _projected(f"{r}_tw", target_year, 3, True)).otherwise(_projected(f"{r}_st", target_year, 3, True))
        out.append(F.coalesce(val, F.col(f"t_{r}"), F.col(f"d_{r}"), F.lit(0.0)).alias(r))
    return j.select(*out)
