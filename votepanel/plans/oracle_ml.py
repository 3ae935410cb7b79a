"""DuckDB texts of the ridge family: sums over rows, and elimination as a recursive query over the rows of a matrix.

The texts take another way than the Spark jobs: features are filled and standardised row by row, products are summed over rows of a
training set, and the equations are solved by Gauss-Jordan steps in SQL.
"""

from __future__ import annotations

from collections.abc import Sequence

from votepanel.constants import CATEGORIES
from votepanel.operators.ml import default_features
from votepanel.plans.oracle import panel_ctes, r6, with_ctes

FEATURES = default_features()
F, T = len(FEATURES), len(CATEGORIES)


def training_panel(target: str = "n_{c}", weight: str = "1.0") -> list[str]:
    """The panel as lists: ``rp(code_bv, election_type, election_year, round, event_key, x, y, w, exprimes)``."""
    y = ", ".join(target.format(c=c) for c in CATEGORIES)
    return [
        *panel_ctes(),
        "rw as (select code_bv, election_type, election_year, round, max(exprimes) as exprimes from fx_local group by all)",
        f"""rp as (select n.code_bv, n.election_type, n.election_year, n.round, n.date_scrutin,
 lower(trim(n.election_type)) || '|' || cast(n.election_year as varchar) || '|' || cast(n.round as varchar) as event_key,
 [{", ".join(f"{f}::double" for f in FEATURES)}] as x, [{y}] as y, [{", ".join(f"n_{c}" for c in CATEGORIES)}] as shares, rw.exprimes, {weight}::double as w
 from fx_norm n join rw using (code_bv, election_type, election_year, round))""",
        """ev as (select event_key, d as date_scrutin, row_number() over (order by d, event_key) - 1 as r, count(*) over () as n
 from (select event_key, min(date_scrutin) as d from rp where date_scrutin is not null group by 1))""",
    ]


def fold_sets(k: int = 3) -> list[str]:
    """Expanding folds over whole elections: ``train`` and ``test`` by fold number."""
    return [
        f"""fo as (select event_key, cast(g.fold as integer) as model, r, n - (least({k}, n - 1) - g.fold) * floor(n / (least({k}, n - 1) + 1)) as st, floor(n / (least({k}, n - 1) + 1)) as t
 from ev, range(0, {k}) g(fold) where g.fold < least({k}, n - 1))""",
        "train as (select model, event_key from fo where r < st)",
        "test as (select model, event_key from fo where r >= st and r < st + t)",
    ]


def split_sets(train: str, test: str, model: str = "'m'") -> list[str]:
    """One training set by conditions on rows."""
    return [f"train as (select distinct {model} as model, event_key from rp where {train})", f"test as (select distinct {model} as model, event_key from rp where {test})"]


def ridge_ctes(alphas: Sequence[float] = (1.0,), back: str = "{p}") -> list[str]:
    """From ``rp, train, test`` to ``diag(model, alpha, keys, category, y_true, y_pred, weight)``: predictions clipped and normalised.

    ``back`` maps a raw prediction to a share."""
    width = F + T
    cats = "[" + ", ".join(f"'{c}'" for c in CATEGORIES) + "]"
    return [
        f"xt as (select t.model, r.code_bv, r.event_key, r.w, u.j, r.x[u.j] as v from train t join rp r using (event_key), range(1, {F + 1}) u(j))",
        "fl as (select model, j, (quantile_disc(floor(v * 4096), 0.5) + 0.5) / 4096 as fill from xt where v is not null group by all)",
        "xf as (select model, code_bv, event_key, w, j, coalesce(v, fill, 0) as v from xt left join fl using (model, j))",
        "mv as (select model, j, sum(w * v) / sum(w) as m from xf group by all)",
        "ms as (select model, j, m, case when d > 1e-6 then sqrt(d) end as s from (select model, j, m, sum(w * (v - m) * (v - m)) / (sum(w) - 1) as d from xf join mv using (model, j) group by all))",
        "zs as (select model, code_bv, event_key, w, j, (v - m) / s as z from xf join ms using (model, j) where s is not null)",
        "sm as (select a.model, a.j as i, b.j as c, sum(a.w * a.z * b.z) as v from zs a join zs b using (model, code_bv, event_key) group by all)",
        f"ym as (select t.model, u.t, sum(r.w * r.y[u.t]) / sum(r.w) as m from train t join rp r using (event_key), range(1, {T + 1}) u(t) group by all)",
        f"bm as (select z.model, z.j as i, {F} + ym.t as c, sum(z.w * z.z * (r.y[ym.t] - ym.m)) as v from zs z join rp r using (code_bv, event_key) join ym using (model) group by all)",
        f"""cell as (select ms.model, a.alpha, ms.j as i, g.c, case when ms.s is null then case when ms.j = g.c then 1.0 else 0.0 end else coalesce(v, 0.0) + case when ms.j = g.c then a.alpha else 0.0 end end as v
 from ms cross join (select unnest([{", ".join(map(repr, map(float, alphas)))}]::double[]) as alpha) a cross join range(1, {width + 1}) g(c)
 left join (select * from sm union all select * from bm) e on e.model = ms.model and e.i = ms.j and e.c = g.c)""",
        f"""gj as (with recursive g(model, alpha, k, i, r) as (
 select model, alpha, 0, i, list(v order by c)::double[] from cell group by model, alpha, i
 union all
 select model, alpha, k + 1, i, case when i = k + 1 then list_transform(p, lambda x: x / p[k + 1]) else list_transform(list_zip(r, p), lambda z: z[1] - r[k + 1] / p[k + 1] * z[2]) end
 from (select *, max(case when i = k + 1 then r end) over (partition by model, alpha) as p from g where k < {F}) s)
 select * from g where k = {F})""",
        f"cf as (select model, alpha, j, u.t, r[{F} + u.t] / s as w, m from (select model, alpha, i as j, r from gj) q join ms using (model, j), range(1, {T + 1}) u(t) where s is not null)",
        "ic as (select ym.model, a.alpha, ym.t, ym.m - coalesce(sum(w * cf.m), 0) as c from ym join (select distinct model, alpha from gj) a using (model) left join cf on cf.model = ym.model and cf.alpha = a.alpha and cf.t = ym.t group by ym.model, a.alpha, ym.t, ym.m)",
        f"""raw as (select t.model, ic.alpha, r.code_bv, r.event_key, ic.t, max(ic.c) + coalesce(sum(cf.w * coalesce(r.x[cf.j], fl.fill, 0)), 0) as p
 from test t join rp r using (event_key) join ic on ic.model = t.model left join cf on cf.model = t.model and cf.alpha = ic.alpha and cf.t = ic.t left join fl on fl.model = t.model and fl.j = cf.j
 group by all)""",
        f"clip as (select *, least(greatest({back.format(p='p')}, 0.0), 1.0) as q from raw)",
        f"""diag as (select c.model, c.alpha, c.code_bv, c.event_key, r.election_type, r.election_year, r.round, {cats}[c.t] as category, r.shares[c.t] as y_true,
 q / case when sum(q) over w = 0 then 1.0 else sum(q) over w end as y_pred, r.exprimes as weight
 from clip c join rp r using (code_bv, event_key) window w as (partition by c.model, c.alpha, c.code_bv, c.event_key))""",
    ]


def metric_columns() -> list[tuple[str, str]]:
    """Expressions and names of the regression metrics over ``diag``."""
    e = "(y_pred - y_true)"
    return [
        (f"avg(abs{e})", "mae_mean"), (f"sqrt(avg({e}*{e}))", "rmse"), (f"quantile_cont(abs{e}, 0.5)", "medae"),
        (f"case when count(*) > 1 then 1 - sum({e}*{e}) / (var_pop(y_true) * count(*)) end", "r2"),
        ("case when count(*) > 1 then 1 - var_pop(y_true - y_pred) / var_pop(y_true) end", "explained_var"),
        (f"case when sum(abs(y_true)) > 0 then sum(abs{e}) / sum(abs(y_true)) end", "wape"),
        (f"avg(2 * abs{e} / (abs(y_true) + abs(y_pred) + 1e-9))", "smape"), (f"avg{e}", "bias"),
    ] + [(f"avg(case when category = '{c}' then abs{e} end)", f"mae_{c}") for c in CATEGORIES]


def ridge_diag(sets: list[str], alphas: Sequence[float] = (1.0,), *, target: str = "n_{c}", back: str = "{p}", weight: str = "1.0") -> str:
    return with_ctes(*training_panel(target, weight), *sets, *ridge_ctes(alphas, back))


def ridge_metrics_sql(sets: list[str], keys: Sequence[tuple[str, str]] = (), alphas: Sequence[float] = (1.0,), **options: str) -> str:
    """Metrics per group; ``keys``: expressions and names."""
    group = ", ".join(k for k, _ in keys)
    cols = [f"{k} as {n}" for k, n in keys] + [f"{r6(x)} as {n}" for x, n in metric_columns()]
    return ridge_diag(sets, alphas, **options) + "select " + ", ".join(cols) + " from diag" + (f" group by {group}" if group else "")


def isotonic_ctes(name: str, fitted: str, asked: str, min_rows: int = 30) -> list[str]:
    """Isotonic maps by walking the lower hull of the cumulative sums, and ``{name}(g, v, y)``: their values at grid values.

    ``fitted``: rows ``g, v, y`` (v: prediction on the grid); ``asked``: rows ``g, v``."""
    return [
        f"{name}_c as (select g, v, sum(w) over o as cw, sum(s) over o as cs, row_number() over o as i from (select g, v, count(*)::double as w, sum(y) as s from ({fitted}) group by g, v) window o as (partition by g order by v))",
        f"""{name}_h as (with recursive h(g, i, k, cw, cs, y) as (
 select distinct g, 0::bigint, 0::bigint, 0.0::double, 0.0::double, null::double from {name}_c where g in (select g from ({fitted}) group by g having count(*) >= {min_rows})
 union all
 select n.g, n.i, n.k, c.cw, c.cs, n.y from (select h.g, h.k as i, arg_min(c.i, (c.cs - h.cs) / (c.cw - h.cw)) as k, min((c.cs - h.cs) / (c.cw - h.cw)) as y from h join {name}_c c on c.g = h.g and c.i > h.k group by h.g, h.k) n
  join {name}_c c on c.g = n.g and c.i = n.k)
 select * from h where y is not null)""",
        f"{name}_t as (select distinct h.g, c.v, h.y from {name}_h h join {name}_c c on c.g = h.g and (c.i = h.i + 1 or c.i = h.k))",
        f"{name}_a as (select distinct g, v from ({asked}))",
        f"{name}_l as (select a.g, a.v, t.v as lv, t.y as ly from {name}_a a asof left join {name}_t t on a.g = t.g and a.v >= t.v)",
        f"{name}_u as (select a.g, a.v, t.v as uv, t.y as uy from {name}_a a asof left join {name}_t t on a.g = t.g and a.v <= t.v)",
        f"{name} as (select g, v, case when ly is null then uy when uy is null then ly when lv = uv then ly else ly + (uy - ly) * (v - lv) / (uv - lv) end as y from {name}_l join {name}_u using (g, v))",
    ]


def calibration_sql(k: int = 3) -> str:
    """Predictions of the test rows of each fold through three maps: of the fold's training rows, of the category in earlier folds, of all in earlier folds."""
    sets = [x.replace("test as (", "tested as (") for x in fold_sets(k)] + ["test as (select * from train union all select * from tested)"]
    keys = "code_bv, election_type, election_year, round"
    grid = "cast(round(least(greatest(y_pred, 0.0), 1.0) * 1000000) as bigint) as v"
    earlier = "select f.f as fold, e.category, e.v, e.y_true as y from dt e, range(0, " + str(k) + ") f(f) where e.tested and f.f > e.fold"
    ctes = [
        f"dt as (select d.model as fold, {', '.join('d.' + c for c in keys.split(', '))}, d.category, y_true, y_pred, {grid}, t.event_key is not null as tested from diag d left join tested t on t.model = d.model and t.event_key = d.event_key)",
        *isotonic_ctes("mf", "select cast(fold as varchar) as g, v, y_true as y from dt where not tested", "select cast(fold as varchar) as g, v from dt where tested"),
        *isotonic_ctes("mb", f"select cast(fold as varchar) || category as g, v, y from ({earlier})", "select cast(fold as varchar) || category as g, v from dt where tested"),
        *isotonic_ctes("ma", f"select cast(fold as varchar) as g, v, y from ({earlier})", "select cast(fold as varchar) as g, v from dt where tested"),
    ]
    on = {"mf": "cast(fold as varchar)", "mb": "cast(fold as varchar) || category", "ma": "cast(fold as varchar)"}
    joins = " ".join(f"left join {m} on {m}.g = {g} and {m}.v = dt.v" for m, g in on.items())
    cols = ", ".join(f"{r6(f'coalesce({m}.y, y_pred)')} as {n}" for m, n in (("mf", "y_cal_fold"), ("mb", "y_cal_bloc"), ("ma", "y_cal_all")))
    return ridge_diag(sets) + ", " + ", ".join(ctes) + f" select {keys}, category, fold, {r6('y_true')} as y_true, floor(y_pred * 10000 + 0.5) / 10000 as y_pred, {cols} from dt {joins} where tested"
