"""Oracle SQL (DuckDB dialect) for the registered queries.

Written independently of the Spark code: plain window functions over whole
tables, which is what the Spark operators must equal.
"""

from __future__ import annotations

from clickforge.plans.sqlviews import with_views

CLIP = "greatest(least({p}, 1-1e-15), 1e-15)"


def r6(expr: str) -> str:
    return f"round({expr}, 6)"


def metric_row_ctes(src: str, keys: list[str], y: str = "clicked", p: str = "p") -> str:
    """CTEs ``mr_base``, ``mr_auc``, ``mr_ap`` over the table ``src``."""
    k = ", ".join(keys)
    kp = f"partition by {k}" if keys else ""
    kg = f"group by {k}" if keys else ""
    kc = f"{k}, " if keys else ""
    pc = CLIP.format(p=p)
    ll = f"-({y}*ln({pc}) + (1-{y})*ln(1-{pc}))"
    w = f"(case when {y}=1 then 49.8 else 1.0 end)"
    return f""",
mr_base AS (
  select {kc} count(*) as n, cast(sum({y}) as bigint) as n_pos,
    sum(case when {p} is null or isnan({p}) or isinf({p}) then 1 else 0 end) as bad,
    sum(case when {p} >= 0.5 and {y}=1 then 1 else 0 end) as tp,
    sum(case when {p} >= 0.5 and {y}=0 then 1 else 0 end) as fp,
    sum(case when not ({p} >= 0.5) and {y}=0 then 1 else 0 end) as tn,
    sum(case when not ({p} >= 0.5) and {y}=1 then 1 else 0 end) as fn,
    avg({ll}) as ll, sum({w}*{ll})/sum({w}) as wll,
    avg(case when {y}=0 then -ln(1-{pc}) end) as ll_neg,
    avg(case when {y}=1 then -ln({pc}) end) as ll_pos,
    avg(cast({y} as double)) as actual_ctr, avg({p}) as predicted_ctr,
    stddev_pop({p}) as pred_std, min({p}) as pred_min, max({p}) as pred_max
  from {src} where {y} is not null {kg}),
mr_d AS (
  select {kc} {p} as s, count(*) as n, sum({y}) as pos from {src}
  where {y} is not null and isfinite({p}) group by {kc} {p}),
mr_dc AS (
  select *, sum(n) over w as n_incl, sum(pos) over w as tp_incl from mr_d
  window w as ({kp} order by s desc rows between unbounded preceding and current row)),
mr_auc AS (
  select {kc} sum(n) as nn, sum(pos) as pp,
    sum(pos * ((n_incl - tp_incl) - (n - pos))) as wrong, sum(pos * (n - pos)) as ties
  from mr_dc {kg}),
mr_a AS (
  select {kc} {pc} as s, count(*) as n, sum({y}) as pos from {src}
  where {y} is not null and isfinite({p}) group by {kc} {pc}),
mr_ac AS (
  select *, sum(n) over w as n_incl, sum(pos) over w as tp_incl from mr_a
  window w as ({kp} order by s desc rows between unbounded preceding and current row)),
mr_ap AS (
  select {kc} case when sum(pos) > 0 and sum(pos) < sum(n) then sum(pos * tp_incl / n_incl) / sum(pos) else 0.0 end as ap
  from mr_ac {kg})"""


def metric_row_select(keys: list[str]) -> str:
    """Final select of the full metric record over the ``mr_*`` CTEs."""
    kc = ", ".join(f"b.{x}" for x in keys)
    kc = kc + ", " if keys else ""
    on_auc = " and ".join(f"b.{x} is not distinct from u.{x}" for x in keys) or "true"
    on_ap = " and ".join(f"b.{x} is not distinct from a.{x}" for x in keys) or "true"
    ok = "(b.n_pos > 0 and b.n_pos < b.n and b.bad = 0)"
    auc = "(u.pp*(u.nn-u.pp) - u.wrong - 0.5*u.ties) / (u.pp*(u.nn-u.pp))"
    comb = "0.5*a.ap + 0.5*(1.0 - least(b.wll, 10.0)/10.0)"
    bias = "(b.predicted_ctr - b.actual_ctr)"
    tp, fp, tn, fn = "b.tp", "b.fp", "b.tn", "b.fn"
    step = (f"case when abs{bias} < 0.0001 then 1.0 when abs{bias} < 0.0005 then 0.9 "
            f"when abs{bias} < 0.001 then 0.7 when abs{bias} < 0.002 then 0.5 "
            f"else greatest(0.0, 1.0 - abs{bias}*100) end")
    return f"""
select {kc} b.n, b.n_pos,
  {r6(f"case when {ok} then {auc} end")} as auc,
  {r6(f"case when {ok} then a.ap else 0.0 end")} as ap,
  {r6(f"case when {ok} then b.ll else 100.0 end")} as log_loss,
  {r6(f"case when {ok} then b.wll else 100.0 end")} as weighted_log_loss,
  {r6(f"case when {ok} then {comb} else 0.0 end")} as combined_score,
  {r6(f"case when {ok} then ({tp}+{tn})/b.n else 0.0 end")} as accuracy,
  {r6(f"case when {ok} and {tp}+{fp} > 0 then {tp}/({tp}+{fp}) else 0.0 end")} as precision,
  {r6(f"case when {ok} and {tp}+{fn} > 0 then {tp}/({tp}+{fn}) else 0.0 end")} as recall,
  {r6(f"case when {ok} and {tn}+{fp} > 0 then {tn}/({tn}+{fp}) else 0.0 end")} as specificity,
  {r6(f"case when {ok} and 2*{tp}+{fp}+{fn} > 0 then 2*{tp}/(2*{tp}+{fp}+{fn}) else 0.0 end")} as f1_score,
  {r6("b.actual_ctr")} as actual_ctr, {r6("b.predicted_ctr")} as predicted_ctr,
  {r6(bias)} as ctr_bias, {r6(f"abs{bias}")} as ctr_absolute_error,
  {r6(f"case when b.actual_ctr > 0 then abs{bias}/b.actual_ctr else 'inf'::double end")} as ctr_relative_error,
  {r6(step)} as ctr_score
from mr_base b left join mr_auc u on {on_auc} left join mr_ap a on {on_ap}"""


def metric_row_sql(keys: list[str], views: tuple[str, ...] = ("long_predictions",),
                   src: str = "long_predictions") -> str:
    return with_views(*views) + metric_row_ctes(src, keys) + metric_row_select(keys)
