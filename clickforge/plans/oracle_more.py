"""Oracle SQL for metrics variants, folds, calibration, ensembles."""

from __future__ import annotations

from clickforge.plans.oracle import metric_row_ctes, metric_row_select, metric_row_sql
from clickforge.plans.sqlviews import with_views


def sub(sql: str) -> str:
    return f"({sql})"


def leaderboard_sql() -> str:
    return f"select *, row_number() over (order by combined_score desc, model) as rank from {sub(metric_row_sql(['model']))}"


def best_model_sql() -> str:
    return f"select arg_max(model, auc) as model, max(auc) as value from {sub(metric_row_sql(['model']))}"


def ap_rowwise_sql() -> str:
    return with_views("long_predictions") + """,
f AS (select model, clicked, row_key, case when p is null or isnan(p) then 0.5 when isinf(p) then
        greatest(least(p, 1-1e-15), 1e-15) else p end as p from long_predictions where clicked is not null),
r AS (select model, clicked,
        sum(clicked) over w as tp, row_number() over w as pos
      from f
      window w as (partition by model order by p desc, row_key rows between unbounded preceding and current row))
select model, round(case when sum(clicked) > 0 then coalesce(sum(case when clicked = 1 then tp / pos end), 0.0) / sum(clicked)
                        else 0.0 end, 6) as ap_rowwise
from r group by model"""


def loss_metrics_sql() -> str:
    return with_views("long_predictions") + metric_row_ctes("long_predictions", ["model"]) + """
select b.model, round(b.ll, 6) as log_loss,
  round(0.5*coalesce(b.ll_neg, 0.0) + 0.5*coalesce(b.ll_pos, 0.0), 6) as balanced_log_loss,
  round(b.wll, 6) as weighted_log_loss, round(a.ap, 6) as ap,
  round(0.5*a.ap + 0.5/(1 + (0.5*coalesce(b.ll_neg, 0.0) + 0.5*coalesce(b.ll_pos, 0.0))), 6) as competition_score,
  round(0.5*a.ap + 0.5*(1 - least(b.wll, 10.0)/10.0), 6) as combined_score
from mr_base b join mr_ap a on a.model = b.model"""


def prediction_summary_sql() -> str:
    return with_views("long_predictions") + """
select model, count(*) as n, round(avg(p), 6) as mean, round(stddev_pop(p), 6) as std,
  round(min(p), 6) as min, round(max(p), 6) as max
from long_predictions group by model"""


def class_weights_sql() -> str:
    return with_views("impressions") + """,
a AS (select case when substr(row_key,1,1) in ('d','e','f') then 'test' else 'train' end as split,
        count(*) as n, cast(sum(clicked) as bigint) as n_pos
      from impressions where clicked is not null group by 1)
select split, n, n_pos, round(n_pos / n, 6) as ctr,
  round(case when n_pos > 0 then (1 - n_pos / n) / (n_pos / n) end, 6) as pos_weight,
  round(case when n_pos > 0 then n / (2.0 * n_pos) end, 6) as balanced_pos,
  round(case when n - n_pos > 0 then n / (2.0 * (n - n_pos)) end, 6) as balanced_neg
from a"""


def click_rate_by_value_sql() -> str:
    from clickforge.plans.oracle_features import CATS, cat_text
    parts = "\n  union all ".join(
        f"select '{c}' as column_name, {cat_text(c)} as value, clicked from train" for c in CATS)
    return with_views("train") + f""",
lv AS ({parts})
select column_name, value, count(*) as n, count(clicked) as n_labelled,
  round(avg(cast(clicked as double)), 6) as ctr
from lv group by column_name, value"""


def folds_sql() -> str:
    return with_views("impressions") + """
select row_key, clicked,
  cast((row_number() over (partition by clicked order by md5(row_key || '42')) - 1) % 5 as int) as fold
from impressions"""


def holdout_sql() -> str:
    return with_views("impressions") + """,
r AS (select row_key, clicked,
        row_number() over (partition by clicked order by md5(row_key || '42')) - 1 as i,
        count(*) over (partition by clicked) as nc
      from impressions)
select row_key, clicked, i < floor(nc * 0.2 + 0.5) as is_valid from r"""


def ids_sql() -> str:
    return with_views("test") + """
select row_key, printf('TEST_%07d', row_number() over (order by row_key) - 1) as ID from test"""


def _clip(x: str, lo: str = "1e-15", hi: str = "1-1e-15") -> str:
    return f"greatest(least({x}, {hi}), {lo})"


def correction_ctes(src: str, p: str, target: float = 0.0191) -> str:
    return f""",
c0 AS (select *, {_clip(p)} as p0 from {src}),
c1 AS (select *, case when m1 > 0 then {_clip(f'p0 * ({target} / m1)')} else {target} end as p1
       from c0 cross join (select avg(p0) as m1 from c0)),
c2 AS (select *, case when abs(m2 - {target}) > 0.001 then {_clip(f'p1 * ({target} / m2)')} else p1 end as p_corrected
       from c1 cross join (select avg(p1) as m2 from c1)),
c3 AS (select *, abs(avg(p_corrected) over () - {target}) < 0.001 as ctr_ok from c2)"""


def ctr_correction_sql() -> str:
    return (with_views("predictions") + ",\nsrc AS (select row_key, p_m1 as p from predictions)"
            + correction_ctes("src", "p") + "\nselect row_key, round(p_corrected, 9) as p_corrected, ctr_ok from c3")


def quantiles_sql() -> str:
    return with_views("long_predictions") + """
select model, round(quantile_cont(p, 0.01), 9) as p01, round(quantile_cont(p, 0.5), 9) as p50,
  round(quantile_cont(p, 0.99), 9) as p99
from long_predictions group by model"""


def post_process_sql() -> str:
    return with_views("predictions") + f""",
src AS (select row_key, p_m2 as p from predictions),
q AS (select greatest(quantile_cont(p, 0.01) * 0.1, 0.0001) as lo, least(quantile_cont(p, 0.99) * 1.1, 0.9999) as hi from src),
a AS (select row_key, greatest(least(p, hi), lo) as p1 from src cross join q),
m AS (select avg(p1) as m from a),
b AS (select row_key, case when abs(m - 0.0201) > 0.001 and m > 0 then {_clip('p1 * (0.0201 / m)', '0.0001', '0.9999')}
                           else p1 end as p2 from a cross join m)
select row_key, round({_clip('p2', '0.0001', '0.9999')}, 9) as p from b"""


def submission_sql() -> str:
    return (with_views("predictions") +
            ",\nsrc AS (select row_key, p_m3 as p from predictions where substr(row_key,1,1) in ('d','e','f'))"
            + correction_ctes("src", "p") +
            "\nselect printf('TEST_%07d', row_number() over (order by row_key) - 1) as ID, "
            "round(p_corrected, 9) as clicked from c3")


def _weights_ctes(src: str, model_col: str = "model") -> str:
    return metric_row_ctes(src, [model_col]).replace("mr_", "ew_") + f""",
ew_bias AS (select {model_col}, abs(avg(p) - avg(cast(clicked as double))) as bias from {src} group by {model_col}),
ew_s AS (select u.{model_col}, (u.pp*(u.nn-u.pp) - u.wrong - 0.5*u.ties) / (u.pp*(u.nn-u.pp)) as auc, a.ap, b.bias
         from ew_auc u join ew_ap a on a.{model_col} = u.{model_col} join ew_bias b on b.{model_col} = u.{model_col}),
ew_raw AS (select {model_col},
    coalesce(greatest(0.5*auc + 0.5*ap, 0.1), 0.1) as perf,
    coalesce(greatest((0.5*auc + 0.5*ap) * (1 - least(bias*10.0, 0.5)), 0.1), 0.1) as stack,
    coalesce(greatest((0.5*auc + 0.5*ap) * (1 - least(bias*15.0, 0.6)), 0.05), 0.05) as corr
  from ew_s),
ew AS (select {model_col}, perf / sum(perf) over () as perf_weight, stack / sum(stack) over () as stack_weight,
         corr / sum(corr) over () as corr_weight from ew_raw)"""


def ensemble_weights_sql() -> str:
    return (with_views("long_predictions") + _weights_ctes("long_predictions") +
            "\nselect model, round(perf_weight, 6) as perf_weight, round(stack_weight, 6) as stack_weight, "
            "round(corr_weight, 6) as corr_weight from ew")


def ensemble_strategies_sql() -> str:
    models = ["p_m1", "p_m2", "p_m3"]
    lp = "\n  union all ".join(f"select row_key, clicked, '{m}' as model, {m} as p from predictions" for m in models)
    w = lambda kind, m: f"(select {kind}_weight from ew where model = '{m}')"

    def wavg(kind):
        num = " + ".join(f"coalesce({w(kind, m)}, 0.0) * {m}" for m in models)
        den = " + ".join(f"coalesce({w(kind, m)}, 0.0)" for m in models)
        return f"case when ({den}) > 0 then ({num}) / ({den}) else ({' + '.join(models)}) / 3 end"

    strat = f"""
sp AS (select row_key, clicked, ({' + '.join(models)}) / 3 as simple_average,
         {wavg('perf')} as performance_weighted, {wavg('corr')} as ctr_corrected from predictions),
sl AS (select row_key, clicked, 'simple_average' as strategy, simple_average as p from sp
  union all select row_key, clicked, 'performance_weighted', performance_weighted from sp
  union all select row_key, clicked, 'ctr_corrected', ctr_corrected from sp)"""
    mr = metric_row_ctes("sl", ["strategy"]) + metric_row_select(["strategy"])
    return (with_views("predictions") + f",\nlp AS ({lp})" + _weights_ctes("lp") + "," + strat + mr.replace(
        "\nselect b.strategy", "\n, mrow AS (select b.strategy", 1) + f""")
select strategy, combined_score, ctr_score, ap, weighted_log_loss,
  row_number() over (order by combined_score desc,
     list_position(['simple_average', 'performance_weighted', 'ctr_corrected'], strategy)) = 1
     and combined_score > -1 as selected,
  combined_score >= 0.35 as target_reached
from mrow""")


def comparison_report_sql() -> str:
    return f"""select count(*) as n_models, round(avg(combined_score), 6) as mean_score,
  round(stddev_samp(combined_score), 6) as std_score, round(avg(ctr_bias), 6) as mean_ctr_bias,
  count(case when combined_score >= 0.34 then 1 end) as n_reaching_target,
  round(max(combined_score), 6) as best_score,
  case when max(combined_score) >= 0.34 then 'deploy_best' else 'improve_models' end as recommendation
from {sub(metric_row_sql(['model']))}"""


def _experiment_metrics_sql() -> str:
    """Per-model metric values of the two logged runs, rounded as the text log prints them."""
    full = metric_row_ctes("long_predictions", ["model"]).replace("mr_", "fa_")
    trn = metric_row_ctes("lp_train", ["model"]).replace("mr_", "tr_")

    def sel(pfx, run, num):
        ok = f"(b.n_pos > 0 and b.n_pos < b.n and b.bad = 0)"
        auc = "(u.pp*(u.nn-u.pp) - u.wrong - 0.5*u.ties) / (u.pp*(u.nn-u.pp))"
        return f"""select {num} as experiment_num, '{run}' as run_model, b.model,
  round(case when {ok} then {auc} end, 4) as auc, round(case when {ok} then a.ap else 0.0 end, 4) as ap,
  round(b.actual_ctr, 6) as actual_ctr, round(b.predicted_ctr, 6) as predicted_ctr,
  round(b.predicted_ctr - b.actual_ctr, 6) as ctr_bias
from {pfx}_base b join {pfx}_auc u on u.model = b.model join {pfx}_ap a on a.model = b.model"""
    return (with_views("long_predictions") +
            ",\nlp_train AS (select * from long_predictions where substr(row_key,1,1) not in ('d','e','f'))"
            + full + trn + f""",
runs AS ({sel('fa', 'all_rows', 1)}
  union all {sel('tr', 'train_split', 2)}),
firsts AS (select experiment_num, arg_min(auc, model) as first_auc, count(*) as successful_models
           from runs group by experiment_num)""")


def experiment_log_sql() -> str:
    return _experiment_metrics_sql() + """
select r.experiment_num, r.run_model, r.model, r.auc, r.ap, r.actual_ctr, r.predicted_ctr, r.ctr_bias,
  f.first_auc, cast(f.successful_models as int) as successful_models
from runs r join firsts f on f.experiment_num = r.experiment_num"""


def experiment_summary_sql() -> str:
    return _experiment_metrics_sql() + """
select count(*) as n_experiments, arg_max(experiment_num, first_auc) as best_experiment,
  max(first_auc) as best_auc, max(experiment_num) as latest_experiment
from firsts"""


def sample_rows_sql() -> str:
    return with_views("impressions") + "\nselect * from impressions order by md5(row_key || '42') limit 1000"


def dataset_check_sql() -> str:
    # the given files are below the floors of 1000 and 100 MB; DuckDB's views don't tell file sizes
    return """select 'train' as table_name, count(*) as row_count, count(*) = 10704179 as rows_ok, false as size_ok from lineitem
union all select 'test', count(*), count(*) = 1527298, false from events"""


def alignment_check_sql() -> str:
    return with_views("impressions") + """,
l AS (select row_key from impressions where substr(row_key,1,1) in ('d','e','f')),
j AS (select l.row_key as lk, r.row_key as rk from l full outer join impressions r on l.row_key = r.row_key)
select count(lk) as left_rows, count(rk) as right_rows,
  count(case when rk is null then 1 end) as left_only, count(case when lk is null then 1 end) as right_only,
  count(case when rk is null then 1 end) = 0 and count(case when lk is null then 1 end) = 0 as aligned
from j"""


def distinct_counts_sql() -> str:
    from clickforge.plans.oracle_features import IMPRESSION_COLUMNS
    parts = " union all ".join(
        f"select '{c}' as column_name, count({c}) as non_null, count(distinct {c}) as n_distinct from impressions"
        for c, _ in IMPRESSION_COLUMNS)
    return with_views("impressions") + "\n" + parts


def minimal_features_sql() -> str:
    cols = ["inventory_id", "day_of_week", "hour", "feat_a_1", "feat_a_2", "feat_a_3",
            "history_b_1", "history_b_2", "history_b_3"]
    sel = ", ".join(f"coalesce({c}, 0) as {c}" for c in cols)
    return with_views("impressions") + f"""
select row_key, {sel},
  case when substr(row_key,1,1) in ('d','e','f') then 'test' else 'train' end as split
from impressions"""


def basic_features_sql() -> str:
    from clickforge.plans.oracle_features import CATS, NUMS, code_ctes, coded_ctes, normalized_ctes
    return (normalized_ctes() + code_ctes() + coded_ctes() +
            f"\nselect row_key, split, {', '.join(CATS + NUMS)} from coded")


def table_scoring_sql() -> str:
    clip = lambda x: f"greatest(least({x}, 0.9999), 0.0001)"
    return with_views("predictions") + f""",
src AS (select row_key, p_m2 as p, cast(floor((row_number() over (order by row_key) - 1) / 80000) as bigint) as batch_id
        from predictions where substr(row_key,1,1) in ('d','e','f')),
q AS (select batch_id, greatest(quantile_cont(p, 0.01) * 0.1, 0.0001) as lo,
        least(quantile_cont(p, 0.99) * 1.1, 0.9999) as hi from src group by batch_id),
a AS (select s.row_key, s.batch_id, greatest(least(s.p, q.hi), q.lo) as p1 from src s join q on q.batch_id = s.batch_id),
m AS (select batch_id, avg(p1) as m from a group by batch_id),
b AS (select a.row_key, a.batch_id,
        {clip("case when abs(m.m - 0.0201) > 0.001 and m.m > 0 then " + clip("a.p1 * (0.0201 / m.m)") + " else a.p1 end")} as p2
      from a join m on m.batch_id = a.batch_id),
g AS (select avg(p2) as gm from b)
select row_key, batch_id,
  round(case when abs(gm - 0.0201) > 0.002 and gm > 0 then {clip("p2 * (0.0201 / gm)")} else p2 end, 9) as p
from b cross join g"""


def submission_csv_sql() -> str:
    return submission_sql()


def _dirty() -> str:
    return with_views("long_predictions") + """,
dirty AS (select model, clicked, case when model = 'm1' and segment = '3' then 'nan'::double
    when model = 'm1' and segment = '4' then null when model = 'm2' and segment = '1' then 'inf'::double
    when model = 'm2' and segment = '2' then '-inf'::double else p end as p from long_predictions)"""


def metrics_unrepaired_sql() -> str:
    return _dirty() + metric_row_ctes("dirty", ["model"]) + metric_row_select(["model"])


def leaderboard_repaired_sql() -> str:
    inner = _dirty() + """,
repaired AS (select model, clicked, case when model = 'm3' then p when p is null or isnan(p) then 0.5
    else greatest(least(p, 1-1e-15), 1e-15) end as p from dirty)""" + metric_row_ctes("repaired", ["model"]) + metric_row_select(["model"])
    return f"select *, row_number() over (order by combined_score desc, model) as rank from {sub(inner)}"


def missing_column_sql() -> str:
    from clickforge.plans.oracle_features import code_ctes, coded_ctes, normalized_ctes
    return (normalized_ctes() + code_ctes() + coded_ctes() +
            "\nselect row_key, split, feat_a_1, cast(0 as float) as feat_a_2, hour from coded")


def cleaned_values_sql() -> str:
    v = """case age_group when '1' then 'nan'::double when '2' then 'inf'::double when '3' then '-inf'::double
      when '4' then null else feat_a_3 end"""
    return with_views("impressions") + f""",
x AS (select row_key, {v} as v from impressions)
select row_key, cast(case when v is null or isnan(v) or isinf(v) then 0.0 else v end as float) as train_value,
  cast(case when v is null or isnan(v) then 0.0 when isinf(v) and v > 0 then 1e6 when isinf(v) then -1e6 else v end as float) as score_value
from x"""


def ensemble_main_sql() -> str:
    return with_views("predictions") + """,
x AS (select row_key, case when segment <> '5' then p_m1 end as a, case when segment <> '6' then p_m2 end as b,
        case when segment <> '6' or p_m3 > 0.02 then p_m3 end as f from predictions)
select row_key, round(coalesce((0.3 * a + 0.2 * b) / 0.5, f, 0.0191), 12) as p,
  case when a is not null and b is not null then 'ensemble' when f is not null then 'single_model' else 'default' end as source,
  round(0.5 * a + 0.5 * b, 12) as p_equal
from x"""


def keyed_metrics_sql() -> str:
    return (with_views("predictions") + """,
k AS (select 'm2' as model, p.p_m2 as p, i.clicked from predictions p join impressions i on p.row_key = i.row_key
      where substr(i.row_key,1,1) in ('d','e','f'))""" + metric_row_ctes("k", ["model"]) + metric_row_select(["model"]))


def submission_template_sql() -> str:
    return (with_views("predictions") +
            ",\nsrc AS (select row_key, p_m3 as p from predictions where substr(row_key,1,1) in ('d','e','f'))"
            + correction_ctes("src", "p") +
            "\nselect row_key, printf('T-%09d', row_number() over (order by row_key) - 1) as ID, "
            "round(p_corrected, 9) as clicked from c3")


def label_confirmation_sql() -> str:
    return """select 'provided' as case_name, 'clicked' as label union all select 'candidate', 'target'
union all select 'default', 'clicked'"""


def fold_metrics_summary_sql() -> str:
    return f"""select model, count(*) as n_folds, round(avg(weighted_log_loss), 6) as weighted_log_loss_mean,
  round(stddev_pop(weighted_log_loss), 6) as weighted_log_loss_std, round(avg(predicted_ctr), 6) as predicted_ctr_mean,
  round(stddev_pop(predicted_ctr), 6) as predicted_ctr_std
from {sub(_unrounded(metric_row_sql(['model', 'segment'])))} group by model"""


def _unrounded(sql: str) -> str:
    return sql.replace(", 6)", ", 15)")


def training_report_sql() -> str:
    return f"""select count(*) as n_models, round(avg(auc), 6) as avg_auc, round(avg(ap), 6) as avg_ap,
  round(avg(log_loss), 6) as avg_log_loss, round(avg(case when model = 'm3' then 1.0 else 0.0 end), 6) as calibrated_share
from {sub(_unrounded(metric_row_sql(['model'])))}"""


def batches_by_name_sql() -> str:
    return with_views("impressions") + """
select row_key, feat_a_1, null::double as feat_a_2, clicked from impressions where substr(row_key,1,1) not in ('d','e','f')
union all select row_key, null, feat_a_2, null from impressions where substr(row_key,1,1) in ('d','e','f')"""


def default_predictions_sql() -> str:
    return with_views("predictions") + """
select row_key, round(case when segment <> '2' then p_m1 else 0.0191 end, 9) as trained,
  round(case when segment <> '2' then p_m1 else 0.0201 end, 9) as served from predictions"""


def diversity_noise_sql() -> str:
    unit = lambda at: f"cast(cast('0x' || substr(md5(row_key || '7'), {at}, 8) as ubigint) as double)"
    return with_views("predictions") + f""",
src AS (select row_key, p_m1 as p from predictions),
q AS (select greatest(quantile_cont(p, 0.01) * 0.1, 0.0001) as lo, least(quantile_cont(p, 0.99) * 1.1, 0.9999) as hi from src),
a AS (select row_key, greatest(least(p, hi), lo) as x from src cross join q),
s AS (select count(distinct x) as nd, stddev_pop(x) as sd from a),
n AS (select row_key, case when nd < 1000 then {_clip(f"x + sqrt(-2 * ln(({unit(1)} + 1) / 4294967296.0)) * cos({unit(9)} * (2 * pi() / 4294967296.0)) * greatest(sd * 0.008, 1e-6)", '0.0001', '0.9999')}
        else x end as x from a cross join s),
m AS (select avg(x) as m from n),
b AS (select row_key, case when abs(m - 0.0201) > 0.001 and m > 0 then {_clip('x * (0.0201 / m)', '0.0001', '0.9999')} else x end as x from n cross join m)
select row_key, round({_clip('x', '0.0001', '0.9999')}, 9) as p from b"""


def experiment_export_sql() -> str:
    full = metric_row_ctes("long_predictions", ["model"])
    return with_views("long_predictions") + full + """
select 1 as experiment_num, 'all_rows' as run_model, b.model,
  round((u.pp*(u.nn-u.pp) - u.wrong - 0.5*u.ties) / (u.pp*(u.nn-u.pp)), 9) as auc, round(a.ap, 9) as ap,
  round(b.actual_ctr, 9) as actual_ctr, round(b.predicted_ctr, 9) as predicted_ctr,
  round(b.predicted_ctr - b.actual_ctr, 9) as ctr_bias
from mr_base b join mr_auc u on u.model = b.model join mr_ap a on a.model = b.model"""
