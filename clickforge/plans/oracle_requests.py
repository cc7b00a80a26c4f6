"""Oracle SQL for request featurisation and serving statistics."""

from __future__ import annotations

from clickforge.plans.sqlviews import with_views

# Fixed values, written out here so that a wrong constant in the operators shows.
DEFAULT_FEATURES = {
    "feat_e_1": 65.0, "feat_e_3": 5.0, "feat_e_4": -0.05, "feat_e_5": -0.02,
    "feat_e_6": -0.04, "feat_e_7": 21.0, "feat_e_8": -172.0, "feat_e_9": -10.0,
    "feat_e_10": -270.0, "feat_d_1": 0.39, "feat_d_2": 1.93, "feat_d_3": 1.76,
    "feat_d_4": 6.0, "feat_d_5": -0.29, "feat_d_6": -0.41,
    "feat_c_1": 0.0, "feat_c_2": 0.0, "feat_c_3": 0.0, "feat_c_4": 0.0,
    "feat_c_5": 0.0, "feat_c_6": 0.0, "feat_c_7": 0.0, "feat_c_8": 0.0,
    "feat_b_1": 0.0, "feat_b_2": 0.0, "feat_b_3": 0.0, "feat_b_4": 0.0,
    "feat_b_5": 0.0, "feat_b_6": 0.0,
}
DEVICE_CODES = {"mobile": 1, "desktop": 2, "tablet": 3, "unknown": 0}
PAGE_CODES = {"home": 1, "search": 2, "product": 3, "checkout": 4, "category": 5, "unknown": 0}
DAY_CODES = {"monday": 1, "tuesday": 2, "wednesday": 3, "thursday": 4, "friday": 5,
             "saturday": 6, "sunday": 7, "unknown": 0}


def md5_mod(x: str, m: int) -> str:
    two64 = (2 ** 64) % m
    hi = f"(('0x' || substr(md5({x}), 1, 16))::UBIGINT::HUGEINT % {m})"
    lo = f"(('0x' || substr(md5({x}), 17, 16))::UBIGINT::HUGEINT % {m})"
    return f"cast(({hi} * {two64} + {lo}) % {m} as bigint)"


def _codes(x: str, codes: dict[str, int]) -> str:
    whens = " ".join(f"when '{k}' then {v}" for k, v in codes.items())
    return f"coalesce(case lower(coalesce({x}, 'unknown')) {whens} end, 0)"


def request_features_sql() -> str:
    d = ",\n  ".join(f"cast({v} as float) as {k}" for k, v in DEFAULT_FEATURES.items())
    h = "coalesce(hour, 12)"
    pos = "coalesce(position, 1)"
    dow = "lower(dayname(ts))"
    return with_views("requests") + f"""
select event_id,
  {d},
  cast({md5_mod('user_id', 1000000)} as float) as user_hash,
  cast({md5_mod('user_id', 10000)} as float) as user_id_encoded,
  cast({md5_mod('ad_id', 1000000)} as float) as ad_hash,
  cast({md5_mod('ad_id', 10000)} as float) as ad_id_encoded,
  cast({_codes('device', DEVICE_CODES)} as float) as device_encoded,
  cast({_codes('page', PAGE_CODES)} as float) as page_encoded,
  cast({h} as float) as hour,
  cast(({h} >= 6 and {h} < 12)::int as float) as is_morning,
  cast(({h} >= 12 and {h} < 18)::int as float) as is_afternoon,
  cast(({h} >= 18 and {h} < 22)::int as float) as is_evening,
  cast(({h} >= 22 or {h} < 6)::int as float) as is_night,
  cast({_codes(dow, DAY_CODES)} as float) as day_of_week_encoded,
  cast(({dow} in ('saturday', 'sunday'))::int as float) as is_weekend,
  cast({md5_mod("user_id || '_' || ad_id", 100000)} as float) as user_ad_interaction,
  cast({pos} as float) as session_position,
  cast(({pos} = 1)::int as float) as is_first_position,
  cast((epoch_us(ts) % 86400000000) / 86400000000.0 as float) as time_index,
  cast(coalesce(cast(bid_amount as double), {md5_mod('cast(bid_amount as varchar)', 1000)}) as float) as context_bid_amount,
  cast(coalesce(cast(k as double), {md5_mod('cast(k as varchar)', 1000)}) as float) as context_k
from requests"""


def scored_ctes() -> str:
    clip = lambda x: f"greatest(least({x}, 0.9999), 0.0001)"
    return with_views("requests") + f""",
span AS (select min(epoch_us(ts)) as lo, max(epoch_us(ts)) as hi from requests),
early AS (select r.* from requests r cross join span where epoch_us(ts) < lo + (hi - lo) * 60 // 100),
late AS (select r.* from requests r cross join span where epoch_us(ts) >= lo + (hi - lo) * 60 // 100),
g AS (select avg(cast(clicked as double)) as g from early),
prior AS (select ad_id, coalesce((count(clicked) * avg(cast(clicked as double)) + 100.0 * g.g) / (count(clicked) + 100.0), g.g) as p_raw
          from early cross join g group by ad_id, g.g),
fac AS (select case when abs(m - 0.0201) > 0.001 and m > 0 then 0.0201 / m else 1.0 end as factor
        from (select avg({clip('p.p_raw')}) as m from early r left join prior p on r.ad_id is not distinct from p.ad_id)),
s0 AS (select r.event_id, r.ts, r.clicked, r.bid_amount, p.p_raw is not null as success,
         case when p.p_raw is not null then {clip(f"{clip('p.p_raw')} * fac.factor")} else 0.0201 end as p,
         case when p.p_raw is not null then {clip('p.p_raw')} else 0.0201 end as raw
       from late r left join prior p on r.ad_id is not distinct from p.ad_id cross join fac),
scored AS (
  select event_id, ts, clicked, 'ad_prior' as model_used, success,
    p as ctr_prediction, raw as raw_prediction, (p >= 0.5)::int as predicted_click,
    abs(p - 0.5) * 2 as confidence,
    case when p < 0.01 then 'very_low' when p < 0.02 then 'low' when p < 0.05 then 'medium'
         when p < 0.1 then 'high' else 'very_high' end as ctr_category,
    case when p > 0.0201 then 'show' else 'skip' end as recommendation,
    p * coalesce(bid_amount, 1.0) as expected_revenue,
    abs(p - raw) > 1e-6 as postprocessing_applied
  from s0)"""


def request_responses_sql() -> str:
    return scored_ctes() + """
select event_id, ts, clicked, model_used, success, round(ctr_prediction, 9) as ctr_prediction,
  round(raw_prediction, 9) as raw_prediction, predicted_click, round(confidence, 9) as confidence,
  ctr_category, recommendation, round(expected_revenue, 9) as expected_revenue, postprocessing_applied
from scored"""


def response_records_sql() -> str:
    return scored_ctes() + """
select event_id, round(ctr_prediction, 9) as ctr_prediction, predicted_click, ctr_category, recommendation, model_used,
  postprocessing_applied, model_used as model_name, '1' as version, ts as "timestamp" from scored"""


def processed_requests_sql() -> str:
    clip = lambda x: f"greatest(least({x}, 0.9999), 0.0001)"
    return scored_ctes() + f""",
src AS (select *, cast(floor((row_number() over (order by event_id) - 1) / 15000) as bigint) as batch_no from scored),
q AS (select batch_no, greatest(quantile_cont(raw_prediction, 0.01) * 0.1, 0.0001) as lo,
        least(quantile_cont(raw_prediction, 0.99) * 1.1, 0.9999) as hi from src where success group by batch_no),
a AS (select s.event_id, s.batch_no, greatest(least(s.raw_prediction, q.hi), q.lo) as p1 from src s join q on q.batch_no = s.batch_no where s.success),
m AS (select batch_no, avg(p1) as m from a group by batch_no),
b AS (select a.event_id, {clip("case when abs(m.m - 0.0201) > 0.001 and m.m > 0 then " + clip("a.p1 * (0.0201 / m.m)") + " else a.p1 end")} as p
      from a join m on m.batch_no = a.batch_no),
r AS (select src.event_id, src.batch_no, src.success, src.raw_prediction, coalesce(b.p, 0.0201) as p from src left join b on b.event_id = src.event_id)
select event_id, batch_no, success, round(raw_prediction, 9) as raw_prediction, round(p, 9) as ctr_prediction,
  case when p < 0.01 then 'very_low' when p < 0.02 then 'low' when p < 0.05 then 'medium' when p < 0.1 then 'high' else 'very_high' end as ctr_category,
  case when p > 0.0201 then 'show' else 'skip' end as recommendation
from r"""


def serving_stats_sql() -> str:
    return scored_ctes() + """,
base AS (
  select model_used, count(*) as total_requests,
    count(case when success then 1 end) as successful_predictions,
    count(case when not success then 1 end) as failed_predictions,
    avg(cast(postprocessing_applied as double)) as postprocessing_rate,
    avg(ctr_prediction - raw_prediction) as avg_adjustment,
    stddev_pop(ctr_prediction - raw_prediction) as adjustment_std,
    count(case when ctr_prediction > raw_prediction then 1 end) as positive_adjustments
  from scored group by model_used),
rec AS (select * from (select *, row_number() over (partition by model_used order by ts desc, event_id desc) as rn
                       from scored where success) where rn <= 1000),
rs AS (select model_used, avg(ctr_prediction) as ctr_mean, stddev_pop(ctr_prediction) as ctr_std,
         min(ctr_prediction) as ctr_min, max(ctr_prediction) as ctr_max from rec group by model_used)
select b.model_used, b.total_requests, b.successful_predictions, b.failed_predictions,
  round(b.postprocessing_rate, 9) as postprocessing_rate, round(b.avg_adjustment, 9) as avg_adjustment,
  round(b.adjustment_std, 9) as adjustment_std, b.positive_adjustments,
  round(b.successful_predictions / b.total_requests, 9) as success_rate,
  round(b.failed_predictions / b.total_requests, 9) as failure_rate,
  round(rs.ctr_mean, 9) as ctr_mean, round(rs.ctr_std, 9) as ctr_std, round(rs.ctr_min, 9) as ctr_min,
  round(rs.ctr_max, 9) as ctr_max
from base b left join rs on rs.model_used = b.model_used"""


def api_usage_sql() -> str:
    return scored_ctes() + """
select count(*) as total_api_calls, count(case when not success then 1 end) as api_error_count,
  count(case when recommendation = 'show' then 1 end) as shown_count,
  count(case when postprocessing_applied then 1 end) as postprocessing_applied_count,
  round(1.0 - count(case when not success then 1 end) / greatest(count(*), 1), 9) as api_success_rate,
  round(count(case when recommendation = 'show' then 1 end) / greatest(count(*), 1), 9) as shown_rate,
  round(count(case when postprocessing_applied then 1 end) / greatest(count(*), 1), 9) as postprocessing_applied_rate
from scored"""


def recent_predictions_sql() -> str:
    return scored_ctes() + """
select event_id, ts, round(ctr_prediction, 9) as ctr_prediction, ctr_category
from scored order by ts desc, event_id desc limit 1000"""


def stream_window_stats_sql() -> str:
    return scored_ctes() + """,
w AS (select time_bucket(interval '1 day', ts) as window_start, model_used,
        count(*) as requests, count(case when success then 1 end) as successful,
        avg(ctr_prediction) as mean_prediction, avg(cast(clicked as double)) as click_rate
      from scored group by 1, 2)
select window_start, window_start + interval '1 day' as window_end, model_used, requests, successful,
  round(mean_prediction, 9) as mean_prediction, round(click_rate, 9) as click_rate,
  round(mean_prediction - click_rate, 9) as ctr_bias,
  round(case when abs(mean_prediction - click_rate) < 0.0001 then 1.0
             when abs(mean_prediction - click_rate) < 0.0005 then 0.9
             when abs(mean_prediction - click_rate) < 0.001 then 0.7
             when abs(mean_prediction - click_rate) < 0.002 then 0.5
             else greatest(0.0, 1.0 - abs(mean_prediction - click_rate) * 100) end, 9) as ctr_score
from w
where window_start + interval '1 day' <= (select max(ts) from scored) - interval '1 hour'"""


def api_usage_pipeline_sql() -> str:
    parts = ["full_pipeline", "calibration", "ensemble", "postprocessing"]
    counts = ", ".join(f"count(case when {p} then 1 end) as {p}_count" for p in parts)
    rates = ", ".join(f"round({p}_count / greatest(total_api_calls, 1), 9) as {p}_rate" for p in parts)
    return scored_ctes() + f""",
o AS (select success, event_id % 4 <> 1 as c, event_id % 5 <> 2 as e, event_id % 6 = 0 or event_id % 3 <> 0 as p from scored),
f AS (select success, c and e and p as full_pipeline, not (c and e and p) and c as calibration, not (c and e and p) and e as ensemble,
        not (c and e and p) and p as postprocessing from o),
n AS (select count(*) as total_api_calls, count(case when not success then 1 end) as api_error_count, {counts} from f)
select *, round(1.0 - api_error_count / greatest(total_api_calls, 1), 9) as api_success_rate, {rates} from n"""


CONTEXT = """WITH r AS (select event_id, cast(json_extract_string(props, '$.k') as double) as k, value, event_type from events
  where event_id % 11 <> 3 and event_id % 13 <> 5)"""


def open_context_features_sql() -> str:
    rows = ["select event_id, 'context_k' as feature, cast(k as float) as value from r",
            f"select event_id, 'context_value', cast(coalesce(value, {md5_mod("'None'", 1000)}) as float) from r",
            f"select event_id, 'context_referrer', cast({md5_mod('event_type', 1000)} as float) from r",
            "select event_id, 'context_returning', cast(event_id % 2 = 0 as int)::float from r",
            "select event_id, 'context_campaign_' || cast(event_id % 3 as varchar), cast("
            + md5_mod("'c' || cast(event_id % 7 as varchar)", 1000) + " as float) from r"]
    for k, v in DEFAULT_FEATURES.items():
        own = "case when event_id % 4 = 0 and event_id % 11 <> 3 and event_id % 13 <> 5 then 70 else 65 end" if k == "feat_e_1" else str(v)
        rows.append(f"select event_id, '{k}', cast({own} as float) from events")
    return CONTEXT + " " + " union all ".join(rows)


def context_keys_sql() -> str:
    rows = ["select 'k' as key, count(*) as requests, count(*) as numeric from r",
            "select 'value', count(*), count(value) from r", "select 'referrer', count(*), 0 from r",
            "select 'returning', count(*), 0 from r", "select 'hour', count(*), count(*) from r",
            "select 'campaign_' || cast(event_id % 3 as varchar), count(*), 0 from r group by 1",
            "select 'feat_e_1', count(*), count(*) from r where event_id % 4 = 0"]
    return CONTEXT + " " + " union all ".join(rows)
