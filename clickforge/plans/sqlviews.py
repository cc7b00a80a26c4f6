"""DuckDB forms of the derived tables (FIXTURES.md §3), used as common table
expressions by the oracle SQL of every registered query."""

IMPRESSIONS = """
impressions AS (
  select md5(concat_ws('-', cast(l_orderkey as varchar), cast(l_linenumber as varchar),
             cast(l_partkey as varchar), cast(l_suppkey as varchar),
             cast(date_diff('day', date '1970-01-01', cast(l_shipdate as date)) as varchar),
             cast(cast(round(l_extendedprice*100) as bigint) as varchar))) as row_key,
    cast(l_quantity >= 48 and l_discount >= 0.07 as int) as clicked,
    case l_returnflag when 'A' then '1.0' when 'R' then '2.0' else null end as gender,
    cast(l_linenumber as varchar) as age_group, l_suppkey as inventory_id,
    cast(dayofweek(l_shipdate)+1 as int) as day_of_week,
    cast(l_partkey % 24 as int) as hour,
    l_extendedprice as feat_a_1, l_discount as feat_a_2, l_tax as feat_a_3,
    cast(l_partkey % 50 as double) as history_b_1, l_extendedprice/1000 as history_b_2,
    case when l_linenumber=3 then null else l_tax*100 end as history_b_3,
    l_orderkey as seq, l_returnflag as ad_id_text
  from lineitem)"""

PREDICTIONS = """
predictions AS (
  select row_key, clicked, age_group as segment,
    0.001+feat_a_2*0.3 as p_m1,
    least(feat_a_1/2000000.0, 0.99) as p_m2,
    0.5*(0.001+feat_a_2*0.3)+0.5*least(feat_a_1/2000000.0, 0.99) as p_m3
  from impressions)"""

LONG_PREDICTIONS = """
long_predictions AS (
  select row_key, clicked, segment, 'm1' as model, p_m1 as p from predictions
  union all select row_key, clicked, segment, 'm2', p_m2 from predictions
  union all select row_key, clicked, segment, 'm3', p_m3 from predictions)"""

REQUESTS = """
requests AS (
  select event_id, ts, concat('user_', cast(user_id as varchar)) as user_id,
    concat('ad_', cast(event_id % 20 as varchar), case when event_id % 20 = 7 then concat('_', cast(cast(ts as date) as varchar)) else '' end) as ad_id,
    case when event_id%3=0 then 'Mobile' when event_id%3=1 then 'desktop' else null end as device,
    case event_type when 'view' then 'home' when 'click' then 'product' when 'purchase' then 'checkout'
                    when 'signup' then 'category' else 'weird' end as page,
    cast(hour(ts) as int) as hour, cast(1+event_id%5 as int) as position, value as bid_amount,
    cast(event_type='click' and cast(json_extract_string(props,'$.k') as int) < 10 as int) as clicked,
    cast(json_extract_string(props,'$.k') as int) as k
  from events)"""

TRAIN = """
train AS (select * from impressions where substr(row_key,1,1) not in ('d','e','f'))"""
TEST = """
test AS (select * from impressions where substr(row_key,1,1) in ('d','e','f'))"""

_DEPS = {
    "impressions": (IMPRESSIONS, ()),
    "predictions": (PREDICTIONS, ("impressions",)),
    "long_predictions": (LONG_PREDICTIONS, ("predictions",)),
    "requests": (REQUESTS, ()),
    "train": (TRAIN, ("impressions",)),
    "test": (TEST, ("impressions",)),
}


def with_views(*names: str) -> str:
    """``WITH`` clause holding the named derived tables and their inputs, in
    dependency order; append further CTEs with a leading comma."""
    order: list[str] = []

    def visit(n: str) -> None:
        for d in _DEPS[n][1]:
            visit(d)
        if n not in order:
            order.append(n)

    for n in names:
        visit(n)
    return "WITH " + ",".join(_DEPS[n][0] for n in order)
