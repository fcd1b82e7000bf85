"""ANSI SQL twins of the registered queries, written against the same tables.

Each statement is assembled from named common table expressions; a statement takes only the ones
it needs. The SQL follows the definitions, not the Spark plans: windows are joined, ranks are
window functions, the Gauss series is summed term by term.
"""

from __future__ import annotations

import re

# Parameters of the literal-parameter forecasts. Published estimates for the
# purchase model (weeks turned into days) and for the spend model.
BG = {"r": 0.243, "alpha": 30.898, "a": 0.793, "b": 2.426}
GG = {"p": 6.25, "q": 3.74, "v": 15.44}
# A small given posterior around them, one row for each draw.
BG_DRAWS = ((0.243, 30.898, 0.793, 2.426), (0.31, 38.5, 0.62, 2.1), (0.2, 24.0, 0.93, 2.9))
GG_DRAWS = ((6.25, 3.74, 15.44), (5.1, 4.2, 19.0), (7.4, 3.3, 12.5))
FORWARD_DAYS = 365
RECENT_DAYS = 91
LOOK_BACKS = (30, 61, 91, 100, 122, 152, 182, 273)
SERIES_TERMS = 1500

_R, _AL, _A, _B = (f"{BG[k]}::double" for k in ("r", "alpha", "a", "b"))
_P, _Q, _V = (f"{GG[k]}::double" for k in ("p", "q", "v"))


def _series(first: str, second: str, third: str, z: str) -> str:
    """2F1 with 0 < second + 1, summed term by term."""
    return (
        f"(1 + list_sum(list_transform(range(1, {SERIES_TERMS + 1}), lambda n: "
        f"({second}) * exp(lgamma(({first}) + n) - lgamma({first}) "
        f"+ lgamma(({second}) + n) - lgamma(({second}) + 1) "
        f"- lgamma(({third}) + n) + lgamma({third}) - lgamma(n + 1.0) + n * ln({z})))))"
    )


def _expected(t: str, r: str = _R, alpha: str = _AL, a: str = _A, b: str = _B) -> str:
    """Conditional expectation over ``t`` days, with the literal parameters where none are given."""
    z = f"({t} / ({alpha} + customer_age + {t}))"
    c = f"({a} + {b} + frequency - 1)"
    series = _series(f"({a} + {b} - 1 - {r})", f"({a} - 1)", c, z)
    return f"(alive * {c} / ({a} - 1) * (1 - power(1 - {z}, {a} - 1) * {series}))"


def _alive(r: str = _R, alpha: str = _AL, a: str = _A, b: str = _B) -> str:
    """Probability of being active, from a row with the customer's state."""
    return (
        f"case when frequency = 0 then 1.0::double else 1 / (1 + {a} / ({b} + frequency - 1) "
        f"* exp(({r} + frequency) * ln(({alpha} + customer_age) / ({alpha} + recency)))) end"
    )


_NEW = (
    f"({_A} + {_B} - 1) / ({_A} - 1) * (1 - power(1 - z, {_A} - 1) * "
    + _series(f"({_A} + {_B} - 1 - {_R})", f"({_A} - 1)", f"({_A} + {_B} - 1)", "z")
    + ")"
)


def _rfm(name: str, occasions: str, start: str, end: str) -> str:
    return f"""{name} as (
  select *,
    case when frequency > 0
      then ((200 * repeat_cents + frequency) // (2 * frequency))::double / 10000 else 0.0 end
      as monetary_value,
    case when frequency > 0
      then (total_spend - first_occasion_spend)::double / frequency else 0.0 end as exact_value,
    frequency > 0 and total_spend > first_occasion_spend as is_gamma_gamma_eligible
  from (
    select source, customer_id, count(*) as occasions, count(*) - 1 as frequency,
      max(order_date) - min(order_date) as recency,
      any_value(w.{end}) - min(order_date) as customer_age,
      min(order_date) as first_order_date, max(order_date) as last_order_date,
      sum(gross_amount) as total_spend, arg_min(gross_amount, order_date) as first_occasion_spend,
      ((sum(gross_amount) - arg_min(gross_amount, order_date)) * 100)::hugeint as repeat_cents
    from {occasions} join win w using (source)
    where order_date between w.{start} and w.{end}
    group by source, customer_id))"""


def _hold(name: str, calibration: str, occasions: str) -> str:
    return f"""{name} as (
  select c.source, c.customer_id, coalesce(n, 0) as holdout_frequency,
    coalesce(spend, 0) as holdout_spend,
    case when n > 0 then ((200 * (spend * 100)::hugeint + n) // (2 * n))::double / 10000
      else 0.0 end as holdout_monetary_value,
    case when n > 0 then spend::double / n else 0.0 end as exact_holdout_value,
    w.duration_holdout
  from {calibration} c join win w using (source)
  left join (
    select source, customer_id, count(*) as n, sum(gross_amount) as spend
    from {occasions} join win using (source)
    where order_date between holdout_start and holdout_end group by 1, 2
  ) h on h.source = c.source and h.customer_id = c.customer_id)"""


def _recent(name: str, calibration: str, occasions: str) -> str:
    return f"""{name} as (
  select c.source, c.customer_id, d.window_days, count(o.order_date) as recent_repeats,
    least(d.window_days, any_value(c.customer_age)) as recent_exposure_days,
    any_value(w.duration_holdout) as duration_holdout
  from {calibration} c join win w using (source)
  cross join (select unnest([{', '.join(str(d) for d in LOOK_BACKS)}]) as window_days) d
  left join {occasions} o
    on o.source = c.source and o.customer_id = c.customer_id
    and o.order_date > c.first_order_date
    and o.order_date > w.calibration_end - d.window_days
    and o.order_date <= w.calibration_end
  group by 1, 2, 3)"""


def _sensitivity(name: str, recent: str, hold: str) -> str:
    return f"""{name} as (
  select r.source, r.window_days, r.customers, r.predicted_purchases, a.actual_purchases,
    100.0::double * (r.predicted_purchases - a.actual_purchases) / a.actual_purchases
      as percent_error
  from (
    select source, window_days, count(*) as customers,
      sum(case when recent_exposure_days > 0
        then recent_repeats::double / recent_exposure_days * duration_holdout else 0.0 end)
        as predicted_purchases
    from {recent} group by 1, 2) r
  join (select source, sum(holdout_frequency)::bigint as actual_purchases from {hold} group by 1) a
    using (source))"""


def _ranked(x: str, by: str) -> str:
    return (
        f"(rank() over (partition by {by} order by {x}) "
        f"+ (count(*) over (partition by {by}, {x}) - 1) / 2.0)"
    )


CTES: dict[str, str] = {
    "tx": """tx as (
  select 'orders' as source, o_custkey as customer_id, o_orderdate::date as order_date,
    l_quantity::integer as quantity, round(l_extendedprice, 2)::decimal(12, 2) as gross_amount
  from lineitem join orders on l_orderkey = o_orderkey
  union all
  select 'events', user_id, ts::date, 1, round(value, 2)::decimal(12, 2)
  from events where event_type = 'purchase')""",
    "occ": """occ as (
  select source, customer_id, order_date, sum(quantity)::bigint as quantity,
    sum(gross_amount) as gross_amount, count(*) as line_items
  from tx group by 1, 2, 3)""",
    "win": """win as (
  select source, s as calibration_start, s + c - 1 as calibration_end, s + c as holdout_start,
    s + c + h - 1 as holdout_end, h as duration_holdout, s as first_order_date,
    e as last_order_date
  from (
    select source, min(order_date) as s, max(order_date) as e,
      case source when 'orders' then 1204 else 14 end as c,
      case source when 'orders' then 1204 else 21 end as h
    from tx group by source))""",
    "cocc": """cocc as (
  select o.* from occ o join win using (source)
  join (select source, customer_id, min(order_date) as acquired from occ group by 1, 2) f
    using (source, customer_id)
  where acquired <= calibration_end - 1)""",
    "cal": _rfm("cal", "occ", "calibration_start", "calibration_end"),
    "full": _rfm("full_rfm", "occ", "calibration_start", "holdout_end"),
    "hold": _hold("hold", "cal", "occ"),
    "recent": _recent("recent", "cal", "occ"),
    "sens": _sensitivity("sens", "recent", "hold"),
    "ccal": _rfm("ccal", "cocc", "calibration_start", "calibration_end"),
    "cfull": _rfm("cfull", "cocc", "calibration_start", "holdout_end"),
    "chold": _hold("chold", "ccal", "cocc"),
    "crecent": _recent("crecent", "ccal", "cocc"),
    "csens": _sensitivity("csens", "crecent", "chold"),
    "state": f"""state as (
  select c.*, duration_holdout,
    {_alive()} as alive,
    case when is_gamma_gamma_eligible
      then {_P} * ({_V} + frequency * monetary_value) / ({_P} * frequency + {_Q} - 1)
      else {_P} * {_V} / ({_Q} - 1) end as value
  from ccal c join win using (source))""",
    "pred": f"""pred as (
  select source, customer_id, horizon_days, purchases as expected_purchases,
    alive as probability_alive, value as expected_avg_value,
    purchases * value as expected_forward_revenue,
    case when is_gamma_gamma_eligible then 'conditional' else 'population_mean' end
      as spend_estimate_source, is_gamma_gamma_eligible
  from (
    select *, duration_holdout as horizon_days, {_expected('duration_holdout')} as purchases
    from state
    union all
    select *, {FORWARD_DAYS} as horizon_days, {_expected(f'{FORWARD_DAYS}.0::double')} as purchases
    from state))""",
    "pop": """pop as (
  select source, sum(frequency)::double / sum(customer_age) as repeat_rate_per_day,
    sum(monetary_value::decimal(18, 4)) filter (is_gamma_gamma_eligible)::double
      / count(*) filter (is_gamma_gamma_eligible) as mean_repeat_order_value
  from ccal group by source)""",
    "base": f"""base as (
  select *, own as baseline_purchases, flat as baseline_purchases_flat,
    order_value as baseline_avg_value, own * order_value as baseline_revenue,
    flat * mean_repeat_order_value as baseline_revenue_flat,
    frequency::double as baseline_carry_forward,
    frequency * order_value as baseline_revenue_carry_forward, recent as baseline_recent,
    recent * order_value as baseline_revenue_recent, 0.0::double as baseline_zero,
    {RECENT_DAYS} as recent_window_days
  from (
    select c.source, c.customer_id, c.frequency, c.recency, c.customer_age, c.monetary_value,
      c.is_gamma_gamma_eligible, h.duration_holdout, h.holdout_frequency, h.holdout_spend,
      h.holdout_monetary_value, p.mean_repeat_order_value,
      case when customer_age > 0 then frequency::double / customer_age * h.duration_holdout
        else 0.0 end as own,
      p.repeat_rate_per_day * h.duration_holdout as flat,
      case when is_gamma_gamma_eligible then monetary_value else mean_repeat_order_value end
        as order_value,
      case when recent_exposure_days > 0
        then recent_repeats::double / recent_exposure_days else 0.0 end * h.duration_holdout
        as recent
    from ccal c join chold h using (source, customer_id) join pop p using (source)
    join crecent r on r.source = c.source and r.customer_id = c.customer_id
      and r.window_days = {RECENT_DAYS}))""",
    "scored": f"""scored as (
  select b.*, b.duration_holdout as horizon_days, expected_purchases, alive as probability_alive,
    value as expected_avg_value, expected_purchases * value as expected_forward_revenue,
    spend_estimate_source
  from base b join (
    select source, customer_id, alive, value, {_expected('duration_holdout')} as expected_purchases,
      case when is_gamma_gamma_eligible then 'conditional' else 'population_mean' end
        as spend_estimate_source
    from state) using (source, customer_id))""",
    "pairs": """pairs as (
  select source, 'purchases' as quantity, unnest(['bg_nbd', 'baseline_recent',
      'baseline_carry_forward', 'baseline_rate', 'baseline_flat', 'baseline_zero']) as family,
    holdout_frequency::double as actual, unnest([expected_purchases, baseline_recent,
      baseline_carry_forward, baseline_purchases, baseline_purchases_flat, baseline_zero])
      as predicted
  from scored
  union all
  select source, 'revenue', unnest(['bg_nbd', 'baseline_recent', 'baseline_carry_forward',
      'baseline_rate', 'baseline_flat', 'baseline_zero']), holdout_spend::double,
    unnest([expected_forward_revenue, baseline_revenue_recent, baseline_revenue_carry_forward,
      baseline_revenue, baseline_revenue_flat, baseline_zero])
  from scored
  union all
  select source, 'avg_order_value', unnest(['bg_nbd', 'baseline_rate']), holdout_monetary_value,
    unnest([expected_avg_value, baseline_avg_value])
  from scored where holdout_frequency > 0)""",
    "scores": f"""scores as (
  select *, case when actual_total <> 0
      then 100 * (predicted_total - actual_total) / actual_total end as percent_error
  from (
    select source, quantity, family, count(*) as population, avg(abs(predicted - actual)) as mae,
      sqrt(avg(power(predicted - actual, 2))) as rmse, sum(actual) as actual_total,
      sum(predicted) as predicted_total,
      case when quantity <> 'purchases' then 100 * avg(abs((predicted - actual) / actual))
        filter (actual <> 0) end as mape,
      case when quantity <> 'purchases' then count(*) filter (actual <> 0) end as mape_included,
      case when quantity <> 'purchases' then count(*) filter (actual = 0) end as mape_excluded,
      case when min(predicted) = max(predicted) or min(actual) = max(actual) then null
        else corr(rp, ra) end as spearman_rho
    from (
      select *, {_ranked('predicted', 'source, quantity, family')} as rp,
        {_ranked('actual', 'source, quantity, family')} as ra
      from pairs)
    group by 1, 2, 3))""",
    "buckets": """buckets as (
  select source, case when frequency <= 6 then frequency::varchar else '7+' end as bucket,
    least(frequency, 7)::bigint as bucket_order, count(*) as customers,
    avg(holdout_frequency) as actual, sum(holdout_frequency)::bigint as actual_total,
    avg(expected_purchases) as bg_nbd, avg(baseline_purchases) as baseline_rate,
    (avg(expected_purchases) - avg(holdout_frequency)) * count(*) as shortfall
  from scored group by 1, 2, 3)""",
    "deciles": """deciles as (
  select *, (row_number() over (partition by source
      order by expected_forward_revenue desc, customer_id) - 1) * 10
      // count(*) over (partition by source) + 1 as decile,
    (row_number() over (partition by source order by baseline_revenue desc, customer_id) - 1) * 10
      // count(*) over (partition by source) + 1 as naive_decile
  from scored)""",
    "decile_rows": """decile_rows as (
  select source, decile, count(*) as customers, avg(expected_forward_revenue) as mean_predicted,
    avg(holdout_spend::double) as mean_actual, sum(holdout_spend::double) as total_actual,
    sum(holdout_spend::double) / sum(sum(holdout_spend::double)) over (partition by source)
      as share_of_actual
  from deciles group by 1, 2)""",
    "naive_rows": """naive_rows as (
  select source, naive_decile as decile, avg(holdout_spend::double) as naive_mean_actual,
    sum(holdout_spend::double) / sum(sum(holdout_spend::double)) over (partition by source)
      as naive_share_of_actual
  from deciles group by 1, 2)""",
    "long_metrics": """long_metrics as (
  select source, family as model_family, quantity,
    unnest(['mae', 'rmse', 'actual_total', 'predicted_total', 'percent_error', 'spearman_rho',
      'mape', 'mape_excluded']) as metric,
    unnest([mae, rmse, actual_total, predicted_total, percent_error, spearman_rho, mape,
      mape_excluded::double]) as value, population
  from scores)""",
    "months": """months as (
  select source, month, days, actual from (
    select source, month,
      coalesce(lead(month) over (partition by source order by month), holdout_end + 1) - month
        as days,
      (select count(*) from cocc o join ccal c using (source, customer_id)
        where o.source = s.source and o.order_date between s.holdout_start and s.holdout_end
          and greatest(date_trunc('month', o.order_date)::date, s.holdout_start) = s.month)
        as actual
    from (
      select source, holdout_start, holdout_end,
        greatest(unnest(generate_series(date_trunc('month', holdout_start)::timestamp,
          holdout_end::timestamp, interval 1 month))::date, holdout_start) as month
      from win) s))""",
    "given_draws": "given_draws as (select * from (values "
    + ", ".join(
        f"({i}, " + ", ".join(f"{v}::double" for v in (*BG_DRAWS[i], *GG_DRAWS[i])) + ")"
        for i in range(len(BG_DRAWS))
    )
    + ") as t(draw_id, r, alpha, a, b, p, q, v))",
    "month_ends": """month_ends as (
  select source, month, days, actual,
    sum(days) over (partition by source order by month)::bigint as to_day from months)""",
    "drawn_months": f"""drawn_months as (
  select source, month, days, actual, draw_id,
    total - coalesce(lag(total) over (partition by source, draw_id order by month), 0) as expected
  from (
    select source, month, days, actual, draw_id,
      sum(n * {_expected("to_day::double", "r", "alpha", "a", "b")}) as total
    from (
      select s.*, m.month, m.days, m.actual, m.to_day, d.draw_id, d.r, d.alpha, d.a, d.b,
        {_alive("d.r", "d.alpha", "d.a", "d.b")} as alive
      from (select source, frequency, recency, customer_age, count(*) as n
            from ccal group by 1, 2, 3, 4) s
      join month_ends m using (source) cross join given_draws d)
    group by 1, 2, 3, 4, 5))""",
    "drawn_forecasts": f"""drawn_forecasts as (
  select source, customer_id, horizon_days, is_gamma_gamma_eligible, draw_id, alive, value,
    purchases, purchases * value as revenue
  from (
    select *, {_expected("horizon_days::double", "r", "alpha", "a", "b")} as purchases,
      case when is_gamma_gamma_eligible
        then p * (v + frequency * monetary_value) / (p * frequency + q - 1)
        else p * v / (q - 1) end as value
    from (
      select c.*, w.duration_holdout as horizon_days, d.*,
        {_alive("d.r", "d.alpha", "d.a", "d.b")} as alive
      from ccal c join win w using (source) cross join given_draws d)))""",
    "new_fit": f"""new_fit as (
  select source, sum({_NEW} * n) as fitted
  from (
    select source, customer_age / ({_AL} + customer_age) as z, count(*) as n
    from ccal group by 1, 2) group by 1)""",
}

# The same relations over every calibration customer, those acquired on the last day included.
_OPEN = {"ccal": "cal", "chold": "hold", "crecent": "recent"}
_RENAMED = ("state", "pop", "base", "scored", "pairs", "scores")
for _name in _RENAMED:
    _text = CTES[_name]
    for _old, _new in {**_OPEN, **{n: f"open_{n}" for n in _RENAMED}}.items():
        _text = re.sub(rf"(\b(?:from|join)\s+){_old}\b", rf"\1{_new}", _text)
    CTES[f"open_{_name}"] = re.sub(rf"^{_name} as", f"open_{_name} as", _text)

# Other CTEs each one reads, found by name so that a statement lists only what it starts from.
_NAMES = {key: re.match(r"\s*(\w+) as", text).group(1) for key, text in CTES.items()}


def _needs(text: str) -> list[str]:
    return [
        key
        for key, name in _NAMES.items()
        if re.search(rf"\b(from|join)\s+{name}\b", text)
    ]


def statement(select: str, **extra: str) -> str:
    """``select`` with every CTE it reads, directly or through another, in dependency order.

    ``extra`` are further CTEs of this statement alone, in order.
    """
    ordered: list[str] = []

    def visit(text: str) -> None:
        for key in _needs(text):
            if key not in ordered:
                visit_one(key)

    def visit_one(key: str) -> None:
        for other in _needs(CTES[key]):
            if other != key and other not in ordered:
                visit_one(other)
        if key not in ordered:
            ordered.append(key)

    for text in extra.values():
        visit(text)
    visit(select)
    parts = [CTES[key] for key in ordered] + [f"{name} as ({text})" for name, text in extra.items()]
    return (f"with {', '.join(parts)} " if parts else "") + select
