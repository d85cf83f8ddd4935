"""Checked queries for the recommendation rules R1-R13 (§2.12), one monthly series per store."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import recommend as rec
from ..operators import series as ts
from ..sources.testdata import FACT_CTE, sales_fact
from .registry import register, rnd, with_ctes

K = ["store"]

SERIES_CTE = """ms AS (SELECT store, CAST(date_trunc('month', date) AS DATE) AS period, sum(sales) AS value FROM fact GROUP BY 1, 2),
bnd AS (SELECT store, min(period) AS lo, max(period) AS hi FROM ms GROUP BY store),
cal AS (SELECT store, CAST(unnest(generate_series(lo, hi, INTERVAL 1 MONTH)) AS DATE) AS period FROM bnd),
s AS (SELECT cal.store, cal.period, coalesce(ms.value, 0.0) AS value FROM cal LEFT JOIN ms USING (store, period)),
ov AS (SELECT store, avg(value) AS overall_mean, stddev_samp(value) AS overall_std FROM s GROUP BY store),
m AS (SELECT store, CAST(month(period) AS INTEGER) AS month_num, monthname(any_value(period)) AS month, avg(value) AS mean,
      min(value) AS min, max(value) AS max, stddev_samp(value) AS std, count(value) AS count, sum(value) AS sum FROM s GROUP BY 1, 2),
mo AS (SELECT m.*, ov.overall_mean, ov.overall_std FROM m JOIN ov USING (store))"""
W = with_ctes(FACT_CTE, SERIES_CTE)

DEMAND_CTE = """, d0 AS (SELECT store, avg(value) AS overall_mean, stddev_samp(value) AS overall_std, quantile_cont(value, 0.5) AS overall_median,
       count(value) AS data_points FROM s GROUP BY store),
d1 AS (SELECT *, overall_mean + 0.5 * overall_std AS high_threshold, overall_mean - 0.5 * overall_std AS low_threshold FROM d0),
d AS (SELECT d1.*, count(*) FILTER (WHERE value > high_threshold) AS high_demand_count, count(*) FILTER (WHERE value < low_threshold) AS low_demand_count,
      coalesce(max(value) FILTER (WHERE value > high_threshold), 0.0) AS peak_value, coalesce(min(value) FILTER (WHERE value < low_threshold), 0.0) AS lowest_value,
      CASE WHEN d1.overall_mean <> 0 THEN d1.overall_std / d1.overall_mean ELSE 0.0 END AS volatility
      FROM d1 JOIN s USING (store) GROUP BY ALL)
"""
ELAST_CTE = """, st0 AS (SELECT store, value, lag(value) OVER (PARTITION BY store ORDER BY period) AS prev FROM s),
st1 AS (SELECT store, (value - prev) / nullif(prev, 0) * 100 AS pct FROM st0 WHERE prev IS NOT NULL),
e0 AS (SELECT store, stddev_pop(pct) AS volatility, avg(abs(pct)) AS sensitivity FROM st1 GROUP BY store),
e AS (SELECT store, (volatility + sensitivity) / 2 AS score, volatility, sensitivity,
      CASE WHEN (volatility + sensitivity) / 2 < 10 THEN 'INELASTIC (Price Insensitive)' WHEN (volatility + sensitivity) / 2 < 20 THEN 'MODERATELY ELASTIC'
           ELSE 'HIGHLY ELASTIC (Price Sensitive)' END AS elasticity_type,
      CASE WHEN (volatility + sensitivity) / 2 < 10 THEN 'Product has stable demand - focus on premium positioning'
           WHEN (volatility + sensitivity) / 2 < 20 THEN 'Balanced pricing approach - adjust based on competitors'
           ELSE 'Demand highly sensitive to price - use aggressive discounts' END AS recommendation,
      CASE WHEN (volatility + sensitivity) / 2 < 10 THEN 'MARGIN OPTIMIZATION' WHEN (volatility + sensitivity) / 2 < 20 THEN 'DYNAMIC PRICING'
           ELSE 'VOLUME MAXIMIZATION' END AS optimal_strategy FROM e0)
"""
STOCK_CTE = """, sk AS (SELECT store, month_num, month, CASE WHEN overall_mean <> 0 THEN (mean - overall_mean) / overall_mean * 100 ELSE 0.0 END AS pct, mean FROM mo),
sk2 AS (SELECT store, month_num, month,
  CASE WHEN pct > 15 THEN 'INCREASE' WHEN pct > 5 THEN 'INCREASE' WHEN pct < -15 THEN 'DECREASE' WHEN pct < -5 THEN 'DECREASE' ELSE 'MAINTAIN' END AS action,
  CASE WHEN pct > 15 THEN 'Increase stock levels by 20-30%' WHEN pct > 5 THEN 'Increase stock levels by 10-15%' WHEN pct < -15 THEN 'Reduce stock levels by 20-30%'
       WHEN pct < -5 THEN 'Reduce stock levels by 5-10%' ELSE 'Maintain current stock levels' END AS recommendation,
  CASE WHEN pct > 15 THEN 'HIGH' WHEN pct > 5 THEN 'MEDIUM' WHEN pct < -15 THEN 'MEDIUM' WHEN pct < -5 THEN 'LOW' ELSE 'LOW' END AS priority,
  round(pct, 2) AS percentage_change,
  CASE WHEN pct > 15 THEN 25 WHEN pct > 5 THEN 12 WHEN pct < -15 THEN -25 WHEN pct < -5 THEN -8 ELSE 0 END AS quantity_increase_percent,
  round(mean, 2) AS expected_sales FROM sk)
"""
PRICE_CTE = """, pr AS (SELECT store, month_num, month,
  CASE WHEN mean > overall_mean + overall_std THEN 'PREMIUM PRICING' WHEN mean > overall_mean THEN 'NORMAL PRICING'
       WHEN mean < overall_mean - overall_std THEN 'AGGRESSIVE DISCOUNT' ELSE 'LIGHT DISCOUNT' END AS strategy,
  CASE WHEN mean > overall_mean + overall_std THEN 0 WHEN mean > overall_mean THEN 0 WHEN mean < overall_mean - overall_std THEN 20 ELSE 10 END AS discount_percent,
  CASE WHEN mean > overall_mean + overall_std THEN 'Increase prices by 5-10% due to high demand' WHEN mean > overall_mean THEN 'Maintain current prices'
       WHEN mean < overall_mean - overall_std THEN 'Offer 15-20% discount to stimulate sales' ELSE 'Offer 8-10% discount to encourage purchases' END AS description,
  CASE WHEN mean > overall_mean + overall_std THEN 'High demand allows for price increase to maximize revenue'
       WHEN mean > overall_mean THEN 'Demand is healthy, maintain prices for good margins'
       WHEN mean < overall_mean - overall_std THEN 'Low demand requires aggressive discounts to boost volume'
       ELSE 'Moderate demand - light discounts can increase volume' END AS rationale FROM mo),
pr2 AS (SELECT *, printf('Expected %d%% increase in volume', 5 + discount_percent * 2) AS expected_impact FROM pr)
"""
INV_CTE = """, iv AS (SELECT store, month_num, month, mean, overall_mean, 1.645 * coalesce(std, overall_std) * sqrt(7) AS safety FROM mo),
iv2 AS (SELECT store, month_num, month, round(mean, 2) AS forecasted_demand, round(mean * 7 / 30 + safety, 0) AS reorder_point,
  round(safety, 0) AS safety_stock, round(mean * 7 / 30 + safety + mean, 0) AS max_stock_level, round(safety * 0.5, 0) AS min_stock_level,
  CASE WHEN mean > overall_mean THEN 'CRITICAL' ELSE 'STANDARD' END AS order_urgency,
  CASE WHEN mean > overall_mean THEN 'Pre-order stock' ELSE 'Regular ordering' END AS recommended_action,
  CASE WHEN mean > overall_mean THEN 3 ELSE 7 END AS lead_time_days, round(mean * 0.25 / 12, 2) AS holding_cost_monthly,
  CASE WHEN mean > overall_mean THEN 'FAST' ELSE 'NORMAL' END AS stock_turnover_velocity FROM iv)
"""
FEST_VALUES = ", ".join(f"({n}, '{name}', {d}, {s})" for n, name, d, s in rec.FESTIVALS)
FEST_CTE = f""", fd AS (SELECT * FROM (VALUES {FEST_VALUES}) AS t(month_num, festival_name, base_discount, base_stock)),
fx AS (SELECT ov.store, ov.overall_mean, fd.*, m.mean FROM ov CROSS JOIN fd LEFT JOIN m ON m.store = ov.store AND m.month_num = fd.month_num),
fz AS (SELECT *, coalesce(mean, overall_mean) > overall_mean AS above FROM fx),
fe AS (SELECT store, month_num, monthname(make_date(2000, month_num, 1)) AS month, festival_name,
  greatest(CASE WHEN above THEN base_discount - 5 ELSE base_discount END, 5) AS recommended_discount,
  CASE WHEN above THEN base_stock - 10 ELSE base_stock END AS stock_increase_percent,
  CASE WHEN above THEN 'STANDARD' ELSE 'AGGRESSIVE' END AS campaign_intensity,
  round(10 + (CASE WHEN above THEN base_discount - 5 ELSE base_discount END) * 0.5, 1) AS expected_sales_lift,
  printf('Celebrate %s with special offers!', festival_name) AS promotional_message,
  'Start 2 weeks before, peak 1 week before' AS implementation_timing FROM fz)
"""


def series(spark, sf):
    s = ts.aggregate(sales_fact(spark, sf), "MS", K, positive=False)
    return ts.complete(s, "MS", K, fill_value=0.0)


@register(
    "rec_month_stats",
    W
    + """SELECT store, month_num, month, round(mean, 2) AS mean, round(min, 2) AS min, round(max, 2) AS max, round(std, 2) AS std, count,
       round(sum, 2) AS sum,
       round((mean - lag(mean) OVER (PARTITION BY store ORDER BY month_num)) / nullif(lag(mean) OVER (PARTITION BY store ORDER BY month_num), 0) * 100, 4) AS growth_rate,
       round(std / nullif(mean, 0) * 100, 4) AS cv FROM m""",
)
def q_rec_month_stats(spark, sf):
    return rnd(rec.month_stats(series(spark, sf), K), overrides={"growth_rate": 4, "cv": 4})


@register(
    "rec_demand",
    W
    + DEMAND_CTE
    + """SELECT store, round(overall_mean, 2) AS overall_mean, round(overall_std, 2) AS overall_std, round(overall_median, 2) AS overall_median,
       data_points, round(high_threshold, 2) AS high_threshold, round(low_threshold, 2) AS low_threshold, high_demand_count, low_demand_count,
       round(peak_value, 2) AS peak_value, round(lowest_value, 2) AS lowest_value, round(volatility, 4) AS volatility FROM d""",
)
def q_rec_demand(spark, sf):
    return rnd(rec.demand(series(spark, sf), K), overrides={"volatility": 4})


@register("rec_stock", W + STOCK_CTE + "SELECT * FROM sk2")
def q_rec_stock(spark, sf):
    return rec.stock(series(spark, sf), K)


@register("rec_pricing", W + PRICE_CTE + "SELECT * FROM pr2")
def q_rec_pricing(spark, sf):
    return rec.pricing(series(spark, sf), K)


@register("rec_festival", W + FEST_CTE + "SELECT * FROM fe")
def q_rec_festival(spark, sf):
    return rec.festival(series(spark, sf), K)


@register(
    "rec_elasticity",
    W
    + ELAST_CTE
    + """SELECT store, round(score, 2) AS elasticity_score, elasticity_type, recommendation, optimal_strategy,
       round(volatility, 2) AS volatility_index, round(sensitivity, 2) AS change_sensitivity FROM e""",
)
def q_rec_elasticity(spark, sf):
    return rec.elasticity(series(spark, sf), K)


@register("rec_inventory", W + INV_CTE + "SELECT * FROM iv2")
def q_rec_inventory(spark, sf):
    return rec.inventory(series(spark, sf), K)


STRAT_VALUES = ", ".join(
    "('{}', {}, '{}', '{}', '{}', {}, '{}', '{}')".format(*row) for row in rec.REVENUE_STRATEGIES
)


@register(
    "rec_revenue",
    W
    + ELAST_CTE
    + f""", sv AS (SELECT * FROM (VALUES {STRAT_VALUES}) AS t(for_strategy, rank, name, description, tactic, expected_revenue_impact, risk_level, implementation_timeline)),
r AS (SELECT ov.store, round(ov.overall_mean * 365, 2) AS current_annual_revenue_estimate, e.elasticity_type, e.optimal_strategy, sv.*
      FROM ov JOIN e USING (store) JOIN sv ON sv.for_strategy = e.optimal_strategy)
SELECT store, current_annual_revenue_estimate, elasticity_type, optimal_strategy, rank, name, description, tactic, CAST(expected_revenue_impact AS DOUBLE) AS expected_revenue_impact,
       risk_level, implementation_timeline, round(avg(expected_revenue_impact) OVER (PARTITION BY store), 1) AS estimated_total_revenue_uplift FROM r""",
)
def q_rec_revenue(spark, sf):
    return rec.revenue(series(spark, sf), K)


def _tactics(kind):
    return "[" + ", ".join(f"'{t}'" for t in rec.POSITIONS[kind][2]) + "]"


@register(
    "rec_position",
    W
    + DEMAND_CTE
    + f""", pz AS (SELECT store, peak_value / greatest(lowest_value, 1.0) AS ratio, volatility AS vol FROM d)
SELECT store,
  CASE WHEN ratio > 2.5 THEN '{rec.POSITIONS['niche'][0]}' WHEN vol > 0.4 THEN '{rec.POSITIONS['volatile'][0]}' ELSE '{rec.POSITIONS['stable'][0]}' END AS market_position,
  CASE WHEN ratio > 2.5 THEN '{rec.POSITIONS['niche'][1]}' WHEN vol > 0.4 THEN '{rec.POSITIONS['volatile'][1]}' ELSE '{rec.POSITIONS['stable'][1]}' END AS recommended_strategy,
  CASE WHEN ratio > 2.5 THEN {_tactics('niche')} WHEN vol > 0.4 THEN {_tactics('volatile')} ELSE {_tactics('stable')} END AS tactical_actions,
  round(ratio, 1) AS peak_to_low_ratio,
  CASE WHEN vol > 0.3 THEN 'HIGH' WHEN vol > 0.15 THEN 'MODERATE' ELSE 'LOW' END AS market_volatility,
  CASE WHEN ratio > 2 THEN 'Timing & Availability' WHEN vol < 0.15 THEN 'Reliability' ELSE 'Agility' END AS competitive_advantage_focus FROM pz""",
)
def q_rec_position(spark, sf):
    return rec.position(series(spark, sf), K)


@register(
    "rec_quick_wins",
    W
    + ELAST_CTE
    + INV_CTE
    + """, c AS (SELECT store, count(*) AS n, list(month ORDER BY month_num)[1:3] AS first3 FROM iv2 WHERE order_urgency = 'CRITICAL' GROUP BY store),
tp AS (SELECT store, arg_min(month, (-mean, month_num)) AS peak_month FROM m GROUP BY store)
SELECT store, 1 AS rank, 'Emergency Stock Increase' AS title, printf('%d high-demand periods identified', n) AS description,
       'Immediately increase orders for ' || array_to_string(first3, ', ') AS action, 'Prevent stockouts during peak demand' AS expected_impact,
       'MINIMAL' AS effort, 'This week' AS timeframe, 'LOW' AS risk_level FROM c
UNION ALL
SELECT store, 2, 'Margin Improvement Opportunity', 'Product shows price inelasticity', 'Implement 5-8% price increase immediately',
       '5-8% revenue boost from margin improvement', 'MINIMAL', 'Immediately', 'LOW' FROM e WHERE elasticity_type = 'INELASTIC (Price Insensitive)'
UNION ALL
SELECT store, 3, 'Create Seasonal Bundle', printf('Peak demand in %s', peak_month), printf('Launch bundle offer in %s with 10%% discount for 2-3 items', peak_month),
       '15-20% increase in average order value', 'LOW', '1-2 weeks', 'LOW' FROM tp""",
)
def q_rec_quick_wins(spark, sf):
    return rec.quick_wins(series(spark, sf), K)


@register(
    "rec_top",
    W
    + STOCK_CTE
    + PRICE_CTE
    + INV_CTE
    + FEST_CTE
    + """, t1 AS (SELECT store, 'stock' AS category, month_num, month, action AS label,
        row_number() OVER (PARTITION BY store ORDER BY CASE priority WHEN 'HIGH' THEN 0 WHEN 'MEDIUM' THEN 1 ELSE 2 END, abs(percentage_change) DESC, month_num) AS rank FROM sk2),
t2 AS (SELECT store, 'pricing' AS category, month_num, month, strategy AS label, row_number() OVER (PARTITION BY store ORDER BY month_num) AS rank FROM pr2),
t3 AS (SELECT store, 'festivals' AS category, month_num, month, festival_name AS label, month_num AS rank FROM fe WHERE month_num <= 3),
t4 AS (SELECT store, 'inventory' AS category, month_num, month, order_urgency AS label,
        row_number() OVER (PARTITION BY store ORDER BY CASE order_urgency WHEN 'CRITICAL' THEN 0 ELSE 1 END, month_num) AS rank FROM iv2)
SELECT store, category, month_num, month, label, CAST(rank AS INTEGER) AS rank FROM (
  SELECT * FROM t1 UNION ALL SELECT * FROM t2 UNION ALL SELECT * FROM t3 UNION ALL SELECT * FROM t4) WHERE rank <= 5""",
)
def q_rec_top(spark, sf):
    parts = rec.top_recommendations(series(spark, sf), K, limit=5)
    label = {"stock": "action", "pricing": "strategy", "festivals": "festival_name", "inventory": "order_urgency"}
    out = None
    for cat, df in parts.items():
        p = df.select(*K, F.lit(cat).alias("category"), "month_num", "month", F.col(label[cat]).alias("label"), F.col("rank").cast("int").alias("rank"))
        out = p if out is None else out.unionByName(p)
    return out


@register(
    "rec_summary",
    W
    + DEMAND_CTE
    + ELAST_CTE
    + STOCK_CTE
    + """, sc AS (SELECT store, count(*) FILTER (WHERE action = 'INCREASE') AS increase_months, count(*) FILTER (WHERE action = 'DECREASE') AS decrease_months,
       count(*) AS inventory_points FROM sk2 GROUP BY store),
j AS (SELECT d.*, sc.increase_months, sc.decrease_months, sc.inventory_points, e.elasticity_type, e.recommendation,
      d.peak_value / greatest(d.lowest_value, 1.0) AS ratio FROM d JOIN sc USING (store) LEFT JOIN e USING (store))
SELECT store, data_points, high_demand_count, increase_months, decrease_months, 3 + least(increase_months, 3) AS actionable_items,
  printf('Analyzed %d data points with high demand in %d periods. Increase stock in %d months (high demand), reduce in %d months. Implement dynamic pricing based on elasticity type (%s). Maintain %d optimized reorder points.',
         data_points, high_demand_count, increase_months, decrease_months, coalesce(elasticity_type, 'STANDARD'), inventory_points) AS summary,
  printf('Demand Volatility: %.2f - ', volatility) || CASE WHEN volatility > 0.3 THEN 'High seasonality detected (2.5x+ peak variation)'
       WHEN volatility > 0.15 THEN 'Moderate fluctuations' ELSE 'Stable demand pattern' END AS key_insight_1,
  'Price Elasticity: ' || coalesce(elasticity_type, 'STANDARD') || ' - ' || coalesce(recommendation, 'Monitor pricing carefully') AS key_insight_2,
  printf('Peak/Low Ratio: %.1fx - Significant opportunity for dynamic pricing & inventory management', ratio) AS key_insight_3,
  'Competitive Position: ' || CASE WHEN ratio > 2.5 THEN 'Focus on timing & availability advantage' WHEN volatility < 0.15 THEN 'Emphasize reliability & consistency'
       ELSE 'Build operational agility' END AS key_insight_4,
  'HIGH' AS implementation_priority FROM j""",
)
def q_rec_summary(spark, sf):
    return rec.summary(series(spark, sf), K)


@register("rec_bundle")
def q_rec_bundle(spark, sf):
    return rec.bundle_json(series(spark, sf), K)


@register(
    "jn_festival",
    W + FEST_CTE + """SELECT store, month_num, festival_name, round(coalesce(mean, overall_mean), 2) AS month_sales, above AS above_mean FROM fz""",
)
def q_jn_festival(spark, sf):
    """The 12-row festival dimension attached to every series' month profile (default: the series mean)."""
    s = series(spark, sf)
    per = rec._overall(s, K, "value").select(*K, "overall_mean", F.inline(rec.festival_dimension()))
    m = rec.month_stats(s, K).select(*K, "month_num", "mean")
    j = per.join(m, [*K, "month_num"], "left")
    sales = F.coalesce("mean", "overall_mean")
    return rnd(j.select(*K, "month_num", "festival_name", sales.alias("month_sales"), (sales > F.col("overall_mean")).alias("above_mean")))
