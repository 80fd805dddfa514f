"""Query registry and the shared SQL fragments used by the comparison queries."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidecast.fixed_values import PROMO_EVERY_YEAR, PROMO_ODD_YEARS, PROMO_TITLES

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a plan under ``name``; ``sql`` may use any fragment of ``FRAGMENTS`` by its x_ name."""
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_fragments(sql)
        return fn
    return add


def settled(expr: str, places: int) -> str:
    """SQL twin of ``functions.scalars.settle``."""
    unit = 10 ** places
    return f"(floor(CAST(({expr}) AS DOUBLE) * {unit} + 0.5001) / {unit})"


def _panel_fragments(tag: str, key: str) -> dict[str, str]:
    """Daily sales, spine, filled series and complete-year panel for one choice of series key."""
    s, sp, de, fi, pa = (f"x_{n}{tag}" for n in ("sales", "spine", "dense", "filled", "panel"))
    edge = ("last_value({c} IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY ds "
            "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)",
            "first_value({c} IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY ds "
            "ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)")
    day = "CASE WHEN {c} IS NOT NULL THEN ds END"
    cols = []
    for c in ("revenue", "cogs"):
        cols += [f"{edge[0].format(c=c)} AS {c}_0", f"{edge[1].format(c=c)} AS {c}_1",
                 f"{edge[0].format(c=day.format(c=c))} AS {c}_d0", f"{edge[1].format(c=day.format(c=c))} AS {c}_d1"]
    lines = [f"coalesce({c}, CASE WHEN {c}_1 IS NULL THEN {c}_0 ELSE {c}_0 + ({c}_1 - {c}_0) * (ds - {c}_d0) "
             f"/ ({c}_d1 - {c}_d0) END) AS {c}" for c in ("revenue", "cogs")]
    return {
        s: f"""SELECT {key} AS series_id, ds,
               CAST(round(sum(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,4))), 0) AS DOUBLE) AS revenue,
               CAST(round(sum(CAST(1.75 * l_quantity * p_retailprice AS DECIMAL(18,4))), 0) AS DOUBLE) AS cogs
               FROM x_lines GROUP BY 1, 2""",
        sp: f"""SELECT series_id, CAST(unnest(generate_series(CAST(lo AS TIMESTAMP), CAST(hi AS TIMESTAMP),
               INTERVAL 1 DAY)) AS DATE) AS ds
               FROM (SELECT series_id, min(ds) AS lo, max(ds) AS hi FROM {s} GROUP BY 1)""",
        de: f"SELECT series_id, ds, revenue, cogs FROM {sp} LEFT JOIN {s} USING (series_id, ds)",
        fi: f"SELECT series_id, ds, {', '.join(lines)} FROM (SELECT *, {', '.join(cols)} FROM {de})",
        pa: f"""SELECT series_id, ds, revenue, cogs FROM (
               SELECT *, count(*) OVER (PARTITION BY series_id, year(ds)) AS n FROM {fi}) WHERE n >= 360""",
    }


def _promo_rows() -> str:
    rows = [f"('{f}', '{PROMO_TITLES[f]}', {s}, {n}, {1 if f in PROMO_ODD_YEARS else 0})"
            for f, (s, n) in {**PROMO_EVERY_YEAR, **PROMO_ODD_YEARS}.items()]
    return ", ".join(rows)


FRAGMENTS: dict[str, str] = {
    "x_orders": "SELECT *, CAST(o_orderdate AS DATE) AS ds FROM orders",
    "x_lines": """SELECT ds, l_orderkey, l_partkey, p_type, p_retailprice, l_quantity, l_extendedprice, l_discount
                  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN x_orders ON l_orderkey = o_orderkey""",
    **_panel_fragments("", "p_type"),
    **_panel_fragments("_all", "'ALL'"),
    "x_traffic_src": """SELECT ds, o_orderpriority AS source, count(*) AS sessions,
                  count(DISTINCT o_custkey) AS unique_visitors,
                  avg(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS bounce_rate,
                  CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / count(*) / 1000 AS avg_session_duration_sec
                  FROM x_orders GROUP BY 1, 2""",
    "x_traffic": "SELECT ds, CAST(sum(sessions) AS BIGINT) AS sessions FROM x_traffic_src GROUP BY 1",
    "x_inv": """SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS snap, l_partkey AS product_id,
                  max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS stockout_flag,
                  max(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END) AS overstock_flag,
                  avg(CASE WHEN l_returnflag = 'R' THEN 0 ELSE 1 END) AS fill_rate,
                  sum(l_quantity) AS days_of_supply, CAST(sum(l_quantity) AS BIGINT) AS units_sold,
                  avg(CASE WHEN l_linestatus = 'O' THEN 0 ELSE 1 END) AS sell_through_rate
                  FROM lineitem GROUP BY 1, 2""",
    "x_month": """SELECT snap, avg(stockout_flag) AS stockout_pct, avg(overstock_flag) AS overstock_pct,
                  avg(days_of_supply) AS days_of_supply, avg(fill_rate) AS fill_rate,
                  max(stockout_flag) AS stockout_any FROM x_inv GROUP BY 1""",
    "x_promos": f"""SELECT family, title || ' ' || CAST(year AS VARCHAR) AS promo_name, CAST(year AS INTEGER) AS year,
                  make_date(year, 1, 1) + (start - 1) AS start_date, make_date(year, 1, 1) + (start + days - 2) AS end_date
                  FROM (SELECT DISTINCT year(ds) AS year FROM x_orders),
                  (VALUES {_promo_rows()}) f(family, title, start, days, odd_only)
                  WHERE odd_only = 0 OR year % 2 = 1""",
    "x_promo_days": """SELECT DISTINCT CAST(unnest(generate_series(CAST(start_date AS TIMESTAMP),
                  CAST(end_date AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS ds FROM x_promos""",
    "x_horizon": """SELECT CAST(unnest(generate_series(TIMESTAMP '2001-01-01', TIMESTAMP '2002-07-01', INTERVAL 1 DAY))
                  AS DATE) AS ds""",
    "x_full_days": """SELECT CAST(unnest(generate_series((SELECT CAST(min(ds) AS TIMESTAMP) FROM x_orders),
                  TIMESTAMP '2002-07-01', INTERVAL 1 DAY)) AS DATE) AS ds""",
    "x_exog": """SELECT d.ds, t.sessions,
                  CASE WHEN d.ds <= z.top THEN m.overstock_pct END AS overstock_pct,
                  CASE WHEN d.ds <= z.top THEN m.days_of_supply END AS days_of_supply,
                  CASE WHEN d.ds <= z.top THEN m.fill_rate END AS fill_rate
                  FROM x_full_days d ASOF LEFT JOIN x_month m ON d.ds >= m.snap
                  LEFT JOIN x_traffic t ON d.ds = t.ds CROSS JOIN (SELECT max(snap) AS top FROM x_month) z""",
    # same-day-last-year structure: prediction, trend, residual
    "x_naive": """SELECT p.series_id, p.ds, p.revenue, p.cogs, l.revenue AS structural_pred,
                  avg(p.revenue) OVER (PARTITION BY p.series_id ORDER BY p.ds
                      RANGE BETWEEN INTERVAL 729 DAY PRECEDING AND INTERVAL 365 DAY PRECEDING) AS structural_trend,
                  p.revenue - l.revenue AS residual
                  FROM x_panel p LEFT JOIN x_panel l ON l.series_id = p.series_id AND l.ds = p.ds - 365""",
    "x_annual": """SELECT series_id, CAST(year(ds) AS INTEGER) AS year, sum(revenue) AS revenue, sum(cogs) AS cogs,
                  count(*) AS days FROM x_panel GROUP BY 1, 2""",
    "x_growth": """SELECT series_id, exp(avg(ln(gr))) AS revenue_growth, exp(avg(ln(gc))) AS cogs_growth FROM (
                  SELECT series_id, revenue / lag(revenue) OVER (PARTITION BY series_id ORDER BY year) AS gr,
                  cogs / lag(cogs) OVER (PARTITION BY series_id ORDER BY year) AS gc FROM x_annual WHERE days >= 360)
                  GROUP BY 1""",
    "x_profile": """SELECT series_id, CAST(month(ds) AS INTEGER) AS month, CAST(day(ds) AS INTEGER) AS day,
                  avg(rn) AS revenue_profile, avg(cn) AS cogs_profile FROM (
                  SELECT *, revenue / avg(revenue) OVER (PARTITION BY series_id, year(ds)) AS rn,
                  cogs / avg(cogs) OVER (PARTITION BY series_id, year(ds)) AS cn FROM x_panel) GROUP BY 1, 2, 3""",
    # seasonal profile forecast over the horizon, from base year 2000
    "x_fc": """SELECT b.series_id, h.ds,
                  b.revenue / 365 * pow(g.revenue_growth, year(h.ds) - 2000) * coalesce(p.revenue_profile, 1.0) AS revenue,
                  b.cogs / 365 * pow(g.cogs_growth, year(h.ds) - 2000) * coalesce(p.cogs_profile, 1.0) AS cogs
                  FROM x_annual b JOIN x_growth g USING (series_id) CROSS JOIN x_horizon h
                  LEFT JOIN x_profile p ON p.series_id = b.series_id AND p.month = month(h.ds) AND p.day = day(h.ds)
                  WHERE b.year = 2000""",
    # seasonal profile structure over history and horizon, with the residual where revenue is known
    "x_state": """SELECT b.series_id, d.ds, q.revenue,
                  b.revenue / 365 * pow(g.revenue_growth, year(d.ds) - 2000) * coalesce(p.revenue_profile, 1.0) AS structural_pred,
                  q.revenue - b.revenue / 365 * pow(g.revenue_growth, year(d.ds) - 2000) * coalesce(p.revenue_profile, 1.0) AS residual
                  FROM x_annual b JOIN x_growth g USING (series_id) JOIN (SELECT series_id, CAST(unnest(generate_series(
                      CAST(min(ds) AS TIMESTAMP), TIMESTAMP '2002-07-01', INTERVAL 1 DAY)) AS DATE) AS ds FROM x_panel GROUP BY 1) d
                      ON d.series_id = b.series_id
                  LEFT JOIN x_profile p ON p.series_id = b.series_id AND p.month = month(d.ds) AND p.day = day(d.ds)
                  LEFT JOIN x_panel q ON q.series_id = b.series_id AND q.ds = d.ds WHERE b.year = 2000""",
    # validation-year errors of the same-day-last-year forecast
    "x_err": """SELECT series_id, ds, revenue AS y, structural_pred AS pred,
                  revenue - structural_pred AS error, (revenue - structural_pred) / nullif(structural_pred, 0) AS rel_error
                  FROM x_naive WHERE ds BETWEEN DATE '2000-01-01' AND DATE '2000-12-31'""",
    "x_ratio": """SELECT series_id, CAST(year(ds) % 2 AS INTEGER) AS parity, CAST(month(ds) AS INTEGER) AS month,
                  median(least(greatest(cogs / nullif(revenue, 0), 0.5), 1.6)) AS ratio
                  FROM x_panel WHERE ds <= DATE '1999-12-31' AND revenue <> 0 GROUP BY 1, 2, 3""",
    "x_ratio_default": """SELECT series_id, median(least(greatest(cogs / nullif(revenue, 0), 0.5), 1.6)) AS ratio_default
                  FROM x_panel WHERE ds <= DATE '1999-12-31' AND revenue <> 0 GROUP BY 1""",
}
_NAME = re.compile(r"\bx_[a-z_]+\b")


def with_fragments(body: str) -> str:
    """Prefix ``body`` with the fragments it uses, in dependency order."""
    order: list[str] = []

    def visit(text: str) -> None:
        for name in _NAME.findall(text):
            if name in FRAGMENTS and name not in order:
                visit(FRAGMENTS[name])
                if name not in order:
                    order.append(name)

    visit(body)
    if not order:
        return body.strip()
    head = ",\n".join(f"{n} AS MATERIALIZED ({FRAGMENTS[n]})" for n in order)
    body = body.strip()
    if body[:5].upper() == "WITH ":
        return f"WITH {head},\n{body[5:]}"
    return f"WITH {head}\n{body}"
