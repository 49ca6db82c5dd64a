"""The same reports in plain SQL, over the same tables, for checking results.

Written from the definitions, not from the DataFrame code: day indexes come from each product's
first day, ranks from window functions over everything, first rows from tuple ordering.
"""

from __future__ import annotations

import math

PRODUCT_ID = (
    "concat('P', lpad(CAST({k} AS VARCHAR), greatest(9, length(CAST({k} AS VARCHAR)))::INT, '0'))"
)

SALES = f"""
sales AS (
  SELECT CAST(l_shipdate AS DATE) AS date,
         {PRODUCT_ID.format(k='l_partkey')} AS product_id,
         p_name AS product_name, p_type AS category,
         CAST(l_quantity AS BIGINT) // (1 + l_partkey % 4) AS quantity_sold,
         CAST(p_retailprice AS DECIMAL(12,2)) AS unit_price,
         CAST(CAST(p_retailprice AS DECIMAL(12,2)) * (0.50 + 0.05 * CAST(l_partkey % 5 AS DECIMAL(2,0)))
              AS DECIMAL(18,4)) AS unit_cost,
         CAST((CAST(l_quantity AS BIGINT) // (1 + l_partkey % 4)) * CAST(p_retailprice AS DECIMAL(12,2))
              AS DECIMAL(18,2)) AS revenue,
         CAST((CAST(l_quantity AS BIGINT) // (1 + l_partkey % 4)) * CAST(p_retailprice AS DECIMAL(12,2))
              * (0.50 - 0.05 * CAST(l_partkey % 5 AS DECIMAL(2,0))) AS DECIMAL(18,4)) AS profit,
         CASE WHEN month(l_shipdate) BETWEEN 5 AND 10 THEN 'Saison des Pluies' ELSE 'Saison Sèche' END AS season,
         CAST(isodow(l_shipdate) >= 6 AS INT) AS is_weekend,
         CAST(3 + p_size % 13 AS INT) AS shelf_life_days,
         50 + (l_orderkey * 31 + l_linenumber) % 251 AS stock,
         l_orderkey AS ok, l_linenumber AS ln
  FROM lineitem JOIN part ON l_partkey = p_partkey
)"""

DAILY = SALES + """,
daily AS (
  SELECT product_id, date, CAST(sum(quantity_sold) AS BIGINT) AS quantity_sold
  FROM sales GROUP BY product_id, date
)"""

PROFILE = SALES + """,
profile AS (
  SELECT product_id,
         arg_min(product_name, (date, ok, ln)) AS product_name,
         arg_min(category, (date, ok, ln)) AS category,
         arg_min(shelf_life_days, (date, ok, ln)) AS shelf_life_days,
         CAST(arg_min(unit_price, (date, ok, ln)) AS DOUBLE) AS base_price,
         CAST(sum(unit_price) AS DOUBLE) / CAST(count(unit_price) AS DOUBLE) AS mean_price,
         CAST(arg_max(stock, (date, ok, ln)) AS BIGINT) AS current_stock,
         max(date) AS last_date
  FROM sales GROUP BY product_id
)"""

SPLIT = """,
split AS (
  SELECT product_id, date, quantity_sold,
         CAST(row_number() OVER (PARTITION BY product_id
                                 ORDER BY md5(concat(product_id, '|', CAST(date AS VARCHAR))))
              <= (count(*) OVER (PARTITION BY product_id) + 4) // 5 AS INT) AS is_test
  FROM daily
)"""


def _lines(rows: str) -> str:
    """Least-squares line per product over `rows`; x counts days from the product's first day."""
    return f""",
firsts AS (SELECT product_id, min(date) AS first_date, max(date) AS last_date FROM daily GROUP BY product_id),
points AS (
  SELECT r.product_id, first_date, last_date,
         CAST(date_diff('day', first_date, date) AS BIGINT) AS x, quantity_sold AS y
  FROM ({rows}) r JOIN firsts ON r.product_id = firsts.product_id
),
sums AS (
  SELECT product_id, any_value(first_date) AS first_date, any_value(last_date) AS last_date,
         count(*) AS n, sum(x)::BIGINT AS sx, sum(y)::BIGINT AS sy,
         sum(x * y)::BIGINT AS sxy, sum(x * x)::BIGINT AS sxx
  FROM points GROUP BY product_id
),
slopes AS (
  SELECT *, CASE WHEN n * sxx - sx * sx = 0 THEN 0::DOUBLE
                 ELSE CAST(n * sxy - sx * sy AS DOUBLE) / CAST(n * sxx - sx * sx AS DOUBLE) END AS slope
  FROM sums
),
lines AS (
  SELECT *, (CAST(sy AS DOUBLE) - slope * CAST(sx AS DOUBLE)) / CAST(n AS DOUBLE) AS intercept FROM slopes
)"""


def _forecast(days: int, rows: str = "SELECT product_id, date, quantity_sold FROM daily") -> str:
    split = SPLIT if "split" in rows else ""
    daily = DAILY[len(SALES):]
    return PROFILE + daily + split + _lines(rows) + f""",
raw AS (
  SELECT l.product_id, p.product_name, p.shelf_life_days, p.base_price, p.current_stock, h,
         l.last_date + CAST(h AS INT) AS day,
         l.intercept + l.slope * CAST(date_diff('day', l.first_date, l.last_date) + h AS DOUBLE) AS raw_prediction
  FROM lines l JOIN profile p ON l.product_id = p.product_id CROSS JOIN range(1, {days} + 1) t(h)
),
forecast AS (
  SELECT strftime(day, '%Y-%m-%d') AS date, product_id, product_name,
         greatest(0, CAST(round_even(raw_prediction, 0) AS BIGINT)) AS predicted_quantity,
         greatest(0, CAST(round_even(raw_prediction * CASE WHEN shelf_life_days < 7 THEN 0.7::DOUBLE
                                                           ELSE 0.8::DOUBLE END, 0) AS BIGINT))
           AS confidence_interval_lower,
         CAST(round_even(raw_prediction * CASE WHEN shelf_life_days < 7 THEN 1.3::DOUBLE
                                               ELSE 1.2::DOUBLE END, 0) AS BIGINT)
           AS confidence_interval_upper,
         shelf_life_days, base_price, current_stock, raw_prediction
  FROM raw
)"""


FORECAST_COLUMNS = (
    "date, product_id, product_name, predicted_quantity, confidence_interval_lower, "
    "confidence_interval_upper, shelf_life_days"
)

STOCK = _forecast(30) + """,
projection AS (
  SELECT *, CAST(sum(predicted_quantity) OVER (PARTITION BY product_id ORDER BY date) AS BIGINT) AS cumulative_demand
  FROM forecast
),
status AS (
  SELECT product_id, product_name,
         min(CASE WHEN current_stock - cumulative_demand
                       <= CASE WHEN shelf_life_days > 10 THEN 30::DOUBLE ELSE 45::DOUBLE END THEN date END) AS due,
         current_stock,
         CASE WHEN shelf_life_days > 10 THEN 30::DOUBLE ELSE 45::DOUBLE END AS reorder_level,
         shelf_life_days,
         CASE WHEN shelf_life_days < 7 THEN 112 WHEN shelf_life_days <= 10 THEN 90 ELSE 60 END AS quantity
  FROM projection GROUP BY ALL
)"""

PRICES = _forecast(14) + """,
demand AS (
  SELECT product_id, product_name, shelf_life_days, base_price,
         CAST(sum(predicted_quantity) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS demand
  FROM forecast GROUP BY ALL
),
prices AS (
  SELECT product_id, product_name, base_price AS current_price,
         base_price * CASE
           WHEN shelf_life_days <= 5 THEN CASE WHEN demand < 10 THEN 0.8::DOUBLE ELSE 1::DOUBLE END
           WHEN shelf_life_days <= 10 THEN CASE WHEN demand < 15 THEN 0.9::DOUBLE ELSE 1::DOUBLE END
           WHEN demand > 25 THEN 1.1::DOUBLE ELSE 1::DOUBLE END AS suggested_price,
         demand AS avg_forecasted_demand, shelf_life_days
  FROM demand
),
changes AS (
  SELECT product_id, current_price, suggested_price, suggested_price - current_price AS price_diff,
         (suggested_price - current_price) / current_price * 100 AS price_change_pct
  FROM prices
)"""

PAIRS = DAILY + SPLIT + _lines(
    "SELECT product_id, date, quantity_sold FROM split WHERE is_test = 0"
) + """,
pairs AS (
  SELECT s.product_id, CAST(quantity_sold AS DOUBLE) AS actual,
         intercept + slope * CAST(date_diff('day', first_date, date) AS DOUBLE) AS predicted
  FROM split s LEFT JOIN lines l ON s.product_id = l.product_id WHERE is_test = 1
)"""


def _metrics(by: str) -> str:
    return f"""
  SELECT {by} count(predicted) AS n,
         round(avg(abs(actual - predicted)), 6) AS mae,
         round(avg((actual - predicted) * (actual - predicted)), 6) AS mse,
         round(sqrt(avg((actual - predicted) * (actual - predicted))), 6) AS rmse,
         round(CASE WHEN count(predicted) < 2 THEN NULL
                    WHEN min(actual) = max(actual)
                    THEN CASE WHEN avg((actual - predicted) * (actual - predicted)) = 0 THEN 1::DOUBLE
                              ELSE 0::DOUBLE END
                    ELSE 1 - avg((actual - predicted) * (actual - predicted)) / var_pop(actual) END, 6) AS r2,
         round(avg(abs((actual - predicted) / nullif(actual, 0))) * 100, 6) AS mape,
         count(*) FILTER (actual = 0 AND predicted IS NOT NULL) AS n_zero_actual
  FROM pairs"""


def _codes(tables: str) -> str:
    return f"""
codes AS (
  SELECT column_name, value,
         CAST(dense_rank() OVER (PARTITION BY column_name ORDER BY value) - 1 AS BIGINT) AS code
  FROM (SELECT DISTINCT 'product_id' AS column_name, product_id AS value FROM {tables}
        UNION ALL SELECT DISTINCT 'product_name', product_name FROM {tables}
        UNION ALL SELECT DISTINCT 'category', category FROM {tables})
)"""


def _calendar(day: str) -> str:
    return f"""
         CAST(month({day}) AS INT) AS month, CAST(day({day}) AS INT) AS day,
         CAST(isodow({day}) - 1 AS INT) AS day_of_week, CAST(quarter({day}) AS INT) AS quarter,
         CAST(dayofyear({day}) AS INT) AS day_of_year,
         CAST(isodow({day}) >= 6 AS INT) AS is_weekend,
         {_flags(day)}"""


def _flags(day: str) -> str:
    return f"""CAST(month({day}) IN (6, 7, 8) AS INT) AS is_summer,
         CAST(month({day}) IN (12, 1, 2) AS INT) AS is_winter,
         CAST(month({day}) IN (3, 4, 5) AS INT) AS is_spring,
         CAST(month({day}) IN (9, 10, 11) AS INT) AS is_fall"""


CANONICAL = """
  SELECT date, product_id, product_name, category, quantity_sold, CAST(unit_price AS DOUBLE) AS unit_price,
         CAST(revenue AS DOUBLE) AS revenue, CAST(profit AS DOUBLE) AS profit, season, is_weekend, shelf_life_days
  FROM sales"""

OVERVIEW = SALES + """,
figures AS (
  SELECT (SELECT CAST(sum(revenue) AS DOUBLE) FROM sales) AS total_revenue,
         (SELECT CAST(sum(profit) AS DOUBLE) FROM sales) AS total_profit,
         (SELECT CAST(sum(q) AS DOUBLE) / count(*) FROM (SELECT sum(quantity_sold) AS q FROM sales GROUP BY date))
           AS avg_daily_sales,
         (SELECT category FROM sales GROUP BY category ORDER BY count(*) DESC, category LIMIT 1) AS top_category,
         (SELECT CAST(sum(revenue) AS DOUBLE) / count(revenue) FROM sales) AS avg_order_value,
         (SELECT round(avg(CAST(profit AS DOUBLE) / nullif(CAST(revenue AS DOUBLE), 0) * 100), 6) FROM sales)
           AS avg_profit_margin,
         (SELECT season FROM sales GROUP BY season ORDER BY sum(revenue) DESC, season LIMIT 1) AS peak_season,
         (SELECT count(DISTINCT product_id) FROM sales) AS total_products
)"""

KPI_PRODUCTS = SALES + """,
product_kpis AS (
  SELECT product_name,
         CAST(sum(quantity_sold) AS DOUBLE) / count(quantity_sold) AS avg_historical_sales,
         CAST(sum(revenue) AS DOUBLE) AS total_historical_revenue,
         arg_min(shelf_life_days, (product_id, date, ok, ln)) AS shelf_life_days,
         CAST(sum(unit_price) AS DOUBLE) / count(unit_price) AS avg_price
  FROM sales GROUP BY product_name
)"""

SUMMARY = _forecast(30) + """,
summary AS (
  SELECT product_id, CAST(sum(predicted_quantity) AS BIGINT) AS total_predicted,
         CAST(sum(predicted_quantity) AS DOUBLE) / count(*) AS avg_per_day,
         CAST(sum(confidence_interval_upper - confidence_interval_lower) AS DOUBLE) / count(*) / 2 AS avg_confidence
  FROM forecast GROUP BY product_id
)"""


FOREST_FEATURES = (
    "product_id_encoded", "product_name_encoded", "category_encoded", "unit_price", "month", "day", "day_of_week", "quarter",
    "day_of_year", "is_weekend", "is_summer", "is_winter", "is_spring", "is_fall", "shelf_life_days", "product_mean_quantity")


def _features(day: str) -> str:
    return f"""[CAST(f AS DOUBLE) for f in [pid, pname, pcat, unit_price, month({day}), day({day}), isodow({day}) - 1, quarter({day}),
      dayofyear({day}), CAST(isodow({day}) >= 6 AS INT), CAST(month({day}) IN (6, 7, 8) AS INT), CAST(month({day}) IN (12, 1, 2) AS INT),
      CAST(month({day}) IN (3, 4, 5) AS INT), CAST(month({day}) IN (9, 10, 11) AS INT), shelf_life_days, level]]"""


def _forest(trees: int = 100, depth: int = 10, bins: int = 64) -> str:
    """The same forest grown in SQL, a level at a time over rows in long form."""
    p, steps, total = math.exp(-1), [], 0.0
    for k in range(1, 14):
        total, p = total + p, p / k
        steps.append(int(total * 2**32))
    n_drawn = " + ".join(f"CAST(u >= {x} AS INT)" for x in steps if x < 2**32 - 1)
    wide = ", ".join(f"b{f}" for f in range(len(FOREST_FEATURES)))
    levels = []
    for d in range(depth + 1):
        levels.append(f"""
    total_{d} AS MATERIALIZED (SELECT t, node, sum(w) AS n, sum(wy) AS s FROM at_{d} GROUP BY 1, 2)""")
        if d == depth:
            break
        sums = " UNION ALL ".join(
            f"SELECT t, node, {f} AS f, b{f} AS b, sum(w) AS n, sum(wy) AS s FROM at_{d} GROUP BY ALL" for f in range(len(FOREST_FEATURES)))
        picked = "CASE f " + " ".join(f"WHEN {f} THEN b{f}" for f in range(len(FOREST_FEATURES))) + " END"
        levels.append(f"""
    left_{d} AS (
      SELECT t, node, f, b, sum(n) OVER side AS nl, sum(s) OVER side AS sl
      FROM ({sums}) WINDOW side AS (PARTITION BY t, node, f ORDER BY b)),
    gain_{d} AS (
      SELECT t, node, f, b, sl * sl / nl + (s - sl) * (s - sl) / (n - nl) AS gain, s * s / n AS whole
      FROM left_{d} JOIN total_{d} USING (t, node) WHERE nl >= 2 AND n - nl >= 2 AND n >= 5),
    split_{d} AS MATERIALIZED (
      SELECT t, node, best.f AS f, best.b AS b FROM (
        SELECT t, node, min({{'g': -gain, 'f': f, 'b': b}}) AS best FROM gain_{d} WHERE gain > whole + 1e-12 * abs(whole) GROUP BY 1, 2)),
    at_{d + 1} AS MATERIALIZED (
      SELECT t, CAST(2 * node + CAST({picked} > b AS INT) AS INT) AS node, w, wy, {wide} FROM at_{d} JOIN split_{d} USING (t, node))""")
    nodes = " UNION ALL ".join(
        f"SELECT t, node, f, b, n, s FROM total_{d} LEFT JOIN split_{d} USING (t, node)" if d < depth
        else f"SELECT t, node, NULL, NULL, n, s FROM total_{d}" for d in range(depth + 1))
    return DAILY + SPLIT + f""",
    parts AS (
      SELECT {PRODUCT_ID.format(k='p_partkey')} AS product_id, p_name AS product_name, p_type AS category,
        CAST(3 + p_size % 13 AS INT) AS shelf_life_days, CAST(CAST(p_retailprice AS DECIMAL(12,2)) AS DOUBLE) AS unit_price,
      FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem)),
    {_codes('parts')},
    levels AS (SELECT product_id, CAST(sum(quantity_sold) AS DOUBLE) / count(*) AS level FROM split WHERE is_test = 0 GROUP BY 1),
    known AS (
      SELECT product_id, parts.product_name, shelf_life_days, unit_price, a.code AS pid, b.code AS pname, c.code AS pcat,
        coalesce(level, (SELECT avg(level) FROM levels)) AS level
      FROM parts LEFT JOIN levels USING (product_id)
      JOIN codes a ON a.column_name = 'product_id' AND a.value = product_id
      JOIN codes b ON b.column_name = 'product_name' AND b.value = parts.product_name
      JOIN codes c ON c.column_name = 'category' AND c.value = parts.category),
    train AS MATERIALIZED (
      SELECT CAST(row_number() OVER () AS INT) AS rid, quantity_sold AS y, {_features('date')} AS x,
        CAST('0x' || substr(md5(concat('draw|', product_id, '|', CAST(date AS VARCHAR))), 1, 15) AS BIGINT) AS seed
      FROM split JOIN known USING (product_id) WHERE is_test = 0),
    spots AS (
      SELECT f, v, row_number() OVER (PARTITION BY f ORDER BY v) AS rn, count(*) OVER (PARTITION BY f) AS m
      FROM (SELECT DISTINCT f, x[f + 1] AS v FROM (SELECT x FROM train ORDER BY seed, x LIMIT 20000), range({len(FOREST_FEATURES)}) r(f))),
    edges AS MATERIALIZED (
      SELECT f, coalesce(list(v ORDER BY v) FILTER (
        list_contains([i * m // least(m, {bins}) for i in range(1, least(m, {bins}))], rn)), []) AS e FROM spots GROUP BY f),
    binned AS MATERIALIZED (
      SELECT rid, """ + ", ".join(f"any_value(b) FILTER (f = {f}) AS b{f}" for f in range(len(FOREST_FEATURES))) + f"""
      FROM (SELECT rid, f, CAST(len(list_filter(e, lambda z: z < x[f + 1])) AS TINYINT) AS b FROM train CROSS JOIN edges) GROUP BY rid),
    factors AS (
      SELECT CAST(t AS INT) AS t, 2 * CAST(CAST('0x' || substr(md5('42:' || t), 1, 15) AS BIGINT) AS HUGEINT) + 1 AS factor FROM range({trees}) r(t)),
    at_0 AS MATERIALIZED (
      SELECT t, 1 AS node, CAST(w AS DOUBLE) AS w, CAST(w * y AS DOUBLE) AS wy, {wide} FROM (
        SELECT t, rid, y, {n_drawn} AS w FROM (
          SELECT t, rid, y, CAST(CAST(seed AS HUGEINT) * factor % 18446744073709551616 // 4294967296 AS BIGINT) AS u FROM train CROSS JOIN factors)) JOIN binned USING (rid)
      WHERE w > 0),{",".join(levels)},
    trees AS MATERIALIZED (
      SELECT t AS tree, node, f, e[b + 1] AS threshold, CAST(n AS BIGINT) AS n, s / n AS value
      FROM ({nodes}) LEFT JOIN edges USING (f))"""


def _walked(rows: str, depth: int = 10) -> str:
    """The trees' mean for rows (k, x), walked step by step."""
    return f""",
    step_0 AS (SELECT k, x, tree, 1 AS node FROM ({rows}) CROSS JOIN (SELECT DISTINCT tree FROM trees)),""" + ",".join(f"""
    step_{d + 1} AS (
      SELECT k, x, tree, CASE WHEN f IS NULL THEN node WHEN x[f + 1] > threshold THEN 2 * node + 1 ELSE 2 * node END AS node
      FROM step_{d} JOIN trees USING (tree, node))""" for d in range(depth)) + f""",
    guessed AS (SELECT k, avg(value) AS p FROM step_{depth} JOIN trees USING (tree, node) GROUP BY k)"""


def _linear(m: int = 12) -> str:
    """Minimum-norm least squares per product over its training days, by two eliminations of lists."""
    def each(n: int, expr: str) -> str:
        return f"[{expr} for j in range({n})]"

    def added(first: str, expr: str) -> str:
        return f"list_reduce(list_concat([{first}], [{expr} for i in range({m})]), lambda a, b: a + b)"

    pairs = ", ".join(f"sum(x[{min(i, j)}] * x[{max(i, j)}])" for i in range(1, m + 1) for j in range(1, m + 1))
    out = f"""
    sold AS (
      SELECT {PRODUCT_ID.format(k='p_partkey')} AS product_id, p_name AS product_name, CAST(3 + p_size % 13 AS INT) AS shelf_life_days,
        CAST(CAST(p_retailprice AS DECIMAL(12,2)) AS DOUBLE) AS unit_price FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem)),
    points AS (
      SELECT *, {_product_features('date')} AS x
      FROM (SELECT *, max(1 - is_test) OVER (PARTITION BY product_id) AS any_used FROM split) JOIN sold USING (product_id)),
    bases AS (SELECT product_id, min(unit_price) AS base FROM points GROUP BY 1),
    shifted AS (
      SELECT product_id, base, is_test, CAST(quantity_sold AS DOUBLE) AS y, list_concat([x[1] - base], x[2:{m}]) AS x
      FROM points JOIN bases USING (product_id) WHERE is_test = 0 OR any_used = 0),
    raw AS (
      SELECT product_id, base, count(*) FILTER (is_test = 0) AS n_days, CAST(count(*) AS DOUBLE) AS n, sum(y) AS sy, [{", ".join(f"sum(x[{i}])" for i in range(1, m + 1))}] AS sx,
        [{", ".join(f"sum(x[{i}] * y)" for i in range(1, m + 1))}] AS sxy, [{pairs}] AS sxx FROM shifted GROUP BY 1, 2),
    centred AS (
      SELECT *, {each(m * m, f"n * sxx[j + 1] - sx[j // {m} + 1] * sx[j % {m} + 1]")} AS g, {each(m, "n * sxy[j + 1] - sx[j + 1] * sy")} AS b FROM raw),
    e0 AS (
      SELECT *, {each(m, f"CASE WHEN g[{m + 1} * j + 1] > 1e-20::DOUBLE * list_max({each(m, f'g[{m + 1} * j + 1]').replace(' j ', ' k ')}) THEN 1e-9::DOUBLE * g[{m + 1} * j + 1] ELSE 'Infinity'::DOUBLE END")} AS least
      FROM centred)"""
    kept = "product_id, base, n_days, n, sy, sx, least"
    for k in range(m):
        before = "".join(f", l{i}, u{i}" for i in range(k))
        out += f""",
    d{k} AS (SELECT *, {each(m, f"CASE WHEN g[{m + 1} * j + 1] > least[j + 1] THEN g[{m + 1} * j + 1] ELSE 0::DOUBLE END")} AS d FROM e{k}),
    p{k} AS (SELECT *, CAST(list_position(d, list_max(d)) - 1 AS INT) AS p, list_max(d) AS top FROM d{k}),
    c{k} AS (
      SELECT *, {each(m, f"CASE WHEN top > 0 THEN g[{m} * p + j + 1] / sqrt(top) ELSE 0::DOUBLE END")} AS l{k},
        CASE WHEN top > 0 THEN b[p + 1] / sqrt(top) ELSE 0::DOUBLE END AS u{k} FROM p{k}),
    e{k + 1} AS MATERIALIZED (
      SELECT {kept}{before}, l{k}, u{k}, {each(m * m, f"CASE WHEN j // {m} = p OR j % {m} = p THEN 0::DOUBLE ELSE g[j + 1] - l{k}[j // {m} + 1] * l{k}[j % {m} + 1] END")} AS g,
        {each(m, f"b[j + 1] - l{k}[j + 1] * u{k}")} AS b FROM c{k})"""
    unused = f"CASE WHEN j // {m} = j % {m} AND list_max(l[j % {m} + 1]) = 0 AND list_min(l[j % {m} + 1]) = 0 THEN 1::DOUBLE ELSE 0::DOUBLE END"
    out += f""",
    small AS (SELECT {kept}, [{", ".join(f"l{k}" for k in range(m))}] AS l, [{", ".join(f"u{k}" for k in range(m))}] AS u FROM e{m}),
    s0 AS (SELECT *, {each(m * m, added(unused, f"l[j // {m} + 1][i + 1] * l[j % {m} + 1][i + 1]"))} AS q FROM small)"""
    for k in range(m):
        out += f""",
    f{k} AS (SELECT *, {each(m, f"CASE WHEN j = {k} THEN 0::DOUBLE ELSE q[{m} * j + {k} + 1] / q[{(m + 1) * k + 1}] END")} AS f FROM s{k}),
    s{k + 1} AS MATERIALIZED (
      SELECT {kept}, l, {each(m * m, f"q[j + 1] - f[j // {m} + 1] * q[{m * k} + j % {m} + 1]")} AS q, {each(m, f"u[j + 1] - f[j + 1] * u[{k + 1}]")} AS u FROM f{k})"""
    return DAILY + SPLIT + "," + out + f""",
    ends AS (SELECT *, {each(m, f"u[j + 1] / q[{m + 1} * j + 1]")} AS v FROM s{m}),
    solved AS (SELECT *, {each(m, added("0::DOUBLE", "l[i + 1][j + 1] * v[i + 1]"))} AS coefficients FROM ends),
    fitted AS MATERIALIZED (
      SELECT product_id, n_days, coefficients,
        (sy - {added("0::DOUBLE", "coefficients[i + 1] * sx[i + 1]")}) / n - coefficients[1] * base AS intercept FROM solved)"""


def _product_features(day: str) -> str:
    return f"""[CAST(f AS DOUBLE) for f in [unit_price, month({day}), day({day}), isodow({day}) - 1, quarter({day}),
      dayofyear({day}), CAST(isodow({day}) >= 6 AS INT), CAST(month({day}) IN (6, 7, 8) AS INT), CAST(month({day}) IN (12, 1, 2) AS INT),
      CAST(month({day}) IN (3, 4, 5) AS INT), CAST(month({day}) IN (9, 10, 11) AS INT), shelf_life_days]]"""


LINE = "list_reduce(list_concat([intercept], [coefficients[i + 1] * x[i + 1] for i in range(12)]), lambda a, b: a + b)"


def statements() -> dict[str, str]:
    w = "WITH "
    forecast_rows = w + _forecast(30) + f" SELECT {FORECAST_COLUMNS} FROM forecast"
    fixed = "format('{{:.{d}f}}', {x})"

    def money(x: str) -> str:
        return f"concat('XOF', {fixed.format(d=2, x=x)})"

    def signed(x: str, text: str) -> str:
        return f"concat(CASE WHEN {x} >= 0 THEN '+' ELSE '' END, {text})"

    profile = SALES + """
          SELECT 'sales' AS table_name, count(*) AS total_records,
                 concat(strftime(min(date), '%Y-%m-%d'), ' au ', strftime(max(date), '%Y-%m-%d')) AS date_range,
                 count(DISTINCT product_id) AS unique_products, count(DISTINCT category) AS unique_categories
          FROM sales
          UNION ALL
          SELECT 'inventory', count(*),
                 concat(strftime(min(date), '%Y-%m-%d'), ' au ', strftime(max(date), '%Y-%m-%d')),
                 count(DISTINCT product_id), NULL
          FROM sales
          UNION ALL SELECT 'customer', count(*), NULL, NULL, NULL FROM customer"""

    return {
        "scan_sales": w + SALES + CANONICAL,
        "scan_inventory": w + SALES + """
          SELECT date, product_id, CAST(stock AS BIGINT) AS current_stock, CAST(30 AS BIGINT) AS reorder_level,
                 shelf_life_days FROM sales""",
        "scan_customer": "SELECT * FROM customer",
        "canonical_sales": w + SALES + CANONICAL,
        "contract_defaults": w + SALES + """
          SELECT date, product_id, season, is_weekend, CAST(7 AS INT) AS shelf_life_days,
                 CAST(100 AS BIGINT) AS current_stock FROM sales""",
        **dict.fromkeys(("csv_roundtrip", "snapshot_roundtrip"), w + SALES + f"""
          SELECT *, 'sales' AS table_name, CAST(NULL AS BIGINT) AS current_stock, CAST(NULL AS BIGINT) AS reorder_level
          FROM ({CANONICAL})
          UNION ALL BY NAME
          SELECT date, product_id, shelf_life_days, 'inventory' AS table_name, CAST(stock AS BIGINT) AS current_stock,
                 CAST(30 AS BIGINT) AS reorder_level FROM sales"""),
        "rejected_rows": w + SALES + """,
          broken AS (
            SELECT stock % 31 = 0 AS no_date, product_id, CAST(substr(product_id, 2) AS BIGINT) % 23 = 0 AS no_id, stock % 29 = 1 AS no_number,
                   stock % 29 = 2 AS below, CAST(substr(product_id, 2) AS BIGINT) % 19 = 3 AS too_large FROM sales),
          bad AS (SELECT *, no_date OR no_id OR no_number OR below OR too_large AS is_bad FROM broken),
          lines AS (
            SELECT 'date' AS "column", 'not a date' AS reason, count(*) FILTER (no_date) AS n FROM bad
            UNION ALL SELECT 'product_id', 'missing', count(*) FILTER (no_id) FROM bad
            UNION ALL SELECT 'quantity_sold', 'not a number', count(*) FILTER (no_number) FROM bad
            UNION ALL SELECT 'quantity_sold', 'negative', count(*) FILTER (below) FROM bad
            UNION ALL SELECT 'unit_price', 'out of range', count(*) FILTER (too_large) FROM bad)
          SELECT * FROM lines WHERE n > 0
          UNION ALL SELECT 'row', 'n_read', count(*) FROM bad UNION ALL SELECT 'row', 'n_rejected', count(*) FILTER (is_bad) FROM bad
          UNION ALL SELECT 'row', 'n_accepted', count(*) FILTER (NOT is_bad) FROM bad
          UNION ALL SELECT 'row', 'in contract form', count(*) FILTER (NOT is_bad) FROM bad""",
        "filter_date_range": w + SALES + """
          SELECT date, product_id, category, quantity_sold FROM sales
          WHERE date BETWEEN DATE '1996-01-01' AND DATE '1998-12-31'""",
        "filter_product_name": w + SALES + """
          SELECT date, product_id, product_name, quantity_sold FROM sales WHERE product_name = 'red widget'""",
        "filter_product_id": w + SALES + """
          SELECT date, product_id, product_name, quantity_sold FROM sales WHERE product_id = 'P000000042'""",
        "project_price_quantity": w + SALES + """
          SELECT CAST(unit_price AS DOUBLE) AS unit_price, quantity_sold, category, product_name FROM sales""",
        "kpi_totals": w + OVERVIEW + """
          SELECT total_revenue, total_profit, avg_order_value, total_products FROM figures""",
        "kpi_avg_daily_sales": w + OVERVIEW + " SELECT avg_daily_sales FROM figures",
        "kpi_top_category": w + OVERVIEW + " SELECT top_category FROM figures",
        "kpi_avg_margin": w + OVERVIEW + " SELECT avg_profit_margin FROM figures",
        "kpi_peak_season": w + OVERVIEW + " SELECT peak_season FROM figures",
        "kpi_overview": w + OVERVIEW + " SELECT * FROM figures",
        "kpi_labels": w + OVERVIEW + """
          SELECT 'total_revenue' AS kpi, concat('XOF', format('{:,.2f}', total_revenue)) AS label FROM figures
          UNION ALL SELECT 'total_profit', concat('XOF', format('{:,.2f}', total_profit)) FROM figures
          UNION ALL SELECT 'avg_daily_sales', format('{:.1f}', avg_daily_sales) FROM figures
          UNION ALL SELECT 'top_category', top_category FROM figures
          UNION ALL SELECT 'avg_order_value', concat('XOF', format('{:.2f}', avg_order_value)) FROM figures
          UNION ALL SELECT 'total_products', CAST(total_products AS VARCHAR) FROM figures
          UNION ALL SELECT 'avg_profit_margin', concat(format('{:.1f}', avg_profit_margin), '%') FROM figures
          UNION ALL SELECT 'peak_season', peak_season FROM figures""",
        "daily_revenue": w + SALES + """
          SELECT date, CAST(sum(revenue) AS DOUBLE) AS revenue FROM sales GROUP BY date""",
        "category_revenue_share": w + SALES + """
          SELECT category, CAST(sum(revenue) AS DOUBLE) AS revenue,
                 round(CAST(sum(revenue) AS DOUBLE) / CAST((SELECT sum(revenue) FROM sales) AS DOUBLE) * 100, 6)
                   AS share_pct
          FROM sales GROUP BY category""",
        "top_products": w + SALES + """
          SELECT product_name, CAST(sum(revenue) AS DOUBLE) AS revenue FROM sales
          GROUP BY product_name ORDER BY sum(revenue) DESC, product_name LIMIT 10""",
        "data_profile": w + profile,
        "data_profile_labels": f"""
          SELECT table_name, format('{{:,}}', total_records) AS total_records,
                 coalesce(date_range, 'N/A') AS date_range,
                 coalesce(CAST(unique_products AS VARCHAR), 'N/A') AS unique_products,
                 coalesce(CAST(unique_categories AS VARCHAR), 'N/A') AS unique_categories
          FROM (WITH {profile})""",
        "category_metrics": w + SALES + """
          SELECT category, CAST(sum(quantity_sold) AS BIGINT) AS quantity_sold,
                 CAST(sum(revenue) AS DOUBLE) AS revenue, CAST(sum(profit) AS DOUBLE) AS profit
          FROM sales GROUP BY category""",
        "category_metrics_in_range": w + SALES + """
          SELECT category, CAST(sum(quantity_sold) AS BIGINT) AS quantity_sold,
                 CAST(sum(revenue) AS DOUBLE) AS revenue, CAST(sum(profit) AS DOUBLE) AS profit
          FROM sales WHERE date BETWEEN DATE '1996-01-01' AND DATE '1998-12-31' GROUP BY category""",
        "season_metrics": w + SALES + """
          SELECT season, CAST(sum(quantity_sold) AS BIGINT) AS quantity_sold,
                 CAST(sum(revenue) AS DOUBLE) AS revenue
          FROM sales GROUP BY season""",
        "product_kpis": w + KPI_PRODUCTS + " SELECT * FROM product_kpis",
        "product_kpi_labels": w + KPI_PRODUCTS + f"""
          SELECT product_name, format('{{:.1f}}', avg_historical_sales) AS avg_historical_sales,
                 concat('XOF', format('{{:,.2f}}', total_historical_revenue)) AS total_historical_revenue,
                 concat(CAST(shelf_life_days AS VARCHAR), ' jours') AS shelf_life_days,
                 {money('avg_price')} AS avg_price
          FROM product_kpis""",
        "product_list": w + SALES + " SELECT DISTINCT product_name FROM sales",
        "product_lookup": w + SALES + """
          SELECT product_name, min(product_id) AS product_id FROM sales GROUP BY product_name""",
        "product_first_attrs": w + PROFILE + """
          SELECT product_id, product_name, category, shelf_life_days, base_price FROM profile""",
        "stock_latest": w + PROFILE + f"""
          SELECT ids.product_id, coalesce(current_stock, 100) AS current_stock
          FROM (SELECT {PRODUCT_ID.format(k='p_partkey')} AS product_id FROM part) ids
          LEFT JOIN profile ON ids.product_id = profile.product_id""",
        "calendar_spine": w + DAILY + f"""
          , spine AS (
            SELECT {PRODUCT_ID.format(k='p_partkey')} AS product_id, CAST(d AS DATE) AS date
            FROM part, (SELECT unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS d FROM daily))
          SELECT product_id, CAST(date_trunc('month', s.date) AS DATE) AS month,
                 CASE WHEN month(s.date) BETWEEN 5 AND 10 THEN 'Saison des Pluies' ELSE 'Saison Sèche' END AS season,
                 count(*) AS n_days, CAST(sum(CAST(isodow(s.date) >= 6 AS INT)) AS BIGINT) AS n_weekend_days,
                 count(quantity_sold) AS n_sale_days, CAST(coalesce(sum(quantity_sold), 0) AS BIGINT) AS quantity_sold
          FROM spine s LEFT JOIN daily USING (product_id, date) GROUP BY ALL""",
        "approx_products": w + SALES + """
          SELECT category, CAST(date_trunc('month', date) AS DATE) AS month, count(DISTINCT product_id) AS n_products,
                 TRUE AS within_bound FROM sales GROUP BY 1, 2""",
        "climate_season": w + SALES + """
          SELECT date, season, is_weekend, count(*) AS n_rows, CAST(sum(quantity_sold) AS BIGINT) AS quantity_sold
          FROM sales GROUP BY ALL""",
        "sale_measures": w + SALES + """
          SELECT product_id, date, quantity_sold, CAST(unit_price AS DOUBLE) AS unit_price,
                 CAST(unit_cost AS DOUBLE) AS unit_cost, CAST(revenue AS DOUBLE) AS revenue,
                 CAST(revenue - profit AS DOUBLE) AS cost, CAST(profit AS DOUBLE) AS profit
          FROM sales""",
        "season_adjusted_demand": w + DAILY + """
          , factors AS (
            SELECT *, CASE WHEN month(date) BETWEEN 5 AND 10 THEN 1.3::DOUBLE ELSE 1::DOUBLE END
                      * CASE WHEN isodow(date) >= 6 THEN 1.25::DOUBLE ELSE 1::DOUBLE END AS demand_factor
            FROM daily)
          SELECT *, CAST(quantity_sold AS DOUBLE) / demand_factor AS adjusted_quantity FROM factors""",
        "product_daily": w + DAILY + " SELECT * FROM daily",
        "date_features": w + SALES + f"""
          SELECT date, product_id, CAST(unit_price AS DOUBLE) AS unit_price,
                 CAST(year(date) AS INT) AS year, {_calendar('date')}, shelf_life_days, quantity_sold
          FROM sales""",
        "label_encode": w + SALES + "," + _codes("sales") + " SELECT * FROM codes",
        "feature_matrix": w + DAILY + f"""
          , parts AS (SELECT {PRODUCT_ID.format(k='p_partkey')} AS product_id, p_name AS product_name,
                             p_type AS category, CAST(3 + p_size % 13 AS INT) AS shelf_life_days,
                             CAST(CAST(p_retailprice AS DECIMAL(12,2)) AS DOUBLE) AS unit_price FROM part),
          {_codes('parts')}
          SELECT CAST(a.code AS DOUBLE) AS product_id_encoded, CAST(b.code AS DOUBLE) AS product_name_encoded,
                 CAST(c.code AS DOUBLE) AS category_encoded, unit_price, {_calendar('date')},
                 shelf_life_days, quantity_sold
          FROM daily JOIN parts USING (product_id)
          JOIN codes a ON a.column_name = 'product_id' AND a.value = product_id
          JOIN codes b ON b.column_name = 'product_name' AND b.value = product_name
          JOIN codes c ON c.column_name = 'category' AND c.value = category""",
        "train_test_split": w + DAILY + SPLIT + " SELECT * FROM split",
        "future_frame": w + PROFILE + f"""
          SELECT strftime(last_date + CAST(h AS INT), '%Y-%m-%d') AS date, product_id, product_name, category,
                 mean_price AS unit_price,
                 CAST(isodow(last_date + CAST(h AS INT)) >= 6 AS INT) AS is_weekend,
                 {_flags('(last_date + CAST(h AS INT))')}, shelf_life_days
          FROM profile CROSS JOIN range(1, 31) t(h)""",
        "forecast_trend": forecast_rows,
        "forecast_trend_train_part": w + _forecast(
            30, "SELECT product_id, date, quantity_sold FROM split WHERE is_test = 0"
        ) + f" SELECT {FORECAST_COLUMNS} FROM forecast",
        "trend_coefficients": w + DAILY + _lines("SELECT product_id, date, quantity_sold FROM daily") + """
          SELECT product_id, n AS n_days, first_date, last_date, intercept, slope FROM lines""",
        "forecast_intervals": w + _forecast(7) + f" SELECT {FORECAST_COLUMNS}, raw_prediction FROM forecast",
        "forecast_summary": w + SUMMARY + " SELECT * FROM summary",
        "forecast_summary_labels": w + SUMMARY + """
          SELECT product_id, format('{:,}', total_predicted) AS total_predicted,
                 format('{:.1f}', avg_per_day) AS avg_per_day,
                 concat('±', format('{:.1f}', avg_confidence)) AS avg_confidence FROM summary""",
        "history_plus_forecast": w + _forecast(30) + """
          SELECT product_id, strftime(date, '%Y-%m-%d') AS date, 'Ventes Historiques' AS series,
                 quantity_sold AS quantity, NULL::BIGINT AS lower, NULL::BIGINT AS upper FROM sales
          UNION ALL
          SELECT product_id, date, 'Prévision', predicted_quantity, confidence_interval_lower,
                 confidence_interval_upper FROM forecast""",
        "eval_holdout": w + PAIRS + f"""
          SELECT product_id, n, mae, mse, r2 FROM ({_metrics('product_id,')} GROUP BY product_id)""",
        "linear_certificate": w + DAILY + """
          SELECT product_id, count(*) AS n_days, TRUE AS is_least_squares, CAST(30 AS BIGINT) AS n_forecast_days
          FROM daily GROUP BY product_id""",
        "forest_trees": w + _forest() + f"""
          SELECT tree, node, {list(FOREST_FEATURES)}[f + 1] AS feature, threshold, n, value FROM trees""",
        "forecast_rf": w + _forest() + """,
          asked AS (
            SELECT row_number() OVER () AS k, product_id, known.product_name, shelf_life_days, day, """ + _features("day") + """ AS x
            FROM (SELECT product_id, max(date) AS last_date FROM daily GROUP BY 1) JOIN known USING (product_id),
              LATERAL (SELECT last_date + CAST(h AS INT) AS day FROM range(1, 31) r(h)))""" + _walked("SELECT k, x FROM asked") + """
          SELECT strftime(day, '%Y-%m-%d') AS date, product_id, product_name, greatest(0, CAST(round_even(p, 0) AS BIGINT)) AS predicted_quantity,
            greatest(0, CAST(round_even(p * CASE WHEN shelf_life_days < 7 THEN 0.7::DOUBLE ELSE 0.8::DOUBLE END, 0) AS BIGINT)) AS confidence_interval_lower,
            CAST(round_even(p * CASE WHEN shelf_life_days < 7 THEN 1.3::DOUBLE ELSE 1.2::DOUBLE END, 0) AS BIGINT) AS confidence_interval_upper,
            shelf_life_days
          FROM asked JOIN guessed USING (k)""",
        "eval_rf": w + _forest() + """,
          asked AS (SELECT row_number() OVER () AS k, quantity_sold, """ + _features("date") + """ AS x
            FROM split JOIN known USING (product_id) WHERE is_test = 1)""" + _walked("SELECT k, x FROM asked") + """,
          pairs AS (SELECT CAST(quantity_sold AS DOUBLE) AS actual, p AS predicted FROM asked JOIN guessed USING (k))""" + _metrics(""),
        "forest_save_load": w + _forest() + """,
          asked AS (
            SELECT row_number() OVER () AS k, NULL AS quantity_sold, """ + _features("day") + """ AS x
            FROM (SELECT product_id, max(date) AS last_date FROM daily GROUP BY 1) JOIN known USING (product_id),
              LATERAL (SELECT last_date + CAST(h AS INT) AS day FROM range(1, 31) r(h))
            UNION ALL
            SELECT -row_number() OVER (), quantity_sold, """ + _features("date") + """
            FROM split JOIN known USING (product_id) WHERE is_test = 1)""" + _walked("SELECT k, x FROM asked") + """,
          pairs AS (SELECT CAST(quantity_sold AS DOUBLE) AS actual, p AS predicted FROM asked JOIN guessed USING (k) WHERE k < 0)
          SELECT * FROM (""" + _metrics("") + """) CROSS JOIN (
            SELECT count(*) AS n_forecast, CAST(sum(greatest(0, CAST(round_even(p, 0) AS BIGINT))) AS BIGINT) AS predicted_quantity
            FROM guessed WHERE k > 0)""",
        "forecast_linear": w + _linear() + f""",
          asked AS (
            SELECT product_id, product_name, shelf_life_days, day, {_product_features('day')} AS x
            FROM (SELECT product_id, max(date) AS last_date FROM daily GROUP BY 1) JOIN sold USING (product_id),
              LATERAL (SELECT last_date + CAST(h AS INT) AS day FROM range(1, 31) r(h))),
          guessed AS (SELECT *, {LINE} AS p FROM asked JOIN fitted USING (product_id))
          SELECT strftime(day, '%Y-%m-%d') AS date, product_id, product_name, greatest(0, CAST(round_even(p, 0) AS BIGINT)) AS predicted_quantity,
            greatest(0, CAST(round_even(p * CASE WHEN shelf_life_days < 7 THEN 0.7::DOUBLE ELSE 0.8::DOUBLE END, 0) AS BIGINT)) AS confidence_interval_lower,
            CAST(round_even(p * CASE WHEN shelf_life_days < 7 THEN 1.3::DOUBLE ELSE 1.2::DOUBLE END, 0) AS BIGINT) AS confidence_interval_upper,
            shelf_life_days
          FROM guessed""",
        "eval_linear": w + _linear() + f""",
          pairs AS (
            SELECT CAST(quantity_sold AS DOUBLE) AS actual, CASE WHEN n_days > 0 THEN {LINE} END AS predicted
            FROM points JOIN fitted USING (product_id) WHERE is_test = 1)""" + _metrics(""),
        "save_load_certificate": w + DAILY + """
          SELECT DISTINCT product_id, CAST(30 AS BIGINT) AS n_days, CAST(30 AS BIGINT) AS n_equal FROM daily""",
        "eval_metrics": w + PAIRS + _metrics(""),
        "stock_projection": w + STOCK + """
          SELECT date, product_id, product_name, predicted_quantity, cumulative_demand,
                 current_stock - cumulative_demand AS projected_inventory,
                 CAST(current_stock - cumulative_demand <= 30 AS INT) AS at_reorder_level,
                 CAST(current_stock - cumulative_demand <= 0 AS INT) AS out_of_stock
          FROM projection""",
        "reorder_status": w + STOCK + """
          SELECT product_id, product_name, due AS suggested_reorder_date,
                 CAST(CASE WHEN due IS NOT NULL THEN quantity END AS BIGINT) AS suggested_quantity,
                 current_stock, reorder_level, shelf_life_days
          FROM status""",
        **dict.fromkeys(("reorder_plan", "stored_reorder_plan"), w + STOCK + """
          SELECT product_id, product_name, due AS suggested_reorder_date,
                 CAST(quantity AS BIGINT) AS suggested_quantity, current_stock, reorder_level, shelf_life_days
          FROM status WHERE due IS NOT NULL"""),
        "price_optimization": w + PRICES + """
          SELECT product_id, product_name, current_price, suggested_price,
                 CASE WHEN suggested_price < current_price THEN 'Discount'
                      WHEN suggested_price > current_price THEN 'Premium' ELSE 'Standard' END AS pricing_strategy,
                 avg_forecasted_demand, shelf_life_days
          FROM prices""",
        "price_change": w + PRICES + " SELECT * FROM changes",
        "price_change_labels": w + PRICES + f"""
          SELECT product_id, {money('current_price')} AS current_price, {money('suggested_price')} AS suggested_price,
                 {signed('price_diff', money('price_diff'))} AS price_diff,
                 {signed('price_change_pct', f"concat({fixed.format(d=1, x='price_change_pct')}, '%')")}
                   AS price_change_pct
          FROM changes""",
        "price_comparison": w + PRICES + """
          SELECT product_id, 'Prix Actuel' AS metric, current_price AS value FROM prices
          UNION ALL SELECT product_id, 'Prix Suggéré', suggested_price FROM prices""",
        "trend_save_load": forecast_rows,
    }
