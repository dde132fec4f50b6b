"""The registered queries as SQL over the same tables, for comparison on another engine."""

from __future__ import annotations

from shelfcast.operators.features import FEATURES, HORIZONS, LAGS, ROLL_WIDTHS
from shelfcast.operators.forecast import LONGEST, SMOOTHING_GRID
from shelfcast.operators.series_models import RIDGE_PENALTIES
from shelfcast.plans.queries import HOLIDAYS, SLICE_ITEM, VAL_DAYS
from shelfcast.plans.training_run import NAIVE_MODELS
from shelfcast.sources.results import RESULT_TABLES

SERIES = "PARTITION BY store, item"
ORDERED = f"{SERIES} ORDER BY date"


def r(expression: str, name: str) -> str:
    """Rounded to six digits, without a negative zero."""
    return f"ROUND(CAST({expression} AS DOUBLE), 6) + 0.0 AS {name}"


# Shared steps. A step may use the ones it lists; `sql` adds them in order.
STEPS: dict[str, tuple[tuple[str, ...], str]] = {}


def step(name: str, body: str, *needs: str) -> None:
    STEPS[name] = (needs, body)


def sql(select: str, *needs: str, recursive: str = "") -> str:
    ordered: list[str] = []

    def visit(name: str) -> None:
        for need in STEPS[name][0]:
            visit(need)
        if name not in ordered:
            ordered.append(name)

    for need in needs:
        visit(need)
    parts = [f"{name} AS ({STEPS[name][1]})" for name in ordered]
    if recursive:
        parts.append(recursive)
    return f"WITH {'RECURSIVE ' if recursive else ''}{', '.join(parts)} {select}"


step(
    "panel",
    """SELECT CAST(l.l_shipdate AS DATE) AS date, s.s_nationkey AS store, p.p_type AS item,
       CAST(SUM(l.l_quantity) AS BIGINT) AS sales
       FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey JOIN part p ON l.l_partkey = p.p_partkey
       GROUP BY 1, 2, 3""",
)
step(
    "dense_panel",
    """SELECT CAST(d.date AS DATE) AS date, d.store, d.item, COALESCE(p.sales, 0) AS sales
       FROM (SELECT store, item, UNNEST(generate_series(CAST(MIN(date) AS TIMESTAMP), CAST(MAX(date) AS TIMESTAMP),
             INTERVAL 1 DAY)) AS date FROM panel GROUP BY store, item) d
       LEFT JOIN panel p ON p.store = d.store AND p.item = d.item AND p.date = CAST(d.date AS DATE)""",
    "panel",
)
_CALENDAR = """CAST(year(date) AS INTEGER) AS year, CAST(month(date) AS INTEGER) AS month, CAST(day(date) AS INTEGER) AS day,
    CAST(isodow(date) - 1 AS INTEGER) AS dow, CAST(weekofyear(date) AS INTEGER) AS week,
    CAST(quarter(date) AS INTEGER) AS quarter, CAST(dayofyear(date) AS INTEGER) AS dayofyear,
    CAST(isodow(date) IN (6, 7) AS INTEGER) AS is_weekend, CAST(day(date) = 1 AS INTEGER) AS is_month_start,
    CAST(date = last_day(date) AS INTEGER) AS is_month_end,
    CAST(month(date) = 1 AND day(date) = 1 AS INTEGER) AS is_year_start,
    CAST(month(date) = 12 AND day(date) = 31 AS INTEGER) AS is_year_end"""
_LAGS = ", ".join(f"LAG(sales, {n}) OVER ({ORDERED}) AS lag_{n}" for n in LAGS)
_ROLLS = ", ".join(
    f"{fn}(sales) OVER ({ORDERED} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING) AS roll_{stat}_{n}"
    for stat, fn in (("mean", "AVG"), ("std", "STDDEV_SAMP"))
    for n in ROLL_WIDTHS
)
_COMPLETE = " AND ".join(f"lag_{n} IS NOT NULL" for n in LAGS)


def _frame(name: str, source: str, prefix: str = "") -> None:
    step(f"{prefix}features", f"SELECT *, {_CALENDAR}, {_LAGS}, {_ROLLS} FROM {source}", source)
    step(f"{prefix}complete", f"SELECT * FROM {prefix}features WHERE {_COMPLETE}", f"{prefix}features")
    for days in (60, VAL_DAYS):
        step(
            f"{prefix}split{days}",
            f"""SELECT c.*, k.cutoff, CASE WHEN c.date <= k.cutoff THEN 'train' ELSE 'val' END AS split
                FROM {prefix}complete c, (SELECT MAX(date) - {days} AS cutoff FROM {prefix}complete) k""",
            f"{prefix}complete",
        )


_frame("features", "panel")
_frame("features", "dense_panel", "dense_")
SPLIT = f"split{VAL_DAYS}"
step(
    "coded",
    """SELECT *, CAST(DENSE_RANK() OVER (ORDER BY store) - 1 AS INTEGER) AS store_code,
       CAST(DENSE_RANK() OVER (ORDER BY item) - 1 AS INTEGER) AS item_code FROM complete""",
    "complete",
)


def _naive(prefix: str, models: dict[str, str], days: int) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{m}' AS model, store, item, date, CAST(sales AS DOUBLE) AS y, CAST({c} AS DOUBLE) AS yhat
            FROM {prefix}split{days} WHERE split = 'val'"""
        for m, c in models.items()
    )


step("naive", _naive("", NAIVE_MODELS, VAL_DAYS), SPLIT)
step("dense_naive", _naive("dense_", NAIVE_MODELS, VAL_DAYS), f"dense_{SPLIT}")

RAW_METRICS = {
    "rmse": "SQRT(AVG((y - yhat) * (y - yhat)))",
    "mae": "AVG(ABS(y - yhat))",
    "r2": """CASE WHEN COUNT(*) < 2 THEN NULL
        WHEN VAR_POP(y) = 0 THEN CASE WHEN SUM((y - yhat) * (y - yhat)) = 0 THEN 1.0 ELSE 0.0 END
        ELSE 1 - SUM((y - yhat) * (y - yhat)) / (VAR_POP(y) * COUNT(*)) END""",
    "mape": "COALESCE(AVG(ABS((y - yhat) / y)) FILTER (WHERE y <> 0), 0) * 100",
    "smape": """COALESCE(AVG(ABS(y - yhat) / ((ABS(y) + ABS(yhat)) / 2)) FILTER (WHERE ABS(y) + ABS(yhat) <> 0), 0) * 100""",
}
METRICS = ", ".join(r(e, n) for n, e in RAW_METRICS.items())
PLAIN_METRICS = ", ".join(f"{e} AS {n}" for n, e in RAW_METRICS.items())
METRIC_COLUMNS = ", ".join(r(n, n) for n in RAW_METRICS)

step("naive_scores", f"SELECT model, {PLAIN_METRICS} FROM naive GROUP BY model", "naive")

_HOLIDAY_LIST = ", ".join(f"DATE '{d}'" for d in HOLIDAYS)
step(
    "study",
    f"""SELECT date, store, item, sales, CAST(isodow(date) - 1 AS INTEGER) AS day_of_week,
        CAST(month(date) AS INTEGER) AS month, CAST(date IN ({_HOLIDAY_LIST}) AS INTEGER) AS holiday FROM panel""",
    "panel",
)
_LEADS = ", ".join(f"LEAD(sales, {h}) OVER ({ORDERED}) AS y{h}" for h in HORIZONS.values())
_INPUTS = ("sales", "day_of_week", "month", "holiday")
_TEXTS = ", ".join(
    f"STRING_AGG(CAST({c} AS VARCHAR), ',') OVER ({ORDERED} ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS x_{c}" for c in _INPUTS
)
_TEXT_COLUMNS = ", ".join(f"x_{c}" for c in _INPUTS)
step(
    "anchored",
    f"""SELECT store, item, date AS anchor_date, ROW_NUMBER() OVER ({ORDERED}) - 1 AS t,
        COUNT(*) OVER ({SERIES}) AS length, {_LEADS},
        LIST(sales) OVER ({ORDERED} ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS values,
        {_TEXTS} FROM study""",
    "study",
)
step(
    "windows",
    " UNION ALL ".join(
        f"""SELECT store, item, anchor_date, '{name}' AS name, CAST({h} AS INTEGER) AS horizon, t - 29 AS i,
            length - 30 - {h} + 1 AS n, y{h} AS y, values, {_TEXT_COLUMNS} FROM anchored
            WHERE length >= {30 + max(HORIZONS.values())} AND t >= 29 AND t - 29 < length - 30 - {h} + 1
            AND length - 30 - {h} + 1 > 100"""
        for name, h in HORIZONS.items()
    ),
    "anchored",
)
step(
    "split_windows",
    """SELECT *, CASE WHEN i < floor(n * CAST(0.7 AS DOUBLE)) THEN 'train'
       WHEN i < floor(n * CAST(0.85 AS DOUBLE)) THEN 'val' ELSE 'test' END AS split FROM windows""",
    "windows",
)
step(
    "baselines",
    " UNION ALL ".join(
        f"""SELECT '{m}' AS model, store, item, name AS horizon, CAST(y AS DOUBLE) AS y, CAST({e} AS DOUBLE) AS yhat
            FROM split_windows WHERE split = 'test'"""
        for m, e in (("last_value", "values[30]"), ("window_mean", "list_sum(values) / 30.0"))
    ),
    "split_windows",
)
step(
    "macro",
    f"""SELECT model, horizon, COUNT(*) AS n_series, AVG(mape) AS mape,
        AVG(mape) FILTER (WHERE item = '{SLICE_ITEM}') AS mape_item, AVG(smape) AS smape,
        AVG(smape) FILTER (WHERE item = '{SLICE_ITEM}') AS smape_item
        FROM (SELECT model, horizon, store, item, {PLAIN_METRICS} FROM baselines GROUP BY ALL) GROUP BY model, horizon""",
    "baselines",
)

# Autocorrelation
step(
    "centred",
    f"""SELECT store, item, ROW_NUMBER() OVER ({ORDERED}) AS t, COUNT(*) OVER ({SERIES}) AS n,
        sales - AVG(sales) OVER ({SERIES}) AS d FROM panel""",
    "panel",
)
step(
    "panel_centred",
    """SELECT 0 AS store, 'all' AS item, ROW_NUMBER() OVER (ORDER BY date, store, item) AS t, COUNT(*) OVER () AS n,
       sales - AVG(sales) OVER () AS d FROM panel""",
    "panel",
)


def _correlations(source: str, name: str) -> None:
    step(
        name,
        f"""SELECT a.store, a.item, k.k, a.n, COALESCE(a.c, 0) / NULLIF(z.c, 0) AS r FROM (SELECT UNNEST(range(0, 31)) AS k) k
            JOIN (SELECT store, item, n, k, SUM(d * ahead) AS c FROM (SELECT store, item, n, d, k,
                  LEAD(d, CAST(k AS INTEGER)) OVER (PARTITION BY store, item, k ORDER BY t) AS ahead
                  FROM {source}, (SELECT UNNEST(range(0, 31)) AS k)) GROUP BY store, item, n, k) a ON a.k = k.k
            JOIN (SELECT store, item, SUM(d * d) AS c FROM {source} GROUP BY store, item) z
            ON z.store = a.store AND z.item = a.item""",
        source,
    )


_correlations("centred", "correlations")
_correlations("panel_centred", "panel_correlations")


def _acf(keys: str, source: str, where: str = "") -> str:
    return f"""SELECT {keys} CAST(k AS INTEGER) AS lag, {r('r', 'acf')},
        {r(f'''CASE WHEN r IS NULL THEN NULL WHEN k = 0 THEN 0 ELSE 1.96 * SQRT((1 + 2 * COALESCE(SUM(CASE WHEN k > 0 THEN r * r END)
        OVER ({SERIES} ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / n) END''', 'band')}
        FROM {source} {where}"""


def _pacf(keys: str, source: str) -> tuple[str, str]:
    recursion = f"""arrays AS (SELECT store, item, MAX(n) AS n, LIST(r ORDER BY k) AS r FROM {source} GROUP BY store, item),
        levinson AS (
        SELECT store, item, n, r, 1 AS k, [r[2]] AS phi, r[2] AS found FROM arrays
        UNION ALL
        SELECT store, item, n, r, k + 1, list_append([phi[j] - last * phi[k + 1 - j] FOR j IN range(1, k + 1)], last), last
        FROM (SELECT *, (r[k + 2] - list_sum([phi[j] * r[k + 2 - j] FOR j IN range(1, k + 1)]))
              / (1 - list_sum([phi[j] * r[j + 1] FOR j IN range(1, k + 1)])) AS last FROM levinson WHERE k < 30))"""
    select = f"""SELECT {keys} lag, {r('found', 'pacf')}, {r('band', 'band')} FROM (
        SELECT store, item, CAST(k AS INTEGER) AS lag, found, 1.96 / SQRT(n) AS band FROM levinson
        UNION ALL SELECT store, item, CAST(0 AS INTEGER), 1.0, 0.0 FROM arrays)"""
    return select, recursion


# Forecasts
step(
    "placed",
    f"SELECT *, ROW_NUMBER() OVER ({ORDERED}) - 1 AS t FROM panel",
    "panel",
)
step(
    "trend",
    """SELECT store, item, regr_slope(sales, t) AS slope, regr_intercept(sales, t) AS intercept, regr_r2(sales, t) AS r_squared,
       COUNT(*) AS n_rows, MAX(date) AS last_date FROM placed GROUP BY store, item""",
    "placed",
)
_DAYS = f"(SELECT CAST(UNNEST(range(1, {LONGEST + 1})) AS INTEGER) AS step)"
BACKTEST = {"1 Month": 30, "3 Months": 90, "1 Year": 365}


def _backtest(h: str, days: int) -> str:
    history = f"""(SELECT store, item, date, sales, ROW_NUMBER() OVER ({ORDERED}) - 1 AS t FROM
        (SELECT *, MAX(date) OVER ({SERIES}) AS last FROM panel) WHERE date <= last - {days})"""
    fits = f"""(SELECT store, item, regr_slope(sales, t) AS slope, regr_intercept(sales, t) AS intercept, COUNT(*) AS n_rows,
        MAX(date) AS last_date, arg_max(sales, date) AS last_value FROM {history} GROUP BY store, item)"""
    return f"""SELECT f.*, p.date, CAST(p.sales AS DOUBLE) AS y, CAST(p.date - f.last_date AS INTEGER) AS step, '{h}' AS horizon
        FROM {fits} f JOIN panel p ON p.store = f.store AND p.item = f.item
        AND p.date > f.last_date AND p.date <= f.last_date + {days}"""


step("backtests", " UNION ALL ".join(_backtest(h, d) for h, d in BACKTEST.items()), "panel")
step(
    "trend_backtests",
    "SELECT store, item, date, y, step, horizon, intercept + slope * (n_rows - 1 + step) AS yhat FROM backtests",
    "backtests",
)
step(
    "historical_trend",
    f"""SELECT store, item, date, sales AS y, intercept + slope * t AS yhat FROM (
        SELECT p.*, k.cutoff, regr_slope(CASE WHEN date <= cutoff THEN sales END, CASE WHEN date <= cutoff THEN t END) OVER ({SERIES}) AS slope,
        regr_intercept(CASE WHEN date <= cutoff THEN sales END, CASE WHEN date <= cutoff THEN t END) OVER ({SERIES}) AS intercept
        FROM placed p, (SELECT MAX(date) - 60 AS cutoff FROM panel) k) WHERE date > cutoff""",
    "placed",
)
step(
    "matrix_rows",
    """SELECT 'persistence' AS model, 'Historical' AS horizon, CAST(sales AS DOUBLE) AS y, CAST(lag_1 AS DOUBLE) AS yhat
       FROM split60 WHERE split = 'val'
       UNION ALL SELECT 'linear_trend', 'Historical', y, yhat FROM historical_trend
       UNION ALL SELECT 'linear_trend', horizon, y, yhat FROM trend_backtests
       UNION ALL SELECT 'persistence', horizon, y, last_value FROM backtests""",
    "split60", "historical_trend", "trend_backtests",
)
step(
    "matrix_scores",
    f"""SELECT model, horizon, {PLAIN_METRICS} FROM matrix_rows GROUP BY model, horizon""",
    "matrix_rows",
)


step(
    "chosen_pair",
    f"""SELECT v.store, v.item FROM {SPLIT} v JOIN coded c USING (store, item, date) WHERE v.split = 'val'
        GROUP BY v.store, v.item, c.store_code, c.item_code
        ORDER BY (c.store_code = 1 AND c.item_code = 1) DESC, (c.store_code = 0 AND c.item_code = 0) DESC,
        COUNT(*) DESC, c.store_code, c.item_code LIMIT 1""",
    SPLIT, "coded",
)
step(
    "direct_rows",
    " UNION ALL ".join(
        f"""SELECT * FROM (SELECT store, item, sales, cutoff, '{name}' AS horizon, LEAD(sales, {h}) OVER ({ORDERED}) AS y,
            LEAD(date, {h}) OVER ({ORDERED}) AS date FROM {SPLIT}) WHERE y IS NOT NULL"""
        for name, h in HORIZONS.items()
    ),
    SPLIT,
)
step(
    "family_rows",
    f"""SELECT 'last_row' AS model, CAST(sales AS DOUBLE) AS y, CAST(lag_1 AS DOUBLE) AS yhat FROM {SPLIT} WHERE split = 'val'
        UNION ALL SELECT 'row_60_back', sales, lag_60 FROM {SPLIT} WHERE split = 'val'
        UNION ALL SELECT 'linear_trend', v.sales, f.yhat FROM (
            SELECT store, item, date, regr_intercept(CASE WHEN date <= cutoff THEN sales END, CASE WHEN date <= cutoff THEN t END) OVER ({SERIES})
            + t * regr_slope(CASE WHEN date <= cutoff THEN sales END, CASE WHEN date <= cutoff THEN t END) OVER ({SERIES}) AS yhat
            FROM placed, (SELECT MAX(cutoff) AS cutoff FROM {SPLIT})) f
        JOIN {SPLIT} v USING (store, item, date) WHERE v.split = 'val'""",
    SPLIT, "placed",
)
step("family_scores", f"SELECT model, {PLAIN_METRICS} FROM family_rows GROUP BY model", "family_rows")


def _histogram(source: str, value: str, bins: int, *needs: str) -> str:
    edge = lambda i: f"CASE WHEN {i} = {bins} THEN hi ELSE ({i}) * ((hi - lo) / {bins}) + lo END"
    return sql(
        f""", data AS (SELECT CAST({value} AS DOUBLE) AS x FROM {source}),
        ends AS (SELECT CASE WHEN MIN(x) = MAX(x) THEN MIN(x) - 0.5 ELSE MIN(x) END AS lo,
                 CASE WHEN MIN(x) = MAX(x) THEN MAX(x) + 0.5 ELSE MAX(x) END AS hi FROM data),
        guessed AS (SELECT x, lo, hi, CAST(LEAST(FLOOR((x - lo) / (hi - lo) * {bins}), {bins - 1}) AS INTEGER) AS g FROM data, ends),
        placed_bins AS (SELECT CASE WHEN x < {edge('g')} THEN g - 1
            WHEN x >= {edge('(g + 1)')} AND g < {bins - 1} THEN g + 1 ELSE g END AS bin, COUNT(*) AS n FROM guessed GROUP BY 1)
        SELECT CAST(b.bin AS INTEGER) AS bin, {r(edge('b.bin'), 'lo')}, {r(edge('(b.bin + 1)'), 'hi')}, COALESCE(h.n, 0) AS n
        FROM (SELECT UNNEST(range(0, {bins})) AS bin) b CROSS JOIN ends LEFT JOIN placed_bins h ON h.bin = b.bin""",
        *needs,
    )


def _extreme(what: str, label: str, metric: str, key: str, largest: bool) -> str:
    order = f"value {'DESC' if largest else 'ASC'} NULLS LAST, key"
    return f"""SELECT '{what}' AS what, {label} AS label, {r('value', 'value')} FROM
        (SELECT {key} AS key, CAST({metric} AS DOUBLE) AS value FROM panel GROUP BY 1 ORDER BY {order} LIMIT 1)"""


_DAY_LABEL = "list_extract(['Mon', 'Tue', 'Wed', 'Thu', 'Fri', 'Sat', 'Sun'], CAST(key AS INTEGER) + 1)"
_MONTH_LABEL = (
    "list_extract(['Jan', 'Feb', 'Mar', 'Apr', 'May', 'Jun', 'Jul', 'Aug', 'Sep', 'Oct', 'Nov', 'Dec'], CAST(key AS INTEGER))"
)
_TEXT = "CAST(key AS VARCHAR)"


def _sequences(days: int, across: bool) -> str:
    part = "store, item" if across else "store, item, split"
    return sql(
        f"""SELECT store, item, date, split, list_aggregate(seq, 'string_agg', ',') AS seq, sales AS y FROM (
            SELECT *, LIST(sales) OVER (PARTITION BY {part} ORDER BY date ROWS BETWEEN 28 PRECEDING AND 1 PRECEDING) AS seq
            FROM split{days}) WHERE len(seq) = 28""",
        f"split{days}",
    )


def _smoothing() -> str:
    grid = ", ".join(f"({i}, {a}, {b}, {g})" for i, (a, b, g) in enumerate(SMOOTHING_GRID))
    first = "list_avg(x[1:7])"
    seasons = ", ".join(f"x[{i + 1}] - {first} AS s{i}" for i in range(7))
    rotated = ", ".join(f"s{i + 1} AS s{i}" for i in range(6))
    recursion = f"""series AS (SELECT store, item, LIST(CAST(sales AS DOUBLE) ORDER BY date) AS x, COUNT(*) AS n,
            MAX(date) AS last_date FROM panel GROUP BY store, item HAVING COUNT(*) >= 14),
        grid AS (SELECT CAST(column0 AS INTEGER) AS g, CAST(column1 AS DOUBLE) AS a, CAST(column2 AS DOUBLE) AS b,
            CAST(column3 AS DOUBLE) AS c FROM (VALUES {grid}) v(column0, column1, column2, column3)),
        smooth AS (
            SELECT store, item, n, last_date, g, a, b, c, 0 AS t, {first} AS l, (list_avg(x[8:14]) - {first}) / 7 AS m, {seasons},
                CAST(NULL AS DOUBLE) AS fit, CAST(0 AS DOUBLE) AS sse FROM series, grid
            UNION ALL
            SELECT store, item, n, last_date, g, a, b, c, t + 1, nl, b * (nl - l) + (1 - b) * m, {rotated},
                c * (y - (l + m)) + (1 - c) * s0, l + m + s0, sse + (y - (l + m + s0)) * (y - (l + m + s0))
            FROM (SELECT h.*, CAST(p.sales AS DOUBLE) AS y, h.a * (p.sales - h.s0) + (1 - h.a) * (h.l + h.m) AS nl
                  FROM smooth h JOIN placed p ON p.store = h.store AND p.item = h.item AND p.t = h.t)),
        best AS (SELECT * FROM smooth WHERE t = n QUALIFY ROW_NUMBER() OVER (PARTITION BY store, item ORDER BY sse, g) = 1)"""
    return sql(
        f"""SELECT 'seasonal_smoothing' AS model, store, item, date, step, kind, {r('yhat', 'yhat')} FROM (
            SELECT s.store, s.item, p.date, CAST(0 AS INTEGER) AS step, 'fitted' AS kind, s.fit AS yhat
            FROM smooth s JOIN best b ON b.store = s.store AND b.item = s.item AND b.g = s.g
            JOIN placed p ON p.store = s.store AND p.item = s.item AND p.t = s.t - 1 WHERE s.t > 0
            UNION ALL
            SELECT store, item, last_date + d.step, d.step, 'forecast',
                l + m * d.step + list_extract([s0, s1, s2, s3, s4, s5, s6], CAST((d.step - 1) % 7 AS INTEGER) + 1)
            FROM best, {_DAYS} d)""",
        "placed",
        recursive=recursion,
    )


def _ridge_on_one_input() -> str:
    """Weights Sxy / (Sxx + penalty) on min-max scaled sales, and the penalty with the smallest error on the validation windows."""
    penalties = ", ".join(f"({i}, {p})" for i, p in enumerate(RIDGE_PENALTIES))
    spans = ", ".join(f"('{name}', {h})" for name, h in HORIZONS.items())
    steps = f"""anchors AS (SELECT p.store, p.item, p.date, p.sales, p.t, h.horizon, h.h, s.n - h.h AS n,
            LEAD(p.sales, CAST(h.h AS INTEGER)) OVER (PARTITION BY p.store, p.item, h.horizon ORDER BY p.date) AS y
            FROM placed p JOIN (SELECT store, item, COUNT(*) AS n FROM placed GROUP BY store, item) s ON s.store = p.store AND s.item = p.item,
                (SELECT column0 AS horizon, column1 AS h FROM (VALUES {spans}) v(column0, column1)) h
            WHERE s.n >= 1 + {max(HORIZONS.values())} AND s.n - h.h > 100),
        parted AS (SELECT *, CASE WHEN t < FLOOR(n * CAST(0.7 AS DOUBLE)) THEN 'train' WHEN t < FLOOR(n * CAST(0.85 AS DOUBLE)) THEN 'val' ELSE 'test' END AS part FROM anchors WHERE t < n),
        ranged AS (SELECT *, MIN(sales) FILTER (WHERE part = 'train') OVER w AS low, MAX(sales) FILTER (WHERE part = 'train') OVER w AS high
            FROM parted WINDOW w AS (PARTITION BY store, item, horizon)),
        scaled AS (SELECT *, (sales - low) / CAST(CASE WHEN high = low THEN 1 ELSE high - low END AS DOUBLE) AS x FROM ranged),
        facts AS (SELECT store, item, horizon, AVG(x) AS mx, AVG(y) AS my, regr_sxy(y, x) AS sxy, regr_sxx(y, x) AS sxx
            FROM scaled WHERE part = 'train' GROUP BY store, item, horizon),
        tried AS (SELECT f.*, k.i, k.penalty, CASE WHEN sxx > 0 THEN sxy / (sxx + penalty) ELSE 0 END AS w
            FROM facts f, (SELECT column0 AS i, CAST(column1 AS DOUBLE) AS penalty FROM (VALUES {penalties}) v(column0, column1)) k),
        judged AS (SELECT t.store, t.item, t.horizon, t.i, t.penalty, t.w, t.mx, t.my, SUM(pow(s.y - (t.my + t.w * (s.x - t.mx)), 2)) AS error
            FROM tried t JOIN scaled s ON s.store = t.store AND s.item = t.item AND s.horizon = t.horizon AND s.part = 'val' GROUP BY ALL),
        chosen AS (SELECT * FROM judged QUALIFY ROW_NUMBER() OVER (PARTITION BY store, item, horizon ORDER BY error, i) = 1)"""
    return sql(
        f""", {steps} SELECT 'chosen_penalty_ridge' AS model, s.store, s.item, s.date AS anchor_date, s.horizon, CAST(s.y AS DOUBLE) AS y,
            {r('c.my + c.w * (s.x - c.mx)', 'yhat')}, {r('c.penalty', 'penalty')}
            FROM scaled s JOIN chosen c ON c.store = s.store AND c.item = s.item AND c.horizon = s.horizon WHERE s.part = 'test'""",
        "placed",
    )


SCALED = ["sales", "lag_1", "lag_7", "roll_mean_7", "roll_std_28"]


step("weekday_levels", f"SELECT dow, AVG(sales) AS level FROM {SPLIT} WHERE split = 'train' GROUP BY dow", SPLIT)
step(
    "one_input_scores",
    f"""SELECT model, {PLAIN_METRICS} FROM (
        SELECT 'DecisionTree' AS model, CAST(sales AS DOUBLE) AS y, level AS yhat FROM {SPLIT} JOIN weekday_levels USING (dow) WHERE split = 'val'
        UNION ALL SELECT 'LinearRegression', CAST(sales AS DOUBLE), a + b * dow FROM {SPLIT},
            (SELECT regr_slope(sales, dow) AS b, regr_intercept(sales, dow) AS a FROM {SPLIT} WHERE split = 'train') WHERE split = 'val')
        GROUP BY model""",
    "weekday_levels",
)
step(
    "line_rows",
    f"""SELECT 'LinearRegression' AS model, store, item, date, CAST(sales AS DOUBLE) AS y, a + b * lag_7 AS yhat
        FROM {SPLIT}, (SELECT regr_slope(sales, lag_7) AS b, regr_intercept(sales, lag_7) AS a FROM {SPLIT} WHERE split = 'train')
        WHERE split = 'val'""",
    SPLIT,
)
step("line_scores", f"SELECT model, {PLAIN_METRICS} FROM line_rows GROUP BY model", "line_rows")
# Model, and whether its target is the weekday's mean itself.
WEEKDAY_ORACLES = {
    "decision_tree_on_weekday": ("DecisionTree", False),
    "extra_trees_on_weekday": ("ExtraTrees", False),
    "hist_gradient_boosting_on_weekday": ("HistGradientBoosting", False),
    "random_forest_on_weekday_levels": ("RandomForest", True),
    "gradient_boosting_on_weekday_levels": ("GradientBoosting", True),
    "early_stopping_on_weekday_levels": ("EarlyStoppingBoosting", True),
}


def all_sql() -> dict[str, str]:
    scaler = ", ".join(
        f"AVG({c}) AS {c}_mean, COALESCE(NULLIF(STDDEV_POP({c}), 0), 1) AS {c}_std" for c in SCALED
    )
    coded = ", ".join(r(f, f) if f.startswith("roll_") else f for f in FEATURES)
    features_rolls = ", ".join(r(f, f) for f in FEATURES if f.startswith("roll_"))
    days = ", ".join(f"CAST(isodow(date) - 1 = {k} AS INTEGER) AS day_{k}" for k in range(7))
    months = ", ".join(f"CAST(month(date) = {k} AS INTEGER) AS month_{k}" for k in range(1, 13))
    minmax = ", ".join(
        r(f"COALESCE(({c} - MIN({c}) OVER ({SERIES})) / CAST(NULLIF(MAX({c}) OVER ({SERIES}) - MIN({c}) OVER ({SERIES}), 0) AS DOUBLE), 0)", c)
        for c in ("sales", "day_of_week", "month", "holiday")
    )
    pairs = "SELECT store, item, COUNT(*) AS n_rows FROM panel GROUP BY store, item"
    sizes = "SELECT store, item, COUNT(*) AS n_rows, MIN(date) AS first_date, MAX(date) AS last_date FROM panel"
    quartiles = ", ".join(f"quantile_cont(sales, {q}) AS q{i}" for i, q in ((1, 0.25), (2, 0.5), (3, 0.75)))
    step("quartiles", f"SELECT {quartiles} FROM panel", "panel")
    points = (0, 25, 50, 75, 90, 95, 99, 100)
    ranking = f"""SELECT model, {METRIC_COLUMNS}, CAST(ROW_NUMBER() OVER (ORDER BY rmse, model) AS INTEGER) AS rank"""
    best = " UNION ALL ".join(
        f"""SELECT * FROM (SELECT '{m}' AS metric, model, {r(m, 'value')} FROM naive_scores
            ORDER BY naive_scores.{m} {'DESC' if m == 'r2' else 'ASC'} NULLS LAST, model LIMIT 1)"""
        for m in RAW_METRICS
    )
    matrix = " UNION ALL ".join(
        f"""SELECT model, '{m}' AS metric, {', '.join(r(f"MAX({m}) FILTER (WHERE horizon = '{h}')", c) for h, c in
            (('Historical', 'historical'), ('1 Month', 'month_1'), ('3 Months', 'months_3'), ('1 Year', 'year_1')))}
            FROM matrix_scores GROUP BY model"""
        for m in RAW_METRICS
    )
    macro_columns = ", ".join(r(c, c) for c in ("mape", "mape_item", "smape", "smape_item"))
    macro_matrix = ", ".join(
        f"MAX(ROUND({m}, 2)) FILTER (WHERE horizon = '{h}') AS \"{h.replace(' ', '_')}_{m}\"" for h in HORIZONS for m in ("mape", "smape")
    )
    acf_pairs = f"JOIN (SELECT store AS s, item AS i FROM ({pairs}) ORDER BY n_rows DESC, store, item LIMIT 2) ON s = store AND i = item"
    pacf, pacf_steps = _pacf("store, item,", "correlations")
    panel_pacf, panel_pacf_steps = _pacf("", "panel_correlations")
    trailing = " UNION ALL ".join(
        f"""SELECT date, store, item, sales, '{w}' AS "window" FROM
            (SELECT *, ROW_NUMBER() OVER ({SERIES} ORDER BY date DESC) AS rn FROM panel) WHERE rn <= {n}"""
        for w, n in (("1 Month", 30), ("3 Months", 90), ("1 Year", 365))
    )
    trailing_days = " UNION ALL ".join(
        f"""SELECT date, store, item, sales, '{w}' AS "window" FROM
            (SELECT *, MAX(date) OVER ({SERIES}) AS last FROM panel) WHERE date >= last - INTERVAL {n} MONTH"""
        for w, n in (("1 Month", 1), ("3 Months", 3), ("1 Year", 12))
    )
    by_window = " UNION ALL ".join(
        f"""SELECT model, '{w}' AS "window", {METRICS} FROM (SELECT *, ROW_NUMBER() OVER
            (PARTITION BY model, store, item ORDER BY date DESC) AS rn FROM naive) WHERE rn <= {n} GROUP BY model"""
        for w, n in (("1 Month", 30), ("3 Months", 90), ("1 Year", 365))
    )
    timeline = f"""SELECT model, store, item, COUNT(*) AS n_rows, {r('AVG(y)', 'actual_mean')}, {r('STDDEV_POP(y)', 'actual_std')},
        {r('AVG(yhat)', 'pred_mean')}, {r('STDDEV_POP(yhat)', 'pred_std')}, {r('AVG(ABS(y - yhat))', 'mae')},
        {r('SQRT(AVG((y - yhat) * (y - yhat)))', 'rmse')} FROM {{}} GROUP BY model, store, item"""
    pair_scores = " UNION ALL ".join(
        f"""SELECT model, store, item, '{w}' AS "window", {METRICS} FROM (SELECT *, ROW_NUMBER() OVER
            (PARTITION BY model, store, item ORDER BY date DESC) AS rn FROM naive JOIN chosen_pair USING (store, item))
            WHERE rn <= {n} GROUP BY model, store, item"""
        for w, n in (("1 Month", 30), ("3 Months", 90), ("1 Year", 365))
    )
    common = f"""seq AS (SELECT store, item, date, sales, list_avg(s) AS m FROM (SELECT *, LIST(sales) OVER (PARTITION BY store, item, split
            ORDER BY date ROWS BETWEEN 28 PRECEDING AND 1 PRECEDING) AS s FROM {SPLIT}) WHERE len(s) = 28 AND split = 'val'),
        shared AS (SELECT v.store, v.item, v.date, v.sales, v.lag_7, q.m FROM {SPLIT} v JOIN seq q USING (store, item, date)),
        both_models AS (SELECT 'row_7_back' AS model, CAST(sales AS DOUBLE) AS y, CAST(lag_7 AS DOUBLE) AS yhat FROM shared
            UNION ALL SELECT 'sequence_mean', sales, m FROM shared),
        common_scores AS (SELECT model, {PLAIN_METRICS} FROM both_models GROUP BY model)"""
    trend_columns = ", ".join(r(c, c) for c in ("slope", "intercept", "r_squared"))
    recursion = f"""fit AS (SELECT regr_slope(sales, roll_mean_7) AS b, regr_intercept(sales, roll_mean_7) AS a FROM complete),
        latest AS (SELECT store, item, MAX(date) AS last_date, LIST(CAST(sales AS DOUBLE) ORDER BY date) AS seq FROM
            (SELECT *, ROW_NUMBER() OVER ({SERIES} ORDER BY date DESC) AS rn FROM panel) WHERE rn <= 7 GROUP BY store, item
            HAVING COUNT(*) = 7),
        rolled AS (SELECT store, item, last_date, seq, 0 AS step, CAST(NULL AS DOUBLE) AS yhat, a, b FROM latest, fit
            UNION ALL SELECT store, item, last_date, list_append(seq[2:7], v), step + 1, v, a, b FROM
            (SELECT *, a + b / 7 * list_sum(seq) AS v FROM rolled WHERE step < {LONGEST}))"""
    found = {
        "panel": sql("SELECT * FROM panel", "panel"),
        "densified_panel": sql("SELECT * FROM dense_panel", "dense_panel"),
        "calendar_features": sql(
            f"""SELECT date, store, item, sales, {_CALENDAR}, strftime(date, '%a') AS day_label, strftime(date, '%b') AS month_label,
                strftime(date, '%Y-%m-%d') AS iso FROM panel""",
            "panel",
        ),
        "holiday_flag": sql("SELECT date, store, item, sales, holiday FROM study", "study"),
        "one_hot_calendar_columns": sql(
            f"""SELECT date, store, item, sales, CAST(isodow(date) - 1 AS INTEGER) AS dow, CAST(month(date) AS INTEGER) AS month,
                {days}, {months} FROM panel""",
            "panel",
        ),
        "log_sales": sql(f"SELECT date, store, item, sales, {r('ln(1 + CAST(sales AS DOUBLE))', 'log_sales')} FROM panel", "panel"),
        "series_position": sql("SELECT date, store, item, sales, CAST(t AS INTEGER) AS t FROM placed", "placed"),
        "lag_features": sql(f"SELECT date, store, item, sales, {', '.join(f'lag_{n}' for n in LAGS)} FROM features", "features"),
        "rolling_features": sql(f"SELECT date, store, item, sales, {features_rolls} FROM features", "features"),
        "training_frame": sql(f"SELECT date, store, item, sales, {coded} FROM coded", "coded"),
        "category_code_table": sql(
            """SELECT DISTINCT 'item' AS kind, item AS label, item_code AS code FROM coded
               UNION ALL SELECT DISTINCT 'store', CAST(store AS VARCHAR), store_code FROM coded""",
            "coded",
        ),
        "global_position": sql(
            "SELECT date, store, item, sales, ROW_NUMBER() OVER (ORDER BY date, store, item) - 1 AS pos FROM panel", "panel"
        ),
        "lookback_sequence_samples": _sequences(VAL_DAYS, False),
        "lookback_across_split": _sequences(60, True),
        "direct_horizon_windows": sql(
            f"SELECT store, item, anchor_date, horizon, CAST(i AS INTEGER) AS i, n, y, split, {_TEXT_COLUMNS} FROM split_windows", "split_windows"
        ),
        "time_split_counts": sql(
            """SELECT split, cutoff, COUNT(*) AS n_rows, MIN(date) AS first_date, MAX(date) AS last_date
               FROM split60 GROUP BY split, cutoff""",
            "split60",
        ),
        "ratio_split_counts": sql(
            "SELECT horizon, split, COUNT(*) AS n_windows FROM split_windows GROUP BY horizon, split", "split_windows"
        ),
        "long_enough_series": sql(f"{sizes} GROUP BY store, item HAVING COUNT(*) >= 395", "panel"),
        "first_ten_series": sql(f"{sizes} GROUP BY store, item ORDER BY store, item LIMIT 10", "panel"),
        "single_series": sql(f"SELECT * FROM panel WHERE store = 1 AND item = '{SLICE_ITEM}'", "panel"),
        "trailing_row_windows": sql(trailing, "panel"),
        "trailing_calendar_windows": sql(trailing_days, "panel"),
        "largest_pairs": sql(f"{pairs} ORDER BY n_rows DESC, store, item LIMIT 3", "panel"),
        "chosen_pair_rows": sql(
            f"""SELECT v.date, v.store, v.item, c.store_code, c.item_code, v.sales FROM {SPLIT} v
                JOIN coded c ON c.store = v.store AND c.item = v.item AND c.date = v.date
                JOIN chosen_pair k ON k.store = v.store AND k.item = v.item
                WHERE v.split = 'val'""",
            "chosen_pair",
        ),
        "standard_scale": sql(
            f"""SELECT store, item, date, split, {', '.join(r(f'({c} - {c}_mean) / {c}_std', c) for c in SCALED)}
                FROM {SPLIT}, (SELECT {scaler} FROM {SPLIT} WHERE split = 'train')""",
            SPLIT,
        ),
        "standard_scaler_parameters": sql(
            f"""SELECT {', '.join(r(f'{c}_{s}', f'{c}_{s}') for c in SCALED for s in ('mean', 'std'))}
                FROM (SELECT {scaler} FROM {SPLIT} WHERE split = 'train')""",
            SPLIT,
        ),
        "standard_scale_round_trip": sql(f"SELECT store, item, date, split, CAST(sales AS DOUBLE) AS sales FROM {SPLIT}", SPLIT),
        "minmax_scale_per_series": sql(f"SELECT date, store, item, {minmax} FROM study", "study"),
        "minmax_round_trip": sql("SELECT date, store, item, CAST(sales AS DOUBLE) AS sales FROM panel", "panel"),
        "dataset_overview": sql(
            f"""SELECT CAST(COUNT(*) AS BIGINT) AS n_rows, MIN(date) AS min_date, MAX(date) AS max_date,
                COUNT(DISTINCT store) AS n_stores, COUNT(DISTINCT item) AS n_items, COUNT(DISTINCT (store, item)) AS n_pairs,
                CAST(MAX(date) - MIN(date) AS INTEGER) AS duration_days,
                {r('COUNT(*) / CAST(COUNT(DISTINCT store) AS DOUBLE)', 'rows_per_store')},
                {r('COUNT(*) / CAST(COUNT(DISTINCT item) AS DOUBLE)', 'rows_per_item')} FROM panel""",
            "panel",
        ),
        "null_counts": sql(
            f"SELECT {', '.join(f'COUNT(*) - COUNT({c}) AS {c}_nulls' for c in ('sales', 'date', 'store', 'item'))} FROM panel", "panel"
        ),
        "sales_moments": sql(
            f"""SELECT {r('AVG(sales)', 'mean')}, {r('STDDEV_SAMP(sales)', 'std')}, MIN(sales) AS min, MAX(sales) AS max,
                {r('skewness(sales)', 'skewness')}, {r('kurtosis(sales)', 'kurtosis')}, {r('median(sales)', 'median')} FROM panel""",
            "panel",
        ),
        "sales_percentiles": sql(
            " UNION ALL ".join(
                f"SELECT CAST({p} AS DOUBLE) AS p, {r(f'quantile_cont(sales, {p / 100})', 'value')} FROM panel" for p in points
            ),
            "panel",
        ),
        "sales_histogram": _histogram("panel", "sales", 50, "panel"),
        "log_sales_histogram": _histogram("panel", "ln(1 + CAST(sales AS DOUBLE))", 50, "panel"),
        "boxplot_stats": sql(
            f"""SELECT {r('MAX(q1)', 'q1')}, {r('MAX(q2)', 'median')}, {r('MAX(q3)', 'q3')},
                {r('LEAST(MIN(CASE WHEN sales >= q1 - 1.5 * (q3 - q1) THEN sales END), MAX(q1))', 'whisker_low')},
                {r('GREATEST(MAX(CASE WHEN sales <= q3 + 1.5 * (q3 - q1) THEN sales END), MAX(q3))', 'whisker_high')},
                COUNT(*) FILTER (WHERE sales < q1 - 1.5 * (q3 - q1) OR sales > q3 + 1.5 * (q3 - q1)) AS n_outliers
                FROM panel, quartiles""",
            "panel",
            "quartiles",
        ),
        "weekday_profile": sql(
            f"""SELECT CAST(isodow(date) - 1 AS INTEGER) AS dow, {r('AVG(sales)', 'mean')}, {r('STDDEV_SAMP(sales)', 'std')},
                MIN(strftime(date, '%a')) AS label FROM panel GROUP BY 1""",
            "panel",
        ),
        "month_profile": sql(
            f"""SELECT CAST(month(date) AS INTEGER) AS month, {r('AVG(sales)', 'mean')}, {r('STDDEV_SAMP(sales)', 'std')},
                MIN(strftime(date, '%b')) AS label FROM panel GROUP BY 1""",
            "panel",
        ),
        "daily_mean": sql(f"SELECT date, {r('AVG(sales)', 'mean')} FROM panel GROUP BY date", "panel"),
        "store_totals_top10": sql(
            f"""SELECT store, CAST(SUM(sales) AS BIGINT) AS total, {r('AVG(sales)', 'mean')}, COUNT(*) AS n_rows
                FROM panel GROUP BY store ORDER BY total DESC, store LIMIT 10""",
            "panel",
        ),
        "item_volatility_top10": sql(
            f"""SELECT item, {r('std', 'std')} FROM (SELECT item, STDDEV_SAMP(sales) AS std FROM panel GROUP BY item
                ORDER BY std DESC NULLS LAST, item LIMIT 10)""",
            "panel",
        ),
        "key_counts": sql(
            """SELECT CASE WHEN GROUPING(store) = 1 THEN 'item' WHEN GROUPING(item) = 1 THEN 'store' ELSE 'pair' END AS level,
               store, item, COUNT(*) AS n_rows FROM panel GROUP BY GROUPING SETS ((store), (item), (store, item))""",
            "panel",
        ),
        "sorted_store_counts": sql("SELECT store, COUNT(*) AS n_rows FROM panel GROUP BY store ORDER BY store", "panel"),
        "store_count_histogram": _histogram("(SELECT COUNT(*) AS n FROM panel GROUP BY store)", "n", 30, "panel"),
        "item_count_histogram": _histogram("(SELECT COUNT(*) AS n FROM panel GROUP BY item)", "n", 30, "panel"),
        "pair_count_histogram": _histogram("(SELECT COUNT(*) AS n FROM panel GROUP BY store, item)", "n", 50, "panel"),
        "item_store_totals": sql(
            f"SELECT store, CAST(SUM(sales) AS BIGINT) AS total FROM panel WHERE item = '{SLICE_ITEM}' GROUP BY store", "panel"
        ),
        "extremes": sql(
            " UNION ALL ".join(
                (
                    _extreme("busiest_day", _DAY_LABEL, "AVG(sales)", "isodow(date) - 1", True),
                    _extreme("quietest_day", _DAY_LABEL, "AVG(sales)", "isodow(date) - 1", False),
                    _extreme("peak_month", _MONTH_LABEL, "AVG(sales)", "month(date)", True),
                    _extreme("low_month", _MONTH_LABEL, "AVG(sales)", "month(date)", False),
                    _extreme("top_store", _TEXT, "SUM(sales)", "store", True),
                    _extreme("top_item", _TEXT, "SUM(sales)", "item", True),
                    _extreme("most_volatile_item", _TEXT, "STDDEV_SAMP(sales)", "item", True),
                )
            ),
            "panel",
        ),
        "acf": sql(_acf("store, item,", "correlations"), "correlations"),
        "pacf": sql(pacf, "correlations", recursive=pacf_steps),
        "acf_of_largest_pairs": sql(_acf("store, item,", "correlations", acf_pairs), "correlations"),
        "panel_acf": sql(_acf("", "panel_correlations"), "panel_correlations"),
        "panel_pacf": sql(panel_pacf, "panel_correlations", recursive=panel_pacf_steps),
        "naive_metrics": sql(f"SELECT model, {METRIC_COLUMNS} FROM naive_scores", "naive_scores"),
        "naive_metrics_densified": sql(f"SELECT model, {METRICS} FROM dense_naive GROUP BY model", "dense_naive"),
        "smoothed_percentage_errors": sql(
            f"""SELECT model, {r('AVG(ABS((y - yhat) / (ABS(y) + 1e-10))) * 100', 'mape_smoothed')},
                {r('AVG(ABS(y - yhat) / ((ABS(y) + ABS(yhat)) / 2 + 1e-10)) * 100', 'smape_smoothed')} FROM naive GROUP BY model""",
            "naive",
        ),
        "metrics_by_window": sql(by_window, "naive"),
        "timeline_summary": sql(timeline.format("naive"), "naive"),
        "fitted_run_by_window": sql(by_window.replace("FROM naive)", "FROM line_rows)"), "line_rows"),
        "fitted_run_timeline": sql(timeline.format("line_rows"), "line_rows"),
        "fitted_run_best": sql(best.replace("naive_scores", "line_scores"), "line_scores"),
        "fitted_run_forecasts": sql(
            f"""SELECT model, store, item, k.last_date + d.step AS date, d.step, {r('yhat', 'yhat')} FROM
                (SELECT model, store, item, arg_max(yhat, date) AS yhat FROM line_rows GROUP BY model, store, item),
                (SELECT MAX(date) AS last_date FROM line_rows) k, {_DAYS} d""",
            "line_rows",
        ),
        "metric_ranking": sql(f"{ranking} FROM naive_scores", "naive_scores"),
        "best_per_metric": sql(best, "naive_scores"),
        "common_key_ranking": sql(f", {common} {ranking} FROM common_scores", SPLIT),
        "combined_results": sql(f"{ranking} FROM family_scores", "family_scores"),
        "chosen_pair_scores": sql(pair_scores, "naive", "chosen_pair"),
        "direct_linear_by_horizon": sql(
            f"""SELECT 'direct_linear' AS model, horizon, store, item, date, CAST(y AS DOUBLE) AS y, {r('a + b * sales', 'yhat')}
                FROM direct_rows JOIN (SELECT horizon, regr_slope(y, sales) AS b, regr_intercept(y, sales) AS a FROM direct_rows
                WHERE date <= cutoff GROUP BY horizon) f USING (horizon) WHERE date > cutoff""",
            "direct_rows",
        ),
        "horizon_matrix": sql(matrix, "matrix_scores"),
        "macro_metrics": sql(f"SELECT model, horizon, n_series, {macro_columns} FROM macro", "macro"),
        "results_matrix": sql(f"SELECT model, {macro_matrix} FROM macro GROUP BY model", "macro"),
        "persistence_forecast": sql(
            f"""SELECT 'row_7_back' AS model, store, item, k.last_date + d.step AS date, d.step, yhat FROM
                (SELECT store, item, CAST(arg_max(lag_7, date) AS DOUBLE) AS yhat FROM {SPLIT} WHERE split = 'val' GROUP BY store, item),
                (SELECT MAX(date) AS last_date FROM panel) k, {_DAYS} d""",
            SPLIT,
        ),
        "linear_trend_fit": sql(f"SELECT store, item, {trend_columns}, n_rows, last_date FROM trend", "trend"),
        "linear_trend_path": sql(
            f"""SELECT 'linear_trend' AS model, store, item, date, step, kind, {r('yhat', 'yhat')} FROM (
                SELECT p.store, p.item, p.date, CAST(0 AS INTEGER) AS step, 'fitted' AS kind, intercept + slope * p.t AS yhat
                FROM placed p JOIN trend f ON p.store = f.store AND p.item = f.item
                UNION ALL SELECT store, item, last_date + d.step, d.step, 'forecast', intercept + slope * (n_rows - 1 + d.step)
                FROM trend, {_DAYS} d)""",
            "placed",
            "trend",
        ),
        "trend_backtest": sql(
            f"""SELECT 'linear_trend' AS model, store, item, date, step, {r('yhat', 'yhat')}, y, horizon FROM trend_backtests""",
            "trend_backtests",
        ),
        "holt_winters": _smoothing(),
        "recursive_mean_forecast": sql(
            f"""SELECT 'recursive_mean' AS model, store, item, last_date + step AS date, CAST(step AS INTEGER) AS step, {r('yhat', 'yhat')}
                FROM rolled WHERE step > 0""",
            "complete",
            recursive=recursion,
        ),
        "csv_panel_scan": sql(
            """SELECT date, store, CAST(DENSE_RANK() OVER (ORDER BY item) - 1 AS INTEGER) AS item, sales FROM panel""", "panel"
        ),
        "parquet_panel_scan": sql("SELECT * FROM panel", "panel"),
        "metrics_written_and_read": sql(
            " UNION ALL ".join(
                f"SELECT model, {METRIC_COLUMNS}, '{name}' AS stored_as FROM naive_scores WHERE {part}"
                for name, part in zip(RESULT_TABLES, ("model LIKE 'row%'", "true", "model LIKE 'mean%'"))
            ),
            "naive_scores",
        ),
        "undated_rows": sql(
            "SELECT COUNT(*) FILTER (WHERE day(date) <> 13) AS n_dated, COUNT(*) FILTER (WHERE day(date) = 13) AS n_undated FROM panel", "panel"
        ),
        "linear_regression_on_one_lag": sql(
            f"""SELECT 'LinearRegression' AS model, store, item, date, CAST(sales AS DOUBLE) AS y, {r('a + b * lag_7', 'yhat')}
                FROM {SPLIT}, (SELECT regr_slope(sales, lag_7) AS b, regr_intercept(sales, lag_7) AS a FROM {SPLIT} WHERE split = 'train')
                WHERE split = 'val'""",
            SPLIT,
        ),
        "saved_model_predictions": sql(
            f"""SELECT 'LinearRegression' AS model, store, item, date, CAST(sales AS DOUBLE) AS y, {r('a + b * lag_7', 'yhat')}
                FROM {SPLIT}, (SELECT regr_slope(sales, lag_7) AS b, regr_intercept(sales, lag_7) AS a FROM {SPLIT} WHERE split = 'train')
                WHERE split = 'val'""",
            SPLIT,
        ),
        **{
            name: sql(
                f"""SELECT '{model}' AS model, store, item, date, {r('level' if levels else 'sales', 'y')}, {r('level', 'yhat')}
                    FROM {SPLIT} JOIN weekday_levels USING (dow) WHERE split = 'val'""",
                "weekday_levels",
            )
            for name, (model, levels) in WEEKDAY_ORACLES.items()
        },
        "hist_gradient_boosting_on_weekend": sql(
            f"""SELECT 'HistGradientBoosting' AS model, store, item, date, CAST(sales AS DOUBLE) AS y,
                    {r('m + (level - m) * (1 - pow(1 - 0.05 * n / (n + 1.0), 5))', 'yhat')}
                FROM {SPLIT} JOIN (SELECT is_weekend, AVG(sales) AS level, COUNT(*) AS n FROM {SPLIT} WHERE split = 'train' GROUP BY is_weekend)
                USING (is_weekend), (SELECT AVG(sales) AS m FROM {SPLIT} WHERE split = 'train') WHERE split = 'val'""",
            SPLIT,
        ),
        "regressor_ranking_on_one_input": sql(f"{ranking} FROM one_input_scores", "one_input_scores"),
        "sequence_of_exact_line": sql(
            f"""SELECT 'SequenceLinear' AS model, store, item, date, CAST(2 * lag_1 + 3 * dow + 5 AS DOUBLE) AS y,
                CAST(2 * lag_1 + 3 * dow + 5 AS DOUBLE) AS yhat FROM (SELECT *, ROW_NUMBER() OVER ({SERIES}, split ORDER BY date) AS place
                FROM {SPLIT}) WHERE split = 'val' AND place > 28""",
            SPLIT,
        ),
        "sequences_over_null_sales": sql(
            f"""SELECT store, item, date, split, list_aggregate(seq, 'string_agg', ',') AS seq, sales AS y FROM (
                SELECT store, item, date, split, sales, LIST(sales) OVER w AS seq, COUNT(*) OVER w AS n, COUNT(sales) OVER w AS known FROM (
                    SELECT * REPLACE (CASE WHEN dayofyear(date) % 97 = 0 THEN NULL ELSE sales END AS sales) FROM {SPLIT})
                WINDOW w AS ({SERIES}, split ORDER BY date ROWS BETWEEN 28 PRECEDING AND 1 PRECEDING))
                WHERE n = 28 AND known = 28 AND sales IS NOT NULL""",
            SPLIT,
        ),
        "recursive_sequence_line": sql(
            f"""SELECT 'SequenceLinear' AS model, store, item, last_date + d.step AS date, d.step,
                ROUND(pow(b1, d.step) * last + (a + b2 * last_dow) * (1 - pow(b1, d.step)) / (1 - b1), 4) + 0.0 AS yhat
                FROM (SELECT store, item, MAX(date) AS last_date, arg_max(sales, date) AS last, arg_max(dow, date) AS last_dow FROM {SPLIT} GROUP BY store, item),
                    (SELECT b1, b2, my - b1 * m1 - b2 * m2 AS a FROM (
                        SELECT (s1y * s22 - s2y * s12) / (s11 * s22 - s12 * s12) AS b1, (s2y * s11 - s1y * s12) / (s11 * s22 - s12 * s12) AS b2, my, m1, m2
                        FROM (SELECT covar_pop(x, y) AS s1y, covar_pop(dow, y) AS s2y, covar_pop(x, dow) AS s12, var_pop(x) AS s11, var_pop(dow) AS s22,
                                AVG(y) AS my, AVG(x) AS m1, AVG(dow) AS m2
                            FROM (SELECT sales AS y, dow, split, LAG(sales) OVER ({SERIES}, split ORDER BY date) AS x FROM {SPLIT})
                            WHERE split = 'train' AND x IS NOT NULL))), {_DAYS} d""",
            SPLIT,
        ),
        "ridge_penalty_on_one_input": _ridge_on_one_input(),
        "recursive_line_on_one_lag": sql(
            f"""SELECT 'recursive_linear' AS model, store, item, last_date + d.step AS date, d.step,
                ROUND(POW(b, d.step) * newest + a * (1 - POW(b, d.step)) / (1 - b), 4) + 0.0 AS yhat
                FROM (SELECT store, item, MAX(date) AS last_date, CAST(arg_max(sales, date) AS DOUBLE) AS newest FROM panel GROUP BY store, item),
                (SELECT regr_slope(sales, lag_1) AS b, regr_intercept(sales, lag_1) AS a FROM {SPLIT} WHERE split = 'train'), {_DAYS} d""",
            SPLIT,
        ),
    }
    same = {"overview": "dataset_overview", "percentiles": "sales_percentiles", "log_histogram": "log_sales_histogram", "box_plot": "boxplot_stats", "key_counts": "key_counts", "extremes": "extremes"}
    return found | {f"profile_study_{table}": found[name] for table, name in same.items()}
