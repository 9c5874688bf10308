"""DuckDB SQL for the registered queries: shared common table expressions and the statements on top of them."""

from __future__ import annotations

BUCKET = "time_bucket(INTERVAL '5 minutes', ts)"

CTE = {
    "bars": f"""SELECT event_type AS symbol, {BUCKET} AS ts, CAST({BUCKET} AS DATE) AS day,
        first(value ORDER BY e.ts, event_id) AS open, max(value) AS high, min(value) AS low,
        last(value ORDER BY e.ts, event_id) AS close, CAST(count(*) AS DOUBLE) AS volume, count(*) AS n
        FROM events e WHERE value > 0 GROUP BY 1, 2, 3""",
    "changes": "SELECT *, ln(close) - ln(lag(close) OVER (PARTITION BY symbol ORDER BY ts)) AS c FROM bars",
    "day_sums": """SELECT symbol, day, sum(c * c) AS s, count(*) AS n_bars, sum(volume) AS volume, last(close ORDER BY ts) AS close,
        max(high) AS high, min(low) AS low FROM changes GROUP BY symbol, day""",
    "rv": """SELECT symbol, day, CASE WHEN row_number() OVER w > 1 THEN s END AS rv, close / lag(close) OVER w - 1 AS r, n_bars, volume
        FROM day_sums WINDOW w AS (PARTITION BY symbol ORDER BY day)""",
    "rv_cal": """SELECT c.symbol, c.day, coalesce(n_bars, 0) AS n_bars, coalesce(volume, 0.0) AS volume, rv FROM (
        SELECT symbol, CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day FROM rv GROUP BY symbol) c
        LEFT JOIN rv ON rv.symbol = c.symbol AND rv.day = c.day""",
    "daily": """SELECT l_returnflag || l_linestatus AS symbol, CAST(l_shipdate AS DATE) AS day,
        first(l_extendedprice / l_quantity ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice / l_quantity) AS open,
        max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low,
        last(l_extendedprice / l_quantity ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice / l_quantity) AS close,
        sum(l_quantity) AS volume, count(*) AS n FROM lineitem WHERE l_quantity > 0 GROUP BY 1, 2""",
    "sparse": """SELECT o_orderpriority AS symbol, CAST(o_orderdate AS DATE) AS day, max(o_totalprice) AS high, min(o_totalprice) AS low,
        last(o_totalprice ORDER BY o_orderkey) AS close, CAST(count(*) AS DOUBLE) AS volume, count(*) AS n FROM orders GROUP BY 1, 2""",
    "sparse_cal": """SELECT c.symbol, c.day, close FROM (SELECT symbol, CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day
        FROM sparse GROUP BY symbol) c LEFT JOIN sparse s ON s.symbol = c.symbol AND s.day = c.day""",
    "sparse_ret": "SELECT symbol, day, ln(close) - ln(lag(close) OVER (PARTITION BY symbol ORDER BY day)) AS r FROM sparse_cal",
    "daily_cal": """SELECT c.symbol, c.day, close, high, low, n FROM (SELECT symbol, CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day
        FROM daily GROUP BY symbol) c LEFT JOIN daily d ON d.symbol = c.symbol AND d.day = c.day""",
    "ret": "SELECT symbol, day, ln(close) - ln(lag(close) OVER (PARTITION BY symbol ORDER BY day)) AS r FROM daily_cal",
    "valid": """SELECT symbol, day, CASE WHEN ok THEN high END AS high, CASE WHEN ok THEN low END AS low, CASE WHEN ok THEN close END AS close
        FROM (SELECT *, coalesce(n >= 1 AND low > 0 AND high > low AND close BETWEEN low AND high, false) AS ok FROM daily_cal)""",
    "dvar": """SELECT symbol, day, ln(high / low) * ln(high / low) / (4 * ln(2)) AS rv,
        close / lag(close) OVER (PARTITION BY symbol ORDER BY day) - 1 AS r, n AS n_bars FROM daily""",
    "dvar_cal": """SELECT c.symbol, c.day, CASE WHEN n_bars >= 2 AND rv > 0 THEN ln(rv) END AS x FROM (
        SELECT symbol, CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day FROM dvar GROUP BY symbol) c
        LEFT JOIN dvar d ON d.symbol = c.symbol AND d.day = c.day""",
    "pos": """SELECT symbol, day, r, r * r AS r2, rv, row_number() OVER (PARTITION BY symbol ORDER BY day) - 1 AS idx FROM dvar""",
    "f_window": """SELECT symbol, day, rv, r, CASE WHEN count(r2) OVER w = 30 THEN avg(r2) OVER w END AS f
        FROM pos WINDOW w AS (PARTITION BY symbol ORDER BY idx ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING)""",
    "f_com": """SELECT symbol, day, lag(now) OVER (PARTITION BY symbol ORDER BY idx) AS f FROM (
        SELECT symbol, day, idx, CASE WHEN count(r2) OVER w >= 30 THEN sum(r2 * power(60.0 / 61.0, -idx)) OVER w
        / sum(CASE WHEN r2 IS NOT NULL THEN power(60.0 / 61.0, -idx) END) OVER w END AS now
        FROM pos WINDOW w AS (PARTITION BY symbol ORDER BY idx))""",
    "losses": """SELECT a.symbol, a.day, a.rv, b.f AS fa, a.f AS fb, a.rv / b.f - ln(a.rv / b.f) - 1 AS q_a, a.rv / a.f - ln(a.rv / a.f) - 1 AS q_b,
        power(ln(a.rv) - ln(b.f), 2) AS m_a, power(ln(a.rv) - ln(a.f), 2) AS m_b
        FROM f_window a JOIN f_com b ON a.symbol = b.symbol AND a.day = b.day WHERE a.rv > 0 AND a.f > 0 AND b.f > 0""",
    "fc": """SELECT symbol, day, r, sqrt(f) AS sigma, {q} * sqrt(f) AS q, {es} * sqrt(f) AS es FROM (
        SELECT symbol, day, r, CASE WHEN count(r2) OVER w = 30 THEN avg(r2) OVER w END AS f
        FROM pos WINDOW w AS (PARTITION BY symbol ORDER BY idx ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING)) WHERE f > 0 AND r IS NOT NULL""",
    "hits": "SELECT *, r < q AS hit FROM fc",
    "moves": """SELECT symbol, count(*) AS n, count(*) FILTER (NOT b AND NOT hit) AS n00, count(*) FILTER (NOT b AND hit) AS n01,
        count(*) FILTER (b AND NOT hit) AS n10, count(*) FILTER (b AND hit) AS n11
        FROM (SELECT symbol, hit, lag(hit) OVER (PARTITION BY symbol ORDER BY day) AS b FROM hits) GROUP BY symbol""",
    "sums": """SELECT day, CAST(count(*) FILTER (r < q) AS DOUBLE) AS s, sum(CASE WHEN r < q THEN r / es ELSE 0.0 END / {p} - 1) AS d, count(*) AS k
        FROM fc GROUP BY day""",
    "trades": """SELECT l_returnflag AS regime, l_linestatus = 'O' AND l_discount = 0 AS kill, l_extendedprice / l_quantity AS entry,
        l_extendedprice / l_quantity * (1 + l_tax - 0.04) AS exit, l_quantity AS size, l_extendedprice * (l_tax - CAST(0.04 AS DOUBLE)) AS gross,
        l_extendedprice * CAST(0.002 AS DOUBLE) AS cost, l_extendedprice * (l_tax - CAST(0.04 AS DOUBLE)) - l_extendedprice * CAST(0.002 AS DOUBLE) AS net,
        o_totalprice AS equity, CASE WHEN l_discount > 0.05 THEN 'timeout' ELSE 'barrier' END AS reason, CAST(l_shipdate AS DATE) AS day,
        l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_tax, l_discount
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_quantity > 0 AND o_totalprice > 0""",
    "real": "SELECT *, net / equity AS ret, size * entry AS notional FROM trades WHERE NOT kill AND regime IS NOT NULL",
    "totals": "SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, o_custkey AS customer, sum(o_totalprice) AS total FROM orders GROUP BY 1, 2",
    "members": """SELECT month, 'C' || customer AS symbol FROM (SELECT *, row_number() OVER (PARTITION BY month ORDER BY round(total, 2) DESC, customer) AS k FROM totals) WHERE k <= 20""",
}

NEEDS = {
    "changes": ["bars"], "day_sums": ["changes"], "rv": ["day_sums"], "rv_cal": ["rv"], "sparse_cal": ["sparse"], "sparse_ret": ["sparse_cal"],
    "daily_cal": ["daily"], "ret": ["daily_cal"], "valid": ["daily_cal"], "dvar": ["daily"], "dvar_cal": ["dvar"], "pos": ["dvar"],
    "f_window": ["pos"], "f_com": ["pos"], "losses": ["f_window", "f_com"], "fc": ["pos"], "hits": ["fc"], "moves": ["hits"], "sums": ["fc"],
    "real": ["trades"], "members": ["totals"],
}


def sql(body: str, *uses: str, **constants: float) -> str:
    """``body`` with the expressions that it uses, and what those use, in front."""
    order: list[str] = []

    def need(name: str) -> None:
        for other in NEEDS.get(name, []):
            need(other)
        if name not in order:
            order.append(name)

    for name in uses:
        need(name)
    for key, value in constants.items():
        body = body.replace("{" + key + "}", repr(value))
    parts = []
    for name in order:
        text = CTE[name]
        for key, value in constants.items():
            text = text.replace("{" + key + "}", repr(value))
        parts.append(f"{name} AS ({text})")
    return f"WITH {', '.join(parts)} {body}" if parts else body


def hac_sql(source: str, value: str, keys: str = "symbol", lags: int = 12) -> str:
    """(keys, n, lag, mean, variance, long_run) of a value, as a subquery."""
    products = ", ".join(f"e * lag(e, {k}) OVER w AS p{k}" for k in range(1, lags + 1))
    weighted = " + ".join(f"2 * greatest(0.0, 1 - {k} / (lag_n + 1.0)) * coalesce(sum(p{k}), 0.0)" for k in range(1, lags + 1))
    return f"""(SELECT {keys}, n, lag_n AS lag, m AS mean, sum(e * e) / n AS variance, (sum(e * e) + {weighted}) / n AS long_run FROM (
        SELECT *, {products} FROM (SELECT {keys}, day, n, m, x - m AS e, CAST(floor(4.0 * power(n / 100.0, 2.0 / 9.0)) AS INTEGER) AS lag_n FROM (
        SELECT {keys}, day, {value} AS x, count({value}) OVER (PARTITION BY {keys}) AS n, avg({value}) OVER (PARTITION BY {keys}) AS m FROM {source}) WHERE x IS NOT NULL)
        WINDOW w AS (PARTITION BY {keys} ORDER BY day)) GROUP BY {keys}, n, lag_n, m)"""


def ess_sql(source: str, value: str, keys: str, order: str, lags: int = 50) -> str:
    """(keys, n, n_eff) of a value in order, as a subquery."""
    lagged = ", ".join(f"lag(x, {k}) OVER w AS l{k}" for k in range(1, lags + 1))
    corr = " + ".join(f"coalesce(CASE WHEN NOT isnan(corr(x, l{k})) THEN corr(x, l{k}) END, 0.0)" for k in range(1, lags + 1))
    return f"""(SELECT {keys}, n, CASE WHEN den > 0 THEN n / den ELSE CAST(n AS DOUBLE) END AS n_eff FROM (
        SELECT {keys}, count(*) AS n, 1 + 2 * ({corr}) AS den FROM (SELECT {keys}, x, {lagged} FROM (
        SELECT {keys}, {order}, {value} AS x FROM {source} WHERE {value} IS NOT NULL) WINDOW w AS (PARTITION BY {keys} ORDER BY {order})) GROUP BY {keys}))"""


def normal_cdf_sql(x: str, nodes: int = 1000) -> str:
    """Phi of a column, by Simpson's rule from 0."""
    weight = f"CASE WHEN k IN (0, {nodes}) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END"
    return f"(0.5 + {x} / {3 * nodes} / sqrt(2 * pi()) * list_sum(list_transform(range(0, {nodes + 1}), lambda k: {weight} * exp(-0.5 * power({x} * k / {nodes}, 2)))))"


def mixture_sql(x: str, nodes: int = 2000) -> str:
    """exp(x * x / 2) * Phi(x) of a column: the integral of exp(x * t - t * t / 2) over t > 0, up to nine beyond its peak."""
    weight, width = f"CASE WHEN k IN (0, {nodes}) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END", f"((greatest({x}, 0.0) + 9) / {nodes})"
    t = f"(k * {width})"
    return f"({width} / 3 / sqrt(2 * pi()) * list_sum(list_transform(range(0, {nodes + 1}), lambda k: {weight} * exp({x} * {t} - {t} * {t} / 2))))"


def determinant(rows: list[list[str]]) -> str:
    """A determinant, expanded along the first row."""
    if len(rows) == 1:
        return rows[0][0]
    minors = [determinant([[*r[:j], *r[j + 1 :]] for r in rows[1:]]) for j in range(len(rows))]
    return "(" + " ".join(f"{'-' if j % 2 else '+'} {rows[0][j]} * {minor}" for j, minor in enumerate(minors)) + ")"


def har_sql(source: str, regressors: tuple[str, ...], complete: str, min_train: int = 365, every: int = 30) -> str:
    """(symbol, day, forecast) of the walk-forward log HAR, as a subquery; ``source`` has symbol, day, d (log variance) and
    x (a further regressor, null if none), ``complete`` says which rows take part.

    Least squares by Cramer's rule on centred running moments of the rows before each refit. The first refit may come late,
    when half of ``min_train`` rows take part.
    """
    names = (*regressors, "y")
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    before = "OVER (PARTITION BY symbol ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    sums = ", ".join([f"sum({a}) FILTER (ok) {before} AS s_{a}" for a in names] + [f"sum({a} * {b}) FILTER (ok) {before} AS s_{a}{b}" for a, b in pairs])
    centred = ", ".join(f"s_{a}{b} - s_{a} * s_{b} / n AS c_{a}{b}" for a, b in pairs)
    c = lambda a, b: f"c_{a}{b}" if (a, b) in pairs else f"c_{b}{a}"
    square = [[c(a, b) for b in regressors] for a in regressors]
    slopes = ", ".join(f"{determinant([[c(a, 'y') if b == r else c(a, b) for b in regressors] for a in regressors])} / {determinant(square)} AS b_{r}" for r in regressors)
    level = " - ".join(["s_y / n", *(f"b_{r} * s_{r} / n" for r in regressors)])
    rest = " - ".join(["c_yy", *(f"b_{r} * {c(r, 'y')}" for r in regressors)])
    fitted = " + ".join(["level", *(f"b_{r} * {r}" for r in regressors)])
    return f"""(WITH har_a AS (SELECT symbol, day, x, d - arg_min(d, day) FILTER (d IS NOT NULL) OVER (PARTITION BY symbol) AS d, arg_min(d, day) FILTER (d IS NOT NULL) OVER (PARTITION BY symbol) AS shift,
            row_number() OVER (PARTITION BY symbol ORDER BY day) - 1 AS t, count(*) OVER (PARTITION BY symbol) AS n_days FROM {source}),
        har_b AS (SELECT *, CASE WHEN count(d) OVER seven = 7 THEN avg(d) OVER seven END AS w, CASE WHEN count(d) OVER thirty = 30 THEN avg(d) OVER thirty END AS m, lead(d) OVER (PARTITION BY symbol ORDER BY t) AS y FROM har_a
            WINDOW seven AS (PARTITION BY symbol ORDER BY t ROWS 6 PRECEDING), thirty AS (PARTITION BY symbol ORDER BY t ROWS 29 PRECEDING)),
        har_c AS (SELECT *, {complete} AS whole, {complete} AND y IS NOT NULL AS ok FROM har_b),
        har_d AS (SELECT *, min(t) FILTER (ok) OVER (PARTITION BY symbol) + {min_train} AS start, count(*) FILTER (ok) {before} AS n, {sums} FROM har_c),
        har_r AS (SELECT *, n >= {min_train // 2} AND ((t - start) % {every} = 0 OR lag(n) OVER (PARTITION BY symbol ORDER BY t) < {min_train // 2}) AS refit FROM har_d WHERE t >= start AND t < n_days - 1),
        har_e AS (SELECT *, max(t) FILTER (refit) OVER (PARTITION BY symbol ORDER BY t) AS block, {centred} FROM har_r),
        har_f AS (SELECT *, {slopes} FROM har_e WHERE refit),
        har_g AS (SELECT symbol, block, {level} AS level, ({rest}) / (n - {len(names)}) AS s2, {', '.join(f'b_{r}' for r in regressors)} FROM har_f),
        har_h AS (SELECT e.symbol, e.t + 1 AS t, exp({fitted} + shift + s2 / 2) AS forecast FROM har_e e JOIN har_g g ON g.symbol = e.symbol AND g.block = e.block WHERE whole)
        SELECT a.symbol, a.day, forecast FROM har_a a LEFT JOIN har_h h ON h.symbol = a.symbol AND h.t = a.t)"""
