"""SQL twins of the derived inputs, as common table expressions for DuckDB."""

from __future__ import annotations

HOUR_US = 3_600_000_000


def r(expr: str, digits: int = 6) -> str:
    """Rounded, with values that round to zero made plain zero."""
    return f"CASE WHEN abs({expr}) < 0.5e-{digits} THEN 0.0 ELSE round({expr}, {digits}) END"


TICKS = """ticks AS MATERIALIZED (
  SELECT event_type AS symbol, ts, event_id, user_id,
    CAST(100000 + SUM(CAST(round(value * 100) AS BIGINT))
      OVER (PARTITION BY event_type ORDER BY ts, event_id) AS DOUBLE) / 100 AS price
  FROM events)"""


def bucket(minutes: int, ts: str = "ts") -> str:
    us = minutes * 60_000_000
    return f"make_timestamp((epoch_us({ts}) // {us}) * {us})"


def bars(minutes: int) -> str:
    return f"""bars AS MATERIALIZED (
  SELECT symbol, {bucket(minutes)} AS ts,
    arg_min(price, (ts, event_id)) AS open, max(price) AS high, min(price) AS low,
    arg_max(price, (ts, event_id)) AS close, CAST(count(*) AS DOUBLE) AS volume, avg(price) AS vwap
  FROM ticks GROUP BY ALL)"""


PAIRS = """pairs AS MATERIALIZED (
  SELECT a.symbol AS leg_1, b.symbol AS leg_2, a.ts AS ts, a.close AS y, b.close AS x,
    row_number() OVER (PARTITION BY a.symbol, b.symbol ORDER BY a.ts) AS pos
  FROM bars a JOIN bars b ON a.ts = b.ts AND a.symbol < b.symbol)"""

STATS = """stats AS MATERIALIZED (
  SELECT leg_1, leg_2, count(*) AS n, avg(y) AS mean_y, corr(y, x) AS corr, regr_slope(y, x) AS beta,
    regr_intercept(y, x) AS alpha
  FROM pairs GROUP BY ALL)"""

RESIDUALS = """resid AS MATERIALIZED (
  SELECT leg_1, leg_2, ts, pos, y, x, y - alpha - beta * x AS spread
  FROM pairs JOIN stats USING (leg_1, leg_2))"""


def kalman(deltas: list[float], r_noise: float = 1e-3, predict_first: bool = True, name: str = "kf") -> str:
    """The filter unrolled over the state (m0, m1, p00, p01, p10, p11) by recursion on the row."""
    grid = ", ".join(f"({d!r}::DOUBLE)" for d in deltas)

    def step(source: str, m0: str, m1: str, p: list[str], q: str, where: str) -> str:
        return f"""
  SELECT leg_1, leg_2, delta, ts, pos, y, x, m0 + a0 / s * e AS m0, m1 + a1 / s * e AS m1,
    p00 - a0 / s * h0 AS p00, p01 - a0 / s * h1 AS p01, p10 - a1 / s * h0 AS p10, p11 - a1 / s * h1 AS p11, e, s
  FROM (SELECT *, h0 + h1 * x + {r_noise!r}::DOUBLE AS s, y - (m0 + m1 * x) AS e
    FROM (SELECT *, p00 + p01 * x AS a0, p10 + p11 * x AS a1, p00 + x * p10 AS h0, p01 + x * p11 AS h1
      FROM (SELECT n.leg_1, n.leg_2, n.delta, n.ts, n.pos, n.y, n.x, {m0} AS m0, {m1} AS m1,
          {p[0]} + {q} AS p00, {p[1]} AS p01, {p[2]} AS p10, {p[3]} + {q} AS p11
        FROM {source} {where})))"""

    first_q = "n.delta" if predict_first else "0.0::DOUBLE"
    one = "1.0::DOUBLE"
    base = step(f"{name}_in n", "0.0::DOUBLE", "0.0::DOUBLE", [one] * 4, first_q, "WHERE n.pos = 1")
    more = step(
        f"{name}_rec k JOIN {name}_in n ON n.leg_1 = k.leg_1 AND n.leg_2 = k.leg_2 AND n.delta = k.delta AND n.pos = k.pos + 1",
        "k.m0",
        "k.m1",
        ["k.p00", "k.p01", "k.p10", "k.p11"],
        "n.delta",
        "",
    )
    return f"""{name}_in AS MATERIALIZED (SELECT leg_1, leg_2, ts, pos, y, x, delta FROM pairs, (VALUES {grid}) d(delta)),
{name}_rec AS ({base}
  UNION ALL {more}),
{name} AS MATERIALIZED (SELECT leg_1, leg_2, delta, ts, pos, y, x, m1 AS beta, m0 AS intercept, e AS error, s,
  sqrt(s) AS std_dev, e / sqrt(s) AS z_score, y - m1 * x AS spread FROM {name}_rec)"""


def rolling(source: str, keys: str, n: int = 30, name: str = "scored") -> str:
    frame = f"(PARTITION BY {keys} ORDER BY pos ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"""{name} AS MATERIALIZED (
  SELECT * EXCLUDE (_n, _m, _s), CASE WHEN _n >= {n} THEN (spread - _m) / nullif(_s, 0) END AS rolling_z
  FROM (SELECT *, count(spread) OVER {frame} AS _n, avg(spread) OVER {frame} AS _m,
      stddev_samp(spread) OVER {frame} AS _s FROM {source}))"""


def positions(
    source: str,
    z: str,
    thresholds: list[tuple[float, float]],
    rule: str,
    same_bar_reentry: bool,
    warmup: int = 0,
    name: str = "walk",
) -> str:
    """Position per (pair, delta, entry, exit) by recursion: side, entry spread, and what happened."""
    grid = ", ".join(f"({e!r}::DOUBLE, {x!r}::DOUBLE)" for e, x in thresholds)
    if rule == "signed":
        leaves = "((side = 1 AND z > -exit) OR (side = -1 AND z < exit))"
    else:
        leaves = "(side <> 0 AND abs(z) < exit)"
    may_enter = f"(side = 0 OR {leaves})" if same_bar_reentry else "side = 0"
    moved = f"""
  SELECT leg_1, leg_2, delta, entry, exit, ts, pos, z, spread,
    CAST(CASE WHEN enters THEN CASE WHEN z < 0 THEN 1 ELSE -1 END WHEN leaves THEN 0 ELSE side END AS INTEGER) AS side,
    CASE WHEN enters THEN spread ELSE entry_spread END AS entry_spread,
    leaves, enters, side AS side_before,
    CASE WHEN leaves THEN side * (spread - entry_spread) ELSE 0.0 END AS points
  FROM (SELECT *, coalesce({leaves}, false) AS leaves, coalesce({may_enter} AND (z < -entry OR z > entry), false) AS enters"""
    fields = "n.leg_1, n.leg_2, n.delta, n.entry, n.exit, n.ts, n.pos, n.z, n.spread"
    return f"""{name}_in AS MATERIALIZED (
  SELECT leg_1, leg_2, delta, entry, exit, ts, pos, CASE WHEN pos > {warmup} THEN {z} END AS z, spread
  FROM {source}, (VALUES {grid}) g(entry, exit)),
{name} AS ({moved}
    FROM (SELECT {fields}, 0 AS side, 0.0::DOUBLE AS entry_spread FROM {name}_in n WHERE n.pos = 1))
  UNION ALL {moved}
    FROM (SELECT {fields}, k.side AS side, k.entry_spread AS entry_spread
      FROM {name} k JOIN {name}_in n ON n.leg_1 = k.leg_1 AND n.leg_2 = k.leg_2 AND n.delta = k.delta
        AND n.entry = k.entry AND n.exit = k.exit AND n.pos = k.pos + 1)))"""


MAX_LAGS = 20  # enough for series of up to 771 rows


def _schur(name: str, rows: str, size: int) -> str:
    """Gram matrix of the columns of ``rows`` (keys, pos, i, v), then elimination column by
    column: at level k entry (size, size) is the squared residual on the first k columns."""
    return f"""{name} AS (
  SELECT 0 AS k, a.leg_1, a.leg_2, a.i, b.i AS j, sum(a.v * b.v) AS v FROM {rows} a JOIN {rows} b USING (leg_1, leg_2, pos) GROUP BY ALL
  UNION ALL
  SELECT a.k + 1, a.leg_1, a.leg_2, a.i, a.j, a.v - coalesce(b.v * c.v / nullif(p.v, 0), 0)
  FROM {name} a JOIN {name} b ON b.leg_1 = a.leg_1 AND b.leg_2 = a.leg_2 AND b.i = a.i AND b.j = a.k + 1
    JOIN {name} c ON c.leg_1 = a.leg_1 AND c.leg_2 = a.leg_2 AND c.j = a.j AND c.i = a.k + 1
    JOIN {name} p ON p.leg_1 = a.leg_1 AND p.leg_2 = a.leg_2 AND p.i = a.k + 1 AND p.j = a.k + 1
  WHERE a.i > a.k + 1 AND a.j > a.k + 1 AND a.k < {size - 1})"""


def adf(source: str, constant: bool, name: str = "adf") -> str:
    """Augmented Dickey-Fuller test of ``spread``: lag by AIC on the common sample, then the level's
    t-statistic on the chosen lag's own sample."""
    base = 2 if constant else 1
    one = "1.0::DOUBLE, " if constant else ""
    size = base + MAX_LAGS + 1
    lags = range(1, MAX_LAGS + 1)
    lagged = ", ".join(f"lag(d, {k}) OVER w AS d{k}" for k in lags)
    used = lambda limit: ", ".join(f"CASE WHEN {k} <= {limit} THEN d{k} ELSE 0.0 END" for k in lags)
    return f"""{name}_d AS MATERIALIZED (SELECT *, {lagged},
    least(CAST(ceil(12 * pow(n / 100.0::DOUBLE, 0.25)) AS BIGINT), n // 2 - {base}) AS top
  FROM (SELECT *, count(*) OVER (PARTITION BY leg_1, leg_2) AS n, lag(spread) OVER v AS level, spread - lag(spread) OVER v AS d
    FROM {source} WINDOW v AS (PARTITION BY leg_1, leg_2 ORDER BY pos)) WINDOW w AS (PARTITION BY leg_1, leg_2 ORDER BY pos)),
{name}_x AS MATERIALIZED (SELECT leg_1, leg_2, pos, unnest(x) AS v, generate_subscripts(x, 1) AS i
  FROM (SELECT leg_1, leg_2, pos, [{one}level, {used('top')}, d] AS x FROM {name}_d WHERE pos >= top + 2)),
{_schur(f'{name}_s', f'{name}_x', size)},
{name}_lag AS MATERIALIZED (SELECT leg_1, leg_2, n, arg_min(lag, (aic, lag)) AS used FROM (
    SELECT s.leg_1, s.leg_2, n, k - {base} AS lag, (n - 1 - top) * (ln(2 * pi() * s.v / (n - 1 - top)) + 1) + 2 * k AS aic
    FROM {name}_s s JOIN (SELECT DISTINCT leg_1, leg_2, n, top FROM {name}_d) USING (leg_1, leg_2)
    WHERE s.i = {size} AND s.j = {size} AND k >= {base} AND k - {base} <= top) GROUP BY ALL),
{name}_y AS MATERIALIZED (SELECT leg_1, leg_2, pos, unnest(x) AS v, generate_subscripts(x, 1) AS i
  FROM (SELECT leg_1, leg_2, pos, [{one}{used('used')}, level, d] AS x FROM {name}_d JOIN {name}_lag USING (leg_1, leg_2) WHERE pos >= used + 2)),
{_schur(f'{name}_t', f'{name}_y', size)},
{name} AS MATERIALIZED (SELECT leg_1, leg_2, used AS used_lag, n - 1 - used AS n_obs,
    ly / ll / sqrt((yy - ly * ly / ll) / (n - 1 - used - {base} - used) / ll) AS stat
  FROM (SELECT leg_1, leg_2, max(CASE WHEN i = {size - 1} AND j = {size - 1} THEN v END) AS ll,
      max(CASE WHEN i = {size - 1} AND j = {size} THEN v END) AS ly, max(CASE WHEN i = {size} AND j = {size} THEN v END) AS yy
    FROM {name}_t WHERE k = {size - 2} GROUP BY ALL) JOIN {name}_lag USING (leg_1, leg_2))"""


def p_value(stat: str, n_vars: int) -> str:
    """Response surface of the statistic, through the normal distribution function's series."""
    from tidepair.functions.unit_root import RESPONSE_SURFACE

    switch, low, high, below, above = RESPONSE_SURFACE[n_vars]
    poly = lambda c: " + ".join(f"{v!r}::DOUBLE * pow({stat}, {k})" for k, v in enumerate(c))
    z = f"(CASE WHEN {stat} <= {switch} THEN {poly(below)} ELSE {poly(above)} END)"
    # Phi(z) = 1/2 + phi(z) * sum of z^(2k+1) / (2k+1)!!
    terms = f"list_sum(list_transform(range(0, 120), lambda k: exp((2 * k + 1) * ln(abs({z}) + 1e-300) - (k + 1) * ln(2) - lgamma(k + 1.5) + ln(pi()) / 2)))"
    phi = f"(0.5 + sign({z}) * exp(-{z} * {z} / 2) / sqrt(2 * pi()) * {terms})"
    return f"(CASE WHEN {stat} > {high} THEN 1.0 WHEN {stat} < {low} THEN 0.0 ELSE {phi} END)"


def query(*ctes: str, body: str, recursive: bool = False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(ctes) + "\n" + body


def over_bars(body: str, minutes: int = 60, *more: str) -> str:
    return query(TICKS, bars(minutes), *more, body=body)


def over_pairs(body: str, minutes: int = 60, *more: str, recursive: bool = False) -> str:
    return query(TICKS, bars(minutes), PAIRS, *more, body=body, recursive=recursive)
