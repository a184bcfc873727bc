"""The checked queries once more, as SQL for DuckDB over the same tables."""

from __future__ import annotations

from latecast.plans.catalog import (
    CUSTOM_BINS, RELEASE, THIS_WEEK, TOTAL_BINS, WEEK_ZERO,
)
from latecast.plans.tables import AS_OF, FORMULA_DRAWS

# Fixed values, written out here so that a wrong constant in the code cannot agree with itself.
LIMITS = {"Median": 0.5, "LI": 0.025, "LS": 0.975, "LIb": 0.25, "LSb": 0.75}
REPORT_LIMITS = {
    "Median": 0.5, "Q1": 0.25, "Q3": 0.75, "IC80I": 0.1, "IC80S": 0.9,
    "IC90I": 0.05, "IC90S": 0.95, "LI": 0.025, "LS": 0.975,
}
SI_PNI = (0, 5, 12, 18, 30, 40, 50, 60, 70, 80, 90, 130)
TEN_YEARS = (0, 10, 20, 30, 40, 50, 60, 70, 80, 90, 130)
FIVE_YEARS = (0, 5, 10, 15, 20, 25, 30, 35, 40, 45, 50, 55, 60, 65, 70, 75, 80, 85, 90, 130)
EXTRACT_LIMITS = (0, 5, 12, 18, 30, 50, 60, 70, 80, 200)
EXTRACT_LABELS = (
    "0 - 4", "5 - 11", "12 - 17", "18 - 29", "30 - 49", "50 - 59", "60 - 69", "70 - 79", "80 +",
)
TOTAL_LABELS = {
    99: "Total", 1: "0 - 9", 2: "10 - 19", 3: "20 - 29", 4: "30 - 39", 5: "40 - 49",
    6: "50 - 59", 7: "60 - 69", 8: "70 - 79", 9: "80+",
}
ACCENTED, PLAIN = "ÁÂÉÊÍÔÓÚÇ", "AAEEIOOUC"
# Half widths of central 90 % and 50 % intervals of Student's t, by degrees of freedom.
T_90 = {1: 6.313751514675043, 2: 2.919985580355516, 3: 2.353363434801823, 4: 2.131846786326649}
T_50 = {1: 1.0, 2: 0.8164965809277260, 3: 0.7648923284043454, 4: 0.7406970841142744}

_LINES = """
ll AS (
  SELECT CAST(o_orderdate AS DATE) AS onset,
         CAST(o_orderdate AS DATE) + CAST(l_quantity AS INTEGER) AS report,
         CAST(l_partkey % 100 AS INTEGER) AS age, o_orderpriority AS series,
         l_partkey, l_suppkey, l_linenumber, l_returnflag, l_linestatus
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def _sunday(day: str) -> str:
    return f"({day} - CAST(dayofweek({day}) AS INTEGER))"


def _age_code(limits, age: str = "age") -> str:
    arms = " ".join(
        f"WHEN {age} >= {lo} AND {age} < {hi} THEN {i}"
        for i, (lo, hi) in enumerate(zip(limits, limits[1:]), start=1)
    )
    return f"CAST(CASE {arms} END AS INTEGER)"


def _weekly(
    *, as_of=None, series=False, limits=None, trim=0, k=0, epiweek=False, extra="", source="ll"
) -> str:
    """CTEs up to ``bw``: rows with onset week, report week, delay, after all filters."""
    view = f"WHERE report <= DATE '{as_of}'" if as_of else ""
    group = "series" if series else "'all'"
    code = _age_code(limits) if limits else "1"
    open_days = "w + 1" if epiweek else "CASE WHEN w = 6 THEN 7 ELSE 0 END"
    start = "0" if epiweek else "(w + 1) % 7"
    return f"""
v AS (SELECT {group} AS g, {code} AS age_class, onset, report, {extra or "series"} FROM {source} {view}),
sc AS (
  SELECT g, last_report + CAST({7 * (k - trim)} - ({open_days}) AS INTEGER) AS cutoff,
         {start} AS s
  FROM (SELECT g, max(report) AS last_report, CAST(dayofweek(max(report)) AS INTEGER) AS w
        FROM v GROUP BY g)),
bw AS (
  SELECT *, CAST((report_week - onset_week) // 7 AS INTEGER) AS delay
  FROM (SELECT v.*, onset - CAST((dayofweek(onset) - s + 7) % 7 AS INTEGER) AS onset_week,
               report - CAST((dayofweek(report) - s + 7) % 7 AS INTEGER) AS report_week
        FROM v JOIN sc USING (g) WHERE report <= cutoff AND age_class IS NOT NULL)
  WHERE report_week >= onset_week)"""


def _triangle(
    *, as_of=AS_OF, series=False, limits=None, k=0, epiweek=False, d_max=15, window=30
) -> str:
    """CTEs up to ``tri``: g, Time, dt_event, delay, age_class, last_time, Y."""
    weekly = _weekly(as_of=as_of, series=series, limits=limits, k=k, epiweek=epiweek)
    return f"""{_LINES}, {weekly},
wk AS (SELECT g, onset_week, delay, age_class, count(*) AS n FROM bw GROUP BY ALL),
tm AS (SELECT g, max(onset_week) AS tmax FROM wk GROUP BY g),
cells AS (SELECT wk.* FROM wk JOIN tm USING (g)
          WHERE onset_week >= tmax - {7 * window} AND delay <= {d_max}),
bd AS (SELECT g, min(onset_week) AS f, (max(onset_week) - min(onset_week)) // 7 + 1 AS last_time
       FROM cells GROUP BY g),
grid AS (
  SELECT g, f, last_time, t, d, age_class
  FROM (SELECT g, f, last_time, unnest(range(1, last_time + {k} + 1)) AS t FROM bd)
  JOIN (SELECT DISTINCT g, age_class FROM cells) USING (g),
       (SELECT unnest(range(0, {d_max + 1})) AS d)),
tri AS (
  SELECT grid.g, CAST(t AS INTEGER) AS "Time", f + CAST((t - 1) * 7 AS INTEGER) AS dt_event,
         CAST(d AS INTEGER) AS delay, grid.age_class, last_time,
         CASE WHEN t + d <= last_time THEN coalesce(n, 0) END AS "Y"
  FROM grid LEFT JOIN cells
    ON cells.g = grid.g AND cells.onset_week = f + CAST((t - 1) * 7 AS INTEGER)
   AND cells.delay = d AND cells.age_class = grid.age_class)"""


def _bigint(expression: str) -> str:
    return f"CAST({expression} AS BIGINT)"


def _weekly_rows(**options) -> str:
    age = ", age_class" if options.get("limits") else ""
    return f"""WITH {_LINES}, {_weekly(extra="series, age", **options)}
SELECT onset_week AS onset, report_week AS report, age, series{age}, delay AS "Delay" FROM bw"""


def _age_binning(limits) -> str:
    names = [f"'{lo} - {hi - 1}'" for lo, hi in zip(limits, limits[1:-1])] + [f"'{limits[-2]}+'"]
    return f"""WITH {_LINES}, {_weekly(limits=limits)}
SELECT age_class, count(*) AS n, ([{", ".join(names)}])[age_class] AS label
FROM bw GROUP BY age_class"""


def _quantiles(value: str, limits: dict[str, float], digits: int = 6) -> str:
    return ", ".join(
        f'round(quantile_cont({value}, {p}), {digits}) AS "{name}"' for name, p in limits.items()
    )


def _draws(*, age_limits=None, draws: int = FORMULA_DRAWS) -> str:
    """CTEs up to ``dr``: formula draws (g, [age_class], draw, Time, dt_event, Y)."""
    age = ', age_class' if age_limits else ""
    wobble = 'draw * 31 + "Time" * 17' + (" + age_class * 7" if age_limits else "")
    return f"""{_triangle(series=True, limits=age_limits)},
fu AS (SELECT g, min("Time") AS first_unknown FROM tri WHERE "Y" IS NULL GROUP BY g),
ob AS (SELECT g, "Time", dt_event{age}, {_bigint('coalesce(sum("Y"), 0)')} AS observed
       FROM tri JOIN fu USING (g) WHERE "Time" >= first_unknown GROUP BY g, "Time", dt_event{age}),
dr AS (SELECT g{age}, CAST(draw AS INTEGER) AS draw, "Time", dt_event,
              {_bigint(f"observed + ({wobble}) % 11")} AS "Y"
       FROM ob, (SELECT unnest(range(1, {draws + 1})) AS draw))"""


_TENS = TEN_YEARS

_ROUNDED_9Q = ", ".join(
    f'round_even(quantile_cont("Y", {p}), 0) AS "{name}"' for name, p in REPORT_LIMITS.items()
)
_FORMULA_REPORT = f"""rep AS (
  SELECT g, "Time", dt_event, {_ROUNDED_9Q} FROM dr GROUP BY g, "Time", dt_event)"""

# Weekly counts of all delays, gaps filled.
_REPORTED = """
obs AS (SELECT g, onset_week AS dt_event, count(*) AS n FROM bw GROUP BY g, onset_week),
full_obs AS (
  SELECT c.g, c.dt_event, coalesce(n, 0) AS n
  FROM (SELECT g, CAST(unnest(generate_series(min(dt_event), max(dt_event), INTERVAL 7 DAY)) AS DATE)
               AS dt_event FROM obs GROUP BY g) c
  LEFT JOIN obs ON obs.g = c.g AND obs.dt_event = c.dt_event)"""


def _rolling(value: str) -> str:
    frame = "(PARTITION BY g ORDER BY dt_event ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)"
    return (
        f"CASE WHEN count({value}) OVER {frame} = 3 "
        f"THEN round_even(avg({value}) OVER {frame}, 0) END AS rolling_average"
    )


def _report_table(rep: str = "rep") -> str:
    """CTE ``tab`` from ``full_obs`` and a summary."""
    names = ", ".join(f'{rep}."{n}"' for n in REPORT_LIMITS)
    return f"""
joined AS (
  SELECT k.g, k.dt_event, n, {names},
         coalesce("Median", CAST(n AS DOUBLE)) AS full_estimate,
         CASE WHEN k.dt_event <= last - 14 THEN CAST(n AS DOUBLE) END AS n_cut
  FROM (SELECT g, dt_event FROM full_obs UNION SELECT g, dt_event FROM {rep}) k
  LEFT JOIN full_obs ON full_obs.g = k.g AND full_obs.dt_event = k.dt_event
  LEFT JOIN (SELECT g, max(dt_event) AS last FROM full_obs GROUP BY g) l ON l.g = k.g
  LEFT JOIN {rep} ON {rep}.g = k.g AND {rep}.dt_event = k.dt_event),
tab AS (SELECT *, {_rolling("full_estimate")} FROM joined)"""


def _trend(name: str, points: str, keys: str, window: int, rolling: int = 0) -> str:
    """CTE ``name``: limits and score per (keys, end_week) from draws in ``points``."""
    span = 7 * (window - 1)
    return f"""
{name}_d AS (SELECT DISTINCT {keys}, dt_event FROM {points}),
{name}_b AS (SELECT {keys}, min(dt_event) AS first_day, max(dt_event) AS last_day
             FROM {name}_d GROUP BY {keys}),
{name}_w AS (
  SELECT {keys}, e.dt_event AS end_week,
         CASE WHEN EXISTS (SELECT 1 FROM {name}_d d WHERE d.dt_event = e.dt_event - {span}
                           AND {" AND ".join(f"d.{k} = e.{k}" for k in keys.split(", "))})
              THEN e.dt_event - {span} ELSE first_day END AS base_week
  FROM {name}_d e JOIN {name}_b USING ({keys}) WHERE e.dt_event >= last_day - {7 * rolling}),
{name}_s AS (
  SELECT {keys}, end_week, draw,
         max(CASE WHEN dt_event = base_week THEN y END) AS base, count(*) AS k,
         sum(x) AS x, sum(y) AS y, sum(x * x) AS x2, sum(y * y) AS y2, sum(x * y) AS xy
  FROM (SELECT {keys}, end_week, base_week, draw, dt_event, CAST("Y" AS DOUBLE) AS y,
               CAST(dt_event - base_week AS DOUBLE) AS x
        FROM {points} JOIN {name}_w USING ({keys})
        WHERE dt_event BETWEEN base_week AND end_week)
  GROUP BY {keys}, end_week, draw),
{name}_l AS (
  SELECT {keys}, end_week, k - 2 AS freedom, k * y2 - y * y AS syy,
         CASE WHEN base > 0 THEN base ELSE 1 END AS unit,
         nullif(k * x2 - x * x, 0) AS sxx, k * xy - x * y AS sxy
  FROM {name}_s)"""


def _score(low="LI", q1="Q1", q3="Q3", up="LS") -> str:
    return f"""CAST(CASE WHEN "{low}" > 0 THEN 1 WHEN "{low}" < 0 AND "{q1}" >= 0 THEN 0.5
  WHEN "{q1}" < 0 AND "{q3}" > 0 THEN 0 WHEN "{q3}" <= 0 AND "{up}" > 0 THEN -0.5
  WHEN "{up}" < 0 THEN -1 END AS DOUBLE)"""


def _trend_limits(name: str, keys: str) -> str:
    slope = "sxy / sxx / unit"
    return f"""
{name}_q AS (
  SELECT {keys}, end_week, count(*) AS draws,
         quantile_cont({slope}, 0.05) AS "LI", quantile_cont({slope}, 0.25) AS "Q1",
         quantile_cont({slope}, 0.75) AS "Q3", quantile_cont({slope}, 0.95) AS "LS"
  FROM {name}_l GROUP BY {keys}, end_week)"""


def _single_limits(name: str, window: int) -> str:
    """Confidence limits of one regression line; the full window fixes the degrees of freedom."""
    wide, narrow = T_90[window - 2], T_50[window - 2]
    return f"""
{name}_q AS (
  SELECT g, end_week, CAST(1 AS BIGINT) AS draws, slope - {wide!r} * e AS "LI",
         slope - {narrow!r} * e AS "Q1", slope + {narrow!r} * e AS "Q3", slope + {wide!r} * e AS "LS"
  FROM (SELECT g, end_week, sxy / sxx / unit AS slope,
               sqrt(greatest(syy - sxy * sxy / sxx, 0) / freedom / sxx) / unit AS e FROM {name}_l))"""


def _trend_output(name: str, series: str = "g AS series", digits: int = 9) -> str:
    limits = ", ".join(f'round("{c}", {digits}) + 0 AS "{c}"' for c in ("LI", "Q1", "Q3", "LS"))
    return f"SELECT {series}, end_week, draws, {limits}, {_score()} AS score FROM {name}_q"


def _snapshots(by_age: bool = False) -> str:
    """CTE ``snap``: cumulative counts per (data, dt_sin_pri[, age_class])."""
    event = f"{_sunday('onset')} + 3" if by_age else "onset"
    age = "age_class," if by_age else ""
    code = (
        "CASE WHEN l_linenumber = 7 THEN 'age_NA' ELSE 'age_' || (age // 10) END AS age_class,"
        if by_age else ""
    )
    part = "dt_sin_pri, age_class" if by_age else "dt_sin_pri"
    same = "AND new.age_class = listed.age_class" if by_age else ""
    return f"""{_LINES},
new AS (
  SELECT {age} dt_sin_pri, data, count(*) AS new_n
  FROM (SELECT {code} {event} AS dt_sin_pri,
               report + CAST((8 - dayofweek(report)) % 7 AS INTEGER) AS data FROM ll)
  GROUP BY ALL),
listed AS (
  SELECT {age} dt_sin_pri,
         CAST(unnest(generate_series(first_day, last_day, INTERVAL 7 DAY)) AS DATE) AS data
  FROM (SELECT {age} dt_sin_pri, min(data) AS first_day FROM new GROUP BY ALL),
       (SELECT max(data) AS last_day FROM new)),
snap AS (
  SELECT listed.*, CAST(sum(coalesce(new_n, 0)) OVER (
           PARTITION BY {', '.join('listed.' + p for p in part.split(', '))} ORDER BY listed.data
         ) AS BIGINT) AS n
  FROM listed LEFT JOIN new ON new.dt_sin_pri = listed.dt_sin_pri AND new.data = listed.data {same})"""


def _epi(day: str) -> str:
    midweek = f"({_sunday(day)} + 3)"
    return (
        f"CAST((dayofyear({midweek}) - 1) // 7 + 1 AS INTEGER) AS dt_event_ew, "
        f"CAST(year({midweek}) AS INTEGER) AS dt_event_ey"
    )


_STEPS = f"""
steps AS (
  SELECT dt_event, dt_release, n, CAST((dt_release - dt_event) // 7 AS INTEGER) AS delay
  FROM (SELECT {_sunday("data")} AS dt_release, dt_event, min(n) AS n
        FROM (SELECT data, {_sunday("dt_sin_pri")} AS dt_event, {_bigint("sum(n)")} AS n
              FROM seen GROUP BY ALL) GROUP BY ALL)),
inc AS (
  SELECT *, n - coalesce(lag(n) OVER (PARTITION BY dt_event ORDER BY delay), 0) AS "Y",
         lag(n) OVER (PARTITION BY dt_event ORDER BY delay) IS NULL AND delay > 0 AS left_truncated
  FROM steps)"""

_MERGE = """CASE WHEN count("Y") = count(*) THEN CAST(sum("Y") AS BIGINT) END"""


def _snapshot_triangle(d_max: int, window: int, k: int) -> str:
    return f"""WITH {_snapshots()},
seen AS (SELECT * FROM snap WHERE data <= DATE '{RELEASE}'), {_STEPS},
lim AS (SELECT greatest(min(dt_release), max(dt_release) - {7 * window}) AS f,
               max(dt_release) AS l FROM inc),
cal AS (SELECT f, l, CAST(unnest(generate_series(f, l + {7 * k}, INTERVAL 7 DAY)) AS DATE)
               AS dt_event FROM lim),
grid AS (SELECT * FROM cal, (SELECT unnest(range(0, {d_max + 1})) AS d)),
cell AS (
  SELECT grid.dt_event, CAST((grid.dt_event - f) // 7 + 1 AS INTEGER) AS "Time",
         CAST(greatest(d, 1) AS INTEGER) AS delay,
         CASE WHEN "Y" IS NULL AND (l - grid.dt_event) // 7 >= d THEN 0
              WHEN "Y" < 0 THEN 0 ELSE "Y" END AS "Y"
  FROM grid LEFT JOIN inc ON inc.dt_event = grid.dt_event AND inc.delay = d)
SELECT dt_event, "Time", delay, {_MERGE} AS "Y" FROM cell GROUP BY ALL"""


def _snapshot_full_weeks(d_max: int, *, window: int | None, k: int, by_age: bool) -> str:
    g = "age_class" if by_age else "'all'"
    seen = (
        "SELECT data, dt_sin_pri, n, CASE WHEN age_class = 'age_0' THEN 'age_1' ELSE age_class END "
        f"AS g FROM snap WHERE age_class <> 'age_NA' AND data <= DATE '{RELEASE}'"
        if by_age else f"SELECT data, dt_sin_pri, n, 'all' AS g FROM snap WHERE data <= DATE '{RELEASE}'"
    )
    first = "f" if window is None else f"greatest(f, l - {7 * window})"
    out = "g AS age_class, " if by_age else ""
    return f"""WITH {_snapshots(by_age)},
seen AS ({seen}),
steps AS (SELECT g, data, {_sunday("dt_sin_pri")} AS dt_event, {_bigint("sum(n)")} AS n
          FROM seen GROUP BY ALL),
inc AS (SELECT *, (data - dt_event) / 7 AS exact,
               n - coalesce(lag(n) OVER (PARTITION BY g, dt_event ORDER BY data), 0) AS y FROM steps),
lim AS (SELECT g, {first} AS f, l FROM
        (SELECT g, min({_sunday("data")}) AS f FROM inc GROUP BY g),
        (SELECT {_sunday("max(data)")} - 7 AS l FROM seen)),
grid AS (
  SELECT g, l, dt_event, d FROM
    (SELECT g, l, CAST(unnest(generate_series(f, l + {7 * k}, INTERVAL 7 DAY)) AS DATE) AS dt_event
     FROM lim WHERE f <= l), (SELECT unnest(range(1, {d_max + 1})) AS d)),
pile AS (
  SELECT inc.g, dt_event, CAST(floor(exact) AS INTEGER) AS delay, exact, 1 AS pri, y
  FROM inc JOIN lim USING (g) WHERE dt_event BETWEEN f AND l AND floor(exact) BETWEEN 0 AND {d_max}
  UNION ALL
  SELECT g, dt_event, CAST(d AS INTEGER), d,
         CASE WHEN dt_event + CAST(7 * d AS INTEGER) > l THEN 2 ELSE 3 END,
         CASE WHEN dt_event + CAST(7 * d AS INTEGER) > l THEN NULL ELSE 0 END
  FROM grid),
one AS (
  SELECT g, dt_event, greatest(delay, 1) AS delay,
         CASE WHEN y < 0 THEN 0 ELSE y END AS "Y"
  FROM pile QUALIFY row_number() OVER (PARTITION BY g, dt_event, delay ORDER BY pri, exact) = 1)
SELECT {out}dt_event, CAST((dt_event - f) // 7 + 1 AS INTEGER) AS "Time", delay, {_MERGE} AS "Y"
FROM one JOIN lim USING (g) GROUP BY g, f, dt_event, delay"""


def _wide_rows() -> str:
    return f"""WITH {_triangle(series=True)},
cut AS (SELECT tri.* FROM tri JOIN (SELECT g, max(dt_event) AS last FROM tri GROUP BY g) USING (g)
        WHERE dt_event >= last - 84 AND delay <= 10)"""


def _growth(key: str) -> str:
    """CTEs ``gw``, ``rc``: the discounted sums of every week from those of the week before."""
    slope = "(s0 * x1 - s1 * x0) / (s0 * (s2 + 1 / 0.0225::DOUBLE) - s1 * s1)"
    return f"""
gw AS (SELECT {key}, "Time", CASE WHEN share > 0 THEN (observed + share) / (1 + (observed + share) / 20)
                ELSE 0 END AS w, CASE WHEN share > 0 THEN ln(observed / share + 0.5::DOUBLE) ELSE 0 END AS x
       FROM wq),
rc AS (SELECT {key}, "Time", w AS s0, 0::DOUBLE AS s1, 0::DOUBLE AS s2, w * x AS x0, 0::DOUBLE AS x1
       FROM gw WHERE "Time" = 1
       UNION ALL
       SELECT gw.g, gw.age_class, gw."Time", s0 * 0.8::DOUBLE + w, (s1 - s0) * 0.8::DOUBLE,
              (s2 - 2 * s1 + s0) * 0.8::DOUBLE, x0 * 0.8::DOUBLE + w * x, (x1 - x0) * 0.8::DOUBLE
       FROM rc JOIN gw ON gw.g = rc.g AND gw.age_class = rc.age_class AND gw."Time" = rc."Time" + 1),
sl AS (SELECT {key}, "Time", CASE WHEN s0 > 0 THEN {slope} ELSE 0 END AS slope,
              CASE WHEN s0 > 0 THEN s0 / (s0 * (s2 + 1 / 0.0225::DOUBLE) - s1 * s1) ELSE 0.0225 END AS slope_var
       FROM rc),
wr AS (SELECT wq.*, slope, slope_var FROM wq JOIN sl USING ({key}, "Time")),"""


def _estimates(key: str, weeks: int) -> str:
    """CTEs ``ec``, ``es``: prior_cases and level_shape by moments, from ``hp`` and ``tri``."""
    return f"""
ea AS (SELECT sum(den * (num / den - an / ad) * (num / den - an / ad)) AS a,
              sum(an / ad * (1 - an / ad)) AS b, sum(an / ad * (1 - an / ad) * (den - 1)) AS c
       FROM hp WHERE delay > 0 AND den > 1 AND an > 0 AND an < ad),
ec AS (SELECT CASE WHEN (a - b) / c > 0 THEN greatest(1, least(1000, 1 / ((a - b) / c) - 1)) ELSE 1000 END
         AS prior_cases FROM ea),
ew AS (SELECT {key}, "Time", coalesce(sum("Y"), 0) AS y, bool_or("Y" IS NULL) AS open_ FROM tri GROUP BY ALL),
em AS (SELECT *, avg(y) OVER b AS m, count(*) OVER b AS n FROM ew
       WINDOW b AS (PARTITION BY {key} ORDER BY "Time" ROWS BETWEEN {weeks + 1} PRECEDING AND 1 PRECEDING)),
es AS (SELECT CASE WHEN sum((y - m) * (y - m) - m - m / {weeks + 1}) > 0
                   THEN greatest(0.5, least(500, sum(m * m) / sum((y - m) * (y - m) - m - m / {weeks + 1})))
                   ELSE 500 END AS level_shape FROM em WHERE NOT open_ AND n = {weeks + 1}),"""


def _fit(*, weeks: int = 2, shape: float | str = 5.0, trend: bool = False, estimated: bool = False, zeros: bool = False) -> str:
    """CTEs from ``tri`` to ``est``: g, age_class, Time, dt_event, unfinished, observed, level,
    remaining, shape; and ``sh`` with the shares."""
    key = "g, age_class"
    prior, moments = "10", ""
    if estimated:
        prior, moments = "(SELECT prior_cases FROM ec)", _estimates(key, weeks)
        shape = "(SELECT level_shape FROM es)"
    ahead = (f'greatest(0, "Time" - max("Time") FILTER (WHERE known IS NOT NULL) OVER (PARTITION BY {key}))')
    if trend:
        shares = " + ".join(
            f"coalesce(lag(share, {j}) OVER p, 0) * exp(slope * -{j})" for j in range(1, weeks + 1))
        cases = " + ".join(f"coalesce(lag(observed, {j}) OVER p, 0)" for j in range(1, weeks + 1))
        levels = f"""{_growth(key)}
wm AS (SELECT *, CASE WHEN known IS NOT NULL THEN
               (observed + {cases} + 0.05::DOUBLE) / (share + {shares} + 0.1::DOUBLE) END AS mean,
              {ahead} AS ahead
       FROM wr WINDOW p AS (PARTITION BY {key} ORDER BY "Time")),
wp0 AS (SELECT * REPLACE (last_value(CASE WHEN known IS NOT NULL THEN slope END IGNORE NULLS) OVER p AS slope,
               last_value(CASE WHEN known IS NOT NULL THEN slope_var END IGNORE NULLS) OVER p AS slope_var),
              0.9::DOUBLE * (1 - pow(0.9::DOUBLE, ahead)) / (1 - 0.9::DOUBLE) AS onward,
              last_value(mean IGNORE NULLS) OVER p AS last_mean
        FROM wm WINDOW p AS (PARTITION BY {key} ORDER BY "Time")),
wp1 AS (SELECT *, last_mean * exp(slope * onward) AS prior FROM wp0),"""
        slope_part = " + onward * onward * slope_var"
    else:
        levels = f"""
wm AS (SELECT *, CASE WHEN known IS NOT NULL THEN
               (sum(observed) OVER n + 0.05::DOUBLE) / (sum(share) OVER n + 0.1::DOUBLE) END AS mean,
              {ahead} AS ahead
       FROM wq WINDOW n AS (PARTITION BY {key} ORDER BY "Time" ROWS BETWEEN {weeks} PRECEDING AND CURRENT ROW)),
wp1 AS (SELECT *, last_value(mean IGNORE NULLS) OVER (PARTITION BY {key} ORDER BY "Time") AS prior, 0 AS slope
        FROM wm),"""
        slope_part = ""
    if zeros:
        levels += f"""
zl AS (SELECT {key}, count(*) FILTER (WHERE share > 0) AS n,
              list(prior * share ORDER BY prior * share) FILTER (WHERE share > 0 AND observed = 0) AS ms
       FROM wp1 GROUP BY {key}),
zo AS (SELECT {key}, CASE WHEN ms IS NULL THEN 0 ELSE list_reduce(range(1, 41), lambda o, i: least(
                0.95::DOUBLE, list_sum(list_transform(ms, lambda m: o / (o + (1 - o)
                  * pow({shape} / ({shape} + m / (1 - o)), {shape})))) / n), 0.5::DOUBLE) END AS off
       FROM zl),
wp AS (SELECT *, CASE WHEN observed = 0 AND off > 0 THEN
                off / (off + (1 - off) * pow({shape} / ({shape} + share * prior), {shape})) ELSE 0 END AS zero_chance
       FROM (SELECT wp1.* REPLACE (prior / (1 - off) AS prior), off FROM wp1 JOIN zo USING ({key}))),"""
    else:
        levels += "\nwp AS (SELECT *, 0 AS zero_chance FROM wp1),"
    return f"""
hz AS (SELECT {key}, delay, coalesce(sum("Y"), 0) AS num, coalesce(sum(so_far), 0) AS den
       FROM (SELECT *, CASE WHEN "Y" IS NOT NULL THEN sum("Y") OVER (
               PARTITION BY {key}, "Time" ORDER BY delay) END AS so_far FROM tri) GROUP BY {key}, delay),
hp AS (SELECT *, sum(num) OVER (PARTITION BY g, delay) AS an, sum(den) OVER (PARTITION BY g, delay) AS ad
       FROM hz),
{moments}
hd AS (SELECT {key}, delay, (num + {prior} * CASE WHEN ad > 0 THEN an / ad ELSE 0 END) / (den + {prior}) AS hazard,
              den + {prior} AS seen FROM hp),
sb AS (SELECT {key}, delay, coalesce(product(1 - hazard) OVER later, 1) AS upto,
              coalesce(sum(CASE WHEN hazard < 1 THEN hazard / (1 - hazard) / seen ELSE 0 END) OVER later, 0)
                AS loose
       FROM hd WINDOW later AS (PARTITION BY {key} ORDER BY delay
                                ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
sa_ AS (SELECT *, upto - coalesce(lag(upto) OVER (PARTITION BY {key} ORDER BY delay), 0) AS part FROM sb),
sh AS (SELECT *, sum(part * part) OVER (PARTITION BY {key} ORDER BY delay) AS seen_sq,
              coalesce(sum(part * part) OVER (PARTITION BY {key} ORDER BY delay
                ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) AS left_sq,
              sum(part * part) OVER (PARTITION BY {key}) AS all_sq FROM sa_),
wk_ AS (SELECT {key}, "Time", dt_event, coalesce(sum("Y"), 0)::BIGINT AS observed,
               max(delay) FILTER (WHERE "Y" IS NOT NULL) AS known, bool_or("Y" IS NULL) AS unfinished
        FROM tri GROUP BY {key}, "Time", dt_event),
wq AS (SELECT w.*, coalesce(upto, 0) AS share, coalesce(seen_sq, 0) AS seen_sq, coalesce(loose, 0) AS loose,
              coalesce(left_sq, (SELECT max(all_sq) FROM sh z WHERE z.g = w.g AND z.age_class = w.age_class))
                AS left_sq
       FROM wk_ w LEFT JOIN sh s ON s.g = w.g AND s.age_class = w.age_class AND s.delay = w.known),{levels}
re AS (SELECT t.g, t.age_class, t."Y",
              CASE WHEN w.share > 0 THEN w.observed * s.part / w.share ELSE 0 END AS mu
       FROM tri t JOIN wp w USING (g, age_class, "Time")
       JOIN sh s ON s.g = t.g AND s.age_class = t.age_class AND s.delay = t.delay WHERE t."Y" IS NOT NULL),
sp AS (SELECT {key}, CASE WHEN sum(mu * mu) > 0 THEN greatest(0, sum((t."Y" - mu) * (t."Y" - mu) - mu)
                / sum(mu * mu)) ELSE 0 END AS spread FROM re t GROUP BY {key}),
wl AS (SELECT w.*, spread, share * prior AS own,
              CASE WHEN share > 0 THEN seen_sq / share / share ELSE 0 END AS c_seen,
              CASE WHEN share < 1 THEN left_sq / (1 - share) / (1 - share) ELSE 0 END AS c_left,
              CASE WHEN share > 0 AND share < 1 THEN loose / (1 - share) / (1 - share) ELSE 0 END AS v_delay
       FROM wp w JOIN sp USING (g, age_class)),
wv AS (SELECT *, own / (1 + spread * own * c_seen) AS weight,
              observed / (1 + spread * observed * c_seen) AS certain FROM wl),
lv AS (SELECT *, CASE WHEN share > 0 THEN ({shape} * prior + weight * observed / share) / ({shape} + weight)
              ELSE prior END AS level FROM wv),
va AS (SELECT *, level * (1 - share) AS remaining, 1 / ({shape} / (1 + ahead) + certain){slope_part} AS v_level FROM lv),
est AS (SELECT {key}, "Time", dt_event, unfinished, observed, level, remaining, ahead, slope, zero_chance, {weeks} AS near,
               1 / (v_level + spread * c_left + v_delay) AS shape,
               CASE WHEN remaining > 0 THEN v_level / (v_level + spread * c_left + v_delay + 1 / remaining)
               ELSE 0 END AS p_level,
               CASE WHEN remaining > 0 THEN v_delay / (v_level + spread * c_left + v_delay + 1 / remaining)
               ELSE 0 END AS p_delay FROM va)"""


def _gauss(text: str) -> str:
    """A normal score from the digest of a text."""
    half = lambda at: f"CAST('0x' || substr(md5({text}), {at}, 13) AS BIGINT)"
    size = "4503599627370496.0::DOUBLE"
    return f"sqrt(-2 * ln(({half(1)} + 1) / {size})) * cos({half(14)} / {size} * (2 * pi()))"


def _moving(keys: str) -> str:
    text = f"concat_ws('|', '1', 'level', {keys}, w, draw)"
    weeks = 'range("Time" - ahead - near, "Time" + 1)'
    return f"list_sum(list_transform({weeks}, lambda w: {_gauss(text)})) / sqrt(ahead + near + 1)"


def _draw(names: str, *, series: str | None = None, draws: int = 1000) -> str:
    """CTEs from ``est`` to ``dr``: g, age_class, draw, Time, dt_event, Y. ``names`` are the keys as text,
    ``series`` those of the series if there are age classes too."""
    levels = _moving(names) if series is None else (
        f"sqrt(0.5) * {_moving(names)} + sqrt(0.5) * {_moving(series)}")
    own = _gauss(f"""concat_ws('|', '1', {names}, op."Time", draw)""")
    delays = _gauss(f"concat_ws('|', '1', 'delay', {series or names}, draw)")
    key = 'g, age_class, "Time"'
    return f"""
op AS (SELECT e.* FROM est e JOIN (SELECT g, age_class, min("Time") AS first FROM est WHERE unfinished
         GROUP BY g, age_class) USING (g, age_class) WHERE "Time" >= first),
di AS (SELECT *, greatest(1, floor(sd / 16)) AS step, greatest(0, floor(remaining - 10 * sd)) AS low
       FROM (SELECT *, sqrt(remaining + remaining * remaining / shape) AS sd FROM op
             WHERE remaining > 0 AND unfinished)),
gr AS (SELECT {key}, remaining AS mu, shape AS r, step, low,
              unnest(range(CAST(ceil((remaining + 20 * sd - low) / step) + 20 AS BIGINT))) AS i FROM di),
ga AS (SELECT *, low + i * step + (step - 1) / 2 AS x FROM gr),
ch AS (SELECT *, exp(lgamma(x + r) - lgamma(r) - lgamma(x + 1) + r * ln(r / (r + mu))
                     + x * ln(mu / (r + mu))) * step AS p FROM ga),
cu AS (SELECT *, sum(p) OVER (PARTITION BY {key} ORDER BY i) AS s FROM ch),
ls AS (SELECT {key}, any_value(low) AS low, any_value(step) AS step, list(s ORDER BY i) AS sums
       FROM cu GROUP BY {key}),
sc_ AS (SELECT op.g, op.age_class, op."Time", op.dt_event, observed, zero_chance, draw,
               ({own}) * sqrt(greatest(0, 1 - p_level - p_delay))
                 + (({levels}) * sqrt(p_level) + ({delays}) * sqrt(p_delay)) AS z
        FROM op, (SELECT CAST(unnest(range(1, {draws + 1})) AS INTEGER) AS draw)),
tl AS (SELECT *, 1 / (1 + 0.2316419::DOUBLE * abs(z)) AS t FROM sc_),
nc AS (SELECT *, t * (0.319381530::DOUBLE + t * (-0.356563782::DOUBLE + t * (1.781477937::DOUBLE
                 + t * (-1.821255978::DOUBLE + t * 1.330274429::DOUBLE)))) * 0.3989422804014327::DOUBLE
                 * exp(-z * z / 2) AS tail FROM tl),
dw AS (SELECT nc.*, low, step, sums,
              (CASE WHEN z < 0 THEN tail ELSE 1 - tail END - zero_chance) / (1 - zero_chance) * sums[-1] AS u
       FROM nc LEFT JOIN ls ON ls.g = nc.g AND ls.age_class = nc.age_class AND ls."Time" = nc."Time"),
pl AS (SELECT *, len(list_filter(sums, lambda z: z <= u)) AS place FROM dw),
dr AS (SELECT g, age_class, draw, "Time", dt_event,
              observed + CASE WHEN sums IS NULL OR u < 0 THEN 0 ELSE CAST(low + place * step + floor(
                (u - CASE WHEN place = 0 THEN 0 ELSE sums[place] END)
                / (sums[place + 1] - CASE WHEN place = 0 THEN 0 ELSE sums[place] END) * step) AS BIGINT)
              END AS "Y" FROM pl)"""



def _labels(limits) -> str:
    names = [f"'{lo} - {hi - 1}'" for lo, hi in zip(limits, limits[1:-1])] + [f"'{limits[-2]}+'"]
    return f"([{', '.join(names)}])[age_class] AS age_label"


def _score_sql() -> dict[str, str]:
    """Ten as-of days in one query: the day is part of the series' name."""
    lines = f"""{_LINES.replace("ll AS (", "l0 AS (")},
ao AS (SELECT DATE '{AS_OF}' - CAST(14 * i AS INTEGER) AS a FROM range(10) t(i)),
ll AS (SELECT l0.* REPLACE (series || '/' || a AS series) FROM l0 JOIN ao ON report <= a)"""
    head = _triangle(as_of=None, series=True).replace(_LINES, lines)
    keys = "split_part(op.g, '/', 1), split_part(op.g, '/', 2)"
    low = {name: f"quantile_cont(\"Y\", {p})" for name, p in LIMITS.items()}
    missed = lambda a, b: f"greatest(0, {a} - later) + greatest(0, later - {b})"
    scored = f"""
pd AS (SELECT series, onset, count(*) AS n FROM l0 GROUP BY ALL),
qs AS (SELECT g, dt_event, list_sort(list("Y")) AS ys, {', '.join(f'{e} AS "{n}"' for n, e in low.items())}
       FROM dr GROUP BY g, dt_event),
tr AS (SELECT qs.g, qs.dt_event, coalesce(sum(n), 0)::BIGINT AS later
       FROM qs LEFT JOIN pd ON pd.series = split_part(qs.g, '/', 1)
        AND pd.onset BETWEEN qs.dt_event AND qs.dt_event + 6 GROUP BY ALL),
so AS (SELECT split_part(g, '/', 1) AS series, CAST(split_part(g, '/', 2) AS DATE) AS as_of, dt_event,
              CAST((max(dt_event) OVER (PARTITION BY g) - dt_event) // 7 AS INTEGER) AS back, later,
              list_sum(list_transform(ys, lambda x: abs(x - later)))::BIGINT / len(ys)
                - list_sum(list_transform(range(1, len(ys) + 1), lambda i: (2 * i - len(ys) - 1) * ys[i]))::BIGINT
                  / (len(ys) * len(ys)) AS crps,
              "LS" - "LI" + ({missed('"LI"', '"LS"')}) * (2 / (1 - 0.95::DOUBLE)) AS interval_95,
              "LSb" - "LIb" + ({missed('"LIb"', '"LSb"')}) * (2 / (1 - 0.5::DOUBLE)) AS interval_50,
              later BETWEEN "LI" AND "LS" AS covered_95, later BETWEEN "LIb" AND "LSb" AS covered_50
       FROM qs JOIN tr USING (g, dt_event))"""
    level = f"{head}, {_fit()}, {_draw(keys)}, {scored}"
    trend = f"{head}, {_fit(trend=True)}, {_draw(keys)}, {scored}"
    rounded = ", ".join(f"round({c}, 6) AS {c}" for c in ("crps", "interval_95", "interval_50"))
    means = ", ".join(
        [f"round(avg({c}), 6) AS {c}" for c in ("crps", "interval_95", "interval_50")]
        + [f"round(avg({c}::INTEGER), 6) AS {c}" for c in ("covered_95", "covered_50")])
    both = lambda by: " UNION ALL ".join(
        f"(WITH RECURSIVE {sql} SELECT '{name}' AS setting, {by}, count(*) AS weeks, {means} FROM so GROUP BY {by})"
        for name, sql in (("level", level), ("trend", trend)))
    return {
        "score_weeks": f"WITH {level} SELECT series, as_of, 'default' AS setting, dt_event, back, later, {rounded}, "
                       "covered_95, covered_50 FROM so",
        "score_by_as_of": both("as_of"), "score_by_age_of_week": both("back"),
    }


def _nowcasts(nations: str) -> dict[str, str]:
    five = _quantiles('"Y"', LIMITS)
    tens, fives = TEN_YEARS, FIVE_YEARS
    week = '"Time", dt_event'
    one = f"{_triangle()}, {_fit()}, {_draw('NULL')}"
    each = f"{_triangle(series=True)}, {_fit()}, {_draw('op.g')}"
    aged = f"{_triangle(limits=tens)}, {_fit()}, {_draw('op.age_class', series='NULL')}"
    q = {"nowcast_total": f"WITH {one} SELECT {week}, {five} FROM dr GROUP BY {week}"}
    q["nowcast_by_series"] = f"WITH {each} SELECT g AS series, {week}, {five} FROM dr GROUP BY g, {week}"
    q["nowcast_pruned"] = q["nowcast_by_series"]
    q["forecast_k"] = (
        f"WITH {_triangle(series=True, k=2)}, {_fit()}, {_draw('op.g')} "
        f"SELECT g AS series, {week}, {five} FROM dr GROUP BY g, {week}"
    )
    q["nowcast_long_level"] = (
        f"WITH {_triangle(series=True)}, {_fit(weeks=8, shape=2.0)}, {_draw('op.g', draws=200)} "
        f"SELECT g AS series, {week}, {five} FROM dr GROUP BY g, {week}"
    )
    rising = f"WITH RECURSIVE {_triangle(series=True, k=3)}, {_fit(trend=True)}"
    q["forecast_trend"] = (
        f"{rising}, {_draw('op.g')} SELECT g AS series, {week}, {five} FROM dr GROUP BY g, {week}"
    )
    q["growth_table"] = f"""{rising}
SELECT g AS series, 'delay' AS term, delay AS index, round(part, 6) AS value FROM sh
UNION ALL SELECT g, 'time', "Time", round(level, 6) FROM est
UNION ALL SELECT g, 'slope', "Time", round(slope, 6) FROM est"""
    q["nowcast_estimated_priors"] = (
        f"WITH {_triangle(series=True, limits=tens)}, {_fit(estimated=True)}, "
        f"{_draw('op.g, op.age_class', series='op.g')} "
        f"SELECT g AS series, age_class, {_labels(tens)}, {week}, {five} FROM dr GROUP BY g, age_class, {week}"
    )
    q["nowcast_zero_inflated"] = (
        f"WITH {_triangle(series=True, limits=fives)}, {_fit(zeros=True)}, "
        f"{_draw('op.g, op.age_class', series='op.g')} "
        f"SELECT g AS series, age_class, {_labels(fives)}, {week}, {five} FROM dr GROUP BY g, age_class, {week}"
    )
    q["zero_shares"] = f"""WITH {_triangle(series=True, limits=fives)}, {_fit(zeros=True)}
SELECT g AS series, age_class, round(off, 6) AS off FROM zo"""
    q["estimated_priors"] = f"""WITH {_triangle(series=True, limits=tens)}, {_fit(estimated=True)}
SELECT round(prior_cases, 6) AS prior_cases, round(level_shape, 6) AS level_shape FROM ec, es"""
    q |= _score_sql()
    label = _labels
    q["nowcast_by_age"] = (
        f"WITH {aged} SELECT age_class, {label(tens)}, {week}, {five} FROM dr GROUP BY age_class, {week}"
    )
    q["trajectories"] = f'WITH {each} SELECT g AS series, draw, {week}, "Y" FROM dr'
    q["trajectories_by_age"] = (
        f'WITH {aged} SELECT age_class, {label(tens)}, draw, {week}, "Y" FROM dr'
    )
    blank = f"{_triangle(series=True, limits=fives)}, {_fit()}, {_draw('op.g, op.age_class', series='op.g')}"
    q["nowcast_blank_strata"] = f"""WITH {blank},
seen AS (SELECT g, age_class, coalesce(sum("Y"), 0) AS total FROM tri GROUP BY ALL),
zb AS (SELECT g, age_class, {week}, CASE WHEN total = 0 THEN 0 ELSE "Y" END AS "Y"
       FROM dr JOIN seen USING (g, age_class))
SELECT g AS series, age_class, {label(fives)}, {week}, {five} FROM zb GROUP BY g, age_class, {week}"""
    many = f"{_triangle(series=True).replace(_LINES, nations)}, {_fit()}, " + _draw(
        "split_part(op.g, '/', 1), split_part(op.g, '/', 2)")
    q["nowcast_many_series"] = (
        f"WITH {many} SELECT split_part(g, '/', 1) AS nation, split_part(g, '/', 2) AS series, {week}, "
        f"{five} FROM dr GROUP BY g, {week}"
    )
    three = _quantiles("total", {"Median": 0.5, "LI": 0.025, "LS": 0.975})
    q["nowcast_window_total"] = f"""WITH {each},
tt AS (SELECT g, draw, CAST(sum("Y") AS BIGINT) AS total FROM dr GROUP BY g, draw)
SELECT g AS series, {three} FROM tt GROUP BY g"""
    q["fit_table"] = f"""WITH {_triangle(series=True)}, {_fit()}
SELECT g AS series, 'delay' AS term, delay AS index, round(part, 6) AS value FROM sh
UNION ALL SELECT g, 'time', "Time", round(level, 6) FROM est"""
    q["nowcast_trend"] = (
        f"WITH {each}, {_trend('t', 'dr', 'g', 3)}, {_trend_limits('t', 'g')} " + _trend_output("t")
    )
    return q


def _situation_forecast(sql: str) -> str:
    """The report's SQL over draws that go on for two weeks."""
    ahead = """
dr AS (SELECT * FROM dr0 UNION ALL
       SELECT d.g, d.draw, d."Time" + 2, d.dt_event + 14, d."Y"
       FROM dr0 d JOIN (SELECT g, max(dt_event) AS last FROM dr0 GROUP BY g) USING (g)
       WHERE d.dt_event > last - 14),
rep AS ("""
    return sql.replace("\ndr AS (", "\ndr0 AS (", 1).replace("rep AS (", ahead.lstrip("\n"), 1)


def oracle_sql() -> dict[str, str]:
    presets = {"SI-PNI": SI_PNI, "10 years": TEN_YEARS, "5 years": FIVE_YEARS}
    weekly_obs = _weekly(as_of=AS_OF, series=True)
    tri = 'dt_event, "Time", delay'
    trend_keys = "g"
    q: dict[str, str] = {}

    q["weekly_line_list"] = _weekly_rows(limits=presets["SI-PNI"])
    q["weekly_line_list_epiweek"] = _weekly_rows(series=True, epiweek=True)
    q["weekly_line_list_trim_k"] = _weekly_rows(
        series=True, limits=presets["SI-PNI"], trim=9, k=1
    )
    q["age_binning_si_pni"] = _age_binning(presets["SI-PNI"])
    q["age_binning_10y"] = _age_binning(presets["10 years"])
    q["age_binning_5y"] = _age_binning(presets["5 years"])
    q["age_binning_custom"] = _age_binning(CUSTOM_BINS)

    q["delay_triangle"] = f'WITH {_triangle()} SELECT {tri}, "Y" FROM tri'
    q["delay_triangle_by_age"] = (
        f'WITH {_triangle(limits=_TENS)} SELECT {tri}, age_class, "Y" FROM tri'
    )
    q["delay_triangle_by_series"] = (
        f'WITH {_triangle(series=True)} SELECT g AS series, {tri}, "Y" FROM tri'
    )
    q["delay_triangle_epiweek"] = (
        f"WITH {_triangle(series=True, limits=_TENS, epiweek=True)} "
        f'SELECT g AS series, {tri}, age_class, "Y" FROM tri'
    )
    q["delay_triangle_forecast_k"] = (
        f'WITH {_triangle(series=True, k=2)} SELECT g AS series, {tri}, "Y" FROM tri'
    )
    nations = f"""{_LINES.replace(
        "FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
        "FROM lineitem JOIN orders ON l_orderkey = o_orderkey "
        "JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey",
    ).replace("o_orderpriority AS series", "n_name || '/' || o_orderpriority AS series")}"""
    q["delay_triangle_many_series"] = (
        f"WITH {_triangle(series=True).replace(_LINES, nations)} SELECT split_part(g, '/', 1) AS "
        f"nation, split_part(g, '/', 2) AS series, {tri}, \"Y\" FROM tri"
    )
    columns = ", ".join(f'max("Y") FILTER (delay = {d}) AS d{d}' for d in range(11))
    q["triangle_wide"] = f"{_wide_rows()} SELECT g AS series, dt_event, {columns} FROM cut GROUP BY ALL"
    q["triangle_long"] = f'{_wide_rows()} SELECT g AS series, dt_event, delay, "Y" FROM cut'
    q["integer_week_triangle"] = f"""WITH {_LINES},
r AS (SELECT series, CAST(({_sunday("onset")} - DATE '{WEEK_ZERO}') // 7 AS INTEGER) AS week,
             CAST(({_sunday("report")} - {_sunday("onset")}) // 7 AS INTEGER) AS late FROM ll),
c AS (SELECT series, week, late, count(*) AS n FROM r
      WHERE week BETWEEN {THIS_WEEK - 39} AND {THIS_WEEK} AND late BETWEEN 0 AND 10 GROUP BY ALL),
grid AS (SELECT series, CAST(w AS INTEGER) AS w, CAST(d AS INTEGER) AS d
         FROM (SELECT DISTINCT series FROM c),
              (SELECT unnest(range({THIS_WEEK - 39}, {THIS_WEEK + 1})) AS w),
              (SELECT unnest(range(0, 11)) AS d))
SELECT grid.series, w AS "Date", CAST(w - {THIS_WEEK - 40} AS INTEGER) AS "Time", d AS delay,
       (w - {THIS_WEEK - 40}) || ' ' || d AS cell,
       CASE WHEN w + d <= {THIS_WEEK} THEN coalesce(n, 0) END AS "Y"
FROM grid LEFT JOIN c ON c.series = grid.series AND week = w AND late = d"""

    known = f"""fu AS (SELECT g, min("Time") AS first_unknown FROM tri WHERE "Y" IS NULL GROUP BY g),
ob AS (SELECT g, "Time", dt_event, {_bigint('coalesce(sum("Y"), 0)')} AS observed
       FROM tri JOIN fu USING (g) WHERE "Time" >= first_unknown GROUP BY g, "Time", dt_event)"""
    q["observed_by_week_from_tmin"] = (
        f'WITH {_triangle(series=True)}, {known} SELECT g AS series, "Time", dt_event, observed FROM ob'
    )
    q["latest_weeks"] = (
        f'WITH {_triangle()}, {known} SELECT "Time", dt_event, observed FROM ob '
        "ORDER BY dt_event DESC LIMIT 6"
    )
    q["epi_curve"] = (
        f"WITH {_triangle(series=True, k=1)} SELECT g AS series, dt_event, "
        f"{_bigint('coalesce(sum(tri.Y), 0)')} AS observed "
        "FROM tri GROUP BY g, dt_event"
    )
    tally = "SELECT g AS series, onset_week AS dt_event, count(*) AS n FROM bw GROUP BY ALL"
    q["weekly_tally"] = f"WITH {_LINES}, {_weekly(series=True)} {tally}"
    q["stored_tally"] = f"WITH {_LINES}, {weekly_obs} {tally}"
    q["as_of_epi_curve"] = f"WITH {_LINES}, {weekly_obs} {tally}"
    q["weekly_tally_shipdate"] = f"""WITH ship AS (
  SELECT CAST(o_orderdate AS DATE) AS onset, CAST(l_shipdate AS DATE) AS report, 'all' AS series
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
{_weekly(epiweek=True, source="ship")}
SELECT onset_week AS dt_event, count(*) AS n FROM bw GROUP BY ALL"""
    q["daily_tally"] = f"""WITH {_LINES}
SELECT series, onset AS date_onset, count(*) AS n FROM ll WHERE year(onset) < 2001 GROUP BY ALL"""
    q["truth_vs_as_of"] = f"""WITH {_LINES}, {_weekly(as_of=AS_OF, series=True, epiweek=True)},
a AS (SELECT g, onset_week, count(*) AS n FROM bw GROUP BY ALL),
b AS (SELECT series, {_sunday("onset")} AS dt_event, count(*) AS n FROM ll
      WHERE onset <= DATE '{AS_OF}' GROUP BY ALL)
SELECT series, dt_event, b.n AS later, coalesce(a.n, 0) AS "then"
FROM b LEFT JOIN a ON g = series AND onset_week = dt_event"""

    q["latest_release"] = f"""WITH {_snapshots()}
SELECT data, dt_sin_pri AS dt_event, n FROM snap WHERE data = (SELECT max(data) FROM snap)"""
    q["named_release_epiweek"] = f"""WITH {_snapshots()}
SELECT {_sunday("dt_sin_pri")} AS dt_event, {_epi("dt_sin_pri")}, {_bigint("sum(n)")} AS n
FROM snap WHERE data = DATE '{RELEASE}' GROUP BY 1, 2, 3"""
    q["release_by_age"] = f"""WITH {_snapshots(True)}
SELECT {_sunday("dt_sin_pri")} AS dt_event, {_epi("dt_sin_pri")},
       substring(age_class, 5, 1) AS fx_etaria, {_bigint("sum(n)")} AS n
FROM snap WHERE data = (SELECT max(data) FROM snap) GROUP BY 1, 2, 3, 4"""
    q["snapshot_increments"] = f"""WITH {_snapshots()}, seen AS (SELECT * FROM snap), {_STEPS}
SELECT dt_event, dt_release, n, delay, "Y", left_truncated FROM inc"""
    q["snapshot_triangle"] = _snapshot_triangle(15, 30, 2)
    q["snapshot_triangle_floor"] = _snapshot_full_weeks(12, window=None, k=1, by_age=False)
    q["snapshot_triangle_by_age"] = _snapshot_full_weeks(12, window=30, k=0, by_age=True)
    q["clean_age_counts"] = f"""WITH {_snapshots(True)}
SELECT data, CASE WHEN age_class = 'age_0' THEN 'age_1' ELSE age_class END AS age_class,
       {_bigint("sum(n)")} AS n
FROM snap WHERE age_class <> 'age_NA' GROUP BY 1, 2"""
    q["normalise_text"] = f"""SELECT doc_id, regexp_replace(
  translate(upper(replace(text, 'ß', 'SS')), '{ACCENTED}', '{PLAIN}'), '\\p{{P}}', ' ', 'g')
  AS search_form FROM documents"""
    brackets = ", ".join(f"'{x}'" for x in EXTRACT_LABELS)
    q["prepare_raw_extract"] = f"""WITH {_LINES}
SELECT onset AS "DT_SIN_PRI", CASE WHEN l_suppkey % 10 <> 0 THEN report END AS "DT_DIGITA",
       l_returnflag AS "CLASSI_FIN", l_linestatus AS "EVOLUCAO", series AS "CO_MUN_RES",
       CAST(years AS DOUBLE) AS "Idade",
       ([{brackets}])[{_age_code(EXTRACT_LIMITS, "years")}] AS fx_etaria
FROM (SELECT *, CASE WHEN l_linenumber % 4 + 1 = 3 THEN age ELSE 0 END AS years FROM ll
      WHERE l_linenumber % 4 + 1 < 4)"""

    by_age = _draws(age_limits=_TENS)
    samples = f"""ts AS (SELECT g, "Time", dt_event, draw, {_bigint('sum("Y")')} AS "Y"
  FROM dr GROUP BY ALL)"""
    q["summary_total"] = f"""WITH {by_age}, {samples}
SELECT g AS series, "Time", dt_event, {_quantiles('"Y"', LIMITS)} FROM ts GROUP BY ALL"""
    q["summary_by_age"] = f"""WITH {by_age}
SELECT g AS series, "Time", dt_event, age_class, {_quantiles('"Y"', LIMITS)} FROM dr
GROUP BY g, "Time", dt_event, age_class"""
    q["total_samples"] = (
        f'WITH {by_age}, {samples} SELECT g AS series, "Time", dt_event, draw, "Y" FROM ts'
    )
    nine = ", ".join(f'"{n}"' for n in REPORT_LIMITS)
    q["summary_9q"] = (
        f'WITH {_draws()}, {_FORMULA_REPORT} SELECT g AS series, "Time", dt_event, {nine} FROM rep'
    )
    capped = ", ".join(
        f'CASE WHEN "{n}" > 30 THEN least(3 * "Median", "{n}") ELSE "{n}" END AS "{n}"'
        if n in ("LS", "IC90S") else f'"{n}"' for n in REPORT_LIMITS
    )
    q["upper_limit_cap"] = (
        f'WITH {_draws()}, {_FORMULA_REPORT} SELECT g AS series, "Time", dt_event, {capped} FROM rep'
    )

    q["trend_score"] = (
        f"WITH {_draws()}, {_trend('t', 'dr', trend_keys, 3)}, {_trend_limits('t', 'g')} "
        + _trend_output("t")
    )
    q["trend_score_by_age"] = (
        f"WITH {by_age}, {_trend('t', 'dr', 'g, age_class', 4)}, "
        f"{_trend_limits('t', 'g, age_class')} " + _trend_output("t", "g AS series, age_class")
    )
    q["trend_score_single_draw"] = (
        f"WITH {_draws(draws=1)}, {_trend('t', 'dr', trend_keys, 5)}, {_single_limits('t', 5)} "
        + _trend_output("t")
    )
    q["rolling_trend_3w"] = (
        f"WITH {_draws()}, {_trend('t', 'dr', trend_keys, 3, 8)}, {_trend_limits('t', 'g')} "
        + _trend_output("t")
    )
    q["rolling_trend_6w"] = (
        f"WITH {_draws()}, {_trend('t', 'dr', trend_keys, 6, 16)}, {_trend_limits('t', 'g')} "
        + _trend_output("t")
    )

    labels = " ".join(f"WHEN {k} THEN '{v}'" for k, v in TOTAL_LABELS.items())
    q["totals_with_history"] = f"""WITH {_draws(age_limits=TOTAL_BINS)},
bw_all AS (
  SELECT onset - CAST((dayofweek(onset) - s + 7) % 7 AS INTEGER) AS dt_event,
         report - CAST((dayofweek(report) - s + 7) % 7 AS INTEGER) AS report_week, age_class
  FROM v, (SELECT last_report - CASE WHEN w = 6 THEN 7 ELSE 0 END AS cutoff, (w + 1) % 7 AS s
           FROM (SELECT max(report) AS last_report, CAST(dayofweek(max(report)) AS INTEGER) AS w FROM v))
  WHERE report <= cutoff AND age_class IS NOT NULL),
cur AS (SELECT dt_event, age_class FROM bw_all WHERE report_week >= dt_event),
past AS (
  SELECT CASE WHEN grouping(age_class) = 1 THEN 99 ELSE age_class END AS a, count(*) AS n
  FROM cur WHERE dt_event <= (SELECT max(dt_event) FROM cur) - 105
  GROUP BY GROUPING SETS ((age_class), ())),
per_draw AS (
  SELECT CASE WHEN grouping(age_class) = 1 THEN 99 ELSE age_class END AS a, draw, sum("Y") AS y
  FROM dr GROUP BY GROUPING SETS ((draw, age_class), (draw)))
SELECT CAST(a AS INTEGER) AS age_class, CASE a {labels} END AS fx_etaria,
       round(avg(y) + max(coalesce(n, 0)), 6) AS "Mean",
       round(quantile_cont(CAST(y AS DOUBLE), 0.025) + max(coalesce(n, 0)), 6) AS "LI",
       round(quantile_cont(CAST(y AS DOUBLE), 0.975) + max(coalesce(n, 0)), 6) AS "LS"
FROM per_draw LEFT JOIN past USING (a) GROUP BY a"""
    wanted = {k: LIMITS[k] for k in ("Median", "LI", "LS")}
    q["window_total"] = f"""WITH {_draws()},
tt AS (SELECT g, draw, CAST(sum("Y") AS BIGINT) AS total FROM dr GROUP BY g, draw)
SELECT g AS series, {_quantiles("total", wanted)} FROM tt GROUP BY g"""

    # ``_draws`` already holds ``bw``: the rows of the same as-of view by series.
    table = f"WITH {_draws()}, {_FORMULA_REPORT}, {_REPORTED}, {_report_table()}"
    q["report_table"] = f"""{table}
SELECT g AS series, dt_event, n, {nine}, full_estimate, n_cut, rolling_average FROM tab"""
    capped_rep = f'capped AS (SELECT g, dt_event, {capped} FROM rep)'
    q["situation_table"] = f"""WITH {_draws()}, {_FORMULA_REPORT}, {capped_rep}, {_REPORTED},
{_report_table("capped")},
spliced AS (
  SELECT full_obs.g, draw, dt_event, n AS "Y"
  FROM full_obs JOIN (SELECT g, min(dt_event) AS start FROM dr GROUP BY g) USING (g),
       (SELECT unnest(range(1, {FORMULA_DRAWS + 1})) AS draw)
  WHERE dt_event < start UNION ALL SELECT g, draw, dt_event, "Y" FROM dr),
{_trend('a', 'spliced', 'g', 6, 16)}, {_trend_limits('a', 'g')},
{_trend('b', 'spliced', 'g', 3, 8)}, {_trend_limits('b', 'g')},
sa AS (SELECT g, end_week, {_score()} AS trend_6w FROM a_q),
sb AS (SELECT g, end_week, {_score()} AS trend_3w FROM b_q)
SELECT tab.g AS series, dt_event, n, {nine}, full_estimate, n_cut, rolling_average, trend_6w, trend_3w
FROM tab LEFT JOIN sa ON sa.g = tab.g AND sa.end_week = dt_event
LEFT JOIN sb ON sb.g = tab.g AND sb.end_week = dt_event"""
    q["rolling_average"] = f"""WITH {_LINES}, {weekly_obs}, {_REPORTED}
SELECT g AS series, dt_event, n, {_rolling("n")} FROM full_obs"""
    q["bridge_row"] = f"""{table},
br AS (
  SELECT g, dt_event, n, "LI", "LS",
         max(dt_event) FILTER ("Median" IS NOT NULL) OVER (PARTITION BY g) AS last,
         CASE WHEN "Median" IS NULL
               AND lead("Median") OVER (PARTITION BY g ORDER BY dt_event) IS NOT NULL
              THEN n ELSE "Median" END AS "Median" FROM tab)
SELECT g AS series, dt_event, n, "Median", "LI", "LS" FROM br WHERE dt_event <= last"""
    q["history_splice"] = f"""WITH {_draws()}, {_REPORTED}
SELECT g AS series, CAST(draw AS INTEGER) AS draw, dt_event, n AS "Y"
FROM full_obs JOIN (SELECT g, min(dt_event) AS start FROM dr GROUP BY g) USING (g),
     (SELECT unnest(range(1, {FORMULA_DRAWS + 1})) AS draw)
WHERE dt_event < start UNION ALL SELECT g, draw, dt_event, "Y" FROM dr"""
    q["dispersion_check"] = f"""WITH {_draws()}, {_FORMULA_REPORT}
SELECT g AS series, bool_and("LS" / ("Median" + 1) < 2) AS consistent
FROM rep JOIN (SELECT g, max(dt_event) AS last FROM rep GROUP BY g) USING (g)
WHERE dt_event = last GROUP BY g"""
    q["zero_case_strata"] = f"""WITH {_draws(age_limits=FIVE_YEARS)},
seen AS (SELECT g, age_class, coalesce(sum("Y"), 0) AS total FROM tri GROUP BY ALL)
SELECT g AS series, age_class, draw, "Time", dt_event, CASE WHEN total = 0 THEN 0 ELSE "Y" END AS "Y"
FROM dr JOIN seen USING (g, age_class)"""
    q["phase_label"] = f"""WITH {_triangle(k=2)}
SELECT "Time", dt_event, count("Y") AS known,
       CASE WHEN "Time" <= max(last_time) THEN 'nowcast' ELSE 'forecast' END AS phase
FROM tri GROUP BY "Time", dt_event"""
    q["trajectory_checks"] = (
        f'WITH {_triangle(series=True, k=2)}, {known} SELECT g AS series, "Time", dt_event, '
        "observed, CAST(1000 AS BIGINT) AS draws, TRUE AS never_below FROM ob"
    )
    q["trajectory_checks_by_age"] = f"""WITH {_triangle(limits=_TENS)},
fu AS (SELECT min("Time") AS first_unknown FROM tri WHERE "Y" IS NULL)
SELECT age_class, "Time", dt_event, {_bigint('coalesce(sum("Y"), 0)')} AS observed,
       CAST(1000 AS BIGINT) AS draws, TRUE AS never_below
FROM tri, fu WHERE "Time" >= first_unknown GROUP BY age_class, "Time", dt_event"""
    q |= _nowcasts(nations)
    q["situation_table_forecast"] = _situation_forecast(q["situation_table"])
    q["snapshot_triangle_from_changes"] = q["snapshot_triangle"]
    q["release_from_changes"] = q["named_release_epiweek"]
    return q
