"""SQL twins of the registered queries, for a local SQL engine.

The statements are written from the definitions of the operators, not from the
Spark plans: plain grouping and joins, and orthogonal polynomials for the fits.
"""

from __future__ import annotations

from conformance.views import AS_OF, MEET_DATE, RANGE
from ironlog.functions.onerm import FIRST_REP, FIRST_RPE, RPE_PERCENT

_PERCENT_ROWS = ", ".join(
    f"({FIRST_REP + i}, {FIRST_RPE + j}, {pct})"
    for i, line in enumerate(RPE_PERCENT)
    for j, pct in enumerate(line)
)

_OWN_ATHLETE = "CASE WHEN c_custkey % 40 = 7 THEN c_custkey + 1000 ELSE c_nationkey END"
LOG = f"""
entry AS (
  SELECT *, CASE p_type
      WHEN 'ECONOMY' THEN 'Low Bar Squat' WHEN 'STANDARD' THEN 'Hack Squat'
      WHEN 'LARGE' THEN 'Bench Press' WHEN 'PROMO' THEN 'Overhead Press'
      WHEN 'MEDIUM' THEN CASE WHEN p_size <= 15 THEN 'RDL' ELSE 'Deadlift' END
      ELSE 'Leg Press' END AS exercise,
    l_tax = 0.08 AND l_returnflag = 'R' AS skipped, c_custkey % 80 = 7 AS steady
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey),
log AS (
  SELECT CAST({_OWN_ATHLETE} AS BIGINT) AS athlete_id,
    CAST(l_shipdate AS DATE) AS "Date",
    'Block ' || year(o_orderdate) AS "Block",
    'Day ' || isodow(l_shipdate) AS "Day",
    exercise AS "Exercise",
    CASE WHEN NOT skipped THEN CAST(l_linenumber AS DOUBLE)
      + CASE WHEN l_quantity = 50 THEN 4 ELSE 0 END END AS "Sets",
    CASE WHEN NOT skipped THEN CASE WHEN steady THEN 1 ELSE l_quantity % 12 + 1 END
      END AS "Reps",
    CASE WHEN NOT skipped AND NOT (l_tax = 0.07 AND l_returnflag = 'N')
      THEN CASE WHEN steady THEN 100.1
        ELSE floor(CAST(round(l_extendedprice * 100) AS BIGINT) / 7000.0 + 0.5) / 2 END
      END AS "Load",
    CASE WHEN NOT steady AND NOT (l_linestatus = 'O' AND l_tax <= 0.02)
      THEN round(5 + 50 * l_discount, 1) END AS "RPE",
    '' AS "Notes",
    CASE WHEN exercise LIKE '%Squat' THEN 'Squat'
      WHEN exercise IN ('RDL', 'Deadlift') THEN 'Deadlift'
      WHEN exercise IN ('Bench Press', 'Overhead Press') THEN 'Bench'
      ELSE 'Accessory' END AS "Lift_Type"
  FROM entry)"""

MESSY = LOG + """,
messy AS (
  SELECT * REPLACE (CASE
    WHEN "Sets" IS NULL AND "Reps" IS NULL AND "Load" IS NULL
      AND "Exercise" = 'RDL' THEN 'Exercise'
    WHEN "RPE" = 5.5 THEN 'Notes: ' || "Exercise"
    ELSE "Exercise" END AS "Exercise") FROM log)"""

METHODS = LOG + f""",
percent(t_reps, t_rpe, pct) AS (VALUES {_PERCENT_ROWS}),
m0 AS (
  SELECT log.*,
    CASE WHEN "Reps" > 0 THEN "Load" * (1 + "Reps" / 30) END AS epley,
    CASE WHEN "Reps" > 0 AND "Reps" < 37
      THEN "Load" * 36 / (37 - "Reps") END AS brzycki,
    CASE WHEN "Reps" > 0 THEN "Load" * pow("Reps", 0.1) END AS lombardi,
    "Load" / CAST(pct AS DOUBLE) AS by_table
  FROM log LEFT JOIN percent
    ON round_even("Reps", 0) = t_reps AND round_even("RPE", 0) = t_rpe),
methods AS (
  SELECT * EXCLUDE (by_table),
    CASE WHEN "RPE" IS NOT NULL THEN coalesce(by_table, epley) END AS rpe_based
  FROM m0),
estimates AS (
  SELECT *, CASE WHEN "Reps" BETWEEN 1 AND 10 AND "RPE" IS NOT NULL THEN rpe_based
      WHEN "Reps" BETWEEN 1 AND 10 THEN brzycki ELSE epley END AS est
  FROM methods)"""

RM = METHODS + """,
rm AS (SELECT * FROM estimates
  WHERE "Lift_Type" IN ('Squat', 'Bench', 'Deadlift'))"""

STRICT = METHODS + """,
strict AS (SELECT * FROM estimates
  WHERE "Load" > 0 AND "Reps" > 0 AND est > 0 AND est < 1000)"""

MEETS = """
meets AS (
  SELECT CAST(c_nationkey AS BIGINT) AS athlete_id, c_name AS "Name",
    CAST(o_orderdate AS DATE) AS "Date", 'Meet ' || o_orderkey % 50 AS "MeetName",
    n_name AS "Federation", c_mktsegment AS "Division",
    CAST(o_orderkey % 10 + 1 AS VARCHAR) AS "Place",
    CASE WHEN o_orderkey % 7 <> 0 THEN sgn * (cents * 37 // 70000) / 100 END
      AS "Best3SquatKg",
    CASE WHEN o_orderkey % 7 <> 0 THEN sgn * (cents * 23 // 70000) / 100 END
      AS "Best3BenchKg",
    CASE WHEN o_orderkey % 7 <> 0 THEN sgn * (cents * 40 // 70000) / 100 END
      AS "Best3DeadliftKg",
    (cents // 700) / 100 AS "TotalKg", (cents // 977) / 100 AS "Dots"
  FROM (SELECT *, CASE WHEN o_orderkey % 11 = 0 THEN -1 ELSE 1 END AS sgn,
          CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders)
  JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""

MEETS_LONG = MEETS + """,
meet_lifts AS (
  SELECT *, 'Squat' AS lift, "Best3SquatKg" AS kg FROM meets
  UNION ALL SELECT *, 'Bench', "Best3BenchKg" FROM meets
  UNION ALL SELECT *, 'Deadlift', "Best3DeadliftKg" FROM meets),
meets_long AS (
  SELECT athlete_id, "Date", 'MEET: ' || "MeetName" AS "Block",
    'Competition' AS "Day", 'Competition ' || lift AS "Exercise",
    1.0::DOUBLE AS "Sets", 1.0::DOUBLE AS "Reps",
    round_even(kg * 2.20462, 1) AS "Load", NULL::DOUBLE AS "RPE",
    'Competition - ' || "Federation" || ' ' || "Division" AS "Notes",
    lift AS "Lift_Type", true AS "Meet_Result", "Place",
    round_even("TotalKg" * 2.20462, 1) AS "Total", "Dots"
  FROM meet_lifts WHERE round_even(kg * 2.20462, 1) > 0)"""

# Weeks and their columns as laid out by the grid view.
GRID = LOG + """,
grid AS (
  SELECT * EXCLUDE ("Block"), "Block" AS block, CAST(date_trunc('week', "Date") AS DATE) AS week_start,
    CAST((CAST(date_trunc('week', "Date") AS DATE) - DATE '1990-01-01') // 7 * 12
      AS BIGINT) AS base_col
  FROM log)"""

_KEYS = 'athlete_id, "Lift_Type"'
_ENTRY = 'athlete_id, "Date", "Exercise", "Load", "Reps", "RPE"'
_LOG_COLUMNS = (
    'athlete_id, "Date", "Block", "Day", "Exercise", "Sets", "Reps", "Load", "RPE",'
    ' "Notes", "Lift_Type"'
)
_MAIN = "\"Lift_Type\" IN ('Squat', 'Bench', 'Deadlift')"
_BLANK = '"Sets" IS NULL AND "Reps" IS NULL AND "Load" IS NULL'
_IN_RANGE = f"\"Date\" BETWEEN DATE '{RANGE[0]}' AND DATE '{RANGE[1]}'"
_RULES = (
    "(VALUES ('RPE', 1.0::DOUBLE, 10.0::DOUBLE), ('Sets', 1.0, 8.0),"
    " ('Reps', 1.0, 50.0), ('Load', 1.0, 700.0)) AS rules(\"column\", \"min\", \"max\")"
)
_BROKEN = (
    '(coalesce("RPE" NOT BETWEEN 1 AND 10, false)'
    ' OR coalesce("Sets" NOT BETWEEN 1 AND 8, false)'
    ' OR coalesce("Reps" NOT BETWEEN 1 AND 50, false)'
    ' OR coalesce("Load" NOT BETWEEN 1 AND 700, false))'
)
_WEEK = "CAST(date_trunc('week', \"Date\") AS DATE)"
_METHOD_COLUMNS = (
    'round(epley, 4) AS "1rm_epley", round(brzycki, 4) AS "1rm_brzycki",'
    ' round(lombardi, 4) AS "1rm_lombardi", round(rpe_based, 4) AS "1rm_rpe_based"'
)


def _with(ctes: str, select: str) -> str:
    return f"WITH {ctes}\n{select}"


def _corr(x: str, y: str) -> str:
    """Correlation; null for a constant side or a missing value."""
    return (
        f"CASE WHEN count({x}) = count(*) AND count({y}) = count(*)"
        f" AND min({x}) < max({x}) AND min({y}) < max({y}) THEN corr({x}, {y}) END"
    )


# --- polynomial fits by orthogonal polynomials -------------------------------------


def _fit(series: str, keys: str = _KEYS) -> str:
    """CTEs ending in ``fit``; ``series`` has keys, "Date" and est.

    t1, t2, t3 are orthogonal over the days of a key; c1, c2, c3 the
    projections of the values on them.
    """
    return f"""
f0 AS (SELECT *, "Date" - min("Date") OVER w AS x FROM {series}
  WINDOW w AS (PARTITION BY {keys})),
f1 AS (SELECT *, x - avg(x) OVER w AS t1, est - avg(est) OVER w AS yc FROM f0
  WINDOW w AS (PARTITION BY {keys})),
f2 AS (SELECT *, t1 * (t1 - sum(t1 * t1 * t1) OVER w / nullif(sum(t1 * t1) OVER w, 0))
    - sum(t1 * t1) OVER w / count(*) OVER w AS t2 FROM f1
  WINDOW w AS (PARTITION BY {keys})),
f3 AS (SELECT *,
    t2 * (t1 - sum(t1 * t2 * t2) OVER w / nullif(sum(t2 * t2) OVER w, 0))
    - t1 * sum(t2 * t2) OVER w / nullif(sum(t1 * t1) OVER w, 0) AS t3 FROM f2
  WINDOW w AS (PARTITION BY {keys})),
f4 AS (SELECT {keys}, count(*) AS n, min("Date") AS first_day, max(x) AS last_day,
    avg(x) AS x_mean, avg(est) AS y_mean, arg_max(est, "Date") AS current,
    sum(yc * yc) AS yy, sum(t1 * t1) AS q1, sum(t2 * t2) AS q2, sum(t3 * t3) AS q3,
    sum(t1 * t1 * t1) AS s1, sum(t1 * t2 * t2) AS s2,
    sum(yc * t1) / nullif(sum(t1 * t1), 0) AS c1,
    sum(yc * t2) / nullif(sum(t2 * t2), 0) AS c2,
    sum(yc * t3) / nullif(sum(t3 * t3), 0) AS c3
  FROM f3 GROUP BY {keys}),
f4b AS (SELECT * EXCLUDE (flat) REPLACE (CASE WHEN flat THEN 0 ELSE yy END AS yy,
    CASE WHEN flat THEN 0 ELSE c1 END AS c1, CASE WHEN flat THEN 0 ELSE c2 END AS c2,
    CASE WHEN flat THEN 0 ELSE c3 END AS c3)
  FROM (SELECT *, yy / n <= y_mean * y_mean * 1e-22 AS flat FROM f4)),
f5 AS (SELECT *,
    CASE WHEN yy = 0 THEN 1.0 ELSE least(1, c1 * c1 * q1 / yy) END AS r1,
    CASE WHEN yy = 0 THEN 1.0 ELSE least(1, (c1 * c1 * q1 + c2 * c2 * q2) / yy) END AS r2,
    CASE WHEN yy = 0 THEN 1.0
      ELSE least(1, (c1 * c1 * q1 + c2 * c2 * q2 + c3 * c3 * q3) / yy) END AS r3
  FROM f4b)"""


def _chosen(every_key: str, robust: bool, keys: str = _KEYS) -> str:
    degree = (
        "CASE WHEN r1 < 0.3 AND r2 > r1 + 0.1 THEN 2 ELSE 1 END"
        if robust
        else "CASE WHEN r3 > greatest(r1, r2) THEN 3 WHEN r2 > r1 THEN 2 ELSE 1 END"
    )
    return f"""
fit AS (SELECT {every_key}.*, f5.* EXCLUDE ({keys}, n), coalesce(n, 0) AS n,
    coalesce(n >= 5, false) AS ok,
    CASE WHEN n >= 5 THEN {degree} END AS degree
  FROM {every_key} LEFT JOIN f5 USING ({keys})),
model AS (SELECT *,
    CASE degree WHEN 1 THEN 'linear' WHEN 2 THEN 'polynomial_2'
      WHEN 3 THEN 'polynomial_3' END AS model_type,
    CASE degree WHEN 1 THEN r1 WHEN 2 THEN r2 WHEN 3 THEN r3 END AS r2_score,
    CASE WHEN ok THEN current END AS current_1rm,
    CASE WHEN ok THEN 'ok' ELSE 'insufficient' END AS state
  FROM fit)"""


def _at(day: str) -> str:
    """Value of the chosen model on a day."""
    t1 = f"(({day}) - x_mean)"
    t2 = f"({t1} * ({t1} - s1 / q1) - q1 / n)"
    t3 = f"({t2} * ({t1} - s2 / q2) - {t1} * q2 / q1)"
    return (
        f"(y_mean + c1 * {t1} + CASE WHEN degree >= 2 THEN c2 * {t2} ELSE 0 END"
        f" + CASE WHEN degree >= 3 THEN c3 * {t3} ELSE 0 END)"
    )


def _series(source: str, days: int) -> str:
    """CTEs ``newest``, ``every_key`` and ``series``: daily best in the window."""
    return f"""
newest AS (SELECT athlete_id, max("Date") AS newest FROM {source} GROUP BY ALL),
every_key AS (SELECT DISTINCT {_KEYS} FROM {source}),
series AS (SELECT {_KEYS}, "Date", max(est) AS est
  FROM {source} JOIN newest USING (athlete_id)
  WHERE est > 0 AND "Date" >= newest - {days} GROUP BY ALL)"""


PLAIN = RM + "," + _series("rm", 365)
PLAIN_FIT = PLAIN + "," + _fit("series") + "," + _chosen("every_key", False)

FILTERED = RM + f""",
newest AS (SELECT athlete_id, max("Date") AS newest FROM rm GROUP BY ALL),
recent AS (SELECT * FROM rm JOIN newest USING (athlete_id)
  WHERE est > 0 AND "Date" >= newest - 180),
counted AS (SELECT {_KEYS}, "Exercise", count(*) AS entries FROM recent GROUP BY ALL),
main AS (SELECT * FROM counted QUALIFY row_number() OVER (
  PARTITION BY {_KEYS} ORDER BY entries DESC, "Exercise") = 1),
every_key AS (SELECT {_KEYS}, main."Exercise" AS main_exercise, entries
  FROM (SELECT DISTINCT {_KEYS} FROM rm) LEFT JOIN main USING ({_KEYS})),
low AS (SELECT recent.* FROM recent JOIN main USING ({_KEYS}, "Exercise")
  WHERE "Reps" <= 6),
bounds AS (SELECT {_KEYS}, avg(est) AS mu, stddev_samp(est) AS sd FROM low
  GROUP BY ALL),
series AS (SELECT {_KEYS}, "Date", max(est) AS est FROM low
  JOIN bounds USING ({_KEYS}) WHERE abs(est - mu) <= 2 * sd + 1e-12 * abs(mu)
  GROUP BY ALL)"""
FILTERED_KEYS = FILTERED + f""",
every_fit AS (SELECT * EXCLUDE (main_exercise, entries),
    CASE WHEN EXISTS (SELECT 1 FROM series s WHERE s.athlete_id = k.athlete_id
      AND s."Lift_Type" = k."Lift_Type") THEN main_exercise END AS main_exercise
  FROM every_key k)"""
ROBUST_FIT = FILTERED_KEYS + "," + _fit("series") + "," + _chosen("every_fit", True)

_FIT_SHOWN = (
    "n AS data_points, round(current_1rm, 4) AS current_1rm, model_type,"
    " round(r2_score, 4) AS r2_score, state AS status"
)


def _metrics(days: int) -> str:
    end = _at(f"last_day + {days}")
    gain = f"({end} - current_1rm)"
    monthly = f"({gain} / ({days} / 30.44::DOUBLE))"
    return (
        f"CASE WHEN ok THEN round({end}, 4) END AS forecast_1rm,"
        f" CASE WHEN ok THEN round({gain}, 4) END AS projected_gain,"
        f" CASE WHEN ok THEN round({monthly}, 4) END AS monthly_gain,"
        f" CASE WHEN ok THEN CASE WHEN {monthly} > 0 THEN 'increasing'"
        " ELSE 'decreasing' END END AS trend_direction"
    )


_GOALS = """
goals("Lift_Type", target) AS (VALUES ('Squat', 575.0::DOUBLE), ('Squat', 600.0),
  ('Squat', 625.0), ('Bench', 425.0), ('Bench', 450.0), ('Bench', 475.0),
  ('Deadlift', 575.0), ('Deadlift', 600.0), ('Deadlift', 625.0))"""


def _linear_goals(goals: str) -> str:
    state = (
        "CASE WHEN NOT ok THEN 'insufficient' WHEN target <= current THEN"
        " 'already_achieved' WHEN c1 > 0 THEN 'reachable' ELSE 'unreachable' END"
    )
    return _with(
        f"{ROBUST_FIT},{goals},"
        f"g AS (SELECT *, {state} AS status, (target - current) / c1 AS needed"
        ' FROM model JOIN goals USING ("Lift_Type"))',
        f"""
SELECT {_KEYS}, main_exercise, n AS data_points, target,
  round(current_1rm, 4) AS current_1rm, model_type, round(r2_score, 4) AS r2_score,
  status,
  CASE WHEN status = 'reachable' THEN round(needed, 4) END AS days_to_target,
  CASE WHEN status = 'reachable' THEN round(needed / 30.44, 4) END
    AS months_to_target,
  CASE WHEN status = 'reachable'
    AND needed <= DATE '9999-12-31' - DATE '{AS_OF}'
    THEN DATE '{AS_OF}' + CAST(floor(needed) AS INTEGER) END AS target_date,
  CASE WHEN status IN ('reachable', 'unreachable') THEN round(c1 * 30.44, 4) END
    AS monthly_gain,
  CASE WHEN status = 'reachable' THEN CASE WHEN r2_score > 0.5 THEN 'High'
    WHEN r2_score > 0.2 THEN 'Medium' ELSE 'Low' END END AS confidence
FROM g""",
    )


def _status(select: str, source: str) -> str:
    """All keys of ``source``; ``select`` gives the figures of those that have some."""
    return f"""SELECT every_key.*, found.* EXCLUDE ({_KEYS}, status),
  coalesce(found.status, 'insufficient') AS status
FROM (SELECT DISTINCT {_KEYS} FROM {source}) AS every_key
LEFT JOIN (SELECT *, 'ok' AS status FROM ({select})) AS found USING ({_KEYS})"""


def _recent(select: str, having: str = "") -> str:
    """Query over ``recent`` rows and their ``daily`` bests of twelve months."""
    return _with(
        STRICT
        + f""",
recent AS (SELECT * FROM strict WHERE "Date" >= DATE '{AS_OF}' - 360),
daily AS (SELECT {_KEYS}, "Date", max(est) AS est, max("Load") AS load,
    min("Exercise") AS exercise FROM recent GROUP BY ALL),
placed AS (SELECT *, row_number() OVER (PARTITION BY {_KEYS} ORDER BY "Date") AS pos,
    count(*) OVER (PARTITION BY {_KEYS}) AS sessions FROM daily)""",
        select,
    )


_WEEKLY = RM + f""",
weekly AS (SELECT {_KEYS}, {_WEEK} AS "Week", count(DISTINCT "Date") AS sessions,
    max(est) AS best, sum("Sets" * "Reps" * "Load") AS vol FROM rm GROUP BY ALL)"""
_FREQUENCY = _WEEKLY + f""",
enough AS (SELECT *, row_number() OVER (PARTITION BY {_KEYS}, sessions
    ORDER BY "Week") AS pos FROM weekly
  QUALIFY count(*) OVER (PARTITION BY {_KEYS}) >= 4),
freq AS (SELECT {_KEYS}, sessions, avg(best) AS average_1rm, count(*) AS week_count,
    CASE WHEN count(*) >= 3 THEN {_corr('pos', 'best')} ELSE 0 END AS r
  FROM enough WHERE sessions BETWEEN 1 AND 7 GROUP BY ALL HAVING count(*) >= 2)"""
_VOLUME = _WEEKLY + f""",
loaded AS (SELECT * FROM weekly WHERE vol > 0
  QUALIFY count(*) OVER (PARTITION BY {_KEYS}) >= 4),
edges AS (SELECT {_KEYS}, quantile_cont(vol, 0.25) AS e1, quantile_cont(vol, 0.5) AS e2,
    quantile_cont(vol, 0.75) AS e3 FROM loaded GROUP BY ALL),
buckets AS (SELECT {_KEYS},
    CASE WHEN vol < e1 THEN 1 WHEN vol < e2 THEN 2 WHEN vol < e3 THEN 3 ELSE 4 END
      AS bucket_no,
    avg(best) AS average_1rm, count(*) AS week_count, avg(vol) AS avg_volume,
    printf('%.0f-%.0f', round_even(min(vol), 0), round_even(max(vol), 0)) AS volume_range
  FROM loaded JOIN edges USING ({_KEYS}) GROUP BY ALL HAVING count(*) >= 2),
named AS (SELECT *, CASE bucket_no WHEN 1 THEN 'Low (Bottom 25%)'
    WHEN 2 THEN 'Moderate (25-50%)' WHEN 3 THEN 'High (50-75%)'
    ELSE 'Very High (Top 25%)' END AS bucket FROM buckets)"""
_BANDS = RM + f""",
banded AS (SELECT *, CASE WHEN "Reps" BETWEEN 1 AND 3 THEN 1
    WHEN "Reps" BETWEEN 4 AND 6 THEN 2 WHEN "Reps" BETWEEN 7 AND 10 THEN 3
    WHEN "Reps" BETWEEN 11 AND 50 THEN 4 END AS band_no,
    CAST("Date" - DATE '1990-01-01' AS DOUBLE) AS at_day FROM rm WHERE est IS NOT NULL),
bands AS (SELECT {_KEYS}, CAST(band_no AS BIGINT) AS band_no,
    CASE band_no WHEN 1 THEN '1-3 (Strength)' WHEN 2 THEN '4-6 (Power)'
      WHEN 3 THEN '7-10 (Hypertrophy)' ELSE '11+ (Endurance)' END AS rep_range,
    CASE WHEN min(at_day) = max(at_day) THEN 0 ELSE {_corr('at_day', 'est')} END AS r,
    avg(est) AS average_1rm, coalesce(sum("Sets" * "Reps" * "Load"), 0) AS total_volume,
    count(*) AS session_count
  FROM banded WHERE band_no IS NOT NULL GROUP BY {_KEYS}, band_no
  HAVING count(*) >= 5)"""

_REP_PRS = LOG + f""",
prs AS (SELECT {_KEYS}, "Reps", "Load", "Date", "Exercise" FROM log
  WHERE {_MAIN} AND "Reps" <= 10
  QUALIFY row_number() OVER (PARTITION BY {_KEYS}, "Reps" ORDER BY "Load" DESC NULLS LAST,
    "Date" NULLS LAST, "Exercise" NULLS LAST) = 1)"""
_PROGRESSION = METHODS + f""",
best_day AS (SELECT {_KEYS}, "Date", max(est) AS est FROM estimates
  WHERE {_MAIN} AND {_IN_RANGE} AND "Load" > 0 AND "Reps" > 0
    AND est > 0 AND est < 1000 GROUP BY ALL),
middle AS (SELECT {_KEYS}, median(est) AS mid FROM best_day GROUP BY ALL),
points AS (SELECT best_day.* FROM best_day JOIN middle USING ({_KEYS})
  WHERE est >= 0.5 * mid)"""
_DAILY_90 = RM + """,
newest AS (SELECT athlete_id, max("Date") AS newest FROM rm GROUP BY ALL),
aged AS (SELECT *, "Date" >= newest - 90 AS recent FROM rm
  JOIN newest USING (athlete_id))"""

_SEARCH = MEETS + """,
hits AS (
  SELECT 'customer#000000007' AS query, 1 AS tier, * FROM meets
    WHERE lower("Name") LIKE '%customer#000000007%'
  UNION ALL SELECT 'Customer#00000001', 1, * FROM meets
    WHERE lower("Name") LIKE '%customer#00000001%'
  UNION ALL SELECT '000000012 customer', 2, * FROM meets
    WHERE lower("Name") LIKE '%000000012%' AND lower("Name") LIKE '%customer%'
  UNION ALL SELECT 'a 1', 2, * FROM meets)"""
_CLEAN_REASON = (
    "CASE WHEN lower(\"Exercise\") LIKE '%exercise%' OR lower(\"Exercise\")"
    f" LIKE '%notes:%' THEN 'header_like' WHEN {_BLANK} THEN 'completely_blank'"
    f" WHEN {_BROKEN} THEN 'suspicious' END"
)
_ROUND_MEETS = (
    'round("Best3SquatKg", 4) AS "Best3SquatKg",'
    ' round("Best3BenchKg", 4) AS "Best3BenchKg",'
    ' round("Best3DeadliftKg", 4) AS "Best3DeadliftKg",'
    ' round("TotalKg", 4) AS "TotalKg", round("Dots", 4) AS "Dots"'
)


def _annotated(source: str) -> str:
    return (
        f'SELECT {_LOG_COLUMNS}, round(est, 4) AS estimated_1rm, {_METHOD_COLUMNS}'
        f" FROM {source}"
    )


def _value(column: str) -> str:
    return _with(METHODS, f"SELECT {_ENTRY}, round({column}, 4) AS value FROM estimates")


def _clean(source: str, ctes: str) -> str:
    return _with(ctes, f"SELECT {_LOG_COLUMNS} FROM {source} WHERE {_CLEAN_REASON} IS NULL")


def _sample(condition: str, n: int, seed: int) -> str:
    text = ", ".join(
        f"'{i}:' || coalesce(CAST({c.strip()} AS VARCHAR), '\\N')"
        for i, c in enumerate(_LOG_COLUMNS.split(","))
    )
    return _with(
        LOG,
        f"SELECT {_LOG_COLUMNS} FROM log WHERE {condition}"
        f" ORDER BY md5(concat_ws('|', {text}, '{seed}')), {_LOG_COLUMNS} LIMIT {n}",
    )


def _text(column: str) -> str:
    """A number as the grid shows it: always with a decimal point."""
    return f'CAST(CAST("{column}" AS DOUBLE) AS VARCHAR)'


def statements() -> dict[str, str]:
    return {
        # sources and sinks
        "read_log": _with(
            LOG,
            f'SELECT * REPLACE (NULL::VARCHAR AS "Notes") FROM'
            f" (SELECT {_LOG_COLUMNS} FROM log)",
        ),
        "read_cells": """
WITH s AS (SELECT *, CAST(0 AS BIGINT) AS athlete_id,
    p_brand || ' ' || (p_partkey // 2000) AS sheet FROM part),
t AS (SELECT *, row_number() OVER (PARTITION BY sheet ORDER BY p_partkey) - 1
    AS row_idx FROM s)
SELECT athlete_id, sheet AS block, row_idx, CAST(0 AS BIGINT) AS col_idx,
  CAST(p_partkey AS VARCHAR) AS value FROM t
UNION ALL SELECT athlete_id, sheet, row_idx, 1, p_name FROM t
UNION ALL SELECT athlete_id, sheet, row_idx, 2, p_type FROM t
UNION ALL SELECT athlete_id, sheet, row_idx, 3, CAST(p_size AS VARCHAR) FROM t
UNION ALL SELECT athlete_id, sheet, row_idx, 4, CAST(p_retailprice AS VARCHAR) FROM t""",
        "sheets_to_1rm": _with(
            RM.replace(_OWN_ATHLETE, "c_custkey // 60"),
            f"""SELECT {_KEYS}, round(est, 4) AS "Max_1RM", "Date",
  "Load" AS "Weight_Used", "Reps", "RPE" FROM rm
QUALIFY row_number() OVER (PARTITION BY {_KEYS} ORDER BY est DESC NULLS LAST,
  "Date" NULLS LAST, "Load" NULLS LAST, "Reps" NULLS LAST, "RPE" NULLS LAST) = 1""",
        ),
        "read_meets": """
WITH t AS (SELECT *, CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) AS price
  FROM orders)
SELECT 'Lifter ' || o_custkey AS "Name",
  CASE WHEN o_orderkey % 13 <> 0 THEN CAST(o_orderdate AS DATE) END AS "Date",
  'Meet ' || o_orderkey AS "MeetName",
  CASE WHEN o_orderkey % 5 <> 0 AND o_orderkey % 7 <> 0 THEN CAST(price AS DOUBLE) END
    AS "TotalKg",
  CASE WHEN o_orderkey % 9 <> 0 THEN CAST(price AS DOUBLE) END AS "Best3SquatKg"
FROM t""",
        "write_log": _with(RM, _annotated("rm")),
        "ingest_grids": _clean("log", LOG),
        "incremental_ingest": _clean("log", LOG),
        "corrected_sheets": _clean("log", LOG),
        # normalisation
        "week_columns": _with(
            GRID, "SELECT DISTINCT athlete_id, block, base_col, week_start FROM grid"
        ),
        "parse_date_multi": """
WITH t AS (SELECT o_orderkey, CASE o_orderkey % 6
    WHEN 0 THEN strftime(o_orderdate, '%Y-%-m-%-d')
    WHEN 1 THEN strftime(o_orderdate, '%m/%d/%Y')
    WHEN 2 THEN strftime(o_orderdate, '%-d/%-m/%Y')
    WHEN 3 THEN strftime(o_orderdate, '%Y-%m-%d 00:00:00')
    WHEN 4 THEN CAST(o_orderkey AS VARCHAR) ELSE '' END AS text FROM orders)
SELECT o_orderkey, text, CAST(coalesce(try_strptime(text, '%Y-%m-%d'),
  try_strptime(text, '%m/%d/%Y'), try_strptime(text, '%d/%m/%Y'),
  try_strptime(text, '%Y-%m-%d %H:%M:%S')) AS DATE) AS date FROM t""",
        "day_labels": _with(
            GRID,
            'SELECT athlete_id, block, base_col, "Day", count(*) AS entries'
            " FROM grid GROUP BY ALL",
        ),
        "day_number": _with(
            GRID,
            """SELECT "Day" AS value, count(*) AS labels,
  CAST(substr("Day", 5) AS BIGINT) AS day_number
FROM (SELECT DISTINCT athlete_id, block, base_col, "Day" FROM grid) GROUP BY ALL""",
        ),
        "session_date": _with(
            GRID,
            'SELECT athlete_id, block, "Date", count(*) AS entries'
            " FROM grid GROUP BY ALL",
        ),
        "project_offsets": _with(
            GRID,
            f"""SELECT athlete_id, block, "Date", "Exercise" AS exercise,
  {_text("Load")} AS load, {_text("Sets")} AS sets, {_text("Reps")} AS reps,
  {_text("RPE")} AS rpe FROM grid""",
        ),
        "clean_numeric": """
WITH t AS (SELECT CASE l_linenumber
    WHEN 1 THEN CAST(l_quantity AS INTEGER) || ' lbs'
    WHEN 2 THEN '@' || CAST(l_quantity AS INTEGER)
    WHEN 3 THEN CAST(l_quantity AS INTEGER) || '-' || (CAST(l_quantity AS INTEGER) + 2)
    WHEN 4 THEN CAST(l_quantity AS INTEGER) || '.'
    WHEN 5 THEN '-' || CAST(l_quantity AS INTEGER)
    WHEN 6 THEN ''
    ELSE ' ~' || CAST(l_quantity AS INTEGER) || '.5kg ' END AS text FROM lineitem)
SELECT text, try_cast(nullif(regexp_replace(text, '[^0-9.-]', '', 'g'), '') AS DOUBLE)
  AS number, count(*) AS rows FROM t GROUP BY ALL""",
        "classify_lift": """
WITH t AS (SELECT (['Front Squat', 'leg press', 'Close-Grip BENCH', 'Hurdle',
    'Romanian Deadlift', 'Shoulder Press', 'Curl'])[p_partkey % 7 + 1]
    || ' ' || p_name AS exercise FROM part),
u AS (SELECT exercise, lower(exercise) AS name FROM t)
SELECT exercise, CASE WHEN name LIKE '%squat%' THEN 'Squat'
  WHEN name LIKE '%deadlift%' OR name LIKE '%rdl%' THEN 'Deadlift'
  WHEN (name LIKE '%bench%' OR name LIKE '%press%') AND name NOT LIKE '%leg%'
    THEN 'Bench' ELSE 'Accessory' END AS lift_type, count(*) AS parts
FROM u GROUP BY ALL""",
        "normalize": _with(LOG, f"SELECT {_LOG_COLUMNS} FROM log"),
        "log_summary": _with(
            LOG,
            """SELECT athlete_id, count(*) AS total_entries,
  count(DISTINCT "Exercise") AS unique_exercises,
  count(DISTINCT "Block") AS unique_blocks, min("Date") AS first_date,
  max("Date") AS last_date FROM log GROUP BY ALL""",
        ),
        "log_blocks": _with(LOG, 'SELECT DISTINCT athlete_id, "Block" FROM log'),
        "log_lift_counts": _with(
            LOG, f"SELECT {_KEYS}, count(*) AS entries FROM log GROUP BY ALL"
        ),
        # quality
        "main_lifts": _with(LOG, f"SELECT {_LOG_COLUMNS} FROM log WHERE {_MAIN}"),
        "blank_profile": _with(
            LOG,
            f""",
c AS (SELECT count(*) AS total,
    count(*) FILTER (WHERE {_BLANK}) AS completely_blank,
    count(*) FILTER (WHERE ("Sets" IS NULL OR "Reps" IS NULL OR "Load" IS NULL)
      AND NOT ({_BLANK})) AS partially_blank FROM log)
SELECT *, round(100.0 * completely_blank / total, 4) AS completely_blank_pct,
  round(100.0 * partially_blank / total, 4) AS partially_blank_pct FROM c""",
        ),
        "blank_top_exercises": _with(
            MESSY,
            f"""SELECT "Exercise", count(*) AS entries FROM messy WHERE {_BLANK}
GROUP BY ALL ORDER BY entries DESC, "Exercise" LIMIT 10""",
        ),
        "suspicious_rows": _with(
            LOG, f"SELECT DISTINCT {_LOG_COLUMNS} FROM log WHERE {_BROKEN}"
        ),
        "rule_violations": _with(
            LOG,
            f"""SELECT "column", "min", "max", count(*) AS violations
FROM (UNPIVOT (SELECT "RPE", "Sets", "Reps", "Load" FROM log)
  ON "RPE", "Sets", "Reps", "Load" INTO NAME "column" VALUE value)
JOIN {_RULES} USING ("column") WHERE value NOT BETWEEN "min" AND "max"
GROUP BY ALL""",
        ),
        "rule_violation_examples": _with(
            LOG,
            f"""SELECT athlete_id, "Date", "Exercise", "column", value, "min", "max",
  row_number() OVER (PARTITION BY "column" ORDER BY athlete_id, "Date", "Exercise",
    value) AS example
FROM (UNPIVOT (SELECT athlete_id, "Date", "Exercise", "RPE", "Sets", "Reps", "Load"
    FROM log) ON "RPE", "Sets", "Reps", "Load" INTO NAME "column" VALUE value)
JOIN {_RULES} USING ("column") WHERE value NOT BETWEEN "min" AND "max"
QUALIFY example <= 3""",
        ),
        "clean_dataset": _clean("messy", MESSY),
        "clean_removal_counts": _with(
            MESSY,
            f"""SELECT count(*) AS original,
  count(*) FILTER (WHERE reason = 'header_like') AS header_like,
  count(*) FILTER (WHERE reason = 'completely_blank') AS completely_blank,
  count(*) FILTER (WHERE reason = 'suspicious') AS suspicious,
  count(*) FILTER (WHERE reason IS NULL) AS clean,
  round(100.0 * count(*) FILTER (WHERE reason IS NULL) / count(*), 4) AS clean_pct
FROM (SELECT {_CLEAN_REASON} AS reason FROM messy)""",
        ),
        "header_like": _with(
            MESSY,
            f"""SELECT {_LOG_COLUMNS} FROM messy WHERE {_BLANK}
AND ("Exercise" LIKE '%Exercise%' OR "Exercise" LIKE '%exercise%')""",
        ),
        "missing_profile": _with(
            LOG,
            "\nUNION ALL ".join(
                f"SELECT '{c}' AS \"column\", count(*) - count(\"{c}\") AS missing,"
                f' round(100.0 * (count(*) - count("{c}")) / count(*), 4) AS pct'
                f' FROM log HAVING count(*) > count("{c}")'
                for c in ("Date", "Exercise", "Sets", "Reps", "Load", "RPE", "Notes")
            ),
        ),
        "extreme_values": _with(
            LOG,
            """SELECT count(*) FILTER (WHERE "Load" > 1000) AS high_loads,
  max("Load") AS max_load, count(*) FILTER (WHERE "Reps" > 50) AS high_reps,
  count(*) FILTER (WHERE "RPE" < 1 OR "RPE" > 10) AS odd_rpe FROM log""",
        ),
        "lift_distribution": _with(
            LOG,
            """SELECT "Lift_Type", count(*) AS entries,
  round(100.0 * count(*) / (SELECT count(*) FROM log), 4) AS pct
FROM log GROUP BY ALL""",
        ),
        "date_coverage": _with(
            LOG,
            """SELECT min("Date") AS first_date, max("Date") AS last_date,
  max("Date") - min("Date") AS span_days FROM log""",
        ),
        "block_top10": _with(
            LOG,
            """SELECT "Block", count(*) AS entries FROM log GROUP BY ALL
ORDER BY entries DESC, "Block" LIMIT 10""",
        ),
        "search_exercise": _with(
            LOG,
            f"""SELECT {_LOG_COLUMNS} FROM log
WHERE regexp_matches("Exercise", '(?i)bar|^rd')""",
        ),
        "sample_rows": _sample("true", 25, 7),
        "show_exercise_examples": _sample("\"Exercise\" ILIKE '%press%'", 25, 7),
        "reconcile_raw": _with(
            LOG,
            """SELECT DISTINCT athlete_id, "Block" AS block, "Date", "Exercise",
  true AS found, "Exercise" AS raw_exercise FROM log
UNION ALL SELECT DISTINCT athlete_id, "Block", "Date", 'Paused ' || "Exercise",
  false, NULL FROM log WHERE "Reps" = 3
UNION ALL SELECT DISTINCT athlete_id, "Block", "Date", 'low BAR',
  true, "Exercise" FROM log WHERE "Exercise" = 'Low Bar Squat'""",
        ),
        # one-rep max
        "rm_epley": _value("epley"),
        "rm_brzycki": _value("brzycki"),
        "rm_lombardi": _value("lombardi"),
        "rpe_table": _with(
            METHODS,
            """SELECT CAST(t_reps AS BIGINT) AS reps, CAST(t_rpe AS BIGINT) AS rpe,
  count(*) AS entries, CAST(pct AS DOUBLE) AS pct
FROM log JOIN percent ON round_even("Reps", 0) = t_reps AND round_even("RPE", 0) = t_rpe
GROUP BY ALL""",
        ),
        "rm_rpe": _value("rpe_based"),
        "rm_best": _value("est"),
        "rm_all_methods": _with(
            METHODS, f"SELECT {_ENTRY}, {_METHOD_COLUMNS} FROM estimates"
        ),
        "with_1rm": _with(RM, _annotated("rm")),
        "with_1rm_strict": _with(
            STRICT, f"SELECT {_LOG_COLUMNS}, round(est, 4) AS estimated_1rm FROM strict"
        ),
        # progress
        "rm_progression": _with(
            RM,
            f"""SELECT {_KEYS}, "Date", round(max(est), 4) AS estimated_1rm FROM rm
WHERE est IS NOT NULL GROUP BY ALL""",
        ),
        "rm_progression_rpe": _with(
            RM,
            f"""SELECT {_KEYS}, "Date", round(max(rpe_based), 4) AS estimated_1rm
FROM rm WHERE rpe_based IS NOT NULL AND "Lift_Type" = 'Bench' GROUP BY ALL""",
        ),
        "max_1rm_by_lift": _with(
            RM,
            f"""SELECT {_KEYS}, round(est, 4) AS "Max_1RM", "Date",
  "Load" AS "Weight_Used", "Reps", "RPE" FROM rm
QUALIFY row_number() OVER (PARTITION BY {_KEYS} ORDER BY est DESC NULLS LAST,
  "Date" NULLS LAST, "Load" NULLS LAST, "Reps" NULLS LAST, "RPE" NULLS LAST) = 1""",
        ),
        "recent_progress": _with(
            _DAILY_90,
            f"""SELECT {_KEYS}, round(max(est), 4) AS "Recent_Max_1RM",
  count(*) AS "Entries" FROM aged WHERE recent GROUP BY ALL""",
        ),
        "progress_delta": _with(
            _DAILY_90,
            f"""SELECT {_KEYS}, round(max(est), 4) AS "Max_1RM",
  round(max(est) FILTER (WHERE recent), 4) AS "Recent_Max_1RM",
  CASE WHEN bool_or(recent)
    THEN round(max(est) FILTER (WHERE recent) - max(est), 4) ELSE 0 END AS "Progress"
FROM aged GROUP BY ALL""",
        ),
        "workout_stats": _with(
            LOG,
            """SELECT athlete_id, count(DISTINCT "Date") AS total_workouts,
  count(*) AS total_entries, min("Date") AS first_workout, max("Date") AS last_workout,
  count(*) FILTER (WHERE "Lift_Type" <> 'Accessory') AS main_lift_entries,
  count(*) FILTER (WHERE "Lift_Type" = 'Accessory') AS accessory_entries,
  max("Date") - min("Date") AS date_range_days,
  round(count(DISTINCT "Date") / greatest(1, (max("Date") - min("Date")) / 7), 4)
    AS workouts_per_week
FROM log GROUP BY ALL""",
        ),
        "rep_prs": _with(
            _REP_PRS,
            f"""SELECT {_KEYS}, "Reps", "Load" AS "Max_Weight",
  CASE WHEN "Load" IS NOT NULL THEN "Date" END AS "Date",
  CASE WHEN "Load" IS NOT NULL THEN "Exercise" END AS "Exercise" FROM prs""",
        ),
        "rep_pr_matrix": _with(
            LOG,
            """SELECT athlete_id, "Reps",
  coalesce(max("Load") FILTER (WHERE "Lift_Type" = 'Bench'), 0) AS "Bench",
  coalesce(max("Load") FILTER (WHERE "Lift_Type" = 'Deadlift'), 0) AS "Deadlift",
  coalesce(max("Load") FILTER (WHERE "Lift_Type" = 'Squat'), 0) AS "Squat"
FROM log WHERE "Lift_Type" <> 'Accessory' AND "Reps" <= 10 GROUP BY ALL""",
        ),
        "progression_series": _with(
            _PROGRESSION,
            f'SELECT {_KEYS}, "Date", round(est, 4) AS estimated_1rm FROM points',
        ),
        "weekly_rpe": _with(
            LOG,
            f"""SELECT {_KEYS}, {_WEEK} AS "Week", round_even(avg("RPE"), 1) AS "RPE"
FROM log WHERE {_MAIN} AND {_IN_RANGE} AND "RPE" > 0 GROUP BY ALL""",
        ),
        "weekly_volume": _with(
            LOG,
            f"""SELECT {_KEYS}, {_WEEK} AS "Week",
  round(coalesce(sum("Sets" * "Reps" * "Load"), 0), 4) AS volume
FROM log WHERE {_MAIN} AND {_IN_RANGE} GROUP BY ALL""",
        ),
        "monthly_frequency": _with(
            LOG,
            f""",
monthly AS (SELECT athlete_id, CAST(date_trunc('month', "Date") AS DATE) AS "Month",
    count(DISTINCT "Date") AS "Workouts" FROM log WHERE {_IN_RANGE} GROUP BY ALL),
typical AS (SELECT athlete_id, avg("Workouts") AS a FROM monthly GROUP BY ALL)
SELECT athlete_id, "Month", "Workouts", round(a, 4) AS "Average",
  "Workouts" < a / 2 AS "Low_Activity" FROM monthly JOIN typical USING (athlete_id)""",
        ),
        "recent_prs": _with(
            _REP_PRS,
            f"""SELECT {_KEYS}, "Reps", "Load" AS "Max_Weight", "Date" FROM prs
WHERE "Load" IS NOT NULL AND "Date" >= DATE '{AS_OF}' - 360
QUALIFY row_number() OVER (PARTITION BY athlete_id
  ORDER BY "Date" DESC, "Lift_Type", "Reps") <= 8""",
        ),
        "competition_bests": _with(
            MEETS_LONG,
            f"""SELECT {_KEYS}, "Load" AS "Best_Weight", "Date", "Place" FROM meets_long
QUALIFY row_number() OVER (PARTITION BY {_KEYS} ORDER BY "Load" DESC, "Date",
  "Place") = 1""",
        ),
        "meet_results_recent": _with(
            MEETS_LONG,
            f"""SELECT athlete_id, "Date", "Lift_Type", "Load", "Place", "Total"
FROM meets_long QUALIFY row_number() OVER (PARTITION BY athlete_id
  ORDER BY "Date" DESC, "Lift_Type", "Load", "Place", "Total") <= 8""",
        ),
        "overlay_series": _with(
            _PROGRESSION + "," + MEETS_LONG,
            f"""SELECT {_KEYS}, "Date", round(est, 4) AS "Weight",
  NULL::VARCHAR AS "Place", 'Training' AS source FROM points
UNION ALL SELECT {_KEYS}, "Date", "Load", "Place", 'Meets' FROM meets_long
WHERE {_IN_RANGE}""",
        ),
        "default_goal": _with(
            RM,
            f"""SELECT athlete_id, lift AS "Lift_Type",
  coalesce(CAST(floor(max(est)) AS BIGINT) + 25, 400) AS goal
FROM (SELECT DISTINCT athlete_id FROM rm)
CROSS JOIN (VALUES ('Squat'), ('Bench'), ('Deadlift')) AS lifts(lift)
LEFT JOIN rm USING (athlete_id)
WHERE "Lift_Type" = lift OR "Lift_Type" IS NULL GROUP BY ALL""",
        ),
        # competition
        "search_lifter": _with(
            _SEARCH,
            'SELECT query, CAST(tier AS BIGINT) AS tier, "Name", "Date", "MeetName"'
            " FROM hits",
        ),
        "search_lifter_regex": _with(
            MEETS
            + """,
hits AS (
  SELECT 'customer#0+7$' AS query, 1 AS tier, * FROM meets
    WHERE regexp_matches(lower("Name"), 'customer#0+7$')
  UNION ALL SELECT '^customer#[0-9]*[02]{2}$', 1, * FROM meets
    WHERE right("Name", 2) IN ('00', '02', '20', '22')
  UNION ALL SELECT '1{2}$ ^cust', 2, * FROM meets
    WHERE "Name" LIKE '%11' AND lower("Name") LIKE 'cust%'
  UNION ALL SELECT 'zz y', 2, * FROM meets)""",
            'SELECT query, CAST(tier AS BIGINT) AS tier, "Name", "Date", "MeetName"'
            " FROM hits",
        ),
        "lifter_meets": _with(
            _SEARCH,
            f"""SELECT query, "Date", "MeetName", "Federation", "Division", "Place",
  {_ROUND_MEETS} FROM hits WHERE query <> 'a 1'""",
        ),
        "kg_to_lbs": _with(
            MEETS,
            f"""SELECT athlete_id, "Name", "Date", "MeetName", "Federation", "Division",
  "Place", {_ROUND_MEETS},
  round_even("Best3SquatKg" * 2.20462, 1) AS "Best3SquatLbs",
  round_even("Best3BenchKg" * 2.20462, 1) AS "Best3BenchLbs",
  round_even("Best3DeadliftKg" * 2.20462, 1) AS "Best3DeadliftLbs",
  round_even("TotalKg" * 2.20462, 1) AS "TotalLbs" FROM meets""",
        ),
        "meets_long": _with(
            MEETS_LONG,
            'SELECT * REPLACE (round("Dots", 4) AS "Dots") FROM meets_long',
        ),
        "integrate_meets": _with(
            LOG + "," + MEETS_LONG,
            f"""SELECT {_LOG_COLUMNS}, false AS "Meet_Result", NULL::VARCHAR AS "Place",
  NULL::DOUBLE AS "Total", NULL::DOUBLE AS "Dots" FROM log
UNION ALL SELECT {_LOG_COLUMNS}, "Meet_Result", "Place", "Total", round("Dots", 4)
FROM meets_long""",
        ),
        "meets_profile": _with(
            MEETS,
            """SELECT count(*) AS entries, min("Date") AS first_date,
  max("Date") AS last_date, count(DISTINCT "Federation") AS federations FROM meets""",
        ),
        "latest_meet": _with(
            MEETS,
            """SELECT "Name", "Date", "MeetName", round("TotalKg", 4) AS "TotalKg"
FROM meets QUALIFY row_number() OVER (PARTITION BY "Name" ORDER BY "Date" DESC,
  "MeetName", "TotalKg") = 1""",
        ),
        # trend
        "progression_prep": _with(
            PLAIN,
            f"""SELECT {_KEYS}, "Date", round(est, 4) AS estimated_1rm,
  "Date" - min("Date") OVER (PARTITION BY {_KEYS}) AS days_since_start FROM series""",
        ),
        "main_exercise": _with(FILTERED, "SELECT * FROM every_key"),
        "progression_filtered": _with(
            FILTERED,
            f"""SELECT {_KEYS}, "Date", round(est, 4) AS estimated_1rm,
  "Date" - min("Date") OVER (PARTITION BY {_KEYS}) AS days_since_start FROM series""",
        ),
        "trend_fit": _with(PLAIN_FIT, f"SELECT {_KEYS}, {_FIT_SHOWN} FROM model"),
        "trend_fit_robust": _with(
            ROBUST_FIT, f"SELECT {_KEYS}, main_exercise, {_FIT_SHOWN} FROM model"
        ),
        "forecast": _with(
            PLAIN_FIT,
            f"""SELECT {_KEYS}, first_day + CAST(last_day + ahead AS INTEGER)
    AS forecast_date, round({_at("last_day + ahead")}, 4) AS value
FROM model CROSS JOIN range(1, 181) AS r(ahead) WHERE ok""",
        ),
        "trend_metrics": _with(
            PLAIN_FIT, f"SELECT {_KEYS}, {_FIT_SHOWN}, {_metrics(180)} FROM model"
        ),
        "trend_metrics_robust": _with(
            ROBUST_FIT,
            f"SELECT {_KEYS}, main_exercise, {_FIT_SHOWN}, {_metrics(180)} FROM model",
        ),
        "goal_timeline": _with(
            f"""{PLAIN_FIT},{_GOALS},
wanted AS (SELECT * FROM model JOIN goals USING ("Lift_Type")),
reached AS (SELECT {_KEYS}, target, min(ahead) AS ahead
  FROM wanted CROSS JOIN range(1, 731) AS r(ahead)
  WHERE ok AND {_at("last_day + ahead")} >= target GROUP BY ALL),
timed AS (SELECT *, ok AND target > current AS pending,
    first_day + CAST(last_day + ahead AS INTEGER) AS day
  FROM wanted LEFT JOIN reached USING ({_KEYS}, target))""",
            f"""SELECT {_KEYS}, n AS data_points, target,
  round(current_1rm, 4) AS current_1rm, model_type, round(r2_score, 4) AS r2_score,
  {_metrics(730)},
  CASE WHEN NOT ok THEN 'insufficient' WHEN target <= current THEN 'already_achieved'
    WHEN ahead IS NULL THEN 'unreachable' ELSE 'reachable' END AS status,
  CASE WHEN pending THEN day END AS target_date,
  CASE WHEN pending THEN day - DATE '{AS_OF}' END AS days_to_target,
  CASE WHEN pending THEN round((day - DATE '{AS_OF}') / 30.44, 4) END
    AS months_to_target
FROM timed""",
        ),
        "goal_timeline_linear": _linear_goals(
            "\ngoals(\"Lift_Type\", target) AS (VALUES ('Squat', 600.0::DOUBLE))"
        ),
        "goal_grid": _linear_goals(_GOALS),
        "meet_attempts": _with(
            f"""{PLAIN_FIT},
ahead AS (SELECT *, CAST(DATE '{MEET_DATE}' - DATE '{AS_OF}' AS BIGINT) AS days_to_meet
  FROM model),
day AS (SELECT *, greatest(last_day + 1, least(DATE '{MEET_DATE}' - first_day,
    last_day + days_to_meet + 30)) AS day FROM ahead),
p AS (SELECT *, CASE WHEN ok THEN {_at("day")} END AS predicted FROM day)""",
            f"""SELECT {_KEYS}, {_FIT_SHOWN}, DATE '{MEET_DATE}' AS meet_date,
  days_to_meet, round(predicted, 4) AS predicted_1rm,
  round(0.9 * predicted, 4) AS opener, round(0.97 * predicted, 4) AS second_attempt,
  round(1.03 * predicted, 4) AS third_attempt,
  round(CASE WHEN ok THEN least(r2_score, 0.95) END, 4) AS confidence FROM p""",
        ),
        "model_compare": f"""
WITH plain AS (WITH {PLAIN_FIT}
  SELECT {_KEYS}, {_FIT_SHOWN}, {_metrics(180)} FROM model),
robust AS (WITH {ROBUST_FIT}
  SELECT {_KEYS}, {_FIT_SHOWN}, {_metrics(180)} FROM model)
SELECT {_KEYS}, plain.status AS plain_status,
  plain.current_1rm AS plain_current_1rm, plain.monthly_gain AS plain_monthly_gain,
  plain.data_points AS plain_data_points, plain.r2_score AS plain_r2_score,
  robust.status AS robust_status, robust.current_1rm AS robust_current_1rm,
  robust.monthly_gain AS robust_monthly_gain,
  robust.data_points AS robust_data_points, robust.r2_score AS robust_r2_score
FROM plain FULL JOIN robust USING ({_KEYS})""",
        # optimisation
        "rep_band_stats": _with(
            _BANDS,
            f"""SELECT {_KEYS}, band_no, rep_range,
  round(r, 4) AS correlation_with_progress, round(average_1rm, 4) AS average_1rm,
  round(total_volume, 4) AS total_volume, session_count,
  round(total_volume / session_count, 4) AS avg_volume_per_session FROM bands""",
        ),
        "rep_band_rank": _with(
            _BANDS,
            f"""SELECT {_KEYS}, rep_range, round(r, 4) AS correlation_with_progress,
  row_number() OVER w AS rank, row_number() OVER w = 1 AS recommended FROM bands
WINDOW w AS (PARTITION BY {_KEYS} ORDER BY r DESC NULLS LAST, band_no)""",
        ),
        "weekly_sessions": _with(
            _WEEKLY,
            f"""SELECT {_KEYS}, "Week", sessions AS "Sessions",
  round(best, 4) AS "Best_1RM" FROM weekly""",
        ),
        "frequency_stats": _with(
            _FREQUENCY,
            f"""SELECT {_KEYS}, sessions AS "Sessions",
  round(average_1rm, 4) AS average_1rm, week_count,
  round(r, 4) AS progress_correlation,
  CASE WHEN week_count >= 4 THEN 'Good' ELSE 'Limited' END AS sample_size FROM freq""",
        ),
        "optimal_frequency": _with(
            _FREQUENCY
            + f""",
best AS (SELECT {_KEYS}, sessions AS optimal_frequency FROM freq
  QUALIFY row_number() OVER (PARTITION BY {_KEYS}
    ORDER BY average_1rm DESC NULLS LAST, sessions) = 1),
overall AS (SELECT {_KEYS}, count(*) >= 4 AS ok, avg(sessions) AS average_frequency,
    min(sessions) || '-' || max(sessions) AS frequency_range FROM weekly GROUP BY ALL)""",
            f"""SELECT {_KEYS}, optimal_frequency,
  CASE WHEN ok THEN round(average_frequency, 4) END AS average_frequency,
  CASE WHEN ok THEN frequency_range END AS frequency_range,
  CASE WHEN ok THEN 'ok' ELSE 'insufficient' END AS status
FROM overall LEFT JOIN best USING ({_KEYS})""",
        ),
        "weekly_volume_stats": _with(
            _VOLUME,
            f"""SELECT {_KEYS}, "Week", round(vol, 4) AS "Weekly_Volume",
  round(best, 4) AS "Best_1RM" FROM loaded""",
        ),
        "volume_buckets": _with(
            _VOLUME,
            f"""SELECT {_KEYS}, CAST(bucket_no AS BIGINT) AS bucket_no,
  round(average_1rm, 4) AS average_1rm, week_count,
  round(avg_volume, 4) AS avg_volume, volume_range, bucket FROM named""",
        ),
        "optimal_volume": _with(
            _VOLUME,
            _status(f"""SELECT {_KEYS}, bucket AS optimal_volume_bucket,
  round(avg_volume, 4) AS optimal_volume FROM named
QUALIFY row_number() OVER (PARTITION BY {_KEYS}
  ORDER BY average_1rm DESC NULLS LAST, bucket_no) = 1""", "rm"),
        ),
        "volume_advice": _with(
            _VOLUME
            + f""",
linked AS (SELECT {_KEYS}, {_corr('vol', 'best')} AS r, avg(vol) AS mean_volume
  FROM loaded GROUP BY ALL)""",
            _status(f"""SELECT {_KEYS}, round(r, 4) AS volume_correlation,
  round(mean_volume, 4) AS average_weekly_volume,
  CASE WHEN r > 0.3 THEN 'Increase' WHEN r > -0.3 THEN 'Maintain'
    ELSE 'Decrease' END AS volume_recommendation FROM linked""", "rm"),
        ),
        # diagnostics
        "recent_daily": _recent(
            f"""SELECT {_KEYS}, "Date", round(est, 4) AS estimated_1rm, load AS "Load",
  exercise AS "Exercise" FROM placed WHERE pos > sessions - 10"""
        ),
        "session_trend": _recent(
            _status(f"""SELECT {_KEYS}, count(*) AS sessions,
  round(regr_slope(est, pos), 4) AS per_session,
  round(8 * regr_slope(est, pos), 4) AS per_month
FROM placed GROUP BY {_KEYS} HAVING count(*) >= 3""", "strict")
        ),
        "high_low": _recent(
            _status(f"""SELECT {_KEYS}, round(max(est), 4) AS highest,
  min("Date") FILTER (WHERE est = top) AS highest_date, round(min(est), 4) AS lowest,
  min("Date") FILTER (WHERE est = bottom) AS lowest_date
FROM (SELECT *, max(est) OVER (PARTITION BY {_KEYS}) AS top,
  min(est) OVER (PARTITION BY {_KEYS}) AS bottom FROM placed)
GROUP BY {_KEYS} HAVING count(*) >= 3""", "strict")
        ),
        "exercise_variants": _recent(
            _status(f"""SELECT DISTINCT {_KEYS}, "Exercise", n_exercises,
  n_exercises > 1 AS several FROM recent JOIN (SELECT {_KEYS},
    count(DISTINCT "Exercise") AS n_exercises FROM recent GROUP BY ALL
    HAVING count(DISTINCT "Date") >= 3)
USING ({_KEYS})""", "strict")
        ),
        "load_variability": _recent(
            _status(f"""SELECT {_KEYS}, round(stddev_samp(load), 4) AS load_std,
  round(avg(load), 4) AS load_mean,
  stddev_samp(load) > 0.3 * avg(load) AS high_variability
FROM placed GROUP BY {_KEYS} HAVING count(*) >= 3""", "strict")
        ),
        "rep_breakdown": _recent(
            _status(f"""SELECT {_KEYS}, "Reps", count(*) AS count,
  round_even(avg(est), 4) AS mean
FROM recent SEMI JOIN (SELECT {_KEYS} FROM placed WHERE sessions >= 3) USING ({_KEYS})
GROUP BY {_KEYS}, "Reps\"""", "strict")
        ),
        "recent_vs_earlier": _recent(
            f""",
sides AS (SELECT {_KEYS}, avg(est) FILTER (WHERE pos > sessions - 7) AS late,
    avg(est) FILTER (WHERE pos <= CASE WHEN sessions >= 14 THEN 7
      ELSE sessions // 2 END) AS early
  FROM placed WHERE sessions >= 3 GROUP BY {_KEYS})
"""
            + _status(f"""SELECT {_KEYS}, round(late, 4) AS recent_avg,
  round(early, 4) AS earlier_avg,
  round(late - early, 4) AS change, CASE WHEN late - early < -20 THEN 'deload'
    WHEN late - early > 20 THEN 'improved' ELSE 'steady' END AS verdict FROM sides""",
                "strict")
        ),
        "top_exercises": _with(
            STRICT,
            f"""SELECT {_KEYS}, "Exercise", count(*) AS entries FROM strict
GROUP BY {_KEYS}, "Exercise" QUALIFY row_number() OVER (PARTITION BY {_KEYS}
  ORDER BY count(*) DESC, "Exercise") <= 3""",
        ),
        "recent_load_drop": _with(
            STRICT
            + f""",
flagged AS (SELECT *, "Date" >= DATE '{AS_OF}' - 90 AS recent FROM strict)""",
            f"""SELECT {_KEYS}, max("Load") FILTER (WHERE recent) AS recent_max,
  round(avg("Load") FILTER (WHERE recent), 4) AS recent_mean,
  max("Load") AS overall_max,
  max("Load") FILTER (WHERE recent) < 0.85 * max("Load") AS dropped,
  CASE WHEN bool_or(recent) THEN 'ok' ELSE 'insufficient' END AS status
FROM flagged GROUP BY {_KEYS}""",
        ),
        "window_sweep": _with(
            f"""{STRICT},
newest AS (SELECT athlete_id, max("Date") AS newest FROM strict GROUP BY ALL),
every_key AS (SELECT DISTINCT {_KEYS}, window_days FROM strict
  CROSS JOIN (VALUES (90), (180), (365)) AS w(window_days)),
series AS (SELECT {_KEYS}, window_days, "Date", max(est) AS est
  FROM strict JOIN newest USING (athlete_id)
  CROSS JOIN (VALUES (90), (180), (365)) AS w(window_days)
  WHERE "Date" >= newest - window_days GROUP BY ALL),
{_fit("series", _KEYS + ", window_days")},
{_chosen("every_key", False, _KEYS + ", window_days")}""",
            f"""SELECT {_KEYS}, CAST(window_days AS BIGINT) AS window_days, {_FIT_SHOWN},
  {_metrics(180)} FROM model""",
        ),
    }
