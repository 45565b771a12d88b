"""One DuckDB statement per registered query."""

from __future__ import annotations

import math

from oracle.sql import BASE, CTES, HOLDOUT, SIDE_LINES, START, TOTAL_LINES, dispersion, dot, nll, over, query, r

SAMPLES = 1000
BLOCK_SAMPLES = 2000
SEED = 7
SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
PAIRS = (
    ("team_decay_180", "expanding_event_rate"),
    ("team_arithmetic", "expanding_event_rate"),
    ("team_multiplicative", "expanding_event_rate"),
    ("team_decay_180", "team_arithmetic"),
    ("team_decay_180", "team_multiplicative"),
) + tuple((m + "_dc", m) for m in BASE)
WHITE = "' ' || chr(9) || chr(10) || chr(13)"


def stripped(cell: str) -> str:
    return f"trim(coalesce({cell}, ''), {WHITE})"


def parsed_count(cell: str) -> str:
    text = stripped(cell)
    value = f"try_cast({text} AS DOUBLE)"
    return (
        f"CASE WHEN regexp_full_match({text}, '[+-]?([0-9]+(\\.[0-9]*)?|\\.[0-9]+)([eE][+-]?[0-9]+)?') AND {value} >= 0 "
        f"AND {value} = floor({value}) THEN CAST({value} AS INTEGER) END"
    )


def reason(cell: str, parsed: str, side: str) -> str:
    return (
        f"CASE WHEN {stripped(cell)} = '' THEN '{side} count is missing' "
        f"WHEN {parsed} IS NULL THEN '{side} count is not a non-negative integer' END"
    )


def joined(items: list[str]) -> str:
    return f"array_to_string(list_filter([{', '.join(items)}], lambda x: x IS NOT NULL), '; ')"


#: A forecast can be scored if its mean and dispersion define a distribution.
VALID = "expected > 0 AND dispersion >= 0 AND isfinite(expected) AND isfinite(dispersion)"


def _brier(lines, actual="actual", prefix="p_") -> str:
    terms = " + ".join(f"pow({prefix}{dot(x)} - ({actual} > {x})::INT, 2)" for x in lines)
    return f"(({terms}) / {len(lines)}.0)"


def _metrics(lines) -> str:
    of = lambda value: f"avg({value}) FILTER ({VALID})"
    return ", ".join(
        [
            f"count(*) FILTER ({VALID}) AS n",
            f"count(*) - count(*) FILTER ({VALID}) AS n_unscored",
            r(of("expected"), "mean_predicted"),
            r(of("actual"), "mean_actual"),
            r(of("abs(actual - expected)"), "mae"),
            r(f"sqrt({of('pow(actual - expected, 2)')})", "rmse"),
            r(of("nll"), "nll"),
            r(of(_brier(lines)), "mean_brier"),
        ]
    )


def _by_line(source: str, lines, keys: str, under: bool = False) -> str:
    parts = []
    for x in lines:
        p, y = f"p_{dot(x)}", f"(actual > {x})::INT"
        columns = [
            f"{x}::DOUBLE AS line",
            r(f"avg(pow({p} - {y}, 2)) FILTER ({VALID})", "brier"),
            r(f"avg({p}) FILTER ({VALID})", "predicted_over"),
            r(f"avg({y}) FILTER ({VALID})", "actual_over"),
        ]
        if under:
            columns += [r(f"1 - avg({p}) FILTER ({VALID})", "predicted_under"), r(f"1 - avg({y}) FILTER ({VALID})", "actual_under")]
        counts = f"count(*) FILTER ({VALID}) AS n, count(*) - count(*) FILTER ({VALID}) AS n_unscored"
        parts.append(f"SELECT {keys}, {counts}, {', '.join(columns)} FROM {source} GROUP BY {keys}")
    return " UNION ALL ".join(parts)


def _p_columns(lines) -> str:
    return ", ".join(r(f"p_{dot(x)}", f"p_{dot(x)}") for x in lines)


MASK = 4294967295


def mixed(x: str) -> str:
    for _ in range(2):
        x = f"((xor({x}, ({x}) >> 16) * 73244475) & {MASK})"
    return f"xor({x}, ({x}) >> 16)"


def sample_key(sample: str) -> str:
    return mixed(f"(({SEED * 2654435761 % (MASK + 1)}::BIGINT + {sample}) & {MASK})")


def drawn(key: str, draw: str) -> str:
    return mixed(f"xor((({draw})::BIGINT * 2654435761) & {MASK}, {key})")


def summary(samples: int) -> str:
    low, high = int(0.025 * (samples - 1)) + 1, int(0.975 * (samples - 1)) + 1
    return ", ".join(
        [
            r("avg(delta)", "mean_delta"),
            r(f"list_sort(list(delta))[{low}]", "lower_95"),
            r(f"list_sort(list(delta))[{high}]", "upper_95"),
            r(f"count(*) FILTER (delta < 0) / {samples}.0::DOUBLE", "share_below_zero"),
        ]
    )


CTES["raw"] = (
    ("log",),
    """
    SELECT match_id, home_team AS host,
      CASE WHEN match_id % 131 = 11 THEN 'E0' WHEN match_id % 3 = 0 THEN ' ' || competition ELSE competition END AS div,
      CASE WHEN match_id % 101 = 7 THEN strftime(match_date, '%Y-%m-%d')
           WHEN match_id % 103 = 9 THEN '31/02/' || strftime(match_date, '%Y')
           WHEN match_id % 5 = 1 THEN strftime(match_date, '%d/%m/%y')
           WHEN match_id % 7 = 2 THEN ' ' || strftime(match_date, '%d/%m/%Y') || chr(9)
           ELSE strftime(match_date, '%d/%m/%Y') END AS day,
      CASE WHEN match_id % 137 = 12 THEN '  ' ELSE home_team END AS home,
      CASE WHEN match_id % 139 = 13 THEN lower(home_team) ELSE away_team END AS away,
      home_goals, away_goals, season,
      CASE WHEN match_id % 89 = 3 THEN '' WHEN match_id % 97 = 4 THEN ' ' WHEN match_id % 107 = 5 THEN 'not-a-number'
           WHEN match_id % 109 = 6 THEN '-1' WHEN match_id % 113 = 8 THEN '2.5'
           WHEN match_id % 11 = 3 THEN home_count || '.0' WHEN match_id % 13 = 4 THEN ' ' || home_count || 'e0 ' ELSE home_count::VARCHAR END AS hc,
      CASE WHEN match_id % 89 = 3 THEN NULL WHEN match_id % 127 = 10 THEN 'nan' ELSE away_count::VARCHAR END AS ac,
      'E1_' || season || '.csv' AS file_name
    FROM log""",
)
_DAY = stripped("day")
CTES["typed"] = (
    ("raw",),
    f"""
    SELECT *, {stripped('div')} AS competition, {stripped('home')} AS home_team, {stripped('away')} AS away_team,
      CAST(CASE WHEN regexp_matches({_DAY}, '/[0-9][0-9][0-9][0-9]$') THEN try_strptime({_DAY}, '%d/%m/%Y')
           WHEN regexp_matches({_DAY}, '/[0-9][0-9]$') THEN try_strptime({_DAY}, '%d/%m/%y') END AS DATE) AS match_date,
      {parsed_count('hc')} AS home_count, {parsed_count('ac')} AS away_count
    FROM raw""",
)
_FAULTS = joined(
    [
        "CASE WHEN match_date IS NULL THEN 'unsupported match date' END",
        "CASE WHEN competition = '' THEN 'competition must not be empty' END",
        "CASE WHEN home_team = '' THEN 'home_team must not be empty' END",
        "CASE WHEN away_team = '' THEN 'away_team must not be empty' END",
        "CASE WHEN lower(home_team) = lower(away_team) THEN 'home_team and away_team must be different' END",
        reason("hc", "home_count", "home"),
        reason("ac", "away_count", "away"),
    ]
)
CTES["judged"] = (
    ("typed",),
    f"""
    SELECT *, {_FAULTS} AS faults,
      CASE WHEN {stripped('hc')} = '' AND {stripped('ac')} = '' THEN 'no_result' WHEN {_FAULTS} <> '' THEN 'quarantined' ELSE 'loaded' END AS status
    FROM typed""",
)
CTES["goal_fc"] = (
    ("goal_rows", "goal_wide", "rho"),
    f"""
    WITH both_p AS (
      SELECT g.match_id, g.match_date, g.season, g.home_goals, g.away_goals, g.model, g.h, g.a, rho.rho,
        1 - exp(-(h + a)) * (1 + (h + a) + (h + a) * (h + a) / 2) AS po, (1 - exp(-h)) * (1 - exp(-a)) AS pb
      FROM goal_rows g JOIN rho USING (competition, model, match_date)
    ),
    models AS (
      SELECT match_id, match_date, season, home_goals, away_goals, 'coin_0_5' AS model, 0.5::DOUBLE AS po, 0.5::DOUBLE AS pb, NULL::DOUBLE AS rho FROM goal_wide WHERE match_date >= {START}
      UNION ALL SELECT match_id, match_date, season, home_goals, away_goals, 'expanding_event_rate', (over_n + 1)::DOUBLE / (n + 2), (btts_n + 1)::DOUBLE / (n + 2), NULL FROM goal_wide WHERE match_date >= {START}
      UNION ALL SELECT match_id, match_date, season, home_goals, away_goals, model, po, pb, NULL FROM both_p
      UNION ALL SELECT match_id, match_date, season, home_goals, away_goals, model || '_dc', po, pb - rho * h * a * exp(-h - a), rho FROM both_p
    )
    SELECT match_id, match_date, season, model, 'over_2_5' AS target, po AS p, (home_goals + away_goals >= 3)::INT AS y, rho FROM models
    UNION ALL SELECT match_id, match_date, season, model, 'btts_yes', pb, (home_goals > 0 AND away_goals > 0)::INT, rho FROM models""",
)
CTES["side_pairs"] = (
    ("side_fc",),
    f"""
    SELECT c.match_id, c.venue, c.match_date, c.competition, c.home_team, c.away_team, c.home_count, c.away_count,
      abs(c.actual - c.expected) - abs(b.actual - b.expected) AS mae_delta,
      {_brier(SIDE_LINES, 'c.actual', 'c.p_')} - {_brier(SIDE_LINES, 'b.actual', 'b.p_')} AS brier_delta
    FROM side_fc c JOIN side_fc b ON c.match_id = b.match_id AND c.venue = b.venue AND c.model = 'team_opponent' AND b.model = 'venue_average'""",
)
CTES["fixture_deltas"] = (
    ("side_pairs",),
    """
    SELECT match_date, competition, home_team, away_team, home_count, away_count, avg(mae_delta) AS mae_delta, avg(brier_delta) AS brier_delta, count(*) AS observations
    FROM side_pairs GROUP BY ALL""",
)
CTES["boot_units"] = (
    ("fixture_deltas",),
    """
    SELECT *, md5(concat_ws('|', match_date::VARCHAR, competition, home_team, away_team, home_count::VARCHAR, away_count::VARCHAR)) AS tag,
      row_number() OVER (ORDER BY md5(concat_ws('|', match_date::VARCHAR, competition, home_team, away_team, home_count::VARCHAR, away_count::VARCHAR))) - 1 AS idx
    FROM fixture_deltas""",
)
CTES["decay_deltas"] = (
    ("decay_fc",),
    " UNION ALL ".join(
        f"""SELECT 'time_weighted_180_minus_{base}' AS pair, c.match_id, c.match_date, c.competition, c.season, c.venue,
          {_brier(SIDE_LINES, 'c.actual', 'c.p_')} - {_brier(SIDE_LINES, 'b.actual', 'b.p_')} AS brier_delta
        FROM decay_fc c JOIN decay_fc b ON c.match_id = b.match_id AND c.venue = b.venue AND c.model = 'time_weighted_180' AND b.model = '{base}'"""
        for base in ("equal_weight", "retained")
    ),
)
_BLOCK = "(match_date - DATE '1970-01-01' + 719163) // 28"


def block_sql(needs, blocks: str, keys: str) -> str:
    return query(
        needs,
        f"""
    SELECT * FROM (SELECT {keys}, {r('sum(s) / sum(n)', 'delta_brier')}, count(*) AS blocks FROM indexed GROUP BY {keys})
    JOIN (SELECT {keys}, {summary(BLOCK_SAMPLES)} FROM ratios GROUP BY {keys}) USING ({keys})""",
        {
            "blocks": blocks,
            "indexed": f"SELECT *, count(*) OVER (PARTITION BY {keys}) AS nb, row_number() OVER (PARTITION BY {keys} ORDER BY block_id) - 1 AS idx FROM blocks",
            "keys": f"SELECT sample, {sample_key('sample')} AS key FROM range(0, {BLOCK_SAMPLES}) s(sample)",
            "draws": f"""SELECT nb, sample, {drawn('key', 'draw')} % nb AS idx
              FROM (SELECT DISTINCT nb FROM indexed), keys, LATERAL (SELECT unnest(range(0, nb)) AS draw)""",
            "ratios": f"SELECT {keys}, sample, sum(s) / sum(n) AS delta FROM draws JOIN indexed USING (nb, idx) GROUP BY {keys}, sample",
        },
    )


def _goal_pairs() -> str:
    return " UNION ALL ".join(
        f"""SELECT '{c}_minus_{b}' AS pair, x.target, x.match_date, pow(x.p - x.y, 2) - pow(z.p - z.y, 2) AS d
        FROM goal_fc x JOIN goal_fc z ON x.match_id = z.match_id AND x.target = z.target AND x.model = '{c}' AND z.model = '{b}'"""
        for c, b in PAIRS
    )


_EVENTS = ", ".join(
    [
        "sum(bn)::BIGINT AS n",
        "sum(bu)::BIGINT AS n_unscored",
        "min(d1) AS first_date",
        "max(d2) AS last_date",
        r("sum(se) / sum(bn)", "brier"),
        r("sum(sp) / sum(bn)", "mean_predicted"),
        r("sum(sy) / sum(bn)", "observed_rate"),
        r("sum(sp) / sum(bn) - sum(sy) / sum(bn)", "calibration_bias"),
        r("sum(bn * abs(sp / bn - sy / bn)) / sum(bn)", "ece"),
    ]
)


def _event_sql(keys: str, source: str = "goal_fc") -> str:
    bins = (
        f"SELECT {keys}, CASE WHEN p >= 0.9 THEN 9 ELSE floor(p * 10)::INT END AS bin, count(p) AS bn, count(*) - count(p) AS bu, "
        "sum(p) AS sp, sum(y) FILTER (p IS NOT NULL)::DOUBLE AS sy, sum(pow(p - y, 2)) AS se, "
        f"min(match_date) AS d1, max(match_date) AS d2 FROM {source} GROUP BY {keys}, bin"
    )
    return f"SELECT {keys}, {_EVENTS} FROM ({bins}) GROUP BY {keys}"


_WINDOWED = f"""(SELECT 'all' AS "window", * FROM goal_fc UNION ALL
  SELECT CASE WHEN match_date < {HOLDOUT} THEN 'development' ELSE 'latest' END, * FROM goal_fc)"""


def _total_scored(alpha: str = "dispersion") -> str:
    return f"SELECT *, {nll('actual', 'expected', alpha)} AS nll FROM total_fc"


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    out["missing_result_filter"] = query("judged", "SELECT match_id, file_name FROM judged WHERE status <> 'no_result'")
    out["quarantine"] = query("judged", "SELECT match_id, file_name, faults FROM judged WHERE status = 'quarantined'")
    out["parse_dates"] = query("typed", 'SELECT match_id, day AS "Date", match_date FROM typed')
    out["parse_counts"] = query("typed", "SELECT match_id, home_count, away_count FROM typed")
    out["contests_canonical"] = query(
        "judged",
        "SELECT match_id, match_date, competition, home_team, away_team, home_count, away_count FROM judged WHERE status = 'loaded'",
    )
    violations = joined(
        [
            "CASE WHEN match_date IS NULL THEN 'match_date must be a date' END",
            "CASE WHEN competition = '' THEN 'competition must not be empty' END",
            "CASE WHEN home_team = '' THEN 'home_team must not be empty' END",
            "CASE WHEN away_team = '' THEN 'away_team must not be empty' END",
            "CASE WHEN lower(home_team) = lower(away_team) THEN 'home_team and away_team must be different' END",
            "CASE WHEN home_count IS NULL THEN 'home_count must be a non-negative integer' END",
            "CASE WHEN away_count IS NULL THEN 'away_count must be a non-negative integer' END",
        ]
    )
    out["constraint_violations"] = query(
        "typed", f"SELECT * FROM (SELECT match_id, {violations} AS violations FROM typed) WHERE violations <> ''"
    )
    out["row_quality"] = query(
        "judged",
        """SELECT file_name, count(*) AS rows_read, count(*) FILTER (status = 'loaded') AS rows_loaded,
        count(*) FILTER (status = 'no_result') AS rows_without_result, count(*) FILTER (status = 'quarantined') AS rows_quarantined
        FROM judged GROUP BY ROLLUP (file_name)""",
    )
    listed = ", ".join(f"'{s}'" for s in SEGMENTS)
    out["unexpected_competitions"] = query(
        "judged", f"SELECT DISTINCT competition FROM judged WHERE status = 'loaded' AND competition NOT IN ({listed})"
    )
    out["duplicate_fixtures"] = query(
        "contests",
        "SELECT competition, match_date, home_team, away_team, count(*) AS n FROM contests GROUP BY ALL HAVING count(*) > 1",
    )
    out["unique_fixtures"] = query("fixtures", "SELECT * FROM fixtures")
    goal_join = "t.match_date = j.match_date AND t.competition = j.competition AND t.home_team = j.home_team AND t.away_team = j.away_team"
    goal_key = "PARTITION BY match_date, competition, home_team, away_team ORDER BY match_id"
    out["goal_contests"] = query(
        "judged",
        f"""SELECT j.match_id, t.home_goals, t.away_goals, t.season, j.home_count, j.away_count
        FROM (SELECT * FROM judged WHERE status = 'loaded' QUALIFY row_number() OVER ({goal_key}) = 1) j
        JOIN (SELECT * FROM typed WHERE match_date IS NOT NULL QUALIFY row_number() OVER ({goal_key}) = 1) t ON {goal_join}""",
    )
    out["excluded_rows"] = query(
        "judged",
        f"SELECT match_id, season FROM typed t WHERE NOT EXISTS (SELECT 1 FROM judged j WHERE j.status = 'loaded' AND {goal_join})",
    )
    fields = "match_date, competition, home_team, away_team"
    out["season_scan"] = query("judged", f"SELECT {fields}, home_count, away_count FROM judged WHERE status = 'loaded'")
    out["season_goals"] = query(
        ("judged", "fixtures"),
        f"""SELECT {fields}, home_goals, away_goals, home_count, away_count FROM judged
        WHERE status = 'loaded' AND match_id IN (SELECT match_id FROM fixtures) AND competition IN ({listed})""",
    )
    out["file_manifest"] = query(
        "typed",
        """SELECT season, count(*) AS rows, min(match_date) AS first_date, max(match_date) AS last_date,
        (SELECT count(DISTINCT team) FROM (SELECT home_team AS team FROM typed i WHERE i.season = t.season
         UNION ALL SELECT away_team FROM typed i WHERE i.season = t.season)) AS teams
        FROM typed t GROUP BY season""",
    )
    out["goal_outcomes"] = query(
        "contests",
        "SELECT match_id, (home_goals + away_goals >= 3)::INT AS over_2_5, (home_goals > 0 AND away_goals > 0)::INT AS btts_yes FROM contests",
    )
    out["observations"] = query(
        "contests",
        """SELECT match_id, 'home' AS venue, home_team AS team, away_team AS opponent, home_count AS count_for, away_count AS count_allowed FROM contests
        UNION ALL SELECT match_id, 'away', away_team, home_team, away_count, home_count FROM contests""",
    )
    out["daily_totals"] = query(
        "contests",
        " UNION ALL ".join(
            f"""SELECT competition, match_date, '{v}' AS venue, {v}_team AS team, count(*) AS n, sum({v}_count)::BIGINT AS count_for,
            sum({o}_count)::BIGINT AS count_allowed, sum({v}_count * {v}_count)::BIGINT AS sq_for,
            sum((home_count + away_count) * (home_count + away_count))::BIGINT AS sq_total FROM contests GROUP BY ALL"""
            for v, o in (("home", "away"), ("away", "home"))
        ),
    )
    out["league_history"] = query(
        "wide",
        """SELECT DISTINCT competition, match_date, n AS past_n, hs::BIGINT AS past_home_sum, aws::BIGINT AS past_away_sum, hq::BIGINT AS past_home_sq,
        aq::BIGINT AS past_away_sq, (hs + aws)::BIGINT AS past_total_sum, tq::BIGINT AS past_total_sq FROM wide""",
    )
    # plain sums of a self-join: DuckDB's window over raw rows has lost a count where it ran on one thread (six copies of sf0.1)
    out["team_history"] = query(
        "contests",
        """SELECT t.competition, t.match_date, t.team, coalesce(sum(h.n), 0)::BIGINT AS past_n, coalesce(sum(h.f), 0)::BIGINT AS past_count_for,
        coalesce(sum(h.a), 0)::BIGINT AS past_count_allowed, t.venue
        FROM days t LEFT JOIN days h ON h.venue = t.venue AND h.competition IS NOT DISTINCT FROM t.competition AND h.team = t.team AND h.match_date < t.match_date
        GROUP BY ALL""",
        {
            "days": " UNION ALL ".join(
                f"""SELECT competition, match_date, {v}_team AS team, '{v}' AS venue, count(*) AS n, sum({v}_count) AS f, sum({o}_count) AS a
            FROM contests GROUP BY ALL"""
                for v, o in (("home", "away"), ("away", "home"))
            )
        },
    )
    out["decayed_history"] = query(
        "dteam",
        f"SELECT competition, match_date, team, {r('wn', 'decayed_n')}, {r('wf', 'decayed_count_for')}, {r('wa', 'decayed_count_allowed')}, venue FROM dteam",
    )
    out["decayed_league_history"] = query(
        "dleague",
        "SELECT competition, match_date, round(ln, 5) + 0.0 AS decayed_n, round(lh, 5) + 0.0 AS decayed_home_sum, round(la, 5) + 0.0 AS decayed_away_sum FROM dleague",
    )
    out["dispersion"] = query(
        "wide",
        f"""SELECT DISTINCT competition, match_date, {r(dispersion('n', 'hs + aws', 'tq'), 'total')}, {r(dispersion('n', 'hs', 'hq'), 'home')},
        {r(dispersion('n', 'aws', 'aq'), 'away')}, {r(dispersion('2 * n', 'hs + aws', 'hq + aq'), 'pooled')} FROM wide""",
    )
    weight = "pow(0.5::DOUBLE, (DATE '2002-01-01' - match_date) / 180.0::DOUBLE)"
    out["time_weight"] = query("contests", f"SELECT match_id, {r(weight, 'weight')} FROM contests")
    out["total_walkforward"] = query(
        "total_fc",
        f"SELECT match_id, match_date, competition, actual, {r('expected', 'expected')}, {r('dispersion', 'dispersion')}, {_p_columns(TOTAL_LINES)} FROM total_fc",
    )
    out["total_metrics"] = query(
        "total_fc", f"SELECT competition, {_metrics(TOTAL_LINES)} FROM scored GROUP BY competition", {"scored": _total_scored()}
    )
    fields = ("n", "n_unscored", "mean_predicted", "mean_actual", "mae", "rmse", "nll", "mean_brier")
    out["report_json"] = query(
        "total_fc",
        "SELECT competition, CAST(to_json({" + ", ".join(f"'{x}': {x}" for x in fields) + "}) AS VARCHAR) AS report FROM metrics",
        {"scored": _total_scored(), "metrics": f"SELECT competition, {_metrics(TOTAL_LINES)} FROM scored GROUP BY competition"},
    )
    out["total_line_metrics"] = query("total_fc", _by_line("total_fc", TOTAL_LINES, "competition", True))
    poisson_p = ", ".join(f"{over('expected', '0.0::DOUBLE', x)} AS p_{dot(x)}" for x in TOTAL_LINES)
    out["poisson_vs_nb"] = query(
        "total_fc",
        f"""SELECT 'negative_binomial' AS model, {_metrics(TOTAL_LINES)} FROM scored
        UNION ALL SELECT 'poisson', {_metrics(TOTAL_LINES)} FROM poisson""",
        {
            "scored": _total_scored(),
            "poisson": f"SELECT actual, expected, 0.0::DOUBLE AS dispersion, {poisson_p}, {nll('actual', 'expected', '0.0::DOUBLE')} AS nll FROM total_fc",
        },
    )
    for name, alpha in (("poisson_over", "0.0::DOUBLE"), ("nb_over", "dispersion")):
        out[name] = query(
            "total_state",
            " UNION ALL ".join(
                f"SELECT competition, match_date, {x}::DOUBLE AS line, {r(over('expected', alpha, x), 'p_over')} FROM total_state"
                for x in (0.5, *TOTAL_LINES)
            ),
        )
    out["long_run_over"] = query(
        "total_state",
        " UNION ALL ".join(
            f"SELECT competition, match_date, {x}::DOUBLE AS line, {r(over('(50 * expected)', '(dispersion / 50)', x), 'p_over')} FROM total_state"
            for x in (450.5, 500.5, 550.5)
        ),
    )
    out["nb_nll"] = query(
        "total_fc",
        f"SELECT match_id, {r(nll('actual', 'expected', 'dispersion'), 'nb_nll')}, {r(nll('actual', 'expected', '0.0::DOUBLE'), 'poisson_nll')} FROM total_fc",
    )
    smooth = lambda total, n: f"({total} + 5.0::DOUBLE * (s::DOUBLE / n)) / ({n} + 5.0::DOUBLE)"
    out["smoothed_rates"] = query(
        "sides",
        f"SELECT match_id, venue, {r(smooth('tf', 'tn'), 'attack')}, {r(smooth('opp_a', 'opp_n'), 'defence')} FROM sides WHERE n > 0 AND match_date >= {START}",
    )
    out["team_walkforward"] = query(
        "side_fc",
        f"SELECT match_id, venue, team, model, actual, {r('expected', 'expected')}, {r('dispersion', 'dispersion')}, {_p_columns(SIDE_LINES)} FROM side_fc",
    )
    out["team_metrics"] = query("side_fc", f"SELECT competition, model, {_metrics(SIDE_LINES)} FROM side_fc GROUP BY competition, model")
    out["team_line_metrics"] = query("side_fc", _by_line("side_fc", SIDE_LINES, "competition, model"))
    out["team_metrics_by_venue"] = query(
        "side_fc", f"SELECT model, venue, {_metrics(SIDE_LINES)} FROM side_fc GROUP BY GROUPING SETS ((model), (model, venue))"
    )
    plain = "avg(abs(actual - expected)) AS mae, sqrt(avg(pow(actual - expected, 2))) AS rmse, avg(nll) AS nll, avg({b}) AS mean_brier".format(b=_brier(SIDE_LINES))
    deltas = ", ".join(r(f"c.{m} - b.{m}", f"{m}_delta") for m in ("mae", "rmse", "nll", "mean_brier"))
    out["metric_differences"] = query(
        "side_fc",
        f"SELECT competition, {deltas} FROM m c JOIN m b USING (competition) WHERE c.model = 'team_opponent' AND b.model = 'venue_average'",
        {"m": f"SELECT competition, model, {plain} FROM side_fc GROUP BY ALL"},
    )
    out["prior_sensitivity"] = query(
        "prior_fc",
        f"SELECT competition, c.prior, {deltas} FROM m c JOIN m b USING (competition) WHERE c.model = 'team_opponent' AND b.model = 'venue_average'",
        {"m": f"SELECT competition, model, prior, {plain} FROM prior_fc GROUP BY ALL"},
    )
    counted = "count(*) AS forecasts, count(*) FILTER (NOT coalesce({valid}, false)) AS unscored"
    out["invalid_scores"] = query(
        ("wide", "sides", "decay_fc", "goal_fc"),
        f"""SELECT 'negative_binomial' AS model, {counted.format(valid='hs + aws > 0')} FROM wide WHERE n > 0
        UNION ALL SELECT 'venue_average', {counted.format(valid='s > 0')} FROM sides WHERE n > 0
        UNION ALL SELECT 'team_opponent', {counted.format(valid='tf + opp_a + s > 0')} FROM sides WHERE n > 0
        UNION ALL SELECT model, count(*), 0 FROM decay_all GROUP BY model
        UNION ALL SELECT model, count(*), count(*) FILTER (p IS NULL) FROM goal_fc GROUP BY model""",
        {
            "decay_all": """SELECT unnest(['retained', 'equal_weight', 'time_weighted_180']) AS model, match_id
              FROM fsides WHERE match_id IN (SELECT match_id FROM fwide WHERE 2 * n >= 100 AND least(hn, an) >= 5)"""
        },
    )
    out["paired_deltas"] = query(
        "fixture_deltas",
        f"SELECT match_date, competition, home_team, away_team, home_count, away_count, {r('mae_delta', 'mae_delta')}, {r('brier_delta', 'brier_delta')}, observations FROM fixture_deltas",
    )
    out["aligned_deltas"] = query(
        "side_pairs", f"SELECT match_id, venue, {r('mae_delta', 'mae_delta')}, {r('brier_delta', 'brier_delta')} FROM side_pairs"
    )
    out["cohort_mismatch"] = query(
        ("fsides", "eligible"),
        f"SELECT match_id, venue, 1::BIGINT AS rows FROM fsides WHERE n > 0 AND match_date >= {START} AND match_id NOT IN (SELECT match_id FROM eligible)",
    )
    out["eligible_fixtures"] = query(
        "eligible", "SELECT match_id, 2 * n AS league_observations, hn AS home_contests, an AS away_contests FROM eligible"
    )
    out["decay_predictions"] = query(
        "decay_fc",
        f"SELECT match_id, venue, model, {r('expected', 'expected')}, {r('dispersion', 'dispersion')}, {_p_columns(SIDE_LINES)} FROM decay_fc",
    )
    out["decay_metrics"] = query("decay_fc", f"SELECT model, {_metrics(SIDE_LINES)} FROM decay_fc GROUP BY model")
    out["block_totals"] = query(
        "decay_deltas",
        f"SELECT competition, pair, {_BLOCK} AS block_id, count(*) AS n, round(sum(brier_delta), 5) + 0.0 AS s FROM decay_deltas GROUP BY ALL",
    )
    out["block_bootstrap"] = block_sql(
        "decay_deltas", f"SELECT pair, {_BLOCK} AS block_id, count(*) AS n, sum(brier_delta) AS s FROM decay_deltas GROUP BY ALL", "pair"
    )
    out["win_counts"] = query(
        ("decay_deltas", "decay_fc"),
        'SELECT pair, "by", count(*) FILTER (d < 0) AS wins, count(*) AS slices FROM per GROUP BY ALL',
        {
            "per": """SELECT pair, 'season' AS "by", season AS v, avg(brier_delta) AS d FROM decay_deltas GROUP BY ALL
            UNION ALL SELECT pair, 'venue', venue, avg(brier_delta) FROM decay_deltas GROUP BY ALL UNION ALL """
            + " UNION ALL ".join(
                f"""SELECT 'time_weighted_180_minus_{base}', 'line', '{x}', avg(pow(p_{dot(x)} - (actual > {x})::INT, 2)) FILTER (model = 'time_weighted_180')
                - avg(pow(p_{dot(x)} - (actual > {x})::INT, 2)) FILTER (model = '{base}') FROM decay_fc"""
                for base in ("equal_weight", "retained")
                for x in SIDE_LINES
            )
        },
    )
    unpivot = " UNION ALL ".join(f"SELECT '{m}' AS metric, sample, {m}_delta AS delta FROM means" for m in ("mae", "brier"))
    out["iid_bootstrap"] = query(
        "boot_units",
        f"SELECT metric, {summary(SAMPLES)} FROM ({unpivot}) GROUP BY metric",
        {
            "keys": f"SELECT sample, {sample_key('sample')} AS key FROM range(0, {SAMPLES}) s(sample)",
            "draws": f"""SELECT sample, {drawn('key', 'draw')} % (SELECT count(*) FROM boot_units) AS idx
              FROM keys, range(0, (SELECT count(*) FROM boot_units)) d(draw)""",
            "means": "SELECT sample, avg(mae_delta) AS mae_delta, avg(brier_delta) AS brier_delta FROM draws JOIN boot_units USING (idx) GROUP BY sample",
        },
    )
    cumulative, term, cuts = 0.0, math.exp(-1.0), []
    for k in range(12):
        cumulative += term
        cuts.append(math.floor(cumulative * 2**32))
        term /= k + 1
    copies = " + ".join(f"(u >= {c})::INT" for c in cuts)
    out["iid_bootstrap_poisson"] = query(
        "boot_units",
        f"SELECT metric, {summary(SAMPLES)} FROM ({unpivot}) GROUP BY metric",
        {
            "keys": f"SELECT sample, {sample_key('sample')} AS key FROM range(0, {SAMPLES}) s(sample)",
            "words": "SELECT mae_delta, brier_delta, ('0x' || tag[1:8])::BIGINT AS w1, ('0x' || tag[9:16])::BIGINT AS w2 FROM boot_units",
            "halves": f"SELECT sample, mae_delta, brier_delta, w2, {mixed('xor(w1, key)')} AS h FROM words, keys",
            "rolls": f"SELECT sample, mae_delta, brier_delta, {mixed('xor(h, w2)')} AS u FROM halves",
            "means": f"""SELECT sample, sum(({copies}) * mae_delta) / sum({copies}) AS mae_delta, sum(({copies}) * brier_delta) / sum({copies}) AS brier_delta
              FROM rolls GROUP BY sample""",
        },
    )
    out["event_rate_forecast"] = query(
        "goal_wide",
        f"SELECT match_id, {r('(over_n + 1)::DOUBLE / (n + 2)', 'over_rate')}, {r('(btts_n + 1)::DOUBLE / (n + 2)', 'btts_rate')} FROM goal_wide WHERE match_date >= {START}",
    )
    out["goal_rates"] = query("goal_rows", f"SELECT match_id, model, {r('h', 'home_rate')}, {r('a', 'away_rate')} FROM goal_rows")
    out["rho_history"] = query("goal_rows", f"SELECT match_id, model, {r('c', 'c')} FROM goal_rows WHERE c IS NOT NULL")
    out["rho_bounds"] = query(
        "bounds", f"SELECT competition, model, match_date, n_history, {r('low', 'low')}, {r('high', 'high')} FROM bounds"
    )
    out["rho_by_date"] = query("rho", f"SELECT competition, model, match_date, n_history, {r('rho', 'rho')} FROM rho")
    out["dc_probabilities"] = query(
        "goal_rows",
        f"""SELECT match_id, model, {r('1 - exp(-(h + a)) * (1 + (h + a) + (h + a) * (h + a) / 2)', 'over_2_5')},
        {r('(1 - exp(-h)) * (1 - exp(-a)) + 0.1::DOUBLE * h * a * exp(-h - a)', 'btts_yes')} FROM goal_rows""",
    )
    out["goal_forecasts"] = query("goal_fc", f"SELECT match_id, model, target, {r('p', 'p')}, y FROM goal_fc")
    out["goal_metrics"] = query("goal_fc", _event_sql("model, target"))
    out["calibration_bins"] = query(
        "goal_fc",
        f"""SELECT k.model, k.target, b.bin::INT AS bin, b.bin / 10.0::DOUBLE AS lower, (b.bin + 1) / 10.0::DOUBLE AS upper, count(f.p) AS n,
        {r('avg(f.p)', 'mean_predicted')}, {r('avg(f.y)', 'observed_rate')}
        FROM (SELECT DISTINCT model, target FROM goal_fc) k CROSS JOIN range(0, 10) b(bin)
        LEFT JOIN goal_fc f ON f.model = k.model AND f.target = k.target AND CASE WHEN f.p >= 0.9 THEN 9 ELSE floor(f.p * 10)::INT END = b.bin GROUP BY ALL""",
    )
    out["window_metrics"] = query("goal_fc", _event_sql('"window", model, target', _WINDOWED))
    out["seasonal_metrics"] = query("goal_fc", _event_sql("season, model, target"))
    out["rho_summary"] = query(
        "goal_fc",
        f"""SELECT model, {r('avg(rho)', 'mean_rho')}, {r('min(rho)', 'min_rho')}, {r('max(rho)', 'max_rho')}
        FROM goal_fc WHERE rho IS NOT NULL AND target = 'over_2_5' GROUP BY model""",
    )


    def score(analysis: str, model: str, lines: tuple, source: str) -> str:
        mean = r(f"avg({_brier(lines)}) FILTER ({VALID})", "score")
        return f"SELECT '{analysis}' AS analysis, competition, {model} AS model, count(*) FILTER ({VALID}) AS n, {mean} FROM {source} GROUP BY ALL"

    out["report_documents"] = query(
        ("total_fc", "side_fc", "decay_fc", "goal_fc", "goal_wide"),
        f"""{score('total', "'negative_binomial'", TOTAL_LINES, 'total_fc')} UNION ALL {score('side', 'model', SIDE_LINES, 'side_fc')} UNION ALL {score('decay', 'model', SIDE_LINES, 'decay_fc')}
        UNION ALL SELECT 'goals', w.competition, g.model, count(g.p), {r('avg(pow(g.p - g.y, 2))', 'score')}
        FROM goal_fc g JOIN goal_wide w USING (match_id) WHERE g.target = 'over_2_5' GROUP BY ALL""",
    )
    out["goal_block_bootstrap"] = block_sql(
        "goal_fc",
        f"""SELECT "window", pair, target, {_BLOCK} AS block_id, count(*) AS n, sum(d) AS s FROM (
          SELECT 'all' AS "window", * FROM ({_goal_pairs()}) UNION ALL SELECT 'latest', * FROM ({_goal_pairs()}) WHERE match_date >= {HOLDOUT}
        ) GROUP BY ALL""",
        '"window", pair, target',
    )
    # a history resumed from snapshots has the rows of one that never stopped
    for name in ("league_history", "team_history", "decayed_history", "decayed_league_history", "rho_bounds", "team_walkforward"):
        out[f"resumed_{name}"] = out[name]
    out["resumed_event_rates"] = out["event_rate_forecast"]
    return out
