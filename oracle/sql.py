"""DuckDB SQL for the registered queries, written from the definitions by brute force.

Histories are range windows over the raw contest rows, decayed sums are self-joins, tails use
``lgamma`` and rho is found by plain bisection, so the SQL shares no algorithm with the
Spark code it checks.
"""

from __future__ import annotations

START = "DATE '1996-07-01'"
HOLDOUT = "DATE '2000-07-01'"
TOTAL_LINES = (8.5, 9.5, 10.5, 11.5)
SIDE_LINES = (3.5, 4.5, 5.5, 6.5)
BASE = ("venue_poisson", "team_arithmetic", "team_multiplicative", "team_decay_180")


def dispersion(n: str, s: str, q: str) -> str:
    n, s, q = (f"({x})::DOUBLE" for x in (n, s, q))
    return (
        f"(CASE WHEN {n} >= 2 AND {s} > 0 THEN greatest(0.0::DOUBLE, "
        f"((({q}) - ({s}) * ({s}) / ({n})) / (({n}) - 1) - ({s}) / ({n})) / (({s}) / ({n}) * (({s}) / ({n})))) "
        f"ELSE 0.0::DOUBLE END)"
    )


def over(mu: str, alpha: str, line: float) -> str:
    top = int(line) + 1
    poisson = f"exp(-({mu}) + k * ln({mu}) - lgamma((k + 1)::DOUBLE))"
    nb = (
        f"exp(lgamma(k + 1 / ({alpha})) - lgamma(1 / ({alpha})) - lgamma((k + 1)::DOUBLE) "
        f"- ln(1 + ({alpha}) * ({mu})) / ({alpha}) + k * ln(({alpha}) * ({mu}) / (1 + ({alpha}) * ({mu}))))"
    )
    tail = lambda term: f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, 1 - list_sum(list_transform(range(0, {top}), lambda k: {term}))))"
    return f"(CASE WHEN ({alpha}) <= 1e-12 THEN {tail(poisson)} ELSE {tail(nb)} END)"


def nll(k: str, mu: str, alpha: str) -> str:
    return (
        f"(CASE WHEN ({alpha}) <= 1e-12 THEN ({mu}) - ({k}) * ln({mu}) + lgamma((({k}) + 1)::DOUBLE) ELSE "
        f"-(lgamma(({k}) + 1 / ({alpha})) - lgamma(1 / ({alpha})) - lgamma((({k}) + 1)::DOUBLE) "
        f"- ln(1 + ({alpha}) * ({mu})) / ({alpha}) + ({k}) * ln(({alpha}) * ({mu}) / (1 + ({alpha}) * ({mu})))) END)"
    )


def r(expression: str, name: str, digits: int = 6) -> str:
    return f"round({expression}, {digits}) + 0.0 AS {name}"


def dot(line: float) -> str:
    return str(line).replace(".", "_")


_WIDE = """
    SELECT *,
      count(*) OVER l AS n,
      coalesce(sum(home_count) OVER l, 0) AS hs, coalesce(sum(away_count) OVER l, 0) AS aws,
      coalesce(sum(home_count * home_count) OVER l, 0) AS hq, coalesce(sum(away_count * away_count) OVER l, 0) AS aq,
      coalesce(sum((home_count + away_count) * (home_count + away_count)) OVER l, 0) AS tq,
      count(*) OVER h AS hn, coalesce(sum(home_count) OVER h, 0) AS hf, coalesce(sum(away_count) OVER h, 0) AS ha,
      count(*) OVER a AS an, coalesce(sum(away_count) OVER a, 0) AS af, coalesce(sum(home_count) OVER a, 0) AS aa,
      coalesce(sum(home_goals) OVER l, 0) AS lhg, coalesce(sum(away_goals) OVER l, 0) AS lag,
      coalesce(sum((home_goals + away_goals >= 3)::INT) OVER l, 0) AS over_n,
      coalesce(sum((home_goals > 0 AND away_goals > 0)::INT) OVER l, 0) AS btts_n,
      coalesce(sum(home_goals) OVER h, 0) AS hgf, coalesce(sum(away_goals) OVER h, 0) AS hga,
      coalesce(sum(away_goals) OVER a, 0) AS agf, coalesce(sum(home_goals) OVER a, 0) AS aga
    FROM {source}
    WINDOW
      l AS (PARTITION BY competition ORDER BY match_date RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 DAY PRECEDING),
      h AS (PARTITION BY competition, home_team ORDER BY match_date RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 DAY PRECEDING),
      a AS (PARTITION BY competition, away_team ORDER BY match_date RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 DAY PRECEDING)
"""


def _side_rows(source: str) -> str:
    return f"""
    SELECT match_id, match_date, competition, season, home_team, away_team, home_count, away_count, 'home' AS venue, home_team AS team, away_team AS opponent,
           home_count AS actual, home_count AS count_for, away_count AS count_allowed, n, hs AS s, hq AS q, hn AS tn, hf AS tf, an AS opp_n, aa AS opp_a,
           hs + aws AS both_s, hq + aq AS both_q FROM {source}
    UNION ALL
    SELECT match_id, match_date, competition, season, home_team, away_team, home_count, away_count, 'away', away_team, home_team,
           away_count, away_count, home_count, n, aws, aq, an, af, hn, ha, hs + aws, hq + aq FROM {source}
    """


def _smooth(total: str, n: str, league: str, k: str = "5.0::DOUBLE") -> str:
    return f"(({total}) + {k} * ({league})) / (({n}) + {k})"


_LEAGUE = "(s::DOUBLE / n)"


def _arithmetic(k: str = "5.0::DOUBLE") -> str:
    return f"({_smooth('tf', 'tn', _LEAGUE, k)} + {_smooth('opp_a', 'opp_n', _LEAGUE, k)}) / 2"


def _decayed_team(role: str, team: str, f: str, a: str, source: str = "fixtures") -> str:
    w = "pow(0.5::DOUBLE, (t.match_date - h.match_date) / 180.0::DOUBLE)"
    return f"""
    SELECT t.competition, t.team, t.match_date, coalesce(sum({w}), 0) AS wn, coalesce(sum({w} * h.{f}), 0) AS wf,
           coalesce(sum({w} * h.{a}), 0) AS wa
    FROM (SELECT DISTINCT competition, {team} AS team, match_date FROM {source}) t
    LEFT JOIN {source} h ON h.competition = t.competition AND h.{team} = t.team AND h.match_date < t.match_date
    GROUP BY ALL
    """


def _decayed_league(home: str, away: str, source: str = "fixtures") -> str:
    w = "pow(0.5::DOUBLE, (t.match_date - h.match_date) / 180.0::DOUBLE)"
    return f"""
    SELECT t.competition, t.match_date, coalesce(sum({w} * h.c), 0) AS ln, coalesce(sum({w} * h.hs), 0) AS lh, coalesce(sum({w} * h.aws), 0) AS la
    FROM (SELECT DISTINCT competition, match_date FROM {source}) t
    LEFT JOIN (SELECT competition, match_date, count(*) AS c, sum({home}) AS hs, sum({away}) AS aws FROM {source} GROUP BY ALL) h
      ON h.competition = t.competition AND h.match_date < t.match_date
    GROUP BY ALL
    """


def _multiplicative(f: str, n: str, oa: str, on: str, league: str) -> str:
    return f"({_smooth(f, n, league)}) * ({_smooth(oa, on, league)}) / ({league})"


def _goal_rate(venue: str) -> dict[str, str]:
    """Rate expressions of the four base models over the goal_wide columns."""
    if venue == "home":
        g, tn, tf, on, oa, w = "lhg", "hn", "hgf", "an", "aga", ("lh", "hwn", "hwf", "awn", "awa")
    else:
        g, tn, tf, on, oa, w = "lag", "an", "agf", "hn", "hga", ("la", "awn", "awf", "hwn", "hwa")
    league = f"greatest(1e-9::DOUBLE, {g}::DOUBLE / n)"
    decayed = f"greatest(1e-9::DOUBLE, {w[0]} / ln)"
    return {
        "venue_poisson": league,
        "team_arithmetic": f"({_smooth(tf, tn, league)} + {_smooth(oa, on, league)}) / 2",
        "team_multiplicative": _multiplicative(tf, tn, oa, on, league),
        "team_decay_180": _multiplicative(w[2], w[1], w[4], w[3], decayed),
    }


def _goal_rows() -> str:
    home, away = _goal_rate("home"), _goal_rate("away")
    return " UNION ALL ".join(
        f"SELECT match_id, match_date, competition, season, home_goals, away_goals, '{m}' AS model, {home[m]} AS h, {away[m]} AS a FROM goal_wide"
        for m in BASE
    )


def _bisection(rounds: int = 46) -> str:
    """Bisection by recursion over all (competition, model, date) targets at once."""
    f = (
        "list_sum(list_transform(list_zip(cs[1:n_history], ws[1:n_history]), lambda z: z[2] * z[1] / (1 + z[1] * {x})))"
    )
    mid = "((lo + hi) / 2)"
    return f"""
    rho_targets AS (
      SELECT b.competition, b.model, b.match_date, b.n_history, b.low, b.high, l.cs, l.ws
      FROM bounds b JOIN rho_lists l USING (competition, model) WHERE n_history >= 50 AND b.match_date >= {START}
    ),
    rho_ends AS (
      SELECT *, {f.format(x='low')} AS f_low, {f.format(x='high')} AS f_high FROM rho_targets
    ),
    rho_steps AS (
      SELECT 0 AS step, competition, model, match_date, n_history, low AS lo, high AS hi FROM rho_ends WHERE f_low > 0 AND f_high < 0
      UNION ALL
      SELECT step + 1, competition, model, match_date, n_history,
             CASE WHEN fm > 0 THEN {mid} ELSE lo END, CASE WHEN fm > 0 THEN hi ELSE {mid} END
      FROM (
        SELECT s.*, {f.format(x=mid)} AS fm FROM rho_steps s JOIN rho_lists l USING (competition, model) WHERE step < {rounds}
      )
    ),
    rho AS (
      SELECT b.competition, b.model, b.match_date, b.n_history, b.low, b.high,
             CASE WHEN e.match_date IS NULL THEN 0.0::DOUBLE WHEN e.f_low <= 0 THEN e.low WHEN e.f_high >= 0 THEN e.high ELSE (s.lo + s.hi) / 2 END AS rho
      FROM (SELECT * FROM bounds WHERE match_date >= {START}) b
      LEFT JOIN rho_ends e USING (competition, model, match_date)
      LEFT JOIN (SELECT * FROM rho_steps WHERE step = {rounds}) s USING (competition, model, match_date)
    )"""


# name -> (dependencies, body); a body starting with its own CTE text is marked by '@'
CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "per_order": (
        (),
        """
    SELECT l_orderkey, min(l_suppkey) AS suppkey,
      CAST(floor(coalesce(sum(CASE WHEN l_linenumber % 2 = 1 THEN l_quantity END), 0) / 10) AS INTEGER) AS home_count,
      CAST(floor(coalesce(sum(CASE WHEN l_linenumber % 2 <> 1 THEN l_quantity END), 0) / 10) AS INTEGER) AS away_count,
      CAST(count(*) FILTER (l_returnflag = 'R') AS INTEGER) AS home_goals,
      CAST(count(*) FILTER (l_returnflag = 'A') AS INTEGER) AS away_goals
    FROM lineitem GROUP BY l_orderkey""",
    ),
    "log": (
        ("per_order",),
        """
    SELECT o_orderkey AS match_id, CAST(o_orderdate AS DATE) AS match_date, c_mktsegment AS competition,
      hn.n_name AS home_team, an.n_name AS away_team, home_count, away_count, home_goals, away_goals,
      printf('%02d%02d', year(CAST(o_orderdate AS DATE) - INTERVAL 6 MONTH) % 100, (year(CAST(o_orderdate AS DATE) - INTERVAL 6 MONTH) + 1) % 100) AS season
    FROM orders JOIN per_order ON o_orderkey = l_orderkey
    JOIN customer ON o_custkey = c_custkey JOIN nation hn ON c_nationkey = hn.n_nationkey
    JOIN supplier ON s_suppkey = suppkey JOIN nation an ON s_nationkey = an.n_nationkey
    """,
    ),
    "contests": (("log",), "SELECT * FROM log WHERE home_team <> away_team"),
    "fixtures": (
        ("contests",),
        "SELECT * FROM contests QUALIFY row_number() OVER (PARTITION BY competition, match_date, home_team, away_team ORDER BY match_id) = 1",
    ),
    "wide": (("contests",), _WIDE.format(source="contests")),
    "fwide": (("fixtures",), _WIDE.format(source="fixtures")),
    "sides": (("wide",), _side_rows("wide")),
    "fsides": (("fwide",), _side_rows("fwide")),
    "dteam": (
        ("fixtures",),
        f"SELECT 'home' AS venue, * FROM ({_decayed_team('home', 'home_team', 'home_count', 'away_count')}) "
        f"UNION ALL SELECT 'away', * FROM ({_decayed_team('away', 'away_team', 'away_count', 'home_count')})",
    ),
    "dleague": (("fixtures",), _decayed_league("home_count", "away_count")),
    "total_state": (
        ("wide",),
        f"""
    SELECT DISTINCT competition, match_date, (hs + aws)::DOUBLE / n AS expected, {dispersion('n', 'hs + aws', 'tq')} AS dispersion
    FROM wide WHERE n > 0""",
    ),
    "total_fc": (
        ("wide", "total_state"),
        f"""
    SELECT w.match_id, w.match_date, w.competition, w.home_count + w.away_count AS actual, t.expected, t.dispersion,
      {', '.join(f"p.p_{dot(x)}" for x in TOTAL_LINES)}
    FROM wide w JOIN total_state t USING (competition, match_date)
    JOIN (SELECT competition, match_date, {', '.join(f"{over('expected', 'dispersion', x)} AS p_{dot(x)}" for x in TOTAL_LINES)} FROM total_state) p USING (competition, match_date)
    WHERE w.match_date >= {START}""",
    ),
    "side_fc": (
        ("sides",),
        f"""
    SELECT *, {', '.join(f"{over('expected', 'dispersion', x)} AS p_{dot(x)}" for x in SIDE_LINES)},
      {nll('actual', 'expected', 'dispersion')} AS nll FROM (
      SELECT 'venue_average' AS model, NULL::INT AS prior, *, {_LEAGUE} AS expected, {dispersion('n', 's', 'q')} AS dispersion FROM sides WHERE n > 0 AND match_date >= {START}
      UNION ALL
      SELECT 'team_opponent', 5, *, {_arithmetic()}, {dispersion('n', 's', 'q')} FROM sides WHERE n > 0 AND match_date >= {START}
    )""",
    ),
    "prior_fc": (
        ("sides",),
        f"""
    SELECT *, {', '.join(f"{over('expected', 'dispersion', x)} AS p_{dot(x)}" for x in SIDE_LINES)},
      {nll('actual', 'expected', 'dispersion')} AS nll FROM (
      SELECT 'venue_average' AS model, NULL::INT AS prior, *, {_LEAGUE} AS expected, {dispersion('n', 's', 'q')} AS dispersion FROM sides WHERE n > 0 AND match_date >= {START}
      """
        + " ".join(
            f"UNION ALL SELECT 'team_opponent', {k}, *, {_arithmetic(f'{k}.0::DOUBLE')}, {dispersion('n', 's', 'q')} FROM sides WHERE n > 0 AND match_date >= {START}"
            for k in (2, 5, 10)
        )
        + ")",
    ),
    "eligible": (
        ("fwide",),
        f"SELECT * FROM fwide WHERE match_date >= {START} AND 2 * n >= 100 AND least(hn, an) >= 5",
    ),
    "decay_rows": (
        ("eligible", "fsides", "dteam", "dleague"),
        """
    SELECT f.*, own.wn AS own_n, own.wf AS own_f, opp.wn AS dopp_n, opp.wa AS dopp_a, l.ln,
      CASE WHEN f.venue = 'home' THEN l.lh ELSE l.la END AS ls
    FROM fsides f JOIN eligible USING (match_id)
    JOIN dteam own ON own.venue = f.venue AND own.competition = f.competition AND own.team = f.team AND own.match_date = f.match_date
    JOIN dteam opp ON opp.venue <> f.venue AND opp.competition = f.competition AND opp.team = f.opponent AND opp.match_date = f.match_date
    JOIN dleague l ON l.competition = f.competition AND l.match_date = f.match_date""",
    ),
    "decay_fc": (
        ("decay_rows",),
        f"""
    SELECT *, {', '.join(f"{over('expected', 'dispersion', x)} AS p_{dot(x)}" for x in SIDE_LINES)},
      {nll('actual', 'expected', 'dispersion')} AS nll FROM (
      SELECT 'retained' AS model, *, {_arithmetic()} AS expected, {dispersion('n', 's', 'q')} AS dispersion FROM decay_rows
      UNION ALL
      SELECT 'equal_weight', *, {_multiplicative('tf', 'tn', 'opp_a', 'opp_n', '((s + 5.0::DOUBLE) / (n + 5.0::DOUBLE))')}, {dispersion('2 * n', 'both_s', 'both_q')} FROM decay_rows
      UNION ALL
      SELECT 'time_weighted_180', *, {_multiplicative('own_f', 'own_n', 'dopp_a', 'dopp_n', '((ls + 5.0::DOUBLE) / (ln + 5.0::DOUBLE))')}, {dispersion('2 * n', 'both_s', 'both_q')} FROM decay_rows
    )""",
    ),
    "gteam_h": (("fixtures",), _decayed_team("home", "home_team", "home_goals", "away_goals")),
    "gteam_a": (("fixtures",), _decayed_team("away", "away_team", "away_goals", "home_goals")),
    "gleague": (("fixtures",), _decayed_league("home_goals", "away_goals")),
    "goal_wide": (
        ("fwide", "gteam_h", "gteam_a", "gleague"),
        """
    SELECT f.*, h.wn AS hwn, h.wf AS hwf, h.wa AS hwa, a.wn AS awn, a.wf AS awf, a.wa AS awa, l.ln, l.lh, l.la
    FROM fwide f
    JOIN gteam_h h ON h.competition = f.competition AND h.team = f.home_team AND h.match_date = f.match_date
    JOIN gteam_a a ON a.competition = f.competition AND a.team = f.away_team AND a.match_date = f.match_date
    JOIN gleague l ON l.competition = f.competition AND l.match_date = f.match_date
    WHERE f.n >= 100""",
    ),
    "goal_rows": (
        ("goal_wide",),
        f"""
    SELECT *, CASE WHEN home_goals <= 1 AND away_goals <= 1 THEN
      CASE WHEN home_goals = 0 AND away_goals = 0 THEN -h * a WHEN home_goals = 0 THEN h WHEN away_goals = 0 THEN a ELSE -1.0::DOUBLE END END AS c
    FROM ({_goal_rows()})""",
    ),
    "bounds": (
        ("goal_rows",),
        """
    SELECT competition, model, match_date, n_history,
      CASE WHEN cmax > 0 THEN greatest(-0.25::DOUBLE, -0.95::DOUBLE / cmax) ELSE -0.25::DOUBLE END AS low,
      least(0.25::DOUBLE, -0.95::DOUBLE / cmin) AS high
    FROM (
      SELECT d.competition, d.model, d.match_date, count(r.c) AS n_history,
        greatest(max(d.mh), max(d.ma), max(r.c)) AS cmax, least(-1.0::DOUBLE, -max(d.mh) * max(d.ma), min(r.c)) AS cmin
      FROM (SELECT competition, model, match_date, max(h) AS mh, max(a) AS ma FROM goal_rows GROUP BY ALL) d
      LEFT JOIN (SELECT * FROM goal_rows WHERE c IS NOT NULL) r
        ON r.competition = d.competition AND r.model = d.model AND r.match_date < d.match_date
      GROUP BY ALL
    )""",
    ),
    "rho_lists": (
        ("goal_rows",),
        """
    SELECT competition, model, list(c ORDER BY match_date) AS cs,
      list(CASE WHEN model = 'team_decay_180' THEN pow(2.0::DOUBLE, (match_date - DATE '1998-01-01') / 180.0::DOUBLE) ELSE 1.0::DOUBLE END ORDER BY match_date) AS ws
    FROM goal_rows WHERE c IS NOT NULL GROUP BY ALL""",
    ),
    "rho": (("bounds", "rho_lists"), "@" + _bisection()),
}


def _ordered(names: tuple[str, ...]) -> list[str]:
    out: list[str] = []

    def visit(name: str) -> None:
        if name in out:
            return
        for dep in CTES[name][0]:
            visit(dep)
        out.append(name)

    for name in names:
        visit(name)
    return out


def query(needs: tuple[str, ...] | str, select: str, extra: dict[str, str] | None = None) -> str:
    """Full statement: the needed CTEs in order, extra CTEs, then the final select."""
    names = (needs,) if isinstance(needs, str) else needs
    parts = []
    for name in _ordered(names):
        body = CTES[name][1]
        parts.append(body[1:].strip() if body.startswith("@") else f"{name} AS MATERIALIZED ({body})")
    parts += [f"{name} AS ({body})" for name, body in (extra or {}).items()]
    return f"WITH RECURSIVE {', '.join(parts)} {select}"
