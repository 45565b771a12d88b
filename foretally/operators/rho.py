"""Low-score dependence (rho) per model and date, from strictly earlier forecasts.

The coefficient history of a date is every earlier low-score result, so evaluating its
likelihood derivative ``f(rho) = sum w c / (1 + c rho)`` date by date would touch each
result once per later date. Instead each result is folded once into daily sums of
``w (c / (1 + c g))**k`` at fixed points g. Their prefix sums over earlier dates are the
Taylor coefficients of f around g for every date at once; f is decreasing, so the sign
change picks the bracket and the nearest expansion gives the root. Where an expansion would
converge too slowly (a root close to the feasible limit) the bracket's cell is cut into a
finer set of points and folded the same way.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foretally.contracts import MIN_RHO_HISTORY, RHO_LIMIT, RHO_MARGIN
from foretally.functions.counts import low_score_coefficients
from foretally.operators.ledger import ANCHOR_DAY, CARRIED, strict_past, strict_past_extreme
from foretally.workspace import attach, settle, spread

GRID_CELLS = 16
SUB_CELLS = 128
MOMENTS = 16
REACH = 0.2
NEWTON_STEPS = 7
_LONG_HALF_LIFE = 100  # days; 2 ** (a century / it) is within the double range
_KEYS = ["competition", "model"]
_BOUNDS = ["low", "high", "c_min", "c_max"]
_T = [f"t{k}" for k in range(1, MOMENTS + 1)]


def rate_rows(rates: DataFrame) -> DataFrame:
    """One row per fixture and base model; ``c`` is NULL unless both sides scored at most once."""
    low = (F.col("home_goals") <= 1) & (F.col("away_goals") <= 1)
    cell = F.col("home_goals") * 2 + F.col("away_goals") + 1
    return rates.select("match_id", "competition", "match_date", "home_goals", "away_goals", F.inline_outer("rates")).withColumn(
        "c", F.when(low, F.element_at(low_score_coefficients(F.col("home_rate"), F.col("away_rate")), cell.cast("int")))
    )


def coefficient_days(rows: DataFrame) -> DataFrame:
    """Per (competition, model, date): number and extremes of the coefficients, and the largest rates."""
    return rows.groupBy(*_KEYS, "match_date").agg(
        F.max("home_rate").alias("top_home"),
        F.max("away_rate").alias("top_away"),
        F.count("c").alias("n_low"),
        F.min("c").alias("day_min"),
        F.max("c").alias("day_max"),
    )


def rho_bounds(rows: DataFrame, carry: DataFrame | None = None) -> DataFrame:
    """History size, extreme coefficients and feasible interval per (competition, model, date).

    The interval covers every earlier coefficient and every cell of the date's own fixtures
    (through the date's largest home and away rates), never the date's results. ``carry`` has the count and
    the extremes of all dates before those of ``rows`` (``snapshots.coefficient_carry``).
    """
    daily = coefficient_days(rows).withColumn(CARRIED, F.lit(False))
    if carry is not None:
        daily = daily.unionByName(carry.withColumn(CARRIED, F.lit(True)), allowMissingColumns=True)
    past = daily.select(
        *_KEYS,
        "match_date",
        strict_past("n_low", _KEYS).alias("n_history"),
        strict_past_extreme("day_min", _KEYS, largest=False).alias("c_min"),
        strict_past_extreme("day_max", _KEYS, largest=True).alias("c_max"),
        "top_home",
        "top_away",
        CARRIED,
    )
    past = past.where(~F.col(CARRIED)).drop(CARRIED)
    # greatest/least skip NULL, so a date without history is bounded by its own cells
    largest = F.greatest("c_max", "top_home", "top_away")
    smallest = F.least(F.col("c_min"), -F.col("top_home") * F.col("top_away"), F.lit(-1.0))
    margin = F.lit(-RHO_MARGIN)
    return past.withColumn(
        "low", F.when(largest > 0, F.greatest(F.lit(-RHO_LIMIT), margin / largest)).otherwise(F.lit(-RHO_LIMIT))
    ).withColumn("high", F.least(F.lit(RHO_LIMIT), margin / smallest))


def _era_days(half_life: float) -> int | None:
    """Days after which weights start anew; None where one scale holds all dates."""
    if half_life <= 0:
        raise ValueError("half_life must be positive")
    return None if half_life >= _LONG_HALF_LIFE else max(1, int(500 * half_life))


def _weight(half_lives: Mapping[str, float]) -> Column:
    """Decay weight up to a factor common to a date (and era), which does not move the root."""
    weight = F.lit(1.0)
    for model, half_life in half_lives.items():
        days = _era_days(half_life)
        day = F.unix_date("match_date")
        start = F.lit(ANCHOR_DAY) if days is None else F.floor(day / days) * days
        scaled = F.pow(F.lit(2.0), (day - start) / F.lit(float(half_life)))
        weight = F.when(F.col("model") == model, scaled).otherwise(weight)
    return weight


def _eras(half_lives: Mapping[str, float]) -> tuple[Column, Column] | None:
    """(era of a row, what a weight of the era before still weighs); None where no half-life is short."""
    era, carry = F.lit(0).cast("bigint"), F.lit(0.0)
    short = {model: h for model, h in half_lives.items() if _era_days(h)}
    for model, half_life in short.items():
        days, own = _era_days(half_life), F.col("model") == model
        era = F.when(own, F.floor(F.unix_date("match_date") / days)).otherwise(era)
        carry = F.when(own, F.lit(2.0 ** (-days / half_life))).otherwise(carry)
    return (era, carry) if short else None


def _point(index: Column, cells: int) -> Column:
    return F.lit(-RHO_LIMIT) + index * F.lit(2 * RHO_LIMIT / cells)


def _folded(history: DataFrame, targets: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Daily sums of the powers at each point, with an empty contribution for every target date.

    Needs c, w, point, g in the history and point, g and the bounds in the targets.
    """
    powers = ["t"]
    for k in range(2, MOMENTS + 1):
        powers.append(f"{powers[k // 2 - 1]} * {powers[k - k // 2 - 1]}")
    shift = 1 + F.col("c") * F.col("g")
    terms = history.withColumn("t", F.when(shift > 0, F.col("c") / shift)).select(*keys, "match_date", "point", "g", "t", "w")
    dates = targets.select(*keys, "match_date", "point", "g", *_BOUNDS)
    return (
        terms.unionByName(dates, allowMissingColumns=True)
        .groupBy(*keys, "match_date", "point", "g")
        .agg(
            *[F.expr(f"sum(w * {power}) AS {name}") for name, power in zip(_T, powers)],
            *[F.max(c).alias(c) for c in _BOUNDS],
        )
    )


def _brackets(folded: DataFrame, keys: Sequence[str], half_lives: Mapping[str, float]) -> DataFrame:
    """For each target date the last point with a positive and the first with a non-positive slope.

    A short half-life cuts the dates into eras of 500 half-lives, as decayed sums do: a date sees its own era and the
    one before.
    """
    eras, cut = _eras(half_lives), []
    if eras:
        folded, cut = folded.withColumns({"era": eras[0], "carry": eras[1]}), ["era"]
        earlier = Window.partitionBy(*keys, "point").orderBy("era").rangeBetween(-1, -1)
    frame = Window.partitionBy(*keys, "point", *cut).orderBy(F.unix_date("match_date")).rangeBetween(Window.unboundedPreceding, -1)

    def past(t: str) -> Column:
        own = F.coalesce(F.sum(t).over(frame), F.lit(0.0))
        return own + F.col("carry") * F.coalesce(F.sum(t).over(earlier), F.lit(0.0)) if eras else own

    summed = folded.select(*keys, "match_date", "g", *_BOUNDS, *[past(t).alias(t) for t in _T]).filter(F.col("low").isNotNull() & F.col("g").between(F.col("low"), F.col("high")))
    node = F.struct("g", *_T)
    return summed.groupBy(*keys, "match_date").agg(
        F.max_by(node, F.when(F.col("t1") > 0, F.col("g"))).alias("left"),
        F.min_by(node, F.when(F.col("t1") <= 0, F.col("g"))).alias("right"),
        *[F.max(c).alias(c) for c in _BOUNDS],
    )


def _slope(x: str, node: str = "") -> str:
    """SQL text of the expansion at offset ``x``: t1 - x (t2 - x (t3 - ...))."""
    value = f"{node}{_T[-1]}"
    for name in reversed(_T[:-1]):
        value = f"{node}{name} - {x} * ({value})"
    return f"({value})"


def _slope_fall(x: str) -> str:
    """SQL text of minus its derivative; positive."""
    value = f"{MOMENTS - 1}D * {_T[-1]}"
    for k in range(MOMENTS - 1, 1, -1):
        value = f"{k - 1}D * {_T[k - 1]} - {x} * ({value})"
    return f"({value})"


def _roots(brackets: DataFrame) -> DataFrame:
    """Newton steps on the nearest expansion, kept inside the bracket.

    ``reach`` bounds the ratio of successive Taylor terms: small means the root is exact.
    """
    sided = brackets.selectExpr(
        *_KEYS,
        "match_date",
        *_BOUNDS,
        "left",
        "right",
        "coalesce(left.g, low) AS lo",
        "coalesce(right.g, high) AS hi",
        "left IS NULL AS no_left",
        "right IS NULL AS no_right",
    ).withColumn("m", F.expr("(lo + hi) / 2 - left.g"))
    use_right = f"no_left OR (NOT no_right AND {_slope('m', 'left.')} > 0)"
    near = sided.withColumn("node", F.expr(f"CASE WHEN {use_right} THEN right ELSE left END")).selectExpr(
        *_KEYS,
        "match_date",
        *_BOUNDS,
        "lo",
        "hi",
        "no_left",
        "no_right",
        "node.g AS g",
        *[f"coalesce(node.{t}, 0D) AS {t}" for t in _T],
    )
    stepped = near.withColumn("x", F.lit(0.0))
    for _ in range(NEWTON_STEPS):
        step = f"coalesce(try_divide({_slope('x')}, {_slope_fall('x')}), 0D)"
        stepped = stepped.withColumn("x", F.expr(f"greatest(lo - g, least(hi - g, x + {step}))"))
    ends = stepped.withColumns({"to_low": F.expr("low - g"), "to_high": F.expr("high - g")})
    return ends.selectExpr(
        *_KEYS,
        "match_date",
        *_BOUNDS,
        "lo",
        "hi",
        """greatest(abs(c_max / (1 + c_max * g)), abs(c_min / (1 + c_min * g)))
           * (CASE WHEN no_left OR no_right THEN hi - lo ELSE (hi - lo) / 2 END) AS reach""",
        f"""CASE WHEN no_left AND {_slope('to_low')} <= 0 THEN low
                 WHEN no_right AND {_slope('to_high')} >= 0 THEN high
                 ELSE g + x END AS rho""",
    )


def fit_rho(
    rows: DataFrame,
    start: dt.date,
    half_lives: Mapping[str, float],
    min_history: int = MIN_RHO_HISTORY,
) -> DataFrame:
    """rho per (competition, model, date) from ``start`` on; 0 while the history is short."""
    bounds = settle(rho_bounds(rows).filter(F.col("match_date") >= F.lit(start)), "rho-bounds")
    fitted = bounds.filter(F.col("n_history") >= min_history)
    # equal coefficients of a date share their weight: they become one row before the points multiply it
    equal = rows.filter(F.col("c").isNotNull()).groupBy(*_KEYS, "match_date", "c").agg(F.count(F.lit(1)).alias("copies"))
    history = settle(equal.select(*_KEYS, "match_date", "c", (_weight(half_lives) * F.col("copies")).alias("w")), "rho-history")

    def on_grid(df: DataFrame) -> DataFrame:
        return spread(df, *_KEYS, "match_date").withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(GRID_CELLS)))).withColumn(
            "g", _point(F.col("point"), GRID_CELLS)
        )

    roots = settle(_roots(_brackets(_folded(on_grid(history), on_grid(fitted), _KEYS), _KEYS, half_lives)), "rho-roots")
    steep = roots.filter(F.col("reach") > REACH)
    if not steep.isEmpty():
        roots = roots.filter(F.col("reach") <= REACH).unionByName(_refined(history, steep, half_lives))
    return bounds.join(roots.select(*_KEYS, "match_date", "rho"), [*_KEYS, "match_date"], "left").withColumn(
        "rho", F.coalesce("rho", F.lit(0.0))
    )


def _refined(history: DataFrame, steep: DataFrame, half_lives: Mapping[str, float]) -> DataFrame:
    """Second pass over the cells (at most GRID_CELLS per competition and model) that need finer points."""
    middle = ((F.col("lo") + F.col("hi")) / 2 + RHO_LIMIT) * (GRID_CELLS / (2 * RHO_LIMIT))
    targets = steep.withColumn("cell", F.greatest(F.lit(0), F.least(F.lit(GRID_CELLS - 1), F.floor(middle))))
    cells = settle(targets.groupBy(*_KEYS).agg(F.collect_set("cell").alias("cells")), "rho-cells")
    keys = [*_KEYS, "cell"]

    def fine(df: DataFrame) -> DataFrame:
        first = F.col("cell") * SUB_CELLS
        return df.withColumn("point", F.explode(F.sequence(first, first + SUB_CELLS))).withColumn(
            "g", _point(F.col("point"), GRID_CELLS * SUB_CELLS)
        )

    # neighbouring cells share an end point, so sums are kept per cell
    local = attach(spread(history, *_KEYS, "match_date"), cells, _KEYS, cells.count()).withColumn("cell", F.explode("cells")).drop("cells")
    bracketed = targets.select(*keys, "match_date", F.col("lo").alias("low"), F.col("hi").alias("high"), "c_min", "c_max")
    return _roots(_brackets(_folded(fine(local), fine(bracketed), keys), keys, half_lives))
