"""Count distributions as column expressions.

Poisson is the Negative Binomial with zero dispersion, and both have the ratio
``P(k) / P(k-1) = a_k`` with ``a_k = mu (1 + alpha (k-1)) / (k (1 + alpha mu))``. A lower
tail is then ``P(0) (1 + a_1 (1 + a_2 (1 + ...)))``, a nested product of plain arithmetic,
compiled into the stage and free of arrays and lambdas. Lines above ``NESTED_LINE`` take a continued
fraction on the side of the tail where it converges; its steps grow with the root of the line, the size of
the expression doesn't grow at all.

The log loss of a count above ``_SHORT`` is a closed form: the errors of Stirling's formula at the count, the shape and
their sum, and two deviances that are computed without subtracting large numbers. It costs the same at any count.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foretally.contracts import POISSON_DISPERSION


#: Highest line whose tail is a nested product.
NESTED_LINE = 60.5
#: Below this probability of zero the mean is so large that no mass worth a double lies below ``NESTED_LINE``.
_NO_ZERO = 1e-290
#: Stirling's series holds from here on; smaller arguments are shifted by as much.
_SERIES_FROM = 10
#: Relative distances below this one take a power series.
_NEAR = 0.03
_NEAR_TERMS = 11
#: Counts up to here, with a dispersion below the other bound, take a product instead of the closed form.
_SHORT = 10
_SHORT_DISPERSION = 1e6


def check_line(line: float) -> float:
    if line < 0 or not math.isclose(line % 1, 0.5):
        raise ValueError("line must be a non-negative half line")
    return float(line)


def clamp01(p: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), p))


def usable(mu: Column, alpha: Column) -> Column:
    """True where a mean and a dispersion define a distribution."""
    endless = F.lit(float("inf"))  # NaN counts as larger still
    return (mu > 0) & (mu < endless) & (alpha >= 0) & (alpha < endless)


def _effective(alpha: Column) -> Column:
    return F.when(alpha <= POISSON_DISPERSION, F.lit(0.0)).otherwise(alpha)


def _log_p0(mu: Column, alpha: Column) -> Column:
    return F.when(alpha > 0, -F.log1p(alpha * mu) / alpha).otherwise(-mu)


def _upper_tail(line: float, p0: str, ratios: Sequence[str]) -> str:
    """SQL text of the clamped upper tail over named columns; ``ratios`` has that of P(k) to P(k - 1) from k = 1 on.

    Text, because a nested product is one call to the parser instead of a call per operator.
    """
    nested = "1D"
    for ratio in reversed(ratios[: math.floor(line)]):
        nested = f"1D + {ratio} * ({nested})"
    return f"IF({p0} < {_NO_ZERO}D, 1D, greatest(0D, least(1D, 1D - {p0} * ({nested}))))"


def _continued(numerators: Callable[[Column], tuple[Column, Column]], steps: int) -> Column:
    """``1 + t1 / (1 + t2 / (1 + ...))`` from the innermost step outwards; ``numerators(m)`` gives t(2m) and t(2m+1)."""

    def step(inner: Column, m: Column) -> Column:
        even, odd = numerators(m.cast("double"))
        return 1 + F.try_divide(even, 1 + F.try_divide(odd, inner))

    inner = F.aggregate(F.expr(f"sequence({steps}, 1, -1)"), F.lit(1.0), step)
    return 1 + F.try_divide(numerators(F.lit(0.0))[1], inner)


def _far_tail(mu: Column, line: float, a: Column) -> Column:
    """P(X > line) by the continued fraction of the smaller tail, times the probability at its edge."""
    k = math.floor(line)
    steps = 10 + math.ceil(3 * math.sqrt(k))

    def upward(m: Column) -> tuple[Column, Column]:
        odds = mu / (1 + a * mu)
        even = m * (1 - a * m) * odds / ((k + 2 * m) * (k + 1 + 2 * m))
        return even, -(k + 1 + m) * (1 + a * (k + 1 + m)) * odds / ((k + 1 + 2 * m) * (k + 2 + 2 * m))

    def downward(m: Column) -> tuple[Column, Column]:
        even = m * (1 + a * (k + m)) / ((1 + (2 * m - 1) * a) * (1 + 2 * a * m) * mu)
        return even, -(k - m) * (1 + a * m) / ((1 + 2 * a * m) * (1 + (2 * m + 1) * a) * mu)

    above = mu * (1 + a) < k + 2
    edge = F.exp(-_log_loss(F.when(above, F.lit(k + 1.0)).otherwise(F.lit(float(k))), mu, a))
    upper = F.try_divide(edge, _continued(upward, steps))
    lower = F.try_divide(edge * (1 + a * k), _continued(downward, steps))
    return clamp01(F.when(above, upper).otherwise(1 - lower))


def over_probability(mu: Column, line: float, alpha: Column | None = None) -> Column:
    """P(X > line); NULL where the mean or dispersion is not usable."""
    line = check_line(line)
    alpha = F.lit(0.0) if alpha is None else alpha
    a = _effective(alpha)
    if line > NESTED_LINE:
        return F.when(usable(mu, alpha), _far_tail(mu, line, a))
    odds = mu / (1 + a * mu)
    nested = F.lit(1.0)
    for k in range(math.floor(line), 0, -1):
        nested = F.lit(1.0) + odds * (1 + a * (k - 1)) * F.lit(1 / k) * nested
    p0 = F.exp(_log_p0(mu, a))
    return F.when(usable(mu, alpha), F.when(p0 < _NO_ZERO, F.lit(1.0)).otherwise(clamp01(1 - p0 * nested)))


def over_probabilities(mu: Column, lines: Sequence[float], alpha: Column | None = None) -> Column:
    """Array of P(X > line), one entry per line."""
    return F.array(*[over_probability(mu, line, alpha) for line in lines])


def _with_tails(df: DataFrame, lines: Sequence[float], expected: str, dispersion: str) -> tuple[DataFrame, list[Column], list[str]]:
    """``df`` with what the lines share, computed once in projections of their own; P(X > line) of each where ``_usable``; helper columns.

    The nested products see no NULL: without a check at each step a stage that scores several models stays below the 8,000
    bytes of code up to which the virtual machine compiles a method at all.
    """
    mu, alpha = F.col("_mu"), F.col("_a")
    staged = df.withColumns({"_mu": F.coalesce(F.col(expected), F.lit(-1.0)), "_a": F.coalesce(F.col(dispersion), F.lit(-1.0))})
    staged = staged.withColumn("_usable", usable(mu, alpha))
    zero_unless = lambda kept, value: F.when(kept, value).otherwise(F.lit(0.0))
    staged = staged.withColumns({"_mu": zero_unless(F.col("_usable"), mu), "_a": zero_unless(F.col("_usable"), _effective(alpha))})
    staged = staged.withColumns({"_odds": F.expr("coalesce(_mu / (1D + _a * _mu), 0D)"), "_p0": F.coalesce(F.exp(_log_p0(mu, alpha)), F.lit(0.0))})
    top = max((math.floor(check_line(line)) for line in lines if line <= NESTED_LINE), default=0)
    ratios = [f"_ratio_{k}" for k in range(1, top + 1)]
    staged = staged.withColumns({ratio: F.expr(f"_odds * (1D + _a * {k}D) * {1 / (k + 1)!r}D") for k, ratio in enumerate(ratios)})
    nested = lambda line: F.expr(_upper_tail(line, "_p0", ratios))
    tails = [nested(line) if line <= NESTED_LINE else _far_tail(mu, check_line(line), alpha) for line in lines]
    return staged, tails, ["_mu", "_a", "_usable", "_odds", "_p0", *ratios]


def add_over_probabilities(
    df: DataFrame,
    lines: Sequence[float],
    expected: str = "expected",
    dispersion: str = "dispersion",
    name: str = "p_over",
) -> DataFrame:
    """Add the array of P(X > line)."""
    staged, tails, helpers = _with_tails(df, lines, expected, dispersion)
    # clamping would turn a missing probability into a bound, so keep NULL explicitly
    return staged.withColumn(name, F.array(*[F.when(F.col("_usable"), tail) for tail in tails])).drop(*helpers)


def add_mean_brier(
    df: DataFrame, lines: Sequence[float], expected: str = "expected", dispersion: str = "dispersion", actual: str = "actual", name: str = "brier"
) -> DataFrame:
    """Add the mean squared error of P(X > line) over the lines; NULL without a distribution or an outcome."""
    staged, tails, helpers = _with_tails(df, lines, expected, dispersion)
    over = [F.coalesce(F.col(actual) > F.lit(float(line)), F.lit(False)).cast("double") for line in lines]
    total = functools.reduce(Column.__add__, [F.pow(tail - y, F.lit(2.0)) for tail, y in zip(tails, over)])
    scored = F.col("_usable") & F.col(actual).isNotNull()
    return staged.withColumn(name, F.when(scored, total / F.lit(float(len(lines))))).drop(*helpers)


def over_map(mu: Column, lines: Sequence[float], alpha: Column | None = None) -> Column:
    """MAP<line, P(X > line)> for consumers that want the probabilities in one cell."""
    return F.map_from_arrays(F.array(*[F.lit(check_line(x)) for x in lines]), over_probabilities(mu, lines, alpha))


def _stirling_error(x: Column) -> Column:
    """``ln Gamma(x + 1) - (x + 1/2) ln x + x - ln(2 pi) / 2`` for x > 0, NULL for x = 0."""

    def series(y: Column) -> Column:
        z = 1 / (y * y)
        return (1 / 12 - z * (1 / 360 - z * (1 / 1260 - z * (1 / 1680 - z * (1 / 1188 - z * (691 / 360360)))))) / y

    # the shifted factors in pairs: (x + j) (x + 11 - j) = u + j (11 - j)
    u, y = x * (x + (_SERIES_FROM + 1)), x + _SERIES_FROM
    product = F.lit(1.0)
    for j in range(1, _SERIES_FROM // 2 + 1):
        product = product * (u + j * (_SERIES_FROM + 1 - j))
    shifted = (y + 0.5) * F.log(y) - _SERIES_FROM + series(y) - F.log(product) - (x + 0.5) * F.log(x)
    return F.when(x < _SERIES_FROM, shifted).otherwise(series(x))


def _deviance(e: Column, ratio: Column) -> Column:
    """``(1 + e) ln(1 + e) - e`` where ``ratio`` is 1 + e, known by itself."""
    near = F.lit(0.0)
    for n in range(_NEAR_TERMS, 1, -1):
        near = F.lit((-1) ** n / (n * (n - 1))) + e * near
    return F.when(F.abs(e) < _NEAR, e * e * near).otherwise(ratio * F.log(ratio) - e)


def _closed_loss(c: Column) -> Column:
    """-ln P(X = k) for k > 0, by Stirling's errors and deviances; ``c`` holds k, mu and a.

    What is needed more than once is the variable of a lambda, so the expression stays short.
    """
    k, mu, a = c["k"], c["mu"], c["a"]
    shape, grown, spread = F.when(a > 0, 1 / a), 1 + a * k, 1 + a * mu
    errors = F.transform(F.array(k, shape, shape + k), _stirling_error)
    pair = lambda e, ratio: F.struct(e.alias("e"), ratio.alias("ratio"))
    pairs = F.array(pair((k - mu) / (mu * grown), k / mu * (spread / grown)), pair((mu - k) / (shape + k), spread / grown))
    deviances = F.transform(pairs, lambda p: _deviance(p["e"], p["ratio"]))
    binomial = errors[1] - errors[2] + (shape + k) / spread * deviances[1]
    poisson = errors[0] + mu * grown / spread * deviances[0] + 0.5 * F.log(2 * math.pi * k * grown)
    return poisson + F.coalesce(binomial, F.lit(0.0))


def _short_loss(k: Column, mu: Column, a: Column) -> Column:
    """-ln P(X = k) for 0 <= k <= ``_SHORT``: the ratios to P(0) multiplied one by one, with a logarithm at the end."""
    product = F.lit(1.0)
    for j in range(1, _SHORT):
        product = product * F.when(k > j, (1 + a * j) * (1 / (j + 1))).otherwise(F.lit(1.0))
    return -(F.log(product) + k * F.log(mu / (1 + a * mu)) + _log_p0(mu, a))


def _log_loss(k: Column, mu: Column, a: Column) -> Column:
    # the closed form is long: inside a lambda it stays out of the stage's compiled code, and runs for large counts alone
    cell = F.array(F.struct(k.alias("k"), mu.alias("mu"), a.alias("a")))
    closed = F.transform(cell, _closed_loss)[0]
    return F.when((k <= _SHORT) & (a < _SHORT_DISPERSION), _short_loss(k, mu, a)).when(k == 0, -_log_p0(mu, a)).otherwise(closed)


def negative_log_loss(count: Column, mu: Column, alpha: Column | None = None) -> Column:
    """-ln P(X = count), for any whole count; NULL where the mean or dispersion is not usable."""
    alpha = F.lit(0.0) if alpha is None else alpha
    return F.when(usable(mu, alpha) & (count >= 0), _log_loss(count.cast("double"), mu, _effective(alpha)))


def add_log_loss(
    df: DataFrame, name: str = "nll", count: str = "actual", expected: str = "expected", dispersion: str = "dispersion"
) -> DataFrame:
    """Add ``negative_log_loss``; what it uses again and again is computed once, in a projection of its own."""
    mu, alpha = F.col(expected), F.col(dispersion)
    scored = usable(mu, alpha) & (F.col(count) >= 0)
    staged = df.withColumns({"_k": F.when(scored, F.col(count).cast("double")), "_alpha": F.when(scored, _effective(alpha))})
    k, a = F.col("_k"), F.col("_alpha")
    return staged.withColumn(name, F.when(k.isNotNull(), _log_loss(k, mu, a))).drop("_k", "_alpha")


def moment_dispersion(n: Column, total: Column, squares: Column) -> Column:
    """Method-of-moments dispersion from prefix sums; 0 where it is not estimable."""
    n, total, squares = (c.cast("double") for c in (n, total, squares))
    # the condition below keeps all divisors but the last from being zero
    mean = total / n
    variance = (squares - total * total / n) / (n - 1)
    excess = (variance - mean) / F.nullif(mean * mean, F.lit(0.0))
    return F.when((n >= 2) & (total > 0), F.greatest(F.lit(0.0), excess)).otherwise(F.lit(0.0))


def poisson_events(home_rate: Column, away_rate: Column) -> tuple[Column, Column]:
    """(P(total >= 3), P(both sides score)) for independent Poisson sides."""
    s = home_rate + away_rate
    over = clamp01(1 - F.exp(-s) * (1 + s + s * s / 2))
    both = clamp01(F.expm1(-home_rate) * F.expm1(-away_rate))
    valid = (home_rate >= 0) & (away_rate >= 0) & ~F.isnan(s) & (s < F.lit(float("inf")))
    return F.when(valid, over), F.when(valid, both)


def low_score_coefficients(home_rate: Column, away_rate: Column) -> Column:
    """Coefficient of rho in the multiplier of the cells 0-0, 0-1, 1-0, 1-1."""
    return F.array(-home_rate * away_rate, home_rate, away_rate, F.lit(-1.0))


def dixon_coles_valid(home_rate: Column, away_rate: Column, rho: Column) -> Column:
    """All four corrected cell multipliers are positive."""
    return (
        (1 - home_rate * away_rate * rho > 0)
        & (1 + home_rate * rho > 0)
        & (1 + away_rate * rho > 0)
        & (1 - rho > 0)
    )


def dixon_coles_events(home_rate: Column, away_rate: Column, rho: Column) -> tuple[Column, Column]:
    """The correction moves mass only between totals below 3, so the first event is unchanged."""
    over, both = poisson_events(home_rate, away_rate)
    corrected = both - rho * home_rate * away_rate * F.exp(-home_rate - away_rate)
    valid = dixon_coles_valid(home_rate, away_rate, rho) & corrected.between(0.0, 1.0)
    return F.when(valid, over), F.when(valid, corrected)
