"""The intercept that gives a logistic model its target rate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import sigmoid

LOWEST, HIGHEST = -40.0, 40.0


class CalibrationError(ValueError):
    pass


def intercepts(df: DataFrame, scores: dict[str, tuple[Column, float, Column | None]], tolerance: float = 1e-6, rounds: int = 50) -> dict[str, float]:
    """name -> b with mean(sigmoid(b + score)) = target over the counted rows. scores: name -> (score, target, counted or None).

    Newton steps inside a bracket that halves whenever a step leaves it. All
    models of a table are solved together: a round is one aggregate. Targets of
    0 and 1 give the ends; no counted row gives the target's own log odds.
    """
    import math

    b, low, high, open_ = {}, {}, {}, []
    for name, (_, target, _) in scores.items():
        if not 0 <= target <= 1:
            raise CalibrationError(f"{name}: target {target} is no share")
        low[name], high[name] = LOWEST, HIGHEST
        b[name] = LOWEST if target == 0 else HIGHEST if target == 1 else math.log(target / (1 - target))
        if 0 < target < 1:
            open_.append(name)
    residual = dict.fromkeys(open_, 1.0)
    for _ in range(rounds):
        if not open_:
            break
        aggs = []
        for i, name in enumerate(open_):
            score, _, counted = scores[name]
            p = sigmoid(score + F.lit(b[name]))
            keep = (lambda x, c=counted: x if c is None else F.when(c, x))
            aggs += [F.avg(keep(p)).alias(f"p{i}"), F.avg(keep(p * (1 - p))).alias(f"d{i}")]
        row = df.agg(*aggs).first()
        still = []
        for i, name in enumerate(open_):
            mean, slope, target = row[f"p{i}"], row[f"d{i}"], scores[name][1]
            if mean is None:
                residual[name] = 0.0
                continue
            residual[name] = gap = mean - target
            if abs(gap) <= tolerance:
                continue
            (high if gap > 0 else low)[name] = b[name]
            step = b[name] - gap / slope if slope > 1e-12 else math.inf
            b[name] = step if low[name] < step < high[name] else (low[name] + high[name]) / 2
            still.append(name)
        open_ = still
    if bad := [f"{n}: {residual[n]:.3g} off its target" for n in open_ if abs(residual[n]) > 50 * tolerance]:
        raise CalibrationError("; ".join(bad))
    return b


def recovered_beta(df: DataFrame, x: Column, y: Column) -> Column:
    """cov(x, y) / var(x) / (p (1 - p)): an aggregate that estimates a coefficient from realised outcomes."""
    return F.covar_pop(x, y) / F.var_pop(x) / (F.avg(y) * (1 - F.avg(y)))
