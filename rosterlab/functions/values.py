"""Numeric, salary and projection expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rosterlab import constants as C


def to_number(value: Column) -> Column:
    """Numeric value of a text, null when it does not parse."""
    return value.try_cast("double")


def exact_ratio(numerator: Column, denominator: Column, digits: int) -> Column:
    """``numerator / denominator`` of non-negative whole numbers, rounded half up without a float in between."""
    scale = 10**digits
    top, bottom = numerator.cast("bigint"), denominator.cast("bigint")
    scaled = F.call_function("div", top * (2 * scale) + bottom, bottom * 2)
    return F.when(bottom > 0, scaled.cast("double") / float(scale))


def points_per_k(points: Column, salary: Column) -> Column:
    return points / (salary / 1000.0)


def valid_salary(salary: Column) -> Column:
    return salary.isNotNull() & (salary > 0)


def noise_band(salary: Column) -> Column:
    """Relative noise of a projection by salary band."""
    cheap, middle, dear = C.NOISE_BANDS
    return (
        F.when(salary < C.NOISE_LOW_SALARY, F.lit(cheap))
        .when(salary <= C.NOISE_HIGH_SALARY, F.lit(middle))
        .otherwise(F.lit(dear))
    )


def hex_number(digits: Column) -> Column:
    """The number that up to 15 hexadecimal digits stand for."""
    return F.conv(digits, 16, 10).cast("bigint")


def keyed_normal(*keys: Column, seed: int) -> Column:
    """Standard normal draw that depends only on the keys and the seed, never on partitioning."""

    digits = F.md5(F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") for k in keys]).cast("binary"))

    def uniform(start: int) -> Column:
        return (hex_number(F.substr(digits, F.lit(start), F.lit(13))).cast("double") + 0.5) / float(2**52)

    return F.sqrt(-2.0 * F.log(uniform(1))) * F.cos(uniform(14) * (2.0 * 3.141592653589793))


def perturbed(points: Column, salary: Column, *keys: Column, seed: int, alpha: float = C.NOISE_BASE_ALPHA) -> Column:
    """Projection with banded noise; ``alpha`` scales all bands."""
    band = noise_band(salary) * (alpha / C.NOISE_BASE_ALPHA)
    return points * (1.0 + keyed_normal(*keys, seed=seed) * band)


def season_of(date: Column) -> Column:
    """January games belong to the season of the year before."""
    return F.when(F.month(date) == 1, F.year(date) - 1).otherwise(F.year(date))


def coerce_timestamp(value: Column) -> Column:
    return F.try_to_timestamp(value)


def default_salary(salary: Column) -> Column:
    return F.coalesce(salary, F.lit(C.PLACEHOLDER_SALARY))


def salary_kind(salary: Column) -> Column:
    return F.when(salary != C.PLACEHOLDER_SALARY, F.lit("REAL")).otherwise(F.lit("PLACEHOLDER"))


def linear_fallback(features: list[Column]) -> Column:
    """Score of a position without a model: weighted sum of its features, nulls as zero."""
    total = F.lit(0.0)
    for feature in features:
        total = total + F.coalesce(feature, F.lit(0.0))
    return total * C.LINEAR_FALLBACK_WEIGHT


def constant_fallback(pos: Column, fp_avg_3: Column) -> Column:
    """Constant for defenses, recent average for a position whose model failed."""
    return F.when(pos == "DST", F.lit(C.DEFENSE_PROJECTION)).otherwise(fp_avg_3)
