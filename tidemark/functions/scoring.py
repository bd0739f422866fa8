"""Scores as column expressions over candidates, behaviour and preferences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Policy parameters.
HALF_LIFE_DAYS = {"post": 14.0, "slow": 30.0}
WILSON_Z = 1.96
ENGAGEMENT_WEIGHTS = {"likes": 0.25, "saves": 0.5, "shares": 0.25}
ENGAGEMENT_LEAST = 20
#: Exposures of a full volume bonus, and days looked back, by type; other types have no engagement.
ENGAGEMENT_REFERENCE = {"POST": 500, "JOURNEY": 200}
ENGAGEMENT_DAYS = {"POST": 14, "JOURNEY": 30}
COMPOSITION = {"context": 0.40, "interest": 0.35, "freshness": 0.15, "popularity": 0.10}
NEUTRAL = 0.5
DECAY_DAYS = ((7, 1.0), (30, 0.8), (90, 0.5))
DECAY_REST = 0.25
SATURATION = 10.0
NORMAL_P, NORMAL_B = 0.2316419, (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)
EXPLORATION = {"freshness": 4.0, "popularity": 3.0}


def ln1p(c: Column) -> Column:
    return F.ln(1 + c)


def age_days(at: Column, now: Column) -> Column:
    return (F.unix_millis(now) - F.unix_millis(at)) / F.lit(86_400_000.0)


def freshness(days: Column, half_life: float) -> Column:
    """2 ** (-days / half life); null for a time in the future."""
    return F.when(days >= 0, F.pow(F.lit(2.0), -days / half_life))


def wilson(successes: Column, n: Column) -> Column:
    """Lower bound of the Wilson interval; null without trials."""
    z2 = WILSON_Z * WILSON_Z
    p = successes / n
    return F.when(n > 0, (p + z2 / (2 * n) - WILSON_Z * F.sqrt((p * (1 - p) + z2 / (4 * n)) / n)) / (1 + z2 / n))


def by_type(values: dict[str, int], type_: Column) -> Column:
    """The value of a type; null for a type without one."""
    return F.create_map(*(F.lit(x) for kv in values.items() for x in kv))[type_]


def engagement(exposure: Column, counts: dict[str, Column], type_: Column) -> Column:
    """Weighted Wilson bounds with a bonus for volume; null below ENGAGEMENT_LEAST exposures and for types without engagement."""
    total = F.lit(0.0)
    for name, weight in ENGAGEMENT_WEIGHTS.items():
        total = total + weight * wilson(counts[name].cast("double"), exposure.cast("double"))
    volume = 0.75 + 0.25 * F.least(F.lit(1.0), ln1p(exposure) / ln1p(by_type(ENGAGEMENT_REFERENCE, type_).cast("double")))
    return F.when((exposure >= ENGAGEMENT_LEAST) & by_type(ENGAGEMENT_REFERENCE, type_).isNotNull(), total * volume)


def clamp(c: Column, lo: float = 0.0, hi: float = 1.0) -> Column:
    """Within bounds, and with a plain zero for a negative one."""
    c = F.least(F.lit(hi), F.greatest(F.lit(lo), c))
    return F.when(c == 0, 0.0).otherwise(c)


def compose(parts: dict[str, Column]) -> Column:
    """Weighted mean; a missing part counts NEUTRAL; null when every part is missing."""
    total = F.lit(0.0)
    for name, weight in COMPOSITION.items():
        total = total + weight * F.coalesce(parts[name], F.lit(NEUTRAL))
    return F.when(F.coalesce(*parts.values()).isNotNull(), total)


def raw_popularity(views: Column, likes: Column, saves: Column) -> Column:
    return ln1p(views) + 2 * ln1p(likes) + 3 * ln1p(saves)


def low_exposure_boost(exposures: Column, threshold: int, most: float) -> Column:
    return F.when(exposures >= threshold, 0.0).otherwise(most * (threshold - exposures) / threshold)


def time_decay(days: Column) -> Column:
    out = F.when(days <= DECAY_DAYS[0][0], DECAY_DAYS[0][1])
    for limit, weight in DECAY_DAYS[1:]:
        out = out.when(days <= limit, weight)
    return out.otherwise(DECAY_REST)


def saturate(x: Column) -> Column:
    return 1 - F.exp(-F.greatest(F.lit(0.0), x) / SATURATION)


def exploration_quality(fresh: Column, popular: Column) -> Column:
    """Weighted mean of the parts there are; null without any."""
    w = F.when(fresh.isNotNull(), EXPLORATION["freshness"]).otherwise(0.0) + F.when(popular.isNotNull(), EXPLORATION["popularity"]).otherwise(0.0)
    s = F.coalesce(fresh, F.lit(0.0)) * EXPLORATION["freshness"] + F.coalesce(popular, F.lit(0.0)) * EXPLORATION["popularity"]
    return F.when(w > 0, s / w)


def haversine_km(lat: Column, lon: Column, lat0: Column, lon0: Column) -> Column:
    h = F.pow(F.sin(F.radians(lat - lat0) / 2), 2) + F.cos(F.radians(lat0)) * F.cos(F.radians(lat)) * F.pow(F.sin(F.radians(lon - lon0) / 2), 2)
    return 2 * 6371.0088 * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def normal_tail(z: Column) -> Column:
    """Two-sided p-value of z by a polynomial for the normal distribution function (Abramowitz and Stegun 26.2.17)."""
    x = F.abs(z)
    t = 1 / (1 + NORMAL_P * x)
    poly = F.lit(0.0)
    for b in reversed(NORMAL_B):
        poly = t * (b + poly)
    return F.least(F.lit(1.0), 2 * F.exp(-x * x / 2) / F.sqrt(2 * F.pi()) * poly)
