"""Stateless and derived scalar features as column expressions, for batch and streaming alike."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.plans.spec import HOUR

EARTH_KM = 6371.0088
#: Spending categories in the order of their codes.
CATEGORIES = ("entertainment", "food_dining", "gas_transport", "grocery_net", "grocery_pos", "health_fitness", "home", "kids_pets", "misc_net", "misc_pos", "personal_care", "shopping_net", "shopping_pos", "travel")
PRIOR = 200.0


def hour(us: Column) -> Column:
    return F.pmod(F.floor(us / HOUR), F.lit(24)).cast("int")


def day_of_week(us: Column) -> Column:
    """Monday is 0."""
    return F.pmod(F.floor(us / (24 * HOUR)) + 3, F.lit(7)).cast("int")


def is_night(us: Column) -> Column:
    h = hour(us)
    return ((h >= 22) | (h < 4)).cast("double")


def age_years(us: Column, dob_days: Column) -> Column:
    return (us / (24.0 * HOUR) - dob_days) / 365.25


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def category_code(category: Column, categories: Sequence[str] = CATEGORIES) -> Column:
    """Position among the categories, -1 for others."""
    return F.coalesce(F.array_position(F.array(*map(F.lit, categories)), category) - 1, F.lit(-1)).cast("double")


def ratio(num: Column, den: Column) -> Column:
    """num / den, null where there is none."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def zscore(x: Column, mean: Column, std: Column) -> Column:
    return F.when(std > 0, (x - mean) / std)


def smoothed_rate(cb: Column, n: Column, all_cb: Column, all_n: Column, prior: float = PRIOR) -> Column:
    """Chargeback rate drawn to the global one by ``prior`` transactions."""
    base = F.coalesce(ratio(all_cb, all_n), F.lit(0.0))
    return (cb + prior * base) / (n + prior)


#: Row features by name, from columns us, amount, category, gender, dob_days, city_pop and the two positions.
ROW_FEATURES = {
    "amount": lambda: F.col("amount").cast("double"),
    "hour": lambda: hour(F.col("us")),
    "day_of_week": lambda: day_of_week(F.col("us")),
    "is_night": lambda: is_night(F.col("us")),
    "age_years": lambda: age_years(F.col("us"), F.col("dob_days")),
    "gender_m": lambda: (F.col("gender") == "M").cast("double"),
    "log_city_pop": lambda: F.ln("city_pop"),
    "dist_home_km": lambda: haversine_km(F.col("home_lat"), F.col("home_lon"), F.col("merch_lat"), F.col("merch_lon")),
    "category_code": lambda: category_code(F.col("category")),
}

#: Features derived from aggregates and the amount.
DERIVED = {
    "amount_to_card_mean": lambda: ratio(F.col("amount"), F.col("card__mean_amount_all")),
    "amount_zscore_card": lambda: zscore(F.col("amount"), F.col("card__mean_amount_all"), F.col("card__std_amount_all")),
    "amount_to_card_max_7d": lambda: ratio(F.col("amount"), F.col("card__max_amount_7d")),
    "amount_to_card_category_mean": lambda: ratio(F.col("amount"), F.col("card_category__mean_amount_all")),
    "card_avg_amount_24h": lambda: ratio(F.col("card__sum_amount_24h"), F.col("card__count_24h")),
    "merchant_cb_rate_30d": lambda: smoothed_rate(*(F.col(c) for c in ("merchant__cb_count_30d", "merchant__count_30d", "global__cb_count_30d", "global__count_30d"))),
    "category_cb_rate_30d": lambda: smoothed_rate(*(F.col(c) for c in ("category__cb_count_30d", "category__count_30d", "global__cb_count_30d", "global__count_30d"))),
}

#: Aggregates that only feed derived features.
NOT_FOR_MODELS = ("global__count_30d", "global__cb_count_30d", "card__sum_amount_24h")
#: What a model without card history does without, besides all aggregates by card.
FROM_HISTORY = ("amount_to_card_mean", "amount_zscore_card", "amount_to_card_max_7d", "amount_to_card_category_mean", "card_avg_amount_24h")


def model_features(aggregates: Sequence[str]) -> list[str]:
    return [*ROW_FEATURES, *(a for a in aggregates if a not in NOT_FOR_MODELS), *DERIVED]


def without_history(features: Sequence[str]) -> list[str]:
    return [f for f in features if not f.startswith(("card__", "card_category__")) and f not in FROM_HISTORY]
