"""Cleaning: normalise, judge by named rules, keep the latest, derive features."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaylark.functions.columns import latest, ratio

PRICES = ("open", "high", "low", "close")


def judge(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """df with `valid` and `failed`, the names of rules that don't hold; unknown is failed."""
    failed = F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(False)), name) for name, c in rules.items()]))
    return df.withColumn("failed", failed).withColumn("valid", F.size("failed") == 0)


def split_valid(df: DataFrame, rules: Mapping[str, Column]) -> tuple[DataFrame, DataFrame]:
    judged = judge(df, rules)
    return judged.where("valid").drop("valid", "failed"), judged.where("not valid").drop("valid")


def normalise_prices(df: DataFrame, *, key: str = "ticker") -> DataFrame:
    return df.withColumns({key: F.upper(F.trim(key))} | {c: F.round(F.round(c, 9), 4) for c in (*PRICES, "vwap")})


def price_rules(*, key: str = "ticker", ts: str = "date") -> dict[str, Column]:
    o, h, l, c = (F.col(x) for x in PRICES)
    none_or = lambda col, cond: F.col(col).isNull() | cond
    return {
        "key": F.col(key).isNotNull() & F.col(ts).isNotNull(),
        "prices_positive": (o > 0) & (h > 0) & (l > 0) & (c > 0),
        "high_is_highest": (h >= o) & (h >= l) & (h >= c),
        "low_is_lowest": (l <= o) & (l <= h) & (l <= c),
        "volume": none_or("volume", F.col("volume") >= 0),
        "transactions": none_or("transactions", F.col("transactions") >= 0),
        "vwap": none_or("vwap", F.col("vwap") > 0),
    }


def intraday(df: DataFrame) -> DataFrame:
    """Features of one bar: close against open, and its range."""
    four = lambda c: F.round(F.round(c, 9), 4)
    o = F.col("open")
    return df.withColumns({"intraday_change": four(F.col("close") - o), "intraday_change_pct": four(ratio(F.col("close") - o, o, positive=True) * 100), "daily_range": four(F.col("high") - F.col("low")), "daily_range_pct": four(ratio(F.col("high") - F.col("low"), o, positive=True) * 100)})


def company_features(df: DataFrame, as_of: str) -> DataFrame:
    """Tidy name, market value in billions and full years listed on a given day."""
    years = F.floor(F.months_between(F.lit(as_of).cast("date"), F.col("list_date")) / 12)
    return df.withColumns({"name": F.trim("name"), "market_cap_billions": F.round(F.round(F.col("market_cap") / 1e9, 9), 4), "years_listed": years, "valid": F.coalesce(F.col("ticker").isNotNull() & (F.trim("name") != "") & (F.col("market_cap").isNull() | (F.col("market_cap") >= 0)), F.lit(False))})


# How each text column of a company is written; numbers that aren't negative.
COMPANY_TEXT = {
    "upper": ("ticker", "ticker_root", "ticker_suffix", "primary_exchange", "type", "currency_name", "state"),
    "lower": ("market", "locale"),
    "trim": ("name", "description", "cik", "composite_figi", "share_class_figi", "sic_code", "sic_description", "homepage_url", "phone_number", "address1", "city", "postal_code", "logo_url", "icon_url"),
}
COMPANY_NUMBERS = ("market_cap", "total_employees", "weighted_shares_outstanding", "share_class_shares_outstanding", "round_lot")


def normalise_companies(df: DataFrame) -> DataFrame:
    """Text trimmed and in the case of its class; columns that df lacks are left out."""
    how = {"upper": lambda c: F.upper(F.trim(c)), "lower": lambda c: F.lower(F.trim(c)), "trim": F.trim}
    return df.withColumns({c: how[k](F.col(c)) for k, cs in COMPANY_TEXT.items() for c in cs if c in df.columns})


def company_rules() -> dict[str, Column]:
    """What makes a company valid: key and name, and no negative number."""
    return {c: F.length(c) > 0 for c in ("ticker", "name")} | {c: F.col(c).isNull() | (F.col(c) >= 0) for c in COMPANY_NUMBERS}


def company_profile(df: DataFrame, as_of: str) -> DataFrame:
    """Market value in billions, full years listed on a given day, and `city, state`."""
    years = F.floor(F.months_between(F.lit(as_of).cast("date"), F.col("list_date")) / 12)
    return df.withColumns({"market_cap_billions": F.round(F.round(F.col("market_cap") / 1e9, 9), 4), "years_listed": years, "location": F.concat_ws(", ", "city", "state")})


def latest_versions(df: DataFrame, keys: list[str], *, version: str = "_ingested_at") -> DataFrame:
    """One row a key: the last that was loaded; of those loaded at one time the row whose
    values come last, so that reruns agree."""
    rest = [F.col(c).desc_nulls_last() for c in df.columns if c not in (*keys, version)]
    return latest(df, keys, [F.col(version).desc_nulls_last(), *rest])
