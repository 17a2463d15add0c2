"""Serving queries for all keys at once, research context, checks of written reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, DateType, MapType, NumericType, StringType, StructType, TimestampType

from quaylark.functions.columns import flag, latest

# The stance words of a report; periods that are no claims; unit factors.
STANCES = ("SUPPORTED", "PARTIALLY_SUPPORTED", "NOT_SUPPORTED", "INSUFFICIENT_DATA")
PERIODS = (1, 7, 10, 14, 20, 30, 50, 52, 90, 365)
UNITS = {"K": 1e3, "M": 1e6, "B": 1e9, "T": 1e12}
# Words that say a decline.
DECLINE = ("below", "decline", "declined", "declining", "decrease", "decreased", "decreasing", "down", "drop", "dropped", "fall", "fallen", "fell", "loss", "lost", "lower", "negative", "under")
#: Characters on either side of a claim that are its context.
CONTEXT = 45
REPORT = "struct<ticker:string,stance:string,summary:string,risks:array<string>,disclaimer:string,data_as_of:string>"
_NUMBER = r"(?<![A-Za-z0-9_.#])([+-]?[0-9]{1,3}(?:,[0-9]{3})+(?:\.[0-9]+)?|[+-]?[0-9]+(?:\.[0-9]+)?)(?:\s*([KMBT])(?![A-Za-z]))?"
_DATE = r"\b([0-9]{4}-[0-9]{2}-[0-9]{2})\b"


def last_n(df: DataFrame, n: int, *, key: str = "ticker", ts: str = "date", keys: DataFrame | None = None) -> DataFrame:
    """The last n rows of each key, oldest first inside it (`place` counts back from 1)."""
    if not 1 <= n <= 365:
        raise ValueError("n must be from 1 to 365")
    df = df if keys is None else df.join(keys.select(key).distinct(), key, "left_semi")
    return df.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(F.col(ts).desc()))).where(F.col("place") <= n)


def report_page(reports: DataFrame, n: int, *, ticker: str | None = None, ts: str = "created", user: str = "user_id") -> DataFrame:
    """The newest n reports of each user, of one ticker if given, newest first (`place`)."""
    if not 1 <= n <= 500:
        raise ValueError("n must be from 1 to 500")
    df = reports if ticker is None else reports.where(F.col("ticker") == ticker)
    w = Window.partitionBy(user).orderBy(F.col(ts).desc(), F.col("report_id").desc())
    return df.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def anomaly_summary(events: DataFrame) -> DataFrame:
    """Per key: events by severity, average and highest score, the latest one."""
    sev = [F.count_if(F.col("severity") == s).alias(f"{s.lower()}_count") for s in ("CRITICAL", "HIGH", "MEDIUM", "LOW")]
    newest = F.max_by(F.struct("date", "severity", "anomaly_score"), "date").alias("latest")
    out = events.where("is_anomaly").groupBy("ticker").agg(F.count(F.lit(1)).alias("total"), *sev, F.round(F.round(F.avg("anomaly_score"), 9), 4).alias("avg_score"), F.round(F.round(F.max("anomaly_score"), 9), 4).alias("max_score"), newest)
    return out.select("*", F.col("latest.date").alias("latest_date"), F.col("latest.severity").alias("latest_severity")).drop("latest")


def watchlist_latest(watch: DataFrame, metrics: DataFrame, columns: list[str]) -> DataFrame:
    """Each watched pair with the latest row of its ticker, or the status NOT_FOUND_IN_GOLD."""
    now = latest(metrics, "ticker", [F.col("date").desc()]).select("ticker", "date", *columns)
    return watch.join(now, "ticker", "left").withColumn("status", F.when(F.col("date").isNull(), "NOT_FOUND_IN_GOLD").otherwise("OK"))


def plain_text(text: Column) -> Column:
    """Dashes and spaces of other kinds become plain ones."""
    return F.translate(text, "‐‑‒–—−   ", "------   ")


def numeric_claims(reports: DataFrame, *, text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(report_id, place, raw, value, decimals, factor, context): the numbers that a text
    claims, with the characters around them, and the columns `keep` of its report. Dates are
    taken out first; whole numbers without unit that name a period are no claims."""
    number = F.lit(_NUMBER)
    body = F.regexp_replace(plain_text(F.coalesce(F.col(text_col), F.lit(""))), _DATE, " ")
    df = reports.select("report_id", *keep, body.alias("b")).select("report_id", *keep, "b", F.split("b", _NUMBER, -1).alias("gap"), *[F.regexp_extract_all("b", number, i).alias(c) for i, c in ((0, "all"), (1, "n"), (2, "u"))])
    df = df.select("report_id", *keep, "b", "gap", "all", F.posexplode(F.arrays_zip("n", "u")).alias("place", "x"))
    # A claim begins where the gaps and claims ahead of it end.
    length = lambda parts: F.aggregate(parts, F.lit(0), lambda n, x: n + F.length(x))
    at = length(F.slice("gap", F.lit(1), F.col("place") + 1)) + length(F.slice("all", F.lit(1), F.col("place")))
    first = F.greatest(at - CONTEXT, F.lit(0))
    context = F.substring(F.col("b"), first + 1, at - first + F.length(F.get("all", F.col("place"))) + CONTEXT)
    digits = F.regexp_replace("x.n", ",", "")
    factor = F.lit(1.0)
    for u, f in UNITS.items():
        factor = F.when(F.col("x.u") == u, f).otherwise(factor)
    value = digits.cast("double")
    df = df.select("report_id", "place", F.concat("x.n", "x.u").alias("raw"), (value * factor).alias("value"), F.when(F.contains(digits, F.lit(".")), F.length(F.substring_index(digits, ".", -1))).otherwise(0).alias("decimals"), factor.alias("factor"), context.alias("context"), *keep)
    period = (F.col("factor") == 1) & (F.col("decimals") == 0) & F.col("value").isin(*[float(p) for p in PERIODS])
    return df.where(~period)


def rounds_to(shown: Column, source: Column) -> Column:
    """Whether a shown number is the source, or how it may be rounded: whole numbers against
    whole numbers are exact; else half a unit for a shown whole number, the larger of 0.02
    and half a percent, or one decimal."""
    whole = lambda x: x == F.floor(x)
    gap = F.abs(shown - source)
    near = (whole(shown) & (gap <= 0.5)) | (gap <= F.greatest(F.lit(0.02), F.abs(source) * 0.005)) | (F.abs(shown - F.round(source, 1)) < 1e-9)
    return (shown == source) | (~(whole(shown) & whole(source)) & near)


def explains(claim: Column, source: Column, factor: Column, context: Column) -> Column:
    """Whether a source value explains a claim: as it is, in the claim's unit, or, with a word
    of decline near the claim, as the size of a negative value."""
    decline = F.arrays_overlap(F.split(F.lower(context), "[^a-z]+"), F.array(*[F.lit(w) for w in DECLINE]))
    return rounds_to(claim, source) | ((factor != 1) & rounds_to(claim / factor, source / factor)) | ((claim > 0) & (source < 0) & decline & rounds_to(claim, -source))


def _flat(value: Column, kind: DataType) -> tuple[Column, Column]:
    """Numbers and days inside a value of this type, as arrays."""
    numbers, days = F.array().cast("array<double>"), F.array().cast("array<string>")
    if isinstance(kind, NumericType):
        numbers = F.array(value.cast("double"))
    elif isinstance(kind, (DateType, TimestampType)):
        days = F.array(value.cast("date").cast("string"))
    elif isinstance(kind, StringType):
        days = F.regexp_extract_all(value, F.lit(_DATE), 1)
    elif isinstance(kind, StructType) and kind.fields:
        parts = [_flat(value[f.name], f.dataType) for f in kind.fields]
        numbers, days = (F.concat(*[F.coalesce(p[i], empty) for p in parts]) for i, empty in ((0, numbers), (1, days)))
    elif isinstance(kind, ArrayType):
        inner = [F.flatten(F.transform(value, part)) for part in (lambda x: _flat(x, kind.elementType)[0], lambda x: _flat(x, kind.elementType)[1])]
        numbers, days = F.concat(F.array(F.size(value).cast("double")), inner[0]), inner[1]
    elif isinstance(kind, MapType):
        held = F.map_values(value)
        numbers, days = (F.flatten(F.transform(held, part)) for part in (lambda x: _flat(x, kind.valueType)[0], lambda x: _flat(x, kind.valueType)[1]))
    return F.coalesce(numbers, F.array().cast("array<double>")), F.coalesce(days, F.array().cast("array<string>"))


def source_values(contexts: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(keys, value) and (keys, day) of all that the other columns hold, however deep: numbers,
    lengths of lists, dates and ISO dates in text, in the values of maps too. Booleans,
    unknowns and text that only looks like a day give none."""
    found = [_flat(F.col(f.name), f.dataType) for f in contexts.schema if f.name not in keys]
    values, days = (contexts.select(*keys, F.explode(F.concat(*[p[i] for p in found])).alias(name)) for i, name in ((0, "value"), (1, "day")))
    return values.where("value is not null").distinct(), days.select(*keys, F.col("day").try_cast("date").alias("day")).where("day is not null").distinct()


def value_sets(contexts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, values, days): what `source_values` gives, as two sets for each of the contexts."""
    found = [_flat(F.col(f.name), f.dataType) for f in contexts.schema if f.name not in keys]
    values, days = (F.concat(*[p[i] for p in found]) for i in (0, 1))
    # Sets of an array tell the zeros apart, which are one value.
    values = F.transform(values, lambda v: v + F.lit(0.0))
    distinct = lambda x: F.array_distinct(F.array_compact(x))
    return contexts.select(*keys, distinct(values).alias("values"), distinct(F.transform(days, lambda d: d.try_cast("date"))).alias("days"))


def ground(reports: DataFrame, sources: DataFrame, *, text_col: str = "text") -> DataFrame:
    """The claims of each report with `grounded`: whether one of the report's source values
    explains it. sources(report_id, value); claims meet the values of their own report only."""
    # A report meets its values once, before its claims are told apart; collect_set drops nulls.
    held = sources.groupBy("report_id").agg(F.collect_set("value").alias("_held"))
    claims = numeric_claims(reports.select("report_id", text_col).join(held.hint("merge"), "report_id", "left"), text_col=text_col, keep=("_held",))
    return claims.withColumn("grounded", flag(F.exists("_held", lambda v: explains(F.col("value"), v, F.col("factor"), F.col("context"))))).drop("_held")


def verdicts(reports: DataFrame, claims: DataFrame, dates: DataFrame) -> DataFrame:
    """Per report(report_id, ticker, text, document): numbers and dates checked, structure
    errors, PASS or FAIL. dates(report_id, day) are the days that the sources know."""
    doc = F.from_json("document", REPORT)
    known = dates.groupBy("report_id").agg(F.collect_set(F.col("day").cast("string")).alias("known"))
    n = claims.groupBy("report_id").agg(F.count(F.lit(1)).alias("claims"), F.count_if(~F.col("grounded")).alias("ungrounded"))
    df = reports.withColumn("_d", doc).join(n, "report_id", "left").join(known, "report_id", "left").fillna(0, subset=["claims", "ungrounded"])
    said = F.array_distinct(F.regexp_extract_all(plain_text(F.coalesce("text", F.lit(""))), F.lit(_DATE), 1))
    df = df.withColumn("unknown_dates", F.size(F.array_except(said, F.coalesce("known", F.array().cast("array<string>")))))
    errors = {
        "document": F.col("_d").isNull(), "ticker": ~F.coalesce(F.col("_d.ticker") == F.col("ticker"), F.lit(False)), "stance": ~F.coalesce(F.col("_d.stance").isin(*STANCES), F.lit(False)),
        "risks": F.coalesce(F.size("_d.risks"), F.lit(0)) == 0, "disclaimer": F.coalesce(F.trim("_d.disclaimer"), F.lit("")) == "", "numbers": F.col("ungrounded") > 0, "dates": F.col("unknown_dates") > 0,
    }
    df = df.withColumn("errors", F.array_join(F.array_compact(F.array(*[F.when(c, k) for k, c in errors.items()])), ","))
    return df.select("report_id", "claims", "ungrounded", "unknown_dates", "errors", F.when(F.col("errors") == "", "PASS").otherwise("FAIL").alias("verdict"))
