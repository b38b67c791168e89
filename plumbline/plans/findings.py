"""Severity rules: result tables in, one findings table out.

Every finding has operator, subject, metric, value, severity and message;
severity is ``ok``, ``warn`` or ``bad``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COLUMNS = ["operator", "subject", "metric", "value", "severity", "message"]


def finding(df: DataFrame, operator: str, subject: Column, metric: str | Column, value: Column,
            severity: Column, message: Column) -> DataFrame:
    metric = F.lit(metric) if isinstance(metric, str) else metric
    return df.select(F.lit(operator).alias("operator"), subject.cast("string").alias("subject"),
                     metric.alias("metric"), value.cast("double").alias("value"),
                     severity.alias("severity"), message.alias("message"))


def subject_of(keys: list[str]) -> Column:
    return F.concat_ws(" / ", *[F.col(k).cast("string") for k in keys])


def stars(p: Column) -> Column:
    return F.when(p < 0.01, "***").when(p < 0.05, "**").when(p < 0.10, "*").otherwise("")


def p_severity(p: Column) -> Column:
    return F.when(p < 0.05, "bad").when(p < 0.10, "warn").otherwise("ok")


def flag(hit: Column, yes: str, no: str, severity_yes: str = "bad", severity_no: str = "ok") -> tuple:
    return F.when(hit, severity_yes).otherwise(severity_no), F.when(hit, yes).otherwise(no)


def p_values(df: DataFrame, operator: str, subject: Column, test: Column, p: str = "p_value") -> DataFrame:
    col = F.col(p)
    return finding(df.where(col.isNotNull()), operator, subject, test, col, p_severity(col),
                   F.concat(F.lit("p = "), F.format_number(col, 4), F.when(stars(col) == "", "").otherwise(
                       F.concat(F.lit(" "), stars(col)))))


def outlier_findings(outliers: DataFrame) -> DataFrame:
    sev, msg = flag(F.col("n_outliers") > 0, "Outliers found", "No outliers")
    return finding(outliers, "outliers", F.col("column"), "n_outliers", F.col("n_outliers"), sev, msg)


def vif_findings(vif: DataFrame) -> DataFrame:
    v = F.col("vif")
    return finding(vif.where(v.isNotNull()), "vif", F.col("column"), "vif", v,
                   F.when(v > 10, "bad").when(v > 5, "warn").otherwise("ok"),
                   F.when(v > 10, "High (>10)").when(v > 5, "Moderate (5-10)").otherwise("Low (<= 5)"))


def condition_findings(cond: DataFrame) -> DataFrame:
    v = F.col("condition_number")
    return finding(cond.where(v.isNotNull()), "condition_number", F.lit("design"), "condition_number", v,
                   F.when(v > 30, "bad").when(v > 15, "warn").otherwise("ok"),
                   F.when(v > 30, "Severe (> 30)").when(v > 15, "Moderate (15-30)").otherwise("Low (<= 15)"))


def heteroskedasticity_findings(table: DataFrame) -> DataFrame:
    sev, msg = flag(F.col("lm_p") < 0.05, "Heteroskedastic", "Homoskedastic")
    return finding(table.where("lm_p IS NOT NULL"), "heteroskedasticity", F.col("test"), "lm_p",
                   F.col("lm_p"), sev, msg)


def frequency_findings(freq: DataFrame, keys: list[str]) -> DataFrame:
    subject = subject_of(keys) if keys else F.lit("table")
    sev, msg = flag(F.col("is_regular"), "Regular series", "Irregular series", "ok", "bad")
    out = finding(freq.where("error IS NULL"), "frequency", subject, "is_regular",
                  F.col("is_regular").cast("int"), sev, msg)
    sev, msg = flag(F.col("expected_match"), "Matches expected frequency",
                    "Differs from expected frequency", "ok", "bad")
    return out.unionByName(finding(freq.where("expected_match IS NOT NULL"), "frequency", subject,
                                   "expected_match", F.col("expected_match").cast("int"), sev, msg))


def stationarity_findings(table: DataFrame, keys: list[str]) -> DataFrame:
    sev, msg = flag(F.col("stationary"), "Stationary", "Non-stationary", "ok", "bad")
    return finding(table.where("stationary IS NOT NULL"), "stationarity", subject_of(keys), F.col("test"),
                   F.col("p_value"), sev, msg)


def ljung_box_findings(table: DataFrame, keys: list[str]) -> DataFrame:
    sev, msg = flag(F.col("p_value") < 0.05, "Autocorrelation detected", "No significant autocorrelation")
    return finding(table.where("p_value IS NOT NULL"), "ljung_box", subject_of(keys), "p_value",
                   F.col("p_value"), sev, msg)


def seasonal_findings(table: DataFrame, keys: list[str]) -> DataFrame:
    v = F.col("seasonal_strength")
    return finding(table.where(v.isNotNull()), "seasonal_strength", subject_of(keys), "seasonal_strength", v,
                   F.when(v >= 0.64, "bad").when(v >= 0.36, "warn").otherwise("ok"),
                   F.when(v >= 0.64, "Strong").when(v >= 0.36, "Moderate").otherwise("Weak"))


def break_findings(tests: DataFrame, keys: list[str]) -> DataFrame:
    sev, msg = flag(F.col("significant"), "Break detected", "No break detected")
    return finding(tests.where("significant IS NOT NULL"), "structural_breaks", subject_of(keys),
                   F.col("test"), F.col("statistic"), sev, msg)


def normality_findings(table: DataFrame) -> DataFrame:
    sev, msg = flag(F.col("is_normal"), "Normal", "Non-normal", "ok", "bad")
    return finding(table.where("is_normal IS NOT NULL"), "normality", F.col("column"), F.col("test"),
                   F.col("p_value"), sev, msg)


def correlation_findings(table: DataFrame, method: str = "pearson", cols: list[str] | None = None) -> DataFrame:
    """Strength of every pair of different columns; ``cols`` limits it to pairs of those."""
    r = F.abs("r")
    rows = table.where("col_a < col_b AND r IS NOT NULL")
    if cols is not None:
        rows = rows.where(F.col("col_a").isin(cols) & F.col("col_b").isin(cols))
    return finding(rows, "correlation", F.concat_ws(" / ", "col_a", "col_b"), method, F.col("r"),
                   F.when(r >= 0.7, "bad").when(r >= 0.4, "warn").otherwise("ok"),
                   F.when(r >= 0.7, "Strong").when(r >= 0.4, "Moderate").otherwise("Weak"))


def arch_findings(table: DataFrame, keys: list[str]) -> DataFrame:
    sev, msg = flag(F.col("has_arch_effects"), "ARCH effects detected", "No ARCH effects")
    return finding(table.where("has_arch_effects IS NOT NULL"), "arch_lm", subject_of(keys), "lm_p",
                   F.col("lm_p"), sev, msg)


def balance_findings(table: DataFrame) -> DataFrame:
    sev, msg = flag(F.col("is_balanced"), "Balanced", "Unbalanced", "ok", "bad")
    return finding(table, "panel_balance", F.lit("panel"), "balance_ratio", F.col("balance_ratio"), sev, msg)


def executive_cards(missing_total: DataFrame, duplicate_rates: DataFrame) -> DataFrame:
    """Missing cells, complete rows and duplicates of the whole table."""
    miss, comp, dup = (F.col(c) for c in (
        "missing_percentage", "complete_row_percentage", "duplicate_percentage"))
    grade = lambda v, low, mid: F.when(v <= low, "ok").when(v <= mid, "warn").otherwise("bad")
    out = finding(missing_total, "summary", F.lit("table"), "missing_percentage", miss, grade(miss, 1, 10),
                  F.lit("Missing cells in percent"))
    out = out.unionByName(finding(
        missing_total, "summary", F.lit("table"), "complete_row_percentage", comp,
        F.when(comp >= 90, "ok").when(comp >= 70, "warn").otherwise("bad"), F.lit("Complete rows in percent")))
    return out.unionByName(finding(
        duplicate_rates, "summary", F.lit("table"), "duplicate_percentage", dup, grade(dup, 0.5, 5),
        F.lit("Duplicate rows in percent")))


def executive_alerts(stationarity: DataFrame, breaks: DataFrame, keys: list[str], first: str) -> DataFrame:
    """ADF and level KPSS of the first value column, and its detected breaks."""
    here = F.col("series") == first
    two = stationarity.where(here & F.col("test").isin("adf", "kpss_level") & F.col("p_value").isNotNull())
    out = finding(two, "summary", subject_of(keys), F.col("test"), F.col("p_value"), F.lit("ok"),
                  F.concat(F.upper("test"), F.lit(" p = "), F.format_number("p_value", 4),
                           F.when(F.col("stationary"), " (Stationary)").otherwise(" (Non-stationary)")))
    found = breaks.where(here & F.col("significant"))
    return out.unionByName(finding(found, "summary", subject_of(keys), F.col("test"), F.col("statistic"),
                                   F.lit("warn"), F.lit("Structural break detected")))
