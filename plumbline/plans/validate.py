"""The validation run: roles, data quality, kind of data, then the checks for that kind.

Results are DataFrames by name. With a sink each one is written as it is ready.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.columns import nested_columns, nulls_for_nan, numeric_columns, q, string_columns, to_moment
from plumbline.functions.series import build_series
from plumbline.functions.tables import write_table
from plumbline.operators import (autocorrelation, breaks, dates, describe, duplicates, missing, panel, regression,
                                 roles, seasonal, shapiro, stationarity)
from plumbline.plans import findings as fd
from plumbline.plans.config import ValidationConfig
from plumbline.sources.readers import profile
from plumbline.sources.sinks import ResultFolder

Results = dict[str, DataFrame]
NO_CALENDAR = "the dates follow no known frequency, so none can be said to be missing"
KINDS = ("cross_sectional", "time_series", "panel")


class Run:
    """Collects results; an operator that fails leaves an ``error`` row and the run goes on."""

    def __init__(self, spark, sink: ResultFolder | None):
        self.spark, self.sink, self.results = spark, sink, {}

    def add(self, name: str, make: Callable[[], DataFrame]) -> DataFrame | None:
        try:
            df = make()
            if self.sink:
                df = write_table(df)
                self.sink.write(name, df)
        except Exception as e:  # noqa: BLE001 - one failing check must not end the run
            df = self.spark.createDataFrame([(name, str(e)[:2000])], "operator string, error string")
            self.results[name] = df
            if self.sink:
                self.sink.write(name, df)
            return None
        self.results[name] = df
        return df


def validate(df: DataFrame, config: ValidationConfig | None = None, sink: ResultFolder | None = None) -> Results:
    """Run all checks that apply to ``df`` and return the result tables by name."""
    cfg = config or ValidationConfig()
    run = Run(df.sparkSession, sink)
    run.add("profile", lambda: profile(df))
    df = nulls_for_nan(df.drop(*nested_columns(df)))
    detected = write_table(roles.detect_dates(df, cfg.date_formats or None))
    run.add("date_detection", lambda: detected)
    date = roles.choose_date(detected, cfg.date_column)
    swapped = date is not None and not detected.where((F.col("column") == date) & F.col("day_first")).isEmpty()
    numeric = cfg.value_columns or [c for c in numeric_columns(df) if c not in (date, cfg.row_id)]
    texts = [c for c in string_columns(df) if c != date]

    _quality(run, df, cfg, date)
    if date is not None:
        # From here on the date column holds moments, whatever shape its text has.
        df = df.withColumn(date, to_moment(df, date, cfg.date_formats, swapped))
    kind = cfg.dataset_type
    if kind is None:
        table = run.add("dataset_type", lambda: roles.classify(df, [date] if date else [], texts))
        kind = table.first()["dataset_type"] if table is not None else "unknown"
    if kind not in KINDS:
        return run.results
    if kind == "cross_sectional":
        _cross_section(run, df, cfg, numeric)
    elif kind == "time_series":
        _time_series(run, df, cfg, date, numeric, [])
    else:
        entity = cfg.entity_column or (texts[0] if texts else None)
        if entity is None:
            run.add("panel", lambda: _fail("Cannot identify entity column"))
            return run.results
        _panel(run, df, cfg, date, entity, numeric)
    return run.results


def _fail(message: str):
    raise ValueError(message)


def _quality(run: Run, df: DataFrame, cfg: ValidationConfig, date: str | None) -> None:
    run.add("missing_columns", lambda: missing.missing_columns(df))
    run.add("missing_by_type", lambda: missing.missing_by_type(df))
    run.add("missing_bands", lambda: missing.missing_bands(df))
    totals = run.add("missing_total", lambda: missing.missing_total(df))
    run.add("populated_columns", lambda: missing.populated_columns(df))
    row_id = cfg.row_id
    rows = df
    if row_id is None:
        row_id = "_row_id"
        # Numbered once and written, so that a lost task cannot number rows anew.
        rows = write_table(df.withColumn(row_id, F.monotonically_increasing_id()))
    names = [c for c in df.columns if c != row_id]
    day = date or duplicates.guess_column(names, duplicates.DATE_WORDS)
    entity = cfg.entity_column or duplicates.guess_column(names, duplicates.ENTITY_WORDS)
    flags = run.add("duplicate_flags", lambda: write_table(duplicates.flag_duplicates(rows, row_id, entity, day, cfg.duplicate_threshold)))
    rates = run.add("duplicate_rates", lambda: duplicates.duplicate_rates(flags)) if flags is not None else None
    run.add("duplicate_groups", lambda: duplicates.first_groups(rows, row_id, entity, day))
    if flags is not None:
        run.add("duplicate_sample", lambda: duplicates.duplicate_sample(rows, flags, row_id))
    texts = [c for c in string_columns(df) if c != date]
    if texts:
        run.add("category_levels", lambda: roles.category_levels(df, texts))
    if totals is not None and rates is not None:
        run.add("findings_summary", lambda: fd.executive_cards(totals, rates))


def _cross_section(run: Run, df: DataFrame, cfg: ValidationConfig, numeric: list[str]) -> None:
    if not numeric:
        run.add("cross_section", lambda: _fail("No numeric columns"))
        return
    run.add("min_max", lambda: describe.min_max(df))
    run.add("describe", lambda: describe.describe(df, numeric))
    run.add("medians", lambda: describe.medians(df, numeric))
    out = run.add("outliers", lambda: describe.outliers(df, numeric, cfg.outlier_method, cfg.outlier_k))
    vif = run.add("vif", lambda: regression.vif(df, numeric))
    cond = run.add("condition_number", lambda: regression.condition_number(df, numeric))
    y = cfg.y_column or numeric[0]
    xs = cfg.x_columns or [c for c in numeric if c != y]
    run.add("ols", lambda: regression.ols(df, y, xs))
    het = run.add("heteroskedasticity", lambda: regression.heteroskedasticity(df, y, xs))
    jb = run.add("jarque_bera", lambda: describe.jarque_bera(df, numeric))
    sw = run.add("shapiro_wilk", lambda: shapiro.shapiro(df, numeric))
    pearson = run.add("pearson", lambda: describe.correlation(df, numeric))
    spearman = run.add("spearman", lambda: describe.correlation(df, numeric, "spearman"))
    rules = [(out, fd.outlier_findings), (vif, fd.vif_findings), (cond, fd.condition_findings),
             (het, fd.heteroskedasticity_findings), (jb, fd.normality_findings), (sw, fd.normality_findings),
             (pearson, lambda t: fd.correlation_findings(t, "pearson", numeric)),
             (spearman, lambda t: fd.correlation_findings(t, "spearman", numeric))]
    _union_findings(run, rules)


def _union_findings(run: Run, rules: list) -> None:
    parts = [rule(table) for table, rule in rules if table is not None]

    def union() -> DataFrame:
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    if parts:
        run.add("findings", union)


def _time_series(run: Run, df: DataFrame, cfg: ValidationConfig, date: str, numeric: list[str],
                 keys: list[str]) -> None:
    rows = df
    run.add("date_range", lambda: dates.date_range(rows, date, keys))
    runs = dates.date_runs(rows, date, keys)
    inferred = write_table(dates.infer_frequency(runs))
    run.add("inferred_frequency", lambda: inferred)
    # Every entity has its own calendar unless the job names one.
    named = cfg.frequency or cfg.panel_frequency
    freq = named or (write_table(inferred.select(*keys, "freq")) if keys else (inferred.select("freq").first() or [None])[0])
    frequencies = run.add("frequency", lambda: dates.frequency(runs, freq))
    run.add("delta_counts", lambda: dates.delta_counts(runs))
    run.add("gaps", lambda: dates.gaps(runs))
    run.add("missing_date_counts", lambda: dates.missing_date_counts(runs, freq) if freq is not None else _fail(NO_CALENDAR))
    run.add("missing_dates", lambda: dates.missing_dates(runs, freq) if freq is not None else _fail(NO_CALENDAR))
    if not numeric:
        return
    if freq is not None and cfg.missing_dates_action in ("forward_fill", "interpolate"):
        run.add("filled_series", lambda: dates.fill_gaps(rows, date, numeric[0], freq, cfg.missing_dates_action, keys))
    series = build_series(rows, date, numeric, keys)
    period = cfg.seasonal_period or inferred.select(*keys, F.col("seasonal_period").alias("period"))
    if isinstance(period, int):
        parts = run.add("stl", lambda: write_table(seasonal.stl(series, period)))
    else:
        parts = run.add("stl", lambda: write_table(seasonal.stl(series, write_table(period))))
    names = series.keys
    strength = run.add("seasonal_strength", lambda: seasonal.seasonal_strength(series, period, parts))
    if not keys:
        run.add("acf", lambda: autocorrelation.acf(series))
    lb = run.add("ljung_box", lambda: autocorrelation.ljung_box(series))
    st = run.add("stationarity", lambda: write_table(stationarity.stationarity(series)))
    arch = run.add("arch_lm", lambda: autocorrelation.arch_lm(series))
    sb = run.add("structural_breaks", lambda: write_table(breaks.break_tests(series)))
    if sb is not None:
        run.add("detected_breaks", lambda: breaks.detected_breaks(sb))
    rules = [(frequencies, lambda t: fd.frequency_findings(t, keys)), (strength, lambda t: fd.seasonal_findings(t, names)),
             (lb, lambda t: fd.ljung_box_findings(t, names)), (st, lambda t: fd.stationarity_findings(t, names)),
             (arch, lambda t: fd.arch_findings(t, names)), (sb, lambda t: fd.break_findings(t, names))]
    if st is not None and sb is not None:
        rules.append((st, lambda t: fd.executive_alerts(t, sb, names, numeric[0])))
    _union_findings(run, rules)


def _panel(run: Run, df: DataFrame, cfg: ValidationConfig, date: str, entity: str, numeric: list[str]) -> None:
    rows = df.where(q(entity).isNotNull())
    run.add("panel_ranges", lambda: panel.panel_ranges(rows, entity, date))
    bal = run.add("panel_balance", lambda: panel.balance(df, entity, date))
    run.add("panel_variance", lambda: panel.variance_decomposition(df, entity, numeric))
    freq = run.add("panel_frequency", lambda: write_table(panel.panel_frequency(rows, entity, date)))
    if freq is not None:
        run.add("panel_consistency", lambda: panel.panel_consistency(freq))
    if numeric:
        run.add("panel_average", lambda: panel.panel_average(rows, date, numeric[0]))
        run.add("snapshot", lambda: panel.snapshot(rows, entity, date, numeric[0]))
    run.add("top_entities", lambda: panel.top_entities(rows, entity))
    if bal is not None:
        run.add("findings_balance", lambda: fd.balance_findings(bal))
    _time_series(run, rows, cfg, date, numeric, [entity])
