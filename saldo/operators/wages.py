"""Wage-cost report by department and by institution, with shares and mean yearly growth.

Shape of the plan: one scan of the ledger is reduced to detail cells, the cells to one row per
(group, year), and every figure of the report is read off those few rows. No part of the report
joins or shuffles ledger rows, and a group that holds most of the ledger is summed inside each
task before the first shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from saldo.functions.numbers import format_number, format_percent, share_percent, to_month
from saldo.functions.numbers import measure as amount_of
from saldo.operators.filters import apply_filters, differs, exclude_values, year_value
from saldo.operators.joins import full_years, only_full_years
from saldo.settings import LedgerProfile


#: Rows that a row stands for, in tables of partial sums.
ROWS = "_rows"


def row_count(df: DataFrame) -> Column:
    """Number of ledger rows, for a ledger as well as for its partial sums."""
    return F.sum(ROWS) if ROWS in df.columns else F.count(F.lit(1))


def in_departments(df: DataFrame, profile: LedgerProfile) -> DataFrame:
    """Rows with a department that the report does not exclude."""
    return exclude_values(df, profile.department, profile.excluded)


def in_department(df: DataFrame, profile: LedgerProfile, department: str) -> DataFrame:
    """Rows of one department that name an institution."""
    rows = apply_filters(df, filters={profile.department: department})
    return rows.filter(F.col(profile.institution).isNotNull())


def wage_amount(df: DataFrame, profile: LedgerProfile) -> Column:
    amount = amount_of(df, profile.measure, profile.scale, profile.precision)
    return F.when(F.col(profile.account_group) == profile.wage_group, amount).otherwise(F.lit(0))


def other_amount(df: DataFrame, profile: LedgerProfile) -> Column:
    amount = amount_of(df, profile.measure, profile.scale, profile.precision)
    return F.when(differs(profile.account_group, profile.wage_group), amount).otherwise(F.lit(0))


def wage_totals(df: DataFrame, profile: LedgerProfile, by: str, year: int | str | None = None) -> DataFrame:
    """Wage sum and number of rows (all rows, not only wages) per group."""
    rows = apply_filters(df, year_value(year))
    return rows.groupBy(by).agg(
        F.sum(wage_amount(df, profile)).cast("double").alias("actual_sum"),
        row_count(df).alias("row_count"),
    )


def wage_yearly(df: DataFrame, source: DataFrame, profile: LedgerProfile, by: str) -> DataFrame:
    """Wage sum per (group, year) in the full years of ``source``."""
    sums = (
        df.filter(F.col("year").isNotNull())
        .groupBy(by, "year")
        .agg(F.sum(wage_amount(df, profile)).cast("double").alias("wage_sum"))
    )
    return only_full_years(sums, source, profile.month)


def yoy_pct(df: DataFrame, by: Sequence[str], value: str, name: str = "yoy_pct") -> DataFrame:
    """Growth over the previous row of the group, in percent of its signed value.

    NULL without a previous value or when that value is 0. Expects one row per (group, year).
    """
    previous = F.lag(value).over(Window.partitionBy(*by).orderBy("year"))
    growth = df.withColumn("_previous", previous).withColumn(
        name,
        F.when(F.col("_previous") != 0, (F.col(value).cast("double") / F.col("_previous").cast("double") - 1) * 100.0),
    )
    return growth.drop("_previous")


def avg_yoy(df: DataFrame, by: str, value: str = "wage_sum") -> DataFrame:
    """Mean growth per group; groups without any growth figure are absent."""
    growth = yoy_pct(df, [by], value).filter(F.col("yoy_pct").isNotNull())
    return growth.groupBy(by).agg(F.avg("yoy_pct").alias("avg_increase_pct"))


def avg_yoy_scope(df: DataFrame, source: DataFrame, profile: LedgerProfile) -> DataFrame:
    """Mean growth of all rows taken together, as one row; NULL when there is no growth figure.

    The window sees one row per year, as the rows are summed before it.
    """
    yearly = wage_yearly(df.withColumn("_scope", F.lit("all")), source, profile, "_scope")
    return yoy_pct(yearly, ["_scope"], "wage_sum").agg(F.avg("yoy_pct").alias("avg_increase_pct"))


def cost_basis(df: DataFrame, profile: LedgerProfile, keys: Sequence[str], detail: Sequence[str]) -> DataFrame:
    """Net wages and net other costs per detail cell; NULL detail keys count as empty text."""
    cells = {f"k_{c}": F.coalesce(F.col(c), F.lit("")) for c in detail if c in df.columns}
    return df.groupBy(*keys, *[v.alias(k) for k, v in cells.items()]).agg(
        F.sum(wage_amount(df, profile)).alias("wage_net"),
        F.sum(other_amount(df, profile)).alias("other_net"),
        row_count(df).alias("row_count"),
    )


def _clamped(net: str) -> Column:
    return F.sum(F.greatest(F.col(net), F.lit(0)))


def cost_totals(basis: DataFrame, by: Sequence[str]) -> DataFrame:
    """Cells clamped at zero, then summed."""
    return basis.groupBy(*by).agg(
        _clamped("wage_net").cast("double").alias("wage_cost_sum"),
        _clamped("other_net").cast("double").alias("other_sum"),
    )


def _by_group_and_year(
    rows: DataFrame, profile: LedgerProfile, by: str, detail: Sequence[str], scope: Column | None = None
) -> DataFrame:
    """Net and clamped costs per (group, year) of the rows in scope, and the greatest month of each.

    Rows out of scope become one cell a year, which tells their months; ``_inside`` is false there.
    """
    inside = F.lit(True) if scope is None else F.coalesce(scope, F.lit(False))
    cells = {f"k_{c}": F.when(inside, F.coalesce(F.col(c), F.lit(""))) for c in detail if c in rows.columns}
    month = F.max(to_month(F.col(profile.month))) if profile.month in rows.columns else F.lit(None).cast("int")
    basis = rows.groupBy(
        inside.alias("_inside"), F.when(inside, F.col(by)).alias("_group"), "year", *[v.alias(k) for k, v in cells.items()]
    ).agg(
        F.sum(wage_amount(rows, profile)).alias("wage_net"),
        F.sum(other_amount(rows, profile)).alias("other_net"),
        row_count(rows).alias("row_count"),
        month.alias("_month"),
    )
    return basis.groupBy("_inside", "_group", "year").agg(
        F.sum("wage_net").alias("wage_sum"),
        _clamped("wage_net").alias("wage_cost"),
        _clamped("other_net").alias("other_cost"),
        F.sum("row_count").alias("row_count"),
        F.max("_month").alias("_month"),
    )


def _report(
    df: DataFrame,
    scope: Column,
    months: DataFrame | None,
    profile: LedgerProfile,
    by: str,
    detail: Sequence[str],
    year: int | str | None,
) -> DataFrame:
    """Group rows and the total row, told apart by ``is_total``.

    The ledger is read once: the years that reach month 12 are read off the same few (group, year)
    rows, before those out of scope are dropped. ``months`` is a smaller frame to look them up in instead.
    """
    dated = F.col("year").isNotNull()
    if months is not None:
        yearly = _by_group_and_year(df.filter(scope), profile, by, detail)
        if profile.month in months.columns:
            marks = full_years(months, profile.month).withColumn("_full", F.lit(True))
            yearly = yearly.join(marks, "year", "left").withColumn("_full", F.coalesce("_full", F.lit(False)))
        else:
            yearly = yearly.withColumn("_full", dated)
    else:
        yearly = _by_group_and_year(df, profile, by, detail, scope)
        last = F.max("_month").over(Window.partitionBy("year"))
        full = dated & F.coalesce(last >= 12, F.lit(False)) if profile.month in df.columns else dated
        yearly = yearly.withColumn("_full", full).filter("_inside")

    # The total is a second grouping of the same few rows; its growth is that of the whole scope.
    sums = yearly.groupingSets([["_group", "year", "_full"], ["year", "_full"]], "_group", "year", "_full").agg(
        F.grouping("_group").alias("_total"),
        F.sum("wage_sum").alias("wage_sum"),
        F.sum("wage_cost").alias("wage_cost"),
        F.sum("other_cost").alias("other_cost"),
        F.sum("row_count").alias("row_count"),
    )
    growth = yoy_pct(sums, ["_total", "_group", "_full"], "wage_sum").withColumn(
        "yoy_pct", F.when(F.col("_full"), F.col("yoy_pct"))
    )

    wanted = year_value(year)
    counted = F.lit(True) if wanted is None else F.col("year").eqNullSafe(F.lit(wanted))
    dated = counted & F.col("year").isNotNull()
    report = growth.groupBy("_total", "_group").agg(
        F.sum(F.when(counted, F.col("wage_sum"))).cast("double").alias("actual_sum"),
        F.sum(F.when(dated, F.col("other_cost"))).cast("double").alias("other_sum"),
        F.sum(F.when(dated, F.col("wage_cost"))).cast("double").alias("wage_cost_sum"),
        F.sum(F.when(counted, F.col("row_count"))).alias("row_count"),
        F.avg("yoy_pct").alias("avg_increase_pct"),
    )
    return (
        report.filter((F.col("_total") == 1) | (F.col("row_count") > 0))
        .withColumn("wage_share_pct", share_percent(F.col("wage_cost_sum"), F.col("other_sum")))
        .withColumn("is_total", F.col("_total") == 1)
        .drop("_total")
    )


FIGURES = ("actual_sum", "other_sum", "wage_cost_sum", "row_count", "avg_increase_pct", "wage_share_pct")


def _groups(report: DataFrame, name: str) -> DataFrame:
    rows = report.filter(~F.col("is_total")).select(F.col("_group").alias(name), *FIGURES)
    return rows.orderBy(F.desc_nulls_last("actual_sum"), F.asc_nulls_last(name))


def _total(report: DataFrame) -> DataFrame:
    zero = {c: F.coalesce(F.col(c), F.lit(0)).cast(report.schema[c].dataType) for c in FIGURES[:4]}
    rows = report.filter("is_total").withColumns(zero)
    return rows.select(F.lit("Total").alias("label"), *FIGURES)


def _department(df: DataFrame, profile: LedgerProfile, year, months: DataFrame | None) -> DataFrame:
    detail = [profile.institution, *profile.detail]
    known = F.col(profile.department)
    scope = known.isNotNull() & ~known.isin(list(profile.excluded)) if profile.excluded else known.isNotNull()
    return _report(df, scope, months, profile, profile.department, detail, year)


def _institution(df: DataFrame, profile: LedgerProfile, department: str, year, months: DataFrame | None) -> DataFrame:
    scope = (F.col(profile.department) == department) & F.col(profile.institution).isNotNull()
    return _report(df, scope, months, profile, profile.institution, profile.detail, year)


def department_report(
    df: DataFrame, profile: LedgerProfile, year: int | str | None = None, months: DataFrame | None = None
) -> DataFrame:
    """Wages, other costs, wage share, rows and mean growth per department, largest wages first.

    The growth figure covers all full years whatever ``year`` says. ``months`` names the frame in
    which to look for full years; by default it is the ledger itself.
    """
    return _groups(_department(df, profile, year, months), "department")


def department_total(
    df: DataFrame, profile: LedgerProfile, year: int | str | None = None, months: DataFrame | None = None
) -> DataFrame:
    """The total row. Its share comes from the summed parts and its growth from the whole scope."""
    return _total(_department(df, profile, year, months))


def institution_report(
    df: DataFrame,
    profile: LedgerProfile,
    department: str,
    year: int | str | None = None,
    months: DataFrame | None = None,
) -> DataFrame:
    """The same report for the institutions inside one department."""
    return _groups(_institution(df, profile, department, year, months), "institution")


def institution_total(
    df: DataFrame,
    profile: LedgerProfile,
    department: str,
    year: int | str | None = None,
    months: DataFrame | None = None,
) -> DataFrame:
    return _total(_institution(df, profile, department, year, months))


def institution_expansion(
    df: DataFrame, profile: LedgerProfile, department: str, year: int | str | None = None
) -> DataFrame:
    """Institutions of one department without the growth figure; the year prunes the scan."""
    rows = apply_filters(in_department(df, profile, department), year_value(year))
    yearly = _by_group_and_year(rows, profile, profile.institution, profile.detail)
    dated = F.col("year").isNotNull()
    out = yearly.groupBy(F.col("_group").alias("institution")).agg(
        F.sum("wage_sum").cast("double").alias("actual_sum"),
        F.sum("row_count").alias("row_count"),
        F.sum(F.when(dated, F.col("wage_cost"))).cast("double").alias("wage_cost_sum"),
        F.sum(F.when(dated, F.col("other_cost"))).cast("double").alias("other_sum"),
    )
    shared = out.withColumn("wage_share_pct", share_percent(F.col("wage_cost_sum"), F.col("other_sum")))
    return shared.orderBy(F.desc_nulls_last("actual_sum"), F.asc_nulls_last("institution"))


def share_trend(
    df: DataFrame, profile: LedgerProfile, department: str, institution: str | None = None
) -> DataFrame:
    """Wage share per year of a department, or of one institution in it.

    Its cells do not hold the institution, so a department is netted across institutions here and
    the figures may differ from the report. A sum that is not positive gives NULL.
    """
    scope = {profile.department: department}
    if institution is not None:
        scope[profile.institution] = institution
    rows = apply_filters(df, filters=scope).filter(F.col("year").isNotNull())
    sums = cost_totals(cost_basis(rows, profile, ["year"], profile.detail), ["year"])
    total = F.col("wage_cost_sum") + F.col("other_sum")
    share = F.when(total > 0, F.col("wage_cost_sum") / total * 100.0)
    return sums.select("year", share.alias("wage_share_pct")).orderBy("year")


def wage_scope_yearly(
    df: DataFrame, profile: LedgerProfile, department: str | None = None, institution: str | None = None
) -> DataFrame:
    """Wages per year over the report scope, or one department or institution of it."""
    scope = {profile.account_group: profile.wage_group}
    if department:
        scope[profile.department] = department
    if institution:
        scope[profile.institution] = institution
    rows = apply_filters(in_departments(df, profile), filters=scope).filter(F.col("year").isNotNull())
    total = F.sum(amount_of(df, profile.measure, profile.scale, profile.precision)).cast("double").alias("actual_sum")
    return rows.groupBy("year").agg(total).orderBy("year")


def with_report_display(report: DataFrame) -> DataFrame:
    """Amounts and percentages of a report as shown."""
    return report.withColumns(
        {
            "actual_sum_fmt": format_number(F.col("actual_sum")),
            "other_sum_fmt": format_number(F.col("other_sum")),
            "avg_increase_fmt": format_percent(F.col("avg_increase_pct")),
            "wage_share_pct_fmt": format_percent(F.col("wage_share_pct")),
        }
    )
