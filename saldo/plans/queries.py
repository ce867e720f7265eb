"""Registered queries: every operator over the whole star tables."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from saldo.functions import numbers
from saldo.functions.periods import file_month, file_year
from saldo.operators import anomalies, drill, entities, explore, filters, harvest, joins, ordering, price_index, selection, wages
from saldo.plans.star import STAR_PROFILE as PROFILE
from saldo.plans.star import star_ledger, table
from saldo.settings import SERIES_KEYS, AnomalyConfig, LedgerProfile
from saldo.sources import csv_folder, results
from saldo.sources import ledger as ledger_store
from saldo.sources.scratch import open_files, remove_folders, scratch_dir, stored
from saldo.sources.stored_ledger import StoredLedger
from saldo.streaming import landing

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

SERIES = ["samtala0", "samtala2"]
THRESHOLDS = AnomalyConfig(min_prior_real_abs=20_000, min_abs_real_change=50_000)
FILTERS = {"tegund0": "STANDARD", "samtala1": "ASIA"}
DEPARTMENT = "BUILDING"
INSTITUTION = "NATION_7"
ANY_LINK = 'href="([^"]+)"'
NO_RESULT, DETAIL_PART, DETAIL_SHIFT = "para", "/de", 125


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def ledger(spark: SparkSession, sf_dir: str, columns: Iterable[str], text: bool = False) -> DataFrame:
    """The star ledger with the asked columns, and the department columns when asked for."""
    names = list(dict.fromkeys(columns))
    plain = [c for c in names if not c.startswith("samtala2")]
    if len(plain) == len(names):
        return star_ledger(spark, sf_dir, plain, text)
    return filters.with_departments(star_ledger(spark, sf_dir, [*plain, "samtala2"], text), PROFILE)


def months(spark: SparkSession, sf_dir: str) -> DataFrame:
    return star_ledger(spark, sf_dir, ["year", "period_month"])


def money(name: str) -> Column:
    return F.round(name, 2).alias(name)


def ratio(name: str) -> Column:
    return F.round(name, 6).alias(name)


# --- Explorer ---------------------------------------------------------------------------


@query
def summary_by_category(spark, sf_dir):
    """Sum of text amounts per department."""
    return explore.summary_by(ledger(spark, sf_dir, ["samtala2_canonical", "raun"], text=True), "samtala2_canonical")


@query
def summary_filtered(spark, sf_dir):
    rows = ledger(spark, sf_dir, ["year", "samtala0", "tegund0", "samtala1", "raun"])
    return explore.summary_by(rows, "samtala0", filters=FILTERS, year=1999)


@query
def totals_signed(spark, sf_dir):
    return explore.totals(ledger(spark, sf_dir, ["raun"]))


@query
def totals_filtered(spark, sf_dir):
    rows = ledger(spark, sf_dir, ["year", "tegund0", "samtala1", "raun"])
    return explore.totals(rows, filters=FILTERS, year="1999")


@query
def value_counts(spark, sf_dir):
    return explore.value_counts(ledger(spark, sf_dir, ["vm_nafn"]), "vm_nafn")


@query
def count_rows(spark, sf_dir):
    return explore.count_rows(ledger(spark, sf_dir, ["year", "tegund0", "samtala1"]), FILTERS, 1999)


@query
def category_profile(spark, sf_dir):
    return explore.category_profile(ledger(spark, sf_dir, PROFILE.category_columns), PROFILE.category_columns)


@query
def facet_options(spark, sf_dir):
    rows = ledger(spark, sf_dir, ["year", *PROFILE.filter_columns])
    return explore.facet_options(rows, PROFILE.filter_columns, FILTERS, 1999)


@query
def facet_options_open(spark, sf_dir):
    rows = ledger(spark, sf_dir, PROFILE.filter_columns)
    return explore.facet_options(rows, PROFILE.filter_columns)


@query
def distinct_years(spark, sf_dir):
    return ordering.distinct_years(ledger(spark, sf_dir, ["year"]))


@query
def preview_page(spark, sf_dir):
    rows = ledger(spark, sf_dir, PROFILE.scope_columns)
    shown = ["year", "samtala0", "samtala3", "tegund0", "tegund1", "vm_numer", "raun"]
    out = explore.preview(rows, shown, FILTERS | {"samtala2_canonical": "HOME"}, limit=900, order=[F.desc("raun")])
    return out.withColumn("raun", F.col("raun").cast("double"))


@query
def number_parse(spark, sf_dir):
    """Amounts in several spellings, most of them usable and some not."""
    rows = star_ledger(spark, sf_dir, ["raun"], text_amounts=True)
    source = rows.select("raun", (F.length("raun") % 4).alias("form"), (F.ascii(F.right("raun", F.lit(1))) % 7).alias("n"))
    text = (
        F.when(F.col("n") == 0, F.concat(F.lit(" "), F.col("raun"), F.lit(" ")))
        .when(F.col("n") == 1, F.concat(F.lit("+"), F.ltrim(F.col("raun"), F.lit("-"))))
        .when(F.col("n") == 2, F.concat(F.col("raun"), F.lit("x")))
        .when(F.col("n") == 3, F.lit(""))
        .when(F.col("n") == 4, F.regexp_replace("raun", ",.*$", ","))
        .otherwise(F.col("raun"))
    )
    parsed = source.select("form", "n", numbers.parse_number(text).alias("amount"))
    return parsed.groupBy("form", "n").agg(
        F.count(F.lit(1)).alias("rows"), F.count("amount").alias("usable"), F.sum("amount").cast("double").alias("total")
    )


@query
def wide_amounts(spark, sf_dir):
    """Ledger amounts times a million millions, with four decimals, summed exactly."""
    rows = star_ledger(spark, sf_dir, ["year", "raun"])
    whole = (F.col("raun") * F.lit(10**12).cast("decimal(13,0)")).cast("decimal(28,0)").cast("string")
    text = F.concat(whole, F.lit(",1234"))
    amounts = rows.select("year", numbers.parse_number(text, scale=4).alias("amount"))
    return amounts.groupBy("year").agg(F.count("amount").alias("usable"), F.sum("amount").cast("string").alias("total"))


@query
def department_modes(spark, sf_dir):
    columns = ["samtala2", "samtala2_raw", "samtala2_canonical", "samtala2_family"]
    return ledger(spark, sf_dir, columns).groupBy(*columns).agg(F.count(F.lit(1)).alias("rows"))


@query
def department_dimension(spark, sf_dir):
    """The department column of each mode; an unknown mode means canonical."""
    rows = ledger(spark, sf_dir, ["samtala2_raw"])
    modes = ["raw", "canonical", "family", "other"]
    pairs = [F.struct(F.lit(m).alias("mode"), F.col(LedgerProfile(department_mode=m).department).alias("department")) for m in modes]
    long = rows.select(F.inline(F.array(*pairs)))
    return long.groupBy("mode", "department").agg(F.count(F.lit(1)).alias("rows"))


@query
def file_periods(spark, sf_dir):
    """Year and month from file names, good and bad ones."""
    orders = table(spark, sf_dir, "orders")
    year = F.year("o_orderdate") + 20
    stamp = F.format_string("%d%02d", year, (F.col("o_orderkey") % 15).cast("int"))
    kind = F.col("o_orderkey") % 3
    name = (
        F.when(kind == 0, F.concat(F.lit("accounts_"), stamp, F.lit(".csv")))
        .when(kind == 1, F.concat(F.lit("accounts-"), year, F.lit("-final.csv")))
        .otherwise(F.concat(F.lit("b1999_"), stamp, F.lit("_x.csv")))
    )
    rows = orders.select(name.alias("filename"))
    dated = rows.select(file_year(F.col("filename")).alias("year"), file_month(F.col("filename")).alias("period_month"))
    return dated.groupBy("year", "period_month").agg(F.count(F.lit(1)).alias("files"))


# --- Drill-down -------------------------------------------------------------------------

SCOPE = {"tegund0": "STANDARD"}


@query
def yearly_scope(spark, sf_dir):
    return drill.yearly_sum(ledger(spark, sf_dir, ["year", "tegund0", "raun"]), SCOPE)


@query
def child_breakdown(spark, sf_dir):
    rows = ledger(spark, sf_dir, ["year", "tegund0", "samtala0", "raun"])
    return drill.breakdown(rows, SCOPE, "samtala0", 1999)


@query
def parent_options(spark, sf_dir):
    return ordering.distinct_values(ledger(spark, sf_dir, ["vm_nafn"]), "vm_nafn", 1500)


def _amount_as_double(df: DataFrame) -> DataFrame:
    return df.withColumn("raun", F.col("raun").cast("double"))


@query
def record_page(spark, sf_dir):
    """A page number beyond the end gives the last page."""
    rows = ledger(spark, sf_dir, PROFILE.scope_columns)
    return _amount_as_double(drill.records(rows, SCOPE, PROFILE.scope_columns, 1999, number=10**9, size=100).rows)


@query
def middle_page(spark, sf_dir):
    """A page deep inside the whole ledger."""
    rows = ledger(spark, sf_dir, PROFILE.scope_columns)
    return _amount_as_double(drill.records(rows, {}, PROFILE.scope_columns, number=100, size=100).rows)


@query
def indexed_pages(spark, sf_dir):
    """The first, a middle and the last page of the whole ledger, sorted once."""
    pager = drill.record_pager(ledger(spark, sf_dir, PROFILE.scope_columns), {}, PROFILE.scope_columns)
    pages = [pager.page(["-year"], number, 50) for number in (1, 123, 10**9)]
    frames = [_amount_as_double(p.rows).withColumns({"page": F.lit(p.number), "pages": F.lit(p.pages)}) for p in pages]
    return csv_folder.union_by_name(frames)


@query
def scope_export(spark, sf_dir):
    rows = ledger(spark, sf_dir, PROFILE.scope_columns)
    return _amount_as_double(drill.export_scope(rows, SCOPE | {"samtala0": INSTITUTION}, PROFILE.scope_columns))


def read_back(spark: SparkSession, path: str, schema: str, order: Sequence[Column]) -> DataFrame:
    """A sorted CSV result as it lies in its files, and whether each file's rows and the files themselves are in order."""
    place = [F.col("_metadata.file_name").alias("file"), F.monotonically_increasing_id().alias("n")]
    rows = spark.read.schema(schema).option("header", True).option("escape", '"').csv(path).select("*", *place)
    # Sort keys as one text cannot be compared, so places by order are compared with places in the files.
    by_order, by_place = Window.partitionBy("file").orderBy(*order, "n"), Window.partitionBy("file").orderBy("n")
    ranked = rows.withColumn("in_file", F.row_number().over(by_order) == F.row_number().over(by_place))
    ends = ranked.groupBy("file").agg(F.bool_and("in_file").alias("in_order"))
    return rows.join(ends, "file").drop("file", "n")


@query
def scope_export_file(spark, sf_dir):
    """The scope export written as CSV and read back."""
    rows = ledger(spark, sf_dir, PROFILE.scope_columns)
    path = scratch_dir(spark, "scope") + "/csv"
    results.write_csv(drill.export_scope(rows, SCOPE | {"samtala0": INSTITUTION}, PROFILE.scope_columns), path)
    schema = ", ".join(f"{c} {'int' if c == 'year' else 'decimal(18,2)' if c == PROFILE.measure else 'string'}" for c in PROFILE.scope_columns)
    return _amount_as_double(read_back(spark, path, schema, [F.desc_nulls_last("year")]))


@query
def scope_rows(spark, sf_dir):
    rows = ledger(spark, sf_dir, PROFILE.scope_columns)
    return _amount_as_double(drill.scope_rows(rows, {PROFILE.department: DEPARTMENT}, PROFILE.scope_columns, 1998))


@query
def pair_exists(spark, sf_dir):
    """The institution's rows in a department where the pair exists, else none."""
    rows = ledger(spark, sf_dir, ["samtala2_canonical", "samtala0"])
    pair = {"samtala2_canonical": DEPARTMENT, "samtala0": INSTITUTION}
    found = filters.pair_exists(rows, pair)
    return filters.apply_filters(rows, filters=pair).agg(F.lit(found).alias("found"), F.count(F.lit(1)).alias("rows"))


# --- Price index ------------------------------------------------------------------------


def index_reply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index reply whose monthly values follow the mean order total, with a decimal comma.

    Computed in whole cents, so the text is the same wherever it is computed.
    """
    orders = table(spark, sf_dir, "orders")
    cents = F.sum((F.col("o_totalprice").cast("decimal(18,2)") * 100).cast("bigint"))
    level = F.expr("total div (n * 1000)")
    monthly = (
        orders.groupBy(F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month"))
        .agg(cents.alias("total"), F.count(F.lit(1)).alias("n"))
        .select(price_index.month_key(F.col("year"), F.col("month")).alias("key"), level.alias("level"))
    )
    text = F.format_string("%d,%02d", F.expr("level div 100"), F.col("level") % 100)
    # One entry per calendar month, so the reply is a short list however many orders there are.
    item = F.struct(F.array("key", F.lit("CPI")).alias("key"), F.array(text).alias("values"))
    return monthly.agg(F.to_json(F.struct(F.array_sort(F.collect_list(item)).alias("data"))).alias("body"))


def index_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    return price_index.parse_index_json(index_reply(spark, sf_dir))


def index_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    return price_index.annual_index(index_months(spark, sf_dir))


@query
def index_monthly(spark, sf_dir):
    return index_months(spark, sf_dir)


@query
def index_annual(spark, sf_dir):
    return index_years(spark, sf_dir).select(
        "year", ratio("cpi_avg"), ratio("cpi_latest_base"), ratio("deflator_to_latest")
    )


@query
def year_range(spark, sf_dir):
    return price_index.year_range(ledger(spark, sf_dir, ["year"]))


@query
def month_keys(spark, sf_dir):
    """Every month from the first to the last ledger year."""
    return price_index.requested_months(ledger(spark, sf_dir, ["year"]), as_of_year=2003).select("month_key", "year", "month")


@query
def month_selection(spark, sf_dir):
    """Index months that the ledger years ask for, in the order the index has them."""
    available = index_months(spark, sf_dir).select("month_key", (F.col("year") * 12 + F.col("month")).alias("position"))
    requested = price_index.requested_months(ledger(spark, sf_dir, ["year"]), as_of_year=1999)
    return joins.select_known(available, requested, "month_key").orderBy("position")


# --- Anomalies --------------------------------------------------------------------------


def series_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return star_ledger(spark, sf_dir, ["year", *SERIES, "raun"])


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = anomalies.detect_anomalies(series_rows(spark, sf_dir), index_years(spark, sf_dir), SERIES, THRESHOLDS)
    return filters.with_departments(rows, PROFILE)


def flagged_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).filter("is_anomaly")


BROWSE = ["samtala0", "samtala2_canonical"]


@query
def annual_actuals(spark, sf_dir):
    rows = star_ledger(spark, sf_dir, ["year", "samtala0", "samtala3", "tegund2", "vm_nafn", "raun"])
    return anomalies.annual_actuals(rows, ["samtala0", "samtala3", "tegund2", "vm_nafn"])


@query
def annual_real(spark, sf_dir):
    """Annual sums in prices of the latest year."""
    annual = anomalies.annual_actuals(series_rows(spark, sf_dir), SERIES)
    real = anomalies.real_series(annual, index_years(spark, sf_dir))
    return real.select("year", *SERIES, money("actual_nominal"), ratio("deflator_to_latest"), money("actual_real"))


@query
def yoy_real(spark, sf_dir):
    annual = anomalies.annual_actuals(series_rows(spark, sf_dir), SERIES)
    real = anomalies.real_series(annual, index_years(spark, sf_dir))
    changed = anomalies.with_real_change(anomalies.with_prior(real, SERIES))
    return changed.select("year", *SERIES, money("prior_real"), money("yoy_real_change"), ratio("yoy_real_pct"))


@query
def modified_zscore(spark, sf_dir):
    """Robust z-score of nominal yearly sums per institution."""
    annual = anomalies.annual_actuals(star_ledger(spark, sf_dir, ["year", "samtala0", "raun"]), ["samtala0"])
    out = anomalies.modified_zscore(annual, ["samtala0"], "actual_nominal", "z")
    return out.select("year", "samtala0", ratio("z"))


@query
def robust_stats(spark, sf_dir):
    """Median and median absolute deviation of all amounts by account group and institution, series above 300 rows narrowed down."""
    rows = star_ledger(spark, sf_dir, ["tegund0", "samtala0", "samtala3", "raun"])
    wide = selection.robust_stats(rows, ["tegund0", "samtala3"], "raun", long=300)
    small = selection.robust_stats(rows, ["tegund0", "samtala0"], "raun", long=300)
    frames = [f.select("tegund0", F.col(k).alias("second"), *[F.round(c, 4).alias(c) for c in ("median", "mad")]) for f, k in ((wide, "samtala3"), (small, "samtala0"))]
    return csv_folder.union_by_name(frames)


@query
def anomalies_all(spark, sf_dir):
    return scored(spark, sf_dir).select(
        "year", *SERIES, "samtala2_canonical", money("actual_real"), money("prior_real"), money("yoy_real_change"),
        ratio("yoy_real_pct"), "series_year_count", ratio("mz_yoy_pct"), "direction", ratio("abs_pct"),
        ratio("abs_mz"), money("abs_change_real"), "is_anomaly", ratio("anomaly_score"),
    )


@query
def anomalies_flagged(spark, sf_dir):
    hits = anomalies.rank_anomalies(flagged_rows(spark, sf_dir))
    return hits.select("year", *SERIES, "direction", money("abs_change_real"), ratio("anomaly_score"))


@query
def anomaly_summary(spark, sf_dir):
    return anomalies.anomaly_summary(scored(spark, sf_dir), index_years(spark, sf_dir), THRESHOLDS)


@query
def anomaly_yearly(spark, sf_dir):
    chart = anomalies.anomaly_yearly(flagged_rows(spark, sf_dir), "samtala2_canonical", "HOME")
    return chart.select(
        "year", "anomalies_count", money("abs_change_sum"), money("abs_change_increase"), money("abs_change_decrease")
    )


@query
def series_totals(spark, sf_dir):
    """Real sum per year of the series that were flagged, by displayed department."""
    rows = scored(spark, sf_dir)
    keys = ordering.distinct_keys(rows.filter("is_anomaly"), BROWSE)
    return anomalies.series_totals(rows, keys, BROWSE).select("year", *BROWSE, money("actual_real_sum"))


@query
def anomaly_page(spark, sf_dir):
    """The second page of flagged rows, as shown, with the year list of each series.

    Pages are browsed off a stored table, so the ledger is read once and not once per step.
    """
    rows = stored(scored(spark, sf_dir), "scored")
    hits = filters.filter_anomalies(rows.filter("is_anomaly"), BROWSE)
    page = anomalies.anomaly_page(hits, BROWSE, number=2, size=25)
    shown = anomalies.with_display(anomalies.attach_series_totals(page, rows, BROWSE))
    years = F.array_join(F.transform("year_totals", lambda t: F.concat_ws(":", t["year"], t["actual_real_fmt"])), " ")
    return shown.select(
        "year", *BROWSE, "direction", "anomaly_score_fmt", "yoy_real_pct_fmt", "yoy_real_change_fmt",
        "actual_real_fmt", "prior_real_fmt", years.alias("year_totals"),
    )


@query
def anomaly_export(spark, sf_dir):
    out = anomalies.export_anomalies(
        flagged_rows(spark, sf_dir), BROWSE, direction="increase", parent="samtala2_canonical", value="HOME"
    )
    return out.select("year", *SERIES, "direction", money("actual_real"), ratio("anomaly_score"))


@query
def anomaly_files(spark, sf_dir):
    """Row counts of the result files after one run."""
    folder = scratch_dir(spark, "results")
    results.write_anomalies(
        scored(spark, sf_dir), index_months(spark, sf_dir), index_years(spark, sf_dir), folder, THRESHOLDS
    )
    tables = {name: spark.read.parquet(f"{folder}/{name}") for name in ("anomalies_yoy_all", "anomalies_flagged")}
    for name in ("anomalies_yoy_all_csv", "anomalies_flagged_csv", "index_monthly_csv", "index_annual_csv"):
        tables[name] = spark.read.option("header", True).csv(f"{folder}/{name}")
    counts = [t.agg(F.lit(name).alias("file"), F.count(F.lit(1)).alias("rows")) for name, t in tables.items()]
    return csv_folder.union_by_name(counts)


@query
def anomalies_ten_keys(spark, sf_dir):
    """The scored table at the default grain of ten keys."""
    rows = star_ledger(spark, sf_dir, ["year", *SERIES_KEYS, "raun"])
    out = anomalies.detect_anomalies(rows, index_years(spark, sf_dir), SERIES_KEYS, THRESHOLDS)
    return out.select(
        "year", *SERIES_KEYS, money("actual_real"), money("prior_real"), "series_year_count", "direction", "is_anomaly",
        F.round("anomaly_score", 4).alias("anomaly_score"),
    )


PARENT_VALUES = {
    "samtala0": "NATION_7", "samtala1": "ASIA", "samtala2_canonical": "HOME", "samtala3": "O", "tegund0": "STANDARD", "tegund1": "F",
    "tegund2": "(missing)", "tegund3": "(missing)", "vm_nafn": "NATION_3", "vm_numer": "VSK-000005", "unknown": "STANDARD",
}


@query
def anomaly_browse(spark, sf_dir):
    """Number and size of increases under a value of each of the ten parents, and of a parent that does not exist."""
    rows = star_ledger(spark, sf_dir, ["year", *SERIES_KEYS, "raun"])
    out = anomalies.detect_anomalies(rows, index_years(spark, sf_dir), SERIES_KEYS, THRESHOLDS)
    table = stored(filters.with_departments(out, PROFILE), "ten-keys")
    frames = []
    for parent, value in PARENT_VALUES.items():
        hits = filters.filter_anomalies(table, PROFILE.anomaly_parents, direction="increase", parent=parent, value=value)
        size = F.round(F.coalesce(F.sum("abs_change_real"), F.lit(0.0)), 0)
        frames.append(hits.agg(F.lit(parent).alias("parent"), F.count(F.lit(1)).alias("rows"), size.alias("size")))
    return csv_folder.union_by_name(frames)


@query
def anomaly_export_file(spark, sf_dir):
    """The anomaly export written as CSV and read back."""
    path = scratch_dir(spark, "anomalies") + "/csv"
    out = anomalies.export_anomalies(flagged_rows(spark, sf_dir), BROWSE)
    wanted = ["year", *SERIES, "direction", "actual_real", "anomaly_score", "abs_change_real"]
    results.write_csv(out.select(*wanted), path)
    schema = "year int, samtala0 string, samtala2 string, direction string, actual_real double, anomaly_score double, abs_change_real double"
    back = read_back(spark, path, schema, [F.desc_nulls_last("anomaly_score"), F.desc_nulls_last("abs_change_real")])
    return back.select("year", *SERIES, "direction", money("actual_real"), ratio("anomaly_score"), "in_order")


@query
def anomaly_file_contents(spark, sf_dir):
    """What the result files hold, read back."""
    folder = scratch_dir(spark, "results")
    scores, monthly, annual = scored(spark, sf_dir), index_months(spark, sf_dir), index_years(spark, sf_dir)
    results.write_anomalies(scores, monthly, annual, folder, THRESHOLDS)

    def csv(name: str, schema: str) -> DataFrame:
        return spark.read.schema(schema).option("header", True).option("escape", '"').csv(f"{folder}/{name}")

    def shaped(rows: DataFrame, name: str, year: str, first, second, figure: str, score: str | None, flag) -> DataFrame:
        score = F.lit(None).cast("double").alias("score") if score is None else F.round(F.col(score).cast("double"), 6).alias("score")
        texts = [F.lit(None).cast("string") if c is None else F.col(c) for c in (first, second)]
        digits = 2 if figure == "actual_real" else 6
        return rows.select(
            F.lit(name).alias("file"), F.col(year).cast("int").alias("year"), texts[0].alias("samtala0"), texts[1].alias("samtala2"),
            F.round(F.col(figure).cast("double"), digits).alias("figure"), score,
            (F.lit(None).cast("boolean") if flag is None else F.col(flag)).alias("is_anomaly"),
        )

    frames = []
    for name in ("anomalies_yoy_all", "anomalies_flagged"):
        kept = spark.read.parquet(f"{folder}/{name}")
        ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
        for rows, label in ((kept, name), (csv(f"{name}_csv", ddl), f"{name}_csv")):
            frames.append(shaped(rows, label, "year", "samtala0", "samtala2", "actual_real", "anomaly_score", "is_anomaly"))
    months_schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in monthly.schema.fields)
    years_schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in annual.schema.fields)
    frames.append(shaped(csv("index_monthly_csv", months_schema), "index_monthly_csv", "year", "month_key", None, "cpi", None, None))
    frames.append(shaped(csv("index_annual_csv", years_schema), "index_annual_csv", "year", None, None, "cpi_avg", "deflator_to_latest", None))
    summary = spark.read.json(f"{folder}/anomalies_summary")
    frames.append(shaped(summary, "anomalies_summary", "year_to", None, None, "rows_total", "rows_flagged", None))
    return csv_folder.union_by_name(frames)


@query
def stored_views(spark, sf_dir):
    """Named views over the ledger and both anomaly tables; the flagged one stands in for a full one that was not kept."""
    folder = scratch_dir(spark, "views")
    ledger_store.write_ledger(ledger_store.prepare_ledger(star_ledger(spark, sf_dir, ["year", "samtala2", "raun"]), PROFILE), f"{folder}/ledger")
    scores = stored(scored(spark, sf_dir).drop(*[c for c in ("samtala2_raw", "samtala2_canonical", "samtala2_family")]), "scores")
    scores.where("is_anomaly").write.parquet(f"{folder}/flagged")
    scores.write.parquet(f"{folder}/all")
    paths = {"ledger": f"{folder}/ledger", "anomalies": f"{folder}/flagged", "anomalies_all": f"{folder}/all"}
    ledger_store.register_views(spark, paths, PROFILE, {"anomalies_all": "anomalies"})

    def counted(view: str, label: str) -> DataFrame:
        return spark.sql(f"SELECT '{label}' AS view, samtala2_canonical, count(*) AS rows FROM {view} GROUP BY 2")

    frames = [counted(name, name) for name in paths]
    ledger_store.register_views(spark, {**paths, "anomalies_all": f"{folder}/none"}, PROFILE, {"anomalies_all": "anomalies"})
    return csv_folder.union_by_name([*frames, counted("anomalies_all", "anomalies_all, not kept")])


# --- Wage report ------------------------------------------------------------------------

REPORT_COLUMNS = ["year", "period_month", "samtala0", "samtala2_canonical", "tegund0", *PROFILE.detail, "raun"]


def report_figures(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(
        *keys, "actual_sum", "other_sum", "wage_cost_sum", "row_count", ratio("avg_increase_pct"), ratio("wage_share_pct")
    )


@query
def full_years(spark, sf_dir):
    return joins.full_years(months(spark, sf_dir))


@query
def wage_totals(spark, sf_dir):
    rows = ledger(spark, sf_dir, ["year", "samtala2_canonical", "tegund0", "raun"])
    return wages.wage_totals(wages.in_departments(rows, PROFILE), PROFILE, PROFILE.department, 1998)


@query
def wage_growth(spark, sf_dir):
    """Wages per department and full year with growth over the year before."""
    rows = ledger(spark, sf_dir, ["year", "samtala2_canonical", "tegund0", "raun"])
    yearly = wages.wage_yearly(wages.in_departments(rows, PROFILE), months(spark, sf_dir), PROFILE, PROFILE.department)
    out = wages.yoy_pct(yearly, [PROFILE.department], "wage_sum")
    return out.select(PROFILE.department, "year", "wage_sum", ratio("yoy_pct"))


@query
def wage_growth_mean(spark, sf_dir):
    rows = ledger(spark, sf_dir, ["year", "samtala0", "tegund0", "raun"])
    yearly = wages.wage_yearly(rows, months(spark, sf_dir), PROFILE, "samtala0")
    return wages.avg_yoy(yearly, "samtala0").select("samtala0", ratio("avg_increase_pct"))


@query
def wage_growth_scope(spark, sf_dir):
    rows = ledger(spark, sf_dir, ["year", "samtala2_canonical", "tegund0", "raun"])
    out = wages.avg_yoy_scope(wages.in_departments(rows, PROFILE), months(spark, sf_dir), PROFILE)
    return out.select(ratio("avg_increase_pct"))


@query
def cost_totals(spark, sf_dir):
    """Net costs per detail cell, clamped at zero and summed by department and year."""
    rows = wages.in_departments(ledger(spark, sf_dir, REPORT_COLUMNS), PROFILE).filter(F.col("year").isNotNull())
    basis = wages.cost_basis(rows, PROFILE, [PROFILE.department, "year"], [PROFILE.institution, *PROFILE.detail])
    return wages.cost_totals(basis, [PROFILE.department, "year"])


@query
def wage_department_report(spark, sf_dir):
    rows = ledger(spark, sf_dir, REPORT_COLUMNS)
    return report_figures(wages.department_report(rows, PROFILE), "department")


@query
def wage_department_report_year(spark, sf_dir):
    rows = ledger(spark, sf_dir, REPORT_COLUMNS)
    return report_figures(wages.department_report(rows, PROFILE, 1999), "department")


@query
def wage_total_row(spark, sf_dir):
    rows = ledger(spark, sf_dir, REPORT_COLUMNS)
    return report_figures(wages.department_total(rows, PROFILE), "label")


@query
def wage_institution_report(spark, sf_dir):
    rows = ledger(spark, sf_dir, REPORT_COLUMNS)
    report = wages.institution_report(rows, PROFILE, DEPARTMENT)
    return report_figures(report, "institution")


@query
def wage_institution_total_row(spark, sf_dir):
    rows = ledger(spark, sf_dir, REPORT_COLUMNS)
    return report_figures(wages.institution_total(rows, PROFILE, DEPARTMENT, 1999), "label")


@query
def institution_expansion(spark, sf_dir):
    out = wages.institution_expansion(ledger(spark, sf_dir, REPORT_COLUMNS), PROFILE, DEPARTMENT, 1999)
    return out.select(
        "institution", "actual_sum", "row_count", "wage_cost_sum", "other_sum", ratio("wage_share_pct")
    )


@query
def report_display(spark, sf_dir):
    """The institution report as shown, first 120 rows."""
    rows = ledger(spark, sf_dir, REPORT_COLUMNS)
    report = wages.institution_report(rows, PROFILE, DEPARTMENT)
    shown = wages.with_report_display(ordering.top_by(report, "actual_sum", 120))
    return shown.select("institution", "actual_sum_fmt", "other_sum_fmt", "avg_increase_fmt", "wage_share_pct_fmt")


@query
def share_trend_department(spark, sf_dir):
    out = wages.share_trend(ledger(spark, sf_dir, REPORT_COLUMNS), PROFILE, DEPARTMENT)
    return out.select("year", ratio("wage_share_pct"))


@query
def share_trend_institution(spark, sf_dir):
    out = wages.share_trend(ledger(spark, sf_dir, REPORT_COLUMNS), PROFILE, DEPARTMENT, INSTITUTION)
    return out.select("year", ratio("wage_share_pct"))


@query
def wage_scope_yearly(spark, sf_dir):
    rows = ledger(spark, sf_dir, ["year", "samtala0", "samtala2_canonical", "tegund0", "raun"])
    return wages.wage_scope_yearly(rows, PROFILE)


@query
def wage_scope_yearly_department(spark, sf_dir):
    rows = ledger(spark, sf_dir, ["year", "samtala0", "samtala2_canonical", "tegund0", "raun"])
    return wages.wage_scope_yearly(rows, PROFILE, DEPARTMENT, INSTITUTION)


# --- Display ----------------------------------------------------------------------------


@query
def number_format(spark, sf_dir):
    """Sums per supplier in every display form."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_linenumber").agg(
        F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).alias("amount"), F.sum("l_quantity").alias("quantity")
    )
    amount = F.when(F.col("l_linenumber") == 2, F.round("amount", 0)).otherwise(-F.col("amount")).cast("double")
    shown = F.when(F.col("l_linenumber") != 3, amount)
    return lines.select(
        "l_suppkey", "l_linenumber",
        numbers.format_number(shown).alias("number"),
        numbers.format_number(F.col("quantity")).alias("whole"),
        numbers.format_grouped(shown).alias("grouped"),
        numbers.format_percent(shown / 100_000).alias("percent"),
        numbers.format_score(shown / 1_000).alias("score"),
    )


@query
def mixed_sort(spark, sf_dir):
    """A breakdown table sorted by its shown cells: amounts by size, words after them."""
    rows = ledger(spark, sf_dir, ["tegund0", "samtala0", "raun"])
    shown = drill.breakdown(rows, SCOPE, "samtala0")
    cell = F.when(F.length("child_value") == 8, F.col("child_value")).otherwise(numbers.format_number(F.col("actual_sum")))
    cells = shown.select("child_value", cell.alias("cell"))
    # The breakdown holds at most 500 rows, so numbering them in one task is safe.
    ranked = cells.withColumn("position", F.row_number().over(_display_window("cell")))
    return ordering.mixed_sort(ranked, "cell").select("position", "child_value", "cell")


def _display_window(column: str):
    return Window.orderBy(*ordering.mixed_order(column), F.asc("child_value"))


# --- Entities and links -----------------------------------------------------------------


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages")


def captures(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Keys, search captures and detail captures made of the page table."""
    source = pages(spark, sf_dir)
    searches = source.select(F.col("page_id").cast("string").alias("vm_number"), "url", "html")
    details = source.select((F.col("page_id") - DETAIL_SHIFT).cast("string").alias("vm_number"), "url", "html")
    keys = entities.entity_keys(searches)
    return keys, searches, details


@query
def entity_keys(spark, sf_dir):
    return entities.entity_keys(ledger(spark, sf_dir, ["vm_numer"]))


@query
def entity_names(spark, sf_dir):
    return entities.read_names(pages(spark, sf_dir), "page_id")


@query
def entity_status(spark, sf_dir):
    return entities.classify(*captures(spark, sf_dir), NO_RESULT, DETAIL_PART)


@query
def entity_resolve(spark, sf_dir):
    """Numbers below 50 are known already; the others are classified."""
    keys, searches, details = captures(spark, sf_dir)
    known = searches.filter(F.col("vm_number").cast("int") < 50).select(
        "vm_number", F.lit("ok").alias("status"), F.lit("known").alias("name"), "url"
    )
    return entities.resolve_new(keys, known, searches, details, NO_RESULT, DETAIL_PART)


@query
def entity_table(spark, sf_dir):
    """The stored entity table after half of the numbers, then all of them twice, were asked for."""
    keys, searches, details = captures(spark, sf_dir)
    path = scratch_dir(spark, "entities") + "/table"
    half = keys.filter(F.col("vm_number").cast("int") % 2 == 0)
    added = [entities.append_new(k, path, searches, details, NO_RESULT, DETAIL_PART) for k in (half, keys, keys)]
    return entities.read_entities(spark, path).withColumn("added_last", F.lit(added[-1]))


@query
def entity_captures(spark, sf_dir):
    """Captures kept in folders, of which later runs read those of new numbers only."""
    keys, searches, details = captures(spark, sf_dir)
    folder = scratch_dir(spark, "captures")
    stores = [entities.CaptureStore(f"{folder}/{name}") for name in ("searches", "details")]
    for store, pages_of in zip(stores, (searches, details)):
        store.add(pages_of)
    few = keys.filter(F.col("vm_number").cast("int") < 10)
    added = [entities.append_new(k, f"{folder}/table", *stores, NO_RESULT, DETAIL_PART) for k in (few, keys, keys)]
    counts = F.array(*[F.lit(n) for n in added])
    return entities.read_entities(spark, f"{folder}/table").withColumn("added", F.array_join(counts.cast("array<string>"), ","))


def harvested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All links. Store them where they are read more than once: finding them is the costly part."""
    return harvest.harvest_links(pages(spark, sf_dir), ANY_LINK)


@query
def link_harvest(spark, sf_dir):
    return harvested(spark, sf_dir)


@query
def link_first_page(spark, sf_dir):
    return harvest.first_pages(harvested(spark, sf_dir))


def listings(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """File listings before and after a fetch: names are the words that head the documents."""
    words = table(spark, sf_dir, "documents").select(
        F.lower(F.regexp_extract("text", r"^(\w+)", 1)).alias("filename"), "doc_id", F.col("n_chars").alias("bytes")
    )
    before = words.filter(F.col("doc_id") % 2 == 0).select("filename", "bytes")
    return before, words.select("filename", "bytes")


@query
def manifest_status(spark, sf_dir):
    return harvest.manifest(stored(harvested(spark, sf_dir), "links"), *listings(spark, sf_dir))


@query
def manifest_summary(spark, sf_dir):
    links = stored(harvested(spark, sf_dir), "links")
    return harvest.manifest_summary(harvest.manifest(links, *listings(spark, sf_dir), force=True))


@query
def manifest_roundtrip(spark, sf_dir):
    """The manifest written as JSON and read back."""
    links = stored(harvested(spark, sf_dir), "links")
    path = scratch_dir(spark, "manifest") + "/json"
    rows = harvest.manifest(links, *listings(spark, sf_dir))
    ledger_store.write_manifest(rows, path, "http://data.example.org/", "2024-01-01T00:00:00Z")
    record = spark.read.schema(ledger_store.MANIFEST_SCHEMA).json(path)
    files = record.select("dataset_url", "count", F.explode("files").alias("f"))
    return files.select("dataset_url", "count", "f.url", "f.filename", "f.status", "f.bytes", "f.etag")


# --- Ingest -----------------------------------------------------------------------------

EARLY = ["samtala0", "samtala2", "samtala3", "tegund0", "vm_numer", "raun"]
#: Bytes of stored texts for each part of a CSV file.
CSV_PART_BYTES = 256 << 20
LATE = {"Samtala0": "samtala0", "Samtala2": "samtala2", "Tegund0": "tegund0", "VM númer": "vm_numer", "Raun": "raun"}


def landed_files(spark: SparkSession, sf_dir: str) -> str:
    """The ledger as CSV data sets of two layouts, one per year, in a scratch folder."""
    folder = scratch_dir(spark, "landing")
    rows = star_ledger(spark, sf_dir, ["year", *EARLY], text_amounts=True)
    # Only names of this century carry a month, so the years are moved up by twenty.
    name = F.format_string("ledger_%d12.csv", F.col("year") + 20)
    early = rows.filter(F.col("year") < 1999).select(name.alias("name"), *EARLY)
    late = rows.filter(F.col("year") >= 1999).select(name.alias("name"), *[F.col(c).alias(n) for n, c in LATE.items()])

    def land(df: DataFrame, part: str, **options) -> None:
        writer = df.write.partitionBy("name").option("header", True).option("ignoreLeadingWhiteSpace", False)
        with open_files(spark):
            writer.option("ignoreTrailingWhiteSpace", False).options(**options).csv(f"{folder}/{part}")

    land(early, "early", sep=",")
    land(late, "late", sep=";", encoding="ISO-8859-1")
    return folder


def ingest_profile(rows: DataFrame) -> DataFrame:
    amount = numbers.measure(rows, "raun")
    return rows.groupBy("source_file", "source_url", "year", "period_month", "samtala2", "samtala3").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count("vm_numer").alias("numbered"),
        F.sum(amount).cast("double").alias("total"),
    )


def landed_manifest(spark: SparkSession, sf_dir: str, folder: str) -> DataFrame:
    """A manifest of the early files, written as JSON and read back. It has one entry per year."""
    years = ordering.distinct_years(star_ledger(spark, sf_dir, ["year"])).filter(F.col("year") < 1999)
    name = F.format_string("ledger_%d12.csv", F.col("year") + 20)
    entry = F.struct(F.concat(F.lit("http://data.example.org/download/"), name).alias("url"), name.alias("filename"))
    path = f"{folder}/manifest"
    years.agg(F.collect_list(entry).alias("files")).coalesce(1).write.json(path)
    return ledger_store.read_manifest(spark, path)


@query
def csv_ingest(spark, sf_dir):
    """The ledger written as CSV files of two layouts, found again, combined, and given their addresses."""
    folder = landed_files(spark, sf_dir)
    manifest = landed_manifest(spark, sf_dir, folder)
    return ingest_profile(ledger_store.with_source_url(csv_folder.read_csv_folder(spark, folder).table, manifest))


@query
def ingest_metadata(spark, sf_dir):
    """Rows and number of columns of every file."""
    ingest = csv_folder.read_csv_folder(spark, landed_files(spark, sf_dir))
    return ledger_store.ingest_metadata(spark, ingest).select("file", "rows", F.size("columns").alias("columns"))


@query
def ingest_columns(spark, sf_dir):
    """Original and final name of every column of every file, from the metadata written by the run."""
    path = scratch_dir(spark, "metadata") + "/json"
    ledger_store.write_metadata(ledger_store.ingest_metadata(spark, csv_folder.read_csv_folder(spark, landed_files(spark, sf_dir))), path)
    schema = "generated_at string, file string, rows bigint, columns map<string,string>"
    return spark.read.schema(schema).json(path).select("file", F.explode("columns").alias("original", "final"))


@query
def clashing_headers(spark, sf_dir):
    """Columns whose names become the same one."""
    folder = scratch_dir(spark, "clashing")
    names = {"l_orderkey": "Raun", "l_linenumber": "Raun.", "l_suppkey": "(raun)", "l_partkey": "raun_2"}
    rows = table(spark, sf_dir, "lineitem").select(*[F.col(c).alias(n) for c, n in names.items()])
    rows.write.option("header", True).csv(f"{folder}/lines_202001.csv")
    back = csv_folder.read_csv_folder(spark, folder).table
    totals = back.agg(*[F.sum(F.col(c).cast("bigint")).alias(c) for c in back.columns[len(csv_folder.PROVENANCE) + 1 :]])
    return totals.unpivot([], totals.columns, "name", "total")


@query
def ledger_update(spark, sf_dir):
    """Wages by department off the partial sums, after all files came, none changed, and one was replaced and one removed."""
    folder = landed_files(spark, sf_dir)
    kept = StoredLedger(f"{scratch_dir(spark, 'kept')}/ledger", PROFILE)
    updates = [kept.update(spark, folder), kept.update(spark, folder)]
    rows = star_ledger(spark, sf_dir, ["year", *EARLY], text_amounts=True).where("year = 1995 AND tegund0 = 'STANDARD'")
    rows.select(*EARLY).write.mode("overwrite").option("header", True).option("ignoreLeadingWhiteSpace", False).option(
        "ignoreTrailingWhiteSpace", False
    ).csv(f"{folder}/early/name=ledger_201512.csv")
    remove_folders(spark, [f"{folder}/early/name=ledger_201612.csv"])
    updates.append(kept.update(spark, folder))
    said = " ".join(f"{len(u.taken)}/{len(u.dropped)}" for u in updates)
    total = kept.read(spark).count()
    report = wages.wage_totals(kept.cells(spark), PROFILE, PROFILE.department)
    return report.withColumns({"updates": F.lit(said), "all_rows": F.lit(total).cast("bigint")})


@query
def ledger_store_roundtrip(spark, sf_dir):
    """The prepared ledger written by year and read back through a named view."""
    rows = star_ledger(spark, sf_dir, ["year", "period_month", "samtala0", "samtala2", "raun"], text_amounts=True)
    path = scratch_dir(spark, "ledger") + "/table"
    ledger_store.write_ledger(ledger_store.prepare_ledger(rows, PROFILE), path)
    ledger_store.register_views(spark, {"ledger": path}, PROFILE)
    return (
        spark.table("ledger")
        .groupBy("year", "samtala2_family")
        .agg(F.count(F.lit(1)).alias("rows"), F.sum("raun").cast("double").alias("total"))
    )


@query
def csv_records(spark, sf_dir):
    """Texts of many lines in one CSV file, a large one in parts of bounded size, each cut into records by many tasks."""
    folder = scratch_dir(spark, "records")
    texts = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    # A part is larger than what a task reads of it, so that records are cut between tasks, but no task writes all texts.
    held = ledger_store.list_files(spark, f"{sf_dir}/documents.parquet").agg(F.sum("bytes")).first()[0] or 0
    writer = texts.coalesce(max(1, -(-held // CSV_PART_BYTES))).write.option("header", True).option("escape", '"').option("quoteAll", True)
    writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(f"{folder}/texts_202012.csv")
    rows = csv_folder.read_csv_folder(spark, folder).table
    return rows.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), "source", F.sha2("text", 256).alias("text_sha256"), "source_file", "year", "period_month"
    )


@query
def landing_ingest(spark, sf_dir):
    """The files of both layouts taken in by the incremental job, a few in each batch."""
    folder = landed_files(spark, sf_dir)
    out, mark = (f"{scratch_dir(spark, name)}/table" for name in ("landed", "landed-mark"))
    landing.ingest_new(spark, folder, out, mark, files_per_batch=3).awaitTermination()
    return ingest_profile(landing.read_landed(spark, out))


@query
def landing_log(spark, sf_dir):
    """What the incremental job notes of every data set: its columns, and that a second run adds none."""
    folder = landed_files(spark, sf_dir)
    out, mark = (f"{scratch_dir(spark, name)}/table" for name in ("landed", "landed-mark"))
    for _ in range(2):
        landing.ingest_new(spark, folder, out, mark).awaitTermination()
    log = landing.read_log(spark, out)
    rows = landing.read_landed(spark, out).groupBy("source_file").agg(F.count(F.lit(1)).alias("rows"))
    return log.groupBy("source_file").agg(F.max(F.size("columns")).alias("columns")).join(rows, "source_file")
