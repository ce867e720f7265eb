"""The same results in plain SQL, written without looking at how the Spark plans get there."""

from __future__ import annotations

# The ledger view over the star tables, all joins included.
LEDGER = """
raw AS (
  SELECT CAST(year(o_orderdate) AS INTEGER) AS year,
         CAST(month(o_orderdate) AS INTEGER) AS period_month,
         c_name AS fyrirtaeki, cn.n_name AS samtala0, r_name AS samtala1,
         '  ' || c_mktsegment || ' ' AS samtala2,
         CASE WHEN l_linenumber = 1 THEN NULL ELSE o_orderstatus END AS samtala3,
         p_type AS tegund0, l_linestatus AS tegund1,
         CAST(NULL AS VARCHAR) AS tegund2, CAST(NULL AS VARCHAR) AS tegund3,
         CASE WHEN s_nationkey <> 0 THEN 'VSK-' || lpad(CAST(s_nationkey AS VARCHAR), 6, '0') END AS vm_numer,
         CASE WHEN s_nationkey <> 0 THEN sn.n_name END AS vm_nafn,
         CAST(CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END * CAST(l_extendedprice AS DECIMAL(18,2))
              AS DECIMAL(18,2)) AS raun
  FROM lineitem
  LEFT JOIN orders ON o_orderkey = l_orderkey
  LEFT JOIN customer ON c_custkey = o_custkey
  LEFT JOIN nation cn ON cn.n_nationkey = c_nationkey
  LEFT JOIN region ON r_regionkey = cn.n_regionkey
  LEFT JOIN part ON p_partkey = l_partkey
  LEFT JOIN supplier ON s_suppkey = l_suppkey
  LEFT JOIN nation sn ON sn.n_nationkey = s_nationkey
),
ledger AS (
  SELECT *, trim(samtala2) AS samtala2_raw,
         CASE WHEN trim(samtala2) IN ('HOUSEHOLD', 'FURNITURE') THEN 'HOME'
              ELSE trim(samtala2) END AS samtala2_canonical,
         CASE WHEN trim(samtala2) IN ('HOUSEHOLD', 'FURNITURE') THEN 'HOME / FURNITURE'
              ELSE trim(samtala2) END AS samtala2_family
  FROM raw
)"""

INDEX = """
level AS (
  SELECT CAST(year(o_orderdate) AS INTEGER) AS year, CAST(month(o_orderdate) AS INTEGER) AS month,
         CAST(sum(CAST(CAST(o_totalprice AS DECIMAL(18,2)) * 100 AS BIGINT)) // (count(*) * 1000) AS BIGINT) AS q
  FROM orders GROUP BY 1, 2
),
index_monthly AS (
  SELECT year, month, format('{:d}M{:02d}', year, month) AS month_key, q / 100.0 AS cpi FROM level
),
annual AS (SELECT year, avg(cpi) AS cpi_avg FROM index_monthly GROUP BY year),
index_annual AS (
  SELECT year, cpi_avg, (SELECT cpi_avg FROM annual ORDER BY year DESC LIMIT 1) AS cpi_latest_base,
         (SELECT cpi_avg FROM annual ORDER BY year DESC LIMIT 1) / cpi_avg AS deflator_to_latest
  FROM annual
)"""


def scored(*keys: str) -> str:
    """The chain from ledger rows to the scored table, for series of these keys."""
    listed, last = ", ".join(keys), len(keys) + 1
    filled = ", ".join(f"coalesce({k}, '(missing)') AS {k}" for k in keys)
    numbers = ", ".join(str(i) for i in range(1, last + 1))
    own, mids, devs = (", ".join(f"{t}.{k}" for k in keys) for t in "cmd")
    return f"""
nominal AS (
  SELECT year, {filled}, CAST(sum(raun) AS DOUBLE) AS actual_nominal
  FROM ledger WHERE year IS NOT NULL AND raun IS NOT NULL GROUP BY {numbers}
),
real AS (
  SELECT n.*, i.deflator_to_latest, n.actual_nominal * i.deflator_to_latest AS actual_real
  FROM nominal n JOIN index_annual i ON i.year = n.year
),
prior AS (
  SELECT *, lag(actual_real) OVER (PARTITION BY {listed} ORDER BY year) AS prior_real FROM real
),
change AS (
  SELECT *, actual_real - prior_real AS yoy_real_change,
         CASE WHEN abs(prior_real) > 1e-9 THEN (actual_real - prior_real) / abs(prior_real) END AS yoy_real_pct
  FROM prior
),
med AS (
  SELECT {listed}, count(*) AS series_year_count, median(yoy_real_pct) AS mid FROM change GROUP BY {listed}
),
mad AS (
  SELECT {own}, median(abs(c.yoy_real_pct - m.mid)) AS dev
  FROM change c JOIN med m ON ({mids}) = ({own}) GROUP BY {own}
),
sized AS (
  SELECT c.*, m.series_year_count,
         CASE WHEN d.dev <> 0 THEN 0.6745 * (c.yoy_real_pct - m.mid) / d.dev END AS mz_yoy_pct,
         CASE WHEN c.yoy_real_change >= 0 THEN 'increase' ELSE 'decrease' END AS direction,
         abs(c.yoy_real_pct) AS abs_pct, abs(c.yoy_real_change) AS abs_change_real
  FROM change c
  JOIN med m ON ({mids}) = ({own})
  JOIN mad d ON ({devs}) = ({own})
),
scored AS (
  SELECT *, abs(mz_yoy_pct) AS abs_mz,
         coalesce(series_year_count >= 4 AND abs_pct >= 0.25 AND abs(mz_yoy_pct) >= 3.5
                  AND abs(prior_real) >= 20000 AND abs_change_real >= 50000, FALSE) AS is_anomaly,
         coalesce(abs(mz_yoy_pct), 0) * 0.7 + coalesce(abs_pct, 0) * 100 * 0.3 AS anomaly_score,
         CASE WHEN trim(samtala2) IN ('HOUSEHOLD', 'FURNITURE') THEN 'HOME'
              ELSE trim(samtala2) END AS samtala2_canonical
  FROM sized
)"""


SCORED = scored("samtala0", "samtala2")
TEN_KEYS = [
    "samtala0", "samtala1", "samtala2", "samtala3", "tegund0", "tegund1", "tegund2", "tegund3", "vm_nafn", "vm_numer",
]

FULL = "SELECT year FROM ledger WHERE year IS NOT NULL GROUP BY year HAVING max(period_month) >= 12"
FIGURES = """CAST(actual_sum AS DOUBLE) AS actual_sum, CAST(other_sum AS DOUBLE) AS other_sum,
  CAST(wage_cost_sum AS DOUBLE) AS wage_cost_sum, CAST(row_count AS BIGINT) AS row_count,
  round(avg_increase_pct, 6) AS avg_increase_pct,
  round(CASE WHEN wage_cost_sum + other_sum <> 0
             THEN CAST(wage_cost_sum AS DOUBLE) / (CAST(wage_cost_sum AS DOUBLE) + CAST(other_sum AS DOUBLE)) * 100
             ELSE 0 END, 6) AS wage_share_pct"""
WAGE = "CASE WHEN tegund0 = 'STANDARD' THEN raun ELSE 0 END"
OTHER = "CASE WHEN tegund0 <> 'STANDARD' OR tegund0 IS NULL THEN raun ELSE 0 END"
DETAIL = ["samtala1", "samtala3", "tegund1", "tegund2", "tegund3", "vm_numer"]
LISTED = "samtala2_canonical IS NOT NULL AND samtala2_canonical NOT IN ('MACHINERY')"
BUILDING = "samtala2_canonical = 'BUILDING' AND samtala0 IS NOT NULL"
SCOPE_COLUMNS = [
    "year", "samtala0", "samtala1", "samtala2_canonical", "samtala3", "tegund0", "tegund1", "tegund2", "tegund3",
    "vm_nafn", "vm_numer",
]
SCOPE_LIST = ", ".join(SCOPE_COLUMNS) + ", CAST(raun AS DOUBLE) AS raun"
SCOPE_ORDER = "year DESC NULLS LAST, " + ", ".join(f"{c} ASC NULLS LAST" for c in [*SCOPE_COLUMNS, "raun"])
STANDARD_1999 = "tegund0 = 'STANDARD' AND year = 1999"


def with_(*parts: str) -> str:
    return "WITH " + ",".join(parts) + "\n"


def growth(by: str, where: str) -> str:
    """CTEs ``delta`` (growth per row) over full years."""
    key = f"{by}, " if by else ""
    part = f"PARTITION BY {by} " if by else ""
    return f"""
yearly AS (
  SELECT {key}year, CAST(sum({WAGE}) AS DOUBLE) AS wage_sum FROM ledger
  WHERE {where} AND year IS NOT NULL AND year IN ({FULL}) GROUP BY {key}year
),
delta AS (
  SELECT {key}year, wage_sum, lag(wage_sum) OVER ({part}ORDER BY year) AS before FROM yearly
),
grown AS (
  SELECT {key}year, wage_sum, CASE WHEN before <> 0 THEN (wage_sum / before - 1) * 100 END AS pct FROM delta
)"""


def cells(by: str, where: str, detail: list[str], year: str) -> str:
    keys = ", ".join(f"coalesce({c}, '')" for c in detail)
    return f"""
basis AS (
  SELECT {by} AS grp, year, sum({WAGE}) AS w, sum({OTHER}) AS o FROM ledger
  WHERE {where} AND year IS NOT NULL {year} GROUP BY {by}, year, {keys}
),
cost AS (SELECT grp, sum(greatest(w, 0)) AS wage_cost_sum, sum(greatest(o, 0)) AS other_sum FROM basis GROUP BY grp)"""


def report(name: str, by: str, where: str, detail: list[str], year: str = "") -> str:
    return with_(
        LEDGER, growth(by, where), cells(by, where, detail, year),
        f"""
tot AS (SELECT {by} AS grp, sum({WAGE}) AS actual_sum, count(*) AS row_count FROM ledger
        WHERE {where} {year} GROUP BY {by}),
mean AS (SELECT {by} AS grp, avg(pct) AS avg_increase_pct FROM grown WHERE pct IS NOT NULL GROUP BY {by})""",
    ) + f"""SELECT tot.grp AS {name}, {FIGURES} FROM tot
LEFT JOIN mean ON mean.grp = tot.grp LEFT JOIN cost ON cost.grp = tot.grp"""


def report_total(by: str, where: str, detail: list[str], year: str = "") -> str:
    return with_(
        LEDGER, growth("", where), cells(by, where, detail, year),
        f"""
tot AS (SELECT sum({WAGE}) AS actual_sum, count(*) AS row_count FROM ledger WHERE {where} {year}),
mean AS (SELECT avg(pct) AS avg_increase_pct FROM grown WHERE pct IS NOT NULL),
sums AS (SELECT sum(wage_cost_sum) AS wage_cost_sum, sum(other_sum) AS other_sum FROM cost)""",
    ) + f"SELECT 'Total' AS label, {FIGURES} FROM tot, mean, sums"


def trend(where: str) -> str:
    return with_(LEDGER, cells("year", where, DETAIL, "")) + """
SELECT grp AS year, round(CASE WHEN wage_cost_sum + other_sum > 0
    THEN CAST(wage_cost_sum AS DOUBLE) / (CAST(wage_cost_sum AS DOUBLE) + CAST(other_sum AS DOUBLE)) * 100 END, 6)
    AS wage_share_pct FROM cost"""


def facets(columns: list[str], year: str, filters: dict[str, str]) -> str:
    parts = []
    for c in columns:
        tests = [f"{f} = '{v}'" for f, v in filters.items() if f != c] + [f"{c} IS NOT NULL"] + ([year] if year else [])
        parts.append(f"SELECT DISTINCT '{c}' AS facet, {c} AS value FROM ledger WHERE {' AND '.join(tests)}")
    return with_(LEDGER, "opts AS (" + " UNION ALL ".join(parts) + ")") + """
SELECT * FROM (SELECT facet, value, CAST(row_number() OVER (PARTITION BY facet ORDER BY value) AS INTEGER) AS position
               FROM opts) WHERE position <= 200"""


FACETS = [
    "fyrirtaeki", "samtala0", "samtala1", "samtala2_canonical", "samtala3", "tegund0", "tegund1", "tegund2", "tegund3",
    "vm_numer", "vm_nafn",
]


def shown(x: str) -> str:
    """Text of a number with dots for thousands and a decimal comma."""
    swap = f"translate(format('{{:,.2f}}', CAST({x} AS DOUBLE)), ',.', '.,')"
    whole = f"replace(format('{{:,}}', CAST(round(CAST({x} AS DOUBLE)) AS BIGINT)), ',', '.')"
    return f"""CASE WHEN {x} IS NULL THEN '' WHEN CAST({x} AS DOUBLE) = round(CAST({x} AS DOUBLE)) THEN {whole}
                ELSE {swap} END"""


def percent(x: str) -> str:
    return f"CASE WHEN {x} IS NULL THEN '' ELSE format('{{:.1f}}%', {x}) END"


def signed(where: str) -> str:
    return with_(LEDGER) + f"""
SELECT count(*) AS rows, coalesce(CAST(sum(raun) AS DOUBLE), 0) AS sum,
       coalesce(CAST(sum(CASE WHEN raun > 0 THEN raun END) AS DOUBLE), 0) AS sum_pos,
       coalesce(CAST(sum(CASE WHEN raun < 0 THEN raun END) AS DOUBLE), 0) AS sum_neg
FROM ledger WHERE {where}"""


PAGE = r"""
clean AS (
  SELECT page_id, url, html, regexp_replace(regexp_replace(html, '<!--.*?-->|<![^>]*>', '', 'gs'),
         '<script[^>]*>.*?</script>|<style[^>]*>.*?</style>', '', 'gs') AS shown FROM pages
),
named AS (
  SELECT page_id, url, shown, regexp_extract(shown, '<h1>(.*?)</h1>', 1, 's') AS h1,
         regexp_extract(shown, '<title>(.*?)</title>', 1, 's') AS title FROM clean
),
plain AS (
  SELECT page_id, url, shown,
         regexp_replace(replace(trim(regexp_replace(CASE WHEN trim(h1) <> '' THEN h1 ELSE title END, '<[^>]*>', '', 'g')),
                 '&quot;', '"'), '&amp;?', '&', 'g') AS name
  FROM named
)"""

STATUS = PAGE + r""",
facts AS (
  SELECT page_id, url, name, contains(lower(regexp_replace(shown, '<[^>]*>', ' ', 'g')), 'para') AS nothing,
         regexp_extract(url, '^(https?://[^/?#]+)', 1)
           || list_filter(regexp_extract_all(shown, 'href="([^"]*)"', 1), lambda x: contains(x, '/de'))[1] AS link
  FROM plain
),
entities AS (
  SELECT CAST(s.page_id AS VARCHAR) AS vm_number,
         CASE WHEN s.nothing THEN 'no_result' WHEN s.link IS NULL THEN 'result_unknown'
              WHEN d.page_id IS NULL THEN 'error: no detail capture' WHEN d.name <> '' THEN 'ok'
              ELSE 'missing_name' END AS status,
         CASE WHEN s.nothing THEN NULL WHEN s.link IS NULL THEN s.name ELSE d.name END AS name,
         CASE WHEN s.nothing OR s.link IS NULL THEN s.url ELSE s.link END AS url
  FROM facts s LEFT JOIN facts d ON d.page_id = s.page_id + 125
)"""

LINKS = r"""
hrefs AS (
  SELECT page_id, regexp_extract(url, '^(https?://[^/?#]+)', 1) AS origin,
         regexp_extract_all(html, 'href="([^"]+)"', 1) AS list FROM pages
),
each AS (
  SELECT page_id, origin || unnest(list) AS link, generate_subscripts(list, 1) AS p FROM hrefs
),
harvest AS (
  SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY min(p)) - 1 AS INTEGER) AS position,
         link, regexp_extract(link, '([^/]+)$', 1) AS filename
  FROM each GROUP BY page_id, link
),
words AS (
  SELECT lower(regexp_extract(text, '^(\w+)', 1)) AS filename, doc_id, n_chars AS bytes FROM documents
),
had AS (SELECT filename, max(bytes) AS had FROM words WHERE doc_id % 2 = 0 GROUP BY filename),
has AS (SELECT filename, max(bytes) AS has FROM words GROUP BY filename),
ranked AS (
  SELECT h.*, had, has, row_number() OVER (PARTITION BY h.filename ORDER BY page_id, position) AS turn
  FROM harvest h LEFT JOIN had ON had.filename = h.filename LEFT JOIN has ON has.filename = h.filename
)"""


def ingested(where: str, url: str) -> str:
    return with_(LEDGER) + f"""
SELECT 'ledger_' || (ledger.year + 20) || '12.csv' AS source_file, {url} AS source_url, CAST(ledger.year + 20 AS INTEGER) AS year, 12 AS period_month, samtala2,
       CASE WHEN ledger.year < 1999 THEN samtala3 END AS samtala3, count(*) AS rows, count(vm_numer) AS numbered,
       CAST(sum(raun) AS DOUBLE) AS total
FROM ledger WHERE {where} GROUP BY ledger.year, samtala2, CASE WHEN ledger.year < 1999 THEN samtala3 END"""


ORACLE: dict[str, str] = {
    "summary_by_category": with_(LEDGER) + """
SELECT samtala2_canonical, CAST(sum(raun) AS DOUBLE) AS raun FROM ledger GROUP BY 1
ORDER BY raun DESC NULLS LAST, 1 LIMIT 50""",
    "summary_filtered": with_(LEDGER) + """
SELECT samtala0, CAST(sum(raun) AS DOUBLE) AS raun FROM ledger
WHERE year = 1999 AND tegund0 = 'STANDARD' AND samtala1 = 'ASIA' GROUP BY 1
ORDER BY raun DESC NULLS LAST, 1 LIMIT 50""",
    "totals_signed": signed("TRUE"),
    "totals_filtered": signed("year = 1999 AND tegund0 = 'STANDARD' AND samtala1 = 'ASIA'"),
    "value_counts": with_(LEDGER) + """
SELECT vm_nafn, count(*) AS count FROM ledger GROUP BY 1 ORDER BY 2 DESC, 1 NULLS LAST LIMIT 50""",
    "count_rows": with_(LEDGER) + """
SELECT count(*) AS rows FROM ledger WHERE year = 1999 AND tegund0 = 'STANDARD' AND samtala1 = 'ASIA'""",
    "category_profile": with_(
        LEDGER,
        "counts AS (" + " UNION ALL ".join(
            f"SELECT '{c}' AS category, count(DISTINCT {c}) AS distinct_count FROM ledger" for c in FACETS[:9]
        ) + ")",
    ) + "SELECT * FROM counts WHERE distinct_count > 1 AND distinct_count <= 200",
    "facet_options": facets(FACETS, "year = 1999", {"tegund0": "STANDARD", "samtala1": "ASIA"}),
    "facet_options_open": facets(FACETS, "", {}),
    "distinct_years": with_(LEDGER) + "SELECT DISTINCT year FROM ledger WHERE year IS NOT NULL",
    "preview_page": with_(LEDGER) + """
SELECT year, samtala0, samtala3, tegund0, tegund1, vm_numer, CAST(raun AS DOUBLE) AS raun FROM ledger
WHERE tegund0 = 'STANDARD' AND samtala1 = 'ASIA' AND samtala2_canonical = 'HOME'
ORDER BY raun DESC, year NULLS LAST, samtala0 NULLS LAST, samtala3 NULLS LAST, tegund1 NULLS LAST,
         vm_numer NULLS LAST LIMIT 500""",
    "number_parse": with_(
        LEDGER,
        f"texts AS (SELECT raun, {shown('raun')} AS t FROM ledger)",
        """forms AS (SELECT CAST(length(t) % 4 AS INTEGER) AS form, CAST(ascii(right(t, 1)) % 7 AS INTEGER) AS n, raun FROM texts)""",
        """amounts AS (SELECT form, n, CASE WHEN n IN (2, 3) THEN NULL WHEN n = 1 THEN abs(raun)
                       WHEN n = 4 THEN CAST(trunc(raun) AS DECIMAL(18,2)) ELSE raun END AS amount FROM forms)""",
    ) + """SELECT form, n, count(*) AS rows, count(amount) AS usable, CAST(sum(amount) AS DOUBLE) AS total
FROM amounts GROUP BY 1, 2""",
    "wide_amounts": with_(LEDGER) + """
SELECT year, count(*) AS usable,
       CAST(sum(CAST(CAST(CAST(raun AS DECIMAL(20,2)) * 1000000000000 AS DECIMAL(30,0)) || '.1234' AS DECIMAL(38,4))) AS VARCHAR) AS total
FROM ledger GROUP BY year""",
    "department_modes": with_(LEDGER) + """
SELECT samtala2, samtala2_raw, samtala2_canonical, samtala2_family, count(*) AS rows FROM ledger GROUP BY ALL""",
    "department_dimension": with_(LEDGER) + """
SELECT mode, department, count(*) AS rows FROM (
  SELECT 'raw' AS mode, samtala2_raw AS department FROM ledger
  UNION ALL SELECT 'canonical', samtala2_canonical FROM ledger
  UNION ALL SELECT 'family', samtala2_family FROM ledger
  UNION ALL SELECT 'other', samtala2_canonical FROM ledger) GROUP BY ALL""",
    "file_periods": """
SELECT y AS year, CASE WHEN k % 3 <> 1 AND m BETWEEN 1 AND 12 THEN m END AS period_month, count(*) AS files
FROM (SELECT CAST(year(o_orderdate) + 20 AS INTEGER) AS y, o_orderkey AS k, CAST(o_orderkey % 15 AS INTEGER) AS m FROM orders)
GROUP BY ALL""",
    "yearly_scope": with_(LEDGER) + """
SELECT year, coalesce(CAST(sum(raun) AS DOUBLE), 0) AS actual_sum FROM ledger
WHERE tegund0 = 'STANDARD' AND year IS NOT NULL GROUP BY year""",
    "child_breakdown": with_(LEDGER) + f"""
SELECT samtala0 AS child_value, CAST(sum(raun) AS DOUBLE) AS actual_sum, count(*) AS row_count FROM ledger
WHERE {STANDARD_1999} AND samtala0 IS NOT NULL GROUP BY 1 ORDER BY abs(sum(raun)) DESC NULLS LAST, 1 LIMIT 500""",
    "parent_options": with_(LEDGER) + """
SELECT DISTINCT vm_nafn FROM ledger WHERE vm_nafn IS NOT NULL ORDER BY 1 LIMIT 1500""",
    "record_page": with_(LEDGER) + f"""
SELECT {SCOPE_LIST} FROM ledger WHERE {STANDARD_1999} ORDER BY {SCOPE_ORDER} LIMIT 100
OFFSET (SELECT greatest(CAST(ceil(count(*) / 100.0) AS BIGINT), 1) * 100 - 100 FROM ledger WHERE {STANDARD_1999})""",
    "middle_page": with_(LEDGER) + f"""
SELECT {SCOPE_LIST} FROM ledger ORDER BY {SCOPE_ORDER} LIMIT 100
OFFSET (SELECT least(9900, greatest(CAST(ceil(count(*) / 100.0) AS BIGINT), 1) * 100 - 100) FROM ledger)""",
    "scope_export_file": with_(LEDGER) + f"""
SELECT {SCOPE_LIST}, TRUE AS in_order FROM ledger WHERE tegund0 = 'STANDARD' AND samtala0 = 'NATION_7'""",
    "anomaly_export_file": with_(LEDGER, INDEX, SCORED) + """
SELECT year, samtala0, samtala2, direction, round(actual_real, 2) AS actual_real, round(anomaly_score, 6) AS anomaly_score, TRUE AS in_order
FROM scored WHERE is_anomaly""",
    "anomaly_file_contents": with_(LEDGER, INDEX, SCORED) + " UNION ALL ".join(
        f"""
SELECT '{name}' AS file, year, samtala0, samtala2, round(actual_real, 2) AS figure, round(anomaly_score, 6) AS score, is_anomaly FROM scored {which}"""
        for kind in ("", "_csv") for name, which in ((f"anomalies_yoy_all{kind}", ""), (f"anomalies_flagged{kind}", "WHERE is_anomaly"))
    ) + """
UNION ALL SELECT 'index_monthly_csv', year, month_key, NULL, round(cpi, 6), NULL, NULL FROM index_monthly
UNION ALL SELECT 'index_annual_csv', year, NULL, NULL, round(cpi_avg, 6), round(deflator_to_latest, 6), NULL FROM index_annual
UNION ALL SELECT 'anomalies_summary', (SELECT max(year) FROM index_annual), NULL, NULL, CAST(count(*) AS DOUBLE),
  CAST(count(*) FILTER (WHERE is_anomaly) AS DOUBLE), NULL FROM scored""",
    "stored_views": with_(LEDGER, INDEX, SCORED) + """
SELECT 'ledger' AS view, samtala2_canonical, count(*) AS rows FROM ledger GROUP BY 2
UNION ALL SELECT 'anomalies', samtala2_canonical, count(*) FROM scored WHERE is_anomaly GROUP BY 2
UNION ALL SELECT 'anomalies_all', samtala2_canonical, count(*) FROM scored GROUP BY 2
UNION ALL SELECT 'anomalies_all, not kept', samtala2_canonical, count(*) FROM scored WHERE is_anomaly GROUP BY 2""",
    "indexed_pages": with_(LEDGER) + f""",
placed AS (
  SELECT {SCOPE_LIST}, CAST((row_number() OVER (ORDER BY {SCOPE_ORDER}) - 1) // 50 + 1 AS INTEGER) AS page,
         CAST((count(*) OVER () + 49) // 50 AS INTEGER) AS pages FROM ledger
)
SELECT placed.* FROM placed JOIN (SELECT unnest([1, 123, 1000000000]) AS asked) ON page = least(asked, pages)""",
    "scope_export": with_(LEDGER) + f"""
SELECT {SCOPE_LIST} FROM ledger WHERE tegund0 = 'STANDARD' AND samtala0 = 'NATION_7'""",
    "scope_rows": with_(LEDGER) + f"""
SELECT {SCOPE_LIST} FROM ledger WHERE samtala2_canonical = 'BUILDING' AND year = 1998
ORDER BY {SCOPE_ORDER} LIMIT 200""",
    "pair_exists": with_(LEDGER) + """
SELECT count(*) > 0 AS found, count(*) AS rows FROM ledger
WHERE samtala2_canonical = 'BUILDING' AND samtala0 = 'NATION_7'""",
    "index_monthly": with_(INDEX) + "SELECT year, month, month_key, cpi FROM index_monthly",
    "index_annual": with_(INDEX) + """
SELECT year, round(cpi_avg, 6) AS cpi_avg, round(cpi_latest_base, 6) AS cpi_latest_base,
       round(deflator_to_latest, 6) AS deflator_to_latest FROM index_annual""",
    "year_range": with_(LEDGER) + "SELECT min(year) AS year_min, max(year) AS year_max FROM ledger",
    "month_keys": with_(LEDGER) + """
SELECT format('{:d}M{:02d}', y, m) AS month_key, CAST(y AS INTEGER) AS year, CAST(m AS INTEGER) AS month
FROM (SELECT min(year) AS lo, greatest(max(year), 2003) AS hi FROM ledger) s,
     LATERAL (SELECT unnest(range(lo, hi + 1)) AS y) a, (SELECT unnest(range(1, 13)) AS m) b""",
    "month_selection": with_(LEDGER, INDEX) + """
SELECT month_key, year * 12 + month AS position FROM index_monthly
WHERE year BETWEEN (SELECT min(year) FROM ledger) AND (SELECT greatest(max(year), 1999) FROM ledger)""",
    "annual_actuals": with_(LEDGER) + """
SELECT year, coalesce(samtala0, '(missing)') AS samtala0, coalesce(samtala3, '(missing)') AS samtala3,
       coalesce(tegund2, '(missing)') AS tegund2, coalesce(vm_nafn, '(missing)') AS vm_nafn,
       CAST(sum(raun) AS DOUBLE) AS actual_nominal
FROM ledger WHERE year IS NOT NULL AND raun IS NOT NULL GROUP BY ALL""",
    "annual_real": with_(LEDGER, INDEX, SCORED) + """
SELECT year, samtala0, samtala2, round(actual_nominal, 2) AS actual_nominal,
       round(deflator_to_latest, 6) AS deflator_to_latest, round(actual_real, 2) AS actual_real FROM real""",
    "yoy_real": with_(LEDGER, INDEX, SCORED) + """
SELECT year, samtala0, samtala2, round(prior_real, 2) AS prior_real, round(yoy_real_change, 2) AS yoy_real_change,
       round(yoy_real_pct, 6) AS yoy_real_pct FROM change""",
    "modified_zscore": with_(
        LEDGER,
        "n AS (SELECT year, coalesce(samtala0, '(missing)') AS samtala0, CAST(sum(raun) AS DOUBLE) AS v FROM ledger GROUP BY 1, 2)",
        "m AS (SELECT samtala0, median(v) AS mid FROM n GROUP BY 1)",
        "d AS (SELECT n.samtala0, median(abs(v - mid)) AS dev FROM n JOIN m ON m.samtala0 = n.samtala0 GROUP BY 1)",
    ) + """
SELECT year, n.samtala0 AS samtala0, round(CASE WHEN dev <> 0 THEN 0.6745 * (v - mid) / dev END, 6) AS z
FROM n JOIN m ON m.samtala0 = n.samtala0 JOIN d ON d.samtala0 = n.samtala0""",
    "robust_stats": with_(LEDGER, """
x AS (SELECT tegund0, samtala3 AS second, 1 AS grain, CAST(raun AS DOUBLE) AS x FROM ledger
      UNION ALL SELECT tegund0, samtala0, 2, CAST(raun AS DOUBLE) FROM ledger),
m AS (SELECT grain, tegund0, second, median(x) AS mid FROM x GROUP BY ALL)""") + """
SELECT x.tegund0 AS tegund0, x.second AS second, round(any_value(mid), 4) AS median, round(median(abs(x - mid)), 4) AS mad
FROM x JOIN m ON x.grain = m.grain AND x.tegund0 = m.tegund0 AND x.second IS NOT DISTINCT FROM m.second
GROUP BY x.grain, x.tegund0, x.second""",
    "anomalies_all": with_(LEDGER, INDEX, SCORED) + """
SELECT year, samtala0, samtala2, samtala2_canonical, round(actual_real, 2) AS actual_real,
       round(prior_real, 2) AS prior_real, round(yoy_real_change, 2) AS yoy_real_change,
       round(yoy_real_pct, 6) AS yoy_real_pct, series_year_count, round(mz_yoy_pct, 6) AS mz_yoy_pct, direction,
       round(abs_pct, 6) AS abs_pct, round(abs_mz, 6) AS abs_mz, round(abs_change_real, 2) AS abs_change_real,
       is_anomaly, round(anomaly_score, 6) AS anomaly_score FROM scored""",
    "anomalies_flagged": with_(LEDGER, INDEX, SCORED) + """
SELECT year, samtala0, samtala2, direction, round(abs_change_real, 2) AS abs_change_real,
       round(anomaly_score, 6) AS anomaly_score FROM scored WHERE is_anomaly""",
    "anomaly_summary": with_(LEDGER, INDEX, SCORED) + """
SELECT count(*) AS rows_total, count(*) FILTER (WHERE is_anomaly) AS rows_flagged,
       (SELECT min(year) FROM index_annual) AS year_from, (SELECT max(year) FROM index_annual) AS year_to,
       CAST(3.5 AS DOUBLE) AS z_threshold, CAST(0.25 AS DOUBLE) AS pct_threshold,
       CAST(50000 AS DOUBLE) AS min_abs_real_change, CAST(20000 AS DOUBLE) AS min_prior_real_abs FROM scored""",
    "anomaly_yearly": with_(LEDGER, INDEX, SCORED) + """
SELECT year, count(*) AS anomalies_count, round(sum(abs_change_real), 2) AS abs_change_sum,
       round(sum(CASE WHEN yoy_real_change > 0 THEN abs(yoy_real_change) ELSE 0 END), 2) AS abs_change_increase,
       round(sum(CASE WHEN yoy_real_change < 0 THEN abs(yoy_real_change) ELSE 0 END), 2) AS abs_change_decrease
FROM scored WHERE is_anomaly AND samtala2_canonical = 'HOME' GROUP BY year""",
    "series_totals": with_(
        LEDGER, INDEX, SCORED, "k AS (SELECT DISTINCT samtala0, samtala2_canonical FROM scored WHERE is_anomaly)"
    ) + """
SELECT year, a.samtala0 AS samtala0, a.samtala2_canonical AS samtala2_canonical,
       round(sum(actual_real), 2) AS actual_real_sum
FROM scored a JOIN k ON a.samtala0 = k.samtala0 AND a.samtala2_canonical = k.samtala2_canonical GROUP BY 1, 2, 3""",
    "anomaly_page": with_(
        LEDGER, INDEX, SCORED,
        """
hits AS (SELECT year, direction, anomaly_score, yoy_real_pct, yoy_real_change, actual_real, prior_real, abs_change_real,
                samtala0, samtala2_canonical FROM scored WHERE is_anomaly),
shown AS (SELECT * FROM hits ORDER BY anomaly_score DESC, abs_change_real DESC, year LIMIT 25
          OFFSET (SELECT CASE WHEN count(*) > 25 THEN 25 ELSE 0 END FROM hits)),
sums AS (SELECT year, samtala0, samtala2_canonical, sum(actual_real) AS s FROM scored GROUP BY 1, 2, 3)""",
        f"""
lists AS (SELECT samtala0, samtala2_canonical, string_agg(year || ':' || ({shown('s')}), ' ' ORDER BY year) AS l
          FROM sums GROUP BY 1, 2)""",
    ) + f"""
SELECT year, p.samtala0 AS samtala0, p.samtala2_canonical AS samtala2_canonical, direction,
       format('{{:.2f}}', anomaly_score) AS anomaly_score_fmt, {percent('yoy_real_pct * 100')} AS yoy_real_pct_fmt,
       {shown('yoy_real_change')} AS yoy_real_change_fmt, {shown('actual_real')} AS actual_real_fmt,
       {shown('prior_real')} AS prior_real_fmt, l AS year_totals
FROM shown p JOIN lists l ON l.samtala0 = p.samtala0 AND l.samtala2_canonical = p.samtala2_canonical""",
    "anomaly_export": with_(LEDGER, INDEX, SCORED) + """
SELECT year, samtala0, samtala2, direction, round(actual_real, 2) AS actual_real,
       round(anomaly_score, 6) AS anomaly_score
FROM scored WHERE is_anomaly AND direction = 'increase' AND samtala2_canonical = 'HOME'""",
    "anomaly_files": with_(LEDGER, INDEX, SCORED) + """
SELECT 'anomalies_yoy_all' AS file, count(*) AS rows FROM scored
UNION ALL SELECT 'anomalies_yoy_all_csv', count(*) FROM scored
UNION ALL SELECT 'anomalies_flagged', count(*) FROM scored WHERE is_anomaly
UNION ALL SELECT 'anomalies_flagged_csv', count(*) FROM scored WHERE is_anomaly
UNION ALL SELECT 'index_monthly_csv', count(*) FROM index_monthly
UNION ALL SELECT 'index_annual_csv', count(*) FROM index_annual""",
    "anomalies_ten_keys": with_(LEDGER, INDEX, scored(*TEN_KEYS)) + f"""
SELECT year, {', '.join(TEN_KEYS)}, round(actual_real, 2) AS actual_real, round(prior_real, 2) AS prior_real,
       series_year_count, direction, is_anomaly, round(anomaly_score, 4) AS anomaly_score FROM scored""",
    "anomaly_browse": with_(LEDGER, INDEX, scored(*TEN_KEYS), """
hits AS (SELECT *, abs_change_real AS size FROM scored WHERE direction = 'increase')""") + " UNION ALL ".join(
        f"""
SELECT '{asked}' AS parent, count(*) AS rows, round(coalesce(sum(size), 0), 0) AS size FROM hits WHERE {parent} = '{value}'"""
        for asked, parent, value in [
            ("samtala0", "samtala0", "NATION_7"), ("samtala1", "samtala1", "ASIA"), ("samtala2_canonical", "samtala2_canonical", "HOME"),
            ("samtala3", "samtala3", "O"), ("tegund0", "tegund0", "STANDARD"), ("tegund1", "tegund1", "F"), ("tegund2", "tegund2", "(missing)"),
            ("tegund3", "tegund3", "(missing)"), ("vm_nafn", "vm_nafn", "NATION_3"), ("vm_numer", "vm_numer", "VSK-000005"),
            ("unknown", "tegund0", "STANDARD"),
        ]
    ),
    "full_years": with_(LEDGER) + FULL,
    "wage_totals": with_(LEDGER) + f"""
SELECT samtala2_canonical, CAST(sum({WAGE}) AS DOUBLE) AS actual_sum, count(*) AS row_count FROM ledger
WHERE {LISTED} AND year = 1998 GROUP BY 1""",
    "wage_growth": with_(LEDGER, growth("samtala2_canonical", LISTED)) + """
SELECT samtala2_canonical, year, wage_sum, round(pct, 6) AS yoy_pct FROM grown""",
    "wage_growth_mean": with_(LEDGER, growth("samtala0", "TRUE")) + """
SELECT samtala0, round(avg(pct), 6) AS avg_increase_pct FROM grown WHERE pct IS NOT NULL GROUP BY 1""",
    "wage_growth_scope": with_(LEDGER, growth("", LISTED)) + """
SELECT round(avg(pct), 6) AS avg_increase_pct FROM grown""",
    "cost_totals": with_(
        LEDGER,
        f"""basis AS (SELECT samtala2_canonical, year, sum({WAGE}) AS w, sum({OTHER}) AS o FROM ledger
        WHERE {LISTED} AND year IS NOT NULL
        GROUP BY 1, 2, {', '.join(f"coalesce({c}, '')" for c in ['samtala0', *DETAIL])})""",
    ) + """
SELECT samtala2_canonical, year, CAST(sum(greatest(w, 0)) AS DOUBLE) AS wage_cost_sum,
       CAST(sum(greatest(o, 0)) AS DOUBLE) AS other_sum FROM basis GROUP BY 1, 2""",
    "wage_department_report": report("department", "samtala2_canonical", LISTED, ["samtala0", *DETAIL]),
    "wage_department_report_year": report(
        "department", "samtala2_canonical", LISTED, ["samtala0", *DETAIL], "AND year = 1999"
    ),
    "wage_total_row": report_total("samtala2_canonical", LISTED, ["samtala0", *DETAIL]),
    "wage_institution_report": report("institution", "samtala0", BUILDING, DETAIL),
    "wage_institution_total_row": report_total("samtala0", BUILDING, DETAIL, "AND year = 1999"),
    "institution_expansion": with_(LEDGER, cells("samtala0", BUILDING, DETAIL, "AND year = 1999")) + f"""
SELECT institution, CAST(actual_sum AS DOUBLE) AS actual_sum, row_count,
       CAST(wage_cost_sum AS DOUBLE) AS wage_cost_sum, CAST(other_sum AS DOUBLE) AS other_sum,
       round(CASE WHEN wage_cost_sum + other_sum <> 0 THEN CAST(wage_cost_sum AS DOUBLE)
             / (CAST(wage_cost_sum AS DOUBLE) + CAST(other_sum AS DOUBLE)) * 100 ELSE 0 END, 6) AS wage_share_pct
FROM (SELECT samtala0 AS institution, sum({WAGE}) AS actual_sum, count(*) AS row_count FROM ledger
      WHERE {BUILDING} AND year = 1999 GROUP BY 1) t LEFT JOIN cost ON grp = institution""",
    "report_display": "SELECT institution, "
    + ", ".join(
        [
            f"{shown('actual_sum')} AS actual_sum_fmt",
            f"{shown('other_sum')} AS other_sum_fmt",
            f"{percent('avg_increase_pct')} AS avg_increase_fmt",
            f"{percent('wage_share_pct')} AS wage_share_pct_fmt",
        ]
    )
    + " FROM (" + report("institution", "samtala0", BUILDING, DETAIL) + ")",
    "share_trend_department": trend("samtala2_canonical = 'BUILDING'"),
    "share_trend_institution": trend("samtala2_canonical = 'BUILDING' AND samtala0 = 'NATION_7'"),
    "wage_scope_yearly": with_(LEDGER) + f"""
SELECT year, CAST(sum(raun) AS DOUBLE) AS actual_sum FROM ledger
WHERE tegund0 = 'STANDARD' AND {LISTED} AND year IS NOT NULL GROUP BY year""",
    "wage_scope_yearly_department": with_(LEDGER) + f"""
SELECT year, CAST(sum(raun) AS DOUBLE) AS actual_sum FROM ledger
WHERE tegund0 = 'STANDARD' AND {LISTED} AND samtala2_canonical = 'BUILDING' AND samtala0 = 'NATION_7'
  AND year IS NOT NULL GROUP BY year""",
    "number_format": f"""
WITH lines AS (SELECT l_suppkey, l_linenumber, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS amount,
                      sum(l_quantity) AS quantity FROM lineitem GROUP BY 1, 2),
vals AS (SELECT l_suppkey, l_linenumber, quantity,
                CASE WHEN l_linenumber = 3 THEN NULL WHEN l_linenumber = 2 THEN CAST(round(amount, 0) AS DOUBLE)
                     ELSE -CAST(amount AS DOUBLE) END AS v FROM lines)
SELECT l_suppkey, l_linenumber, {shown('v')} AS number, {shown('quantity')} AS whole,
       CASE WHEN v IS NULL THEN '' ELSE regexp_replace(format('{{:,.2f}}', v), '0$', '') END AS grouped,
       {percent('v / 100000')} AS percent, format('{{:.2f}}', coalesce(v / 1000, 0)) AS score FROM vals""",
    "mixed_sort": with_(
        LEDGER,
        f"""b AS (SELECT samtala0 AS child_value, CAST(sum(raun) AS DOUBLE) AS s FROM ledger
        WHERE tegund0 = 'STANDARD' AND samtala0 IS NOT NULL GROUP BY 1
        ORDER BY abs(sum(raun)) DESC, 1 LIMIT 500),
        c AS (SELECT child_value, length(child_value) = 8 AS word,
                     CASE WHEN length(child_value) <> 8 THEN s END AS s,
                     CASE WHEN length(child_value) = 8 THEN child_value ELSE {shown('s')} END AS cell FROM b)""",
    ) + """
SELECT CAST(row_number() OVER (ORDER BY word, s, lower(cell), cell, child_value) AS INTEGER) AS position, child_value, cell FROM c""",
    "entity_keys": with_(LEDGER) + r"""
SELECT DISTINCT regexp_replace(trim(vm_numer), '\D+', '', 'g') AS vm_number FROM ledger WHERE trim(vm_numer) <> ''""",
    "entity_names": with_(PAGE) + "SELECT page_id, CASE WHEN name <> '' THEN name END AS name FROM plain",
    "entity_status": with_(STATUS) + "SELECT vm_number, status, name, url FROM entities",
    "entity_resolve": with_(STATUS) + """
SELECT e.vm_number, CASE WHEN page_id < 50 THEN 'ok' ELSE status END AS status,
       CASE WHEN page_id < 50 THEN 'known' ELSE name END AS name,
       CASE WHEN page_id < 50 THEN p.url ELSE e.url END AS url
FROM entities e JOIN pages p ON CAST(p.page_id AS VARCHAR) = e.vm_number""",
    "entity_table": with_(STATUS) + "SELECT vm_number, status, name, url, CAST(0 AS INTEGER) AS added_last FROM entities",
    "entity_captures": with_(STATUS) + """
SELECT vm_number, status, name, url, (SELECT count(*) FILTER (WHERE page_id < 10) || ',' || count(*) FILTER (WHERE page_id >= 10) || ',0' FROM pages) AS added
FROM entities""",
    "link_harvest": with_(LINKS) + "SELECT page_id, position, link, filename FROM harvest",
    "link_first_page": with_(LINKS) + "SELECT link, min(page_id) AS page_id FROM harvest GROUP BY link",
    "manifest_status": with_(LINKS) + """
SELECT page_id, position, link AS url, filename,
       CASE WHEN had IS NOT NULL OR (has IS NOT NULL AND turn > 1) THEN 'skipped'
            WHEN has IS NOT NULL THEN 'downloaded' ELSE 'error: file has not landed' END AS status,
       CAST(CASE WHEN had IS NOT NULL THEN had ELSE coalesce(has, 0) END AS BIGINT) AS bytes FROM ranked""",
    "manifest_summary": with_(LINKS) + """
SELECT count(*) AS count, count(*) FILTER (WHERE has IS NULL) AS errors,
       CAST(coalesce(sum(has), 0) AS BIGINT) AS bytes FROM ranked""",
    "manifest_roundtrip": with_(LINKS) + """
SELECT 'http://data.example.org/' AS dataset_url, (SELECT count(*) FROM ranked) AS count, link AS url, filename,
       CASE WHEN had IS NOT NULL OR (has IS NOT NULL AND turn > 1) THEN 'skipped'
            WHEN has IS NOT NULL THEN 'downloaded' ELSE 'error: file has not landed' END AS status,
       CAST(CASE WHEN had IS NOT NULL THEN had ELSE coalesce(has, 0) END AS BIGINT) AS bytes,
       CAST(NULL AS VARCHAR) AS etag FROM ranked""",
    "csv_ingest": ingested(
        "TRUE",
        "CASE WHEN ledger.year < 1999 THEN 'http://data.example.org/download/ledger_' || (ledger.year + 20) || '12.csv' END",
    ),
    "ingest_metadata": with_(LEDGER) + """
SELECT 'ledger_' || (year + 20) || '12.csv' AS file, count(*) AS rows,
       CAST(CASE WHEN year < 1999 THEN 10 ELSE 9 END AS INTEGER) AS columns FROM ledger GROUP BY year""",
    "ingest_columns": """
WITH early AS (SELECT unnest(['samtala0', 'samtala2', 'samtala3', 'tegund0', 'vm_numer', 'raun']) AS original, TRUE AS is_early),
late AS (SELECT unnest(['Samtala0', 'Samtala2', 'Tegund0', 'VM númer', 'Raun']) AS original, FALSE AS is_early),
fixed AS (SELECT unnest(['source_file', 'source_url', 'year', 'ingested_at']) AS original),
years AS (SELECT DISTINCT CAST(year(o_orderdate) AS INTEGER) AS year FROM lineitem JOIN orders ON o_orderkey = l_orderkey)
SELECT 'ledger_' || (year + 20) || '12.csv' AS file, original, lower(replace(replace(original, ' ', '_'), 'ú', 'u')) AS final
FROM years JOIN (SELECT * FROM early UNION ALL SELECT * FROM late) ON is_early = (year < 1999)
UNION ALL SELECT 'ledger_' || (year + 20) || '12.csv', original, original FROM years, fixed""",
    "clashing_headers": """
SELECT unnest(['raun', 'raun_3', 'raun_4', 'raun_2']) AS name,
       unnest([CAST(sum(l_orderkey) AS BIGINT), CAST(sum(l_linenumber) AS BIGINT), CAST(sum(l_suppkey) AS BIGINT), CAST(sum(l_partkey) AS BIGINT)]) AS total
FROM lineitem""",
    "ledger_update": with_(LEDGER, """
kept AS (SELECT * FROM ledger WHERE year <> 1996 AND (year <> 1995 OR tegund0 = 'STANDARD'))""") + f"""
SELECT samtala2_canonical, CAST(sum({WAGE}) AS DOUBLE) AS actual_sum, count(*) AS row_count,
       '7/0 0/0 1/1' AS updates, (SELECT count(*) FROM kept) AS all_rows FROM kept GROUP BY 1""",
    "ledger_store_roundtrip": with_(LEDGER) + """
SELECT year, samtala2_family, count(*) AS rows, CAST(sum(raun) AS DOUBLE) AS total FROM ledger GROUP BY 1, 2""",
    "landing_ingest": ingested("TRUE", "CAST(NULL AS VARCHAR)"),
    "landing_log": with_(LEDGER) + """
SELECT 'ledger_' || (year + 20) || '12.csv' AS source_file, count(*) AS rows,
       CAST(CASE WHEN year < 1999 THEN 10 ELSE 9 END AS INTEGER) AS columns FROM ledger GROUP BY year""",
    "csv_records": """
SELECT doc_id, source, sha256(text) AS text_sha256, 'texts_202012.csv' AS source_file, 2020 AS year, 12 AS period_month
FROM documents""",
}
