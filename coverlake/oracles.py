"""DuckDB oracle SQL.

``FIXTURE_SQL`` restates every fixture view of ``coverlake.sources.fixtures``
as a DuckDB CTE over the pre-registered driver tables; ``with_fixtures``
prefixes a query with the CTEs it needs.  DuckDB notes: ``/`` is float
division and ``//`` integer division; casting a double to an integer rounds
(Spark truncates), so integer parts are taken with ``//``.
"""

from __future__ import annotations

import re

D0 = "DATE '1995-01-01'"

FIXTURE_SQL: dict[str, str] = {
    "quotes": f"""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
       CAST(l_partkey % 50 AS INTEGER) AS secid,
       CAST(l_shipdate AS DATE) AS date,
       CAST(l_shipdate AS DATE) + CAST((l_orderkey*37 + l_partkey*11 + l_linenumber*101) % 800 AS INTEGER) AS exdate,
       CAST(l_shipdate AS DATE) - CAST((l_orderkey + l_linenumber) % 6 AS INTEGER) AS last_date,
       CASE WHEN l_suppkey % 40 = 0 THEN CAST(0 AS DOUBLE) ELSE l_discount*100 + l_linenumber END AS best_bid,
       l_discount*100 + l_linenumber + CAST(0.05 AS DOUBLE) + l_tax AS best_offer,
       CAST(l_quantity - 2 AS DOUBLE) AS volume,
       CAST((l_orderkey + l_suppkey) % 25 AS DOUBLE) AS open_interest,
       CASE WHEN l_returnflag = 'N' THEN 'P' ELSE 'C' END AS cp_flag,
       CASE WHEN l_partkey % 97 = 0 THEN NULL ELSE CAST(0.1 AS DOUBLE) + CAST(0.018 AS DOUBLE)*l_quantity END AS impl_volatility,
       CAST(1000.0*(40 + (l_partkey*7 + l_suppkey*13 + l_linenumber*29) % 120) AS DOUBLE) AS strike_price
FROM lineitem""",
    "prices": f"""
SELECT secid, date,
       60.0 + secid + 10*sin(datediff('day', {D0}, date)/90.0) AS close
FROM (SELECT DISTINCT CAST(l_partkey % 50 AS INTEGER) AS secid, CAST(l_shipdate AS DATE) AS date
      FROM lineitem WHERE l_partkey % 31 <> 0) k""",
    "zero_curve": f"""
SELECT date, days,
       CASE WHEN (n + days) % 41 = 0 THEN NULL ELSE 1.0 + days/400.0 + (n % 13)/10.0 END AS rate
FROM (SELECT d.date, CAST(t.days AS INTEGER) AS days, datediff('day', {D0}, d.date) AS n
      FROM (SELECT DISTINCT CAST(l_shipdate AS DATE) AS date FROM lineitem
            WHERE CAST(l_shipdate AS DATE) < DATE '2001-09-01') d,
           (SELECT unnest([10, 30, 60, 91, 152, 182, 273, 365, 547]) AS days) t) g""",
    "membership": f"""
SELECT CAST(p_partkey % 40 AS INTEGER) AS permno,
       {D0} + CAST((p_partkey*37) % 1800 AS INTEGER) AS start,
       {D0} + CAST((p_partkey*37) % 1800 AS INTEGER) + CAST(200 + (p_partkey*53) % 900 AS INTEGER) AS ending
FROM part""",
    "id_link": f"""
SELECT CAST(p_partkey % 50 AS INTEGER) AS secid, CAST(p_partkey % 40 AS INTEGER) AS permno,
       {D0} + CAST((p_partkey*17) % 700 AS INTEGER) AS sdate,
       {D0} + CAST(1500 + (p_partkey*41) % 1100 AS INTEGER) AS edate
FROM part""",
    "predictions": """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, date, seed_id, y_true, S, sigma, tau, r,
       round(y_true + 0.0012*((l_suppkey*7 + l_orderkey*3) % 21 - 15), 9) AS lb,
       round(y_true + 0.0012*((l_partkey*5 + l_orderkey) % 13 - 6), 9) AS pp,
       round(y_true + 0.0012*((l_partkey*3 + l_orderkey*5) % 25 - 6), 9) AS ub
FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_shipdate AS DATE) AS date,
             CAST(l_linenumber AS INTEGER) AS seed_id,
             round(l_extendedprice/100000.0, 9) AS y_true,
             CAST(0.5 AS DOUBLE) + CAST(0.02 AS DOUBLE)*l_quantity AS S,
             CAST(0.1 AS DOUBLE) + CAST(0.009 AS DOUBLE)*(l_partkey % 100) AS sigma,
             (14 + (l_orderkey*37 + l_partkey*11) % 490)/252.0 AS tau,
             CAST(0.001 AS DOUBLE) + CAST(0.6 AS DOUBLE)*l_tax AS r
      FROM lineitem) b""",
    "grid_errors": """
SELECT CAST(cell // 800 AS INTEGER) AS sample_id,
       CASE WHEN (cell // 400) % 2 = 0 THEN 'proper_train' ELSE 'train' END AS set_type,
       CAST(cell % 400 AS INTEGER) AS grid_no,
       y_true,
       round(y_true + 0.0001*((l_orderkey + l_partkey*3) % 41 - 20), 9) AS y_pred
FROM (SELECT l_orderkey, l_partkey, (l_orderkey*7919 + l_partkey*104729 + l_suppkey*31) % 4800 AS cell,
             round(l_extendedprice/100000.0, 9) AS y_true FROM lineitem) b""",
    "index_list": f"""
SELECT CAST(p_partkey AS INTEGER) AS permno,
       {D0} + CAST((p_partkey*37) % 1800 AS INTEGER) AS start,
       {D0} + CAST((p_partkey*37) % 1800 AS INTEGER) + CAST(200 + (p_partkey*53) % 900 AS INTEGER) AS ending
FROM part""",
    "monthly_returns": """
SELECT CAST(l_partkey AS INTEGER) AS permno, last_day(CAST(l_shipdate AS DATE)) AS date,
       round(avg(l_discount), 9) AS ret
FROM lineitem GROUP BY 1, 2""",
    "stock_names": f"""
SELECT CAST(p_partkey AS INTEGER) AS permno, p_name AS comnam,
       CASE WHEN p_partkey % 17 = 0 THEN NULL ELSE 'N' || CAST((p_partkey*7919) % 100000000 AS VARCHAR) END AS ncusip,
       CAST(10 + p_partkey % 2 AS INTEGER) AS shrcd,
       CAST(1 + p_partkey % 3 AS INTEGER) AS exchcd,
       CAST(p_size*100 AS INTEGER) AS hsiccd,
       CASE WHEN p_partkey % 23 = 0 THEN NULL ELSE p_brand END AS ticker,
       {D0} + CAST((p_partkey*29) % 1500 AS INTEGER) AS namedt,
       CASE WHEN p_partkey % 5 = 0 THEN NULL
            ELSE {D0} + CAST((p_partkey*29) % 1500 AS INTEGER) + CAST(300 + (p_partkey*31) % 1200 AS INTEGER) END AS nameendt
FROM part""",
    "ccm_links": f"""
SELECT lpad(CAST(p_partkey % 997 AS VARCHAR), 6, '0') AS gvkey,
       '0' || CAST(j + 1 AS VARCHAR) AS iid,
       CAST(p_partkey AS INTEGER) AS permno,
       (['LC', 'LU', 'LS', 'NR', 'NU'])[CAST((p_partkey + j) % 5 + 1 AS INTEGER)] AS linktype,
       (['P', 'C', 'J'])[CAST((p_partkey*3 + j) % 3 + 1 AS INTEGER)] AS linkprim,
       {D0} + CAST((p_partkey*13 + j*900) % 2000 AS INTEGER) AS linkdt,
       CASE WHEN (p_partkey + j) % 4 = 0 THEN NULL
            ELSE {D0} + CAST((p_partkey*13 + j*900) % 2000 AS INTEGER) + CAST(400 + (p_partkey*19) % 1000 AS INTEGER) END AS linkenddt
FROM part, (SELECT unnest([0, 1]) AS j) jj""",
    "company_names": """
SELECT lpad(CAST(p_partkey % 997 AS VARCHAR), 6, '0') AS gvkey, min(p_brand) AS conm,
       min(p_type) AS tic, lpad(CAST(max(p_partkey) AS VARCHAR), 9, '0') AS cusip,
       lpad(CAST(min(p_partkey) AS VARCHAR), 10, '0') AS cik, CAST(max(p_size)*10 AS INTEGER) AS sic,
       CAST(max(p_size)*1000 + min(p_size) AS INTEGER) AS naics,
       CAST(10000000 + max(p_size)*100 AS VARCHAR) AS gsubind, CAST(100000 + max(p_size) AS VARCHAR) AS gind
FROM part GROUP BY 1""",
}


def with_fixtures(sql: str, *extra: str) -> str:
    """Prefix ``sql`` with the fixture CTEs it mentions (plus ``extra``)."""
    needed = [n for n in FIXTURE_SQL if re.search(rf"\b{n}\b", sql) or n in extra]
    if not needed:
        return sql
    body = sql.strip()
    ctes = ",\n".join(f"{n} AS ({FIXTURE_SQL[n].strip()})" for n in needed)
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"
