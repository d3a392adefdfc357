"""Oracle SQL: every registered query as one DuckDB statement over the raw driver tables.

The adapter tables of ``salesengine.sources.adapters`` are restated here as
CTEs; ``sql(body, *views)`` prepends the ones a query needs.
"""

from __future__ import annotations

from salesengine.operators.bootstrap import bootstrap_ci_sql
from salesengine.operators.forecast import arima_111_exact_sql, arima_111_forecast_sql
from salesengine.operators.histogram import histogram_sql

# adapter tables as SQL (FIXTURES.md §2); same mapping as sources/adapters.py
VIEWS = {
    "soh": """SELECT o_orderkey AS SalesOrderID, o_custkey AS CustomerID, CAST(o_orderdate AS DATE) AS OrderDate,
        CAST(o_totalprice AS DECIMAL(19,4)) AS TotalDue, o_orderkey % 25 AS BillToAddressID,
        CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN NULL ELSE o_custkey % 10 END AS SalesPersonID
        FROM orders""",
    "soht": """SELECT soh.*, c_nationkey AS TerritoryID FROM soh JOIN customer ON customer.c_custkey = soh.CustomerID""",
    "sod": """SELECT l_orderkey AS SalesOrderID, l_linenumber AS SalesOrderDetailID, l_partkey AS ProductID,
        CAST(l_extendedprice AS DECIMAL(19,4)) AS Gross,
        CAST(l_extendedprice AS DECIMAL(19,4)) * (1 - CAST(l_discount AS DECIMAL(9,4))) AS LineTotal
        FROM lineitem""",
    "prod": "SELECT p_partkey AS ProductID, p_name AS Name FROM part",
    "cust": "SELECT c_custkey AS CustomerID FROM customer",
    "addr": "SELECT n_nationkey AS AddressID, n_name AS City, n_regionkey AS StateProvinceID FROM nation",
    "terr": "SELECT n_nationkey AS TerritoryID, n_name AS Name FROM nation",
    "inv": """SELECT l_partkey AS ProductID, l_suppkey AS LocationID,
        CAST(TRUNC(SUM(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0.0 END)) AS INTEGER) AS Quantity
        FROM lineitem GROUP BY l_partkey, l_suppkey""",
    "vend": "SELECT s_suppkey AS BusinessEntityID, s_name AS Name FROM supplier",
    "pv": """SELECT l_suppkey AS BusinessEntityID, l_partkey AS ProductID,
        CASE WHEN count(d) > 0 THEN CAST(sum(d) AS BIGINT) // count(d) END AS AverageLeadTime
        FROM (SELECT l_suppkey, l_partkey, CAST(l_shipdate AS DATE) - CAST(o_orderdate AS DATE) AS d
              FROM lineitem JOIN orders ON l_orderkey = o_orderkey) x
        GROUP BY l_suppkey, l_partkey""",
    "po": """SELECT o_orderkey AS PurchaseOrderID, f.VendorID, CAST(o_orderdate AS DATE) AS OrderDate,
        CAST(f.ship_ts AS DATE) AS ShipDate, CAST(o_totalprice AS DECIMAL(19,4)) AS TotalDue
        FROM orders LEFT JOIN (SELECT l_orderkey, MIN(l_suppkey) AS VendorID, MIN(l_shipdate) AS ship_ts
                               FROM lineitem GROUP BY l_orderkey) f ON f.l_orderkey = o_orderkey""",
    "person": """SELECT s_suppkey AS BusinessEntityID, s_name AS FirstName, n_name AS LastName
        FROM supplier JOIN nation ON n_nationkey = s_nationkey""",
    "emp": """SELECT s_suppkey AS BusinessEntityID, CAST(FLOOR(s_acctbal) AS INTEGER) % 100 AS VacationHours,
        CAST(s_suppkey % 80 AS INTEGER) AS SickLeaveHours FROM supplier""",
    "edh": """SELECT s_suppkey AS BusinessEntityID, s_nationkey AS DepartmentID FROM supplier
        UNION ALL SELECT s_suppkey, (s_nationkey + 1) % 25 FROM supplier WHERE s_suppkey % 4 = 0""",
    "dept": "SELECT n_nationkey AS DepartmentID, n_name AS Name FROM nation",
    "feedback": """SELECT event_id AS FeedbackID, user_id AS CustomerID, CAST(ts AS DATE) AS FeedbackDate,
        props AS Comments FROM events""",
}
# views that read other views
_DEPENDS = {"soht": ("soh",)}

AS_OF = "(SELECT CAST(max(o_orderdate) AS DATE) FROM orders)"


def since(years: int = 1) -> str:
    return f"CAST({AS_OF} - INTERVAL {years} YEAR AS DATE)"


def int_avg(x: str) -> str:
    return f"(CASE WHEN count({x}) > 0 THEN CAST(sum({x}) AS BIGINT) // count({x}) END)"


def money_avg(x: str) -> str:
    return money_avg_from(f"sum({x})", f"count({x})")


def money_avg_from(total: str, n: str) -> str:
    s = f"CAST(({total}) * 10000 AS HUGEINT)"
    return (f"(CASE WHEN ({n}) > 0 THEN CAST((CASE WHEN {s} < 0 THEN -1 ELSE 1 END) * "
            f"((2 * abs({s}) + ({n})) // (2 * ({n}))) AS DOUBLE) / 10000.0 END)")


def sql(body: str, *views: str, extra: dict[str, str] | None = None) -> str:
    names: list[str] = []

    def add(v):
        for d in _DEPENDS.get(v, ()):
            add(d)
        if v not in names:
            names.append(v)

    for v in views:
        add(v)
    ctes = [f"{v} AS ({VIEWS[v]})" for v in names]
    ctes += [f"{k} AS ({v})" for k, v in (extra or {}).items()]
    return ("WITH " + ",\n".join(ctes) + "\n" if ctes else "") + body


# -- business queries (B) --------------------------------------------------

B01 = sql(f"""SELECT p.Name AS ProductName, CAST(SUM(sod.LineTotal) AS DOUBLE) AS TotalSales
FROM sod JOIN soh ON sod.SalesOrderID = soh.SalesOrderID JOIN prod p ON sod.ProductID = p.ProductID
WHERE soh.OrderDate >= {since(1)}
GROUP BY p.Name ORDER BY TotalSales DESC, ProductName""", "sod", "soh", "prod")

B02 = sql("""SELECT CAST(year(OrderDate) AS BIGINT) AS "Year", CAST(SUM(TotalDue) AS DOUBLE) AS TotalSales
FROM soh GROUP BY 1 ORDER BY 1""", "soh")

B03 = sql("""SELECT CAST(year(OrderDate) AS BIGINT) AS "Year", CAST(month(OrderDate) AS BIGINT) AS "Month",
CAST(SUM(TotalDue) AS DOUBLE) AS TotalSales FROM soh GROUP BY 1, 2 ORDER BY 1, 2""", "soh")

B04 = sql("""SELECT p.ProductID, p.Name AS ProductName, CAST(SUM(sod.LineTotal) AS DOUBLE) AS TotalSales
FROM sod JOIN prod p ON sod.ProductID = p.ProductID GROUP BY p.ProductID, p.Name
ORDER BY TotalSales DESC, p.ProductID""", "sod", "prod")

B05 = sql("""SELECT c.CustomerID, a.City, a.StateProvinceID, COUNT(soh.SalesOrderID) AS OrderCount,
CAST(SUM(soh.TotalDue) AS DOUBLE) AS TotalSpent
FROM cust c JOIN soh ON c.CustomerID = soh.CustomerID JOIN addr a ON soh.BillToAddressID = a.AddressID
GROUP BY c.CustomerID, a.City, a.StateProvinceID""", "cust", "soh", "addr")

B07 = sql("""SELECT c.CustomerID, COUNT(DISTINCT soh.SalesOrderID) AS RepeatPurchaseCount,
CAST(SUM(soh.TotalDue) AS DOUBLE) AS TotalSpent, MAX(soh.OrderDate) AS LatestPurchaseDate
FROM cust c JOIN soh ON c.CustomerID = soh.CustomerID GROUP BY c.CustomerID""", "cust", "soh")


def _b08(sales_from: str) -> str:
    return f"""SELECT p.ProductID, p.Name AS ProductName, pi.Quantity AS InventoryQty,
COUNT(s.SalesOrderDetailID) AS SalesCount
FROM prod p JOIN inv pi ON p.ProductID = pi.ProductID LEFT JOIN {sales_from} s ON p.ProductID = s.ProductID
GROUP BY p.ProductID, p.Name, pi.Quantity
HAVING (pi.Quantity = 0 AND COUNT(s.SalesOrderDetailID) = 0) OR pi.Quantity > 100"""


B08 = sql(_b08("sod"), "prod", "inv", "sod")
B08_RECENT = sql(_b08(f"(SELECT sod.* FROM sod JOIN soh ON sod.SalesOrderID = soh.SalesOrderID "
                      f"WHERE soh.OrderDate >= {since(1)})"), "prod", "inv", "sod", "soh")

B09 = sql(f"""SELECT pv.BusinessEntityID AS VendorID, v.Name AS VendorName,
{int_avg('pv.AverageLeadTime')} AS AvgLeadTimeDays
FROM pv JOIN vend v ON pv.BusinessEntityID = v.BusinessEntityID GROUP BY pv.BusinessEntityID, v.Name""",
          "pv", "vend")

_VENDOR_MEASURES = f"""COUNT(po.PurchaseOrderID) AS PurchaseOrders, {money_avg('po.TotalDue')} AS AvgOrderCost,
{int_avg('(po.ShipDate - po.OrderDate)')} AS AvgDeliveryDay"""

B10 = sql(f"""SELECT pv.BusinessEntityID AS VendorID, v.Name AS VendorName, {_VENDOR_MEASURES}
FROM vend v JOIN pv ON v.BusinessEntityID = pv.BusinessEntityID JOIN po ON pv.ProductID = po.PurchaseOrderID
GROUP BY pv.BusinessEntityID, v.Name""", "vend", "pv", "po")

B11 = sql(f"""SELECT v.BusinessEntityID AS VendorID, v.Name AS VendorName, {_VENDOR_MEASURES}
FROM vend v JOIN po ON po.VendorID = v.BusinessEntityID GROUP BY v.BusinessEntityID, v.Name""", "vend", "po")

_PROFIT = """CAST(SUM(sod.LineTotal) AS DOUBLE) AS TotalSales, CAST(SUM(sod.Gross) AS DOUBLE) AS TotalCost,
CAST(SUM(sod.LineTotal) - SUM(sod.Gross) AS DOUBLE) AS Profit"""
B12 = sql(f"""SELECT p.ProductID, p.Name AS ProductName, {_PROFIT}
FROM prod p JOIN sod ON p.ProductID = sod.ProductID GROUP BY p.ProductID, p.Name""", "prod", "sod")
B13 = sql(f"""SELECT sod.ProductID, p.Name AS ProductName, {_PROFIT}
FROM sod JOIN prod p ON sod.ProductID = p.ProductID GROUP BY sod.ProductID, p.Name""", "prod", "sod")

_TERR_JOIN = """FROM soht soh JOIN terr st ON soh.TerritoryID = st.TerritoryID
JOIN sod ON soh.SalesOrderID = sod.SalesOrderID JOIN prod p ON sod.ProductID = p.ProductID"""
B14 = sql(f"""SELECT st.Name AS TerritoryName, {money_avg('soh.TotalDue')} AS AvgSales,
p.Name AS BestSellingProduct, CAST(MAX(soh.TotalDue) AS DOUBLE) AS MaxSale
{_TERR_JOIN} GROUP BY st.Name, p.Name""", "soht", "terr", "sod", "prod")
B15 = sql(f"""SELECT TerritoryName, BestSellingProduct, ProductSales FROM (
  SELECT st.Name AS TerritoryName, p.Name AS BestSellingProduct, CAST(SUM(sod.LineTotal) AS DOUBLE) AS ProductSales,
         row_number() OVER (PARTITION BY st.Name ORDER BY SUM(sod.LineTotal) DESC, p.Name) AS rn
  {_TERR_JOIN} GROUP BY st.Name, p.Name) r WHERE rn = 1""", "soht", "terr", "sod", "prod")

B16 = sql("""SELECT p.ProductID, p.Name AS ProductName, pi.Quantity AS InventoryQty,
COUNT(sod.SalesOrderDetailID) AS SalesCount
FROM prod p JOIN inv pi ON p.ProductID = pi.ProductID JOIN sod ON p.ProductID = sod.ProductID
GROUP BY p.ProductID, p.Name, pi.Quantity HAVING pi.Quantity < 10""", "prod", "inv", "sod")

B18 = sql("""SELECT soh.SalesPersonID, p.FirstName, p.LastName, COUNT(soh.SalesOrderID) AS TotalOrders,
CAST(SUM(soh.TotalDue) AS DOUBLE) AS TotalSales
FROM soh JOIN person p ON soh.SalesPersonID = p.BusinessEntityID
GROUP BY soh.SalesPersonID, p.FirstName, p.LastName""", "soh", "person")

B19 = sql(f"""SELECT edh.DepartmentID, d.Name AS DepartmentName, COUNT(e.BusinessEntityID) AS TotalEmployees,
{int_avg('e.VacationHours')} AS AvgVacationHours, {int_avg('e.SickLeaveHours')} AS AvgSickLeaveHours
FROM edh JOIN emp e ON edh.BusinessEntityID = e.BusinessEntityID JOIN dept d ON edh.DepartmentID = d.DepartmentID
GROUP BY edh.DepartmentID, d.Name""", "edh", "emp", "dept")


# -- chart data (C) --------------------------------------------------------


_SEG = """SELECT c.CustomerID, a.City, a.StateProvinceID, COUNT(soh.SalesOrderID) AS OrderCount,
SUM(soh.TotalDue) AS TotalSpent
FROM cust c JOIN soh ON c.CustomerID = soh.CustomerID JOIN addr a ON soh.BillToAddressID = a.AddressID
GROUP BY c.CustomerID, a.City, a.StateProvinceID"""
_RET = """SELECT c.CustomerID, COUNT(DISTINCT soh.SalesOrderID) AS RepeatPurchaseCount,
SUM(soh.TotalDue) AS TotalSpent, MAX(soh.OrderDate) AS LatestPurchaseDate
FROM cust c JOIN soh ON c.CustomerID = soh.CustomerID GROUP BY c.CustomerID"""
_MONTHLY_UNITS = """SELECT CAST(year(OrderDate) AS BIGINT) AS "Year", CAST(month(OrderDate) AS BIGINT) AS "Month",
CAST(SUM(TotalDue) * 10000 AS DECIMAL(38,0)) AS x FROM soh GROUP BY 1, 2"""


def _nest(q: str) -> str:
    """A statement with its own WITH clause, as the body of an outer one."""
    return f"SELECT * FROM ({q}) nested"


C01 = B01
C02 = sql(f"""SELECT mean."Year", MeanMonthlySales, Months, CiLow, CiHigh FROM mean JOIN ci ON ci."Year" = mean."Year" """,
          "soh", extra={
              "m": _MONTHLY_UNITS,
              "mean": """SELECT "Year", CAST(sum(x) AS DOUBLE) / CAST(count(x) AS DOUBLE) / 10000.0 AS MeanMonthlySales,
                         count(x) AS Months FROM m GROUP BY 1""",
              "ci": bootstrap_ci_sql('SELECT "Year" AS g, "Month" AS r, CAST(x AS BIGINT) AS x FROM m', "Year",
                                     scale=10000.0),
          })
C03 = sql("""SELECT make_date(CAST(year(OrderDate) AS BIGINT), CAST(month(OrderDate) AS BIGINT), 1) AS "Date",
CAST(SUM(TotalDue) AS DOUBLE) AS TotalSales FROM soh GROUP BY 1 ORDER BY 1""", "soh")
C04 = B04.replace("ORDER BY TotalSales DESC, p.ProductID", "ORDER BY TotalSales DESC, p.ProductID LIMIT 10")
C05 = sql("""SELECT * FROM (SELECT p.ProductID, p.Name AS ProductName, CAST(SUM(sod.LineTotal) AS DOUBLE) AS TotalSales
FROM sod JOIN prod p ON sod.ProductID = p.ProductID GROUP BY p.ProductID, p.Name
ORDER BY TotalSales ASC, p.ProductID DESC LIMIT 10) b""", "sod", "prod")
C06 = sql("""SELECT CustomerID, OrderCount, CAST(TotalSpent AS DOUBLE) AS TotalSpent, StateProvinceID FROM seg""",
          "cust", "soh", "addr", extra={"seg": _SEG})
C07 = sql("""SELECT StateProvinceID, CAST(SUM(TotalSpent) AS DOUBLE) / CAST(COUNT(TotalSpent) AS DOUBLE) AS AvgTotalSpent
FROM seg GROUP BY StateProvinceID""", "cust", "soh", "addr", extra={"seg": _SEG})
C08 = sql("""SELECT StateProvinceID, CAST(SUM(OrderCount) AS DOUBLE) / CAST(COUNT(OrderCount) AS DOUBLE) AS AvgOrderCount
FROM seg GROUP BY StateProvinceID""", "cust", "soh", "addr", extra={"seg": _SEG})
C09 = sql("""SELECT StateProvinceID, COUNT(*) AS SegmentRows, COUNT(DISTINCT CustomerID) AS DistinctCustomers
FROM seg GROUP BY StateProvinceID""", "cust", "soh", "addr", extra={"seg": _SEG})
_TOP20 = "SELECT City, COUNT(*) AS CustomerRows FROM seg GROUP BY City ORDER BY CustomerRows DESC, City LIMIT 20"
C10 = sql(_TOP20, "cust", "soh", "addr", extra={"seg": _SEG})
C11 = sql("""SELECT City, COUNT(*) AS CustomerRows FROM seg WHERE City IN (SELECT City FROM top20) GROUP BY City""",
          "cust", "soh", "addr", extra={"seg": _SEG, "top20": _TOP20})
C12 = sql(_nest(histogram_sql("SELECT CAST(RepeatPurchaseCount AS DOUBLE) AS x FROM ret")), "cust", "soh",
          extra={"ret": _RET})
C13 = sql(_nest(histogram_sql("SELECT CAST(TotalSpent AS DOUBLE) AS x FROM ret")), "cust", "soh", extra={"ret": _RET})
C14 = sql(_nest(histogram_sql("SELECT CAST(LatestPurchaseDate - DATE '1970-01-01' AS DOUBLE) AS x FROM ret")), "cust", "soh",
          extra={"ret": _RET})
C15 = B12 + " ORDER BY Profit DESC, p.ProductID LIMIT 10"
_B14_ROWS = f"""SELECT st.Name AS TerritoryName, p.Name AS BestSellingProduct,
CAST(round({money_avg('soh.TotalDue')} * 10000) AS BIGINT) AS x
{_TERR_JOIN} GROUP BY st.Name, p.Name"""
_B15_ROWS = f"""SELECT TerritoryName, BestSellingProduct FROM (
  SELECT st.Name AS TerritoryName, p.Name AS BestSellingProduct,
         row_number() OVER (PARTITION BY st.Name ORDER BY SUM(sod.LineTotal) DESC, p.Name) AS rn
  {_TERR_JOIN} GROUP BY st.Name, p.Name) r WHERE rn = 1"""
C16 = sql("""SELECT mean.TerritoryName, MeanAvgSales, CiLow, CiHigh, lab.BestSellingProduct AS Label
FROM mean JOIN ci ON ci.TerritoryName = mean.TerritoryName LEFT JOIN lab ON lab.TerritoryName = mean.TerritoryName""",
          "soht", "terr", "sod", "prod", extra={
              "rows_": _B14_ROWS,
              "mean": """SELECT TerritoryName, CAST(sum(x) AS DOUBLE) / CAST(count(x) AS DOUBLE) / 10000.0 AS MeanAvgSales
                         FROM rows_ GROUP BY TerritoryName""",
              "ci": bootstrap_ci_sql("SELECT TerritoryName AS g, BestSellingProduct AS r, x FROM rows_",
                                     "TerritoryName", scale=10000.0),
              "lab": _B15_ROWS,
          })


_SERIES = """SELECT 'ALL' AS k, CAST(date_trunc('month', OrderDate) AS DATE) AS period, CAST(SUM(TotalDue) AS DOUBLE) AS v
  FROM soh GROUP BY 2
UNION ALL
SELECT st.Name AS k, CAST(date_trunc('month', OrderDate) AS DATE) AS period, CAST(SUM(TotalDue) AS DOUBLE) AS v
  FROM soht JOIN terr st ON soht.TerritoryID = st.TerritoryID
  GROUP BY soht.TerritoryID, st.Name, 2
UNION ALL
SELECT c.c_mktsegment AS k, CAST(date_trunc('month', OrderDate) AS DATE) AS period, CAST(SUM(TotalDue) AS DOUBLE) AS v
  FROM soh JOIN customer c ON c.c_custkey = soh.CustomerID
  WHERE c.c_mktsegment IS NOT NULL GROUP BY c.c_mktsegment, 2"""
B17 = sql("SELECT k AS SeriesKey, Step, ForecastDate, Forecast, Phi, Theta, Fit FROM fc", "soht", "terr", "soh",
          extra={"fc": arima_111_forecast_sql(_SERIES)})
B17_EXACT = sql("SELECT k AS SeriesKey, Step, ForecastDate, Forecast, Phi, Theta, Fit FROM fc", "soht", "soh", "terr",
                extra={"fc": arima_111_exact_sql(_SERIES)})
_PRODUCT_SERIES = """SELECT 'Product ' || CAST(ProductID AS VARCHAR) AS k, CAST(date_trunc('month', OrderDate) AS DATE) AS period,
  CAST(SUM(LineTotal) AS DOUBLE) AS v FROM sod JOIN soh ON soh.SalesOrderID = sod.SalesOrderID
  WHERE ProductID IS NOT NULL GROUP BY ProductID, 2"""
B17_PRODUCTS = sql("SELECT k AS SeriesKey, Step, ForecastDate, Forecast, Phi, Theta, Fit FROM fc", "sod", "soh",
                   extra={"fc": arima_111_forecast_sql(_PRODUCT_SERIES)})
_TOTAL = """SELECT 'ALL' AS k, CAST(date_trunc('month', OrderDate) AS DATE) AS period, CAST(SUM(TotalDue) AS DOUBLE) AS v
  FROM soh GROUP BY 2"""
C17 = sql("""SELECT period AS "Date", v AS Sales, 'actual' AS Kind FROM tot
UNION ALL SELECT ForecastDate AS "Date", Forecast AS Sales, 'forecast' AS Kind FROM fc""", "soh",
          extra={"tot": _TOTAL, "fc": arima_111_forecast_sql(_TOTAL)})


# -- table jobs (A) --------------------------------------------------------

def _values(rows, start_expr: str) -> str:
    vals = ", ".join(f"({i}, {c}, '{d}', '{m}')" for i, (c, d, m) in enumerate(rows))
    return (f"SELECT {start_expr} + i AS FeedbackID, CAST(c AS BIGINT) AS CustomerID, CAST(d AS DATE) AS FeedbackDate, "
            f"CAST(m AS VARCHAR) AS Comments FROM (VALUES {vals}) v(i, c, d, m)")


_V1 = [(101, "2024-06-08", "Great product!"), (102, "2024-06-09", "Nice product!"),
       (103, "2024-06-10", "Product is okay!"), (104, "2024-06-11", "Nice"), (105, "2024-06-12", "It is okay")]
_V2 = [(1001, "2022-09-01", "Great service!"), (1002, "2022-09-05", "Product quality is excellent"),
       (1003, "2022-09-10", "Could improve packaging"), (1001, "2022-09-12", "Fast delivery")]
_FB = """SELECT row_number() OVER (ORDER BY ts, event_id) AS FeedbackID, user_id AS CustomerID,
CAST(ts AS DATE) AS FeedbackDate, props AS Comments FROM events"""
_N = "(SELECT count(*) FROM events)"
_UPD = """SELECT FeedbackID, CustomerID,
CASE WHEN CustomerID = 101 THEN DATE '2024-06-09' ELSE FeedbackDate END AS FeedbackDate,
CASE WHEN FeedbackID = 3 THEN 'Great customer support' ELSE Comments END AS Comments FROM {src}"""
_DEL = "SELECT * FROM {src} WHERE NOT coalesce(CustomerID = 105, false) AND NOT coalesce(FeedbackID = 2, false)"

A04 = "SELECT doc_id, text, lang, source, n_chars FROM documents"
A04_INFERRED = sql("""SELECT SalesOrderID, CustomerID, CAST(OrderDate AS VARCHAR) AS OrderDate, CAST(SalesPersonID AS DOUBLE) AS SalesPersonID,
  SalesPersonID % 2 = 0 AS EvenSeller, CustomerID % 2 = 0 AS EvenCustomer FROM soh""", "soh")
A08 = _FB
A09 = f"{_FB} UNION ALL {_values(_V1, _N + ' + 1')}"
A10 = _FB
A11 = f"{_FB} UNION ALL {_values(_V2, _N + ' + 1')}"
A12 = sql(_UPD.format(src="fb"), extra={"fb": _FB})
A13 = sql(_DEL.format(src="fb"), extra={"fb": _FB})
A15 = sql(_DEL.format(src="upd"), extra={
    "fb": f"{_FB} UNION ALL {_values(_V1, _N + ' + 1')} UNION ALL {_values(_V2, _N + ' + 6')}",
    "upd": _UPD.format(src="fb")})
A14 = """SELECT row_number() OVER (ORDER BY CAST(d.doc_id AS VARCHAR)) AS ID, CAST(d.doc_id AS VARCHAR) AS product_id,
CAST(NULL AS VARCHAR) AS product_parent, CAST(NULL AS VARCHAR) AS product_title, CAST(l.quality AS INTEGER) AS star_rating,
CAST(NULL AS INTEGER) AS helpful_votes, CAST(NULL AS INTEGER) AS total_votes, CAST(NULL AS VARCHAR) AS vine,
CAST(NULL AS VARCHAR) AS verified_purchase, CAST(NULL AS VARCHAR) AS review_headline, d.text AS review_body,
CAST(NULL AS DATE) AS review_date
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id"""
A16 = B01 + " LIMIT 5"

A14_WIDE = """SELECT row_number() OVER (ORDER BY CAST(d.doc_id AS VARCHAR)) AS ID,
CAST(d.doc_id AS VARCHAR) AS asins,
CAST(NULL AS VARCHAR) AS brand,
CAST(NULL AS VARCHAR) AS categories,
CAST(NULL AS VARCHAR) AS colors,
CAST(NULL AS TIMESTAMP) AS dateAdded,
CAST(NULL AS TIMESTAMP) AS dateUpdated,
CAST(NULL AS VARCHAR) AS dimension,
CAST(NULL AS VARCHAR) AS ean,
CAST(NULL AS VARCHAR) AS keys,
CAST(NULL AS VARCHAR) AS manufacturer,
CAST(NULL AS VARCHAR) AS manufacturerNumber,
CAST(NULL AS VARCHAR) AS name,
CAST(NULL AS DOUBLE) AS prices,
CAST(NULL AS TIMESTAMP) AS reviews_date,
(l.toxic = 0) AS reviews_doRecommend,
CAST(NULL AS INTEGER) AS reviews_numHelpful,
CAST(l.quality AS DOUBLE) AS reviews_rating,
CAST(NULL AS VARCHAR) AS reviews_sourceURLs,
d.text AS reviews_text,
CAST(NULL AS VARCHAR) AS reviews_title,
CAST(NULL AS VARCHAR) AS reviews_userCity,
CAST(NULL AS VARCHAR) AS reviews_userProvince,
CAST(NULL AS VARCHAR) AS reviews_username,
CAST(NULL AS VARCHAR) AS sizes,
CAST(NULL AS VARCHAR) AS upc,
CAST(NULL AS DOUBLE) AS weight
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id"""
