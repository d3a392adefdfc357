"""Expected rows of the business queries by nested loops over the adapter tables' rows, one Python function a query."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable
from decimal import ROUND_HALF_UP, Decimal

from salesengine.sources import adapters as A


def rows_of(t, adapter: str) -> list[dict]:
    return [r.asDict() for r in A.ADAPTERS[adapter](t).collect()]


def pairs(left: Iterable[dict], right: list[dict], key: str, other: str | None = None, outer: bool = False) -> list[dict]:
    """Every left row with every right row of equal, non-null key; ``outer`` keeps left rows without one."""
    by = defaultdict(list)
    for r in right:
        by[r[other or key]].append(r)
    blank = dict.fromkeys(right[0]) if right else {}
    out = []
    for x in left:
        found = by.get(x[key], []) if x[key] is not None else []
        out += [{**y, **x} for y in found] or ([{**blank, **x}] if outer else [])
    return out


def groups(rows: list[dict], *keys: str) -> dict[tuple, list[dict]]:
    out = defaultdict(list)
    for r in rows:
        out[tuple(r[k] for k in keys)].append(r)
    return out


def total(rows: list[dict], column: str) -> float:
    return float(sum((r[column] for r in rows), Decimal(0)))


def mean4(rows: list[dict], column: str) -> float:
    return float((sum((r[column] for r in rows), Decimal(0)) / len(rows)).quantize(Decimal("0.0001"), ROUND_HALF_UP))


def customer_segments(t):
    orders = pairs(rows_of(t, "cust"), rows_of(t, "soh"), "CustomerID")
    billed = pairs(orders, rows_of(t, "addr"), "BillToAddressID", "AddressID")
    for (c, city, state), part in groups(billed, "CustomerID", "City", "StateProvinceID").items():
        yield {"CustomerID": c, "City": city, "StateProvinceID": state, "OrderCount": len(part), "TotalSpent": total(part, "TotalDue")}


def customer_retention(t):
    for (c,), part in groups(pairs(rows_of(t, "cust"), rows_of(t, "soh"), "CustomerID"), "CustomerID").items():
        yield {"CustomerID": c, "RepeatPurchaseCount": len({r["SalesOrderID"] for r in part}), "TotalSpent": total(part, "TotalDue"),
               "LatestPurchaseDate": max(r["OrderDate"] for r in part)}


def _stock(t, outer: bool):
    stocked = pairs(rows_of(t, "prod"), rows_of(t, "inv"), "ProductID")
    lines = [{"ProductID": r["ProductID"], "line": r["SalesOrderDetailID"]} for r in rows_of(t, "sod")]
    for (p, name, quantity), part in groups(pairs(stocked, lines, "ProductID", outer=outer), "ProductID", "Name", "Quantity").items():
        yield {"ProductID": p, "ProductName": name, "InventoryQty": quantity, "SalesCount": sum(r["line"] is not None for r in part)}


def inventory_anomalies(t):
    for r in _stock(t, outer=True):
        if r["InventoryQty"] > 100 or (r["InventoryQty"] == 0 and r["SalesCount"] == 0):
            yield r


def low_inventory_sellers(t):
    return (r for r in _stock(t, outer=False) if r["InventoryQty"] < 10)


def product_profitability(t):
    for (p, name), part in groups(pairs(rows_of(t, "prod"), rows_of(t, "sod"), "ProductID"), "ProductID", "Name").items():
        sold, cost = (sum((r[c] for r in part), Decimal(0)) for c in ("LineTotal", "Gross"))
        yield {"ProductID": p, "ProductName": name, "TotalSales": float(sold), "TotalCost": float(cost), "Profit": float(sold - cost)}


def product_ranking(t):
    for r in product_profitability(t):
        yield {k: r[k] for k in ("ProductID", "ProductName", "TotalSales")}


def salesperson_performance(t):
    sold = pairs(rows_of(t, "soh"), rows_of(t, "person"), "SalesPersonID", "BusinessEntityID")
    for (s, first, last), part in groups(sold, "SalesPersonID", "FirstName", "LastName").items():
        yield {"SalesPersonID": s, "FirstName": first, "LastName": last, "TotalOrders": len(part), "TotalSales": total(part, "TotalDue")}


def vendor_lead_time(t):
    for (v, name), part in groups(pairs(rows_of(t, "pv"), rows_of(t, "vend"), "BusinessEntityID"), "BusinessEntityID", "Name").items():
        days = [r["AverageLeadTime"] for r in part if r["AverageLeadTime"] is not None]
        yield {"VendorID": v, "VendorName": name, "AvgLeadTimeDays": int(Decimal(sum(days)) / len(days)) if days else None}


def vendor_evaluation_by_vendor(t):
    for (v, name), part in groups(pairs(rows_of(t, "vend"), rows_of(t, "po"), "BusinessEntityID", "VendorID"), "BusinessEntityID", "Name").items():
        yield {"VendorID": v, "VendorName": name, "PurchaseOrders": len(part), "AvgOrderCost": mean4(part, "TotalDue")}


def vendor_evaluation(t):
    matched = pairs(rows_of(t, "pv"), [{k: r[k] for k in ("PurchaseOrderID", "TotalDue")} for r in rows_of(t, "po")], "ProductID", "PurchaseOrderID")
    for (v, name), part in groups(pairs(matched, rows_of(t, "vend"), "BusinessEntityID"), "BusinessEntityID", "Name").items():
        yield {"VendorID": v, "VendorName": name, "PurchaseOrders": len(part), "AvgOrderCost": mean4(part, "TotalDue")}


def territory_product_sales(t):
    lines = pairs(rows_of(t, "sod"), rows_of(t, "soh_territory"), "SalesOrderID")
    named = pairs(lines, [{"TerritoryID": r["TerritoryID"], "TerritoryName": r["Name"]} for r in rows_of(t, "terr")], "TerritoryID")
    for (territory, product), part in groups(pairs(named, rows_of(t, "prod"), "ProductID"), "TerritoryName", "Name").items():
        yield {"TerritoryName": territory, "BestSellingProduct": product, "MaxSale": float(max(r["TotalDue"] for r in part)), "AvgSales": mean4(part, "TotalDue")}


def expected(key: str, t) -> tuple[list[str], list[tuple]]:
    """Columns and sorted rows."""
    found = list(globals()[key](t))
    columns = list(found[0]) if found else []
    return columns, sorted(tuple(r[c] for c in columns) for r in found)
