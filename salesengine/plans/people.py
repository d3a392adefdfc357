"""People queries: B18, B19."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesengine.functions.money import int_avg, units_sum, units_to_double
from salesengine.sources import adapters as A


def salesperson_performance(t) -> DataFrame:
    """Orders and sales per salesperson; orders without one are dropped (inner join, S8).

    Few salespeople share all orders, so each is a hot key: orders are reduced
    to one row per salesperson and map task before the join.
    """
    per_sp = A.soh(t).filter(F.col("SalesPersonID").isNotNull()).groupBy("SalesPersonID").agg(
        F.count("SalesOrderID").alias("n"), units_sum("TotalDueU").alias("s"))
    j = per_sp.join(A.person(t), F.col("SalesPersonID") == F.col("BusinessEntityID"))
    g = j.groupBy("SalesPersonID", "FirstName", "LastName").agg(
        F.sum("n").alias("TotalOrders"), units_to_double(F.sum("s")).alias("TotalSales"))
    return g.orderBy(F.desc("TotalSales"), "SalesPersonID")


def department_productivity(t) -> DataFrame:
    """History rows per department (no end-date filter) and integer-average hours."""
    j = A.edh(t).join(A.emp(t), "BusinessEntityID").join(A.dept(t), "DepartmentID")
    return j.groupBy("DepartmentID", F.col("Name").alias("DepartmentName")).agg(
        F.count("BusinessEntityID").alias("TotalEmployees"),
        int_avg("VacationHours").alias("AvgVacationHours"),
        int_avg("SickLeaveHours").alias("AvgSickLeaveHours"),
    ).orderBy(F.desc("TotalEmployees"), "DepartmentID")
