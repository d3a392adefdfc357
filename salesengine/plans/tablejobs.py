"""Table jobs of the reference as runnable flows.

Each flow loads the feedback or review table from the driver data (events,
documents, labels), applies the reference's statements, and returns the table
read back.  Tables and exports go under the session's shared storage root, a
fresh folder per run.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from salesengine.operators.identity import assign_identity
from salesengine.plans import sales
from salesengine.session import storage_root
from salesengine.sources import adapters as A
from salesengine.sources.csv import export_csv, read_csv, read_csv_with_rejects
from salesengine.sources.keyed_table import REVIEWS_SCHEMA, REVIEWS_WIDE_SCHEMA, feedback_table, reviews_table
from salesengine.sources.warehouse import run_query

# fixed values: the rows and statements of the reference scripts
SAMPLE_FEEDBACK_V1 = [  # appended by the earlier script
    (101, "2024-06-08", "Great product!"),
    (102, "2024-06-09", "Nice product!"),
    (103, "2024-06-10", "Product is okay!"),
    (104, "2024-06-11", "Nice"),
    (105, "2024-06-12", "It is okay"),
]
SAMPLE_FEEDBACK_V2 = [  # INSERT ... VALUES of the later script
    (1001, "2022-09-01", "Great service!"),
    (1002, "2022-09-05", "Product quality is excellent"),
    (1003, "2022-09-10", "Could improve packaging"),
    (1001, "2022-09-12", "Fast delivery"),
]
UPDATE_DATE_CUSTOMER, UPDATE_DATE_VALUE = 101, "2024-06-09"
UPDATE_COMMENT_ID, UPDATE_COMMENT_VALUE = 3, "Great customer support"
DELETE_CUSTOMER, DELETE_ID = 105, 2
FEEDBACK_COLUMNS = ["CustomerID", "FeedbackDate", "Comments"]


def _run_name(prefix: str) -> str:
    return f"{prefix}_{uuid.uuid4().hex[:12]}"


def feedback_rows(t) -> DataFrame:
    """Feedback rows from ``events`` in arrival order (ts, event_id); FeedbackID is assigned on load."""
    return t["events"].select(
        F.col("user_id").alias("CustomerID"), F.to_date("ts").alias("FeedbackDate"),
        F.col("props").alias("Comments"), "ts", "event_id")


def _loaded_feedback(spark: SparkSession, t):
    table = feedback_table(spark, _run_name("CustomerFeedback"))
    table.create()
    table.append(feedback_rows(t), order_by=["ts", "event_id"])
    return table


def identity_assign(spark: SparkSession, t) -> DataFrame:
    """Consecutive FeedbackID over the event order."""
    rows = feedback_rows(t)
    out = assign_identity(rows, ["ts", "event_id"], "FeedbackID")
    return out.select("FeedbackID", *FEEDBACK_COLUMNS)


def table_append(spark: SparkSession, t) -> DataFrame:
    """Load, then append the five sample rows (identities continue after the maximum)."""
    table = _loaded_feedback(spark, t)
    table.insert_values(SAMPLE_FEEDBACK_V1, FEEDBACK_COLUMNS)
    return table.read()


def table_insert_values(spark: SparkSession, t) -> DataFrame:
    """Load, then INSERT the four literal rows."""
    table = _loaded_feedback(spark, t)
    table.insert_values(SAMPLE_FEEDBACK_V2, FEEDBACK_COLUMNS)
    return table.read()


def _apply_updates(table) -> None:
    table.update(F.col("CustomerID") == UPDATE_DATE_CUSTOMER,
                 {"FeedbackDate": F.lit(UPDATE_DATE_VALUE).cast("date")})
    table.update(F.col("FeedbackID") == UPDATE_COMMENT_ID, {"Comments": F.lit(UPDATE_COMMENT_VALUE)})


def _apply_deletes(table) -> None:
    table.delete(F.col("CustomerID") == DELETE_CUSTOMER)
    table.delete(F.col("FeedbackID") == DELETE_ID)


def table_update(spark: SparkSession, t) -> DataFrame:
    """Load, then the two UPDATE statements (date by customer, comment by key)."""
    table = _loaded_feedback(spark, t)
    _apply_updates(table)
    return table.read()


def table_delete(spark: SparkSession, t) -> DataFrame:
    """Load, then the two DELETE statements (by customer, by key)."""
    table = _loaded_feedback(spark, t)
    _apply_deletes(table)
    return table.read()


def feedback_lifecycle(spark: SparkSession, t) -> DataFrame:
    """Create -> load -> append -> insert -> update -> delete -> read back."""
    table = _loaded_feedback(spark, t)
    table.insert_values(SAMPLE_FEEDBACK_V1, FEEDBACK_COLUMNS)
    table.insert_values(SAMPLE_FEEDBACK_V2, FEEDBACK_COLUMNS)
    _apply_updates(table)
    _apply_deletes(table)
    return table.read()


def table_replace(spark: SparkSession, t) -> DataFrame:
    """A10: replacing twice with the same rows leaves one copy, numbered from 1."""
    table = feedback_table(spark, _run_name("CustomerFeedback"))
    table.create()
    table.replace(feedback_rows(t), order_by=["ts", "event_id"])
    table.replace(feedback_rows(t), order_by=["ts", "event_id"])
    return table.read()


def review_rows(t) -> DataFrame:
    """Product reviews from ``documents`` and their ``labels`` (review_body = whole text)."""
    labels = t["labels"].select("doc_id", "quality")
    d = t["documents"].join(labels, "doc_id", "left")
    cols = []
    for f in REVIEWS_SCHEMA.fields[1:]:
        if f.name == "product_id":
            c = F.col("doc_id").cast("string")
        elif f.name == "star_rating":
            c = F.col("quality").cast("int")
        elif f.name == "review_body":
            c = F.col("text")
        else:
            c = F.lit(None).cast(f.dataType)
        cols.append(c.alias(f.name))
    return d.select(*cols)


def review_order(df: DataFrame, *keys: str) -> list:
    """``keys``, then a hash of the whole row: a product with very many reviews is split over tasks, and only
    rows that are equal throughout can change places."""
    return [*[F.col(k) for k in keys], F.xxhash64(*[F.col(c) for c in df.columns])]


def load_reviews_csv(spark: SparkSession, path: str, name: str, wide: bool = False):
    """Typed CSV read; rows that parse replace the table (numbered by product, then date), rows that do not go to
    ``<name>_rejects``.  Returns (table, rejects table path)."""
    schema = REVIEWS_WIDE_SCHEMA if wide else REVIEWS_SCHEMA
    good, bad = read_csv_with_rejects(spark, path, T.StructType(schema.fields[1:]))
    rejects = f"{storage_root(spark)}/tables/{name}_rejects"
    bad.write.mode("overwrite").parquet(rejects)
    table = reviews_table(spark, name, wide=wide)
    table.replace(good, order_by=review_order(good, *(("asins", "reviews_date") if wide else ("product_id", "review_date"))))
    return table, rejects


def reviews_load(spark: SparkSession, t) -> DataFrame:
    """Reviews -> CSV -> typed read (rejects kept aside) -> identity -> replace the table -> read back."""
    path = f"{storage_root(spark)}/exports/{_run_name('productReviews')}"
    export_csv(review_rows(t), path)
    table, _ = load_reviews_csv(spark, path, _run_name("ProductReviews"))
    return table.read()


def review_rows_wide(t) -> DataFrame:
    """The 26-column review shape of the earlier script: asins = id, text, rating, recommended = not toxic."""
    labels = t["labels"].select("doc_id", "quality", "toxic")
    d = t["documents"].join(labels, "doc_id", "left")
    given = {
        "asins": F.col("doc_id").cast("string"),
        "reviews_text": F.col("text"),
        "reviews_rating": F.col("quality").cast("double"),
        "reviews_doRecommend": F.col("toxic") == 0,
    }
    return d.select(*[given.get(f.name, F.lit(None).cast(f.dataType)).alias(f.name)
                      for f in REVIEWS_WIDE_SCHEMA.fields[1:]])


def reviews_load_wide(spark: SparkSession, t) -> DataFrame:
    """A07 + A14 for the 26-column table: CSV -> typed read (rejects kept aside) -> identity -> replace -> read back."""
    path = f"{storage_root(spark)}/exports/{_run_name('productReviewsWide')}"
    export_csv(review_rows_wide(t), path)
    table, _ = load_reviews_csv(spark, path, _run_name("ProductReviewsWide"), wide=True)
    return table.read()


def csv_export(spark: SparkSession, t) -> DataFrame:
    """B01 written as CSV (header, only if non-empty) and read back typed."""
    df = sales.product_sales_window(t, A.data_as_of(t), 1)
    path = f"{storage_root(spark)}/exports/{_run_name('product_sales_window')}"
    export_csv(df, path)
    return read_csv(spark, path, "ProductName string, TotalSales double")


def csv_read(spark: SparkSession, t) -> DataFrame:
    """Documents (whole multi-line texts) through CSV and back with a declared schema."""
    docs = t["documents"]
    path = f"{storage_root(spark)}/exports/{_run_name('documents')}"
    export_csv(docs, path)
    return read_csv(spark, path, docs.schema)


def csv_read_inferred(spark: SparkSession, t) -> DataFrame:
    """A04 without a schema: orders through CSV and back with inferred types (missing integers become floats, dates stay text)."""
    orders = A.soh(t).select(
        F.col("SalesOrderID"), "CustomerID", "OrderDate", F.col("SalesPersonID").cast("long").alias("SalesPersonID"),
        F.when(F.col("SalesPersonID").isNotNull(), F.col("SalesPersonID") % 2 == 0).alias("EvenSeller"), (F.col("CustomerID") % 2 == 0).alias("EvenCustomer"))
    path = f"{storage_root(spark)}/exports/{_run_name('orders')}"
    export_csv(orders, path)
    return read_csv(spark, path)


SQL_MONTHLY = """SELECT CAST(YEAR(OrderDate) AS BIGINT) AS Year, CAST(MONTH(OrderDate) AS BIGINT) AS Month,
CAST(SUM(TotalDue) AS DOUBLE) AS TotalSales FROM soh GROUP BY YEAR(OrderDate), MONTH(OrderDate) ORDER BY Year, Month"""


def src_table_query(spark: SparkSession, t) -> DataFrame:
    """SQL text over the warehouse views (the reference's monthly-sales statement)."""
    return run_query(spark, t, SQL_MONTHLY)


def preview(spark: SparkSession, t) -> DataFrame:
    """The first 5 rows of B01 in its order."""
    return sales.product_sales_window(t, A.data_as_of(t), 1).limit(5)
