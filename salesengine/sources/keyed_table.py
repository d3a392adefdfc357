"""Mutable tables on plain parquet: A06, A07, A09-A13.

A table is one parquet folder, partitioned by ``_bucket`` = identity value div
``rows_per_bucket``.  Loads are ordinary appends.  An update reads the buckets
that hold a matching row, and writes those buckets again with Spark's dynamic
partition overwrite; the other buckets aren't touched.  A delete is an update of
the hidden ``_deleted`` flag, which ``read`` filters on, so a bucket never
becomes empty and the identity values of deleted rows are never given out again
(as an IDENTITY column behaves).  ``replace`` writes the folder anew.

The buckets to rewrite stay in Spark: they are a broadcast frame of one number
each, and there are (largest key div ``rows_per_bucket``) of them at most.
The driver gets one value, the largest key.

Constraints of the DDL are checked inside the jobs: NOT NULL and VARCHAR(n)
violations raise through ``raise_error``, before anything stored is changed, so
no extra pass is made.

One writer per table at a time.  A failed job leaves the table as it was until
Spark's job commit moves its files in; the commit itself is not atomic, so after
the loss of a driver in that moment the load or statement has to be run again
(streamed batches do that by themselves, by their label).
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from salesengine.operators.identity import assign_identity
from salesengine.session import reliable_checkpoint, storage_root

#: Keys of one bucket: the unit that an update or a delete rewrites, some GB of feedback rows.
ROWS_PER_BUCKET = 10_000_000

BATCH, DELETED, BUCKET = "_batch", "_deleted", "_bucket"


class KeyedTable:
    """A table at ``path`` with a declared schema, an optional identity column and VARCHAR limits.

    ``read`` returns the rows as a lazy DataFrame; every other method runs one statement.
    A table without an identity column has one bucket.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, identity: str | None = None,
                 varchar: dict[str, int] | None = None, rows_per_bucket: int = ROWS_PER_BUCKET):
        self.spark = spark
        self.path = path.rstrip("/")
        self.schema = schema
        self.identity = identity
        self.varchar = dict(varchar or {})
        self.rows_per_bucket = rows_per_bucket
        self._stored = T.StructType([
            *schema.fields, T.StructField(BATCH, T.StringType()), T.StructField(DELETED, T.BooleanType()),
            T.StructField(BUCKET, T.LongType())])

    @classmethod
    def at(cls, spark: SparkSession, name: str, schema: T.StructType, **kw) -> KeyedTable:
        """A table named ``name`` under the session's shared storage root."""
        return cls(spark, f"{storage_root(spark)}/tables/{name}", schema, **kw)

    # -- reading -----------------------------------------------------------
    def _rows(self) -> DataFrame:
        """Stored rows, deleted ones included; a table that doesn't exist raises."""
        return self.spark.read.schema(self._stored).parquet(self.path)

    def read(self) -> DataFrame:
        return self._rows().filter(~F.col(DELETED)).select(*self.schema.names)

    def batch_rows(self, label: str) -> int:
        """Rows appended under ``label`` and not deleted since (one column is read, by its statistics)."""
        return self._rows().filter((F.col(BATCH) == label) & ~F.col(DELETED)).count()

    # -- writing -----------------------------------------------------------
    def _checked(self, field: T.StructField, value: Column) -> Column:
        c = value.cast(field.dataType)
        if not field.nullable:
            c = F.when(c.isNull(), F.raise_error(F.lit(f"NULL into NOT NULL column {field.name}"))).otherwise(c)
        if field.name in self.varchar:
            n = self.varchar[field.name]
            c = F.when(F.length(c) > n, F.raise_error(F.lit(f"value longer than {n} in {field.name}"))).otherwise(c)
        return c.alias(field.name)

    def _numbered(self, df: DataFrame, order_by: Sequence[str | Column] | None, start: int) -> DataFrame:
        """``df`` with checked columns and, if the table has one, a new identity column; its violations have been raised."""
        own = [f for f in self.schema.fields if f.name != self.identity]
        if not self.identity:
            return reliable_checkpoint(df.select(*[self._checked(f, F.col(f.name)) for f in own]))
        keys = [F.col(k) if isinstance(k, str) else k for k in order_by or [f.name for f in own]]
        keyed = df.select(*[self._checked(f, F.col(f.name)) for f in own],
                          *[k.alias(f"_key{i}") for i, k in enumerate(keys)])
        out = assign_identity(keyed, [f"_key{i}" for i in range(len(keys))], self.identity, start=start)
        return out.select(*self.schema.names)

    def _save(self, df: DataFrame, mode: str, label: str | None = None) -> None:
        bucket = F.col(self.identity) if self.identity else F.lit(0)
        bucket = F.call_function("div", bucket, F.lit(self.rows_per_bucket)).cast("long")
        df.select(*self.schema.names, F.lit(label).cast("string").alias(BATCH), F.lit(False).alias(DELETED),
                  bucket.alias(BUCKET)).write.mode(mode).option("partitionOverwriteMode", "static").partitionBy(
            BUCKET).parquet(self.path)

    def _next_id(self) -> int:
        if not self.identity:
            return 1
        return (self._rows().agg(F.max(self.identity).alias("m")).first()["m"] or 0) + 1

    def create(self) -> None:
        """DROP-if-exists + CREATE: an empty table, identity restarting at 1."""
        self._save(self.spark.createDataFrame([], self.schema), "overwrite")

    def replace(self, df: DataFrame, order_by: Sequence[str | Column] | None = None) -> None:
        """A10: the table becomes ``df`` (identity renumbered from 1); ``df`` may come from the table itself."""
        self._save(self._numbered(df, order_by, start=1), "overwrite")

    def append(self, df: DataFrame, order_by: Sequence[str | Column] | None = None, label: str | None = None) -> None:
        """Add rows; an identity column in ``df`` is dropped and numbered from the next identity value."""
        self._save(self._numbered(df, order_by, start=self._next_id()), "append", label)

    def insert_values(self, rows: Iterable[tuple], columns: Sequence[str]) -> None:
        """INSERT ... VALUES; identities follow the order of ``rows``.

        The rows are literals of the statement, already on the driver, so they
        are numbered there; no distributed key assignment is needed.
        """
        rows = [tuple(r) for r in rows]
        fields = {f.name: f for f in self.schema.fields}
        given = T.StructType([T.StructField(c, T.StringType() if fields[c].dataType == T.DateType()
                                            else fields[c].dataType) for c in columns])
        if self.identity:
            start = self._next_id()
            given = given.add(T.StructField(self.identity, T.LongType()))
            rows = [r + (start + i,) for i, r in enumerate(rows)]
        df = self.spark.createDataFrame(rows, given).coalesce(1)  # a statement's literals: one file
        absent = {f.name: F.lit(None).cast(f.dataType) for f in self.schema.fields if f.name not in given.names}
        df = df.withColumns(absent) if absent else df
        self._save(df.select(*[self._checked(f, F.col(f.name)) for f in self.schema.fields]), "append")

    def _rewrite(self, predicate: Column, change: Callable[[str, Column], Column]) -> None:
        """Columns become ``change(name, hit)`` in the buckets with a row where ``predicate`` is true."""
        rows = self._rows()
        hit = F.coalesce(predicate, F.lit(False)) & ~F.col(DELETED)
        touched = rows.filter(hit).select(BUCKET).distinct()
        new = rows.join(F.broadcast(touched), BUCKET, "left_semi").select(
            *[change(n, hit).alias(n) for n in self._stored.names])
        new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(self.path)

    def update(self, predicate: Column, assignments: dict[str, Column]) -> None:
        """SET col = value WHERE predicate (a NULL predicate leaves the row)."""
        if self.identity in assignments:
            raise ValueError(f"identity column {self.identity} can't be updated")
        new = {n: self._checked(self.schema[n], c) for n, c in assignments.items()}
        self._rewrite(predicate, lambda n, hit: F.when(hit, new[n]).otherwise(F.col(n)) if n in new else F.col(n))

    def delete(self, predicate: Column) -> None:
        """DELETE WHERE predicate (a NULL predicate keeps the row)."""
        self._rewrite(predicate, lambda n, hit: F.col(n) | hit if n == DELETED else F.col(n))

    def discard_batch(self, label: str) -> None:
        """Delete what was appended under ``label``."""
        self.delete(F.col(BATCH) == label)


# -- table definitions (A06, A07); fixed values: column names, order, types and lengths of the DDL ----------

FEEDBACK_SCHEMA = T.StructType([
    T.StructField("FeedbackID", T.LongType(), False),
    T.StructField("CustomerID", T.LongType(), False),
    T.StructField("FeedbackDate", T.DateType(), False),
    T.StructField("Comments", T.StringType(), True),
])
FEEDBACK_VARCHAR = {"Comments": 300}

# ProductReviews as loaded by the later script (ID + 11 columns)
REVIEWS_SCHEMA = T.StructType([
    T.StructField("ID", T.LongType(), False),
    T.StructField("product_id", T.StringType()),
    T.StructField("product_parent", T.StringType()),
    T.StructField("product_title", T.StringType()),
    T.StructField("star_rating", T.IntegerType()),
    T.StructField("helpful_votes", T.IntegerType()),
    T.StructField("total_votes", T.IntegerType()),
    T.StructField("vine", T.StringType()),
    T.StructField("verified_purchase", T.StringType()),
    T.StructField("review_headline", T.StringType()),
    T.StructField("review_body", T.StringType()),
    T.StructField("review_date", T.DateType()),
])
REVIEWS_VARCHAR = {"product_id": 255, "product_parent": 255, "product_title": 255, "vine": 10,
                   "verified_purchase": 10, "review_headline": 255}

# ProductReviews of the earlier script (ID + 26 columns)
_S, _TS, _D = T.StringType(), T.TimestampNTZType(), T.DoubleType()
REVIEWS_WIDE_SCHEMA = T.StructType([T.StructField("ID", T.LongType(), False)] + [
    T.StructField(n, t) for n, t in [
        ("asins", _S), ("brand", _S), ("categories", _S), ("colors", _S), ("dateAdded", _TS), ("dateUpdated", _TS),
        ("dimension", _S), ("ean", _S), ("keys", _S), ("manufacturer", _S), ("manufacturerNumber", _S),
        ("name", _S), ("prices", _D), ("reviews_date", _TS), ("reviews_doRecommend", T.BooleanType()),
        ("reviews_numHelpful", T.IntegerType()), ("reviews_rating", _D), ("reviews_sourceURLs", _S),
        ("reviews_text", _S), ("reviews_title", _S), ("reviews_userCity", _S), ("reviews_userProvince", _S),
        ("reviews_username", _S), ("sizes", _S), ("upc", _S), ("weight", _D),
    ]])
REVIEWS_WIDE_VARCHAR = {n: 255 for n in (
    "asins", "brand", "colors", "dimension", "ean", "manufacturer", "manufacturerNumber", "name", "reviews_title",
    "reviews_userCity", "reviews_userProvince", "reviews_username", "sizes", "upc")}


def feedback_table(spark: SparkSession, name: str = "CustomerFeedback") -> KeyedTable:
    return KeyedTable.at(spark, name, FEEDBACK_SCHEMA, identity="FeedbackID", varchar=FEEDBACK_VARCHAR)


def reviews_table(spark: SparkSession, name: str = "ProductReviews", wide: bool = False) -> KeyedTable:
    if wide:
        return KeyedTable.at(spark, name, REVIEWS_WIDE_SCHEMA, identity="ID", varchar=REVIEWS_WIDE_VARCHAR)
    return KeyedTable.at(spark, name, REVIEWS_SCHEMA, identity="ID", varchar=REVIEWS_VARCHAR)
