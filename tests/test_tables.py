"""Keyed tables (A06-A15): constraints, identity continuation, update and delete by bucket, CSV."""

import pytest
from pyspark.sql import functions as F

from salesengine.plans import tablejobs
from salesengine.sources.csv import export_csv, read_csv
from salesengine.sources.keyed_table import feedback_table
from salesengine.session import storage_root
from tests.fixtures import feedback_events


@pytest.fixture()
def loaded(spark):
    t = feedback_events(spark, 60)
    table = feedback_table(spark, tablejobs._run_name("t"))
    table.create()
    table.append(tablejobs.feedback_rows(t).repartition(5), order_by=["ts", "event_id"])
    return table


def test_create_gives_empty_typed_table(spark):
    table = feedback_table(spark, tablejobs._run_name("t"))
    table.create()
    df = table.read()
    assert df.count() == 0 and df.columns == ["FeedbackID", "CustomerID", "FeedbackDate", "Comments"]


def test_append_continues_identity(spark, loaded):
    loaded.insert_values(tablejobs.SAMPLE_FEEDBACK_V2, tablejobs.FEEDBACK_COLUMNS)
    df = loaded.read()
    ids = sorted(r["FeedbackID"] for r in df.collect())
    assert ids == list(range(1, 65))
    last = sorted((r["FeedbackID"], r["CustomerID"]) for r in df.filter("FeedbackID > 60").collect())
    assert last == [(61, 1001), (62, 1002), (63, 1003), (64, 1001)]


def test_identity_column_in_input_is_ignored(spark, loaded):
    df = loaded.read().limit(3)  # carries FeedbackID 1..3
    loaded.append(df, order_by=["FeedbackID"])
    assert sorted(r["FeedbackID"] for r in loaded.read().collect()) == list(range(1, 64))


def test_not_null_violation_raises_and_commits_nothing(spark, loaded):
    before = sorted(loaded.read().collect())
    bad = spark.createDataFrame([(None, "2024-01-01", "x")], "CustomerID long, FeedbackDate string, Comments string")
    for statement in (lambda: loaded.insert_values([(None, "2024-01-01", "x")], tablejobs.FEEDBACK_COLUMNS),
                      lambda: loaded.append(bad), lambda: loaded.replace(bad),
                      lambda: loaded.update(F.col("FeedbackID") == 5, {"CustomerID": F.lit(None)})):
        with pytest.raises(Exception, match="NOT NULL"):
            statement()
        assert sorted(loaded.read().collect()) == before


def test_varchar_limit_raises(spark, loaded):
    with pytest.raises(Exception, match="longer than 300"):
        loaded.insert_values([(1, "2024-01-01", "x" * 301)], tablejobs.FEEDBACK_COLUMNS)


def test_update_touches_exactly_the_predicate_rows(spark, loaded):
    before = {r["FeedbackID"]: r for r in loaded.read().collect()}
    loaded.update(F.col("CustomerID") == 101, {"Comments": F.lit("changed")})
    after = {r["FeedbackID"]: r for r in loaded.read().collect()}
    assert before.keys() == after.keys()
    for k, r in after.items():
        if before[k]["CustomerID"] == 101:
            assert r["Comments"] == "changed"
        else:
            assert r == before[k]


def _files(spark, table):
    """Data files by bucket."""
    rows = spark.read.parquet(table.path).select("_bucket", F.col("_metadata.file_path").alias("f")).distinct().collect()
    return {b: {r["f"] for r in rows if r["_bucket"] == b} for b in {r["_bucket"] for r in rows}}


def test_update_and_delete_rewrite_only_touched_buckets(spark):
    table = feedback_table(spark, tablejobs._run_name("t"))
    table.rows_per_bucket = 10
    table.create()
    table.append(tablejobs.feedback_rows(feedback_events(spark, 38)), order_by=["ts", "event_id"])
    files = _files(spark, table)
    assert set(files) == {0, 1, 2, 3}
    table.update(F.col("FeedbackID") == 15, {"Comments": F.lit("changed")})
    after = _files(spark, table)
    assert {b for b in files if files[b] != after[b]} == {1}
    assert [r["FeedbackID"] for r in table.read().filter("Comments = 'changed'").collect()] == [15]
    table.update(F.col("FeedbackID") == 10 ** 6, {"Comments": F.lit("nobody")})
    assert _files(spark, table) == after
    table.delete(F.col("FeedbackID").between(20, 29))  # a whole bucket
    table.delete(F.col("FeedbackID") == 38)
    assert sorted(r["FeedbackID"] for r in table.read().collect()) == [*range(1, 20), *range(30, 38)]
    table.update(F.col("FeedbackID") == 25, {"Comments": F.lit("changed")})  # a deleted row isn't updated
    assert table.read().filter("Comments = 'changed'").count() == 1
    table.insert_values([(1, "2024-01-01", "x")], tablejobs.FEEDBACK_COLUMNS)
    assert table.read().filter("Comments = 'x'").first()["FeedbackID"] == 39  # 38 isn't given out again


def test_identity_column_is_not_updated(spark, loaded):
    with pytest.raises(ValueError):
        loaded.update(F.col("CustomerID") == 101, {"FeedbackID": F.lit(1)})


def test_replace_from_the_table_itself_and_recreate(spark, loaded):
    loaded.delete(F.col("FeedbackID") <= 10)
    loaded.replace(loaded.read(), order_by=["FeedbackID"])
    assert sorted(r["FeedbackID"] for r in loaded.read().collect()) == list(range(1, 51))
    loaded.create()
    assert loaded.read().count() == 0
    loaded.insert_values([(1, "2024-01-01", "x")], tablejobs.FEEDBACK_COLUMNS)
    assert loaded.read().first()["FeedbackID"] == 1


def test_delete_keeps_rows_with_null_predicate(spark, loaded):
    loaded.insert_values([(7, "2024-01-01", None)], tablejobs.FEEDBACK_COLUMNS)
    loaded.delete(F.col("Comments") == "{\"k\": 3}")
    df = loaded.read()
    assert df.count() == 60  # 61 rows, one deleted, the NULL-comment row kept
    assert df.filter(F.col("Comments").isNull()).count() == 1


def test_csv_round_trip_keeps_text(spark):
    text = 'line one, with comma\nline "two"\r\nthree\n'
    df = spark.createDataFrame([(1, text), (2, ""), (3, None)], "id long, t string")
    path = f"{storage_root(spark)}/exports/{tablejobs._run_name('rt')}"
    assert export_csv(df, path)
    back = read_csv(spark, path, "id long, t string")
    got = dict((r["id"], r["t"]) for r in back.collect())
    assert got[1] == text and got[2] == "" and got[3] is None


def test_csv_export_skips_empty(spark):
    df = spark.createDataFrame([], "id long")
    assert not export_csv(df, f"{storage_root(spark)}/exports/{tablejobs._run_name('e')}")


def test_missing_csv_raises(spark):
    with pytest.raises(Exception):
        read_csv(spark, "/nonexistent/productReviews", "a string").count()


def test_reviews_load_keeps_rejects_aside(spark):
    from pyspark.sql import types as T

    from salesengine.sources.keyed_table import REVIEWS_SCHEMA

    cols = [f.name for f in REVIEWS_SCHEMA.fields[1:]]
    good = {c: None for c in cols}
    rows = [dict(good, product_id="b", star_rating="1", review_body='fine, "quoted"\nsecond line'),
            dict(good, product_id="a", star_rating="not a number", review_body="bad rating"),
            dict(good, product_id="c", star_rating="0", review_date="2024-02-30x")]
    df = spark.createDataFrame(rows, T.StructType([T.StructField(c, T.StringType()) for c in cols]))
    path = f"{storage_root(spark)}/exports/{tablejobs._run_name('rev')}"
    export_csv(df.select(*cols), path)
    table, rejects = tablejobs.load_reviews_csv(spark, path, tablejobs._run_name("rv"))
    loaded = table.read().collect()
    assert [(r["ID"], r["product_id"], r["star_rating"]) for r in loaded] == [(1, "b", 1)]
    assert spark.read.parquet(rejects).count() == 2


def test_a_fresh_object_sees_all_statements(spark, loaded):
    for i in range(3):
        loaded.update(F.col("FeedbackID") == 1, {"Comments": F.lit(f"v{i}")})
    fresh = feedback_table(spark, loaded.path.rsplit("/", 1)[-1])
    assert fresh.read().filter(F.col("FeedbackID") == 1).first()["Comments"] == "v2"
    assert fresh.read().count() == 60


def test_read_errors_are_raised(spark, tmp_path):
    """Neither a missing folder nor a broken file looks like an empty table."""
    from pyspark.sql import types as T

    from salesengine.sources.keyed_table import KeyedTable

    schema = T.StructType([T.StructField("a", T.LongType())])
    rows = spark.createDataFrame([(1,)], schema)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        KeyedTable(spark, str(tmp_path / "none"), schema).read()
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        KeyedTable(spark, str(tmp_path / "none"), schema, identity="a").append(rows)
    broken = tmp_path / "broken" / "_bucket=0"
    broken.mkdir(parents=True)
    (broken / "part-0.parquet").write_bytes(b"no parquet")
    table = KeyedTable(spark, str(tmp_path / "broken"), schema, identity="a")
    for statement in (lambda: table.read().count(), lambda: table.append(rows), lambda: table.delete(F.lit(True))):
        with pytest.raises(Exception):
            statement()


def test_a_hot_product_is_split_and_numbered_in_order(spark):
    """A product with a third of all reviews: its rows are ordered by date and content, in several tasks."""
    from salesengine.sources.keyed_table import REVIEWS_SCHEMA

    given = {"product_id": F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("p"), F.col("id"))),
             "review_date": F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 50).cast("int")),
             "review_body": F.concat(F.lit("text "), F.col("id"))}
    df = spark.range(3000).select(*[given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name)
                                    for f in REVIEWS_SCHEMA.fields[1:]])
    keys = tablejobs.review_order(df, "product_id", "review_date")
    hot = df.repartitionByRange(8, *keys).filter("product_id = 'hot'")
    assert hot.select(F.spark_partition_id()).distinct().count() > 1
    path = f"{storage_root(spark)}/exports/{tablejobs._run_name('hot')}"
    export_csv(df, path)
    table, _ = tablejobs.load_reviews_csv(spark, path, tablejobs._run_name("hot"))
    rows = sorted(table.read().select("ID", "product_id", "review_date", "review_body").collect())
    assert [r["ID"] for r in rows] == list(range(1, 3001))
    assert [(r["product_id"], r["review_date"]) for r in rows] == sorted((r["product_id"], r["review_date"]) for r in rows)
    assert len({r["review_body"] for r in rows}) == 3000


def test_wide_load_keeps_rejects(spark):
    from pyspark.sql import types as T

    from salesengine.sources.keyed_table import REVIEWS_WIDE_SCHEMA

    cols = [f.name for f in REVIEWS_WIDE_SCHEMA.fields[1:]]
    rows = [dict.fromkeys(cols) | {"asins": "a", "reviews_rating": "4.5"}, dict.fromkeys(cols) | {"asins": "b", "reviews_rating": "four"}]
    path = f"{storage_root(spark)}/exports/{tablejobs._run_name('wide')}"
    export_csv(spark.createDataFrame(rows, T.StructType([T.StructField(c, T.StringType()) for c in cols])), path)
    table, rejects = tablejobs.load_reviews_csv(spark, path, tablejobs._run_name("w"), wide=True)
    assert [(r["ID"], r["asins"], r["reviews_rating"]) for r in table.read().collect()] == [(1, "a", 4.5)]
    assert spark.read.parquet(rejects).count() == 1
