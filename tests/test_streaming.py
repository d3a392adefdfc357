"""Streaming append load: files arriving over time end up in the table once, with consecutive keys."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from salesengine.plans import tablejobs
from salesengine.session import storage_root
from salesengine.sources.csv import export_csv
from salesengine.sources.keyed_table import feedback_table
from salesengine.streaming import start_append_stream
from tests.fixtures import feedback_events

SCHEMA = T.StructType([
    T.StructField("CustomerID", T.LongType()), T.StructField("FeedbackDate", T.DateType()),
    T.StructField("Comments", T.StringType()), T.StructField("event_id", T.LongType()),
])


def test_stream_appends_new_files_once(spark):
    rows = tablejobs.feedback_rows(feedback_events(spark, 30)).select(*SCHEMA.fieldNames())
    src = f"{storage_root(spark)}/incoming/{tablejobs._run_name('fb')}"
    table = feedback_table(spark, tablejobs._run_name("stream"))
    table.create()
    export_csv(rows.filter("event_id < 10"), f"{src}/batch1")
    export_csv(rows.filter("event_id >= 10 AND event_id < 20"), f"{src}/batch2")
    sid = tablejobs._run_name("s")

    def run():
        q = start_append_stream(spark, f"{src}/*", table, SCHEMA, order_by=["event_id"], stream_id=sid)
        q.awaitTermination(120)

    run()
    assert sorted(r["FeedbackID"] for r in table.read().collect()) == list(range(1, 21))
    run()  # nothing new: no change
    assert table.read().count() == 20
    export_csv(rows.filter("event_id >= 20"), f"{src}/batch3")
    run()
    got = sorted((r["FeedbackID"], r["Comments"]) for r in table.read().collect())
    assert [i for i, _ in got] == list(range(1, 31))
    assert table.read().filter(F.col("Comments").isNull()).count() == 0


def test_replayed_batch_is_not_appended_twice(spark):
    from salesengine.streaming.load import batch_appender

    rows = tablejobs.feedback_rows(feedback_events(spark, 12)).select(*SCHEMA.fieldNames())
    table = feedback_table(spark, tablejobs._run_name("replay"))
    table.create()
    append = batch_appender(table, ["event_id"], "s1")
    append(rows, 0)
    append(rows, 0)  # the same micro-batch again, e.g. after a failure before the stream checkpoint
    assert table.read().count() == 12
    fresh = feedback_table(spark, table.path.rsplit("/", 1)[-1])  # a new object reads the table
    batch_appender(fresh, ["event_id"], "s1")(rows, 0)
    assert fresh.read().count() == 12

    # what a broken commit left of a batch goes before the batch is appended again
    table.append(rows.limit(5), order_by=["event_id"], label="s1:1")
    append(rows, 1)
    assert table.read().count() == 24 and table.batch_rows("s1:1") == 12
