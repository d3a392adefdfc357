"""CSV records over block borders, rejects of the same pass, inferred types, exports counted as they are written."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from salesengine.plans import tablejobs
from salesengine.session import storage_root
from salesengine.sources import csv_records
from salesengine.sources.csv import CSV_OPTIONS, export_csv, inferred_type, read_csv, read_csv_inferred, read_csv_with_rejects

SCHEMA = "id long, a string, b string"


@pytest.fixture()
def small_blocks(spark):
    """Blocks of 64 bytes, a task each."""
    keys = {"spark.sql.files.maxPartitionBytes": "64", "spark.sql.files.openCostInBytes": "64"}
    old = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in old.items():
        spark.conf.set(k, v)


def texts(seed, n):
    r = random.Random(seed)
    parts = ["x", "line\n", '"', '""', ",", "\r\n", "\n\n", "é文", "long " * 30, " ", "\\", "\\N"]
    return [(i, "".join(r.choices(parts, k=r.randrange(0, 9))), None if i % 7 == 0 else "".join(r.choices(parts, k=2))) for i in range(n)]


def written(spark, rows, schema=SCHEMA, files=1):
    path = f"{storage_root(spark)}/exports/{tablejobs._run_name('csv')}"
    assert export_csv(spark.createDataFrame(rows, schema).repartition(files), path)
    return path


def by_id(df):
    return sorted(map(tuple, df.collect()), key=lambda r: r[0])


@pytest.mark.parametrize("seed, files", [(1, 1), (2, 3)])
def test_blocks_give_the_rows_of_the_whole_file_reader(small_blocks, seed, files):
    spark = small_blocks
    rows = texts(seed, 120)
    path = written(spark, rows, files=files)
    found = csv_records.pieces(spark, path)
    assert found.select("file", "block").distinct().count() > 20 * files
    assert {r["kind"] for r in found.select("kind").distinct().collect()} == {"whole", "head", "middle", "tail"}
    got = by_id(read_csv(spark, path, SCHEMA))
    assert got == by_id(spark.read.options(**CSV_OPTIONS).option("mode", "FAILFAST").schema(SCHEMA).csv(path))
    # a text of the null marker alone reads as null, whichever reader
    assert [r for r in got if "\\N" not in r[1:]] == [r for r in sorted(rows) if "\\N" not in r[1:]]


def test_one_large_file_is_read_by_many_tasks(small_blocks):
    spark = small_blocks
    path = written(spark, [(i, f"text {i}\nmore", "b") for i in range(300)])
    read = spark.read.text(path).select(F.input_file_name().alias("f"))
    assert read.distinct().count() == 1
    assert csv_records.pieces(spark, path).rdd.getNumPartitions() > 50
    assert read_csv(spark, path, SCHEMA).count() == 300


def test_rejects_come_from_the_same_pass(small_blocks):
    spark = small_blocks
    rows = [(str(i) if i % 10 else f"no {i}", f"a\n{i}" * 5, "b,") for i in range(100)]
    path = written(spark, rows, "id string, a string, b string")
    good, bad = read_csv_with_rejects(spark, path, T.StructType.fromDDL(SCHEMA))
    assert sorted(r["id"] for r in good.collect()) == [i for i in range(100) if i % 10]
    got = bad.collect()
    assert len(got) == 10 and all("no " in r["raw_record"] and r["a"].startswith("a\n") for r in got)


def test_line_ends_blank_lines_and_open_quotes(spark, tmp_path):
    (tmp_path / "x.csv").write_bytes(b'id,a,b\r\n1,"x\r\ny",z\r\n\r\n2,,""\r\n3,p,"open\r\nto the end')
    good, bad = read_csv_with_rejects(spark, str(tmp_path / "x.csv"), T.StructType.fromDDL(SCHEMA))
    assert by_id(good)[:2] == [(1, "x\r\ny", "z"), (2, None, "")]
    assert good.count() + bad.count() == 3
    (tmp_path / "only.csv").write_bytes(b"id,a,b\n")
    assert read_csv(spark, str(tmp_path / "only.csv"), SCHEMA).count() == 0


def test_failfast_raises(spark):
    path = written(spark, [("x", "a", "b")], "id string, a string, b string")
    with pytest.raises(Exception):
        read_csv(spark, path, SCHEMA).collect()


def test_inferred_types_equal_the_reference_reader(spark, tmp_path):
    pd = pytest.importorskip("pandas")
    text = ('name,whole,gap,real,flag,half,day,mixed,empty,big\n"Sport-100, Black",1,2,1.5,True,True,2024-01-05,1,,1\n'
            'x,-3,NA,2e3,False,,2024-02-01,y,NaN,99999999999999999999\n"a\nb",+4,5,.5,true,false,2024-03-01,2,null,3\n')
    (tmp_path / "t.csv").write_text(text)
    out = read_csv_inferred(spark, str(tmp_path / "t.csv"))
    assert dict(out.dtypes) == {"name": "string", "whole": "bigint", "gap": "double", "real": "double", "flag": "boolean", "half": "boolean",
                                "day": "string", "mixed": "string", "empty": "double", "big": "double"}
    want = pd.read_csv(tmp_path / "t.csv")
    kinds = {"int64": "bigint", "float64": "double", "bool": "boolean"}
    for c in ("whole", "gap", "real", "flag", "empty"):
        assert kinds[str(want[c].dtype)] == dict(out.dtypes)[c]
    for c in ("name", "day", "mixed"):
        assert want[c].dtype not in ("int64", "float64", "bool")
    got = out.orderBy("whole").collect()
    assert [r["gap"] for r in got] == [None, 2.0, 5.0] and [r["name"] for r in got] == ["x", "Sport-100, Black", "a\nb"]
    assert dict(read_csv_inferred(spark, str(tmp_path / "t.csv"), dates=True).dtypes)["day"] == "date"
    assert [r["day"] for r in read_csv_inferred(spark, str(tmp_path / "t.csv"), dates=True).orderBy("day").collect()][0] == dt.date(2024, 1, 5)


def test_export_of_a_query_result_infers_name_and_amount(spark):
    path = written(spark, [("Hitch Rack - 4-Bike", 1200.0), ("Sport-100 Helmet, Black", 1189.66)], "ProductName string, TotalSales double")
    assert read_csv(spark, path).dtypes == [("ProductName", "string"), ("TotalSales", "double")]


def test_types_merge():
    assert [inferred_type(k, m) for k, m in [(15, False), (15, True), (3, False), (3, True), (2, False), (4, True), (8, False), (0, False)]] == [
        "bigint", "double", "bigint", "double", "double", "boolean", "string", "string"]
    assert inferred_type(8, False, dates=True) == "date"


def test_short_rows_are_filled_and_long_rows_raise(spark, tmp_path):
    (tmp_path / "s.csv").write_text("a,b\n1,2\n3\n")
    assert by_id(read_csv_inferred(spark, str(tmp_path / "s.csv"))) == [(1, 2.0), (3, None)]
    (tmp_path / "l.csv").write_text("a,b\n1,2\n3,4,5\n")
    with pytest.raises(Exception, match="more fields"):
        read_csv_inferred(spark, str(tmp_path / "l.csv"))


def test_export_runs_the_plan_once_and_leaves_nothing_when_empty(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    root = f"{storage_root(spark)}/exports/{tablejobs._run_name('once')}"
    df = spark.range(50).mapInPandas(count, "id long")
    assert export_csv(df, f"{root}/full") and seen.value == 50
    assert not export_csv(df.where("id < 0"), f"{root}/none")
    jvm = spark.sparkContext._jvm
    fs = jvm.org.apache.hadoop.fs.Path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    assert [f.getPath().getName() for f in fs.listStatus(jvm.org.apache.hadoop.fs.Path(root))] == ["full"]
    assert export_csv(spark.range(3), f"{root}/full") and read_csv(spark, f"{root}/full", "id long").count() == 3
