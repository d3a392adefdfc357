"""CSV in and out.

Reads with a schema parse whole records, line breaks inside quotes included, and
split large files over tasks (``csv_records``); rows that don't fit come from
the same pass.  Without a schema the types are inferred as the reference's reader
infers them, in one more pass.  Writes quote every field, so text with commas,
quotes and newlines survives a round trip.
"""

from __future__ import annotations

import csv as standard

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from salesengine.session import reliable_checkpoint
from salesengine.sources import csv_records

# a field of \\N is NULL and a quoted empty field is empty text, so the two stay apart in a file; an unquoted
# empty field (other writers' NULL) is read as NULL, too
CSV_OPTIONS = {"header": "true", "multiLine": "true", "escape": '"', "quote": '"', "nullValue": "\\N", "emptyValue": ""}
# the writer trims leading/trailing blanks by default; texts must come back whole
WRITE_OPTIONS = {"quoteAll": "true", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


CORRUPT = "_corrupt_record"


def _ddl(schema: T.StructType) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)


def _parser(schema: T.StructType, mode: str):
    options = {**CSV_OPTIONS, "mode": mode, "columnNameOfCorruptRecord": CORRUPT}
    return lambda text: F.from_csv(text, _ddl(schema), options)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None,
             mode: str = "FAILFAST", multi_line: bool = True) -> DataFrame:
    """Header CSV; with ``schema`` the columns are typed on read, otherwise types are inferred (``read_csv_inferred``).

    ``multi_line=False``, for files whose texts hold no line breaks, leaves the reading to Spark's own splitting reader.
    """
    if schema is None:
        return read_csv_inferred(spark, path)
    if not multi_line:
        return spark.read.options(**CSV_OPTIONS).option("mode", mode).option("multiLine", False).schema(schema).csv(path)
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    return csv_records.parsed(spark, path, _parser(schema, mode)).select("row.*")


def read_csv_with_rejects(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """Typed read that keeps going past bad rows: (rows that parsed, rejected raw records), from one pass.

    Records whose fields do not fit the schema come back in the second frame with
    the fields that did parse and their raw text (``raw_record``), so a load can
    count them and keep them in a side table.  Nothing is collected.
    """
    with_corrupt = T.StructType(list(schema.fields) + [T.StructField(CORRUPT, T.StringType())])
    rows = csv_records.parsed(spark, path, _parser(with_corrupt, "PERMISSIVE")).select("row.*")
    good = rows.filter(F.col(CORRUPT).isNull()).drop(CORRUPT)
    return good, rows.filter(F.col(CORRUPT).isNotNull()).withColumnRenamed(CORRUPT, "raw_record")


# fixed values: the fields that the reference's reader takes for missing
MISSING = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None",
           "n/a", "nan", "null"]
TRUE, FALSE = ["True", "TRUE", "true"], ["False", "FALSE", "false"]

#: What a field can be, as bits; a column can be what all of its fields can be, so columns of parts of a file merge by AND.
_INTEGER, _FLOAT, _BOOLEAN, _DATE = 1, 2, 4, 8
_ANY = _INTEGER | _FLOAT | _BOOLEAN | _DATE
_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def _missing(c: Column) -> Column:
    return c.isNull() | c.isin(MISSING)


def _kinds(c: Column) -> Column:
    """Bits of one field; a missing one can be anything."""
    x = F.trim(c)
    whole = x.rlike("^[+-]?[0-9]+$") & x.try_cast("bigint").isNotNull()
    number = x.rlike(_NUMBER) | F.lower(x).isin("inf", "-inf", "+inf", "infinity", "-infinity", "+infinity")
    date = x.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$") & x.try_cast("date").isNotNull()
    bits = [F.when(t, F.lit(b)).otherwise(0) for t, b in ((whole, _INTEGER), (number, _FLOAT), (c.isin(TRUE + FALSE), _BOOLEAN), (date, _DATE))]
    return F.when(_missing(c), F.lit(_ANY)).otherwise(bits[0] + bits[1] + bits[2] + bits[3])


def inferred_type(kinds: int, missing: bool, dates: bool = False) -> str:
    """The type of a column from the AND of its fields' kinds: integers with missing fields are floats, as is a column of nothing else."""
    if kinds & _INTEGER and not missing:
        return "bigint"
    if kinds & _FLOAT:
        return "double"
    if kinds & _BOOLEAN:
        return "boolean"
    return "date" if dates and kinds & _DATE else "string"


def _as(c: Column, kind: str) -> Column:
    if kind == "boolean":
        value = F.when(c.isin(TRUE), True).when(c.isin(FALSE), False)
    else:
        value = c if kind == "string" else F.trim(c).cast(kind)
    return F.when(~_missing(c), value).cast(kind)


def read_csv_inferred(spark: SparkSession, path: str, dates: bool = False) -> DataFrame:
    """Header CSV with the types that its fields allow: bigint, double, boolean, with ``dates`` ISO dates, else text.

    One aggregate over all records finds them; the reference's reader (which leaves dates as text) does so in one process.
    A record with too few fields has nulls, one with too many fields raises.
    """
    names = next(standard.reader([csv_records.header(spark, path)]), [])
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names] + [T.StructField(CORRUPT, T.StringType())])
    if not names:
        return spark.createDataFrame([], T.StructType([]))
    rows = csv_records.parsed(spark, path, _parser(schema, "PERMISSIVE")).select("row.*")
    cells = [F.col(f"`{n}`") for n in names]
    many = F.col(CORRUPT).isNotNull() & cells[-1].isNotNull()
    checked = F.when(many, F.raise_error(F.concat(F.lit("more fields than columns: "), CORRUPT))).otherwise(cells[0]).alias(names[0])
    rows = reliable_checkpoint(rows.select(checked, *cells[1:]))
    found = rows.agg(*(F.bit_and(_kinds(c)).alias(f"k{i}") for i, c in enumerate(cells)), *(F.max(_missing(c)).alias(f"m{i}") for i, c in enumerate(cells))).first()
    kinds = [inferred_type(_ANY if found[f"k{i}"] is None else found[f"k{i}"], found[f"m{i}"] is not False, dates) for i in range(len(names))]
    kinds = ["string" if found[f"k{i}"] is None else k for i, k in enumerate(kinds)]  # no rows
    return rows.select(*(_as(c, k).alias(n) for c, k, n in zip(cells, kinds, names, strict=True)))


def export_csv(df: DataFrame, path: str) -> bool:
    """Write ``df`` with a header if it has rows; returns whether anything was written.

    The rows are counted as they are written, so the plan runs once; what was there is only replaced by rows, and an
    empty frame leaves no folder behind.  The files, in order of their names, keep the frame's order.
    """
    counted = Observation()
    parent, _, name = path.rstrip("/").rpartition("/")
    fresh = f"{parent}/_writing-{name}"  # readers of the parent folder skip such names
    df.observe(counted, F.count(F.lit(1)).alias("rows")).write.options(**CSV_OPTIONS).options(**WRITE_OPTIONS).mode("overwrite").csv(fresh)
    written = counted.get["rows"] > 0
    _published(df.sparkSession, fresh, path, written)
    return written


def _published(spark: SparkSession, fresh: str, path: str, keep: bool) -> None:
    """Puts the folder ``fresh`` in the place of ``path`` if it is to be kept, else takes it away."""
    jvm = spark.sparkContext._jvm
    source, target = jvm.org.apache.hadoop.fs.Path(fresh), jvm.org.apache.hadoop.fs.Path(path)
    fs = source.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if keep:
        fs.delete(target, True)
        if not fs.rename(source, target):
            raise OSError(f"{fresh} can't be renamed to {path}")
    else:
        fs.delete(source, True)
