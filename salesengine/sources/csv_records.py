"""Records of CSV files with line breaks inside quotes, read by many tasks.

A large file is read in blocks, as Spark's text reader splits it.  Whether a block
begins inside a quoted field is the parity of the quotes before it in its file
(a doubled quote inside a field doesn't change it), so it follows from one count a
block.  Knowing that, each task puts the lines of its blocks together to
records; only what a block's border cuts, two pieces a block at most, is joined
with its other part by file and block.

The files are read twice: once for the counts, once for the records.  Quotes must be
those of RFC 4180, i.e. stand around whole fields; a file that ends inside
quotes ends with one long record, which won't parse.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from salesengine.session import reliable_checkpoint

WHOLE, HEAD, MIDDLE, TAIL = "whole", "head", "middle", "tail"
_PIECES = "file string, block long, kind string, first boolean, text string"


def _assembled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of each block's lines, and the pieces at its borders; ``first`` marks what the block begins with."""
    out: list[tuple] = []
    place, lines, inside, headed, first = None, [], False, False, True

    def put(kind: str) -> None:
        nonlocal lines, first
        out.append((*place, kind, first, "\n".join(lines) if len(lines) > 1 else lines[0]))
        lines, first = [], False

    def flushed() -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) if out else [[]] * 5
        out.clear()
        types = (pa.string(), pa.int64(), pa.string(), pa.bool_(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["file", "block", "kind", "first", "text"])

    for batch in batches:
        odd = pc.equal(pc.bit_wise_and(pc.count_substring(batch.column("value"), '"'), 1), 1).to_pylist()
        columns = (batch.column(c).to_pylist() for c in ("file", "block", "inside", "value"))
        for file, block, begins_inside, value, turns in zip(*columns, odd, strict=True):
            if (file, block) != place:
                if lines:
                    put(MIDDLE if headed else TAIL)
                place, inside, headed, first = (file, block), begins_inside, begins_inside, True
            lines.append(value)
            inside ^= turns
            if not inside:
                put(HEAD if headed else WHOLE)
                headed = False
        yield flushed()
    if lines:
        put(MIDDLE if headed else TAIL)
    yield flushed()


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """file, block, kind, first, text of every record and of the pieces of records that a block's border cuts."""
    read = spark.read.option("lineSep", "\n").text(path)
    lines = read.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    counts = lines.groupBy("file", "block").agg((F.sum(quotes) % 2).alias("odd"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    # one row a block of the reader; the join must leave the lines in their order, as a broadcast does
    starts = counts.select("file", "block", (F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2 == 1).alias("inside"))
    return lines.join(F.broadcast(starts), ["file", "block"]).select("file", "block", "inside", "value").mapInArrow(_assembled, _PIECES)


def joined(cut: DataFrame) -> DataFrame:
    """file, block (where it begins), first, text of the records that ``pieces`` (other than whole ones) make up."""
    late = F.when(F.col("kind") == TAIL, 1).otherwise(0)
    along = Window.partitionBy("file").orderBy("block", late).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = cut.withColumn("late", late).withColumn("record", F.sum("late").over(along))
    parts = F.sort_array(F.collect_list(F.struct("block", "late", "text")))
    out = numbered.groupBy("file", "record").agg(parts.alias("parts"), F.min_by("first", F.struct("block", "late")).alias("first"))
    return out.select("file", F.col("parts")[0]["block"].alias("block"), "first", F.array_join(F.transform("parts", lambda p: p["text"]), "\n").alias("text"))


def _row(text: Column, name: str = "text") -> Column:
    """A record (column ``name``) without the carriage return of its line's end."""
    return F.when(F.substring(text, -1, 1) == "\r", F.expr(f"left({name}, length({name}) - 1)")).otherwise(text)


def parsed(spark: SparkSession, path: str, parse, header: bool = True) -> DataFrame:
    """``parse`` (Column of a record -> Column) of every record of the files, as column ``row``; headers and empty lines are left out.

    The records are parsed once, into the shared checkpoint folder.
    """
    header_row = F.col("first") & (F.col("block") == 0) if header else F.lit(False)
    some = ~header_row & (F.length("text") > 0)
    found = pieces(spark, path).withColumn("text", F.when(F.col("kind") == WHOLE, _row(F.col("text"))).otherwise(F.col("text")))
    found = found.where((F.col("kind") != WHOLE) | some)
    whole = F.col("kind") == WHOLE
    kept = reliable_checkpoint(found.select(
        "file", "block", "kind", "first", F.when(~whole, F.col("text")).alias("text"), F.when(whole, parse(F.col("text"))).alias("row")))
    cut = joined(kept.where(~whole).drop("row")).withColumn("text", _row(F.col("text"))).where(some)
    return kept.where(whole).select("row").unionByName(cut.select(parse(F.col("text")).alias("row")))


def header(spark: SparkSession, path: str) -> str:
    """The first line of one of the files."""
    lines = spark.read.option("lineSep", "\n").text(path).where("_metadata.file_block_start = 0")
    row = lines.select(_row(F.col("value"), "value").alias("text")).first()
    return row["text"] if row else ""
