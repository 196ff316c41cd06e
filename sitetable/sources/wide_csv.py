"""CSV files with quoted line breaks, read by many tasks per file.

A line break ends a record only outside of quotes, so a task that starts in the middle of a file cannot tell by itself
where its first record begins. Files are read as lines in byte ranges, twice: first every range counts its
quotes (a value's own quotes are doubled, so an odd count flips inside and outside), and the counts before a range,
one number per range, tell on which side it starts. Then the lines of a range are put together to records; the
pieces of the few records that cross from range to range, two a range at most, are joined by a small shuffle.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

cloudpickle.register_pickle_by_value(sys.modules[__name__])

_PIECES = "file string, start long, crossing boolean, opens boolean, first boolean, text string"


def _lines(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Lines in the order of the file within each byte range; a line lies in the range where it starts."""
    text = spark.read.option("lineSep", "\n").option("recursiveFileLookup", True).text(list(paths))
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")


def odd_ranges(lines: DataFrame) -> set[tuple[str, int]]:
    """The ranges that start inside quotes: one row per byte range reaches the driver."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    flips = lines.groupBy("file", "start").agg((F.sum(quotes) % 2).alias("odd"))
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    inside = flips.withColumn("inside", F.coalesce(F.sum("odd").over(before) % 2, F.lit(0)))
    return {(r["file"], r["start"]) for r in inside.filter("inside = 1").select("file", "start").collect()}


def _records(inside: set[tuple[str, int]]):
    """Lines of a task to records, and to pieces of records that begin or end in another range."""
    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the record that is being read, whether it began in this range, and whether it is the file's first
        place, open_, begun, first, held = None, False, False, False, []

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [()] * 6
            kinds = [pa.string(), pa.int64(), pa.bool_(), pa.bool_(), pa.bool_(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                                              ["file", "start", "crossing", "opens", "first", "text"])

        def rest() -> list[tuple]:
            return [(*place, True, begun, first, "\n".join(held))] if held else []

        for batch in batches:
            odd = pc.equal(pc.bit_wise_and(pc.count_substring(batch.column(2), '"'), 1), 1).to_pylist()
            out: list[tuple] = []
            for file, start, line, flips in zip(*(batch.column(i).to_pylist() for i in range(3)), odd, strict=True):
                if (file, start) != place:
                    out += rest()
                    place, held, first = (file, start), [], start == 0
                    open_ = place in inside
                    begun = not open_
                held.append(line)
                open_ ^= flips
                if not open_:
                    out.append((file, start, not begun, False, first, "\n".join(held)))
                    held, begun, first = [], True, False
            yield batch_of(out)
        yield batch_of(rest())
    return assemble


def read_wide_csv(spark: SparkSession, paths: Sequence[str], schema: T.StructType, header: bool = True,
                  options: dict | None = None) -> DataFrame:
    """``row``, the given columns of a record, and ``_file``, of CSV files; every file starts with a header line if ``header``.

    Quotes are those of ``"``, doubled inside a value; a quote may stand in quoted values only. Records come in any
    order; blank records are skipped; a value's line breaks are kept as they are.
    """
    lines = _lines(spark, paths)
    pieces = lines.mapInArrow(_records(odd_ranges(lines)), _PIECES)
    whole = pieces.filter(~F.col("crossing") & ~(F.lit(header) & F.col("first"))).select("file", "text")
    # a crossing record: the piece that opens it, pieces of ranges wholly inside it, the piece that ends it
    order = Window.partitionBy("file").orderBy("start", "opens").rowsBetween(Window.unboundedPreceding, 0)
    crossing = pieces.filter("crossing").withColumn("record", F.sum(F.col("opens").cast("long")).over(order))
    joined = (crossing.groupBy("file", "record").agg(F.array_sort(F.collect_list(F.struct("start", "opens", "text"))).alias("p"),
                                                     F.max("first").alias("first"))
              .filter(~(F.lit(header) & F.col("first"))).select("file", F.array_join(F.transform("p", lambda p: p["text"]), "\n").alias("text")))
    records = whole.unionAll(joined).select("file", F.rtrim(F.col("text"), F.lit("\r")).alias("text")).filter("trim(text) <> ''")
    columns = ", ".join("`" + f.name.replace("`", "``") + "` " + f.dataType.simpleString() for f in schema.fields)
    given = {"escape": '"', "multiLine": True} | (options or {})  # multiLine: a value's line breaks stay as they are
    return records.select(F.from_csv("text", columns, given).alias("row"), F.col("file").alias("_file"))
