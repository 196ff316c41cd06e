"""Sync targets: CSV and Parquet folders, text-typed tables and JDBC databases.

A target keeps one folder (or database table) per table name. Its parts are listed in a commit log (``tablelog``), with
their columns and row counts: reads are planned from it, and writers that meet lose nothing. Appends align columns by
name; columns that are new to the table are added at its end. An append that is run again under the same ``part`` name
replaces itself instead of doubling.

The first upsert puts a table into buckets by a hash of its key. From then on an upsert writes the rows it was given, as
a delta in the buckets they belong to, and leaves all other files alone; reads merge deltas into the buckets that
have any, the newest value of each column winning, and a bucket with ``MOST_DELTAS`` of them is rewritten on its own.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable, Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitetable.functions.text import as_text
from sitetable.operators.tables import one_per_key, quoted
from sitetable.session import matching, read_or_none, remove
from sitetable.sources.tablelog import DELTA, ROWS, Entry, Part, State, TableLog, new_folder
from sitetable.sources.wide_csv import read_wide_csv

N_BUCKETS, MOST_DELTAS = 16, 8


def all_text(df: DataFrame) -> DataFrame:
    """Every column as text, nested values as JSON."""
    return df.select(*[as_text(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields])


def append_union(existing: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows added to a table by column name; gaps on either side become null."""
    return existing.unionByName(rows, allowMissingColumns=True)


_WIDER = (T.ByteType(), T.ShortType(), T.IntegerType(), T.LongType(), T.DoubleType())


def _fits(given: T.DataType, stored: T.DataType) -> bool:
    """May a value of one type be stored as the other without loss?"""
    if given == stored or isinstance(given, T.NullType):
        return True
    if isinstance(stored, T.StringType):
        return isinstance(given, T.AtomicType)
    if isinstance(given, T.LongType) or given not in _WIDER:
        return isinstance(given, T.FloatType) and isinstance(stored, T.DoubleType)
    return stored in _WIDER[_WIDER.index(given):]


def aligned(rows: DataFrame, stored: T.StructType) -> DataFrame:
    """Rows in the types of the stored columns; a column that would lose something is refused."""
    known = {f.name: f.dataType for f in stored.fields}
    bad = [f"{f.name}: {f.dataType.simpleString()} into {known[f.name].simpleString()}" for f in rows.schema.fields
           if f.name in known and not _same(f.dataType, known[f.name]) and not _fits(f.dataType, known[f.name])]
    if bad:
        raise ValueError("column types do not fit the table: " + "; ".join(bad))
    return rows.select(*[(F.col(f"`{f.name}`").cast(known[f.name]) if f.name in known and not _same(f.dataType, known[f.name])
                          else F.col(f"`{f.name}`")).alias(f.name) for f in rows.schema.fields])


def _same(one: T.DataType, other: T.DataType) -> bool:
    """Equal types, whatever they say about nulls."""
    return one.simpleString() == other.simpleString()


def _types_hold(rows: T.StructType, table: T.StructType) -> bool:
    known = {f.name: f.dataType for f in table.fields}
    return all(f.name not in known or _same(f.dataType, known[f.name]) for f in rows.fields)


def _widened(table: T.StructType, rows: T.StructType) -> T.StructType:
    new = [T.StructField(f.name, f.dataType) for f in rows.fields if f.name not in table.names]
    return T.StructType([*table.fields, *new])


def _counted(df: DataFrame, rows: Observation) -> DataFrame:
    return df.observe(rows, F.count(F.lit(1)).alias("rows"))


def bucket_of(keys: Sequence[str], n_buckets: int) -> Column:
    """The bucket of a row by its key values, in the table's stored types."""
    return F.pmod(F.xxhash64(*quoted(keys)), F.lit(n_buckets)).cast("int")


def _look_up(values: dict, kind: str) -> Column:
    """The value listed for a row's ``_folder``."""
    pairs = [x for folder, v in values.items()
             for x in (F.lit(folder), F.array(*map(F.lit, v)) if isinstance(v, list) else F.lit(v))]
    return F.try_element_at(F.create_map(*pairs), F.col("_folder")).cast(kind) if pairs else F.lit(None).cast(kind)


FOREIGN = "/foreign"  # among the merged names: files of others have become rows of a part


class FolderTarget:
    """Tables as folders under one path; subclasses say how a folder is read and written."""

    FORMAT, OPTIONS, SUFFIX = "", {}, ""

    def __init__(self, spark: SparkSession, path: str, n_buckets: int = N_BUCKETS):
        self.spark, self.path, self.n_buckets = spark, path.rstrip("/"), n_buckets
        self._logs: dict[str, TableLog] = {}

    def folder(self, table: str) -> str:
        return f"{self.path}/{table}"

    def log(self, table: str) -> TableLog:
        return self._logs.setdefault(table, TableLog(self.spark, self.folder(table)))

    def prepare(self, df: DataFrame) -> DataFrame:
        return df

    # -- files ---------------------------------------------------------------------

    def _layout(self, part: Part) -> tuple:
        """Parts of one layout are read together."""
        return ()

    def _open(self, paths: list[str], layout: tuple, schema: T.StructType) -> DataFrame:
        """Files of a layout: ``_row``, where columns may be missing, and ``_path``."""
        raise NotImplementedError

    def _load(self, paths: list[str]) -> DataFrame:
        """Files that have their own column names."""
        return self.spark.read.format(self.FORMAT).load(paths)

    def _foreign(self, table: str, state: State) -> DataFrame | None:
        """Files that others put into the table's folder."""
        found = [] if FOREIGN in state.merged else matching(self.spark, f"{self.folder(table)}/*{self.SUFFIX}")
        return read_or_none(lambda: self._load(found)) if found else None

    def _write(self, df: DataFrame, table: str, kind: str, keys: Sequence[str] | None, n_buckets: int, **about) -> Part:
        """Write a folder that no log lists yet. Spark deals the buckets out and splits those that are too large."""
        folder, seen = new_folder(), Observation()
        path, texts = f"{self.folder(table)}/{folder}", [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
        breaks = functools.reduce(Column.__or__, [F.coalesce(F.col(f"`{c}`").rlike("[\r\n]"), F.lit(False)) for c in texts], F.lit(False))
        out = df.observe(seen, F.count(F.lit(1)).alias("rows"), F.max(breaks if self.FORMAT == "csv" else F.lit(False)).alias("breaks"))
        held = None
        if not keys:
            out.write.format(self.FORMAT).options(**self.OPTIONS).save(path)
        else:
            placed = out.withColumn("_bucket", bucket_of(keys, n_buckets)).hint("rebalance", "_bucket")
            placed.write.format(self.FORMAT).options(**self.OPTIONS).partitionBy("_bucket").save(path)
            held = tuple(sorted(int(p.rsplit("=", 1)[1]) for p in matching(self.spark, f"{path}/_bucket=*")))
        return Part(folder, kind, seen.get["rows"], tuple(df.columns), keys=tuple(keys) if keys else None, n_buckets=n_buckets,
                    buckets=held, one_line=not seen.get["breaks"], **about)

    def _drop(self, table: str, folders: Sequence[str]) -> None:
        for folder in folders:
            remove(self.spark, f"{self.folder(table)}/{folder}")

    def _scan(self, table: str, state: State, parts: Sequence[Part], buckets: set[int] | None = None) -> DataFrame | None:
        """Rows of parts (of these buckets only, if given): ``_row``, and ``_folder``, the part they are from."""
        layouts: dict[tuple, list[str]] = {}
        for p in parts:
            path = f"{self.folder(table)}/{p.folder}"
            if p.buckets is not None and (p.cut or buckets is not None and not buckets >= set(p.buckets)):
                paths = [f"{path}/_bucket={b}" for b in p.buckets if buckets is None or b in buckets]
            else:
                paths = [path] if p.rows else []
            layouts.setdefault(self._layout(p), []).extend(paths)
        scans = []
        for layout, paths in layouts.items():
            if paths:
                found = self._open(paths, layout, state.schema)
                held = found.schema["_row"].dataType.names
                row = [(F.col("_row").getField(f.name) if f.name in held else F.lit(None).cast(f.dataType)).alias(f.name)
                       for f in state.schema.fields]
                scans.append(found.select(F.struct(*row).alias("_row"),
                                          F.regexp_extract("_path", "/(part=[0-9a-f]+)/", 1).alias("_folder")))
        return functools.reduce(DataFrame.unionAll, scans) if scans else None

    # -- reading -------------------------------------------------------------------

    def _empty(self, schema: T.StructType) -> DataFrame:
        return self.spark.createDataFrame([], schema)

    def _merged(self, table: str, state: State, buckets: set[int], loose: Sequence[Part] = ()) -> DataFrame:
        """The rows of these buckets (and of loose parts) with the deltas applied."""
        names = state.schema.names
        deltas = [p for p in state.of_kind(DELTA) if buckets & set(p.buckets)]
        rows = [p for p in state.of_kind(ROWS) if p not in loose and p.buckets and buckets & set(p.buckets)]
        held, change = self._scan(table, state, [*rows, *loose], buckets), self._scan(table, state, deltas, buckets)
        nothing = self._empty(T.StructType([T.StructField("_row", state.schema), T.StructField("_folder", T.StringType())]))
        held, change = nothing if held is None else held, nothing if change is None else change
        # equal structs are equal null for null
        key = F.struct(*[F.col("_row").getField(k).alias(k) for k in state.keys]).alias("_key")
        held = held.select(key, "_row", _look_up({p.folder: p.at for p in [*rows, *loose]}, "long").alias("_at"))
        delta = F.struct(_look_up({p.folder: p.at for p in deltas}, "long").alias("_at"),
                         _look_up({p.folder: list(p.columns) for p in deltas}, "array<string>").alias("_has"), "_row")
        changes = (change.select(key, delta.alias("_d")).groupBy("_key")
                   .agg(F.array_sort(F.collect_list("_d"), lambda a, b: (a["_at"] - b["_at"]).cast("int")).alias("_deltas")))

        def newest(c: str) -> Column:
            return F.aggregate("_since", F.col("_row").getField(c), lambda v, d: F.when(
                F.array_contains(d["_has"], c), d["_row"].getField(c)).otherwise(v)).alias(c)

        later = F.filter(F.coalesce("_deltas", F.array()), lambda d: d["_at"] > F.col("_at"))
        changed = held.join(changes, "_key", "left").select("_row", later.alias("_since"))
        first = changes.withColumn("_first", F.col("_deltas")[0]["_at"])
        before = held.select(F.col("_key").alias("_old"), F.col("_at").alias("_old_at"))
        new = first.join(before, (F.col("_key") == F.col("_old")) & (F.col("_old_at") < F.col("_first")), "left_anti")
        none = F.struct(*[F.lit(None).cast(f.dataType).alias(f.name) for f in state.schema.fields])
        new = new.select(none.alias("_row"), F.col("_deltas").alias("_since"))
        return changed.select(*map(newest, names)).unionAll(new.select(*map(newest, names)))

    def _rows(self, table: str, state: State) -> DataFrame:
        dirty = {b for p in state.of_kind(DELTA) for b in p.buckets}
        loose = state.loose() if dirty else []
        settled = [p for p in state.of_kind(ROWS) if p not in loose]
        clean = self._scan(table, state, settled, {b for p in settled for b in p.buckets} - dirty if dirty else None)
        clean = self._empty(state.schema) if clean is None else clean.select("_row.*")
        return clean.unionAll(self._merged(table, state, dirty, loose)) if dirty else clean

    def read(self, table: str, limit: int | None = None) -> DataFrame | None:
        """The table, or None if nothing was written yet."""
        state = self.log(table).state()
        found = self._foreign(table, state)
        if state.version >= 0:
            own = self._rows(table, state)
            found = own if found is None else append_union(found, own)
        return found if found is None or limit is None else found.limit(limit)

    # -- writing -------------------------------------------------------------------

    def _known(self, table: str, state: State) -> T.StructType:
        foreign = self._foreign(table, state)
        return state.schema if foreign is None else _widened(foreign.schema, state.schema)

    def _commit(self, table: str, make: Callable[[State], Entry | None]) -> State | None:
        """Commit, and delete folders that commits before this one took off the list.

        What this one takes off stays for those who still read it, until the next that takes off something.
        """
        purged: tuple[str, ...] = ()

        def purging(now: State) -> Entry | None:
            nonlocal purged
            entry = make(now)
            purged = tuple(f for f, _ in now.gone) if entry is not None and entry.remove else ()
            return entry and replace(entry, purged=purged)

        done = self.log(table).commit(purging)
        if done is not None:
            self._drop(table, purged)
        return done

    def append(self, df: DataFrame, table: str, part: str | None = None) -> int:
        """Append rows; returns their number, counted while they are written.

        Values go into the stored column types; ones that do not fit are refused before anything is written.
        A part that was merged into others since is there already and is not appended again.
        """
        given = self.prepare(df)
        while True:
            state = self.log(table).state()
            rows = aligned(given, self._known(table, state))
            new = self._write(rows, table, ROWS, state.keys, state.n_buckets, name=part)

            def make(now: State, rows=rows, new=new) -> Entry | None:
                if part in now.merged or not _types_hold(rows.schema, now.schema):
                    return None
                old = tuple(f for f, p in now.parts.items() if part is not None and p.name == part)
                return Entry((new,), old, _widened(now.schema, rows.schema))

            if self._commit(table, make) is not None:
                return new.rows
            self._drop(table, [new.folder])
            if part in self.log(table).state().merged:
                return new.rows

    def upsert(self, df: DataFrame, table: str, keys: Sequence[str], order: Sequence[str] = ()) -> int:
        """Insert or replace by key; returns the number of rows given.

        Of rows that repeat a key the last by ``order`` counts. Columns that the rows lack keep their values. Only
        the buckets of the given keys get files; those with many deltas are rewritten, the others are not touched.
        """
        given, keys = self.prepare(df), tuple(keys)
        while True:
            state = self.log(table).state()
            rows, counted = aligned(given, self._known(table, state)), Observation()
            if state.keys != keys or state.loose():
                state = self._bucketed(table, keys)
            best = one_per_key(_counted(rows, counted).withColumn("_key", F.struct(*quoted(keys))), ["_key"], order)
            new = self._write(best.select(*quoted(rows.columns)), table, DELTA, keys, state.n_buckets)

            def make(now: State, rows=rows, new=new) -> Entry | None:
                if (now.keys, now.n_buckets) != (keys, new.n_buckets) or not _types_hold(rows.schema, now.schema):
                    return None
                return Entry((new,), schema=_widened(now.schema, rows.schema))

            done = self._commit(table, make)
            if done is not None:
                many = {b for b in new.buckets if sum(b in p.buckets for p in done.of_kind(DELTA)) >= MOST_DELTAS}
                if many and not done.loose():
                    self.compact(table, many)
                return counted.get["rows"]
            self._drop(table, [new.folder])

    def _bucketed(self, table: str, keys: tuple[str, ...]) -> State:
        """Put all rows of a table into buckets by its new key (or those that a writer left outside of them)."""
        while True:
            state, add = self.log(table).state(), ()
            if state.keys == keys and not state.loose():
                return state
            old = self.read(table)
            if old is not None and old.columns:
                add = (self._write(old, table, ROWS, keys, self.n_buckets, at=max(0, state.version)),)
            names = (FOREIGN, *(p.name for p in state.parts.values() if p.name is not None))
            schema = state.schema if old is None else _widened(T.StructType(), old.schema)

            def make(now: State, state=state, add=add, names=names, schema=schema) -> Entry | None:
                return Entry(add, tuple(state.parts), schema, keys, self.n_buckets, names) if now.version == state.version else None

            done = self._commit(table, make)
            if done is not None:
                return done
            self._drop(table, [p.folder for p in add])

    def compact(self, table: str, buckets: set[int]) -> bool:
        """Rewrite these buckets with their deltas applied; others may write meanwhile.

        Parts with rows in other buckets too are listed on for those only. False if another writer got there first.
        """
        state = self.log(table).state()
        old = [p for p in state.parts.values() if p.buckets and buckets & set(p.buckets)]
        if state.loose() or not any(p.kind == DELTA for p in old):
            return False
        new = self._write(self._merged(table, state, buckets), table, ROWS, state.keys, state.n_buckets, at=state.version)
        left = tuple(p.without(buckets) for p in old if set(p.buckets) - buckets)
        emptied = tuple(p.folder for p in old if not set(p.buckets) - buckets)
        names = tuple(p.name for p in old if p.name is not None)

        def make(now: State) -> Entry | None:
            if any(now.parts.get(p.folder) != p for p in old):  # another compaction, or a part that was replaced
                return None
            return Entry((new, *left), emptied, merged=names)

        if self._commit(table, make) is None:
            self._drop(table, [new.folder])
            return False
        return True

    def last_cursor(self, table: str, column: str = "updated_at") -> str | None:
        """Greatest non-empty value of the cursor column as text; None without table, column or value."""
        found = self.read(table)
        if found is None or column not in found.columns:
            return None
        return last_cursor(found, column)


class ParquetTarget(FolderTarget):
    FORMAT, SUFFIX = "parquet", ".parquet"

    def _open(self, paths, layout, schema):
        found = self.spark.read.schema(schema).option("recursiveFileLookup", True).parquet(*paths)
        return found.select(F.struct(*quoted(schema.names)).alias("_row"), F.col("_metadata.file_path").alias("_path"))


class TextTarget(ParquetTarget):
    """Every column is text, nested values are JSON; new columns appear on append."""

    def prepare(self, df):
        return all_text(df)


class CsvTarget(FolderTarget):
    """CSV files are read by position, so the log keeps the column list of every part.

    It also says whether any value of a part has a line break: files without are split at lines, the others, and those
    from elsewhere beside the parts (which have a header of their own), by ``wide_csv``.
    """

    FORMAT, SUFFIX = "csv", ".csv"
    OPTIONS = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}

    def prepare(self, df):
        return all_text(df)

    def _layout(self, part):
        return part.columns, part.one_line

    def _open(self, paths, layout, schema):
        columns, one_line = layout
        strings = T.StructType([T.StructField(c, T.StringType()) for c in columns])
        if not one_line:
            return read_wide_csv(self.spark, paths, strings).toDF("_row", "_path")
        found = self.spark.read.schema(strings).options(**self.OPTIONS, recursiveFileLookup=True).csv(paths)
        return found.select(F.struct(*quoted(columns)).alias("_row"), F.col("_metadata.file_path").alias("_path"))

    def _load(self, paths):
        columns = self.spark.read.options(**self.OPTIONS, multiLine=True).csv(paths[0]).columns
        strings = T.StructType([T.StructField(c, T.StringType()) for c in columns])
        return read_wide_csv(self.spark, paths, strings).select("row.*")


def merge_statement(table: str, staged: str, columns: Sequence[str], keys: Sequence[str], quote: str = '"') -> str:
    """One statement that inserts or replaces the rows of a staged table by key (SQL:2003 MERGE)."""
    def named(c: str) -> str:
        return quote + c.replace(quote, 2 * quote) + quote

    same = " AND ".join(f"(t.{named(k)} = s.{named(k)} OR (t.{named(k)} IS NULL AND s.{named(k)} IS NULL))" for k in keys)
    rest = [c for c in columns if c not in keys]
    update = f" WHEN MATCHED THEN UPDATE SET {', '.join(f'{named(c)} = s.{named(c)}' for c in rest)}" if rest else ""
    return (f"MERGE INTO {table} t USING {staged} s ON ({same}){update} WHEN NOT MATCHED THEN INSERT "
            f"({', '.join(map(named, columns))}) VALUES ({', '.join(f's.{named(c)}' for c in columns)})")


def partition_options(column: str, low, high, parts: int) -> dict[str, str]:
    """Options by which Spark reads a database table in ``parts`` tasks, each a range of a number or date column."""
    if parts < 1:
        raise ValueError("parts must be 1 or more")
    return {"partitionColumn": column, "lowerBound": str(low), "upperBound": str(high), "numPartitions": str(parts)}


class JdbcTarget:
    """A real database behind a JDBC url; tables are appended to in batches, by tasks that may run twice.

    An upsert writes a table of its own beside the target and merges it by one statement in the database, so a task
    that runs twice, or a job that fails, leaves the target alone.
    """

    def __init__(self, spark: SparkSession, url: str, batch_size: int = 500, partitioned: dict[str, str] | None = None, **options: str):
        self.spark, self.url, self.batch_size, self.options = spark, url, batch_size, options
        self.partitioned = partitioned or {}

    def _save(self, df: DataFrame, table: str, mode: str) -> int:
        rows = Observation()
        (_counted(df, rows).write.format("jdbc").mode(mode).option("url", self.url).option("dbtable", table)
           .option("batchsize", self.batch_size).options(**self.options).save())
        return rows.get["rows"]

    def append(self, df: DataFrame, table: str, part: str | None = None) -> int:
        return self._save(df, table, "append")

    def _execute(self, statements: Sequence[str]) -> None:
        """Run statements in one transaction, by the driver that Spark reads the url with."""
        jvm = self.spark._jvm
        properties = jvm.java.util.Properties()
        for name, value in self.options.items():
            properties.setProperty(name, value)
        connection = jvm.java.sql.DriverManager.getConnection(self.url, properties)
        try:
            connection.setAutoCommit(False)
            for text in statements:
                statement = connection.createStatement()
                statement.execute(text)
                statement.close()
            connection.commit()
        finally:
            connection.close()

    def upsert(self, df: DataFrame, table: str, keys: Sequence[str], order: Sequence[str] = ()) -> int:
        """Insert or replace by key; of rows that repeat a key the last by ``order`` counts. Returns the rows given."""
        given, staged = Observation(), f"{table}_{uuid.uuid4().hex[:12]}"
        best = one_per_key(_counted(df, given).withColumn("_key", F.struct(*quoted(keys))), ["_key"], order).select(*quoted(df.columns))
        self._save(best, staged, "overwrite")
        self._execute([merge_statement(table, staged, df.columns, keys), f"DROP TABLE {staged}"])
        return given.get["rows"]

    def read(self, table: str, limit: int | None = None) -> DataFrame | None:
        """The table: in one task, or in ranges of a column where ``partitioned`` (``partition_options``) says so."""
        found = read_or_none(lambda: self.spark.read.format("jdbc").option("url", self.url)
                             .option("dbtable", table).options(**self.options, **self.partitioned).load())
        return found if found is None or limit is None else found.limit(limit)

    def last_cursor(self, table: str, column: str = "updated_at") -> str | None:
        found = self.read(table)
        return None if found is None or column not in found.columns else last_cursor(found, column)


TARGETS = {"csv": CsvTarget, "parquet": ParquetTarget, "sqlite": TextTarget, "text": TextTarget,
           "postgres": JdbcTarget, "jdbc": JdbcTarget}


def open_target(spark: SparkSession, kind: str, path: str):
    """Target by type name, in any case; ``sqlite`` tables become text-typed Spark tables."""
    target = TARGETS.get(kind.lower())
    if target is None:
        raise ValueError(f"unsupported target type: {kind!r}")
    return target(spark, path)


def last_cursor(df: DataFrame, column: str = "updated_at") -> str | None:
    text = F.col(column).cast("string")
    return df.agg(F.max(F.when(text != "", text))).first()[0]
