"""Keyed table operations: insert-if-absent, upsert, cascading delete, checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitetable.schemas import CASCADE, LENGTHS, TABLES


def quoted(names: Sequence[str]) -> list[Column]:
    """Columns by their literal names, dots included."""
    return [F.col(f"`{name}`") for name in names]


def one_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str] = (), last: bool = True) -> DataFrame:
    """One row per key: the last (or first) by ``order``. Aggregated partially, so copies never pile up."""
    if not order:
        return df.dropDuplicates(list(keys))
    rest = [c for c in df.columns if c not in keys]
    pick = F.max_by if last else F.min_by
    best = df.groupBy(*quoted(keys)).agg(pick(F.struct(*quoted(rest)), F.struct(*quoted(order))).alias("_row"))
    return best.select(*[F.col(f"`{c}`") if c in keys else F.col("_row").getField(c).alias(c) for c in df.columns])


def insert_absent(target: DataFrame, rows: DataFrame, keys: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """The rows whose key is not in ``target`` yet, one per key (the first by ``order``); append them."""
    return one_per_key(rows, keys, order, last=False).join(target.select(*quoted(keys)), list(keys), "left_anti") \
        .select(*quoted(rows.columns))


def get_or_create(target: DataFrame, rows: DataFrame, keys: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """Target plus the absent rows; existing rows win and are not updated."""
    return target.unionByName(insert_absent(target, rows, keys, order), allowMissingColumns=True)


def upsert(target: DataFrame, updates: DataFrame, keys: Sequence[str], set_cols: Sequence[str],
           order: Sequence[str] = ()) -> DataFrame:
    """Target with ``set_cols`` taken from matching updates and new keys inserted whole.

    Columns outside ``set_cols`` (id, created_at ...) keep the target's values.
    Several updates of one key: the last by ``order`` applies.
    """
    # a struct key compares null-safely, and the updates, grouped by it, are joined without another shuffle
    new = one_per_key(updates.withColumn("_key", F.struct(*quoted(keys))), ["_key"], order)
    joined = target.withColumn("_old", F.lit(True)).withColumn("_key", F.struct(*quoted(keys))).alias("t").join(
        new.withColumn("_new", F.lit(True)).alias("u"), "_key", "full_outer")

    def value(name: str) -> Column:
        if name not in new.columns:
            return F.col(f"t.`{name}`")
        if name in set_cols:
            return F.when(F.col("_new"), F.col(f"u.`{name}`")).otherwise(F.col(f"t.`{name}`"))
        return F.when(F.col("_old"), F.col(f"t.`{name}`")).otherwise(F.col(f"u.`{name}`"))

    return joined.select(*[value(c).alias(c) for c in target.columns])


def delete_cascade(tables: Mapping[str, DataFrame], table: str, ids: DataFrame) -> dict[str, DataFrame]:
    """Delete rows by id and follow the declared references: children go too, or lose their link."""
    left = dict(tables)
    gone = {table: ids.select("id").distinct()}
    left[table] = tables[table].join(gone[table], "id", "left_anti")
    for name, spec in TABLES.items():  # declared parents first
        if name not in tables or name == table:
            continue
        df = tables[name]
        columns = df.columns
        for column, (parent, action) in spec.references.items():
            if parent not in gone or column not in columns:
                continue
            dead = gone[parent].select(F.col("id").alias(column))
            if action == CASCADE:
                gone[name] = df.join(dead, column, "left_semi").select("id")
                df = df.join(dead, column, "left_anti")
            else:
                df = (df.join(dead.withColumn("_dead", F.lit(True)), column, "left")
                        .withColumn(column, F.when(F.col("_dead").isNull(), F.col(column))).drop("_dead"))
        left[name] = df.select(*columns)
    return left


def violations(tables: Mapping[str, DataFrame]) -> DataFrame:
    """All breaches of the declared rules: (table_name, rule, column_name, key, n_rows).

    Values are counted before they are compared with a parent table, so a key
    that most rows share is looked up once.
    """
    found: list[DataFrame] = []

    def add(df: DataFrame, table: str, rule: str, column: str, key: Column) -> None:
        found.append(df.select(F.lit(table).alias("table_name"), F.lit(rule).alias("rule"),
                               F.lit(column).alias("column_name"), key.cast("string").alias("key"),
                               F.col("n").alias("n_rows")))

    for name, df in tables.items():
        spec = TABLES[name]
        # required and domain rules in one pass: each row gives its few breaches, counted before they move
        tests = [("required", c, F.col(c).isNull(), F.lit(None)) for c in spec.required if c in df.columns]
        tests += [("domain", c, ~F.col(c).isin(*domain), F.col(c)) for c, domain in spec.domains.items() if c in df.columns]
        # a value that is too long is told by its length
        tests += [("length", c, F.length(c) > n, F.length(c)) for c, n in LENGTHS.get(name, {}).items() if c in df.columns]
        if tests:
            breaches = F.array_compact(F.array(*[F.when(test, F.struct(
                F.lit(rule).alias("rule"), F.lit(c).alias("c"), key.cast("string").alias("key")))
                for rule, c, test, key in tests]))
            counted = df.select(F.explode(breaches).alias("b")).groupBy("b").agg(F.count("*").alias("n_rows"))
            found.append(counted.select(F.lit(name).alias("table_name"), "b.rule", F.col("b.c").alias("column_name"),
                                        "b.key", "n_rows"))
        for key in spec.unique:
            if set(key) <= set(df.columns):
                twice = df.dropna(subset=list(key)).groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1")
                add(twice, name, "unique", ",".join(key), F.concat_ws(",", *key))
        for column, (parent, _) in spec.references.items():
            if column in df.columns and parent in tables:
                used = df.dropna(subset=[column]).groupBy(column).agg(F.count("*").alias("n"))
                orphans = used.join(tables[parent].select(F.col("id").alias(column)), column, "left_anti")
                add(orphans, name, "reference", column, F.col(column))
    out = found[0]
    for df in found[1:]:
        out = out.unionByName(df)
    return out
