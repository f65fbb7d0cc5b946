"""Insert, update, delete and upsert as pure changes of a table, and their publication.

A change gives the table as it would be and the rows that it touched; publish() writes it to a new
folder and names it current, so that readers see the old table or the new one.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.catalog import Table


@dataclass(frozen=True)
class Change:
    """The table after a change, and the rows to return: new values, of a delete the old ones."""

    table: DataFrame
    returning: DataFrame


def complete(new: DataFrame, old: DataFrame, table: Table) -> DataFrame:
    """new with all columns of old: those it lacks get the table's default, or null."""
    return new.select(*[F.col(c).cast(t) if c in new.columns else F.lit(table.defaults.get(c)).cast(t).alias(c) for c, t in old.dtypes])


def insert(old: DataFrame, new: DataFrame, table: Table) -> Change:
    rows = complete(new, old, table)
    return Change(old.unionByName(rows), rows)


def _one_each(rows: DataFrame, keys: list[str], last: bool = False) -> DataFrame:
    """The first of the rows with equal keys, by their other columns, or the last."""
    others = [c for c in rows.columns if c not in keys]
    order = [F.col(c).desc() if last else F.col(c) for c in others] or [F.lit(0)]
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def insert_or_ignore(old: DataFrame, new: DataFrame, table: Table, target: tuple[str, ...] = ()) -> Change:
    """ON CONFLICT DO NOTHING: rows whose key is there are left out."""
    keys = list(target or table.key)
    rows = _one_each(complete(new, old, table), keys).join(old.select(*keys), keys, "left_anti").select(*old.columns)
    return Change(old.unionByName(rows), rows)


def replace(old: DataFrame, new: DataFrame, table: Table, order: Column | None = None) -> Change:
    """REPLACE: new rows take the place of those with their key; of new rows with one key the last by order (or by their other columns) stays."""
    keys = list(table.key)
    if order is not None:
        last = Window.partitionBy(*keys).orderBy(order.desc())
        new = new.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")
    rows = _one_each(complete(new, old, table), keys, last=True)
    return Change(old.join(rows.select(*keys), keys, "left_anti").select(*old.columns).unionByName(rows), rows)


def _once(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows, which fail when they are read if a key without null stands twice."""
    whole = reduce(and_, [F.col(k).isNotNull() for k in keys])
    counted = rows.withColumn("_n", F.when(whole, F.count("*").over(Window.partitionBy(*keys))))
    return counted.where(F.when(F.col("_n") > 1, F.raise_error(F.lit("a row cannot be affected a second time: two new rows have one key")).cast("boolean")).otherwise(True)).drop("_n")


def upsert(old: DataFrame, new: DataFrame, table: Table, changes: dict[str, Column], target: tuple[str, ...] = (), target_where: Column | None = None, where: Column | None = None) -> Change:
    """ON CONFLICT (target) WHERE target_where DO UPDATE SET changes WHERE where.

    changes and where are over old.column and excluded.column. With target_where, which is over the
    table's columns, only rows that fulfil it can conflict, as with a partial unique index; others
    are added. Where a conflict's where isn't true the old row stays and isn't returned. Two new
    rows with one key are an error.
    """
    keys = list(target or table.key)
    rows = complete(new, old, table)
    apt = F.lit(True) if target_where is None else F.coalesce(target_where, F.lit(False))
    held, free = old.where(apt), old.where(~apt)
    new_held, new_free = _once(rows.where(apt), keys), rows.where(~apt)
    pair = held.alias("old").join(new_held.alias("excluded"), [F.col(f"old.{k}") == F.col(f"excluded.{k}") for k in keys], "inner")
    hit = F.lit(True) if where is None else F.coalesce(where, F.lit(False))
    updated = pair.select(*[F.when(hit, changes[c].cast(t)).otherwise(F.col(f"old.{c}")).alias(c) if c in changes else F.col(f"old.{c}") for c, t in old.dtypes], hit.alias("_hit"))
    added = new_held.join(held.select(*keys), keys, "left_anti").select(*old.columns).unionByName(new_free)
    kept = held.join(new_held.select(*keys), keys, "left_anti").select(*old.columns).unionByName(free)
    return Change(kept.unionByName(updated.drop("_hit")).unionByName(added), updated.where("_hit").drop("_hit").unionByName(added))


def update(old: DataFrame, changes: dict[str, Column], where: Column | None = None, keep_old: bool = False) -> Change:
    """SET all changes from the old values, where the condition is true. An empty change is an error. keep_old adds a struct of the old row to what is returned."""
    if not changes:
        raise ValueError("there are no changes to save")
    hit = F.lit(True) if where is None else F.coalesce(where, F.lit(False))
    marked = old.withColumn("_hit", hit)
    new = marked.select(*[F.when(F.col("_hit"), changes[c]).otherwise(F.col(c)).cast(t).alias(c) if c in changes else F.col(c) for c, t in old.dtypes], "_hit", F.struct(*old.columns).alias("old"))
    returned = new.where("_hit").drop("_hit")
    return Change(new.drop("_hit", "old"), returned if keep_old else returned.drop("old"))


def update_batch(old: DataFrame, changes: DataFrame, table: Table, cleared: dict[str, Column] | None = None) -> Change:
    """One set of changes for each key: null leaves a value as it is, unless cleared says for the column, over those of changes, that it becomes null."""
    keys, cleared = list(table.key), cleared or {}
    renamed = changes.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in changes.columns if c not in keys], *[F.coalesce(x, F.lit(False)).alias(f"_no_{c}") for c, x in cleared.items()], F.lit(True).alias("_hit"))
    joined = old.join(renamed, keys, "left")

    def value(c: str, kind: str) -> Column:
        out = F.coalesce(F.col(f"_new_{c}"), F.col(c)) if c in changes.columns and c not in keys else F.col(c)
        return (F.when(~F.coalesce(F.col(f"_no_{c}"), F.lit(False)), out) if c in cleared else out).cast(kind).alias(c)

    new = joined.select(*[value(c, t) for c, t in old.dtypes], "_hit")
    return Change(new.drop("_hit"), new.where("_hit").drop("_hit"))


def delete(old: DataFrame, where: Column | None = None) -> Change:
    hit = F.lit(True) if where is None else F.coalesce(where, F.lit(False))
    return Change(old.where(~hit), old.where(hit))


def publish(change: Change, folder: str, version: int) -> str:
    """Write the table as a version of folder. Readers of other versions go on undisturbed."""
    path = f"{folder}/v{version:06d}"
    change.table.write.parquet(path)
    return path


def latest(spark: SparkSession, folder: str) -> DataFrame:
    """The greatest version in folder that was written to its end."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    done = [s.getPath().toString() for s in fs.listStatus(path) if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    return spark.read.parquet(max(done))
