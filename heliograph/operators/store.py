"""Writes of a keyed table, as DataFrame to DataFrame: the caller stores the result, partition by partition.

No function collects keys; all membership tests are semi- and anti-joins, so that both sides may be of any size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def distinct_rows(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row for each key: the first in `order`, which should tell all rows of a key apart."""
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rank = 1").drop("_rank")


def absent(new: DataFrame, old: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of new whose key old doesn't have: what an insert that ignores conflicts would add."""
    return new.join(old.select(*keys), keys, "left_anti")


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """old and the rows of new with other keys; of several new rows of a key the first in `order`."""
    return old.unionByName(absent(distinct_rows(new, keys, order), old, keys), allowMissingColumns=True)


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """new, and the rows of old with other keys; of several new rows of a key the first in `order` wins."""
    return absent(old, new, keys).unionByName(distinct_rows(new, keys, order), allowMissingColumns=True)


def delete_matching(old: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """old without the rows whose key is in gone."""
    return old.join(gone.select(*keys), keys, "left_anti")


def surviving(children: DataFrame, parents: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of children whose parent is there: what a cascading delete leaves."""
    return children.join(parents.select(*keys), keys, "left_semi")


def update_from(old: DataFrame, values: DataFrame, keys: list[str], column: str, value: str) -> DataFrame:
    """old with `column` replaced by values.value where its key is in values and the value isn't null."""
    new = values.select(*keys, F.col(value).alias("_new"))
    return old.join(new, keys, "left").withColumn(column, F.coalesce("_new", column)).drop("_new")


def work_queue(rows: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that have nothing in done yet."""
    return rows.join(done.select(*keys), keys, "left_anti")


def with_existence(rows: DataFrame, other: DataFrame, keys: list[str], name: str) -> DataFrame:
    """rows with a boolean column that tells whether other has their key."""
    mark = other.select(*keys).distinct().withColumn("_there", F.lit(True))
    return rows.join(mark, keys, "left").withColumn(name, F.coalesce("_there", F.lit(False))).drop("_there")


def replace_partitions(df: DataFrame, path: str, by: str) -> None:
    """Overwrites the partitions that df has rows of, and no others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def truncate_and_load(df: DataFrame, path: str, by: str | None = None) -> None:
    """Replaces all that is stored at path, partitions that df has no rows of included."""
    writer = df.write.mode("overwrite").option("partitionOverwriteMode", "static")
    (writer.partitionBy(by) if by else writer).parquet(path)


def write_json(df: DataFrame, path: str) -> None:
    """A line of JSON for each row, nulls included; numbers that JSON doesn't have (nan, infinities) are null."""
    for f in df.schema:
        if f.dataType.typeName() in ("double", "float"):
            df = df.withColumn(f.name, F.when(F.abs(F.col(f.name)) < float("inf"), F.col(f.name)))
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def export_csv(df: DataFrame, path: str, by: str, key: str) -> None:
    """A CSV folder of all rows, the greatest `by` first and ties by key; parts are in order too."""
    df.orderBy(F.desc_nulls_last(by), key).write.mode("overwrite").csv(path, header=True)


def enriched(df: DataFrame, values: DataFrame, key: str, column: str) -> DataFrame:
    """df with `column` of values for its key, replacing one of that name; null where there is none."""
    return df.drop(column).join(values.select(key, column), key, "left")


def cached(spark, path: str, days: int, build, now: Column | None = None) -> DataFrame:
    """The table at path if it was written less than so many days ago; else what build() gives, written there first."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
    fs = jpath.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(jpath):
        at = F.timestamp_millis(F.lit(fs.getFileStatus(jpath).getModificationTime()).cast("long"))
        if spark.range(1).select(is_fresh(at, days, now)).first()[0]:
            return spark.read.parquet(path)
    build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def export_names(df: DataFrame, path: str, column: str = "name") -> None:
    """All names of a catalogue as one comma-separated text; a catalogue is small by definition (see tables.MOST_OPERATORS)."""
    df.agg(F.array_join(F.array_sort(F.collect_set(column)), ", ").alias("value")).write.mode("overwrite").text(path)


def is_fresh(written: Column, days: int, now: Column | None = None) -> Column:
    """Whether a timestamp is less than so many whole days old."""
    seconds = F.unix_timestamp(now if now is not None else F.current_timestamp()) - F.unix_timestamp(written)
    return F.floor(seconds / 86400) < days
