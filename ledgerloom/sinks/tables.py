"""Table writes. All of these run Spark jobs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ledgerloom.functions.columns import quoted, ref
from ledgerloom.operators.joins import require_unique, upsert
from ledgerloom.session import shared_dir
from ledgerloom.sources.queries import scan


#: Partition column of tables that ``merge_buckets`` writes.
KEY_BUCKET = "_key_bucket"


def overwrite(df: DataFrame, table: str, partition_by: Sequence[str] = ()) -> None:
    """Replace the table, schema included."""
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.saveAsTable(table)


def create_empty(spark: SparkSession, table: str, ddl: str, comment: str | None = None, partition_by: Sequence[str] = ()) -> None:
    parts = f" PARTITIONED BY ({', '.join(quoted(c) for c in partition_by)})" if partition_by else ""
    tail = "" if comment is None else " COMMENT '" + comment.replace("'", "\\'") + "'"
    spark.sql(f"CREATE TABLE IF NOT EXISTS {table} ({ddl}) USING parquet{parts}{tail}")


def create_like(df: DataFrame, table: str, partition_by: Sequence[str] = ()) -> None:
    """Create the table with the frame's columns when it does not exist; nothing of the frame is run."""
    if not df.sparkSession.catalog.tableExists(table):
        cols = ", ".join(f"{quoted(f.name)} {f.dataType.simpleString()}" for f in df.schema.fields)
        create_empty(df.sparkSession, table, cols, partition_by=partition_by)


def widened(known: StructType, incoming: StructType) -> StructType:
    """The known columns, then those of the incoming rows that differ from all of them by more than letter case."""
    have = {n.lower() for n in known.fieldNames()}
    return StructType([*known.fields, *[f for f in incoming.fields if f.name.lower() not in have]])


def evolve(spark: SparkSession, table: str, incoming: StructType) -> list[str]:
    """Add the columns the table lacks; old rows read NULL. Returns their names."""
    known = scan(spark, table).schema
    new = widened(known, incoming).fields[len(known) :]
    if new:
        cols = ", ".join(f"{quoted(f.name)} {f.dataType.simpleString()}" for f in new)
        spark.sql(f"ALTER TABLE {table} ADD COLUMNS ({cols})")
    return [f.name for f in new]


def append(df: DataFrame, table: str, evolving: bool = True) -> None:
    """Create if absent, add new columns, then insert by name; columns the frame lacks become NULL."""
    spark = df.sparkSession
    create_like(df, table)
    if evolving:
        evolve(spark, table, df.schema)
    aligned(df, scan(spark, table).schema).write.mode("append").insertInto(table)


def aligned(df: DataFrame, target: StructType) -> DataFrame:
    """The columns of a table in its order, matched without regard to letter case; those the frame lacks are NULL."""
    have = {c.lower(): c for c in df.columns}
    return df.select(
        *[
            (ref(have[f.name.lower()]) if f.name.lower() in have else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in target.fields
        ]
    )


def put_partitions(df: DataFrame, table: str, by: str, evolving: bool = True) -> None:
    """Overwrite the partitions that the rows name; the table is created partitioned by that column if it is absent."""
    spark = df.sparkSession
    create_like(df, table, [by])
    if evolving:
        evolve(spark, table, df.schema)
    rows = aligned(df, scan(spark, table).schema)
    old = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        rows.write.mode("overwrite").insertInto(table)
    finally:
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", old)


def location(spark: SparkSession, table: str) -> str:
    found = spark.sql(f"DESCRIBE TABLE EXTENDED {table}").where("col_name = 'Location'").first()
    return found["data_type"]


def has_partition(spark: SparkSession, table: str, by: str, value: str) -> bool:
    """Is the partition there? Looks at its folder only. One that its writer died before registering is registered."""
    if not spark.catalog.tableExists(table) or not exists(spark, f"{location(spark, table)}/{by}={value}"):
        return False
    if not [r for r in spark.sql(f"SHOW PARTITIONS {table}").collect() if r[0] == f"{by}={value}"]:
        spark.sql(f"ALTER TABLE {table} RECOVER PARTITIONS")
    return True


def merge_buckets(df: DataFrame, table: str, keys: Sequence[str], buckets: int = 256) -> None:
    """Upsert into a table partitioned by a hash of its keys; only buckets with a source row are read and written.

    The new content of those buckets is staged in the shared folder and then swapped in; a
    merge that died while swapping is completed by the next one. The number of buckets is
    fixed when the table is created. One merge per table at a time.
    """
    if not keys:
        raise ValueError("merge: keys are required")
    spark = df.sparkSession
    staged = f"{shared_dir(spark)}/merge-{table.replace('.', '-').replace('`', '')}"
    if spark.catalog.tableExists(table):
        if exists(spark, f"{staged}/_SUCCESS"):
            put_partitions(spark.read.parquet(staged).hint("rebalance", KEY_BUCKET), table, KEY_BUCKET)
            remove(spark, staged)
        buckets = int(spark.sql(f"SHOW TBLPROPERTIES {table} ('key_buckets')").first()["value"])
    else:
        create_like(df.withColumn(KEY_BUCKET, F.lit(0)), table, [KEY_BUCKET])
        spark.sql(f"ALTER TABLE {table} SET TBLPROPERTIES ('key_buckets'='{buckets}')")
    evolve(spark, table, df.schema)
    number = F.pmod(F.xxhash64(*[ref(k) for k in keys]), F.lit(buckets)).cast("int")
    source = df.withColumn(KEY_BUCKET, number)
    # At most ``buckets`` numbers; they prune the partitions to read.
    touched = [r[0] for r in source.select(KEY_BUCKET).distinct().collect()]
    known = scan(spark, table).where(F.col(KEY_BUCKET).isin(touched))
    upsert(known, aligned(source, known.schema), keys).write.mode("overwrite").parquet(staged)
    put_partitions(spark.read.parquet(staged).hint("rebalance", KEY_BUCKET), table, KEY_BUCKET)
    remove(spark, staged)


def merge(df: DataFrame, table: str, keys: Sequence[str]) -> None:
    """Upsert into a parquet table: matched keys replaced, new keys added.

    Parquet tables cannot be read and overwritten in one plan, so the result is
    first written to the shared folder and then copied over. A merge that died
    while copying is completed from its finished staged copy by the next one.
    One merge per table at a time.
    """
    if not keys:
        raise ValueError("merge: keys are required")
    spark = df.sparkSession
    create_like(df, table)
    staged = f"{shared_dir(spark)}/merge-{table.replace('.', '-').replace('`', '')}"
    if exists(spark, f"{staged}/_SUCCESS"):
        _copy_over(spark, staged, table)
    upsert(scan(spark, table), df, keys).write.mode("overwrite").parquet(staged)
    _copy_over(spark, staged, table)


def _copy_over(spark: SparkSession, staged: str, table: str) -> None:
    spark.read.parquet(staged).write.mode("overwrite").insertInto(table)
    remove(spark, staged)


def save_features(df: DataFrame, table: str, keys: Sequence[str], comment: str = "") -> None:
    """Feature table with a checked primary key."""
    require_unique(df, keys, table)
    overwrite(df, table)
    describe_table(df.sparkSession, table, comment, {"primary_key": ",".join(keys)})


def describe_table(spark: SparkSession, table: str, comment: str = "", properties: Mapping[str, str] | None = None) -> None:
    escape = lambda s: s.replace("\\", "\\\\").replace("'", "\\'")
    if comment:
        spark.sql(f"COMMENT ON TABLE {table} IS '{escape(comment)}'")
    if properties:
        pairs = ", ".join(f"'{escape(k)}'='{escape(v)}'" for k, v in properties.items())
        spark.sql(f"ALTER TABLE {table} SET TBLPROPERTIES ({pairs})")


def drop(spark: SparkSession, table: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {table}")


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder this library staged."""
    location = spark._jvm.org.apache.hadoop.fs.Path(path)
    location.getFileSystem(spark._jsc.hadoopConfiguration()).delete(location, True)


def exists(spark: SparkSession, path: str) -> bool:
    location = spark._jvm.org.apache.hadoop.fs.Path(path)
    return location.getFileSystem(spark._jsc.hadoopConfiguration()).exists(location)
