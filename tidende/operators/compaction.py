"""Far too many small files: read packed splits, write few files of a good size, verify, then publish."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tidende.io import fresh_path

#: Largest list of superfluous files that is broadcast, in rows (a path of about 100 bytes each).
BROADCAST_ROWS = 200_000


@contextmanager
def split_packing(spark: SparkSession, max_partition_bytes: int, open_cost_bytes: int):
    """The engine's own packing of small files into splits, for the plans made inside; the settings are put back."""
    wanted = {"spark.sql.files.maxPartitionBytes": str(max_partition_bytes), "spark.sql.files.openCostInBytes": str(open_cost_bytes)}
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def superfluous_files(files: DataFrame) -> DataFrame:
    """``file_path`` of each file whose ``doc_id`` came in an earlier one, by ``loaded_at``, then ``file_path``.

    Only the three key columns are read and aggregated before the shuffle, so a ``doc_id`` with a third of all files
    is no hot group; the anti-join is on the unique path. A null ``loaded_at`` is later than any other. Files
    without ``doc_id`` are records of their own; null and blank texts are records as any other.
    """
    keys = files.where(F.col("doc_id").isNotNull()).select("doc_id", "loaded_at", "file_path")
    order = F.struct(F.col("loaded_at").isNull().alias("late"), "loaded_at", "file_path")
    first = keys.groupBy("doc_id").agg(F.min(order).alias("k")).select(F.col("k.file_path").alias("file_path"))
    return keys.select("file_path").join(first, "file_path", "left_anti")


def _checks(df: DataFrame) -> list[Column]:
    return [F.count(F.lit(1)).alias("rows"), F.sum(F.xxhash64(*[F.col(c) for c in sorted(df.columns)]).cast("decimal(38,0)")).alias("sum")]


def content_check(df: DataFrame) -> tuple[int, int]:
    """Rows, and an order-free checksum over every column."""
    row = df.agg(*_checks(df)).first()
    return row[0], int(row[1] or 0)


def bytes_of(files: DataFrame) -> int:
    """What the files of a file source hold, summed in the engine: the driver asks for no single file."""
    sizes = files.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size"))
    return int(sizes.groupBy("path").agg(F.max("size").alias("size")).agg(F.sum("size")).first()[0] or 0)


def publish(fs, staged, final, kept) -> None:
    """``staged`` takes the place of ``final``, which is kept aside until it has."""
    if fs.exists(final):
        if fs.exists(kept):
            fs.delete(kept, True)
        if not fs.rename(final, kept):
            raise RuntimeError(f"compaction: {final} can't be put aside")
    if not fs.rename(staged, final):
        if fs.exists(kept):
            fs.rename(kept, final)
        raise RuntimeError(f"compaction: {final} can't be published")
    fs.delete(kept, True)


def _anti(files: DataFrame, drop: DataFrame) -> DataFrame:
    """``files`` without the paths of ``drop``: by broadcast while that list is small, else by shuffle."""
    few = drop.count() <= BROADCAST_ROWS
    return files.join(F.broadcast(drop) if few else drop.hint("shuffle_hash"), "file_path", "left_anti")


def compact(files: DataFrame, target: str | None = None, file_bytes: int = 128 << 20, open_cost_bytes: int = 1 << 20, input_bytes: int | None = None) -> DataFrame:
    """Consolidate ``files`` (one row a delivered file) into few files under ``target``; the written table.

    Splits are packed up to ``file_bytes`` with ``open_cost_bytes`` for opening a file, superfluous deliveries are left out,
    the number of output files follows from the size (``input_bytes``, by default the files' own) and is reached by
    ``coalesce``. The texts aren't shuffled while the list of superfluous files is broadcast, up to ``BROADCAST_ROWS``; a longer one is
    joined by a shuffle. What goes into the staged table is counted and checksummed on its way and compared with what is read back,
    and only then takes the place of ``target``, which is put aside until then; a job that died leaves the table before it. Every record, null and blank texts
    included, is in the result exactly once and unchanged.
    """
    spark = files.sparkSession
    target = target or fresh_path(spark, "compacted")
    staging = f"{target}.staging"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    staged, final, aside = hadoop.Path(staging), hadoop.Path(target), hadoop.Path(f"{target}.before")
    fs = staged.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(aside) and not fs.exists(final):  # an earlier job died between the two renames
        fs.rename(aside, final)
    if input_bytes is None:
        input_bytes = bytes_of(files)
    with split_packing(spark, file_bytes, open_cost_bytes):
        kept = _anti(files, superfluous_files(files))
        wanted = max(1, -(-input_bytes // file_bytes))
        seen = Observation("compacted")
        kept.observe(seen, *_checks(files)).coalesce(int(wanted)).write.mode("overwrite").parquet(staging)
        written = spark.read.schema(files.schema).parquet(staging)
        expected, found = (seen.get["rows"], int(seen.get["sum"] or 0)), content_check(written)
    if expected != found:
        fs.delete(staged, True)
        raise RuntimeError(f"compaction: {found[0]} rows written, {expected[0]} expected, or their contents differ")
    publish(fs, staged, final, aside)
    return spark.read.schema(files.schema).parquet(target)


def adds_nothing(files: DataFrame) -> DataFrame:
    """``file_path`` of each file that isn't in the compacted table, compared by path after it was written and verified."""
    done = compact(files)
    return files.select("file_path").join(done.select("file_path"), "file_path", "left_anti")
