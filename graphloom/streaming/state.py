"""State across micro-batches: upserts that keep the latest row of a key, and calls that may arrive before the symbols they
name. However a table is dealt into batches, the outcome is that of the whole table at once.

Both write a log of changes, a folder for each batch; a batch that is run again replaces its folder. ``latest`` reads a log.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: A name's calls are dealt to so many shares where they meet their symbol, which goes to each, so that one name may hold many of them.
SALTS = 2
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextlib.contextmanager
def _rocksdb(spark: SparkSession) -> Iterator[None]:
    """State in RocksDB for queries started meanwhile: on executors' disks, checkpointed to the shared folder."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.unset(_PROVIDER) if before is None else spark.conf.set(_PROVIDER, before)


def _logged(changes: DataFrame, log: str, checkpoint: str):
    """Start a query that appends the changes of each batch to a log."""

    def each(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{log}/_batch={number}")

    with _rocksdb(changes.sparkSession):
        return changes.writeStream.outputMode("update").foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(log: DataFrame, *keys: str) -> DataFrame:
    """The last change of each key in a log (with the column _batch that reading its folder gives)."""
    rest = [c for c in log.columns if c not in (*keys, "_batch")]
    last = log.groupBy(*keys).agg(F.max(F.struct("_batch", *rest)).alias("_last"))
    return last.select(*keys, *[F.col("_last")[c].alias(c) for c in rest])


def read_log(spark: SparkSession, log: str, schema: str) -> DataFrame:
    return spark.read.schema(f"{schema}, _batch long").parquet(log)


def upserts(rows: DataFrame, log: str, checkpoint: str, key: str = "id", seq: str = "seq"):
    """Log the row of each key with the largest seq so far (of equal ones the largest row), whenever it changes or is sent
    again. Spark's own aggregation keeps one row a key as state. A null key is a key; a null seq comes before all others."""
    others = [c for c in rows.columns if c not in (key, seq)]
    best = rows.groupBy(key).agg(F.max(F.struct(seq, *others)).alias("_row"))
    return _logged(best.select(key, *[F.col("_row")[c].alias(c) for c in (seq, *others)]), log, checkpoint)


def calls(symbols: DataFrame, calls: DataFrame) -> DataFrame:
    """A stream of symbols (symbol_id, name) and one of calls (call_id, name) as one: kind, id, name."""
    return symbols.select(F.lit("symbol").alias("kind"), F.col("symbol_id").alias("id"), "name").unionByName(calls.select(F.lit("call").alias("kind"), F.col("call_id").alias("id"), "name"))


def resolve_early_calls(rows: DataFrame, log: str, checkpoint: str, salts: int = SALTS):
    """Log (call_id, name, symbol_id) of a stream of kind ('symbol' or 'call'), id and name: the smallest symbol of a call's
    name. Calls wait for a symbol as state, and are logged again if a smaller one comes. Null ids and names, and other kinds,
    are passed over; repeated rows change nothing that ``latest`` gives.

    The state is two tables in the log's folder ``_waiting``, with a folder for each batch: the rows so far, and the
    smallest symbol of each name whenever it changes. A batch joins its calls with the smallest symbols, and the calls before
    it with those that it changed; so a batch is a few joins, whatever the number of names, and reads the calls so far once."""
    spark, schema = rows.sparkSession, "id string, name string, _batch long, kind string"
    asked = rows.where("id IS NOT NULL AND name IS NOT NULL AND kind IN ('symbol', 'call')").select("kind", F.col("id").cast("string").alias("id"), F.col("name").cast("string").alias("name"))
    salt = F.pmod(F.xxhash64("call_id"), F.lit(salts)).cast("int").alias("salt")
    copies = F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt")

    def joined(calls: DataFrame, best: DataFrame) -> DataFrame:
        calls = calls.select(F.col("id").alias("call_id"), "name").select("*", salt)
        return calls.join(best.select("name", "symbol_id", copies), ["name", "salt"]).select("call_id", "name", "symbol_id")

    def each(batch: DataFrame, number: int) -> None:
        held, least = f"{log}/_waiting/rows", f"{log}/_waiting/least"
        batch.write.mode("overwrite").partitionBy("kind").parquet(f"{held}/_batch={number}")
        # from here on in the caller's session, whose plans adapt to the sizes of a batch
        every = spark.read.schema(schema).parquet(held).where(F.col("_batch") <= number)
        calls, now = every.where("kind = 'call'"), F.col("_batch") == number
        changed = every.where(now & (F.col("kind") == "symbol")).groupBy("name").agg(F.min("id").alias("symbol_id"))
        so_far = lambda: spark.read.schema("name string, symbol_id string, _batch long").parquet(least)
        if number:
            before = so_far().where(F.col("_batch") < number).groupBy("name").agg(F.min("symbol_id").alias("_before"))
            changed = changed.join(before, "name", "left").where("_before IS NULL OR symbol_id < _before").select("name", "symbol_id")
        changed.write.mode("overwrite").parquet(f"{least}/_batch={number}")
        best = so_far().where(F.col("_batch") <= number).groupBy("name").agg(F.min("symbol_id").alias("symbol_id"))
        found = joined(calls.where(now), best).unionByName(joined(calls.where(~now), so_far().where(now).select("name", "symbol_id")))
        found.write.mode("overwrite").parquet(f"{log}/_batch={number}")

    return asked.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
