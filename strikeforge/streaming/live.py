"""The chain as a stream: latest tick per contract, strategies once per trigger."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from datetime import date
from functools import partial
from math import ceil

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from strikeforge.operators.ingest import EXPIRY_FIELD, latest_quotes
from strikeforge.operators.snapshot import latest_per_key
from strikeforge.schema import RAW_CONTRACT_KEY
from strikeforge.sources.versioned import BUCKET, Manifest, VersionedTable

#: What a bucket of the snapshot is chosen by: a symbol with very many contracts spreads over
#: the buckets of its expirations.
BUCKET_BY = ("symbol", EXPIRY_FIELD)
AS_OF = "as_of"

#: What one partition of the state is to hold, in bytes of landed ticks (compressed with zstd).
STATE_PARTITION_BYTES = 12 << 20
#: What one bucket of the snapshot is to stand for, likewise; a task merges one or a few.
BUCKET_BYTES = 6 << 20
LEAST_BUCKETS = 64
#: State on the executors' disks within a fixed memory; only changes go to the checkpoint each time.
#: Both are compressed with zstd, which takes blocks of some size. The files of a shuffle go when the
#: write or the batch that made it has ended, not when the driver next collects garbage.
STATE_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.compression": "zstd",
    "spark.sql.streaming.stateStore.rocksdb.blockSizeKB": "64",
    "spark.sql.streaming.stateStore.compression.codec": "zstd",
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
}


class LiveQuotes:
    """Keeps the last tick of every live contract in a stored snapshot.

    Each micro-batch is reduced to one row per contract and merged with the rows the snapshot
    has in the same buckets, by tick time, so a late, older tick changes nothing and no streaming
    state grows with the contracts ever seen. Only buckets that a batch touches are written
    again. A batch's number is the version of the snapshot it makes; a batch that is run again
    after a failure finds its version published or publishes it, with the same rows. Readers
    see whole versions, also during a write. Contracts that expired before ``as_of()`` are not in a
    snapshot any more; their rows go when their bucket is next written.
    """

    def __init__(
        self,
        spark: SparkSession,
        folder: str,
        newest_by: Sequence[str] = ("ts",),
        as_of: Callable[[], date] | None = None,
        on_snapshot: Callable[[DataFrame, int], None] | None = None,
        n_buckets: int = LEAST_BUCKETS,
    ):
        self.spark = spark
        self.folder = folder.rstrip("/")
        self.newest_by = tuple(newest_by)
        self.as_of = as_of
        self.on_snapshot = on_snapshot
        self.table = VersionedTable(spark, f"{self.folder}/snapshot", BUCKET_BY, n_buckets)

    def merge(self, batch: DataFrame, batch_id: int, reduced: bool = False) -> None:
        """Publish the snapshot after a micro-batch; a ``reduced`` one has few rows per contract."""
        table = VersionedTable(
            batch.sparkSession, self.table.folder, BUCKET_BY, self.table.n_buckets
        )
        today = self.as_of() if self.as_of is not None else None

        def settle(rows: DataFrame) -> DataFrame:
            # Grouped by the bucket they are dealt by: stored rows are shuffled once.
            latest = latest_per_key(rows, (BUCKET, *RAW_CONTRACT_KEY), self.newest_by, deal=False)
            return _unexpired(latest, today)

        notes = {AS_OF: str(today)} if today else {}
        rows = batch if reduced else latest_quotes(batch, self.newest_by, deal=False)
        manifest = table.upsert(rows, batch_id, settle, notes)
        if self.on_snapshot is not None:
            self.on_snapshot(_snapshot(table, manifest), batch_id)

    def writer(self, ticks: DataFrame, mode: str = "append") -> DataStreamWriter:
        """A writer to start with any trigger; progress is kept next to the snapshots.

        ``ticks`` is the raw feed, or ``latest_in_state`` of it with ``mode="update"``.
        """
        return (
            ticks.writeStream.outputMode(mode)
            .option("checkpointLocation", f"{self.folder}/progress")
            .foreachBatch(partial(self.merge, reduced=mode == "update"))
        )

    def current(self) -> DataFrame:
        """The newest snapshot."""
        manifest = self.table.manifest()
        if manifest is None:
            raise ValueError(f"no snapshot in {self.folder} yet")
        return _snapshot(self.table, manifest)


def _unexpired(rows: DataFrame, today: date | str | None) -> DataFrame:
    """The text of an expiration sorts like the date it spells."""
    if not today:
        return rows
    return rows.filter(F.col(EXPIRY_FIELD) >= str(today).replace("-", ""))


def _snapshot(table: VersionedTable, manifest: Manifest) -> DataFrame:
    return _unexpired(table.read(manifest), manifest.notes.get(AS_OF))


def buckets_for(n_bytes: int) -> int:
    """How many buckets a snapshot of so many bytes of landed ticks takes for merges in memory."""
    return max(LEAST_BUCKETS, ceil(n_bytes / BUCKET_BYTES))


def latest_in_state(
    ticks: DataFrame, newest_by: Sequence[str] = ("ts",), *, delay: str, window: str
) -> DataFrame:
    """A stream of contracts whose last tick has changed, kept in Spark's state store.

    Per contract and ``window`` of event time the greatest record stays in the state: newest
    first, then by all other fields, as in a batch. ``newest_by`` starts with the event time.
    Ticks up to ``delay`` behind the newest seen count; the watermark drops later ones, and with
    it windows that are over leave the state, which so holds the contracts of recent windows only.
    Run it in update mode into ``LiveQuotes.writer``: every trigger then hands over changed
    contracts alone, and the stored snapshot joins the windows. Start it in ``state_sized_for``.
    """
    event_time, *_ = newest_by
    rest = [c for c in ticks.columns if c not in RAW_CONTRACT_KEY and c not in newest_by]
    record = F.struct(*newest_by, *rest)
    # Watermarks need a time with a zone; the record keeps the feed's.
    timed = ticks.withColumn("_event_time", F.col(event_time).cast("timestamp"))
    kept = (
        timed.withWatermark("_event_time", delay)
        .groupBy(F.window("_event_time", window).alias("_window"), *RAW_CONTRACT_KEY)
        .agg(F.max(record).alias("_record"))
    )
    return kept.select(
        *(c if c in RAW_CONTRACT_KEY else F.col(f"_record.{c}").alias(c) for c in ticks.columns)
    )


@contextmanager
def state_sized_for(spark: SparkSession, n_bytes: int) -> Iterator[int]:
    """Streams started inside keep their state in RocksDB, in partitions enough for ``n_bytes`` of ticks.

    Spark's default keeps the state of every window as objects on the executors' heaps, and in as
    many partitions as the session shuffles to. A stream takes its settings when it starts and its
    checkpoint keeps the number of partitions, so size it for what the windows will hold. The
    session's own settings come back at the end.
    """
    shuffled = "spark.sql.shuffle.partitions"
    partitions = max(int(spark.conf.get(shuffled)), ceil(n_bytes / STATE_PARTITION_BYTES))
    settings = STATE_SETTINGS | {shuffled: str(partitions)}
    before = {name: spark.conf.get(name, None) for name in settings}
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        yield partitions
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
