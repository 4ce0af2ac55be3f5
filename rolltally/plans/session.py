"""Session settings the operators are planned for."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a hot prompt in a join even when that costs one more exchange after it.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Don't run a window or aggregate on a finer key in the partitioning of a coarser one: a hot prompt would
    # stay in one task. With the exchange, rank filters are also applied before it (WindowGroupLimit).
    "spark.sql.requireAllClusterKeysForDistribution": "true",
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    # Streaming state beyond the heap.
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the settings to a session made elsewhere."""
    for name, value in SETTINGS.items():
        spark.conf.set(name, value)
    return spark


#: Bytes of a scan's split, what opening a file counts as, and bytes of a partition after an exchange. Staged tables are columns of few distinct values,
#: some bytes a row, so splits of 128 MB would hold tens of millions of rows, which aggregates and rank filters then sort in one task.
SCANS = {
    "spark.sql.files.maxPartitionBytes": 8 << 20,
    "spark.sql.files.openCostInBytes": 1 << 18,
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": 16 << 20,
}
_UNITS = {"": 1, "b": 1, "k": 1 << 10, "m": 1 << 20, "g": 1 << 30, "t": 1 << 40}


def bytes_of(size: str) -> int:
    """Bytes of a setting such as ``134217728b``, ``64k`` or ``128MB``."""
    digits = size.strip().lower().rstrip("kmgtb")
    return int(digits) * _UNITS[size.strip().lower()[len(digits) :][:1]]


def narrow_scans(spark: SparkSession) -> SparkSession:
    """Scans and exchanges whose tasks hold a bounded number of narrow rows; smaller settings are kept."""
    for name, most in SCANS.items():
        if bytes_of(spark.conf.get(name)) > most:
            spark.conf.set(name, str(most))
    return spark


def local_session(cores: int | str = "*", partitions: int = 8, memory: str = "20g") -> SparkSession:
    """Single-machine session for tests and the benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("rolltally")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(partitions))
    )
    for name, value in SETTINGS.items():
        builder = builder.config(name, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
