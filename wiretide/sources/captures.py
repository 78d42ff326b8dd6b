"""Recorded captures: one JSON object a line, optionally gzip or zstandard by file name.

Numbers that may exceed a signed 64-bit integer (socket and cgroup ids) are decimals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

U64 = T.DecimalType(20, 0)
_FIELDS: list[tuple[str, T.DataType]] = [
    ("ts_ns", U64), ("ts_wall_ms", T.LongType()), ("kind", T.StringType()), ("pid", T.LongType()), ("tgid", T.LongType()), ("uid", T.LongType()), ("gid", T.LongType()),
    ("cgroup_id", U64), ("comm", T.StringType()), ("cpu", T.LongType()), ("direction", T.StringType()), ("sock_id", U64), ("conn_id", U64), ("db_handle", U64),
    ("protocol", T.IntegerType()), ("src", T.StringType()), ("dst", T.StringType()), ("total_bytes", T.LongType()), ("data_b64", T.StringType()), ("socket_fd", T.IntegerType()),
    ("tls_lib", T.StringType()), ("bytes_sent", U64), ("bytes_recv", U64), ("rtt_us", T.LongType()), ("api", T.StringType()), ("sql_total_bytes", T.LongType()), ("sql", T.StringType()),
]
EVENT = T.StructType([T.StructField(n, t) for n, t in _FIELDS])
CORRUPT = "_corrupt"
#: Fields each kind can't do without, and TLS libraries and SQLite calls that are known.
NEEDED = {"conn_start": ["src", "dst"], "tcp_data": ["src", "dst"], "dns": ["src", "dst"], "conn_end": [], "tls_data": [], "sqlite": []}
ALWAYS = ["ts_ns", "kind", "pid", "tgid", "uid", "gid", "cgroup_id", "comm", "cpu"]
TLS_LIBS = ["openssl", "boringssl", "gnutls", "nss", "rustls", "go"]
SQLITE_APIS = ["prepare_v2", "exec"]


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """All lines as they are; lines that aren't JSON objects have ``_corrupt`` and nulls elsewhere."""
    schema = T.StructType([*EVENT.fields, T.StructField(CORRUPT, T.StringType())])
    return spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).json(path)


def stream_lines(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    schema = T.StructType([*EVENT.fields, T.StructField(CORRUPT, T.StringType())])
    return spark.readStream.schema(schema).option("columnNameOfCorruptRecord", CORRUPT).option("maxFilesPerTrigger", files_per_trigger).json(path)


def fault(row_corrupt: str = CORRUPT) -> Column:
    """Why a line is no event: ``json``, ``missing`` field, or an ``unknown`` kind, library or call."""
    missing = F.lit(False)
    for name in ALWAYS:
        missing = missing | F.col(name).isNull()
    for kind, names in NEEDED.items():
        for name in names:
            missing = missing | ((F.col("kind") == kind) & F.col(name).isNull())
    unknown = ~F.col("kind").isin(list(NEEDED))
    unknown = unknown | ((F.col("kind") == "tls_data") & F.col("tls_lib").isNotNull() & ~F.col("tls_lib").isin(TLS_LIBS))
    unknown = unknown | ((F.col("kind") == "sqlite") & F.col("api").isNotNull() & ~F.col("api").isin(SQLITE_APIS))
    return F.when(F.col(row_corrupt).isNotNull(), "json").when(missing, "missing").when(F.coalesce(unknown, F.lit(False)), "unknown")


def events(lines: DataFrame) -> DataFrame:
    """Events with the format's defaults; faulty lines are left out."""
    e = lines.where(fault().isNull())
    return e.select(
        *(c for c in EVENT.names if c not in {"sock_id", "conn_id", "protocol", "direction", "total_bytes", "data_b64", "socket_fd", "tls_lib", "api"}),
        F.coalesce("sock_id", F.lit(0).cast(U64)).alias("sock_id"),
        F.coalesce("conn_id", F.lit(0).cast(U64)).alias("conn_id"),
        F.when(F.col("protocol") == 17, 17).otherwise(6).alias("protocol"),
        F.when(F.col("direction") == "rx", "rx").otherwise("tx").alias("direction"),
        F.coalesce("total_bytes", F.lit(0).cast("long")).alias("total_bytes"),
        F.coalesce("data_b64", F.lit("")).alias("data_b64"),
        F.coalesce("socket_fd", F.lit(-1)).alias("socket_fd"),
        F.when(F.col("kind") == "tls_data", F.coalesce("tls_lib", F.lit("openssl"))).alias("tls_lib"),
        F.when(F.col("kind") == "sqlite", F.coalesce("api", F.lit("prepare_v2"))).alias("api"),
    )


def write(events_: DataFrame, path: str, compression: str = "zstd", max_records: int = 0) -> None:
    """Capture files of JSON lines; ``max_records`` starts a new file after so many."""
    events_.select(*(c for c in EVENT.names if c in events_.columns)).write.option("compression", compression).option("maxRecordsPerFile", max_records).json(path)


def tables(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    return [spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names]


def as_events(table: DataFrame) -> DataFrame:
    """The ``events`` table as captured events: users are processes, event types are kinds."""
    kind = F.col("event_type")
    return table.select(
        F.col("event_id"),
        F.col("ts"),
        F.col("user_id").alias("tgid"),
        kind.alias("kind"),
        F.when(kind.isin("click", "view"), "tx").when(kind.isin("purchase", "signup"), "rx").alias("direction"),
        F.floor("value").cast("long").alias("total_bytes"),
        F.col("value"),
        F.col("props"),
    )
