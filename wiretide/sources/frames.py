"""Binary event frames: a header of fixed layout, a payload by kind, then the captured bytes.

Numbers are little-endian, apart from the remote port of connections and TCP data, which stays in
network order. Decoding is column expressions; only the walk from frame to frame within a blob runs
in Python, by the lengths that the frames state.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.protocols import let, number
from ..functions.text import shown_ip
from .captures import EVENT, U64

#: Size of the header and its version; kinds, libraries and calls by number; kinds that carry no event.
HEADER, VERSION = 72, 1
KINDS = {1: "conn_start", 2: "conn_end", 3: "tcp_data", 4: "tls_data", 5: "dns", 8: "sqlite"}
SILENT = [6, 7, 127]
TLS_LIBS = {1: "openssl", 2: "boringssl", 3: "gnutls", 4: "nss", 5: "go"}
SQLITE_APIS = {1: "prepare_v2", 2: "exec"}
IPV4, IPV6 = 2, 10
#: Size of each kind's payload before its captured bytes.
FIXED = {"conn_start": 48, "conn_end": 32, "tcp_data": 56, "tls_data": 32, "dns": 44, "sqlite": 24}
#: Place of each kind's first address, which the second follows.
ADDRESSES = {"conn_start": 8, "tcp_data": 8, "dns": 8}
#: Place and size of each field, from the payload's start; a payload has those of its kind alone.
PLACES = {
    "protocol": {"conn_start": (0, 1), "tcp_data": (0, 1)},
    "family": {"conn_start": (1, 1), "tcp_data": (2, 1), "dns": (1, 1)},
    "direction": {"tcp_data": (1, 1), "tls_data": (1, 1), "dns": (0, 1)},
    "sport": {"conn_start": (4, 2), "tcp_data": (4, 2), "dns": (4, 2)},
    "dport": {"conn_start": (6, 2), "tcp_data": (6, 2), "dns": (6, 2)},
    "sock_id": {"conn_start": (40, 8), "conn_end": (0, 8), "tcp_data": (40, 8)},
    "conn_id": {"tls_data": (8, 8)},
    "db_handle": {"sqlite": (8, 8)},
    "total_bytes": {"tcp_data": (48, 4), "tls_data": (20, 4), "dns": (40, 2)},
    "captured": {"tcp_data": (52, 4), "tls_data": (24, 4), "dns": (42, 2), "sqlite": (20, 4)},
    "socket_fd": {"tls_data": (16, 4)},
    "tls_lib": {"tls_data": (0, 1)},
    "api": {"sqlite": (0, 1)},
    "sql_total_bytes": {"sqlite": (16, 4)},
    "bytes_sent": {"conn_end": (8, 8)},
    "bytes_recv": {"conn_end": (16, 8)},
    "rtt_us": {"conn_end": (24, 4)},
}
_NETWORK_ORDER = {"conn_start", "tcp_data"}


def _little(data: Column, at: int, size: int) -> Column:
    """An unsigned little-endian number; eight bytes give a decimal."""
    if size < 8:
        return number(data, at, size, little=True)
    digits = F.hex(F.substring(data, at + 1, size))
    turned = F.concat(*(F.substring(digits, 2 * k + 1, 2) for k in reversed(range(size))))
    return F.when(F.length(digits) == 2 * size, F.conv(turned, 16, 10).cast(U64))


def _text(data: Column) -> Column:
    """Bytes up to the first NUL as text; what isn't UTF-8 becomes U+FFFD."""
    return F.make_valid_utf8(F.substring_index(data.cast("string"), "\0", 1))


def ip_text(family: Column, raw: Column) -> Column:
    """An address of 16 bytes, of which IPv4 uses the first four; null for other families.

    IPv6 is written with its longest run of zero groups left out, mapped IPv4 with its last part in decimals.
    """
    v4 = lambda at: F.concat_ws(".", *(number(raw, at + k, 1).cast("string") for k in range(4)))
    digits = F.lower(F.hex(raw))
    groups = F.concat_ws(":", *(F.regexp_replace(F.substring(digits, 4 * k + 1, 4), "^0{1,3}", "") for k in range(8)))

    def short(g: Column) -> Column:
        runs = (F.when(g.rlike(rf"(^|:)0(:0){{{n - 1}}}(:|$)"), F.regexp_replace(g, rf"^(.*?)(?:^|:)0(?::0){{{n - 1}}}(?::|$)", "$1::")) for n in range(8, 1, -1))
        return F.coalesce(*runs, g)

    v6 = F.when(digits.startswith("0" * 20 + "ffff"), F.concat(F.lit("::ffff:"), v4(12))).otherwise(let(groups, short))
    return F.when(F.octet_length(raw) == 16, F.when(family == IPV4, v4(0)).when(family == IPV6, v6))


def split(blobs: DataFrame, content: str = "content") -> DataFrame:
    """One row per frame: the blob's other columns, ``ordinal``, ``at`` (its first byte) and ``frame``.

    Each frame ends where it says. Where a length can't be (less than a header, or beyond the end) the
    rest of the blob is one last frame, whose fault ``decoded`` tells. Null and empty blobs have no frames.
    """
    keep = [c for c in blobs.columns if c != content]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in blobs.select(*keep).schema), "ordinal int", "at long", "frame binary"])

    def bounds(blob: bytes) -> Iterator[tuple[int, int]]:
        at = 0
        while at < len(blob):
            size = int.from_bytes(blob[at + 4 : at + 8], "little")
            end = at + size if HEADER <= size <= len(blob) - at else len(blob)
            yield at, end
            at = end

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = batch.schema.get_field_index(content)
            for i in range(batch.num_rows):
                blob = batch.column(place)[i].as_py() or b""
                own = list(bounds(blob))
                for part in range(0, len(own), 4096):
                    cut = own[part : part + 4096]
                    row = pa.array([i] * len(cut))
                    kept = [batch.column(c).take(row) for c in range(batch.num_columns) if c != place]
                    yield pa.RecordBatch.from_arrays([*kept, pa.array(range(part, part + len(cut)), pa.int32()), pa.array([a for a, _ in cut], pa.int64()), pa.array([blob[a:b] for a, b in cut], pa.binary())], names=[*keep, "ordinal", "at", "frame"])

    return blobs.mapInArrow(run, schema)


def _named(of: dict[int, str], code: Column) -> Column:
    return F.try_element_at(F.create_map(*(x for k, v in of.items() for x in (F.lit(k).cast("long"), F.lit(v)))), code)


def _fields(kind: Column, payload: Column) -> Column:
    """The numbers of a payload, null where its kind hasn't them, its captured bytes, and whether it is whole."""

    def by_kind(value: dict[str, Column]) -> Column:
        out = F.when(F.lit(False), None)
        for k, v in value.items():
            out = out.when(kind == k, v)
        return out

    def read(name: str, k: str, at: int, size: int) -> Column:
        return number(payload, at, size) if name == "dport" and k in _NETWORK_ORDER else _little(payload, at, size)

    own = [by_kind({k: read(name, k, *place) for k, place in places.items()}).alias(name) for name, places in PLACES.items()]
    fixed, raw = by_kind({k: F.lit(v) for k, v in FIXED.items()}), by_kind({k: F.lit(at) for k, at in ADDRESSES.items()})
    place = [F.substr(payload, raw + 1 + at, F.lit(16)).alias(name) for name, at in (("source", 0), ("target", 16))]
    return F.struct(*own, *place, fixed.alias("fixed"), F.octet_length(payload).alias("size"))


def _event(data: Column, kind: Column, payload: Column, f: Column, wall_ms: Callable[[Column], Column] | None) -> Column:
    side = lambda raw, port: let(ip_text(f["family"], f[raw]), lambda ip: F.concat(shown_ip(ip), F.lit(":"), f[port].cast("string")))
    captured, ts = F.substr(payload, f["fixed"] + 1, f["captured"].cast("int")), _little(data, 16, 8)
    sql = kind == "sqlite"
    values = {
        "ts_ns": ts, "ts_wall_ms": wall_ms(ts) if wall_ms else F.lit(None), "kind": kind, "pid": _little(data, 24, 4), "tgid": _little(data, 28, 4), "uid": _little(data, 32, 4), "gid": _little(data, 36, 4),
        "cgroup_id": _little(data, 40, 8), "comm": _text(F.substring(data, 57, 16)), "cpu": _little(data, 8, 4), "direction": F.when(f["direction"] == 0, "tx").when(f["direction"] > 0, "rx"),
        "src": side("source", "sport"), "dst": side("target", "dport"), "data_b64": F.when(~sql, F.base64(captured)), "socket_fd": F.when(f["socket_fd"] >= 2**31, f["socket_fd"] - 2**32).otherwise(f["socket_fd"]),
        "tls_lib": _named(TLS_LIBS, f["tls_lib"]), "api": _named(SQLITE_APIS, f["api"]), "sql_total_bytes": F.nullif(f["sql_total_bytes"], F.lit(2**32 - 1)), "sql": F.when(sql, _text(captured)),
    }
    return F.struct(*((values[x.name] if x.name in values else f[x.name]).cast(x.dataType).alias(x.name) for x in EVENT.fields))


def decoded(frames: DataFrame, frame: str = "frame", wall_ms: Callable[[Column], Column] | None = None) -> DataFrame:
    """Adds ``event`` (the columns of a capture) and ``fault``; one of them is null.

    Faults: ``short`` (less than a header), ``version``, ``truncated``, ``kind`` (unknown), ``silent``
    (a kind without events), ``protocol``, ``family``, ``library``, ``call``. Frames carry no wall
    clock; ``wall_ms`` makes it of the event's ``ts_ns``.
    """
    data = F.col(frame)
    size, total, code = F.octet_length(data), _little(data, 4, 4), number(data, 1, 1)
    header = F.when(data.isNull() | (size < HEADER), "short").when(number(data, 0, 1) != VERSION, "version").when((total > size) | (total < HEADER), "truncated").when(code.isin(SILENT), "silent").when(_named(KINDS, code).isNull(), "kind")

    def told(t: Column) -> Column:
        def checked(f: Column) -> Column:
            # A field that the kind hasn't is null, so that its test doesn't hold.
            cut = (f["size"] < f["fixed"]) | (f["size"] < f["fixed"] + F.coalesce(f["captured"], F.lit(0)))
            fault = F.when(cut, "truncated").when(~f["protocol"].isin(6, 17), "protocol").when(~f["family"].isin(IPV4, IPV6), "family").when(~f["tls_lib"].isin(list(TLS_LIBS)), "library").when(~f["api"].isin(list(SQLITE_APIS)), "call")
            return let(fault, lambda x: F.struct(F.when(x.isNull(), _event(data, t["kind"], t["payload"], f, wall_ms)).alias("event"), x.alias("fault")))

        return let(_fields(t["kind"], t["payload"]), checked)

    whole = let(F.struct(_named(KINDS, code).alias("kind"), F.substr(data, F.lit(HEADER + 1), (total - HEADER).cast("int")).alias("payload")), told)
    out = frames.withColumn("_fault", header).withColumn("_told", F.when(F.col("_fault").isNull(), whole))
    return out.select(*frames.columns, F.col("_told.event").alias("event"), F.coalesce("_fault", "_told.fault").alias("fault"))


def events(frames: DataFrame, frame: str = "frame", wall_ms: Callable[[Column], Column] | None = None) -> DataFrame:
    """Events of all frames without a fault, with the columns of a capture and those of ``frames`` that it hasn't."""
    more = [c for c in frames.columns if c != frame and c not in EVENT.names]
    return decoded(frames, frame, wall_ms).where("event is not null").select(*more, "event.*")
