"""Payload events as packets of a classic capture file (raw IP link type)."""

from __future__ import annotations

import struct

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import host_of, ipv4_number, port_of
from .flows import segments

#: Fixed value: the header of a capture file with microseconds and raw IP packets.
FILE_HEADER = struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 262144, 101)


def hex_of(value: Column, size: int) -> Column:
    """A number as ``size`` big-endian bytes in hexadecimal."""
    return F.lpad(F.hex(F.pmod(value.cast("long"), F.lit(1 << 8 * size))), 2 * size, "0")


def little(value: Column, size: int) -> Column:
    digits = hex_of(value, size)
    return F.concat(*(F.substring(digits, 2 * k + 1, 2) for k in reversed(range(size))))


def address(ip: Column) -> Column:
    """Bytes of an address in hexadecimal; IPv6 addresses may be shortened once with ``::``."""
    own = F.when(F.startswith(ip, F.lit("::")), F.concat(F.lit("0"), ip)).otherwise(ip)
    left, right = F.split(F.split_part(own, F.lit("::"), F.lit(1)), ":"), F.split(F.split_part(own, F.lit("::"), F.lit(2)), ":")
    words = lambda part: F.array_join(F.transform(F.filter(part, lambda w: w != ""), lambda w: F.lpad(w, 4, "0")), "")
    v6 = F.concat(words(left), F.repeat(F.lit("0"), F.lit(32) - F.length(words(left)) - F.length(words(right))), words(right))
    return F.when(ip.contains(":"), F.upper(v6)).otherwise(hex_of(ipv4_number(ip), 4))


def records(packets: DataFrame) -> DataFrame:
    """flow, ts_ns, seq and the bytes of each packet record, in a TCP segment with running numbers.

    ``packets`` as from ``flows.payloads`` with ``src``; a file is FILE_HEADER and the records by time.
    """
    placed = packets.join(segments(packets).select("flow", "ts_ns", "seq", "direction", "tcp_seq", "tcp_ack"), ["flow", "ts_ns", "seq", "direction"])
    sent = F.col("direction") == "tx"
    source, target = F.when(sent, F.col("src")).otherwise(F.col("dst")), F.when(sent, F.col("dst")).otherwise(F.col("src"))
    size = F.octet_length("data")
    tcp = F.concat(hex_of(port_of(source), 2), hex_of(port_of(target), 2), hex_of(F.col("tcp_seq"), 4), hex_of(F.col("tcp_ack"), 4), F.lit("5018FFFF00000000"), F.hex("data"))
    ends = F.concat(address(host_of(source)), address(host_of(target)))
    v4 = F.concat(F.lit("4500"), hex_of(size + 40, 2), F.lit("0000400040060000"), ends)
    v6 = F.concat(F.lit("60000000"), hex_of(size + 20, 2), F.lit("0640"), ends)
    frame = F.concat(F.when(host_of(source).contains(":"), v6).otherwise(v4), tcp)
    length = (F.length(frame) / 2).cast("long")
    micros = F.col("ts_wall_ms") * 1000
    head = F.concat(little(F.floor(micros / 1_000_000), 4), little(micros % 1_000_000, 4), little(length, 4), little(length, 4))
    return placed.select("flow", "ts_ns", "seq", F.unhex(F.concat(head, frame)).alias("record"))
