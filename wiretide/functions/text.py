"""Scalar helpers as column expressions."""

from __future__ import annotations

import ipaddress
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F


def host_of(sockaddr: Column) -> Column:
    """The address of ``1.2.3.4:80`` or ``[2001:db8::1]:80``; null if it has neither form."""
    part = F.regexp_extract(sockaddr, r"^\[?(.*?)\]?:(\d+)$", 1)
    return F.when(part != "", part)


def port_of(sockaddr: Column) -> Column:
    part = F.regexp_extract(sockaddr, r"^\[?(.*?)\]?:(\d+)$", 2)
    return F.when(part != "", part).try_cast("int")


def base64_lenient(text: Column) -> Column:
    """Bytes of base64 in either alphabet; junk is skipped and ``=`` ends the text."""
    own = F.regexp_replace(F.translate(F.substring_index(text, "=", 1), "-_", "+/"), "[^A-Za-z0-9+/]", "")
    # A lone sixth of a group holds no byte.
    return F.unbase64(F.when(F.length(own) % 4 == 1, F.substr(own, F.lit(1), F.length(own) - 1)).otherwise(own))


def base64_strict(text: Column) -> Column:
    """Bytes of base64 in either alphabet; null if it holds anything else but white space."""
    return F.try_to_binary(F.translate(text, "-_", "+/"), F.lit("base64"))


def url_decoded(text: Column) -> Column:
    """Percent and plus decoding; a percent sign without two hex digits stays as it is."""
    return F.coalesce(F.try_url_decode(F.regexp_replace(text, "%(?![0-9A-Fa-f]{2})", "%25")), text)


def one_line(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def humanised(size: Column, units: tuple[str, ...] = ("B", "KiB", "MiB", "GiB", "TiB")) -> Column:
    """``1023 B``, ``1.5 KiB`` and so on, tenths rounded down."""
    out = F.concat_ws(" ", size.cast("string"), F.lit(units[0]))
    for k, unit in enumerate(units[1:], 1):
        tenths = F.floor(size * 10 / F.lit(1024**k))
        text = F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit(f" {unit}"))
        out = F.when(size >= 1024**k, text).otherwise(out)
    return out


def shortened(text: Column, most: int) -> Column:
    """At most ``most`` characters; an ellipsis stands for what is cut."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 1), F.lit("…"))).otherwise(text)


def age(seconds: Column) -> Column:
    return F.when(seconds < 60, F.concat(seconds.cast("string"), F.lit("s"))).when(seconds < 3600, F.concat(F.floor(seconds / 60).cast("string"), F.lit("m"))).otherwise(F.concat(F.floor(seconds / 3600).cast("string"), F.lit("h")))


def path_of(url: Column) -> Column:
    """What stands between the host and the first ``?``; a fragment stays in it."""
    return F.substring_index(F.regexp_replace(url, r"^[a-z]+://[^/?#]*", ""), "?", 1)


def query_of(url: Column) -> Column:
    return F.when(F.instr(url, "?") > 0, F.regexp_replace(F.regexp_replace(url, r"^[^?]*\?", ""), "#.*$", ""))


def url_host(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-z]+://([^/?#:]*)", 1)


def fnv1a32(text: Column) -> Column:
    """FNV-1a of the UTF-8 bytes, as an unsigned number."""
    codes = F.transform(F.sequence(F.lit(1), F.octet_length(text)), lambda i: F.conv(F.substr(F.hex(text), i * 2 - 1, F.lit(2)), 16, 10).cast("long"))
    step = lambda h, b: F.pmod(h.bitwiseXOR(b) * F.lit(16777619).cast("long"), F.lit(1 << 32))
    return F.when(F.length(text) == 0, F.lit(2166136261)).otherwise(F.aggregate(codes, F.lit(2166136261).cast("long"), step))


def header_value(headers: Column, name: str) -> Column:
    """The first header of that name, in any case."""
    return F.get(F.filter(headers, lambda h: F.lower(h["name"]) == name.lower()), F.lit(0))["value"]


def glob(text: Column, pattern: str) -> Column:
    """Shell-style match of the whole text: ``*`` and ``?``."""
    import re

    return text.rlike("^" + "".join({"*": ".*", "?": "."}.get(c, re.escape(c)) for c in pattern) + "$")


def ipv4_number(ip: Column) -> Column:
    """An IPv4 address as a number; null if it isn't one."""
    octets = F.transform(F.split(ip, r"\."), lambda o: o.try_cast("long"))
    whole = F.aggregate(octets, F.lit(0).cast("long"), lambda n, o: n * 256 + o)
    return F.when(ip.rlike(r"^\d{1,3}(\.\d{1,3}){3}$") & (F.array_max(octets) <= 255), whole)


def ip_key(ip: Column) -> Column:
    """Any address as 32 hex digits of its 16 bytes, in their order; IPv4 as a mapped address. Null if it is neither.

    A trailing IPv4 address within an IPv6 one is read as its last four bytes.
    """
    v4 = lambda x: F.lpad(F.lower(F.hex(ipv4_number(x))), 8, "0")
    tail = F.regexp_extract(ip, r":(\d{1,3}(?:\.\d{1,3}){3})$", 1)
    last = F.concat(F.substring(v4(tail), 1, 4), F.lit(":"), F.substring(v4(tail), 5, 4))
    text = F.lower(F.when(tail == "", ip).otherwise(F.concat(F.substr(ip, F.lit(1), F.length(ip) - F.length(tail)), last)))
    groups = lambda x: F.transform(F.filter(F.split(x, ":"), lambda g: g != ""), lambda g: F.lpad(g, 4, "0"))
    halves = F.split(text, "::")
    left, right = groups(halves[0]), groups(F.coalesce(F.get(halves, F.lit(1)), F.lit("")))
    gap = 8 - F.size(left) - F.size(right)
    digits = F.concat(F.array_join(left, ""), F.repeat(F.lit("0000"), gap), F.array_join(right, ""))
    edges = ~text.rlike(r"^:[^:]|[^:]:$|:::")
    fine = edges & F.when(F.size(halves) == 2, gap >= 1).otherwise((F.size(halves) == 1) & (gap == 0))
    return F.coalesce(F.concat(F.lit("0" * 20 + "ffff"), v4(ip)), F.when(text.rlike(r"^[0-9a-f:]*:[0-9a-f:]*$") & ~text.rlike("[0-9a-f]{5}") & fine, digits))


def in_cidr(ip: Column, cidr: str) -> Column:
    """Whether an address lies in a network of its family; null for no address."""
    net = ipaddress.ip_network(cidr)
    first, last = int(net.network_address), int(net.broadcast_address)
    if net.version == 4:
        return ipv4_number(F.regexp_replace(ip, "(?i)^::ffff:", "")).between(first, last)
    return ip_key(ip).between(f"{first:032x}", f"{last:032x}") & F.instr(ip, ":").cast("boolean")


def shown_ip(ip: Column) -> Column:
    """A mapped IPv4 address as IPv4, other IPv6 addresses in brackets."""
    plain = F.regexp_replace(ip, r"(?i)^::ffff:(?=\d+\.)", "")
    return F.when(F.instr(plain, ":") > 0, F.concat(F.lit("["), plain, F.lit("]"))).otherwise(plain)


def shown_endpoint(name: Column, ip: Column, port: Column) -> Column:
    """``name[ip]:port``, or ``ip:port`` without a name of its own."""
    base, end = shown_ip(ip), F.concat(F.lit(":"), port.cast("string"))
    own = name.isNotNull() & (name != "") & (name != base)
    return F.when(own, F.concat(name, F.lit("["), base, F.lit("]"), end)).otherwise(F.concat(base, end))


def scrubbed(text: Column) -> Column:
    """Texts of over 64 characters that are all of a token's alphabet are hidden."""
    return F.when(F.trim(text).rlike(r"^[A-Za-z0-9_.=-]{65,}$"), "<redacted>").otherwise(text)


def fnv1a64(text: Column) -> Column:
    """FNV-1a of the UTF-8 bytes as 16 hex digits; the halves are kept apart, so nothing overflows."""
    half = (1 << 32) - 1
    codes = F.transform(F.sequence(F.lit(1), F.greatest(F.octet_length(text), F.lit(1))), lambda i: F.conv(F.hex(F.substr(F.encode(text, "UTF-8"), i, F.lit(1))), 16, 10).cast("long"))
    start = F.struct(F.lit(0xCBF29CE4).cast("long").alias("high"), F.lit(0x84222325).cast("long").alias("low"))

    def step(h, b):
        low = h["low"].bitwiseXOR(b)
        return F.struct((h["high"] * 435 + F.shiftright(low * 435, 32) + low * 256).bitwiseAND(F.lit(half)).alias("high"), (low * 435).bitwiseAND(F.lit(half)).alias("low"))

    digits = lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")
    return F.when(text == "", F.lit("cbf29ce484222325")).otherwise(F.aggregate(codes, start, step, lambda h: F.concat(digits(h["high"]), digits(h["low"]))))


def clock(time: Column) -> Column:
    return F.date_format(time, "HH:mm:ss.SSS")


def size_of(text: str) -> int:
    """Bytes of ``10``, ``10k``, ``100M``, ``1.5G``: powers of 1024."""
    import re

    found = re.fullmatch(r"\s*(\d+(?:\.\d*)?|\.\d+)\s*([kmgt]?)(?:i?b)?\s*", text.lower())
    if not found:
        raise ValueError(f"not a size: {text!r}")
    return int(float(found[1]) * 1024 ** " kmgt".index(found[2] or " "))


def seconds_of(text: str) -> float:
    """Seconds of ``30s``, ``5m``, ``1h 30m``, ``250ms``."""
    import re

    units = {"ms": 0.001, "s": 1, "m": 60, "h": 3600, "d": 86400, "w": 604800}
    if not re.fullmatch(r"\s*(\d+\s*(ms|[smhdw])\s*)+", text):
        raise ValueError(f"not a duration: {text!r}")
    return sum(int(n) * units[u] for n, u in re.findall(r"(\d+)\s*(ms|[smhdw])", text))


#: Address ranges that aren't public.
PRIVATE = ["127.0.0.0/8", "10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "169.254.0.0/16", "255.255.255.255/32", "192.0.2.0/24", "198.51.100.0/24", "203.0.113.0/24", "0.0.0.0/32"]


def is_private(ip: Column) -> Column:
    """Loopback, private, link-local, broadcast, documentation and unspecified addresses of both families."""
    v4 = F.regexp_replace(ip, "(?i)^::ffff:", "")
    nets = [ipaddress.ip_network(c) for c in PRIVATE]
    hit = F.exists(F.array(ipv4_number(v4)), lambda n: reduce(or_, (n.between(int(x.network_address), int(x.broadcast_address)) for x in nets)))
    return F.when(ip.isNull(), None).otherwise(F.coalesce(hit, F.lit(False)) | F.lower(ip).rlike(r"^(::1|::|f[cd][0-9a-f]{2}:.*|fe[89ab][0-9a-f]:.*)$"))
