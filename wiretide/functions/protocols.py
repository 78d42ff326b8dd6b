"""Which protocol a flow speaks, and the first fields of common messages, as column expressions.

Payloads are binary columns. The port decides where it is known; otherwise the first bytes of the
client's side do, then those of the server's.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .classify import REDACTED_HEADERS

#: Ports that belong to a protocol.
PORTS = {
    "http1": [80, 8080, 8000, 3000, 5000, 8888], "postgres": [5432], "mysql": [3306, 33060], "redis": [6379], "mongodb": [27017, 27018, 27019], "kafka": [9092, 29092],
    "cassandra": [9042, 9142], "memcached": [11211], "mqtt": [1883, 8883], "nats": [4222, 6222], "pop3": [110, 995], "smtp": [25, 465, 587, 2525], "imap": [143, 993],
    "modbus": [502], "ldap": [389, 636, 3268, 3269], "opcua": [4840, 4843], "iec104": [2404], "ssh": [22], "dnp3": [20000], "s7": [102], "enip": [44818, 2222],
    "bacnet": [47808, 47809], "stun": [3478, 5349], "ftp": [21], "sip": [5060, 5061], "tls": [443, 8443], "rdp": [3389], "socks": [1080], "telnet": [23], "ntp": [123],
    "radius": [1812, 1813], "syslog": [514, 601, 6514], "amqp": [5672, 5671], "kerberos": [88], "oracle": [1521, 1526], "mssql": [1433, 1434], "dhcp": [67, 68],
    "tftp": [69], "tacacs": [49], "snmp": [161, 162], "smb": [139, 445], "wireguard": [51820], "irc": [6667, 6697, 7000], "nfs": [2049], "rtsp": [554, 8554],
    "smpp": [2775], "dns": [53], "mdns": [5353], "coap": [5683],
}
#: Words that begin a NATS message, and HTTP methods.
NATS = ["PING", "PONG", "INFO ", "CONNECT ", "PUB ", "SUB ", "MSG ", "HPUB ", "HMSG ", "UNSUB ", "+OK", "-ERR"]
METHODS = ["GET", "PUT", "POST", "HEAD", "DELETE", "OPTIONS", "PATCH", "CONNECT", "TRACE"]
#: How many first bytes tell a protocol.
HEAD = 64


def number(data: Column, at: int, size: int, little: bool = False) -> Column:
    """An unsigned number of the bytes from ``at`` (from 0); null where they are missing."""
    part = F.substring(data, at + 1, size)
    digits = F.hex(part)
    if little:
        digits = F.concat(*(F.substring(digits, 2 * k + 1, 2) for k in reversed(range(size))))
    return F.when(F.octet_length(part) == size, F.conv(digits, 16, 10).cast("long"))


def latin1(data: Column) -> Column:
    """Bytes as characters of the same value, so that patterns can see them."""
    return F.decode(data, "ISO-8859-1")


def by_port(port: Column) -> Column:
    return reduce(lambda out, kv: out.when(port.isin(kv[1]), kv[0]), PORTS.items(), F.when(F.lit(False), ""))


def by_bytes(data: Column) -> Column:
    """The protocol whose mark the first bytes bear; the first that fits counts."""
    size, head = F.octet_length(data), latin1(F.substring(data, 1, HEAD))
    first = number(data, 0, 1)
    starts = lambda words: head.rlike("^(" + "|".join(w.replace("+", r"\+") for w in words) + ")")
    kafka_key, length, version = number(data, 4, 2), number(data, 0, 4), number(data, 4, 4)
    mongo_op = number(data, 12, 4, little=True)
    return (
        F.when(size < 4, None)
        .when(head.rlike(r"(?s)^[\x{C0}-\x{FF}]\x00\x00\x00\x01"), "quic")
        .when(head.rlike(r"(?s)^\x16\x03[\x00-\x04](?!\x00\x00).."), "tls")
        .when(head.startswith("PRI * HTTP/2.0\r\n\r\nSM\r\n\r\n"), "http2")
        .when(head.startswith("HTTP/") | head.rlike("^(" + "|".join(METHODS) + ") "), "http1")
        .when(starts(NATS), "nats")
        .when(head.rlike(r"^[-+:$*_#,(=%~>]") & latin1(data).contains("\r"), "redis")
        .when(first.isin(0x80, 0x81), "memcached")
        .when((size >= 12) & head.rlike(r"(?s)^[\x10-\x1F].\x00(\x04MQTT|\x06MQIsdp)"), "mqtt")
        .when(first.isin(0x04, 0x84, 0x05, 0x85) & (number(data, 5, 4) <= 256 * 1024 * 1024), "cassandra")
        .when(number(data, 0, 4, little=True).between(16, 48 * 1024 * 1024) & (mongo_op.isin(1) | mongo_op.between(2001, 2007) | mongo_op.between(2010, 2013)), "mongodb")
        .when((length.between(8, 1023) & version.between(0x30000, 0x3FFFF)) | ((length == 8) & (version == 0x04D2162F)), "postgres")
        .when((size >= 12) & length.between(8, 100 * 1024 * 1024) & ((kafka_key <= 1000) | (kafka_key == 0xFFFF)), "kafka")
    )


def detect(port: Column, sent: Column, received: Column) -> Column:
    return F.coalesce(by_port(port), by_bytes(sent), by_bytes(received), F.lit("unknown"))


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


_REQUEST = "(?:" + "|".join(METHODS) + r") [^ \r\n]+ HTTP/1\.[01]\r\n"
_RESPONSE = r"HTTP/1\.[01] \d{3}[^\r\n]*\r\n"
_MESSAGES = "array<struct<head:string,body:string>>"


def _field(head: Column, name: str) -> Column:
    return F.trim(F.regexp_extract(head, rf"(?i)\r\n{name}:[ \t]*([^\r\n]*)", 1))


def _chunked(text: Column, at: Column) -> Column:
    """The joined chunks that begin at a place, and the place after them (past trailers)."""
    start = F.struct(at.alias("at"), F.lit("").alias("body"), F.lit(False).alias("done"))

    def step(s, _):
        line = F.position(F.lit("\r\n"), text, s["at"])
        size = F.conv(F.regexp_extract(F.substr(text, s["at"], F.lit(16)), r"^([0-9A-Fa-f]{1,8})[;\r]", 1), 16, 10).cast("int")

        def moved(x):
            bad = (x["line"] == 0) | x["size"].isNull()
            after = F.position(F.lit("\r\n\r\n"), text, x["line"])
            last = F.when(after > 0, after + 4).otherwise(F.length(text) + 1)
            return F.struct(F.when(bad, s["at"]).when(x["size"] == 0, last).otherwise(x["line"] + 4 + x["size"]).alias("at"), F.when(bad | (x["size"] == 0), s["body"]).otherwise(F.concat(s["body"], F.substr(text, x["line"] + 2, x["size"]))).alias("body"), (bad | (x["size"] == 0)).alias("done"))

        return F.when(s["done"], s).otherwise(let(F.struct(line.alias("line"), size.alias("size")), moved))

    # Each chunk has two line ends of its own.
    most = F.greatest(F.regexp_count(F.substr(text, at), F.lit(r"\r\n")), F.lit(1))
    return F.aggregate(F.sequence(F.lit(1), most), start, step)


def _messages(text: Column, first: str, response: bool) -> Column:
    """Heads and bodies of messages; each begins where the body of the one before ends.

    A body has the length that its head states, or the chunks that follow; a response with neither
    lasts to the end of the bytes, a request has none. Bytes that are no message are skipped.
    """
    start = F.struct(F.lit(1).alias("at"), F.array().cast(_MESSAGES).alias("out"))

    def step(s, _):
        gap = F.regexp_instr(F.substr(text, s["at"]), F.lit(first))
        begin = s["at"] + gap - 1
        end = F.when(gap > 0, F.position(F.lit("\r\n\r\n"), text, begin)).otherwise(0)

        def bodied(x):
            head = F.substr(text, x["begin"], x["end"] + 2 - x["begin"])
            at = x["end"] + 4
            stated = _field(head, "content-length").try_cast("int")
            rest = F.length(text) + 1 - at
            size = F.coalesce(F.when(stated.isNotNull(), F.least(stated, rest)), F.when(head.rlike(r"^HTTP/1\.[01] (1\d\d|204|304)"), F.lit(0)).otherwise(rest) if response else F.lit(0))
            plain = F.struct((at + size).alias("at"), F.substr(text, at, size).alias("body"), F.lit(True).alias("done"))
            body = F.when(F.lower(_field(head, "transfer-encoding")).endswith("chunked"), _chunked(text, at)).otherwise(plain)
            return let(body, lambda b: F.struct(b["at"].alias("at"), F.array_append(s["out"], F.struct(head.alias("head"), b["body"].alias("body"))).alias("out")))

        found = F.struct(begin.alias("begin"), end.alias("end"))
        return let(found, lambda x: F.when(x["end"] == 0, F.struct((F.length(text) + 1).alias("at"), s["out"].alias("out"))).otherwise(bodied(x)))

    most = F.greatest(F.regexp_count(text, F.lit(first)), F.lit(1))
    return F.when(text.isNotNull(), F.aggregate(F.sequence(F.lit(1), most), start, step)["out"])


def http1_requests(data: Column) -> Column:
    """Requests in a client's bytes: method, target, headers and body (bytes as characters), in order."""
    line = lambda h, k: F.regexp_extract(h, r"^([A-Z]+) ([^ ]+) HTTP/(1\.[01])\r\n", k)
    return F.transform(let(latin1(data), lambda t: _messages(t, _REQUEST, False)), lambda m: F.struct(line(m["head"], 1).alias("method"), line(m["head"], 2).alias("target"), headers(m["head"]).alias("headers"), m["body"].alias("body")))


def http1_responses(data: Column) -> Column:
    """Responses in a server's bytes: status, reason, headers and body (bytes as characters), in order."""
    line = lambda h, k: F.regexp_extract(h, r"^HTTP/1\.[01] (\d{3}) ?([^\r\n]*)\r\n", k)
    return F.transform(let(latin1(data), lambda t: _messages(t, _RESPONSE, True)), lambda m: F.struct(line(m["head"], 1).cast("int").alias("status"), line(m["head"], 2).alias("reason"), headers(m["head"]).alias("headers"), m["body"].alias("body")))


def headers(head: Column) -> Column:
    """Name and value of each header line after the first, in order; values that carry credentials are masked."""
    lines = F.regexp_extract_all(head, F.lit(r"\r\n([^:\r\n]+):[ \t]*([^\r\n]*)"), F.lit(0))
    part = lambda x, k: F.regexp_extract(x, r"\r\n([^:\r\n]+):[ \t]*([^\r\n]*)", k)
    return F.transform(lines, lambda x: F.struct(part(x, 1).alias("name"), F.when(F.lower(F.trim(part(x, 1))).isin(*REDACTED_HEADERS), "<redacted>").otherwise(part(x, 2)).alias("value")))


#: DNS record types by number.
DNS_TYPES = {1: "A", 2: "NS", 5: "CNAME", 6: "SOA", 12: "PTR", 15: "MX", 16: "TXT", 28: "AAAA", 33: "SRV", 65: "HTTPS", 255: "ANY"}


def dns_question(data: Column) -> Column:
    """id, is_response, rcode, name and type of a DNS message's first question; null if there is none.

    A name has at most 127 labels, so the walk over labels is bounded.
    """
    byte = lambda at: F.conv(F.hex(F.substr(data, at + 1, F.lit(1))), 16, 10).cast("int")
    start = F.struct(F.lit(12).alias("at"), F.lit("").alias("name"), F.lit(False).alias("done"))

    def step(s, _):
        size = F.coalesce(byte(s["at"]), F.lit(0))
        label = latin1(F.substr(data, s["at"] + 2, size))
        end = s["done"] | (size == 0) | (size > 63)
        return F.struct(F.when(end, s["at"]).otherwise(s["at"] + 1 + size).alias("at"), F.when(end, s["name"]).when(s["name"] == "", label).otherwise(F.concat(s["name"], F.lit("."), label)).alias("name"), end.alias("done"))

    walked = F.aggregate(F.sequence(F.lit(1), F.lit(127)), start, step)
    kind = lambda w: F.conv(F.hex(F.substr(data, w["at"] + 2, F.lit(2))), 16, 10).cast("int")
    names = F.create_map(*(x for k, v in DNS_TYPES.items() for x in (F.lit(k), F.lit(v))))
    flags = number(data, 2, 2)
    fine = (F.octet_length(data) >= 17) & (number(data, 4, 2) >= 1)
    return F.when(
        fine,
        F.get(F.transform(F.array(walked), lambda w: F.struct(number(data, 0, 2).cast("int").alias("id"), (flags >= 0x8000).alias("is_response"), (flags % 16).cast("int").alias("rcode"), w["name"].alias("name"), F.coalesce(F.try_element_at(names, kind(w)), kind(w).cast("string")).alias("type"))), F.lit(0)),
    )


def _commands(text: Column) -> Column:
    """Words of each array of bulk strings, by the lengths they state; bytes that are none are skipped."""
    start = F.struct(F.lit(1).alias("at"), F.array().cast("array<array<string>>").alias("out"))
    count = lambda at, mark: F.regexp_extract(F.substr(text, at, F.lit(16)), rf"^{mark}(\d{{1,9}})\r\n", 1).try_cast("int")
    after = lambda at: F.position(F.lit("\r\n"), text, at) + 2

    def word(w, _):
        def read(n):
            begin = after(w["at"])
            fine = n.isNotNull() & (begin + n <= F.length(text) + 1)
            return F.when(fine, F.struct((begin + n + 2).alias("at"), F.array_append(w["words"], F.substr(text, begin, n)).alias("words"), F.lit(True).alias("fine"))).otherwise(F.struct(w["at"].alias("at"), w["words"].alias("words"), F.lit(False).alias("fine")))

        return F.when(w["fine"], let(count(w["at"], r"\$"), read)).otherwise(w)

    def step(s, _):
        gap = F.regexp_instr(F.substr(text, s["at"]), F.lit(r"\*[1-9]\d{0,8}\r\n\$"))

        def read(begin):
            empty = F.struct(after(begin).alias("at"), F.array().cast("array<string>").alias("words"), F.lit(True).alias("fine"))
            # Each word takes five bytes or more.
            words = F.least(count(begin, r"\*"), F.floor(F.length(text) / 5).cast("int") + 1)
            return let(F.aggregate(F.sequence(F.lit(1), F.greatest(words, F.lit(1))), empty, word), lambda w: F.struct(w["at"].alias("at"), F.when(w["fine"], F.array_append(s["out"], w["words"])).otherwise(s["out"]).alias("out")))

        done = F.struct((F.length(text) + 1).alias("at"), s["out"].alias("out"))
        return let(gap, lambda g: F.when(g == 0, done).otherwise(let(s["at"] + g - 1, read)))

    most = F.greatest(F.regexp_count(text, F.lit(r"\*[1-9]\d{0,8}\r\n\$")), F.lit(1))
    return F.when(text.isNotNull(), F.aggregate(F.sequence(F.lit(1), most), start, step)["out"])


def redis_commands(data: Column) -> Column:
    """Arrays of bulk strings in a client's bytes, words separated by a space.

    ``AUTH`` comes without its arguments, and the password of ``HELLO ... AUTH user password`` is masked.
    """

    def shown(w: Column) -> Column:
        name = F.upper(F.get(w, F.lit(0)))
        hello = F.transform(w, lambda x, i: F.when((i >= 3) & (F.upper(F.get(w, i - 2)) == "AUTH"), "<redacted>").otherwise(x))
        return F.when(name == "AUTH", F.slice(w, 1, 1)).when(name == "HELLO", hello).otherwise(w)

    return F.transform(let(latin1(data), _commands), lambda w: F.array_join(shown(w), " "))


def protobuf_varint(data: Column, at: int = 0) -> Column:
    """The unsigned number of up to nine bytes that begins at ``at``."""
    digits = F.transform(F.sequence(F.lit(at + 1), F.lit(at + 9)), lambda i: F.conv(F.hex(F.substr(data, i, F.lit(1))), 16, 10).cast("long"))
    start = F.struct(F.lit(0).cast("long").alias("value"), F.lit(0).alias("shift"), F.lit(False).alias("done"))
    step = lambda s, b: F.struct(F.when(s["done"] | b.isNull(), s["value"]).otherwise(s["value"] + (b % 128) * F.pow(F.lit(2.0), s["shift"]).cast("long")).alias("value"), (s["shift"] + 7).alias("shift"), (s["done"] | (F.coalesce(b, F.lit(255)) < 128)).alias("done"))
    return F.aggregate(digits, start, step, lambda s: F.when(s["done"], s["value"]))
