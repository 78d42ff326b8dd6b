"""Messages of line-based protocols and of protocols with fixed headers, as column expressions.

Layouts are data: a line protocol is a pattern with named parts, a header a list of numbers at
fixed places. Secrets never leave these functions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .protocols import headers, latin1, number

#: The lines of text protocols and the names of their parts.
LINES = {
    "smtp": (r"(\d{3})[ -](.*)|(?i)(HELO|EHLO|LHLO|MAIL|RCPT|DATA|BDAT|RSET|VRFY|EXPN|HELP|NOOP|QUIT|STARTTLS|AUTH)(?:[ ](.*))?", "code text verb argument"),
    "ftp": (r"(\d{3})[ -](.*)|([A-Za-z]{3,4})(?: (.*))?", "code text verb argument"),
    "pop3": (r"(\+OK|-ERR)(?: (.*))?|(?i)(USER|PASS|APOP|AUTH|STAT|LIST|RETR|DELE|NOOP|RSET|QUIT|TOP|UIDL|CAPA|STLS)(?: (.*))?", "status text verb argument"),
    "imap": (r"(\*|\+|[A-Za-z0-9.]+) ([A-Za-z]+|\d+)(?: (.*))?", "tag verb argument"),
    "irc": (r"(?::(\S+) )?([A-Za-z]+|\d{3})(?: ((?!:)\S+(?: (?!:)\S+)*))?(?: :(.*))?", "prefix verb argument trailing"),
    "nats": (r"(?i)(INFO|CONNECT|H?PUB|SUB|UNSUB|H?MSG|PING|PONG|\+OK|-ERR)(?:[ \t]+(.*))?", "verb argument"),
    "memcached": (r"(gets?|gats?|set|add|replace|append|prepend|cas|delete|incr|decr|touch|stats|version|flush_all|quit|VALUE|STORED|NOT_STORED|EXISTS|NOT_FOUND|DELETED|TOUCHED|END|ERROR|CLIENT_ERROR|SERVER_ERROR)(?: (\S+))?(?: (.*))?", "verb key argument"),
    "ssh": (r"SSH-(\d\.\d+)-(\S+)(?: (.*))?", "version software comment"),
}
#: Verbs with a secret behind them, and secret members of JSON options.
SECRET_VERBS = r"(?i)^(PASS|APOP|ACCT|AUTH|LOGIN|AUTHENTICATE)$"
SECRET_MEMBERS = r'(?i)("(?:pass|password|auth_token|token|jwt|nkey|sig)"\s*:\s*)"(?:[^"\\]|\\.)*"'
#: Protocols whose messages are a start line and headers.
START_LINE = r"((?:[A-Z_-]+ \S+ (?:SIP|RTSP|HTTP)/\d\.\d|(?:SIP|RTSP|HTTP)/\d\.\d \d{3}[^\r\n]*)\r\n(?:[^\r\n]++\r\n)*+\r\n)"
#: Numbers in headers as name, place and bytes, for bit fields also shift and bits.
HEADERS = {
    "ntp": "leap 0 1 6 2, version 0 1 3 3, mode 0 1 0 3, stratum 1 1, reference 12 4, transmit 40 4",
    "dns": "id 0 2, is_response 2 1 7 1, opcode 2 1 3 4, rcode 3 1 0 4, questions 4 2, answers 6 2, authorities 8 2, additional 10 2",
    "modbus": "transaction 0 2, length 4 2, unit 6 1, is_exception 7 1 7 1, function 7 1 0 7",
    "radius": "code 0 1, id 1 1, length 2 2",
    "tacacs": "version 0 1, type 1 1, sequence 2 1, unencrypted 3 1 0 1, session 4 4, length 8 4",
    "stun": "type 0 2, length 2 2, cookie 4 4",
    "coap": "version 0 1 6 2, type 0 1 4 2, token_length 0 1 0 4, class 1 1 5 3, detail 1 1 0 5, message 2 2",
    "smpp": "length 0 4, command 4 4, status 8 4, sequence 12 4",
    "tftp": "opcode 0 2",
    "dhcp": "operation 0 1, hardware 1 1, hops 3 1, transaction 4 4, seconds 8 2",
    "nfs": "xid 0 4, is_reply 4 4, rpc_version 8 4, program 12 4, version 16 4, procedure 20 4",
    "kafka": "length 0 4, api 4 2, api_version 6 2, correlation 8 4",
    "cassandra": "is_response 0 1 7 1, version 0 1 0 7, flags 1 1, stream 2 2, opcode 4 1, length 5 4",
    "mqtt": "type 0 1 4 4, duplicate 0 1 3 1, qos 0 1 1 2, retain 0 1 0 1",
    "amqp": "type 0 1, channel 1 2, length 3 4",
    "tls": "content 0 1, version 1 2, length 3 2, handshake 5 1",
    "s7": "length 2 2, cotp 5 1 4 4, protocol 7 1, kind 8 1, reference 11 2",
    "rdp": "length 2 2, cotp 5 1 4 4",
    "socks": "version 0 1, command 1 1",
}
#: The same, least byte first.
LITTLE = {
    "mongodb": "length 0 4, request 4 4, response_to 8 4, opcode 12 4",
    "mysql": "length 0 3, sequence 3 1",
    "enip": "command 0 2, length 2 2, session 4 4, status 8 4",
    "wireguard": "type 0 1, sender 4 4",
    "dnp3": "length 2 1, direction 3 1 7 1, primary 3 1 6 1, function 3 1 0 4, destination 4 2, source 6 2",
    "iec104": "start 0 1, length 1 1, sent 2 2, received 4 2",
}


def line_messages(data: Column, protocol: str) -> Column:
    """Each line of one side that is a message, as JSON of its parts, in order; other lines are left out.

    Mail bodies are skipped; what follows a secret verb, and secret members of options, are masked.
    """
    shape, names = LINES[protocol]
    text = latin1(data)
    if protocol == "smtp":
        text = F.regexp_replace(text, r"(?si)((?:^|\n)DATA\r\n).*?(?:(?<=\n)\.\r\n|\z)", "$1")
    lines = F.filter(F.split(text, r"\r?\n"), lambda x: x.rlike(f"^(?:{shape})$"))
    if protocol == "ssh":
        lines = F.slice(lines, 1, 1)

    def parts(line: Column) -> Column:
        part = {name: F.regexp_extract(line, f"^(?:{shape})$", k) for k, name in enumerate(names.split(), 1)}
        for name in {"argument", "trailing"} & part.keys():
            shown = F.regexp_replace(part[name], SECRET_MEMBERS, '$1"<redacted>"')
            part[name] = F.when((part[name] != "") & part["verb"].rlike(SECRET_VERBS), "<redacted>").otherwise(shown)
        return F.to_json(F.struct(*(F.when(v != "", v).alias(name) for name, v in part.items())))

    return F.transform(lines, parts)


def line_messages_of(protocol: Column, data: Column) -> Column:
    """``line_messages`` by the row's protocol; null for other protocols."""
    return reduce(lambda out, p: out.when(protocol == p, line_messages(data, p)), LINES, F.when(F.lit(False), F.array(F.lit(""))))


def start_line_messages(data: Column) -> Column:
    """SIP, RTSP and SSDP messages: start line and headers, in order."""
    heads = F.regexp_extract_all(latin1(data), F.lit(START_LINE), F.lit(1))
    return F.transform(heads, lambda h: F.struct(F.regexp_extract(h, r"^([^\r\n]*)", 1).alias("start"), headers(h).alias("headers")))


def header(data: Column, protocol: str) -> Column:
    """Numbers of the header at the start of the data, by name; null where bytes are missing."""
    little = protocol in LITTLE
    entries = []
    for spec in (LITTLE if little else HEADERS)[protocol].split(", "):
        name, at, size, *bits = spec.split()
        value = number(data, int(at), int(size), little)
        if bits:
            value = F.shiftright(value, int(bits[0])).bitwiseAND((1 << int(bits[1])) - 1)
        entries += [F.lit(name), value]
    return F.create_map(*entries)


def header_of(protocol: Column, data: Column) -> Column:
    """``header`` by the row's protocol; null for other protocols."""
    return reduce(lambda out, p: out.when(protocol == p, header(data, p)), [*HEADERS, *LITTLE], F.when(F.lit(False), F.create_map(F.lit(""), F.lit(0).cast("long"))))


def syslog(line: Column) -> Column:
    """Facility, severity and fields of an RFC 5424 or RFC 3164 line; null for other lines."""
    new = r"(?s)^<(\d{1,3})>\d{1,2} (\S+) (\S+) (\S+) (\S+) (\S+) (.*)$"
    old = r"(?s)^<(\d{1,3})>(\w{3} [ \d]\d \d\d:\d\d:\d\d) (\S+) ([^:\[\s]+)(?:\[(\d+)\])?: ?(.*)$"
    priority = F.regexp_extract(line, r"^<(\d{1,3})>", 1).try_cast("int")
    part = lambda k_new, k_old: F.nullif(F.nullif(F.when(line.rlike(new), F.regexp_extract(line, new, k_new)).otherwise(F.regexp_extract(line, old, k_old) if k_old else F.lit("")), F.lit("")), F.lit("-"))
    fields = F.struct(F.floor(priority / 8).cast("int").alias("facility"), (priority % 8).alias("severity"), part(2, 2).alias("timestamp"), part(3, 3).alias("host"), part(4, 4).alias("app"), part(5, 5).alias("procid"), part(6, 0).alias("msgid"), part(7, 6).alias("message"))
    return F.when((line.rlike(new) | line.rlike(old)) & (priority < 192), fields)
