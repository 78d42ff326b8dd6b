"""Line messages, fixed headers and system log lines of further protocols, over inline payloads."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import messages as M
from .content import values
from .registry import query

_SIDES = {
    "smtp": "220 mx ready\r\nEHLO a.example\r\nAUTH PLAIN c2VjcmV0\r\nDATA\r\nPASS me not\r\n.\r\nQUIT\r\n",
    "ftp": "USER ann\r\nPASS hunter2\r\n230 Logged in\r\n",
    "pop3": "+OK ready\r\nUSER ann\r\nPASS x\r\nSTAT\r\n",
    "imap": "a1 LOGIN ann pw\r\n* 3 EXISTS\r\na1 OK done\r\n",
    "irc": "PASS :pw\r\n:ann!a@h PRIVMSG #c :hello there\r\nNICK ann\r\n",
    "nats": 'CONNECT {"user":"u","pass":"p"}\r\nPUB a.b 3\r\nabc\r\nPING\r\n',
    "memcached": "set k 0 60 5\r\nvalue\r\nget k\r\nSTORED\r\n",
    "ssh": "SSH-2.0-OpenSSH_9.6 Ubuntu\r\nSSH-2.0-x\r\n",
}
_SAID = {
    "smtp": ['{"code":"220","text":"mx ready"}', '{"verb":"EHLO","argument":"a.example"}', '{"verb":"AUTH","argument":"<redacted>"}', '{"verb":"DATA"}', '{"verb":"QUIT"}'],
    "ftp": ['{"verb":"USER","argument":"ann"}', '{"verb":"PASS","argument":"<redacted>"}', '{"code":"230","text":"Logged in"}'],
    "pop3": ['{"status":"+OK","text":"ready"}', '{"verb":"USER","argument":"ann"}', '{"verb":"PASS","argument":"<redacted>"}', '{"verb":"STAT"}'],
    "imap": ['{"tag":"a1","verb":"LOGIN","argument":"<redacted>"}', '{"tag":"*","verb":"3","argument":"EXISTS"}', '{"tag":"a1","verb":"OK","argument":"done"}'],
    "irc": ['{"verb":"PASS","trailing":"<redacted>"}', '{"prefix":"ann!a@h","verb":"PRIVMSG","argument":"#c","trailing":"hello there"}', '{"verb":"NICK","argument":"ann"}'],
    "nats": [r'{"verb":"CONNECT","argument":"{\"user\":\"u\",\"pass\":\"<redacted>\"}"}', '{"verb":"PUB","argument":"a.b 3"}', '{"verb":"PING"}'],
    "memcached": ['{"verb":"set","key":"k","argument":"0 60 5"}', '{"verb":"get","key":"k"}', '{"verb":"STORED"}'],
    "ssh": ['{"version":"2.0","software":"OpenSSH_9.6","comment":"Ubuntu"}'],
}
_LINES = ", ".join(f"('{p}', '{s.encode().hex()}')" for p, s in _SIDES.items())
_EXPECTED = ", ".join(f"('{p}', {k}, '{m}')" for p, said in _SAID.items() for k, m in enumerate(said))


@query(f"SELECT protocol, ordinal, message FROM (VALUES {_EXPECTED}) AS t(protocol, ordinal, message)")
def line_messages(spark, sf_dir):
    own = values(spark, "protocol, payload", f"{_LINES}, ('smtp', ''), ('other', '00'), ('ftp', NULL)")
    return own.select("protocol", F.posexplode(M.line_messages_of(F.col("protocol"), F.unhex("payload"))).alias("ordinal", "message"))


_HEADERS = {
    "ntp": ("1c0100e9" + "00000000" * 2 + "47505300" + "00000000" * 6 + "e0000001" + "00000000", {"leap": 0, "version": 3, "mode": 4, "stratum": 1, "reference": 1196446464, "transmit": 3758096385}),
    "modbus": ("000100000003118302", {"transaction": 1, "length": 3, "unit": 17, "is_exception": 1, "function": 3}),
    "coap": ("4401abcd", {"version": 1, "type": 0, "token_length": 4, "class": 0, "detail": 1, "message": 43981}),
    "mongodb": ("100000000700000000000000dd070000", {"length": 16, "request": 7, "response_to": 0, "opcode": 2013}),
    "mqtt": ("3b00", {"type": 3, "duplicate": 1, "qos": 1, "retain": 1}),
    "kafka": ("0000001400030009000000ff", {"length": 20, "api": 3, "api_version": 9, "correlation": 255}),
    "wireguard": ("0100000005000000", {"type": 1, "sender": 5}),
    "dns": ("123481830001000000000001", {"id": 4660, "is_response": 1, "opcode": 0, "rcode": 3, "questions": 1, "answers": 0, "authorities": 0, "additional": 1}),
}
_FIELDS = ", ".join(f"('{p}', '{name}', {value})" for p, (_, fields) in _HEADERS.items() for name, value in fields.items())


@query(f"SELECT protocol, field, CAST(value AS BIGINT) AS value FROM (VALUES {_FIELDS}, ('tftp', 'opcode', NULL)) AS t(protocol, field, value)")
def fixed_headers(spark, sf_dir):
    rows = ", ".join(f"('{p}', '{data}')" for p, (data, _) in _HEADERS.items())
    own = values(spark, "protocol, payload", f"{rows}, ('tftp', '00'), ('other', '0000')")
    return own.select("protocol", F.explode(M.header_of(F.col("protocol"), F.unhex("payload"))).alias("field", "value"))


_LOG = "('<34>1 2003-10-11T22:14:15.003Z mx.example su - ID47 it failed', 4, 2, '2003-10-11T22:14:15.003Z', 'mx.example', 'su', NULL, 'ID47', 'it failed'), ('<13>Feb  5 17:32:18 host cron[42]: job: done', 1, 5, 'Feb  5 17:32:18', 'host', 'cron', '42', NULL, 'job: done'), ('<999>1 a b c d e f', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL), ('plain', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL)"
_PARTS = ["facility", "severity", "timestamp", "host", "app", "procid", "msgid", "message"]


@query(f"SELECT line, {', '.join(_PARTS)} FROM (VALUES {_LOG}) AS t(line, {', '.join(_PARTS)})")
def syslog_lines(spark, sf_dir):
    own = values(spark, f"line, {', '.join('x_' + p for p in _PARTS)}", _LOG)
    return own.select("line", M.syslog(F.col("line")).alias("s")).select("line", *(f"s.{p}" for p in _PARTS))


_CALL = "INVITE sip:bob@b.example SIP/2.0\r\nCall-ID: 1@a\r\nCSeq: 1 INVITE\r\n\r\nSIP/2.0 200 OK\r\nCall-ID: 1@a\r\n\r\n"


@query("SELECT ordinal, start, call_id FROM (VALUES (0, 'INVITE sip:bob@b.example SIP/2.0', '1@a'), (1, 'SIP/2.0 200 OK', '1@a')) AS t(ordinal, start, call_id)")
def sip_messages(spark, sf_dir):
    from ..functions.text import header_value

    own = values(spark, "payload", f"('{_CALL.encode().hex()}'), ('')")
    each = own.select(F.posexplode(M.start_line_messages(F.unhex("payload"))).alias("ordinal", "m"))
    return each.select("ordinal", "m.start", header_value(F.col("m.headers"), "call-id").alias("call_id"))
