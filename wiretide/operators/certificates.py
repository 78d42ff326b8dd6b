"""Certificates seen on the wire: their main fields and what is odd about them."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import UTC, datetime

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIELDS = "subject string, issuer string, subject_cn string, issuer_cn string, names int, not_before timestamp, not_after timestamp, signature string, rsa_bits int, self_signed boolean"
#: Signature algorithms that are broken (MD2, MD5, SHA-1 with RSA; SHA-1 with ECDSA).
WEAK_SIGNATURES = ["1.2.840.113549.1.1.2", "1.2.840.113549.1.1.4", "1.2.840.113549.1.1.5", "1.2.840.10045.4.1"]
RSA, COMMON_NAME, ALTERNATIVE_NAMES = "1.2.840.113549.1.1.1", "2.5.4.3", "2.5.29.17"
LONGEST_DAYS, LEAST_RSA_BITS = 398, 2048


def elements(data: bytes) -> list[tuple[int, bytes, bytes]]:
    """Tag, contents and whole encoding of each DER element in a row."""
    out, at = [], 0
    while at < len(data):
        start, tag, size = at, data[at], data[at + 1]
        at += 2
        if size & 0x80:
            n = size & 0x7F
            size, at = int.from_bytes(data[at : at + n], "big"), at + n
        if at + size > len(data):
            raise ValueError("cut short")
        out.append((tag, data[at : at + size], data[start : at + size]))
        at += size
    return out


def oid(data: bytes) -> str:
    numbers, value = [data[0] // 40, data[0] % 40] if data[0] < 80 else [2, data[0] - 80], 0
    for byte in data[1:]:
        value = value << 7 | byte & 0x7F
        if not byte & 0x80:
            numbers.append(value)
            value = 0
    return ".".join(map(str, numbers))


def name_of(data: bytes) -> tuple[str, str | None]:
    """All parts of a distinguished name as text, and the common name."""
    parts = []
    for _, attributes, _ in elements(data):
        for _, pair, _ in elements(attributes):
            (_, kind, _), (_, value, _) = elements(pair)[:2]
            parts.append((oid(kind), value.decode("utf-8", "replace")))
    return ", ".join(f"{k}={v}" for k, v in parts), next((v for k, v in parts if k == COMMON_NAME), None)


def moment(tag: int, data: bytes) -> datetime:
    text = data.decode()
    if tag == 0x17:  # two digits of the year
        text = ("20" if int(text[:2]) < 50 else "19") + text
    return datetime.strptime(text[:14], "%Y%m%d%H%M%S").replace(tzinfo=UTC)


def certificate(der: bytes | None) -> dict:
    """The fields of an X.509 certificate; all empty if the bytes aren't one."""
    try:
        body = elements(elements(elements(der)[0][1])[0][2])[0][1]
        parts = elements(body)
        if parts[0][0] == 0xA0:
            parts = parts[1:]
        algorithm, issuer, validity, subject, key = parts[1:6]
        begin, end = elements(validity[1])
        kind, bits = elements(key[1])
        rsa = None
        if oid(elements(kind[1])[0][1]) == RSA:
            rsa = int.from_bytes(elements(elements(bits[1][1:])[0][1])[0][1], "big").bit_length()
        names = 0
        for tag, data, _ in parts[6:]:
            for _, extension, _ in elements(elements(data)[0][1]) if tag == 0xA3 else []:
                items = elements(extension)
                if oid(items[0][1]) == ALTERNATIVE_NAMES:
                    names = len(elements(elements(items[-1][1])[0][1]))
        whole, cn = name_of(subject[1])
        by, by_cn = name_of(issuer[1])
        return {"subject": whole, "issuer": by, "subject_cn": cn, "issuer_cn": by_cn, "names": names, "not_before": moment(*begin[:2]), "not_after": moment(*end[:2]), "signature": oid(elements(algorithm[1])[0][1]), "rsa_bits": rsa, "self_signed": subject[1] == issuer[1]}
    except (ValueError, IndexError, TypeError):
        return {}


def parsed(certificates: DataFrame, der: str = "der") -> DataFrame:
    """Adds sha256 and ``x509`` (null fields where the bytes are no certificate)."""

    @F.pandas_udf(FIELDS)
    def read(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        columns = [f.split()[0] for f in FIELDS.split(", ")]
        for column in batches:
            rows = pd.DataFrame([certificate(d) for d in column], columns=columns, index=column.index, dtype=object)
            for c in ("not_before", "not_after"):
                rows[c] = pd.to_datetime(rows[c], utc=True)
            yield rows

    return certificates.withColumns({"sha256": F.sha2(der, 256), "x509": read(F.col(der))})


def anomalies(at: Column) -> Column:
    """What is odd about ``x509`` at a moment."""
    own = lambda c: F.col(f"x509.{c}")
    rules = {
        "self_signed": own("self_signed"),
        "weak_signature": own("signature").isin(WEAK_SIGNATURES),
        "short_rsa_key": own("rsa_bits") < LEAST_RSA_BITS,
        "not_valid_now": (at < own("not_before")) | (at > own("not_after")),
        "long_validity": F.timestamp_diff("DAY", own("not_before"), own("not_after")) > LONGEST_DAYS,
    }
    return F.filter(F.array(*(F.when(rule, F.lit(name)) for name, rule in rules.items())), lambda x: x.isNotNull())


def first_of_each(certificates: DataFrame) -> DataFrame:
    return certificates.dropDuplicates(["sha256"])
