"""Whole files as rows: captures whose codec their first bytes tell, folders of samples and of certificates.

Files come through Spark's binary reader, so any store that Spark reads will do. A compressed file
can't be split: it is one row and one task, and a partition holds no more files than
``spark.sql.files.maxPartitionBytes``, or one larger one. Its text is unpacked piece by piece.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .captures import CORRUPT, EVENT, fault

FILE = "path string, modificationTime timestamp, length long, content binary"
LINE = "path string, line_no long, line string, broken string"
#: First bytes of compressed files.
GZIP, ZSTD = b"\x1f\x8b", b"\x28\xb5\x2f\xfd"
#: Packed bytes that are read at once, and lines and characters of a batch.
STEP, LINES, CHARACTERS = 1 << 13, 1 << 13, 1 << 24


def _unpacked(packed: memoryview, fresh: Callable) -> Iterator[bytes]:
    """The text of all members of a file, whose pieces end anywhere; an error if the last member isn't whole."""
    member = fresh()
    for at in range(0, len(packed), STEP):
        rest = bytes(packed[at : at + STEP])
        while rest:
            if member.eof:
                rest = rest.lstrip(b"\0")  # padding between members
                if not rest:
                    break
                member = fresh()
            yield member.decompress(rest)
            rest = member.unused_data if member.eof else b""
    if not member.eof:
        raise EOFError


def _pieces(content: memoryview) -> tuple[str, Iterator[bytes]]:
    head = bytes(content[:4])
    if head[:2] == GZIP:
        return "gzip", _unpacked(content, lambda: zlib.decompressobj(31))
    if head == ZSTD:
        import zstandard

        return "zstd", _unpacked(content, lambda: zstandard.ZstdDecompressor().decompressobj())
    return "plain", (bytes(content[at : at + (1 << 20)]) for at in range(0, len(content), 1 << 20))


def _lines(content: memoryview) -> Iterator[tuple[int, bytes | None, str | None]]:
    """Numbered lines without empty ones; a broken file ends with its codec."""
    codec, pieces = _pieces(content)
    open_, n = [], 1
    broken = None
    try:
        for piece in pieces:
            *whole, last = piece.split(b"\n")
            for line in whole:
                open_.append(line)
                line = b"".join(open_)
                open_.clear()
                if line:
                    yield n, line, None
                n += 1
            open_.append(last)
    except Exception as error:
        # Each library has its own error for bytes that it can't unpack; any other is a fault of this code.
        if not isinstance(error, (EOFError, zlib.error)) and type(error).__name__ != "ZstdError":
            raise
        broken = codec
    if any(open_):
        yield n, b"".join(open_), None
        n += 1
    if broken:
        yield n, None, broken


def lines(files: DataFrame) -> DataFrame:
    """``path``, ``line_no`` (from 1), ``line`` and ``broken`` of files with ``path`` and ``content``.

    gzip (any number of members), zstandard (any number of frames) and plain text are told by their
    first bytes, whatever the name says. Empty lines are left out but counted; bytes that aren't UTF-8
    become U+FFFD. A file that ends early or is damaged gives the lines before that, then one row with
    its codec in ``broken`` and no line. Null and empty files have no lines.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                held, size = [], 0
                for row in _lines(memoryview(content.as_buffer() if content.is_valid else b"")):
                    held.append(row)
                    size += len(row[1] or b"")
                    if len(held) == LINES or size >= CHARACTERS:
                        yield batch_of(path, held)
                        held, size = [], 0
                yield batch_of(path, held)

    def batch_of(path: str, rows: list) -> pa.RecordBatch:
        text = [None if line is None else line.decode("utf-8", "replace") for _, line, _ in rows]
        return pa.RecordBatch.from_arrays([pa.array([path] * len(rows), pa.string()), pa.array([n for n, _, _ in rows], pa.int64()), pa.array(text, pa.string()), pa.array([b for _, _, b in rows], pa.string())], names=["path", "line_no", "line", "broken"])

    return files.select(F.col("path").cast("string"), "content").mapInArrow(run, LINE)


def parsed(numbered: DataFrame) -> DataFrame:
    """Lines as capture rows, as ``captures.read_lines`` gives them, with ``path`` and ``line_no``; a broken file counts as one faulty line."""
    schema = T.StructType([*EVENT.fields, T.StructField(CORRUPT, T.StringType())])
    event = F.from_json("line", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    out = numbered.select("path", "line_no", "broken", event.alias("e")).select("path", "line_no", "broken", "e.*")
    return out.withColumn(CORRUPT, F.coalesce(CORRUPT, F.concat(F.lit("broken "), "broken"))).drop("broken")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return parsed(lines(spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)))


def stream_lines(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    return parsed(lines(spark.readStream.format("binaryFile").schema(FILE).option("maxFilesPerTrigger", files_per_trigger).load(path)))


def faults(rows: DataFrame) -> DataFrame:
    """Lines of each file and how many of them are no events, by reason."""
    told = rows.withColumn("fault", fault())
    return told.groupBy("path").agg(F.count("*").alias("lines"), F.count("fault").alias("faulty"), *(F.count_if(F.col("fault") == x).alias(x) for x in ("json", "missing", "unknown")))


def samples(spark: SparkSession, path: str, largest: int = 4 << 20) -> DataFrame:
    """``sample`` (the path) and ``content`` of all files below a folder; the empty and those beyond ``largest`` bytes are no messages."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return found.where(F.col("length").between(1, largest)).select(F.col("path").alias("sample"), "content")


def pins(spark: SparkSession, path: str) -> DataFrame:
    """SHA-256 of each different ``*.der`` file of a folder; a folder that doesn't exist is an error."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.der").load(path)
    return found.select(F.sha2("content", 256).alias("sha256")).distinct()
