"""Token ids in files of compressed bit or byte planes.

A chunk holds whole documents. Its ids are cut into blocks of a fixed number of ids; each block
is transposed into planes (bit k, or byte k, of every id), each plane is a zstandard frame, and
the chunk's index has the compressed size of every plane of every block, so that a block can be
read alone. Chunks are rows of a Parquet dataset in ascending doc_id order.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import encoder
from .store import table
from .textbytes import slices

CHUNK_IDS = 1 << 20
BLOCK_IDS = 1 << 16
CHUNKS = "part int, chunk int, first_id long, n_ids long, plane_kind string, id_bytes int, block_ids int, doc_ids binary, doc_lengths binary, plane_sizes binary, planes binary, crc32 long"
READ = "doc_id long, start long, n_tokens long, ids_crc32 long"


def to_planes(ids: np.ndarray, kind: str, id_bytes: int) -> np.ndarray:
    """A row of bytes for each plane of one block."""
    cells = ids.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :id_bytes]
    if kind == "byte":
        return np.ascontiguousarray(cells.T)
    return np.packbits(np.unpackbits(np.ascontiguousarray(cells), axis=1, bitorder="little").T, axis=1, bitorder="little")


def from_planes(planes: list[bytes], kind: str, id_bytes: int, n: int) -> np.ndarray:
    cells = np.zeros((n, 4), np.uint8)
    if kind == "byte":
        for k, plane in enumerate(planes):
            cells[:, k] = np.frombuffer(plane, np.uint8)
    else:
        bits = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), bitorder="little")[:n] for p in planes], axis=1)
        cells[:, :id_bytes] = np.packbits(bits, axis=1, bitorder="little")
    return cells.view("<u4").reshape(-1)


def encode_chunk(ids: np.ndarray, kind: str = "byte", block_ids: int = BLOCK_IDS, level: int = 1) -> tuple[int, np.ndarray, bytes]:
    """Bytes an id takes, compressed plane sizes (block by block), and the planes."""
    import zstandard

    press = zstandard.ZstdCompressor(level=level)
    id_bytes = max(1, (int(ids.max()).bit_length() + 7) // 8) if len(ids) else 1
    planes = [press.compress(p.tobytes()) for i in range(0, len(ids), block_ids) for p in to_planes(ids[i : i + block_ids], kind, id_bytes)]
    return id_bytes, np.array([len(p) for p in planes], "<u4"), b"".join(planes)


def decode_chunk(planes: bytes, sizes: np.ndarray, kind: str, id_bytes: int, block_ids: int, n_ids: int) -> np.ndarray:
    import zstandard

    press, out, at = zstandard.ZstdDecompressor(), [np.zeros(0, "<u4")], 0
    bounds = np.concatenate(([0], np.cumsum(sizes.astype(np.int64)))).tolist()
    per = id_bytes * (1 if kind == "byte" else 8)
    for i in range(0, n_ids, block_ids):
        own = [press.decompress(planes[bounds[k] : bounds[k + 1]]) for k in range(at, at + per)]
        out.append(from_planes(own, kind, id_bytes, min(block_ids, n_ids - i)))
        at += per
    return np.concatenate(out)


def chunks(docs: DataFrame, tokenizer: str, end_id: int = 2, kind: str = "byte", block_ids: int = BLOCK_IDS) -> DataFrame:
    """Chunks of all documents in ascending doc_id order (null text: empty; null doc_id first).

    Rows with equal doc_ids follow each other in the order of their texts' hashes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, enc, chunk, first = TaskContext.get().partitionId(), encoder(tokenizer), 0, 0
        held: list[tuple] = []

        def close() -> pa.RecordBatch:
            nonlocal held, chunk, first
            ids, own, lengths = (np.concatenate(x) for x in zip(*held, strict=True))
            id_bytes, sizes, planes = encode_chunk(ids, kind, block_ids)
            row = (part, chunk, first, len(ids), kind, id_bytes, block_ids, own.astype("<i8").tobytes(), lengths.astype("<u4").tobytes(), sizes.tobytes(), planes, zlib.crc32(planes))
            types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.int64()]
            held, chunk, first = [], chunk + 1, first + len(ids)
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], names=[x.split()[0] for x in CHUNKS.split(", ")])

        waiting = 0
        for batch in batches:
            for own in slices(batch):
                ids, counts = enc.encode(own.column(1))
                total = counts + 1
                lead = np.cumsum(total)
                full = np.empty(int(lead[-1]), np.uint32)
                keep = np.ones(len(full), bool)
                keep[lead - 1] = False
                full[keep], full[~keep] = ids, end_id
                held.append((full, own.column(0).fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False), total))
                waiting += len(full)
                if waiting >= CHUNK_IDS:
                    yield close()
                    waiting = 0
        if held:
            yield close()

    order = [F.col("doc_id"), F.xxhash64("text")]
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, CHUNKS)


def read(stored: DataFrame) -> DataFrame:
    """Documents from stored chunks: ids before each in the whole dataset, number of ids, their crc32."""
    sums = {r[0]: r[1] for r in stored.groupBy("part").agg(F.sum("n_ids")).collect()}  # a row per writing task
    base, total = {}, 0
    for part in sorted(sums):
        base[part], total = total, total + sums[part]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                if zlib.crc32(r["planes"]) != r["crc32"]:
                    raise ValueError(f"chunk {r['part']}/{r['chunk']} is damaged")
                ids = decode_chunk(r["planes"], np.frombuffer(r["plane_sizes"], "<u4"), r["plane_kind"], r["id_bytes"], r["block_ids"], r["n_ids"])
                doc, length = np.frombuffer(r["doc_ids"], "<i8"), np.frombuffer(r["doc_lengths"], "<u4").astype(np.int64)
                lead = np.concatenate(([0], np.cumsum(length)))
                data = memoryview(ids).cast("B")
                crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(lead[:-1].tolist(), lead[1:].tolist(), strict=True)]
                null = doc == np.iinfo(np.int64).min
                yield pa.RecordBatch.from_arrays([pa.array(doc, mask=null), pa.array(lead[:-1] + base[r["part"]] + r["first_id"]), pa.array(length), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return stored.mapInArrow(run, READ)


def write_and_read(docs: DataFrame, tokenizer: str, end_id: int = 2, kind: str = "byte") -> DataFrame:
    """Store all documents' ids and return what the stored chunks hold."""
    return read(table(chunks(docs, tokenizer, end_id, kind), "tokens"))
