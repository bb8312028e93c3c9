"""Operator 6, token ids as length-delimited binary records.

A record is its length (8 bytes, little endian), the masked CRC-32C of those, the data, and the data's masked CRC-32C: the framing that
readers of such record files know. The data are doc_id (8 bytes) and the token ids, with 2 bytes each. Every task writes a file of its own; a separate
index has the offset of each record, so that records can be read in any order. There is no end mark in the data: the frame tells where they end.

A task that is run again writes a new file, and the index names the files of the tasks that ended well, so lost executors
leave at most files that nothing refers to.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkernel as tk
from .shared import fresh_path, partitions, save, small_batches, table, texts
from .tokenizer import RANKS, encoder, ids_of

POLYNOMIAL = 0x82F63B78
PIECE = 256
HEAD, TAIL = 12, 4


def _table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(POLYNOMIAL), t >> 1)
    return t.astype(np.uint32)


TABLE = _table()


def _shift_tables(n: int) -> np.ndarray:
    """The effect of n zero bytes on a CRC register, by each of its bytes."""
    out = np.arange(256, dtype=np.uint32)[None, :] << (np.arange(4, dtype=np.uint32)[:, None] * np.uint32(8))
    for _ in range(n):
        out = TABLE[out & 255] ^ (out >> np.uint32(8))
    return out


SHIFT = _shift_tables(PIECE)


def _shifted(crc: np.ndarray) -> np.ndarray:
    return SHIFT[0][crc & 255] ^ SHIFT[1][(crc >> np.uint32(8)) & 255] ^ SHIFT[2][(crc >> np.uint32(16)) & 255] ^ SHIFT[3][crc >> np.uint32(24)]


def crc32c(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """CRC-32C of data[start:start + size] for each pair. Pieces of all records are run side by side; then each record's are folded."""
    n = len(starts)
    counts = -(-sizes // PIECE)
    owner = np.repeat(np.arange(n), counts)
    index = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    # the first piece of a record is the short one: zeros before a message leave a zero register as it is
    short = sizes - (counts - 1) * PIECE
    at = starts[owner] + np.where(index == 0, 0, short[owner] + (index - 1) * PIECE)
    length = np.where(index == 0, short[owner], PIECE)
    crc = np.zeros(len(owner), np.uint32)
    order = np.argsort(-length, kind="stable")
    crc_o, at_o, length_o = crc[order], at[order], length[order]
    # the register's start value is all ones: it is put over the first four bytes, or what there is of them
    opening = np.where(index == 0, np.uint32(0xFFFFFFFF), np.uint32(0))[order].astype(np.uint32)
    crc_o = opening
    lengths_desc = -length_o
    for j in range(PIECE):
        live = int(np.searchsorted(lengths_desc, -j, side="left"))
        if not live:
            break
        crc_o[:live] = TABLE[(crc_o[:live] ^ data[at_o[:live] + j]) & 255] ^ (crc_o[:live] >> np.uint32(8))
    crc[order] = crc_o
    out = np.full(n, 0xFFFFFFFF, np.uint32)
    begins = np.cumsum(counts) - counts
    by = np.argsort(-counts, kind="stable")
    desc = -counts[by]
    for j in range(int(counts.max()) if n else 0):
        own = by[: int(np.searchsorted(desc, -j, side="left"))]
        piece = crc[begins[own] + j]
        out[own] = piece if j == 0 else _shifted(out[own]) ^ piece
    return out ^ np.uint32(0xFFFFFFFF)


def masked(crc: np.ndarray) -> np.ndarray:
    return ((crc >> np.uint32(15)) | (crc << np.uint32(17))) + np.uint32(0xA282EAD8)


def frame(payloads: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The framed records, their offsets and the masked checksums of their data."""
    sizes = np.array([len(p) for p in payloads], np.int64)
    offsets = np.r_[0, np.cumsum(sizes + HEAD + TAIL)]
    out = np.zeros(offsets[-1], np.uint8)
    lengths = sizes.astype("<u8").view(np.uint8).reshape(-1, 8)
    out[offsets[:-1, None] + np.arange(8)] = lengths
    flat = lengths.reshape(-1)
    out[offsets[:-1, None] + 8 + np.arange(4)] = masked(crc32c(flat, np.arange(len(sizes)) * 8, np.full(len(sizes), 8))).astype("<u4").view(np.uint8).reshape(-1, 4)
    body = np.frombuffer(b"".join(payloads), np.uint8)
    begins = np.cumsum(sizes) - sizes
    sums = masked(crc32c(body, begins, sizes))
    out[np.arange(len(body)) + np.repeat(offsets[:-1] + HEAD - begins, sizes)] = body
    out[offsets[1:, None] - TAIL + np.arange(4)] = sums.astype("<u4").view(np.uint8).reshape(-1, 4)
    return out.tobytes(), offsets[:-1], sums


def parse(record: bytes) -> bytes:
    """A record's data; ValueError if a checksum or a length is wrong."""
    raw = np.frombuffer(record, np.uint8)
    if len(raw) < HEAD + TAIL:
        raise ValueError("a record is cut off")
    size = int(raw[:8].view("<u8")[0])
    if masked(crc32c(raw, np.array([0]), np.array([8])))[0] != raw[8:12].view("<u4")[0]:
        raise ValueError("the checksum of a record's length is wrong")
    if len(raw) != size + HEAD + TAIL:
        raise ValueError("a record's length is wrong")
    if masked(crc32c(raw, np.array([HEAD]), np.array([size])))[0] != np.frombuffer(record[-4:], "<u4")[0]:
        raise ValueError("the checksum of a record's data is wrong")
    return record[HEAD:-TAIL]


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _write(batches, folder, ranks):
    encode = ids_of(ranks)
    out, at, number, name = None, 0, 0, f"part-{uuid.uuid4().hex}.rec"
    for b in tk.slices(batches):
        if out is None:
            system, path = _filesystem(folder)
            system.create_dir(path, recursive=True)
            out = system.open_output_stream(f"{path}/{name}")
        ids = b.column("doc_id").to_pylist()
        tokens = [np.array(encode(x), "<u2") for x in b.column("text").to_pylist()]
        data, offsets, sums = frame([i.to_bytes(8, "little", signed=True) + t.tobytes() for i, t in zip(ids, tokens)])
        out.write(data)
        n = b.num_rows
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), pa.array([f"{folder}/{name}"] * n), pa.array(np.arange(number, number + n)), pa.array(offsets + at), pa.array(np.diff(np.r_[offsets, len(data)])), pa.array([len(t) for t in tokens], pa.int64()), pa.array(sums.astype(np.int64))],
            ["doc_id", "file", "record", "offset", "length", "n_tokens", "checksum"],
        )
        at += len(data)
        number += n
    if out is not None:
        out.close()


INDEX = "doc_id bigint, file string, record bigint, offset bigint, length bigint, n_tokens bigint, checksum bigint"


def write_records(docs: DataFrame, folder: str | None = None, ranks: str = RANKS) -> DataFrame:
    """Write the records and return their index: doc_id, file, record (its number in the file), offset, length (with its frame), n_tokens, checksum.

    Null texts and rows without doc_id are left out; an empty text gives a record without tokens; a repeated row is written as often
    as it comes; other columns are ignored; an empty table gives an empty index and no file. The vocabulary must have 65,536 ids at most."""
    spark = docs.sparkSession
    small_batches(spark)
    if encoder(ranks).n_vocab > 1 << 16:
        raise ValueError("token ids must fit in two bytes")
    folder = folder or fresh_path(spark, "records")
    return save(texts(docs).mapInArrow(lambda it: _write(it, folder, ranks), INDEX), "index")


def _read(batches):
    system, opened, name = None, None, None
    for b in batches:
        ids, tokens = [], []
        for file, offset, length in zip(*(b.column(c).to_pylist() for c in ("file", "offset", "length"))):
            if file != name:
                if opened is not None:
                    opened.close()
                system, path = _filesystem(file)
                opened, name = system.open_input_file(path), file
            data = parse(opened.read_at(length, offset))
            ids.append(int.from_bytes(data[:8], "little", signed=True))
            tokens.append(np.frombuffer(data[8:], "<u2").astype(np.int32))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(tokens, pa.list_(pa.int32()))], ["doc_id", "tokens"])
    if opened is not None:
        opened.close()


def read_records(index: DataFrame) -> DataFrame:
    """doc_id and tokens of the records that the rows of an index name, whatever their order; checksums are verified."""
    return index.select("file", "offset", "length").mapInArrow(_read, "doc_id bigint, tokens array<int>")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return write_records(table(spark, sf_dir, "documents"))
