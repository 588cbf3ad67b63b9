"""Token-id output as sorted-string-table shards.

A shard holds documents in ascending id order: data blocks with prefix-compressed keys, a sparse index with one
entry for each block, a Bloom filter over the keys, and a fixed-size footer. A reader finds one document by the
footer, the filter, a binary search of the index and one block.

    shard  := magic block* index bloom footer
    block  := zstd(entry*) crc32            entry := varint(shared) varint(unshared) varint(bytes) suffix ids
    key    := 0x00 (null) | 0x01 big-endian(id xor 2^63)      ids := little-endian u16, or u32 if the flag says so

Nulls: a null text is the empty text (only the end id); a null id sorts before all others. Repeated ids are kept,
each as an entry of its own. Extra columns are ignored. An empty table gives no shard.
"""

from __future__ import annotations

import bisect
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, tokens

MAGIC = b"LODESST1"
_FOOTER = struct.Struct("<QQQQQQBxxxxxxx8s")
_INDEX = struct.Struct("<QII")


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(b: bytes, i: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        x = b[i]
        i += 1
        n |= (x & 127) << shift
        if x < 128:
            return n, i
        shift += 7


def key_of(doc_id: int | None) -> bytes:
    return b"\0" if doc_id is None else b"\1" + (int(doc_id) + 2**63).to_bytes(8, "big")


def id_of(key: bytes) -> int | None:
    return None if key == b"\0" else int.from_bytes(key[1:], "big") - 2**63


def _probes(key: bytes, bits: int, hashes: int = 7) -> list[int]:
    import xxhash

    h = xxhash.xxh3_128_intdigest(key)
    a, b = h & 0xFFFFFFFFFFFFFFFF, h >> 64 | 1
    return [(a + i * b) % bits for i in range(hashes)]


class Writer:
    """Appends (key, ids) in key order to a stream; memory is one block, the index and the keys' hashes."""

    def __init__(self, stream, wide: bool, block_bytes: int = 128 << 10):
        import zstandard

        self.out, self.wide, self.block_bytes = stream, wide, block_bytes
        self.zip = zstandard.ZstdCompressor(level=1)
        self.at, self.n, self.n_ids = len(MAGIC), 0, 0
        self.block: list[bytes] = []
        self.size, self.first, self.last = 0, b"", b""
        self.index: list[tuple[bytes, int, int, int]] = []
        self.keys: list[bytes] = []
        stream.write(MAGIC)

    def add(self, key: bytes, ids: np.ndarray) -> None:
        if key < self.last:
            raise ValueError("keys must ascend")
        shared = 0
        if self.block:
            while shared < min(len(key), len(self.last)) and key[shared] == self.last[shared]:
                shared += 1
        else:
            self.first = key
        value = ids.astype("<u4" if self.wide else "<u2", copy=False).tobytes()
        entry = b"".join((_varint(shared), _varint(len(key) - shared), _varint(len(value)), key[shared:], value))
        self.block.append(entry)
        self.size += len(entry)
        self.last, self.n, self.n_ids = key, self.n + 1, self.n_ids + len(ids)
        self.keys.append(key)
        if self.size >= self.block_bytes:
            self._flush()

    def _flush(self) -> None:
        if self.block:
            raw = b"".join(self.block)
            data = self.zip.compress(raw)
            self.out.write(data + struct.pack("<I", zlib.crc32(raw)))
            self.index.append((self.first, self.at, len(data), len(raw)))
            self.at += len(data) + 4
            self.block, self.size = [], 0

    def close(self) -> None:
        self._flush()
        index = b"".join(_varint(len(k)) + k + _INDEX.pack(at, n, raw) for k, at, n, raw in self.index)
        bits = max(64, 10 * len(self.keys))
        bloom = bytearray((bits + 7) // 8)
        for k in self.keys:
            for p in _probes(k, bits):
                bloom[p >> 3] |= 1 << (p & 7)
        self.out.write(index + bytes(bloom))
        self.out.write(_FOOTER.pack(self.at, len(index), self.at + len(index), bits, self.n, self.n_ids, self.wide, MAGIC))


class Reader:
    """Reads a shard from a seekable file."""

    def __init__(self, f, size: int):
        self.f = f
        f.seek(size - _FOOTER.size)
        index_at, index_n, bloom_at, self.bits, self.n, self.n_ids, self.wide, magic = _FOOTER.unpack(f.read(_FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a shard")
        f.seek(index_at)
        raw, i = f.read(index_n), 0
        self.first: list[bytes] = []
        self.blocks: list[tuple[int, int, int]] = []
        while i < len(raw):
            n, i = _read_varint(raw, i)
            self.first.append(raw[i : i + n])
            self.blocks.append(_INDEX.unpack_from(raw, i + n))
            i += n + _INDEX.size
        f.seek(bloom_at)
        self.bloom = f.read((self.bits + 7) // 8)

    def may_hold(self, doc_id: int | None) -> bool:
        return all(self.bloom[p >> 3] >> (p & 7) & 1 for p in _probes(key_of(doc_id), self.bits))

    def _entries(self, k: int) -> Iterator[tuple[bytes, np.ndarray]]:
        import zstandard

        at, n, size = self.blocks[k]
        self.f.seek(at)
        data = self.f.read(n + 4)
        raw = zstandard.ZstdDecompressor().decompress(data[:n], max_output_size=size)
        if zlib.crc32(raw) != struct.unpack("<I", data[n:])[0]:
            raise ValueError(f"block {k} is damaged")
        i, key = 0, b""
        while i < len(raw):
            shared, i = _read_varint(raw, i)
            own, i = _read_varint(raw, i)
            size, i = _read_varint(raw, i)
            key = key[:shared] + raw[i : i + own]
            i += own
            yield key, np.frombuffer(raw, "<u4" if self.wide else "<u2", size // (4 if self.wide else 2), i)
            i += size

    def __iter__(self) -> Iterator[tuple[int | None, np.ndarray]]:
        for k in range(len(self.blocks)):
            for key, ids in self._entries(k):
                yield id_of(key), ids

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """All entries of ``doc_id``; most absent ids cost no block read."""
        if not self.may_hold(doc_id):
            return []
        key, out = key_of(doc_id), []
        k = max(0, bisect.bisect_left(self.first, key) - 1)
        while k < len(self.blocks) and self.first[k] <= key:
            out += [ids for x, ids in self._entries(k) if x == key]
            k += 1
        return out


def open_shard(uri: str) -> Reader:
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    return Reader(store.open_input_file(path), store.get_file_info(path).size)


def write_shards(docs: DataFrame, out: str, tokenizer: str, end_id: int, drops_space: bool = False, shard_bytes: int = 32 << 20) -> DataFrame:
    """Encodes ``docs`` (doc_id, text) into shards below ``out``; returns the manifest, itself a table in the shared folder.

    One range shuffle on doc_id brings the documents in order; each task then streams its range into one shard.
    A shard's name is its own for each attempt and only a finished attempt is listed, so a lost executor leaves
    at most an unlisted file. Manifest: shard (ascending with doc_id), path, n_docs, n_ids.
    """
    spark = docs.sparkSession
    n = common.pieces(docs, shard_bytes)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id")

    def work(batches):
        import pyarrow as pa
        from pyarrow import fs
        from pyspark import TaskContext

        common.claim("tokens")
        enc, shard = tokens.encoder(tokenizer, end_id, drops_space), TaskContext.get().partitionId()
        uri = f"{out}/shard-{shard:06d}-{uuid.uuid4().hex}.sst"
        writer = stream = None
        for part, every, bounds in tokens.encoded(batches, enc):
            if writer is None:
                store, path = fs.FileSystem.from_uri(uri)
                store.create_dir(path.rpartition("/")[0], recursive=True)
                stream = store.open_output_stream(path)
                writer = Writer(stream, enc.wide)
            for doc_id, s, e in zip(part.column(0).to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist()):
                writer.add(key_of(doc_id), every[s:e])
        if writer is not None:
            writer.close()
            stream.close()
            yield pa.RecordBatch.from_pydict({"shard": [shard], "path": [uri], "n_docs": [writer.n], "n_ids": [writer.n_ids]})

    return common.written(rows.mapInArrow(work, "shard long, path string, n_docs long, n_ids long"), "shards-manifest")


def read_shards(manifest: DataFrame) -> DataFrame:
    """Per document of the listed shards: doc_id, start (ids of all documents before it), ids (little-endian u32 bytes)."""
    return _scan(manifest, "doc_id long, start long, ids binary", lambda doc_id, start, ids: (doc_id, start, ids.astype("<u4").tobytes()))


def digest_shards(manifest: DataFrame) -> DataFrame:
    """As :func:`read_shards`, with n_tokens and the crc32 of the ids in place of the ids."""
    return _scan(manifest, "doc_id long, start long, n_tokens long, ids_crc32 long", lambda doc_id, start, ids: (doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))


def _scan(manifest: DataFrame, schema: str, row) -> DataFrame:
    # One row for each shard, never for each document, passes through this single-partition window.
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.select("shard", "path", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("before"))
    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def work(batches):
        import pyarrow as pa

        kinds = {"long": pa.int64(), "binary": pa.binary()}
        fields = pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in schema.split(", ")])
        for batch in batches:
            for path, start in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                out, size = [], 0
                for doc_id, ids in open_shard(path):
                    out.append(row(doc_id, start, ids))
                    start += len(ids)
                    size += len(ids)
                    if len(out) >= 5000 or size > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), fields)], schema=fields)
                        out, size = [], 0
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), fields)], schema=fields)

    return placed.repartitionByRange(n, "shard").mapInArrow(work, schema)


def lookup(manifest: DataFrame, doc_id: int) -> list[np.ndarray]:
    """The ids stored for one document, by Bloom filter and binary search of each shard's index."""
    return [ids for r in manifest.select("path").toLocalIterator() for ids in open_shard(r.path).get(doc_id)]


def op1_sstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document of ``documents`` encoded, written as shards in the shared folder, and read back."""
    docs = common.table(spark, sf_dir, "documents")
    manifest = write_shards(docs, common.scratch(spark, "sst"), tokens.tokenizer_path("byte_bpe_50k.json"), 0)
    return digest_shards(manifest)
