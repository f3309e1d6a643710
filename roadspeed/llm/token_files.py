"""Token-ID output: seekable zstandard files of documents in identifier order.

A file is a row of independent zstandard frames, each with the ids of some
consecutive documents as little-endian unsigned integers; then a skippable frame
with the document index (identifiers and id counts); then the seek table, a
skippable frame of the published seekable format: per frame its compressed and
plain size and the low 32 bits of the plain bytes' XXH64, closed by the frame
count, a descriptor and a magic number. A reader fetches the end of a file,
decompresses only the frames of the documents it wants, and checks each of them.

Documents are range-partitioned by identifier, so a task writes one file and all
files in name order hold all documents in order. A file counts once the manifest
names it; a retried task writes under another name, so lost tasks leave nothing
behind that a reader would see.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from roadspeed.llm.frames import place, session, text_of
from roadspeed.llm.pretokens import CachedEncoder

#: Fixed values of the format.
SEEK_MAGIC, TABLE_MAGIC, INDEX_MAGIC, CHECKSUMS = 0x8F92EAB1, 0x184D2A5E, 0x184D2A50, 0x80
FRAME_BYTES = 1 << 18
END_ID = 2

MANIFEST = "part int, file string, n_docs long, n_ids long"
ROW = "doc_id long, start long, n_tokens long, ids_crc32 long"


class Writer:
    """Writes one file; documents are given in pieces, so that a long one is never held whole."""

    def __init__(self, sink, width: int = 2, frame_bytes: int = FRAME_BYTES, level: int = 3):
        import zstandard

        self.sink, self.dtype, self.frame_bytes = sink, f"<u{width}", frame_bytes
        self.packer = zstandard.ZstdCompressor(level=level, write_content_size=True)
        self.held, self.size, self.entries, self.ids, self.counts = [], 0, [], [], []

    def begin(self, doc_id: int | None) -> None:
        self.ids.append(doc_id)
        self.counts.append(0)

    def add(self, ids: bytes) -> None:
        """More ids of the open document, as little-endian bytes of the file's width."""
        self.counts[-1] += len(ids) // int(self.dtype[2:])
        while len(ids) + self.size >= self.frame_bytes:
            cut = self.frame_bytes - self.size
            self.held.append(ids[:cut])
            self._flush()
            ids = ids[cut:]
        self.held.append(ids)
        self.size += len(ids)

    def _flush(self) -> None:
        import xxhash

        plain = b"".join(self.held)
        if plain:
            frame = self.packer.compress(plain)
            self.sink.write(frame)
            self.entries.append((len(frame), len(plain), xxhash.xxh64(plain).intdigest() & 0xFFFFFFFF))
        self.held, self.size = [], 0

    def close(self) -> None:
        import xxhash

        self._flush()
        index = self.packer.compress(struct.pack("<QB", len(self.ids), int(self.dtype[2:])) + b"".join((
            np.array([i is None for i in self.ids], np.uint8).tobytes(),
            np.array([i or 0 for i in self.ids], "<i8").tobytes(), np.array(self.counts, "<u8").tobytes())))
        self.sink.write(struct.pack("<II", INDEX_MAGIC, len(index)) + index)
        self.entries.append((len(index) + 8, 0, xxhash.xxh64(index).intdigest() & 0xFFFFFFFF))
        table = b"".join(struct.pack("<III", *e) for e in self.entries)
        tail = table + struct.pack("<IBI", len(self.entries), CHECKSUMS, SEEK_MAGIC)
        self.sink.write(struct.pack("<II", TABLE_MAGIC, len(tail)) + tail)


class Reader:
    """Random access to a file by its seek table and document index."""

    def __init__(self, source, size: int):
        import zstandard

        self.source, self.unpacker = source, zstandard.ZstdDecompressor()
        count, flags, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEK_MAGIC or not flags & CHECKSUMS:
            raise ValueError("no seek table with checksums at the end of the file")
        table = np.frombuffer(self._at(size - 9 - 12 * count, 12 * count), "<u4").reshape(-1, 3).astype(np.int64)
        if int(table[:, 0].sum()) + 8 + 12 * count + 9 != size:
            raise ValueError("the seek table does not fit the file")
        self.packed = np.concatenate(([0], np.cumsum(table[:, 0])))
        self.plain = np.concatenate(([0], np.cumsum(table[:, 1])))
        self.sums = table[:, 2]
        index = self._at(int(self.packed[-2]) + 8, int(table[-1, 0]) - 8)
        self._check(index, count - 1)
        raw = self.unpacker.decompress(index)
        n, self.width = struct.unpack_from("<QB", raw)
        null = np.frombuffer(raw, np.uint8, n, 9)
        ids = np.frombuffer(raw, "<i8", n, 9 + n)
        self.ids = [None if z else i for z, i in zip(null.tolist(), ids.tolist())]
        self.counts = np.frombuffer(raw, "<u8", n, 9 + 9 * n).astype(np.int64)
        self.ends = np.cumsum(self.counts)
        self.cached = (-1, b"")

    def _at(self, offset: int, size: int) -> bytes:
        self.source.seek(offset)
        return self.source.read(size)

    def _check(self, data: bytes, frame: int) -> None:
        import xxhash

        if xxhash.xxh64(data).intdigest() & 0xFFFFFFFF != self.sums[frame]:
            raise ValueError(f"checksum of frame {frame} differs")

    def frame(self, k: int) -> bytes:
        if self.cached[0] != k:
            plain = self.unpacker.decompress(self._at(int(self.packed[k]), int(self.packed[k + 1] - self.packed[k])))
            self._check(plain, k)
            self.cached = k, plain
        return self.cached[1]

    def pieces(self, row: int) -> Iterator[np.ndarray]:
        """Ids of the row-th document, at most a frame at a time."""
        a, z = int(self.ends[row] - self.counts[row]) * self.width, int(self.ends[row]) * self.width
        k = int(np.searchsorted(self.plain, a, "right")) - 1
        while a < z:
            stop = min(z, int(self.plain[k + 1]))
            yield np.frombuffer(self.frame(k)[a - int(self.plain[k]):stop - int(self.plain[k])], f"<u{self.width}")
            a, k = stop, k + 1

    def document(self, row: int) -> np.ndarray:
        parts = list(self.pieces(row))
        return np.concatenate(parts) if parts else np.zeros(0, f"<u{self.width}")


def packer(width: int):
    """Ids as little-endian unsigned integers; one that does not fit raises."""
    letter = {2: "H", 4: "I"}[width]
    return lambda ids: struct.pack(f"<{len(ids)}{letter}", *ids)


def _write(folder: str, path: str, end_id: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = CachedEncoder.kept((path, "ids", width), lambda: CachedEncoder(path, packer(width), limit=400_000))
        part, writer, sink, name = TaskContext.get().partitionId(), None, None, ""
        end = np.array([end_id], f"<u{width}").tobytes()
        for batch in batches:
            for doc_id, lists in zip(batch.column(0).to_pylist(), encoder.values(batch.column(1).to_pylist())):
                if writer is None:
                    store, base = place(folder)
                    store.create_dir(base, recursive=True)
                    name = f"part-{part:06d}-{uuid.uuid4().hex}.zst"
                    sink = store.open_output_stream(f"{base}/{name}", compression=None)
                    writer = Writer(sink, width)
                writer.begin(doc_id)
                for values in lists:
                    writer.add(b"".join(values))
                writer.add(end)
        if writer is not None:
            writer.close()
            sink.close()
            yield pa.RecordBatch.from_pylist([{"part": part, "file": name, "n_docs": len(writer.ids), "n_ids": sum(writer.counts)}],
                                             pa.schema([("part", pa.int32()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))
    return run


def write_ids(df: DataFrame, folder: str, path: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text",
              width: int = 2) -> DataFrame:
    """Encode all texts and write them in ascending identifier order; returns the manifest (part, file, n_docs, n_ids).

    ``folder`` is a new folder that all nodes share; its ``manifest`` lists the
    files that count. Null texts are empty (only the end id); null identifiers come
    first; rows that repeat an identifier are ordered by text. ``width`` is the bytes
    per id: ids that do not fit raise. An empty table gives an empty manifest.
    """
    spark = session(df)
    ordered = (df.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
               .repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text"))
    ordered.mapInArrow(_write(folder, path, end_id, width), MANIFEST).write.parquet(f"{folder}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def _read(folder: str):
    def run(batches):
        for batch in batches:
            for name, base in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                store, root = place(folder)
                with store.open_input_file(f"{root}/{name}") as source:
                    reader = Reader(source, source.size())
                    sums = np.zeros(len(reader.ids), np.int64)
                    for row in range(len(reader.ids)):
                        crc = 0
                        for ids in reader.pieces(row):
                            crc = zlib.crc32(ids.astype("<u4").tobytes(), crc)
                        sums[row] = crc
                yield pa.RecordBatch.from_arrays([
                    pa.array(reader.ids, pa.int64()), pa.array(reader.ends - reader.counts + base),
                    pa.array(reader.counts), pa.array(sums)], ["doc_id", "start", "n_tokens", "ids_crc32"])
    return run


def read_digests(spark: SparkSession, folder: str) -> DataFrame:
    """One row per document read back from the files: doc_id, start (ids before it), n_tokens, ids_crc32."""
    manifest = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    files = manifest.count()
    # One row per file, so the running sum is over as many rows as files.
    before = F.sum("n_ids").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    listed = manifest.select("part", "file", F.coalesce(before, F.lit(0)).alias("base"), F.row_number().over(W.orderBy("part")).alias("k"))
    tasks = listed.repartitionById(max(1, files), (F.col("k") - 1).cast("int")).drop("k")
    return tasks.mapInArrow(_read(folder), ROW)


def read_documents(spark: SparkSession, folder: str, doc_ids: list[int]) -> dict[int, list[int]]:
    """Ids of a few requested documents; only their frames are decompressed."""
    store, base = place(folder)
    wanted, out = set(doc_ids), {}
    for row in spark.read.schema(MANIFEST).parquet(f"{folder}/manifest").orderBy("part").toLocalIterator():
        with store.open_input_file(f"{base}/{row.file}") as source:
            reader = Reader(source, source.size())
            for k, i in enumerate(reader.ids):
                if i in wanted:
                    out[i] = reader.document(k).tolist()
    return out
