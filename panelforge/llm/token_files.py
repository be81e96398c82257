"""Token-id files: independent zstandard frames, a document table, and a trailing seek table.

One shard file is

* data frames: each an independent zstandard frame of at most ``FRAME_BYTES`` of
  little-endian token ids (a document may span frames, a frame may hold many documents);
* one skippable frame with the document table (zstandard-compressed): for each document
  its id, whether the id is null, and its token count;
* the seek table of the published seekable zstandard format: a skippable frame with the
  compressed size, raw size and xxh64 checksum (low 32 bits) of each data frame, then a
  footer with the number of frames.

A reader fetches the tail, finds the frames that cover the wanted documents and
decompresses only those, checking each. Files are written under a name of their own
per attempt and renamed at the end, so a lost task leaves no half file behind; the manifest
names only finished files.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import column, new_path, partitions, prepare, stage
from .tokens import encoder

FRAME_BYTES = 1 << 20
# Fixed values of the published formats.
SKIPPABLE_TABLE, SKIPPABLE_SEEK, SEEK_FOOTER, WITH_CHECKSUMS = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1, 0x80


def open_folder(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a folder given by URI or plain path."""
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


class ShardWriter:
    """Appends documents to one shard file."""

    def __init__(self, out, level: int = 3):
        self.out, self.packer = out, zstandard.ZstdCompressor(level=level, write_checksum=False)
        self.pending = bytearray()
        self.frames: list[tuple[int, int, int]] = []
        self.ids: list[np.ndarray] = []
        self.nulls: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []

    def add(self, doc_ids: np.ndarray, nulls: np.ndarray, counts: np.ndarray, data: bytes) -> None:
        self.ids.append(doc_ids)
        self.nulls.append(nulls)
        self.counts.append(counts)
        self.pending += data
        while len(self.pending) >= FRAME_BYTES:
            self._frame(bytes(self.pending[:FRAME_BYTES]))
            del self.pending[:FRAME_BYTES]

    def _frame(self, raw: bytes) -> None:
        packed = self.packer.compress(raw)
        self.out.write(packed)
        self.frames.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))

    def close(self, width: int) -> tuple[int, int]:
        """Write both tables; documents and tokens in the file."""
        if self.pending:
            self._frame(bytes(self.pending))
        ids, nulls, counts = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (self.ids, self.nulls, self.counts))
        table = struct.pack("<BQ", width, len(ids)) + ids.astype("<i8").tobytes() + counts.astype("<i8").tobytes() + nulls.astype("u1").tobytes()
        packed = self.packer.compress(table)
        self.out.write(struct.pack("<II", SKIPPABLE_TABLE, len(packed)) + packed)
        seek = b"".join(struct.pack("<III", *f) for f in self.frames)
        seek += struct.pack("<IBI", len(self.frames), WITH_CHECKSUMS, SEEK_FOOTER)
        self.out.write(struct.pack("<II", SKIPPABLE_SEEK, len(seek)) + seek)
        return len(ids), int(counts.sum()) if len(counts) else 0


class ShardReader:
    """Reads chosen documents of a shard file, decompressing only the frames they lie in."""

    def __init__(self, file):
        self.file = file
        end = file.size()
        n, _, magic = struct.unpack("<IBI", self._at(end - 9, 9))
        if magic != SEEK_FOOTER:
            raise ValueError("no seek table at the end of the file")
        seek_at = end - 9 - 12 * n
        entries = np.frombuffer(self._at(seek_at, 12 * n), "<u4").reshape(n, 3)
        self.frames = entries
        self.starts = np.concatenate([[0], np.cumsum(entries[:, 0], dtype=np.int64)])
        self.raw = np.concatenate([[0], np.cumsum(entries[:, 1], dtype=np.int64)])
        head = self._at(int(self.starts[-1]), 8)
        magic, size = struct.unpack("<II", head)
        if magic != SKIPPABLE_TABLE:
            raise ValueError("no document table behind the frames")
        table = zstandard.ZstdDecompressor().decompress(self._at(int(self.starts[-1]) + 8, size))
        self.width, docs = struct.unpack("<BQ", table[:9])
        self.ids = np.frombuffer(table, "<i8", docs, 9)
        self.counts = np.frombuffer(table, "<i8", docs, 9 + 8 * docs)
        self.nulls = np.frombuffer(table, "u1", docs, 9 + 16 * docs).astype(bool)
        self.bounds = np.concatenate([[0], np.cumsum(self.counts)]).astype(np.int64)
        self.dtype = np.dtype("<u2" if self.width == 2 else "<u4")
        self._last: tuple[int, bytes] = (-1, b"")

    def _at(self, start: int, size: int) -> bytes:
        self.file.seek(start)
        return self.file.read(size)

    def frame(self, k: int) -> bytes:
        if self._last[0] != k:
            raw = zstandard.ZstdDecompressor().decompress(self._at(int(self.starts[k]), int(self.frames[k, 0])), max_output_size=int(self.frames[k, 1]))
            if len(raw) != self.frames[k, 1] or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.frames[k, 2]:
                raise ValueError(f"frame {k} is damaged")
            self._last = (k, raw)
        return self._last[1]

    def document(self, at: int) -> np.ndarray:
        """Ids of the document at a place in the table."""
        lo, hi = int(self.bounds[at]) * self.width, int(self.bounds[at + 1]) * self.width
        if lo == hi:
            return np.zeros(0, self.dtype)
        first = int(np.searchsorted(self.raw, lo, "right")) - 1
        last = int(np.searchsorted(self.raw, hi, "left")) - 1
        parts = [self.frame(k)[max(0, lo - int(self.raw[k])) : hi - int(self.raw[k])] for k in range(first, last + 1)]
        return np.frombuffer(b"".join(parts), self.dtype)


def write_tokens(docs: DataFrame, folder: str, tokenizer_file: str, *, end_id: int | None = 2) -> DataFrame:
    """Encode every text and write shard files in ascending ``doc_id`` order; the manifest.

    Manifest columns: ``shard`` (in doc_id order), ``file``, ``n_docs``, ``n_tokens``. Null
    texts count as empty; null doc_ids come first; repeated rows are written each time;
    other columns are ignored. An empty table gives an empty manifest. Rows are range
    partitioned by doc_id, and each partition streams into one file.
    """
    spark = docs.sparkSession
    prepare(spark)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = out = None
        code = encoder(tokenizer_file)
        store, root = open_folder(folder)
        for batch in batches:
            if not batch.num_rows:
                continue
            if writer is None:
                store.create_dir(root, recursive=True)
                name = f"{root}/{uuid.uuid4().hex}.tokens"
                out = store.open_output_stream(name + ".part")
                writer = ShardWriter(out)
            ids, bounds = code.encode(column(batch, "text"))
            if end_id is not None:
                ids = np.insert(ids, bounds[1:], end_id)
                bounds = bounds + np.arange(len(bounds))
            key = column(batch, "doc_id")
            nulls = key.is_null().to_numpy(zero_copy_only=False)
            writer.add(key.fill_null(0).to_numpy(), nulls, np.diff(bounds), ids.astype(code.dtype).tobytes())
            if len(writer.ids) == 1:
                least, least_null = int(key.fill_null(0).to_numpy()[0]), bool(nulls[0])
        if writer is not None:
            n_docs, n_tokens = writer.close(code.dtype.itemsize)
            out.close()
            store.move(name + ".part", name)
            yield pa.RecordBatch.from_pylist(
                [{"file": name.rsplit("/", 1)[1], "first_null": least_null, "first_id": least, "n_docs": n_docs, "n_tokens": n_tokens}],
                schema=pa.schema([("file", pa.string()), ("first_null", pa.bool_()), ("first_id", pa.int64()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]),
            )

    ordered = docs.select("doc_id", "text").repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    done = stage(ordered.mapInArrow(write, "file string, first_null boolean, first_id long, n_docs long, n_tokens long"), "manifest")
    order = Window.orderBy(F.col("first_null").desc(), "first_id")  # one row per file
    return done.select((F.row_number().over(order) - 1).cast("long").alias("shard"), "file", "n_docs", "n_tokens")


def read_tokens(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """Per document from the files: ``shard``, ``doc_id``, ``at`` (ids before it in the shard),
    ``n_tokens`` and ``ids_crc32`` (of the ids as little-endian unsigned 32-bit integers)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = open_folder(folder)
        for batch in batches:
            for shard, name in zip(column(batch, "shard").to_pylist(), column(batch, "file").to_pylist()):
                with store.open_input_file(f"{root}/{name}") as file:
                    r = ShardReader(file)
                    for lo in range(0, len(r.ids), 10_000):
                        part = range(lo, min(lo + 10_000, len(r.ids)))
                        crc = [zlib.crc32(r.document(k).astype("<u4").tobytes()) for k in part]
                        cut = slice(part.start, part.stop)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(part), shard)), pa.array(r.ids[cut], mask=r.nulls[cut]), pa.array(r.bounds[cut]), pa.array(r.counts[cut]), pa.array(crc, pa.int64())],
                            names=["shard", "doc_id", "at", "n_tokens", "ids_crc32"],
                        )

    files = manifest.select("shard", "file").repartition(partitions(spark), "file")  # a given number: few rows stand for much work
    return files.mapInArrow(read, "shard long, doc_id long, at long, n_tokens long, ids_crc32 long")


def fetch(spark: SparkSession, folder: str, file: str, doc_ids: list[int]) -> dict[int, list[int]]:
    """Ids of a few documents of one file, read without touching other frames."""
    store, root = open_folder(folder)
    with store.open_input_file(f"{root}/{file}") as handle:
        r = ShardReader(handle)
        wanted = set(doc_ids)
        return {int(i): r.document(k).tolist() for k, i in enumerate(r.ids) if int(i) in wanted and not r.nulls[k]}


def token_files(docs: DataFrame, tokenizer_file: str, *, end_id: int | None = 2, folder: str | None = None) -> DataFrame:
    """Write the token files of a table and read them back: ``doc_id``, ``start``, ``n_tokens``, ``ids_crc32``.

    ``start`` counts all ids of the documents before it in doc_id order.
    """
    spark = docs.sparkSession
    folder = folder or new_path(spark, "tokens")
    manifest = write_tokens(docs, folder, tokenizer_file, end_id=end_id)
    before = F.coalesce(F.sum("n_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shards = manifest.select("shard", before.alias("before"))
    return read_tokens(spark, folder, manifest).join(shards, "shard").select(
        "doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32"
    )
