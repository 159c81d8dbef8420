"""Token-id files: byte or bit planes of fixed-size id blocks, zstd per plane, with a chunk index.

A file holds whole documents in order:

    magic "GLTF", u8 version, u8 bytes per id, u8 plane kind (0 byte, 1 bit), u8 zero,
    u32 ids per block, u64 ids, u64 documents,
    blocks: for each block its planes, each a zstd frame,
    documents: zstd frame of doc ids (i64, null as the smallest) and of id counts (u64),
    index: u64 place and u32 size of each plane of each block, then of the two document frames,
    u64 place of the index, magic "GLTF".

A reader seeks to the index, then reads only the blocks that it needs.

Cases: a null text counts as empty and still gets its end id; a null doc_id sorts first and is
kept; rows with equal doc_id are ordered by a hash of their text, then the text, so that an id that
many rows share is dealt to many tasks, and equal rows are interchangeable; an empty table
gives no file and no row; extra columns are ignored; a long text may exceed a file's target size,
which ends at the next document.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geomlake.llm import common, word_ids

MAGIC, BLOCK, FILE_IDS = b"GLTF", 1 << 16, 8 << 20
#: Tasks that read files at most; a task reads its files one after the other.
TASKS = 20_000
NULL_ID = np.iinfo(np.int64).min
_HEAD = "<4sBBBBIQQ"


def planes(ids: np.ndarray, kind: int) -> list[bytes]:
    """The byte (0) or bit (1) planes of one block of little-endian unsigned ids."""
    octets = ids.view(np.uint8).reshape(len(ids), ids.dtype.itemsize)
    if kind == 0:
        return [octets[:, k].tobytes() for k in range(octets.shape[1])]
    bits = np.unpackbits(octets, axis=1, bitorder="little")
    return [np.packbits(bits[:, k]).tobytes() for k in range(bits.shape[1])]


def unplanes(parts: list[bytes], n: int, width: int, kind: int) -> np.ndarray:
    if kind == 0:
        octets = np.stack([np.frombuffer(p, np.uint8) for p in parts], axis=1)
    else:
        bits = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), count=n) for p in parts], axis=1)
        octets = np.packbits(bits, axis=1, bitorder="little")
    return np.ascontiguousarray(octets).view(f"<u{width}").ravel()


def file_image(ids: np.ndarray, doc_ids: np.ndarray, counts: np.ndarray, kind: int = 0, block: int = BLOCK, level: int = 3) -> bytes:
    """The bytes of a file that holds these documents."""
    press = zstandard.ZstdCompressor(level=level).compress
    out = bytearray(struct.pack(_HEAD, MAGIC, 1, ids.dtype.itemsize, kind, 0, block, len(ids), len(doc_ids)))
    index = bytearray()

    def put(raw: bytes) -> None:
        frame = press(raw)
        index.extend(struct.pack("<QI", len(out), len(frame)))
        out.extend(frame)

    for start in range(0, len(ids), block):
        for plane in planes(ids[start : start + block], kind):
            put(plane)
    put(doc_ids.astype("<i8").tobytes())
    put(counts.astype("<u8").tobytes())
    at = len(out)
    return bytes(out + index + struct.pack("<Q4s", at, MAGIC))


class TokenFile:
    """Random access to a token file; source: an open seekable binary file."""

    def __init__(self, source):
        self.source = source
        magic, version, self.width, self.kind, _, self.block, self.n_ids, self.n_docs = struct.unpack(_HEAD, self._at(0, struct.calcsize(_HEAD)))
        size = source.size() if callable(getattr(source, "size", None)) else source.seek(0, 2)
        at, tail = struct.unpack("<Q4s", self._at(size - 12, 12))
        if magic != MAGIC or tail != MAGIC or version != 1:
            raise ValueError("not a whole token file")
        self.index = list(struct.iter_unpack("<QI", self._at(at, size - 12 - at)))
        self.per_block = self.width * (8 if self.kind else 1)

    def _at(self, place: int, n: int) -> bytes:
        self.source.seek(place)
        return self.source.read(n)

    def _frame(self, k: int) -> bytes:
        return zstandard.ZstdDecompressor().decompress(self._at(*self.index[k]))

    def documents(self) -> tuple[np.ndarray, np.ndarray]:
        return np.frombuffer(self._frame(len(self.index) - 2), "<i8"), np.frombuffer(self._frame(len(self.index) - 1), "<u8").astype(np.int64)

    def ids(self, start: int = 0, end: int | None = None) -> np.ndarray:
        """The ids from start to end; only their blocks are read."""
        end = self.n_ids if end is None else end
        out = []
        for b in range(start // self.block, -(-end // self.block)) if end > start else ():
            n = min(self.block, self.n_ids - b * self.block)
            part = unplanes([self._frame(b * self.per_block + k) for k in range(self.per_block)], n, self.width, self.kind)
            out.append(part[max(0, start - b * self.block) : end - b * self.block])
        return np.concatenate(out) if out else np.zeros(0, f"<u{self.width}")


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 2, kind: int = 0, file_ids: int = FILE_IDS) -> DataFrame:
    """Tokenizes documents and writes them in ascending doc_id order to token files below folder.

    Returns the files as a table (part, seq, path, n_docs, n_ids), ordered by (part, seq). A task
    writes under a name of its own attempt and renames, so a repeated task leaves the same files.
    """
    source = common.texts(docs)
    dealt = source.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"), "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, task = word_ids.loaded(tokenizer), TaskContext.get()
        store, root = pafs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
        store.create_dir(root, recursive=True)
        ids, names, counts, held, seq = [], [], [], 0, 0

        def flush() -> pa.RecordBatch:
            name = f"{root}/{task.partitionId():08d}-{seq:06d}.gltf"
            temp = f"{name}.{task.taskAttemptId()}.part"
            n_docs = sum(map(len, names))
            with store.open_output_stream(temp, compression=None) as f:
                f.write(file_image(np.concatenate(ids), np.concatenate(names), np.concatenate(counts), kind))
            store.move(temp, name)
            return pa.RecordBatch.from_pydict({"part": [task.partitionId()], "seq": [seq], "path": [name], "n_docs": [n_docs], "n_ids": [held]}, schema=made)

        for batch in common.slices(batches):
            got, offsets = word_ids.with_end(*coder.encode(batch.column(1)), end_id)
            ids.append(got)
            names.append(batch.column(0).fill_null(NULL_ID).to_numpy())
            counts.append(np.diff(offsets))
            held += len(got)
            if held >= file_ids:
                yield flush()
                ids, names, counts, held, seq = [], [], [], 0, seq + 1
        if held:
            yield flush()

    made = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])
    return common.saved(dealt.mapInArrow(write, "part int, seq int, path string, n_docs long, n_ids long"), "token-file-list")


def read_token_files(files: DataFrame, folder: str) -> DataFrame:
    """Per document of the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    A file's start is the sum over earlier files of its part, which a window adds up, and over earlier
    parts, one number for each writing task, which the driver does. Tasks read a file at a time.
    """
    spark = files.sparkSession
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("n"), F.count("*").alias("files")).toPandas().sort_values("part")
    ends = np.cumsum(parts["n"].to_numpy(np.int64))
    before = spark.createDataFrame(list(zip(parts["part"].tolist(), (ends - parts["n"].to_numpy(np.int64)).tolist(), strict=True)), "part int, before long")
    earlier = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    plan = files.withColumn("inside", F.coalesce(F.sum("n_ids").over(earlier), F.lit(0))).join(F.broadcast(before), "part")  # a row for each task
    plan = plan.select("path", (F.col("before") + F.col("inside")).alias("start")).repartition(max(1, min(TASKS, int(parts["files"].sum()))))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = pafs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
        for batch in batches:
            for row in batch.to_pylist():
                with store.open_input_file(row["path"]) as source:
                    held = TokenFile(source)
                    names, counts = held.documents()
                    ends = np.cumsum(counts)
                    raw = memoryview(held.ids().astype("<u4")).cast("B")
                crc = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), counts.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(names, mask=names == NULL_ID), pa.array(row["start"] + ends - counts), pa.array(counts), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return plan.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
