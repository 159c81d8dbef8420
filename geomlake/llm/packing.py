"""Concatenate-and-cut packing of tokenized documents into fixed windows.

Pass one tokenizes each partition once, stores the ids with their place inside the partition and
so gives a token total for each partition. The driver turns these totals (one number for each
task) into prefix sums. Pass two adds a partition's sum to the places, which makes them places
in the one long stream of all tokens, and cuts every document at multiples of the window: piece,
sequence and offset follow from arithmetic on each row alone, without a shuffle.

Only the stream's last window can be short. It is cut at powers of two, largest first, so that
no sequence needs padding at all.

Cases: a null or empty text has its end id alone; a null doc_id is kept; equal rows are packed
each on their own; an empty table gives no piece; a text longer than a window spans several; extra
columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from geomlake.llm import common, word_ids

WINDOW = 2048


def tokenized(docs: DataFrame, tokenizer: str, end_id: int = 1) -> DataFrame:
    """Pass one, stored: part, place (ids before the document in its partition), doc_id, ids (little-endian)."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part, place = word_ids.loaded(tokenizer), TaskContext.get().partitionId(), 0
        for batch in common.slices(batches):
            ids, offsets = word_ids.with_end(*coder.encode(batch.column(1)), end_id)
            n, size = batch.num_rows, ids.dtype.itemsize
            blobs = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((offsets * size).astype(np.int32)), pa.py_buffer(ids)])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, part, np.int32)), pa.array(place + offsets[:-1]), batch.column(0), blobs, pa.array(np.full(n, size, np.int32))], ["part", "place", "doc_id", "ids", "width"])
            place += len(ids)

    return common.saved(common.texts(docs).mapInArrow(encode, "part int, place long, doc_id long, ids binary, width int"), "packing-ids")


def last_cuts(total: int, window: int) -> list[int]:
    """Starts of the sequences of the stream's short last window: powers of two, largest first."""
    at, cuts = total - total % window, []
    while at < total:
        cuts.append(at)
        at += 1 << ((total - at).bit_length() - 1)
    return cuts


def packed(docs: DataFrame, tokenizer: str, end_id: int = 1, window: int = WINDOW) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    held = tokenized(docs, tokenizer, end_id)
    ends = held.selectExpr("part", "place + length(ids) div width AS stop").groupBy("part").agg({"stop": "max"}).toDF("part", "n").collect()
    totals, at = {}, 0
    for row in sorted(ends):
        totals[row["part"]], at = at, at + row["n"]
    base, tail = held.sparkSession.sparkContext.broadcast(totals), last_cuts(at, window)
    full = at - at % window

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "ids"):
            rows = {name: [] for name in made.names}
            for part, place, doc_id, blob, width in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids = np.frombuffer(blob, f"<u{width}").astype("<u4")
                first, n = base.value[part] + place, len(ids)
                marks = [first, *range(first - first % window + window, min(first + n, full + 1), window), *(c for c in tail if first < c < first + n)]
                marks = sorted({m for m in marks if m < first + n})
                for a, b in zip(marks, [*marks[1:], first + n], strict=True):
                    k = max((i for i, c in enumerate(tail) if c <= a), default=0)
                    sequence, opened = (a // window, a - a % window) if a < full else (full // window + k, tail[k])
                    for name, value in zip(made.names, (doc_id, a - first, b - a, zlib.crc32(ids[a - first : b - first]), n, sequence, a - opened), strict=True):
                        rows[name].append(value)
            yield pa.RecordBatch.from_pydict(rows, schema=made)

    made = pa.schema([(name, pa.int64()) for name in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])
    return held.mapInArrow(cut, ", ".join(f"{name} long" for name in made.names))
