"""Token counts under a byte-pair vocabulary: heap-and-linked-list merging that emits no ids.

The symbols of a stretch of text form a linked list; a heap holds its adjacent pairs by rank. The
lowest-ranked pair that still stands is merged until none is left; the count is the number of
initial symbols minus the merges (a symbol outside the vocabulary counts its UTF-8 bytes).

Two characters that stand side by side in no vocabulary piece can never be merged across, so a
text is first cut there: the counts of the stretches add up to the count of the whole text, and
each distinct stretch is merged once per worker.

Cases: a null or empty text has 0 tokens; a text of any length is counted whole; a null doc_id
is kept; repeated rows are counted each; an empty table gives no row; extra columns are ignored.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from geomlake.llm import common

SPACE = "▁"
CACHE = 600_000


class PieceCounter:
    """Counts tokens as the vocabulary's library does: a dummy space in front, spaces kept."""

    def __init__(self, path: str, cache: int = CACHE):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.vocab_size()
        kept = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.ranks = {model.id_to_piece(i): -model.get_score(i) for i in kept}
        self.pairs = {piece[i : i + 2] for piece in self.ranks for i in range(len(piece) - 1)}
        self.words, self.stretches, self.limit = {}, {}, cache

    def merged(self, text: str) -> int:
        """Tokens of one stretch."""
        n, ranks = len(text), self.ranks
        if n == 1 or text in ranks and n == 2:
            return 1 if text in ranks else len(text.encode())
        end, after, before = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(text[i : i + 2])) is not None]
        heapq.heapify(heap)
        merges, live = 0, [True] * n
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = after[i] if live[i] else n
            if j >= n or end[j] != stop or not live[i]:
                continue
            merges += 1
            live[j], end[i], after[i] = False, stop, after[j]
            k = after[i]
            if k < n:
                before[k] = i
                if (r := ranks.get(text[i : end[k]])) is not None:
                    heapq.heappush(heap, (r, i, end[k]))
            h = before[i]
            if h >= 0 and (r := ranks.get(text[h:stop])) is not None:
                heapq.heappush(heap, (r, h, stop))
        alone = (text[i] for i in range(n) if live[i] and end[i] == i + 1 and text[i] not in ranks)
        return n - merges + sum(len(c.encode()) - 1 for c in alone)

    def counted(self, text: str) -> int:
        """Tokens of a run of text whose spaces are already marked."""
        pairs, known, total, start = self.pairs, self.stretches, 0, 0
        for i in range(1, len(text) + 1):
            if i == len(text) or text[i - 1 : i + 1] not in pairs:
                part = text[start:i]
                n = known.get(part)
                if n is None:
                    n = known[part] = self.merged(part)
                total, start = total + n, i
        return total

    def counts(self, texts: pa.Array) -> np.ndarray:
        """Tokens of every text of an array without nulls."""
        if len(self.words) > self.limit:
            self.words.clear()
        if len(self.stretches) > self.limit:
            self.stretches.clear()
        words = pc.split_pattern(texts, " ")
        coded = words.values.dictionary_encode()
        values = coded.dictionary.to_pylist()
        known = self.words
        for w in values:
            if w not in known:
                known[w] = self.counted(SPACE + w)
        each = np.fromiter((known[w] for w in values), np.int64, len(values))[coded.indices.to_numpy(zero_copy_only=False)]
        sums = np.concatenate([[0], np.cumsum(each)])
        offsets = words.offsets.to_numpy()
        out = sums[offsets[1:]] - sums[offsets[:-1]]
        # Runs of spaces can merge with one another: these texts are counted by their own stretches.
        odd = pc.match_substring_regex(texts, f"  |^ | $|^$|{SPACE}").to_numpy(zero_copy_only=False)
        for i in np.flatnonzero(odd):
            text = texts[int(i)].as_py()
            marked = (SPACE + text.replace(" ", SPACE)) if text else ""
            out[i] = sum(known[u[1:]] if u[1:] in known and u[:1] == SPACE and SPACE not in u[1:] else self.counted(u) for u in _UNITS.findall(marked))
        return out


_UNITS = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
_LOADED: dict[str, PieceCounter] = {}


def loaded(path: str) -> PieceCounter:
    if path not in _LOADED:
        _LOADED[path] = PieceCounter(path)
    return _LOADED[path]


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 4096) -> DataFrame:
    """Per document: doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = loaded(vocabulary)
        for batch in common.slices(batches):
            n = counter.counts(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pc.binary_length(batch.column(1)).cast(pa.int64()), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return common.texts(docs).mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
