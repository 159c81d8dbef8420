"""Token ids of whole texts by a word-level byte-pair tokenizer of the tokenizers library.

The tokenizer drops white space and never merges across it, so the ids of a text are those of
its white-space separated chunks one after the other. A batch's distinct chunks are encoded
once, by the library, and the ids are laid out with NumPy.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts that are encoded whole: spaces that the library does not know, letters to be composed
#: before they are lower-cased, and strings that lower-casing would make special.
WHOLE = "[\x1c-\x1f\u0300-\u036f]|(?i)<\\|(start|end)oftext\\|>"
#: Distinct stems kept by a worker in each of two generations.
CACHE = 450_000
TAIL = ".,;:!?*$%#&"


class WordTokenizer:
    """Encodes string arrays to (ids, offsets): the ids of row i are ids[offsets[i]:offsets[i + 1]]."""

    def __init__(self, path: str, cache: int = CACHE):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        vocab = self.library.get_vocab()
        self.dtype = np.dtype("<u2" if max(vocab.values()) < 1 << 16 else "<u4")
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for token, i in vocab.items() if token.endswith("</w>")]] = True
        self.new, self.old, self.others, self.limit = {}, {}, {}, cache

    def encoded(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def _plain(self, stems: list[str]) -> list[bytes | None]:
        """The ids of stems that are letters only, by the library or kept; None for others."""
        if len(self.new) > self.limit:
            self.new, self.old = {}, self.new
        new, old = self.new, self.old
        missing = [s for s in stems if s not in new]
        new.update([(s, old[s]) for s in missing if s in old])
        plain = [s for s in missing if s not in new and s.isalpha() and (s.isascii() or s.lower().isalpha())]
        if plain:
            ids = np.array(self.library.encode_batch_fast([" ".join(plain)], add_special_tokens=False)[0].ids, self.dtype)
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) == len(plain):
                raw, start = ids.tobytes(), 0
                for word, end in zip(plain, (cuts * self.dtype.itemsize).tolist(), strict=True):
                    new[word], start = raw[start:end], end
            else:
                new.update([(word, self.encoded(word)) for word in plain])
        return [new.get(s) for s in stems]

    def _other(self, word: str) -> bytes:
        if len(self.others) > self.limit:
            self.others.clear()
        if word not in self.others:
            self.others[word] = self.encoded(word)
        return self.others[word]

    def _pieces(self, words: pa.Array) -> tuple[list[bytes], np.ndarray]:
        """Id strings, and two of them for each word: its stem's and its tail's (or the empty one)."""
        stems = pc.utf8_rtrim(words, characters=TAIL)
        coded = stems.dictionary_encode()
        pieces = self._plain(coded.dictionary.to_pylist())
        place = np.stack([coded.indices.to_numpy(zero_copy_only=False), np.full(len(words), len(pieces))], axis=1)
        unknown = np.array([p is None for p in pieces], bool)
        pieces = [p or b"" for p in pieces] + [b""]
        tail = pc.subtract(pc.binary_length(words), pc.binary_length(stems)).to_numpy(zero_copy_only=False)
        other = unknown[place[:, 0]] if len(place) else tail > 0
        marks, one = {}, np.flatnonzero((tail == 1) & ~other)
        if len(one):
            last = np.frombuffer(words.buffers()[2], np.uint8)[np.frombuffer(words.buffers()[1], np.int32)[one + 1 + words.offset] - 1]
            for byte in np.unique(last).tolist():
                marks[chr(byte)] = len(pieces)
                pieces.append(self._other(chr(byte)))
                place[one[last == byte], 1] = marks[chr(byte)]
        for chosen, column in ((np.flatnonzero(other), 0), (np.flatnonzero((tail > 1) & ~other), 1)):
            rows = pa.array(chosen)
            for i, word, stem in zip(chosen.tolist(), words.take(rows).to_pylist(), stems.take(rows).to_pylist(), strict=True):
                part = word if column == 0 else word[len(stem) :]
                if part not in marks:
                    marks[part] = len(pieces)
                    pieces.append(self._other(part))
                place[i, column] = marks[part]
        return pieces, place

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        texts = pc.fill_null(texts, "")
        odd = np.flatnonzero(pc.match_substring_regex(texts, WHOLE).to_numpy(zero_copy_only=False))
        whole = {int(i): self.encoded(texts[int(i)].as_py()) for i in odd}
        if whole:
            mask = np.zeros(len(texts), bool)
            mask[odd] = True
            texts = pc.if_else(pa.array(mask), "", texts)
        chunks = pc.utf8_split_whitespace(pc.ascii_lower(texts))
        coded = chunks.values.dictionary_encode()
        index = coded.indices.to_numpy(zero_copy_only=False)
        bounds = chunks.offsets.to_numpy()
        pieces, place = self._pieces(coded.dictionary)
        size = self.dtype.itemsize
        counts = np.fromiter(map(len, pieces), np.int64, len(pieces)) // size
        pool = np.frombuffer(b"".join(pieces), self.dtype)
        firsts = np.concatenate([[0], np.cumsum(counts)])
        index = place[index].ravel()
        each = counts[index]
        ends = np.concatenate([[0], np.cumsum(each)])
        ids = pool[np.repeat(firsts[index] - ends[:-1], each) + np.arange(ends[-1])]
        offsets = ends[2 * (bounds - bounds[0])]
        if whole:
            rows = [ids[a:b] for a, b in zip(offsets, offsets[1:], strict=False)]
            for i, raw in whole.items():
                rows[i] = np.frombuffer(raw, self.dtype)
            ids, offsets = np.concatenate(rows), np.concatenate([[0], np.cumsum([len(r) for r in rows])])
        return ids, offsets


def with_end(ids: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Appends end_id to every row."""
    n = len(offsets) - 1
    return np.insert(ids, offsets[1:], end_id), offsets + np.arange(n + 1)


_LOADED: dict[str, WordTokenizer] = {}


def loaded(path: str) -> WordTokenizer:
    """One tokenizer for each worker process."""
    if path not in _LOADED:
        _LOADED[path] = WordTokenizer(path)
    return _LOADED[path]
