"""Sampled subword segmentation by forward filtering and backward sampling, and lossless decoding.

A segmentation's probability is proportional to the product of its pieces' weights, to the power
`theta`. Forward filtering sums the weights of all ways to reach each place of the piece lattice;
backward sampling walks from the end, taking each piece with its share of that sum. A piece of the
vocabulary has spaces at its front only (a model with others is refused), so a text's lattice falls
apart before every run of spaces: each distinct stretch (spaces and the word behind them) is filtered once per worker, and
all stretches of a batch are sampled together, one step at a time.

The random numbers are a hash of seed, row key, stretch and step: a row's segmentation does not
depend on partitions, batches or other rows.

A vocabulary of merges has ranks for scores; a piece then weighs 1 / (1 + rank), as in Zipf's law.
A character that no piece covers, and a literal space mark, become their UTF-8 bytes' pieces, so
decoding gives the text back byte by byte.

Cases: a null or empty text has no piece and decodes to the empty text; texts of any length are
encoded whole; rows with the same key and text have the same pieces; a null doc_id counts as key
0 and is kept; an empty table gives no row; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from geomlake.llm import common

MARK, CACHE_EDGES = "▁", 8_000_000
_UNITS = re.compile(" +[^ ]*|[^ ]+")
_K = [np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


def uniform(seed: int, key: np.ndarray, unit: np.ndarray, step: int) -> np.ndarray:
    """Numbers in [0, 1) that depend on the arguments alone."""
    x = key.astype(np.uint64) * _K[0] + unit.astype(np.uint64) * _K[1] + np.uint64((step * int(_K[2]) + seed) & (2**64 - 1))
    for k in (_K[3], _K[4]):
        x = (x ^ (x >> np.uint64(31))) * k
    return ((x ^ (x >> np.uint64(33))) >> np.uint64(11)).astype(np.float64) / (1 << 53)


class PieceLattice:
    """Lattices of stretches, kept as one pool of nodes and their incoming edges."""

    def __init__(self, path: str, theta: float = 1.0, limit: int = CACHE_EDGES):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.vocab_size()
        plain = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        scores = {i: model.get_score(i) for i in plain}
        ranked = min(scores.values()) <= -1000  # ranks, not log probabilities
        self.pieces = {model.id_to_piece(i).replace(MARK, " "): (i, theta * (-math.log1p(-s) if ranked else s)) for i, s in scores.items()}
        if odd := [t for t in self.pieces if " " in t.lstrip(" ")]:
            raise ValueError(f"pieces with a space behind other characters, as {odd[0]!r}: stretches would not fall apart")
        self.octets = [0] * 256
        self.bytes = [b""] * n
        for i in range(n):
            if model.is_byte(i):
                self.octets[int(model.id_to_piece(i)[3:5], 16)] = i
                self.bytes[i] = bytes([int(model.id_to_piece(i)[3:5], 16)])
        for text, (i, _) in self.pieces.items():
            self.bytes[i] = text.encode()
        self.limit = limit
        self._build_trie()
        self.reset()

    def reset(self) -> None:
        self.nodes, self.runs, self.n, self.n_edges = {}, {}, 0, 0
        self.cum, self.to, self.piece = np.zeros(1 << 16), np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int32)
        self.first = np.zeros(1 << 14, np.int32)

    def _build_trie(self) -> None:
        """The pieces as transitions (state, character) to states, sorted for look-up, and each state's piece."""
        states, self.state_piece, self.state_weight = {"": 0}, [-1], [0.0]
        for text in sorted(self.pieces):
            for k in range(1, len(text) + 1):
                if text[:k] not in states:
                    states[text[:k]] = len(states)
                    self.state_piece.append(-1)
                    self.state_weight.append(0.0)
            self.state_piece[states[text]], self.state_weight[states[text]] = self.pieces[text]
        moves = sorted(((states[t[:-1]] << 21) | ord(t[-1]), s) for t, s in states.items() if t)
        self.moves, self.moved = (np.array(x, np.int64) for x in zip(*moves, strict=True))
        self.state_piece, self.state_weight = np.array(self.state_piece, np.int32), np.array(self.state_weight)

    def _edges(self, units: list[str]) -> tuple[np.ndarray, ...]:
        """All edges of the stretches' lattices: from node (-1: start), to node, piece, log weight; nodes by stretch; node depths."""
        chars = np.frombuffer("".join(units).encode("utf-32-le"), "<u4").astype(np.int64)
        size = np.fromiter(map(len, units), np.int64, len(units))
        stop = np.repeat(np.cumsum(size), size)
        frm, to, piece, weight = [], [], [], []
        at, state, k = np.arange(len(chars)), np.zeros(len(chars), np.int64), 0
        while len(at):
            key = (state << 21) | chars[at + k]
            found = np.minimum(np.searchsorted(self.moves, key), len(self.moves) - 1)
            hit = self.moves[found] == key
            at, state, k = at[hit], self.moved[found[hit]], k + 1
            ends = self.state_piece[state] >= 0
            frm.append(at[ends] - 1)
            to.append(at[ends] + k - 1)
            piece.append(self.state_piece[state[ends]])
            weight.append(self.state_weight[state[ends]])
            on = at + k < stop[at]
            at, state = at[on], state[on]
        single = np.zeros(len(chars), bool)
        single[to[0]] = True
        octets = np.where(single, 1, 1 + (chars >= 0x80) + (chars >= 0x800) + (chars >= 0x10000))
        node = np.cumsum(octets) - 1
        starts = np.cumsum(size) - size
        opening = np.zeros(len(chars), bool)
        opening[starts] = True
        before = np.where(opening, -1, np.concatenate([[-1], node[:-1]]))
        frm, to = np.concatenate(frm), np.concatenate(to)
        frm, to = before[frm + 1], node[to]
        extra = [(int(before[i]) if j == 0 else int(node[i] - octets[i] + j), int(node[i] - octets[i] + 1 + j), self.octets[o], 0.0 if j else -20.0) for i in np.flatnonzero(~single).tolist() for j, o in enumerate(chr(chars[i]).encode())]
        more = list(zip(*extra, strict=True)) or [(), (), (), ()]
        frm, to, piece, weight = (np.concatenate([x, np.array(y, x.dtype)]) for x, y in zip((frm, to, np.concatenate(piece), np.concatenate(weight)), more, strict=True))
        nodes = np.add.reduceat(octets, starts)
        depth = np.arange(int(nodes.sum())) - np.repeat(np.cumsum(nodes) - nodes, nodes)
        return frm, to, piece, weight, nodes, depth

    def add(self, units: list[str]) -> list[int]:
        """Filters stretches forward, stores them in the pool, gives the nodes of their ends."""
        if not units:
            return []
        frm, to, piece, weight, nodes, depth = self._edges(units)
        order = np.lexsort((-weight, to))
        frm, to, piece, weight = frm[order], to[order], piece[order], weight[order]
        count = np.bincount(to, minlength=len(depth))
        first = np.cumsum(count) - count
        alpha, by_depth = np.zeros(len(depth) + 1), np.argsort(depth, kind="stable")  # the last place stands for the start
        share = np.zeros(len(to))
        for level in np.split(by_depth, np.flatnonzero(np.diff(depth[by_depth])) + 1):
            c = count[level]
            edge = np.repeat(first[level] - (np.cumsum(c) - c), c) + np.arange(c.sum())
            logs, heads = alpha[frm[edge]] + weight[edge], np.cumsum(c) - c
            top = np.maximum.reduceat(logs, heads)
            e = np.exp(logs - np.repeat(top, c))
            total = np.add.reduceat(e, heads)
            alpha[level] = top + np.log(total)
            share[edge] = e / np.repeat(total, c)
        rank, run = np.arange(len(to)) - first[to], share.copy()
        for k in range(1, int(count.max())):
            here = np.flatnonzero(rank == k)
            run[here] += run[here - 1]
        run[first + count - 1] = 1.0
        while self.n_edges + len(to) > len(self.cum):
            self.cum, self.to, self.piece = (np.concatenate([x, np.zeros_like(x)]) for x in (self.cum, self.to, self.piece))
        while self.n + len(depth) > len(self.first):
            self.first = np.concatenate([self.first, np.zeros_like(self.first)])
        where = slice(self.n_edges, self.n_edges + len(to))
        self.cum[where], self.to[where], self.piece[where] = run, np.where(frm < 0, -1, frm + self.n), piece
        self.first[self.n : self.n + len(depth)] = first + self.n_edges
        ends = self.n + np.cumsum(nodes) - 1
        self.n, self.n_edges = self.n + len(depth), where.stop
        return ends.tolist()

    def stretches(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """End node of every stretch, and each text's first stretch."""
        if self.n_edges > self.limit:
            self.reset()
        odd = pc.match_substring_regex(texts, "  |^ | $|^$").to_numpy(zero_copy_only=False)
        words = pc.split_pattern(pc.if_else(pa.array(odd), "", texts), " ")
        coded = words.values.dictionary_encode()
        known, distinct = self.nodes, coded.dictionary.to_pylist()
        new = [w for w in distinct if w not in known]
        known.update(zip(new, self.add([" " + w for w in new]), strict=True))
        nodes = [known[w] for w in distinct]
        flat = np.array(nodes, np.int64)[coded.indices.to_numpy(zero_copy_only=False)] if len(nodes) else np.zeros(0, np.int64)
        bounds = words.offsets.to_numpy().astype(np.int64)
        if not odd.any():
            return flat, bounds
        rows = {i: _UNITS.findall(" " + texts[i].as_py()) if texts[i].as_py() else [] for i in np.flatnonzero(odd).tolist()}
        new = list({u for units in rows.values() for u in units if u not in self.runs})
        self.runs.update(zip(new, self.add(new), strict=True))
        parts = [np.array([self.runs[u] for u in rows[i]], np.int64) if i in rows else flat[bounds[i] : bounds[i + 1]] for i in range(len(texts))]
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])

    def sample(self, texts: pa.Array, keys: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and the offsets of each text's."""
        node, bounds = self.stretches(texts)
        n = len(node)
        row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        unit, key = np.arange(n) - bounds[row], keys[row]
        steps, live, step, length = [], np.arange(n), 0, np.zeros(n, np.int64)
        while len(live):
            edge, u = self.first[node[live]], uniform(seed, key[live], unit[live], step)
            on = np.flatnonzero(u >= self.cum[edge])
            while len(on):
                edge[on] += 1
                on = on[u[on] >= self.cum[edge[on]]]
            steps.append((live, self.piece[edge]))
            length[live] += 1
            before = self.to[edge]
            node[live] = before
            live, step = live[before >= 0], step + 1
        ends = np.cumsum(length)
        ids = np.zeros(int(ends[-1]) if n else 0, np.int32)
        for k, (which, piece) in enumerate(steps):
            ids[ends[which] - 1 - k] = piece
        sums = np.concatenate([[0], ends])
        return ids, sums[bounds]

    def decode(self, ids: np.ndarray) -> str:
        """The text of a sequence of ids."""
        return b"".join(map(self.bytes.__getitem__, ids.tolist())).decode()[1:]


_LOADED: dict[tuple[str, float], PieceLattice] = {}


def loaded(path: str, theta: float) -> PieceLattice:
    if (path, theta) not in _LOADED:
        _LOADED[path, theta] = PieceLattice(path, theta)
    return _LOADED[path, theta]


def encoded(docs: DataFrame, vocabulary: str, seed: int = 17, theta: float = 1.0) -> DataFrame:
    """doc_id, ids: a sampled segmentation of each text."""

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = loaded(vocabulary, theta)
        for batch in common.slices(batches):
            ids, offsets = lattice.sample(batch.column(1), batch.column(0).fill_null(0).to_numpy(), seed)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))], ["doc_id", "ids"])

    return common.texts(docs).mapInArrow(sample, "doc_id long, ids array<int>")


def decoded(rows: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, text of rows of ids."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = loaded(vocabulary, 1.0)
        for batch in batches:
            texts = [None if ids.values is None else lattice.decode(ids.values.to_numpy()) for ids in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return rows.select("doc_id", "ids").mapInArrow(join, "doc_id long, text string")


def sampled(docs: DataFrame, vocabulary: str, seed: int = 17, theta: float = 1.0) -> DataFrame:
    """Per document: doc_id, n_bytes, n_pieces, ids_crc32 (of the ids as u32), lossless (decoding gives the text)."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = loaded(vocabulary, theta)
        for batch in common.slices(batches):
            ids, offsets = lattice.sample(batch.column(1), batch.column(0).fill_null(0).to_numpy(), seed)
            raw, at = memoryview(ids.astype("<u4")).cast("B"), offsets.tolist()
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at, at[1:], strict=False)]
            same = [lattice.decode(ids[a:b]) == text for a, b, text in zip(at, at[1:], batch.column(1).to_pylist(), strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pc.binary_length(batch.column(1)).cast(pa.int64()), pa.array(np.diff(offsets)), pa.array(crc, pa.int64()), pa.array(same)], ["doc_id", "n_bytes", "n_pieces", "ids_crc32", "lossless"])

    return common.texts(docs).mapInArrow(digest, "doc_id long, n_bytes long, n_pieces long, ids_crc32 long, lossless boolean")
