"""Exact BM25 top-k search: an inverted index in shards, block-max pruning in groups of them, exact merge.

Index. A shard holds about SHARD words. Its documents are ordered so that neighbours are alike (by
the signs of a few principal components of their most frequent words, then by length) and cut into
blocks of WIDTH; equal texts are one document with all their ids. Document counts and lengths add
up over all shards to global statistics, so a score does not depend on the shard.

Search. A task joins GROUP shards and searches them as one, for BATCH queries at a time. Parts of
terms below COMMON of the documents are summed in place; those above it are bounded by their largest
part in each block. Only windows with a block whose sum and bounds reach the query's threshold are
scored, by a matrix product over the common terms for all queries that need the window. The
threshold is a floor from other shards, or the k-th best in the blocks of the largest bounds. Up to
here scores are single-precision, and parts kept in 16 bits, with a proven leeway; what can still be
among the k best is scored again in double precision, term by term in one fixed order, so ties are
exact.

Plan. Queries are a stored table, a row each. A tile is a group of shards and a chunk of QUERIES
queries; each task reads its shards and then its queries from the shared folder, so neither the
driver nor a broadcast holds queries, and a task's work has a bound. A root of the shards is visited
first; its k-th best is the floor that the others start from, a column of the queries. The groups'
best are merged by score, then doc_id.

A document as a query asks with all its distinct words, weighted by inverse document frequency;
with `terms` given, only for so many of its most telling words: those with the largest count times
that frequency, then the smallest word. search() takes any terms with positive weights.

Cases: a null text has no word: it is never found and, as a query, finds nothing; a text of any
length is indexed and asked whole; rows that share a doc_id are found each, and ask together; a
null doc_id is neither found nor asked; scores are compared to nine decimals, ties go to the
smaller doc_id; an empty table gives no row; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from geomlake.llm import common

K1, B, SHARD, QUERIES = 1.2, 0.75, 4_000_000, 16_384
#: Documents of a shard at most, of a block; queries searched together; documents scored together; postings added together.
DOCS, WIDTH, BATCH, WINDOW, RUN = 65_536, 16, 256, 512, 16_384
#: Postings of a term up to which it is gathered, not sliced; places that fit 16 bits; a term's part of a score, at most K1 + 1, is kept in steps.
FEW, MANY, STEP = 256, 65_536, (K1 + 1) / 65_535
#: Shards searched as one, where there are enough of them for all cores.
GROUP = 3
#: Share of a shard's documents: terms in more are bounded by blocks and scored by matrix products.
COMMON = 0.08
#: Words a document asks with: all.
TERMS = None
_TABLE = np.array([b if b >= 128 or chr(b).isdigit() or chr(b).islower() else b + 32 if chr(b).isupper() else 32 for b in range(256)], np.uint8)


def words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct lower-cased words of a batch, the word number at each place, and where texts start."""
    texts = pa.array(texts) if texts.offset == 0 else pa.concat_arrays([texts])
    _, offsets, data = texts.buffers()
    flat = _TABLE[np.frombuffer(data, np.uint8)] if data is not None and data.size else np.zeros(0, np.uint8)
    texts = pa.Array.from_buffers(pa.string(), len(texts), [None, offsets, pa.py_buffer(flat)])
    split = pc.ascii_split_whitespace(texts)
    coded = split.values.dictionary_encode()
    index, bounds = coded.indices.to_numpy(zero_copy_only=False), split.offsets.to_numpy().astype(np.int64)
    empty = coded.dictionary.index("").as_py()
    if empty >= 0:
        real = index != empty
        bounds, index = np.concatenate([[0], np.cumsum(real)])[bounds], index[real]
    return coded.dictionary, index, bounds


def counts(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words of a batch; row, word and count of each pair; lengths of the texts."""
    distinct, index, bounds = words(texts)
    row, n = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds)), max(1, len(distinct))
    pair, tf = np.unique(row * n + index, return_counts=True)
    return distinct, pair // n, pair % n, tf, np.diff(bounds)


_SHARD = "ids binary, id_starts binary, lengths binary, terms binary, starts binary, docs binary, tfs binary, n_docs long, n_words long"


def alike_order(length: np.ndarray, term: np.ndarray, doc: np.ndarray, tf: np.ndarray, top: int = 64, signs: int = 4) -> np.ndarray:
    """An order of documents in which neighbours use alike words and are of alike length."""
    df = np.bincount(term)
    chosen = np.argsort(-df, kind="stable")[:top]
    column = np.full(len(df), -1)
    column[chosen] = np.arange(len(chosen))
    here = column[term] >= 0
    used = np.zeros((len(length), len(chosen)))
    used[doc[here], column[term[here]]] = np.log1p(tf[here])
    used /= np.maximum(np.linalg.norm(used, axis=1, keepdims=True), 1e-9)
    used -= used.mean(axis=0)
    _, axes = np.linalg.eigh(used.T @ used)
    sides = used @ axes[:, ::-1][:, :signs] > 0
    return np.lexsort((length, sides @ (1 << np.arange(sides.shape[1])[::-1])))


def shard_row(ids: np.ndarray, classes: np.ndarray, hashes: np.ndarray, doc: np.ndarray, tf: np.ndarray, length: np.ndarray) -> pa.RecordBatch:
    """A shard: ids of rows and the different text (class) that each has; word hash, class and count of postings; lengths of classes."""
    names, term = np.unique(hashes, return_inverse=True)
    order = alike_order(length, term, doc, tf) if len(term) else np.arange(len(length))
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    doc, length, classes = place[doc], length[order], place[classes]
    by_term, by_class = np.lexsort((doc, term)), np.lexsort((ids, classes))
    copies = np.bincount(classes, minlength=len(length))
    starts = np.concatenate([[0], np.cumsum(np.bincount(term, minlength=len(names)))])
    parts = (ids[by_class].astype("<i8"), np.concatenate([[0], np.cumsum(copies)]).astype("<u4"), length.astype("<u4"), names.astype("<i8"), starts.astype("<u4"), doc[by_term].astype("<u4"), tf[by_term].astype("<u4"))
    return pa.RecordBatch.from_arrays([*(pa.array([p.tobytes()], pa.binary()) for p in parts), pa.array([len(ids)]), pa.array([int((length * copies).sum())])], [c.split(" ")[0] for c in _SHARD.split(", ")])


def emptied(held: list[tuple[np.ndarray, ...]]) -> list[np.ndarray]:
    """The arrays of a list one after the other; the list is empty then, so they are in memory once."""
    out = [np.concatenate(x) for x in zip(*held, strict=True)]
    held.clear()
    return out


def index(docs: DataFrame, shard: int = SHARD) -> DataFrame:
    """The stored index, a row and a file for each shard."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        known: dict[bytes, int] = {}
        ids: list[int] = []
        classes: list[int] = []
        size = 0
        for batch in common.slices(batches):
            new = []
            for i, (doc_id, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                key = xxhash.xxh3_128_digest(text)
                if key not in known:
                    new.append(i)
                classes.append(known.setdefault(key, len(known)))
                ids.append(doc_id)
            distinct, doc, word, tf, length = counts(batch.column(1).take(pa.array(new, pa.int64())))
            hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in distinct.to_pylist()), np.uint64, len(distinct)).view(np.int64)
            held.append((hashes[word], (doc + len(known) - len(new)).astype(np.int32), tf.astype(np.int32), length))
            size += int(length.sum())
            if size >= shard or len(known) >= DOCS or len(ids) >= 16 * DOCS:
                yield shard_row(np.array(ids), np.array(classes), *emptied(held))
                known, ids, classes, size = {}, [], [], 0
        if ids:
            yield shard_row(np.array(ids), np.array(classes), *emptied(held))

    return common.saved(common.texts(docs.where("doc_id IS NOT NULL")).mapInArrow(build, _SHARD), "search-index", maxRecordsPerFile=1)


def document_counts(shards: DataFrame) -> DataFrame:
    """term (hash), df: in how many documents of all shards each term stands."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for terms, starts, docs, id_starts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                copies, first = np.diff(np.frombuffer(id_starts, "<u4").astype(np.int64)), np.frombuffer(starts, "<u4").astype(np.int64)[:-1]
                df = np.add.reduceat(copies[np.frombuffer(docs, "<u4")], first) if len(first) else first
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(terms, "<i8")), pa.array(df)], ["term", "df"])

    rows = shards.select("terms", "starts", "docs", "id_starts").mapInArrow(count, "term long, df long")
    return rows.groupBy("term").agg(F.sum("df").alias("df"))


def idf(n: int, df: Column) -> Column:
    return F.log1p((F.lit(float(n)) - df + 0.5) / (df + 0.5))


def telling_terms(asked: DataFrame, shards: DataFrame, terms: int | None = TERMS) -> DataFrame:
    """query_id, term, weight: all distinct words of documents (doc_id, text), or the most telling `terms`."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            distinct, row, word, tf, _ = counts(batch.column(1))
            hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in distinct.to_pylist()), np.uint64, len(distinct)).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), distinct.take(pa.array(word)), pa.array(hashes[word]), pa.array(tf)], ["query_id", "word", "term", "tf"])

    n = shards.agg(F.coalesce(F.sum("n_docs"), F.lit(0))).first()[0]
    rows = common.texts(asked.where("doc_id IS NOT NULL")).mapInArrow(split, "query_id long, word string, term long, tf long")
    rows = rows.join(document_counts(shards), "term").withColumn("idf", idf(n, F.col("df")))
    if terms is None:
        return rows.select("query_id", "term", F.col("idf").alias("weight")).distinct()
    best = F.struct((-F.round(F.col("tf") * F.col("idf"), 9)).alias("s"), "word", "term", "idf")
    chosen = rows.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_set(best)), 1, terms).alias("best"))
    return chosen.select("query_id", F.explode("best").alias("x")).select("query_id", F.col("x.term").alias("term"), F.col("x.idf").alias("weight"))


def joined(rows: list[dict]) -> dict:
    """Several shards as one: their documents stand one after the other, their postings by term."""
    if len(rows) == 1:
        return rows[0]
    parts = [{c: np.frombuffer(r[c], kind).astype(to, copy=False) for c, kind, to in (("ids", "<i8", "<i8"), ("id_starts", "<u4", np.int64), ("lengths", "<u4", "<u4"), ("terms", "<i8", "<i8"), ("starts", "<u4", np.int64), ("docs", "<u4", "<u4"), ("tfs", "<u4", "<u4"))} for r in rows]
    names = np.unique(np.concatenate([x["terms"] for x in parts]))
    places, sizes = [np.searchsorted(names, x["terms"]) for x in parts], [np.diff(x["starts"]) for x in parts]
    starts = np.zeros(len(names) + 1, np.int64)
    for place, size in zip(places, sizes, strict=True):
        starts[place + 1] += size
    np.cumsum(starts, out=starts)
    free, docs, tfs, n, m = starts[:-1].copy(), np.empty(starts[-1], "<u4"), np.empty(starts[-1], "<u4"), 0, 0
    for x, place, size in zip(parts, places, sizes, strict=True):
        at = np.repeat(free[place] - x["starts"][:-1], size)
        at += np.arange(len(at))
        docs[at], tfs[at] = x["docs"] + np.uint32(n), x["tfs"]
        free[place] += size
        x["id_starts"] = x["id_starts"][n > 0 :] + m
        n, m = n + len(x["lengths"]), m + len(x["ids"])
    return {"ids": np.concatenate([x["ids"] for x in parts]), "id_starts": np.concatenate([x["id_starts"] for x in parts]).astype("<u4"), "lengths": np.concatenate([x["lengths"] for x in parts]), "terms": names, "starts": starts.astype("<u4"), "docs": docs, "tfs": tfs}


def placed(docs: np.ndarray) -> np.ndarray:
    """Places of documents: in each WINDOW, first the first of each block, then the second."""
    return docs // WINDOW * WINDOW + docs % WIDTH * (WINDOW // WIDTH) + docs % WINDOW // WIDTH


def unplaced(places: np.ndarray) -> np.ndarray:
    """The documents at some places."""
    return places // WINDOW * WINDOW + places % (WINDOW // WIDTH) * WIDTH + places % WINDOW // (WINDOW // WIDTH)


class Shard:
    """One shard's postings by term and by document, and the blocks of its common terms."""

    def __init__(self, row: dict, mean: float):
        self.ids, self.id_starts = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["id_starts"], "<u4").astype(np.int64)
        self.length, self.terms = np.frombuffer(row["lengths"], "<u4").astype(np.float64), np.frombuffer(row["terms"], "<i8")
        self.start, self.mean = np.frombuffer(row["starts"], "<u4").astype(np.int64), mean
        self.n, doc, tf = len(self.length), np.frombuffer(row["docs"], "<i4"), np.frombuffer(row["tfs"], "<u4")
        df = np.diff(self.start)
        # All postings by document: its terms in the order of their hashes, so equal texts add up to equal scores.
        by_doc = np.argsort(doc.astype(np.uint16) if self.n <= MANY else doc, kind="stable")
        self.own = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=self.n))])
        self.own_tf = tf.astype(np.min_scalar_type(tf.max(initial=0)))[by_doc]
        self.own_term = np.repeat(np.arange(len(df), dtype=np.int32), df)[by_doc]
        del by_doc
        weight = tf.astype(np.float32)
        weight *= np.float32(K1 + 1) / (weight + (K1 * (1 - B + B * self.length / mean)).astype(np.float32)[doc])
        place = placed(np.arange(self.n, dtype=np.uint32))[doc]
        # Postings by term: a document's place and, in the lower 16 bits, its part in steps.
        self.posts = np.rint(weight / np.float32(STEP)).astype(np.uint32 if self.n <= MANY else np.uint64)
        self.posts |= place.astype(self.posts.dtype) << 16
        common_terms = np.flatnonzero(df > max(COMMON * self.n, WIDTH))
        self.column = np.full(len(df), -1, np.int32)
        self.column[common_terms] = np.arange(len(common_terms))
        # Common terms: the parts of every document, a row for each place, and the largest of each block.
        self.part = np.zeros((-(-self.n // WINDOW) * WINDOW, len(common_terms)), np.float32)
        for column, (a, b) in enumerate(zip(self.start[common_terms].tolist(), self.start[common_terms + 1].tolist(), strict=True)):
            self.part[place[a:b], column] = weight[a:b]
        self.most = self.part.reshape(-1, WIDTH, WINDOW // WIDTH, len(common_terms)).max(axis=1).reshape(-1, len(common_terms)) if len(common_terms) else np.zeros((len(self.part) // WIDTH, 0), np.float32)
        del place, weight
        self.asked, self.marked = np.zeros(len(df)), np.zeros(len(df), bool)
        self.read = self.scored = 0

    def add(self, sums: np.ndarray, query: np.ndarray, terms: np.ndarray, weights: np.ndarray) -> None:
        """Adds to sums, by query and place, the parts of some terms, in the order of queries; RUN postings at a time, which stay in the cache."""
        begin, size, weights = self.start[terms], self.start[terms + 1] - self.start[terms], (weights * STEP).astype(np.float32)
        self.read += int(size.sum())
        for few in (True, False):
            chosen = np.flatnonzero((size <= FEW) == few)
            ends = np.cumsum(size[chosen])
            cuts = np.unique(np.concatenate([[0, len(chosen)], np.flatnonzero(np.diff(query[chosen])) + 1, np.searchsorted(ends, np.arange(RUN, ends[-1], RUN)) if len(ends) else []]).astype(int)).tolist()
            for i, j in zip(cuts, cuts[1:], strict=False):
                here = chosen[i:j]
                first, n = begin[here], size[here]
                if few:
                    at = np.repeat(first - (np.cumsum(n) - n), n)
                    at += np.arange(len(at))
                    posts = self.posts[at]
                else:
                    posts = np.concatenate([self.posts[a:b] for a, b in zip(first.tolist(), (first + n).tolist(), strict=True)])
                np.add.at(sums[query[here[0]]], (posts >> 16).astype(np.intp), (posts & 0xFFFF).astype(np.float32) * np.repeat(weights[here], n))

    def holding(self, terms: np.ndarray) -> np.ndarray:
        """The places of documents that have any of the terms."""
        return np.unique(np.concatenate([self.posts[a:b] for a, b in zip(self.start[terms].tolist(), self.start[terms + 1].tolist(), strict=True)]) >> 16).astype(np.intp)

    def exact(self, docs: np.ndarray, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Scores in double precision, to nine decimals."""
        spans = list(zip(self.own[docs].tolist(), self.own[docs + 1].tolist(), strict=True))
        self.asked[terms], self.marked[terms] = weights, True
        every = np.concatenate([self.own_term[a:b] for a, b in spans])
        here = np.flatnonzero(self.marked[every])
        asked = self.asked[every[here]]
        self.marked[terms] = False
        tf = np.concatenate([self.own_tf[a:b] for a, b in spans])[here].astype(np.float64)
        which = np.searchsorted(np.cumsum([b - a for a, b in spans]), here, side="right")
        out = np.bincount(which, tf * (K1 + 1) / (tf + K1 * (1 - B + B * self.length[docs[which]] / self.mean)) * asked, len(docs))
        self.scored += len(docs)
        return np.round(out, 9)

    def best(self, docs: np.ndarray, terms: np.ndarray, weights: np.ndarray, k: int, floor: float) -> tuple[np.ndarray, np.ndarray]:
        """doc_ids and scores of the k best of some documents, with at least `floor`."""
        scores = self.exact(docs, terms, weights)
        keep = (scores > 0) & (scores >= floor)
        docs, scores = docs[keep], scores[keep]
        if len(scores) > k:
            keep = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
            docs, scores = docs[keep], scores[keep]
        first, n = self.id_starts[docs], np.minimum(self.id_starts[docs + 1] - self.id_starts[docs], k)
        ids, scores = self.ids[np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())], np.repeat(scores, n)
        order = np.lexsort((ids, -scores))[:k]
        return ids[order], scores[order]

    def search(self, queries: list[tuple[np.ndarray, np.ndarray, float]], k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each of some queries (term hashes, weights, floor): its number, doc_ids and scores of the k best."""
        asked, sums, held = np.zeros((len(queries), self.part.shape[1]), np.float32), np.zeros((len(queries), len(self.part)), np.float32), []
        rare = []
        known, which = np.unique(np.concatenate([hashes for hashes, _, _ in queries]), return_inverse=True)
        place = np.minimum(np.searchsorted(self.terms, known), max(0, len(self.terms) - 1))
        place = np.where(self.terms[place] == known, place, -1)[which] if len(self.terms) else np.full(len(which), -1)
        bounds = np.cumsum([0, *(len(hashes) for hashes, _, _ in queries)]).tolist()
        for i, (_, weights, floor) in enumerate(queries):
            terms = place[bounds[i] : bounds[i + 1]]
            terms, weights = terms[terms >= 0], weights[terms >= 0]
            column = self.column[terms]
            asked[i, column[column >= 0]] = weights[column >= 0]
            rare.append((np.full(len(terms), i)[column < 0], terms[column < 0], weights[column < 0]))
            held.append((terms, weights, floor))
        self.add(sums, *map(np.concatenate, zip(*rare, strict=True)))
        # A single-precision sum of m parts, none negative, errs by a share of m half-units in the last place, at most.
        leeway = 1.2e-7 * (16 + np.array([len(terms) for terms, _, _ in held]))
        # Parts of terms that are not common are off by half a step each.
        slack = np.array([float(weights.sum()) for _, _, weights in rare]) * (STEP * 0.501) + 1e-8
        limit = asked @ self.most.T
        limit += sums.reshape(len(held), -1, WIDTH, WINDOW // WIDTH).max(axis=2).reshape(limit.shape)
        threshold = np.array([floor for _, _, floor in held]) * (1 - leeway) - slack
        for i in np.flatnonzero(threshold == -np.inf).tolist():
            # The blocks of the largest limits give a first threshold.
            blocks = np.argpartition(limit[i], -k)[-k:] if limit.shape[1] > k else np.arange(limit.shape[1])
            at = placed((blocks[:, None] * WIDTH + np.arange(WIDTH)).ravel())
            if len(at) >= k:
                threshold[i] = np.partition(sums[i, at] + self.part[at] @ asked[i], len(at) - k)[len(at) - k] * (1 - 2 * leeway[i]) - 2 * slack[i]
        # Documents that no threshold above zero excludes are those with any term.
        found = [(np.full(len(at), i), at, np.full(len(at), np.inf, np.float32)) for i in np.flatnonzero(threshold <= 0).tolist() if len(held[i][0]) for at in [self.holding(held[i][0])]]
        threshold[threshold <= 0] = np.inf
        low = (threshold * (1 - 3 * leeway)).astype(np.float32)[:, None]
        pivots = (limit >= low).reshape(len(held), -1, WINDOW // WIDTH).any(axis=2)
        for window in np.flatnonzero(pivots.any(axis=0)).tolist():
            which, here = np.flatnonzero(pivots[:, window]), slice(window * WINDOW, (window + 1) * WINDOW)
            scores = asked[which] @ self.part[here].T
            scores += sums[which, here]
            at = np.flatnonzero(scores >= low[which])
            if len(at):
                found.append((which[at // WINDOW], at % WINDOW + here.start, scores.ravel()[at]))
        if not found:
            return
        query, at, scores = map(np.concatenate, zip(*found, strict=True))
        order = np.argsort(query, kind="stable")
        query, docs, scores = query[order], unplaced(at[order]), scores[order]
        cuts = [0, *(np.flatnonzero(np.diff(query)) + 1).tolist(), len(query)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            i, own = int(query[a]), scores[a:b]
            near = own >= np.partition(own, b - a - k)[b - a - k] * (1 - 2 * leeway[i]) - 2 * slack[i] if b - a > k else slice(None)
            terms, weights, floor = held[i]
            yield i, *self.best(docs[a:b][near], terms, weights, k, floor)


_FOUND = pa.schema([("query_id", pa.int64()), ("doc_id", pa.int64()), ("score", pa.float64())])


def grouped(shards: list[tuple[str, int]], size: int) -> list[list[str]]:
    """Files of shards (file, documents) in groups of `size` and of DOCS documents at most."""
    groups, held = [], DOCS
    for path, n in shards:
        if not groups or len(groups[-1]) >= size or held + n > DOCS:
            groups.append([])
            held = 0
        groups[-1].append(path)
        held += n
    return groups


def visited(spark: SparkSession, groups: list[list[str]], folder: str, chunks: int, mean: float, k: int) -> DataFrame:
    """query_id, doc_id, score: each group's k best of every query; folder: the stored queries, by chunk."""

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tile in batch.column(0).to_pylist():
                rows = []
                for path in groups[tile // chunks]:
                    store, path = common.store(path)
                    with store.open_input_file(path) as source:
                        rows += pq.read_table(source).to_pylist()
                rows = joined(rows)
                shard = Shard(rows, mean)
                rows = None
                size = max(1, min(BATCH, 8_000_000 // max(1, shard.n)))
                for path in common.files(f"{folder}/chunk={tile % chunks}"):
                    store, path = common.store(path)
                    with store.open_input_file(path) as source:
                        for part in pq.ParquetFile(source).iter_batches(batch_size=size):
                            names = part.column(part.schema.get_field_index("query_id")).to_pylist()
                            columns = [part.column(part.schema.get_field_index(c)) for c in ("terms", "weights", "floor")]
                            queries = [(t.values.to_numpy(), w.values.to_numpy(), -np.inf if f.as_py() is None else f.as_py()) for t, w, f in zip(*columns, strict=True)]
                            found = [(np.full(len(ids), names[i]), ids, scores) for i, ids, scores in shard.search(queries, k)]
                            if found:
                                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found, strict=True)], schema=_FOUND)

    n = len(groups) * chunks
    return spark.range(0, n, 1, max(1, min(n, 10_000))).mapInArrow(visit, "query_id long, doc_id long, score double")


def ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best rows of each query, with their rank; partitions keep only k of a query before they are dealt out."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "doc_id", "score")


def search(shards: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, rank (from 1), doc_id, score of each query's k best; queries: query_id, term, weight.

    shards: as index() gives them, a file each.
    """
    spark = shards.sparkSession
    stats = shards.agg(F.coalesce(F.sum("n_docs"), F.lit(0)).alias("n"), F.coalesce(F.sum("n_words"), F.lit(0)).alias("w")).first()
    mean = stats["w"] / max(1, stats["n"]) or 1.0
    entry = F.struct("term", F.col("weight").cast("double").alias("weight"))
    summed = queries.repartition("query_id").groupBy("query_id", "term").agg(F.sum("weight").alias("weight"))
    whole = common.saved(summed.groupBy("query_id").agg(F.array_sort(F.collect_list(entry)).alias("x")).select("query_id", F.col("x.term").alias("terms"), F.col("x.weight").alias("weights"), F.lit(None).cast("double").alias("floor")), "search-asked")
    chunks = max(1, -(-whole.count() // QUERIES))
    chunk = F.pmod(F.xxhash64("query_id"), F.lit(chunks)).cast("int")

    def dealt(asked: DataFrame) -> str:
        folder = common.new_folder(spark, "search-chunks")
        asked.withColumn("chunk", chunk).repartition(chunks, "chunk").write.partitionBy("chunk").parquet(folder)
        return folder

    # A root of the shards goes first: the others then give only what passes a query's k-th best there.
    files = sorted((r["path"], r["n_docs"]) for r in shards.select(F.input_file_name().alias("path"), "n_docs").collect())
    ahead, cores = max(1, round(len(files) ** 0.5)), spark.sparkContext.defaultParallelism
    first, rest = files[::ahead], [x for i, x in enumerate(files) if i % ahead]
    groups = [grouped(x, max(1, min(GROUP, len(x) * chunks // (2 * cores)))) for x in (first, rest)]
    found = visited(spark, groups[0], dealt(whole), chunks, mean, k)
    if rest:
        found = common.saved(found, "search-first")
        kth = ranked(found, k).where(F.col("rank") == k).select("query_id", F.col("score").alias("kth"))
        raised = whole.join(kth, "query_id", "left").select("query_id", "terms", "weights", F.col("kth").alias("floor"))
        found = found.union(visited(spark, groups[1], dealt(raised), chunks, mean, k))
    return ranked(found, k)


def similar(docs: DataFrame, asked: Column, k: int = 10, terms: int | None = TERMS) -> DataFrame:
    """The k best of all documents for each document that `asked` (over doc_id) picks."""
    shards = index(docs)
    queries = common.saved(telling_terms(docs.where(asked), shards, terms), "search-queries")
    return search(shards, queries, k)
