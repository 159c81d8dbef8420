"""Near-duplicate classes by chosen-path set similarity join on word shingles.

1. Every text becomes its set of word shingles (64-bit hashes); texts with equal sets are one
   class with a number of its own, and a row (smallest doc_id, then hash of the text) to read it by.
   A class has a signature of minwise tokens.
2. TREES independent trees branch the classes by minwise tokens: the first one whole, 64 bits,
   deeper ones by a byte. Nodes above `node` classes branch before they meet in a task; in a task,
   nodes above `leaf` branch further, the first TWICE times twice over, by two tokens. The classes of a
   small node are compared with one another by their signatures, and those that may reach the
   similarity (4.7 standard deviations of leeway) are joined in local stars.
3. The stars' connected components are clusters: no two classes of different clusters were found
   alike in any tree. The whole sets of a small cluster meet in one task, which tests pairs on them
   until every two classes are either connected by links or tested. A cluster with more shingles
   than GRID is cut into blocks, and every two blocks meet in a task of their own; one with more than
   CLUSTER is branched further, over all trees, until its nodes fit.
4. Components of the confirmed links give the result.

A pair at the threshold stays together in a tree's first node with probability 0.8, in a branch with
0.8 again, in one of two branches with 1 - (1 - 0.8) ** 2 = 0.96. missed() gives the odds that no tree
keeps it together: 1e-14 in first nodes, 9e-13 after four branches in a task, 5e-9 where a first node
of over `node` classes branched once before, 1e-6 where twice.

No pair list is made: tasks give at most one link for each class and tree, and a task tests only
pairs that are not connected yet. Exact copies collapse by a map-side aggregation before.

Cases: a null text, or one without words, has an empty set and is linked with nothing; with fewer
words than a shingle has, all words are one shingle; rows that share a doc_id are compared each,
by their texts, and keep that id, and a component's id is the smallest doc_id in it, whatever rows
elsewhere share it; a null doc_id is linked with nothing, has a null component and is kept; an empty
table gives no row; extra columns are ignored; texts are used whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geomlake.llm import common
from geomlake.llm.components import components

TREES, TOKENS, MATCHES, LEAF = 20, 64, 36, 1024
#: Most classes of a node in one task; shingles of a block, of a cluster that is cut into blocks; blocks of a cluster.
NODE, GRID, CLUSTER, BLOCKS = 100_000, 50_000, 8_000_000, 24
_ODD = np.random.default_rng(77).integers(1 << 20, 1 << 32, TOKENS, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * M2
    return x ^ (x >> np.uint64(29))


def shingle_sets(texts: pa.Array, k: int) -> list[np.ndarray]:
    """The sorted shingle hashes of each text of an array without nulls."""
    words = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    coded = words.values.dictionary_encode()
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) if w else 0 for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    empty = coded.dictionary.index("").as_py()
    index = coded.indices.to_numpy(zero_copy_only=False)
    flat, bounds = hashes[index] if len(index) else np.zeros(0, np.uint64), words.offsets.to_numpy().astype(np.int64)
    if empty >= 0:
        real = index != empty
        bounds = np.concatenate([[0], np.cumsum(real)])[bounds]
        flat = flat[real]
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        n, run = max(min(b - a, k), 0), max(b - a - k + 1, min(b - a, 1))
        h = np.zeros(run, np.uint64)
        for j in range(n):
            h = mixed(h * M1 + flat[a + j : a + j + run] + np.uint64(j + 1))
        out.append(np.unique(h))
    return out


def signature(shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The minwise tokens of a set: those that open the trees, whole, and the low bytes of all."""
    low, at = np.full(TOKENS, 0xFFFFFFFF, np.uint32), np.zeros(TREES, np.int64)
    x = (shingles ^ (shingles >> np.uint64(32))).astype(np.uint32)
    for start in range(0, len(x), 1 << 14):
        part = x[None, start : start + (1 << 14)] * _ODD[:, None]
        least = part.min(axis=1)
        for t in np.flatnonzero(least[:TREES] < low[:TREES]).tolist() if start else range(TREES):
            at[t] = start + part[t].argmin()
        np.minimum(low, least, out=low)
    return shingles[at], low.astype(np.uint8)


def sketches(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, mark (hash of the text), n_shingles, key (equal for equal sets), first (tokens), sig; stored."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            sets = shingle_sets(batch.column(1), k)
            keys = [xxhash.xxh3_128_digest(s) if len(s) else None for s in sets]
            tokens = [tuple(x.tobytes() for x in signature(s)) if len(s) else (None, None) for s in sets]
            columns = [batch.column(0), batch.column(2), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), *(pa.array(x, pa.binary()) for x in zip(*tokens, strict=True))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "mark", "n_shingles", "key", "first", "sig"])

    rows = common.texts(docs, F.xxhash64("text").alias("mark"))
    return common.saved(rows.mapInArrow(sketch, "doc_id long, mark long, n_shingles long, key binary, first binary, sig binary"), "sketches")


class Links:
    """Union-find over positions, some of them connected beforehand; the smallest position leads.

    A pivot is tested against all that it isn't connected with. Two unconnected positions are not
    both in the largest group, so once every position outside it was a pivot, all unconnected pairs
    were tested. alike(pivot, others) says which of the others are linked with the pivot.
    """

    def __init__(self, labels: np.ndarray, alike):
        _, first, place = np.unique(labels, return_index=True, return_inverse=True)
        self.top, self.alike, self.todo = first[place], alike, np.ones(len(labels), bool)

    def waiting(self) -> np.ndarray:
        """Positions still to be pivots."""
        sizes = np.bincount(self.top, minlength=len(self.top))
        return np.flatnonzero(self.todo & (self.top != sizes.argmax()))

    def test(self, pivot: int) -> None:
        self.todo[pivot] = False
        others = np.flatnonzero(self.top != self.top[pivot])
        hit = others[self.alike(pivot, others)] if len(others) else others
        if len(hit):
            tops = np.unique(np.append(self.top[hit], self.top[pivot]))
            self.top[np.isin(self.top, tops)] = tops[0]

    def finish(self) -> np.ndarray:
        """The leaders once no unconnected pair is untested."""
        while len(open_ := self.waiting()):
            self.test(int(open_[0]))
        return self.top


def visited(rows: np.ndarray, ids: np.ndarray, tokens: np.ndarray, n: np.ndarray, tree: int, similarity: float, leaf: int = LEAF, depth: int = 1) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Stars (a, b) of a node's rows, ordered by id, that may be alike, and the depth that they were found at.

    A few spread pivots connect what is alike on the whole. If the pairs that then remain are no
    more than those of a small node, they are all compared; else the node branches by the next token,
    up to a depth of TWICE by each of two.
    """
    sig, size = tokens[rows], n[rows]

    def alike(p, others):
        near = np.minimum(size[others], size[p]) >= similarity * np.maximum(size[others], size[p]) - 1e-9
        near[near] = (sig[others[near]] == sig[p]).sum(axis=1) >= MATCHES
        return near

    links = Links(ids[rows], alike)
    if len(rows) > leaf:
        for p in range(0, len(rows), -(-len(rows) // 8)):
            links.test(p)
    whole = len(links.waiting()) * len(rows) <= leaf * leaf or depth > DEPTHS
    top = links.finish() if whole else links.top
    tied = top != np.arange(len(rows))
    yield ids[rows[tied]], ids[rows[top[tied]]], depth
    for way in () if whole else range(2 if depth <= TWICE else 1):
        byte = tokens[rows, coordinate(tree, depth, way)]
        order = np.argsort(byte, kind="stable")
        for part in np.split(rows[order], np.flatnonzero(np.diff(byte[order])) + 1):
            if len(part) > 1:
                yield from visited(part, ids, tokens, n, tree, similarity, leaf, depth + 1)


#: Depths that have two tokens of their own; depths that branch by both. Branching before a task takes tokens from the deep end.
DEPTHS, TWICE = (TOKENS - 1) // 2, 4


def coordinate(tree: int, depth: int, way: int = 0) -> int:
    """The token by which a tree branches at a depth, in one of two ways: an odd step reaches all."""
    return (tree + max(0, 2 * depth - 1 + way) * (2 * tree + 1)) % TOKENS


def missed(depth: int, before: int = 0, similarity: float = 0.8, trees: int = TREES) -> float:
    """The odds that no tree keeps a pair together, after so many branches in a task and before it."""
    together = 1.0
    for at in range(depth, 0, -1):
        together = 1 - (1 - similarity * together) ** 2 if at <= TWICE else similarity * together
    return (1 - similarity ** (before + 1) * together) ** trees


def runs(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.Table]:
    """The tables of equal values of a column by which the rows are sorted."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        values = batch.column(batch.schema.get_field_index(column)).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(values[1:] != values[:-1]) + 1).tolist(), len(values)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if held and held[0].column(held[0].schema.get_field_index(column))[0].as_py() != values[a]:
                if sum(x.num_rows for x in held) > 1:
                    yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if sum(x.num_rows for x in held) > 1:
        yield pa.Table.from_batches(held)


def branched(classes: DataFrame, start: list[str]) -> DataFrame:
    """A row for each class (cid, n_shingles, first, sig and the columns of start) and tree: tree, node, cid, n, sig.

    The first node is the tree's first token, or start's columns where given.
    """

    def branch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            first = np.frombuffer(b"".join(batch.column(2).to_pylist()), "<u8").reshape(n, TREES)
            above = batch.column(4).to_numpy().view(np.uint64) if start else None
            for t in range(TREES):
                node = mixed((above if start else first[:, t]) * M1 + np.uint64(t + 1)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, t, np.int32)), pa.array(node), batch.column(0), batch.column(1), batch.column(3)], ["tree", "node", "cid", "n", "sig"])

    return classes.select("cid", "n_shingles", "first", "sig", *start).mapInArrow(branch, "tree int, node long, cid long, n long, sig binary")


def bounded(rows: DataFrame, weight, most: int) -> DataFrame:
    """Branches nodes heavier than `most` by further tokens, while there are any.

    The rows are made anew for each look at their weights: that is cheaper than to move them.
    """
    for depth in range(1, DEPTHS):
        heavy = common.saved(rows.groupBy("node").agg(F.sum(weight).alias("weight")).where(F.col("weight") > most).select("node"), "heavy")
        if heavy.isEmpty():
            break
        place = F.element_at(F.array(*[F.lit(coordinate(t, DEPTHS + 1 - depth)) for t in range(TREES)]), F.col("tree") + 1)
        deeper = F.xxhash64("node", F.col("sig").substr(place + 1, F.lit(1)), F.lit(depth))
        marked = rows.join(small(heavy.withColumn("heavy", F.lit(True))), "node", "left")
        rows = marked.select("tree", F.when(F.col("heavy"), deeper).otherwise(F.col("node")).alias("node"), "cid", "n", "sig")
    return rows


def starred(rows: DataFrame, similarity: float, leaf: int = LEAF) -> DataFrame:
    """Local stars (a, b) of classes that may be alike, from every small node of every tree, with their depth."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        held = 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found, strict=True)], ["a", "b", "depth"])

        for node in runs(batches, "node"):
            ids, n = node["cid"].to_numpy(), node["n"].to_numpy()
            tokens = np.frombuffer(b"".join(node["sig"].to_pylist()), np.uint8).reshape(-1, TOKENS)
            for a, b, depth in visited(np.argsort(ids, kind="stable"), ids, tokens, n, node["tree"][0].as_py(), similarity, leaf):
                if len(a):
                    found.append((a, b, np.full(len(a), depth, np.int32)))
                    held += len(a)
            if held > 100_000 or len(found) > 5000:
                yield out()
                found, held = [], 0
        if found:
            yield out()

    return rows.repartition("node").sortWithinPartitions("node").mapInArrow(compare, "a long, b long, depth int").groupBy("a", "b").agg(F.max("depth").alias("depth"))


def confirmed(groups: DataFrame, classes: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Links (a, b) on whole sets inside groups (cid, grp, label): a star for each component of a group.

    Rows of one label are known to be connected. A class is read by its row's doc_id and mark.
    """

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            new = []
            for i, at in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                if at not in seen:
                    seen.add(at)
                    new.append(i)
            yield batch.take(pa.array(new, pa.int64()))

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, "grp"):
            cids, first = np.unique(group["cid"].to_numpy(), return_index=True)
            sets = []
            for part in common.slices(group.take(pa.array(first)).combine_chunks().to_batches()):
                sets += shingle_sets(part.column(part.schema.get_field_index("text")), k)
            size = np.array([len(s) for s in sets])
            flat, place = np.concatenate(sets), np.concatenate([[0], np.cumsum(size)])

            def alike(p, others, sets=sets, size=size, flat=flat, place=place):
                own, near = sets[p], np.minimum(size[others], size[p]) * 100 >= percent * np.maximum(size[others], size[p])
                for i in np.flatnonzero(near) if near.sum() < 32 else ():
                    x = sets[others[i]]
                    both = int((own[np.minimum(np.searchsorted(own, x), len(own) - 1)] == x).sum())
                    near[i] = 100 * both >= percent * (len(own) + len(x) - both)
                if near.sum() >= 32:
                    both = np.add.reduceat(own[np.minimum(np.searchsorted(own, flat), len(own) - 1)] == flat, place[:-1], dtype=np.int64)[others]
                    near &= 100 * both >= percent * (len(own) + size[others] - both)
                return near

            top = Links(group["label"].to_numpy()[first], alike).finish()
            tied = np.flatnonzero(top != np.arange(len(cids)))
            if len(tied):
                yield pa.RecordBatch.from_arrays([pa.array(cids[tied]), pa.array(cids[top[tied]])], ["a", "b"])

    asked = common.saved(groups.join(classes.select("cid", "rep", "mark"), "cid"), "asked")
    rows = common.texts(docs, F.xxhash64("text").alias("mark"))
    held = rows.join(small(asked), (F.col("doc_id") == F.col("rep")) & (rows["mark"] == asked["mark"])).select("cid", "grp", "label", "text")
    return held.mapInArrow(once, held.schema).repartition("grp").sortWithinPartitions("grp").mapInArrow(confirm, "a long, b long")


def small(rows: DataFrame, most: int = 1_000_000) -> DataFrame:
    """Marks a stored table of a few longs for broadcast if it is counted to have few rows."""
    return F.broadcast(rows) if rows.count() <= most else rows


def gridded(weights: DataFrame, most: int, block: int = GRID) -> DataFrame:
    """Groups (cid, grp, label) of clusters (cid, grp, n_shingles) up to `most` shingles: whole, or every two blocks."""
    totals = weights.groupBy("grp").agg(F.sum("n_shingles").alias("w")).where(F.col("w") <= most)
    n = F.least(F.lit(BLOCKS), F.ceil(F.col("w") / block)).cast("int")
    rows = weights.join(totals, "grp").select("cid", "grp", n.alias("n"), F.pmod(F.xxhash64("cid"), n).alias("own"))
    # Two blocks make one cell, as one block does.
    cells = F.when(F.col("n") <= 2, F.array(F.lit(0))).otherwise(F.array_except(F.sequence(F.lit(0), F.col("n") - 1), F.array("own")))
    met = rows.select("cid", "grp", "n", "own", F.explode(cells).alias("other"))
    cell = F.when(F.col("n") <= 2, F.col("grp")).otherwise(F.xxhash64("grp", F.least("own", "other"), F.greatest("own", "other")))
    return met.select("cid", cell.alias("grp"), F.col("cid").alias("label"))


def split(heavy: DataFrame, classes: DataFrame, docs: DataFrame, k: int, percent: int, most: int) -> DataFrame:
    """Links (a, b) of clusters (cid, grp, n_shingles, first, sig) that are too large for blocks.

    They are branched further over all trees, which connects nearly all of a cluster. Any link
    that this can miss has an end outside the cluster's largest component: those members are then
    tested, chunk by chunk, against all chunks of their cluster, so that no pair is left out.
    """
    held = common.saved(heavy.select("cid", "grp", "n_shingles", "first", "sig"), "heavy")
    nodes = common.saved(bounded(branched(held, ["grp"]), F.col("n"), most).select("cid", F.col("node").alias("grp"), F.col("cid").alias("label")).distinct(), "groups")
    found = common.saved(confirmed(nodes, classes, docs, k, percent), "links")
    named = common.saved(held.join(components(found).toDF("cid", "label"), "cid", "left").select("cid", "grp", "n_shingles", F.coalesce("label", "cid").alias("label")), "named")
    sizes = named.groupBy("grp", "label").agg(F.sum("n_shingles").alias("w"))
    totals = sizes.groupBy("grp").agg(F.sum("w").alias("all"), F.max_by("label", F.struct("w", "label")).alias("largest"), F.max("w").alias("top"))
    chunks = lambda w: F.ceil(2 * w / most).cast("int")
    rows = named.join(totals, "grp").withColumns({"rest": F.when(F.col("all") > F.col("top"), chunks(F.col("all") - F.col("top"))).otherwise(0), "whole": chunks(F.col("all")), "mix": F.xxhash64("cid")})
    rows = rows.where("rest > 0")
    met = rows.select("cid", "label", "grp", F.pmod("mix", "whole").alias("m"), F.explode(F.sequence(F.lit(0), F.col("rest") - 1)).alias("r"))
    outside = rows.where("label <> largest").select("cid", "label", "grp", F.explode(F.sequence(F.lit(0), F.col("whole") - 1)).alias("m"), F.pmod("mix", "rest").alias("r"))
    pairs = common.saved(met.union(outside.select(met.columns)).select("cid", F.xxhash64("grp", "m", "r").alias("grp"), "label").distinct(), "chunks")
    return found.union(confirmed(pairs, classes, docs, k, percent))


def labelled(docs: DataFrame, k: int = 5, percent: int = 80, cluster: int = CLUSTER, node: int = NODE, leaf: int = LEAF, grid: int = GRID) -> DataFrame:
    """Per row of docs: doc_id, mark (hash of the text), n_shingles, label (of its component), component_id."""
    sketched = sketches(docs, k)
    usable = sketched.where("key IS NOT NULL AND doc_id IS NOT NULL")
    classes = usable.groupBy("key").agg(F.min(F.struct("doc_id", "mark")).alias("row"), F.first("n_shingles").alias("n_shingles"), F.first("first").alias("first"), F.first("sig").alias("sig"))
    classes = common.saved(classes.select(F.monotonically_increasing_id().alias("cid"), "key", F.col("row.doc_id").alias("rep"), F.col("row.mark").alias("mark"), "n_shingles", "first", "sig"), "classes")
    stars = starred(bounded(branched(classes, []), F.lit(1), node), percent / 100, leaf)
    weights = common.saved(components(stars).toDF("cid", "grp").join(classes.select("cid", "n_shingles", "first", "sig"), "cid"), "clusters")
    heavy = weights.groupBy("grp").agg(F.sum("n_shingles").alias("w")).where(F.col("w") > cluster).select("grp")
    links = confirmed(gridded(weights, cluster, min(grid, cluster)), classes, docs, k, percent)
    if not heavy.isEmpty():
        links = links.union(split(weights.join(heavy, "grp", "left_semi"), classes, docs, k, percent, cluster))
    linked = components(links).toDF("cid", "label").join(classes.select("cid", "rep"), "cid")
    lowest = linked.groupBy("label").agg(F.min("rep").alias("low"))
    linked = linked.select("cid", "label").join(lowest, "label")
    named = classes.select("key", "cid", "rep").join(linked, "cid", "left").select("key", F.coalesce("label", "cid").alias("label"), F.coalesce("low", "rep").alias("low"))
    out = sketched.select("doc_id", "mark", "n_shingles", "key").join(named, "key", "left")
    own = F.col("doc_id").isNotNull()
    return out.select("doc_id", "mark", "n_shingles", F.when(own, F.col("label")).alias("label"), F.when(own, F.coalesce("low", "doc_id")).alias("component_id"))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, **more: int) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (smallest doc_id reachable), kept."""
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept")
    return labelled(docs, k, percent, **more).select("doc_id", "n_shingles", "component_id", kept)


def one_each(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs without near-duplicates: of each component, the row with the smallest doc_id, then mark.

    Rows stay or go by what they hold, never by doc_id alone: other components' rows that share the id
    stay. Of rows that are equal in doc_id and text, one stays, that with the smallest hash of its
    other plain columns. Rows without words or doc_id stay.
    """
    rows = labelled(docs, k, percent).where("label IS NOT NULL").groupBy("label", "doc_id", "mark").agg(F.count("*").alias("n"))
    rows = common.saved(rows, "components")
    first = rows.groupBy("label").agg(F.min(F.struct("doc_id", "mark")).alias("first")).select("label", "first.*")
    # Joined by row, not by component: a component may hold a third of all rows.
    of = ["label", "doc_id", "mark"]
    named = lambda found: found.select(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark"))
    gone = common.saved(named(rows.join(first, of, "left_anti")), "gone")
    twice = common.saved(named(rows.where("n > 1").join(first, of, "left_semi")), "twice")
    here = lambda other: (docs["doc_id"].cast("long") == other["_id"]) & (F.xxhash64(docs["text"]) == other["_mark"])
    kept = docs.join(small(gone), here(gone), "left_anti")
    if twice.isEmpty():
        return kept
    plain = [F.col(c) for c, kind in docs.dtypes if "<" not in kind]
    equal = kept.join(small(twice), here(twice), "left_semi").groupBy(F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_mark"))
    one = equal.agg(F.min_by(F.struct(*docs.columns), F.xxhash64(*plain)).alias("row")).select("row.*")
    return kept.join(small(twice), here(twice), "left_anti").union(one)


def oracle(percent: int = 80) -> str:
    """The result for two-word shingles as DuckDB SQL: every pair that shares a shingle, then a walk over the links."""
    return f"""
    WITH RECURSIVE w AS (
      SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{common.ASCII_UPPER}', '{common.ASCII_LOWER}'), '[\\x20\\x09-\\x0D]+'), lambda q: q <> '') AS ws FROM documents
    ), s AS (
      SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) > 1 THEN list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) ELSE ws END) AS sh FROM w
    ), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
    ), p AS (SELECT a.doc_id AS i, b.doc_id AS j, count(*) AS both_n FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL
    ), l AS (SELECT i, j FROM p JOIN n x ON x.doc_id = i JOIN n y ON y.doc_id = j WHERE 100 * both_n >= {percent} * (x.n + y.n - both_n)
    ), e AS (SELECT i AS src, j AS dst FROM l UNION ALL SELECT j, i FROM l
    ), walk AS (SELECT DISTINCT src AS doc_id, src AS seen FROM e UNION SELECT walk.doc_id, e.dst FROM walk JOIN e ON e.src = walk.seen
    ), c AS (SELECT doc_id, min(seen) AS low FROM walk GROUP BY doc_id)
    SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(c.low, d.doc_id) AS component_id, coalesce(c.low, d.doc_id) = d.doc_id AS kept
    FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)"""
