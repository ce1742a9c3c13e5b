"""Near duplicates by a chosen-path similarity join.

A document is the set of its word shingles. Documents of equal sets are one record. In
each of several independent trees a record starts at the root and walks down: a node
picks, by a hash of its path, one or two minwise functions of its level, and a record
goes to the child of its minwise token under each. Records of similarity s stay together
with probability s at each step; with 1.25 children a node, a pair at 0.8 meets at a
given leaf level once per tree on average. Nodes of few records are compared
exhaustively by sketches; larger ones branch again. A node that is still large after the
last level, or that keeps most of its parent's records, or a small one most of whose pairs
are candidates, is dense. It is dealt into small
blocks, each of which gives a forest of its likeliest links, and every record of it is
compared with the node's pivot: this ties most near copies together without all their
pairs. What is not tied by confirmed links then is compared on the full sets, all pairs: the
dense nodes that share records are one family, whose blocks are joined pairwise across
tasks. ``TREES`` trees find a pair at the threshold with probability above 0.998.

Candidate pairs are confirmed on the full sets: first the best partner and the likely
partner of smallest id of each record, then every pair that still joins two components. Pairs inside a component cannot change
it and are not read.

No text, or text without words: the empty set, linked with nothing. A null doc_id gets a
null component and is kept. Rows of equal doc_id are one document. Ties: the smallest id names
a class. A very long text is one set in one task. Only doc_id and text are read, so other
columns may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ticketloom.llm.common import scratch_path, small_side, without, written
from ticketloom.llm.graph import components

TREES = 12
#: Levels of a tree; two minwise functions belong to each.
LEVELS = 6
#: Levels that every record walks before nodes are counted.
FIRST_LEVELS = 2
#: Records of a node that are compared exhaustively.
SMALL_NODE = 192
#: A node that keeps this share of its parent's records is dense: its records are alike,
#: and branching would only copy them.
DENSE = 0.75
#: A small node with more candidate pairs a record is dense, too.
DENSE_PAIRS = 4
#: Stands for the equal bytes of a row that says: this record belongs to that dense node.
MEMBER = -1
#: Bytes of a sketch, and equal bytes from which a pair is a candidate at threshold 0.8.
SKETCH = 64
SKETCH_MARGIN = 0.22
#: Share of equal bytes from which a leaf keeps one link per record only.
SURE = 0.92
#: Share of equal bytes from which the partner of smallest id is confirmed first, too.
LIKELY = 0.84
#: Records, and bytes of sets, of one block of a family of dense nodes.
FAMILY_BLOCK = 512
FAMILY_BYTES = 16_000_000
SEED = 11
_CACHE_WORDS = 150_000

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class _WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        h = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        if len(self) < _CACHE_WORDS:
            self[word] = h
        return h


_WORDS = _WordHash()


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct k-word shingles of a text, A-Z in lower case."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    n = max(len(h) - k + 1, 1)
    width = min(k, len(h))
    out = np.full(n, width, np.uint64)
    for j in range(width):
        out = _mix(out ^ h[j:j + n]) + np.uint64(j + 1)
    return np.unique(out)


def _functions(count: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    return (rng.integers(0, 1 << 32, count, np.uint32) | np.uint32(1))[:, None], rng.integers(0, 1 << 32, count, np.uint32)[:, None]


def _signature(s: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (s >> np.uint64(32)).astype(np.uint32) ^ s.astype(np.uint32)
    parts = [(((x[i:i + 2048] ^ b) * a)).min(axis=1) for i in range(0, len(x), 2048)]
    return reduce(np.minimum, parts)


def _features(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _functions(TREES * LEVELS * 2)
        for batch in batches:
            n, key, sig = [], [], []
            for text in batch.column(1):
                s = shingle_set(text.as_py(), k)
                n.append(len(s))
                key.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                sig.append(_signature(s, a, b).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(key, pa.binary()),
                                              pa.array(sig, pa.binary())], names=["doc_id", "n", "key", "sig"])
    return run


def _walk(path: np.ndarray, level: int, tree: np.ndarray, sig: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Children of each row: (row, path). The node's path decides whether it branches once or twice."""
    rows = np.arange(len(path))
    twice = _mix(path ^ np.uint64(level * 2 + 1)) % np.uint64(4) == 0
    out_rows, out_paths = [], []
    for slot, pick in ((0, np.ones(len(path), bool)), (1, twice)):
        r = rows[pick]
        value = sig[r, tree[r] * (2 * LEVELS) + 2 * level + slot].astype(np.uint64)
        out_rows.append(r)
        out_paths.append(_mix(_mix(path[r] ^ np.uint64(2 * level + slot + 1)) + value))
    return np.concatenate(out_rows), np.concatenate(out_paths)


_NODE = "tree int, path bigint, id bigint, n bigint, sketch binary, parent bigint"


def _matrix(column, dtype, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(-1, width)


def _node_batch(tree, path, ids, n, sketch, parent) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([
        pa.array(tree.astype(np.int32)), pa.array(path.view(np.int64)), pa.array(ids), pa.array(n),
        pa.array([x.tobytes() for x in sketch], pa.binary()), pa.array(parent)],
        names=["tree", "path", "id", "n", "sketch", "parent"])


def _first_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for big in batches:
        for at in range(0, big.num_rows, 1000):
            batch = big.slice(at, 1000)
            sig = _matrix(batch.column(2), np.uint32, TREES * LEVELS * 2)
            ids, n = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            sketch = sig[:, :SKETCH].astype(np.uint8)
            row = np.tile(np.arange(len(ids)), TREES)
            tree = np.repeat(np.arange(TREES), len(ids))
            path = _mix(tree.astype(np.uint64) + np.uint64(SEED))
            for level in range(FIRST_LEVELS):
                r, path = _walk(path, level, tree, sig[row])
                row, tree = row[r], tree[r]
            yield _node_batch(tree, path, ids[row], n[row], sketch[row], np.zeros(len(row), np.int64))


def _next_nodes(level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sig = _matrix(batch.column(5), np.uint32, TREES * LEVELS * 2)
            tree, path, ids, n, size = (batch.column(i).to_numpy() for i in range(5))
            r, child = _walk(path.view(np.uint64), level, tree, sig)
            yield _node_batch(tree[r], child, ids[r], n[r], sig[r, :SKETCH].astype(np.uint8), size[r])
    return run


_PAIR_SCHEMA = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("equal", pa.int32())])
_PAIR = "a bigint, b bigint, equal int"


def _pair_batch(a, b, e) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b), pa.int64()), pa.array(np.maximum(a, b), pa.int64()),
                                       pa.array(np.asarray(e, np.int32))], schema=_PAIR_SCHEMA)


def _compare(ids: np.ndarray, n: np.ndarray, sketch: np.ndarray, similarity: float, forest: bool):
    """Candidate pairs of one node: links that are surely similar as a forest, the others all.

    With ``forest``, and where there are more than ``DENSE_PAIRS`` pairs a record, all of them
    as a forest of the likeliest: one link less than records. In the second case rows
    (smallest id, id, MEMBER) follow, which make the node a dense one.
    """
    order = np.lexsort((ids, n))
    ids, n, sketch = ids[order], n[order], sketch[order]
    least, sure = int(SKETCH * (similarity - SKETCH_MARGIN)), int(SKETCH * SURE)
    stop = np.searchsorted(n, np.floor(n / similarity + 1e-9), "right")
    found = []
    for i in range(len(ids) - 1):
        if stop[i] > i + 1:
            e = np.count_nonzero(sketch[i + 1:stop[i]] == sketch[i], axis=1)
            j = np.flatnonzero(e >= least)
            if len(j):
                found.append((np.full(len(j), i), j + i + 1, e[j]))
    if not found:
        return None
    i, j, e = (np.concatenate(x) for x in zip(*found))
    keep = ids[i] != ids[j]
    i, j, e = i[keep], j[keep], e[keep]
    dense = not forest and len(i) > DENSE_PAIRS * len(ids)
    if forest or dense:
        sure = least
    if len(ids) > 4 and (e >= sure).any():
        parent = list(range(len(ids)))

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        keep = []
        for k in np.argsort(-e, kind="stable").tolist():
            x, y = root(int(i[k])), root(int(j[k]))
            if x != y:
                keep.append(k)
                if e[k] >= sure:
                    parent[x] = y
        i, j, e = i[keep], j[keep], e[keep]
    if dense:
        chief = np.full(len(ids), ids.min())
        return np.concatenate((ids[i], chief)), np.concatenate((ids[j], ids)), np.concatenate((e, np.full(len(ids), MEMBER)))
    return ids[i], ids[j], e


def _leaves(similarity: float):
    """Rows sorted by path: nodes may go on from one batch to the next. Blocks of dense nodes are marked."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in _and_end(batches):
            if batch is not None:
                now = [batch.column(i).to_numpy() for i in range(3)] + [_matrix(batch.column(3), np.uint8, SKETCH),
                                                                          batch.column(4).to_numpy(zero_copy_only=False)]
                held = now if held is None else [np.concatenate(x) for x in zip(held, now)]
            if held is None or not len(held[0]):
                continue
            cuts = np.concatenate(([0], np.flatnonzero(np.diff(held[0])) + 1))
            if batch is None:
                cuts = np.append(cuts, len(held[0]))
            out = [x for a, b in zip(cuts[:-1], cuts[1:]) if b - a > 1
                   and (x := _compare(held[1][a:b], held[2][a:b], held[3][a:b], similarity, bool(held[4][a]))) is not None]
            held = [x[cuts[-1]:] for x in held]
            if out:
                yield _pair_batch(*(np.concatenate(x) for x in zip(*out)))
    return run


def _and_end(batches):
    yield from (b for b in batches if b.num_rows)
    yield None


def _pivots(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                e = np.count_nonzero(_matrix(batch.column(2), np.uint8, SKETCH) == _matrix(batch.column(3), np.uint8, SKETCH), axis=1)
                k = np.flatnonzero(e >= int(SKETCH * (similarity - SKETCH_MARGIN)))
                yield _pair_batch(batch.column(0).to_numpy()[k], batch.column(1).to_numpy()[k], e[k])
    return run


def candidates(first: DataFrame, records: DataFrame, similarity: float) -> tuple[DataFrame, DataFrame | None]:
    """Pairs a < b with the number of equal sketch bytes, from all trees and levels; and
    rows id, chief of the dense nodes, if there are any.

    ``first`` holds id, n, sig of the records to pair; ``records`` is a written table in
    which the signatures of those that branch further are looked up. Counts are combined before the shuffle; the joins by
    path and by id may be split where a key is hot.
    """
    spark = records.sparkSession
    rows = first.select("id", "n", "sig").mapInArrow(_first_nodes, _NODE)
    leaves, stars, dense_nodes, level = [], [], [], FIRST_LEVELS
    while True:
        draw = F.xxhash64("id", "path")
        nodes = rows.groupBy("path").agg(F.count(F.lit(1)).alias("size"), F.min(draw).alias("pivot")).where("size > 1")
        held = written(rows.join(nodes, "path"), scratch_path(spark, "nodes"))
        leaves.append(held.where(F.col("size") <= SMALL_NODE).select("path", "id", "n", "sketch", F.lit(False).alias("block")))
        dense = (F.col("parent") > 0) & (F.col("size") >= DENSE * F.col("parent")) | F.lit(level == LEVELS)
        large = held.where(F.col("size") > SMALL_NODE)
        last, wide = large.where(dense), large.where(~dense)
        if last.limit(1).count():
            blocks = F.ceil(F.col("size") * 2 / SMALL_NODE)
            leaves.append(last.select(F.xxhash64("path", F.pmod(F.xxhash64("path", "id"), blocks)).alias("path"),
                                      "id", "n", "sketch", F.lit(True).alias("block")))
            chief = last.where(draw == F.col("pivot")).select("path", F.col("id").alias("chief"), F.col("sketch").alias("mark"))
            star = last.join(chief, "path").where("id <> chief").select("id", "chief", "sketch", "mark")
            dense_nodes.append(star.select("id", "chief"))
            stars.append(star)
        ids = written(wide.select("id").distinct(), scratch_path(spark, "wide"))
        if not ids.limit(1).count():
            break
        some = records.join(small_side(ids), "id", "left_semi").select("id", "sig")
        rows = wide.select("tree", "path", "id", "n", "size").join(some, "id").select(
            "tree", "path", "id", "n", "size", "sig").mapInArrow(_next_nodes(level), _NODE)
        level += 1
    # the leaves of all levels at once; a path belongs to one level
    pairs = reduce(DataFrame.union, leaves).repartition("path").sortWithinPartitions("path").mapInArrow(_leaves(similarity), _PAIR)
    if stars:
        pairs = pairs.union(reduce(DataFrame.union, stars).mapInArrow(_pivots(similarity), _PAIR))
    found = written(pairs, scratch_path(spark, "found"))
    member = found.where(F.col("equal") == MEMBER)
    if member.limit(1).count():
        dense_nodes.append(member.select(F.col("b").alias("id"), F.col("a").alias("chief")))
    dense = written(reduce(DataFrame.union, dense_nodes).distinct(), scratch_path(spark, "dense")) if dense_nodes else None
    return found.where(F.col("equal") != MEMBER).groupBy("a", "b").agg(F.max("equal").alias("equal")), dense


def _both(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs of two lists of sets, exact."""
    token, at = np.unique(np.concatenate(x + y), return_inverse=True)
    row = np.repeat(np.arange(len(x) + len(y)), [len(s) for s in x + y])
    left = row < len(x)
    shared = np.zeros(len(token), bool)
    shared[at[left]] = True
    other = np.zeros(len(token), bool)
    other[at[~left]] = True
    shared &= other
    keep = shared[at]
    row, at = row[keep], (np.cumsum(shared) - 1)[at[keep]]
    order = np.argsort(at, kind="stable")
    row, at = row[order], at[order]
    out = np.zeros((len(x), len(y)), np.int64)
    for start in range(0, int(shared.sum()), 4096):
        a, b = np.searchsorted(at, (start, start + 4096))
        bits = np.zeros((len(x) + len(y), 4096), np.float32)
        bits[row[a:b], at[a:b] - start] = 1
        out += (bits[:len(x)] @ bits[len(x):].T).astype(np.int64)
    return out


def _family_links(similarity: float):
    """Links of one pair of blocks of a family: confirmed pairs, as a forest over the labels."""
    percent = round(similarity * 100)

    def run(table: pa.Table) -> pa.Table:
        ids, label = table["id"].to_numpy(), table["label"].to_numpy()
        side = table["side"].to_numpy()
        sets = [np.frombuffer(s, np.uint64) for s in table["set"].to_pylist()]
        # A block paired with itself comes once, as side 0.
        x = np.flatnonzero(side == 0)
        y = np.flatnonzero(side == 1) if (side == 1).any() else x
        none = pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        if not len(x) or table["i"][0] != table["j"][0] and y is x:
            return none
        both = _both([sets[k] for k in x], [sets[k] for k in y])
        n = np.array([len(s) for s in sets])
        i, j = np.nonzero((100 * both >= percent * (n[x][:, None] + n[y][None, :] - both)) & (label[x][:, None] != label[y][None, :]))
        if not len(i):
            return none
        i, j = x[i], y[j]
        _, first = np.unique(np.sort(np.stack([label[i], label[j]]), axis=0), axis=1, return_index=True)
        parent: dict[int, int] = {}

        def root(v: int) -> int:
            while parent.setdefault(v, v) != v:
                parent[v] = parent[parent[v]]
                v = parent[v]
            return v

        keep = []
        for k in first.tolist():
            p, q = root(int(label[i[k]])), root(int(label[j[k]]))
            if p != q:
                parent[p] = q
                keep.append(k)
        a, b = ids[i[keep]], ids[j[keep]]
        return pa.table({"a": pa.array(np.minimum(a, b)), "b": pa.array(np.maximum(a, b))})
    return run


def dense_links(dense: DataFrame, own: DataFrame, label: DataFrame, plain: DataFrame, k: int, similarity: float) -> DataFrame | None:
    """Confirmed links a, b between different labels inside the families of dense nodes.

    Dense nodes that share records are one family, compared once. The records of its most
    frequent label are tied already: they meet only the others, never each other. A family
    of one label is left out. None: nothing is open.
    """
    spark = plain.sparkSession
    # A record's chiefs hang together: link each with the record's smallest one, then only chiefs.
    least = dense.groupBy("id").agg(F.min("chief").alias("least"))
    of = components(dense.join(least, "id").where("chief <> least").select("least", "chief").distinct(), "least", "chief")
    every = least.union(dense.select("chief", "chief")).groupBy("id").agg(F.min("least").alias("least"))
    family = every.join(of.select(F.col("id").alias("least"), "label"), "least", "left").select(
        "id", F.coalesce("label", "least").alias("family"))
    size = own.where("doc_id = rep").groupBy("doc_id").agg(F.max("n").alias("n")).withColumnRenamed("doc_id", "id")
    member = written(family.join(label, "id", "left").join(size, "id").select(
        "id", "family", "n", F.coalesce("label", "id").alias("label")), scratch_path(spark, "members"))
    part = member.groupBy("family", "label").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("n"))
    most = part.groupBy("family").agg(F.max(F.struct("m", "label", "n")).alias("top"), F.sum("m").alias("m"), F.sum("n").alias("n")).where("m > top.m")
    blocks = lambda m, n: F.greatest(F.ceil(m / FAMILY_BLOCK), F.ceil(n * 8 / FAMILY_BYTES)).cast("int")
    most = written(most.select("family", F.col("top.label").alias("top"), blocks(F.col("top.m"), F.col("top.n")).alias("tops"),
                               blocks(F.col("m") - F.col("top.m"), F.col("n") - F.col("top.n")).alias("rests")), scratch_path(spark, "families"))
    if not most.limit(1).count():
        return None
    # Blocks 0 to rests - 1 hold the others, the next ones the most frequent label.
    mine = F.when(F.col("label") == F.col("top"), F.col("rests") + F.pmod(F.xxhash64("id"), F.col("tops"))).otherwise(
        F.pmod(F.xxhash64("id"), F.col("rests"))).cast("int")
    placed = member.join(small_side(most), "family").select("id", "family", "label", "tops", "rests", mine.alias("block"))
    placed = written(placed, scratch_path(spark, "placed"))
    wanted = small_side(placed.select("id"))
    sets = plain.join(wanted, F.col("doc_id") == F.col("id"), "left_semi").mapInArrow(
        _sets(k), "id bigint, set binary").dropDuplicates(["id"])
    # With every other block, with itself if it is not of the most frequent label.
    last = F.when(F.col("block") < F.col("rests"), F.col("rests") + F.col("tops")).otherwise(F.col("rests")) - 1
    dealt = placed.join(sets, "id").select("id", "family", "label", "set", "block", F.explode(F.sequence(F.lit(0), last)).alias("other"))
    dealt = dealt.select("id", "label", "set", "family", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
                         (F.col("block") > F.col("other")).cast("int").alias("side"))
    return written(dealt.groupBy("family", "i", "j").applyInArrow(_family_links(similarity), "a bigint, b bigint"),
                   scratch_path(spark, "family-links"))


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(
                [shingle_set(t.as_py(), k).tobytes() for t in batch.column(1)], pa.binary())], names=["id", "set"])
    return run


def _confirmed(similarity: float):
    percent = round(similarity * 100)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * both >= percent * (len(x) + len(y) - both))
            keep = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])
    return run


def classes(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    spark = docs.sparkSession
    plain = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    feats = written(plain.mapInArrow(_features(shingle), "doc_id bigint, n bigint, key binary, sig binary"),
                    scratch_path(spark, "features"))
    reps = feats.where("n > 0 and doc_id is not null").groupBy("key").agg(F.min("doc_id").alias("rep"))
    own = feats.select("doc_id", "n", "key").join(reps, "key", "left").select("doc_id", "n", "rep")
    own = written(own, scratch_path(spark, "records"))
    reps = own.where("doc_id = rep").select("doc_id").distinct()
    records = feats.where("n > 0").select(F.col("doc_id").alias("id"), "n", "sig")
    first = feats.where("n > 0").join(reps, "doc_id", "left_semi").select(F.col("doc_id").alias("id"), "n", "sig")
    pairs, dense = candidates(first, records, similarity)
    pairs = written(pairs, scratch_path(spark, "pairs"))

    sides = pairs.select(F.col("a").alias("id"), F.struct("equal", "a", "b").alias("p")).union(
        pairs.select(F.col("b").alias("id"), F.struct("equal", "a", "b").alias("p")))
    wanted = small_side(written(sides.select("id").distinct(), scratch_path(spark, "wanted")))
    sets = written(plain.join(wanted, F.col("doc_id") == F.col("id"), "left_semi").mapInArrow(
        _sets(shingle), "id bigint, set binary").dropDuplicates(["id"]), scratch_path(spark, "sets"))

    def confirm(some: DataFrame) -> DataFrame:
        left = some.join(sets.select(F.col("id").alias("a"), F.col("set").alias("x")), "a")
        both = left.join(sets.select(F.col("id").alias("b"), F.col("set").alias("y")), "b").select("a", "b", "x", "y")
        return written(both.mapInArrow(_confirmed(similarity), "a bigint, b bigint"), scratch_path(spark, "links"))

    likely = F.when(F.col("p.equal") >= int(SKETCH * LIKELY), F.struct(
        F.when(F.col("p.a") == F.col("id"), F.col("p.b")).otherwise(F.col("p.a")).alias("other"), "p.a", "p.b"))
    picks = sides.groupBy("id").agg(F.max("p").alias("p"), F.min(likely).alias("q"))
    best = picks.select("p.a", "p.b").union(picks.where("q is not null").select("q.a", "q.b")).distinct()
    links = confirm(best)
    label = components(links)
    low, high = (label.select(F.col("id").alias(x), F.col("label").alias(f"{x}_label")) for x in "ab")
    open_pairs = pairs.join(low, "a", "left").join(high, "b", "left").where(
        F.coalesce("a_label", "a") != F.coalesce("b_label", "b")).select("a", "b").join(best, ["a", "b"], "left_anti")
    links = links.union(confirm(open_pairs))
    label = components(links)
    more = dense_links(dense, own, label, plain, shingle, similarity) if dense is not None else None
    if more is not None:
        label = components(links.union(more))
    found = own.join(label, own["rep"] == label["id"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("label", "rep", "doc_id"))
    return found.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"),
                        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def deduplicated(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """The documents with one of each class of near duplicates, columns as given."""
    spark = docs.sparkSession
    gone = written(classes(docs, shingle, similarity).where("not kept").select("doc_id").distinct(),
                   scratch_path(spark, "duplicates"))
    return without(docs, "doc_id", gone)
