"""Token ids in Re-Pair grammar files.

Documents are range-partitioned into shards and sorted by doc_id. Each task encodes its
shard (block by block if it is large) and compresses it by Re-Pair: count neighbouring
pairs, replace the most frequent by new symbols, again until no pair occurs often enough to
pay for its rule. Many pairs are replaced in one round, chosen so that none of their
occurrences can overlap; pairs of one symbol are replaced from the start of each run. A
pair never reaches over the end of a document.

File format, one binary per block (little endian): magic ``RPR1``; uint32 numbers of
documents, rules and symbols; the rules as uint32 pairs (rule r has the symbol
VOCABULARY + r); the expansion length of each rule (uint32); for each document its
first symbol and its first id in the block (uint64 each, one entry more for the end);
the symbols (uint32, deflated). One document is decoded from its symbols alone, and one
stretch of ids by the expansion lengths. Blocks are stored in Parquet rows
(shard, block, first ids, file), so that Spark commits, places and reads them.

Null text is empty: the end id alone. Rows of equal doc_id keep their number, in no
fixed order unless their texts are equal. A null doc_id sorts first. A very long text is
encoded whole. Only doc_id and text are read, so other columns may have any name.
"""

from __future__ import annotations

import math
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ticketloom.llm.common import scratch_path
from ticketloom.llm.tokens import END_ID, vocabulary_path, worker_encoder

#: Ids from here on are nonterminals.
VOCABULARY = 1 << 16
#: Mean text bytes of a shard, one task's share with a grammar of its own.
SHARD_BYTES = 8 << 20
#: Text bytes from which a shard is cut into blocks: what a task holds at a time. A shard gets
#: so large only where many rows share a doc_id.
BLOCK_BYTES = 24 << 20
#: Occurrences from which a pair pays for its rule.
MIN_COUNT = 32
#: Rows tokenized at a time.
STEP_ROWS = 256
MAGIC = b"RPR1"
#: Hash slots in which pairs are counted.
SLOT_BITS = 20


def _odd(s: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which of these places hold a pair of one symbol at an odd distance from the start of its run.

    The places hold all of a run or none of it, so its places follow each other.
    """
    same = np.flatnonzero(s[at] == s[at + 1])
    if len(same):
        i = np.arange(len(same))
        begin = np.maximum.accumulate(np.where(np.diff(at[same], prepend=-2) != 1, i, 0))
        same = same[(i - begin) % 2 == 1]
    return same


class _Pairs:
    """The pairs at some places, counted in hash slots.

    Each slot stands for one of its codes; codes of other pairs in a slot are ``late``: they
    are counted apart, and wait for a round in which the slot is theirs.
    """

    def __init__(self, s: np.ndarray, at: np.ndarray, least: int):
        at = np.delete(at, _odd(s, at))
        code = (s[at].astype(np.uint64) << np.uint64(32)) | s[at + 1]
        slot = ((code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        busy = np.bincount(slot, minlength=1 << SLOT_BITS)[slot] >= least
        self.at, self.code, self.slot = at[busy], code[busy], slot[busy]
        held = np.zeros(1 << SLOT_BITS, np.uint64)
        held[self.slot] = self.code
        mine = held[self.slot] == self.code
        n = np.bincount(self.slot[mine], minlength=1 << SLOT_BITS)
        slots = np.flatnonzero(n >= least)
        self.value, self.n = held[slots], n[slots]
        late, m = np.unique(self.code[~mine], return_counts=True)
        self.late = late[m >= least]
        if not len(slots):
            self.value, self.n, self.late = self.late, m[m >= least], np.zeros(0, np.uint64)

    def places(self, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where these pairs stand, and which of them each is."""
        table = np.full(1 << SLOT_BITS, -1, np.int32)
        table[((pairs * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)] = np.arange(len(pairs))
        k = table[self.slot]
        hit = np.flatnonzero(k >= 0)
        hit = hit[pairs[k[hit]] == self.code[hit]]
        return self.at[hit], k[hit]


def _chosen(value: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Which pairs to replace together: the most frequent ones of which no two can overlap."""
    left, right, out = set(), set(), np.zeros(len(value), bool)
    order = np.lexsort((value, -n))
    for k, a, b in zip(order.tolist(), (value[order] >> np.uint64(32)).tolist(), (value[order] & np.uint64(0xFFFFFFFF)).tolist()):
        if a in right or b in left or a == b and (a in left or b in right):
            continue
        left.add(a)
        right.add(b)
        out[k] = True
    return out


def repair(ids: np.ndarray, end: int = END_ID, least: int = MIN_COUNT) -> tuple[np.ndarray, np.ndarray]:
    """Symbols and rules (one pair of symbols each) of a block of ids, until no pair occurs ``least`` times.

    After the first round only pairs with a symbol of the last round are counted anew, and
    pairs that were frequent but overlapped a chosen one.
    """
    s, rules, new = ids.astype(np.uint32), [], 0
    waiting = np.zeros(0, np.uint64)
    while len(s) > 1:
        touched = s[:-1] != end
        if new:
            fresh = s >= new
            near = fresh[:-1] | fresh[1:]
            if len(waiting):
                first, second = np.zeros(VOCABULARY + len(rules), bool), np.zeros(VOCABULARY + len(rules), bool)
                first[(waiting >> np.uint64(32)).astype(np.int64)] = True
                second[(waiting & np.uint64(0xFFFFFFFF)).astype(np.int64)] = True
                near |= first[s[:-1]] & second[s[1:]]
            touched &= near
        found = _Pairs(s, np.flatnonzero(touched), least)
        if not len(found.value):
            break
        pick = _chosen(found.value, found.n)
        pairs, waiting = found.value[pick], np.concatenate((found.value[~pick], found.late))
        at, k = found.places(pairs)
        new = VOCABULARY + len(rules)
        s[at] = new + k
        keep = np.ones(len(s), bool)
        keep[at + 1] = False
        s = s[keep]
        rules += zip((pairs >> np.uint64(32)).tolist(), (pairs & np.uint64(0xFFFFFFFF)).tolist())
    return s, np.array(rules, np.uint32).reshape(-1, 2)


def expansion_lengths(rules: np.ndarray) -> np.ndarray:
    """Ids in the expansion of each rule; a rule names earlier rules only."""
    out = np.zeros(len(rules), np.int64)
    for r, (a, b) in enumerate(rules.tolist()):
        out[r] = (out[a - VOCABULARY] if a >= VOCABULARY else 1) + (out[b - VOCABULARY] if b >= VOCABULARY else 1)
    return out


def write_block(ids: np.ndarray, lengths: np.ndarray, end: int = END_ID) -> bytes:
    """The file of one block: ``lengths`` are the documents' numbers of ids."""
    symbols, rules = repair(ids, end)
    size = expansion_lengths(rules)
    each = np.ones(len(symbols), np.int64)
    big = symbols >= VOCABULARY
    each[big] = size[symbols[big] - VOCABULARY]
    first_id = np.concatenate(([0], np.cumsum(lengths)))
    first_symbol = np.searchsorted(np.concatenate(([0], np.cumsum(each))), first_id)
    return b"".join((
        MAGIC, struct.pack("<III", len(lengths), len(rules), len(symbols)), rules.astype("<u4").tobytes(),
        size.astype("<u4").tobytes(), first_symbol.astype("<u8").tobytes(), first_id.astype("<u8").tobytes(),
        zlib.compress(symbols.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1)))


class Block:
    """A block's file, decoded whole, by document or by any stretch of ids."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("no Re-Pair block")
        docs, rules, n = struct.unpack_from("<III", data, 4)
        at = 16
        self.rules = np.frombuffer(data, "<u4", 2 * rules, at).reshape(-1, 2)
        self.size = np.frombuffer(data, "<u4", rules, at := at + 8 * rules).astype(np.int64)
        self.first_symbol = np.frombuffer(data, "<u8", docs + 1, at := at + 4 * rules).astype(np.int64)
        self.first_id = np.frombuffer(data, "<u8", docs + 1, at := at + 8 * (docs + 1)).astype(np.int64)
        planes = np.frombuffer(zlib.decompress(data[at + 8 * (docs + 1):]), np.uint8).reshape(4, n)
        self.symbols = np.ascontiguousarray(planes.T).view("<u4").ravel()
        parts: list[np.ndarray] = []
        for a, b in self.rules.tolist():
            parts.append(np.concatenate([parts[x - VOCABULARY] if x >= VOCABULARY else np.array([x], np.uint32)
                                         for x in (a, b)]))
        self.flat = np.concatenate([np.arange(VOCABULARY, dtype=np.uint32), *parts])
        self.starts = np.concatenate((np.arange(VOCABULARY), VOCABULARY + np.cumsum(self.size) - self.size))
        self.lengths = np.concatenate((np.ones(VOCABULARY, np.int64), self.size))

    def _expand(self, symbols: np.ndarray) -> np.ndarray:
        n = self.lengths[symbols]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        return self.flat[np.arange(total) + np.repeat(self.starts[symbols] - (ends - n), n)]

    def ids(self) -> np.ndarray:
        return self._expand(self.symbols)

    def document(self, k: int) -> np.ndarray:
        return self._expand(self.symbols[self.first_symbol[k]:self.first_symbol[k + 1]])

    def stretch(self, k: int, start: int, stop: int) -> np.ndarray:
        """Ids start to stop of document k, expanding only the symbols they need."""
        s = self.symbols[self.first_symbol[k]:self.first_symbol[k + 1]]
        edges = np.concatenate(([0], np.cumsum(self.lengths[s])))
        a = max(int(np.searchsorted(edges, start, "right")) - 1, 0)
        b = int(np.searchsorted(edges, stop, "left"))
        return self._expand(s[a:b])[start - edges[a]:stop - edges[a]]


_BLOCK = "shard int, block int, docs binary, n_tokens bigint, file binary"
_BLOCK_SCHEMA = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("docs", pa.binary()),
                           ("n_tokens", pa.int64()), ("file", pa.binary())])
_NO_ID = -(1 << 63)


def _compressor(path: str | None, block_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder = worker_encoder(path or vocabulary_path())
        shard, block = TaskContext.get().partitionId(), 0
        keys: list[int] = []
        texts: list[str | None] = []
        held = 0

        def flush() -> pa.RecordBatch:
            parts = [encoder.encode(texts[k:k + STEP_ROWS]) for k in range(0, len(texts), STEP_ROWS)]
            ids, lengths = (np.concatenate(x) for x in zip(*parts))
            return pa.RecordBatch.from_pydict({
                "shard": [shard], "block": [block], "docs": [np.array(keys, "<i8").tobytes()],
                "n_tokens": [len(ids)], "file": [write_block(ids, lengths)]}, schema=_BLOCK_SCHEMA)

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                t = text.as_py()
                keys.append(_NO_ID if key is None else key)
                texts.append(t)
                held += len(t or "") + 64
                if held >= block_bytes:
                    yield flush()
                    block, held, keys, texts = block + 1, 0, [], []
        if keys:
            yield flush()

    return run


def write_token_files(docs: DataFrame, path: str, vocabulary: str | None = None,
                      block_bytes: int = BLOCK_BYTES, shard_bytes: int = SHARD_BYTES) -> None:
    """Encode all documents and write their files, ascending by doc_id over shards and blocks."""
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    ordered = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").repartitionByRange(
        max(1, math.ceil(total / shard_bytes)), "doc_id").sortWithinPartitions("doc_id")
    ordered.mapInArrow(_compressor(vocabulary, block_bytes), _BLOCK).write.parquet(path)


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start, docs, data in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
            b = Block(data.as_py())
            ids = b.ids().astype("<u4")
            edges = b.first_id
            yield pa.RecordBatch.from_arrays([
                pa.array([None if k == _NO_ID else k for k in np.frombuffer(docs.as_py(), "<i8").tolist()], pa.int64()),
                pa.array(start + edges[:-1], pa.int64()), pa.array(np.diff(edges), pa.int64()),
                pa.array([zlib.crc32(ids[x:y]) for x, y in zip(edges[:-1], edges[1:])], pa.int64()),
            ], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def read_starts(spark: SparkSession, path: str) -> DataFrame:
    """Blocks of the files with ``start``, the ids of all blocks before; sums run by shard, then in it."""
    blocks = spark.read.parquet(path)
    before = (Window.unboundedPreceding, -1)
    shards = blocks.groupBy("shard").agg(F.sum("n_tokens").alias("n")).select(
        "shard", F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(*before)), F.lit(0)).alias("base"))
    sizes = blocks.select("shard", "block", "n_tokens").join(shards, "shard").select(
        "shard", "block", (F.col("base") + F.coalesce(F.sum("n_tokens").over(
            Window.partitionBy("shard").orderBy("block").rowsBetween(*before)), F.lit(0))).alias("start"))
    return blocks.join(sizes, ["shard", "block"])


def token_digest(docs: DataFrame) -> DataFrame:
    """Write the files, read them back, and describe each document's ids."""
    path = scratch_path(docs.sparkSession, "token-files")
    write_token_files(docs, path)
    return read_starts(docs.sparkSession, path).select("start", "docs", "file").mapInArrow(
        _decoded, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
