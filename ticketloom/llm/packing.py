"""Hierarchical packing into windows of several lengths.

A document longer than the longest window fills whole windows with its head; what is
left is routed to the tier of the shortest window that holds it. Tiers are packed from
the longest down: each document opens a window of its tier, and the gap behind it is
filled from shorter tiers, longest fitting document first; where none fits, one is cut
to size and its rest goes back to the pool. So windows are full, and a full window of
any tier is a power of two. What remains at the end of a group (less than one window)
becomes full windows of falling powers of two and one last padded sequence.

Windows are dealt over training steps so that every step gets its share of every tier.

Documents are dealt into groups of bounded size by a hash of id and text; a group is packed
in one task with bounded memory, and costs at most one padded sequence. A group that grows
too large because many rows are equal is packed part by part.

Null text is empty and still has its end id. Equal rows, and rows of equal or null doc_id,
are packed each on their own. Very long texts are cut like others. Only doc_id and text are
read, so other names cannot clash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ticketloom.llm.tokens import vocabulary_path, worker_encoder

#: Window lengths, longest first; all are powers of two.
TIERS = (4096, 2048, 1024, 512)
#: Mean text bytes of a group.
GROUP_BYTES = 8 << 20
#: Ids from which a group is packed in parts, and rows tokenized at a time.
PART_IDS = 12 << 20
STEP_ROWS = 256
#: Tokens of a training step.
STEP_TOKENS = 64 * 4096
#: The remainder of a group is cut to powers of two down to this one.
LEAST_WINDOW = 64
SEED = 4


class _Pool:
    """Documents' rests by length: the longest that fits, or the shortest, in a step."""

    def __init__(self, longest: int):
        self.by_length: list[list[tuple[int, int]]] = [[] for _ in range(longest + 1)]
        self.filled = 0

    def add(self, length: int, doc: int, start: int) -> None:
        self.by_length[length].append((doc, start))
        self.filled |= 1 << length

    def take(self, length: int) -> tuple[int, int]:
        got = self.by_length[length].pop()
        if not self.by_length[length]:
            self.filled ^= 1 << length
        return got

    def longest(self, most: int) -> int:
        """Length of the longest rest of at most so many ids; 0 if there is none."""
        return max((self.filled & ((1 << (most + 1)) - 1)).bit_length() - 1, 0)

    def shortest(self) -> int:
        return (self.filled & -self.filled).bit_length() - 1 if self.filled else 0


def pack(lengths: list[int], tiers: tuple[int, ...] = TIERS) -> list[tuple[int, list[tuple[int, int, int]]]]:
    """Windows (length, [(document, start, ids), ...]) that hold every id of the documents once."""
    top, pool, out = tiers[0], _Pool(tiers[0]), []
    for doc in reversed(range(len(lengths))):
        n, start = lengths[doc], 0
        while n - start >= top:
            out.append((top, [(doc, start, top)]))
            start += top
        if n > start:
            pool.add(n - start, doc, start)

    def fill(room: int) -> list[tuple[int, int, int]]:
        pieces = []
        while room and pool.filled:
            n = pool.longest(room)
            if n:
                doc, start = pool.take(n)
            else:
                doc, start = pool.take(whole := pool.shortest())
                n = room
                pool.add(whole - n, doc, start + n)
            pieces.append((doc, start, n))
            room -= n
        return pieces

    total = sum(lengths) - sum(w for w, _ in out)
    for k, tier in enumerate(tiers):
        least = tiers[k + 1] if k + 1 < len(tiers) else 0
        while total >= tier and (n := pool.longest(tier)) > least:
            out.append((tier, fill(tier)))
            total -= tier
    tier = top
    while total:
        while tier > total and tier > LEAST_WINDOW:
            tier //= 2
        if total < tier:
            tier = top
        got = fill(min(tier, total))
        out.append((tier, got))
        total -= sum(n for _, _, n in got)
    return out


def steps_of(windows: list[int], step_tokens: int = STEP_TOKENS) -> list[int]:
    """The training step of each window: every tier is spread evenly over the steps."""
    steps = max(1, round(sum(windows) / step_tokens))
    seen: dict[int, int] = {}
    each = {w: windows.count(w) for w in set(windows)}
    out = []
    for w in windows:
        i = seen.get(w, 0)
        seen[w] = i + 1
        out.append(i * steps // each[w])
    return out


_FIELDS = pa.schema([
    ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()),
    ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("window", pa.int32()),
    ("step", pa.int64())])
PIECES = ("doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, "
          "offset bigint, window int, step bigint")
#: Pieces in an Arrow batch.
_BATCH = 4096


def _packer(vocabulary: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(vocabulary or vocabulary_path())

        def flush(group, first, keys, parts, lengths):
            ids = np.concatenate(parts).astype("<u4")
            n = np.concatenate(lengths)
            edge = np.cumsum(n) - n
            windows = pack(n.tolist())
            step = steps_of([w for w, _ in windows])
            rows: list[tuple] = []
            for s, (window, pieces) in enumerate(windows):
                at = 0
                for doc, start, length in pieces:
                    a = edge[doc] + start
                    rows.append((keys[doc], start, length, ids[a:a + length].tobytes(), int(n[doc]),
                                 (group << 32) | (first + s), at, window, (group << 32) | (first + step[s])))
                    at += length
                if len(rows) >= _BATCH:
                    yield _batch(rows)
                    rows = []
            if rows:
                yield _batch(rows)
            return first + len(windows)

        group, keys, parts, lengths, first, held = None, [], [], [], 0, 0
        for batch in batches:
            groups = batch.column(0).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(np.diff(groups)) + 1).tolist(), len(groups)]
            for a, b in zip(cuts[:-1], cuts[1:]):
                if b == a:
                    continue
                if group is not None and (groups[a] != group or held >= PART_IDS):
                    first = yield from flush(group, first, keys, parts, lengths)
                    first = first if groups[a] == group else 0
                    keys, parts, lengths, held = [], [], [], 0
                group = int(groups[a])
                keys += batch.column(1).slice(a, b - a).to_pylist()
                for c in range(a, b, STEP_ROWS):
                    ids, n = encoder.encode(batch.column(2).slice(c, min(STEP_ROWS, b - c)).to_pylist())
                    parts.append(ids)
                    lengths.append(n)
                    held += len(ids)
        if keys:
            yield from flush(group, first, keys, parts, lengths)

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _FIELDS)], schema=_FIELDS)


def packed(docs: DataFrame, vocabulary: str | None = None, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """One row per piece with its ids (little-endian unsigned 32-bit) and its place."""
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    groups = max(1, math.ceil(total / group_bytes))
    dealt = docs.select(
        F.pmod(F.xxhash64(F.lit(SEED), "doc_id", "text"), F.lit(groups)).cast("int").alias("group"),
        F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    # two groups to a task, none by chance
    return dealt.repartitionById(max(1, math.ceil(groups / 2)), F.expr("group div 2").cast("int")).sortWithinPartitions(
        "group", "doc_id", "text").mapInArrow(_packer(vocabulary), PIECES)


def pack_digest(docs: DataFrame) -> DataFrame:
    """One row per piece, its ids as a checksum."""
    return packed(docs).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
                               "sequence_id", "offset", "window", "step")
