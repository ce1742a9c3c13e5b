"""Best-fit packing by bin completion: as few sequences of bounded length as possible.

A document longer than a sequence is cut into full sequences and one shorter piece, its
first. Pieces are then packed by a branch-and-bound search that decides one sequence at a
time: it takes the longest piece left and enumerates what may stand beside it. Only
undominated fillings count: one is dominated if a piece left out could take the place of
some of its pieces without overflow. They are tried in order of their waste.

Bounds: a solution of n sequences may waste n * capacity less all ids; a branch is left
when its waste is above that of the best solution known less one sequence. The first
solution known (the incumbent) is best-fit decreasing, and each branch given up is completed
by best fit, which may give a better one. The search ends when a solution meets the lower
bound (pieces above half a sequence never share one, and what does not fit into their gaps
needs sequences of its own), or after a bounded number of decisions; then the best
solution found stands. That limits the search, never the rows: every solution holds all.

Work at scale: tasks tokenize where the texts are; only ids go into the shuffle. Documents
are dealt by hash of the row into groups of bounded size. A group is packed in one task, and
its least filled sequences climb: those of 64 groups are packed again together, until one
group is left. So what grouping costs does not grow with the number of groups.

Null text is empty: the end id alone. Equal rows, rows of equal or null doc_id are packed
each on their own; a group that grows too large because many rows are equal is packed part
by part. An empty table gives no pieces. Very long texts become pieces while they are
tokenized. Only doc_id and text are read, so other names cannot clash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ticketloom.llm.byte_tokens import worker_chunks
from ticketloom.llm.common import scratch_path, written

CAPACITY = 2048
#: Mean text bytes of a group, and the ids from which a group is packed in parts.
GROUP_BYTES = 16 << 20
PART_IDS = 24 << 20
#: Text bytes tokenized at a time.
STEP_BYTES = 2 << 20
#: Decisions of the search, besides one for each sequence; a completion by best fit counts as four.
NODES = 240
#: Fillings kept at a decision, those without waste among them, and places looked at for them.
FILLINGS = 6
PERFECT = 2
PROBES = 128
#: Groups packed together in the next round, and the filling up to which a sequence climbs.
CLIMB = 64
SEED = 12


class Pieces:
    """A multiset of lengths: counts, and the lengths present as bits of one number."""

    def __init__(self, lengths: list[int], capacity: int):
        self.count = np.bincount(np.array(lengths, np.int64), minlength=capacity + 1).tolist()
        self.present = sum(1 << n for n in range(capacity + 1) if self.count[n])

    def take(self, n: int) -> None:
        self.count[n] -= 1
        if not self.count[n]:
            self.present ^= 1 << n

    def put(self, n: int) -> None:
        if not self.count[n]:
            self.present |= 1 << n
        self.count[n] += 1

    def longest(self, most: int) -> int:
        """The longest length of at most ``most``; 0 if there is none."""
        return (self.present & ((1 << (most + 1)) - 1)).bit_length() - 1 if most > 0 and self.present & ((1 << (most + 1)) - 1) else 0

    def items(self) -> list[int]:
        return [n for n in range(len(self.count) - 1, 0, -1) for _ in range(self.count[n])]


def best_fit(items: list[int], capacity: int) -> list[list[int]]:
    """Each length, longest first, into the fullest sequence that still has room for it."""
    gaps: list[list[list[int]]] = [[] for _ in range(capacity + 1)]
    open_, out = 0, []
    for n in items:
        fits = open_ >> n
        if fits:
            gap = n + (fits & -fits).bit_length() - 1
            mine = gaps[gap].pop()
            if not gaps[gap]:
                open_ ^= 1 << gap
        else:
            gap, mine = capacity, []
            out.append(mine)
        mine.append(n)
        rest = gap - n
        if rest:
            if not gaps[rest]:
                open_ |= 1 << rest
            gaps[rest].append(mine)
    return out


def lower_bound(items: list[int], capacity: int) -> int:
    """Sequences that any packing needs (Martello and Toth's second bound)."""
    n = np.bincount(np.array(items, np.int64), minlength=capacity + 1)[:capacity + 1]
    total = n * np.arange(capacity + 1)
    count, ids = np.concatenate(([0], np.cumsum(n))), np.concatenate(([0], np.cumsum(total)))
    half = capacity // 2
    k = np.arange(half + 1)
    large = count[-1] - count[capacity - k + 1]
    middle = count[capacity - k + 1] - count[half + 1]
    room = middle * capacity - (ids[capacity - k + 1] - ids[half + 1])
    small = ids[half + 1] - ids[k]
    return int(np.max(large + middle + np.maximum(0, -(-(small - room) // capacity)), initial=0))


def _dominated(chosen: list[int], waste: int, left: Pieces) -> bool:
    """Whether a piece left out could replace some of the chosen without overflow."""
    sums = {0: 0}
    for n in chosen:
        for s, m in list(sums.items()):
            sums[s + n] = max(sums.get(s + n, 0), m + 1)
    for s, m in sums.items():
        # one piece in the place of one: it must be longer; of several: it may be as long
        low = s + (m < 2)
        if m and (left.present >> low) & ((1 << (s + waste - low + 1)) - 1):
            return True
    return not chosen and left.longest(waste) > 0


def fillings(room: int, left: Pieces, slack: int) -> list[tuple[int, list[int]]]:
    """(waste, lengths) of undominated fillings of the room beside the longest piece, least waste first."""
    n = left.longest(room)
    if not n:
        return [(room, [])] if room <= slack else []
    if n == room:
        return [(0, [n])]  # dominates every other
    found: list[tuple[int, list[int]]] = []
    probes, perfect = PROBES, 0

    def scan(chosen: list[int], rest: int, top: int, more: int) -> None:
        """Fillings of ``more`` further pieces, none longer than ``top``."""
        nonlocal probes, perfect
        n = left.longest(min(rest, top))
        while n and probes > 0 and perfect < PERFECT and n * more >= rest - slack:
            probes -= 1
            left.take(n)
            chosen.append(n)
            if more > 1:
                scan(chosen, rest - n, n, more - 1)
            elif rest - n <= slack and not _dominated(chosen, rest - n, left):
                found.append((rest - n, chosen.copy()))
                perfect += rest == n
            chosen.pop()
            left.put(n)
            if more == 1:
                return  # a shorter last piece is dominated by this one
            n = left.longest(n - 1)

    for more in range(1, room + 1):
        scan([], room, room, more)
        if probes <= 0 or perfect or _sum_of_shortest(left, more + 1) > room:
            break
    if not found:  # every probe went by: the longest that fit, one after the other
        chosen, rest = [], room
        while n := left.longest(rest):
            left.take(n)
            chosen.append(n)
            rest -= n
        for n in chosen:
            left.put(n)
        if rest <= slack:
            found.append((rest, chosen))
    found.sort(key=lambda x: x[0])
    return found[:FILLINGS]


def _sum_of_shortest(left: Pieces, m: int) -> int:
    """Ids of the m shortest pieces; more than any room if there are not so many."""
    bits, total = left.present, 0
    while m and bits:
        n = (bits & -bits).bit_length() - 1
        k = min(m, left.count[n])
        total, m = total + k * n, m - k
        bits &= bits - 1
    return total if not m else 1 << 60


def complete(lengths: list[int], capacity: int = CAPACITY, nodes: int = NODES) -> list[list[int]]:
    """The lengths (1 to capacity) in as few sequences as the search finds."""
    if not lengths:
        return []
    left = Pieces(lengths, capacity)
    best = best_fit(left.items(), capacity)
    bound, total, budget = lower_bound(lengths, capacity), sum(lengths), len(best) + nodes
    goal = len(best)  # the search itself must match the incumbent, then beat it
    path: list[tuple[int, list[int], list[tuple[int, list[int]]]]] = []
    wasted, found = 0, False

    def undo() -> None:
        nonlocal wasted
        waste, filling, _ = path[-1]
        wasted -= waste
        for n in filling:
            left.put(n)

    while goal >= bound:
        slack = goal * capacity - total - wasted
        longest = left.longest(capacity)
        if not longest:
            best, found, goal = [f for _, f, _ in path], True, len(path) - 1
            if goal < bound:
                break
            slack, choices = -1, []
        else:
            left.take(longest)
            choices = [(w, [longest, *f]) for w, f in fillings(capacity - longest, left, slack)]
            left.put(longest)
            budget -= 1
            if not choices:  # given up: completed by best fit
                budget -= 3
                rest = best_fit(left.items(), capacity)
                if len(path) + len(rest) < len(best) + (not found):
                    best, found, goal = [f for _, f, _ in path] + rest, True, len(path) + len(rest) - 1
        if choices:
            path.append((0, [], choices[::-1]))
        while path:  # the next filling of the deepest decision that has one within the waste allowed
            undo()
            choices = path[-1][2]
            if choices and choices[-1][0] <= goal * capacity - total - wasted and (budget > 0 or not path[-1][1]):
                waste, filling = choices.pop()
                for n in filling:
                    left.take(n)
                wasted += waste
                path[-1] = (waste, filling, choices)
                break
            path.pop()
        if not path:
            break
    return best


_PIECES = pa.schema([("group", pa.int64()), ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()),
                     ("length", pa.int64()), ("ids", pa.binary())])
PIECES = "group bigint, doc_id bigint, piece int, start bigint, length bigint, ids binary"
PACKED = PIECES + ", sequence_id bigint, offset bigint, filled bigint"


def _offsets(lengths: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(lengths)))


def _binary(ids: np.ndarray, edges: np.ndarray) -> pa.Array:
    """One binary value per stretch of ids."""
    return pa.Array.from_buffers(pa.binary(), len(edges) - 1, [
        None, pa.py_buffer((ids.itemsize * edges).astype(np.int32)), pa.py_buffer(ids)])


def _wide(rows: pa.Table) -> pa.Table:
    """Ids of 16 bits, as they travel, to 32."""
    ids = rows.column("ids").combine_chunks()
    edges = np.frombuffer(ids.buffers()[1], np.int32, len(ids) + 1, 4 * ids.offset).astype(np.int64) // 2
    flat = np.frombuffer(ids.buffers()[2], "<u2")[edges[0]:edges[-1]].astype("<u4")
    return rows.set_column(rows.column_names.index("ids"), "ids", _binary(flat, edges - edges[0]))


def _cutter(path: str | None, capacity: int):
    """group, doc_id, text in; pieces with their ids (little-endian unsigned 16-bit) out."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_chunks(path)
        for batch in batches:
            part = np.cumsum(batch.column(3).to_numpy(zero_copy_only=False)) // STEP_BYTES
            cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
            for a, b in zip(cuts[:-1], cuts[1:]):
                if b == a:
                    continue
                ids, n = encoder.encode(batch.column(2).slice(a, b - a).to_pylist())
                pieces = -(-n // capacity)
                doc = np.repeat(np.arange(b - a), pieces)
                piece = np.arange(len(doc)) - np.repeat(_offsets(pieces)[:-1], pieces)
                first = (n - 1) % capacity + 1
                length = np.where(piece == 0, first[doc], capacity)
                start = np.where(piece == 0, 0, first[doc] + (piece - 1) * capacity)
                at = pa.array(doc)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(a, b - a).take(at), batch.column(1).slice(a, b - a).take(at), pa.array(piece, pa.int32()),
                    pa.array(start), pa.array(length), _binary(ids.astype("<u2"), _offsets(length))], schema=_PIECES)

    return run


def _packer(capacity: int, part_ids: int, wide: bool):
    """Pieces in order of their group in; the same with sequence and place out, ids of 32 bits."""
    def packed(rows: pa.Table, group: int, first: int) -> tuple[pa.Table, int]:
        length = rows.column("length").to_numpy()
        by = np.argsort(length, kind="stable").tolist()
        at: list[list[int]] = [[] for _ in range(capacity + 1)]
        for k in reversed(by):
            at[length[k]].append(k)
        order, sequence, offset, filled = [], [], [], []
        for s, lengths in enumerate(complete(length.tolist(), capacity)):
            place, full = 0, sum(lengths)
            for n in lengths:
                order.append(at[n].pop())
                sequence.append((group << 32) | (first + s))
                offset.append(place)
                filled.append(full)
                place += n
        rows = (_wide(rows) if wide else rows).take(pa.array(order, pa.int64()))
        for name, values in (("sequence_id", sequence), ("offset", offset), ("filled", filled)):
            rows = rows.append_column(name, pa.array(values, pa.int64()))
        return rows, first + s + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        group, ids, first = None, 0, 0

        def flush():
            nonlocal first
            if held:
                rows, first = packed(pa.Table.from_batches(held), group, first)
                yield from rows.to_batches(max_chunksize=4096)

        for batch in batches:
            groups = batch.column(0).to_numpy(zero_copy_only=False)
            part = np.cumsum(batch.column(4).to_numpy(zero_copy_only=False)) // part_ids
            cuts = [0, *(np.flatnonzero(np.diff(groups) | np.diff(part)) + 1).tolist(), len(groups)]
            for a, b in zip(cuts[:-1], cuts[1:]):
                if b == a:
                    continue
                rows = batch.slice(a, b - a)
                if groups[a] != group or ids >= part_ids:
                    yield from flush()
                    first = first if groups[a] == group else 0
                    held, group, ids = [], int(groups[a]), 0
                held.append(rows)
                ids += int(rows.column(4).to_numpy().sum())
        yield from flush()

    return run


def _in_groups(pieces: DataFrame, groups: int, capacity: int, part_ids: int, wide: bool) -> DataFrame:
    """Groups go to tasks directly, two to a task: no task is dealt more by chance."""
    tasks = max(1, math.ceil(groups / 2))
    return pieces.repartitionById(tasks, F.expr("cast(group div 2 as int)")).sortWithinPartitions(
        "group", "doc_id", "start", "length", F.crc32("ids")).mapInArrow(_packer(capacity, part_ids, wide), PACKED)


def packed(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None, group_bytes: int = GROUP_BYTES,
           part_ids: int = PART_IDS, climb: int = CLIMB) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids, sequence_id, offset, filled.

    ``ids`` are little-endian unsigned 32-bit; ``filled`` is the number of ids in the sequence.
    """
    spark = docs.sparkSession
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint")
    total = docs.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    groups = max(1, math.ceil(total / group_bytes))
    dealt = docs.select(
        F.pmod(F.xxhash64(F.lit(SEED), "doc_id", "text"), F.lit(groups)).alias("group"),
        F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("text"), size.alias("size"))
    pieces = dealt.mapInArrow(_cutter(vocabulary, capacity), PIECES)
    done, level = [], 0
    while True:
        rows = _in_groups(pieces, groups, capacity, part_ids, level == 0)
        if groups == 1:
            done.append(rows.withColumn("level", F.lit(level)))
            break
        rows = written(rows, scratch_path(spark, "packed"))
        climbs = F.col("filled") < capacity - capacity // 16
        done.append(rows.where(~climbs).withColumn("level", F.lit(level)))
        pieces = rows.where(climbs).select(F.expr(f"group div {climb}").alias("group"), *_PIECES.names[1:])
        groups, level = math.ceil(groups / climb), level + 1
    out = done[0]
    for rows in done[1:]:
        out = out.unionByName(rows)
    return out.select("doc_id", "piece", "start", "length", "ids", F.col("sequence_id").bitwiseOR(
        F.shiftleft(F.col("level").cast("bigint"), 58)).alias("sequence_id"), "offset", "filled")


def pack_digest(docs: DataFrame) -> DataFrame:
    """One row per piece, its ids as a checksum."""
    return packed(docs).select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset", "filled")
