"""Removal of byte strings that stand earlier in the corpus, by induced suffix sorting.

Every 100-byte string of the corpus picks one of its 24-byte grams, the one of smallest
hash (the leftmost of equals). Equal strings pick the same gram at the same place, so
suffixes need to meet only where their picked grams are equal: the grams are the sampled
suffixes, and the shards of the suffix order are dealt by them.

1. Picked grams are counted over the corpus. Grams seen once end here.
2. The others are sent with the bytes around them, sorted by gram (Spark's sorter keeps
   the queue on disk where memory ends), and a task takes whole grams, chunk by chunk.
3. In a chunk the suffixes at the grams are sorted by recursive naming: eight-byte blocks
   are named in order, then pairs of names, and so on. From there the order is induced
   leftwards: the suffix one byte further left is the tuple (byte, rank of the suffix
   behind it). The length of the common prefix with the neighbour in the order is
   carried along: one more where the bytes agree, the minimum over what was passed.
   Neighbours with a common prefix of 100 bytes hold the same string; all but the
   earliest in a run are marked.
   Equal surroundings of a gram are collapsed to the earliest before the sort.
4. Grams that stand in very many places do not fill one task: their strings are hashed
   one by one (128 bits), the earliest place is found by a combined minimum, and the
   others are marked by a join. Same marks, other route.
5. A document's marks become its removed bytes.

Documents whose whole text equals an earlier one's are removed at once (if they have a
string at all) and take no part: their strings all stand in the earlier document.

Null text is empty. Texts under 100 bytes lose nothing. Rows that share a doc_id are one
document: they do not remove each other, and if their texts differ their marks are
united. A null doc_id comes before all others. Ties go to the smaller doc_id, then the earlier
start. Very long texts are hashed and sorted in stretches. Only doc_id and text are read, so
other columns may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ticketloom.llm.common import scratch_path, small_side, written

LENGTH = 100
GRAM = 24
SPAN = LENGTH - GRAM + 1
#: Places from which a gram's strings take the route of step 4: what a task holds at most.
HOT = 500_000
#: Bytes hashed at a time, and grams sorted at a time.
CHUNK = 1 << 20
SORT_ROWS = 30_000
_NULL = -(1 << 63)
_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _M2
    x = (x ^ (x >> np.uint64(29))) * _M3
    return x ^ (x >> np.uint64(32))


def _blocks(data: np.ndarray, dtype: str = "<u8") -> np.ndarray:
    """The eight bytes from each place on, as a number."""
    return np.ndarray((len(data) - 7,), dtype, data.tobytes(), strides=(1,)).copy()


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    w = _blocks(data)
    n = len(data) - GRAM + 1
    h = _mix(w[:n] * _M1 + np.uint64(1))
    h = _mix(h + w[8:8 + n])
    return _mix(h * _M1 + w[16:16 + n])


def picked_grams(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """hash, place, first and last start of the strings that pick each gram of one stretch of bytes."""
    h = _gram_hashes(data)
    m = len(data) - LENGTH + 1
    v = (h & ~np.uint64(0x1FFFFF)) | np.arange(len(h), dtype=np.uint64)
    padded = np.full(-(-len(v) // SPAN) * SPAN, ~np.uint64(0))
    padded[:len(v)] = v
    rows = padded.reshape(-1, SPAN)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    place = (np.minimum(behind[:m], ahead[SPAN - 1:SPAN - 1 + m]) & np.uint64(0x1FFFFF)).astype(np.int64)
    cut = np.flatnonzero(np.diff(place)) + 1
    first = np.concatenate(([0], cut))
    last = np.concatenate((cut, [m])) - 1
    at = place[first]
    return h[at], at, first, last


def _document_grams(data: np.ndarray):
    """The picked grams of a document of any length, in stretches that overlap by a string less one byte."""
    for a in range(0, len(data) - LENGTH + 1, CHUNK):
        h, at, first, last = picked_grams(data[a:a + CHUNK + LENGTH - 1])
        yield h, at + a, first + a, last + a


def _bytes(text: str | None) -> bytes:
    return text.encode("utf-8", "surrogatepass") if text else b""


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """gram, doc_id, place: the gram's place, with the distances to its first and last string start."""
    for batch in batches:
        out, held = [], 0
        keys = batch.column(0).to_pylist()

        def flush():
            h, d, p = (np.concatenate(x) for x in zip(*out))
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(d), pa.array(p)], names=["gram", "doc_id", "place"])

        small: list[tuple[int, bytes]] = []

        def together():
            """Short documents are hashed behind each other; strings across their borders are left out."""
            data = np.frombuffer(b"".join(x for _, x in small), np.uint8)
            size = np.array([len(x) for _, x in small])
            end = np.cumsum(size)
            ids = np.array([k for k, _ in small], np.int64)
            h = _gram_hashes(data)
            v = (h & ~np.uint64(0x1FFFFF)) | np.arange(len(h), dtype=np.uint64)
            padded = np.full(-(-len(v) // SPAN) * SPAN, ~np.uint64(0))
            padded[:len(v)] = v
            rows = padded.reshape(-1, SPAN)
            ahead = np.minimum.accumulate(rows, axis=1).ravel()
            behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
            m = len(data) - LENGTH + 1
            place = (np.minimum(behind[:m], ahead[SPAN - 1:SPAN - 1 + m]) & np.uint64(0x1FFFFF)).astype(np.int64)
            doc = np.repeat(np.arange(len(size)), size)
            inside = np.flatnonzero(np.arange(m) + LENGTH <= end[doc[:m]])
            place, doc = place[inside], doc[inside]
            cut = np.flatnonzero((np.diff(place) != 0) | (np.diff(doc) != 0)) + 1
            first = np.concatenate(([0], cut))
            last = np.concatenate((cut, [len(place)])) - 1
            at, d = place[first], doc[first]
            base = (end - size)[d]
            return h[at], ids[d], ((at - base) << 16) | ((at - inside[first]) << 8) | (at - inside[last])

        size = 0
        for key, text in zip(keys, batch.column(1)):
            data = _bytes(text.as_py())
            if len(data) < LENGTH:
                continue
            key = _NULL if key is None else key
            if len(data) > CHUNK // 2:
                for h, at, first, last in _document_grams(np.frombuffer(data, np.uint8)):
                    out.append((h, np.full(len(h), key, np.int64), (at << 16) | ((at - first) << 8) | (at - last)))
                    held += len(h)
            else:
                small.append((key, data))
                size += len(data)
                if size > CHUNK:
                    out.append(together())
                    held += len(out[-1][0])
                    small, size = [], 0
            if held > 200_000:
                yield flush()
                out, held = [], 0
        if small:
            out.append(together())
        if out:
            yield flush()


_PIECE = "hot boolean, a bigint, b bigint, doc_id bigint, place bigint, bytes binary"
_PIECE_SCHEMA = pa.schema([("hot", pa.bool_()), ("a", pa.int64()), ("b", pa.int64()), ("doc_id", pa.int64()),
                           ("place", pa.int64()), ("bytes", pa.binary())])


def _window_hash(data: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128-bit hashes of the strings from the given places on."""
    cols = np.lib.stride_tricks.sliding_window_view(data, LENGTH)[start]
    words = np.zeros((len(start), 104), np.uint8)
    words[:, :LENGTH] = cols
    words = words.view("<u8")
    x, y = np.full(len(start), 7, np.uint64), np.full(len(start), 11, np.uint64)
    for j in range(13):
        x = _mix(x * _M1 + words[:, j])
        y = _mix((y ^ words[:, j]) * _M2 + np.uint64(j))
    return x, y


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes around each repeated gram; for hot grams the hashes of its strings."""
    for batch in batches:
        rows: list[tuple] = []
        for key, text, found in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
            data = _bytes(text.as_py())
            for g in found.as_py():
                at, left, right = g["place"] >> 16, (g["place"] >> 8) & 255, g["place"] & 255
                if at - right + LENGTH > len(data):
                    continue  # a place of another row with this doc_id
                if g["hot"]:
                    part = np.frombuffer(data[at - left:at - right + LENGTH], np.uint8)
                    x, y = _window_hash(part, np.arange(left - right + 1))
                    rows += [(True, a, b, key, at - left + i, None) for i, (a, b) in enumerate(zip(
                        x.view(np.int64).tolist(), y.view(np.int64).tolist()))]
                else:
                    rows.append((False, g["gram"], 0, key, g["place"], data[at - left:at - right + LENGTH]))
            if len(rows) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _PIECE_SCHEMA)], schema=_PIECE_SCHEMA)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _PIECE_SCHEMA)], schema=_PIECE_SCHEMA)


def _named(keys: list[np.ndarray]) -> np.ndarray:
    """Ranks of tuples in their order; equal tuples have equal ranks."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(new)
    return rank


def _range_minimum(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Minimum of values[low:high] for many non-empty ranges, by doubling."""
    width = high - low
    out = np.empty(len(low), values.dtype)
    level, table = 0, values
    top = int(width.max()).bit_length()
    while level < top:
        pick = (width >> level) == 1
        if pick.any():
            out[pick] = np.minimum(table[low[pick]], table[high[pick] - (1 << level)])
        if len(table) > (1 << level):
            table = np.minimum(table[:-(1 << level)], table[1 << level:])
        level += 1
    return out


def induced_marks(group: np.ndarray, doc: np.ndarray, place: np.ndarray, pieces: list[bytes]) -> np.ndarray:
    """Bit matrix: row i, column d is set if the string d bytes before gram i stands earlier.

    ``group`` numbers the grams in sorted order of rows; rows of a group share the gram.
    """
    n = len(group)
    left, right = (place >> 8) & 255, place & 255
    spot = _named([doc, place >> 16])
    tail = np.zeros((n, 128), np.uint8)
    head = np.zeros((n, SPAN), np.uint8)
    for i, p in enumerate(pieces):
        k = left[i]
        t = np.frombuffer(p, np.uint8)
        tail[i, :len(t) - k] = t[k:]
        head[i, :k] = t[:k][::-1]
    # recursive naming of the suffixes at the grams: blocks of 8, 16, 32, 64, 128 bytes
    levels = [tail.view(">u8").astype(np.uint64)]
    levels[0] = np.unique(levels[0], return_inverse=True)[1].reshape(n, 16)
    while levels[-1].shape[1] > 1:
        a, b = levels[-1][:, ::2].ravel(), levels[-1][:, 1::2].ravel()
        levels.append(_named([a, b]).reshape(n, -1))
    order = np.lexsort((levels[-1][:, 0], group))
    # common prefixes of neighbours: down the levels, then byte by byte in the last block
    x, y = order[:-1], order[1:]
    common = np.zeros(n - 1, np.int64)
    for k in range(len(levels) - 1, -1, -1):
        block, col = 8 << k, common // (8 << k)
        live = col < levels[k].shape[1]
        c = np.minimum(col, levels[k].shape[1] - 1)
        common += np.where(live & (levels[k][x, c] == levels[k][y, c]), block, 0)
    for _ in range(7):
        c = np.minimum(common, 127)
        common += (common < 128) & (tail[x, c] == tail[y, c])
    prefix = np.concatenate(([0], common))
    prefix[1:][group[x] != group[y]] = -1
    prefix[0] = -1
    marks = np.zeros((n, SPAN), bool)
    for d in range(SPAN):
        if d:
            # induce one byte to the left: stable by (gram, byte), ranks kept inside
            stay = left[order] >= d
            at = np.flatnonzero(stay)
            if not len(at):
                break
            rows = order[at]
            byte = head[rows, d - 1]
            move = np.argsort((group[rows].astype(np.int64) << 8) | byte, kind="stable")
            new, pos = rows[move], at[move]
            same = np.zeros(len(new), bool)
            same[1:] = (group[new[1:]] == group[new[:-1]]) & (byte[move][1:] == byte[move][:-1])
            low = np.full(len(new), 0, np.int64)
            k = np.flatnonzero(same)
            if len(k):
                low[k] = 1 + _range_minimum(prefix, pos[k - 1] + 1, pos[k] + 1)
            low[~same] = -1
            order, prefix = new, low
        run = np.flatnonzero(prefix < LENGTH)
        active = (left[order] >= d) & (right[order] <= d)
        place_of = np.where(active, spot[order], np.iinfo(np.int64).max)
        first = np.minimum.reduceat(place_of, run)
        number = np.cumsum(prefix < LENGTH) - 1
        marks[order, d] = active & (place_of != first[number])
    return marks


def _alone(gram: np.ndarray, doc: np.ndarray, place: np.ndarray, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The earliest row of each gram with equal bytes around it, and the later rows.

    All strings of a later row stand in the earliest one. Rows of one place (of rows that
    share a doc_id) are given once.
    """
    first: dict[tuple, int] = {}
    shift, spot = ((place >> 8) & 255).tolist(), list(zip(doc.tolist(), (place >> 16).tolist()))
    keys = list(zip(gram.tolist(), shift, pieces))
    for i, k in enumerate(keys):
        j = first.setdefault(k, i)
        if spot[i] < spot[j]:
            first[k] = i
    rest = [i for i, k in enumerate(keys) if spot[i] != spot[first[k]]]
    return np.array(sorted(first.values()), np.int64), np.array(rest, np.int64)


def _sorted_marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by gram; whole grams are taken together, in chunks."""
    held: list[tuple] = []
    size = 0

    def settle(rows):
        gram = np.concatenate([r[0] for r in rows])
        doc, place = (np.concatenate([r[k] for r in rows]) for k in (1, 2))
        pieces = [p for r in rows for p in r[3]]
        one, rest = _alone(gram, doc, place, pieces)
        group = np.concatenate(([0], np.cumsum(np.diff(gram[one]) != 0)))
        marks = np.zeros((len(gram), SPAN), bool)
        marks[one] = induced_marks(group, doc[one], place[one], [pieces[i] for i in one])
        d = np.arange(SPAN)
        marks[rest] = (d >= (place[rest] & 255)[:, None]) & (d <= ((place[rest] >> 8) & 255)[:, None])
        hit = np.flatnonzero(marks.any(axis=1))
        bits = np.packbits(marks[hit], axis=1)
        return pa.RecordBatch.from_arrays([pa.array(doc[hit]), pa.array(place[hit] >> 16), pa.array(
            [b.tobytes() for b in bits], pa.binary())], names=["doc_id", "at", "marks"])

    for batch in batches:
        if not batch.num_rows:
            continue
        now = (batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy(), batch.column(3).to_pylist())
        held.append(now)
        size += len(now[0])
        if size >= SORT_ROWS:
            gram = np.concatenate([r[0] for r in held])
            cut = int(np.flatnonzero(gram != gram[-1]).max(initial=-1)) + 1
            if cut:
                doc, place = (np.concatenate([r[k] for r in held]) for k in (1, 2))
                pieces = [p for r in held for p in r[3]]
                yield settle([(gram[:cut], doc[:cut], place[:cut], pieces[:cut])])
                held = [(gram[cut:], doc[cut:], place[cut:], pieces[cut:])]
                size = len(gram) - cut
    if size:
        yield settle(held)


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text, marks in zip(batch.column(1), batch.column(2)):
            data = _bytes(text.as_py())
            found = marks.as_py()
            at = np.array([m["at"] for m in found], np.int64)
            bits = np.frombuffer(b"".join(m["marks"] for m in found), np.uint8).reshape(len(found), -1)
            i, d = np.nonzero(np.unpackbits(bits, axis=1)[:, :SPAN])
            start = at[i] - d
            start = start[start + LENGTH <= len(data)]
            step = np.zeros(len(data) + 1, np.int64)
            np.add.at(step, start, 1)
            np.add.at(step, start + LENGTH, -1)
            gone = np.cumsum(step)[:-1] > 0
            spans = int(np.count_nonzero(np.diff(np.concatenate(([False], gone)).astype(np.int8)) == 1))
            rest = np.frombuffer(data, np.uint8)[~gone].tobytes()
            out.append((len(data), int(gone.sum()), spans, hashlib.sha256(rest).hexdigest(), rest))
        cols = list(zip(*out)) or [[]] * 5
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string()), pa.array(cols[4], pa.binary())],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def marked(texts: DataFrame) -> DataFrame:
    """doc_id and list of (at, marks) of the documents that hold earlier strings. ``texts`` has key and text."""
    spark = texts.sparkSession
    grams = texts.mapInArrow(_grams, "gram bigint, doc_id bigint, place bigint")
    often = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("gram", (F.col("n") > HOT).alias("hot"))
    spots = written(grams.join(often, "gram"), scratch_path(spark, "repeated-grams"))
    wanted = spots.groupBy("doc_id").agg(F.collect_list(F.struct("gram", "place", "hot")).alias("found"))
    ids = small_side(spots.select(F.col("doc_id").alias("id")).distinct())
    some = texts.join(ids, texts["key"] == F.col("id"), "left_semi")
    pieces = written(some.join(wanted, some["key"] == wanted["doc_id"]).select("key", "text", "found").mapInArrow(_pieces, _PIECE),
                     scratch_path(spark, "pieces"))
    cold = pieces.where("not hot").select(F.col("a").alias("gram"), "doc_id", "place", "bytes")
    by_sort = cold.repartition("gram").sortWithinPartitions("gram").mapInArrow(_sorted_marks, "doc_id bigint, at bigint, marks binary")
    hot = pieces.where("hot").select("a", "b", "doc_id", "place")
    first = hot.groupBy("a", "b").agg(F.min(F.struct("doc_id", "place")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    by_hash = hot.join(first, ["a", "b"]).where((F.col("doc_id") != F.col("first.doc_id")) | (F.col("place") != F.col("first.place"))).select(
        "doc_id", F.col("place").alias("at"), F.unhex(F.lit("80" + "00" * 9)).alias("marks"))
    return written(by_sort.union(by_hash), scratch_path(spark, "marks"))


def removed(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the bytes left)."""
    spark = docs.sparkSession
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_NULL)).alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    sums = keyed.where(F.octet_length("text") >= LENGTH).select("key", F.sha2("text", 256).alias("sum"))
    first = sums.groupBy("sum").agg(F.min("key").alias("first"), F.max("key").alias("last")).where("first <> last").drop("last")
    copies = written(sums.join(first, "sum").where("key <> first").select(F.col("key").alias("copy"), F.col("sum").alias("copy_sum")).distinct(),
                     scratch_path(spark, "copies"))
    is_copy = (F.col("key") == F.col("copy")) & (F.sha2("text", 256) == F.col("copy_sum"))
    alone = keyed.join(small_side(copies), is_copy, "left_anti")
    marks = marked(alone)
    ids = small_side(written(marks.select(F.col("doc_id").alias("id")).distinct(), scratch_path(spark, "marked")))
    lists = marks.groupBy("doc_id").agg(F.collect_list(F.struct("at", "marks")).alias("marks"))
    hit = alone.join(ids, alone["key"] == F.col("id"), "left_semi")
    changed = hit.join(lists, hit["key"] == lists["doc_id"]).select("key", "text", "marks").mapInArrow(
        _removed, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary")
    size = F.octet_length("text").cast("bigint")
    zero = F.lit(0).cast("bigint")
    plain = alone.join(ids, alone["key"] == F.col("id"), "left_anti").select(
        F.col("key").alias("doc_id"), size.alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"),
        F.sha2("text", 256).alias("kept_sha256"), F.col("text").cast("binary").alias("kept"))
    whole = keyed.join(small_side(copies), is_copy, "left_semi").select(
        F.col("key").alias("doc_id"), size.alias("n_bytes"), size.alias("n_removed"), F.lit(1).cast("bigint").alias("n_spans"),
        F.sha2(F.lit(""), 256).alias("kept_sha256"), F.lit("").cast("binary").alias("kept"))
    return changed.union(plain).union(whole).withColumn("doc_id", F.nullif("doc_id", F.lit(_NULL)))


def suffix_digest(docs: DataFrame) -> DataFrame:
    return removed(docs).drop("kept")
