"""Periodic runs of words, by enumeration of maximal pairs.

A run is a stretch of consecutive words with smallest period q, at least ``least`` words
and two periods long, that no neighbouring word extends. A run from s to e of period q is
the maximal pair of the places s and s + q: the words from both agree for e - s - q places,
the words in front of both differ, and so do the words behind. So runs are found without
any extension of a seed:

1. Words become numbers. A document without a repeated stretch of ``least / 2`` words has no
   run and ends here; the others go on, many documents in one set of arrays.
2. Suffixes are sorted by prefix doubling; a word's rank holds its document, so suffixes of
   different documents never meet. The ranks of all levels give the common prefix of
   neighbours in the order.
3. The tree of LCP intervals is walked bottom-up with a stack, interval by interval of
   common prefixes of at least ``least / 2`` words. An interval keeps its places in text
   order, each with its class, the word on its left. When a child joins, the shorter list
   goes into the longer one, and each new pair of neighbours is looked at: the pair is
   left-maximal if the classes differ, right-maximal because the places come from different
   children. If its distance is at most the interval's common prefix and both together reach
   ``least``, it is a run. Places between the two would be a smaller period of the same
   stretch, so the nearest places of the other child suffice, and of equal stretches the
   smallest period stands.

Work is by document and needs no shuffle. Memory grows with the longest document: 4 bytes a
word for each doubling of its longest repeat.

Null and empty texts have no words and no runs. Ties need no rule: a stretch has one smallest
period. Repeated rows are judged each on its own; a null doc_id is a value like any other.
Other columns are not read, so their names cannot clash.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable, Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Words of the shortest run.
LEAST = 12
#: Text bytes whose words a task holds at a time; a longer text is a step of its own.
STEP_BYTES = 1 << 20
#: Words a task keeps numbers for between steps.
KNOWN_WORDS = 400_000

Rewrite = Callable[[int | None, int], "np.ndarray | None"]


class _Numbers(dict):
    """Word to number; new words are numbered in order."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def _repeats(words: np.ndarray, docs: np.ndarray, size: int) -> np.ndarray:
    """Numbers of the documents in which a stretch of so many words may stand twice."""
    n = len(words) - size + 1
    if n < 2:
        return np.zeros(0, np.int64)
    factor = np.random.default_rng(13).integers(1, 1 << 62, size + 1, np.uint64) * np.uint64(2) + np.uint64(1)
    h = docs[:n].astype(np.uint64) * factor[size]
    for k in range(size):
        h += words[k:k + n].astype(np.uint64) * factor[k]
    inside = docs[:n] == docs[size - 1:]
    h, at = h[inside], docs[:n][inside]
    s = np.sort(h)
    twice = np.unique(s[1:][s[1:] == s[:-1]])
    if not len(twice):
        return np.zeros(0, np.int64)
    k = np.minimum(np.searchsorted(twice, h), len(twice) - 1)
    return np.unique(at[twice[k] == h])


def _suffixes(words: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order by document, and common prefix of each suffix with the one before it."""
    n = len(words)
    order = np.lexsort((words, docs))
    new = np.concatenate(([True], (np.diff(words[order]) != 0) | (np.diff(docs[order]) != 0)))
    rank = np.empty(n + 1, np.int32)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank[n] = -1
    levels, k = [rank], 1
    same = np.flatnonzero(~new)
    active = order[np.union1d(same, same - 1)]
    while len(active):
        rank = levels[-1]
        behind = active + k
        behind = np.where((behind < n) & (docs[np.minimum(behind, n - 1)] == docs[active]), rank[np.minimum(behind, n)], -1)
        old = rank[active]
        by = np.lexsort((behind, old))
        active, behind, old = active[by], behind[by], old[by]
        group = np.concatenate(([True], np.diff(old) != 0))
        new = group | np.concatenate(([True], np.diff(behind) != 0))
        place = np.arange(len(active))
        first = np.maximum.accumulate(np.where(group, place, 0))
        rank = rank.copy()
        rank[active] = old + np.maximum.accumulate(np.where(new, place, 0)) - first
        levels.append(rank)
        same = np.flatnonzero(~new)
        active = active[np.union1d(same, same - 1)]
        k *= 2
    order = np.empty(n, np.int64)
    order[levels[-1][:n]] = np.arange(n)
    a, b, common = order[:-1], order[1:], np.zeros(max(n - 1, 0), np.int64)
    for j in reversed(range(len(levels))):
        common += (levels[j][np.minimum(a + common, n)] == levels[j][np.minimum(b + common, n)]).astype(np.int64) << j
    return order, np.concatenate(([0], common)) if n else common


def _walk(places: list[int], common: list[int], left: list[int], least: int, found: dict[tuple[int, int], int]) -> None:
    """Bottom-up over the LCP intervals of one block of the suffix order; runs go to ``found``."""
    of = dict(zip(places, left))

    def join(a: list[int], b: list[int], size: int) -> list[int]:
        if len(a) < len(b):
            a, b = b, a
        for x in b:
            k = bisect_left(a, x)
            if k < len(a):
                q = a[k] - x
                if q <= size and q + size >= least and of[a[k]] != of[x]:
                    key = (x, a[k] + size)
                    found[key] = min(q, found.get(key, q))
            if k:
                q = x - a[k - 1]
                if q <= size and q + size >= least and of[a[k - 1]] != of[x]:
                    key = (a[k - 1], x + size)
                    found[key] = min(q, found.get(key, q))
        if len(b) < 8:
            for x in b:
                insort(a, x)
        else:
            a += b
            a.sort()  # two ordered stretches: one merge
        return a

    open_: list[tuple[int, list[int]]] = []
    child = [places[0]]
    for place, size in zip(places[1:], common[1:]):
        while open_ and open_[-1][0] >= size:
            at, mine = open_.pop()
            child = join(mine, child, at)
        open_.append((size, child))
        child = [place]
    while open_:
        at, mine = open_.pop()
        child = join(mine, child, at)


def word_runs(documents: list[np.ndarray], least: int = LEAST) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of the runs of each document, given as word numbers."""
    half = (least + 1) // 2
    out: list[list[tuple[int, int, int]]] = [[] for _ in documents]
    sizes = np.array([len(d) for d in documents], np.int64)
    words = np.concatenate([np.zeros(0, np.int64), *documents])
    chosen = _repeats(words, np.repeat(np.arange(len(documents)), sizes), half)
    if not len(chosen):
        return out
    words = np.concatenate([documents[d] for d in chosen])
    first = np.concatenate(([0], np.cumsum(sizes[chosen])))
    docs = np.repeat(np.arange(len(chosen)), sizes[chosen])
    order, common = _suffixes(words, docs)
    start = np.flatnonzero((common < half) & np.append(common[1:] >= half, False))
    end = np.flatnonzero((common >= half) & np.append(common[1:] < half, True)) + 1
    if not len(start):
        return out
    # a block without two places closer than its longest common prefix holds no run
    block = np.repeat(np.arange(len(start)), end - start)
    inside = np.concatenate([np.arange(a, b) for a, b in zip(start, end)])
    by = np.lexsort((order[inside], block))
    gap = np.diff(order[inside][by], prepend=0)
    edge = np.cumsum(end - start) - (end - start)
    gap[edge] = np.iinfo(np.int64).max
    longest = common[inside]
    longest[edge] = 0
    hopeful = np.minimum.reduceat(gap, edge) <= np.maximum.reduceat(longest, edge)
    found: dict[int, dict[tuple[int, int], int]] = {}
    for a, b in zip(start[hopeful], end[hopeful]):
        at = order[a:b]
        d = int(docs[at[0]])
        place = at - first[d]
        left = np.where(place > 0, words[np.maximum(at - 1, 0)], -1)
        _walk(place.tolist(), common[a:b].tolist(), left.tolist(), least, found.setdefault(d, {}))
    for d, runs in found.items():
        out[chosen[d]] = sorted((s, e - s, q) for (s, e), q in runs.items())
    return out


def _kept(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Words that no run holds behind its first period."""
    step = np.zeros(n + 1, np.int64)
    for s, length, q in runs:
        step[s + q] += 1
        step[s + length] -= 1
    return np.cumsum(step[:n]) == 0


RUNS = "doc_id bigint, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed binary"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _finder(least: int, rewrite: Rewrite | None):
    def step(keys: list[int | None], texts: list[str | None], numbers: _Numbers) -> pa.RecordBatch:
        words, ids = [], []
        for key, text in zip(keys, texts):
            ws = text.encode("utf-8", "surrogatepass").split() if text else []
            n = np.fromiter(map(numbers.__getitem__, ws), np.int64, len(ws))
            order = rewrite(key, len(ws)) if rewrite and ws else None
            if order is not None:
                ws, n = [ws[k] for k in order.tolist()], n[order]
            words.append(ws)
            ids.append(n)
        if len(numbers) > KNOWN_WORDS:
            numbers.clear()
        runs = word_runs(ids, least)
        texts_out = [b" ".join(compress(ws, _kept(len(ws), r).tolist()) if r else ws) for ws, r in zip(words, runs)]
        flat = [x for r in runs for x in r]
        fields = [pa.array([x[k] for x in flat], pa.int64()) for k in range(3)]
        offsets = pa.array(np.concatenate(([0], np.cumsum([len(r) for r in runs]))), pa.int32())
        return pa.RecordBatch.from_arrays([
            pa.array(keys, pa.int64()), pa.array([len(ws) for ws in words], pa.int64()),
            pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(fields, fields=list(_RUN))),
            pa.array(texts_out, pa.binary())], names=["doc_id", "n_words", "runs", "collapsed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = _Numbers()
        for batch in batches:
            size = batch.column(2).to_numpy(zero_copy_only=False)
            part = np.cumsum(size) // STEP_BYTES
            cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(size)]
            for a, b in zip(cuts[:-1], cuts[1:]):
                if b > a:
                    yield step(batch.column(0).slice(a, b - a).to_pylist(), batch.column(1).slice(a, b - a).to_pylist(), numbers)

    return run


def collapsed(docs: DataFrame, least: int = LEAST, rewrite: Rewrite | None = None) -> DataFrame:
    """Rows doc_id, n_words, runs, collapsed: the words outside of repeated periods, joined by a space.

    ``rewrite`` may give an order of word numbers to take in the place of a document's own.
    """
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", size.alias("size"))
    return rows.mapInArrow(_finder(least, rewrite), RUNS).withColumn("collapsed", F.decode("collapsed", "UTF-8"))


def planted(key: int | None, n: int) -> np.ndarray | None:
    """The word order of the check: every tenth document by checksum gets a periodic end."""
    import zlib

    if key is None:
        return None
    g, last = divmod(zlib.crc32(str(key).encode()), 10)
    if last:
        return None
    a = g % n
    order = np.arange(n)
    order[a:] = a + (order[a:] - a) % (1 + (n - a) // (3 + g % 8))
    return order


def run_digest(docs: DataFrame) -> DataFrame:
    """One row per document: its longest run, and checksums of all runs and of what is kept."""
    longest = F.reduce("runs", F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>"),
                       lambda best, r: F.when(best.isNull() | (r["length"] > best["length"]), r).otherwise(best))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    return collapsed(docs, rewrite=planted).select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), longest.alias("r"), "runs", "collapsed", "n_words").select(
        "doc_id", "n_runs", "r.start", "r.length", "r.period",
        F.floor(1000 * F.col("r.length") / F.col("r.period")).cast("bigint").alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"), "n_words")
