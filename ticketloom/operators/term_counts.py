"""Counts of words and of pairs of neighbouring words, without a shuffle of all pairs.

The rows' words are written once as numbers, piece by piece, each piece with its distinct
words. Words are counted first. A pair occurs no more often than either of its words, nor in
more documents, so the counts of the words bound those of the pairs: pairs that cannot be
among the most frequent terms are left out before the shuffle. The others are pairs of a
bounded number of words, and are counted by number.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from ticketloom.session import WIDE_ROWS, materialize, small_batches

#: Words that pairs may be made of, at most; beyond that all pairs are counted as text.
FREQUENT = 1 << 18
#: Words in a piece at most, unless one row has more.
PIECE = 1 << 18
_PIECE = "words array<string>, codes binary, sizes binary, folds binary, n long"
_STATS = "fold int, df long, cf long"


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        ends, a = np.cumsum(pc.list_value_length(whole.column(0)).to_numpy(zero_copy_only=False)), 0
        while a < whole.num_rows:
            before = int(ends[a - 1]) if a else 0
            b = max(a + 1, int(np.searchsorted(ends, before + PIECE, "right")))
            batch, a = whole.slice(a, b - a), b
            coded = batch.column(0).flatten().dictionary_encode()
            sizes = np.diff(ends[a - batch.num_rows:a], prepend=before)
            yield pa.RecordBatch.from_arrays([
                pa.ListArray.from_arrays(pa.array([0, len(coded.dictionary)], pa.int32()), coded.dictionary),
                pa.array([coded.indices.to_numpy().astype("<i4").tobytes()], pa.binary()),
                pa.array([sizes.astype("<i4").tobytes()], pa.binary()),
                pa.array([batch.column(1).to_numpy().astype("<i4").tobytes()], pa.binary()),
                pa.array([batch.num_rows], pa.int64())], names=["words", "codes", "sizes", "folds", "n"])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Words, number of each place's word, row of each place, and fold of each row, piece by piece."""
    for batch in batches:
        for k in range(batch.num_rows):
            codes, sizes, folds = (np.frombuffer(batch.column(c)[k].as_buffer(), "<i4") for c in (1, 2, 3))
            yield batch.column(0)[k].values, codes, np.repeat(np.arange(len(sizes)), sizes), folds


def _counts(key: np.ndarray, many: int, row: np.ndarray, folds: np.ndarray) -> Iterator[tuple]:
    """For each fold the keys (below ``many``) it has, their rows and their occurrences."""
    seen = np.sort(row * many + key)
    seen = seen[np.diff(seen, prepend=-1) > 0]
    fold, owner = folds[row], seen // many
    every, seen, own = np.unique(folds).tolist(), seen - owner * many, folds[owner]
    for f in every:
        cf = np.bincount(key[fold == f] if every[1:] else key, minlength=many)
        df = np.bincount(seen[own == f] if every[1:] else seen, minlength=many)
        there = np.flatnonzero(cf)
        yield f, there, df[there], cf[there]


def _batch(terms: pa.Array, name: str, fold: int, df: np.ndarray, cf: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [terms, pa.array(np.full(len(df), fold), pa.int32()), pa.array(df, pa.int64()), pa.array(cf, pa.int64())],
        names=[name, "fold", "df", "cf"])


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for words, codes, row, folds in _read(batches):
        for fold, there, df, cf in _counts(codes.astype(np.int64), len(words), row, folds):
            yield _batch(words.take(pa.array(there)), "term", fold, df, cf)


def _pair_counts(names: pa.Array) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        many = len(names)
        for words, codes, row, folds in _read(batches):
            number = pc.fill_null(pc.index_in(words, value_set=names.cast(words.type)), -1).to_numpy().astype(np.int64)
            at = number[codes]
            here = np.flatnonzero((row[:-1] == row[1:]) & (at[:-1] >= 0) & (at[1:] >= 0))
            if len(here):
                pairs, code = np.unique(at[here] * many + at[here + 1], return_inverse=True)
                for fold, there, df, cf in _counts(code, len(pairs), row[here], folds):
                    yield _batch(pa.array(pairs[there]), "pair", fold, df, cf)

    return run


def written_words(df: DataFrame, terms: str, fold: Column) -> DataFrame:
    """The words of the rows as numbers, written once; ``terms`` are words followed by their pairs."""
    every = F.coalesce(F.col(terms), F.array().cast("array<string>"))
    rows = df.select(every.alias("t"), fold.cast("int").alias("fold"))
    words = F.slice("t", F.lit(1), F.floor((F.size("t") + 1) / 2).cast("int"))
    with small_batches(df.sparkSession):
        return materialize(rows.select(words.alias("t"), "fold").mapInArrow(_pieces, _PIECE), "words", **WIDE_ROWS)


def term_pair_stats(pieces: DataFrame, bound: Callable[[DataFrame], int], min_df: int) -> DataFrame | None:
    """Documents and occurrences by term and fold: (term, fold, df, cf), of all words and of the pairs that matter.

    ``bound`` gives, from the counts of the words, the occurrences that a pair needs at least.
    Pairs with fewer, or in fewer than ``min_df`` documents, may be missing. None where too
    many words are as frequent.
    """
    words = pieces.mapInArrow(_word_counts, f"term string, {_STATS}").groupBy("term", "fold").agg(
        F.sum("df").alias("df"), F.sum("cf").alias("cf"))
    with small_batches(pieces.sparkSession):
        words = materialize(words, "word-stats")
    least = bound(words)
    enough = (F.sum("cf") >= least) & (F.sum("df") >= min_df)
    totals = words.groupBy("term").agg(enough.alias("_kept")).where("_kept").select("term")
    names = totals.limit(FREQUENT + 1).toArrow().column(0).combine_chunks()
    if len(names) > FREQUENT:
        return None
    own = F.collect_list(F.struct("fold", "df", "cf"))
    pairs = pieces.mapInArrow(_pair_counts(names), f"pair long, {_STATS}").groupBy("pair", "fold").agg(
        F.sum("df").alias("df"), F.sum("cf").alias("cf"))
    pairs = pairs.groupBy("pair").agg(own.alias("_own"), enough.alias("_kept")).where("_kept")
    with small_batches(pieces.sparkSession):
        pairs = materialize(pairs, "pair-stats")
    numbered = pieces.sparkSession.createDataFrame(
        pa.table({"n": pa.array(np.arange(len(names)), pa.int64()), "w": names.cast(pa.string())}))
    many = F.lit(max(len(names), 1)).cast("long")
    a, b = numbered.toDF("_a", "_first"), numbered.toDF("_b", "_second")
    named = pairs.withColumns({"_a": F.floor(F.col("pair") / many), "_b": F.col("pair") % many}).join(a, "_a").join(b, "_b")
    return words.unionByName(named.select(
        F.concat("_first", F.lit(" "), "_second").alias("term"), F.inline("_own")).select("term", "fold", "df", "cf"))
