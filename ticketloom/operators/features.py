"""TF-IDF features: long table for SQL work, sparse vectors for models.

The vocabulary is chosen once, with ties in alphabetical order, and both forms use it.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.ml import PipelineModel
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer, VectorSlicer
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, functions as F

from ticketloom.functions.text import bound, ngrams_1_2, word_tokens
from ticketloom.operators.ranking import top_n
from ticketloom.operators.term_counts import term_pair_stats, written_words


def with_terms(df: DataFrame, text: str, out: str = "terms") -> DataFrame:
    """Add the unigrams and bigrams of a text."""
    tokens = df.withColumn("_tokens", word_tokens(text))
    return tokens.withColumn(out, ngrams_1_2("_tokens")).drop("_tokens")


def _first_flags(terms: Column) -> Column:
    """Each term with 1 at its first place in the document and 0 at repeats."""

    def marked(s: Column) -> Column:
        before = F.concat(F.array(F.lit(None).cast("string")), s)
        pairs = F.zip_with(
            s, before,
            lambda a, b: F.struct(a.alias("term"), (~a.eqNullSafe(b)).cast("int").alias("first")),
        )
        # ``before`` is one longer; its last pair has no term.
        return F.filter(pairs, lambda x: x["term"].isNotNull())

    return bound(F.sort_array(terms), marked)


def term_stats(df: DataFrame, terms: str = "terms") -> DataFrame:
    """Documents and occurrences of every term.

    Sorting inside the row marks repeats, so one aggregation by term is enough: no
    shuffle by document and term, and a term that fills every document is combined
    before the shuffle.
    """
    return (
        df.select(F.inline(_first_flags(F.col(terms))))
        .groupBy("term")
        .agg(F.sum("first").alias("df"), F.count("*").alias("cf"))
    )


def smooth_idf(n_docs: Column, df: Column) -> Column:
    """ln((1 + n) / (1 + df)) + 1."""
    return F.log((n_docs + 1).cast("double") / (df + 1)) + 1.0


def _rows(pieces: DataFrame) -> int:
    """Rows of the table that ``written_words`` has written."""
    return pieces.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def fit_vocabulary(
    df: DataFrame, terms: str = "terms", max_features: int = 8000, min_df: int = 3,
    max_df: float = 0.7, pairs: bool = False,
) -> DataFrame:
    """Terms kept, with document count, occurrences and idf.

    Of the terms in at least ``min_df`` documents and at most that share of them, the
    most frequent in the corpus; at most ``max_features`` rows. With ``pairs`` the terms are
    those of ``with_terms``, words and pairs of neighbours: pairs that the counts of their
    words rule out are not counted. The rows are the same.
    """
    n, stats = df.agg(F.count("*").alias("n")).scalar(), None

    def top(stats: DataFrame) -> DataFrame:
        kept = stats.where((F.col("df") >= min_df) & (F.col("df") <= F.lit(max_df) * n))
        return kept.orderBy(F.desc("cf"), "term").limit(max_features)

    def least(words: DataFrame) -> int:
        got = top(words).agg(F.count("*").alias("n"), F.min("cf").alias("cf")).first()
        return got["cf"] if got["n"] and got["n"] == max_features else 0

    if pairs:
        pieces = written_words(df, terms, F.lit(0))
        n = F.lit(_rows(pieces))
        stats = term_pair_stats(pieces, least, min_df)
    stats = term_stats(df, terms) if stats is None else stats.drop("fold")
    return top(stats).withColumn("idf", smooth_idf(n, F.col("df")))


def fold_stats(
    df: DataFrame, fold: str, terms: str = "terms", sizes: dict[int, int] | None = None,
    max_features: int = 8000, min_df: int = 3, max_df: float = 0.7,
) -> DataFrame:
    """Documents and occurrences of every term in every fold: (term, fold, df, cf).

    One reading of the texts; combined before the shuffle, as in ``term_stats``. With
    ``sizes``, the documents of each fold, the terms are those of ``with_terms``, and pairs
    that are in no vocabulary of ``fold_vocabularies`` within these limits may be left out.
    """
    def least(words: DataFrame) -> int:
        chosen = fold_vocabularies(words, sizes, max_features, min_df, max_df)
        got = chosen.groupBy("fold").agg(F.count("*").alias("n"), F.min("cf").alias("cf")).collect()
        full = [r["cf"] for r in got if r["n"] == max_features]
        return min(full) if full and len(full) == len(sizes) else 0

    if sizes:
        stats = term_pair_stats(written_words(df, terms, F.col(fold)), least, min_df)
        if stats is not None:
            return stats
    return (
        df.select(F.col(fold).alias("fold"), F.inline(_first_flags(F.col(terms))))
        .groupBy("term", "fold")
        .agg(F.sum("first").alias("df"), F.count("*").alias("cf"))
    )


def fold_vocabularies(
    stats: DataFrame, sizes: dict[int, int], max_features: int = 8000, min_df: int = 3, max_df: float = 0.7,
) -> DataFrame:
    """The vocabulary that each fold is tested with: (fold, term, df, cf, idf).

    Counts of the other folds are the total less the fold's own, so the texts are not read
    again for any fold. ``sizes`` are the documents of each fold. Limits and order are those
    of ``fit_vocabulary``.
    """
    n = sum(sizes.values())
    train = F.create_map(*(F.lit(x) for f, own in sizes.items() for x in (f, n - own)))
    own = F.map_from_entries(F.collect_list(F.struct("fold", F.struct("df", "cf"))))
    totals = stats.groupBy("term").agg(F.sum("df").alias("_df"), F.sum("cf").alias("_cf"), own.alias("_own"))
    each = totals.select(
        "term", "_df", "_cf", "_own", F.explode(F.array(*(F.lit(f).cast("int") for f in sizes))).alias("fold"))
    mine = F.try_element_at("_own", F.col("fold"))
    rest = each.select(
        "fold", "term", (F.col("_df") - F.coalesce(mine["df"], F.lit(0))).alias("df"),
        (F.col("_cf") - F.coalesce(mine["cf"], F.lit(0))).alias("cf"), train[F.col("fold")].alias("_n"))
    kept = rest.where((F.col("df") >= min_df) & (F.col("df") <= F.lit(max_df) * F.col("_n")))
    top = top_n(kept, ["fold"], [F.desc("cf"), F.asc("term")], max_features)
    return top.withColumn("idf", smooth_idf(F.col("_n"), F.col("df"))).drop("_n", "rank")


def _long_rows(
    df: DataFrame, vocabulary: DataFrame, doc: str, terms: str, keep: tuple[str, ...], max_features: int
) -> DataFrame:
    """Non-zero entries of the vector form: document, kept columns, term, tf, weight.

    A document is one row, so its counts and its norm are row-local: nothing is shuffled,
    and only the entries leave the row.
    """
    model = vectorizer(vocabulary, max_features)
    named = F.split(F.lit("\0".join(vocabulary_of(model))), "\0")
    rows = model.transform(df.select(doc, *keep, F.col(terms).alias("terms")))
    counts, weights = F.unwrap_udt("_counts"), F.unwrap_udt("features")
    entries = F.transform(counts["indices"], lambda i, k: F.struct(
        (i + 1).alias("_i"), F.get(counts["values"], k).cast("bigint").alias("tf"),
        F.get(weights["values"], k).alias("weight")))
    flat = rows.select(doc, *keep, F.inline(entries))
    return flat.select(doc, *keep, F.element_at(named, F.col("_i")).alias("term"), "tf", "weight")


def term_counts(
    df: DataFrame, vocabulary: DataFrame, doc: str, terms: str = "terms", keep: tuple[str, ...] = (),
    max_features: int = 8000,
) -> DataFrame:
    """Occurrences of each vocabulary term per document; row-local."""
    return _long_rows(df, vocabulary, doc, terms, keep, max_features).drop("weight")


def tf_idf(
    df: DataFrame, vocabulary: DataFrame, doc: str, terms: str = "terms", keep: tuple[str, ...] = (),
    max_features: int = 8000,
) -> DataFrame:
    """Long table (document, kept columns, term, tf, weight) with rows of length one.

    Also transforms new documents with a vocabulary fitted on others.
    """
    return _long_rows(df, vocabulary, doc, terms, keep, max_features)


def vectorizer(vocabulary: DataFrame, max_features: int = 8000) -> PipelineModel:
    """Fitted pipeline from ``terms`` to normalised ``features``.

    Terms are indexed in alphabetical order.  Only the vocabulary, bounded by
    ``max_features``, comes to the driver.
    """
    rows = vocabulary.select("term", "idf").limit(max_features + 1).collect()
    if len(rows) > max_features:
        raise ValueError(f"vocabulary has more than {max_features} terms")
    if not rows:
        raise ValueError("no term meets the document limits")
    idf = dict((r["term"], r["idf"]) for r in rows)
    terms = sorted(idf)
    counts = CountVectorizerModel.from_vocabulary(terms, inputCol="terms", outputCol="_counts")
    weights = ElementwiseProduct(
        scalingVec=Vectors.dense([idf[t] for t in terms]), inputCol="_counts", outputCol="_weighted"
    )
    return PipelineModel([counts, weights, Normalizer(p=2.0, inputCol="_weighted", outputCol="features")])


def fold_vectors(df: DataFrame, vocabularies: DataFrame, folds: Iterable[int], max_features: int = 8000) -> DataFrame:
    """Replace ``terms`` by one feature vector for each fold's vocabulary, ``features_<fold>``.

    All vectors of a row come from one reading of its terms.
    """
    kept = vocabularies.persist()
    out = df
    for f in folds:
        out = vectorizer(kept.where(F.col("fold") == f), max_features).transform(out).withColumnRenamed(
            "features", f"features_{f}").drop("_counts", "_weighted")
    kept.unpersist()
    return out.drop("terms")


def sliced_features(df: DataFrame, model: PipelineModel, ranked: list[str], size: int, out: str = "features") -> DataFrame:
    """Features of a smaller vocabulary, cut from the weights of a larger one.

    ``ranked`` are the larger vocabulary's terms from the most frequent on. Weights do not
    depend on the other terms, so the vector of the first ``size`` is a slice, normalised again.
    """
    place = {t: i for i, t in enumerate(vocabulary_of(model))}
    slicer = VectorSlicer(inputCol="_weighted", outputCol="_sliced", indices=sorted(place[t] for t in ranked[:size]))
    return Normalizer(p=2.0, inputCol="_sliced", outputCol=out).transform(slicer.transform(df)).drop("_sliced")


def vocabulary_of(model: PipelineModel) -> list[str]:
    """Terms of a fitted vectorizer, by index."""
    return list(model.stages[0].vocabulary)


def with_features(df: DataFrame, text: str, model: PipelineModel) -> DataFrame:
    """Add ``features``; row-local."""
    out = model.transform(with_terms(df, text))
    return out.drop("terms", "_counts", "_weighted")
