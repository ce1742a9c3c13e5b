"""Quality rules: cross-document line frequency within a host.

Lines are normalised (lower case, runs of digits as one 0, runs of blanks as one,
trimmed) and hashed. For each host (column ``source``; null is a host of its own) and
line the distinct documents that hold it are counted. A line above both limits, a number
and a share of the host's distinct documents, is boilerplate and is removed. Documents that
lose more than half of their words are depleted and rejected.

Documents of equal text in one host count once, by a hash of the whole text: a copied
document is no boilerplate, and which copy stays is left to the near-duplicate stage.

Null text counts as empty: no words, ``base_failed``. Equal rows get equal verdicts, ties
need no rule. Very long texts are one row's arrays. Documents without lines above the limits
keep their text byte for byte. All columns travel in one struct, so names cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ticketloom.llm.common import SPACE, let, pinned, scratch_path, words, written

#: Limits: a line is boilerplate in a host from so many distinct documents on, and from this
#: share of the host's distinct documents on.
LINE_DOCUMENTS = 20
LINE_SHARE = 0.05
#: Line hashes of all hosts up to which the lists are broadcast; beyond, the join shuffles by host.
BROADCAST_LINES = 1_000_000

#: Fixed values of the base rules.
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SYMBOLS = "[#*$%&|<>]"


def _normalised_lines(text: Column) -> Column:
    flat = F.lower(F.coalesce(text, F.lit("")))
    flat = F.regexp_replace(flat, "[0-9]+", "0")
    flat = F.regexp_replace(flat, "[ \\t\\x0B\\f\\r]+", " ")
    return F.transform(F.split(flat, "\n", -1), F.trim)


def _line_hashes(lines: Column) -> Column:
    """Hash of each line; null for a line without a word."""
    return F.transform(lines, lambda x: F.when(x != "", F.xxhash64(x)))


def _copy() -> Column:
    """What is equal for documents of equal text."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


def host_lines(docs: DataFrame) -> DataFrame:
    """Rows source, line, documents: the distinct documents of a host that hold a line.

    The first count is by document, so that no single key gathers a common line's rows.
    """
    base = pinned(docs, "source", copy=_copy(), h=F.array_distinct(F.array_compact(_line_hashes(_normalised_lines(F.col("text"))))))
    rows = base.select("source", "copy", F.explode("h").alias("line"))
    return rows.distinct().groupBy("source", "line").agg(F.count(F.lit(1)).alias("documents"))


def boilerplate(docs: DataFrame, min_documents: int = LINE_DOCUMENTS,
                min_share: float = LINE_SHARE) -> DataFrame:
    """Rows source, bad: the hashes of the lines above the limits in each host.

    With mean m lines a document, a host has at most m / min_share such lines, so the
    list of a host is bounded whatever its size.
    """
    sizes = docs.select("source", _copy().alias("copy")).distinct().groupBy("source").agg(F.count(F.lit(1)).alias("size"))
    lines = host_lines(docs).where(F.col("documents") >= min_documents)
    over = lines.join(sizes, lines["source"].eqNullSafe(sizes["source"])).where(
        F.col("documents") >= min_share * F.col("size"))
    return over.groupBy(lines["source"]).agg(F.sort_array(F.collect_list("line")).alias("bad"))


def _repeat_words(w: Column) -> Column:
    """Words that lie in a window of three words found twice or more in the text."""
    windows = F.when(F.size(w) >= 3, F.transform(
        F.sequence(F.lit(1), F.size(w) - 2),
        lambda i: F.xxhash64(F.element_at(w, i), F.element_at(w, i + 1), F.element_at(w, i + 2)),
    )).otherwise(F.array().cast("array<bigint>"))

    def covered(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        starts = let(pairs, lambda s: F.sort_array(F.transform(
            F.filter(s, lambda x, i: F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False))
                     | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False))),
            lambda x: x["i"])))
        return let(starts, lambda p: F.aggregate(
            F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(x - F.get(p, i - 1), F.lit(3)))),
            F.lit(0).cast("bigint"), lambda a, x: a + x))

    return let(windows, lambda h: F.when(
        F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("bigint")).otherwise(covered(h)))


def assess(docs: DataFrame, min_documents: int = LINE_DOCUMENTS, min_share: float = LINE_SHARE) -> DataFrame:
    """A struct ``doc`` with all columns of ``docs``, and a struct ``quality``: figures, cleaned text, verdict."""
    spark = docs.sparkSession
    bad = written(boilerplate(docs, min_documents, min_share), scratch_path(spark, "boilerplate"))
    if bad.agg(F.coalesce(F.sum(F.size("bad") + 4), F.lit(0))).first()[0] <= BROADCAST_LINES:
        bad = F.broadcast(bad)
    packed = docs.select(F.struct("*").alias("doc"), F.col("source").alias("host"))
    held = packed.join(bad, packed["host"].eqNullSafe(bad["source"]), "left").select("doc", "bad")
    text = F.coalesce("doc.text", F.lit(""))
    held = pinned(held, "doc", "bad", w=words(text), raw=F.split(text, "\n", -1))
    worded = F.filter("raw", lambda x: x.rlike(f"[^{SPACE[1:]}"))
    norm = F.when(F.size("bad") > 0, _line_hashes(_normalised_lines(text)))
    held = pinned(
        held, "doc",
        gone=let(norm, lambda h: F.transform("raw", lambda x, i: F.struct(
            x.alias("line"), F.coalesce(F.array_contains("bad", F.get(h, i)), F.lit(False)).alias("gone")))),
        q=F.struct(
            F.size("w").cast("bigint").alias("n_words"),
            F.length(F.array_join("w", "")).cast("bigint").alias("word_chars"),
            F.regexp_count(text, F.lit(SYMBOLS)).cast("bigint").alias("n_symbols"),
            let(worded, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines"),
            _repeat_words(F.col("w")).alias("n_repeat_words"),
        ),
    )
    q = F.col("q")
    lost = F.filter("gone", lambda x: x["gone"])
    lost_words = F.coalesce(F.size(words(F.array_join(F.transform(lost, lambda x: x["line"]), "\n"))), F.lit(0))
    any_lost = F.coalesce(F.size(lost), F.lit(0)) > 0
    failed = (q["n_words"] < MIN_WORDS) | (100 * q["n_repeat_words"] > MAX_REPEAT_PERCENT * q["n_words"])
    rest = F.array_join(F.transform(F.filter("gone", lambda x: ~x["gone"]), lambda x: x["line"]), "\n")
    return held.select("doc", F.struct(
        "q.*",
        F.when(any_lost, lost_words).otherwise(0).cast("bigint").alias("lost_words"),
        failed.alias("base_failed"),
        (~failed & ~F.when(any_lost, 2 * lost_words > q["n_words"]).otherwise(False)).alias("kept"),
        F.when(any_lost, rest).otherwise(F.col("doc.text")).alias("text"),
    ).alias("quality"))


def verdicts(docs: DataFrame) -> DataFrame:
    """One row per document with its figures and verdict."""
    return assess(docs).select("doc.doc_id", "quality.*").drop("text")


def clean(docs: DataFrame) -> DataFrame:
    """The documents kept, without boilerplate lines; columns as given."""
    out = assess(docs).where("quality.kept")
    changed = {"text": F.col("quality.text")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col("quality.text") == F.col("doc.text"), F.col("doc.n_chars")).otherwise(
            F.length("quality.text").cast(docs.schema["n_chars"].dataType))
    return out.select(*(changed.get(c, F.col(f"doc.`{c}`")).alias(c) for c in docs.columns))
