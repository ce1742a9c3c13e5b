"""Text expressions: Column in, Column out, no UDF.

A word character is a Unicode letter, a Unicode number or ``_``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, functions as F

from ticketloom import lexicons as lx

WORD = r"\p{L}\p{N}_"
SPACE = r"\s\x{1c}-\x{1f}\x{85}\p{Z}"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def literals(values: Iterable[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate a costly value once and use it several times in an expression."""
    return F.element_at(F.transform(F.array(value), body), 1)


# -- cleaning ---------------------------------------------------------------

def strip_punct(c: Column | str) -> Column:
    """Every character that is neither a word character nor space becomes a space."""
    return F.regexp_replace(_col(c), rf"[^{WORD}\s]", " ")


def squash(c: Column | str) -> Column:
    """Runs of white space (Unicode) become one space; ends are trimmed."""
    return F.trim(F.regexp_replace(_col(c), rf"[{SPACE}]+", " "))


def remove_phrases(c: Column | str, phrases: Sequence[str] = lx.COURTESY_PHRASES) -> Column:
    """Replace each phrase by a space, in list order, as a substring."""
    return reduce(lambda acc, p: F.replace(acc, F.lit(p), F.lit(" ")), phrases, _col(c))


def normalize_synonyms(
    c: Column | str, pairs: Sequence[tuple[str, str]] = lx.SYNONYMS
) -> Column:
    """Replace each synonym by its canonical term, in list order, as a substring."""
    return reduce(lambda acc, p: F.replace(acc, F.lit(p[0]), F.lit(p[1])), pairs, _col(c))


def preprocess(
    c: Column | str,
    phrases: Sequence[str] = lx.COURTESY_PHRASES,
    pairs: Sequence[tuple[str, str]] = lx.SYNONYMS,
) -> Column:
    """Lower, strip punctuation, squash, drop phrases, apply synonyms, squash.

    Punctuation and space are one class here: a run of either becomes one space, which
    equals stripping and then squashing but reads the text once.
    """
    lowered = F.lower(F.coalesce(_col(c), F.lit("")))
    spaced = F.regexp_replace(lowered, rf"[^{WORD}]+", " ")
    return squash(normalize_synonyms(remove_phrases(spaced, phrases), pairs))


def outside(kept: str) -> str:
    """Class of all characters but these, as ranges.

    The engine tests a negated class of several ranges character by character through a chain
    of predicates; the same set as plain ranges is some ten times as fast.
    """
    points, ranges, at = sorted(set(map(ord, kept))), [], 0
    for p in [*points, 0x110000]:
        if p > at:
            ranges.append(rf"\x{{{at:X}}}-\x{{{p - 1:X}}}")
        at = p + 1
    return "[" + "".join(ranges) + "]"


#: Characters that ``clean_es`` keeps.
SPANISH = "abcdefghijklmnopqrstuvwxyzáéíóúñü0123456789-_"


def clean_es(c: Column | str) -> Column:
    """Keep Spanish lower-case letters, digits, space, ``-`` and ``_``."""
    # Other signs and space alike end as one space, so one pass is enough.
    return F.trim(F.regexp_replace(F.lower(F.coalesce(_col(c), F.lit(""))), outside(SPANISH) + "+", " "))


# -- combining --------------------------------------------------------------

def combined_text(*cols: Column | str) -> Column:
    """Join the text columns with a space; nulls are skipped."""
    return F.concat_ws(" ", *[_col(c) for c in (cols or lx.TEXT_COLUMNS)])


def rule_text(resumen: Column | str, *fields: Column | str) -> Column:
    """Lower-case summary, then each field that is neither empty nor the text ``nan``."""

    def present(c: Column) -> Column:
        keep = (c != "") & (F.lower(F.trim(c)) != "nan")
        return F.when(keep, F.lower(c))

    return F.concat_ws(
        " ", F.lower(F.coalesce(_col(resumen), F.lit(""))), *[present(_col(f)) for f in fields]
    )


def analysis_text(resumen: Column | str, notas: Column | str, causa: Column | str) -> Column:
    """Three cleaned columns, a space, and the technical keywords found in them."""
    parts = [F.when(_col(c).isNotNull(), clean_es(c)) for c in (resumen, notas, causa)]
    return bound(
        F.concat_ws(" ", *parts), lambda full: F.concat(full, F.lit(" "), technical_keywords(full))
    )


def ellipsize(c: Column | str, n: int) -> Column:
    """First n characters and ``...`` when the text is longer than n."""
    c = _col(c)
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


def default_text(c: Column | str, value: Column | str) -> Column:
    """Value to show where the column is null."""
    return F.coalesce(_col(c), value if isinstance(value, Column) else F.lit(value))


# -- tokens -----------------------------------------------------------------

def word_tokens(c: Column | str) -> Column:
    """Word runs of at least two characters: the vectorizer's tokens."""
    return F.regexp_extract_all(
        F.lower(F.coalesce(_col(c), F.lit(""))), F.lit(rf"[{WORD}]{{2,}}"), F.lit(0)
    )


def ascii_tokens(c: Column | str) -> Column:
    """Word runs made of at least three ASCII letters or digits.

    A run with an accent or ``_`` drops out whole.
    """
    return F.regexp_extract_all(
        F.lower(F.coalesce(_col(c), F.lit(""))),
        F.lit(rf"(?<![{WORD}])[a-z0-9]{{3,}}(?![{WORD}])"),
        F.lit(0),
    )


def drop_stopwords(arr: Column | str, stop: Sequence[str]) -> Column:
    """Remove stop words; repeats of the other words stay."""
    return F.filter(_col(arr), lambda x: ~x.isin(*stop))


def meaningful_words(c: Column | str, stop: Sequence[str] = lx.ANALYZER_STOPWORDS) -> Column:
    """White-space words longer than three, with a letter, not stop words."""
    words = F.split(squash(F.lower(F.coalesce(_col(c), F.lit("")))), " ")
    return F.filter(
        words, lambda x: (F.length(x) > 3) & x.rlike(r"\p{L}") & ~x.isin(*stop)
    )


def ngrams_1_2(tokens: Column | str) -> Column:
    """All tokens followed by all pairs of neighbours joined by a space."""
    t = _col(tokens)
    n = F.size(t)
    pairs = F.when(
        n >= 2,
        F.zip_with(
            F.slice(t, F.lit(1), F.greatest(n - 1, F.lit(0))),
            F.slice(t, F.lit(2), F.greatest(n - 1, F.lit(0))),
            lambda a, b: F.concat_ws(" ", a, b),
        ),
    ).otherwise(F.array().cast("array<string>"))
    return F.concat(t, pairs)


def rows_of(array: str) -> Column:
    """``explode`` of a column, without re-evaluation.

    A plain ``explode(column)`` makes Spark add a filter on the size of the array, and
    that filter is pushed below the projection that computes it, so costly text work
    is done again.  A conditional expression is left alone.
    """
    return F.explode(F.when(F.size(array) > 0, F.col(array)))


# -- searching --------------------------------------------------------------

def contains_any(c: Column | str, words: Sequence[str]) -> Column:
    """True when any word occurs as a substring."""
    c = _col(c)
    return reduce(lambda acc, w: acc | c.contains(w), words[1:], c.contains(words[0]))


def count_sub(c: Column | str, word: str) -> Column:
    """Number of non-overlapping occurrences of a substring."""
    c = _col(c)
    removed = F.length(c) - F.length(F.replace(c, F.lit(word), F.lit("")))
    return F.when(c.contains(word), (removed / len(word)).cast("int")).otherwise(F.lit(0))


def count_subs(c: Column | str, words: Sequence[str]) -> Column:
    """Sum of the counts of several substrings, each counted on its own."""
    return reduce(lambda acc, w: acc + count_sub(c, w), words[1:], count_sub(c, words[0]))


def whole_words(words: Sequence[str]) -> str:
    """Pattern of whole words (or phrases), longest first.

    The first letters are tested before anything else, as most positions fail there.
    """
    longest = sorted(set(words), key=lambda w: (-len(w), w))
    firsts = "".join(sorted({w[0] for w in longest}))
    return rf"(?=[{firsts}])(?<![{WORD}])(?:{'|'.join(longest)})(?![{WORD}])"


def technical_keywords(
    c: Column | str, classes: Sequence[tuple[str, Sequence[str]]] = lx.TECHNICAL_CLASSES
) -> Column:
    """``class_word`` for each whole technical word: class order, then text order."""
    every = [w for _, words in classes for w in words]
    found = F.regexp_extract_all(
        F.lower(F.coalesce(_col(c), F.lit(""))), F.lit(whole_words(every)), F.lit(0)
    )

    def named(f: Column, name: str, words: Sequence[str]) -> Column:
        mine = F.filter(f, lambda x: x.isin(*words))
        return F.transform(mine, lambda x: F.concat(F.lit(name + "_"), x))

    return bound(
        found, lambda f: F.array_join(F.concat(*[named(f, n, ws) for n, ws in classes]), " ")
    )


# -- formatting -------------------------------------------------------------

def title_case(c: Column | str) -> Column:
    """First letter of each run of letters upper-case, the rest lower-case."""
    runs = F.regexp_extract_all(_col(c), F.lit(r"\p{L}+|[^\p{L}]+"), F.lit(0))
    return F.array_join(F.transform(runs, lambda r: F.initcap(r)), "")


def slug_key(name: Column | str) -> Column:
    """Key of a classifier category: drop signs, spaces become ``_``, lower-case."""
    kept = F.regexp_replace(_col(name), rf"[^{WORD}\s-]", "")
    return F.lower(F.replace(kept, F.lit(" "), F.lit("_")))


def slug_merged(name: Column | str) -> Column:
    """Key of an analyzer category: as above, with runs of space and ``-`` merged."""
    kept = F.regexp_replace(F.lower(_col(name)), rf"[^{WORD}\s-]", "")
    return F.regexp_replace(kept, r"[\s-]+", "_")


def join_first(arr: Column | str, n: int) -> Column:
    """First n elements as text."""
    return F.array_join(F.slice(_col(arr), 1, n), ", ")


def format_percent(c: Column | str, digits: int = 1) -> Column:
    """Share 0..1 as text such as ``92.6%``."""
    return F.format_string(f"%.{digits}f%%", _col(c) * F.lit(100.0))


def format_decimals(c: Column | str, digits: int = 3) -> Column:
    return F.format_string(f"%.{digits}f", _col(c).cast("double"))


def type_id(label: Column | str) -> Column:
    """``tipo_NN`` from a numeric label."""
    return F.format_string("tipo_%02d", _col(label).cast("int"))
