"""One-pass search of a phrase list.

``contains`` once per phrase reads the text as many times as there are phrases.
Here a single regular expression with a look-ahead reports, for every position, the
longest phrase that starts there.  Two phrases that start at one position are
prefixes of each other, so the longest one implies the rest, and the set of phrases
in the text is complete.  The pattern shares common prefixes, so its cost hardly
grows with the list.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from ticketloom.functions.text import WORD, _col, bound, literals


def _quote(ch: str) -> str:
    return "\\" + ch if re.match(r"[^\w\s]", ch) else ch


def _shared_prefix_pattern(phrases: Sequence[str]) -> str:
    """Alternation with shared prefixes, greedy for the longest phrase."""
    heads: dict[str, list[str]] = {}
    for p in phrases:
        if p:
            heads.setdefault(p[0], []).append(p[1:])
    alternatives = [_quote(h) + _shared_prefix_pattern(rest) for h, rest in sorted(heads.items())]
    if not alternatives:
        return ""
    body = alternatives[0] if len(alternatives) == 1 else f"(?:{'|'.join(alternatives)})"
    return f"(?:{body})?" if "" in phrases else body


def _any_of(chars: set[str]) -> str:
    return "[" + "".join(_quote(c) for c in sorted(chars)) + "]"


def phrase_pattern(phrases: Sequence[str], match: str = "substring") -> str:
    """Look-ahead pattern whose group 1 is the longest phrase at a position.

    Two character classes in front reject most positions before any alternative is
    tried, and first letters are tried in groups of three.
    """
    words = sorted(set(phrases))
    if not words or "" in words:
        raise ValueError("phrases must be a non-empty list of non-empty texts")
    firsts = sorted({w[0] for w in words})
    groups = [firsts[i : i + 3] for i in range(0, len(firsts), 3)]
    branches = [
        f"(?={_any_of(set(g))})" + _shared_prefix_pattern([w for w in words if w[0] in g])
        for g in groups
    ]
    body = f"(?:{'|'.join(branches)})"
    lead = _any_of(set(firsts))
    if all(len(w) > 1 for w in words):
        lead += _any_of({w[1] for w in words})
    if match == "word":
        return rf"(?<![{WORD}])(?={lead})(?=({body})(?![{WORD}]))"
    if match == "substring":
        return rf"(?={lead})(?=({body}))"
    raise ValueError("match must be 'substring' or 'word'")


def _implied(phrase: str, phrases: Sequence[str], match: str) -> list[str]:
    """Shorter phrases that a phrase brings along because they are its prefixes."""
    found = [p for p in phrases if p != phrase and phrase.startswith(p)]
    if match == "word":
        found = [p for p in found if re.match(r"\W", phrase[len(p)])]
    return found


def phrases_in(text: Column | str, phrases: Sequence[str], match: str = "substring") -> Column:
    """Distinct phrases present in the text (any order)."""
    words = sorted(set(phrases))
    longest = F.array_distinct(
        F.regexp_extract_all(_col(text), F.lit(phrase_pattern(words, match)), F.lit(1))
    )
    nested = {w: _implied(w, words, match) for w in words}
    nested = {w: short for w, short in nested.items() if short}
    if not nested:
        return longest
    lookup = F.create_map(*[x for w, short in nested.items() for x in (F.lit(w), literals(short))])
    none = F.array().cast("array<string>")
    return bound(
        longest,
        lambda found: F.array_union(
            found, F.flatten(F.transform(found, lambda x: F.coalesce(lookup[x], none)))
        ),
    )
