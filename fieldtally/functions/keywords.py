"""Many keywords in one walk over a text.

The keywords become a trie, written as one pattern: at each place of the text a match follows the trie
as far as it goes, so the cost hangs on the text and hardly on the number of keywords. All shorter
keywords at a place are beginnings of the longest one there; which of them comes first in the list is known beforehand.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

END = ""


def trie_of(keywords: tuple[str, ...]) -> dict:
    root: dict = {}
    for keyword in keywords:
        node = root
        for char in keyword:
            node = node.setdefault(char, {})
        node[END] = {}
    return root


def _literal(char: str) -> str:
    return char if char.isalnum() or ord(char) > 127 else "\\" + char if char.isprintable() else f"\\x{ord(char):02x}"


def trie_pattern(keywords: tuple[str, ...]) -> str:
    """A pattern that matches the longest of the keywords at a place. Without recursion, as keywords may be long."""
    root = trie_of(keywords)
    done: dict[int, str] = {}
    stack = [(root, False)]
    while stack:
        node, ready = stack.pop()
        branches = [c for c in node if c != END]
        if not ready:
            stack.append((node, True))
            stack += [(node[c], False) for c in branches]
            continue
        parts = [_literal(c) + done.pop(id(node[c])) for c in sorted(branches)]
        whole = "|".join(parts)
        if END in node and parts:
            whole = f"(?:{whole})?+"  # the longer one first, and no way back
        elif len(parts) > 1:
            whole = f"(?:{whole})"
        done[id(node)] = whole
    return done[id(root)]


def any_listed(text: Column, keywords: tuple[str, ...]) -> Column:
    """Whether a text contains one of the keywords."""
    if not keywords or "" in keywords:
        return F.lit(bool(keywords)) & text.isNotNull()
    return F.rlike(text, F.lit(trie_pattern(keywords)))


def first_listed(text: Column, keywords: tuple[str, ...]) -> Column:
    """Position (from 1) in the list of the first keyword that a text contains, else 0."""
    if not keywords:
        return F.lit(0)
    rank: dict[str, int] = {}
    for i, keyword in enumerate(keywords, start=1):
        rank.setdefault(keyword, i)
    ordered = sorted(rank)
    best, chain = {}, []  # the least position of a keyword and those that it begins with
    for keyword in ordered:
        while chain and not keyword.startswith(chain[-1]):
            chain.pop()
        best[keyword] = min(rank[keyword], best[chain[-1]] if chain else rank[keyword])
        chain.append(keyword)
    by_place = sorted(best, key=best.get)
    names, places = F.array(*[F.lit(n) for n in by_place]), F.array(*[F.lit(best[n]) for n in by_place])
    found = F.regexp_extract_all(text, F.lit(f"(?=({trie_pattern(keywords)}))"), F.lit(1))
    # the first of the list that was found: by a hash table of what was found, not by a search of the list for each of it
    first = F.get(F.array_intersect(names, found), F.lit(0))
    return F.coalesce(F.get(places, F.array_position(names, first).cast("int") - 1), F.lit(0))
