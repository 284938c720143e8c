"""Scores of search hits and alternatives."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioflow.functions.text import norm_keyword, text_or_blank


def _flag(c: Column) -> Column:
    return F.when(text_or_blank(c) != "", 1).otherwise(0)


def relevance(name: Column, author: Column, cover: Column, intro: Column, last: Column, query: str) -> Column:
    """Match of a hit with the keyword on lower-cased raw text, at most 120."""
    k = query.lower().strip()
    if not k:
        return F.lit(0)
    n, a = F.lower(text_or_blank(name)), F.lower(text_or_blank(author))
    scattered = F.lit(len(k) > 1)
    for ch in sorted(set(k)):
        scattered = scattered & n.contains(ch)
    by_name = (
        F.when(n == k, 100).when(n.startswith(k), 82).when(n.contains(k), 62).when(scattered, 28).otherwise(0)
    )
    by_author = (
        F.when(a == "", 0)
        .when(a == k, 95)
        .when(a.contains(k), 52)
        .when(F.lit(k).contains(a), 30)
        .otherwise(0)
    )
    extras = _flag(cover) * 2 + _flag(intro) * 2 + _flag(last)
    return F.least(F.lit(120), by_name + by_author + extras)


def final_score(base: Column, weight: Column) -> Column:
    """Relevance plus the source weight bonus."""
    return base + F.least(F.lit(8.0), F.coalesce(weight, F.lit(0)) / F.lit(25.0))


def exact_match(name: Column, author: Column, query: str, kind: str = "all") -> Column:
    """Whether the normalised title and/or author equal the normalised query; a blank query keeps all."""
    q = norm_keyword(F.lit(query))
    n, a = norm_keyword(name) == q, norm_keyword(author) == q
    return (q == "") | {"name": n, "author": a}.get(kind, n | a)


def name_score(candidate: Column, target: Column) -> Column:
    """Title part of the match score, on normalised titles."""
    kept = F.filter(F.split(candidate, ""), lambda ch: (ch != "") & target.contains(ch))
    overlap = F.floor(30 * F.size(kept) / F.greatest(F.length(target), F.lit(1)) + 0.5).cast("int")
    return (
        F.when((candidate == "") | (target == ""), 0)
        .when(candidate == target, 70)
        .when(candidate.contains(target) | target.contains(candidate), 48)
        .otherwise(overlap)
    )


def author_score(candidate: Column, target: Column) -> Column:
    """Author part of the match score, on normalised authors."""
    return (
        F.when((candidate == "") | (target == ""), 0)
        .when(candidate == target, 25)
        .when(candidate.contains(target) | target.contains(candidate), 12)
        .otherwise(0)
    )


def total_score(by_name: Column, by_author: Column, cover: Column, intro: Column, clamp: bool = True) -> Column:
    """Match score from its parts, 0..100 when clamped; cover and intro are booleans."""
    extras = F.when(cover, 3).otherwise(0) + F.when(intro, 2).otherwise(0)
    total = by_name + by_author + extras
    return F.greatest(F.lit(0), F.least(F.lit(100), total)) if clamp else total


def match_score(
    name: Column, author: Column, cover: Column, intro: Column, target_name: Column, target_author: Column
) -> Column:
    """How well a candidate matches a book, 0..100."""
    return total_score(
        name_score(norm_keyword(name), norm_keyword(target_name)),
        author_score(norm_keyword(author), norm_keyword(target_author)),
        text_or_blank(cover) != "",
        text_or_blank(intro) != "",
    )


def richness(intro: Column, cover: Column, last: Column, kind: Column) -> Column:
    """How many of the four descriptive fields are filled."""
    return _flag(intro) + _flag(cover) + _flag(last) + _flag(kind)


def overall_percent(chapter_index: Column, pos: Column, total: Column) -> Column:
    """Share of a book that has been read, 0..1."""
    whole = F.when(F.coalesce(total, F.lit(0)) == 0, 1).otherwise(total)
    return F.least(F.greatest((chapter_index + pos) / whole, F.lit(0.0)), F.lit(1.0))
