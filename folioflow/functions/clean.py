"""Cleaning of chapter text."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioflow.functions.text import drop_space, is_ad_line, java_replacement, let, one_space, pattern_groups, strip_space, text_or_blank

HTML_MARK = r"<[a-zA-Z!/][^>]*>"


def apply_replace_rules(text: Column, rules: str) -> Column:
    """Apply a source's ``pattern##replacement`` lines, ignoring case.

    A line that starts with ``##`` has an empty pattern and is skipped. A pattern that
    does not compile is taken literally.
    """
    out = text
    for line in re.split(r"\r?\n", rules or ""):
        if "##" not in line:
            continue
        pattern, rest = line.split("##", 1)
        replacement = rest.split("##", 1)[0]
        if not pattern:
            continue
        groups = pattern_groups(pattern)
        if groups is not None:
            out = F.regexp_replace(out, "(?i)" + pattern, java_replacement(replacement, groups))
        else:
            out = F.replace(out, F.lit(pattern), F.lit(replacement))
    return out


def plain_lines(text: Column) -> Column:
    """Lines of a text without markup: a few entities decoded, blanks collapsed, empty lines dropped."""
    plain = F.regexp_replace(text, "(?i)&nbsp;", " ")
    for entity, char in [("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")]:
        plain = F.regexp_replace(plain, "(?i)" + entity, char)
    out = F.when(text.contains("&"), plain).otherwise(text)
    out = F.when(text.contains("\r"), F.regexp_replace(out, r"\r\n?", "\n")).otherwise(out)
    lines = F.transform(F.split(out, "\n"), lambda x: strip_space(one_space(x, "\t\f\x0b")))
    return F.filter(lines, lambda x: x != "")


def clean_lines(lines: Column, aliases: list[Column] = (), ad_patterns: list[str] | None = None) -> Column:
    """Drop title repeats at the top and advertising lines, then join.

    A line equal to a title alias is dropped while at most one line has been kept. That is
    every alias line before the second other line, so no running state is needed.
    """
    trimmed = F.filter(F.transform(lines, strip_space), lambda x: x != "")
    kept = F.filter(trimmed, lambda x: ~is_ad_line(x, ad_patterns))
    if aliases:
        names = F.filter(F.array(*[strip_space(text_or_blank(a)) for a in aliases]), lambda a: a != "")
        marked = let(
            names,
            lambda ns: F.transform(
                kept,
                lambda x: F.struct(
                    x.alias("line"), F.exists(ns, lambda a: (x == a) | (drop_space(x) == drop_space(a))).alias("is_alias")
                ),
            ),
        )

        def drop_aliases(ms: Column) -> Column:
            others = F.filter(F.transform(ms, lambda m, i: F.when(~m["is_alias"], i)), lambda i: i.isNotNull())
            second = F.coalesce(F.try_element_at(others, F.lit(2)), F.size(ms))
            return let(second, lambda s: F.filter(ms, lambda m, i: (i >= s) | ~m["is_alias"]))

        kept = F.transform(let(marked, drop_aliases), lambda m: m["line"])
    return strip_space(F.regexp_replace(F.array_join(kept, "\n"), r"\n{3,}", "\n\n"))


def clean_plain(
    text: Column, aliases: list[Column] = (), replace_rules: str = "", ad_patterns: list[str] | None = None
) -> Column:
    """Clean a text without markup; texts with markup go through the node table first."""
    ready = apply_replace_rules(text_or_blank(text), replace_rules)
    return clean_lines(plain_lines(ready), list(aliases), ad_patterns)
