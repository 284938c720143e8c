"""Text normalisers. All of them are built-in expressions, so they stay in code generation."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# White space as browsers define it. Java's \s lacks the no-break and ideographic spaces.
SPACE = r"\t\n\x{0b}\f\r \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}"

# The same characters one by one, for trim and translate, which are far faster than a regex.
SPACE_CHARS = (
    "\t\n\x0b\f\r \u00a0\u1680" + "".join(chr(c) for c in range(0x2000, 0x200B)) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
)

# Full-width forms U+FF01..U+FF5E and the half-width forms they fold to.
FULL_WIDTH = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
HALF_WIDTH = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F))

# Punctuation ignored when keywords are compared.
KEYWORD_PUNCTUATION = "《》<>【】[]()（）［］{}:：·.,，、!！?？'\"“”‘’-_—/\\|~"
# Wrappers ignored when titles are compared.
TITLE_WRAPPERS = "《》〈〉「」『』【】[]"
# Punctuation ignored by the strict merge key.
MERGE_PUNCTUATION = "[]【】《》〈〉「」『』()（）·、,，.。:：!！?？\"'—-"

# Tests for advertising and navigation lines of at most 80 characters.
AD_LINE_PATTERNS = [
    r"^(?:天才一秒记住|一秒记住|请记住本站|记住本站|本站域名|本书首发|首发地址|最新网址|永久网址|手机用户请|手机版请|手机阅读请|请浏览|本章未完|点击下一页|继续阅读)",
    r"(?:请记住本站|记住本书首发域名|一秒记住本站|天才一秒记住|最新章节请|无弹窗全文阅读|手机用户请浏览|手机版阅读网址|本章未完，请点击|内容未完，请点击)",
    r"^(?:上一章|下一章|上一页|下一页|返回目录|返回书页|目[" + SPACE + r"]*录|章节目录|加入书签|推荐本书|投推荐票|求收藏|求推荐票|求月票|求打赏|笔趣阁|全文阅读|手机阅读)[" + SPACE + r":：,，、]*$",
    r"(?i)^(?:www\.|m\.|wap\.)[A-Za-z0-9_-]+\.(?:com|cn|net|org|cc|me|top|xyz|info|la|tv)",
    r"(?i)^(?:https?://|ftp://)[^" + SPACE + r"]+$",
    r"(?i)(?:www\.[A-Za-z0-9_-]+\.(?:com|cn|net|org|cc|top|xyz|info))",
    r"^(?:小说|本书|更多精校|更多章节|免费阅读|全集下载|txt下载|电子书下载)",
    r"(?:记住我们的网址|收藏本站|把本站加入收藏|按Ctrl\+D)",
    r"^(?:第[一二三四五六七八九十百千0-9]+[章节卷])?[" + SPACE + r"]*[（(【\[]?(?:求票|求订阅|加更|公告)[）)】\]]?$",
    r"^[" + SPACE + r"\-—=*~·。#>_+]{3,}$",
    r"^&nbsp;?$",
]
AD_LINE_MAX = 80

CJK = r"\x{4e00}-\x{9fff}\x{3400}-\x{4dbf}"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind a value once, so that an expression that uses it several times stays small."""
    return F.element_at(F.transform(F.array(value), lambda x: body(x)), 1)


def char_class(chars: str) -> str:
    """A regex class matching any of the given characters."""
    return "[" + "".join("\\" + c if c in r"\[]^-&" else c for c in chars) + "]"


def strip_space(c: Column) -> Column:
    """Remove white space (browser definition) at both ends."""
    return F.btrim(c, F.lit(SPACE_CHARS))


def drop_chars(c: Column, chars: str) -> Column:
    return F.translate(c, chars, "")


def drop_space(c: Column) -> Column:
    return drop_chars(c, SPACE_CHARS)


def one_space(c: Column, chars: str) -> Column:
    """Turn runs of the given characters and blanks into one blank."""
    return F.regexp_replace(F.translate(c, chars, " " * len(chars)), " {2,}", " ")


def text_or_blank(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def not_blank(c: Column) -> Column:
    return strip_space(text_or_blank(c)) != ""


def norm_keyword(c: Column) -> Column:
    """Fold full-width forms, drop white space and punctuation, lower-case."""
    kept = {f: h for f, h in zip(FULL_WIDTH, HALF_WIDTH) if h not in KEYWORD_PUNCTUATION}
    dropped = [x for x in dict.fromkeys(FULL_WIDTH + SPACE_CHARS + KEYWORD_PUNCTUATION) if x not in kept]
    return F.lower(F.translate(text_or_blank(c), "".join(kept) + "".join(dropped), "".join(kept.values())))


def norm_title(c: Column) -> Column:
    """Drop title wrappers and white space, lower-case."""
    return F.lower(drop_chars(text_or_blank(c), SPACE_CHARS + TITLE_WRAPPERS))


def clean_author(c: Column) -> Column:
    """Drop the author label in front and one author mark at the end, collapse white space."""
    out = F.regexp_replace(text_or_blank(c), r"\r?\n+", " ")
    out = F.regexp_replace(out, f"^[{SPACE}]*作[{SPACE}]*者[{SPACE}]*[:：][{SPACE}]*", "")
    out = F.regexp_replace(out, f"^[{SPACE}]*著[{SPACE}]*者[{SPACE}]*[:：][{SPACE}]*", "")
    # \z and not $: a dollar sign also matches before a final line feed in Java.
    out = F.regexp_replace(out, rf"[{SPACE}]*[著作]\z", "")
    # Words of printable ASCII with single blanks between them are clean as they are.
    return F.when(text_or_blank(c).rlike(r"[^!-~ ]|^ |  | \z"), strip_space(one_space(out, SPACE_CHARS))).otherwise(text_or_blank(c))


def author_key(c: Column) -> Column:
    return norm_keyword(clean_author(c))


def dedupe_key(name: Column, author: Column) -> Column:
    """Strict merge key of a title and an author."""

    def norm(x: Column) -> Column:
        return F.lower(drop_chars(text_or_blank(x), SPACE_CHARS + MERGE_PUNCTUATION))

    return F.concat(norm(name), F.lit("::"), norm(author))


def tidy(c: Column) -> Column:
    """Collapse white space, including no-break and ideographic spaces, to single spaces."""
    return strip_space(one_space(text_or_blank(c), "\t\n\r\f\x0b\u00a0\u3000"))


def escape_html(c: Column) -> Column:
    out = text_or_blank(c)
    for raw, safe in [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")]:
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return out


def count_words(c: Column) -> Column:
    """CJK characters plus runs of ASCII letters and digits between them."""
    text = text_or_blank(c)
    return F.regexp_count(text, F.lit(f"[{CJK}]")) + F.regexp_count(text, F.lit("[A-Za-z0-9]+"))


def is_ad_line(c: Column, extra: list[str] | None = None) -> Column:
    """True for blank lines and for short lines that look like advertising or navigation."""
    pattern = "|".join(f"(?:{p})" for p in [*(extra or []), *AD_LINE_PATTERNS])
    return let(
        strip_space(text_or_blank(c)),
        lambda line: (line == "") | ((F.length(line) <= AD_LINE_MAX) & line.rlike(pattern)),
    )


def split_long(c: Column, limit: int = 20000) -> Column:
    """Pack lines greedily into pieces of at most ``limit``; a longer single line stays whole."""
    text = text_or_blank(c)
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("cur"))

    def step(acc: Column, line: Column) -> Column:
        full = (acc["cur"] != "") & (F.length(acc["cur"]) + F.length(line) + 1 > limit)
        return F.struct(
            F.when(full, F.array_append(acc["done"], acc["cur"])).otherwise(acc["done"]).alias("done"),
            F.when(full | (acc["cur"] == ""), line)
            .otherwise(F.concat(acc["cur"], F.lit("\n"), line))
            .alias("cur"),
        )

    def finish(acc: Column) -> Column:
        return F.when(acc["cur"] != "", F.array_append(acc["done"], acc["cur"])).otherwise(acc["done"])

    return F.when(F.length(text) <= limit, F.array(text)).otherwise(
        F.aggregate(F.split(text, "\n"), start, step, finish)
    )


def fold_script(c: Column, pairs: dict[str, str]) -> Column:
    """Map characters one to one, e.g. traditional to simplified forms.

    ``pairs`` is a parameter: deployments bring their own table.
    """
    keep = {a: b for a, b in pairs.items() if len(a) == 1 and len(b) == 1 and a != b}
    return F.translate(text_or_blank(c), "".join(keep), "".join(keep.values())) if keep else text_or_blank(c)


def first_nonempty(*parts: Column) -> Column:
    """The first part that is not blank, else an empty string."""
    return F.coalesce(*[F.when(not_blank(p), p.cast("string")) for p in parts], F.lit(""))


def concat_lines(*parts: Column) -> Column:
    """Non-empty parts joined by line feeds."""
    return F.concat_ws("\n", *[F.nullif(text_or_blank(p), F.lit("")) for p in parts])


def chars(c: Column) -> Column:
    """The characters of a string as an array."""
    return F.filter(F.split(text_or_blank(c), ""), lambda x: x != "")


def parts_of_lengths(rows: DataFrame, others: DataFrame, keys: list[str], text: str, part: str) -> DataFrame:
    """The rows with every distinct substring of ``text`` that is as long as some ``part`` of the others with the same keys.

    A substring of any other length has no equal among them. Each length is a row of its own before substrings are
    made, so a text of n characters never holds more than n substrings at a time.
    """
    lengths = others.select(*keys, F.length(part).alias("_n")).filter("_n > 0").distinct()
    fitting = rows.join(lengths, keys).filter(F.length(text) >= F.col("_n"))
    starts = F.sequence(F.lit(1), F.length(text) - F.col("_n") + 1)
    made = F.array_distinct(F.transform(starts, lambda i: F.substring(F.col(text), i, F.col("_n"))))
    return fitting.withColumn(part, F.explode(made)).drop("_n")


def interleave_chars(a: Column, b: Column) -> Column:
    """Alternate the characters of two strings, the longer one first."""
    a, b = text_or_blank(a), text_or_blank(b)
    swap = F.length(a) < F.length(b)
    first, second = F.when(swap, b).otherwise(a), F.when(swap, a).otherwise(b)
    return F.array_join(
        F.zip_with(chars(first), chars(second), lambda x, y: F.concat(text_or_blank(x), text_or_blank(y))), ""
    )


def regex_chain(c: Column, rules: list[tuple[str, str]]) -> Column:
    """Apply ``(pattern, replacement)`` pairs in order; patterns that do not compile are skipped.

    In a replacement ``$1`` to ``$99`` stand for groups that the pattern has, ``$&`` for the match and ``$$`` for a dollar
    sign; everything else is plain text.
    """
    out = text_or_blank(c)
    for pattern, replacement in rules:
        groups = pattern_groups(pattern) if pattern else None
        if groups is not None:
            out = F.regexp_replace(out, pattern, java_replacement(replacement or "", groups))
    return out


def java_replacement(text: str, groups: int) -> str:
    """A replacement text in the notation of the engine that runs it, for a pattern with so many groups."""
    out, i = [], 0
    while i < len(text):
        c, i = text[i], i + 1
        if c != "$":
            # A digit after a group must not become part of its number.
            after_group = bool(out) and re.fullmatch(r"\$\d+", out[-1]) is not None
            out.append("\\" + c if c == "\\" or (c.isdigit() and after_group) else c)
            continue
        two, one = text[i : i + 2], text[i : i + 1]
        if one == "$":
            out.append("\\$")
            i += 1
        elif one == "&":
            out.append("$0")
            i += 1
        elif re.fullmatch("[0-9]{2}", two) and 1 <= int(two) <= groups:
            out.append("$" + str(int(two)))
            i += 2
        elif re.fullmatch("[1-9]", one) and int(one) <= groups:
            out.append("$" + one)
            i += 1
        else:
            out.append("\\$")
    return "".join(out)


def pattern_groups(pattern: str) -> int | None:
    """The number of groups of a pattern, or None if it does not compile in the engine that will run it.

    Asks the driver's JVM, so a classic session is needed, not Spark Connect.
    """
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    if spark is None:
        return re.compile(pattern).groups
    try:
        return spark.sparkContext._jvm.java.util.regex.Pattern.compile(pattern).matcher("").groupCount()
    except Exception:  # the driver-side check reports any syntax error the same way
        return None
