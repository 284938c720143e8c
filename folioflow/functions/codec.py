"""Encodings, digests and time formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioflow.functions.text import drop_space, let, text_or_blank

# Charset labels and the encoding each one stands for.
CHARSET_ALIASES = {
    "gb2312": "gbk", "gb_2312": "gbk", "gb-2312": "gbk", "x-gbk": "gbk", "cp936": "gbk", "ms936": "gbk",
    "utf8": "utf-8", "utf8mb4": "utf-8",
    "big5-hkscs": "big5", "cp950": "big5", "big-5": "big5",
    "iso-8859-1": "windows-1252", "latin1": "windows-1252",
}
# The encodings a page may be decoded from.
DECODABLE = [
    "utf-8", "utf-16le", "utf-16be", "gbk", "gb18030", "big5", "windows-1252", "windows-1251",
    "shift_jis", "euc-jp", "euc-kr", "iso-8859-2", "iso-8859-15", "koi8-r",
]
# Encodings a keyword may have to be sent in.
TRANSCODED = ["gbk", "gb18030", "big5"]


def charset_name(c: Column) -> Column:
    """Canonical charset label."""
    names = F.create_map(*[F.lit(x) for pair in CHARSET_ALIASES.items() for x in pair])
    return let(
        F.lower(F.regexp_replace(text_or_blank(c), "[\"'\\s]", "")), lambda label: F.coalesce(names[label], label)
    )


def body_charset(body: Column, content_type: Column, charset: Column) -> Column:
    """The charset of bytes without a byte order mark: given, header, markup, strict UTF-8, then GBK.

    The first of the labels that names a known encoding counts.
    """
    head = F.decode(F.substring(body, 1, 4096), "ISO-8859-1")
    labels = F.array(
        text_or_blank(charset),
        F.regexp_extract(text_or_blank(content_type), r"(?i)charset\s*=\s*[\"']?([\w-]+)", 1),
        F.regexp_extract(head, r"(?i)<meta[^>]+charset\s*=\s*[\"']?\s*([\w-]+)", 1),
        F.regexp_extract(head, r"(?i)<\?xml[^>]+encoding\s*=\s*[\"']([\w-]+)", 1),
    )
    known = F.filter(F.transform(labels, charset_name), lambda x: x.isin(*DECODABLE))
    guess = F.when(F.is_valid_utf8(body.cast("string")), "utf-8").otherwise("gbk")
    return F.coalesce(F.try_element_at(known, F.lit(1)), guess)


def decode_body(body: Column, content_type: Column, charset: Column) -> Column:
    """Bytes to text: by byte order mark, else by ``body_charset``."""
    size = F.length(body)
    return (
        F.when(body.isNull() | (size == 0), "")
        .when(F.hex(F.substring(body, 1, 3)) == "EFBBBF", F.decode(F.substring(body, F.lit(4), size), "UTF-8"))
        .when(F.hex(F.substring(body, 1, 2)) == "FFFE", F.decode(F.substring(body, F.lit(3), size), "UTF-16LE"))
        .otherwise(F.call_function("decode", body, body_charset(body, content_type, charset)))
    )


def _char_bytes(ch: Column, charset: str) -> Column:
    """Hex bytes of a character; characters the charset lacks keep their UTF-8 bytes."""
    native = F.hex(F.encode(ch, charset))
    return F.when((native == "3F") & (ch != "?"), F.hex(F.encode(ch, "UTF-8"))).otherwise(native)


def _percent(pair: Column) -> Column:
    char = F.char(F.conv(pair, 16, 10).cast("int"))
    keep = (F.conv(pair, 16, 10).cast("int") < 128) & char.rlike(r"[A-Za-z0-9\-_.!~*'()]")
    return F.when(keep, char).otherwise(F.concat(F.lit("%"), pair))


def encode_keyword(keyword: Column, charset: Column) -> Column:
    """Percent-encode a keyword in the charset its site expects."""
    text = text_or_blank(keyword)
    name = charset_name(F.regexp_replace(text_or_blank(charset), "[_]", "-"))
    letters = F.filter(F.split(text, ""), lambda x: x != "")

    def hexed(cs: str) -> Column:
        return F.array_join(F.transform(letters, lambda ch: _char_bytes(ch, cs)), "")

    pairs = F.hex(F.encode(text, "UTF-8"))
    for cs in TRANSCODED:
        pairs = F.when(name == cs, hexed(cs)).otherwise(pairs)
    return F.array_join(F.transform(F.regexp_extract_all(pairs, F.lit("(..)"), F.lit(1)), _percent), "")


def base64_encode(c: Column) -> Column:
    return F.regexp_replace(F.base64(F.encode(text_or_blank(c), "UTF-8")), r"\s", "")


def base64_decode(c: Column) -> Column:
    return F.coalesce(F.decode(F.try_to_binary(drop_space(text_or_blank(c)), F.lit("base64")), "UTF-8"), F.lit(""))


def hex_encode(c: Column) -> Column:
    return F.lower(F.hex(F.encode(text_or_blank(c), "UTF-8")))


def hex_decode(c: Column) -> Column:
    digits = F.regexp_replace(text_or_blank(c), "[^0-9a-fA-F]", "")
    even = F.substring(digits, F.lit(1), F.floor(F.length(digits) / 2).cast("int") * 2)
    return F.decode(F.unhex(even), "UTF-8")


def md5(c: Column) -> Column:
    return F.md5(F.encode(text_or_blank(c), "UTF-8"))


def sha1(c: Column) -> Column:
    return F.sha1(F.encode(text_or_blank(c), "UTF-8"))


def sha256(c: Column) -> Column:
    return F.sha2(F.encode(text_or_blank(c), "UTF-8"), 256)


def time_format(ts: Column, pattern: str = "yyyy/MM/dd HH:mm") -> Column:
    """Format Unix seconds (below 1e12) or milliseconds in the session time zone; 0 means now."""
    n = ts.cast("long")
    millis = F.when(n < 1_000_000_000_000, n * 1000).otherwise(n)
    when = F.when(F.coalesce(n, F.lit(0)) == 0, F.current_timestamp()).otherwise(F.timestamp_millis(millis))
    return F.date_format(when, pattern)
