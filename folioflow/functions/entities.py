"""HTML entities. Used per value inside the shred job and as a column function."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Named entities that are decoded; all others stay as written.
NAMED = {
    "amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ",
    "copy": "©", "reg": "®", "trade": "™", "hellip": "…",
    "mdash": "—", "ndash": "–", "lsquo": "‘", "rsquo": "’",
    "ldquo": "“", "rdquo": "”", "bull": "•", "middot": "·",
    "times": "×", "divide": "÷", "laquo": "«", "raquo": "»",
    "deg": "°", "plusmn": "±", "sect": "§", "para": "¶",
    "euro": "€", "pound": "£", "yen": "¥", "cent": "¢",
    "larr": "←", "rarr": "→", "uarr": "↑", "darr": "↓",
    "ensp": " ", "emsp": " ", "thinsp": " ", "shy": "­", "zwnj": "‌", "zwj": "‍",
}
ENTITY = re.compile(r"&(?:#([xX])([0-9a-fA-F]+)|#([0-9]+)|([a-zA-Z][a-zA-Z0-9]{1,31}));")


def _char(m: re.Match[str]) -> str:
    _, hexed, dec, name = m.groups()
    if name:
        return NAMED.get(name, NAMED.get(name.lower(), m[0]))
    code = int(hexed, 16) if hexed else int(dec)
    return chr(code) if code <= 0x10FFFF and not 0xD800 <= code <= 0xDFFF else m[0]


def unescape(text: str) -> str:
    return ENTITY.sub(_char, text) if "&" in text else text


def unescape_html(c: Column) -> Column:
    """Decode named, decimal and hexadecimal entities, each once; unknown ones stay.

    Only texts with an ampersand are sent to Python.
    """

    @F.pandas_udf(T.StringType())
    def decode(texts: pd.Series) -> pd.Series:
        return texts.map(unescape, na_action="ignore")

    return F.coalesce(decode(F.when(c.contains("&"), c)), c)
