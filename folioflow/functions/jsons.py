"""JSON operators on variant columns. A path is a chain of steps, built in Python."""

from __future__ import annotations

import json
import math
import re
from collections.abc import Callable, Iterator
from json.decoder import scanstring

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioflow.functions.lists import pick_at, pick_slice
from folioflow.functions.text import let, strip_space, text_or_blank

Step = Callable[[Column], Column]


def is_json(c: Column) -> Column:
    """Whether a text is exactly one JSON value.

    The parser stops after the first value. Wrapped as an array item and as a member, text
    with anything after that value does not parse to the wrapped form in both cases.
    """
    item = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), c, F.lit("]"))), "$", "array<variant>")
    member = F.try_parse_json(F.concat(F.lit('{"a":'), c, F.lit("}")))
    return F.coalesce((F.size(item) == 1) & member.isNotNull(), F.lit(False))


def parse(c: Column) -> Column:
    return F.when(is_json(c), F.try_parse_json(c))


# Stands behind a text that is parsed, as a second item; no JSON token by itself.
END = "~end of text~"


def _whole_value(c: Column) -> Column:
    """The value of a text that is exactly one JSON value, else NULL: as ``is_json`` and parsing, with one parse.

    The second item is where it should be only if the text is one item; a text that holds the mark itself is tested by ``is_json``.
    """
    both = F.try_parse_json(F.concat(F.lit("["), c, F.lit(f',"{END}"]')))
    one = let(both, lambda v: F.when(F.try_variant_get(v, "$[1]", "string") == END, F.try_variant_get(v, "$[0]", "variant")))
    ends = [c.startswith(a) & ~c.endswith(b) for a, b in ("{}", "[]")]
    hopeless = ends[0] | ends[1] | c.rlike(r"^[A-Za-z&&[^tfnNI]]")
    return F.when(c.contains(END), parse(c)).when(~hopeless, one)


def parse_json_loose(c: Column) -> Column:
    """Parse JSON; when that fails cut what stands before the first and after the last bracket."""

    def trim(x: Column) -> Column:
        return F.regexp_extract(x, r"(?s)^(.*[\]}])", 1)

    def first_valid(s: Column) -> Column:
        head = F.regexp_extract(s, r"(?s)([\[{].*)$", 1)
        # Each form is cut and parsed only if the one before is no JSON.
        return F.coalesce(_whole_value(s), *[let(x, _whole_value) for x in (trim(s), head, trim(head))])

    return let(strip_space(text_or_blank(c)), first_valid)


def _items(node: Column) -> Column:
    return F.try_variant_get(node, "$", "array<variant>")


def _values(node: Column) -> Column:
    return F.map_values(F.try_variant_get(node, "$", "map<string,variant>"))


def _member(node: Column, name: str) -> Column:
    return F.try_variant_get(node, f"$[{_quoted(name)}]", "variant")


def _quoted(name: str) -> str:
    return '"' + name.replace("\\", "\\\\").replace('"', '\\"') + '"'


def _none() -> Column:
    return F.array().cast("array<variant>")


def _each(fn: Callable[[Column], Column]) -> Step:
    """Lift a node -> array function over the current node list."""
    return lambda nodes: F.flatten(F.transform(nodes, lambda n: F.coalesce(fn(n), _none())))


def key(name: str) -> Step:
    """Member of an object; on an array, the member of every item that has it."""

    def one(n: Column) -> Column:
        return F.filter(F.array(_member(n, name)), lambda v: v.isNotNull())

    step = _each(lambda n: F.coalesce(F.flatten(F.transform(_items(n), one)), one(n)))
    step.member = _quoted(name)
    return step


def _straight(steps: tuple[Step, ...]) -> str | None:
    """The path of steps that are members only; it leads from objects to one node or to none."""
    names = [getattr(step, "member", None) for step in steps]
    return None if not names or None in names else "$" + "".join(f"[{n}]" for n in names)


def index(n: int) -> Step:
    """Item of an array, or the n-th value of an object."""
    return _each(lambda node: pick_at(F.coalesce(_items(node), _values(node)), n))


def span(start: int | None = None, end: int | None = None) -> Step:
    return _each(lambda node: pick_slice(_items(node), start, end))


def union(*positions: int) -> Step:
    return _each(lambda node: F.concat(*[pick_at(_items(node), n) for n in positions]))


def wildcard() -> Step:
    return _each(lambda node: F.coalesce(_items(node), _values(node)))


def where(test: Callable[[Column], Column]) -> Step:
    """Keep the items (or member values) that pass the test."""
    return _each(lambda node: F.filter(F.coalesce(_items(node), _values(node)), test))


def json_path(v: Column, *steps: Step) -> Column:
    """All nodes the steps lead to, as an array; NULL when there are none."""
    def walked(v: Column) -> Column:
        nodes = F.filter(F.array(v), lambda x: x.isNotNull())
        for step in steps:
            nodes = step(nodes)
        return let(nodes, lambda n: F.when(F.size(n) > 0, n))

    straight = _straight(steps)
    if straight is None:
        return walked(v)
    # Members of objects are one look; arrays on the way are walked step by step.
    one = lambda v: let(F.try_variant_get(v, straight, "variant"), lambda x: F.when(x.isNotNull(), F.array(x)))
    return let(v, lambda v: F.coalesce(one(v), walked(v)))


def as_text(node: Column) -> Column:
    """A scalar as text, anything else as JSON."""
    return F.coalesce(F.try_variant_get(node, "$", "string"), F.to_json(node))


def path_text(v: Column, *steps: Step) -> Column:
    """The only node a path leads to as text, several nodes as a JSON array, none as blank."""

    def show(nodes: Column) -> Column:
        many = F.concat(F.lit("["), F.array_join(F.transform(nodes, lambda x: F.to_json(x)), ","), F.lit("]"))
        return (
            F.when(nodes.isNull(), "").when(F.size(nodes) == 1, let(F.element_at(nodes, 1), as_text)).otherwise(many)
        )

    walked = let(json_path(v, *steps), show)
    straight = _straight(steps)
    # A member that is there and not null is read at once; ``v`` should be a column then, as it stands here twice.
    return walked if straight is None else F.coalesce(F.try_variant_get(v, straight, "string"), walked)


def field(node: Column, name: str) -> Column:
    return F.try_variant_get(node, f'$["{name}"]', "string")


def loose_eq(value: Column, other: str | float | bool) -> Column:
    """Equality that does not tell numbers from their text."""
    text = F.lit(str(other).lower() if isinstance(other, bool) else str(other))
    same = value == text
    if isinstance(other, (int, float)) and not isinstance(other, bool):
        same = same | F.coalesce(value.try_cast("double") == F.lit(float(other)), F.lit(False))
    return F.coalesce(same, F.lit(False))


def compare(value: Column, op: str, other: str | float | bool) -> Column:
    """``== = != <> > >= < <= =~`` with loose equality and numeric order."""
    if op in ("==", "="):
        return loose_eq(value, other)
    if op in ("!=", "<>"):
        return ~loose_eq(value, other)
    if op == "=~":
        return F.coalesce(value.rlike(str(other).strip("/")), F.lit(False))
    a, b = value.try_cast("double"), F.lit(float(other))
    out = {">": a > b, ">=": a >= b, "<": a < b, "<=": a <= b}[op]
    return F.coalesce(out, F.lit(False))


def exists(node: Column, name: str) -> Column:
    """Present and truthy: not null, false, zero or blank."""
    raw = _member(node, name)
    text = F.coalesce(F.to_json(raw), F.lit(""))
    return ~text.isin("", "null", "false", "0", '""', "[]")


_BLANK = re.compile(r"[ \t\n\r]*")
_NUMBER = re.compile(r"-?(?:0|[1-9]\d*)(\.\d+)?([eE][-+]?\d+)?")
_WORDS = {"null": None, "true": True, "false": False, "NaN": math.nan, "Infinity": math.inf, "-Infinity": -math.inf}


def parse_deep(text: str) -> object:
    """A JSON text of any depth: open containers stand on a list, so nothing recurses. As ``json.loads`` otherwise."""

    def fail(at: int) -> ValueError:
        return ValueError(f"no JSON at {at}")

    def blank(at: int) -> int:
        return _BLANK.match(text, at).end()

    def scalar(at: int) -> tuple[object, int]:
        if text[at : at + 1] == '"':
            return scanstring(text, at + 1, True)
        for word, value in _WORDS.items():
            if text.startswith(word, at):
                return value, at + len(word)
        m = _NUMBER.match(text, at)
        if not m:
            raise fail(at)
        return (float(m[0]) if m[1] or m[2] else int(m[0])), m.end()

    def key(at: int) -> tuple[str, int]:
        at = blank(at)
        if text[at : at + 1] != '"':
            raise fail(at)
        name, at = scanstring(text, at + 1, True)
        at = blank(at)
        if text[at : at + 1] != ":":
            raise fail(at)
        return name, blank(at + 1)

    open_: list[tuple[object, str | None]] = []  # containers and the member being read
    name: str | None = None
    at = blank(0)
    while True:
        first = text[at : at + 1]
        if first in ("{", "["):
            new: object = {} if first == "{" else []
            inner = blank(at + 1)
            if text[inner : inner + 1] != "}]"[first == "["]:
                open_.append((new, name))
                name, at = key(inner) if first == "{" else (None, inner)
                continue
            value, at = new, inner + 1
        else:
            value, at = scalar(at)
        # Put the value where it belongs, and close what ends here.
        while open_:
            holder, outer = open_[-1]
            if isinstance(holder, dict):
                holder[name] = value
            else:
                holder.append(value)
            at = blank(at)
            mark = text[at : at + 1]
            if mark == ",":
                name, at = key(at + 1) if isinstance(holder, dict) else (None, blank(at + 1))
                break
            if mark != ("}" if isinstance(holder, dict) else "]"):
                raise fail(at)
            open_.pop()
            value, name, at = holder, outer, at + 1
        else:
            if blank(at) != len(text):
                raise fail(at)
            return value


def dump_deep(value: object) -> str:
    """The text of a JSON value of any depth, as ``json.dumps`` with plain characters writes it."""
    out: list[str] = []
    todo: list[object] = [iter([("", value)])]
    ends: list[str] = [""]
    while todo:
        head, item = next(todo[-1], (None, None))
        if head is None:
            todo.pop()
            out.append(ends.pop())
            continue
        out.append(head)
        if isinstance(item, dict):
            out.append("{")
            todo.append((f"{', ' if i else ''}{json.dumps(k, ensure_ascii=False)}: ", v) for i, (k, v) in enumerate(item.items()))
            ends.append("}")
        elif isinstance(item, list):
            out.append("[")
            todo.append((", " if i else "", v) for i, v in enumerate(item))
            ends.append("]")
        else:
            out.append(json.dumps(item, ensure_ascii=False))
    return "".join(out)


def json_recursive(c: Column, name: str) -> Column:
    """Values of every member called ``name`` at any depth, in document order, as JSON texts.

    Column expressions cannot recurse, so each Arrow batch goes through a short descent, which keeps its own stack: texts
    nested deeper than the interpreter can recurse are read and written the same. Texts that are no JSON give an empty list.
    """

    def descend(value: object) -> Iterator[object]:
        stack: list[Iterator] = [iter([(None, value)])]
        while stack:
            k, item = next(stack[-1], (None, stack))
            if item is stack:  # this level is done
                stack.pop()
                continue
            if k is not None and k == name:
                yield item
            if isinstance(item, dict):
                stack.append(iter(item.items()))
            elif isinstance(item, list):
                stack.append(iter([(None, x) for x in item]))

    def read(text: str) -> object:
        try:
            return json.loads(text)
        except RecursionError:
            return parse_deep(text)

    def write(value: object) -> str:
        try:
            return json.dumps(value, ensure_ascii=False)
        except RecursionError:
            return dump_deep(value)

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def collect(texts: pd.Series) -> pd.Series:
        def one(text: str | None) -> list[str]:
            try:
                return [write(v) for v in descend(read(text or "null"))]
            except ValueError:
                return []

        return texts.map(one)

    return collect(c)


def merge_json(base: Column, patch: Column, schema: T.StructType) -> Column:
    """Deep merge over a known schema: objects recurse, other values are replaced, nulls are ignored."""

    def merge(a: Column, b: Column, struct: T.StructType) -> Column:
        parts = []
        for f in struct.fields:
            x, y = a[f.name], b[f.name]
            inner = merge(x, y, f.dataType) if isinstance(f.dataType, T.StructType) else F.coalesce(y, x)
            parts.append(inner.alias(f.name))
        return F.struct(*parts)

    return merge(F.from_json(base, schema), F.from_json(patch, schema), schema)
