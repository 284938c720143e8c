"""Schemas of the landed inputs. Readers get them explicitly; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T


def struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


S, I, L, B, D, TS = (
    T.StringType(), T.IntegerType(), T.LongType(), T.BooleanType(), T.DoubleType(), T.TimestampNTZType(),
)

# One row per fetched response.
PAGES = struct(
    page_id=L, source_id=L, final_url=S, status=I, content_type=S, charset=S, server=S, text=S, elapsed=L
)
# The given pages table.
RAW_PAGES = struct(page_id=L, url=S, html=S)
HITS = struct(
    source_id=L, book_url=S, name=S, author=S, kind=S, intro=S, cover_url=S, last_chapter=S, item_pos=I
)
EVENTS = struct(event_id=L, ts=TS, user_id=L, event_type=S, value=D, props=S)
LINEITEM = struct(
    l_orderkey=L, l_partkey=L, l_suppkey=L, l_linenumber=I, l_quantity=D, l_extendedprice=D,
    l_discount=D, l_tax=D, l_returnflag=S, l_linestatus=S, l_shipdate=TS,
)
# One row per node of a page; see operators.dom.
NODES = struct(
    page_id=L, pre=I, last=I, parent=I, depth=I, kind=S, tag=S, attrs=T.MapType(S, S), text=S,
    elem_index=I, prev_elem=I, gap=B, hide=I, skip=I, n_elems=I, type_index=I, n_type=I,
)
