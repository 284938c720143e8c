"""Exact dedup by deterministic block naming.

A text is lower-cased in A-Z, cut into blocks of ``BLOCK`` bytes, and the sorted distinct blocks are numbered. Adjacent
numbers are paired, the sorted distinct pairs are numbered again, and so on, until each text is one number. Numbers come
from sorting the blocks and pairs themselves, never from hashes, so two texts of one length get the same number
exactly when they are equal.

The first block of every text is named first. A text whose length and first block no other text has is identified by
that alone and goes no further. The texts of possible copies are found by a merge join at every size, compressed, and
cut into blocks behind it, so what is shuffled is in proportion to the input. Only distinct
blocks are sorted (map tasks combine them), and names return by a join that Spark can split where a block is hot.

A row is one document. Rows that repeat doc_id and text are one document and give one row that counts them all in
group_size. A null text is an empty one; a null doc_id is a value like any other and the smallest. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioflow.llm.frames import table, written
from folioflow.llm.registry import query

BLOCK = 1024
#: Bytes of the first block that are named for all texts.
HEAD = 64


def _plain(texts: pa.Array) -> list[bytes]:
    """Normalised texts: bytes.lower changes A-Z alone."""
    return [b"" if t is None else t.lower() for t in texts.cast(pa.binary()).to_pylist()]


#: What ``with_digest`` can add to the digest: Spark type, Arrow type and a function of the normalised text.
EXTRA: dict[str, tuple] = {
    "n_bytes": (T.LongType(), pa.int64(), len),
    "head": (T.BinaryType(), pa.binary(), lambda t: t[:HEAD]),
    "packed": (T.BinaryType(), pa.binary(), lambda t: zstandard.ZstdCompressor(level=3).compress(t)),
}


def with_digest(docs: DataFrame, *keep: str, extra: tuple[str, ...] = ()) -> DataFrame:
    """The kept columns, the SHA-256 of the normalised text as ``_digest``, and columns of ``EXTRA``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), 256):
                part = batch.slice(lo, 256)
                texts = _plain(part.column(0))
                columns = part.columns[1:] + [pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary())]
                columns += [pa.array([EXTRA[name][2](t) for t in texts], EXTRA[name][1]) for name in extra]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    rows = docs.select(F.col("text").alias("_text"), *keep)
    schema = T.StructType([*rows.schema.fields[1:], T.StructField("_digest", T.BinaryType()), *(T.StructField(n, EXTRA[n][0]) for n in extra)])
    names = schema.names
    return rows.mapInArrow(run, schema)


def _blocks(texts: DataFrame) -> DataFrame:
    """member, pos and block of every text (member, packed); an empty text has one empty block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        rows: list[tuple] = []
        for batch in batches:
            for member, packed in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = unpack(packed.as_py())
                for pos, k in enumerate(range(0, max(len(text), 1), BLOCK)):
                    rows.append((member, pos, text[k : k + BLOCK]))
                    if len(rows) == 4096:
                        yield batch_of(rows)
                        rows = []
        if rows:
            yield batch_of(rows)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.binary()))]
        return pa.RecordBatch.from_arrays(columns, names=["member", "pos", "block"])

    return texts.select("member", "packed").mapInArrow(run, "member long, pos int, block binary")


def numbered(values: DataFrame, *columns: str) -> DataFrame:
    """Distinct values in sorted order with integer names; written, because names must not change on a re-run."""
    ordered = values.select(*columns).distinct().repartitionByRange(*columns).sortWithinPartitions(*columns)
    return written(ordered.withColumn("name", F.monotonically_increasing_id()), "names")


def identities(texts: DataFrame) -> DataFrame:
    """member and name: the final name of each text (member, packed). Texts of one length are comparable."""
    blocks = written(_blocks(texts), "blocks")
    level = blocks.join(numbered(blocks, "block"), "block").select("member", "pos", "name").distinct()
    done: DataFrame | None = None
    while True:
        level = written(level, "level")
        sizes = level.groupBy("member").agg(F.max("pos").alias("last"), F.max("name").alias("name"))
        single = sizes.filter("last = 0").select("member", "name")
        done = single if done is None else done.unionByName(single)
        rest = level.join(sizes.filter("last > 0").select("member"), "member", "left_semi")
        pairs = rest.groupBy("member", F.expr("pos div 2").alias("half")).agg(
            F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("a"),
            F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(-1)).alias("b"),
        )
        pairs = written(pairs, "pairs")
        if pairs.isEmpty():
            return done
        level = pairs.join(numbered(pairs, "a", "b"), ["a", "b"]).select("member", F.col("half").alias("pos"), "name")


def exact_groups(docs: DataFrame) -> DataFrame:
    """One row for each distinct (doc_id, normalised text): doc_id, digest, copies, keep_id, group_size, kept.

    Of equal texts the row with the largest doc_id stays; copies counts the rows that are this document. ``docs`` needs
    doc_id and text. An empty table gives an empty one.
    """
    plain = docs.select(F.col("doc_id").cast("long"), "text")
    heads = with_digest(plain, "doc_id", extra=("n_bytes", "head"))
    heads = written(heads.groupBy("doc_id", "_digest", "n_bytes", "head").agg(F.count("*").alias("copies")), "heads")
    shared = heads.groupBy("n_bytes", "head").agg(F.count("*").alias("rows")).filter("rows > 1").drop("rows")
    possible = heads.join(written(shared, "shared"), ["n_bytes", "head"]).drop("head")
    possible = written(possible.withColumn("member", F.monotonically_increasing_id()), "possible")
    keys = possible.select(F.col("doc_id").alias("_id"), F.col("_digest").alias("_key"), "member")
    texts = with_digest(plain, "doc_id", extra=("packed",))
    wanted = texts.join(keys.hint("merge"), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_digest") == F.col("_key")))
    named = written(possible.join(identities(wanted.select("member", "packed")), "member"), "named")
    groups = named.groupBy("n_bytes", "name").agg(F.max("doc_id").alias("keep_id"), F.sum("copies").alias("group_size"))
    members = named.join(written(groups, "groups"), ["n_bytes", "name"])
    members = members.select(F.col("doc_id").alias("_id"), F.col("_digest").alias("_key"), "keep_id", "group_size")
    rows = heads.join(members, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_digest") == F.col("_key")), "left")
    grouped = F.col("group_size").isNotNull()
    keep = F.when(grouped, F.col("keep_id")).otherwise(F.col("doc_id"))
    return rows.select(
        "doc_id",
        F.col("_digest").alias("digest"),
        "copies",
        keep.alias("keep_id"),
        F.when(grouped, F.col("group_size")).otherwise(F.col("copies")).alias("group_size"),
        keep.eqNullSafe(F.col("doc_id")).alias("kept"),
    )


def stage(docs: DataFrame) -> DataFrame:
    """The rows whose text stays, once each, with the columns they came with."""
    groups = written(exact_groups(docs), "exact")
    kept = groups.filter("kept").select(F.col("doc_id").alias("_id"), F.col("digest").alias("_key"))
    columns = docs.columns
    inner = docs.toDF(*(f"in_{k}" for k in range(len(columns))))
    number = f"in_{columns.index('doc_id')}"
    rows = with_digest(inner.withColumn("text", F.col(f"in_{columns.index('text')}")), *inner.columns)
    rows = rows.join(kept, F.col(number).cast("long").eqNullSafe(F.col("_id")) & (F.col("_digest") == F.col("_key")), "left_semi")
    if not groups.filter("copies > 1").isEmpty():
        rows = rows.dropDuplicates([number, "_digest"])
    return rows.select(*(F.col(f"in_{k}").alias(c) for k, c in enumerate(columns)))


SQL = """
with t as (select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as plain from documents),
g as (select plain, max(doc_id) as keep_id, count(*) as group_size from t group by plain)
select t.doc_id, g.keep_id, cast(g.group_size as bigint) as group_size, t.doc_id = g.keep_id as kept, sha256(t.plain) as text_sha256
from t join g on t.plain = g.plain
"""


@query("op2_block_naming", SQL)
def op2(spark, sf_dir):
    return exact_groups(table(spark, sf_dir, "documents")).select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")
    )
