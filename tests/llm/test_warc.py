"""WARC archives against the pages they were made from, and hand-made archives."""

import gzip
import hashlib
import random

import pytest

from folioflow.llm import warc

END = b"\r\n\r\n"


def pages_of():
    rng = random.Random(5)
    texts = [bytes(rng.choices(range(32, 127), k=n)).decode() for n in (0, 1, 99, 100, 101, 8192, 16384, 40000, 300000)]
    tricky = "<p>WARC/1.1\r\nWARC-Type: response\r\n\r\n5\r\nhello\r\n0\r\n\r\n" + "é漢😀" * 9000
    rows = [(k, f"http://x/{k}", t) for k, t in enumerate([*texts, tricky])]
    rows += [(100 + k, None, t) for k, t in enumerate([*texts, tricky])]
    rows += [(None, "http://x/a b\r\nc", texts[5]), (None, None, None), (200, "u", None), (201, "u", "")]
    rows += [(7, "again", texts[7]), (300, "u", "only\0here" * 30), (300, "u", "only\0here" * 30), (None, "n", "n" * 500), (None, "n", "n" * 500)]
    rows += [(1000 + k, "hot", "copied everywhere " * 40) for k in range(400)]
    return rows


def expected(rows):
    least = {}
    for page_id, _, html in rows:
        raw = (html or "").encode()
        if len(raw) >= 100 and page_id is not None:
            least[raw] = min(least.get(raw, page_id), page_id)
    out = []
    for page_id, _, html in rows:
        raw = (html or "").encode()
        first = least.get(raw)
        seen = first is not None and first != page_id
        out.append((page_id, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if seen else "response", first if seen else None))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def archives(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("warc") / "a")
    extra = "page_id long, url string, html string"
    df = spark.createDataFrame([(*r, "x", 1) for r in pages_of()], extra + ", digest string, first_id int").repartition(3)
    warc.write_archives(df, path, records=50)
    return path


def test_round_trip(spark, archives):
    rows = pages_of()
    got = warc.read_archives(spark, archives, keep=True).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == expected(rows)
    assert all(r.whole for r in got)
    sent = {hashlib.sha256((h or "").encode()).hexdigest(): (h or "").encode() for _, _, h in rows}
    assert all(bytes(r.payload) == sent[r.payload_digest] for r in got if r.record_type == "response")
    assert {r.target for r in got if r.target and r.target.startswith("http://x/a")} == {"http://x/a%20b%0D%0Ac"}


def test_records_are_bounded_and_segmented(spark, archives):
    rows = warc.read_records(spark, archives).collect()
    assert max(len(r.block) for r in rows) <= warc.SEGMENT
    assert sum(r.kind == "continuation" for r in rows) > 20
    assert len({r.id for r in rows}) == len(rows)
    # Every record is in exactly one of the two halves.
    assert len(rows) == sum(warc.read_records(spark, archives, s).count() for s in (True, False))


def test_empty(spark, tmp_path):
    path = str(tmp_path / "none")
    warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.read_archives(spark, path).count() == 0


def record(kind, name, block, *more):
    head = ["WARC/1.0", f"WARC-Type: {kind}", f"warc-record-id: <{name}>", *more, f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + END + block + END


def parts_of(name, block, cuts, total=None, skip=(), twice=()):
    edges = [0, *cuts, len(block)]
    out = []
    for n, (a, b) in enumerate(zip(edges, edges[1:]), 1):
        more = [f"WARC-Segment-Number: {n}"]
        if n > 1:
            more.append(f"WARC-Segment-Origin-ID: <{name}>")
        if b == len(block):
            more.append(f"WARC-Segment-Total-Length: {len(block) if total is None else total}")
        if n not in skip:
            one = record("response" if n == 1 else "continuation", name if n == 1 else f"{name}/{n}", block[a:b], *more)
            out += [one] * (2 if n in twice else 1)
    return out


def test_foreign_archives(spark, tmp_path):
    """Order of segments, lost and repeated ones, wrong totals, chunk extensions and trailers, plain bodies, gzip members."""
    http = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: Chunked\r\n\r\n"
    body = b"5;x=1\r\nhello\r\n1\r\n,\r\nA ; y\r\n 123\r\n\r\n89\r\n0\r\nTrailer: t\r\n\r\n"
    good = parts_of("good", http + body, [20, 60], twice=(2,))
    rng = random.Random(1)
    rng.shuffle(good)
    files = [
        [record("warcinfo", "i", b"software: none"), *good[:2], record("response", "plain", b"HTTP/1.0 200 OK\r\n\r\nas it is")],
        [*good[2:], *parts_of("lost", http + body, [20, 60], skip=(2,)), *parts_of("short", http + body, [20, 60], total=9)],
        [*parts_of("headless", http + body, [20, 60], skip=(1,)), record("response", "broken", http + b"zz\r\nhello")],
        [record("response", "lies", b"HTTP/1.0 200 OK\r\n\r\nabc", "WARC-Payload-Digest: sha256:" + "0" * 64)],
        [record("revisit", "orphan", b"", "WARC-Payload-Digest: sha256:" + "1" * 64)],
    ]
    (tmp_path / "sub").mkdir()
    for k, parts in enumerate(files):
        data = b"".join(gzip.compress(p) for p in parts) if k % 2 else b"".join(parts)
        (tmp_path / ("sub" if k == 2 else "") / f"f{k}.warc").write_bytes(data)
    got = {r.id: (r.whole, None if r.payload is None else bytes(r.payload)) for r in warc.read_archives(spark, str(tmp_path), keep=True).collect()}
    assert got == {
        "good": (True, b"hello, 123\r\n\r\n89"),
        "plain": (True, b"as it is"),
        "lost": (False, None),
        "short": (False, None),
        "broken": (False, None),
        "lies": (False, b"abc"),
        "orphan": (False, None),
    }


def test_framing():
    rng = random.Random(2)
    for n in (0, 1, 7, 8, 9, 1000):
        raw = bytes(rng.randrange(256) for _ in range(n))
        assert warc.unchunked(warc.chunked(raw, 8)) == raw
    for broken in (b"", b"5\r\nhel", b"5\r\nhelloX\r\n0\r\n\r\n", b"5\r\nhello\r\n", b"-1\r\n\r\n"):
        assert warc.unchunked(broken) is None
    with pytest.raises(ValueError):
        list(warc.parse(b"nothing here" + END))
