"""The pipeline's stages against brute force, and the registered queries against their SQL."""

import hashlib
import os
import sys

import pytest
import tiktoken

SF = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path[:0] = [os.path.join(ROOT, "tests"), os.path.join(ROOT, "tests", "llm")]


def test_pipeline(spark):
    import public_tokenizers
    from test_operators import LOWER, brute_classes, words

    import corpus_pipeline
    from folioflow.llm import byte_bpe, quality
    from folioflow.llm.frames import table

    docs = table(spark, SF, "documents")
    verdict = {r.doc_id: r.kept for r in quality.score(docs.select("doc_id", "text"), quality.fit(docs, table(spark, SF, "labels"))).collect()}
    rows = [tuple(r) for r in docs.collect() if verdict[r.doc_id]]
    last = {}
    for r in rows:
        plain = r[1].translate(LOWER)
        last[plain] = max(last.get(plain, -1), r[0])
    rows = [r for r in rows if last[r[1].translate(LOWER)] == r[0]]
    groups, find = brute_classes(rows)
    rows = [r for r in rows if groups[find(tuple(words(r[1])))][0] == r[0]]
    plain = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(public_tokenizers.path(byte_bpe.VOCABULARY)), special_tokens={})
    got = corpus_pipeline.run(spark, SF).collect()
    expected = {r[0]: (r[3], r[2], plain.encode_ordinary(r[1]), hashlib.sha256(r[1].encode()).hexdigest()) for r in rows}
    assert {r.doc_id: (r.source, r.lang, list(r.ids), r.decoded_sha256) for r in got} == expected and len(got) == len(expected)


def brute_slots(sources, weights):
    """The source and number of the block of every slot, slot by slot; sources maps to numbers of blocks."""
    total, given, out, slot = sum(weights.values()), dict.fromkeys(sources, 0), {}, 0
    while any(given[s] < n for s, n in sources.items()):
        ready = [(-(-(given[s] + 1) * total // weights[s]), s is not None, str(s), s) for s, n in sources.items() if given[s] < n and given[s] * total // weights[s] <= slot]
        if ready:
            s = min(ready)[3]
            out[s, given[s]] = slot
            given[s] += 1
        slot += 1
    return out


def test_pipeline_rows_follow_the_schedule(spark, monkeypatch):
    import corpus_pipeline
    from folioflow.llm import mixing

    def runs():
        rows = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
        texts = {r.doc_id: len(r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
        sources, end = {}, {}
        for r in sorted(rows.values(), key=lambda r: (str(r.source), r.mix_offset)):
            assert r.mix_offset == end.get(r.source, 0) and r.mix_block == r.mix_offset // mixing.BLOCK
            end[r.source] = r.mix_offset + texts[r.doc_id]
            sources[r.source] = max(r.mix_block + 1, -(-end[r.source] // mixing.BLOCK))
        weights = {s: corpus_pipeline.TARGETS.get(s, corpus_pipeline.OTHERS) for s in sources}
        slots = brute_slots(sources, weights)
        assert all(r.mix_slot == slots[r.source, r.mix_block] for r in rows.values())
        return {k: r.mix_slot for k, r in rows.items()}

    monkeypatch.setattr(mixing, "BLOCK", 500)
    monkeypatch.setattr(mixing.mix, "__defaults__", (None, 500))
    first = runs()
    monkeypatch.setitem(corpus_pipeline.TARGETS, "src1", 9)
    assert runs() != first


def test_stages_keep_columns(spark):
    import corpus_pipeline
    from folioflow.llm.frames import table

    docs = table(spark, SF, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == 0


@pytest.mark.parametrize("name", ["op2_block_naming", "op4_token_rollups"])
def test_against_sql(spark, name):
    from compare import compare, duck

    from folioflow.llm.queries import ORACLE, QUERIES

    assert compare(QUERIES[name](spark, SF), duck(SF), ORACLE[name]) == ""
