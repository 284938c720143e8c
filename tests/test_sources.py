"""Definition files that are read in byte ranges."""

import json
import random

import pytest

from folioflow.sources.definitions import read_source_arrays


def some(rng, depth=2):
    """Values with everything that could be taken for a border of items."""
    text = rng.choice(["a,b", "[{", "}]", 'say "x", ok', "back\\slash\\", "\\\\", "é漢😀,", "", "\n,\t", '"', '\\",{"', "plain " * 30])
    if depth and rng.random() < 0.5:
        return rng.choice([[some(rng, depth - 1) for _ in range(rng.randint(0, 3))], {text: some(rng, depth - 1), "k": some(rng, depth - 1)}])
    return rng.choice([text, 1, -2.5, None, True])


@pytest.mark.parametrize("size", [900, 1_000_000])
def test_one_array_in_many_ranges(spark, tmp_path, size):
    rng = random.Random(size)
    files = {}
    for k, (indent, form) in enumerate([(None, "{}"), (2, "{}"), (None, "﻿ {} \n"), (None, '{{"bookSources": {}}}')]):
        items = [{"name": f"n{i}", "x": some(rng), "y": [some(rng) for _ in range(rng.randint(0, 3))]} if rng.random() < 0.9 else some(rng) for i in range(40 if k else 80)]
        folder = tmp_path / ("wrapped" if k == 3 else "plain")
        folder.mkdir(exist_ok=True)
        (folder / f"f{k}.json").write_text(form.format(json.dumps(items, indent=indent, ensure_ascii=bool(k % 2))), encoding="utf-8")
        files[f"f{k}.json"] = items
    for name, text in (("e0.json", "[]"), ("e1.json", ""), ("e2.json", "[ ]\n"), ("e3.json", '[{"name": "one"}]')):
        (tmp_path / "plain" / name).write_text(text)
    files["e3.json"] = [{"name": "one"}]
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(k) for k in keys]
    spark.conf.set(keys[0], str(size))
    spark.conf.set(keys[1], "1")
    try:
        got = read_source_arrays(spark, str(tmp_path / "plain")).collect() + read_source_arrays(spark, str(tmp_path / "wrapped"), level=2).collect()
    finally:
        for k, v in zip(keys, before):
            spark.conf.set(k, v)
    found = {(r.doc_id.rsplit("/", 1)[1], r.pos): json.loads(r.raw) for r in got}
    assert len(found) == len(got)
    assert found == {(f, i): x for f, items in files.items() for i, x in enumerate(items) if isinstance(x, dict)}
