from __future__ import annotations

import zlib
from collections import Counter, defaultdict

from lexiframe.llm import sharding as S


def test_rows(docs, empty, pairs, tmp_path):
    out = S.shard_documents(docs, str(tmp_path / "map"), shards=4, slots=64).collect()
    want = Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in pairs)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in out) == want
    places = defaultdict(list)
    for r in out:
        places[r.shard].append(r.slot)
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    assert {(r.law, r.grown_shard) for r in out} == {("bytes", None)} and set(places) <= set(range(4))
    assert S.shard_documents(empty, str(tmp_path / "none")).count() == 0
    assert S.with_shards(empty, str(tmp_path / "none2")).count() == 0
    whole = S.with_shards(docs, str(tmp_path / "whole"), shards=4, slots=64)
    assert whole.columns[: len(docs.columns)] == docs.columns and "shard_size" in whole.columns
    by_id = {r.doc_id: r.shard for r in out}
    assert all(by_id[r.doc_id] == r.shard_shard for r in whole.filter("doc_id IS NOT NULL").collect())


def test_near_equal_bytes_and_editing(spark, tmp_path):
    rows = [(k, "x" * (k * 7919 % 400)) for k in range(5000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    path = str(tmp_path / "map")
    out = S.shard_documents(docs, path, slots=1024)
    load = Counter()
    for r in out.collect():
        load[r.shard] += r.size
    assert len(load) == 24 and max(load.values()) < 1.01 * min(load.values())

    weights = S.slot_weights(S.record_slots(docs, slots=1024), 1024)
    one = S.load_map(spark, path)
    S.save_map(S.edited_map(one, weights, 25), path)
    two = S.load_map(spark, path)
    assert {r.version for r in two.collect()} == {2} and S.load_map(spark, path, 1).count() == 1024 == two.count()
    old = {r.virtual_slot: r.shard for r in S.load_map(spark, path, 1).collect()}
    new = {r.virtual_slot: r.shard for r in two.collect()}
    size = {r.virtual_slot: r.bytes for r in weights.collect()}
    load = Counter()
    for s, shard in new.items():
        load[shard] += size[s]
    assert len(load) == 25 and max(load.values()) < 1.03 * min(load.values())
    moved = sum(size[s] for s in old if old[s] != new[s]) / sum(size.values())
    assert moved < 0.12  # a new shard's share is 0.04
    fewer = {r.virtual_slot: r.shard for r in S.edited_map(two, weights, 24).collect()}
    assert set(fewer.values()) == set(range(24))
