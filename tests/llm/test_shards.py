"""Rendezvous shards against the rule written in Python, and their numbering."""

from __future__ import annotations

import hashlib
import math
import zlib

import pytest

from revlake.llm.shards import assign_shards, write_shards


def scores(key, weights):
    name = "" if key is None else str(key)
    unit = [(int(hashlib.md5(f"{name}:{k}".encode()).hexdigest()[:13], 16) + 0.5) / 16**13 for k in range(len(weights))]
    return [-w / math.log(u) for w, u in zip(weights, unit)]


def best(key, weights):
    own = scores(key, weights)
    return own.index(max(own))


def test_shards_equal_the_rule(make_docs, odd_pairs):
    pairs = odd_pairs + [(1000 + k, f"text {k % 7}") for k in range(500)] + [(77, "hot")] * 300 + [(None, None)] * 5
    weights = [1.0, 2.5, 0.0, 1.0, 0.5]
    got = assign_shards(make_docs(pairs), weights).collect()
    want = [(i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode()), "key", best(i, weights), best(i, [*weights, 1.0])) for i, t in pairs]
    assert sorted(((r.doc_id, r.size, r.text_crc32, r.law, r.shard, r.grown_shard) for r in got), key=repr) == sorted(want, key=repr)
    for k in range(5):
        slots = sorted(r.slot for r in got if r.shard == k)
        assert slots == list(range(len(slots)))
    assert not any(r.shard == 2 for r in got)
    assert all(r.grown_shard in (r.shard, 5) for r in got)


def test_weights_are_kept_and_few_rows_move(spark):
    docs = spark.range(20_000).selectExpr("id AS doc_id", "'x' AS text")
    got = assign_shards(docs, [1.0, 2.0, 1.0], added=1.0).collect()
    sizes = [sum(r.shard == k for r in got) / len(got) for k in range(3)]
    assert sizes == pytest.approx([0.25, 0.5, 0.25], abs=0.02)
    moved = [r for r in got if r.grown_shard != r.shard]
    assert len(moved) / len(got) == pytest.approx(0.2, abs=0.02) and {r.grown_shard for r in moved} == {3}
    order = sorted((r for r in got if r.shard == 1), key=lambda r: r.slot)
    assert [r.doc_id for r in order][:50] != sorted(r.doc_id for r in order)[:50]  # mixed


def test_written_shards_hold_all_rows_in_order(spark, make_docs, odd_pairs, tmp_path):
    docs = make_docs(odd_pairs + [(k, f"t{k}") for k in range(100, 160)])
    write_shards(docs, [1.0] * 4, str(tmp_path / "shards"))
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert sorted(back.columns) == sorted([*docs.columns, "shard", "slot"])
    assert sorted(map(repr, back.select(*docs.columns).collect())) == sorted(map(repr, docs.collect()))
    for k in range(4):
        slots = [r.slot for r in back.filter(back.shard == k).orderBy("slot").collect()]
        assert slots == list(range(len(slots)))


def test_no_rows_and_bad_weights(make_docs):
    assert assign_shards(make_docs([]), [1.0]).count() == 0
    for weights in ([], [0.0], [1.0, -1.0]):
        with pytest.raises(ValueError):
            assign_shards(make_docs([]), weights)
