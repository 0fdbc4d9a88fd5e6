"""Blocks of near-duplicate clusters hold a bounded number of sets."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from revlake.llm import near_duplicates as near

from .test_duplicates import brute_components


def test_second_pass_meets_in_bounded_tiles(make_docs, monkeypatch):
    """Pages of one template, few of them linked, repeated rows among them."""
    r = random.Random(4)
    template = [f"t{k}" for k in range(40)]
    pairs = [(k, " ".join(template + [f"w{r.randint(0, 9999)}" for _ in range(14)])) for k in range(60)]
    pairs += [(100 + k, pairs[k][1] + " end") for k in range(0, 60, 9)]
    pairs += [pairs[7]] * 40
    sizes, blocks = [], near._blocks

    def counted(rows, percent):
        sizes.extend(x["n"] for x in rows.groupBy("root", "block").agg(F.count("*").alias("n")).collect())
        return blocks(rows, percent)

    monkeypatch.setattr(near, "_blocks", counted)
    monkeypatch.setattr(near, "SHARED", 2)
    got = near.near_duplicates(make_docs(pairs), 2, 80, 12).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got)) == sorted(brute_components(pairs, 2))
    # a block of 12 and a piece of 12, dealt out by hash
    assert len(sizes) > 10 and max(sizes) <= 45
