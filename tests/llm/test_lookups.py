"""License scans, URL filters and the pipeline as a whole."""

from __future__ import annotations

import random

import pytest

import corpus_pipeline
from revlake.llm.licenses import NOTICES, scan_licenses
from revlake.llm.queries import URL_RULES
from revlake.llm.urls import bloom_blocks, canonical_rules, filter_urls

TEXTS = {name: text for name, text in NOTICES if len(text) > 150}
ISC = TEXTS["ISC"]


def brute_verdict(url, rules):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host, after = rest[:cut], rest[cut:]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        path = after[: min([after.find(c) for c in "?#" if c in after] or [len(after)])]
    fits = []
    for rule, verdict in rules:
        h, _, p = rule.partition("/")
        p = "/" + p if "/" in rule else ""
        if host and (host == h or host.endswith("." + h)) and path.startswith(p):
            fits.append((len(rule), len(h), verdict, rule))
    best = max(fits, default=(0, 0, "allow", None))
    return host, path, best[3], best[2]


def urls(n):
    r = random.Random(11)
    hosts = ["org", "example.org", "a.b.example.org", "EXAMPLE.org", "badexample.org", "x.com", "com", "net", "example.org:80", ""]
    paths = ["", "/", "/es/", "/es", "/en/1", "/en/12", "/en/2", "/fr/x", "/de/", "/ES/"]
    tails = ["", "?q=/es/", "#/es/", "?a#b"]
    out = [f"{r.choice(['http', 'https', ''])}{r.choice(['://', '://', ':/'])}{r.choice(hosts)}{r.choice(paths)}{r.choice(tails)}" for _ in range(n)]
    return [*out, None, "", "://", "http://", "http://org", "http://org?x", "a://b://c.org/es/", "http://" + "a." * 3000 + "org/" + "y" * 5000]


@pytest.mark.parametrize("limit", [16 << 20, 0])
def test_urls_equal_brute_force(spark, limit):
    rules = [*URL_RULES, ("net", "block"), ("example.org/es/", "allow"), (None, "block"), ("/x", "block")]
    pages = [(k, u) for k, u in enumerate(urls(300))] + [(None, "http://org/a"), (5, "http://x.com/de/"), (5, "http://x.com/de/")]
    table = spark.createDataFrame([(i, u, None, None) for i, u in pages], "page_id long, url string, host string, block string")
    got = filter_urls(table, spark.createDataFrame(rules, "rule string, verdict string"), broadcast_bytes=limit).collect()
    usable = [(r, v) for r, v in rules if r and not r.startswith("/")]
    assert sorted(map(tuple, got), key=repr) == sorted(((i, *brute_verdict(u, usable)) for i, u in pages), key=repr)


def test_no_urls_and_no_rules(spark):
    rules = spark.createDataFrame(URL_RULES, "rule string, verdict string")
    pages = spark.createDataFrame([(1, "http://example.org/es/")], "page_id long, url string")
    assert filter_urls(pages.limit(0), rules).count() == 0
    assert [tuple(r) for r in filter_urls(pages, rules.limit(0)).collect()] == [(1, "example.org", "/es/", None, "allow")]


def test_bloom_filter_has_all_keys_and_few_others(spark):
    rules = spark.createDataFrame([(f"h{k}.org/p{k}", "block") for k in range(4000)], "rule string, verdict string")
    blocks = bloom_blocks(canonical_rules(rules), 500)
    assert blocks.count() <= 500
    pages = spark.createDataFrame([(k, f"http://h{k}.org/p{k}") for k in range(4000)], "page_id long, url string")
    assert filter_urls(pages, rules).filter("verdict = 'block'").count() == 4000


def test_license_texts(spark, make_docs, odd_pairs):
    changed = "Copyright (c) 2020 Someone\n\n" + ISC.upper().replace(",", " ,").replace("\n\n", "\n \n")
    pairs = [(100, ISC), (101, changed), (102, ISC + " more"), (103, "some prose\nreleased under the MIT LICENCE\nmore prose"), (104, "© 2021 All of us")]
    known = spark.createDataFrame([*NOTICES, ("ISC-again", ISC.lower()), (None, "x"), ("void", None), ("void", " ")], "license_id string, text string")
    got = {r.doc_id: r for r in scan_licenses(make_docs(pairs + odd_pairs), known).collect()}
    assert (got[100].license_id, got[101].license_id, got[102].license_id) == ("ISC", "ISC", None)
    assert got[100].text_sha256 == got[101].text_sha256
    assert (got[103].license_id, got[103].line_licenses) == (None, "MIT")
    assert got[104].text_sha256 is None and got[1].text_sha256 is None and got[2].text_sha256 is None
    assert len(got) == len({i for i, _ in pairs + odd_pairs})
    assert scan_licenses(make_docs([]), known).count() == 0
    assert scan_licenses(make_docs(pairs), known.limit(0)).filter("license_id IS NOT NULL").count() == 0


def test_licenses_inside_longer_documents(spark, make_docs):
    """Each listed text alone, between a title and other lines, and wrapped anew with a copyright line in it."""
    pairs, want = [], {}
    for k, (name, text) in enumerate(NOTICES):
        words = text.split()
        wrapped, at = [], 0
        while at < len(words):
            n = 2 + (at + k) % 9
            wrapped.append(" ".join(words[at : at + n]))
            at += n
        wrapped.insert(len(wrapped) // 2, "Copyright (c) 2024 by us")
        pairs += [(10 * k, text), (10 * k + 1, f"{name} License\n\nCopyright 2020 Some One\n\n{text}\n\nand so the file goes on\n"), (10 * k + 2, "\n".join(["our files", *wrapped, "the end"]))]
        pairs += [(10 * k + 3, text.rsplit(" ", 1)[0] + "\nnot all of it"), (10 * k + 4, f"so {text}")]
        want |= {10 * k: name, 10 * k + 1: name, 10 * k + 2: name}
    known = spark.createDataFrame(list(NOTICES), "license_id string, text string")
    for row in scan_licenses(make_docs(pairs), known).collect():
        if row.doc_id % 10 == 0:
            assert row.license_id == want[row.doc_id]
        if row.doc_id in want:
            assert want[row.doc_id] in (row.line_licenses or "").split(","), row
        else:  # a word is missing, or one stands before
            assert row.license_id is None and want[row.doc_id // 10 * 10] not in (row.line_licenses or "").split(",")


def test_pipeline_stages(spark, make_docs, tmp_path):
    r = random.Random(12)

    def prose(n):
        return " ".join("".join(r.choice("aeiounrstlm") for _ in range(r.randint(2, 8))) for _ in range(n))

    good = [(k, prose(80)) for k in range(160)]
    toxic = [(1000 + k, prose(40) + " horrid " + prose(30)) for k in range(60)]
    poor = [(2000 + k, " ".join(w + "%%%" for w in prose(60).split())) for k in range(60)]
    item = prose(30)
    copies = [(3000, good[0][1]), (3001, good[1][1] + " end")]
    leak = [(4000, prose(40) + " " + item + " " + prose(40))]
    boiler = [(5000 + k, f"{prose(40)}\nread 1{k} more stories on our pages\n{prose(20)}") for k in range(14)]
    docs = make_docs(good + toxic + poor + copies + leak + boiler).select("doc_id", "text", "lang", "source", "n_chars")
    rating = [(i, 1, 0) for i, _ in good] + [(i, 1, 1) for i, _ in toxic] + [(i, 0, 0) for i, _ in poor]
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(rating, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "line_dedup", "near_dedup", "decontamination", "sentencepiece"]
    stage, left = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, run in corpus_pipeline.STAGES[:-1]:
        stage = run(spark, stage, str(tmp_path))
        assert stage.columns == docs.columns
        left[name] = {x.doc_id: x for x in stage.collect()}
    first = set(left["quality_classifier"])
    assert not first & {i for i, _ in toxic + poor} and len(first & {i for i, _ in good}) >= 156
    assert set(left["line_dedup"]) == first
    assert "stories" in left["line_dedup"][5000].text and "stories" not in left["line_dedup"][5001].text
    assert set(left["line_dedup"]) - set(left["near_dedup"]) == {3000, 3001} & first
    assert set(left["near_dedup"]) - set(left["decontamination"]) == {4000} & first
    result = corpus_pipeline.run(spark, str(tmp_path))
    assert {x.doc_id for x in result.collect()} == set(left["decontamination"])
