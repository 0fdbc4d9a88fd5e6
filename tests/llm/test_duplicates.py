"""Near duplicates, substring dedup, line dedup and decontamination, against brute force."""

from __future__ import annotations

import hashlib
import random
import re
from pathlib import Path

import numpy as np
import pytest

from revlake.llm.chunks import boundaries, cut_repeats, gear, repeated_spans, _GEAR, LARGEST, WINDOW
from revlake.llm import near_duplicates as near
from revlake.llm.components import components
from revlake.llm.contamination import decontaminate, find_leaks, item_sketches, shingle_rows
from revlake.llm.near_duplicates import drop_near_duplicates, near_duplicates, region_ties
from revlake.llm.templates import drop_recurring_lines, line_report, recurring_lines
from revlake.session import shared_dir

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(text, size):
    words = WORDS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if len(words) >= size:
        return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}
    return {tuple(words)} if words else set()


def brute_components(pairs, size):
    sets = [shingle_set(t, size) for _, t in pairs]
    group = list(range(len(pairs)))
    for i in range(len(pairs)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and 100 * common >= 80 * (len(sets[i]) + len(sets[j]) - common):
                a, b = group[i], group[j]
                group = [min(a, b) if g in (a, b) else g for g in group]
    least = {}
    for g, (i, _) in zip(group, pairs):
        if i is not None:
            least[g] = min(least.get(g, i), i)
    return [(i, len(s), least.get(g) if s else i) for (i, _), s, g in zip(pairs, sets, group)]


def crowd(n, seed):
    """Texts at all distances from each other: every one edits an earlier one."""
    r = random.Random(seed)
    texts = [[r.choice("abcdefghijklmnopqrstuvwxyz") * r.randint(1, 3) for _ in range(60)]]
    while len(texts) < n:
        words = list(r.choice(texts[-30:]))
        for _ in range(r.randint(1, 6)):
            words[r.randrange(len(words))] = f"w{r.randint(0, 99)}"
        texts.append(words)
    return [(k, " ".join(w)) for k, w in enumerate(texts)]


@pytest.mark.parametrize(("size", "block"), [(2, 1500), (5, 1500), (2, 12)])
def test_near_duplicates_equal_brute_force(make_docs, odd_pairs, size, block):
    pairs = crowd(120, size) + [(i + 1000 if i else i, t) for i, t in odd_pairs] + [(2000, "Alpha BETA " * 20_000), (3000, "short one"), (3001, "short one")]
    got = near_duplicates(make_docs(pairs), size, 80, block).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(brute_components(pairs, size), key=repr)


def crowded(n, core, size, r):
    """Documents that hold a common core, with own words beside it; every third is followed by an edit of it."""
    shared, out = [f"c{k}" for k in range(core)], []
    while len(out) < n:
        own = [f"o{r.randrange(10**9)}" for _ in range(r.randint(core // 2, core * 3))]
        at = r.randrange(len(own))
        words = own[:at] + shared + own[at:]
        out.append(words)
        if len(out) % 3 == 0:
            words = list(words)
            for _ in range(max(1, len(words) // (12 * size))):
                words[r.randrange(len(words))] = f"e{r.randrange(10**9)}"
            out.append(words)
    r.shuffle(out)
    return [(k, " ".join(w)) for k, w in enumerate(out)]


@pytest.mark.parametrize(("size", "region"), [(2, 2048), (2, 7), (5, 2048)])
def test_links_inside_a_crowd_are_found(make_docs, monkeypatch, size, region):
    monkeypatch.setattr(near, "REGION", region)
    pairs = crowded(500, 80, size, random.Random(size))
    got = near_duplicates(make_docs(pairs), size, 80).select("doc_id", "n_shingles", "component_id").collect()
    want = brute_components(pairs, size)
    assert sum(i != c for i, _, c in want) > 60
    assert sorted(map(tuple, got)) == sorted(want)


def test_region_ties_equal_brute_force():
    r = np.random.default_rng(8)
    centres = r.integers(0, 256, (6, 128), dtype=np.uint8)
    low = centres[r.integers(0, 6, 90)]
    low[r.random(low.shape) < 0.22] = 0
    probe, label = r.random(90) < 0.6, r.integers(0, 70, 90)
    ties = region_ties(label, low, probe)

    def joined(pairs):
        group = label.copy()
        for i, j in pairs:
            group[group == group[j]] = group[i]
        return {tuple(np.flatnonzero(group == g)) for g in group}

    agree = [(i, j) for i in np.flatnonzero(probe) for j in np.flatnonzero(~probe) if (low[i] == low[j]).sum() >= near.AGREE]
    assert joined(ties) == joined(agree)
    assert len(ties) < 70 and joined(ties) != joined([])


def test_large_sets_are_dealt_out_by_their_shingles(make_docs, monkeypatch):
    monkeypatch.setattr(near, "BLOCK_SHINGLES", 3000)
    pairs = crowd(80, 3)
    got = near_duplicates(make_docs(pairs), 2, 80).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got)) == sorted(brute_components(pairs, 2))


def test_near_duplicates_of_nothing(make_docs):
    assert near_duplicates(make_docs([])).count() == 0
    assert near_duplicates(make_docs([(1, None), (2, "")])).count() == 2


def test_drop_near_duplicates_keeps_one_of_a_group(make_docs):
    text = " ".join(f"w{i}" for i in range(50))
    docs = make_docs([(3, text), (1, text + " more"), (2, text), (9, "another text of its own"), (4, None), (5, None), (7, text)])
    left = drop_near_duplicates(docs)
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.collect()) == [1, 4, 5, 9]


def test_components_of_random_links(spark):
    r = random.Random(5)
    links = [(r.randrange(300), r.randrange(300)) for _ in range(160)] + [(k, k + 1) for k in range(400, 460)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    alone = {x for x in root if all(a == b for a, b in links if x in (a, b))}
    got = dict(map(tuple, components(spark.createDataFrame(links, "u long, v long")).collect()))
    assert got == {x: find(x) for x in root if x not in alone}


def test_gear_and_boundaries_follow_the_content():
    data = np.frombuffer(bytes(random.Random(6).choices(range(256), k=3000)), np.uint8)
    rolled = [sum(int(_GEAR[data[i - j]]) << j for j in range(min(WINDOW, i + 1))) & 0xFFFFFFFF for i in range(len(data))]
    assert gear(data).tolist() == rolled
    ends = boundaries(data)
    moved = boundaries(np.r_[data[:100], np.frombuffer(b"inserted", np.uint8), data[100:]])
    assert set(e + 8 for e in ends if e > 200) <= set(moved) and ends[-1] == 3000


def test_repeated_passages_are_found_and_cut(make_docs, odd_pairs):
    r = random.Random(7)

    def prose(n):
        return " ".join("".join(r.choice("abcdefghijklmnopqrst") for _ in range(r.randint(2, 9))) for _ in range(n))

    passage = prose(60)
    pairs = [(10, prose(80) + " " + passage + " " + prose(50)), (11, prose(7) + " " + passage), (12, passage + " " + prose(90)), (13, prose(200))]
    pairs += [(20 + k, prose(100) + " " + "one short line that is shared by all" + " " + prose(30)) for k in range(3)]
    docs = make_docs(pairs + odd_pairs + [(30, pairs[0][1])])
    spans = repeated_spans(docs).collect()
    assert {(s.doc_id, s.first_doc_id) for s in spans} == {(11, 10), (12, 10), (30, 10)}
    texts = dict(pairs)
    for s in spans:
        if s.doc_id in (11, 12):
            assert texts[s.doc_id].encode()[s.start : s.start + s.size].decode() in passage
    cut = {x.doc_id: x.text for x in cut_repeats(docs).collect()}
    assert cut[10] == texts[10] and cut[13] == texts[13] and cut[20] == texts[20] and cut[1] is None
    assert len(cut[11]) < len(texts[11]) - 200 and len(cut[30]) < 40
    assert repeated_spans(make_docs([])).count() == 0


def test_passages_of_over_fifty_words_are_found(make_docs):
    """Random and self-repeating passages of 51 to 60 words, each in two documents of other words."""
    r = random.Random(3)

    def prose(n, letters="abcdefghijklmnopqrst"):
        return " ".join("".join(r.choice(letters) for _ in range(r.randint(2, 9))) for _ in range(n))

    pairs, planted = [], 300
    for k in range(planted):
        size = r.randint(51, 60)
        unit = prose(r.randint(1, 4)).split() if k % 3 == 0 else prose(size).split()
        passage = " ".join((unit * size)[:size])
        for i in (2 * k, 2 * k + 1):
            pairs.append((i, f"{prose(r.randint(1, 60))} {passage} {prose(r.randint(1, 60))}"))
    pairs += [(5000 + k, prose(200)) for k in range(100)]
    found = {(s.doc_id, s.first_doc_id) for s in repeated_spans(make_docs(pairs)).collect()}
    right = {(2 * k + 1, 2 * k) for k in range(planted)}
    assert len(found & right) >= 0.99 * planted
    assert not any(i >= 5000 for i, _ in found)


def test_periodic_text_has_bounded_chunks():
    for unit in (b"abcd", b"a", b"seven by", b"a longer unit of text that repeats, "):
        ends = boundaries(np.frombuffer(unit * 20_000, np.uint8))
        assert np.diff(np.r_[0, ends]).max() <= 4 * LARGEST


def test_cutting_keeps_columns_of_any_name(spark):
    r = random.Random(8)
    passage = " ".join("".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(70))
    docs = spark.createDataFrame([(1, passage, 1, 2, 3, 4), (2, "start " + passage, 5, 6, 7, 8)], "doc_id long, text string, spans int, cut_id int, cut_th int, _spans int")
    left = {x.doc_id: x for x in cut_repeats(docs).collect()}
    assert left[1].text == passage and len(left[2].text) < 100 and (left[2].spans, left[2].cut_id, left[2].cut_th, left[2]._spans) == (5, 6, 7, 8)


def test_recurring_templates_are_dropped_but_once(make_docs, odd_pairs):
    pairs = [(k, f"own start {chr(97 + k)}\nviewed 1{k} times by 2{k} people today\nown end {chr(97 + k)}") for k in range(12)]
    pairs += [(50 + k, "a b\ncopy of the same text\nc d") for k in range(15)]
    docs = make_docs(pairs + [(i + 500 if i else i, t) for i, t in odd_pairs])
    assert {(r.doc_id, r.pos) for r in recurring_lines(docs).collect()} == {(k, 1) for k in range(1, 12)}
    left = {r.doc_id: r for r in drop_recurring_lines(docs).collect()}
    assert left[0].text == pairs[0][1]
    assert left[3].text == "own start d\nown end d" and left[3].n_chars == len(left[3].text)
    assert left[55].text == "a b\ncopy of the same text\nc d"
    assert left[1].th is None and left[2].text == "own start c\nown end c"
    assert drop_recurring_lines(docs).count() == len(pairs) + len(odd_pairs)
    assert drop_recurring_lines(make_docs([])).count() == 0


def test_line_dedup_deals_texts_out_and_leaves_one_table(spark, make_docs):
    docs = make_docs([(k, f"own start {chr(97 + k)}\nthe line of all pages\nown end {chr(97 + k)}") for k in range(12)])
    folder = Path(shared_dir(spark)) / f"revlake-{spark.sparkContext.applicationId}"
    before = {p.name for p in folder.iterdir()} if folder.exists() else set()
    left = drop_recurring_lines(docs)
    assert [p.name.split("-")[0] for p in folder.iterdir() if p.name not in before] == ["gone"]
    plan = left._jdf.queryExecution().sparkPlan().toString()
    assert "ShuffledHashJoin" in plan and "BroadcastHashJoin" not in plan
    assert {r.doc_id: r.text for r in left.collect()} == {k: t.text if k == 0 else t.text.replace("the line of all pages\n", "") for k, t in enumerate(docs.collect())}


def test_blocks_of_boilerplate_recur_by_documents(make_docs):
    own = [f"body {'abcdefghijklmn'[k] * 9} of a page with words of its own" for k in range(14)]
    head, foot = "site news sport\nall pages of this site\nsearch in it", "about this site\nterms of use\nwrite to the editors"
    pairs = [(k, f"{head}\n{t}\n{foot}") for k, t in enumerate(own)] + [(30, "terms of use"), (31, "another page\nof two lines")]
    left = {r.doc_id: r.text for r in drop_recurring_lines(make_docs(pairs)).collect()}
    assert left[0] == pairs[0][1] and left[30] == "" and left[31] == pairs[-1][1]
    assert all(left[k] == own[k] for k in range(1, 14))


def _prose(r, n):
    return " ".join("".join(r.choice("abcdefghijklmnopqrst") for _ in range(r.randint(3, 9))) for _ in range(n))


@pytest.mark.parametrize("own_words", [3, 40])
def test_pages_lose_all_boilerplate_however_little_is_their_own(make_docs, own_words):
    r = random.Random(own_words)
    head = "home news sport culture weather\nsubscribe now and read all there is\nsearch this site for words"
    foot = "about the makers of this site\nterms of use and privacy\nwrite to the editors at any time"
    own = [_prose(r, own_words) for _ in range(26)]
    docs = make_docs([(k, f"{head}\n{t}\n{foot}") for k, t in enumerate(own)])
    left = {x.doc_id: x.text for x in drop_recurring_lines(docs).collect()}
    assert left[0] == f"{head}\n{own[0]}\n{foot}" and all(left[k] == own[k] for k in range(1, 26))
    report = {x.doc_id: x for x in line_report(docs).collect()}
    assert all(report[k].n_left == len(own[k]) and report[k].n_chars > report[k].n_left for k in range(1, 26))
    assert report[1].text_sha256 == hashlib.sha256(own[1].encode()).hexdigest()


def test_navigation_of_many_words_is_dropped(make_docs):
    """Nine tenths of a page recur, but what does not is no variant of a common line."""
    r = random.Random(4)
    nav = "\n".join(_prose(r, 12) for _ in range(20))
    own = [_prose(r, 6) for _ in range(15)]
    left = {x.doc_id: x.text for x in drop_recurring_lines(make_docs([(k, f"{nav}\n{t}") for k, t in enumerate(own)])).collect()}
    assert all(left[k] == own[k] for k in range(1, 15))


def test_edited_copies_of_a_story_keep_it(make_docs):
    r = random.Random(9)
    story = [_prose(r, 14) for _ in range(30)]
    pairs = []
    for k in range(20):
        lines = list(story)
        for at in r.sample(range(30), 2):
            words = lines[at].split()
            words[r.randrange(14)] = _prose(r, 1)
            lines[at] = " ".join(words)
        pairs.append((k, "\n".join(lines)))
    assert {x.doc_id: x.text for x in drop_recurring_lines(make_docs(pairs)).collect()} == dict(pairs)


def test_near_copies_keep_their_lines(make_docs):
    body = [f"{w} stands in a line that all the copies of one story have" for w in "anna bert carl dora emil fritz gerd hans ida jan".split()]
    pairs = [(k, "\n".join([*body, "copied by " + "abcdefghijklmn"[k] * 5])) for k in range(14)]
    assert {r.doc_id: r.text for r in drop_recurring_lines(make_docs(pairs)).collect()} == dict(pairs)


def test_leaf_template_generalises_a_word(make_docs):
    names = "anna bert carl dora emil fritz gerd hans ida jan karl lena".split()
    pairs = [(k, f"{n} begins\nposted in the news by {n} with all rights kept\n{n} ends") for k, n in enumerate(names)]
    assert {(r.doc_id, r.pos) for r in recurring_lines(make_docs(pairs)).collect()} == {(k, 1) for k in range(1, 12)}


def test_leaks_equal_brute_force(spark, make_docs, odd_pairs):
    r = random.Random(8)

    def prose(n):
        return [f"w{r.randint(0, 4000)}" for _ in range(n)]

    items, docs = [], []
    for k in range(40):
        words = prose(r.choice([1, 3, 5, 6, 12, 20, 39, 60]))
        items.append((k, " ".join(words)))
        kept = [w if r.random() > k / 400 else "changed" for w in words]
        docs.append((100 + k, " ".join(prose(r.choice([0, 50, 3000])) + kept + prose(40))))
        docs.append((200 + k, " ".join(words).upper()))
    items += [(90, None), (91, ""), (92, " "), (None, "an item that has no id at all"), (0, items[0][1])]
    docs += odd_pairs + [(300, "so an item that has no id at all")]
    sets = [(i, shingle_set(t, 5)) for i, t in dict.fromkeys(items)]
    want = set()
    for d, t in docs:
        own = shingle_set(t, 5)
        want |= {(d, i, len(s), len(s & own)) for i, s in sets if s and 100 * len(s & own) >= 80 * len(s)}
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    table = make_docs(docs)
    for limit in (1 << 20, 0):  # sketches sent along, and joined
        got = find_leaks(table, benchmark, broadcast_bytes=limit).collect()
        assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    left = decontaminate(table, benchmark)
    assert left.columns == table.columns
    assert sorted((x.doc_id for x in left.collect()), key=repr) == sorted((d for d, _ in docs if d not in {w[0] for w in want}), key=repr)
    assert decontaminate(make_docs([]), benchmark).count() == 0
    assert find_leaks(table, benchmark.limit(0)).count() == 0


def test_sketch_is_deep_enough(spark):
    items = spark.createDataFrame([(n, " ".join(f"t{i}" for i in range(n + 4))) for n in range(1, 70)], "item_id long, text string")
    depth = {}
    for row in item_sketches(shingle_rows(items, "item_id")).collect():
        depth[row.n] = depth.get(row.n, 0) + 1
    assert all(depth[n] >= min(n, n * 20 // 100 + 1) for n in range(1, 70))
