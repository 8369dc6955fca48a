"""The join, decontamination and repeats against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from conftest import prose

from pergola.llm import components, decontaminate, jaccard_join, substring_dedup
from pergola.llm._arrow import key_filter, passes, runs_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ITEM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(s):
    return re.sub("[A-Z]", lambda m: m[0].lower(), s or "")


def shingles(t):
    w = WORD.findall(lower(t))
    return frozenset(tuple(w[k : k + 4]) for k in range(len(w) - 3)) if len(w) >= 4 else frozenset([tuple(w)] if w else [])


def components_of(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            i, j = sets[a][1], sets[b][1]
            if sets[a][0] is not None and sets[b][0] is not None and i and j and 100 * len(i & j) >= 85 * len(i | j):
                parent[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(sets):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return sorted(((i, len(s), least.get(find(k)) if i is not None else None) for k, (i, s) in enumerate(sets)), key=repr)


def joined(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.join(df).collect()), key=repr)


def test_join_on_awkward_rows(spark, awkward):
    assert joined(awkward) == components_of([(r.doc_id, r.text) for r in awkward.collect()])
    assert jaccard_join.join(awkward.limit(0)).count() == 0


def family(rng, n, size, edits):
    base = prose(rng, size, 3000).split()
    out = []
    for _ in range(n):
        own = list(base)
        for _ in range(rng.randint(0, edits)):
            own[rng.randrange(len(own))] = f"e{rng.randrange(10**6)}"
        out.append(" ".join(own))
    return out


@pytest.mark.parametrize("block", [jaccard_join.BLOCK_SHINGLES, 1500])
def test_join_equals_brute_force(spark, monkeypatch, block):
    rng = random.Random(block)
    monkeypatch.setattr(jaccard_join, "BLOCK_SHINGLES", block)
    texts = [t for size in (5, 8, 20, 60, 150) for _ in range(4) for t in family(rng, 6, size, max(1, size // 12))] + family(rng, 40, 80, 8)
    passage = prose(rng, 60)
    texts += [prose(rng, rng.randint(5, 120), 60) for _ in range(60)] + [f"{prose(rng, 20)} {passage} {prose(rng, 15)}" for _ in range(15)]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    assert joined(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)) == components_of(rows)


def test_shared_shingle_of_sets_whose_hashes_agree_in_31_bits(spark):
    held = {}
    for k in range(1_000_000):
        key = k.to_bytes(16, "little")
        h = xxhash.xxh64_intdigest(key, 42)
        other, whole = held.setdefault(h & 0x7FFFFFFF, (key, h))
        if whole != h:
            break
    assert whole != h
    rows = spark.createDataFrame([(bytearray(other), [5]), (bytearray(key), [5])], "k binary, low array<long>")
    assert passes(np.frombuffer(jaccard_join._filters(rows)[0], np.uint8), np.array([5], np.uint64)).all()


def test_search_meets_every_required_overlap():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 60, 200).astype(np.uint64)
    sets = [np.unique(np.where(rng.random(200) < p, rng.integers(0, 1 << 60, 200).astype(np.uint64), base)) for p in np.linspace(0, 0.3, 60)]
    index = jaccard_join.Index(sets, 85)
    for q in range(len(sets)):
        want = {k for k, s in enumerate(sets) if 100 * len(np.intersect1d(sets[q], s)) >= 85 * len(np.union1d(sets[q], s))}
        assert set(index.search(q, np.zeros(len(sets), bool)).tolist()) == want


def test_heap_puts_lists_back_and_skips():
    """Groups of a production size: lists span many ranges, and those that can't reach the required overlap are moved on without counting."""
    rng = np.random.default_rng(7)
    base = rng.integers(0, 1 << 60, 150).astype(np.uint64)
    sets = [np.unique(np.where(rng.random(150) < 0.12, rng.integers(0, 1 << 60, 150).astype(np.uint64), base)) if k >= 700 else np.unique(np.append(base[k % 150], rng.integers(0, 1 << 60, 120).astype(np.uint64))) for k in range(1500)]
    index = jaccard_join.Index(sets, 85)
    for q in (1, 701, 1400):
        want = {k for k, s in enumerate(sets) if 100 * len(np.intersect1d(sets[q], s)) >= 85 * len(np.union1d(sets[q], s))}
        assert set(index.search(q, np.zeros(len(sets), bool)).tolist()) == want
    assert index.again > 100 and index.skipped > 20


def links_of(sets, other, least):
    return {(a, b) for a, x in enumerate(sets) for b, y in enumerate(other) if 100 * len(np.intersect1d(x, y)) >= least * len(np.union1d(x, y))}


@pytest.mark.parametrize("least", [80, 85])
def test_linked_sets_hold_the_same_of_enough_parts(least):
    rng = np.random.default_rng(least)
    fresh = lambda n: rng.integers(0, 1 << 62, n).astype(np.uint64)
    for size in (*range(1, 40), 150, 700):
        for _ in range(20):
            shared = fresh(size)
            mine, other = (np.unique(np.append(shared, fresh(rng.integers(0, size // 4 + 1)))) for _ in range(2))
            if not links_of([mine], [other], least):
                continue
            common = set(jaccard_join.classes(len(mine), least)) & set(jaccard_join.classes(len(other), least))
            assert any((jaccard_join.part_keys(mine, low, n) == jaccard_join.part_keys(other, low, n)).sum() > 2 * spare for low, n, spare in common)


def test_search_across_blocks_ties_what_links_there():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 60, 120).astype(np.uint64)
    sets = [np.unique(np.where(rng.random(120) < p, rng.integers(0, 1 << 60, 120).astype(np.uint64), base)) for p in np.linspace(0, 0.2, 60)]
    left, right = sets[::2], sets[1::2]
    want, found = links_of(left, right, 85), jaccard_join.linked_across(left, right, 85)
    assert want and set(found) <= want
    classes = lambda pairs: {frozenset(c) for c in merged([{("l", a), ("r", b)} for a, b in pairs])}
    assert classes(found) == classes(want)
    assert jaccard_join.Index(right, 85).search_for(np.array([1, 2, 3], np.uint64), np.zeros(len(right), bool)).tolist() == []


def merged(groups):
    out = []
    for g in groups:
        for other in [o for o in out if o & g]:
            out.remove(other)
            g = g | other
        out.append(g)
    return out


def test_a_passage_that_many_share_makes_no_large_group(spark, monkeypatch):
    rng = random.Random(12)
    monkeypatch.setattr(jaccard_join, "BLOCK_SHINGLES", 4000)
    passage = prose(rng, 30, 3000)
    texts = [f"{prose(rng, 100, 3000)} {passage} {prose(rng, 70, 3000)}" for _ in range(60)]
    texts += [t.replace("w1", "v1", 1) for t in texts[:9]]
    rows = list(enumerate(texts))
    held, sizes = jaccard_join._grouped, []
    monkeypatch.setattr(jaccard_join, "_grouped", lambda members: sizes.extend(r["count"] for r in members.groupBy("root").count().collect()) or held(members))
    assert joined(spark.createDataFrame(rows, "doc_id long, text string")) == components_of(rows)
    assert max(sizes) < 15


def test_components(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)] + [(7, 3)]
    found = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    assert found == {n: find(n) for e in edges for n in e}
    assert components.components(spark.createDataFrame([], "a string, b string")).count() == 0


def contaminated(docs, items):
    wins = {}
    for name, t in items:
        w = ITEM_WORD.findall(lower(t))
        for k in range(max(1, len(w) - 12)):
            if w:
                wins.setdefault(tuple(w[k : k + 13]), set()).update([] if name is None else [str(name)])
    out = []
    for i, t in docs:
        w = ITEM_WORD.findall(lower(t))
        hit, names = set(), set()
        for n in {len(x) for x in wins}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in wins:
                    hit.update(range(k, k + n))
                    names |= wins[tuple(w[k : k + n])]
        out.append((i, len(w), len(hit), sorted(names), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block", [decontaminate.BLOCK_WINDOWS, 20])
def test_decontamination_equals_brute_force(spark, awkward, block):
    rng = random.Random(1)
    long = [prose(rng, 40, 50) for _ in range(6)]
    items = [(1, long[0]), (2, long[1]), (2, long[1]), (3, "One"), (4, "the of and"), (5, None), (6, ""), (None, long[2]), (7, long[0].upper() + " more words"), (8, "W1 w2x w3x w4x w5x")]
    docs = [(i, f"{prose(rng, 25, 30)} {' '.join(long[i % 6].split()[i % 9 : 13 + i % 20])} {prose(rng, 25, 30)}") for i in range(40)] + [(50, "one"), (51, "w1-W2x.w3x,w4xé"), (52, long[5] * 3)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").unionByName(awkward.select("doc_id", "text"))
    bench = spark.createDataFrame([(*r, "?") for r in items], "item_id long, text string, win string")
    found = decontaminate.contamination(frame, bench, block_windows=block)
    want = contaminated([(r.doc_id, r.text) for r in frame.collect()], items)
    assert sorted(((r.doc_id, r.n_words, r.n_hit, list(r["items"]), r.contaminated) for r in found.collect()), key=repr) == want
    kept = decontaminate.contamination(awkward, bench, block_windows=block, keep=("text", "lang"))
    assert kept.columns == ["doc_id", "text", "lang", "n_words", "n_hit", "items", "contaminated"] and kept.count() == awkward.count()
    assert {r.n_hit for r in decontaminate.contamination(awkward, bench.limit(0)).collect()} == {0}
    assert decontaminate.contamination(awkward.limit(0), bench).count() == 0


def removed(rows, window=50):
    first = {}
    for i, t in rows:
        w = WORD.findall(t or "")
        for k in range(len(w) - window + 1):
            if i is not None:
                s = tuple(w[k : k + window])
                first[s] = min(first.get(s, i), i)
    out = []
    for i, t in rows:
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if i is not None and first[tuple(w[k : k + window])] < i:
                gone[k : k + window] = [True] * window
        out.append((i, len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone) if not g).encode()).hexdigest()))
    return sorted(out, key=repr)


def cut(df):
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.deduplicate(df).collect()), key=repr)


def test_repeats_on_awkward_rows(spark, awkward):
    assert cut(awkward) == removed([(r.doc_id, r.text) for r in awkward.collect()])
    assert substring_dedup.deduplicate(awkward.limit(0)).count() == 0


def test_repeats_equal_brute_force(spark):
    rng = random.Random(6)
    passages = [prose(rng, n, 80) for n in (49, 50, 51, 60, 90, 200)] + ["z " * 120, "a b " * 70, "p q r " * 40, "m m n " * 40]
    rows = [(i, f"{prose(rng, rng.randint(0, 60), 80)} {rng.choice(passages)} {prose(rng, rng.randint(0, 60), 80)} {rng.choice(passages)}") for i in range(80)]
    rows += [(90, rows[3][1]), (90, rows[4][1]), (2, rows[2][1] + " tail"), (91, passages[1]), (92, passages[0])]
    rng.shuffle(rows)
    assert cut(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)) == removed(rows)


def test_equal_windows_have_equal_anchors():
    rng = np.random.default_rng(1)
    for _ in range(200):
        window = rng.integers(0, rng.integers(2, 60), 50).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        found = set()
        for _ in range(4):
            left, right = rng.integers(0, 60, rng.integers(0, 90)), rng.integers(0, 60, rng.integers(0, 90))
            words = np.concatenate([left.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), window, right.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)])
            names, hashes = substring_dedup.anchors(words)
            found.add((*(int(n[len(left)]) for n in names), int(hashes[len(left)])))
            assert all(n[len(left)] != substring_dedup.LAST for n in names)
        assert len(found) == 1


def test_runs_of_any_length_have_one_name():
    word, other = np.uint64(0x1234567890ABCDEF), np.uint64(11)
    names = {}
    for n in (1, 2, 3, 40, 700):
        words = np.concatenate([[other], np.full(n, word), [other]]).astype(np.uint64)
        s = substring_dedup._runs(substring_dedup.Symbols(words, np.arange(n + 2), np.arange(n + 2) + 1, n + 2))
        assert len(s.names) == 3 and (s.lo[1], s.hi[1]) == (0, n + 2)
        names[n] = int(s.names[1])
    assert len(set(names.values())) == 5 and names[1] == int(word)


def test_a_range_goes_only_if_its_words_are_the_same(spark, monkeypatch):
    """All windows given the same name and hash: what they meet by is then no reason to remove a word."""
    rows = [(i, prose(random.Random(i), 70, 900)) for i in range(6)] + [(9, prose(random.Random(2), 70, 900))]
    frame = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    hits = spark.createDataFrame([(1, 3, 0, 3), (1, 4, 0, 4), (1, 9, 0, 3)], "doc_id long, spot long, owner long, found long")
    found = substring_dedup._ranges(hits, 50).first()
    assert [(r["first"], r["words"], r["own_first"]) for r in found.ranges] == [(3, 51, 3), (9, 50, 3)]
    assert substring_dedup._digest([b"a", b"b", b"c"], 1, 2) != substring_dedup._digest([b"a", b"b", b"d"], 1, 2)
    assert cut(frame) == removed(rows)


def test_key_filter_passes_all_its_keys(spark):
    keys = np.random.default_rng(2).integers(-(1 << 62), 1 << 62, 5000)
    held = np.frombuffer(key_filter(spark.createDataFrame([(int(k),) for k in keys], "k long"), "k"), np.uint8)
    assert passes(held, keys.view(np.uint64)).all()
    other = np.random.default_rng(3).integers(-(1 << 62), 1 << 62, 5000)
    assert passes(held, other.view(np.uint64)).mean() < 0.02


def test_run_hashes_tell_orders_apart():
    words = np.arange(1, 5, dtype=np.uint64)
    assert len({int(runs_of(np.array(p, np.uint64), 4)[0]) for p in __import__("itertools").permutations(words.tolist())}) == 24
