"""Near duplicates by signatures and fill-in-middle texts against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
from conftest import prose
from test_pairs import family, shingles

from pergola.llm import _arrow, fim, minhash


def classes(rows, least=80):
    sets = [(i, shingles(t)) for i, t in rows]
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            i, j = sets[a][1], sets[b][1]
            if sets[a][0] is not None and sets[b][0] is not None and i and j and 100 * len(i & j) >= least * len(i | j):
                parent[find(a)] = find(b)
    lowest = {}
    for k, (i, _) in enumerate(sets):
        if i is not None:
            lowest[find(k)] = min(lowest.get(find(k), i), i)
    found = ((i, len(s), lowest.get(find(k)) if i is not None else None) for k, (i, s) in enumerate(sets))
    return sorted(((i, n, c, i is None or i == c) for i, n, c in found), key=repr)


def deduplicated(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.deduplicate(df).collect()), key=repr)


def test_near_duplicates_on_awkward_rows(spark, awkward):
    assert deduplicated(awkward) == classes([(r.doc_id, r.text) for r in awkward.collect()])
    assert minhash.deduplicate(awkward.limit(0)).count() == 0


@pytest.mark.parametrize("chunk", [minhash.CHUNK, 400])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(minhash, "CHUNK", chunk)
    rng = random.Random(chunk)
    texts = [t for size in (5, 8, 20, 60, 150) for _ in range(4) for t in family(rng, 6, size, max(1, size // 10))] + family(rng, 40, 80, 10)
    passage = prose(rng, 80, 3000)
    texts += [f"{prose(rng, rng.randint(5, 30), 3000)} {passage} {prose(rng, rng.randint(5, 30), 3000)}" for _ in range(60)]
    chain = prose(rng, 100, 3000).split()
    for k in range(40):  # each is near its neighbours only
        chain = [*chain[3:], *(f"c{k}x{j}" for j in range(3))]
        texts.append(" ".join(chain))
    rows = list(enumerate(texts)) + [(3, texts[200]), (None, texts[4])]
    rng.shuffle(rows)
    assert deduplicated(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)) == classes(rows)


def test_pairs_of_a_bucket_without_its_pivot_are_found(spark):
    """A bucket whose pivot is like none of the others: only the comparison across classes can link them."""
    rng = np.random.default_rng(4)
    base = np.unique(rng.integers(0, 1 << 62, 200)).astype(np.uint64)
    sets = [np.unique(rng.integers(0, 1 << 62, 200)).astype(np.uint64), base, np.unique(np.append(base[:-5], rng.integers(0, 1 << 62, 5).astype(np.uint64))), base[:-30]]
    sigs = minhash.signatures(np.concatenate(sets), np.cumsum([0, *map(len, sets)])[:-1])
    names = minhash.signed(minhash.bands(sigs))
    buckets = {int(names[k, b]) for b in range(minhash.BANDS) for k in (1, 2, 3) if (names[1:, b] == names[k, b]).sum() > 1}
    rows = [(k, len(s), bytearray(sig.tobytes()), bytearray(s.tobytes())) for k, (s, sig) in enumerate(zip(sets, sigs))]
    held = spark.createDataFrame(rows, "node long, n_shingles long, sig binary, own binary")
    members = spark.createDataFrame([(b, 0, k, k, 0) for b in buckets for k in range(4) if k == 0 or b in names[k]], "band long, pivot long, node long, class long, home long")
    groups = minhash._open(members, held).join(held.drop("n_shingles"), "node")
    found = {frozenset((r.a, r.b)) for r in minhash._compared_in_groups(groups, minhash.least_matches(), 80).collect()}
    assert len(found) in (2, 3) and set().union(*found) == {1, 2, 3}


def test_posterior_bounds_keep_links_and_drop_others():
    needed = minhash.least_matches()
    assert needed == sorted(needed) and 80 <= needed[-1] <= 100
    rng = np.random.default_rng(9)
    for share, least, most in ((0.8, 0.999, 1), (0.45, 0, 0.002)):
        a = rng.integers(0, 1 << 32, (20_000, 128), dtype=np.uint64).astype(np.uint32)
        b = np.where(rng.random(a.shape) < share, a, a ^ np.uint32(1))
        alive, matches = minhash.survivors(a, b, needed)
        assert least <= len(alive) / len(a) <= most
        assert (matches == (a[alive] == b[alive]).sum(axis=1)).all()


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    both, x, y = (rng.integers(0, 1 << 63, n).astype(np.uint64) for n in (400, 50, 50))
    sets = [np.unique(np.append(both, x)), np.unique(np.append(both, y))]
    a, b = minhash.signatures(np.concatenate(sets), np.array([0, len(sets[0])]))
    assert abs((a == b).mean() - 0.8) < 0.12
    names = minhash.bands(np.stack([a, a]))
    assert (names[0] == names[1]).all() and len(set(names[0].tolist())) == minhash.BANDS


UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def middle_filled(i, text, seed=42, cut=50, first=80):
    text = text or ""
    units = UNIT.findall(text)
    h = [int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[8 * k : 8 * k + 8], 16) for k in range(4)]
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= cut:
        return (i, len(units), "plain", None, None, text)
    a, b = sorted(v % (len(units) + 1) for v in h[:2])
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form = "spm" if h[3] % 100 < first else "psm"
    return (i, len(units), form, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}")


def fim_rows(rng):
    odd = ["", None, " ", "\t\n", " a", "a ", "<P>", "a<S>b", "x <M>", "<", "<P", "P> <", "é 你好 😀 b\x0bc", " x y\x85z", "a" * 3000, "w " * 40_000, "<<P <<S >M>"]
    return [(i, odd[i % len(odd)]) for i in range(200)] + [(300 + i, prose(rng, rng.randint(0, 90)) + rng.choice(["", " ", "\n", " <", "é"])) for i in range(300)] + [(None, "a b c d")]


def test_fill_in_middle_equals_brute_force(spark, awkward):
    rows = fim_rows(random.Random(2))
    for frame in (spark.createDataFrame(rows, "doc_id long, text string").repartition(3), awkward):
        found = fim.transform(frame, keep=("n_words",) if frame is awkward else ())
        want = sorted((middle_filled(r.doc_id, r.text) for r in frame.collect()), key=repr)
        assert sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in found.collect()), key=repr) == want
        back = found.select("doc_id", fim.restored(found.output, found.form).alias("text")).collect()
        assert sorted(map(tuple, back), key=repr) == sorted(((r.doc_id, r.text or "") for r in frame.collect()), key=repr)
    assert fim.digests(fim.transform(awkward.limit(0))).count() == 0


def test_rank_and_select():
    rng = np.random.default_rng(3)
    for n, share in ((0, 0), (1, 1), (63, 0.5), (64, 0.5), (511, 0.9), (512, 1), (513, 0.01), (40_000, 0.2), (3_000, 0)):
        bits = rng.random(n) < share
        held = fim.Bits(bits)
        assert (held.rank(np.arange(n + 1)) == np.concatenate([[0], np.cumsum(bits)])).all()
        assert (held.select(np.arange(int(bits.sum()))) == np.flatnonzero(bits)).all()


def test_signatures_and_bands_are_kept_once(spark, awkward, tmp_path, monkeypatch):
    places = iter(range(10_000))
    monkeypatch.setattr(_arrow, "shared_dir", lambda spark: f"file://{tmp_path}/{next(places)}")
    assert minhash.deduplicate(awkward).count() == awkward.count()
    held = [set(spark.read.parquet(str(p)).columns) for p in tmp_path.iterdir() if any(p.glob("*.parquet"))]
    assert sum("sig" in columns for columns in held) == 1 and {"band", "node"} not in held
