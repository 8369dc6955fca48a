"""Models: held-out accuracy, normalisation, gradients, and awkward rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from pergola.llm import language_id, lm_score, pii, quality_rules, toxicity
from pergola.llm import queries as named

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="session")
def small():
    from pathlib import Path

    where = Path("/root/testdata/sf0.01")
    if not where.exists():
        pytest.skip("the common tables are not here")
    return str(where)


def rows_of(df):
    return {r.doc_id: r for r in df.collect()}


def test_language_held_out(spark, small):
    found = rows_of(named.op9_language_id(spark, small))
    docs = rows_of(spark.read.parquet(f"{small}/documents.parquet"))
    held = [i for i, r in found.items() if r.held_out]
    assert held == [i for i in found if zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean([found[i].lang_pred == docs[i].lang for i in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in found.values())


def test_language_backoff_and_awkward_rows(spark, awkward):
    model = language_id.train(awkward)
    assert model.langs == ["de", "en", "fr"]
    scorer = language_id.Scorer(model)
    assert (scorer.row("the") == model.words.get("the")).all()
    unseen = scorer.row("écolière")
    known = next(n for n in range(4, 0, -1) if any(model.grams[n].get(g) is not None for g in language_id.grams("écolière", n)))
    assert np.allclose(unseen, np.mean([r for g in language_id.grams("écolière", known) if (r := model.grams[known].get(g)) is not None], axis=0))
    assert (scorer.row("ꙮꙮ") == 0).all()
    found = language_id.predict(awkward, model, keep=("text", "source")).collect()
    assert len(found) == awkward.count()
    assert {r.lang_pred for r in found if not r.text or not r.text.strip()} == {"und"}
    assert language_id.predict(awkward.limit(0), model).count() == 0
    nothing = language_id.train(awkward.limit(0))
    assert {r.lang_pred for r in language_id.predict(awkward, nothing).collect()} == {"und"}


def test_language_model_score_base_by_hand(spark, small):
    found = rows_of(named.op3_lm_score(spark, small))
    docs = spark.read.parquet(f"{small}/documents.parquet").collect()
    tokens = {r.doc_id: WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), r.text)) + ["\n"] for r in docs}
    counts = Counter(w for i, own in tokens.items() if zlib.crc32(str(i).encode()) % 10 for w in own)
    n, v = sum(counts.values()), len(counts)
    for i, own in tokens.items():
        r = found[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(own), sum(counts[w] > 0 for w in own), n)
        assert math.isclose(r.base_score, sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own), rel_tol=1e-9)
    held = [r for r in found.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_language_model_is_normalised(spark, awkward):
    model = lm_score.train(lm_score.documents(awkward), vocabulary=40, hot_words=60)
    tables = lm_score.Tables(model.parameters)
    p = np.exp(tables.one[::9, None, :] + tables.two[None, ::7, :] - tables.normaliser[::9, ::7, None]).sum(axis=2)
    assert np.allclose(p, 1, atol=1e-3)
    lexicon = model.lexicon
    assert math.isclose(lexicon.outcome_shares().sum(), 1.0)
    counts = {bytes(r.word): r.n for r in model.counts.collect()}
    inside = Counter()
    for w, n in counts.items():
        place = lexicon.places.get(w)
        if place is None or place >= lexicon.size:
            inside[lexicon.ending(w)] += (n + 0.1) / lexicon.floor
    assert np.allclose([inside[lexicon.size + k] for k in range(len(lexicon.masses))], lexicon.masses)
    found = lm_score.score(awkward, model).collect()
    assert len(found) == awkward.count()
    texts = Counter((r.doc_id, lm_score.tokens((r.text or "").encode()).__len__()) for r in awkward.collect())
    assert Counter((r.doc_id, r.n_tokens) for r in found) == texts
    twice = [r for r in found if r.doc_id == 9]
    assert len(twice) == 2 and math.isclose(twice[0].score, twice[1].score)
    assert lm_score.score(awkward.limit(0), model).count() == 0


def test_language_model_scores_by_hand(spark, awkward):
    """Every score against a loop over tokens that sums over all outcomes, with words that training has not seen."""
    model = lm_score.train(lm_score.documents(awkward.where("doc_id < 10")), vocabulary=30, hot_words=50)
    lexicon, p = model.lexicon, model.parameters
    counts = {bytes(r.word): r.n for r in model.counts.collect()}
    shares = lexicon.outcome_shares()

    def outcome(w):
        place = lexicon.places.get(w)
        return place if place is not None and place < lexicon.size else lexicon.ending(w)

    strange = 0
    for r in lm_score.score(awkward.where("doc_id <> 7"), model, keep=("text",)).collect():
        total, before = 0.0, [lexicon.start, lexicon.start]
        for w in lm_score.tokens((r.text or "").encode()):
            h = p.R[before[0]] @ p.C1 + p.R[before[1]] @ p.C2
            logs = (h @ p.Q.T + p.b).astype(np.float64)
            logs -= np.log(np.exp(logs - logs.max()).sum()) + logs.max()
            k = outcome(w)
            if w not in counts:
                strange, value = strange + 1, logs[lexicon.unknown]
            else:
                value = logs[k] + (0 if k < lexicon.size else math.log((counts[w] + 0.1) / lexicon.floor / shares[k]))
            total += value / math.log(10)
            before = [k, before[0]]
        assert math.isclose(r.score, total, rel_tol=1e-4, abs_tol=1e-3)
    assert strange > 5


def test_language_model_does_not_depend_on_the_layout(spark, awkward):
    docs = lm_score.documents(awkward)
    models = [lm_score.train(docs.repartition(n), vocabulary=40, hot_words=60, shard_tokens=2000) for n in (2, 7)]
    assert (models[0].parameters.flat() == models[1].parameters.flat()).all()
    first, second = (sorted((str(r.doc_id), r.score) for r in lm_score.score(docs, m).collect()) for m in models)
    assert np.allclose([s for _, s in first], [s for _, s in second], rtol=1e-12)


def test_language_model_learns_from_every_training_token(spark, awkward, monkeypatch):
    seen, whole = [], lm_score.vector_sum

    def here(*args):
        values = whole(*args)
        seen.append(0 if values is None else int(values[-1]))
        return values

    monkeypatch.setattr(lm_score, "vector_sum", here)
    model = lm_score.train(lm_score.documents(awkward), vocabulary=40, hot_words=60, shard_tokens=2000)
    assert len(seen) == lm_score.ROUNDS and sum(seen) == model.lexicon.total


def test_language_model_without_training_text(spark, awkward):
    found = lm_score.score(awkward, lm_score.train(lm_score.documents(awkward.limit(0)))).collect()
    assert all(r.n_known == 0 and math.isfinite(r.score) for r in found)


def test_toxicity_held_out(spark, small):
    """Only rows that were not learnt from, of all languages."""
    found = rows_of(named.op2_toxicity(spark, small))
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{small}/labels.parquet").collect()}
    held = [i for i, r in found.items() if r.held_out and labels.get(i) is not None]
    assert all(zlib.crc32(str(i).encode()) % 3 == 1 for i in held)
    tox, clean = ([found[i] for i in held if labels[i] == y] for y in (1, 0))
    assert np.mean([a.score > b.score for a in tox for b in clean]) > 0.93
    assert np.mean([r.predicted for r in tox]) >= 0.7 and np.mean([r.predicted for r in clean]) < 0.02
    assert all(r.predicted == int(r.score >= 0.7) and 0 <= r.score <= 1 for r in found.values())


def test_kneser_ney_by_hand():
    """Both models of every word against dictionaries, loops and fractions of counts; characters of long words as the sum of their parts."""
    rng = random.Random(4)
    words = sorted({"".join(rng.choice("abé") for _ in range(rng.randint(1, 9))).encode() for _ in range(60)})
    counts = np.array([[rng.randint(0, 6), rng.randint(0, 6)] for _ in words], float)
    counts[:, 0] += counts.sum(axis=1) == 0
    counts[7] = 0, 90
    model = toxicity.fit(words, counts)
    order = toxicity.ORDER
    grams = Counter()
    for w, n in zip(words, counts):
        own = (256,) * (order - 1) + tuple(w) + (257,)
        for k in range(order - 1, len(own)):
            grams[own[k - order + 1 : k + 1]] += n.sum()
    seen = {order: grams}
    for n in range(order - 1, 0, -1):
        seen[n] = Counter(g[1:] for g in seen[n + 1])

    def shared(g):
        if len(g) == 1:
            return (seen[1].get(g, 0) + 1) / (sum(seen[1].values()) + 258)
        after = {x: n for x, n in seen[len(g)].items() if x[:-1] == g[:-1]}
        total, d = sum(after.values()), model.shared[len(g) - 2].discount
        if not total:
            return shared(g[1:])
        return (max(after.get(g, 0) - d, 0) + d * sum(n > 0 for n in after.values()) * shared(g[1:])) / total

    def characters(w):
        own = (256,) * (order - 1) + tuple(w) + (257,)
        return math.prod(shared(own[k - order + 1 : k + 1]) for k in range(order - 1, len(own)))

    both = {w: n.sum() for w, n in zip(words, counts)}
    ones, twos = (sum(n == k for n in both.values()) for k in (1, 2))
    less, total = min(max(ones / max(ones + 2 * twos, 1), 0.3), 0.95), counts.sum()

    def word(w):
        return max(both.get(w, 0) - less, 0) / total + (1 - sum(max(n - less, 0) for n in both.values()) / total) * characters(w)

    def likelihood(w, c):
        size, gone = counts[:, c].sum(), {}
        for x, pair in zip(words, counts):
            e = [k * word(x) for k in counts.sum(axis=0)]
            told = any(n > m + toxicity.DEVIATIONS * math.sqrt(m) + toxicity.DISCOUNT for n, m in zip(pair, e))
            gone[x] = min(pair[c], toxicity.DISCOUNT) if told else pair[c]
        kept = counts[words.index(w), c] - gone[w] if w in gone else 0
        return math.log((kept + (sum(gone.values()) + toxicity.BACKOFF) * word(w)) / (size + toxicity.BACKOFF))

    asked = [*words[:20], b"ab", "ébé".encode(), b"zzz", b""]
    logs, sizes = toxicity.word_likelihoods(model, asked)
    assert sizes.tolist() == [len(w) + 1 for w in asked]
    assert np.allclose(logs, [[likelihood(w, c) for c in (0, 1)] for w in asked], rtol=1e-4)
    assert any(abs(a - b) > 0.5 for a, b in logs)
    long = b"abba" * 400
    whole, n = toxicity.character_likelihoods(model.shared, model.first, [long])
    parts, ns = toxicity.character_likelihoods(model.shared, model.first, toxicity.cut(long))
    assert len(ns) > 3 and ns.sum() == n[0] and np.allclose(parts.sum(), whole[0])


def test_toxicity_awkward_rows(spark, awkward):
    labels = spark.createDataFrame([(1, 1), (2, 0), (4, 0), (5, 0), (None, 1), (7, None), (9, 0), (9, 1), (99, 0)], "doc_id long, toxic int")
    for use in (labels, labels.limit(0)):
        found = toxicity.score(awkward, toxicity.train(awkward, use), keep=("lang",)).collect()
        assert len(found) == awkward.count() and all(0 <= r.score <= 1 for r in found)
    assert toxicity.score(awkward.limit(0), toxicity.train(awkward, labels)).count() == 0


def test_rare_expressions_say_nothing():
    words = [b"idiot", b"the", b"seen", b"once"]
    model = toxicity.fit(words, np.array([[0, 200], [500, 500], [0, 1], [1, 0]], float))
    logs = toxicity.word_likelihoods(model, words)[0]
    ratio = dict(zip(words, logs[:, 1] - logs[:, 0]))
    assert ratio[b"idiot"] > 2 > abs(ratio[b"once"]) and abs(ratio[b"the"]) < 1
    assert abs(ratio[b"once"] - ratio[b"seen"]) < 1e-9


def test_comparison_carries_the_score(spark, small):
    """The weight of the length-normalised comparison is positive, and no other column of the text comes into the score."""
    docs, labels = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels.where("crc32(cast(doc_id AS string)) % 3 <> 1"))
    assert model.weights[0] > 0 and len(model.weights) == 2
    ratios = toxicity.Ratios(model)
    texts = {r.doc_id: toxicity.parts_of((r.text or "").encode()) for r in docs.limit(200).collect()}
    ratios.meet(list(texts.values()))
    found = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    for i, words in texts.items():
        logs, sizes = toxicity.word_likelihoods(model, words) if words else (np.zeros((1, 2)), np.ones(1))
        c = (logs[:, 1] - logs[:, 0]).sum() / sizes.sum() ** 0.5
        assert np.isclose(found[i], 1 / (1 + math.exp(-(model.weights[0] * math.copysign(abs(c) ** 0.5, c) + model.weights[1]))), atol=1e-6)


def statistics(text):
    t = text or ""
    w = WORD.findall(t)
    windows = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
    n = Counter(windows)
    covered = {p for k, x in enumerate(windows) if n[x] > 1 for p in (k, k + 1, k + 2)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered))


def test_statistics(spark, awkward):
    extra = spark.createDataFrame([(100, "a b c a b c\nx | y\n\nx | y\n  \n"), (101, "a a a a"), (102, "é b c d\x1fe d\x1fe"), (103, "one two")], "doc_id long, text string")
    rows = awkward.select("doc_id", "text").unionByName(extra)
    found = quality_rules.statistics(rows).collect()
    key = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert sorted(((r.doc_id, *(r[k] for k in key)) for r in found), key=repr) == sorted(((r.doc_id, *statistics(r.text)) for r in rows.collect()), key=repr)


def test_rules(spark, small):
    found = rows_of(named.op4_quality_rules(spark, small))
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{small}/labels.parquet").collect()}
    assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.base_failed and r.kept) for r in found.values())
    good = [found[i].kept for i, q in labels.items() if q == 1 and not found[i].base_failed]
    low = [found[i].kept for i, q in labels.items() if q == 0]
    assert np.mean(good) > 0.97 and np.mean(low) < 0.3


def test_rules_are_learnt_and_run_without_python(spark, awkward):
    rng = np.random.default_rng(0)
    x = {k: rng.random(900) for k in quality_rules.FEATURES}
    low = (x["symbol_share"] > 0.7) | ((x["upper_share"] < 0.3) & (x["mark_share"] >= 0.6))
    rules = quality_rules.learn(x, low)
    hit = np.any([quality_rules._holds(r, x) for r in rules], axis=0)
    assert np.mean(hit == low) > 0.95
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 0), (7, None)], "doc_id long, quality int")
    for use in (labels, labels.limit(0)):
        df = quality_rules.judge(awkward, use)
        assert "Python" not in df._jdf.queryExecution().executedPlan().toString() and df.count() == awkward.count()
    assert quality_rules.judge(awkward.limit(0), labels).count() == 0


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base(text):
    out = []
    for order, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            fits = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 12 <= len(digits) <= 19 and pii.luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if fits:
                out.append((m.start(), order, m.end(), kind))
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(out))


def test_patterns_equal_regular_expressions():
    rng = random.Random(3)
    letters = list("aZ09..@@-+ ()%_é\n1234567")
    for _ in range(5000):
        t = "".join(rng.choice(letters) for _ in range(rng.randint(0, 40)))
        assert pii.joined(pii.base_spans(t)) == base(t), t


def test_tagger_gradients():
    rng = np.random.default_rng(0)
    model, chars, tags = pii.Tagger.start(), rng.integers(0, pii.CLASSES, (3, 6)), rng.integers(0, 9, (3, 6))
    for n in model.NAMES:
        setattr(model, n, getattr(model, n).astype(np.float64))
    _, gradients = model.loss(chars, tags)
    for n in model.NAMES:
        a = getattr(model, n)
        at = (0, chars[0, 2], 3) if n == "x" else tuple(rng.integers(0, s) for s in a.shape)
        was = a[at]
        sides = []
        for e in (1e-4, -1e-4):
            a[at] = was + e
            sides.append(model.loss(chars, tags)[0])
        a[at] = was
        assert abs((sides[0] - sides[1]) / 2e-4 - gradients[n][at]) < 2e-4


@pytest.fixture(scope="session")
def tagger(spark, small):
    return pii.train(spark.read.parquet(f"{small}/documents.parquet"))


def grouped(rng, mark):
    return pii._groups(*pii._card(rng), mark)


def address(rng, at, dot="."):
    return f"{pii._name(rng)}{at}{pii._name(rng)}{dot}org"


#: Forms that the patterns miss.
FORMS = {
    "phone": [lambda r: f"({pii._number(r, 3)}) 555-{pii._number(r, 4)}", lambda r: f"{pii._number(r, 3)}-555-{pii._number(r, 4)}", lambda r: f"{pii._number(r, 3)}.555.{pii._number(r, 4)}"],
    "card": [lambda r: grouped(r, "."), lambda r: grouped(r, "/")],
    "ip": [lambda r: " . ".join(str(r.randint(0, 255)) for _ in range(4)), lambda r: "[.]".join(str(r.randint(0, 255)) for _ in range(4))],
    "email": [lambda r: address(r, " @ "), lambda r: address(r, " [at] "), lambda r: address(r, " at ", " dot "), lambda r: address(r, "(at)", "(dot)")],
}


def test_added_spans_of_planted_forms(spark, small, tagger):
    """Recall of the model's own spans in rows that it was not shown, by kind; and nothing in what only looks like personal data."""
    rng = random.Random(99)
    docs = spark.read.parquet(f"{small}/documents.parquet").where("length(text) > 200").orderBy("doc_id").limit(120).collect()
    for kind, makers in FORMS.items():
        cases = []
        for r in docs:
            item, at = rng.choice(makers)(rng), rng.choice([k for k, c in enumerate(r.text) if c == " "]) + 1
            cases.append((r.text[:at] + item + rng.choice([" ", ". ", ", "]) + r.text[at:], at, at + len(item)))
        texts = [c[0] for c in cases]
        assert not any((a, b, kind) in pii.base_spans(t) for t, a, b in cases)
        found = pii.added_spans(tagger, texts, [pii.base_spans(t) for t in texts])
        assert np.mean([(a, b, kind) in own for (_, a, b), own in zip(cases, found)]) >= 0.9, kind
    plain = [f"Seen {pii.look_alike(rng)} there, and no more of it." for _ in range(300)]
    assert np.mean([bool(x) for x in pii.added_spans(tagger, plain, [pii.base_spans(t) for t in plain])]) < 0.03


def test_decoding_is_the_best_of_all_ways():
    rng = np.random.default_rng(3)
    model, chars = pii.Tagger.start(), rng.integers(0, pii.CLASSES, (4, 4))
    e, _ = model.emissions(model.states(chars))
    ways = np.array(np.meshgrid(*[range(pii.TAGS)] * 4)).reshape(4, -1).T
    for k, best in enumerate(model.decode(chars)):
        totals = model.first[ways[:, 0]] + e[k, range(4), ways].sum(axis=1) + model.moves[ways[:, :-1], ways[:, 1:]].sum(axis=1)
        assert ways[totals.argmax()].tolist() == best.tolist()


def test_personal_data(spark, small, awkward, tagger):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    model = tagger
    found = rows_of(pii.digests(pii.find(docs, model)))
    right = wrong = missed = 0
    for r in docs.collect():
        assert found[r.doc_id].base_sha256 == hashlib.sha256(base(r.text).encode()).hexdigest()
        starts = pii.windows(r.text)
        if len(starts):
            got = set(pii.tagged_spans(pii.reconciled(len(r.text), starts, model.decode(pii.cut(pii.codes(r.text), starts)))))
            want = set(pii.shapes(r.text))
            right, wrong, missed = right + len(got & want), wrong + len(got - want), missed + len(want - got)
    assert right / (right + wrong) > 0.9 and right / (right + missed) > 0.9
    assert pii.added_spans(model, ["call me at (212) 555-0142 please"], [[]])[0]
    rows = pii.find(awkward, model, keep=("lang",))
    assert rows.count() == awkward.count() and pii.find(awkward.limit(0), model).count() == 0
    clean = {r.doc_id: r.text for r in pii.redacted(rows).collect()}
    assert clean[11] == "Tel [phone], [email], [ip], [card]."
    assert pii.train(awkward.limit(0)) is None and pii.find(awkward, None).count() == awkward.count()
