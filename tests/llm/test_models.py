import math
import random
import zlib
from collections import Counter
from itertools import product

import numpy as np
import pyarrow as pa
import pytest

from pointloom.llm import boosting, hmm, quality, scoring, toxicity

BAD = ["idiot", "moron", "scum", "loser"]


def corpus(n, seed=1):
    random.seed(seed)
    rows = []
    for i in range(n):
        w = [f"w{random.randrange(400)}" for _ in range(60)]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(3):
                w[random.randrange(60)] = random.choice(BAD)
        rows.append((i, " ".join(w), int(toxic)))
    return rows


def test_forward_equals_the_sum_over_paths():
    rng = np.random.default_rng(1)
    k, v = 3, 5
    norm = lambda x, a: x / x.sum(axis=a, keepdims=True)
    c = hmm.Chain(norm(rng.random(k), 0), norm(rng.random((k, k)), 1), norm(rng.random((v, k)), 0))
    seqs = [[0], [1, 2], [4, 3, 2, 1, 0], [2, 2, 2]]
    got = hmm.log10_likelihood(c, np.array(sum(seqs, [])), np.array([len(s) for s in seqs]))
    for s, g in zip(seqs, got, strict=True):
        total = 0.0
        for path in product(range(k), repeat=len(s)):
            p = c.start[path[0]] * c.emit[s[0], path[0]]
            for a, b, o in zip(path, path[1:], s[1:], strict=False):
                p *= c.move[a, b] * c.emit[o, b]
            total += p
        assert g == pytest.approx(math.log10(total))


def test_baum_welch_raises_the_likelihood_and_adds_up():
    rng = np.random.default_rng(2)
    seqs = [rng.choice([0, 1, 2] if i % 2 else [3, 4, 5], 30) for i in range(40)]
    seq, n = np.concatenate(seqs), np.array([30] * 40)
    share = np.full(6, 1 / 6)
    chain, last = hmm.first_chain(share, 2), -np.inf
    for _ in range(10):
        c = hmm.Counts.zero(2, 6)
        c.add(chain, seq[:600], n[:20])
        c.add(chain, seq[600:], n[20:])
        assert c.emit.sum() == pytest.approx(1200, rel=1e-3) and c.start.sum() == pytest.approx(40, rel=1e-3) and c.move.sum() == pytest.approx(1160, rel=1e-3)
        chain = c.chain(share, 0.01)
        now = hmm.log10_likelihood(chain, seq, n).sum()
        assert now > last - 1e-3
        last = now
    assert last / 1200 > -0.55  # about log10(1/3), not log10(1/6)


def test_scores_against_plain_counts(spark, docs_of, odd_rows, monkeypatch):
    monkeypatch.setattr(scoring, "HEAD", 50)
    rows = [(i, t) for i, t, _ in corpus(80)] + odd_rows
    d = docs_of(rows)
    model = scoring.train(d.where(~scoring.held_out()))
    got = sorted(((str(r.doc_id), r.n_tokens, r.n_known, r.base_score, r.score) for r in scoring.scores(d, model).collect()))
    c = Counter()
    for i, t in rows:
        if i is not None and zlib.crc32(str(i).encode()) % 5 != 1:
            c.update((t or "").encode().lower().split())
            c["end"] += 1
    total, distinct = sum(c.values()), len(c)
    assert (model.n_tokens, model.n_words) == (total, distinct)
    want = []
    for i, t in rows:
        w = [*(t or "").encode().lower().split(), "end"]
        want.append((str(i), len(w), sum(c[x] > 0 for x in w), sum(math.log10((c[x] + 0.5) / (total + 0.5 * (distinct + 1))) for x in w)))
    assert [g[:3] for g in got] == [w[:3] for w in sorted(want)]
    assert [g[3] for g in got] == pytest.approx([w[3] for w in sorted(want)])
    assert all(math.isfinite(g[4]) and g[4] <= 0 for g in got)


def test_scores_against_one_word_at_a_time(docs_of, monkeypatch):
    """The forward recursion with plain loops, and each word's share of its class from plain counts."""
    monkeypatch.setattr(scoring, "HEAD", 20)
    rows = [(i, t) for i, t, _ in corpus(40)] + [(100, "unseen wxyz w1"), (101, None)]
    d = docs_of(rows)
    model = scoring.train(d.where("doc_id < 30"), states=3, rounds=4)
    words = Counter(w for i, t in rows if i < 30 for w in (t or "").encode().split())
    k, chain = model.classes, model.chain
    n_head = len(k.counts)
    tail_of = lambda w: zlib.crc32(w[-3:]) % scoring.TAILS
    tail = [w for w in words if w not in k.head]
    want = {}
    for i, t in rows:
        total, a = 0.0, None
        for w in [*(t or "").encode().split(), None]:
            cls = 0 if w is None else k.head.get(w, n_head + tail_of(w) if w not in k.head else 0)
            a = [chain.start[s] if a is None else sum(a[r] * chain.move[r, s] for r in range(3)) for s in range(3)]
            a = [x * chain.emit[cls, s] for s, x in enumerate(a)]
            total += math.log10(sum(a))
            a = [x / sum(a) for x in a]
            if cls >= n_head:
                same = [words[x] for x in tail if tail_of(x) == cls - n_head]
                share = (words[w] - scoring.DISCOUNT if words[w] else scoring.DISCOUNT * len(same)) / sum(same) if same else 1
                total += math.log10(share)
        want[i] = total
    got = {r.doc_id: r.score for r in scoring.scores(d, model).collect()}
    assert got.keys() == want.keys() and all(got[i] == pytest.approx(want[i], rel=1e-9) for i in got)


def test_partial_sums_of_many_partitions(docs_of, monkeypatch):
    d = docs_of([(i, t) for i, t, _ in corpus(80)])
    one = scoring.train(d.coalesce(1), rounds=3)
    monkeypatch.setattr(scoring, "FAN", 2)
    monkeypatch.setattr(scoring, "CHUNK", 64)
    many = scoring.train(d.repartition(9), rounds=3)
    assert many.chain.emit == pytest.approx(one.chain.emit, rel=1e-3, abs=1e-6) and many.chain.move == pytest.approx(one.chain.move, rel=1e-3)


def test_every_round_takes_all_texts(docs_of, monkeypatch):
    monkeypatch.setattr(scoring, "HEAD", 50)
    texts = [t for _, t, _ in corpus(80)] + ["a text that fills any sample"] * 2_100
    model = scoring.train(docs_of(list(enumerate(texts))))
    seqs = [np.array([*model.classes.of(scoring.tokens(t.encode())), 0]) for t in texts]
    share, last = model.classes.share(), -math.inf
    chain = hmm.first_chain(share, scoring.STATES)
    for _ in range(scoring.ROUNDS):
        c = hmm.Counts.zero(scoring.STATES, model.classes.size)
        c.add(chain, np.concatenate(seqs), np.array([len(s) for s in seqs]))
        assert c.log10 == pytest.approx(hmm.log10_likelihood(chain, np.concatenate(seqs), np.array([len(s) for s in seqs])).sum(), rel=1e-4)
        chain = c.chain(share)
        if c.log10 - last <= scoring.GAIN * abs(c.log10):
            break
        last = c.log10
    assert model.chain.move == pytest.approx(chain.move, rel=0.01, abs=1e-4)
    assert model.chain.emit == pytest.approx(chain.emit, rel=0.01, abs=1e-4)


def test_words_and_tail_classes_in_arrow():
    texts = [" Some  WORDS\tof\x0b\x0c\r\nany length ", "", None, "\x1c\u2003\u00c9 x", " "]
    words, n = scoring._split(pa.array(texts))
    plain = [scoring.tokens((t or "").encode()) for t in texts]
    assert words.to_pylist() == sum(plain, []) and n.tolist() == [len(w) for w in plain]
    assert scoring._tail(words).tolist() == [zlib.crc32(w[-3:]) % scoring.TAILS for w in words.to_pylist()]
    assert scoring._tail(words.slice(2, 3)).tolist() == [zlib.crc32(w[-3:]) % scoring.TAILS for w in words.to_pylist()[2:5]]
    assert len(scoring._split(pa.array([], pa.string()))[0]) == 0


def test_the_outcomes_of_a_tail_class_add_up_to_one():
    c, d = np.array([1, 1, 2, 5]), scoring.DISCOUNT
    assert ((c - d) / c.sum()).sum() + d * len(c) / c.sum() == pytest.approx(1)


def test_scores_without_training_tokens(spark, docs_of):
    d = docs_of([(1, "a b")])
    r = scoring.scores(d, scoring.train(d.where("false"))).first()
    assert (r.n_tokens, r.n_known, r.base_score, r.score) == (3, 0, 0.0, 0.0)
    assert scoring.scores(d.where("false"), scoring.train(d)).count() == 0


def test_toxic_rows_are_found_on_held_out_rows(spark, docs_of, odd_rows):
    rows = corpus(400)
    labels = spark.createDataFrame([(i, 1, t) for i, _, t in rows] + [(None, 1, 1), (1, 1, None)], "doc_id long, quality int, toxic int")
    d = docs_of([(i, t) for i, t, _ in rows] + odd_rows)
    got = toxicity.scores(d, toxicity.train(d, labels)).collect()
    assert len(got) == 400 + len(odd_rows) and all(0 <= r.score <= 1 for r in got)
    truth = {i: t for i, _, t in rows if toxicity.held_out(i)}
    hits = [(r.score >= 0.7) == bool(truth[r.doc_id]) for r in got if r.doc_id in truth and r.doc_id > 7]
    assert sum(hits) / len(hits) > 0.95
    clean = docs_of([(0, "w1 w2 w3"), (1, "you idiot scum moron " * 3), (None, "scum " * 9)])
    kept = toxicity.drop_toxic(clean.unionByName(d), labels.where("doc_id > 1")).columns
    assert kept == clean.columns


def test_too_few_labels_give_the_share(spark, docs_of):
    d = docs_of([(1, "a"), (2, "b")])
    m = toxicity.train(d, spark.createDataFrame([], "doc_id long, toxic int"))
    assert [r.score for r in toxicity.scores(d, m).collect()] == [0.0, 0.0]


def test_trees_and_calibration():
    rng = np.random.default_rng(3)
    x = rng.random((2000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    p = boosting.BoostedTrees().fit(x[:1500], y[:1500]).predict(x[1500:])
    assert ((p > 0.5) == y[1500:]).mean() > 0.95
    q = boosting.Isotonic().fit(np.array([0.1, 0.2, 0.3, 0.4]), np.array([0, 1, 0, 1])).predict(np.array([0.0, 0.25, 0.9]))
    assert (np.diff(q) >= 0).all() and q[0] < 0.01 and q[2] > 0.99 and 0.4 < q[1] < 0.6


def perplexity_by_hand(trusted, texts):
    """Kneser-Ney with dictionaries, one conditional probability at a time."""
    order = quality.ORDER
    pad = b"\n" * (order - 1)
    level = Counter(bytes((pad + t)[i : i + order]) for t in trusted for i in range(len(t)))
    levels = {order: level}
    for n in range(order - 1, 0, -1):
        levels[n] = Counter(g[1:] for g in levels[n + 1])
    tables = {}
    for n, c in levels.items():
        off = (0.0, *quality.discounts(*(sum(x == k for x in c.values()) for k in (1, 2, 3, 4))))
        total, taken = Counter(), Counter()
        for g, x in c.items():
            total[g[:-1]] += x
            taken[g[:-1]] += off[min(x, 3)]
        tables[n] = c, off, total, taken

    def p(g):
        if not g:
            return 1 / 256
        c, off, total, taken = tables[len(g)]
        back = p(g[1:])
        if g[:-1] not in total:
            return back
        return (c.get(g, 0) - off[min(c.get(g, 0), 3)] + taken[g[:-1]] * back) / total[g[:-1]]

    return [2 ** (-sum(math.log2(p((pad + t)[i : i + order])) for i in range(len(t))) / len(t)) if t else None for t in texts]


def test_perplexity_against_brute_force(docs_of, odd_rows, monkeypatch):
    monkeypatch.setattr(quality, "BLOCK_BYTES", 2000)
    random.seed(11)
    words = ["the", "and", "of", "ther", "été", "Straße", "x1", "\n"]
    texts = [" ".join(random.choice(words) for _ in range(random.randrange(1, 80))) for _ in range(60)]
    rows = list(enumerate(texts)) + [(i, t if i != 5 else t[:3000]) for i, t in odd_rows]
    model = quality.train(docs_of(list(enumerate(texts[:30])) + [(1, None), (2, "")]).select("text"))
    got = [(str(r.doc_id), r.perplexity or 0) for r in quality.perplexity(docs_of(rows), model).collect()]
    want = perplexity_by_hand([t.encode() for t in texts[:30]], [(t or "").encode() for _, t in rows])
    want = [(str(i), x or 0) for (i, _), x in zip(rows, want, strict=True)]
    assert [g[0] for g in sorted(got)] == [w[0] for w in sorted(want)]
    assert [g[1] for g in sorted(got)] == pytest.approx([w[1] for w in sorted(want)], rel=1e-9)


def test_kneser_ney_is_a_distribution(spark, docs_of):
    model = quality.train(docs_of([(1, "the cat sat on the mat\n" * 3), (2, ""), (3, "a")]).select("text"))
    assert np.allclose(model.low.reshape(-1, 256).sum(axis=1), 1)
    contexts = [b"the ", b"xthe", b"zzzz", b"\n\n\n\n"]
    grams = [int.from_bytes(c + bytes([b]), "big") for c in contexts for b in range(256)]
    got = quality.probabilities(spark.createDataFrame([(g,) for g in grams], "gram long"), model).toPandas()
    assert len(got) == len(grams) and (got.p > 0).all()
    assert np.allclose(got.groupby(got.gram // 256).p.sum(), 1)
    assert [len(quality._grams([x])[0]) for x in (b"", b"a", b"abcd")] == [0, 1, 4]
    one, two = quality._grams([b"abc"])[0].tolist(), quality._grams([b"xy"])[0].tolist()
    assert quality._grams([b"abc", b"", b"xy"])[0].tolist() == one + two


def test_quality_of_held_out_rows(spark, docs_of, odd_rows):
    random.seed(10)
    good = [(i, " ".join(random.choice(["the", "and", "of", "ther", "ing", "able"]) for _ in range(50))) for i in range(300)]
    junk = [(1000 + i, "".join(random.choice("%$#@&*!|qzxj") for _ in range(200))) for i in range(50)]
    labels = spark.createDataFrame([(i, 1) for i, _ in good[:250]] + [(i, 0) for i, _ in junk[:20]] + [(None, 1)], "doc_id long, quality int")
    rows = {r.doc_id: r for r in quality.classify(docs_of(good + junk), labels).collect()}
    assert sum(rows[i].keep for i, _ in good) > 280 and not any(rows[i].keep for i, _ in junk)
    odd = quality.classify(docs_of(odd_rows), labels).collect()
    assert len(odd) == len(odd_rows) and all(r.perplexity is None and not r.keep for r in odd if r.doc_id in (1, 2))
    assert quality.classify(docs_of([]), labels).count() == 0
    assert all(r.keep for r in quality.classify(docs_of(good), labels.where("false")).collect())


def test_distance_to_second_person_at_every_length():
    lexicon = toxicity.Lexicon({b"weak": 4.5, b"strong": 9.0})
    proximity = lambda words: lexicon.features(" ".join(words).encode())[8]
    assert proximity(["weak", "you"] * 400) == 1 / 1001
    assert proximity(["strong"] * 400 + ["x"] * 50 + ["you"] * 400) == 1 / 52
    random.seed(15)
    for n in (5, 40, 3000):
        words = [random.choice(["weak", "strong", "you", *["x"] * 20]) for _ in range(n)]
        at = lambda w, words=words: [i for i, x in enumerate(words) if x == w]
        assert proximity(words) == 1 / (1 + min((abs(i - j) for i in at("strong") for j in at("you")), default=1000))
