import hashlib
import re
import random
from collections import Counter

import pytest

from pointloom.llm import jaccard, substrings, suffixes
from pointloom.llm.decontaminate import WordHashes


def linked_by_hand(rows):
    known = WordHashes()
    sets = [set(jaccard.shingle_set((t or "").encode(), known).tolist()) for _, t in rows]
    parent, links = list(range(len(rows))), [0] * len(rows)

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a + 1, len(rows)):
            if sets[a] and sets[b] and len(sets[a] & sets[b]) * 5 >= 4 * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                parent[max(root(a), root(b))] = min(root(a), root(b))
    least = {}
    for k, (i, _) in enumerate(rows):
        ids = [rows[m][0] for m in range(len(rows)) if root(m) == root(k) and rows[m][0] is not None]
        least[k] = min(ids) if ids else None
    return sorted((str(i), str(least[k]), links[k]) for k, (i, _) in enumerate(rows))


def near(text, edits):
    w = text.split()
    for _ in range(edits):
        w[random.randrange(len(w))] = f"e{random.randrange(10**6)}"
    return " ".join(w)


@pytest.mark.parametrize("tile", [1024, 16])
def test_jaccard_against_brute_force(docs_of, odd_rows, monkeypatch, tile):
    monkeypatch.setattr(jaccard, "TILE_ROWS", tile)
    random.seed(6)
    base = [" ".join(f"w{random.randrange(500)}" for _ in range(120)) for _ in range(5)]
    rows = [(100 + i, near(base[i % 5], i % 4)) for i in range(60)] + [(300 + i, base[0]) for i in range(5)] + odd_rows
    got = sorted((str(r.doc_id), str(r.class_id), r.n_links) for r in jaccard.similar_documents(docs_of(rows)).collect())
    assert got == linked_by_hand(rows)


def test_pruning_bound_and_empty_table(docs_of):
    assert jaccard.least_matches(32, 4, 5, 1e-7) < 16 < jaccard.least_matches(192, 4, 5, 1e-7) < 154
    assert jaccard.similar_documents(docs_of([])).count() == 0


def test_one_of_each_group_stays(docs_of):
    t = " ".join(f"w{i}" for i in range(50))
    other = " ".join(f"v{i}" for i in range(50))
    d = docs_of([(3, t), (2, t + " more"), (2, t), (9, "else"), (None, t), (None, other), (None, other), (None, None), (None, None)])
    assert sorted((str(r.doc_id), r.text or "") for r in jaccard.keep_one(d).collect()) == sorted([("2", t + " more"), ("9", "else"), ("None", other), ("None", ""), ("None", "")])
    assert jaccard.keep_one(docs_of([])).count() == 0


def removed_by_hand(texts, n):
    count = {}
    for t in texts:
        for p in range(len(t) - n + 1):
            count[t[p : p + n]] = count.get(t[p : p + n], 0) + 1
    out = []
    for t in texts:
        cover = [False] * len(t)
        for p in range(len(t) - n + 1):
            if count[t[p : p + n]] > 1:
                cover[p : p + n] = [True] * n
        spans = sum(c and not (k and cover[k - 1]) for k, c in enumerate(cover))
        kept = bytes(b for b, c in zip(t, cover, strict=True) if not c)
        out.append((len(t), sum(cover), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [20_000, 2])
def test_substrings_against_brute_force(docs_of, monkeypatch, hot):
    monkeypatch.setattr(substrings, "HOT", hot)
    random.seed(7)
    some = lambda n: "".join(random.choice("abcé \n") for _ in range(n))
    shared = [some(450), some(420), some(395)]
    texts = [some(random.randrange(300)) + random.choice(shared) + some(random.randrange(200)) for _ in range(25)]
    texts += [None, "", "x" * 1000, "ab" * 400, shared[0] * 2, texts[0], texts[0], some(399)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(0, texts[0]), (None, texts[1])]
    want = sorted((str(i), *r) for (i, _), r in zip(rows, removed_by_hand([(t or "").encode() for _, t in rows], 400), strict=True))
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substrings.removal_digest(docs_of(rows)).collect())
    assert got == want


def passages_by_hand(texts, n):
    words = [[m.span() for m in re.finditer(rb"[^\x00-\x20]+", t)] for t in texts]
    strings = [[(w[k][0], w[k + n - 1][1]) for k in range(len(w) - n + 1)] for w in words]
    count = Counter(t[a:z] for t, s in zip(texts, strings, strict=True) for a, z in s)
    out = []
    for t, s in zip(texts, strings, strict=True):
        cover = bytearray(len(t))
        for a, z in s:
            if count[t[a:z]] > 1:
                cover[a:z] = b"\x01" * (z - a)
        out.append((sum(cover), len(re.findall(rb"\x01+", bytes(cover)))))
    return out


@pytest.mark.parametrize("hot, depth", [(20_000, 4096), (2, 4096), (20_000, 150)])
def test_passages_against_brute_force(docs_of, monkeypatch, hot, depth):
    monkeypatch.setattr(substrings, "HOT", hot)
    monkeypatch.setattr(substrings, "BLOCK", 1500)
    monkeypatch.setattr(suffixes.repeated, "__defaults__", (depth,))
    random.seed(17)
    some = lambda n: "".join(random.choice(["a", "of", "é\x01x", "word", "w" * 300][random.random() > 0.99 and 4 or random.randrange(4)]) + random.choice([" ", " ", "\n", "  ", "\x02 "]) for _ in range(n))
    shared = [some(60), some(50).strip(), some(49), some(300)]
    texts = [some(random.randrange(60)) + random.choice(shared) + random.choice(["", "s", " "]) + some(random.randrange(40)) for _ in range(40)]
    texts += [None, "", "the " * 200, "a b " * 60, " " + shared[0] + " ", "x", texts[0], texts[0], shared[1], shared[1] + "s", some(2000)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(0, texts[0]), (None, texts[1])]
    want = sorted((str(i), *r) for (i, _), r in zip(rows, passages_by_hand([(t or "").encode() for _, t in rows], 50), strict=True))
    got = sorted((str(r.doc_id), r.n_passage_bytes, r.n_passages) for r in substrings.removal_digest(docs_of(rows)).collect())
    assert got == want


def test_texts_longer_than_a_block(docs_of, monkeypatch):
    monkeypatch.setattr(substrings, "BLOCK", 1000)
    random.seed(8)
    t = "".join(random.choice("abcdef") for _ in range(5000))
    rows = [(1, t), (2, t[700:2500] + "!"), (3, "?" + t[4600:])]
    want = [(i, *r) for (i, _), r in zip(rows, removed_by_hand([x.encode() for _, x in rows], 400), strict=True)]
    assert sorted(tuple(r)[:5] for r in substrings.removal_digest(docs_of(rows)).collect()) == want
    assert substrings.removal_digest(docs_of([])).count() == 0


def test_repeats_leave_the_texts(docs_of):
    p = "p" * 10 + "q" * 390 + "é" * 50
    d = docs_of([(1, "one " + p), (2, p + " two"), (3, "three"), (4, None)])
    got = {r.doc_id: r.text for r in substrings.remove_repeats(d).collect()}
    assert got == {1: "one ", 2: " two", 3: "three", 4: None}
    assert substrings.remove_repeats(d).columns == d.columns


def test_two_stage_order_is_suffix_order():
    random.seed(9)
    for _ in range(200):
        alphabet, n = random.choice([b"ab", b"abc\x00", bytes(range(200))]), random.choice([3, 6])
        parts = [bytes(random.choice(alphabet) for _ in range(random.randint(n, 50))) for _ in range(random.randint(1, 6))]
        text = suffixes.GAP.join(parts) + suffixes.END
        wanted = suffixes.np.zeros(len(text), dtype=bool)
        at = 0
        for p in parts:
            wanted[at : at + random.randint(1, len(p) - n + 1)] = True
            at += len(p) + 2
        order = suffixes.two_stage_order(text, wanted, n)
        keys = [text[i : i + n] for i in order.tolist()]
        assert keys == sorted(keys) and sorted(order.tolist()) == suffixes.np.flatnonzero(wanted).tolist()
