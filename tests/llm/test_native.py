import random

import duckdb
import numpy as np
import pytest

from pointloom.llm import chat, urls, vectors

T = "conv_id long, turn long, role string, text string, k int, a long"


def maximal(spark, rows):
    d = spark.createDataFrame([(*r, 1, 2) for r in rows], T)
    return d, {r.conv_id: (r.n_turns, r.n_copies) for r in chat.maximal_conversations(d).collect()}


def test_snapshots(spark):
    rows = [(1, 0, "user", "hi"), (2, 0, "user", "hi"), (2, 1, "assistant", "yes"), (3, 5, "user", "hi"), (3, 9, "assistant", "yes"), (4, 0, "user", "hi"), (4, 1, "assistant", "no"), (5, 0, "user", None), (6, 0, "user", ""), (7, 0, None, "hi"), (None, 0, "user", "hi"), (2, 1, "assistant", "yes")]
    d, got = maximal(spark, rows)
    assert got == {2: (2, 2), 4: (2, 1), 5: (1, 1), 6: (1, 1), 7: (1, 1)}
    chats = {r.conv_id: r.chat for r in chat.render(d, chat.maximal_conversations(d)).collect()}
    assert chats[2] == "<|user|>\nhi\n<|assistant|>\nyes\n" and chats[7] == "<||>\nhi\n"
    assert maximal(spark, [])[1] == {}


def test_random_snapshots_by_hand(spark):
    random.seed(11)
    talks = {i: [random.choice("ab") for _ in range(random.randint(1, 5))] for i in range(60)}
    _, got = maximal(spark, [(i, k, "u", t) for i, ts in talks.items() for k, t in enumerate(ts)])
    want = {}
    for i, ts in talks.items():
        if not any(len(o) > len(ts) and o[: len(ts)] == ts for o in talks.values()):
            same = [j for j, o in talks.items() if o == ts]
            want[min(same)] = (len(ts), len(same))
        del i
    assert got == want


URLS = ["http://a.Example.ORG/es/x?y#z", "https://example.org", "http://org/x", "http://notorg/fr/", "ftp://x.com/fr/1", "http://com/de/", "http://b.com/de", "no scheme", None, "", "http://", "http://x.com?/fr/", "http://example.org/en/12", "http://www.example.org/en/2", "x://y://z.org/a", "http://.com/fr/a", "http://com./fr/", "http://a.org:80/x", "HTTP://É.org/É?"]


def test_urls_against_sql(spark):
    d = spark.createDataFrame([(i, u, "r", "v") for i, u in enumerate(URLS)] + [(0, URLS[0], "r", "v")], "page_id long, url string, rule string, verdict string")
    got = urls.match_rules(d, urls.rule_table(spark)).select("page_id", "host", "path", "rule", "verdict")
    con = duckdb.connect()
    con.execute("create table pages (page_id bigint, url varchar)")
    con.executemany("insert into pages values (?, ?)", [(i, u) for i, u in enumerate(URLS)])
    want = con.execute(urls.ORACLE.replace("(partition by page_id", "(partition by page_id")).fetchall()
    want.append(next(w for w in want if w[0] == 0))
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    assert urls.match_rules(d.limit(0), urls.rule_table(spark)).count() == 0


@pytest.mark.parametrize("lanes", [1, 5])
def test_nested_rules_by_hand(spark, lanes):
    random.seed(12)
    label = lambda: random.choice("abc")
    host = lambda n: ".".join(label() for _ in range(n))
    path = lambda: "/" + "".join(random.choice("xy/") for _ in range(random.randint(0, 3)))
    rules = list({(h, p): (h, p, random.choice(["allow", "block"])) for h, p in ((host(random.randint(1, 3)), path()) for _ in range(25))}.values())
    pages = [(i, f"http://{host(random.randint(1, 4))}{path()}") for i in range(200)]
    got = {r.page_id: (r.rule, r.verdict) for r in urls.match_rules(spark.createDataFrame(pages, "page_id long, url string"), urls.rule_table(spark, rules), "allow", lanes=lanes).collect()}
    for i, u in pages:
        h, _, p = u[7:].partition("/")
        fits = [(len(a + b), len(a), b, a + b, v) for a, b, v in rules if (h == a or h.endswith("." + a)) and ("/" + p).startswith(b)]
        best = max(fits, default=None)
        assert got[i] == ((best[3], best[4]) if best else (None, "allow"))


V = "vec_id long, embedding array<double>, label int, key string, v int"


def vectors_by_hand(rows, t=0.98):
    ok = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) and lab is not None for _, v, lab in rows]
    parent, links = list(range(len(rows))), [0] * len(rows)

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a + 1, len(rows)):
            if ok[a] and ok[b] and rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]):
                x, y = np.array(rows[a][1]), np.array(rows[b][1])
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= t:
                    links[a] += 1
                    links[b] += 1
                    parent[max(root(a), root(b))] = min(root(a), root(b))
    least = [min(rows[m][0] for m in range(len(rows)) if root(m) == root(k)) for k in range(len(rows))]
    return sorted((r[0], links[k], least[k], r[0] == least[k]) for k, r in enumerate(rows))


@pytest.mark.parametrize("tile", [4096, 7])
def test_vectors_against_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(vectors, "TILE_ROWS", tile)
    rng = np.random.default_rng(13)
    base = rng.standard_normal((6, 10))
    rows = []
    for i in range(80):
        v = base[i % 6] * rng.uniform(0.1, 9) + rng.standard_normal(10) * rng.choice([0, 0.02, 0.08, 0.3])
        rows.append((i, v.tolist(), int(i % 3) if i % 11 else None))
    one = rows[1][1]
    rows += [(100, None, 1), (101, [], 1), (102, [0.0] * 10, 1), (103, [float("nan")] * 10, 1), (104, [None] + one[1:], 1), (105, one, 1), (106, one, 1), (107, [1.0, 2.0], 1), (108, [2.0, 4.0], 1), (109, [float("inf")] + one[1:], 1)]
    got = vectors.near_vectors(spark.createDataFrame([(*r, "k", 1) for r in rows], V)).collect()
    assert sorted(map(tuple, got)) == vectors_by_hand(rows)
    assert vectors.near_vectors(spark.createDataFrame([], V)).count() == 0
