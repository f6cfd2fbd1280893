import random
import re

from pointloom.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def by_hand(docs, items):
    wins = {}
    for i, t in items:
        w = words(t)
        n = min(10, len(w))
        if i is not None and n:
            for k in range(len(w) - n + 1):
                wins.setdefault(tuple(w[k : k + n]), set()).add(str(i))
    out = []
    for i, t in docs:
        w, hit, ids = words(t), set(), set()
        for n in {len(k) for k in wins}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in wins:
                    hit.update(range(k, k + n))
                    ids |= wins[tuple(w[k : k + n])]
        out.append((str(i), len(w), len(hit), sorted(ids)))
    return sorted(out)


def run(spark, docs_of, docs, items):
    bench = spark.createDataFrame(items, "item_id long, text string")
    return sorted((str(r.doc_id), r.n_words, r.n_hit, list(r["items"])) for r in decontaminate.contamination(docs_of(docs), bench).collect())


def test_against_brute_force(spark, docs_of):
    random.seed(5)
    vocab = [f"w{i}" for i in range(8)]
    some = lambda n: " ".join(random.choice(vocab) for _ in range(n))
    items = [(i, some(random.choice([1, 3, 9, 10, 11, 30]) if i % 5 == 0 else 25)) for i in range(1, 25) if i % 25] + [(99, None), (98, ""), (None, "w1 w2"), (3, "w1")]
    items = [x for x in items if not (x[1] and len(x[1].split()) < 4 and x[0] not in (3,))]
    docs = [(i, some(40)) for i in range(30)] + [(100, (items[1][1] + ", " + some(3)).upper()), (101, items[2][1].replace(" ", "--")), (102, None), (103, "")]
    assert run(spark, docs_of, docs, items) == by_hand(docs, items)


def test_odd_rows_and_empty_tables(spark, docs_of, odd_rows):
    items = [(1, " ".join(f"w{i % 977}x{i}" for i in range(29_000, 29_030))), (2, "a b"), (3, "a b")]
    assert run(spark, docs_of, odd_rows, items) == by_hand(odd_rows, items)
    assert run(spark, docs_of, [], items) == []
    assert [x[2:] for x in run(spark, docs_of, odd_rows, [])] == [(0, [])] * len(odd_rows)


def test_clean_rows_stay(spark, docs_of):
    bench = spark.createDataFrame([(1, "one two three four five six seven eight nine ten")], "item_id long, text string")
    docs = docs_of([(1, "clean text"), (2, "so one two three four five six seven eight nine ten it is"), (None, "x")])
    kept = decontaminate.drop_contaminated(docs, bench)
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "None"] and kept.columns == docs.columns
