import random

import corpus_pipeline
import __spark_entry__ as entry
from pointloom.llm import decontaminate, jaccard, toxicity


def make(spark, folder):
    random.seed(14)
    text = lambda n: " ".join(f"{random.choice('bcdfgh')}{random.choice('aeiou')}{random.randrange(3000)}" for _ in range(n))
    docs = [[i, text(80)] for i in range(300)]
    bad = set(range(0, 300, 5))
    for i in bad:
        docs[i][1] += " you idiot scum moron idiot"
    docs[1][1] = docs[2][1] + " tail"
    passage = text(80)
    docs[3][1] += " " + passage
    docs[4][1] += " " + passage
    item = text(20)
    docs[6][1] = text(30) + " " + item + " " + text(30)
    spark.createDataFrame([(*d, "en", "s", len(d[1])) for d in docs] + [(None, "no id here", "en", "s", 10), (400, None, "en", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i in bad)) for i in range(300)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return bad, passage


def test_stages(spark, tmp_path):
    bad, passage = make(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = docs.columns
    ids = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/out{k}")
        docs = spark.read.parquet(f"{tmp_path}/out{k}")
        ids.append({r.doc_id for r in docs.select("doc_id").collect()})
        if k < 4:
            assert docs.columns == columns, name
    assert not ids[0] & bad and len(ids[0]) == 302 - len(bad)
    assert ids[0] - ids[1] == {2}  # document 1 stands for both
    assert ids[1] == ids[2]
    kept = {r.doc_id: r.text for r in spark.read.parquet(f"{tmp_path}/out2").collect()}
    assert passage[200:400] not in kept[3] + kept[4] and kept[400] is None
    assert ids[2] - ids[3] == {6} and ids[3] == ids[4]
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == docs.count()


def test_every_operator_is_registered():
    names = entry.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert set(entry.oracle_sql()) <= set(names)


def test_decisions_are_taken_row_by_row(spark, docs_of):
    random.seed(16)
    text = lambda n: " ".join(f"{random.choice('bcdfgh')}{random.choice('aeiou')}{random.randrange(3000)}" for _ in range(n))
    a, b, c = text(120), text(120), text(120)
    kept = lambda d: sorted((str(r.doc_id), r.text) for r in d.collect())
    # repeated rows, another text of the same id, copies without an id
    got = jaccard.keep_one(docs_of([(1, a), (1, a), (1, b), (2, a + " tail"), (None, c), (None, c), (5, None), (5, None)]))
    assert sorted((r.doc_id or 0, r.text or "") for r in got.collect()) == sorted([(1, a), (1, b), (0, c), (5, ""), (5, "")])
    item = text(15)
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert kept(decontaminate.drop_contaminated(docs_of([(None, a + " " + item), (None, b), (4, c), (4, c + " " + item)]), bench)) == sorted([("None", b), ("4", c)])
    bad = [(i, text(30) + (" you idiot scum moron" if i % 3 == 0 else "")) for i in range(300)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i, _ in bad], "doc_id long, toxic int")
    rows = [(None, text(30) + " you idiot scum moron"), (None, a), (900, b), (900, text(30) + " you idiot scum moron")]
    got = {t for _, t in kept(toxicity.drop_toxic(docs_of(bad + rows), labels))}
    assert {a, b} <= got and not any("scum" in t for t in got)
