"""Benchmark decontamination by winnowed fingerprints."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.llm.arrow import slices
from pointloom.llm.bitfilter import BitFilter
from pointloom.session import ROW, numbered, prepare, table

#: Words of a window, and of the k-grams that are winnowed. A window holds WINDOW - GRAM + 1 k-grams; both sides keep
#: the least of these, so every shared window has a fingerprint in common.
WINDOW, GRAM = 10, 6
_NON_WORD = bytes(range(0x30)) + bytes(range(0x3A, 0x61)) + bytes(range(0x7B, 0x80))
_UPPER = bytes(range(0x41, 0x5B))
#: Bytes to bytes: A-Z to lower case, others that belong to no word to a space.
_FOLD = bytes(i + 32 if i in _UPPER else 32 if i in _NON_WORD else i for i in range(256))
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: bytes) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z; UTF-8 bytes of other characters belong to words."""
    return text.translate(_FOLD).split()


class WordHashes(dict):
    """Word -> 64-bit hash, remembered for a bounded number of words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 400_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def hash_words(words: list[bytes], known: WordHashes) -> np.ndarray:
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k consecutive word hashes; k takes part in it."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    g = np.full(n, k, dtype=np.uint64)
    for j in range(k):
        g *= _MIX
        g ^= h[j : j + n]
        g ^= g >> np.uint64(29)
    g *= _MIX
    return g ^ (g >> np.uint64(32))


def winnow(g: np.ndarray, w: int) -> np.ndarray:
    """Positions of the minima (the last of equal ones) of each w consecutive k-gram hashes."""
    n = len(g) - w + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    low, at = g[:n].copy(), np.arange(n)
    for j in range(1, w):
        other = g[j : j + n]
        less = other <= low
        low[less] = other[less]
        at[less] = np.flatnonzero(less) + j
    return np.unique(at)


def _item_rows(window: int, gram: int):
    """Arrow stage: the fingerprints or the windows of benchmark items."""

    def fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for _, texts in slices(batches):
            out, size = [], []
            for t in texts:
                h = hash_words(words_of(t), known)
                if len(h):
                    g = gram_hashes(h, gram)[winnow(gram_hashes(h, gram), window - gram + 1)] if len(h) >= window else gram_hashes(h, len(h))
                    out.append(g)
                    size.append(np.full(len(g), min(len(h), window), dtype=np.int32))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out).view(np.int64)), pa.array(np.concatenate(size))], ["g", "n"])

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in slices(batches):
            ids, keys = [], []
            for item, t in zip(rows.column("item_id").to_pylist(), texts, strict=True):
                w = words_of(t)
                n = min(window, len(w))
                for key in {b" ".join(w[i : i + n]) for i in range(len(w) - n + 1)} if n else ():
                    ids.append(item)
                    keys.append(key)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(ids, pa.string())], ["key", "item"])

    return fingerprints, windows


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(doc_id, n_words, spans, n_hit, items) for each row of docs.

    spans: sorted (start, end) word ranges of the windows that occur in an item; n_hit: the words in their union; items: sorted ids (as strings) of the items with such a window. An item's windows are its runs of ``window`` words, or all of its words if it has fewer. Null texts have no words; items with a null id or without words match nothing; repeated rows count each for themselves; extra columns are ignored.
    Documents' winnowed fingerprints are tested against a filter of fixed maximal size over the benchmark's; each that passes is extended to the windows around it, which are then joined to the items' windows word for word.
    """
    texts = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return _found(texts, benchmark, window, gram).drop("rid")


def _found(texts: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """contamination() of (rid, doc_id, text), with rid."""
    bench = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null")
    fingerprints, item_windows = _item_rows(window, gram)
    found = bench.select("text").mapInArrow(fingerprints, "g long, n int")
    passing = BitFilter(found.select("g"), int(bench.agg(F.sum(F.length("text"))).first()[0] or 0) // 4)
    short = sorted(r[0] for r in found.where(F.col("n") < window).select("n").distinct().collect())  # below window: a handful
    passes = passing.test

    schema = pa.schema([("rid", pa.int64()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("key", pa.binary()), ("start", pa.int32()), ("end", pa.int32())])

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        reach = window - gram
        for rows, texts in slices(batches):
            out: list[list] = [[] for _ in schema]

            def add(*row, out=out):
                for column, value in zip(out, row, strict=True):
                    column.append(value)

            for rid, doc, t in zip(rows.column("rid").to_pylist(), rows.column("doc_id").to_pylist(), texts, strict=True):
                w = words_of(t)
                h = hash_words(w, known)
                add(rid, doc, len(w), b" %d" % rid, None, None)  # no window starts with a space
                g = gram_hashes(h, gram)
                at = winnow(g, reach + 1)
                at = at[passes(g[at])]
                if len(at):
                    starts = np.unique(at[:, None] - np.arange(reach + 1))
                    for s in starts[(starts >= 0) & (starts + window <= len(w))].tolist():
                        add(rid, None, None, b" ".join(w[s : s + window]), s, s + window)
                for n in short:
                    for s in np.flatnonzero(passes(gram_hashes(h, n))).tolist():
                        add(rid, None, None, b" ".join(w[s : s + n]), s, s + n)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, schema.types, strict=True)], schema=schema)

    cand = texts.mapInArrow(candidates, "rid long, doc_id long, n_words long, key binary, start int, end int")
    keys = bench.mapInArrow(item_windows, "key binary, item string").groupBy("key").agg(F.sort_array(F.collect_set("item")).alias("items"))
    hits = cand.join(keys, "key", "left").where("start is null or items is not null")
    one = hits.groupBy("rid").agg(F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.array_sort(F.collect_set(F.when(F.col("start").isNotNull(), F.struct("start", "end")))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    union = F.aggregate("spans", F.struct(F.lit(0).alias("n"), F.lit(0).alias("e")), lambda a, s: F.struct((a["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(s["start"], a["e"]))).alias("n"), F.greatest(s["end"], a["e"]).alias("e")), lambda a: a["n"].cast("long"))
    return one.select("rid", "doc_id", "n_words", "spans", union.alias("n_hit"), "items")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs without a shared window, each by its own text, whatever its doc_id."""
    rows = numbered(docs)
    texts = rows.select(F.col(ROW).alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    bad = _found(texts, benchmark).where("n_hit > 0").select(F.col("rid").alias(ROW))
    return rows.join(bad, ROW, "left_anti").select(*docs.columns)


ORACLE = """
with d as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') as w from documents),
b as (select item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') as w from benchmark),
bw as (select distinct item_id, n, list_aggregate(w[i : i + n - 1], 'string_agg', ' ') as win from (select item_id, w, least(10, len(w)) as n, unnest(range(1, cast(len(w) - least(10, len(w)) + 2 as bigint))) as i from b where len(w) > 0)),
lens as (select distinct n from bw),
dw as (select doc_id, n, i, list_aggregate(w[i : i + n - 1], 'string_agg', ' ') as win from (select doc_id, w, n, unnest(range(1, cast(greatest(len(w) - n + 2, 1) as bigint))) as i from d, lens)),
hit as (select distinct doc_id, i, n, item_id from dw join bw using (n, win)),
pos as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from (select distinct doc_id, i, n from hit)) group by doc_id),
its as (select doc_id, count(distinct item_id) as n_items, string_agg(distinct cast(item_id as varchar), ',' order by cast(item_id as varchar)) as ids from hit group by doc_id)
select d.doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join pos on d.doc_id = pos.doc_id left join its on d.doc_id = its.doc_id
"""
