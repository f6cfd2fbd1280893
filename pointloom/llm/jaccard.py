"""Near-duplicate join on word shingles: banded MinHash candidates, Bayesian pruning, exact verification."""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.graph import connected_components
from pointloom.llm.arrow import slices
from pointloom.llm.bitfilter import BitFilter
from pointloom.llm.decontaminate import WordHashes, gram_hashes, hash_words, words_of
from pointloom.session import ROW, cut, prepare, table

SHINGLE = 5
#: Similarity from which documents are linked, as a fraction.
THRESHOLD = 4, 5
#: A pair at the threshold shares no band with probability (1 - 0.8^6)^32 = 6e-5, a more similar one with less.
BANDS, ROWS = 32, 6
#: MinHash values that are compared before each pruning, and the posterior probability below which a pair is dropped.
STEPS, TOLERANCE = (32, 64, 128, 192), 1e-7
#: Classes and shingles of one tile side, about; larger groups are dealt over several tiles, smaller ones share lanes.
TILE_ROWS, TILE_SHINGLES, LANE_SHINGLES = 1024, 1_000_000, 200_000
#: A character that stands in a word.
_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
_rng = np.random.default_rng(7)
_A = (_rng.integers(0, 1 << 31, BANDS * ROWS, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
_B = _rng.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)


def shingle_set(text: bytes, known: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the runs of SHINGLE words; of all words, if there are fewer; empty without words."""
    h = hash_words(words_of(text), known)
    return np.unique(gram_hashes(h, min(SHINGLE, len(h)))) if len(h) else np.zeros(0, dtype=np.uint64)


def min_hashes(sets: list[np.ndarray]) -> np.ndarray:
    """(len(sets), BANDS * ROWS) 32-bit minima of the non-empty sets."""
    out = np.empty((len(sets), BANDS * ROWS), dtype=np.uint32)
    if not sets:
        return out
    x = np.concatenate(sets)
    x = (x ^ (x >> np.uint64(32))).astype(np.uint32)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    v = np.empty_like(x)
    for k in range(BANDS * ROWS):
        np.multiply(x, _A[k], out=v)
        v += _B[k]
        v ^= v >> np.uint32(15)
        out[:, k] = np.minimum.reduceat(v, starts)
    return out


def band_hashes(m: np.ndarray) -> np.ndarray:
    """(rows of m, BANDS) 64-bit hashes of ROWS minima each; the band takes part."""
    g = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(m), BANDS)).copy()
    for r in range(ROWS):
        g = (g ^ m[:, r::ROWS].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        g ^= g >> np.uint64(29)
    return g


def _key(s: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(s.tobytes())


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, doc_id, key, k, bands): key names the shingle set, k is its first half; null without words."""
    known = WordHashes()
    for rows, texts in slices(batches):
        sets = [shingle_set(t, known) for t in texts]
        keys = [_key(s) if len(s) else None for s in sets]
        g = iter(band_hashes(min_hashes([s for s in sets if len(s)])).view(np.int64).tolist())
        bands = [next(g) if len(s) else None for s in sets]
        half = [int.from_bytes(k[:8], "little", signed=True) if k else None for k in keys]
        yield pa.RecordBatch.from_arrays([rows.column("row"), rows.column("doc_id"), pa.array(keys, pa.binary()), pa.array(half, pa.int64()), pa.array(bands, pa.list_(pa.int64()))], ["row", "doc_id", "key", "k", "bands"])


def _content(wanted: BitFilter):
    """Arrow stage: (doc_id, key, minima, shingles) of documents whose set passes the filter, each set once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, seen = WordHashes(), set()
        for rows, texts in slices(batches):
            ids, keys, sets = [], [], []
            for doc, t in zip(rows.column("doc_id").to_pylist(), texts, strict=True):
                s = shingle_set(t, known)
                if len(s):
                    key = _key(s)
                    if key not in seen and wanted.test(np.frombuffer(key[:8], "<u8"))[0]:
                        seen.add(key)
                        ids.append(doc)
                        keys.append(key)
                        sets.append(s)
            m = min_hashes(sets)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array([r.tobytes() for r in m], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], ["key", "minima", "shingles"])

    return run


@functools.cache
def least_matches(n: int, num: int, den: int, tolerance: float) -> int:
    """The fewest equal values among n with which P(similarity >= num/den) is at least the tolerance, for a uniform prior: the posterior is Beta(m + 1, n - m + 1), whose upper tail is a binomial sum."""
    t = num / den
    for m in range(n + 1):
        # P(Beta(m+1, n-m+1) > t) = P(Binomial(n + 1, t) <= m)
        if sum(math.comb(n + 1, i) * t**i * (1 - t) ** (n + 1 - i) for i in range(m + 1)) >= tolerance:
            return m
    return n + 1


def _links(a: np.ndarray, b: np.ndarray, minima: np.ndarray, sets: list[np.ndarray], same: bool) -> Iterator[tuple[int, np.ndarray]]:
    """(row of a, linked rows of b) for rows given as numbers into minima and sets; same: a and b are the same rows, pairs come once."""
    num, den = THRESHOLD
    sizes = np.array([len(sets[j]) for j in b])
    vocabulary, ids = np.unique(np.concatenate([sets[j] for j in b]), return_inverse=True)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    mb = minima[b]
    for p, i in enumerate(a):
        rest = np.arange(p + 1 if same else 0, len(b))
        n = len(sets[i])
        rest = rest[(np.minimum(sizes[rest], n) * den >= np.maximum(sizes[rest], n) * num)]
        got, last = np.zeros(len(rest), dtype=np.int64), 0
        for step in STEPS:
            if not len(rest):
                break
            got += (mb[rest, last:step] == minima[i, last:step]).sum(axis=1)
            ok = got >= least_matches(step, num, den, TOLERANCE)
            rest, got, last = rest[ok], got[ok], step
        if not len(rest):
            continue
        at = np.searchsorted(vocabulary, sets[i])
        at[at == len(vocabulary)] = 0
        mark = np.zeros(len(vocabulary), dtype=np.int32)
        mark[at[vocabulary[at] == sets[i]]] = 1
        if 4 * len(rest) > len(b):
            common = np.add.reduceat(mark[ids], starts)[rest]
        else:
            common = np.array([mark[ids[starts[r] : starts[r] + sizes[r]]].sum() for r in rest])
        linked = rest[common * (num + den) >= num * (n + sizes[rest])]
        if len(linked):
            yield p, linked


def _tile(key: tuple, rows: pa.Table) -> pa.Table:
    """(key, other, links): with other null, links that a class gains in this tile; else a pair that spans a group of linked classes."""
    comp, block = rows.column("comp").to_pylist(), rows.column("block").to_numpy()
    keys, weight = rows.column("key").to_pylist(), rows.column("weight").to_numpy()
    first, groups = {}, {}
    for r, k in enumerate(keys):  # a set that several tasks have read counts once
        if first.setdefault((comp[r], k), r) == r:
            groups.setdefault(comp[r], []).append(r)
    minima = np.frombuffer(b"".join(rows.column("minima").to_pylist()), np.uint32).reshape(-1, BANDS * ROWS)
    sets = [np.frombuffer(s, np.uint64) for s in rows.column("shingles").to_pylist()]
    lane, i, j = (x.as_py() for x in key)
    links, parent = np.zeros(len(keys), dtype=np.int64), np.arange(len(keys))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out_key, out_other, out_links = [], [], []
    for members in groups.values():
        g = np.array(members)
        a, b = (g[block[g] == i], g[block[g] == j]) if i != j else (g, g)
        if not len(a) or not len(b):
            continue
        for p, linked in _links(a, b, minima, sets, i == j):
            q = b[linked]
            links[a[p]] += weight[q].sum()
            links[q] += weight[a[p]]
            for x in q:
                s, t = root(int(a[p])), root(int(x))
                if s != t:
                    parent[t] = s
                    out_key.append(keys[a[p]])
                    out_other.append(keys[x])
                    out_links.append(0)
    for r in np.flatnonzero(links):
        out_key.append(keys[r])
        out_other.append(None)
        out_links.append(int(links[r]))
    return pa.table([pa.array(out_key, pa.binary()), pa.array(out_other, pa.binary()), pa.array(out_links, pa.int64())], ["key", "other", "links"])


def similar_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, class_id, n_links) for each row of docs.

    Two rows are linked if the Jaccard similarity of their sets of five-word shingles is at least 0.8; n_links counts the other linked rows, class_id is the smallest doc_id reachable by links. Words as in decontamination; a text of 1 to 4 words is one shingle; a null text or one without words links with nothing, not even with its like, and is its own class. Repeated rows are rows of their own; a null doc_id is never the smallest unless all are null. Extra columns are ignored.
    Rows with equal sets become one weighted class first. Classes that share a MinHash band join a candidate group (connected components over bands); only these send their shingles on. Groups are compared within tiles of bounded size, a larger group in several, so no group meets in one task and no pair becomes a row.
    """
    base = docs.select(F.lit(None).cast("string").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sketches, weights, found, groups = _groups(base)
    links = found.where("other is null").groupBy("key").agg(F.sum("links").alias("links"))
    least = groups.join(weights, "key").groupBy("component").agg(F.min("rep").alias("least"))
    classes = weights.join(links, "key", "left").join(groups.join(least, "component").select("key", "least"), "key", "left")
    classes = classes.select("key", F.coalesce("least", "rep").alias("class"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("links"))
    out = sketches.select("doc_id", "key").join(classes, "key", "left")
    return out.select("doc_id", F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("class")).alias("class_id"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"))


def _groups(base: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Of (row, doc_id, text): the sketches, the weights of their keys, what the tiles found, and (key, component) of linked keys."""
    sketches = cut(base.mapInArrow(_sketch, "row string, doc_id long, key binary, k long, bands array<long>"))
    known = sketches.where("key is not null")
    bands = known.select("key", F.explode("bands").alias("band"))
    shared = bands.groupBy("band").agg(F.min("key").alias("low"), F.max("key").alias("high")).where("low <> high").select("band", "low")
    edges = bands.join(shared, "band").where("key <> low").select("key", "low").distinct()
    comps = connected_components(edges, "key", "low").withColumnRenamed("component", "comp")
    weights = known.groupBy("key", "k").agg(F.count("*").alias("weight"), F.min("doc_id").alias("rep"))
    members = cut(weights.join(comps.withColumnRenamed("node", "key"), "key"))
    wanted = BitFilter(members.select("k"), members.count())
    content = base.mapInArrow(_content(wanted), "key binary, minima binary, shingles binary").join(members.select("key", "comp", "weight"), "key")
    content = cut(content.withColumn("n", (F.length("shingles") / 8).cast("long")))
    sizes = content.groupBy("comp").agg(F.count("*").alias("n_rows"), F.sum("n").alias("n_all"))
    blocks = sizes.select("comp", F.ceil(F.greatest(F.col("n_rows") / TILE_ROWS, F.col("n_all") / TILE_SHINGLES)).cast("int").alias("blocks"))
    lanes = max(1, int((content.agg(F.sum("n")).first()[0] or 0) // LANE_SHINGLES))
    tiles = content.join(blocks, "comp").withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    tiles = tiles.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tiles = tiles.select("comp", "block", "key", "weight", "minima", "shingles", F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("comp"), F.lit(lanes))).otherwise(F.xxhash64("comp")).alias("lane"), F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    found = cut(tiles.groupBy("lane", "i", "j").applyInArrow(_tile, "key binary, other binary, links long"))
    groups = connected_components(found.where("other is not null"), "key", "other").withColumnRenamed("node", "key")
    return sketches, weights, found, groups


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return similar_documents(table(spark, sf_dir, "documents"))


def keep_one(docs: DataFrame) -> DataFrame:
    """Of each class of similar_documents() the row with the smallest doc_id, one without an id only where no row of the class has one; of rows with the same id one of least hash. Rows without words stay.

    Rows are named by 128 bits of hashes of doc_id and text; of rows that agree in both any one is as good.
    """
    worded = F.coalesce(F.col("text").cast("string").rlike(_WORD), F.lit(False))
    name = F.concat(*(F.hex(F.xxhash64(F.lit(k), F.col("doc_id").isNull(), "doc_id", "text")) for k in (1, 2)))
    rows = docs.where(worded).withColumn(ROW, name)
    sketches, _, _, groups = _groups(rows.select(F.col(ROW).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    firsts = sketches.groupBy("key").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row")).alias("first"))
    firsts = firsts.join(groups, "key", "left").groupBy(F.coalesce("component", "key").alias("class")).agg(F.min("first").alias("first"))
    kept = rows.join(firsts.select(F.col("first.row").alias(ROW)), ROW, "left_semi").dropDuplicates([ROW])
    return kept.select(*docs.columns).unionByName(docs.where(~worded))


ORACLE = """
with recursive d as (select row_number() over () as r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') as w from documents),
s as (select distinct r, list_aggregate(w[i : i + least(5, len(w)) - 1], 'string_agg', ' ') as g from d, unnest(range(1, cast(greatest(len(w) - 3, 2) as bigint))) as t(i) where len(w) > 0),
n as (select r, count(*) as n from s group by r),
l as (select a.r as x, b.r as y from s a join s b on a.g = b.g and a.r <> b.r join n on n.r = a.r join n m on m.r = b.r where least(n.n, m.n) * 5 >= greatest(n.n, m.n) * 4 group by a.r, b.r, n.n, m.n having count(*) * 9 >= 4 * (n.n + m.n)),
c(r, t) as (select r, r from d union select c.r, l.y from c join l on c.t = l.x),
k as (select c.r, min(d.doc_id) as class_id from c join d on d.r = c.t group by c.r),
e as (select x, count(*) as n_links from l group by x)
select d.doc_id, class_id, coalesce(n_links, 0) as n_links from d join k on k.r = d.r left join e on e.x = d.r
"""
