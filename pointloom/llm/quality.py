"""Quality classifier: perplexity under an interpolated modified Kneser-Ney model of trusted text."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.llm.arrow import slices
from pointloom.llm.bitfilter import BitFilter
from pointloom.session import cut, prepare, table

#: Bytes of an n-gram; a gram is the number that its bytes spell, so it is its own key. At most 7.
ORDER = 5
#: Levels whose tables are held whole: 256 ** DENSE cells whatever the corpus.
DENSE = 2
#: Bytes of text that ask for their grams' probabilities together, about.
BLOCK_BYTES = 32 << 20
#: Share of trusted text of a language that passes.
QUANTILE = 0.98
_START = 10


def _grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(ORDER-grams as numbers, lengths): one gram for each byte, the first ones preceded by line ends."""
    pad = bytes([_START]) * (ORDER - 1)
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    s = np.frombuffer(b"".join(pad + t for t in texts), np.uint8).astype(np.int64)
    g = np.zeros(max(0, len(s) - ORDER + 1), dtype=np.int64)
    for k in range(ORDER):
        g = (g << 8) | s[k : k + len(g)]
    # the last ORDER - 1 starts of a text reach into the next one
    keep = np.ones(len(g), dtype=bool)
    ends = np.cumsum(lengths + ORDER - 1)[:-1]
    for k in range(1, ORDER):
        keep[ends - k] = False
    return g[keep], lengths


def _distinct(g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct numbers, ascending, and where each begins in the sorted array."""
    s = np.sort(g)
    first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.zeros(0, dtype=np.int64)
    return s[first], first


class _Distinct:
    """Distinct numbers with their counts, from one array after the other."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, g: np.ndarray) -> None:
        s, first = _distinct(g)
        self.parts.append((s, np.diff(first, append=len(g))))
        self.held += len(s)
        if self.held > 1_000_000:
            self.parts = [self.all()]
            self.held = len(self.parts[0][0]) // 2  # merged again when it has grown by half a million at least

    def all(self) -> tuple[np.ndarray, np.ndarray]:
        g, n = (np.concatenate([np.zeros(0, dtype=np.int64), *x]) for x in zip(*self.parts, strict=True)) if self.parts else np.zeros((2, 0), dtype=np.int64)
        order = np.argsort(g, kind="stable")
        g = g[order]
        first = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])) if len(g) else np.zeros(0, dtype=np.int64)
        return g[first], np.add.reduceat(n[order], first) if len(g) else n


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(gram, c) of each block."""
    for _, block in groupby(_blocks(batches), key=itemgetter(0)):
        found = _Distinct()
        for _, _, texts in block:
            found.add(_grams(texts)[0])
        g, n = found.all()
        yield pa.RecordBatch.from_arrays([pa.array(g), pa.array(n)], ["gram", "c"])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch, list[bytes]]]:
    """Slices of rows with the number of their block, which has about BLOCK_BYTES of text."""
    k, size = 0, 0
    for rows, texts in slices(batches):
        yield k, rows, texts
        size += sum(map(len, texts))
        if size >= BLOCK_BYTES:
            k, size = k + 1, 0


def discounts(n1: float, n2: float, n3: float, n4: float) -> tuple[float, float, float]:
    """What is taken off counts of 1, 2 and more, from the numbers of grams that occur so often; 0.5, 1 and 1.5 where those aren't defined."""
    if min(n1, n2, n3, n4) == 0:
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    d = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return tuple(min(max(x, 0.05), k + 0.95) for k, x in enumerate(d))


def dense(counts: np.ndarray, below: np.ndarray) -> np.ndarray:
    """Probabilities of all grams of one level, from their counts and those of the level below."""
    d = np.array([0.0, *discounts(*(float((counts == k).sum()) for k in (1, 2, 3, 4)))])
    rows = counts.reshape(-1, 256).astype(float)
    off = d[np.minimum(rows, 3).astype(np.int64)]
    total = rows.sum(axis=1, keepdims=True)
    back = below[np.arange(len(counts)) % len(below)].reshape(-1, 256)
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(total > 0, (rows - off + off.sum(axis=1, keepdims=True) * back) / total, back).ravel()


@dataclass
class QualityModel:
    levels: dict[int, DataFrame]  # level -> (gram, c) with DENSE < level <= ORDER
    off: dict[int, tuple[float, float, float]]  # level -> discounts
    low: np.ndarray  # probabilities of all grams of level DENSE


def _suffix(n: int) -> Column:
    return F.col("gram").bitwiseAND(F.lit((1 << 8 * n) - 1).cast("long"))


def train(texts: DataFrame) -> QualityModel:
    """texts: one string column of trusted text, all of which is counted: per block, then summed by gram over the shards.

    Below ORDER a gram's count is the number of bytes before which it is known. Each level has three discounts of its own.
    """
    rows = texts.select(F.col(texts.columns[0]).cast("string").alias("text")).where("text is not null")
    levels = {ORDER: cut(rows.mapInArrow(_count, "gram long, c long").groupBy("gram").agg(F.sum("c").alias("c")))}
    for n in range(ORDER - 1, DENSE - 1, -1):
        levels[n] = levels[n + 1].groupBy(_suffix(n).alias("gram")).agg(F.count("*").alias("c"))
        levels[n] = cut(levels[n]) if n > DENSE else levels[n]
    got = levels.pop(DENSE).toArrow()  # at most 256 ** DENSE rows
    counts = np.zeros(256**DENSE)
    counts[got.column("gram").to_numpy()] = got.column("c").to_numpy()
    below = [counts]
    for n in range(DENSE - 1, 0, -1):
        below.append((below[-1] > 0).reshape(-1, 256**n).sum(axis=0))
    low = np.full(1, 1 / 256)
    for c in reversed(below):
        low = dense(c, low)
    off = {n: discounts(*df.agg(*(F.count_if(F.col("c") == k) for k in (1, 2, 3, 4))).first()) for n, df in levels.items()}
    return QualityModel(levels, off, low)


def probabilities(grams: DataFrame, model: QualityModel) -> DataFrame:
    """(gram, p) for the distinct ORDER-grams of a column ``gram``: the interpolated probability of the last byte after the others.

    Level by level: the gram's count joins by gram, its context's sums by the context, the lower level's probability by the gram without its first byte. A context that isn't known leaves the lower level's probability as it is.
    """
    asked = {ORDER: cut(grams.select("gram").distinct())}
    for n in range(ORDER - 1, DENSE - 1, -1):
        asked[n] = asked[n + 1].select(_suffix(n).alias("gram")).distinct()
    low = grams.sparkSession.createDataFrame(pa.table({"gram": np.arange(len(model.low)), "p": model.low}))
    p = low
    for n in range(DENSE + 1, ORDER + 1):
        c, off = F.col("c"), model.off[n]
        discount = F.when(c == 1, off[0]).when(c == 2, off[1]).when(c > 2, off[2]).otherwise(0.0)
        sums = model.levels[n].groupBy(F.shiftright("gram", 8).alias("context")).agg(F.sum("c").alias("total"), F.sum(discount).alias("taken"))
        known = asked[n].join(model.levels[n], "gram", "left").select("gram", F.coalesce("c", F.lit(0)).alias("c"), F.shiftright("gram", 8).alias("context"), _suffix(n - 1).alias("rest"))
        met = known.join(sums, "context", "left").join(p.select(F.col("gram").alias("rest"), F.col("p").alias("back")), "rest")
        value = F.when(F.col("total").isNull(), F.col("back")).otherwise((c - discount + F.col("taken") * F.col("back")) / F.col("total"))
        p = cut(met.select("gram", value.alias("p")))
    return p


def _block_id(k: int) -> int:
    return TaskContext.get().partitionId() << 32 | k


def _ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, gram): the distinct grams of each block."""
    for k, block in groupby(_blocks(batches), key=itemgetter(0)):
        found = _Distinct()
        for _, _, texts in block:
            found.add(_grams(texts)[0])
        g, _ = found.all()
        for at in range(0, len(g), 100_000):
            some = g[at : at + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), _block_id(k))), pa.array(some)], ["block", "gram"])


_PACKED = pa.schema([("block", pa.int64()), ("ids", pa.list_(pa.int64())), ("langs", pa.list_(pa.string())), ("lengths", pa.list_(pa.int64())), ("data", pa.binary())])


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of a block, compressed slice by slice; blocks as in _ask."""
    for k, rows, texts in _blocks(batches):
        data = pa.compress(b"".join(texts), codec="zstd", asbytes=True)
        columns = [[_block_id(k)], [rows.column("doc_id").to_pylist()], [rows.column("lang").to_pylist()], [[len(t) for t in texts]], [data]]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _PACKED, strict=True)], schema=_PACKED)


def _score(texts: pa.Table, answers: pa.Table) -> pa.Table:
    """(doc_id, lang, perplexity) of the rows of one block."""
    gram, bits = answers.column("gram").combine_chunks(), np.log2(answers.column("p").to_numpy())
    out: list[list] = [[], [], []]
    for ids, langs, lengths, data in zip(*(texts.column(c).to_pylist() for c in ("ids", "langs", "lengths", "data")), strict=True):
        flat, ends = pa.decompress(data, decompressed_size=sum(lengths), codec="zstd", asbytes=True), np.cumsum(lengths).tolist()
        g, _ = _grams([flat[z - n : z] for z, n in zip(ends, lengths, strict=True)])
        at = pc.index_in(pa.array(g), value_set=gram)
        if at.null_count:
            raise RuntimeError("a block's rows changed between two reads; write the documents to a table first")
        sums = np.concatenate([[0.0], np.cumsum(bits[at.to_numpy()])])
        for i, (doc, lang, z, n) in enumerate(zip(ids, langs, ends, lengths, strict=True)):
            out[0].append(doc)
            out[1].append(lang)
            out[2].append(math.exp2(min(1000.0, (sums[z - n] - sums[z]) / n)) if n else None)
    return pa.table([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.string(), pa.float64()), strict=True)], ["doc_id", "lang", "perplexity"])


def perplexity(docs: DataFrame, model: QualityModel) -> DataFrame:
    """(doc_id, lang, perplexity) for each row of docs: per byte, over its whole text; null for an empty or null text. Extra columns are ignored.

    Blocks of about BLOCK_BYTES of text ask for their distinct grams, which bounds the rows of a frequent gram by the number of blocks; grams meet the model in joins, and a block's answers its compressed texts. docs is read twice and must come in the same partitions both times, as a table does; if it doesn't, the job fails.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    asked = base.mapInArrow(_ask, "block long, gram long")
    answers = asked.join(probabilities(asked, model), "gram")
    texts = base.mapInArrow(_pack, "block long, ids array<long>, langs array<string>, lengths array<long>, data binary")
    return texts.groupBy("block").cogroup(answers.select("block", "gram", "p").groupBy("block")).applyInArrow(_score, "doc_id long, lang string, perplexity double")


def rows_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows (doc_id, text) of docs whose doc_id stands in ids (one distinct long column doc_id); texts of others aren't shuffled, but for a few."""
    wanted = BitFilter(ids.select(F.xxhash64("doc_id").alias("g")), ids.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = wanted.test(b.column("g").to_numpy().view(np.uint64))
            yield b.filter(pa.array(ok)).select(["doc_id", "text"])

    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")
    return base.withColumn("g", F.xxhash64("doc_id")).mapInArrow(run, "doc_id long, text string").join(ids, "doc_id", "left_semi")


def classify(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """(doc_id, lang, perplexity, threshold, keep) for each row of docs.

    Trusted are the documents of labels.quality 1. The model counts all of them but those whose crc32(doc_id as text) mod 5 is 1; the threshold of a language is the quantile of the perplexity of just these, or of all trusted ones where there are fewer than 20. A language without any gets the quantile over all languages, and without any trusted text everything but empty text is kept. keep: the perplexity is at most the threshold; texts without a byte aren't kept. A null lang is a language of its own.
    """
    good = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality = 1").select("doc_id").distinct()
    tested = F.expr("pmod(crc32(cast(cast(doc_id as string) as binary)), 5) = 1")
    model = train(rows_of(docs, good.where(~tested)).select("text"))
    scored = cut(perplexity(docs, model))
    trusted = scored.where("perplexity is not null").join(good, "doc_id", "left_semi").withColumn("tested", tested)
    q, n = F.lit(quantile), F.lit(10_000)

    def limits(rows):
        return rows.agg(F.percentile_approx(F.when(F.col("tested"), F.col("perplexity")), q, n).alias("a"), F.percentile_approx("perplexity", q, n).alias("b"), F.count_if("tested").alias("n"))

    pick = F.when(F.col("n") >= 20, F.col("a")).otherwise(F.col("b"))
    by_lang = limits(trusted.groupBy("lang")).select(F.col("lang").alias("l"), pick.alias("own"))
    overall = limits(trusted).select(pick.alias("any"))
    # overall is one row, by_lang has one for each language
    out = scored.join(by_lang, F.col("lang").eqNullSafe(F.col("l")), "left").join(F.broadcast(overall), how="left")
    out = out.withColumn("threshold", F.coalesce("own", "any", F.lit(float("inf"))))
    return out.select("doc_id", "lang", "perplexity", "threshold", F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(False)).alias("keep"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
