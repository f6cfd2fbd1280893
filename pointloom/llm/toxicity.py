"""Toxicity scores: boosted trees over dense features of the whole text, calibrated by isotonic regression."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.llm.arrow import slices
from pointloom.llm.boosting import BoostedTrees, Isotonic
from pointloom.session import prepare, table

#: Bounds of the labelled sample that the model is fitted on, and of the lexicon; scoring has none.
SAMPLE_ROWS, SAMPLE_CHARS, LEXICON_WORDS = 8_000, 200_000, 5_000
#: Second-person words of the covered languages.
SECOND_PERSON = frozenset(w.encode() for w in "you your yours yourself u ur tu te toi ton ta tes vous votre vos du dich dir dein deine ihr euch euer sie ihnen usted ustedes tú ti vosotros vuestro vuestra".split())
#: Characters read as letters in obfuscated words.
LEET = bytes.maketrans(b"0134578@$!", b"oieastbasi")
TIERS = (4.0, 7.0, 12.0)
FOLDS = 5
_CLEAR = bytes(32 if i < 0x30 or 0x3A <= i < 0x41 or 0x5B <= i < 0x61 or 0x7B <= i < 0x80 else i for i in range(256))
_MIXED = re.compile(rb"[^\s]*[A-Za-z\x80-\xff][0-9@$!*]+[A-Za-z\x80-\xff][^\s]*")
_STRETCHED = re.compile(rb"([A-Za-z])\1\1")


def held_out(doc_id) -> bool:
    """crc32 of the id as text, modulo 3, is 1; such rows are never learned from. A null id counts as held out."""
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % 3 == 1


def _words(text: bytes) -> tuple[list[bytes], list[bytes]]:
    """Lower-case words, and the plain reading of words with digits or signs between letters."""
    low = text.decode("utf-8", "replace").lower().encode()
    return low.translate(_CLEAR).split(), [w.translate(LEET).translate(_CLEAR).replace(b" ", b"") for w in _MIXED.findall(low)]


@dataclass
class Lexicon:
    """Word -> how many standard deviations more often than by chance it stands in toxic texts."""

    z: dict[bytes, float]

    def features(self, text: bytes) -> list[float]:
        words, plain = _words(text)
        n, size = max(1, len(words)), max(1, len(text))
        hits = [(i, self.z[w]) for i, w in enumerate(words) if w in self.z]
        hidden = [self.z[w] for w in plain if w in self.z]
        scores = sorted([s for _, s in hits] + hidden, reverse=True)
        persons = [i for i, w in enumerate(words) if w in SECOND_PERSON] if hits else []
        near = _least_distance([i for i, s in hits if s >= TIERS[1]], persons)
        raw = text.split()
        shouted = sum(w.isupper() and len(w) > 1 for w in raw)
        capitals = sum(map(text.count, _CAPITALS))
        marks = [text.count(c) for c in (b"!", b"?", b"*", b"#", b"@", b"%")]
        counts = [sum(s >= t for s in scores) for t in TIERS]
        return [*(100 * c / n for c in counts), *map(float, counts), scores[0] if scores else 0.0, sum(scores[:3]), 1 / (1 + near), 100 * len(hidden) / n, capitals / size, shouted / max(1, len(raw)), sum(marks) / size, marks[0] / size, 100 * len(plain) / n, 100 * len(_STRETCHED.findall(text)) / n, 1 - len(set(words)) / n]


def _least_distance(a: list[int], b: list[int]) -> int:
    """Between a place of a and one of b, both ascending; 1000 if there is none."""
    if not a or not b:
        return 1000
    x, y = np.array(a), np.array(b)
    k = np.searchsorted(y, x)
    return int(min(np.abs(x - y[np.maximum(k - 1, 0)]).min(), np.abs(x - y[np.minimum(k, len(y) - 1)]).min()))


_CAPITALS = [bytes([c]) for c in range(65, 91)]


def _lexicon(docs: list[np.ndarray], y: np.ndarray, vocabulary: list[bytes]) -> Lexicon:
    """From documents given as their distinct word numbers."""
    n1 = np.bincount(np.concatenate([d for d, t in zip(docs, y, strict=True) if t] or [np.zeros(0, int)]), minlength=len(vocabulary))
    n = np.bincount(np.concatenate(docs or [np.zeros(0, int)]), minlength=len(vocabulary))
    expected = np.maximum(n * y.mean(), 1e-9)
    z = np.where(n1 >= 3, (n1 - expected) / np.sqrt(expected), 0)
    best = [i for i in np.argsort(-z, kind="stable")[:LEXICON_WORDS] if z[i] >= TIERS[0]]
    return Lexicon({vocabulary[i]: float(z[i]) for i in best})


@dataclass
class ToxicityModel:
    lexicon: Lexicon
    trees: BoostedTrees | None
    calibration: Isotonic | None
    prior: float

    def score(self, texts: list[bytes]) -> np.ndarray:
        if self.trees is None:
            return np.full(len(texts), self.prior)
        return self.calibration.predict(self.trees.predict(np.array([self.lexicon.features(t) for t in texts])))


def fit(texts: list[bytes], labels: np.ndarray) -> ToxicityModel:
    """Lexicon features of each row come from a lexicon of the other folds, and the calibration from trees of the other folds, so neither sees the row's own label. With fewer than 10 rows of either label: the share of toxic rows for every text."""
    y = np.asarray(labels, dtype=float)
    if min(y.sum(), len(y) - y.sum()) < 10:
        return ToxicityModel(Lexicon({}), None, None, float(y.mean()) if len(y) else 0.0)
    number: dict[bytes, int] = {}
    docs = [np.array(sorted({number.setdefault(w, len(number)) for part in _words(t) for w in part}), dtype=int) for t in texts]
    vocabulary = list(number)
    fold = np.arange(len(y)) % FOLDS
    x = [[]] * len(y)
    for k in range(FOLDS):
        lex = _lexicon([d for d, f in zip(docs, fold, strict=True) if f != k], y[fold != k], vocabulary)
        for i in np.flatnonzero(fold == k):
            x[i] = lex.features(texts[i])
    x = np.array(x)
    out = np.zeros(len(y))
    for k in range(FOLDS):
        out[fold == k] = BoostedTrees().fit(x[fold != k], y[fold != k]).predict(x[fold == k])
    return ToxicityModel(_lexicon(docs, y, vocabulary), BoostedTrees().fit(x, y), Isotonic().fit(out, y), float(y.mean()))


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, sample_chars: int = SAMPLE_CHARS) -> ToxicityModel:
    """Fits on at most sample_rows labelled rows that aren't held out: those of least hash of the id, but for texts of more than sample_chars characters. Only the text and the label ``toxic`` (0 or 1) are used; null texts, ids and labels are left out; of several labels of one id the highest counts."""
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("toxic is not null and doc_id is not null and pmod(crc32(cast(cast(doc_id as string) as binary)), 3) <> 1").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    marks = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(f"text is not null and length(text) <= {sample_chars}")
    # sample_rows bounds what is broadcast
    got = rows.join(F.broadcast(marks), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(sample_rows).select("text", "toxic").toArrow()
    return fit([t.encode() for t in got.column("text").to_pylist()], got.column("toxic").to_numpy())


def scores(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """(doc_id, score) for each row of docs, by its whole text; a null text is empty. Extra columns are ignored."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in slices(batches):
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(held.value.score(texts), pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = scores(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", F.expr("doc_id is null or pmod(crc32(cast(cast(doc_id as string) as binary)), 3) = 1").alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The rows of docs that score below the threshold, each by its own text, whatever its doc_id."""
    held = docs.sparkSession.sparkContext.broadcast(train(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in slices(batches):
            yield rows.filter(pa.array(held.value.score(texts) < threshold))

    return docs.mapInArrow(run, docs.schema)
