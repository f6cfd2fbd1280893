"""Language-model scores of whole texts by a hidden Markov model over word classes."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.llm.hmm import Chain, Counts, by_time, first_chain, log10_likelihood
from pointloom.session import cut, prepare, table

#: Words with a class of their own (the most frequent that occur twice); all others share TAILS classes by their last
#: three bytes. Both bound the model, so that it can be broadcast; they drop no count.
HEAD, TAILS = 65_278, 256
#: Latent states, Baum-Welch rounds over all training texts at most, and the relative gain in likelihood below which they end.
STATES, ROUNDS, GAIN = 8, 14, 1e-4
#: Taken off each count within a tail class, in favour of unknown words.
DISCOUNT = 0.75
#: Tokens that one forward or Baum-Welch block takes at most, about; a block takes as many steps as its longest text, so it holds texts of like length, MEAN_ACTIVE of them at least.
BLOCK_TOKENS, MEAN_ACTIVE = 2_000_000, 1_600
#: Tokens of a Baum-Welch task, about, so that it fills its blocks and sends its counts once for many texts; texts of more than LONG tokens meet in tasks of their own.
TASK_TOKENS, LONG = 4_000_000, 2048
#: Tokens that are counted together before they leave a task, about.
COUNT_TOKENS = 1_500_000
#: Rows of the model that are summed together, and partial sums that one task adds up.
CHUNK, FAN = 1024, 64
_END = b""  # no word is empty


def tokens(text: bytes) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z; the end of the text is counted apart."""
    return text.lower().split()


def _split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The tokens of all texts (null: empty) one after the other, and how many each text has."""
    words = pc.ascii_split_whitespace(pc.ascii_lower(texts.fill_null("")))
    text = np.repeat(np.arange(len(texts)), pc.list_value_length(words).to_numpy())
    flat = words.flatten().cast(pa.binary())
    some = pc.greater(pc.binary_length(flat), 0)  # white space at either end of a text leaves empty strings
    return flat.filter(some), np.bincount(text[some.to_numpy(zero_copy_only=False)], minlength=len(texts))


def held_out(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 5, is 1; a null id is held out too."""
    return F.expr(f"{doc_id} is null or pmod(crc32(cast(cast({doc_id} as string) as binary)), 5) = 1")


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.Array] = []
    ends = size = 0

    def out() -> pa.RecordBatch:
        found = pc.value_counts(pa.chunked_array(held, pa.binary()))
        return pa.RecordBatch.from_arrays([found.field(0), found.field(1)], ["word", "c"])

    for batch in batches:
        words, n = _split(batch.column("text"))
        held.append(words)
        ends, size = ends + len(n), size + len(words)
        if size > COUNT_TOKENS:
            yield out()
            held, size = [], 0
    yield out()
    yield pa.RecordBatch.from_arrays([pa.array([_END], pa.binary()), pa.array([ends], pa.int64())], ["word", "c"])


#: CRC-32 of each byte, by its rule.
_CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _CRC = np.where(_CRC & 1, (_CRC >> 1) ^ np.uint32(0xEDB88320), _CRC >> 1)


def _tail(words: pa.Array) -> np.ndarray:
    """CRC-32 of the last three bytes of each word, modulo TAILS."""
    if not len(words):
        return np.zeros(0, dtype=np.int64)
    _, places, data = words.buffers()
    begin = np.frombuffer(places, "<i4")[words.offset : words.offset + len(words) + 1]
    data, begin, end = np.frombuffer(data, "u1"), begin[:-1], begin[1:]
    crc = np.full(len(words), 0xFFFFFFFF, dtype=np.uint32)
    for k in (3, 2, 1):
        at = end - k
        step = _CRC[(crc ^ data[np.maximum(at, begin)]) & 255] ^ (crc >> 8)
        crc = np.where(at >= begin, step, crc)
    return (~crc % TAILS).astype(np.int64)


@dataclass
class Classes:
    """Word -> class: 0 is the end, then HEAD words, then the tail classes."""

    head: dict[bytes, int]
    counts: np.ndarray  # of each head class
    tail_tokens: np.ndarray
    tail_words: np.ndarray

    @property
    def size(self) -> int:
        return len(self.counts) + TAILS

    def share(self) -> np.ndarray:
        c = np.concatenate([self.counts, self.tail_tokens]) + 0.5
        return c / c.sum()

    @cached_property
    def words(self) -> pa.Array:
        return pa.array(list(self.head), pa.binary())

    def of(self, words: pa.Array | list[bytes]) -> np.ndarray:
        words = words if isinstance(words, pa.Array) else pa.array(words, pa.binary())
        out = pc.index_in(words, value_set=self.words).fill_null(-1).to_numpy() + np.int64(1)
        rest = out == 0
        out[rest] = len(self.counts) + _tail(words.filter(pa.array(rest)))
        return out

    def sequences(self, words: pa.Array, n: np.ndarray) -> list[np.ndarray]:
        """Of texts of n words each: their classes, the end included."""
        out = np.zeros(len(words) + len(n), dtype="<u2")
        out[np.arange(len(words)) + np.repeat(np.arange(len(n)), n)] = self.of(words)
        return np.split(out, np.cumsum(n + 1)[:-1])


def _width(n: int) -> int:
    """Class of texts of like length: the power of two up to which a text of n tokens reaches."""
    return max(6, (n - 1).bit_length())


def _enough(width: int, size: int) -> bool:
    return size >= min(BLOCK_TOKENS, MEAN_ACTIVE << width)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(class sequence, lengths) of texts of like length from rows of packed sequences."""
    held: dict[int, list[tuple[bytes, bytes]]] = {}
    size: Counter[int] = Counter()

    def block(width: int) -> tuple[np.ndarray, np.ndarray]:
        seqs, lengths = zip(*held.pop(width), strict=True)
        size[width] = 0
        return np.frombuffer(b"".join(seqs), "<u2"), np.frombuffer(b"".join(lengths), "<i8")

    for b in batches:
        for s, n, width in zip(*(b.column(c).to_pylist() for c in ("seq", "lengths", "width")), strict=True):
            held.setdefault(width, []).append((s, n))
            size[width] += len(s) // 2
            if _enough(width, size[width]):
                yield block(width)
    for width in sorted(held):
        yield block(width)


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each block: its classes in order of steps, and the number of texts at each step."""
    for seq, lengths in _blocks(batches):
        obs, active, *_ = by_time(seq, lengths)
        yield pa.RecordBatch.from_arrays([pa.array([x.astype(t).tobytes()], pa.binary()) for x, t in ((obs, "<u2"), (active, "<i8"))], ["obs", "active"])


@dataclass
class LanguageModel:
    counts: DataFrame  # (word, c) of all training tokens
    n_tokens: int
    n_words: int
    classes: Classes
    chain: Chain


def train(docs: DataFrame, states: int = STATES, rounds: int = ROUNDS) -> LanguageModel:
    """Counts all tokens of docs (text; null: empty) and fits the chain on all its texts.

    Each Baum-Welch round sums the expected counts of every partition's texts and re-estimates on the driver, which holds only the bounded model. The first chain is disturbed at random, which gives the states something to tell apart; no text has a part in it.
    """
    texts = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    counts = cut(texts.mapInArrow(_count, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c")).where("c > 0"))
    total, distinct = counts.agg(F.sum("c"), F.count("*")).first()
    # words by steps of their counts: about HEAD reach the sort, whatever the vocabulary's size
    step = F.floor(F.log2("c") * 8)
    steps = counts.where("c > 1 and length(word) > 0").groupBy(step.alias("s")).agg(F.count("*").alias("n")).orderBy(F.desc("s")).collect()  # at most 512 rows
    held_words = np.cumsum([r.n for r in steps])
    least = steps[min(int(np.searchsorted(held_words, HEAD)), len(steps) - 1)].s if steps else 0
    top = counts.where("c > 1 and length(word) > 0").where(step >= least).orderBy(F.desc("c"), "word").limit(HEAD).toArrow()
    words, own = top.column("word").to_pylist(), top.column("c").to_numpy()
    ends = counts.where("length(word) = 0").select("c").first()
    tail = F.pmod(F.crc32(F.expr("substring(word, -3, 3)")), F.lit(TAILS)).alias("j")
    per_class = counts.where("length(word) > 0").groupBy(tail).agg(F.sum("c").alias("c"), F.count("*").alias("v")).toArrow()
    in_tail, in_words = np.zeros(TAILS), np.zeros(TAILS)
    in_tail[per_class.column("j").to_numpy()] = per_class.column("c").to_numpy()
    in_words[per_class.column("j").to_numpy()] = per_class.column("v").to_numpy()
    place = _tail(pa.array(words, pa.binary()))
    in_tail -= np.bincount(place, own, TAILS)
    in_words -= np.bincount(place, minlength=TAILS)
    classes = Classes({w: i + 1 for i, w in enumerate(words)}, np.concatenate([[ends[0] if ends else 0], own]).astype(float), in_tail, in_words)
    share = classes.share()
    held = docs.sparkSession.sparkContext.broadcast(classes)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by_width: dict[int, list[np.ndarray]] = {}
            for x in held.value.sequences(*_split(batch.column("text"))):
                by_width.setdefault(_width(len(x)), []).append(x)
            columns = [[np.concatenate(v).tobytes() for v in by_width.values()], [np.array([len(x) for x in v], dtype="<i8").tobytes() for v in by_width.values()], list(by_width)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.binary(), pa.int32()), strict=True)], ["seq", "lengths", "width"])

    chain = first_chain(share, states)
    coded = cut(texts.mapInArrow(encode, "seq binary, lengths binary, width int"))
    long = F.col("width") > _width(LONG)
    in_short, in_long = (coded.where(w).agg(F.sum(F.length("seq"))).first()[0] or 0 for w in (~long, long))
    coded = coded.where(~long).coalesce(in_short // (2 * TASK_TOKENS) + 1).unionByName(coded.where(long).coalesce(in_long // (2 * TASK_TOKENS) + 1))
    blocks = cut(coded.mapInArrow(_steps, "obs binary, active binary"))
    last = -np.inf
    for _ in range(rounds):
        chain, reached = _round(blocks, chain, share)
        if reached - last <= GAIN * abs(reached):
            break
        last = reached
    return LanguageModel(counts, int(total or 0), int(distinct), classes, chain)


_PART = pa.schema([("chunk", pa.int64()), ("part", pa.int64()), ("rows", pa.binary()), ("data", pa.binary())])
_PART_TYPE = "chunk long, part long, rows binary, data binary"


def _parts(counts: np.ndarray, chunks: list[int], part: int) -> list[pa.Array]:
    """Of (chunks, CHUNK, states) counts the rows that aren't all 0, by chunk."""
    some = [np.flatnonzero(c.any(axis=1)).astype("<u2") for c in counts]
    own = [k for k, at in enumerate(some) if len(at)]
    columns = [[chunks[k] for k in own], [part] * len(own), [some[k].tobytes() for k in own], [counts[k][some[k]].astype("<f4").tobytes() for k in own]]
    return [pa.array(c, t) for c, t in zip(columns, _PART.types, strict=True)]


def _added(table: pa.Table, states: int) -> np.ndarray:
    total = np.zeros((CHUNK, states))
    for at, data in zip(table.column("rows").to_pylist(), table.column("data").to_pylist(), strict=True):
        total[np.frombuffer(at, "<u2")] += np.frombuffer(data, "<f4").reshape(-1, states)
    return total


def _round(blocks: DataFrame, chain: Chain, share: np.ndarray) -> tuple[Chain, float]:
    """One Baum-Welch round over all partitions, and the log10 likelihood by the chain that it began with.

    A task sends its expected counts as chunks of the model's rows; chunks are added up in single precision steps of FAN, so no task receives more, however many partitions there are.
    """
    states, size = len(chain.start), len(share)
    held = blocks.sparkSession.sparkContext.broadcast(chain)
    height = -(-(size + states + 2) // CHUNK) * CHUNK

    def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = Counts.zero(states, size)
        for b in batches:
            for obs, active in zip(b.column("obs"), b.column("active"), strict=True):
                c.add_steps(held.value, np.frombuffer(obs.as_buffer(), "<u2"), np.frombuffer(active.as_buffer(), "<i8"))
        rows = np.zeros((height, states))
        np.concatenate([c.emit, c.move, c.start[None], np.eye(1, states) * c.log10], out=rows[: size + states + 2])
        yield pa.RecordBatch.from_arrays(_parts(rows.reshape(-1, CHUNK, states), list(range(height // CHUNK)), TaskContext.get().partitionId()), schema=_PART)

    def add(key: tuple, rows: pa.Table) -> pa.Table:
        part = key[1].as_py() if len(key) > 1 else 0
        return pa.Table.from_arrays(_parts(_added(rows, states)[None], [key[0].as_py()], part), schema=_PART)

    parts, n = blocks.mapInArrow(expect, _PART_TYPE), blocks.rdd.getNumPartitions()
    while n > FAN:
        n = -(-n // FAN)
        parts = parts.withColumn("part", F.col("part") % n).groupBy("chunk", "part").applyInArrow(add, _PART_TYPE)
    sums = parts.groupBy("chunk").applyInArrow(add, _PART_TYPE).toArrow()  # the model's size
    rows = np.zeros((height // CHUNK, CHUNK, states))
    for k, chunk in enumerate(sums.column("chunk").to_pylist()):
        rows[chunk] = _added(sums.slice(k, 1), states)
    rows = rows.reshape(height, states)[: size + states + 2]
    return (Counts(rows[-2], rows[size : size + states], rows[:size]).chain(share) if rows.any() else chain), float(rows[-1, 0])


def scores(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """For each row of docs: doc_id, n_tokens, n_known, base_score and score, over its whole text (null: empty), the end included.

    score is the log10 probability by the chain of the class sequence, times that of each word within its class: 1 for words of their own class and the end; (c - DISCOUNT) / C for a known word of a tail class with C training tokens and V words, and DISCOUNT V / C for the outcome "unknown" of that class (1 where C is 0). base_score is the sum of log10((c + 0.5) / (N + 0.5 (V + 1))). Without training tokens both are 0. Rows with a null or repeated doc_id are scored each; extra columns are ignored.
    Only words without a class of their own leave a text's task, counted per text, to meet their counts in a join.
    """
    k = model.classes
    per_token = np.log10(model.n_tokens + 0.5 * (model.n_words + 1))
    with np.errstate(divide="ignore"):
        seen = np.where(k.tail_tokens > 0, -np.log10(k.tail_tokens), 0.0)
        unseen = np.where(k.tail_tokens > 0, np.log10(np.maximum(DISCOUNT * k.tail_words, 1e-300)) + seen, 0.0)
    held = docs.sparkSession.sparkContext.broadcast((k, model.chain, np.log10(k.counts + 0.5), bool(model.n_tokens)))
    whole = pa.struct([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_head", pa.int64()), ("chain", pa.float64()), ("base", pa.float64())])
    schema = pa.schema([("rid", pa.int64()), ("word", pa.binary()), ("times", pa.int64()), ("whole", whole)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, chain, head_log, trained = held.value
        n_head = len(classes.counts)
        waiting: dict[int, list[tuple]] = {}
        size: Counter[int] = Counter()

        def block(width: int) -> pa.RecordBatch:
            rids, docs_, seqs = zip(*waiting.pop(width), strict=True)
            size[width] = 0
            lengths = np.array([len(s) for s in seqs], dtype=np.int64)
            seq = np.concatenate(seqs)
            total = log10_likelihood(chain, seq, lengths) if trained else np.zeros(len(lengths))
            own = seq < n_head
            at = np.repeat(np.arange(len(seqs)), lengths)
            known = own & ((seq > 0) | (classes.counts[0] > 0))
            base = np.bincount(at[own], head_log[seq[own]], len(seqs))
            heads = np.bincount(at[known], minlength=len(seqs))
            fields = [pa.array(c, f.type) for c, f in zip((docs_, lengths, heads, total, base), whole, strict=True)]
            words = pa.array([b" %d" % r for r in rids], pa.binary())  # no word starts with a space
            return pa.RecordBatch.from_arrays([pa.array(rids, pa.int64()), words, pa.nulls(len(rids), pa.int64()), pa.StructArray.from_arrays(fields, fields=list(whole))], schema=schema)

        for batch in batches:
            words, n = _split(batch.column("text"))
            seqs, rids = classes.sequences(words, n), batch.column("rid")
            at = np.repeat(np.arange(len(n)), n)
            rest = np.concatenate([s[:-1] for s in seqs]) >= n_head if seqs else np.zeros(0, dtype=bool)
            tail = pa.table([rids.take(pa.array(at[rest])), words.filter(pa.array(rest))], ["rid", "word"])
            tail = tail.group_by(["rid", "word"], use_threads=False).aggregate([([], "count_all")]).combine_chunks()
            for part in tail.to_batches():
                columns = [part.column(c) for c in ("rid", "word", "count_all")]
                yield pa.RecordBatch.from_arrays([*columns, pa.nulls(len(part), whole)], schema=schema)
            for rid, doc, x in zip(rids.to_pylist(), batch.column("doc_id").to_pylist(), seqs, strict=True):
                width = _width(len(x))
                waiting.setdefault(width, []).append((rid, doc, x.copy()))
                size[width] += len(x)
            for width in [w for w in waiting if _enough(w, size[w])]:
                yield block(width)
        for width in sorted(waiting):
            yield block(width)

    base = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = base.mapInArrow(run, "rid long, word binary, times long, whole struct<doc_id: long, n_tokens: long, n_head: long, chain: double, base: double>")
    met = rows.join(model.counts, "word", "left")
    zero = F.lit(0.0)
    tail = F.pmod(F.crc32(F.expr("substring(word, -3, 3)")), F.lit(TAILS)).cast("int")
    seen_, unseen_ = (F.array(*map(F.lit, x.tolist()))[tail] for x in (seen, unseen))
    out = met.groupBy("rid").agg(
        F.max("whole.doc_id").alias("doc_id"), F.max("whole.n_tokens").alias("n_tokens"),
        (F.max("whole.n_head") + F.coalesce(F.sum(F.when(F.col("c").isNotNull(), F.col("times"))), F.lit(0))).alias("n_known"),
        (F.max("whole.base") + F.coalesce(F.sum(F.col("times") * F.log10(F.coalesce("c", F.lit(0)) + 0.5)), zero) - F.max("whole.n_tokens") * F.lit(float(per_token))).alias("base_score"),
        (F.max("whole.chain") + F.coalesce(F.sum(F.col("times") * F.when(F.col("c").isNotNull(), F.log10(F.col("c") - DISCOUNT) + seen_).otherwise(unseen_)), zero)).alias("score"),
    )
    return out.drop("rid")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs.where(~held_out()))
    out = scores(docs, model)
    return out.select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known", F.lit(model.n_tokens).cast("long").alias("train_tokens"), "base_score", "score")
