"""Removal of long repeated byte strings, found by suffix sorting of candidate stretches."""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.llm.arrow import slices
from pointloom.llm.bitfilter import BitFilter
from pointloom.llm.suffixes import END, GAP, repeated
from pointloom.session import cut, prepare, table

#: Bytes of the grams whose least hash names the group in which a string is looked for; strings are at least as long.
GRAM = 96
#: Bytes of text that one sorting task takes, about; stretches of one group from which each of their strings is dealt by its own hash.
LANE_BYTES, HOT = 2 << 20, 20_000
#: Bytes that are hashed at a time, about, whatever a text's length.
BLOCK = 1 << 19
_MULTIPLIER = 0x9E3779B97F4A7C15
_VALUES = np.random.default_rng(11).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


@dataclass(frozen=True)
class Strings:
    """What is compared: the n bytes from each byte on or, by words, the n words from each word on. Words are runs of bytes above 0x20, so n words are at least 2 n - 1 bytes."""

    n: int
    words: bool = False

    def __post_init__(self):
        if self.n < (GRAM // 2 + 1 if self.words else GRAM):
            raise ValueError(f"strings must have at least {GRAM} bytes")

    def windows(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of all strings of data, both ascending."""
        if not self.words:
            starts = np.arange(max(0, len(data) - self.n + 1), dtype=np.int64)
            return starts, starts + self.n
        word = np.zeros(len(data) + 2, dtype=bool)
        np.greater(np.frombuffer(data, np.uint8), 0x20, out=word[1:-1])
        edges = np.flatnonzero(word[1:] != word[:-1])
        starts, ends = edges[::2], edges[1::2]
        return starts[: max(0, len(starts) - self.n + 1)], ends[self.n - 1 :]

    def parts(self, data: bytes) -> Iterator[tuple[int, np.ndarray, np.ndarray, bytes]]:
        """(place, starts, ends, stretch): all strings once, those of about BLOCK bytes of starts at a time; starts and ends count from place."""
        if not self.words:
            for at in range(0, max(0, len(data) - self.n + 1), BLOCK):
                part = data[at : at + BLOCK + self.n - 1]
                yield at, *self.windows(part), part
            return
        starts, ends = self.windows(data)
        k = 0
        while k < len(starts):
            z = int(np.searchsorted(starts, starts[k] + BLOCK))
            at = int(starts[k])
            yield at, starts[k:z] - at, ends[k:z] - at, data[at : int(ends[z - 1])]
            k = z


#: Strings of 400 bytes, and passages of 50 words.
BYTES, PASSAGES = Strings(400), Strings(50, words=True)


@functools.cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier modulo 2^64 and of its inverse."""
    out = []
    for x in (_MULTIPLIER, pow(_MULTIPLIER, -1, 1 << 64)):
        factors = np.full(n + 1, x, dtype=np.uint64)
        factors[0] = 1
        out.append(np.cumprod(factors, dtype=np.uint64))
    up, down = out
    return up, down


def gram_hashes(data: bytes) -> np.ndarray:
    """One hash for each GRAM bytes of data."""
    b = np.frombuffer(data, np.uint8)
    up, down = _powers(1 << max(20, len(b).bit_length()))
    c = np.zeros(len(b) + 1, dtype=np.uint64)
    np.cumsum(_VALUES[b] * up[: len(b)], out=c[1:])
    h = (c[GRAM:] - c[:-GRAM]) * down[: len(b) - GRAM + 1]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def least_hashes(h: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The least of the gram hashes h within each string; equal strings have equal ones."""
    width = ends - starts - GRAM + 1
    level = np.frexp(width.astype(np.float64))[1] - 1
    out = np.empty(len(starts), dtype=np.uint64)
    by_level = np.bincount(level)
    for k, n in enumerate(by_level.tolist()):
        if n:
            own = slice(None) if n == len(starts) else np.flatnonzero(level == k)
            out[own] = np.minimum(h[starts[own]], h[ends[own] - GRAM + 1 - (1 << k)])
        if k + 1 < len(by_level):
            h = np.minimum(h[: -(1 << k)], h[1 << k :])
    return out


def _blocks(texts: list[bytes], strings: Strings) -> Iterator[list[tuple[int, int, np.ndarray, np.ndarray, bytes]]]:
    """Lists of (text, place, starts, ends, stretch) of about BLOCK bytes."""
    block, size = [], 0
    for i, t in enumerate(texts):
        for at, starts, ends, part in strings.parts(t):
            if len(starts):
                if block and size + len(part) > BLOCK:
                    yield block
                    block, size = [], 0
                block.append((i, at, starts, ends, part))
                size += len(part)
    if block:
        yield block


def runs(texts: list[bytes], strings: Strings) -> list[list[tuple[int, int, int, int, int]]]:
    """For each text (key, start, end, n, places): runs of n strings with the same least hash, which stands at so many places, at least for more than one."""
    out: list[list[tuple[int, int, int, int, int]]] = [[] for _ in texts]
    for block in _blocks(texts, strings):
        h = gram_hashes(b"".join(x[4] for x in block))
        sizes = np.array([len(x[4]) for x in block])
        shift = np.cumsum(sizes) - sizes
        starts = np.concatenate([x[2] + s for x, s in zip(block, shift.tolist(), strict=True)])
        ends = np.concatenate([x[3] + s for x, s in zip(block, shift.tolist(), strict=True)])
        m = least_hashes(h, starts, ends)
        counts = np.array([len(x[2]) for x in block])
        fresh = np.zeros(len(m), dtype=bool)
        fresh[1:] = m[1:] != m[:-1]
        fresh[np.cumsum(counts) - counts] = True
        first = np.flatnonzero(fresh)
        last = np.concatenate([first[1:], [len(m)]]) - 1
        # a gram with the least hash that the last string of a run has left behind: it has another one
        left = np.minimum.reduceat(h, np.stack([starts[first], starts[last]], axis=1).ravel())[::2]
        places = 1 + ((left == m[first]) & (first < last))
        of = np.repeat(np.arange(len(block)), counts)[first]
        base = (np.array([x[1] for x in block]) - shift)[of]
        for i, *run in zip(np.array([x[0] for x in block])[of].tolist(), m[first].view(np.int64).tolist(), (starts[first] + base).tolist(), (ends[last] + base).tolist(), (last - first + 1).tolist(), places.tolist(), strict=True):
            out[i].append(tuple(run))
    return out


def digest(text: bytes) -> bytes:
    return xxhash.xxh3_128_digest(text)


def _row_mark(text_digest: bytes, doc_id) -> int:
    return xxhash.xxh3_64_intdigest(text_digest + str(-1 if doc_id is None else doc_id).encode())


def _survey(strings: Strings):
    schema = pa.schema([("doc_id", pa.int64()), ("digest", pa.binary()), ("n_bytes", pa.int64()), ("mark", pa.int64()), ("first", pa.int64()), ("last", pa.int64()), ("size", pa.int64()), ("keys", pa.list_(pa.int64())), ("places", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in slices(batches):
            ids, digests = rows.column("doc_id"), [digest(t) for t in texts]
            marks = np.array([_row_mark(d, i) for d, i in zip(digests, ids.to_pylist(), strict=True)], dtype=np.uint64).view(np.int64)
            found = runs(texts, strings)
            columns = [ids, digests, [len(t) for t in texts], marks, [f[0][1] if f else None for f in found], [f[-1][2] if f else None for f in found], [sum(r[2] - r[1] for r in f) for f in found], [[r[0] for r in f] for f in found], [[r[4] for r in f] for f in found]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) if not isinstance(c, pa.Array) else c for c, t in zip(columns, schema.types, strict=True)], schema=schema)

    return run


def _stretches(strings: Strings, standing: BitFilter, shared: BitFilter, hot: BitFilter | None, lanes: int):
    """Arrow stage: (lane, digest, start, n, data) for the runs with a shared key of the rows that stand for their text. For a single string of a hot group n is its length less than 0, and data is its digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in slices(batches):
            digests = [digest(t) for t in texts]
            marks = np.array([_row_mark(d, i) for d, i in zip(digests, rows.column("doc_id").to_pylist(), strict=True)], dtype=np.uint64)
            stand = np.flatnonzero(standing.test(marks))
            out: list[list] = [[], [], [], [], []]
            for i, found in zip(stand.tolist(), runs([texts[i] for i in stand], strings), strict=True):
                if not found:
                    continue
                keys = np.array([r[0] for r in found], dtype=np.int64).view(np.uint64)
                ok = shared.test(keys)
                very = hot.test(keys) & ok if hot is not None else np.zeros(len(keys), dtype=bool)
                for r in np.flatnonzero(ok).tolist():
                    _, start, end, n, _ = found[r]
                    data = texts[i][start:end]
                    if very[r]:
                        for a, z in zip(*(x.tolist() for x in strings.windows(data)), strict=True):
                            d = digest(data[a:z])
                            for column, value in zip(out, (int.from_bytes(d[:8], "little") % lanes, digests[i], start + a, a - z, d), strict=True):
                                column.append(value)
                    else:
                        for column, value in zip(out, (int(keys[r]) % lanes, digests[i], start, n, data), strict=True):
                            column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["lane", "digest", "start", "n", "data"])

    return run


def _united(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranges sorted by start, those that touch joined."""
    if not len(starts):
        return starts, ends
    reach = np.maximum.accumulate(ends)
    cuts = np.flatnonzero(starts[1:] > reach[:-1]) + 1
    return starts[np.concatenate([[0], cuts])], reach[np.concatenate([cuts - 1, [len(reach) - 1]])]


def _sort_lane(strings: Strings):
    def run(rows: pa.Table) -> pa.Table:
        digests, starts, ns, data = (rows.column(c).to_pylist() for c in ("digest", "start", "n", "data"))
        once = {(d, s, n): r for r, (d, s, n) in enumerate(zip(digests, starts, ns, strict=True))}
        out: list[tuple[bytes, int, int]] = []
        single: dict[bytes, list[int]] = {}
        stretches = []
        for (_, _, n), r in once.items():
            stretches.append(r) if n > 0 else single.setdefault(data[r], []).append(r)
        for same in single.values():
            if len(same) > 1:
                out.extend((digests[r], starts[r], starts[r] - ns[r]) for r in same)
        if stretches:
            # a blank ends the last word of each stretch
            text = (b" " + GAP).join(data[r] for r in stretches) + b" " + END
            size, at, place = np.zeros(len(text), dtype=np.int32), [], 0
            for r in stretches:
                a, z = strings.windows(data[r])
                size[place + a] = z - a
                at.append((place, a, z))
                place += len(data[r]) + 1 + len(GAP)
            hit = repeated(text, size)
            for r, (p, a, z) in zip(stretches, at, strict=True):
                ok = hit[p + a]
                out.extend((digests[r], starts[r] + x, starts[r] + y) for x, y in zip(*(v.tolist() for v in _united(a[ok], z[ok])), strict=True))
        columns = list(zip(*out, strict=True)) or [(), (), ()]
        return pa.table([pa.array(columns[0], pa.binary()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64())], ["digest", "start", "end"])

    return run


def _unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(digest, whole, spans) from the spans of all lanes."""
    spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    for b in batches:
        out = []
        for found in b.column("s").to_pylist():
            at = np.array(sorted((x["start"], x["end"]) for x in found), dtype=np.int64).reshape(-1, 2)
            out.append([{"start": x, "end": y} for x, y in zip(*(v.tolist() for v in _united(at[:, 0], at[:, 1])), strict=True)])
        yield pa.RecordBatch.from_arrays([b.column("digest"), b.column("whole"), pa.array(out, spans)], ["digest", "whole", "spans"])


def repeated_spans(docs: DataFrame, strings: Strings = BYTES) -> tuple[DataFrame, DataFrame]:
    """(texts, spans). texts: (doc_id, digest, n_bytes) for each row of docs; spans: (digest, whole, spans) for the texts of which something repeats: merged (start, end) byte ranges covered by a string that also starts elsewhere in any row. whole: the text stands in several rows, and the range is all of it.

    A null text is empty. Rows are told apart by position only, so repeated rows repeat each other. Each string belongs to the group named by the least hash of its grams, so equal strings meet; groups that occur once are dropped, copies of a text send it once, and what is left is sorted lane by lane. Groups of more than HOT stretches are compared string by string instead, dealt by the strings' own 128-bit hashes.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    seen = cut(base.mapInArrow(_survey(strings), "doc_id long, digest binary, n_bytes long, mark long, first long, last long, size long, keys array<long>, places array<int>"))
    copies = seen.groupBy("digest").agg(F.count("*").alias("copies"), F.min("mark").alias("mark"), F.max("n_bytes").alias("n_bytes"), F.max("first").alias("start"), F.max("last").alias("end"))
    rows = seen.join(copies.select("digest", "mark"), ["digest", "mark"], "left_semi").select(F.explode(F.arrays_zip("keys", "places")).alias("r")).select(F.col("r.keys").alias("key"), F.col("r.places").alias("places"))
    shared = cut(rows.groupBy("key").agg(F.count("*").alias("c"), F.sum("places").alias("places")).where("places > 1"))
    n_keys, stretches, top = shared.agg(F.count("*"), F.sum("c"), F.max("c")).first()
    size, every = seen.agg(F.sum("size"), F.sum(F.size("keys"))).first()
    wanted = BitFilter(shared.select("key"), n_keys)
    hot = BitFilter(shared.where(F.col("c") > HOT).select("key"), n_keys) if (top or 0) > HOT else None
    standing = BitFilter(copies.select("mark"), copies.count())
    # by the mean length of a stretch
    lanes = int(max(1, (stretches or 0) * (size or 0) // max(1, every or 0) // LANE_BYTES))
    parts = base.mapInArrow(_stretches(strings, standing, wanted, hot, lanes), "lane long, digest binary, start long, n long, data binary")
    found = parts.groupBy("lane").applyInArrow(_sort_lane(strings), "digest binary, start long, end long")
    whole = copies.where("copies > 1 and start is not null").select("digest", "start", "end", F.expr("start = 0 and end = n_bytes").alias("whole"))
    every = found.withColumn("whole", F.lit(False)).unionByName(whole).groupBy("digest").agg(F.max("whole").alias("whole"), F.collect_set(F.struct("start", "end")).alias("s"))
    spans = cut(every.mapInArrow(_unite, "digest binary, whole boolean, spans array<struct<start:bigint,end:bigint>>"))
    return seen.select("doc_id", "digest", "n_bytes"), spans


def _kept(text: bytes, spans: list[dict]) -> bytes:
    at, out = 0, []
    for s in spans:
        out.append(text[at : s["start"]])
        at = s["end"]
    return b"".join(out) + text[at:]


def remove_repeats(docs: DataFrame, text: str = "text", strings: Strings = BYTES) -> DataFrame:
    """docs with the repeated bytes taken out of the text, all columns and rows kept. A character of which only a part is left goes too; n_chars, if there is such a column, follows the changed texts."""
    _, spans = repeated_spans(docs.withColumnRenamed(text, "text") if text != "text" else docs, strings)
    columns = [c for c in docs.columns if c not in ("_digest", "_whole", "_spans")]
    docs = docs.select(*columns)
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in slices(batches, text):
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array([digest(t) for t in texts], pa.binary())], [*rows.schema.names, "_digest"])

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = columns.index(text)
            spans_ = b.column("_spans").to_pylist()
            new = [t if not s else _kept(t.encode(), s).decode("utf-8", "ignore") for t, s in zip(b.column(at).to_pylist(), spans_, strict=True)]
            out = list(b.columns[: len(columns)])
            out[at] = pa.array(new, pa.string())
            yield pa.RecordBatch.from_arrays([*out, pa.array([bool(s) for s in spans_])], [*columns, "_changed"])

    met = docs.mapInArrow(name, f"{types}, _digest binary").join(spans.select(F.col("digest").alias("_digest"), F.col("spans").alias("_spans")), "_digest", "left")
    out = met.select(*columns, "_spans").mapInArrow(remove, f"{types}, _changed boolean")
    if "n_chars" in columns:
        out = out.withColumn("n_chars", F.when(F.col("_changed"), F.length(text)).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.select(*columns)


def _halves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(b"".join(x[:8] for x in b.column("digest").to_pylist()), "<i8"))], ["g"])


def removal_digest(docs: DataFrame, strings: Strings = BYTES, passages: Strings = PASSAGES) -> DataFrame:
    """For each row of docs: doc_id, n_bytes, n_removed, n_spans and the SHA-256 of what is kept when repeated ``strings`` go; n_passage_bytes and n_passages tell how many bytes repeated ``passages`` cover, in how many runs."""
    _, spans = repeated_spans(docs, strings)
    _, found = repeated_spans(docs, passages)
    partial = spans.where("not whole")
    wanted = BitFilter(partial.select("digest").mapInArrow(_halves, "g long"), partial.count())
    covered = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    found = found.select("digest", covered.alias("n_passage_bytes"), F.size("spans").cast("long").alias("n_passages"))

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data in slices(batches):
            d = [digest(t) for t in data]
            ok = wanted.test(np.frombuffer(b"".join(x[:8] for x in d), "<u8"))
            sha = [hashlib.sha256(t).hexdigest() for t in data]
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(d, pa.binary()), pa.array([len(t) for t in data], pa.int64()), pa.array(sha), pa.array([t if k else None for t, k in zip(data, ok, strict=True)], pa.binary())], ["doc_id", "digest", "n_bytes", "sha", "data"])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for n, sha, data, whole, found in zip(*(b.column(c).to_pylist() for c in ("n_bytes", "sha", "data", "whole", "spans")), strict=True):
                if whole:
                    out.append((n, 1, hashlib.sha256(b"").hexdigest()))
                elif found:
                    out.append((sum(s["end"] - s["start"] for s in found), len(found), hashlib.sha256(_kept(data, found)).hexdigest()))
                else:
                    out.append((0, 0, sha))
            removed, count, shas = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), pa.array(removed, pa.int64()), pa.array(count, pa.int64()), pa.array(shas, pa.string()), b.column("n_passage_bytes"), b.column("n_passages")], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passage_bytes", "n_passages"])

    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = base.mapInArrow(texts, "doc_id long, digest binary, n_bytes long, sha string, data binary").join(spans, "digest", "left").join(found, "digest", "left")
    zero = F.lit(0).cast("long")
    rows = rows.select("doc_id", "n_bytes", "sha", "data", "whole", "spans", F.coalesce("n_passage_bytes", zero).alias("n_passage_bytes"), F.coalesce("n_passages", zero).alias("n_passages"))
    return rows.mapInArrow(finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passage_bytes long, n_passages long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return removal_digest(table(spark, sf_dir, "documents"))


ORACLE = """
with d as (select row_number() over () as r, doc_id, hex(encode(coalesce(text, ''))) as h from documents),
w as (select r, p, hash(substr(h, 2 * p + 1, 800)) as b from d, unnest(range(0, cast(greatest(length(h) // 2 - 399, 0) as bigint))) as t(p)),
s as (select r, p from (select r, p, count(*) over (partition by b) as n from w) where n > 1),
g as (select r, p, case when p - lag(p) over (partition by r order by p) <= 400 then 0 else 1 end as fresh from s),
i as (select r, p, sum(fresh) over (partition by r order by p) as k from g),
sp as (select r, k, min(p) as a, max(p) + 400 as z from i group by r, k),
gap as (select r, k, a, coalesce(lag(z) over (partition by r order by a), 0) as before, z, lead(a) over (partition by r order by a) is null as last from sp),
-- passages: pieces are words with the blanks after them, counted in bytes
pc as (select row_number() over () as r, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\\x00-\\x20]+[\\x00-\\x20]*') as p from documents),
u as (select r, i, strlen(p[i]) as n, strlen(regexp_extract(p[i], '^[^\\x00-\\x20]+')) as w, strlen(t) - list_sum(list_transform(p, lambda x: strlen(x))) + sum(strlen(p[i])) over (partition by r order by i) as z from pc, unnest(range(1, len(p) + 1)) as q(i)),
win as (select r, cast(z - n as bigint) as a, cast(lead(z - n + w, 49) over (partition by r order by i) as bigint) as e from u),
ws as (select win.r, a, e, count(*) over (partition by hash(substr(h, 2 * a + 1, 2 * (e - a))), e - a) as n from win join d on d.r = win.r where e is not null),
wg as (select r, a, e, case when a <= lag(e) over (partition by r order by a) then 0 else 1 end as fresh from ws where n > 1),
wi as (select r, a, e, sum(fresh) over (partition by r order by a) as k from wg),
wr as (select r, sum(n) as n, count(*) as c from (select r, k, max(e) - min(a) as n from wi group by r, k) group by r),
kept as (select d.r, string_agg(substr(h, 2 * before + 1, 2 * (a - before)) || case when last then substr(h, 2 * z + 1) else '' end, '' order by a) as kh, sum(z - a) as n, count(*) as c from d join gap on gap.r = d.r group by d.r)
select doc_id, cast(length(h) // 2 as bigint) as n_bytes, cast(coalesce(kept.n, 0) as bigint) as n_removed, coalesce(kept.c, 0) as n_spans, sha256(unhex(coalesce(kh, h))) as kept_sha256, cast(coalesce(wr.n, 0) as bigint) as n_passage_bytes, coalesce(wr.c, 0) as n_passages from d left join kept on kept.r = d.r left join wr on wr.r = d.r
"""
