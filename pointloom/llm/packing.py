"""Token sequences packed by the sum-of-squares rule."""

from __future__ import annotations

import functools
import json
import os
import re
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.llm.arrow import slices
from pointloom.session import cut, prepare, table

#: Pieces shorter than a sequence that one packing task takes, about; bounds its memory at any input size.
SHARD_PIECES = 65_536
#: Runs of text whose ids a worker remembers.
CACHE_RUNS = 500_000
#: Fixed value: the division rule for which plain runs may be divided here.
DIVISION = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_SHARD = 1 << 40


def public_vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: Runs of these characters stand as they are under canonical composition, lower-case one by one, and hold letters, digits 0-9 and signs only.
_PLAIN = re.compile("[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f]+")
_LETTERS = "a-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017f"
#: The vocabulary's own division of such runs.
_PARTS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^{_LETTERS}0-9]+")


class RunIds(dict):
    """A run of text without ASCII white space -> its little-endian 32-bit ids, remembered for a bounded number of runs.

    Plain runs are divided here and each part goes to the vocabulary's merge model; all others go through the whole tokenizer.
    """

    def __init__(self, path: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.whole = Tokenizer.from_file(path)
        self.model, self.part_ids = self.whole.model, {}
        divided = json.loads(Path(path).read_text())["pre_tokenizer"]["pretokenizers"]
        self.divides = divided[0]["pattern"]["Regex"] == DIVISION and divided[1]["type"] == "ByteLevel"
        level = ByteLevel(add_prefix_space=False, use_regex=False)
        self.signs = {c: level.pre_tokenize_str(chr(c))[0][0] for c in range(0xC0, 0x180)}

    def __missing__(self, run: bytes) -> bytes:
        if len(self) >= CACHE_RUNS:
            self.clear()
        if self.divides and (run.isalpha() or run[-1:] in (b".", b",") and run[:-1].isalpha()):
            # ASCII letters, perhaps with a full stop or comma: most runs
            parts = [run.lower().decode()] if run.isalpha() else [run[:-1].lower().decode(), run[-1:].decode()]
            ids = b"".join([self.part_ids.get(p) or self.part(p) for p in parts])
            self[run] = ids
            return ids
        text = run.decode("utf-8", "replace")
        if self.divides and b"<|" not in run and _PLAIN.fullmatch(text):
            ids = b"".join([self.part_ids.get(p) or self.part(p) for p in _PARTS.findall(text.lower())])
        else:
            ids = np.asarray(self.whole.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        self[run] = ids
        return ids

    def forget(self) -> None:
        self.clear()
        self.part_ids.clear()

    def part(self, p: str) -> bytes:
        if len(self.part_ids) >= CACHE_RUNS:
            self.part_ids.clear()
        self.part_ids[p] = ids = b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(p if p.isascii() else p.translate(self.signs))])
        return ids


@functools.cache
def run_ids(path: str) -> RunIds:
    return RunIds(path)


def _ids(texts: list[bytes], path: str) -> Iterator[bytes]:
    """Little-endian 32-bit ids of each text. The vocabulary drops white space and none of its tokens spans it, so runs between ASCII white space are looked up one by one."""
    known = run_ids(path)
    for text in texts:
        yield b"".join(map(known.__getitem__, text.split()))


def tokenize(docs: DataFrame, vocabulary: str | None = None, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids): each row of docs as pieces of at most ``capacity`` ids, closed by ``end_id``.

    ids holds unsigned 32-bit little-endian integers. A null or empty text is the end id alone. Rows with a null or repeated doc_id are documents of their own; extra columns are ignored.
    """
    path = vocabulary or public_vocabulary()
    end = np.asarray([end_id], dtype="<u4").tobytes()
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary())])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in slices(batches):
            out: list[list] = [[], [], [], [], []]
            for doc, ids in zip(rows.column("doc_id").to_pylist(), _ids(texts, path), strict=True):
                ids += end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    for column, value in zip(out, (doc, k, at // 4, len(part) // 4, part), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, schema.types, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from pieces(batches)
        finally:  # workers live on; what a task remembered does not
            run_ids(path).forget()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, piece int, start long, length long, ids binary")


def place(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each length, longest first.

    count[g] is the number of open bins with g ids left. A piece goes to the open bin for which the sum of squared counts becomes smallest; the change is 2(count[g-s] - count[g]) + 2, or 1 - 2 count[g] for an exact fit. Ties: the smallest gap. A bin is opened only when no open one fits.
    """
    count = np.zeros(capacity + 1, dtype=np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, offsets = np.zeros(len(lengths), dtype=np.int64), np.zeros(len(lengths), dtype=np.int64)
    used = 0
    for i in np.argsort(-lengths, kind="stable"):
        s = int(lengths[i])
        if s > capacity:
            raise ValueError(f"a piece of {s} ids exceeds the capacity {capacity}")
        gaps = np.flatnonzero(count[s:capacity])
        if len(gaps):
            change = 2 * (count[gaps] * (gaps > 0) - count[gaps + s]) + 2 - (gaps == 0)
            left = int(gaps[change.argmin()])
            b = open_bins[left + s].pop()
            count[left + s] -= 1
            offsets[i] = capacity - left - s
        else:
            b, left = used, capacity - s
            used += 1
        bins[i] = b
        if left:
            open_bins[left].append(b)
            count[left] += 1
    return bins, offsets


def pack(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """pieces with sequence_id and offset; pieces: any columns with ``length`` (1 to capacity).

    A piece of full length is a sequence of its own. The others are dealt round over shards of about SHARD_PIECES by their running number within each partition, so no key, null or repeated row gathers in one task and a shard's size doesn't depend on the input's; each shard is packed alone. pieces are cut in the checkpoint folder first, as their number decides how many shards there are. sequence_id has the shard in its high bits; sequences of full pieces are numbered from 2^62.
    """
    fields = cut(pieces.drop("_shard", "sequence_id", "offset"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields.schema.fields) + ", sequence_id long, offset long"
    rest = fields.where(F.col("length") != capacity)
    shards = -(-rest.count() // SHARD_PIECES) or 1
    dealt = rest.withColumn("_shard", F.pmod(F.monotonically_increasing_id(), F.lit(shards)))

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        bins, offsets = place(rows.column("length").to_numpy(), capacity)
        rows = rows.drop_columns(["_shard"])
        return rows.append_column("sequence_id", pa.array(bins + key[0].as_py() * _SHARD)).append_column("offset", pa.array(offsets))

    full = fields.where(F.col("length") == capacity).withColumns({"sequence_id": F.monotonically_increasing_id() + F.lit(1 << 62), "offset": F.lit(0).cast("long")})
    return dealt.groupBy("_shard").applyInArrow(run, schema).unionByName(full)


def pack_documents(docs: DataFrame, vocabulary: str | None = None, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """tokenize() then pack(), with the ids kept: the training sequences themselves. An empty table gives no rows."""
    return pack(tokenize(docs, vocabulary, capacity, end_id), capacity)


def packed_digest(docs: DataFrame, capacity: int = 2048) -> DataFrame:
    """pack_documents() with ids_crc32 in place of the ids, which are then neither written nor shuffled."""
    pieces = tokenize(docs, capacity=capacity).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return pack(pieces, capacity).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return packed_digest(table(spark, sf_dir, "documents").select("doc_id", "text"))
