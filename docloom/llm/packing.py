"""Packing of tokenised documents into sequences: bounded-space online best fit.

A document's tokens, closed by one end token, are cut into pieces of the sequence's length only if they
are longer; the odd piece comes first. A task keeps at most OPEN sequences open. They hang in a bitset
keyed by free space (bit f is set while a sequence with f free places is open), so that the fullest one
that a piece still fits in is the lowest bit from the piece's length up. Where none fits, a new one is
opened; if too many are open, the fullest closes first. Pieces arrive in runs of LOOKAHEAD, the longest
of a run first.

What is still open at the end of a task, and not nearly full, is dissolved: its pieces go to the next round.
Rounds pack the leftovers of FAN_IN tasks each, by the same method, until one task is left. A task
of a round gets the pieces of at most FAN_IN * OPEN sequences, so rounds are small at any size of the
input. Only lengths and places move; a join brings every piece the sequence and the offset that the
rounds found. Pieces are written to the
shared folder before the rounds, so that no loss of an executor changes them.

Defined results: a null text is an empty one, and an empty document is its end token alone. Documents
that repeat are packed each. An empty table gives no pieces. Columns that a result would clash with are
refused with a ValueError.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise, prepare

CAPACITY, END = 2048, 0
OPEN, LOOKAHEAD, FAN_IN = 1024, 4096, 8
#: A sequence with less free space than this is closed rather than left to the next round.
LEAST_FREE = 8
VOCABULARY = "byte_bpe_50k"

_encoders: dict[str, object] = {}


class Encoder:
    """Token ids of the tokenizer file NAME.json. The same vocabulary's ranks (NAME.tiktoken) give the same ids
    several times faster, and are used for every text without a special token's string; texts that their regular
    expression gives up on (runs of some hundred thousand blanks) go to the tokenizer itself too."""

    def __init__(self, name: str = VOCABULARY, folder: str | None = None):
        import json

        import public_tokenizers as P
        import tiktoken

        path = (lambda n: f"{folder}/{n}") if folder else P.path
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path(f"{name}.tiktoken"), "rb"))}
        self.fast = tiktoken.Encoding(name, pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.file = path(f"{name}.json")
        with open(self.file) as f:
            self.special = [t["content"] for t in json.load(f).get("added_tokens", ())]
        self.exact = None

    def ids(self, text: str | None) -> np.ndarray:
        text = text or ""
        if not any(s in text for s in self.special):
            try:
                return np.asarray(self.fast.encode_to_numpy(text, disallowed_special=()), np.uint32)
            except ValueError:  # its regular expression ran out of stack
                pass
        if self.exact is None:
            from tokenizers import Tokenizer

            self.exact = Tokenizer.from_file(self.file)
        return np.array(self.exact.encode(text, add_special_tokens=False).ids, np.uint32)


def encoder(name: str = VOCABULARY, folder: str | None = None) -> Encoder:
    key = f"{folder}/{name}"
    if key not in _encoders:
        _encoders[key] = Encoder(name, folder)
    return _encoders[key]


def tokenise(docs: DataFrame, text: str = "text", vocabulary: str = VOCABULARY, folder: str | None = None, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """A row per piece: the columns of docs but the text, then piece, start, length and ids (unsigned
    32-bit little-endian, as bytes)."""
    prepare(docs.sparkSession)
    at = docs.columns.index(text)
    rest = [f for i, f in enumerate(docs.schema.fields) if i != at]
    names = ["piece", "start", "length", "ids"]
    if clash := set(names) & {f.name for f in rest}:
        raise ValueError(f"{clash} are already columns")
    schema = T.StructType([*rest, T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids", T.BinaryType())])

    def run(batches):
        enc = encoder(vocabulary, folder)
        for batch in batches:
            row, piece, start, length, data, size = [], [], [], [], [], 0
            others = [c for i, c in enumerate(batch.columns) if i != at]

            def out():
                take = pa.array(row, pa.int64())
                columns = [c.take(take) for c in others]
                return pa.RecordBatch.from_arrays([*columns, pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(data, pa.binary())], names=schema.names)

            for i, t in enumerate(batch.column(at).to_pylist()):
                ids = np.append(enc.ids(t), np.uint32(end)).astype("<u4")
                cuts = [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)]
                for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                    row.append(i), piece.append(k), start.append(a), length.append(b - a), data.append(ids[a:b].tobytes())
                    size += b - a
                if size > 1 << 20:
                    yield out()
                    row, piece, start, length, data, size = [], [], [], [], [], 0
            if row:
                yield out()

    return docs.mapInArrow(run, schema)


class Packer:
    """Bounded-space best fit. place() and finish() yield (sequence, used, still open, [(item, offset), ...])."""

    def __init__(self, capacity: int = CAPACITY, most_open: int = OPEN, least_free: int = LEAST_FREE):
        self.capacity, self.most_open, self.least_free = capacity, most_open, least_free
        self.bits, self.by_free, self.open, self.made = 0, {}, 0, 0

    def _take(self, free: int) -> list:
        held = self.by_free[free]
        s = held.pop()
        if not held:
            del self.by_free[free]
            self.bits &= ~(1 << free)
        self.open -= 1
        return s

    def _hang(self, s: list, free: int) -> None:
        self.by_free.setdefault(free, []).append(s)
        self.bits |= 1 << free
        self.open += 1

    def place(self, item, length: int) -> Iterator[tuple]:
        fitting = self.bits >> length
        if fitting:
            free = length + (fitting & -fitting).bit_length() - 1
            s = self._take(free)
        else:
            if self.open == self.most_open:  # the fullest closes
                f = (self.bits & -self.bits).bit_length() - 1
                full = self._take(f)
                yield full[0], self.capacity - f, False, full[1]
            s, free = [self.made, []], self.capacity
            self.made += 1
        s[1].append((item, self.capacity - free))
        free -= length
        if free:
            self._hang(s, free)
        else:
            yield s[0], self.capacity, False, s[1]

    def finish(self) -> Iterator[tuple]:
        for free in sorted(self.by_free):
            for s in self.by_free[free]:
                yield s[0], self.capacity - free, free >= self.least_free, s[1]


def _round(rows: DataFrame, number: int, schema: T.StructType, length_at: int, capacity: int, most_open: int, lookahead: int) -> DataFrame:
    """rows with bin, bin_offset, and left: how much an open sequence holds, null for a closed one."""
    out_schema = T.StructType([*schema.fields, T.StructField("bin", T.LongType()), T.StructField("bin_offset", T.LongType()), T.StructField("left", T.LongType())])

    def run(batches):
        from pyspark import TaskContext

        base = (number << 56) | (TaskContext.get().partitionId() << 32)
        packer, done, held = Packer(capacity, most_open), [], []

        def out():
            columns = list(zip(*done, strict=True))
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, arrow, strict=True)], names=out_schema.names)

        def emit(closed):
            for s, used, still, items in closed:
                done.extend((*item, base | s, offset, used if still else None) for item, offset in items)

        def feed():
            held.sort(key=lambda r: -r[length_at])
            for r in held:
                emit(packer.place(r, r[length_at]))
            held.clear()

        arrow = None
        for batch in batches:
            arrow = arrow or [*batch.schema.types, pa.int64(), pa.int64(), pa.int64()]
            held.extend(zip(*(c.to_pylist() for c in batch.columns), strict=True))
            if len(held) >= lookahead:
                feed()
            if len(done) >= 10_000:
                yield out()
        feed()
        emit(packer.finish())
        if done:
            yield out()

    return rows.mapInArrow(run, out_schema)


def pack(pieces: DataFrame, length: str = "length", capacity: int = CAPACITY, most_open: int = OPEN, lookahead: int = LOOKAHEAD) -> DataFrame:
    """pieces with two more columns, sequence_id and offset. Every length is from 1 to capacity. All columns
    go along; drop bulky ones first and join them to the result."""
    prepare(pieces.sparkSession)
    if clash := {"sequence_id", "offset", "bin", "bin_offset", "left", "task", "bin0", "offset0", "_bin", "_offset"} & set(pieces.columns):
        raise ValueError(f"{clash} are reserved columns")
    placed = materialise(_round(pieces, 1, pieces.schema, pieces.columns.index(length), capacity, most_open, lookahead))
    task = F.shiftright("bin", 32).bitwiseAND((1 << 24) - 1)
    spare = placed.where("left is not null").select(F.col("bin").alias("bin0"), F.col("bin_offset").alias("offset0"), F.col(length).cast("long").alias("size"), task.alias("task"))
    tasks = spare.agg(F.max("task")).first()[0]
    moved: list[DataFrame] = []  # where the pieces that a round moved went, by the place that the first round gave them
    number = 2
    while tasks:
        tasks = tasks // FAN_IN + 1
        dealt = spare.repartitionById(tasks, F.floor(F.col("task") / FAN_IN).cast("int")).drop("task").sortWithinPartitions("bin0", "offset0")
        done = materialise(_round(dealt, number, dealt.schema, 2, capacity, most_open, lookahead))
        spare = done.where("left is not null").select("bin0", "offset0", "size", task.alias("task"))
        tasks, number = spare.agg(F.max("task")).first()[0], number + 1
        moved.append(done.where("left is null") if tasks else done)  # one task's leftovers stay as they are
    if not moved:
        return placed.withColumnsRenamed({"bin": "sequence_id", "bin_offset": "offset"}).drop("left")
    gone = reduce(DataFrame.unionAll, moved).select("bin0", "offset0", F.col("bin").alias("_bin"), F.col("bin_offset").alias("_offset"))
    return placed.join(gone, (placed.bin == gone.bin0) & (placed.bin_offset == gone.offset0), "left").select(
        *pieces.columns, F.coalesce("_bin", "bin").alias("sequence_id"), F.coalesce("_offset", "bin_offset").alias("offset")
    )


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, ids (bytes): the packed pieces' ids in their order. packed holds sequence_id, offset and ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate("parts", F.lit(b"").cast("binary"), lambda s, x: F.concat(s, x.ids))
    return packed.groupBy("sequence_id").agg(parts.alias("parts")).select("sequence_id", joined.alias("ids"))


def documents_packed(docs: DataFrame) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece of every document."""
    pieces = tokenise(docs.select("doc_id", "text"))
    slim = pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return pack(slim).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
