"""Best-fit packing: bounded-space online best fit into sequences of fixed capacity.

A task keeps at most ``open_bins`` bins open, in a bitset keyed by free space. A piece goes into the
open bin that it fills best. If none has room and all places are taken, the fullest bin closes. Bins
that are still open when a task ends (``open_bins`` a task at most) are packed again as items, in
ever fewer tasks, until one task has seen them; so hardly any space is lost between tasks.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import sizes, table, text_or_empty, written
from .tokens import WORD_FILE, encoder, tokenizer_path

CAPACITY, END_ID, OPEN_BINS, PIECES_PER_TASK = 4096, 1, 256, 250_000


class BestFit:
    """Places lengths from 0 to ``capacity`` one by one; returns (bin, offset) for each."""

    def __init__(self, capacity: int, open_bins: int):
        self.capacity, self.places = capacity, open_bins
        self.free = 0  # bit f: an open bin has f units of free space
        self.bins: dict[int, list[int]] = {}
        self.opened = self.made = 0

    def place(self, length: int) -> tuple[int, int]:
        fits = self.free >> length
        if fits:
            space = length + (fits & -fits).bit_length() - 1
            number = self._take(space)
        else:
            if self.opened >= self.places:
                self._take((self.free & -self.free).bit_length() - 1)  # the fullest closes
            number, space = self.made, self.capacity
            self.made += 1
        if space > length:
            self._put(space - length, number)
        return number, self.capacity - space

    def _take(self, space: int) -> int:
        stack = self.bins[space]
        number = stack.pop()
        if not stack:
            self.free &= ~(1 << space)
        self.opened -= 1
        return number

    def _put(self, space: int, number: int) -> None:
        self.bins.setdefault(space, []).append(number)
        self.free |= 1 << space
        self.opened += 1

    def still_open(self) -> Iterator[tuple[int, int]]:
        """(bin, units filled) of each."""
        for space, numbers in sorted(self.bins.items()):
            for n in numbers:
                yield n, self.capacity - space


def token_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """Pieces of at most ``capacity`` tokens: id, piece, start, length, ids_crc32 (and ids as bytes).

    Null texts count as empty, and an empty text gives one piece that holds only the end id. Columns
    other than the id and the text are left out. Repeated rows each give their own pieces.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids

    def cut(batches):
        enc, end, step = encoder(path), end_id.to_bytes(4, "little"), 4 * capacity
        for batch in batches:
            out: list[tuple] = []
            for i, text in enumerate(batch.column(1).to_pylist()):
                ids = enc.encode(text) + end
                for k, at in enumerate(range(0, len(ids), step)):
                    part = ids[at : at + step]
                    out.append((i, k, at // 4, len(part) // 4, zlib.crc32(part), part if keep_ids else None))
            cols = list(zip(*out)) if out else [[]] * 6
            arrays = [batch.column(0).take(pa.array(cols[0], pa.int32()))] + [pa.array(c, t) for c, t in zip(cols[1:], (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
            yield pa.RecordBatch.from_arrays(arrays[: 5 + keep_ids], names[: 5 + keep_ids])

    return rows.mapInArrow(cut, schema)


def _round(items: DataFrame, tasks: int, capacity: int, open_bins: int, number: int) -> DataFrame:
    """items (item, length) -> item, bin, bin_offset, and a row without item for each bin left open."""
    kind = items.schema["item"].dataType

    def pack(batches):
        at, fit = (number << 56) + (TaskContext.get().partitionId() << 32), BestFit(capacity, open_bins)
        seen = None
        for batch in batches:
            seen = batch.column(0)
            bins, offsets = zip(*map(fit.place, batch.column(1).to_pylist())) if batch.num_rows else ((), ())
            yield pa.RecordBatch.from_arrays([seen, pa.array([at + b for b in bins], pa.int64()), pa.array(offsets, pa.int64()), pa.nulls(len(bins), pa.int64())], ["item", "bin", "bin_offset", "filled"])
        if seen is not None:
            left = list(fit.still_open())
            yield pa.RecordBatch.from_arrays([pa.nulls(len(left), seen.type), pa.array([at + b for b, _ in left], pa.int64()), pa.nulls(len(left), pa.int64()), pa.array([f for _, f in left], pa.int64())], ["item", "bin", "bin_offset", "filled"])

    mixed = items.repartition(tasks).sortWithinPartitions(F.xxhash64("item"), "item")
    return written(mixed.mapInArrow(pack, f"item {kind.simpleString()}, bin long, bin_offset long, filled long"), f"packed{number}")


def best_fit_pack(pieces: DataFrame, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, per_task: int = PIECES_PER_TASK) -> DataFrame:
    """``pieces`` (any columns, with ``length`` from 1 to ``capacity``) plus sequence_id and offset.

    ``pieces`` must be read from a written table, as it is counted first. An empty table gives an
    empty result. Equal and repeated pieces are placed one by one.
    """
    too_long = pieces.filter(~F.col("length").between(0, capacity) | F.col("length").isNull()).limit(1).count()
    if too_long:
        raise ValueError(f"each length must be between 0 and {capacity}")
    items = pieces.select(F.struct(*[F.col(c) for c in pieces.columns]).alias("item"), "length")
    tasks, number = sizes(pieces, per_task), 0
    first = _round(items, tasks, capacity, open_bins, number)
    placed = first.filter("filled is null").select("item", F.col("bin"), "bin_offset")
    moves, left = None, first.filter("filled is not null")
    while tasks > 1:
        number += 1
        fewer = sizes(left, per_task)
        tasks = fewer if fewer < tasks else tasks // 2
        again = _round(left.select(F.col("bin").alias("item"), F.col("filled").alias("length")), tasks, capacity, open_bins, number)
        step = again.filter("filled is null").select(F.col("item").alias("old"), F.col("bin").alias("to"), F.col("bin_offset").alias("by"))
        if moves is None:
            moves = step
        else:
            nxt = step.select(F.col("old").alias("to"), F.col("to").alias("to2"), F.col("by").alias("by2"))
            moves = moves.join(nxt, "to", "left").select("old", F.coalesce("to2", "to").alias("to"), (F.col("by") + F.coalesce("by2", F.lit(0))).alias("by"))
        left = again.filter("filled is not null")
    if moves is not None:
        placed = placed.join(moves, placed["bin"] == moves["old"], "left").select("item", F.coalesce("to", "bin").alias("bin"), (F.col("bin_offset") + F.coalesce("by", F.lit(0))).alias("bin_offset"))
    return placed.select("item.*", F.col("bin").alias("sequence_id"), F.col("bin_offset").alias("offset"))


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    pieces = written(token_pieces(docs, path or tokenizer_path(WORD_FILE), capacity, keep_ids=keep_ids), "pieces")
    return best_fit_pack(pieces, capacity)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
