"""Token-ID / binary output: flat unsigned integer files with 64-bit document offsets.

``write_token_files`` puts documents in ascending id order into one set of files for each task:
``part-N.ids`` (ids, little-endian, 16 bits if the vocabulary allows, else 32), ``part-N.off``
(64-bit offsets, one more than documents) and ``part-N.doc`` (the document ids as an Arrow file).
The prefix sum of the tasks' token counts gives each part's base. ``read_token_files``
memory-maps them again. A task writes under a name of its own and renames when done, so a task that
is run again leaves whole files.
"""

from __future__ import annotations

import contextlib
import itertools
import os
import tempfile
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch_path, table, text_or_empty
from .tokens import BYTE_FILE, encoder, tokenizer_path

END_ID, DOCS_PER_BATCH, DOCS_PER_WRITE = 2, 1024, 256


@dataclass(frozen=True)
class TokenFiles:
    folder: str
    id_type: str
    width: int
    parts: tuple[tuple[str, int, int, int], ...]  # name, documents, tokens, base


def write_token_files(docs: DataFrame, folder: str, path: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> TokenFiles:
    """Null texts count as empty; null ids come first; equal ids are ordered by a hash of the text.

    An empty table gives no parts. Only the id and the text are read, whatever other columns are
    called. The driver receives one short row for each part.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    width = 2 if encoder(path).vocab_size <= 1 << 16 and end_id < 1 << 16 else 4

    def write(batches):
        context, enc = TaskContext.get(), encoder(path)
        store, root = fs.FileSystem.from_uri(folder)
        name = f"part-{context.partitionId():06d}"
        own = f"{root}/_{name}-{context.taskAttemptId()}"
        offsets, ids_of_docs, total = [np.zeros(1, "<u8")], [], 0
        end = end_id.to_bytes(4, "little")
        with contextlib.ExitStack() as stack:
            out = None
            for batch in batches:
                if not batch.num_rows:
                    continue
                if out is None:
                    store.create_dir(root, recursive=True)
                    out = stack.enter_context(store.open_output_stream(own + ".ids"))
                found = [enc.encode(text) + end for text in batch.column(1).to_pylist()]
                for at in range(0, len(found), DOCS_PER_WRITE):
                    out.write(np.frombuffer(b"".join(found[at : at + DOCS_PER_WRITE]), "<u4").astype(f"<u{width}").tobytes())
                offsets.append((total + np.cumsum([len(ids) // 4 for ids in found])).astype("<u8"))
                total = int(offsets[-1][-1])
                ids_of_docs.append(batch.column(0))
        if out is None:
            return
        with store.open_output_stream(own + ".off") as f:
            f.write(np.concatenate(offsets).tobytes())
        docs_table = pa.table({"doc_id": pa.chunked_array(ids_of_docs)})
        with store.open_output_stream(own + ".doc") as f, pa.ipc.new_file(f, docs_table.schema) as w:
            w.write_table(docs_table, max_chunksize=DOCS_PER_BATCH)
        for end_of_name in (".ids", ".off", ".doc"):
            store.move(own + end_of_name, f"{root}/{name}{end_of_name}")
        yield pa.RecordBatch.from_pydict({"name": [name], "docs": [docs_table.num_rows], "tokens": [total]}, pa.schema([("name", pa.string()), ("docs", pa.int64()), ("tokens", pa.int64())]))

    tie = F.xxhash64("text")
    ordered = rows.repartitionByRange("doc_id", tie).sortWithinPartitions("doc_id", tie)
    made = sorted(map(tuple, ordered.mapInArrow(write, "name string, docs long, tokens long").collect()))
    bases = itertools.accumulate((t for _, _, t in made), initial=0)
    return TokenFiles(folder, kind, width, tuple((n, d, t, b) for (n, d, t), b in zip(made, bases)))


@contextlib.contextmanager
def _mapped(store: fs.FileSystem, path: str):
    """A memory map of a file; a file of a remote store is first copied to the task's own disk."""
    if isinstance(store, fs.LocalFileSystem):
        with pa.memory_map(path) as f:
            yield f
        return
    handle, local = tempfile.mkstemp()
    os.close(handle)
    try:
        with store.open_input_stream(path) as src, open(local, "wb") as dst:
            while block := src.read(1 << 22):
                dst.write(block)
        with pa.memory_map(local) as f:
            yield f
    finally:
        os.unlink(local)


def read_token_files(spark: SparkSession, files: TokenFiles, keep_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and ids as 32-bit bytes), one task for each part."""
    schema = f"doc_id {files.id_type}, start long, n_tokens long, ids_crc32 long" + ", ids binary" * keep_ids
    folder, width = files.folder, files.width

    def read(batches):
        store, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with _mapped(store, f"{root}/{name}.ids") as a, _mapped(store, f"{root}/{name}.off") as b, _mapped(store, f"{root}/{name}.doc") as c:
                    ids, offsets = np.frombuffer(a.read_buffer(), f"<u{width}"), np.frombuffer(b.read_buffer(), "<u8").astype("i8")
                    docs, at = pa.ipc.open_file(c), 0
                    for k in range(docs.num_record_batches):
                        part = docs.get_batch(k)
                        ends = offsets[at : at + part.num_rows + 1]
                        whole = memoryview(ids[ends[0] : ends[-1]].astype("<u4").tobytes())
                        raw = [whole[s:e] for s, e in itertools.pairwise((4 * (ends - ends[0])).tolist())]
                        cols = [part.column(0), pa.array(base + ends[:-1], pa.int64()), pa.array(np.diff(ends), pa.int64()), pa.array(list(map(zlib.crc32, raw)), pa.int64())]
                        yield pa.RecordBatch.from_arrays(cols + [pa.array(list(map(bytes, raw)), pa.binary())] * keep_ids, ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * keep_ids)
                        at += part.num_rows

    parts = spark.createDataFrame([(n, b) for n, _, _, b in files.parts], "name string, base long")
    return parts.repartition(max(1, len(files.parts))).mapInArrow(read, schema)


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = write_token_files(table(spark, sf_dir, "documents"), scratch_path(spark, "tokens"), tokenizer_path(BYTE_FILE))
    return read_token_files(spark, files)
