"""Token ids of documents in sorted-string-table shards, written and read by executors."""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkwright.llm import sstable, tiles
from sparkwright.llm.shared import arrow_map, materialise, runs, shared_folder, strings
from sparkwright.llm.tokens import encoder


def filesystem(uri: str):
    """The file system of a URI and the path in it; works wherever pyarrow does."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if "://" not in uri:
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


#: Bytes at which a task closes its file and begins the next.
FILE_BYTES = 256 << 20


def write_shards(
    docs: DataFrame, tokenizer: str, folder: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, file_bytes: int = FILE_BYTES
) -> DataFrame:
    """Encode every whole text, append ``end_id``, and write files of ranges of ids
    under ``folder``, each of about ``file_bytes`` at most. Returns the manifest:
    part and file (in order of ids), path, entries, ids.

    A file is named by its task attempt and listed in the manifest by the attempt
    that Spark commits, so a task that is repeated or lost leaves no trace in the
    result. A null text counts as empty (its entry holds the end id alone); a text of
    any length is one entry; null ids come first; ids may repeat, in an order that a
    hash of the text fixes. An empty table writes no file."""
    spark = docs.sparkSession
    narrow = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    placed = narrow.repartitionByRange(parts, "id").sortWithinPartitions("id", F.xxhash64("text"))

    def write(batches):
        encode = encoder(tokenizer)
        end = np.array([end_id], encode.dtype).tobytes()
        context = TaskContext.get()
        name = f"{folder}/{context.partitionId():06d}-{context.taskAttemptId()}"
        out = table = None
        number = 0

        def done() -> pa.RecordBatch:
            table.close()
            out.close()
            return pa.RecordBatch.from_pydict({"part": [context.partitionId()], "file": [number], "path": [f"{name}-{number}.sst"], "entries": [table.entries], "ids": [table.ids]})

        for batch in batches:
            data, offsets = strings(batch.column(1))
            ids = batch.column(0).to_pylist()
            for lo, hi in runs(offsets, tiles.CHUNK, 1 << 20):
                values, at = encode.encode_chunk(data, offsets[lo : hi + 1])
                for k in range(hi - lo):
                    if table is None:
                        fs, local = filesystem(f"{name}-{number}.sst")
                        fs.create_dir(local.rpartition("/")[0], recursive=True)
                        out = fs.open_output_stream(local)
                        table = sstable.Writer(out, encode.dtype.itemsize)
                    table.add(sstable.key_of(ids[lo + k]), values[at[k] : at[k + 1]].tobytes() + end)
                    if table.at >= file_bytes:
                        yield done()
                        table, number = None, number + 1
        if table is not None:
            yield done()

    return materialise(placed.mapInArrow(write, "part long, file long, path string, entries long, ids long"), "manifest")


def read_shards(manifest: DataFrame) -> DataFrame:
    """Per entry, from the files: id, start (ids of all entries before it), n_tokens, ids_crc32
    (of the ids as little-endian unsigned 32-bit integers)."""
    # One row a file: the window is over the manifest alone.
    before = Window.orderBy("part", "file").rowsBetween(Window.unboundedPreceding, -1)
    placed = materialise(manifest.select("path", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("offset")), "offsets")
    files = placed.repartition(max(1, placed.count()))

    def read(batch: pa.RecordBatch):
        for path, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            fs, local = filesystem(path)
            with fs.open_input_file(local) as f:
                table = sstable.Reader(lambda offset, length, f=f: f.read_at(length, offset), f.size())
                dtype = "<u2" if table.id_width == 2 else "<u4"
                rows: list[tuple] = []
                for key, value in table:
                    ids = np.frombuffer(value, dtype)
                    rows.append((sstable.id_of(key), at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    at += len(ids)
                    if len(rows) >= 8192:
                        yield _batch(rows)
                        rows = []
                if rows:
                    yield _batch(rows)

    def _batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["id", "start", "n_tokens", "ids_crc32"])

    return arrow_map(files, read, "id long, start long, n_tokens long, ids_crc32 long")


def token_table(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0) -> DataFrame:
    """Write the shards in a fresh folder of the shared one and read them back."""
    spark: SparkSession = docs.sparkSession
    folder = f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    return read_shards(write_shards(docs, tokenizer, folder, id_col, text_col, end_id)).withColumnRenamed("id", id_col)
