"""Token-id files: flat unsigned integers, 64-bit document offsets, bases from prefix sums."""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices
from .encoding import encoder

NO_ID = np.iinfo(np.int64).min


def _store(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None) -> dict:
    """Encode all documents and write them in ascending id order under ``folder`` (a URI all executors reach).

    Partition ``p`` of the range sort becomes ``p.ids`` (flat little-endian unsigned integers,
    two bytes where the vocabulary fits), ``p.off`` (n+1 64-bit offsets in ids) and ``p.doc``
    (64-bit document ids). Each file is written under a name of the task attempt and then
    renamed, so a repeated task replaces the same content. ``index.json`` holds for each
    partition the documents and ids before it, from prefix sums of the partitions' counts.

    Null text is empty (the end id alone); a null id sorts first and is stored as the least
    64-bit integer; repeated ids stand together, by text. An empty table gives empty files.
    Returns the index.
    """
    spark = docs.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("long").alias("i"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    rows = rows.withColumn("h", F.xxhash64("t"))
    rows = rows.repartitionByRange(n, F.asc_nulls_first("i"), "h").sortWithinPartitions(F.asc_nulls_first("i"), "h", "t").select("i", "t")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, task = encoder(tokenizer), TaskContext.get()
        part = task.partitionId()
        store, root = _store(folder)
        store.create_dir(root, recursive=True)
        names = {k: f"{root}/{part:06d}.{k}" for k in ("ids", "off", "doc")}
        mine = {k: f"{v}.attempt{task.taskAttemptId()}" for k, v in names.items()}
        docs_n, ids_n = 0, 0
        with store.open_output_stream(mine["ids"]) as ids, store.open_output_stream(mine["off"]) as off, store.open_output_stream(mine["doc"]) as doc:
            off.write(np.zeros(1, "<i8").tobytes())
            for batch in slices(batches):
                encoded, sizes = enc.flat(batch.column(1))
                ids.write(np.insert(encoded, np.cumsum(sizes), end_id).tobytes())
                at = ids_n + np.cumsum(sizes + 1, dtype="<i8")
                off.write(at.tobytes())
                doc.write(np.array([NO_ID if i is None else i for i in batch.column(0).to_pylist()], "<i8").tobytes())
                docs_n, ids_n = docs_n + batch.num_rows, int(at[-1])
        for k, v in names.items():
            store.move(mine[k], v)
        yield pa.RecordBatch.from_pydict({"part": [part], "n_docs": [docs_n], "n_tokens": [ids_n], "bytes": [enc.dtype.itemsize]})

    counts = sorted(rows.mapInArrow(write, "part long, n_docs long, n_tokens long, bytes long").collect())
    parts, doc_base, base = [], 0, 0
    for part, n_docs, n_tokens, width in counts:
        parts.append({"part": part, "n_docs": n_docs, "n_tokens": n_tokens, "doc_base": doc_base, "base": base, "bytes": width})
        doc_base, base = doc_base + n_docs, base + n_tokens
    index = {"parts": parts, "n_docs": doc_base, "n_tokens": base, "end_id": end_id}
    store, root = _store(folder)
    store.create_dir(root, recursive=True)
    with store.open_output_stream(f"{root}/index.json") as out:
        out.write(json.dumps(index).encode())
    return index


def _mapped(store: pafs.FileSystem, path: str, dtype: str, length: int) -> np.ndarray:
    """A memory map where the store is a local or mounted folder; else the file's bytes by one ranged read."""
    if not length:
        return np.zeros(0, dtype)
    if isinstance(store, pafs.LocalFileSystem):
        return np.memmap(path, dtype=dtype, mode="r", shape=(length,))
    with store.open_input_file(path) as f:
        return np.frombuffer(f.read_at(length * np.dtype(dtype).itemsize, 0), dtype)


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of token files, read through their memory maps.

    Returns ``doc_id, position, start, n_tokens, ids_crc32``: the document's ordinal, the ids
    of all documents before it, its ids with the end id, and the unsigned crc32 of these as
    little-endian unsigned 32-bit integers.
    """
    store, root = _store(folder)
    with store.open_input_stream(f"{root}/index.json") as f:
        index = json.loads(f.read())
    schema = "doc_id long, position long, start long, n_tokens long, ids_crc32 long"
    rows = [(p["part"], p["n_docs"], p["n_tokens"], p["doc_base"], p["base"], p["bytes"]) for p in index["parts"] if p["n_docs"]]
    todo = spark.createDataFrame(rows, "part long, n_docs long, n_tokens long, doc_base long, base long, bytes long")
    todo = todo.repartition(max(1, min(len(rows), 4 * spark.sparkContext.defaultParallelism)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(folder)
        for batch in batches:
            for p in batch.to_pylist():
                name = f"{root}/{p['part']:06d}"
                ids = _mapped(store, f"{name}.ids", f"<u{p['bytes']}", p["n_tokens"])
                off = _mapped(store, f"{name}.off", "<i8", p["n_docs"] + 1)
                doc = _mapped(store, f"{name}.doc", "<i8", p["n_docs"])
                for lo in range(0, p["n_docs"], 4096):
                    hi = min(lo + 4096, p["n_docs"])
                    o, who = off[lo : hi + 1], np.array(doc[lo:hi])
                    crc = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(o[:-1].tolist(), o[1:].tolist(), strict=True)]
                    yield pa.RecordBatch.from_pydict(
                        {
                            "doc_id": pa.array(who, pa.int64(), mask=who == NO_ID),
                            "position": np.arange(lo, hi) + p["doc_base"],
                            "start": o[:-1] + p["base"],
                            "n_tokens": np.diff(o),
                            "ids_crc32": np.array(crc, np.int64),
                        }
                    )

    return todo.mapInArrow(read, schema)


def token_ids(folder: str, position: int) -> np.ndarray:
    """The ids of one document by its ordinal, straight from the maps."""
    store, root = _store(folder)
    with store.open_input_stream(f"{root}/index.json") as f:
        index = json.loads(f.read())
    p = next(p for p in index["parts"] if p["doc_base"] <= position < p["doc_base"] + p["n_docs"])
    name, k = f"{root}/{p['part']:06d}", position - p["doc_base"]
    off = _mapped(store, f"{name}.off", "<i8", p["n_docs"] + 1)
    return np.array(_mapped(store, f"{name}.ids", f"<u{p['bytes']}", p["n_tokens"])[off[k] : off[k + 1]])
