"""Token ids in Arrow's file format (operator 4).

A token file is an Arrow IPC file of record batches with two columns: `ids`, a fixed-size list of LENGTH unsigned
integers (16 bits wide where the vocabulary's ids fit, else 32), and `mask`, a fixed-size list of LENGTH booleans that is
false only behind the end of the file's stream. Batches are not compressed and all rows have one size, so row k of any batch
lies at a computed place: a memory-mapped file gives a sequence's ids, and its mask as Arrow's packed bits (`mask_bits`), as
views without copying; `mask` expands these bits to one byte a token, which is a copy.

Writing: documents are range-partitioned and sorted by id (text hash and text break ties), each task encodes its range and
writes one file under a name of its own attempt, and returns one manifest row. The manifest is written as a table, so a
repeated task leaves at most an unreferenced file. Each file starts with a fresh sequence; `start` counts all ids before a
document over the whole corpus, from a running sum over one number for each file.

Defined results: a null or empty text is the end id alone; a null id sorts first; repeated ids and rows are all kept; a
text of any length is streamed through the sequences; extra columns are ignored; an empty table writes no file.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import shared_encoder, text_batches, with_end
from .scratch import fresh_path, materialize, ship

LENGTH, ROWS, MAX_BROADCAST_FILES = 2048, 256, 500_000
MANIFEST = "part int, uri string, n_ids long, doc_ids array<long>, n_tokens array<long>"


def schema(length: int, wide: bool = False):
    import pyarrow as pa

    kind = pa.uint32() if wide else pa.uint16()
    return pa.schema([pa.field("ids", pa.list_(pa.field("item", kind, False), length), False), pa.field("mask", pa.list_(pa.field("item", pa.bool_(), False), length), False)])


def open_fs(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class TokenFileWriter:
    """Appends ids to a token file, a record batch at a time; memory stays at one batch."""

    def __init__(self, uri: str, length: int = LENGTH, wide: bool = False):
        import pyarrow as pa

        if length % 8:
            raise ValueError("length must be a multiple of 8, so that each row's mask begins at a whole byte")
        self.fs, path = open_fs(uri)
        self.fs.create_dir(path.rpartition("/")[0], recursive=True)
        self.sink, self.length, self.n = self.fs.open_output_stream(path), length, 0
        self.schema, self.kind = schema(length, wide), np.uint32 if wide else np.uint16
        self.out = pa.ipc.new_file(self.sink, self.schema)
        self.rest: list[np.ndarray] = []
        self.held = 0

    def append(self, ids: np.ndarray) -> None:
        if len(ids) and int(ids.max()) > np.iinfo(self.kind).max:
            raise ValueError(f"id {int(ids.max())} doesn't fit into {np.dtype(self.kind).name}")
        self.rest.append(ids.astype(self.kind))
        self.held += len(ids)
        self.n += len(ids)
        if self.held >= self.length * ROWS:
            self._write(self.held // (self.length * ROWS) * ROWS)

    def _write(self, rows: int) -> None:
        import pyarrow as pa

        flat = np.concatenate(self.rest)
        now, self.rest = flat[: rows * self.length], [flat[rows * self.length :]]
        self.held = len(self.rest[0])
        for k in range(0, rows, ROWS):
            part = now[k * self.length : (k + ROWS) * self.length]
            size = -(-len(part) // self.length) * self.length
            mask = np.arange(size) < len(part)
            part = np.concatenate([part, np.zeros(size - len(part), self.kind)]) if size > len(part) else part
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), type=f.type) for x, f in zip((part, mask), self.schema)]
            self.out.write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schema))

    def close(self) -> int:
        if self.held:
            self._write(-(-self.held // self.length))
        self.out.close()
        self.sink.close()
        return self.n


class TokenFile:
    """Random access to a token file. Local files are memory-mapped and sequences are views of the mapping."""

    def __init__(self, uri: str):
        import pyarrow as pa

        self.fs, path = open_fs(uri)
        self.source = pa.memory_map(path) if self.fs.type_name == "local" else self.fs.open_input_file(path)
        self.reader = pa.ipc.open_file(self.source)
        self.length = self.reader.schema.field("ids").type.list_size

    def _row(self, k: int, column: str):
        batch = self.reader.get_batch(k // ROWS)
        return batch.column(column)[k % ROWS].values

    def sequence(self, k: int) -> np.ndarray:
        """The ids of sequence k, without a copy."""
        return self._row(k, "ids").to_numpy(zero_copy_only=True)

    def mask_bits(self, k: int) -> np.ndarray:
        """The mask of sequence k as packed bits, least bit first, without a copy."""
        values = self.reader.get_batch(k // ROWS).column("mask").values
        first = (values.offset + k % ROWS * self.length) // 8
        return np.frombuffer(values.buffers()[1], np.uint8)[first : first + self.length // 8]

    def mask(self, k: int) -> np.ndarray:
        return np.unpackbits(self.mask_bits(k), bitorder="little").view(bool)

    def tokens(self, start: int, n: int) -> np.ndarray:
        """n ids of the file's stream from `start`."""
        per = self.length * ROWS
        parts = []
        for b in range(start // per, -(-(start + n) // per)):
            lo, hi = max(start - b * per, 0), min(start + n - b * per, per)
            parts.append(self.reader.get_batch(b).column("ids").values.to_numpy(zero_copy_only=True)[lo:hi])
        return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.empty(0, np.uint16)


def write(docs: DataFrame, folder: str, vocab: str | None = None, length: int = LENGTH) -> DataFrame:
    """Writes token files into `folder` (any place that pyarrow's file systems reach); returns the manifest."""

    def put(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        out, encoder, doc_ids, counts = None, shared_encoder(vocab), [], []
        for batch in text_batches(batches):
            if out is None:
                uri = f"{folder}/{uuid.uuid4().hex}.arrow"
                out = TokenFileWriter(uri, length, wide=len(encoder.leads) > 1 << 16)
            ids, n = with_end(*encoder.encode([x or "" for x in batch.column("text").to_pylist()]))
            out.append(ids)
            doc_ids += batch.column("doc_id").to_pylist()
            counts += n.tolist()
        if out is not None:
            row = {"part": TaskContext.get().partitionId(), "uri": uri, "n_ids": out.close(), "doc_ids": doc_ids, "n_tokens": counts}
            kinds = [pa.int32(), pa.string(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row.values(), kinds)], list(row))

    ship(docs.sparkSession)
    order = [F.col("doc_id").asc_nulls_first(), F.col("_tie"), F.col("text")]
    ranged = docs.select(F.col("doc_id").cast("long"), "text").withColumn("_tie", F.xxhash64("text"))
    ranged = ranged.repartitionByRange(*order[:2]).sortWithinPartitions(*order).drop("_tie")
    return materialize(ranged.mapInArrow(put, MANIFEST), "manifest")


def read(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, uri, file_start) of every document, from the files' own bytes."""
    # two numbers for each file go through one task; the documents' arrays stay where they are until their file is read
    before = F.coalesce(F.sum("n_ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = materialize(manifest.select("part", "n_ids").withColumn("first", before).select("part", "first"), "starts")
    n = first.count()
    first = F.broadcast(first) if n <= MAX_BROADCAST_FILES else first
    # ranges of part: one file in each partition, where adaptive execution would gather all files, by their few bytes, in one
    files = manifest.join(first, "part").repartitionByRange(max(1, n), "part")

    def get(batches):
        import pyarrow as pa

        for batch in batches:
            for row in batch.to_pylist():
                file, at, starts, crc = TokenFile(row["uri"]), 0, [], []
                for n in row["n_tokens"]:
                    starts.append(at)
                    crc.append(zlib.crc32(file.tokens(at, n).astype("<u4").tobytes()))
                    at += n
                local = np.array(starts, np.int64)
                columns = [row["doc_ids"], local + row["first"], row["n_tokens"], crc, [row["uri"]] * len(local), local]
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "start", "n_tokens", "ids_crc32", "uri", "file_start"])

    return files.mapInArrow(get, "doc_id long, start long, n_tokens long, ids_crc32 long, uri string, file_start long")


def op4_token_files(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return read(write(docs, fresh_path(spark, "tokens"))).select("doc_id", "start", "n_tokens", "ids_crc32")
