"""Token-ID output: documents in id order as blocks of an entropy coder, and their reader."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.llm.memory import lean
from dossier.llm.rans import Table, decode_parts, encode
from dossier.llm.tokens import IdCounter, token_ids
from dossier.llm.words import slices
from dossier.session import partitions

#: A block is closed when it holds so many ids; a document is never divided.
BLOCK = 1 << 20


def _counts(path: str, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, texts = IdCounter(path), 0
        for batch in batches:
            texts += batch.num_rows
            for i, j in slices(batch.column(0), 1 << 20):
                counter.add(batch.column(0).slice(i, j - i))
        total = counter.counts()
        total = np.append(total, np.zeros(max(0, end + 1 - len(total)), np.int64))
        total[end] += texts
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["token", "n"])

    return run


def _blocks(path: str, end: int, frequencies):
    """Blocks of the rows (id, text, file, row) of a task.

    Without a file the task is one part. With files each unbroken run of a file's rows is a part, named
    by the file and the run's first row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Table.from_bytes(frequencies.value)
        part, block, first, size = "", 0, 0, 0
        held: list[np.ndarray] = []
        names: list[pa.Array] = []
        lengths: list[np.ndarray] = []

        def close() -> pa.RecordBatch:
            docs = pa.concat_arrays(names)
            ids = np.concatenate(held)
            row = [part, block, first, len(ids), None, np.concatenate(lengths).astype("<u4").tobytes(), encode(ids, table)]
            kinds = [pa.string(), pa.int32(), pa.int64(), pa.int64(), None, pa.binary(), pa.binary()]
            cols = [pa.ListArray.from_arrays(pa.array([0, len(docs)], pa.int32()), docs) if k is None else pa.array([x], k) for x, k in zip(row, kinds, strict=True)]
            held.clear(), names.clear(), lengths.clear()
            return pa.RecordBatch.from_arrays(cols, ["part", "block", "first", "n_ids", "docs", "lengths", "data"])

        last = None
        for batch in batches:
            for i, j in slices(batch.column(1), 1 << 20):
                piece = batch.slice(i, j - i)
                ids, at = token_ids(piece.column(1), path)
                n = np.diff(at) + 1
                # The end id goes behind each text's ids.
                whole = np.full(len(ids) + len(n), end, np.uint32)
                inside = np.ones(len(whole), bool)
                inside[np.cumsum(n) - 1] = False
                whole[inside] = ids
                files, rows, runs = piece.column(2), piece.column(3), [0]
                if files.null_count < len(files):
                    named, index = files.to_pylist(), rows.to_pylist()
                    before = [last, *zip(named, index, strict=True)]
                    runs = [k for k in range(len(named)) if before[k] is None or (named[k], index[k]) != (before[k][0], before[k][1] + 1)]
                    last = before[-1]
                else:
                    runs = [] if last else [0]
                    named, index, last = None, None, ("", 0)
                ends = np.append(0, np.cumsum(n))
                for lo, hi in zip(sorted({0, *runs}), [*sorted({0, *runs} - {0}), len(n)], strict=True):
                    if lo in runs:
                        if held:
                            yield close()
                        part = f"{named[lo]}/{index[lo]:020d}" if named else f"{TaskContext.get().partitionId():010d}"
                        block, first, size = 0, 0, 0
                    held.append(whole[ends[lo] : ends[hi]])
                    names.append(piece.column(0).slice(lo, hi - lo))
                    lengths.append(n[lo:hi])
                    size += len(held[-1])
                    if size >= BLOCK:
                        yield close()
                        block, first, size = block + 1, first + size, 0
        if held:
            yield close()

    return run


def write_token_files(docs: DataFrame, out: str, tokenizer_path: str, end: int = 2, id_col: str = "doc_id", text_col: str = "text", as_stored: bool = False) -> None:
    """Encode docs into the folder out: `table` holds the frequencies, `blocks` the blocks.

    A first pass counts the ids of the whole corpus, which gives one table for all blocks. A second
    deals texts by ranges of (id, hash of the text), tokenises them in that order and encodes each
    range's blocks. If as_stored, docs is read from Parquet files and keeps their order, which is that
    of the files' numbers, names and rows: then nothing is shuffled.

    The folder holds Parquet files of binary records, so any store that Spark writes to will do; a
    record is complete in itself: place, document ids and lengths, coder block with checkpoints and
    checksums. Ids may be of any type that sorts. Null counts as an empty text, which has its end id
    only; null ids come first; rows that share an id are in the order of their texts' hashes, and
    repeated rows are rows. A text of any length is one document. Extra columns are ignored; an empty
    table gives a table and no blocks.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    where = [F.lit(None).cast("string"), F.lit(None).cast("long")]
    if as_stored:
        number = F.lpad(F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1), 10, "0")
        where = [F.concat(number, F.lit(" "), F.col("_metadata.file_name")), F.col("_metadata.row_index")]
    base = docs.select(F.col(f"`{id_col}`").alias("_id"), text.alias("_text"), where[0].alias("_file"), where[1].alias("_row"))
    kind = docs.schema[id_col].dataType.simpleString()
    counted = base.select("_text").mapInArrow(lean("token files", _counts(tokenizer_path, end)), "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    pairs = counted.collect()  # at most the vocabulary
    counts = np.zeros(1 + max((r[0] for r in pairs), default=end), np.int64)
    for token, n in pairs:
        counts[token] = n
    frequencies = Table.of(counts).to_bytes()
    spark.createDataFrame([(bytearray(frequencies),)], "data binary").coalesce(1).write.parquet(f"{out}/table")
    shared = spark.sparkContext.broadcast(frequencies)
    if not as_stored:
        order = [F.col("_id").asc_nulls_first(), F.xxhash64("_text")]
        base = base.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order, "_text")
    schema = f"part string, block int, first long, n_ids long, docs array<{kind}>, lengths binary, data binary"
    base.mapInArrow(lean("token files", _blocks(tokenizer_path, end, shared)), schema).write.option("compression", "none").parquet(f"{out}/blocks")
    shared.destroy()


def read_token_files(spark: SparkSession, out: str, with_ids: bool = False) -> DataFrame:
    """Documents of a folder, decoded: doc, start, n_tokens, ids_crc32 and, if asked, ids.

    start counts the ids of all documents before it; the parts' totals are summed on the driver, one
    number for each part. Blocks are decoded from checkpoint to checkpoint. Damage is an error.
    """
    blocks = spark.read.parquet(f"{out}/blocks")
    data = bytes(spark.read.parquet(f"{out}/table").first()[0])
    totals = sorted((r[0], r[1]) for r in blocks.groupBy("part").agg(F.sum("n_ids")).collect())
    before, total = {}, 0
    for part, n in totals:
        before[part] = total
        total += n
    shared = spark.sparkContext.broadcast((data, before))
    kind = blocks.schema["docs"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, starts = Table.from_bytes(shared.value[0]), shared.value[1]
        for batch in batches:
            for i in range(batch.num_rows):
                part, first = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                n = np.frombuffer(batch.column(3)[i].as_py(), "<u4").astype(np.int64)
                ends = np.cumsum(n)
                crc, at, doc, kept = np.zeros(len(n), np.int64), 0, 0, []
                for ids in decode_parts(batch.column(4)[i].as_py(), table):
                    raw = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
                    if with_ids:
                        kept.append(ids)
                    lo, stop = 0, at + len(ids)
                    while lo < len(ids):  # up to the end of a document, or of what is decoded
                        hi = min(int(ends[doc]), stop) - at
                        crc[doc] = zlib.crc32(raw[4 * lo : 4 * hi], int(crc[doc]))
                        doc, lo = doc + (at + hi == ends[doc]), hi
                    at = stop
                cols = [batch.column(2)[i].values, pa.array(starts[part] + first + ends - n), pa.array(n), pa.array(crc)]
                names = ["doc", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(np.concatenate(kept).astype(np.int64))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names)

    schema = f"doc {kind}, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    return blocks.select("part", "first", "docs", "lengths", "data").mapInArrow(lean("token files", run), schema)
