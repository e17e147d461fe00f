"""Token files: tokenised documents in range-coded stripes, in document order.

Documents are dealt out by ranges of their id and sorted, so file after file
the ids stand in ascending document order.  A file is a sequence of stripes of
whole documents: the documents' ids and token counts, and the range-coded
blocks of ``token_codec`` with their checksums.  Stripes are binary rows of a
Parquet dataset, which gives what a cluster needs of a file format besides:
atomic commit of a task's output, and any store that Spark can write to.

A worker holds one stripe: ``STRIPE_TOKENS`` ids, or the longest document.

Defined results: a null or empty text is a document of the end id alone;
documents without an id come first; repeated ids stand side by side, ordered
by a hash of their text; an empty table gives an empty set of files.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from matchengine.llm import textvec as tv
from matchengine.llm import token_codec as codec
from matchengine.llm import tokens as tk

#: Text of one file, as long as there are at most MAX_FILES (their bounds are
#: part of the plan); beyond, files grow.
FILE_BYTES, MAX_FILES = 256 << 20, 100_000
STRIPE_TOKENS = codec.BLOCK_TOKENS * codec.STRIPE_BLOCKS
STRIPE = "file int, stripe int, doc_ids array<long>, counts array<long>, data binary"


def _file_of(number: Column, bounds: list[int]) -> Column:
    """How many bounds are below ``number``: first by every k-th, then among k."""
    if not bounds:
        return F.lit(0)
    listed = lambda some: F.split(F.lit(",".join(map(str, some))), ",").cast("array<long>")
    step = max(1, math.isqrt(len(bounds)))
    coarse = F.size(F.filter(listed(bounds[step - 1 :: step]), lambda x: x < number)) * step
    return coarse + F.size(F.filter(F.slice(listed(bounds), coarse + 1, F.lit(step)), lambda x: x < number))


def write_token_files(documents: DataFrame, path: str, tokenizer: str, *, doc_id: str = "doc_id", text: str = "text", end_id: int = 2) -> None:
    """Tokenise every whole text and write the files to a new folder."""
    source = documents.select(tv.long_id(documents, doc_id).alias("doc_id"), F.col(f"`{text}`").alias("text"))
    size = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    files = min(MAX_FILES, max(int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // FILE_BYTES)))
    # Bounds come from the ids alone; a range partitioning would read all texts
    # once more to sample them.
    bounds = source.select(F.percentile_approx("doc_id", [k / files for k in range(1, files)] or [0.5], 20 * files)).first()[0] or []
    part = _file_of(F.coalesce("doc_id", F.lit(-(2**63)).cast("long")), sorted(set(bounds)))
    dealt = source.select(part.alias("file"), "doc_id", "text").repartitionById(files, "file").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))

    def stripes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, file, number = tk.encoder(tokenizer), 0, 0
        ids, names, counts, size = [], [], [], 0

        def row() -> pa.RecordBatch:
            data = codec.encode_stripe(np.concatenate(ids))
            return pa.RecordBatch.from_arrays(
                [pa.array([file], pa.int32()), pa.array([number], pa.int32()), pa.array([names], pa.list_(pa.int64())), pa.array([counts], pa.list_(pa.int64())), pa.array([data], pa.binary())],
                names=["file", "stripe", "doc_ids", "counts", "data"],
            )

        for part, data, offsets in tv.text_chunks(batches, 2, tv.CHUNK_BYTES // 2):
            found, begin = tk.with_end(*encoder.encode(data, offsets), end_id)
            if size and size + len(found) > STRIPE_TOKENS:
                yield row()
                ids, names, counts, size, number = [], [], [], 0, number + 1
            file = part.column(0)[0].as_py()
            ids.append(found)
            names += part.column(1).to_pylist()
            counts += np.diff(begin).tolist()
            size += len(found)
        if names:
            yield row()

    dealt.mapInArrow(stripes, STRIPE).write.parquet(path)


def read_token_files(spark: SparkSession, path: str, *, with_ids: bool = False) -> DataFrame:
    """One row per document, from the files alone: doc_id, start, n_tokens,
    ids_crc32, and ``ids`` (little-endian 32-bit) if asked for."""
    files = spark.read.schema(STRIPE).parquet(path)
    per_stripe = files.select("file", "stripe", F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))
    # Places before a stripe: of the files before, then of its own file.
    per_file = per_stripe.groupBy("file").agg(F.sum("n").alias("n"))
    before = per_file.select("file", F.coalesce(F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("file_start"))
    inside = Window.partitionBy("file").orderBy("stripe").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_stripe.select("file", "stripe", F.coalesce(F.sum("n").over(inside), F.lit(0)).alias("stripe_start")).join(before, "file").select("file", "stripe", (F.col("stripe_start") + F.col("file_start")).alias("first"))

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, stripe, names, counts, data in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                raw = memoryview(codec.decode_stripe(data)).cast("B")
                begin = np.append(0, np.cumsum(counts)).tolist()
                ids = [raw[4 * a : 4 * b] for a, b in zip(begin, begin[1:], strict=False)]
                for low in range(0, len(names), 4096):
                    high = min(low + 4096, len(names))
                    columns = [
                        pa.array([file] * (high - low), pa.int32()),
                        pa.array([stripe] * (high - low), pa.int32()),
                        pa.array(names[low:high], pa.int64()),
                        pa.array(begin[low:high], pa.int64()),
                        pa.array(counts[low:high], pa.int64()),
                        pa.array([zlib.crc32(x) for x in ids[low:high]], pa.int64()),
                    ]
                    if with_ids:
                        columns.append(pa.array([bytes(x) for x in ids[low:high]], pa.binary()))
                    yield pa.RecordBatch.from_arrays(columns, names=["file", "stripe", "doc_id", "at", "n_tokens", "ids_crc32", "ids"][: len(columns)])

    schema = "file int, stripe int, doc_id long, at long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids
    decoded = files.mapInArrow(documents, schema)
    return decoded.join(starts, ["file", "stripe"]).select("doc_id", (F.col("first") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)
