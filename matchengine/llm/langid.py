"""Language identification with string kernels.

The kernel of two texts is the blended-spectrum presence kernel: the number of
byte n-grams (all lengths of ``NGRAMS``) that occur in both, over the geometric
mean of how many occur in each.  N-grams are hashed to ``BUCKETS`` places, so a
text is a row of zeros and ones.  Landmarks of the training sample give the
Nystroem map; one-versus-rest kernel ridge regression is solved on it by the
driver, and texts are scored in batches by two matrix products, with the
landmarks and with the dual weights.

The model is fitted on a bounded sample, ``SAMPLE_PER_LANGUAGE`` labelled rows a
language and ``SAMPLE`` in all, drawn by a hash of the id.  What is broadcast is
``LANDMARKS`` x ``BUCKETS`` numbers (4 MB) and ``LANDMARKS`` weights a language.

Defined results: a null text, or one without a letter, is ``und`` with score 0;
without any labelled row every text is.  All labels are learnt, with fewer rows
each the more there are; more than ``MAX_LANGUAGES`` of them are an error.  Of
equal scores the first label in order wins.  A null id is neither held out nor
learnt from.  Repeated rows are judged alike.  Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchengine.llm import textvec as tv

NGRAMS = (1, 2, 3)
BUCKETS = 8192
LANDMARKS = 128
SAMPLE_PER_LANGUAGE, SAMPLE = 400, 8000
#: A label needs a row of the sample; there are fewer languages than that.
MAX_LANGUAGES = SAMPLE
RIDGE = 1e-3
UNKNOWN = "und"

_LETTERS = tv.byte_class((0x41, 0x5A), (0x61, 0x7A))
#: Letters in lower case and the bytes of other scripts; all else is a blank.
_FOLD = np.where(_LETTERS | tv.byte_class((0x80, 0xFF)), tv.LOWER, 0x20).astype(np.uint8)
_FACTORS = np.array([2654435761, 2246822519, 3266489917], np.uint32)


def presence(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows of zeros and ones: which hashed n-grams each text has."""
    n = len(offsets) - 1
    out = np.zeros((n, BUCKETS), np.float32)
    flat = out.ravel()
    folded = _FOLD[data].astype(np.uint32)
    row = np.repeat(np.arange(n, dtype=np.int32) * BUCKETS, np.diff(offsets))
    room = np.repeat(offsets[1:], np.diff(offsets)) - np.arange(len(data))
    for size in NGRAMS:
        count = max(len(data) - size + 1, 0)
        h = np.full(count, size * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
        for j in range(size):
            h = (h ^ folded[j : j + count]) * _FACTORS[j]
        h ^= h >> np.uint32(15)
        at = row[:count] + (h & np.uint32(BUCKETS - 1)).astype(np.int32)
        flat[at if size == 1 else at[room[:count] >= size]] = 1
    return out


def has_letter(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    upto = np.append(0, np.cumsum(_LETTERS[data]))
    found = upto[offsets[1:]] > upto[offsets[:-1]]
    for k in np.flatnonzero(~found & (np.diff(offsets) > 0)):
        found[k] = any(c.isalpha() for c in data[offsets[k] : offsets[k + 1]].tobytes().decode("utf-8", "replace"))
    return found


@dataclass
class KernelModel:
    languages: list[str]
    #: Unit-length landmark rows, one column each, and dual weights.
    landmarks: np.ndarray
    weights: np.ndarray

    @staticmethod
    def fit(rows: np.ndarray, labels: list[str]) -> KernelModel:
        languages = sorted(set(labels))
        of = {c: [k for k, x in enumerate(labels) if x == c] for c in languages}
        # One of each language in turn; beyond LANDMARKS languages, of the first in
        # the rows' random order.
        turns = sorted((turn, k) for c in languages for turn, k in enumerate(of[c]))
        chosen = sorted(k for _, k in turns[:LANDMARKS])
        unit = rows / np.sqrt(np.maximum(rows.sum(axis=1, keepdims=True), 1))
        marks = unit[chosen]
        k_nm, k_mm = (unit @ marks.T).astype(float), (marks @ marks.T).astype(float)
        values, vectors = np.linalg.eigh(k_mm)
        root = vectors / np.sqrt(np.maximum(values, 1e-6))
        mapped = k_nm @ root
        wanted = np.where(np.array(labels)[:, None] == np.array(languages)[None, :], 1.0, -1.0)
        solved = np.linalg.solve(mapped.T @ mapped + RIDGE * len(rows) * np.eye(mapped.shape[1]), mapped.T @ wanted)
        return KernelModel(languages, np.ascontiguousarray(marks.T, np.float32), (root @ solved).astype(np.float32))

    def score(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the best language and its score from 0 to 1."""
        kernel = (rows @ self.landmarks) / np.sqrt(np.maximum(rows.sum(axis=1, keepdims=True), 1))
        scores = kernel @ self.weights
        best = scores.argmax(axis=1)
        return best, np.clip((scores[np.arange(len(rows)), best].astype(float) + 1) / 2, 0, 1)


def held_out(doc_id: str) -> Column:
    return F.coalesce(F.crc32(F.col(f"`{doc_id}`").cast("string")) % 4 == 2, F.lit(False))


def train(documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> KernelModel | None:
    """Fit on a bounded sample of the labelled documents not held out."""
    rows = documents.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("id").isNotNull() & ~held_out("id"))
    counts = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MAX_LANGUAGES + 1).collect()
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages; a model of all would not fit its bound")
    if not counts:
        return None
    each = min(SAMPLE_PER_LANGUAGE, max(1, SAMPLE // len(counts)))
    scale = 1 << 30
    # At most MAX_LANGUAGES rows: of a rare label every row may be drawn.
    share = documents.sparkSession.createDataFrame([(r["lang"], min(scale, 2 * each * scale // r["count"])) for r in counts], "__lang string, share long")
    drawn = F.xxhash64(F.lit("langid"), F.col("id").cast("string"))
    sample = rows.join(F.broadcast(share), F.col("lang") == F.col("__lang")).where(F.pmod(drawn, F.lit(scale)) < F.col("share")).select("lang", "text", drawn.alias("drawn"))

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in tv.text_chunks(batches, 1, tv.CHUNK_BYTES // 2):
            packed = np.packbits(presence(data, offsets) > 0, axis=1)
            some = pa.array(has_letter(data, offsets))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array([r.tobytes() for r in packed], pa.binary())], names=["lang", "drawn", "bits"]).filter(some)

    # About twice as many as wanted are drawn; of each label the first stay.
    first = Window.partitionBy("lang").orderBy("drawn", "bits")
    drawn_rows = sample.mapInArrow(bits, "lang string, drawn long, bits binary")
    found = drawn_rows.withColumn("place", F.row_number().over(first)).where(F.col("place") <= each).orderBy("drawn", "lang", "bits").limit(SAMPLE + len(counts)).collect()
    if not found:
        return None
    packed = np.frombuffer(b"".join(bytes(r["bits"]) for r in found), np.uint8).reshape(len(found), -1)
    return KernelModel.fit(np.unpackbits(packed, axis=1).astype(np.float32), [r["lang"] for r in found])


def predict(documents: DataFrame, model: KernelModel | None, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    source = documents.select(F.col(f"`{doc_id}`").alias("doc_id"), held_out(doc_id).alias("held_out"), F.col(f"`{text}`").alias("text"))

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        for part, data, offsets in tv.text_chunks(batches, 2, tv.CHUNK_BYTES // 2):
            for low in range(0, part.num_rows, 512):
                high = min(low + 512, part.num_rows)
                some = offsets[low : high + 1]
                piece, where = data[some[0] : some[-1]], some - some[0]
                known = has_letter(piece, where) if fitted else np.zeros(high - low, bool)
                names, score = [UNKNOWN] * (high - low), np.zeros(high - low)
                if known.any():
                    best, value = fitted.score(presence(piece, where))
                    names = [fitted.languages[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)]
                    score = np.where(known, value, 0.0)
                yield pa.RecordBatch.from_arrays([part.column(0)[low:high], part.column(1)[low:high], pa.array(names, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(label, f"doc_id {kind}, held_out boolean, lang_pred string, score double")
