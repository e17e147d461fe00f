"""Connected components of an edge table, smallest member as the name.

Each task first replaces its share of the edges between integers or strings by a forest, so
copies of one path or cycle go before any shuffle.  Labels start as the least neighbour.  Each
round takes the least label among a vertex and its neighbours and then the label
of that label, so paths shorten by more than half; the loop ends when no label
has changed.  Every round is written to the shared folder, so lineage stays
short.  Only a count comes to the driver, observed while a round is written.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, StringType

from matchengine.durable import discard, keep


def least_members(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The vertices of the edges (a, b), sorted, and each one's component."""
    vertex, at = np.unique(np.append(a, b), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    label = np.arange(len(vertex))
    while True:
        low, nearer = np.minimum(label[a], label[b]), label.copy()
        np.minimum.at(nearer, a, low)
        np.minimum.at(nearer, b, low)
        # A label is also given to the vertex that was the label before.
        np.minimum.at(nearer, label[a], low)
        np.minimum.at(nearer, label[b], low)
        nearer = nearer[nearer]
        if (nearer == label).all():
            return vertex, vertex[label]
        label = nearer


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        # Names are replaced by their places among those of the batch.
        named = pa.chunked_array([batch.column(0), batch.column(1)]).combine_chunks().dictionary_encode()
        codes = named.indices.to_numpy()
        vertex, root = least_members(codes[: len(batch)], codes[len(batch) :])
        some = vertex != root
        yield pa.RecordBatch.from_arrays([named.dictionary.take(pa.array(root[some])), named.dictionary.take(pa.array(vertex[some]))], names=["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b) to (vertex, component); vertices without edges are absent."""
    edges = edges.select("a", "b").where("a <> b")
    kind = edges.schema["a"].dataType
    if isinstance(kind, (IntegralType, StringType)):
        name = "long" if isinstance(kind, IntegralType) else "string"
        edges = edges.select(F.col("a").cast(name).alias("a"), F.col("b").cast(name).alias("b")).mapInArrow(_forests, f"a {name}, b {name}")
    both = keep(edges.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.*").distinct(), "edges")
    labels = keep(both.groupBy(F.col("a").alias("vertex")).agg(F.min("b").alias("n")).select("vertex", F.least("vertex", "n").alias("component")), "labels")
    while True:
        near = both.join(labels.select(F.col("vertex").alias("b"), "component"), "b").groupBy("a").agg(F.min("component").alias("n"))
        hooked = labels.join(near.withColumnRenamed("a", "vertex"), "vertex").select("vertex", F.col("component").alias("was"), F.least("component", "n").alias("component"))
        before, hooked = labels, keep(hooked, "labels")
        of = hooked.select(F.col("vertex").alias("component"), F.col("component").alias("top"))
        jumped = hooked.join(of, "component").select("vertex", "was", F.col("top").alias("component"))
        seen = Observation()
        labels = keep(jumped.observe(seen, F.count_if(F.col("was") != F.col("component")).alias("changed")).select("vertex", "component"), "labels")
        changed = seen.get["changed"]
        discard(before, hooked)
        if not changed:
            discard(both)
            return labels
