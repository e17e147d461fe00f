"""Whole jobs: levels to pairs, probabilities, clusters and adopted values."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchengine.operators import cluster, groups, pairs
from matchengine.schema import CONFIG, MatchConfig


@dataclass
class Match:
    pairs: DataFrame
    clusters: DataFrame


def match(levels: DataFrame, config: MatchConfig = CONFIG, scorer=None, order: dict[str, int] | None = None, block: list[str] | None = None, reach: float | None = None) -> Match:
    """Match standard levels of different datasets.

    ``scorer`` adds ``probability`` to feature rows; without one the rule-based
    score does.  Pairs not above the pair threshold are left out.  Levels are
    paired inside a ``block`` of columns, the nuclide where ``levels`` has it, and, with
    ``reach``, only up to that distance of energies; levels of one nuclide, without
    that column, form all pairs of different datasets.
    """
    if block is None and "nuclide" in levels.columns:
        block = ["nuclide"]
    found = pairs.features(pairs.cross_dataset_pairs(levels, block, order=order, reach=reach), config)
    scored = scorer(found) if scorer else pairs.score(found, config=config)
    edges = scored.where(F.col("probability") > config.pair_threshold).select(
        "level_id_1", "level_id_2", "dataset_code_1", "dataset_code_2", "ds_rank_1", "level_index_1", "ds_rank_2", "level_index_2", "energy", "spin", "parity", "specificity", "gamma", "probability"
    )
    rank = F.struct("ds_rank_1", "level_index_1", "ds_rank_2", "level_index_2")
    edges = edges.withColumn("pair_rank", rank)
    named = edges.withColumnsRenamed({"level_id_1": "level_1_id", "level_id_2": "level_2_id"})
    seq = F.struct("dataset_code", "level_index")
    nodes = levels.select("dataset_code", "level_id", "energy_value", "energy_uncertainty", seq.alias("seq"))
    ranked = named.withColumn("pair_rank", F.concat_ws("/", *[F.lpad(F.col(c).cast("string"), 9, "0") for c in ("ds_rank_1", "level_index_1", "ds_rank_2", "level_index_2")]))
    flat = nodes.withColumn("seq", F.concat_ws("/", F.col("dataset_code"), F.lpad(F.col("seq.level_index").cast("string"), 9, "0")))
    return Match(ranked, cluster.greedy_clusters(flat, ranked.select("level_1_id", "level_2_id", "probability", "pair_rank"), config.merge_threshold))


def report_members(found: Match) -> DataFrame:
    """Cluster members with anchor and probability against it."""
    key = ["component", "n"]
    numbered = found.clusters.join(cluster.anchors(found.clusters, key), key)
    numbers = groups.numbered(numbered.select(*key, "mean_energy", "first_seq").distinct(), [], ["mean_energy", "first_seq", "component", "n"], "cluster_no")
    numbers = numbers.withColumn("cluster_no", F.col("cluster_no").cast("int"))
    edge = found.pairs.select(F.col("level_1_id").alias("a"), F.col("level_2_id").alias("b"), "probability")
    both = edge.unionByName(edge.select(F.col("b").alias("a"), F.col("a").alias("b"), "probability"))
    joined = numbered.join(numbers.select(*key, "cluster_no"), key)
    scored = joined.join(both, (F.col("level_id") == F.col("a")) & (F.col("anchor") == F.col("b")), "left")
    return scored.select("cluster_no", "dataset_code", "level_id", (F.col("level_id") == F.col("anchor")).alias("is_anchor"), F.col("probability").alias("match_probability"))


def consensus(members: DataFrame, levels: DataFrame) -> DataFrame:
    """Adopted scheme: weighted energy, anchor's spin-parity and sources."""
    joined = members.join(levels.select("level_id", "energy_value", "energy_uncertainty", "spin_parity_string"), "level_id")
    w = F.when(F.col("energy_uncertainty") > 0, 1 / (F.col("energy_uncertainty") * F.col("energy_uncertainty")))
    percent = F.when(F.col("is_anchor"), F.lit("100")).otherwise(F.round(F.coalesce("match_probability", F.lit(0.0)) * 100, 0).cast("int").cast("string"))
    source = F.struct((~F.col("is_anchor")).alias("later"), "dataset_code", F.concat("level_id", F.lit("("), percent, F.lit("%)")).alias("text"))
    return joined.groupBy("cluster_no").agg(
        F.round(F.coalesce(F.sum(w * F.col("energy_value")) / F.sum(w), F.avg("energy_value")), 1).alias("adopted_energy"),
        F.max(F.when(F.col("is_anchor"), F.col("spin_parity_string"))).alias("adopted_spin_parity"),
        F.concat_ws(" + ", F.transform(F.sort_array(F.collect_list(source)), lambda x: x["text"])).alias("sources"),
    )


def rescored(members: DataFrame, levels: DataFrame, config: MatchConfig = CONFIG, scorer=None) -> DataFrame:
    """Each member against its cluster's anchor, features in (member, anchor)
    order, with the probability; the anchor itself is left out.  ``members``:
    level_id, anchor; ``levels``: standard levels."""
    side = lambda k, name: levels.select(*[F.col(c).alias(name if c == "level_id" else f"{c}_{k}") for c in levels.columns])
    both = members.where("level_id <> anchor").select("level_id", "anchor").join(side(1, "level_id"), "level_id").join(side(2, "anchor"), "anchor")
    found = pairs.features(both, config)
    return scorer(found) if scorer else pairs.score(found, config=config)
