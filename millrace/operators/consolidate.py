"""Clusters of equal and near records, and which of them may be merged."""

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import values as V
from . import gates

MIN_CLUSTER, STALE_DAYS = 3, 90.0
#: Vectors in the memory of a task at once.
BLOCK = 8_192
#: Rows held against them at once.
ROWS = 256
# States that a merge must not touch.
LOCKED_EPISTEMIC = ("approved-canonical",)
LOCKED_TRUTH = ("human_approved",)
LOCKED_REVIEW = ("rejected", "disputed", "superseded")


def exact_clusters(records: DataFrame, least: int = MIN_CLUSTER) -> DataFrame:
    """Records of one tenant and subject with equal content: ids in order, reason, key, score 1."""
    by = records.where("content_hash is not null").groupBy("tenant", "subject", "content_hash").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("id")).alias("ids"))
    return by.where(F.col("n") >= least).select("tenant", "subject", F.lit("content_hash").alias("reason"), F.col("content_hash").alias("key"), "ids", F.lit(1.0).alias("score"))


def near_pairs(vectors: DataFrame, threshold: float, block: str | None = None) -> DataFrame:
    """(id, other, sim) of all pairs (with a block: of equal, non-null values of that column) with dot product >= threshold, and each row with itself.

    All rows are held against BLOCK rows at a time, a bounded matrix in the tasks' memory: only near pairs
    are ever made, and no vector is shuffled.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("id"), (F.col(block).cast("string") if block else F.lit("")).alias("block"), F.col("embedding").cast("array<double>").alias("v")).where("id IS NOT NULL AND block IS NOT NULL AND size(v) > 0")
    passes, out = max(1, -(-rows.count() // BLOCK)), None
    for n in range(passes):
        own = rows.where(F.pmod(F.xxhash64("id"), F.lit(passes)) == n).collect()
        part = rows.mapInPandas(_near([(r["id"], r["block"], r["v"]) for r in own], threshold), "id long, other long, sim double")
        out = part if out is None else out.unionByName(part)
    return out


def _near(own: list[tuple[int, str, list[float]]], threshold: float):
    by: dict[tuple[str, int], list] = {}
    for i, b, v in own:
        by.setdefault((b, len(v)), []).append((i, v))
    kept = {k: (np.array([i for i, _ in x]), np.array([v for _, v in x])) for k, x in by.items()}

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for key, rows in part.groupby([part["block"], part["v"].map(len)]):
                if key not in kept:
                    continue
                ids, matrix = kept[key]
                for a in range(0, len(rows), ROWS):
                    others = rows["id"].to_numpy()[a : a + ROWS]
                    sims = np.round(matrix @ np.stack(rows["v"].to_numpy()[a : a + ROWS]).T, 9)
                    p, q = np.nonzero((sims >= threshold) | (ids[:, None] == others[None, :]))
                    yield pd.DataFrame({"id": ids[p], "other": others[q], "sim": sims[p, q]})

    return run


def near_neighbourhoods(vectors: DataFrame, threshold: float, least: int = MIN_CLUSTER, block: str | None = None) -> DataFrame:
    """Star-shaped sets: a vector and all (with a block: all of its block) with dot product >= threshold; equal sets once, under their smallest id."""
    pairs = near_pairs(vectors, threshold, block)
    stars = pairs.groupBy("id").agg(F.array_sort(F.collect_list("other")).alias("ids"), F.min("sim").alias("score")).where(F.size("ids") >= least)
    return stars.groupBy("ids").agg(F.min("id").alias("key"), F.min_by("score", "id").alias("score"))


def currently_valid(now: Column) -> Column:
    """Within its window; a bound that is no instant closes it."""
    bad = lambda c: (F.coalesce(F.col(c), F.lit("")) != "") & V.instant(F.col(c)).isNull()
    return ~bad("valid_from") & ~bad("valid_until") & V.valid_at(F.col("valid_from"), F.col("valid_until"), now)


def may_merge(now: Column) -> Column:
    no = lambda c, *v: ~F.coalesce(F.col(c).isin(*v), F.lit(False))
    accepted = F.coalesce(F.col("review_state") == "accepted", F.lit(False))
    age = F.greatest((F.unix_micros(now) / 1e6 - F.coalesce("created_at", F.unix_micros(now) / 1e6)) / 86400.0, F.lit(0.0))
    return (
        no("retention", "pinned") & currently_valid(now) & no("epistemic", *LOCKED_EPISTEMIC) & no("truth_status", *LOCKED_TRUTH) & no("review_state", *LOCKED_REVIEW)
        & (no("epistemic", "model-generated") | accepted) & ~F.coalesce("pii", F.lit(False)) & (age >= STALE_DAYS)
    )


def safe_clusters(members: DataFrame, now: Column, least: int = MIN_CLUSTER) -> DataFrame:
    """Whether each cluster (cluster_id and record columns) may be merged: one tenant, subject and policy, no locked member, all may merge."""
    groups = F.to_json(F.struct("classification", F.array_sort("roles").alias("r"), F.array_sort(F.transform(F.coalesce("role_groups", F.array().cast("array<array<string>>")), lambda g: F.array_sort(g))).alias("g")))
    locked = F.coalesce(F.col("retention") == "pinned", F.lit(False)) | F.coalesce(F.col("epistemic").isin(*LOCKED_EPISTEMIC), F.lit(False)) | F.coalesce(F.col("truth_status").isin(*LOCKED_TRUTH), F.lit(False))
    by = members.groupBy("cluster_id").agg(
        F.count("*").alias("n"), F.count_distinct("tenant").alias("tenants"), F.count_distinct("subject").alias("subjects"), F.count_distinct(groups).alias("policies"),
        F.bool_or(locked).alias("locked"), F.bool_and(may_merge(now)).alias("mergeable"),
    )
    safe = (F.col("n") >= least) & (F.col("tenants") == 1) & (F.col("subjects") == 1) & (F.col("policies") == 1) & ~F.col("locked") & F.col("mergeable")
    return by.withColumn("safe", safe)


def proposals(members: DataFrame, generate: Callable[[DataFrame], DataFrame], now: Column, least: int = MIN_CLUSTER, model: Column | None = None, rules: Column | None = None) -> DataFrame:
    """A merged summary for each cluster (cluster_id and record columns with content): outcome, why not, and the record to be written.

    `generate` maps cluster_id, tenant, subject, texts (the distinct texts of the members, in order of their first id) to cluster_id,
    summary and claims (null: the summary is the claim). Nothing is generated of a cluster that is not safe (`unsafe`), has a member
    without text (`unavailable`) or whose texts the model may not see (`egress`; without model and rules the model is a local one).
    An empty summary is `empty`; one whose claims the texts contradict or do not support is `rejected`; all else is `proposed`, and
    waits for review. The texts of a cluster are gathered in one row, copies once.
    """
    none = F.array().cast("array<string>")
    local = F.struct(*(F.lit(v).alias(k) for k, v in (("runtime", "local"), ("provider", "local"), ("region", "local"), ("retention", "none"), ("training_opt_out", True), ("endpoint", None), ("provider_policy_id", None))))
    closed = F.struct(
        F.lit(False).alias("allow_external_models"), F.lit(False).alias("require_zero_retention"), F.lit(False).alias("allow_redaction"),
        *(none.alias(k) for k in ("allowed_providers", "allowed_regions", "redactable_pii_labels", "deny_pii_labels", "deny_classifications", "human_review_classifications")),
    )
    entry = "array<struct<provider_policy_id:string,provider:string,runtime:string,region:string,retention:string,training_opt_out:boolean,endpoint:string,status:string,allowed_classifications:array<string>,denied_pii_labels:array<string>>>"
    safe = safe_clusters(members, now, least).select("cluster_id", "safe")
    copies = members.groupBy("cluster_id", "content").agg(F.min("id").alias("_first"), F.min("tenant").alias("tenant"), F.min("subject").alias("subject"), F.min("classification").alias("classification"))
    by = copies.groupBy("cluster_id").agg(
        F.min("tenant").alias("tenant"), F.min("subject").alias("subject"), F.min("classification").alias("classification"), F.bool_or(F.col("content").isNull()).alias("_gone"),
        F.transform(F.array_sort(F.collect_list(F.struct("_first", "content"))), lambda s: s["content"]).alias("texts"),
    )
    span = F.struct(F.col("cluster_id").alias("span_id"), F.col("classification"), none.alias("pii_labels"), F.array_join("texts", " ").alias("text"))
    ready = by.join(safe, "cluster_id").withColumn("_stop", F.when(~F.col("safe"), "unsafe").when(F.col("_gone"), "unavailable"))
    asked = gates.egress(ready.withColumns({"model": local if model is None else model, "policy": closed if rules is None else rules, "providers": F.array().cast(entry), "spans": F.array(span)}))
    asked = asked.withColumn("_stop", F.coalesce("_stop", F.when(~gates.generation_allowed(F.col("decision")), "egress"))).select("cluster_id", "tenant", "subject", "classification", "texts", "decision", "_stop")
    made = generate(asked.where("_stop IS NULL").select("cluster_id", "tenant", "subject", "texts")).select("cluster_id", F.trim("summary").alias("summary"), F.col("claims").cast("array<string>").alias("claims"))
    rows = asked.join(made, "cluster_id", "left").withColumn("_stop", F.coalesce("_stop", F.when(F.coalesce("summary", F.lit("")) == "", "empty")))
    told = rows.where("_stop IS NULL").select(F.col("cluster_id").alias("candidate_id"), F.array_join("texts", " ").alias("support"), F.explode(F.coalesce("claims", F.array("summary"))).alias("claim"), F.lit(True).alias("cited"), F.lit(True).alias("material"))
    decided = gates.decide(gates.check_claims(told)).select(F.col("candidate_id").alias("cluster_id"), F.col("decision").alias("faithfulness"))
    out = rows.join(decided, "cluster_id", "left").withColumn("faithfulness", F.when(F.col("_stop").isNull(), F.coalesce("faithfulness", F.lit("accepted"))))
    outcome = F.coalesce("_stop", F.when(F.col("faithfulness") == "rejected", "rejected").otherwise("proposed"))
    proposed = outcome == "proposed"
    content_hash = F.when(proposed, T.content_hash(F.col("summary")))
    return out.select(
        "cluster_id", "tenant", "subject", "classification", outcome.alias("outcome"), F.col("decision").alias("egress"), "faithfulness", F.when(proposed, F.col("summary")).alias("content"), content_hash.alias("content_hash"),
        F.when(proposed, F.concat(F.lit("sum_"), F.left(F.sha2(F.concat_ws("|", "tenant", "subject", F.col("cluster_id").cast("string"), content_hash), 256), F.lit(24)))).alias("id"),
        F.when(proposed, "model-generated").alias("epistemic"), F.when(proposed, "proposed").alias("review_state"),
        F.when(proposed, F.when(F.col("faithfulness") == "accepted", "generated_supported").otherwise("generated_needs_review")).alias("truth_status"),
    )


def proposal_edges(proposed: DataFrame, members: DataFrame) -> DataFrame:
    """Edges (child, parent, kind) from each proposed summary to all members of its cluster."""
    return proposed.where("outcome = 'proposed'").select("cluster_id", F.col("id").alias("child")).join(members.select("cluster_id", F.col("id").alias("parent")), "cluster_id").select("child", "parent", F.lit("derived_from").alias("kind"))
