"""Gates on text that leaves or enters: model egress decisions and claim support."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

# Decisions.
ALLOWED, REDACTED, LOCAL, REVIEW, DENIED = "external_model_allowed", "external_model_allowed_with_redaction", "local_model_only", "human_approval_required", "denied"
CLAIM_LABELS = ("supported", "partially_supported", "unsupported", "contradicted", "not_checkable")


def _list(c: Column) -> Column:
    return F.coalesce(c, F.array().cast("array<string>"))


def matched_provider(model: Column, providers: Column) -> Column:
    """The first registry entry that agrees with the model's fields and, if it names one, its policy id."""
    same = lambda p, f: model[f].isNull() | p[f].eqNullSafe(model[f])
    fits = F.filter(
        F.coalesce(providers, F.array()),
        lambda p: same(p, "provider") & same(p, "runtime") & same(p, "region") & same(p, "retention") & same(p, "training_opt_out") & same(p, "endpoint") & (F.coalesce(model["provider_policy_id"], F.lit("")).isin("") | p["provider_policy_id"].eqNullSafe(model["provider_policy_id"])),
    )
    return F.get(fits, F.lit(0))


def egress(requests: DataFrame) -> DataFrame:
    """Decides each request: columns model, policy, providers (null: no registry), spans (span_id, classification, pii_labels, text).

    Adds decision, reason, pii_labels, classifications, payload, leaks, unsafe_external. The first rule that fits decides.
    """
    m, p = F.col("model"), F.col("policy")
    spans = F.coalesce("spans", F.array())
    out = requests.withColumn("provider_policy", matched_provider(m, F.col("providers"))).withColumn("pii_labels", F.array_sort(F.array_distinct(F.flatten(F.transform(spans, lambda s: _list(s["pii_labels"]))))))
    out = out.withColumn("classifications", F.array_sort(F.array_distinct(F.transform(spans, lambda s: F.coalesce(s["classification"], F.lit("internal"))))))
    labels, classes, entry = F.col("pii_labels"), F.col("classifications"), F.col("provider_policy")
    meets = lambda a, b: F.arrays_overlap(a, _list(b))
    within = lambda a, b: F.size(F.array_except(a, _list(b))) == 0
    no = lambda c: ~F.coalesce(c, F.lit(False))
    registry = F.size(F.coalesce("providers", F.array())) > 0
    rules = (
        (m["runtime"].eqNullSafe("local"), LOCAL, "model runtime is local"),
        (no(p["allow_external_models"]), LOCAL, "tenant policy disables external models"),
        (registry & entry.isNull(), DENIED, "no matching provider registry entry"),
        (entry.isNotNull() & ~entry["status"].eqNullSafe("approved"), DENIED, "provider registry entry is not approved"),
        (no(F.array_contains(_list(p["allowed_providers"]), m["provider"])), DENIED, "model provider is not allowed"),
        (no(F.array_contains(_list(p["allowed_regions"]), m["region"])), DENIED, "model region is not allowed"),
        (F.coalesce(p["require_zero_retention"], F.lit(False)) & ~m["retention"].eqNullSafe("zero"), DENIED, "zero retention is required"),
        (no(m["training_opt_out"]), DENIED, "model does not opt out of training"),
        (entry.isNotNull() & ~within(classes, entry["allowed_classifications"]), DENIED, "registry disallows a classification"),
        (entry.isNotNull() & meets(labels, entry["denied_pii_labels"]), DENIED, "registry denies a PII label"),
        (meets(classes, p["deny_classifications"]), DENIED, "classification is denied"),
        (meets(labels, p["deny_pii_labels"]), DENIED, "PII label is denied"),
        (meets(classes, p["human_review_classifications"]), REVIEW, "classification needs approval"),
        ((F.size(labels) > 0) & F.coalesce(p["allow_redaction"], F.lit(False)) & within(labels, p["redactable_pii_labels"]), REDACTED, "redaction is required"),
        (F.size(labels) > 0, REVIEW, "PII cannot be redacted automatically"),
    )
    decision, reason = F, F
    for condition, result, why in rules:
        decision, reason = decision.when(condition, result), reason.when(condition, why)
    out = out.withColumn("first", decision.otherwise(ALLOWED)).withColumn("reason", reason.otherwise("allowed by tenant and model policy"))
    sent = F.transform(spans, lambda s: F.struct(s["span_id"].alias("span_id"), F.coalesce(s["classification"], F.lit("internal")).alias("classification"), F.when(F.col("first") == REDACTED, T.redact(F.coalesce(s["text"], F.lit("")), _list(s["pii_labels"]))).otherwise(F.coalesce(s["text"], F.lit(""))).alias("text")))
    out = out.withColumn("payload", F.when(F.col("first").isin(ALLOWED, REDACTED), sent))
    leaks = F.array_sort(F.array_distinct(F.flatten(F.transform(F.coalesce("payload", F.array()), lambda s: T.detected_pii(s["text"])))))
    out = out.withColumn("leaks", leaks).withColumn("leaked", (F.col("first") == REDACTED) & (F.size("leaks") > 0))
    out = out.withColumn("decision", F.when(F.col("leaked"), DENIED).otherwise(F.col("first"))).withColumn("reason", F.when(F.col("leaked"), "redacted payload still shows PII").otherwise(F.col("reason")))
    out = out.withColumn("payload", F.when(F.col("leaked"), None).otherwise(F.col("payload")))
    unsafe = (F.col("decision") == ALLOWED) & ((F.size(labels) > 0) | meets(classes, p["deny_classifications"]) | meets(classes, p["human_review_classifications"]))
    return out.withColumn("unsafe_external", F.coalesce(unsafe, F.lit(False))).drop("first", "leaked", "provider_policy")


def generation_allowed(decision: Column, allow_review: bool = False) -> Column:
    return decision.isin(ALLOWED, REDACTED, LOCAL, *([REVIEW] if allow_review else []))


def egress_summary(decided: DataFrame) -> DataFrame:
    return decided.agg(*(F.count_if(F.col("decision") == d).alias(d) for d in (ALLOWED, REDACTED, LOCAL, REVIEW, DENIED)))


def source_text(cited: Column, spans: Column) -> Column:
    """Texts of the cited spans, in the order cited, joined by spaces; unknown ids are skipped."""
    texts = F.transform(cited, lambda i: F.get(F.filter(spans, lambda s: s["span_id"] == i), F.lit(0))["text"])
    return F.array_join(F.filter(texts, lambda t: t.isNotNull()), " ")


def check_claims(claims: DataFrame) -> DataFrame:
    """Adds support_score, missing_anchors and label to rows of claim text, support text and `cited` (whether it cites anything)."""
    support = F.coalesce("support", F.lit(""))
    # each text is normalised once; later steps read the columns
    out = claims.withColumns({"_c": T.flat(F.col("claim")), "_s": T.flat(support), "_x": T.claim_tokens(F.col("claim")), "_y": T.claim_tokens(support)})
    out = out.withColumns({"support_score": T.token_support(F.col("_x"), F.col("_y")), "_m": F.filter(T.flat_anchors(F.col("_c")), lambda a: ~F.contains(F.col("_s"), a))})
    out = out.withColumn("label", T.label_of(F.col("_c"), F.col("_s"), F.col("_m"), F.col("support_score"), F.col("cited") & (support != "")))
    quiet = F.col("label").isin("not_checkable", "contradicted")
    return out.withColumn("missing_anchors", F.when(quiet, F.array().cast("array<string>")).otherwise(F.col("_m"))).drop("_c", "_s", "_x", "_y", "_m")


def claim_labels(claims: Column, support: str = "support") -> Callable[[DataFrame], DataFrame]:
    """Adds `labels` to rows of one text and many claims on it (an array): the label of each claim, in order, as check_claims gives it for a cited one.

    The text is normalised once for all its claims, and stands in one row.
    """

    def add(rows: DataFrame) -> DataFrame:
        text = F.coalesce(support, F.lit(""))
        out = rows.withColumns({"_s": T.flat(text), "_y": T.claim_tokens(text), "_c": F.transform(claims, lambda c: F.struct(T.flat(c).alias("flat"), T.claim_tokens(c).alias("tokens")))})

        def label(c: Column) -> Column:
            missing = F.filter(T.flat_anchors(c["flat"]), lambda a: ~F.contains(F.col("_s"), a))
            return T.label_of(c["flat"], F.col("_s"), missing, T.token_support(c["tokens"], F.col("_y")), F.col("_s") != "")

        return out.withColumn("labels", F.transform("_c", label)).drop("_s", "_y", "_c")

    return add


def decide(checked: DataFrame) -> DataFrame:
    """One row for each candidate: accepted, needs_human_review or rejected, by its material claims; accepted without any."""
    has = lambda *labels: F.coalesce(F.bool_or(F.col("material") & F.col("label").isin(*labels)), F.lit(False))
    decision = F.when(has("contradicted", "unsupported"), "rejected").when(has("partially_supported", "not_checkable"), "needs_human_review").otherwise("accepted")
    return checked.groupBy("candidate_id").agg(decision.alias("decision"), F.count("*").alias("claim_count"), *(F.count_if(F.col("label") == x).alias(f"claims_{x}") for x in CLAIM_LABELS))
