"""Scalar functions of record fields: tenants, lists, booleans, instants, defaults, weights."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Domains and weights of the record model.
CLASSIFICATIONS = ("public", "internal", "confidential", "restricted")
KINDS = ("source", "episodic", "semantic", "procedural", "profile", "generated", "working", "capability-contract")
EPISTEMICS = ("observed-fact", "user-stated", "imported-source", "inferred-belief", "model-generated", "hypothesis", "simulated", "approved-canonical")
TRUTH_WEIGHTS = {"source_observed": 1.00, "human_approved": 1.00, "generated_supported": 0.92, "generated_needs_review": 0.40, "inferred": 0.52}
TRUST_RANKS = {"hypothesis": 0, "simulated": 0, "inferred-belief": 1, "model-generated": 1, "user-stated": 2, "imported-source": 2, "observed-fact": 3, "approved-canonical": 99}
TYPE_WEIGHTS = {
    "default": {"source": 1.05, "episodic": 1.00, "semantic": 1.10, "procedural": 1.00, "profile": 0.95, "generated": 0.85, "working": 1.00},
    "customer_support": {"source": 1.10, "episodic": 1.05, "semantic": 1.22, "procedural": 1.08, "profile": 1.00, "generated": 0.85, "working": 1.00},
    "procedure": {"source": 1.00, "episodic": 0.92, "semantic": 1.05, "procedural": 1.38, "profile": 0.80, "generated": 0.82, "working": 0.95},
    "profile": {"source": 0.92, "episodic": 0.88, "semantic": 0.95, "procedural": 0.80, "profile": 1.45, "generated": 0.75, "working": 0.95},
    "temporal_state": {"source": 1.00, "episodic": 1.35, "semantic": 1.12, "procedural": 0.85, "profile": 0.85, "generated": 0.80, "working": 1.10},
    "policy": {"source": 1.20, "episodic": 0.88, "semantic": 1.08, "procedural": 1.15, "profile": 0.75, "generated": 0.78, "working": 0.95},
}


def lookup(values: dict, key: Column) -> Column:
    return F.create_map(*(F.lit(x) for kv in values.items() for x in kv))[key]


def classification_rank(name: Column) -> Column:
    """Place among the classes; null and unknown names rank above all of them, so nobody's clearance reaches them."""
    return F.coalesce(lookup({c: i for i, c in enumerate(CLASSIFICATIONS)}, name), F.lit(len(CLASSIFICATIONS)))


def trust_rank(epistemic: Column) -> Column:
    return lookup(TRUST_RANKS, epistemic)


def default_truth(epistemic: Column) -> Column:
    return (
        F.when(epistemic == "approved-canonical", "human_approved")
        .when(epistemic == "model-generated", "generated_supported")
        .when(epistemic.isin("inferred-belief", "hypothesis", "simulated"), "inferred")
        .otherwise("source_observed")
    )


def truth_status(status: Column, epistemic: Column) -> Column:
    """A known status, else the default of the epistemic class."""
    return F.when(status.isin(*TRUTH_WEIGHTS), status).otherwise(default_truth(epistemic))


def truth_weight(status: Column, epistemic: Column) -> Column:
    return lookup(TRUTH_WEIGHTS, truth_status(status, epistemic))


def type_weight(intent: str, kind: Column) -> Column:
    """Unknown intents weigh as default, unknown kinds 1."""
    return F.coalesce(lookup(TYPE_WEIGHTS.get(intent, TYPE_WEIGHTS["default"]), kind), F.lit(1.0))


def instant(value: Column) -> Column:
    """An ISO-8601 date or time as a timestamp (UTC where it names no zone); null where it is none. Bare years are none."""
    return F.when(value.rlike(r"^\d{4}-\d{2}-\d{2}"), F.try_to_timestamp(value))


def valid_at(valid_from: Column, valid_until: Column, at: Column) -> Column:
    """valid_from <= at < valid_until; a bound that is missing or no instant does not bind."""
    return F.coalesce(at >= instant(valid_from), F.lit(True)) & F.coalesce(at < instant(valid_until), F.lit(True))


def entity_bonus(entities: Column, wanted: list[str]) -> Column:
    """0.06 times the share of the wanted entities that the record names."""
    asked = sorted(set(wanted))
    if not asked:
        return F.lit(0.0)
    return F.lit(0.06) * F.size(F.array_intersect(F.coalesce(entities, F.array().cast("array<string>")), F.array(*map(F.lit, asked)))) / len(asked)


def recency(created_at: Column, at: Column) -> Column:
    """1 / (1 + age in days / 30) of an epoch in seconds."""
    return 1 / (1 + F.greatest((F.unix_micros(at) / 1e6 - created_at) / 86400.0, F.lit(0.0)) / 30.0)


def typed_score(base: Column, *, intent: str, entities: list[str], at: Column | None) -> Column:
    """Re-score of a record by type, truth, confidence (0 and null count as 1), entities, sources and age."""
    confidence = F.when(F.coalesce(F.col("confidence"), F.lit(0.0)) == 0, 1.0).otherwise(F.col("confidence"))
    sourced = (F.size(F.coalesce("source_ids", F.array())) > 0) & (F.size(F.coalesce("source_spans", F.array())) > 0)
    score = base * type_weight(intent, F.col("kind")) * truth_weight(F.col("truth_status"), F.col("epistemic")) * confidence
    score = score + entity_bonus(F.col("entities"), entities) + F.when(sourced, 0.035).otherwise(0.0)
    return score if at is None else score + 0.035 * recency(F.col("created_at"), at)


def tenant_name(value: Column, default: str = "tenant:default") -> Column:
    """As it is with a colon, else behind the prefix tenant:; the default where it is blank."""
    value = F.trim(F.coalesce(value, F.lit("")))
    return F.when(value == "", default).when(F.contains(value, F.lit(":")), value).otherwise(F.concat(F.lit("tenant:"), value))


def tenant_slug(value: Column, default: str = "tenant:default") -> Column:
    """What follows the first colon."""
    name = tenant_name(value, default)
    return F.substring(name, F.locate(":", name) + 1, F.length(name))


def list_value(value: Column) -> Column:
    """Comma-separated items, trimmed, without blanks."""
    return F.filter(F.transform(F.split(F.coalesce(value, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")


def bool_value(value: Column, default: bool = False) -> Column:
    v = F.coalesce(value, F.lit(""))
    return F.when(v == "", default).otherwise(F.lower(F.trim(v)).isin("1", "true", "yes", "on"))


def attr_pair(value: Column) -> Column:
    """Struct (k, v) of key=value or key:value; null of anything else."""
    mark = F.when(F.contains(value, F.lit("=")), "=").when(F.contains(value, F.lit(":")), ":")
    at = F.locate("=", value)
    at = F.when(mark == "=", at).otherwise(F.locate(":", value))
    return F.when(mark.isNotNull(), F.struct(F.trim(F.substring(value, F.lit(1), at - 1)).alias("k"), F.trim(F.substring(value, at + 1, F.length(value))).alias("v")))


def _given(fields: Column, *keys: str) -> Column:
    """The first of the fields that is neither null nor empty."""
    return F.coalesce(*(F.nullif(fields[k], F.lit("")) for k in keys))


def attr_pairs(value: Column) -> Column:
    """Pairs of a comma-separated list; an item that is none stands as null."""
    return F.transform(list_value(value), attr_pair)


def role_groups(value: Column) -> Column:
    """Groups of a JSON list of lists, else one group of comma-separated roles; empty groups go. Null where JSON is malformed."""
    nested = F.from_json(value, "array<array<string>>")
    nested = F.when(F.exists(nested, lambda g: g.isNull()), None).otherwise(F.filter(F.transform(nested, lambda g: F.filter(g, lambda r: F.trim(r) != "")), lambda g: F.size(g) > 0))
    one = list_value(value)
    return F.when(F.startswith(F.ltrim(value), F.lit("[")), nested).when(F.size(one) > 0, F.array(one)).otherwise(F.array().cast("array<array<string>>"))


def policy_from(fields: Column) -> Column:
    """Policy of a record's fields (a map of strings) as a struct; what is not given has its default."""
    return F.struct(
        F.coalesce(fields["visibility"], F.lit("tenant")).alias("visibility"), F.coalesce(fields["classification"], F.lit("internal")).alias("classification"), bool_value(fields["pii"]).alias("pii"), list_value(fields["roles"]).alias("roles"),
        attr_pairs(fields["attrs"]).alias("attrs"), F.coalesce(fields["retention"], F.lit("decayable")).alias("retention"), role_groups(fields["role_groups"]).alias("role_groups"),
    )


def principal_from(fields: Column, default_tenant: str = "tenant:default") -> Column:
    """Principal of a request's fields as a struct; a missing tenant is the default one, a missing clearance internal."""
    return F.struct(
        F.coalesce(_given(fields, "principal_id", "principal", "id"), F.lit("agent:recall")).alias("id"), tenant_name(fields["tenant"], default_tenant).alias("tenant"), list_value(fields["roles"]).alias("roles"),
        attr_pairs(fields["attrs"]).alias("attrs"), F.coalesce(fields["clearance"], F.lit("internal")).alias("clearance"),
    )


def source_from(fields: Column) -> Column:
    """Source (kind, uri, path) of a record's fields; null where none names one. `path` goes with a uri field alone."""
    kind = F.coalesce(_given(fields, "source_kind"), F.lit("bulk")).alias("kind")
    text = F.trim(F.coalesce(fields["source"], F.lit("")))
    first = F.when(F.map_contains_key(fields, "source_uri"), fields["source_uri"]).when(F.map_contains_key(fields, "source_id"), fields["source_id"]).otherwise(fields["uri"])
    own = F.struct(kind, text.alias("uri"), F.lit(None).cast("string").alias("path"))
    return F.when(text != "", own).when(F.coalesce(first, F.lit("")) != "", F.struct(kind, first.alias("uri"), _given(fields, "source_path", "path").alias("path")))


def mirror_family(source_ids: Column) -> Column:
    """Struct (key, rank) of the first markdown source among memory and team-memory, the former of rank 0; null without one."""
    pattern = r"(?i)^markdown://(memory|team-memory|team_memory)/(.+)$"
    first = F.get(F.filter(source_ids, lambda s: s.rlike(pattern)), F.lit(0))
    root = F.lower(F.regexp_extract(first, pattern, 1))
    return F.when(first.isNotNull(), F.struct(F.concat(F.lit("mirror:"), F.lower(F.regexp_extract(first, pattern, 2))).alias("key"), F.when(root == "memory", 0).otherwise(1).alias("rank")))


def record_errors() -> Column:
    """Why a record is not valid, in order; empty for a valid one."""
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    out = lambda c: ~F.coalesce(F.col(c).between(0, 1), F.lit(False))
    checks = (
        (blank("tenant") | blank("subject"), "tenant and subject are required"),
        (~F.coalesce(F.col("kind").isin(*KINDS), F.lit(False)), "kind"),
        (~F.coalesce(F.col("epistemic").isin(*EPISTEMICS), F.lit(False)), "epistemic"),
        (~F.coalesce(F.col("classification").isin(*CLASSIFICATIONS), F.lit(False)), "classification"),
        (~F.coalesce(F.col("visibility").isin("private", "tenant", "shared"), F.lit(False)), "visibility"),
        (out("confidence"), "confidence"),
        (out("salience"), "salience"),
        (~F.coalesce(F.col("content_hash") == F.concat(F.lit("sha256:"), F.sha2("content", 256)), F.lit(False)), "content_hash"),
    )
    return F.filter(F.array(*(F.when(c, F.lit(m)) for c, m in checks)), lambda x: x.isNotNull())


def write_refusal() -> Column:
    """Why a new record may not be written; null where it may."""
    contract = (F.col("kind") == "capability-contract") | (F.col("policy_scope") == "continuity-privileged")
    right = (F.col("kind") == "capability-contract") & (F.col("policy_scope") == "continuity-privileged") & ~F.col("indexed")
    return F.when(F.col("epistemic") == "approved-canonical", "approved-canonical requires approval").when(contract & ~right, "contracts must be privileged and unindexed")


# Names of files that hint at secrets.
SECRET_HINTS = ("password", "secret", "api_key", "apikey", "token", "credential", "private_key")


def secret_hint(path: Column) -> Column:
    return F.lower(path).rlike("|".join(SECRET_HINTS))


def _stem(path: Column) -> Column:
    return F.lower(F.regexp_replace(F.substring_index(path, "/", -1), r"\.[^.]+$", ""))


def inferred_kind(path: Column) -> Column:
    return F.when(_stem(path).startswith("reference_"), "source").otherwise("semantic")


def inferred_epistemic(path: Column) -> Column:
    """By the conventions of file names; the first that fits."""
    s = _stem(path)
    return (
        F.when(s.startswith("feedback_"), "user-stated").when(s.startswith("reference_"), "imported-source").when(F.contains(s, F.lit("hypothesis")), "hypothesis")
        .when(F.contains(s, F.lit("inferred")) | F.contains(s, F.lit("belief")), "inferred-belief").when(s.startswith("project_"), "observed-fact").otherwise("imported-source")
    )


def stable_id(tenant: Column, path: Column, content_hash: Column) -> Column:
    """md_, a slug of the file name and a digest of tenant, path and content."""
    from .text import slug

    name = F.concat(tenant, F.lit("|"), path, F.lit("|"), content_hash)
    return F.concat(F.lit("md_"), slug(_stem(path)), F.lit("_"), F.left(F.sha2(name, 256), F.lit(16)))


def trimmed_distinct(items: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(items, lambda x: F.trim(x)), lambda x: x != ""))


def metadata_error(valid_from: Column, valid_until: Column, now: Column) -> Column:
    """Why a validity window may not be set: a bound that is no instant, a start in the future, an end before the start."""
    no = lambda c: c.isNotNull() & instant(c).isNull()
    return (
        F.when(no(valid_from), "valid_from").when(no(valid_until), "valid_until").when(instant(valid_from) > now, "valid_from is in the future")
        .when(instant(valid_until) < instant(valid_from), "valid_until is before valid_from")
    )


def utc_text(value: Column) -> Column:
    """An instant as ISO-8601 text in UTC; null if it is none."""
    return F.date_format(instant(value), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def matches_marker(marker: str) -> Column:
    """Whether a record is the one meant: equal to its id, subject, uri or path, or among its source or subject ids."""
    return F.coalesce(
        (F.col("id") == marker) | (F.col("subject") == marker) | (F.col("uri") == marker) | (F.col("path") == marker) | F.array_contains("source_ids", marker) | F.array_contains("subject_ids", marker), F.lit(False)
    )
