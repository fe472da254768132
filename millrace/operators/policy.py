"""Access rules and filters over records: Columns that reach the scan before anything is scored."""

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import values

# Review states and their legal moves.
TRANSITIONS = {
    "proposed": ("accepted", "rejected", "disputed", "superseded"),
    "accepted": ("superseded", "disputed"),
    "rejected": ("disputed",),
    "disputed": ("accepted", "rejected", "superseded"),
    "superseded": (),
}
HIDDEN = ("rejected", "disputed", "superseded")
REVIEWERS = ("reviewer", "approver")


@dataclass(frozen=True)
class Principal:
    id: str
    tenant: str
    roles: tuple[str, ...] = ()
    attrs: dict[str, str] = field(default_factory=dict)
    clearance: str = "internal"


def _strings(items: Iterable[str]) -> Column:
    return F.array(*map(F.lit, items)).cast("array<string>")


def _gates() -> Column:
    """Role gates of a record: its roles and role groups without empty ones; a null group stays, as a gate that nobody passes."""
    groups = F.coalesce("role_groups", F.array().cast("array<array<string>>"))
    return F.filter(F.concat(F.array(F.coalesce("roles", F.array().cast("array<string>"))), groups), lambda g: g.isNull() | (F.size(g) > 0))


def deny_reason(who: Principal) -> Column:
    """The first rule that denies a record to the principal; ok if none does.

    What is not known denies: a null tenant, a null or unknown class or visibility, a null role gate, an attribute without name or value.
    """
    own = _strings(who.roles)
    denies = lambda c: F.coalesce(c, F.lit(True))
    held = F.create_map(*(F.lit(x) for kv in who.attrs.items() for x in kv)) if who.attrs else F.create_map().cast("map<string,string>")
    lacking = F.filter(F.coalesce("attrs", F.array().cast("array<struct<k:string,v:string>>")), lambda a: denies(held[a["k"]] != a["v"]))
    return (
        F.when(denies(F.col("tenant") != who.tenant), "cross-tenant")
        .when(values.classification_rank(F.col("classification")) > values.CLASSIFICATIONS.index(who.clearance), "classification>clearance")
        .when(~F.forall(_gates(), lambda g: F.coalesce(F.arrays_overlap(g, own), F.lit(False))), "role")
        .when(F.size(lacking) > 0, F.concat(F.lit("attr:"), F.coalesce(F.get(lacking, F.lit(0))["k"], F.lit(""))))
        .when(~F.coalesce(F.col("visibility").isin("tenant", "shared"), F.lit(False)) & denies(F.col("created_by") != who.id), "private")
        .otherwise("ok")
    )


def visible(records: DataFrame, who: Principal) -> DataFrame:
    return records.where((F.col("tenant") == who.tenant) & (deny_reason(who) == "ok"))


def review_shown(include: Iterable[str] = (), hide: Iterable[str] = ()) -> Column:
    hidden = sorted((set(HIDDEN) | set(hide)) - set(include))
    return F.coalesce(~F.col("review_state").isin(*hidden), F.lit(True))


def predicates(filters: dict, at: Column) -> dict[str, Column]:
    """The conjuncts of a filter, by name. An empty `kinds` passes nothing; other empty lists pass everything."""
    subject_ids = F.coalesce("subject_ids", F.array("subject"))
    both = lambda *names: sorted({x for n in names for x in filters.get(n) or ()})
    denied = both("denied_subjects", "denied_subject_ids")
    kinds = both("memory_types", "allowed_memory_types")
    one_of = lambda name, column: F.col(column).isin(*both(name, f"allowed_{name}")) if both(name, f"allowed_{name}") else F.lit(True)
    return {
        "review": review_shown(filters.get("include_review_states", ()), (*filters.get("hide_review_states", ()), *(["proposed"] if filters.get("hide_proposed") else []))),
        "kinds": (F.col("kind").isin(*filters["kinds"]) if filters["kinds"] else F.lit(False)) if "kinds" in filters else F.lit(True),
        "types": F.col("kind").isin(*kinds) if kinds else F.lit(True),
        "epistemics": one_of("epistemics", "epistemic"),
        "scopes": one_of("policy_scopes", "policy_scope"),
        "auxiliary": F.lit(True) if filters.get("include_contextual_aux") else F.coalesce(F.col("policy_scope") != "contextual-aux", F.lit(True)),
        "classifications": F.col("classification").isin(*filters["allowed_classifications"]) if filters.get("allowed_classifications") else F.lit(True),
        "subjects": ~(F.col("subject").isin(*denied) | F.arrays_overlap(subject_ids, _strings(denied))) if denied else F.lit(True),
        "valid": F.lit(True) if filters.get("include_expired") else values.valid_at(F.col("valid_from"), F.col("valid_until"), at),
        "subject": F.col("subject") == filters["subject"] if "subject" in filters else F.lit(True),
        "indexed": F.coalesce("indexed", F.lit(False)),
    }


def matching(records: DataFrame, filters: dict, at: Column) -> DataFrame:
    for condition in predicates(filters, at).values():
        records = records.where(condition)
    return records


#: Names under which a service request may give a filter, and the filter's own.
REQUEST_LISTS = {"kind": "kinds", "kinds": "kinds", "memory_types": "memory_types", "policy_scopes": "policy_scopes", "allowed_classifications": "allowed_classifications", "denied_subjects": "denied_subjects", "entities": "entities"}
REQUEST_VALUES = ("subject", "method", "intent", "effective_at")


def merged_filters(filters: dict, request: dict, k: int = 8, topc: int = 50) -> tuple[dict, int, int]:
    """Filters with what a request gives beside them: lists (or comma-separated text) are united, single values replaced; k and topc within 50 and 200."""
    items = lambda v: [x.strip() for x in v.split(",") if x.strip()] if isinstance(v, str) else list(v or ())
    out = dict(filters)
    for name in REQUEST_VALUES:
        if request.get(name) not in (None, ""):
            out[name] = request[name]
    for name, own in REQUEST_LISTS.items():
        if request.get(name) not in (None, ""):
            out[own] = list(dict.fromkeys([*items(out.get(own)), *items(request[name])]))
    k = max(1, min(50, k))
    return out, k, max(k, min(200, topc))


def normal_review_state(state: Column) -> Column:
    """A struct (state, error): blank is none, what is no state is an error."""
    known = F.nullif(state, F.lit(""))
    odd = known.isNotNull() & ~known.isin(*TRANSITIONS)
    return F.struct(F.when(~odd, known).alias("state"), F.when(odd, F.concat(F.lit("no review state: "), known)).alias("error"))


def inherited(records: DataFrame, edges: DataFrame) -> DataFrame:
    """id, classification, pii and role_groups of every child: the strictest of its own and its parents', all role gates in conjunction.

    A null or unknown class of any of them leaves the child without a class, which denies it to everyone; a null
    pii counts as true. Parents that are not among the records do not count.
    """
    gates = F.transform(_gates(), lambda g: F.array_sort(F.array_distinct(g)))
    own = records.select("id", values.classification_rank(F.col("classification")).alias("rank"), F.coalesce("pii", F.lit(True)).alias("pii"), gates.alias("gates"))
    pairs = edges.select(F.col("child").alias("top"), F.col("parent").alias("id")).distinct()
    pairs = pairs.unionByName(pairs.select("top", F.col("top").alias("id")).distinct())
    by = pairs.join(own, "id").groupBy("top").agg(F.max("rank").alias("rank"), F.bool_or("pii").alias("pii"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("gates")))).alias("role_groups"))
    return by.select(F.col("top").alias("id"), F.get(_strings(values.CLASSIFICATIONS), F.col("rank")).alias("classification"), "pii", "role_groups")


def move_refusal(state: Column, target: Column, roles: Iterable[str]) -> Column:
    """Why a review state may not move to the target; null where it may."""
    legal = values.lookup({f"{a}>{b}": True for a, to in TRANSITIONS.items() for b in to}, F.concat_ws(">", state, target))
    return (
        F.when(F.coalesce(target, F.lit("")) == "", "target is required")
        .when(F.lit(not set(roles) & set(REVIEWERS)), "role is required")
        .when(F.coalesce(state, F.lit("")) == "", "not in the workflow")
        .when(~F.coalesce(legal, F.lit(False)), "illegal transition")
    )


def set_where(records: DataFrame, column: str, expected: Column, new: Column, chosen: Column) -> DataFrame:
    """Compare and set, null-safe: the column of chosen rows changes where it still has the expected value."""
    hit = chosen & F.col(column).eqNullSafe(expected)
    return records.withColumn("changed", F.coalesce(hit, F.lit(False))).withColumn(column, F.when(F.col("changed"), new).otherwise(F.col(column)))


def approved(records: DataFrame, chosen: Column, roles: Iterable[str]) -> DataFrame:
    """Chosen records become approved-canonical where an approver may: none that is still, or no longer, in review."""
    may = chosen & F.lit("approver" in set(roles)) & F.coalesce(~F.col("review_state").isin("proposed", "rejected", "disputed", "superseded"), F.lit(True))
    return records.withColumn("changed", F.coalesce(may, F.lit(False))).withColumn("epistemic", F.when(F.col("changed"), "approved-canonical").otherwise(F.col("epistemic"))).withColumn("truth_status", F.when(F.col("changed"), "human_approved").otherwise(F.col("truth_status")))
