"""The engine's verbs as tools of an agent: a closed list, by name and JSON arguments, for callers known by their token."""

import hashlib
import hmac
import json
from collections.abc import Callable, Iterable

from pyspark.sql import functions as F

from .engine import Engine
from .operators import contracts, gates
from .operators.policy import Principal

#: What a caller may not say of itself: it is who its token says.
CLAIMED = ("principal", "tenant", "tenant_id", "roles", "clearance", "attrs", "created_by", "producer", "actor")
TOOLS = ("remember", "recall", "explain_recall", "forget", "evaluate_egress", "assess_faithfulness", "health")
#: Most results of a recall and most records of a call.
MOST_RESULTS, MOST_RECORDS = 50, 10_000


class Credentials:
    """Principals by bearer token; only hashes of the tokens are held."""

    def __init__(self, known: dict[str, Principal]):
        self._known = [(hashlib.sha256(token.encode()).digest(), who) for token, who in known.items()]

    def principal(self, token: str | None) -> Principal:
        """Whose token it is; all are compared, so the time does not tell which."""
        own = hashlib.sha256((token or "").encode()).digest()
        found = [who for digest, who in self._known if hmac.compare_digest(digest, own)]
        if not token or not found:
            raise PermissionError("unknown token")
        return found[0]


class Tools:
    """Calls by name. What is not on the list, or not allowed here, is refused before anything is read; without `allowed` nothing is."""

    def __init__(self, engine: Engine, credentials: Credentials, allowed: Iterable[str] = ()):
        self.engine, self.credentials = engine, credentials
        self.allowed = frozenset(allowed)
        if unknown := self.allowed - set(TOOLS):
            raise ValueError("no such tools: " + ", ".join(sorted(unknown)))

    def call(self, name: str, arguments: str | dict, token: str | None) -> dict:
        """{ok, result} or {ok, error}: a category of errors, never a message, as that may tell what a caller must not know."""
        try:
            if name not in self.allowed:
                raise PermissionError(name)
            who = self.credentials.principal(token)
            given = json.loads(arguments) if isinstance(arguments, str) else arguments
            if not isinstance(given, dict) or any(k in given for k in CLAIMED):
                raise ValueError("arguments")
            step: Callable[..., dict] = getattr(self, f"_{name}")
            return {"ok": True, "result": step(who, **given)}
        except TypeError:
            return {"ok": False, "error": "invalid_response"}
        except Exception as e:
            return {"ok": False, "error": contracts.error_category(e)}

    def _remember(self, who: Principal, records: list[dict]) -> dict:
        if not isinstance(records, list) or not 0 < len(records) <= MOST_RECORDS or any(not isinstance(r, dict) or any(k in r for k in CLAIMED) for r in records):
            raise ValueError("records")
        rows = [({k: v if isinstance(v, str) else json.dumps(v) for k, v in r.items() if v is not None},) for r in records]
        return self.engine.remember_many(self.engine.spark.createDataFrame(rows, "fields map<string,string>"), who)

    def _recall(self, who: Principal, query: str, filters: dict | None = None, k: int = 8, method: str = "hybrid") -> dict:
        rows = self.engine.recall(query, who, filters, max(1, min(int(k), MOST_RESULTS)), method=method).orderBy("rank")
        return {"results": [r.asDict(recursive=True) for r in rows.collect()]}

    def _explain_recall(self, who: Principal, query: str, filters: dict | None = None) -> dict:
        return self.engine.explain(query, who, filters)

    def _forget(self, who: Principal, subject: str) -> dict:
        if not isinstance(subject, str) or not subject:
            raise ValueError("subject")
        return self.engine.forget(subject, who)

    def _evaluate_egress(self, who: Principal, request: dict) -> dict:
        schema = (
            "model struct<runtime:string,provider:string,region:string,retention:string,training_opt_out:boolean,endpoint:string,provider_policy_id:string>, "
            "policy struct<allow_external_models:boolean,allowed_providers:array<string>,allowed_regions:array<string>,require_zero_retention:boolean,allow_redaction:boolean,redactable_pii_labels:array<string>,deny_pii_labels:array<string>,deny_classifications:array<string>,human_review_classifications:array<string>>, "
            "providers array<struct<provider_policy_id:string,provider:string,runtime:string,region:string,retention:string,training_opt_out:boolean,endpoint:string,status:string,allowed_classifications:array<string>,denied_pii_labels:array<string>>>, "
            "spans array<struct<span_id:string,classification:string,pii_labels:array<string>,text:string>>"
        )
        row = self.engine.spark.createDataFrame([(json.dumps(request),)], "j string").select(F.from_json("j", schema).alias("r")).select("r.*")
        return gates.egress(row).select("decision", "reason", "payload", "leaks").first().asDict(recursive=True)

    def _assess_faithfulness(self, who: Principal, claims: list[dict]) -> dict:
        rows = [(i, str(c["claim"]), str(c.get("support") or ""), bool(c.get("material", True)), bool(c.get("cited", True))) for i, c in enumerate(claims)]
        told = gates.check_claims(self.engine.spark.createDataFrame(rows, "place int, claim string, support string, material boolean, cited boolean").withColumn("candidate_id", F.lit(0)))
        decided = gates.decide(told).first()
        return {"decision": decided["decision"] if decided else "accepted", "claims": [r.asDict() for r in told.orderBy("place").select("label", "support_score", "missing_anchors").collect()]}

    def _health(self, who: Principal) -> dict:
        return self.engine.health()
