"""Text functions as Columns: tokens, hashes, clipping, redaction, claim checks, secrets."""

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns, in the order in which redaction applies them.
PII = {
    "email": r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b",
    "phone": r"\b(?:\+?1[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b",
    "ssn": r"\b\d{3}-\d{2}-\d{4}\b",
    "customer_id": r"(?i)\bcustomer\s+[_-]?\s*\d+\b",
    "credit_card": r"\b(?:\d[ -]*?){13,16}\b",
}
#: customer_id is redacted on request but is not reported as a leak.
DETECTED = ("email", "phone", "ssn", "credit_card")

# Word and phrase lists of the claim check.
STOPWORDS = ("a", "an", "and", "are", "because", "by", "for", "has", "is", "of", "on", "the", "to", "was", "with")
ANCHOR_PHRASES = ("approved", "denied", "duplicate charge", "eligible", "expedited review", "lifetime", "not eligible", "one time", "one-time", "pending authorization", "refund exception", "unpublished", "vip escalation")
ANCHOR_PATTERNS = (r"\b(?:customer|case|order)\s*[_-]?\s*[a-z0-9]+\b", r"\b\d+(?:\.\d+)?\s*(?:percent|%)\b", r"\$\s*\d+(?:\.\d+)?")
UNCERTAIN_SUPPORT = ("might", "may", "possible", "suspected", "not confirmed", "unconfirmed", "had not confirmed")
UNCERTAIN_CLAIM = ("might", "may", "possible", "possibly", "suspected")
POSITIVE = ("approved", "eligible", "offered", "promised", "received")
NEGATIVE = ("denied", "declined", "not eligible", "no refund", "rejected")

# Formats of credentials, and what marks an example.
SECRETS = (
    r"-----BEGIN (?:RSA |EC |OPENSSH |PGP |DSA )?PRIVATE KEY-----",
    r"\bAKIA[0-9A-Z]{16}\b",
    r"\bsk-[A-Za-z0-9]{20,}\b",
    r"\bAIza[0-9A-Za-z_\-]{35}\b",
    r"\bghp_[A-Za-z0-9]{36}\b",
    r"\bgithub_pat_[A-Za-z0-9_]{60,}\b",
    r"\bxox[baprs]-[A-Za-z0-9-]{10,}\b",
)
PLACEHOLDERS = ("example", "xxxx", "your-", "your_", "changeme", "redacted", "placeholder", "sk-test", "<", "...")


def any_of(conditions) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def tokens(text: Column) -> Column:
    """Runs of [a-z0-9] in the lower-cased text; none for null."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), 0)


def content_hash(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text, 256))


def token_bucket(token: Column, dims: int = 256) -> Column:
    """md5 of the token modulo dims (a power of two up to 2**32)."""
    return F.pmod(F.conv(F.substring(F.md5(token), 25, 8), 16, 10).cast("long"), F.lit(dims))


def jaccard(query_tokens: Column, text_tokens: Column) -> Column:
    """Share of distinct tokens in common; 0 where both are empty."""
    return F.size(F.array_intersect(query_tokens, text_tokens)) / F.greatest(F.size(F.array_union(query_tokens, text_tokens)), F.lit(1))


def clip(text: Column, limit: int) -> Column:
    """At most limit characters: head and tail around a marker."""
    marker = "\n...\n"
    text = F.coalesce(text, F.lit(""))
    if limit <= 0:
        return text
    if limit <= len(marker):
        return F.when(F.length(text) <= limit, text).otherwise(F.left(text, F.lit(limit)))
    room = limit - len(marker)
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.left(text, F.lit(room // 2)), F.lit(marker), F.right(text, F.lit(room - room // 2))))


def _bound(value: Column, function) -> Column:
    """function(value), with the value computed once however often it is named."""
    return F.get(F.transform(F.array(value), function), F.lit(0))


def _may_hold(text: Column, label: str) -> Column:
    """A cheap necessary condition: an address has an @, the other kinds a digit."""
    return F.contains(text, F.lit("@")) if label == "email" else text.rlike("[0-9]")


def redact(text: Column, labels: Column | None = None) -> Column:
    """Replaces PII by markers, for the labels given (all if none). Each pattern sees what the one before it left."""
    def step(name: str, pattern: str):
        asked = lambda x: _may_hold(x, name) if labels is None else F.array_contains(labels, name) & _may_hold(x, name)
        return lambda x: F.when(asked(x), F.regexp_replace(x, pattern, f"[REDACTED_{name.upper()}]")).otherwise(x)

    out = text
    for name, pattern in PII.items():
        out = _bound(out, step(name, pattern))
    return out


def detected_pii(text: Column) -> Column:
    """Sorted labels of raw PII that the text still shows."""
    found = lambda x: F.array(*(F.when(_may_hold(x, name) & x.rlike(PII[name]), F.lit(name)) for name in DETECTED))
    return F.array_sort(F.filter(_bound(text, found), lambda x: x.isNotNull()))


def normalise(text: Column) -> Column:
    """Lower case, underscores as spaces, single spaces."""
    return F.trim(F.regexp_replace(F.replace(F.lower(text), F.lit("_"), F.lit(" ")), r"\s+", " "))


def flat(text: Column) -> Column:
    """Normalised, with hyphens as spaces: what phrases and anchors are looked for in."""
    return F.replace(normalise(text), F.lit("-"), F.lit(" "))


def claim_tokens(text: Column) -> Column:
    words = F.array_distinct(F.regexp_extract_all(normalise(text), F.lit("[a-z0-9]+"), 0))
    return F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(*STOPWORDS))


def token_support(own: Column, support: Column) -> Column:
    """Share of the claim's tokens among the support's; 0 for a claim without tokens."""
    return F.when(F.size(own) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(own, support)) / F.size(own))


def support_score(claim: Column, support: Column) -> Column:
    return token_support(claim_tokens(claim), claim_tokens(support))


def flat_anchors(text: Column) -> Column:
    found = [F.regexp_extract_all(text, F.lit(p), 0) for p in ANCHOR_PATTERNS]
    # a phrase with a hyphen never occurs in flattened text
    phrases = F.filter(F.array(*(F.when(F.contains(text, F.lit(p)), F.lit(p)) for p in ANCHOR_PHRASES)), lambda x: x.isNotNull())
    return F.array_sort(F.array_distinct(F.concat(*found, phrases)))


def anchors(text: Column) -> Column:
    """Entities, percentages, amounts and fixed phrases in a text, sorted."""
    return _bound(flat(text), flat_anchors)


def _missing(claim: Column, support: Column) -> Column:
    return F.filter(flat_anchors(claim), lambda a: ~F.contains(support, a))


def missing_anchors(claim: Column, support: Column) -> Column:
    return _missing(flat(claim), flat(support))


def has_any(text: Column, terms) -> Column:
    return any_of(F.contains(text, F.lit(t)) for t in terms)


def _contradicts(c: Column, s: Column) -> Column:
    has = lambda x, t: F.contains(x, F.lit(t))
    return (
        (has_any(c, POSITIVE) & has_any(s, NEGATIVE))
        | (has(c, "lifetime") & has(s, "one time"))
        | (has(c, "eligible") & has(s, "not eligible"))
        | (has(c, "approved") & (has(s, "denied") | has(s, "declined") | has(s, "rejected")))
    )


def contradicts(claim: Column, support: Column) -> Column:
    """Positive claim against negative support, or one of the fixed opposite pairs (substrings, so "not eligible" is also "eligible")."""
    return _contradicts(flat(claim), flat(support))


def uncertainty_mismatch(claim: Column, support: Column) -> Column:
    return has_any(flat(support), UNCERTAIN_SUPPORT) & ~has_any(flat(claim), UNCERTAIN_CLAIM)


def label_of(claim: Column, support: Column, missing: Column, score: Column, checkable: Column, enough: float = 0.72, some: float = 0.45) -> Column:
    """Label of a claim: not_checkable, contradicted, unsupported, partially_supported or supported; the first that holds.

    claim and support are flat() texts, missing and score what missing_anchors() and support_score() say of them.
    """
    return (
        F.when(~checkable, "not_checkable")
        .when(_contradicts(claim, support), "contradicted")
        .when(F.size(missing) > 0, "unsupported")
        .when(has_any(support, UNCERTAIN_SUPPORT) & ~has_any(claim, UNCERTAIN_CLAIM), "partially_supported")
        .when(score >= enough, "supported")
        .when(score >= some, "partially_supported")
        .otherwise("unsupported")
    )


def claim_label(claim: Column, support: Column, cited: Column) -> Column:
    c, s = flat(claim), flat(support)
    return label_of(c, s, _missing(c, s), support_score(claim, support), cited & (F.coalesce(support, F.lit("")) != ""))


def shows_secret(text: Column) -> Column:
    """Whether a credential stands in the text without a mark of an example within 24 characters around it."""

    def real(pattern: str) -> Column:
        # what stands between the matches gives their surroundings, as matches have no offsets
        found = F.regexp_extract_all(text, F.lit(f"({pattern})"), 1)
        between = F.split(text, pattern)
        around = F.zip_with(found, F.sequence(F.lit(0), F.size(found)), lambda m, i: F.concat(F.right(F.get(between, i), F.lit(24)), m, F.left(F.get(between, i + 1), F.lit(24))))
        return F.exists(F.slice(around, F.lit(1), F.size(found)), lambda w: ~any_of(F.contains(F.lower(w), F.lit(h)) for h in PLACEHOLDERS))

    return any_of(F.when(text.rlike(p), real(p)).otherwise(False) for p in SECRETS)


def sanitise_recalled(text: Column) -> Column:
    """Without blocks and notes of recalled context, trimmed."""
    out = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?i)<\s*memory-context\s*>[\s\S]*?</\s*memory-context\s*>", "")
    return F.trim(F.regexp_replace(out, r"(?i)\[System note:\s*The following is recalled memory context[^\]]*\]\s*", ""))


def slug(text: Column, limit: int = 36) -> Column:
    """Lower-case runs of letters and digits joined by underscores, cut to the limit; "memory" if there are none."""
    out = F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), F.lit("_"))
    return F.left(F.when(out == "", "memory").otherwise(out), F.lit(limit))


def numbered_lines(text: Column) -> Column:
    """Lines with their number, right-aligned to six, and a tab."""
    return F.array_join(F.transform(F.split(text, "\n"), lambda x, i: F.concat(F.lpad((i + 1).cast("string"), 6, " "), F.lit("\t"), x)), "\n")


def human_size(n: Column) -> Column:
    kb, mb = n / 1024, n / 1048576
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit("B"))).when(kb < 1024, F.concat(F.round(kb, 1).cast("string"), F.lit("K"))).otherwise(F.concat(F.round(mb, 1).cast("string"), F.lit("M")))


def line_range(text: Column, first: int, count: int) -> Column:
    """count lines from line `first` (from 1) on."""
    return F.array_join(F.slice(F.split(text, "\n"), first, count), "\n")


def context_window(text: Column, start: Column, end: Column, width: int) -> Column:
    """The span [start, end) with half of width on either side."""
    low = F.greatest(start - width // 2, F.lit(0))
    return F.substring(text, low + 1, F.least(end + width // 2, F.length(text)) - low)
