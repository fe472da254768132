"""Text files kept as records, and closed JSON documents: edits by path, exact keys, cutovers, anchor records."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import crypto


def occurrences(text: Column, part: str) -> Column:
    """Places where a part stands, not overlapping."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / max(1, len(part))).cast("int")


def replaced_once(text: Column, old: str, new: str) -> Column:
    """Struct (text, error): the text with the one place of `old` replaced; an error if it stands nowhere or more than once."""
    n = occurrences(text, old)
    error = F.when(n == 0, "not found").when(n > 1, "found more than once")
    return F.struct(F.when(n == 1, F.replace(text, F.lit(old), F.lit(new))).otherwise(text).alias("text"), error.alias("error"))


def inserted(text: Column, line: int, new: str) -> Column:
    """Struct (text, error): new text after a line (0: at the top); an error beyond the last line."""
    lines = F.split(text, "\n")
    out = F.array_join(F.concat(F.slice(lines, 1, line), F.array(F.lit(new)), F.slice(lines, line + 1, F.greatest(F.size(lines) - line, F.lit(0)))), "\n")
    ok = F.size(lines) >= line
    return F.struct(F.when(ok, out).otherwise(text).alias("text"), F.when(~ok, "no such line").alias("error"))


def renamed(files: DataFrame, old: str, new: str) -> DataFrame:
    """Paths at or under `old` move to `new`, unless something stands there."""
    taken = files.where((F.col("path") == new) | F.startswith("path", F.lit(new + "/"))).limit(1).agg(F.count("*").alias("_taken"))
    hit = (F.col("path") == old) | F.startswith("path", F.lit(old + "/"))
    rows = files.crossJoin(F.broadcast(taken))  # one row
    return rows.withColumn("path", F.when(hit & (F.col("_taken") == 0), F.concat(F.lit(new), F.substring("path", len(old) + 1, 1 << 30))).otherwise(F.col("path"))).drop("_taken")


def without_path(files: DataFrame, path: str) -> DataFrame:
    """Files but those at or under a path; rows without a path stay."""
    hit = (F.col("path") == path) | F.startswith("path", F.lit(path.rstrip("/") + "/"))
    return files.where(~F.coalesce(hit, F.lit(False)))


def listed(files: DataFrame, path: str) -> DataFrame:
    """What stands directly in a folder: name (folders end with /) and how many files are at or under it."""
    root = path.rstrip("/") + "/"
    rest = F.substring("path", len(root) + 1, 1 << 30)
    name = F.regexp_extract(rest, "^[^/]+/?", 0)
    return files.where(F.startswith("path", F.lit(root))).groupBy(name.alias("name")).agg(F.count_distinct("path").alias("files")).where("name <> ''")


def path_error(path: Column, root: str = "/memories") -> Column:
    """Why a path may not be used: empty, climbing, escaped, or outside the root; null if it may."""
    norm = F.regexp_replace(F.regexp_replace(path, r"(/\.)+(?=/|$)", ""), "/+", "/")
    return F.when(F.coalesce(path, F.lit("")) == "", "path required").when(F.contains(path, F.lit("\\")) | F.contains(F.lower(path), F.lit("%2e")) | F.array_contains(F.split(path, "/"), ".."), "illegal path").when(~((norm == root) | norm.startswith(root + "/")), "outside the root")


def closed_error(document: Column, schema: dict[str, str]) -> Column:
    """Why a JSON object does not have exactly the keys of the schema, each matching its pattern; null if it does."""
    keys = F.json_object_keys(document)
    wanted = F.array(*map(F.lit, sorted(schema)))
    field = lambda k: F.get_json_object(document, f"$.{k}")
    bad = F.filter(F.array(*(F.when(~F.coalesce(field(k).rlike(f"^(?:{p})$"), F.lit(False)), F.lit(k)) for k, p in sorted(schema.items()))), lambda x: x.isNotNull())
    return (
        F.when(keys.isNull(), "not an object").when(F.size(F.array_except(keys, wanted)) > 0, F.concat(F.lit("unknown:"), F.array_join(F.array_sort(F.array_except(keys, wanted)), ",")))
        .when(F.size(F.array_except(wanted, keys)) > 0, F.concat(F.lit("missing:"), F.array_join(F.array_sort(F.array_except(wanted, keys)), ","))).when(F.size(bad) > 0, F.concat(F.lit("invalid:"), F.array_join(bad, ",")))
    )


def cutovers(log: DataFrame) -> DataFrame:
    """For each chain with a seal (action strict_seal): whether it was made on the head it names and activation follows at once.

    log: chain_id, seq, action, approved_seq (the head that was approved).
    """
    order = Window.partitionBy("chain_id").orderBy("seq")
    rows = log.withColumn("next", F.lead("action").over(order)).withColumn("next_seq", F.lead("seq").over(order)).withColumn("before", F.lag("seq").over(order))
    seals = rows.where("action = 'strict_seal'")
    on_head = F.coalesce(F.col("before"), F.lit(0)) == F.col("approved_seq")
    state = F.when(~F.coalesce(on_head, F.lit(False)), "stale_approval").when(F.col("next").isNull(), "sealed").when((F.col("next") == "strict_activate") & (F.col("next_seq") == F.col("seq") + 1), "active").otherwise("not_consecutive")
    return seals.select("chain_id", "seq", state.alias("state"))


def anchor_error(chain_id: str) -> Column:
    """Why an anchor record (anchor_id, chain_id, seq, row_hash, created_at) is not well-formed; null if it is."""
    checks = (
        (~F.coalesce(F.col("anchor_id").rlike(r"^anchor:[0-9A-Za-z:_-]+$"), F.lit(False)), "anchor_id"),
        (~F.col("chain_id").eqNullSafe(chain_id), "chain_id"),
        (~F.coalesce(F.col("seq") > 0, F.lit(False)), "seq"),
        (~F.coalesce(F.col("row_hash").rlike("^[0-9a-f]{64}$"), F.lit(False)), "row_hash"),
        (F.try_to_timestamp("created_at").isNull(), "created_at"),
    )
    out = F
    for condition, name in checks:
        out = out.when(condition, name)
    return out.otherwise(F.lit(None))


def rewrapped(keys: DataFrame, old_root: bytes, new_root: bytes, tenant: str, most: int | None = None) -> DataFrame:
    """Wrapped keys of a tenant under a new root, `most` at a time by subject; `outcome`: rewrapped, skipped, failed, shredded or left."""
    rows = keys.where(F.col("tenant") == tenant)
    plain, done = crypto.unwrapped(F.col("dek"), old_root, tenant), crypto.unwrapped(F.col("dek"), new_root, tenant).isNotNull()
    todo = ~done & plain.isNotNull() & (F.col("state") != "shredded")
    rows = rows.withColumn("_todo", F.coalesce(todo, F.lit(False)))
    if most is not None:
        first = rows.where("_todo").orderBy("subject").limit(most).select("subject", F.lit(True).alias("_now"))
        rows = rows.join(first, "subject", "left")
    else:
        rows = rows.withColumn("_now", F.col("_todo"))
    now = F.coalesce("_now", F.lit(False)) & F.col("_todo")
    outcome = F.when(F.col("state") == "shredded", "shredded").when(done, "skipped").when(now, "rewrapped").when(F.col("_todo"), "left").otherwise("failed")
    return rows.withColumn("outcome", outcome).withColumn("dek", F.when(F.col("outcome") == "rewrapped", crypto.wrapped(plain, new_root, tenant)).otherwise(F.col("dek"))).drop("_todo", "_now")
