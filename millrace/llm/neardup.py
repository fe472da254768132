"""MinHash near-dedup (5): circulant MinHash, banding, exact Jaccard verification.

Signature: shingles are permuted once over 2**32 places; coordinate k is the
least value of a second permutation of the places shifted circularly by k. So
two permutations make all BANDS * ROWS coordinates. Six equal coordinates in one
of 32 bands make a candidate: a pair at similarity 0.85 is missed with
probability (1 - 0.85**6)**32 < 3e-7. Under 0.85, 38 bands of five: at 0.8 as much.

Documents with equal shingle sets are one class, whose smallest doc_id goes on.
First every document is compared with one document of its buckets (its star),
and what is confirmed on the full sets is joined into components. The star is
the member with the fewest shingles that no other document has, as edits make
such shingles: the original of a group of edited copies. Then come, within
buckets that still hold several components, pairs across components; pairs
inside one cannot change the result. Those buckets are not paired whole: two
exact rules, which lose no link, split them by keys before any pair is made.

* Shingles that one component alone holds link it with no other, so a document
  whose other shingles are too few for the threshold drops out.
* Of two linked documents' live shingles in order of rarity, one among the
  first m - a + 1 of each is common to both (m: live shingles, a: the number
  that the threshold asks for), and their sizes are in one class or neighbouring
  ones. So pairs meet under (shingle, size class) and must share a bucket.

Before sets are compared, two further exact bounds drop pairs: shingles of its
own bound what a document can share, and of 512 buckets of shingles each in which
two documents' counts differ in parity holds a shingle of one of them alone.
Candidates whose one-bit sketches differ in more of 192 places than 6
deviations above the mean of a pair at the threshold are dropped.

Links: 100 * |intersection| >= percent * |union| of the full 64-bit shingle sets.

Defined results: null and empty texts have no shingles and are linked with
nothing; a text of fewer than five words is one shingle; an empty table gives no
rows. doc_id is a key; rows repeated whole are returned as often as they stand;
a row without doc_id has no component and is kept.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .jobs import discard, map_batches, written
from .text import LOWER, chunks, mix, shingle_sets

K = 5
PERCENT = 85
COORDINATES = 192
ROUNDS = 2
#: Columns of a document's one-bit sketch and of the parities of its shingles in 512 buckets.
BITS = ["s0", "s1", "s2"]
ODD = [f"o{i}" for i in range(8)]
SIGNATURE = f"doc_id long, n long, a long, b long, {', '.join(f'{c} long' for c in BITS + ODD)}, bands array<long>"


def banding(percent: int) -> tuple[int, int]:
    """Bands and rows."""
    return (32, 6) if percent >= 85 else (38, 5)


def sketch_limit(percent: int) -> int:
    p = (1 - percent / 100) / 2
    return int(COORDINATES * p + 6 * (COORDINATES * p * (1 - p)) ** 0.5)


def _permute(x: np.ndarray, m: int, n: int) -> np.ndarray:
    """A permutation of 32-bit places, in place."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(m)
    x ^= x >> np.uint32(13)
    x *= np.uint32(n)
    x ^= x >> np.uint32(16)
    return x


def signatures(flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Coordinates x documents; the shingles of document d stand from starts[d] on."""
    places = _permute((flat ^ (flat >> np.uint64(32))).astype(np.uint32), 0x85EBCA6B, 0xC2B2AE35)
    out = np.empty((COORDINATES, len(starts)), np.uint32)
    for k in range(COORDINATES):
        out[k] = np.minimum.reduceat(_permute(places + np.uint32(k), 0x7FEB352D, 0x846CA68B), starts)
    return out


def _sign(percent: int):
    bands_, rows = banding(percent)
    odd = np.random.default_rng(5).integers(0, 1 << 63, rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for c in chunks(batch.column(1), LOWER):
            sets = list(shingle_sets(c, K))
            n = np.array([len(s) for s in sets], np.int64)
            full = n > 0
            flat = np.concatenate([*sets, np.zeros(0, np.uint64)])
            starts = (np.cumsum(n) - n)[full]
            cols = np.zeros((2 + len(BITS) + len(ODD), len(n)), np.uint64)
            bands = np.zeros((len(n), 0), np.int64)
            if full.any():
                cols[0, full] = np.add.reduceat(mix(flat ^ np.uint64(0x51ED270B)), starts)
                cols[1, full] = np.add.reduceat(mix(flat ^ np.uint64(0xA24BAED4963EE407)), starts)
                sig = signatures(flat, starts)
                for i in range(3):
                    cols[2 + i, full] = np.packbits((sig[64 * i : 64 * (i + 1)] & 1).astype(np.uint8), axis=0).T.copy().view(np.uint64)[:, 0]
                places = np.repeat(np.arange(len(starts)) * 512, n[full]) + (flat >> np.uint64(55)).astype(np.int64)
                odd_bits = (np.bincount(places, minlength=512 * len(starts)) & 1).astype(np.uint8).reshape(-1, 64)
                cols[5:, full] = np.packbits(odd_bits, axis=1).view(np.uint64)[:, 0].reshape(-1, len(ODD)).T
                keys = [mix((sig[rows * b : rows * (b + 1)].astype(np.uint64) * odd[:, None]).sum(axis=0, dtype=np.uint64) + np.uint64(b)) for b in range(bands_)]
                bands = np.stack(keys, axis=1).view(np.int64)
            offsets = np.concatenate(([0], np.cumsum(full * bands.shape[1]))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(bands.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(c.row, c.docs), pa.array(n), *(pa.array(x.view(np.int64)) for x in cols), lists], ["doc_id", "n", "a", "b", *BITS, *ODD, "bands"])

    return run


def _sets(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for c in chunks(batch.column(1), LOWER):
        yield pa.RecordBatch.from_arrays([batch.column(0).slice(c.row, c.docs), pa.array([s.tobytes() for s in shingle_sets(c, K)], pa.binary())], ["id", "shingles"])


def _confirm(percent: int):
    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        keep = []
        for x, y in zip(batch.column(2), batch.column(3), strict=True):
            p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            both = np.concatenate((p, q))
            both.sort(kind="stable")
            same = int((both[1:] == both[:-1]).sum())
            keep.append(100 * same >= percent * (len(p) + len(q) - same))
        yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return run


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) linked on their full sets."""
    left = sets.withColumnsRenamed({"id": "u", "shingles": "p"})
    right = sets.withColumnsRenamed({"id": "v", "shingles": "q"})
    both = pairs.join(right, "v").join(left, "u").select("u", "v", "p", "q")
    return map_batches(both, _confirm(percent), "u long, v long")


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable, for every id in an edge (u, v); labels are handed on and shortened till none changes."""
    both = written(edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    labels = written(both.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("m")).select("id", F.least("id", "m").alias("component")))
    while True:
        told = both.join(labels.withColumnRenamed("id", "u"), "u").groupBy(F.col("v").alias("id")).agg(F.min("component").alias("m"))
        nearer = labels.join(told, "id").select("id", "component", F.least("component", "m").alias("m"))
        root = labels.select(F.col("id").alias("m"), F.col("component").alias("r"))
        new = written(nearer.join(root, "m").select("id", F.least("m", "r").alias("component"), (F.least("m", "r") < F.col("component")).alias("moved")))
        moved = new.where("moved").limit(1).count()
        discard(labels)
        labels = new.select("id", "component")
        labels._millrace_path = new._millrace_path
        if not moved:
            discard(both)
            return labels


def _near(x: str, y: str, percent: int) -> Column:
    """Whether two documents can be linked, by their sizes, shingles of their own and sketches."""
    differ, parity = (sum((F.bit_count(F.col(f"{x}.{c}").bitwiseXOR(F.col(f"{y}.{c}"))) for c in columns), F.lit(0)) for columns in (BITS, ODD))
    n, m = F.col(f"{x}.n"), F.col(f"{y}.n")
    most = F.least(n - F.col(f"{x}.u"), m - F.col(f"{y}.u"))
    return (100 * most >= percent * (n + m - most)) & ((100 + percent) * parity <= (100 - percent) * (n + m)) & (differ <= sketch_limit(percent))


def _shingle_rows(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    sizes = np.array([len(x.as_buffer()) // 8 for x in batch.column(1)], np.int64)
    flat = np.concatenate([np.frombuffer(x.as_buffer(), np.int64) for x in batch.column(1)]) if len(sizes) else np.zeros(0, np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(flat), pa.array(np.repeat(batch.column(0).to_numpy(), sizes))], ["h", "id"])


def across(rest: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (u, v) of documents of different components that can be linked: rest has id, component and what _near asks for.

    A linked pair has at least a = percent * n / 100 shingles in common, all of them live: held by several components.
    A pair is made once, under the rarest of the first shingles that both have.
    """
    told = map_batches(sets.join(rest.select("id"), "id").select("id", "shingles"), _shingle_rows, "h long, id long").join(rest.select("id", "component", "n"), "id")
    live = told.groupBy("h").agg(F.count("*").alias("df"), F.min("component").alias("x"), F.max("component").alias("y")).where("x < y").select("h", "df")
    asked = F.ceil(F.col("n") * percent / 100).cast("int")
    by = told.join(live, "h").groupBy("id", "n").agg(F.array_sort(F.collect_list(F.struct("df", "h"))).alias("live")).where(F.size("live") >= asked)
    # sizes of a linked pair differ by a factor under `step`, so their classes by one at most
    step = 100 / percent * (1 + 1e-6)
    first = F.transform(F.slice("live", F.lit(1), F.greatest(F.size("live") - asked + 1, F.lit(0))), lambda x: x["h"])
    keys = by.select("id", F.floor(F.ln("n") / float(np.log(step))).alias("class"), first.alias("first")).join(rest, "id").withColumn("h", F.explode("first"))
    larger = keys.withColumn("c", F.col("class")).alias("p")
    smaller = keys.withColumn("c", F.explode(F.array(F.col("class"), F.col("class") + 1))).alias("q")
    same = (F.col("p.h") == F.col("q.h")) & (F.col("p.c") == F.col("q.c")) & (F.col("p.component") != F.col("q.component")) & ((F.col("q.class") < F.col("p.class")) | (F.col("p.id") < F.col("q.id")))
    once = F.get(F.array_intersect("p.first", "q.first"), F.lit(0)) == F.col("p.h")
    return larger.join(smaller, same & _near("p", "q", percent) & once).select(F.col("p.id").alias("u"), F.col("q.id").alias("v"))


def own_counts(sets: DataFrame) -> DataFrame:
    """(id, u): how many shingles of a set stand in no other of the sets, where any do."""
    alone = map_batches(sets, _shingle_rows, "h long, id long").groupBy("h").agg(F.count("*").alias("c"), F.min("id").alias("id")).where("c = 1")
    return alone.groupBy("id").agg(F.count("*").alias("u"))


def link_classes(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    signed = written(map_batches(docs, _sign(percent), SIGNATURE))
    equal = written(signed.where("n > 0").groupBy("a", "b", "n").agg(F.min("doc_id").alias("rep")))
    members = written(signed.join(equal, ["a", "b", "n"]).select("doc_id", "rep", "n", *BITS, *ODD, F.when(F.col("doc_id") == F.col("rep"), F.col("bands")).alias("bands")))
    alone = written(signed.where("n = 0").select("doc_id", F.lit(0).cast("long").alias("n")))
    discard(signed)
    discard(equal)
    rows = members.where("bands is not null").select(F.col("doc_id").alias("id"), F.explode("bands").alias("key"))
    shared = written(rows.groupBy("key").agg(F.min("id").alias("head"), F.max("id").alias("foot")).where("head < foot").select("key"))
    members_of = written(rows.join(shared, "key"))
    discard(shared)
    sets = written(map_batches(docs.join(members_of.select(F.col("id").alias("doc_id")).distinct(), "doc_id").select("doc_id", "text"), _sets, "id long, shingles binary").dropDuplicates(["id"]))
    facts = members.where("bands is not null").select(F.col("doc_id").alias("id"), "n", *BITS, *ODD, "bands").join(sets.select("id"), "id").join(own_counts(sets), "id", "left")
    facts = written(facts.withColumn("u", F.coalesce("u", F.lit(0))).distinct())
    # a bucket's stars: the member with the fewest shingles of its own, and one by chance
    told = members_of.join(facts.select("id", "u"), "id")
    stars = written(told.groupBy("key").agg(F.min(F.struct("u", "id"))["id"].alias("star0"), F.min(F.struct(F.xxhash64("id"), "id"))["id"].alias("star1")))
    buckets = written(members_of.join(stars, "key"))
    discard(members_of)
    discard(stars)
    labels = None
    edges: list[DataFrame] = []
    for n in range(ROUNDS):
        stars = buckets.select("id", F.col(f"star{n % 2}").alias("star")).distinct().where("id <> star")
        if labels is not None:
            stars = _labelled(_labelled(stars, labels, "id", "x"), labels, "star", "y").where("x <> y").drop("x", "y")
        stars = stars.join(facts.drop("bands").alias("p"), "id").join(facts.drop("bands").withColumnRenamed("id", "star").alias("q"), "star").where(_near("p", "q", percent)).select("id", "star", F.col("q.u").alias("u"))
        pairs = stars.groupBy("id").agg(F.min(F.struct("u", "star"))["star"].alias("star")).select(F.col("star").alias("u"), F.col("id").alias("v"))
        edges.append(written(confirmed(pairs, sets, percent)))
        if labels is not None:
            discard(labels)
        labels = components(_union(edges))
    own = written(_labelled(buckets.select("key", "id"), labels, "id", "component"))
    discard(labels)
    mixed = own.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y").select("key")
    enough = F.expr(f"100 * (n - u) >= {percent} * n")
    rest = written(own.join(mixed, "key").select("id", "component").distinct().join(facts.where(enough).drop("bands"), "id"))
    pairs = written(across(rest, sets, percent))
    p, q = (facts.select(F.col("id").alias(c), F.col("bands").alias(a)) for c, a in (("u", "p"), ("v", "q")))
    met = pairs.join(p, "u").join(q, "v").where(F.exists(F.zip_with("p", "q", lambda a, b: a == b), lambda x: x)).select("u", "v")
    edges.append(written(confirmed(met, sets, percent)))
    for t in (buckets, own, rest, pairs, sets, facts):
        discard(t)
    found = components(_union(edges)).withColumnRenamed("id", "rep")
    every = members.select("doc_id", "rep", "n").join(found, "rep", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "rep").alias("component_id"))
    every = every.unionByName(alone.select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))
    return every.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def _labelled(rows: DataFrame, labels: DataFrame, by: str, name: str) -> DataFrame:
    """rows with the component of column `by`, its own value where it has none."""
    own = labels.select(F.col("id").alias(by), F.col("component").alias(name))
    return rows.join(own, by, "left").withColumn(name, F.coalesce(name, by))


def deduplicate(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The documents without those that are linked, directly or not, with a smaller doc_id."""
    return docs.join(link_classes(docs, percent).where("not kept").select("doc_id").distinct(), "doc_id", "left_anti")
