"""Benchmark decontamination (1): SimHash of item-sized windows.

For every benchmark item of n words, each n-word window of a document has a
256-bit SimHash of its weighted five-word shingles. A shingle counts by the root
of its weight, so two windows of similarity s have a cosine of s or more however
unequal the weights are. RADIUS is 3 deviations above the mean distance at the
threshold: a pair at a similarity of exactly 0.8 is missed with a probability of
0.16 %, one at 0.85 with one in 10 million or so.

Multi-index: the fingerprint is cut into 32 blocks of eight bits, each with a
table from a block's value to the items within two bits of it. 71 differing bits
can spoil (three bits or more) at most 23 blocks, so an item within the radius
is found in nine look-ups or more, and an unrelated one is in 4 % of the cases.
What is found so is measured, and verified on the exact weighted shingles.

Only windows that hold a shingle of an item of their size are fingerprinted: a
window without one has similarity 0, so nothing is lost and clean text costs one
table look-up a word.

Similarity: the weight of the shingles in common (multisets) over the larger of
the two total weights. A shingle weighs 1 / (number of items that hold it), 1 if
none does; items count over the whole benchmark, however many passes it takes.
Words are lower-cased runs of ASCII letters, digits and non-ASCII, so case,
punctuation and line breaks do not hide a leak.

Defined results: null and empty texts and items match nothing; an item without
item_id is searched for too, its matches have a null item_id; items of under
five words are one shingle; a document shorter than the item is one window;
repeated rows give repeated results; of tied windows the first counts; an empty
table of documents gives no rows, an empty benchmark none either and lets every
document pass.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .jobs import keep_rows, map_batches, written
from .text import ALNUM, chunks, grams, inside, mix, one

K = 5
THRESHOLD = 0.8
BITS, BLOCKS = 256, 32
RADIUS = 71
#: Bits that may differ in a block, and the blocks that agree so far in every fingerprint within the radius.
SPARE = 2
AGREE = BLOCKS - RADIUS // (SPARE + 1)
#: Items in the memory of a task at once; a larger benchmark takes more passes.
ITEMS = 20_000
SCHEMA = "doc_id long, item_id long, start_word long, n_words long, similarity double, distance int"


def fingerprints(shingles: np.ndarray, weights: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """SimHash of shingles[s : s + n] for each s of starts, as BLOCKS bytes each."""
    words = np.stack([mix(shingles + np.uint64(0x9E3779B97F4A7C15 * (i + 1) & 0xFFFFFFFFFFFFFFFF)) for i in range(BITS // 64)], axis=1)
    bits = np.unpackbits(words.astype("<u8").view(np.uint8).reshape(-1, BLOCKS), axis=1).astype(np.float64) * 2 - 1
    sums = np.zeros((len(shingles) + 1, BITS))
    np.cumsum(bits * np.sqrt(weights)[:, None], axis=0, out=sums[1:])
    return np.packbits(sums[np.minimum(starts + n, len(shingles))] - sums[starts] > 1e-9, axis=1)


class Index:
    """Multi-index over fingerprints: for each block and value the rows within SPARE bits of it, one after another."""

    def __init__(self, prints: np.ndarray):
        values = np.arange(256, dtype=np.uint8)
        close = np.bitwise_count(values[:, None] ^ values[None, :]) <= SPARE
        self.prints, self.rows, self.at = prints, [], []
        for b in range(BLOCKS):
            value, row = np.nonzero(close[:, prints[:, b]])
            self.rows.append(row)
            self.at.append(np.searchsorted(value, np.arange(257)))

    def near(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, row, distance) of every pair within RADIUS."""
        size, out = len(self.prints), []
        for a in range(0, len(prints), 256):
            part = prints[a : a + 256]
            votes = np.zeros(len(part) * size, np.uint8)
            for b in range(BLOCKS):
                low, high = self.at[b][part[:, b]], self.at[b][part[:, b].astype(np.int64) + 1]
                n = high - low
                places = np.repeat(low - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
                # a row stands once under a value, so no place of a block is counted twice
                votes[np.repeat(np.arange(len(part)) * size, n) + self.rows[b][places]] += 1
            q, row = np.divmod(np.flatnonzero(votes >= AGREE), size)
            distance = np.bitwise_count(part[q] ^ self.prints[row]).sum(axis=1, dtype=np.int64)
            close = distance <= RADIUS
            out.append((q[close] + a, row[close], distance[close]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


class Items:
    """The shingles, weights, fingerprints and multi-index of a part of the benchmark, by number of words.

    shared: the shingles that more than one item of the whole benchmark holds, in order, and how many do.
    """

    def __init__(self, rows: list[tuple[int, str]], shared: tuple[np.ndarray, np.ndarray]):
        self.shared, self.held = shared
        texts = [(i, w) for i, t in rows if len(w := one(t or "", ALNUM))]
        self.shingles = [grams(w, min(K, len(w))) for _, w in texts]
        self.ids = [i for i, _ in texts]
        self.sizes = np.array([len(w) for _, w in texts], np.int64)
        distinct = [np.unique(s) for s in self.shingles]
        flat = np.concatenate([*distinct, np.zeros(0, np.uint64)])
        owner = np.repeat(np.arange(len(distinct)), [len(s) for s in distinct])
        order = np.argsort(flat, kind="stable")
        self.keys, self.at, self.owners = (*np.unique(flat[order], return_index=True), owner[order])
        self.until = np.append(self.at[1:], len(flat)).astype(np.int64) if len(flat) else np.zeros(0, np.int64)
        self.seen = np.zeros(1 << 20, bool)
        self.seen[(self.keys >> np.uint64(44)).astype(np.int64)] = True
        self.weighed = [self.weight(s) for s in self.shingles]
        self.groups = {}
        for n in np.unique(self.sizes).tolist():
            own = np.flatnonzero(self.sizes == n)
            prints = np.concatenate([fingerprints(self.shingles[i], self.weighed[i], np.array([0]), len(self.shingles[i])) for i in own])
            self.groups[n] = own, Index(prints)

    def weight(self, shingles: np.ndarray) -> np.ndarray:
        if not len(self.shared):
            return np.ones(len(shingles))
        at = np.minimum(np.searchsorted(self.shared, shingles), len(self.shared) - 1)
        return np.where(self.shared[at] == shingles, 1.0 / self.held[at], 1.0)

    def holds(self, shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the items' shingles, and which."""
        maybe = np.flatnonzero(self.seen[(shingles >> np.uint64(44)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.keys, shingles[maybe]), len(self.keys) - 1)
        ok = self.keys[at] == shingles[maybe]
        return maybe[ok], at[ok]

    def similarity(self, item: int, shingles: np.ndarray) -> float:
        a, x = np.unique(self.shingles[item], return_counts=True)
        b, y = np.unique(shingles, return_counts=True)
        both, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
        return float((self.weight(both) * np.minimum(x[i], y[j])).sum() / max(self.weighed[item].sum(), self.weight(shingles).sum()))

    def matches(self, shingles: np.ndarray, words: int, k: int, where: np.ndarray, which: np.ndarray) -> Iterator[tuple]:
        """Best window of each matching item in one document, whose item shingles `which` stand at `where`."""
        by_size: dict[int, dict[int, list[int]]] = {}
        for p, key in zip(where.tolist(), which.tolist(), strict=True):
            for item in self.owners[self.at[key] : self.until[key]].tolist():
                by_size.setdefault(int(self.sizes[item]), {}).setdefault(item, []).append(p)
        for n, found in by_size.items():
            if min(K, n) != k:
                continue
            span = min(n, words) - k + 1
            near = np.zeros(len(shingles) + 1, np.int64)
            for p in {p for ps in found.values() for p in ps}:
                near[max(0, p - span + 1)] += 1
                near[p + 1] -= 1
            starts = np.flatnonzero(np.cumsum(near[:-1])[: len(shingles) - span + 1] > 0)
            if not len(starts):
                continue
            low, high = int(starts[0]), int(starts[-1]) + span
            prints = fingerprints(shingles[low:high], self.weight(shingles[low:high]), starts - low, span)
            own, index = self.groups[n]
            s, i, distance = index.near(prints)
            best: dict[int, tuple[float, int, int]] = {}
            for a, item, d in zip(starts[s].tolist(), own[i].tolist(), distance.tolist(), strict=True):
                if (x := self.similarity(item, shingles[a : a + span])) >= THRESHOLD and x > best.get(item, (0.0,))[0]:
                    best[item] = (x, a, d)
            for item, (x, a, d) in best.items():
                yield self.ids[item], a, min(n, words), x, d


def _found(items: Items, texts: pa.Array) -> Iterator[tuple]:
    """(row, item_id, start_word, n_words, similarity, distance) of a batch's matches."""
    sizes = sorted({min(K, int(n)) for n in items.sizes})
    for c in chunks(texts, ALNUM):
        for k in sizes:
            g, ok = grams(c.words, k), inside(c, k)
            if not len(g):
                continue
            where, which = items.holds(g)
            where, which = where[ok[where]], which[ok[where]]
            docs = np.searchsorted(c.first, where, "right") - 1
            for d in np.unique(docs).tolist():
                own = docs == d
                a, b = int(c.first[d]), int(c.first[d + 1])
                for m in items.matches(g[a : b - k + 1], b - a, k, where[own] - a, which[own]):
                    yield c.row + d, *m


def _search(items: Items):
    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        if out := list(_found(items, batch.column(1))):
            row, *rest = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), *(pa.array(x, t) for x, t in zip(rest, (pa.int64(),) * 3 + (pa.float64(), pa.int32()), strict=True))], ["doc_id", "item_id", "start_word", "n_words", "similarity", "distance"])

    return run


def shared_shingles(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The shingles that more than one item of the benchmark (item_id, text) holds, in order, and how many do."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        words = [one(t or "", ALNUM) for t in batch.column(1).to_pylist()]
        own = np.concatenate([*(np.unique(grams(w, min(K, len(w)))) for w in words if len(w)), np.zeros(0, np.uint64)])
        yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64))], ["shingle"])

    counts = map_batches(rows, run, "shingle long").groupBy("shingle").agg(F.count("*").alias("n")).where("n > 1").toArrow()
    keys = counts["shingle"].to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(keys)
    return keys[order], counts["n"].to_numpy()[order]


def _blocks(benchmark: DataFrame) -> Iterator[tuple[Items, bool]]:
    """The benchmark, ITEMS items at a time, and whether it has more than one part."""
    rows = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string"))
    passes = max(1, -(-rows.count() // ITEMS))
    shared = shared_shingles(rows)
    for n in range(passes):
        yield Items([tuple(r) for r in rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == n).orderBy("item_id", "text").collect()], shared), passes > 1


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each document and benchmark item in it: doc_id, item_id, start_word, n_words, similarity, distance (bits).

    The benchmark is taken ITEMS items at a time, a bounded table in the tasks' memory, beside the shared shingles
    of the whole benchmark (16 bytes each), by which each pass weighs alike; no document is shuffled. The result of
    each of several passes is written before the next one's items are made.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    out = None
    for items, several in _blocks(benchmark):
        part = map_batches(docs, _search(items), SCHEMA)
        part = written(part) if several else part
        out = part if out is None else out.unionByName(part)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents in which no benchmark item is found, with all their columns.

    One pass filters rows where they stand. Several write the keys of what they find, and documents of those keys go.
    """

    def bad(items: Items, texts: pa.Array) -> np.ndarray:
        out = np.zeros(len(texts), bool)
        out[[m[0] for m in _found(items, texts)]] = True
        return out

    def keys(items: Items):
        def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            found = batch.column(0).filter(pa.array(bad(items, batch.column(0)), pa.bool_()))
            yield pa.RecordBatch.from_arrays([found], ["text"])

        return run

    text, gone = F.col("text").cast("string"), None
    for items, several in _blocks(benchmark):
        if not several:
            return keep_rows(docs, "text", lambda texts, items=items: (~bad(items, texts)).tolist())
        part = written(map_batches(docs.select(text.alias("text")), keys(items), "text string").select(F.sha2("text", 256).alias("_text")).distinct())
        gone = part if gone is None else gone.unionByName(part)
    return docs.withColumn("_text", F.sha2(text, 256)).join(gone.distinct(), "_text", "left_anti").select(*docs.columns)
