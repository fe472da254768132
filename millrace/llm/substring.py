"""Substring dedup (10): level-wise doubling of repeated word windows.

A window of WINDOW words goes if its words also start a window of a document
with a smaller doc_id; every word it covers is removed.

Levels are 13, 25 and 50 words, each at most twice the one before. At each
level below the last, of the short windows in a full window the one with the
least hash is its anchor, so equal windows have equal anchors, and one word in
about (50 - length) / 2 starts one. Full windows whose anchor stands in one
document alone end there; around anchors that repeat, the next level looks at
windows of twice the length, and without any left it is the last. At the last level full windows are compared by two
64-bit hashes. What is removed ends here, as longer repeats are unions of these
windows; longest_repeats() doubles on until no candidates survive.

Words are [^\\x20\\x09-\\x0D]+ as they stand. Counts are combined before they are
shuffled, and the rows of a common window are joined with one row, so a window
that stands in a third of all documents is split over tasks.

Defined results: null and empty texts have no words and an empty kept text;
documents of fewer words than a window lose none; doc_id is a key, and rows with
equal ones are not compared with one another; rows without it are left whole;
an empty table gives no rows.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .jobs import discard, map_batches, written
from .text import PLAIN, SECOND, Chunk, chunks, grams, inside

WINDOW = 50
#: The first level has at most so many words.
SHORTEST = 15


def slide(x: np.ndarray, width: int, least: bool) -> np.ndarray:
    """Least or greatest of each `width` consecutive values."""
    op, size = np.minimum if least else np.maximum, 1
    while 2 * size <= width:
        x = op(x[:-size], x[size:])
        size *= 2
    return op(x[: len(x) - (width - size)], x[width - size :]) if width > size else x


def levels(window: int) -> list[int]:
    """Lengths from a few words up to the window's, each at most twice the one before."""
    out = [window]
    while out[0] > SHORTEST:
        out.insert(0, -(-out[0] // 2))
    return out


def anchored(c: Chunk, window: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the windows of `length` words, and the least of them in each full window; 0 where it would leave its document."""
    g = grams(c.words, length)
    g |= np.uint64(1)
    return g, np.where(inside(c, window), slide(g, window - length + 1, True), np.uint64(0))


def _alive(c: Chunk, lists: pa.Array, window: int, length: int) -> np.ndarray:
    """Which full windows have an anchor of `length` words among those listed for their documents."""
    alive = np.unique(lists.slice(c.row, c.docs).flatten().to_numpy().view(np.uint64))
    if not len(alive):
        return np.zeros(0, bool)
    _, least = anchored(c, window, length)
    return alive[np.minimum(np.searchsorted(alive, least), len(alive) - 1)] == least


def _anchors(window: int, length: int, before: int | None):
    """(h, doc_id) of the anchors of `length` words, around anchors of `before` words that repeat where those are listed."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        for c in chunks(batch.column(1), PLAIN):
            if len(c.words) < window:
                continue
            g, least = anchored(c, window, length)
            if before is not None:
                alive = _alive(c, batch.column(2), window, before)
                if not alive.any():
                    continue
                least = np.where(alive, least, np.uint64(0))
            ends = np.zeros(len(g) - len(least), np.uint64)
            # a window is an anchor if it is the least of some full window that holds it
            at = np.flatnonzero(slide(np.concatenate((ends, least, ends)), len(ends) + 1, False) == g)
            doc = np.searchsorted(c.first, at, "right") - 1
            yield pa.RecordBatch.from_arrays([pa.array(g[at].view(np.int64)), pa.array(ids[c.row + doc])], ["h", "doc_id"])

    return run


def _windows(window: int, before: int):
    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        for c in chunks(batch.column(1), PLAIN):
            if len(c.words) < window:
                continue
            at = np.flatnonzero(_alive(c, batch.column(2), window, before))
            if not len(at):
                continue
            doc = np.searchsorted(c.first, at, "right") - 1
            hashes = [pa.array(grams(c.words, window, *step)[at].view(np.int64)) for step in ((), (SECOND,))]
            yield pa.RecordBatch.from_arrays([*hashes, pa.array(ids[c.row + doc]), pa.array((at - c.first[doc]).astype(np.int32))], ["h", "g", "doc_id", "start"])

    return run


def _keep(window: int):
    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        n, removed, kept = [], [], []
        for text, starts in zip(batch.column(1), batch.column(2), strict=True):
            words = text.as_buffer().to_pybytes().split() if text.is_valid else []
            gone = np.zeros(len(words) + window + 1, np.int32)
            if starts.is_valid:
                at = starts.values.to_numpy()
                np.add.at(gone, at, 1)
                np.add.at(gone, at + window, -1)
                left = np.flatnonzero(np.cumsum(gone)[: len(words)] == 0).tolist()
                removed.append(len(words) - len(left))
                kept.append(b" ".join([words[i] for i in left]))
            else:
                removed.append(0)
                kept.append(b" ".join(words))
            n.append(len(words))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.binary()).view(pa.string()), pa.array(n, pa.int64()), pa.array(removed, pa.int64())], ["doc_id", "kept", "n_words", "n_removed"])

    return run


def repeated(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, least): hashes that stand in several documents, and the smallest doc_id."""
    return rows.groupBy(*keys).agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").drop("most")


def repeated_windows(docs: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """(h, g, doc_id, start) of the windows around repeated anchors, and repeated() of them; both are written tables."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where("doc_id is not null")
    *short, _ = levels(window) if window > SHORTEST else (-(-window // 2), window)
    alive, before = None, None
    for length in short:
        own = docs if alive is None else docs.join(alive, "doc_id").select("doc_id", "text", "alive")
        anchors = map_batches(own, _anchors(window, length, before), "h long, doc_id long")
        anchors = anchors if alive is None else written(anchors)
        shared = written(repeated(anchors, "h").select("h"))
        listed = written(anchors.join(shared, "h").groupBy("doc_id").agg(F.collect_set("h").alias("alive")))
        discard(shared)
        if alive is not None:
            discard(alive)
            discard(anchors)
        alive, before = listed, length
        if listed.isEmpty():
            break
    windows = written(map_batches(docs.join(alive, "doc_id").select("doc_id", "text", "alive"), _windows(window, before), "h long, g long, doc_id long, start int"))
    discard(alive)
    return windows, written(repeated(windows, "h", "g"))


def repeated_starts(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, starts: places (in words, from 0) of the windows that go, for documents with any."""
    windows, first = repeated_windows(docs, window)
    out = written(windows.join(first, ["h", "g"]).where("doc_id > least").groupBy("doc_id").agg(F.collect_list("start").alias("starts")))
    discard(windows)
    discard(first)
    return out


def longest_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, longest: the greatest length window * 2**k of which a document has a window that another has too.

    The doubling goes on until no candidates survive: two repeated windows end to end make one of twice the
    length, known by both hashes, so no text is read again.
    """
    windows, first = repeated_windows(docs, window)
    rows = written(windows.join(first.select("h", "g"), ["h", "g"]))
    discard(windows)
    discard(first)
    found, length = None, window
    while not rows.isEmpty():
        level = written(rows.select("doc_id", F.lit(length).alias("longest")).distinct())
        found = level if found is None else found.unionByName(level)
        ahead = rows.select(F.col("h").alias("h2"), F.col("g").alias("g2"), "doc_id", (F.col("start") - length).alias("start"))
        twice = written(rows.join(ahead, ["doc_id", "start"]).select(F.xxhash64("h", "h2").alias("h"), F.xxhash64("g2", "g").alias("g"), "doc_id", "start"))
        again = written(repeated(twice, "h", "g").select("h", "g"))
        longer = written(twice.join(again, ["h", "g"]))
        for t in (rows, twice, again):
            discard(t)
        rows, length = longer, 2 * length
    if found is None:
        return rows.select("doc_id", F.lit(length).alias("longest"))
    return found.groupBy("doc_id").agg(F.max("longest").alias("longest"))


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, kept (the words left, joined by one space), n_words, n_removed of every document."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return map_batches(docs.join(repeated_starts(docs, window), "doc_id", "left").select("doc_id", "text", "starts"), _keep(window), "doc_id long, kept string, n_words long, n_removed long")


def without_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """All rows and columns of docs; texts that lose words become the words left, joined by one space, and n_chars follows."""
    at, names = docs.columns.index("text"), docs.columns
    out = docs.join(repeated_starts(docs, window).withColumnRenamed("starts", "_starts"), "doc_id", "left").select(*names, "_starts")
    keep = _keep(window)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        (cut,) = keep(pa.RecordBatch.from_arrays([pa.nulls(batch.num_rows), batch.column(at), batch.column(len(names))], ["doc_id", "text", "starts"]))
        texts = pc.if_else(pc.greater(cut.column(3), 0), cut.column(1), batch.column(at))
        columns = [batch.column(i) for i in range(len(names))]
        columns[at] = texts
        if "n_chars" in names:
            i = names.index("n_chars")
            columns[i] = pc.if_else(pc.greater(cut.column(3), 0), pc.utf8_length(texts).cast(columns[i].type), columns[i])
        yield pa.RecordBatch.from_arrays(columns, names)

    return map_batches(out, run, docs.schema)
