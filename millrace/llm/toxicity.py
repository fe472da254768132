"""Toxicity (8): a convolutional text classifier over hashed word embeddings.

Each word has an embedding by its hash; filters of several widths slide over the
whole text, each filter's largest response in the text is kept (max pooling),
and a logistic layer makes the logit. The widest filters share one weight
vector over their words. All of it is trained here, in numpy, with Adam.

Thresholds are calibrated by language: the language is guessed from the text's
function words alone, and its threshold, the one with fewest errors on labelled
rows kept out of the descent, or the general one if under 5 of those are toxic,
is taken from the logit. So score >= 0.5 is the
calibrated decision, and no column but the text enters a score.

The fit sees at most SAMPLE labelled rows of at most SAMPLE_BYTES each and
SAMPLE_TOTAL together, those first by a hash of doc_id; scoring sees every word
of every document.

Defined results: null text is empty; an empty text is scored from its padding;
without labels of both kinds every score is 0; documents labelled more than once
are toxic if any label says so; labels without a document do not count; repeated
rows are scored each; an empty table gives no rows.
"""

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .jobs import keep_rows, map_batches
from .text import ALNUM, chunks, one

SAMPLE = 9_000
SAMPLE_BYTES = 200_000
SAMPLE_TOTAL = 100_000_000
BITS = 15
WIDTHS = (1, 2, 3)
#: Widths whose words share their weights.
WIDE = (32, 128)
FILTERS = 8
WIDE_FILTERS = 4
DIM = 8
EPOCHS = 5
#: Words in a smaller part of the sample's documents have no embedding of their own: what follows them is chance.
LEAST = 0.002
PAD = 1 << BITS
#: Function words by language; they choose a threshold only.
LANGUAGES = {"en": "the of and to in is that for it was", "fr": "le la les des et du un une est que", "de": "der die das und den ein nicht mit ist zu", "es": "el los las una por con del se para y"}
SCHEMA = "doc_id long, score double, language string"


@dataclass
class Model:
    embed: np.ndarray
    filters: dict[int, np.ndarray]
    bias: np.ndarray
    out: np.ndarray
    base: float
    thresholds: np.ndarray

    def tables(self) -> dict[int, list[np.ndarray]]:
        """Response of each word at each place of each filter: a convolution is then a sum of look-ups."""
        return {w: [self.embed @ f[j] for j in range(f.shape[0])] for w, f in self.filters.items()}


def bins(words: np.ndarray) -> np.ndarray:
    return (words >> np.uint64(64 - BITS)).astype(np.int32)


def pad(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bins with three pads after each document, and the documents' starts."""
    n = np.diff(first)
    at = first + 3 * np.arange(len(first))
    out = np.full(int(at[-1]), PAD, np.int32)
    out[np.arange(len(words)) + 3 * np.repeat(np.arange(len(n)), n)] = bins(words)
    return out, at


def responses(lookup: list[np.ndarray], width: int, x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Filter responses that start at each bin; those in the last two pads of a document are -inf."""
    if len(lookup) > 1:
        out = np.zeros((len(x), lookup[0].shape[1]), np.float32)
        for j, t in enumerate(lookup):
            out[: len(x) - j] += t[x[j:]]
    else:
        own = lookup[0][x].astype(np.float64)
        if width > 1:
            sums = np.zeros((len(x) + 1, own.shape[1]))
            np.cumsum(own, axis=0, out=sums[1:])
            last = np.minimum(np.arange(len(x)) + width, np.repeat(at[1:], np.diff(at)))
            own = sums[last] - sums[: len(x)]
        out = own.astype(np.float32)
    out[at[1:] - 1] = out[at[1:] - 2] = -np.inf
    return out


def pooled(model: Model, tables: dict[int, list[np.ndarray]], x: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.concatenate([np.maximum.reduceat(responses(t, w, x, at), at[:-1], axis=0) for w, t in tables.items()], axis=1) + model.bias


def languages(x: np.ndarray, at: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Language with most function words in each document; -1 without any."""
    lang = known[x]
    counts = np.stack([np.add.reduceat((lang == i).astype(np.int32), at[:-1]) for i in range(len(LANGUAGES))], axis=1)
    return np.where(counts.max(axis=1) > 0, counts.argmax(axis=1), -1)


def known_bins() -> np.ndarray:
    out = np.full(PAD + 1, -1, np.int8)
    for i, words in enumerate(LANGUAGES.values()):
        out[bins(one(words, ALNUM))] = i
    return out


def threshold(logits: np.ndarray, labels: np.ndarray, fallback: float) -> float:
    """The cut with fewest errors, ties to the higher one; halfway between neighbours."""
    if labels.sum() < 5:
        return fallback
    order = np.argsort(-logits)
    s, y = logits[order], labels[order]
    errors = np.concatenate(([y.sum()], y.sum() - np.cumsum(y) + np.cumsum(1 - y)))
    k = int(np.argmin(errors))
    return float(s[0] + 1 if k == 0 else (s[k - 1] + s[k]) / 2 if k < len(s) else s[-1] - 1)


def cuts(logits: np.ndarray, lang: np.ndarray, labels: np.ndarray) -> list[float]:
    """Each language's own threshold, below the general one or above it; last the general one, which languages of few toxic labels take too."""
    general = threshold(logits, labels, 0.0)
    return [*(threshold(logits[lang == i], labels[lang == i], general) for i in range(len(LANGUAGES))), general]


def fit(texts: list[np.ndarray], labels: np.ndarray, seed: int = 7) -> Model | None:
    """texts: word bins of each row."""
    if not 0 < labels.sum() < len(labels):
        return None
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(texts))
    held = order[: len(texts) // 4]
    train = order[len(texts) // 4 :]
    if not 0 < labels[train].sum() < len(train):
        train = order
    held = held if len(held) else train
    hold = [np.zeros(PAD + 1), np.zeros(PAD + 1)]
    for i in train:
        hold[int(labels[i])][np.unique(texts[i])] += 1
    n1, n0 = labels[train].sum(), len(train) - labels[train].sum()
    share1, share0 = (hold[1] + 0.5) / (n1 + 1), (hold[0] + 0.5) / (n0 + 1)
    both = (hold[1] + hold[0] + 1) / (len(train) + 2)
    surprise = (share1 - share0) / np.sqrt(both * (1 - both) * (1 / n1 + 1 / n0))
    frequent = hold[0] + hold[1] >= max(4, LEAST * len(train))
    frequent[PAD] = False
    embed = rng.normal(0, 0.1, (PAD + 1, DIM))
    embed[:, 0] = np.clip(np.log(share1 / share0), -2, 2) * (np.abs(surprise) > 4)
    embed[~frequent] = 0
    filters = {w: rng.normal(0, 0.3, (w, DIM, FILTERS)) for w in WIDTHS} | {w: rng.normal(0, 0.1, (1, DIM, WIDE_FILTERS)) for w in WIDE}
    for f in filters.values():
        f[:, 0] = np.abs(f[:, 0]) + 0.3
    at_filter = np.concatenate(([0], np.cumsum([f.shape[2] for f in filters.values()])))
    count = int(at_filter[-1])
    p = {"e": embed, "b": np.zeros(count), "u": rng.normal(0, 0.1, count) + 0.05, "c": np.array(float(np.log(n1 / n0)))} | {w: f for w, f in filters.items()}
    first = {k: np.zeros_like(v) for k, v in p.items()}
    second = {k: np.zeros_like(v) for k, v in p.items()}
    step, size = 0, 32
    for epoch in range(EPOCHS if len(train) > 1000 else 3 * EPOCHS):
        rate = 0.01 * 0.7**epoch if len(train) > 1000 else 0.01 * 0.9**epoch
        rng.shuffle(train)
        for a in range(0, len(train), size):
            own = train[a : a + size]
            x, at = pad(*_joined([texts[i] for i in own]))
            used, local = np.unique(x, return_inverse=True)
            pool, best = [], {}
            for w in filters:
                r = responses([p["e"][used] @ p[w][j] for j in range(p[w].shape[0])], w, local, at)
                top = np.stack([r[s:t].argmax(axis=0) + s for s, t in zip(at[:-1], at[1:], strict=True)])
                best[w] = top
                pool.append(np.take_along_axis(r, top, axis=0))
            z = np.concatenate(pool, axis=1) + p["b"]
            h = np.maximum(z, 0)
            g = (1 / (1 + np.exp(-(h @ p["u"] + p["c"]))) - labels[own]) / len(own)
            grads = {"u": h.T @ g + 1e-3 * p["u"], "c": g.sum()}
            gz = np.outer(g, p["u"]) * (z > 0)
            grads["b"] = gz.sum(axis=0)
            ge = np.zeros((len(used), DIM))
            for i, w in enumerate(filters):
                gw, top = gz[:, at_filter[i] : at_filter[i + 1]], best[w]
                grads[w] = np.zeros_like(p[w])
                taps = p[w].shape[0]
                for j in range(w):
                    place = top + j
                    ok = place < at[1:, None]
                    word = local[np.minimum(place, len(local) - 1)]
                    live = ok & (gw != 0)
                    if not live.any():
                        continue
                    word, k, gl = word[live], np.nonzero(live)[1], gw[live]
                    tap = j if taps > 1 else 0
                    np.add.at(grads[w][tap].T, k, gl[:, None] * p["e"][used[word]])
                    np.add.at(ge, word, gl[:, None] * p[w][tap].T[k])
            step += 1
            fix = np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            ge[~frequent[used]] = 0
            for k, gk in (*grads.items(), ("e", ge)):
                rows = used if k == "e" else ...
                first[k][rows] = 0.9 * first[k][rows] + 0.1 * gk
                second[k][rows] = 0.999 * second[k][rows] + 0.001 * gk**2
                p[k][rows] -= rate * fix * first[k][rows] / (np.sqrt(second[k][rows]) + 1e-8)
    model = Model(p["e"].astype(np.float32), {w: p[w].astype(np.float32) for w in filters}, p["b"].astype(np.float32), p["u"], float(p["c"]), np.zeros(len(LANGUAGES) + 1))
    x, at = pad(*_joined([texts[i] for i in held]))
    logits, lang, y = np.maximum(pooled(model, model.tables(), x, at), 0) @ model.out + model.base, languages(x, at, known_bins()), labels[held]
    model.thresholds[:] = cuts(logits, lang, y)
    return model


def _joined(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Bins as hashes again, for pad()."""
    first = np.concatenate(([0], np.cumsum([len(x) for x in parts], dtype=np.int64))).astype(np.int64)
    return np.concatenate([*parts, np.zeros(0, np.int32)]).astype(np.uint64) << np.uint64(64 - BITS), first


def scores(model: Model, tables, known: np.ndarray, x: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    logits, lang = np.maximum(pooled(model, tables, x, at), 0) @ model.out + model.base, languages(x, at, known)
    return 1 / (1 + np.exp(-np.clip(logits - model.thresholds[lang], -40, 40))), lang


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learnt from."""
    return F.crc32(doc_id.cast("string")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame) -> Model | None:
    spark = docs.sparkSession
    sample = labels.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int")).where("doc_id is not null and toxic in (0, 1)").where(~held_out(F.col("doc_id")))
    sample = sample.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).withColumn("size", F.coalesce(F.octet_length("text"), F.lit(0))).where(F.col("size") <= SAMPLE_BYTES)
    rows = spark.createDataFrame(sample.collect(), sample.schema)  # SAMPLE rows at most
    sizes = texts.join(F.broadcast(rows), "doc_id").groupBy("doc_id").agg(F.sum("size").alias("size"), F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").collect()
    within = [r for r, total in zip(sizes, accumulate(r["size"] for r in sizes), strict=True) if total <= SAMPLE_TOTAL]
    rows = spark.createDataFrame([(r["doc_id"], r["toxic"]) for r in within], sample.schema)

    def to_bins(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        out = [bins(c.words[a:b]).tobytes() for c in chunks(batch.column(1), ALNUM) for a, b in zip(c.first[:-1], c.first[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary()), batch.column(2)], ["doc_id", "bins", "toxic"])

    # a doc_id that stands more than once would make the sample larger, so the bound is held here too
    found = map_batches(texts.drop("size").join(F.broadcast(rows), "doc_id"), to_bins, "doc_id long, bins binary, toxic int").orderBy("doc_id", "bins").limit(SAMPLE).collect()
    return fit([np.frombuffer(r["bins"], np.int32) for r in found], np.array([r["toxic"] for r in found], np.float64))


def score_toxicity(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, score and guessed language of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a fixed size
    kept: list = []

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        if not kept and shared.value is not None:
            kept.extend((shared.value, shared.value.tables(), known_bins()))
        names = [*LANGUAGES, None]
        score, lang = [], []
        for c in chunks(batch.column(1), ALNUM):
            if kept:
                s, n = scores(*kept, *pad(c.words, c.first))
            else:
                s, n = np.zeros(c.docs), np.full(c.docs, -1)
            score.append(s)
            lang += [names[i] for i in n.tolist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate([*score, np.zeros(0)]), pa.float64()), pa.array(lang, pa.string())], ["doc_id", "score", "language"])

    return map_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, SCHEMA)


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents whose calibrated score is under 0.5, with all their columns."""
    model = train(docs, labels)
    if model is None:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a fixed size
    kept: list = []

    def calm(texts: pa.Array) -> list[bool]:
        if not kept:
            kept.extend((shared.value, shared.value.tables(), known_bins()))
        return [s < 0.5 for c in chunks(texts, ALNUM) for s in scores(*kept, *pad(c.words, c.first))[0].tolist()]

    return keep_rows(docs, "text", calm)
