"""License scans (3): exact phrases, and fuzzy search for short notices.

Base: places where a phrase's words stand consecutively. Method: a notice may
differ in up to e characters, one for every four of its words. Its words are cut into 2e + 1 pieces;
an edit touches two pieces at most (it can join the last word of one to the
first of the next), so one piece stands unchanged in every match. Those exact
seeds are found by word hashes; around each, the regex library's bounded-error
matching verifies the edits and reports the span.

Words are lower-cased runs of ASCII letters, digits and non-ASCII; notices are
matched against words joined by one space. Null texts count as empty; empty ones
have no word, place or label and score 0. Score: 1 where a base phrase stands,
else 1 - edits / characters of the best notice, else 0. Repeated rows are
scanned each; an empty table gives no rows.
"""

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations, pairwise

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .jobs import map_batches
from .text import ALNUM, Chunk, chunks, grams, one

#: Phrase: label.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Notice: label.
NOTICES = {
    "permission is hereby granted free of charge to any person obtaining a copy": "mit-notice",
    "licensed under the apache license version 2 0": "apache-notice",
    "this program is free software you can redistribute it and or modify": "gpl-notice",
    "licensed under the gnu general public license version": "gpl-notice",
    "redistribution and use in source and binary forms with or without modification": "bsd-notice",
    "subject to the terms of the mozilla public license": "mpl-notice",
    "this work is licensed under a creative commons attribution": "cc-notice",
    "released under the terms of the mit license": "mit-notice",
}
SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label: string, first_word: long, last_word: long, edits: int>>"


def edits_allowed(words: int) -> int:
    """One in four words, which is one in 20 to 30 characters of the notices."""
    return max(1, words // 4)


def pieces(words: list[str], count: int) -> list[tuple[int, int]]:
    """The words cut into `count` pieces whose shortest has most letters, as short ones stand everywhere."""
    cuts = ((0, *c, len(words)) for c in combinations(range(1, len(words)), count - 1))
    best = max(cuts, key=lambda c: sorted(sum(map(len, words[a:b])) for a, b in pairwise(c)))
    return list(pairwise(best))


@lru_cache(1)
def plans():
    """For each number of words of a seed: sorted hashes, and the (notice, offset) of each; the phrases; the compiled notices."""
    seeds: dict[int, dict[int, list[tuple[int, int]]]] = {}
    patterns = []
    for i, notice in enumerate(NOTICES):
        words = notice.split(" ")
        edits = edits_allowed(len(words))
        for a, b in pieces(words, 2 * edits + 1):
            h = int(grams(one(" ".join(words[a:b]), ALNUM), b - a)[0])
            seeds.setdefault(b - a, {}).setdefault(h, []).append((i, a))
        patterns.append((regex.compile(f"(?b)(?:{regex.escape(notice, literal_spaces=True)}){{e<={edits}}}"), len(words), len(notice), edits))
    by_size = {n: (np.array(sorted(x), np.uint64), [x[h] for h in sorted(x)]) for n, x in seeds.items()}
    return by_size, [(one(p, ALNUM), label) for p, label in PHRASES.items()], patterns, list(NOTICES.values())


def notices(c: Chunk) -> dict[int, list[tuple[str, int, int, int, float]]]:
    """Verified notices of each document with any: label, first and last word, edits, score."""
    by_size, _, patterns, labels = plans()
    places = set()
    for n, (hashes, owners) in by_size.items():
        g = grams(c.words, n)
        at = np.minimum(np.searchsorted(hashes, g), len(hashes) - 1)
        for p in np.flatnonzero(hashes[at] == g).tolist():
            places.update((i, p - a) for i, a in owners[at[p]])
    out: dict[int, list] = {}
    done: dict[int, int] = {}
    for i, p in sorted(places):
        pattern, words, size, most = patterns[i]
        d = int(np.searchsorted(c.first, min(max(p, 0), len(c.words) - 1), "right")) - 1
        for doc in {d, min(d + 1, c.docs - 1), max(d - 1, 0)}:
            a, b = max(p - 2 * most, int(c.first[doc])), min(p + words + 2 * most, int(c.first[doc + 1]))
            if b - a < words - most or p + words + most < c.first[doc]:
                continue
            start = c.starts[a:b]
            line = [bytes(ALNUM.fold[c.data[s:e]]).decode() for s, e in zip(start, c.ends[a:b], strict=True)]
            if m := pattern.search(" ".join(line)):
                ends = np.cumsum([len(w) + 1 for w in line])
                first, last = a + int(np.searchsorted(ends, m.start(), "right")), a + int(np.searchsorted(ends, m.end() - 1, "right"))
                if done.get(i, -1) >= first:
                    continue
                done[i] = last
                edits = sum(m.fuzzy_counts)
                zero = int(c.first[doc])
                out.setdefault(doc, []).append((labels[i], first - zero, last - zero, edits, 1 - edits / size))
    return out


def _scan(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    rows = {k: [] for k in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")}
    for c in chunks(batch.column(1), ALNUM):
        hits: dict[int, list[tuple[int, str]]] = {}
        for words, label in plans()[1]:
            n = len(c.words) - len(words) + 1
            ok = np.ones(max(n, 0), bool)
            for j, w in enumerate(words):
                ok &= c.words[j : j + n] == w if n > 0 else ok
            for p in np.flatnonzero(ok).tolist():
                d = int(np.searchsorted(c.first, p, "right")) - 1
                if p + len(words) <= c.first[d + 1]:
                    hits.setdefault(d, []).append((p - int(c.first[d]), label))
        found = notices(c) if len(c.words) else {}
        for d, n in enumerate(np.diff(c.first).tolist()):
            base, fuzzy = hits.get(d, ()), found.get(d, ())
            own = {label for _, label in base}
            rows["n_words"].append(n)
            rows["n_base"].append(len(base))
            rows["first_word"].append(min((p for p, _ in base), default=None))
            rows["last_word"].append(max((p for p, _ in base), default=None))
            rows["base_labels"].append(",".join(sorted(own)))
            rows["labels"].append(",".join(sorted(own | {x[0] for x in fuzzy})))
            rows["score"].append(1.0 if base else max((x[4] for x in fuzzy), default=0.0))
            rows["spans"].append([{"label": x[0], "first_word": x[1], "last_word": x[2], "edits": x[3]} for x in fuzzy])
    kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("edits", pa.int32())]))]
    yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, t) for x, t in zip(rows.values(), kinds, strict=True))], ["doc_id", *rows])


def scan_licenses(docs: DataFrame) -> DataFrame:
    """For every document: number of words, places of base phrases, labels, score and the spans of fuzzy notices (words from 0)."""
    return map_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), _scan, SCHEMA)
