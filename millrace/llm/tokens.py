"""Token counts (9): unigram segmentation over a trie of distinct pre-tokens.

A text is cut into pre-tokens (a run of letters, of digits or of other marks,
with one space before it, or white space). A pre-token's tokens are the pieces
of its best segmentation under a unigram model over a public vocabulary: a piece
at rank r has log-probability -log(r + 10), the Zipf law of frequency-ordered
vocabularies; single bytes are all in the vocabulary, so each text has one.

Distinct pre-tokens go into a trie. The forward score of a trie node depends on
its prefix alone and is computed once, when the node is made, from the scores on
its path; the count of a pre-token is stored where it ends. Equal scores take
the fewer pieces.

A task's memory is bounded whatever the texts: pre-tokens are taken PIECES at a
time, within a text too, a full trie is started anew between them, and a
pre-token of more than LONG bytes is scored by itself, with the scores of one
longest piece in memory. None of it changes a count.

Defined results: null and empty texts have 0 tokens; repeated rows are counted
each; an empty table gives no rows.
"""

import base64
import math
import re
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .jobs import map_batches

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Trie nodes and stored counts in a task.
NODES = 1_000_000
#: Pre-tokens taken at once, and bytes of one that goes into the trie.
PIECES, LONG = 50_000, 1_000
PRETOKEN = re.compile(r" ?[^\W\d_]+| ?\d+| ?(?:[^\w\s]|_)+|\s+")
SCHEMA = "doc_id long, n_tokens long, n_pretokens long"


def load_vocabulary(path: str = VOCABULARY) -> dict[bytes, float]:
    """Pieces and their log-probabilities, from a file of base64 pieces and ranks."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): -math.log(int(b) + 10) for a, b in map(bytes.split, f)}


class Trie:
    def __init__(self, pieces: dict[bytes, float]):
        #: The vocabulary from its pieces' last bytes on: 256 * node + byte gives a node, and a node its piece's log-probability.
        self.tails: dict[int, int] = {}
        self.logs: list[float | None] = [None]
        for piece, log in pieces.items():
            node = 0
            for byte in reversed(piece):
                node = self.tails.setdefault(node << 8 | byte, len(self.logs))
                if node == len(self.logs):
                    self.logs.append(None)
            self.logs[node] = log
        self.longest = max(map(len, pieces), default=1)
        self.clear()

    def clear(self) -> None:
        #: 256 * node + byte: the child; for each node its forward score and number of pieces; for each terminal the latter.
        self.children: dict[int, int] = {}
        self.scores, self.sizes = [0.0], [0]
        self.counts: dict[str, int] = {}

    def alone(self, data: bytes) -> int:
        """Number of pieces of a long pre-token, by the scores of the last few places."""
        tail, logs, held = self.tails.get, self.logs, self.longest + 1
        scores, sizes = [0.0] * held, [0] * held
        for end in range(1, len(data) + 1):
            best, fewest = -math.inf, 0
            start, back = end, 0
            while start and (back := tail(back << 8 | data[start - 1])):
                start -= 1
                if (p := logs[back]) is not None:
                    s, n = scores[start % held] + p, sizes[start % held] + 1
                    if s > best or s == best and n < fewest:
                        best, fewest = s, n
            scores[end % held], sizes[end % held] = best, fewest
        return sizes[len(data) % held]

    def insert(self, token: str) -> int:
        """Number of pieces; makes the nodes that are missing."""
        data, node, path = token.encode(), 0, [0]
        children, scores, sizes, tail, logs = self.children, self.scores, self.sizes, self.tails.get, self.logs
        for end, byte in enumerate(data, 1):
            if (child := children.get(node << 8 | byte)) is None:
                best, fewest = -math.inf, 0
                start, back = end, 0
                while start and (back := tail(back << 8 | data[start - 1])):
                    start -= 1
                    if (p := logs[back]) is not None:
                        at = path[start]
                        s, n = scores[at] + p, sizes[at] + 1
                        if s > best or s == best and n < fewest:
                            best, fewest = s, n
                child = children[node << 8 | byte] = len(scores)
                scores.append(best)
                sizes.append(fewest)
            node = child
            path.append(node)
        self.counts[token] = n = sizes[node]
        return n

    def count(self, tokens: list[str]) -> int:
        """Pieces of all the tokens; each distinct one is looked up or inserted once."""
        counts = self.counts
        try:
            return sum(map(counts.__getitem__, tokens))
        except KeyError:
            pass
        extra = 0
        for token in dict.fromkeys(tokens):
            if token not in counts:
                if len(token) > LONG and len(token.encode()) > LONG:
                    counts[token] = self.alone(token.encode())
                    extra += 1
                else:
                    self.insert(token)
        out = sum(map(counts.__getitem__, tokens))
        if extra:
            for token in dict.fromkeys(tokens):
                if len(token) > LONG:
                    counts.pop(token, None)
        return out

    def count_text(self, text: str) -> tuple[int, int]:
        """Pieces and pre-tokens of a text."""
        if len(text) <= PIECES:
            tokens = PRETOKEN.findall(text)
            self.make_room()
            return self.count(tokens), len(tokens)
        found, total, number = (m.group() for m in PRETOKEN.finditer(text)), 0, 0
        while part := list(islice(found, PIECES)):
            self.make_room()
            total, number = total + self.count(part), number + len(part)
        return total, number

    def make_room(self) -> None:
        """Starts the trie anew once it is full; PIECES pre-tokens of LONG bytes come on top of NODES at most."""
        if len(self.scores) + len(self.counts) > NODES:
            self.clear()


_kept: dict[str, Trie] = {}


def kept_trie(vocabulary: str, pieces) -> Trie:
    """One trie for a Python worker, as its tasks see the same words again."""
    if vocabulary not in _kept:
        _kept.clear()
        _kept[vocabulary] = Trie(pieces.value)
    return _kept[vocabulary]


def count_tokens(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, n_tokens and n_pretokens of every whole text."""
    pieces = docs.sparkSession.sparkContext.broadcast(load_vocabulary(vocabulary))  # the file's size, whatever the input's

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        trie = kept_trie(vocabulary, pieces)
        found = [trie.count_text(t or "") for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for n, _ in found], pa.int64()), pa.array([n for _, n in found], pa.int64())], ["doc_id", "n_tokens", "n_pretokens"])

    return map_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, SCHEMA)
