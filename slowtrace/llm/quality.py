"""Document quality by a linear-chain conditional random field over lines.

Every line is labelled good or bad. What a line looks like (and its neighbours) gives its own score, two by two
weights tie consecutive lines, and forward-backward gives the probability of "good" for each line; a document's quality
is their mean, weighted by the length of the lines. The field is fitted to documents whose quality is known, each line
taking the label of its document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slowtrace.llm.words import WordHasher, texts_of

THRESHOLD = 0.3
FIT_DOCUMENTS = 6_000   # labelled documents the field is fitted to, at most: those with the smallest hash of their id
FIT_BYTES = 1 << 16     # longer documents are not fitted to (all are scored)
_STEP_BYTES = 1 << 21   # text looked at in one go

# --- fixed values: byte classes
_CLASS = np.zeros(256, np.uint8)
for _c in range(256):
    _CLASS[_c] = (1 if chr(_c).isupper() and _c < 128 else 2 if 48 <= _c < 58 else 3 if chr(_c) in "!?" else 4 if chr(_c) in ".,;:'\"-()"
                  else 5 if chr(_c) in "|\t" else 6 if chr(_c) in "#$%&*+/<=>@[\\]^_`{}~" else 7 if _c in (0x20, 0x0B, 0x0C, 0x0D)
                  else 8 if _c >= 128 else 0)
_CLASSES = 9
# --- end of fixed values


def line_features(texts: list[bytes], hasher: WordHasher) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of every non-blank line, its length in bytes, and the number of such lines per text."""
    data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    ends = np.flatnonzero(data == 10)
    starts = np.append(0, ends[:-1] + 1)
    text_ends = np.cumsum([len(t) + 1 for t in texts]) - 1
    owner = np.searchsorted(text_ends, ends)
    blank = (data == 10) | (_CLASS[data] == 7) | (data == 9)
    filled = np.append(0, np.cumsum(~blank))
    real = filled[ends] > filled[starts]
    counts = np.bincount(owner[real], minlength=len(texts))
    starts, ends = starts[real], ends[real]
    if not len(starts):
        return np.zeros((0, _WIDTH)), np.zeros(0), counts
    length = (ends - starts).astype(float)
    classes = _CLASS[data]
    shares = []
    for kind in range(1, _CLASSES):
        total = np.append(0, np.cumsum(classes == kind, dtype=np.int64))
        shares.append((total[ends] - total[starts]) / length)
    begins = ~blank & np.append(True, blank[:-1])
    at = np.flatnonzero(begins)
    low, high = np.searchsorted(at, starts), np.searchsorted(at, ends)
    words = (high - low).astype(float)
    hashes = hasher(data.tobytes().split())
    line = np.searchsorted(starts, at, "right") - 1
    same = np.append(0, np.cumsum(np.append(False, (hashes[1:] == hashes[:-1]) & (line[1:] == line[:-1]))))
    adjacent = (same[high] - same[low]) / words
    mixed = hashes >> np.uint64(24) | line.astype(np.uint64) << np.uint64(40)
    distinct = np.unique(mixed)
    unlike = np.bincount((distinct >> np.uint64(40)).astype(np.int64), minlength=len(starts)) / words
    last = data[ends - 1 - (data[ends - 1] == 13)]
    return np.stack([
        *shares, adjacent, 1 - unlike, np.log1p(length), np.log1p(words), length / words / 10,
        (_CLASS[last] == 4).astype(float), (_CLASS[data[starts]] == 1).astype(float),
    ], axis=1), length, counts


_WIDTH = _CLASSES - 1 + 7


def with_neighbours(own: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Each line's features next to those of the line before and after in its document (zero at the ends), and a one."""
    edge = np.cumsum(counts[counts > 0])
    first = np.zeros(len(own), bool)
    first[np.append(0, edge[:-1])[:len(edge)]] = True
    before = np.roll(own, 1, axis=0)
    before[first] = 0
    after = np.roll(own, -1, axis=0)
    after[np.roll(first, -1)] = 0
    return np.concatenate([own, before, after, first[:, None], np.roll(first, -1)[:, None], np.ones((len(own), 1))], axis=1)


def _chains(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First line and number of lines of each chain, longest first."""
    starts = np.append(0, np.cumsum(counts)[:-1])
    order = np.argsort(-counts, kind="stable")
    order = order[counts[order] > 0]
    return starts[order], counts[order]


def forward_backward(unary: np.ndarray, ties: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """P(good) per line, expected transitions (2 x 2) and the sum of log normalisers, all chains in step."""
    score = np.stack([np.zeros_like(unary), unary], axis=1)
    alpha, beta = np.zeros_like(score), np.zeros_like(score)
    starts, lengths = _chains(counts)
    active = np.searchsorted(-lengths, -np.arange(1, (lengths[0] if len(lengths) else 0) + 1), "right")
    alpha[starts] = score[starts]
    for t in range(1, len(active)):
        at = starts[:active[t]] + t
        alpha[at] = score[at] + np.logaddexp(alpha[at - 1, :1] + ties[0], alpha[at - 1, 1:] + ties[1])
    for t in range(len(active) - 1, 0, -1):
        at = starts[:active[t]] + t
        ahead = score[at] + beta[at]
        beta[at - 1] = np.logaddexp(ahead[:, :1] + ties[:, 0], ahead[:, 1:] + ties[:, 1])
    ends = starts + lengths - 1
    norm = np.logaddexp(alpha[ends, 0], alpha[ends, 1])
    per_line = np.zeros(len(unary))
    per_line[starts] = 1
    owner = np.cumsum(per_line).astype(int) - 1
    in_order = np.argsort(starts)
    z = norm[in_order][owner] if len(unary) else norm
    good = np.exp(alpha[:, 1] + beta[:, 1] - z)
    moves = np.zeros((2, 2))
    inner = np.flatnonzero(per_line == 0)
    for i in range(2):
        for j in range(2):
            moves[i, j] = np.exp(alpha[inner - 1, i] + ties[i, j] + score[inner, j] + beta[inner, j] - z[inner]).sum()
    return good, moves, float(norm.sum())


@dataclass
class LineField:
    """A fitted field; small, so every task gets a copy."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    ties: np.ndarray
    prior: float

    @classmethod
    def fit(cls, own: np.ndarray, counts: np.ndarray, labels: np.ndarray, steps: int = 150, ridge: float = 1e-4) -> LineField:
        """Likelihood of the line labels, climbed by Adam. ``labels``: one per document, 0 or 1."""
        prior = float(labels.mean()) if len(labels) else 0.5
        if not len(own):
            return cls(np.zeros(_WIDTH), np.ones(_WIDTH), np.zeros(3 * _WIDTH + 3), np.zeros((2, 2)), prior)
        mean, scale = own.mean(axis=0), own.std(axis=0) + 1e-6
        x = with_neighbours((own - mean) / scale, counts)
        y = np.repeat(labels, counts).astype(float)
        begins = np.zeros(len(x), bool)
        begins[np.cumsum(counts)[counts > 0] - counts[counts > 0]] = True
        inner = np.flatnonzero(~begins)
        seen = np.zeros((2, 2))
        np.add.at(seen, (y[inner - 1].astype(int), y[inner].astype(int)), 1)
        point, first, second = np.zeros(x.shape[1] + 4), 0.0, 0.0
        for step in range(1, steps + 1):
            good, moves, _ = forward_backward(x @ point[:-4], point[-4:].reshape(2, 2), counts)
            slope = np.append(x.T @ (y - good), (seen - moves).reshape(-1)) / len(x) - ridge * point
            first, second = 0.9 * first + 0.1 * slope, 0.99 * second + 0.01 * slope ** 2
            point = point + 0.1 * (first / (1 - 0.9 ** step)) / (np.sqrt(second / (1 - 0.99 ** step)) + 1e-8)
        return cls(mean, scale, point[:-4], point[-4:].reshape(2, 2), prior)

    def scores(self, texts: list[bytes], hasher: WordHasher) -> np.ndarray:
        """Quality of each text; a text without lines gets the share of good documents."""
        out, at = np.full(len(texts), self.prior), 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size + len(texts[end]) <= _STEP_BYTES):
                size += len(texts[end])
                end += 1
            own, length, counts = line_features(texts[at:end], hasher)
            if len(own):
                x = with_neighbours((own - self.mean) / self.scale, counts)
                good, _, _ = forward_backward(x @ self.weights, self.ties, counts)
                owner = np.repeat(np.arange(at, end), counts)
                weight = np.bincount(owner, length, minlength=end)[at:end]
                total = np.bincount(owner, length * good, minlength=end)[at:end]
                has = weight > 0
                out[at:end][has] = np.clip(total[has] / weight[has], 0, 1)
            at = end
        return out


def held_out(doc_id: Column) -> Column:
    """Documents whose labels are never learnt from; a null id is one of them."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(5)) == 0, F.lit(True))


def _training_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hasher = WordHasher()
    for batch in batches:
        own, _, counts = line_features(texts_of(batch.column("text")), hasher)
        edges = np.append(0, np.cumsum(counts))
        rows = [own[a:b].astype("<f4").tobytes() for a, b in zip(edges, edges[1:], strict=False)]
        yield pa.RecordBatch.from_arrays([batch.column("quality"), pa.array(rows, pa.binary())], ["quality", "lines"])


def fit(docs: DataFrame, labels: DataFrame, documents: int = FIT_DOCUMENTS) -> LineField:
    """Fit to a bounded sample of the labelled documents that are not held out.

    Only the features of at most ``documents`` documents of at most FIT_BYTES come to the driver, whatever the input.
    """
    known = (labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").where(~held_out(F.col("doc_id")))
             .groupBy("doc_id").agg(F.max("quality").alias("quality"))
             .orderBy(F.xxhash64("doc_id"), "doc_id").limit(documents))
    texts = docs.select("doc_id", "text").where(F.octet_length("text") <= FIT_BYTES)
    sample = (texts.join(F.broadcast(known), "doc_id")  # at most ``documents`` rows of two numbers
              .select(F.col("quality").cast("int").alias("quality"), "text")
              .mapInArrow(_training_lines, "quality int, lines binary"))
    rows = sample.orderBy(F.xxhash64("lines")).limit(2 * documents).collect()
    own = [np.frombuffer(r["lines"], "<f4").reshape(-1, _WIDTH) for r in rows]
    counts = np.array([len(o) for o in own], int)
    return LineField.fit(np.concatenate([np.zeros((0, _WIDTH)), *own]), counts, np.array([r["quality"] for r in rows], int))


def score(docs: DataFrame, field: LineField) -> DataFrame:
    """``docs`` with ``score``: quality of every whole text, from its text alone. Null and empty texts get the prior."""
    @F.arrow_udf("double")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        hasher = WordHasher()
        for batch in batches:
            yield pa.array(field.scores(texts_of(batch), hasher), pa.float64())

    return docs.withColumn("score", scored(F.col("text")))


def drop_bad(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the documents that score below THRESHOLD; all columns as they were."""
    marked = score(docs.select(F.struct(*docs.columns).alias("row"), F.col("text")), fit(docs, labels))
    return marked.where(F.col("score") >= THRESHOLD).select("row.*")
