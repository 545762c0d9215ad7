"""Collocations: frequent phrases of two to four words, mined from Rabin-Karp fingerprints.

Inside tasks numpy finds the words of many texts at once and hashes them; prefix polynomials over the word hashes give
the fingerprint of every n-gram by one subtraction and one product. The shuffle adds up fingerprints, never texts: a row
is (fingerprint, check, occurrences, one document that holds it). The check is a polynomial of other word hashes with
another base. Longer n-grams are counted only where all their shorter parts are frequent, as told by a bit filter of
frequent fingerprints; the filter grows with their number up to a bound, beyond which it passes more rows, not fewer.

Only frequent n-grams become text. The first and the last document that hold a fingerprint are read again and yield its
words. A fingerprint stands for one phrase if all its checks agree and both documents give the same words; any other is
counted again, exactly, by the words themselves, in one more pass that looks for such fingerprints alone.

Scores, containment and ranks are SQL over the frequent phrases; products are decimals of 38 digits. The first rows of
each language are found by salted pre-ranking, so no task gets all phrases of a language.

A null text is empty, a null language is ``und``; texts without words give nothing, repeated rows count each, an empty
table gives no rows. Ties in a score go by frequency, then by the bytes of the phrase. Columns but ``lang`` and ``text``
are ignored. Very long texts are hashed whole; memory grows with the longest text, not with the table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slowtrace.llm.words import mix, texts_of
from slowtrace.session import settle

LONGEST, AT_LEAST, TOP = 4, 30, 2_000
SPLITS, BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"
CHUNK = 1 << 20           # bytes of text hashed at once, or one text if it is longer
GATHERED = 1 << 20        # n-grams summed up inside a task before they are sent
FILTER_BITS = 30          # the filter has at most 2 ** FILTER_BITS bits
_SLICE = 1 << 16          # bytes of the filter made by one group
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_SEEDS = (0xA0761D6478BD642F, 0xE7037ED1A0B428DB)
_LENGTH = 0x8EBC6AF09C88C6E3
_BLOCKS = 8               # words of up to eight blocks of eight bytes are hashed by numpy, longer ones one by one

_CLASS = np.zeros(256, np.uint8)
_CLASS[list(BLANKS)] = 1
_CLASS[list(SPLITS)] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32


class Words:
    """The words of many texts: where each lies, its piece, its text, and two hashes."""

    def __init__(self, texts: list[bytes], both: bool = True):
        joined = b"\n".join(texts)
        self.buffer = _LOWER[np.frombuffer(joined + b"\n" + bytes(8), np.uint8)]
        kind = _CLASS[self.buffer[:len(joined) + 1]]
        inside = np.concatenate([[False], kind == 0])
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        self.starts, self.ends = edge[::2], edge[1::2]  # the last byte is a split, so every word has an end
        self.piece = np.cumsum(kind == 2)[self.starts] if len(self.starts) else self.starts
        begins = np.cumsum([0, *(len(t) + 1 for t in texts)])[:-1]
        self.text = np.searchsorted(begins, self.starts, side="right") - 1
        self._prefixes = [self._prefix(seed, base) for seed, base in list(zip(_SEEDS, _BASES, strict=True))[:1 + both]]

    def _hashes(self, seed: int) -> np.ndarray:
        blocks = np.lib.stride_tricks.as_strided(self.buffer[:8].view("<u8"), (len(self.buffer) - 7,), (1,))
        lengths = self.ends - self.starts
        out = mix(lengths.astype(np.uint64) * np.uint64(_LENGTH) + np.uint64(seed))
        alive = np.arange(len(lengths))
        for block in range(_BLOCKS):
            alive = alive[lengths[alive] > 8 * block]
            if not len(alive):
                break
            rest = np.minimum(lengths[alive] - 8 * block, 8)
            value = blocks[self.starts[alive] + 8 * block] & (np.uint64(2 ** 64 - 1) >> (64 - 8 * rest).astype(np.uint64))
            out[alive] = mix(out[alive] ^ (value * np.uint64(seed | 1)))
        for i in np.flatnonzero(lengths > 8 * _BLOCKS).tolist():
            out[i] = xxhash.xxh3_64_intdigest(self.buffer[self.starts[i]:self.ends[i]].tobytes(), seed)
        return out

    def _prefix(self, seed: int, base: int) -> tuple[np.ndarray, np.ndarray]:
        """Sums of hash times falling powers of the base, and its powers: all arithmetic is modulo 2 ** 64."""
        hashes = self._hashes(seed)
        n = len(hashes) + 1
        down = np.cumprod(np.full(n, pow(base, -1, 2 ** 64), np.uint64))
        up = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, base, np.uint64))])
        return np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * down[:-1], dtype=np.uint64)]), up

    def places(self, n: int) -> np.ndarray:
        """Where n-grams begin: n words of one piece."""
        if len(self.piece) < n:
            return np.empty(0, np.int64)
        return np.flatnonzero(self.piece[n - 1:] == self.piece[:len(self.piece) - n + 1])

    def polynomial(self, which: int, at: np.ndarray, n: int) -> np.ndarray:
        sums, up = self._prefixes[which]
        return (sums[at + n] - sums[at]) * up[at + n]

    def phrase(self, at: int, n: int) -> str:
        return b" ".join(self.buffer[s:e].tobytes() for s, e in
                         zip(self.starts[at:at + n], self.ends[at:at + n], strict=True)).decode("utf-8", "replace")


class Grams:
    """Fingerprints and checks of the n-grams of many texts in their languages.

    ``bits`` of a fingerprint are kept; fewer than 64 make collisions for tests of what follows them.
    """

    def __init__(self, texts: list[bytes], langs: list[str], bits: int, checked: bool = True):
        self.words, self._bits = Words(texts, checked), bits
        self._seeds = np.array([xxhash.xxh3_64_intdigest(lang) for lang in langs], np.uint64)

    def fingerprint(self, at: np.ndarray, n: int, which: int = 0) -> np.ndarray:
        values = mix(self.words.polynomial(which, at, n) ^ (self._seeds[self.words.text[at]] + np.uint64(n)))
        return values if which else values >> np.uint64(64 - self._bits)

    def within(self, n: int, known: FingerprintFilter | None, length: int) -> np.ndarray:
        """Places of n-grams all of whose parts of ``length`` words pass the filter."""
        at = self.words.places(n)
        if known is None or not len(at):
            return at
        passes = np.zeros(len(self.words.starts) + 1, bool)
        parts = self.words.places(length)
        passes[parts[known.passes(self.fingerprint(parts, length))]] = True
        for step in range(n - length + 1):
            at = at[passes[at + step]]
        return at


class FingerprintFilter:
    """Passes every fingerprint it was made of and few others.

    One bit per key among at least 16 a key. Keys are dealt by the part of the filter they set, so tasks send 8 KB per
    64 KB slice they filled and hold nothing else; the whole is bounded by ``FILTER_BITS``.
    """

    def __init__(self, keys: DataFrame, column: str = "fp"):
        n = keys.count()
        bits = min(FILTER_BITS, max(19, int(16 * n).bit_length()))
        shift, size = 64 - bits, 1 << (bits - 3)

        def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                place = _places(batch.column(0).to_numpy(), shift)
                yield pa.RecordBatch.from_arrays([pa.array((place >> 19).astype(np.int32)), pa.array(place & ((1 << 19) - 1))],
                                                 ["slice", "bit"])

        def filled(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = np.zeros(_SLICE * 8, bool)
            for batch in batches:
                own[batch.column("bit").to_numpy()] = True
            packed = np.packbits(own, bitorder="little").tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([packed])], ["slice", "bits"])

        parts = (keys.select(column).mapInArrow(sliced, "slice int, bit long")
                 .groupBy("slice").applyInArrow(filled, "slice int, bits binary"))
        whole = np.zeros(size, np.uint8)
        for row in parts.toLocalIterator():  # at most 2 ** FILTER_BITS bits in all
            whole[row["slice"] * _SLICE:(row["slice"] + 1) * _SLICE] = np.frombuffer(row["bits"], np.uint8)
        self._shared, self._shift = keys.sparkSession.sparkContext.broadcast(whole), shift

    def passes(self, fingerprints: np.ndarray) -> np.ndarray:
        place = _places(fingerprints.view(np.int64), self._shift)
        return (self._shared.value[place >> 3] >> (place & 7).astype(np.uint8) & 1).astype(bool)

    def release(self) -> None:
        self._shared.unpersist()


def _places(keys: np.ndarray, shift: int) -> np.ndarray:
    return (mix(keys.view(np.uint64)) >> np.uint64(shift)).astype(np.int64)


# --- passes over the texts ------------------------------------------------------------------------------------------

def _chunks(batch: pa.RecordBatch) -> Iterator[tuple[int, list[bytes], list[str]]]:
    """(first row, texts, languages) of runs of rows with CHUNK bytes or one row."""
    texts, langs = texts_of(batch.column("text")), batch.column("lang").to_pylist()
    first, size = 0, 0
    for i, text in enumerate(texts):
        if size and size + len(text) > CHUNK:
            yield first, texts[first:i], langs[first:i]
            first, size = i, 0
        size += len(text) + 1
    yield first, texts[first:], langs[first:]


class _Sums:
    """Occurrences per (fingerprint, check), sent whenever GATHERED of them are waiting."""

    def __init__(self):
        self._parts: list[tuple[np.ndarray, ...]] = []
        self._n = 0

    def add(self, *columns: np.ndarray) -> bool:
        if len(columns[0]):
            self._parts.append(columns)
            self._n += len(columns[0])
        return self._n >= GATHERED

    def rows(self) -> pa.RecordBatch | None:
        if not self._n:
            return None
        fp, check, row, *tail = (np.concatenate(c) for c in zip(*self._parts, strict=True))
        self._parts, self._n = [], 0
        order = np.argsort(fp)
        fp, check, row = fp[order], check[order], row[order]
        new = np.flatnonzero(np.concatenate([[True], (fp[1:] != fp[:-1]) | (check[1:] != check[:-1])]))
        counts = np.diff(np.append(new, len(fp)))
        columns = [pa.array(fp[new].view(np.int64)), pa.array(check[new].view(np.int64)), pa.array(row[new]), pa.array(counts)]
        names = ["fp", "check", "row", "n"]
        if tail:
            columns.append(pa.array(tail[0][order][new]))
            names.append("lang")
        return pa.RecordBatch.from_arrays(columns, names)


def _counted(lengths: tuple[int, ...], known: FingerprintFilter | None, bits: int):
    """Occurrences of the n-grams of these lengths; single words come with their language."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = _Sums()
        for batch in batches:
            rows = batch.column("row").to_numpy()
            for first, texts, langs in _chunks(batch):
                grams = Grams(texts, langs, bits)
                for n in lengths:
                    at = grams.within(n, known, min(lengths) - 1)
                    owner = grams.words.text[at]
                    tail = [np.array(langs, object)[owner]] if lengths == (1,) else []
                    if sums.add(grams.fingerprint(at, n), grams.fingerprint(at, n, 1), rows[first + owner], *tail):
                        yield sums.rows()
        rest = sums.rows()
        if rest is not None:
            yield rest
    return run


def _named(bits: int):
    """The words behind the wanted fingerprints of each document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, langs, wanted = texts_of(batch.column("text")), batch.column("lang").to_pylist(), batch.column("wanted")
            for i, text in enumerate(texts):
                grams = Grams([text], [langs[i]], bits, False)
                want = np.sort(wanted[i].values.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
                out: list[tuple] = []
                for n in range(1, LONGEST + 1):
                    at = grams.words.places(n)
                    fp = grams.fingerprint(at, n)
                    fp, where = np.unique(fp, return_index=True)
                    hit = np.isin(fp, want, assume_unique=False)
                    out += [(f, n, grams.words.phrase(int(at[w]), n))
                            for f, w in zip(fp[hit].view(np.int64).tolist(), where[hit].tolist(), strict=True)]
                if out:
                    fps, ns, phrases = zip(*out, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(fps, pa.int64()), pa.array([langs[i]] * len(fps)),
                                                      pa.array(ns, pa.int32()), pa.array(phrases)], ["fp", "lang", "words", "phrase"])
    return run


def _recounted(doubtful: FingerprintFilter, bits: int):
    """Occurrences, by their words, of all n-grams whose fingerprint may be doubtful."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts, langs in _chunks(batch):
                grams, seen = Grams(texts, langs, bits, False), {}
                for n in range(1, LONGEST + 1):
                    at = grams.words.places(n)
                    fp = grams.fingerprint(at, n)
                    hit = doubtful.passes(fp)
                    for f, a in zip(fp[hit].view(np.int64).tolist(), at[hit].tolist(), strict=True):
                        key = (f, langs[grams.words.text[a]], n, grams.words.phrase(a, n))
                        seen[key] = seen.get(key, 0) + 1
                if seen:
                    columns = zip(*seen, strict=True)
                    types = [pa.int64(), pa.string(), pa.int32(), pa.string()]
                    yield pa.RecordBatch.from_arrays(
                        [*[pa.array(c, t) for c, t in zip(columns, types, strict=True)], pa.array(list(seen.values()), pa.int64())],
                        ["fp", "lang", "words", "phrase", "a"])
    return run


# --- the operator ---------------------------------------------------------------------------------------------------

def frequent_phrases(docs: DataFrame, at_least: int = AT_LEAST, bits: int = 64) -> tuple[DataFrame, DataFrame]:
    """((lang, words, phrase, a) of all phrases of up to LONGEST words found ``at_least`` times, (lang, n words in all)).

    ``words`` is the length of the phrase. Counts are exact.
    """
    base = settle(docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text",
                              F.monotonically_increasing_id().alias("row")).where("text IS NOT NULL"))
    sums = [F.sum("n").alias("a"), F.min("check").alias("low"), F.max("check").alias("high"),
            F.min("row").alias("first"), F.max("row").alias("last")]
    schema = "fp long, check long, row long, n long"
    single = settle(base.mapInArrow(_counted((1,), None, bits), schema + ", lang string").groupBy("lang", "fp").agg(*sums))
    totals = settle(single.groupBy("lang").agg(F.sum("a").alias("n")))
    enough = F.col("a") >= at_least
    found = settle(single.where(enough).drop("lang"))
    levels = [found]
    for lengths in ((2,), tuple(range(3, LONGEST + 1))):
        known = FingerprintFilter(found)
        found = settle(base.mapInArrow(_counted(lengths, known, bits), schema).groupBy("fp").agg(*sums).where(enough))
        known.release()
        levels.append(found)
    # with shortened fingerprints one may stand for phrases of several lengths
    grams = levels[0].unionByName(levels[1]).unionByName(levels[2])
    wanted = (grams.select("fp", F.explode(F.array_distinct(F.array("first", "last"))).alias("row"))
              .groupBy("row").agg(F.collect_set("fp").alias("wanted")))
    named = settle(base.join(wanted, "row").select("lang", "text", "wanted")
                   .mapInArrow(_named(bits), "fp long, lang string, words int, phrase string").distinct())
    one = named.groupBy("fp").agg(F.count("*").alias("readings"), F.first("lang").alias("lang"), F.first("words").alias("words"),
                                  F.first("phrase").alias("phrase"))
    checks = grams.groupBy("fp").agg(F.sum("a").alias("a"), F.min("low").alias("low"), F.max("high").alias("high"),
                                     F.count("*").alias("levels"))
    judged = settle(checks.join(one, "fp", "left").withColumn(
        "sound", F.expr("low = high AND levels = 1 AND readings <=> 1")))
    phrases = judged.where("sound").select("lang", "words", "phrase", "a")
    doubtful = judged.where("NOT sound").select("fp")
    if not doubtful.isEmpty():
        again = FingerprintFilter(doubtful)
        exact = settle(base.mapInArrow(_recounted(again, bits), "fp long, lang string, words int, phrase string, a long")
                       .groupBy("fp", "lang", "words", "phrase").agg(F.sum("a").alias("a")).where(enough))
        again.release()
        phrases = phrases.unionByName(exact.join(doubtful, "fp", "left_semi").drop("fp"))
    return settle(phrases), totals


def collocations(phrases: DataFrame, totals: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of all phrases of two words and more that no longer phrase accounts for.

    A phrase is cut into a first part and a rest where 2000000 a / (l + r), rounded down, is least (the first such cut).
    It is left out if a phrase that holds its words in a row occurs at least 0.8 times as often.
    """
    longer = phrases.where("words > 1").withColumn("parts", F.split("phrase", " "))
    part = "array_join(slice(parts, {}, {}), ' ')"
    cut = longer.select("lang", "phrase", "a", F.explode(F.expr("sequence(1, words - 1)")).alias("k"), "parts", "words").select(
        "lang", "phrase", "a", "k", F.expr(part.format("1", "k")).alias("head"),
        F.expr(part.format("k + 1", "words - k")).alias("rest"))
    counts = phrases.select(F.col("lang"), F.col("phrase").alias("of"), F.col("a").alias("count"))

    def with_count(df: DataFrame, of: str, name: str) -> DataFrame:
        own = counts.withColumnsRenamed({"of": of, "count": name})
        return df.join(own, ["lang", of])

    scored = with_count(with_count(cut, "head", "l"), "rest", "r").withColumn(
        "score", F.expr("(cast(2000000 as decimal(20, 0)) * cast(a as decimal(18, 0))) "
                        "div (cast(l as decimal(20, 0)) + cast(r as decimal(20, 0)))"))
    best = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("best")).select(
        "lang", "phrase", "a", "best.l", "best.r", "best.score")
    inner = longer.where("words > 2").select(
        "lang", F.col("a").alias("outer"), "parts", F.explode(F.expr("sequence(2, words - 1)")).alias("length")).select(
        "lang", "outer", "parts", "length", F.explode(F.expr("sequence(1, size(parts) - length + 1)")).alias("at")).select(
        "lang", F.expr(part.format("at", "length")).alias("phrase"), "outer")
    widest = inner.groupBy("lang", "phrase").agg(F.max("outer").alias("outer"))
    kept = best.join(widest, ["lang", "phrase"], "left").where(
        "outer IS NULL OR cast(outer as decimal(20, 0)) * 100 < cast(a as decimal(20, 0)) * 80").drop("outer")
    return kept.join(totals, "lang")


def top_phrases(found: DataFrame, top: int = TOP, salts: int = 64) -> DataFrame:
    """The first ``top`` rows of each language by score, frequency and phrase, with their rank."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = found.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(salts)))
    rank = F.row_number()
    few = (salted.withColumn("rank", rank.over(Window.partitionBy("lang", "salt").orderBy(*order)))
           .where(F.col("rank") <= top).drop("rank", "salt"))
    return few.withColumn("rank", rank.over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)


def mine(docs: DataFrame, top: int = TOP, at_least: int = AT_LEAST, bits: int = 64) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the best collocations of each language in ``docs`` (lang, text)."""
    phrases, totals = frequent_phrases(docs, at_least, bits)
    return top_phrases(collocations(phrases, totals), top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
