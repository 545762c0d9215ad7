"""Collocations against counting by hand."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from slowtrace.llm import phrases
from slowtrace.llm.phrases import Grams, Words

SCHEMA = "lang string, text string, fp long, a long, n long, row long, phrase string, score double"


def lowered(text):
    return text.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def by_hand(rows, top, at_least):
    count, total = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\n-\r]", lowered(text or "")):
            words = re.findall(r"[^ \t]+", piece)
            total[lang] += len(words)
            for k in range(1, 5):
                count[lang].update(tuple(words[i:i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, own in count.items():
        found = {g: a for g, a in own.items() if a >= at_least}
        scored = []
        for gram, a in found.items():
            if len(gram) == 1:
                continue
            score, k = min((2000000 * a // (own[gram[:k]] + own[gram[k:]]), k) for k in range(1, len(gram)))
            covered = any(100 * b >= 80 * a and any(other[i:i + len(gram)] == gram for i in range(len(other) - len(gram) + 1))
                          for other, b in found.items() if len(other) > len(gram))
            if not covered:
                scored.append((-score, -a, " ".join(gram).encode(), own[gram[:k]], own[gram[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, total[lang], -score))
    return sorted(out)


def corpus():
    rng = random.Random(3)
    vocabulary = ["The", "the", "of", "STATE", "ä", "Ünion", "x" * 70, "y" * 700, "a-b", "it's", "\x1cfs", "日本語", "b", "c"]
    texts = []
    for _ in range(120):
        words = []
        for _ in range(rng.randrange(60)):
            words += rng.choice([[rng.choice(vocabulary)], ["New", "york", "city"], ["to", "be", "or", "not", "to"]])
        text = words[0] if words else ""
        for word in words[1:]:
            text += rng.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n", "\x0b", "!? "]) + word
        texts.append((rng.choice(["en", "en", "de", None, "und", ""]), text))
    return [*texts, *texts[:30], ("en", None), (None, None), ("en", ""), ("de", " \t ... "), ("fr", "new york city " * 40)]


@pytest.mark.parametrize("bits", [64, 12])
def test_against_counting(spark, bits):
    """With twelve bits most fingerprints stand for several phrases; the recount must still be exact."""
    rows = corpus()
    df = spark.createDataFrame([(*r, 1, 2, 3, 4, "p", 0.5) for r in rows], SCHEMA)
    got = phrases.mine(df, top=40, at_least=5, bits=bits)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(tuple(r) for r in got.collect()) == by_hand(rows, 40, 5)


def test_many_chunks_give_the_same(spark, monkeypatch):
    rows = corpus()
    texts = [(r[1] or "").encode() for r in rows]
    batch_of = __import__("pyarrow").RecordBatch.from_pydict({
        "lang": ["und" if r[0] is None else r[0] for r in rows], "text": [r[1] for r in rows], "row": list(range(len(rows)))})
    def total(gathered, chunk):
        monkeypatch.setattr(phrases, "GATHERED", gathered)
        monkeypatch.setattr(phrases, "CHUNK", chunk)
        sums = Counter()
        for out in phrases._counted((2,), None, 64)(iter([batch_of])):
            for fp, n in zip(out.column("fp").to_pylist(), out.column("n").to_pylist(), strict=True):
                sums[fp] += n
        return sums
    assert total(1 << 20, 1 << 20) == total(10, 100)
    assert sum(map(len, texts)) > 10_000


def test_words_lie_where_the_pattern_finds_them():
    texts = [b"", b" ", b"A b.C\td", "Ä\x85é\xa0z, \x00q".encode(), b"x" * 300 + b" y"]
    words = Words(texts)
    got = [(int(t), bytes(words.buffer[s:e])) for t, s, e in zip(words.text, words.starts, words.ends, strict=True)]
    want = [(i, lowered(w.decode()).encode()) for i, t in enumerate(texts) for w in re.findall(rb"[^ \t.,;:!?\n-\r]+", t)]
    assert got == want


def test_equal_ngrams_have_equal_fingerprints():
    text = b"one two three four one two three four five"
    grams = Grams([text, b"four five", b"four five"], ["a", "a", "b"], 64)
    assert grams.fingerprint(np.array([0, 1]), 4)[0] == grams.fingerprint(np.array([4]), 4)[0]
    inside, alone, other = (grams.fingerprint(np.array([at]), 2)[0] for at in (7, 9, 11))
    assert inside == alone != other


def test_filter_passes_all_its_keys(spark):
    keys = np.random.default_rng(1).integers(-2 ** 63, 2 ** 63 - 1, 20_000)
    known = phrases.FingerprintFilter(spark.createDataFrame([(int(k),) for k in keys], "fp long"))
    assert known.passes(keys.view(np.uint64)).all()
    others = np.random.default_rng(2).integers(-2 ** 63, 2 ** 63 - 1, 20_000).view(np.uint64)
    assert known.passes(others).mean() < 0.1
    known.release()


@pytest.mark.parametrize("rows", [[], [("en", None)], [(None, "")], [("en", "once only")]])
def test_nothing_to_find(spark, rows):
    assert phrases.mine(spark.createDataFrame(rows, "lang string, text string")).collect() == []


def test_hot_language_and_ties(spark):
    """Equal scores go by frequency and then by bytes; rank is cut at the top."""
    rows = [("en", f"{a} {b}") for a, b in [("é", "z"), ("z", "é"), ("B", "c"), ("b1", "c1")] for _ in range(30)]
    got = phrases.top_phrases(phrases.collocations(*phrases.frequent_phrases(spark.createDataFrame(rows, "lang string, text string"))), 3)
    assert [r["phrase"] for r in got.orderBy("rank").collect()] == ["b c", "b1 c1", "z é"]
