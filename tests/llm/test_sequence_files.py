"""Stream files of sequences: round trip through the tokenizers library, random access, odd rows."""

import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from slowtrace.llm import sequence_files
from slowtrace.llm.sequence_files import END, LAST, TOKEN, Sequences, WordEncoder
from slowtrace.session import scratch_path

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(VOCABULARY)


def ids_of(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids + [END]


def corpus():
    rng = random.Random(9)
    pool = ["Hello", "WORLD", "it's", "été", "ΣΑΣ", "日本語", "#", "<|endoftext|>", "a.b,c", "123", " ", " ", "İ", "x" * 900,
            "\x1c", "́", "don't.", "\U0001f600"]
    texts = ["".join(w + rng.choice([" ", "\n", "\t", "  ", "\r\n", "\x0b", "\x0c"]) for w in rng.choices(pool, k=rng.randrange(40)))
             for _ in range(150)]
    texts += [None, "", " ", "#", "word " * 9_000, texts[0], texts[0]]
    return [(i * 7 % 101 - 20, t) for i, t in enumerate(texts)] + [(None, "no id"), (None, None), (None, "no id"), (2 ** 62 + 5, "big")]


@pytest.fixture(scope="module")
def written(spark):
    rows = corpus()
    df = spark.createDataFrame([(*r, "p", 1, b"m") for r in rows], "doc_id long, text string, path string, start long, mask binary")
    folder = scratch_path(spark, "sequences")
    sequence_files.write_sequences(df.repartition(5), VOCABULARY, folder, length=16, rows=4, per_file=40)
    return rows, folder


def test_documents_from_the_files(spark, written):
    rows, folder = written
    got = sorted((tuple(r) for r in sequence_files.read_documents(spark, folder).collect()), key=lambda r: r[1])
    key = [(-2 ** 63, r[0]) if r[0] is None else (r[0], 0) for r in got]
    assert [k[0] for k in key] == sorted(k[0] for k in key)
    at = 0
    for _, start, n, _ in got:
        assert start == at
        at += n
    assert at == sum(len(ids_of(t)) for _, t in rows)
    want = sorted((str(i), len(ids_of(t)), zlib.crc32(np.array(ids_of(t), "<u4").tobytes())) for i, t in rows)
    assert sorted((str(i), n, crc) for i, _, n, crc in got) == want


def test_sequences_by_number(spark, written):
    """Any order of access gives what a reader of the whole stream gives; ids are views, not copies."""
    rows, folder = written
    sequences = Sequences(spark, folder)
    files = sequence_files.files(spark, folder).orderBy("file").collect()
    assert len(files) > 5 and sum(f["n_sequences"] for f in files) == len(sequences)
    every, masks = [], []
    for f in files:
        with pa.memory_map(f"{folder.removeprefix('file://')}/tokens/{f['path']}") as source, pa.ipc.open_stream(source) as stream:
            for batch in stream:
                every += [np.array(x, np.uint16) for x in batch.column("ids").to_pylist()]
                masks += [np.array(x, np.uint8) for x in batch.column("mask").to_pylist()]
    order = list(range(len(sequences)))
    random.Random(1).shuffle(order)
    for i in order:
        ids, mask = sequences[i]
        assert len(ids) == len(mask) == 16 and np.array_equal(ids, every[i]) and np.array_equal(mask, masks[i])
        assert not ids.flags.owndata and not ids.flags.writeable
        assert set(ids[mask == 0].tolist()) <= {0} and np.all(np.diff((mask == 0).astype(int)) >= 0)
    joined = np.concatenate(masks)
    assert (joined == LAST).sum() == len(rows) and set(joined.tolist()) <= {0, TOKEN, LAST}
    for wrong in (-1, len(sequences)):
        with pytest.raises(IndexError):
            sequences[wrong]


def test_unlisted_files_do_not_count(spark, written):
    """What an attempt that failed left behind is no part of the data set."""
    _, folder = written
    before = sorted(tuple(map(str, r)) for r in sequence_files.read_documents(spark, folder).collect())
    with open(f"{folder.removeprefix('file://')}/tokens/tokens-left.arrows", "wb") as file:
        file.write(b"broken")
    assert sorted(tuple(map(str, r)) for r in sequence_files.read_documents(spark, folder).collect()) == before


def test_empty_table(spark):
    folder = scratch_path(spark, "sequences")
    sequence_files.write_sequences(spark.createDataFrame([], "doc_id long, text string"), VOCABULARY, folder)
    assert sequence_files.read_documents(spark, folder).collect() == [] and len(Sequences(spark, folder)) == 0


def test_text_ids(spark):
    folder = scratch_path(spark, "sequences")
    df = spark.createDataFrame([("b", "two"), ("a", "one"), (None, "none")], "doc_id string, text string")
    sequence_files.write_sequences(df, VOCABULARY, folder)
    got = sequence_files.read_documents(spark, folder).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [None, "a", "b"]


@pytest.mark.parametrize("remember, longest", [(600_000, 200), (30, 200), (600_000, 4)])
def test_encoder_equals_the_library(remember, longest):
    encode = WordEncoder(VOCABULARY, remember, longest)
    texts = [t or "" for _, t in corpus()]
    for start in range(0, len(texts), 20):
        for text, ids in zip(texts[start:start + 20], encode([t.encode() for t in texts[start:start + 20]]), strict=True):
            assert ids.tolist() == ids_of(text)[:-1], text[:50]


def test_new_words_are_encoded_together():
    """One call of the merges for all words that a call meets first, none for words met before."""
    encode, calls = WordEncoder(VOCABULARY), []

    class Counted:
        def encode_ordinary(self, text, merges=encode._merges):
            calls.append(text)
            return merges.encode_ordinary(text)

    encode._merges = Counted()
    texts = [f"don't it's{i} a{i}b{i % 7} <|endoftext|>  {'x' * (i % 230)} été{i}" for i in range(300)] + ["", " "]
    for _ in range(2):
        for text, ids in zip(texts, encode([t.encode() for t in texts]), strict=True):
            assert ids.tolist() == ids_of(text)[:-1], text
    assert len(calls) == 1


def test_portions_cover_all_rows(monkeypatch):
    monkeypatch.setattr(sequence_files, "PORTION", 10)
    for texts in ([], [None], ["", None, "a" * 35, "b", "c" * 9, "d" * 3, None], ["e" * 4] * 20):
        rows = [first + i for first, n in sequence_files._portions(pa.array(texts, pa.string())) for i in range(n)]
        assert rows == list(range(len(texts)))


def test_every_letter_of_the_quick_way():
    """Each code point below U+0250 alone, inside words, and beside digits, quotes and marks."""
    encode = WordEncoder(VOCABULARY)
    assert encode._merges is not None
    words = [w for c in map(chr, range(0x250)) if not (c.encode()).isspace()
             for w in (c, f"ab{c}cd", f"{c}{c}1", f"A{c}'s", f".{c}!", f"don't{c}", f"'{c}ve'll")]
    for word, ids in zip(words, encode([w.encode() for w in words]), strict=True):
        assert ids.tolist() == ids_of(word)[:-1], repr(word)


def test_words_of_the_corpus(spark):
    """All distinct words of a table, against the library."""
    texts = [r[0] or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    words = sorted({w for t in texts for w in t.split()})
    encode = WordEncoder(VOCABULARY)
    want = [c.ids for c in LIBRARY.encode_batch(words, add_special_tokens=False)]
    assert len(words) > 10_000 and [i.tolist() for i in encode([w.encode() for w in words])] == want


def test_encoder_of_other_files():
    """A vocabulary that keeps white space gets whole texts."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    library, encode = Tokenizer.from_file(path), WordEncoder(path)
    for text in ("two words", " a  b\n", ""):
        assert encode([text.encode()])[0].tolist() == library.encode(text, add_special_tokens=False).ids
