"""Training-data operators against brute force, round trips, invariants and odd input."""

import bisect
import datetime as dt
import hashlib
import os
import random
import re
import time
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from slowtrace.llm import (
    contamination, digest_index, hilbert, lines, linking, minhash, packing, pseudonyms, quality, rendering, substrings, tokens,
)
from slowtrace.llm.words import WordHasher, runs, shingle_set
from slowtrace.session import scratch_path

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, digest string, score double, node long, removed int"
rng = random.Random(5)
VOCAB = [f"w{i}" for i in range(4000)]


def prose(n):
    return [rng.choice(VOCAB) for _ in range(n)]


def corpus():
    """Copies, edited copies, shared passages, short, empty and null texts, a very long one."""
    base, passage = prose(160), prose(70)
    texts = [" ".join(base)] * 4 + [" ".join(base).upper()]
    for n in (1, 2, 4, 7, 9):
        edited = list(base)
        for at in rng.sample(range(len(base)), n):
            edited[at] = "edit" + str(rng.random())
        texts.append(" ".join(edited))
    texts += [" ".join(prose(30) + passage + prose(40)) for _ in range(5)]
    texts += [" ".join(passage[:49]), " ".join(passage[:50]), "", None, "one", "one two", "one  two", " \n ", "x" * 5000]
    texts += [" ".join(prose(30_000)), "\n".join(" ".join(prose(12)) for _ in range(9))]
    return [(i * 3 % len(texts), t) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    """The corpus with clashing extra columns."""
    return spark.createDataFrame([(i, t, "d", 0.5, 1, 2) for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    """Null ids, repeated rows, ties."""
    text = " ".join(prose(80))
    found = [(None, text), (None, text), (4, text), (4, text), (2, text), (None, None), (7, ""), (7, "")]
    return spark.createDataFrame([(i, t, None, None, None, None) for i, t in found], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return (text or "").encode().split()


# --- exact dedup

def test_exact(spark, docs, rows):
    index = digest_index.DigestIndex(spark, scratch_path(spark, "t"), 4)
    got = {r["doc_id"]: r for r in digest_index.exact_groups(digest_index.fingerprints(docs), index).collect()}
    groups = defaultdict(list)
    for i, t in rows:
        groups[(t or "").encode().lower()].append(i)
    for own in groups.values():
        for i in own:
            assert (got[i]["keep_id"], got[i]["group_size"], got[i]["kept"]) == (max(own), len(own), i == max(own))


def test_exact_index_persists(spark, docs, odd, none):
    path = scratch_path(spark, "t")
    index = digest_index.DigestIndex(spark, path, 4)
    first = digest_index.drop_exact(docs, index)
    assert first.columns == docs.columns
    n = first.count()
    again = digest_index.DigestIndex(spark, path, 4)
    assert again.rows().count() == n
    again.add(digest_index.fingerprints(docs))
    assert again.rows().count() == n
    new = digest_index.DigestIndex(spark, scratch_path(spark, "t"), 4)
    kept = digest_index.drop_exact(odd, new).collect()
    assert sorted((r["doc_id"], bool(r["text"])) for r in kept) == [(4, True), (7, False)]
    assert digest_index.drop_exact(none, digest_index.DigestIndex(spark, scratch_path(spark, "t"), 4)).count() == 0


def test_exact_of_any_ids(spark):
    """Ids whose sum passes 64 bits, negative ones, and columns named like those of the index."""
    ids = [2 ** 63 - 1, 2 ** 62, 2 ** 62 + 1, -2 ** 63, -5, None, 0]
    rows = [(i, t, b"d", 3) for i, t in zip(ids, ["A", "a", "b", "B", "c", "c", None], strict=True)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, digest binary, row long")
    index = digest_index.DigestIndex(spark, scratch_path(spark, "t"), 4)
    got = digest_index.exact_groups(digest_index.fingerprints(docs), index).collect()
    index.close()
    assert {r["doc_id"]: r["keep_id"] for r in got} == {
        2 ** 63 - 1: 2 ** 63 - 1, 2 ** 62: 2 ** 63 - 1, 2 ** 62 + 1: 2 ** 62 + 1, -2 ** 63: 2 ** 62 + 1, -5: -5, None: -5, 0: 0}
    assert {bytes(r["digest"]) for r in got if r["doc_id"] == 0} == {hashlib.sha256(b"").digest()}


def test_exact_index_has_one_file_per_bucket_and_batch(spark, monkeypatch):
    """Also where rows are dealt out to more partitions than the index has buckets."""
    frame, n = type(spark.range(0)), 13
    dealt = frame.repartition
    monkeypatch.setattr(frame, "repartition", lambda self, parts, *keys: dealt(self, max(n, parts) if keys else parts, *keys))
    index = digest_index.DigestIndex(spark, scratch_path(spark, "t"), 4)
    for first in (0, 200):
        batch = spark.range(first, first + 300).select(
            F.unhex(F.sha2(F.col("id").cast("string"), 256)).alias("digest"), F.col("id").alias("doc_id"), F.col("id").alias("row"))
        index.add(batch)
    files = index.rows().inputFiles()
    got = index.rows().count()
    index.close()
    assert got == 500 and len(files) == 2 * 4


def test_digest_without_python(spark, capsys):
    docs = spark.createDataFrame([(1, "Ä A")], "doc_id long, text string")
    df = docs.select(digest_index.text_digest(F.col("text")).alias("d"))
    df.explain("formatted")
    plan = capsys.readouterr().out
    assert "EvalPython" not in plan and "InArrow" not in plan
    assert bytes(df.first()["d"]) == hashlib.sha256("Ä a".encode()).digest()


# --- substrings

def brute_substrings(rows):
    first = {}
    for i, t in rows:
        w = words(t)
        for k in range(len(w) - 49):
            key = tuple(w[k:k + 50])
            first[key] = min(first.get(key, i), i)
    out = {}
    for i, t in rows:
        w = words(t)
        gone = {k + j for k in range(len(w) - 49) if first[tuple(w[k:k + 50])] < i for j in range(50)}
        out[i] = (len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode())
    return out


def test_substrings(docs, rows, odd, none):
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_text"]) for r in substrings.drop_repeats(docs).collect()}
    assert got == brute_substrings(rows)
    strange = sorted((str(r["doc_id"]), r["n_words"], r["n_removed"]) for r in substrings.drop_repeats(odd).collect())
    assert strange == sorted([("2", 80, 0), ("4", 80, 80), ("4", 80, 80), ("7", 0, 0), ("7", 0, 0),
                              ("None", 0, 0), ("None", 80, 80), ("None", 80, 80)])
    assert substrings.drop_repeats(none).count() == 0


def test_substrings_without_shared_sketch(docs, rows, odd):
    """A sketch too large to be sent to every task: the same rows through a join with its counters."""
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_text"]) for r in substrings.drop_repeats(docs, shared_bits=0).collect()}
    assert got == brute_substrings(rows)
    strange = sorted((str(r["doc_id"]), r["n_words"], r["n_removed"]) for r in substrings.drop_repeats(odd, shared_bits=0).collect())
    assert strange == sorted((str(r["doc_id"]), r["n_words"], r["n_removed"]) for r in substrings.drop_repeats(odd).collect())


def test_substrings_with_unsure_copies(monkeypatch, docs, rows):
    """A filter of copies that passes other rows as well: they are told apart by a join."""
    monkeypatch.setattr(substrings.KeyFilter, "passes", lambda self, *columns: F.lit(True))
    monkeypatch.setattr(substrings.KeyFilter, "mask", lambda self, keys: np.ones(len(keys), bool))
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_text"]) for r in substrings.drop_repeats(docs).collect()}
    assert got == brute_substrings(rows)


def test_sketch_never_underestimates():
    """Sketches of parts of the cells, added: no counter is below the true count, up to two."""
    draw = np.random.default_rng(7)
    bits = substrings.SLICE_BITS + 2
    cells = draw.integers(0, 2 ** 63, 30_000, dtype=np.uint64)
    cells = np.concatenate([cells, draw.choice(cells, 9_000), np.full(500, cells[0])])
    sent = defaultdict(list)
    for part in np.array_split(draw.permutation(cells), 7):
        for name, filled in substrings.partial_sketch(part, bits):
            sent[name].append(filled)
    merged = {name: substrings.added(iter(parts)) for name, parts in sent.items()}
    distinct, n = np.unique(cells, return_counts=True)
    estimates = []
    for row in range(2):
        at = substrings.counter_of(distinct, row, bits).astype(np.int64)
        estimates.append([merged[2 * (a >> substrings.SLICE_BITS) + row][a & (2 ** substrings.SLICE_BITS - 1)] for a in at.tolist()])
    estimate = np.min(estimates, axis=0)
    assert (estimate >= np.minimum(n, 2)).all()
    assert (estimate[n == 1] > 1).mean() < 0.01


# --- near duplicates

def brute_near(rows):
    sets = {}
    for i, t in rows:
        w = [x.lower() for x in words(t)]
        sets[i] = {tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    component = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for i in sets:
            for j in sets:
                common = len(sets[i] & sets[j])
                if common and 100 * common >= 75 * len(sets[i] | sets[j]) and component[i] != component[j]:
                    component[i] = component[j] = min(component[i], component[j])
                    changed = True
    return {i: (len(sets[i]), component[i], component[i] == i) for i in sets}


def test_near(docs, rows, odd, none):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_groups(docs).collect()}
    assert got == brute_near(rows)
    strange = minhash.drop_near(odd).collect()
    assert sorted(str(r["doc_id"]) for r in strange) == ["2", "7", "7", "None"]
    assert minhash.drop_near(none).count() == 0


def test_near_large_group_without_centre(spark):
    """Edited copies, many of them far from each other, in one posting list larger than a block."""
    base, texts = prose(60), []
    for i in range(400):
        edited = list(base)
        for at in rng.sample(range(60), i % 8):
            edited[at] = f"e{rng.randrange(40)}"
        texts.append((i, " ".join(edited)))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"])
           for r in minhash.near_groups(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert got == brute_near(texts)


def test_near_around_a_template(spark, monkeypatch):
    """Documents that share half their words with all others: long lists in many groups, taken apart by rare shingles."""
    draw = random.Random(4)
    head, texts = [draw.choice(VOCAB) for _ in range(40)], []
    for i in range(150):
        own = [f"w{draw.randrange(10 ** 6)}" for _ in range(draw.choice([12, 30, 40]))]
        texts.append((3 * i, " ".join(head + own)))
        texts.append((3 * i + 1, " ".join(head + own + [f"x{i}"])))
        texts.append((3 * i + 2, " ".join(own[:-8] + head + own[-8:])))
    docs, want = spark.createDataFrame(texts, "doc_id long, text string"), brute_near(texts)
    used = []
    rare = minhash.rare_shingles
    monkeypatch.setattr(minhash, "rare_shingles", lambda sets: used.append(1) or rare(sets))
    for long in (linking.LONG, 3):
        monkeypatch.setattr(linking, "LONG", long)
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_groups(docs).collect()}
        assert got == want
    assert used == [1] and len({c for _, c, _ in want.values()}) > 100


def test_rare_shingles_meet(spark):
    """Every linked pair of sets meets under one key; documents of a template meet under few."""
    draw = random.Random(5)
    sets = []
    for _ in range(60):
        one = draw.sample(range(200), draw.randrange(1, 60))
        near = [x for x in one if draw.random() < 0.9] or one
        sets += [one, near, list(range(30)) + draw.sample(range(10 ** 3, 10 ** 6), 30)]
    df = spark.createDataFrame(list(enumerate(sets)), "node long, shingles array<long>")
    keys: dict[int, set[int]] = {}
    for r in minhash.rare_shingles(df).collect():
        keys.setdefault(r["node"], set()).add(r["key"])
    linked = 0
    for a, x in enumerate(map(set, sets)):
        for b, y in enumerate(map(set, sets)):
            if a < b and 100 * len(x & y) >= 75 * len(x | y):
                linked += 1
                assert keys.get(a, set()) & keys.get(b, set())
    assert linked >= 30 and not any(keys.get(i) for i in range(2, 180, 3))


# --- contamination

def test_contamination(spark, docs, rows, none):
    known = dict(rows)
    inside = known[max(known, key=lambda i: len(known[i] or ""))].split()
    items = [(1, " ".join(inside[20_000:20_040]).upper()), (2, " ".join(prose(40))), (3, "one two"), (4, ""), (5, None),
             (6, " ".join(inside[500:520] + ["zz"])), (7, " ".join(inside[900:960])), (8, "a b " * 30)]
    items += [(9, " ".join(inside[3000:3150])), (10, " ".join(inside[100:106]))]
    got = {(r["doc_id"], r["item_id"]): (r["n_shingles"], r["n_found"]) for r in contamination.contained_items(
        docs, spark.createDataFrame(items, "item_id long, text string")).collect()}

    def shingles(t):
        w = [x.lower() for x in words(t)]
        return {tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    want = {}
    for i, t in rows:
        for item, u in items:
            own = shingles(u)
            if own and len(own & shingles(t)) >= 0.75 * len(own):
                want[i, item] = (len(own), len(own & shingles(t)))
    assert got == want and len(want) >= 6
    assert contamination.drop_contaminated(none, spark.createDataFrame(items, "item_id long, text string")).count() == 0
    left = contamination.drop_contaminated(docs, spark.createDataFrame([], "item_id long, text string"))
    assert left.count() == len(rows) and left.columns == docs.columns


# --- lines

def test_edit_distance():
    def plain(a, b):
        before = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row = [i]
            for j, y in enumerate(b, 1):
                row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
            before = row
        return before[-1]

    for _ in range(300):
        a, b = ([rng.choice("abc") for _ in range(rng.randrange(9))] for _ in range(2))
        for limit in range(9):
            assert lines.edit_within(a, b, limit) == (plain(a, b) <= limit)


def test_lines(spark, odd, none):
    long = prose(60)
    texts = [(3, "Same line here!\nother one\n\nsame LINE, here"), (1, "same line here"), (2, None), (5, "\n \n"),
             (6, " ".join(long)), (8, " ".join(long) + ".\n" + " ".join(prose(60)))]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_lines"], r["n_removed"], r["removed"]) for r in lines.repeated_lines(df).collect()}
    assert got == {3: (3, 2, [0, 3]), 1: (1, 0, []), 2: (0, 0, []), 5: (0, 0, []), 6: (1, 0, []), 8: (2, 1, [0])}
    cut = {r["doc_id"]: r["text"] for r in lines.drop_lines(df).collect()}
    assert cut[3] == "other one\n" and cut[2] is None and cut[1] == "same line here"
    assert lines.repeated_lines(odd).count() == 8 and lines.repeated_lines(none).count() == 0


def test_edited_lines(spark):
    """Lines of 1 to 60 words with up to a quarter (or a little more) of their words edited, against brute force."""
    draw = random.Random(8)
    texts, n = [], 0
    for size in [*range(1, 25), 30, 40, 50, 60]:
        for _ in range(3):
            base = [draw.choice(VOCAB) for _ in range(size)]
            texts.append((n, " ".join(base)))
            for off in {1, size // 4, size // 4 + 1}:
                edited = list(base)
                for at in range(off):
                    place = size * at // off if draw.random() < 0.7 else draw.randrange(size)
                    kind = draw.randrange(3)
                    if kind == 0 and place < len(edited):
                        edited[place] = f"e{draw.randrange(10 ** 6)}"
                    elif kind == 1:
                        edited.insert(place, draw.choice(VOCAB))
                    elif len(edited) > 1:
                        del edited[min(place, len(edited) - 1)]
                n += 1
                texts.append((n, " ".join(edited)))
            n += 1
    group = {i: i for i, _ in texts}
    for a, x in texts:
        for b, y in texts:
            if a < b and group[a] != group[b] and lines.similar(x.encode(), y.encode()):
                low, high = sorted((group[a], group[b]))
                group = {i: low if g == high else g for i, g in group.items()}
    df = spark.createDataFrame(texts, "doc_id long, text string")
    got = {r["doc_id"]: r["n_removed"] for r in lines.repeated_lines(df).collect()}
    assert got == {i: int(group[i] != i) for i, _ in texts}
    assert 60 < sum(got.values()) < len(texts)



def test_many_alike_lines(spark, tmp_path):
    """A cluster whose lists are too dense to be compared pair by pair; and what is settled on the way does not stay."""
    draw = random.Random(9)
    base = [f"w{i}" for i in range(12)]
    texts = [(0, " ".join(base))]
    for n in range(1, 400):
        edited = list(base)
        edited[11 - n % 2] = f"x{n}"
        texts.append((n, " ".join(edited)))
    texts += [(1000 + n, " ".join(f"y{draw.randrange(10 ** 6)}" for _ in range(12))) for n in range(50)]
    shared = spark.conf.get("spark.checkpoint.dir")
    df, before = spark.createDataFrame(texts, "doc_id long, text string"), set(os.listdir(shared))
    got = {r["doc_id"]: r["n_removed"] for r in lines.repeated_lines(df).collect()}
    assert got == {n: int(0 < n < 1000) for n, _ in texts}
    assert len({f for f in os.listdir(shared) if f.startswith("settled-")} - before) == 1


def test_words_of_lines():
    texts = ["Hello, World a\n\n b! c\n", "", "\u00e9t\u00e9 A\x0bB\x00c\td\r\ne", "...", "x" * 70000 + " y " + "z" * 40000, "Hello world A"]
    texts = [t.encode() for t in texts]
    words = lines.Words(texts)
    want = [(i, n, lines.normal_words(line)) for i, t in enumerate(texts) for n, line in enumerate(t.split(b"\n")) if lines.normal_words(line)]
    assert [*zip(words.owner.tolist(), words.number.tolist(), words.sizes.tolist(), strict=True)] == [(i, n, len(w)) for i, n, w in want]
    assert words.digests() == [hashlib.blake2b(b" ".join(w), digest_size=16).digest() for _, _, w in want]
    flat = [w for _, _, line in want for w in line]
    assert len({*zip(flat, words.hashes.tolist(), strict=True)}) == len(set(flat)) == len(set(words.hashes.tolist()))
    assert all(abs(np.searchsorted(lines._CLASSES, a, "right") - np.searchsorted(lines._CLASSES, b, "right")) <= lines._REACH
               for a in range(3, 700) for b in range(a - a // lines.ONE_IN, a))


# --- pseudonyms

def test_pseudonyms_round_trip(spark, none):
    text = ("card 4111 1111 1111 1111 or 4111-1111-1111-1111, not 4111111111111112; born 1980-02-29 or 02/29/1980, "
            "ip 10.0.0.1 not 300.1.1.1, call +1 (279) 555-0216, iban DE89 3704 0044 0532 0130 00, ssn 123-45-6789, "
            'mail John.Doe@mail.example.com token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" version 1.2.3 in 2024')
    df = spark.createDataFrame([(1, text, 9), (2, text, 9), (3, None, 9), (4, "", 9)], "doc_id long, text string, kind int")
    done = pseudonyms.pseudonymise(df, b"k")
    out = {r["doc_id"]: r for r in done.collect()}
    new = out[1]["text"]
    assert new == out[2]["text"] != text and out[3]["text"] is None and out[4]["findings"] == []
    for clear in ("4111 1111", "1980-02-29", "10.0.0.1", "555-0216", "0532 0130", "123-45-6789", "John.Doe", "24be64"):
        assert clear not in new
    for stays in ("4111111111111112", "300.1.1.1", "version 1.2.3 in 2024", "@mail.example.com"):
        assert stays in new
    kinds = [f["kind"] for f in out[1]["findings"]]
    assert kinds == ["card", "card", "date", "date", "ipv4", "phone", "iban", "ssn", "email", "secret"]
    values = [f["pseudonym"] for f in out[1]["findings"]]
    assert values[0].replace(" ", "") == values[1].replace("-", "")
    assert dt.datetime.strptime(values[2], "%Y-%m-%d") == dt.datetime.strptime(values[3], "%m/%d/%Y")
    digits = values[0].replace(" ", "")
    assert pseudonyms.luhn_digit(digits[:-1]) == int(digits[-1])
    back = pseudonyms.reveal(done.select("doc_id", "text"), b"k").where("doc_id = 1").first()["text"]
    assert back.lower() == text.lower()
    assert pseudonyms.pseudonymise(none, b"k").count() == 0


@pytest.mark.parametrize(("text", "kind", "found"), [
    ("Ask 8.8.8.8 now", "ipv4", "8.8.8.8"), ("4 1 1 1 1 1 1 1 1 1 1 1 1 1 1 1 ", "card", "4 1 1 1 1 1 1 1 1 1 1 1 1 1 1 1"),
])
def test_pseudonyms_without_digit_runs(text, kind, found):
    new, spans = pseudonyms.replace_in(text, pseudonyms.Keyed(b"k"))
    assert [(s["kind"], text[s["start"]:s["end"]]) for s in spans] == [(kind, found)] and found not in new
    assert pseudonyms.replace_in(new, pseudonyms.Keyed(b"k", back=True))[0] == text


@pytest.mark.parametrize(("text", "kind", "found"), [
    ("card 4111 1111 1111 1111 12/27", "card", "4111 1111 1111 1111"), ("4111111111111111 123", "card", "4111111111111111"),
    ("AT611904300234573201 BIC BKAUATWW", "iban", "AT611904300234573201"),
    ("ES91 2100 0418 4502 0005 1332 BIC X", "iban", "ES91 2100 0418 4502 0005 1332"),
    ("4111-1111-1111-1111", "card", "4111-1111-1111-1111"), ("DE89 3704 0044 0532 0130 00 EUR", "iban", "DE89 3704 0044 0532 0130 00"),
])
def test_pseudonyms_before_more_symbols(text, kind, found):
    new, spans = pseudonyms.replace_in(text, pseudonyms.Keyed(b"k"))
    assert [(s["kind"], text[s["start"]:s["end"]]) for s in spans] == [(kind, found)] and found not in new
    alone, _ = pseudonyms.replace_in(found, pseudonyms.Keyed(b"k"))
    assert spans[0]["pseudonym"] == alone
    assert pseudonyms.replace_in(new, pseudonyms.Keyed(b"k", back=True))[0] == text


def test_permutation_is_one():
    for size in (1, 2, 10, 365, 1000):
        image = [pseudonyms.permute(v, size, b"k", "t") for v in range(size)]
        assert sorted(image) == list(range(size))
        assert [pseudonyms.permute(v, size, b"k", "t", back=True) for v in image] == list(range(size))


# --- tokens and packing

def test_encoder_equals_library():
    library, fast = Tokenizer.from_file(VOCABULARY), tokens.Encoder(VOCABULARY)
    cases = ["", "a", "Hello  world\n\n x", "<|endoftext|> in text", "x" * 5000, "  " * 3000, "it's we'LL 12²3 é́ 　 \x85 \x1c"]
    cases += ["".join(chr(c) + "a " + chr(c) for c in range(s, s + 256) if not 0xD800 <= c < 0xE000) for s in range(0, 0x20000, 256)]
    for text in cases:
        assert fast(text).tolist() == library.encode(text, add_special_tokens=False).ids


def test_packing(docs, rows, odd, none):
    got = packing.pack(packing.token_pieces(docs, VOCABULARY, with_ids=True)).collect()
    library, pieces, bins = Tokenizer.from_file(VOCABULARY), defaultdict(list), defaultdict(list)
    for r in got:
        assert r["length"] == len(r["ids"]) <= 1024
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        pieces[r["doc_id"]].append(r)
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, t in rows:
        own = sorted(pieces[i], key=lambda r: r["piece"])
        assert sum((list(r["ids"]) for r in own), []) == [*library.encode(t or "", add_special_tokens=False).ids, 2]
        assert [r["start"] for r in own] == list(np.cumsum([0, *(r["length"] for r in own)])[:-1])
        assert all(r["length"] == 1024 for r in own[1:])
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 1024
    assert packing.pack(packing.token_pieces(odd, VOCABULARY)).count() == 8
    assert packing.pack(packing.token_pieces(none, VOCABULARY)).count() == 0


@pytest.mark.parametrize("lengths", [[1] * 3000, random.Random(1).choices(range(1, 1024), k=500)])
def test_best_fit_needs_few(spark, lengths):
    df = spark.createDataFrame(list(enumerate(lengths)), "item long, length long")
    placed = {r["item"]: (r["sequence_id"], r["offset"]) for r in packing.best_fit(df).collect()}
    assert len(placed) == len(lengths)
    bins = defaultdict(list)
    for item, (sequence, offset) in placed.items():
        bins[sequence].append((offset, lengths[item]))
    for held in bins.values():
        ends = 0
        for offset, length in sorted(held):
            assert offset == ends
            ends += length
        assert ends <= 1024
    assert len(bins) <= 1.02 * -(-sum(lengths) // 1024) + 2


def best_fit_decreasing(lengths):
    gaps = []
    for length in sorted(lengths, reverse=True):
        at = bisect.bisect_left(gaps, length)
        gap = gaps.pop(at) if at < len(gaps) else 1024
        bisect.insort(gaps, gap - length)
    return len(gaps)


@pytest.mark.parametrize("lengths", [
    [1000] * 500 + [24] * 500, [490] * 200 + [22] * 200, [994] * 100 + [24] * 90 + [6] * 150 + [3] * 20,
])
def test_small_pieces_fill_gaps(spark, lengths):
    df = spark.createDataFrame(list(enumerate(lengths)), "item long, length long")
    bins = defaultdict(list)
    for r in packing.best_fit(df).collect():
        bins[r["sequence_id"]].append((r["offset"], lengths[r["item"]]))
    assert sum(map(len, bins.values())) == len(lengths)
    for held in bins.values():
        assert [o for o, _ in sorted(held)] == list(np.cumsum([0, *(n for _, n in sorted(held))])[:-1])
        assert sum(n for _, n in held) <= 1024
    assert len(bins) <= best_fit_decreasing(lengths)


# --- pages

@pytest.mark.parametrize(("html", "text"), [
    ("", ""), ("plain", "plain"), ("<p>a<p>b", "a\n\nb"), ("<div>a</div><div>b</div>", "a\nb"),
    ("<ul><li>a<li>b<ol start=3><li>x<li>y</ol></ul>", "- a\n- b\n  3. x\n  4. y"),
    ("a<div hidden>no</div><span style='display: none'>no</span><script>no</script><!-- no -->b", "ab"),
    ("<table><tr><td>aa<td>b<tr><td>c<td>dd</table>", "aa  b\nc   dd"), ("x &lt;&amp;&nbsp;y", "x <& y"),
    ("<b>a</b> <i>b</i>c", "a bc"), ("a<br>b<br><br>c", "a\nb\n\nc"), ("<pre>a\n  b</pre>", "a\n  b"),
    ("<td>lone</td>", "lone"), ("</p></div>a<", "a<"), ("<a href='x>y'>t</a>", "t"), ("<p" + "<b>" * 3000 + "deep", "deep"),
])
def test_rendering(html, text):
    assert rendering.render(html) == text


@pytest.mark.parametrize(("html", "text"), [
    ("<table><thead><th>Name<th>Age<tbody><tr><td>Ann<td>5</table>", "Name  Age\nAnn   5"),
    ("<table><tbody><td>x</table>", "x"), ("<table><td>a<td>b<tr><td>c</table>", "a  b\nc"),
    ("<table><tbody>text<tr><td>x</table>", "text\nx"), ("<table><colgroup><col><td>x</table>", "x"),
    ("<div><table><tr><td>a<tbody><td>b</table></div>c", "a\nb\n\nc"),
    ("<table><td><table><tbody><td>in</table><td>out</table>", "in  out"),
    ("a <svg><title>no</title><desc>no</desc><path/><text>two</text><text>words</text></svg> b", "a two words b"),
    ("<svg><desc/><text>t</text></svg>", "t"), ("<svg/>rest", "rest"),
    ("<math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>no</annotation></math>", "x=2"),
])
def test_implied_rows_and_drawings(html, text):
    assert rendering.render(html) == text


def test_rendering_rows(spark):
    df = spark.createDataFrame([(1, "<p>a", "old"), (2, None, "old"), (2, None, "old")], "page_id long, html string, text string")
    assert sorted(str(r["text"]) for r in rendering.extract_text(df).collect()) == ["None", "None", "a"]
    assert rendering.extract_text(df.limit(0)).count() == 0


def test_all_visible_words_stay(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").limit(60).collect()
    for r in pages:
        body = re.sub(r"(?s)<(script|style|head)\b.*?</\1>|<!--.*?-->", " ", r["html"])
        want = re.sub(r"<[^>]*>", " ", body)
        from html import unescape
        assert sorted(unescape(want).split()) == sorted(w for w in rendering.render(r["html"]).split() if w != "-") or "-" in want


# --- shards

@pytest.mark.parametrize(("dims", "bits"), [(2, 4), (3, 3), (4, 2)])
def test_curve_visits_neighbours(dims, bits):
    cells = np.stack(np.meshgrid(*[np.arange(2 ** bits)] * dims, indexing="ij"), axis=-1).reshape(-1, dims)
    place = hilbert.curve_index(cells, bits)
    assert sorted(place) == list(range(len(cells)))
    steps = np.abs(np.diff(cells[np.argsort(place)], axis=0)).sum(axis=1)
    assert (steps == 1).all()


@pytest.mark.parametrize("page, text", [
    ("<table><tr><td>" * 3000 + "deep", "deep"), ("<table>" * 3000 + "deep", "deep"), ("<div>" * 30000 + "deep", "deep"),
    ("<table>" + "<tr><td rowspan=1000 colspan=1000>a<td>b" * 300 + "</table>", None),
    ("<table><tr>" + "<td rowspan=1000 colspan=1000>a" * 20 + "</table>", None),
    ("<span>" * 20000 + "<li>a" * 5000, None), ("<b>" * 20000 + "</i>" * 20000 + "end", "end"), ("<ul><li>" * 3000 + "deep", None),
])
def test_deep_and_wide_pages(page, text):
    """Nesting without bound and cells that span a million places take time in proportion to the page."""
    began = time.monotonic()
    got = rendering.render(page)
    assert time.monotonic() - began < 5 and len(got) < 100 * len(page)
    assert text is None or got.split() == [text]


def test_spanning_cells_hold_their_place():
    page = "<table><tr><td rowspan=3>a<td>b<td>c<tr><td>d<td>e<tr><td colspan=2>f<tr><td>g<td>h<td>i</table>"
    assert rendering.render(page).split("\n") == ["a  b  c", "   d  e", "   f", "g  h  i"]


def test_shards(spark, none):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs = docs.union(docs.limit(3)).union(docs.limit(2).select(F.lit(None), F.lit(None), F.lit(None), F.lit(None), F.lit(None)))
    got = hilbert.shard_documents(docs).collect()
    sizes = defaultdict(list)
    for r in got:
        sizes[r["shard"]].append(r["slot"])
    assert len(got) == docs.count() and sorted(sizes) == list(range(8))
    assert max(map(len, sizes.values())) - min(map(len, sizes.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in sizes.values())
    path = scratch_path(spark, "shards")
    hilbert.write_shards(docs, hilbert.shard_documents(docs), path)
    assert spark.read.parquet(path).count() == len(got)
    empty = spark.createDataFrame([], docs.schema)
    assert hilbert.shard_documents(empty).count() == 0


def test_long_common_starts_keep_their_order(spark):
    """Sources that differ only behind a long common start still are a dimension, in byte order; nulls lie first."""
    sources = [f"https://a.example/{i:03d}" for i in (5, 1, 3, 1)] + [None, "", "https://a.example/é"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(sources)], "n int, source string")
    got = {r["source"]: r["at"] for r in hilbert.with_text_order(df, "source", "at").collect()}
    assert got == {None: None, "": 0, "https://a.example/001": 1, "https://a.example/003": 3, "https://a.example/005": 4,
                   "https://a.example/é": 5}
    docs = spark.createDataFrame([(i, "t", "en", f"https://a.example/{i % 64:03d}") for i in range(640)],
                                 "doc_id long, text string, lang string, source string")
    placed = hilbert.shard_documents(docs).collect()
    assert len({r["curve"] for r in placed}) >= 30
    in_order = sorted(placed, key=lambda r: (r["shard"], r["slot"]))
    assert [r["curve"] for r in in_order] == sorted(r["curve"] for r in placed)


def test_shard_folders_beside_clashing_columns(spark):
    docs = spark.createDataFrame([(i, "t", "en", "s", 9) for i in range(16)], "doc_id long, text string, lang string, source string, shard_id int")
    path = scratch_path(spark, "shards")
    hilbert.write_shards(docs, hilbert.shard_documents(docs), path)
    got = spark.read.parquet(path)
    assert sorted(got.columns) == sorted([*docs.columns, "shard_id_"]) and got.where("shard_id = 9").count() == 16


# --- quality

def test_forward_backward_by_enumeration():
    unary, ties = np.array([0.3, -1.0, 2.0, 0.5, -0.2]), np.array([[0.4, -0.3], [0.1, 0.9]])
    counts = np.array([3, 0, 2])
    good, moves, norm = quality.forward_backward(unary, ties, counts)
    at, want, total = 0, [], 0.0
    for n in counts:
        if n == 0:
            continue
        weights = {}
        for code in range(2 ** n):
            y = [code >> k & 1 for k in range(n)]
            s = sum(unary[at + k] * y[k] for k in range(n)) + sum(ties[y[k], y[k + 1]] for k in range(n - 1))
            weights[tuple(y)] = np.exp(s)
        z = sum(weights.values())
        want += [sum(w for y, w in weights.items() if y[k]) / z for k in range(n)]
        total += np.log(z)
        at += n
    assert np.allclose(good, want) and np.isclose(norm, total) and np.isclose(moves.sum(), 3)


def test_quality_held_out(spark, docs, odd, none):
    table = lambda name: spark.read.parquet(f"/root/testdata/sf0.01/{name}.parquet")
    field = quality.fit(table("documents"), table("labels"))
    scored = quality.score(table("documents"), field).withColumn("held", quality.held_out(F.col("doc_id")))
    checked = scored.where("held").join(table("labels"), "doc_id").collect()
    right = sum((r["score"] >= quality.THRESHOLD) == bool(r["quality"]) for r in checked)
    assert right >= 0.97 * len(checked)
    held = {r["doc_id"] for r in checked}
    assert all(zlib.crc32(str(i).encode()) % 5 == 0 for i in held)
    for df in (docs, odd):
        scores = [r["score"] for r in quality.score(df.drop("score"), field).collect()]
        assert len(scores) == df.count() and all(0 <= s <= 1 for s in scores)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.drop_bad(none, labels).count() == 0
    assert quality.drop_bad(docs, labels).columns == docs.columns


# --- words

def test_runs_are_equal_for_equal_words():
    h = WordHasher()(words("a b c d e f a b c d e"))
    for n in (1, 2, 3, 5):
        r = runs(h, n)
        assert len(r) == 12 - n
        for i in range(len(r)):
            for j in range(len(r)):
                assert (r[i] == r[j]) == (list(h[i:i + n]) == list(h[j:j + n]))
    assert len(shingle_set(h[:0])) == 0 and len(shingle_set(h[:3])) == 1
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")
