"""Token ids in Arrow stream files of equal-length sequences.

A file is an Arrow IPC stream without compression. Its rows are sequences of ``LENGTH`` ids with a mask as long, both
fixed-size lists (ids of 16 bits where the vocabulary allows, else 32); a batch holds ``ROWS`` of them, the last one of a file what is left. Equal batches take equally many
bytes, so sequence ``i`` lies at a place that follows from ``i`` by arithmetic: a memory-mapped file gives it without
reading anything else and without copying. The mask is 1 on ids, 2 on the last id of a document and 0 on the padding of
a file's last sequence. Beside each token file lies a stream file of the ids of its documents in the same order.

Documents are range-sorted by doc_id, and every task writes the files of its own range under names no other attempt
uses; a file ends with the document that fills its ``PER_FILE`` sequences. The rows that tell of them are written as the table ``files``; Spark commits
those of one attempt per task, and a file that is not named there does not belong to the data set. So a lost executor
costs its tasks and nothing else. Starts are running sums over that table.

A null text is empty and gives the end id alone. Documents with a null doc_id come first; documents with equal ids are
ordered by a hash of their text, equal rows come one after the other. A document may span sequences and batches, not files.
An empty table gives a data set without files. Other columns of the documents are ignored.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tiktoken
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from slowtrace.llm.tokens import byte_of_symbol

LENGTH, ROWS, PER_FILE = 1024, 256, 64 * 256
PORTION = 4 * 2 ** 20  # bytes of text encoded at once
END = 2
TOKEN, LAST = 1, 2  # in a mask; 0 is padding
_TELLS = ("task int, nth int, path string, length int, rows int, bits int, header long, batch_bytes long, n_sequences long, "
          "n_tokens long, n_documents long")


class WordEncoder:
    """Ids of texts by a file of the tokenizers library, one look-up per word that was met before.

    Where the file's rules drop white space before anything is merged, white space parts any two words and a text has
    the ids of its words one after the other. Texts of one call are split together, so a word is looked up once a call, and
    new words are encoded together. Words met are remembered up to a bound, then forgotten all at once; a text
    with a word longer than ``longest`` bytes and files with other rules go to the library text by text.
    """

    def __init__(self, path: str, remember: int = 600_000, longest: int = 200):
        self._library, self._remember, self._longest = Tokenizer.from_file(path), remember, longest
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self._by_word = _parts_at_blanks(spec) and self._blanks_part()
        self._merges = _merges(spec) if self._by_word else None
        if self._merges is not None:
            self._cut_or_line = regex.compile(
                spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"].replace(r"\s", _BLANKS) + r"|\n")
            self._ends_piece = np.zeros(self._merges.n_vocab, bool)
            self._ends_piece[[i for b, i in self._merges._mergeable_ranks.items() if b.endswith(b" ")]] = True
            self._added = regex.compile("|".join(regex.escape(t["content"]) for t in spec["added_tokens"]) or r"(?!)")
        self.size = self._library.get_vocab_size()
        self._forget()

    def _forget(self) -> None:
        self._known: dict[bytes, int] = {b"": 0}
        self._flat = np.empty(0, np.uint32)
        self._begins, self._sizes = np.zeros(1, np.int64), np.zeros(1, np.int64)

    def _whole(self, text: str) -> list[int]:
        return self._library.encode(text, add_special_tokens=False).ids

    def _blanks_part(self) -> bool:
        return all(self._whole(a + gap + b) == self._whole(a) + self._whole(b)
                   for a, b in (("ab", "cd"), ("1", "2"), ("a.", "'s"), (".", "!"))
                   for gap in (" ", "  ", "\n", "\t", "\r\n", "\x0b", "\x0c"))

    def _learn(self, words: list[bytes]) -> None:
        """Ids of words not met before, by the same merges in tiktoken where their letters are ones both lower alike."""
        texts = b"\n".join(words).decode("utf-8", "replace").split("\n")
        found, sizes = [], np.zeros(len(words), np.int64)
        quick, slow = [], []
        for i, text in enumerate(texts):
            (quick if self._merges is not None and (text.isascii() or not _RARE.search(text)) else slow).append(i)
        if quick and self._added.search("\n".join([texts[i] for i in quick])):
            slow += [i for i in quick if self._added.search(texts[i])]
            quick = [i for i in quick if not self._added.search(texts[i])]
        if quick:
            ids, sizes[quick] = self._quick([texts[i] for i in quick])
            found.append((quick, ids))
        if slow:
            ids = [self._whole(texts[i]) for i in slow]
            sizes[slow] = [len(i) for i in ids]
            found.append((slow, np.fromiter(chain.from_iterable(ids), np.uint32)))
        # ids of quick words and of others lie apart
        begins = np.empty(len(words), np.int64)
        at = len(self._flat)
        for which, ids in found:
            begins[which] = at + np.cumsum(sizes[which]) - sizes[which]
            at += len(ids)
        self._flat = np.concatenate([self._flat, *[ids for _, ids in found]])
        self._begins, self._sizes = np.append(self._begins, begins), np.append(self._sizes, sizes)
        self._known.update(zip(words, range(len(self._known), len(self._known) + len(words)), strict=True))

    def _quick(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all ``texts`` one after the other, and how many each has; a piece ends with an id that holds a blank."""
        pieces = self._cut_or_line.findall("\n".join([t.lower() for t in texts]) + "\n")
        line = np.fromiter((p == "\n" for p in pieces), bool, len(pieces))
        ids = np.array(self._merges.encode_ordinary(" ".join([p for p in pieces if p != "\n"]) + " " if len(pieces) > len(texts) else ""),
                       np.uint32)
        # after how many ids each piece, and each text, is done
        done = np.append(0, np.flatnonzero(self._ends_piece[ids]) + 1)[np.cumsum(~line)[line]]
        return ids, np.diff(done, prepend=0)

    def __call__(self, texts: list[bytes]) -> list[np.ndarray]:
        if not self._by_word:
            return [self._by_library(text) for text in texts]
        # Arrow splits at the six ASCII blanks, as bytes.split does; an empty word has no ids
        split = pc.ascii_split_whitespace(pa.array(texts, pa.large_binary()).view(pa.large_string()))
        words = split.flatten().dictionary_encode()
        distinct, owner = words.dictionary.view(pa.large_binary()).to_pylist(), words.indices.to_numpy()
        numbers, borders = self._numbers(distinct), split.offsets.to_numpy() - split.offsets[0].as_py()
        begins, sizes = self._begins[numbers][owner], self._sizes[numbers][owner]
        done = np.cumsum(sizes)
        ids = self._flat[np.arange(int(done[-1]) if len(done) else 0) + np.repeat(begins - done + sizes, sizes)]
        ends = np.append(0, done)[borders].tolist()
        out = [ids[begin:end] for begin, end in zip(ends, ends[1:])]
        long = pc.binary_length(words.dictionary).to_numpy(zero_copy_only=False) > self._longest
        for i in set((np.searchsorted(borders, np.flatnonzero(long[owner]), side="right") - 1).tolist()) if long.any() else ():
            out[i] = self._by_library(texts[i])
        return out

    def _by_library(self, text: bytes) -> np.ndarray:
        return np.array(self._whole(text.decode("utf-8", "replace")), np.uint32)

    def _numbers(self, words: list[bytes]) -> np.ndarray:
        """The numbers of different ``words``, by which their ids are known; a word over ``longest`` gets that of no ids."""
        numbers = np.fromiter((self._known.get(word, -1) for word in words), np.int64, len(words))
        new = [i for i in np.flatnonzero(numbers < 0).tolist() if len(words[i]) <= self._longest]
        if len(self._known) + len(new) > self._remember:
            self._forget()
            numbers[:] = -1
            new = [i for i, word in enumerate(words) if 0 < len(word) <= self._longest]
        if new:
            numbers[new] = np.arange(len(self._known), len(self._known) + len(new))
            self._learn([words[i] for i in new])
        return np.maximum(numbers, 0)


#: White space below U+0250; beyond that, letters and spaces are left to the library.
_BLANKS = "\\t\\n\\x0b\\x0c\\r \\x85\\xa0"
_RARE = regex.compile("[^\\x00-\\u024f]")


def _merges(spec: dict) -> tiktoken.Encoding | None:
    """The merges of a file that marks ends of words, in tiktoken: a blank behind each word stands for the mark.

    The merges of such a file are numbered in their order behind the bytes, bare and marked, which is how tiktoken
    ranks them. None for files of another make.
    """
    model, cuts = spec["model"], (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
    mark, special = model.get("end_of_word_suffix"), {t["content"] for t in spec["added_tokens"]}
    if not mark or len(cuts) != 2 or cuts[1]["type"] != "ByteLevel" or cuts[1]["use_regex"] or cuts[1]["add_prefix_space"]:
        return None
    if len(model["vocab"]) - len(special & model["vocab"].keys()) != 512 + len(model["merges"]):
        return None
    symbols, ranks = byte_of_symbol(), {}
    for token, i in model["vocab"].items():
        if token not in special:
            bare = token.removesuffix(mark)
            ranks[bytes(symbols[c] for c in bare) + (b" " if bare != token else b"")] = i
    for i, pair in enumerate(model["merges"]):
        left, right = pair.split(" ") if isinstance(pair, str) else pair
        if model["vocab"].get(left + right) != 512 + i:
            return None
    return tiktoken.Encoding("words", pat_str="[^ ]+ ", mergeable_ranks=ranks, special_tokens={})


def _parts_at_blanks(spec: dict) -> bool:
    """Whether the rules of a tokenizer file can be followed word by word."""
    rules = spec["normalizer"] or {"type": "Sequence", "normalizers": []}
    cuts = (spec["pre_tokenizer"] or {}).get("pretokenizers", [spec["pre_tokenizer"] or {}])
    return (all(n["type"] in ("NFC", "Replace", "Lowercase") for n in rules.get("normalizers", [rules]))
            and cuts[0].get("type") == "Split" and cuts[0]["behavior"] == "Removed" and cuts[0]["invert"]
            and not any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"])
            and spec["model"]["type"] == "BPE" and not spec["model"].get("dropout"))


@cache
def encoder(path: str) -> WordEncoder:
    """One encoder per worker process and file."""
    return WordEncoder(path)


# --- the file format ------------------------------------------------------------------------------------------------

def sequence_schema(length: int, bits: int) -> pa.Schema:
    """Ids of 16 or 32 bits."""
    ids = pa.uint16() if bits == 16 else pa.uint32()
    return pa.schema([pa.field("ids", pa.list_(ids, length), False), pa.field("mask", pa.list_(pa.uint8(), length), False)])


def _batch(ids: np.ndarray, mask: np.ndarray, length: int, bits: int) -> pa.RecordBatch:
    schema, ids = sequence_schema(length, bits), ids.astype(np.uint16 if bits == 16 else np.uint32)
    return pa.RecordBatch.from_arrays([
        pa.FixedSizeListArray.from_arrays(pa.array(ids), length), pa.FixedSizeListArray.from_arrays(pa.array(mask), length),
    ], schema=schema)


class _Writer:
    """One token file and its file of document ids; rows are written as soon as a batch is full."""

    def __init__(self, folder: str, id_type: pa.DataType, length: int, rows: int, bits: int):
        self.length, self.rows, self.bits = length, rows, bits
        place, root = fs.FileSystem.from_uri(folder)
        self.path = f"tokens-{uuid.uuid4().hex}.arrows"
        self._out = place.open_output_stream(f"{root}/{self.path}")
        self._stream = pa.ipc.new_stream(self._out, sequence_schema(length, bits))
        self.header, self.batch_bytes = 0, 0
        self._id_out = place.open_output_stream(f"{root}/{self.path}.docs")
        self._id_stream = pa.ipc.new_stream(self._id_out, pa.schema([("doc_id", id_type)]))
        self._ids: list[np.ndarray] = []
        self._masks: list[np.ndarray] = []
        self._doc_ids: list = []
        self._id_type, self._waiting = id_type, 0
        self.n_tokens = self.n_documents = self.n_sequences = 0

    def add(self, ids: np.ndarray, mask: np.ndarray) -> None:
        self._ids.append(ids)
        self._masks.append(mask)
        self._waiting += len(ids)
        self.n_tokens += len(ids)
        if self._waiting >= self.length * self.rows:
            self._flush(False)

    def ended(self, doc_id) -> None:
        """A document has its last token in this file."""
        self.n_documents += 1
        self._doc_ids.append(doc_id)
        if len(self._doc_ids) >= 65_536:
            self._flush_ids()

    def _flush_ids(self) -> None:
        if self._doc_ids:
            self._id_stream.write_batch(pa.RecordBatch.from_arrays([pa.array(self._doc_ids, self._id_type)], ["doc_id"]))
            self._doc_ids = []

    def _flush(self, final: bool) -> None:
        ids, mask = np.concatenate(self._ids), np.concatenate(self._masks)
        full = self.length * self.rows
        for start in range(0, len(ids) if final else len(ids) // full * full, full):
            part, seen = ids[start:start + full], mask[start:start + full]
            if len(part) % self.length:
                pad = -len(part) % self.length
                part, seen = np.pad(part, (0, pad)), np.pad(seen, (0, pad))
            before = self._out.tell()
            self._stream.write_batch(_batch(part, seen, self.length, self.bits))
            if not self.n_sequences:
                # the schema is written before the first batch, if not earlier
                self.batch_bytes = pa.ipc.get_record_batch_size(_batch(part, seen, self.length, self.bits))
                self.header = self._out.tell() - self.batch_bytes
            elif len(part) == full and self._out.tell() - before != self.batch_bytes:
                raise AssertionError("batches of one file differ in size")
            self.n_sequences += len(part) // self.length
        rest = 0 if final else len(ids) % full
        self._ids, self._masks = ([ids[-rest:]], [mask[-rest:]]) if rest else ([], [])
        self._waiting = rest

    def close(self) -> None:
        if self._waiting:
            self._flush(True)
        self._flush_ids()
        for each in (self._stream, self._out, self._id_stream, self._id_out):
            each.close()


def _portions(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """(first row, rows) of portions that begin within different ``PORTION`` bytes; a long row goes with those before it."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    _, firsts = np.unique((np.cumsum(sizes) - sizes) // PORTION, return_index=True)
    edges = [*firsts.tolist(), len(texts)]
    for first, end in zip(edges, edges[1:]):
        yield first, end - first


def _write(vocabulary: str, folder: str, length: int, rows: int, per_file: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task = encoder(vocabulary), TaskContext.get().partitionId()
        bits = 16 if encode.size <= 2 ** 16 else 32
        done: list[tuple] = []
        writer: _Writer | None = None

        def close() -> None:
            writer.close()
            done.append((task, len(done), writer.path, length, rows, bits, writer.header, writer.batch_bytes, writer.n_sequences,
                         writer.n_tokens, writer.n_documents))

        for batch in batches:
            doc_ids = batch.column("doc_id")
            for start, rows_here in _portions(batch.column("text")):
                part = batch.column("text").slice(start, rows_here).cast(pa.binary()).to_pylist()
                for i, ids in enumerate(encode([text or b"" for text in part])):
                    ids = np.append(ids, np.uint32(END))
                    mask = np.full(len(ids), TOKEN, np.uint8)
                    mask[-1] = LAST
                    if writer is None:
                        writer = _Writer(folder, doc_ids.type, length, rows, bits)
                    writer.add(ids, mask)
                    writer.ended(doc_ids[start + i].as_py())
                    if writer.n_tokens >= per_file * length:
                        close()
                        writer = None
        if writer is not None:
            close()
        if done:
            columns = [pa.array(c) for c in zip(*done, strict=True)]
            types = [pa.int32(), pa.int32(), pa.string(), *[pa.int32()] * 3, *[pa.int64()] * 5]
            names = ["task", "nth", "path", "length", "rows", "bits", "header", "batch_bytes", "n_sequences", "n_tokens",
                     "n_documents"]
            yield pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(columns, types, strict=True)], names)
    return run


# --- writing and reading data sets ----------------------------------------------------------------------------------

def write_sequences(docs: DataFrame, vocabulary: str, folder: str, length: int = LENGTH, rows: int = ROWS,
                    per_file: int = PER_FILE) -> None:
    """Write the ids of all ``docs`` (doc_id, text) as a new data set below ``folder``, which all executors can reach.

    ``rows`` sequences make a batch.
    """
    spark = docs.sparkSession
    tie = F.xxhash64("text")
    # the files are written by the tasks: the folder must be there before them
    place, root = fs.FileSystem.from_uri(_uri(folder))
    place.create_dir(f"{root}/tokens", recursive=True)
    ordered = (docs.select("doc_id", "text").repartitionByRange("doc_id", tie).sortWithinPartitions("doc_id", tie))
    told = ordered.mapInArrow(_write(vocabulary, f"{_uri(folder)}/tokens", length, rows, per_file), _TELLS)
    told.write.parquet(f"{folder}/told")
    own = spark.read.schema(_TELLS).parquet(f"{folder}/told")
    # one row per file: a running sum over files, not over documents
    order = Window.orderBy("task", "nth").rowsBetween(Window.unboundedPreceding, -1)
    own = own.withColumns({f"before_{c}": F.coalesce(F.sum(f"n_{c}").over(order), F.lit(0))
                           for c in ("sequences", "tokens", "documents")})
    number = F.row_number().over(Window.orderBy("task", "nth")) - 1
    (own.withColumns({"file": number, "id_type": F.lit(docs.schema["doc_id"].dataType.simpleString())})
     .drop("task", "nth").write.parquet(f"{folder}/files"))


def _uri(folder: str) -> str:
    return folder.rstrip("/") if "://" in folder or folder.startswith("file:") else f"file://{folder.rstrip('/')}"


def files(spark: SparkSession, folder: str) -> DataFrame:
    """One row per file of the data set: its path, layout, counts, and the counts before it."""
    return spark.read.parquet(f"{folder}/files")


def _source(folder: str, path: str):
    """The file as one buffer where it can be mapped, else as a seekable file."""
    place, root = fs.FileSystem.from_uri(f"{_uri(folder)}/tokens")
    if isinstance(place, fs.LocalFileSystem):
        return pa.memory_map(f"{root}/{path}")
    return place.open_input_file(f"{root}/{path}")


@dataclass(frozen=True)
class SequenceFile:
    """Random access to one file, by a row of :func:`files`."""
    folder: str
    path: str
    length: int
    rows: int
    bits: int
    header: int
    batch_bytes: int
    n_sequences: int

    def batches(self, first: int = 0, last: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ids, mask) of batches ``first`` to ``last`` (excluded), rows x length; views of a mapped file."""
        schema = sequence_schema(self.length, self.bits)
        end = -(-self.n_sequences // self.rows)
        source = _source(self.folder, self.path)
        for k in range(first, end if last is None else min(last, end)):
            source.seek(self.header + k * self.batch_bytes)
            got = pa.ipc.read_record_batch(pa.ipc.read_message(source), schema)
            yield tuple(c.flatten().to_numpy(zero_copy_only=True).reshape(-1, self.length) for c in got.columns)

    def __getitem__(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, mask) of sequence ``i``."""
        if not 0 <= i < self.n_sequences:
            raise IndexError(i)
        ids, mask = next(self.batches(i // self.rows, i // self.rows + 1))
        return ids[i % self.rows], mask[i % self.rows]

    def doc_ids(self) -> Iterator[pa.Array]:
        """Ids of the documents that end in this file, in order."""
        place, root = fs.FileSystem.from_uri(f"{_uri(self.folder)}/tokens")
        with place.open_input_stream(f"{root}/{self.path}.docs") as source, pa.ipc.open_stream(source) as stream:
            for batch in stream:
                yield batch.column(0)


class Sequences:
    """All sequences of a data set by number, without Spark work per access; the list of files is held here."""

    def __init__(self, spark: SparkSession, folder: str):
        rows = files(spark, folder).orderBy("file").collect()  # one row per file
        self._files = [SequenceFile(folder, r["path"], r["length"], r["rows"], r["bits"], r["header"], r["batch_bytes"],
                                    r["n_sequences"]) for r in rows]
        self._firsts = np.array([r["before_sequences"] for r in rows], np.int64)
        self._n = sum(f.n_sequences for f in self._files)

    def __len__(self) -> int:
        return self._n

    def __getitem__(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        if not 0 <= i < self._n:
            raise IndexError(i)
        at = int(np.searchsorted(self._firsts, i, side="right")) - 1
        return self._files[at][i - int(self._firsts[at])]


def _read(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                own = SequenceFile(folder, row["path"], row["length"], row["rows"], row["bits"], row["header"],
                                   row["batch_bytes"], row["n_sequences"])
                names, at = own.doc_ids(), row["before_tokens"]
                waiting, begun, crc = next(names), at, 0
                for ids, mask in own.batches():
                    ids, mask = ids.reshape(-1).astype("<u4"), mask.reshape(-1)
                    n, done = int(np.count_nonzero(mask)), 0  # padding comes last
                    out = []
                    for end in (np.flatnonzero(mask == LAST) + 1).tolist():
                        out.append((begun, at + end - begun, zlib.crc32(ids[done:end], crc)))
                        begun, crc, done = at + end, 0, end
                    crc = zlib.crc32(ids[done:n], crc)
                    at += n
                    while len(waiting) < len(out):
                        waiting = pa.concat_arrays([waiting, next(names)])
                    if out:
                        columns = [pa.array(c, pa.int64()) for c in zip(*out, strict=True)]
                        yield pa.RecordBatch.from_arrays([waiting[:len(out)], *columns],
                                                         ["doc_id", "start", "n_tokens", "ids_crc32"])
                        waiting = waiting[len(out):]
    return run


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files alone, one file per row of work."""
    own = files(spark, folder)
    head = own.select("id_type").first()
    schema = f"doc_id {head['id_type'] if head else 'long'}, start long, n_tokens long, ids_crc32 long"
    return own.repartition("path").mapInArrow(_read(folder), schema)
