"""Token ids of documents as binary files of Simple-8b words.

1. Texts are dealt by ranges of doc_id and sorted within them; each task encodes its range in
   that order. Words are encoded once per worker and kept in a table of bounded size: the
   tokenizer drops white space and never joins across it, so a text's ids are those of its
   words. ASCII capitals are lower-cased and closing punctuation is cut off first, neither of
   which changes an id, so that the table meets fewer words. The end id follows.
2. ``simple8b`` packs each document by itself. Each task strings its range together into files
   of ``FILE_WORDS`` words, written under another name and renamed when whole, so a task that
   runs twice leaves the same files. The table of files, stored by Spark, lists what belongs
   to the result.
3. Files are read back by tasks, decoded by selectors, and each document's ids are digested.

The number of ids before a document is the sum over the ranges before its own (one number per
shuffle partition meets in the driver), the files before its own in the range, and its place.

Defined cases: a null text is an empty one, which has only the end id; null doc_ids come first;
rows that share a doc_id follow by the CRC-32 of their text, and equal rows in any order; a text
of any length is encoded piece by piece, cut at blanks, and stays whole in one file; an empty
table writes no file and gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm import simple8b
from riskloom.llm.common import arrow_rows, shuffle_width, staged
from riskloom.session import work_folder

END_ID = 2
FILE_WORDS = 1 << 20
PIECE = 1 << 21  # bytes encoded at a time
TABLE = 500_000  # words a worker remembers, and
TABLE_BYTES = 1 << 25  # their length, before it starts anew
SUFFIX = ".s8b"
FILES = "part int, number int, file string, first bigint, n_docs bigint, n_ids bigint"
READ = "doc_id bigint, part int, at bigint, n_tokens bigint, ids_crc32 bigint"
# Closing punctuation behind a letter or digit (ASCII, or a lower-case letter up to U+00FF) is a token run of its own.
_CLOSING = re.compile(rb"[!-&(-/:-@[-`{-~](?:(?<=[a-z0-9].)|(?<=\xc3[\x9f-\xb6\xb8-\xbf].))[!-&(-/:-@[-`{-~]*(?=[ \n]|$)")
# Words of Latin letters that normal forms and lower case leave letters: one run of tokens each.
_LATIN = re.compile("[a-zß-öø-ÿ]+")


def _pieces(text: bytes) -> Iterator[bytes]:
    """The text in parts of about ``PIECE`` bytes, cut at blanks only."""
    at = 0
    while len(text) - at > PIECE:
        cut = text.find(b" ", at + PIECE)
        if cut < 0:
            break
        yield text[at:cut]
        at = cut
    yield text[at:]


def _words(text: bytes) -> list[bytes]:
    """Parts between ASCII white space, with the same tokens as the text."""
    if b"<|" not in text:  # strings of added tokens are told by their case
        text = _CLOSING.sub(rb" \g<0>", text.lower())
    return text.split()


class _Table:
    """Ids of the words met so far, as 32-bit integers."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a Spark task has one core
        from tokenizers import Tokenizer

        self.tokenizer, self.known, self.size = Tokenizer.from_file(path), {}, 0
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        suffix = self.tokenizer.model.end_of_word_suffix or ""
        self.ends = np.zeros(self.tokenizer.get_vocab_size(with_added_tokens=True), bool)
        self.ends[[i for piece, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if suffix and piece.endswith(suffix)]] = True

    def _learn_run(self, words: list[bytes], joined: str) -> None:
        """Words of one token run each: encoded as one text and told apart by the ids that end a word."""
        (coded,) = self.tokenizer.encode_batch_fast([joined], add_special_tokens=False)
        ids = np.array(coded.ids, np.uint32)
        stops = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
        raw, start = ids.tobytes(), 0
        for word, stop in zip(words, stops, strict=True):
            self.known[word] = raw[start:stop]
            start = stop

    def learn(self, words: set[bytes]) -> None:
        plain, texts, other, runs = [], [], [], self.ends.any()
        for word in words:
            text = word.decode()
            self.size += len(word)
            if runs and _LATIN.fullmatch(text):
                plain.append(word)
                texts.append(text)
            else:
                other.append((word, text))
        if plain:
            self._learn_run(plain, " ".join(texts))
        coded = self.tokenizer.encode_batch_fast([t for _, t in other], add_special_tokens=False)
        for (word, _), c in zip(other, coded, strict=True):
            self.known[word] = array("I", c.ids).tobytes()

    def ids(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text as 32-bit integers."""
        if len(self.known) > TABLE or self.size > TABLE_BYTES:
            self.known, self.size = {}, 0
        split = [_words(t) for t in texts]
        found = [list(map(self.known.get, words)) for words in split]
        gaps = [[i for i, x in enumerate(ids) if x is None] if None in ids else [] for ids in found]
        self.learn({words[i] for words, places in zip(split, gaps, strict=True) for i in places})
        for words, ids, places in zip(split, found, gaps, strict=True):
            for i in places:
                ids[i] = self.known[words[i]]
        return [b"".join(ids) for ids in found]


@cache
def _table(path: str) -> _Table:
    """One table per worker process, which later tasks find filled."""
    return _Table(path)


def _arrow(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


_FILES = pa.schema([("part", pa.int32()), ("number", pa.int32()), ("file", pa.string()), ("first", pa.int64()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])
_READ = pa.schema([("doc_id", pa.int64()), ("part", pa.int32()), ("at", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def _packed(batches: Iterator[pa.RecordBatch], path: str, end_id: int, group: int) -> Iterator[tuple]:
    """doc_ids, lengths and packed words of some documents at a time. Ids have 32 bits, so there are no escapes."""
    end, table = array("I", [end_id]).tobytes(), _table(path)

    def pack(doc_ids: list, raw: list[bytes]) -> tuple:
        raw = [r + end for r in raw]
        lengths = [len(r) // 4 for r in raw]
        return doc_ids, lengths, simple8b.pack(np.frombuffer(b"".join(raw), np.uint32), np.cumsum(lengths))[0]

    for batch in batches:
        doc_ids, texts, size = [], [], 0
        for doc_id, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            text = value.as_py() or b""
            if size and size + len(text) > group:
                yield pack(doc_ids, table.ids(texts))
                doc_ids, texts, size = [], [], 0
            if len(text) > PIECE:
                yield pack([doc_id], [b"".join(table.ids([p])[0] for p in _pieces(text))])
                continue
            doc_ids.append(doc_id)
            texts.append(text)
            size += len(text)
        if texts:
            yield pack(doc_ids, table.ids(texts))


def _filesystem(folder: str) -> tuple[fs.FileSystem, str]:
    """Any store that pyarrow knows; ``file:/x`` is the path /x."""
    return fs.FileSystem.from_uri(re.sub("^file:/*", "/", folder))


def _write(path: str, folder: str, end_id: int, file_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _filesystem(folder)
        context = TaskContext.get()
        part, number, first = context.partitionId(), 0, 0
        docs, lengths, words, n_words = [], [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal number, first, docs, lengths, words, n_words
            content = simple8b.to_file(part, first, docs, np.array(lengths), np.concatenate(words), np.zeros(0, np.uint64))
            name = f"part-{part:06d}-{number:06d}{SUFFIX}"
            trial = f"{root}/.{name}.{context.taskAttemptId()}"
            with store.open_output_stream(trial) as out:
                out.write(content)
            store.move(trial, f"{root}/{name}")
            row = (part, number, name, first, len(docs), sum(lengths))
            number, first = number + 1, first + sum(lengths)
            docs, lengths, words, n_words = [], [], [], 0
            return _arrow([row], _FILES)

        for some_docs, some_lengths, some_words in _packed(batches, path, end_id, min(PIECE, 8 * file_words)):
            docs += some_docs
            lengths += some_lengths
            words.append(some_words)
            n_words += len(some_words)
            if n_words >= file_words:
                yield flush()
        if docs:
            yield flush()

    return run


def _read(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _filesystem(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with store.open_input_stream(f"{root}/{name}") as source:
                    coded = simple8b.from_file(source.read())
                ids = memoryview(coded.numbers().astype("<u4")).cast("B")
                rows, starts = [], coded.starts.tolist()
                for doc_id, a, b in zip(coded.doc_id, starts[:-1], starts[1:], strict=True):
                    rows.append((doc_id, coded.part, coded.first + a, b - a, zlib.crc32(ids[4 * a : 4 * b])))
                yield _arrow(rows, _READ)

    return run


def write_token_files(docs: DataFrame, path: str, folder: str, end_id: int = END_ID, file_words: int = FILE_WORDS) -> DataFrame:
    """Writes the documents' ids to ``folder`` and returns the table of files, ``FILES``."""
    spark = docs.sparkSession
    arrow_rows(spark)
    store, root = _filesystem(folder)
    store.create_dir(root, recursive=True)
    text = F.col("text").cast("string")
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.cast("binary").alias("text"))
    # the row number lets ranges split equal documents
    keyed = texts.withColumns({"crc": F.crc32(F.coalesce("text", F.lit(b""))), "row": F.monotonically_increasing_id()})
    order = ["doc_id", "crc", "row"]
    dealt = keyed.repartitionByRange(shuffle_width(spark), *order).sortWithinPartitions(*order)
    return staged(dealt.select("doc_id", "text").mapInArrow(_write(path, folder, end_id, file_words), FILES), "token-files")


def read_token_files(spark: SparkSession, files: DataFrame, folder: str) -> DataFrame:
    """One row per document of the listed files: doc_id, start, n_tokens, ids_crc32."""
    ranges = files.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()  # at most one row per shuffle partition
    starts, total = [], 0
    for r in sorted(ranges, key=lambda r: r["part"]):
        starts.append((r["part"], total))
        total += r["n"]
    before = spark.createDataFrame(starts, "part int, before bigint")
    read = files.select("file").repartition(shuffle_width(spark)).mapInArrow(_read(folder), READ)
    found = read.join(F.broadcast(before), "part")
    return found.select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def token_files(docs: DataFrame, path: str, end_id: int = END_ID) -> DataFrame:
    """Writes the ids to a new folder of the shared one and returns what is read back from there."""
    spark = docs.sparkSession
    folder = work_folder(spark, "tokens")
    return read_token_files(spark, write_token_files(docs, path, folder, end_id), folder)
