"""Encoding and decoding of a corpus with a public byte-level BPE vocabulary."""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tiktoken
from pyspark import SparkFiles, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.session import materialize

TOKENIZERS = os.environ.get("STRANDLOOM_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"

# Fixed value: the split pattern published with the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# White space as the vocabulary's library sees it (Unicode's property), then the same pattern for ASCII texts.
_WIDE = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+""")
_ASCII = re.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+""")

#: Text per dictionary chunk, in characters, and distinct words at which a chunk ends early.
CHUNK_CHARS = 8_000_000
CHUNK_WORDS = 400_000


def pre_tokens(text: str) -> list[str]:
    """The pieces into which the vocabulary's pattern cuts a text; together they are the text."""
    return (_ASCII if text.isascii() else _WIDE).findall(text)


def vocabulary_path(folder: str = TOKENIZERS, name: str = VOCABULARY) -> str:
    return os.path.join(folder, name)


def ship_vocabulary(spark: SparkSession, path: str) -> str:
    """Send a vocabulary file to the executors with the job; returns the name by which tasks ask for it."""
    spark.sparkContext.addFile(path)
    return os.path.basename(path)


def shipped_encoder(name: str) -> tiktoken.Encoding:
    """In a task: the encoder of a vocabulary sent by :func:`ship_vocabulary`."""
    return encoder(SparkFiles.get(name))


@lru_cache(4)
def encoder(path: str) -> tiktoken.Encoding:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


class _Codes(dict):
    """Numbers words in order of first use."""

    def __missing__(self, word: str) -> int:
        self[word] = code = len(self)
        return code


def _lists(values: np.ndarray, lengths: list[int], kind: pa.DataType) -> pa.Array:
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def _packed(numbers: np.ndarray) -> bytes:
    """Numbers of four bytes, compressed byte by byte: the upper ones are nearly always 0."""
    return pa.compress(np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), codec="zstd", asbytes=True)


def _unpacked(data: pa.BinaryScalar, count: int) -> np.ndarray:
    raw = pa.decompress(data.as_buffer(), 4 * count, codec="zstd")
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def explode_pre_tokens(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Pre-tokens with positions, word by number: (chunk, docs, sizes, codes, words).

    A row of documents has their ids, how many pre-tokens each of them has, and the
    numbers of all of these in order of position; one row per chunk has the chunk's
    distinct words in order of number. So a word is sent on once per chunk, however
    often it occurs.
    """
    rows = docs.select(F.col(doc_id).alias("doc"), F.col(text).alias("text"))
    doc_type = rows.schema["doc"].dataType.simpleString()
    names = ["chunk", "docs", "sizes", "codes", "words"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        seq, chars, known = 0, 0, _Codes()

        def row(ids: pa.Array | None, sizes: list[int] | None, codes: bytes | None, words: list[str] | None) -> pa.RecordBatch:
            held = pa.nulls(1, pa.list_(kind)) if ids is None else pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
            return pa.RecordBatch.from_arrays([pa.array([(part << 32) + seq], pa.int64()), held, pa.array([sizes], pa.list_(pa.int32())), pa.array([codes], pa.binary()), pa.array([words], pa.list_(pa.string()))], names)

        kind = pa.int64()
        for b in batches:
            kind = b.column(0).type
            ids, codes, start = b.column(0), [], 0
            for i, value in enumerate(b.column(1)):
                text_here = value.as_py() or ""
                words = pre_tokens(text_here)
                codes.append(np.fromiter(map(known.__getitem__, words), np.uint32, len(words)))
                chars += len(text_here)
                full = chars >= CHUNK_CHARS or len(known) >= CHUNK_WORDS
                if full or i == b.num_rows - 1:
                    yield row(ids.slice(start, i + 1 - start), [len(c) for c in codes], _packed(np.concatenate(codes)), None)
                    start, codes = i + 1, []
                if full:
                    yield row(None, None, None, list(known))
                    seq, chars, known = seq + 1, 0, _Codes()
        if chars or known:
            yield row(None, None, None, list(known))

    return rows.mapInArrow(cut, f"chunk long, docs array<{doc_type}>, sizes array<int>, codes binary, words array<string>")


def _by_chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words' ids (of, code, ids) put together by chunk before they are sent: (of, codes, sizes, ids), packed."""
    for b in batches:
        if not b.num_rows:
            continue
        chunk = b.column("of").to_numpy()
        order = np.argsort(chunk, kind="stable")
        code, lists = b.column("code").to_numpy()[order], b.column("ids").take(pa.array(order))
        begin = lists.offsets.to_numpy()
        sizes, flat = np.diff(begin), lists.values.to_numpy(zero_copy_only=False)
        first = np.flatnonzero(np.append(True, np.diff(chunk[order]) != 0))
        last = np.append(first[1:], len(order))
        cells = [(chunk[order[i]], j - i, int(begin[j] - begin[i]), _packed(code[i:j]), _packed(sizes[i:j]), _packed(flat[begin[i] : begin[j]])) for i, j in zip(first, last)]
        types = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*cells), types)], ["of", "n_words", "n_ids", "codes", "sizes", "ids"])


def _assemble(left: pa.Table, right: pa.Table) -> pa.Table:
    """The ids of a chunk's documents, from their words' numbers and the words' ids."""
    counts = right["n_words"].to_pylist()
    cells = lambda c, sizes: np.concatenate([_unpacked(x, n) for x, n in zip(right[c], sizes)] + [np.zeros(0, np.uint32)])
    code, size, values = cells("codes", counts), cells("sizes", counts).astype(np.int64), cells("ids", right["n_ids"].to_pylist()).astype(np.int32)
    first, length = np.zeros(len(code), np.int64), np.zeros(len(code), np.int64)
    first[code], length[code] = np.cumsum(size) - size, size
    docs, lists = [], []
    for held, sizes, codes in zip(left["docs"], left["sizes"], left["codes"]):
        sizes = sizes.values.to_numpy()
        numbers = _unpacked(codes, int(sizes.sum()))
        ends = np.append(0, np.cumsum(length[numbers]))
        ids = values[np.arange(ends[-1]) + np.repeat(first[numbers] - ends[:-1], length[numbers])]
        docs.append(held.values)
        lists.append(pa.ListArray.from_arrays(pa.array(ends[np.append(0, np.cumsum(sizes))], pa.int32()), pa.array(ids, pa.int32())))
    kind = left.schema.field("docs").type.value_type
    return pa.table({"doc": pa.chunked_array(docs, kind), "ids": pa.chunked_array(lists, pa.list_(pa.int32()))})


def encode_corpus(docs: DataFrame, doc_id: str, text: str, vocabulary: str | None = None) -> DataFrame:
    """Token ids of every document: (doc_id, ids), without special tokens.

    Pre-tokens are exploded with positions, every distinct word of the corpus is
    encoded once, its ids are joined back and the documents are put together by
    position. Positions stay packed beside their documents and words travel once per
    chunk, so a word that makes up a tenth of the corpus is no hot key.

    Defined cases: an empty or null text gives an empty list; a null or repeated
    doc_id keeps its row; every row of ``docs`` gives one row; an empty table gives
    none; further columns are ignored.
    """
    shipped = ship_vocabulary(docs.sparkSession, vocabulary or vocabulary_path())
    doc_type = docs.schema[doc_id].dataType.simpleString()
    cut = materialize(explode_pre_tokens(docs, doc_id, text), "pretokens")
    entries = cut.filter("words is not null").select("chunk", F.posexplode("words").alias("code", "word"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = shipped_encoder(shipped)
        for b in batches:
            ids = [bpe.encode_ordinary(w) for w in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), _lists(np.array([i for x in ids for i in x], np.int32), [len(x) for x in ids], pa.int32())], ["word", "ids"])

    encoded = entries.select("word").distinct().mapInArrow(encode, "word string, ids array<int>")
    looked_up = entries.join(encoded, "word").select(F.col("chunk").alias("of"), "code", "ids")
    looked_up = looked_up.mapInArrow(_by_chunk, "of long, n_words int, n_ids int, codes binary, sizes binary, ids binary")
    documents = cut.filter("codes is not null").select("chunk", "docs", "sizes", "codes")
    out = documents.groupBy("chunk").cogroup(looked_up.groupBy("of")).applyInArrow(_assemble, f"doc {doc_type}, ids array<int>")
    return out.select(F.col("doc").alias(doc_id), "ids")


def token_table(vocabulary: str | None = None) -> list[bytes]:
    """The bytes of every token in order of id; empty for ids that the vocabulary lacks."""
    with open(vocabulary or vocabulary_path(), "rb") as f:
        rows = {int(n): base64.b64decode(t) for t, n in map(bytes.split, f)}
    return [rows.get(i, b"") for i in range(max(rows) + 1)]


def decode_corpus(encoded: DataFrame, doc_id: str, ids: str, vocabulary: str | None = None) -> DataFrame:
    """Texts of token ids, by a join with the table of token bytes: (doc_id, text).

    The table has as many rows as the vocabulary (50,256, 0.4 MB), so every task has it
    and joins a batch of documents' ids at once, by place; nothing is shuffled. An empty
    list gives an empty text, a null list null; a repeated or null doc_id keeps its row;
    ids that the vocabulary lacks give nothing, and bytes that are no UTF-8 the
    replacement character.
    """
    shared = encoded.sparkSession.sparkContext.broadcast(token_table(vocabulary))
    rows = encoded.select(F.col(doc_id).alias("doc"), F.col(ids).alias("ids"))
    doc_type = rows.schema["doc"].dataType.simpleString()

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.array([*shared.value, b""], pa.large_binary())
        unknown = len(table) - 1
        for b in batches:
            lists = b.column("ids")
            flat = lists.flatten().fill_null(unknown).to_numpy(zero_copy_only=False)
            found = table.take(pa.array(np.where((flat < 0) | (flat > unknown), unknown, flat)))
            offsets = np.frombuffer(found.buffers()[1], np.int64)[found.offset : found.offset + len(found) + 1] if len(found) else np.zeros(1, np.int64)
            data = memoryview(found.buffers()[2] or b"")
            ends = np.append(0, np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy()))
            cuts = offsets[ends].tolist()
            texts = [bytes(data[i:j]).decode(errors="replace") if known else None for i, j, known in zip(cuts, cuts[1:], lists.is_valid().to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("doc"), pa.array(texts, pa.string())], ["doc", "text"])

    return rows.mapInArrow(join, f"doc {doc_type}, text string").select(F.col("doc").alias(doc_id), "text")
