"""Splitting oversized texts at natural boundaries, by pointer doubling."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm.tokens import ship_vocabulary, shipped_encoder, vocabulary_path
from strandloom.session import discard, materialize

#: Kinds of boundary, the best last; a token boundary is always possible.
KINDS = ("token", "word", "sentence", "line", "paragraph", "section")
#: Tokens of a character besides its first; it has four bytes at most.
INNER_TOKENS = 3
_TOKEN, _WORD, _SENTENCE, _LINE, _PARAGRAPH, _SECTION = range(6)

# What opens a section, ends a sentence and may follow its end.
_OPENS_SECTION = re.compile(r"\\(?:(?:sub)*section|chapter|part|appendix|begin\{(?:abstract|thebibliography|document)\})|#{1,6} ")
_SENTENCE_ENDS = np.array([ord(c) for c in ".!?…"], np.uint32)
_FULL_STOPS = np.array([ord(c) for c in "。！？｡।۔؟"], np.uint32)
_CLOSERS = np.array([ord(c) for c in ")]}\"'”’»」』）"], np.uint32)
_SPACES = np.array([*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000], np.uint32)
_BREAKS = np.array([10, 11, 12, 0x85, 0x2028, 0x2029], np.uint32)


def _gaps(text: str, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last character position of each place to cut, and its kind."""
    n = len(chars)
    space = np.isin(chars, _SPACES)
    edge = np.diff(space.astype(np.int8), prepend=0, append=0)
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    inner = (first > 0) & (last < n)
    first, last = first[inner], last[inner]
    ends = np.isin(chars, _SENTENCE_ENDS) | np.isin(chars, _FULL_STOPS)
    bare = np.flatnonzero(np.isin(chars[:-1], _FULL_STOPS) & ~space[1:]) + 1
    lone_cr = (chars == 13) & np.append(chars[1:] != 10, True)
    breaks = np.append(0, np.cumsum(np.isin(chars, _BREAKS) | lone_cr))
    lines = breaks[last] - breaks[first]
    closed = np.isin(chars[first - 1], _CLOSERS) & ends[np.maximum(first - 2, 0)]
    kind = np.where(ends[first - 1] | closed, _SENTENCE, _WORD)
    kind = np.where(lines >= 2, _PARAGRAPH, np.where(lines == 1, _LINE, kind))
    heads = np.array([m.start() for m in _OPENS_SECTION.finditer(text)], np.int64)
    kind[(lines >= 1) & np.isin(last, heads)] = _SECTION
    order = np.argsort(np.append(last, bare), kind="stable")
    return np.append(first, bare)[order], np.append(last, bare)[order], np.append(kind, np.full(len(bare), _SENTENCE))[order]


def _successors(text: str, sizes: np.ndarray, most: int, overlap: int) -> dict[str, np.ndarray]:
    """The successor table of one text of more than ``most`` tokens.

    A boundary ``pos`` (in tokens) ends a piece; the next piece begins at ``start``,
    ``overlap`` tokens earlier or at the first character after that, and ends at
    ``next``: of the best kind of boundary that lies in reach, the farthest one.
    In a stretch without any break every token is a boundary where a cut can lie: a piece
    gets on by ``most - overlap`` tokens, give or take the inner tokens of a character at
    both of its ends, so the k-th cut is within k times as many of its even place.
    Only boundaries that are a successor of another stay, and 0, the beginning.
    """
    n = len(sizes)
    raw = np.frombuffer(text.encode(), np.uint8)
    begin = np.append(0, np.cumsum(sizes))
    lead = np.append((raw & 0xC0) != 0x80, True)
    whole = lead[begin]  # tokens that begin with a character
    char_of = np.append(0, np.cumsum(lead[:-1]))
    chars = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    byte_of = np.append(np.flatnonzero(lead[:-1]), len(raw))
    first, last, kind = _gaps(text, chars)
    at = np.searchsorted(begin, byte_of[last], side="right") - 1
    fits = (begin[at] >= byte_of[first]) & whole[at] & (at > overlap) & (at < n)
    kinds = np.zeros(n + 1, np.int8)
    np.maximum.at(kinds, at[fits], kind[fits])
    places = [np.flatnonzero((kinds == k) & whole) for k in range(6)]
    places[_TOKEN] = places[_TOKEN][(places[_TOKEN] > overlap) & (places[_TOKEN] < n)]
    starts = np.flatnonzero(whole)

    def follow(pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        start = np.where(pos == 0, 0, starts[np.searchsorted(starts, np.maximum(pos - overlap, 0))])
        limit = start + most
        to = np.full(len(pos), -1)
        for k in reversed(range(6)):
            if len(places[k]):
                far = places[k][np.maximum(np.searchsorted(places[k], limit, side="right") - 1, 0)]
                to = np.where((to < 0) & (far > pos) & (far <= limit), far, to)
        return start, np.where(limit >= n, n, to)

    natural = np.unique(np.concatenate([[0, n], *places[1:]]))
    wide = np.flatnonzero(np.diff(natural) > most - overlap)
    bare = []
    for a, b in zip(natural[wide], natural[wide + 1]):
        inside = starts[(starts > a) & (starts < b)]
        gone = inside - a - (overlap if a == 0 else 0)  # the first piece has no overlap
        cuts = np.maximum(np.rint(gone / (most - overlap)), 1)
        bare.append(inside[np.abs(gone - cuts * (most - overlap)) <= INNER_TOKENS * cuts])
    reached = np.unique(follow(np.concatenate([natural[:-1], *bare]))[1])
    pos = np.append(0, reached[reached < n])
    start, to = follow(pos)
    return {"pos": pos, "start": start, "next": to, "pos_char": char_of[begin[pos]], "start_char": char_of[begin[start]], "next_char": char_of[begin[to]], "kind": kinds[np.minimum(to, n)]}


_TABLE = "h long, pos int, start int, next int, pos_char int, start_char int, next_char int, last boolean, kind int"


def successor_table(docs: DataFrame, doc_id: str, text: str, most: int, overlap: int, vocabulary: str | None = None) -> DataFrame:
    """Successors of the boundaries of every text of more than ``most`` tokens; ``doc`` and a hash of the text name the text."""
    shipped = ship_vocabulary(docs.sparkSession, vocabulary or vocabulary_path())
    # A token has at least one byte, so shorter texts need no encoding.
    rows = docs.filter(F.octet_length(text) > most).select(F.col(doc_id).alias("doc"), F.col(text).alias("text"), F.xxhash64(text).alias("h"))
    doc_type = rows.schema["doc"].dataType.simpleString()
    names = ["pos", "start", "next", "pos_char", "start_char", "next_char"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = shipped_encoder(shipped)
        size_of = np.zeros(bpe.max_token_value + 1, np.int64)
        for token in bpe.token_byte_values():
            size_of[bpe.encode_single_token(token)] = len(token)
        for b in batches:
            for i, value in enumerate(b.column(1)):
                one = value.as_py()
                ids = np.array(bpe.encode_ordinary(one), np.int64)
                if len(ids) <= most:
                    continue
                got = _successors(one, size_of[ids], most, overlap)
                m = len(got["pos"])
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array([i] * m)), pa.array([b.column(2)[i].as_py()] * m, pa.int64()), *[pa.array(got[c], pa.int32()) for c in names], pa.array(got["next"] == len(ids)), pa.array(got["kind"], pa.int32())],
                    ["doc", "h", *names, "last", "kind"],
                )

    return rows.mapInArrow(cut, f"doc {doc_type}, {_TABLE}").distinct()


def greedy_cuts(table: DataFrame) -> DataFrame:
    """The rows of a successor table that the greedy cutting from 0 meets.

    Round k joins the boundaries met so far with the table of 2**k steps, then squares
    that table, so the rounds are the logarithm of the most pieces of a text. The tables
    grow with the texts, so all joins are merge joins, whatever the size of a compressed file.
    """
    on = [F.col("a.doc").eqNullSafe(F.col("b.doc")), F.col("a.h") == F.col("b.h")]
    table = materialize(table, "successors")
    # One table a round: boundaries met so far have no ``next``, steps have one.
    begin = table.filter("pos = 0").select("doc", "h", "pos", F.lit(None).cast("int").alias("next"))
    state = begin.unionByName(table.filter("not last").select("doc", "h", "pos", "next"))
    while True:
        met, steps = state.filter("next is null"), state.filter("next is not null")
        if steps.isEmpty():
            break
        further = met.alias("a").join(steps.alias("b").hint("merge"), [*on, F.col("a.pos") == F.col("b.pos")]).select("b.doc", "b.h", F.col("b.next").alias("pos"), F.lit(None).cast("int").alias("next"))
        squared = steps.alias("a").join(steps.alias("b").hint("merge"), [*on, F.col("a.next") == F.col("b.pos")]).select("a.doc", "a.h", "a.pos", "b.next")
        before, state = state, materialize(met.unionByName(further).unionByName(squared), "met")
        discard(before)
    return table.alias("a").join(met.alias("b").hint("merge"), [*on, F.col("a.pos") == F.col("b.pos")], "left_semi")


def split_texts(docs: DataFrame, doc_id: str, text: str, most: int = 2048, overlap: int = 128, vocabulary: str | None = None) -> DataFrame:
    """Pieces of every text: (doc_id, piece_no, start_token, end_token, boundary, text).

    A text of at most ``most`` tokens is one piece with null end_token and boundary.
    A longer one gives pieces of at most ``most`` tokens of its own encoding, each but
    the first repeating the last ``overlap`` tokens of the piece before it (fewer only
    where this breaks a character). It is cut at the farthest boundary in reach of the
    best kind there: sections, paragraphs, lines, sentences, words, tokens.

    Defined cases: a null text gives one piece with a null text, an empty text an empty
    one; a text without any break is cut between tokens, never within a character; a
    row that comes again gives its pieces again; an empty table gives no rows; further
    columns are ignored.
    """
    cuts = greedy_cuts(successor_table(docs, doc_id, text, most, overlap, vocabulary))
    fields = ["pos", "start", "next", "start_char", "next_char", "last", "kind"]
    of_text = cuts.groupBy("doc", "h").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("cuts"))
    rows = docs.select(F.col(doc_id).alias("d"), F.col(text).alias("text"), F.xxhash64(text).alias("dh"))
    # Texts of at most ``most`` bytes can't be cut; they pass by the join, as those that turn out to be short enough pass by the slicing.
    may_be_cut = F.coalesce(F.octet_length("text") > most, F.lit(False))
    both = rows.filter(may_be_cut).join(of_text, F.col("d").eqNullSafe(F.col("doc")) & (F.col("dh") == F.col("h")), "left").select("d", "text", "cuts")
    pieces = _sliced(both.filter("cuts is not null"))
    whole = both.filter("cuts is null").select("d", "text").unionByName(rows.filter(~may_be_cut).select("d", "text"))
    none = F.lit(None)
    whole = whole.select("d", F.lit(0).alias("piece_no"), F.lit(0).alias("start"), none.cast("int").alias("next"), none.cast("boolean").alias("last"), none.cast("int").alias("kind"), "text")
    boundary = F.when(~F.col("last"), F.element_at(F.array(*map(F.lit, KINDS)), F.col("kind") + 1)).when(F.col("last"), F.lit("end"))
    return pieces.unionByName(whole).select(F.col("d").alias(doc_id), "piece_no", F.col("start").alias("start_token"), F.col("next").alias("end_token"), boundary.alias("boundary"), "text")


def _sliced(rows: DataFrame) -> DataFrame:
    """The pieces of texts with their sorted cuts, in one pass over each text."""
    doc_type = rows.schema["d"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, (value, cuts) in enumerate(zip(b.column("text"), b.column("cuts"))):
                one, at = value.as_py(), cuts.values
                m = len(at)
                where = zip(at.field("start_char").to_pylist(), at.field("next_char").to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [b.column("d").take(pa.array([i] * m)), pa.array(range(m), pa.int32()), *[at.field(c) for c in ("start", "next", "last", "kind")], pa.array([one[s:e] for s, e in where], pa.string())],
                    ["d", "piece_no", "start", "next", "last", "kind", "text"],
                )

    return rows.mapInArrow(cut, f"d {doc_type}, piece_no int, start int, next int, last boolean, kind int, text string")


def oversized(docs: DataFrame, doc_id: str, text: str, most: int = 2048, overlap: int = 128, vocabulary: str | None = None) -> DataFrame:
    """Ids of the texts that are cut: those whose greedy cutting has a second piece."""
    cuts = greedy_cuts(successor_table(docs, doc_id, text, most, overlap, vocabulary))
    return cuts.filter("pos > 0").select(F.col("doc").alias(doc_id)).distinct()
