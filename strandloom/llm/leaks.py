"""Evaluation texts leaking into training text, found by template windows."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.session import materialize

WINDOW = 12
#: An exact window with fewer ordinary words keeps its words: placeholders alone tell nothing.
LEAST_LITERALS = 4
#: Ordinary words that a re-parameterised passage has in common with the item, three quarters of a window,
#: and the most placeholders and words in which they have to be found.
SHARED_LITERALS, LONGEST = 9, 36
#: Words of one value, as in "1,200" or a name of two words; a longer run of placeholders is no value.
VALUE_WORDS = 4
#: Bits of the filter that is sent to the tasks; its size doesn't depend on the data.
FILTER_BITS = 1 << 23
#: Characters of text handled at once in a task.
BLOCK_CHARS = 2_000_000

# Units of the international system and those in common use beside it, with prefixes and symbols.
_PREFIXES = "kilo mega giga tera milli micro nano pico centi deci".split()
_SYMBOL_PREFIXES = "k m g t u n p c d".split()
_UNIT_NAMES = "second metre meter gram litre liter hertz volt watt joule ampere kelvin newton pascal ohm farad tesla mole byte bit electronvolt".split()
_UNIT_SYMBOLS = "m g l hz v w j pa mol ev b bp".split()
_OTHER_UNITS = "sec min minute hr hour day week month year degree percent ton tonne mile inch inches foot feet yard pound ounce gallon litres".split()
UNITS = frozenset(f"{p}{u}{s}" for p in ["", *_PREFIXES] for u in [*_UNIT_NAMES] for s in ("", "s")) | frozenset(f"{u}{s}" for u in _OTHER_UNITS for s in ("", "s")) | frozenset(f"{p}{u}" for p in _SYMBOL_PREFIXES for u in _UNIT_SYMBOLS)

_INVISIBLE = re.compile("[\u00ad\u200b-\u200d\u2060\ufeff]")
_COMMAND = re.compile(r"\\[A-Za-z]+")
_WORD = re.compile("[a-z0-9]+")
_NUM, _NAME, _UNIT = 1, 2, 3


def words_of(text: str) -> list[str]:
    """Words after NFKC, without invisible characters and backslash commands, lower-cased."""
    text = text if text.isascii() else _INVISIBLE.sub("", unicodedata.normalize("NFKC", text))
    return _WORD.findall(_COMMAND.sub(" ", text).lower())


#: The seed of Spark's own xxhash64, so that tasks and SQL agree.
_SEED = 42


def _hash_words(words: list[str]) -> np.ndarray:
    """64-bit hashes of words, the same in every process."""
    return np.fromiter((xxhash.xxh64_intdigest(w, seed=_SEED) for w in words), np.uint64, len(words))


def _among(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes a bit filter holds."""
    spot = hashes & np.uint64(FILTER_BITS - 1)
    return (bits[spot >> np.uint64(3)] >> (spot & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _kinds(words: list[str], hashes: np.ndarray, ordinary: np.ndarray) -> np.ndarray:
    """0 for an ordinary word of the test material, else the placeholder's type."""
    number = np.fromiter((any("0" <= ch <= "9" for ch in w) for w in words), bool, len(words))
    unit = np.fromiter((w in UNITS for w in words), bool, len(words))
    return np.where(number, _NUM, np.where(unit, _UNIT, np.where(_among(ordinary, hashes), 0, _NAME))).astype(np.int32)


class _Lexicon:
    """Numbers words; keeps the kind of each word, its hash and that of its placeholder."""

    def __init__(self, ordinary: np.ndarray) -> None:
        self.ordinary, self.codes = ordinary, {}
        self.word_hash = self.template_hash = np.zeros(0, np.uint64)
        self.kind = np.zeros(0, np.int32)
        self.words: list[str] = []

    def add(self, text: str) -> np.ndarray:
        words = words_of(text)
        codes = self.codes
        fresh = [w for w in dict.fromkeys(words) if w not in codes]
        if fresh:
            for w in fresh:
                codes[w] = len(codes)
            self.words += fresh
            own = _hash_words(fresh)
            kinds = _kinds(fresh, own, self.ordinary)
            marks = np.concatenate([np.zeros(1, np.uint64), _hash_words(["<num>", "<name>", "<unit>"])])
            self.word_hash = np.append(self.word_hash, own)
            self.template_hash = np.append(self.template_hash, np.where(kinds == 0, own, marks[kinds]))
            self.kind = np.append(self.kind, kinds)
        return np.fromiter(map(codes.__getitem__, words), np.int64, len(words))


_FACTOR = 0x9E3779B97F4A7C15


def _windows(values: np.ndarray, size: int) -> np.ndarray:
    """Polynomial hashes, modulo 2**64, of all runs of ``size`` values."""
    out = np.zeros(len(values) - size + 1, np.uint64)
    for k in range(size):
        out *= np.uint64(_FACTOR)
        out += values[k : k + len(out)]
    return out ^ (out >> np.uint64(29))


def _stretches(values: np.ndarray, first: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Hashes, modulo 2**64, of the runs of values from ``first`` up to ``stop``."""
    power = np.cumprod(np.append(np.uint64(1), np.full(len(values), _FACTOR, np.uint64)))
    inverse = np.cumprod(np.append(np.uint64(1), np.full(len(values), pow(_FACTOR, -1, 1 << 64), np.uint64)))
    upto = np.append(np.uint64(0), np.cumsum(values * power[:-1]))
    out = (upto[stop] - upto[first]) * inverse[first] + (stop - first).astype(np.uint64)
    out = (out ^ (out >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(29))


def _exact(known: _Lexicon, codes: np.ndarray, owner: np.ndarray, size: int, bits: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """First words, keys and passages of the windows of ``size`` words."""
    if len(codes) < size:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), []
    literals = np.append(0, np.cumsum(known.kind[codes] == 0))
    templated = literals[size:] - literals[:-size] >= LEAST_LITERALS
    key = np.where(templated, _windows(known.template_hash[codes], size), _windows(known.word_hash[codes], size) ^ np.uint64(1))
    good = owner[: len(key)] == owner[size - 1 :]
    if bits is not None:
        good &= _among(bits, key)
    at = np.flatnonzero(good)
    return at, key[at], [" ".join(map(known.words.__getitem__, codes[i : i + size])) for i in at]


def _templates(known: _Lexicon, codes: np.ndarray, owner: np.ndarray, size: int, bits: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """First words, keys and slot patterns of the template windows.

    Neighbouring placeholders of one type are one value. A window has ``size`` values and
    ordinary words at least, and goes on until SHARED_LITERALS of them are ordinary. Its
    pattern has for each value the place of its first equal.
    """
    kind = known.kind[codes]
    begins = np.append(True, (kind[1:] == 0) | (kind[1:] != kind[:-1]) | (owner[1:] != owner[:-1])) if len(codes) else np.zeros(0, bool)
    first = np.flatnonzero(begins)
    ends = np.append(first[1:], len(codes))
    here = kind[first]
    literals = np.append(0, np.cumsum(here == 0))
    barred = np.append(0, np.cumsum((here != 0) & (ends - first > VALUE_WORDS)))
    n = len(first)
    start = np.arange(n)
    stop = np.maximum(start + size, np.searchsorted(literals, literals[:-1] + SHARED_LITERALS))
    start, stop = start[stop <= n], stop[stop <= n]
    good = (stop - start <= LONGEST) & (owner[first[start]] == owner[first[stop - 1]]) & (barred[start] == barred[stop])
    start, stop = start[good], stop[good]
    key = _stretches(known.template_hash[codes[first]], start, stop)
    if bits is not None:
        kept = _among(bits, key)
        start, stop, key = start[kept], stop[kept], key[kept]
    patterns = []
    for a, b in zip(start.tolist(), stop.tolist()):
        seen: dict[tuple[int, ...], int] = {}
        values = [tuple(codes[first[t] : ends[t]].tolist()) for t in range(a, b) if here[t]]
        patterns.append(",".join(str(seen.setdefault(v, i)) for i, v in enumerate(values)))
    return first[start], key, patterns


_FAMILIES = {"exact": _exact, "reparameterised": _templates}


def template_windows(rows: DataFrame, row_id: str, text: str, ordinary: np.ndarray, size: int = WINDOW, kinds: tuple[str, ...] = tuple(_FAMILIES), keep: np.ndarray | None = None) -> DataFrame:
    """Template windows of texts: (id, kind, pos, key, mark).

    Numbers, units and names (words outside the bit filter ``ordinary``) become typed
    placeholders, so that a question with other numbers has the same key. The kind of a
    word depends on the word alone, so equal passages always have equal keys. Of kind
    'exact' are the windows of ``size`` words, whose mark is the passage; one with fewer
    than LEAST_LITERALS ordinary words is keyed by its own words. Of kind
    'reparameterised' are windows that go on until enough of their words are ordinary;
    their mark is the pattern of their slots. ``keep`` is a bit filter of keys; windows
    that can't be in it are left out.
    """
    context = rows.sparkSession.sparkContext
    shared = context.broadcast((ordinary, keep))
    source = rows.select(F.col(row_id).alias("id"), F.col(text).alias("text")).filter("text is not null")
    id_type = source.schema["id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain, bits = shared.value
        known = _Lexicon(plain)

        def out(ids: pa.Array, held: list[tuple[int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
            codes = np.concatenate([c for _, c in held])
            lengths = np.array([len(c) for _, c in held])
            owner = np.repeat(np.arange(len(held)), lengths)
            begin = np.cumsum(lengths) - lengths
            row = np.array([i for i, _ in held])
            for kind in kinds:
                at, key, marks = _FAMILIES[kind](known, codes, owner, size, bits)
                if len(at):
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(pa.array(row[owner[at]])), pa.array([kind] * len(at)), pa.array(at - begin[owner[at]], pa.int64()), pa.array(key.view(np.int64)), pa.array(marks, pa.string())], ["id", "kind", "pos", "key", "mark"]
                    )

        for b in batches:
            held, chars = [], 0
            for i, value in enumerate(b.column(1)):
                one = value.as_py()
                held.append((i, known.add(one)))
                chars += len(one)
                if chars >= BLOCK_CHARS or i == b.num_rows - 1:
                    yield from out(b.column(0), held)
                    held, chars = [], 0
                    if len(known.words) > 500_000:
                        known = _Lexicon(plain)

    return source.mapInArrow(cut, f"id {id_type}, kind string, pos long, key long, mark string")


def bit_filter(keys: DataFrame) -> np.ndarray:
    """Bit array of FILTER_BITS bits with the low bits of the column ``key`` set.

    At most FILTER_BITS / 32 rows reach the driver, however many keys there are.
    """
    spot = F.col("key").bitwiseAND(F.lit(FILTER_BITS - 1))
    words = keys.select(F.shiftright(spot, 5).alias("word"), F.expr("shiftleft(1L, cast(key & 31 as int))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(FILTER_BITS // 32, np.uint32)
    out[words["word"].to_numpy()] = words["bits"].to_numpy().astype(np.uint32)
    return out.view(np.uint8)


def ordinary_words(items: DataFrame, text: str) -> np.ndarray:
    """Bit filter of the words that the test material writes in lower case and without digits somewhere.

    A word that only shares its bit with one of them counts as ordinary too, in items
    and documents alike.
    """
    # A command's letters are no words; a capital marks a name or a sentence's start.
    plain = F.regexp_replace(F.col(text), r"\\[A-Za-z]+", " ")
    found = items.select(F.explode(F.regexp_extract_all(plain, F.lit(r"(?<![A-Za-z0-9])([a-z]+)(?![A-Za-z0-9])"), 1)).alias("w"))
    return bit_filter(found.select(F.xxhash64("w").alias("key")))


def _consistent() -> Column:
    """Whether each value of the item stands for one value of the document throughout the window."""
    item, doc = (F.transform(F.split(c, ","), lambda x: x.cast("int")) for c in ("item_mark", "mark"))
    # The place of a value's first equal: where the item's values are equal, the document's have to be.
    return (F.col("item_mark") == "") | F.forall(F.arrays_zip(item.alias("a"), doc.alias("b")), lambda x: F.get(doc, x["a"]) == x["b"])


def _classes(windows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Item windows as classes (kind, spot, key, item_mark, set) and the items of each set (set, item).

    A class has the items with one key and mark. Classes with the same items, as the
    neighbouring windows of a passage have, share their set, whose name is made of hashes
    of the items, so that no class is gathered.
    """
    same = ["kind", "key", "mark"]
    rows = materialize(windows.select(*same, F.col("id").alias("item")).distinct(), "items")
    named = rows.groupBy(*same).agg(F.bit_xor(F.xxhash64("item")).alias("h1"), F.bit_xor(F.xxhash64(F.lit(1), "item")).alias("h2"), F.count("*").alias("n"))
    classes = materialize(named.select(*same, F.concat_ws(":", "h1", "h2", "n").alias("set")), "classes")
    first = classes.groupBy("set").agg(F.min(F.struct(*same)).alias("c")).select("set", "c.*")
    members = rows.join(first, same).select("set", "item")
    return classes.select("kind", _spot().alias("spot"), F.col("mark").alias("item_mark"), "set", "key"), members


def _spot() -> Column:
    """What windows are joined by: exact ones by their passage too, so that a stem common to many items is no hot key."""
    return F.when(F.col("kind") == "exact", F.xxhash64("key", "mark")).otherwise(F.col("key"))


def leaks(docs: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str, size: int = WINDOW, kinds: tuple[str, ...] = tuple(_FAMILIES)) -> DataFrame:
    """Document and item pairs that share a template window: (doc_id, item_id, kind, windows).

    ``kind`` is 'exact' where the two share ``size`` consecutive words, else
    'reparameterised' where a window of at least ``size`` ordinary words and values, with
    SHARED_LITERALS ordinary ones, agrees and the slots are consistent: wherever the
    item has a value again, the document has one value again. ``windows`` counts the
    document's windows of that kind, once for each slot pattern that the item has them in.

    Items with one template and slot pattern are one class; windows are joined and slots
    checked between classes, and classes with the same items are told apart by their set
    only, which is expanded to its items at the end: a stem that K items share costs one
    row a window, not K.

    Defined cases: null and empty texts and items of fewer than ``size`` words match
    nothing; of items with equal passages each counts; repeated rows of one id count
    as one document; a null id is an id like others; empty tables give no rows; further columns are ignored.
    """
    lower = ordinary_words(items, item_text)
    classes, members = _classes(template_windows(items, item_id, item_text, lower, size, kinds))
    found = template_windows(docs, doc_id, text, lower, size, kinds, bit_filter(classes)).withColumn("spot", _spot())
    hits = found.join(classes.drop("key"), ["kind", "spot"]).filter(F.when(F.col("kind") == "exact", F.col("mark") == F.col("item_mark")).otherwise(_consistent()))
    counted = materialize(hits.select("id", "kind", "set", "pos", "item_mark").distinct().groupBy("id", "kind", "set").agg(F.count("*").alias("windows")), "hits")
    pairs = counted.join(members, "set").groupBy("id", "item", "kind").agg(F.sum("windows").alias("windows"))
    # An exact pair is no re-parameterised one too; 'exact' comes first in the alphabet.
    one = pairs.groupBy("id", "item").agg(F.min(F.struct("kind", "windows")).alias("best"))
    return one.select(F.col("id").alias(doc_id), F.col("item").alias(item_id), "best.kind", "best.windows")
