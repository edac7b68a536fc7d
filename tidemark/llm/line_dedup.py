"""Operator 7: line dedup by winnowing."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import giving_back, release_memory, reliable_checkpoint, shared_folder, slices
from tidemark.llm.words import Runs, Words, batch_words
from tidemark.session import remove_folder, stored

#: Bits of a table that tells which numbers are listed, as powers of two: from 128 kB to 32 MB.
TABLE_BITS = (20, 28)
#: Spreads the places of a text over a table of bits.
_STEP = 40503
#: Documents are told apart by so many buckets before texts are shuffled.
BUCKETS = 1 << 20


def window_minima(words: Words, runs: Runs, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, mark, line hashes): each window of ``least`` words in a text and its fingerprint.

    A line is a run of half as many words, one from each word on. The mark of a window is
    the place of the smallest line hash in it, the rightmost of equal ones, so that
    it follows from the window's words alone.
    """
    k, n, left = least // 2, len(words.hashes), words.left()
    start = np.flatnonzero(left >= least)
    first = np.arange(max(0, n - k + 1))
    lines = runs.of(first, first + k)
    width, reach, best = 1, least - k + 1, first
    while len(start) and width < reach:
        step = min(width, reach - width)
        one, two = best[:-step], best[step:]
        best, width = np.where(lines[two] <= lines[one], two, one), width + step
    return start, best[start] if len(start) else start, lines


def marks_of(words: Words, least: int) -> tuple[np.ndarray, ...]:
    """(text number, place in it, fingerprint, context) of the distinct window minima.

    The context is the hash of all words that any window around the mark can hold, of another kind
    than the fingerprint, so that words that clash in one do not in the other.
    """
    runs = Runs(words.hashes)
    _, mark, lines = window_minima(words, runs, least)
    mark = mark[np.concatenate(([True], mark[1:] != mark[:-1]))] if len(mark) else mark
    row = np.searchsorted(words.bounds, mark, "right") - 1
    low = np.maximum(words.bounds[row], mark - (least - least // 2))
    high = np.minimum(words.bounds[row + 1], mark + least)
    context = Runs(words.named(1)).of(low, high) + (mark - low).astype(np.uint64)
    return row, mark - words.bounds[row], lines[mark], context


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, Words]]:
    for batch in batches:
        for part in slices(batch, "text", 1 << 20):
            yield part, batch_words(part.column("text"))


def _long(values: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(values).view(np.int64) if values.dtype == np.uint64 else values.astype(np.int64))


def _fingerprints(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, words in _parts(batches):
            yield pa.record_batch([_long(marks_of(words, least)[2])], ["mark"])

    return giving_back(run)


def _places(least: int, table: Broadcast, key: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, words in _parts(batches):
            row, pos, mark, context = marks_of(words, least)
            seen = in_table(table.value, mark)
            keys = [part.column(c).take(pa.array(row[seen])) for c in key]
            yield pa.record_batch([*keys, _long(pos[seen]), _long(mark[seen]), _long(context[seen])], [*key, "pos", "mark", "context"])

    return giving_back(run)


def _windows(least: int, table: Broadcast, key: list[str]):
    """Windows around the marks that the table lists by place, named by two hashes of their words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, words in _parts(batches):
            runs = Runs(words.hashes)
            start, mark, _ = window_minima(words, runs, least)
            row = np.searchsorted(words.bounds, start, "right") - 1
            named = part.column("r").to_numpy()[row].view(np.uint64)
            listed = in_table(table.value, named ^ ((mark - words.bounds[row]) * _STEP).astype(np.uint64))
            start, row = start[listed], row[listed]
            keys = [part.column(c).take(pa.array(row)) for c in key]
            names = [_long(x.of(start, start + least)) for x in (runs, Runs(words.named(1)))]
            yield pa.record_batch([*keys, _long(start - words.bounds[row]), *names], [*key, "pos", "w1", "w2"])

    return giving_back(run)


def cut_part(texts: pa.Array, ranges: list[tuple[np.ndarray, np.ndarray, np.ndarray]], least: int) -> pa.Array:
    """(text, removed) of each text without the windows that begin in the given ranges: text
    numbers and first and last places, in words."""
    words = batch_words(texts, hashed=False)
    bounds, n = words.bounds, len(words.starts)
    change = np.zeros(n + 1, np.int64)
    for row, low, high in ranges:
        np.add.at(change, bounds[row] + np.maximum(low, 0), 1)
        np.add.at(change, bounds[row] + np.minimum(high, bounds[row + 1] - bounds[row] - least) + least, -1)
    gone = np.cumsum(change[:n]) > 0
    begins, ends = np.zeros(n + 1, bool), np.zeros(n + 1, bool)
    begins[bounds], ends[bounds] = True, True
    first = np.flatnonzero(gone & (begins[:n] | ~np.concatenate(([False], gone))[:n]))
    last = np.flatnonzero(gone & (ends[1:] | ~np.append(gone, False)[1:])) + 1
    row = np.searchsorted(bounds, first, "right") - 1
    # Up to the next word of the same text, or the end of it.
    to = np.where(last < bounds[row + 1], np.append(words.starts, len(words.data))[last], words.offsets[row + 1])
    step = np.zeros(len(words.data) + 1, np.int8)
    np.add.at(step, words.starts[first], 1)
    np.add.at(step, to, -1)
    keep = np.cumsum(step[:-1], dtype=np.int8) == 0
    offsets = np.concatenate(([0], np.cumsum(keep)))[words.offsets].astype(np.int32)
    kept = pa.StringArray.from_buffers(len(texts), pa.py_buffer(offsets), pa.py_buffer(words.data[keep]))
    kept = pc.if_else(texts.is_null(), pa.scalar(None, pa.string()), kept)
    places = [pa.array((x - bounds[row]).astype(np.int32)) for x in (first, last)]
    spans = pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(len(texts) + 1)).astype(np.int32)), pa.StructArray.from_arrays(places, ["start", "end"]))
    return pa.StructArray.from_arrays([kept, spans], ["text", "removed"])


def _cut(least: int):
    """Texts without windows: those around the marks in ``whole``, and those that begin at ``starts``."""

    @F.arrow_udf("text string, removed array<struct<start:int,end:int>>")
    def run(texts: pa.Array, whole: pa.Array, starts: pa.Array) -> pa.Array:
        batch, done = pa.record_batch([texts, whole, starts], ["text", "whole", "starts"]), []
        for part in slices(batch, "text", 1 << 20):
            ranges = []
            for column, before in ((part.column("whole"), least - least // 2), (part.column("starts"), 0)):
                row = np.repeat(np.arange(len(part)), pc.fill_null(column.value_lengths(), 0).to_numpy())
                pos = column.flatten().to_numpy()
                ranges.append((row, pos - before, pos))
            done.append(cut_part(part.column("text"), ranges, least))
        release_memory()
        return pa.concat_arrays(done)

    return run


def bit_table(numbers: DataFrame) -> Broadcast:
    """A bit for each of ``numbers(v long)`` by its last bits; others may share it, none is left out.

    The table has 32 bits a number or more, within bounds: beyond them more numbers share a bit, which costs
    work and changes nothing.
    """
    count = numbers.count()
    bits = min(max((count * 32).bit_length(), TABLE_BITS[0]), TABLE_BITS[1])
    low = numbers.select(F.col("v").bitwiseAND((1 << bits) - 1).alias("v"))
    rows = low.groupBy(F.shiftright("v", 15).alias("at")).agg(F.bitmap_construct_agg(F.col("v").bitwiseAND(32767)).alias("bits"))
    table = np.zeros(1 << (bits - 3), np.uint8)
    for r in rows.collect():
        table[r["at"] * 4096 : (r["at"] + 1) * 4096] = np.frombuffer(r["bits"], np.uint8)
    return numbers.sparkSession.sparkContext.broadcast(table)


def in_table(table: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """Which of the numbers have their bit in the table of :func:`bit_table`."""
    bit = numbers & np.uint64(len(table) * 8 - 1)
    return (table[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 > 0


def _among(rows: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """Rows whose bucket is (``left_semi``) or is not (``left_anti``) one of those of ``keys``.

    At most :data:`BUCKETS` numbers are broadcast. Rows of other keys may share a bucket.
    """
    bucket = F.pmod("r", F.lit(BUCKETS)).alias("b")
    return rows.join(F.broadcast(keys.select(bucket).distinct()), F.pmod(rows["r"], F.lit(BUCKETS)) == F.col("b"), how)


@dataclass(frozen=True)
class Places:
    """How a place is named, so that places compare by id and word.

    A text is named by ``key``. Where that is one whole number that leaves room, a place is the number and
    ``bits`` bits of the word's number in one long, which Spark keeps and compares without a sort; else it is a struct.
    """

    key: list[str]
    bits: int = 0

    def place(self) -> Column:
        return (F.shiftleft(self.key[0], self.bits) + F.col("pos")) if self.bits else F.struct(*self.key, "pos")

    def text(self) -> Column:
        return F.col(self.key[0]) if self.bits else F.struct(*self.key)

    def text_of(self, at: str) -> Column:
        return F.shiftright(at, self.bits) if self.bits else F.struct(*(F.col(f"{at}.{k}") for k in self.key))

    def pos_of(self, at: str) -> Column:
        return F.col(at).bitwiseAND((1 << self.bits) - 1) if self.bits else F.col(f"{at}.pos")

    def parts(self, at: str) -> list[Column]:
        """The key's columns and the word's number out of a place."""
        key = [self.text_of(at).alias(self.key[0])] if self.bits else [F.col(f"{at}.{k}") for k in self.key]
        return [*key, self.pos_of(at).alias("pos")]


def distinct_ids(named: DataFrame, kind: str) -> bool:
    """Whether ids are whole numbers that name one row each."""
    if kind == "string":
        return False
    counted = named.groupBy("n", "i").agg(F.count("*").alias("c")).where("n OR c > 1")
    return counted.isEmpty()


def packed_places(marks: DataFrame, least: int) -> Places:
    """Places of texts that their id names, in one long where ids and word numbers leave room."""
    low, high, words = marks.agg(F.min("i"), F.max("i"), F.max("pos")).first()
    bits = ((words or 0) + least).bit_length()
    fits = low is None or max(abs(int(low)), abs(int(high)) + 1).bit_length() + bits < 63
    return Places(["i"], bits if fits else 0)


def repeated_windows(named: DataFrame, kind: str, least: int, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """What to cut from ``named(key..., r, text)``, a row for each text that loses words: marks all
    of whose windows go, (key..., whole), and first words of single windows, (key..., starts)."""
    spark = named.sparkSession
    folder = f"{shared_folder(spark)}/marks-{uuid.uuid4().hex}"
    kinds = {"n": "boolean", "i": kind, "r": "long"}
    schema = ", ".join(f"{k} {kinds[k]}" for k in key) + ", pos long, "
    hashes = named.select("text").mapInArrow(_fingerprints(least), "mark long")
    shared = stored(hashes.groupBy("mark").agg(F.count("*").alias("c")).where("c > 1").select(F.col("mark").alias("v")), f"{folder}/shared")
    # Written, since texts are hashed anew each time that their marks are asked for.
    marks = stored(named.mapInArrow(_places(least, bit_table(shared), key), f"{schema}mark long, context long"), f"{folder}/marks")
    at = packed_places(marks, least) if key == ["i"] else Places(key)
    place = at.place().alias("at")
    apart = (at.text() != at.text_of("at")) | (F.col("pos") >= at.pos_of("at") + least)

    # Marks of one context have all their windows in common with the first of them. Writing
    # takes the sum's partitioning away, so that a passage of many rows can be split.
    contexts = marks.groupBy("mark", "context").agg(F.min(place).alias("at"), F.count("*").alias("c"))
    contexts = stored(contexts, f"{folder}/contexts")
    later = marks.join(contexts.where("c > 1").drop("c"), ["mark", "context"]).where(at.place() != F.col("at"))
    # A text has as many marks as a share of its words; rows equal in id and text have them twice.
    whole = F.collect_set(F.when(apart, F.col("pos"))).alias("whole")
    close = F.collect_set(F.when(~apart, F.struct("pos", "mark"))).alias("close")
    later = reliable_checkpoint(later.groupBy(*key).agg(whole, close))

    # Where the contexts of a mark differ, runs end nearby: windows there are compared one by one. Texts
    # stay where they are: a table of bits tells the places, as it told the fingerprints.
    several = stored(contexts.groupBy("mark").agg(F.count("*").alias("c")).where("c > 1").select("mark"), f"{folder}/several")
    edges = contexts.select(*at.parts("at"), "mark").unionByName(later.select(*key, F.explode("close").alias("m")).select(*key, "m.pos", "m.mark"))
    bucket = F.col("r") if "r" in key else F.xxhash64("i").alias("r")
    edges = stored(edges.join(several, "mark").select(bucket, "pos"), f"{folder}/edges")
    listed = bit_table(edges.select(F.col("r").bitwiseXOR(F.col("pos") * _STEP).alias("v")).distinct())
    texts = _among(named, edges, "left_semi")
    windows = stored(texts.mapInArrow(_windows(least, listed, key), f"{schema}w1 long, w2 long"), f"{folder}/windows")
    earliest = windows.groupBy("w1", "w2").agg(F.min(place).alias("at"), F.count("*").alias("c")).where("c > 1").drop("c")
    met = windows.join(stored(earliest, f"{folder}/earliest"), ["w1", "w2"]).where(apart)
    met = reliable_checkpoint(met.groupBy(*key).agg(F.collect_set("pos").alias("starts")))
    remove_folder(spark, folder)
    return later.where(F.size("whole") > 0).drop("close"), met


def _never_null(column: Column, kind: str) -> Column:
    return F.coalesce(column, F.lit("") if kind == "string" else F.lit(0).cast(kind))


def remove_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = 50) -> DataFrame:
    """Delete later repeats of word runs: all columns of ``docs`` with the text cut, and
    ``removed_words`` (numbers of the deleted words, from 0, as start and end) beside them.

    A run is a sequence of ``least_words`` words or more, wherever it begins and ends in
    its lines, and words are compared exactly. Its earliest place, by id and word, stays;
    every later one goes, also within a document where it does not overlap the earliest.
    With a word go the blanks and line ends up to the next word that stays.

    Method: a line of half of ``least_words`` words begins at each word, since a passage may
    start inside a printed line. Windows over the line hashes select their minima, so that two
    places of a run have fingerprints in common wherever it lies. Fingerprints are counted
    first; only those of two places or more are joined by position. A match is extended both
    ways: at once where all words around the fingerprints agree, else window by
    window. Minima are pre-aggregated and the joins are plain, so that a passage
    in a third of the documents is split, not collected. Texts that nothing is cut from,
    told by their bucket, are not shuffled.

    Null, empty and short texts are left as they are; a text that consists of repeats
    becomes empty, and its row stays. Rows with a null id come after all others. Rows
    equal in id and text count as one document and are cut alike; rows that share only
    an id are told apart by a hash of their text. An empty table gives an empty result. A
    column named ``removed_words``, in any case, is replaced. Fingerprints with their contexts,
    and windows, are compared by two 64-bit hashes of their words that have nothing in common.
    """
    others = [c for c in docs.columns if c.lower() != "removed_words"]
    kind = dict(docs.dtypes)[id_col]
    kind = "bigint" if kind in ("tinyint", "smallint", "int", "bigint") else "string"
    # All input columns travel in one struct, so no name can clash.
    row = docs.select(F.struct(*(F.col(f"`{c}`") for c in others)).alias("d"))
    held, text = F.col("d").getField(id_col), F.col("d").getField(text_col)
    named = row.select(
        held.isNull().alias("n"), _never_null(held.cast(kind), kind).alias("i"), F.xxhash64(held, text).alias("r"), text.alias("text"), "d"
    )
    key = ["n", "i", "r"]
    if distinct_ids(named.select("n", "i"), kind):
        # The id alone names a text, so a row of marks is half as wide and its places are numbers.
        key, named = ["i"], named.withColumn("r", F.xxhash64("i"))
    whole, single = repeated_windows(named.select(*{*key, "r"}, "text"), kind, least_words, key)
    of = lambda rows: rows.select(F.col("r") if "r" in key else F.xxhash64("i").alias("r"))
    lose = of(whole).unionByName(of(single))
    none = F.array().cast("array<struct<start:int,end:int>>")
    shown = lambda text, removed: [*(text.alias(c) if c == text_col else F.col("d").getField(c).alias(c) for c in others), removed.alias("removed_words")]
    as_they_are = _among(named, lose, "left_anti").select(*shown(F.col("text"), none))
    joined = _among(named.drop("text"), lose, "left_semi").join(whole, key, "left").join(single, key, "left")
    done = joined.select("d", _cut(least_words)(F.col("d").getField(text_col), F.col("whole"), F.col("starts")).alias("cut"))
    return as_they_are.unionByName(done.select(*shown(F.col("cut.text"), F.col("cut.removed"))))
