"""Incremental deduplication of repeated passages with a log-structured fingerprint index.

Documents come in batches in ascending order of id. Every window of WINDOW words holds W = WINDOW - GRAM + 1
grams of GRAM words, and the first of those with the smallest hash is its anchor, so equal windows have equal
anchors. Neighbouring windows share an anchor; an entry of the index is an anchor with the stretch of windows it
serves: the gram's hash, 128 bits of the whole stretch, document, first window, number of windows. About
one word in eight starts one.

A batch becomes a sorted immutable run: entries dealt and sorted by the gram's hash, written as a bucketed table. It is
merge-joined with the earlier runs bucket by bucket; no run is shuffled again. Its texts are kept in the same way, dealt by document: whatever is
later asked of some documents' texts (lists of places by document) comes to them, so a text goes through one shuffle in its life. Stretches that are equal repeat as a whole.
Where a gram stands in different stretches, some windows may still be equal, so the windows of each such stretch's first
occurrence are hashed one by one (128 bits) from the texts. Runs are compacted in levels: as soon as ``fan_out`` runs have
sizes of one power of ``fan_out``, they are merged into one, again bucket by bucket, which keeps the first occurrence of every stretch.

Hashes only propose. Words are digested by BLAKE2b, stretches and windows by a mix of these digests that isn't linear; what is to go is
joined to whole intervals, and the words of each interval and of the earlier occurrence it repeats are digested by SHA-256
from the texts and compared. An interval that differs stays.

Hot passages are aggregated before they are shuffled: of a stretch that a task meets again only occurrences earlier than
all it met are indexed, the others are proposed at once. A hot gram (one that stands in so many different stretches that
its entries would fill an eighth of a bucket) isn't dealt by its hash: its windows are indexed one by one in runs of
their own, dealt by the window's hash. Which grams are hot is read from the entries whose hash is divisible by
64; it moves entries from one kind of run to the other and changes no result.

Only documents with an old stretch that a batch's grams meet in another form are read again, from the batches whose ids these span.

An index with a path outlives its session: runs, texts and hot grams are segments under one log (``millrace.sources.segments``), and
a batch is committed as a whole. ``SubstringIndex.open(spark, path)`` goes on where the last commit ended; a batch that failed midway left nothing.

Defined cases: a null text has no words. Rows without an id are returned as they are and lend no window. Rows that repeat an id
count as one document, so none of them is removed for another. If their texts differ, only words that all of them have at the same place, and that
repeat an earlier place of another document or their own, are removed from them; whatever the digests of one of them refute stays in all. Texts under WINDOW words stay whole. An
empty table gives an empty result.
"""

from __future__ import annotations

import gc
import hashlib
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.encoding import portions, strings
from millrace.llm.shared import delete, joined, new_path, written
from millrace.sources.segments import SegmentStore

#: Runs of one level that are merged into one of the next.
WINDOW, GRAM, FAN_OUT = 20, 6, 2
#: Batches into which a whole table is cut.
BATCHES = 3
#: A gram is hot from so many entries in a batch, if these also are a share of 1 / HOT_SHARE of a bucket; one entry in SAMPLED is counted.
HOT_LEAST, HOT_SHARE, SAMPLED = 512, 8, 64
#: Digests of words that a worker remembers.
DIGESTS_KEPT = 400_000
_U = np.uint64
_ODD = (_U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F))
_WHITE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_digests: dict[bytes, bytes] = {}


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _both(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One number for two in order; for either one kept, a bijection of the other."""
    return _mixed(a * _ODD[0] + _mixed(b ^ _ODD[1]))


def _word_digests(words: list[bytes]) -> np.ndarray:
    """128 bits of each distinct word."""
    if len(_digests) > DIGESTS_KEPT:
        _digests.clear()
    for w in words:
        if w not in _digests:
            _digests[w] = hashlib.blake2b(w, digest_size=16).digest()
    return np.frombuffer(b"".join(map(_digests.__getitem__, words)), np.uint64).reshape(-1, 2)


class Words:
    """Words of several texts in a row, with hashes of stretches of them in two independent lanes.

    ``spans`` (text, first place, end): only words in one of these are digested and hashed, the others are counted; ``at`` gives the place of a word among them.
    """

    def __init__(self, texts: list[bytes], spans: tuple[np.ndarray, ...] | None = None) -> None:
        data = np.frombuffer(b" " + b" ".join(texts) + b" ", np.uint8)
        white = _WHITE[data]
        starts = np.nonzero(white[:-1] & ~white[1:])[0] + 1
        lengths = np.nonzero(~white[:-1] & white[1:])[0] + 1 - starts
        begin = 1 + np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
        self.first = np.searchsorted(starts, begin)  # of each text, and one more
        self.text = np.repeat(np.arange(len(texts)), np.diff(self.first))
        letters = data[~white]
        if spans is not None:
            text, a, end = spans
            place = lambda x: np.bincount(np.minimum(self.first[text] + x, self.first[text + 1]), minlength=len(starts) + 1)
            within = np.cumsum(place(a) - place(end))[: len(starts)] > 0
            self.at = np.cumsum(within) - 1
            letters, lengths, self.text = letters[np.repeat(within, lengths)], lengths[within], self.text[within]
        self.n = len(lengths)
        at = np.concatenate(([0], np.cumsum(lengths))).astype(np.int64)
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), self.n, [None, pa.py_buffer(at), pa.py_buffer(letters)]).dictionary_encode()
        each = _word_digests(words.dictionary.to_pylist())[words.indices.to_numpy(zero_copy_only=False)] if self.n else np.zeros((0, 2), np.uint64)
        self.of = {(1, lane): each[:, lane].copy() for lane in range(2)}

    def hashes(self, length: int, lane: int = 0) -> np.ndarray:
        """Of the ``length`` words from each place on."""
        if (length, lane) not in self.of:
            top = 1 << (length - 1).bit_length() - 1
            a, b = self.hashes(top, lane), self.hashes(length - top, lane)[top:]
            self.of[length, lane] = _both(a[: len(b)], b)
        return self.of[length, lane]


def entries(words: Words) -> tuple[np.ndarray, ...]:
    """Entries of all texts: gram hash, both halves of the stretch's hash, text, first window and number of windows (places within the text)."""
    count, wide = words.n - WINDOW + 1, WINDOW - GRAM + 1
    whole = np.nonzero(words.text[: max(count, 0)] == words.text[WINDOW - 1 :])[0]
    if not len(whole):
        none = np.zeros(0, np.uint64)
        return none, none, none, whole, whole, whole
    grams = words.hashes(GRAM)
    least, width = np.arange(len(grams)), 1
    while 2 * width <= wide:
        a, b = least[:-width], least[width:]
        least, width = np.where(grams[b] < grams[a], b, a), 2 * width
    a, b = least[:count], least[wide - width : wide - width + count]
    anchor = np.where(grams[b] < grams[a], b, a)[whole]
    text = words.text[whole]
    first = np.concatenate(([0], np.nonzero((np.diff(anchor) != 0) | (np.diff(text) != 0))[0] + 1))
    number = np.diff(np.concatenate((first, [len(whole)])))
    start, anchor, text = whole[first], anchor[first], text[first]
    shape = ((anchor - start) * 64 + number).astype(np.uint64)
    # at most W windows share an anchor, so the first and the last of them hold all words of the stretch
    halves = [_both(_both(of[start], of[start + number - 1]), shape) for of in (words.hashes(WINDOW, 0), words.hashes(WINDOW, 1))]
    return grams[anchor], *halves, text, start - words.first[text], number


def _merged(doc: np.ndarray, start: np.ndarray, end: np.ndarray, of: np.ndarray, shift: np.ndarray) -> tuple[np.ndarray, ...]:
    """Intervals of one document that touch, and repeat one document ``of`` at one distance ``shift``, joined."""
    if not len(doc):
        return doc, start, end, of, shift
    order = np.lexsort((start, shift, of, doc))
    doc, start, end, of, shift = (x[order] for x in (doc, start, end, of, shift))
    new = np.concatenate(([True], (np.diff(doc) != 0) | (np.diff(of) != 0) | (np.diff(shift) != 0)))
    offset = np.cumsum(new) * (int(end.max()) + 1)  # so that the running maximum starts afresh with each group
    reach = np.maximum.accumulate(end + offset) - offset
    new[1:] |= start[1:] > reach[:-1]
    first = np.nonzero(new)[0]
    return doc[first], start[first], np.maximum.reduceat(end, first), of[first], shift[first]


def _encoded(rows: pa.RecordBatch, text: int) -> list[bytes]:
    return strings(rows.column(text)).cast(pa.binary()).to_pylist()


def _packed(a: Column, n: Column) -> Column:
    """A stretch of n words from a as one number."""
    return F.shiftleft(a.cast("long"), 32) + n.cast("long")


#: An entry (n windows from a), or with h null n words from a that repeat those of document f from fa on.
_ENTRY = "h long, s1 long, s2 long, doc long, a int, n int, f long, fa int"
_REPEAT = "doc long, a int, n int, f long, fa int"


class _Common:
    """Stretches that a task met more than once, with their first occurrence so far; it starts afresh beyond MOST."""

    MOST = 200_000

    def __init__(self) -> None:
        self.h = self.s1 = self.s2 = np.zeros(0, np.uint64)
        self.doc = self.a = np.zeros(0, np.int64)

    def met(self, h: np.ndarray, s1: np.ndarray, s2: np.ndarray, doc: np.ndarray, a: np.ndarray) -> tuple[np.ndarray, ...]:
        """Which of distinct stretches repeat an earlier occurrence, which are it once more, and that occurrence; earlier ones become the first."""
        if not len(self.h):
            return np.zeros(len(h), bool), np.zeros(len(h), bool), doc, a
        at = np.minimum(np.searchsorted(self.h, h), len(self.h) - 1)
        known = (self.h[at] == h) & (self.s1[at] == s1) & (self.s2[at] == s2)
        same = known & (doc == self.doc[at]) & (a == self.a[at])
        after = known & ((doc > self.doc[at]) | ((doc == self.doc[at]) & (a > self.a[at])))
        before = known & ~after & ~same
        of, place = self.doc[at], self.a[at]
        self.doc[at[before]], self.a[at[before]] = doc[before], a[before]
        return after, same, of, place

    def add(self, h: np.ndarray, *rest: np.ndarray) -> None:
        new = ~np.isin(h, self.h)  # of a gram's stretches, the one that was common first
        if not new.any():
            return
        if len(self.h) + new.sum() > self.MOST:
            self.__init__()
        h, first = np.unique(np.concatenate((self.h, h[new])), return_index=True)
        self.h, (self.s1, self.s2, self.doc, self.a) = h, (np.concatenate((x, y[new]))[first] for x, y in zip((self.s1, self.s2, self.doc, self.a), rest, strict=True))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries, and repeats of what the same task met earlier."""
    common, names = _Common(), [x.split()[0] for x in _ENTRY.split(", ")]
    for batch in batches:
        for rows in portions(batch, 1):
            h, s1, s2, text, a, n = entries(Words(_encoded(rows, 1)))
            if not len(h):
                continue
            doc = rows.column(0).to_numpy(zero_copy_only=False)[text].astype(np.int64)
            order = np.lexsort((a, doc, s2, s1, h))
            h, s1, s2, doc, a, n = (x[order] for x in (h, s1, s2, doc, a.astype(np.int64), n))
            new = np.concatenate(([True], (np.diff(h) != 0) | (np.diff(s1) != 0) | (np.diff(s2) != 0)))
            starts = np.nonzero(new)[0]
            first = starts[np.cumsum(new) - 1]
            of, place = doc[first], a[first]
            late = (doc != of) | (a != place)
            again = np.diff(np.concatenate((starts, [len(h)]))) > 1
            late[starts], same, of[starts], place[starts] = common.met(*(x[starts] for x in (h, s1, s2, doc, a)))
            stays = new & ~late
            stays[starts[same]] = False
            common.add(*(x[starts[again]] for x in (h, s1, s2, doc, a)))
            gone, start, end, of, shift = _merged(doc[late], a[late], (a + n + WINDOW - 1)[late], of[late], (place - a)[late])
            none = lambda k, kind: pa.nulls(k, kind)
            longs, ints = (lambda x: pa.array(x.view(np.int64))), (lambda x: pa.array(x.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([longs(h[stays]), longs(s1[stays]), longs(s2[stays]), pa.array(doc[stays]), ints(a[stays]), ints(n[stays]), none(stays.sum(), pa.int64()), none(stays.sum(), pa.int32())], names=names)
            yield pa.RecordBatch.from_arrays([*[none(len(gone), pa.int64())] * 3, pa.array(gone), ints(start), ints(end - start), pa.array(of), ints(start + shift)], names=names)


def _unpacked(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Row, a, n and the rest of each element of a list of packed (a, n), or of structs that begin with it."""
    flat = lists.flatten()
    packed = (flat.field(0) if pa.types.is_struct(flat.type) else flat).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(lists)), np.diff(np.asarray(lists.offsets))), packed >> 32, packed & 0xFFFFFFFF, flat


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Both hashes of every window of the listed stretches (columns: doc, text, list of packed (a, n), whether hot)."""
    for batch in batches:
        for rows in portions(batch, 1):
            text, a, n, _ = _unpacked(rows.column(2))
            words = Words(_encoded(rows, 1), (text, a, a + n + WINDOW - 1))
            each = np.concatenate(([0], np.cumsum(n)))
            text, place = np.repeat(text, n), np.repeat(a - each[:-1], n) + np.arange(each[-1])
            start = words.first[text] + place
            inside = start + WINDOW <= words.first[text + 1]
            text, place, start = pa.array(text[inside]), place[inside], words.at[start[inside]]
            halves = [pa.array(words.hashes(WINDOW, i)[start].view(np.int64)) if len(start) else pa.nulls(0, pa.int64()) for i in range(2)]
            yield pa.RecordBatch.from_arrays([*halves, rows.column(0).take(text), pa.array(place.astype(np.int32)), rows.column(3).take(text)], names=["w1", "w2", "doc", "a", "hot"])


def _sha(words: list[bytes], a: int, n: int) -> bytes:
    return hashlib.sha256(b" ".join(words[a : a + n])).digest()


def _wholes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole intervals from proposals (columns: doc, list of (packed (a, n), f, fa))."""
    for batch in batches:
        row, a, n, flat = _unpacked(batch.column(1))
        of, place = (flat.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (1, 2))
        row, a, end, of, shift = _merged(row, a, a + n, of, place - a)
        ints = lambda x: pa.array(x.astype(np.int32))
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), ints(a), ints(end - a), pa.array(of), ints(a + shift)], names=["doc", "a", "n", "f", "fa"])


#: Marks a packed interval of words that are to go.
_GOES = 1 << 31
_PASSED = "_id long, n_words long, n_removed long, kept_text string, a int, n int, sha binary"


def _passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each text (columns: doc, text, list of packed (a, n), marked if it is to go, or null) what stays, and (n_words null) digests of the listed intervals."""
    names, kinds = [x.split()[0] for x in _PASSED.split(", ")], [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.binary()]
    for batch in batches:
        for rows in portions(batch, 1):
            results, digests = [], []
            for doc, text, listed in zip(rows.column(0).to_pylist(), _encoded(rows, 1), rows.column(2), strict=True):
                words = text.split()
                rest = words
                if listed.is_valid:
                    packed = listed.values.to_numpy(zero_copy_only=False)
                    a, n, goes = packed >> 32, packed & (_GOES - 1), (packed & _GOES) > 0
                    rest = _rest(words, a[goes], n[goes])
                    digests += [(doc, None, None, None, x, k, hashlib.sha256(b" ".join(words[x : x + k])).digest()) for x, k in set(zip(a.tolist(), n.tolist(), strict=True))]
                results.append((doc, len(words), len(words) - len(rest), b" ".join(rest).decode(), None, None, None))
            for part in (results, digests):
                if part:
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*part, strict=True), kinds, strict=True)], names=names)


def _rest(words: list[bytes], start: np.ndarray, n: np.ndarray) -> list[bytes]:
    """The words that no interval covers."""
    if not len(start):
        return words
    place = lambda x: np.bincount(np.minimum(x, len(words)), minlength=len(words) + 1)
    stays = np.cumsum((place(start) - place(start + n))[:-1]) == 0
    return [w for w, k in zip(words, stays.tolist(), strict=True) if k]


class Runs:
    """Sorted immutable runs, segments of a store: bucketed and sorted by a key, of rows told apart by ``same``, each at its first (doc, a). They are merged in levels."""

    def __init__(self, store: SegmentStore, group: str, same: list[str], fan_out: int) -> None:
        self.store, self.group, self.same, self.fan_out, self.merges = store, group, same, max(2, fan_out), 0

    @property
    def sizes(self) -> dict[str, int]:
        return {s["folder"]: s["rows"] for s in self.store.segments(self.group)}

    @property
    def buckets(self) -> int:
        own = self.store.state["groups"].get(self.group)
        return own["buckets"] if own else min(100_000, int(self.store.spark.conf.get("spark.sql.shuffle.partitions")))

    def add(self, rows: DataFrame, dealt: bool = False) -> DataFrame | None:
        """Writes a run (dealt: its rows lie in their buckets already); the run, or None if there is no row."""
        return self.store.add(self.group, rows, self.same[0], (self.same[0],), dealt)

    def tables(self) -> list[DataFrame]:
        return self.store.tables(self.group)

    def compact(self) -> None:
        """Merges runs while ``fan_out`` of them are of one level; each then holds every row once, at its first occurrence."""
        while True:
            levels: dict[int, list[str]] = {}
            for name, rows in self.sizes.items():
                levels.setdefault(int(math.log(rows, self.fan_out) + 0.5), []).append(name)
            full = next((names for _, names in sorted(levels.items()) if len(names) >= self.fan_out), None)
            if full is None:
                return
            # runs come in ascending order of documents, so of equal rows the older run's are first: each run adds what no older one has
            key, older = self.same[0], []
            for table in [self.store.table(self.group, name) for name in full]:
                rows = table
                for old in older:
                    known = old.select(key, *[F.col(c).alias(f"_{c}") for c in self.same[1:]])
                    # one condition over both sides, so that it is no join key: only a join by the key leaves the runs where they are. Dealt by more, each task would hold, and write, rows of all buckets
                    unlike = reduce(Column.bitwiseOR, [rows[c].bitwiseXOR(known[f"_{c}"]) for c in self.same[1:]])
                    rows = rows.join(known, (rows[key] == known[key]) & (unlike == 0), "left_anti")
                older.append(rows)
            # grouped (each row is one already), so that the plan reads the oldest run by its buckets too
            rest = [c for c in older[0].columns if c not in self.same]
            older[0] = older[0].groupBy(*self.same).agg(*[F.first(c).alias(c) for c in rest]).select(older[0].columns)
            self.add(_union(older), dealt=True)
            self.merges += 1
            for name in full:
                self.store.drop(self.group, name)


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.union(t)
    return out


class SubstringIndex:
    """Runs of earlier batches, their texts, and what each batch repeats.

    ``docs``: where batches given as conditions come from. ``path``: the index's folder, if it is to stay; else ``close`` removes it.
    ``hot_least``: entries of one gram in a batch from which it may be hot.
    """

    def __init__(self, docs: DataFrame | None, id_col: str = "doc_id", text_col: str = "text", fan_out: int = FAN_OUT, hot_least: int = HOT_LEAST, path: str | None = None, spark: SparkSession | None = None) -> None:
        self.spark: SparkSession = spark or docs.sparkSession
        self.id_col, self.text_col = id_col, text_col
        self.docs = None if docs is None else self._named(docs)
        self.stays, self.store, self.hot_least, self.spent = path is not None, SegmentStore(self.spark, path or new_path(self.spark, "index")), hot_least, []
        self.stretches, self.windows = Runs(self.store, "stretches", ["h", "s1", "s2"], fan_out), Runs(self.store, "windows", ["w1", "w2"], fan_out)

    @classmethod
    def open(cls, spark: SparkSession, path: str, **options) -> SubstringIndex:
        """The index that was committed at ``path``, by this session or another; an empty one if there is none."""
        return cls(None, path=path, spark=spark, **options)

    def _named(self, docs: DataFrame) -> DataFrame:
        return docs.select(F.col(self.id_col).cast("long").alias("doc"), F.coalesce(F.col(self.text_col), F.lit("")).alias("text"))

    @property
    def highest(self) -> int | None:
        """The largest id of all batches."""
        return max((s["high"] for s in self.store.segments("texts")), default=None)

    @property
    def hot(self) -> DataFrame | None:
        """The grams that are hot."""
        return self.store.rows("hot")

    def _hot(self, raw: DataFrame) -> DataFrame | None:
        """Grams of the batch that are hot but were not yet; None if there is none. A bucket holds HOT_SHARE of the least of them at most, so there are few."""
        entries_ = raw.where("h IS NOT NULL")
        all_ = entries_.count()
        least = max(self.hot_least, all_ // (HOT_SHARE * self.stretches.buckets))
        if self.hot_least >= SAMPLED:
            entries_, least = entries_.where(F.pmod("s1", F.lit(SAMPLED)) == 0), least // SAMPLED
        found = entries_.groupBy("h").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") >= least).select("h")
        if (known := self.hot) is not None:
            found = found.join(known, "h", "left_anti")
        return self.store.add("hot", found, "h")

    def ingest(self, batch) -> DataFrame:
        """Adds a batch: a table, or the documents that fulfil a condition (on ``doc``). Its ids must be above all before; rows without one are left out.

        What it repeats comes back: n words from a in doc, as from fa in f.
        """
        new = (self._named(batch) if isinstance(batch, DataFrame) else self.docs.where(batch)).where("doc IS NOT NULL")
        before = self.highest
        texts = self.store.add("texts", new, "doc")
        if texts is None:
            return self.spark.createDataFrame([], _REPEAT)
        low, high = texts.agg(F.min("doc"), F.max("doc")).first()
        self.store.segments("texts")[-1].update(low=low, high=high)
        if before is not None and low <= before:
            self.store.drop("texts", self.store.segments("texts")[-1]["folder"])
            raise ValueError(f"ids of a batch must be above {before}")
        batch = F.lit(True) if before is None else F.col("doc") > before
        raw = written(texts.mapInArrow(_scan, _ENTRY), "run-raw")
        own = written(raw.where("h IS NULL").select("doc", "a", "n", "f", "fa"), "run-own")
        self.spent[:0] = [raw, own]
        entries_ = raw.where("h IS NOT NULL").select("h", "s1", "s2", "doc", "a", "n")
        newly, at, hot_listed = self._hot(raw), F.struct("doc", "a"), None
        if newly is not None:
            old = [joined(r, newly, "h", "left_semi", 8).select("doc", "a", "n") for r in self.stretches.tables()]
        if (all_hot := self.hot) is not None:
            hot = joined(entries_, all_hot, "h", "left_semi", 8).select("doc", "a", "n")
            hot_listed = _union([hot, *old]) if newly is not None else hot
            entries_ = joined(entries_, all_hot, "h", "left_anti", 8)
        earlier = self.stretches.tables()
        new = self.stretches.add(entries_)
        repeats, listed = [own], []
        if new is not None:
            grams = new.groupBy("h").agg(F.count(F.lit(1)).alias("c"))
            met = _union([new, *[r.join(grams.hint("shuffle_hash"), "h", "left_semi") for r in earlier]])  # bucketed by h throughout: neither this nor the grouping shuffles
            firsts, gram = met.groupBy("h", "s1", "s2").agg(F.min(at).alias("first"), F.first("n").alias("n"), F.count(F.lit(1)).alias("c")), Window.partitionBy("h")
            unlike = F.count(F.lit(1)).over(gram) > 1  # a row is a stretch
            firsts = written(firsts.select("*", unlike.alias("unlike")).where("c > 1 OR unlike"), "run-firsts")
            self.spent.append(firsts)
            known = firsts.where("c > 1").select("h", F.col("s1").alias("k1"), F.col("s2").alias("k2"), "first")
            # equal halves as one condition that is no join key, since only a join by h alone leaves the run where it is
            again = new.join(known.hint("shuffle_hash"), "h").where((F.col("s1").bitwiseXOR(F.col("k1")).bitwiseOR(F.col("s2").bitwiseXOR(F.col("k2"))) == 0) & (at > F.col("first")))
            repeats.append(again.select("doc", "a", (F.col("n") + WINDOW - 1).alias("n"), F.col("first.doc").alias("f"), F.col("first.a").alias("fa")))
            listed.append(firsts.where("unlike").select("first.doc", "first.a", "n", F.lit(False).alias("hot")))
        if hot_listed is not None:
            listed.append(hot_listed.withColumn("hot", F.lit(True)))
        if listed:
            repeats.append(self._by_window(_union(listed), batch))
        repeats = written(_union(repeats), "run-repeats")
        self._delete_spent()
        self.stretches.compact()
        self.windows.compact()
        self.store.commit()
        self.store.vacuum()
        return repeats

    def _delete_spent(self) -> None:
        for table in self.spent:
            delete(self.spark, table)
        self.spent = []
        self._free_shuffles()

    def _free_shuffles(self) -> None:
        """Shuffle files of finished jobs go when the driver has collected what refers to them, which a driver with memory left would put off to the end."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def only_texts(self) -> None:
        """Drops all runs from the index, for one that takes no further batch."""
        for group in ("stretches", "windows", "hot"):
            for s in self.store.segments(group):
                self.store.drop(group, s["folder"])
        self.store.vacuum()
        self._free_shuffles()

    def _by_window(self, listed: DataFrame, batch) -> DataFrame:
        """Of the listed stretches (doc, a, n, hot), the windows that repeat an earlier one; those that are hot are met with their runs and added to them."""
        lists = written(listed.groupBy("doc", "hot").agg(F.collect_list(_packed(F.col("a"), F.col("n"))).alias("at")), "run-unlike")
        delete(self.spark, self.spent.pop(0))  # the raw entries: all of them are in runs or lists now
        self._free_shuffles()
        low, high, any_hot = lists.agg(F.min("doc"), F.max("doc"), F.max("hot")).first()
        if low is None:
            return self.spark.createDataFrame([], _REPEAT)
        read = [t for s, t in zip(self.store.segments("texts"), self.store.tables("texts"), strict=True) if s["low"] <= high and s["high"] >= low]
        texts = _union([_listed(t, lists, "inner").select("doc", "text", "at", "hot") for t in read])
        found = written(texts.mapInArrow(_windows, "w1 long, w2 long, doc long, a int, hot boolean").coalesce(self.stretches.buckets), "run-windows")
        firsts = found.groupBy("w1", "w2").agg(F.min(F.struct("doc", "a")).alias("first"), F.count(F.lit(1)).alias("c"), F.max("hot").alias("hot"))
        earliest = firsts.where("c > 1").select("w1", "w2", "first")
        if any_hot:
            earlier = self.windows.tables()
            new = self.windows.add(firsts.where("hot").select("w1", "w2", "first.doc", "first.a"))
            if new is not None and earlier:
                keys = new.groupBy("w1").agg(F.count(F.lit(1)).alias("c"))
                earliest = _union([earliest] + [r.join(keys, "w1", "left_semi").select("w1", "w2", F.struct("doc", "a").alias("first")) for r in earlier])
                earliest = earliest.groupBy("w1", "w2").agg(F.min("first").alias("first"))
        earliest = written(earliest, "run-earliest")
        self.spent += [lists, found, earliest]
        late = found.join(earliest.hint("merge"), ["w1", "w2"]).where((F.struct("doc", "a") > F.col("first")) & batch)
        return late.select("doc", "a", F.lit(WINDOW).alias("n"), F.col("first.doc").alias("f"), F.col("first.a").alias("fa"))

    def without(self, repeats: DataFrame) -> DataFrame:
        """Of every document (``_id``, ``n_words``, ``n_removed``, ``kept_text``) what is left without its proposed repeats, where their words are those of the earlier place.

        One pass takes the words away and digests (SHA-256) both places of every repeat. Documents with a repeat that its digests
        refute are gone through again without it.
        """
        lists = repeats.groupBy("doc").agg(F.collect_list(F.struct(_packed(F.col("a"), F.col("n")).alias("p"), "f", "fa")).alias("at"))
        claims = written(lists.mapInArrow(_wholes, _REPEAT), "claims")
        asked = claims.select(F.col("f").alias("doc"), _packed(F.col("fa"), F.col("n")).alias("p")).distinct()
        going = _packed(F.col("a"), F.col("n")).bitwiseOR(F.lit(_GOES)).alias("p")
        both = claims.select("doc", going).union(asked)
        passed = written(self._pass(self._texts(), both), "passed")
        shown = passed.where("n_words IS NULL").groupBy("_id", "a", "n").agg(F.min("sha").alias("sha"), F.max("sha").alias("other"))
        shown = written(shown.where("sha = other").select("_id", "a", "n", "sha"), "claims-digests")
        own = claims.join(shown.select(F.col("_id").alias("doc"), "a", "n", F.col("sha").alias("own")).hint("merge"), ["doc", "a", "n"], "left")
        proved = own.join(shown.select(F.col("_id").alias("f"), F.col("a").alias("fa"), "n", "sha").hint("merge"), ["f", "fa", "n"], "left")
        refuted = written(proved.where(~F.coalesce(F.col("own") == F.col("sha"), F.lit(False))).select("doc", "a", "n", "f", "fa"), "claims-refuted")
        results = passed.where("n_words IS NOT NULL").drop("a", "n", "sha")
        if refuted.isEmpty():
            return results
        odd = written(refuted.select("doc").distinct(), "claims-odd")
        left = claims.join(odd, "doc", "left_semi").join(refuted, ["doc", "a", "n", "f", "fa"], "left_anti").select("doc", going)
        again = self._pass([_listed(t, odd, "left_semi") for t in self._texts()], left).where("n_words IS NOT NULL").drop("a", "n", "sha")
        return results.join(odd.withColumnRenamed("doc", "_id"), "_id", "left_anti").union(written(again, "passed-again"))

    def _texts(self) -> list[DataFrame]:
        """All documents: those ingested, or before any is, those that the index was made for."""
        return self.store.tables("texts") or [self.docs]


    def _pass(self, texts: list[DataFrame], listed: DataFrame) -> DataFrame:
        lists = written(listed.groupBy("doc").agg(F.collect_list("p").alias("at")), "removed-lists")
        return _union([_listed(t, lists, "left").select("doc", "text", "at").mapInArrow(_passed, _PASSED) for t in texts]).coalesce(self.stretches.buckets)

    def close(self) -> None:
        """Ends the use of the index; one without a path of its own goes with all its files."""
        if self.stays:
            self.store.close()
        else:
            self.store.remove()
            self.store.state["groups"] = {}


def _listed(texts: DataFrame, lists: DataFrame, how: str) -> DataFrame:
    """Texts with what is listed for their documents. The lists are dealt to the buckets of texts and hashed there; texts are neither moved nor sorted, at whatever size."""
    return texts.join(lists.hint("shuffle_hash"), "doc", how)


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batches: int = BATCHES, fan_out: int = FAN_OUT, hot_least: int = HOT_LEAST) -> DataFrame:
    """A row per input row: ``id_col``, ``n_words``, ``n_removed``, ``kept_text`` (kept words joined by a space)."""
    index = SubstringIndex(docs, id_col, text_col, fan_out, hot_least)
    cuts = docs.agg(F.percentile_approx(F.col(id_col).cast("long"), [i / batches for i in range(1, batches)], 1000)).first()[0] if batches > 1 else []
    cuts = sorted(set(cuts or []))
    doc, gone = F.col("doc"), []
    try:
        for low, high in zip([None, *cuts], [*cuts, None], strict=True):
            batch = (F.lit(True) if low is None else doc > low) & (F.lit(True) if high is None else doc <= high)
            gone.append(index.ingest(batch))
        index.only_texts()
        kept = index.without(_union(gone)) if index.highest is not None else None
    finally:
        index.close()
    rest = index.docs.where("doc IS NULL").select("doc", "text", F.lit(None).cast("array<long>").alias("at")).mapInArrow(_passed, _PASSED).drop("a", "n", "sha")
    return (rest if kept is None else kept.union(rest)).withColumnRenamed("_id", id_col)
