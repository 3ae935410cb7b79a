"""Removal of long repeats by column-wise construction of multi-document Burrows-Wheeler transforms.

A text is a sequence of symbols: its bytes (``remove_repeats``: strings of 400 bytes that start anywhere else, same text included) or its
words (``remove_passages``: 50 words in a row that another text holds too, whatever the white space between them). What follows
names bytes; words are the same with 8-word grams and 64-bit word hashes as symbols, and "another string" means one of another text.

Distribution. Two equal windows of ``length`` bytes have the same smallest 64-byte-gram hash. Every document is cut into runs of windows
with the same smallest hash ("super-windows": the bytes of the run's windows, at most 511 + length of them); equal windows
meet under the same hash. Runs with equal bytes are counted first, by partial aggregation, so copies in thousands are one row:
a run seen twice repeats whole. Text is fetched only for runs that were seen once and share their hash with a different
run (or hold it twice), and for the runs they are to be compared with.

Those runs form bounded collections of whole hash groups, aligned at the place of their smallest gram (runs that hold it more
than once are divided by the first place in each window), so that equal windows start in the same column. A collection is
sorted column-wise from the last column to the first: each round inserts one symbol per string, the order of the round is the
stable order of the symbols over the order of the round before (the LF step of the Burrows-Wheeler transform), and the common
prefix lengths of neighbours are one more than range minima of the lengths before. A round reads and writes its segment of
the transform and of the lengths in order, as sequential files would be; suffixes of earlier columns can't equal a window
of this one, so only the newest column is kept, and being bounded it stays in the task: no machine-local file is needed.
Neighbours with a common prefix of ``length`` bytes or more are repeats. A hash group too large for one collection is split
further, window by window, with partial counts.

Defined results: null text is the empty text; texts shorter than ``length`` bytes lose nothing; rows that repeat a text (with or
without the same doc_id) are occurrences of each other; null ids pass through; columns beside ``doc_id`` and ``text`` are
ignored by the report. Between documents (passages), rows of one text are one document: copies of whole texts stay, and so does what
only one text repeats.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from votepanel.llm.hashing import U, WordIds, mix, odd_constants
from votepanel.session import cut_lineage

CHUNK, MAX_RUN = 65_536, 512
#: Strings of one collection; larger hash groups are split by window.
COLLECTION = 4096


@dataclass(frozen=True)
class Alphabet:
    """What a text is a sequence of: the symbols of its bytes (``reader()`` makes a task's function for them), and how many make a gram.
    ``across``: only repeats in other texts count."""

    reader: Callable[[], Callable[[bytes], np.ndarray]]
    kind: type
    gram: int
    across: bool


def _byte_reader() -> Callable[[bytes], np.ndarray]:
    return lambda data: np.frombuffer(data, np.uint8)


def _word_reader() -> Callable[[bytes], np.ndarray]:
    ids = WordIds()
    return lambda data: ids.of(data.split())


BYTES = Alphabet(_byte_reader, np.uint8, 64, False)
WORDS = Alphabet(_word_reader, np.uint64, 8, True)


class RollingHash:
    """Hashes of all grams of a symbol array, from prefix sums of a polynomial modulo 2^64."""

    def __init__(self, size: int) -> None:
        base = int(odd_constants(1, 71)[0])
        inverse = pow(base, -1, 1 << 64)
        self.power, self.inverse = np.ones(size + 1, np.uint64), np.ones(size + 1, np.uint64)
        self.power[1:], self.inverse[1:] = U(base), U(inverse)
        np.cumprod(self.power, out=self.power)
        np.cumprod(self.inverse, out=self.inverse)
        self.of_byte = mix(np.arange(1, 257, dtype=np.uint64) * U(0x9E3779B97F4A7C15))

    def grams(self, data: np.ndarray, n: int) -> np.ndarray:
        prefix = np.zeros(len(data) + 1, np.uint64)
        values = self.of_byte[data] if data.dtype == np.uint8 else data
        np.cumsum(values * self.power[: len(data)], out=prefix[1:])
        m = len(data) - n + 1
        return mix((prefix[n:] - prefix[:m]) * self.inverse[:m])


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w neighbours: prefix and suffix minima of blocks of w."""
    n = len(x)
    padded = np.full(-(-n // w) * w, ~U(0))
    padded[:n] = x
    blocks = padded.reshape(-1, w)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - w + 1], left[w - 1 : n])


def super_windows(whole: np.ndarray, length: int, gram: int, rolling: RollingHash) -> tuple[np.ndarray, ...]:
    """Runs of windows with one smallest gram hash: (hash, first window, windows, hash occurs twice, content hash)."""
    out: list[list] = [[], [], [], []]
    digests = []
    data, item = whole.tobytes(), whole.itemsize
    for c in range(0, len(whole) - length + 1, CHUNK):
        part = whole[c : c + CHUNK + length - 1]
        g = rolling.grams(part, gram)
        low = sliding_min(g, length - gram + 1)
        start = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
        size = np.diff(np.append(start, len(low)))
        if size.max() > MAX_RUN:
            extra = -(-size // MAX_RUN)
            k = np.arange(extra.sum()) - np.repeat(np.cumsum(extra) - extra, extra)
            start, left = np.repeat(start, extra) + k * MAX_RUN, np.repeat(size, extra) - k * MAX_RUN
            size = np.minimum(left, MAX_RUN)
        value = low[start]
        span = length - gram
        out[0].append(value)
        out[1].append(start + c)
        out[2].append(size)
        out[3].append(np.fromiter((np.count_nonzero(g[s : s + n + span] == v) > 1 for s, n, v in zip(start.tolist(), size.tolist(), value, strict=True)), bool, len(start)))
        digests += [xxhash.xxh3_64_intdigest(data[item * s : item * (s + n + length - 1)]) for s, n in zip((start + c).tolist(), size.tolist(), strict=True)]
    if not digests:
        return tuple(np.empty(0, t) for t in (np.int64, np.int64, np.int64, bool, np.int64))
    mh, first, size, twice = (np.concatenate(x) for x in out)
    return mh.view(np.int64), first.astype(np.int64), size.astype(np.int64), twice, np.array(digests, np.uint64).view(np.int64)


RUN_TYPE = pa.struct([("mh", pa.int64()), ("first", pa.int64()), ("size", pa.int64()), ("twice", pa.bool_()), ("c", pa.int64())])


def _cut(length: int, alphabet: Alphabet):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling, symbols = RollingHash(CHUNK + length), alphabet.reader()
        for whole in batches:
            for k in range(0, whole.num_rows, 64):
                batch = whole.slice(k, 64)
                sizes, shas, parts, offsets = [], [], [], [0]
                for text in batch.column(2):
                    data = (text.as_py() or "").encode()
                    sizes.append(len(data))
                    shas.append(hashlib.sha256(data).hexdigest())
                    parts.append(super_windows(symbols(data), length, alphabet.gram, rolling))
                    offsets.append(offsets[-1] + len(parts[-1][0]))
                fields = [pa.array(np.concatenate(x)) for x in zip(*parts, strict=True)]
                runs = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(fields, fields=list(RUN_TYPE)))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(shas), runs], names=["doc_id", "key", "n_bytes", "sha", "runs"])

    return run


def _keyed(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``key`` and the text."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), _key().alias("key"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def _key() -> Column:
    """The identity of a text, on which alone the result depends: 128 bits of its bytes."""
    return F.unhex(F.md5(F.coalesce(F.col("text").cast("string"), F.lit(""))))


def column_order_repeats(strings: list[bytes], anchors: np.ndarray, windows: np.ndarray, length: int, kind: type = np.uint8, owners: np.ndarray | None = None) -> list[np.ndarray]:
    """Per string, which of its first ``windows[i]`` windows also start in another string at the same distance from the anchor.

    ``anchors[i]``: place of the string's anchor. Every window holds its anchor, so equal windows are in one column. ``kind``: the symbols
    that the bytes of a string are. ``owners[i]``: strings of one owner don't count for each other."""
    n = len(strings)
    text = np.frombuffer(b"".join(strings), kind)
    sizes = np.fromiter(map(len, strings), np.int64, n) // text.itemsize
    owners = np.arange(n) if owners is None else owners
    begin = np.cumsum(sizes) - sizes
    right = sizes - anchors
    found = [np.zeros(w, bool) for w in windows.tolist()]
    joins = np.argsort(-right, kind="stable")  # strings enter in order of their right end
    ends = -right[joins]
    order, lcp, entered = np.empty(0, np.int64), np.empty(0, np.int64), 0
    for column in range(int(right.max()) - 1, -int(anchors.max()) - 1, -1):
        upto = int(np.searchsorted(ends, -column, side="left"))  # right end > column
        if upto > entered:  # their suffix after this column is empty: first in the order, no common prefix
            order = np.concatenate([joins[entered:upto], order])
            lcp = np.concatenate([np.zeros(upto - entered, np.int64), lcp])
            entered = upto
        here = anchors[order] + column >= 0
        if not here.all():  # strings that begin right of this column leave; the gap keeps the smaller common prefix
            keep = np.flatnonzero(here)
            if not len(keep):
                break
            lcp = np.minimum.reduceat(lcp[: keep[-1] + 1], np.concatenate([[0], keep[:-1] + 1]))
            order = order[keep]
            lcp[0] = 0
        symbol = text[begin[order] + anchors[order] + column]
        turn = np.argsort(symbol, kind="stable")
        same = symbol[turn[1:]] == symbol[turn[:-1]]
        lcp = np.concatenate([[0], np.where(same, 1 + range_minima(lcp, turn[:-1] + 1, turn[1:]), 0)])
        order = order[turn]
        if (lcp >= length).any():  # equal windows are neighbours: classes of them, and whether a class has two owners
            start = np.flatnonzero(lcp < length)
            shared = np.minimum.reduceat(owners[order], start) != np.maximum.reduceat(owners[order], start)
            at = anchors + column
            for i in order[np.repeat(shared, np.diff(np.append(start, len(order))))].tolist():
                if at[i] < windows[i]:
                    found[i][at[i]] = True
    return found


def range_minima(x: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """min(x[first..last]) for many ranges, from minima of power-of-two stretches; a range with first > last is taken as empty."""
    out = np.zeros(len(first), x.dtype)
    span = last - first + 1
    level, width = x, 1
    todo = span > 0
    while todo.any():
        now = todo & (span < 2 * width)
        if now.any():
            out[now] = np.minimum(level[first[now]], level[last[now] - width + 1])
            todo &= ~now
        if len(level) <= width:
            break
        level, width = np.minimum(level[:-width], level[width:]), 2 * width
    return out


def _fetch(length: int, alphabet: Alphabet):
    """Rows of (text, cuts) -> the strings to compare, one per place of the smallest gram; no key: other texts hold the string too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling, symbols = RollingHash(MAX_RUN + length), alphabet.reader()
        span = length - alphabet.gram
        for batch in batches:
            for row in range(batch.num_rows):
                data = symbols(batch.column(0)[row].as_py().encode())
                rows: list[list] = [[] for _ in range(8)]
                for cut in batch.column(1)[row].as_py():
                    s, n = cut["first"], cut["size"]
                    part = data[s : s + n + length - 1]
                    places = np.flatnonzero(rolling.grams(part, alphabet.gram) == np.int64(cut["mh"]).view(np.uint64))
                    before = -1
                    for p in places.tolist():
                        lo, hi = max(0, before + 1, p - span), min(n, p + 1)  # windows whose first place is p
                        before = p
                        if lo < hi:
                            string = data[s + lo : s + hi + length - 1].tobytes()
                            for col, v in zip(rows, (cut["mh"], cut["nd"], xxhash.xxh3_64_intdigest(string) - (1 << 63), string, p - lo, hi - lo, cut["key"] if cut["single"] else None, s + lo), strict=True):
                                col.append(v)
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows, kinds, strict=True)], names=STRINGS)

    return run


STRINGS = ["mh", "nd", "content", "string", "anchor", "windows", "key", "first"]


def _compare(length: int, alphabet: Alphabet):
    """Sorted strings of whole hash groups -> the repeated windows of those that were seen once, as (key, first, size)."""

    def solve(rows: pa.Table) -> pa.RecordBatch:
        cols = {c: rows.column(c).combine_chunks() for c in ("mh", "content", "anchor", "windows", "key", "first")}
        strings = rows.column("string").to_pylist()
        anchors, windows, first = (cols[c].to_numpy() for c in ("anchor", "windows", "first"))
        keys = cols["key"].to_pylist()
        # equal strings repeat whole (in one text only, if that counts); one of them is compared with the others
        seen: dict[tuple, list[int]] = {}
        for i, x in enumerate(zip(anchors.tolist(), strings, strict=True)):
            seen.setdefault(x, []).append(i)
        one = [v[0] for v in seen.values()]
        shared = [len(v) > 1 and (not alphabet.across or len({keys[i] for i in v}) > 1) for v in seen.values()]
        number: dict[bytes | int, int] = {}
        owners = np.array([number.setdefault(i if not alphabet.across or many or keys[i] is None else keys[i], len(number)) for i, many in zip(one, shared, strict=True)])
        marks = column_order_repeats([strings[i] for i in one], anchors[one], windows[one], length, alphabet.kind, owners)
        out: list[list] = [[], [], []]
        for same, mark, many in zip(seen.values(), marks, shared, strict=True):
            if many:
                mark[:] = True
            if not mark.any():
                continue
            edge = np.flatnonzero(np.diff(np.concatenate([[0], mark.view(np.int8), [0]])))
            for i in same:
                if keys[i] is not None:
                    for a, b in edge.reshape(-1, 2).tolist():
                        for col, v in zip(out, (keys[i], int(first[i]) + a, b - a), strict=True):
                            col.append(v)
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.binary(), pa.int64(), pa.int64()), strict=True)], names=["key", "first", "size"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_rows: list[pa.RecordBatch] = []
        held = 0
        for batch in batches:
            mh = batch.column(0).to_numpy()
            starts = np.concatenate([[0], np.flatnonzero(mh[1:] != mh[:-1]) + 1, [len(mh)]]) if len(mh) else np.array([0])
            for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                new_group = not open_rows or open_rows[-1].column(0)[-1].as_py() != int(mh[a])
                if new_group and held >= COLLECTION:
                    yield solve(pa.Table.from_batches(open_rows))
                    open_rows, held = [], 0
                open_rows.append(batch.slice(a, b - a))
                held += b - a
        if open_rows:
            yield solve(pa.Table.from_batches(open_rows))

    return run


def _windows(length: int, alphabet: Alphabet):
    """Strings of very large hash groups -> one row per window."""

    item = np.dtype(alphabet.kind).itemsize

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                string, n = batch.column(3)[row].as_py(), batch.column(5)[row].as_py()
                digests = np.frombuffer(b"".join(xxhash.xxh3_128_digest(string[item * i : item * (i + length)]) for i in range(n)), np.int64).reshape(-1, 2)
                key, first = batch.column(6)[row].as_py(), batch.column(7)[row].as_py()
                yield pa.RecordBatch.from_arrays([pa.array(digests[:, 0]), pa.array(digests[:, 1]), pa.array([key] * n, pa.binary()), pa.array(np.arange(first, first + n))], names=["w1", "w2", "key", "first"])

    return run


def _merge(length: int):
    """Lists of repeated windows -> maximal spans, their number and their symbols."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, n_removed = [], []
            for found in batch.column(1):
                first, size = (found.values.field(k).to_numpy() for k in (0, 1))
                turn = np.argsort(first, kind="stable")
                lo, hi = first[turn], (first + size)[turn] + length - 1
                top = np.maximum.accumulate(hi)
                new = np.flatnonzero(np.concatenate([[True], lo[1:] > top[:-1]]))
                lo, hi = lo[new], np.append(top[new[1:] - 1], top[-1])
                spans.append(np.stack([lo, hi], axis=1).ravel())
                n_removed.append(int((hi - lo).sum()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_removed, pa.int64()), pa.array([len(x) // 2 for x in spans], pa.int64()), pa.array(spans, pa.list_(pa.int64()))], names=["key", "n_removed", "n_spans", "spans"])

    return run


def repeated_spans(docs: DataFrame, length: int = 400, alphabet: Alphabet = BYTES) -> tuple[DataFrame, DataFrame]:
    """``(scan, spans)``: per row ``doc_id, key, n_bytes, sha`` of its text; per text with repeats ``key, n_removed, n_spans, spans``
    (spans: from, to, from, to, ... in symbols)."""
    scan = cut_lineage(_keyed(docs).mapInArrow(_cut(length, alphabet), "doc_id long, key binary, n_bytes long, sha string, runs array<struct<mh:long,first:long,size:long,twice:boolean,c:long>>"), "scan")
    runs = scan.select("key", F.explode("runs").alias("r")).select("key", "r.*")
    by_content = ["mh", "c", "size"]  # two 64-bit hashes and the size
    # what is shuffled is kept small: the key once, or twice where the texts of a run count
    low, more = F.min(F.struct("key", "first")).alias("low"), [F.max("key").alias("last_key")] if alphabet.across else [F.count(F.lit(1)).alias("cnt"), F.max("twice").alias("twice")]
    single = F.col("low.key") == F.col("last_key") if alphabet.across else F.col("cnt") == 1
    counted = cut_lineage(runs.groupBy(*by_content).agg(low, *more).select(*by_content, single.alias("single"), "low.key", "low.first", "last_key" if alphabet.across else "twice"), "runs")
    rivals = F.min("key") != F.max("last_key") if alphabet.across else (F.count(F.lit(1)) > 1) | F.max("twice")
    groups = counted.groupBy("mh").agg(F.count(F.lit(1)).alias("nd"), F.bool_or("single").alias("open"), rivals.alias("rivals"))
    cuts = counted.join(groups.where("open and rivals"), "mh")
    per_text = cuts.groupBy("key").agg(F.collect_list(F.struct("mh", "nd", "single", "first", "size", "key")).alias("cuts"))
    # one row of each needed text, whichever
    one = scan.select("key", F.col("doc_id").alias("id")).groupBy("key").agg(F.min("id").alias("id"))
    needed = per_text.join(one, "key")
    texts = _keyed(docs).join(needed, "key").where("doc_id <=> id").drop("id")
    strings = cut_lineage(texts.select("text", "cuts").mapInArrow(_fetch(length, alphabet), "mh long, nd long, content long, string binary, anchor long, windows long, key binary, first long").dropDuplicates(["mh", "content", "key", "first"]), "strings")
    small = strings.where(F.col("nd") <= COLLECTION).repartition("mh").sortWithinPartitions("mh")
    compared = small.mapInArrow(_compare(length, alphabet), "key binary, first long, size long")
    windows = strings.where(F.col("nd") > COLLECTION).mapInArrow(_windows(length, alphabet), "w1 long, w2 long, key binary, first long")
    several = (F.min("key") != F.max("key")) | (F.count("key") < F.count(F.lit(1))) if alphabet.across else F.count(F.lit(1)) > 1
    again = windows.groupBy("w1", "w2").agg(several.alias("several")).where("several")
    split = windows.where("key is not null").join(again.select("w1", "w2"), ["w1", "w2"], "left_semi").select("key", "first", F.lit(1).cast("long").alias("size"))
    whole = runs.join(counted.where("not single").select(*by_content), by_content, "left_semi").select("key", "first", "size")
    found = whole.unionByName(compared).unionByName(split).distinct()
    listed = found.groupBy("key").agg(F.collect_list(F.struct("first", "size")).alias("found"))
    spans = cut_lineage(listed.mapInArrow(_merge(length), "key binary, n_removed long, n_spans long, spans array<bigint>"), "spans")
    return scan, spans


def _kept_bytes(data: bytes, spans: list[int]) -> bytes:
    return b"".join(data[a:b] for a, b in zip([0, *spans[1::2]], [*spans[::2], len(data)], strict=True))


def _kept_sha(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        shas = [hashlib.sha256(_kept_bytes(t.as_py().encode(), s.as_py())).hexdigest() for t, s in zip(batch.column(1), batch.column(2), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shas, pa.string())], names=["key", "kept_sha256"])


def repeats_report(docs: DataFrame, length: int = 400) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_kept`` of every row (bytes of the text, taken out, and left)."""
    scan, spans = repeated_spans(docs, length)
    rows = scan.select("doc_id", "key", "n_bytes", "sha").join(spans.drop("spans"), "key", "left")
    rows = rows.select("doc_id", "key", "n_bytes", "sha", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"))
    partly = rows.where("n_removed > 0 and n_removed < n_bytes").groupBy("key").agg(F.min("doc_id").alias("id"))
    texts = _keyed(docs).join(partly, "key").where("doc_id <=> id").join(spans.select("key", "spans"), "key")
    shas = texts.select("key", "text", "spans").mapInArrow(_kept_sha, "key binary, kept_sha256 string").dropDuplicates(["key"])
    kept = F.when(F.col("n_removed") == 0, F.col("sha")).when(F.col("n_removed") == F.col("n_bytes"), F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.col("kept_sha256"))
    return rows.join(shas, "key", "left").select("doc_id", "n_bytes", "n_removed", "n_spans", kept.alias("kept_sha256"), (F.col("n_bytes") - F.col("n_removed")).alias("n_kept"))


def remove_repeats(docs: DataFrame, length: int = 400) -> DataFrame:
    """The rows of ``docs``, all columns, with repeated bytes cut out of ``text``; a character cut in two is dropped whole.

    Rows without repeats, and null texts, are unchanged; a text that repeats whole becomes empty."""
    return _without(docs, repeated_spans(docs, length)[1], BYTES)


def remove_passages(docs: DataFrame, length: int = 50) -> DataFrame:
    """The rows of ``docs``, all columns, without the words under ``length`` words in a row that another text holds too.

    A passage goes from every text that holds it, with the white space before it, and rows of which nothing is left go. Words are the
    runs ``[^\\x20\\x09-\\x0D]+``; rows without such passages, and null or empty texts, are unchanged."""
    return _without(docs, repeated_spans(docs, length, WORDS)[1], WORDS)


_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def word_spans(data: bytes, spans: list[int]) -> list[int]:
    """Spans of words as spans of bytes, each from the end of the word before it; after the last word nothing is left."""
    ends = [0, *(m.end() for m in _WORD.finditer(data))]
    ends[-1] = len(data)
    return [ends[k] for k in spans]


def _without(docs: DataFrame, spans: DataFrame, alphabet: Alphabet) -> DataFrame:
    """``docs`` without the spans of their texts."""
    spans = spans.select(F.col("key").alias("_repeat_key"), F.col("spans").alias("_repeat_spans"))
    joined = docs.withColumn("_repeat_key", _key()).join(spans, "_repeat_key", "left").drop("_repeat_key")
    names = list(docs.columns)
    at = names.index("text")
    in_words = alphabet is WORDS

    def left(text: str, spans: list[int]) -> str:
        data = text.encode()
        return _kept_bytes(data, word_spans(data, spans) if in_words else spans).decode(errors="ignore")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = list(batch.columns)
            spans = cols.pop()
            cols[at] = pa.array([t.as_py() if s.as_py() is None else left(t.as_py(), s.as_py()) for t, s in zip(cols[at], spans, strict=True)], pa.string())
            out = pa.RecordBatch.from_arrays(cols, names=names)
            yield out.filter(pc.or_kleene(spans.is_null(), pc.fill_null(pc.not_equal(cols[at], ""), True))) if in_words else out

    return joined.mapInArrow(run, docs.schema)


def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes under 400-byte strings that occur more than once in the whole ``documents`` table."""
    return repeats_report(spark.read.parquet(f"{sf_dir}/documents.parquet"))
