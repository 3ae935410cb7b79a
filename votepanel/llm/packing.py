"""Sum-of-squares online packing of tokenised documents into sequences of a fixed length.

A document is its token ids and an end id. Whole sequences are cut off a long document as they fill; what is left of it is
placed online: of all fill levels h that hold an open window with room, and the empty window, it takes the one after which the sum
of the squared counts of open windows per level is smallest (highest level on ties). The counts are one array over the levels, so a
placement is one pass over that array. Sequences are not padded at the end of a task or when over ``MAX_OPEN``
windows are open: the emptiest windows are cut up to fill the fullest until one is left, and that one, at the end, is cut into
sequences of falling powers of two. So the packing loses no token and pads none; the sum-of-squares rule keeps the cuts few.

Distribution. A task packs its own rows from scan to sequences, without any shuffle; sequence ids start at the task's own range.
A lost task is redone from the same rows in the same order and gives the same sequences, so the input should be a table
read from files (write a shuffled one first). Memory: open windows (``MAX_OPEN`` times ``length`` ids) and one document's ids. Texts are
encoded in stretches of about CHUNK characters.

Encoding. Ids are those of the tokenizers library for the file. Where the file is a plain byte-level BPE, a stretch of text with
characters below U+0250 only (whose classes all Unicode versions share) is encoded from the same vocabulary by a faster byte-pair
library with equal ids; any other stretch, and any other file, goes through the tokenizers library. A stretch ends before a white space that
follows a non-space: no token of a byte-level tokenizer reaches across that place.

Defined results: null text is empty, and only the end id is packed; strings of special tokens in a text are ordinary text;
rows that repeat a doc_id, or have none, are documents of their own; equal documents are packed each; other columns are ignored; an
empty table gives no piece.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LENGTH, END, MAX_OPEN, CHUNK, TASK_BITS = 2048, 1, 4096, 65_536, 40
PIECE_SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
#: Fixed value: the pattern of the byte-level pre-tokenizer.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SAFE = re.compile(r"\S(?=[ \t\n\r\x0b\x0c])")
WIDE = re.compile("[^\x00-\u024f]")


def stretches(text: str, size: int = CHUNK) -> Iterator[str]:
    """The text in parts of ``size`` characters or a little more, cut where no token can reach across."""
    at = 0
    while at < len(text):
        cut = SAFE.search(text, at + size - 1) if len(text) - at > size else None
        end = cut.end() if cut else len(text)
        yield text[at:end]
        at = end


class TextEncoder:
    """Texts -> little-endian 32-bit ids of a tokenizers file."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        self.fast = self._byte_pairs(json.loads(self.library.to_str()))

    @staticmethod
    def _byte_pairs(parts: dict):
        """The same vocabulary as byte pairs in rank order, if the file is that and nothing more."""
        import tiktoken

        split, model = parts["pre_tokenizer"] or {}, parts["model"]
        plain = split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space") and not parts["normalizer"]
        plain = plain and model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        if not plain:
            return None
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        order = [model["vocab"][a + b] for a, b in pairs]
        special = {t["content"] for t in parts["added_tokens"]}
        byte_of = byte_letters()
        ranks = {bytes(byte_of[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
        if order != sorted(set(order)) or len(ranks) != 256 + len(order):
            return None
        return tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> bytes:
        """The ids of a whole text; a plain byte-level file encodes it in stretches, so only its ids are held."""
        return b"".join(map(self._stretch, stretches(text) if self.fast else [text]))

    def _stretch(self, text: str) -> bytes:
        if self.fast and not WIDE.search(text):
            return self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4").tobytes()
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def byte_letters() -> dict[str, int]:
    """The letter that byte-level tokenizer files write for each byte: itself where it is printable, else the next from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    other = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(other)}


class Levels:
    """The level array: how many open windows there are at each fill level, with the two ends set so that one difference gives the cost.

    Moving a window from level h to h + size changes the sum of squares by ``2 * (count[h + size] - count[h]) + 2``; an empty
    window costs ``2 * count[size] + 1`` and one that becomes full ``1 - 2 * count[h]``: as if their counts were 1/2 and -1/2."""

    def __init__(self, length: int) -> None:
        self.length = length
        self.count = np.zeros(length + 1)
        self.count[0], self.count[length] = 0.5, -0.5

    def change(self, level: int, by: int) -> None:
        if 0 < level < self.length:
            self.count[level] += by

    def best(self, size: int) -> int:
        before = self.count[: self.length - size + 1]
        cost = np.where(before > 0, self.count[size:] - before, np.inf)[::-1]
        return self.length - size - int(cost.argmin())


class Packer:
    """Windows of one task. A piece is ``[doc_id, start, length, ids, doc_tokens]``, a window ``[sequence_id, fill, pieces]``."""

    def __init__(self, first_id: int, length: int = LENGTH, max_open: int = MAX_OPEN) -> None:
        self.next_id, self.length, self.max_open = first_id, length, max_open
        self.levels, self.open, self.n_open = Levels(length), {}, 0
        self.done: list[list] = []

    def _window(self) -> list:
        self.next_id += 1
        return [self.next_id - 1, 0, []]

    def _put(self, window: list, piece: list) -> None:
        window[1] += piece[2]
        window[2].append(piece)

    def _shelve(self, window: list) -> None:
        if window[1] == self.length:
            self.done.append(window)
        else:
            self.levels.change(window[1], 1)
            self.open.setdefault(window[1], []).append(window)
            self.n_open += 1

    def add(self, doc_id: int | None, ids: bytes) -> None:
        total = len(ids) // 4
        whole = total - total % self.length
        for start in range(0, whole, self.length):
            window = self._window()
            self._put(window, [doc_id, start, self.length, ids[4 * start : 4 * (start + self.length)], total])
            self.done.append(window)
        if whole == total:
            return
        level = self.levels.best(total - whole)
        if level:
            window = self.open[level].pop()
            self.levels.change(level, -1)
            self.n_open -= 1
        else:
            window = self._window()
        self._put(window, [doc_id, whole, total - whole, ids[4 * whole :], total])
        self._shelve(window)
        if self.n_open > self.max_open:
            self.settle()

    def settle(self) -> None:
        """Fill the fullest open windows with what the emptiest hold, cutting pieces, until at most one is open."""
        windows = sorted((w for same in self.open.values() for w in same), key=lambda w: (-w[1], w[0]))
        self.levels, self.open, self.n_open = Levels(self.length), {}, 0
        low, high = 0, len(windows) - 1
        while low < high:
            target, donor = windows[low], windows[high]
            doc_id, start, n, ids, total = donor[2].pop()
            take = min(n, self.length - target[1])
            donor[1] -= n
            if take < n:
                self._put(donor, [doc_id, start, n - take, ids[: 4 * (n - take)], total])
            self._put(target, [doc_id, start + n - take, take, ids[4 * (n - take) :], total])
            if target[1] == self.length:
                self.done.append(target)
                low += 1
            if not donor[1]:
                high -= 1
        if low == high:
            self._shelve(windows[low])

    def finish(self) -> None:
        """Settle, and cut the window that is left into sequences of falling powers of two."""
        self.settle()
        left = [w for same in self.open.values() for w in same]
        self.open, self.n_open = {}, 0
        for window in left:
            pieces = window[2][::-1]
            while pieces:
                target = self._window()
                size = 1 << (sum(p[2] for p in pieces).bit_length() - 1)
                while target[1] < size:
                    doc_id, start, n, ids, total = pieces.pop()
                    take = min(n, size - target[1])
                    self._put(target, [doc_id, start, take, ids[: 4 * take], total])
                    if take < n:
                        pieces.append([doc_id, start + take, n - take, ids[4 * take :], total])
                self.done.append(target)

    def rows(self) -> pa.RecordBatch:
        """The pieces of the finished windows, which are then forgotten."""
        out: list[list] = [[] for _ in range(7)]
        for sequence, _, pieces in self.done:
            offset = 0
            for doc_id, start, n, ids, total in pieces:
                for col, v in zip(out, (doc_id, start, n, ids, total, sequence, offset), strict=True):
                    col.append(v)
                offset += n
        self.done = []
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds, strict=True)], names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])


_ENCODERS: dict[str, TextEncoder] = {}


def _pack(path: str, length: int, end: int, max_open: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _ENCODERS:
            _ENCODERS[path] = TextEncoder(path)
        encode = _ENCODERS[path]
        packer = Packer(TaskContext.get().partitionId() << TASK_BITS, length, max_open)
        tail = np.array([end], "<u4").tobytes()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                packer.add(doc_id, encode(text.as_py() or "") + tail)
                if len(packer.done) >= 1024:
                    yield packer.rows()
        packer.finish()
        yield packer.rows()

    return run


def pack_documents(docs: DataFrame, tokenizer: str, length: int = LENGTH, end: int = END, max_open: int = MAX_OPEN) -> DataFrame:
    """``doc_id, start, length, ids, doc_tokens, sequence_id, offset`` of every piece; ``ids``: little-endian 32-bit token ids.

    ``tokenizer``: file of the tokenizers library; ``end``: the id after every document; ``length`` is a power of two, or the last
    sequences of a task may be padded."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_pack(tokenizer, length, end, max_open), PIECE_SCHEMA)


def sequences(pieces: DataFrame) -> DataFrame:
    """``sequence_id, n_tokens, ids, doc_ids, lengths``: the sequences themselves, from their pieces in order (at most ``length`` a group)."""
    parts = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("offset", "ids", "doc_id", "length"))).alias("p"))
    ids = F.aggregate("p", F.lit(b""), lambda all_ids, x: F.concat(all_ids, x["ids"]))
    return parts.select("sequence_id", "n_tokens", ids.alias("ids"), F.col("p.doc_id").alias("doc_ids"), F.col("p.length").alias("lengths"))


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document of the whole ``documents`` table in sequences of at most 2048 tokens."""
    import public_tokenizers

    pieces = pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
