"""Byte-level BPE by a lazily determinised finite-state transducer, and streaming decode.

Encoding. The merges are known through the ranks file only. A sequence of tokens is the BPE result of its bytes exactly when every
adjacent pair of tokens is the BPE result of the pair's own bytes. This gives a nondeterministic transducer over bytes: its
state is (last token, bytes of the next token read so far); where those bytes are a token that may follow the last one, it
may emit it. Determinisation is done on demand, one transition per (state, byte) met: a deterministic state is the set of
hypotheses, and its transition names the one token that ends at this byte if the text up to here were all. A hypothesis
ends when no token starts with its open bytes, so its rivals are decided after a lookahead bounded by the longest token: as soon
as one hypothesis is left, or the piece ends, the tokens before its open bytes are certain and emitted.

Decoding. A state machine over tokens holds the unfinished UTF-8 sequence (at most three bytes) as its state; its transitions
are built when first met from a per-byte UTF-8 machine. Malformed bytes, which whole-text encodings never produce, become
U+FFFD, one for each rejected sequence.

Defined results: null text is encoded as the empty text; special-token strings inside texts are ordinary text; repeated rows and
null ids pass through; columns beside ``doc_id`` and ``text`` are ignored. Letters and digits are those of the installed ``regex``
library (a code point assigned by a Unicode version younger than another library's tables may be split differently there). Tables of states are forgotten at a size limit and rebuilt.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Callable, Iterator
from itertools import chain

import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Limits of what a worker remembers: deterministic states, and pieces with their tokens.
MAX_STATES, MAX_PIECES = 300_000, 400_000


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


class Merger:
    """The definition: repeatedly join the adjacent pair whose joined bytes have the lowest rank, leftmost first."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks

    def __call__(self, piece: bytes) -> list[bytes]:
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            joined = [self.ranks.get(a + b) for a, b in zip(parts, parts[1:], strict=False)]
            best = min((r for r in joined if r is not None), default=None)
            if best is None:
                break
            k = joined.index(best)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts


class Transducer:
    """Lazily determinised transducer of a rank table: pieces of bytes to token ids.

    A hypothesis is one number, (last token + 1, or 0) * 2^24 + trie node of the open bytes; a state is the bytes of an array of them.
    Transitions are kept by state * 2^8 + byte; one is a number, next state * 2^32 + token that ends here + 1 (0: none), and tokens
    stay below 2^24, so shifted right by 24 bits it is the next state * 2^8."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.merge = Merger(ranks)
        self.bytes_of = {i: t for t, i in ranks.items()}
        if max(ranks.values(), default=0) >= 0xFFFFFF:
            raise ValueError("ranks below 2^24 - 1 are expected")
        self.length_of = {i + 1: (i, len(t)) for t, i in ranks.items()}  # with the one object of each id, so that remembered ids share it
        self.child: dict[int, int] = {}
        self.token_at = [-1]
        for token, i in ranks.items():
            node = 0
            for byte in token:
                key = node << 8 | byte
                node = self.child.get(key, -1)
                if node < 0:
                    node = self.child[key] = len(self.token_at)
                    self.token_at.append(-1)
            self.token_at[node] = i
        self.edges: dict[int, tuple[tuple, tuple] | None] = {}
        self.follows: dict[int, bool] = {}
        self.reset()

    def reset(self) -> None:
        self.steps = Steps(self)
        self.hypotheses: list[bytes] = []
        self.numbers: dict[bytes, int] = {}
        self.start = self.number(array("q", (0,)).tobytes())

    def number(self, state: bytes) -> int:
        n = self.numbers.get(state)
        if n is None:
            n = self.numbers[state] = len(self.hypotheses)
            self.hypotheses.append(state)
        return n

    def parts(self, i: int) -> tuple[tuple, tuple] | None:
        """The parts of a token that touch its right and its left edge while it is merged, outermost first, each with the rank
        of the merge that makes it and of the merge that uses it up. None: merging its bytes gives another result, or not in rank order."""
        if i in self.edges:
            return self.edges[i]
        ends: list[list] = [[], []]
        for side in (0, 1):
            part, used = self.bytes_of[i], float("inf")
            while True:
                made = self.ranks[part] if len(part) > 1 else -1
                if made >= used:
                    self.edges[i] = None
                    return None
                ends[side].append((part, made, used))
                if len(part) == 1:
                    break
                halves = self.last_merge(part)
                if halves is None:
                    self.edges[i] = None
                    return None
                part, used = halves[1 - side], made
        out = self.edges[i] = (tuple(ends[0]), tuple(ends[1]))
        return out

    def last_merge(self, token: bytes) -> tuple[bytes, bytes] | None:
        """The two parts whose merge makes the token, if its bytes merge into it."""
        parts = [token[k : k + 1] for k in range(len(token))]
        while len(parts) > 2:
            joined = [self.ranks.get(a + b) for a, b in zip(parts, parts[1:], strict=False)]
            best = min((r for r in joined if r is not None), default=None)
            if best is None:
                return None
            k = joined.index(best)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return (parts[0], parts[1])

    def may_follow(self, last: int, token: int) -> bool:
        """Whether the bytes of both tokens together merge into just these two."""
        key = last << 32 | token
        known = self.follows.get(key) if last >= 0 else None
        if known is not None:
            return known
        after = self.parts(token)
        if last < 0:
            return after is not None
        before = self.parts(last)
        if before is None or after is None:
            return False
        known, ranks = True, self.ranks
        # of the parts on both sides of the border that exist at the same time, none may be merged across it before it is used up
        for a, made_a, used_a in before[0]:
            for b, made_b, used_b in after[1]:
                if made_a < used_b and made_b < used_a:
                    r = ranks.get(a + b)
                    if r is not None and r < used_a and r <= used_b:
                        known = False
        if len(self.follows) >= 2 * MAX_STATES:
            self.follows.clear()
        self.follows[key] = known
        return known

    def step(self, n: int, byte: int) -> int:
        """Build one transition of the determinised transducer: the next state, and the token that ends here or -1."""
        found, ended = array("q"), -1
        child, token_at, follows = self.child, self.token_at, self.follows
        for hypothesis in array("q", self.hypotheses[n]):  # the oldest open bytes first
            node = child.get((hypothesis & 0xFFFFFF) << 8 | byte)
            if node is not None:
                last = hypothesis >> 24
                found.append(last << 24 | node)
                token = token_at[node]
                if token >= 0 and ended < 0:
                    known = follows.get(last - 1 << 32 | token) if last else None
                    if self.may_follow(last - 1, token) if known is None else known:
                        ended = token
        if ended >= 0:
            found.append((ended + 1) << 24)
        state = found.tobytes()
        number = self.numbers.get(state)
        out = self.steps[n << 8 | byte] = (self.number(state) if number is None else number) << 32 | ended + 1
        return out

    def __call__(self, piece: bytes) -> tuple[int, ...]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return (whole,)
        if len(self.hypotheses) > MAX_STATES:
            self.reset()
        n, ends, steps = self.start << 8, [], self.steps
        if len(piece) < 512:
            for byte in piece:
                got = steps[n | byte]
                n = got >> 24
                ends.append(got)
            return tuple(self.emitted(ends))
        out: list[int] = []
        for byte in piece:
            got = steps[n | byte]
            n = got >> 24
            ends.append(got)
            if len(ends) >= 512 and got & 0xFFFFFF and len(self.hypotheses[n >> 8]) == 8:  # one hypothesis left: all before it is certain
                out += self.emitted(ends)
                ends.clear()
        return (*out, *self.emitted(ends))

    def emitted(self, ends: list[int]) -> list[int]:
        """The certain tokens, read back from the transition of the last byte by their lengths."""
        out, at, length_of = [], len(ends), self.length_of
        while at:
            token, length = length_of[ends[at - 1] & 0xFFFFFF]
            out.append(token)
            at -= length
        out.reverse()
        return out


class Steps(dict):
    """The transitions met so far, by state * 2^8 + byte; others are built."""

    def __init__(self, transducer: Transducer) -> None:
        super().__init__()
        self.transducer = transducer

    def __missing__(self, key: int) -> int:
        return self.transducer.step(key >> 8, key & 0xFF)


class Remembered(dict):
    """Text -> token ids by the given function; short texts are remembered, up to a limit."""

    def __init__(self, encode: Callable[[str], tuple[int, ...]], limit: int) -> None:
        super().__init__()
        self.encode, self.limit = encode, limit

    def __missing__(self, text: str) -> tuple[int, ...]:
        ids = self.encode(text)
        if len(text) <= 32:
            if len(self) >= self.limit:
                self.clear()
            self[text] = ids
        return ids


#: Code point length by lead byte ranges, with the range of the second byte (fixed values of UTF-8).
_LEADS = ((0xC2, 0xDF, 1, 0x80, 0xBF), (0xE0, 0xE0, 2, 0xA0, 0xBF), (0xE1, 0xEC, 2, 0x80, 0xBF), (0xED, 0xED, 2, 0x80, 0x9F), (0xEE, 0xEF, 2, 0x80, 0xBF), (0xF0, 0xF0, 3, 0x90, 0xBF), (0xF1, 0xF3, 3, 0x80, 0xBF), (0xF4, 0xF4, 3, 0x80, 0x8F))


class OpenSequence(dict):
    """A state of the decoder, the unfinished UTF-8 sequence: token id -> (next state, text), built when first met."""

    def __init__(self, decoder: StreamDecoder, unfinished: bytes) -> None:
        super().__init__()
        self.decoder, self.unfinished = decoder, unfinished

    def __missing__(self, token: int) -> tuple[OpenSequence, str]:
        state, text = self.decoder.feed(self.unfinished, self.decoder.tokens[token])
        got = self[token] = (self.decoder.state(state), text)
        if not (self.unfinished or state):
            self.decoder.closed[token] = text
        return got


class StreamDecoder:
    """Token ids to text, one token at a time; the state is the open UTF-8 sequence. Transitions from no open sequence to none are kept in
    a table of their own, so that a run of them is one join."""

    def __init__(self, tokens: dict[int, bytes]) -> None:
        self.tokens = tokens
        self.leads = {b: (n, lo, hi) for first, last, n, lo, hi in _LEADS for b in range(first, last + 1)}
        self.states: dict[bytes, OpenSequence] = {}
        self.closed: dict[int, str] = {}

    def state(self, unfinished: bytes) -> OpenSequence:
        if unfinished not in self.states:
            self.states[unfinished] = OpenSequence(self, unfinished)
        return self.states[unfinished]

    def feed(self, state: bytes, data: bytes) -> tuple[bytes, str]:
        """The per-byte machine: open sequence and bytes -> open sequence and text."""
        out = []
        for b in data:
            if state:
                more, lo, hi = self.leads[state[0]]
                if (lo if len(state) == 1 else 0x80) <= b <= (hi if len(state) == 1 else 0xBF):
                    state += bytes((b,))
                    if len(state) == more + 1:
                        code = state[0] & (0x3F >> more)
                        for c in state[1:]:
                            code = code << 6 | c & 0x3F
                        out.append(chr(code))
                        state = b""
                    continue
                out.append("�")
                state = b""
            if b < 0x80:
                out.append(chr(b))
            elif b in self.leads:
                state = bytes((b,))
            else:
                out.append("�")
        return state, "".join(out)

    def __call__(self, ids: list[int]) -> str:
        if sum(map(len, self.states.values())) >= MAX_STATES:
            self.states.clear()
        try:
            return "".join(map(self.closed.__getitem__, ids))
        except KeyError:
            pass
        out = [*map(self.closed.get, ids)]
        state = start = self.state(b"")
        at, last = 0, len(ids)
        while at < last:
            if state is start:  # on to the next token that opens a sequence, or was not met yet
                try:
                    at = out.index(None, at)
                except ValueError:
                    break
            state, out[at] = state[ids[at]]
            at += 1
        return "".join(out) + ("�" if state.unfinished else "")


def codec(path: str, pattern: str) -> tuple[Callable[[str], list[int]], StreamDecoder]:
    """``encode(text) -> ids`` and the streaming decoder of a ranks file.

    ``pattern`` cuts a text into pieces. Where it is the public GPT-style pattern, whose pieces never run on from a visible character
    into a space, a text whose spaces all follow visible characters may be cut at its spaces first: the parts are pieced
    on their own, with their leading space, and remembered."""
    ranks = load_ranks(path)
    transduce, split = Transducer(ranks), regex.compile(pattern).findall
    pieces = Remembered(lambda piece: transduce(piece.encode()), MAX_PIECES)

    def whole(text: str) -> tuple[int, ...]:
        return tuple(chain.from_iterable(map(pieces.__getitem__, split(text))))

    def spaced(part: str) -> tuple[int, ...]:
        """Of a part and the space before it; ASCII letters are one piece."""
        return pieces[" " + part] if part.isascii() and part.isalpha() else whole(" " + part)

    parts = Remembered(spaced, MAX_PIECES)
    space_after_space = regex.compile(r"\s ").search
    by_parts = r" ?\p{L}+" in pattern and r"\s+(?!\S)|\s+" in pattern

    def encode(text: str) -> list[int]:
        if not by_parts or space_after_space(text):
            return list(whole(text))
        first, *rest = text.split(" ")
        return [*whole(first), *chain.from_iterable(map(parts.__getitem__, rest))]

    return encode, StreamDecoder({v: k for k, v in ranks.items()})


_CODECS: dict[tuple[str, str], tuple] = {}


def _run(name: str, pattern: str, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = SparkFiles.get(name)
        if (path, pattern) not in _CODECS:
            _CODECS[path, pattern] = codec(path, pattern)
        encode, decode = _CODECS[path, pattern]
        decimal = {i: str(i) for i in decode.tokens}
        for whole in batches:
            for k in range(0, whole.num_rows, 256):
                batch = whole.slice(k, 256)
                rows: list[list] = [[], [], [], []]
                kept = []
                for text in batch.column(1):
                    ids = encode(text.as_py() or "")
                    rows[0].append(len(ids))
                    rows[1].append(hashlib.sha256(",".join(map(decimal.__getitem__, ids)).encode()).hexdigest())
                    rows[2].append(hashlib.sha256(decode(ids).encode()).hexdigest())
                    if keep_ids:
                        kept.append(pa.array(ids, pa.int32()))
                cols = [batch.column(0), pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.string()), pa.array(rows[2], pa.string())]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if keep_ids:
                    offsets = pa.array([0, *pa.compute.cumulative_sum(pa.array(rows[0])).to_pylist()], pa.int32())
                    cols.append(pa.ListArray.from_arrays(offsets, pa.concat_arrays(kept)))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return run


def encode_documents(docs: DataFrame, vocabulary: str, pattern: str, keep_ids: bool = False) -> DataFrame:
    """Encode and decode whole texts. ``vocabulary`` is a ranks file on the driver; Spark ships it to the executors.

    Returns ``doc_id, n_tokens, ids_sha256, decoded_sha256`` and, if asked for, ``ids array<int>``."""
    import os

    spark = docs.sparkSession
    name = os.path.basename(vocabulary)
    if not any(f.endswith("/" + name) for f in spark.sparkContext.listFiles):
        spark.sparkContext.addFile(vocabulary)
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_run(name, pattern, keep_ids), schema)


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of the whole ``documents`` table in the public multilingual 50k vocabulary."""
    import public_tokenizers

    return encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
