"""Chat formatting with offset-aligned loss masks.

A conversation is rendered whole: ``<|start|>role<|text|>text<|end|>`` per turn. Control strings (these, and those of common other
templates) inside roles and texts are escaped with a backslash, literal backslashes are doubled, so the rendering is
reversible. It is encoded once, with the markers as special tokens, so no token crosses a turn's edge; running sums of token
lengths are the tokens' byte offsets. The turn spans to train on (assistant texts) are sorted, and a binary search over the token
starts gives the tokens under the mask. The report is read back from the output: turns from the rendered string, loss text
from the masked tokens.

Defined results: null text and null role are empty strings; turns are ordered by turn, then role, then text (nulls first); rows that repeat a
turn are turns of their own; rows without conv_id are one conversation; an empty table gives only what the query adds;
columns beside ``conv_id, turn, role, text`` are ignored. A conversation is one row of the output, and so has to fit a task.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from votepanel.llm.bpe import load_ranks

START, TEXT, END = "<|start|>", "<|text|>", "<|end|>"
#: Control strings that must not appear in turns (fixed values of common templates).
CONTROLS = ("<|", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_CONTROL = re.compile("|".join(map(re.escape, ("\\", *CONTROLS))))
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_TURN = re.compile(re.escape(START) + "(.*?)" + re.escape(TEXT) + "(.*?)" + re.escape(END), re.DOTALL)


def escape(text: str) -> str:
    """A backslash goes into every control string after its first character; literal backslashes are doubled."""
    return _CONTROL.sub(lambda m: "\\\\" if m[0] == "\\" else m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The conversation as one string, and the byte spans of the assistant texts in it, in order."""
    out, spans, at = [], [], 0
    for role, text in turns:
        head, body = START + escape(role) + TEXT, escape(text)
        begin = at + len(head.encode())
        end = begin + len(body.encode())
        if role == "assistant":
            spans.append((begin, end))
        out += [head, body, END]
        at = end + len(END)
    return "".join(out), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    return [(unescape(role), unescape(text)) for role, text in _TURN.findall(formatted)]


class Encoder:
    """Token ids and byte lengths of rendered conversations, in a ranks file's vocabulary plus the markers."""

    def __init__(self, path: str, pattern: str) -> None:
        import tiktoken

        ranks = load_ranks(path)
        first = max(ranks.values()) + 1
        self.encoding = tiktoken.Encoding("chat", pat_str=pattern, mergeable_ranks=ranks, special_tokens={t: first + i for i, t in enumerate((START, TEXT, END))})
        self.length = np.zeros(first + 3, np.int64)
        for token, i in ranks.items():
            self.length[i] = len(token)
        for i, t in enumerate((START, TEXT, END)):
            self.length[first + i] = len(t)

    def __call__(self, formatted: str) -> tuple[np.ndarray, np.ndarray]:
        """Token ids, and the byte offset at which each begins (one more at the end)."""
        ids = np.array(self.encoding.encode(formatted, allowed_special="all"), np.int64)
        return ids, np.concatenate([[0], np.cumsum(self.length[ids])])


def loss_mask(offsets: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """True for the tokens that begin and end inside one of the sorted spans."""
    mask = np.zeros(len(offsets) - 1, bool)
    if spans:
        begin, end = np.array(spans).T
        first, last = np.searchsorted(offsets[:-1], begin, "left"), np.searchsorted(offsets[1:], end, "right")
        for a, b in zip(first.tolist(), last.tolist(), strict=True):
            mask[a:b] = True
    return mask


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def _format(name: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (SparkFiles.get(name), pattern)
        if key not in _ENCODERS:
            _ENCODERS[key] = Encoder(*key)
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for turns in batch.column(1).to_pylist():
                formatted, spans = render([(t["role"], t["text"]) for t in turns])
                ids, offsets = _ENCODERS[key](formatted)
                for col, v in zip(out, (formatted, ids, offsets[:-1], loss_mask(offsets, spans)), strict=True):
                    col.append(v)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, t) for x, t in zip(out, (pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.bool_())), strict=True))], names=["conv_id", "formatted", "ids", "offsets", "loss_mask"])

    return run


def format_conversations(rows: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """``conv_id, formatted, ids, offsets (bytes), loss_mask`` of every conversation."""
    import os

    name = os.path.basename(vocabulary)
    context = rows.sparkSession.sparkContext
    if not any(f.endswith("/" + name) for f in context.listFiles):
        context.addFile(vocabulary)
    turns = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).alias("t"))
    whole = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns")).select("conv_id", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))
    return whole.mapInArrow(_format(name, pattern), "conv_id long, formatted string, ids array<int>, offsets array<int>, loss_mask array<boolean>")


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[list] = [[] for _ in range(5)]
        for formatted, offsets, mask in zip(*(batch.column(c) for c in (1, 2, 3)), strict=True):
            formatted, data = formatted.as_py(), formatted.as_py().encode()
            turns = parse(formatted)
            begin = np.append(offsets.values.to_numpy(), len(data))
            on = mask.values.to_numpy(zero_copy_only=False)
            # a masked stretch is unescaped whole; stretches of several turns are apart
            edge = np.flatnonzero(np.diff(np.concatenate([[0], on.view(np.int8), [0]])))
            loss = "".join(unescape(data[begin[a] : begin[b]].decode()) for a, b in edge.reshape(-1, 2))
            row = (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(formatted))
            for col, v in zip(out, row, strict=True):
                col.append(v)
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, t) for x, t in zip(out, kinds, strict=True))], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


def chat_report(formatted: DataFrame) -> DataFrame:
    """Digests of turns and of the text under the loss mask, read back from :func:`format_conversations`."""
    return formatted.select("conv_id", "formatted", "offsets", "loss_mask").mapInArrow(_read_back, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one (-7) whose turns are control strings."""
    import public_tokenizers

    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    odd = spark.createDataFrame([(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")], "conv_id long, turn long, role string, text string")
    return chat_report(format_conversations(rows.unionByName(odd), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN))


_ESC = "replace(replace(replace(replace(replace(replace(replace(replace({x}, '\\', '\\\\'), '<|', '<\\|'), '</s>', '<\\/s>'), '<s>', '<\\s>'), '[INST]', '[\\INST]'), '[/INST]', '[\\/INST]'), '<<SYS>>', '<\\<SYS>>'), '<</SYS>>', '<\\</SYS>>')"
ORACLE = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
  coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS loss,
  sum({len(START + TEXT + END)} + length({_ESC.format(x="role")}) + length({_ESC.format(x="text")})) AS formatted_chars FROM c GROUP BY conv_id)
SELECT conv_id, n_turns::BIGINT AS n_turns, sha256(turns) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars::BIGINT AS formatted_chars FROM g
"""
