"""Chat formatting with offset-aligned loss masks.

A conversation is rendered as a whole, encoded once with offsets, and the sorted spans of its assistant texts are
intersected with the sorted token spans by binary search.

Template: a turn is `<|turn|>` role `<|text|>` text `<|end|>`. The three control strings are tokens of their own, so that
no token spans the border of a text. Inside roles and texts a backslash is doubled and a control string gets a backslash
after its "<"; so control strings never occur inside texts, and reading back is exact.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import AddedToken, Tokenizer, processors

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
LOSS_ROLE = "assistant"
_ESCAPE = re.compile(r"\\|<(?=\|(?:turn|text|end)\|>)")
_UNESCAPE = re.compile(r"\\\\|<\\(?=\|(?:turn|text|end)\|>)")
_READ = re.compile(r"<\|turn\|>(.*?)<\|text\|>(.*?)<\|end\|>", re.S)
#: Conversations that a worker makes at a time.
ROWS = 64
WORKER: dict[str, Tokenizer] = {}


def escape(s: str) -> str:
    return _ESCAPE.sub(lambda m: "\\\\" if m[0] == "\\" else "<\\", s)


def unescape(s: str) -> str:
    return _UNESCAPE.sub(lambda m: "\\" if m[0] == "\\\\" else "<", s)


def render(turns: list[tuple[str, str]], loss_role: str = LOSS_ROLE) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation of (role, text), and the spans (code points) of the texts that carry the loss."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{TURN}{escape(role)}{TEXT}", escape(text)
        parts += [head, body, END]
        if role == loss_role:
            spans.append((at + len(head), at + len(head) + len(body)))
        at += len(head) + len(body) + len(END)
    return "".join(parts), spans


def read_back(formatted: str) -> list[tuple[str, str]]:
    return [(unescape(a), unescape(b)) for a, b in _READ.findall(formatted)]


def tokenizer(json_text: str) -> Tokenizer:
    """The tokenizer with the control strings as tokens; offsets keep leading spaces."""
    out = Tokenizer.from_str(json_text)
    out.encode_special_tokens = False
    out.add_special_tokens([AddedToken(s, special=True, normalized=False) for s in (TURN, TEXT, END)])
    out.post_processor = processors.ByteLevel(trim_offsets=False)
    out.no_padding()
    out.no_truncation()
    return out


def masked(starts: np.ndarray, ends: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """For each token span (sorted) whether it lies in a span of the loss, by binary search in the sorted spans."""
    if not spans:
        return np.zeros(len(starts), bool)
    s = np.array(spans)
    k = np.searchsorted(s[:, 0], starts, side="right") - 1
    near = s[np.maximum(k, 0)]
    return (k >= 0) & (starts < near[:, 1]) & (ends <= near[:, 1]) & (starts < ends)


def format_conversations(spark: SparkSession, rows: DataFrame, tokenizer_path: str, loss_role: str = LOSS_ROLE) -> DataFrame:
    """rows (conv_id, turn, role, text) to one row a conversation: conv_id, formatted, ids, starts, ends, mask.

    Turns are taken by turn, then role and text where turns tie; a null turn comes first. Repeated rows are turns each.
    Null roles and texts count as empty. Extra columns are ignored; an empty table gives an empty result. A
    conversation is the unit that a model reads, so its turns are gathered in one row, however many conversations share
    a first turn; nothing else is gathered.
    """
    turns, made = _made(spark, rows, tokenizer_path, loss_role)
    schema = T.StructType([turns.schema["conv_id"], *T._parse_datatype_string("formatted string, ids array<int>, starts array<int>, ends array<int>, mask array<boolean>").fields])

    def run(batches):
        ints = pa.list_(pa.int32())
        for ids, found in made(batches):
            yield pa.RecordBatch.from_arrays(
                [
                    ids,
                    pa.array([f for f, _, _, _ in found], pa.string()),
                    pa.array([i for _, i, _, _ in found], ints),
                    pa.array([s[:, 0] for _, _, s, _ in found], ints),
                    pa.array([s[:, 1] for _, _, s, _ in found], ints),
                    pa.array([m for _, _, _, m in found], pa.list_(pa.bool_())),
                ],
                names=schema.names,
            )

    return turns.mapInArrow(run, schema)


def _made(spark: SparkSession, rows: DataFrame, tokenizer_path: str, loss_role: str):
    """The turns of each conversation in one row (conv_id, turns), and what makes of batches of them conv_id and, for each
    conversation, (formatted, ids, spans, mask)."""
    shared = spark.sparkContext.broadcast(open(tokenizer_path, encoding="utf-8").read())
    key = hashlib.sha256(shared.value.encode()).hexdigest()
    none = lambda c: F.coalesce(F.col(c), F.lit(""))
    turns = rows.select("conv_id", F.struct("turn", none("role").alias("role"), none("text").alias("text")).alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))

    def made(batches):
        if key not in WORKER:
            WORKER[key] = tokenizer(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                rendered = [render([(t["role"], t["text"]) for t in x], loss_role) for x in part.column(1).to_pylist()]
                found = []
                for text, spans in rendered:
                    e = WORKER[key].encode(text, add_special_tokens=False)
                    at_ = np.array(e.offsets, np.int32).reshape(-1, 2)
                    found.append((text, e.ids, at_, masked(at_[:, 0], at_[:, 1], spans)))
                yield part.column(0), found

    return turns, made


def loss_texts(formatted: str, starts: np.ndarray, ends: np.ndarray, mask: np.ndarray) -> list[str]:
    """The texts under the mask, unescaped: runs of masked tokens, each from its first start to its last end."""
    starts, ends, edges = np.asarray(starts), np.asarray(ends), np.flatnonzero(np.diff(np.concatenate([[0], np.asarray(mask, np.int8), [0]])))
    return [unescape(formatted[starts[a] : int(ends[a:b].max())]) for a, b in edges.reshape(-1, 2)]


DIGESTS = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _digest(formatted: str, starts: np.ndarray, ends: np.ndarray, mask: np.ndarray) -> tuple:
    """DIGESTS of one conversation, read back from what was made of it alone."""
    turns = read_back(formatted)
    loss = "".join(loss_texts(formatted, starts, ends, mask))
    whole = "".join(f"{r}\n{t}\n" for r, t in turns)
    return len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(formatted)


def _digests(ids: pa.Array, found: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays([ids, *[pa.array([x[k] for x in found], kinds[k]) for k in range(5)]], names=["conv_id", *[d.split()[0] for d in DIGESTS.split(", ")]])


def read_conversations(made: DataFrame) -> DataFrame:
    """What can be read back from format_conversations(): n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    schema = T.StructType([made.schema["conv_id"], *T._parse_datatype_string(DIGESTS).fields])

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                columns = part.select(["formatted", "starts", "ends", "mask"]).to_pylist()
                yield _digests(part.column(0), [_digest(**row) for row in columns])

    return made.select("conv_id", "formatted", "starts", "ends", "mask").mapInArrow(run, schema)


def checked_conversations(spark: SparkSession, rows: DataFrame, tokenizer_path: str, loss_role: str = LOSS_ROLE) -> DataFrame:
    """read_conversations() of format_conversations(), in one pass: what was made of a conversation is read back in the same
    task, and only the digests leave it."""
    turns, made = _made(spark, rows, tokenizer_path, loss_role)
    schema = T.StructType([turns.schema["conv_id"], *T._parse_datatype_string(DIGESTS).fields])

    def run(batches):
        for ids, found in made(batches):
            yield _digests(ids, [_digest(f, s[:, 0], s[:, 1], m) for f, _, s, m in found])

    return turns.mapInArrow(run, schema)


#: A conversation that shows the escaping; the registered query adds it to the table.
PROBE_ID, PROBE_TEXT = -7, r"\### Assistant: </turn> ok"
SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *, length(regexp_replace(replace(role, '\', '\\'), '<(\|(turn|text|end)\|>)', '<\\\1', 'g')) + length(regexp_replace(replace(text, '\', '\\'), '<(\|(turn|text|end)\|>)', '<\\\1', 'g')) + 23 AS n FROM c)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(n) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
