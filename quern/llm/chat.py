"""Chat formatting: a finite-state machine over roles, a declarative template, and per-segment loss flags.

A template says how a turn opens and closes and which roles bear loss. Control strings inside texts are escaped
by a mark after their first character, and the mark itself by doubling, so that what was formatted can be read
back exactly. Turns come as a stream in order, and one conversation's turns are never held together: the
machine keeps a state, and digests are kept up turn by turn.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import _base

#: Control strings of common chat formats, escaped beside the template's own.
FOREIGN = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|endoftext|>", "<|startoftext|>", "<|user|>", "<|assistant|>", "<|system|>")


@dataclass(frozen=True)
class Template:
    """How turns are written, which roles may follow which, and which bear loss."""

    open: str = "<|turn|>"
    after_role: str = "\n"
    close: str = "<|end|>"
    after_turn: str = "\n"
    mark: str = "␛"
    loss_roles: frozenset[str] = frozenset({"assistant"})
    controls: tuple[str, ...] = FOREIGN
    #: The machine: role -> next state, by state. A role that isn't there is out of order.
    moves: dict[str, dict[str, str]] = field(
        default_factory=lambda: {"start": {"system": "system", "user": "user"}, "system": {"user": "user"}, "user": {"assistant": "assistant"}, "assistant": {"user": "user"}}
    )
    accepting: frozenset[str] = frozenset({"user", "assistant"})


class Formatter:
    """Writes and reads turns of a template."""

    def __init__(self, template: Template = Template()):
        self.template = t = template
        controls = sorted({t.open, t.close, *t.controls} - {""}, key=lambda c: (-len(c), c))
        self._starts = re.compile(f"(?=(?:{'|'.join(map(re.escape, controls))}))(.)", re.S)
        self._plain = re.compile(f"{t.mark}({t.mark})?")
        self._role = re.compile(f"{t.mark}({t.mark}|n)?")
        self._turn = re.compile(f"{re.escape(t.open)}(.*?){re.escape(t.after_role)}(.*?){re.escape(t.close)}{re.escape(t.after_turn)}", re.S)

    def escape(self, text: str) -> str:
        if self.template.mark in text:
            text = text.replace(self.template.mark, self.template.mark * 2)
        return self._starts.sub(rf"\1{self.template.mark}", text)

    def unescape(self, text: str) -> str:
        return self._plain.sub(lambda m: m.group(1) or "", text) if self.template.mark in text else text

    def segments(self, role: str, text: str) -> list[tuple[str, bool]]:
        """(text, loss) of a turn's segments: its opening, its text and its close."""
        t = self.template
        name = self.escape(role).replace("\n", f"{t.mark}n")
        return [(f"{t.open}{name}{t.after_role}", False), (self.escape(text), role in t.loss_roles), (f"{t.close}{t.after_turn}", False)]

    def read(self, segments: list[tuple[str, bool]]) -> Iterator[tuple[str, str, str]]:
        """(role, text, text under the loss mask) of each turn written in ``segments``."""
        whole = "".join(s for s, _ in segments)
        masked, at = [], 0
        for s, loss in segments:
            if loss:
                masked.append((at, at + len(s)))
            at += len(s)
        place = 0
        for m in self._turn.finditer(whole):
            if m.start() != place:
                raise ValueError("text between turns")
            place = m.end()
            role = self._role.sub(lambda x: {"n": "\n", None: ""}.get(x.group(1), x.group(1)), m.group(1))
            under = "".join(whole[max(a, m.start()) : min(b, m.end())] for a, b in masked if a < m.end() and b > m.start())
            yield role, self.unescape(m.group(2)), self.unescape(under)
        if place != len(whole):
            raise ValueError("text after the last turn")


_SEGMENT = pa.list_(pa.struct([("text", pa.string()), ("loss", pa.bool_())]))
_TURNS = "conv_id long, turn long, role string, segments array<struct<text:string,loss:boolean>>, state string, valid boolean"


def format_turns(conversations: DataFrame, template: Template = Template()) -> DataFrame:
    """One row for each turn: its segments with loss flags, the machine's state after it, and whether all is in order so far.

    Turns are ordered by turn, role and text (null first); null texts and roles count as empty. A turn out of
    order is formatted like any other, with ``valid`` false from there on. Rows of one conversation stay together
    and in order within their partition. Repeated rows are turns of their own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = Formatter(template)
        current, state, valid = object(), "start", True
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            for conv, turn, role, text in zip(*[batch.column(i).to_pylist() for i in range(4)], strict=True):
                if conv != current:
                    current, state, valid = conv, "start", True
                to = template.moves.get(state, {}).get(role)
                valid, state = valid and to is not None, to or state
                row = conv, turn, role, [{"text": s, "loss": loss} for s, loss in f.segments(role, text)], state, valid
                for column, x in zip(out, row, strict=True):
                    column.append(x)
            kinds = [pa.int64(), pa.int64(), pa.string(), _SEGMENT, pa.string(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], ["conv_id", "turn", "role", "segments", "state", "valid"])

    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")])
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(run, _TURNS)


def read_back(turns: DataFrame, template: Template = Template()) -> DataFrame:
    """One row for each conversation of ``format_turns``, from its formatted text and loss mask alone.

    conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, valid (in order, and in an accepting state).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = Formatter(template)
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]
        key: object = _base
        now: list = []
        done: list[list] = []

        def close() -> None:
            if key is not _base:
                n, all_, loss_n, loss, chars, valid = now
                done.append([key, n, all_.hexdigest(), loss_n, loss.hexdigest(), chars, valid])

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)], names)
            done.clear()
            return batch

        for batch in batches:
            rows = zip(*[batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("conv_id", "segments", "state", "valid")], strict=True)
            for conv, part in groupby(rows, key=lambda r: r[0]):
                if conv != key:
                    close()
                    key, now = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, True]
                for _, segments, state, valid in part:
                    pieces = [(s["text"], s["loss"]) for s in segments]
                    for role, text, under in f.read(pieces):
                        now[0] += 1
                        now[1].update(f"{role}\n{text}\n".encode())
                        now[2] += len(under)
                        now[3].update(under.encode())
                    now[4] += sum(len(s) for s, _ in pieces)
                    now[5] = valid and state in template.accepting
            if done:
                yield out()
        close()
        if done:
            yield out()

    return turns.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean")


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    conversations = _base.read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return read_back(format_turns(conversations))


#: Mark and controls as in ``Template``, as patterns of the oracle.
_CONTROLS = r"<\|turn\|>|<\|end\|>|<s>|</s>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>|<\|endoftext\|>|<\|startoftext\|>|<\|user\|>|<\|assistant\|>|<\|system\|>"
ORACLE_SQL = f"""
WITH c AS (
    SELECT CAST(conv_id AS BIGINT) AS conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
),
t AS (
    SELECT *, len(regexp_extract_all(text, '{_CONTROLS}')) + len(text) - len(replace(text, '␛', '')) + len(regexp_extract_all(role, '{_CONTROLS}')) AS marks,
        CASE role WHEN 'system' THEN 's' WHEN 'user' THEN 'u' WHEN 'assistant' THEN 'a' ELSE 'x' END AS letter
    FROM c
)
SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    CAST(coalesce(sum(len(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
    CAST(sum(len(role) + len(text) + marks + {len("<|turn|>") + 1 + len("<|end|>") + 1}) AS BIGINT) AS formatted_chars,
    regexp_full_match(string_agg(letter, '' ORDER BY turn, role, text), 's?u(au)*a?') AS valid
FROM t GROUP BY conv_id
"""
