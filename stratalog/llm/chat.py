"""Chat formatting: a finite-state machine over roles and a declarative template.

Conversations are dealt out by id and sorted by turn inside each partition; one streaming
pass then walks the rows, so a conversation of any length needs the memory of one turn. The
output is a stream of text segments with a loss flag each, and the reader turns such a
stream back into roles and texts."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table


@dataclass(frozen=True)
class ChatTemplate:
    """Markers around a turn, the roles whose text bears loss, and the order of turns.

    `steps` maps a state to the roles that may come next; a role is the next state. `final`
    holds the states in which a conversation may end."""

    open: str = "<turn>"
    after_role: str = "\n"
    close: str = "</turn>\n"
    loss_roles: tuple[str, ...] = ("assistant",)
    steps: dict[str, tuple[str, ...]] = field(default_factory=lambda: {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})
    final: tuple[str, ...] = ("assistant",)

    @property
    def controls(self) -> tuple[str, ...]:
        return (self.open.strip(), self.close.strip())

    def escape(self, text: str) -> str:
        """A backslash goes before each backslash and each control string."""
        text = text.replace("\\", "\\\\")
        for x in self.controls:
            text = text.replace(x, "\\" + x)
        return text

    def escape_role(self, role: str) -> str:
        return self.escape(role).replace(self.after_role, "\\" + self.after_role)

    @staticmethod
    def unescape(text: str) -> str:
        return re.sub(r"\\(.)", r"\1", text, flags=re.S)

    def turn_pattern(self) -> re.Pattern[str]:
        o, r, c = (re.escape(x) for x in (self.open, self.after_role, self.close))
        return re.compile(rf"{o}((?:\\.|(?!{r})[^\\])*){r}((?:\\.|(?!{c})[^\\])*){c}", re.S)


TEMPLATE = ChatTemplate()
SEGMENTS = pa.schema([("conv_id", pa.int64()), ("seg", pa.int64()), ("text", pa.string()), ("loss", pa.bool_()), ("valid", pa.bool_())])
SEGMENTS_DDL = "conv_id long, seg long, text string, loss boolean, valid boolean"
#: Segments, or bytes of them, in one batch.
BATCH_ROWS, BATCH_BYTES = 4096, 4 << 20


def _emit(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def segments(conversations: DataFrame, template: ChatTemplate = TEMPLATE) -> DataFrame:
    """Rows conv_id, seg, text, loss, valid of all conversations of (conv_id, turn, role, text).

    Each turn gives an opening with the role, its escaped text and a closing; a last segment
    without text ends a conversation and has whether the machine accepts it. Segments of a
    conversation come in order, within one partition. Turns are ordered by turn (null first),
    then role and text, so ties and repeated rows have one order; a null text or role is empty,
    null ids form one conversation. A conversation that the machine rejects is formatted all
    the same, with valid false from the turn at fault. An empty table has no segments."""
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        size, begun, conv, seg, state, valid = 0, False, None, 0, "", True
        for batch in batches:
            for next_conv, role, text in zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3)):
                role, text = role.as_py(), text.as_py()
                if not begun or next_conv != conv:
                    if begun:
                        out.append((conv, seg, "", False, valid and state in template.final))
                    begun, conv, seg, state, valid = True, next_conv, 0, "", True
                valid = valid and role in template.steps.get(state, ())
                state = role
                out.append((conv, seg, template.open + template.escape_role(role) + template.after_role, False, valid))
                out.append((conv, seg + 1, template.escape(text), role in template.loss_roles, valid))
                out.append((conv, seg + 2, template.close, False, valid))
                seg += 3
                size += len(text)
                if len(out) >= BATCH_ROWS or size >= BATCH_BYTES:
                    yield _emit(out, SEGMENTS)
                    out, size = [], 0
        if begun:
            out.append((conv, seg, "", False, valid and state in template.final))
        if out:
            yield _emit(out, SEGMENTS)

    return ordered.mapInArrow(walk, SEGMENTS_DDL)


DIGESTS = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("valid", pa.bool_())])


def read_back(formatted: DataFrame, template: ChatTemplate = TEMPLATE) -> DataFrame:
    """One row per conversation, parsed from its segments alone.

    Takes the output of segments() as it comes, each conversation's segments in order within
    one partition, and fails where they aren't. The text of a turn is parsed with the
    template's markers as soon as it is closed; only its digests are kept."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern = template.turn_pattern()
        conv, want = None, 0
        out: list[tuple] = []
        for batch in batches:
            for conv_id, seg, text, loss, valid in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if seg == 0:
                    if want:
                        raise ValueError(f"segments of conversation {conv} end early")
                    conv, turns, chars, loss_chars = conv_id, 0, 0, 0
                    turns_sha, loss_sha, open_text = hashlib.sha256(), hashlib.sha256(), []
                elif conv_id != conv or seg != want:
                    raise ValueError(f"segment {seg} of conversation {conv_id} is out of order")
                want = seg + 1
                chars += len(text)
                if loss:
                    plain = template.unescape(text)
                    loss_chars += len(plain)
                    loss_sha.update(plain.encode())
                if text:
                    open_text.append(text)
                    if text == template.close:
                        m = pattern.fullmatch("".join(open_text))
                        if not m:
                            raise ValueError(f"conversation {conv_id} doesn't parse at segment {seg}")
                        turns_sha.update(f"{template.unescape(m[1])}\n{template.unescape(m[2])}\n".encode())
                        turns += 1
                        open_text = []
                elif not open_text:  # the end: an empty text of a turn follows its opening
                    out.append((conv_id, turns, turns_sha.hexdigest(), loss_chars, loss_sha.hexdigest(), chars, valid))
                    want = 0
                    if len(out) >= BATCH_ROWS:
                        yield _emit(out, DIGESTS)
                        out = []
        if out:
            yield _emit(out, DIGESTS)

    return formatted.mapInArrow(parse, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean")


#: A conversation that holds the control strings of common templates.
EXTRA_TEXT = "\\### Assistant: </turn> ok"


def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-7, 0, "user", EXTRA_TEXT), (-7, 1, "assistant", EXTRA_TEXT)], "conv_id long, turn long, role string, text string")
    return read_back(segments(rows.unionByName(extra)))


OP1_SQL = r"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all values (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
o as (
  select *, row_number() over w as i, count(*) over (partition by conv_id) as n, lag(role) over w as before
  from t window w as (partition by conv_id order by turn nulls first, role, text)),
e as (
  select *,
    replace(replace(replace(text, '\', '\\'), '<turn>', '\<turn>'), '</turn>', '\</turn>') as escaped,
    replace(replace(replace(replace(role, '\', '\\'), '<turn>', '\<turn>'), '</turn>', '\</turn>'), chr(10), '\' || chr(10)) as escaped_role,
    coalesce(case when i = 1 then role in ('system', 'user') when before in ('system', 'assistant') then role = 'user' when before = 'user' then role = 'assistant' end, false)
      and (i < n or role = 'assistant') as fits
  from o)
select conv_id, count(*)::bigint as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by i)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by i) filter (role = 'assistant'), '')) as loss_sha256,
  sum(length(escaped_role) + length(escaped) + 6 + 1 + 8)::bigint as formatted_chars,
  bool_and(fits) as valid
from e group by conv_id
"""
