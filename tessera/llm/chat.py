"""Chat formatting: conversations rendered turn by turn through a compiled template, with reversible escapes
and a loss mask, and read back from the rendered text."""

from __future__ import annotations

import hashlib
import re
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.template import Template, text_of

#: Strings that chat formats give a meaning to. None may stand in a rendered text as it is.
CONTROLS = (
    "<|turn|>", "<|says|>", "<|end|>", "<|endoftext|>", "<|startoftext|>", "<|im_start|>", "<|im_end|>", "<|begin_of_text|>", "<|eot_id|>",
    "<|start_header_id|>", "<|end_header_id|>", "<|system|>", "<|user|>", "<|assistant|>", "<s>", "</s>", "<unk>", "<pad>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>",
    "<start_of_turn>", "<end_of_turn>", "<bos>", "<eos>",
)
MARK = "\\"
_STARTS = re.compile("(?=" + "|".join(map(re.escape, CONTROLS)) + ")(.)", re.S)
_UNDO = re.compile(r"\\(\\?)")

TEMPLATE = (
    "{%- for m in messages -%}"
    "<|turn|>{{ m.role | escape }}<|says|>"
    "{%- if m.role == 'assistant' -%}{% generation %}{{ m.content | escape }}{% endgeneration %}"
    "{%- else -%}{{ m.content | escape }}{%- endif -%}"
    "<|end|>"
    "{%- endfor -%}"
)


def escape(text) -> str:
    """Doubles the mark and puts one behind the first character of every control string, overlapping ones too."""
    return _STARTS.sub(r"\1\\", text_of(text).replace(MARK, MARK * 2))


def unescape(text: str) -> str:
    return _UNDO.sub(r"\1", text)


FILTERS = {"escape": escape}
_TURN = re.compile(r"<\|turn\|>(.*?)<\|says\|>(.*?)<\|end\|>", re.S)


class Reader:
    """Takes rendered pieces as they come and digests the turns and the masked text read back from them."""

    def __init__(self):
        self.turns = hashlib.sha256()
        self.loss = hashlib.sha256()
        self.n_turns = self.loss_chars = self.chars = 0
        self.buffer: list[str] = []
        self.masked: list[str] = []

    def write(self, text: str, masked: bool) -> None:
        self.chars += len(text)
        self.buffer.append(text)
        if masked:
            self.masked.append(text)
        elif "<|end|>" in text:
            self.flush()

    def flush(self) -> None:
        text, at = "".join(self.buffer), 0
        for m in _TURN.finditer(text):
            role, said = unescape(m[1]), unescape(m[2])
            self.turns.update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
            self.n_turns += 1
            at = m.end()
        self.buffer = [text[at:]]
        if self.masked:
            loss = unescape("".join(self.masked))
            self.loss.update(loss.encode("utf-8", "surrogatepass"))
            self.loss_chars += len(loss)
            self.masked = []

    def row(self, conv_id) -> tuple:
        self.flush()
        return conv_id, self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


DIGEST = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _dealt(conversations: DataFrame) -> DataFrame:
    turns = conversations.select("conv_id", "turn", "role", "text")
    return turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")


def _messages(batches):
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True)


def _said(turns):
    return ({"role": role or "", "content": text or ""} for _, role, text in turns)


def formatted(conversations: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """(conv_id, formatted, loss_spans): the rendered text and the (start, end) code point spans under the loss mask.

    Turns go by `turn`, ties by role and text; repeated rows are turns of their own. Null roles and texts are
    empty. A null conv_id is a conversation. Other columns are not read; an empty table gives none.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = f"conv_id {dict(conversations.dtypes)['conv_id']}, formatted string, loss_spans array<struct<start: long, end: long>>"
    target = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        compiled = Template(template, FILTERS)
        for conv_id, turns in groupby(_messages(batches), key=lambda r: r[0]):
            text, spans = compiled.render(messages=_said(turns))
            columns = ([conv_id], [text], [[{"start": a, "end": b} for a, b in spans]])
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, target, strict=True)], schema=target)

    return _dealt(conversations).mapInArrow(run, schema)


def digests(conversations: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) read back from the rendered text.

    As formatted(), but streamed: a task holds one turn at a time, however long a conversation is.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = f"conv_id {dict(conversations.dtypes)['conv_id']}, {DIGEST}"
    target = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        compiled, rows = Template(template, FILTERS), []
        for conv_id, turns in groupby(_messages(batches), key=lambda r: r[0]):
            reader = Reader()
            compiled.stream(reader.write, messages=_said(turns))
            rows.append(reader.row(conv_id))
            if len(rows) >= 2000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), target, strict=True)], schema=target)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), target, strict=True)], schema=target)

    return _dealt(conversations).mapInArrow(run, schema)
