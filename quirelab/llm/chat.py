"""Chat formatting by schema fingerprints.

A record's nested field paths ("messages[].role") are hashed. The first record of each fingerprint chooses, among
declarative mappings, the one that needs the most of these paths; all others of the fingerprint take it from a table. A
mapping says where turns stand, not how to walk a record, so that prompt, instruction and message layouts become rows of
(role, text) alike.

A template writes each turn as a piece of text with marks. Marks that stand inside a text or a role get a backslash after
their first character (one more if they have some already), so that no text can open or close a turn and every text can be
read back. Loss spans cover assistant texts, by code points of the piece.

Cases: a null role or text is the empty string. Turns are in the order of the given columns (null first), then of the place
in their record, then of their digest. A record that fits no mapping, is no JSON object or is null gives one row without
layout, role and text, which format_turns leaves out and counts can find. A field that a mapping names as optional gives no
turn where it is missing or null. Repeated rows are repeated turns. A null key is a conversation of its own. Texts of any
length are formatted whole, and a conversation of any number of turns is never held by one task. Empty tables give no rows.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quirelab.llm.rows import map_rows
from quirelab.llm.sequences import hashed
from quirelab.session import materialise

#: Fingerprints whose mapping a task remembers.
KNOWN = 10_000


@dataclass(frozen=True)
class Turn:
    """A turn's role and where its text stands: paths whose texts are joined by an empty line. Without the first one there
    is no turn."""

    role: str
    texts: tuple[str, ...]


@dataclass(frozen=True)
class Each:
    """A turn for each element of an array (of the record itself, if path is empty); its text stands at the first of the
    paths that leads to one."""

    path: str
    role: str
    texts: tuple[str, ...]


@dataclass(frozen=True)
class Mapping:
    name: str
    needs: frozenset[str]
    turns: tuple[Turn | Each, ...]


def mapping(name: str, needs: str, *turns: Turn | Each) -> Mapping:
    return Mapping(name, frozenset(needs.split()), turns)


#: Field names of common layouts, and what they call the three roles.
MAPPINGS = (
    mapping("turn", "role text", Each("", "role", ("text",))),
    mapping("message parts", "messages[].role messages[].content[].text", Each("messages", "role", ("content[].text", "content"))),
    mapping("messages", "messages[].role messages[].content", Each("messages", "role", ("content",))),
    mapping("from and value", "conversations[].from conversations[].value", Turn("system", ("system",)), Each("conversations", "from", ("value",))),
    mapping("instruction", "instruction output", Turn("system", ("system",)), Turn("user", ("instruction", "input")), Turn("assistant", ("output",))),
    mapping("prompt and completion", "prompt completion", Turn("system", ("system",)), Turn("user", ("prompt",)), Turn("assistant", ("completion",))),
    mapping("prompt and response", "prompt response", Turn("system", ("system",)), Turn("user", ("prompt",)), Turn("assistant", ("response",))),
    mapping("question and answer", "question answer", Turn("user", ("question", "context")), Turn("assistant", ("answer",))),
)
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def field_paths(value: object, at: str = "") -> Iterator[str]:
    """The nested field paths of a record, with those of objects and arrays on the way; repeats are possible."""
    if isinstance(value, dict):
        for k, v in value.items():
            path = f"{at}.{k}" if at else k
            yield path
            yield from field_paths(v, path)
    elif isinstance(value, list):
        for v in value:
            yield from field_paths(v, at + "[]")


def fingerprint(record: object) -> int:
    return xxhash.xxh3_64_intdigest("\n".join(sorted(set(field_paths(record)))).encode("utf-8", "surrogatepass"))


def choose(record: object, mappings: Sequence[Mapping]) -> Mapping | None:
    """The mapping that needs the most of the record's paths; of equal ones the first."""
    there = set(field_paths(record))
    return max((m for m in mappings if m.needs <= there), key=lambda m: len(m.needs), default=None)


def values(record: object, path: str) -> list[str]:
    """The texts at a path, in order; numbers, objects and the like as JSON."""
    found = [record]
    for step in path.replace("[]", ".[]").split(".") if path else []:
        if step == "[]":
            found = [x for v in found if isinstance(v, list) for x in v]
        else:
            found = [v[step] for v in found if isinstance(v, dict) and v.get(step) is not None]
    return [v if isinstance(v, str) else json.dumps(v, ensure_ascii=False) for v in found]


def turns_of(record: dict, chosen: Mapping) -> list[tuple[str, str]]:
    out = []
    for spec in chosen.turns:
        if isinstance(spec, Each):
            for one in (record.get(spec.path) or []) if spec.path else [record]:
                role = "".join(values(one, spec.role))
                out.append((ROLES.get(role, role), "".join(next(filter(None, (values(one, path) for path in spec.texts)), []))))
        elif values(record, spec.texts[0]):
            out.append((spec.role, "\n\n".join(t for path in spec.texts for t in values(record, path))))
    return out


def canonical_turns(records: DataFrame, payload_col: str, keep: Sequence[str], mappings: Sequence[Mapping] = MAPPINGS) -> DataFrame:
    """keep, layout, at, role, text: the turns of records, whose payload is a struct or JSON text. at counts from 0."""
    schema = T.StructType([*(T.StructField(c, records.schema[c].dataType) for c in keep), *T.StructType.fromDDL("layout string, at int, role string, text string")])
    n = len(keep)

    def make():
        known: dict[int, Mapping | None] = {}

        def read(payload: object) -> object:
            if isinstance(payload, str):
                try:
                    return json.loads(payload)
                except ValueError:
                    return None
            return payload

        def call(*columns):
            out: list[list] = [[] for _ in schema]
            for *kept, payload in zip(*columns):
                record = read(payload)
                chosen = None
                if isinstance(record, dict):
                    mark = fingerprint(record)
                    if mark in known:
                        chosen = known[mark]
                    else:
                        chosen = choose(record, mappings)
                        if len(known) < KNOWN:
                            known[mark] = chosen
                rows = [(chosen.name, k, *t) for k, t in enumerate(turns_of(record, chosen))] if chosen else [(None, None, None, None)]
                for row in rows:
                    for x, v in zip(out, (*kept, *row)):
                        x.append(v)
            return out

        return call

    return map_rows(records, [*keep, payload_col], schema, make)


@dataclass(frozen=True)
class Template:
    """marks: strings that no text may hold as they are, each an opening character and a rest. turns: role, opening, closing;
    other: opening, middle and closing of turns of other roles. Openings start and closings end with a mark."""

    marks: tuple[str, ...]
    turns: tuple[tuple[str, str, str], ...]
    other: tuple[str, str, str]

    def _pattern(self, extra: str = "") -> str:
        first = "".join(sorted({m[0] for m in self.marks}))
        rests = "|".join(dict.fromkeys(re.escape(m[1:]) for m in self.marks))
        return f"([{re.escape(first)}]){extra}(\\\\*(?:{rests}))"

    def escape(self, c: Column) -> Column:
        return F.regexp_replace(c, F.lit(self._pattern()), F.lit("$1\\\\$2"))

    def unescape(self, c: Column) -> Column:
        return F.regexp_replace(c, F.lit(self._pattern("\\\\")), F.lit("$1$2"))

    def write(self, role: Column, text: Column) -> tuple[Column, Column, Column]:
        """The piece of a turn, and start and length of the loss span in it."""
        text = self.escape(text)
        begin, middle, end = self.other
        piece = F.concat(F.lit(begin), self.escape(role), F.lit(middle), text, F.lit(end))
        start = F.lit(0)
        for name, opening, closing in self.turns:
            piece = F.when(role == name, F.concat(F.lit(opening), text, F.lit(closing))).otherwise(piece)
            if name == "assistant":
                start = F.lit(len(opening))
        loss = role == "assistant"
        return piece, F.when(loss, start).otherwise(0), F.when(loss, F.length(text)).otherwise(0)

    def read(self, piece: Column) -> tuple[Column, Column]:
        """The role and text of a piece."""
        cut = lambda a, b: self.unescape(F.substring(piece, F.lit(len(a) + 1), F.length(piece) - len(a) - len(b)))
        begin, middle, end = self.other
        # Openings that begin another one's are asked for last.
        forms = sorted([(o, c, F.lit(r), cut(o, c)) for r, o, c in self.turns] + [(begin, end, None, None)], key=lambda x: len(x[0]))
        at = F.instr(piece, middle)
        role = text = F.lit(None).cast("string")
        for opening, closing, r, t in forms:
            if r is None:
                r = self.unescape(F.substring(piece, F.lit(len(begin) + 1), at - len(begin) - 1))
                t = self.unescape(F.substring(piece, at + len(middle), F.length(piece) - at - len(middle) - len(end) + 1))
            fits = piece.startswith(opening)
            role, text = F.when(fits, r).otherwise(role), F.when(fits, t).otherwise(text)
        return role, text


#: Marks of instruction templates.
INST = Template(
    ("<s>", "</s>", "<<SYS>>", "<</SYS>>", "[INST]", "[/INST]", "[ROLE]", "[/ROLE]"),
    (("user", "<s>[INST] ", " [/INST]</s>"), ("assistant", "<s>", "</s>"), ("system", "<s><<SYS>>\n", "\n<</SYS>></s>")),
    ("<s>[ROLE] ", " [/ROLE]", "</s>"),
)


def format_turns(turns: DataFrame, key: str, order: Sequence[str] = (), template: Template = INST) -> DataFrame:
    """key, order (a struct, by which pieces are sorted), piece, loss_start, loss_length: a row for each turn. The formatted
    conversation is its pieces one after another."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    piece, start, length = template.write(role, text)
    place = F.struct(*(F.col(c) for c in order), F.col("at"), F.sha2(F.concat(role, F.lit("\n"), text).cast("binary"), 256).alias("digest"))
    return turns.where("layout IS NOT NULL").select(key, place.alias("order"), piece.alias("piece"), start.alias("loss_start"), length.alias("loss_length"))


def read_turns(formatted: DataFrame, key: str, template: Template = INST) -> DataFrame:
    """key, order, role, text, loss (the text under the mask, null without), piece: what formatted turns say."""
    role, text = template.read(F.col("piece"))
    loss = F.when(F.col("loss_start") > 0, template.unescape(F.substring("piece", F.col("loss_start") + 1, F.col("loss_length"))))
    return formatted.select(key, "order", role.alias("role"), text.alias("text"), loss.alias("loss"), "piece")


def digest(formatted: DataFrame, key: str, template: Template = INST) -> DataFrame:
    """key, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars: as read back from formatted turns."""
    read = read_turns(formatted, key, template)
    sums = read.groupBy(key).agg(F.count(F.lit(1)).alias("n_turns"), F.coalesce(F.sum(F.length("loss")), F.lit(0)).alias("loss_chars"), F.sum(F.length("piece").cast("long")).alias("formatted_chars"))
    turns = hashed(read, [key], "order", F.concat("role", F.lit("\n"), "text", F.lit("\n")), "turns_sha256")
    loss = hashed(read.where("loss IS NOT NULL"), [key], "order", F.col("loss"), "loss_sha256")
    same = lambda a, b: a[key].eqNullSafe(b[key])
    out = sums.join(turns, same(sums, turns)).join(loss, same(sums, loss), "left")
    return out.select(sums[key], "n_turns", "turns_sha256", F.col("loss_chars").cast("long").alias("loss_chars"), F.coalesce("loss_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("loss_sha256"), "formatted_chars")


def marked_conversation(spark: SparkSession) -> DataFrame:
    """Conversation -7, whose texts are made of marks, as a record of messages: conv_id, turn, payload."""
    text = "</s>[INST] ok [/INST]"
    record = {"messages": [{"role": "user", "content": text}, {"role": "assistant", "content": text}]}
    return spark.range(1).select(F.lit(-7).cast("long").alias("conv_id"), F.lit(None).cast("long").alias("turn"), F.lit(json.dumps(record)).alias("payload"))


def format_conversations(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Formatted turns of a table of turns and of conversation -7, written to the shared folder and read from there."""
    c = conversations
    rows = c.select(c[conv_col].cast("long").alias("conv_id"), c[turn_col].cast("long").alias("turn"), F.struct(c[role_col].alias("role"), c[text_col].alias("text")).alias("payload"))
    keep = ["conv_id", "turn"]
    turns = canonical_turns(rows, "payload", keep).union(canonical_turns(marked_conversation(c.sparkSession), "payload", keep))
    return materialise(format_turns(turns, "conv_id", ["turn"]), "formatted")


#: The same rows by DuckDB.
SQL = r"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
 e AS (SELECT *, sha256(role || chr(10) || text) AS k, length(regexp_replace(text, '([<\[])(\\*(?:s>|/s>|<SYS>>|</SYS>>|INST\]|/INST\]|ROLE\]|/ROLE\]))', '\1\\\2', 'g')) AS n,
  length(regexp_replace(role, '([<\[])(\\*(?:s>|/s>|<SYS>>|</SYS>>|INST\]|/INST\]|ROLE\]|/ROLE\]))', '\1\\\2', 'g')) AS m FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, k)) AS turns_sha256,
 CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
 sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, k) FILTER (role = 'assistant'), '')) AS loss_sha256,
 CAST(sum(n + CASE role WHEN 'user' THEN 22 WHEN 'assistant' THEN 7 WHEN 'system' THEN 24 ELSE 22 + m END) AS BIGINT) AS formatted_chars
 FROM e GROUP BY conv_id"""
