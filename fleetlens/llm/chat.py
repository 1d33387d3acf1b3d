r"""Chat formatting by schema fingerprint (DataFrame functions only).

A layout is declared as the nested field paths it needs and a mapping from
those fields to canonical turns ``(conv_id, turns array<struct<role, text>>)``.
The fingerprint of a set of paths is the SHA-256 of its sorted members. A frame
(or, for JSON records, each row) gets the first declared layout whose
fingerprint equals that of the paths they share; fields that no layout names
are ignored, so extra columns never change the choice.

Template, one turn after the other::

    ### ROLE: TEXT</turn>\n

``\``, ``#`` and ``<`` inside a role or text are written ``\\``, ``\h`` and
``\l`` (and ``:`` in a role ``\c``), so neither ``###`` nor ``</turn>`` can occur
in a value and :func:`read_back` restores every text exactly. The loss mask is
``segments``: pieces whose concatenation is the formatted text, each with a flag
that is true for exactly the assistant texts.

Defined cases: a null role or text is empty; null conv_ids form one
conversation of their own; turns sort by ``turn`` (nulls first), then role, then
text, and repeated rows stay repeated turns; an empty table or an empty message
list gives no rows or zero turns. One conversation is one output cell, so it has
to fit Spark's 2 GB cell limit; nothing larger than one conversation is grouped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TURN = T.StructType([T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])
END = "</turn>\n"


def field_paths(schema: T.DataType, at: str = "") -> set[str]:
    """Nested field paths of a schema: ``a.b`` for structs, ``a[]`` for array elements."""
    if isinstance(schema, T.StructType):
        out = set()
        for f in schema.fields:
            out |= field_paths(f.dataType, f"{at}.{f.name}" if at else f.name)
        return out
    if isinstance(schema, T.ArrayType):
        return field_paths(schema.elementType, f"{at}[]")
    return {at}


def fingerprint(paths) -> str:
    """SHA-256 of the sorted paths."""
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


def _s(c) -> Column:
    return F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit(""))


def _turn(role, text) -> Column:
    return F.struct((F.lit(role) if isinstance(role, str) else role).alias("role"), _s(text).alias("text"))


def _by_rows(df: DataFrame) -> DataFrame:
    rows = df.select(F.col("conv_id").cast("long").alias("conv_id"),
                     F.struct(F.col("turn").alias("turn"), _s("role").alias("role"), _s("text").alias("text")).alias("t"))
    return rows.groupBy("conv_id").agg(
        F.transform(F.sort_array(F.collect_list("t")),
                    lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def _messages(column: str, role: str, text: str, names: dict[str, str] | None = None):
    def convert(df: DataFrame) -> DataFrame:
        def one(m):
            r = _s(m[role])
            for k, v in (names or {}).items():
                r = F.when(_s(m[role]) == k, F.lit(v)).otherwise(r)
            return F.struct(r.alias("role"), _s(m[text]).alias("text"))
        turns = F.coalesce(F.transform(F.col(column), one), F.array().cast(T.ArrayType(TURN)))
        return df.select(F.col("conv_id").cast("long").alias("conv_id"), turns.alias("turns"))
    return convert


def _instruction(df: DataFrame) -> DataFrame:
    ask = F.concat(_s("instruction"), F.when(_s("input") == "", F.lit("")).otherwise(F.concat(F.lit("\n\n"), _s("input"))))
    return df.select(F.col("conv_id").cast("long").alias("conv_id"),
                     F.array(_turn("user", ask), _turn("assistant", F.col("output"))).alias("turns"))


def _pair(ask: str, answer: str):
    def convert(df: DataFrame) -> DataFrame:
        return df.select(F.col("conv_id").cast("long").alias("conv_id"),
                         F.array(_turn("user", F.col(ask)), _turn("assistant", F.col(answer))).alias("turns"))
    return convert


@dataclass(frozen=True)
class Layout:
    name: str
    paths: frozenset[str]
    convert: Callable[[DataFrame], DataFrame]
    schema: str  # DDL of the fields, for JSON records

    @property
    def fingerprint(self) -> str:
        return fingerprint(self.paths)


#: Declared layouts, most specific first.
LAYOUTS = (
    Layout("turn rows", frozenset({"conv_id", "turn", "role", "text"}), _by_rows,
           "conv_id long, turn long, role string, text string"),
    Layout("messages", frozenset({"conv_id", "messages[].role", "messages[].content"}), _messages("messages", "role", "content"),
           "conv_id long, messages array<struct<role string, content string>>"),
    Layout("from/value", frozenset({"conv_id", "conversations[].from", "conversations[].value"}),
           _messages("conversations", "from", "value", {"human": "user", "gpt": "assistant"}),
           "conv_id long, conversations array<struct<`from` string, value string>>"),
    Layout("instruction", frozenset({"conv_id", "instruction", "input", "output"}), _instruction,
           "conv_id long, instruction string, input string, output string"),
    Layout("prompt/completion", frozenset({"conv_id", "prompt", "completion"}), _pair("prompt", "completion"),
           "conv_id long, prompt string, completion string"),
    Layout("question/answer", frozenset({"conv_id", "question", "answer"}), _pair("question", "answer"),
           "conv_id long, question string, answer string"),
)


def select_layout(schema: T.StructType, layouts=LAYOUTS) -> Layout:
    """The first layout whose fingerprint is that of the schema's paths it names."""
    paths = field_paths(schema)
    for m in layouts:
        if fingerprint(paths & m.paths) == m.fingerprint:
            return m
    raise ValueError(f"no declared layout fits the fields {sorted(paths)}")


def canonical_turns(df: DataFrame, layouts=LAYOUTS) -> DataFrame:
    """``conv_id, turns`` from a frame in any declared layout."""
    m = select_layout(df.schema, layouts)
    top = sorted({p.split(".")[0].split("[")[0] for p in m.paths})
    return m.convert(df.select(*[F.col(f"`{c}`") for c in top]))


def canonical_turns_json(df: DataFrame, column: str = "json", layouts=LAYOUTS) -> DataFrame:
    """``conv_id, turns`` from JSON records whose layout differs by row.

    Each row's field paths come from its parsed value, those of all elements of a
    list together; their fingerprint picks the row's layout. A record with an empty
    list fits by its top fields and has zero turns. Rows that fit none (null or
    broken JSON included) raise no error and come back with ``conv_id`` null and
    ``turns`` null.
    """
    keys = F.json_object_keys(F.col(f"`{column}`"))
    have = F.coalesce(keys, F.array().cast("array<string>"))
    tops = [sorted({p.split(".")[0].split("[")[0] for p in m.paths}) for m in layouts]
    which = F.lit(-1)
    for i in range(len(layouts) - 1, -1, -1):
        inner = sorted({p.split("[].")[1] for p in layouts[i].paths if "[]" in p})
        ok = F.sha2(F.array_join(F.array_sort(F.array_intersect(have, F.array(*map(F.lit, tops[i])))), "\n"), 256) == fingerprint(tops[i])
        if inner:
            column_of = next(p.split("[")[0] for p in layouts[i].paths if "[]" in p)
            element = F.from_json(F.get_json_object(F.col(f"`{column}`"), f"$.{column_of}"), "array<string>")
            held = F.array_distinct(F.flatten(F.transform(element, lambda e: F.coalesce(F.json_object_keys(e), F.array().cast("array<string>")))))
            found = F.sha2(F.array_join(F.array_sort(F.array_intersect(held, F.array(*map(F.lit, inner)))), "\n"), 256)
            ok = ok & F.coalesce((F.size(element) == 0) | (found == fingerprint(inner)), F.lit(False))
        which = F.when(ok, F.lit(i)).otherwise(which)
    rows = df.select(F.col(f"`{column}`").alias("record"), which.alias("layout"))
    out = rows.where("layout = -1").select(F.lit(None).cast("long").alias("conv_id"), F.lit(None).cast(T.ArrayType(TURN)).alias("turns"))
    for i, m in enumerate(layouts):
        part = rows.where(F.col("layout") == i).select(F.from_json("record", m.schema).alias("v")).select("v.*")
        out = out.unionByName(m.convert(part))
    return out


def escape(c: Column, role: bool = False) -> Column:
    c = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    c = F.replace(F.replace(c, F.lit("#"), F.lit("\\h")), F.lit("<"), F.lit("\\l"))
    return F.replace(c, F.lit(":"), F.lit("\\c")) if role else c


def unescape(c: Column, role: bool = False) -> Column:
    r"""Inverse of :func:`escape`. ``<`` and ``#`` cannot occur in escaped text, so they
    hold the places of ``\\`` and ``\l`` until one simultaneous exchange restores all."""
    c = F.replace(c, F.lit("\\\\"), F.lit("<"))
    if role:
        c = F.replace(c, F.lit("\\c"), F.lit(":"))
    c = F.replace(F.replace(c, F.lit("\\l"), F.lit("#")), F.lit("\\h"), F.lit("\\"))
    return F.translate(c, "<#\\", "\\<#")


def format_chat(turns: DataFrame) -> DataFrame:
    """``conv_id, formatted, segments``; loss is true on the texts of the role ``assistant``."""
    def pieces(t):
        return F.array(
            F.struct(F.concat(F.lit("### "), escape(t["role"], True), F.lit(": ")).alias("text"), F.lit(False).alias("loss")),
            F.struct(escape(t["text"]).alias("text"), (t["role"] == "assistant").alias("loss")),
            F.struct(F.lit(END).alias("text"), F.lit(False).alias("loss")))
    seg = turns.select("conv_id", F.flatten(F.transform("turns", pieces)).alias("segments"))
    return seg.select("conv_id", F.array_join(F.col("segments.text"), "").alias("formatted"), "segments")


def read_back(formatted: Column) -> Column:
    """Turns (role, text) parsed from the formatted text alone."""
    parts = F.split(formatted, END)
    parts = F.slice(parts, 1, F.size(parts) - 1)

    def one(p):
        body = F.substr(p, F.lit(5))
        role = F.substring_index(body, ": ", 1)
        return F.struct(unescape(role, True).alias("role"),
                        unescape(F.substr(body, F.length(role) + 3)).alias("text"))
    return F.transform(parts, one)


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")


def digest(chat: DataFrame) -> DataFrame:
    """Counts and digests of formatted chats, read back from the formatted output."""
    back = chat.select("conv_id", "formatted", read_back(F.col("formatted")).alias("turns"),
                       loss_text(F.col("segments")).alias("loss"))
    flat = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(flat, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))
