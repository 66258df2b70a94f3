"""Chat formatting with DataFrame functions only.

A declarative `Template` names a prefix and a suffix for each role, which roles carry loss, and the
turns that may follow each other. `format_chats` gives, per conversation, the segments (text and loss
flag) whose concatenation is the formatted text, and what the finite-state machine says of the order.

Control strings inside texts are escaped by putting one more escape character after their first
character, whether none or some stand there already; taking one away restores the text exactly.

Defined results: a null text is empty; a null role is the empty role; roles that the template
doesn't know are written between role marks and are an error of order; rows of one turn number are
ordered by role, then text; repeated rows are repeated turns; a null conversation id is one
conversation; an empty table gives an empty result; other columns are not read.
One row of the result holds one whole conversation, since its text and its digest are one value.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Role:
    prefix: str
    suffix: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    roles: dict[str, Role] = field(default_factory=lambda: {
        "system": Role("<s>[SYS] ", " [/SYS]"),
        "user": Role("[INST] ", " [/INST]"),
        "assistant": Role("[OUT] ", " </s>", loss=True),
    })
    #: Around the name of a role that has no entry, and after its text.
    other: tuple[str, str, str] = ("[ROLE] ", " [/ROLE] ", " [/TURN]")
    #: state -> role -> next state; anything else is an error. The state after a turn is its role.
    order: dict[str, tuple[str, ...]] = field(default_factory=lambda: {
        "": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",),
    })
    final: tuple[str, ...] = ("assistant",)
    controls: tuple[str, ...] = ("<s>", "</s>", "[SYS]", "[/SYS]", "[INST]", "[/INST]", "[OUT]", "[ROLE]", "[/ROLE]", "[/TURN]")
    escape: str = "\\"

    def __post_init__(self):
        firsts = {c[0] for c in self.controls}
        if self.escape in "".join(self.controls) or any(f in c[1:] for c in self.controls for f in firsts):
            raise ValueError("a control string holds the escape character, or another's first character further on")
        inner = set("".join(self.controls))
        marks = [m for r in self.roles.values() for m in (r.prefix[-1:], r.suffix[:1])]
        if any(m in inner or not m for m in [*marks, self.other[0][-1], self.other[1][0], self.other[1][-1], self.other[2][0]]):
            raise ValueError("marks must part texts from control strings by another character")

    def _spots(self, escapes: str) -> str:
        """A regular expression for the empty places after the first characters of control strings."""
        by: dict[str, list[str]] = {}
        for c in self.controls:
            by.setdefault(c[0], []).append(re.escape(c[1:]))
        one = re.escape(self.escape)
        return "|".join(f"(?<={re.escape(f)}){escapes}(?={one}*(?:{'|'.join(rest)}))" for f, rest in by.items())

    def escaped(self, text: Column) -> Column:
        return F.regexp_replace(text, self._spots(""), re.escape(self.escape))

    def unescaped(self, text: Column) -> Column:
        return F.regexp_replace(text, self._spots(re.escape(self.escape)), "")


def format_chats(rows: DataFrame, template: Template = Template(), id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Per conversation: id, segments array<struct<text, loss>>, formatted, valid, first_error (turn index or null)."""
    t = template
    turns = rows.select(F.col(id).alias("id"), F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).alias("t"))
    chats = turns.groupBy("id").agg(F.array_sort(F.collect_list("t")).alias("turns"))

    def segment(value: Column, loss: bool) -> Column:
        return F.struct(value.alias("text"), F.lit(loss).alias("loss"))

    def segments(x: Column) -> Column:
        body, out = t.escaped(x["text"]), None
        for name, r in t.roles.items():
            parts = F.array(segment(F.lit(r.prefix), False), segment(body, r.loss), segment(F.lit(r.suffix), False))
            out = F.when(x["role"] == name, parts) if out is None else out.when(x["role"] == name, parts)
        head = F.concat(F.lit(t.other[0]), t.escaped(x["role"]), F.lit(t.other[1]))
        return out.otherwise(F.array(segment(head, False), segment(body, False), segment(F.lit(t.other[2]), False)))

    step = F.create_map(*(F.lit(x) for state, nexts in t.order.items() for n in nexts for x in (f"{state}>{n}", n)))

    def advance(state: Column, x: Column) -> Column:
        nxt = F.try_element_at(step, F.concat(state["at"], F.lit(">"), x["role"]))
        bad = state["error"].isNull() & nxt.isNull()
        return F.struct(F.coalesce(nxt, F.lit("")).alias("at"), F.when(bad, state["n"]).otherwise(state["error"]).alias("error"), (state["n"] + 1).alias("n"))

    start = F.struct(F.lit("").alias("at"), F.lit(None).cast("int").alias("error"), F.lit(0).alias("n"))
    end = F.aggregate("turns", start, advance)
    out = chats.select("id", F.flatten(F.transform("turns", segments)).alias("segments"), end.alias("end"))
    return out.select(
        F.col("id").alias(id), "segments", F.array_join(F.col("segments.text"), "").alias("formatted"),
        (F.col("end.error").isNull() & F.col("end.at").isin(*t.final)).alias("valid"), F.col("end.error").alias("first_error"),
    )


def read_back(formatted: Column, template: Template = Template()) -> Column:
    """array<struct<role, text>>: the turns of a formatted text, unescaped."""
    t, q = template, re.escape
    heads = [q(r.prefix) for r in t.roles.values()] + [f"{q(t.other[0])}.*?{q(t.other[1])}"]
    tails = [q(r.suffix) for r in t.roles.values()] + [q(t.other[2])]
    pattern = F.lit(f"(?s)({'|'.join(heads)})(.*?)({'|'.join(tails)})")
    name = None

    def role(head: Column) -> Column:
        nonlocal name
        name = None
        for key, r in t.roles.items():
            name = F.when(head == r.prefix, key) if name is None else name.when(head == r.prefix, key)
        inner = F.substring(head, F.lit(len(t.other[0]) + 1), F.length(head) - len(t.other[0]) - len(t.other[1]))
        return name.otherwise(t.unescaped(inner))

    pairs = F.arrays_zip(F.regexp_extract_all(formatted, pattern, F.lit(1)).alias("h"), F.regexp_extract_all(formatted, pattern, F.lit(2)).alias("b"))
    return F.transform(pairs, lambda p: F.struct(role(p["h"]).alias("role"), t.unescaped(p["b"]).alias("text")))


def digest(chats: DataFrame, template: Template = Template(), id: str = "conv_id") -> DataFrame:
    """The columns of the op2 contract, read back from the formatted text and its loss mask."""
    back = chats.select(id, "segments", "formatted", "valid", read_back(F.col("formatted"), template).alias("turns"))
    loss = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: template.unescaped(s["text"])), "")
    all_turns = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return back.select(
        id, F.size("turns").cast("long").alias("n_turns"), F.sha2(all_turns, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"), "valid",
    )


def sql(rows: str = "conversations", template: Template = Template()) -> str:
    """DuckDB SQL for digest(format_chats()) with the conversation of the contract added."""
    t = template
    q = lambda s: "'" + s.replace("'", "''") + "'"
    body = role = "{}"
    esc = "\\\\" if t.escape == "\\" else re.escape(t.escape)
    for c in t.controls:  # one more escape character after the first character of each control string
        pattern = f"{re.escape(c[0])}({esc}*){re.escape(c[1:])}"
        body = f"regexp_replace({body}, {q(pattern)}, {q(c[0] + esc + chr(92) + '1' + c[1:])}, 'g')"
    role = body.replace("{}", "role")
    body = body.replace("{}", "text")
    whens = " ".join(f"WHEN {q(n)} THEN {len(r.prefix) + len(r.suffix)}" for n, r in t.roles.items())
    loss = ", ".join(q(n) for n, r in t.roles.items() if r.loss)
    allowed = ", ".join(q(f"{s}>{n}") for s, ns in t.order.items() for n in ns)
    return f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM {rows}
           UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
n AS (SELECT *, coalesce(lag(role) OVER w, '') AS before, lead(role) OVER w IS NULL AS is_last FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
        coalesce(string_agg(CASE WHEN role IN ({loss}) THEN text ELSE '' END, '' ORDER BY turn, role, text), '') AS loss,
        sum(length({body}) + CASE role {whens} ELSE {len(''.join(t.other))} + length({role}) END) AS chars,
        bool_and((before || '>' || role) IN ({allowed}) AND (NOT is_last OR role IN ({', '.join(map(q, t.final))}))) AS valid
      FROM n GROUP BY conv_id)
SELECT conv_id, n_turns::BIGINT AS n_turns, sha256(turns) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256,
  chars::BIGINT AS formatted_chars, valid FROM g"""
