"""Chat formatting with the spans of turns found by black-box rendering.

A template is any function from a list of (role, text) to a string. It is never
parsed: the turns before and up to each turn are rendered, and the output that
comes on top of the previous one is the turn's span. Where an output doesn't begin
with the one before it, the template rewrites history; such a conversation is
flagged, and its spans come from the last rendering. A turn's text is located
inside by rendering the same turns once more with a mark in the text's place: a
private-use character that neither the turns nor their rendering hold.

``plain_template`` is the template of the query. It escapes its control strings
inside texts and roles, reversibly, so that no text can close a turn or open one.

Turns are ordered by turn, then role and text; null turns come first, null roles
and texts are empty. Each row with a null conv_id is a conversation of its own, as
nothing says that such rows belong together. Repeated
rows are turns of their own. Extra columns are ignored; an empty table gives no
rows. A conversation is rendered in one task; rendering all prefixes takes time in
proportion to the square of its turns.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Turns = list[tuple[str, str]]

#: Control strings of the template; fixed values.
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]")
#: Stands for a line break in a role: a backslash that is not doubled, before a letter.
BREAK = "\\n"
#: Private-use characters, which templates leave alone.
MARKS = (range(0xE000, 0xF900), range(0xF0000, 0xFFFFE), range(0x100000, 0x10FFFE))


def escape(text: str) -> str:
    """A backslash becomes two; a control string gets one after its first character."""
    text = text.replace("\\", "\\\\")
    for c in CONTROLS:
        text = text.replace(c, f"{c[0]}\\{c[1:]}")
    return text


def unescape(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text)


def plain_template(turns: Turns) -> str:
    """<s>role, a line break, [INST]text[/INST]</s>, a line break; assistants' texts have no [INST]."""
    out = []
    for role, text in turns:
        name = escape(role).replace("\n", BREAK)
        body = escape(text)
        out.append(f"<s>{name}\n{body}</s>\n" if role == "assistant" else f"<s>{name}\n[INST]{body}[/INST]</s>\n")
    return "".join(out)


def read_back(formatted: str) -> Turns:
    """The turns that plain_template rendered."""
    turns = []
    for block in formatted.split("</s>\n")[:-1]:
        name, _, body = block.removeprefix("<s>").partition("\n")
        role = unescape(re.sub(r"\\(\\|n)", lambda m: "\n" if m[1] == "n" else m[0], name))
        turns.append((role, unescape(body if role == "assistant" else body.removeprefix("[INST]").removesuffix("[/INST]"))))
    return turns


def unused_mark(turns: Turns, rendered: str) -> str:
    """A character that no role, text or rendering of theirs holds."""
    used = set(rendered).union(*(set(part) for turn in turns for part in turn))
    return next(c for c in map(chr, chain(*MARKS)) if c not in used)


def spans(turns: Turns, template: Callable[[Turns], str]) -> tuple[str, list[tuple[int, int, int, int]], bool]:
    """(output, (start, stop, text start, text stop) of each turn, whether the template rewrites history)."""
    before, out, rewrites = template([]), [], False
    first, mark = before, unused_mark(turns, template(turns))
    for i, (role, text) in enumerate(turns):
        now = template(turns[: i + 1])
        rewrites |= not now.startswith(before)
        marked = template([*turns[:i], (role, mark)])
        at = marked.find(mark, 0 if rewrites else len(before))
        out.append((len(before), len(now), at, at + len(now) - len(marked) + len(mark)))
        before = now
    if not rewrites:
        return before, out, False
    # each turn's place in the last rendering, by marking it there
    places = []
    for i, (role, _) in enumerate(turns):
        marked = template([*turns[:i], (role, mark), *turns[i + 1 :]])
        at = marked.find(mark)
        places.append((at, at + len(before) - len(marked) + len(mark)) if at >= 0 else (-1, -1))
    starts = [len(first)]
    for (_, stop), (begin, _) in zip(places, places[1:]):
        starts.append(stop if begin < 0 else max(stop, starts[-1]))
    return before, [(s, e, *p) for s, e, p in zip(starts, [*starts[1:], len(before)], places)], True


OUT = "conv_id long, n_turns long, formatted string, turn_spans array<array<int>>, loss_spans array<array<int>>, rewrites_history boolean"
_OUT = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("formatted", pa.string()), ("turn_spans", pa.list_(pa.list_(pa.int32()))), ("loss_spans", pa.list_(pa.list_(pa.int32()))), ("rewrites_history", pa.bool_())])


def conversations(rows: DataFrame) -> DataFrame:
    """(conv_id, turns): the turns of each conversation in order."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    conv = F.col("conv_id").cast("long")
    alone = F.when(conv.isNull(), F.monotonically_increasing_id())
    return rows.groupBy(conv.alias("conv_id"), alone.alias("alone")).agg(F.sort_array(F.collect_list(turn)).alias("turns")).select("conv_id", F.transform("turns", lambda t: F.struct(t.role.alias("role"), t.text.alias("text"))).alias("turns"))


def formatted(rows: DataFrame, template: Callable[[Turns], str] = plain_template, loss_role: str = "assistant") -> DataFrame:
    """(conv_id, n_turns, formatted, turn_spans, loss_spans, rewrites_history) for each conversation.

    Spans are in code points; loss_spans cover the texts of ``loss_role``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for conv, turns in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                turns = [(t["role"], t["text"]) for t in turns]
                text, found, rewrites = spans(turns, template)
                out.append((conv, len(turns), text, [list(s[:2]) for s in found], [list(s[2:]) for s, t in zip(found, turns) if t[0] == loss_role and s[2] >= 0], rewrites))
            columns = list(zip(*out)) if out else [()] * len(_OUT)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _OUT)], schema=_OUT)

    return conversations(rows).mapInArrow(run, OUT)


#: The digests in DuckDB SQL, from the rows themselves.
ORACLE = r"""
WITH rows AS (
  SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
escaped AS (
  SELECT *, {body} AS body, replace({name}, chr(10), '\n') AS name FROM rows)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(name) + length(body) + CASE WHEN role = 'assistant' THEN 9 ELSE 22 END) AS BIGINT) AS formatted_chars,
       false AS rewrites_history
FROM escaped GROUP BY conv_id
"""
for _column, _place in (("text", "{body}"), ("role", "{name}")):
    _sql = f"replace({_column}, chr(92), chr(92) || chr(92))"
    for _c in CONTROLS:
        _sql = f"replace({_sql}, '{_c}', '{_c[0]}' || chr(92) || '{_c[1:]}')"
    ORACLE = ORACLE.replace(_place, _sql)


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, rewrites_history boolean"
_DIGESTS = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("rewrites_history", pa.bool_())])


def digests(done: DataFrame) -> DataFrame:
    """What can be read back from ``formatted`` with plain_template: turns, and the text under the loss mask."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for conv, text, loss, rewrites in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "formatted", "loss_spans", "rewrites_history"))):
                turns = read_back(text)
                under = "".join(unescape(text[a:b]) for a, b in loss)
                said = "".join(f"{role}\n{body}\n" for role, body in turns)
                out.append((conv, len(turns), hashlib.sha256(said.encode()).hexdigest(), len(under), hashlib.sha256(under.encode()).hexdigest(), len(text), rewrites))
            columns = list(zip(*out)) if out else [()] * len(_DIGESTS)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _DIGESTS)], schema=_DIGESTS)

    return done.mapInArrow(run, DIGESTS)


def with_probe(rows: DataFrame) -> DataFrame:
    """rows and conversation -1, whose texts are control strings."""
    probe = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]
    own = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    return own.unionByName(rows.sparkSession.createDataFrame(probe, "conv_id long, turn long, role string, text string"))
