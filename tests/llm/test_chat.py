import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from rivulet.llm.chat import digests, escape, formatted, plain_template, read_back, spans, unescape, with_probe

SCHEMA = "conv_id long, turn long, role string, text string, lang string"
PIECES = st.lists(st.sampled_from(["<s>", "</s>", "[INST]", "[/INST]", "\\", "\n", "a", "<", "[", "s>", "</s>\n<s>", "é", "\ue000", "\ue001"]), max_size=8).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant"]), PIECES), PIECES), max_size=5))
def test_round_trip_and_spans(turns):
    text = plain_template(turns)
    assert read_back(text) == turns
    got, found, rewrites = spans(turns, plain_template)
    assert got == text and not rewrites
    assert [unescape(text[a:b]) for _, _, a, b in found] == [t for _, t in turns]
    assert "".join(text[a:b] for a, b, _, _ in found) == text
    assert all(c not in escape(t) for _, t in turns for c in ("<s>", "</s>", "[INST]", "[/INST]"))


def forgetful(turns):
    """Drops the body of all assistant turns but the last."""
    return "".join(f"{r}:{'...' if r == 'assistant' and i < len(turns) - 1 else t};" for i, (r, t) in enumerate(turns))


def test_history_that_is_rewritten_is_found():
    turns = [("user", "a"), ("assistant", "long answer"), ("user", "b"), ("assistant", "end")]
    text, found, rewrites = spans(turns, forgetful)
    assert rewrites and text == "user:a;assistant:...;user:b;assistant:end;"
    assert [text[a:b] if a >= 0 else None for _, _, a, b in found] == ["a", None, "b", "end"]


def test_marks_in_the_data_do_not_mislead():
    turns = [("us\ue000er", "a\ue000"), ("assistant", "\ue000b\ue001"), ("user", "\ue000")]
    text, found, rewrites = spans(turns, forgetful)
    assert rewrites and [text[a:b] if a >= 0 else None for _, _, a, b in found] == ["a\ue000", None, "\ue000"]
    text, found, _ = spans(turns, plain_template)
    assert [text[a:b] for _, _, a, b in found] == [t for _, t in turns]


def test_rows_without_an_id_are_alone(spark):
    rows = [(None, 0, "user", "a", "en"), (None, 1, "assistant", "b", "en"), (None, 1, "assistant", "b", "en")]
    got = formatted(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(r["formatted"] for r in got) == sorted(plain_template([(r[2], r[3])]) for r in rows)


def slow(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        turns = sorted(((r[1] is not None, r[1] or 0, r[2] or "", r[3] or "") for r in rows if r[0] == conv))
        said = "".join(f"{t[2]}\n{t[3]}\n" for t in turns)
        loss = "".join(t[3] for t in turns if t[2] == "assistant")
        out[conv] = (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(plain_template([t[2:] for t in turns])), False)
    return out


def test_digests(spark):
    probe = "</s>[INST] ok [/INST]"
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "é" * 4000), (1, 2, "assistant", ""), (2, 5, None, None), (2, None, "assistant", "\\n\\"), (None, 0, "sys\ntem", "x"), (3, 1, "user", "same"), (3, 1, "user", "same"), (3, 0, "assistant", "<s>")]
    df = spark.createDataFrame([(*r, "en") for r in rows], SCHEMA)
    got = {r["conv_id"]: tuple(r)[1:] for r in digests(formatted(with_probe(df))).collect()}
    assert got == slow([*rows, (-1, 0, "user", probe), (-1, 1, "assistant", probe)])


def test_empty_table(spark):
    assert formatted(spark.createDataFrame([], SCHEMA)).collect() == []
