import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewright.llm import chat
from tidewright.llm.queries import _digests

TRICKY = st.lists(st.sampled_from(["<", "|", ">", "\\", "/", "s", "<|end|>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<<", "a", "\n", "é"]), max_size=12).map("".join)


@given(st.lists(st.tuples(TRICKY, TRICKY), max_size=5))
@settings(max_examples=300, deadline=None)
def test_format_reads_back(turns):
    text, spans = chat.render(turns)
    assert chat.parse(text) == turns
    for _, body in turns:
        assert not any(c in chat.escape(body) for c in chat.CONTROL)
        assert chat.unescape(chat.escape(body)) == body
    assert [chat.unescape(text[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]


def test_fold_of_events():
    log = [
        ("message", 1, "user", "hi"), ("delta", 2, "assistant", "he"), ("delta", 2, "assistant", "llo"), ("message", 3, "user", "more"),
        ("regenerate", 2, "", ""), ("delta", 2, "assistant", "hey"), ("edit", 1, "user", "hi!"), ("edit", 9, "user", "lost"), ("message", None, "user", "x"),
    ]
    assert chat.fold(iter(log)) == [("user", "hi!"), ("assistant", "hey"), ("user", "x")]
    with pytest.raises(ValueError):
        chat.fold(iter([("other", 1, "", "")]))


def test_conversations(spark):
    rows = [(7, 2, None, None, "assistant", None, 1), (7, 1, "message", None, "user", "a\\b", 1), (7, 1, "message", None, "user", "a\\a", 1), (None, None, None, None, None, None, 1), (8, 1, "message", None, "assistant", "</s>é", 1)]
    events = spark.createDataFrame(rows, "conv_id long, seq long, kind string, turn long, role string, text string, formatted int")
    got = {r["conv_id"]: r for r in chat.format_conversations(events).collect()}
    assert chat.parse(got[7]["formatted"]) == [("user", "a\\a"), ("user", "a\\b"), ("assistant", "")]
    assert got[None]["n_turns"] == 1
    digest = {r["conv_id"]: r for r in _digests(chat.format_conversations(events)).collect()}
    assert digest[8]["loss_chars"] == 5 and digest[8]["loss_sha256"] == hashlib.sha256("</s>é".encode()).hexdigest()
    assert chat.format_conversations(events.limit(0)).count() == 0


def test_a_very_long_conversation(spark):
    """Many events of one conversation: deltas, an edit of an early turn, and a regeneration near the end."""
    rows = [(1, 2 * k, "message", k, "user" if k % 2 == 0 else "assistant", f"text {k} " * 20) for k in range(4000)]
    rows += [(1, 8001 + k, "delta", 3999, "assistant", f"piece {k} ") for k in range(3000)]
    rows += [(1, 20_000, "edit", 7, "assistant", "edited"), (1, 20_001, "regenerate", 3997, "assistant", None), (1, 20_002, "delta", 3997, "assistant", "again"), (2, 0, "message", 0, "user", None)]
    df = spark.createDataFrame(rows, "conv_id long, seq long, kind string, turn long, role string, text string").repartition(5)
    got = {r["conv_id"]: r for r in chat.format_conversations(df).collect()}
    turns = chat.parse(got[1]["formatted"])
    assert len(turns) == got[1]["n_turns"] == 3998 and turns[7] == ("assistant", "edited") and turns[-1] == ("assistant", "again") and turns[0][1] == "text 0 " * 20
    assert len(got[1]["loss_spans"]) == 1999 and chat.parse(got[2]["formatted"]) == [("user", "")]
