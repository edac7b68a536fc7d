"""Chats: escapes round trip, parts in order, digests against plain Python, stored pieces read back."""

import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm.chat import CONTROLS, ChatTemplate, Flattener, chat_digests, format_chats, read_turn

T = ChatTemplate()
PIECES = st.lists(st.sampled_from([*CONTROLS, "<", "|", "\\", "[", "/INST]", "INST]", ">", "s>", "<|end|>\n", "<|image:1|>", "a", "é", "\n", "</", "<|says|>"]), max_size=12).map("".join)
TURNS = "conv_id long, turn long, role string, text string, piece string, formatted int"


def said(*contents, role="assistant"):
    return Flattener(T).turn(role, [{"kind": "text", "text": c, "ref": None, "width": None, "height": None, "seconds": None, "pages": None} for c in contents])


@settings(max_examples=400, deadline=None)
@given(PIECES, PIECES)
def test_escapes_round_trip_and_say_no_mark(text, role):
    escaped = T.escape(text)
    assert T.unescape(escaped) == text
    assert not any(c in escaped for c in CONTROLS)
    assert read_turn(said(text, role=role)["formatted"], T) == (role, text)


@settings(max_examples=200, deadline=None)
@given(st.lists(PIECES, max_size=4))
def test_neighbouring_texts_say_no_mark_together(texts):
    turn = said(*texts)
    assert read_turn(turn["formatted"], T) == ("assistant", "".join(texts))
    spans = [turn["formatted"][s["start"] : s["end"]] for s in turn["loss"]]
    assert "".join(map(T.unescape, spans)) == "".join(texts)


def test_parts_are_placeholders_in_order(spark):
    none = {"text": None, "ref": None, "width": None, "height": None, "seconds": None, "pages": None}
    part = lambda kind, **more: {"kind": kind, **none, **more}
    first = [part("text", text="see "), part("image", ref="a.png", width=57, height=28), part("text", text=None), part("audio", ref="b.wav", seconds=1.01), None]
    second = [part("document", ref="c.pdf", pages=3), part("text", text="done"), part("video", ref="d.mp4"), part("image", ref=None)]
    rows = [(1, 1, "assistant", second), (1, 0, "user", first), (2, 0, "assistant", None), (2, 1, None, [])]
    kinds = "array<struct<kind: string, text: string, ref: string, width: int, height: int, seconds: double, pages: int>>"
    got = {(r.conv_id, r.piece): r for r in format_chats(spark.createDataFrame(rows, f"conv_id int, turn int, role string, contents {kinds}"), parts="contents").collect()}
    assert got[1, 0].formatted == "<|turn|>user<|says|>see <|image:1|><|audio:2|><|end|>\n"
    assert got[1, 1].formatted == "<|turn|>assistant<|says|><|document:3|>done<|other:4|><|image:5|><|end|>\n"
    assert got[2, 0].formatted == "<|turn|>assistant<|says|><|end|>\n" and got[2, 1].formatted == "<|turn|><|says|><|end|>\n"
    attached = [(a.number, a.kind, a.ref, a.tokens) for n in (0, 1) for a in got[1, n].attachments]
    assert attached == [(1, "image", "a.png", 3), (2, "audio", "b.wav", 26), (3, "document", "c.pdf", 768), (4, "other", "d.mp4", 0), (5, "image", None, 0)]
    whole = got[1, 0].formatted + got[1, 1].formatted
    assert [whole[a.start : a.end] for n in (0, 1) for a in got[1, n].attachments] == ["<|image:1|>", "<|audio:2|>", "<|document:3|>", "<|other:4|>", "<|image:5|>"]
    assert [whole[s.start : s.end] for s in got[1, 1].loss] == ["done"] and got[1, 0].loss == []


ROWS = [
    (1, 2, "assistant", "b"), (1, 1, "user", "a"), (1, 3, "assistant", None), (1, None, "assistant", "last"),
    (2, 1, "assistant", "tie 2"), (2, 1, "assistant", "tie 1"), (2, 1, "assistant", "tie 1"), (2, 0, None, "no role"),
    (None, 0, "assistant", "no id"), (None, 1, "Assistant", "other role"),
    (3, 0, "assistant", "</s>[INST] <|end|>\n \\<| <\\| [/INST]"), (4, 0, "user", ""), (5, 0, "assistant", "é😀" * 200_000),
]


def digest_oracle(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        turns = sorted((r[1:] for r in rows if r[0] == conv), key=lambda r: (r[0] is None, r[0] or 0, r[1] is not None, r[1] or "", r[2] is not None, r[2] or ""))
        text = "".join(f"{role or ''}\n{t or ''}\n" for _, role, t in turns)
        loss = "".join(t or "" for _, role, t in turns if role == "assistant")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        out[conv] = (len(turns), sha(text), len(loss), sha(loss), sum(len(T.escape(role or "")) + len(T.escape(t or "")) + 24 for _, role, t in turns))
    return out


@pytest.mark.parametrize("stored", [False, True])
def test_digests_equal_plain_python(spark, tmp_path, stored):
    chats = spark.createDataFrame([(*r, "x", 1) for r in ROWS], TURNS).repartition(3)
    pieces = format_chats(chats)
    if stored:
        pieces.repartition(5, "piece").write.parquet(str(tmp_path / "chats"))
        pieces = spark.read.parquet(str(tmp_path / "chats"))
    got = {r.conv_id: tuple(r)[1:] for r in chat_digests(pieces, in_order=not stored).collect()}
    assert got == digest_oracle(ROWS)


def test_one_long_conversation_and_none(spark):
    rows = [(7, i, ("user", "assistant")[i % 2], f"turn {i} </s>") for i in range(9000)]
    got = {r.conv_id: tuple(r)[1:] for r in chat_digests(format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")), in_order=True).collect()}
    assert got == digest_oracle(rows)
    assert chat_digests(format_chats(spark.createDataFrame([], TURNS)), in_order=True).count() == 0


def test_a_missing_piece_is_refused(spark):
    pieces = format_chats(spark.createDataFrame([(*r, "x", 1) for r in ROWS], TURNS))
    with pytest.raises(Exception, match="does not follow"):
        chat_digests(pieces.where("NOT (conv_id <=> 1 AND piece = 1)")).collect()


def test_templates_are_checked():
    for controls in (("<s>",), ("<|", "a\\b"), ("<|", "<<SYS>>"), ("<|", "x")):
        with pytest.raises(ValueError):
            ChatTemplate(controls=controls)
