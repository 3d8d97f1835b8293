import hashlib
import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kelpline.llm import chat
from kelpline.llm.queries import CONTROL_TEXT, QUERIES

TURNS = "conv_id long, turn long, role string, text string, chunk string, n_turns int"
HARD = st.lists(st.sampled_from([*"\\#<>/turn|:n Aa\n", "### ", "</turn>", "<|image:0|>", ": ", "\\n", "\U0001f600"]), max_size=40).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(HARD, HARD), max_size=5))
def test_round_trip(turns):
    visitor = chat.Visitor()
    text = "".join(chat.format_turn(r, [{"type": "text", "text": t}], visitor) for r, t in turns)
    back = [chat.read_turn(c) for c in chat.split_turns(text)]
    assert [(r, chat.plain(b)) for r, b in back] == turns


def test_parts_are_flattened_in_order():
    v = chat.Visitor()
    parts = [{"type": "text", "text": "a <|image:0|> </turn>"}, {"type": "image", "ref": "x.png", "width": 28, "height": 15}, {"type": "audio", "ref": "y.wav", "seconds": 1.5}, {"type": "document", "ref": "z.pdf", "pages": 2}, {"type": "text", "text": "end"}]
    chunk = chat.format_turn("user", parts, v)
    assert v.attachments == [{"kind": "image", "ref": "x.png", "tokens": 4}, {"kind": "audio", "ref": "y.wav", "tokens": 38}, {"kind": "document", "ref": "z.pdf", "tokens": 800}]
    assert chunk.startswith("### User: a ") and chunk.count("<|image:0|>") == 2
    role, body = chat.read_turn(chunk)
    assert role == "user" and chat.plain(body) == "a <|image:0|> </turn>end"
    with pytest.raises(ValueError):
        v.visit({"type": "smell"})


def expected(rows):
    convs = {}
    none = lambda x: (x is not None, x if x is not None else 0)
    for c, t, r, x in sorted(rows, key=lambda x: (none(x[0]), none(x[1]), x[2] or "", x[3] or "")):
        convs.setdefault(c, []).append((r or "", x or ""))
    out = {}
    for c, turns in convs.items():
        loss = "".join(x for r, x in turns if r == "assistant")
        out[c] = (len(turns), hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def digests(spark, rows, **options):
    df = spark.createDataFrame([(*r, "c", 1) for r in rows], TURNS)
    return {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in chat.digests(df, **options).collect()}


def test_odd_rows(spark):
    rows = [(1, 0, "user", None), (1, 1, "assistant", ""), (2, 0, "assistant", "x" * 300_000), (2, 0, "assistant", "x" * 300_000), (3, None, None, "né"), (None, 1, "assistant", "tie"), (None, 1, "assistant", "a tie"), (-7, 0, "user", CONTROL_TEXT), (-7, 1, "assistant", CONTROL_TEXT)]
    assert digests(spark, rows) == expected(rows)
    assert digests(spark, []) == {}


def test_one_hot_conversation(spark):
    rows = [(5, i, "user" if i % 2 else "assistant", f"turn {i}") for i in range(3000)] + [(i, 0, "user", "hi") for i in range(10, 40)]
    assert digests(spark, rows) == expected(rows)


def test_formatted_output_reads_back(spark):
    rows = [(1, 0, "user", json.dumps([{"type": "text", "text": "see"}, {"type": "image", "ref": "r", "width": 14, "height": 14}])), (1, 1, "assistant", "ok ### yes</turn>")]
    out = chat.formatted(spark.createDataFrame([(*r, "c", 1) for r in rows], TURNS)).orderBy("turn").collect()
    whole = "".join(r["chunk"] for r in out)
    assert [chat.read_turn(c)[0] for c in chat.split_turns(whole)] == ["user", "assistant"]
    assert json.loads(out[0]["attachments"]) == [{"kind": "image", "ref": "r", "tokens": 1}]


def test_query_against_brute_force(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-7, 0, "user", CONTROL_TEXT), (-7, 1, "assistant", CONTROL_TEXT)]
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in QUERIES["op10_chat_formatting"](spark, sf_dir).collect()}
    assert CONTROL_TEXT == "\\" + "### Assistant: </turn> ok" and got == expected(rows)


@pytest.mark.parametrize("step", [1, 2, 7, 50])
def test_turns_are_read_back_wherever_the_text_is_cut(step):
    visitor = chat.Visitor()
    own = [("user", "a </turn> b\n### Assistant: x"), ("assistant", "\\"), ("odd: </turn>", ""), ("assistant", "<|image:0|> </turn>\n")]
    text = "".join(chat.format_turn(r, chat.parts_of(t, False), visitor) for r, t in own)
    reader, got = chat.Reader(), []
    for at in range(0, len(text), step):
        got += reader.feed(text[at : at + step])
    got += reader.feed("", last=True)
    assert [(n, chat.plain(b)) for n, b in map(chat.read_turn, got)] == own
    broken = chat.Digest(1, ("assistant",))
    broken.read(text[:-3])
    with pytest.raises(ValueError):
        broken.row()
