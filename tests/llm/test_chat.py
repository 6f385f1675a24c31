"""Chat formatting: any text survives, digests follow the contract."""

import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusmith.llm import chat, queries

TRICKY = st.lists(st.sampled_from(["\\", "#", "##", "###", "### ", "</turn>", "</", "<", "\n", "a", "Assistant:", "é", "turn>", "\\\\"]), max_size=12).map("".join)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(TRICKY, TRICKY), max_size=5))
def test_round_trip(turns):
    made = [chat.render(r, t) for r, t in turns]
    text = "".join(m[0] for m in made)
    found = chat.parse(text)
    assert [x[:2] for x in found] == turns
    for (rendered, start, end, _), (_, body) in zip(made, turns):
        assert chat.parse(rendered)[0][2:] == (start, end)


def test_plain_text_is_left_alone():
    rendered, start, end, escaped = chat.render("user", "a # b < c \\ d")
    assert escaped == 0 and rendered[start:end] == "a # b < c \\ d"
    for bad in ("### a\nb", "x", "### a\nb</turn>", "### a\nx ### y</turn>\n"):
        with pytest.raises(ValueError):
            chat.parse(bad)


def test_rows(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", "a"), (2, 0, None, None), (None, 0, "assistant", "z"), (1, 1, "assistant", "b"), (3, None, "user", "x"), (3, 0, "assistant", "</turn>")]
    table = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, rendered string")
    found = {r.conv_id: r for r in chat.read_back(chat.format_turns(table)).collect()}
    assert set(found) == {1, 2, 3, None}
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert found[1].n_turns == 3 and found[1].turns_sha256 == digest("user\na\nassistant\nb\nassistant\nb\n") and found[1].loss_sha256 == digest("bb") and found[1].loss_chars == 2
    assert found[2].turns_sha256 == digest("\n\n") and found[2].loss_chars == 0
    assert found[3].turns_sha256 == digest("user\nx\nassistant\n</turn>\n") and found[3].loss_sha256 == digest("</turn>")
    assert chat.read_back(chat.format_turns(table.limit(0))).count() == 0


def test_query_adds_a_conversation(spark, sf_dir):
    r = queries.op7_chat(spark, sf_dir).where("conv_id = -7").collect()
    text = queries.ADDED_TEXT
    assert len(r) == 1 and r[0].turns_sha256 == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest() and r[0].loss_chars == len(text)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "### x"]), TRICKY), max_size=5), st.data())
def test_reading_by_mask_and_in_pieces(turns, data):
    """Digests come from the joined text and the mask, wherever the text is broken between turns' pieces."""
    made = [chat.render(r, t) for r, t in turns]
    reader = chat.Reader(1)
    for (rendered, start, end, _), (role, _) in zip(made, turns):
        at = data.draw(st.integers(0, len(rendered)))
        reader.feed(rendered[:at], [])
        reader.feed(rendered[at:], [])
        if role == "assistant":  # the mask's span, as a piece has it
            text = chat.unescape(rendered[start:end])
            reader.loss.update(text.encode())
            reader.loss_chars += len(text)
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    loss = "".join(t for r, t in turns if r == "assistant")
    assert reader.close() == (1, len(turns), digest("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), digest(loss), sum(len(m[0]) for m in made))


def test_the_mask_decides(spark):
    """Only what the mask covers is in the loss text, whatever the roles say."""
    table = spark.createDataFrame([(1, 0, "user", "q \\###"), (1, 1, "assistant", "a")], "conv_id long, turn long, role string, text string")
    from pyspark.sql import functions as F

    turned = chat.format_turns(table).withColumn("in_loss", ~F.col("in_loss"))
    found = chat.read_back(turned).first()
    assert found.loss_chars == 6 and found.loss_sha256 == hashlib.sha256(b"q \\###").hexdigest()


def test_long_texts_take_time_in_proportion():
    import time

    took = []
    for n in (300_000, 1_200_000):
        start = time.perf_counter()
        text = "a # b " * (n // 6) + "</turn>"
        rendered, a, b, _ = chat.render("user", text)
        assert chat.parse(rendered)[0][1] == text == chat.unescape(rendered[a:b])
        took.append(time.perf_counter() - start)
    assert took[1] < 8 * took[0] + 1
