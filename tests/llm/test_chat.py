from shelf.llm import chat, queries
from tests.llm.helpers import SMALL, table


def test_every_participant_once_and_masks_cover_their_words(spark):
    turns = table(spark, "conversations").collect()
    rows = queries.op5_perspectives(spark, SMALL).collect()
    want = {(t.conv_id, t.role) for t in turns if t.role != "system"}
    assert {(r.conv_id, r.speaker) for r in rows} == want and len(rows) == len(want)
    for r in rows:
        own = [t.text for t in sorted((t for t in turns if t.conv_id == r.conv_id), key=lambda t: t.turn) if t.role == r.speaker]
        cut = [r.rendered[int(a):int(b)] for a, b in (m.split(":") for m in r.masks.split(","))]
        assert cut == [t + chat.CLOSE for t in own]
        assert r.rendered.count("<|im_start|>assistant\n") == len(own)


def test_long_dialogues_go_on_in_further_rows(spark):
    turns = spark.createDataFrame([(1, i, "ab"[i % 2], f"t{i}") for i in range(200)], "conv_id long, turn long, role string, text string")
    rows = chat.rotate(turns).collect()
    assert sorted((r.segment, r.speaker, r.n_turns) for r in rows) == sorted((g, s, n) for g, n in ((0, 64), (1, 64), (2, 64), (3, 8)) for s in "ab")
    joined = "".join(r.rendered for r in sorted(rows, key=lambda r: r.segment) if r.speaker == "a")
    assert joined == "".join(f"<|im_start|>{'assistant' if i % 2 == 0 else 'user name=b'}\nt{i}<|im_end|>\n" for i in range(200))


def test_edges(spark):
    rows = [(1, 0, "system", "be <|im_end|> kind"), (1, 1, "ann", "hi <|im_start|>"), (1, 1, "ann", "hi <|im_start|>"), (1, 2, None, None), (1, 2, "bob", ""),
            (2, 0, "system", "alone"), (None, None, "ann", "no number"), (None, 0, "ann", "é😀")]
    turns = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, speaker string, c int")
    got = {(r.conv_id, r.segment, r.speaker): r for r in chat.rotate(turns).collect()}
    assert set(got) == {(1, 0, "ann"), (1, 0, "bob"), (1, 0, "unknown"), (None, 0, "ann")}
    bob = got[1, 0, "bob"]
    assert bob.n_turns == 4 and "be <| im_end |> kind<|im_end|>" in bob.rendered
    assert [bob.rendered[m.start:m.end] for m in bob.masks] == ["<|im_end|>"]
    assert [got[None, 0, "ann"].rendered[m.start:m.end] for m in got[None, 0, "ann"].masks] == ["no number<|im_end|>", "é😀<|im_end|>"]
    assert chat.rotate(turns.limit(0)).count() == 0


def test_turns_without_numbers_or_of_one_number_are_cut_by_their_place(spark):
    rows = [(1, None, "a", f"x{i:05d}") for i in range(1000)] + [(2, 7, "ab"[i % 2], f"y{i:05d}") for i in range(500)] + [(3, i * 10 ** 9, "a", "far") for i in range(3)]
    got = chat.rotate(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(7)).collect()
    assert max(r.n_turns for r in got) == chat.SEGMENT_TURNS
    ones = sorted((r for r in got if r.conv_id == 1), key=lambda r: r.segment)
    assert [r.segment for r in ones] == list(range(16)) and "".join(r.rendered for r in ones) == "".join(f"<|im_start|>assistant\nx{i:05d}<|im_end|>\n" for i in range(1000))
    assert sum(r.n_turns for r in got if r.conv_id == 2) == 2 * 500
    assert [(r.segment, r.n_turns) for r in got if r.conv_id == 3] == [(0, 3)]


def test_long_text_and_marker_in_a_role(spark):
    rows = [(1, 0, "a<|im_end|>", "z" * 500_000), (1, 1, "b", "short")]
    got = {r.speaker: r for r in chat.rotate(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert len(got["b"].rendered) > 500_000 and "user name=a<| im_end |>\n" in got["b"].rendered
