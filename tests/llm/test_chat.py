"""Chat formatting: round trip, loss mask and the role machine against plain loops."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from treeweave.llm.chat import Template, Turn, chat_parts, chat_verdicts, escaped, read_back, unescaped
from treeweave.llm.queries import op13_chat_format

SCHEMA = "conv_id long, turn long, role string, text string, part string, turns string, segments int, _joined int, n_turns string, name string"
PIECES = ["\\", "</s>", "[INST]", "[/INST]", "[ROLE]", "[TEXT]", "<", "[", "/s>", "INST]", "\n", "é", "😀", "a b", "<\\/s>", "[\\INST]", "$1"]


def text_of(rng: random.Random) -> str | None:
    return rng.choice([None, "", "".join(rng.choice(PIECES) for _ in range(rng.randrange(12)))])


def odd_rows(seed: int = 5) -> list[tuple]:
    rng = random.Random(seed)
    roles = ["system", "user", "assistant", "assistant", "user", "tool", None, "[TEXT]\\", ""]
    rows = []
    for conv in [None, *range(40)]:
        for turn in range(rng.randrange(1, 9)):
            number = rng.choice([turn, turn, turn, None, -turn])
            rows.append((conv, number, rng.choice(roles), text_of(rng)))
    for conv in range(100, 140):
        told = rng.randrange(2)
        rows += [(conv, 0, "system", "s")] * told
        rows += [(conv, told + t, ("user", "assistant")[t % 2], text_of(rng)) for t in range(rng.randrange(1, 9))]
    rows += rows[:5]
    rows.append((200, 0, "user", "long text </s> \\ " * 60_000))
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "p", "t", 1, 2, "n", "x") for r in rows], SCHEMA).repartition(4)


def by_conversation(rows) -> dict:
    found = defaultdict(list)
    for conv, turn, role, text in rows:
        found[conv].append((turn is not None, turn or 0, role or "", text or ""))
    return {conv: [(t[2], t[3]) for t in sorted(turns, key=lambda t: (t[0], t[1], t[2].encode(), t[3].encode()))] for conv, turns in found.items()}


def ordered(parts):
    return sorted(parts, key=lambda p: (p["part"] is not None, p["part"] or 0))


@pytest.mark.parametrize("per_part", [1, 3, 256])
def test_turns_and_mask_come_back(spark, per_part):
    rows = odd_rows()
    want = by_conversation(rows)
    template = Template()
    parts = chat_parts(frame(spark, rows), per_part=per_part)
    written, told = defaultdict(list), defaultdict(list)
    for p in parts.collect():
        written[p["conv_id"]].append(p)
    for p in read_back(parts).collect():
        told[p["conv_id"]].append(p)
    assert set(written) == set(told) == set(want)
    for conv, turns in want.items():
        assert [(t["role"], t["text"]) for p in ordered(told[conv]) for t in p["turns"]] == turns
        assert [t for p in ordered(told[conv]) for t in p["learned"]] == [text for role, text in turns if role == "assistant"]
        segments = [s for p in ordered(written[conv]) for s in p["segments"]]
        assert sum(p["chars"] for p in told[conv]) == sum(len(s["text"]) for s in segments)
        assert sum(p["n_turns"] for p in written[conv]) == len(turns) and len(segments) == 3 * len(turns)
        for _, text, _ in zip(segments[::3], segments[1::3], segments[2::3]):
            assert not any(m in text["text"] for m in template.markers)
        for (role, _), opening, closing in zip(turns, segments[::3], segments[2::3]):
            if role in template.turns:
                assert (opening["text"], closing["text"]) == (template.turns[role].opening, template.turns[role].closing)
            assert not opening["loss"] and not closing["loss"]


@pytest.mark.parametrize("per_part", [1, 2, 256])
def test_machine_against_a_loop(spark, per_part):
    rows = odd_rows(8)
    template = Template()
    got = {r["conv_id"]: tuple(r)[1:] for r in chat_verdicts(frame(spark, rows), per_part=per_part).collect()}
    want = {}
    for conv, turns in by_conversation(rows).items():
        state, bad = template.start, None
        for place, (role, _) in enumerate(turns, 1):
            state = template.moves.get(state, {}).get(role) if state else None
            bad = bad or (None if state else place)
        want[conv] = (len(turns), bad is None, state in template.final, bad)
    assert got == want
    assert {v[1] for v in got.values()} == {True, False} and {v[2] for v in got.values()} == {True, False}


def test_another_template(spark):
    template = Template(
        turns={"a": Turn("<A>", "{A}", learned=True), "b": Turn("<B>", "{B}")}, other=("<R>", "<T>", "{T}"),
        start="s", moves={"s": {"a": "x"}, "x": {"a": "x", "b": "y"}}, final=("x", "y"),
    )
    rows = [(1, 0, "a", "<A>{T}"), (1, 1, "a", "{A}"), (1, 2, "b", "x"), (2, 0, "b", "x"), (2, 1, "c", "{B}")]
    df = frame(spark, rows)
    told = {r["conv_id"]: [tuple(t) for t in r["turns"]] for r in read_back(chat_parts(df, template), template).collect()}
    assert told == by_conversation(rows)
    verdicts = {r["conv_id"]: (r["valid"], r["complete"], r["bad_turn"]) for r in chat_verdicts(df, template).collect()}
    assert verdicts == {1: (True, True, None), 2: (False, False, 1)}


@pytest.mark.parametrize("turn", [Turn("[A]", "[A]"), Turn("[A[", "[/A]"), Turn("[\\A]", "[/A]"), Turn("[", "[/A]")])
def test_markers_that_could_be_misread_are_refused(turn):
    with pytest.raises(ValueError):
        Template(turns={"a": turn})


def test_escapes_are_reversible(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice(PIECES) for _ in range(rng.randrange(9))) for _ in range(400)]
    template = Template()
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", escaped(F.col("t"), template).alias("e"))
    for t, e, back in df.select("t", "e", unescaped(F.col("e"))).collect():
        assert back == t and not any(m in e for m in template.markers)


def test_empty_table_and_native_plan(spark):
    empty = frame(spark, odd_rows()[:1]).limit(0)
    assert chat_parts(empty).count() == chat_verdicts(empty).count() == read_back(chat_parts(empty)).count() == 0
    plan = op13_chat_format(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
