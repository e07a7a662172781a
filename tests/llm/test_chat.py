from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shelfspark.llm import chat

BITS = ["\\", "###", "#", "</turn>", "\n", "</turn", ">", "n", " ", "é", "### Assistant:", "$1", "ok", "😀", ":\n", "\x00", "\x01"]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "a:\nb", "\\n", "", "</turn>", "\x00\\"]), st.lists(st.sampled_from(BITS), max_size=8).map("".join)), min_size=1, max_size=5), min_size=1, max_size=12))
def test_round_trip(spark, conversations):
    rows = [(c, k, role, text) for c, turns in enumerate(conversations) for k, (role, text) in enumerate(turns)]
    made = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    read = made.select("conv_id", chat.parse(F.col("formatted")).alias("turns"), "segments").collect()
    for r in read:
        turns = conversations[r.conv_id]
        assert [(t.role, t.text) for t in r.turns] == turns
        assert sum(s.loss for s in r.segments) == sum(role == "assistant" for role, _ in turns)


def test_machine_and_edges(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "u"), (1, 2, "assistant", "a")]
    rows += [(2, 0, "user", "u"), (2, 1, "user", "v"), (3, 0, "assistant", None), (4, 0, "user", "u"), (5, None, None, None)]
    rows += [(None, 1, "assistant", "b"), (None, 0, "user", "c"), (6, 2, "assistant", "late"), (6, 1, "user", "x" * 1_000_000), (7, 0, "user", "u"), (7, 0, "user", "u")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, segments int")
    got = {r.conv_id: r for r in chat.op6(df).collect()}
    assert {k: (r.valid, r.error_turn) for k, r in got.items()} == {1: (True, None), 2: (False, 1), 3: (False, 0), 4: (False, None), 5: (False, 0), None: (True, None), 6: (True, None), 7: (False, 1), -7: (True, None)}
    assert got[6].loss_chars == 4 and got[-7].loss_chars == 26 and got[7].n_turns == 2
    assert [r.conv_id for r in chat.op6(df.limit(0)).collect()] == [-7]


def test_native_plan(spark, sf):
    plan = chat.op6(spark.read.parquet(f"{sf}/conversations.parquet"))._jdf.queryExecution().toString()
    assert not [x for x in ("Python", "Pandas", "Arrow") if x in plan]
