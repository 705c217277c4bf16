from corpusmill.llm import snapshot_collapse as C
from helpers import same_as_sql


def turns(spark, rows):
    return spark.createDataFrame([(*r, 1, 2) for r in rows], "conv_id long, turn long, role string, text string, place int, n int")


ROWS = [
    # 1 is a prefix of 2, 2 of 3; 4 equals 3; 5 shares an opening only; 6 differs in a role
    (1, 0, "user", "hi"), (1, 1, "bot", "hello"),
    (2, 0, "user", "hi"), (2, 1, "bot", "hello"), (2, 2, "user", "how"),
    (3, 0, "user", "hi"), (3, 1, "bot", "hello"), (3, 2, "user", "how"), (3, 3, "bot", "so"),
    (4, 10, "user", "hi"), (4, 20, "bot", "hello"), (4, 30, "user", "how"), (4, 40, "bot", "so"),
    (5, 0, "user", "hi"), (5, 1, "bot", "bye"),
    (6, 0, "user", "hi"), (6, 1, "user", "hello"),
    (7, 0, None, None), (7, None, "user", ""), (8, None, "user", ""),
    (9, 0, "a", "b"), (9, 0, "a", "b"), (10, 0, "a", "b"),  # a repeated row is a turn of its own
]


def test_keeps_maximal_conversations(spark):
    t = turns(spark, ROWS)
    got = C.collapse(t)
    assert {r.conv_id for r in got.collect()} == {3, 5, 6, 7, 9}
    same_as_sql(got, {"conversations": t.toPandas().astype({"turn": "Int64"})}, C.SQL)
    text = "".join(r.rendered for r in got.where("conv_id = 3").orderBy("place").collect())
    assert text.startswith("<|user|>\nhi<|end|>\n<|bot|>\nhello<|end|>\n")


def test_ranges_of_turns_do_not_change_the_hashes(spark):
    t = turns(spark, [(i % 2, j, "user", f"t{j}") for i in range(2) for j in range(40)] + [(5, j, "user", f"t{j}") for j in range(25)])
    one = {(r.conv_id, r.place): r.prefix for r in C.with_prefix_hashes(t).collect()}
    many = {(r.conv_id, r.place): r.prefix for r in C.with_prefix_hashes(t, per_range=7).collect()}
    assert one == many and one[0, 25] == one[5, 25] != one[5, 24]


def test_null_conversation_and_empty(spark):
    got = C.collapse(turns(spark, [(None, 0, "u", "x"), (None, 1, "u", "y"), (1, 0, "u", "x")]))
    assert [(r.conv_id, r.place) for r in got.orderBy("place").collect()] == [(None, 1), (None, 2)]
    assert C.collapse(turns(spark, ROWS).limit(0)).count() == 0
