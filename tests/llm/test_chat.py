from notegraph.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"

ROWS = [
    (1, 0, "a", "Hello there, how is it going today?\n\nSecond paragraph of the message."),
    (1, 1, "b", "A different remark altogether."),
    (1, 2, "c", "On Monday a wrote:\n> Hello there, how is it   GOING today?\nFine, thank you."),
    (1, 3, "a", "> > Second paragraph of the message.\n> Fine, thank you.\nGood to hear."),
    (1, 4, "b", "> A different remark altogether.\nWas it?"),
    (2, 0, "d", "> Good to hear.\nFrom elsewhere."),
    (2, 1, "d", "> nobody ever said this\nUnknown quote."),
    (3, 0, "e", None),
    (3, 1, "e", "5 > 3 is no quote"),
    (3, 1, "e", "5 > 3 is no quote"),
    (None, 0, "x", "no conversation"),
    (4, None, "y", "> no conversation\nno turn"),
]


def run(spark, rows):
    return chat.conversations(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()


def test_replies_follow_what_they_answer(spark):
    got = run(spark, ROWS)
    assert len(got) == len(ROWS)
    order = sorted((x for x in got if x.thread == 1), key=lambda x: x.position)
    assert [(x.conv_id, x.turn) for x in order] == [(1, 0), (1, 2), (1, 3), (2, 0), (1, 1), (1, 4)]
    assert [x.position for x in order] == list(range(6))
    by = {(x.conv_id, x.turn): x for x in got}
    assert (by[1, 2].reply_conv, by[1, 2].reply_turn, by[1, 2].depth) == (1, 0, 1)
    assert (by[1, 3].reply_turn, by[1, 3].depth, by[1, 3].n_quotes) == (2, 2, 2)
    assert (by[2, 0].thread, by[2, 0].reply_conv, by[2, 0].depth) == (1, 1, 3)
    assert (by[2, 1].thread, by[2, 1].reply_conv, by[2, 1].n_quotes) == (2, None, 1)


def test_quotes_are_left_out(spark):
    by = {(x.conv_id, x.turn): x.text for x in run(spark, ROWS)}
    assert by[1, 2] == "Fine, thank you."
    assert by[1, 3] == "Good to hear."
    assert by[3, 0] == "" and by[3, 1] == "5 > 3 is no quote" and by[4, None] == "no turn"


def test_first_holder_in_the_conversation_comes_first(spark):
    rows = [(1, 0, "a", "Thanks a lot for that."), (2, 0, "a", "Thanks a lot for that."), (2, 1, "b", "> thanks a lot for that.\nWelcome."), (0, 0, "c", "> Thanks a lot for that.\nToo early.")]
    by = {(x.conv_id, x.turn): x for x in run(spark, rows)}
    assert by[2, 1].reply_conv == 2
    assert by[0, 0].reply_conv is None  # an answer comes after what it quotes


def test_plain_conversations_keep_their_order(spark):
    rows = [(c, t, "a", f"text {c} {t}") for c in range(20) for t in range(c % 7 + 1)]
    got = run(spark, rows)
    assert all((x.thread, x.position, x.depth, x.n_quotes) == (x.conv_id, x.turn, 0, 0) for x in got)


def test_long_chains(spark):
    rows = [(1, 0, "a", "start of it all")] + [(1, t, "a", f"> {'start of it all' if t == 1 else f'answer number {t - 1}'}\nanswer number {t}") for t in range(1, 40)]
    got = sorted(run(spark, rows), key=lambda x: x.position)
    assert [x.turn for x in got] == list(range(40)) and [x.depth for x in got] == list(range(40))


def test_against_sql(spark):
    import duckdb
    import pandas as pd

    rows = [x for x in dict(((r[0], r[1]), r) for r in ROWS).values() if x[0] is not None and x[1] is not None]
    rows += [(9, t, "z", f"> answer {t - 1} of nine\n>> deeper\nLe lundi x a écrit :\n> answer {t // 2} of nine\nanswer {t} of nine\n\nmore") for t in range(12)]
    conversations = pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"])
    con = duckdb.connect()
    con.register("conversations", conversations)
    got = con.execute(chat.SQL)
    names = [d[0] for d in got.description]
    want = sorted(tuple(dict(zip(names, r, strict=True))[c] for c in sorted(names)) for r in got.fetchall())
    mine = sorted((tuple(x[c] for c in sorted(names)) for x in run(spark, rows)), key=repr)
    assert mine == sorted(want, key=repr) and any(r[sorted(names).index("depth")] > 3 for r in mine)
