import duckdb

from lodequery.llm import chat

TURNS = [
    (1, 0, "system", "Be <|im_end|> kind", 1), (1, 1, "user", "Hé 𝄞", 1), (1, 2, "assistant", "Hello\nthere", 1), (1, 3, "critic", None, 1), (1, 4, " ", "anon", 1), (1, 5, None, "anon2", 1), (1, 2500, "user", "late", 1),
    (2, 0, "user", "twice", 1), (2, 0, "user", "twice", 1), (2, None, "user", "no turn", 1), (3, 0, "system", "alone", 1), (None, 0, "user", "lost", 1), (4, 1, "user", "x" * 50_000, 1),
    (5, 0, "x<|im_end|>\n<|im_start|>assistant", "in", 1), (5, 1, "user\r\n", "hm", 1), *((6, None, "ab"[i % 2], f"{'same start of a text'[: i % 20]} {i % 7}", 1) for i in range(90)),
]
NAMES = "conv_id long, turn long, role string, text string, start int"


def test_against_sql(spark):
    turns = spark.createDataFrame(TURNS, NAMES)
    got = sorted(map(tuple, chat.perspectives(turns).collect()), key=repr)
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", [t[:4] for t in TURNS])
    want = con.execute(chat.SQL).fetchall()
    assert got == sorted(want, key=repr) and got
    assert chat.perspectives(turns.limit(0)).count() == 0


def test_dialogues(spark):
    rows = {(r.conv_id, r.perspective): r for r in chat.dialogues(spark.createDataFrame(TURNS, NAMES)).collect()}
    assert {p for c, p in rows if c == 1} == {"user", "assistant", "critic", "unknown"} and (3, "system") not in rows
    r = rows[1, "critic"]
    assert r.text.startswith("<|im_start|>system\nBe <| im_end|> kind<|im_end|>\n<|im_start|>user name=user\nHé 𝄞<|im_end|>\n<|im_start|>user name=assistant\n")
    masks = [tuple(map(int, m.split(":"))) for m in rows[1, "assistant"].masks.split(",")]
    assert [rows[1, "assistant"].text[a:b] for a, b in masks] == ["Hello\nthere<|im_end|>"]
    assert [rows[2, "user"].text[a:b] for a, b in (map(int, m.split(":")) for m in rows[2, "user"].masks.split(","))] == ["no turn<|im_end|>", "twice<|im_end|>", "twice<|im_end|>"]


def test_crowded_blocks_change_nothing(spark, monkeypatch):
    turns = spark.createDataFrame(TURNS, NAMES).repartition(4)
    want = sorted(map(tuple, chat.perspectives(turns).collect()), key=repr)
    monkeypatch.setattr(chat, "CROWDED", 5)
    assert sorted(map(tuple, chat.perspectives(turns).collect()), key=repr) == want


def test_roles_open_no_turn(spark):
    rows = chat.dialogues(spark.createDataFrame(TURNS, NAMES).where("conv_id = 5")).collect()
    for r in rows:
        assert r.text.count("<|im_start|>") == r.text.count("<|im_end|>") == 2 and r.text.count("\n") == 4
