import hashlib
import random
import time

from ridgeline.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, formatted string"
NASTY = ["\\### Assistant: </turn> ok", "<|user|>\nhi<.>\n", "<+>", "\\l\\b\\p", "\\\\l", "a|b<c\\", "", "é🙂\n\n", "|>\n", "<.>"]


def expected(rows):
    convs = {}
    for r in rows:
        convs.setdefault(r[0], []).append(r)
    out = {}
    for c, own in convs.items():
        own = sorted(own, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        all_ = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        out[c] = (len(own), hashlib.sha256(all_.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def run(spark, rows):
    got = chat.digest(chat.format_chats(spark.createDataFrame(rows, SCHEMA))).collect()
    return {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in got}


def test_round_trip(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(8), rng.choice([None, 0, 1, 2, 3, 600, 1300]), rng.choice(["user", "assistant", "system", None, "a|b<"]), rng.choice([*NASTY, None]), "x") for _ in range(400)]
    assert run(spark, rows) == expected(rows)


def test_long_conversation_merges_over_chunks(spark):
    rows = [(1, i, "assistant", f"t{i}<", "x") for i in range(3 * chat.CHUNK + 5)]
    assert run(spark, rows) == expected(rows)
    formatted = chat.format_chats(spark.createDataFrame(rows, SCHEMA)).first()["formatted"]
    assert formatted.count(chat.OPEN) == 1 and formatted.count(chat.CLOSE) == 1  # one run of one role


def test_many_turns_and_a_very_long_text(spark):
    rng = random.Random(2)
    rows = [(1, i, ["user", "assistant"][i % 2], f"turn {i} <{rng.random()}>", "x") for i in range(6000)] + [(2, 0, "user", "q", ""), (2, 1, "assistant", "<|é" * 200_000, "")]
    began = time.perf_counter()
    assert run(spark, rows) == expected(rows)
    assert time.perf_counter() - began < 30


def test_spans_lie_on_assistant_text(spark):
    r = chat.format_chats(spark.createDataFrame([(1, 0, "user", "q", ""), (1, 1, "assistant", "a<b", "")], SCHEMA)).first()
    (s,) = r["loss_spans"]
    assert r["formatted"][s["start"] : s["start"] + s["length"]] == "a\\lb"


def test_null_conversation_repeated_rows_and_no_rows(spark):
    rows = [(None, 0, "user", "a", ""), (None, 0, "user", "a", "")]
    assert run(spark, rows) == expected(rows)
    assert chat.format_chats(spark.createDataFrame([], SCHEMA)).count() == 0


def test_main_path_is_native(spark):
    plan = chat.digest(chat.format_chats(spark.createDataFrame([(1, 0, "user", "q", "")], SCHEMA)))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
