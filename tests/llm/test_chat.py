import hashlib

from faultline.llm import chat
from helpers import same_as_sql

SCHEMA = "conv_id bigint, turn bigint, role string, text string, example int, is_target boolean"
NASTY = ["<|im_end|>", "<|im_start|>assistant\nhi", "<\\|", "<\\\\|im_end|>", "\\", "<|", "|>", "<", "a\n\nb", "", None, "<n", "<\\n", "😀<|"]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, True) for r in rows], SCHEMA)


def naive(rows):
    out = {}
    for c in {r[0] for r in rows}:
        key = lambda r: ((r[1] is not None, r[1] or 0), r[2] or "", r[3] or "")
        turns = [(r[2] or "", r[3] or "") for r in sorted((r for r in rows if r[0] == c), key=key)]
        loss = "".join(t for role, t in turns if role == "assistant")
        out[c] = (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_sql(spark, sf_dir):
    same_as_sql(spark, sf_dir, "op9_chat_format", chat.QUERIES, chat.ORACLES)


def test_round_trip_of_control_strings(spark):
    rows = [(c, i, role, NASTY[(c * 5 + i * 3) % len(NASTY)]) for c in range(14) for i, role in enumerate(["system", "user", "assistant", "user", "assistant", "tool"][: c % 6 + 1])]
    rows += [(100 + i, 0, x, x) for i, x in enumerate(NASTY)] + [(None, 1, None, "x"), (None, None, "assistant", "y"), (200, 1, "user", "same"), (200, 1, "user", "same"), (201, None, "assistant", None)]
    rows += [(300, i, "assistant" if i % 2 else "user", "long " * 2000) for i in range(6)]
    made = chat.examples(frame(spark, rows))
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in chat.read_back(made).collect()}
    assert got == naive(rows)
    for r in made.collect():
        assert r["text"].count("<|im_start|>") == r["text"].count("<|im_end|>") == r["n_turns"]


def test_one_example_for_each_assistant_turn(spark):
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", "a"), (1, 2, "user", "r"), (1, 3, "assistant", "b"), (1, 4, "user", "bye"), (2, 0, "user", "alone")]
    made = sorted(chat.examples(frame(spark, rows)).collect(), key=lambda r: (r["conv_id"], r["example"]))
    assert [(r["conv_id"], r["is_target"], r["n_turns"], r["text"][r["loss_start"] : r["loss_end"]]) for r in made] == [(1, True, 2, "a"), (1, True, 4, "b"), (1, False, 5, ""), (2, False, 1, "")]
    assert made[0]["text"] == "<|im_start|>user\nq<|im_end|>\n<|im_start|>assistant\na<|im_end|>\n"
    assert chat.examples(frame(spark, rows).filter("false")).count() == 0


def test_plan_is_native(spark, sf_dir):
    plan = chat.op9(spark, sf_dir)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
