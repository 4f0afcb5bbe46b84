import hashlib
import random

from corvane.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, state string, loss boolean"


def conversations():
    rng = random.Random(3)
    bits = ["</s>", "<|user|>\n", "[INST]", "&lt;", "&amp;lt;", "&", "<", "é😀", "\n", "", "|>", "&bar;", "x" * 50]
    rows = []
    for c in range(40):
        for k in range(rng.randint(1, 9)):
            rows.append((c, k, rng.choice(["user", "assistant", "system", "assistant", "tool|<x>", None]), None if rng.random() < 0.1 else "".join(rng.choice(bits) for _ in range(rng.randint(0, 8))), "s", True))
    rows += [(None, 1, "user", "no conversation", None, None), (7, None, "user", "no turn", None, None), (50, 3, "assistant", "tie b", None, None), (50, 3, "assistant", "tie a", None, None), (50, 3, "assistant", "tie a", None, None), (51, 0, "assistant", "long " * 100_000, None, None)]
    return rows


def test_round_trip(spark):
    rows = conversations()
    got = {r["conv_id"]: r for r in chat.read_back(chat.segments(spark.createDataFrame(rows, SCHEMA).repartition(5))).collect()}
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append(r)
    assert got.keys() == by.keys()
    for conv, own in by.items():
        own.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        turns = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        g = got[conv]
        assert g["n_turns"] == len(own)
        assert g["turns_sha256"] == hashlib.sha256(turns.encode()).hexdigest()
        assert g["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
        assert g["loss_chars"] == len(loss)
        assert g["formatted_chars"] >= len(turns)


def test_machine(spark):
    cases = {1: ["system", "user", "assistant"], 2: ["user", "assistant", "user", "assistant"], 3: ["user"], 4: ["assistant", "user"], 5: ["user", "user", "assistant"], 6: ["system", "assistant"], 7: ["user", "assistant", "tool"]}
    rows = [(c, k, r, "t", None, None) for c, roles in cases.items() for k, r in enumerate(roles)]
    got = {r["conv_id"]: r["valid"] for r in chat.read_back(chat.segments(spark.createDataFrame(rows, SCHEMA))).collect()}
    assert got == {1: True, 2: True, 3: False, 4: False, 5: False, 6: False, 7: False}


def test_segments_join_to_the_text_and_no_control_string_is_inside(spark):
    rows = chat.segments(spark.createDataFrame(conversations(), SCHEMA)).collect()
    for r in rows:
        if r["part"] == 1:
            assert not any(x in r["text"] for x in "<>|[]")
        else:
            assert not r["loss"]


def test_query_has_the_probe(spark, data):
    row = chat.query(spark, f"{data}/sf0.001").where("conv_id = -1").first()
    text = chat.PROBE
    assert row["n_turns"] == 2 and row["loss_chars"] == len(text) and row["valid"]
    assert row["turns_sha256"] == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()


def test_empty(spark):
    assert chat.read_back(chat.segments(spark.createDataFrame([], SCHEMA))).count() == 0
