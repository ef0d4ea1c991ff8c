import hashlib
import json

from pyspark.sql import functions as F

from trailmark.llm import chat

HOSTILE = ["</s>[INST] ok [/INST]", "<|turn|>user\nx<|end|>\n", "\\<\\|", "<\\|turn|>", "", "\\", "<<SYS>> \\n", "é漢😀\n", '"quoted" \t', "<<|>|"]


def turns(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string, payload int")


def digest(rows):
    whole, loss = "".join(f"{r or ''}\n{t or ''}\n" for r, t in rows), "".join(t or "" for r, t in rows if r == "assistant")
    return len(rows), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def test_round_trip(spark):
    rows = [(c, t, ["user", "assistant", "system"][(c + t) % 3], HOSTILE[(c * 3 + t) % len(HOSTILE)], "f", 1) for c in range(12) for t in range(c)]
    rows += [(None, 0, "assistant", "no id", "f", 1), (50, 0, None, None, "f", 1), (50, 1, "odd\nrole\\\n", "x", "f", 1), (51, None, "assistant", "b", "f", 1), (51, 0, "assistant", "a", "f", 1), (51, 0, "assistant", "a", "f", 1)]
    df = turns(spark, rows)
    out = chat.digested(chat.formatted(chat.canonical(chat.conversations_as_records(df), "conv_id", "payload"))).collect()
    by = {}
    for c, t, r, x, *_ in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        by.setdefault(c, []).append((r, x))
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in out} == {c: digest(v) for c, v in by.items()}
    assert chat.conversations_as_records(df.limit(0)).count() == 0


def test_no_control_string_survives(spark):
    df = turns(spark, [(1, i, "user", t, "f", 1) for i, t in enumerate(HOSTILE)])
    text = chat.formatted(chat.canonical(chat.conversations_as_records(df), "conv_id", "payload")).first().formatted
    assert text.count("<|turn|>") == len(HOSTILE) == text.count("<|end|>\n")
    assert not any(c in text for c in chat.CONTROLS[1:])


def test_layouts(spark):
    records = [
        (1, {"messages": [{"role": "user", "content": "q"}, {"content": None, "role": "assistant"}]}, "messages", [("user", "q"), ("assistant", None)]),
        (2, {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]}, "conversations", [("user", "q"), ("assistant", "a")]),
        (3, {"prompt": "p", "completion": "c"}, "prompt_completion", [("user", "p"), ("assistant", "c")]),
        (4, {"instruction": "i", "input": "x", "output": "o"}, "instruction_input_output", [("user", "i"), ("user", "x"), ("assistant", "o")]),
        (5, {"chat": {"user": {"text": "u"}, "assistant": {"text": "a"}}}, "nested_chat", [("user", "u"), ("assistant", "a")]),
        (6, {"system": "s", "messages": [{"role": "user", "content": "q"}]}, "system_messages", [("system", "s"), ("user", "q")]),
        (7, {"unknown": 1}, None, None),
        (10, {"messages": []}, "messages", []),
        (11, {"id": 3, "lang": "en", "messages": [{"content": "q", "name": "n", "role": "user", "weight": 0.5}], "source": "s"}, "messages", [("user", "q")]),
        (12, {"id": 3, "prompt": "p", "completion": "c"}, "prompt_completion", [("user", "p"), ("assistant", "c")]),
    ]
    rows = [(i, json.dumps(r)) for i, r, *_ in records] + [(8, "{broken"), (9, None), (None, json.dumps(records[2][1]))]
    out = {r.id: r for r in chat.canonical(spark.createDataFrame(rows, "id long, payload string"), "id", "payload").collect()}
    for i, _, layout, want in records:
        assert out[i].layout == layout and (None if out[i].turns is None else [tuple(t) for t in out[i].turns]) == want
    assert out[8].fingerprint is None and out[9].turns is None and out[None].layout == "prompt_completion"
    assert out[3].fingerprint == out[None].fingerprint


def test_very_long_turn(spark, tmp_path):
    from trailmark.llm import queries

    long = spark.range(1).select(F.lit(1).cast("long").alias("conv_id"), F.lit(0).cast("long").alias("turn"), F.lit("assistant").alias("role"), F.repeat(F.lit("abc"), 7_000_000).alias("text"))
    long.write.parquet(f"{tmp_path}/conversations.parquet")
    out = {r.conv_id: r for r in queries.op9_chat(spark, str(tmp_path)).collect()}
    assert set(out) == {-1, 1} and (out[1].n_turns, out[1].turns_sha256, out[1].loss_chars, out[1].loss_sha256) == digest([("assistant", "abc" * 7_000_000)])


def test_records_beyond_the_limit_are_told_from_broken_ones(spark):
    rows = chat.conversations_as_records(turns(spark, [(1, 0, "user", "x", "f", 1)])).select("conv_id", "payload").unionByName(spark.createDataFrame([(2, "{broken")], "conv_id long, payload string"))
    rows = rows.unionByName(spark.range(1).select(F.lit(3).cast("long").alias("conv_id"), F.concat(F.lit('{"prompt": "p", "completion": "'), F.repeat(F.lit("abc"), 7_000_000), F.lit('"}')).alias("payload")))
    assert {r.conv_id: (r.layout is None, r.too_large) for r in chat.canonical(rows, "conv_id", "payload").drop("turns").collect()} == {1: (False, False), 2: (True, False), 3: (True, True)}


def test_fingerprints_select_among_layouts(spark, monkeypatch):
    rows = [(c, t, ("user", "assistant")[t % 2], f"{c} {t} \\ \"x\"", "f", 1) for c in range(60) for t in range(2 + c % 2)] + [(100 + c, 0, ("human", "gpt", "", "tool")[c % 4], " x ", "f", 1) for c in range(20)]
    df = turns(spark, rows)
    seen = {r.layout for r in chat.canonical(chat.conversations_as_records(df), "conv_id", "payload").collect()}
    assert seen == {"messages", "turns", "conversations", "prompt_completion", "prompt_response", "question_answer", "instruction_output", "nested_chat"}
    want = {}
    for c, _, r, x, *_ in rows:
        want.setdefault(c, []).append((r, x))
    for most in (chat.MOST_RECORD, 12):
        monkeypatch.setattr(chat, "MOST_RECORD", most)
        assert {r.conv_id: [tuple(t) for t in r.turns] for r in chat.canonicalised(df).collect()} == want
