import hashlib

from barloom.llm import catalog, chat

HARD = ["</s>[INST] ok [/INST]", "a\\b", "<\\s>", "\\<s>\\", "<<ROLE>>", "<", "</s", "", "[[INST]]\\\\", "x" * 1200 + "é😀<s>" * 90]


def test_escape_is_reversible_and_hides_control_strings():
    for t in HARD + ["".join(p) for p in zip(HARD, HARD[1:], strict=False)]:
        assert chat.unescape(chat.escape(t)) == t
        assert not any(c in chat.escape(t) for c in chat.CONTROL)


def test_turns_and_loss_read_back(spark):
    rows = [(c, t, role, HARD[(c + t) % len(HARD)], "clash", i) for i, (c, t, role) in enumerate((c, t, ["system", "user", "assistant", "to</s>ol\n"][t % 4]) for c in range(12) for t in range(9))]
    rows += [(50, 0, None, None, "", 0), (50, 0, "assistant", "tie", "", 0), (50, 0, "assistant", "tie", "", 0), (50, None, "user", "first", "", 0), (None, 1, "assistant", "no id", "", 0)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, seq string, message long").repartition(6)
    out = {r.conv_id: r for r in catalog.chat_digests(chat.formatted(df)).collect()}
    for c in {r[0] for r in rows}:
        if c == 50:
            turns = [("user", "first"), ("", ""), ("assistant", "tie"), ("assistant", "tie")]
        else:
            turns = [(r[2], r[3]) for r in sorted((r for r in rows if r[0] == c), key=lambda r: r[1])]
        learnt = "".join(t for r, t in turns if r == "assistant")
        assert out[c].n_turns == len(turns)
        assert out[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert (out[c].loss_chars, out[c].loss_sha256) == (len(learnt), hashlib.sha256(learnt.encode()).hexdigest())
    assert chat.formatted(spark.createDataFrame([], df.schema)).collect() == []


def test_events_fold_into_final_messages(spark):
    log = [
        (1, 0, 10, "message", "user", "Hi"), (1, 1, 11, "delta", "assistant", "Hel"), (1, 2, 11, "delta", "assistant", "lo"), (1, 3, 12, "message", "user", "More?"),
        (1, 4, 10, "edit", "user", "Hi!"), (1, 5, 11, "regenerate", "assistant", ""), (1, 6, 11, "delta", "assistant", "Good "), (1, 7, 11, "delta", "assistant", "day"),
    ]
    df = spark.createDataFrame(log[::-1], "conv_id long, seq long, message long, kind string, role string, text string")
    row = chat.formatted_log(df).first()
    assert chat.parse(row.formatted) == [("user", "Hi!"), ("assistant", "Good day")]
    assert [row.formatted[s.start : s.stop] for s in row.loss] == ["Good day"]


def test_rows_without_a_conversation_stay_alone(spark):
    rows = [(None, i, "assistant", f"t{i % 3}") for i in range(9)] + [(4, 0, "user", "q")]
    out = chat.formatted(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert sorted(chat.parse(r.formatted) for r in out if r.conv_id is None) == sorted([("assistant", f"t{i % 3}")] for i in range(9)) and len(out) == 10
