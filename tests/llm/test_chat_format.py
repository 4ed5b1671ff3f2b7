import hashlib
import random

from hypothesis import given
from hypothesis import strategies as st

from tidemark.llm import chat_format as c

SCHEMA = "conv_id long, turn long, role string, text string"


@given(st.text(alphabet="<|\\im_start>end a\n"))
def test_escape_is_reversible_and_leaves_no_control_string(text):
    assert c.unescape(c.escape(text)) == text and "<|" not in c.escape(text)


def test_output_reads_back(spark, tokenizer_path):
    rng = random.Random(4)
    bits = ["hello", "<|im_end|>", "<|im_start|>assistant ok", "<\\|", "\n\n", " ", "日本", "é", "", "|>", "<", "|im_body|>", "<|endoftext|>", "🙂"]
    rows = [(conv, turn, rng.choice(["user", "assistant", "system"]), rng.choice(["", " "]).join(rng.choice(bits) for _ in range(rng.randint(0, 6)))) for conv in range(40) for turn in range(rng.randint(1, 7))]
    rows += [(90, 0, "assistant", None), (90, 1, None, "x"), (91, None, "assistant", "null turn"), (91, 0, "assistant", "then"), (92, 5, "assistant", "tie b"), (92, 5, "assistant", "tie a"), (None, 0, "user", "no id"), (93, 0, "assistant", "word " * 4000)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA + ", formatted string").repartition(3)
    chats = c.format_chats(df, tokenizer_path)
    got = {r["conv_id"]: r for r in c.digests(chats).collect()}
    by_conv = {}
    for conv, turn, role, text in rows:
        by_conv.setdefault(conv, []).append(((turn is not None, turn or 0), role or "", text or ""))
    assert set(got) == set(by_conv)
    for conv, turns in by_conv.items():
        turns.sort()
        said = "".join(f"{role}\n{text}\n" for _, role, text in turns)
        loss = "".join(text for _, role, text in turns if role == "assistant")
        r = got[conv]
        assert r["n_turns"] == len(turns) and r["turns_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    for r in chats.collect():
        assert len(r["token_ids"]) == len(r["loss_mask"]) == len(r["token_starts"]) and r["token_ends"][-1] == len(r["formatted"])


def test_empty(spark, tokenizer_path):
    assert c.format_chats(spark.createDataFrame([], SCHEMA), tokenizer_path).collect() == []
