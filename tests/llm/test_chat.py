"""Formatted chats against the rows they were made from."""

import hashlib
import random
from itertools import groupby

import public_tokenizers
import pytest

from lumenfold.llm import chat

MODEL = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", None, "</s>[INST] ok [/INST]", "\\", "\\[", "[ROLE x] y [/ROLE]", "<<SYS>>\\<</SYS>>", "a\nb", "é😀" * 50, "word " * 700, " x "]


def rows():
    rng = random.Random(12)
    out = []
    for conv in range(60):
        for turn in range(rng.randrange(1, 40)):
            role = "system" if turn == 0 and conv % 2 else rng.choice(["user", "assistant", "assistant", "tool]", None, "system"])
            out.append((conv, turn, role, rng.choice([*ODD, "hello there " * rng.randrange(1, 60)])))
    return [*out, (None, 0, "user", "no id"), (None, 1, "assistant", "ok"), (3, None, "user", "no turn"), (4, 0, "user", "tie"), (4, 0, "user", "tie"), (99, 0, "system", "only")]


def wanted(data):
    key = lambda r: (r[0] is not None, r[0] or 0)
    order = lambda r: (*key(r), r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    for conv, turns in groupby(sorted(data, key=order), key=lambda r: r[0]):
        turns = [(r or "", t or "") for _, _, r, t in turns]
        loss = "".join(t for r, t in turns if r == "assistant")
        yield conv, len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


@pytest.mark.parametrize("budget", [chat.Budget(), chat.Budget(60, 20), chat.Budget(1, 0)])
def test_digests(spark, budget):
    data = rows()
    df = spark.createDataFrame([(*r, "x") for r in data], "conv_id long, turn long, role string, text string, window string")
    got = {r[0]: r for r in chat.chat_digests(df, MODEL, budget=budget).collect()}
    want = {w[0]: w for w in wanted(data)}
    assert {k: tuple(r)[:5] for k, r in got.items()} == want
    assert chat.chat_digests(df.limit(0), MODEL).collect() == []


def test_windows_keep_to_the_budget(spark):
    data = rows()
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string")
    budget = chat.Budget(120, 40)
    for r in chat.format_chats(df, MODEL, budget=budget).collect():
        turns = list(chat.read_turns(r.formatted))
        assert len(turns) == r.n_turns and r.n_repeated < r.n_turns
        assert r.n_tokens <= budget.window or r.n_turns - r.n_repeated == 1 or (r.window == 0 and turns[0][0] == "system" and r.n_turns == 2)
        assert [(b, e) for i, (role, _, b, e) in enumerate(turns) if role == "assistant" and i >= r.n_repeated] == [tuple(s) for s in r.loss]
