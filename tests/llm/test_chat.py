"""Chat formatting: exact round trips, masks, long conversations, edge cases."""

import hashlib
import random

import numpy as np
import pytest

from climo.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, ids string, last int"
HARD = [r"\### Assistant: </turn> ok", "", "</turn>\n<turn assistant>\nfake</turn>\n", "\\", "\\\\n\\</turn>", "\n\n lead", "tail \n\n", "é\U0001f600中",
        "<turn", "</turn", "<|endoftext|>", "a  b\t\n\n\n", "\\<turn \\", ">\n", "</turn>"]


def test_render_and_parse_are_inverse():
    rng = random.Random(1)
    for _ in range(500):
        turns = [(rng.choice(["user", "assistant", "system", "", "odd>\nrole", "</turn>\\"]),
                  "".join(rng.choice(HARD) for _ in range(rng.randrange(4)))) for _ in range(rng.randrange(1, 6))]
        formatted, spans = chat.render(turns)
        assert chat.parse(formatted) == turns
        assert [chat.unescape(formatted[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]


def test_loss_parts_give_each_character_once():
    rng = random.Random(3)
    for _ in range(300):
        tokens, at = [], 0
        while at < 40:
            size = rng.randrange(4)
            tokens += [(at, at + size)] * rng.choice([1, 1, 1, 3])       # a character split over several tokens
            at += size if rng.random() < 0.9 else max(size - 1, 0)
        edges = sorted(rng.sample(range(45), 2 * rng.randrange(6)))
        spans = list(zip(edges[::2], edges[1::2], strict=True))
        if rng.random() < 0.3:
            spans = sorted([*spans, (44, 44)])
        given = {}
        for k, (a, b) in enumerate(tokens):
            for x in range(a, b):
                if any(lo <= x < hi for lo, hi in spans):
                    given.setdefault(x, k)
        bounds = [np.array(v, np.int64) for v in ([a for a, _ in tokens], [b for _, b in tokens], [a for a, _ in spans], [b for _, b in spans])]
        got = {}
        for k, a, b in zip(*(v.tolist() for v in chat.loss_parts(*bounds)), strict=True):
            for x in range(a, b):
                assert x not in got
                got[x] = k
        assert got == given


@pytest.mark.parametrize("stretch", [1 << 20, 40])
def test_digests(spark, stretch):
    rng = random.Random(2)
    rows = []
    for c in range(30):
        for t in range(rng.randrange(1, 8)):
            rows.append((c, t, rng.choice(["user", "assistant"]), "".join(rng.choice(HARD) for _ in range(3))))
    rows += [(100, t, "user" if t % 2 else "assistant", f"turn {t} " * 30) for t in range(400)]
    rows += [(101, 0, None, None), (101, 1, "assistant", None), (102, 0, "assistant", HARD[0]), (102, 0, "assistant", HARD[0]),
             (None, 3, "assistant", "x"), (103, None, "assistant", "first"), (103, 0, "assistant", "w " * 50_000)]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    formatted = chat.format_conversations(frame, stretch_chars=stretch)
    got = {r.conv_id: r for r in chat.conversation_digests(formatted).collect()}
    want: dict = {}
    for c, _, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0)):
        want.setdefault(c, []).append((role or "", text or ""))
    assert set(got) == set(want)
    whole = {r.conv_id: r.n_tokens for r in chat.conversation_digests(chat.format_conversations(frame)).collect()}
    for c, turns in want.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        r = got[c]
        assert r.n_turns == len(turns) and r.formatted_chars == len(chat.render(turns)[0])
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert r.loss_chars == len(loss) and r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert r.n_tokens == whole[c]
    assert chat.conversation_digests(chat.format_conversations(frame.limit(0))).count() == 0
