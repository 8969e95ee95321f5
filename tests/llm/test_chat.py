import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from quaylight.llm import chat
from quaylight.llm.common import table

piece = st.sampled_from([*chat.CONTROL, "\\", "<", "|", "[", "im_start", "a", "\n", "n", "é"])
text = st.lists(piece, max_size=12).map("".join)


@settings(max_examples=300, deadline=None)
@given(text, text)
def test_escapes_round_trip(role, said):
    e, r = chat.escape(said), chat.escape_role(role)
    assert chat.unescape(e) == said
    assert chat.unescape_role(r) == role
    assert not any(c in e or c in r for c in chat.CONTROL)
    assert chat.parse(f"{chat.OPEN}{r}\n{e}{chat.CLOSE}" * 2) == [(role, said)] * 2


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["system", "user", "assistant"]), st.integers(1, 30)), min_size=1, max_size=25), st.integers(5, 60), st.integers(0, 20))
def test_windows_hold_each_turn_once_within_budget(turns, budget, history):
    w = chat.Windows(1, budget, history)
    made = [(r, f"{chat.OPEN}{r}\n{i}{chat.CLOSE}", n, len(chat.OPEN) + len(r) + 1) for i, (r, n) in enumerate(turns)]
    out = [d for t in made if (d := w.add(t))] + [w.close()]
    new, loss = [], []
    for _, _, said, spans, repeated in out:
        parsed = chat.parse(said)
        new += [int(t) for _, t in parsed[repeated:]]
        loss += [int(said[a:b]) for a, b in zip(spans[::2], spans[1::2], strict=True)]
        size = sum(turns[int(t)][1] for _, t in parsed)
        assert size <= budget or len(parsed) - repeated == 1
        assert [int(t) for _, t in parsed] == sorted(int(t) for _, t in parsed)
        if turns[0][0] == "system":
            assert int(parsed[0][1]) == 0
    assert new == list(range(len(turns)))
    assert loss == [i for i, (r, _) in enumerate(turns) if r == "assistant"]


def digests(rows):
    turns = "".join(f"{r or ''}\n{t or ''}\n" for r, t in rows)
    loss = "".join(t or "" for r, t in rows if r == "assistant")
    return len(rows), hashlib.sha256(turns.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def test_op5(spark, tiny):
    got = {r.conv_id: r for r in chat.op5(spark, tiny).collect()}
    want = {-1: [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]}
    for r in table(spark, tiny, "conversations").orderBy("conv_id", "turn").collect():
        want.setdefault(r.conv_id, []).append((r.role, r.text))
    assert {k: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for k, r in got.items()} == {k: digests(v) for k, v in want.items()}


def test_odd_turns(spark):
    rows = [(1, 0, None, None), (1, 1, "assistant", None), (1, 1, "assistant", "x" * 9000), (None, 5, "user", "a"), (None, 5, "user", "a"), (2, None, "a\nb", "q")]
    df = spark.createDataFrame([(*r, 7) for r in rows], "conv_id long, turn long, role string, text string, loss int")
    got = {r.conv_id: r for r in chat.read_back(chat.format_chats(df, budget=20, history=5)).collect()}
    assert (got[1].n_turns, got[1].loss_chars, got[None].n_turns, got[2].n_turns) == (3, 9000, 2, 1)
    assert chat.format_chats(df.where("turn > 9")).count() == 0
