import hashlib
from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from sayplace.llm.chat_format import digests, escape, format_turns, parse, render, unescape

NASTY = st.lists(st.sampled_from(["\\", "#", "###", "### ", "</turn>", "</", "turn>", "\n", "a", " ", "é", "user"]), max_size=12).map("".join)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(NASTY, NASTY), max_size=5))
def test_round_trip(turns):
    whole, spans = "", []
    for role, text in turns:
        formatted, begin, end = render(role, text)
        spans.append((len(whole) + begin, len(whole) + end))
        whole += formatted
    got = parse(whole)
    assert [(r, t) for r, t, _, _ in got] == turns
    assert [(a, b) for _, _, a, b in got] == spans
    for (_, text), (a, b) in zip(turns, spans):
        assert unescape(whole[a:b]) == text


@given(NASTY)
def test_escape(text):
    assert unescape(escape(text)) == text


def test_refused():
    for broken in ("x", "### user", "### user\nhi", "### user\nhi</turn>\n", "### user\na ### b\n</turn>\n"):
        assert parse(broken) is None


def test_conversations(spark):
    rows = [
        (1, 1, "assistant", "B"), (1, 0, "user", "A"), (1, 1, "assistant", "B"), (2, 0, None, None), (2, None, "assistant", "x\n</turn>\n### user\ny"), (None, 0, "assistant", "z"), (3, 5, "assistant", ""), (3, 4, "user", "q" * 100_000),
        # Equal turns and roles: the order is the texts', which is another one than that of what is written.
        (4, 0, "user", "###x"), (4, 0, "user", "$"), (4, 1, "user", "a\t"), (4, 1, "user", "a"), (4, 1, "user", "a\n"), (4, 2, "assistant", "\\###"), (4, 2, "assistant", "###"), (4, 2, "assistant", "</turn>"), (4, 2, None, "b"), (4, 2, "", "a")]
    df = spark.createDataFrame([(*r, "own", 1) for r in rows], "conv_id long, turn long, role string, text string, formatted string, begin int").repartition(4)
    got = {r.conversation: r for r in digests(format_turns(df, "conv_id", "turn", "role", "text", in_order=True)).collect()}
    by = defaultdict(list)
    for c, turn, role, text in rows:
        by[c].append((turn is not None, turn, role or "", text or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns = [t[2:] for t in sorted(turns, key=lambda t: (t[0], t[1] or 0, t[2], t[3]))]
        learned = "".join(t for r, t in turns if r == "assistant")
        r = got[c]
        assert r.n_turns == len(turns) and r.loss_chars == len(learned)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(learned.encode()).hexdigest()
        assert r.formatted_chars == sum(len(render(a, b)[0]) for a, b in turns)


def test_empty(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert digests(format_turns(none, "conv_id", "turn", "role", "text", in_order=True)).count() == 0
