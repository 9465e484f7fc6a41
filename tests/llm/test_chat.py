from itertools import product

from loomstat.llm import chat


def brute(roles):
    """Cheapest repair by trying every labelling, and for equal neighbours every way."""
    best = float("inf")
    for labels in product((1, 2, 3), repeat=len(roles)):
        for ways in product((0, 1), repeat=len(roles)):
            cost, state = 0.0, 0
            for r, to, w in zip(roles, labels, ways):
                options = chat.WAYS.get((state, to))
                if not options or w >= len(options):
                    cost = float("inf")
                    break
                cost += options[w][0] + (0 if r == to else chat.RELABEL if r else chat.UNKNOWN)
                state = to
            best = min(best, cost + chat.END_COST[state])
    return best


def legal(text):
    roles = [part.split("\n", 1)[0] for part in text.split("<|im_start|>")[1:]]
    if roles[:1] == ["system"]:
        roles = roles[1:]
    return roles == ["user", "assistant"] * (len(roles) // 2) and roles and text.count("<|im_start|>") == text.count("<|im_end|>\n")


def rendered(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (str(r.conv_id), r.position)):
        text, cost = out.get(r.conv_id, ("", 0))
        out[r.conv_id] = text + r.fragment, r.cost
    return out


def test_costs_match_brute_force_and_results_are_legal(spark):
    names = [None, "system", "user", "assistant"]
    cases = [c for n in (1, 2, 3, 4) for c in product(range(4), repeat=n)]
    rows = [(i, t, names[r], f"t{t}") for i, c in enumerate(cases) for t, r in enumerate(c)]
    got = rendered(chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))
    for i, c in enumerate(cases):
        text, cost = got[i]
        assert cost == brute(c) and legal(text)
        assert [p for p in text.replace("<", "\n").split("\n") if p.startswith("t") and p[1:].isdigit()] == [f"t{t}" for t in range(len(c))]


def test_long_conversation_is_cut_into_segments(spark, monkeypatch):
    rows = [(7, t, ("user", "user", "assistant", "bot", "system")[t * t % 5], "x") for t in range(3000)]
    one = rendered(chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)))[7]
    roles = [chat.role_number(r[2]) for r in rows]
    total = chat.TURNS[roles[0]][0]
    for r in roles[1:]:
        total = chat.product(total, chat.TURNS[r])
    assert one[1] == (total + chat.END_COST).min() and legal(one[0])


def test_nulls_repeats_and_empty(spark):
    schema = "conv_id long, turn long, role string, text string, segment string, place int"
    rows = [(None, 0, "user", None, "c", 1), (1, None, None, "", "c", 1), (1, 0, "USER ", "a", "c", 1), (1, 0, "USER ", "a", "c", 1)]
    out = chat.format_chats(spark.createDataFrame(rows, schema)).collect()
    assert len(out) == 4 and sorted(r.position for r in out if r.conv_id == 1) == [0, 1, 2]
    assert chat.format_chats(spark.createDataFrame([], schema)).count() == 0
