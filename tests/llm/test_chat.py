import random

from helpers import rows

from basketry.llm import chat


def turns(spark, table):
    return spark.createDataFrame(table, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as k", "2 as h1", "3 as last")


def test_equals_brute_force(spark):
    rng = random.Random(1)
    logs = {}
    for i in range(60):
        old = rng.choice(list(logs.values())) if logs and rng.random() < 0.7 else []
        keep = old[: rng.randrange(len(old) + 1)]
        logs[i] = keep + [(rng.choice(["user", "bot", None]), rng.choice(["a", "b", None, ""])) for _ in range(rng.randrange(4))]
    logs = {i: t for i, t in logs.items() if t}
    table = [(i, k, r, t) for i, log in logs.items() for k, (r, t) in enumerate(log)]
    rng.shuffle(table)
    want = []
    for i, log in logs.items():
        longer = any(len(o) > len(log) and o[: len(log)] == log for o in logs.values())
        if not longer and i == min(j for j, o in logs.items() if o == log):
            text = "".join(f"<|{r or ''}|>\n{t or ''}<|end|>\n" for r, t in log)
            want.append((i, len(log), text))
    found = chat.rendered(turns(spark, table + table[:20]))
    assert rows(found, "conv_id", "n_turns", "text") == sorted(want, key=repr)


def test_edge_cases(spark):
    table = [(None, 0, "user", "x"), (1, 0, "user", "hi <|end|>"), (1, None, "bot", "first"), (2, 0, "user", "x" * 200_000), (3, 0, "user", "y"), (3, 0, "user", "x")]
    found = {r.conv_id: r for r in chat.rendered(turns(spark, table)).collect()}
    assert found[1].text == "<|bot|>\nfirst<|end|>\n<|user|>\nhi < |end|><|end|>\n"
    # Equal turn numbers go by role and text, so 3 begins like the conversation without an id.
    assert found[3].n_turns == 2 and None not in found and len(found[2].text) > 200_000
    assert chat.rendered(turns(spark, table).limit(0)).count() == 0
