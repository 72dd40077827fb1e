"""Views against a model of the rules: a dict that is changed write by write."""

import random

from pyspark.sql import functions as F

from chronolith.plans import views


def model(operations):
    """(living, changes by cursor, removal log) by replaying (key, instant, remove)."""
    state, removed, versions = {}, [], {}
    for key, instant, remove in operations:
        alive = state.get(key, (None, False))[1]
        if remove:
            if alive:
                state[key] = (state[key][0], False)
                removed.append((key, instant))
        else:
            state[key] = (instant, True)
            versions.setdefault(key, []).append(instant)
    return state, removed, versions


def test_random_logs(spark):
    for seed in range(3):
        rng = random.Random(seed)
        ops = [(rng.choice("abcdefgh"), i + 1, rng.random() < 0.3) for i in range(120)]
        frame = spark.createDataFrame([(1, 0, k, i, r, i * 10) for k, i, r in ops], "tenant long, pivot long, rec string, instant long, gone boolean, body long")
        v, r = views.from_operations(frame, F.col("gone"))
        v = v.drop("gone")
        state, removed, versions = model(ops)
        living = {x["rec"]: (x["instant"], x["body"]) for x in views.living(v, r).collect()}
        assert living == {k: (i, i * 10) for k, (i, alive) in state.items() if alive}
        assert {x["rec"]: x["removed"] for x in views.latest(v, r).collect()} == {k: not alive for k, (i, alive) in state.items() if i}
        assert sorted((x["rec"], x["instant"]) for x in r.collect()) == sorted(removed)
        order = [x["rec"] for x in views.recency(views.living(v, r)).orderBy("pos").collect()]
        assert order == [k for k, (i, alive) in sorted(state.items(), key=lambda x: (-(x[1][0] or 0), x[0])) if alive]
        for cursor in (0, 40, 110, 500):
            events = views.changes(v, r, cursor).orderBy("instant").collect()
            want = [(k, i, "saved") for k, (i, alive) in state.items() if alive and i > cursor] + [(k, i, "removed") for k, i in removed if i > cursor]
            assert [(e["rec"], e["instant"], e["event"]) for e in events] == sorted(want, key=lambda x: x[1])
        tail = max([i for i, alive in state.values() if alive] + [i for _, i in removed])
        assert views.tail(v, r).first()["cursor"] == tail
        for k, instants in versions.items():
            got = [(x["instant"], x["previous"], x["next"]) for x in views.history(v).where(F.col("rec") == k).orderBy("ver").collect()]
            up = [None, *instants, None]
            assert got == [(up[i], up[i - 1], up[i + 1]) for i in range(len(instants), 0, -1)]


def test_unique_changes(spark):
    v = spark.createDataFrame([(1, 10, "a"), (1, 20, "b"), (1, 30, "c")], "tenant long, instant long, body string")
    cursors = spark.createDataFrame([(1, c) for c in (10, 15, 0, 30, 40, None)] + [(2, 5)], "tenant long, cursor long")
    got = {}
    for r in views.unique_changes(v, cursors).collect():
        got.setdefault(r["cursor"], []).append(r["instant"])
    assert {c: sorted(x) for c, x in got.items()} == {10: [20, 30], 15: [30], 0: [30]}


def test_save_while_dead_does_not_revive(spark):
    v = spark.createDataFrame([(1, 0, "x", 1, True), (1, 0, "x", 3, False), (1, 0, "y", 4, False)], "tenant long, pivot long, rec string, instant long, enters boolean")
    r = spark.createDataFrame([(1, 0, "x", 2)], "tenant long, pivot long, rec string, instant long")
    assert views.living(v, r).collect() == []
    assert {x["rec"]: (x["instant"], x["removed"], x["in_living"]) for x in views.latest(v, r).collect()} == {"x": (3, True, False), "y": (4, False, False)}
