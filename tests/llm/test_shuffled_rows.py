"""What the joins of near copies and the training order write and shuffle."""

from pathlib import Path

import numpy as np

from quarry.llm import jaccard_join, training_order
from quarry.llm.common import stage

S = jaccard_join.JoinSettings()
NODES = "nid long, n long, sketch binary, tokens array<long>"


def join_rows(df):
    """Rows that come out of the joins of the plan of `df`, which is run."""
    df.sparkSession.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df.collect()
        todo, rows = [df._jdf.queryExecution().executedPlan()], 0
        while todo:
            node = todo.pop()
            if "Join" in node.nodeName():
                rows += node.metrics().get("numOutputRows").get().value()
            children = node.children()
            todo += [children.apply(i) for i in range(children.size())]
        return rows
    finally:
        df.sparkSession.conf.set("spark.sql.adaptive.enabled", "true")


def test_a_token_of_many_nodes_joins_groups_and_not_nodes(spark):
    # 300 nodes of one size in six groups, each a component of its own, with the same five looked-up tokens
    members = [[(50 * g + i, 100, b"", [1, 2, 3, 4, 5], [0, 1, 2, 3, 4]) for i in range(50)] for g in range(6)]
    groups = stage(spark.createDataFrame([(50 * g, m) for g, m in enumerate(members)], f"grp long, members array<{jaccard_join.MEMBER}>"), "groups")
    none = spark.createDataFrame([], "nid long, root long")
    visits = jaccard_join.later_visits(groups, none, S)
    want = {(50 * g, 50 * h + i) for h in range(6) for g in range(h) for i in range(50)}
    assert sorted((r.grp, r.nid) for r in visits.collect()) == sorted(want)
    # five tokens in all pairs of six groups, those with themselves included; by nodes there were 187,500
    assert join_rows(visits) <= 5 * 6 * 6


def test_later_visits_by_size_room_and_component(spark):
    rng = np.random.default_rng(5)
    tokens = [sorted(rng.choice(40, 4, replace=False).tolist()) for _ in range(120)]
    nodes = [(i, int(rng.integers(60, 100)), b"", t, rng.permutation(8)[:4].tolist()) for i, t in enumerate(tokens)]
    cuts = [0, 1, 5, 30, 31, 70, 100, 120]
    groups = stage(spark.createDataFrame([(a, nodes[a:b]) for a, b in zip(cuts, cuts[1:])], f"grp long, members array<{jaccard_join.MEMBER}>"), "groups")
    root = {i: i % 7 if i % 3 else i for i in range(120)}
    roots = spark.createDataFrame([(i, r) for i, r in root.items() if r != i], "nid long, root long")
    grp = {i: a for a, b in zip(cuts, cuts[1:]) for i in range(a, b)}

    def asked(at, t, r):
        own = [(n, 100 * n - 190 * ps[ts.index(t)]) for i, n, _, ts, ps in nodes[at:] if grp[i] == at and t in ts and root[i] == r]
        return own and (min(n for n, _ in own), max(n for n, _ in own), max(m for _, m in own))

    want = set()
    for i, n, _, ts, ps in nodes:
        for t, place in zip(ts, ps):
            for at in {g for g in grp.values() if g < grp[i]}:
                for r in set(root.values()) - {root[i]}:
                    if got := asked(at, t, r):
                        low, high, most = got
                        if 100 * high >= 90 * n and 100 * n >= 90 * low and 100 * n - 190 * place >= 90 * low and most >= 90 * n:
                            want.add((at, i))
    got = [(r.grp, r.nid) for r in jaccard_join.later_visits(groups, roots, S).collect()]
    assert len(want) > 50 and sorted(got) == sorted(want)


def test_nodes_that_meet_by_chance_are_in_no_group(spark):
    rows = [
        (1, 100, b"", [7, 70]), (2, 50, b"", [7, 71]),  # sizes too far apart
        (3, 100, b"", [72, 73, 74, 75, 76, 77, 8]), (4, 100, b"", [8]),  # too much before the token in one of them
        (5, 100, b"", [9]), (6, 95, b"", [9]),  # may be linked
        (7, 100, b"", [10]), (8, 40, b"", [10]), (9, 92, b"", [10]),
    ]
    groups = jaccard_join.similar_groups(spark.createDataFrame(rows, NODES), S)
    found = {m.nid: m.tokens for r in groups.collect() for m in r.members}
    assert {5, 6, 7, 9} <= set(found) and not {1, 2, 3, 4} & set(found)
    assert found[5] == found[6] == [9]


def test_staged_token_ids_are_packed(spark):
    rng = np.random.default_rng(2)
    words = [f"word{i} " for i in range(300)]
    docs = spark.createDataFrame([(i, "".join(rng.choice(words, 800))) for i in range(60)], "doc_id long, text string")
    sequences = training_order.tokenized(docs.coalesce(1), training_order.OrderSettings())
    plain = stage(sequences, "plain")
    size, before = (sum(Path(f.removeprefix("file:")).stat().st_size for f in df.inputFiles()) for df in (sequences, plain))
    assert size < 0.9 * before
