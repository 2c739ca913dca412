import random

from quireforge.llm import mixing as mx

SIZED = "doc_id long, source string, n_tokens long, total long, budget double"
TARGETS = "mix_name string, source string, target_weight double, max_repeats int, n_tokens long"


def run(spark, docs, targets, **kw):
    sized = spark.createDataFrame([(*d, 0, 0.0) for d in docs], SIZED)
    chosen, report = mx.mix_sources(sized, spark.createDataFrame([(*t, 0) for t in targets], TARGETS), **kw)
    return chosen.collect(), {(r["mix_name"], r["source"]): r for r in report.collect()}


def test_shares_repeats_and_order(spark):
    rng = random.Random(1)
    docs = [(i, "big" if i < 3000 else "small" if i < 3100 else "tiny", rng.randrange(1, 60)) for i in range(3110)]
    chosen, report = run(spark, docs, [("m", "big", 2.0, 1), ("m", "small", 1.0, 3), ("m", "gone", 1.0, 9), ("n", "tiny", 0.1, 2)])
    size = {d: n for d, _, n in docs}
    mine = [r for r in chosen if r["mix_name"] == "m"]
    assert sorted(r["position"] for r in mine) == list(range(1, len(mine) + 1))
    total = sum(size[r["doc_id"]] for r in mine)
    small = sum(size[r["doc_id"]] for r in mine if r["source"] == "small")
    assert abs(small / total - 1 / 3) < 120 / total and report[("m", "small")]["most_repeats"] == 3 and report[("m", "big")]["most_repeats"] == 1
    assert small == 3 * sum(n for _, s, n in docs if s == "small") and report[("m", "small")]["tokens"] == small
    assert report[("m", "gone")]["tokens"] == 0 and report[("m", "gone")]["target_share"] == 0.25 and abs(report[("m", "small")]["actual_share"] - small / total) < 1e-12
    keys = [(r["mix_name"], r["doc_id"], r["repeat"]) for r in chosen]
    assert len(keys) == len(set(keys)) and all(r["repeat"] <= {"big": 1, "small": 3, "tiny": 2}[r["source"]] for r in chosen)
    # The shares hold at every point of the order, not just at its end.
    mine.sort(key=lambda r: r["position"])
    half = mine[: len(mine) // 2]
    assert abs(sum(size[r["doc_id"]] for r in half if r["source"] == "small") / sum(size[r["doc_id"]] for r in half) - 1 / 3) < 0.02
    assert sum(size[r["doc_id"]] for r in chosen if r["mix_name"] == "n") == 2 * sum(n for _, s, n in docs if s == "tiny")


def test_budget_and_determinism(spark):
    docs = [(i, "a" if i % 2 else "b", 10) for i in range(400)]
    first, report = run(spark, docs, [("m", "a", 1.0, 1), ("m", "b", 3.0, 1)], budget=400)
    assert sum(r["n_tokens"] for r in first) == 400 and report[("m", "b")]["tokens"] == 300
    assert sorted(map(tuple, first)) == sorted(map(tuple, run(spark, docs[::-1], [("m", "b", 3.0, 1), ("m", "a", 1.0, 1)], budget=400)[0]))
    assert sorted(r["doc_id"] for r in first) != sorted(r["doc_id"] for r in run(spark, docs, [("m", "a", 1.0, 1), ("m", "b", 3.0, 1)], budget=400, seed=5)[0])


def test_budget_that_small_sources_cannot_fill(spark):
    docs = [(i, "big", 10) for i in range(900)] + [(1000 + i, "small", 10) for i in range(20)]
    chosen, report = run(spark, docs, [("m", "big", 1.0, 1), ("m", "small", 1.0, 3)], budget=4000)
    big, small = report[("m", "big")], report[("m", "small")]
    assert (big["tokens"], big["short"], small["tokens"], small["short"]) == (2000, 0, 600, 1400) and small["most_repeats"] == 3
    assert abs(small["actual_share"] - 600 / 2600) < 1e-9 and len(chosen) == 260
    _, report = run(spark, docs, [("m", "big", 1.0, 1), ("m", "small", 1.0, 3)])
    assert report[("m", "big")]["tokens"] == report[("m", "small")]["tokens"] == 600 and {r["short"] for r in report.values()} == {0}


def test_dirty_rows(spark):
    docs = [(1, None, 5), (2, "a", 0), (3, "a", None), (4, "a", 7), (None, "a", 3)]
    chosen, report = run(spark, docs, [("m", "a", 1.0, None), ("m", None, 1.0, 2), ("m", "b", 0.0, 2), (None, "a", 1.0, 2), ("m", "c", None, 1), ("m", "a", 1.0, None)])
    assert sorted((r["doc_id"] or 0, r["repeat"]) for r in chosen) == [(0, 1), (4, 1)] and set(report) == {("m", "a")}


def test_empty(spark):
    assert run(spark, [], []) == ([], {})
    chosen, report = run(spark, [], [("m", "a", 1.0, 1)])
    assert chosen == [] and report[("m", "a")]["actual_share"] == 0 and run(spark, [(1, "a", 5)], [])[0] == []
