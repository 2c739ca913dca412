from datetime import datetime

import pytest

from quireforge.llm import queries
from quireforge.llm import survivors as sv

STATED = "entity_id long, doc_id long, key string, value string, ingested_at timestamp_ntz, label string, vote string, source string"
T = [datetime(2024, 1, d) for d in range(1, 6)]


def run(spark, rows, labels=("First Recorded", "Toll"), **kw):
    stated = spark.createDataFrame([(*r, "clash", "clash", "clash") for r in rows], STATED)
    names = spark.createDataFrame([(x, "clash") for x in labels], "label string, value string")
    return {(r["entity_id"], r["label"]): r for r in sv.survivors(stated, names, **kw).collect()}


@pytest.mark.parametrize("value", [None, "", "  ", " ", "N/A", "k. A.", "…", "???", "--", "UNKNOWN ", "sin datos", "[missing]", "none s [cut]", "year (…)", "high...", "40…", "Ta�zeno", "see above"])
def test_unusable(spark, value):
    assert run(spark, [(1, 1, "Toll", value, T[0])]) == {}


@pytest.mark.parametrize("value", ["0", "none since the flood", "first frost.", "c. 465", "323 A.F. ", "unknown island"])
def test_usable(spark, value):
    assert run(spark, [(1, 1, "Toll", value, T[0])])[(1, "Toll")]["value"] == value


def test_latest_with_nulls_and_ties(spark):
    rows = [
        (1, 5, " TOLL :", "old", T[0]), (1, 4, "toll", "new", T[2]), (1, 3, "Toll", "N/A", T[4]), (1, 2, "Toll", "tie", T[2]), (1, 2, "Toll", "tie", T[2]),
        (2, 9, "First_Recorded", "x", None), (2, 8, "First Recorded", "y", None), (3, 1, "Other", "z", T[0]), (None, 1, "Toll", "z", T[0]), (4, None, "Toll", "z", T[0]), (5, 1, None, "z", T[0]),
    ]
    got = {k: r["doc_id"] for k, r in run(spark, rows, prefer="latest").items()}
    assert got == {(1, "Toll"): 2, (2, "First Recorded"): 8}


def test_p2_found_discovers_nothing(spark, small, monkeypatch):
    """Time alone decides its rows, so the rounds must not run; the rows stay those of the survivors by time."""
    stated, labels = queries.table(spark, small, "entity_fields"), queries.table(spark, small, "field_labels")
    fields = ["entity_id", "label", "value", "doc_id", "at"]
    want = {tuple(r) for r in sv.survivors(stated, labels, prefer="latest").select(*fields).collect()}
    monkeypatch.setattr(sv, "discover", None)
    twice = {r[0] for r in sv.stated_twice(stated).collect()}
    assert {tuple(r) for r in queries.QUERIES["p2_found"](spark, small).collect()} == {(e, label, d) for e, label, _, d, _ in want if e in twice}
    assert {tuple(r) for r in sv.latest(stated, labels).select(*fields).collect()} == want


def test_latest_says_how_far_it_is_backed(spark):
    rows = [(1, d, "Toll", "old", T[0]) for d in (1, 2, 3)] + [(1, 4, "Toll", "new", T[4]), (2, 4, "Toll", "new", T[4])]
    got = run(spark, rows, prefer="latest")
    assert got[(1, "Toll")]["value"] == "new" and got[(1, "Toll")]["share"] < 0.5 and got[(2, "Toll")]["share"] == 1


def test_support_beats_recency_and_reliable_sources_count(spark):
    rows = [(1, d, "Toll", "good" if d < 4 else "bad", T[d % 5]) for d in range(1, 6)]
    assert run(spark, rows)[(1, "Toll")]["value"] == "good"
    # Sources 1 and 2 are right elsewhere, 3 to 5 are not; in the end one voice each stands against one.
    rows = [(e, d, "Toll", "true" if d in (1, 2) or (d, e) in ((6, e), (7, e)) else f"false{d}", T[0]) for e in range(2, 12) for d in range(1, 8)]
    rows += [(1, 1, "Toll", "trusted", T[0]), (1, 3, "Toll", "doubted", T[4])]
    assert run(spark, rows)[(1, "Toll")]["value"] == "trusted"


def test_ties_go_to_the_reliable_then_the_later(spark):
    rows = [(1, 1, "Toll", "early", T[0]), (1, 2, "Toll", "late", T[3]), (2, 8, "Toll", "b", None), (2, 7, "Toll", "a", None)]
    got = run(spark, rows)
    assert got[(1, "Toll")]["value"] == "late" and got[(2, "Toll")]["doc_id"] == 7 and got[(1, "Toll")]["share"] == 0.5
    # Source 1 agrees with another about a second field, so its word weighs more than the later one of source 2.
    rows += [(3, 1, "Toll", "same", T[0]), (3, 9, "Toll", "same", T[0]), (4, 2, "Toll", "p", T[0]), (4, 5, "Toll", "q", T[0])]
    assert run(spark, rows)[(1, "Toll")]["value"] == "early"


def test_hot_groups_and_sources_are_split(spark, monkeypatch):
    rows = [(1, d, "Toll", f"v{d % 4}", T[d % 5]) for d in range(1, 160)] + [(e, 1, "Toll", "v1", T[0]) for e in range(2, 90)] + [(e, e + 500, "Toll", "v2", T[1]) for e in range(2, 40)]
    split = {p: run(spark, rows, prefer=p) for p in ("support", "latest")}
    monkeypatch.setattr(sv.skew, "heavy_keys", lambda *a: None)
    for p, got in split.items():
        plain = run(spark, rows, prefer=p)
        assert {k: (r["value"], r["doc_id"], round(r["support"], 6)) for k, r in got.items()} == {k: (r["value"], r["doc_id"], round(r["support"], 6)) for k, r in plain.items()}


def test_says_when_it_has_not_settled(spark):
    rows = [(e, d, "Toll", f"v{(e * d) % 3}", T[0]) for e in range(1, 6) for d in range(1, 8)]
    with pytest.warns(UserWarning, match="settled"):
        run(spark, rows, rounds=1)


def test_planted_truth(spark):
    """Values of sources that are right at known rates: discovery finds more true values than counting heads."""
    import random
    from collections import Counter, defaultdict

    rng, rows, heads = random.Random(3), [], defaultdict(Counter)
    rates = {d: 0.95 if d <= 3 else 0.3 for d in range(1, 11)}
    for e in range(60):
        for d, rate in rates.items():
            if rng.random() < 0.7:
                v = "true" if rng.random() < rate else f"false {rng.randrange(3)}"
                heads[e][v] += 1
                rows.append((e, d, "Toll", v, T[rng.randrange(5)]))
    got = run(spark, rows)
    right = sum(got[(e, "Toll")]["value"] == "true" for e in range(60))
    counted = sum(c["true"] > max(n for v, n in [*c.items(), ("", 0)] if v != "true") for c in heads.values())
    assert right > counted and right >= 52


def test_writing_of_a_value_does_not_split_votes(spark):
    rows = [(1, 1, "Toll", "Free  today", T[0]), (1, 2, "Toll", "FREE TODAY.", T[0]), (1, 3, "Toll", "paid", T[4])]
    got = run(spark, rows)[(1, "Toll")]
    assert got["value"].lower().startswith("free") and got["share"] > 0.5


def test_empty_and_long(spark):
    assert run(spark, []) == {} and run(spark, [(1, 1, "Toll", "x", T[0])], labels=()) == {}
    assert len(run(spark, [(1, 1, "Toll", "x" * 300_000, T[0])])[(1, "Toll")]["value"]) == 300_000


def test_stated_twice(spark):
    df = spark.createDataFrame([(1, 1), (1, 2), (2, 1), (2, 1), (3, None), (3, 1), (None, 1), (None, 2)], "entity_id long, doc_id long")
    assert [r[0] for r in sv.stated_twice(df).collect()] == [1]
