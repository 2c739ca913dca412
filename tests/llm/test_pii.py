import os
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quireforge.llm import pii, pii_train

DOCS = "/root/testdata/sf0.01/documents.parquet"


def test_stretches_cover_what_can_be_a_mention():
    text = "Filler words without any sign. Write to ann.lee@example.org or call 01632 960 733. Anna Lee lives at 12A Loom Hill." + " plain" * 60
    cut = list(pii.stretches(text))
    assert all(text[a : a + len(w)] == w for a, w in cut)
    for part in ("ann.lee@example.org", "01632 960 733", "Anna Lee", "12A Loom Hill"):
        s = text.index(part)
        assert any(a <= s and s + len(part) <= a + len(w) for a, w in cut)
    assert sum(len(w) for _, w in cut) < len(text) and list(pii.stretches("all small letters here")) == []
    long = "Anna Lee " * 100
    windows = list(pii.stretches(long))
    assert max(len(w) for _, w in windows) == pii.WINDOW and windows[1][0] == pii.WINDOW - pii.OVERLAP


def test_viterbi_equals_brute_force():
    import itertools

    r = np.random.default_rng(1)
    k = pii.TAGS
    w = {"W": r.normal(0, 1, (2, pii.SYMBOLS, 12)), "U": r.normal(0, 1, (2, 3, 12)), "O": r.normal(0, 2, (6, k)), "o": r.normal(0, 1, k), "A": r.normal(0, 2, (k, k)), "first": r.normal(0, 1, k), "last": r.normal(0, 1, k)}
    t = pii.Tagger(w)
    words = ["Ab1", "x@y", "Q7", "é"]
    ids, lens = pii.encode(words), np.array([len(x) for x in words])
    e, path = t.emissions(ids, lens), t.decode(ids, lens)
    for b, n in enumerate(lens):
        best = max(itertools.product(range(k), repeat=int(n)), key=lambda p: w["first"][p[0]] + w["last"][p[-1]] + sum(e[p[i], i, b] for i in range(n)) + sum(w["A"][x, y] for x, y in zip(p, p[1:], strict=False)))
        assert tuple(path[b][:n]) == best


def test_padding_and_company_change_nothing():
    """A window's numbers are the same bits alone, among others and beside longer ones."""
    rng, tagger = random.Random(5), pii.load_tagger(pii.WEIGHTS)
    text = "".join(a + " " for a, _ in SAMPLES) * 3
    words = [text[a : a + rng.randrange(1, 150)] for a in (rng.randrange(len(text) - 150) for _ in range(200))]

    def bits(part):
        lens = np.ones(pii.ROWS, np.intp)
        lens[: len(part)] = [len(x) for x in part]
        e = tagger.emissions(pii.encode(part, pii.ROWS), lens)
        return [e[:, : len(x), i].tobytes() for i, x in enumerate(part)]

    together = bits(words)
    assert all(bits([w]) == [b] for w, b in list(zip(words, together, strict=True))[::20])
    order = rng.sample(range(len(words)), len(words))
    mixed = bits([words[i] for i in order] + ["x" * 192])
    assert [mixed[order.index(i)] for i in range(len(words))] == together


def test_same_rows_for_any_split():
    texts = [t for t, _ in SAMPLES] * 3 + ["Anna Lee " * 3000, "", None] + [t.upper() for t, _ in SAMPLES]
    whole = pii.Finder().find(texts)
    assert [pii.Finder().find([t])[0] for t in texts] == whole
    assert [s for i in range(0, len(texts), 4) for s in pii.Finder().find(texts[i : i + 4])] == whole


OTHER_NAMES = [
    ("The ledger was handed to Jon Venn by Carla de la Cruz last week.", {"Jon Venn", "Carla de la Cruz"}), ("JOHN SMITH signed the book on a Monday.", {"JOHN SMITH"}),
    ("A letter from Łukasz Žižek arrived, and Šimon Čapek read it.", {"Łukasz Žižek", "Šimon Čapek"}), ("The map was drawn by E. Holm in the autumn.", {"E. Holm"}),
    ("It was sold to Wu, Mei in the yard.", {"Wu, Mei"}), ("Ольга Петрова wrote the note.", {"Ольга Петрова"}),
]


def test_names_outside_the_templates():
    got = pii.Finder().find([t for t, _ in OTHER_NAMES])
    hit = sum(len({t[s:e] for s, e, _ in spans} & want) for (t, want), spans in zip(OTHER_NAMES, got, strict=True))
    assert hit >= 7 and hit / sum(len(w) for _, w in OTHER_NAMES) > 0.8


@settings(max_examples=300, deadline=None)
@given(
    st.one_of(
        st.from_regex(r"\+?[0-9](?:[ .()/–-]{0,3}[0-9]){4,14}", fullmatch=True), st.from_regex(r"[A-ZÑ]{0,3}[ -]?[0-9](?:[ .-]?[0-9A-ZÑ]{1,3}){2,4}[0-9]{2}", fullmatch=True),
        st.from_regex(r"[a-z]{1,8}(?: ?@ ?|\[at\]| \(at\) )[a-z]{1,8}\.[a-z]{2,4}", fullmatch=True),
        st.from_regex(r"[A-ZÀÉŠŁΩД](?:[a-zéš]{1,9}|\.),?\s(?:(?:von|de la|van|[A-Z]\.)\s){0,3}[A-ZÀÉŠŁΩД][a-zéš]{1,9}", fullmatch=True),
    )
)
def test_every_form_is_looked_at(mention):
    """What the exact check can accept lies in a window of the network, wherever it stands."""
    text = "plain words " * 20 + mention + " and more plain words" * 10
    s = 240
    holds = [a <= s and s + len(mention) <= a + len(w) for a, w in pii.stretches(text)]
    assert any(holds) or sum(c.isdigit() for c in mention) < pii.LEAST_DIGITS and "@" not in mention and "at" not in mention


def test_gradients():
    m = pii_train.Model(4, 3)
    m.p = {n: a.astype(np.float64) for n, a in m.p.items()}
    r = np.random.default_rng(0)
    m.p["A"] += r.normal(0, 0.3, m.p["A"].shape)
    ids, y = r.integers(0, pii.SYMBOLS, (2, 5)), r.integers(0, pii.TAGS, (2, 5))
    _, g = m.loss(ids, y)
    used = int(ids[0, 2])
    for name, at in (("U", (0, 1, 2)), ("U", (1, 2, 9)), ("O", (3, 4)), ("A", (int(y[0, 0]), int(y[0, 1]))), ("W", (0, used, 3)), ("W", (1, used, 14)), ("o", (2,)), ("first", (int(y[0, 0]),)), ("last", (int(y[1, -1]),))):
        keep, h = m.p[name][at], 1e-3
        m.p[name][at] = keep + h
        up = m.loss(ids, y)[0]
        m.p[name][at] = keep - h
        down = m.loss(ids, y)[0]
        m.p[name][at] = keep
        assert abs((up - down) / (2 * h) - g[name][at]) < 2e-3, name


def test_reconcile():
    assert pii.reconcile([(5, 9, 0, False, False), (5, 7, 0, False, True), (20, 25, 1, True, False), (18, 25, 1, False, False), (30, 35, 2, False, False), (33, 40, 3, False, False)]) == [(5, 9, 0), (18, 25, 1), (33, 40, 3)]
    assert pii.reconcile([(1, 5, 0, False, True), (4, 9, 0, True, False)]) == [(1, 9, 0)]


SAMPLES = [
    ("Contact Jonas Quillfeld on +44 20 7946 0556 before the autumn count.", {("name", "Jonas Quillfeld"), ("phone", "+44 20 7946 0556")}),
    ("Send corrections to edda.hollorizal@example.net or by post to 119 Granary Street, Rigesiba.", {("email", "edda.hollorizal@example.net"), ("address", "119 Granary Street, Rigesiba")}),
    ("Mme Ilse Pendfeld, pièce n° 1 84 13 00 811 050 99, a signé la fiche.", {("name", "Ilse Pendfeld"), ("id_number", "1 84 13 00 811 050 99")}),
    ("Tibor Zorrack, wohnhaft Webergasse 49b, 00075 Karasemo", {("name", "Tibor Zorrack"), ("address", "Webergasse 49b, 00075 Karasemo")}),
    ("Passport QQ 56 10 55 C was left in the cellar.", {("id_number", "QQ 56 10 55 C")}),
    ("Two weights @ 65.44 each. Shelf mark 8749-1746-56 is still missing.", set()),
]


@pytest.mark.parametrize("text,want", SAMPLES)
def test_finds_mentions(text, want):
    got = {(k, text[s:e]) for s, e, k in pii.Finder().find([text])[0]}
    assert got == want


def test_held_out_agreement():
    """On documents that the weights were not made from, the spans agree with the labels of cues and names."""
    if not os.path.exists(DOCS):
        pytest.skip("no test tables")
    import pyarrow.parquet as pq

    texts = [t for t in pq.read_table("/root/testdata/check_s/documents.parquet", columns=["text"]).column(0).to_pylist()[:1500] if t] if os.path.isdir("/root/testdata/check_s") else [t for t in pq.read_table(DOCS, columns=["text"]).column(0).to_pylist() if t]
    names = [tuple(r) for r in pq.read_table("/root/testdata/sf0.01/known_names.parquet").to_pandas().itertuples(index=False)]
    labeller = pii_train.Labeller(names, texts)
    both = found = wanted = 0
    for text, spans in zip(texts, pii.Finder().find(texts), strict=True):
        a, b = {(s, k) for s, _, k in spans}, {(s, pii.KINDS[k]) for s, _, k in labeller.spans(text)}
        both, found, wanted = both + len(a & b), found + len(a), wanted + len(b)
    assert wanted > 300 and both / found > 0.93 and both / wanted > 0.97


def test_training_learns():
    rng = random.Random(0)
    texts = [f"Contact {pii_train._word(rng, 'Xx')} {pii_train._word(rng, 'Xx')} on +44 20 7946 0{rng.randrange(100, 999)} before noon." for _ in range(400)]
    lines = []
    w = pii_train.train(texts, [], hidden=12, steps=60, batch=32, log=lines.append)
    assert set(w) == {"W", "U", "O", "o", "A", "first", "last"} and "windows" in lines[0]


def test_spark(spark):
    rows = [(i, t, "clash", 0) for i, (t, _) in enumerate(SAMPLES)] + [(50, None, "clash", 0), (51, "", "clash", 0), (52, "x" * 300_000, "clash", 0), (0, SAMPLES[0][0], "clash", 0), (53, "Anna Lee " * 20_000, "clash", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, kind string, start_pos int")
    got = {(r["doc_id"], r["kind"], r["mention"]) for r in pii.find_mentions(df).collect() if r["doc_id"] != 53}
    assert got == {(i, *m) for i, (_, want) in enumerate(SAMPLES) for m in want}
    clean = {r["doc_id"]: r["text"] for r in pii.redact(df).collect()}
    assert clean[0] == "Contact [NAME] on [PHONE] before the autumn count." and clean[50] is None and clean[51] == "" and clean[5] == SAMPLES[5][0] and clean[52] == "x" * 300_000
    assert pii.find_mentions(df.limit(0)).count() == 0 and pii.redact(df.limit(0)).count() == 0
