import difflib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import exemplars as E
from tessera.plans import catalog
from tests.oracle import SF_DIR


def _norm(text):
    return re.sub(r"\s+", " ", text).strip().lower()[:300]


def _brute(spark, folder):
    def texts(name, key):
        return [(r[0], _norm(r[1])) for r in spark.read.parquet(f"{folder}/{name}.parquet").select(key, "text").collect() if r[1] is not None]

    found = set()
    items = texts("benchmark", "item_id")
    for d, a in texts("documents", "doc_id"):
        for i, b in items:
            m = difflib.SequenceMatcher(None, a, b)
            if m.real_quick_ratio() >= 0.75 and m.quick_ratio() >= 0.75 and m.ratio() >= 0.75:
                found.add((i, d))
    return found


def _found(spark, folder):
    return {(r.item_id, r.doc_id) for r in catalog.QUERIES["similar_exemplars"](spark, folder).collect()}


def test_planted_texts_equal_brute_force(spark, tmp_path):
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 8))) for _ in range(400)]
    items, docs = [(100, None), (101, ""), (102, "x" * 900)], [(5000, None), (5001, " \n"), (5002, "x" * 400), (5003, "ab")]
    for i in range(40):
        text = [rng.choice(words) for _ in range(rng.randint(4, 60))]
        items.append((i, " ".join(text)))
        # The last letter of every third, then of every word: no run of three words stays whole.
        for k in (3, 1):
            docs.append((i * 10 + k, " ".join(w[:-1] + "Z" if j % k == 0 else w for j, w in enumerate(text))))
        docs.append((i * 10 + 5, " ".join(rng.choice(words) for _ in range(40))))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = _brute(spark, tmp_path)
    # difflib leaves common letters of long texts out, so not every pair reaches 0.75.
    assert len({(i, i * 10 + k) for i in range(40) for k in (1, 3)} & want) >= 30
    assert _found(spark, tmp_path) == want


@pytest.mark.parametrize("folder", [SF_DIR])
def test_equals_brute_force(spark, folder):
    assert _found(spark, folder) == _brute(spark, folder)


def test_common_subsequence_is_exact_or_a_bound():
    rng = random.Random(2)

    def plain(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            before = 0
            for j, y in enumerate(b, 1):
                before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
        return row[-1]

    for _ in range(200):
        a, b = ("".join(rng.choice("abcd") for _ in range(rng.randint(0, 90))) for _ in range(2))
        assert E.common(E.places(a), len(a), b, 0) == plain(a, b)
        least = rng.randint(0, 90)
        got = E.common(E.places(a), len(a), b, least)
        assert got == plain(a, b) or plain(a, b) <= got < least


def test_several_blocks_of_exemplars_and_the_best_of_a_kind(spark, monkeypatch):
    monkeypatch.setattr(E, "BLOCK", 3)
    texts = spark.createDataFrame([(1, "k", "the old house by the river"), (2, "m", "the old house by the river"), (3, None, "nothing")], "id long, kind string, t string")
    rows = [(10 + i, "k" if i % 2 else "m", "the old house by the river"[: 26 - i]) for i in range(9)] + [(30, None, "nothing")]
    got = E.lookup(texts, spark.createDataFrame(rows, "id long, kind string, t string"), 3)
    best = {}
    for r in got.collect():
        best.setdefault(r["text_id"], []).append(r["exemplar_id"])
    assert {k: sorted(v) for k, v in best.items()} == {1: [11, 13, 15], 2: [10, 12, 14], 3: [30]}


def test_first_independent_set_equals_the_walk(spark):
    rng = random.Random(11)
    for n, m in ((1, 0), (40, 30), (60, 200)):
        edges = {(rng.randrange(n), rng.randrange(n)) for _ in range(m)} if m else set()
        places = list(range(n))
        rng.shuffle(places)
        kept = []
        for i in sorted(range(n), key=places.__getitem__):
            if not any((i, j) in edges or (j, i) in edges for j in kept):
                kept.append(i)
        nodes = spark.createDataFrame([(i, places[i]) for i in range(n)], "id long, place long")
        got = E.first_independent(nodes, spark.createDataFrame([*edges, (0, 0)], "a long, b long"))
        assert sorted(r["id"] for r in got.collect()) == sorted(kept)


@pytest.mark.parametrize("most", [7, 200])
def test_store_equals_the_sequential_loop(spark, most):
    rng = random.Random(5)
    base = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randint(30, 120))) for _ in range(12)]
    rows = []
    for i in range(70):
        t = list(rng.choice(base))
        for _ in range(rng.randint(0, 9)):
            t[rng.randrange(len(t))] = rng.choice("xyz")
        rows.append((i, rng.choice([8.9, 9.0, 9.3, 9.3, 10.0]), "".join(t)))
    rows += [(100, 9.5, None), (101, 9.5, "")]
    shots = []
    for i, s, t in sorted((r for r in rows if r[1] >= 9 and r[2]), key=lambda r: (-r[1], r[0])):
        if not any(difflib.SequenceMatcher(None, t, b).ratio() > 0.9 for _, _, b in shots):
            shots.append((i, s, t))
            shots = sorted(shots, key=lambda r: -r[1])[:most]
    got = E.stored(spark.createDataFrame(rows, "id long, score double, t string"), most, block=20).orderBy("place").collect()
    assert [r["id"] for r in got] == [s[0] for s in shots] and 0 < len(shots) < 70


def test_normalised(spark):
    row = spark.createDataFrame([(" A B\n\nC ",)], "t string").select(E.normalised(F.col("t"))).head()
    assert row[0] == "a b c"


def test_a_group_of_exemplars_goes_through_a_text_at_once(monkeypatch):
    from tessera.operators import exemplars as X

    rng = random.Random(12)
    word = lambda n: "".join(rng.choice("abcd ž") for _ in range(n))
    texts = [word(rng.choice([0, 1, 7, 8, 9, 60, 300])) for _ in range(70)]
    group = X.Group(texts)
    for other in ["", "a", word(31), word(32), word(33), word(300)]:
        alone = [X.common(X.places(t), len(t), other, 0) for t in texts]
        assert group.common(other, np.zeros(len(texts))).tolist() == alone
    # Ruled out as a group, where each had been compared alone before.
    calls = []
    monkeypatch.setattr(X, "common", lambda *a: calls.append(a))
    held = X.Exemplars(list(range(70)), texts)
    for other in texts:
        want = [(i, r) for i, t in enumerate(texts) if (r := difflib.SequenceMatcher(None, other, t).ratio()) >= 0.75]
        assert sorted(held.alike(other, 0.75)) == want
    assert not calls


def test_lookup_uses_whole_texts(spark, tmp_path):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 8)))
    text = lambda n: " ".join(word() for _ in range(n))
    items = [(i, text(rng.randint(30, 250))) for i in range(20)] + [(50, None), (51, "ab")]
    docs = [(100, None), (101, "ab"), (102, "")]
    for i, t in items[:20]:
        docs.append((1000 + i, t.upper()))
        docs.append((2000 + i, t[:300] + text(200)))  # alike at the beginning alone
        docs.append((3000 + i, text(70) + t[300:] if len(t) > 1200 else text(300)))  # alike but for the beginning
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    kinds = {}
    for name, key in (("benchmark", "item_id"), ("documents", "doc_id")):
        kinds |= {(key, r[0]): r[1] for r in spark.read.parquet(f"{tmp_path}/{name}.parquet").select(key, T.block_type(F.col("text"))).collect()}
    whole = lambda t: re.sub(r"\s+", " ", t).strip().lower()
    want = set()
    for d, a in docs:
        near = [(i, difflib.SequenceMatcher(None, whole(a), whole(b)).ratio()) for i, b in items if a is not None and b is not None and kinds["item_id", i] == kinds["doc_id", d]]
        want |= {(d, i, r) for i, r in sorted(near, key=lambda x: (-x[1], x[0]))[:3] if r >= 0.75}
    got = {tuple(r) for r in catalog.QUERIES["exemplar_lookup"](spark, str(tmp_path)).collect()}
    assert got == want and len(want) >= 20


def test_long_texts_of_one_letter_are_not_lost(spark):
    frame = lambda rows: spark.createDataFrame(rows, "id long, t string")
    got = E.alike(frame([(1, "x" * 70_000), (2, "x" * 20), (3, None)]), frame([(7, "x" * 70_001), (8, None)]), 0.75)
    assert [(r["text_id"], r["exemplar_id"]) for r in got.collect()] == [(1, 7)]
    assert E.alike(frame([(1, "a")]), frame([(1, "a")]).limit(0), 0.75).collect() == []


def test_exemplars_of_many_characters_make_blocks(spark, monkeypatch):
    monkeypatch.setattr(E, "CHARACTERS", 100)
    rows = [(i, chr(97 + i) * 50) for i in range(20)]
    frame = spark.createDataFrame(rows, "id long, t string")
    got = E.alike(frame, frame, 0.75)
    assert sorted((r["text_id"], r["exemplar_id"]) for r in got.collect()) == [(i, i) for i in range(20)]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 10
