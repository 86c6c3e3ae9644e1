"""Embedding join, Merkle manifest and conversation trie against plain versions."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from tessera.llm import _scan, embeddings, merkle, trie
from tests.llm.small import SCHEMA, corpus, frame


def _same(got, want):
    key = lambda x: tuple((v is None, str(v)) for v in x)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


# Vectors


def plain_links(rows, least=0.9):
    width = max([len(v) for _, v in rows if v is not None] or [1])
    unit, good = np.zeros((len(rows), width)), np.zeros(len(rows), bool)
    for i, (_, v) in enumerate(rows):
        if v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v):
            x = np.array(v, float)
            x /= np.abs(x).max()
            unit[i, : len(x)], good[i] = x / np.linalg.norm(x), True
    near = (unit @ unit.T >= least) & good[:, None] & good[None, :]
    np.fill_diagonal(near, False)
    order = lambda i: (rows[i][0] is None, rows[i][0] or 0)
    least_of, out = {}, []
    for i in sorted(range(len(rows)), key=order):
        work = [] if i in least_of else [i]
        while work:
            j = work.pop()
            if j not in least_of:
                least_of[j] = rows[i][0]
                work += np.flatnonzero(near[j]).tolist()
    for i, (vec_id, _) in enumerate(rows):
        out.append((vec_id, int(near[i].sum()), least_of[i], vec_id == least_of[i]))
    return out


def _vectors(spark, rows):
    full = [(i, v, "x", 1) for i, v in rows]
    return spark.createDataFrame(full, "vec_id long, embedding array<double>, unit string, node int").repartition(3)


def test_vectors_with_awkward_cases(spark):
    rng = np.random.default_rng(1)
    base = rng.standard_normal(16)
    rows = [(i, (base + 0.1 * rng.standard_normal(16)).tolist()) for i in range(30)]
    rows += [(100, None), (101, []), (102, [0.0] * 16), (103, [float("nan")] + [1.0] * 15), (104, [None, 1.0]), (105, [float("inf"), 1.0]), (None, base.tolist())]
    rows += [(110, base.tolist()), (111, (base * 3).tolist()), (112, (base * 1e300).tolist()), (113, (base * 1e-300).tolist()), (114, [1.0, 2.0]), (115, [2.0, 4.0])]
    rows += [rows[0], (7, rows[3][1])]
    _same(embeddings.link_vectors(_vectors(spark, rows)).collect(), plain_links(rows))
    assert embeddings.link_vectors(_vectors(spark, rows).limit(0)).count() == 0


@pytest.mark.parametrize("spread", [0.16, 0.35])
def test_clouds_around_the_threshold_equal_brute_force(spark, monkeypatch, spread):
    # Small cells and chunks: many cells, hot cells in several chunks, undecided pairs of balls.
    monkeypatch.setattr(embeddings, "CELL", 32)
    monkeypatch.setattr(embeddings, "CHUNK", 16)
    rng = np.random.default_rng(int(spread * 100))
    centres = rng.standard_normal((6, 24))
    rows = [(i, (centres[i % 6 if i % 2 else 0] + spread * rng.standard_normal(24)).tolist()) for i in range(300)]
    rows += [(1000 + i, rng.standard_normal(24).tolist()) for i in range(200)]
    rows += [(2000 + i, rows[0][1]) for i in range(40)]
    want = plain_links(rows)
    assert sum(w[1] for w in want) > 500
    _same(embeddings.link_vectors(_vectors(spark, rows)).collect(), want)


def test_a_group_of_copies_is_not_compared_pair_by_pair(spark):
    rng = np.random.default_rng(4)
    base = rng.standard_normal(32)
    rows = [(i, (base + 0.02 * rng.standard_normal(32)).tolist()) for i in range(400)]
    made = embeddings.units(_column(rows), 32)[0]
    nodes = spark.createDataFrame([(i, 1, 0.0, bytearray(x.astype("<f8").tobytes())) for i, x in enumerate(made)], embeddings._NODE)
    balls, members = embeddings._balls(nodes, made.mean(axis=0) * 0, 32)
    assert balls.count() < 60 and balls.agg({"weight": "sum"}).head()[0] == 400
    assert members.count() + balls.count() == 400 and members.select("node").distinct().count() == members.count()


def _column(rows):
    import pyarrow as pa

    return pa.array([v for _, v in rows], pa.list_(pa.float64()))


def test_rotation_and_blocks_keep_distances():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((50, 64))
    made, good = embeddings.units(_column([(0, v.tolist()) for v in x]), 64)
    plain = x / np.linalg.norm(x, axis=1)[:, None]
    assert good.all() and np.allclose(made @ made.T, plain @ plain.T, atol=1e-12)
    assert embeddings.spans(64) == [(0, 16), (16, 32), (32, 48), (48, 64)] and embeddings.spans(2) == [(0, 1), (1, 2)]


# Scan


def test_scan_of_a_group_over_many_partitions(spark):
    rng = random.Random(3)
    rows = [("hot", i, rng.randrange(-(2**62), 2**62)) for i in range(3000)] + [(g, i, i) for g in (None, "a", "zz") for i in range(20)]
    table = spark.createDataFrame(rows, "g string, i int, x long").repartition(7)
    from pyspark.sql import functions as F

    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        got = {w: {(r["g"], r["i"]): (r["n"], r["s"] % 2**64) for r in _scan.scan(table, "g", [F.col("i")], "x", w, "n", "s", "t").collect()} for w in (False, True)}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    for weighted in (False, True):
        sums = {}
        for g, i, x in sorted(rows, key=lambda r: (str(r[0]), r[1])):
            sums[g] = (sums.get(g, 0) + x * (pow(_scan.BASE, i + 1, 2**64) if weighted else 1)) % 2**64
            assert got[weighted][g, i] == (i + 1, sums[g])
    assert _scan.powers(np.array([-2, 3]))[0] * _scan.powers(np.array([2]))[0] == 1


# Merkle


def _h(xs):
    return hashlib.sha256("".join(xs).encode()).hexdigest()


def plain_manifest(rows):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda d, s, lang, n, t: _h(map(field, (d, s, lang, n, t)))
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

    def tree(nodes):
        paths, at = [[] for _ in nodes], list(range(len(nodes)))
        while len(nodes) > 1:
            for i, k in enumerate(at):
                run = nodes[k // 8 * 8 : k // 8 * 8 + 8]
                paths[i].append((k % 8, run[: k % 8] + run[k % 8 + 1 :]))
            at, nodes = [k // 8 for k in at], [_h(nodes[k : k + 8]) for k in range(0, len(nodes), 8)]
        return nodes[0], paths

    by = {}
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r))):
        by.setdefault(r[2], []).append(r)
    order = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    trees = {x: tree([leaf(*r) for r in by[x]]) for x in order}
    root, tops = tree([trees[x][0] for x in order])
    out = []
    for x, top in zip(order, tops, strict=True):
        for r, path in zip(by[x], trees[x][1], strict=True):
            tampered = zlib.crc32(b"" if r[0] is None else str(r[0]).encode()) % 3 == 0 and r[4] is not None
            fold = leaf(*r[:4], r[4].translate(low)) if tampered else leaf(*r)
            for k, siblings in path + top:
                fold = _h(siblings[:k] + [fold] + siblings[k:])
            out.append((r[0], leaf(*r), trees[x][0], root, _h(s for _, ss in path + top for s in ss), fold, fold == root))
    return out


@pytest.mark.parametrize("langs", [1, 3, 11, 70])
def test_manifest(spark, langs):
    rows = corpus(60, langs)
    names = [None, *(chr(0xFF5E - i) + "l\U0001f600"[: i % 3] for i in range(langs - 1))]
    # Languages of one row, of exactly eight, and of many.
    full = [(d, t and "Ab" + t, names[i % langs if i % 3 else 0], f"s{i % 2}" if i % 5 else None, len(t) + 2 if t else None, "x", "k", "t", 7) for i, (d, t) in enumerate(rows)]
    want = plain_manifest([(d, s, lang, n, t) for d, t, lang, s, n, *_ in full])
    table = spark.createDataFrame(full, SCHEMA).repartition(5)
    got = merkle.manifest(table).collect()
    _same(got, want)
    assert 0 < sum(r["verified"] for r in got) < len(got)
    assert merkle.manifest(table.limit(0)).count() == 0


def test_manifest_of_one_row_and_of_full_levels(spark):
    for n in (1, 8, 9, 64, 65, 513):
        rows = [(i, "s", "en", 3, f"Text {i}") for i in range(n)]
        table = spark.createDataFrame([(d, t, lang, s, k) for d, s, lang, k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
        _same(merkle.manifest(table).collect(), plain_manifest(rows))


# Trie


def plain_trie(rows):
    convs = {}
    for c, t, r, x in rows:
        if c is not None:
            convs.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    convs = {c: [v[2:] for v in sorted(vs, key=lambda v: v[:2])] for c, vs in convs.items()}
    built = {}
    for c, v in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = convs.get(c - c % 5, [])[:h] + v[h:]
    nodes = {}
    for c, v in built.items():
        for d in range(len(v) + 1):
            nodes.setdefault(tuple(v[:d]), []).append(c)
    children, below, out = {}, {}, []
    for p in nodes:
        if p:
            children.setdefault(p[:-1], []).append(p)
    for p in sorted(nodes, key=len, reverse=True):
        own = (len(nodes[p]) - 1) * len(p[-1][1].encode()) if p else 0
        kids = children.get(p, [])
        below[p] = (sum(below[k][0] for k in kids) or 1, own + sum(below[k][1] for k in kids))
        ends = ",".join(map(str, sorted(c for c in nodes[p] if len(built[c]) == len(p))))
        out.append((min(nodes[p]), len(p), min(nodes[p[:-1]]) if p else None, len(nodes[p]), len(kids), *below[p], _h([ends])))
    return out


def _conversations(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, key string, depth int").repartition(4)


def _talk(seed, n, long=0):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        length = long if c == 7 else rng.randint(1, 12)
        rows += [(c, t if t else rng.choice([None, 0]), rng.choice(["user", "assistant", None]), rng.choice(["", None, "a", "ä", "Ab", "abc " * 3])) for t in range(length)]
    rows = [r for r in rows if r[0] % 11 != 5] + [(None, 0, "user", "x"), (-3, 0, "user", "a"), (-5, 0, "user", "a"), (n + 90, 0, "user", "a")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("bits", [64, 3, 0])
def test_trie(spark, bits):
    # Few bits: turns and prefixes collide all the time and must be told apart by what they say.
    rows = _talk(bits, 40 if bits else 12)
    if not bits:
        bits = 1
    _same(trie.prefix_trie(_conversations(spark, rows), bits, bits).collect(), plain_trie(rows))


def test_trie_of_a_long_conversation_and_of_copies(spark, monkeypatch):
    rows = _talk(9, 20, 600) + [(1000 + c, t, "user", f"same {t}") for c in range(300) for t in range(3)]
    _same(trie.prefix_trie(_conversations(spark, rows)).collect(), plain_trie(rows))
    assert trie.prefix_trie(_conversations(spark, rows).limit(0)).count() == 0
    assert trie.prefix_trie(_conversations(spark, [(None, 1, "user", "x")])).count() == 0


def test_ends_in_many_pieces(spark, monkeypatch):
    ends = spark.range(20_000).selectExpr("1L AS depth", "7L AS key", "id AS conv").repartition(3)
    assert trie._pieces(ends).count() > 1
    got = trie._digests(ends).collect()
    assert [r["ends_sha256"] for r in got] == [_h([",".join(map(str, range(20_000)))])]


def test_a_vector_is_in_one_cell_however_many_it_reaches(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "CELL", 16)
    rng = np.random.default_rng(6)
    made = embeddings.units(_column([(0, x.tolist()) for x in rng.standard_normal((400, 16))]), 16)[0]
    nodes = spark.createDataFrame([(i, 1, 0.0, bytearray(x.astype("<f8").tobytes())) for i, x in enumerate(made)], embeddings._NODE)
    cells = embeddings._cells(nodes, made.mean(axis=0), 16).collect()
    held = np.concatenate([np.frombuffer(r["nodes"], "<i8") for r in cells])
    assert sorted(held.tolist()) == list(range(400)) and len(cells) >= 13
    assert all(len(r["units"]) == 16 * len(r["nodes"]) <= 32 * 8 * 16 for r in cells)
