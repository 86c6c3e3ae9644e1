import base64
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

import public_tokenizers
from tessera.llm import _bytes, bpe, decontam, language_model, line_dedup, near_dups, sharding, toxicity
from tests.llm.small import words

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def pieces():
    return bpe.PieceCache(bpe.load_ranks(RANKS))


def _encode(texts, pieces):
    data, offsets = _bytes.string_parts(pa.array(texts, pa.string()))
    return [np.frombuffer(x, "<u4").tolist() for x in bpe.encode_block(data, offsets, pieces)]


def test_bpe_equals_the_library(library, pieces):
    rng = random.Random(1)
    alphabet = list("abcdelmrstvLE'' \n\t0123.,!?-é 　ßǅ٣Ⅳ🙂日\x1c\x85")
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    texts += ["".join(rng.choice("'sretlvmd \n") for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    texts += ["", " ", "a" * 5000, " " * 300 + "x", "don't we'll they've I'd 'S", "x" * 39, "x" * 41]
    assert _encode(texts, pieces) == [library.encode_ordinary(t) for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=80))
def test_bpe_of_any_text(library, pieces, text):
    ids = _encode([text], pieces)[0]
    assert ids == library.encode_ordinary(text)
    assert bpe.decode(np.array(ids, "<u4").tobytes(), bpe.load_ranks(RANKS)) == text.encode()


def test_bpe_knows_every_codepoint(library, pieces):
    texts = ["a" + chr(c) + "1" for c in range(0, 0x3100) if not 0xD800 <= c < 0xE000]
    assert _encode(texts, pieces) == [library.encode_ordinary(t) for t in texts]


@pytest.mark.parametrize("n", [1, 2, 3, 17, 40, 1000, 4097])
def test_permutation_and_its_inverse(n):
    places = sharding.permute(np.arange(n), n, 3)
    assert sorted(places.tolist()) == list(range(n))
    assert (sharding.permute(places, n, 3, back=True) == np.arange(n)).all()
    assert sharding.row_at(0, 0, n, 1, 3) == int(np.flatnonzero(places == 0)[0])


def _edit(a, b):
    previous = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(previous[j] + 1, row[-1] + 1, previous[j - 1] + (x != y)))
        previous = row
    return previous[-1]


def test_banded_alignment_against_the_full_table():
    rng = random.Random(2)
    pairs, limits = [], []
    for _ in range(300):
        a = [rng.randint(1, rng.choice([3, 50])) for _ in range(rng.randint(0, 60))]
        b = list(a)
        for _ in range(rng.randint(0, 20)):
            at = rng.randint(0, len(b))
            b[at : at + rng.randint(0, 1)] = [rng.randint(1, 50)] * rng.randint(0, 1)
        pairs.append((np.array(a, np.uint64), np.array(b, np.uint64)))
        limits.append(rng.randint(0, 40))
    for (a, b), limit, d in zip(pairs, limits, map(near_dups.edit_distance, *zip(*pairs, strict=True), limits), strict=True):
        exact = _edit(a.tolist(), b.tolist())
        assert d == exact if exact <= limit else d > limit


def test_myers_against_the_full_table():
    rng = random.Random(3)
    for _ in range(300):
        item = [rng.randint(0, 4) for _ in range(rng.randint(1, 90))]
        passage = [rng.randint(0, 4) for _ in range(rng.randint(0, 60))]
        row = [0] * (len(passage) + 1)
        for i, x in enumerate(item, 1):
            new = [i]
            for j, y in enumerate(passage, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        assert decontam.least_distance(np.array(item, np.uint64), np.array(passage, np.uint64)) == min(row)


def test_order_minhash_heeds_order():
    rng = np.random.default_rng(4)
    text = rng.integers(0, 2**60, 300, dtype=np.uint64)
    near, swapped = text.copy(), np.concatenate([text[150:], text[:150]])
    near[[40, 200]] = 7
    both = np.concatenate([text, near, swapped])
    made = near_dups.sketches(both, np.repeat(np.arange(3), 300), 3)
    same = (made[0] == made[1]).mean(), (made[0] == made[2]).mean()
    assert same[0] > 0.6 and same[1] < same[0]


def test_patience_blocks():
    assert line_dedup.patience([1, 2, 3, 4, 9], [7, 1, 2, 8, 4, 9]) == [(0, 1), (1, 2), (3, 4), (4, 5)]
    later = [(0, 5, 3), (1, 6, 3), (4, 9, 4)]
    assert line_dedup.common_blocks(later, [(2, 5), (3, 6), (9, 9)]) == [0, 1]


def test_learned_weights_follow_the_held_out_counts():
    # Bucket 1: bigrams predict everything; bucket 2: bigrams never match.
    rows = np.array([[1, 1, 60, 100], [2, 0, 20, 100]])
    weights = language_model.learn_weights(rows, 1000)
    assert weights[1, 0] > 0.95 and weights[2, 0] < 0.01 and weights[0, 0] == 0
    assert np.allclose(weights.sum(axis=1), 1)


def test_roles_match_crc():
    for i in (0, 1, 17, 12345, None):
        crc = zlib.crc32(b"" if i is None else str(i).encode())
        assert (language_model.role(i) == language_model.UNSEEN) == (crc % 7 == 2)


def test_pu_learning_finds_the_marked_words():
    rng = np.random.default_rng(5)
    clean = [np.unique(rng.integers(100, 4000, 40)) for _ in range(1500)]
    toxic = [np.append(np.unique(rng.integers(100, 4000, 40)), rng.integers(0, 5)) for _ in range(400)]
    model = toxicity.train(toxic[:200], clean[:900] + toxic[200:300], prior=0.1)
    score = lambda texts: np.array([model.scores(np.zeros(len(x), int), x.astype(int), 1)[0] for x in texts])
    assert (score(toxic[300:]) >= 0.3).mean() > 0.9 and (score(clean[900:]) >= 0.3).mean() < 0.05


def test_word_spans_match_the_pattern():
    texts = [None, "", " a\tb\x0bc\x0c", "é\x1cx y", "\n\n", "last"]
    data, offsets = _bytes.string_parts(pa.array(texts, pa.string()))
    starts, ends, rows = _bytes.word_spans(data, offsets)
    raw = data.tobytes()
    got = [(int(r), raw[a:b].decode()) for a, b, r in zip(starts, ends, rows, strict=True)]
    assert got == [(i, w) for i, t in enumerate(texts) for w in words(t)]
    hashes = _bytes.word_hashes(data, starts, ends)
    assert len(set(hashes.tolist())) == len({w for _, w in got})


def test_rarest_words_and_bitmaps_keep_all_pairs_that_may_be_linked():
    rng = np.random.default_rng(23)
    order = rng.integers(0, 255, 1 << near_dups.ORDER_BITS).astype(np.uint8)
    each = []
    for n in (1, 2, 4, 5, 9, 16, 17, 40, 128, 129, 300):
        text = rng.integers(0, max(2, n // 2), n).astype(np.uint64)  # words come again
        for _ in range(6):
            other = text.copy()
            other[rng.choice(n, n // 5, replace=False)] = rng.integers(1000, 2000, n // 5)
            each += [text[: n - n // 5], other]
    sizes = np.array([len(w) for w in each])
    runs, at = near_dups._labelled_runs(np.concatenate(each), np.repeat(np.arange(len(each)), sizes), len(each), 1)
    first, rows = near_dups.rarest(runs, at, sizes, order)
    bits = [near_dups.bitmap(runs[at == i], n) for i, n in enumerate(sizes.tolist())]
    every = np.arange(len(each))
    i, j, more = near_dups.slack(bits, sizes, every, every)
    judged = dict(zip(zip(i.tolist(), j.tolist(), strict=True), more.tolist(), strict=True))
    assert len(judged) == len(i)
    bags, rare = [set(runs[at == x].tolist()) for x in every], [set(first[rows == x].tolist()) for x in every]
    linked = 0
    for a in range(len(each)):
        for b in range(len(each)):
            longest = max(sizes[a], sizes[b])
            over = len(bags[a] & bags[b]) - (longest - int(longest * 0.2 + 1e-9))
            if over >= 0:
                linked += 1
                assert rare[a] & rare[b] and judged[a, b] >= over
    assert 300 < linked < len(judged) <= len(each) ** 2
