"""Properties of the operators' inner steps, on generated inputs."""

import re

import numpy as np
import pyarrow as pa
from hypothesis import assume, given, settings
from hypothesis import strategies as st

from quireflow.llm import embedding_dedup, minhash_dedup, packing, sharding, trigrams, words

literal = st.text("abcd", min_size=1, max_size=6)
piece = st.recursive(
    st.one_of(literal, st.sampled_from(["[ab]", "[a-z]+", "x*", "c?", "\\d+"])),
    lambda inner: st.one_of(st.lists(inner, min_size=1, max_size=3).map("".join), st.lists(inner, min_size=2, max_size=3).map(lambda p: f"(?:{'|'.join(p)})"), inner.map(lambda p: f"(?:{p})+"), inner.map(lambda p: f"(?:{p})?")),
    max_leaves=6,
)


@settings(max_examples=200, deadline=None)
@given(piece, st.lists(st.one_of(literal, st.text("abcdx1 ", max_size=8)), max_size=8))
def test_a_match_always_satisfies_its_trigram_query(pattern, parts):
    text = "".join(parts)
    assume(re.search(pattern, text))
    for clause in trigrams.query(pattern):
        assert any(all(g in text for g in conjunction) for conjunction in clause)


def plain_components(link, ids):
    label = {i: i for i in ids}
    for _ in ids:
        for a in range(len(ids)):
            for b in range(len(ids)):
                if link[a][b]:
                    low = min(label[ids[a]], label[ids[b]])
                    label[ids[a]] = label[ids[b]] = low
    return label


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sets(st.integers(0, 12), min_size=1), min_size=1, max_size=12), st.sampled_from([50, 80, 100]))
def test_set_blocks(sets, percent):
    ids = np.array([7 * i % 31 for i in range(len(sets))])
    a, b = minhash_dedup.block_links(ids, pa.array([sorted(s) for s in sets], pa.list_(pa.int64())), percent)
    link = [[100 * len(x & y) >= percent * len(x | y) for y in sets] for x in sets]
    want = plain_components(link, ids.tolist())
    got = dict(zip(ids.tolist(), ids.tolist())) | dict(zip(a.tolist(), b.tolist()))
    assert got == want


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 14), st.integers(0, 6))
def test_vector_blocks(seed, n, second):
    r = np.random.default_rng(seed)
    x = r.standard_normal((n + second, 2))
    x /= np.linalg.norm(x, axis=1)[:, None]
    reps, copies = r.permutation(100)[: n + second].astype(np.int64), r.integers(1, 4, n + second)
    keys = r.integers(0, 2, (n + second, 3))
    side = np.array([1] * n + [2] * second) if second else np.zeros(n, int)
    met, count, root = embedding_dedup.block_links(1, side, reps, copies, keys, x, 0.9)
    link = (x @ x.T >= 0.9) & (keys[:, 0][:, None] != keys[:, 0][None, :])
    if second:
        link &= side[:, None] != side[None, :]
    np.fill_diagonal(link, False)
    assert count.tolist() == (link @ copies).tolist() and (met == (count > 0)).all()
    want = plain_components(link.tolist(), reps.tolist())
    assert all(root[i] == want[int(reps[i])] for i in range(len(reps)) if met[i])


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.lists(st.integers(1, 9), min_size=1, max_size=8))
def test_small_vector_blocks_side_by_side(seed, sizes):
    r = np.random.default_rng(seed)
    n, cuts = sum(sizes), np.cumsum([0, *sizes])
    x = r.standard_normal((n, 2))
    x /= np.linalg.norm(x, axis=1)[:, None]
    reps, copies, keys = r.permutation(100)[:n].astype(np.int64), r.integers(1, 4, n), r.integers(0, 2, (n, 3))
    side, table = r.integers(1, 3, n), np.repeat(r.integers(0, 3, len(sizes)), sizes)
    keys[np.arange(n), table] = 7  # a block's rows agree in its table
    for i, j in zip(cuts, cuts[1:]):
        if r.integers(2):  # else two blocks meet, of which one may be empty
            side[i:j] = 0
    met, count, root = embedding_dedup.small_links(np.array(sizes), table, side, reps, copies, keys, x, 0.9)
    for i, j in zip(cuts, cuts[1:]):
        one = embedding_dedup.block_links(int(table[i]), side[i:j], reps[i:j], copies[i:j], keys[i:j], x[i:j], 0.9)
        assert met[i:j].tolist() == one[0].tolist() and count[i:j].tolist() == one[1].tolist() and root[i:j][met[i:j]].tolist() == one[2][one[0]].tolist()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=60))
def test_packing_windows(lengths):
    lengths = np.array(lengths, np.int64)
    window, offset = packing.best_fit_decreasing(lengths, 50)
    for w in set(window.tolist()):
        own = sorted((int(offset[i]), int(lengths[i])) for i in np.flatnonzero(window == w))
        assert [o for o, _ in own] == np.cumsum([0, *[n for _, n in own]])[:-1].tolist() and sum(n for _, n in own) <= 50
    full = np.bincount(window, lengths) if len(lengths) else np.zeros(0)
    assert len(full) < 2 or sorted(full)[0] + sorted(full)[1] > 50  # no two windows could be one


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 30), min_size=1, max_size=8), st.integers(1, 6), st.integers(0, 999))
def test_matrices(sources, shards, seed):
    per = sharding.blocks_a_shard(sum(sources), shards, 4)
    targets = sharding.block_sizes(sum(sources), shards, per).tolist()
    m = sharding.communication_matrix(sources, targets, seed)
    assert m.sum(axis=1).tolist() == sources and m.sum(axis=0).tolist() == targets and max(targets) <= 4
    whole = np.array(targets).reshape(shards, per).sum(axis=1)
    assert whole.max() - whole.min() <= 1


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text("aB é\t\n\x0b!", max_size=12)), max_size=8))
def test_word_bounds(texts):
    data, offs = words.utf8(pa.array(texts, pa.string()))
    s, e, first = words.bounds(data, offs)
    raw = data.tobytes()
    assert [[raw[s[j] : e[j]] for j in range(first[i], first[i + 1])] for i in range(len(texts))] == [(t or "").encode().split() for t in texts]
    h = words.word_hashes(data, s, e)
    k = words.rolling(h, 2)
    at = words.starts_within(first, 2)
    pairs = [(raw[s[i] : e[i]], raw[s[i + 1] : e[i + 1]]) for i in at]
    assert len(set(pairs)) == len(set(k[at].tolist()))
