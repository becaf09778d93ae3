"""Where single tokens stand in two sets decides whether the search gives out a pair that shares them."""

import numpy as np
import pyarrow as pa
import pytest

from tideline.llm import op09_jaccard, postings, textkernel


def _met(sets, t):
    """{(a, b): (meetings, need)} of the search in a single bucket, a and b counting in sets."""
    tokens = np.concatenate([np.sort(textkernel.mix64(np.array(sorted(s), np.uint64)) >> np.uint64(16)) for s in sets])
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    fp, size, _ = op09_jaccard.fingerprints(tokens, row, len(sets))
    counter = postings.Counter(16)
    counter.add(tokens)
    counter._settle()
    rank = np.minimum(255, np.log2(1.0 + counter.cells) * postings.SCALE).astype(np.uint8)
    packer, batches, number, met = postings.Packer(), [], {x: i for i, x in enumerate(fp.tolist())}, {}
    for (keys, at, roles, _, _), need, _ in op09_jaccard.signatures(tokens, row, size, rank, t):
        batches += packer.add(keys, np.zeros(len(keys), np.int64), at, roles, fp, size, need)
    for made in postings.meet(pa.Table.from_batches([*batches, *packer.flush()]).to_batches(), t):
        for a, b, w, need in zip(*(x.to_pylist() for x in made.columns)):
            pair = tuple(sorted((number[a], number[b])))
            met[pair] = (met.get(pair, (0, 0))[0] + w, need)
    return met


@pytest.mark.parametrize("t, most", [(0.5, 12_000), (0.7, 2000)])
def test_chance_pairs_of_large_sets_are_not_given_out(t, most):
    """Sets of unlike sizes that share a few tokens of a small universe, some of them near copies."""
    r = np.random.default_rng(3)
    sets = [frozenset((30_000 * r.random(n) ** 2).astype(int).tolist()) for n in r.integers(60, 400, 400)]
    sets += [frozenset(x for x in s if r.random() > 0.15) | {40_000 + 2 * i, 40_001 + 2 * i} for i, s in enumerate(sets[:40])]
    met = _met(sets, t)
    similar = {(i, j) for j in range(len(sets)) for i in range(j) if len(sets[i] & sets[j]) >= t * len(sets[i] | sets[j]) - 1e-12}
    assert len(similar) >= 30
    assert all(pair in met and met[pair][0] >= met[pair][1] for pair in similar)
    assert len(met) < most, len(met)


def test_places_at_their_bounds():
    """The first tokens in common are as far back as they can be: all that is left is shared."""
    for t in (0.5, 0.7, 0.9):
        for small in (3, 9, 40, 333):
            for large in range(small, int(small / t) + 1):
                least = int(postings.shared(np.array([large]), np.array([small]), t)[0])
                if least > small:
                    continue
                for size in (large, small):
                    for k in range(min(postings.SPARE + 1, least)):
                        role = postings.placed(np.array([size - least + k]), np.array([size]), t)
                        other = postings.placed(np.array([0]), np.array([large + small - size]), t)
                        pair = (role, other) if size == large else (other, role)
                        assert postings._early(*pair, np.array([large]), np.array([small]), t).all()
