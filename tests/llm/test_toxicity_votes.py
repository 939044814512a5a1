import numpy as np

from tessaria.llm import toxicity as T


def test_votes_are_those_of_all_examples():
    """What a posting tells lies with it, and a vote from opened blocks is that of a look at every example."""
    rng = np.random.default_rng(4)
    terms = np.arange(300, dtype=np.int64) * 11
    rows = []
    for d in range(120):
        t = np.unique(rng.choice(terms[: 300 if d % 2 else 150], size=rng.integers(1, 60)))
        rows.append((d, d % 2, t, rng.integers(1, 5, len(t)).astype(np.int32), d % 10 < 7))
    learn, held = ([x for x in rows if x[4] == part] for part in (True, False))
    index = T._index(terms, 1 + rng.random(300), learn, held, {0: 1.0, 1: 1.0}, 0.5, 8, 20)
    assert len(index.tells) == len(index.postings) == index.many.sum()
    place = {int(d): k for k, d in enumerate(index.ids)}
    full = np.zeros((len(index.ids), len(terms)))
    for d, _, t, n, _ in learn:
        i, w = index.vector(t, n)
        full[place[d], i] = w
    for d, _, t, n, _ in held:
        i, w = index.vector(t, n)
        cosine, told = full[:, i] @ w, full[:, i] @ (w * index.telling[i])
        at = np.argsort(-cosine, kind="stable")[:20]
        at = at[cosine[at] > 0]
        got = index.nearest(i, w)
        assert np.allclose(np.sort(got[1]), np.sort(cosine[at])) and np.allclose(told[got[0]], got[2])
