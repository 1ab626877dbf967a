"""A scorer lives on between tasks and batches, and keeps its scores."""

import numpy as np

from ledgerlens.llm import toxicity


def test_scorer_is_kept_and_scores_alike():
    rng = np.random.default_rng(2)
    net = toxicity.Windows(*(np.append(rng.normal(size=toxicity.BUCKETS), 0) for _ in range(2)))
    assert toxicity.scorer_of(net) is toxicity.scorer_of(net)
    texts = [b" ".join(b"w%d" % rng.integers(3000) for _ in range(rng.integers(0, 200))) for _ in range(120)]
    kept, brief = toxicity.scorer_of(net), toxicity.Scorer(net, most=50)
    tables = set()
    for a in range(0, 120, 10):
        some = texts[a : a + 10]
        want = np.vstack([toxicity.Scorer(net).summaries([t]) for t in some])
        assert np.allclose(kept.summaries(some), want, atol=1e-4) and np.allclose(brief.summaries(some), want, atol=1e-4)
        tables.add(id(kept.room))
    # the table grows a few times, not with each batch
    assert len(tables) < 9 and len(brief.known) < len(kept.known)
