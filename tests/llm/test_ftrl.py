"""The learner against FTRL-proximal written out coordinate by coordinate."""
import math

import numpy as np
import pytest

from screenloom.llm import ftrl


def plain(examples, epochs, l1):
    z, n = {}, {}

    def weight(k, bound):
        s = z.get(k, 0.0)
        if abs(s) <= bound:
            return 0.0
        return (math.copysign(bound, s) - s) / ((ftrl.BETA + math.sqrt(n.get(k, 0.0))) / ftrl.ALPHA + ftrl.L2)

    rng = np.random.default_rng(11)
    for _ in range(epochs):
        for i in rng.permutation(len(examples)):
            y, at = examples[i]
            keys = [(int(k), l1) for k in at] + [("bias", 0.0)]
            own = {k: weight(k, bound) for k, bound in keys}
            g = 1 / (1 + math.exp(-sum(own.values()))) - y
            for k, w in own.items():
                old = n.get(k, 0.0)
                z[k] = z.get(k, 0.0) + g - (math.sqrt(old + g * g) - math.sqrt(old)) / ftrl.ALPHA * w
                n[k] = old + g * g
    return {k: weight(k, 0.0 if k == "bias" else l1) for k in z}


@pytest.mark.parametrize("epochs,l1", [(1, 0.0), (4, 0.5), (3, 2.0)])
def test_learner_is_ftrl(monkeypatch, epochs, l1):
    monkeypatch.setattr(ftrl, "L1", l1)
    rng = np.random.default_rng(epochs)
    examples = []
    for i in range(60):
        at = rng.choice(40, size=rng.integers(0, 9), replace=False)
        examples.append((float(3 in at or rng.random() < 0.2), at.astype(np.int64)))
    w, bias = ftrl.learn(examples, epochs)
    want = plain(examples, epochs, l1)
    assert bias == pytest.approx(want.pop("bias"))
    assert {int(k): w[k] for k in np.flatnonzero(w)} == pytest.approx({k: v for k, v in want.items() if v})
    assert w[3] > 0 and (l1 == 0.0 or (w[:40] == 0).any())
