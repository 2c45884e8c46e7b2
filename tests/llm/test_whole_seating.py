"""Seating in blocks takes as many tables as seating one after another."""

import numpy as np
import pytest

from polyview.llm import pitman_yor


def test_blocks_have_no_bias(monkeypatch):
    n = np.full(4000, 8192)
    mean = lambda new: pitman_yor.seated(n, np.full(len(n), new), 0.5, np.random.default_rng(5)).mean()
    got = {new: mean(new) for new in (2.0, 60.0)}
    monkeypatch.setattr(pitman_yor, "EXACT", 1 << 20)
    for new, x in got.items():
        assert x == pytest.approx(mean(new), rel=0.015)
