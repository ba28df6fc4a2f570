"""Two small models, written by hand, for tests, examples and queries; they are no judgement of real URLs."""

from __future__ import annotations

import numpy as np

from lynceus.functions.features import FEATURES
from lynceus.operators.scoring import ModelDocument

def _stump(f: int, t: float, low: float, high: float, missing: int = 0, default_left: bool = True) -> dict:
    return {"f": [f], "t": [t], "l": [-1], "r": [-2], "d": [default_left], "m": [missing], "v": [(low + high) / 2], "lv": [low, high]}


def offline_model() -> ModelDocument:
    """Three trees over length, marks and host shape, with Platt calibration."""
    deep = {"f": [1, 2], "t": [0.5, 2.5], "l": [-1, -2], "r": [1, -3], "d": [True, False], "m": [0, 2], "v": [0.1, 0.4], "lv": [-0.6, 0.2, 0.9]}
    return ModelDocument.from_json({
        "meta": {"calibration_base_rate": 0.4712}, "features": ["url_len", "scheme_http", "n_params", "sus_words_path", "host_n_labels", "tld_logit"], "init_score": -0.2,
        "trees": [_stump(0, 45.5, -0.5, 0.6), deep, _stump(3, 0.5, -0.2, 1.1), _stump(4, 2.5, -0.4, 0.3), _stump(5, 0.0, -0.3, 0.5, missing=1)],
        "calibration": {"type": "platt", "a": 1.7, "b": 0.1}, "thresholds": {"fraud": 0.8, "legit": 0.2}, "tld_table": {"com": 0.45, "net": 0.6, "org": 0.2, "example": 0.5}, "tld_prior": 0.5,
    })


def second_model() -> ModelDocument:
    """A correction by domain age and mail records."""
    return ModelDocument.from_json({
        "meta": {"calibration_base_rate": 0.4712}, "features": ["domain_age_days_log", "dns_has_mx", "dns_n_a"], "init_score": 0.0,
        "trees": [_stump(0, 2.0, 1.4, -0.9, missing=2, default_left=False), _stump(1, 0.5, 0.3, -0.3, missing=2), _stump(2, 1.5, 0.1, -0.1, missing=2)],
        "calibration": {"type": "platt", "a": 1.5, "b": 0.0}, "thresholds": {"fraud": 0.85, "legit": 0.15},
    })


def large_model(trees: int = 400, leaves: int = 15, seed: int = 0) -> ModelDocument:
    """A model as large as a real one, over all features, drawn from a seed; its judgements mean nothing."""
    rng, names = np.random.default_rng(seed), [*FEATURES, "tld_logit"]
    top = np.array([1.0 if n.endswith("ratio") else 5.0 if n.endswith(("entropy", "logit")) else 60.0 if n.endswith("_len") else 4.0 for n in names])

    def tree() -> dict:
        """Grown leaf by leaf: a leaf picked at random becomes a split."""
        t: dict[str, list] = {k: [] for k in ("f", "t", "l", "r", "d", "m", "v")}
        ends: list[tuple[int, str]] = []
        for i in range(leaves - 1):
            if i:
                parent, side = ends.pop(int(rng.integers(len(ends))))
                t[side][parent] = i
            f = int(rng.integers(len(names)))
            for k, v in (("f", f), ("t", float(rng.random() * top[f])), ("l", 0), ("r", 0), ("d", bool(rng.random() < 0.5)), ("m", 2), ("v", float(rng.normal(0, 0.02)))):
                t[k].append(v)
            ends += [(i, "l"), (i, "r")]
        for k, (parent, side) in enumerate(ends):
            t[side][parent] = ~k
        return t | {"lv": rng.normal(0, 0.05, leaves).tolist()}

    return ModelDocument.from_json({
        "meta": {"calibration_base_rate": 0.4712}, "features": names, "init_score": 0.0, "trees": [tree() for _ in range(trees)], "calibration": {"type": "platt", "a": 1.2, "b": 0.0},
        "thresholds": {"fraud": 0.8, "legit": 0.2}, "tld_table": {"com": 0.45, "net": 0.6, "org": 0.2, "example": 0.5}, "tld_prior": 0.5,
    })
