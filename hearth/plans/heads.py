"""Deterministic heads used by the registered queries.

No trained weights ship with the workload, so the evaluation queries use a head
generated from a rule that both Spark and the SQL oracle can reproduce.
"""

from __future__ import annotations

import numpy as np

# The head rule  w[c][j] = ((c*31 + j*17 + r*7) % 23 - 11) / 11.0
# (c = class, j = feature index, r = round; round 0 is the base head, no bias).
HEAD_C, HEAD_J, HEAD_R, HEAD_MOD, HEAD_SHIFT = 31, 17, 7, 23, 11


def fixed_head(num_classes: int = 10, width: int = 64, round_: int = 0) -> np.ndarray:
    c = np.arange(num_classes)[:, None]
    j = np.arange(width)[None, :]
    return ((c * HEAD_C + j * HEAD_J + round_ * HEAD_R) % HEAD_MOD - HEAD_SHIFT) / float(HEAD_SHIFT)


def class_names(num_classes: int = 10) -> list[str]:
    return [f"class_{i}" for i in range(num_classes)]
