"""What both language models share: the modified Kneser-Ney discounts."""

from __future__ import annotations

import numpy as np


def discounts(counts_of_counts) -> np.ndarray:
    """What to take off counts 0, 1, 2 and 3 or more, from how many n-grams occur 1 to 4 times.

    Where the table is too small for the estimate, the discount falls back to half a
    count, so every context keeps some mass for words it has not seen.
    """
    n = [0.0, *(float(x or 0) for x in counts_of_counts)]
    y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.0
    out = [0.0]
    for k in (1, 2, 3):
        d = k - (k + 1) * y * n[k + 1] / n[k] if n[k] and y else 0.0
        out.append(d if 0.0 < d <= k else 0.5)
    return np.array(out)


def off(counts: np.ndarray, taken: np.ndarray) -> np.ndarray:
    """Discounted counts."""
    return np.maximum(counts - taken[np.minimum(counts, 3)], 0.0)
