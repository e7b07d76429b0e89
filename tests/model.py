"""Plain-Python models of operators, for comparison."""

import math
import random

Z = 1.959963984540054


def wilson(k, n):
    if n == 0:
        return 1.0
    p = k / n
    return min(1.0, (p + Z * Z / (2 * n) + Z * math.sqrt(p * (1 - p) / n + Z * Z / (4 * n * n))) / (1 + Z * Z / n))


def fold_state(history, p):
    """State after (direct, reuse) pairs at threshold 0.5, one by one."""
    state, n, b, h, g, gain = "candidate", 0, 0, 0, 0, 0.0
    for d, r in history:
        n, gain = n + 1, gain + r - d
        good, ok = d >= 0.5, r >= 0.5
        b, h, g = b + (not good and ok), h + (good and not ok), g + (good and ok)
        if state == "quarantine":
            continue
        if h >= p.quarantine_at_harm_count:
            state = "quarantine"
        elif (
            state == "candidate" and n >= p.promotion_min_observations and h + g >= p.promotion_min_direct_good_observations and b >= p.promotion_min_benefits
            and gain / n > p.promotion_min_mean_gain and wilson(h, h + g) <= p.promotion_max_wilson_breakage_upper_bound
        ):
            state = "active"
    return state


def histories(count, seed):
    rnd = random.Random(seed)
    return {f"e{i}": [(rnd.randint(0, 8) / 8, rnd.randint(0, 8) / 8) for _ in range(rnd.randint(1, 9))] for i in range(count)}
