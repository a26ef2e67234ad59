"""p-values from a handful of already aggregated counts.

The counting itself is done by Spark; these helpers turn a few totals, read as
one row, into a probability.
"""

from __future__ import annotations

import math

# Largest sample for which the exact distribution is used.
EXACT_U_GROUP = 8
EXACT_TAU_SIZE = 33


def normal_tail(z: float) -> float:
    """P(Z >= z)."""
    return 0.5 * math.erfc(z / math.sqrt(2.0))


def u_counts(n1: int, n2: int) -> list[int]:
    """Number of arrangements of n1 and n2 items for each U from 0 to n1 * n2.

    The generating function is the Gaussian binomial of (n1 + n2, n1).
    """
    top = n1 * n2
    ways = [0] * (top + 1)
    ways[0] = 1
    for k in range(1, n1 + 1):
        step = n2 + k
        for u in range(top, step - 1, -1):
            ways[u] -= ways[u - step]
        for u in range(k, top + 1):
            ways[u] += ways[u - k]
    return ways


def u_form(n1: int, n2: int, tie_sum: float) -> str:
    """The published rule: exact for up to 8 items in the smaller group and no ties, else normal."""
    return "exact" if min(n1, n2) <= EXACT_U_GROUP and tie_sum == 0 else "normal"


def u_greater_p(u: float, n1: int, n2: int, tie_sum: float, form: str | None = None) -> float:
    """One-sided p that the first group tends to be larger.

    ``tie_sum`` is the sum of t^3 - t over groups of t equal values; ``form`` is "exact" or "normal", by default as
    ``u_form`` says.  The exact form's work grows with n1 * n1 * n2.
    """
    small, large = min(n1, n2), max(n1, n2)
    if (form or u_form(n1, n2, tie_sum)) == "exact":
        ways = u_counts(small, large)
        return min(1.0, sum(ways[math.ceil(u):]) / sum(ways))
    n = n1 + n2
    spread = n1 * n2 / 12.0 * ((n + 1) - tie_sum / (n * (n - 1.0)))
    if spread <= 0:
        return 1.0
    return min(1.0, max(0.0, normal_tail((u - n1 * n2 / 2.0 - 0.5) / math.sqrt(spread))))


def _exact_tau_p(n: int, discordant: int) -> float:
    """Two-sided p from the number of permutations with so few inversions."""
    pairs = n * (n - 1) // 2
    few = min(discordant, pairs - discordant)
    if 4 * few == n * (n - 1):
        return 1.0
    if n > 170:  # n! exceeds a double; only few <= 1 gets here
        return 0.0
    ways = [1] + [0] * few
    for size in range(2, n + 1):
        window, out = 0, []
        for k in range(few + 1):
            window += ways[k]
            if k >= size:
                window -= ways[k - size]
            out.append(window)
        ways = out
    return min(1.0, 2.0 * sum(ways) / math.factorial(n))


def tau_b(n: int, discordant: int, x_ties: int, y_ties: int, both_ties: int) -> float | None:
    """Kendall's tau-b from pair counts; null when one side is constant."""
    pairs = n * (n - 1) // 2
    if x_ties == pairs or y_ties == pairs:
        return None
    balance = pairs - x_ties - y_ties + both_ties - 2 * discordant
    tau = balance / math.sqrt(pairs - x_ties) / math.sqrt(pairs - y_ties)
    return max(-1.0, min(1.0, tau))


def tau_p(n, discordant, x_ties, y_ties, both_ties, x_moments, y_moments, form: str | None = None) -> float | None:
    """Two-sided p of tau-b.

    ``*_moments`` are (sum t(t-1)(t-2), sum t(t-1)(2t+5)) over tie groups; ``form`` is "exact" or "normal", by default
    exact without ties up to a size and where nearly all pairs agree.
    """
    pairs = n * (n - 1) // 2
    if x_ties == pairs or y_ties == pairs:
        return None
    untied = x_ties == 0 and y_ties == 0 and (n <= EXACT_TAU_SIZE or min(discordant, pairs - discordant) <= 1)
    if form == "exact" or (form is None and untied):
        return _exact_tau_p(n, discordant)
    balance = pairs - x_ties - y_ties + both_ties - 2 * discordant
    m = n * (n - 1.0)
    spread = (m * (2 * n + 5) - x_moments[1] - y_moments[1]) / 18.0 + 2.0 * x_ties * y_ties / m
    if n > 2:
        spread += x_moments[0] * y_moments[0] / (9.0 * m * (n - 2))
    return min(1.0, 2.0 * normal_tail(abs(balance) / math.sqrt(spread)))
