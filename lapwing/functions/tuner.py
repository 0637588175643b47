"""A user's weights and reading patterns as one fold over ratings and interactions in event order.

A piece of a user's events becomes a summary that says what it does to any state before it: running means are affine maps,
calibration and serendipity weights increasing piecewise linear maps, and an interaction that sets the weights from the
patterns makes all earlier weights irrelevant. Summaries are applied one after the other, so pieces can be folded apart;
a stream folds what a micro-batch released and applies that to its state.
"""

from __future__ import annotations

from bisect import bisect_right
from hashlib import md5

# fixed values of the tuner
DEFAULTS = {"lambda": 0.5, "alpha": 0.5, "beta": 0.3, "confidence": 0.0}
LEARNING_RATE, CONFIDENCE_STEP, SHIFT = 0.1, 0.05, 0.1
GOOD, BAD = 0.7, 0.3
MIN_INTERACTIONS, MIN_SHOWN = 10, 5
DWELL_CAP, SWITCH_FACTOR = 60.0, 5

SAME = (1.0, 0.0)
IDENTITY = ((0.0, 1.0), (0.0, 1.0))
#: Steps of a map that differ by less are one: far below the digits of any result.
FLAT = 1e-14


def draw(user, n: int, seed: int = 42) -> float:
    """Seeded stand-in for U(.3, .7): the hash of seed, user and feedback number."""
    return 0.3 + 0.4 * int(md5(f"{seed}|{user}|{n}".encode()).hexdigest()[:8], 16) / 2**32


def moved(old: float, good: bool) -> float:
    """A weight after a good or a bad rating, smoothed."""
    target = min(1.0, old + SHIFT) if good else max(0.0, old - SHIFT)
    return (1 - LEARNING_RATE) * old + LEARNING_RATE * target


def then_moved(line: tuple, good: bool) -> tuple:
    """The map `line`, followed by a rating: points are added where the clamp begins to hold, and equal steps dropped."""
    xs, ys = line
    edge = 1 - SHIFT if good else SHIFT
    i = bisect_right(ys, edge)
    if 0 < i < len(ys) and ys[i - 1] < edge:
        at = xs[i - 1] + (xs[i] - xs[i - 1]) * (edge - ys[i - 1]) / (ys[i] - ys[i - 1])
        xs, ys = (*xs[:i], at, *xs[i:]), (*ys[:i], edge, *ys[i:])
    ys = tuple(moved(y, good) for y in ys)
    if len(ys) > 64:
        keep = [j for j in range(len(ys)) if j in (0, len(ys) - 1) or ys[j] - ys[j - 1] > FLAT]
        xs, ys = tuple(xs[j] for j in keep), tuple(ys[j] for j in keep)
    return xs, ys


def value_at(line: tuple, x: float) -> float:
    xs, ys = line
    if len(xs) == 1:
        return ys[0]
    i = min(max(bisect_right(xs, x), 1), len(xs) - 1)
    return ys[i - 1] + (x - xs[i - 1]) * (ys[i] - ys[i - 1]) / (xs[i] - xs[i - 1]) if xs[i] > xs[i - 1] else ys[i]


def preference_of(dwell: float, skip: float, switches: int, total: int) -> float:
    return 0.4 * min(1.0, dwell / DWELL_CAP) + 0.3 * (1 - skip) + 0.3 * min(1.0, switches / total * SWITCH_FACTOR)


def implied_weights(preference: float) -> tuple[float, float, float]:
    return 1.0 - preference * 0.6, 0.3 + preference * 0.4, 0.2 + preference * 0.4


class Fold:
    """What a run of one user's events does. It starts after `total` interactions and `rated` ratings, of which the last
    click had the category `last[0]` (None: no click yet)."""

    def __init__(self, user, total: int = 0, rated: int = 0, last: tuple | None = None):
        self.user, self.total, self.rated, self.last = user, total, rated, last
        self.switches, self.dwell, self.skip = 0, SAME, SAME
        self.weights_from = None
        self.lam, self.alpha, self.beta = SAME, IDENTITY, IDENTITY
        if not total and not rated:  # the weights before are known
            self.alpha, self.beta = (((DEFAULTS[c],), (DEFAULTS[c],)) for c in ("alpha", "beta"))

    def add(self, action: str, value: float, label: str | None) -> None:
        """One event: `rate` with the rating and the algorithm, `dwell` with seconds, `skip`, or `click` with the category."""
        if action == "rate":
            self.rate(label, value)
        else:
            self.act(action, value, label)

    def act(self, action: str, seconds: float, category: str | None) -> None:
        t = self.total
        if action == "dwell":
            self.dwell = (self.dwell[0] * t / (t + 1), (self.dwell[1] * t + seconds) / (t + 1))
        elif action == "skip":
            self.skip = (self.skip[0] * t / (t + 1), (self.skip[1] * t + 1.0) / (t + 1))
        elif action == "click":
            self.switches += self.last is not None and self.last[0] != category
            self.last = (category,)
        self.total = t + 1
        if self.total > MIN_INTERACTIONS:
            self.weights_from = (*self.dwell, *self.skip, self.switches, self.total)
            self.lam, self.alpha, self.beta = SAME, IDENTITY, IDENTITY

    def rate(self, algorithm: str, rating: float) -> None:
        good, bad = rating > GOOD, rating < BAD
        if algorithm in ("mmr", "xquad") and not good:
            m, b = self.lam
            keep = 1 - LEARNING_RATE
            self.lam = ((keep - LEARNING_RATE) * m, (keep - LEARNING_RATE) * b + LEARNING_RATE) if bad else (keep * m, keep * b + LEARNING_RATE * draw(self.user, self.rated))
        elif algorithm == "calibrated" and (good or bad):
            self.alpha = then_moved(self.alpha, good)
        elif algorithm == "serendipity" and (good or bad):
            self.beta = then_moved(self.beta, good)
        self.rated += 1

    def summary(self) -> dict:
        out = {"total": self.total, "rated": self.rated, "switches": int(self.switches), "dwell": self.dwell, "skip": self.skip, "weights_from": self.weights_from}
        return out | {"lam": self.lam, "alpha_x": self.alpha[0], "alpha_y": self.alpha[1], "beta_x": self.beta[0], "beta_y": self.beta[1]}


def start() -> dict:
    """State of a user without events."""
    return {"lambda": DEFAULTS["lambda"], "alpha": DEFAULTS["alpha"], "beta": DEFAULTS["beta"], "confidence": 0.0, "feedback_count": 0, "avg_dwell_time": 0.0, "skip_rate": 0.0, "category_switches": 0, "total_interactions": 0}


def resumed(state: dict, s: dict) -> dict:
    """The state after the events of a summary."""
    weights = state["lambda"], state["alpha"], state["beta"]
    if s["weights_from"] is not None:
        dm, db, sm, sb, switches, total = s["weights_from"]
        weights = implied_weights(preference_of(dm * state["avg_dwell_time"] + db, sm * state["skip_rate"] + sb, state["category_switches"] + int(switches), int(total)))
    return {
        "lambda": s["lam"][0] * weights[0] + s["lam"][1],
        "alpha": value_at((s["alpha_x"], s["alpha_y"]), weights[1]),
        "beta": value_at((s["beta_x"], s["beta_y"]), weights[2]),
        "confidence": min(1.0, CONFIDENCE_STEP * s["rated"]),
        "feedback_count": s["rated"],
        "avg_dwell_time": s["dwell"][0] * state["avg_dwell_time"] + s["dwell"][1],
        "skip_rate": s["skip"][0] * state["skip_rate"] + s["skip"][1],
        "category_switches": state["category_switches"] + s["switches"],
        "total_interactions": s["total"],
    }
