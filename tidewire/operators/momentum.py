"""Story momentum, trend with hysteresis, lifecycle and observation intervals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewire.functions.numbers import saturating

# Weights of the momentum parts, and seconds to the next observation by state.
WEIGHTS = {"velocity": 0.25, "acceleration": 0.20, "breadth": 0.20, "arrivals": 0.15, "persistence": 0.10, "freshness": 0.10}
BY_TREND = {"BREAKING": 60, "SURGING": 180, "EARLY_SIGNAL": 300}
BY_STATE = {"discovered": 600, "watching": 600, "rising": 300, "breaking": 60, "peaking": 600, "cooling": 1800, "stale": 3600, "archived": 86400}
# Transitions that the lifecycle declares.
TRANSITIONS = {
    "discovered": ["watching", "rising", "breaking", "stale"], "watching": ["rising", "breaking", "cooling", "stale"],
    "rising": ["breaking", "peaking", "cooling"], "breaking": ["peaking", "cooling"], "peaking": ["cooling", "rising", "breaking"],
    "cooling": ["stale", "rising"], "stale": ["archived", "rising", "watching"], "archived": ["rising"],
}


def normal_velocity(x: Column) -> Column:
    """Unknown and 0 both count as one half."""
    return F.when(F.coalesce(x, F.lit(0.0)) == 0, 0.5).otherwise(x)


def momentum(velocity, acceleration, independent, independent_15, persistence, freshness) -> Column:
    acc = F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.5 + 0.5 * F.coalesce(acceleration, F.lit(0.0)))), 4)
    parts = {
        "velocity": normal_velocity(velocity), "acceleration": acc, "breadth": F.round(saturating(independent), 4),
        "arrivals": F.least(F.lit(1.0), independent_15 / 3), "persistence": F.least(F.lit(1.0), F.least(F.lit(10), persistence) / 6), "freshness": freshness,
    }
    total = sum((parts[k] * w for k, w in WEIGHTS.items()), F.lit(0.0))
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)), 4)


def confidence(snapshots, independent, freshness) -> Column:
    c = 0.40 * F.least(F.lit(1.0), snapshots / 6) + 0.40 * F.least(F.lit(1.0), independent / 3) + 0.20 * freshness
    return F.round(F.greatest(F.lit(0.1), c), 4)


def trend(current, mom, acc, independent, items, sure, samples) -> Column:
    """The next trend state; those already breaking, surging or rising leave at a lower bar than they enter."""
    stay = lambda s, bar: (current == s) & (mom >= bar)
    return (
        F.when(stay("BREAKING", 0.75) | ((current != "BREAKING") & (((mom >= 0.85) & (sure >= 0.40) & (samples >= 2)) | ((acc >= 0.40) & (independent >= 3) & (mom >= 0.75)))), "BREAKING")
        .when(stay("SURGING", 0.65) | ((mom >= 0.75) & (acc >= 0.05)), "SURGING")
        .when(stay("RISING", 0.50) | ((mom >= 0.60) & (acc >= 0)), "RISING")
        .when((acc >= 0.15) & (independent >= 2) & (sure >= 0.35) & (items <= 5), "EARLY_SIGNAL")
        .when((items >= 8) & (acc <= -0.15), "SATURATED")
        .when((acc <= -0.10) & (mom < 0.45), "COOLING")
        .otherwise("NORMAL")
    )


def lifecycle(state, trend_state, mom, acc, age_seconds, material=None) -> Column:
    material = F.lit(False) if material is None else material
    return (
        F.when(material & state.isin("cooling", "stale", "archived"), "rising")
        .when(trend_state == "BREAKING", "breaking")
        .when(trend_state.isin("RISING", "SURGING"), F.when(state == "breaking", "peaking").otherwise("rising"))
        .when((trend_state == "EARLY_SIGNAL") & state.isin("discovered", "stale"), "watching")
        .when(state.isin("breaking", "rising") & (acc < -0.15), "peaking")
        .when((state == "peaking") & (mom < 0.50), "cooling")
        .when((state == "cooling") & (age_seconds > 43_200) & (mom < 0.30), "stale")
        .when((state == "stale") & (age_seconds > 259_200), "archived")
        .when(state == "discovered", "watching")
        .otherwise(state)
    )


def observation_interval(state, trend_state) -> Column:
    out = F.lit(600)
    for s, n in BY_STATE.items():
        out = F.when(state == s, n).otherwise(out)
    for t, n in BY_TREND.items():
        out = F.when(trend_state == t, n).otherwise(out)
    return out


def fold_states(steps: Column) -> Column:
    """The trend and lifecycle after an ordered array of steps (mom, acc, independent, items, sure, samples, age)."""
    start = F.struct(F.lit("NORMAL").alias("trend"), F.lit("discovered").alias("state"))

    def step(s, x):
        t = trend(s["trend"], x["mom"], x["acc"], x["independent"], x["items"], x["sure"], x["samples"])
        return F.struct(t.alias("trend"), lifecycle(s["state"], t, x["mom"], x["acc"], x["age"]).alias("state"))

    return F.aggregate(steps, start, step)


def fast_path(trend_state, material, seconds_since_last) -> Column:
    return (trend_state.isin("BREAKING", "EARLY_SIGNAL") | material) & (seconds_since_last.isNull() | (seconds_since_last >= 300))


def illegal_transition(before, after) -> Column:
    ok = before == after
    for s, to in TRANSITIONS.items():
        ok = ok | ((before == s) & after.isin(*to))
    return ~ok
