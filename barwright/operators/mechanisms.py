"""Mechanism scores: how much a symbol's recent prints look like a named market behaviour, each in [0, 1].

One pass of range windows per symbol gives the features; a score is an expression over them, so all scores of a print
are one projection. ``UNIT`` scales the windows to the tape's own pace. Only mechanisms that prints alone show are
here; those that need queue positions, limit states or an index basket are not.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.windows import near

UNIT = 86_400
#: Windows in units.
WINDOWS = {"s": 1, "m": 3, "l": 10}
#: Lifecycle: a score at or above the first starts a phase, one below the second ends it, and it is confirmed after so many seconds.
ACTIVE, RELEASE, CONFIRM = 0.60, 0.25, 43_200


def ramp(x: str, low: float, high: float) -> str:
    """0 at ``low``, 1 at ``high``, linear between; null counts as 0."""
    return f"coalesce(least(greatest(({x} - {low}) / {high - low}, 0.0), 1.0), 0.0)"


def div(a: str, b: str) -> str:
    return f"(({a}) / nullif({b}, 0))"


MOVE_S, MOVE_L = f"({div('ps', 'pl')} - 1)", f"({div('value', 'pl')} - 1)"
FLAT = f"(1 - {ramp(f'abs({MOVE_S})', 0.1, 0.6)})"
BUSY, QUIET = ramp(div("CAST(ns AS DOUBLE) * 10", "nl"), 1.0, 3.0), f"(1 - {ramp(div('CAST(ns AS DOUBLE) * 10', 'nl'), 1.0, 3.0)})"
BUY, SELL = ramp("fm", 0.1, 0.7), ramp("-fm", 0.1, 0.7)
LARGE = ramp(div("CAST(k AS DOUBLE)", "kl"), 1.0, 2.0)

#: Score of each mechanism over the features below.
MECHANISMS = {
    "liquidity_sweep": f"{ramp(f'abs({MOVE_L})', 0.5, 2.0)} * {LARGE}",
    "failed_sweep": f"{ramp(div('mx', 'pl'), 2.0, 4.0)} * {ramp(div('pl', 'value'), 1.0, 2.0)}",
    "exhaustion": f"{BUSY} * {FLAT} * {ramp(div('sdl', 'pl'), 0.3, 1.0)}",
    "passive_accumulation": f"{ramp('-fs', 0.0, 0.6)} * {FLAT} * {ramp('fl', 0.0, 0.4)}",
    "passive_distribution": f"{ramp('fs', 0.0, 0.6)} * {FLAT} * {ramp('-fl', 0.0, 0.4)}",
    "participation_footprint": f"(1 - {ramp(div('skl', 'kl'), 0.3, 0.8)}) * {ramp('CAST(nl AS DOUBLE)', 8.0, 20.0)}",
    "metaorder_trajectory": f"{ramp('abs(fl)', 0.1, 0.5)} * {ramp('abs(fm)', 0.1, 0.7)} * CASE WHEN sign(fl) = sign(fm) THEN 1.0 ELSE 0.0 END",
    "block_absorption": f"{LARGE} * (1 - {ramp(f'abs({MOVE_L})', 0.1, 0.6)})",
    "inventory_rebalancing": f"CASE WHEN sign(fs) <> sign(fl) THEN 1.0 ELSE 0.0 END * {ramp('abs(fs)', 0.2, 0.8)} * {FLAT}",
    "churn_anomaly": f"{BUSY} * {FLAT}",
    "liquidity_run": f"{ramp(f'abs({MOVE_S})', 0.5, 1.5)} * {BUSY}",
    "ignition": f"{ramp(MOVE_S, 0.2, 1.0)} * {BUSY} * {BUY}",
    "flow_impact_divergence": f"{ramp('abs(fm)', 0.2, 0.8)} * {FLAT}",
    "compression_expansion": f"{ramp(div('sds', 'sdl'), 1.0, 2.0)}",
    "false_breakout": f"CASE WHEN mx > value * 2 AND ps < pl THEN 1.0 ELSE 0.0 END * {ramp('-fs', 0.0, 0.5)}",
    "stealth_accumulation": f"{BUY} * {QUIET} * {FLAT}",
    "stealth_distribution": f"{SELL} * {QUIET} * {FLAT}",
    "absorption": f"{ramp(div('CAST(vs AS DOUBLE)', 'kl'), 1.0, 4.0)} * {FLAT}",
    "order_splitting": f"(1 - {ramp(div('sks', 'ks'), 0.1, 0.5)}) * {ramp('CAST(ns AS DOUBLE)', 2.0, 4.0)}",
    "accumulation_like": f"greatest({BUY} * {QUIET} * {FLAT}, {ramp('fl', 0.1, 0.5)} * {FLAT})",
    "distribution_like": f"greatest({SELL} * {QUIET} * {FLAT}, {ramp('-fl', 0.1, 0.5)} * {FLAT})",
    "ofi_state": f"{ramp('abs(fs)', 0.3, 1.0)}",
    "trade_churn_repetition": f"(1 - {ramp(div('sdl', 'pl'), 0.2, 1.0)}) * {ramp('CAST(nl AS DOUBLE)', 8.0, 20.0)}",
}


def features_sql() -> list[str]:
    """Features as SQL over (symbol, sec, value, k, side); the same text runs on any engine with range frames.

    Means and deviations come from sums of whole cents and counts, which are exact whatever the order of summing.
    """
    cents = "CAST(floor(value * 100 + 0.5) AS BIGINT)"
    out = []
    for name, units in WINDOWS.items():
        w = f"OVER (PARTITION BY symbol ORDER BY sec RANGE BETWEEN {units * UNIT} PRECEDING AND CURRENT ROW)"
        n, mean = f"count(*) {w}", lambda x: f"CAST(sum({x}) {w} AS DOUBLE) / count(*) {w}"
        spread = lambda x: f"sqrt(CAST({n} * sum({x} * {x}) {w} - sum({x}) {w} * sum({x}) {w} AS DOUBLE)) / {n}"
        out += [
            f"{n} AS n{name}", f"sum(k) {w} AS v{name}", f"sum(side * k) {w} / nullif(sum(k) {w}, 0) AS f{name}", f"{mean(cents)} / 100 AS p{name}",
            f"{spread(cents)} / 100 AS sd{name}", f"{mean('CAST(k AS BIGINT)')} AS k{name}", f"{spread('CAST(k AS BIGINT)')} AS sk{name}",
        ]
        if name == "l":
            out += [f"max(value) {w} AS mx"]
    return out


def scores(prints: DataFrame) -> DataFrame:
    """All scores for prints (symbol, event_id, sec, value, k, side); rows stay."""
    f = prints.selectExpr("*", *features_sql())
    return f.select("symbol", "event_id", "sec", *[near(F.expr(e)).alias(n) for n, e in MECHANISMS.items()])


def lifecycle(scored: DataFrame, names: list[str]) -> DataFrame:
    """(symbol, event_id, mechanism, score, phase, age): phases NONE, BUILDING, ACTIVE, CONFIRMED by the scores so far.

    A phase is on from the last score at or above ``ACTIVE`` unless one below ``RELEASE`` came since; its age counts
    from the first score of the phase. Hysteresis is the last decisive row, so no row is visited in a loop.
    """
    long = scored.unpivot(["symbol", "event_id", "sec"], names, "mechanism", "score")
    w = Window.partitionBy("mechanism", "symbol").orderBy("sec", "event_id")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    mark = F.when(F.col("score") >= ACTIVE, True).when(F.col("score") < RELEASE, False)
    on = long.withColumn("on", F.coalesce(F.last(mark, True).over(so_far), F.lit(False)))
    on = on.withColumn("start", F.col("on") & ~F.coalesce(F.lag("on").over(w), F.lit(False)))
    on = on.withColumn("since", F.last(F.when(F.col("start"), F.col("sec")), True).over(so_far))
    age = F.when(F.col("on"), F.col("sec") - F.col("since"))
    phase = F.when(F.col("on") & (age >= CONFIRM), "CONFIRMED").when(F.col("on"), "ACTIVE").when(F.col("score") >= 0.35, "BUILDING").otherwise("NONE")
    return on.select("symbol", "event_id", "mechanism", "score", phase.alias("phase"), age.alias("age"))
