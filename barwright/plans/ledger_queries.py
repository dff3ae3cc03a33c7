"""What left the touch of books, accounted for by traded volume over time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.windows import near, near_sql
from ..operators.ledger import VOLUME, drops, settle
from ..operators.mechanisms import ramp
from ..sources.tables import TOUCHES, touches
from .registry import query

#: Days that drops and volumes of the snapshots wait for each other; the mechanism looks back as long.
LAG = 500
W = "OVER (PARTITION BY symbol ORDER BY dn, book)"
#: What left a side's best price since the snapshot before: all of it if the price is worse or gone, else what it lost.
DROP = {
    "bid": f"CASE WHEN lag(b1) {W} IS NULL OR b1 > lag(b1) {W} THEN 0.0 WHEN b1 IS NULL OR b1 < lag(b1) {W} THEN lag(bq) {W} ELSE greatest(lag(bq) {W} - bq, 0.0) END",
    "ask": f"CASE WHEN lag(a1) {W} IS NULL OR a1 < lag(a1) {W} THEN 0.0 WHEN a1 IS NULL OR a1 > lag(a1) {W} THEN lag(aq) {W} ELSE greatest(lag(aq) {W} - aq, 0.0) END",
}
EVENTS = f"""{TOUCHES}, moved AS (SELECT *, {DROP['bid']} AS bid, {DROP['ask']} AS ask FROM touches),
events_ AS (
  SELECT symbol, dn, book, 0 AS rank, 'volume' AS kind, CAST(vol AS DOUBLE) AS q FROM moved UNION ALL SELECT symbol, dn, book, 1, 'bid', bid FROM moved UNION ALL SELECT symbol, dn, book, 2, 'ask', ask FROM moved),
ev AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY dn, book, rank) AS i, max(dn) OVER (PARTITION BY symbol) AS last_dn FROM events_ WHERE q > 0),
steps AS (
  SELECT DISTINCT symbol, CAST(0 AS BIGINT) AS i, CAST([] AS STRUCT(i BIGINT, dn INTEGER, vol BOOLEAN, rem DOUBLE)[]) AS open, CAST([] AS STRUCT(i BIGINT, q DOUBLE)[]) AS taken FROM ev
  UNION ALL
  SELECT symbol, i, list_concat(list_filter(list_transform(live, lambda x, k: {{'i': x.i, 'dn': x.dn, 'vol': x.vol, 'rem': x.rem - t[k]}}), lambda x: x.rem > 1e-9),
      CASE WHEN q - coalesce(list_sum(t), 0) > 1e-9 THEN [{{'i': i, 'dn': dn, 'vol': vol, 'rem': q - coalesce(list_sum(t), 0)}}] ELSE [] END),
    CASE WHEN vol THEN list_filter(list_transform(live, lambda x, k: {{'i': x.i, 'q': t[k]}}), lambda x: x.q > 0) ELSE [{{'i': i, 'q': coalesce(list_sum(t), 0)}}] END
  FROM (
    SELECT *, list_transform(live, lambda x, k: CASE WHEN x.vol = vol THEN 0 ELSE greatest(0, least(x.rem, q - coalesce(list_sum(list_transform(live[1:k - 1], lambda y: y.rem)), 0))) END) AS t
    FROM (SELECT s.symbol, e.i, e.dn, e.kind = 'volume' AS vol, e.q, list_filter(s.open, lambda x: x.dn >= e.dn - {LAG}) AS live FROM steps s JOIN ev e ON e.symbol = s.symbol AND e.i = s.i + 1))),
traded AS (SELECT symbol, x.i AS i, sum(x.q) AS traded FROM (SELECT symbol, unnest(taken) AS x FROM steps) GROUP BY ALL),
ledger AS (
  SELECT symbol, dn, book, kind, q, coalesce(traded, 0) AS traded, CASE WHEN last_dn > dn + {LAG} THEN q - coalesce(traded, 0) ELSE 0 END AS pulled, CASE WHEN last_dn > dn + {LAG} THEN 0 ELSE q - coalesce(traded, 0) END AS open_
  FROM ev LEFT JOIN traded USING (symbol, i) WHERE kind <> 'volume')"""


def touch_drops(spark, sf_dir) -> DataFrame:
    """(symbol, dn, book, b1, bq, vol, kind, id, t, seq, quantity): volume and drops of all snapshots, as ``settle`` takes them."""
    moved = touches(spark, sf_dir).selectExpr("*", *[f"{e} AS {side}" for side, e in DROP.items()])
    each = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).cast("double").alias("quantity"), F.lit(i).alias("rank")) for i, (k, c) in enumerate([(VOLUME, "vol"), ("bid", "bid"), ("ask", "ask")])])
    return moved.select("symbol", "dn", "book", F.inline(each)).select("symbol", F.col("dn").alias("t"), F.struct("book", "rank").alias("seq"), "kind", F.col("book").alias("id"), "quantity")


@query(f"WITH RECURSIVE {EVENTS} SELECT symbol, book, kind AS side, q AS dropped, {near_sql('traded')} AS traded, {near_sql('pulled')} AS pulled, {near_sql('open_')} AS open FROM ledger")
def queue_ledger(spark, sf_dir):
    """Every drop of the best bid and ask: traded within the lag before or after it, pulled beyond, or still open."""
    d = drops(settle(touch_drops(spark, sf_dir), "symbol", LAG), "symbol")
    return d.select("symbol", F.col("id").alias("book"), F.col("kind").alias("side"), F.col("quantity").alias("dropped"), near("traded").alias("traded"), near("pulled").alias("pulled"), near("open").alias("open"))


#: Of the run of snapshots with the present best bid (within the lag): its first quantity, steps up and down.
RUN = f"PARTITION BY symbol, island ORDER BY dn RANGE BETWEEN {LAG} PRECEDING AND CURRENT ROW"
SHARES = {
    "fall": "greatest(q0 - bq, 0.0)",
    "pull_share": "CASE WHEN bq < q0 THEN greatest(greatest(q0 - bq - volume, 0.0) / nullif(q0, 0), least(coalesce(pulled, 0.0) / nullif(bq + coalesce(pulled, 0.0), 0), (q0 - bq) / nullif(q0, 0))) ELSE 0.0 END",
    "stack_share": "CASE WHEN bq > q0 THEN (bq - q0) / nullif(bq, 0) ELSE 0.0 END",
}
SCORE = f"{ramp('greatest(pull_share, stack_share)', 0.15, 0.75)} * (0.6 + 0.4 * coalesce(CAST(CASE WHEN pull_share >= stack_share THEN downs ELSE ups END AS DOUBLE) / nullif(ups + downs, 0), 0.0))"


@query(f"""WITH RECURSIVE {EVENTS}, l AS (SELECT symbol, dn, book, b1, bq, vol, coalesce(b1 <> lag(b1) {W} OR lag(b1) {W} IS NULL, true) AS fresh FROM touches WHERE b1 IS NOT NULL),
n AS (SELECT *, sum(fresh::INT) {W} AS island FROM l), s AS (SELECT *, CASE WHEN NOT fresh AND bq > lag(bq) {W} THEN 1 ELSE 0 END AS up, CASE WHEN NOT fresh AND bq < lag(bq) {W} THEN 1 ELSE 0 END AS down, CASE WHEN fresh THEN 0.0 ELSE vol END AS own FROM n),
r AS (SELECT *, first_value(bq) OVER ({RUN}) AS q0, sum(up) OVER ({RUN}) AS ups, sum(down) OVER ({RUN}) AS downs, sum(own) OVER ({RUN}) AS volume FROM s),
p AS (SELECT r.symbol, r.book, sum(g.pulled) AS pulled FROM r JOIN ledger g ON g.symbol = r.symbol AND g.kind = 'bid' AND g.dn + {LAG} <= r.dn AND g.dn + {LAG} >= r.dn - {LAG} GROUP BY ALL),
x AS (SELECT *, {', '.join(f'{e} AS {n}' for n, e in SHARES.items())} FROM r LEFT JOIN p USING (symbol, book))
SELECT symbol, book, {near_sql('pull_share')} AS pull_share, {near_sql('stack_share')} AS stack_share, {near_sql(SCORE)} AS score, CASE WHEN {near_sql(SCORE)} = 0 THEN 0 WHEN pull_share >= stack_share THEN -1 ELSE 1 END AS direction FROM x""")
def queue_pull_stack(spark, sf_dir):
    """The best bid's queue at an unchanged price: the share pulled (volume and ledger deducted) or stacked, weighed by how steadily."""
    entries = settle(touch_drops(spark, sf_dir), "symbol", LAG).where("kind = 'bid' AND entry = 'pulled'")
    rows = touches(spark, sf_dir).where("b1 IS NOT NULL").select("symbol", "dn", "book", "b1", "bq", "vol")
    l = rows.selectExpr("*", f"coalesce(b1 <> lag(b1) {W} OR lag(b1) {W} IS NULL, true) AS fresh").selectExpr("*", f"sum(CAST(fresh AS INT)) {W} AS island")
    steps = {"up": f"CASE WHEN NOT fresh AND bq > lag(bq) {W} THEN 1 ELSE 0 END", "down": f"CASE WHEN NOT fresh AND bq < lag(bq) {W} THEN 1 ELSE 0 END", "own": "CASE WHEN fresh THEN 0.0 ELSE vol END"}
    s = l.selectExpr("*", *[f"{e} AS {n}" for n, e in steps.items()])
    run = Window.partitionBy("symbol", "island").orderBy("dn").rangeBetween(-LAG, 0)
    # The first of the frame's first day by book, as rows of one day come in any order.
    q0 = F.min(F.struct("dn", "book", "bq")).over(run)["bq"]
    r = s.select("symbol", "dn", "book", "bq", q0.alias("q0"), F.sum("up").over(run).alias("ups"), F.sum("down").over(run).alias("downs"), F.sum("own").over(run).alias("volume"))
    # Pulls of the last LAG days at each snapshot: both in one frame by time.
    both = r.unionByName(entries.select("symbol", F.col("at").cast("int").alias("dn"), F.col("quantity").alias("pull")), allowMissingColumns=True)
    recent = Window.partitionBy("symbol").orderBy("dn").rangeBetween(-LAG, 0)
    x = both.withColumn("pulled", F.sum("pull").over(recent)).where("book IS NOT NULL").selectExpr("*", *[f"{e} AS {n}" for n, e in SHARES.items()])
    score = near(F.expr(SCORE))
    direction = F.when(score == 0, 0).when(F.col("pull_share") >= F.col("stack_share"), -1).otherwise(1)
    return x.select("symbol", "book", near("pull_share").alias("pull_share"), near("stack_share").alias("stack_share"), score.alias("score"), direction.alias("direction"))
