"""Levels that hold their size, and symbols that follow others of their sector."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.windows import near, near_sql
from ..operators.lags import best_lag, lagged_correlations, on_grid, steps
from ..operators.persistence import held_since
from ..sources.tables import BARS, SNAPSHOTS, bars, snapshots, table
from .registry import query

W = "OVER (PARTITION BY symbol ORDER BY dn, book)"


def level_observations(spark, sf_dir) -> DataFrame:
    """(symbol, side, price, rn, dn, book, qty): every level of every snapshot, and a quantity of 0 in the first one that lacks it."""
    w = Window.partitionBy("symbol").orderBy("dn", "book")
    s = snapshots(spark, sf_dir).withColumns({"rn": F.row_number().over(w), "next_dn": F.lead("dn").over(w)})
    rows = None
    for side in ("bid", "ask"):
        part = s.select("symbol", "dn", "rn", "next_dn", "book", F.lit(side).alias("side"), F.inline(side + "s"))
        rows = part if rows is None else rows.unionByName(part)
    again = F.lead("rn").over(Window.partitionBy("symbol", "side", "price").orderBy("rn"))
    gone = rows.withColumn("again", again).where("next_dn IS NOT NULL AND (again IS NULL OR again > rn + 1)")
    gone = gone.select("symbol", "side", "price", (F.col("rn") + 1).alias("rn"), F.col("next_dn").alias("dn"), F.lit(None).cast("long").alias("book"), F.lit(0.0).alias("qty"))
    return rows.select("symbol", "side", "price", "rn", "dn", "book", "qty").unionByName(gone)


@query(f"""WITH {SNAPSHOTS}, r AS (SELECT *, row_number() {W} AS rn, lead(dn) {W} AS next_dn FROM snaps),
l AS (SELECT symbol, side, price, rn, dn, next_dn, book, qty, lead(rn) OVER (PARTITION BY symbol, side, price ORDER BY rn) AS again FROM r JOIN levels USING (book)),
o AS (SELECT symbol, side, price, rn, dn, book, qty FROM l UNION ALL SELECT symbol, side, price, rn + 1, next_dn, NULL, 0 FROM l WHERE next_dn IS NOT NULL AND (again IS NULL OR again > rn + 1)),
b AS (SELECT a.*, (SELECT max(c.rn) FROM o c WHERE c.symbol = a.symbol AND c.side = a.side AND c.price = a.price AND c.rn < a.rn AND c.qty < 0.5 * a.qty) AS broke FROM o a WHERE a.book IS NOT NULL)
SELECT b.symbol, b.book, b.side, b.price, b.qty, (b.dn - min(o.dn))::BIGINT AS held_days FROM b JOIN o ON o.symbol = b.symbol AND o.side = b.side AND o.price = b.price AND o.rn <= b.rn AND (b.broke IS NULL OR o.rn > b.broke) GROUP BY b.symbol, b.book, b.side, b.price, b.qty, b.dn""")
def level_held(spark, sf_dir):
    """Days that each displayed level has held at least half of its present quantity without a break."""
    o = held_since(level_observations(spark, sf_dir), ["symbol", "side", "price"], "rn", "qty").where("book IS NOT NULL")
    # ``since`` is the number of a snapshot; its day is the symbol's.
    days = snapshots(spark, sf_dir).select("symbol", F.col("dn").alias("since_dn"), F.row_number().over(Window.partitionBy("symbol").orderBy("dn", "book")).alias("since"))
    return o.withColumn("since", F.col("since").cast("int")).join(days, ["symbol", "since"]).select("symbol", "book", "side", "price", "qty", (F.col("dn") - F.col("since_dn")).cast("long").alias("held_days"))


GAP, LAGS, LEADERS, OVERLAP = 5, [0, 1, 2, 3], 3, 20
PAIRS = f"""{BARS}, total AS (SELECT symbol, s_nationkey AS sector, sum(trades) AS trades FROM bars JOIN supplier ON s_suppkey = symbol GROUP BY ALL),
top AS (SELECT symbol AS leader, sector FROM total QUALIFY row_number() OVER (PARTITION BY sector ORDER BY trades DESC, symbol) <= {LEADERS}),
pairs AS (SELECT leader, symbol AS follower FROM total JOIN top USING (sector) WHERE symbol <> leader),
seen AS (SELECT symbol, CAST(ts - DATE '1970-01-01' AS BIGINT) AS bin, ln(close) AS v, lead(CAST(ts - DATE '1970-01-01' AS BIGINT)) OVER (PARTITION BY symbol ORDER BY ts) AS after FROM bars WHERE close > 0),
grid AS (SELECT symbol, unnest(range(bin, least(coalesce(after - 1, bin + {GAP}), bin + {GAP}) + 1)) AS bin, v FROM seen),
ch AS (SELECT symbol, bin, r FROM (SELECT symbol, bin, v - lag(v) OVER (PARTITION BY symbol ORDER BY bin) AS r, bin - lag(bin) OVER (PARTITION BY symbol ORDER BY bin) AS d FROM grid) WHERE d = 1),
c AS (SELECT p.leader, p.follower, l.lag, count(*) AS n, corr(x.r, y.r) AS rho FROM ch y JOIN pairs p ON p.follower = y.symbol CROSS JOIN (SELECT unnest({LAGS}) AS lag) l JOIN ch x ON x.symbol = p.leader AND x.bin = y.bin - l.lag GROUP BY ALL)"""


@query(f"WITH {PAIRS}, b AS (SELECT *, row_number() OVER (PARTITION BY leader, follower ORDER BY round(rho, 6) DESC, lag) AS place FROM c WHERE n >= {OVERLAP} AND rho IS NOT NULL AND NOT isnan(rho)) SELECT leader, follower, lag::INT AS lag, n, {near_sql('rho')} AS rho FROM b WHERE place = 1")
def pair_lags(spark, sf_dir):
    """The lag at which each symbol follows the most traded ones of its sector most closely, on a daily grid with unfilled days masked."""
    b = bars(spark, sf_dir, together=True)
    sector = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("symbol"), F.col("s_nationkey").alias("sector"))
    total = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("symbol")).agg(F.count("*").alias("trades")).join(sector, "symbol")
    w = Window.partitionBy("sector").orderBy(F.desc("trades"), "symbol")  # a row for each symbol
    top = total.withColumn("place", F.row_number().over(w)).where(F.col("place") <= LEADERS).select(F.col("symbol").alias("leader"), "sector")
    pairs = total.select(F.col("symbol").alias("follower"), "sector").join(top, "sector").where("follower <> leader").select("leader", "follower")
    paths = b.where("close > 0").select("symbol", F.unix_date("ts").alias("bin"), "ts", F.ln("close").alias("v"))
    found = lagged_correlations(steps(on_grid(paths, "symbol", "bin", "ts", "v", GAP), "symbol"), pairs, "symbol", LAGS)
    return best_lag(found, OVERLAP).select("leader", "follower", "lag", "n", near("rho").alias("rho"))
