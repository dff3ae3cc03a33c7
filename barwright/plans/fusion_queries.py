"""Queries over several sensors and typed events: status, fused quotes and books, clocks, event order, frames and states."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import levels as L
from ..functions.windows import by_symbol, near, near_sql
from ..sources.tables import BARS, SNAPSHOTS, TAPE, TOUCHES, bars, snapshots, table, tape, touches
from .registry import query
from .snapshot_queries import in_order
from .stats_queries import SIG, evaluated

S = "PARTITION BY symbol ORDER BY ts"
SEC = "CAST(floor(epoch_us(t) / 1000000) AS BIGINT)"


def seconds(c="t"):
    return F.unix_seconds(F.col(c).cast("timestamp"))


# ---- sensors

STATUS = f"{TAPE}, x AS (SELECT symbol, source, {SEC} AS sec FROM tape), g AS (SELECT *, sec - lag(sec) OVER w AS gap, row_number() OVER (PARTITION BY symbol, source ORDER BY sec DESC) AS back FROM x WINDOW w AS (PARTITION BY symbol, source ORDER BY sec)), m AS (SELECT max(sec) AS now FROM x)"


@query(f"WITH {STATUS} SELECT symbol, source, count(*) AS prints, max(sec) AS last_sec, quantile_cont(gap, 0.5) FILTER (back <= 64) AS cadence, CASE WHEN count(gap) < 2 THEN 'UNKNOWN' WHEN (SELECT now FROM m) - max(sec) > 3 * quantile_cont(gap, 0.5) FILTER (back <= 64) THEN 'STALE' ELSE 'LIVE' END AS status FROM g GROUP BY symbol, source")
def sensor_status(spark, sf_dir):
    """Cadence of each source's last 64 gaps for a symbol, and whether its silence is three times that."""
    key = Window.partitionBy("symbol", "source")
    x = tape(spark, sf_dir).select("symbol", "source", seconds().alias("sec"))
    now = x.agg(F.max("sec").alias("now"))  # one row
    g = x.withColumn("gap", F.col("sec") - F.lag("sec").over(key.orderBy("sec"))).withColumn("back", F.row_number().over(key.orderBy(F.desc("sec"))))
    a = g.groupBy("symbol", "source").agg(F.count("*").alias("prints"), F.max("sec").alias("last_sec"), F.percentile(F.when(F.col("back") <= 64, F.col("gap")), 0.5).alias("cadence"), F.count("gap").alias("gaps"))
    status = F.when(F.col("gaps") < 2, "UNKNOWN").when(F.col("now") - F.col("last_sec") > 3 * F.col("cadence"), "STALE").otherwise("LIVE")
    return a.join(F.broadcast(now)).select("symbol", "source", "prints", "last_sec", "cadence", status.alias("status"))


LATEST = f"{TAPE}, l AS (SELECT symbol, CAST(t AS DATE) AS day, source, max({SEC}) AS sec, (list(value ORDER BY t DESC, event_id DESC))[1] AS value FROM tape GROUP BY ALL)"


def latest(spark, sf_dir):
    """The last value of each source, by symbol and day."""
    g = tape(spark, sf_dir).groupBy("symbol", F.to_date("t").alias("day"), "source")
    return g.agg(F.max(F.struct("t", "event_id", "value")).alias("m")).select("symbol", "day", "source", F.unix_seconds(F.col("m.t").cast("timestamp")).alias("sec"), F.col("m.value").alias("value"))


@query(f"WITH {LATEST}, f AS (SELECT *, first_value(value) OVER (PARTITION BY symbol, day ORDER BY sec DESC, source) AS fused, first_value(source) OVER (PARTITION BY symbol, day ORDER BY sec DESC, source) AS chosen FROM l) SELECT symbol, day, chosen, fused, count(*) AS sensors, count(*) FILTER (abs(value - fused) <= 10) AS agreeing, {near_sql('max(value) - min(value)')} AS spread FROM f GROUP BY symbol, day, chosen, fused")
def fused_quotes(spark, sf_dir):
    """The freshest sensor's value of a symbol and day, how many others agree within ten, and the spread of all."""
    g = latest(spark, sf_dir).groupBy("symbol", "day").agg(F.min(F.struct((-F.col("sec")).alias("age"), "source", "value")).alias("b"), F.collect_list("value").alias("v"))
    agreeing = F.size(F.filter("v", lambda x: F.abs(x - F.col("b.value")) <= 10)).cast("long")  # a value for each source
    return g.select("symbol", "day", F.col("b.source").alias("chosen"), F.col("b.value").alias("fused"), F.size("v").cast("long").alias("sensors"), agreeing.alias("agreeing"), near(F.array_max("v") - F.array_min("v")).alias("spread"))


@query(f"WITH {LATEST} SELECT a.source AS source_a, b.source AS source_b, count(*) AS pairs, quantile_cont(a.sec - b.sec, 0.5) AS median_offset FROM l a JOIN l b ON a.symbol = b.symbol AND a.day = b.day AND a.source < b.source GROUP BY ALL")
def clock_offsets(spark, sf_dir):
    """Median offset of each two sources' last receipts; a symbol and day makes its own few pairs."""
    g = latest(spark, sf_dir).groupBy("symbol", "day").agg(F.collect_list(F.struct("source", "sec")).alias("x"))  # an element for each source
    pairs = F.flatten(F.transform("x", lambda a: F.transform(F.filter("x", lambda b: a["source"] < b["source"]), lambda b: F.struct(a["source"].alias("source_a"), b["source"].alias("source_b"), (a["sec"] - b["sec"]).alias("off")))))
    return g.select(F.inline(pairs)).groupBy("source_a", "source_b").agg(F.count("*").alias("pairs"), F.percentile("off", 0.5).alias("median_offset"))


SIDED = "SELECT l_orderkey AS book, floor(l_extendedprice / nullif(l_quantity, 0) / 100) * 100 AS price, sum(l_quantity) AS qty FROM lineitem {} GROUP BY ALL"
FUSE = f"a AS ({SIDED.format('')}), b AS ({SIDED.format('WHERE l_linenumber <= 3')}), ra AS (SELECT *, row_number() OVER (PARTITION BY book ORDER BY price) AS n FROM a), rb AS (SELECT *, row_number() OVER (PARTITION BY book ORDER BY price) AS n FROM b), j AS (SELECT ra.book, ra.n, ra.price AS pa, ra.qty AS qa, rb.price AS pb, rb.qty AS qb FROM ra LEFT JOIN rb ON ra.book = rb.book AND ra.n = rb.n)"


@query(f"WITH {FUSE} SELECT book, count(*) AS levels, count(*) FILTER (pa = pb AND qa = qb) AS equal, count(*) FILTER (pb IS NOT NULL AND NOT (pa = pb AND qa = qb)) AS different, count(*) FILTER (pb IS NULL) AS truncated, {near_sql('count(*) FILTER (pa = pb AND qa = qb) / nullif(count(pb), 0)::DOUBLE')} AS agreement FROM j GROUP BY book")
def fused_books(spark, sf_dir):
    """Two sensors of a book, one that sees its first three line items alone: level by level, truncation apart from conflict."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("book"), (F.floor(F.try_divide("l_extendedprice", "l_quantity") / 100) * 100.0).alias("price"), F.col("l_quantity").alias("qty"), (F.col("l_linenumber") <= 3).alias("seen"))
    sums = rows.groupBy("book", "price").agg(F.sum("qty").alias("a"), F.sum(F.when(F.col("seen"), F.col("qty"))).alias("b"))
    side = lambda c: F.sort_array(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("price", F.col(c).alias("qty")))))
    z = sums.groupBy("book").agg(side("a").alias("a"), side("b").alias("b")).withColumn("z", F.zip_with("a", "b", lambda x, y: F.when(y.isNull(), "t").when((x["price"] == y["price"]) & (x["qty"] == y["qty"]), "e").otherwise("d")))
    n = lambda k: F.size(F.filter("z", lambda x: x == k)).cast("long")
    return z.select("book", F.size("a").cast("long").alias("levels"), n("e").alias("equal"), n("d").alias("different"), n("t").alias("truncated"), near(F.try_divide(n("e").cast("double"), F.size("b"))).alias("agreement"))


@query(f"WITH {TAPE}, b AS (SELECT symbol, max(t) AS t, sum(value) AS total, count(*) AS n FROM tape WHERE value > 90 GROUP BY symbol) SELECT event_id, coalesce(b.n, 0) AS blocks, {near_sql('coalesce(b.total, 0)')} AS block_value, b.t IS NOT NULL AND b.t >= tape.t AS block_ahead FROM tape LEFT JOIN b USING (symbol)")
def block_map(spark, sf_dir):
    """A symbol's block prints as one aggregate, mapped to each of its rows; without blocks zero."""
    t = tape(spark, sf_dir)
    b = t.where("value > 90").groupBy("symbol").agg(F.max("t").alias("bt"), F.sum("value").alias("total"), F.count("*").alias("n"))
    j = t.join(b, "symbol", "left")
    return j.select("event_id", F.coalesce("n", F.lit(0)).alias("blocks"), near(F.coalesce("total", F.lit(0.0))).alias("block_value"), F.coalesce(F.col("bt") >= F.col("t"), F.lit(False)).alias("block_ahead"))


# ---- typed events and their order

TYPES = "CASE source WHEN 'purchase' THEN 'TRADE' WHEN 'signup' THEN 'STATUS' ELSE 'QUOTE' END"
PRIORITY = "CASE source WHEN 'purchase' THEN 0 WHEN 'click' THEN 1 WHEN 'view' THEN 2 ELSE 3 END"
NORMAL = f"{TAPE}, x AS (SELECT symbol, source, event_id, {SEC} AS sec, CAST(t AS DATE) AS day, {TYPES} AS kind, {PRIORITY} AS priority, row_number() OVER (PARTITION BY symbol, source, k ORDER BY t, event_id) > 1 AS repeated, {SEC} - lag({SEC}) OVER (PARTITION BY symbol ORDER BY t, event_id) AS silence FROM tape)"


def typed(spark, sf_dir):
    """Tape rows as typed events, with what the symbol's silence before them was and whether the source repeats itself."""
    t = tape(spark, sf_dir).withColumn("sec", seconds())
    first = Window.partitionBy("symbol", "source", "k").orderBy("t", "event_id")
    w = Window.partitionBy("symbol").orderBy("t", "event_id")
    return t.select("symbol", "source", "event_id", "sec", F.to_date("t").alias("day"), F.expr(TYPES).alias("kind"), F.expr(PRIORITY).alias("priority"), (F.row_number().over(first) > 1).alias("repeated"), (F.col("sec") - F.lag("sec").over(w)).alias("silence"))


@query(f"WITH {NORMAL} SELECT symbol, event_id, sec, CASE WHEN repeated THEN 'CORRECTION' ELSE kind END AS event FROM x UNION ALL SELECT symbol, event_id, sec - silence AS sec, 'GAP' AS event FROM x WHERE silence > 172800")
def normalised_events(spark, sf_dir):
    """Typed events: trades, quotes, status, corrections of what a source said before, and gaps for silences of two days."""
    x = typed(spark, sf_dir)
    own = x.select("symbol", "event_id", "sec", F.when(F.col("repeated"), "CORRECTION").otherwise(F.col("kind")).alias("event"))
    gaps = x.where("silence > 172800").select("symbol", "event_id", (F.col("sec") - F.col("silence")).alias("sec"), F.lit("GAP").alias("event"))
    return own.unionByName(gaps)


@query(f"WITH {NORMAL} SELECT event_id, day, row_number() OVER (PARTITION BY day ORDER BY sec, priority, event_id) AS place FROM x")
def event_order(spark, sf_dir):
    """Total order of a day's events: receipt, priority of the source, sequence."""
    return typed(spark, sf_dir).select("event_id", "day", F.row_number().over(Window.partitionBy("day").orderBy("sec", "priority", "event_id")).cast("long").alias("place"))


@query(f"WITH {NORMAL}, f AS (SELECT symbol, min(sec) FILTER (kind = 'QUOTE') AS observed, min(sec) FILTER (kind = 'TRADE') AS settled, count(*) FILTER (kind = 'TRADE') AS trades FROM x GROUP BY symbol) SELECT symbol, trades, coalesce(settled < observed, false) AS settled_first, observed IS NULL AND trades > 0 AS never_observed FROM f")
def stream_checks(spark, sf_dir):
    """Symbols that settle before or without an observation."""
    x = typed(spark, sf_dir)
    of = lambda k: F.min(F.when(F.col("kind") == k, F.col("sec")))
    f = x.groupBy("symbol").agg(of("QUOTE").alias("o"), of("TRADE").alias("s"), F.count_if(F.col("kind") == "TRADE").alias("trades"))
    return f.select("symbol", "trades", F.coalesce(F.col("s") < F.col("o"), F.lit(False)).alias("settled_first"), (F.col("o").isNull() & (F.col("trades") > 0)).alias("never_observed"))


@query("SELECT event_id, strptime(strftime(ts + INTERVAL 6 HOUR, '%Y-%m-%d %H:%M:%S'), '%Y-%m-%d %H:%M:%S') - INTERVAL 6 HOUR AS utc, CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) * 1000 AS epoch_ms FROM events")
def clock_conversions(spark, sf_dir):
    """Local time strings, six hours ahead, back to universal time, and epoch milliseconds of whole seconds."""
    e = table(spark, sf_dir, "events")
    text = F.date_format(F.col("ts") + F.expr("INTERVAL 6 HOURS"), "yyyy-MM-dd HH:mm:ss")
    utc = F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss")).cast("timestamp_ntz") - F.expr("INTERVAL 6 HOURS")
    return e.select("event_id", utc.alias("utc"), (seconds("ts") * 1000).alias("epoch_ms"))


# ---- frames, states, days

KINDS = ("ADD", "REMOVE", "INCREASE", "REDUCE")
FRAME = f"""{SNAPSHOTS}, p AS (SELECT *, lag(book) OVER (PARTITION BY symbol ORDER BY dn, book) AS prev FROM snaps), x AS (SELECT p.book, side, price, qty AS now, 0 AS was FROM p JOIN levels USING (book) WHERE prev IS NOT NULL UNION ALL SELECT p.book, side, price, 0, qty FROM p JOIN levels l ON l.book = p.prev),
d AS (SELECT book, side, price, sum(now) AS now, sum(was) AS was FROM x GROUP BY ALL), k AS (SELECT book, side, now - was AS change, CASE WHEN was = 0 THEN 'ADD' WHEN now = 0 THEN 'REMOVE' WHEN now > was THEN 'INCREASE' ELSE 'REDUCE' END AS kind FROM d WHERE now <> was)"""


@query(f"WITH {FRAME} SELECT book, " + ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k.lower()}, coalesce(sum(change) FILTER (kind = '{k}'), 0) AS q_{k.lower()}" for k in KINDS) + " FROM k GROUP BY book")
def frame_events(spark, sf_dir):
    """Counts and quantities of a snapshot's level changes by kind."""
    w = in_order()
    s = snapshots(spark, sf_dir).select("book", F.lag("bids").over(w).alias("b0"), F.lag("asks").over(w).alias("a0"), "bids", "asks")
    d = s.select("book", F.inline(F.concat(L.difference(F.col("b0"), F.col("bids")), L.difference(F.col("a0"), F.col("asks")))))
    own = lambda k: F.col("kind") == k
    return d.groupBy("book").agg(*[c for k in KINDS for c in (F.count_if(own(k)).alias(f"n_{k.lower()}"), F.coalesce(F.sum(F.when(own(k), F.col("change"))), F.lit(0.0)).alias(f"q_{k.lower()}"))])


MID = f"{TOUCHES}, m AS (SELECT symbol, book, dn, (b1 + a1) / 2 AS mid FROM touches WHERE b1 IS NOT NULL AND a1 IS NOT NULL), o AS (SELECT *, lead(mid, 3) OVER w AS ahead, lead(dn, 3) OVER w - dn AS span, max(mid) OVER n AS hi, min(mid) OVER n AS lo FROM m WINDOW w AS (PARTITION BY symbol ORDER BY dn, book), n AS (PARTITION BY symbol ORDER BY dn, book ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING))"


@query(f"WITH {MID} SELECT symbol, book, CASE WHEN span <= 900 THEN {near_sql('ahead / mid - 1')} END AS ret3, {near_sql('hi / mid - 1')} AS best, {near_sql('lo / mid - 1')} AS worst FROM o")
def frame_outcomes(spark, sf_dir):
    """Mid three frames ahead unless the frames span too long, and the best and worst mid on the way."""
    w = in_order()
    m = touches(spark, sf_dir).where("b1 IS NOT NULL AND a1 IS NOT NULL").select("symbol", "book", "dn", ((F.col("b1") + F.col("a1")) / 2).alias("mid"))
    n = w.rowsBetween(1, 3)
    o = m.select("symbol", "book", "mid", F.lead("mid", 3).over(w).alias("ahead"), (F.lead("dn", 3).over(w) - F.col("dn")).alias("span"), F.max("mid").over(n).alias("hi"), F.min("mid").over(n).alias("lo"))
    # Over a mid of 0, where sides below one price step meet, the return is infinite, or no number if both are 0.
    over_zero = lambda c: F.when(F.col(c) == 0, float("nan")).when(F.col(c) > 0, float("inf")).when(F.col(c) < 0, float("-inf"))
    r = lambda c: F.when(F.col("mid") != 0, near(F.try_divide(c, "mid") - 1)).otherwise(over_zero(c))
    return o.select("symbol", "book", F.when(F.col("span") <= 900, r("ahead")).alias("ret3"), r("hi").alias("best"), r("lo").alias("worst"))


STATE = "CASE WHEN ret IS NULL THEN 'UNKNOWN' WHEN ret > 0.2 THEN 'UP' WHEN ret < -0.2 THEN 'DOWN' WHEN trades >= 3 THEN 'BUSY' ELSE 'FLAT' END"
MACHINE = f"{BARS}, r AS (SELECT *, close / nullif(lag(close) OVER ({S}), 0) - 1 AS ret FROM bars), s AS (SELECT *, {STATE} AS state FROM r), c AS (SELECT *, lag(state) OVER ({S}) AS before FROM s), i AS (SELECT *, sum(CASE WHEN before IS NULL OR state <> before THEN 1 ELSE 0 END) OVER ({S}) AS episode FROM c)"


@query(f"WITH {MACHINE} SELECT symbol, ts, state, episode::BIGINT AS episode, row_number() OVER w AS age, {near_sql('close / first_value(close) OVER w - 1')} AS since_entry, CASE WHEN before IS NOT NULL AND before <> state THEN before || '>' || state END AS transition FROM i WINDOW w AS (PARTITION BY symbol, episode ORDER BY ts)")
def state_machine(spark, sf_dir):
    """States of bars, their episodes with age and move since entry, and the transitions between them."""
    w = by_symbol()
    r = bars(spark, sf_dir).withColumn("ret", F.try_divide("close", F.lag("close").over(w)) - 1).withColumn("state", F.expr(STATE))
    c = r.withColumn("before", F.lag("state").over(w))
    turned = F.col("before").isNull() | (F.col("state") != F.col("before"))
    i = c.withColumn("episode", F.sum(turned.cast("int")).over(w))
    e = Window.partitionBy("symbol", "episode").orderBy("ts")
    change = F.when(F.col("before").isNotNull() & (F.col("before") != F.col("state")), F.concat("before", F.lit(">"), "state"))
    return i.select("symbol", "ts", "state", F.col("episode").cast("long").alias("episode"), F.row_number().over(e).cast("long").alias("age"), near(F.col("close") / F.first("close").over(e) - 1).alias("since_entry"), change.alias("transition"))


@query(f"WITH {BARS}, r AS (SELECT symbol, ts, close / nullif(lag(close) OVER ({S}), 0) - 1 AS ret, lead(close) OVER ({S}) / nullif(close, 0) - 1 AS next_ret FROM bars), d AS (SELECT ts, count(ret) AS n, count(*) FILTER (ret < -0.2) AS falls, avg(next_ret) FILTER (ret < -0.2) AS rebound FROM r GROUP BY ts) SELECT ts, n, falls, {near_sql('rebound')} AS rebound FROM d WHERE falls >= 3 AND falls > 0.3 * n")
def panic_days(spark, sf_dir):
    """Days on which three and more symbols and over three tenths of all fall by a fifth, and how those open up after."""
    w = by_symbol()
    r = bars(spark, sf_dir).select("ts", (F.try_divide("close", F.lag("close").over(w)) - 1).alias("ret"), (F.try_divide(F.lead("close").over(w), F.col("close")) - 1).alias("next_ret"))
    d = r.groupBy("ts").agg(F.count("ret").alias("n"), F.count_if(F.col("ret") < -0.2).alias("falls"), F.avg(F.when(F.col("ret") < -0.2, F.col("next_ret"))).alias("rebound"))
    return d.where("falls >= 3 AND falls > 0.3 * n").select("ts", "n", "falls", near("rebound").alias("rebound"))


@query(f"WITH {BARS}, q AS (SELECT symbol, close AS price, lag(low) OVER ({S}) AS bid, lag(high) OVER ({S}) AS ask, lag(close) OVER ({S}) AS last_, ts FROM bars) SELECT symbol, ts, CASE WHEN bid IS NULL THEN 'UNKNOWN' WHEN bid = ask AND price <> bid THEN CASE WHEN price > bid THEN 'BUY' ELSE 'SELL' END WHEN price >= ask THEN 'BUY' WHEN price <= bid THEN 'SELL' WHEN price > (bid + ask) / 2 THEN 'BUY' WHEN price < (bid + ask) / 2 THEN 'SELL' ELSE 'UNKNOWN' END AS direction FROM q")
def trade_direction(spark, sf_dir):
    """Aggressor of a price against the quote before it: at or through a side, then by the mid; locked quotes apart."""
    w = by_symbol()
    q = bars(spark, sf_dir).select("symbol", "ts", F.col("close").alias("p"), F.lag("low").over(w).alias("bid"), F.lag("high").over(w).alias("ask"))
    p, bid, ask, mid = F.col("p"), F.col("bid"), F.col("ask"), (F.col("bid") + F.col("ask")) / 2
    rule = F.when(bid.isNull(), "UNKNOWN").when((bid == ask) & (p != bid), F.when(p > bid, "BUY").otherwise("SELL")).when(p >= ask, "BUY").when(p <= bid, "SELL").when(p > mid, "BUY").when(p < mid, "SELL").otherwise("UNKNOWN")
    return q.select("symbol", "ts", rule.alias("direction"))


# ---- relations and reasons

FIELDS = {"yr": "yr", "trades": "trades", "class": "symbol % 5"}
CODE = "sum(CASE WHEN h > 0 AND h < n THEN -(h * log2(h / n::DOUBLE) + (n - h) * log2((n - h) / n::DOUBLE)) ELSE 0 END)"


@query(f"WITH {SIG}, v AS (" + " UNION ALL ".join(f"SELECT '{k}' AS field, CAST({x} AS VARCHAR) AS value, count(*) AS n, sum(hit::INT) AS h FROM e GROUP BY ALL" for k, x in FIELDS.items()) + f") SELECT field, count(*) AS branches, sum(n)::BIGINT AS n_rows, round({CODE}, 3) AS bits FROM v GROUP BY field")
def categorical_splits(spark, sf_dir):
    """Bits the outcome costs after a split by each value of a field, for all fields in one grouped pass."""
    fields = F.array(*[F.struct(F.lit(k).alias("field"), F.expr(x).cast("string").alias("value")) for k, x in FIELDS.items()])
    v = evaluated(spark, sf_dir).select(F.inline(fields), "hit").groupBy("field", "value").agg(F.count("*").alias("n"), F.count_if("hit").alias("h"))
    n, h = F.col("n"), F.col("h")
    code = F.when((h > 0) & (h < n), -(h * F.log2(h / n) + (n - h) * F.log2((n - h) / n))).otherwise(0.0)
    return v.groupBy("field").agg(F.count("*").alias("branches"), F.sum("n").alias("n_rows"), F.round(F.sum(code), 3).alias("bits"))


TREE = f"{SIG}, best AS (SELECT yr, trades, volume >= 25 AS big, count(*) AS n, sum(hit::INT) AS h FROM e GROUP BY ALL)"


@query(f"WITH {TREE} SELECT yr, trades, big, n, h::BIGINT AS hits, {near_sql('(h + 1) / (n + 2)::DOUBLE')} AS estimate FROM best WHERE n >= 20")
def tree_leaves(spark, sf_dir):
    """Leaves of the tree that splits by year, trades and volume, with smoothed estimates; small leaves are left out."""
    g = evaluated(spark, sf_dir).groupBy("yr", "trades", (F.col("volume") >= 25).alias("big")).agg(F.count("*").alias("n"), F.count_if("hit").alias("hits")).where("n >= 20")
    return g.select("yr", "trades", "big", "n", "hits", near((F.col("hits") + 1) / (F.col("n") + 2)).alias("estimate"))


FOOT = {"wide": "sig", "busy": "trades >= 2", "big": "volume > 40", "early": "yr < 1998"}
CHAINS = [(a, b) for i, a in enumerate(FOOT) for b in list(FOOT)[i + 1 :]]


@query(f"WITH {SIG} " + " UNION ALL ".join(f"SELECT '{a}&{b}' AS chain, count(*) AS n, {near_sql('avg(hit::INT)')} AS hit_rate FROM e WHERE ({FOOT[a]}) AND ({FOOT[b]})" for a, b in CHAINS))
def conjunctions(spark, sf_dir):
    """Every two footprints together: rows and hit rate, all chains in one pass."""
    chains = F.array_compact(F.array(*[F.when(F.expr(f"({FOOT[a]}) AND ({FOOT[b]})"), f"{a}&{b}") for a, b in CHAINS]))
    e = evaluated(spark, sf_dir).select(F.explode(chains).alias("chain"), F.col("hit").cast("int").alias("hit"))
    return e.groupBy("chain").agg(F.count("*").alias("n"), near(F.avg("hit")).alias("hit_rate"))


REASONS = {"thin": "volume < 5", "single": "trades = 1", "wide": "high > low * 3"}


@query(f"WITH {BARS}, f AS (SELECT {', '.join(f'coalesce({e}, false) AS {n}' for n, e in REASONS.items())} FROM bars), r AS (" + " UNION ALL ".join(f"SELECT '{n}' AS reason, count(*) FILTER ({n}) AS inclusive, count(*) FILTER ({n}" + "".join(f" AND NOT {m}" for m in REASONS if m != n) + ") AS exclusive, count(*) AS total FROM f" for n in REASONS) + ") SELECT * FROM r")
def denominator(spark, sf_dir):
    """Bars excluded for each reason, counted with and without others, against all."""
    flags = {n: F.coalesce(F.expr(e), F.lit(False)) for n, e in REASONS.items()}
    f = bars(spark, sf_dir).select(*[c.alias(n) for n, c in flags.items()])
    alone = {n: reduce(lambda x, y: x & y, [~F.col(m) for m in REASONS if m != n], F.col(n)) for n in REASONS}
    one = f.agg(F.count("*").alias("total"), *[F.struct(F.lit(n).alias("reason"), F.count_if(n).alias("inclusive"), F.count_if(alone[n]).alias("exclusive")).alias(n) for n in REASONS])
    return one.select("total", F.inline(F.array(*REASONS))).select("reason", "inclusive", "exclusive", "total")


BLEND = "(coalesce(0.5 * z, 0) + coalesce(0.3 * share, 0) + coalesce(0.2 * late, 0)) / nullif((CASE WHEN z IS NULL THEN 0 ELSE 0.5 END) + (CASE WHEN share IS NULL THEN 0 ELSE 0.3 END) + (CASE WHEN late IS NULL THEN 0 ELSE 0.2 END), 0)"


@query(f"WITH b AS (SELECT l_suppkey AS s, CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) / count(*) AS mean, sqrt(CAST(count(*) * sum(CAST(l_quantity AS BIGINT) * CAST(l_quantity AS BIGINT)) - sum(CAST(l_quantity AS BIGINT)) * sum(CAST(l_quantity AS BIGINT)) AS DOUBLE)) / count(*) AS sd, count(*) AS n FROM lineitem GROUP BY l_suppkey), p AS (SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN n >= 4 THEN greatest(-1.0, least(1.0, (l_quantity - mean) / nullif(sd, 0))) END AS z, CASE WHEN l_discount > 0 THEN l_discount * 10 END AS share, CASE WHEN l_returnflag <> 'N' THEN l_tax * 10 END AS late FROM lineitem JOIN b ON s = l_suppkey) SELECT l_orderkey, l_linenumber, l_partkey, {near_sql('z')} AS z, {near_sql(BLEND)} AS blend FROM p")
def baseline_blend(spark, sf_dir):
    """Clipped z of a line's quantity against its supplier's, and a weighted mean of the parts that can be observed."""
    q = F.col("l_quantity").cast("long")
    li = table(spark, sf_dir, "lineitem")
    b = li.groupBy(F.col("l_suppkey").alias("s")).agg((F.sum(q).cast("double") / F.count("*")).alias("mean"), (F.sqrt((F.count("*") * F.sum(q * q) - F.sum(q) * F.sum(q)).cast("double")) / F.count("*")).alias("sd"), F.count("*").alias("n"))
    j = li.join(b, F.col("l_suppkey") == F.col("s"))
    z = F.when(F.col("n") >= 4, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide(F.col("l_quantity") - F.col("mean"), F.col("sd")))))
    # greatest and least pass over nulls here; a null z stays null.
    z = F.when(F.col("sd") != 0, z)
    p = j.select("l_orderkey", "l_linenumber", "l_partkey", z.alias("z"), F.when(F.col("l_discount") > 0, F.col("l_discount") * 10).alias("share"), F.when(F.col("l_returnflag") != "N", F.col("l_tax") * 10).alias("late"))
    return p.select("l_orderkey", "l_linenumber", "l_partkey", near("z").alias("z"), near(F.expr(BLEND)).alias("blend"))
