"""Which listing and which company claims of several sources are about; what sources disagree on is shown and never voted on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import checkpointed


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (u, v); the root is the component's smallest node.

    Each round gives a node its neighbours' smallest root and then that root's own, so rounds grow with the logarithm of the
    longest chain. Links and labels are only shuffled and added up; a hub's links are partial minima. Links with a null are left out.
    """
    fine = links.dropna().select("u", "v")
    edges = checkpointed(fine.unionByName(fine.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    labels = checkpointed(edges.select(F.col("u").alias("node")).distinct().withColumn("root", F.col("node")))
    while True:
        low = edges.join(labels.withColumnRenamed("node", "v"), "v").groupBy(F.col("u").alias("node")).agg(F.min("root").alias("low"))
        near = checkpointed(labels.join(low, "node").select("node", F.least("root", "low").alias("root"), F.col("root").alias("before")))
        of = near.select(F.col("node").alias("root"), F.col("root").alias("next"))
        found = checkpointed(near.join(of, "root").select("node", F.least("root", "next").alias("root"), "before"))
        labels = found.select("node", "root")
        if found.where("root <> before").isEmpty():
            return labels


def placed(claims: DataFrame) -> DataFrame:
    """``claims`` (source, exchange, code, as_of, attributes map) with a code, on an exchange: its own, or the only one others name.

    Adds ``inferred``. A claim without an exchange stays only if the other claims of its code leave exactly one possibility.
    """
    named = lambda c: F.when(F.trim(c) != "", F.trim(c))
    fine = claims.withColumns({"exchange": named("exchange"), "code": named("code")}).where("code IS NOT NULL")
    known = fine.where("exchange IS NOT NULL").groupBy("code").agg(F.min("exchange").alias("lo"), F.max("exchange").alias("hi"))
    only = known.where("lo = hi").select("code", F.col("lo").alias("only"))
    both = fine.join(only, "code", "left")
    return both.select("source", F.coalesce("exchange", "only").alias("exchange"), "code", "as_of", "attributes", F.col("exchange").isNull().alias("inferred")).where("exchange IS NOT NULL")


def resolutions(on_listings: DataFrame, identity: list[str]) -> DataFrame:
    """(exchange, code, attribute, value, status, sources, is_identity) from ``placed`` claims.

    A source's word is its earliest one (of one day the smallest). One value of all sources is OBSERVED; several are a CONFLICT
    and withheld. Null and blank values claim nothing.
    """
    said = on_listings.select("exchange", "code", "source", "as_of", F.explode("attributes").alias("attribute", "value")).where("trim(value) <> ''")
    word = said.groupBy("exchange", "code", "attribute", "source").agg(F.min(F.struct("as_of", "value"))["value"].alias("value"))
    g = word.groupBy("exchange", "code", "attribute").agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.count("*").alias("sources"))
    same = F.col("lo") == F.col("hi")
    return g.select(
        "exchange", "code", "attribute", F.when(same, F.col("lo")).alias("value"), F.when(same, "OBSERVED").otherwise("CONFLICT").alias("status"), "sources",
        F.col("attribute").isin(*identity).alias("is_identity"),
    )


def key(exchange: str = "exchange", code: str = "code") -> Column:
    return F.concat_ws(":", exchange, code)


def listings(claims: DataFrame, identity: list[str], company: str) -> DataFrame:
    """(exchange, code, sources, first_seen, last_seen, inferred, absent, resolved, conflicts, company_id, company) for each listing.

    ``absent``: sources that knew it before and are there on the last day of all claims, but without it. ``resolved``: no conflict
    on an ``identity`` attribute. ``company_id``: the resolved attribute ``company``. ``company``: the smallest listing ("exchange:code") of those
    connected by a code on several exchanges or by a company id on one; codes that share an id are told apart as listings all the same.
    """
    on = checkpointed(placed(claims))
    latest = on.agg(F.max("as_of").alias("latest"))  # one row
    now = on.join(F.broadcast(latest), F.col("as_of") == F.col("latest")).select("source").distinct().agg(F.collect_set("source").alias("there"))  # sources are few
    seen = on.join(F.broadcast(latest)).groupBy("exchange", "code").agg(
        F.sort_array(F.collect_set("source")).alias("sources"), F.min("as_of").alias("first_seen"), F.max("as_of").alias("last_seen"), F.min("inferred").alias("inferred"),
        F.collect_set(F.when(F.col("as_of") == F.col("latest"), F.col("source"))).alias("still"),
    )
    absent = F.sort_array(F.array_intersect(F.array_except("sources", "still"), "there"))
    found = checkpointed(resolutions(on, identity))
    open_ = F.col("status") == "CONFLICT"
    about = found.groupBy("exchange", "code").agg(
        F.count_if(open_ & F.col("is_identity")).alias("critical"), F.count_if(open_).alias("conflicts"), F.max(F.when(F.col("attribute") == company, F.col("value"))).alias("company_id")
    )
    rows = checkpointed(seen.join(F.broadcast(now)).join(about, ["exchange", "code"], "left").select(
        "exchange", "code", "sources", "first_seen", "last_seen", "inferred", absent.alias("absent"), (F.coalesce("critical", F.lit(0)) == 0).alias("resolved"),
        F.coalesce("conflicts", F.lit(0)).alias("conflicts"), "company_id",
    ))
    # Identifiers are nodes beside listings: marked so that they are larger than any listing and never a root.
    by_code = rows.select(key().alias("u"), F.concat(F.lit("\uffff code "), "code").alias("v"))
    by_id = rows.where("company_id IS NOT NULL").select(key().alias("u"), F.concat(F.lit("\uffff id "), "exchange", F.lit(" "), "company_id").alias("v"))
    roots = components(by_code.unionByName(by_id)).select(F.col("node").alias("listing"), F.col("root").alias("company"))
    return rows.withColumn("listing", key()).join(roots, "listing").drop("listing")


def reused_ids(found: DataFrame) -> DataFrame:
    """(exchange, company_id, codes): company ids of ``listings`` that stand under several codes of one exchange, a rename or an error."""
    g = found.where("company_id IS NOT NULL").groupBy("exchange", "company_id").agg(F.sort_array(F.collect_set("code")).alias("codes"))
    return g.where(F.size("codes") > 1)
