"""Composite lenses over mentions and pair statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import kernels
from quillon.sources.tables import materialised

from .dma import cells, disproportionality, measures, pair_counts


def class_effect(mentions: DataFrame, class_of) -> DataFrame:
    """Class by event statistics; a class effect needs two drugs with the event."""
    rows = mentions.withColumn("class", class_of)
    drugs = rows.groupBy("class", "event").agg(F.countDistinct("drug").alias("n_drugs"))
    found = disproportionality(rows, drug="class").withColumnRenamed("drug", "class")
    return found.join(drugs, ["class", "event"]).withColumn("class_effect", (F.col("n_drugs") >= 2) & (F.col("strength") != "WEAK"))


def active_comparator(mentions: DataFrame, class_of) -> DataFrame:
    """2x2 tables within a drug's class; single-member classes have no comparator and null statistics."""
    pairs = pair_counts(mentions).withColumn("class", class_of)
    members = pairs.groupBy("class").agg(F.countDistinct("drug").alias("members"))
    found = cells(pairs, ["class"]).join(members, "class")
    alone = F.col("members") < 2
    ror = [F.when(~alone, c).alias(n) for c, n in zip(kernels.ror(), ("ror", "ror_low", "ror_high"))]
    found = found.select("class", "drug", "event", "a", "b", "c", "d", "members", *ror)
    return found.withColumn("stands_out", F.coalesce(F.col("ror_low") > 1, F.lit(False)))


def organ_system_alerts(mentions: DataFrame) -> DataFrame:
    """Organ systems that signal by the PRR rule although no member event does."""
    by_event = disproportionality(mentions).withColumn("sdr", kernels.sdr_by_prr())
    system = mentions.select("event", "soc").distinct()
    members = by_event.join(system, "event").groupBy("drug", "soc").agg(F.max("sdr").alias("member_sdr"), F.max("a").alias("max_member"))
    by_soc = disproportionality(mentions, event="soc").withColumnRenamed("event", "soc").withColumn("soc_sdr", kernels.sdr_by_prr())
    found = by_soc.join(members, ["drug", "soc"])
    return found.withColumn("alert", F.col("soc_sdr") & ~F.col("member_sdr") & (F.col("max_member") < 3))


def universe_and_subset(mentions: DataFrame, in_subset) -> DataFrame:
    """PRR of a pool of products against the PRR of a part of it, by event."""
    pool = disproportionality(mentions.withColumn("drug", F.substring("drug", 1, 7)))
    part = disproportionality(mentions.where(in_subset).withColumn("drug", F.substring("drug", 1, 7)))
    part = part.select("drug", "event", F.col("a").alias("subset_n"), F.col("prr").alias("subset_prr"))
    both = pool.select("drug", "event", F.col("a").alias("universe_n"), F.col("prr").alias("universe_prr")).join(part, ["drug", "event"])
    return both.withColumn("prr_ratio", F.round(F.col("subset_prr") / F.col("universe_prr"), 3))


def interactions(mentions: DataFrame, min_count: int = 2) -> DataFrame:
    """Drug pairs of a post by event, with Omega shrinkage over posts of two drugs or more.

    Pairs arise within a post's own drug list, so the self-join is bounded by the drugs of one post.
    """
    post = mentions.groupBy("post").agg(F.array_sort(F.collect_set("drug")).alias("drugs"), F.collect_set("event").alias("events"))
    post = post.where(F.size("drugs") >= 2)
    drug = post.select("post", F.explode("drugs").alias("drug"), "events")
    n_drug = drug.groupBy("drug").agg(F.count("*").alias("n"))
    n_drug_event = drug.select("drug", F.explode("events").alias("event")).groupBy("drug", "event").agg(F.count("*").alias("n"))
    n_event = post.select(F.explode("events").alias("event")).groupBy("event").agg(F.count("*").alias("n_event"))
    two = F.expr("flatten(transform(drugs, (x, i) -> transform(slice(drugs, i + 2, size(drugs)), y -> struct(x as drug_a, y as drug_b))))")
    pair = post.select(F.explode(two).alias("p"), "events").select("p.*", "events")
    n_pair = pair.groupBy("drug_a", "drug_b").agg(F.count("*").alias("n_pair"))
    triad = pair.select("drug_a", "drug_b", F.explode("events").alias("event")).groupBy("drug_a", "drug_b", "event").agg(F.count("*").alias("n"))
    for s in "ab":
        triad = triad.join(n_drug_event.select(F.col("drug").alias(f"drug_{s}"), "event", F.col("n").alias(f"n_{s}e")), [f"drug_{s}", "event"])
        triad = triad.join(n_drug.select(F.col("drug").alias(f"drug_{s}"), F.col("n").alias(f"n_{s}")), f"drug_{s}")
    triad = triad.join(n_event, "event").join(n_pair, ["drug_a", "drug_b"]).where(F.col("n") >= min_count)
    omega, low = kernels.shrinkage(F.col("n"), F.col("n_ae") * F.col("n_be") / F.col("n_event"))
    ratio = (F.col("n") / F.col("n_pair")) / F.greatest(F.col("n_ae") / F.col("n_a"), F.col("n_be") / F.col("n_b"))
    found = triad.select("drug_a", "drug_b", "event", "n", F.round(omega, 3).alias("omega"), F.round(low, 3).alias("omega025"), F.round(ratio, 3).alias("interaction_ratio"))
    flag = F.col("omega025") > 0
    return found.withColumn("strength", F.when(flag | ((F.col("n") >= 3) & (F.col("omega") > 0)), "MODERATE").otherwise("WEAK"))


def masking(mentions: DataFrame) -> DataFrame:
    """Competitors of each pair for its event: the ten largest, whether they mask it, and the pair's risk class."""
    return _maskers(pair_counts(mentions))


def _maskers(pairs: DataFrame) -> DataFrame:
    total = F.sum("a").over(Window.partitionBy("event"))
    rows = pairs.withColumn("event_total", total)
    top = Window.partitionBy("event").orderBy(F.desc("a"), "drug")
    best = rows.withColumn("place", F.row_number().over(top)).where("place <= 11")
    rivals = best.select("event", F.col("drug").alias("rival"), F.col("a").alias("n_rival"))
    found = rows.join(rivals, "event").where("drug != rival")
    order = Window.partitionBy("drug", "event").orderBy(F.desc("n_rival"), "rival")
    found = found.withColumn("place", F.row_number().over(order)).where("place <= 10")
    share = F.round(F.col("n_rival") / F.col("event_total"), 4)
    likely = (F.col("n_rival") >= 2) & ((share >= 0.10) | (F.col("n_rival") > F.col("a")))
    by = found.groupBy("drug", "event").agg(F.max("a").alias("target"), F.max("event_total").alias("event_total"), F.max(share).alias("top_share"), F.count_if(likely).alias("n_likely"), F.min_by("rival", F.struct(-F.col("n_rival"), F.col("rival"))).alias("top_rival"), F.collect_list(F.when(likely, F.struct((-F.col("n_rival")).alias("n"), "rival"))).alias("maskers"))
    by = by.withColumn("maskers", F.transform(F.slice(F.array_sort("maskers"), 1, 3), lambda m: m["rival"]))
    own = F.col("target") / F.col("event_total")
    risk = F.when((F.col("top_share") >= 0.35) & (own < 0.40), "high").when((F.col("top_share") >= 0.15) | (F.col("n_likely") > 0), "moderate").otherwise("low")
    return by.withColumn("risk", risk)


def _dropped(by_post: DataFrame, sets: DataFrame) -> DataFrame:
    """excluded, drug, event and n: the mentions m of the posts that have any of a set's one to three members."""
    two = F.flatten(F.transform("members", lambda x, i: F.transform(F.slice("members", i + 2, F.size("members")), lambda y: F.array(x, y))))
    three = F.filter(F.array("members"), lambda m: F.size(m) == 3)
    of = sets.select("excluded", F.explode(F.concat(F.transform("members", lambda x: F.array(x)), two, three)).alias("part"))
    named = [F.get("part", i).alias(c) for i, c in enumerate(("first", "second", "third"))]
    parts = materialised(of.select("part").distinct().select("part", F.monotonically_increasing_id().alias("id"), *named), "parts")
    rows = by_post.select(F.array_distinct(F.transform("m", lambda x: x["drug"])).alias("drugs"), "m").select(F.explode("drugs").alias("first"), "drugs", "m").join(parts.drop("part"), "first")
    held = [F.col(c).isNull() | F.array_contains("drugs", F.col(c)) for c in ("second", "third")]
    seen = rows.where(held[0] & held[1]).select("id", F.explode("m").alias("x")).groupBy("id", "x.drug", "x.event").agg(F.count("*").alias("n"))
    sign = F.when(F.size("part") == 2, -1).otherwise(1)
    by = of.join(parts.select("part", "id"), "part").select("excluded", "id", sign.alias("sign")).join(seen, "id")
    return by.groupBy("excluded", "drug", "event").agg(F.sum(F.col("n") * F.col("sign")).alias("n"))


def remine(mentions: DataFrame) -> DataFrame:
    """Statistics of every pair before and after whole posts with its maskers (up to three likely ones, else the
    event's largest other drug) are dropped, what comes of it, and how well the pair can be judged.

    Pairs of an event share few sets of maskers. What the dropped posts held is counted and taken off the pair's cells.
    Posts with any of a set's drugs are those with one of them, less those with two, plus those with three; each part
    of a set is counted once for all sets that have it, within a post's own row, so no post is repeated for each set.
    """
    by_post = materialised(mentions.groupBy("post").agg(F.collect_list(F.struct("drug", "event")).alias("m")), "posts")
    pairs = materialised(pair_counts(by_post.select(F.explode("m").alias("x")).select("x.*")), "pairs")
    before = cells(pairs)
    members = F.when(F.size("maskers") > 0, F.col("maskers")).otherwise(F.array("top_rival"))
    target = _maskers(pairs).select("drug", "event", F.array_sort(members).alias("members"))
    target = materialised(target.withColumn("excluded", F.array_join("members", "|")), "targets")
    gone = _dropped(by_post, target.select("excluded", "members").distinct())
    rows = target.drop("members").join(before, ["drug", "event"])
    for name, keys in (("pair", ["drug", "event"]), ("drug", ["drug"]), ("event", ["event"]), ("all", [])):
        lost = gone.groupBy("excluded", *keys).agg(F.sum("n").alias(f"gone_{name}"))
        rows = rows.join(lost, ["excluded", *keys], "left").fillna(0, [f"gone_{name}"])
    cut = {
        "a": F.col("a") - F.col("gone_pair"),
        "b": F.col("b") - (F.col("gone_drug") - F.col("gone_pair")),
        "c": F.col("c") - (F.col("gone_event") - F.col("gone_pair")),
        "d": F.col("d") - (F.col("gone_all") - F.col("gone_drug") - F.col("gone_event") + F.col("gone_pair")),
    }
    keys = ["excluded", "drug", "event"]
    pick = lambda df, tag: measures(df.select(*keys, "a", "b", "c", "d")).select(*keys, F.col("a").alias(f"n_{tag}"), F.col("prr").alias(f"prr_{tag}"), kernels.sdr_by_prr().alias(f"sdr_{tag}"), (F.col("a") / (F.col("a") + F.col("b"))).alias(f"rate_{tag}"))
    after = rows.withColumns(cut).where("a > 0")
    rows = pick(rows, "before").join(pick(after, "after"), keys, "left")
    ratio = F.round(F.col("prr_after") / F.col("prr_before"), 3)
    together = F.round(F.col("rate_after") / F.col("rate_before"), 3)
    outcome = (
        F.when(F.col("n_after").isNull(), "vanished").when(~F.col("sdr_before") & F.col("sdr_after"), "unmasked").when(F.col("sdr_before") & ~F.col("sdr_after"), "attenuated")
        .when(~together.between(0.85, 1.15), "co_reported").when(ratio <= 0.85, "attenuated").when(ratio >= 1.15, "amplified").otherwise("stable")
    )
    tier = F.when(F.col("n_before") >= 3, "evaluable").when(F.col("n_before") == 2, "provisional").otherwise("exploratory")
    rows = rows.withColumn("masking_ratio", ratio).withColumn("coreporting", together).withColumn("outcome", outcome).withColumn("tier", tier)
    return rows.drop("sdr_before", "sdr_after", "rate_before", "rate_after")


def spatial_scan(posts: DataFrame, signal_posts: DataFrame) -> DataFrame:
    """Areas of a level by scan statistic of signal posts against all posts, and the most likely cluster."""
    base = posts.groupBy("country").agg(F.count("*").alias("base"))
    seen = posts.join(signal_posts, "post", "left_semi").groupBy("country").agg(F.count("*").alias("observed"))
    rows = base.join(seen, "country", "left").withColumn("observed", F.coalesce("observed", F.lit(0)))
    totals = rows.agg(F.sum("base").alias("all_base"), F.sum("observed").alias("total"))
    rows = rows.crossJoin(F.broadcast(totals)).withColumn("mu", F.col("total") * F.col("base") / F.col("all_base"))
    llr = F.round(kernels.scan_llr(F.col("observed"), F.col("mu"), F.col("total")), 2)
    inside = F.col("observed") / F.col("mu")
    rows = rows.select("country", "observed", F.round("mu", 3).alias("expected"), llr.alias("llr"), F.round(inside, 2).alias("rr"))
    flagged = (F.col("observed") >= 5) & (F.col("rr") >= 3) & (F.col("llr") >= 3.84)
    first = F.row_number().over(Window.orderBy(F.desc("llr"), F.desc("rr"), F.desc("observed"), "country"))
    return rows.withColumn("flagged", flagged).withColumn("most_likely", first == 1)


def calibrated(rows: DataFrame, is_control) -> DataFrame:
    """Empirical null from negative controls, and calibrated z and interval of every pair's IC."""
    se = (F.col("ic") - F.col("ic025")) / kernels.Z95
    null = rows.where(is_control).agg(F.count("*").alias("k"), F.avg("ic").alias("mu"), F.greatest(F.lit(0.0), F.var_samp("ic") - F.avg(se * se)).alias("tau2"))
    spread = F.sqrt(se * se + F.col("tau2"))
    z = F.when(F.col("k") >= 3, (F.col("ic") - F.col("mu")) / spread)
    out = rows.crossJoin(F.broadcast(null))
    return out.select("drug", "event", "a", "ic", F.round(z, 3).alias("z"), F.round(F.col("ic") - F.col("mu") - kernels.Z95 * spread, 3).alias("low"), kernels.e_value(F.col("prr")).alias("e_value"))


def network(mentions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Drug-event edges with weights, and degree centrality of the nodes."""
    edges = pair_counts(mentions).withColumnRenamed("a", "weight")
    ends = edges.select(F.lit("drug").alias("kind"), F.col("drug").alias("node"), "weight").union(edges.select(F.lit("event"), "event", "weight"))
    nodes = ends.groupBy("kind", "node").agg(F.count("*").alias("degree"), F.sum("weight").alias("strength"))
    n = nodes.agg((F.count("*") - 1).alias("others"))
    return edges, nodes.crossJoin(F.broadcast(n)).select("kind", "node", "degree", "strength", F.round(F.col("degree") / F.col("others"), 4).alias("centrality"))
