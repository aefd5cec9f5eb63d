"""URL filters by a sort-merge range join: canonical keys turn rule prefixes into intervals that a sorted sweep opens and closes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenvec.llm.common import hot_keys, join_hot, lower_ascii, materialize, maybe_broadcast

#: Copies of one row that are made in one task.
COPIES = 10_000
#: URLs of one sweep at about most, unless the rules of one host are more.
SWEEP_ROWS = 4096
#: Hosts of a range of keys at about most, and the hashed sample of keys that the ranges are cut at.
RANGE_HOSTS, CUT_SAMPLE = 50_000, 20_000


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty for null or without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.expr("substring(__url, instr(__url, '://') + 3)")).otherwise("")
    return lower_ascii(F.coalesce(F.regexp_extract(rest, r"^([^/?#]*)", 1), F.lit(""))), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: Column) -> Column:
    """Labels in reverse order, each with a dot behind it: a host's subdomains have keys that begin with its own."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def rule_stacks(rules: DataFrame) -> DataFrame:
    """``rules`` (verdict, host, path) to (host, path, stack): a rule with those it is nested in on its host, innermost first.

    Of rules with the same host and path, block wins over allow. A null host or path is empty.
    """
    tidy = rules.select(lower_ascii(F.coalesce("host", F.lit(""))).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict")
    tidy = tidy.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    prefixes = tidy.select("host", "path", F.explode(F.sequence(F.lit(0), F.length("path"))).alias("n")).select("host", "path", F.expr("substring(path, 1, n)").alias("outer"))
    around = tidy.select("host", F.col("path").alias("outer"), "verdict")
    entry = F.struct(F.length("outer").alias("n"), F.col("outer").alias("path"), "verdict")
    return prefixes.join(around, ["host", "outer"]).groupBy("host", "path").agg(F.sort_array(F.collect_list(entry), asc=False).alias("stack"))


def open_rules(hosts: DataFrame, ruled: DataFrame) -> DataFrame:
    """(host, at): for each host (host, key) the places of hosts with rules (at, key) whose key begins its own: a sweep over sorted keys.

    A key's subdomains are the interval of keys that begin with it, and intervals are nested or apart. Each opening carries the stack of
    the intervals it lies in, and itself; the stack at a host is that of the last opening before it, without those that have closed,
    whose keys don't begin the host's. Keys are swept in ranges, cut at a bounded sample, and what is open at a cut is opened there again.
    """
    spark = hosts.sparkSession
    outer = ruled.select(F.col("at").alias("__at"), F.col("key").alias("__key"))
    labels = F.split("key", r"\.")
    begins = F.transform(F.sequence(F.lit(1), F.size(labels) - 1), lambda i: F.concat(F.array_join(F.slice(labels, F.lit(1), i), "."), F.lit(".")))
    entry = F.struct(F.length("__key").alias("n"), F.col("__key").alias("key"), F.col("__at").alias("at"))

    def stacked(keys: DataFrame) -> DataFrame:
        return keys.select("key", F.explode(begins).alias("__key")).join(outer, "__key").groupBy("key").agg(F.sort_array(F.collect_list(entry)).alias("stack"))

    ranges = -(-hosts.count() // RANGE_HOSTS)
    sample = [r.key for r in hosts.select("key").orderBy(F.xxhash64("key"), "key").limit(CUT_SAMPLE).collect()] if ranges > 1 else []  # bounded
    cuts = sorted({sorted(sample)[len(sample) * i // ranges] for i in range(1, ranges)}) if sample else []
    below = lambda some: F.size(F.filter(some, lambda c: c <= F.col("key")))
    run = 1 + int(len(cuts) ** 0.5)  # a key's range: first among every run-th cut, then among the cuts of that run
    number = (below(F.lit(cuts[run - 1 :: run])) * run + below(F.slice(F.lit(cuts), below(F.lit(cuts[run - 1 :: run])) * run + 1, F.lit(run)))) if len(cuts) > run else below(F.lit(cuts)) if cuts else F.lit(0)
    openings = stacked(ruled.select("key").distinct())
    if cuts:
        openings = openings.unionByName(stacked(spark.createDataFrame([(c,) for c in cuts], "key string"))).dropDuplicates(["key"])
    nothing = F.lit(None).cast(openings.schema["stack"].dataType)
    events = openings.select("key", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("host"), "stack").unionByName(hosts.select("key", F.lit(1).alias("kind"), "host", nothing.alias("stack")))
    sweep = Window.partitionBy("range").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, 0)
    swept = events.withColumn("range", number).withColumn("stack", F.last("stack", ignorenulls=True).over(sweep)).where("kind = 1 and stack is not null")
    return swept.select("host", F.explode(F.expr("filter(stack, x -> startswith(key, x.key))")).alias("x")).select("host", F.col("x.at").alias("at"))


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per row of ``pages``: (page_id, host, path, rule, verdict).

    A rule fits its host and all subdomains if the URL's path starts with the rule's; the longest rule (host and path together, then the
    longer host) wins; without one the rule is null and the verdict is ``default``.

    Plan: in the order of reversed hosts a rule's host and its subdomains are an interval. A sweep over the distinct hosts of the URLs and
    the hosts with rules (``open_rules``) tells which of the latter are open at each host. For each of them a URL makes a probe, and a
    second sweep, over the paths of that host's rules and of its probes, does the same for path prefixes: it carries the stack of the
    last rule opened, those that have closed no longer begin the path and are popped, and the top of what is left wins. A host
    with many URLs is swept in several salted runs, each with that host's rules, so no host meets in one task. Stacks are made once, from
    the rules alone, by joining each rule with those whose host or path begins its own. All is native SQL.

    Null URLs have an empty host and path and the default verdict. Repeated rows are judged once and give repeated rows, ``COPIES`` of one a
    task at most where there are more. Empty tables of pages or rules are
    fine. Other columns are not looked at.
    """
    host, path = split_url(F.col("__url"))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("__url")).select("page_id", host.alias("host"), path.alias("path"))
    rows = rows.groupBy("page_id", "host", "path").agg(F.count("*").alias("copies"))
    stacks = materialize(rule_stacks(rules).withColumn("key", host_key(F.col("host"))), "rules")
    hosts = stacks.groupBy("host", "key").agg(F.count("*").alias("rules"))
    known = hosts.count()
    full = materialize(rows.groupBy("host").agg(F.count("*").alias("c"), F.max("copies").alias("most")).withColumn("key", host_key(F.col("host"))), "hosts")
    at = materialize(open_rules(full.select("host", "key"), hosts.select(F.col("host").alias("at"), "key")), "open")
    fits = at.groupBy("host").agg(F.collect_list("at").alias("ats"))  # one entry per label of the host at most
    total, most = full.agg(F.coalesce(F.sum("c"), F.lit(0)), F.coalesce(F.max("most"), F.lit(0))).first()
    probes = join_hot(rows, fits, ["host"], hot_keys(full, total))
    probes = probes.select("page_id", F.col("host").alias("full"), "path", F.explode("ats").alias("host")).join(maybe_broadcast(hosts, known), "host")
    probes = materialize(probes.select("page_id", "full", "path", "host", "key", "rules"), "probes")
    runs = probes.groupBy("host", "key", "rules").agg(F.count("*").alias("n")).select("host", "key", F.ceil(F.col("n") / F.greatest(F.lit(SWEEP_ROWS), "rules")).alias("runs"))
    opened = stacks.join(runs, ["host", "key"]).withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.col("runs") - 1))).select("key", "run", "host", "path", F.lit(0).alias("kind"), F.lit(None).cast(rows.schema["page_id"].dataType).alias("page_id"), F.lit(None).cast("string").alias("full"), "stack")
    asked = probes.join(maybe_broadcast(runs, known), ["host", "key"]).select("key", F.pmod(F.xxhash64("page_id", "full", "path"), F.col("runs")).alias("run"), "host", "path", F.lit(1).alias("kind"), "page_id", "full", F.lit(None).cast(stacks.schema["stack"].dataType).alias("stack"))
    sweep = Window.partitionBy("key", "run").orderBy("path", "kind").rowsBetween(Window.unboundedPreceding, 0)
    swept = opened.unionByName(asked).withColumn("stack", F.last("stack", ignorenulls=True).over(sweep)).where("kind = 1 and stack is not null")
    top = swept.withColumn("top", F.expr("get(filter(stack, x -> startswith(path, x.path)), 0)")).where("top is not null")
    best = top.groupBy("page_id", F.col("full").alias("host"), "path").agg(F.max(F.struct((F.length("host") + F.col("top.n")).alias("n"), F.length("host").alias("h"), F.concat("host", "top.path").alias("rule"), F.col("top.verdict").alias("verdict"))).alias("won"))
    won = best.select(F.col("page_id").alias("__id"), F.col("host").alias("__host"), F.col("path").alias("__path"), "won")
    out = rows.join(won, F.col("page_id").eqNullSafe(F.col("__id")) & (F.col("host") == F.col("__host")) & (F.col("path") == F.col("__path")), "left")
    out = out.select("page_id", "host", "path", F.col("won.rule").alias("rule"), F.coalesce("won.verdict", F.lit(default)).alias("verdict"), "copies")
    times = lambda n: F.explode(F.sequence(F.lit(1).cast("long"), n))
    if most > COPIES:  # many copies of one row are dealt over tasks before they are rows again
        lots = out.withColumn("lot", times(F.ceil(F.col("copies") / COPIES))).repartition("page_id", "host", "lot")
        out = lots.withColumn("copies", F.least(F.lit(COPIES).cast("long"), F.col("copies") - (F.col("lot") - 1) * COPIES)).drop("lot")
    return out.withColumn("copy", times(F.col("copies"))).drop("copies", "copy")
