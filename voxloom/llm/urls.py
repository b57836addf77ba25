"""URL filter: path rules first, then trust and distrust spread over the links of hosts.

A url is judged by the longest rule that fits.  Hosts most of whose pages a rule allows are
trusted seeds, hosts most of whose pages a rule blocks are blocked seeds; a linked host without
a page is judged as its path ``/`` would be.  Over the distinct host links of all pages, weighted by the pages that carry them, trust is a personalised
PageRank along the links, and distrust one against them: linking to a blocked host is what
makes a host suspicious.

Distrust of a blocked host is divided among all that link to it, so its size says little in a
large graph.  ``reach`` is not divided: it is the damped chance that a walk along a host's
links comes to a blocked host.  A page without a rule is blocked when its host's distrust or
reach comes to ``THRESHOLD`` and its distrust exceeds its trust.

All three start from the seeds' shares and are iterated until no host's value changes by more
than ``TOLERANCE`` of itself; changes below ``LEAST`` count as none.

DataFrame functions only.  Links are reduced to distinct host pairs before any iteration.
Null urls, and urls without ``://``, have an empty host and path, belong to no host of the
graph and are allowed.  Pages without html, or with relative links only, add no edge.
Repeated rows are pages of their own; an empty table gives an empty result.
"""

from pyspark.sql import Column, DataFrame, functions as F

from voxloom.llm.common import LOWER, UPPER, kept

# Fixed values: (verdict, host, path).
RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)
FOLLOW = 0.85
ROUNDS = 8  # rounds before the first look at convergence
KEEP_EVERY = 4  # rounds between written states
TOLERANCE, LEAST = 1e-6, 1e-13
THRESHOLD = 0.01
LINK = r"""(?i)href\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^"'\s>/?#]+)"""


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), "^([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def longest_rule(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, verdict) of the longest fitting rule, null without one."""
    ordered = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    fits = [
        F.when(
            ((host == name) | host.endswith("." + name)) & path.startswith(start),
            F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict")),
        )
        for verdict, name, start in ordered
    ]
    return F.coalesce(*fits)


def host_links(pages: DataFrame) -> DataFrame:
    """src, dst, along, against: a link's share of what leaves src and of what reaches dst."""
    linked = F.transform(F.regexp_extract_all("html", F.lit(LINK), 1), lambda h: F.translate(h, UPPER, LOWER))
    pairs = (
        pages.select(host_of(F.col("url")).alias("src"), F.explode(F.array_distinct(linked)).alias("dst"))
        .where("src <> '' and dst <> '' and src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))
    )
    pairs = kept(pairs, "host-pairs")
    leaving = pairs.groupBy("src").agg(F.sum("n").alias("leaving"))
    reaching = pairs.groupBy("dst").agg(F.sum("n").alias("reaching"))
    return kept(
        pairs.join(leaving, "src").join(reaching, "dst").select(
            "src", "dst", (F.col("n") / F.col("leaving")).alias("along"), (F.col("n") / F.col("reaching")).alias("against")
        ),
        "host-links",
    )


def propagate(seeds: DataFrame, links: DataFrame) -> DataFrame:
    """host, trust, distrust, reach, iterated until they stand, from ``seeds(host, trusted, blocked)``."""
    none, names = F.lit(0.0), ("trust", "distrust", "reach")
    start = seeds.select(
        "host", (F.col("trusted") * (1 - FOLLOW)).alias("trust"),
        *[(F.col("blocked") * (1 - FOLLOW)).alias(c) for c in names[1:]],
    )
    ways = links.select(F.col("src").alias("at"), F.col("dst").alias("to"), F.col("along").alias("t"), none.alias("d"), none.alias("r"))
    ways = ways.unionByName(
        links.select(F.col("dst").alias("at"), F.col("src").alias("to"), none.alias("t"), F.col("against").alias("d"), F.col("along").alias("r"))
    )
    if links.isEmpty():
        return start
    state, turn = start, 0
    while True:
        turn += 1
        moved = ways.join(state, ways["at"] == state["host"]).select(
            F.col("to").alias("host"), *[(F.col(c) * F.col(w) * FOLLOW).alias(c) for c, w in zip(names, "tdr")]
        )
        looked = turn % KEEP_EVERY == 0
        parts = [moved, start] if not looked else [moved, start, state]
        sides = [
            p.select("host", *[F.col(c) if i < 2 else none.alias(c) for c in names],
                     *[(F.col(c) if i == 2 else none).alias(f"old_{c}") for c in names])
            for i, p in enumerate(parts)
        ]
        both = sides[0]
        for side in sides[1:]:
            both = both.unionByName(side)
        sums = both.groupBy("host").agg(*[F.sum(c).alias(c) for c in (*names, *(f"old_{c}" for c in names))])
        if not looked:
            state = sums.select("host", *names)
            continue
        sums = kept(sums, "host-state")
        state = sums.select("host", *names)
        moving = [F.abs(F.col(c) - F.col(f"old_{c}")) > TOLERANCE * F.col(c) + LEAST for c in names]
        if turn >= ROUNDS and sums.where(moving[0] | moving[1] | moving[2]).isEmpty():
            return state


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust of every page."""
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    parsed = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn(
        "found", longest_rule(F.col("host"), F.col("path"), rules)
    )
    share = lambda verdict: F.avg(F.coalesce(F.col("found.verdict") == verdict, F.lit(False)).cast("int"))
    seeds = kept(
        parsed.where("host <> ''").groupBy("host").agg(share("allow").alias("allowed"), share("block").alias("barred"))
        .select(
            "host", (F.col("allowed") > 0.5).cast("double").alias("trusted"),
            (F.col("barred") > 0.5).cast("double").alias("blocked"),
        ),
        "host-seeds",
    )
    links = host_links(pages)
    unseen = links.select(F.col("dst").alias("host")).distinct().join(seeds, "host", "left_anti").withColumn(
        "verdict", longest_rule(F.col("host"), F.lit("/"), rules)["verdict"]
    ).where("verdict is not null")
    unseen = unseen.select(
        "host", (F.col("verdict") == "allow").cast("double").alias("trusted"),
        (F.col("verdict") == "block").cast("double").alias("blocked"),
    )
    state = propagate(kept(seeds.unionByName(unseen), "all-seeds"), links).select(
        F.col("host").alias("h"), *[F.round(c, 12).alias(c) for c in ("trust", "distrust", "reach")]
    )
    suspect = (F.greatest("distrust", "reach") >= THRESHOLD) & (F.col("distrust") > F.col("trust"))
    by_graph = F.when(F.coalesce(suspect, F.lit(False)), "block").otherwise("allow")
    return parsed.join(state, F.col("host") == F.col("h"), "left").select(
        "page_id", "host", "path", F.col("found.rule").alias("rule"),
        F.coalesce(F.col("found.verdict"), by_graph).alias("verdict"),
        F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"),
    )
