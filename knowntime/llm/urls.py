"""URL filters: longest-matching rules, then trust and distrust propagated over host links.

Rules name a host (its subdomains included) and a path prefix. Pages that no
rule fits are judged by their host: personalised PageRank carries trust from
hosts with allowed pages along links, and distrust from hosts with blocked pages
against the links' direction (a host that links to bad hosts is suspect); a host
whose distrust exceeds ``ratio`` times its trust is blocked.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knowntime.llm._shared import release, stash

TOGETHER = 4


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _suffixes(host: Column) -> Column:
    """The host and every domain above it."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def match_rules(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """(page_id, url, ...) and (verdict, rule) -> page_id, url, host, path, rule, rule_verdict.

    ``rule`` is ``host/path-prefix``. The longest fitting rule wins, then the
    smaller text, then block before allow. Rules are looked up once per distinct
    host; the join back to pages splits a hot host.
    """
    rules = rules.select(
        "rule", "verdict", F.lower(F.substring_index("rule", "/", 1)).alias("rule_host"), F.expr("substring(rule, instr(rule, '/'))").alias("rule_path")
    ).where(F.col("rule").contains("/"))
    named = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    above = named.select("host").distinct().select("host", F.explode(_suffixes(F.col("host"))).alias("rule_host"))
    order = F.struct((-F.length("rule")).alias("n"), "rule", F.when(F.col("verdict") == "block", 0).otherwise(1).alias("k"), "rule_path", "verdict")
    by_host = stash(above.join(rules, "rule_host").groupBy("host").agg(F.array_sort(F.collect_list(order)).alias("fits")))
    best = F.try_element_at(F.filter("fits", lambda r: F.startswith(F.col("path"), r["rule_path"])), F.lit(1))
    return named.join(by_host, "host", "left").select("page_id", "url", "host", "path", best["rule"].alias("rule"), best["verdict"].alias("rule_verdict"))


def host_links(pages: DataFrame) -> DataFrame:
    """(src, dst, n): absolute links between different hosts in ``html``, and each host
    with the domain directly above it both ways. Counted before the shuffle ends."""
    out = pages.select(
        host_of(F.col("url")).alias("src"),
        F.explode(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(r"""(?i)href\s*=\s*["']?((?:https?:)?//[^/?#"'\s>]+)"""), F.lit(1))).alias("to"),
    ).select("src", host_of(F.concat(F.lit("x:"), F.regexp_replace("to", "^(?i)https?:", ""))).alias("dst"))
    hosts = pages.select(host_of(F.col("url")).alias("src")).distinct()
    up = hosts.where("size(split(src, '[.]')) > 2").select("src", F.expr("substring(src, instr(src, '.') + 1)").alias("dst"))
    links = out.where("src <> dst and src <> '' and dst <> ''").unionByName(up).unionByName(up.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return links.groupBy("src", "dst").agg(F.count("*").alias("n"))


def propagate(links: DataFrame, seeds: DataFrame, damping: float = 0.85, rounds: int | None = None, tolerance: float = 1e-6) -> DataFrame:
    """(src, dst, n) links and (host, trusted, blocked) page counts -> (host, trust, distrust).

    Both walks advance ``TOGETHER`` rounds in a job, written to the shared folder, until
    the sum over hosts of the absolute changes of both over a job is at most ``tolerance``
    or ``rounds`` are done; without ``rounds``, those
    after which damping leaves no larger change. Totals are 1 at most, so neither
    depends on the number of hosts. Weight on a host without links in a walk's
    direction is lost, as with seeds only.
    """
    if rounds is None:  # a round's change is 2 * damping ** round at most, for two walks
        rounds = math.ceil(math.log(tolerance / 4) / math.log(damping))
    hosts = stash(links.select(F.col("src").alias("host")).union(links.select(F.col("dst").alias("host"))).union(seeds.select("host")).distinct())
    sums = seeds.agg(F.greatest(F.sum("trusted"), F.lit(1)).alias("t"), F.greatest(F.sum("blocked"), F.lit(1)).alias("b")).first()
    total_t, total_b = (sums["t"] or 1), (sums["b"] or 1)
    start = stash(
        hosts.join(seeds, "host", "left").select("host", (F.coalesce("trusted", F.lit(0)) / F.lit(float(total_t))).alias("s_t"), (F.coalesce("blocked", F.lit(0)) / F.lit(float(total_b))).alias("s_d"))
    )
    out_n = links.groupBy("src").agg(F.sum("n").alias("out_n"))
    in_n = links.groupBy("dst").agg(F.sum("n").alias("in_n"))
    moves = links.join(out_n, "src").join(in_n, "dst")
    moves = stash(
        moves.select(F.col("src").alias("at"), F.col("dst").alias("to"), (F.col("n") / F.col("out_n")).alias("w_t"), F.lit(0.0).alias("w_d")).unionByName(
            moves.select(F.col("dst").alias("at"), F.col("src").alias("to"), F.lit(0.0).alias("w_t"), (F.col("n") / F.col("in_n")).alias("w_d"))
        )
    )
    state = start.select("host", F.col("s_t").alias("trust"), F.col("s_d").alias("distrust"))
    restart = start.select("host", ((1 - damping) * F.col("s_t")).alias("t"), ((1 - damping) * F.col("s_d")).alias("d"))
    done = 0
    while done < rounds:
        new = state
        for _ in range(min(TOGETHER, rounds - done)):
            sent = moves.join(new, moves["at"] == new["host"]).select(F.col("to").alias("host"), (damping * F.col("w_t") * F.col("trust")).alias("t"), (damping * F.col("w_d") * F.col("distrust")).alias("d"))
            new = restart.unionByName(sent).groupBy("host").agg(F.sum("t").alias("trust"), F.sum("d").alias("distrust"))
            done += 1
        new = stash(new)
        old = state.select("host", F.col("trust").alias("old_t"), F.col("distrust").alias("old_d"))
        change = new.join(old, "host").agg(F.sum(F.abs(F.col("trust") - F.col("old_t")) + F.abs(F.col("distrust") - F.col("old_d"))).alias("c")).first()["c"] or 0.0
        release(state)
        state = new
        if change <= tolerance:
            break
    return state.select("host", "trust", "distrust")


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str]] | DataFrame, ratio: float = 1.0) -> DataFrame:
    """(page_id, url, html) and (verdict, rule) pairs -> page_id, host, path, rule, verdict,
    trust, distrust; one row per row.

    A null url, or one without ``://``, has empty host and path; such a page, and
    one whose host neither walk reaches, is allowed.
    """
    if not isinstance(rules, DataFrame):
        rules = pages.sparkSession.createDataFrame([tuple(r) for r in rules], "verdict string, rule string")
    pages = pages.select("page_id", F.col("url").cast("string"), F.col("html").cast("string"))
    ruled = match_rules(pages, rules)
    seeds = stash(
        ruled.where("rule is not null and host <> ''").groupBy("host").agg(
            F.count_if(F.col("rule_verdict") == "allow").alias("trusted"), F.count_if(F.col("rule_verdict") == "block").alias("blocked")
        )
    )
    scores = propagate(stash(host_links(pages)), seeds)
    method = F.when(F.coalesce("distrust", F.lit(0.0)) > ratio * F.coalesce("trust", F.lit(0.0)), "block").otherwise("allow")
    return ruled.join(scores, "host", "left").select(
        "page_id", "host", "path", "rule", F.coalesce("rule_verdict", method).alias("verdict"), F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust")
    )
