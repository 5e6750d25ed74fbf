"""URL verdicts by pattern rules, indexed by their rarest literal token. DataFrame functions only."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._scratch import set_apart, written

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """pattern: a regular expression that is looked for in host + path; the first '/' begins the path. literals: tokens (runs of letters and digits, lower
    case) of which every matching URL has each one. rank: of fitting rules, the highest wins; then the first of the list."""

    name: str
    verdict: str
    pattern: str
    literals: tuple[str, ...]
    rank: int = 0


def place_rule(verdict: str, place: str) -> Rule:
    """A rule for a host and its subdomains and the paths that start with the given one: `example.net/en/`. Longer places outrank shorter ones, and any
    place outranks a word."""
    host, _, path = place.partition("/")
    return Rule(place, verdict, rf"^(?:[^/]*\.)?{re.escape(host)}{re.escape('/' + path)}", tuple(_tokens(f"{host} {path.rpartition('/')[0]}")), 1000 + len(place))


def word_rule(word: str) -> Rule:
    """Blocks hosts with the word, or words joined by '-', between other signs."""
    return Rule(word, "block", rf"^(?:[^/]*[^a-z0-9/])?{re.escape(word)}(?:[^a-z0-9/][^/]*)?(?:/|\z)", tuple(_tokens(word)))


def _tokens(text: str) -> list[str]:
    return list(dict.fromkeys(re.findall("[a-z0-9]+", text.lower())))


#: The places a caller decides on by name.
PLACES = (place_rule("block", "net/"), place_rule("allow", "example.net/en/"), place_rule("block", "example.com/de/"), place_rule("allow", "org/fr/"))
#: The method's own rules: words of hosts that sell rather than tell.
WORDS = tuple(word_rule(w) for w in ("casino", "casino-win", "cheap-pills", "free-bets", "ads-track", "porn", "viagra", "payday-loans", "replica-watches", "click-bait"))


def host_of(url: Column) -> Column:
    """After the first '://' up to '/', '?', '#' or the end, A-Z lower-cased; empty without one."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to '?', '#' or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


RULES = "rule_id bigint, name string, verdict string, pattern string, literals array<string>, rank int"


def rule_table(spark: SparkSession, rules: tuple[Rule, ...]) -> DataFrame:
    """Rules in order as a table, as judged() takes it."""
    return spark.createDataFrame([(k, r.name, r.verdict, r.pattern, list(r.literals), r.rank) for k, r in enumerate(rules)], RULES)


def filed(rules: DataFrame, tokens: DataFrame) -> DataFrame:
    """(token, rule_id, name, verdict, pattern, rank): each rule under that literal of its own which the fewest URLs have; without literals, under ''.
    tokens: (token, n). Rules are few beside URLs, and their literals are counted in one join."""
    each = rules.select("rule_id", F.explode(F.array_distinct("literals")).alias("literal"))
    rarity = each.join(tokens, each["literal"] == tokens["token"], "left").groupBy("rule_id").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "literal")).alias("rarest"))
    return rules.join(rarity, "rule_id", "left").select(F.coalesce("rarest.literal", F.lit("")).alias("token"), "rule_id", "name", "verdict", "pattern", "rank")


def judged(pages: DataFrame, rules: DataFrame | tuple[Rule, ...], url_col: str = "url", default: str = "allow") -> DataFrame:
    """pages with host, path, rule (the winner's name, null if none fits) and verdict; columns of pages with these names, in any case, are replaced.
    rules: any number, as a table of the columns RULES, or a tuple; of fitting rules the highest rank wins, then the lowest rule_id.

    Each rule is filed under that literal of its own which the fewest URLs have, counted over all URLs. URLs' tokens fetch the rules filed under them, in a
    join that the planner broadcasts while the rules are few and splits where a token is in many URLs; only fetched rules run their expressions, and only
    hosts and paths that a rule fits, each with its best, are shuffled and joined back. Rules without literals run on every URL. Null URLs and URLs without '://' have an empty host and path,
    which no place fits. URLs of any length are read whole. Rows that repeat are judged alike; an empty table, or no rules, gives an empty result, or the default.
    """
    spark = pages.sparkSession
    rules = rule_table(spark, rules) if isinstance(rules, tuple) else rules.select(*(x.split()[0] for x in RULES.split(", ")))
    added = ("host", "path", "rule", "verdict")
    apart, rest = set_apart(pages, (url_col,), added)
    base = apart.withColumns({"host": host_of(F.col("in0")), "path": path_of(F.col("in0"))})
    subject = F.concat("host", "path")
    # A-Z alone, as hosts: other capitals, such as the Kelvin sign, stay what rules take them for.
    tokens = F.array_union(F.regexp_extract_all(F.translate(subject, _UPPER, _LOWER), F.lit("[a-z0-9]+"), F.lit(0)), F.array(F.lit("")))
    each = base.select("host", "path", tokens.alias("tokens"))
    # Counted before they meet the rules: a token that a third of all URLs have is combined where it lies.
    counts = each.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    index = written(filed(rules, counts))
    fetched = each.select("host", "path", F.explode("tokens").alias("token")).join(index, "token").where(F.regexp_like(subject, F.col("pattern")))
    best = fetched.groupBy("host", "path").agg(F.max(F.struct("rank", (-F.col("rule_id")).alias("turn"), "name", "verdict")).alias("best"))
    best = best.select(F.col("host").alias("of_host"), F.col("path").alias("of_path"), "best")
    out = base.join(best, (base["host"] == best["of_host"]) & (base["path"] == best["of_path"]), "left")
    out = out.withColumns({"rule": F.col("best.name"), "verdict": F.coalesce("best.verdict", F.lit(default))})
    names = {url_col.lower(): "in0"} | {c.lower(): f"c{k}" for k, c in enumerate(rest)}
    own = [c for c in pages.columns if c.lower() not in added]
    return out.select(*(names[c.lower()] for c in own), *added).toDF(*own, *added)
