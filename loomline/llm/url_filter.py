"""URL filtering by rules that are fetched through their rarest literal token. DataFrame functions only."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rules are broadcast up to this number; beyond it they are joined by a shuffle.
BROADCAST_RULES = 100_000


@dataclass(frozen=True)
class Rule:
    """kind: 'domain' fits host + path and names the rule; 'pattern' fits the lower-cased url and only decides the rest. tokens: literals (runs of a-z0-9) that any fitting url holds whole; one written as a|b stands for alternatives, at least one of which it holds."""

    name: str
    kind: str
    regex: str
    action: str
    tokens: tuple[str, ...]


def domain_rule(name: str, action: str) -> Rule:
    """name: host and path, as in example.net/en/."""
    host, slash, path = name.partition("/")
    words = re.split("[^a-z0-9]+", (host + slash + path).lower())
    whole = words if not name[-1].isalnum() else words[:-1]
    return Rule(name, "domain", r"(?s)\A(?:[^/?#]*\.)?" + re.escape(host) + re.escape(slash + path), action, tuple(sorted({w for w in whole if w})) or tuple(w for w in words if w)[:1])


def pattern_rule(name: str, regex: str, tokens: str, action: str = "block") -> Rule:
    return Rule(name, "pattern", regex, action, tuple(tokens.split()))


DOMAIN_RULES = (domain_rule("net/", "block"), domain_rule("example.net/en/", "allow"), domain_rule("example.com/de/", "block"), domain_rule("org/fr/", "allow"))
#: Pages that seldom hold prose: advertisements, accounts, carts, session copies.
PATTERN_RULES = (
    pattern_rule("ad path", r"/ads?/", "ad|ads"),
    pattern_rule("ads path", r"/ads/", "ads"),
    pattern_rule("banner path", r"/banner/", "banner"),
    pattern_rule("login page", r"/login(?:[/?#.]|$)", "login"),
    pattern_rule("sign-up page", r"/signup(?:[/?#.]|$)", "signup"),
    pattern_rule("cart page", r"/cart(?:[/?#.]|$)", "cart"),
    pattern_rule("checkout page", r"/checkout(?:[/?#.]|$)", "checkout"),
    pattern_rule("session copy", r"[?&;](?:php|j)?sessionid=", "sessionid|phpsessionid|jsessionid"),
    pattern_rule("php session copy", r"[?&;]phpsessid=", "phpsessid"),
    pattern_rule("print copy", r"[?&]print=[1y]", "print"),
    pattern_rule("calendar export", r"\.ics(?:[?#]|$)", "ics"),
)


def rule_table(spark: SparkSession, rules: tuple[Rule, ...]) -> DataFrame:
    kind = "array<struct<name:string,kind:string,regex:string,action:string,tokens:array<string>>>"
    rows = F.array(*(F.struct(F.lit(r.name).alias("name"), F.lit(r.kind).alias("kind"), F.lit(r.regex).alias("regex"), F.lit(r.action).alias("action"), F.array(*map(F.lit, r.tokens)).alias("tokens")) for r in rules)) if rules else F.array()
    return spark.range(1).select(F.inline(rows.cast(kind)))


def url_filter(pages: DataFrame, rules: tuple[Rule, ...] = DOMAIN_RULES + PATTERN_RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per page: id, host, path, rule, verdict, matched patterns.

    The longest domain rule that fits gives rule and verdict (ties: the smaller name); otherwise a page is blocked if a
    blocking pattern fits, else allowed. A null url, or one without ://, has an empty host and path and is allowed.
    Each rule is indexed under its literal token (or all alternatives of one) that the fewest distinct urls hold; a url's
    tokens fetch candidate rules, and only those run their regular expressions, once per distinct url. Repeated rows each get their row; an
    empty table gives none; other columns are ignored.
    """
    spark = pages.sparkSession
    base = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"))
    rest = F.when(F.instr("url", "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    parts = {"host": F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER), "path": F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)}
    urls = base.filter("url is not null").select("url").distinct().withColumns(parts).withColumn("low", F.translate("url", UPPER, LOWER))
    tokens = F.filter(F.array_distinct(F.split("low", "[^a-z0-9]+")), lambda t: t != "")
    table = rule_table(spark, rules)
    small = (lambda df: F.broadcast(df)) if len(rules) <= BROADCAST_RULES else (lambda df: df)
    ruled = table.select("name", "kind", "regex", "action", F.explode("tokens").alias("tokens")).withColumn("token", F.explode(F.split("tokens", r"\|")))
    seen = urls.select(F.explode(tokens).alias("token")).join(small(ruled.select("token").distinct()), "token", "left_semi").groupBy("token").agg(F.count("*").alias("n"))
    rarest = ruled.join(seen, "token", "left").groupBy("name", "kind", "regex", "action", "tokens").agg(F.sum(F.coalesce("n", F.lit(0))).alias("n"))
    rarest = rarest.groupBy("name", "kind", "regex", "action").agg(F.min_by("tokens", F.struct("n", "tokens")).alias("tokens")).withColumn("token", F.explode(F.split("tokens", r"\|"))).drop("tokens")
    fetched = urls.withColumn("token", F.explode(tokens)).join(small(rarest), "token")
    fits = F.when(F.col("kind") == "domain", F.expr("rlike(concat(host, path), regex)")).otherwise(F.expr("rlike(low, regex)"))
    matched = fetched.filter(fits).groupBy("url").agg(
        F.min(F.when(F.col("kind") == "domain", F.struct((-F.length("name")).alias("rank"), "name", "action"))).alias("best"),
        F.array_sort(F.collect_set(F.when(F.col("kind") == "pattern", F.col("name")))).alias("patterns"),
        F.max(F.when((F.col("kind") == "pattern") & (F.col("action") == "block"), 1).otherwise(0)).alias("bad"),
    )
    verdict = F.coalesce("best.action", F.when(F.col("bad") == 1, "block").otherwise("allow"))
    # a second key spreads null urls, which match nothing, over the join's tasks
    spread = F.when(F.col("url").isNull(), F.pmod(F.monotonically_increasing_id(), F.lit(1024))).otherwise(F.length("url") % 1).cast("int")
    out = base.withColumn("spread", spread).join(matched.withColumn("spread", (F.length("url") % 1).cast("int")), ["url", "spread"], "left").withColumns(parts)
    return out.select(F.col("id").alias(id_col), "host", "path", F.col("best.name").alias("rule"), verdict.alias("verdict"), F.array_join("patterns", ",").alias("patterns"))
