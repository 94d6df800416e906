"""URL filters: pattern rules found by their rarest literal token.

A rule is (name, verdict, regular expression). The tokens that a url must have for it are read off the expression,
and the rule is filed under that of them which the fewest urls hold; the tokens of a url fetch the rules filed
under them, and only those run.
The regular expressions see ``host + path``: the host with A-Z lower-cased, the path as it is. They are Java's, as Spark runs
them: a pattern that Java doesn't know is a ValueError before anything runs. Tokens are read off what Java and Python write alike;
a pattern with anything else has none and runs on every url, with the same results.

Defined results: a null url, or one without ``://``, has an empty host and path and matches no rule; urls
that repeat get equal results; columns named host, path, rule, verdict or pattern are replaced.
"""

from __future__ import annotations

import re
import string
from dataclasses import dataclass
from re import _parser as parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, small, stash

TOKEN = "[A-Za-z0-9]+"


@dataclass(frozen=True)
class Rule:
    """``weight`` orders the rules that match; ties go to the smaller name."""

    name: str
    verdict: str
    pattern: str
    weight: int
    named: bool = True


#: What Java reads otherwise than Python, which would take it for something else: classes within classes, quoted parts, octal numbers.
OTHERWISE = re.compile(r"&&|\\Q|\\0|\[[^\]]*\[")


def checked(spark, rule: Rule) -> Rule:
    """The rule, whose pattern Java knows."""
    try:
        spark.sparkContext._jvm.java.util.regex.Pattern.compile(rule.pattern)
    except Exception as e:
        told = str(getattr(e, "java_exception", e)).splitlines()[0]
        raise ValueError(f"rule {rule.name}: {rule.pattern!r} is no Java regular expression ({told})") from None
    return rule


def literals(pattern: str) -> set[str]:
    """The tokens that every url has in which the pattern is found: runs of literal letters and digits, outside of
    choices and repeats, beside which only the url's ends or other characters can be."""
    if OTHERWISE.search(pattern):
        return set()
    try:
        parsed = parser.parse(pattern)
    except (re.error, OverflowError):
        return set()
    if parsed.state.flags & (re.IGNORECASE | re.VERBOSE):
        return set()
    seq = list(parsed)

    def plain(code: int) -> bool:
        return re.fullmatch(TOKEN, chr(code)) is not None

    def outer(item) -> bool:
        """Whether what the item takes is one character, which is no letter or digit, at either end."""
        op, arg = item
        name = str(op)
        if name == "LITERAL":
            return not plain(arg)
        if name == "IN":
            if str(arg[0][0]) == "NEGATE":
                taken = {c for k, v in arg[1:] if str(k) in ("LITERAL", "RANGE") for c in (range(v[0], v[1] + 1) if str(k) == "RANGE" else (v,))}
                return all(ord(c) in taken for c in string.ascii_letters + string.digits)
            return all(str(k) == "LITERAL" and not plain(v) for k, v in arg)
        return False

    def side(items: list, at: int, step: int) -> bool:
        """Whether the items before (-1) or after (1) a place can only be the url's end or another character."""
        if not 0 <= at < len(items):
            return False
        op, arg = items[at]
        name = str(op)
        if name == "AT":
            return str(arg) in (("AT_BEGINNING", "AT_BEGINNING_STRING") if step < 0 else ("AT_END_STRING",)) or (step > 0 and str(arg) == "AT_END")
        if name == "SUBPATTERN":
            inner = list(arg[-1])
            return bool(inner) and side(inner, len(inner) - 1 if step < 0 else 0, step)
        if name == "BRANCH":
            return all(bool(list(b)) and side(list(b), len(b) - 1 if step < 0 else 0, step) for b in arg[1])
        if name in ("MAX_REPEAT", "MIN_REPEAT"):
            low, _, sub = arg
            sub = list(sub)
            return bool(sub) and side(sub, len(sub) - 1 if step < 0 else 0, step) and (low > 0 or side(items, at + step, step))
        return outer(items[at])

    found, at = set(), 0
    while at < len(seq):
        end = at
        while end < len(seq) and str(seq[end][0]) == "LITERAL" and plain(seq[end][1]):
            end += 1
        if end > at and side(seq, at - 1, -1) and side(seq, end, 1):
            found.add("".join(chr(c) for _, c in seq[at:end]))
        at = max(end, at + 1)
    return found


def site_rule(verdict: str, site: str) -> Rule:
    """``host/path`` that fits the host, its subdomains, and paths that start with the path."""
    return Rule(site, verdict, rf"^(?:[^/]*\.)?{re.escape(site)}", 1_000_000 + len(site))


def word_rule(verdict: str, *tokens: str) -> Rule:
    """Words that stand side by side in the url, each as a whole token."""
    return Rule("word:" + "-".join(tokens), verdict, r"(?:^|[^A-Za-z0-9])" + "[^A-Za-z0-9]".join(tokens) + r"(?:[^A-Za-z0-9]|$)", len(tokens), named=False)


#: Rules of the contract.
SITE_RULES = (
    site_rule("allow", "com/"), site_rule("block", "example.com/en/"), site_rule("allow", "www.example.com/en/"),
    site_rule("block", "net/es/"), site_rule("block", "net/fr/"),
)
#: The method's own rules, for urls that no rule of the contract fits.
WORD_RULES = (
    word_rule("block", "spam", "farm"), word_rule("block", "cheap", "pills"), word_rule("block", "casino"), word_rule("block", "porn"),
    word_rule("block", "xxx"), word_rule("block", "torrent"), word_rule("block", "free", "money"), word_rule("block", "viagra"),
)


def url_host(url: Column) -> Column:
    return lower_ascii(F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), F.lit("")))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def url_filter(pages: DataFrame, rules: tuple[Rule, ...] = SITE_RULES + WORD_RULES, url: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with host, path, rule (null unless a named rule decided), verdict and pattern (whatever decided).

    Work is done once per distinct host and path, counted before the shuffle; verdicts are joined back.
    The rules are given by the caller, so the index has as many rows as there are rules. A rule whose pattern has no
    literal token runs on every url.
    """
    spark = pages.sparkSession
    rules = tuple(checked(spark, r) for r in rules)
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict", "pattern")]
    page = pages.select(F.struct(*kept).alias("_row"), url_host(F.col(url)).alias("host"), url_path(F.col(url)).alias("path"))
    if not rules:
        return page.select("_row.*", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"), F.lit(None).cast("string").alias("pattern"))
    sites = stash(page.select("host", "path").distinct(), "urls")
    # a token that no url has stands for the rules without a literal
    tokens = F.array_append(F.array_distinct(F.regexp_extract_all("site", F.lit(f"({TOKEN})"), F.lit(1))), F.lit(""))
    found = sites.select("host", "path", F.concat("host", "path").alias("site")).withColumn("token", F.explode(tokens))
    of = {r: literals(r.pattern) for r in rules}
    wanted = spark.createDataFrame([(t,) for t in sorted(set().union(*of.values()))], "wanted string")
    have = dict(found.join(small(wanted), F.col("token") == F.col("wanted")).groupBy("token").count().collect())  # no more rows than literals
    filed = [(min(of[r], key=lambda t: (have.get(t, 0), t), default=""), r.name, r.verdict, r.pattern, r.weight, r.named) for r in rules]
    index = spark.createDataFrame(filed, "token string, name string, verdict string, pattern string, weight int, named boolean")
    hits = found.join(small(index), "token").filter(F.expr("site rlike pattern"))
    # the greatest weight wins, then the smallest name
    best = hits.groupBy("host", "path").agg(F.min(F.struct((-F.col("weight")).alias("w"), "name", "verdict", "named")).alias("b"))
    best = best.select(F.col("host").alias("_h"), F.col("path").alias("_p"), "b")
    out = page.join(best, (F.col("host") == F.col("_h")) & (F.col("path") == F.col("_p")), "left")
    # in two steps, so that no name of the caller's is taken for one of these
    added = F.struct("host", "path", F.when(F.col("b.named"), F.col("b.name")).alias("rule"), F.coalesce(F.col("b.verdict"), F.lit(default)).alias("verdict"), F.col("b.name").alias("pattern"))
    return out.select("_row", added.alias("_added")).select("_row.*", "_added.*")
