"""URL filters with a token index (native).

A rule is a regular expression, over host and path (``site``) or over all that follows the first ``://``, in lower case, with
the literal tokens (``[0-9a-z]+`` runs) that every url it finds holds as whole tokens. ``literal_tokens`` takes them from the
expression: a literal counts only if nothing that may stand beside it can be a letter or digit. Each rule is indexed by the one
of its tokens that is rarest among the urls. The distinct tokens of a url fetch the rules indexed by them, and only those run
their expression. A rule without such a token is indexed by the empty token, which every url has.

A site rule allows or blocks a host with its subdomains where the path starts with the rule's; the longest that fits decides.
Where none fits, a url that one of the other rules finds is blocked and all else is allowed.

Verdicts are functions of the url, so rules are matched once per distinct url and joined back on the url; joins are shuffled
unless the smaller side was measured to be small, and Spark may split a hot url.

Defined results: a null url, or one without ``://``, has empty host and path, no rule, and is allowed; of several ``://`` the
first counts; repeated rows are judged alike; of rules of one length the last name decides; a url of any length is read whole;
empty tables, and an empty rule table, give empty results and all allowed; extra columns pass through, whatever their names,
and columns of the input named like an added one are replaced.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, carried, restored, small, stored


@dataclass(frozen=True)
class Rule:
    name: str
    verdict: str
    pattern: str
    weight: int = 0  # of a site rule: the length of its host and path
    site: bool = False


RULES = "name string, verdict string, pattern string, weight int, site boolean, tokens array<string>"


def host_rule(verdict: str, host: str, path: str) -> Rule:
    """A rule on a host with its subdomains and the start of a path."""
    if path and path[0] != "/":
        raise ValueError(f"the path {path!r} does not begin with a slash, as all paths do")
    return Rule(host + path, verdict, rf"^(?:[^/]*\.)?{re.escape(host)}{re.escape(path) if path else r'(?:/|\z)'}", len(host + path), True)


#: The base rules (verdict, host, path).
SITES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
BASE = [host_rule(*x) for x in SITES]


def _host_word(word: str) -> str:
    return rf"^(?:[^/?#]*[.-])?{word}(?:[.-][^/?#]*)?(?:[/?#]|\z)"


#: Patterns over the lower-cased url behind its ``://``.
PATTERNS = [
    Rule("spam-host", "block", _host_word("spam")),
    Rule("pills-host", "block", _host_word("pills")),
    Rule("casino-host", "block", _host_word("casino")),
    Rule("adult-host", "block", _host_word("xxx")),
    Rule("number-host", "block", r"^[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?::[0-9]+)?(?:[/?#]|\z)"),
    Rule("free-download", "block", r"free[-_]download"),
    Rule("login-page", "block", r"/login(?:[/?#.]|\z)"),
    Rule("admin-page", "block", r"/wp-admin(?:[/?#]|\z)"),
    Rule("calendar-trap", "block", r"/calendar/[0-9]{4}/[0-9]{1,2}(?:[/?#]|\z)"),
    Rule("session-query", "block", r"[?&;](?:jsessionid|phpsessid|sid)="),
    Rule("affiliate-query", "block", r"[?&]affiliate="),
]


# --- the tokens of an expression -----------------------------------------------------------------------------------------


def _alnum(code: int) -> bool:
    return code < 128 and chr(code).isalnum()


def _flat(items) -> list:
    """The parts of a concatenation, with plain groups opened."""
    out = []
    for kind, value in items:
        name = str(kind)
        if name == "SUBPATTERN" and not value[1] and not value[2]:
            out += _flat(value[3])
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and value[0] == value[1] == 1:
            out += _flat(value[2])
        else:
            out.append((name, value))
    return out


def _apart(items: list, at: int, left: bool, beyond) -> bool:
    """Whether what stands next to a literal, as ``items`` from ``at`` on lead away from it, is surely no letter or digit."""
    if at == len(items):
        return beyond()
    name, value = items[at]
    after = lambda: _apart(items, at + 1, left, beyond)
    inner = lambda part, then: _apart(_flat(part)[::-1] if left else _flat(part), 0, left, then)
    if name == "LITERAL":
        return not _alnum(value)
    if name == "AT":
        return str(value) in (("AT_BEGINNING", "AT_BEGINNING_STRING", "AT_BOUNDARY") if left else ("AT_END", "AT_END_STRING", "AT_BOUNDARY"))
    if name == "IN":
        return all(str(k) == "LITERAL" and not _alnum(v) or str(k) == "RANGE" and not any(map(_alnum, range(v[0], min(v[1], 127) + 1))) for k, v in value)
    if name == "BRANCH":
        return all(inner(part, after) for part in value[1])
    if name == "SUBPATTERN" and not value[1] and not value[2]:
        return inner(value[3], after)
    if name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
        return inner(value[2], after) and (value[0] > 0 or after())
    return False


def literal_tokens(pattern: str) -> tuple[str, ...]:
    """Tokens, in lower case, that every text in which ``pattern`` is found holds as whole ones; none if that is not sure."""
    from re import _parser

    try:
        items = _flat(_parser.parse(pattern.replace(r"\z", r"\Z")))
    except re.error:
        return ()
    found, at = [], 0
    nothing = lambda: False  # noqa: E731  the text around a find may hold anything
    while at < len(items):
        to = at
        while to < len(items) and items[to][0] == "LITERAL" and _alnum(items[to][1]):
            to += 1
        if to > at and _apart(items[:at][::-1], 0, True, nothing) and _apart(items[to:], 0, False, nothing):
            found.append("".join(chr(v) for _, v in items[at:to]).lower())
        at = max(to, at + 1)
    return tuple(dict.fromkeys(found))


# --- urls --------------------------------------------------------------------------------------------------------------


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case."""
    return ascii_lower(F.regexp_extract(_after(url), r"^([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_after(url), r"^[^/?#]*([^?#]*)", 1)


def _after(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def tokens_of(url: Column) -> Column:
    """The distinct tokens of a url, and the empty one."""
    return F.array_distinct(F.array_append(F.split(ascii_lower(url), "[^0-9a-z]+"), F.lit("")))


def rule_rows(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    """Rules as a table ``RULES``, with the tokens of their expressions."""
    return spark.createDataFrame([(r.name, r.verdict, r.pattern, r.weight, r.site, list(literal_tokens(r.pattern))) for r in rules], RULES)


def indexed(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """The rules with ``token``: the one of theirs that the fewest urls (``link``) hold (ties: the smaller text), empty without one."""
    rules = rules.distinct().withColumn("rid", F.xxhash64("name", "verdict", "pattern", "site"))
    wanted = rules.select("rid", F.explode("tokens").alias("token")).distinct()
    seen = urls.select(F.explode(tokens_of(F.col("link"))).alias("token")).join(small(wanted.select("token").distinct()), "token", "left_semi")
    seen = small(stored(urls.sparkSession, seen.groupBy("token").agg(F.count("*").alias("n")), "seen", 4))
    rarest = wanted.join(seen, "token", "left").groupBy("rid").agg(F.min_by("token", F.struct(F.coalesce("n", F.lit(0)), "token")).alias("token"))
    return rules.join(rarest, "rid", "left").select("name", "verdict", "pattern", "weight", "site", F.coalesce("token", F.lit("")).alias("token"))


ADDED = ("host", "path", "rule", "verdict", "patterns")


def url_filter(pages: DataFrame, rules: list[Rule] | DataFrame | None = None) -> DataFrame:
    """``pages`` with host, path, rule, verdict and patterns (names of the other rules that fit, sorted, comma-joined).

    ``rules``: a list, or a table ``RULES`` of any length; by default those of this module.
    """
    spark = pages.sparkSession
    rules = rules if isinstance(rules, DataFrame) else rule_rows(spark, BASE + PATTERNS if rules is None else rules)
    rows = pages.select(carried(pages, *ADDED), F.col("url").alias("link"))
    link = F.col("link")
    urls = stored(spark, rows.select("link").filter(link.contains("://")).distinct(), "urls")
    table = small(stored(spark, indexed(urls, rules), "rules", 4))
    candidates = urls.select("link", F.explode(tokens_of(link)).alias("token")).join(table, "token")
    subject = F.when(F.col("site"), F.concat(host_of(link), path_of(link))).otherwise(ascii_lower(_after(link)))
    fits = candidates.filter(F.call_function("rlike", subject, F.col("pattern")))
    verdicts = fits.groupBy(link.alias("_link")).agg(
        F.max(F.when(F.col("site"), F.struct("weight", "name", "verdict"))).alias("best"),
        F.array_join(F.array_sort(F.collect_set(F.when(~F.col("site"), F.col("name")))), ",").alias("names"),
    )
    out = rows.join(small(stored(spark, verdicts, "verdicts")), link == F.col("_link"), "left")
    names = F.coalesce("names", F.lit(""))
    return restored(
        out,
        F.coalesce(host_of(link), F.lit("")).alias("host"),
        F.coalesce(path_of(link), F.lit("")).alias("path"),
        F.col("best.name").alias("rule"),
        F.coalesce(F.col("best.verdict"), F.when(names != "", "block").otherwise("allow")).alias("verdict"),
        names.alias("patterns"),
    )


def op6_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return url_filter(pages).select("page_id", "host", "path", "rule", "verdict", "patterns")


def _sql() -> str:
    """The base rules as the contract states them, on host and path; the patterns as expressions."""
    sites = ", ".join(f"('{h}', '{p}', '{v}')" for v, h, p in SITES)
    names = "\n".join(f"    case when regexp_matches(u, '{r.pattern}') then '{r.name}' end," for r in PATTERNS).rstrip(",")
    return f"""
with sites(h, p, v) as (values {sites}),
a as (
  select row_number() over () rid, page_id, case when contains(url, '://') then url[strpos(url, '://') + 3 :] else '' end t from pages),
b as (
  select rid, page_id, translate(regexp_extract(t, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host,
    regexp_extract(t, '^[^/?#]*([^?#]*)', 1) path, translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') u from a),
best as (
  select rid, max({{'w': length(h || p), 'n': h || p, 'v': v}}) best from b join sites on (host = h or ends_with(host, '.' || h)) and starts_with(path, p)
  group by rid),
c as (select *, list_sort(list_filter([
{names}], lambda x: x is not null)) pats from b)
select page_id, coalesce(host, '') host, coalesce(path, '') path, best.n as rule,
  coalesce(best.v, case when len(pats) > 0 then 'block' else 'allow' end) verdict, coalesce(array_to_string(pats, ','), '') patterns
from c left join best using (rid)
"""


OP6_SQL = _sql()
QUERIES = {"op6_urls": op6_urls}
ORACLE = {"op6_urls": OP6_SQL}
