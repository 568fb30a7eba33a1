"""Block and allow lists for URLs, looked up by each rule's rarest literal token.

A rule is a regular expression over host and path, with the literal tokens that any URL
it fits must contain.  Of these the one that the fewest URLs of the corpus contain is the
rule's place in the index.  A URL's tokens fetch the rules indexed under them, and only
the fetched rules run their expressions.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from descry.functions.text import once
from descry.llm.common import ascii_lower, hidden

#: Rules are literals of the plan; a longer list is refused.
MOST_RULES = 20_000
#: Parts of the index; a token is compared with those of its part.
PARTS = 256
#: Between literal tokens of a path.
BETWEEN = r"[^0-9A-Za-z]+"


@dataclass(frozen=True)
class UrlRule:
    """``name`` is what a URL is told to have matched; ``pattern`` is searched in host + path.

    ``tokens`` are host labels (``host:net``) and path words (``path:en``) that every URL
    fitted has; without any, the rule is tried on every URL.  Of several rules that fit,
    the one with the greatest ``rank`` wins, then the least name.
    """

    name: str
    verdict: str
    pattern: str
    tokens: tuple[str, ...]
    rank: int


def place_rule(verdict: str, host: str, path: str) -> UrlRule:
    """A host with all its subdomains, and the start of the path; longer rules win."""
    labels = [f"host:{x}" for x in host.split(".") if x]
    # the last word of a path may go on in a URL, unless something else ends it
    words = re.findall(r"[0-9A-Za-z]+(?=[^0-9A-Za-z])", path)
    return UrlRule(
        name=host + path,
        verdict=verdict,
        pattern=rf"^(?:[^/]*\.)?{re.escape(host)}{re.escape(path)}",
        tokens=(*labels, *(f"path:{w}" for w in words)),
        rank=1_000_000 + len(host + path),
    )


def pattern_rule(verdict: str, pattern: str, tokens: Sequence[str]) -> UrlRule:
    """A regular expression, which any place rule overrules."""
    return UrlRule(pattern, verdict, pattern, tuple(tokens), 0)


PLACES = (
    place_rule("block", "net", "/"),
    place_rule("allow", "example.net", "/en/"),
    place_rule("block", "example.com", "/de/"),
    place_rule("allow", "org", "/fr/"),
)
#: What the rules by pattern say of URLs that no place rule fits; else they are allowed.
PATTERNS = (
    pattern_rule("block", r"/login(?:/|$)", ("path:login",)),
    pattern_rule("block", r"/signin(?:/|$)", ("path:signin",)),
    pattern_rule("block", r"/logout(?:/|$)", ("path:logout",)),
    pattern_rule("block", r"^(?:[^/]*\.)?ad\.[^/]*/", ("host:ad",)),
    pattern_rule("block", r"^(?:[^/]*\.)?ads\.[^/]*/", ("host:ads",)),
    pattern_rule("block", r"/wp-admin/", ("path:wp", "path:admin")),
    pattern_rule("block", r"/cgi-bin/", ("path:cgi", "path:bin")),
)


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host, A-Z in lower case, and path; both empty for a null URL and one without ``://``."""
    start = F.instr(url, "://")
    rest = F.when(start > 0, F.substr(url, start + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    # `(?s)` for line ends inside a URL
    host = ascii_lower(F.regexp_extract(rest, r"(?s)\A([^/?#]*)", 1))
    return host, F.regexp_extract(rest, r"(?s)\A[^/?#]*([^?#]*)", 1)


def url_tokens(host: Column, path: Column) -> Column:
    """Different tokens of a URL, among them an empty one."""
    labels = F.transform(F.split(host, r"\.", -1), lambda x: F.concat(F.lit("host:"), x))
    words = F.transform(F.split(path, BETWEEN, -1), lambda x: F.concat(F.lit("path:"), x))
    return F.array_distinct(F.concat(F.array(F.lit("")), labels, words))


def with_url_parts(pages: DataFrame) -> DataFrame:
    """Rows, hidden, beside host and path."""
    host, path = url_parts(F.col("url"))
    return once(hidden(pages, url=F.col("url").cast("string")), host=host, path=path).drop("url")


def index_places(pages: DataFrame, rules: Sequence[UrlRule]) -> dict[UrlRule, str]:
    """The token that each rule stands under: its rarest over all URLs, then the least.

    Only tokens that a rule has are counted, so the driver gets at most one number each.
    """
    wanted = sorted({t for r in rules for t in r.tokens})
    if not wanted:
        return {r: "" for r in rules}
    parts = with_url_parts(pages)
    held = F.array_intersect(
        url_tokens(F.col("host"), F.col("path")), F.array(*[F.lit(t) for t in wanted])
    )
    counts = {
        r["token"]: r["count"]
        for r in parts.select(F.explode(held).alias("token")).groupBy("token").count().collect()
    }
    return {
        r: min(r.tokens, key=lambda t: (counts.get(t, 0), t)) if r.tokens else "" for r in rules
    }


def judged_urls(pages: DataFrame, rules: Sequence[UrlRule] = (*PLACES, *PATTERNS)) -> DataFrame:
    """Rows, hidden, beside host, path, rule and verdict.

    ``rule`` is the place rule that decided, null if none did; the verdict is its own, else
    that of the pattern rule that fits, else ``allow``.  A null URL and one without ``://``
    have an empty host and path and are allowed.  Rows are judged singly, repeated rows
    alike; no column but url is read.
    """
    if len(rules) > MOST_RULES:
        raise ValueError(f"at most {MOST_RULES} rules")
    rows = with_url_parts(pages)
    index: dict[str, list[UrlRule]] = {}
    for rule, token in index_places(pages, rules).items():
        index.setdefault(token, []).append(rule)
    rows = once(rows, _found=_fetched(url_tokens(F.col("host"), F.col("path")), index))
    at = F.concat("host", "path")
    fits = F.filter("_found", lambda r: F.rlike(at, r["pattern"]))
    best = F.array_min(
        F.transform(fits, lambda r: F.struct((-r["rank"]).alias("rank"), r["name"], r["verdict"]))
    )
    rows = once(rows, _best=best)
    return rows.select(
        *[F.col(f"`{c}`") for c in rows.columns if not c.startswith("_") or c.startswith("__")],
        F.when(F.col("_best.rank") < 0, F.col("_best.name")).alias("rule"),
        F.coalesce("_best.verdict", F.lit("allow")).alias("verdict"),
    )


def _fetched(tokens: Column, index: dict[str, list[UrlRule]]) -> Column:
    """The rules that the index has under some tokens; the index is one literal."""
    kind = "struct<name: string, verdict: string, pattern: string, rank: long>"
    parts: list[dict[str, list[dict]]] = [{} for _ in range(PARTS)]
    for token, rules in index.items():
        parts[zlib.crc32(token.encode()) % PARTS][token] = [
            {"name": r.name, "verdict": r.verdict, "pattern": r.pattern, "rank": r.rank}
            for r in rules
        ]
    literal = F.from_json(F.lit(json.dumps(parts)), f"array<map<string, array<{kind}>>>")
    part = lambda t: (F.crc32(t) % PARTS + 1).cast("int")
    found = F.transform(
        tokens, lambda t: F.try_element_at(F.element_at(literal, part(t)), t)
    )
    return F.flatten(F.array_compact(found))
