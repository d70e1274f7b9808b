"""URL filter: rules by host and path, then a list of canonical URLs.

* Rules are few and given as a parameter: (verdict, ``host/path``). A rule fits
  its host and all subdomains when the URL's path starts with the rule's path;
  the longest fitting rule decides.
* URLs no rule decides are looked up in a list of canonical URLs, which may be as
  large as the table. A blocked Bloom filter of the list (64-bit blocks, four
  bits a URL, each block one row) of fixed size is broadcast; URLs it rejects are
  surely not listed and never shuffle, possible hits go to an exact hash join with
  the list, which removes the false positives. The size is a constant, so
  the broadcast is bounded whatever the list; a longer list only sends more rows
  to the exact join.

Canonical form: ASCII-lower-cased host without ``www.``, path without a trailing
``/`` or ``.html``, query without ``utm_*`` parameters; no scheme, no fragment.

Defined results: a null url or one without ``://`` has empty host and path, fits
no rule, is never listed and allowed. Null ids carry through, repeated rows get
equal results, extra columns pass (own names are replaced); empty tables give no
rows; an empty list blocks nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bloom_split

RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"://([^/?#]*)([^?#]*)(\?[^#]*)?"


def _part(url: Column, k: int) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, k), F.lit(""))


def host(url: Column) -> Column:
    return F.translate(_part(url, 1), _UPPER, _LOWER)


def path(url: Column) -> Column:
    return _part(url, 2)


def canonical(url: Column) -> Column:
    """Null when there is no host."""
    name = F.regexp_replace(host(url), r"^www\.", "")
    place = F.regexp_replace(path(url), r"(\.html|/)$", "")
    query = F.regexp_replace(F.regexp_replace(_part(url, 3), r"[?&]utm_[^&]*", ""), r"^&", "?")
    return F.when(name != "", F.concat(name, place, query))


def rule_of(name: Column, place: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule; nulls when none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: len(r[1])):
        h, slash, p = text.partition("/")
        fits = ((name == h) | name.endswith("." + h)) & F.startswith(place, F.lit(slash + p))
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def judge(pages: DataFrame, listed: DataFrame, url_col: str = "url", rules=RULES, listed_col: str = "url") -> DataFrame:
    """``pages`` with host, path, rule, listed and verdict."""
    new = ("host", "path", "rule", "listed", "verdict")
    keep = [F.col(f"`{c}`") for c in pages.columns if c not in new or c == url_col]
    url = F.col(f"`{url_col}`")
    parsed = pages.select(*keep, host(url).alias("host"), path(url).alias("path"), canonical(url).alias("_canonical"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    ruled = parsed.withColumn("rule", rule).withColumn("verdict", verdict)
    entries = listed.select(canonical(F.col(listed_col)).alias("_entry")).where("_entry is not null").distinct()
    asked = ruled.where("verdict is null and _canonical is not null")
    may, clear = bloom_split(asked, "_canonical", entries)
    found = may.join(entries.hint("shuffle_hash"), may["_canonical"] == entries["_entry"], "left").withColumn("listed", F.col("_entry").isNotNull()).drop("_entry")
    rest = ruled.where("verdict is not null or _canonical is null").unionByName(clear).withColumn("listed", F.lit(False))
    out = found.unionByName(rest)
    return out.withColumn("verdict", F.coalesce("verdict", F.when(F.col("listed"), "block").otherwise("allow"))).drop("_canonical")
