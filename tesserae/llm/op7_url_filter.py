"""URL filters by a temporal list join, in DataFrame operations only.

Dated list entries (add or remove) become validity intervals: an entry is active from an `add` to the next
change of the same entry on the same list. Every capture is expanded to the few keys that an entry could name it
by (its host and parent domains, its path prefixes, its whole address) and joined as of its fetch time.

Parents such as a top-level domain are keys of a large part of all captures, so keys of captures are dealt over
`salts` parts and intervals, which are few, are repeated for each part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SALTS = 32

_HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"
_PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)"


def intervals(entries: DataFrame) -> DataFrame:
    """list, kind, entry, since, until (null: still active) from list, kind, entry, action, at.

    Of several changes at one time the last by name counts (remove after add). Rows with a null in any of the
    five columns say nothing.
    """
    clean = entries.select("list", "kind", "entry", "action", "at").dropna()
    changes = clean.groupBy("list", "kind", "entry", "at").agg(F.max("action").alias("action"))
    order = Window.partitionBy("list", "kind", "entry").orderBy("at")
    return changes.withColumn("until", F.lead("at").over(order)).where("action = 'add'").select("list", "kind", "entry", F.col("at").alias("since"), "until")


def host_of(url) -> F.Column:
    return F.lower(F.regexp_extract(url, _HOST, 1))


def keys_of(url) -> F.Column:
    """All (kind, entry) keys of an address: domain, prefix and url."""
    host = host_of(url)
    labels = F.split(host, r"\.")
    n = F.size(labels)
    domains = F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(F.lit("domain").alias("kind"), F.array_join(F.slice(labels, i, n), ".").alias("entry")))
    parts = F.filter(F.split(F.regexp_extract(url, _PATH, 1), "/"), lambda x: x != "")
    prefixes = F.transform(
        F.when(F.size(parts) > 0, F.sequence(F.lit(1), F.size(parts))).otherwise(F.array().cast("array<int>")),
        lambda i: F.struct(F.lit("prefix").alias("kind"), F.concat(host, F.lit("/"), F.array_join(F.slice(parts, F.lit(1), i), "/")).alias("entry")),
    )
    whole = F.array(F.struct(F.lit("url").alias("kind"), url.alias("entry")))
    return F.when(host != "", F.concat(domains, prefixes, whole)).otherwise(whole)


def filter_urls(captures: DataFrame, entries: DataFrame, salts: int = SALTS) -> DataFrame:
    """page_id, url, fetched_at, host, n_matches, matches, blocked for each row of captures (page_id, url, fetched_at).

    matches are `list:kind:entry` of all entries active at fetched_at (since <= fetched_at < until), sorted and
    joined by commas; blocked says that there is one. A null url or fetch time matches nothing (host: empty for
    null or unusual addresses). Rows of captures that are equal get equal rows.
    """
    own = captures.select("page_id", "url", "fetched_at")
    active = intervals(entries).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    asked = (
        own.where("url is not null and fetched_at is not null").distinct()
        .withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(salts)).cast("int"))
        .withColumn("key", F.explode(keys_of(F.col("url")))).select("page_id", "url", "fetched_at", "salt", "key.kind", "key.entry")
    )
    hit = asked.join(active, ["kind", "entry", "salt"]).where("since <= fetched_at and (until is null or fetched_at < until)")
    found = hit.groupBy("page_id", "url", "fetched_at").agg(F.array_sort(F.collect_set(F.concat_ws(":", "list", "kind", "entry"))).alias("m"))
    # a capture matches few entries: lists times its own keys
    f = found.select(F.col("page_id").alias("p"), F.col("url").alias("u"), F.col("fetched_at").alias("t"), "m")
    joined = own.join(f, own.page_id.eqNullSafe(f.p) & (own.url == f.u) & (own.fetched_at == f.t), "left")
    n = F.when(F.col("m").isNull(), F.lit(0)).otherwise(F.size("m")).cast("long")
    return joined.select("page_id", "url", "fetched_at", F.coalesce(host_of(F.col("url")), F.lit("")).alias("host"), n.alias("n_matches"), F.coalesce(F.array_join("m", ","), F.lit("")).alias("matches"), F.col("m").isNotNull().alias("blocked"))
