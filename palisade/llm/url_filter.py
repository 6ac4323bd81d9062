"""URL filtering by lists that change over time.

List changes (list, kind, value, at, action add or remove) become validity intervals [since, until).
Each capture yields the keys by which lists can name it (its host, the domains above it, its URL path
prefixes); a join on the key finds the entries, and the as-of condition since <= fetched < until
keeps those in force when the page was fetched. Of all entries in force an allowing list wins, then the
most specific kind (prefix, host, domain), then the list's and the value's name.

Captures without a usable URL or fetch time match nothing and are accepted; so are captures no entry
names. Changes with a null field are ignored; of changes of one entry at one time a removal counts.
An addition while in force and a removal while not change nothing. Repeated captures are judged one
by one. Host names are compared in lower case without port, user or a final dot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

URL = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    authority = F.regexp_replace(F.regexp_extract(url, URL, 1), "^.*@", "")
    return F.regexp_replace(F.lower(F.regexp_replace(authority, ":[0-9]*$", "")), "\\.$", "")


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, URL, 2)


def intervals(changes: DataFrame) -> DataFrame:
    """(list, kind, value, allow, since, until): until is null while an entry is in force."""
    entry = ["list", "kind", "value"]
    known = changes.select(*entry, "at", "action", F.coalesce("allow", F.lit(False)).alias("allow")).dropna(subset=[*entry, "at", "action"])
    known = known.groupBy(*entry, "at").agg(F.max(F.col("action") == "remove").alias("off"), F.max("allow").alias("allow"))
    w = Window.partitionBy(*entry).orderBy("at")
    turned = known.withColumn("before", F.lag("off", 1, True).over(w)).filter(F.col("off") != F.col("before"))
    return turned.withColumn("until", F.lead("at").over(w)).filter(~F.col("off")).select(*entry, "allow", F.col("at").alias("since"), "until")


def keys(url: Column) -> Column:
    """array<struct<kind, value, rank>>: the host, every domain it lies in, and the host with every prefix of its path at a slash."""
    labels = F.split(host_of(url), "\\.")
    n = F.size(labels)
    domains = F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(F.lit("domain").alias("kind"), F.array_join(F.slice(labels, i, n), ".").alias("value"), (10000 - i).alias("rank")))
    parts = F.filter(F.split(path_of(url), "/"), lambda x: x != "")
    prefixes = F.transform(
        F.filter(F.sequence(F.lit(0), F.size(parts)), lambda i: i > 0),
        lambda i: F.struct(F.lit("prefix").alias("kind"), F.concat(host_of(url), F.lit("/"), F.array_join(F.slice(parts, 1, i), "/")).alias("value"), (30000 + i).alias("rank")),
    )
    host = F.array(F.struct(F.lit("host").alias("kind"), host_of(url).alias("value"), F.lit(20000).alias("rank")))
    return F.when(host_of(url) != "", F.concat(domains, host, prefixes))


def judge(captures: DataFrame, changes: DataFrame, id_col: str = "page_id", url_col: str = "url", time_col: str = "fetched_at") -> DataFrame:
    """(id, n_entries, accepted, list, kind, value): one row per capture; the last three name the entry that decided, or are null."""
    entries = intervals(changes)
    asked = captures.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(time_col).alias("at"))
    named = asked.select("row", "id", "at", F.explode_outer(keys(F.col("url"))).alias("k")).select("row", "id", "at", "k.kind", "k.value", "k.rank")
    in_force = (F.col("since") <= F.col("at")) & (F.col("until").isNull() | (F.col("at") < F.col("until")))
    hit = named.join(entries.select("list", "kind", "value", "allow", "since", "until"), ["kind", "value"], "left").withColumn("on", F.coalesce(in_force, F.lit(False)))
    # the least of these is the entry that decides; few rows a capture, combined before the shuffle
    best = F.when(F.col("on"), F.struct((~F.col("allow")).alias("block"), (-F.col("rank")).alias("order"), "list", "kind", "value"))
    out = hit.groupBy("row").agg(F.first("id").alias("id"), F.count_if("on").alias("n_entries"), F.min(best).alias("best"))
    return out.select(F.col("id").alias(id_col), "n_entries", F.coalesce(~F.col("best.block"), F.lit(True)).alias("accepted"), "best.list", "best.kind", "best.value")


def list_history(captures: DataFrame, url_col: str = "url") -> DataFrame:
    """List changes derived from the captures' own hosts, for tables that come without lists.

    Of the hosts, by a hash: some are blocked from a date on, some for a time, some twice, and some
    allowed again; of the domains above them, some are blocked.
    """
    hosts = captures.select(host_of(F.col(url_col)).alias("host")).filter("host <> ''").distinct()
    code = F.conv(F.substring(F.md5("host"), 1, 6), 16, 10).cast("long")
    hosts = hosts.withColumn("code", code)
    day = lambda n: F.timestamp_add("DAY", n.cast("int"), F.lit("2024-01-01").cast("timestamp_ntz"))
    first = F.col("code") % 120

    def change(name: str, kind: str, value: Column, at: Column, action: str, allow: bool = False) -> Column:
        return F.struct(F.lit(name).alias("list"), F.lit(kind).alias("kind"), value.alias("value"), day(at).alias("at"), F.lit(action).alias("action"), F.lit(allow).alias("allow"))

    block = F.col("code") % 3 == 0
    parent = F.substring_index("host", ".", -3)
    rows = F.array_compact(F.array(
        F.when(block, change("spam", "host", F.col("host"), first, "add")),
        F.when(block & (F.col("code") % 2 == 0), change("spam", "host", F.col("host"), first + 90, "remove")),
        F.when(block & (F.col("code") % 4 == 0), change("spam", "host", F.col("host"), first + 200, "add")),
        F.when(F.col("code") % 7 == 0, change("adult", "domain", parent, first + 60, "add")),
        F.when(F.col("code") % 14 == 0, change("adult", "domain", parent, first + 150, "remove")),
        F.when(F.col("code") % 5 == 0, change("trusted", "host", F.col("host"), first + 30, "add", True)),
        F.when(F.col("code") % 10 == 0, change("trusted", "host", F.col("host"), first + 160, "remove", True)),
        F.when(F.col("code") % 11 == 0, change("language", "prefix", F.concat("host", F.lit("/en")), first, "add")),
    ))
    return hosts.select(F.explode(rows).alias("c")).select("c.*").distinct()


def fetched_at(id_col: Column) -> Column:
    """A fetch time within 2024 that depends on the id alone, for captures that have none."""
    return F.timestamp_add("HOUR", (F.conv(F.substring(F.md5(id_col.cast("string")), 1, 6), 16, 10).cast("long") % 8760).cast("int"), F.lit("2024-01-01").cast("timestamp_ntz"))
