"""Crawl permission and pacing: robots rules matched against URLs, and a start slot for every request."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from articleflow.functions import ColumnOrName, as_column
from articleflow.functions.urls import percent_decoded, url_origin
from articleflow.operators.numbering import number_rows

_LINE_ENDS = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"
_BLANK = r"[ \t\n\x0b\f\r\x1c-\x1f\x85\xa0]"


def robots_rules(robots: DataFrame, agent: str) -> DataFrame:
    """``origin, rules, crawl_delay`` out of fetched robots files (``origin, status, body``), one row per origin.

    A file that was not answered with 200 has no rules. Lines become rows: neighbouring user-agent lines open a group, an empty line closes it, and rules
    outside of groups count for nothing. The first group that names the agent speaks, or else the first one for all (``*``); its rules keep the order of the file.
    """
    text = F.when(F.col("status") == 200, F.col("body"))
    lines = robots.select("origin", F.posexplode(F.split(text, _LINE_ENDS)).alias("place", "line"))
    said = F.regexp_replace(F.regexp_replace("line", "#.*", ""), f"^{_BLANK}+|{_BLANK}+$", "")
    key = F.lower(F.regexp_replace(F.substring_index(said, ":", 1), f"{_BLANK}+$", ""))
    value = percent_decoded(F.regexp_replace(F.regexp_extract(said, "^[^:]*:(.*)$", 1), f"^{_BLANK}+", ""))
    read = lines.select("origin", "place", F.when(F.col("line") == "", "blank").when(said.contains(":"), key).alias("key"), value.alias("value"))
    is_delay = (F.col("key") == "crawl-delay") & F.col("value").rlike("^[0-9]+$")
    kind = F.when(F.col("key") == "user-agent", "agent").when(F.col("key") == "blank", "blank").when(F.col("key").isin("allow", "disallow") | is_delay, "rule")
    tokens = read.withColumn("kind", kind).where(F.col("kind").isNotNull())

    in_file = Window.partitionBy("origin").orderBy("place")
    opens = (F.col("kind") == "agent") & ~F.coalesce(F.lag("kind").over(in_file) == "agent", F.lit(False))
    inside = F.last(F.when(F.col("kind") != "rule", F.col("kind") == "agent"), ignorenulls=True).over(in_file)
    grouped = tokens.withColumns({"group": F.sum(opens.cast("int")).over(in_file), "inside": inside}).where((F.col("kind") != "blank") & F.col("inside"))

    path, allow = F.col("value"), (F.col("key") == "allow") | (F.col("value") == "")
    rule = F.when(F.col("key").isin("allow", "disallow"), F.struct("place", path.alias("path"), allow.alias("allow")))
    delay = F.max_by(F.col("value").cast("double"), F.when(F.col("key") == "crawl-delay", F.col("place")))
    groups = grouped.groupBy("origin", "group").agg(
        F.collect_list(F.when(F.col("kind") == "agent", F.lower("value"))).alias("agents"), F.array_sort(F.collect_list(rule)).alias("rules"),
        delay.alias("crawl_delay"), F.count_if(F.col("kind") == "rule").alias("n"),
    )
    token = F.lit(agent.split("/")[0].lower())
    for_all = F.array_contains("agents", "*")
    named = ~for_all & F.exists("agents", lambda name: token.contains(name))
    heard = groups.where((F.col("n") > 0) & (for_all | named)).groupBy("origin").agg(
        F.min_by(F.struct("rules", "crawl_delay"), F.struct(for_all, "group")).alias("_g")
    )
    rules = F.transform("_g.rules", lambda r: F.struct(r["path"].alias("path"), r["allow"].alias("allow")))
    return robots.select("origin").join(heard.select("origin", rules.alias("rules"), "_g.crawl_delay"), "origin", "left")


def robots_path(url: ColumnOrName) -> Column:
    """Decoded path, query and fragment of a URL, as rules are compared with it."""
    url = as_column(url)
    decoded = F.coalesce(F.try_url_decode(F.replace(url, F.lit("+"), F.lit("%2B"))), url)
    rest = F.regexp_extract(decoded, r"(?s)^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*(.*)$", 1)
    return F.when(rest == "", "/").otherwise(rest)


def mark_allowed(urls: DataFrame, rules: DataFrame, *, url: str = "url") -> DataFrame:
    """Add ``allowed`` and ``crawl_delay``: the first rule whose path begins the URL's path decides, else allow.

    The rules of an origin travel as one array, so a URL meets them in its own row: an equi join on the
    origin, no pairs of URLs and rules, no grouping afterwards.
    """
    joined = urls.withColumn("origin", url_origin(url)).join(rules, "origin", "left")
    path = robots_path(url)
    hits = F.filter("rules", lambda rule: F.startswith(path, rule["path"]))
    allowed = F.coalesce(F.get(hits, F.lit(0))["allow"], F.lit(True))
    return joined.withColumn("allowed", allowed).drop("rules")


def fetch_slots(requests: DataFrame, *, seq: str, delay: float) -> DataFrame:
    """Add ``slot_seconds``: the n-th request to an origin may start after n - 1 delays.

    The delay is the larger of ours and the origin's own ``crawl_delay``. A hot origin is numbered block by
    block, not in one task.
    """
    numbered = number_rows(requests, seq, "_n", by=["origin"])
    pause = F.greatest(F.lit(float(delay)), F.coalesce(F.col("crawl_delay"), F.lit(0.0)))
    return numbered.withColumn("slot_seconds", (F.col("_n") - 1) * pause).drop("_n")
