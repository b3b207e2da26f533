"""URL filters: seed rules, and a tree of path templates per host that carries their labels over to urls no rule fits.

1. Rules (verdict, "host/path") judge a host and its subdomains where the url's path starts with the rule's; the longest rule wins. Pages judged by
   one are the labelled ones (further labels may be given as a column).
2. The tree grows from the host down, a level of path segments at a time. Digits and hex names in segments are variable (`{n}`, `{h}`); of what is left a
   segment stays a branch of its own if it has `least` pages and a 64th of its parent's, the others share the wildcard `*`. So a node has at most 65
   branches, however many names occur below it.
3. Branches of a node, in order of their share of blocked labels, are merged with the one before if the shares do not differ significantly (two-proportion
   test); branches without a label are merged with each other. A merged branch pools its pages, and so do equal segments below it.
4. A template's purity is its share of blocked labels, smoothed towards its parent's by `weight` labels; a host's parent is the share in the whole corpus. A
   template of `reject` or more is blocked; below DEPTH segments a template ends in `**`.

Only counts by host and path shape travel: pages are added up by (host, shape) within each task first, so a host with a third of all pages costs no more than
its shapes. No Python runs on the way.

Results: a null url, or one without ://, has an empty host and path and is judged by the empty template. Page ids are not read but passed on: null and repeated ids,
ties and equal rows give a row each. An empty table gives none, and without any label all is allowed. Very long urls are read whole (templates stop
at DEPTH). Columns other than page_id and url are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import checkpoint

#: The seed rules: fixed values.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
DEPTH, BRANCHES = 8, 64
#: Two shares differ if they are so many standard errors apart.
APART = 2.58
#: At most so many rows are broadcast.
SMALL = 200_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: str = "url") -> tuple[Column, Column]:
    """Host and path of a url column."""
    rest = F.expr(f"case when instr(`{url}`, '://') > 0 then substr(`{url}`, instr(`{url}`, '://') + 3) else '' end")
    return F.translate(F.regexp_extract(rest, r"\A([^/?#]*)", 1), _UPPER, _LOWER), F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)


def rule_of(rules, host: Column, path: Column) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none does. For a list of rules that a plan can hold."""
    name = verdict = F.lit(None).cast("string")
    for says, rule in sorted(rules, key=lambda r: len(r[1])):
        own, _, start = rule.partition("/")
        fits = ((host == own) | host.endswith(f".{own}")) & path.startswith(f"/{start}")
        name, verdict = F.when(fits, F.lit(rule)).otherwise(name), F.when(fits, F.lit(says)).otherwise(verdict)
    return name, verdict


def shape(path: Column) -> Column:
    """The path with what varies by itself replaced: hex names of eight or more that hold a digit, and runs of digits."""
    hexed = F.regexp_replace(path, r"(?<![0-9A-Za-z])(?=[a-fA-F]*[0-9])[0-9a-fA-F]{8,}(?![0-9A-Za-z])", "{h}")
    return F.regexp_replace(hexed, "[0-9]+", "{n}")


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(SMALL + 1).count() <= SMALL else df


def _share(bad: str, labelled: str, weight: float, above: Column) -> Column:
    return (F.col(bad) + weight * above) / (F.col(labelled) + weight)


def templates(shapes: DataFrame, least: int = 8, weight: float = 4.0) -> DataFrame:
    """host, shape, template, purity for rows of host, shape, pages, labelled, bad (one row for each host and shape)."""
    total = shapes.agg(F.sum("bad").alias("b"), F.sum("labelled").alias("l")).first()
    prior = (total["b"] or 0) / total["l"] if total["l"] else 0.0
    hosts = shapes.groupBy("host").agg(F.sum("bad").alias("b"), F.sum("labelled").alias("l")).select("host", _share("b", "l", weight, F.lit(prior)).alias("purity"))
    # The first segment is what stands before the path's first slash: nothing.
    open_ = checkpoint(shapes.join(hosts, "host").select("*", F.split("shape", "/").alias("segments"), F.lit("").alias("node")).withColumn("ends", F.size("segments") <= 1))
    done = open_.where("ends").select("host", "shape", F.col("node").alias("template"), "purity")
    open_ = open_.where("not ends")
    place = ["host", "node"]
    for level in range(1, DEPTH + 1):
        if not open_.head(1):
            break
        here = open_.withColumn("segment", F.element_at("segments", level + 1))
        counts = here.groupBy(*place, "segment").agg(F.sum("pages").alias("n"))
        whole = here.groupBy(*place).agg(F.sum("pages").alias("of"))
        literal = counts.where(F.col("n") >= least).join(whole, place).where(F.col("n") * BRANCHES >= F.col("of")).select(*place, "segment", F.col("segment").alias("name"))
        here = checkpoint(here.join(_small(checkpoint(literal)), [*place, "segment"], "left").withColumn("name", F.coalesce("name", F.lit("*"))))

        branches = here.groupBy(*place, "name").agg(F.sum("labelled").alias("l"), F.sum("bad").alias("b"), F.max("purity").alias("above"))
        order = Window.partitionBy(*place).orderBy(F.col("l") == 0, F.col("b") / F.greatest(F.col("l"), F.lit(1)), "name")
        l0, b0 = F.lag("l").over(order), F.lag("b").over(order)
        both = (F.col("b") + b0) / F.greatest(F.col("l") + l0, F.lit(1))
        error = F.sqrt(both * (1 - both) * (1 / F.greatest(F.col("l"), F.lit(1)) + 1 / F.greatest(l0, F.lit(1))))
        differs = F.when(F.col("l") == 0, l0 > 0).otherwise(F.abs(F.col("b") / F.greatest(F.col("l"), F.lit(1)) - b0 / F.greatest(l0, F.lit(1))) > APART * error)
        branches = branches.withColumn("new", F.coalesce(differs, F.lit(False)).cast("int")).withColumn("class", F.sum("new").over(order))
        pooled = branches.groupBy(*place, "class").agg(F.sum("l").alias("l"), F.sum("b").alias("b"), F.max("above").alias("above"), F.array_sort(F.collect_list("name")).alias("names"))
        label = F.when(F.size("names") == 1, F.element_at("names", 1)).otherwise(F.concat(F.lit("{"), F.array_join("names", "|"), F.lit("}")))
        pooled = pooled.select(*place, "class", label.alias("label"), _share("b", "l", weight, F.col("above")).alias("own"))
        moved = _small(checkpoint(branches.select(*place, "name", "class").join(pooled, [*place, "class"]).drop("class")))
        last = level == DEPTH
        here = here.join(moved, [*place, "name"]).withColumn("purity", F.col("own")).withColumn("ends", (F.size("segments") <= level + 1) | F.lit(last))
        here = here.withColumn("node", F.concat("node", F.lit("/"), "label", F.when(F.size("segments") > level + 1, F.lit("/**" if last else "")).otherwise(F.lit(""))))
        here = checkpoint(here.select(*open_.columns))
        done = done.unionByName(here.where("ends").select("host", "shape", F.col("node").alias("template"), "purity"))
        open_ = here.where("not ends")
    return done


def judge(pages: DataFrame, rules=RULES, reject: float = 0.8, least: int = 8, weight: float = 4.0) -> DataFrame:
    """page_id, host, path, rule, verdict, template, purity of every page."""
    host, path = split_url()
    rule, says = rule_of(rules, F.col("host"), F.col("path"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path")).withColumns({"rule": rule, "says": says, "shape": shape(F.col("path"))})
    shapes = rows.groupBy("host", "shape").agg(F.count(F.lit(1)).alias("pages"), F.count("says").alias("labelled"), F.count_if(F.col("says") == "block").alias("bad"))
    found = checkpoint(templates(checkpoint(shapes), least, weight))
    verdict = F.coalesce("says", F.when(F.col("purity") >= reject, F.lit("block")).otherwise(F.lit("allow")))
    return rows.join(_small(found), ["host", "shape"], "left").select("page_id", "host", "path", "rule", verdict.alias("verdict"), "template", "purity")
