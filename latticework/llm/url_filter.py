"""URL filter: rules first, then a path-template tree per host.

A rule is a host and the start of a path; it fits the host and its subdomains, and the longest
fitting rule decides.  The urls that rules decide are the labelled ones.  For the others each
host gets a tree of path templates, grown level by level: the values that follow a template
are generalised into a wildcard where they are many and mostly rare, and stay literal
otherwise.  Branches of one parent that cannot be told apart by their share of blocked labels
(a z-test against the parent) are merged, as are those that are significantly above it, and
those below.  A merged branch is rejected if its labelled purity, smoothed towards the host's
and that towards the whole corpus', reaches one half.

The tree is as deep as the deepest path.  All steps are aggregates and joins; a host may hold
any share of the rows.  Defined results: a null url, or one without ``://``, has empty
host and path and is judged with the other such urls; nulls in other columns pass through;
repeated rows are judged alike; no rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, picked, skew_join

# Fixed values of the contract.
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
CUT_LEVELS = 6  # the lineage is cut after so many
MANY, RARE_SHARE = 8, 0.2
Z = 1.96
PRIOR = 2.0
REJECT = 0.5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parsed(pages: DataFrame) -> DataFrame:
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return picked(pages, "page_id", "url").select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1).alias("path"))


def fitting(rules: tuple[tuple[str, str], ...]) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, null where none fits."""
    rule = verdict = F.lit(None).cast("string")
    for text, decision in sorted(rules, key=lambda r: len(r[0])):
        host, _, path = text.partition("/")
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(f"/{path}")
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(decision)).otherwise(verdict)
    return rule, verdict


def grow(rows: DataFrame) -> DataFrame:
    """``rows(host, path)`` with columns parent and template, wildcards for variable segments."""
    parts = F.split(F.trim(F.col("path"), F.lit("/")), "/")
    rows = cut(rows.withColumn("parts", parts).withColumn("parent", F.lit("")).withColumn("template", F.lit("")), "paths")
    depth = rows.agg(F.max(F.size("parts"))).first()[0] or 0
    for level in range(depth):
        if level and level % CUT_LEVELS == 0:
            rows = cut(rows, "levels")
        rows = rows.withColumn("segment", F.get("parts", F.lit(level)))
        values = rows.where("segment is not null").groupBy("host", "template", "segment").agg(F.count("*").alias("n"))
        spread = values.groupBy("host", "template").agg((F.count("*") >= MANY).alias("many"), F.count("*").alias("values"), F.sum("n").alias("n"))
        spread = spread.select("host", "template", (F.col("many") & (F.col("values") > RARE_SHARE * F.col("n"))).alias("variable"))
        rows = skew_join(rows, spread, ["host", "template"], "left")
        step = F.concat_ws("/", "template", F.when(F.col("variable"), F.lit("*")).otherwise(F.col("segment")))
        has = F.col("segment").isNotNull()
        rows = rows.withColumn("parent", F.when(has, F.col("template")).otherwise(F.col("parent"))).withColumn("template", F.when(has, step).otherwise(F.col("template"))).drop("segment", "variable")
    return rows.drop("parts")


def merged(rows: DataFrame) -> DataFrame:
    """Per (host, parent, template) of ``rows``: lean (-1, 0, 1) and smoothed purity of its merged branch."""
    blocked, labelled = F.sum((F.col("verdict") == "block").cast("long")), F.count("verdict")
    branches = cut(rows.groupBy("host", "parent", "template").agg(F.coalesce(blocked, F.lit(0)).alias("b"), labelled.alias("l")), "branches")
    whole = branches.agg(((F.coalesce(F.sum("b"), F.lit(0)) + 1.0) / (F.coalesce(F.sum("l"), F.lit(0)) + 2.0)).alias("all_rate"))
    hosts = branches.groupBy("host").agg(F.sum("b").alias("hb"), F.sum("l").alias("hl")).join(F.broadcast(whole))  # one row
    hosts = hosts.select("host", ((F.col("hb") + PRIOR * F.col("all_rate")) / (F.col("hl") + PRIOR)).alias("host_rate"))
    parents = branches.groupBy("host", "parent").agg(F.sum("b").alias("pb"), F.sum("l").alias("pl"))
    told = skew_join(skew_join(branches, parents, ["host", "parent"]), hosts, ["host"])
    rate = (F.col("pb") + PRIOR * F.col("host_rate")) / (F.col("pl") + PRIOR)
    z = (F.col("b") / F.col("l") - F.col("rate")) / F.sqrt(F.col("rate") * (1 - F.col("rate")) / F.col("l"))
    told = told.withColumn("rate", rate).withColumn("z", F.when((F.col("l") > 0) & (F.col("rate") > 0) & (F.col("rate") < 1), z).otherwise(0.0))
    told = told.withColumn("lean", F.when(F.col("z") >= Z, 1).when(F.col("z") <= -Z, -1).otherwise(0))
    pooled = told.groupBy("host", "parent", "lean").agg(F.sum("b").alias("mb"), F.sum("l").alias("ml"))
    out = skew_join(told.select("host", "parent", "template", "lean", "host_rate"), pooled, ["host", "parent", "lean"])
    return out.select("host", "parent", "template", "lean", ((F.col("mb") + PRIOR * F.col("host_rate")) / (F.col("ml") + PRIOR)).alias("purity"))


def judge(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """One row per row of ``pages(page_id, url)``: page_id, host, path, rule, verdict, template, purity."""
    rule, verdict = fitting(rules)
    rows = cut(grow(parsed(pages).withColumn("rule", rule).withColumn("verdict", verdict)), "templates")
    told = skew_join(rows, merged(rows), ["host", "parent", "template"])
    own = F.when(F.col("purity") >= REJECT, "block").otherwise("allow")
    return told.select("page_id", "host", "path", "rule", F.coalesce("verdict", own).alias("verdict"), "template", "purity")


def oracle(rules: tuple[tuple[str, str], ...] = RULES, depth: int = 8) -> str:
    """The same judgement as DuckDB SQL, for paths of at most ``depth`` segments."""
    cases = {"rule": "", "verdict": ""}
    for text, decision in sorted(rules, key=lambda r: -len(r[0])):
        host, _, path = text.partition("/")
        fits = f"(host = '{host}' or ends_with(host, '.{host}')) and starts_with(path, '/{path}')"
        cases["rule"] += f" when {fits} then '{text}'"
        cases["verdict"] += f" when {fits} then '{decision}'"
    levels = ""
    for k in range(1, depth + 1):
        segment = f"parts[{k}]"
        levels += f"""
        s{k} as (select *, {segment} as segment from t{k - 1}),
        v{k} as (select host, template, count(*) >= {MANY} and count(*) > {RARE_SHARE} * sum(n) as variable
            from (select host, template, segment, count(*) as n from s{k} where segment is not null group by all) group by all),
        t{k} as (select page_id, host, path, parts, rule, verdict,
                case when segment is null then parent else template end as parent,
                case when segment is null then template
                    else template || '/' || case when variable then '*' else segment end end as template
            from s{k} left join v{k} using (host, template)),"""
    return f"""
    with r as (select page_id, case when position('://' in coalesce(url, '')) > 0
                then substr(url, position('://' in url) + 3) else '' end as rest from pages),
        p as (select page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') as host,
            regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from r),
        t0 as (select *, string_split(trim(path, '/'), '/') as parts, '' as parent, '' as template,
            case{cases["rule"]} end as rule, case{cases["verdict"]} end as verdict from p),{levels}
        b as (select host, parent, template, count(*) filter (verdict = 'block') as b, count(verdict) as l from t{depth} group by all),
        g as (select (sum(b) + 1.0::double) / (sum(l) + 2.0::double) as all_rate from b),
        h as (select host, (sum(b) + {PRIOR}::double * any_value(all_rate)) / (sum(l) + {PRIOR}::double) as host_rate from b, g group by host),
        q as (select host, parent, sum(b) as pb, sum(l) as pl from b group by all),
        e as (select *, (pb + {PRIOR}::double * host_rate) / (pl + {PRIOR}::double) as rate from b join q using (host, parent) join h using (host)),
        z as (select *, case when l > 0 and rate > 0 and rate < 1
            then (b / l::double - rate) / sqrt(rate * (1 - rate) / l::double) else 0 end as z from e),
        n as (select *, case when z >= {Z}::double then 1 when z <= -{Z}::double then -1 else 0 end as lean from z),
        m as (select host, parent, lean, sum(b) as mb, sum(l) as ml from n group by all),
        f as (select host, parent, template, (mb + {PRIOR}::double * host_rate) / (ml + {PRIOR}::double) as purity
            from n join m using (host, parent, lean))
    select page_id, host, path, rule, coalesce(verdict, case when purity >= {REJECT}::double then 'block' else 'allow' end) as verdict
    from t{depth} join f using (host, parent, template)"""
