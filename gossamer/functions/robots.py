"""robots.txt: rules as a table, permission as a longest match."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parse_robots(text: str | None, agent: str = "*") -> tuple[list[tuple[bool, str]], float | None]:
    """((allow, path) rules, crawl delay) of the group that names the agent, else of "*". A text without groups allows all."""
    groups: dict[str, tuple[list[tuple[bool, str]], list[float]]] = {}
    current: list[str] = []
    in_rules = True
    for line in (text or "").splitlines():
        name, colon, value = line.partition("#")[0].partition(":")
        if not colon:
            continue
        name, value = name.strip().lower(), value.strip()
        if name == "user-agent":
            if in_rules:
                current, in_rules = [], False
            current.append(value.lower())
            groups.setdefault(value.lower(), ([], []))
        elif current:
            in_rules = True
            for a in current:
                if name in ("allow", "disallow") and value:
                    groups[a][0].append((name == "allow", value))
                elif name == "crawl-delay":
                    try:
                        groups[a][1].append(float(value))
                    except ValueError:
                        pass
    named = [a for a in groups if a != "*" and a in agent.lower()]
    rules, delays = groups.get(max(named, key=len) if named else "*", ([], []))
    return rules, delays[0] if delays else None


def rule_pattern(path: str) -> str:
    """Regular expression of a rule's path: * is any run, a final $ the end."""
    anchored = path.endswith("$")
    body = path[:-1] if anchored else path
    return "^" + ".*".join(re.escape(part) for part in body.split("*")) + ("$" if anchored else "")


def robots_rules(files: DataFrame) -> DataFrame:
    """(origin, allow, length, pattern, delay) of robots files (origin, text); an origin without rules has one null rule."""

    def run(batches):
        import pandas as pd

        for batch in batches:
            out = []
            for origin, text in zip(batch["origin"], batch["text"]):
                rules, delay = parse_robots(text)
                out += [(origin, allow, len(path), rule_pattern(path), delay) for allow, path in rules] or [(origin, None, None, None, delay)]
            yield pd.DataFrame(out, columns=["origin", "allow", "length", "pattern", "delay"]).astype({"length": "Int64"})

    return files.select("origin", "text").mapInPandas(run, "origin string, allow boolean, length int, pattern string, delay double")


def can_fetch(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(url, allowed): the longest matching rule of the url's origin decides, allow before disallow; no rule allows.

    ``urls``: url, origin, path, a row a url. The join is on the origin; rules an origin has are few, so a hot origin only
    skews the url side, which AQE splits.
    """
    hits = urls.join(rules.where("pattern IS NOT NULL"), "origin", "left").where(F.col("pattern").isNull() | F.expr("path RLIKE pattern"))
    best = hits.groupBy("url").agg(F.max(F.struct("length", "allow")).alias("top"))
    return urls.select("url").distinct().join(best, "url", "left").select("url", F.coalesce("top.allow", F.lit(True)).alias("allowed"))


def crawl_delay(rules: DataFrame) -> DataFrame:
    """(origin, delay) of the origins that ask for one."""
    return rules.where("delay IS NOT NULL").groupBy("origin").agg(F.max("delay").alias("delay"))


def path_of(url: Column) -> Column:
    """Path and query, "/" if empty."""
    rest = F.regexp_extract(url, r"^[A-Za-z]+://[^/?#]*([^#]*)", 1)
    return F.when(rest == "", "/").when(rest.startswith("?"), F.concat(F.lit("/"), rest)).otherwise(rest)
