"""Fetching by policy over an injected client: robots rules, retries with back-off, a pause for each domain, answers kept for a time.

The client is made in each task by a factory, so the library opens no connection of
its own and a test can hand in answers.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from urllib.robotparser import RobotFileParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticeworks.sources.feeds import cached

#: (code, body) of a request; raises if there is no answer.
Client = Callable[[str], tuple[int, str]]


@dataclass(frozen=True)
class Policy:
    """How often to try, how long to wait before the second try (doubled for each further one), and how long between two requests to a domain."""

    tries: int = 3
    wait: float = 2.0
    interval: float = 10.0
    agent: str = "*"


def allowed(robots: str | None, agent: str, url: str) -> bool:
    """True if a domain's robots rules let the agent read the address; no rules allow all."""
    if not robots:
        return True
    rules = RobotFileParser()
    rules.parse(robots.splitlines())
    return rules.can_fetch(agent, url)


def fetch_one(url: str, client: Client, policy: Policy, sleep: Callable[[float], None]) -> dict:
    """The answer to one address: a missing answer, an overload or a server's fault is tried again, anything else is final."""
    waited, code, body, status = 0.0, None, None, "network-error"
    for attempt in range(1, policy.tries + 1):
        try:
            code, body = client(url)
            status = "ok" if code < 400 else "http-error"
        except Exception:  # noqa: BLE001 - whatever a client raises is a missing answer
            code, body, status = None, None, "network-error"
        if status == "ok" or code is not None and code != 429 and code < 500 or attempt == policy.tries:
            break
        pause = policy.wait * 2 ** (attempt - 1)
        sleep(pause)
        waited += pause
    return {"status": status, "code": code, "body": body, "attempts": attempt, "waited": waited}


def to_fetch(urls: DataFrame, log: DataFrame, now: Column, hours: int) -> DataFrame:
    """The addresses without a good answer of the last ``hours``."""
    fresh = cached(log, now, hours).where((F.col("status") == "ok") & ~F.col("stale"))
    return urls.join(fresh.select("url"), "url", "left_anti")


def fetched(urls: DataFrame, factory: Callable[[], Client], policy: Policy = Policy(), *, robots: DataFrame | None = None, sleep: Callable[[float], None] = time.sleep, clock: Callable[[], float] = time.monotonic) -> DataFrame:
    """(url, domain, status, code, body, attempts, waited) of (url, domain); ``robots`` is (domain, rules).

    All addresses of a domain are read by one task, one after the other, because only
    there can the pause between them be kept; domains run side by side. Repeated
    addresses are read once, null ones not at all.
    """
    rows = urls.where("url is not null and domain is not null").select("url", "domain").distinct()
    rows = rows.join(robots.select("domain", "rules"), "domain", "left") if robots is not None else rows.withColumn("rules", F.lit(None).cast("string"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client, last = factory(), {}
        for frame in frames:
            out = []
            for domain, url, rules in zip(frame["domain"], frame["url"], frame["rules"], strict=True):
                if not allowed(rules if isinstance(rules, str) else None, policy.agent, url):
                    out.append({"url": url, "domain": domain, "status": "robots-blocked", "code": None, "body": None, "attempts": 0, "waited": 0.0})
                    continue
                if domain in last and (rest := last[domain] + policy.interval - clock()) > 0:
                    sleep(rest)
                out.append({"url": url, "domain": domain, **fetch_one(url, client, policy, sleep)})
                last[domain] = clock()
            yield pd.DataFrame(out, columns=["url", "domain", "status", "code", "body", "attempts", "waited"]).astype({"code": "Int32"})

    return rows.repartition("domain").sortWithinPartitions("domain", "url").mapInPandas(run, "url string, domain string, status string, code int, body string, attempts int, waited double")
