"""Pages from the web: robots rules, languages, and fetching with a pause between requests."""

from __future__ import annotations

import time
import urllib.request
from urllib.robotparser import RobotFileParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.functions.links import robots_url

TIMEOUT, DELAY = 5.0, 1.0


@F.pandas_udf(T.BooleanType())
def allowed(url: pd.Series, robots: pd.Series) -> pd.Series:
    """Whether a robots file's text lets any agent fetch the url; no text, or a broken one, doesn't."""
    known: dict[str, RobotFileParser] = {}

    def one(u, body):
        if u is None or body is None:
            return False
        if body not in known:
            known[body] = RobotFileParser()
            known[body].parse(body.splitlines())
        try:
            return known[body].can_fetch("*", u)
        except Exception:
            return False

    return pd.Series([one(u, b) for u, b in zip(url, robots, strict=True)])


def robots_gate(pages: DataFrame, robots: DataFrame, url: str = "url") -> DataFrame:
    """Pages that the robots table (robots_url, body) allows."""
    rows = pages.withColumn("_r", robots_url(F.col(url))).join(robots.select(F.col("robots_url").alias("_r"), F.col("body").alias("_b")), "_r", "left")
    return rows.where(allowed(F.col(url), F.col("_b"))).drop("_r", "_b")


def of_languages(lang: Column, targets: list[str]) -> Column:
    """Whether a detected language is a target; none detected is not."""
    return F.coalesce(lang.isin(targets), F.lit(False))


def _profile(text: str, most: int = 300) -> list[str]:
    counts: dict[str, int] = {}
    padded = f" {' '.join(text.lower().split())} "
    for n in (1, 2, 3):
        for k in range(len(padded) - n + 1):
            counts[padded[k : k + n]] = counts.get(padded[k : k + n], 0) + 1
    return sorted(counts, key=lambda g: (-counts[g], g))[:most]


def language_detector(samples: dict[str, str]):
    """UDF from texts to the sample language of the nearest n-gram profile (Cavnar and Trenkle 1994); null without letters."""
    profiles = {lang: {g: k for k, g in enumerate(_profile(text))} for lang, text in samples.items()}

    @F.pandas_udf(T.StringType())
    def run(c: pd.Series) -> pd.Series:
        def one(text):
            own = _profile(text or "")
            if not any(ch.isalpha() for ch in text or ""):
                return None
            return min(profiles, key=lambda lang: (sum(abs(k - profiles[lang].get(g, 300)) for k, g in enumerate(own)), lang))

        return c.map(one)

    return run


def _get(url: str, timeout: float) -> str:
    with urllib.request.urlopen(url, timeout=timeout) as answer:
        return answer.read().decode(answer.headers.get_content_charset() or "utf-8", "replace")


def fetch(urls: DataFrame, url: str = "url", get=_get, timeout: float = TIMEOUT, delay: float = DELAY) -> DataFrame:
    """(url, html, error) of each url; a host's pages are fetched by one task, ``delay`` seconds apart."""
    host = F.regexp_extract(F.col(url), r"://([^/?#]*)", 1)

    def run(batches):
        for batch in batches:
            for u in batch.column(0).to_pylist():
                try:
                    row = (u, get(u, timeout), None)
                except Exception as e:  # a page that can't be had is a row, not a failure
                    row = (u, None, str(e))
                time.sleep(delay)
                yield pa.RecordBatch.from_arrays([pa.array([x], pa.string()) for x in row], names=["url", "html", "error"])

    return urls.select(F.col(url).alias("url"), host.alias("_h")).repartition("_h").select("url").mapInArrow(run, "url string, html string, error string")
