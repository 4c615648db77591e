"""Connectors to the outside: each takes a callable that does the talking, with an offline default.

Distinct inputs only are sent out, in partitions, with retries; results come back as rows to join.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.functions.text import extract_url, first_phone, first_street, model_answer, page_has_name, with_scheme
from pairloom.operators.joins import not_in

Fetch = Callable[[str], tuple[int, str]]


def offline(url: str) -> tuple[int, str]:
    """No network: status 0 and no page."""
    return 0, ""


def with_retries(call: Callable[[str], str], attempts: int = 3, wait: float = 2.0, sleep: Callable[[float], None] = time.sleep) -> Callable[[str], str | None]:
    """The call, tried again after waits that double; None when all attempts fail."""
    def run(value: str) -> str | None:
        pause = wait
        for attempt in range(attempts):
            try:
                return call(value)
            except Exception:
                if attempt + 1 < attempts:
                    sleep(pause)
                    pause *= 2
        return None

    return run


def fetch_pages(df: DataFrame, column: str, fetch: Fetch = offline) -> DataFrame:
    """(value, url, status, page) of each distinct URL; the other scheme is tried where the first fails."""
    urls = df.select(F.col(column).alias("value")).filter(F.coalesce("value", F.lit("")) != "").distinct().withColumn("url", with_scheme(extract_url(F.col("value"))))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for value, url in zip(batch["value"], batch["url"], strict=True):
                other = "http://" + url[8:] if url.startswith("https://") else "https://" + url[7:]
                status, page = fetch(url)
                if not 0 < status < 400:
                    status, page = fetch(other)
                rows.append((value, url, int(status), page))
            yield pd.DataFrame(rows, columns=["value", "url", "status", "page"])

    return urls.mapInPandas(run, "value string, url string, status int, page string")


def verify_websites(df: DataFrame, column: str, fetch: Fetch = offline, name: str | None = None) -> DataFrame:
    """``df`` with site_valid: whether the page answers and, if a name column is given, holds the name."""
    pages = fetch_pages(df, column, fetch).select(F.col("value").alias(column), "status", "page")
    joined = df.join(pages, column, "left")
    ok = (F.col("status") > 0) & (F.col("status") < 400)
    if name:
        ok = ok & page_has_name(F.col("page"), F.col(name))
    return joined.withColumn("site_valid", F.coalesce(ok, F.lit(False))).drop("status", "page")


def search_truth(results: DataFrame, key: str) -> DataFrame:
    """(key, phone, web, address): first hit of each in search results (key, rank, snippet, url), by rank."""
    cells = results.select(key, "rank", first_phone(F.col("snippet")).alias("phone"), F.coalesce("url", F.lit("")).alias("web"), first_street(F.col("snippet")).alias("address"))
    return cells.groupBy(key).agg(*[F.coalesce(F.min_by(F.when(F.col(c) != "", F.col(c)), F.when(F.col(c) != "", F.col("rank"))), F.lit("")).alias(c) for c in ("phone", "web", "address")])


def label_with(df: DataFrame, key: str, prompt: str, labeler: Callable[[str], str], done: DataFrame | None = None, attempts: int = 3) -> DataFrame:
    """Winners, label and reason for rows not labelled yet; a labeler that fails leaves all winners none."""
    todo = not_in(df, done, key) if done is not None else df
    call = with_retries(labeler, attempts)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({key: batch[key], "answer": [call(p) for p in batch[prompt]]})

    kind = dict(df.dtypes)[key]
    answers = todo.select(key, prompt).mapInPandas(run, f"{key} {kind}, answer string")
    told = answers.withColumn("_t", model_answer(F.coalesce("answer", F.lit("{}"))))
    return told.select(key, "_t.*")
