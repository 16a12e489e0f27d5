"""Fetching documents over HTTP at a polite rate."""

from __future__ import annotations

import time
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial

import pandas as pd
from pyspark.sql import DataFrame

# Fixed value: the least time between two requests, in seconds.
MIN_INTERVAL = 0.25


def http_get(url: str, user_agent: str) -> str:
    """GET ``url``; any status but success raises."""
    request = urllib.request.Request(url, headers={"User-Agent": user_agent})
    with urllib.request.urlopen(request, timeout=60) as response:
        return response.read().decode("utf-8", errors="replace")


@dataclass(frozen=True)
class JsonPost:
    """POST a JSON body and return the reply; any status but success raises."""

    url: str
    headers: tuple[tuple[str, str], ...]

    def __call__(self, body: str) -> str:
        headers = {"Content-Type": "application/json", **dict(self.headers)}
        request = urllib.request.Request(self.url, body.encode(), headers, method="POST")
        with urllib.request.urlopen(request, timeout=300) as response:
            return response.read().decode()


def model_post(api_key: str) -> JsonPost:
    return JsonPost(
        "https://api.anthropic.com/v1/messages",
        (("x-api-key", api_key), ("anthropic-version", "2023-06-01")),
    )


def embedding_post(api_key: str) -> JsonPost:
    return JsonPost(
        "https://api.voyageai.com/v1/embeddings", (("Authorization", f"Bearer {api_key}"),)
    )


def fetch_documents(
    urls: DataFrame,
    user_agent: str,
    fetch: Callable[[str], str] | None = None,
    min_interval: float = MIN_INTERVAL,
    lanes: int = 1,
) -> DataFrame:
    """``urls`` plus ``body``. ``lanes`` tasks fetch at once and share the rate.

    The remote end sets the limit, so more tasks would only wait longer each.
    """
    if not user_agent.strip():
        raise ValueError("a user agent is required")
    get = fetch or partial(http_get, user_agent=user_agent)
    pause = min_interval * lanes

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ready = time.monotonic()
        for batch in batches:
            bodies = []
            for url in batch["url"]:
                wait = ready - time.monotonic()
                if wait > 0:
                    time.sleep(wait)
                ready = max(ready, time.monotonic()) + pause
                bodies.append(get(url))
            yield batch.assign(body=bodies)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in urls.schema) + ", body string"
    return urls.repartition(lanes).mapInPandas(run, schema)
