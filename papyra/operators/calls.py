"""Calls of outside services from workers: retries, ranked providers with fallback, health, progress."""

from __future__ import annotations

import functools
import random
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, functions as F


def delays(tries: int = 3, first: float = 1.0, factor: float = 2.0, cap: float = 60.0, jitter: float = 0.1, noise: Callable[[], float] = random.random) -> list[float]:
    """Seconds to wait after each failure but the last: growing by ``factor``, up to ``jitter`` more, ``cap`` at most."""
    return [min(cap, first * factor ** k * (1 + jitter * noise())) for k in range(max(0, tries - 1))]


def retrying(errors: type[BaseException] | tuple[type[BaseException], ...] = Exception, tries: int = 3, first: float = 1.0, factor: float = 2.0, cap: float = 60.0,
             jitter: float = 0.1, sleep: Callable[[float], None] = time.sleep):
    """A decorator: calls again after one of ``errors``; the last failure is raised."""

    def wrap(f):
        @functools.wraps(f)
        def call(*args, **kwargs):
            for wait in [*delays(tries, first, factor, cap, jitter), None]:
                try:
                    return f(*args, **kwargs)
                except errors:
                    if wait is None:
                        raise
                    sleep(wait)

        return call

    return wrap


class Busy(Exception):
    """A provider asks to be left alone for a while."""


@dataclass(frozen=True)
class Provider:
    """A service that answers a prompt with a text, and tokens and cost."""

    name: str
    rank: int
    complete: Callable[[str], tuple[str, int, float]]
    enabled: bool = True


def ordered(providers: list[Provider]) -> list[Provider]:
    """Those that are enabled, the lowest rank first, as given among equals."""
    return sorted((p for p in providers if p.enabled), key=lambda p: p.rank)


def completed(prompt: str, providers: list[Provider], tries: int = 3, busy_seconds: float = 60.0, sleep: Callable[[float], None] = time.sleep) -> tuple[str | None, str | None, int, float, str | None]:
    """``reply, provider, tokens, cost, error`` of the first provider that answers; each is tried so often."""
    error = None
    for p in ordered(providers):
        for k, wait in enumerate([*delays(tries, jitter=0.0), 0.0]):
            try:
                reply, tokens, cost = p.complete(prompt)
                return reply, p.name, tokens, cost, None
            except Busy as e:
                error, wait = f"{p.name}: {e}", busy_seconds
            except Exception as e:  # noqa: BLE001  any failure passes on to the next try or provider
                error = f"{p.name}: {e}"
            if k < tries - 1:
                sleep(wait)
    return None, None, 0, 0.0, error or "no provider is enabled"


def completions(rows: DataFrame, providers: list[Provider], prompt: str = "prompt", tries: int = 3, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """``id, prompt`` to ``id, reply, provider, tokens, cost, error``: a row that no provider answers has an error, the
    others go on. The usage is what ``stats.ledger`` sums up."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in parts:
            got = [completed(t, providers, tries, sleep=sleep) for t in d["prompt"]]
            cols = list(zip(*got)) or [()] * 5
            yield pd.DataFrame({"id": d["id"].to_numpy(), "reply": pd.Series(cols[0], dtype=object), "provider": pd.Series(cols[1], dtype=object), "tokens": pd.Series(cols[2], dtype="int64"), "cost": pd.Series(cols[3], dtype="float64"), "error": pd.Series(cols[4], dtype=object)})

    return rows.select(F.col("id").cast("long").alias("id"), F.col(prompt).alias("prompt")).mapInPandas(run, "id long, reply string, provider string, tokens long, cost double, error string")


def health(providers: list[Provider], prompt: str = "ping") -> dict[str, bool]:
    """Whether each enabled provider answers."""
    def answers(p: Provider) -> bool:
        try:
            p.complete(prompt)
            return True
        except Exception:  # noqa: BLE001  any failure means that it doesn't
            return False

    return {p.name: answers(p) for p in ordered(providers)}


def with_progress(items: list, each: Callable, progress: Callable[[int, int, object], None]) -> list:
    """``each`` of the items, told before as (number from 1, all, item)."""
    out = []
    for k, x in enumerate(items, 1):
        progress(k, len(items), x)
        out.append(each(x))
    return out
