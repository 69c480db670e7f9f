"""Enrichment through pluggable backends, with offline stubs as defaults."""

from __future__ import annotations

import math
import random
import time
from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T


class Backend(Protocol):
    """One client in each partition; it gets batches of texts and gives one result, or None, for each."""

    name: str

    def run(self, texts: Sequence[str]) -> list[str | None]: ...


class Echo:
    """Offline stub: the text with a tag before it; fails on texts that hold `fail`."""

    def __init__(self, name: str = "echo", tag: str = "", fail: str | None = None):
        self.name, self.tag, self.fail = name, tag, fail

    def run(self, texts: Sequence[str]) -> list[str | None]:
        return [None if self.fail and self.fail in t else f"{self.tag}{t}" for t in texts]


class Limiter:
    """At least 60 / rpm seconds between calls; rpm is the whole job's, shared among its partitions."""

    def __init__(self, rpm: float, partitions: int = 1, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.gap, self.next, self.clock, self.sleep = 60 * partitions / rpm, 0.0, clock, sleep

    def wait(self) -> None:
        now = self.clock()
        if now < self.next:
            self.sleep(self.next - now)
        self.next = max(now, self.next) + self.gap


def attempts(df: DataFrame, id_col: str, text_col: str, backends: Sequence[Callable[[], Backend]], passes: int = 2, rpm: float | None = None, give_up: int = 10) -> DataFrame:
    """request_id, pass, priority, provider, content, ok: tries of each text, backend after backend, until one succeeds.

    A backend that fails `give_up` times in a row is not asked again by its
    partition. Calls are repeated if a task is; results are keyed by id, so a
    rerun changes nothing.
    """
    parts = df.sparkSession.sparkContext.defaultParallelism
    kind = df.schema[id_col].dataType.simpleString()

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        clients = [make() for make in backends]
        fails = [0] * len(clients)
        limit = Limiter(rpm, parts) if rpm else None
        for b in batches:
            rows, left = [], list(zip(b.iloc[:, 0], b.iloc[:, 1].fillna(""), strict=True))
            for n in range(1, passes + 1):
                for k, c in enumerate(clients):
                    if not left or fails[k] >= give_up:
                        continue
                    if limit:
                        limit.wait()
                    done = c.run([t for _, t in left])
                    rows += [(i, n, k, c.name, x, x is not None) for (i, _), x in zip(left, done, strict=True)]
                    fails[k] = 0 if any(x is not None for x in done) else fails[k] + 1
                    left = [r for r, x in zip(left, done, strict=True) if x is None]
            yield pd.DataFrame(rows, columns=["request_id", "pass", "priority", "provider", "content", "ok"])

    return df.select(id_col, text_col).mapInPandas(work, f"request_id {kind}, pass int, priority int, provider string, content string, ok boolean")


class Failed(Exception):
    """A call that failed: its class (cold, 429, 5xx, network, auth, 404, parse, empty or other) and how long the service asks to wait."""

    def __init__(self, kind: str = "other", wait: float | None = None):
        super().__init__(kind)
        self.kind, self.wait = kind, wait


#: Seconds that a provider rests after a failure of each class.
REST = {"cold": 45.0, "429": 15.0, "5xx": 15.0, "network": 15.0, "auth": 3600.0, "404": 3600.0, "parse": 2.0}


def rest(kind: str, fails: int, most: float = 90.0) -> float:
    return min(most, REST.get(kind, 5.0) * math.pow(1.3, fails - 1))


def retried(call: Callable[[str], str], text: str, tries: int = 5, sleep: Callable[[float], None] = time.sleep) -> str:
    """The answer of one of `tries` calls; between them as long as the service asks, else longer and longer. The last failure is raised, and one of authorisation at once."""
    for n in range(1, tries + 1):
        try:
            return call(text)
        except Failed as e:
            if n == tries or e.kind == "auth":
                raise
            sleep(e.wait if e.wait is not None else rest(e.kind, n))
    raise Failed("other")


class Router:
    """Asks providers in order, lets those that fail rest, and ends when one succeeds or all passes are used up.

    A provider has `name` and `call(text)`, which raises Failed. `read` turns an
    answer into a result, or raises Failed: `empty` isn't held against the
    provider. One that fails `give_up` times in a row, or on a class in
    `disable`, isn't asked again.
    """

    def __init__(self, providers: Sequence, passes: int = 3, read: Callable[[str], str] | None = None, give_up: int | None = None, disable: Sequence[str] = (), clock: Callable[[], float] = time.time, sleep: Callable[[float], None] = time.sleep):
        self.providers, self.passes, self.read, self.give_up, self.disable, self.clock, self.sleep = providers, passes, read, give_up, set(disable), clock, sleep
        self.fails, self.until = [0] * len(providers), [0.0] * len(providers)

    def ask(self, text: str) -> list[tuple[int, int, str, str | None, bool, str | None]]:
        """pass, priority, provider, content, ok and error of each call made."""
        made: list[tuple[int, int, str, str | None, bool, str | None]] = []
        for n in range(1, self.passes + 1):
            now, before = self.clock(), len(made)
            for k, p in enumerate(self.providers):
                if self.until[k] > now:
                    continue
                try:
                    content = p.call(text)
                    content = self.read(content) if self.read else content
                    if not (content or "").strip():
                        raise Failed("parse")
                except Failed as e:
                    made.append((n, k, p.name, None, False, e.kind))
                    if e.kind == "empty":
                        self.fails[k], self.until[k] = 0, 0.0
                        continue
                    self.fails[k] += 1
                    gone = e.kind in self.disable or (self.give_up is not None and self.fails[k] >= self.give_up)
                    self.until[k] = math.inf if gone else now + rest(e.kind, self.fails[k])
                    continue
                made.append((n, k, p.name, content, True, None))
                self.fails[k], self.until[k] = 0, 0.0
                return made
            if len(made) == before and n < self.passes:  # all rest: wait for the first to be back
                back = min((u for u in self.until if now < u < math.inf), default=now + 5.0)
                self.sleep(max(0.5, min(20.0, back - now + 0.5)))
        return made


class Stub:
    """Offline provider: a tag before the text, or a failure of class `kind` on texts that hold one of `fails`."""

    def __init__(self, name: str, tag: str = "", fails: Sequence[str] = (), kind: str = "parse"):
        self.name, self.tag, self.fails, self.kind = name, tag, tuple(fails), kind

    def call(self, text: str) -> str:
        if any(f in text for f in self.fails):
            raise Failed(self.kind)
        return self.tag + text


def routed(df: DataFrame, id_col: str, text_col: str, make: Callable[[], Router]) -> DataFrame:
    """request_id, pass, priority, provider, content, ok, error: the calls of one router for each task. Null texts count as empty."""
    kind = df.schema[id_col].dataType.simpleString()

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        router = make()
        for b in batches:
            rows = [(i, *r) for i, t in zip(b.iloc[:, 0], b.iloc[:, 1], strict=True) for r in router.ask("" if t is None else t)]
            yield pd.DataFrame(rows, columns=["request_id", "pass", "priority", "provider", "content", "ok", "error"])

    return df.select(id_col, text_col).mapInPandas(work, f"request_id {kind}, pass int, priority int, provider string, content string, ok boolean, error string")


def by_chunks(df: DataFrame, id_col: str, text_col: str, limit: int, process: Callable[[DataFrame], DataFrame], hard: bool = False, joiner: str = " ") -> DataFrame:
    """id and result: texts taken apart into chunks, processed and put together in order.

    process gets request_id (id and place as a string), text and gives request_id, content; a
    text with a chunk that has no content gets null, one without chunks ''.
    """
    parts = df.select(F.col(id_col).alias("__id"), F.posexplode(T.chunks(text_col, limit, hard)).alias("__at", "text")).withColumn("request_id", F.to_json(F.struct("__id", "__at")))
    done = process(parts.select("request_id", "text"))
    whole = parts.select("__id", "__at", "request_id").join(done.select("request_id", "content"), "request_id", "left")
    put = whole.groupBy("__id").agg(F.sort_array(F.collect_list(F.struct("__at", "content"))).alias("x"), F.count("content").alias("n"))
    joined = F.array_join(F.transform("x", lambda s: s["content"]), joiner)
    out = df.select(F.col(id_col).alias("__id")).join(put, "__id", "left")
    return out.select(F.col("__id").alias(id_col), F.when(F.col("n").isNull(), "").when(F.col("n") == F.size("x"), joined).alias("result"))


def answer_fields(answers: DataFrame, template_cols: Sequence[str], gate: Column, ask: Callable[[DataFrame], DataFrame], checks: dict[str, Column], id_col: str = "pair_key") -> DataFrame:
    """A worker's rows: id, the columns, think and reasons (empty: accepted).

    Rows that fail the gate are rejected without a call. ask gets id and message
    and gives request_id, content; what it can't answer is `llm_failed`. checks
    are named tests of the columns and think that have to hold.
    """
    open_rows = answers.withColumn("__open", F.coalesce(gate, F.lit(False)))
    said = ask(open_rows.where("__open").select(id_col, "message")).select(F.col("request_id").alias(id_col), F.col("content").alias("think"))
    both = open_rows.join(said, id_col, "left")
    failed = F.filter(F.array(*(F.when(~F.coalesce(test, F.lit(False)), F.lit(name)) for name, test in checks.items())).cast("array<string>"), lambda x: x.isNotNull())
    reasons = F.when(~F.col("__open"), F.array(F.lit("no_enrichment_sources_available"))).when(F.col("think").isNull(), F.array(F.lit("llm_failed"))).otherwise(failed)
    return both.select(id_col, *template_cols, F.when(F.size(reasons) == 0, F.col("think")).alias("think"), reasons.alias("reasons"))


def first_success(tries: DataFrame, by: str = "request_id") -> DataFrame:
    """The content of each request's first success in order of pass and priority."""
    order = F.struct("pass", "priority")
    return tries.where("ok").groupBy(by).agg(F.min_by("content", order).alias("content"), F.min_by("provider", order).alias("provider"))


def router_stats(tries: DataFrame, by: Sequence[str] = ("provider",)) -> DataFrame:
    return tries.groupBy(*by).agg(F.count("*").alias("calls"), F.count_if(F.col("ok")).alias("successes"), F.count_if(~F.col("ok")).alias("failures"))


def all_or_nothing(rows: DataFrame, block: Sequence[str], good: Column) -> DataFrame:
    """Rows of the blocks in which every row is good."""
    return rows.withColumn("__all", F.min(good.cast("int")).over(W.partitionBy(*block))).where("__all = 1").drop("__all")


def pseudo_perplexity(losses: Column | str, least: int = 4, most: int = 64) -> Column:
    """exp of the mean loss over the first `most` tokens; null below `least` tokens (losses: one for each masked token)."""
    x = F.slice(losses, 1, most)
    return F.when(F.size(losses) >= least, F.exp(F.aggregate(x, F.lit(0.0), lambda s, v: s + v) / F.size(x)))


def prompt(template: str, cols: Sequence[str], contexts: Sequence[str] = (), key: str | None = None) -> Column:
    """A filled template (%s for each column), with one context chosen by the key's hash."""
    extra = [F.element_at(F.array(*(F.lit(c) for c in contexts)), F.pmod(F.hash(key), F.lit(len(contexts))) + 1)] if contexts else []
    return F.format_string(template, *(F.col(c) for c in cols), *extra)


def until_target(have: Callable[[], DataFrame], generate: Callable[[DataFrame, int], None], targets: DataFrame, by: str, rounds: int = 5) -> DataFrame:
    """Generate for the groups below target, round after round, until none is left or rounds are used up; the last deficit."""
    from .incremental import deficit

    for n in range(rounds):
        gap = deficit(have(), targets, by)
        if gap.isEmpty():
            break
        generate(gap, n)
    return deficit(have(), targets, by)


def jitter(base: float, attempt: int, most: float = 90.0, seed: int | None = None) -> float:
    return min(most, base * math.pow(1.3, attempt - 1)) * (1 + 0.1 * random.Random(seed).random())
