"""The fallback over providers: as a fold over recorded outcomes, and with live clients inside tasks."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from duoscope.functions.errors import errors_table
from duoscope.functions.responses import TOO_MANY, UNAVAILABLE, model_unavailable
from duoscope.functions.text import let
from duoscope.operators.embedding import embed  # noqa: F401  (the other kind of call)
from duoscope.operators.providers import CHAIN, ProviderError

ATTEMPTS = "array<struct<tier:int,model:string,error:string>>"


def fallback(outcomes: DataFrame) -> DataFrame:
    """request_id, tier, model, answer, attempts of (request_id, tier, pool, model, status, rate_limit, error, answer), final outcomes.

    A pool that answers 429 is dead for later tiers, but not if its limit is 0 (the model isn't
    available); the first answer wins, and tiers after it aren't asked. An outcome without a pool shares
    none. A request has at most one outcome a tier, so a fold over its outcomes is small.
    """
    gone = model_unavailable(F.col("status"), F.col("rate_limit"))
    row = F.struct("tier", "pool", "model", F.coalesce(F.col("status") == TOO_MANY, F.lit(False)).alias("limited"), F.coalesce(gone, F.lit(False)).alias("gone"), "error", "answer")
    tried = outcomes.groupBy("request_id").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    start = F.struct(F.array().cast("array<string>").alias("dead"), F.array().cast(ATTEMPTS).alias("attempts"), F.lit(None).cast("int").alias("tier"), F.lit(None).cast("string").alias("model"), F.lit(None).cast("string").alias("answer"))

    def step(s: Column, x: Column) -> Column:
        dead = F.coalesce(F.array_contains(s["dead"], x["pool"]), F.lit(False))
        note = F.when(dead, F.concat(F.lit("skipped: "), x["pool"], F.lit(" exhausted"))).when(x["gone"], F.concat(F.lit("not available on this account: "), x["error"])).otherwise(x["error"])
        won = ~dead & x["answer"].isNotNull()
        kills = x["pool"].isNotNull() & ~dead & x["limited"] & ~x["gone"] & x["answer"].isNull()
        attempt = F.array(F.struct(x["tier"].cast("int").alias("tier"), x["model"].alias("model"), note.alias("error")))
        after = F.struct(
            F.when(kills, F.concat(s["dead"], F.array(x["pool"]))).otherwise(s["dead"]).alias("dead"),
            F.when(won, s["attempts"]).otherwise(F.concat(s["attempts"], attempt)).alias("attempts"),
            F.when(won, x["tier"].cast("int")).alias("tier"),
            F.when(won, x["model"]).alias("model"),
            F.when(won, x["answer"]).alias("answer"),
        )
        return F.when(s["tier"].isNotNull(), s).otherwise(after)

    return tried.withColumn("end", F.aggregate("rows", start, step)).select("request_id", "end.tier", "end.model", "end.answer", "end.attempts")


@dataclass(frozen=True)
class Waits:
    """When a call is tried again, and for how long a request may go on; seconds."""

    retries: int = 1
    base_delay: float = 1.0
    longest_delay: float = 30.0
    exhausted_after: float = 60.0
    budget: float = 900.0


def fallback_in_time(calls: DataFrame, waits: Waits = Waits()) -> DataFrame:
    """request_id, tier, model, answer, attempts, elapsed of recorded calls, each tier's first (attempt 0) and those after it.

    calls: request_id, tier, pool, model, attempt, status, retry_after, reset_at, rate_limit, error,
    answer, seconds (that the call took; null: none) and started (of the request, as epoch seconds).
    The fold carries a clock: calls and waits move it on. 429 and 503 are tried again, unless retries are
    used up, the model isn't available (429 with a limit of 0), the answer asks for longer than the
    longest delay or past the budget, or, for 429, for longer than exhausted_after. What a tier ends on
    is its attempt; where that is 429, its pool is dead, unless the model isn't available. Once the budget is
    spent, tiers are skipped. Calls that this rule would not have made are ignored; where it would have
    made one that isn't recorded, the tier ends on the last that is. elapsed: where the clock stops. A
    request has few calls, so its fold is small.
    """
    row = F.struct(
        "tier", "attempt", "pool", "model", "status", "retry_after", "reset_at", "rate_limit", "error", "answer",
        F.coalesce("seconds", F.lit(0.0)).cast("double").alias("seconds"), F.col("started").cast("double").alias("started"),
    )
    tried = calls.groupBy("request_id").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    text, none = (lambda: F.lit(None).cast("string")), F.lit(False)
    # open: what a tier ends on, if it isn't tried again; its tier is null where none is open.
    idle = F.struct(F.lit(None).cast("int").alias("tier"), text().alias("model"), text().alias("note"), text().alias("kills"), F.lit(0).alias("tries"))
    start = F.struct(
        F.lit(0.0).alias("clock"), F.array().cast("array<string>").alias("dead"), F.array().cast(ATTEMPTS).alias("attempts"), F.lit(None).cast("int").alias("at"), idle.alias("open"),
        F.lit(None).cast("int").alias("tier"), text().alias("model"), text().alias("answer"),
    )

    def closed(s: Column, when: Column | None = None) -> Column:
        """With the open tier ended, if there is one; when: a further condition."""
        o = s["open"]
        ends = o["tier"].isNotNull() if when is None else o["tier"].isNotNull() & when
        ended = F.concat(s["attempts"], F.array(F.struct(o["tier"].alias("tier"), o["model"].alias("model"), o["note"].alias("error"))))
        return F.struct(
            s["clock"].alias("clock"),
            F.when(ends & o["kills"].isNotNull(), F.concat(s["dead"], F.array(o["kills"]))).otherwise(s["dead"]).alias("dead"),
            F.when(ends, ended).otherwise(s["attempts"]).alias("attempts"),
            s["at"].alias("at"),
            F.when(ends, idle).otherwise(o).alias("open"),
            *[s[c].alias(c) for c in ("tier", "model", "answer")],
        )

    def judged(s: Column, x: Column) -> Column:
        """What a row is to the state, tiers before it ended: `makes` a call, skips its tier (`note`), or neither; and what such a call comes to."""
        first = s["at"].isNull() | (s["at"] != x["tier"])
        dead = F.coalesce(F.array_contains(s["dead"], x["pool"]), none)
        skip = F.when(first & dead, F.concat(F.lit("skipped: "), x["pool"], F.lit(" exhausted"))).when(first & (s["clock"] >= waits.budget), F.lit("skipped: time budget spent"))
        gone = F.coalesce((x["status"] == TOO_MANY) & (x["rate_limit"] == 0), none)
        clock = s["clock"] + x["seconds"]
        return F.struct(
            skip.alias("skip"),
            (skip.isNull() & (first | s["open"]["tier"].isNotNull())).alias("makes"),
            F.when(first, 0).otherwise(s["open"]["tries"]).alias("tries"),
            F.coalesce(x["status"] == TOO_MANY, none).alias("limited"),
            gone.alias("gone"),
            clock.alias("clock"),
            F.coalesce(x["retry_after"].cast("double"), x["reset_at"] - (x["started"] + clock)).alias("told"),
        )

    def moved(s: Column, x: Column, j: Column) -> Column:
        delay = F.coalesce(F.when(j["told"].isNotNull(), F.greatest(F.lit(0.0), j["told"])), waits.base_delay * F.pow(F.lit(2.0), j["tries"]))
        again = F.coalesce(x["status"].isin(TOO_MANY, UNAVAILABLE), none)
        final = ~again | j["gone"] | (j["tries"] >= waits.retries) | (j["limited"] & F.coalesce(j["told"] > waits.exhausted_after, none)) | (delay > waits.longest_delay) | (j["clock"] + delay >= waits.budget)
        won = j["makes"] & x["answer"].isNotNull()
        error = F.coalesce(x["error"], F.lit("?"))
        note = F.when(j["gone"], F.concat(F.lit("not available on this account: "), error)).otherwise(error)
        kills = F.when(j["limited"] & ~j["gone"], x["pool"])
        hold = F.struct(x["tier"].cast("int").alias("tier"), x["model"].alias("model"), note.alias("note"), kills.alias("kills"), (j["tries"] + 1).alias("tries"))
        skipped = F.concat(s["attempts"], F.array(F.struct(x["tier"].cast("int").alias("tier"), x["model"].alias("model"), j["skip"].alias("error"))))
        after = F.struct(
            F.when(j["makes"], j["clock"] + F.when(won | final, 0.0).otherwise(delay)).otherwise(s["clock"]).alias("clock"),
            s["dead"].alias("dead"),
            F.when(j["skip"].isNotNull(), skipped).otherwise(s["attempts"]).alias("attempts"),
            F.when(j["makes"] | j["skip"].isNotNull(), x["tier"].cast("int")).otherwise(s["at"]).alias("at"),
            F.when(won, idle).when(j["makes"], hold).otherwise(s["open"]).alias("open"),
            F.when(won, x["tier"].cast("int")).alias("tier"),
            F.when(won, x["model"]).alias("model"),
            F.when(won, x["answer"]).alias("answer"),
        )
        return let(F.struct(after.alias("s"), (j["makes"] & final).alias("final")), lambda y: closed(y["s"], y["final"]))

    def step(s: Column, x: Column) -> Column:
        other = s["at"].isNull() | (s["at"] != x["tier"])
        on = let(closed(s, other), lambda t: let(judged(t, x), lambda j: moved(t, x, j)))
        return F.when(s["tier"].isNotNull(), s).otherwise(on)

    ended = tried.withColumn("end", F.aggregate("rows", start, step, lambda s: closed(s)))
    return ended.select("request_id", "end.tier", "end.model", "end.answer", "end.attempts", F.col("end.clock").alias("elapsed"))


def failure(attempts: Column) -> Column:
    """The message of a request that no tier answered, with every attempt; null where there was none."""
    each = F.transform(attempts, lambda a: F.concat(F.lit("tier "), a["tier"].cast("string"), F.lit(" "), F.coalesce(a["model"], F.lit("?")), F.lit(": "), F.coalesce(a["error"], F.lit("?"))))
    return F.when(F.size(attempts) > 0, F.concat(F.lit("no tier answered: "), F.array_join(each, "; ")))


def unanswered(results: DataFrame, key: str = "request_id") -> DataFrame:
    """(key, status_code, error_code, error_message) of the results without an answer."""
    return errors_table(results.filter("tier is null").withColumn("error_code", F.lit("generation_unavailable")), key, message=failure(F.col("attempts")))


@dataclass
class Policy:
    """Waits and retries of live calls, as in Waits."""

    retries: int = 1
    base_delay: float = 1.0
    longest_delay: float = 30.0
    exhausted_after: float = 60.0
    budget: float = 900.0
    sleep: Callable[[float], None] = time.sleep
    clock: Callable[[], float] = time.monotonic
    now: Callable[[], float] = time.time

    def call(self, client, prompt: str, deadline: float, spent: dict) -> dict:
        for attempt in range(self.retries + 1):
            spent["calls"] += 1
            try:
                return client.complete(prompt)
            except ProviderError as e:
                until = None if e.reset is None else max(0.0, e.reset - self.now())
                wait = next((x for x in (e.wait, until) if x is not None), self.base_delay * 2**attempt)
                told = e.wait if e.wait is not None else until
                final = e.status not in (TOO_MANY, UNAVAILABLE) or attempt == self.retries or e.rate_limit == 0 and e.status == TOO_MANY
                final = final or e.status == TOO_MANY and told is not None and told > self.exhausted_after
                if final or wait > self.longest_delay or self.clock() + wait >= deadline:
                    raise
                self.sleep(wait)
                spent["waited"] += wait
        raise AssertionError("unreachable")

    def run(self, clients: list, prompt: str, spent: dict | None = None) -> tuple[int | None, dict | None, list[dict]]:
        """The tier that answered, its answer (text, model, finish_reason), and the attempts before it. spent: gets `calls` made and seconds `waited`."""
        deadline, dead, attempts = self.clock() + self.budget, set(), []
        spent = {} if spent is None else spent
        spent |= {"calls": 0, "waited": 0.0}
        for c in clients:
            note = f"skipped: {c.pool} exhausted" if c.pool in dead else "skipped: time budget spent" if self.clock() >= deadline else None
            if note is None:
                try:
                    return c.tier, self.call(c, prompt, deadline, spent), attempts
                except ProviderError as e:
                    gone = e.status == TOO_MANY and e.rate_limit == 0
                    note = f"not available on this account: {e}" if gone else str(e)
                    if e.status == TOO_MANY and not gone:
                        dead.add(c.pool)
            attempts.append({"tier": c.tier, "model": c.model, "error": note})
        return None, None, attempts


def complete(prompts: DataFrame, clients: Callable[[], list], policy: Policy | None = None) -> DataFrame:
    """pair_id, request_id, tier, model, finish_reason, answer, attempts, calls, waited, tokens_in, tokens_out of (pair_id, prompt).

    `clients` makes the providers once in a task (operators.providers.Client over a transport, or others
    with tier, pool, model and complete(prompt)). request_id is a UUID of the task's own making; tokens are
    null where the answer doesn't tell them. Calls aren't repeatable: write the result before using
    it twice, and switch speculation off.
    """
    rule = policy or Policy()
    schema = f"pair_id long, request_id string, tier int, model string, finish_reason string, answer string, attempts {ATTEMPTS}, calls int, waited double, tokens_in long, tokens_out long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = sorted(clients(), key=lambda c: c.tier)
        kind = pa.list_(pa.struct([("tier", pa.int32()), ("model", pa.string()), ("error", pa.string())]))
        kinds = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), kind, pa.int32(), pa.float64(), pa.int64(), pa.int64()]
        for batch in batches:
            rows = []
            for prompt in batch.column(1).to_pylist():
                spent = {"calls": 0, "waited": 0.0}
                if prompt and prompt.strip():
                    tier, said, attempts = rule.run(made, prompt, spent)
                else:
                    tier, said, attempts = None, None, [{"tier": None, "model": None, "error": "prompt must not be empty"}]
                said = said or {}
                rows.append((str(uuid.uuid4()), tier, said.get("model"), said.get("finish_reason"), said.get("text"), attempts, spent["calls"], spent["waited"], said.get("tokens_in"), said.get("tokens_out")))
            columns = zip(*rows, strict=True) if rows else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], list(FIELDS))

    return prompts.select(F.col("pair_id").cast("long"), "prompt").mapInArrow(run, schema)


FIELDS = ("pair_id", "request_id", "tier", "model", "finish_reason", "answer", "attempts", "calls", "waited", "tokens_in", "tokens_out")


def observed(results: DataFrame, tiers: tuple[int, ...] = tuple(p.tier for p in CHAIN), name: str = "completion") -> tuple[DataFrame, Observation]:
    """The results, and what they sum to once an action has run on them: requests, answered, calls, waited, tokens_in, tokens_out and errors_<tier> for each of the tiers.

    Sums are taken where the rows are, by each task that succeeds, so they cost no pass of their own and
    a task that is done again counts once.
    """
    seen = Observation(name)
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    errors = [total(F.size(F.filter("attempts", of_tier(t)))).alias(f"errors_{t}") for t in tiers]
    sums = [total(c).alias(c) for c in ("calls", "waited", "tokens_in", "tokens_out")]
    return results.observe(seen, F.count(F.lit(1)).alias("requests"), F.count("tier").alias("answered"), *sums, *errors), seen


def of_tier(tier: int) -> Callable[[Column], Column]:
    return lambda attempt: attempt["tier"] == tier
