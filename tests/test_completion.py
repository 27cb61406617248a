"""The fallback with a clock against live runs of the policy on scripts of answers and errors."""

import random

from duoscope.operators.completion import Policy, Waits, complete, fallback_in_time, observed
from duoscope.operators.providers import CHAIN, Client, ProviderError

CALLS = "request_id long, tier int, pool string, model string, attempt int, status int, retry_after double, reset_at double, rate_limit double, error string, answer string, seconds double, started double"
START = 1_700_000_000.0


class Scripted:
    """A provider that follows its recorded calls, on a clock that they move."""

    def __init__(self, tier, pool, calls, now):
        self.tier, self.pool, self.model, self.calls, self.now = tier, pool, f"m{tier}", iter(calls), now

    def complete(self, prompt):
        c = next(self.calls)
        self.now[0] += c["seconds"] or 0.0
        if c["answer"] is not None:
            return {"text": c["answer"], "model": self.model, "finish_reason": "stop"}
        raise ProviderError(c["error"], c["status"], c["retry_after"], c["rate_limit"], c["reset_at"])


def script(rnd, request, retries):
    tiers = []
    for tier in range(1, rnd.randint(2, 7)):
        calls = []
        for attempt in range(retries + 1):
            status = rnd.choice([200, 429, 429, 503, 500, None])
            calls.append(
                {
                    "request_id": request, "tier": tier, "pool": None, "model": f"m{tier}", "attempt": attempt, "status": status,
                    "retry_after": rnd.choice([None, None, 0.0, 5.0, 30.0, 31.0, 60.0, 61.0]), "reset_at": rnd.choice([None, None, START - 5, START + 20, START + 100]),
                    "rate_limit": rnd.choice([None, None, None, 0.0, 10.0]), "error": f"error {tier}.{attempt}", "answer": f"yes {tier}" if status == 200 and rnd.random() < 0.4 else None,
                    "seconds": rnd.choice([None, 0.0, 1.5, 20.0]), "started": START,
                }
            )
        tiers.append((rnd.choice("PQR"), calls))
        for c in calls:
            c["pool"] = tiers[-1][0]
    return tiers


def test_recorded_calls_end_as_live_ones(spark):
    rnd = random.Random(7)
    for waits in (Waits(), Waits(retries=2, budget=40.0), Waits(retries=0), Waits(base_delay=25.0, longest_delay=26.0, budget=60.0)):
        rows, wanted = [], {}
        for request in range(150):
            tiers = script(rnd, request, waits.retries)
            rows += [tuple(c.values()) for _, calls in tiers for c in calls]
            now = [0.0]
            policy = Policy(**vars(waits), sleep=lambda s, now=now: now.__setitem__(0, now[0] + s), clock=lambda now=now: now[0], now=lambda now=now: START + now[0])
            tier, said, attempts = policy.run([Scripted(i, pool, calls, now) for i, (pool, calls) in enumerate(tiers, 1)], "why")
            wanted[request] = (tier, said and said["text"], [(a["tier"], a["model"], a["error"]) for a in attempts], round(now[0], 6))
        rnd.shuffle(rows)
        got = {r.request_id: (r.tier, r.answer, [tuple(a) for a in r.attempts], round(r.elapsed, 6)) for r in fallback_in_time(spark.createDataFrame(rows, CALLS), waits).collect()}
        assert got == wanted
    assert any("time budget" in a[2] for w in wanted.values() for a in w[2])


def call(request, tier, pool, attempt, status=None, retry=None, answer=None):
    return (request, tier, pool, f"m{tier}", attempt, status, retry, None, None, f"e{tier}.{attempt}", answer, None, None)


def test_calls_that_are_missing_or_too_many(spark):
    rows = [
        call(1, 1, "P", 0, 429, 2.0), call(1, 2, "P", 0, 200, answer="never asked"),  # the second call isn't recorded: 429 is final
        call(2, 1, "P", 0, 500), call(2, 1, "P", 1, 200, answer="never asked"), call(2, 2, "P", 0, 200, answer="asked"),
        call(3, 1, "P", 0, 503, 2.0),
        call(4, 1, None, 0, 429), call(4, 1, None, 1, 429), call(4, 2, None, 0, 200, answer="no pool is shared"),
        call(5, 1, "P", 0, 200, answer="first"), call(5, 2, "P", 0, 500),
    ]
    got = {r.request_id: (r.tier, r.answer, [a.error for a in r.attempts]) for r in fallback_in_time(spark.createDataFrame(rows, CALLS)).collect()}
    assert got == {
        1: (None, None, ["e1.0", "skipped: P exhausted"]), 2: (2, "asked", ["e1.0"]), 3: (None, None, ["e1.0"]),
        4: (2, "no pool is shared", ["e1.1"]), 5: (1, "first", []),
    }
    assert fallback_in_time(spark.createDataFrame([], CALLS)).collect() == []


def test_totals_of_live_calls(spark):
    class One:
        tier, pool, model = 3, "P", "m"

        def complete(self, prompt):
            if prompt.startswith("fail"):
                raise ProviderError("down", 503, wait=0.0)
            if prompt.startswith("timeout"):
                raise ProviderError("One: request failed: timed out")
            return {"text": prompt, "model": "m", "finish_reason": "stop", "tokens_in": 5, "tokens_out": None}

    df = spark.createDataFrame([(i, p) for i, p in enumerate(["a", "fail", "b", "timeout", " ", None])], "pair_id long, prompt string")
    results, seen = observed(complete(df, lambda: [One()], Policy(sleep=lambda s: None)), tiers=(1, 3))
    rows = {r.pair_id: r for r in results.collect()}
    assert seen.get == {"requests": 6, "answered": 2, "calls": 5, "waited": 0.0, "tokens_in": 10, "tokens_out": 0, "errors_1": 0, "errors_3": 2}
    assert rows[1].calls == 2 and rows[1].tier is None and rows[4].calls == 0
    assert len({r.request_id for r in rows.values()}) == 6


def test_a_transport_that_raises_is_an_attempt():
    def send(url, headers, body):
        if "generativelanguage" in url:
            raise TimeoutError("read timed out")
        return 200, {}, '{"choices":[{"message":{"content":"hi"}}],"usage":{"prompt_tokens":3,"completion_tokens":4}}'

    env = {"GOOGLE_API_KEY": "g", "MISTRAL_API_KEY": "m"}
    clients = [Client(CHAIN[0], send, env=env), Client(CHAIN[3], send, env=env)]
    tier, said, attempts = Policy().run(clients, "why")
    assert tier == 4 and said["text"] == "hi" and (said["tokens_in"], said["tokens_out"]) == (3, 4)
    assert [a["error"] for a in attempts] == [f"{CHAIN[0].name}: request failed: read timed out"]
