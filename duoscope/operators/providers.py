"""The providers of answers and of vectors: their limits, requests, credentials, and a client over a transport of the caller's.

Requests are JSON made by column expressions from a template, so a table of prompts becomes a table of
request bodies without Python. Keys are read on the driver or in the task, never from a DataFrame.
"""

from __future__ import annotations

import json
import math
import os
import time
import warnings
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from email.utils import parsedate_to_datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duoscope.functions.responses import MILLISECONDS, PLAUSIBLE
from duoscope.functions.text import tokens

# Addresses, settings and limits, in tokens.
GOOGLE = "https://generativelanguage.googleapis.com/v1beta/models"
MISTRAL = "https://api.mistral.ai/v1"
OPENROUTER = "https://openrouter.ai/api/v1/chat/completions"
GROQ = "https://api.groq.com/openai/v1/chat/completions"
CLOUDFLARE = "https://api.cloudflare.com/client/v4/accounts"
REASON_MISTRAL = {"reasoning_effort": "high", "top_p": 1}
REASON_ROUTER = {"reasoning": {"effort": "high"}}
REASON = {"reasoning_effort": "high"}
MAX_TOKENS, REPORT_MAX_TOKENS, TEMPERATURE, MARGIN, BATCH = 1_024, 32_000, 0.0, 0.10, 96
INPUT_TYPES = {"query": "search_query", "document": "search_document"}
TASK_TYPES = {"query": "RETRIEVAL_QUERY", "document": "RETRIEVAL_DOCUMENT"}


class ProviderError(Exception):
    """What a client raises; `wait` is the seconds that the answer asks for, `reset` when its limit ends."""

    def __init__(self, message: str, status: int | None = None, wait: float | None = None, rate_limit: float | None = None, reset: float | None = None):
        super().__init__(message)
        self.status, self.wait, self.rate_limit, self.reset = status, wait, rate_limit, reset


@dataclass(frozen=True)
class Provider:
    """kind: google or openai, the shape of requests and answers; url: with {account} where an account is part of it."""

    tier: int
    kind: str
    name: str
    model: str
    url: str
    key_env: str
    window: int
    most_out: int
    most_in: int | None = None
    extra: dict = field(default_factory=dict)
    account_env: str | None = None

    @property
    def pool(self) -> str:
        return f"GOOGLE:{self.model}" if self.kind == "google" else self.key_env

    @property
    def endpoint(self) -> str:
        return f"{self.url}/{self.model}:generateContent" if self.kind == "google" else self.url

    def request(self, prompt: str, max_tokens: int = MAX_TOKENS) -> dict:
        if self.kind == "google":
            settings = {"maxOutputTokens": max_tokens, "temperature": TEMPERATURE, "thinkingConfig": {"thinkingLevel": "MEDIUM"}}
            return {"contents": [{"parts": [{"text": prompt}]}], "generationConfig": settings}
        return {"model": self.model, "messages": [{"role": "user", "content": prompt}], "max_tokens": max_tokens, "temperature": TEMPERATURE, **self.extra}


@dataclass(frozen=True)
class Embedder:
    """kind: indexed, result, values or float, the shape of answers (functions.responses.raw_vectors)."""

    kind: str
    name: str
    model: str
    url: str
    key_env: str
    dim: int
    most_in: int | None = None
    account_env: str | None = None

    @property
    def endpoint(self) -> str:
        return {"values": f"{self.url}/{self.model}:batchEmbedContents", "result": f"{self.url}/{{account}}/ai/run/{self.model}"}.get(self.kind, self.url)

    def request(self, texts: list[str], task: str = "document") -> dict:
        if self.kind == "values":  # a text for each request object: several in one give one vector
            return {"requests": [{"model": f"models/{self.model}", "content": {"parts": [{"text": t}]}, "taskType": TASK_TYPES[task]} for t in texts]}
        if self.kind == "result":
            return {"text": texts}
        if self.kind == "float":
            return {"model": self.model, "texts": texts, "input_type": INPUT_TYPES[task], "embedding_types": ["float"]}
        return {"model": self.model, "input": texts}


def _google(tier: int, name: str, model: str, window: int = 1_048_576, most_out: int = 65_536, most_in: int | None = None) -> Provider:
    return Provider(tier, "google", name, model, GOOGLE, "GOOGLE_API_KEY", window, most_out, most_in)


def _mistral(tier: int, name: str, model: str, window: int, most_out: int, extra: dict = REASON_MISTRAL) -> Provider:
    return Provider(tier, "openai", name, model, f"{MISTRAL}/chat/completions", "MISTRAL_API_KEY", window, most_out, None, extra)


def _router(tier: int, name: str, model: str, window: int, most_out: int) -> Provider:
    return Provider(tier, "openai", name, model, OPENROUTER, "OPENROUTER_API_KEY", window, most_out, None, REASON_ROUTER)


# The order of the tiers, their models and limits.
CHAIN = (
    _google(1, "Gemini 3.7 Flash", "gemini-3.7-flash"),
    _google(2, "Gemini 3.6 Flash", "gemini-3.6-flash"),
    _google(3, "Gemini 3.5 Flash", "gemini-3.5-flash"),
    _mistral(4, "GLM-5.2", "glm-5-2", 1_048_576, 1_048_576),
    _router(5, "Nemotron 3 Ultra", "nvidia/nemotron-3-ultra-550b-a55b:free", 1_000_000, 65_536),
    _google(6, "Gemini 3.5 Flash-Lite", "gemini-3.5-flash-lite"),
    _mistral(7, "Mistral Medium", "mistral-medium-latest", 262_144, 262_144),
    _google(8, "Gemma 4 31B", "gemma-4-31b-it", 262_144, 32_768, 16_000),
    _router(9, "North Mini Code", "cohere/north-mini-code:free", 256_000, 64_000),
    _router(10, "Nemotron 3 Super", "nvidia/nemotron-3-super-120b-a12b:free", 262_144, 262_144),
    Provider(11, "openai", "GPT-OSS 120B", "@cf/openai/gpt-oss-120b", f"{CLOUDFLARE}/{{account}}/ai/v1/chat/completions", "CLOUDFLARE_API_KEY", 128_000, 128_000, None, REASON, "CLOUDFLARE_ACCOUNT_ID"),
    Provider(12, "openai", "GPT-OSS 120B (Groq)", "openai/gpt-oss-120b", GROQ, "GROQ_API_KEY", 8_000, 8_000, None, REASON),
    _mistral(13, "Magistral Small", "magistral-small-latest", 262_144, 262_144),
    _mistral(14, "Devstral 2", "devstral-2512", 262_144, 16_384, {}),
    _google(15, "Gemini 3.1 Flash-Lite", "gemini-3.1-flash-lite"),
)

# The embedders, in the order of a change from one to the next.
EMBEDDERS = (
    Embedder("indexed", "Codestral Embed", "codestral-embed", f"{MISTRAL}/embeddings", "MISTRAL_API_KEY", 1536),
    Embedder("result", "BGE Base EN v1.5", "@cf/baai/bge-base-en-v1.5", CLOUDFLARE, "CLOUDFLARE_API_KEY", 768, 512, "CLOUDFLARE_ACCOUNT_ID"),
    Embedder("indexed", "Mistral Embed", "mistral-embed", f"{MISTRAL}/embeddings", "MISTRAL_API_KEY", 1024),
    Embedder("values", "Gemini Embedding 001", "gemini-embedding-001", GOOGLE, "GOOGLE_API_KEY", 3072, 2048),
    Embedder("float", "Cohere Embed v4", "embed-v4.0", "https://api.cohere.com/v2/embed", "COHERE_API_KEY", 1536),
)

MARK = "\u0001"  # where the text goes in a template


def json_string(text: Column) -> Column:
    """The text as a JSON string, with its quotes."""
    whole = F.to_json(F.array(text))
    return F.substring(whole, F.lit(2), F.length(whole) - 2)


def around(request: dict | list, mark: str = json.dumps(MARK)) -> tuple[str, str]:
    before, after = json.dumps(request, ensure_ascii=False, separators=(",", ":")).split(mark)
    return before, after


def chat_payload(provider: Provider, prompt: Column, max_tokens: int = MAX_TOKENS) -> Column:
    """The body of a request for an answer."""
    before, after = around(provider.request(MARK, max_tokens))
    return F.concat(F.lit(before), json_string(prompt), F.lit(after))


def embed_payload(embedder: Embedder, texts: Column, task: str = "document") -> Column:
    """The body of a request for the vectors of an array of texts."""
    if embedder.kind == "values":
        before, after = around(embedder.request([MARK], task)["requests"][0])
        each = F.transform(texts, lambda t: F.concat(F.lit(before), json_string(t), F.lit(after)))
        return F.concat(F.lit('{"requests":['), F.array_join(each, ","), F.lit("]}"))
    before, after = around(embedder.request([MARK], task), json.dumps([MARK]))
    return F.concat(F.lit(before), F.to_json(texts), F.lit(after))


def credential(name: str, env_name: str | None, env: Mapping[str, str]) -> str:
    """The stripped value of a variable; ProviderError before any request where it is missing."""
    value = (env.get(env_name or "") or "").strip()
    if not value:
        raise ProviderError(f"{name}: {env_name} is not set")
    return value


def address(of: Provider | Embedder, env: Mapping[str, str] = os.environ) -> str:
    return of.endpoint.replace("{account}", credential(of.name, of.account_env, env)) if "{account}" in of.endpoint else of.endpoint


def headers(of: Provider | Embedder, env: Mapping[str, str] = os.environ) -> dict[str, str]:
    key = credential(of.name, of.key_env, env)
    own = {"x-goog-api-key": key} if of.url == GOOGLE else {"Authorization": f"Bearer {key}"}
    return {**own, "Content-Type": "application/json"}


def keyed_tiers(tiers: DataFrame, keys: DataFrame) -> DataFrame:
    """The tiers (with key_env) whose variable is among the keys (name) that are set."""
    return tiers.join(keys.select(F.col("name").alias("key_env")).distinct(), "key_env", "left_semi")


def validate_keys(env: Mapping[str, str] = os.environ, chain: tuple[Provider, ...] = CHAIN) -> list[str]:
    """Names of the tiers with a key; RuntimeError if there are none, a warning if some are missing."""
    usable = [p.name for p in chain if env.get(p.key_env)]
    missing = sorted({p.key_env for p in chain if not env.get(p.key_env)})
    if not usable:
        raise RuntimeError(f"no tier can answer: set at least one of {', '.join(missing)}")
    if missing:
        warnings.warn(f"{len(usable)} of {len(chain)} tiers have a key; without: {', '.join(missing)}", stacklevel=2)
    return usable


def misfit(provider: Provider, n_chars: int, max_tokens: int) -> str | None:
    """Why a prompt of that length isn't sent: max_output, max_input, window, or None."""
    padded = math.ceil(math.ceil(n_chars / 3) * (1 + MARGIN))
    if max_tokens > provider.most_out:
        return "max_output"
    if provider.most_in is not None and padded > provider.most_in:
        return "max_input"
    return "window" if padded + max_tokens > provider.window else None


def provider_fit(prompts: DataFrame, max_tokens: int, text: str = "text", chain: tuple[Provider, ...] = CHAIN) -> DataFrame:
    """Each prompt with each provider's tier and reason: null if it fits, else max_output, max_input or window."""
    rows = F.array(*[F.struct(F.lit(p.tier).alias("tier"), F.lit(p.window).alias("window"), F.lit(p.most_out).alias("most_out"), F.lit(p.most_in).cast("int").alias("most_in")) for p in chain])
    padded = F.ceil(tokens(F.col(text)).cast("double") * F.lit(1 + MARGIN))
    reason = F.when(F.lit(max_tokens) > F.col("most_out"), "max_output").when(F.col("padded") > F.col("most_in"), "max_input").when(F.col("padded") + max_tokens > F.col("window"), "window")
    return prompts.withColumn("padded", padded).select("*", F.inline(rows)).withColumn("reason", reason).drop("window", "most_out", "most_in")


#: What sends a request: (address, headers, body) to (status, headers, body).
Transport = Callable[[str, dict[str, str], str], tuple[int, Mapping[str, str], str]]


@dataclass
class Client:
    """A provider over a transport, for operators.completion: checks that the prompt fits and that there is a key, sends, reads the answer."""

    provider: Provider
    send: Transport
    max_tokens: int = MAX_TOKENS
    env: Mapping[str, str] = field(default_factory=lambda: os.environ)

    @property
    def tier(self) -> int:
        return self.provider.tier

    @property
    def pool(self) -> str:
        return self.provider.pool

    @property
    def model(self) -> str:
        return self.provider.model

    def complete(self, prompt: str) -> dict:
        """text, model, finish_reason, and tokens_in and tokens_out where they are told; ProviderError where there is no answer."""
        p = self.provider
        if reason := misfit(p, len(prompt), self.max_tokens):
            raise ProviderError(f"{p.name}: the prompt does not fit ({reason})")
        body = json.dumps(p.request(prompt, self.max_tokens), ensure_ascii=False)
        where, how = address(p, self.env), headers(p, self.env)
        try:
            status, given, text = self.send(where, how, body)
        except Exception as why:  # a transport raises what it likes: timeouts, resets, DNS
            raise ProviderError(f"{p.name}: request failed: {why}") from why
        if status != 200:
            raise ProviderError(f"{p.name} HTTP {status}: {text.strip()[:300]}", status, **told(given))
        return read_answer(p, text)


def told(given: Mapping[str, str], now: Callable[[], float] = time.time) -> dict:
    """wait, reset and rate_limit that headers tell; functions.responses has the same rules as columns."""
    found = {k.lower(): v.strip() for k, v in given.items()}

    def number(x: str | None) -> float | None:
        try:
            return None if x is None else float(x)
        except ValueError:
            return None

    wait, reset, after = number(found.get("retry-after")), number(found.get("x-ratelimit-reset")), found.get("retry-after")
    if wait is None and after is not None:
        try:
            wait = parsedate_to_datetime(after).timestamp() - now()
        except ValueError:
            pass
    if reset is not None:
        reset = reset / 1000 if reset > MILLISECONDS else reset
        reset = now() + reset if reset < PLAUSIBLE else reset
    limits = [x for x in (number(v) for k, v in found.items() if k.startswith("x-ratelimit-limit-")) if x is not None]
    return {"wait": None if wait is None else max(0.0, wait), "reset": reset, "rate_limit": min(limits, default=None)}


def read_answer(p: Provider, text: str) -> dict:
    try:
        body = json.loads(text)
        if p.kind == "google":
            if not (found := body.get("candidates")):
                why = (body.get("promptFeedback") or {}).get("blockReason", "no candidates")
                raise ProviderError(f"{p.name}: prompt was blocked: {why}")
            reason, model = found[0].get("finishReason", "unknown"), body.get("modelVersion")
            said = "".join(x.get("text", "") for x in (found[0].get("content") or {}).get("parts") or [])
        else:
            first = body["choices"][0]
            reason, model, said = first.get("finish_reason", "unknown"), body.get("model"), first["message"]["content"]
            if isinstance(said, list):
                said = "".join(x.get("text", "") for x in said if isinstance(x, dict) and x.get("type") == "text")
    except (ValueError, KeyError, IndexError, TypeError, AttributeError) as e:
        raise ProviderError(f"{p.name}: the response can't be read: {text.strip()[:300]}") from e
    if not isinstance(said, str) or not said.strip():
        raise ProviderError(f"{p.name}: returned an empty answer ({reason})")
    return {"text": said.strip(), "model": model or p.name, "finish_reason": reason, **used(p, body)}


def used(p: Provider, body: dict) -> dict:
    """tokens_in and tokens_out, as far as the answer tells them."""
    block, into, out = ("usageMetadata", "promptTokenCount", "candidatesTokenCount") if p.kind == "google" else ("usage", "prompt_tokens", "completion_tokens")
    told = body.get(block)
    if not isinstance(told, dict):
        return {}
    return {name: told[key] for name, key in (("tokens_in", into), ("tokens_out", out)) if isinstance(told.get(key), int)}
