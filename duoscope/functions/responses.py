"""Column functions on what providers answer: waits, limits, messages and vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from duoscope.functions.text import strip, truncate

TOO_MANY, UNAVAILABLE = 429, 503
# A reset above the first is in milliseconds, one below the second is a time from now.
MILLISECONDS, PLAUSIBLE = 1e11, 1e9


def retry_after(value: Column, now: Column) -> Column:
    """Seconds to wait from a Retry-After header: a number of at least 0, or an HTTP date; else null. now: epoch seconds."""
    number = strip(value).try_cast("double")
    date = F.try_to_timestamp(F.regexp_replace(value, "^[A-Za-z]{3}, ", ""), F.lit("dd MMM yyyy HH:mm:ss z"))
    return F.when(number.isNotNull(), F.greatest(F.lit(0.0), number)).when(date.isNotNull(), F.greatest(F.lit(0.0), date.cast("double") - now))


def reset_at(value: Column, now: Column) -> Column:
    """Epoch seconds of a reset header given in seconds, in milliseconds, or as a time from now."""
    number = strip(value).try_cast("double")
    seconds = F.when(number > MILLISECONDS, number / 1000).otherwise(number)
    return F.when(seconds < PLAUSIBLE, now + seconds).otherwise(seconds)


def rate_limit_ceiling(headers: Column) -> Column:
    """The least of the limits among the headers; null if none can be read."""
    limits = F.map_filter(headers, lambda k, v: F.lower(k).startswith("x-ratelimit-limit-"))
    return F.array_min(F.filter(F.transform(F.map_values(limits), lambda v: v.try_cast("double")), lambda x: x.isNotNull()))


def delay(retry: Column, reset: Column, now: Column, attempt: Column, base: float = 1.0) -> Column:
    """Seconds before another attempt: as told, else until the reset, else doubling."""
    return F.coalesce(retry, F.when(reset.isNotNull(), F.greatest(F.lit(0.0), reset - now)), base * F.pow(F.lit(2.0), attempt))


def pool_exhausted(status: Column, wait: Column, longest: float = 60.0) -> Column:
    return (status == TOO_MANY) & F.coalesce(wait > longest, F.lit(False))


def model_unavailable(status: Column, ceiling: Column) -> Column:
    return (status == TOO_MANY) & F.coalesce(ceiling == 0, F.lit(False))


def outcome(source: Column, status: Column, headers: Column, body: Column, now: Column) -> Column:
    """What a response that isn't 200 says: message, status, retry_after, reset_at, rate_limit. headers: a map of names as they came."""
    named = lambda wanted: F.element_at(F.map_values(F.map_filter(headers, lambda k, v: F.lower(k) == wanted)), 1)
    header = lambda wanted: F.when(F.size(F.map_filter(headers, lambda k, v: F.lower(k) == wanted)) > 0, named(wanted))
    return F.struct(
        F.concat(source, F.lit(" HTTP "), status.cast("string"), F.lit(": "), truncate(body)).alias("message"),
        status.cast("int").alias("status"),
        retry_after(header("retry-after"), now).alias("retry_after"),
        reset_at(header("x-ratelimit-reset"), now).alias("reset_at"),
        rate_limit_ceiling(headers).alias("rate_limit"),
    )


def openai_message(body: Column) -> Column:
    """Text of choices[0].message.content, a string or a list of typed blocks, without white space at its ends; null if empty."""
    held = F.try_variant_get(F.try_parse_json(body), "$.choices[0].message.content", "variant")
    blocks = F.from_json(F.get_json_object(body, "$.choices[0].message.content"), "array<struct<type:string,text:string>>")
    joined = F.array_join(F.transform(F.filter(blocks, lambda b: b["type"] == "text"), lambda b: b["text"]), "")
    kind = F.schema_of_variant(held)
    said = F.when(kind == "STRING", F.try_variant_get(held, "$", "string")).when(kind.startswith("ARRAY"), joined)
    return F.nullif(strip(said), F.lit(""))


def google_message(body: Column) -> Column:
    """The joined parts of candidates[0], without white space at its ends; null if empty."""
    parts = F.from_json(F.get_json_object(body, "$.candidates[0].content.parts"), "array<struct<text:string>>")
    return F.nullif(strip(F.array_join(F.transform(parts, lambda p: F.coalesce(p["text"], F.lit(""))), "")), F.lit(""))


def answer(body: Column, kind: str, name: Column) -> Column:
    """text, model, finish_reason and error of an answer; kind: google or openai. error: blocked, empty, or null."""
    if kind == "google":
        text, model, reason = google_message(body), "$.modelVersion", "$.candidates[0].finishReason"
        none = F.get_json_object(body, "$.candidates[0]").isNull()
        blocked = F.when(none, F.concat(F.lit("prompt was blocked: "), F.coalesce(F.get_json_object(body, "$.promptFeedback.blockReason"), F.lit("no candidates"))))
    else:
        text, model, reason = openai_message(body), "$.model", "$.choices[0].finish_reason"
        blocked = F.when(F.get_json_object(body, "$.choices[0].message").isNull(), "the response can't be read")
    ended = F.coalesce(F.get_json_object(body, reason), F.lit("unknown"))
    empty = F.when(text.isNull(), F.concat(F.lit("returned an empty answer ("), ended, F.lit(")")))
    return F.struct(text.alias("text"), F.coalesce(F.nullif(F.get_json_object(body, model), F.lit("")), name).alias("model"), ended.alias("finish_reason"), F.coalesce(blocked, empty).alias("error"))


def usage_summary(body: Column, kind: str) -> Column:
    """Tokens in, out and of thought, as far as they are told."""
    # Where the counts stand.
    paths = {
        "google": ("$.usageMetadata.promptTokenCount", "$.usageMetadata.candidatesTokenCount", "$.usageMetadata.thoughtsTokenCount"),
        "openai": ("$.usage.prompt_tokens", "$.usage.completion_tokens", "$.usage.completion_tokens_details.reasoning_tokens"),
    }[kind]
    counts = [F.coalesce(F.get_json_object(body, p), F.lit("?")) for p in paths]
    last = "thought" if kind == "google" else "reasoning"
    return F.concat(counts[0], F.lit(" in / "), counts[1], F.lit(" out / "), counts[2], F.lit(f" {last} tokens"))


def raw_vectors(body: Column, kind: str) -> Column:
    """Vectors of an embedding response in the order of the texts, by the shape of the provider's body."""
    if kind == "indexed":
        rows = F.from_json(F.get_json_object(body, "$.data"), "array<struct<index:int,embedding:array<double>>>")
        rows = F.when(~F.exists(rows, lambda r: r.isNull() | r["index"].isNull()), rows)
        placed = F.transform(rows, lambda r, at: F.struct(r["index"], at.alias("at"), r["embedding"].alias("v")))
        return F.transform(F.array_sort(placed), lambda r: r["v"])
    if kind == "result":
        ok = F.coalesce(F.get_json_object(body, "$.success"), F.lit("true")) == "true"
        found = F.from_json(F.get_json_object(body, "$.result.data"), "array<array<double>>")
        return F.when(ok & (F.size(found) == F.get_json_object(body, "$.result.shape[0]").cast("int")), found)
    if kind == "float":
        return F.from_json(F.get_json_object(body, "$.embeddings.float"), "array<array<double>>")
    if kind == "values":
        rows = F.from_json(F.get_json_object(body, "$.embeddings"), "array<struct<values:array<double>>>")
        return F.transform(rows, lambda r: r["values"])
    raise ValueError(f"unknown shape {kind!r}")


def prompt_tokens(body: Column, path: str) -> Column:
    return F.coalesce(F.get_json_object(body, path).try_cast("long"), F.lit(0))


def served_model(body: Column, configured: Column) -> Column:
    return F.coalesce(F.nullif(F.get_json_object(body, "$.model"), F.lit("")), configured)
