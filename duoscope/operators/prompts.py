"""Context and prompt of each pair, as ordered aggregations over its chunks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duoscope.functions.errors import status_code
from duoscope.functions.text import strip, tokens
from duoscope.operators.selection import select_within

PROMPT_BUDGET = 26_000
# The wording of a context.
INCLUDED, DROPPED = "text included", "text NOT included"
NOTHING_SENT = "(no part of this side was included)"
PRIOR_HEADING = "ALREADY FOUND IN SIDE B"


@dataclass(frozen=True)
class Instructions:
    name: str
    header: str
    closing: str


PREAMBLE = """You compare two sides of one piece of work. Side A describes what should be done, side B is what was done. Each side comes as an outline of all its parts and the text of those that had room."""
RULES = (
    "Say only what the texts show; where a part's text was not included, say that you have not seen it.",
    'Cite a part by its id and its exact words, as in [B-17 "the words"], for each claim about it.',
    "Quote from one line where you can, without changing a character.",
    "A value that differs, one that only one side has, and one that can't be found are three different things.",
)
LABELS = {
    "DIFFERENT": "both sides state it and they disagree",
    "ONLY IN A": "described, and not found in side B",
    "ONLY IN B": "done, and not described in side A",
    "UNSEEN": "the part that would show it was not included",
}


def instructions(name: str, sections: list[str]) -> Instructions:
    """The header has preamble, rules, labels and the sections of the answer; the closing repeats their numbers."""
    numbers = ", ".join(f"§{i}" for i in range(1, len(sections) + 1))
    rules = "\n".join(f"- {x}" for x in RULES)
    labels = "\n".join(f"{k}: {v}" for k, v in LABELS.items())
    listed = "\n".join(f"§{i} {s}" for i, s in enumerate(sections, 1))
    return Instructions(name, f"{PREAMBLE}\n\nRULES\n{rules}\n\nLABELS\n{labels}\n\nOUTPUT\n{listed}", f"Answer with sections {numbers} in this order.")


TEMPLATES = {
    x.name: x
    for x in (
        instructions("full", ["Whether the sides belong together", "Differences", "Settings that only one side has", "What is missing", "Likely causes"]),
        instructions("core", ["Differences", "Likely causes"]),
        instructions("report", ["Whether the sides belong together", "Differences by effect", "Likely causes"]),
        instructions("scan", ["What side B does"]),
        instructions("compare", ["Differences to what was found"]),
    )
}


def build_context(selected: DataFrame) -> DataFrame:
    """pair_id, context of chunks with ids and `included`: per side an outline of all, then the included texts."""
    line = F.concat_ws("  ", "chunk_id", F.when(F.col("included"), INCLUDED).otherwise(DROPPED), "header")
    block = F.when(F.col("included"), F.concat(F.col("chunk_id"), F.lit("  "), F.col("header"), F.lit("\n"), F.col("text")))
    rows = selected.select("pair_id", "side", "pos", line.alias("line"), block.alias("block"))
    sides = rows.groupBy("pair_id", "side").agg(
        F.expr("listagg(line, '\n') within group (order by pos)").alias("outline"),
        F.expr("listagg(block, '\n\n') within group (order by pos)").alias("blocks"),
    )
    text = F.concat(F.lit("SIDE "), F.col("side"), F.lit("\n\nALL PARTS, IN ORDER\n"), F.col("outline"), F.lit("\n\nTEXT\n"), F.coalesce("blocks", F.lit(NOTHING_SENT)))
    return sides.withColumn("part", text).groupBy("pair_id").agg(F.expr("listagg(part, '\n\n\n') within group (order by side)").alias("context"))


def build_prompt(contexts: DataFrame, template: Instructions, question: str = "question", prior: str | None = None) -> DataFrame:
    """With prompt, of the columns context, question and prior; null where the question is blank."""
    asked = strip(F.col(question))
    found = F.when(strip(F.col(prior)) != "", F.concat(F.lit(PRIOR_HEADING + "\n\n"), strip(F.col(prior)))) if prior else F.lit(None).cast("string")
    prompt = F.concat_ws("\n\n\n", F.lit(template.header), "context", found, F.concat(F.lit(template.closing + "\n\nQUESTION: "), asked))
    return contexts.withColumn("prompt", F.when(asked != "", prompt))


def reserve(chunks: DataFrame, questions: DataFrame, template: Instructions) -> DataFrame:
    """pair_id, overhead: tokens of the prompt without any text, and of the prefix of each id."""
    empty = build_prompt(build_context(chunks.withColumn("included", F.lit(False))).join(questions, "pair_id"), template)
    prefixes = chunks.groupBy("pair_id").agg(F.sum(tokens(F.concat(F.col("chunk_id"), F.lit("  ")))).alias("prefixes"))
    return empty.join(prefixes, "pair_id").select("pair_id", (tokens(F.col("prompt")) + F.col("prefixes")).alias("overhead"))


def plan(chunks: DataFrame, questions: DataFrame, template: Instructions = TEMPLATES["report"], budget: int = PROMPT_BUDGET) -> tuple[DataFrame, DataFrame]:
    """Chunks with cost and included, and per pair prompt, overhead, room and status (ok, or the error's code)."""
    overhead = reserve(chunks, questions, template).withColumn("room", F.lit(budget) - F.col("overhead"))
    selected = select_within(chunks.join(overhead, "pair_id"), "room").withColumn("included", F.col("included") & (F.col("room") > 0))
    made = build_prompt(build_context(selected).join(questions, "pair_id"), template).join(overhead, "pair_id")
    sent = selected.groupBy("pair_id").agg(F.count_if("included").alias("n_sent"))
    fits = (F.col("n_sent") > 0) & (tokens(F.col("prompt")) <= budget)
    status = F.when(F.col("prompt").isNull(), "invalid_question").when(fits, "ok").otherwise("artifacts_too_large_to_compare")
    return selected, made.join(sent, "pair_id").withColumn("status", status)


def report(results: DataFrame, counts: DataFrame, cited: DataFrame) -> DataFrame:
    """pair_id, status_code (null where there is an answer) and report, the JSON that a request returns.

    results: pair_id, answer, model, tier, finish_reason, attempts; counts: side_counts(); cited:
    citation_counts(). Pairs of counts that have no result come without an answer.
    """
    sides = counts.groupBy("pair_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("side", F.struct("total", "sent"))))).alias("chunks"))
    whole = sides.join(results, "pair_id", "left").join(cited, "pair_id", "left")
    body = F.struct("answer", "model", "tier", "finish_reason", "attempts", "chunks", F.struct("written", "resolved", "resolved_list").alias("citations"))
    code = F.when(F.col("tier").isNull(), "generation_unavailable")
    return whole.select("pair_id", status_code(code).alias("status_code"), F.to_json(body).alias("report"))
