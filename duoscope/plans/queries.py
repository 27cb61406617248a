"""The operators over the given tables, each with SQL of the same result where SQL can express it.

Conversations serve as pairs: turns of the user and the system are side A, those of the assistant side
B, in the order of the turns. Documents serve as artifacts named by id and language.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duoscope.functions import responses as R
from duoscope.functions import tables
from duoscope.functions import text as T
from duoscope.functions.errors import errors_table
from duoscope.functions.pieces import SEPARATORS
from duoscope.operators import chunking, citations, completion, embedding, prompts, providers, ranking, selection, vectors

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
BUDGET = 400


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def artifacts(spark: SparkSession, sf_dir: str, suffix: str = ".txt") -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("pair_id"), F.when(F.col("lang") == "en", "A").otherwise("B").alias("side"), F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit(suffix)).alias("name"), "text")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    side = F.when(F.col("role") == "assistant", "B").otherwise("A")
    last = F.size(F.split("text", "\n", -1))
    return c.select(F.col("conv_id").alias("pair_id"), side.alias("side"), F.col("turn").alias("pos"), F.col("role").alias("source"), "text", F.lit(1).alias("start_line"), T.chunk_header(F.col("role"), F.lit(""), F.lit(1), last).alias("header"))


TURNS = """t AS (SELECT conv_id AS pair_id, CASE WHEN role = 'assistant' THEN 'B' ELSE 'A' END AS side, turn AS pos, role AS source, text,
    '[' || role || ' · lines 1-' || len(string_split(text, chr(10))) || ']' AS header FROM conversations),
 c AS (SELECT *, side || '-' || (row_number() OVER (PARTITION BY pair_id, side ORDER BY pos) - 1) AS chunk_id,
    ceil(length(header || chr(10) || text) / 3.0)::BIGINT AS cost FROM t),
 s AS (SELECT *, sum(cost) OVER (PARTITION BY pair_id, side ORDER BY pos ROWS UNBOUNDED PRECEDING) <= 200 AS included FROM c)"""


@query("SELECT doc_id, ceil(length(text) / 3.0)::BIGINT AS tokens FROM documents")
def token_estimate(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.tokens(F.col("text")).alias("tokens"))


@query("SELECT doc_id, ceil(length('[' || source || ' · lines 1-2]' || chr(10) || text) / 3.0)::BIGINT AS tokens FROM documents")
def embed_text_cost(spark, sf_dir):
    header = T.chunk_header(F.col("source"), F.lit(""), F.lit(1), F.lit(2))
    return table(spark, sf_dir, "documents").select("doc_id", T.tokens(T.embed_text(header, F.col("text"))).alias("tokens"))


@query("SELECT doc_id, CASE WHEN length(trim(text)) <= 300 THEN trim(text) ELSE left(trim(text), 300) || '…' END AS short FROM documents")
def truncate(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.truncate(F.col("text")).alias("short"))


@query("""SELECT doc_id, n - 1 AS n, line FROM (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS n, len(l) AS size
    FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)) WHERE NOT (n = size AND line = '')""")
def split_lines(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.split_lines(F.col("text"))).alias("n", "line"))


def headed(spark, sf_dir) -> DataFrame:
    """Documents as Markdown: a heading, a fence with a false heading for every third, and a second heading."""
    d = artifacts(spark, sf_dir, ".md")
    fence = F.when(F.col("pair_id") % 3 == 0, "```\n# no heading\n```\n").otherwise("")
    return d.withColumn("text", F.concat(F.lit("# Part "), F.col("pair_id").cast("string"), F.lit("\n\n"), fence, F.col("text"), F.lit("\n\n## Rest\nlast")))


HEADED = """m AS (SELECT doc_id AS pair_id, '# Part ' || doc_id || chr(10) || chr(10) || CASE WHEN doc_id % 3 = 0 THEN '```' || chr(10) || '# no heading' || chr(10) || '```' || chr(10) ELSE '' END
    || text || chr(10) || chr(10) || '## Rest' || chr(10) || 'last' AS text FROM documents),
 l AS (SELECT pair_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM m),
 f AS (SELECT *, regexp_matches(line, '^\\s*(```|~~~)') AS fence FROM l),
 o AS (SELECT *, sum(fence::INT) OVER w % 2 = 1 AS open FROM f WINDOW w AS (PARTITION BY pair_id ORDER BY line_no)),
 h AS (SELECT *, NOT fence AND NOT open AND regexp_matches(line, '^#{1,6}\\s+\\S') AS is_heading FROM o),
 x AS (SELECT *, sum(is_heading::INT) OVER (PARTITION BY pair_id ORDER BY line_no) AS section FROM h)"""


@query(f"WITH {HEADED} SELECT pair_id, line_no, line FROM x WHERE is_heading")
def markdown_headers(spark, sf_dir):
    return chunking.markdown_lines(headed(spark, sf_dir)).filter("is_heading").select("pair_id", "line_no", "line")


@query(f"""WITH {HEADED}, b AS (SELECT *, min(line_no) FILTER (WHERE trim(line) <> '') OVER w AS start_line, max(line_no) FILTER (WHERE trim(line) <> '') OVER w AS end_line FROM x WINDOW w AS (PARTITION BY pair_id, section))
    SELECT pair_id, start_line, end_line, string_agg(line, chr(10) ORDER BY line_no) AS text,
    coalesce(max(CASE WHEN is_heading THEN trim(regexp_extract(line, '^#{{1,6}}\\s+(\\S.*)$', 1)) END), '') AS label
    FROM b WHERE line_no BETWEEN start_line AND end_line GROUP BY pair_id, section, start_line, end_line""")
def markdown_sections(spark, sf_dir):
    return chunking.markdown_pieces(headed(spark, sf_dir)).select("pair_id", "start_line", "end_line", "text", "label")


def part_sources(spark, sf_dir) -> DataFrame:
    """Python of each part: a class and a decorated function, both long enough to stay apart."""
    filler = "# " + "x" * 100
    p = table(spark, sf_dir, "part")
    key, size = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    source = F.concat(F.lit("class P"), key, F.lit(f":\n    {filler}\n    def name(self):\n        return {filler!r}\n\n\n\n@wraps\ndef size_"), size, F.lit(f"():\n    return {filler!r}\n"))
    return p.select(F.col("p_partkey").alias("pair_id"), F.lit("B").alias("side"), F.lit("part.py").alias("name"), source.alias("text"))


@query("""SELECT p_partkey AS pair_id, unnest(['class P' || p_partkey, 'def size_' || p_size]) AS label, unnest([1, 8]) AS start_line, unnest([4, 10]) AS end_line FROM part""")
def python_definitions(spark, sf_dir):
    return chunking.chunks(part_sources(spark, sf_dir)).select("pair_id", "label", "start_line", "end_line")


@query(f"WITH {TURNS} SELECT pair_id, side, pos, chunk_id FROM c")
def assign_ids(spark, sf_dir):
    return selection.assign_ids(turns(spark, sf_dir)).select("pair_id", "side", "pos", "chunk_id")


@query(f"WITH {TURNS} SELECT pair_id, chunk_id, cost, included FROM s")
def budget_select(spark, sf_dir):
    return selection.select_within(selection.assign_ids(turns(spark, sf_dir)), BUDGET).select("pair_id", "chunk_id", "cost", "included")


@query(f"""WITH {TURNS}, p AS (SELECT DISTINCT pair_id FROM t), w AS (SELECT pair_id, unnest(['A', 'B']) AS side FROM p)
    SELECT w.pair_id, w.side, count(s.pos) AS total, count(*) FILTER (WHERE included) AS sent FROM w LEFT JOIN s ON w.pair_id = s.pair_id AND w.side = s.side GROUP BY w.pair_id, w.side""")
def side_counts(spark, sf_dir):
    return selection.side_counts(selection.select_within(turns(spark, sf_dir), BUDGET))


@query(f"WITH {TURNS}, p AS (SELECT DISTINCT pair_id FROM t), w AS (SELECT pair_id, unnest(['A', 'B']) AS side FROM p) SELECT pair_id, side, 'empty_artifact' AS error_code FROM w WHERE NOT EXISTS (FROM t WHERE t.pair_id = w.pair_id AND t.side = w.side)")
def empty_sides(spark, sf_dir):
    t = turns(spark, sf_dir)
    return selection.empty_sides(t, t)


@query(f"WITH {TURNS} SELECT pair_id, 'A-' || pos AS chunk_id FROM t WHERE NOT EXISTS (FROM c WHERE c.pair_id = t.pair_id AND c.chunk_id = 'A-' || t.pos)")
def unknown_selected(spark, sf_dir):
    t = turns(spark, sf_dir)
    wanted = t.select("pair_id", F.concat(F.lit("A-"), F.col("pos").cast("string")).alias("chunk_id"))
    return selection.unknown_selected(wanted, selection.assign_ids(t))


CONTEXT = f"""{TURNS}, e AS (SELECT pair_id, side, 'SIDE ' || side || chr(10) || chr(10) || 'ALL PARTS, IN ORDER' || chr(10)
    || string_agg(chunk_id || '  ' || CASE WHEN included THEN 'text included' ELSE 'text NOT included' END || '  ' || header, chr(10) ORDER BY pos) || chr(10) || chr(10) || 'TEXT' || chr(10)
    || coalesce(string_agg(chunk_id || '  ' || header || chr(10) || text, chr(10) || chr(10) ORDER BY pos) FILTER (WHERE included), '(no part of this side was included)') AS part FROM s GROUP BY pair_id, side),
 k AS (SELECT pair_id, string_agg(part, chr(10) || chr(10) || chr(10) ORDER BY side) AS context FROM e GROUP BY pair_id)"""


@query(f"WITH {CONTEXT} SELECT pair_id, context FROM k")
def build_context(spark, sf_dir):
    return prompts.build_context(selection.select_within(selection.assign_ids(turns(spark, sf_dir)), BUDGET))


def quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


REPORT = prompts.TEMPLATES["report"]
PROMPT = f"{quoted(REPORT.header)} || repeat(chr(10), 3) || context || repeat(chr(10), 3) || {quoted(REPORT.closing)} || chr(10) || chr(10) || 'QUESTION: why ' || pair_id"


def questions(df: DataFrame) -> DataFrame:
    return df.select("pair_id").distinct().withColumn("question", F.concat(F.lit(" why "), F.col("pair_id").cast("string"), F.lit("\n")))


@query(f"""WITH {CONTEXT.replace("<= 200", "< 0")}, q AS (SELECT pair_id, sum(ceil((length(chunk_id) + 2) / 3.0)) AS prefixes FROM c GROUP BY pair_id)
    SELECT pair_id, (ceil(length({PROMPT}) / 3.0) + prefixes)::BIGINT AS overhead FROM k JOIN q USING (pair_id)""")
def reserve_overhead(spark, sf_dir):
    t = selection.assign_ids(turns(spark, sf_dir))
    return prompts.reserve(t, questions(t), REPORT)


@query(f"WITH {CONTEXT} SELECT pair_id, {PROMPT} AS prompt FROM k")
def build_prompt(spark, sf_dir):
    s = selection.select_within(selection.assign_ids(turns(spark, sf_dir)), BUDGET)
    return prompts.build_prompt(prompts.build_context(s).join(questions(s), "pair_id"), REPORT).select("pair_id", "prompt")


# The plan: overhead and room of each pair, its budget from the room, and the tokens of the prompt that comes out.
PLAN = f"""{TURNS}, q AS (SELECT pair_id, sum(ceil((length(chunk_id) + 2) / 3.0)) AS prefixes FROM c GROUP BY pair_id),
 z AS (SELECT *, FALSE AS chosen FROM c),
 x AS (SELECT pair_id, side, 'SIDE ' || side || chr(10) || chr(10) || 'ALL PARTS, IN ORDER' || chr(10) || string_agg(chunk_id || '  text NOT included  ' || header, chr(10) ORDER BY pos)
    || chr(10) || chr(10) || 'TEXT' || chr(10) || '(no part of this side was included)' AS part FROM z GROUP BY pair_id, side),
 y AS (SELECT pair_id, string_agg(part, chr(10) || chr(10) || chr(10) ORDER BY side) AS context FROM x GROUP BY pair_id),
 r AS (SELECT pair_id, (ceil(length({PROMPT}) / 3.0) + prefixes)::BIGINT AS overhead FROM y JOIN q USING (pair_id)),
 i AS (SELECT c.*, overhead, 1200 - overhead AS room, 1200 - overhead > 0 AND sum(cost) OVER (PARTITION BY pair_id, side ORDER BY pos ROWS UNBOUNDED PRECEDING) <= floor((1200 - overhead) / 2.0) AS included FROM c JOIN r USING (pair_id)),
 e AS (SELECT pair_id, side, 'SIDE ' || side || chr(10) || chr(10) || 'ALL PARTS, IN ORDER' || chr(10)
    || string_agg(chunk_id || '  ' || CASE WHEN included THEN 'text included' ELSE 'text NOT included' END || '  ' || header, chr(10) ORDER BY pos) || chr(10) || chr(10) || 'TEXT' || chr(10)
    || coalesce(string_agg(chunk_id || '  ' || header || chr(10) || text, chr(10) || chr(10) ORDER BY pos) FILTER (WHERE included), '(no part of this side was included)') AS part FROM i GROUP BY pair_id, side),
 k AS (SELECT pair_id, string_agg(part, chr(10) || chr(10) || chr(10) ORDER BY side) AS context FROM e GROUP BY pair_id),
 n AS (SELECT pair_id, count(*) FILTER (WHERE included) AS n_sent, min(overhead) AS overhead, min(room) AS room FROM i GROUP BY pair_id)"""


@query(f"""WITH {PLAN} SELECT pair_id, overhead, room, n_sent, CASE WHEN n_sent > 0 AND ceil(length({PROMPT}) / 3.0) <= 1200 THEN 'ok' ELSE 'artifacts_too_large_to_compare' END AS status
    FROM k JOIN n USING (pair_id)""")
def prompt_plan(spark, sf_dir):
    t = selection.assign_ids(turns(spark, sf_dir))
    return prompts.plan(t, questions(t), budget=1_200)[1].select("pair_id", "overhead", "room", "n_sent", "status")


def answers(spark, sf_dir) -> DataFrame:
    """An answer of each supplier that cites two parts, one quote with marks that look like an end."""
    s = table(spark, sf_dir, "supplier")
    text = F.concat(F.lit('Both differ [B-'), F.col("s_suppkey").cast("string"), F.lit(' "'), F.col("s_name"), F.lit('", A-'), F.col("s_nationkey").cast("string"), F.lit(' "x = (1 + 2)"] and B-7 alone; [A-1 "a "word" in"].'))
    return s.select(F.col("s_suppkey").alias("pair_id"), text.alias("answer"))


@query("""SELECT s_suppkey AS pair_id, unnest([0, 1, 2]) AS n, unnest(['B-' || s_suppkey, 'A-' || s_nationkey, 'A-1']) AS chunk_id, unnest([s_name, 'x = (1 + 2)', 'a "word" in']) AS quote FROM supplier""")
def find_citations(spark, sf_dir):
    return citations.find_citations(answers(spark, sf_dir))


def quotes(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """A quote of the middle of each turn's first line, of each turn, and its chunks."""
    t = selection.assign_ids(turns(spark, sf_dir))
    first = F.get(F.split("text", "\n"), F.lit(0))
    return t.select("pair_id", F.col("pos").alias("n"), "chunk_id", F.substring(first, 4, 30).alias("quote")), t


@query(f"""WITH {TURNS}, l AS (SELECT pair_id, pos, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM t),
    q AS (SELECT pair_id, pos, chunk_id, source, substring(string_split(text, chr(10))[1], 4, 30) AS quote FROM c),
    m AS (SELECT q.*, line_no, line, trim(line) = trim(quote) AS exact FROM q JOIN l USING (pair_id, pos) WHERE trim(quote) <> '' AND contains(line, trim(quote))),
    b AS (SELECT *, bool_or(exact) OVER (PARTITION BY pair_id, pos) AS any_exact FROM m),
    r AS (SELECT pair_id, pos, min(line_no) AS line, arg_min(line, line_no) AS text, count(*) = 1 AS "unique" FROM b WHERE exact OR NOT any_exact GROUP BY pair_id, pos)
    SELECT pair_id, pos AS n, chunk_id, quote, CASE WHEN line IS NOT NULL THEN source END AS source, line, r.text, "unique" FROM q LEFT JOIN r USING (pair_id, pos)""")
def resolve_contained(spark, sf_dir):
    return citations.resolve(*quotes(spark, sf_dir))


@query("""WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)
    SELECT doc_id AS pair_id, 1 AS line, l[1] AS text, true AS "unique" FROM d WHERE len(l) > 1 AND length(trim(l[1])) > 20 AND length(trim(l[2])) > 30""")
def resolve_wrapped(spark, sf_dir):
    """The end of each document's first line with the start of the second, as one quote."""
    d = table(spark, sf_dir, "documents").withColumn("l", F.split("text", "\n"))
    d = d.filter((F.size("l") > 1) & (F.length(F.trim(F.get("l", F.lit(0)))) > 20)).filter(F.length(F.trim(F.get("l", F.lit(1)))) > 30)
    quote = F.concat(F.substring(F.get("l", F.lit(0)), -20, 20), F.lit("\n  "), F.substring(F.get("l", F.lit(1)), 1, 25))
    pair = d.select(F.col("doc_id").alias("pair_id"), F.lit("B-0").alias("chunk_id"), F.lit(0).alias("n"), quote.alias("quote"), "source", F.lit(1).alias("start_line"), "text")
    return citations.resolve(pair.select("pair_id", "n", "chunk_id", "quote"), pair).select("pair_id", "line", "text", "unique")


@query("""SELECT p_partkey, regexp_replace('a\\_' || p_name || '\\* \\\\ b\\c', '\\\\([^\\w\\s]|_)', '\\1', 'g') AS plain FROM part""".replace("\\\\ b", "\\| b"))
def unescape_quotes(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", T.unescape(F.concat(F.lit("a\\_"), "p_name", F.lit("\\* \\| b\\c"))).alias("plain"))


@query("""SELECT vec_id, round(list_sum(list_transform(u, lambda x: x * x)), 9) AS squared, round(u[1], 9) AS first FROM
    (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE)))) AS u FROM embeddings)""")
def unit_normalize(spark, sf_dir):
    u = table(spark, sf_dir, "embeddings").select("vec_id", vectors.unit(F.col("embedding")).alias("u"))
    return u.select("vec_id", F.round(F.aggregate("u", F.lit(0.0), lambda a, x: a + x * x), 9).alias("squared"), F.round(F.get("u", F.lit(0)), 9).alias("first"))


@query("SELECT vec_id, CASE WHEN embedding IS NULL THEN 'missing' WHEN len(embedding) <> CASE WHEN vec_id % 5 = 0 THEN 63 ELSE 64 END THEN 'width' END AS error FROM embeddings")
def vector_validate(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    parts = [vectors.validated(e.filter(f"vec_id % 5 {op} 0"), dim) for op, dim in (("=", 63), ("<>", 64))]
    return parts[0].unionByName(parts[1]).select("vec_id", "error")


@query("SELECT event_id, least(value, CASE WHEN event_id % 3 = 0 THEN event_id::DOUBLE END) AS ceiling FROM events")
def rate_limit_ceiling(spark, sf_dir):
    headers = F.create_map(F.lit("X-RateLimit-Limit-Requests"), F.col("value").cast("string"), F.lit("x-ratelimit-limit-tokens"), F.when(F.col("event_id") % 3 == 0, F.col("event_id").cast("string")).otherwise("n/a"), F.lit("x-ratelimit-remaining"), F.lit("0"))
    return table(spark, sf_dir, "events").select("event_id", R.rate_limit_ceiling(headers).alias("ceiling"))


NOW = 1_700_000_000.0
RESET = f"CASE WHEN event_id % 3 = 0 THEN {NOW!r}::DOUBLE + event_id % 90 WHEN event_id % 3 = 1 THEN ({NOW!r}::DOUBLE + event_id % 90) ELSE {NOW!r}::DOUBLE + event_id % 90 END"


def waits(spark, sf_dir) -> DataFrame:
    soon = F.col("event_id") % 90
    given = F.when(F.col("event_id") % 3 == 0, soon).when(F.col("event_id") % 3 == 1, (soon + int(NOW)) * 1000).otherwise(soon + int(NOW))
    e = table(spark, sf_dir, "events").withColumn("reset", R.reset_at(given.cast("string"), F.lit(NOW)))
    told = F.when(F.col("event_id") % 4 == 0, F.lit("7.5")).when(F.col("event_id") % 4 == 1, F.lit("Tue, 14 Nov 2023 22:13:50 GMT")).when(F.col("event_id") % 4 == 2, F.lit("-3"))
    return e.withColumn("told", R.retry_after(told, F.lit(NOW)))


@query(f"SELECT event_id, {RESET} AS reset FROM events")
def reset_epoch(spark, sf_dir):
    return waits(spark, sf_dir).select("event_id", "reset")


@query("""SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 7.5::DOUBLE WHEN event_id % 4 = 1 THEN 30.0::DOUBLE WHEN event_id % 4 = 2 THEN 0.0::DOUBLE WHEN event_id % 5 = 0 THEN (2.0::DOUBLE) ** (event_id % 3) ELSE (event_id % 90)::DOUBLE END AS delay FROM events""")
def retry_delay(spark, sf_dir):
    reset = F.when((F.col("event_id") % 5 != 0), F.col("reset"))
    return waits(spark, sf_dir).select("event_id", R.delay(F.col("told"), reset, F.lit(NOW), F.col("event_id") % 3).alias("delay"))


TIERS = ", ".join(f"({p.tier}, {p.window}, {p.most_out}, {p.most_in or 'NULL'})" for p in providers.CHAIN)


@query(f"""WITH p(tier, win, most_out, most_in) AS (VALUES {TIERS}), d AS (SELECT doc_id, ceil(ceil(length(text) / 3.0)::DOUBLE * 1.1::DOUBLE)::BIGINT AS padded FROM documents)
    SELECT doc_id, tier, padded, CASE WHEN 4000 > most_out THEN 'max_output' WHEN padded > most_in THEN 'max_input' WHEN padded + 4000 > win THEN 'window' END AS reason FROM d, p""")
def provider_fit(spark, sf_dir):
    return providers.provider_fit(table(spark, sf_dir, "documents"), 4000).select("doc_id", "tier", "padded", "reason")


def outcomes(spark, sf_dir) -> DataFrame:
    """Five tiers a request made of events, their kinds as pools."""
    e = table(spark, sf_dir, "events")
    code = (F.col("event_id") * 13 + F.floor(F.col("event_id") / 5)) % 7
    status = F.when(code == 0, 200).when(code <= 4, 429).otherwise(503)
    return e.select(F.floor(F.col("event_id") / 5).alias("request_id"), (F.col("event_id") % 5 + 1).cast("int").alias("tier"), F.col("event_type").alias("pool"), F.concat(F.lit("model "), (F.col("event_id") % 5 + 1).cast("string")).alias("model"), status.alias("status"), F.when(code == 4, 0.0).alias("rate_limit"), F.concat(F.lit("status "), status.cast("string")).alias("error"), F.when(code == 0, F.concat(F.lit("answer "), F.col("event_id").cast("string"))).alias("answer"))


@query("""WITH o AS (SELECT event_id // 5 AS request_id, event_id % 5 + 1 AS tier, event_type AS pool, (event_id * 13 + event_id // 5) % 7 AS code, event_id FROM events),
    d AS (SELECT *, coalesce(bool_or(code BETWEEN 1 AND 3) OVER (PARTITION BY request_id, pool ORDER BY tier ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS dead FROM o),
    w AS (SELECT *, min(CASE WHEN code = 0 AND NOT dead THEN tier END) OVER (PARTITION BY request_id) AS won FROM d)
    SELECT request_id, min(won)::INT AS tier, max(CASE WHEN tier = won THEN 'answer ' || event_id END) AS answer,
    coalesce(string_agg(tier || ' ' || CASE WHEN dead THEN 'skipped: ' || pool || ' exhausted' WHEN code = 4 THEN 'not available on this account: status 429' WHEN code BETWEEN 1 AND 3 THEN 'status 429' WHEN code = 0 THEN 'status 200' ELSE 'status 503' END, '; ' ORDER BY tier) FILTER (WHERE won IS NULL OR tier < won), '') AS attempts
    FROM w GROUP BY request_id""")
def fallback_chain(spark, sf_dir):
    found = completion.fallback(outcomes(spark, sf_dir))
    return found.select("request_id", "tier", "answer", F.array_join(F.transform("attempts", lambda a: F.concat_ws(" ", a["tier"].cast("string"), a["error"])), "; ").alias("attempts"))


# A request for each pair, answered as the request of the same number among the outcomes.
REPLY = """o AS (SELECT event_id // 5 AS request_id, event_id % 5 + 1 AS tier, event_type AS pool, (event_id * 13 + event_id // 5) % 7 AS code, event_id FROM events),
    d AS (SELECT *, coalesce(bool_or(code BETWEEN 1 AND 3) OVER (PARTITION BY request_id, pool ORDER BY tier ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS dead FROM o),
    w AS (SELECT *, min(CASE WHEN code = 0 AND NOT dead THEN tier END) OVER (PARTITION BY request_id) AS won FROM d),
    a AS (SELECT request_id AS pair_id, min(won)::INT AS tier, max(CASE WHEN tier = won THEN 'answer ' || event_id END) AS answer, count(*) FILTER (WHERE won IS NULL OR tier < won) AS n_attempts FROM w GROUP BY request_id)"""


@query(f"""WITH {TURNS}, {REPLY}, l AS (SELECT pair_id, pos, unnest(string_split(text, chr(10))) AS line FROM t),
    q AS (SELECT pair_id, pos, substring(string_split(text, chr(10))[1], 4, 30) AS quote FROM c),
    f AS (SELECT q.pair_id, q.pos, trim(quote) <> '' AND bool_or(contains(line, trim(quote))) AS found FROM q JOIN l USING (pair_id, pos) GROUP BY q.pair_id, q.pos, quote),
    g AS (SELECT pair_id, count(*) AS written, count(*) FILTER (WHERE found) AS resolved FROM f GROUP BY pair_id),
    h AS (SELECT pair_id, count(*) FILTER (WHERE side = 'A') AS a_total, count(*) FILTER (WHERE side = 'A' AND included) AS a_sent, count(*) FILTER (WHERE side = 'B') AS b_total, count(*) FILTER (WHERE side = 'B' AND included) AS b_sent FROM s GROUP BY pair_id)
    SELECT h.*, answer, CASE WHEN tier IS NOT NULL THEN 'model ' || tier END AS model, tier, CASE WHEN tier IS NOT NULL THEN 'stop' END AS finish_reason, coalesce(n_attempts, 0) AS n_attempts, written, resolved,
    CASE WHEN tier IS NULL THEN 503 END AS status_code FROM h LEFT JOIN a USING (pair_id) LEFT JOIN g USING (pair_id)""")
def compare_report(spark, sf_dir):
    """What a request returns for each pair, read back from its JSON: the answer and how it was had, counts by side, and the citations of an answer that quotes its turns."""
    found, t = quotes(spark, sf_dir)
    body = prompts.report(
        completion.fallback(outcomes(spark, sf_dir)).withColumn("finish_reason", F.when(F.col("tier").isNotNull(), "stop")).withColumnRenamed("request_id", "pair_id"),
        selection.side_counts(selection.select_within(t, BUDGET)),
        citations.citation_counts(citations.resolve(found, t)),
    )
    get = lambda path: F.get_json_object("report", f"$.{path}")
    count = lambda path: F.coalesce(get(path), F.lit("0")).cast("long")
    return body.select(
        "pair_id", *[count(f"chunks.{s}.{k}").alias(f"{s.lower()}_{k}") for s in "AB" for k in ("total", "sent")],
        get("answer").alias("answer"), get("model").alias("model"), get("tier").cast("int").alias("tier"), get("finish_reason").alias("finish_reason"),
        F.coalesce(F.json_array_length(get("attempts")), F.lit(0)).cast("long").alias("n_attempts"), count("citations.written").alias("written"), F.json_array_length(get("citations.resolved_list")).cast("long").alias("resolved"),
        "status_code",
    )


CODES = "CASE event_id % 5 WHEN 0 THEN 'invalid_question' WHEN 1 THEN 'upload_too_large' WHEN 2 THEN 'generation_unavailable' WHEN 3 THEN 'no such code' END"


@query(f"SELECT event_id, CASE event_id % 5 WHEN 0 THEN 422 WHEN 1 THEN 413 WHEN 2 THEN 503 ELSE 400 END AS status_code, {CODES} AS error_code, event_type AS error_message FROM events WHERE event_id % 5 < 4")
def error_rows(spark, sf_dir):
    return errors_table(table(spark, sf_dir, "events").withColumn("error_code", F.expr(CODES)), "event_id", message=F.col("event_type"))


def around(request: dict, *mark: str) -> tuple[str, str]:
    before, after = providers.around(request, *mark)
    return quoted(before), quoted(after)


CHAT = [(p.tier, *around(p.request(providers.MARK, 4000))) for p in (providers.CHAIN[0], providers.CHAIN[3], providers.CHAIN[4])]


@query(" UNION ALL ".join(f"SELECT doc_id, {t} AS tier, {b} || to_json(text)::VARCHAR || {a} AS body FROM documents" for t, b, a in CHAT))
def chat_payloads(spark, sf_dir):
    """The requests of three tiers for each document as a prompt."""
    d = table(spark, sf_dir, "documents")
    rows = [F.struct(F.lit(p.tier).alias("tier"), providers.chat_payload(p, F.col("text"), 4000).alias("body")) for p in (providers.CHAIN[0], providers.CHAIN[3], providers.CHAIN[4])]
    return d.select("doc_id", F.inline(F.array(*rows)))


def embed_sql(e: providers.Embedder) -> str:
    if e.kind == "values":
        before, after = around(e.request([providers.MARK])["requests"][0])
        return f"'{{\"requests\":[' || array_to_string(list_transform(texts, lambda t: {before} || to_json(t)::VARCHAR || {after}), ',') || ']}}'"
    before, after = around(e.request([providers.MARK]), providers.json.dumps([providers.MARK]))
    return f"{before} || to_json(texts)::VARCHAR || {after}"


@query("WITH t AS (SELECT conv_id, list(text ORDER BY turn) AS texts FROM conversations GROUP BY conv_id) " + " UNION ALL ".join(f"SELECT conv_id, {quoted(e.model)} AS model, {embed_sql(e)} AS body FROM t" for e in providers.EMBEDDERS))
def embed_payloads(spark, sf_dir):
    """The requests of every embedder for the turns of each conversation."""
    t = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("texts"))
    rows = [F.struct(F.lit(e.model).alias("model"), providers.embed_payload(e, F.col("texts")).alias("body")) for e in providers.EMBEDDERS]
    return t.select("conv_id", F.inline(F.array(*rows)))


@query(r"""SELECT doc_id, doc_id % 2 = 0 AS google, CASE WHEN doc_id % 7 = 3 THEN NULL ELSE nullif(regexp_replace(text, '^\s+|\s+$', '', 'g'), '') END AS said,
    CASE WHEN doc_id % 2 = 0 THEN 'served' ELSE 'configured' END AS model,
    CASE WHEN doc_id % 7 = 3 AND doc_id % 2 = 0 THEN 'prompt was blocked: SAFETY' WHEN doc_id % 7 = 3 OR regexp_replace(text, '\s', '', 'g') = '' THEN 'returned an empty answer (' || CASE WHEN doc_id % 2 = 0 THEN 'unknown' ELSE 'length' END || ')' END AS error,
    CASE WHEN doc_id % 2 = 0 THEN '? in / ? out / ? thought tokens' ELSE doc_id || ' in / 7 out / ? reasoning tokens' END AS usage FROM documents""")
def provider_answers(spark, sf_dir):
    """Response bodies made of documents, in both shapes, read back."""
    text = providers.json_string(F.col("text"))
    n = F.col("doc_id")
    google = F.when(n % 7 == 3, F.lit('{"modelVersion":"served","promptFeedback":{"blockReason":"SAFETY"}}')).otherwise(F.concat(F.lit('{"modelVersion":"served","candidates":[{"content":{"parts":[{"text":'), text, F.lit("},{}]}}]}")))
    content = F.when(n % 7 == 3, F.lit('" "')).when(n % 3 == 0, F.concat(F.lit('[{"type":"thinking","text":"x"},{"type":"text","text":'), text, F.lit("}]"))).otherwise(text)
    openai = F.concat(F.lit('{"choices":[{"finish_reason":"length","message":{"content":'), content, F.lit('}}],"usage":{"completion_tokens":7,"prompt_tokens":'), n.cast("string"), F.lit("}}"))
    is_google = n % 2 == 0
    d = table(spark, sf_dir, "documents").select("doc_id", is_google.alias("google"), google.alias("g"), openai.alias("o"))
    name = F.lit("configured")
    a = F.when(F.col("google"), R.answer(F.col("g"), "google", name)).otherwise(R.answer(F.col("o"), "openai", name))
    usage = F.when(F.col("google"), R.usage_summary(F.col("g"), "google")).otherwise(R.usage_summary(F.col("o"), "openai"))
    return d.select("doc_id", "google", a.alias("a"), usage.alias("usage")).select("doc_id", "google", F.col("a.text").alias("said"), F.col("a.model").alias("model"), F.col("a.error").alias("error"), "usage")


@query(f"""SELECT event_id, 'p HTTP ' || CASE WHEN event_id % 2 = 0 THEN 429 ELSE 503 END || ': ' || event_type AS message, CASE WHEN event_id % 2 = 0 THEN 429 ELSE 503 END AS status,
    CASE WHEN event_id % 3 = 0 THEN (event_id % 50)::DOUBLE END AS retry_after, {NOW!r}::DOUBLE + event_id % 90 AS reset_at, CASE WHEN event_id % 2 = 0 THEN 0.0::DOUBLE END AS rate_limit FROM events""")
def error_outcomes(spark, sf_dir):
    """What responses of status 429 and 503 say, their headers made of events."""
    n = F.col("event_id")
    headers = F.map_filter(
        F.create_map(F.lit("Retry-After"), F.when(n % 3 == 0, (n % 50).cast("string")), F.lit("X-RateLimit-Reset"), (n % 90).cast("string"), F.lit("X-RateLimit-Limit-Tokens"), F.when(n % 2 == 0, "0")),
        lambda k, v: v.isNotNull(),
    )
    status = F.when(n % 2 == 0, 429).otherwise(503)
    found = table(spark, sf_dir, "events").select("event_id", R.outcome(F.lit("p"), status, headers, F.col("event_type"), F.lit(NOW)).alias("o"))
    return found.select("event_id", "o.*")


@query(f"SELECT p_partkey, p_brand FROM part WHERE upper(split_part(p_type, ' ', 1)) || '_API_KEY' IN (SELECT upper(split_part(p_type, ' ', 1)) || '_API_KEY' FROM part WHERE p_size < 3 AND p_partkey < 400)")
def keyed_tiers(spark, sf_dir):
    """Parts as tiers, the kinds of some small ones as the keys that are set."""
    p = table(spark, sf_dir, "part")
    key = F.concat(F.upper(F.split("p_type", " ")[0]), F.lit("_API_KEY"))
    return providers.keyed_tiers(p.withColumn("key_env", key), p.filter("p_size < 3 and p_partkey < 400").select(key.alias("name"))).select("p_partkey", "p_brand")


#: One embedder for each shape of an answer, as wide as the table's vectors.
SHAPES = tuple(replace(providers.EMBEDDERS[i], dim=64) for i in (0, 1, 3, 4))
SHAPE_NAMES = "[" + ", ".join(quoted(e.name) for e in SHAPES) + "]"
SHAPE_MODELS = "[" + ", ".join(quoted(e.model) for e in SHAPES) + "]"


def recorded_batches(spark, sf_dir) -> DataFrame:
    """Answers to batches of eight vectors in the four shapes; by number, some are short, narrow, zero, refused, no JSON or of another shape."""
    fault, kind = F.col("batch") % 9, F.col("batch") % 4
    rows = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 8).alias("batch"), F.struct("vec_id", F.col("embedding").cast("array<double>").alias("v")).alias("row"))
    b = rows.groupBy("batch").agg(F.array_sort(F.collect_list("row")).alias("rows"))  # eight rows at most
    v = F.transform("rows", lambda r, i: F.when((fault == 2) & (i == 0), F.slice(r["v"], 1, 63)).when((fault == 3) & (i == 0), F.transform(r["v"], lambda x: F.lit(0.0))).otherwise(r["v"]))
    b = b.withColumn("v", v).withColumn("v", F.when(fault == 1, F.slice("v", 1, F.size("v") - 1)).otherwise(F.col("v")))
    size = F.size("v").cast("string")
    indexed = F.concat(F.lit('{"model":"served","usage":{"prompt_tokens":9},"data":'), F.to_json(F.reverse(F.transform("v", lambda x, i: F.struct(i.alias("index"), x.alias("embedding"))))), F.lit("}"))
    result = F.concat(F.lit('{"success":true,"result":{"shape":['), size, F.lit(',64],"data":'), F.to_json("v"), F.lit("}}"))
    values = F.concat(F.lit('{"embeddings":'), F.to_json(F.transform("v", lambda x: F.struct(x.alias("values")))), F.lit("}"))
    float_ = F.concat(F.lit('{"embeddings":{"float":'), F.to_json("v"), F.lit('},"meta":{"billed_units":{"input_tokens":5}}}'))
    whole = F.when(kind == 0, indexed).when(kind == 1, result).when(kind == 2, values).otherwise(float_)
    other = F.when(kind == 1, F.lit('{"success":false,"errors":["full"]}')).otherwise(F.lit("{}"))
    body = F.when(fault == 4, "slow down").when(fault == 5, " oops ").when(fault == 6, other).otherwise(whole)
    model = F.element_at(F.array(*[F.lit(e.model) for e in SHAPES]), kind.cast("int") + 1)
    return b.select("batch", model.alias("model"), F.transform("rows", lambda r: r["vec_id"]).alias("ids"), F.when(fault == 4, 429).otherwise(200).alias("status"), body.alias("body"))


@query(f"""WITH e AS (SELECT vec_id, vec_id // 8 AS batch, embedding::DOUBLE[] AS v, count(*) OVER (PARTITION BY vec_id // 8) AS n, row_number() OVER (PARTITION BY vec_id // 8 ORDER BY vec_id) AS at FROM embeddings),
    k AS (SELECT *, batch % 9 AS fault, batch % 4 AS kind, {SHAPE_NAMES}[batch % 4 + 1] || ': ' AS name FROM e),
    f AS (SELECT *, CASE fault WHEN 1 THEN name || 'asked for ' || n || ' vectors but got ' || (n - 1) WHEN 2 THEN name || 'expected 64 dimensions, got [63]' WHEN 3 THEN name || 'a zero vector cannot be normalized'
        WHEN 4 THEN name || 'HTTP 429: slow down' WHEN 5 THEN name || 'response was not JSON: oops'
        WHEN 6 THEN name || CASE WHEN kind = 1 THEN 'the response reports failure: ["full"]' ELSE 'unexpected response shape: {{}}' END END AS error FROM k)
    SELECT batch, vec_id AS id, CASE WHEN error IS NULL THEN CASE WHEN kind = 0 THEN 'served' ELSE {SHAPE_MODELS}[kind + 1] END END AS model, error,
    CASE WHEN error IS NULL THEN round(v[1] / sqrt(list_sum(list_transform(v, lambda x: x * x))), 9) END AS first, CASE WHEN error IS NULL THEN round(v[64] / sqrt(list_sum(list_transform(v, lambda x: x * x))), 9) END AS last FROM f""")
def embed_responses(spark, sf_dir):
    """Recorded answers of four shapes, read into unit vectors or a batch's error."""
    read = embedding.read_responses(recorded_batches(spark, sf_dir), SHAPES)
    at = lambda i: F.round(F.get("embedding", F.lit(i)), 9)
    return read.select("batch", "id", "model", "error", at(0).alias("first"), at(63).alias("last"))


def timed_calls(spark, sf_dir) -> DataFrame:
    """Four tiers a request with two calls each, made of events: their kinds as pools, seconds by id."""
    e, n = table(spark, sf_dir, "events"), F.col("event_id")
    code = (n * 13 + F.floor(n / 8)) % 11
    status = F.when(code == 0, 200).when(code <= 4, 429).when(code <= 7, 503).otherwise(500)
    wait = F.when(n % 5 == 1, 5.0).when(n % 5 == 2, 31.0).when(n % 5 == 3, 61.0)
    return e.select(
        F.floor(n / 8).alias("request_id"), (F.floor(n % 8 / 2) + 1).cast("int").alias("tier"), F.col("event_type").alias("pool"), F.concat(F.lit("model "), F.floor(n % 8 / 2).cast("string")).alias("model"),
        (n % 2).cast("int").alias("attempt"), status.alias("status"), wait.alias("retry_after"), F.when(n % 7 < 3, F.lit(NOW + 90)).alias("reset_at"), F.when(code == 4, 0.0).alias("rate_limit"),
        F.concat(F.lit("status "), status.cast("string")).alias("error"), F.when(code == 0, F.concat(F.lit("answer "), n.cast("string"))).alias("answer"), (n % 4 * 20.0).alias("seconds"), F.lit(NOW).alias("started"),
    )


@query(f"""WITH RECURSIVE e AS (SELECT event_id // 8 AS request_id, event_id % 8 AS n, event_id % 8 // 2 + 1 AS tier, event_type AS pool, (event_id * 13 + event_id // 8) % 11 AS code, event_id AS id FROM events),
    o AS (SELECT *, CASE WHEN code = 0 THEN 200 WHEN code <= 4 THEN 429 WHEN code <= 7 THEN 503 ELSE 500 END AS status, CASE id % 5 WHEN 1 THEN 5.0 WHEN 2 THEN 31.0 WHEN 3 THEN 61.0 END::DOUBLE AS retry,
        (id % 4 * 20)::DOUBLE AS seconds, id % 7 < 3 AS resets FROM e),
    s AS (SELECT DISTINCT request_id, -1::BIGINT AS n, 0::DOUBLE AS clock, []::VARCHAR[] AS dead, []::VARCHAR[] AS attempts, false AS open, NULL::BIGINT AS won, NULL::VARCHAR AS answer FROM o
    UNION ALL SELECT request_id, n, CASE WHEN over THEN clock WHEN calls THEN later + CASE WHEN code = 0 OR final THEN 0 ELSE delay END ELSE clock END,
        CASE WHEN calls AND code BETWEEN 1 AND 3 AND final THEN list_append(dead, pool) ELSE dead END,
        CASE WHEN skip IS NOT NULL THEN list_append(attempts, tier || ' ' || skip) WHEN calls AND code > 0 AND final THEN list_append(attempts, tier || CASE WHEN code = 4 THEN ' not available on this account: status ' ELSE ' status ' END || status) ELSE attempts END,
        calls AND code > 0 AND NOT final, CASE WHEN over THEN won WHEN calls AND code = 0 THEN tier END, CASE WHEN over THEN answer WHEN calls AND code = 0 THEN 'answer ' || id END
    FROM (SELECT *, code >= 8 OR code = 4 OR tries = 1 OR (status = 429 AND coalesce(told > 60, false)) OR delay > 30 OR later + delay >= 150 AS final
    FROM (SELECT *, coalesce(greatest(told, CASE WHEN told IS NOT NULL THEN 0 END), 2.0 ** tries) AS delay
    FROM (SELECT *, NOT over AND (open OR (first AND skip IS NULL)) AS calls, coalesce(retry, CASE WHEN resets THEN 90 - later END) AS told
    FROM (SELECT s.request_id, s.n + 1 AS n, s.clock, s.dead, s.attempts, s.open, s.won, s.answer, s.won IS NOT NULL AS over, o.n % 2 = 0 AS first, o.tier, o.pool, o.code, o.status, o.retry, o.resets, o.id, s.clock + o.seconds AS later,
        CASE WHEN s.won IS NULL AND o.n % 2 = 0 THEN CASE WHEN list_contains(s.dead, o.pool) THEN 'skipped: ' || o.pool || ' exhausted' WHEN s.clock >= 150 THEN 'skipped: time budget spent' END END AS skip, CASE WHEN s.open THEN 1 ELSE 0 END AS tries
    FROM s JOIN o ON s.request_id = o.request_id AND o.n = s.n + 1)))))
    SELECT request_id, won::INT AS tier, answer, array_to_string(attempts, '; ') AS attempts, round(clock, 6) AS elapsed FROM s WHERE n = 7""")
def fallback_timed(spark, sf_dir):
    """The fallback over calls that take time, with waits, retries and a budget of 150 seconds."""
    found = completion.fallback_in_time(timed_calls(spark, sf_dir), completion.Waits(budget=150.0))
    said = F.array_join(F.transform("attempts", lambda a: F.concat_ws(" ", a["tier"].cast("string"), a["error"])), "; ")
    return found.select("request_id", "tier", "answer", said.alias("attempts"), F.round("elapsed", 6).alias("elapsed"))


@query("""WITH u AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE)))) AS v FROM embeddings),
    s AS (SELECT q.vec_id AS query_id, x.vec_id AS id, round(list_inner_product(q.v, x.v), 12) AS score FROM u q JOIN u x ON q.vec_id % 20 = 0 AND q.vec_id <> x.vec_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s)
    SELECT query_id, rank::INT AS rank, id, round(score, 9) AS score FROM r WHERE rank <= 10""")
def nearest_vectors(spark, sf_dir):
    """The ten nearest to each vector whose id is divisible by 20, among all rows."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return ranking.top_k(e.filter("id % 20 = 0"), e).withColumn("score", F.round("score", 9))


def packed_sql(source: str) -> str:
    """k (doc_id, i, start_line, end_line, text): the texts of a table (doc_id, text) in ever finer parts, by lists (l0 to l4), packed by a fold."""
    steps = [f"l0 AS (SELECT doc_id, text, [text] AS p FROM {source} WHERE regexp_matches(text, '\\S'))"]
    for i, separator in enumerate(SEPARATORS, 1):
        mark = "' '" if separator == " " else f"repeat(chr(10), {len(separator)})"
        parts = f"list_transform(string_split(x, {mark}), lambda y, i: CASE WHEN i < len(string_split(x, {mark})) THEN y || {mark} ELSE y END)"
        steps.append(f"l{i} AS (SELECT doc_id, text, flatten(list_transform(p, lambda x: CASE WHEN length(x) > 1530 THEN list_filter({parts}, lambda y: y <> '') ELSE [x] END)) AS p FROM l{i - 1})")
    steps.append("""z AS (SELECT doc_id, text, flatten(list_transform(p, lambda x: list_transform(range(0, length(x), 1530), lambda i: length(substring(x, i + 1, 1530))))) AS sizes FROM l4),
    f AS (SELECT doc_id, text, list_reduce(list_transform(sizes, lambda s: {'b': 0::BIGINT, 'e': s::BIGINT, 'done': []::STRUCT(b BIGINT, e BIGINT)[]}), lambda a, x: {
        'b': CASE WHEN a.e > 0 AND a.e + x.e - a.b > 1500 THEN greatest(a.b, a.e - 150, a.e + x.e - 1530) ELSE a.b END, 'e': a.e + x.e,
        'done': CASE WHEN a.e > 0 AND a.e + x.e - a.b > 1500 THEN list_append(a.done, {'b': a.b, 'e': a.e}) ELSE a.done END}) AS s FROM z),
    u AS (SELECT doc_id, text, unnest(list_append(s.done, {'b': s.b, 'e': s.e})) AS c FROM f),
    v AS (SELECT doc_id, c.b AS b, substring(text, c.b + 1, c.e - c.b) AS body, left(text, c.b) AS before FROM u),
    w AS (SELECT doc_id, b, regexp_replace(body, '^\\s+|\\s+$', '', 'g') AS text, len(string_split(before || regexp_extract(body, '^\\s+'), chr(10))) AS start_line FROM v),
    k AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY b) - 1)::INT AS i, start_line::INT AS start_line, (start_line + len(string_split(text, chr(10))) - 1)::INT AS end_line, text FROM w WHERE text <> '')""")
    return ", ".join(steps)


@query(f"WITH {packed_sql('documents')} SELECT doc_id AS pair_id, i AS \"at\", start_line, end_line, text FROM k")
def size_pieces(spark, sf_dir):
    """Documents cut by size, packed with an overlap, without Python."""
    return chunking.size_pieces(artifacts(spark, sf_dir)).select("pair_id", "at", "start_line", "end_line", "text")


@query("""WITH p AS (SELECT *, '# ' || p_name AS one, '## Rest of it' || chr(10) || p_type AS two FROM part),
    c AS (SELECT p_partkey, 'B-0' AS chunk_id, 'a.py' AS artifact_id, 'class P' || p_partkey AS label, 1 AS start_line, 4 AS end_line FROM p
    UNION ALL SELECT p_partkey, 'B-1', 'a.py', 'def size_' || p_size, 8, 10 FROM p
    UNION ALL SELECT p_partkey, 'B-2', 'b.md', CASE WHEN length(two) > length(one) THEN 'Rest of it' ELSE trim(p_name) END, 1, 4 FROM p)
    SELECT p_partkey AS pair_id, chunk_id, artifact_id, label, start_line, end_line, '[' || artifact_id || ' · ' || label || ' · lines ' || start_line || '-' || end_line || ']' AS header FROM c""")
def side_chunks_sql(spark, sf_dir):
    """Two files of each part, cut, merged and numbered by a table function from SQL: Python with a class and a function, and Markdown of two small sections that become one."""
    tables.register(spark)
    md = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("pair_id"), F.lit("B").alias("side"), F.lit("b.md").alias("name"), F.concat(F.lit("# "), "p_name", F.lit("\n\n## Rest of it\n"), "p_type").alias("text"))
    files = part_sources(spark, sf_dir).withColumn("name", F.lit("a.py")).unionByName(md)
    return spark.sql("SELECT pair_id, chunk_id, artifact_id, label, start_line, end_line, header FROM side_chunks(TABLE(SELECT * FROM {files}) PARTITION BY (pair_id, side) ORDER BY name)", files=files)


@query(f"""WITH {TURNS}, l AS (SELECT pair_id, pos, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM t),
    q AS (SELECT pair_id, pos, chunk_id, source, CASE pos % 3 WHEN 0 THEN ' ' || string_split(text, chr(10))[1] WHEN 1 THEN substring(string_split(text, chr(10))[1], 4, 30) ELSE 'no such words' END AS quote FROM c),
    m AS (SELECT q.*, line_no, line, trim(line) = trim(quote) AS exact FROM q JOIN l USING (pair_id, pos) WHERE trim(quote) <> '' AND contains(line, trim(quote))),
    b AS (SELECT *, bool_or(exact) OVER (PARTITION BY pair_id, pos) AS any_exact FROM m),
    r AS (SELECT pair_id, pos, min(line_no) AS line, arg_min(line, line_no) AS text, count(*) = 1 AS "unique" FROM b WHERE exact OR NOT any_exact GROUP BY pair_id, pos)
    SELECT pair_id, pos AS n, chunk_id, quote, CASE WHEN line IS NOT NULL THEN source END AS source, line, r.text, "unique" FROM q LEFT JOIN r USING (pair_id, pos)""")
def resolve_indexed(spark, sf_dir):
    """Quotes of whole first lines, of parts of them, and of nothing, by the line index."""
    t = selection.assign_ids(turns(spark, sf_dir))
    first, kind = F.get(F.split("text", "\n"), F.lit(0)), F.col("pos") % 3
    quote = F.when(kind == 0, F.concat(F.lit(" "), first)).when(kind == 1, F.substring(first, 4, 30)).otherwise("no such words")
    return citations.resolve_by_index(t.select("pair_id", F.col("pos").alias("n"), "chunk_id", quote.alias("quote")), t)


# Pieces p (doc_id, i, s, e, label, text) of lines y (doc_id, lines): one by one, small ones join a neighbour whose lines have room,
# one of the same section before another, the next before the one before.
MADE = "list_slice(lines, {x}.s, {y}.e)"
JOINED = "{{'s': {x}.s, 'e': {y}.e, 'label': CASE WHEN length({y}.text) > length({x}.text) THEN {y}.label ELSE {x}.label END, 'text': array_to_string(" + MADE + ", chr(10))}}"
NEXT, PREVIOUS = JOINED.format(x="todo[1]", y="todo[2]"), JOINED.format(x="done[-1]", y="todo[1]")


MERGED = f"""r AS (SELECT doc_id, lines, []::STRUCT(s BIGINT, e BIGINT, label VARCHAR, text VARCHAR)[] AS done, todo FROM y JOIN (SELECT doc_id, list({{'s': s::BIGINT, 'e': e::BIGINT, 'label': label, 'text': text}} ORDER BY i) AS todo FROM p GROUP BY doc_id) USING (doc_id)
    UNION ALL SELECT doc_id, lines, CASE way WHEN 'next' THEN done WHEN 'previous' THEN done[:-2] ELSE list_append(done, todo[1]) END,
        CASE way WHEN 'next' THEN list_prepend({NEXT}, todo[3:]) WHEN 'previous' THEN list_prepend({PREVIOUS}, todo[2:]) ELSE todo[2:] END
    FROM (SELECT *, CASE WHEN ahead AND (NOT back OR split_part(todo[1].label, ' · ', 1) = split_part(todo[2].label, ' · ', 1) OR split_part(todo[1].label, ' · ', 1) <> split_part(done[-1].label, ' · ', 1)) THEN 'next' WHEN back THEN 'previous' ELSE 'stay' END AS way
    FROM (SELECT *, length(todo[1].text) < 90 AND len(todo) > 1 AND length(array_to_string({MADE.format(x='todo[1]', y='todo[2]')}, chr(10))) <= 1530 AS ahead,
        length(todo[1].text) < 90 AND len(done) > 0 AND length(array_to_string({MADE.format(x='done[-1]', y='todo[1]')}, chr(10))) <= 1530 AS back FROM r WHERE len(todo) > 0))),
    c AS (SELECT doc_id, unnest(done) AS x, generate_subscripts(done, 1) AS i FROM r WHERE len(todo) = 0)"""


@query(f"""WITH RECURSIVE g AS (SELECT doc_id, '# Part ' || doc_id || chr(10) || chr(10) || CASE WHEN doc_id % 3 = 0 THEN '```' || chr(10) || '# no heading' || chr(10) || '```' || chr(10) ELSE '' END || text AS body FROM documents),
    y AS (SELECT doc_id, string_split(body || chr(10) || chr(10) || '## Rest' || chr(10) || 'last', chr(10)) AS lines, regexp_replace(body, '\\n\\s*$', '') AS text FROM g),
    large AS (SELECT doc_id, text FROM y WHERE length(text) > 1530), {packed_sql('large')},
    p AS (SELECT doc_id, i, start_line AS s, end_line AS e, 'Part ' || doc_id || ' · part ' || (i + 1) || '/' || count(*) OVER (PARTITION BY doc_id) AS label, text FROM k
    UNION ALL SELECT doc_id, 0, 1, len(string_split(text, chr(10))), 'Part ' || doc_id, text FROM y WHERE length(text) <= 1530
    UNION ALL SELECT doc_id, 1000000, len(lines) - 1, len(lines), 'Rest', '## Rest' || chr(10) || 'last' FROM y),
    {MERGED}
    SELECT doc_id AS pair_id, (i - 1)::INT AS chunk_index, x.s::INT AS start_line, x.e::INT AS end_line, x.label AS label, x.text AS text FROM c""")
def markdown_chunks(spark, sf_dir):
    return chunking.chunks(headed(spark, sf_dir)).select("pair_id", "chunk_index", "start_line", "end_line", "label", "text")


@query(f"""WITH RECURSIVE y AS (SELECT doc_id, lang, string_split(text, chr(10)) AS lines FROM documents), {packed_sql('documents')},
    p AS (SELECT doc_id, i, start_line AS s, end_line AS e, '' AS label, text FROM k),
    {MERGED}
    SELECT doc_id AS pair_id, CASE WHEN lang = 'en' THEN 'A' ELSE 'B' END AS side, 'd' || doc_id || '.txt' AS source, (i - 1)::INT AS chunk_index, x.s::INT AS start_line, x.e::INT AS end_line,
    '[d' || doc_id || '.txt · lines ' || x.s || '-' || x.e || ']' AS header, x.text AS text FROM c JOIN y USING (doc_id)""")
def recursive_chunks(spark, sf_dir):
    return chunking.chunks(artifacts(spark, sf_dir)).select("pair_id", "side", "source", "chunk_index", "start_line", "end_line", "header", "text")
