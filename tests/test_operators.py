import itertools
import json
import os
import random
import time

import pytest
from pyspark.sql import functions as F

from duoscope.functions import errors, pieces, responses, text
from duoscope.operators import chunking, citations, completion, prompts, providers, selection, vectors
from duoscope.sources import files
from duoscope.streaming.intake import start_intake


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column).first()[0]


@pytest.mark.parametrize("s", ["a\nb", "a\r\nb\r\n", "a\x0cb\x85c\u2028d", "", "\n", "x\n\n", "a\x1cb\x1dc"])
def test_lines_are_pythons(spark, s):
    assert one(spark, text.split_lines(F.col("s")), s=s) == s.splitlines()


@pytest.mark.parametrize("s", [" a ", "\t\u00a0x\x1f\n", "", "\u3000", "a b"])
def test_strip_is_pythons(spark, s):
    assert one(spark, text.strip(F.col("s")), s=s) == s.strip()


def test_text_functions(spark):
    assert one(spark, text.tokens(F.col("s")), s="a😀éx") == 2
    assert one(spark, text.truncate(F.col("s"), 3), s="  abcd ") == "abc…"
    assert one(spark, text.section_numbers(F.col("s")), s="§10 and §2, §10") == [2, 10]
    assert one(spark, text.unescape(F.col("s")), s="a\\_b \\* c\\d") == "a_b * c\\d"
    assert one(spark, text.embed_text(F.lit(""), F.col("s")), s="x") == "x"


def test_cuts_by_size():
    assert pieces.spans("x" * 4000) == [(0, 1530), (1530, 3060), (3060, 4000)]
    assert pieces.by_size(" \n ") == []
    body = "\n\n".join(" ".join(f"word{i}" for i in range(k, k + 60)) for k in range(40))
    found = pieces.by_size(body)
    assert all(len(t) <= pieces.MOST and t == t.strip() and t in body for t, *_ in found)
    for t, first, last, _ in found:
        assert t.split("\n")[0] in body.split("\n")[first - 1] and t.split("\n")[-1] in body.split("\n")[last - 1]


def test_python_definitions():
    source = "import os\n\n\n@deco\nclass A:\n    x = 1\n\n" + "".join(f"    def m{i}(self):\n        # {'c' * 100}\n        return {i}\n\n" for i in range(20)) + "\nasync def f():\n    pass\n"
    found = pieces.by_definition(source)
    assert found[0] == ("import os", 1, 1, "")
    assert found[1][0].startswith("@deco\nclass A") and found[1][3] == "class A"
    assert [p[3] for p in found[2:5]] == ["class A · def m0", "class A · def m1", "class A · def m2"]
    assert found[-1][3] == "def f"
    assert pieces.by_definition("def (:\n" * 3) == pieces.by_size("def (:\n" * 3)
    assert pieces.by_definition("a\x00b") == pieces.by_size("a\x00b")


def test_small_pieces_merge_with_their_kin():
    source = "\n".join(["short one", "", "x" * 200, "", "short two"])
    parts = [("short one", 1, 1, "a"), ("x" * 200, 3, 3, "a · b"), ("short two", 5, 5, "c")]
    assert pieces.merged(parts, source) == [(source, 1, 5, "a · b")]
    long = [("s", 1, 1, ""), ("y" * 1530, 2, 2, "")]
    assert pieces.merged(long, "s\n" + "y" * 1530) == long
    labelled = pieces.capped([("word " * 700, 3, 3, "L")])
    assert [p[3] for p in labelled] == [f"L · part {i}/{len(labelled)}" for i in range(1, len(labelled) + 1)] and len(labelled) > 2


def test_chunks_of_each_kind(spark):
    md = "intro\n\n# One\nbody " + "b " * 60 + "\n```\n# not a heading\n~~~\n## Two\n" + "t " * 60
    rows = [(1, "A", "dir/a.MD", md), (1, "B", "b.py", "def f(x):\n    return x\n"), (1, "B", "c.txt", "plain"), (2, "A", "d.md", "  "), (2, "B", "e.py", None)]
    got = chunking.chunks(spark.createDataFrame(rows, "pair_id long, side string, name string, text string")).orderBy("side", "pos").collect()
    assert [(r.side, r.source, r.chunk_index, r.pos) for r in got] == [("A", "a.MD", 0, 1), ("A", "a.MD", 1, 2), ("B", "b.py", 0, 1), ("B", "c.txt", 0, 2)]
    assert got[0].label == "One" and got[1].label == "Two" and got[2].header == "[b.py · def f · lines 1-2]" and got[3].header == "[c.txt · lines 1-1]"


def test_budget_is_a_prefix_of_each_side(spark):
    rows = [(1, s, i, "", "x" * (3 * n)) for s in "AB" for i, n in enumerate([4, 9, 1])]
    got = selection.select_within(spark.createDataFrame(rows, "pair_id long, side string, pos int, header string, text string"), 21).orderBy("side", "pos").collect()
    assert [r.included for r in got] == [True, False, False] * 2


def test_prompt_parts_and_status(spark):
    rows = [(p, s, i, f"{s}.md", "[h]", "t" * 30) for p in (1, 2, 3) for s in "AB" for i in range(2)]
    c = selection.assign_ids(spark.createDataFrame(rows, "pair_id long, side string, pos int, source string, header string, text string"))
    q = spark.createDataFrame([(1, " why? ", ""), (2, "  ", ""), (3, "what", "found it")], "pair_id long, question string, prior string")
    selected, made = prompts.plan(c, q)
    status = {r.pair_id: (r.status, r.prompt) for r in made.collect()}
    assert status[1][0] == "ok" and status[2] == ("invalid_question", None) and status[1][1].endswith("QUESTION: why?")
    assert "A-0  text included  [h]" in status[1][1]
    small = {r.pair_id: r.status for r in prompts.plan(c, q, budget=60)[1].collect()}
    assert small[1] == "artifacts_too_large_to_compare"
    prior = prompts.build_prompt(prompts.build_context(selected).join(q, "pair_id"), prompts.TEMPLATES["compare"], prior="prior").filter("pair_id = 3").first().prompt
    assert "\n\n\nALREADY FOUND IN SIDE B\n\nfound it\n\n\n" in prior


def test_resolution_order(spark):
    chunk = [(1, "B-0", "b.py", 100, "a = 1\nuse a = 1 twice\n  same\nsame\nbegins here\n  and goes on\nx\\_y | z")]
    cases = {"a = 1": (100, "a = 1", True), "twice": (101, "use a = 1 twice", True), "same": (102, "  same", False), "here and goes": (104, "begins here", True), "x\\\\_y \\| z": None, "x\\_y \\| z": None, "nowhere": None, " ": None}
    cites = spark.createDataFrame([(1, i, "B-0", q) for i, q in enumerate(cases)] + [(1, 99, "B-7", "a = 1")], "pair_id long, n int, chunk_id string, quote string")
    got = {r.quote if r.n < 99 else None: r for r in citations.resolve(cites, spark.createDataFrame(chunk, "pair_id long, chunk_id string, source string, start_line int, text string")).collect()}
    for q, want in cases.items():
        assert (tuple(got[q])[5:] == want) if want else got[q].line is None, q
    assert got[None].source is None


def test_headers(spark):
    now = F.lit(1_000_000_000.0)
    assert one(spark, responses.retry_after(F.col("h"), now), h="5") == 5
    assert one(spark, responses.retry_after(F.col("h"), now), h="-5") == 0
    assert one(spark, responses.retry_after(F.col("h"), now), h="soon") is None
    assert one(spark, responses.retry_after(F.col("h"), now), h="Sun, 09 Sep 2001 01:46:50 GMT") == 10
    assert one(spark, responses.reset_at(F.col("h"), now), h="30") == 1_000_000_030
    assert one(spark, responses.reset_at(F.col("h"), now), h="1700000000000") == 1_700_000_000
    assert one(spark, responses.delay(F.lit(None).cast("double"), F.lit(None).cast("double"), now, F.col("a")), a=3) == 8


def test_bodies(spark):
    body = lambda x: json.dumps(x)
    message = lambda c: body({"choices": [{"message": {"content": c}}]})
    assert one(spark, responses.openai_message(F.col("b")), b=message("hi")) == "hi"
    assert one(spark, responses.openai_message(F.col("b")), b=message([{"type": "text", "text": "a"}, {"type": "think"}, {"type": "text", "text": "b"}])) == "ab"
    for given, want in (("", None), (" \n", None), (" x ", "x"), ("[]", "[]"), ('[{"a":1}]', '[{"a":1}]'), ([], None), (["a"], None), (5, None), (None, None)):
        assert one(spark, responses.openai_message(F.col("b")), b=message(given)) == want, given
    assert one(spark, responses.google_message(F.col("b")), b=body({"candidates": [{"content": {"parts": [{"text": " "}]}}]})) is None
    blocked = one(spark, responses.answer(F.col("b"), "google", F.lit("n")), b=body({"promptFeedback": {"blockReason": "SAFETY"}}))
    assert tuple(blocked) == (None, "n", "unknown", "prompt was blocked: SAFETY")
    assert one(spark, responses.answer(F.col("b"), "openai", F.lit("n")), b="not JSON").error == "the response can't be read"
    assert one(spark, responses.google_message(F.col("b")), b=body({"candidates": [{"content": {"parts": [{"text": "x"}, {"text": "y"}]}}]})) == "xy"
    assert one(spark, responses.raw_vectors(F.col("b"), "indexed"), b=body({"data": [{"index": 1, "embedding": [2.0]}, {"index": 0, "embedding": [1.0]}]})) == [[1.0], [2.0]]
    assert one(spark, responses.raw_vectors(F.col("b"), "result"), b=body({"success": True, "result": {"shape": [2, 1], "data": [[1.0]]}})) is None
    assert one(spark, responses.raw_vectors(F.col("b"), "float"), b=body({"embeddings": {"float": [[1.5]]}})) == [[1.5]]
    assert one(spark, responses.raw_vectors(F.col("b"), "values"), b=body({"embeddings": [{"values": [3.0]}]})) == [[3.0]]


def test_hostile_python_is_cut_by_size():
    for source in ("-" * 20_000 + "x", "x" + ".a" * 20_000, "(" * 300 + ")" * 300):
        assert pieces.by_definition(source) == pieces.by_size(source)


def test_a_form_feed_shifts_text_but_not_lines():
    """The parser counts two lines before f, splitlines() three, so the text of f ends a line early."""
    assert pieces.by_definition("x = 1\n\x0c\ndef f():\n    pass\n") == [("x = 1", 1, 1, ""), ("def f():", 4, 4, "def f"), ("    pass", 5, 5, "")]


def slow_merge(parts, text, settled=0):
    """By the rule: pieces before `settled` stay; the first after them that is small and has a neighbour with room is replaced by the two as one."""
    rows = text.splitlines()

    def one(left, right):
        first, last = min(left[1], right[1]), max(left[2], right[2])
        return "\n".join(rows[first - 1 : last]), first, last, max((left, right), key=lambda p: len(p[0]))[3]

    def kin(p, q):
        pairs = zip(p[3].split(" · "), q[3].split(" · "), strict=False)
        return sum(1 for _ in itertools.takewhile(lambda x: x[0] == x[1], pairs))

    if settled == len(parts):
        return list(parts)
    before, piece, after = parts[:settled], parts[settled], parts[settled + 1 :]
    ways = []  # (closeness, whether it is the next, what comes of it, where to go on)
    if len(piece[0]) < 90 and after:
        ways.append((kin(piece, after[0]), True, (*before, one(piece, after[0]), *after[1:]), settled))
    if len(piece[0]) < 90 and before:
        ways.append((kin(piece, before[-1]), False, (*before[:-1], one(before[-1], piece), *after), settled - 1))
    ways = [w for w in ways if len(w[2][w[3]][0]) <= 1530]
    if not ways:
        return slow_merge(parts, text, settled + 1)
    _, _, parts, settled = max(ways, key=lambda w: w[:2])
    return slow_merge(parts, text, settled)


def test_merging_against_a_slow_version():
    rnd = random.Random(1)
    for _ in range(400):
        lines, parts = [], []
        for _ in range(rnd.randint(1, 12)):
            first = len(lines) + 1
            lines += [" ".join(rnd.choice(["aa", "bbbb", "c"]) for _ in range(rnd.choice([1, 3, 10, 60, 200]))) for _ in range(rnd.randint(1, 3))]
            parts.append(("\n".join(lines[first - 1 :]), first, len(lines), rnd.choice(["", "a", "a · b", "a · b · c", "d"])))
            lines += [""] * (rnd.random() < 0.3)
        text = "\n".join(lines)
        assert pieces.merged(parts, text) == slow_merge(tuple(parts), text)


def slow_cuts(text, separators=pieces.SEPARATORS):
    """By definition: text that is too long is cut behind each of the first separator that it holds, and so on."""
    if len(text) <= 1530:
        return [text] if text else []
    if not separators:
        return [text[:1530], *slow_cuts(text[1530:], ())]
    first, *others = separators
    parts = [x + first for x in text.split(first)]
    parts[-1] = parts[-1].removesuffix(first)
    return [y for x in parts for y in slow_cuts(x, tuple(others))]


def test_cuts_against_a_slow_version():
    rnd = random.Random(2)
    for _ in range(60):
        text = "".join(rnd.choice(["word", " ", "\n", "\n\n", "\n\n\n", "x" * rnd.randint(1, 900)]) for _ in range(rnd.randint(1, 80)))
        assert [text[a:b] for a, b in pieces.spans(text) if a < b] == slow_cuts(text)


def test_positions_and_other_splitters(spark):
    rows = [(1, "A", "b.rst", 0, "one"), (1, "A", "a.rst", 1, "two"), (1, "A", "b.rst", 2, "three"), (1, "A", ".md", 3, "# four")]
    df = spark.createDataFrame(rows, "pair_id long, side string, name string, artifact_pos int, text string")
    got = chunking.chunks(df, chunking.SPLITTERS | {".rst": lambda t: [(t.upper(), 1, 1, "R")]}).orderBy("pos").collect()
    assert [(r.text, r.label, r.source) for r in got] == [("ONE", "R", "b.rst"), ("TWO", "R", "a.rst"), ("THREE", "R", "b.rst"), ("# four", "", ".md")]
    twice = [(1, "A", "m.md", 5, "# T\nbody"), (1, "A", "m.md", 4, "# U\nother")]
    got = chunking.chunks(spark.createDataFrame(twice, df.schema)).orderBy("pos").collect()
    assert [r.label for r in got] == ["U", "T"]


def test_a_quote_in_a_long_text(spark):
    text_ = "\n".join(f"line {i} of the text" for i in range(5_000)) + "\nthe end\n  of it"
    cites = spark.createDataFrame([(1, 0, "B-0", "line 4321 of the text line 4322 of"), (1, 1, "B-0", "the end of it"), (1, 2, "B-0", "none of this")], "pair_id long, n int, chunk_id string, quote string")
    chunk = spark.createDataFrame([(1, "B-0", "b", 1, text_)], "pair_id long, chunk_id string, source string, start_line int, text string")
    start = time.perf_counter()
    assert [r.line for r in citations.resolve(cites, chunk).orderBy("n").collect()] == [4322, 5001, None]
    assert time.perf_counter() - start < 20


def test_an_outcome_without_a_pool(spark):
    schema = "request_id long, tier int, pool string, model string, status int, rate_limit double, error string, answer string"
    rows = [(1, 1, None, "a", 429, None, "busy", None), (1, 2, None, "b", 200, None, None, "yes"), (2, 1, "p", "a", 429, None, "busy", None), (2, 2, "p", "b", 200, None, None, "never")]
    got = {r.request_id: r for r in completion.fallback(spark.createDataFrame(rows, schema)).collect()}
    assert (got[1].tier, got[1].model, got[1].answer) == (2, "b", "yes") and got[2].tier is None
    bad = completion.unanswered(completion.fallback(spark.createDataFrame(rows, schema))).collect()
    assert [tuple(r) for r in bad] == [(2, 503, "generation_unavailable", "no tier answered: tier 1 a: busy; tier 2 b: skipped: p exhausted")]


def test_error_codes(spark):
    assert one(spark, errors.status_code(F.col("c")), c="upload_too_large") == 413
    assert one(spark, errors.status_code(F.col("c")), c="what") == 400
    rows = spark.createDataFrame([(i, t, "too_long" if i % 2 else None) for i, t in enumerate("abcdefghij")], "pos int, text string, error string").withColumn("batch", F.lit(0))
    assert [tuple(r) for r in vectors.first_errors(rows, "batch", "pos").collect()] == [(0, "too_long", 5, [1, 3, 5])]
    with pytest.raises(ValueError):
        completion.embed(rows, None, dim=2, size=97)


def test_requests(spark):
    for p in providers.CHAIN:
        body = one(spark, providers.chat_payload(p, F.col("t"), 9), t='a "b"\n\\é😀')
        assert json.loads(body) == p.request('a "b"\n\\é😀', 9)
    for e in providers.EMBEDDERS:
        for task in ("query", "document"):
            body = one(spark, providers.embed_payload(e, F.array("t", F.lit("x")), task), t='q"')
            assert json.loads(body) == e.request(['q"', "x"], task)
    assert [p.tier for p in providers.CHAIN] == list(range(1, 16))
    assert providers.EMBEDDERS[3].request(["x"], "query")["requests"][0]["taskType"] == "RETRIEVAL_QUERY"


def test_credentials():
    env = {"CLOUDFLARE_API_KEY": " k ", "CLOUDFLARE_ACCOUNT_ID": "acc", "GOOGLE_API_KEY": "g", "MISTRAL_API_KEY": " "}
    assert providers.address(providers.CHAIN[10], env).split("/")[-5:] == ["acc", "ai", "v1", "chat", "completions"]
    assert providers.address(providers.EMBEDDERS[1], env).endswith("/acc/ai/run/@cf/baai/bge-base-en-v1.5")
    assert providers.headers(providers.CHAIN[10], env)["Authorization"] == "Bearer k"
    assert providers.headers(providers.EMBEDDERS[3], env)["x-goog-api-key"] == "g"
    with pytest.raises(providers.ProviderError, match="MISTRAL_API_KEY is not set"):
        providers.headers(providers.CHAIN[3], env)
    with pytest.warns(UserWarning, match="OPENROUTER_API_KEY"):
        assert "Gemini 3.7 Flash" in providers.validate_keys(env)
    with pytest.raises(RuntimeError, match="GROQ_API_KEY"):
        providers.validate_keys({})


def test_client_over_a_transport():
    sent, env = [], {"GOOGLE_API_KEY": "g", "GROQ_API_KEY": "q"}

    def send(url, headers, body):
        sent.append((url, json.loads(body)))
        return replies.pop(0)

    google, groq = (providers.Client(p, send, 100, env) for p in (providers.CHAIN[0], providers.CHAIN[11]))
    replies = [(200, {}, json.dumps({"candidates": [{"finishReason": "STOP", "content": {"parts": [{"text": " a"}, {"text": "b "}]}}]})), (429, {"Retry-After": "7", "x-ratelimit-limit-day": "0"}, "slow " * 200)]
    assert google.complete("hi") == {"text": "ab", "model": "Gemini 3.7 Flash", "finish_reason": "STOP"}
    assert sent[0][0].endswith("gemini-3.7-flash:generateContent") and sent[0][1]["generationConfig"]["maxOutputTokens"] == 100
    with pytest.raises(providers.ProviderError) as e:
        google.complete("hi")
    assert (e.value.status, e.value.wait, e.value.rate_limit) == (429, 7.0, 0.0) and len(str(e.value)) < 330
    with pytest.raises(providers.ProviderError, match="does not fit"):
        groq.complete("x" * 30_000)
    assert len(sent) == 2
    for body in ("nonsense", "{}", '{"choices":[{"message":{"content":" "}}]}', '{"choices":[{"message":{"content":5}}]}'):
        with pytest.raises(providers.ProviderError):
            providers.read_answer(providers.CHAIN[3], body)
    said = {"choices": [{"message": {"content": [{"type": "text", "text": "x"}, {"type": "thinking"}]}}], "model": "m"}
    assert providers.read_answer(providers.CHAIN[3], json.dumps(said)) == {"text": "x", "model": "m", "finish_reason": "unknown"}
    assert providers.told({"X-RateLimit-Reset": "30"}, lambda: 1e9)["reset"] == 1e9 + 30
    assert providers.told({"Retry-After": "Sun, 09 Sep 2001 01:46:50 GMT"}, lambda: 1e9)["wait"] == 10


class Fake:
    def __init__(self, tier, pool, script):
        self.tier, self.pool, self.model, self.script = tier, pool, f"m{tier}", list(script)

    def complete(self, prompt):
        x = self.script.pop(0)
        if isinstance(x, Exception):
            raise x
        return {"text": x, "model": self.model, "finish_reason": "stop"}


def test_live_policy():
    E = completion.ProviderError
    waits = []
    rule = completion.Policy(sleep=waits.append, clock=lambda: 0.0)
    clients = [Fake(1, "p", [E("busy", 429, 5), E("busy", 429, 5)]), Fake(2, "p", []), Fake(3, "q", [E("none", 429, rate_limit=0)]), Fake(4, "q", [E("down", 503), "yes"])]
    assert rule.run(clients, "x") == (4, {"text": "yes", "model": "m4", "finish_reason": "stop"}, [{"tier": 1, "model": "m1", "error": "busy"}, {"tier": 2, "model": "m2", "error": "skipped: p exhausted"}, {"tier": 3, "model": "m3", "error": "not available on this account: none"}])
    assert waits == [5, 1.0]
    assert rule.run([Fake(1, "p", [E("long", 429, 61)])], "x")[0] is None and len(waits) == 2


def test_complete_and_embed_in_tasks(spark):
    class Echo:
        tier, pool, model = 1, "p", "m"

        def complete(self, prompt):
            return {"text": prompt.upper(), "model": "served", "finish_reason": "stop"}

    got = completion.complete(spark.createDataFrame([(1, "a"), (2, " ")], "pair_id long, prompt string"), lambda: [Echo()]).orderBy("pair_id").collect()
    assert tuple(got[0]) == (1, 1, "served", "stop", "A", []) and got[1].answer is None

    class Twos:
        def embed(self, texts):
            return [[3.0, 4.0] if t != "bad" else [1.0] for t in texts]

    rows = completion.embed(spark.createDataFrame([(1, "x"), (2, ""), (3, "bad")], "id long, text string"), Twos, dim=2).orderBy("id").collect()
    assert rows[0].embedding == [0.6, 0.8] and [r.error for r in rows] == [None, "blank", "width"]


def test_vectors(spark):
    df = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0]), (3, None), (4, [3.0, 4.0])], "vec_id long, embedding array<double>")
    assert [r.error for r in vectors.validated(df, 2).orderBy("vec_id").collect()] == ["zero", "width", "missing", None]


def test_uploads_and_stream(spark, tmp_path):
    folder = tmp_path / "up"
    folder.mkdir()
    (folder / "a.md").write_bytes("é\r\nb".encode())
    (folder / "b.py").write_bytes(b"\x89PNG\xff")
    (folder / "plain").write_bytes(b"x")
    (folder / "big.txt").write_bytes(b"x = 1\n" * 200_000)
    got = {r.name: (r.text, r.error_code, r.status) for r in files.read_uploads(spark, str(folder)).collect()}
    assert got == {"a.md": ("é\r\nb", None, None), "b.py": (None, "unreadable_upload", 422), "plain": (None, "unnamed_upload", 422), "big.txt": (None, "upload_too_large", 413)}
    assert {r.text for r in files.read_artifacts(spark, str(folder)).filter("name = 'a.md'").collect()} == {"é\nb"}
    rows = spark.createDataFrame([(1, "A", "a.md", "# T\nbody"), (1, "B", "b.py", "x = 1")], "pair_id long, side string, name string, text string")
    assert files.oversized_pairs(rows, max_bytes=-32_765).collect()[0].pair_id == 1
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    start_intake(stream, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    assert {r.chunk_id for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {"A-0", "B-0"}
