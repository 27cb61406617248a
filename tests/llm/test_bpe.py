import hashlib
import random

import pytest
from pyspark.sql import functions as F

from duoscope.llm import bpe

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")
HARD = ["", None, " ", "a", "\n\n", "don't you'll  it's", "<|startoftext|>x <|endoftext|>", "é ́e Å", " x y", "ΣΑΣ İI ǅ", "x" * 5000, "日本語" * 800, "a‍b 😀👍🏽", "1234 5.6", "\x00\x1f\x85 b"]


def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def want(texts):
    t = tokenizer()
    ids = [t.encode(x or "", add_special_tokens=False).ids for x in texts]
    return [(len(x), hashlib.sha256(" ".join(map(str, x)).encode()).hexdigest(), hashlib.sha256(t.decode(x, skip_special_tokens=False).encode()).hexdigest()) for x in ids]


@pytest.mark.parametrize("bits", [2, 5, 10])
def test_joins_are_repaired(bits):
    rnd = random.Random(bits)
    base = ["".join(rnd.choice("ab cdé\nÉ'ſ<|>s\t 12日") for _ in range(rnd.randint(0, 400))) for _ in range(150)]
    texts = [(x or "") for x in HARD] + base + [a + b for a, b in zip(base, base[1:])]
    encoder, plain = bpe.ReusingEncoder(PATH, chunk_bits=bits, max_chunks=50, max_words=60), tokenizer()
    import numpy as np

    for start in range(0, len(texts), 20):
        part = texts[start : start + 20]
        for text, ids in zip(part, encoder.encode([x.encode() for x in part])):
            assert np.frombuffer(ids, np.int32).tolist() == plain.encode(text, add_special_tokens=False).ids, text


def test_whole_table_against_the_library(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", F.lit("x").alias("ids"))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = {r[0]: tuple(r)[1:] for r in bpe.digests(bpe.encode(docs, PATH)).collect()}
    assert got == dict(zip((i for i, _ in rows), want([t for _, t in rows])))


def test_hard_texts_and_round_trip(spark):
    docs = spark.createDataFrame(list(enumerate(HARD)), "doc_id long, text string")
    coded = bpe.encode(docs, PATH).cache()
    assert [tuple(r)[1:] for r in bpe.digests(coded).orderBy("doc_id").collect()] == want(HARD)
    assert [r.text for r in bpe.decode(coded, PATH).orderBy("doc_id").collect()] == [r.decoded for r in coded.orderBy("doc_id").collect()]
    assert bpe.encode(docs.limit(0), PATH).collect() == []


def test_ids_that_are_null_or_unknown_decode_to_nothing(spark):
    ids = tokenizer().encode("the cat", add_special_tokens=False).ids
    rows = spark.createDataFrame([(1, [ids[0], None, 10**8, ids[1]]), (2, None), (3, [])], "doc_id long, ids array<int>")
    assert [r.text for r in bpe.decode(rows, PATH).orderBy("doc_id").collect()] == [tokenizer().decode(ids), "", ""]


def test_a_tokenizer_that_keeps_white_space_is_refused(tmp_path):
    from tokenizers import Tokenizer, models, pre_tokenizers

    kept = Tokenizer(models.WordLevel({"a": 0, "b": 1, "Ġa": 2, "Ġb": 3, "?": 4}, unk_token="?"))
    kept.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False)
    kept.save(str(tmp_path / "kept.json"))
    with pytest.raises(ValueError, match="white space"):
        bpe.ReusingEncoder(str(tmp_path / "kept.json"))


def test_a_join_that_disagrees_is_encoded_as_a_whole():
    encoder, plain = bpe.ReusingEncoder(PATH, chunk_bits=4), tokenizer()
    text = "some words that are cut into chunks here and there " * 5
    poisoned = {}

    class Off:
        """Ids of a join that are wrong when it stands alone."""

        def __getattr__(self, name):
            return getattr(plain, name)

        def encode_batch_fast(self, texts, **kw):
            out = plain.encode_batch_fast(texts, **kw)
            if not poisoned:
                poisoned["x"] = True
                return [plain.encode("zebra", add_special_tokens=False)] * len(texts)
            return out

    encoder.tokenizer = Off()
    import numpy as np

    assert np.frombuffer(encoder.encode([text.encode()])[0], np.int32).tolist() == plain.encode(text, add_special_tokens=False).ids
