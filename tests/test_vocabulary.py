"""Words to ids through dictionaries of chunks, and tokenizers by name."""

import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from seqloom.functions.text import WORD_PATTERN, split_words
from seqloom.operators import vocabulary as vb
from seqloom.session import stored


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(["a", "b", "the", "of", f"w{rng.randrange(90)}"]) for _ in range(rng.randint(0, 30))), i % 3, "p") for i in range(200)]
    rows += [(7, None, 1, None), (7, "", 1, "p"), (8, " \n", 2, "p"), (8, "new unknown new", 2, "p"), (9, "a b " * 500, 0, "long")]
    return spark.createDataFrame(rows + rows[:2], "d long, text string, _of int, payload string").repartition(3)


@pytest.fixture(scope="module")
def vocab(spark, docs):
    rows = sorted({w for (t,) in docs.select("text").collect() for w in (t or "").split()} - {"unknown", "new"})
    return spark.createDataFrame([(w, 5 * i, False) for i, w in enumerate(rows)], "token string, id long, is_special boolean")


@pytest.mark.parametrize("small_vocab, chunk", [(10**6, 1), (0, 40), (0, 1 << 18)])
@pytest.mark.parametrize("unknown, max_len", [(None, None), (99_999, 7)])
def test_rows_and_columns_stay(spark, docs, vocab, monkeypatch, small_vocab, chunk, unknown, max_len):
    monkeypatch.setattr(vb, "CHUNK_ELEMENTS", chunk)
    ids = {r["token"]: r["id"] for r in vocab.collect()}
    out = vb.encode_rows(docs, vocab, "text", unknown, max_len, "found", small_vocab)
    assert out.columns == ["d", "text", "_of", "payload", "found"]
    expected = [(*r, [ids.get(w, unknown) for w in (r["text"] or "").split()[:max_len]]) for r in docs.collect()]
    assert sorted(map(repr, map(tuple, out.collect()))) == sorted(map(repr, expected))


def test_words_are_no_rows_of_the_plan(docs, vocab):
    plan = vb.encode_rows(docs, vocab, small_vocab=0)._jdf.queryExecution().toString()
    assert "Generate" not in plan and "CoGroup" in plan


def test_words_reach_the_plan_once_per_chunk(spark, docs, vocab, monkeypatch):
    written = []
    monkeypatch.setattr(vb, "stored", lambda df, name: written.append(store := stored(df, name)) or store)
    vb.encode(docs, vocab, "d", small_vocab=0).collect()
    chunks = written[0].select(vb.CHUNK, vb.CODES, vb.CODE, vb.ELEMENT).collect()
    words = [(r[vb.CHUNK], r[vb.ELEMENT]) for r in chunks if r[vb.CODES] is None]
    rows = [r for r in chunks if r[vb.CODES] is not None]
    assert len(rows) == docs.count() and len(words) == len(set(words)) and all(w for _, w in words)
    assert not any("array" in kind for _, kind in written[0].dtypes)
    assert "regexp" not in vb.build_vocab(docs)._jdf.queryExecution().toString()


def test_words_are_split_as_by_the_pattern():
    rng = random.Random(1)
    for _ in range(300):
        texts = [None if rng.random() < 0.1 else "".join(rng.choice("ab \u00e9\U0001f600 \t\n\r\v\x00") for _ in range(rng.randrange(9))) for _ in range(rng.randrange(6))]
        column = pa.array(["zz q", *texts, "x"], pa.string()).slice(1, len(texts))
        for n in (None, 0, 1, 2):
            assert split_words(column, n).to_pylist() == [re.findall(WORD_PATTERN, x or "")[:n] for x in texts]


@pytest.mark.parametrize("small_vocab", [10**6, 0])
def test_bytes_that_are_no_text_are_read_as_before(spark, small_vocab):
    df = spark.range(1).select(F.lit(7).alias("d"), F.expr("cast(x'61ff6220c3' as string)").alias("text"))
    vocab = vb.build_vocab(df)
    assert sorted(r["token"] for r in vocab.collect()) == ["a\ufffdb", "\ufffd"]
    back = vb.decode(vb.encode(df, vocab, "d", small_vocab=small_vocab), vocab, "d", small_vocab=small_vocab)
    assert back.first()["text"] == "a\ufffdb \ufffd"


def test_bytes_bound_what_is_sent(docs, vocab, monkeypatch):
    monkeypatch.setattr(vb, "SMALL_BYTES", 10)
    assert "CoGroup" in vb.encode_rows(docs, vocab)._jdf.queryExecution().toString()


def test_tokenizers_by_name(spark, docs, vocab):
    with pytest.raises(ValueError):
        vb.tokenizer("vocab")
    with pytest.raises(ValueError):
        vb.tokenizer("other")
    rows = docs.where("text is not null")
    own = vb.tokenizer("words")(rows, "text", 3).collect()
    words = {}
    for r in own:
        assert len(r["input_ids"]) == len(r["text"].split()[:3])
        for w, i in zip(r["text"].split(), r["input_ids"]):
            assert words.setdefault(w, i) == i
    assert len(set(words.values())) == len(words)
    points = vb.tokenizer("codepoints")(rows, "text", 4, "ids").select("text", "ids").collect()
    assert all(r["ids"] == [ord(c) for c in r["text"][:4]] for r in points)
    given = vb.tokenizer("vocab", vocab, unknown=1)(rows, "text", 4).where(F.col("text").startswith("new")).first()
    assert given["input_ids"] == [1, 1, 1]


def test_a_tokenizer_file(docs):
    files = pytest.importorskip("public_tokenizers")
    tokenizers = pytest.importorskip("tokenizers")
    path = files.path("byte_bpe_50k.json")
    direct = tokenizers.Tokenizer.from_file(path)
    for r in vb.tokenizer(f"hf:{path}")(docs, "text", 9).collect():
        assert r["input_ids"] == direct.encode(r["text"] or "", add_special_tokens=False).ids[:9]
