import zlib

import numpy as np
import public_tokenizers
import pytest

from seqloom.llm import token_store as ts

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [
    None, "", " ", "  ", "a  b", "a   b", "a\n b", "a \nb", "tab\t x", "x<|endoftext|> y", "don't we'll  I'm", "a\u00a0 b", "a \u00a0b",
    "é ü 漢字 日本 \U0001F600 x", "1 22 333 !! ?? ...  --", "a\x1c b", "trailing ", " leading", "word " * 5000, "x" * 3000, "same", "same",
]


def brute(rows):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(PATH)
    out, start = [], 0
    for key, text in rows:
        ids = plain.encode(text or "", add_special_tokens=False).ids + [0]
        out.append((key, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids))
        start += len(ids)
    return out


@pytest.mark.parametrize("parts", [1, 3])
def test_round_trip(spark, prose, parts):
    texts = TEXTS + [prose(300) for _ in range(40)]
    rows = [(i * 3, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame([(k, t, 0) for k, t in reversed(rows)], "doc_id long, text string, start int").repartition(parts)
    manifest = ts.write_tokens(df, "doc_id", "text", PATH, seq_len=64)
    got = sorted(map(tuple, ts.read_tokens(manifest).collect()))
    expected = brute(rows)
    assert got == [e[:4] for e in expected]

    # Every sequence is a view of the file; ids under the mask are the documents, one after the other.
    stream = []
    for p in manifest.orderBy("part").collect():
        ids, _ = ts.open_part(p["folder"], p["name"])
        n = sum(ids.get_batch(b).num_rows for b in range(ids.num_record_batches))
        for i in range(n):
            values, mask = ts.sequence(ids, i)
            assert len(values) == 64 and not values.flags.owndata
            stream += values[mask.to_numpy(zero_copy_only=False)].tolist()
    assert stream == [x for e in expected for x in e[4]]


def test_null_keys_ties_and_empty(spark):
    df = spark.createDataFrame([(None, "b"), (2, "x"), (1, "y"), (1, "y"), (1, None)], "doc_id long, text string")
    got = ts.read_tokens(ts.write_tokens(df, "doc_id", "text", PATH)).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [None, 1, 1, 1, 2]
    assert [r["start"] for r in got] == np.cumsum([0] + [r["n_tokens"] for r in got])[:-1].tolist()
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert ts.read_tokens(ts.write_tokens(empty, "doc_id", "text", PATH)).count() == 0


def test_other_tokenizers_are_encoded_whole(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    encoder = ts.Encoder(path)
    assert not encoder.in_pieces
    texts = ["Some  Words\n here", "", "and   more"]
    plain = [e.ids for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(b, encoder.dtype).tolist() for b in encoder.encode(texts)] == plain


def test_pieces_met_again_are_never_encoded_twice(monkeypatch, prose):
    monkeypatch.setattr(ts, "CACHED_PIECES", 60)
    encoder, learned = ts.Encoder(PATH), []
    learn = encoder._learn
    monkeypatch.setattr(encoder, "_learn", lambda new: learned.extend(new) or learn(new))
    for i in range(30):
        texts = [f"the first of them {i}x{j} naïve  {prose(1)} 漢字{i % 3} ends {j}y" for j in range(6)] + ["", " ", None or "no"]
        plain = [e.ids for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
        assert [np.frombuffer(b, encoder.dtype).tolist() for b in encoder.encode(texts)] == plain
        texts = [t.replace("  ", " ") for t in texts]
        plain = [e.ids for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
        assert [np.frombuffer(b, encoder.dtype).tolist() for b in encoder.encode(texts)] == plain
    assert learned.count("first") == learned.count("naïve") == learned.count("ends") == 1
    assert len(encoder.pieces) + len(encoder.older) < 150
