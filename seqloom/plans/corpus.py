"""Queries over documents: scans, tokens, vocabulary, blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from seqloom.functions.text import CODEPOINTS, CONTROL_TOKENS, word_count
from seqloom.operators import blocks, decoding, sharding, vocabulary
from seqloom.operators.ledger import token_counts
from seqloom.plans.registry import joined, query, table
from seqloom.session import scratch_path, stored
from seqloom.sources.corpus import register_dataset, scan_files, spread
from seqloom.sources.corpus import scan_named as find_named

SEQ_LEN = 512
MAX_TOKENS = 4 * SEQ_LEN  # the truncation rule: four blocks' worth of one document
MICRO = 8
PAD = 0


WORDS_SQL = r"regexp_extract_all(text, '[^ \n\t\r]+')"
IDS_SQL = "list_transform(string_split(text, ''), lambda c: unicode(c))"
CUT_IDS_SQL = (
    f"list_transform(string_split(substr(text, 1, {MAX_TOKENS}), ''), lambda c: unicode(c))"
)
BATCHES_SQL = (
    f"SELECT (row_number() OVER (ORDER BY doc_id) - 1) // {MICRO} AS batch_id, * FROM documents"
)


def blocks_sql(docs: str, group: str = "", seq_len: int = SEQ_LEN, pad: int = PAD) -> str:
    """Packing by brute force, a row per token. ``docs`` gives ``group…, o, ids``."""
    size, g = seq_len + 1, f"{group}, " if group else ""
    by = f"PARTITION BY {group} " if group else ""
    return f"""
    docs AS ({docs}),
    tokens AS (
        SELECT {g}o, unnest(list_append(ids, {pad})) AS id, unnest(range(len(ids) + 1)) AS i
        FROM docs WHERE len(ids) > 0),
    placed AS (SELECT {g}id, row_number() OVER ({by}ORDER BY o, i) - 1 AS p FROM tokens),
    full_blocks AS (
        SELECT {g}p // {size} AS block, list(id ORDER BY p) AS f
        FROM placed GROUP BY {g}p // {size} HAVING count(*) >= 2),
    blocks AS (
        SELECT {g}CAST(block AS BIGINT) AS block, CAST(len(f) AS INTEGER) AS n_valid,
            list_resize(f, {size}, {pad})[1:{seq_len}] AS input_ids,
            list_resize(f[2:], {seq_len}, -100) AS labels
        FROM full_blocks)"""


SHOW_SQL = """block, n_valid, array_to_string(input_ids, ' ') AS input_ids,
    array_to_string(labels, ' ') AS labels"""


def show(packed: DataFrame, *group: str) -> DataFrame:
    return packed.select(
        *group,
        *(["block"] if "block" in packed.columns else []),
        "n_valid",
        joined("input_ids").alias("input_ids"),
        joined("labels").alias("labels"),
    )


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"))


def batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in micro-batches, with only the text that truncation can keep."""
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "lang", CODEPOINTS.clip(F.col("text"), MAX_TOKENS).alias("text")
    )
    return sharding.assign_batches(docs, "doc_id", MICRO)


def pack(docs: DataFrame) -> DataFrame:
    return blocks.pack_batches(
        docs,
        ["batch_id"],
        "doc_id",
        SEQ_LEN,
        PAD,
        payload="text",
        tokens=lambda text: CODEPOINTS.ids(text, MAX_TOKENS),
    )


def batch_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(batches(spark, sf_dir))


@query(
    "scan_documents",
    "SELECT doc_id, lang, source, n_chars, CAST(length(text) AS INTEGER) AS text_length "
    "FROM documents",
)
def scan_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", "lang", "source", "n_chars", F.length("text").alias("text_length"))


NARROW_SQL = "SELECT doc_id, lang, CAST(length(text) AS INTEGER) AS text_length FROM documents"


def _narrow(docs):
    return docs.select("doc_id", "lang", F.length("text").alias("text_length"))


@query("scan_named", f"{NARROW_SQL} WHERE lang = 'en'")
def scan_named(spark, sf_dir):
    """A dataset registered by name, in splits of its own, and read through the session's catalog."""
    path = scratch_path(spark, "named")
    docs = table(spark, sf_dir, "documents")
    docs.where("lang = 'en'").write.parquet(f"{path}/english")
    docs.where("lang <> 'en'").write.parquet(f"{path}/other")
    register_dataset(spark, "corpus", {"train": f"{path}/other", "test": f"{path}/english"}, config="by_language")
    return _narrow(find_named(spark, "corpus", "by_language", "test"))


@query("select_files", f"{NARROW_SQL} WHERE doc_id >= (SELECT (max(doc_id) + 1) // 2 FROM documents)")
def select_files(spark, sf_dir):
    """Two snapshots side by side: only the files of the later one match the pattern."""
    path = scratch_path(spark, "snapshot")
    docs = table(spark, sf_dir, "documents")
    half = ((docs.agg(F.max("doc_id")).first()[0] or 0) + 1) // 2
    docs.where(F.col("doc_id") < half).write.option("compression", "snappy").parquet(f"{path}/early")
    docs.where(F.col("doc_id") >= half).write.option("compression", "gzip").parquet(f"{path}/late")
    return _narrow(scan_files(spark, path, name_glob="*.gz.parquet"))


@query(
    "tokenize_documents",
    f"SELECT doc_id, CAST(len({WORDS_SQL}) AS INTEGER) AS n_words, "
    f"CAST(len({IDS_SQL}) AS INTEGER) AS n_tokens, array_to_string({CUT_IDS_SQL}, ' ') AS input_ids "
    "FROM documents",
)
def tokenize_documents(spark, sf_dir):
    return texts(spark, sf_dir).select(
        "doc_id",
        word_count(F.col("text")).alias("n_words"),
        CODEPOINTS.count(F.col("text"), None).alias("n_tokens"),
        joined(CODEPOINTS.ids(F.col("text"), MAX_TOKENS)).alias("input_ids"),
    )


def vocab_sql(source: str = "documents") -> str:
    return f"""words AS (SELECT DISTINCT unnest({WORDS_SQL}) AS token FROM {source}),
    base AS (
        SELECT token, CAST(row_number() OVER (ORDER BY md5(token), token) - 1 AS BIGINT) AS id,
            false AS is_special FROM words),
    vocab AS (
        SELECT * FROM base UNION ALL
        SELECT token, CAST((SELECT count(*) FROM base) + k AS BIGINT), true
        FROM (VALUES ('<|user|>', 0), ('<|assistant|>', 1), ('<|end|>', 2)) AS s(token, k))"""


VOCAB_SQL = vocab_sql()


def vocab_of(spark, sf_dir):
    """The base vocabulary is stored: its highest id and its size are then a look at the files."""
    base = stored(vocabulary.build_vocab(texts(spark, sf_dir)), "vocab")
    return vocabulary.extend_vocab(base, CONTROL_TOKENS)


@query("vocab_with_specials", f"WITH {VOCAB_SQL} SELECT token, id, is_special FROM vocab")
def vocab_with_specials(spark, sf_dir):
    return vocab_of(spark, sf_dir)


# Two rows in a row share a key, and some more have no text or no words: rows stay apart and none is lost.
ENCODE_SQL = f"""WITH {VOCAB_SQL},
    docs AS (
        SELECT doc_id AS r, doc_id // 2 AS pair, text FROM documents
        UNION ALL SELECT -1 - i, -1, CASE WHEN i > 0 THEN ' ' END FROM (SELECT unnest(range(3)) AS i)),
    tokens AS (SELECT r, unnest({WORDS_SQL}) AS token, unnest(range(len({WORDS_SQL}))) AS i FROM docs),
    ids AS (SELECT r, count(*) AS n, string_agg(id, ' ' ORDER BY i) AS input_ids
        FROM tokens JOIN vocab USING (token) GROUP BY r)
    SELECT pair, CAST(coalesce(n, 0) AS INTEGER) AS n, coalesce(input_ids, '') AS input_ids
    FROM docs LEFT JOIN ids USING (r)"""


def encoded(spark, sf_dir, **how):
    docs = texts(spark, sf_dir).select(F.expr("doc_id div 2").alias("pair"), "text")
    more = spark.range(3).select(F.lit(-1).cast("long").alias("pair"), F.when(F.col("id") > 0, " ").alias("text"))
    ids = vocabulary.encode(docs.union(more), vocab_of(spark, sf_dir), "pair", **how)
    return ids.select("pair", F.size("input_ids").alias("n"), joined("input_ids").alias("input_ids"))


@query("encode_vocab_join", ENCODE_SQL)
def encode_vocab_join(spark, sf_dir):
    return encoded(spark, sf_dir, small_vocab=0)


@query("encode_vocab", ENCODE_SQL)
def encode_vocab(spark, sf_dir):
    """The same rows with the vocabulary sent to the tasks, while it is small enough for that."""
    return encoded(spark, sf_dir)


PACK_VOCAB_SQL = f"""WITH {VOCAB_SQL},
    numbered AS ({BATCHES_SQL}),
    word_places AS (
        SELECT batch_id, doc_id, unnest(({WORDS_SQL})[1:{MAX_TOKENS}]) AS token,
            unnest(range(least(len({WORDS_SQL}), {MAX_TOKENS}))) AS i FROM numbered),
    ids AS (
        SELECT batch_id, doc_id AS o, list(id ORDER BY i) AS ids FROM word_places JOIN vocab USING (token) GROUP BY ALL),
    pad AS (SELECT id FROM vocab WHERE token = '<|end|>'),"""


@query(
    "pack_vocab_blocks",
    f"""{PACK_VOCAB_SQL}
    {blocks_sql('SELECT batch_id, o, ids FROM ids', 'batch_id', pad='(SELECT id FROM pad)')}
    SELECT batch_id, {SHOW_SQL} FROM blocks""",
)
def pack_vocab_blocks(spark, sf_dir):
    """The everyday path: words to the ids of a vocabulary, cut to ``MAX_TOKENS``, padded by its end token, packed."""
    vocab = vocab_of(spark, sf_dir)
    encode = vocabulary.tokenizer("vocab", vocab)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ids = encode(docs, "text", MAX_TOKENS).drop("text")
    dealt = sharding.assign_batches(ids, "doc_id", MICRO, profile=docs)
    end = vocabulary.special_ids(vocab)[CONTROL_TOKENS[2]]
    return show(blocks.pack_batches(dealt, ["batch_id"], "doc_id", SEQ_LEN, vocabulary.pad_id(None, end)), "batch_id")


DECODE_SQL = f"SELECT doc_id, array_to_string({WORDS_SQL}, ' ') AS text FROM documents"


def decoded(spark, sf_dir, **how):
    """Words to ids with the role and end tokens around them, and back without those."""
    docs, vocab = texts(spark, sf_dir), vocab_of(spark, sf_dir)
    framed = docs.select(
        "doc_id", F.concat_ws(" ", F.lit(CONTROL_TOKENS[0]), "text", F.lit(CONTROL_TOKENS[2])).alias("text")
    )
    return vocabulary.decode(vocabulary.encode(framed, vocab, "doc_id", **how), vocab, "doc_id", **how)


@query("decode_roundtrip", DECODE_SQL)
def decode_roundtrip(spark, sf_dir):
    return decoded(spark, sf_dir)


@query("decode_roundtrip_join", DECODE_SQL)
def decode_roundtrip_join(spark, sf_dir):
    return decoded(spark, sf_dir, small_vocab=0)


@query(
    "compact_by_mask",
    f"SELECT doc_id, array_to_string(list_filter({IDS_SQL}, lambda i: i <> 32), ' ') AS input_ids "
    "FROM documents",
)
def compact_by_mask(spark, sf_dir):
    ids = texts(spark, sf_dir).select("doc_id", CODEPOINTS.ids(F.col("text"), None).alias("ids"))
    masked = ids.select("doc_id", "ids", F.transform("ids", lambda i: (i != 32).cast("int")).alias("mask"))
    return masked.select(
        "doc_id", joined(decoding.compact(F.col("ids"), F.col("mask"))).alias("input_ids")
    )


@query(
    "pack_blocks",
    f"""WITH numbered AS ({BATCHES_SQL}),
    {blocks_sql(f'SELECT batch_id, doc_id AS o, {CUT_IDS_SQL} AS ids FROM numbered', 'batch_id')}
    SELECT batch_id, {SHOW_SQL} FROM blocks""",
)
def pack_blocks(spark, sf_dir):
    return show(batch_blocks(spark, sf_dir), "batch_id")


@query(
    "pack_global",
    f"""WITH {blocks_sql(f'SELECT doc_id AS o, {IDS_SQL} AS ids FROM documents')}
    SELECT {SHOW_SQL} FROM blocks""",
)
def pack_global(spark, sf_dir):
    """The whole corpus, untruncated, as one stream."""
    packed = blocks.pack_global(
        table(spark, sf_dir, "documents").select("doc_id", "text"),
        "doc_id",
        SEQ_LEN,
        PAD,
        ids=CODEPOINTS.ids(F.col("text"), None),
        length=CODEPOINTS.count(F.col("text"), None),
    )
    return show(packed)


@query(
    "pack_by_source",
    f"""WITH {blocks_sql(f'SELECT source, doc_id AS o, {IDS_SQL} AS ids FROM documents', 'source')}
    SELECT source, {SHOW_SQL} FROM blocks""",
)
def pack_by_source(spark, sf_dir):
    """One stream per source; a source may be any share of the corpus."""
    packed = blocks.pack_blocks(
        table(spark, sf_dir, "documents").select("doc_id", "source", "text"),
        ["source"],
        "doc_id",
        SEQ_LEN,
        PAD,
        ids=CODEPOINTS.ids(F.col("text"), None),
        length=CODEPOINTS.count(F.col("text"), None),
    )
    return show(packed, "source")


LANGS = ("de", "en", "es", "fr")


@query(
    "pack_with_empty_batches",
    f"""WITH numbered AS ({BATCHES_SQL}),
    {blocks_sql(f"SELECT batch_id, lang, doc_id AS o, {CUT_IDS_SQL} AS ids FROM numbered", 'batch_id, lang')},
    every AS (SELECT DISTINCT batch_id, unnest({list(LANGS)!r}) AS lang FROM numbered)
    SELECT batch_id, lang, coalesce(block, 0) AS block, coalesce(n_valid, 1) AS n_valid,
        array_to_string(coalesce(input_ids, list_resize([{PAD}], {SEQ_LEN}, {PAD})), ' ') AS input_ids,
        array_to_string(coalesce(labels, list_resize([-100], {SEQ_LEN}, -100)), ' ') AS labels
    FROM every LEFT JOIN blocks USING (batch_id, lang)""",
)
def pack_with_empty_batches(spark, sf_dir):
    """Each batch is packed by language; a language that a batch lacks still yields one block."""
    docs = batches(spark, sf_dir)
    packed = blocks.pack_batches(
        docs,
        ["batch_id", "lang"],
        "doc_id",
        SEQ_LEN,
        PAD,
        payload="text",
        tokens=lambda text: CODEPOINTS.ids(text, MAX_TOKENS),
    )
    every = docs.select("batch_id", F.explode(F.array(*map(F.lit, LANGS))).alias("lang"))
    keys = ["batch_id", "lang"]
    return show(blocks.with_empty_groups(packed, every, keys, SEQ_LEN, PAD), *keys)


@query(
    "unpacked_blocks",
    f"""WITH docs AS (
        SELECT doc_id, list_transform(string_split(substr(text, 1, {SEQ_LEN + 1}), ''),
            lambda c: unicode(c)) AS f FROM documents)
    SELECT doc_id, CAST(len(f) AS INTEGER) AS n_valid,
        array_to_string(list_resize(f, {SEQ_LEN + 1}, {PAD})[1:{SEQ_LEN}], ' ') AS input_ids,
        array_to_string(list_resize(f[2:], {SEQ_LEN}, -100), ' ') AS labels
    FROM docs WHERE len(f) >= 2""",
)
def unpacked_blocks(spark, sf_dir):
    docs = texts(spark, sf_dir).select(
        "doc_id", CODEPOINTS.ids(F.col("text"), SEQ_LEN + 1).alias("input_ids")
    )
    return show(blocks.unpacked_blocks(docs, ["doc_id"], SEQ_LEN, PAD), "doc_id")


@query(
    "token_counts",
    f"""WITH numbered AS ({BATCHES_SQL}),
    {blocks_sql(f'SELECT batch_id, doc_id AS o, {CUT_IDS_SQL} AS ids FROM numbered', 'batch_id')}
    SELECT batch_id, CAST(sum(len(list_filter(labels, lambda y: y <> -100))) AS BIGINT)
        AS supervised_tokens, count(*) AS examples
    FROM blocks GROUP BY batch_id""",
)
def token_count_report(spark, sf_dir):
    return token_counts(batch_blocks(spark, sf_dir), ["batch_id"])
