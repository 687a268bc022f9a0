"""Queries over logits and prompts: decoding steps, losses, recall."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from seqloom.functions import vectors as vx
from seqloom.functions.seeded import digest, draw_unit
from seqloom.functions.text import CODEPOINTS
from seqloom.operators import decoding, evaluation, long_logits
from seqloom.plans.registry import joined, query, r6, sql_r6, table

SEED = 42
TOP_P, TEMPERATURE = 0.9, 0.1
PAIRS, DISTRACTORS = 16, 64

LOGITS_SQL = "rows AS (SELECT vec_id, label, embedding::DOUBLE[] AS logits FROM embeddings)"


def logit_rows(spark, sf_dir):
    emb = table(spark, sf_dir, "embeddings")
    return emb.select("vec_id", "label", vx.doubles(F.col("embedding")).alias("logits"))


@query(
    "greedy_token",
    f"WITH {LOGITS_SQL} SELECT vec_id, CAST(list_position(logits, list_max(logits)) - 1 AS INTEGER) AS token FROM rows",
)
def greedy_token(spark, sf_dir):
    return logit_rows(spark, sf_dir).select("vec_id", decoding.greedy(F.col("logits")).alias("token"))


NUCLEUS_SQL = f"""{LOGITS_SQL},
    each AS (SELECT vec_id, list_max(logits) AS top, unnest(logits) AS l, unnest(range(len(logits))) AS token FROM rows),
    raw AS (SELECT vec_id, token, exp((l - top) / {TEMPERATURE}) AS e FROM each),
    probs AS (SELECT vec_id, token, e / sum(e) OVER (PARTITION BY vec_id) AS p FROM raw),
    summed AS (
        SELECT *, sum(p) OVER (PARTITION BY vec_id ORDER BY p DESC, token) AS c FROM probs),
    kept AS (SELECT * FROM summed WHERE c - p <= {TOP_P}),
    nucleus AS (
        SELECT vec_id, token, c, p, sum(p) OVER (PARTITION BY vec_id) AS total FROM kept)"""


@query(
    "nucleus_filter",
    f"""WITH {NUCLEUS_SQL} SELECT vec_id, CAST(token AS INTEGER) AS token,
        {sql_r6('p / greatest(total, 1e-12)')} AS p FROM nucleus""",
)
def nucleus_filter(spark, sf_dir):
    kept = decoding.nucleus(F.col("logits"), TOP_P, TEMPERATURE)
    rows = logit_rows(spark, sf_dir).select("vec_id", F.inline(kept))
    return rows.select("vec_id", "token", r6(F.col("p")).alias("p"))


def long_rows(spark, sf_dir):
    """A row per vector and channel."""
    rows = logit_rows(spark, sf_dir)
    return rows.select("vec_id", "label", F.posexplode("logits").alias("token", "logit"))


@query(
    "nucleus_long",
    f"""WITH {NUCLEUS_SQL} SELECT vec_id, CAST(token AS BIGINT) AS token,
        {sql_r6('p / greatest(total, 1e-12)')} AS p FROM nucleus""",
)
def nucleus_long(spark, sf_dir):
    """The same nuclei from logits that are rows, by sums over digits."""
    kept = long_logits.nucleus(long_rows(spark, sf_dir), ["vec_id"], "token", "logit", TOP_P, TEMPERATURE)
    return kept.select("vec_id", "token", r6(F.col("p")).alias("p"))


@query(
    "nucleus_sample",
    f"""WITH {NUCLEUS_SQL},
    drawn AS (
        SELECT *, ('0x' || substr(md5('{SEED}:' || vec_id), 1, 8))::UBIGINT / 4294967296.0::DOUBLE AS u FROM nucleus)
    SELECT vec_id, CAST(arg_min(token, c) AS INTEGER) AS token FROM drawn WHERE c / total > u GROUP BY vec_id""",
)
def nucleus_sample(spark, sf_dir):
    u = draw_unit(digest(SEED, F.col("vec_id")))
    token = decoding.nucleus_sample(F.col("logits"), u, TOP_P, TEMPERATURE)
    return logit_rows(spark, sf_dir).select("vec_id", token.alias("token"))


LOSS_SQL = f"""{LOGITS_SQL},
    nll AS (
        SELECT vec_id, vec_id // 25 AS seq_id, list_max(logits)
            + ln(list_sum(list_transform(logits, lambda l: exp(l - list_max(logits))))) - logits[label + 1] AS nll
        FROM rows WHERE vec_id % 7 <> 0)"""


def losses(spark, sf_dir, by):
    """Every seventh row carries no target."""
    rows = logit_rows(spark, sf_dir).select(
        F.expr("vec_id div 25").alias("seq_id"),
        "logits",
        F.when(F.col("vec_id") % 7 == 0, -100).otherwise(F.col("label")).alias("label"),
    )
    return evaluation.cross_entropy(rows, by, "logits", "label")


@query(
    "masked_xent",
    f"WITH {LOSS_SQL} SELECT seq_id, count(*) AS targets, {sql_r6('avg(nll)')} AS loss FROM nll GROUP BY seq_id",
)
def masked_xent(spark, sf_dir):
    found = losses(spark, sf_dir, ["seq_id"])
    return found.select("seq_id", "targets", r6(F.col("loss")).alias("loss"))


@query(
    "masked_xent_long",
    f"WITH {LOSS_SQL} SELECT seq_id, count(*) AS targets, {sql_r6('avg(nll)')} AS loss FROM nll GROUP BY seq_id",
)
def masked_xent_long(spark, sf_dir):
    """The same losses from logits that are rows: sums that add up wherever they meet."""
    rows = long_rows(spark, sf_dir).select(
        F.expr("vec_id div 25").alias("seq_id"),
        "vec_id",
        "token",
        "logit",
        F.when(F.col("vec_id") % 7 == 0, -100).otherwise(F.col("label")).alias("label"),
    )
    found = long_logits.cross_entropy(rows, ["seq_id", "vec_id"], ["seq_id"], "token", "logit", "label")
    return found.select("seq_id", "targets", r6(F.col("loss")).alias("loss"))


@query(
    "perplexity",
    f"WITH {LOSS_SQL} SELECT count(*) AS targets, {sql_r6('avg(nll)')} AS loss, {sql_r6('exp(avg(nll))')} AS perplexity FROM nll",
)
def perplexity(spark, sf_dir):
    found = losses(spark, sf_dir, [])
    return found.select(
        "targets", r6(F.col("loss")).alias("loss"), r6(F.col("perplexity")).alias("perplexity")
    )


def _draw_sql(kind: str, j: str) -> str:
    return (
        f"'{kind}' || (('0x' || substr(md5('{SEED}:' || doc_id || ':{kind}:' || {j}), 1, 8))::UBIGINT % 100000000)"
    )


PROMPTS_SQL = f"""drawn AS (
        SELECT doc_id, lang, list_transform(range({PAIRS}), lambda j: {_draw_sql('K', 'j')}) AS k,
            list_transform(range({PAIRS}), lambda j: {_draw_sql('V', 'j')}) AS v,
            ('0x' || substr(md5('{SEED}:' || doc_id || ':target'), 1, 8))::UBIGINT::BIGINT % {PAIRS} AS t FROM documents),
    prompts AS (
        SELECT doc_id, lang, array_to_string(list_transform(range(1, {PAIRS + 1}), lambda j: k[j] || '=' || v[j] || ';'), ' ')
            || repeat(' filler', {DISTRACTORS}) || ' Query: ' || k[t + 1] || '=' AS prompt, v[t + 1] AS answer FROM drawn)"""


def prompts(spark, sf_dir):
    """One prompt per document."""
    return evaluation.recall_prompts(
        table(spark, sf_dir, "documents").select("doc_id"), "doc_id", PAIRS, DISTRACTORS, SEED
    )


@query("kv_recall_prompts", f"WITH {PROMPTS_SQL} SELECT doc_id, prompt, answer FROM prompts")
def kv_recall_prompts(spark, sf_dir):
    return prompts(spark, sf_dir)


@query(
    "kv_answer_lookup",
    f"""WITH {PROMPTS_SQL},
    pairs AS (SELECT doc_id, unnest(regexp_extract_all(prompt, '(K\\d+)=(V\\d+);', 1)) AS k,
        unnest(regexp_extract_all(prompt, '(K\\d+)=(V\\d+);', 2)) AS v FROM prompts),
    asked AS (SELECT doc_id, answer, regexp_extract(prompt, 'Query: (K\\d+)=', 1) AS k FROM prompts)
    SELECT doc_id, CAST(count(*) AS INTEGER) AS found, bool_or(v = answer) AS right_answer
    FROM asked JOIN pairs USING (doc_id, k) GROUP BY doc_id""",
)
def kv_answer_lookup(spark, sf_dir):
    found = prompts(spark, sf_dir).withColumn("v", evaluation.lookup_values(F.col("prompt")))
    return found.select(
        "doc_id", F.size("v").alias("found"), F.array_contains("v", F.col("answer")).alias("right_answer")
    )


@query(
    "kv_recall_score",
    f"""WITH asked AS (
        SELECT role, text AS prediction, regexp_extract(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), '[^ ]+') AS answer
        FROM conversations)
    SELECT role, count(*) AS prompts, {sql_r6('avg(CASE WHEN contains(prediction, answer) THEN 1 ELSE 0 END)')} AS score
    FROM asked WHERE answer IS NOT NULL GROUP BY role""",
)
def kv_recall_score(spark, sf_dir):
    """Turns as predictions: how often does one recall the first word of the turn before it?"""
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    asked = table(spark, sf_dir, "conversations").select(
        "role", F.col("text").alias("prediction"), F.regexp_extract(before, "[^ ]+", 0).alias("answer")
    )
    score = evaluation.recall_score(asked.where("answer IS NOT NULL"), "prediction", "answer", ["role"])
    return score.select("role", "prompts", r6(F.col("score")).alias("score"))


@query(
    "strip_prompt",
    """SELECT conv_id, turn, array_to_string(list_transform(string_split(text, ''), lambda c: unicode(c)), ' ') AS ids
    FROM conversations""",
)
def strip_prompt(spark, sf_dir):
    """Outputs are prompt (the role) and continuation (the text); the mask marks the prompt."""
    turns = table(spark, sf_dir, "conversations")
    prompt = CODEPOINTS.ids(F.col("role"), None)
    out = turns.select(
        "conv_id",
        "turn",
        F.concat(prompt, CODEPOINTS.ids(F.col("text"), None)).alias("output"),
        F.concat(F.transform(prompt, lambda _: F.lit(1)), F.array(F.lit(0), F.lit(0))).alias("mask"),
    )
    rest = decoding.strip_prompt(F.col("output"), F.col("mask"))
    return out.select("conv_id", "turn", joined(rest).alias("ids"))
