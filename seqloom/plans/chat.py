"""Queries over conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqloom.functions.text import CODEPOINTS, CONTROL_TOKENS
from seqloom.operators import chat, sharding, vocabulary
from seqloom.operators.chat import ControlIds
from seqloom.operators.ledger import unsupervised
from seqloom.operators.vocabulary import pad_id
from seqloom.plans.corpus import WORDS_SQL, vocab_sql
from seqloom.plans.registry import joined, query, table
from seqloom.session import stored
from seqloom.sources.corpus import fill_turn_defaults

SEQ_LEN = 512
MICRO = 16
CONTROL = ControlIds()
PAD = pad_id(None, CONTROL.end)


CODEPOINTS_SQL = "list_transform(string_split(text, ''), lambda c: unicode(c))"


def render_sql(ids: str = CODEPOINTS_SQL, user="{c.user}", assistant="{c.assistant}", end="{c.end}", source="conversations") -> str:
    """A row per token, with a conversation's tokens numbered in turn order."""
    user, assistant, end = (x.format(c=CONTROL) for x in (user, assistant, end))
    return f"""turns AS (
        SELECT conv_id, turn, role = 'assistant' AS a,
            list_concat([CASE WHEN role = 'assistant' THEN {assistant} ELSE {user} END], {ids}, [{end}]) AS seg
        FROM {source}),
    tokens AS (
        SELECT conv_id, turn, a, unnest(seg) AS id, unnest(range(len(seg))) AS i FROM turns),
    stream AS (
        SELECT conv_id, turn, id, a AND i > 0 AS sup,
            row_number() OVER (PARTITION BY conv_id ORDER BY turn, i) - 1 AS p FROM tokens),
    shifted AS (
        SELECT conv_id, turn, p, id, lead(id) OVER w AS next_id, lead(sup) OVER w AS next_sup
        FROM stream WINDOW w AS (PARTITION BY conv_id ORDER BY p)),
    examples AS (
        SELECT conv_id, turn, p, id, CASE WHEN next_sup THEN next_id ELSE -100 END AS label
        FROM shifted WHERE next_id IS NOT NULL)"""


RENDER_SQL = render_sql()

CUT_SQL = f"""{RENDER_SQL},
    cut AS (
        SELECT conv_id, list(id ORDER BY p) AS input_ids, list(label ORDER BY p) AS labels
        FROM examples WHERE p < {SEQ_LEN} GROUP BY conv_id)"""


@query(
    "scan_conversations",
    "SELECT conv_id, turn, role, CAST(length(text) AS INTEGER) AS text_length FROM conversations",
)
def scan_conversations(spark, sf_dir):
    turns = fill_turn_defaults(table(spark, sf_dir, "conversations"))
    return turns.select("conv_id", "turn", "role", F.length("text").alias("text_length"))


@query(
    "turn_defaults",
    """SELECT conv_id, turn, coalesce(CASE WHEN role <> 'system' THEN role END, 'user') AS role,
        CAST(coalesce(CASE WHEN turn > 0 THEN length(text) END, 0) AS INTEGER) AS text_length FROM conversations""",
)
def turn_defaults(spark, sf_dir):
    """Turns without a role are the user's and turns without a text are empty."""
    turns = table(spark, sf_dir, "conversations").withColumns(
        {"role": F.when(F.col("role") != "system", F.col("role")), "text": F.when(F.col("turn") > 0, F.col("text"))}
    )
    return fill_turn_defaults(turns).select("conv_id", "turn", "role", F.length("text").alias("text_length"))


@query(
    "tokenize_turns",
    "SELECT conv_id, turn, CAST(length(text) AS INTEGER) AS n_tokens, "
    "array_to_string(list_transform(string_split(text, ''), lambda c: unicode(c)), ' ') AS ids "
    "FROM conversations",
)
def tokenize_turns(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select(
        "conv_id",
        "turn",
        CODEPOINTS.count(F.col("text"), None).alias("n_tokens"),
        joined(CODEPOINTS.ids(F.col("text"), None)).alias("ids"),
    )


def rendered(spark, sf_dir):
    return chat.render_turns(
        fill_turn_defaults(table(spark, sf_dir, "conversations")),
        "conv_id",
        "turn",
        CONTROL,
        ids=CODEPOINTS.ids(F.col("text"), None),
        length=CODEPOINTS.count(F.col("text"), None),
    )


@query(
    "render_chat",
    f"""WITH {RENDER_SQL}
    SELECT conv_id, turn, CAST(min(p) AS BIGINT) AS start,
        string_agg(id, ' ' ORDER BY p) AS input_ids, string_agg(label, ' ' ORDER BY p) AS labels
    FROM examples GROUP BY conv_id, turn""",
)
def render_chat(spark, sf_dir):
    """Whole conversations, each as its turns laid end to end."""
    return rendered(spark, sf_dir).select(
        "conv_id", "turn", "start", joined("input_ids").alias("input_ids"), joined("labels").alias("labels")
    )


RENDER_VOCAB_SQL = f"""WITH {vocab_sql('conversations')},
    special AS (SELECT token, id FROM vocab WHERE is_special),
    spoken AS (
        SELECT conv_id, turn, any_value(role) AS role, list(id ORDER BY i) FILTER (id IS NOT NULL) AS ids FROM (
            SELECT conv_id, turn, role, unnest(list_append({WORDS_SQL}, NULL)) AS token,
                unnest(range(len({WORDS_SQL}) + 1)) AS i FROM conversations)
        LEFT JOIN vocab USING (token) GROUP BY conv_id, turn),
    {render_sql("coalesce(ids, [])", *(f"(SELECT id FROM special WHERE token = '{t}')" for t in CONTROL_TOKENS), "spoken")}
    SELECT conv_id, turn, CAST(min(p) AS BIGINT) AS start,
        string_agg(id, ' ' ORDER BY p) AS input_ids, string_agg(label, ' ' ORDER BY p) AS labels
    FROM examples GROUP BY conv_id, turn"""


@query("render_chat_vocab", RENDER_VOCAB_SQL)
def render_chat_vocab(spark, sf_dir):
    """Whole conversations in the ids of a vocabulary of their words, with its own control tokens."""
    turns = fill_turn_defaults(table(spark, sf_dir, "conversations"))
    vocab = vocabulary.extend_vocab(stored(vocabulary.build_vocab(turns), "vocab"), CONTROL_TOKENS)
    ids = vocabulary.tokenizer("vocab", vocab)(turns, "text", name="turn_ids")
    special = vocabulary.special_ids(vocab)
    out = chat.render_turns(ids, "conv_id", "turn", ControlIds(*(special[t] for t in CONTROL_TOKENS)))
    return out.select(
        "conv_id", "turn", "start", joined("input_ids").alias("input_ids"), joined("labels").alias("labels")
    )


NESTED_SQL = f"""WITH {RENDER_SQL}
    SELECT conv_id, CAST(count(*) AS INTEGER) AS n,
        string_agg(id, ' ' ORDER BY p) AS input_ids, string_agg(label, ' ' ORDER BY p) AS labels
    FROM examples GROUP BY conv_id"""


@query("render_chat_nested", NESTED_SQL)
def render_chat_nested(spark, sf_dir):
    """Conversations that hold their messages as an array are rendered inside their rows."""
    message = F.struct("turn", "role", F.col("text").alias("content"))
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(message)).alias("messages"))
    out = chat.render_messages(turns, "conv_id", lambda text: CODEPOINTS.ids(text, None), CONTROL)
    return out.select(
        "conv_id",
        F.size("input_ids").alias("n"),
        joined("input_ids").alias("input_ids"),
        joined("labels").alias("labels"),
    )


def examples(spark, sf_dir):
    return chat.assemble(rendered(spark, sf_dir), "conv_id", SEQ_LEN)


@query(
    "render_chat_truncated",
    f"""WITH {CUT_SQL}
    SELECT conv_id, CAST(len(input_ids) AS INTEGER) AS n, array_to_string(input_ids, ' ') AS input_ids,
        array_to_string(labels, ' ') AS labels FROM cut""",
)
def render_chat_truncated(spark, sf_dir):
    return examples(spark, sf_dir).select(
        "conv_id",
        F.size("input_ids").alias("n"),
        joined("input_ids").alias("input_ids"),
        joined("labels").alias("labels"),
    )


@query(
    "unsupervised_report",
    f"""WITH {CUT_SQL}
    SELECT conv_id, CAST(len(input_ids) AS INTEGER) AS n FROM cut
    WHERE len(list_filter(labels, lambda y: y <> -100)) = 0""",
)
def unsupervised_report(spark, sf_dir):
    return unsupervised(examples(spark, sf_dir)).select("conv_id", F.size("input_ids").alias("n"))


COLLATE_SQL = f"""{CUT_SQL},
    batched AS (
        SELECT *, (row_number() OVER (ORDER BY conv_id) - 1) // {MICRO} AS batch_id FROM cut),
    padded AS (
        SELECT *, max(len(input_ids)) OVER (PARTITION BY batch_id) AS longest FROM batched)"""


def batched(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    return sharding.assign_batches(examples(spark, sf_dir), "conv_id", MICRO, profile=turns)


@query(
    "collate_chat",
    f"""WITH {COLLATE_SQL}
    SELECT batch_id, conv_id, array_to_string(list_resize(input_ids, longest, {PAD}), ' ') AS input_ids,
        array_to_string(list_resize(labels, longest, -100), ' ') AS labels FROM padded""",
)
def collate_chat(spark, sf_dir):
    padded = chat.collate(
        batched(spark, sf_dir), ["batch_id"], {"input_ids": PAD, "labels": -100}
    )
    return padded.select(
        "batch_id", "conv_id", joined("input_ids").alias("input_ids"), joined("labels").alias("labels")
    )


@query(
    "pad_outputs",
    f"""WITH {COLLATE_SQL}
    SELECT batch_id, conv_id, array_to_string(list_resize(input_ids, longest, {PAD}), ' ') AS output_ids
    FROM padded""",
)
def pad_outputs(spark, sf_dir):
    """Ragged outputs of a batch; without a padding id the end token fills."""
    padded = chat.collate(batched(spark, sf_dir), ["batch_id"], {"input_ids": pad_id(None, CONTROL.end)})
    return padded.select("batch_id", "conv_id", joined("input_ids").alias("output_ids"))
