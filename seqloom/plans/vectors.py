"""Queries over vectors, one row at a time: norms, rotations, gates, low-rank maps, lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqloom.functions import vectors as vx
from seqloom.operators import layers
from seqloom.operators.decoding import every_channel
from seqloom.operators.lookup import lookup
from seqloom.operators.sharding import every_n
from seqloom.plans.registry import query, r6, sql_list, sql_r6, table, weight_grid

DIM = 64
THETA = 10000.0
N_LAYERS, ATTENTION_EVERY = 12, 4
OPERATORS, RANK = 2, 2
U = [weight_grid(DIM, RANK, salt=o) for o in range(OPERATORS)]
V = [weight_grid(DIM, RANK, salt=o + 3) for o in range(OPERATORS)]
GATE = weight_grid(OPERATORS, DIM, salt=1)
PROJECTION, BIAS = weight_grid(3, DIM, salt=2), [0.1, -0.2, 0.3]

ROWS_SQL = "rows AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings)"


def channels_sql(expression: str, source: str = "rows") -> str:
    return f"""SELECT vec_id, CAST(i AS INTEGER) AS i, {sql_r6('value')} AS value
        FROM (SELECT vec_id, unnest(y) AS value, unnest(range(len(y))) AS i
              FROM (SELECT vec_id, {expression} AS y FROM {source}))"""


def vectors(spark, sf_dir):
    emb = table(spark, sf_dir, "embeddings")
    return emb.select("vec_id", "label", vx.doubles(F.col("embedding")).alias("x"))


def channels(df, vector):
    rows = every_channel(df.select("vec_id", vector.alias("y")), ["vec_id"], "y")
    return rows.select("vec_id", "i", r6(F.col("value")).alias("value"))


NORM_SQL = "sqrt(list_sum(list_transform(x, lambda a: a * a)))"


@query(
    "rms_norm",
    f"""WITH {ROWS_SQL}, scaled AS (
        SELECT vec_id, x, 1 / sqrt(list_avg(list_transform(x, lambda a: a * a)) + 1e-6) AS f FROM rows)
    {channels_sql('list_transform(x, lambda a, k: a * f * (1 + k / 100.0::DOUBLE))', 'scaled')}""",
)
def rms_norm(spark, sf_dir):
    weight = vx.literal([1 + k / 100.0 for k in range(1, DIM + 1)])
    return channels(vectors(spark, sf_dir), vx.rms_norm(F.col("x"), weight))


@query(
    "l2_normalize",
    f"""WITH {ROWS_SQL}, scaled AS (SELECT vec_id, x, greatest({NORM_SQL}, 1e-12) AS f FROM rows)
    {channels_sql('list_transform(x, lambda a: a / f)', 'scaled')}""",
)
def l2_normalize(spark, sf_dir):
    return channels(vectors(spark, sf_dir), vx.l2_normalize(F.col("x")))


@query(
    "rotary",
    f"""WITH {ROWS_SQL}, pairs AS (
        SELECT vec_id, k, x[2 * k + 1] AS a, x[2 * k + 2] AS b,
            (vec_id % 25) * pow({THETA}, -2.0 * k / {DIM}) AS t FROM rows, range({DIM // 2}) AS r(k)),
    turned AS (
        SELECT vec_id, 2 * k AS i, a * cos(t) - b * sin(t) AS value FROM pairs UNION ALL
        SELECT vec_id, 2 * k + 1, a * sin(t) + b * cos(t) FROM pairs)
    SELECT vec_id, CAST(i AS INTEGER) AS i, {sql_r6('value')} AS value FROM turned""",
)
def rotary(spark, sf_dir):
    return channels(vectors(spark, sf_dir), vx.rotary(F.col("x"), F.col("vec_id") % 25, DIM, THETA))


@query(
    "linear",
    f"""WITH {ROWS_SQL}
    {channels_sql(f"list_transform({sql_list([[*w, b] for w, b in zip(PROJECTION, BIAS)])}, "
                  f"lambda w: list_dot_product(w[1:{DIM}], x) + w[{DIM + 1}])")}""",
)
def linear(spark, sf_dir):
    return channels(vectors(spark, sf_dir), vx.linear(F.col("x"), PROJECTION, BIAS))


@query(
    "softmax_gate",
    f"""WITH {ROWS_SQL}, e AS (
        SELECT vec_id, list_transform(x, lambda a: exp(a - list_max(x))) AS x FROM rows)
    {channels_sql('list_transform(x, lambda a: a / list_sum(x))', 'e')}""",
)
def softmax_gate(spark, sf_dir):
    return channels(vectors(spark, sf_dir), vx.softmax(F.col("x")))


@query(
    "bounded_gates",
    f"""WITH {ROWS_SQL}, every AS (SELECT vec_id, unnest(x) AS a, unnest(range(len(x))) AS i FROM rows)
    SELECT vec_id, CAST(i AS INTEGER) AS i, {sql_r6('0.9 + 0.0999 / (1 + exp(-a))')} AS decay,
        {sql_r6('1 / (1 + exp(-a))')} AS erase,
        {sql_r6('CASE WHEN a > 0 THEN a + 1 ELSE exp(a) END')} AS phi,
        {sql_r6('0.1 * ln(greatest(a, 1e-6))')} AS bias FROM every""",
)
def bounded_gates(spark, sf_dir):
    """Every gate on every value of every vector."""
    each = vectors(spark, sf_dir).select("vec_id", F.posexplode("x").alias("i", "a"))
    return each.select(
        "vec_id",
        "i",
        r6(vx.bounded_gate(F.col("a"), 0.9, 0.9999)).alias("decay"),
        r6(vx.sigmoid(F.col("a"))).alias("erase"),
        r6(vx.elu1(F.col("a"))).alias("phi"),
        r6(vx.importance_bias(F.col("a"), 0.1)).alias("bias"),
    )


FUSE_SQL = """list_transform(x, lambda a, k:
    (m[1] * a + m[2] * x[65 - k] + m[3] * a * a) / (m[1] + m[2] + m[3]) / (1 + exp(-a)))"""


@query(
    "fuse_three_scales",
    f"""WITH {ROWS_SQL}, mixed AS (
        SELECT vec_id, x, list_transform(x[1:3], lambda a: exp(a)) AS m FROM rows)
    {channels_sql(FUSE_SQL, 'mixed')}""",
)
def fuse_three_scales(spark, sf_dir):
    square = F.transform(F.col("x"), lambda a: a * a)
    fused = vx.fuse_scales(F.col("x"), F.reverse(F.col("x")), square, F.slice(F.col("x"), 1, 3), F.col("x"))
    return channels(vectors(spark, sf_dir), fused)


def _columns(matrix):
    return [list(c) for c in zip(*matrix)]


def _resonance_sql() -> str:
    """One term per operator and rank: gate, times V-column against x, times U-column."""
    terms, scores = [], []
    for o in range(OPERATORS):
        scores.append(f"exp(list_dot_product({sql_list(GATE[o])}, x)) AS g{o}")
        for r in range(RANK):
            scores.append(f"list_dot_product({sql_list(_columns(V[o])[r])}, x) AS low{o}{r}")
            terms.append(f"g{o} / ({' + '.join(f'g{p}' for p in range(OPERATORS))}) * low{o}{r} * u{o}{r}[k]")
    ups = [f"{sql_list(_columns(U[o])[r])} AS u{o}{r}" for o in range(OPERATORS) for r in range(RANK)]
    delta = f"list_transform(x, lambda a, k: ({' + '.join(terms)}) / sqrt({float(RANK)}))"
    return f"""{ROWS_SQL}, low AS (SELECT *, {', '.join(scores + ups)} FROM rows),
    deltas AS (SELECT vec_id, label, x, {delta} AS d FROM low),
    moved AS (
        SELECT vec_id, label, d, list_transform(x, lambda a, k: a + d[k]) AS x FROM deltas)"""


RESONANCE_SQL = _resonance_sql()


def resonated(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    return rows.withColumn("r", vx.resonance(F.col("x"), F.col("x"), U, V, GATE))


@query("resonance", f"WITH {RESONANCE_SQL} {channels_sql('x', 'moved')}")
def resonance(spark, sf_dir):
    return channels(resonated(spark, sf_dir), F.col("r.out"))


@query(
    "delta_ratio",
    f"""WITH {RESONANCE_SQL}
    SELECT label, {sql_r6(f"avg({NORM_SQL.replace('x', 'd', 1)}) / greatest(avg({NORM_SQL}), 1e-8)")} AS delta_ratio
    FROM moved GROUP BY label""",
)
def delta_ratio(spark, sf_dir):
    rows = resonated(spark, sf_dir).select("label", F.col("r.delta").alias("d"), F.col("r.out").alias("o"))
    return layers.delta_ratio(rows, ["label"], "d", "o").withColumn("delta_ratio", r6(F.col("delta_ratio")))


LAYERS_SQL = (
    f"SELECT vec_id // {N_LAYERS} AS seq_id, vec_id % {N_LAYERS} AS layer, "
    "1 / (1 + exp(-embedding[1]::DOUBLE)) AS rho FROM embeddings"
)


def layer_rows(spark, sf_dir):
    return vectors(spark, sf_dir).select(
        F.expr(f"vec_id div {N_LAYERS}").alias("seq_id"),
        (F.col("vec_id") % N_LAYERS).alias("layer"),
        vx.sigmoid(F.col("x")[0]).alias("rho"),
    )


@query(
    "layer_schedule",
    f"SELECT seq_id, layer, (layer + 1) % {ATTENTION_EVERY} = 0 AS attends FROM ({LAYERS_SQL})",
)
def layer_schedule(spark, sf_dir):
    rows = layer_rows(spark, sf_dir)
    return rows.select("seq_id", "layer", every_n(F.col("layer"), ATTENTION_EVERY).alias("attends"))


@query(
    "importance_mean",
    f"""WITH l AS ({LAYERS_SQL})
    SELECT a.seq_id, a.layer AS attention_layer, {sql_r6('avg(r.rho)')} AS importance, count(*) AS layers
    FROM l a JOIN l r ON a.seq_id = r.seq_id AND r.layer < a.layer AND r.layer > a.layer - {ATTENTION_EVERY}
    WHERE (a.layer + 1) % {ATTENTION_EVERY} = 0 GROUP BY a.seq_id, a.layer""",
)
def importance_mean(spark, sf_dir):
    means = layers.importance_mean(
        layer_rows(spark, sf_dir), ["seq_id"], "layer", F.col("rho"), ATTENTION_EVERY
    )
    return means.withColumn("importance", r6(F.col("importance")))


@query(
    "embedding_lookup",
    f"""WITH asked AS (
        SELECT event_id, user_id FROM events
        UNION ALL SELECT -1 - i, CASE WHEN i > 0 THEN -i END FROM (SELECT unnest(range(3)) AS i))
    SELECT event_id, user_id, coalesce(CAST(len(embedding) AS INTEGER), -1) AS dim,
        {sql_r6('list_sum(list_transform(embedding, lambda a, k: a::DOUBLE * k))')} AS weighted
    FROM asked LEFT JOIN embeddings ON user_id = vec_id""",
)
def embedding_lookup(spark, sf_dir):
    """Every value counts, by its place; some more ids are unknown or null and keep their rows."""
    more = spark.range(3).select((-1 - F.col("id")).alias("event_id"), F.when(F.col("id") > 0, -F.col("id")).alias("user_id"))
    ids = table(spark, sf_dir, "events").select("event_id", "user_id").unionByName(more)
    found = lookup(ids, "user_id", vectors(spark, sf_dir), "vec_id", missing="null")
    total = F.aggregate(F.transform("x", lambda a, i: a * (i + 1)), F.lit(0.0), lambda acc, a: acc + a)
    return found.select("event_id", "user_id", F.coalesce(F.size("x"), F.lit(-1)).alias("dim"), r6(total).alias("weighted"))
