"""Queries over vectors cut into heads, each with parameters of its own from a table."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqloom.functions import vectors as vx
from seqloom.operators import attention
from seqloom.plans import ordered
from seqloom.plans.registry import query, r6, sql_list, sql_r6, table, weight_grid

HEADS, WIDTH = 4, 16
OPERATORS, RANK = 2, 3
#: The parameters of every head.
U = [[weight_grid(WIDTH, RANK, salt=7 * h + o) for o in range(OPERATORS)] for h in range(HEADS)]
V = [[weight_grid(WIDTH, RANK, salt=7 * h + o + 3) for o in range(OPERATORS)] for h in range(HEADS)]
CHOICE = [weight_grid(OPERATORS, WIDTH, salt=h) for h in range(HEADS)]
MIX = [weight_grid(3, WIDTH, salt=h + 2) for h in range(HEADS)]
GATE = [weight_grid(WIDTH, WIDTH, salt=h + 5) for h in range(HEADS)]
WEIGHT = [weight_grid(3, WIDTH, salt=h + 4) for h in range(HEADS)]
BIAS = [[h / 10.0, -0.2, 0.3 * h] for h in range(HEADS)]
BETA = [0.1 + 0.2 * h for h in range(HEADS)]


def parameters(spark, **columns):
    """A row per head; the head is ``head``."""
    schema = "head int, " + ", ".join(f"{n} {kind}" for n, (kind, _) in columns.items())
    rows = [(h, *(values[h] for _, values in columns.values())) for h in range(HEADS)]
    return spark.createDataFrame(rows, schema)


MATRIX, MATRICES = "array<array<double>>", "array<array<array<double>>>"

ROWS_SQL = f"""rows AS (
    SELECT vec_id, head, embedding[head * {WIDTH} + 1 : (head + 1) * {WIDTH}]::DOUBLE[] AS x
    FROM embeddings, (SELECT unnest(range({HEADS})) AS head))"""


def head_rows(spark, sf_dir):
    x = vx.doubles(F.col("embedding"))
    parts = [F.struct(F.lit(h).alias("head"), F.slice(x, h * WIDTH + 1, WIDTH).alias("x")) for h in range(HEADS)]
    return table(spark, sf_dir, "embeddings").select("vec_id", F.inline(F.array(*parts)))


def values_sql(source: str, vector: str = "y") -> str:
    return f"""SELECT vec_id, CAST(head AS INTEGER) AS head, CAST(i AS INTEGER) AS i, {sql_r6('value')} AS value
        FROM (SELECT vec_id, head, unnest({vector}) AS value, unnest(range(len({vector}))) AS i FROM ({source}))"""


def values(df, vector):
    return df.select("vec_id", "head", F.posexplode(vector).alias("i", "value")).withColumn("value", r6(F.col("value")))


def each_head(select) -> str:
    return " UNION ALL ".join(f"SELECT vec_id, head, {select(h)} FROM rows WHERE head = {h}" for h in range(HEADS))


def _columns(matrix):
    return [list(c) for c in zip(*matrix)]


def product_sql(matrix, x: str = "x") -> str:
    return f"list_transform({sql_list(matrix)}, lambda w: list_dot_product(w, {x}))"


def _linear_sql() -> str:
    return f"WITH {ROWS_SQL} " + values_sql(
        each_head(lambda h: f"list_transform({sql_list([[*w, b] for w, b in zip(WEIGHT[h], BIAS[h])])}, "
                            f"lambda w: list_dot_product(w[1:{WIDTH}], x) + w[{WIDTH + 1}]) AS y")
    )


@query("linear_heads", _linear_sql())
def linear_heads(spark, sf_dir):
    own = vx.head_parameters(parameters(spark, weight=(MATRIX, WEIGHT), bias=("array<double>", BIAS)), "head")
    return values(head_rows(spark, sf_dir), vx.linear_heads(F.col("head"), F.col("x"), own))


def _resonance_sql() -> str:
    def low(h: int) -> str:
        parts = [f"list_transform({product_sql(CHOICE[h])}, lambda s: exp(s)) AS g"]
        for o in range(OPERATORS):
            parts.append(f"{product_sql(_columns(V[h][o]))} AS low{o}")
            parts.append(f"{sql_list(U[h][o])} AS up{o}")
        return "x, " + ", ".join(parts)

    terms = " + ".join(f"g[{o + 1}] / list_sum(g) * list_dot_product(up{o}[k], low{o})" for o in range(OPERATORS))
    moved = f"list_transform(x, lambda a, k: a + ({terms}) / sqrt({float(RANK)})) AS y"
    return f"WITH {ROWS_SQL}, low AS ({each_head(low)}) " + values_sql(f"SELECT vec_id, head, {moved} FROM low")


@query("resonance_heads", _resonance_sql())
def resonance_heads(spark, sf_dir):
    own = vx.head_parameters(parameters(spark, u=(MATRICES, U), v=(MATRICES, V), gate=(MATRIX, CHOICE)), "head")
    x = F.col("x")
    return values(head_rows(spark, sf_dir), vx.resonance_heads(F.col("head"), x, x, own)["out"])


def _fuse_sql() -> str:
    parts = each_head(
        lambda h: f"x, list_transform({product_sql(MIX[h])}, lambda s: exp(s)) AS m, {product_sql(GATE[h])} AS g"
    )
    mixed = f"(m[1] * a + m[2] * x[{WIDTH + 1} - k] + m[3] * a * a) / list_sum(m) / (1 + exp(-g[k]))"
    return f"WITH {ROWS_SQL}, p AS ({parts}) " + values_sql(
        f"SELECT vec_id, head, list_transform(x, lambda a, k: {mixed}) AS y FROM p"
    )


@query("fuse_heads", _fuse_sql())
def fuse_heads(spark, sf_dir):
    """Three scales of every head, weighted and gated by the head's own matrices."""
    own = vx.head_parameters(parameters(spark, mix=(MATRIX, MIX), gate=(MATRIX, GATE)), "head")
    x = F.col("x")
    square = F.transform(x, lambda a: a * a)
    return values(head_rows(spark, sf_dir), vx.fuse_heads(F.col("head"), x, F.reverse(x), square, x, own))


ATTENTION_SQL = f"""WITH {ROWS_SQL},
    b AS (SELECT unnest({BETA}) AS beta, unnest(range({HEADS})) AS head),
    placed AS (
        SELECT vec_id // {ordered.SEQ} AS seq_id, vec_id % {ordered.SEQ} AS pos, head, x, beta,
            1 / (1 + exp(-x[1])) AS rho FROM rows JOIN b USING (head)),
    scores AS (
        SELECT q.seq_id, q.head, q.pos, k.x AS v, list_dot_product(q.x, k.x) / sqrt({float(WIDTH)})
            + k.beta * ln(greatest(k.rho, 1e-6)) AS s
        FROM placed q JOIN placed k ON q.seq_id = k.seq_id AND q.head = k.head AND k.pos <= q.pos),
    tops AS (SELECT *, exp(s - max(s) OVER (PARTITION BY seq_id, head, pos)) AS w FROM scores),
    each AS (SELECT seq_id, head, pos, w, unnest(v) AS a, unnest(range({WIDTH})) AS i FROM tops)
    SELECT seq_id, CAST(head AS INTEGER) AS head, pos, CAST(i AS INTEGER) AS i, {sql_r6('sum(w * a) / sum(w)')} AS value
    FROM each GROUP BY seq_id, head, pos, i"""


@query("attention_heads", ATTENTION_SQL)
def attention_heads(spark, sf_dir):
    """Every head attends by itself, with a weight of importance of its own."""
    rows = head_rows(spark, sf_dir).join(parameters(spark, beta=("double", BETA)), "head")
    rows = rows.select(
        F.expr(f"vec_id div {ordered.SEQ}").alias("seq_id"), (F.col("vec_id") % ordered.SEQ).alias("pos"), "head", "x", "beta"
    )
    x = F.col("x")
    out = attention.causal_attention(rows, ["seq_id", "head"], "pos", x, x, x, vx.sigmoid(x[0]), F.col("beta"), max_seq_len=4096)
    each = out.select("seq_id", "head", "pos", F.posexplode("attended").alias("i", "value"))
    return each.withColumn("value", r6(F.col("value")))
