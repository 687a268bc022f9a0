"""Queries over ordered rows: memories, filters, attention, and the checks on them."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqloom.functions import vectors as vx
from seqloom.functions.kernels import CausalFir, FastMemory, SlowMemory
from seqloom.operators import attention, evaluation, ordered
from seqloom.operators.decoding import every_channel
from seqloom.operators.numbering import ROWS_PER_CHUNK
from seqloom.plans.registry import query, r6, sql_list, sql_r6, table, weight_grid
from seqloom.session import stored

DIM = 64
SEQ = 25
EPS = 1e-6
BETA = 0.1
FIR = [0.1, -0.2, 0.3, 0.25, 0.5]
FIR_BIAS = 0.05
FIR_GRID, FIR_GRID_BIAS = weight_grid(5, DIM), weight_grid(1, DIM, salt=4)[0]


# phi of the centred value, so that both branches occur.
PHI_SQL = "CASE WHEN value > 100 THEN value - 99 ELSE exp(value - 100) END"


def memory_sql(value: str = "value", phi: str = PHI_SQL, key: str = "user_id") -> str:
    w = f"OVER (PARTITION BY {key} ORDER BY event_id)"
    return f"sum(({phi}) * {value}) {w} / greatest(sum({phi}) {w}, {EPS})"


def events(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")


def memory_of(df, keys=("user_id",), **options):
    return ordered.slow_memory(df, list(keys), "event_id", F.col("value") - 100.0, F.col("value"), eps=EPS, **options)


@query(
    "slow_memory_events",
    f"SELECT user_id, event_id, {sql_r6(memory_sql())} AS memory FROM events",
)
def slow_memory_events(spark, sf_dir):
    return memory_of(events(spark, sf_dir)).select("user_id", "event_id", r6(F.col("memory")).alias("memory"))


def chunk_rows(rows) -> int:
    """The operators' own limit, or less on a small table, so that its few keys are cut into chunks too (about 40 in all)."""
    return min(ROWS_PER_CHUNK, max(20, rows.count() // 40))


@query(
    "slow_memory_by_type",
    f"SELECT event_type, event_id, {sql_r6(memory_sql(key='event_type'))} AS memory FROM events",
)
def slow_memory_by_type(spark, sf_dir):
    """Five keys share all rows: each is summed in ordered chunks."""
    rows = events(spark, sf_dir)
    found = memory_of(rows, ["event_type"], rows_per_chunk=chunk_rows(rows))
    return found.select("event_type", "event_id", r6(F.col("memory")).alias("memory"))


def fir_sql(key: str) -> str:
    terms = [f"{w}::DOUBLE * coalesce(lag(value, {len(FIR) - 1 - j}) OVER w, 0)" for j, w in enumerate(FIR)]
    return f"""SELECT {key}, event_id, {sql_r6(f"{FIR_BIAS}::DOUBLE + " + " + ".join(terms))} AS fir
    FROM events WINDOW w AS (PARTITION BY {key} ORDER BY event_id)"""


@query("causal_fir", fir_sql("user_id"))
def causal_fir(spark, sf_dir):
    out = ordered.causal_fir(events(spark, sf_dir), ["user_id"], "event_id", F.col("value"), FIR, FIR_BIAS)
    return out.select("user_id", "event_id", r6(F.col("fir")).alias("fir"))


@query("causal_fir_by_type", fir_sql("event_type"))
def causal_fir_by_type(spark, sf_dir):
    rows = events(spark, sf_dir)
    out = ordered.causal_fir(
        rows, ["event_type"], "event_id", F.col("value"), FIR, FIR_BIAS, rows_per_chunk=chunk_rows(rows)
    )
    return out.select("event_type", "event_id", r6(F.col("fir")).alias("fir"))


@query(
    "eos_fill",
    """SELECT user_id, event_id, CASE WHEN coalesce(max(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END)
        OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1
        THEN 'error' ELSE event_type END AS filled FROM events""",
)
def eos_fill(spark, sf_dir):
    out = ordered.eos_fill(events(spark, sf_dir), ["user_id"], "event_id", "event_type", F.lit("error"))
    return out.select("user_id", "event_id", "filled")


SEQ_SQL = (
    f"rows AS (SELECT vec_id // {SEQ} AS seq_id, vec_id % {SEQ} AS pos, embedding::DOUBLE[] AS x "
    "FROM embeddings)"
)
CHANNEL_SQL = f"""{SEQ_SQL}, channels AS (
    SELECT seq_id, pos, x, unnest(x) AS v, unnest(range({DIM})) AS i FROM rows)"""


def sequences(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(
        F.expr(f"vec_id div {SEQ}").alias("seq_id"),
        (F.col("vec_id") % SEQ).alias("pos"),
        F.col("embedding").alias("x"),
    )


def channels(df, vector):
    rows = every_channel(df, ["seq_id", "pos"], vector)
    return rows.select("seq_id", "pos", "i", r6(F.col("value")).alias("value"))


SLOW_EMBEDDINGS_SQL = f"""WITH {CHANNEL_SQL},
    phis AS (SELECT *, CASE WHEN v > 0 THEN v + 1 ELSE exp(v) END AS phi FROM channels)
    SELECT seq_id, pos, CAST(i AS INTEGER) AS i,
        {sql_r6(f'sum(phi * v) OVER w / greatest(sum(phi) OVER w, {EPS})')} AS value
    FROM phis WINDOW w AS (PARTITION BY seq_id, i ORDER BY pos)"""


@query("slow_memory_embeddings", SLOW_EMBEDDINGS_SQL)
def slow_memory_embeddings(spark, sf_dir):
    kernel = SlowMemory(DIM, EPS)
    out = ordered.scan(sequences(spark, sf_dir), ["seq_id"], "pos", kernel, {"q": "x", "v": "x"})
    return channels(out, "out")


FIR_EMBEDDINGS_SQL = f"""WITH {CHANNEL_SQL}
    SELECT seq_id, pos, CAST(i AS INTEGER) AS i, {sql_r6(
        f"({sql_list(FIR_GRID_BIAS)})[i + 1] + " + " + ".join(
            f"({sql_list(w)})[i + 1] * coalesce(lag(v, {len(FIR_GRID) - 1 - j}) OVER w, 0)"
            for j, w in enumerate(FIR_GRID)))} AS value
    FROM channels WINDOW w AS (PARTITION BY seq_id, i ORDER BY pos)"""


@query("causal_fir_embeddings", FIR_EMBEDDINGS_SQL)
def causal_fir_embeddings(spark, sf_dir):
    kernel = CausalFir(FIR_GRID, FIR_GRID_BIAS)
    out = ordered.scan(sequences(spark, sf_dir), ["seq_id"], "pos", kernel, {"x": "x"})
    return channels(out, "out")


# Rank one: the key is the sign of the centred value, so the state is one number per user.
def fast_events_sql(key: str) -> str:
    return f"""WITH RECURSIVE base AS (
        SELECT {key}, event_id, row_number() OVER (PARTITION BY {key} ORDER BY event_id) AS n,
            value / 100 AS v, (CASE WHEN value >= 100 THEN 1 ELSE -1 END)::DOUBLE AS k,
            0.9 + 0.0999 / (1 + exp(-(value / 100 - 1))) AS g, 1 / (1 + exp(-value / 200)) AS e,
            1 / (1 + exp(value / 300)) AS w FROM events),
    steps AS (
        SELECT {key}, event_id, n, w * k * v AS s FROM base WHERE n = 1 UNION ALL
        SELECT b.{key}, b.event_id, b.n, (b.g - b.e) * p.s + b.w * b.k * b.v
        FROM steps p JOIN base b ON b.{key} = p.{key} AND b.n = p.n + 1)
    SELECT {key}, event_id, {sql_r6('s')} AS memory FROM steps"""


def gated_events(spark, sf_dir):
    return events(spark, sf_dir).select(
        "event_id",
        "user_id",
        "event_type",
        F.array(F.col("value") - 100.0).alias("q"),
        F.array(F.when(F.col("value") >= 100.0, 1.0).otherwise(-1.0)).alias("k"),
        F.array(F.lit(1.0)).alias("one"),
        F.array(F.col("value") / 100.0).alias("v"),
        F.array(F.col("value")).alias("raw"),
        vx.bounded_gate(F.col("value") / 100.0 - 1.0, 0.9, 0.9999).alias("decay"),
        vx.sigmoid(F.col("value") / 200.0).alias("erase"),
        vx.sigmoid(-F.col("value") / 300.0).alias("write"),
    )


FAST_R1_INPUTS = {"k": "k", "q": "one", "v": "v", "decay": "decay", "erase": "erase", "write": "write"}
@query("fast_memory_r1", fast_events_sql("user_id"))
def fast_memory_r1(spark, sf_dir):
    rows = gated_events(spark, sf_dir)
    out = ordered.scan(rows, ["user_id"], "event_id", FastMemory(1, 1), FAST_R1_INPUTS)
    return out.select("user_id", "event_id", r6(F.col("out")[0]).alias("memory"))


@query("fast_memory_by_type", fast_events_sql("event_type"))
def fast_memory_by_type(spark, sf_dir):
    """Long keys: each chunk becomes one affine map, the maps are composed, the chunks replayed."""
    rows = gated_events(spark, sf_dir)
    out = ordered.scan(
        rows, ["event_type"], "event_id", FastMemory(1, 1), FAST_R1_INPUTS, rows_per_chunk=chunk_rows(rows)
    )
    return out.select("event_type", "event_id", r6(F.col("out")[0]).alias("memory"))


# Rank two on vectors; the oracle follows every channel by itself.
FAST_SQL = f"""WITH RECURSIVE {SEQ_SQL},
    units AS (
        SELECT *, greatest(sqrt(x[1] * x[1] + x[2] * x[2]), 1e-12) AS kn,
            greatest(sqrt(x[3] * x[3] + x[4] * x[4]), 1e-12) AS qn FROM rows),
    base AS (
        SELECT seq_id, pos, unnest(x) AS v, unnest(range({DIM})) AS i, x[1] / kn AS k0, x[2] / kn AS k1,
            x[3] / qn AS q0, x[4] / qn AS q1, 0.9 + 0.0999 / (1 + exp(-x[5])) AS g,
            1 / (1 + exp(-x[6])) AS e, 1 / (1 + exp(-x[7])) AS w FROM units),
    steps AS (
        SELECT seq_id, pos, i, q0, q1, w * k0 * v AS s0, w * k1 * v AS s1 FROM base WHERE pos = 0 UNION ALL
        SELECT b.seq_id, b.pos, b.i, b.q0, b.q1,
            b.g * p.s0 - b.e * b.k0 * (b.k0 * p.s0 + b.k1 * p.s1) + b.w * b.k0 * b.v,
            b.g * p.s1 - b.e * b.k1 * (b.k0 * p.s0 + b.k1 * p.s1) + b.w * b.k1 * b.v
        FROM steps p JOIN base b ON b.seq_id = p.seq_id AND b.i = p.i AND b.pos = p.pos + 1)
    SELECT seq_id, pos, CAST(i AS INTEGER) AS i, {sql_r6('q0 * s0 + q1 * s1')} AS value FROM steps"""

FAST_INPUTS = {"k": "k", "q": "q", "v": "x", "decay": "decay", "erase": "erase", "write": "write"}


def gated_sequences(spark, sf_dir):
    return sequences(spark, sf_dir).select(
        "seq_id",
        "pos",
        "x",
        F.slice("x", 1, 2).alias("k"),
        F.slice("x", 3, 2).alias("q"),
        vx.bounded_gate(F.col("x")[4], 0.9, 0.9999).alias("decay"),
        vx.sigmoid(F.col("x")[5]).alias("erase"),
        vx.sigmoid(F.col("x")[6]).alias("write"),
    )


@query("fast_memory", FAST_SQL)
def fast_memory(spark, sf_dir):
    rows = gated_sequences(spark, sf_dir)
    out = ordered.scan(rows, ["seq_id"], "pos", FastMemory(2, DIM), FAST_INPUTS)
    return channels(out, "out")


ATTENTION_SQL = f"""WITH {SEQ_SQL},
    rho AS (SELECT *, 1 / (1 + exp(-x[1])) AS rho FROM rows),
    scores AS (
        SELECT q.seq_id, q.pos, k.x AS v,
            list_dot_product(q.x, k.x) / sqrt({float(DIM)}) + {BETA} * ln(greatest(k.rho, 1e-6)) AS s
        FROM rho q JOIN rho k ON q.seq_id = k.seq_id AND k.pos <= q.pos),
    weights AS (
        SELECT seq_id, pos, v, exp(s - max(s) OVER (PARTITION BY seq_id, pos)) AS w FROM scores),
    each AS (SELECT seq_id, pos, w, unnest(v) AS v, unnest(range({DIM})) AS i FROM weights)
    SELECT seq_id, pos, CAST(i AS INTEGER) AS i, {sql_r6('sum(w * v) / sum(w)')} AS value
    FROM each GROUP BY seq_id, pos, i"""


@query("causal_attention", ATTENTION_SQL)
def causal_attention(spark, sf_dir):
    rows = sequences(spark, sf_dir)
    out = attention.causal_attention(
        rows, ["seq_id"], "pos", F.col("x"), F.col("x"), F.col("x"), rho=vx.sigmoid(F.col("x")[0]), beta=BETA, max_seq_len=4096
    )
    return channels(out, "attended")


# Every other importance is missing and counts in full; without any there is no bias at all.
PARTIAL_SQL = ATTENTION_SQL.replace("1 / (1 + exp(-x[1])) AS rho", "CASE WHEN pos % 2 = 0 THEN 1 / (1 + exp(-x[1])) ELSE 1 END AS rho")
UNIFORM_SQL = ATTENTION_SQL.replace("1 / (1 + exp(-x[1])) AS rho", "1.0::DOUBLE AS rho")


def attended(spark, sf_dir, rho):
    x = F.col("x")
    rows = sequences(spark, sf_dir)
    return channels(attention.causal_attention(rows, ["seq_id"], "pos", x, x, x, rho=rho, beta=BETA), "attended")


@query("attention_partial_importance", PARTIAL_SQL)
def attention_partial_importance(spark, sf_dir):
    return attended(spark, sf_dir, F.when(F.col("pos") % 2 == 0, vx.sigmoid(F.col("x")[0])))


@query("attention_without_importance", UNIFORM_SQL)
def attention_without_importance(spark, sf_dir):
    return attended(spark, sf_dir, None)


PLANTED_SQL = f"""WITH a AS (SELECT event_id, {memory_sql()} AS m FROM events),
    ends AS (SELECT min(event_id) AS low, max(event_id) AS high FROM events),
    b AS (
        SELECT event_id, m + CASE WHEN event_id = high THEN 0.25 ELSE 0 END AS m FROM a, ends WHERE event_id > low
        UNION ALL SELECT -1, 0)
    SELECT count(a.m) FILTER (b.event_id IS NOT NULL) AS matched, count(*) FILTER (b.event_id IS NULL) AS only_left,
        count(*) FILTER (a.event_id IS NULL) AS only_right, {sql_r6('max(abs(a.m - b.m))')} AS max_abs_diff,
        {sql_r6('avg(abs(a.m - b.m)) * 1000')} AS mean_abs_diff_milli
    FROM a FULL JOIN b ON a.event_id = b.event_id"""


@query("parity_planted", PLANTED_SQL)
def parity_planted(spark, sf_dir):
    """A row that differs, one that is missing and one too many are found; ranges of rows without any are never joined."""
    a = stored(memory_of(events(spark, sf_dir)).select("event_id", "memory"), "memory")
    low, high = a.agg(F.min("event_id"), F.max("event_id")).first()
    moved = F.when(F.col("event_id") == high, F.col("memory") + 0.25).otherwise(F.col("memory"))
    b = a.where(F.col("event_id") > low).withColumn("memory", moved)
    b = b.unionByName(spark.range(1).select(F.lit(-1).cast("long").alias("event_id"), F.lit(0.0).alias("memory")))
    report = evaluation.parity_by_ranges(a, b, ["event_id"], "memory")
    return report.select(
        "matched",
        "only_left",
        "only_right",
        r6(F.col("max_abs_diff")).alias("max_abs_diff"),
        r6(F.col("mean_abs_diff") * 1000.0).alias("mean_abs_diff_milli"),
    )


@query(
    "parity_report",
    f"""WITH a AS (SELECT event_id, {memory_sql()} AS m FROM events),
    b AS (SELECT event_id, {memory_sql('value::FLOAT::DOUBLE')} AS m FROM events)
    SELECT count(*) AS matched, CAST(0 AS BIGINT) AS only_left, CAST(0 AS BIGINT) AS only_right,
        {sql_r6('max(abs(a.m - b.m)) * 1000')} AS max_abs_diff_milli,
        {sql_r6('avg(abs(a.m - b.m)) * 1000')} AS mean_abs_diff_milli
    FROM a JOIN b USING (event_id)""",
)
def parity_report(spark, sf_dir):
    """What single precision inputs cost the cumulative memory."""
    full = events(spark, sf_dir)
    single = F.col("value").cast("float").cast("double")
    narrow = ordered.slow_memory(full, ["user_id"], "event_id", F.col("value") - 100.0, single, eps=EPS)
    report = evaluation.parity(memory_of(full), narrow, ["event_id"], "memory")
    return report.select(
        "matched",
        "only_left",
        "only_right",
        r6(F.col("max_abs_diff") * 1000.0).alias("max_abs_diff_milli"),
        r6(F.col("mean_abs_diff") * 1000.0).alias("mean_abs_diff_milli"),
    )


@query(
    "leakage_check",
    f"""WITH changed AS (
        SELECT user_id, event_id, CASE WHEN event_id <= (SELECT max(event_id) // 2 FROM events)
            THEN value ELSE value * 2 + 1 END AS value FROM events),
    a AS (SELECT event_id, {memory_sql()} AS m FROM events),
    b AS (SELECT event_id, {memory_sql()} AS m FROM changed)
    SELECT count(*) AS matched, CAST(0 AS BIGINT) AS only_left, CAST(0 AS BIGINT) AS only_right,
        max(abs(a.m - b.m)) AS max_abs_diff, avg(abs(a.m - b.m)) AS mean_abs_diff
    FROM a JOIN b USING (event_id) WHERE event_id <= (SELECT max(event_id) // 2 FROM events)""",
)
def leakage_check(spark, sf_dir):
    """The second half of the events changes; the results on the first half must not."""
    rows = events(spark, sf_dir)
    half = rows.agg(F.expr("max(event_id) div 2")).first()[0]
    kept = F.col("event_id") <= half
    changed = rows.withColumn("value", F.when(kept, F.col("value")).otherwise(F.col("value") * 2 + 1))
    return evaluation.leakage(memory_of, rows, changed, kept, ["event_id"], "memory")


@query(
    "chunk_parity",
    f"""WITH a AS (SELECT event_id, {memory_sql(key='event_type')} AS m FROM events),
    b AS (SELECT event_id, sum(({PHI_SQL}) * value) OVER w / greatest(sum({PHI_SQL}) OVER w, {EPS}) AS m
        FROM events WINDOW w AS (PARTITION BY event_type ORDER BY event_id ROWS UNBOUNDED PRECEDING))
    SELECT count(*) AS matched, CAST(0 AS BIGINT) AS only_left, CAST(0 AS BIGINT) AS only_right,
        max(abs(a.m - b.m)) < 1e-9 AS same FROM a JOIN b USING (event_id)""",
)
def chunk_parity(spark, sf_dir):
    """Whole keys against keys cut into chunks with carried sums."""
    rows = events(spark, sf_dir)
    whole = memory_of(rows, ["event_type"])
    cut = memory_of(rows, ["event_type"], rows_per_chunk=chunk_rows(rows))
    report = evaluation.parity(whole, cut, ["event_id"], "memory")
    return report.select("matched", "only_left", "only_right", (F.col("max_abs_diff") < 1e-9).alias("same"))
