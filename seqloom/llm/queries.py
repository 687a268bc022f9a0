"""The registered queries of this subpackage: each operator over its whole table, and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from seqloom.llm import decontamination, hard_negatives, licenses, mixing, near_duplicates, pii, quality, repeats, sharding, spelling, token_store, toxicity, url_filter
from seqloom.llm.registry import query
from seqloom.llm.text import word_count
from seqloom.plans.registry import table

WORDS_SQL = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"

# ---------------------------------------------------------------------------------------------- op1

HOST_RULES = [
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
]
PATTERN_RULES = [
    ("block", "^casino^"),
    ("block", "^porn^"),
    ("block", "^xxx^"),
    ("block", "^login^"),
    ("block", "^ads^"),
    ("block", "://m.*^page=*^ref=x"),
    ("block", "://m.*^utm_source=feed^"),
    ("block", "^es/9*.html^"),
    ("allow", "://blog.*^en/1*^"),
    ("allow", "^robots.txt^"),
]


def _url_sql() -> str:
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')".format
    fit = "(host = '{0}' OR host LIKE '%.{0}') AND starts_with(path, '{1}')".format
    longest = sorted(HOST_RULES, key=lambda r: -len(r[1] + r[2]))
    rule = "CASE " + " ".join(f"WHEN {fit(h, p)} THEN '{h}{p}'" for _, h, p in longest) + " END"
    verdict = "CASE rule " + " ".join(f"WHEN '{h}{p}' THEN '{a}'" for a, h, p in longest) + " END"
    ordered = sorted(PATTERN_RULES, key=lambda r: r[0] != "allow")
    pattern = "CASE " + " ".join(
        f"WHEN regexp_matches(low, '{url_filter.pattern_regex(p)}', 's') THEN '{p}'" for _, p in ordered
    )
    action = "CASE pattern " + " ".join(f"WHEN '{p}' THEN '{a}'" for a, p in ordered) + " ELSE 'allow' END"
    return rf"""
    WITH parts AS (
      SELECT page_id, {lower("url")} AS low,
        {lower("regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's')")} AS host,
        regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path
      FROM pages),
    ruled AS (SELECT *, {rule} AS rule FROM parts),
    matched AS (SELECT *, CASE WHEN rule IS NULL THEN {pattern} END END AS pattern FROM ruled)
    SELECT page_id, host, path, rule, pattern, coalesce({verdict}, {action}) AS verdict FROM matched
    """


@query("op1_url_filter", _url_sql())
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge(pages, "url", HOST_RULES, PATTERN_RULES).drop("url")


# ---------------------------------------------------------------------------------------------- op2

# Shingles that two documents share are joined, counted per pair, and linked pairs closed transitively.
_NEAR_SQL = rf"""
WITH RECURSIVE
w AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ 	-
]+') AS words
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(words[i:i+4], ' ') AS shingle
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 3, 2))) AS i FROM w WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
classes AS (
  SELECT n.doc_id, min(n.doc_id) OVER (PARTITION BY k) AS class
  FROM n JOIN (SELECT doc_id, md5(string_agg(shingle, chr(10) ORDER BY shingle)) AS k FROM s GROUP BY doc_id) USING (doc_id)),
reps AS MATERIALIZED (SELECT s.* FROM s JOIN classes USING (doc_id) WHERE doc_id = class),
links AS MATERIALIZED (
  SELECT a.doc_id AS a, b.doc_id AS b
  FROM reps a JOIN reps b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id
  HAVING 100 * count(*) >= 75 * ((SELECT n FROM n WHERE n.doc_id = a.doc_id) + (SELECT n FROM n WHERE n.doc_id = b.doc_id) - count(*))),
reach(a, b) AS (
  SELECT doc_id, doc_id FROM classes WHERE doc_id = class
  UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(least.component_id, d.doc_id) AS component_id,
  coalesce(least.component_id, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN classes USING (doc_id) LEFT JOIN least ON least.a = classes.class
"""


@query("op2_near_duplicates", _NEAR_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return near_duplicates.near_duplicates(docs, "doc_id", "text").drop("group", "text_a", "text_b")


# ---------------------------------------------------------------------------------------------- op3


@query("op3_toxicity")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    docs = docs.select("doc_id", "text", "lang")
    return toxicity.score(docs, labels, "doc_id", "text", "lang", "toxic").drop("text")


# ---------------------------------------------------------------------------------------------- op4


@query("op4_token_store")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    manifest = token_store.write_tokens(docs, "doc_id", "text", public_tokenizers.path("byte_bpe_50k.json"))
    return token_store.read_tokens(manifest)


# ---------------------------------------------------------------------------------------------- op5


def _quality_sql() -> str:
    rules, alpha = len(quality.RULES), quality.ALPHA / len(quality.RULES)
    share = {r: f"CASE WHEN {b} > 0 THEN {a}::DOUBLE / {b} ELSE 0 END" for r, (a, b) in quality.RULES.items()}
    shares = " UNION ALL ".join(f"SELECT stratum, good, '{r}' AS rule, {x} AS share FROM held" for r, x in share.items())
    # The most lenient of equally good cutoffs is the largest.
    cut = ", ".join(f"max(cutoff) FILTER (rule = '{r}') AS {r}_cut" for r in share)
    broken = ", ".join(f"CASE WHEN {x} > {r}_cut THEN '{r}' END" for r, x in share.items())
    gone = "length({0}) - length(translate({0}, '{1}', ''))".format
    spaces = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return rf"""
    WITH t AS (
      SELECT doc_id, lang AS stratum, coalesce(text, '') AS t,
        regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
        list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: length(translate(x, {spaces}, '')) > 0) AS l
      FROM documents),
    windows AS (
      SELECT doc_id, i, w[i] || ' ' || w[i+1] || ' ' || w[i+2] AS g
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM t WHERE len(w) > 2)),
    again AS (SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
    covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i+1, i+2]) AS p FROM again) GROUP BY doc_id),
    f AS (
      SELECT doc_id, stratum, len(w)::BIGINT AS n_words, length(translate(t, {spaces}, ''))::BIGINT AS word_chars,
        ({gone("t", quality.SYMBOLS)})::BIGINT AS n_symbols, ({gone("t", quality.CAPITALS)})::BIGINT AS n_capitals,
        len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
        coalesce(n, 0)::BIGINT AS n_repeat_words
      FROM t LEFT JOIN covered USING (doc_id)),
    b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f),
    held AS (SELECT b.*, quality AS good FROM b JOIN labels USING (doc_id) WHERE NOT base_failed AND quality IN (0, 1)),
    shares AS ({shares}),
    counts AS (
      SELECT stratum, rule, cutoff, sum(good)::BIGINT AS n,
        coalesce(sum(good) FILTER (share > cutoff), 0)::BIGINT AS k, count(*) FILTER (share > cutoff AND good = 0) AS bad
      FROM shares, (SELECT unnest({list(quality.CUTOFFS)!r})::DOUBLE AS cutoff) GROUP BY ALL),
    tested AS (
      SELECT *, CASE WHEN k >= n * {alpha!r} THEN 1 ELSE list_sum(list_transform(range(0, k + 1), lambda i: exp(
        lgamma(n + 1) - CASE WHEN i = 0 THEN 0 ELSE lgamma(i + 1) END - lgamma(n - i + 1)
        + i * ln({alpha!r}::DOUBLE) + (n - i) * ln({1 - alpha!r}::DOUBLE)))) END AS p
      FROM counts),
    chosen AS (
      SELECT stratum, rule, cutoff FROM tested
      WHERE bad > 0 AND p <= {quality.DELTA / rules!r}::DOUBLE / (SELECT count(*) FROM (SELECT DISTINCT stratum FROM held))
      QUALIFY row_number() OVER (PARTITION BY stratum, rule ORDER BY bad DESC, k, cutoff DESC) = 1),
    cuts AS (SELECT stratum, {cut} FROM chosen GROUP BY stratum),
    judged AS (
      SELECT b.*, CASE WHEN base_failed THEN 'base' ELSE array_to_string(list_filter([{broken}], lambda x: x IS NOT NULL), ',') END AS rejected_by
      FROM b LEFT JOIN cuts ON b.stratum IS NOT DISTINCT FROM cuts.stratum)
    SELECT *, rejected_by = '' AS kept FROM judged
    """


@query("op5_quality_rules", _quality_sql())
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return quality.judge(docs, "doc_id", "text", "lang", labels, "quality")


# ---------------------------------------------------------------------------------------------- op6


@query("op6_decontamination")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return decontamination.contaminated(docs.select("doc_id", "text"), "text", items, "item_id", "text").drop("text")


# ---------------------------------------------------------------------------------------------- op7


@query("op7_repeats")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return repeats.remove_repeats(docs, "text")


# ---------------------------------------------------------------------------------------------- op8


def _base_sql() -> str:
    pattern = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }
    digits = "regexp_replace(m, '[^0-9]', '', 'g')"
    double = f"list_transform(range(1, len({digits}) + 1), lambda i: CASE WHEN i % 2 = 0 THEN [0,2,4,6,8,1,3,5,7,9][substr({digits}, -i, 1)::INT + 1] ELSE substr({digits}, -i, 1)::INT END)"
    valid = {
        "email": "true",
        "ip": "list_max(list_transform(string_split(m, '.'), lambda p: p::HUGEINT)) <= 255",
        "card": f"len({digits}) BETWEEN 14 AND 19 AND list_sum({double}) % 10 = 0",
        "phone": f"len({digits}) BETWEEN 10 AND 15",
    }
    each = " UNION ALL ".join(
        f"""SELECT doc_id, {n} AS n, '{k}' AS kind, p AS parts, i, p[i] AS m FROM (
          SELECT doc_id, p, unnest(range(2, len(p) + 1, 2)) AS i FROM (
            SELECT doc_id, string_split(regexp_replace(t, '{pattern[k]}', chr(1) || '\\0' || chr(1), 'g'), chr(1)) AS p FROM t))"""
        for n, k in enumerate(pii.KINDS)
    )
    check = " ".join(f"WHEN '{k}' THEN {valid[k]}" for k in pii.KINDS)
    return f"""
    WITH t AS (SELECT doc_id, replace(coalesce(text, ''), chr(1), chr(2)) AS t FROM documents),
    found AS ({each}),
    placed AS (
      SELECT doc_id, n, kind, length(array_to_string(parts[1:i-1], '')) AS a, length(m) AS len FROM found WHERE CASE kind {check} END),
    listed AS (
      SELECT doc_id, string_agg(kind || ':' || a || ':' || (a + len), ',' ORDER BY a, n) AS spans,
        {", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in pii.KINDS)}
      FROM placed GROUP BY doc_id)
    SELECT documents.doc_id, {", ".join(f"coalesce(n_{k}, 0)::BIGINT AS n_{k}" for k in pii.KINDS)}, sha256(coalesce(spans, '')) AS base_sha256
    FROM documents LEFT JOIN listed USING (doc_id)
    """


@query("op8_personal_data")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(table(spark, sf_dir, "documents"), "doc_id", "text")


@query("personal_data_base", _base_sql())
def personal_data_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the fixed patterns of op8 find; the bootstrapped spans are tested against a loop."""
    return op8(spark, sf_dir).drop("spans")


# ---------------------------------------------------------------------------------------------- op9

SHARDS = 16


def _sharding_sql() -> str:
    def draw(node: str, children: list[tuple[int, float]]) -> str:
        pairs = ", ".join(
            f"{{'draw': -ln((('0x' || substr(md5(k || '|{node}|{c}'), 1, 12))::BIGINT + 0.5::DOUBLE) / {float(2**48)!r}::DOUBLE) / {float(w)!r}::DOUBLE, 'c': {c}}}"
            for c, w in children
        )
        return f"list_min([{pairs}]).c"

    def shard(topology: sharding.Topology) -> str:
        out = []
        for r, region in enumerate(topology.regions):
            racks = [(k, sum(rack.values())) for k, rack in enumerate(region)]
            leaves = " ".join(f"WHEN {k} THEN {draw(f'{r}/{k}', sorted(rack.items()))}" for k, rack in enumerate(region))
            out.append(f"WHEN {r} THEN (CASE {draw(str(r), racks)} {leaves} END)")
        top = [(r, sum(sum(k.values()) for k in region)) for r, region in enumerate(topology.regions)]
        return f"CASE {draw('top', top)} {' '.join(out)} END"

    topology = sharding.regular(SHARDS)
    return f"""
    WITH keyed AS (
      SELECT doc_id, coalesce(strlen(text), 0) + 1 AS size, text, coalesce('k' || doc_id, 'null') AS k FROM documents),
    placed AS (SELECT *, {shard(topology)} AS shard, {shard(topology.grown())} AS grown_shard FROM keyed)
    SELECT doc_id, size, 'key' AS law, shard::INT AS shard, grown_shard::INT AS grown_shard,
      row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS slot
    FROM placed
    """


@query("op9_sharding")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By key: doc_id and the shard count decide. DuckDB has no crc32, so ``sharding_law`` has the SQL."""
    text = F.coalesce("text", F.lit(""))
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    return sharding.place(docs, "doc_id", sharding.regular(SHARDS))


@query("sharding_law", _sharding_sql())
def op9_law(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows without the checksum, in the order of the file within a shard."""
    return op9(spark, sf_dir).drop("text_crc32")


# --------------------------------------------------------------------------------------------- op10

BLOCK_WORDS, PASSES, MIX_SEED = 128, 3, 7


def cyclic_weights(names: list[str | None]) -> list[float]:
    """1, 2, 3, repeating, for the sources in order."""
    return [float(i % 3 + 1) for i in range(len(names))]


# Targets: with unit u, source s gets least(3 * size, u * weight). Sources stop in the order of
# size / weight, so u is the first unit under which the next source does not stop.
_MIX_SQL = rf"""
WITH docs AS (SELECT doc_id, source, {WORDS_SQL} AS size FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight
  FROM docs GROUP BY source),
stops AS (
  SELECT *, (SELECT sum(source_size) FROM sources)::DOUBLE AS total,
    coalesce(sum(source_size) OVER w, 0)::DOUBLE * {PASSES} AS stopped,
    sum(weight) OVER (ORDER BY source_size / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS free,
    row_number() OVER (ORDER BY source_size / weight, source) AS place
  FROM sources WINDOW w AS (ORDER BY source_size / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
unit AS (SELECT arg_min((total - stopped) / free, place) AS u FROM stops WHERE (total - stopped) / free * weight <= {PASSES} * source_size),
goals AS (
  SELECT source, source_size, least({PASSES} * source_size::DOUBLE, weight * coalesce(u, 'infinity'::DOUBLE)) AS target
  FROM sources, unit),
plan AS (
  SELECT *, CASE WHEN source_size > 0 THEN round_even(target, 0)::BIGINT // source_size ELSE 0 END AS passes,
    CASE WHEN source_size > 0 THEN round_even(target, 0)::BIGINT % source_size ELSE 0 END AS rest
  FROM goals),
blocks AS (
  SELECT doc_id, source, part, least({BLOCK_WORDS}, size - part * {BLOCK_WORDS}) AS n,
    md5('{MIX_SEED}:' || coalesce(doc_id::VARCHAR, 'null') || ':' || part) AS h
  FROM (SELECT *, unnest(range((size + {BLOCK_WORDS - 1}) // {BLOCK_WORDS})) AS part FROM docs)),
ranked AS (SELECT *, sum(n) OVER (PARTITION BY source ORDER BY h) - n AS before FROM blocks),
taken AS (
  SELECT doc_id, sum(n * (passes + (2 * before + n <= 2 * rest)::INT)) AS taken
  FROM ranked JOIN plan ON ranked.source IS NOT DISTINCT FROM plan.source GROUP BY doc_id)
SELECT docs.doc_id, size::BIGINT AS size, source_size, round(target, 3) AS target, coalesce(taken, 0)::BIGINT AS taken
FROM docs JOIN goals ON docs.source IS NOT DISTINCT FROM goals.source LEFT JOIN taken ON docs.doc_id = taken.doc_id
"""


@query("op10_mixing")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of each document, and the first and last of the shards that its draws went to.

    The splitting tree decides the shards by seeded hypergeometric draws, so ``mixing_taken`` has the SQL of the rest.
    """
    docs = table(spark, sf_dir, "documents")
    rows = mixing.numbered(
        docs, F.col("doc_id").alias("key"), F.col("source"), word_count(F.col("text")).alias("size")
    )
    draws, sources = mixing.mix(
        rows, cyclic_weights, shards=SHARDS, block_words=BLOCK_WORDS, max_passes=PASSES, seed=MIX_SEED
    )
    taken = draws.groupBy("row").agg(
        F.sum("n_words").alias("taken"), F.min("shard").alias("first_shard"), F.max("shard").alias("last_shard")
    )
    return (
        rows.join(taken, "row", "left")
        .join(F.broadcast(sources.withColumnRenamed("source", "of")), F.col("source").eqNullSafe(F.col("of")))
        .select(
            F.col("key").alias("doc_id"),
            "size",
            "source_size",
            F.round("target", 3).alias("target"),
            F.coalesce("taken", F.lit(0)).cast("long").alias("taken"),
            "first_shard",
            "last_shard",
        )
    )


@query("mixing_taken", _MIX_SQL)
def op10_taken(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows without the shards."""
    return op10(spark, sf_dir).drop("first_shard", "last_shard")


# --------------------------------------------------------------------------------------------- op13

_NEGATIVES_SQL = """
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
    list_inner_product(a.v, b.v)::BIGINT AS score
  FROM e a, e b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5),
n AS (
  SELECT anchor_id, positive_id, other_id AS negative_id, positive_score, score AS negative_score,
    row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id)::INT AS rank
  FROM p JOIN s USING (anchor_id)
  WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""


@query("op13_hard_negatives", _NEGATIVES_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(rows, "vec_id", "embedding", label, F.col("vec_id") % 100 == 0)


# --------------------------------------------------------------------------------------------- op12


def _license_sql() -> str:
    lines = ", ".join(
        f"({n}, '{t.label}', {t.share}, {str(t.base).lower()}, {p}, '{w}', {int(k)})"
        for n, t in enumerate(licenses.TEMPLATES)
        for p, (w, k) in enumerate(zip(t.words, t.key))
    )
    labels = "string_agg(DISTINCT label, ',' ORDER BY label)"
    return rf"""
    WITH t(template, label, share, base, p, word, key) AS (VALUES {lines}),
    w AS (
      SELECT doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
      FROM documents),
    x AS (
      SELECT doc_id, words[i] AS word, i - 1 AS place FROM (SELECT *, unnest(range(1, len(words) + 1)) AS i FROM w)
      WHERE words[i] IN (SELECT word FROM t)),
    heavy AS (
      SELECT word, 1 + round(1000 * ln(((SELECT count(*) FROM documents) + 1) / (count(DISTINCT doc_id) + 1)))::BIGINT AS weight
      FROM (SELECT DISTINCT word FROM t) LEFT JOIN x USING (word) GROUP BY word),
    totals AS (SELECT template, sum(weight) AS total, sum(key) AS keys FROM t JOIN heavy USING (word) GROUP BY template),
    finds AS (
      SELECT doc_id, template, label, base, place - p AS start, sum(weight) / any_value(total) AS found
      FROM x JOIN t USING (word) JOIN heavy USING (word) JOIN totals USING (template)
      GROUP BY ALL
      HAVING 100 * sum(weight) >= any_value(share) * any_value(total) AND sum(key) = any_value(keys)),
    listed AS (
      SELECT doc_id, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word,
        {labels} FILTER (base) AS base_labels, {labels} AS labels, max(found) AS score
      FROM finds GROUP BY doc_id)
    SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
      coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, round(coalesce(score, 0), 6)::DOUBLE AS score
    FROM w LEFT JOIN listed USING (doc_id)
    """


@query("op12_license_scan", _license_sql())
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return licenses.scan(docs, "text").drop("text", "places").withColumn("score", F.round("score", 6))


# --------------------------------------------------------------------------------------------- op11

# A checksum by its table, byte by byte; words that are equal without one place, or with a place blanked, are near.
_SPELLING_SQL = r"""
WITH RECURSIVE
crc AS MATERIALIZED (
  SELECT list(x ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i::UBIGINT, range(8)::UBIGINT[]),
      lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384::UBIGINT, c // 2) ELSE c // 2 END) AS x
    FROM (SELECT unnest(range(256)) AS i))),
runs AS MATERIALIZED (
  SELECT doc_id, run, count(*) AS k FROM (
    SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+')),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents)
  WHERE length(run) >= 7 GROUP BY ALL),
bytes AS (SELECT *, hex(encode(doc_id || ':' || run)) AS x FROM runs),
summed AS (
  SELECT run, k, xor(4294967295::UBIGINT, list_reduce(
    list_prepend(4294967295::UBIGINT, list_transform(range(0, len(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::UBIGINT)),
    lambda c, b: xor(c // 256, t[(xor(c % 256, b) + 1)::INT]))) AS h
  FROM bytes, crc),
cut AS (
  SELECT k, CASE WHEN h % 31 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word
  FROM summed),
words AS MATERIALIZED (SELECT word, sum(k)::BIGINT AS n FROM cut WHERE length(word) >= 7 GROUP BY word HAVING sum(k) >= 2),
places AS MATERIALIZED (
  SELECT word, n, substr(word, 1, i) AS a, substr(word, i + 2) AS b, i FROM (SELECT *, unnest(range(0, length(word))) AS i FROM words)),
near AS MATERIALIZED (
  SELECT DISTINCT word, near, near_n FROM (
    SELECT x.word, y.word AS near, y.n AS near_n FROM places x JOIN places y USING (a, b, i) WHERE x.word <> y.word
    UNION ALL SELECT p.word, w.word, w.n FROM places p JOIN words w ON p.a || p.b = w.word
    UNION ALL SELECT w.word, p.word, p.n FROM places p JOIN words w ON p.a || p.b = w.word)),
forms AS MATERIALIZED (
  SELECT word, count(*) AS n_near, max(near_n) AS top,
    first(near ORDER BY near_n DESC, near) AS best FROM near GROUP BY word),
judged AS MATERIALIZED (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= 10 * n THEN best END AS form, CASE WHEN top >= 10 * n THEN top END AS form_n
  FROM words LEFT JOIN forms USING (word)),
walk AS (
  SELECT word, word AS here, 0 AS step FROM words
  UNION ALL SELECT walk.word, j.form, step + 1 FROM walk JOIN judged j ON j.word = here WHERE j.form IS NOT NULL),
ends AS (SELECT word, arg_max(here, step) AS root FROM walk GROUP BY word)
SELECT word, form, root, n, n_near, form_n FROM judged JOIN ends USING (word)
"""


@query("op11_spelling_variants", _SPELLING_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text")
