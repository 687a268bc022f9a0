"""Personal data: fixed patterns as seeds, and bootstrapped contextual extraction around them.

**Base.** Four patterns (email, ip, card, phone) are matched leftmost and non-overlapping, checked, and
placed in code points. The regular expressions are written so that a long run of fitting characters
is read once: possessive quantifiers, and a start only where a run starts or a match has just ended.

**Bootstrapping.** The two words before a seed are a pattern of its kind. Identifier-like strings (with a
digit or ``@``) that no base pattern claims are candidates; a candidate after the same two words is an
instance of the pattern. Scores pass over the graph of patterns and instances a fixed number of rounds:
a pattern's confidence is the mean score of its instances, an unseen instance's score is the noisy-or
of its patterns' confidences. Patterns need ``SUPPORT`` distinct seeds; instances of patterns that
reach ``CONFIDENT`` become spans of the pattern's kind.

Everything is columns, joins and aggregates. Texts are read once; what goes on is one narrow row per
document with its spans and candidates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from seqloom.llm.text import with_row
from seqloom.session import stored

KINDS = ("email", "ip", "card", "phone")
SUPPORT = 3
CONFIDENT = 0.9
ROUNDS = 3
LEFT = 80  # characters before a match in which its context words are looked for

_LOCAL = "[A-Za-z0-9._%+-]"
_TOKEN = "[A-Za-z0-9@._%+()-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}+",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
CANDIDATE = rf"(?<!{_TOKEN})[A-Za-z._%+()-]{{0,64}}+[0-9@]{_TOKEN}*+"
#: What a text must contain for a pattern to be tried.
_NEEDS = {"email": "@", "phone": "+"}
_MARK, _INSTEAD, _BLANK = "\u0001", "\u0002", "\u0003"
_SPANS = "array<struct<start:bigint,end:bigint,text:string,left:string>>"


def _parts(text: Column, pattern: str) -> Column:
    """The text cut at its matches: odd places hold the matches. ``text`` must not hold the mark."""
    return F.split(F.regexp_replace(text, pattern, f"{_MARK}$0{_MARK}"), _MARK)


def _placed(parts: Column) -> Column:
    """The matches with their places and the text just before them."""
    start = F.struct(
        F.lit(0).cast("long").alias("pos"), F.lit(0).alias("i"), F.lit("").alias("left"), F.array().cast(_SPANS).alias("out")
    )

    def step(acc: Column, x: Column) -> Column:
        end = (acc["pos"] + F.length(x)).cast("long")
        span = F.struct(acc["pos"].alias("start"), end.alias("end"), x.alias("text"), acc["left"].alias("left"))
        match = acc["i"] % 2 == 1
        return F.struct(
            end.alias("pos"),
            (acc["i"] + 1).alias("i"),
            F.when(match, acc["left"]).otherwise(F.substring(x, -LEFT, LEFT)).alias("left"),
            F.when(match, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"),
        )

    return F.aggregate(parts, start, step, lambda acc: acc["out"])


def _luhn(digits: Column) -> Column:
    backward = F.reverse(digits)

    def value(i: Column) -> Column:
        d = F.substring(backward, i, F.lit(1)).cast("int")
        twice = 2 * d - F.when(d > 4, 9).otherwise(0)
        return F.when(i % 2 == 0, twice).otherwise(d)

    places = F.sequence(F.lit(1), F.length(digits))
    return F.aggregate(F.transform(places, value), F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: str, text: Column) -> Column:
    if kind == "ip":
        return F.forall(
            F.split(text, "\\."),
            lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.ltrim(p, F.lit("0")).try_cast("int"), F.lit(0)) <= 255),
        )
    if kind == "card":
        digits = F.translate(text, " -", "")
        return F.when(F.length(digits).between(14, 19), _luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(F.translate(text, "+ ().-", "")).between(10, 15)
    return F.lit(True)


def _claimed(kind: str, text: Column) -> Column:
    """Matches that candidates may not touch: valid ones and those of the kind's shape that failed its check."""
    return F.length(F.translate(text, " -", "")).between(14, 19) if kind == "card" else F.lit(True)


def _needed(kind: str, text: Column) -> Column:
    return F.contains(text, F.lit(_NEEDS[kind])) if kind in _NEEDS else F.col("digits")


def _context(left: Column) -> Column:
    """The two words before a place, lower-cased; null unless both are letters only."""
    found = F.regexp_extract(left, r"(?U)(\p{L}++\s++\p{L}++)[\s:=\"'(]*+$", 1)
    return F.when(found != "", F.lower(F.regexp_replace(found, r"(?U)\s+", " ")))


def _seeds(kind: str) -> Column:
    """The valid matches of a kind, each with its context."""

    def span(s: Column) -> Column:
        number = F.lit(KINDS.index(kind)).alias("kind")
        return F.struct(
            s["start"].alias("start"), number, s["end"].alias("end"), s["text"].alias("text"), _context(s["left"]).alias("context")
        )

    matches = _placed(_parts(F.col("t"), PATTERNS[kind]))
    return F.transform(F.filter(matches, lambda s: _valid(kind, s["text"])), span)


def _blanked(kind: str) -> Column:
    def blank(x: Column, i: Column) -> Column:
        return F.when((i % 2 == 1) & _claimed(kind, x), F.repeat(F.lit(_BLANK), F.length(x))).otherwise(x)

    return F.array_join(F.transform(_parts(F.col("t"), PATTERNS[kind]), blank), "")


def extract(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``row, doc_id, base, candidates`` of every document, as a table.

    ``base``: sorted ``(start, kind, end, text, context)``, ``kind`` the place in ``KINDS``.
    ``candidates``: ``(start, end, text, context)``.
    """
    whole = F.translate(F.coalesce(F.col(text), F.lit("")), _MARK + _BLANK, _INSTEAD + _INSTEAD)
    df = docs.select(F.col(key).alias("doc_id"), whole.alias("t")).withColumn("digits", F.col("t").rlike("[0-9]"))
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint,text:string,context:string>>")
    for kind in KINDS:
        df = df.withColumn(kind, F.when(_needed(kind, F.col("t")), _seeds(kind)).otherwise(none))
    # What a base pattern claims is blanked before candidates are looked for.
    for kind in KINDS:
        df = df.withColumn("t", F.when(_needed(kind, F.col("t")), _blanked(kind)).otherwise(F.col("t")))
    candidates = F.filter(
        F.transform(
            _placed(_parts(F.col("t"), CANDIDATE)),
            lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["text"].alias("text"), _context(s["left"]).alias("context")),
        ),
        lambda s: s["context"].isNotNull(),
    )
    none = F.array().cast("array<struct<start:bigint,end:bigint,text:string,context:string>>")
    found = df.select(
        "doc_id",
        F.sort_array(F.concat(*KINDS)).alias("base"),
        F.when(F.col("digits") | F.contains("t", F.lit("@")), candidates).otherwise(none).alias("candidates"),
    )
    return stored(with_row(found, "row"), "personal")


def discover(found: DataFrame) -> DataFrame:
    """``row, start, kind, end`` of candidates that confident patterns extract."""
    seeds = found.select(F.explode("base").alias("s")).select(
        F.col("s.context").alias("pattern"), F.lower("s.text").alias("instance"), F.col("s.kind").alias("kind")
    )
    seeds = seeds.where("pattern IS NOT NULL").distinct()
    supported = seeds.groupBy("pattern", "kind").agg(F.countDistinct("instance").alias("support")).where(F.col("support") >= SUPPORT)
    seen = found.select("row", F.explode("candidates").alias("c")).select(
        "row", F.col("c.context").alias("pattern"), F.lower("c.text").alias("instance"), F.col("c.start").alias("start"), F.col("c.end").alias("end")
    )
    seen = stored(seen.join(supported.select("pattern").distinct(), "pattern", "left_semi"), "candidates")
    seeds = stored(seeds.join(supported.select("pattern").distinct(), "pattern", "left_semi"), "seeds")

    edges = stored(seeds.select("pattern", "instance").union(seen.select("pattern", "instance")).distinct(), "graph")
    degree = edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("degree"))
    known = seeds.select("instance", "kind").distinct().withColumn("score", F.lit(1.0))
    scores = known
    for _ in range(ROUNDS):
        confidence = (
            edges.join(scores, "instance")
            .groupBy("pattern", "kind")
            .agg(F.sum("score").alias("total"))
            .join(degree, "pattern")
            .join(supported.select("pattern", "kind"), ["pattern", "kind"])
            .withColumn("confidence", F.least(F.col("total") / F.col("degree"), F.lit(1.0)))
            .select("pattern", "kind", "confidence")
        )
        confidence = stored(confidence, "confidence")
        doubt = F.sum(F.ln(F.greatest(1 - F.col("confidence"), F.lit(1e-12))))
        unseen = (
            edges.join(known.select("instance").distinct(), "instance", "left_anti")
            .join(confidence, "pattern")
            .groupBy("instance", "kind")
            .agg((1 - F.exp(doubt)).alias("score"))
        )
        scores = stored(known.unionByName(unseen), "scores")
    accepted = confidence.where(F.col("confidence") >= CONFIDENT)
    return (
        seen.join(known.select("instance").distinct(), "instance", "left_anti")
        .join(accepted, "pattern")
        .join(scores.where(F.col("score") >= CONFIDENT).drop("score"), ["instance", "kind"])
        .select("row", "start", "kind", "end")
        .distinct()
    )


def _listed(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def personal_data(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans``, one row per row of ``docs``.

    Counts and ``base_sha256`` are of base spans, ``spans`` lists base and discovered ones by start, then
    kind. A null or empty text has none (the hash of nothing). Repeated rows have the same spans; null keys
    are kept; an empty table gives an empty result. Other columns are not read.
    """
    found = extract(docs, key, text)
    more = (
        discover(found)
        .groupBy("row")
        .agg(F.collect_list(F.struct("start", "kind", "end")).alias("more"))  # spans of one text
    )
    base = F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    fresh = F.filter("more", lambda m: ~F.exists("base", lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"])))
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
    count = lambda n: F.size(F.filter("base", lambda s: s["kind"] == n)).cast("long").alias(f"n_{KINDS[n]}")
    joined = found.drop("candidates").join(more, "row", "left").select("doc_id", base.alias("base"), F.coalesce("more", none).alias("more"))
    return joined.select(
        "doc_id",
        *(count(n) for n in range(len(KINDS))),
        F.sha2(_listed(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        _listed(F.sort_array(F.concat("base", fresh))).alias("spans"),
    )
