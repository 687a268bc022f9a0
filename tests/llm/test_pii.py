import hashlib
import random
import re

import pytest

from seqloom.llm import pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def valid(kind, m):
    digits = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(p) <= 255 for p in m.split("."))
    if kind == "card":
        twice = [int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits))]
        return 14 <= len(digits) <= 19 and sum(twice) % 10 == 0
    return kind == "email" or 10 <= len(digits) <= 15


def base(text):
    return sorted(
        (m.start(), n, m.end(), m[0])
        for n, kind in enumerate(pii.KINDS)
        for m in re.finditer(PLAIN[kind], text or "")
        if valid(kind, m[0])
    )


def listed(spans):
    return ",".join(f"{pii.KINDS[n]}:{a}:{b}" for a, n, b in sorted(spans))


CARD = "4539 1488 0343 6467"
TEXTS = [
    None, "", "nothing here 12 or 3.4", "a@b.com_x@y.org a@b.c@d.e @x.y a@b", "me.you%1+2-3@mail-1.example.co.uk.", "1.2.3.4.5.6.7.8 256.1.1.1 001.002.003.4 1.2.3",
    f"{CARD} 4539-1488-0343-6467 4539148803436467 4539148803436468 x{CARD}9", "+1 (052) 555-0934 +12 +1234567890123456 ++49 30 1234567)",
    "\u0001a@b.com\u0001\u0002 é\U0001F600 a@b.com 10.0.0.1", "9" * 30_000, "a" * 30_000 + "@" + "b" * 10_000, "1." * 5000, "a@b.cc " * 400, "99999999999999999999.1.1.1",
    "tel:+1 2 3 4 5 6 7 8 9 0 1.2.3.4",
]


def test_base_against_plain_expressions(spark):
    rng = random.Random(7)
    texts = TEXTS + ["".join(rng.choice("01234 5678.9@+-()ab_") for _ in range(300)) for _ in range(60)]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, base string")
    for r in pii.personal_data(df, "doc_id", "text").collect():
        spans = base(texts[r["doc_id"]])
        text = listed(s[:3] for s in spans)
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(s[1] == n for s in spans) for n in range(4)], texts[r["doc_id"]]
        assert r["base_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert r["spans"] == text  # no context recurs, so nothing is discovered


def discovered(texts):
    """The bootstrapping, as loops."""
    def context(left):
        m = re.search(r"([^\W\d_]+\s+[^\W\d_]+)[\s:=\"'(]*$", left[-pii.LEFT :])
        return re.sub(r"\s+", " ", m[1]).lower() if m else None

    seeds, seen = set(), []
    for i, t in enumerate(texts):
        for n, kind in enumerate(pii.KINDS):
            for m in re.finditer(PLAIN[kind], t or ""):
                if valid(kind, m[0]) and context(t[: m.start()]):
                    seeds.add((context(t[: m.start()]), m[0].lower(), n))
        blank = t or ""
        for kind in pii.KINDS:
            shape = lambda m, k=kind: k != "card" or 14 <= len(re.sub("[^0-9]", "", m)) <= 19
            blank = re.sub(PLAIN[kind], lambda m: "\u0003" * len(m[0]) if shape(m[0]) else m[0], blank)
        token = "[A-Za-z0-9@._%+()-]"
        for m in re.finditer(rf"(?<!{token})[A-Za-z._%+()-]{{0,64}}[0-9@]{token}*", blank):
            if c := context(blank[: m.start()]):
                seen.append((i, c, m[0].lower(), m.start(), m.end()))
    supported = {(p, k) for p, _, k in seeds if len({x for q, x, j in seeds if (q, j) == (p, k)}) >= pii.SUPPORT}
    live = {p for p, _ in supported}
    edges = {(p, x) for p, x, _ in seeds if p in live} | {(c, x) for _, c, x, _, _ in seen if c in live}
    known = {(x, k): 1.0 for p, x, k in seeds if p in live}
    names, scores = {x for x, _ in known}, dict(known)
    for _ in range(pii.ROUNDS):
        conf = {}
        for p, k in supported:
            members = [x for q, x in edges if q == p]
            conf[p, k] = min(1.0, sum(scores.get((x, k), 0) for x in members) / len(members))
        scores = dict(known)
        for p, x in edges:
            if x not in names:
                for (q, k), c in conf.items():
                    if q == p and c > 0:
                        scores[x, k] = 1 - (1 - scores.get((x, k), 0)) * max(1 - c, 1e-12)
    out = set()
    for i, c, x, a, b in seen:
        for (q, k), value in conf.items():
            if q == c and x not in names and value >= pii.CONFIDENT and scores.get((x, k), 0) >= pii.CONFIDENT:
                out.add((i, a, k, b))
    return out


@pytest.fixture
def contexts():
    rng = random.Random(11)
    phone = lambda: f"+1 {rng.randint(200, 999)} 555-{rng.randint(1000, 9999)}"
    texts = [f"Please call me at {phone()} today" for _ in range(40)]
    texts += ["Please call me at 0555-0173 today.", "or CALL\nME at: (0555-0199) again", "call me at 5550-188"]
    texts += [f"write to us at u{i}@mail.example.com" for i in range(5)] + ["write to us at 17:30"] * 3 + [f"look to us at {i}.5" for i in range(6)]
    texts += [f"the price is {i}.99 and we call it {i}" for i in range(30)]
    return texts


def test_discovery_against_loops(spark, contexts):
    df = spark.createDataFrame(list(enumerate(contexts)), "doc_id long, text string")
    expected = discovered(contexts)
    assert {i for i, *_ in expected} >= {40, 41}
    got = {r["doc_id"]: r["spans"] for r in pii.personal_data(df, "doc_id", "text").collect()}
    for i, text in enumerate(contexts):
        more = {(a, k, b) for j, a, k, b in expected if i == j}
        assert got[i] == listed({s[:3] for s in base(text)} | more), text


def test_nulls_repeats_and_empty(spark, contexts):
    rows = [(None, contexts[0]), (None, contexts[0]), (1, None)] + [(2, t) for t in contexts]
    got = pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text")
    assert got.count() == len(rows)
    assert got.where("doc_id = 1").first()["spans"] == ""
    assert pii.personal_data(spark.createDataFrame([], "doc_id long, text string"), "doc_id", "text").count() == 0
