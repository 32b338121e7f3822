"""Lexical search, vector codes, personal data: brute force and edges."""

import hashlib
import math
import random
import re
import string

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lodemine.llm import codes, lexical, pii
from lodemine.llm.common import materialize

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOW = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)

# -- lexical search


def terms(text):
    return TERM.findall((text or "").translate(LOW))


def brute_search(items, docs, k):
    """Rows (item, rank, doc, score) as the contract states it, for documents as rows."""
    held = [(d, terms(t)) for d, t in docs]
    held = [(d, t) for d, t in held if t]
    n_docs, total = len(held), sum(len(t) for _, t in held)
    df = {}
    for _, t in held:
        for x in set(t):
            df[x] = df.get(x, 0) + 1
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    out = []
    for i, words in asked.items():
        scored = []
        for d, t in held:
            m = 100 - 50 + (50 * len(t) * n_docs) // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1))) * ((10**9 * t.count(x)) // (1000 * t.count(x) + 20 * m)) for x in words if x in t)
            if s > 0:
                scored.append((-s, d is None, d or 0))
        out += [(i, r, None if none else d, -s) for r, (s, none, d) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def some_texts(rng, n):
    words = ["alpha", "Beta", "gämma", "ünder", "x1", "42", "Ⅷ", "delta", "ΣΑΣ"] + [f"w{i}" for i in range(40)]
    glue = [" ", "-", "_", "\n", " ", "'", "\x7f", "."]
    return ["".join(rng.choice(words) + rng.choice(glue) for _ in range(rng.choice([0, 1, 5, 60]))) for _ in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_search_matches_brute_force(spark, seed, monkeypatch):
    rng = random.Random(seed)
    docs = list(enumerate(some_texts(rng, 150))) + [(200, None), (201, ""), (None, "alpha w3 w4"), (7, "alpha w3 w4"), (7, "alpha w3 w4"), (None, "ALPHA w3 w4")]
    items = list(enumerate(some_texts(rng, 12))) + [(50, None), (51, "nowhere"), (None, "w1 w2"), (3, "alpha")]
    rng.shuffle(docs)
    docs_df = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, score int").repartition(3)
    items_df = spark.createDataFrame([(i, t, "q") for i, t in items], "item_id long, text string, doc_id string")
    monkeypatch.setattr(lexical, "FIRST", 3)
    monkeypatch.setattr(lexical, "CHUNK", 100)
    for group_bytes in (1 << 23, 300):
        got = lexical.search(items_df, docs_df, k=5, group_bytes=group_bytes)
        assert got.columns == ["item_id", "rank", "doc_id", "score"]
        assert sorted([tuple(r) for r in got.collect()], key=str) == brute_search(items, docs, 5)


def test_search_of_empty_tables(spark):
    none, some = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    no_items, items = spark.createDataFrame([], "item_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical.search(items, none).count() == lexical.search(no_items, some).count() == lexical.search(no_items, none).count() == 0
    assert [tuple(r) for r in lexical.search(items, some).collect()] == [(1, 1, 1, brute_search([(1, "a")], [(1, "a b")], 1)[0][3])]


def test_search_of_a_very_long_text(spark):
    docs = [(1, "w1 " * 300_000 + "w2"), (2, "w1 w2 w3"), (3, "z" * 500_000)]
    items = [(1, "w1 w2"), (2, "z" * 500_000)]
    got = lexical.search(spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string"))
    assert sorted([tuple(r) for r in got.collect()], key=str) == brute_search(items, docs, 50)


def test_what_is_passed_on_does_not_grow_with_tasks(spark, monkeypatch):
    rng = random.Random(5)
    docs = spark.createDataFrame([(i, " ".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 60)))) for i in range(4000)], "doc_id long, text string")
    items = spark.createDataFrame([(i, " ".join(rng.sample("abcdefgh", 3))) for i in range(20)], "item_id long, text string")
    monkeypatch.setattr(lexical, "FIRST", 16)
    passed = []
    once = lexical._best

    def counted(*args, **named):
        rows = materialize(once(*args, **named), "counted")
        passed.append(rows.count())
        return rows

    monkeypatch.setattr(lexical, "_best", counted)
    for parts in (2, 40):
        lexical.search(items, docs.repartition(parts), k=5).count()
    # 20 items x 5: in the first pass of at most so many each task, then of the order of FIRST x k an item
    assert all(n <= 20 * 5 * 16 * 2 for n in passed) and passed[3] < 4 * passed[1] + 400


def test_radix_order_and_sums():
    rng = np.random.default_rng(3)
    for top in (1, 60_000, 1 << 20, 1 << 40):
        keys = rng.integers(0, top, 5000)
        assert (lexical.radix_order(keys) == np.argsort(keys, kind="stable")).all()
    assert len(lexical.radix_order(np.zeros(0, np.int64))) == 0


# -- vector codes


def brute_codes(rows, parts=8, entries=16, rounds=6):
    kept = [(i, [math.floor(4096 * x) for x in v], lab) for i, v, lab in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    step = len(kept[0][1]) // parts
    seeds, seen = [], set()
    for i, v, _ in sorted((r for r in kept if r[0] is not None), key=lambda r: (r[0], r[1])):
        if i not in seen:
            seen.add(i)
            seeds.append(v)
    books = [[v[p * step : (p + 1) * step] for v in seeds[:entries]] for p in range(parts)]

    def nearest(v, book):
        return min((sum((a - b) ** 2 for a, b in zip(v, e)), j) for j, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for _, v, _ in kept:
                part = v[p * step : (p + 1) * step]
                groups.setdefault(nearest(part, books[p])[1], []).append(part)
            for j, of in groups.items():
                books[p][j] = [sum(c) // len(of) for c in zip(*of)]
    coded = [(i, lab, [nearest(v[p * step : (p + 1) * step], books[p]) for p in range(parts)]) for i, v, lab in kept]
    errors = {}
    for _, lab, c in coded:
        errors[lab] = errors.get(lab, 0) + sum(d for d, _ in c)
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted([(i, "".join(f"{j:02x}" for _, j in c), sum(d for d, _ in c), errors[lab], sha) for i, lab, c in coded], key=str)


def coded_rows(spark, rows, **named):
    df = spark.createDataFrame([(i, v, lab, "n", 0) for i, v, lab in rows], "vec_id long, embedding array<double>, label int, n string, _label int").withColumn("_c", F.lit("c"))
    table = materialize(codes.whole(df, "embedding"), "t")
    books = codes.train(table, **named)
    out = codes.label_errors(codes.encode(table, books))
    assert {"n", "embedding", "_label", "_c"} <= set(out.columns)
    return sorted([tuple(r) for r in out.select("vec_id", "code", "error", "label_error", F.lit(codes.digest(books))).collect()], key=str)


@pytest.mark.parametrize("n", [5, 120])
def test_codes_match_brute_force(spark, n):
    rng = random.Random(n)
    point = lambda: [rng.choice([rng.gauss(0, 1), 0.0, rng.gauss(5, 0.1)]) for _ in range(16)]
    rows = [(i, point(), rng.choice([None, 1, 2])) for i in range(n)]
    bad = [(900, None, 1), (901, [], 1), (902, [1.0] * 15 + [None], 1), (903, [1.0] * 15 + [float("nan")], 1), (904, [float("inf")] * 16, 1)]
    rows += [rows[0], rows[0], (3, point(), 1), (None, point(), None), (None, [0.0] * 16, 7)]
    assert coded_rows(spark, rows + bad) == brute_codes(rows)


def test_codes_of_odd_tables(spark):
    assert coded_rows(spark, []) == []
    rows = [(1, [1.0, 2.0, 3.0], 1), (2, [4.0] * 9, 1), (3, [1e300] * 9, 1), (4, [-1e300] * 9, 1), (None, [7.0] * 5, 2)]
    got = {r[0]: r for r in coded_rows(spark, rows)}
    assert got[1][1] == "00" * 8 and got[1][2] == 0 and got[2][1] != got[3][1] != got[4][1]
    assert got[None][1] is None and got[None][2] is None
    with pytest.raises(ValueError):
        codes.train(codes.whole(spark.createDataFrame([(1, [1.0] * 800)], "vec_id long, v array<double>"), "v"), parts=8)


def test_annulus_is_exact_and_prunes():
    rng = np.random.default_rng(1)
    for spread in (1, 1000):
        entries = rng.integers(-50, 50, (64, 4)) * rng.integers(1, spread + 1, (64, 1))
        entries[9] = entries[3]
        x = np.concatenate([rng.integers(-60, 60, (500, 4)) * rng.integers(1, spread + 1, (500, 1)), entries])
        code, best, evaluated = codes.by_annulus(x, entries)
        d = ((x[:, None] - entries) ** 2).sum(2)
        assert (best == d.min(1)).all() and (code == d.argmin(1)).all()
        assert evaluated <= x.shape[0] * 64
    assert evaluated < 0.5 * x.shape[0] * 64  # norms are spread


# -- personal data

BASE = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(d := re.sub("[^0-9]", "", m)) <= 19 and sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(d[::-1])) % 10 == 0),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(re.sub("[^0-9]", "", m)) <= 15),
}


def base_spans(text):
    out = []
    for place, (kind, (pattern, valid)) in enumerate(BASE.items()):
        out += [(m.start(), place, kind, m.end()) for m in re.finditer(pattern, text or "") if valid(m.group())]
    return [(kind, a, b) for a, _, kind, b in sorted(out)]


def found_spans(spark, texts):
    df = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)], "doc_id long, text string, pii int")
    return {r.doc_id: [(s["kind"], s["start"], s["end"], s["score"]) for s in r.pii] for r in pii.find(df).collect()}


def test_base_kinds_match_plain_expressions(spark):
    rng = random.Random(4)
    bits = ["a@b.c", "_d@e.f", "@", ".", "x.y@z", "mail", "1.2.3.4", "300.1.2.3", "0.00.255.0256", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 123-4567", "+49.30.1234567", "+", "-", " ", "9", "é", "😀", "\n", "12", "%", "(", ")", "79927398713", "A", "tel "]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 40))) for _ in range(600)] + [None, "", "x"]
    got = found_spans(spark, texts)
    for i, t in enumerate(texts):
        assert [s[:3] for s in got[i] if s[0] in BASE] == base_spans(t), t


def test_checks_and_words_decide(spark):
    texts = [
        "pay to IBAN DE89 3704 0044 0532 0130 00 please",
        "DE89370400440532013001",  # mod 97 fails
        "xDE89370400440532013000",  # touched
        "GB82WEST12345698765432",
        "my ssn: 123-45-6789.",
        "part 123-45-6789",  # no word nearby
        "ssn 000-12-3456 or 123-00-4567",
        "version 1.2.3.4 of the package",
        "server at 10.0.0.1",
    ]
    got = found_spans(spark, texts)
    kinds = [[s[0] for s in got[i]] for i in range(len(texts))]
    assert kinds == [["iban"], [], [], ["iban"], ["ssn"], [], [], ["ip"], ["ip"]]
    assert texts[0][got[0][0][1] : got[0][0][2]] == "DE89 3704 0044 0532 0130 00" and got[0][0][3] == 100
    assert got[7][0][3] == 30 and got[8][0][3] == 90


def test_many_matches_and_long_runs(spark):
    many = "a@b.cd " * 20_000
    texts = [many, "a" * 400_000, "1" * 400_000, "a@b" + ".c" * 100_000, "1.2." * 10_000, "+" * 100_000, "+1" + " " * 200_000, "A1" * 100_000]
    got = {i: [s[:3] for s in found] for i, found in found_spans(spark, texts).items()}
    assert got[0] == [("email", 7 * i, 7 * i + 6) for i in range(20_000)]
    assert got[3] == [("email", 0, len(texts[3]))]
    assert got[4] == [("ip", 8 * i, 8 * i + 7) for i in range(5_000)]
    assert [got[i] for i in (1, 2, 5, 6, 7)] == [[]] * 5


def test_redaction(spark):
    df = spark.createDataFrame([(1, "mail a@b.cd now"), (2, None), (3, "nothing"), (4, "é +1 555 123 4567!")], "doc_id long, text string")
    got = {r.doc_id: r.text for r in pii.redact(pii.find(df)).collect()}
    assert got == {1: "mail [EMAIL] now", 2: None, 3: "nothing", 4: "é [PHONE]!"}
    assert pii.find(df.limit(0)).count() == 0


def test_contract_columns_against_sql(spark, tmp_path):
    rng = random.Random(8)
    bits = ["tel +1 555 123 4567 ", "a@b.cd", " iban DE89370400440532013000 ", "4111111111111111", " visa ", "10.1.1.1", "é", " ", "ssn 123-45-6789"]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randint(0, 9)))) for i in range(80)] + [(90, None), (90, None), (None, "a@b.cd")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.sql(pii.OP13_SQL)
    got = pii.op13_pii(spark, str(tmp_path)).select(*want.columns)
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, want.fetchall()))
