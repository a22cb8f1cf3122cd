"""Runs, exact copies and collocations against brute force, against their SQL, and on odd rows."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from pairloom.llm import collocations, exact_copies, periodic_runs, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.mark.parametrize("name", ["op11_runs", "op12_exact_copies", "op13_collocations"])
def test_queries_agree_with_their_sql(spark, sf_dir, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    want = con.sql(queries.ORACLES[name])
    got = queries.QUERIES[name](spark, sf_dir)
    assert sorted(got.columns) == sorted(want.columns)
    assert Counter(map(tuple, got.select(*want.columns).collect())) == Counter(want.fetchall())


def brute_lyndon(w):
    return [next((j for j in range(i + 1, len(w) + 1) if w[j:] < w[i:])) - i for i in range(len(w))]


def brute_runs(w, exponent, least):
    found = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(least, exponent * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def random_words(rng):
    w = [rng.randrange(rng.randint(1, 4)) for _ in range(rng.randint(0, 40))]
    return (w[: rng.randint(1, 6)] * 20)[: len(w)] + w[:5] if rng.random() < 0.4 else w


def test_phase_one_gives_the_lyndon_array():
    rng = random.Random(1)
    for _ in range(500):
        w = random_words(rng)
        assert periodic_runs.lyndon_lengths(w) == brute_lyndon(w)


@pytest.mark.parametrize(("exponent", "least"), [(4, 6), (2, 1), (2, 4), (3, 3), (5, 20)])
def test_runs_of_random_texts(spark, exponent, least):
    rng = random.Random(exponent)
    texts = [[f"w{c}" for c in random_words(rng)] for _ in range(150)]
    docs = spark.createDataFrame([(i, "  ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in periodic_runs.collapsed(docs, exponent, least).collect()}
    for i, t in enumerate(texts):
        want = brute_runs(t, exponent, least)
        gone = {k for s, n, q in want for k in range(s + q, s + n)}
        assert [(r["start"], r["length"], r["period"]) for r in rows[i]["runs"]] == want
        assert rows[i]["collapsed"] == " ".join(x for k, x in enumerate(t) if k not in gone)


def test_runs_on_odd_rows(odd_docs, no_docs):
    rows = periodic_runs.collapsed(odd_docs).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(r["doc_id"] for r in odd_docs.collect())
    of = {r["doc_id"]: r for r in rows}
    assert [tuple(r) for r in of[8]["runs"]] == [(0, 30000, 1)] and of[8]["collapsed"] == "word"
    assert all(of[d]["runs"] == [] and of[d]["collapsed"] == "" for d in (2, 3, 4))
    assert of[6]["collapsed"] == "Ünïcödé 漢字 😀 mail me@example.org"
    assert periodic_runs.collapsed(no_docs).count() == 0 and periodic_runs.query(no_docs).count() == 0
    digests = {r["doc_id"]: r for r in periodic_runs.query(odd_docs).collect()}
    assert digests[2]["n_runs"] == 0 and digests[2]["start"] is None and digests[2]["collapsed_sha256"] == hashlib.sha256(b"").hexdigest()


def test_long_runs_in_a_long_text(spark):
    rng = random.Random(3)
    w = [f"v{rng.randrange(1000)}" for _ in range(5000)] * 9 + ["x"] * 20000
    row = periodic_runs.collapsed(spark.createDataFrame([(1, " ".join(w))], "doc_id long, text string")).first()
    assert [tuple(r) for r in row["runs"]] == [(0, 45000, 5000), (45000, 20000, 1)]
    assert row["collapsed"] == " ".join([*w[:5000], "x"])


def brute_classes(rows):
    groups = defaultdict(list)
    for d, t in rows:
        groups[t or ""].append(d)
    out = []
    for t, ids in groups.items():
        keep = max((d for d in ids if d is not None), default=None)
        first = True
        for d in sorted(ids, key=lambda x: -1 if x is None else x):
            out.append((d, keep, len(ids), d == keep and first))
            first = first and d != keep
    return Counter(out)


@pytest.mark.parametrize("digest", [exact_copies.sha256, lambda t: F.hex(F.crc32(t) % 3), lambda t: F.lit("same")])
def test_classes_are_of_equal_texts_whatever_the_digest(spark, odd_docs, digest):
    rng = random.Random(2)
    rows = [(rng.randrange(80) if rng.random() < 0.9 else None, rng.choice(["hot", "hot", "a", "a ", "A", "", None, f"t{rng.randrange(30)}"])) for _ in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = exact_copies.classes(docs, digest=digest)
    assert Counter(tuple(r)[:4] for r in got.collect()) == brute_classes(rows)
    odd = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    assert Counter(tuple(r)[:4] for r in exact_copies.classes(odd_docs, digest=digest).collect()) == brute_classes(odd)


def test_classes_of_normalised_texts_and_of_nothing(spark, no_docs):
    docs = spark.createDataFrame([(1, "A b"), (2, "a B"), (3, "c")], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in exact_copies.classes(docs, normalise=F.lower).collect()}
    assert rows[1]["keep_id"] == 2 and not rows[1]["kept"] and rows[2]["kept"] and rows[2]["digest"] == hashlib.sha256(b"a b").hexdigest()
    assert exact_copies.classes(no_docs).count() == 0 and exact_copies.deduplicated(no_docs).count() == 0


def test_rows_that_stay_keep_their_columns(odd_docs):
    clashing = odd_docs.withColumns({"row": F.lit(1), "digest": F.lit("x"), "kept": F.lit(True), "all": F.lit(0), "texts": F.lit(5), "salt": F.lit(3)})
    out = exact_copies.deduplicated(clashing)
    assert out.columns == clashing.columns
    assert sorted(str(r["doc_id"]) for r in out.collect()) == sorted(["5", "3", "4", "None", "6", "7", "8", "9", "10"])


def brute_collocations(rows, length, least, first):
    f = defaultdict(Counter)
    for lang, text in rows:
        own = f[lang or "und"]
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))):
            w = re.findall(r"[^\x20\x09]+", piece)
            own.update(tuple(w[i : i + k]) for k in range(1, length + 1) for i in range(len(w) - k + 1))
    out = []
    for lang, own in f.items():
        n = sum(c for p, c in own.items() if len(p) == 1)
        phrases = {p: c for p, c in own.items() if len(p) > 1 and c >= least}
        longest = Counter()
        for p, c in phrases.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    longest[p[i : i + m]] = max(longest[p[i : i + m]], c)
        rows = []
        for p, a in phrases.items():
            score, _, l, r = min((1000000 * a * a // (own[p[:k]] * own[p[k:]]), k, own[p[:k]], own[p[k:]]) for k in range(1, len(p)))
            if not 2 * longest[p] >= a or not longest[p]:
                rows.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, i, p.decode(), -a, l, r, n, -s) for i, (s, a, p, l, r) in enumerate(sorted(rows)[:first], 1)]
    return sorted(out)


def made_texts(seed):
    rng = random.Random(seed)
    vocabulary = [f"{c}é" for c in "abcdefgh"] + ["hot"] * 6
    return [(rng.choice(["en", "en", None, "de"]), "".join(rng.choice(vocabulary) + rng.choice([" ", " ", "\t", " . ", ",", "\n", "  "]) for _ in range(rng.randrange(60)))) for _ in range(150)]


@pytest.mark.parametrize(("length", "least", "share", "chars"), [(3, 10, None, None), (3, 2, 40, 300), (4, 3, 4, 1000), (6, 2, 400, 100000), (2, 5, 40, 10)])
def test_collocations_agree_with_brute_force_however_leads_are_routed(spark, monkeypatch, length, least, share, chars):
    if share:
        monkeypatch.setattr(collocations, "ROUTE_WORDS", share)
        monkeypatch.setattr(collocations, "BATCH_CHARS", chars)
    rows = made_texts(length)
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    assert sorted(tuple(r) for r in collocations.collocations(docs, length, least, 40).collect()) == brute_collocations(rows, length, least, 40)


def test_weights_of_rows_whose_key_passes_64_bits():
    rng = np.random.default_rng(1)
    columns = [rng.integers(0, 3, 500) * 400000 for _ in range(7)]
    got, weight = collocations._weighed(columns, 1 << 20)
    assert {tuple(r): int(n) for r, n in zip(np.stack(got, 1).tolist(), weight)} == Counter(map(tuple, np.stack(columns, 1).tolist()))


def test_collocations_on_odd_rows(odd_docs, no_docs):
    rows = [(r["lang"], r["text"]) for r in odd_docs.collect()]
    assert sorted(tuple(r) for r in collocations.collocations(odd_docs, least=2).collect()) == brute_collocations(rows, 3, 2, 2000)
    assert collocations.collocations(no_docs).count() == 0


@pytest.mark.parametrize("small", [0, 1, 7, 4096])
def test_partitions_count_every_phrase_whatever_is_left_to_the_plain_sort(monkeypatch, small):
    monkeypatch.setattr(collocations, "SMALL", small)
    rng = np.random.default_rng(small)
    columns = [rng.integers(0 if k else 1, 6, 3000).astype(np.int32) for k in range(4)]
    for k in range(1, 4):
        columns[k][columns[k - 1] == 0] = 0
    weight, depth = rng.integers(1, 4, 3000), np.where(columns[0] == 2, 2, 1)
    want = Counter()
    for *words, n in zip(*[c.tolist() for c in columns], weight.tolist()):
        for k in range(1, 5):
            if words[k - 1] and (words[0] != 2 or k > 1):
                want[tuple(words[:k])] += n
    assert dict(collocations.phrase_partitions(columns, weight, depth, 12)) == {p: n for p, n in want.items() if n >= 12}
