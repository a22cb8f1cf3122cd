"""Operators on documents against brute force, and on odd rows."""

import base64
import hashlib
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from pairloom.llm import byte_bpe, kernel_quality, mixing, pii_bootstrap, queries, simhash_pivots
from pairloom.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_fingerprint(text):
    words = WORD.findall((text or "").translate(LOWER))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(pairs):
    """(id, fingerprint) -> smallest id reachable over links of 2 or fewer bits."""
    prints = sorted({f for _, f in pairs})
    root = {f: f for f in prints}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for i, a in enumerate(prints):
        for b in prints[i + 1 :]:
            if (a ^ b).bit_count() <= 2:
                root[find(a)] = find(b)
    least = defaultdict(list)
    for d, f in pairs:
        if d is not None:
            least[find(f)].append(d)
    return {f: min(least[find(f)], default=None) for f in prints}


def test_simhash_agrees_with_brute_force(spark, sf_dir, texts):
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.op1_simhash(spark, sf_dir).collect()}
    prints = [(d, brute_fingerprint(t)) for d, t in texts]
    least = brute_components(prints)
    assert got == {d: (f"{f:016x}", least[f]) for d, f in prints}


def test_simhash_on_odd_rows(odd_docs, no_docs):
    rows = simhash_pivots.near_duplicates(odd_docs).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(r["doc_id"] for r in odd_docs.collect())
    of = {r["doc_id"]: r for r in rows}
    assert of[1]["component_id"] == of[5]["component_id"] == of[9]["component_id"] == 1
    assert of[2]["component_id"] == of[3]["component_id"] == of[4]["component_id"] == 2 and of[2]["fingerprint"] == "0" * 16
    assert of[None]["component_id"] is None
    assert simhash_pivots.near_duplicates(no_docs).count() == 0


@pytest.mark.parametrize("hot", [20000, 8, 2])
def test_links_lose_nothing_when_buckets_are_dealt_again(spark, hot):
    rng = np.random.default_rng(1)
    centre = int(rng.integers(1 << 62))
    prints = {centre ^ sum(1 << int(b) for b in rng.choice(12, rng.integers(0, 6), replace=False)) for _ in range(150)}
    prints |= {int(x) for x in rng.integers(0, 1 << 63, 100, np.uint64)}
    prints |= {p ^ 1 << 60 ^ 1 << 3 for p in list(prints)[:20]}
    signed = [int(np.uint64(p).astype(np.int64)) for p in prints]
    nodes = spark.createDataFrame([(s, [s]) for s in signed], "node long, words array<bigint>")
    got = {(r["node"], r["root"]) for r in components(simhash_pivots.links(nodes, simhash_pivots.exact_levels(), hot)).collect()}
    roots = {}
    for node, root in got:
        roots.setdefault(root, set()).add(node)
    brute = brute_components([(s, s & (1 << 64) - 1) for s in signed])
    want = {}
    for s in signed:
        want.setdefault(brute[s & (1 << 64) - 1], set()).add(s)
    assert {frozenset(v) for v in roots.values()} == {frozenset(v) for v in want.values() if len(v) > 1}


def test_keep_one_drops_near_copies_only(spark):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(3000)]
    base = [rng.choice(words, 300).tolist() for _ in range(60)]
    docs = [(i, " ".join(b)) for i, b in enumerate(base)]
    for i, b in enumerate(base[:30]):
        copy = list(b)
        for at in rng.choice(300, 3, replace=False):
            copy[at] = "changed"
        docs.append((100 + i, " ".join(copy)))
    left = {r["doc_id"] for r in simhash_pivots.keep_one(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert set(range(60)) <= left and len(left - set(range(60))) <= 1


def jaccard(a, b, k=5):
    a, b = ({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} for w in (a.split(), b.split()))
    return len(a & b) / len(a | b)


def copies_at(rng, low, high, groups, length=300):
    """Pairs of texts with a similarity in [low, high), by changed words."""
    out = []
    while len(out) < groups:
        base = rng.integers(0, 100_000, length).astype(str).tolist()
        copy = list(base)
        for at in rng.permutation(length):
            copy[at] = "changed"
            s = jaccard(" ".join(base), " ".join(copy))
            if s < high:
                if s >= low:
                    out.append((" ".join(base), " ".join(copy)))
                break
    return out


@pytest.mark.parametrize("hot", [20000, 40])
def test_keep_one_goes_by_the_similarity_of_shingles(spark, hot):
    rng = np.random.default_rng(5)
    alike, unlike = copies_at(rng, 0.8, 0.82, 300), copies_at(rng, 0.76, 0.8, 300)
    docs = [(2 * i + j, t) for i, pair in enumerate(alike + unlike) for j, t in enumerate(pair)]
    left = {r["doc_id"] for r in simhash_pivots.keep_one(spark.createDataFrame(docs, "doc_id long, text string"), hot=hot).collect()}
    assert set(range(600, 1200)) <= left and set(range(0, 600, 2)) <= left
    assert len(left & set(range(1, 600, 2))) <= 3


def test_pairs_of_blocks_lose_no_pair_of_a_crowded_key(spark):
    rng = np.random.default_rng(9)
    centre = rng.integers(0, 1 << 63, 4, np.uint64)
    words = [centre ^ simhash_pivots._mask(rng.choice(256, rng.integers(0, 8), replace=False), 4) for _ in range(300)]
    nodes = spark.createDataFrame([(i, w.view(np.int64).tolist(), i) for i, w in enumerate(words)], "node long, words array<bigint>, root long")
    families = simhash_pivots.sampled_families(4, 20, 3, 39)
    whole, split = ({tuple(sorted(r)) for r in simhash_pivots.links(nodes, families, hot).collect()} for hot in (20_000, 16))
    assert whole == split and len(whole) > 300 * 299 / 4


def test_a_link_that_does_not_hold_does_not_hide_others(spark):
    a = [f"a{i}" for i in range(300)]
    star, tail = list(a), [f"t{i}" for i in range(34)]
    docs = [(i, " ".join(star + tail[:1] + [f"v{i}x{j}" for j in range(60)])) for i in range(30)]
    docs += [(100 + i, t + " end") for i, t in docs]
    left = {r["doc_id"] for r in simhash_pivots.keep_one(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert left == set(range(30))


def test_a_group_dealt_to_blocks_has_the_same_links(spark):
    """Sets around one centre, some at 0.8 of each other and some not: brute force, a group in one task, and one in blocks agree."""
    rng = np.random.default_rng(13)
    centre = rng.integers(0, 1 << 40, 120)
    sets = [np.unique(np.concatenate([rng.permutation(centre)[rng.integers(0, 24) :], rng.integers(1 << 41, 1 << 42, rng.integers(0, 9))])) for _ in range(120)]
    sets += [np.empty(0, np.int64), sets[0][:1], np.array([5], np.int64)]
    pairs = [(a, b) for a in range(len(sets)) for b in range(a) if (both := len(np.intersect1d(sets[a], sets[b]))) * 10 >= 8 * (len(sets[a]) + len(sets[b]) - both)]
    joined = lambda links: {frozenset(v) for v in _groups(range(len(sets)), links)}
    whole = simhash_pivots._alike(pd.DataFrame({"node": range(len(sets)), "set": sets}))
    assert joined(zip(whole["u"], whole["v"])) == joined(pairs) and 1 < len(joined(pairs)) < len(sets)
    rows = spark.createDataFrame([(i, 7, s.tolist()) for i, s in enumerate(sets)], "node long, key long, set array<long>")
    dealt = simhash_pivots._in_blocks(rows, 2000, F.size("set"))
    assert dealt.select("key").distinct().count() > 10
    assert joined((r["u"], r["v"]) for r in dealt.groupBy("key").applyInPandas(simhash_pivots._alike, "u long, v long").collect()) == joined(pairs)


def _groups(nodes, links):
    group = {n: {n} for n in nodes}
    for a, b in links:
        if group[a] is not group[b]:
            group[a] |= group[b]
            for n in group[b]:
                group[n] = group[a]
    return {id(g): g for g in group.values()}.values()


def test_more_fingerprints_get_longer_keys_and_more_of_them():
    assert simhash_pivots.widened(1000, 14, 96) == simhash_pivots.widened(1 << 21, 14, 96) == (14, 96)
    assert simhash_pivots.widened(1 << 23, 14, 96) == (16, 150) and simhash_pivots.widened(1 << 35, 14, 96)[0] == 28


def test_links_deal_out_a_small_table_and_count_only_heavy_keys(spark, monkeypatch):
    """A table of one partition has many times as many keys; they are made in more tasks, and none is counted alone where no key is crowded."""
    rng = np.random.default_rng(3)
    words = rng.integers(0, 1 << 63, (400, 4), np.uint64)
    words[200:] = words[:200] ^ np.uint64(5)
    nodes = spark.createDataFrame([(i, w.view(np.int64).tolist()) for i, w in enumerate(words)], "node long, words array<bigint>").coalesce(1)
    parts, written, keyed, pinned = [], [], simhash_pivots._keyed, simhash_pivots.pinned
    monkeypatch.setattr(simhash_pivots, "_keyed", lambda df, families: parts.append(df.rdd.getNumPartitions()) or keyed(df, families))
    monkeypatch.setattr(simhash_pivots, "pinned", lambda df: written.append(df.columns) or pinned(df))
    families = simhash_pivots.sampled_families(4, 14, 20, 60)[0]
    for hot, counted in ((20_000, False), (6000, False), (2, True)):
        written.clear()
        pairs = {tuple(sorted(r)) for r in simhash_pivots.links(nodes, [families], hot).collect()}
        assert pairs == {(i, i + 200) for i in range(200)} and (["key", "blocks"] in written) == counted
    assert min(parts) >= 4


def test_sets_are_shuffled_once(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (1, "g h i j k l"), (2, "A B C D E F"), (3, "m n o p q r"), (4, "s t")], "doc_id long, text string")
    node = lambda t: int(np.uint64(xxhash.xxh64_intdigest(simhash_pivots.shingle_set(t, 5).tobytes(), 42)).view(np.int64))
    members = spark.createDataFrame([(1, node("a b c d e f"), 7), (3, node("m n o p q r"), 7), (4, node("s t"), 8)], "doc_id long, node long, key long")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        sets = simhash_pivots._sets(docs, members, 5)
        plan = sets._jdf.queryExecution().executedPlan().toString()
        got = {(r["node"], r["key"], tuple(r["set"])) for r in sets.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert got == {(node(t), k, tuple(simhash_pivots.shingle_set(t, 5).view(np.int64).tolist())) for t, k in (("a b c d e f", 7), ("m n o p q r", 7), ("s t", 8))} and sets.count() == 3
    assert not re.search(r"hashpartitioning\(doc_id#\d+L?, node", plan)


def test_repeated_shingles_count_once(spark):
    docs = [(1, "a b c d e " * 400), (2, "a b c d e " * 400 + " ".join(f"w{i}" for i in range(60))), (3, "a b c d e " * 300), (3, "other words under this id that is there twice")]
    left = sorted(r["doc_id"] for r in simhash_pivots.keep_one(spark.createDataFrame(docs, "doc_id long, text string")).collect())
    assert left == [1, 2]


def brute_mix(docs, max_epochs=3):
    size = defaultdict(int)
    for _, text, source in docs:
        size[source] += len(WORD.findall(text or ""))
    order = sorted(size, key=lambda s: (s is None, [ord(c) for c in s or ""]))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    total, clamped = sum(size.values()), set()
    while True:
        free = total - sum(max_epochs * size[s] for s in clamped)
        weights = sum(weight[s] for s in order if s not in clamped)
        over = {s for s in order if s not in clamped and weight[s] * free > max_epochs * size[s] * weights}
        if not over:
            return size, {s: float(max_epochs * size[s]) if s in clamped else weight[s] * free / weights for s in order}
        clamped |= over


def test_mixing(spark, sf_dir):
    docs = [(r["doc_id"], r["text"], r["source"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    size, target = brute_mix(docs)
    rows = mixing.mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).collect()
    taken, most = defaultdict(int), defaultdict(int)
    for r in rows:
        assert r["source_size"] == size[r["source"]] and r["target"] == pytest.approx(target[r["source"]], rel=1e-12)
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
        most[r["source"]] = max(most[r["source"]], r["size"])
    assert len(rows) == len(docs)
    assert all(abs(taken[s] - target[s]) <= most[s] for s in target)
    again = mixing.mix(spark.read.parquet(f"{sf_dir}/documents.parquet").repartition(7)).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))


def test_mixing_on_odd_rows(odd_docs, no_docs):
    rows = mixing.mix(odd_docs).collect()
    size, target = brute_mix([(r["doc_id"], r["text"], r["source"]) for r in odd_docs.collect()])
    assert {r["source"]: r["target"] for r in rows} == pytest.approx(target) and len(rows) == 12
    assert mixing.mix(no_docs).count() == 0
    copies = Counter(r["doc_id"] for r in mixing.mixed_rows(odd_docs).collect())
    taken = {r["doc_id"]: r for r in rows}
    assert all(copies[d] * r["size"] == r["taken"] for d, r in taken.items() if d != 5 and r["size"])


@pytest.fixture(scope="module")
def bpe():
    with open(queries.VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def digest(b):
    return hashlib.sha256(b).hexdigest()


def test_bpe(spark, sf_dir, texts, bpe):
    got = {r["doc_id"]: tuple(r)[1:] for r in queries.op6_byte_bpe(spark, sf_dir).collect()}
    for d, t in texts:
        ids = bpe.encode_ordinary(t or "")
        assert got[d] == (len(ids), digest(",".join(map(str, ids)).encode()), digest((t or "").encode()))


def test_bpe_on_odd_rows(odd_docs, no_docs, bpe):
    rows = byte_bpe.encode(odd_docs, queries.VOCABULARY, public_tokenizers.PATTERN).collect()
    assert sorted((r["doc_id"] or 0, r["ids"], r["decoded"]) for r in rows) == sorted((r["doc_id"] or 0, bpe.encode_ordinary(r["text"] or ""), r["text"] or "") for r in odd_docs.collect())
    assert byte_bpe.encode(no_docs, queries.VOCABULARY, public_tokenizers.PATTERN).count() == 0


def test_bpe_leaves_nothing_in_the_workers(spark, odd_docs):
    """Spark keeps a worker for the tasks of other stages; encoders of tasks that are over would count beside their memory."""
    assert byte_bpe.encode(odd_docs, queries.VOCABULARY, public_tokenizers.PATTERN).agg(F.sum("n_tokens")).first()[0] > 0

    def held(batches):
        for pdf in batches:
            yield pd.DataFrame({"n": [len(byte_bpe.Encoder._made)] * len(pdf)})

    assert {r["n"] for r in spark.range(64, numPartitions=8).mapInPandas(held, "n int").collect()} == {0}


def test_bpe_pieces(bpe):
    odd = ["  a  b \n\n c\t\td   ", "don't  it's 'S", "\x1c x\x1dy \x85z  q", "ab" * 300, "12 34  5.6,7", "😀 é 漢字. ☃", "x\n y \n\n  z", " .,", "a.'s b,'t", "²., x². y"]
    encoder = byte_bpe.Encoder.of(queries.VOCABULARY, public_tokenizers.PATTERN)
    for text, (ids, n, back) in zip(odd, encoder.texts(odd)):
        want = bpe.encode_ordinary(text)
        assert (ids, n, back) == (",".join(map(str, want)), len(want), text.encode())


def test_bpe_on_random_texts(bpe, monkeypatch):
    """Texts are cut before their pieces are sought: never inside a piece, whatever stands beside the cut, and with few chunks kept."""
    monkeypatch.setattr(byte_bpe, "KEPT", 50)
    draw = random.Random(6)
    signs = list("abXY  \n\n\t\r\x0b\x1c\x7f.,,'’s0129²½éÉ×÷—\u00a0\u0085\u1680\u2009\u2028\u3000\ufeff漢😀कЖ҂Աʰʹ") + ["'re", "'s", " the", " don't", "\n\n", " \n", "tion"]
    odd = ["".join(draw.choices(signs, k=draw.randint(0, 14))) for _ in range(9000)]
    encoder = byte_bpe.Encoder(queries.VOCABULARY, public_tokenizers.PATTERN)
    for at in range(0, len(odd), 3000):
        part = odd[at : at + 3000]
        for text, (ids, n, back) in zip(part, encoder.texts(part), strict=True):
            want = bpe.encode_ordinary(text)
            assert (ids, n, back) == (",".join(map(str, want)), len(want), text.encode()), text


def test_bpe_repeated_words_cost_little():
    """A word that is known already takes little more than the pattern alone takes to find it, or less."""
    draw = random.Random(6)
    words = ["".join(draw.choices("abcdefgh", k=4)) for _ in range(2000)]
    text = " ".join(draw.choices(words, k=400_000))
    encoder = byte_bpe.Encoder(queries.VOCABULARY, public_tokenizers.PATTERN)
    assert next(encoder.texts([text]))[2] == text.encode()

    def seconds(work):
        took = []
        for _ in range(3):
            began = time.process_time()
            work()
            took.append(time.process_time() - began)
        return min(took)

    assert seconds(lambda: list(encoder.texts([text]))) < 1.5 * seconds(lambda: encoder.pieces.findall(text))


def test_quality(spark, sf_dir):
    rows = queries.op7_quality(spark, "/root/testdata/sf0.01").collect()
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    held = [(r["predicted"], labels[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert np.mean([a == b for a, b in held]) >= 0.95


def test_quality_on_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (3, 0), (7, None), (99, 1), (None, 0)], "doc_id long, quality int")
    assert kernel_quality.classify(odd_docs, labels).count() == 12
    assert {r["score"] for r in kernel_quality.classify(odd_docs, labels.limit(0)).collect()} == {0.5}
    assert kernel_quality.classify(no_docs, labels).count() == 0


def test_isotonic_pools_violators():
    steps, values = kernel_quality.isotonic(np.arange(5.0), np.array([0, 1, 0, 1, 1.0]), np.ones(5))
    assert values.tolist() == [0, 0, 0.5, 0.5, 1, 1] and (np.diff(values) >= 0).all() and steps[0] == 0


BASE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"), "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def luhn(digits):
    return sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def brute_spans(text):
    out = []
    for rank, (kind, pattern) in enumerate(BASE.items()):
        for m in pattern.finditer(text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and max(int(x) for x in m[0].split(".")) > 255 or kind == "card" and not (14 <= len(digits) <= 19 and luhn(digits)) or kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), rank, m.end(), kind))
    return sorted(out)


def listed(spans):
    return ",".join(f"{k}:{s}:{e}" for s, _, e, k in spans)


def test_personal_data(spark, sf_dir, texts):
    rows = {r["doc_id"]: r for r in queries.op10_pii(spark, sf_dir).collect()}
    for d, t in texts:
        spans = brute_spans(t)
        assert rows[d]["base_sha256"] == digest(listed(spans).encode())
        assert [rows[d][f"n_{k}"] for k in BASE] == [sum(s[3] == k for s in spans) for k in BASE]
        assert set(filter(None, listed(spans).split(","))) <= set(rows[d]["spans"].split(","))


IDENTIFIERS = [
    "a@b.c_d@e.f", "x@y", "é😀 a.b+c@d-e.f.g. 1.2.3.4.5.6.7.8 256.1.1.1 001.02.3.4", "4111 1111 1111 1111", "4111-1111-1111-1112", "4111  1111 1111 1111", "5 4111111111111111",
    "+1 (988) 555-2485. +49 30 12345678-", "+1 2", "+1234567890123456", "4242424242424242-", "1" * 5000, "+1" + " " * 3000, "a" * 5000, "9.9.9.9 " * 300, "4111111111111111,4111111111111111", "+14111111111111111", None, "",
]


def test_base_spans_of_odd_texts(spark):
    docs = spark.createDataFrame(list(enumerate(IDENTIFIERS)), "doc_id long, text string")
    for r in pii_bootstrap.find(docs).collect():
        assert r["spans"] == listed(brute_spans(IDENTIFIERS[r["doc_id"]])), IDENTIFIERS[r["doc_id"]]


def test_patterns_discover_unseen_identifiers(spark):
    docs = [(i, f"lorem ipsum write to clerk{i}@mail.example.com dolor") for i in range(20)]
    docs += [(100 + i, f"Please write to: member-55{i}01 dolor") for i in range(3)]
    docs += [(200 + i, f"please  write to\tmember-77{i}01 dolor") for i in range(3)] + [(300, "version 20240101x is out")]
    got = {r["doc_id"]: r["spans"] for r in pii_bootstrap.find(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert all(got[200 + i] == "context:17:29" for i in range(3))
    assert got[300] == "" and all(got[i].startswith("email:") and "," not in got[i] for i in range(20))
    clean = {r["doc_id"]: r["text"] for r in pii_bootstrap.redacted(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert clean[0] == "lorem ipsum write to [EMAIL] dolor" and clean[200] == "please  write to\t[CONTEXT] dolor" and clean[300] == docs[-1][1]


def test_personal_data_on_odd_rows(odd_docs, no_docs):
    assert pii_bootstrap.find(odd_docs).count() == 12 and pii_bootstrap.find(no_docs).count() == 0
    rows = {r["doc_id"]: r for r in pii_bootstrap.redacted(odd_docs).collect()}
    assert rows[2]["text"] is None and rows[6]["text"].endswith("mail [EMAIL]") and rows[6]["n_chars"] == len(rows[6]["text"]) and rows[1]["label"] == 1


def test_mixing_agrees_with_sql(spark, sf_dir, odd_docs):
    import duckdb
    rows = [tuple(r)[:5] for r in odd_docs.collect()]

    for docs, create in (
        (spark.read.parquet(f"{sf_dir}/documents.parquet"), f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'"),
        (odd_docs, "CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)"),
    ):
        con = duckdb.connect()
        con.execute(create)
        if docs is odd_docs:
            con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", rows)
        want = Counter(con.execute(mixing.SQL).fetchall())
        assert Counter(map(tuple, mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken").collect())) == want


def test_a_chain_of_contexts_is_followed_to_its_end(spark):
    """Each context is confident only through the identifiers that the one before it added."""
    docs, links = [], 7
    for i in range(15):
        docs.append(f"call pa0 pb0 user{i}@example.org now")
    for k in range(links):
        for i in range(10):
            docs.append(f"call pa{k} pb{k} ID{k}{i:04d} now")
            docs += [f"else pa{k + 1} pb{k + 1} ID{k}{i:04d} there {j}" for j in range(2)]
    rows = pii_bootstrap.find(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")).collect()
    missed = [docs[r["doc_id"]] for r in rows if r["spans"] == ""]
    assert not missed


def test_a_word_cut_by_the_reach_is_no_pattern(spark):
    """The two words before these identifiers are longer than the reach, and their ends are alike."""
    long = "x" * 70
    docs = [(i, f"{long} word user{i}@example.org") for i in range(10)] + [(100 + i, f"z{long} word ID1234{i} end") for i in range(3)]
    docs += [(200 + i, f"{'y' * 30} {'v' * 20} user{i}@example.org") for i in range(10)] + [(300, f"a b {'y' * 30} {'v' * 20} ID123456")]
    got = {r["doc_id"]: r["spans"] for r in pii_bootstrap.find(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert all(got[100 + i] == "" for i in range(3)) and got[300] == "context:56:64"
