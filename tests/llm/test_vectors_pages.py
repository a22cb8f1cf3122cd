"""Vector searches, rollups, pages and the language model against brute force, and on odd rows."""

import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from pairloom.llm import bilinear_lm, norm_topk, pruned_graph, queries, token_rollup, wrapper_html

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, shard int, rank int")


def lengths_of_all_sizes(n=900, d=8, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)).astype(np.float32) * rng.lognormal(0, 0.8, (n, 1)).astype(np.float32)
    x[100:140] = x[100]
    x[200] = 0
    return x


def brute_top(x, every, k, measure):
    out = {}
    for q in range(0, len(x), every):
        scores = measure(x, x[q])
        order = sorted((i for i in range(len(x)) if i != q), key=lambda i: (-scores[i], i))[:k]
        out[q] = [(i, scores[i]) for i in order]
    return out


@pytest.mark.parametrize("d", [2, 8])
def test_exact_top_k(spark, d, monkeypatch):
    monkeypatch.setattr(norm_topk, "SHARD_ROWS", 20)
    x = lengths_of_all_sizes(d=d)
    rows = norm_topk.search(vectors(spark, [(i, v.tolist(), 0, 0) for i, v in enumerate(x)]), every=30).collect()
    whole = np.floor(x.astype(np.float64) * 1024).astype(np.int64)
    want = brute_top(whole, 30, 10, lambda a, q: a @ q)
    got = {}
    for r in sorted(rows, key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert got == want


ODD_VECTORS = [(0, [1.0, 0.0], 0, 0), (1, None, 0, 0), (2, [None, 1.0], 0, 0), (3, [float("nan"), 1.0], 0, 0), (4, [float("inf"), 1.0], 0, 0), (5, [0.0, 0.0], 0, 0), (None, [1.0, 1.0], 0, 0), (6, [1.0, 0.0], 0, 0), (6, [1.0, 0.0], 0, 0), (100, [1e6, -1e6], 0, 0)]


def test_searches_on_odd_vectors(spark):
    rows = norm_topk.search(vectors(spark, ODD_VECTORS)).collect()
    assert [(r["rank"], r["vec_id"], r["score"]) for r in rows if r["query_id"] == 0] == [(1, 100, 1024 * 1024000000), (2, 6, 1 << 20), (3, 6, 1 << 20), (4, 5, 0)]
    assert norm_topk.search(vectors(spark, [])).count() == 0
    near = pruned_graph.nearest(vectors(spark, ODD_VECTORS)).collect()
    assert [(r["rank"], r["vec_id"]) for r in near if r["query_id"] == 0] == [(1, 100), (2, 6), (3, 6)]
    assert pruned_graph.nearest(vectors(spark, [])).count() == 0 and pruned_graph.nearest(vectors(spark, ODD_VECTORS[:1])).count() == 0


@pytest.mark.parametrize("unit", [True, False])
def test_graph_recall(spark, monkeypatch, unit):
    monkeypatch.setattr(pruned_graph, "SHARD_ROWS", 1000)
    rng = np.random.default_rng(5)
    x = (rng.normal(size=(2400, 16)) + 2 * rng.normal(size=(12, 16))[rng.integers(12, size=2400)]).astype(np.float32)
    x[500:800] = x[500]
    if unit:
        x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = pruned_graph.nearest(vectors(spark, [(i, v.tolist(), 0, 0) for i, v in enumerate(x)])).collect()
    want = brute_top(x.astype(np.float64), 20, 20, lambda a, q: a @ q)
    assert len(rows) == 120 * 20
    scores = {q: w[-1][1] for q, w in want.items()}
    assert np.mean([r["score"] >= scores[r["query_id"]] - 1e-9 for r in rows]) >= 0.9
    same = [r["vec_id"] for r in sorted(rows, key=lambda r: r["rank"]) if r["query_id"] == 600 and unit]
    assert not unit or same == [i for i in range(500, 520)]


def test_rollup_agrees_with_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    got = queries.op5_token_rollup(spark, sf_dir)
    want = con.execute(token_rollup.SQL)
    names = [d[0] for d in want.description]
    assert Counter(map(tuple, got.select(names).collect())) == Counter(want.fetchall())


def test_ledger_counts_a_batch_once(spark, odd_docs, no_docs, tmp_path):
    ledger = token_rollup.Ledger(spark, str(tmp_path / "ledger"))
    assert ledger.totals().count() == 0
    counts = token_rollup.counted(odd_docs, "words-1")
    assert ledger.commit("a", token_rollup.inserts(counts)) and not ledger.commit("a", token_rollup.inserts(counts))
    once = sorted(map(str, ledger.totals().collect()))
    (tmp_path / "ledger" / "deltas" / "torn").mkdir()
    assert sorted(map(str, ledger.totals().collect())) == once
    ledger.fold()
    ledger.fold()
    assert sorted(map(str, ledger.totals().collect())) == once and not ledger.commit("a", token_rollup.inserts(counts))
    assert ledger.commit("b", token_rollup.deletes(counts)) and ledger.totals().count() == 0
    assert token_rollup.maintained(no_docs).count() == 0 and token_rollup.maintained(odd_docs).count() > 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="single post"><header><h2>Site</h2></header>
<nav><ul><li><a href="/a">A</a></li></ul></nav><div class="cookie-notice">We use cookies</div><div id="content"><aside>Side</aside>
<article><header><h1>Title &amp; more</h1><span>by me</span></header><p><b>One   two<br>three <a href=x title="a > b">link</a><p>Four &eacute;&#x1F600;
five<ul><li>x<li>y</ul><form><input>F</form><div class="ad">Buy</div><section class="comments"><p>Nice!</p></section></article>
<article class="comment">me too</article></div><footer>&copy; F</footer>"""


def test_pages(spark):
    bare = "<html><body><div><a href=1>Home</a> <a href=2>About</a></div><div class=c1><h1>Head {i}</h1><p>Some words of page {i} that are long enough.</p></div><div>Same line</div></body></html>"
    rows = [(1, "http://H.example/1", PAGE, "x"), (2, None, None, "x"), (3, "http://h.example/2", "", "x"), (4, "nonsense", "plain &lt;text&gt; <", "x"), (1, "http://H.example/1", PAGE, "x")]
    rows += [(10 + i, f"https://user@bare.example:80/{i}?q", bare.replace("{i}", str(i)), "x") for i in range(12)]
    rows += [(50, "http://deep.example", "<div>" * 300 + "word " * 50000 + "</div>" * 300, "x"), (51, "http://quote.example", '<p class="a' * 2000, "x")]
    out = wrapper_html.extract(spark.createDataFrame(rows, "page_id long, url string, html string, host string")).collect()
    text = {r["page_id"]: r["text"] for r in out}
    assert len(out) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in out)
    assert text[1] == "Title & more\nOne two three link\nFour é😀 five\nx\ny"
    assert text[2] == text[3] == "" and text[4] == "plain <text> <"
    assert text[13] == "Head 3\nSome words of page 3 that are long enough." and len(text[50]) == 249999
    assert wrapper_html.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_copies_of_a_page_count_once(spark):
    page = "<html><body><div>Head {i}</div><div><p>Short words of {i}.</p><p>More of {i}.</p></div><footer>Visit {c}</footer></body></html>"
    rows = [(i * 1000 + c, f"http://five.example/{i}", page.replace("{i}", str(i)).replace("{c}", str(c))) for i in range(5) for c in range(60)]
    rows += [(9000 + c, "http://one.example/", page.replace("{i}", "one").replace("{c}", str(c))) for c in range(12)]
    text = {r["page_id"]: r["text"] for r in wrapper_html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(text[i * 1000 + c] == f"Head {i}\nShort words of {i}.\nMore of {i}." for i in range(5) for c in range(60))
    assert all(text[9000 + c] == "Head one\nShort words of one.\nMore of one." for c in range(12))


def test_pages_of_the_table(spark, sf_dir):
    """The given pages hold their article in an element of that name."""
    import html

    for r in queries.op8_html(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html"), "page_id").collect():
        article = re.search("<article>(.*?)</article>", r["html"], re.S)[1]
        lines = [re.sub(r"\s+", " ", html.unescape(re.sub("<[^>]+>", "", x))).strip() for x in re.split("</?(?:p|h1)>", article)]
        assert r["text"] == "\n".join(x for x in lines if x)


def test_wrappers_align_streams():
    a, b = ["n", "h", "p", "p", "p", "f"], ["n", "q", "h", "p", "f", "i", "t", "i", "t"]
    w = wrapper_html.folded(wrapper_html.aligned(wrapper_html.folded(a), wrapper_html.folded(b)))
    assert wrapper_html.text_of(w) == "n (q)? h (p)+ f ((i t)+)?" and wrapper_html.parsed(wrapper_html.text_of(w)) == w
    assert wrapper_html.slots(w) == ["n", "q", "h", "p", "f", "i", "t"]


def brute_base(docs):
    count, total = Counter(), 0
    tokens = [(d, WORD.findall((t or "").translate(LOWER)) + [" "]) for d, t in docs]
    for d, words in tokens:
        if d is not None and zlib.crc32(str(d).encode()) % 10:
            count.update(words)
            total += len(words)
    return [(d, len(w), sum(count[x] > 0 for x in w), total, sum(math.log10((count[x] + 0.1) / (total + 0.1 * (len(count) + 1))) for x in w)) for d, w in tokens]


def test_language_model(spark, sf_dir):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    rows = {r["doc_id"]: r for r in queries.op9_bilinear_lm(spark, sf_dir).collect()}
    for d, n, known, total, base in brute_base(docs):
        r = rows[d]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (n, known, total) and r["base_score"] == pytest.approx(base, rel=1e-9)
        assert r["held_out"] == (zlib.crc32(str(d).encode()) % 10 == 0)


def test_language_model_beats_the_base_on_held_out_documents(spark):
    """200 documents are too few to learn from; 1000 are enough."""
    held = [r for r in queries.op9_bilinear_lm(spark, "/root/testdata/sf0.01").collect() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_language_model_on_odd_rows(odd_docs, no_docs):
    rows = bilinear_lm.score(odd_docs).collect()
    want = brute_base([(r["doc_id"], r["text"]) for r in odd_docs.collect()])
    got = sorted((r["doc_id"] or 0, r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in rows)
    assert got == sorted((d or 0, n, k, t, round(b, 6)) for d, n, k, t, b in want)
    assert bilinear_lm.score(no_docs).count() == 0


def test_probabilities_add_up(spark):
    docs = spark.createDataFrame([(i, " ".join(np.random.default_rng(i).choice(["a", "b", "c", "d"], 30))) for i in range(40)], "doc_id long, text string")
    coded = bilinear_lm.blocks(docs)
    from pyspark.sql import functions as F

    words = coded.select(F.explode(F.arrays_zip("words", "trained")).alias("w")).select(F.col("w.words").alias("word"), F.col("w.trained").alias("n"))
    model, facts = bilinear_lm.train(coded, words.groupBy("word").agg(F.sum("n").alias("c")))
    last, before, norm = model.tables()
    total = np.exp(last[:, None, :] + before[None, :, :] - norm[:, :, None]).sum(axis=2)
    assert np.allclose(total, 1) and facts["rest_n"] == 0 and len(model.words) == 5


def test_words_without_a_class_are_told_from_their_contexts_and_tell_what_follows(spark, monkeypatch):
    """Both texts have the same words and classes; only the own vectors of the words without a class set them apart."""
    monkeypatch.setattr(bilinear_lm, "CLASSES", 5)
    rng, rows = np.random.default_rng(4), []
    for i in range(400):
        odd = rng.integers(0, 2, 20)
        rows.append((i, " ".join(f"{'ab'[o]} r{2 * rng.integers(0, 20) + o} {'cd'[o]}" for o in odd)))
    held = [i for i in range(1000, 1100) if zlib.crc32(str(i).encode()) % 10 == 0][:2]
    told, turned = "a r0 c b r1 d", "a r1 c b r0 d"
    docs = spark.createDataFrame([*rows, (held[0], told), (held[1], turned)], "doc_id long, text string")
    scores = {r["doc_id"]: r for r in bilinear_lm.score(docs).collect()}
    assert scores[held[0]]["base_score"] == pytest.approx(scores[held[1]]["base_score"])
    assert scores[held[0]]["score"] > scores[held[1]]["score"] + 1


def made_group(words=500, classes=7, seed=8):
    """A model of some classes and the places of the words of a group, which come in different contexts."""
    rng = np.random.default_rng(seed)
    counts = rng.integers(50, 500, classes - 1).astype(float)
    model = bilinear_lm.Model.fresh([f"c{i}" for i in range(classes - 1)], counts, 900)
    model.target = rng.normal(0, 0.5, model.target.shape)
    frame = bilinear_lm.Frame.of(model, {"top": list(counts), "rest_n": 900})
    word = np.repeat(np.arange(words), rng.geometric(0.2, words) - 1)
    before, after = (word + rng.integers(0, 3, len(word))) % (classes + 1), (word // 3 + rng.integers(0, 2, len(word))) % (classes + 1)
    return model, frame, (word, before, after, words)


def test_words_of_a_group_add_up_and_so_do_the_classes_after_them():
    model, frame, group = made_group()
    c, context, context_unit, target, target_unit, norm = bilinear_lm.own_vectors(*group, frame)
    assert c.tolist() == np.bincount(group[0], minlength=group[3]).tolist() and target.any() and not target[c == 0].any()
    share = np.where(c > 0, c + bilinear_lm.ALPHA, 0)
    assert np.allclose(share / share.sum() @ np.exp(target * target_unit @ frame.seen.T), np.exp(norm))
    rest = len(model.words)
    kind, own = np.array([*range(rest), *[rest] * group[3], rest + 1]), np.zeros((rest + group[3] + 1, bilinear_lm.OWN))
    own[rest:-1] = context * context_unit
    rng = np.random.default_rng(0)
    one, two = rng.integers(0, len(kind), (2, 300))
    for scale in (1, 40):  # the second one leaves the range of single precision
        total = sum(np.exp(bilinear_lm._class_scores(model, frame, model.tables(), kind, own * scale, one, two, np.full(300, k))) for k in range(rest + 1))
        assert np.allclose(total, 1, atol=1e-4)


def test_words_in_the_same_places_share_a_fit_and_nothing_else_does(monkeypatch):
    _, frame, group = made_group()
    shared = bilinear_lm.own_vectors(*group, frame)
    monkeypatch.setattr(bilinear_lm, "FEW", 0)
    for a, b in zip(shared, bilinear_lm.own_vectors(*group, frame)):
        assert np.allclose(a, b, atol=1)  # vectors in units of 8 bits


def test_blocks_of_few_tokens_hold_every_word(spark, odd_docs, monkeypatch):
    want = sorted((r["doc_id"] or 0, r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in bilinear_lm.score(odd_docs).collect())
    monkeypatch.setattr(bilinear_lm, "BLOCK_TOKENS", 5)
    monkeypatch.setattr(bilinear_lm, "PIECE_BYTES", 20)
    monkeypatch.setattr(bilinear_lm, "GROUP_ROWS", 3)
    assert sorted((r["doc_id"] or 0, r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in bilinear_lm.score(odd_docs).collect()) == want


def test_a_batch_committed_beside_a_fold_counts_once(spark, tmp_path):
    counts = spark.createDataFrame([("s", "en", "words-1", 3, 9)], "source string, lang string, tokenizer string, tokens long, chars long")

    class Beside(token_rollup.Ledger):
        """Another driver commits as soon as the fold has listed its batches."""

        late = False

        def batches(self):
            names = super().batches()
            if not self.late:
                self.late = True
                token_rollup.Ledger(self.spark, self.path).commit("late", token_rollup.inserts(counts))
            return names

    ledger = Beside(spark, f"file://{tmp_path}/ledger")
    ledger.late = True
    ledger.commit("first", token_rollup.inserts(counts))
    ledger.late = False
    ledger.fold()
    for _ in range(2):
        assert [tuple(r) for r in ledger.totals().collect()] == [("s", "en", "words-1", 2, 6, 18)]
        ledger.fold()
