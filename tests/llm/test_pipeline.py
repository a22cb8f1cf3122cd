"""The pipeline stage by stage against plain Python, and as a whole."""

import hashlib
from collections import Counter, defaultdict

import pytest
import tiktoken
from pyspark.sql import functions as F
from test_documents import WORD, brute_mix, brute_spans

import corpus_pipeline
from pairloom.llm import byte_bpe, kernel_quality, simhash_pivots
from pairloom.session import pinned

STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    """Rows before the first stage and after each."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(pinned(stage(spark, out[-1], sf_dir)))
    return out


def rows(df):
    return [r.asDict() for r in df.collect()]


def test_stages_return_the_columns_of_documents(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_copies", "personal_data", "mixture", "token_ids"]
    assert all(s.columns == stages[0].columns for s in stages[1:5])


def test_quality_keeps_what_the_model_accepts(spark, sf_dir, stages):
    stats = pinned(kernel_quality.with_statistics(stages[0].select("doc_id", "text")))
    model = kernel_quality.learn(stats, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    want = [r for r in rows(stages[0]) if model.score(kernel_quality.statistics(r["text"])[None, :])[0] >= kernel_quality.THRESHOLD]
    assert sorted(map(str, rows(stages[1]))) == sorted(map(str, want)) and 0 < len(want) < stages[0].count()


def test_one_of_each_group_of_near_copies_stays(stages):
    before, kept = {r["doc_id"]: r["text"] for r in rows(stages[1])}, {r["doc_id"] for r in rows(stages[2])}
    prints = {d: simhash_pivots.fingerprint(t, 5, 4) for d, t in before.items()}
    far = {a: min((sum((x ^ y).bit_count() for x, y in zip(prints[a], prints[b])) for b in before if b != a), default=256) for a in before}
    for a in before:
        if far[a] > simhash_pivots.WIDE["radius"]:
            assert a in kept
    for a in kept:
        for b in kept:
            assert a == b or sum((x ^ y).bit_count() for x, y in zip(prints[a], prints[b])) > 20


def test_personal_data_goes(stages):
    before = {r["doc_id"]: r for r in rows(stages[2])}
    for r in rows(stages[3]):
        text, at, out = before[r["doc_id"]]["text"] or "", 0, ""
        for start, _, end, kind in brute_spans(text):
            if start >= at:
                out += text[at:start] + f"[{kind.upper()}]"
            at = max(at, end)
        assert r["text"] == out + text[at:] and r["n_chars"] == (len(r["text"]) if r["text"] != text else before[r["doc_id"]]["n_chars"])


def test_sources_come_near_their_targets(stages):
    before = rows(stages[3])
    size, target = brute_mix([(r["doc_id"], r["text"], r["source"]) for r in before])
    longest, taken = defaultdict(int), defaultdict(int)
    for r in before:
        longest[r["source"]] = max(longest[r["source"]], len(WORD.findall(r["text"])))
    after = rows(stages[4])
    for r in after:
        taken[r["source"]] += len(WORD.findall(r["text"]))
    assert all(abs(taken[s] - target[s]) <= longest[s] for s in target)
    assert max(Counter(r["doc_id"] for r in after).values()) <= 3 and {str(r) for r in after} <= {str(r) for r in before}


def test_token_ids(stages):
    encoder = byte_bpe.Encoder.of(corpus_pipeline.VOCABULARY, corpus_pipeline.public_tokenizers.PATTERN)
    bpe = tiktoken.Encoding("own", pat_str=corpus_pipeline.public_tokenizers.PATTERN, mergeable_ranks=encoder.ranks, special_tokens={})
    want = Counter((r["doc_id"], tuple(bpe.encode_ordinary(r["text"])), hashlib.sha256(r["text"].encode()).hexdigest()) for r in rows(stages[4]))
    assert Counter((r["doc_id"], tuple(r["ids"]), r["decoded_sha256"]) for r in rows(stages[5])) == want


def test_run_applies_the_stages(spark, sf_dir, stages):
    assert Counter(map(str, rows(corpus_pipeline.run(spark, sf_dir)))) == Counter(map(str, rows(stages[5])))


def test_stages_on_odd_rows(spark, sf_dir, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        for _, stage in corpus_pipeline.STAGES:
            docs = pinned(stage(spark, docs, sf_dir))
    out = corpus_pipeline.near_copies(spark, odd_docs, sf_dir)
    ids = Counter(r["doc_id"] for r in out.collect())
    assert ids[1] == 1 and ids[5] == ids[9] == 0 and ids[None] == 1 and ids[8] == ids[6] == 1


@pytest.mark.parametrize("name", ["quality", "near_copies", "personal_data", "mixture"])
def test_stages_stand_columns_with_their_own_names(spark, sf_dir, name):
    """Columns named as a stage names its own come back as they went in."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    own = ["_stats", "_score", "_s", "_whole", "_size", "_c1", "_copies", "_s_email", "_th", "_base", "_all", "node", "words", "root", "key.x"]
    more = docs.select("*", *[F.concat(F.lit(c), F.col("doc_id")).alias(c) for c in own])
    out = STAGES[name](spark, more, sf_dir)
    assert out.columns == more.columns
    got = rows(out)
    assert got and all(r[c] == f"{c}{r['doc_id']}" for r in got for c in own)
    plain = rows(STAGES[name](spark, docs, sf_dir))
    assert sorted(str([r[c] for c in docs.columns]) for r in got) == sorted(str([r[c] for c in docs.columns]) for r in plain)
