"""BPE against the tokenizer library, the source mix against a plain computation, the pipeline."""

import random

import duckdb
import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from tests.llm import cases
from tidepair.llm import bpe, quality_rules, queries, source_mix
from tidepair.session import stage


@pytest.fixture(scope="module")
def library():
    ranks = bpe.load_ranks(public_tokenizers.path(bpe.RANKS))
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_ids_match_the_library(library):
    encoder, decoder = bpe.tokenizer(public_tokenizers.path(bpe.RANKS), public_tokenizers.PATTERN)
    rng = random.Random(3)
    alphabets = ["ab", "aab ", "abcdefghijklmnopqrstuvwxyz ", "éèêàüßñ aei", "\n\t  x", "0123456789", "中文字日本語 한국", "!?.,-=_*#'", "😀🎉👨‍👩‍👧 a", "\x00\x1c\x85  z"]
    for _ in range(3000):
        text = "".join(rng.choice(rng.choice(alphabets)) for _ in range(rng.randint(0, 50)))
        ids, written = encoder.encode(text)
        assert ids == library.encode_ordinary(text)
        assert ",".join(written) == ",".join(map(str, ids))
        assert bpe._decoded(decoder, ids, rng.choice([1, 2, 3, 4096])).decode() == text


def test_stores_may_overflow(library, monkeypatch):
    monkeypatch.setattr(bpe, "MOST_KEPT", 40)
    monkeypatch.setattr(bpe, "CHUNK_CHARS", 64)
    encoder = bpe.Encoder(bpe.load_ranks(public_tokenizers.path(bpe.RANKS)), public_tokenizers.PATTERN)
    for seed in range(5):
        text = cases.prose(seed, 200) + "   \n  " + cases.prose(seed, 20)
        assert encoder.encode(text)[0] == library.encode_ordinary(text)


def test_decoder_replaces_what_is_no_character():
    _, decoder = bpe.tokenizer(public_tokenizers.path(bpe.RANKS), public_tokenizers.PATTERN)
    rng = random.Random(5)
    for _ in range(2000):
        ids = [rng.randrange(50_000) for _ in range(rng.randint(0, 10))]
        raw = b"".join(decoder.tokens[i] for i in ids)
        assert bpe._decoded(decoder, ids, rng.choice([1, 2, 5])).decode() == raw.decode("utf-8", "replace")


def test_encode_and_decode_frames(spark, library):
    docs = cases.frame(spark).unionByName(cases.documents(spark), allowMissingColumns=True)
    texts = {}
    for r in docs.select("doc_id", "text").collect():
        texts.setdefault(r.doc_id, set()).add(tuple(library.encode_ordinary(r.text or "")))
    coded = bpe.encode(docs)
    got = coded.collect()
    assert len(got) == docs.count()
    assert all(r.exact and tuple(r.ids) in texts[r.doc_id] and r.n_tokens == len(r.ids) for r in got)
    back = sorted((r.doc_id or -1, r.text) for r in bpe.decode(coded).collect())
    assert back == sorted((r.doc_id or -1, r.text or "") for r in docs.select("doc_id", "text").collect())
    assert bpe.encode(cases.empty(spark)).collect() == []


def plain_targets(sizes):
    """Targets by sharing again and again (sizes: source -> words)."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    total, out, free = sum(sizes.values()), {}, set(names)
    while free:
        level = (total - sum(out.values())) / sum(weight[s] for s in free)
        above = {s for s in free if level * weight[s] > 3 * sizes[s]}
        if not above:
            out |= {s: level * weight[s] for s in free}
            break
        out |= {s: 3.0 * sizes[s] for s in above}
        free -= above
    return out


def test_mix_meets_targets(spark):
    rng = random.Random(9)
    data = [(i, cases.prose(i, rng.randint(1, 60)), "en", None if i % 50 == 0 else rng.choice(["a", "a", "a", "b", "c", "d"] if i < 480 else ["e", "f"]), 1) for i in range(500)]
    docs = cases.frame(spark, data)
    got = source_mix.mix(docs).collect()
    sizes, taken, source = {}, {}, {r[0]: r[3] for r in data}
    for r in got:
        s = source[r.doc_id]
        assert r.size == len(cases.words(data[r.doc_id][1])) and 0 <= r.taken <= 3 * r.size and r.taken % max(1, r.size) == 0
        sizes[s], taken[s] = sizes.get(s, 0) + r.size, taken.get(s, 0) + r.taken
    want = plain_targets(sizes)
    for r in got:
        assert r.target == pytest.approx(want[source[r.doc_id]]) and r.source_size == sizes[source[r.doc_id]]
    assert any(t == 3.0 * sizes[s] for s, t in want.items()) and any(t < 3.0 * sizes[s] for s, t in want.items())
    for s, t in want.items():
        assert t - 61 <= taken[s] <= t + 1e-6
    assert sum(want.values()) - sum(taken.values()) < 10 * len(want)
    assert sorted(map(tuple, source_mix.mix(docs).collect())) == sorted(map(tuple, got))
    drawn = source_mix.draw(docs)
    copies = {r.doc_id: r["count"] for r in drawn.groupBy("doc_id").count().collect()}
    assert drawn.dtypes == docs.dtypes
    assert copies == {r.doc_id: r.taken // r.size for r in got if r.taken}


def test_one_long_document_leaves_no_gap(spark):
    # A document much longer than the others stands somewhere in the order of the hashes.
    data = [(i, cases.prose(i, 150 if i in (3, 40) else 10 + i % 7), "en", "b" if i < 30 else "a", 1) for i in range(90)]
    got = source_mix.mix(cases.frame(spark, data, clash=False)).collect()
    taken, target = {}, {}
    for r in got:
        s = data[r.doc_id][3]
        taken[s], target[s] = taken.get(s, 0) + r.taken, r.target
    for s, t in target.items():
        assert 0 <= t - taken[s] < 0.05 * t


def test_mix_of_odd_rows(spark):
    got = source_mix.mix(cases.frame(spark)).collect()
    assert len(got) == len(cases.rows()) and all(0 <= r.taken <= 3 * r.size for r in got)
    assert source_mix.mix(cases.empty(spark)).collect() == []
    assert source_mix.draw(cases.empty(spark)).collect() == []
    blank = source_mix.mix(cases.frame(spark, [(1, None, None, None, None), (2, " ", "en", "s", 1)])).collect()
    assert [(r.size, r.taken) for r in blank] == [(0, 0), (0, 0)]


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_queries_match_their_sql(spark, name):
    path = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/documents.parquet'")
    want = con.execute(queries.SQL[name]).df()
    got = queries.QUERIES[name](spark, path).toPandas()
    key = lambda df: sorted(map(tuple, df[sorted(df.columns)].astype(object).values.tolist()))
    assert sorted(got.columns) == sorted(want.columns)
    assert key(got) == key(want)


def test_pipeline_stages(spark, library):
    path = "/root/testdata/sf0.001"
    docs = cases.documents(spark)
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "near_duplicates", "secret_scan", "source_mix", "byte_bpe"]
    steps = dict(corpus_pipeline.STAGES)
    frames = [docs]
    for name in names:
        frames.append(stage(steps[name](spark, frames[-1], path), name))
        if name != names[-1]:
            assert frames[-1].columns == docs.columns
    kept = {r.doc_id for r in quality_rules.judge(docs).where("kept").collect()}
    assert {r.doc_id for r in frames[1].collect()} == kept
    # One of each group, and none that has no near copy is lost.
    from tests.llm.test_dedup import brute_components

    cleaned = {r.doc_id: cases.shingles(r.text) for r in frames[1].collect()}
    assert {r.doc_id for r in frames[2].collect()} == set(brute_components(cleaned).values())
    assert frames[3].count() == frames[2].count()
    texts = {r.doc_id: r.text for r in frames[4].collect()}
    out = frames[5].collect()
    assert len(out) == frames[4].count()
    assert all(list(r.ids) == library.encode_ordinary(texts[r.doc_id]) for r in out)
    run = corpus_pipeline.run(spark, path).collect()
    assert sorted((r.doc_id, r.ids_sha256) for r in run) == sorted((r.doc_id, r.ids_sha256) for r in out)


def test_pipeline_of_odd_rows_and_empty_table(spark):
    for data in (cases.frame(spark), cases.empty(spark)):
        docs = data
        for name, step in corpus_pipeline.STAGES[:-1]:
            out = step(spark, docs, "")
            assert out.schema.names == data.schema.names, name
            docs = spark.createDataFrame(out.collect(), out.schema)
        assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() == docs.count()
