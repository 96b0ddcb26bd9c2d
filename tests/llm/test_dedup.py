"""Near-duplicate documents and passages against brute force."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import cases
from tidepair import session
from tidepair.llm import fingerprints, graph, minhash_dedup, passage_dedup, set_join
from tidepair.llm import text as tx


def brute_components(docs):
    """Least reachable id by comparing all sets (docs: id -> shingle set)."""
    parent = {i: i for i in docs}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(docs)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            both = len(docs[i] & docs[j])
            if both and 100 * both >= 75 * (len(docs[i]) + len(docs[j]) - both):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in docs}


def test_near_duplicates_match_brute_force(spark):
    docs = cases.documents(spark)
    sets = {r.doc_id: cases.shingles(r.text) for r in docs.collect()}
    want = brute_components(sets)
    got = {r.doc_id: r for r in minhash_dedup.near_duplicates(docs).collect()}
    assert len(set(want.values())) < len(want)
    assert {i: r.component_id for i, r in got.items()} == want
    assert {i: r.n_shingles for i, r in got.items()} == {i: len(s) for i, s in sets.items()}
    assert all(r.kept == (i == want[i]) for i, r in got.items())


def test_near_duplicates_of_odd_rows(spark):
    got = minhash_dedup.near_duplicates(cases.frame(spark)).collect()
    assert len(got) == len(cases.rows())
    by_id = {r.doc_id: r for r in got if r.doc_id is not None}
    assert [by_id[i].component_id for i in (1, 2, 3, 14)] == [1, 1, 1, 1]
    assert [(by_id[i].n_shingles, by_id[i].component_id, by_id[i].kept) for i in (4, 5, 6)] == [(0, i, True) for i in (4, 5, 6)]
    assert [(by_id[i].n_shingles, by_id[i].component_id) for i in (7, 8)] == [(1, 7), (1, 7)]
    assert by_id[10].component_id == 9 and not by_id[10].kept
    assert all(r.component_id is None and not r.kept for r in got if r.doc_id is None)
    assert minhash_dedup.near_duplicates(cases.empty(spark)).collect() == []


def test_large_group_of_copies_stays_linear(spark):
    base = cases.prose(3, 120).split(" ")
    data = [(i, " ".join(base[:k] + [f"edit{i}"] + base[k + 1 :]), "en", "s", 1) for i, k in enumerate(range(0, 120))]
    docs = cases.frame(spark, data, clash=False)
    sketch = minhash_dedup.sketches(docs).withColumnRenamed("doc_id", "node")
    pairs = minhash_dedup.candidates(minhash_dedup.table_keys(sketch))
    # Not all pairs: each table gives a member at most two.
    assert pairs.count() < 120 * 119 / 4
    assert {r.component_id for r in minhash_dedup.near_duplicates(docs).collect()} == {0}


def test_links_between_members_far_from_the_ends(spark):
    # All documents share 840 words (similarity 0.72, no link), pairs of them 30 more (0.77).
    shared = cases.prose(1, 840)
    data = [(i, f"{shared} {cases.prose(100 + i % 30, 30)} {cases.prose(1000 + i, 130)}", "en", "s", 1) for i in range(60)]
    docs = cases.frame(spark, data, clash=False)
    want = brute_components({r[0]: cases.shingles(r[1]) for r in data})
    assert want == {i: i % 30 for i in range(60)}
    assert {r.doc_id: r.component_id for r in minhash_dedup.near_duplicates(docs).collect()} == want


def test_pairs_just_above_the_threshold_are_found(spark):
    """Recall at a similarity of 0.75 to 0.8, in pairs and in groups that share most of their text."""
    data, sets = [], {}
    for k in range(150):
        base = cases.prose(5000 + k // 3 * 3, 300).split(" ")
        for j in range(2):
            words = list(base)
            # Each changed word costs five shingles; both texts change different ones.
            for n in range(4 - (j and k % 2)):
                words[10 + 67 * n + 13 * j + k % 3] = f"n{k}x{j}x{n}"
            data.append((2 * k + j, " ".join(words), "en", "s", 1))
    sets = {r[0]: cases.shingles(r[1]) for r in data}
    near = [(a, b) for a, b in zip(range(0, 300, 2), range(1, 300, 2)) if 0.75 <= len(sets[a] & sets[b]) / len(sets[a] | sets[b]) <= 0.82]
    assert len(near) > 100
    got = {r.doc_id: r.component_id for r in minhash_dedup.near_duplicates(cases.frame(spark, data, clash=False)).collect()}
    assert got == brute_components(sets)
    assert all(got[a] == got[b] for a, b in near)


def test_prefix_join_misses_no_similar_pair(spark):
    rng = np.random.default_rng(5)
    rows, common = [], rng.choice(10**6, 60, replace=False)
    for i in range(160):
        size = int(rng.integers(1, 60))
        own = set(rng.choice(common, min(size, 60), replace=False).tolist()) | set((2_000_000 + i * 100 + np.arange(rng.integers(0, 12))).tolist())
        rows.append((i, int(i % 9 == 0) * 1000 + i, len(own), sorted(own)))
    sets = spark.createDataFrame(rows, "node long, component long, n int, hashes array<long>")
    want = set()
    for i, _, _, x in rows:
        for j, _, _, y in rows[:i]:
            both = len(set(x) & set(y))
            if 100 * both >= 75 * (len(x) + len(y) - both):
                want.add((j, i))
    pairs = set_join.across(sets, 75)
    assert len(want) > 20 and want <= {tuple(r) for r in pairs.collect()}
    assert {tuple(r) for r in set_join.verified(pairs, sets, 75).collect()} == want


def test_a_group_below_the_threshold_builds_few_pairs(spark):
    # 300 variants of one text, any two of them at 0.72: they share table keys, and none is linked.
    shared = cases.prose(1, 840)
    data = [(i, f"{shared} {cases.prose(1000 + i, 160)}", "en", "s", 1) for i in range(300)]
    docs = cases.frame(spark, data, clash=False)
    sketch = minhash_dedup.sketches(docs).withColumnRenamed("doc_id", "node")
    sets = set_join.sets_of(docs, sketch.select("node", "digest")).withColumn("component", F.col("node"))
    assert set_join.across(sets, 75).count() == 0
    assert {r.component_id for r in minhash_dedup.near_duplicates(docs).collect()} == set(range(300))


def test_drop_keeps_one_of_each_group_and_the_columns(spark):
    docs = cases.frame(spark)
    out = minhash_dedup.drop_near_duplicates(docs)
    assert out.dtypes == docs.dtypes
    ids = sorted(r.doc_id for r in out.collect() if r.doc_id is not None)
    assert ids == [1, 4, 5, 6, 7, 9, 11, 12, 13]
    assert sum(r.doc_id is None for r in out.collect()) == 2


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(139, 200), (7, 7)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 140), 100), 200: 100}
    assert graph.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_fingerprint_bands_match_brute_force(spark):
    docs = cases.documents(spark)
    sets = {r.doc_id: cases.shingles(r.text) for r in docs.collect()}
    got = {r.doc_id: r.class_id for r in fingerprints.near_duplicates(docs).collect()}
    assert got == {i: c for i, c in brute_components(sets).items() if sets[i]}


def test_edits_match_brute_force(spark):
    import hashlib

    docs = cases.documents(spark)
    texts = sorted(((r.doc_id, r.text or "") for r in docs.collect()), reverse=True)
    got = {r.doc_id: r for r in fingerprints.compare_edits(docs).collect()}
    jaccard = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    errors = []
    for k, (i, text) in enumerate(texts):
        after = texts[(k + 1) % len(texts)][1]
        cut = len(text) // 3
        edited = text[: len(text) - cut] + after[:cut]
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and got[i].n_chars == len(text)
        errors.append(got[i].near_edited - jaccard(cases.shingles(text), cases.shingles(edited)))
        errors.append(got[i].near_next - jaccard(cases.shingles(text), cases.shingles(after)))
    assert np.abs(errors).max() < 0.2 and np.std(errors) < 0.05


def test_edits_of_odd_rows(spark):
    data = [r for r in cases.rows() if r[0] != 9]
    got = fingerprints.compare_edits(cases.frame(spark, data)).collect()
    assert len(got) == len(data)
    by_id = {r.doc_id: r for r in got}
    assert by_id[1].fingerprint == by_id[2].fingerprint and by_id[1].near_next != by_id[4].near_next
    assert by_id[4].n_chars == 0 and by_id[4].near_edited == 1.0
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    lone = fingerprints.compare_edits(cases.frame(spark, data[:1])).collect()
    assert lone[0].near_next == 1.0
    assert fingerprints.compare_edits(cases.empty(spark)).collect() == []


def test_compact_windows_match_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(150):
        first = np.concatenate([[0], np.cumsum(rng.integers(0, 40, rng.integers(1, 6)))])
        hashes = rng.integers(0, rng.choice([5, 50, 10**6]), first[-1]).astype(np.uint64)
        length = int(rng.integers(1, 12))
        want = set()
        for t in range(len(first) - 1):
            x = hashes[first[t] : first[t + 1]].tolist()
            for c in range(len(x)):
                left = right = c
                while left > 0 and x[left - 1] > x[c]:
                    left -= 1
                while right < len(x) - 1 and x[right + 1] >= x[c]:
                    right += 1
                if right - left + 1 >= length:
                    want.add((t, left, c, right))
        got = np.stack(passage_dedup.compact_windows(hashes, first, length), axis=1)
        assert set(map(tuple, got.tolist())) == want


@pytest.fixture(scope="module")
def passages(spark):
    docs = cases.documents(spark)
    return {r.doc_id: cases.words(r.text, lower=True) for r in docs.collect()}, passage_dedup.repeated_passages(docs).collect()


def test_passages_are_right(passages):
    texts, got = passages
    cut = lambda w: {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    assert got
    for r in got:
        one, two = texts[r.doc_id][r.start_word : r.end_word], texts[r.match_id][r.match_start : r.match_end]
        a, b = cut(one), cut(two)
        assert min(len(one), len(two)) >= 50 and r.doc_id != r.match_id
        assert 100 * len(a & b) >= 75 * len(a | b) and r.similarity == pytest.approx(len(a & b) / len(a | b))


def test_passages_cover_all_exact_repeats(passages):
    texts, got = passages
    holders = {}
    for i, w in texts.items():
        for k in range(len(w) - 49):
            holders.setdefault(tuple(w[k : k + 50]), set()).add(i)
    covered = {i: np.zeros(len(w), bool) for i, w in texts.items()}
    for r in got:
        covered[r.doc_id][r.start_word : r.end_word] = True
    for i, w in texts.items():
        for k in range(len(w) - 49):
            if len(holders[tuple(w[k : k + 50])]) > 1:
                assert covered[i][k : k + 50].all()


def test_shared_passage_in_many_documents_and_odd_rows(spark):
    passage = cases.prose(77, 60)
    near = passage.replace("x30 ", "edited ")
    data = [(100 + i, f"{cases.prose(200 + i, 70)} {near if i % 3 == 0 else passage} {cases.prose(500 + i, 40)}", "en", "s", 1) for i in range(30)]
    got = passage_dedup.repeated_passages(cases.frame(spark, data + [(1, cases.prose(900, 300), "en", "s", 1), (2, None, None, None, None), (None, passage, "en", "s", 1)]))
    got = got.collect()
    assert {r.doc_id for r in got} == {r[0] for r in data}
    assert all(70 <= r.start_word and r.end_word <= 130 for r in got)
    assert {r.doc_id for r in got if (r.start_word, r.end_word) == (70, 130)} == {r[0] for r in data}
    assert passage_dedup.repeated_passages(cases.empty(spark)).collect() == []


def test_repeats_around_a_frequent_line_are_found(spark):
    # Half of each pair's passage is stock text that all others hold too.
    stock = cases.prose(77, 25)
    data = [(1000 + i, f"{cases.prose(3000 + i, 60)} {stock} {cases.prose(4000 + i, 60)}", "en", "s", 1) for i in range(40)]
    for i in range(40):
        passage = f"{stock} {cases.prose(2000 + i, 25)}"
        data += [(100 + i, f"{cases.prose(5000 + i, 60)} {passage} {cases.prose(6000 + i, 60)}", "en", "s", 1)]
        data += [(200 + i, f"{cases.prose(7000 + i, 60)} {passage} {cases.prose(8000 + i, 60)}", "en", "s", 1)]
    got = passage_dedup.repeated_passages(cases.frame(spark, data, clash=False)).collect()
    assert {(r.doc_id, r.match_id, r.start_word, r.end_word) for r in got} == {x for i in range(40) for x in ((100 + i, 200 + i, 60, 110), (200 + i, 100 + i, 60, 110))}


def test_near_passages_are_found(spark):
    # Two of 75 words are changed: similarity 61 / 81. Four functions lost one of the 300 pairs.
    data = []
    for i in range(300):
        w = cases.prose(10_000 + i, 75).split(" ")
        near = " ".join(w[:20] + ["one"] + w[21:50] + ["two"] + w[51:])
        data += [(1000 + i, f"{cases.prose(20_000 + i, 60)} {' '.join(w)} {cases.prose(30_000 + i, 60)}", "en", "s", 1)]
        data += [(2000 + i, f"{cases.prose(40_000 + i, 60)} {near} {cases.prose(50_000 + i, 60)}", "en", "s", 1)]
    got = passage_dedup.repeated_passages(cases.frame(spark, data, clash=False)).collect()
    assert all(r.match_id % 1000 == r.doc_id % 1000 and 60 <= r.start_word and r.end_word <= 135 for r in got)
    assert len({r.doc_id for r in got}) == 2 * 300


def test_passages_bridge_what_their_length_allows():
    rng = np.random.default_rng(6)
    draw = lambda n: rng.integers(0, 2**63, n).astype(np.uint64)
    # Seven words in the middle of 100 leave 11 shingles without a match.
    for n, misses in ((96, 11), (46, 6), (700, 90)):
        one = draw(n)
        two = one.copy()
        two[(n - misses) // 2 : (n - misses) // 2 + misses] = draw(misses)
        both = n - misses
        assert passage_dedup._passages(one, two, (0, n - 1, 0, n - 1)) == [(0, n + 4, 0, n + 4, both / (n + misses))]
        # A stray match next to the passage takes nothing from it.
        mine, theirs, stray = draw(60), draw(60), draw(1)
        one2, two2 = np.concatenate([one, mine, stray]), np.concatenate([stray, theirs, two])
        got = passage_dedup._passages(one2, two2, (0, len(one2) - 1, 0, len(two2) - 1))
        assert got == [(0, n + 4, 61, 61 + n + 4, both / (n + misses))]


def test_shingles_and_words_match_brute_force():
    texts = ["", "a", "a b c", "A b\tc d e", "é ü\x0bb  c d e f", "x " * 50, "日本 語 a b c d"]
    words = tx.Words([t.encode() for t in texts])
    assert np.diff(words.first).tolist() == [len(cases.words(t)) for t in texts]
    hashes, first = words.shingles()
    sets, bounds = tx.distinct(hashes, first)
    assert np.diff(bounds).tolist() == [len(cases.shingles(t)) for t in texts]
    names = {}
    for t, a, b in zip(texts, first[:-1], first[1:], strict=True):
        w = cases.words(t, lower=True)
        for k, h in enumerate(hashes[a:b].tolist()):
            assert names.setdefault(h, tuple(w[k : k + 5])) == tuple(w[k : k + 5])


def test_only_words_of_regions_go_on():
    text = " ".join(f"w{i}" for i in range(400)).encode()
    words = passage_dedup.tx.Words([text])
    whole = words.shingles()[0]
    # Two regions that overlap, one that touches their words, one apart.
    flat = [c for left, right in ((200, 250), (20, 70), (60, 110), (114, 160)) for c in (left, right, 0, 0)]
    cut, at = passage_dedup._cut(text, words, flat)
    assert len(cut.split()) == 55 + 145
    mine = passage_dedup.tx.Words([cut]).shingles()[0]
    for k, begin in enumerate(at):
        left, right = flat[4 * k : 4 * k + 2]
        assert (mine[begin : begin + right - left + 1] == whole[left : right + 1]).all()


def test_shared_keys_take_one_exchange(spark):
    rows = spark.createDataFrame([(1, 5, 0), (1, 5, 1), (2, 5, 0), (2, 7, 0), (2, 6, 0)], "key long, node long, at long")
    found = passage_dedup._shared(rows)
    assert sorted(map(tuple, found.collect())) == [(2, 5, 0, 5, 7, 3), (2, 6, 0, 5, 7, 3), (2, 7, 0, 5, 7, 3)]
    assert found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("Exchange hashpartitioning") <= 1


def _family(n, template, every):
    """Copies of a text, each with other words at random places."""
    rng = np.random.default_rng(8)
    data = []
    for i in range(n):
        w = template.split(" ")
        for k in np.flatnonzero(rng.random(len(w)) < 1 / every):
            w[k] = f"own{i}x{k}"
        data.append((100 + i, " ".join(w), "en", "s", 1))
    return data


def test_a_shorter_text_of_the_same_id_is_no_error(spark):
    # The words of a region end behind the shorter text.
    passage = cases.prose(77, 60)
    data = [(1, f"{cases.prose(200, 90)} {passage}", "en", "s", 1), (1, cases.prose(300, 20), "en", "s", 1), (1, cases.prose(500, 130), "en", "s", 1), (2, f"{passage} {cases.prose(400, 9)}", "en", "s", 1)]
    got = passage_dedup.repeated_passages(cases.frame(spark, data, clash=False)).collect()
    assert {(r.doc_id, r.start_word, r.end_word, r.match_id, r.match_start, r.match_end) for r in got} == {(1, 90, 150, 2, 0, 60), (2, 0, 60, 1, 90, 150)}


def test_hopeful_stretches_match_brute_force():
    rng = np.random.default_rng(5)
    length, price = passage_dedup.LENGTH, min(passage_dedup.PRICES)
    for _ in range(30):
        theirs = np.unique(rng.integers(0, 300, 200)).astype(np.uint64)
        # From hardly any hit to nearly all.
        stretches = [np.where(rng.random(n) < share, rng.choice(theirs, n), rng.integers(300, 600, n).astype(np.uint64)) for n, share in zip(rng.integers(0, 140, 12), rng.uniform(0.55, 0.95, 12), strict=True)]
        want = []
        for m in stretches:
            total = np.concatenate([[0], np.cumsum(np.where(np.isin(m, theirs), 1, -price))])
            want.append(any(total[j] >= total[i] for i in range(len(total)) for j in range(i + length, len(total))))
        assert passage_dedup._hopeful(stretches, theirs).tolist() == want


def test_a_text_goes_once_to_a_tile(spark):
    docs = cases.frame(spark, _family(40, cases.prose(77, 120), 30), clash=False)
    pairs = spark.createDataFrame([(100 + i, 100 + j, [0, 50 + j, 0, 60]) for i in range(40) for j in range(i + 1, 40)], "node long, other long, regions array<long>")
    placed = passage_dedup._tiled(pairs)
    assert sorted((r.node, r.other) for r in placed.collect()) == [(100 + i, 100 + j) for i in range(40) for j in range(i + 1, 40)]
    rows = passage_dedup._texts(placed, docs.select("doc_id", "text")).collect()
    # One text for each document, not one for each of 780 pairs; the words of its regions alone.
    assert len(rows) == len({r.node for r in rows}) == 40
    assert {r.node: len(r.cut.split()) for r in rows} == {100: 94, **{100 + i: 94 if i < 39 else 65 for i in range(1, 40)}}


def test_few_open_members_are_compared_as_many_are(spark, monkeypatch):
    docs = cases.frame(spark, _family(30, cases.prose(77, 140), 22), clash=False)
    found = []
    for few in (0, 10**6):
        monkeypatch.setattr(passage_dedup, "FEW", few)
        found.append({tuple(r) for r in passage_dedup.repeated_passages(docs).collect()})
    assert found[0] and found[0] == found[1]


def test_members_of_large_buckets_are_marked_in_one_exchange(spark):
    """One exchange of the members; a place in a passage shared with an end is settled, an end always is."""
    spot = lambda x, y: x * 2**35 + y * 2**6 + 1
    rows = [(7, n, n, spot(n, n + 3), 1, 9, 20) for n in (1, 2, 3, 4, 9)] + [(7, 2, 2, spot(2, 5), 1, 9, 20), (7, 4, 5, spot(30, 31), 1, 9, 20)]
    large = spark.createDataFrame(rows, "key long, node long, span long, spot long, lo long, hi long, n long")
    spans = spark.createDataFrame([(2, {1: [(0, 10)]}), (3, {5: [(0, 99)]}), (4, {1: [(0, 8)], 9: [(0, 12), (30, 80)]})], "n2 long, with map<long, array<struct<start_word: long, end_word: long>>>")
    marked = passage_dedup._marked(large, spans)
    plan = marked._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(") <= 2
    assert sorted((r.node, r.span, r.settled) for r in marked.collect()) == [(1, 1, True), (2, 2, True), (3, 3, False), (4, 4, True), (4, 5, True), (9, 9, True)]


def test_steps_leave_only_what_is_read(spark, monkeypatch):
    """Classes of documents give the pairs that all documents at once give; tables between the steps are gone."""
    docs = cases.frame(spark, _family(30, cases.prose(78, 140), 22), clash=False)
    place = f"{session.shared_dir(spark)}/tidepair/{spark.sparkContext.applicationId}"
    found = []
    for classes in (1, 3):
        monkeypatch.setattr(passage_dedup, "CLASSES", classes)
        before = set(os.listdir(place)) if os.path.exists(place) else set()
        found.append({tuple(r) for r in passage_dedup.repeated_passages(docs).collect()})
        assert {n.split("-")[0] for n in set(os.listdir(place)) - before} == {"passages", "blocks"}
    assert found[0] and found[0] == found[1]
