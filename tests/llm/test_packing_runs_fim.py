"""Packing, periodic runs and fill-in-the-middle against brute force and the tokenizer library."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm import cases
from tidepair.llm import fill_middle, packing, periodic_runs, queries
from tidepair.llm import text as tx

SF = "/root/testdata/sf0.001"


# ---- fill in the middle ------------------------------------------------------------------------


def plain_fim(doc_id, text):
    """(n, form, prefix_chars, middle_chars, output) by the rule as it is written down."""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    n = len(units)
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    if h4 % 100 < 20:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def odd_texts():
    rng = random.Random(7)
    out = ["", "a", "é", "<P> has a mark", "x <M", "<", "ab<S>", "日本語 text 😀 ends", "A" * 200_000, "é" * 50_000, "a b" * 9000, "\x00 \x85\r\n"]
    alphabet = ["ab", "<>PSM", "é日😀", " \n", "XYZ"]
    out += ["".join(rng.choice(rng.choice(alphabet)) for _ in range(rng.randint(1, 60))) for _ in range(150)]
    return out


def fim_rows():
    return [(i, t) for i, t in enumerate(odd_texts())] + [(r[0], r[1]) for r in cases.rows()]


def test_fim_matches_the_rule(spark):
    data = fim_rows()
    docs = spark.createDataFrame(data, "doc_id long, text string").withColumn("piece", F.lit(1)).withColumn("digest", F.lit("x"))
    want = Counter()
    for i, t in data:
        n, form, p, m, out = plain_fim(i, t or "")
        want[i, n, form, p, m, sha(out), sha(t or ""), True] += 1
    assert {w[2] for w in want} == {"plain", "psm", "spm"}
    assert Counter(map(tuple, fill_middle.digests(docs).collect())) == want


def test_fim_query_over_the_table(spark):
    texts = {r.doc_id: r.text for r in cases.documents(spark).collect()}
    got = queries.QUERIES["op13_fill_in_middle"](spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        n, form, p, m, out = plain_fim(r.doc_id, texts[r.doc_id])
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output_sha256, r.restored_sha256) == (n, form, p, m, sha(out), sha(texts[r.doc_id]))


def test_fim_outputs_and_restoring(spark, monkeypatch):
    monkeypatch.setattr(fill_middle, "CHUNK", 3)
    monkeypatch.setattr(fill_middle, "CHUNK_BYTES", 7)
    data = [(i, t) for i, t in fim_rows() if len(t or "") < 5000]
    out = fill_middle.transform(spark.createDataFrame(data, "doc_id long, text string"))
    rows = out.collect()
    assert Counter((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in rows) == Counter((i, *plain_fim(i, t or "")) for i, t in data)
    back = fill_middle.restore(spark.createDataFrame(rows, out.schema)).collect()
    assert Counter(map(tuple, back)) == Counter((i, t or "") for i, t in data)


@pytest.mark.parametrize("form", ["plain", "psm", "spm"])
def test_marks_may_be_cut_by_pieces(form):
    segments = {b"<P>": b"pre<x", b"<S>": b"", b"<M>": b"mid<"}
    output = b"as it <is" if form == "plain" else b"".join(m + segments[m] for m in fill_middle.ORDERS[form])
    for size in range(1, 9):
        parts = [b"", b"", b""]
        for segment, content in fill_middle.parsed(form, (output[k : k + size] for k in range(0, len(output), size))):
            parts[segment] += content
        assert parts == ([output, b"", b""] if form == "plain" else [segments[b"<P>"], segments[b"<M>"], segments[b"<S>"]])


def test_fim_deals_copies_of_one_row(spark):
    docs = spark.createDataFrame([(None, "the same text")] * 500 + [(1, "another")], "doc_id long, text string").repartition(3)
    pieces = fill_middle.pieces(docs)
    assert pieces.where("doc_id is null").select("copy").distinct().count() > 100
    got = fill_middle.digests(docs).collect()
    assert len(got) == 501 and all(r.exact for r in got)
    assert fill_middle.digests(cases.empty(spark)).collect() == []
    assert fill_middle.transform(cases.empty(spark)).collect() == []


# ---- periodic runs -----------------------------------------------------------------------------


def plain_runs(words):
    """All runs by walking every lag (start, length, period)."""
    n, least = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(12, 2 * q) and j > i:
                least.setdefault((i, j - 1 + q), q)
            i = max(j, i + 1)
    return sorted((s, e - s + 1, q) for (s, e), q in least.items())


def plain_planted(doc_id, words):
    h = zlib.crc32(str("" if doc_id is None else doc_id).encode())
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def plain_report(doc_id, words):
    found = plain_runs(words)
    kept = [w for i, w in enumerate(words) if not any(s + q <= i < s + length for s, length, q in found)]
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    top = (None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])
    return (doc_id, len(found), *top, sha("".join(f"{s},{length},{q}\n" for s, length, q in found)), sha(" ".join(kept)))


def test_runs_match_brute_force():
    rng = random.Random(1)
    for _ in range(150):
        texts = []
        for _ in range(rng.randint(1, 8)):
            words = [rng.randrange(rng.choice([1, 2, 3, 30])) for _ in range(rng.choice([0, 1, 11, 12, 13, 24, 60, 150]))]
            if words and rng.random() < 0.6:
                a = rng.randrange(len(words))
                p = rng.randint(1, max(1, (len(words) - a) // 2))
                words = [words[i] if i < a else words[a + (i - a) % p] for i in range(len(words))]
            if rng.random() < 0.4:
                words = (words + [99]) * rng.randint(1, 4)
            texts.append(words)
        hashed = tx.Words([" ".join(map(str, w)).encode() for w in texts], lower=False)
        text_of = np.repeat(np.arange(len(texts)), np.diff(hashed.first))
        start, length, period = periodic_runs.runs(hashed.hashes, text_of)
        for i, words in enumerate(texts):
            own = text_of[start] == i if len(start) else start
            got = list(zip(start[own] - hashed.first[i], length[own], period[own], strict=True)) if len(start) else []
            assert got == plain_runs(words)


def test_runs_of_one_word_many_times():
    n = 200_000
    start, length, period = periodic_runs.runs(tx.Words([b"same " * n], lower=False).hashes, np.zeros(n, dtype=np.int64))
    assert (start.tolist(), length.tolist(), period.tolist()) == ([0], [n], [1])


def test_runs_of_odd_rows(spark):
    data = [r for r in cases.rows() if r[0] not in (9, 10)]
    data += [(100 + i, "a b c " * i, "en", "s", 1) for i in range(12)] + [(200, "Cut cut " * 9, "en", "s", 1), (201, "line\n" * 13, "en", "s", 1)]
    want = Counter(plain_report(r[0], plain_planted(r[0], cases.words(r[1]))) for r in data)
    docs = cases.frame(spark, data)
    assert Counter(map(tuple, periodic_runs.digests(periodic_runs.planted(docs)).collect())) == want
    found = {r.doc_id: r for r in periodic_runs.find(docs).collect()}
    assert [(x.start, x.length, x.period) for x in found[13].runs] == [(0, 120, 1)] and found[13].collapsed == "same"
    assert found[4].n_words == 0 and found[4].runs == [] and found[4].collapsed == ""
    assert periodic_runs.digests(periodic_runs.planted(cases.empty(spark))).collect() == []


def test_runs_query_over_the_table(spark):
    got = queries.QUERIES["op12_periodic_runs"](spark, SF).collect()
    texts = {r.doc_id: r.text for r in cases.documents(spark).collect() if r.text is None or len(r.text) < 3000}
    got = {r.doc_id: tuple(r) for r in got if r.doc_id in texts}
    want = {i: plain_report(i, plain_planted(i, cases.words(t))) for i, t in texts.items()}
    assert got == want and any(r[1] for r in want.values())


# ---- packing -----------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    tokenizer.encode_special_tokens = True
    return tokenizer


def test_word_ids_match_the_library(library):
    ids = packing.word_ids(public_tokenizers.path(packing.VOCABULARY))
    rng = random.Random(3)
    alphabets = ["ab's", "ABC 'll", "\n\t\x0b  x", "0123 .,!?", "é́ÀßΣς", "日本 한국", "😀 👨‍👩‍👧", "\x85\xa0 \x1c a", "<|endoftext|>", "가 İ"]
    texts = ["".join(rng.choice(rng.choice(alphabets)) for _ in range(rng.randint(0, 60))) for _ in range(1500)] + ["<|endoftext|> x", "word" * 50]
    got = ids.encode([t.encode() for t in texts])
    want = [library.encode(t, add_special_tokens=False).ids + [packing.END] for t in texts]
    assert [np.frombuffer(g, ids.kind).tolist() for g in got] == want
    assert max(map(len, ids.kept)) <= packing.LONGEST_KEPT


def check_pieces(rows, texts, library, length=4096):
    """Every id once, sequences without gaps, lengths full or powers of two (texts: (doc_id, text))."""
    sequences, held = defaultdict(list), defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append(r)
        held[r.doc_id].append(r)
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at == length or (at < length and at & (at - 1) == 0)
    wanted = defaultdict(list)
    for doc_id, text in texts:
        wanted[doc_id].append(library.encode(text or "", add_special_tokens=False).ids + [packing.END])
    assert held.keys() == wanted.keys()
    for doc_id, lists in wanted.items():
        for total in {len(x) for x in lists}:
            same = [x for x in lists if len(x) == total]
            own = sorted((r.start, r.length, r.ids_crc32) for r in held[doc_id] if r.doc_tokens == total)
            assert sum(r[1] for r in own) == total * len(same)
            if len(same) == 1:
                at = 0
                for start, n, crc in own:
                    assert start == at and crc == zlib.crc32(np.array(same[0][at : at + n], dtype="<u4").tobytes())
                    at += n
    return sequences


def test_packing_query_over_the_table(spark, library):
    docs = cases.documents(spark).collect()
    rows = queries.QUERIES["op11_mixture_packing"](spark, SF).collect()
    sequences = check_pieces(rows, [(r.doc_id, r.text) for r in docs], library)
    # Every full window is near the corpus's own mixture.
    source = {r.doc_id: r.source for r in docs}
    total, share = sum(r.length for r in rows), Counter()
    for r in rows:
        share[source[r.doc_id]] += r.length / total
    full = [own for own in sequences.values() if sum(r.length for r in own) == 4096]
    assert len(full) > 20
    for own in full:
        mixed = Counter()
        for r in own:
            mixed[source[r.doc_id]] += r.length / 4096
        assert sum(abs(mixed[s] - share[s]) for s in share) / 2 < 0.15


def test_packing_of_odd_rows(spark, library, monkeypatch):
    monkeypatch.setattr(packing, "BIN", 3)
    docs = cases.frame(spark).withColumn("queue", F.lit(1)).withColumn("ids", F.lit("x")).withColumn("task", F.lit(0))
    packed = packing.pack(docs, length=512)
    rows = packed.collect()
    check_pieces(rows, [(r[0], r[1]) for r in cases.rows()], library, 512)
    assert all(len(r.ids) == r.length and zlib.crc32(np.array(r.ids, dtype="<u4").tobytes()) == r.ids_crc32 for r in rows)
    whole = {r.sequence_id: r.ids for r in packing.sequences(packed).collect()}
    assert whole.keys() == {r.sequence_id for r in rows} and max(map(len, whole.values())) == 512
    assert packing.pack(cases.empty(spark)).collect() == []


def test_packing_to_given_weights(spark):
    rng = random.Random(4)
    data = [(i, cases.prose(i, rng.randint(5, 400)), "en", ["a", "b", None][min(2, i % 8)], 1) for i in range(600)]
    rows = packing.pack(cases.frame(spark, data, clash=False), weights={"a": 2, "b": 1, None: 1}, length=1024).collect()
    source = {r[0]: r[3] for r in data}
    tokens = Counter()
    for r in rows:
        tokens[source[r.doc_id]] += r.length
    # Until the first queue is empty, windows hold a half of a and a quarter of b.
    lasting = min(tokens["a"] / 0.5, tokens["b"] / 0.25, tokens[None] / 0.25) // 1024
    windows = defaultdict(Counter)
    for r in rows:
        windows[r.sequence_id][source[r.doc_id]] += r.length
    for k in range(1, int(lasting) - 1):
        assert abs(windows[k]["a"] / 1024 - 0.5) < 0.1 and abs(windows[k]["b"] / 1024 - 0.25) < 0.1
    assert sum(len(c) for c in windows.values()) > 0


def test_rare_sources_wait_for_a_turn(spark):
    data = [(i, cases.prose(i, 300), "en", "big", 1) for i in range(200)] + [(1000, cases.prose(9, 120), "en", "small", 1)]
    rows = packing.pack(cases.frame(spark, data, clash=False)).collect()
    # Credit of a share far below one turn a window gathers over windows, so pieces are turns (or what a sequence end leaves of one).
    own = [r for r in rows if r.doc_id == 1000]
    assert len(own) <= 2 * own[0].doc_tokens / packing.TURN + 2
    assert len({r.sequence_id for r in own}) > 5
