"""Nearest neighbours, mixing and packing, and the pipeline."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from helpers import edge_rows, rows, words
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from candor.llm import common, mixing, neighbours, packing, queries

TOKENS = str(public_tokenizers.path("word_bpe_49k.json"))


def plain_nearest(table, is_query, k=5):
    ids = np.array([i for i, _ in table])
    m = np.array([v for _, v in table], np.float64)
    unit = m / np.sqrt((m * m).sum(1))[:, None]
    out = {}
    for i in np.flatnonzero([is_query(x) for x in ids]):
        score = unit @ unit[i]
        order = [j for j in np.lexsort((ids, -np.round(score, 12))) if j != i][:k]
        out[ids[i]] = [(ids[j], score[j]) for j in order]
    return out


def test_nearest_recall(llm):
    got = defaultdict(list)
    for q, rank, v, score in rows(queries.nearest(llm, "/root/testdata/sf0.1"), "query_id", "rank", "vec_id", "score"):
        got[q].append((rank, v, score))
    table = [(r["vec_id"], r["embedding"]) for r in llm.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()]
    want = plain_nearest(table, lambda i: i % 50 == 0)
    assert set(got) == set(want)
    assert all([r for r, _, _ in sorted(x)] == [1, 2, 3, 4, 5] for x in got.values())
    assert np.mean([len({v for _, v, _ in got[q]} & {v for v, _ in want[q]}) / 5 for q in want]) >= 0.95
    score = {(q, v): s for q in want for v, s in want[q]}
    assert all(abs(s - score[q, v]) < 1e-12 for q in got for _, v, s in got[q] if (q, v) in score)


def test_nearest_odd_rows(llm):
    schema = "vec_id long, embedding array<float>, bucket string, score double"
    nan, inf = float("nan"), float("inf")
    table = [(i, [1.0, 2.0, 0.5 * (i % 3)]) for i in range(40)] + [(100, [0.0, 0.0, 0.0]), (150, None), (200, [nan, 1.0, 1.0]), (250, [1.0, None, 1.0])]
    table += [(300, [inf, 1.0, 1.0]), (350, []), (400, [1.0, 2.0]), (None, [1.0, 2.0, 3.0]), (50, [-1.0, -2.0, 0.0]), (50, [-1.0, -2.0, 0.0])]
    df = llm.createDataFrame([(*r, "own", 1.0) for r in table], schema)
    got = rows(neighbours.search(df, F.col("vec_id") % 50 == 0, group_rows=4), "query_id", "rank", "vec_id")
    assert [r[2] for r in got if r[0] == 0] == [3, 6, 9, 12, 15]
    assert {r[0] for r in got} == {0, 50} and len([r for r in got if r[0] == 50]) == 5
    few = llm.createDataFrame([(0, [1.0, 0.0]), (7, [-1.0, 0.0]), (8, [0.0, 1.0])], "vec_id long, embedding array<float>")
    assert rows(neighbours.search(few, F.col("vec_id") == 0), "rank", "vec_id") == [(1, 8), (2, 7)]
    assert neighbours.search(df.where("vec_id < 0"), F.lit(True)).count() == 0
    assert neighbours.search(few.where("vec_id = 0"), F.lit(True)).count() == 0


def test_nearest_among_many_equal_vectors(llm):
    rng = np.random.default_rng(3)
    same, near = rng.standard_normal(8), rng.standard_normal((200, 8))
    table = [(i, (same if i % 3 == 1 else near[i // 3]).tolist()) for i in range(600)]
    table = [(i, (same * 2).tolist() if i % 30 == 10 else v) for i, v in table]
    df = llm.createDataFrame(table, "vec_id long, embedding array<double>").repartition(4)
    got = defaultdict(list)
    for q, _, v in rows(neighbours.search(df, F.col("vec_id") % 5 == 0, group_rows=16, probes=400), "query_id", "rank", "vec_id"):
        got[q].append(v)
    want = plain_nearest(table, lambda i: i % 5 == 0)
    assert set(got) == set(want) and all(len(set(x)) == 5 for x in got.values())
    equal = [q for q in want if q % 3 == 1]
    assert len(equal) == 40 and all(got[q] == [v for v, _ in want[q]] for q in equal)
    assert np.mean([got[q] == [v for v, _ in want[q]] for q in want]) >= 0.9
    index = neighbours.few_copies(df.withColumnRenamed("embedding", "vec"), 6)
    assert index.count() == 400 + 2 * 6


def test_equal_vectors_are_scored_in_blocks(monkeypatch):
    exact, sizes = neighbours._cosines, []
    monkeypatch.setattr(neighbours, "_cosines", lambda a, b: sizes.append(len(a)) or exact(a, b))
    q, v = np.ones((500, 4)), np.ones((4096, 4))
    parts = neighbours.best_pairs(np.arange(500), q, np.arange(4096) + 1000, v, np.arange(500), np.arange(4096), 5)
    ids = np.concatenate([p[1] for p in parts])
    assert ids.tolist() == list(range(1000, 1005)) * 500
    assert max(sizes) <= 1 << 16 and sum(sizes) == 500 * 4096


def test_probes_come_in_the_order_of_their_cost():
    gaps, width = np.array([0.2, 0.7, 1.1]), 1.5
    sets = neighbours.probe_sets(gaps, width, 27)
    cost = [sum((gaps[i] if d < 0 else width - gaps[i]) ** 2 for i, d in s) for s in sets]
    assert cost == sorted(cost) and len({tuple(sorted(s)) for s in sets}) == 27


def plain_targets(sizes, share=1.5):
    names = sorted((n for n in sizes if n is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {n: [3, 1, 2][i % 3] for i, n in enumerate(names)}
    left, open_, out = share * sum(sizes.values()), set(names), {}
    while open_:
        level = left / sum(w[n] for n in open_)
        full = {n for n in open_ if level * w[n] >= 2 * sizes[n]}
        if not full:
            return out | {n: level * w[n] for n in open_}
        out |= {n: 2 * sizes[n] for n in full}
        left -= sum(2 * sizes[n] for n in full)
        open_ -= full
    return out


@pytest.mark.parametrize("name", ["edge", "docs"])
def test_mixture(name, request, none):
    df = request.getfixturevalue(name)
    got = mixing.mix(df).collect()
    table = [(r["doc_id"], r["text"], r["source"]) for r in df.collect()]
    assert Counter((r["doc_id"], r["size"], r["source"]) for r in got) == Counter((i, len(words(t)), s) for i, t, s in table)
    sizes, taken = Counter(), Counter()
    for r in got:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        assert 0 <= r["taken"] <= 2 * r["size"]
    want = plain_targets(dict(sizes))
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - want[r["source"]]) < 1e-6
    assert all(abs(taken[s] - want[s]) <= 1 for s in want)
    assert rows(mixing.mix(df.repartition(7)), "doc_id", "size", "taken") == rows(mixing.mix(df), "doc_id", "size", "taken")
    assert mixing.mix(none).count() == mixing.mixed_documents(none).count() == 0
    out = mixing.mixed_documents(df)
    assert out.columns == df.columns


def test_running_sum_spans_tasks(llm):
    df = llm.createDataFrame([("a" if i % 3 else None, i, i % 7) for i in range(500)], "g string, k long, v long")
    got = common.running_sum(df, ["g", "k"], "v", ["g"], "s", 500, each=40)
    for g in ("a", None):
        total = 0
        for k, v, s in sorted((r["k"], r["v"], r["s"]) for r in got.collect() if r["g"] == g):
            assert s == total, k
            total += v


def test_components_of_paths_and_stars(llm):
    links = [(i, i + 1) for i in range(100)] + [(1000, 1000 + i) for i in range(1, 300)] + [(2001, 2000)]
    got = {r[0]: r[1] for r in common.components(llm.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(101)} | {1000 + i: 1000 for i in range(300)} | {2000: 2000, 2001: 2000}
    assert common.components(llm.createDataFrame([], "a long, b long")).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(
    ["Hello,", "world", "l'été", "É!", "don't", "<|endoftext|>", "<|ENDOFTEXT|>", "a b", "ΣΑΣ", "İz", "éx", "x2y", "--", "''s", " ", "ﬁ", "ſ", "A.b", "한국", "..."]), max_size=12),
    st.sampled_from([" ", "\n", "\t ", " \r\n"]))
def test_word_tokens_are_the_texts_tokens(parts, gap):
    text = gap.join(parts)
    want = FULL.encode(text, add_special_tokens=False).ids
    assert MEMO.encode([text, text])[0].tolist() == [*want, 0, *want, 0]


FULL = Tokenizer.from_file(TOKENS)
MEMO = packing.WordTokens(FULL)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=80))
def test_word_tokens_of_any_text(text):
    assert MEMO.encode([text])[0].tolist() == [*FULL.encode(text, add_special_tokens=False).ids, 0]


def test_word_tokens_within_few_bytes(texts):
    """A cache far smaller than the vocabulary, cut many times, gives the same ids."""
    small, batch = packing.WordTokens(FULL, limit=1 << 16), []
    cuts = 0
    for text in list(texts.values()):
        batch.append(text)
        if len(batch) == 5:
            known = len(small.old)
            ids, ends = small.encode(batch)
            cuts += len(small.old) != known
            want = [[*e.ids, 0] for e in FULL.encode_batch_fast(batch, add_special_tokens=False)]
            assert ids.tolist() == [i for x in want for i in x] and ends.tolist() == np.cumsum([len(x) for x in want]).tolist()
            batch = []
    small.cut()
    small.cut()
    assert cuts > 5 and small.held() == 0


def test_other_tokenizers_get_whole_texts():
    assert isinstance(packing.encoder(TOKENS), packing.WordTokens)
    assert isinstance(packing.encoder(str(public_tokenizers.path("byte_bpe_50k.json"))), packing.WholeTexts)
    whole = packing.WholeTexts(FULL, 7)
    ids, ends = whole.encode(["One  two", "", " x "])
    want = [[*FULL.encode(t, add_special_tokens=False).ids, 7] for t in ("One  two", "", " x ")]
    assert ids.tolist() == [i for x in want for i in x] and ends.tolist() == np.cumsum([len(x) for x in want]).tolist()


@pytest.mark.parametrize("name", ["edge", "docs"])
def test_packing(name, request, none):
    df = request.getfixturevalue(name)
    got = packing.pack_documents(df, TOKENS).collect()
    want = Counter()
    total = 0
    for doc_id, text in [(r["doc_id"], r["text"]) for r in df.collect()]:
        ids = np.array([*FULL.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        total += len(ids)
        for k in range(0, len(ids), 2048):
            piece = ids[k : k + 2048]
            want[doc_id, k // 2048, k, len(piece), zlib.crc32(piece.tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for cells in bins.values():
        at = 0
        for offset, n in sorted(cells):
            assert offset == at
            at += n
        assert at <= 2048
    assert len(bins) <= 1.03 * total / 2048 + 2
    assert packing.pack_documents(none, TOKENS).count() == 0


def test_the_fullest_bin_closes_first_and_the_tightest_fit_wins():
    bins = packing.BestFit(10, 2)
    assert [bins.place(n) for n in (4, 7, 3, 9, 6, 5, 1)] == [(0, 0), (1, 0), (1, 7), (2, 0), (0, 4), (3, 0), (2, 9)]


def test_pipeline(llm, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = llm.read.parquet(f"{sf}/documents.parquet")
    df, counts = docs, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        df = common.written(stage(llm, df, sf), f"test-{name}")
        counts.append(df.count())
        if name != "packing":
            assert df.dtypes == docs.dtypes, name
        if name == "near_copies":
            kept = {r["doc_id"] for r in df.collect()}
    assert counts[0] >= counts[1] > counts[2] >= counts[3] > 0 and counts[5] >= counts[4]
    assert {r["doc_id"] for r in df.select("doc_id").collect()} <= kept
    assert sorted(map(tuple, corpus_pipeline.run(llm, sf).drop("sequence_id", "offset").collect())) == sorted(
        map(tuple, df.drop("sequence_id", "offset").collect()))


def test_pipeline_on_odd_and_no_rows(llm, edge, none):
    want = {
        # No text or no letter: 4, 5, 6, 11 and the row of nulls.
        "language": [1, 2, 3, 7, 8, 9, 9, 9, 10, 12, 13, 14, None],
        # Copies of the row without an id, which sorts first: 1, 2 and two rows of 9. Copy of 12: 13.
        "exact_copies": [3, 7, 8, 9, 10, 12, 14, None],
        # 3 is that row with a word more.
        "near_copies": [7, 8, 9, 10, 12, 14, None],
    }
    df, empty = edge, none
    for name, stage in corpus_pipeline.STAGES:
        df, empty = (common.written(stage(llm, x, ""), f"test-{name}") for x in (df, empty))
        ids = [r["doc_id"] for r in df.select("doc_id").collect()]
        if name in want:
            assert sorted(ids, key=lambda i: (i is None, i)) == want[name], name
        assert set(ids) <= set(want["near_copies"]) or name in want
        assert empty.count() == 0
        if name != "packing":
            assert df.dtypes == edge.dtypes and empty.dtypes == none.dtypes
