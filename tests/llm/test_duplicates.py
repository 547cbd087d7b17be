"""Exact copies, repeated passages and near copies against plain versions."""

from itertools import combinations

import numpy as np
import pytest
from helpers import DOCS, SPACE, edge_rows, long_text, rows, sha, words

from candor.llm import exact_dedup, jaccard, substrings

LOW = -(2**63)


def plain_exact(table):
    groups = {}
    for doc_id, text in table:
        groups.setdefault(SPACE.sub(" ", text or ""), []).append(doc_id)
    out, kept = [], set()
    for doc_id, text in table:
        t = SPACE.sub(" ", text or "")
        ids = groups[t]
        keep = min(ids, key=lambda x: LOW if x is None else x)
        first = doc_id == keep and t not in kept
        if first:
            kept.add(t)
        out.append((doc_id, keep, len(ids), first, sha(t)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("n, k, each", [(0, 2, 5), (1, 2, 5), (7, 1, 3), (9, 2, 4), (8, 3, 6), (30, 2, 1 << 18)])
def test_token_sets_come_in_blocks(n, k, each):
    blocks = list(jaccard.blocks_of_sets(n, k, each))
    assert all(0 < len(b) <= each for b in blocks)
    assert sorted(map(tuple, (x for b in blocks for x in b.tolist()))) == list(combinations(range(n), k))


@pytest.mark.parametrize("batches", [1, 2, 4])
def test_exact_copies(edge, docs, batches):
    got = rows(exact_dedup.exact_duplicates(edge, batches))
    assert got == plain_exact([(r[0], r[1]) for r in edge_rows()])
    if batches == 2:
        got = rows(exact_dedup.exact_duplicates(docs))
        assert got == plain_exact([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_keep_first_keeps_columns_and_one_of_each(edge, none):
    kept = exact_dedup.keep_first(edge)
    assert kept.columns == edge.columns
    want = [r for r in plain_exact([(r[0], r[1]) for r in edge_rows()]) if r[3]]
    assert sorted((r["doc_id"] for r in kept.collect()), key=repr) == sorted((r[0] for r in want), key=repr)
    assert exact_dedup.exact_duplicates(none).count() == exact_dedup.keep_first(none).count() == 0


def test_a_digest_clash_is_no_copy(llm):
    """Matches are believed only after their bytes were compared."""
    docs = llm.createDataFrame([(1, "one"), (5, "two"), (6, "one")], "doc_id long, text string")
    prints = exact_dedup.fingerprints(docs).collect()
    digest = {r["doc_id"]: r["digest"] for r in prints}
    pairs = llm.createDataFrame(
        [(digest[1], 3, 1, 6), (digest[5], 3, 1, 5)], "digest binary, n_bytes int, snap_id long, first_id long")
    assert [r["first_id"] for r in exact_dedup.same_bytes(pairs, docs, "doc_id", "text").collect()] == [6]


@pytest.mark.parametrize("n", [1, 2, 3, 50, 5_000, 100_000])
def test_filter_holds_all_its_keys_and_few_others(n):
    rng = np.random.default_rng(n)
    keys = rng.integers(0, 2**63, n, dtype=np.uint64)
    blob = exact_dedup.build_filter(keys)
    assert exact_dedup.may_hold(blob, keys).all()
    others = rng.integers(2**63, 2**64 - 1, 100_000, dtype=np.uint64)
    assert exact_dedup.may_hold(blob, others).mean() < 0.006
    assert n < 100_000 or len(blob) < 1.35 * n


def plain_passages(table, size):
    first = {}
    for doc_id, text in sorted(table, key=lambda r: LOW if r[0] is None else r[0]):
        w = words(text)
        for i in range(len(w) - size + 1):
            at = (LOW if doc_id is None else doc_id, i)
            k = tuple(w[i : i + size])
            first[k] = min(first.get(k, at), at)
    out = []
    for doc_id, text in table:
        w = words(text)
        gone = set()
        for i in range(len(w) - size + 1):
            if first[tuple(w[i : i + size])] != (LOW if doc_id is None else doc_id, i):
                gone.update(range(i, i + size))
        kept = [x for i, x in enumerate(w) if i not in gone]
        out.append((doc_id, len(w), len(w) - len(kept), " ".join(kept)))
    return sorted(out, key=repr)


def test_repeated_passages(edge, docs, none, llm, monkeypatch):
    cols = ("doc_id", "n_words", "n_removed", "kept")
    assert rows(substrings.remove_repeats(edge, 20), *cols) == plain_passages([(r[0], r[1]) for r in edge_rows()], 20)
    table = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = rows(substrings.remove_repeats(docs, 20), *cols)
    assert got == plain_passages(table, 20)
    assert sum(r[2] for r in got) > 0
    assert substrings.remove_repeats(none, 20).count() == 0
    p, q, loop = long_text(25, 1), long_text(25, 2), "a b c " * 40
    table = [(1, f"{p} {q}"), (2, f"x {q} y {p} z"), (3, loop), (4, f"{loop} end"), (5, p[: p.rindex(" ")])]
    df = llm.createDataFrame([(*r, None, None, 0) for r in table], DOCS).repartition(5)
    assert rows(substrings.remove_repeats(df, 20), *cols) == plain_passages(table, 20)
    cut = [r["removed"] for r in substrings.remove_repeats(df, 20).where("doc_id = 2").collect()][0]
    assert [(x["start"], x["end"]) for x in cut] == [(1, 26), (27, 52)]


def chunk_of(table, size=20):
    chunk = substrings.Chunk(size)
    for doc_id, sha, text in table:
        chunk.add(doc_id, sha, text)
    return chunk


def test_marks_of_a_chunk_are_keyed_by_document():
    table = [(2 * i + j, 1000 + i, long_text(40, i)) for i in range(64) for j in range(2)]
    got = list(chunk_of(table).rows(8))
    marks = {key: substrings._marked(blob) for key, _, blob in got if blob}
    assert {key for key, entries, _ in got if entries} == set(range(8)) and set(marks) == set(range(8, 16))
    found = sorted((int(i), int(s)) for ids, _, starts in marks.values() for i, s in zip(ids, starts, strict=True))
    assert found == [(2 * i + 1, s) for i in range(64) for s in range(21)]


def test_marks_of_copies_spread_over_buckets():
    text = long_text(40, 5)
    got = [(key, substrings._marked(blob)) for key, _, blob in chunk_of([(i, 77, text) for i in range(64)]).rows(8) if blob]
    assert len({key for key, _ in got}) == 8 and max(len(starts) for _, (_, _, starts) in got) <= 21 * 16
    assert sorted(int(i) for _, (ids, _, _) in got for i in ids) == sorted(list(range(1, 64)) * 21)


def test_marks_of_a_repeated_row_are_sent_once():
    ids, shas, starts = (np.repeat(x, 5) for x in (np.array([-4, 9, 9]), np.array([1, 2, 2]), np.array([8, 0, 7])))
    got = substrings._marked(substrings._marks(ids, shas, starts))
    assert [x.tolist() for x in got] == [[-4, 9, 9], [1, 2, 2], [8, 0, 7]]


def test_packed_entries_come_back():
    key = np.array([5, 2**56 - 1, 7, 0], np.uint64)
    blob = substrings._blob(key, np.array([0, 0, 2, 2]), np.array([3, 900, 0, 70_000], np.uint32), np.array([-4, 1, 9]), np.array([11, 12, 13]))
    got = substrings._entries(blob)
    assert [x.tolist() for x in got] == [key.tolist(), [3, 900, 0, 70_000], [-4, -4, 9, 9], [11, 11, 13, 13]]


def plain_near(table, n, percent):
    sets = []
    for doc_id, text in table:
        w = [re_lower(x) for x in words(text)]
        sets.append((LOW if doc_id is None else doc_id, {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()))
    comp = list(range(len(sets)))

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i, (a, s) in enumerate(sets):
        for j in range(i):
            b, t = sets[j]
            if s and t and 100 * len(s & t) >= percent * len(s | t):
                comp[root(i)] = root(j)
    least = {}
    for i, (a, _) in enumerate(sets):
        least[root(i)] = min(least.get(root(i), a), a)
    name = lambda x: None if x == LOW else x
    return sorted(((name(a), len(s), name(least[root(i)])) for i, (a, s) in enumerate(sets)), key=repr)


def re_lower(x):
    return x.encode().lower().decode()


@pytest.mark.parametrize(("n", "percent", "rare"), [(3, 90, 32), (5, 80, 32), (5, 80, 1)])
def test_near_copies(edge, docs, n, percent, rare):
    got = rows(jaccard.similar_documents(edge, n, percent, rare=rare), "doc_id", "n_shingles", "component_id")
    assert got == plain_near([(r[0], r[1]) for r in edge_rows()], n, percent)
    got = rows(jaccard.similar_documents(docs, n, percent, rare=rare), "doc_id", "n_shingles", "component_id")
    assert got == plain_near([(r["doc_id"], r["text"]) for r in docs.collect()], n, percent)


@pytest.mark.parametrize("n, common", [(0, 0), (1, 0), (40, 39), (400, 380), (5000, 100)])
def test_marks_differ_in_no_more_bits_than_tokens(n, common):
    rng = np.random.default_rng(n)
    some = rng.integers(-(2**63), 2**63 - 1, 2 * n - common + 1, dtype=np.int64)
    a, b = some[:n], some[n - common : 2 * n - common]
    marks = [jaccard.parity_mark(x) for x in (a, b)]
    assert all(len(m) == len(jaccard.MARK) for m in marks)
    differ = sum(int(x).bit_count() for x in (marks[0] ^ marks[1]).view(np.uint64))
    assert differ <= 2 * (n - common) and differ % 2 == 0


@pytest.mark.parametrize("rare", [32, 1])
def test_chains_and_frequent_words(llm, rare):
    """Links that only hold step by step, in a table where most n-grams are shared by all documents."""
    common = long_text(120, 1).split()
    table = []
    for i in range(60):
        w = list(common)
        for j in range(i // 2):
            w[(j * 11) % 120] = f"edit{j % 7}"
        table.append((100 - i, " ".join(w)))
    table += [(200 + i, " ".join(common[: 8 + i])) for i in range(40)]
    df = llm.createDataFrame(table, "doc_id long, text string")
    got = rows(jaccard.similar_documents(df, 2, 80, rare=rare), "doc_id", "n_shingles", "component_id")
    assert got == plain_near(table, 2, 80)
    assert 1 < len({r[2] for r in got}) < 90


@pytest.mark.parametrize("row_tests", [jaccard.ROW_TESTS, 0])
def test_shared_passages_are_not_combined_where_pairs_are_fewer(llm, monkeypatch, row_tests):
    """Texts that share a passage but are no copies: pairs of them are tested, no pairs of the passage's words are written."""
    passage = long_text(36, 2)
    table = [(i, passage + " " + long_text(5, 10 + i)) for i in range(40)]
    table += [(100 + i, text + " end") for i, text in table[::10]]
    made, combined = [], jaccard._combined

    def counted(entries, k):
        out = combined(entries, k)
        made.append(out.count())
        return out

    monkeypatch.setattr(jaccard, "_combined", counted)
    df = llm.createDataFrame(table, "doc_id long, text string")
    got = rows(jaccard.similar_documents(df, 3, 80, rare=2, row_tests=row_tests), "doc_id", "n_shingles", "component_id")
    assert got == plain_near(table, 3, 80)
    assert len({r[2] for r in got}) == 40
    assert not made if row_tests else made[0] > 200


@pytest.mark.parametrize("most", [1, jaccard.MOST])
def test_combinations_of_frequent_words(llm, monkeypatch, most):
    """The result is the same whichever tokens are combined."""
    monkeypatch.setattr(jaccard, "MOST", most)
    passage = long_text(30, 2).split()
    table = [(i, " ".join([*passage[: 20 + i % 11], *long_text(9, 10 + i % 25).split()])) for i in range(60)]
    df = llm.createDataFrame(table, "doc_id long, text string")
    got = rows(jaccard.similar_documents(df, 2, 80, rare=1, row_tests=1), "doc_id", "n_shingles", "component_id")
    assert got == plain_near(table, 2, 80)


def test_keep_one_of_each_component(edge, none, docs):
    kept = jaccard.keep_one(edge)
    assert kept.columns == edge.columns
    want = {r[0] for r in plain_near([(r[0], r[1]) for r in edge_rows()], 5, 80) if r[0] == r[2]}
    assert {r["doc_id"] for r in kept.collect()} == want
    assert jaccard.similar_documents(none).count() == jaccard.keep_one(none).count() == 0
