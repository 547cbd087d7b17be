"""Fingerprints, the Merkle manifest and the source divergence audit, against plain versions."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from helpers import edge_rows, rows, sha
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from candor.llm import divergence, fingerprints, manifest, queries

# Fingerprints


def plain_digest(text):
    data = b"\0\0" + text.encode() + b"\0\0"
    counts = [0] * fingerprints.BUCKETS
    for i in range(len(data) - 2):
        h = int.from_bytes(data[i : i + 3], "big") * 2654435761 % 2**32
        h = (h ^ h >> 15) * 0x85EBCA6B % 2**32
        counts[(h ^ h >> 13) % fingerprints.BUCKETS] += 1
    n = len(counts)
    cuts = [sorted(counts)[n * k // 4 - 1] for k in (1, 2, 3)]
    codes = [sum(c > q for q in cuts) for c in counts]
    length = min(255, round(np.log1p(len(text.encode())) / np.log(fingerprints.LENGTH_STEP)))
    body = [sum(codes[4 * i + k] << 2 * k for k in range(4)) for i in range(n // 4)]
    return bytes([length, *body]).hex()


def plain_score(a, b):
    x, y = bytes.fromhex(a), bytes.fromhex(b)
    gap = min(fingerprints.LENGTH_CAP, fingerprints.LENGTH_COST * abs(x[0] - y[0]))
    gap += sum(abs((p >> s & 3) - (q >> s & 3)) for p, q in zip(x[1:], y[1:], strict=True) for s in (0, 2, 4, 6))
    return 1 - min(gap, fingerprints.FARTHEST) / fingerprints.FARTHEST


@settings(deadline=None, max_examples=30)
@given(st.lists(st.text(max_size=80), min_size=1, max_size=8))
def test_digests(texts):
    got = fingerprints.digests([t.encode() for t in texts])
    assert got == [plain_digest(t) for t in texts]
    assert fingerprints.scores(got, got[::-1]).tolist() == pytest.approx([plain_score(a, b) for a, b in zip(got, got[::-1], strict=True)])


def test_digests_of_many_and_long_texts():
    texts = ["one", "two " * 400_000, *(f"text {i}" for i in range(2_500)), "", "one"]
    got = fingerprints.digests([t.encode() for t in texts])
    assert [got[i] for i in (0, 1, 5, 2_000, -2, -1)] == [plain_digest(texts[i]) for i in (0, 1, 5, 2_000, -2, -1)]
    assert len(got) == len(texts) and got[0] == got[-1]


def plain_edited(table):
    """Ids in order (null last, then by a hash that only ties of one id need), with their edited texts."""
    order = sorted(table, key=lambda r: (r[0] is None, r[0] or 0))
    out = []
    for i, (doc_id, text) in enumerate(order):
        after = order[(i + 1) % len(order)][1]
        half = len(text) // 2
        out.append((doc_id, len(text), text[: len(text) - half] + after[:half], plain_digest(text), plain_digest(after)))
    return out


@pytest.mark.parametrize("range_rows", [1, 7, 1_000])
def test_edited_by_next(llm, range_rows):
    table = [(i * 37 % 101, f"{i} " + "käse und brot 𝄞 " * (i % 9)) for i in range(101)]
    df = llm.createDataFrame(table, "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: r for r in fingerprints.edited_by_next(df, range_rows=range_rows).collect()}
    want = plain_edited(table)
    assert len(got) == len(want)
    for doc_id, n, edited, own, after in want:
        r = got[doc_id]
        assert (r["n_chars"], r["edited"], r["fingerprint"], r["edited_fingerprint"]) == (n, edited, own, plain_digest(edited))
        assert r["near_edited"] == pytest.approx(plain_score(own, plain_digest(edited))) and r["near_next"] == pytest.approx(plain_score(own, after))


def test_fingerprint_odd_rows(llm, edge, none):
    got = fingerprints.edited_by_next(edge, range_rows=4).collect()
    assert sorted((r["doc_id"] or -1, r["n_chars"]) for r in got) == sorted((r[0] or -1, len(r[1] or "")) for r in edge_rows())
    assert all(0 <= r[c] <= 1 for r in got for c in ("near_edited", "near_next"))
    by_id = {r["doc_id"]: r for r in got}
    texts = {r[0]: r[1] or "" for r in edge_rows()}
    assert by_id[1]["edited"] == texts[1][: len(texts[1]) - len(texts[1]) // 2] + texts[2][: len(texts[1]) // 2]
    assert by_id[12]["fingerprint"] == by_id[13]["fingerprint"] and by_id[12]["near_next"] == 1
    assert by_id[4]["fingerprint"] == by_id[5]["fingerprint"] == plain_digest("")
    assert fingerprints.edited_by_next(none).count() == 0 and fingerprints.fingerprints(none).count() == 0
    one = fingerprints.edited_by_next(edge.where("doc_id = 8")).collect()
    assert one[0]["edited"] == "x" * 50_000 and one[0]["near_next"] == 1
    assert fingerprints.fingerprints(edge).count() == len(edge_rows())


def test_fingerprints_tell_halves_from_strangers(llm):
    got = queries.document_fingerprints(llm, "/root/testdata/sf0.01").collect()
    edited, after = np.array([(r["near_edited"], r["near_next"]) for r in got]).T
    assert (edited >= after).mean() > 0.98 and np.median(edited) > 0.45 > 0.25 > np.median(after)


# Manifest


def plain_field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def plain_leaf(row):
    doc_id, text, lang, source, n_chars = row
    return sha("".join(map(plain_field, (doc_id, source, lang, n_chars, text))))


def plain_tree(nodes):
    """The root, and each leaf's runs with its place in them."""
    paths = [[] for _ in nodes]
    place = list(range(len(nodes)))
    while len(nodes) > 1:
        groups = [nodes[i : i + 3] for i in range(0, len(nodes), 3)]
        for path, i in zip(paths, place, strict=True):
            path.append((groups[i // 3], i % 3))
        place = [i // 3 for i in place]
        nodes = [sha("".join(g)) for g in groups]
    return nodes[0], paths


def plain_manifest(table, change):
    by_source = defaultdict(list)
    for row in table:
        by_source[row[3]].append(row)
    names = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    subs = {}
    for s in names:
        by_source[s].sort(key=lambda r: (r[0] is None, r[0] or 0, plain_leaf(r)))
        subs[s] = plain_tree([plain_leaf(r) for r in by_source[s]])
    root, tops = plain_tree([subs[s][0] for s in names])
    out = []
    for s, top in zip(names, tops, strict=True):
        for row, path in zip(by_source[s], subs[s][1], strict=True):
            folded, beside = plain_leaf(change(row)), ""
            for group, i in path + top:
                beside += "".join(group[:i] + group[i + 1 :])
                folded = sha("".join(group[:i]) + folded + "".join(group[i + 1 :]))
            out.append((row[0], plain_leaf(row), subs[s][0], root, sha(beside), folded, folded == root))
    return sorted(out, key=repr)


def shown(df):
    rows_ = df.select("id", "leaf", "subroot", "root", F.sha2(manifest.proof(F.col("path")), 256).alias("proof"), "folded_root", "verified")
    return rows(rows_)


def own_leaf(text):
    return manifest.leaf(*[F.col(c) for c in ("doc_id", "source", "lang", "n_chars")], text)


@pytest.mark.parametrize("span", [1, 2, 6])
def test_manifest_of_all_sizes(llm, span):
    sizes = [1, 2, 3, 4, 9, 10, 28, 82] if span < 6 else [1, 3, 730]
    table = [(k * 1000 + i * 7 % 991, f"text\n{i}", "en", None if k == 0 else f"s{k}é", i) for k, n in enumerate(sizes) for i in range(n)]
    df = llm.createDataFrame(table, "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    cut = F.when(F.col("doc_id") % 3 == 0, own_leaf(F.translate("text", "\n", ""))).otherwise(own_leaf(F.col("text")))
    got = shown(manifest.verified(manifest.manifest(df, cut, span=span)))
    want = plain_manifest(table, lambda r: (r[0], r[1].replace("\n", ""), *r[2:]) if r[0] % 3 == 0 else r)
    assert got == want and {x[-1] for x in got} == {True, False}


def test_manifest_odd_rows(llm, edge, none):
    got = shown(manifest.verified(manifest.manifest(edge, span=1)))
    assert got == plain_manifest(edge_rows(), lambda r: r) and all(x[-1] for x in got)
    assert manifest.manifest(none).count() == 0
    one = shown(manifest.verified(manifest.manifest(edge.where("doc_id = 8"))))
    row = next(r for r in edge_rows() if r[0] == 8)
    assert one == [(8, plain_leaf(row), plain_leaf(row), plain_leaf(row), sha(""), plain_leaf(row), True)]


def test_manifest_query(llm, docs):
    table = [(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in docs.collect()]
    tampered = lambda r: (r[0], r[1].replace("\n", ""), *r[2:]) if r[1] and zlib.crc32(str(r[0]).encode()) % 2 == 0 else r
    got = rows(queries.dataset_manifest(llm, "/root/testdata/sf0.001"))
    assert got == plain_manifest(table, tampered)


# Divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(0x41, 0x5B)}


def plain_audit(table, least=3, top=200):
    counts, documents = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in table:
        found = [t.translate(LOWER) for t in TERM.findall(text or "")]
        counts[lang or "", source or ""].update(found)
        documents[lang or ""].update(set(found))
    out = []
    for lang in documents:
        kept = sorted(t for t, n in documents[lang].items() if n >= least)
        groups = {s: c for (own, s), c in counts.items() if own == lang}
        whole = sum(groups.values(), Counter())

        def chances(c, kept=kept):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 1) // (n + len(kept)) for t in kept}

        p, q = {s: chances(c) for s, c in groups.items()}, chances(whole)
        for s, c in groups.items():
            pair = [(b, sum((p[s][t] - p[b][t]) ** 2 // p[b][t] for t in kept)) for b in groups if b != s]
            term = [(t, (p[s][t] - q[t]) ** 2 // q[t]) for t in kept if c[t] and p[s][t] > q[t]]
            for part, found, limit in (("pair", pair, None), ("term", term, top)):
                order = sorted(found, key=lambda x: (-x[1], x[0].encode()))[:limit]
                out += [(lang, s, part, item, value, i + 1) for i, (item, value) in enumerate(order)]
    return sorted(out, key=repr)


def audited(df, **kw):
    return rows(divergence.audit(df, **kw), "lang", "source", "part", "item", "value", "rank")


@pytest.mark.parametrize("block_bytes,shard_bytes", [(1, 500), (4_000, 50), (1 << 20, 1 << 20)])
def test_audit(llm, block_bytes, shard_bytes):
    # Many runs that overlap, a source with a third of all rows, terms on the edge of three documents.
    words = ["Ähre", "brot", "Brot", "x1y", "naïve", "日本", "zoo", "ant", "bee", "cat", "dog"]
    table = [(" ".join(words[(i * k + i // 7) % len(words)] for k in range(1, 2 + i % 6)) + f" only{chr(97 + i % 20)}{chr(97 + i // 3 % 26)}",
              ("en", "de", None)[i % 3], "big" if i % 3 == 1 else f"s{i % 5}") for i in range(150)]
    df = llm.createDataFrame(table, "text string, lang string, source string").repartition(3)
    got = audited(df, block_bytes=block_bytes, shard_bytes=shard_bytes)
    assert got == plain_audit(table)
    assert audited(df, block_bytes=block_bytes, shard_bytes=shard_bytes, least=1, top=3) == plain_audit(table, 1, 3)


def test_audit_documents(llm, docs):
    assert audited(docs) == plain_audit([(r["text"], r["lang"], r["source"]) for r in docs.collect()])


def test_audit_odd_rows(llm, edge, none):
    assert audited(edge, least=1) == plain_audit([(r[1], r[2], r[3]) for r in edge_rows()], 1)
    assert audited(edge) == plain_audit([(r[1], r[2], r[3]) for r in edge_rows()])
    assert audited(none) == []
    empty = llm.createDataFrame([("", "en", "a"), (None, "en", "b"), ("1 2 3", "en", None)], "text string, lang string, source string")
    assert audited(empty) == [("en", s, "pair", i, 0, k) for s in ("", "a", "b") for k, i in enumerate(sorted({"", "a", "b"} - {s}), 1)]


def test_chance_is_exact(llm):
    cells = [(0, 0, 1), (4 * 10**15, 8 * 10**15, 10**6), (10**12, 3 * 10**12, 7), (5, 12, 3), (0, 10**15, 1)]
    df = llm.createDataFrame(cells, "c long, n long, v long")
    got = df.select(divergence.chance(F.col("c"), F.col("n"), F.col("v"))).collect()
    assert [r[0] for r in got] == [1 + 10**9 * (c + 1) // (n + v) for c, n, v in cells]
