"""The queries of the corpus operators: whole tables in, the contract's columns out, and their SQL."""

from __future__ import annotations

import hashlib
import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candor.llm import (
    chat,
    divergence,
    exact_dedup,
    fingerprints,
    jaccard,
    language,
    manifest,
    mixing,
    neighbours,
    packing,
    secrets,
    substrings,
    token_counts,
)
from candor.session import tune

CONTROL_CHAT = "\\### Assistant: </turn> ok"


def tokenizer(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tune(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    model = language.fit(docs.where(~held_out))
    found = language.identify(docs, model)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substrings.remove_repeats(table(spark, sf_dir, "documents"), 20)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame(
        [(-7, 0, "user", CONTROL_CHAT), (-7, 1, "assistant", CONTROL_CHAT)], rows.schema)
    return read_back(chat.format_conversations(rows.unionByName(extra)))


def read_back(formatted: DataFrame) -> DataFrame:
    """Turns and loss text as the formatted output holds them."""
    @F.pandas_udf("n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string")
    def digests(texts: pd.Series, spans: pd.Series, roles: pd.Series) -> pd.DataFrame:
        out = []
        for text, cells, names in zip(texts, spans, roles, strict=True):
            turns = chat.parse(text)
            whole = "".join([f"{role}\n{body}\n" for role, body in turns])
            loss = "".join([
                chat.unescape(text[c["text_start"] : c["text_end"]]) for c, role in zip(cells, names, strict=True) if role == "assistant"])
            out.append((len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()))
        return pd.DataFrame(out, columns=["n_turns", "turns_sha256", "loss_chars", "loss_sha256"])

    d = digests("formatted", "spans", "roles")
    return formatted.select("conv_id", F.length("formatted").cast("long").alias("formatted_chars"), d.alias("d")).select(
        "conv_id", "d.n_turns", "d.turns_sha256", "d.loss_chars", "d.loss_sha256", "formatted_chars")


def exact_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), 2048, 0)


def near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard.similar_documents(table(spark, sf_dir, "documents"), n=3, percent=90)
    return found.select("doc_id", "n_shingles", "component_id")


def mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", (F.round(F.col("target") * 1e3) / 1e3).alias("target"), "taken")


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"), 4096)


def found_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents"))
    base = F.filter("found", lambda s: s["kind"] < 3)
    return found.select(
        "doc_id", "n_assign", "n_access", "n_hex", F.sha2(secrets.listed(base), 256).alias("base_sha256"),
        secrets.listed(F.col("found")).alias("spans"))


def document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fingerprints.edited_by_next(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def dataset_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    heads = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    own, cut = (manifest.leaf(*heads, t) for t in (F.col("text"), F.translate("text", "\n", "")))
    tampered = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0) & F.contains("text", F.lit("\n"))
    rows = manifest.verified(manifest.manifest(docs, F.when(tampered, cut).otherwise(own)))
    return rows.select(
        F.col("id").alias("doc_id"), "leaf", "subroot", "root", F.sha2(manifest.proof(F.col("path")), 256).alias("proof_sha256"),
        "folded_root", "verified")


def source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


JOBS = {
    "op1_nearest": nearest,
    "op2_languages": languages,
    "op3_repeated_passages": repeated_passages,
    "op4_chats": chats,
    "op5_exact_copies": exact_copies,
    "op6_packed": packed,
    "op7_near_copies": near_copies,
    "op8_mixture": mixture,
    "op9_tokens": tokens,
    "op10_secrets": found_secrets,
    "op11_fingerprints": document_fingerprints,
    "op12_manifest": dataset_manifest,
    "op13_divergence": source_divergence,
}

_NORMAL = r"regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')"

_EXACT = f"""
WITH t AS (SELECT doc_id, sha256({_NORMAL}) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256)
"""

_MIX = r"""
WITH t AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5('mix:' || coalesce(doc_id::VARCHAR, '')) AS k
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w
  FROM t GROUP BY source),
r AS (  -- sources by the level at which they are full; the level if exactly the ones before are full
  SELECT *, 2 * source_size / w AS full_at,
         (1.5 * sum(source_size) OVER () - coalesce(sum(2 * source_size) OVER before, 0))
         / (sum(w) OVER () - coalesce(sum(w) OVER before, 0)) AS level
  FROM s WINDOW before AS (ORDER BY 2 * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT arg_min(level, full_at) FILTER (WHERE level < full_at) AS level FROM r),
g AS (SELECT source, source_size, least(2.0 * source_size, coalesce(l.level * w, 2.0 * source_size))::DOUBLE AS target FROM r, l),
p AS (
  SELECT t.*, source_size, target, floor(target + 1e-6)::BIGINT AS budget,
         coalesce(sum(size) OVER (PARTITION BY t.source ORDER BY k, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM t JOIN g ON t.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, round(target * 1e3) / 1e3 AS target,
       (CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END * size
        + greatest(0, least(size, CASE WHEN source_size > 0 THEN budget % source_size ELSE 0 END - before)))::BIGINT AS taken
FROM p
"""

_MANIFEST = r"""
WITH RECURSIVE t AS (
  SELECT doc_id, source, concat(
           coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'),
           coalesce(strlen(lang) || ':' || lang, '-'), coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-')) AS head, text,
         list_reduce(list_prepend(4294967295::BIGINT, [ascii(c)::BIGINT FOR c IN string_split(doc_id::VARCHAR, '')]),
           lambda crc, b: list_reduce(list_prepend(xor(crc, b), range(8)),
             lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))) & 1 = 1 AS tampered  -- the CRC is the complement
  FROM documents),
leaves AS (
  SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
         CASE WHEN tampered THEN sha256(head || coalesce(strlen(replace(text, chr(10), '')) || ':' || replace(text, chr(10), ''), '-'))
              ELSE sha256(head || coalesce(strlen(text) || ':' || text, '-')) END AS changed,
         row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS rank
  FROM t),
level AS (
  SELECT source, 0 AS l, list(leaf ORDER BY rank) AS nodes FROM leaves GROUP BY source
  UNION ALL
  SELECT source, l + 1, [sha256(array_to_string(nodes[3 * i + 1 : 3 * i + 3], '')) FOR i IN range((len(nodes) + 2) // 3)]
  FROM level WHERE len(nodes) > 1),
subroots AS (
  SELECT source, nodes[1] AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS rank FROM level WHERE len(nodes) = 1),
high AS (
  SELECT 0 AS l, list(subroot ORDER BY rank) AS nodes FROM subroots
  UNION ALL
  SELECT l + 1, [sha256(array_to_string(nodes[3 * i + 1 : 3 * i + 3], '')) FOR i IN range((len(nodes) + 2) // 3)]
  FROM high WHERE len(nodes) > 1),
steps AS (  -- a row for each leaf and level: what stands before and after its node in the run
  SELECT doc_id, 0 AS tree, l, nodes[3 * (rank // pow(3, l + 1)::BIGINT) + 1 : (rank // pow(3, l)::BIGINT)] AS before,
         nodes[(rank // pow(3, l)::BIGINT) + 2 : 3 * (rank // pow(3, l + 1)::BIGINT) + 3] AS after
  FROM leaves JOIN level ON leaves.source IS NOT DISTINCT FROM level.source WHERE len(nodes) > 1
  UNION ALL
  SELECT doc_id, 1, l, nodes[3 * (s.rank // pow(3, l + 1)::BIGINT) + 1 : (s.rank // pow(3, l)::BIGINT)],
         nodes[(s.rank // pow(3, l)::BIGINT) + 2 : 3 * (s.rank // pow(3, l + 1)::BIGINT) + 3]
  FROM leaves JOIN subroots s ON leaves.source IS NOT DISTINCT FROM s.source, high WHERE len(nodes) > 1),
paths AS (
  SELECT doc_id, list([array_to_string(before, ''), array_to_string(after, '')] ORDER BY tree, l) AS path FROM steps GROUP BY doc_id),
folded AS (
  SELECT leaves.doc_id, leaf, subroot, (SELECT nodes[1] FROM high WHERE len(nodes) = 1) AS root,
         sha256(array_to_string([p[1] || p[2] FOR p IN coalesce(path, [])], '')) AS proof_sha256,
         list_reduce(list_prepend([changed, ''], coalesce(path, [])), lambda a, p: [sha256(p[1] || a[1] || p[2]), ''])[1] AS folded_root
  FROM leaves JOIN subroots s ON leaves.source IS NOT DISTINCT FROM s.source LEFT JOIN paths USING (doc_id))
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM folded
"""

_DIVERGENCE = r"""
WITH d AS (
  SELECT row_number() OVER () AS n, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
w AS (
  SELECT n, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d),
kept AS (SELECT lang, term, count(*)::HUGEINT AS total FROM w GROUP BY lang, term HAVING count(DISTINCT n) >= 3),
lang AS (SELECT lang, count(*)::HUGEINT AS v, sum(total)::HUGEINT AS n FROM kept GROUP BY lang),
c AS (SELECT lang, source, term, count(*)::HUGEINT AS c FROM w JOIN kept USING (lang, term) GROUP BY lang, source, term),
g AS (
  SELECT lang, source, coalesce(n, 0)::HUGEINT AS n, coalesce(v, 0)::HUGEINT AS v FROM (SELECT DISTINCT lang, source FROM d)
  LEFT JOIN (SELECT lang, source, sum(c)::HUGEINT AS n FROM c GROUP BY lang, source) USING (lang, source)
  LEFT JOIN (SELECT lang, v FROM lang) USING (lang)),
p AS (
  SELECT g.lang, g.source, kept.term, coalesce(c.c, 0) AS c, 1 + 1000000000 * (coalesce(c.c, 0) + 1) // (g.n + g.v) AS p,
         1 + 1000000000 * (total + 1) // (lang.n + lang.v) AS q
  FROM g JOIN kept USING (lang) JOIN lang USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term),
f AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item,
         coalesce(s.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // y.p) AS value
             FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) s
  ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM p WHERE c > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM f)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM r WHERE part = 'pair' OR rank <= 200
"""

ORACLES = {"op5_exact_copies": _EXACT, "op8_mixture": _MIX, "op12_manifest": _MANIFEST, "op13_divergence": _DIVERGENCE}

assert all(re.fullmatch(r"op\d+_\w+", name) for name in JOBS)
