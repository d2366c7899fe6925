"""The queries of this subpackage: each applies one operator to its whole table, with production parameters."""

from __future__ import annotations

import os
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwarden.llm import bpe, chat_format, decontaminate, exact_dedup, language_id, language_model, merkle, near_dedup, quality, substring_dedup, token_alignment, token_files, url_filter
from sparkwarden.llm.common import held_out, table

#: Where each executor has the vocabularies; a parameter, since a cluster may keep them elsewhere.
VOCABULARIES = os.environ.get("SPARKWARDEN_VOCABULARIES", os.path.dirname(public_tokenizers.path("README.md")))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels"), ~held_out(F.col("_id")))
    scored = quality.score(docs, model, keep=["doc_id"])
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_passages", "focus")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_passages(table(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.train(docs, ~held_out(F.col("doc_id")))
    return language_id.identify(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "ambiguous")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), decontaminate.contaminated().alias("contaminated"))


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), f"{VOCABULARIES}/byte_bpe_multi_50k.tiktoken", with_ids=False)


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen, rejected = chat_format.swapped_replies(table(spark, sf_dir, "conversations"))
    pairs = chat_format.preference_pairs(chosen, rejected)
    text = {c: F.array_join(F.transform(c, lambda m: F.concat_ws("-", m["start"], m["end"])), ",") for c in ("chosen_mask", "rejected_mask")}
    return pairs.withColumns(text)


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicate(table(spark, sf_dir, "documents"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = token_files.write_token_files(table(spark, sf_dir, "documents"), f"{VOCABULARIES}/byte_bpe_50k.json", added=True)
    return token_files.read_documents(manifest)


def op11_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score(table(spark, sf_dir, "documents"), F.crc32(F.col("_id").cast("string")) % 7 != 2)


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.align(table(spark, sf_dir, "documents"), f"{VOCABULARIES}/byte_bpe_50k.json", f"{VOCABULARIES}/piece_bpe_32k.model")


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = merkle.build(table(spark, sf_dir, "documents"), other=merkle.lower_cased())
    return merkle.verify(merkle.witnesses(manifest)).select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}


OP7_SQL = r"""
WITH rests AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), cuts AS (
  SELECT page_id, rest, length(regexp_replace(rest, '(?s)[/?#].*$', '')) AS host_length, length(regexp_replace(rest, '(?s)[?#].*$', '')) AS whole_length FROM rests
), parts AS (
  SELECT page_id, translate(substr(rest, 1, host_length), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         substr(rest, host_length + 1, whole_length - host_length) AS path
  FROM cuts
), rules(host_end, prefix, verdict) AS (
  VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')
), fitting AS (
  SELECT DISTINCT p.host, p.path, max_by(r.host_end || r.prefix, length(r.host_end || r.prefix)) OVER w AS rule,
         max_by(r.verdict, length(r.host_end || r.prefix)) OVER w AS verdict
  FROM parts p JOIN rules r ON (p.host = r.host_end OR ends_with(p.host, '.' || r.host_end)) AND starts_with(p.path, r.prefix)
  WINDOW w AS (PARTITION BY p.host, p.path)
), words AS (
  SELECT page_id, list_filter(['spam', 'casino', 'porn', 'xxx', 'viagra', 'torrent', 'warez', 'escort'],
    lambda x: list_contains(regexp_extract_all(host || path, '[A-Za-z0-9\x{80}-\x{10ffff}]+'), x)) AS found
  FROM parts
), longest AS (
  SELECT page_id, (SELECT min(w) FROM unnest(found) AS u(w) WHERE length(w) = (SELECT max(length(v)) FROM unnest(found) AS t(v))) AS word FROM words
)
SELECT p.page_id, p.host, p.path, f.rule,
       coalesce(f.verdict, CASE WHEN w.word IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict, coalesce(f.rule, '~' || w.word) AS matched
FROM parts p LEFT JOIN fitting f ON p.host = f.host AND p.path = f.path
JOIN longest w ON w.page_id IS NOT DISTINCT FROM p.page_id
"""

OP4_SQL = r"""
WITH item_words AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), doc_words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), windows AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS m, array_to_string(list_slice(w, i, i + least(10, len(w)) - 1), ' ') AS s
  FROM item_words, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS t(i) WHERE len(w) > 0
), sizes AS (SELECT DISTINCT m FROM windows), places AS (
  SELECT doc_id, m, i, array_to_string(list_slice(w, i, i + m - 1), ' ') AS s
  FROM doc_words, sizes, unnest(range(1, greatest(1, len(w) - m + 2))) AS t(i)
), found AS (SELECT p.doc_id, p.i, p.m, v.item_id FROM places p JOIN windows v ON p.m = v.m AND p.s = v.s),
hit AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM found, unnest(range(i, i + m)) AS t(j) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS names FROM found GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(i.n_items, 0) AS n_items,
       sha256(coalesce(i.names, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM doc_words d LEFT JOIN hit h ON h.doc_id IS NOT DISTINCT FROM d.doc_id LEFT JOIN items i ON i.doc_id IS NOT DISTINCT FROM d.doc_id
"""

OP8_SQL = r"""
WITH c AS (SELECT DISTINCT conv_id AS pair_id, turn, role, text FROM conversations),
last AS (SELECT pair_id, max(turn) AS at, max_by(text, turn) AS reply FROM c WHERE role = 'assistant' GROUP BY pair_id),
r AS (
  SELECT c.pair_id, c.turn, c.role, c.text FROM c LEFT JOIN last l ON c.pair_id = l.pair_id WHERE l.at IS NULL OR c.turn < l.at
  UNION ALL SELECT l.pair_id, l.at, 'assistant', o.reply FROM last l JOIN last o ON o.pair_id = xor(l.pair_id, 1)
),
a AS (SELECT pair_id, turn, row_number() OVER (PARTITION BY pair_id ORDER BY turn, role, text) - 1 AS place, role, text FROM c),
b AS (SELECT pair_id, turn, row_number() OVER (PARTITION BY pair_id ORDER BY turn, role, text) - 1 AS place, role, text FROM r),
j AS (
  SELECT coalesce(a.pair_id, b.pair_id) AS pair_id, coalesce(a.place, b.place) AS place, a.role AS role_a, a.text AS text_a, b.role AS role_b, b.text AS text_b
  FROM a FULL JOIN b ON a.pair_id = b.pair_id AND a.place = b.place
),
p AS (
  SELECT pair_id, coalesce(min(place) FILTER (WHERE role_a IS DISTINCT FROM role_b OR text_a IS DISTINCT FROM text_b), max(place) + 1) AS n_prompt_turns FROM j GROUP BY pair_id
),
sides AS (SELECT 'a' AS side, * FROM a UNION ALL SELECT 'b', * FROM b),
k AS (
  SELECT side, pair_id, turn // 64 AS block, place, role, n_prompt_turns, place < n_prompt_turns AS shared,
         '<|' || role || '|>' || chr(10) AS head, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS said
  FROM sides JOIN p USING (pair_id)
),
s AS (
  SELECT *, coalesce(sum(CASE WHEN shared THEN 0 ELSE length(said) END) OVER (PARTITION BY side, pair_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begun FROM k
),
m AS (SELECT *, CAST(CAST(begun + length(head) AS BIGINT) AS VARCHAR) || '-' || CAST(CAST(begun + length(said) - 1 AS BIGINT) AS VARCHAR) AS mask FROM s)
SELECT pair_id, block, n_prompt_turns,
       coalesce(string_agg(said, '' ORDER BY place) FILTER (WHERE side = 'a' AND shared), '') AS prompt,
       coalesce(string_agg(said, '' ORDER BY place) FILTER (WHERE side = 'a' AND NOT shared), '') AS chosen,
       coalesce(string_agg(mask, ',' ORDER BY place) FILTER (WHERE side = 'a' AND NOT shared AND role = 'assistant'), '') AS chosen_mask,
       coalesce(string_agg(said, '' ORDER BY place) FILTER (WHERE side = 'b' AND NOT shared), '') AS rejected,
       coalesce(string_agg(mask, ',' ORDER BY place) FILTER (WHERE side = 'b' AND NOT shared AND role = 'assistant'), '') AS rejected_mask
FROM m GROUP BY pair_id, block, n_prompt_turns
"""

OP9_SQL = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS points, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents
), g AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY points DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM n
)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256 FROM g
"""


def _merkle_sql(source_levels: int = 8, levels: int = 5) -> str:
    """Each level of the trees as a step of its own: enough for 16 ** source_levels rows of a source, 16 ** levels sources."""
    field = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || {c} END"
    leaf = lambda text: "sha256(" + " || ".join(map(field, ("doc_id", "source", "lang", "n_chars", text))) + ")"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    bit = "CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END"
    byte = f"list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, i: {bit})"
    crc = f"xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda s: ascii(s)::BIGINT)), lambda c, b: {byte}), 4294967295)"
    steps = [
        f"l AS (SELECT doc_id, source, {leaf('text')} AS leaf, CASE WHEN {crc} % 5 = 0 THEN {leaf(lower)} END AS other FROM documents)",
        "p AS (SELECT *, coalesce('1' || source, '0') AS g, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM l)",
        "a0 AS (SELECT g, pos, leaf AS node, count(*) OVER (PARTITION BY g) AS n FROM p)",
    ]

    def climb(tree: str, depth: int) -> None:
        for k in range(depth):
            steps.append(f"{tree}r{k} AS (SELECT g, pos // 16 AS pos, string_agg(node, '' ORDER BY pos) AS run FROM {tree}{k} WHERE n > 1 GROUP BY g, pos // 16)")
            steps.append(f"{tree}{k + 1} AS (SELECT g, pos, sha256(run) AS node, count(*) OVER (PARTITION BY g) AS n FROM {tree}r{k} UNION ALL SELECT g, pos, node, n FROM {tree}{k} WHERE n = 1)")

    climb("a", source_levels)
    steps.append(f"b0 AS (SELECT 'all' AS g, row_number() OVER (ORDER BY g) - 1 AS pos, node, count(*) OVER () AS n, g AS source FROM a{source_levels})")
    climb("b", levels)
    tables, sides = f"p JOIN b0 s ON s.source = p.g CROSS JOIN b{levels} t", []
    for tree, depth, group, pos in (("a", source_levels, "p.g", "p.pos"), ("b", levels, "'all'", "s.pos")):
        for k in range(depth):
            run, at = f"{tree}r{k}", f"({pos} // {16**k})"
            tables += f" LEFT JOIN {run} ON {run}.g = {group} AND {run}.pos = {at} // 16"
            sides.append((f"substr({run}.run, 1, 64 * ({at} % 16))", f"substr({run}.run, 64 * ({at} % 16) + 65)"))
    proof = ", ".join(x for pair in sides for x in pair)
    columns = ", ".join(f"{x} AS before{i}, {y} AS after{i}" for i, (x, y) in enumerate(sides))
    steps.append(f"f0 AS (SELECT p.doc_id, p.leaf, s.node AS subroot, t.node AS root, concat({proof}) AS proof, coalesce(p.other, p.leaf) AS fold, {columns} FROM {tables})")
    for i in range(len(sides)):
        steps.append(f"f{i + 1} AS (SELECT * REPLACE (CASE WHEN before{i} IS NULL THEN fold ELSE sha256(before{i} || fold || after{i}) END AS fold) FROM f{i})")
    return "WITH " + ",\n".join(steps) + f"\nSELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = root AS verified FROM f{len(sides)}"


def oracle_sql() -> dict[str, str]:
    return {"op4_decontaminate": OP4_SQL, "op7_url_filter": OP7_SQL, "op8_chat_format": OP8_SQL, "op9_exact_dedup": OP9_SQL, "op13_merkle_manifest": _merkle_sql()}
