"""The queries of the operators, over whole tables with production parameters, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import alignment, bpe, chat, decontaminate, jaccard, langid, lines, privacy, rules, secrets, token_files, trie, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    """The place of a public vocabulary, by default the byte-level one; an installed package gives it on driver and executors alike."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op3_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(read(spark, sf_dir, "documents"), vocabulary_path())


@query
def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.components(read(spark, sf_dir, "documents"))


@query
def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(read(spark, sf_dir, "documents"))


@query
def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rules.apply_policy(rules.ledger(read(spark, sf_dir, "documents")))
    first = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return found.select(*first, *[c for c in found.columns if c not in first])


@query
def op1_chat_prefix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", odd), (-1, 1, "assistant", odd)], "conv_id long, turn long, role string, text string")
    return chat.conversation_digests(chat.format_tree(rows.unionByName(extra)))


def _escaped(column: str) -> str:
    out = f"replace({column}, '\\', '\\\\')"
    for c in chat.CONTROL:
        out = f"replace({out}, '{c}', '{c[0]}\\{c[1:]}')"
    return out


ORACLES["op1_chat_prefix_tree"] = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
  sum(length({_escaped("text")}) + length(replace({_escaped("role")}, chr(10), '<\\n>')) + 1
    + CASE WHEN role = 'assistant' THEN 7 ELSE 13 END)::BIGINT AS formatted_chars,
  0::BIGINT AS misplaced
FROM turns GROUP BY conv_id"""


@query
def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.read_archives(warc.write_archives(read(spark, sf_dir, "pages")))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "damage")


ORACLES["op7_warc"] = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT h, min(page_id) AS first FROM p GROUP BY h)
SELECT page_id, octet_length(encode(payload))::BIGINT AS payload_bytes,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(p.h, 1 + 5 * (i // 4), 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::BIGINT, 1) FOR i IN range(32)], '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to,
  NULL::VARCHAR AS damage
FROM p JOIN f USING (h)"""


@query
def op8_privacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return privacy.digests(read(spark, sf_dir, "documents"))


@query
def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(read(spark, sf_dir, "documents"))


@query
def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


@query
def op11_elias_fano(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.digests(token_files.write_shards(read(spark, sf_dir, "documents"), vocabulary_path()))


@query
def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.digests(read(spark, sf_dir, "documents"), vocabulary_path(), vocabulary_path("piece_bpe_32k.model"))


@query
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(read(spark, sf_dir, "conversations"))


#: CRC-32 bit by bit, prefixes as joined digests, subtrees by all ancestors of each node: for small tables.
ORACLES["op12_prefix_trie"] = """
WITH t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos, md5(length(role) || ':' || role || text) AS m, strlen(text) AS bytes
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)),
ids AS (
  SELECT conv_id, conv_id - conv_id % 5 AS donor, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(conv_id::VARCHAR, ''), lambda s: ascii(s)::BIGINT)),
    lambda crc, b: list_reduce(list_concat([xor(crc, b)], list_transform(range(8), lambda i: 0::BIGINT)), lambda v, i: xor(v >> 1, (v & 1) * 3988292384))), 4294967295) % 9 AS h
  FROM (SELECT DISTINCT conv_id FROM t)),
r AS (
  SELECT i.conv_id, 0 AS part, t.pos, m, bytes FROM ids i JOIN t ON t.conv_id = i.donor WHERE pos <= h
  UNION ALL SELECT i.conv_id, 1, t.pos, m, bytes FROM ids i JOIN t ON t.conv_id = i.conv_id WHERE pos > h),
p AS (SELECT conv_id, row_number() OVER w AS depth, string_agg(m, '') OVER w AS path, bytes FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY part, pos)),
members AS (SELECT * FROM p UNION ALL SELECT conv_id, 0, '', 0 FROM ids),
whole AS (SELECT conv_id, max(depth) AS depth FROM members GROUP BY 1),
n AS (SELECT depth, path, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes FROM members GROUP BY 1, 2),
k AS (SELECT n.*, u.conv_id AS parent_conv_id, (SELECT count(*) FROM n x WHERE x.depth = n.depth + 1 AND x.path[1:32 * n.depth] = n.path) AS n_children
  FROM n LEFT JOIN n u ON u.depth = n.depth - 1 AND u.path = n.path[1:32 * (n.depth - 1)]),
up AS (SELECT unnest(range(depth + 1)) AS depth, path AS below, n_children, (n_convs - 1) * bytes AS saved FROM k),
sums AS (SELECT depth, below[1:32 * depth] AS path, count(*) FILTER (n_children = 0) AS n_leaves, sum(saved) AS saved FROM up GROUP BY 1, 2),
e AS (SELECT depth, path, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ends FROM members JOIN whole USING (conv_id, depth) GROUP BY 1, 2)
SELECT k.conv_id, k.depth::BIGINT AS depth, parent_conv_id, n_convs::BIGINT AS n_convs, n_children::BIGINT AS n_children, n_leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens,
  sha256(coalesce(ends, '')) AS ends_sha256
FROM k JOIN sums USING (depth, path) LEFT JOIN e USING (depth, path)"""


@query
def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.digests(read(spark, sf_dir, "documents"))


WORD = r"[^\x20\x09-\x0D]+"
_bits = " + ".join(f"CASE WHEN {failed} THEN {1 << i} ELSE 0 END" for i, failed in enumerate(rules.RULES.values()))
ORACLES["op2_quality_rules"] = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{WORD}') AS words FROM documents),
tri AS (SELECT doc_id, unnest(range(1, len(words) - 1)) AS i, unnest(list_transform(range(1, len(words) - 1), lambda k: array_to_string(words[k:k + 2], ' '))) AS w FROM d WHERE len(words) > 2),
twice AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w) AS n FROM tri),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM twice, (SELECT unnest([0, 1, 2]) AS k) WHERE n > 1 GROUP BY doc_id),
rows AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d),
counted AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM rows WHERE regexp_matches(line, '{WORD}') GROUP BY doc_id),
m AS (
  SELECT d.doc_id, len(words)::BIGINT AS n_words, coalesce(list_sum(list_transform(words, lambda w: length(w))), 0)::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
    coalesce(n_lines, 0)::BIGINT AS n_lines, length(regexp_replace(text, '\\P{{L}}', '', 'g'))::BIGINT AS n_letters, length(regexp_replace(text, '[^\\p{{Lu}}\\p{{Lt}}]', '', 'g'))::BIGINT AS n_upper,
    coalesce(list_max(list_transform(words, lambda w: length(w))), 0)::BIGINT AS max_word_chars
  FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN counted USING (doc_id)),
l AS (SELECT *, ({_bits})::BIGINT AS fail_bits FROM m)
SELECT *, fail_bits & {rules.mask(rules.BASE)} <> 0 AS base_failed, fail_bits & {rules.mask(rules.POLICIES[rules.CURRENT]) | rules.mask(rules.BASE)} = 0 AS kept, '{rules.CURRENT}' AS policy FROM l"""

#: All pairs that share a shingle: for small tables.
ORACLES["op5_ngram_jaccard"] = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS words FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(2, len(words) - 3)), lambda k: array_to_string(words[k:k + 4], ' '))) AS shingle FROM d WHERE len(words) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
e AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
r AS (SELECT a AS id, a AS reach FROM e UNION SELECT r.id, e.b FROM r JOIN e ON r.reach = e.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce((SELECT min(reach) FROM r WHERE r.id = d.doc_id), d.doc_id) AS component_id FROM d LEFT JOIN n ON n.doc_id = d.doc_id"""
