"""Registered queries of the text operators, each over its whole tables, with SQL where SQL can state them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skysift.llm.automaton import contamination
from skysift.llm.bpe import encode
from skysift.llm.common import table
from skysift.llm.conversation_repair import damaged, repair
from skysift.llm.credentials import KINDS, find_credentials
from skysift.llm.epsilon_grid import near_vectors
from skysift.llm.lines import drop_repeated_lines
from skysift.llm.prefix_trie import prefix_trie, rebuilt
from skysift.llm.quality import evidence, site_quality
from skysift.llm.repeats import remove_repeats
from skysift.llm.simhash import near_duplicates
from skysift.llm.token_counts import count_tokens
from skysift.llm.toxicity import score, train
from skysift.llm.weighted_sampling import fingerprint_edits
from skysift.session import cut

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(build: Callable) -> Callable:
    QUERIES[build.__name__] = build
    return build


@query
def op1_site_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").where(~held_out())
    judged = cut(evidence(docs, labels, ["doc_id", "source", "lang"]))
    known = labels.where(F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.min("quality").alias("label"))
    found = site_quality(judged.join(known, "doc_id", "left"), "source", "lang", label_col="label")
    return found.select("doc_id", held_out().alias("held_out"), "evidence", "host_posterior", "path_posterior", "quality", (F.col("quality") >= 0.5).alias("keep"))


def held_out() -> Column:
    """Rows that no label is learned from."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1


@query
def op2_weighted_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_edits(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, round_trip=True)
    return found.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op4_repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    found = score(docs, train(docs, labels.where(~held_out())), ["doc_id"])
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query
def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), ["doc_id"])
    return found.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 2048).alias("over_limit"), "n_chunks", "n_widened")


@query
def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return drop_repeated_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLES["op7_line_dedup"] = """
WITH lines AS (
  SELECT doc_id, i, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))),
repeated AS (SELECT k, min(doc_id) AS keeper FROM lines WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) >= 2),
marked AS (SELECT l.doc_id, l.i, l.line, r.k IS NOT NULL AND l.doc_id <> r.keeper AS gone FROM lines l LEFT JOIN repeated r ON l.k = r.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


@query
def op8_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@query
def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_credentials(table(spark, sf_dir, "documents"))
    name = F.array(*(F.lit(k) for k in KINDS))

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(name, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind: int) -> Column:
        # a second parameter of the condition, a default one too, would be the span's index
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{KINDS[kind]}")

    counts = [count(k) for k in range(3)]
    return found.select("doc_id", *counts, F.sha2(joined(F.filter("spans", lambda s: s["kind"] < 3)), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


@query
def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), ["doc_id"])
    ends = F.col("spans")
    n_hit = F.aggregate(F.transform(ends, lambda x, i: F.when(i % 2 == 0, -x).otherwise(x)), F.lit(0).cast("long"), lambda a, x: a + x)
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"),
    )


ORACLES["op10_decontamination"] = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (SELECT DISTINCT item_id, k, array_to_string(w[s + 1 : s + k], ' ') AS g
  FROM (SELECT item_id, w, least(len(w), 10) AS k, unnest(range(0, len(w) - least(len(w), 10) + 1)) AS s FROM b WHERE len(w) > 0)),
grams AS (SELECT doc_id, k, s, array_to_string(w[s + 1 : s + k], ' ') AS g
  FROM (SELECT doc_id, w, k, unnest(range(0, len(w) - k + 1)) AS s FROM d, (SELECT DISTINCT k FROM windows) WHERE len(w) >= k)),
found AS (SELECT g.doc_id, g.s, g.k, x.item_id FROM grams g JOIN windows x ON g.k = x.k AND g.g = x.g),
hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + k)) AS p FROM (SELECT DISTINCT doc_id, s, k FROM found)) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM found) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(i.n_items, 0) AS n_items,
       sha256(coalesce(i.ids, '')) AS items_sha256, h.n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN hits h USING (doc_id) LEFT JOIN items i USING (doc_id)
"""


@query
def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(rebuilt(table(spark, sf_dir, "conversations")))


ORACLES["op11_conversation_trie"] = """
WITH t AS (SELECT conv_id AS c, turn, md5(length(r) || ':' || r || ':' || x) AS tid, octet_length(encode(x)) AS nb
  FROM (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL)),
placed AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, tid) AS pos, tid, nb FROM t),
convs AS (SELECT c, c - c % 5 AS donor, xor(4294967295, list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
    lambda s, b: list_reduce(list_prepend(xor(s, b), range(8)), lambda y, i: xor(y >> 1, 3988292384 * (y & 1))))) % 9 AS h
  FROM (SELECT DISTINCT c FROM t)),
turns AS (SELECT c, 1 AS part, pos, tid, nb FROM placed JOIN convs USING (c) WHERE pos > h
  UNION ALL SELECT v.c, 0, p.pos, p.tid, p.nb FROM convs v JOIN placed p ON p.c = v.donor WHERE p.pos <= v.h),
paths AS (SELECT c, row_number() OVER w AS d, string_agg(tid, '') OVER w AS path, nb FROM turns WINDOW w AS (PARTITION BY c ORDER BY part, pos)
  UNION ALL SELECT c, 0, '', 0 FROM convs),
nodes AS (SELECT path, d, min(c) AS conv_id, count(*) AS n, max(nb) AS nb FROM paths GROUP BY path, d),
last AS (SELECT path, string_agg(c::VARCHAR, ',' ORDER BY c) AS ids FROM (SELECT c, arg_max(path, d) AS path FROM paths GROUP BY c) GROUP BY path),
kids AS (SELECT left(path, 32 * (d - 1)) AS path, count(*) AS k FROM nodes WHERE d > 0 GROUP BY 1),
under AS (SELECT left(n.path, 32 * a) AS path, count(*) FILTER (WHERE k IS NULL) AS leaves, sum((n - 1) * nb) AS saved
  FROM (SELECT *, unnest(range(d + 1)) AS a FROM nodes) n LEFT JOIN kids ON kids.path = n.path GROUP BY 1)
SELECT n.conv_id, n.d AS depth, p.conv_id AS parent_conv_id, n.n AS n_convs, coalesce(k.k, 0) AS n_children, u.leaves AS n_leaves,
       u.saved::BIGINT AS saved_tokens, sha256(coalesce(l.ids, '')) AS ends_sha256
FROM nodes n JOIN under u ON u.path = n.path LEFT JOIN kids k ON k.path = n.path LEFT JOIN last l ON l.path = n.path
LEFT JOIN nodes p ON n.d > 0 AND p.path = left(n.path, 32 * (n.d - 1))
"""


@query
def op12_embedding_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_vectors(table(spark, sf_dir, "embeddings"))
    return found.select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))


ORACLES["op12_embedding_links"] = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT vec_id, (SELECT count(*) FROM links WHERE a = vec_id) AS n_links, (SELECT min(b) FROM reach WHERE a = vec_id) AS component_id,
       vec_id = (SELECT min(b) FROM reach WHERE a = vec_id) AS kept
FROM embeddings
"""


@query
def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    found = repair(damaged(rows), rows.select(F.col("conv_id").cast("bigint").alias("conv_id")))
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return found.select("conv_id", *counts, "audit", F.lower(F.hex("repaired")).alias("repaired_sha256"))
