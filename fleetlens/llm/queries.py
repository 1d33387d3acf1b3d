"""Registered queries of this subpackage, with DuckDB SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, chat, jaccard, lexical, lines, middle, mixing, quality, sharding, simhash, spm, topk, toxicity
from .common import native_bytes, table

#: Below this score a document counts as label 0 (both classifiers).
THRESHOLD = 0.3
SHARD_BYTES = 1 << 20
PROBE = "\\### Assistant: </turn> ok"


def crc_of(id_col: Column) -> Column:
    return F.crc32(F.encode(F.coalesce(id_col.cast("string"), F.lit("")), "UTF-8"))


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations (rows by turn) and conversation -7 (a messages record), formatted and read back."""
    rows = chat.canonical_turns(table(spark, sf_dir, "conversations"))
    message = F.struct(F.lit("user").alias("role"), F.lit(PROBE).alias("content"))
    answer = F.struct(F.lit("assistant").alias("role"), F.lit(PROBE).alias("content"))
    probe = chat.canonical_turns(spark.range(1).select(F.lit(-7).cast("long").alias("conv_id"), F.array(message, answer).alias("messages")))
    return chat.digest(chat.format_chat(rows.unionByName(probe)))


def op2_spm_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text in pieces: their number, the scores of the 4 best segmentations, digests of ids and decoded text."""
    return spm.encode_digests(table(spark, sf_dir, "documents"), keep=["doc_id"])


def op3_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 vectors of greatest integer inner product for every vec_id divisible by 20."""
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a mix of 150 % of all words by source weights 5, 2, 1 takes of every document."""
    plan = mixing.plan_mix(table(spark, sf_dir, "documents"))
    return plan.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learned from the labels of rows that are not held out."""
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"), "quality", crc_of(F.col("id")) % 5 != 0)
    scored = docs.select("doc_id", (crc_of(F.col("doc_id")) % 5 == 0).alias("held_out"), quality.score_column(spark, model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def op6_extendible_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard of every document by extendible hashing of its id, at most 1 MiB of text a shard."""
    docs = table(spark, sf_dir, "documents").select("doc_id", native_bytes("text").alias("n_bytes"))
    return sharding.assign_shards(docs, size=F.col("n_bytes"), limit=SHARD_BYTES)


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document; links at 3 or fewer differing bits of 3-word SimHashes."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, bits=3)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """10 near vectors by Euclidean distance for every vec_id divisible by 100, from an NN-descent graph."""
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document from its nearest labelled examples, and the ids of the nearest."""
    found = toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "toxic", crc_of(F.col("id")) % 4 != 2)
    return found.select("doc_id", (crc_of(F.col("doc_id")) % 4 == 2).alias("held_out"), "score",
                        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "evidence")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that at least 10 documents hold: counts and the kept text's digest."""
    out = lines.drop_frequent_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), min_docs=10, min_chars=1)
    return out.select("doc_id", F.col("_line_n").alias("n_lines"), F.col("_line_dropped").alias("n_dropped"),
                      F.sha2(F.coalesce("_line_kept", F.lit("")), 256).alias("kept_sha256"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 documents of highest score for every benchmark item."""
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=50)


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document cut in prefix, middle and suffix: counts, and digests of the output and of the text restored from it."""
    return middle.fill_in_middle_digests(table(spark, sf_dir, "documents"), keep=["doc_id"])


def op13_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component and set size of every document; links at a Jaccard similarity of 0.8 or more of 5-word shingles."""
    return jaccard.jaccard_classes(table(spark, sf_dir, "documents"), words=5, percent=80)


QUERIES = {f.__name__: f for f in (
    op1_chat_format, op2_spm_encode, op3_exact_topk, op4_mix_sources, op5_quality, op6_extendible_shards,
    op7_simhash, op8_ann, op9_toxicity, op10_line_dedup, op11_lexical_search, op12_fill_in_middle,
    op13_jaccard_join)}


_OP1 = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7::BIGINT, 0::BIGINT, 'user', '\### Assistant: </turn> ok'),
                   (-7::BIGINT, 1::BIGINT, 'assistant', '\### Assistant: </turn> ok')),
e AS (SELECT *, replace(replace(replace(text, '\', '\\'), '#', '\h'), '<', '\l') AS etext,
             replace(replace(replace(replace(role, '\', '\\'), '#', '\h'), '<', '\l'), ':', '\c') AS erole FROM t)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length(erole) + length(etext) + 4 + 2 + 8)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""

_OP3 = """
WITH v AS (
  SELECT vec_id, min(list_transform(embedding, lambda x: floor(64 * x::DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
  GROUP BY vec_id),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 20
"""

_SYMBOLS_SQL = mixing.SYMBOLS.replace("'", "''")
_OP4 = rf"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         CASE WHEN coalesce(length(text), 0) = 0 THEN 1.0::DOUBLE
              ELSE greatest(0.1::DOUBLE, length(translate(text, '{_SYMBOLS_SQL}', ''))::DOUBLE / length(text)) END AS weight,
         (('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE + 1.0) / 4503599627370496.0 AS u
  FROM documents),
s AS (SELECT source, sum(size)::DOUBLE AS size FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][1 + ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3)::INTEGER]::DOUBLE AS w FROM s),
o AS (SELECT *, 2 * size / w AS ratio, row_number() OVER (ORDER BY 2 * size / w, source NULLS LAST) AS i FROM w),
p AS (SELECT *, coalesce(sum(2 * size) OVER b, 0) AS capped, coalesce(sum(w) OVER b, 0) AS used,
             sum(w) OVER () AS all_w, 1.5 * sum(size) OVER () AS total
      FROM o WINDOW b AS (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT min_by(level, i) AS level FROM (SELECT i, ratio, (total - capped) / (all_w - used) AS level FROM p) WHERE level <= ratio),
g AS (SELECT source, size, CASE WHEN level IS NULL THEN 2 * size ELSE least(2 * size, level * w) END AS target FROM o, l),
b AS (SELECT *, CASE WHEN size > 0 THEN floor((target + 1e-6) / size) ELSE 0 END AS epochs FROM g),
r AS (SELECT d.doc_id, d.size, b.size AS source_size, b.target, b.epochs, floor(b.target + 1e-6 - b.epochs * b.size) AS budget,
             coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY -ln(d.u) / d.weight, d.doc_id
                                        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
      FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size::BIGINT AS source_size, target,
       (CASE WHEN size > 0 THEN (epochs + (start + size / 2.0 <= budget)::INTEGER) * size ELSE 0 END)::BIGINT AS taken FROM r
"""

_OP6 = f"""
WITH d AS (SELECT doc_id, coalesce(octet_length(encode(text)), 0)::BIGINT AS n_bytes,
                  ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT >> 1 AS h FROM documents),
x AS (SELECT d.*, r.depth, d.h >> (31 - r.depth) AS prefix FROM d, (SELECT unnest(range(0, 32))::INTEGER AS depth) r),
c AS (SELECT *, sum(n_bytes) OVER p AS shard_bytes, count(*) OVER p AS shard_rows FROM x WINDOW p AS (PARTITION BY depth, prefix)),
f AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY depth) AS k FROM c WHERE shard_bytes <= {SHARD_BYTES} OR shard_rows = 1)
SELECT doc_id, n_bytes, 'b' || CASE WHEN depth = 0 THEN '' ELSE lpad(bin(prefix), depth, '0') END AS shard,
       shard_bytes::BIGINT AS shard_bytes, shard_rows::BIGINT AS shard_rows FROM f WHERE k = 1
"""

_OP10 = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS t FROM documents),
l AS (SELECT r, doc_id, unnest(t) AS line, generate_subscripts(t, 1) AS pos FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT r) >= 10),
m AS (SELECT k.*, f.key IS NOT NULL AS dropped FROM k LEFT JOIN f USING (key))
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM m GROUP BY r
"""

_OP11 = r"""
WITH x AS (SELECT *, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM documents),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(low, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM x),
s AS (SELECT count(*) FILTER (len(t) > 0) AS n_docs, sum(len(t))::BIGINT AS n_terms FROM d),
p AS (SELECT r, doc_id, term, any_value(n) AS n, count(*) AS tf FROM (SELECT r, doc_id, len(t) AS n, unnest(t) AS term FROM d) GROUP BY r, doc_id, term),
w AS (SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM p, s GROUP BY term),
b AS (SELECT item_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM benchmark),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(low, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM b),
c AS (SELECT item_id, r, any_value(doc_id) AS doc_id,
             sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + ((50 * n * n_docs) // n_terms)))))::BIGINT AS score
      FROM q JOIN p USING (term) JOIN w USING (term), s GROUP BY item_id, r),
o AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank, doc_id, score FROM c WHERE score > 0)
SELECT * FROM o WHERE rank <= 50
"""

_OP12 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h,
                  regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS t FROM documents),
k AS (SELECT *, len(t) AS n, ('0x' || substr(h, 1, 8))::BIGINT % (len(t) + 1) AS a, ('0x' || substr(h, 9, 8))::BIGINT % (len(t) + 1) AS b,
             CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
                       OR ('0x' || substr(h, 17, 8))::BIGINT % 100 >= 50 THEN 'plain'
                  WHEN ('0x' || substr(h, 25, 8))::BIGINT % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM d),
c AS (SELECT *, coalesce(array_to_string(t[1:least(a, b)], ''), '') AS prefix, coalesce(array_to_string(t[least(a, b) + 1:greatest(a, b)], ''), '') AS middle,
             coalesce(array_to_string(t[greatest(a, b) + 1:], ''), '') AS suffix FROM k)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle
                        ELSE '<P>' || prefix || '<S>' || suffix || '<M>' || middle END) AS output_sha256, sha256(text) AS restored_sha256 FROM c
"""

_OP13 = r"""
WITH RECURSIVE x AS (SELECT row_number() OVER () AS r, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM documents),
w AS (SELECT r, doc_id, regexp_extract_all(low, '[^\x20\x09-\x0D]+') AS w FROM x),
d AS (SELECT r, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                             ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
g AS (SELECT r, unnest(s) AS s FROM d),
p AS (SELECT a.r AS x, b.r AS y, count(*) AS shared FROM g a JOIN g b ON a.s = b.s AND a.r < b.r GROUP BY a.r, b.r),
l AS (SELECT x, y FROM p JOIN d a ON a.r = x JOIN d b ON b.r = y WHERE 100 * shared >= 80 * (len(a.s) + len(b.s) - shared)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
reach AS (SELECT r, r AS other FROM d UNION SELECT reach.r, e.y FROM reach JOIN e ON e.x = reach.other),
c AS (SELECT reach.r, min(d.doc_id) AS component_id FROM reach JOIN d ON d.r = reach.other GROUP BY reach.r)
SELECT doc_id, len(s) AS n_shingles, component_id FROM d JOIN c USING (r)
"""

ORACLES = {"op11_lexical_search": _OP11, "op12_fill_in_middle": _OP12, "op13_jaccard_join": _OP13,
           "op1_chat_format": _OP1, "op3_exact_topk": _OP3, "op4_mix_sources": _OP4,
           "op6_extendible_shards": _OP6, "op10_line_dedup": _OP10}
