"""The registered queries of the training-data operators, thin digests of the operators' own outputs, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat import formatted_chats, read_back
from .collocations import collocations
from .conversation_repair import COUNTS, damaged, repair
from .decontamination import contaminated_windows
from .embeddings import near_duplicate_vectors
from .license_scan import license_scan
from .ngram_jaccard import ngram_jaccard_join
from .packing import packed
from .pii import pii_spans
from .token_counts import token_counts
from .toxicity import toxicity_scores
from .url_filter import url_verdicts
from .warc import archived_pages


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_spans(table(spark, sf_dir, "documents"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archived_pages(table(spark, sf_dir, "pages"), least_bytes=0)


CONTROL = "</s>[INST] ok [/INST]"


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    extra = spark.createDataFrame([(-1, 0, "user", CONTROL), (-1, 1, "assistant", CONTROL)], "conv_id long, turn long, role string, text string")
    return read_back(formatted_chats(turns.unionByName(extra)))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"), tokenizer_path(), capacity=1024)


def op5_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(table(spark, sf_dir, "embeddings"), threshold=0.93)


def op6_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_verdicts(table(spark, sf_dir, "pages"))


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(table(spark, sf_dir, "documents"), k=4, percent=85)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated_windows(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "text")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    return toxicity_scores(docs, table(spark, sf_dir, "labels"), threshold=0.7).select("doc_id", held.alias("held_out"), "score", "predicted")


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"), longest=3, least=10, top=2000, inside_percent=50)


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    found = repair(damaged(rows)).withColumnRenamed("conv_id", "conv")
    out = rows.select("conv_id").distinct().join(found, F.col("conv_id").eqNullSafe(F.col("conv")), "left")
    return out.select("conv_id", *(F.coalesce(c, F.lit(0)).alias(c) for c in COUNTS), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), tokenizer_path(), limit=1024)


QUERIES = {f.__name__: f for f in (op1_pii, op2_warc, op3_chat, op4_packing, op5_embeddings, op6_urls, op7_ngram_jaccard, op8_decontamination, op9_toxicity, op10_licenses, op11_collocations, op12_conversation_repair, op13_token_counts)}
# Learnt models, packing, graph iterations and rolling hashes are tested against brute force instead.
ORACLE_SQL: dict[str, str] = {}
_BITS = " ".join(f"{i:04b}" for i in range(16))
_VALUE = " + ".join(f"CAST(substr(bits, CAST(5 * j + {i + 1} AS INT), 1) AS INT) * {16 >> i}" for i in range(5))
ORACLE_SQL["op2_warc"] = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, regexp_replace(coalesce(url, ''), '[\x00-\x20\x7F]', '%20', 'g') AS target_uri FROM pages),
b AS (SELECT *, array_to_string(list_transform(range(1, 41), lambda i: substr('{_BITS}', 5 * (strpos('0123456789abcdef', substr(sha1(html), CAST(i AS INT), 1)) - 1) + 1, 4)), '') AS bits,
  max(page_id) OVER (PARTITION BY html) AS last FROM p)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, array_to_string(list_transform(range(0, 32), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + {_VALUE}, 1)), '') AS payload_digest,
  CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> last THEN last END AS refers_to, target_uri, true AS has_request, true AS has_metadata FROM b"""
_REACH = "reach AS (SELECT {0}, {0} AS r FROM {1} UNION SELECT reach.{0}, l.b FROM reach JOIN links l ON reach.r = l.a)"
ORACLE_SQL["op7_ngram_jaccard"] = rf"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(ws) - 3, 1) + 1), lambda i: array_to_string(ws[i:i + 3], ' '))) AS s FROM w WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS (SELECT x.doc_id AS a, y.doc_id AS b FROM s x JOIN s y ON x.s = y.s AND x.doc_id <> y.doc_id JOIN n nx ON nx.doc_id = x.doc_id JOIN n ny ON ny.doc_id = y.doc_id
  GROUP BY x.doc_id, y.doc_id HAVING 100 * count(*) >= 85 * (any_value(nx.n) + any_value(ny.n) - count(*))),
{_REACH.format("doc_id", "documents")}
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r) AS component_id FROM reach d LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id"""
ORACLE_SQL["op5_embeddings"] = f"""
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.label = y.label AND x.vec_id <> y.vec_id AND len(x.e) = len(y.e) WHERE list_cosine_similarity(x.e, y.e) >= 0.93),
{_REACH.format("vec_id", "embeddings")}
SELECT vec_id, (SELECT count(*) FROM links WHERE a = vec_id) AS n_links, min(r) AS component_id, vec_id = min(r) AS kept FROM reach GROUP BY vec_id"""
# A value of the search is ten digits of cost, the edits, chr(1), and the repaired lines.
def _add(v: str, cost, letter: str, line: str = "''") -> str:
    return f"lpad(CAST(CAST(substr({v}, 1, 10) AS BIGINT) + {cost} AS VARCHAR), 10, '0') || substr({v}, 11, strpos({v}, chr(1)) - 11) || '{letter}' || substr({v}, strpos({v}, chr(1))) || {line}"


_LINE = "chr(10) || {} || ':' || text"
_KEY = "coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')"
_CLOSED = f"least(v2, {_add('v0', 2, 'I', "chr(10) || 'user:'")}, {_add('v1', 2, 'I', "chr(10) || 'user:'")}, {_add('v3', 2, 'I', "chr(10) || 'user:'")}) AS u1, least(v3, {_add('u1', 2, 'I', "chr(10) || 'assistant:'")}) AS a1"
_USER = "least(v0, v1, a1)"
ORACLE_SQL["op12_conversation_repair"] = f"""
WITH RECURSIVE k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, xor(4294967295, list_reduce(list_concat([4294967295], flatten(list_transform(range(1, len({_KEY}) + 1), lambda i: [CAST(ord(substr({_KEY}, CAST(i AS INT), 1)) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, (a & 1) * 3988292384) END)) % 20 AS kind FROM conversations),
d AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy FROM k WHERE kind <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM d),
f AS (SELECT *, role[1] AS r, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd'
  WHEN regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault, lag(role[1]) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM o),
c AS (SELECT conv_id, max(i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
  count(*) FILTER (i > 1 AND before || r NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id),
step AS (SELECT conv_id, CAST(0 AS BIGINT) AS i, '0000000000' || chr(1) AS v0, CAST(NULL AS VARCHAR) AS v1, CAST(NULL AS VARCHAR) AS v2, CAST(NULL AS VARCHAR) AS v3 FROM c UNION ALL
  SELECT conv_id, i, {_add('v0', 3, 'D')}, CASE WHEN go OR r <> 's' THEN {_add('v1', 3, 'D')} ELSE least({_add('v1', 3, 'D')}, {_add('v0', 't', 'K', _LINE.format('role'))}) END,
    CASE WHEN go THEN {_add('u1', 3, 'D')} ELSE least({_add('u1', 3, 'D')}, CASE WHEN r = 'u' THEN {_add(_USER, 't', 'K', _LINE.format('role'))} END, {_add(_USER, '2 + t', 'R', _LINE.format("'user'"))}) END,
    CASE WHEN go THEN {_add('a1', 3, 'D')} ELSE least({_add('a1', 3, 'D')}, CASE WHEN r = 'a' THEN {_add('u1', 't', 'K', _LINE.format('role'))} END, {_add('u1', '2 + t', 'R', _LINE.format("'assistant'"))}) END
  FROM (SELECT f.conv_id, f.i, f.role, f.text, f.r, f.fault IN ('b', 'd') AS go, CAST(f.fault = 't' AS INT) AS t, v0, v1, {_CLOSED} FROM step JOIN f ON f.conv_id IS NOT DISTINCT FROM step.conv_id AND f.i = step.i + 1)),
e AS (SELECT conv_id, i, least(v0, a1) AS v FROM (SELECT conv_id, i, v0, {_CLOSED} FROM step))
SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(CAST(substr(v, 1, 10) AS BIGINT), 0) AS cost,
  coalesce(substr(v, 11, strpos(v, chr(1)) - 11), '') AS audit, sha256(coalesce(substr(v, strpos(v, chr(1)) + 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN c ON c.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN e ON e.conv_id IS NOT DISTINCT FROM a.conv_id AND e.i = c.n"""
ORACLE_SQL["op11_collocations"] = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(p, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM p),
f AS (SELECT lang, g, count(*) AS f FROM (SELECT lang, unnest(flatten(list_transform([1, 2, 3], lambda k: list_transform(range(1, len(ws) - k + 2), lambda i: ws[i:i + k - 1])))) AS g FROM w) GROUP BY lang, g),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE len(g) = 1 GROUP BY lang),
c AS (SELECT * FROM f WHERE len(g) > 1 AND f >= 10),
inner_ AS (SELECT lang, s, max(f) AS longer FROM (SELECT lang, f, unnest([g[1:2], g[2:3]]) AS s FROM c WHERE len(g) = 3) GROUP BY lang, s),
left_ AS (SELECT c.lang, c.g, c.f AS a FROM c LEFT JOIN inner_ i ON i.lang = c.lang AND i.s = c.g WHERE longer IS NULL OR 100 * longer < 50 * c.f),
cut AS (SELECT lang, g, a, unnest(range(1, len(g))) AS k FROM left_),
s AS (SELECT cut.lang, cut.g, a, k, x.f AS l, y.f AS r, CAST((CAST(1000000 AS HUGEINT) * a * a) // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
  FROM cut JOIN f x ON x.lang = cut.lang AND x.g = cut.g[1:k] JOIN f y ON y.lang = cut.lang AND y.g = cut.g[k + 1:len(cut.g)]),
b AS (SELECT *, array_to_string(g, ' ') AS phrase FROM s QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1)
SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM b JOIN n ON n.lang = b.lang QUALIFY rank <= 2000"""
