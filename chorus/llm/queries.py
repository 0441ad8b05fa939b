"""The registered queries of this subpackage: thin contracts over the operators."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chorus.llm import ann, bpe, covertree, langid, linededup, merkle, minhash, packing, pii, quality, topk, urls, warc
from chorus.llm.common import table

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of every document."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors of every fiftieth."""
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perplexity of every document under the model of trusted text, and whether it is kept."""
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predicted language of every document."""
    docs = table(spark, sf_dir, "documents")
    found = langid.predict(docs, langid.train(docs))
    return found.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded text of every document, as counts and digests."""
    ids = bpe.encode(table(spark, sf_dir, "documents"), WORD_BPE)
    return bpe.decode(ids, WORD_BPE).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document in windows of 2048 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"), WORD_BPE).select(
        "doc_id", "start", F.expr("octet_length(ids) div 4").alias("length"), F.crc32("ids").alias("ids_crc32"),
        "doc_tokens", "sequence_id", "offset")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as WARC archives and read back."""
    manifest = warc.write_archives(table(spark, sf_dir, "pages"))
    return warc.read_archives(spark, manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for every twentieth document, taken whole as a query."""
    return topk.search(table(spark, sf_dir, "documents"), F.col("doc_id") % 20 == 0)


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document: base counts, their digest and all spans; secrets; how many spans of either."""
    found = pii.find(table(spark, sf_dir, "documents"))
    return found.select("doc_id", *[F.size(f"base_{k}").cast("long").alias(f"n_{k}") for k in pii.KINDS],
                        F.sha2(pii.joined("base"), 256).alias("base_sha256"), pii.joined("all").alias("spans"),
                        pii.joined("all", ("secret",)).alias("secrets"), F.size("all_secret").cast("long").alias("n_secret"),
                        F.size(F.concat(*[f"all_{k}" for k in pii.ALL])).cast("long").alias("n_all"))


URL_RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def op10_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict for every page's url."""
    return urls.judge(table(spark, sf_dir, "pages"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op11_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that ten documents or more share."""
    found = linededup.drop_repeated(table(spark, sf_dir, "documents"), least=10, keep="none")
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op12_hardneg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives for the nearest positives of every hundredth vector."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return covertree.mine(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, label)


def _manifest(docs: DataFrame) -> DataFrame:
    """Leaves, proofs, and what each proof says of a text that lost its line breaks (every second document)."""
    fields = lambda text: [F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text]
    touched = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    leaf = merkle.digest(fields(F.col("text")))
    changed = F.when(touched & F.contains("text", F.lit("\n")), merkle.digest(fields(F.replace("text", F.lit("\n"), F.lit(""))))).otherwise(F.col("leaf"))
    made = merkle.Manifest(docs.withColumn("leaf", leaf).select("doc_id", "source", "leaf", changed.alias("changed")))
    found = made.prove(made.leaves)
    return found.select("doc_id", "leaf", "subroot", "root", F.sha2(merkle.siblings(F.col("proof")).cast("binary"), 256).alias("proof_sha256"),
                        merkle.fold(F.col("changed"), F.col("proof")).alias("folded_root")) \
        .withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of all documents, a proof for each, and the check of a tampered copy."""
    return _manifest(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_near_dedup": op1_near_dedup,
    "op2_ann": op2_ann,
    "op3_quality": op3_quality,
    "op4_langid": op4_langid,
    "op5_bpe": op5_bpe,
    "op6_packing": op6_packing,
    "op7_topk": op7_topk,
    "op8_warc": op8_warc,
    "op9_pii": op9_pii,
    "op10_urls": op10_urls,
    "op11_linededup": op11_linededup,
    "op12_hardneg": op12_hardneg,
    "op13_merkle": op13_merkle,
}

_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def _url_sql(damping: float = 0.85, rounds: int = 8) -> str:
    """The rules as CASE, the propagation as one common table expression for each round."""
    fits = [f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '/{p}') THEN "
            for _, t in sorted(URL_RULES, key=lambda r: -len(r[1])) for h, _, p in [t.partition("/")]]
    ordered = sorted(URL_RULES, key=lambda r: -len(r[1]))
    rule = " ".join(f + f"'{t}'" for f, (_, t) in zip(fits, ordered))
    verdict = " ".join(f + f"'{k}'" for f, (k, _) in zip(fits, ordered))
    steps = "".join(f"""
r{i + 1} AS (SELECT kind, host, sum(v) AS v FROM (
  SELECT r.kind, e.dst AS host, r.v * e.w * {damping} AS v FROM r{i} r JOIN edges e ON e.kind = r.kind AND e.host = r.host
  UNION ALL SELECT kind, host, v * {1 - damping} FROM seed) GROUP BY ALL),""" for i in range(rounds))
    return f"""
WITH u AS (SELECT page_id, coalesce(html, '') AS html,
  translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), {_AZ}) AS host,
  coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
j AS (SELECT *, CASE {rule} END AS rule, CASE {verdict} END AS known FROM u),
share AS (SELECT host, count(*) FILTER (WHERE known = 'allow') / count(*) AS trust,
  count(*) FILTER (WHERE known = 'block') / count(*) AS distrust FROM j WHERE host <> '' GROUP BY host),
tree AS (SELECT DISTINCT array_to_string(l[i:], '.') AS src, array_to_string(l[i + 1:], '.') AS dst
  FROM (SELECT l, unnest(range(1, len(l) - 1)) AS i FROM (SELECT string_split(host, '.') AS l FROM share))),
link AS (SELECT host AS src, translate(unnest(list_distinct(regexp_extract_all(html,
  '(?i)href\\s*=\\s*["'']?(?:https?:)?//([^/?#"''<>\\s]+)', 1))), {_AZ}) AS dst FROM j WHERE host <> ''),
pair AS (SELECT src, dst, count(*) AS n FROM (SELECT * FROM tree UNION ALL SELECT * FROM link) WHERE src <> dst GROUP BY ALL),
way AS (SELECT 'trust' AS kind, src AS host, dst, n FROM pair UNION ALL SELECT 'distrust', dst, src, n FROM pair),
edges AS (SELECT kind, host, dst, n / sum(n) OVER (PARTITION BY kind, host) AS w FROM way),
raw AS (SELECT 'trust' AS kind, host, trust AS v FROM share UNION ALL SELECT 'distrust', host, distrust FROM share),
seed AS (SELECT kind, host, v / sum(v) OVER (PARTITION BY kind) AS v FROM raw WHERE v > 0),
r0 AS (SELECT * FROM seed),{steps}
score AS (SELECT host, round(coalesce(sum(v) FILTER (WHERE kind = 'trust'), 0), 12) AS trust,
  round(coalesce(sum(v) FILTER (WHERE kind = 'distrust'), 0), 12) AS distrust FROM r{rounds} GROUP BY host)
SELECT page_id, j.host, path, rule, coalesce(known, CASE WHEN coalesce(distrust, 0) > coalesce(trust, 0) THEN 'block' ELSE 'allow' END) AS verdict
FROM j LEFT JOIN score ON score.host = j.host"""


_CRC = """list_reduce([4294967295::BIGINT] || list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ascii(c)::BIGINT),
  lambda a, b: list_reduce([xor(a, b)] || [0::BIGINT, 0, 0, 0, 0, 0, 0, 0], lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END))"""


def _merkle_sql() -> str:
    """Levels, proofs and folding by recursion; ``xor`` with all ones at crc32's end flips its lowest bit."""
    field = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE CONCAT(strlen(CAST({c} AS VARCHAR)), ':', {c}) END"
    leaf = lambda text: "sha256(CONCAT(" + ", ".join(map(field, ("doc_id", "source", "lang", "n_chars", text))) + "))"
    climb = """SELECT level + 1, g, i // 3, sha256(string_agg(d, '' ORDER BY i)), any_value((n + 2) // 3) FROM {0} WHERE n > 1 GROUP BY level, g, i // 3"""
    return f"""
WITH RECURSIVE l AS (SELECT doc_id, coalesce('=' || source, '') AS g, {leaf("text")} AS leaf, CASE WHEN {_CRC} & 1 = 1
    THEN {leaf("replace(text, chr(10), '')")} ELSE {leaf("text")} END AS changed FROM documents),
r AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM l),
low(level, g, i, d, n) AS (SELECT CAST(0 AS BIGINT), g, i, leaf, n FROM r UNION ALL {climb.format("low")}),
top AS MATERIALIZED (SELECT g, d, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS n FROM low WHERE n = 1),
high(level, g, i, d, n) AS (SELECT CAST(100 AS BIGINT), '', i, d, n FROM top UNION ALL {climb.format("high")}),
node AS MATERIALIZED (SELECT * FROM low WHERE n > 1 UNION ALL SELECT * FROM high WHERE n > 1),
step AS (SELECT doc_id, g AS own, unnest(range(0, 30)) AS level, i, g FROM r
  UNION ALL SELECT doc_id, r.g, unnest(range(100, 130)), top.i, '' FROM r JOIN top ON top.g = r.g),
place AS (SELECT *, i // CAST(pow(3, level % 100) AS BIGINT) AS own_i FROM step),
run AS MATERIALIZED (SELECT p.doc_id, p.own, p.level, row_number() OVER (PARTITION BY p.doc_id, p.own ORDER BY p.level) AS k,
  coalesce(string_agg(o.d, '' ORDER BY o.i) FILTER (WHERE o.i < p.own_i), '') AS a, coalesce(string_agg(o.d, '' ORDER BY o.i) FILTER (WHERE o.i > p.own_i), '') AS b
  FROM place p JOIN node o ON o.level = p.level AND o.g = p.g AND o.i // 3 = p.own_i // 3 GROUP BY p.doc_id, p.own, p.level),
proof AS (SELECT doc_id, own, sha256(string_agg(a || b, '' ORDER BY k)) AS proof_sha256, max(k) AS steps FROM run GROUP BY doc_id, own),
fold(doc_id, own, k, d) AS (SELECT doc_id, g, CAST(0 AS BIGINT), changed FROM r
  UNION ALL SELECT f.doc_id, f.own, f.k + 1, sha256(run.a || f.d || run.b) FROM fold f JOIN run ON run.doc_id = f.doc_id AND run.own = f.own AND run.k = f.k + 1),
root AS (SELECT d FROM high WHERE n = 1)
SELECT r.doc_id, r.leaf, top.d AS subroot, root.d AS root, coalesce(proof_sha256, sha256('')) AS proof_sha256, fold.d AS folded_root, fold.d = root.d AS verified
FROM r JOIN top ON top.g = r.g LEFT JOIN proof p ON p.doc_id = r.doc_id AND p.own = r.g
JOIN fold ON fold.doc_id = r.doc_id AND fold.own = r.g AND fold.k = coalesce(p.steps, 0), root"""


ORACLES: dict[str, str] = {
    "op11_linededup": f"""
WITH l AS (SELECT doc_id, i, line, regexp_replace(translate(line, {_AZ}), '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g') AS key
  FROM (SELECT doc_id, unnest(s) AS line, unnest(range(len(s))) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS s FROM documents))),
c AS (SELECT key FROM l WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(c.key) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE c.key IS NULL), '')) AS kept_sha256
FROM l LEFT JOIN c ON c.key = l.key GROUP BY doc_id""",
    "op12_hardneg": """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS x
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.x, b.x) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER w AS INT) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 5""",
    "op13_merkle": _merkle_sql(),
    "op10_urls": _url_sql(),
    "op1_near_dedup": f"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), {_AZ}), '[\\x20\\x09-\\x0D]+'),
                                               lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
  ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS sh FROM w),
r AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c, any_value(a.n) + any_value(b.n) AS n
      FROM r a JOIN r b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT a, b FROM p WHERE 100 * c >= 75 * (n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT s.doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, component_id, s.doc_id = component_id AS kept
FROM s JOIN c ON c.doc_id = s.doc_id""",
    "op7_topk": """
WITH w AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                    '[0-9a-z\\x{80}-\\x{10ffff}]+')) AS word FROM documents),
t AS (SELECT doc_id, word, count(*) AS tf FROM w GROUP BY ALL),
l AS (SELECT doc_id, sum(tf) AS len FROM t GROUP BY doc_id),
g AS (SELECT count(*) AS n, (SELECT sum(len) FROM l) / count(*) AS mean FROM documents),
f AS (SELECT word, ln(1 + (n - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM t, g GROUP BY word, n),
s AS (SELECT q.doc_id AS query_id, t.doc_id,
             round(sum(idf * t.tf * 2.2 / (t.tf + 1.2 * (0.25 + 0.75 * len / mean))), 9) AS score
      FROM t q JOIN t USING (word) JOIN f USING (word) JOIN l ON l.doc_id = t.doc_id, g
      WHERE q.doc_id % 20 = 0 AND t.doc_id <> q.doc_id GROUP BY ALL),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INT) AS rank FROM s)
SELECT query_id, rank, doc_id, score FROM r WHERE rank <= 10""",
    "op8_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
m AS (SELECT hex, min(page_id) AS first FROM p GROUP BY hex)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           CAST(((CAST('0x' || substr(p.hex, CAST(5 * (i // 4) + 1 AS INT), 5) AS INT) >> CAST(15 - 5 * (i % 4) AS INT)) & 31) + 1 AS INT), 1)), '')
           AS payload_digest,
       CASE WHEN page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM p JOIN m ON p.hex = m.hex""",
}
