"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import cover_dedup, exact_dedup, hmm_lm, html_text, line_quality, maxscore, mixing, packing, prefix_trie, secrets, simhash_bk, warc, whitening
from tidemark.llm.shared import table

TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op2_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return maxscore.top_k(rows, rows.where("vec_id % 20 = 0"), k=20)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op6_hmm_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm_lm.score(table(spark, sf_dir, "documents"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_bk.near_groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.concat(*[F.substring(F.hex("fp"), k, 2) for k in range(15, 0, -2)])).alias("fingerprint"), "component_id")


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("spans", lambda s: s["rank"] == k)).cast("long")
    base = secrets.joined(F.filter("spans", lambda s: s["rank"] < len(secrets.BASE)))
    return found.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(base, 256).alias("base_sha256"),
        secrets.joined(F.col("spans")).alias("spans"),
    )


def op9_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"]
    return warc.round_trip(table(spark, sf_dir, "pages")).select(*columns)


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = F.col("conv_id")
    made = prefix_trie.prefixes(table(spark, sf_dir, "conversations"), base=conv - conv % 100, head=F.crc32(conv.cast("string")) % 6)
    return prefix_trie.nodes(made)


def op12_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover_dedup.near_vectors(table(spark, sf_dir, "embeddings"), cosine=0.95)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"), components=16)


def queries() -> dict:
    made = (
        op1_html_text, op2_maxscore, op3_mixing, op4_packing, op5_exact_dedup, op6_hmm_lm, op7_simhash, op8_secrets, op9_line_quality, op10_warc, op11_prefix_trie, op12_cover_tree, op13_whitening,
    )
    return {f.__name__: f for f in made}


_BASE32 = " || ".join(
    f"substr('{warc.BASE32}', 1 + (((('0x' || substr(h, {k + 1}, 5))::INTEGER) >> {s}) & 31), 1)" for k in range(0, 40, 5) for s in (15, 10, 5, 0)
)

SQL = {
    "op2_maxscore": """
      WITH e AS MATERIALIZED (SELECT row_number() OVER () AS row, vec_id, embedding FROM embeddings), long AS (SELECT row, vec_id, unnest(range(1, 65)) AS dim, unnest(embedding) AS x FROM e),
      v AS (SELECT row, vec_id, dim, CAST(floor(64 * x::DOUBLE) AS BIGINT) AS x FROM long),
      s AS (SELECT q.row AS asked, c.row, q.vec_id AS query_id, c.vec_id, CAST(sum(q.x * c.x) AS BIGINT) AS score FROM v q JOIN v c ON q.dim = c.dim AND q.row <> c.row WHERE q.vec_id % 20 = 0 GROUP BY 1, 2, 3, 4),
      r AS (SELECT *, CAST(row_number() OVER (PARTITION BY asked ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
      SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20""",
    "op3_mixing": """
      WITH d AS (SELECT *, coalesce(source, '') AS s, greatest(1, length(coalesce(text, ''))) AS size, coalesce(CAST(doc_id AS VARCHAR), '') || chr(31) || md5(coalesce(text, '')) AS key FROM documents),
      n AS (SELECT s, sum(size)::DOUBLE AS n FROM d GROUP BY 1), m AS (SELECT s, 1.0::DOUBLE / (SELECT count(*) FROM n) * (SELECT sum(n) FROM n) / n AS mean FROM n),
      r AS (SELECT s, mean, unnest(range(greatest(0, floor(mean - 12 * sqrt(mean) - 40))::BIGINT, ceil(mean + 12 * sqrt(mean) + 40)::BIGINT)) AS k FROM m),
      c AS (SELECT s, k, sum(exp(k * ln(mean) - mean - lgamma(k + 1))) OVER (PARTITION BY s ORDER BY k) AS cdf FROM r),
      u AS (SELECT *, ('0x' || substr(md5('42' || chr(31) || key), 1, 12))::BIGINT / 281474976710656::DOUBLE AS u FROM d),
      w AS (SELECT u.key, u.s, min(c.k) AS copies FROM (SELECT DISTINCT key, s, u FROM u) u JOIN c ON u.s = c.s WHERE c.cdf > u.u GROUP BY 1, 2),
      x AS (SELECT u.*, w.copies, unnest(range(1, w.copies + 1)) AS copy FROM u JOIN w ON u.key = w.key AND u.s = w.s)
      SELECT doc_id, text, lang, source, n_chars, copy, copies, md5('43' || chr(31) || key || chr(31) || copy) AS mix_key FROM x""",
    "op5_exact_dedup": r"""
      WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
      k AS (SELECT doc_id, norm, first_value(doc_id) OVER (PARTITION BY norm ORDER BY n DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size FROM t)
      SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM k""",
    "op10_warc": f"""
      WITH p AS (SELECT page_id, url, coalesce(html, '') AS html FROM pages), g AS (SELECT *, strlen(html) AS payload_bytes, sha1(html) AS h, max(page_id) OVER (PARTITION BY html) AS top FROM p)
      SELECT page_id, payload_bytes, {_BASE32} AS payload_digest, CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to, url FROM g""",
}

#: Every prefix as the text of its turns' digests; a node's subtree is met through the prefixes of the nodes' smallest members.
SQL["op11_prefix_trie"] = """
      WITH RECURSIVE bits(b, k, v) AS (SELECT range, 0, range FROM range(256) UNION ALL SELECT b, k + 1, xor(v >> 1, CASE WHEN v % 2 = 1 THEN 3988292384 ELSE 0 END) FROM bits WHERE k < 8),
      ids AS (SELECT DISTINCT conv_id AS c, conv_id::VARCHAR AS s FROM conversations WHERE conv_id IS NOT NULL),
      crc(c, s, v) AS (SELECT c, s, 4294967295 FROM ids UNION ALL SELECT c, substr(crc.s, 2), xor(crc.v >> 8, bits.v) FROM crc JOIN bits ON crc.s <> '' AND bits.k = 8 AND bits.b = xor(crc.v & 255, ascii(crc.s)::BIGINT)),
      heads AS (SELECT c, c - c % 100 AS base, xor(v, 4294967295) % 6 AS h FROM crc WHERE s = ''),
      t AS (SELECT conv_id AS c, turn, sha256(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || ':' || coalesce(text, '')) AS leaf, length(coalesce(text, '')) AS size FROM conversations WHERE conv_id IS NOT NULL),
      own AS (SELECT c, leaf, size, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, leaf) - 1 AS i FROM t),
      built AS (SELECT heads.c, 0 AS side, i, leaf, size FROM heads JOIN own ON own.c = heads.base AND i < h UNION ALL SELECT heads.c, 1, i, leaf, size FROM heads JOIN own ON own.c = heads.c AND i >= h),
      turns AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY side, i) AS d, leaf, size FROM built),
      rows AS (SELECT c, d, size, string_agg(leaf, '') OVER (PARTITION BY c ORDER BY d) AS seq FROM turns UNION ALL SELECT c, 0, 0, '' FROM ids),
      p AS (SELECT *, lag(seq) OVER (PARTITION BY c ORDER BY d) AS parent, d = max(d) OVER (PARTITION BY c) AS last FROM rows),
      n AS (SELECT seq, min(c) AS owner, max(d) AS d, max(parent) AS parent, max(size) AS size, count(*) AS n_convs, count(*) FILTER (last) AS n_ends, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (last), '')) AS ends FROM p GROUP BY seq),
      below AS (SELECT p.seq, count(*) FILTER (n.n_convs = n.n_ends) AS n_leaves, sum((n.n_convs - 1) * n.size) AS saved FROM n JOIN p ON p.c = n.owner AND p.d <= n.d GROUP BY 1),
      kids AS (SELECT parent AS seq, count(*) AS n_children FROM n WHERE parent IS NOT NULL GROUP BY 1)
      SELECT n.owner AS conv_id, n.d AS depth, above.owner AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, CAST(saved AS BIGINT) AS saved_tokens, n.n_ends, n.ends AS ends_sha256
      FROM n JOIN below USING (seq) LEFT JOIN kids USING (seq) LEFT JOIN n above ON above.seq = n.parent"""

SQL["op12_cover_tree"] = """
      WITH RECURSIVE e AS (SELECT row_number() OVER () AS row, vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
      v AS (SELECT * FROM e WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
      l AS MATERIALIZED (SELECT a.row AS a, b.row AS b FROM v a JOIN v b ON a.row <> b.row AND list_cosine_similarity(a.e, b.e) >= 0.95::DOUBLE),
      r(a, b) AS (SELECT row, row FROM e UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
      c AS (SELECT r.a AS row, min(o.vec_id) AS component_id FROM r JOIN e o ON o.row = r.b GROUP BY 1),
      n AS (SELECT a AS row, count(*) AS n FROM l GROUP BY 1)
      SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM e JOIN c USING (row) LEFT JOIN n USING (row)"""


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
