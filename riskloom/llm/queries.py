"""The registered query of each training-data operator, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import op1_packing, op2_minhash, op3_licenses, op4_decontaminate, op5_importance, op6_toxicity, op7_exact_dedup, op8_warc, op9_token_planes, op10_repeats, op11_clusters, op12_token_counts, op13_lexical_search


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op1_packing.pack(_t(spark, sf_dir, "documents"))


def op7_exact_dedup_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op7_exact_dedup.exact_dedup(_t(spark, sf_dir, "documents"))


def op9_token_planes_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op9_token_planes.token_planes(_t(spark, sf_dir, "documents"))


def op2_minhash_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op2_minhash.near_dedup(_t(spark, sf_dir, "documents"))


def op3_licenses_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op3_licenses.scan_licenses(_t(spark, sf_dir, "documents"))


def op4_decontaminate_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op4_decontaminate.find_leaks(_t(spark, sf_dir, "documents"), _t(spark, sf_dir, "benchmark"))


def op5_importance_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The drawn documents."""
    return op5_importance.resample(_t(spark, sf_dir, "documents"), _t(spark, sf_dir, "labels")).where("kept")


def op6_toxicity_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents found toxic, with their probabilities; every document is scored."""
    docs = _t(spark, sf_dir, "documents")
    return op6_toxicity.score(docs, op6_toxicity.train(docs, _t(spark, sf_dir, "labels"))).where("is_toxic")


def op8_warc_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op8_warc.warc_round_trip(_t(spark, sf_dir, "pages")).drop("url_key", "stamp")


def op10_repeats_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10_repeats.repeated_spans(_t(spark, sf_dir, "documents"))


def op11_clusters_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op11_clusters.clusters(_t(spark, sf_dir, "embeddings"))


def op12_token_counts_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op12_token_counts.token_counts(_t(spark, sf_dir, "documents"))


def op13_lexical_search_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op13_lexical_search.ranked(_t(spark, sf_dir, "documents"), _t(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_packing": op1_packing_query,
    "op2_minhash": op2_minhash_query,
    "op3_licenses": op3_licenses_query,
    "op4_decontaminate": op4_decontaminate_query,
    "op5_importance": op5_importance_query,
    "op6_toxicity": op6_toxicity_query,
    "op7_exact_dedup": op7_exact_dedup_query,
    "op8_warc": op8_warc_query,
    "op9_token_planes": op9_token_planes_query,
    "op10_repeats": op10_repeats_query,
    "op11_clusters": op11_clusters_query,
    "op12_token_counts": op12_token_counts_query,
    "op13_lexical_search": op13_lexical_search_query,
}

#: Words between ASCII white space, A-Z lower-cased.
_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"""
#: Letters, digits and what lies beyond ASCII, A-Z lower-cased.
_TERMS = r"""regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"""


def _clusters_sql(rounds: int = 5) -> str:
    """The rounds one after the other: a{k} assigns every vector to the centroids c{k}."""
    steps = [
        """v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
              FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        "c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY s NULLS LAST, v) - 1 AS j, v AS c FROM (SELECT sha256('2:' || vec_id) AS s, v FROM v ORDER BY s NULLS LAST, v LIMIT 40))",
    ]
    for k in range(rounds + 1):
        steps.append(f"""a{k} AS MATERIALIZED (SELECT r, min([CAST(list_sum(list_transform(range(1, 65), lambda i: (v[i] - c[i]) * (v[i] - c[i]))) AS BIGINT), j]) AS m FROM v, c{k} GROUP BY r)""")
        if k < rounds:
            steps.append(f"""c{k + 1} AS MATERIALIZED (
                SELECT c.j, coalesce(n.c, c.c) AS c FROM c{k} c LEFT JOIN (
                    SELECT j, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c FROM (
                        SELECT j, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM (SELECT m[2] AS j, unnest(v) AS x, unnest(range(64)) AS i FROM a{k} JOIN v USING (r)) GROUP BY j, i)
                    GROUP BY j) n ON n.j = c.j)""")
    return f"""WITH {", ".join(steps)}
        SELECT vec_id, CAST(m[2] AS INTEGER) AS cluster, m[1] AS distance, CAST(sum(m[1]) OVER (PARTITION BY m[2]) AS BIGINT) AS cluster_inertia, CAST(sum(m[1]) OVER () AS BIGINT) AS inertia,
               sha256(array_to_string(c, ',')) AS centroid_sha256
        FROM a{rounds} JOIN v USING (r) JOIN c{rounds} ON j = m[2]"""


ORACLE_SQL = {
    "op11_clusters": _clusters_sql(),
    "op13_lexical_search": f"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS w FROM documents WHERE text IS NOT NULL),
        s AS (SELECT count(*) AS n, CAST(sum(len(w)) AS BIGINT) AS l FROM d WHERE len(w) > 0),
        p AS (SELECT r, doc_id, len(w) AS n, unnest(w) AS term FROM d),
        c AS (SELECT r, doc_id, n, term, count(*) AS tf FROM p GROUP BY ALL),
        f AS (SELECT term, CAST(floor(1000 * ln((2 * s.n + 2) / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM c, s GROUP BY term, s.n),
        i AS (SELECT k, item_id, unnest(list_distinct(w)) AS term FROM (SELECT row_number() OVER () AS k, item_id, {_TERMS} AS w FROM benchmark WHERE text IS NOT NULL)),
        x AS (SELECT k, item_id, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * c.n * s.n) // s.l)))) AS BIGINT) AS score
              FROM i JOIN f USING (term) JOIN c USING (term), s GROUP BY k, item_id, r, doc_id),
        o AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY k ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM x WHERE score > 0)
        SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM o WHERE rank <= 10""",
    "op2_minhash": f"""
        WITH RECURSIVE d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
        s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i : i + 2], ' '))
                                                       WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE []::VARCHAR[] END)) AS g FROM d),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
        l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 85 * (x.n + y.n - i)),
        e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
        r AS (SELECT DISTINCT a AS x, a AS y FROM e UNION SELECT r.x, e.b FROM r JOIN e ON r.y = e.a),
        c AS (SELECT x AS doc_id, min(y) AS m FROM r GROUP BY x)
        SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(m, doc_id) AS component_id, coalesce(m, doc_id) = doc_id AS kept
        FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)""",
    "op10_repeats": f"""
        WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
        k AS (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS k FROM d WHERE len(w) >= 50),
        g AS (SELECT doc_id, k, md5(array_to_string(w[k : k + 49], ' ')) AS g FROM k),
        h AS (SELECT g, min(doc_id) AS lo FROM g GROUP BY g HAVING min(doc_id) <> max(doc_id)),
        i AS (SELECT doc_id, k, lo, k - row_number() OVER (PARTITION BY doc_id ORDER BY k) AS island FROM g JOIN h USING (g))
        SELECT doc_id, min(k) - 1 AS start_word, max(k) + 49 AS end_word, max(k) - min(k) + 50 AS n_words, min(lo) AS first_doc_id
        FROM i GROUP BY doc_id, island""",
    "op8_warc": r"""
        WITH p AS (SELECT page_id, url, coalesce(html, '') AS body, strlen(coalesce(html, '')) AS payload_bytes FROM pages),
        h AS (SELECT *, sha1(body) AS hex, max(page_id) OVER (PARTITION BY body) AS winner FROM p)
        SELECT page_id, payload_bytes,
               list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                   1 + ((CAST('0x' || substr(hex, (i // 4) * 5 + 1, 5) AS INTEGER) >> (15 - 5 * (i % 4))) & 31)::INTEGER, 1)),
                   'string_agg', '') AS payload_digest,
               CASE WHEN page_id = winner THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> winner THEN winner END AS refers_to
        FROM h""",
    "op7_exact_dedup": r"""
        WITH d AS (
            SELECT doc_id, length(coalesce(text, '')) AS n,
                   sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
            FROM documents),
        w AS (
            SELECT text_sha256, first(doc_id ORDER BY n DESC, doc_id) AS keep_id, count(*) AS group_size
            FROM d GROUP BY text_sha256)
        SELECT d.doc_id, w.keep_id, w.group_size, d.doc_id = w.keep_id AS kept, text_sha256
        FROM d JOIN w USING (text_sha256)""",
}
