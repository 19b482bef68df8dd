"""Registered queries of the corpus operators, and their DuckDB SQL where SQL can express them."""
from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fintally.llm import centroid_clusters, decontaminate, exact_dedup, html_extract, lexical_search, license_scan, line_dedup, piece_lattice, piece_model, quality_mil, sentence_spans, simhash_bktree, suffix_dedup, token_count
from fintally.llm.common import table


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_extract.extract_pages(table(spark, sf_dir, "pages"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and labels of every document."""
    return license_scan.scan_licenses(table(spark, sf_dir, "documents")).drop("detections")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document under the 32k piece model."""
    return token_count.token_counts(table(spark, sf_dir, "documents"), piece_model.model_bytes())


def op4_quality_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    return quality_mil.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document under the 32k piece model, and whether they decode to its text."""
    return piece_lattice.token_digests(table(spark, sf_dir, "documents"), piece_model.model_bytes())


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark items that every document holds, up to edits."""
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate group of every document."""
    return simhash_bktree.near_duplicates(table(spark, sf_dir, "documents"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without its repeated 200-byte strings, as a digest."""
    out = suffix_dedup.remove_repeated_bytes(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The copy group and the owner of every document."""
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op10_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without its repeated sentence spans."""
    return sentence_spans.remove_repeated_spans(table(spark, sf_dir, "documents"))


def op11_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cluster of every vector, its distance and the inertia."""
    return centroid_clusters.cluster_report(table(spark, sf_dir, "embeddings"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten documents that match every benchmark item best."""
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without lines that it shares, as a digest."""
    out = line_dedup.drop_repeated_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_html_extraction, op2_license_scan, op3_token_counts, op4_quality_mil, op5_sentencepiece, op6_decontamination,
    op7_simhash_dedup, op8_suffix_dedup, op9_exact_dedup, op10_sentence_spans, op11_centroid_clusters,
    op12_lexical_search, op13_line_dedup)}

UPPER, LOWER = string.ascii_uppercase, string.ascii_lowercase


def _rounds_sql(k: int = 8, rounds: int = 10) -> str:
    """The clusters in SQL: one pair of steps (assign, move) for each round."""
    def assign(r: int) -> str:
        return f"""a{r} AS MATERIALIZED (SELECT vec_id, v, c, (sum((x - y) * (x - y)))::BIGINT AS dist FROM (
            SELECT vec_id, kept.v, c, unnest(kept.v) AS x, unnest(c{r}.v) AS y FROM kept, c{r}) GROUP BY vec_id, v, c
            QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY dist, c) = 1)"""

    def move(r: int) -> str:
        return f"""m{r} AS (SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY d) AS v FROM (
            SELECT c, d, sum(x) AS s, count(*) AS n FROM (SELECT c, unnest(v) AS x, generate_subscripts(v, 1) AS d FROM a{r}) GROUP BY c, d) GROUP BY c),
        c{r + 1} AS MATERIALIZED (SELECT c, coalesce(m{r}.v, c{r}.v) AS v FROM c{r} LEFT JOIN m{r} USING (c))"""
    steps = ",\n".join(f"{assign(r)},\n{move(r)}" for r in range(rounds))
    return f"""WITH kept AS MATERIALIZED (
            SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
            WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS c, v FROM (
            SELECT sha256('3:' || vec_id::VARCHAR) AS h, v FROM kept ORDER BY h LIMIT {k})),
        {steps},
        {assign(rounds)}
        SELECT vec_id, a{rounds}.c::INTEGER AS cluster, dist AS distance, (sum(dist) OVER (PARTITION BY a{rounds}.c))::BIGINT AS cluster_inertia,
               (sum(dist) OVER ())::BIGINT AS inertia, sha256(array_to_string(c{rounds}.v, ',')) AS centroid_sha256
        FROM a{rounds} JOIN c{rounds} USING (c)"""


_TERMS = r"""unnest(regexp_extract_all(translate(text, '{0}', '{1}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))""".format(UPPER, LOWER)

ORACLE: dict[str, str] = {
    "op11_centroid_clusters": _rounds_sql(),
    "op12_lexical_search": f"""
        WITH words AS (SELECT doc_id, {_TERMS} AS t FROM documents),
        tf AS MATERIALIZED (SELECT doc_id, t, count(*) AS tf FROM words GROUP BY ALL),
        size AS MATERIALIZED (SELECT doc_id, sum(tf)::BIGINT AS n FROM tf GROUP BY doc_id),
        total AS MATERIALIZED (SELECT count(*) AS nd, sum(n)::BIGINT AS l FROM size),
        asked AS MATERIALIZED (SELECT item_id, t, count(*) AS q FROM (SELECT item_id, {_TERMS} AS t FROM benchmark) GROUP BY ALL),
        weight AS MATERIALIZED (SELECT t, floor(1000 * ln((2 * nd + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, total GROUP BY t, nd),
        gain AS MATERIALIZED (SELECT doc_id, t, w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * nd) // l))) AS g
                 FROM tf JOIN size USING (doc_id) JOIN weight USING (t), total WHERE t IN (SELECT t FROM asked)),
        score AS (SELECT item_id, doc_id, sum(q * g)::BIGINT AS score FROM asked JOIN gain USING (t) GROUP BY ALL)
        SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INTEGER AS rank, doc_id, score
        FROM score WHERE score > 0 QUALIFY rank <= 10""",
    "op13_line_dedup": f"""
        WITH lines AS MATERIALIZED (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS pos FROM (
            SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)),
        keys AS MATERIALIZED (SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') AS k FROM lines),
        shared AS MATERIALIZED (SELECT k, max(doc_id) AS stays FROM keys WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3)
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
        FROM (SELECT keys.*, coalesce(doc_id <> stays, false) AS gone FROM keys LEFT JOIN shared USING (k)) GROUP BY doc_id""",
    "op9_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC) = 1 AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""",
}
