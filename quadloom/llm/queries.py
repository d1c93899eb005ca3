"""The queries of this subpackage, with production parameters, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

from pyspark.sql import DataFrame, SparkSession

from .ball_tree import top_k
from .chat_format import chat_format
from .common import read
from .exact_dedup import exact_dedup
from .html_text import html_text
from .language_id import language_id
from .secret_scan import secret_report
from .sentencepiece_codec import codec_report, load_model
from .shingle_join import shingle_join
from .source_mix import mixed_sizes
from .token_files import token_files


@cache
def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_report(read(spark, sf_dir, "documents"))


@cache
def unigram_model():
    return load_model(tokenizer_file("piece_bpe_32k.model"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codec_report(read(spark, sf_dir, "documents"), unigram_model())


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text(read(spark, sf_dir, "pages"))


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed_sizes(read(spark, sf_dir, "documents"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(read(spark, sf_dir, "documents"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    with open(tokenizer_file("byte_bpe_50k.json"), encoding="utf-8") as f:
        return token_files(read(spark, sf_dir, "documents"), f.read())


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format(read(spark, sf_dir, "conversations"))


def op8_shingle_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shingle_join(read(spark, sf_dir, "documents"), words=3, num=90, den=100)


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read(spark, sf_dir, "documents"))


def op10_ball_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(read(spark, sf_dir, "embeddings"), "vec_id % 50 = 0", 5)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


SQL = {
    "op7_chat_format": r"""
        WITH t AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL),
        o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS n FROM t),
        p AS (SELECT conv_id, n, string_agg('<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10), '' ORDER BY n)
              OVER (PARTITION BY conv_id ORDER BY n) AS text FROM o),
        e AS (SELECT conv_id, max(n) AS n_turns, max_by(text, n) AS text FROM p GROUP BY conv_id)
        SELECT min(conv_id) AS conv_id, n_turns, count(*) AS n_logged, text FROM e
        WHERE text NOT IN (SELECT p.text FROM p JOIN e USING (conv_id) WHERE p.n < e.n_turns)
        GROUP BY n_turns, text
    """,
    "op10_ball_tree": r"""
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
        ), r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s)
        SELECT * FROM r WHERE rank <= 5
    """,
    "op8_shingle_join": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS l
            FROM documents
        ), s AS (
            SELECT doc_id, unnest(list_distinct(CASE WHEN len(l) >= 3 THEN list_transform(range(1, len(l) - 1), lambda i: l[i] || ' ' || l[i + 1] || ' ' || l[i + 2]) ELSE [array_to_string(l, ' ')] END)) AS g
            FROM w WHERE len(l) > 0
        ), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id), p AS (
            SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
        ), l AS (
            SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * p.c >= 90 * (x.n + y.n - p.c)
        ), e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l), r AS (
            SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a
        )
        SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id
        FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a) c USING (doc_id)
    """,
    "op9_exact_dedup": r"""
        WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS h FROM documents)
        SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = min(doc_id) OVER g AS kept, h AS text_sha256
        FROM d WINDOW g AS (PARTITION BY h)
    """,
}


def oracle_sql() -> dict[str, str]:
    return {name: SQL[name] for name in queries() if name in SQL}
