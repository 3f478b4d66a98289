"""The operators as queries over the test tables, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, whole

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pretokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


@_query(
    """
    WITH t AS (
      SELECT doc_id, length(coalesce(text, '')) AS points, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS norm FROM documents
    ), g AS (
      SELECT norm, count(*) AS group_size, arg_min(doc_id, (-points, doc_id)) AS keep_id FROM t GROUP BY norm
    )
    SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM t JOIN g USING (norm)
    """
)
def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_dedup

    return exact_dedup(table(spark, sf_dir, "documents"))


@_query()
def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


@_query(
    """
    WITH RECURSIVE w AS (
      SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents
    ), s AS (
      SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS shingle FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)
    ), n AS (
      SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
    ), links AS (
      SELECT x, y FROM (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL)
      JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 75 * (nx.n + ny.n - c)
    ), e AS (
      SELECT x, y FROM links UNION ALL SELECT y, x FROM links
    ), reach AS (
      SELECT doc_id AS node, doc_id AS other FROM documents UNION SELECT r.node, e.y FROM reach r JOIN e ON r.other = e.x
    )
    SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
    FROM (SELECT node AS doc_id, min(other) AS component_id FROM reach GROUP BY node) LEFT JOIN n USING (doc_id)
    """
)
def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


@_query(
    """
    WITH l AS (
      SELECT doc_id, source, text, i, line, trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare
      FROM (SELECT doc_id, source, text, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)
    ), b AS (
      SELECT bare FROM l WHERE length(bare) >= 20 AND source IS NOT NULL GROUP BY bare HAVING count(DISTINCT source) >= 10 AND count(DISTINCT coalesce(text, '')) >= 10
    )
    SELECT doc_id, CAST(count(*) FILTER (hit) AS BIGINT) AS lines_removed, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT hit), '')) AS text_sha256
    FROM (SELECT l.*, b.bare IS NOT NULL AS hit FROM l LEFT JOIN b USING (bare)) GROUP BY doc_id
    """
)
def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import dedup_lines

    clean = dedup_lines(table(spark, sf_dir, "documents"))
    return clean.select("doc_id", "lines_removed", F.sha2(whole("text"), 256).alias("text_sha256"))


def _license_sql() -> str:
    """The scan in SQL: k-grams as texts instead of hashes; of each place where a notice may start, the distinct template
    positions in reach are counted by a join of the hits with themselves."""
    import re

    from .license_scan import COVERAGE, GAP, NOTICE_GRAM, NOTICES, PHRASE_GRAM, PHRASES, WORD

    rows = []
    for i, (text, label, k, base) in enumerate([(t, x, PHRASE_GRAM, True) for t, x in PHRASES.items()] + [(t, x, NOTICE_GRAM, False) for x, t in NOTICES.items()]):
        words = re.findall(WORD, text.lower())
        rows += [f"({i}, '{label}', {base}, {k}, {len(words) - k + 1}, {at}, '{' '.join(words[at : at + k])}')" for at in range(len(words) - k + 1)]
    return f"""
    WITH w AS (
      SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS ws FROM documents
    ), p AS (
      SELECT doc_id, unnest(ws) AS a, CAST(generate_subscripts(ws, 1) - 1 AS BIGINT) AS pos FROM w
    ), g AS (
      SELECT doc_id, pos, a || ' ' || lead(a) OVER o AS two, a || ' ' || lead(a) OVER o || ' ' || lead(a, 2) OVER o || ' ' || lead(a, 3) OVER o AS four
      FROM p WINDOW o AS (PARTITION BY doc_id ORDER BY pos)
    ), t(template, label, base, k, grams, tpos, gram) AS (VALUES {", ".join(rows)}),
    hits AS MATERIALIZED (
      SELECT doc_id, template, label, base, grams, tpos, pos - tpos AS diagonal FROM g JOIN t ON k = {PHRASE_GRAM} AND two = gram
      UNION ALL SELECT doc_id, template, label, base, grams, tpos, pos - tpos FROM g JOIN t ON k = {NOTICE_GRAM} AND four = gram
    ), phrases AS (
      SELECT doc_id, label, diagonal AS word FROM hits WHERE base GROUP BY doc_id, template, label, grams, diagonal HAVING count(DISTINCT tpos) = max(grams)
    ), steps AS (
      SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY doc_id, template ORDER BY diagonal) > {GAP} THEN 1 ELSE 0 END AS new
      FROM (SELECT DISTINCT doc_id, template, label, grams, diagonal FROM hits WHERE NOT base)
    ), chains AS (
      SELECT *, sum(new) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS chain FROM steps
    ), reach AS (
      SELECT c.doc_id, c.template, c.label, c.grams, c.chain, c.diagonal, count(DISTINCT h.tpos) / CAST(c.grams AS DOUBLE) AS coverage
      FROM chains c JOIN chains o ON o.doc_id = c.doc_id AND o.template = c.template AND o.chain = c.chain AND o.diagonal BETWEEN c.diagonal AND c.diagonal + c.grams
      JOIN hits h ON h.doc_id = o.doc_id AND h.template = o.template AND h.diagonal = o.diagonal GROUP BY c.doc_id, c.template, c.label, c.grams, c.chain, c.diagonal
    ), starts AS (
      SELECT doc_id, label, max(coverage) AS coverage, list({{'n': CAST(1 AS BIGINT), 'at': CAST(diagonal AS BIGINT), 'grams': grams}} ORDER BY diagonal) FILTER (coverage >= {COVERAGE}) AS places
      FROM reach GROUP BY doc_id, template, label, chain
    ), notices AS (
      SELECT doc_id, label, coverage,
        CASE WHEN len(places) > 0 THEN list_reduce(places, lambda a, b: CASE WHEN b.at > a.at + a.grams THEN {{'n': a.n + 1, 'at': b.at, 'grams': a.grams}} ELSE a END).n END AS times FROM starts
    ), d AS (
      SELECT doc_id, sum(n_base) AS n_base, min(first_word) AS first_word, max(last_word) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (n_base > 0) AS base_labels,
        string_agg(DISTINCT label, ',' ORDER BY label) FILTER (coverage >= {COVERAGE}) AS labels, max(coverage) AS score, sum(times) AS n_notices
      FROM (
        SELECT doc_id, label, count(*) AS n_base, min(word) AS first_word, max(word) AS last_word, 1.0 AS coverage, 0 AS times FROM phrases GROUP BY doc_id, label
        UNION ALL SELECT doc_id, label, 0, NULL, NULL, coverage, coalesce(times, 0) FROM notices
      ) GROUP BY doc_id
    )
    SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
      CAST(coalesce(score, 0.0) AS DOUBLE) AS score, CAST(coalesce(n_notices, 0) AS BIGINT) AS n_notices FROM w LEFT JOIN d USING (doc_id)
    """


@_query(_license_sql())
def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .license_scan import license_scan

    return license_scan(table(spark, sf_dir, "documents"))


@_query()
def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import encode_digests

    return encode_digests(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.tiktoken"), pretokenizer())


@_query()
def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import document_token_counts

    return document_token_counts(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.tiktoken"), pretokenizer(), eod=50256)


@_query()
def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm_score import lm_scores

    return lm_scores(table(spark, sf_dir, "documents"))


@_query(
    """
    WITH v AS (
      SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
      WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ), s AS (
      SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
    )
    SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
    FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
    """
)
def op8_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .vector_search import top_k

    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


@_query()
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@_query()
def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


@_query(
    """
    WITH d AS (
      SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
    ), u AS (
      SELECT *, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d
    ), c AS (
      SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
        CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u
    ), p AS (
      SELECT *, substring(text, 1, a) AS prefix, substring(text, a + 1, b - a) AS middle, substring(text, b + 1) AS suffix FROM c
    )
    SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
      sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
      sha256(text) AS restored_sha256
    FROM p
    """
)
def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fill_in_middle import digests

    return digests(table(spark, sf_dir, "documents"))


@_query()
def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .alignment import alignment

    return alignment(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))
