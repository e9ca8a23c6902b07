"""The queries of the training-data operators and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .arrow_output import op4_arrow_stream
from .common import documents
from .cover_tree import op9_cover_tree
from .crf_langid import op1_crf_language
from .divergence import op13_divergence
from .divergence import oracle as divergence_sql
from .decision_list import op3_decision_list, with_statistics
from .kneser_ney import op8_kneser_ney
from .mixing import op7_raking
from .mixing import oracle as raking_sql
from .phrase_automata import op11_phrase_automata
from .phrase_automata import oracle as passages_sql
from .piece_scan import op6_piece_scan
from .sharding import op2_sampled_splitters
from .simhash import op5_simhash_blocks
from .spelling import op12_spelling
from .spelling import oracle as spelling_sql
from .suffix_dedup import op10_suffix_array

QUERIES = {
    f.__name__: f
    for f in (
        op1_crf_language,
        op2_sampled_splitters,
        op3_decision_list,
        op4_arrow_stream,
        op5_simhash_blocks,
        op6_piece_scan,
        op7_raking,
        op8_kneser_ney,
        op9_cover_tree,
        op10_suffix_array,
        op11_phrase_automata,
        op12_spelling,
        op13_divergence,
    )
}



def quality_statistics(spark, sf_dir: str):
    """The statistics of op3 before any rule, as SQL can express them."""
    rows = with_statistics(documents(spark, sf_dir).select("doc_id", "text"))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"))


QUERIES["quality_statistics"] = quality_statistics

#: Words are split by hand, as \\s and its like take more characters than the law does.
STATISTICS_SQL = """WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS MATERIALIZED (SELECT doc_id, text, list_filter(string_split_regex(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM d),
l AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id),
s AS MATERIALIZED (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 7), ' ') AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM w WHERE len(w) >= 8)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS c FROM s) WHERE c > 1),
n AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM r) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(array_to_string(list_concat([''], w), '')) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, len(w) < 20 OR 100 * coalesce(n_repeat_words, 0) > 30 * len(w) AS base_failed
FROM w LEFT JOIN l ON l.doc_id = w.doc_id LEFT JOIN n ON n.doc_id = w.doc_id"""

VECTORS_SQL = """WITH RECURSIVE v AS MATERIALIZED (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS MATERIALIZED (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
walk AS (SELECT x, y FROM l UNION SELECT w.x, l.y FROM walk w JOIN l ON w.y = l.x), c AS (SELECT x, least(x, min(y)) AS component FROM walk GROUP BY x), n AS (SELECT x, count(*) AS n FROM l GROUP BY x)
SELECT vec_id, coalesce(n.n, 0) AS n_links, coalesce(component, vec_id) AS component_id, vec_id = coalesce(component, vec_id) AS kept FROM embeddings LEFT JOIN n ON n.x = vec_id LEFT JOIN c ON c.x = vec_id"""

ORACLES: dict[str, str] = {"op7_raking": raking_sql(), "op9_cover_tree": VECTORS_SQL, "quality_statistics": STATISTICS_SQL, "op11_phrase_automata": passages_sql(), "op12_spelling": spelling_sql(), "op13_divergence": divergence_sql()}
