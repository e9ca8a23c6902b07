"""A few queries against their SQL on the smallest tables."""

import os

import duckdb
import pytest

import seqframe.assembly_queries
import seqframe.graph_queries
import seqframe.layout_queries
import seqframe.read_queries  # noqa: F401
from seqframe.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SOME = [
    "gapped_segments", "kmer_spectrum", "weak_split", "dovetail", "resolve_junctions", "interval_merge", "effective_intervals", "coverage_histogram", "length_parameters",
    "min_med_max_coverage", "kmer_pairs", "contains_all_kmers", "minimizers", "branch_degree", "unitigs", "edit_identity", "low_complexity_reads", "packed_reads", "mate_overlap",
    "strobemers", "seen_kmers", "bloom_filter_rate", "longest_covered_run", "aligned_blocks", "inverted_artefacts", "widened_islands", "binomial_edges", "stitched_paths",
    "kmer_successors", "left_variants", "canonical_successors", "canonical_left_variants", "complex_parts", "complex_parts_of_long", "backbone_paths", "stitched_backbones", "lookahead_coverage", "greedy_extension", "joined_mates", "corrected_mismatches",
    "best_pairs", "tail_scores_of_targets", "tail_oriented_edges", "mirrored_halves",
]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", SOME)
def test_query(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(ORACLES[name])
    got = QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = con.sql(f"SELECT {', '.join(chr(34) + c + chr(34) for c in columns)} FROM want").fetchall()
    assert sorted(map(repr, map(tuple, got.select(*columns).collect()))) == sorted(map(repr, rows))
