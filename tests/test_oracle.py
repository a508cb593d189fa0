"""Every registered query with SQL against DuckDB on the same tables; the others for rows."""

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check_oracle import TABLES, rows

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="session")
def con(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, sf, con, name):
    df = QUERIES[name](spark, sf)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    if name not in ORACLES:
        assert got
    else:
        cur = con.execute(ORACLES[name])
        names = [d[0] for d in cur.description]
        assert sorted(names) == sorted(df.columns)
        assert got == rows(names, cur.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() == 2


def test_survey_names_are_registered():
    wanted = """scan_metadata scan_captions scan_image_folder scan_predicate_matrix scan_tar_shards group_samples
    expand_shards dataset_size read_dataset json_lookup feature_roundtrip export_features metrics_sink
    retry_sink mirror_diff verify_checksums parse_taxon taxon_ranks scientific_name taxonomic_name common_name
    sci_common_name taxon_common_name text_types class_prompt_name prompt_expand random_text_type basic_clean
    whitespace_clean canonicalize_text canonicalize_keep clean_modes pretokenize encode_corpus decode_tokens frame_tokens
    reduce_random reduce_shuffle reduce_block reduce_priority frame_cls encode_traits path_parts coalesce_parts
    task_catalog l2_normalize cl2n logits pairwise_distance natural_sort latest_by_natural_key threshold_labels
    filter_complete_samples drop_null_traits task_splits filter_classes skip_bad_samples kshot_guard existing_shards
    old_new_mask epoch_gate label_encode attach_attributes zip_lines semi_classes unlabelled_anti task_features
    cross_scores replay_pairing label_consistency weighted_resample inbatch_pairs class_index mean_vector class_centroids
    ensemble_prototypes topk_accuracy exact_match macro_f1 micro_accuracy fold_summary average_meter
    average_meter_windowed throughput contrastive_eval retrieval_metrics sigmoid_pair_loss segment_loss distill_loss
    contingency cluster_accuracy cluster_purity kmeans_inertia count_samples knn_vote distinct_classes topk_classes
    nearest_centroid kshot_split k_per_class subset_sampler balanced_val exact_fraction relabel_priority class_to_idx
    class_to_idx_sorted permute_classes row_index assign_batches assign_batches_drop_last epoch_shuffle assign_workers
    pad_shares match_rank d2_seed_step best_restart sorted_classes merge_flagged new_classes except_ids union_sources
    few_shot_eval zero_shot_eval simpleshot_eval kmeans_fixed_init semi_kmeans category_discovery task_probe
    multilabel_probe training_mix shared_features embed_batch stream_shards stream_meter stream_results stream_scores
    stream_resume read_features""".split()
    assert not set(wanted) - set(QUERIES)
