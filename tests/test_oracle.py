"""Registered queries beside their SQL on the smallest tables."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry
from groundtally.plans import registry
from tests.oracle_check import check, duck

SF = "/root/testdata/sf0.001"
QUICK = ("A6_quota_harvest", "A11_integrity_check", "A12_split_manifest", "A14_sample_hash", "C11_mined_mapping", "D18_class_sets", "D14_referring_box", "E18_rule_residue", "E19_tfidf",
         "G2_top_reasons", "G15_coverage_precision", "G24_metric_delta", "H13_class_presence", "H14_absent_classes", "I1_column_profile", "J5_band_presence", "J7_stack_channels", "A13_input_fingerprint", "B8_redact_secrets", "C10_class_inventory", "D9_area", "D10_adjacency", "E14_query_spec", "G1_task_score",
         "G12_mcnemar", "G21_corpus_bleu", "G22_rouge_l", "H3_stratified_folds", "H5_severed_pairs", "I14_option_spacing", "I26_surface_forms", "J4_norm_stats")


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(SF):
        pytest.skip("no test tables here")
    return duck(SF)


@pytest.mark.parametrize("key", QUICK)
def test_query_equals_sql(spark, con, key):
    status, rows, *_, why = check(spark, con, SF, key, entry.queries()[key], entry.oracle_sql()[key])
    assert status == "ok", why


def test_every_query_has_sql_but_the_fitted_models():
    assert set(registry.queries()) - set(registry.oracle_sql()) == {"E18_intent_classifier", "E18_combined", "F14_blind_classifier"}
    assert set(entry.oracle_sql()) <= set(entry.queries())
