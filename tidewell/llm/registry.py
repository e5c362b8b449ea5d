"""The queries of this subpackage, and their SQL."""

from __future__ import annotations

from . import content_store, exact, merkle, mixing, nbsvm, packing, pivots, recompression, simhash, toxicity, vptree, warc, wavelet


def queries() -> dict:
    return {
        "op1_vantage_point_trees": vptree.op1,
        "op2_pivot_distance_index": pivots.op2,
        "op3_naive_bayes_svm": nbsvm.op3,
        "op4_recompression": recompression.op4,
        "op5_bin_completion": packing.op5,
        "op6_hierarchical_budget": mixing.op6,
        "op7_noisy_channel": toxicity.op7,
        "op8_warc_index_first": warc.op8,
        "op9_simhash_anchor_cover": simhash.op9,
        "op10_content_store": content_store.op10,
        "op11_dual_sorted_wavelet": wavelet.op11,
        "op12_binomial_runs": exact.op12,
        "op13_coordinate_proofs": merkle.op13,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_pivot_distance_index": pivots.ORACLE, "op6_hierarchical_budget": mixing.ORACLE, "op8_warc_index_first": warc.ORACLE, "op11_dual_sorted_wavelet": wavelet.ORACLE, "op12_binomial_runs": exact.ORACLE, "op13_coordinate_proofs": merkle.ORACLE}
