"""The subpackage's queries by name, and DuckDB SQL for those that SQL can express.

All modules are imported here, so that a missing dependency shows when the subpackage is imported.
"""

from __future__ import annotations

from . import bpe, kdtree, langid, licenses, neardup, packing, permutation, quality, suffixdedup, tokenfile

QUERIES = {
    f.__name__: f
    for f in (
        licenses.op1_license_scan, langid.op2_language_id, bpe.op3_bpe, quality.op4_quality_classifier, kdtree.op5_exact_top_k, neardup.op6_minhash_near_dedup, tokenfile.op7_token_files,
        packing.op8_best_fit_packing, suffixdedup.op9_suffix_array_dedup, permutation.op10_permutation_index,
    )
}
ORACLES = {"op1_license_scan": licenses.ORACLE_SQL, "op5_exact_top_k": kdtree.ORACLE_SQL, "op6_minhash_near_dedup": neardup.ORACLE_SQL}


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLES)
