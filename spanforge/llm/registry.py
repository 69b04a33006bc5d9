"""What the driver entry file registers for this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chaining, counting, decontaminate, knn, minhash, packing, periodic, pii, quality, resampling, simhash, substring, toxicity

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_simhash_near_dedup": simhash.op1_simhash_near_dedup,
        "op2_substring_dedup": substring.op2_substring_dedup,
        "op3_best_fit_packing": packing.op3_best_fit_packing,
        "op4_edit_token_counts": counting.op4_edit_token_counts,
        "op5_voronoi_knn": knn.op5_voronoi_knn,
        "op6_toxicity": toxicity.op6_toxicity,
        "op7_decontamination": decontaminate.op7_decontamination,
        "op8_collinear_chaining": chaining.op8_collinear_chaining,
        "op9_quality": quality.op9_quality,
        "op10_pii_surrogates": pii.op10_pii_surrogates,
        "op11_periodic_runs": periodic.op11_periodic_runs,
        "op12_superminhash_near_dedup": minhash.op12_superminhash_near_dedup,
        "op13_importance_resampling": resampling.op13_importance_resampling,
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_voronoi_knn": knn.OP5_SQL, "op7_decontamination": decontaminate.OP7_SQL,
            "op12_superminhash_near_dedup": minhash.OP12_SQL, "op13_importance_resampling": resampling.OP13_SQL}
