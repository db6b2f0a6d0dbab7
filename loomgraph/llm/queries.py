"""The registered queries of this subpackage, and their SQL where DuckDB can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomgraph.llm import bestfit, blocknames, bpe, langid, linededup, media, mixing, packing, prefixtrie, quality, setjoin, spelling, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    return {
        "op1_pack_tokens": packing.query,
        "op2_language_id": langid.query,
        "op3_quality": quality.query,
        "op4_media_columns": media.query,
        "op5_jaccard_join": setjoin.query,
        "op6_warc": warc.query,
        "op7_bpe": bpe.query,
        "op8_mixing": mixing.query,
        "op9_exact_dedup": blocknames.query,
        "op10_line_dedup": linededup.query,
        "op11_prefix_trie": prefixtrie.query,
        "op12_best_fit_packing": bestfit.query,
        "op13_spelling_variants": spelling.query,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {"op9_exact_dedup": blocknames.ORACLE, "op11_prefix_trie": prefixtrie.ORACLE}
