"""The queries of this subpackage, with DuckDB twins where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import table
from . import bpe, classifier, jaccard, jpeg, mixing, negatives, personal, ppm, quality, secrets, sentencepieces, spellings, tokenfile


def _documents(operator: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: operator(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_cube_mixing": _documents(mixing.mix),
    "op2_secret_automaton": _documents(secrets.find),
    "op3_progressive_jpeg": _documents(jpeg.store),
    "op4_divergence_rules": _documents(quality.report),
    "op5_bpe_transducer": _documents(bpe.encode_documents),
    "op6_jaccard_join": _documents(jaccard.link),
    "op7_ppm_scoring": _documents(ppm.score),
    "op8_quality_classifier": lambda spark, sf_dir: classifier.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")),
    "op9_personal_data": _documents(personal.find),
    "op10_token_files": _documents(tokenfile.round_trip),
    "op11_spelling_variants": _documents(spellings.group),
    "op12_cover_negatives": lambda spark, sf_dir: negatives.mine(table(spark, sf_dir, "embeddings")),
    "op13_piece_rounds": _documents(sentencepieces.encode_documents),
}

ORACLE: dict[str, str] = {"op6_jaccard_join": jaccard.SQL, "op4_divergence_rules": quality.SQL, "op11_spelling_variants": spellings.SQL, "op12_cover_negatives": negatives.SQL}
