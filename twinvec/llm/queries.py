"""Imports every module that registers a query."""

from twinvec.llm import (bpe, embedding_dedup, license_scan, line_dedup, merkle, ngram_jaccard, packing, quality_lm,  # noqa: F401
                         phrases, quality_rules, substring_dedup, url_filter, warc)
from twinvec.llm.registry import ORACLE, QUERIES


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLE)
