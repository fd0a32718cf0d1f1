"""Queries of this folder and their SQL."""

from __future__ import annotations

from codelake.llm import (
    decontaminate,
    exact,
    filter_audit,
    language,
    licences,
    minhash,
    mixing,
    ngram_lm,
    quality,
    repeats,
    resample,
    simhash,
    warc,
)

MODULES = [language, licences, exact, quality, decontaminate, mixing, ngram_lm, repeats, simhash, warc,
           resample, minhash, filter_audit]
QUERIES = {name: query for m in MODULES for name, query in m.QUERIES.items()}
SQL = {name: sql for m in MODULES for name, sql in m.SQL.items()}
