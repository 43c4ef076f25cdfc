"""The queries of this package for the driver, and their SQL where there is one."""

from __future__ import annotations

from . import decontaminate, embeddings, html_text, mixing, near_dedup, periodic_runs, pii, prefix_trie, quality, secrets, token_counts, token_files, warc

_MODULES = (decontaminate, embeddings, quality, mixing, pii, token_files, token_counts, secrets, near_dedup, html_text, warc, prefix_trie, periodic_runs)


def queries() -> dict:
    found = {name: getattr(m, name) for m in _MODULES for name in vars(m) if name.startswith("op") and name[2:3].isdigit()}
    found["pipeline"] = pipeline
    return found


def pipeline(spark, sf_dir: str):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def oracle_sql() -> dict[str, str]:
    return {k: v for m in _MODULES for k, v in m.SQL.items()}
