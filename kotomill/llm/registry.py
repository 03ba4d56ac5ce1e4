"""The queries of this subpackage, and the pipeline at the top of the repository."""

from __future__ import annotations

from . import clusters, decontam, divergence, html, licences, mixing, pii, quality, quotes, records, secrets, simhash, topk

MODULES = (decontam, html, quality, quotes, pii, secrets, simhash, mixing, topk, licences, clusters, records, divergence)


def queries() -> dict:
    import corpus_pipeline

    found = {name: query for module in MODULES for name, query in module.QUERIES.items()}
    return found | {"pipeline": corpus_pipeline.run}


def oracles() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
