"""All queries of the alignment engine with their SQL."""

from __future__ import annotations

from . import coding, dataset, files, genome, levels, packaging, selection, signals, viewer


def queries() -> dict:
    return signals.QUERIES | genome.QUERIES | files.QUERIES | packaging.QUERIES | dataset.QUERIES | coding.QUERIES | viewer.QUERIES | selection.QUERIES | levels.QUERIES


def oracle_sql() -> dict[str, str]:
    return signals.SQL | genome.SQL | files.SQL | packaging.SQL | dataset.SQL | coding.SQL | viewer.SQL | selection.SQL | levels.SQL
