"""Every registered query and its check SQL, gathered from the family modules."""

from __future__ import annotations

import importlib

FAMILIES = ("scans", "quality", "classes", "regions", "questions", "answers", "scoring", "fitting",
            "folds", "corpus", "bands", "streams")


def _modules():
    return [importlib.import_module(f"groundtally.plans.{name}") for name in FAMILIES]


def queries():
    out = {}
    for m in _modules():
        out.update(m.QUERIES)
    return out


def oracle_sql():
    out = {}
    for m in _modules():
        out.update(m.ORACLES)
    return out


def flagship(spark, sf):
    from groundtally.plans import answers

    return answers.flagship(spark, sf)
