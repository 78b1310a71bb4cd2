"""DuckDB text of the derived input views, shared by the check queries."""

from __future__ import annotations

from groundtally.functions import dims
from groundtally.functions import fixed_values as V
from groundtally.sources.fixture import ANNOTATION_SELECT


def q(text: str | None) -> str:
    """A SQL string literal."""
    return "NULL" if text is None else "'" + text.replace("'", "''") + "'"


def values(rows, cols: str) -> str:
    body = ", ".join("(" + ", ".join(q(v) if isinstance(v, str) or v is None else str(v) for v in r) + ")"
                     for r in rows)
    return f"(SELECT * FROM (VALUES {body}) AS v({cols}))"


TAX = "tax AS " + values(dims.class_rows(), "code, idx, name, l2, l1, c19, c19_id, coarse7, coarse7_id")
C19 = "c19 AS " + values([(i, n) for i, n in enumerate(dims.C19_NAMES)], "cls, class_name")

PIXELS = """pixels AS (
  SELECT i.patch_id, i.r AS row, i.c AS col, CASE WHEN i.idx < 0 THEN 999 ELSE t.code END AS code
  FROM (SELECT CAST(n_nationkey AS INT) AS patch_id, CAST(FLOOR(p_partkey / 40) AS INT) AS r,
          CAST(p_partkey % 40 AS INT) AS c,
          CASE WHEN p_partkey % 97 = 0 THEN -2 ELSE
            CAST((CAST(FLOOR(FLOOR(p_partkey / 40) / 5) AS INT) * 3
                + CAST(FLOOR((p_partkey % 40) / 8) AS INT) * 5
                + n_nationkey * 7 + CASE WHEN p_size % 10 = 0 THEN 1 ELSE 0 END) % 44 AS INT) END AS idx
        FROM nation CROSS JOIN part) i
  LEFT JOIN tax t ON t.idx = i.idx)"""

PATCHES = """patches AS (
  SELECT CONCAT('S2A_', CAST(c_custkey AS VARCHAR), '_T', CAST(10 + c_nationkey AS VARCHAR), 'ABC_',
                CAST(CAST(FLOOR((c_custkey % 120) / 12) AS INT) AS VARCHAR), '_',
                CAST((c_custkey % 120) % 12 AS VARCHAR)) AS patch_id,
         CONCAT('T', CAST(10 + c_nationkey AS VARCHAR), 'ABC') AS tile,
         CAST(FLOOR((c_custkey % 120) / 12) AS INT) AS row,
         CAST((c_custkey % 120) % 12 AS INT) AS col, c_mktsegment AS country,
         CAST(36 AS DOUBLE) + c_nationkey + CAST(FLOOR((c_custkey % 120) / 12) AS DOUBLE) / 80 AS lat,
         CAST(-8 AS DOUBLE) + c_nationkey + CAST((c_custkey % 120) % 12 AS DOUBLE) / 60 AS lon
  FROM customer)"""

CLS = "cls AS " + values([(i, n) for i, n in enumerate(dims.C19_NAMES)], "k, name")
ANNOTATIONS = CLS + ", ann_all AS (" + ANNOTATION_SELECT.format(orders="orders", cls="cls") + \
    "), ann AS (SELECT * FROM ann_all WHERE split <> 'bench')"

SCORED = """scored AS (
  SELECT l_suppkey AS patch_id, CONCAT(l_returnflag, '|', l_linestatus) AS task,
         l_tax < 0.01 AS abstained, (l_tax >= 0.01 AND l_discount < 0.05) AS correct,
         CASE WHEN l_tax < 0.01 THEN CONCAT('reason ', CAST(l_linenumber AS VARCHAR)) ELSE '' END AS reason
  FROM lineitem)"""

SHAPES = "shapes AS (SELECT patch_id, MAX(row) + 1 AS h, MAX(col) + 1 AS w FROM pixels GROUP BY patch_id)"
PIX19 = "pix19 AS (SELECT p.patch_id, p.row, p.col, t.c19_id AS cls FROM pixels p JOIN tax t USING (code) WHERE t.c19_id >= 0)"


def first_hit(col: str, pairs, default: str = "NULL") -> str:
    """CASE over (label, pattern) pairs, first match wins."""
    return "CASE " + " ".join(
        f"WHEN regexp_matches({col}, {q(p)}) THEN {q(lab)}" for lab, p in pairs) + f" ELSE {default} END"


def chain(*ctes: str) -> str:
    return "WITH RECURSIVE " + ", ".join(ctes) + " "
