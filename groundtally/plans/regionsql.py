"""DuckDB text of the region measurements, written pixel- and run-wise with recursive queries."""

from __future__ import annotations

from groundtally.functions import fixed_values as V
from groundtally.operators.regions import disk_offsets
from groundtally.plans.sqlviews import PIX19, PIXELS, SHAPES, TAX


def offsets(radius: int) -> str:
    return "(SELECT * FROM (VALUES " + ", ".join(f"({a}, {b})" for a, b in disk_offsets(radius)) + ") AS o(dy, dx))"


def islands(name: str, cells: str) -> str:
    return (f"{name} AS MATERIALIZED (SELECT patch_id, cls, row, MIN(col) AS c0, MAX(col) AS c1, "
            f"patch_id::BIGINT * 100000000000000000 + cls * 1000000000000000::BIGINT + row * {1 << 32} + MIN(col) AS id "
            f"FROM (SELECT *, col - ROW_NUMBER() OVER (PARTITION BY patch_id, cls, row ORDER BY col) AS g "
            f"FROM {cells}) GROUP BY patch_id, cls, row, g)")


def links(name: str, runs: str, reach: int) -> str:
    half = (f"SELECT a.id AS a, b.id AS b FROM {runs} a JOIN {runs} b ON a.patch_id = b.patch_id AND a.cls = b.cls "
            f"AND b.row = a.row + 1 AND a.c0 <= b.c1 + {reach} AND b.c0 <= a.c1 + {reach}")
    return f"{name} AS MATERIALIZED (WITH h AS ({half}) SELECT a, b FROM h UNION ALL SELECT b, a FROM h)"


def labelling(name: str, runs: str, edges: str) -> str:
    return (f"{name}(id, lab) USING KEY (id) AS (SELECT id, id FROM {runs} UNION "
            f"SELECT e.b, MIN(c.lab) FROM {name} c JOIN {edges} e ON e.a = c.id "
            f"JOIN recurring.{name} r ON r.id = e.b WHERE c.lab < r.lab GROUP BY e.b)")


def region_ctes(connectivity: int = 4, fill: bool = True, opening: int = 0, prefix: str = "",
                base: bool = True) -> list[str]:
    """CTEs ending in `{prefix}mask` (cells), `{prefix}lrun` (labelled runs) and `{prefix}reg`."""
    p = prefix
    out = [TAX, PIXELS, SHAPES, PIX19] if base else []
    src = "pix19"
    if opening:
        o = offsets(opening)
        size = len(disk_offsets(opening))
        out.append(f"{p}ero AS (SELECT patch_id, cls, row - dy AS row, col - dx AS col FROM pix19, {o} o "
                   f"GROUP BY ALL HAVING COUNT(*) = {size})")
        out.append(f"{p}opn AS (SELECT DISTINCT patch_id, cls, row + dy AS row, col + dx AS col FROM {p}ero, {o} o)")
        src = f"{p}opn"
    if fill:
        out.append(f"{p}bg AS (SELECT c.patch_id, c.cls, x.row, x.col FROM (SELECT DISTINCT patch_id, cls FROM {src}) c "
                   f"JOIN pixels x ON x.patch_id = c.patch_id ANTI JOIN {src} m "
                   f"ON m.patch_id = c.patch_id AND m.cls = c.cls AND m.row = x.row AND m.col = x.col)")
        out.append(islands(f"{p}gap", f"{p}bg"))
        out.append(links(f"{p}gedge", f"{p}gap", 0))
        out.append(f"{p}outside(id) AS (SELECT g.id FROM {p}gap g JOIN shapes s ON s.patch_id = g.patch_id "
                   f"WHERE g.row = 0 OR g.row = s.h - 1 OR g.c0 = 0 OR g.c1 = s.w - 1 "
                   f"UNION SELECT e.b FROM {p}outside o JOIN {p}gedge e ON e.a = o.id)")
        out.append(f"{p}hole AS (SELECT g.patch_id, g.cls, g.row, UNNEST(RANGE(g.c0, g.c1 + 1)) AS col FROM {p}gap g "
                   f"ANTI JOIN {p}outside o ON o.id = g.id)")
        out.append(f"{p}mask AS (SELECT patch_id, cls, row, col FROM {src} UNION ALL SELECT * FROM {p}hole)")
    else:
        out.append(f"{p}mask AS (SELECT patch_id, cls, row, col FROM {src})")
    out.append(islands(f"{p}run", f"{p}mask"))
    out.append(links(f"{p}edge", f"{p}run", 1 if connectivity == 8 else 0))
    out.append(labelling(f"{p}cc", f"{p}run", f"{p}edge"))
    out.append(f"{p}lrun AS MATERIALIZED (SELECT r.*, c.lab % 1000000000000000 AS label FROM {p}run r JOIN {p}cc c ON c.id = r.id)")
    out.append(
        f"{p}reg AS MATERIALIZED (SELECT patch_id, cls, label, CAST(SUM(c1 - c0 + 1) AS BIGINT) AS area_px, MIN(row) AS r0, "
        f"MIN(c0) AS c0, MAX(row) + 1 AS r1, MAX(c1) + 1 AS c1, CAST(SUM(row * (c1 - c0 + 1)) AS BIGINT) AS sum_row, "
        f"CAST(SUM((c0 + c1) * (c1 - c0 + 1)) AS BIGINT) AS sum_col2 FROM {p}lrun GROUP BY patch_id, cls, label)")
    return out


def fact_cte(prefix: str = "") -> str:
    p = prefix
    return (
        f"{p}fact AS MATERIALIZED (SELECT r.patch_id, r.cls, COUNT(*) AS n_regions, CAST(SUM(area_px) AS BIGINT) AS area_px, "
        f"SUM(area_px) * 100.0::DOUBLE AS area_m2, SUM(area_px)::DOUBLE / ANY_VALUE(s.h * s.w) AS coverage, "
        f"100.0::DOUBLE * SUM(area_px) / ANY_VALUE(s.h * s.w) AS coverage_pct, "
        f"SUM(sum_row)::DOUBLE / SUM(area_px) AS mask_row, SUM(sum_col2)::DOUBLE / (2 * SUM(area_px)) AS mask_col, "
        f"ARG_MAX(sum_row::DOUBLE / area_px, area_px * 100000000000000 - label) AS big_row, "
        f"ARG_MAX(sum_col2::DOUBLE / (2 * area_px), area_px * 100000000000000 - label) AS big_col, "
        f"(MIN(r0) + MAX(r1)) / 2.0::DOUBLE AS box_row, (MIN(c0) + MAX(c1)) / 2.0::DOUBLE AS box_col, "
        f"ANY_VALUE(s.h) AS h, ANY_VALUE(s.w) AS w "
        f"FROM {p}reg r JOIN shapes s ON s.patch_id = r.patch_id WHERE area_px >= {V.MIN_MAPPING_UNIT_PX} GROUP BY r.patch_id, r.cls)")


def adjacency_cte(radius: int = V.DILATION_PX, name: str = "adj") -> str:
    return (f"{name} AS MATERIALIZED (SELECT a.patch_id, a.cls AS class_a, b.cls AS class_b, "
            f"COUNT(DISTINCT (b.row, b.col)) AS overlap_px FROM (SELECT patch_id, cls, row + dy AS row, col + dx AS col "
            f"FROM pix19, {offsets(radius)} o) a JOIN pix19 b ON a.patch_id = b.patch_id AND a.row = b.row AND a.col = b.col "
            f"WHERE a.cls <> b.cls GROUP BY ALL)")


def bearing_sql(dr: str, dc: str) -> str:
    a = f"degrees(atan2({dc}, -({dr})))"
    return f"(({a}) - 360.0::DOUBLE * FLOOR(({a}) / 360.0::DOUBLE))"


def compass_sql(angle: str, band: str) -> str:
    m = f"(({angle}) - 90.0::DOUBLE * FLOOR(({angle}) / 90.0::DOUBLE))"
    return (f"CASE WHEN ABS({m} - 45.0::DOUBLE) <= ({band}) / 2.0::DOUBLE "
            f"THEN (['NE', 'SE', 'SW', 'NW'])[CAST(FLOOR(({angle}) / 90.0::DOUBLE) AS INT) % 4 + 1] "
            f"ELSE (['N', 'E', 'S', 'W'])[CAST(ROUND_EVEN(({angle}) / 90.0::DOUBLE, 0) AS INT) % 4 + 1] END")
