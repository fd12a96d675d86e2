"""Queries whose Spark SQL and DuckDB SQL are one text, or two texts where the dialects differ.

``{name}`` is a view of :mod:`.fixtures`. Spark gets the views as DataFrames and optimises each query as one plan.
"""

from __future__ import annotations

#: name -> SQL of both engines, or (Spark SQL, DuckDB SQL).
SQL: dict[str, str | tuple[str, str]] = {}

# Projections and scalar functions -------------------------------------------------------------------------------------
SQL["las_decode"] = "SELECT point_idx, x_raw * cast(0.001 AS double) + 1000 AS x, y_raw * cast(0.01 AS double) - 50 AS y, z_raw * cast(0.001 AS double) AS z FROM (SELECT point_idx, cast(floor(x * 1000) AS int) AS x_raw, cast(floor(y * 100) AS int) AS y_raw, cast(floor(z * 1000) AS int) AS z_raw FROM {points})"
SQL["global_shift"] = "SELECT p.point_idx, p.x - f.x AS x, p.y - f.y AS y, p.z - f.z AS z FROM {points} p CROSS JOIN (SELECT x, y, z FROM {points} WHERE point_idx = 0) f"
_BOX = "(SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, min(z) AS z0, max(z) AS z1 FROM {points})"
SQL["frame_zup_to_yup"] = f"SELECT point_idx, x - (x0 + x1) / 2 AS vx, z - z0 AS vy, -(y - (y0 + y1) / 2) AS vz FROM {{points}} CROSS JOIN {_BOX} b"
SQL["frame_center_yup"] = f"SELECT point_idx, x - (x0 + x1) / 2 AS vx, y - (y0 + y1) / 2 AS vy, z - (z0 + z1) / 2 AS vz FROM {{points}} CROSS JOIN {_BOX} b"
# Viewer-local, Y up, with one translation -> world -> viewer-local, Z up source, with another.
SQL["frame_map"] = "SELECT point_idx, wx - 3.0 AS vx, wz - 1.5 AS vy, -(wy - 2.0) AS vz FROM (SELECT point_idx, x + 10.0 AS wx, y + 20.0 AS wy, z + 30.0 AS wz FROM {points})"
SQL["pose_quaternion"] = """SELECT point_idx,
 (1 - 2 * (qy * qy + qz * qz)) * x + 2 * (qx * qy - qz * qw) * y + 2 * (qx * qz + qy * qw) * z + scan_id AS x,
 2 * (qx * qy + qz * qw) * x + (1 - 2 * (qx * qx + qz * qz)) * y + 2 * (qy * qz - qx * qw) * z + 2.0 AS y,
 2 * (qx * qz - qy * qw) * x + 2 * (qy * qz + qx * qw) * y + (1 - 2 * (qx * qx + qy * qy)) * z + 3.0 AS z
FROM (SELECT point_idx, x, y, z, scan_id, w / n AS qw, a / n AS qx, b / n AS qy, c / n AS qz FROM
 (SELECT *, CASE WHEN s = 0 THEN cast(1 AS double) ELSE sqrt(s) END AS n FROM
  (SELECT *, w * w + a * a + b * b + c * c AS s FROM
   (SELECT point_idx, x, y, z, scan_id, cast(scan_id AS double) AS w, cast(0.5 AS double) AS a, cast(scan_id * 0.25 AS double) AS b, cast(1 AS double) AS c FROM {points}) u1) u2) u3) u4"""
SQL["spherical_to_cartesian"] = "SELECT point_idx, round(x * cos(el) * cos(az), 9) AS x, round(x * cos(el) * sin(az), 9) AS y, round(x * sin(el), 9) AS z FROM (SELECT point_idx, x, y / 10 AS az, z / 20 AS el FROM {points})"
SQL["ptx_transform"] = """SELECT point_idx, CASE WHEN row_form THEN x * m0 + y * m4 + z * m8 + m12 ELSE x * m0 + y * m1 + z * m2 + m3 END AS x,
 CASE WHEN row_form THEN x * m1 + y * m5 + z * m9 + m13 ELSE x * m4 + y * m5 + z * m6 + m7 END AS y,
 CASE WHEN row_form THEN x * m2 + y * m6 + z * m10 + m14 ELSE x * m8 + y * m9 + z * m10 + m11 END AS z
FROM (SELECT *, CASE WHEN abs(m3) < 1e-8 AND abs(m7) < 1e-8 AND abs(m11) < 1e-8 AND abs(m15 - 1) < 1e-8 THEN true
  WHEN abs(m12) < 1e-8 AND abs(m13) < 1e-8 AND abs(m14) < 1e-8 AND abs(m15 - 1) < 1e-8 THEN false ELSE true END AS row_form FROM
 (SELECT point_idx, x, y, z, cast(0 AS double) AS m0, cast(1 AS double) AS m1, cast(0 AS double) AS m2, CASE WHEN scan_id < 2 THEN cast(0 AS double) ELSE cast(5 AS double) END AS m3,
   cast(-1 AS double) AS m4, cast(0 AS double) AS m5, cast(0 AS double) AS m6, cast(0 AS double) AS m7, cast(0 AS double) AS m8, cast(0 AS double) AS m9, cast(1 AS double) AS m10,
   cast(0 AS double) AS m11, CASE WHEN scan_id < 2 THEN cast(7 AS double) ELSE cast(0 AS double) END AS m12, cast(0 AS double) AS m13, cast(0 AS double) AS m14, cast(1 AS double) AS m15 FROM {points}) u1) u2"""
SQL["color_divisor"] = "SELECT scan_id, CASE WHEN m = 0 THEN 0 WHEN m > 255 THEN 65535 ELSE 255 END AS divisor FROM (SELECT scan_id, max(greatest(x * 10 * scan_id, y, z)) AS m FROM {points} GROUP BY scan_id)"
SQL["color_normalize"] = "SELECT point_idx, greatest(cast(0 AS double), least(cast(1 AS double), x / d)) AS r, greatest(cast(0 AS double), least(cast(1 AS double), y / d)) AS g, greatest(cast(0 AS double), least(cast(1 AS double), z / d)) AS b FROM {points} CROSS JOIN (SELECT CASE WHEN m > 255 THEN cast(65535 AS double) WHEN m > 1.0001 THEN cast(255 AS double) ELSE cast(1 AS double) END AS d FROM (SELECT max(greatest(x, y, z)) AS m FROM {points}) u1) u2"
SQL["rgb_unpack"] = (
    "SELECT point_idx, (shiftright(u, 16) & 255) / 255.0D AS r, (shiftright(u, 8) & 255) / 255.0D AS g, (u & 255) / 255.0D AS b FROM (SELECT point_idx, point_idx * 7919 % 16777216 AS u FROM {points})",
    "SELECT point_idx, ((u >> 16) & 255) / 255.0::DOUBLE AS r, ((u >> 8) & 255) / 255.0::DOUBLE AS g, (u & 255) / 255.0::DOUBLE AS b FROM (SELECT point_idx, point_idx * 7919 % 16777216 AS u FROM {points})",
)
SQL["intensity_normalize"] = "SELECT point_idx, greatest(cast(0 AS double), least(cast(1 AS double), y / CASE WHEN m > 255 THEN cast(65535 AS double) WHEN m > 1.0001 THEN m ELSE cast(1 AS double) END)) AS intensity FROM {points} p JOIN (SELECT scan_id AS s, max(y) AS m FROM {points} GROUP BY scan_id) t ON p.scan_id = t.s"
SQL["classification_clamp"] = "SELECT point_idx, cast(greatest(0, least(255, floor((classification - 3) * 60.5 + 0.5))) AS int) AS classification FROM {points}"
SQL["elevation_ramp"] = "SELECT point_idx, greatest(cast(0 AS double), least(cast(1 AS double), 1.5 - abs(4 * t - 3))) AS r, greatest(cast(0 AS double), least(cast(1 AS double), 1.5 - abs(4 * t - 2))) AS g, greatest(cast(0 AS double), least(cast(1 AS double), 1.5 - abs(4 * t - 1))) AS b FROM (SELECT point_idx, (z - z0) / CASE WHEN h = 0 THEN cast(1 AS double) ELSE h END AS t FROM {points} CROSS JOIN (SELECT min(z) AS z0, max(z) - min(z) AS h FROM {points}) u1) u2"
SQL["color_to_byte"] = "SELECT point_idx, cast(greatest(0, least(255, floor(x / s * 255 + 0.5))) AS int) AS r, cast(greatest(0, least(255, floor(z / s * 255 + 0.5))) AS int) AS b FROM {points} CROSS JOIN (SELECT CASE WHEN max(x) > 1.0001 THEN cast(255 AS double) ELSE cast(1 AS double) END AS s FROM {points} WHERE point_idx < 300) u1"
SQL["up_axis"] = """SELECT CASE WHEN far > 0 THEN 'z' WHEN dz <= 0.78 * least(dx, dy) THEN 'z' WHEN dy <= 0.78 * least(dx, dz) THEN 'y' WHEN dx <= 0.78 * least(dy, dz) THEN 'x' ELSE 'y' END AS axis
FROM (SELECT max(x) - min(x) AS dx, max(y) - min(y) AS dy, max(z) - min(z) AS dz, sum(CASE WHEN point_idx = 0 AND greatest(abs(x), abs(y), abs(z)) > 10000 THEN 1 ELSE 0 END) AS far FROM {points})"""
SQL["comment_kv"] = (
    r"SELECT page_id, lower(regexp_extract(c, '(?i)^(?:VENDOR_)?([a-z_]+)\\s*[:=]', 1)) AS k, trim(regexp_extract(c, '[:=]\\s*(.*)$', 1)) AS v FROM (SELECT page_id, concat(CASE WHEN page_id % 2 = 0 THEN 'VENDOR_' ELSE '' END, 'CRS = ', url) AS c FROM {html_docs})",
    r"SELECT page_id, lower(regexp_extract(c, '(?i)^(?:VENDOR_)?([a-z_]+)\s*[:=]', 1)) AS k, trim(regexp_extract(c, '[:=]\s*(.*)$', 1)) AS v FROM (SELECT page_id, concat(CASE WHEN page_id % 2 = 0 THEN 'VENDOR_' ELSE '' END, 'CRS = ', url) AS c FROM {html_docs})",
)
SQL["content_sha256"] = ("SELECT doc_id, sha2(text, 256) AS sha FROM {docs}", "SELECT doc_id, sha256(text) AS sha FROM {docs}")
SQL["cache_key_sha1"] = (
    "SELECT page_id, substring(sha1(concat_ws('|', url, cast(length(html) AS string), 'lod')), 1, 16) AS cache_key FROM {html_docs}",
    "SELECT page_id, substring(sha1(concat_ws('|', url, cast(length(html) AS varchar), 'lod')), 1, 16) AS cache_key FROM {html_docs}",
)
SQL["xml_entities"] = "SELECT page_id, replace(replace(replace(replace(replace(s, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&apos;', ''''), '&amp;', '&') AS decoded FROM (SELECT page_id, replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS s FROM {html_docs})".replace("''''", "chr(39)")
SQL["filename_sanitize"] = (
    r"SELECT page_id, substring(regexp_replace(url, '[^\\w.\\-]+', '_'), 1, 120) AS file FROM {html_docs}",
    r"SELECT page_id, substring(regexp_replace(url, '[^\w.\-]+', '_', 'g'), 1, 120) AS file FROM {html_docs}",
)
SQL["url_extension"] = (
    r"SELECT page_id, lower(regexp_extract(url, '\\.([A-Za-z0-9]+)$', 1)) AS ext FROM {html_docs}",
    r"SELECT page_id, lower(regexp_extract(url, '\.([A-Za-z0-9]+)$', 1)) AS ext FROM {html_docs}",
)
SQL["doc_extract_numbers"] = (
    r"SELECT doc_id, size(n) AS numbers, array_join(n, ' ') AS found FROM (SELECT doc_id, regexp_extract_all(text, '[0-9]+(?:[.,][0-9]+)?', 0) AS n FROM {docs})",
    r"SELECT doc_id, CAST(len(n) AS INTEGER) AS numbers, array_to_string(n, ' ') AS found FROM (SELECT doc_id, regexp_extract_all(text, '[0-9]+(?:[.,][0-9]+)?') AS n FROM {docs})",
)
SQL["doc_strip_markup"] = (
    r"SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '</(p|li|h1|div)>', '\n'), '<[^>]+>', ''), '\n{{3,}}', '\n\n') AS text FROM {html_docs}".replace(r"\n", "\\n"),
    r"SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '</(p|li|h1|div)>', chr(10), 'g'), '<[^>]+>', '', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g') AS text FROM {html_docs}",
)
SQL["doc_binary_sniff"] = (
    r"SELECT doc_id, instr(head, chr(0)) > 0 OR length(regexp_replace(head, '[^\\x01-\\x08\\x0e-\\x1f]', '')) >= 0.1 * length(head) AS is_binary FROM (SELECT doc_id, substring(text, 1, 8192) AS head FROM {docs})",
    r"SELECT doc_id, contains(head, chr(0)) OR length(regexp_replace(head, '[^\x01-\x08\x0e-\x1f]', '', 'g')) >= 0.1 * length(head) AS is_binary FROM (SELECT doc_id, substring(text, 1, 8192) AS head FROM {docs})",
)
SQL["polyline_explode"] = "SELECT poly, i, x AS x0, y AS y0, coalesce(lead(x) OVER (PARTITION BY poly ORDER BY i, x, y), first_value(x) OVER (PARTITION BY poly ORDER BY i, x, y)) AS x1, coalesce(lead(y) OVER (PARTITION BY poly ORDER BY i, x, y), first_value(y) OVER (PARTITION BY poly ORDER BY i, x, y)) AS y1 FROM (SELECT l_orderkey AS poly, l_linenumber AS i, x, y FROM {raw_points})"
SQL["ellipse_tessellate"] = (
    "SELECT room_id, k, round(r * cos(2 * pi() * k / 48), 6) AS x, round(r / 2 * sin(2 * pi() * k / 48), 6) AS y FROM (SELECT room_id, abs(area) AS r FROM {rooms}) LATERAL VIEW explode(sequence(0, 48)) e AS k",
    "SELECT room_id, CAST(k AS INTEGER) AS k, round(r * cos(2 * pi() * k / 48), 6) AS x, round(r / 2 * sin(2 * pi() * k / 48), 6) AS y FROM (SELECT room_id, abs(area) AS r FROM {rooms}), range(0, 49) t(k)",
)

# Filters --------------------------------------------------------------------------------------------------------------
SQL["sample_stride"] = "SELECT point_idx, x, y, z FROM {points} WHERE point_idx % 16 = 0"
SQL["finite_filter"] = (
    "SELECT point_idx, v FROM (SELECT point_idx, CASE WHEN point_idx % 7 = 0 THEN double('NaN') WHEN point_idx % 11 = 0 THEN double('Infinity') ELSE x END AS v FROM {points}) WHERE NOT isnan(v) AND abs(v) < double('Infinity')",
    "SELECT point_idx, v FROM (SELECT point_idx, CASE WHEN point_idx % 7 = 0 THEN 'NaN'::DOUBLE WHEN point_idx % 11 = 0 THEN 'Infinity'::DOUBLE ELSE x END AS v FROM {points}) WHERE isfinite(v)",
)
SQL["ptx_valid_returns"] = "SELECT scan_id, point_idx, row_number() OVER (PARTITION BY scan_id ORDER BY point_idx) - 1 AS valid_idx FROM {points} WHERE NOT (z = 0 AND classification = 1)"
SQL["text_row_filter"] = (
    r"SELECT doc_id, line RLIKE '^\\s*[-+]?(\\d|\\.\\d)' AS is_row, line LIKE '#%' AS is_comment FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN concat(cast(n_chars AS string), ' 1 2') WHEN doc_id % 3 = 1 THEN concat('# ', name) ELSE text END AS line FROM {docs})",
    r"SELECT doc_id, regexp_matches(line, '^\s*[-+]?(\d|\.\d)') AS is_row, line LIKE '#%' AS is_comment FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN concat(cast(n_chars AS varchar), ' 1 2') WHEN doc_id % 3 = 1 THEN concat('# ', name) ELSE text END AS line FROM {docs})",
)
SQL["ext_allowlist"] = "SELECT page_id, url FROM {html_docs} WHERE url LIKE '%.html' OR url LIKE '%.htm' OR url LIKE '%.txt'"
SQL["findings_escalate"] = "SELECT element_id, kind, part_id FROM {findings} WHERE severity = 'warn' AND review = 'open'"
SQL["frame_gate"] = "SELECT scan_id, CASE WHEN scan_id = 3 THEN 'error' WHEN scan_id = 2 OR mx IS NULL THEN 'confirm' ELSE 'ok' END AS gate FROM (SELECT scan_id, max(x) AS mx FROM {points} GROUP BY scan_id)"
SQL["section_slab"] = "SELECT point_idx, x, y, z FROM {points} WHERE y BETWEEN 25 - 0.5 AND 25 + 0.5"
SQL["section_box"] = "SELECT point_idx FROM {points} WHERE x BETWEEN 10 AND 40 AND y BETWEEN 10 AND 40 AND z BETWEEN 2 AND 8"
SQL["select_box"] = "SELECT point_idx, scan_id FROM {points} WHERE abs(x - 30) <= 10 AND abs(y - 25) <= 5 AND abs(z - 5) <= 2"
SQL["select_sphere"] = "SELECT point_idx FROM {points} WHERE (x - 30) * (x - 30) + (y - 25) * (y - 25) + (z - 5) * (z - 5) <= 100"
SQL["select_color"] = "SELECT point_idx FROM {points} WHERE abs(x / 100 - 0.4) <= 0.1 AND abs(y / 50 - 0.5) <= 0.1 AND abs(z / 10 - 0.5) <= 0.2"
# Crossings of a ray along +x with the edges of a fixed quadrilateral, odd means inside.
_EDGES = [((10, 5), (60, 10)), ((60, 10), (50, 40)), ((50, 40), (20, 45)), ((20, 45), (10, 5))]
_CROSS = " + ".join(f"CASE WHEN ({a[1]} > y) <> ({b[1]} > y) AND x < cast({b[0] - a[0]} AS double) * (y - {a[1]}) / {b[1] - a[1]} + {a[0]} THEN 1 ELSE 0 END" for a, b in _EDGES)
SQL["select_polygon"] = f"SELECT point_idx FROM {{points}} WHERE ({_CROSS}) % 2 = 1"
SQL["plane_protect"] = "SELECT s.point_idx FROM (SELECT point_idx FROM {points} WHERE x < 30) s LEFT ANTI JOIN (SELECT point_idx FROM {points} WHERE abs(z - 5) < 0.5) p ON s.point_idx = p.point_idx", "SELECT s.point_idx FROM (SELECT point_idx FROM {points} WHERE x < 30) s ANTI JOIN (SELECT point_idx FROM {points} WHERE abs(z - 5) < 0.5) p ON s.point_idx = p.point_idx"
SQL["depth_gap_front"] = "SELECT scan_id, point_idx, x FROM (SELECT *, sum(CASE WHEN x - prev > 0.02 THEN 1 ELSE 0 END) OVER (PARTITION BY scan_id, classification ORDER BY x, point_idx ROWS UNBOUNDED PRECEDING) AS gap_no FROM (SELECT scan_id, classification, point_idx, x, lag(x) OVER (PARTITION BY scan_id, classification ORDER BY x, point_idx) AS prev FROM {points}) u1) u2 WHERE gap_no = 0"
SQL["selection_invert"] = "SELECT point_idx FROM {points} WHERE NOT (x BETWEEN 10 AND 40 AND y < 30)"
SQL["prune_outliers"] = "SELECT point_idx FROM {points} CROSS JOIN (SELECT avg(x) AS cx, avg(y) AS cy, avg(z) AS cz FROM {points}) c CROSS JOIN (SELECT stddev_pop(x) AS r FROM {points}) s WHERE round(sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy) + (z - cz) * (z - cz)) - 2.5 * r, 6) <= 0"

# Joins ----------------------------------------------------------------------------------------------------------------
_IFC = "(SELECT concat('G', cast(l_orderkey AS varchar(20))) AS ifc_guid, max(l_partkey) AS part_id FROM (SELECT l_orderkey + CASE WHEN l_partkey % 10 = 0 THEN 10000000 ELSE 0 END AS l_orderkey, l_partkey FROM {raw_points}) u0 GROUP BY l_orderkey)"
SQL["ifc_link_matched"] = f"SELECT e.element_id, i.ifc_guid, i.part_id FROM {_IFC} i JOIN {{elements}} e ON i.ifc_guid = e.ifc_guid"
SQL["ifc_link_created"] = f"SELECT i.ifc_guid, i.part_id FROM {_IFC} i LEFT ANTI JOIN {{elements}} e ON i.ifc_guid = e.ifc_guid", f"SELECT i.ifc_guid, i.part_id FROM {_IFC} i ANTI JOIN {{elements}} e ON i.ifc_guid = e.ifc_guid"
SQL["find_or_create"] = "SELECT s.name, coalesce(f.floor_id, -1) AS floor_id FROM (SELECT DISTINCT CASE WHEN kind = 'BUILDING' THEN 'Storey 1' ELSE concat('Storey ', kind) END AS name FROM {rooms}) s LEFT JOIN {floors} f ON s.name = f.name"
SQL["container_coalesce"] = "SELECT e.element_id, coalesce(r.room_id, rep.room_id, 0) AS room_id FROM {elements} e LEFT JOIN (SELECT room_id, floor_id FROM {rooms} WHERE room_id % 4 <> 0) r ON e.room_id = r.room_id LEFT JOIN (SELECT floor_id, min(room_id) AS room_id FROM {rooms} GROUP BY floor_id) rep ON e.element_id % 30 = rep.floor_id"
SQL["findings_carry_over"] = "SELECT n.element_id, n.kind, n.part_id, o.review FROM (SELECT element_id, kind, part_id FROM {findings} WHERE severity = 'err') n LEFT JOIN (SELECT element_id, kind, review FROM (SELECT *, row_number() OVER (PARTITION BY element_id, kind ORDER BY created_at, part_id, weight) AS rn FROM {findings} WHERE severity <> 'err') u WHERE rn = 1) o ON n.element_id = o.element_id AND n.kind = o.kind"
SQL["semi_join_docs"] = "SELECT r.room_id, r.name FROM {rooms} r LEFT SEMI JOIN {docs} d ON r.room_id = d.room_id", "SELECT r.room_id, r.name FROM {rooms} r SEMI JOIN {docs} d ON r.room_id = d.room_id"
SQL["registered_file_semi"] = "SELECT page_id, url FROM {html_docs} h WHERE concat('src', cast(page_id % 60 AS varchar(9))) IN (SELECT name FROM {docs} WHERE is_upload UNION SELECT kind FROM {rooms})"
SQL["room_assembly"] = (
    "SELECT r.room_id, coalesce(array_join(e.ids, ','), '') AS elements, coalesce(d.n, 0) AS docs FROM {rooms} r LEFT JOIN (SELECT room_id, sort_array(collect_list(element_id)) AS ids FROM {elements} GROUP BY room_id) e ON r.room_id = e.room_id LEFT JOIN (SELECT room_id, count(*) AS n FROM {docs} GROUP BY room_id) d ON r.room_id = d.room_id",
    "SELECT r.room_id, coalesce(e.ids, '') AS elements, coalesce(d.n, 0) AS docs FROM {rooms} r LEFT JOIN (SELECT room_id, string_agg(CAST(element_id AS VARCHAR), ',' ORDER BY element_id) AS ids FROM {elements} GROUP BY room_id) e ON r.room_id = e.room_id LEFT JOIN (SELECT room_id, count(*) AS n FROM {docs} GROUP BY room_id) d ON r.room_id = d.room_id",
)
SQL["coverage_anti"] = "SELECT e.element_id, e.room_id FROM {elements} e LEFT ANTI JOIN {docs} d ON e.room_id = d.room_id", "SELECT e.element_id, e.room_id FROM {elements} e ANTI JOIN {docs} d ON e.room_id = d.room_id"
SQL["null_safe_join"] = (
    "SELECT a.doc_id, b.n FROM {docs} a JOIN (SELECT room_id, name, element_id, count(*) AS n FROM {docs} WHERE is_upload GROUP BY room_id, name, element_id) b ON a.room_id = b.room_id AND a.name = b.name AND a.element_id <=> b.element_id",
    "SELECT a.doc_id, b.n FROM {docs} a JOIN (SELECT room_id, name, element_id, count(*) AS n FROM {docs} WHERE is_upload GROUP BY room_id, name, element_id) b ON a.room_id = b.room_id AND a.name = b.name AND a.element_id IS NOT DISTINCT FROM b.element_id",
)
SQL["upsert_by_key"] = "SELECT coalesce(n.cloud_id, o.cloud_id) AS cloud_id, coalesce(n.labels, o.labels) AS labels, coalesce(o.revision, 0) + CASE WHEN n.cloud_id IS NULL THEN 0 ELSE 1 END AS revision FROM (SELECT part_id AS cloud_id, count(*) AS labels, 3 AS revision FROM {findings} WHERE part_id % 2 = 0 GROUP BY part_id) o FULL OUTER JOIN (SELECT part_id AS cloud_id, max(kind) AS labels FROM {findings} WHERE part_id % 3 = 0 GROUP BY part_id) n ON o.cloud_id = n.cloud_id"
SQL["snapshot_diff"] = "SELECT n.project, n.last, CASE WHEN o.project IS NULL THEN 'new' ELSE 'newer' END AS change FROM (SELECT project, max(event_id) AS last FROM {operations} GROUP BY project) n LEFT JOIN (SELECT project, max(event_id) AS last FROM {operations} WHERE event_id % 5 < 2 GROUP BY project) o ON n.project = o.project WHERE o.project IS NULL OR n.last > o.last"
SQL["rule_cross"] = "SELECT e.element_id, r.rule, CASE WHEN e.cost > r.bound THEN 'warn' ELSE 'ok' END AS result FROM {elements} e CROSS JOIN (SELECT 'cheap' AS rule, 50000.0 AS bound UNION ALL SELECT 'dear', 200000.0) r"
SQL["sync_merge_latest"] = "SELECT room_id, name, src FROM (SELECT *, row_number() OVER (PARTITION BY room_id ORDER BY src DESC) AS rn FROM (SELECT room_id, name, 1 AS src FROM {rooms} UNION ALL SELECT room_id, concat(name, ' (copy)') AS name, 2 AS src FROM {rooms} WHERE room_id % 3 = 0) u1) u2 WHERE rn = 1"

# Aggregates -----------------------------------------------------------------------------------------------------------
SQL["bbox"] = "SELECT scan_id, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, min(z) AS z0, max(z) AS z1, (min(x) + max(x)) / 2 AS cx, max(x) - min(x) AS w FROM {points} GROUP BY scan_id"
SQL["scan_counts"] = "SELECT scan_id, count(*) AS n, count(CASE WHEN z <> 0 THEN 1 END) AS valid FROM {points} GROUP BY scan_id"
SQL["findings_counts"] = "SELECT e.room_id, count(CASE WHEN f.severity = 'err' THEN 1 END) AS err, count(CASE WHEN f.severity = 'warn' THEN 1 END) AS warn, count(CASE WHEN f.severity = 'ok' THEN 1 END) AS ok FROM {findings} f JOIN {elements} e ON f.element_id = e.element_id GROUP BY e.room_id"
SQL["findings_rollup"] = "SELECT f.kind, f.severity, count(*) AS n FROM {findings} f GROUP BY ROLLUP (f.kind, f.severity)"
SQL["findings_report"] = "SELECT r.floor_id, f.severity, count(*) AS n, min(f.created_at) AS first_at, round(sum(f.weight), 2) AS weight FROM {findings} f JOIN {elements} e ON f.element_id = e.element_id JOIN {rooms} r ON e.room_id = r.room_id GROUP BY r.floor_id, f.severity"
SQL["strided_stats"] = "SELECT min(x) AS x0, max(x) AS x1, round(avg(x), 6) AS xa, min(y) AS y0, max(y) AS y1, round(avg(y), 6) AS ya, count(*) AS n FROM {points} WHERE point_idx % 37 = 0"
SQL["robust_bounds"] = "SELECT max(CASE WHEN d <= 2.5 * r THEN x END) AS robust_x1, max(x) AS x1, max(CASE WHEN d <= 2.5 * r THEN y END) AS robust_y1, max(y) AS y1 FROM (SELECT p.x, p.y, round(sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy)), 6) AS d, round(r, 6) AS r FROM {points} p CROSS JOIN (SELECT avg(x) AS cx, avg(y) AS cy, stddev_pop(x) AS r FROM {points}) c) u"
SQL["next_version"] = (
    "SELECT room_id, name, max(cast(regexp_replace(version, '[^0-9]', '') AS int)) + 1 AS next_version FROM {docs} GROUP BY room_id, name",
    "SELECT room_id, name, max(cast(regexp_replace(version, '[^0-9]', '', 'g') AS int)) + 1 AS next_version FROM {docs} GROUP BY room_id, name",
)
SQL["class_histogram"] = "SELECT scan_id, classification, count(*) AS n FROM {points} GROUP BY scan_id, classification"
_VOX = "cast(floor(x / 2) AS bigint) AS vx, cast(floor(y / 5) AS bigint) AS vy, cast(floor(z / 2) AS bigint) AS vz"
SQL["voxel_density_clean"] = f"SELECT point_idx FROM (SELECT point_idx, count(*) OVER (PARTITION BY vx, vy, vz) AS n FROM (SELECT point_idx, {_VOX} FROM {{points}}) u1) u2 WHERE n >= 8"
SQL["voxel_downsample"] = f"SELECT vx, vy, vz, min(point_idx) AS first_idx, sum(cast(round(x * 100000) AS bigint)) / cast(count(*) AS double) / 100000 AS x, sum(cast(round(y * 100000) AS bigint)) / cast(count(*) AS double) / 100000 AS y, sum(cast(round(z * 100000) AS bigint)) / cast(count(*) AS double) / 100000 AS z, count(*) AS n FROM (SELECT point_idx, x, y, z, {_VOX} FROM {{points}}) u GROUP BY vx, vy, vz"
SQL["octree_node_counts"] = "SELECT lvl, cast(floor(x / 128 * p) AS bigint) AS i, cast(floor(y / 128 * p) AS bigint) AS j, cast(floor(z / 128 * p) AS bigint) AS k, count(*) AS n FROM {points} CROSS JOIN (SELECT 1 AS lvl, 2 AS p UNION ALL SELECT 2, 4 UNION ALL SELECT 3, 8 UNION ALL SELECT 4, 16) l GROUP BY lvl, cast(floor(x / 128 * p) AS bigint), cast(floor(y / 128 * p) AS bigint), cast(floor(z / 128 * p) AS bigint)"
SQL["plane_inliers"] = "SELECT plane, count(*) AS inliers FROM (SELECT pl.plane, abs(pl.a * x + pl.b * y + pl.c * z - pl.d) / sqrt(pl.a * pl.a + pl.b * pl.b + pl.c * pl.c) AS dist FROM {points} CROSS JOIN (SELECT 0 AS plane, 0.0 AS a, 0.0 AS b, 1.0 AS c, 5.0 AS d UNION ALL SELECT 1, 1.0, 0.0, 0.0, 30.0 UNION ALL SELECT 2, 1.0, 1.0, 0.0, 60.0 UNION ALL SELECT 3, 0.0, 1.0, 0.0, 25.0) pl) u WHERE dist <= 0.25 GROUP BY plane"
SQL["dsm_grid"] = "SELECT cast(floor(x / 0.5) AS bigint) AS i, cast(floor(y / 0.5) AS bigint) AS j, max(z) AS z FROM {points} GROUP BY cast(floor(x / 0.5) AS bigint), cast(floor(y / 0.5) AS bigint)"
SQL["dtm_grid"] = "SELECT cast(floor(x / 0.5) AS bigint) AS i, cast(floor(y / 0.5) AS bigint) AS j, min(z) AS z, count(*) AS n FROM {points} WHERE classification = 2 GROUP BY cast(floor(x / 0.5) AS bigint), cast(floor(y / 0.5) AS bigint)"
_GRID = "(SELECT cast(floor(x / 5) AS bigint) AS i, cast(floor(y / 5) AS bigint) AS j, round(avg(z), 6) AS h FROM {points} GROUP BY cast(floor(x / 5) AS bigint), cast(floor(y / 5) AS bigint))"
# A level crosses the cell edge from (i, j) to its right or upper neighbour: one end of a contour segment.
SQL["contour_segments"] = f"SELECT level, i, j, dir, round((level - h) / (h2 - h), 4) AS t FROM (SELECT a.i, a.j, d.dir, a.h, b.h AS h2 FROM {_GRID} a CROSS JOIN (SELECT 0 AS dir, 1 AS di, 0 AS dj UNION ALL SELECT 1, 0, 1) d JOIN {_GRID} b ON b.i = a.i + d.di AND b.j = a.j + d.dj) e CROSS JOIN (SELECT cast(4.5 AS double) AS level UNION ALL SELECT 5.0 UNION ALL SELECT 5.5) l WHERE (h < level AND h2 >= level) OR (h >= level AND h2 < level)"
SQL["section_occupancy"] = "SELECT DISTINCT cast(floor(x / 0.25) AS bigint) AS i, cast(floor(z / 0.25) AS bigint) AS j FROM {points} WHERE abs(y - 25) <= 1"
SQL["profile_station"] = "SELECT point_idx, round(x * cos(0.6) + y * sin(0.6), 9) AS station, z AS elevation FROM {points} WHERE abs(-x * sin(0.6) + y * cos(0.6)) <= 2"
# Triangles are three successive points of a scan; each edge that straddles z = 5 gives one end of the cut.
SQL["mesh_plane_segments"] = "SELECT tri, e, round(xa + (5 - za) / (zb - za) * (xb - xa), 9) AS x, round(ya + (5 - za) / (zb - za) * (yb - ya), 9) AS y FROM (SELECT tri, 0 AS e, x0 AS xa, y0 AS ya, z0 AS za, x1 AS xb, y1 AS yb, z1 AS zb FROM {t} UNION ALL SELECT tri, 1, x1, y1, z1, x2, y2, z2 FROM {t} UNION ALL SELECT tri, 2, x2, y2, z2, x0, y0, z0 FROM {t}) u WHERE (za < 5 AND zb >= 5) OR (za >= 5 AND zb < 5)".replace("{t}", "(SELECT cast(floor(point_idx / 3) AS bigint) AS tri, max(CASE WHEN point_idx % 3 = 0 THEN x END) AS x0, max(CASE WHEN point_idx % 3 = 0 THEN y END) AS y0, max(CASE WHEN point_idx % 3 = 0 THEN z END) AS z0, max(CASE WHEN point_idx % 3 = 1 THEN x END) AS x1, max(CASE WHEN point_idx % 3 = 1 THEN y END) AS y1, max(CASE WHEN point_idx % 3 = 1 THEN z END) AS z1, max(CASE WHEN point_idx % 3 = 2 THEN x END) AS x2, max(CASE WHEN point_idx % 3 = 2 THEN y END) AS y2, max(CASE WHEN point_idx % 3 = 2 THEN z END) AS z2 FROM {points} GROUP BY cast(floor(point_idx / 3) AS bigint))")
SQL["line_fit_rms"] = "SELECT scan_id, classification, n, round(sqrt(greatest(cast(0 AS double), (sxx + syy - sqrt((sxx - syy) * (sxx - syy) + 4 * sxy * sxy)) / 2)), 4) AS rms FROM (SELECT scan_id, classification, count(*) AS n, covar_pop(x, x) AS sxx, covar_pop(y, y) AS syy, covar_pop(x, y) AS sxy FROM {points} GROUP BY scan_id, classification) u"
_OCC = "(SELECT DISTINCT cast(floor(x / 2) AS bigint) AS i, cast(floor(y / 2) AS bigint) AS j FROM {points} WHERE abs(z - 5) < 0.05 AND classification = 1)"
_HOLE = f"SELECT i, j, count(*) AS neighbours FROM (SELECT o.i + d.di AS i, o.j + d.dj AS j FROM {_OCC} o CROSS JOIN (SELECT -1 AS di, 0 AS dj UNION ALL SELECT 1, 0 UNION ALL SELECT 0, -1 UNION ALL SELECT 0, 1) d) n WHERE NOT EXISTS (SELECT 1 FROM {_OCC} p WHERE p.i = n.i AND p.j = n.j) GROUP BY i, j HAVING count(*) >= 3"
SQL["hole_fill_cells"] = _HOLE
SQL["distinct_check"] = "SELECT count(*) AS n, count(DISTINCT element_id) AS elements, count(DISTINCT kind) AS kinds, count(DISTINCT part_id) AS parts FROM {findings}"

# Windows, order, sets, nested values, streams ---------------------------------------------------------------------------
SQL["scan_offsets"] = "SELECT scan_id, n, cast(coalesce(sum(n) OVER (ORDER BY scan_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bigint) AS first_idx FROM (SELECT scan_id, count(*) AS n FROM {points} GROUP BY scan_id) u"
SQL["prefix_offsets"] = "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, cast(coalesce(sum(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber, l_shipdate, l_extendedprice ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bigint) AS byte_offset FROM {raw_points}"
SQL["latest_per_key"] = "SELECT project, event_id, operation FROM (SELECT *, row_number() OVER (PARTITION BY project ORDER BY event_id DESC) AS rn FROM {operations}) u WHERE rn = 1"
SQL["revision_undo_redo"] = "SELECT project, event_id, lag(event_id) OVER (PARTITION BY project ORDER BY event_id) AS undo_to, lead(event_id) OVER (PARTITION BY project ORDER BY event_id) AS redo_to FROM {operations}"
SQL["version_history"] = "SELECT doc_id, room_id, dense_rank() OVER (PARTITION BY room_id, name ORDER BY version) AS rev FROM {docs}"
SQL["representative_room"] = "SELECT DISTINCT floor_id, first_value(room_id) OVER (PARTITION BY floor_id ORDER BY room_id) AS room_id FROM {rooms}"
SQL["topk_per_group"] = "SELECT project, event_id FROM (SELECT project, event_id, row_number() OVER (PARTITION BY project ORDER BY event_id DESC) AS rn FROM {operations}) u WHERE rn <= 8"
SQL["newest_row"] = "SELECT event_id, project, operation FROM {operations} ORDER BY event_id DESC LIMIT 1"
SQL["ops_recent"] = "SELECT event_id, project, operation FROM {operations} ORDER BY event_id DESC LIMIT 50"
SQL["union_scans"] = "SELECT point_idx, scan_id, x FROM {points} WHERE scan_id = 0 UNION ALL SELECT point_idx, scan_id, x FROM {points} WHERE scan_id = 2"
SQL["selection_except"] = "SELECT point_idx FROM {points} WHERE x < 40 EXCEPT SELECT point_idx FROM {points} WHERE z > 5"
SQL["selection_intersect"] = "SELECT point_idx FROM {points} WHERE x < 40 INTERSECT SELECT point_idx FROM {points} WHERE z > 5"
SQL["undo_union"] = "SELECT point_idx, x FROM {points} WHERE x < 40 UNION ALL SELECT point_idx, x FROM {points} WHERE NOT x < 40"
SQL["array_append_unique"] = (
    "SELECT doc_id, array_join(CASE WHEN array_contains(v, version) THEN v ELSE array_append(v, version) END, ',') AS versions FROM (SELECT doc_id, version, array('v1', 'v3') AS v FROM {docs})",
    "SELECT doc_id, array_to_string(CASE WHEN list_contains(v, version) THEN v ELSE list_append(v, version) END, ',') AS versions FROM (SELECT doc_id, version, ['v1', 'v3'] AS v FROM {docs})",
)
SQL["json_props"] = (
    "SELECT event_id, cast(get_json_object(parameters, '$.k') AS int) AS k FROM {operations}",
    "SELECT event_id, CAST(json_extract_string(parameters, '$.k') AS INTEGER) AS k FROM {operations}",
)
SQL["explode_elements"] = (
    "SELECT room_id, pos, id FROM (SELECT room_id, sort_array(collect_list(element_id)) AS ids FROM {elements} GROUP BY room_id) LATERAL VIEW posexplode(ids) e AS pos, id",
    "SELECT room_id, CAST(row_number() OVER (PARTITION BY room_id ORDER BY element_id) - 1 AS INTEGER) AS pos, element_id AS id FROM {elements}",
)
SQL["date_trunc_day"] = ("SELECT element_id, date_format(created, 'yyyy-MM-dd') AS day FROM {elements}", "SELECT element_id, strftime(created, '%Y-%m-%d') AS day FROM {elements}")
SQL["ops_by_day"] = ("SELECT date_format(ts, 'yyyy-MM-dd') AS day, operation, count(*) AS n FROM {operations} GROUP BY 1, 2", "SELECT strftime(ts, '%Y-%m-%d') AS day, operation, count(*) AS n FROM {operations} GROUP BY 1, 2")
SQL["events_tumbling"] = (
    "SELECT window(ts, '1 hour').start AS start_ts, operation, count(*) AS n, round(sum(value), 4) AS total FROM {operations} GROUP BY window(ts, '1 hour'), operation",
    "SELECT time_bucket(INTERVAL '1 hour', ts) AS start_ts, operation, count(*) AS n, round(sum(value), 4) AS total FROM {operations} GROUP BY 1, 2",
)
SQL["events_session"] = (
    "SELECT project, session_window(ts, '30 minutes').start AS start_ts, count(*) AS n FROM {operations} GROUP BY project, session_window(ts, '30 minutes')",
    "SELECT project, min(ts) AS start_ts, count(*) AS n FROM (SELECT *, sum(CASE WHEN ts - prev < INTERVAL '30 minutes' THEN 0 ELSE 1 END) OVER (PARTITION BY project ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT *, lag(ts) OVER (PARTITION BY project ORDER BY ts, event_id) AS prev FROM {operations}) u1) u2 GROUP BY project, s",
)
