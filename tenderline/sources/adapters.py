"""Domain tables derived from the given tables.

Each entry is a SELECT that Spark SQL and other engines read alike; {name} stands for a given table or for another
entry. `domain()` gives the DataFrame, `ctes()` the same tables as WITH clauses for an oracle.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from tenderline.sources import scratch

GIVEN = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

TABLES: dict[str, str] = {
    # order lines, one row for each (order, line): the given table repeats some of these pairs
    "orderlines": "SELECT l_orderkey, l_linenumber, max(l_partkey) AS l_partkey, max(l_suppkey) AS l_suppkey, max(l_quantity) AS l_quantity, max(l_extendedprice) AS l_extendedprice, max(l_discount) AS l_discount, max(l_tax) AS l_tax, max(l_returnflag) AS l_returnflag, max(l_shipdate) AS l_shipdate FROM {lineitem} GROUP BY l_orderkey, l_linenumber",
    # plants, work centres, services and materials: one row each per nation, supplier group and brand digit
    "plants": "SELECT CASE n_nationkey WHEN 0 THEN 'DE' WHEN 1 THEN 'PL' ELSE 'CN' END AS code, 0.13 - 0.02 * n_nationkey AS overhead_pct, 0.01 * n_nationkey AS logistics_pct, 4 + 2 * n_nationkey AS base_weeks, n_nationkey AS ord FROM {nation} WHERE n_nationkey < 3",
    "centres": "SELECT w.code, p.code AS plant, (60.0 + 7 * w.k) * (1.0 - 0.2 * p.ord) AS rate_eur_h FROM (SELECT DISTINCT s_suppkey % 7 AS k, 'WC' || CAST(s_suppkey % 7 AS VARCHAR(4)) AS code FROM {supplier}) w CROSS JOIN {plants} p WHERE NOT (w.k = 5 AND p.code = 'CN')",
    "services": "SELECT DISTINCT 'SV' || CAST(s_suppkey % 3 AS VARCHAR(4)) AS code, 1.5 + 0.5 * (s_suppkey % 3) AS price_eur_kg, 80.0 + 20 * (s_suppkey % 3) AS lot_min_eur FROM {supplier}",
    "materials": "SELECT DISTINCT 'M' || CAST(p_partkey % 6 AS VARCHAR(4)) AS code, CASE WHEN p_partkey % 6 < 3 THEN 'steel' WHEN p_partkey % 6 < 5 THEN 'aluminium' ELSE 'cast_iron' END AS mat_group, CASE WHEN p_partkey % 6 < 3 THEN 7.85 WHEN p_partkey % 6 < 5 THEN 2.7 ELSE 7.2 END AS density, 1.2 + 0.6 * (p_partkey % 6) AS price_eur_kg, 0.8 + 0.1 * (p_partkey % 6) AS machinability FROM {part}",
    "parts": """SELECT p_partkey AS part_id, p_name AS title, p_type AS family, CASE WHEN p_size % 3 = 0 THEN 'rotational' WHEN p_size % 3 = 1 THEN 'prismatic' ELSE 'assembly' END AS shape_class,
        CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE 'M' || CAST(p_partkey % 6 AS VARCHAR(4)) END AS material_code,
        CASE WHEN p_partkey % 13 = 0 THEN 0.0 ELSE 5.0 + p_size * 3 END AS main_mm, 20.0 + p_partkey % 97 AS length_mm, 10.0 + p_size * 2 AS width_mm, 5.0 + p_partkey % 41 AS height_mm,
        CAST(p_partkey % 5 AS INT) AS n_holes, CAST(p_partkey % 4 AS INT) AS n_threads, p_partkey % 7 = 0 AS has_keyway, p_partkey % 9 = 0 AS has_gear, p_partkey % 8 = 0 AS has_heat, p_partkey % 6 = 1 AS has_surface,
        CASE WHEN p_partkey % 10 = 3 THEN NULL ELSE CAST(5 + p_partkey % 8 AS INT) END AS min_it, p_retailprice AS list_price FROM {part}""",
    # work done on a part: its first lines by order
    "features": """SELECT l_partkey AS part_id, l_orderkey * 8 + l_linenumber AS fid,
        CASE (l_orderkey + l_linenumber) % 12 WHEN 0 THEN 'outer_diameter' WHEN 1 THEN 'outer_diameter' WHEN 2 THEN 'bore' WHEN 3 THEN 'hole' WHEN 4 THEN 'thread' WHEN 5 THEN 'keyway' WHEN 6 THEN 'groove' WHEN 7 THEN 'pocket' WHEN 8 THEN 'slot' WHEN 9 THEN 'wall' WHEN 10 THEN 'chamfer' ELSE 'gear' END AS ftype,
        CAST(l_quantity AS DOUBLE) AS nominal, CASE WHEN l_linenumber = 4 THEN NULL ELSE CAST(l_extendedprice AS DOUBLE) / 1000 END AS len_mm, CAST(1 + l_suppkey % 4 AS INT) AS qty, CASE WHEN l_suppkey % 9 = 4 THEN NULL ELSE CAST(l_tax AS DOUBLE) END AS band,
        CASE WHEN l_linenumber % 3 = 0 THEN CAST(5 + l_suppkey % 8 AS INT) END AS it_grade, CASE WHEN l_suppkey % 5 = 0 THEN 0.4 WHEN l_suppkey % 5 = 1 THEN 0.8 END AS ra_um, CAST(l_discount AS DOUBLE) AS radius,
        CASE (l_suppkey + l_linenumber) % 6 WHEN 0 THEN 'H7/g6' WHEN 1 THEN 'h8' WHEN 2 THEN 'JS6' WHEN 3 THEN 'H9' END AS fit,
        CASE WHEN l_suppkey % 3 = 0 THEN NULL ELSE CAST(15 + 3 * l_linenumber AS INT) END AS teeth, CASE WHEN l_suppkey % 4 = 0 THEN NULL ELSE 1.5 END AS module FROM {orderlines}""",
    # what else is printed on a drawing: treatments, notes, general tolerance and the material's text
    "specs": """SELECT p_partkey AS part_id, CASE p_partkey % 9 WHEN 0 THEN 'Case hardened 58 HRC' WHEN 1 THEN 'quenched and tempered' WHEN 2 THEN 'hardened 60 HRC' WHEN 3 THEN 'nitrided' WHEN 4 THEN '' END AS heat_treatment,
        CASE p_partkey % 7 WHEN 0 THEN 'anodised' WHEN 1 THEN 'Zinc plated' WHEN 2 THEN 'black oxide' WHEN 3 THEN 'painted' END AS surface_treatment, CASE WHEN p_partkey % 12 = 1 THEN 'Milled 5-AXIS' WHEN p_partkey % 12 = 4 THEN 'sharp corners' ELSE p_name END AS notes,
        CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE 'ISO 2768-mK' END AS general_tolerance, CASE p_partkey % 14 WHEN 3 THEN 0.4 WHEN 5 THEN 3.2 END AS default_ra, CASE WHEN p_partkey % 22 = 0 THEN ' ' WHEN p_partkey % 11 = 0 THEN 'special alloy' ELSE 'M' || CAST(p_partkey % 6 AS VARCHAR(4)) END AS material_text FROM {part} WHERE p_partkey % 37 <> 5""",
    "bom": "SELECT l_partkey AS part_id, l_orderkey * 8 + l_linenumber AS item_no, CAST(l_quantity AS INT) AS qty, CASE l_linenumber % 4 WHEN 0 THEN 'Cylinder head screw M' || CAST(3 + l_suppkey % 17 AS VARCHAR(4)) || ' x 20' WHEN 1 THEN 'Housing cover' WHEN 2 THEN 'Shaft' ELSE 'Plate' END AS description, CASE WHEN l_linenumber % 5 = 0 THEN 'ISO 7089' END AS standard, CASE WHEN l_suppkey % 4 = 1 THEN 'PT-' || CAST(l_partkey + 1 AS VARCHAR(12)) WHEN l_suppkey % 8 = 6 THEN NULL ELSE 'PN-' || CAST(l_suppkey AS VARCHAR(12)) END AS part_number FROM {orderlines} WHERE l_partkey % 4 <> 0",
    # standard parts: a number, and the tokens (cut by |) that tell the part in a text
    "catalog": "SELECT s_suppkey AS ord, 'PN-' || CAST(s_suppkey AS VARCHAR(12)) AS part_number, CAST(s_acctbal AS DOUBLE) AS unit_price, CASE s_suppkey % 4 WHEN 3 THEN 'ISO 7089|plate' WHEN 1 THEN 'cover|PT-' || CAST(s_suppkey % 10 AS VARCHAR(4)) ELSE 'screw|M' || CAST(3 + s_suppkey % 17 AS VARCHAR(4)) || 'x20' END AS tokens FROM {supplier} WHERE s_suppkey % 3 = 0",
    "part_numbers": "SELECT p_partkey AS part_id, 'PT-' || CAST(p_partkey AS VARCHAR(12)) AS part_number FROM {part} WHERE p_partkey % 6 <> 5",
    "material_keys": "SELECT code, code AS key, 10 * machinability AS ordinal FROM {materials} UNION ALL SELECT code, mat_group || ' ' || code AS key, 100 + machinability AS ordinal FROM {materials}",
    # material texts as written on drawings
    "callouts": "SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN 'm' || CAST(p_partkey % 7 AS VARCHAR(4)) WHEN 1 THEN 'Bar of Steel-M' || CAST(p_partkey % 4 AS VARCHAR(4)) || ', rolled' WHEN 2 THEN 'cast' WHEN 3 THEN 'aluminium M.' || CAST(3 + p_partkey % 2 AS VARCHAR(4)) ELSE p_name END AS text FROM {part}",
    "requests": "SELECT o_orderkey AS rfq_id, CAST(o_orderdate AS DATE) AS issued FROM {orders}",
    "quotes": "SELECT o_custkey AS rfq_id, o_orderkey % 5 + 1 AS version FROM {orders}",
    "part_costs": "SELECT l_partkey AS part_id, CASE l_suppkey % 3 WHEN 0 THEN 'DE' WHEN 1 THEN 'PL' ELSE 'CN' END AS plant, CAST(CASE WHEN l_quantity >= 48 THEN 200 ELSE l_quantity END AS INT) AS qty, avg(l_extendedprice / l_quantity) AS unit_cost FROM {lineitem} WHERE l_partkey % 19 <> 3 GROUP BY 1, 2, 3",
    "history": "SELECT l_partkey AS part_id, CASE l_suppkey % 3 WHEN 0 THEN 'DE' WHEN 1 THEN 'PL' ELSE 'CN' END AS plant, CAST(CASE WHEN l_quantity >= 48 THEN 200 ELSE l_quantity END AS INT) AS qty, l_extendedprice * (1 - l_discount) / l_quantity AS unit_price, l_orderkey * 8 + l_linenumber AS quote_no FROM {orderlines}",
    # requested lines: order lines, with the quantity asked and a due date
    "items": "SELECT l_orderkey AS rfq_id, l_linenumber AS line_no, l_partkey AS part_id, CASE WHEN l_partkey % 23 = 0 AND l_linenumber = 2 THEN 0 ELSE CAST(l_quantity AS INT) END AS qty, CAST(l_shipdate AS DATE) AS due FROM {orderlines}",
    # operations of a line: two in-house or outsourced steps for each
    "ops": """SELECT rfq_id, line_no, 10 * k AS seq, CASE WHEN (rfq_id + line_no + k) % 6 = 0 THEN NULL ELSE 'WC' || CAST((rfq_id + k) % 7 AS VARCHAR(4)) END AS centre,
        CASE WHEN (rfq_id + line_no + k) % 6 = 0 THEN 'SV' || CAST(line_no % 3 AS VARCHAR(4)) END AS service, 5.0 * k + line_no AS setup_min, 0.5 + qty * 0.05 * k AS cycle_min, (rfq_id + k) % 11 = 0 AS suggested, CASE WHEN (rfq_id + k) % 5 > 0 THEN 0.4 + qty * 0.04 * k END AS rule_cycle_min
        FROM {items} CROSS JOIN (SELECT 1 AS k UNION ALL SELECT 2 UNION ALL SELECT 3) x""",
    "calls": "SELECT event_id AS id, user_id AS rfq_id, event_type AS node, ts, CAST(floor(value * 10) AS BIGINT) AS latency_ms, CAST(event_id % 900 AS BIGINT) AS tokens_in, CAST(event_id % 200 AS BIGINT) AS tokens_out, event_id % 4 = 0 AS cache_hit, CAST(1 + event_id % 3 AS INT) AS attempts, event_id % 17 <> 0 AS ok FROM {events}",
    # before and after a review: operations of a line with changed times
    "edited": "SELECT rfq_id, line_no, seq, centre, setup_min AS before_setup, cycle_min AS before_cycle, CASE WHEN rfq_id % 5 = 0 THEN setup_min + 2 ELSE setup_min END AS after_setup, CASE WHEN (rfq_id + seq) % 4 = 0 THEN cycle_min * 1.25 ELSE cycle_min END AS after_cycle, (rfq_id + line_no) % 13 = 0 AS removed FROM {ops} WHERE centre IS NOT NULL",
    # the table of operations as a reviewer gave it back: changed times, rows gone, sequence numbers twice, new rows, rows begun and left blank
    "edit_rows": """SELECT rfq_id, line_no, 10 * seq AS pos, CAST(seq AS BIGINT) AS seq, coalesce(centre, service) AS op_code, centre AS work_center, CASE WHEN rfq_id % 5 = 0 THEN setup_min + 2 WHEN rfq_id % 7 = 3 THEN NULL ELSE setup_min END AS setup_min,
        CASE WHEN (rfq_id + seq) % 4 = 0 THEN cycle_min * 1.25 ELSE cycle_min END AS cycle_min, rfq_id % 3 = 0 AS accept FROM {ops} WHERE (rfq_id * 3 + line_no + seq) % 13 <> 0
        UNION ALL SELECT rfq_id, line_no, 10 * seq + 5, CAST(seq AS BIGINT), 'extra', NULL, 4.0, 1.5, FALSE FROM {ops} WHERE seq = 10 AND (rfq_id + line_no) % 6 = 1
        UNION ALL SELECT rfq_id, line_no, 900, NULL, ' ', NULL, NULL, 3.0, FALSE FROM {items} WHERE (rfq_id + line_no) % 5 = 2
        UNION ALL SELECT rfq_id, line_no, 910, CASE WHEN rfq_id % 2 = 0 THEN 77 END, 'wc3 ', CASE WHEN rfq_id % 4 = 0 THEN 'wc2' END, 12.0, NULL, FALSE FROM {items} WHERE (rfq_id + line_no) % 9 = 4""",
    # sizes as printed: some are missing, some drawings are in inches
    "printed": "SELECT part_id, shape_class, CASE WHEN part_id % 4 = 0 OR main_mm = 0 THEN NULL ELSE main_mm END AS max_diameter_mm, CASE WHEN part_id % 5 = 0 THEN NULL ELSE length_mm END AS length_mm, width_mm, CASE WHEN part_id % 10 = 3 THEN NULL ELSE height_mm END AS height_mm, part_id % 6 = 2 AS inch FROM {parts}",
    # parts of an assembly: bought or made, with the plant of their recorded cost where there is one
    "make_items": "SELECT l_orderkey AS rfq_id, l_linenumber AS item_no, CASE WHEN l_suppkey % 10 = 0 THEN NULL WHEN l_suppkey % 10 < 5 THEN 'PL' WHEN l_suppkey % 10 < 8 THEN 'CN' ELSE 'DE' END AS plant, l_linenumber % 3 = 0 AS make FROM {orderlines}",
    # prices by plant and quantity before and after a review round
    "price_edits": "SELECT l_orderkey AS rfq_id, CAST(l_linenumber % 3 AS INT) AS round, CASE l_suppkey % 3 WHEN 0 THEN 'DE' WHEN 1 THEN 'PL' ELSE 'CN' END || '@' || CAST(CAST(l_quantity AS INT) AS VARCHAR(9)) AS cell, CASE WHEN l_suppkey % 8 = 0 THEN 0.0 WHEN l_suppkey % 8 = 1 THEN NULL ELSE CAST(l_extendedprice AS DOUBLE) / 100 END AS before, CASE WHEN l_suppkey % 9 = 0 THEN NULL ELSE CAST(l_extendedprice AS DOUBLE) * (1 - CAST(l_discount AS DOUBLE)) / 100 END AS after FROM {orderlines}",
    # rates and services by the names that routing rules use
    "shop": "SELECT k.code, p.code AS plant, (40.0 + 5 * k.o) * (1.0 - 0.2 * p.ord) AS rate_eur_h FROM (SELECT DISTINCT CASE s_suppkey % 13 WHEN 0 THEN 'SAW' WHEN 1 THEN 'CNC_TURN' WHEN 2 THEN 'CNC_MILL_3AX' WHEN 3 THEN 'CNC_MILL_5AX' WHEN 4 THEN 'DRILL' WHEN 5 THEN 'HOB' WHEN 6 THEN 'GRIND_CYL' WHEN 7 THEN 'DEBURR' WHEN 8 THEN 'INSPECT' WHEN 9 THEN 'INSPECT_CMM' WHEN 10 THEN 'ASSEMBLY' WHEN 11 THEN 'TEST' ELSE 'WASH_PACK' END AS code, s_suppkey % 13 AS o FROM {supplier}) k CROSS JOIN {plants} p WHERE NOT (k.o = 6 AND p.code = 'CN')",
    "shop_services": "SELECT DISTINCT CASE s_suppkey % 5 WHEN 0 THEN 'HT_CASE' WHEN 1 THEN 'HT_QT' WHEN 2 THEN 'ANODIZE' WHEN 3 THEN 'ZINC' ELSE 'BLACK' END AS code, 1.5 + 0.5 * (s_suppkey % 5) AS price_eur_kg, 80.0 + 20 * (s_suppkey % 5) AS lot_min_eur FROM {supplier}",
    # recorded operations of finished parts: one for each order line of the part, with times of its own
    "recorded": "SELECT l_partkey AS part_id, CAST(l_orderkey * 8 + l_linenumber AS BIGINT) AS seq, CASE l_suppkey % 6 WHEN 0 THEN 'TURN' WHEN 1 THEN 'MILL' WHEN 2 THEN 'DRILL' WHEN 3 THEN 'GRIND' WHEN 4 THEN 'INSPECT' ELSE 'HEAT_TREAT' END AS op_code, CASE l_suppkey % 6 WHEN 0 THEN 'CNC_TURN' WHEN 1 THEN 'CNC_MILL_3AX' WHEN 2 THEN 'DRILL' WHEN 3 THEN 'GRIND_CYL' WHEN 4 THEN 'INSPECT' ELSE 'OUTSOURCED' END AS work_center, CASE WHEN l_suppkey % 6 = 5 THEN 'HT_QT' END AS service_code, CAST(5 + l_linenumber AS DOUBLE) AS setup_min, CAST(l_quantity AS DOUBLE) / 10 AS cycle_min FROM {orderlines} WHERE l_orderkey % 8 = 0",
    # what a model has read of a drawing's views, with its own words as evidence; and what is printed in title block and notes
    "readings": """SELECT l_orderkey AS drawing, l_linenumber AS n, CASE l_suppkey % 9 WHEN 0 THEN 'bore' WHEN 1 THEN 'hole' WHEN 2 THEN 'outer_diameter' WHEN 3 THEN 'chamfer' WHEN 4 THEN 'thread' WHEN 5 THEN 'face' WHEN 6 THEN 'pocket' WHEN 7 THEN 'slot' ELSE 'keyway' END AS ftype,
        CASE (l_suppkey + l_linenumber) % 8 WHEN 0 THEN '4x Ø' || CAST(CAST(l_quantity AS INT) AS VARCHAR(6)) || ',5' WHEN 1 THEN 'M ' || CAST(CAST(l_quantity AS INT) AS VARCHAR(6)) || ' × 1.5' WHEN 2 THEN '1,5x45' WHEN 3 THEN 'POCKET 40x' || CAST(CAST(l_quantity AS INT) AS VARCHAR(6)) WHEN 4 THEN CAST(CAST(l_quantity AS INT) AS VARCHAR(6)) || ' P9' WHEN 5 THEN NULL WHEN 6 THEN '2 × M' || CAST(CAST(l_quantity AS INT) AS VARCHAR(6)) ELSE 'Ø' || CAST(CAST(l_quantity AS INT) AS VARCHAR(6)) || ' h7' END AS evidence,
        CASE WHEN l_partkey % 3 = 0 THEN NULL WHEN l_partkey % 7 = 1 THEN 40.0 ELSE CAST(l_quantity AS DOUBLE) END AS nominal, CASE WHEN l_linenumber = 4 THEN NULL ELSE CAST(l_linenumber AS DOUBLE) * 30 END AS len_mm, CAST(1 + l_partkey % 2 AS INT) AS qty, CASE l_partkey % 8 WHEN 0 THEN 'h7' WHEN 1 THEN 'H7' WHEN 2 THEN 'p9' WHEN 3 THEN 'N9' WHEN 4 THEN 'H7/g6' END AS fit,
        CASE l_partkey % 5 WHEN 0 THEN 0.0 WHEN 1 THEN CAST(l_tax AS DOUBLE) END AS upper_mm, CASE l_partkey % 5 WHEN 0 THEN 0.0 WHEN 1 THEN CAST(l_discount AS DOUBLE) END AS lower_mm, CASE WHEN l_suppkey % 4 = 0 THEN 0.8 END AS ra_um, CASE WHEN l_partkey % 6 = 0 THEN 'M8' END AS thread FROM {orderlines}""",
    "titles": "SELECT o_orderkey AS drawing, CASE o_orderkey % 4 WHEN 0 THEN '1:2' WHEN 1 THEN '2 : 1' WHEN 2 THEN '1:1' END AS scale, CASE WHEN o_orderkey % 9 = 0 THEN 'inch' ELSE 'mm' END AS units, CASE o_orderkey % 6 WHEN 0 THEN NULL WHEN 1 THEN 'special alloy' ELSE 'M' || CAST(o_orderkey % 6 AS VARCHAR(4)) END AS material, CASE WHEN o_custkey % 12 <> 5 THEN 'PT-' || CAST(o_custkey AS VARCHAR(12)) END AS part_number, CASE WHEN o_custkey % 3 = 0 THEN 'B' END AS revision, o_orderpriority AS title, CASE WHEN o_custkey % 5 = 0 THEN ' ' ELSE 'ISO 2768-mK' END AS general_tolerance, CASE WHEN o_custkey % 4 = 1 THEN 3.2 END AS default_ra, 'title=block;general_tolerance=block' || CASE WHEN o_custkey % 7 < 5 THEN ';material=block;part_number=block' ELSE '' END || CASE WHEN o_custkey % 4 <> 2 THEN ';scale=corner;revision=corner;default_ra=corner' ELSE '' END AS evidence FROM {orders} WHERE o_orderkey % 10 <> 7",
    "views": "SELECT o_orderkey AS drawing, CASE o_orderkey % 3 WHEN 0 THEN 'rotational' WHEN 1 THEN 'prismatic' ELSE 'assembly' END AS shape_class, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(o_custkey % 60 AS DOUBLE) * 10 END AS max_diameter_mm, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(o_custkey % 90 AS DOUBLE) * 2 END AS length_mm, CAST(o_custkey % 50 AS DOUBLE) * 20 AS width_mm, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE 12.0 END AS height_mm FROM {orders} WHERE o_orderkey % 11 <> 5",
    "notes": "SELECT o_orderkey AS drawing, CASE WHEN o_orderkey % 6 = 0 THEN 2.0 WHEN o_orderkey % 6 = 3 THEN 0.0 END AS gear_module, CASE WHEN o_orderkey % 4 < 3 THEN CAST(20 + o_custkey % 9 AS INT) END AS gear_teeth, CASE o_orderkey % 8 WHEN 1 THEN '1,2,2' WHEN 3 THEN '1,2,3' END AS items FROM {orders} WHERE o_orderkey % 13 <> 4",
    # requests as a model has read them, and as they are; their files
    "intake": "SELECT o_orderkey AS rfq_id, CASE o_custkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'eur' ELSE 'Usd' END AS currency, CASE o_custkey % 5 WHEN 0 THEN ' ' WHEN 1 THEN 'dap Berlin' WHEN 2 THEN 'FCA' END AS incoterm, 'pack well|DAP Berlin, unloaded|fca terms|EN 10204 certificate' AS requirements, o_orderpriority AS note FROM {orders}",
    # requests as they were sent, and as a model has read them; requirements are cut by |
    "sent_requests": "SELECT o_orderkey AS rfq_id, 'Customer ' || CAST(o_custkey AS VARCHAR(12)) AS customer, 'Contact ' || CAST(o_custkey % 50 AS VARCHAR(4)) AS contact, 'c' || CAST(o_custkey % 50 AS VARCHAR(4)) || '@example.com' AS email, CASE WHEN o_custkey % 2 = 0 THEN 'en' ELSE 'de' END AS language, CAST(o_orderdate AS DATE) AS received, CASE o_custkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'DAP' ELSE 'FCA' END AS incoterm, CASE WHEN o_custkey % 4 = 0 THEN 'USD' ELSE 'EUR' END AS currency, CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'Zinc plated, thickness 8|Delivered in returnable boxes' ELSE 'Zinc plated, thickness 8|Delivered in returnable boxes|Certificate of grade 3 for the steel' END AS requirements FROM {orders}",
    "read_requests": "SELECT o_orderkey AS rfq_id, CASE WHEN o_orderkey % 6 = 0 THEN 'CUSTOMER  ' ELSE 'customer ' END || CAST(o_custkey AS VARCHAR(12)) AS customer, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE 'Contact ' || CAST(o_custkey % 50 AS VARCHAR(4)) END AS contact, 'c' || CAST(o_custkey % 50 AS VARCHAR(4)) || '@example.com' AS email, 'en' AS language, CASE WHEN o_orderkey % 7 = 0 THEN CAST(o_orderdate AS DATE) + 1 ELSE CAST(o_orderdate AS DATE) END AS received, CASE o_custkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'dap' WHEN 2 THEN 'fca' ELSE 'EXW' END AS incoterm, 'EUR' AS currency, CASE o_orderkey % 3 WHEN 0 THEN NULL WHEN 1 THEN 'zinc plating, thickness 8|black paint' ELSE 'deliver in returnable boxes|certificate of grade 3 steel|zinc' END AS requirements FROM {orders} WHERE o_orderkey % 19 <> 3",
    "sent_lines": "SELECT l_orderkey AS rfq_id, l_linenumber AS line_no, CAST(CAST(l_quantity AS INT) AS VARCHAR(6)) || ',' || CAST(CAST(l_quantity AS INT) * 2 AS VARCHAR(6)) AS quantities, CAST(l_shipdate AS DATE) AS due, 'drw-' || CAST(l_partkey AS VARCHAR(12)) AS drawing_ref, CASE WHEN l_suppkey % 3 = 0 THEN NULL ELSE 'P-' || CAST(l_partkey AS VARCHAR(12)) END AS part_number FROM {orderlines}",
    "read_lines": "SELECT l_orderkey AS rfq_id, l_linenumber AS line_no, CAST(CAST(l_quantity AS INT) AS VARCHAR(6)) || CASE WHEN l_partkey % 6 = 0 THEN '' ELSE ',' || CAST(CAST(l_quantity AS INT) * 2 AS VARCHAR(6)) END AS quantities, CASE WHEN l_partkey % 5 = 0 THEN NULL ELSE CAST(l_shipdate AS DATE) END AS due, CASE WHEN l_partkey % 8 = 0 THEN 'DRW-' ELSE 'drw-' END || CAST(l_partkey AS VARCHAR(12)) AS drawing_ref, CASE WHEN l_suppkey % 3 = 0 THEN NULL ELSE 'p - ' || CAST(l_partkey AS VARCHAR(12)) END AS part_number FROM {orderlines} WHERE NOT (l_linenumber = 2 AND l_orderkey % 4 = 1)",
    "intake_items": "SELECT l_orderkey AS rfq_id, l_linenumber * 3 AS line_no, CAST(CAST(l_quantity AS INT) AS VARCHAR(6)) || ',0,' || CAST(CAST(l_quantity AS INT) * 2 AS VARCHAR(6)) || ',' || CAST(CAST(l_quantity AS INT) AS VARCHAR(6)) || ',-5' AS quantities, CASE l_suppkey % 4 WHEN 0 THEN 'DRW_' || CAST(l_partkey AS VARCHAR(12)) || '.PDF' WHEN 1 THEN CAST(l_partkey AS VARCHAR(12)) WHEN 2 THEN 'see drw-' || CAST(l_partkey AS VARCHAR(12)) || ' rev a' END AS drawing_ref, CASE WHEN l_linenumber = 2 THEN '  ' ELSE l_returnflag END AS notes FROM {orderlines}",
    "attachments": "SELECT l_orderkey AS rfq_id, 'drw-' || CAST(l_partkey AS VARCHAR(12)) || '.pdf' AS file FROM {orderlines} WHERE l_linenumber < 6 GROUP BY 1, 2",
    "wanted": "SELECT o_orderkey AS rfq_id, 'Customer ' || CAST(o_custkey AS VARCHAR(12)) AS customer, o_orderpriority AS priority, CAST(o_orderdate AS DATE) AS issued, o_totalprice AS total FROM {orders}",
    "understood": "SELECT o_orderkey AS rfq_id, CASE WHEN o_orderkey % 6 = 0 THEN 'CUSTOMER  ' ELSE 'customer ' END || CAST(o_custkey AS VARCHAR(12)) AS customer, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE replace(o_orderpriority, '-', ' - ') END AS priority, CASE WHEN o_orderkey % 7 = 0 THEN CAST(o_orderdate AS DATE) + 1 ELSE CAST(o_orderdate AS DATE) END AS issued, CASE WHEN o_orderkey % 4 = 0 THEN o_totalprice * 1.02 ELSE o_totalprice * 1.001 END AS total FROM {orders}",
    # what reviewers did: edits of a line in their order, the margin and plant they set, and their decisions
    "edits": "SELECT l_orderkey AS rfq_id, l_linenumber AS line_no, CAST(k AS INT) AS ordinal, CASE WHEN k = 3 AND l_suppkey % 3 = 0 THEN 'margin' ELSE CASE (l_suppkey + k) % 6 WHEN 0 THEN 'cycle_min' WHEN 1 THEN 'setup_min' WHEN 2 THEN 'remove_op' WHEN 3 THEN 'accept_suggested' WHEN 4 THEN 'cycle_min' ELSE 'add_op' END END AS field, CAST(CASE WHEN l_suppkey % 29 = 0 THEN 77 ELSE 10 * (1 + (l_partkey + k) % 3) END AS INT) AS seq, CASE WHEN l_suppkey % 31 = 0 THEN -1.0 ELSE CAST(l_quantity AS DOUBLE) / 2 END AS new_value FROM {orderlines} CROSS JOIN (SELECT 1 AS k UNION ALL SELECT 2 UNION ALL SELECT 3) x WHERE l_orderkey % 4 = 0",
    "overrides": "SELECT o_orderkey AS rfq_id, CASE o_custkey % 5 WHEN 0 THEN 0.25 WHEN 1 THEN 20.0 WHEN 2 THEN 95.0 END AS margin, CASE o_custkey % 7 WHEN 0 THEN 'PL' WHEN 1 THEN 'auto' WHEN 2 THEN 'CN' END AS plant, CASE WHEN o_orderkey % 2 = 0 THEN 'de' ELSE 'en' END AS language, CASE o_custkey % 3 WHEN 0 THEN 'FCA' WHEN 1 THEN 'DAP' END AS incoterm, CASE WHEN o_orderkey % 17 = 0 THEN ' ' || o_orderpriority || ' ' END AS remark FROM {orders}",
    "reviewed": "SELECT o_orderkey AS rfq_id, 'R' || CAST(o_custkey % 7 AS VARCHAR(4)) AS reviewer, CAST(o_orderdate AS DATE) AS done, o_custkey % 9 = 0 AS reused FROM {orders}",
    "reviews": "SELECT user_id AS rfq_id, event_id, ts, event_type AS action, 'R' || CAST(user_id % 7 AS VARCHAR(4)) AS reviewer, CAST(event_id % 4 AS INT) AS n_edits, CASE WHEN event_id % 5 = 0 THEN props END AS remark FROM {events}",
    # pages as text with headings
    "articles": "SELECT page_id, 'p' || CAST(page_id AS VARCHAR(12)) || '.md' AS file, replace(replace(replace(replace(replace(replace(html, '<article>', chr(10) || '# page' || chr(10)), '<h1>', chr(10) || '## '), '</h1>', chr(10)), '<p><b>', chr(10) || '### '), '</b>', chr(10)), '<br>', chr(10) || '```' || chr(10)) AS content FROM {pages}",
    "true_features": "SELECT l_orderkey AS drawing, CAST(l_linenumber AS INT) AS n, l_returnflag AS ftype, CASE WHEN l_suppkey % 13 = 0 THEN NULL ELSE CAST(l_quantity AS DOUBLE) END AS nominal, CASE WHEN l_suppkey % 5 = 1 THEN NULL ELSE CAST(l_tax AS DOUBLE) END AS band, CAST(1 + l_suppkey % 4 AS INT) AS qty, CAST(l_extendedprice AS DOUBLE) / 1000 AS len_mm FROM {orderlines}",
    "read_features": "SELECT l_orderkey AS drawing, CAST(l_linenumber AS INT) AS n, CASE WHEN l_suppkey % 11 = 0 THEN 'R' ELSE l_returnflag END AS ftype, CASE WHEN l_suppkey % 13 = 0 THEN NULL WHEN l_suppkey % 4 = 0 THEN CAST(l_quantity AS DOUBLE) + 0.5 WHEN l_suppkey % 9 = 0 THEN CAST(l_quantity AS DOUBLE) + 2 ELSE CAST(l_quantity AS DOUBLE) END AS nominal, CASE WHEN l_suppkey % 6 = 0 THEN CAST(l_tax AS DOUBLE) + 0.01 WHEN l_suppkey % 7 = 1 THEN NULL ELSE CAST(l_tax AS DOUBLE) END AS band, CAST(1 + l_suppkey % 4 + l_linenumber % 2 AS INT) AS qty, CASE WHEN l_linenumber = 3 THEN NULL ELSE CAST(l_extendedprice AS DOUBLE) / 1000 * 1.005 END AS len_mm FROM {orderlines} WHERE l_suppkey % 8 <> 0",
    "predicted": "SELECT l_orderkey AS drawing, l_linenumber AS n, l_returnflag AS ftype, l_quantity AS nominal, l_tax AS band FROM {orderlines} WHERE l_suppkey % 7 <> 0",
    "gold": "SELECT l_orderkey AS drawing, l_linenumber AS n, l_returnflag AS ftype, CASE WHEN l_suppkey % 9 = 0 THEN l_quantity + 2 WHEN l_suppkey % 4 = 0 THEN l_quantity + 0.25 ELSE l_quantity END AS nominal, CASE WHEN l_suppkey % 6 = 0 THEN l_tax + 0.01 ELSE l_tax END AS band FROM {orderlines} WHERE l_suppkey % 8 <> 0",
}


def doubles(sql: str) -> str:
    """Number literals with a point as doubles, so that no engine computes in decimals."""
    return re.sub(r"(?<![\w.'])(\d+\.\d+)(?![\w.])", r"\1E0", sql)


TABLES = {name: doubles(sql) for name, sql in TABLES.items()}


def _needs(sql: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"\{(\w+)\}", sql)))


#: Tables that most others are made of, aggregated once a session. Master tables are among them so that their size is known from their files: joins with them
#: need no hint, as Spark broadcasts them while they are below spark.sql.autoBroadcastJoinThreshold and shuffles them beyond.
WRITTEN = ("orderlines", "part_costs", "plants", "centres", "services", "materials")
#: Schemas of the given tables by path: queries read a table many times, and its footers need be looked at once.
_schemas: dict[str, StructType] = {}


def domain(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The DataFrame of a domain table or a given table."""
    if name in GIVEN:
        path = f"{sf_dir}/{name}.parquet"
        if path not in _schemas:
            _schemas[path] = spark.read.parquet(path).schema
        return spark.read.schema(_schemas[path]).parquet(path)
    sql = TABLES[name]
    build = lambda: spark.sql(sql, **{n: domain(spark, sf_dir, n) for n in _needs(sql)})
    return scratch.once(spark, sf_dir, name, build) if name in WRITTEN else build()


def ctes(*names: str) -> str:
    """WITH clauses of the domain tables and those they are made of."""
    seen: dict[str, str] = {}

    def add(name: str) -> None:
        if name in GIVEN or name in seen:
            return
        for n in _needs(TABLES[name]):
            add(n)
        seen[name] = f"{name} AS ({TABLES[name].format(**{n: n for n in _needs(TABLES[name])})})"

    for n in names:
        add(n)
    return "WITH " + ", ".join(seen.values())
