"""The derived tables of :mod:`rasterlake.sources.fixtures` as SQL CTEs.

They let an independent SQL engine compute the same inputs for the checks.
"""

from __future__ import annotations

# name -> (names it builds on, CTE body)
CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "px8": (
        (),
        """
        SELECT image_id, (pos % 8)::INT AS x, (pos // 8)::INT AS y, alpha,
               floor(alpha * 255 + 0.5)::INT AS code
        FROM (SELECT image_id, pos,
                     least(1.0, greatest(0.0, (v + 0.6::DOUBLE) / 1.2::DOUBLE)) AS alpha
              FROM (SELECT vec_id AS image_id,
                           unnest(range(0, len(embedding))) AS pos,
                           unnest(embedding)::DOUBLE AS v
                    FROM embeddings))""",
    ),
    "px8s": (
        ("px8",),
        """
        SELECT image_id, x, y, a2 AS alpha, floor(a2 * 255 + 0.5)::INT AS code
        FROM (SELECT image_id, x, y,
                     least(1.0, greatest(0.0, (alpha - 0.5::DOUBLE) * 6.0::DOUBLE + 0.5::DOUBLE)) AS a2
              FROM px8)""",
    ),
    "rgba8": (
        ("px8",),
        """
        SELECT image_id // 4 AS image_id, x, y,
               max(CASE WHEN image_id % 4 = 0 THEN code END) AS r,
               max(CASE WHEN image_id % 4 = 1 THEN code END) AS g,
               max(CASE WHEN image_id % 4 = 2 THEN code END) AS b,
               least(255, 2 * max(CASE WHEN image_id % 4 = 3 THEN code END)) AS a
        FROM px8 GROUP BY image_id // 4, x, y""",
    ),
    "flat32": (
        ("rgba8",),
        """
        SELECT image_id, (x * 4 + i)::INT AS x, (y * 4 + j)::INT AS y,
               CASE WHEN r > 127 THEN 200 ELSE 40 END AS r,
               CASE WHEN image_id % 3 > 0 AND g > 127 THEN 190 ELSE 60 END AS g,
               CASE WHEN image_id % 3 = 2 AND b > 127 THEN 220 ELSE 30 END AS b,
               CASE WHEN image_id % 2 = 0 THEN 255 WHEN a < 200 THEN 0 WHEN image_id % 4 = 1 THEN 255 ELSE 128 END AS a
        FROM rgba8 CROSS JOIN (SELECT range AS i FROM range(0, 4)) CROSS JOIN (SELECT range AS j FROM range(0, 4))""",
    ),
    "mosaic": (
        ("px8",),
        """
        SELECT e.label, ((t.slot % 8) * 8 + p.x)::INT AS x, ((t.slot // 8) * 8 + p.y)::INT AS y, p.alpha
        FROM px8 p JOIN embeddings e ON e.vec_id = p.image_id
        JOIN (SELECT vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS slot
              FROM embeddings) t ON t.vec_id = p.image_id""",
    ),
    "grid": (
        (),
        """
        SELECT i.image_id, s.x, s.y, coalesce(c.v, 0.0) AS v
        FROM (SELECT DISTINCT l_suppkey AS image_id FROM lineitem) i
        CROSS JOIN (SELECT (k % 64)::INT AS x, (k // 64)::INT AS y FROM range(0, 4096) t(k)) s
        LEFT JOIN (SELECT l_suppkey AS image_id, (l_partkey % 64)::INT AS x, (l_orderkey % 64)::INT AS y,
                          least(1.0, greatest(0.0, sum((l_discount * 100)::BIGINT) / (10.0::DOUBLE * count(*)))) AS v
                   FROM lineitem GROUP BY 1, 2, 3) c
        ON c.image_id = i.image_id AND c.x = s.x AND c.y = s.y""",
    ),
    "labels4": (
        ("px8",),
        "SELECT image_id, x, y, least(3, floor(alpha * 4)::INT) AS label FROM px8",
    ),
    "bin8": (
        ("px8s",),
        "SELECT image_id, x, y, alpha >= 0.5 AS inside FROM px8s",
    ),
    "pair": (
        ("px8",),
        """
        SELECT a.image_id, a.x, a.y, a.alpha AS obs, b.alpha AS pred
        FROM px8 a JOIN px8 b ON b.image_id = a.image_id + 1 AND b.x = a.x AND b.y = a.y""",
    ),
    "chain": (
        (),
        """
        SELECT user_id AS chain_id,
               (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1)::BIGINT AS k,
               value / 10 AS px,
               (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1)::DOUBLE AS py,
               0.35::DOUBLE AS halfwidth, 1.0::DOUBLE AS weight_ds
        FROM events""",
    ),
    "segments": (
        ("chain",),
        """
        SELECT chain_id, k AS sid, px AS x1, py AS y1, x2, y2
        FROM (SELECT *, lead(px) OVER (PARTITION BY chain_id ORDER BY k) AS x2,
                     lead(py) OVER (PARTITION BY chain_id ORDER BY k) AS y2 FROM chain)
        WHERE x2 IS NOT NULL""",
    ),
    "samples": (
        (),
        """
        SELECT l_returnflag AS axis_flag, l_linestatus AS axis_status,
               l_linenumber AS axis_line, c_mktsegment AS axis_segment,
               l_discount * 10 AS distance_px, l_tax * 10 AS sigma_px,
               l_quantity AS weight_ds, l_tax AS bias_px, l_tax >= 0.08 AS capped
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey""",
    ),
    "meas": (
        (),
        """
        SELECT o_orderkey AS group_id, l_suppkey AS scene_id, l_linenumber::BIGINT AS cell_id,
               c_mktsegment AS family, (16 * (1 << (l_partkey % 6)::INT))::BIGINT AS size_px,
               l_returnflag AS profile,
               CASE WHEN l_partkey % 5 = 4 THEN 'equivalent_family' ELSE 'identifiable' END AS identifiability,
               l_linestatus = 'O' AS accepted,
               l_discount >= 0.09 AND l_tax >= 0.07 AS catastrophic,
               l_linenumber <= 4 AS mandatory,
               (l_quantity * 100)::BIGINT AS runtime_ms,
               l_discount * 3 AS p95_px, l_discount * 3 + l_tax AS p99_px,
               l_discount * 3 + l_tax + l_tax AS max_px,
               (10 + l_partkey % 90)::BIGINT AS samples,
               floor((10 + l_partkey % 90) * least(1.0, 0.35 / greatest(l_discount * 3 + l_tax + l_tax, 1e-9)))::BIGINT AS at95,
               floor((10 + l_partkey % 90) * least(1.0, 0.45 / greatest(l_discount * 3 + l_tax + l_tax, 1e-9)))::BIGINT AS at99,
               l_extendedprice / l_quantity / 997 AS bits_per_block,
               o_orderpriority AS class, o_orderstatus AS status,
               CASE WHEN l_partkey % 7 = 0 THEN NULL ELSE 'reason_' || (l_partkey % 4) END AS reason,
               (l_discount * 100)::BIGINT AS palette_delta,
               (l_tax * 100)::BIGINT AS channel_delta,
               (l_quantity)::BIGINT AS quantity, l_extendedprice AS price,
               l_orderkey, l_partkey, l_shipdate
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey""",
    ),
    "meas1": (
        ("meas",),
        """
        SELECT group_id, scene_id, cell_id, any_value(family) AS family,
               max(size_px) AS size_px, min(profile) AS profile, min(identifiability) AS identifiability,
               bool_and(accepted) AS accepted, bool_or(catastrophic) AS catastrophic,
               bool_and(mandatory) AS mandatory, max(runtime_ms) AS runtime_ms,
               max(p95_px) AS p95_px, max(p99_px) AS p99_px, max(max_px) AS max_px,
               max(samples) AS samples, max(bits_per_block) AS bits_per_block,
               max(palette_delta) AS palette_delta, max(channel_delta) AS channel_delta,
               max(quantity) AS quantity, any_value(class) AS class, any_value(status) AS status,
               max(reason) AS reason
        FROM meas GROUP BY group_id, scene_id, cell_id""",
    ),
    "hyp": (
        (),
        """
        SELECT l_orderkey AS image_id,
               concat_ws('-', l_linenumber, l_partkey, l_suppkey, round(l_extendedprice * 100)::BIGINT,
                         l_quantity::BIGINT, round(l_discount * 100)::BIGINT, round(l_tax * 100)::BIGINT,
                         l_returnflag, strftime(l_shipdate, '%Y%m%d')) AS hypothesis_id,
               'd' || (l_partkey % 5) AS delivery, l_returnflag AS topology_class,
               l_linestatus AS formation_class, l_extendedprice / 1000 AS total_bits,
               l_quantity::BIGINT AS memory_bytes
        FROM lineitem""",
    ),
    "arms": (
        (),
        """
        SELECT user_id, CAST(ts AS DATE)::VARCHAR AS day,
               CASE event_type WHEN 'click' THEN 'PF00' WHEN 'view' THEN 'PF01'
                    WHEN 'purchase' THEN 'PF10' WHEN 'signup' THEN 'PF11' END AS arm,
               event_type = 'error' AS contaminated, value, event_id,
               'b' || (user_id % 3) AS backend, 'c' || (event_id % 2) AS config
        FROM events""",
    ),
    "runs": (
        (),
        """
        SELECT input, artifact, repeat,
               CASE WHEN (length(input) + ascii(artifact)) % 2 = 0 THEN min(own) OVER (PARTITION BY input, artifact) ELSE own END AS digest
        FROM (SELECT source AS input, lang AS artifact, doc_id % 3 AS repeat, min(sha256(text)) AS own FROM documents GROUP BY 1, 2, 3)""",
    ),
    "manifest": (
        (),
        """
        SELECT 'page-' || page_id AS name, sha256(html) AS sha256,
               (length(url) + 16)::BIGINT AS width, (length(html) % 512 + 1)::BIGINT AS height
        FROM pages""",
    ),
    "files": (
        (),
        """
        SELECT 'page-' || page_id AS name,
               CASE WHEN page_id % 11 = 0 THEN sha256(html || '!') ELSE sha256(html) END AS sha256,
               CASE WHEN page_id % 13 = 0 THEN NULL ELSE (length(url) + 16)::BIGINT END AS width,
               CASE WHEN page_id % 17 = 0 THEN 0::BIGINT ELSE (length(html) % 512 + 1)::BIGINT END AS height
        FROM pages WHERE page_id % 7 <> 0
        UNION ALL
        SELECT 'extra-' || page_id, sha256(url), 1::BIGINT, 1::BIGINT FROM pages WHERE page_id % 10 = 0""",
    ),
    "changes": (
        (),
        """
        SELECT conv_id AS change_set,
               CASE WHEN role = 'user' THEN 'configs\\gate_' ELSE 'crates/code_' END
                 || (turn % 3) || CASE WHEN role = 'user' THEN '.toml' ELSE '.src' END AS path,
               CASE (length(text) % 3) WHEN 0 THEN 'A' WHEN 1 THEN 'M' ELSE 'D' END AS kind,
               conv_id % 2 = 0 AND turn < 2 AS at_base, turn
        FROM conversations""",
    ),
}


# the wide rasters under the names of the small ones
WIDE = """
        SELECT d.image_id, d.x, d.y, least(1.0, greatest(0.0, coalesce(c.v, 0.0) + (d.x * 7 + d.y * 13) % 5 * 0.002::DOUBLE)) AS v
        FROM (SELECT image_id, (k % 256)::INT AS x, (k // 256)::INT AS y FROM (SELECT DISTINCT l_suppkey % 4 AS image_id FROM lineitem) CROSS JOIN range(0, 53248) t(k)) d
        LEFT JOIN (SELECT l_suppkey % 4 AS image_id, l_partkey % 32 AS cx, l_orderkey % 26 AS cy, sum(round(l_discount * 100)::BIGINT) % 11 / 10.0::DOUBLE AS v FROM lineitem GROUP BY ALL) c
        ON c.image_id = d.image_id AND c.cx = d.x // 8 AND c.cy = d.y // 8"""
WIDE_CTES = {"grid": WIDE, "px8": f"SELECT image_id, x, y, v AS alpha, floor(v * 255 + 0.5)::INT AS code FROM ({WIDE})"}


def widened(sql: str) -> str:
    """The same query over the wide rasters."""
    for name, body in WIDE_CTES.items():
        sql = sql.replace(f"{name} AS ({CTES[name][1].strip()})", f"{name} AS ({body.strip()})", 1)
    return sql


def with_fixtures(names: list[str], body: str) -> str:
    """Prefix ``body`` with the CTEs of ``names`` and what they build on."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name in ordered:
            return
        for parent in CTES[name][0]:
            visit(parent)
        ordered.append(name)

    for name in names:
        visit(name)
    body = body.strip()
    parts = [f"{n} AS ({CTES[n][1].strip()})" for n in ordered]
    if body.lower().startswith("select"):
        return f"WITH {', '.join(parts)} {body}" if parts else body
    recursive = "RECURSIVE " if body.lower().startswith("recursive") else ""
    if recursive:
        body = body[len("recursive"):].strip()
    return f"WITH {recursive}{', '.join(parts + [body]) if parts else body}"
