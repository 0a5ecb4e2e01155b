"""DuckDB SQL for the corpus queries that SQL can express."""

from __future__ import annotations

from . import linededup, mixing, secrets


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def secret_scan() -> str:
    """Parts between a rule's matches and the matches themselves, added up, give the places."""
    kinds = []
    for k, r in enumerate(secrets.RULES):
        pattern = _quoted(r.pattern)
        kinds.append(f"""
SELECT doc_id, {k} AS kind, '{r.kind}' AS name, place AS start, place + length(w[i]) AS stop
FROM (SELECT doc_id, w, p, i,
             list_sum(list_transform(g[1:i], lambda x: length(x)))::BIGINT
             + coalesce(list_sum(list_transform(w[1:i-1], lambda x: length(x))), 0)::BIGINT AS place
      FROM (SELECT doc_id, w, p, g, unnest(range(1, len(w) + 1)) AS i
            FROM (SELECT doc_id, regexp_extract_all(t, {pattern}, 0) AS w, regexp_extract_all(t, {pattern}, {r.group}) AS p,
                         regexp_split_to_array(t, {pattern}) AS g
                  FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents))))
WHERE length(p[i]) >= {r.least}""")
    return f"""
WITH spans AS ({' UNION ALL '.join(kinds)}),
found AS (SELECT doc_id, sum((kind = 0)::BIGINT) AS a, sum((kind = 1)::BIGINT) AS b, sum((kind = 2)::BIGINT) AS c,
                 string_agg(name || ':' || start || ':' || stop, ',' ORDER BY start, kind) AS s
          FROM spans GROUP BY doc_id)
SELECT d.doc_id, coalesce(a, 0)::BIGINT AS n_assign, coalesce(b, 0)::BIGINT AS n_access, coalesce(c, 0)::BIGINT AS n_hex,
       sha256(coalesce(s, '')) AS base_sha256, coalesce(s, '') AS spans
FROM documents d LEFT JOIN found f ON d.doc_id = f.doc_id"""


def line_dedup() -> str:
    return f"""
WITH lines AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line,
                      unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents),
keyed AS (SELECT *, trim(line, ' ' || chr(9) || chr(13)) AS k FROM lines),
spread AS (SELECT k, min(struct_pack(doc_id := doc_id, pos := pos)) AS first FROM keyed WHERE k <> ''
           GROUP BY k HAVING count(DISTINCT source) >= {linededup.MIN_SITES}),
marked AS (SELECT x.doc_id, x.pos, x.line,
                  s.k IS NOT NULL AND NOT (s.first.doc_id = x.doc_id AND s.first.pos = x.pos) AS cut
           FROM keyed x LEFT JOIN spread s ON x.k = s.k AND x.k <> '')
SELECT doc_id, count(*)::BIGINT AS n_lines, sum(cut::BIGINT)::BIGINT AS n_removed,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT cut), '')) AS kept_sha256
FROM marked GROUP BY doc_id"""


def _permuted(inner: str, x: str, n: str, keys: list[str], seed: int, others: str) -> str:
    """The swap-or-not shuffle, one nested query a round."""
    p, rounds = mixing.P, mixing.ROUNDS
    c = mixing.constants(seed, rounds * (len(keys) + 3))
    q = inner
    for r in range(rounds):
        a = c[r * (len(keys) + 3) :]
        key = f"{a[0]}::BIGINT"
        for k, m in zip(keys, a[3:]):
            key = f"(({key} + {k} % {p} * {m}::BIGINT) % {p})"
        q = f"SELECT {others}, {n}, {x}, {key} AS ky FROM ({q})"
        q = f"SELECT {others}, {n}, {x}, ky, (ky % {n} - {x} + {n}) % {n} AS other FROM ({q})"
        q = f"SELECT {others}, {n}, CASE WHEN ((greatest({x}, other) % {p} * {a[1]}::BIGINT + ky) % {p} * {a[2]}::BIGINT % {p}) % 2 = 1 THEN other ELSE {x} END AS {x} FROM ({q})"
    return q


def _uniform(g: str, seed: int) -> str:
    """mixing.uniform of ``g``, as nested queries over a table draw(g)."""
    p, a = mixing.P, mixing.constants(seed, 7)
    q = f"SELECT g, ({g} % {p} * {a[0]}::BIGINT + {g} // {p} * {a[1]}::BIGINT + {a[2]}) % {p} AS x FROM slots"
    for k in (3, 5):
        q = f"SELECT g, x, x * x % {p} AS s FROM ({q})"
        q = f"SELECT g, (s * s % {p} * x % {p} * {a[k]}::BIGINT + {a[k + 1]}) % {p} AS x FROM ({q})"
    return q


def source_mix(block: int = 32, seed: int = 11) -> str:
    p, cap = mixing.P, mixing.CAP
    a, b = mixing.constants(3, 2)
    again = _permuted("SELECT shard, over0 + i - draws AS j, m FROM placed WHERE i >= draws", "j", "m", [], seed + 1, "shard")
    shuffled = _permuted(
        "SELECT * FROM indexed",
        "block", "blocks", ["sid", "epoch"], seed, "sid, epoch",
    )
    return f"""
WITH rws AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM documents),
buckets AS (SELECT greatest(1, floor(sqrt(count(*))))::BIGINT AS m FROM rws),
ordered AS (SELECT doc_id, source, size, (((doc_id % {p} + {p}) % {p} * {a}::BIGINT + {b}) % {p}) % m AS bucket FROM rws, buckets),
streams AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY bucket, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS row_start FROM ordered),
sizes AS (SELECT source, sum(size)::BIGINT AS source_size FROM rws GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS sid FROM sizes),
weighed AS (SELECT *, sid % 3 + 1 AS weight, source_size * {cap} AS capped FROM ranked),
levels AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(capped) OVER w, 0))::DOUBLE / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0))::DOUBLE AS level
           FROM weighed WINDOW w AS (ORDER BY capped::DOUBLE / weight, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
aimed AS (SELECT *, least(capped::DOUBLE, max(level) OVER () * weight) AS target, ceil(source_size::DOUBLE / {block})::BIGINT AS blocks FROM levels),
passed AS (SELECT *, least(floor(target / greatest(source_size, 1)), {cap})::BIGINT AS passes FROM aimed),
sources AS (SELECT *, least(passes * blocks + round((target - passes * source_size) * blocks / greatest(source_size, 1))::BIGINT, {cap} * blocks)::BIGINT AS draws FROM passed),
total AS (SELECT coalesce(sum(draws), 0)::BIGINT AS t FROM sources),
upto AS (SELECT sid, draws, sum(draws) OVER (ORDER BY sid)::BIGINT AS u FROM sources),
shares AS (SELECT sid, floor((u - draws)::DOUBLE / t::DOUBLE * {p})::BIGINT AS lo, floor(u::DOUBLE / t::DOUBLE * {p})::BIGINT AS hi FROM upto, total WHERE t > 0),
slots AS MATERIALIZED (SELECT unnest(range(t)) AS g FROM total),
thrown AS MATERIALIZED ({_uniform("g", seed)}),
counts AS MATERIALIZED (SELECT g // {mixing.SLOTS} AS shard, sid, count(*) AS n FROM thrown JOIN shares ON x >= lo AND x < hi GROUP BY ALL),
got AS (SELECT sid, sum(n)::BIGINT AS n FROM counts GROUP BY sid),
needs AS (SELECT s.sid, draws, least(draws, coalesce(n, 0)) AS kept, greatest(coalesce(n, 0) - draws, 0) AS over, draws - least(draws, coalesce(n, 0)) AS room FROM sources s LEFT JOIN got USING (sid)),
rooms AS (SELECT *, (sum(over) OVER w - over)::BIGINT AS over0, (sum(room) OVER w - room)::BIGINT AS room0, (sum(over) OVER ())::BIGINT AS m FROM needs WINDOW w AS (ORDER BY sid ROWS UNBOUNDED PRECEDING)),
listed AS (SELECT shard, sid, unnest(range(a, a + n)) AS i FROM (SELECT *, (sum(n) OVER (PARTITION BY sid ORDER BY shard) - n)::BIGINT AS a FROM counts)),
placed AS MATERIALIZED (SELECT * FROM listed JOIN rooms USING (sid)),
again AS MATERIALIZED ({again}),
drawn AS MATERIALIZED (SELECT sid, i FROM placed WHERE i < draws
          UNION ALL SELECT r.sid, r.kept + x.j - r.room0 FROM again x JOIN rooms r ON x.j >= r.room0 AND x.j < r.room0 + r.room),
indexed AS MATERIALIZED (SELECT sid, blocks, i // blocks AS epoch, i % blocks AS block FROM drawn JOIN sources USING (sid)),
shuffled AS MATERIALIZED ({shuffled}),
chosen AS MATERIALIZED (SELECT sid, block, count(*) AS times FROM shuffled GROUP BY sid, block),
spans AS (SELECT *, unnest(range(row_start // {block}, (row_start + size - 1) // {block} + 1)) AS block
          FROM (SELECT sid, t.* FROM streams t JOIN ranked r ON t.source IS NOT DISTINCT FROM r.source WHERE size > 0)),
words AS (SELECT s.sid, s.row_start, sum(times * (least((s.block + 1) * {block}, row_start + size) - greatest(s.block * {block}, row_start)))::BIGINT AS taken
          FROM spans s JOIN chosen d ON s.sid = d.sid AND s.block = d.block GROUP BY s.sid, s.row_start)
SELECT t.doc_id, t.size, o.source_size, o.target, CASE WHEN t.size > 0 THEN coalesce(g.taken, 0) ELSE 0 END::BIGINT AS taken
FROM streams t JOIN sources o ON t.source IS NOT DISTINCT FROM o.source
LEFT JOIN words g ON g.sid = o.sid AND g.row_start = t.row_start AND t.size > 0"""


def exact_topk() -> str:
    return """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
             list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i]))::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 20"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_secret_scan": secret_scan(),
        "op3_source_mix": source_mix(),
        "op5_exact_topk": exact_topk(),
        "op6_line_dedup": line_dedup(),
    }
