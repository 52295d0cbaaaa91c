"""SQL for sharding, the prefix trie and conversation repair, written from their definitions alone."""

from __future__ import annotations

# The table of CRC-32 by its rule; lists of bytes are folded with it.
_TAB = """tab AS (
  SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab)"""


def _crc(bytes_: str) -> str:
    return f"xor(list_reduce(list_prepend(4294967295, {bytes_}), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295)"


def _ascii(text: str) -> str:
    return f"list_transform(string_split({text}, ''), lambda x: ascii(x)::BIGINT)"


def _shard(n: int) -> str:
    scores = ", ".join(f"-1 / ln((('0x' || substr(md5(doc_id || ':{k}'), 1, 13))::BIGINT + 0.5) / 4503599627370496)" for k in range(n))
    return f"(list_position([{scores}], list_max([{scores}])) - 1)::INT"


_OP11 = f"""
WITH {_TAB},
d AS (SELECT doc_id, strlen(coalesce(text, ''))::BIGINT AS n, hex(encode(coalesce(text, ''))) AS h FROM documents),
b AS (SELECT doc_id, n + 1 AS size, list_transform(range(n), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT) AS bytes FROM d),
s AS (SELECT doc_id, size, {_crc("bytes")}::BIGINT AS text_crc32, {_shard(8)} AS shard, {_shard(9)} AS grown_shard FROM b, tab)
SELECT doc_id, size, text_crc32, 'key' AS law, shard,
       row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS slot, grown_shard FROM s
"""

_OP12 = f"""
WITH {_TAB},
c AS (
  SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list({{'r': r, 't': t}} ORDER BY turn NULLS FIRST, r, t) AS s FROM c GROUP BY conv_id),
h AS (SELECT conv_id, s, {_crc(_ascii("conv_id::VARCHAR"))} % 6 AS h FROM own, tab),
p AS (
  SELECT h.conv_id, list_concat(coalesce(b.s[1 : h], []), h.s[h + 1 :]) AS s
  FROM h LEFT JOIN own b ON b.conv_id = h.conv_id - h.conv_id % 100),
m AS (SELECT conv_id, s, d, s[1 : d] AS k FROM (SELECT conv_id, s, unnest(range(len(s) + 1)) AS d FROM p)),
g AS (
  SELECT k, d, min(conv_id) AS owner, count(*) AS n, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE d = len(s)) AS ends
  FROM m GROUP BY k, d),
o AS (SELECT m.conv_id, m.d, g.owner FROM m JOIN g USING (k, d)),
t AS (
  SELECT g.owner, g.d, g.n, g.ends, up.owner AS parent, CASE WHEN g.d = 0 THEN 0 ELSE (g.n - 1) * length(k[g.d].t) END AS own_saved
  FROM g LEFT JOIN o up ON up.conv_id = g.owner AND up.d = g.d - 1),
ch AS (SELECT parent AS owner, d - 1 AS d, count(*) AS n_children FROM t WHERE d > 0 GROUP BY ALL),
f AS (SELECT t.*, coalesce(n_children, 0) AS n_children FROM t LEFT JOIN ch USING (owner, d)),
sub AS (
  SELECT a.owner, a.d, count(*) FILTER (WHERE f.n_children = 0) AS n_leaves, sum(f.own_saved) AS saved
  FROM f JOIN o a ON a.conv_id = f.owner AND a.d <= f.d GROUP BY ALL)
SELECT owner AS conv_id, d AS depth, parent AS parent_conv_id, n AS n_convs, n_children::BIGINT AS n_children, n_leaves,
       saved::BIGINT AS saved_tokens, sha256(coalesce(ends, '')) AS ends_sha256
FROM f JOIN sub USING (owner, d)
"""

# Costs are lists by state: 1 nothing yet, 2 after the system turn, 3 after a user turn, 4 after an assistant turn.
_OP13 = rf"""
WITH RECURSIVE {_TAB},
raw AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         {_crc(_ascii("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')"))} % 20 AS k FROM conversations, tab),
dam AS (
  SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role,
         CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(range(CASE WHEN k = 3 THEN 2 ELSE 1 END)) AS copy FROM raw WHERE k <> 0),
num AS (
  SELECT *, row_number() OVER w AS i, regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS stripped, lag(substr(role, 1, 1)) OVER w AS before
  FROM dam WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
fl AS (
  SELECT conv_id, turn, role, text, i, substr(role, 1, 1) AS x, before,
         CASE WHEN stripped = '' THEN 'B' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'D' WHEN right(stripped, 1) NOT IN ('.', '!', '?') THEN 'T' ELSE '' END AS fault FROM num),
tot AS (
  SELECT conv_id, max(i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'B') AS blank,
         count(*) FILTER (WHERE fault = 'D') AS duplicate, count(*) FILTER (WHERE fault = 'T') AS truncated,
         count(*) FILTER (WHERE before IS NOT NULL AND before || x NOT IN ('su', 'ua', 'au')) AS illegal FROM fl GROUP BY conv_id),
bw(conv_id, i, f) AS (
  SELECT conv_id, n + 1, [0, 6, 3, 0]::BIGINT[] FROM tot
  UNION ALL
  SELECT conv_id, i, [least(g[1], 3 + g[3], 6 + g[4]), least(g[2], 3 + g[3], 6 + g[4]), least(g[3], 3 + g[4]), least(g[4], 3 + g[3])] FROM (
    SELECT bw.conv_id, fl.i, list_transform([1, 2, 3, 4], lambda s: least(4 + bw.f[s],
      CASE WHEN fault IN ('B', 'D') THEN 1000000000000 ELSE least(
        CASE WHEN s = 1 AND x = 's' THEN bw.f[2] WHEN s <> 3 AND x = 'u' THEN bw.f[3] WHEN s = 3 AND x = 'a' THEN bw.f[4] ELSE 1000000000000 END,
        3 + CASE WHEN s = 3 THEN bw.f[4] ELSE bw.f[3] END) + CASE WHEN fault = 'T' THEN 3 ELSE 0 END END)) AS g
    FROM bw JOIN fl ON fl.conv_id IS NOT DISTINCT FROM bw.conv_id AND fl.i = bw.i - 1)),
fw(conv_id, i, s, audit, lines) AS (
  SELECT conv_id, 1::BIGINT, 1, '', []::VARCHAR[] FROM tot
  UNION ALL
  SELECT conv_id, CASE WHEN e = 'I' THEN i ELSE i + 1 END,
         CASE WHEN e = 'D' THEN s WHEN e = 'K' AND x = 's' THEN 2 WHEN s = 3 THEN 4 ELSE 3 END, audit || e,
         CASE e WHEN 'D' THEN lines WHEN 'K' THEN list_append(lines, role || ':' || text)
           ELSE list_append(lines, CASE WHEN s = 3 THEN 'assistant' ELSE 'user' END || ':' || CASE WHEN e = 'R' THEN text ELSE '' END) END
  FROM (
    SELECT fw.*, fl.role, fl.text, fl.x, CASE
        WHEN fl.i IS NOT NULL AND a.f[s] = 4 + b.f[s] THEN 'D'
        WHEN a.f[s] = 3 + a.f[CASE WHEN s = 3 THEN 4 ELSE 3 END] THEN 'I'
        WHEN fault NOT IN ('B', 'D') AND (s = 1 AND x = 's' OR s <> 3 AND x = 'u' OR s = 3 AND x = 'a')
          AND a.f[s] = b.f[CASE x WHEN 's' THEN 2 WHEN 'u' THEN 3 ELSE 4 END] + CASE WHEN fault = 'T' THEN 3 ELSE 0 END THEN 'K'
        ELSE 'R' END AS e
    FROM fw JOIN bw a ON a.conv_id IS NOT DISTINCT FROM fw.conv_id AND a.i = fw.i
    LEFT JOIN fl ON fl.conv_id IS NOT DISTINCT FROM fw.conv_id AND fl.i = fw.i
    LEFT JOIN bw b ON b.conv_id IS NOT DISTINCT FROM fw.conv_id AND b.i = fw.i + 1
    WHERE fl.i IS NOT NULL OR s IN (2, 3))),
done AS (
  SELECT fw.* FROM fw JOIN tot ON tot.conv_id IS NOT DISTINCT FROM fw.conv_id WHERE fw.i = tot.n + 1 AND s IN (1, 4)),
best AS (SELECT conv_id, f[1] AS cost FROM bw WHERE i = 1)
SELECT ids.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit,
       sha256(coalesce(array_to_string(lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) ids
LEFT JOIN tot ON tot.conv_id IS NOT DISTINCT FROM ids.conv_id
LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM ids.conv_id
LEFT JOIN done ON done.conv_id IS NOT DISTINCT FROM ids.conv_id
"""


def statements() -> dict[str, str]:
    return {"op11_rendezvous_shards": _OP11, "op12_prefix_trie": _OP12, "op13_structure_repair": _OP13}
