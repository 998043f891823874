"""SQL fragments shared by the oracle queries."""
from __future__ import annotations

CELLS = """cells AS (
  SELECT o_orderkey AS cell_id, CAST(year(o_orderdate) AS VARCHAR) AS batch,
         'T' || CAST(o_custkey % 32 AS VARCHAR) AS target,
         CASE WHEN o_orderkey % 10 < 6 THEN 'train' WHEN o_orderkey % 10 < 8 THEN 'val' ELSE 'test' END AS split
  FROM orders)"""
COUNTS = """counts AS (
  SELECT l_orderkey AS cell_id, CAST(l_partkey % 64 AS INTEGER) AS gene_idx, sum(l_quantity) AS cnt
  FROM lineitem GROUP BY 1, 2)"""
NORM = """norm AS (
  SELECT cell_id, gene_idx, ln(1 + cnt * 10000.0 / CASE WHEN total = 0 THEN 1 ELSE total END) AS v
  FROM (SELECT *, sum(cnt) OVER (PARTITION BY cell_id) AS total FROM counts))"""
SIZES = """sizes AS (
  SELECT split, batch, target, count(*) AS n_cells FROM cells WHERE target <> 'T0'
  GROUP BY ALL HAVING count(*) >= 10)"""
PROFILE = """profile AS (
  SELECT split, batch, target, gene_idx, sum(v) / any_value(n_cells) AS mean
  FROM norm JOIN cells USING (cell_id) JOIN sizes USING (split, batch, target) GROUP BY ALL)"""
NCTRL = """nctrl AS (SELECT batch, count(*) AS n FROM cells WHERE target = 'T0' GROUP BY 1)"""
CTRL = """ctrl AS (
  SELECT batch, gene_idx, sum(v) / any_value(n) AS mean
  FROM norm JOIN cells USING (cell_id) JOIN nctrl USING (batch) WHERE target = 'T0' GROUP BY batch, gene_idx)"""
DELTA = """delta AS (
  SELECT s.split, s.batch, s.target, g.gene_idx,
         coalesce(p.mean, 0) - coalesce(c.mean, 0) AS delta
  FROM sizes s CROSS JOIN (SELECT DISTINCT gene_idx FROM norm) g
  LEFT JOIN profile p ON p.split = s.split AND p.batch = s.batch AND p.target = s.target AND p.gene_idx = g.gene_idx
  LEFT JOIN ctrl c ON c.batch = s.batch AND c.gene_idx = g.gene_idx
  WHERE p.mean IS NOT NULL OR c.mean IS NOT NULL)"""
SCORES = """net AS (
  SELECT l_orderkey, sum(l_extendedprice * (1 - l_discount)) AS net FROM lineitem GROUP BY 1),
scores AS (
  SELECT o_orderkey AS row_key, CAST(year(o_orderdate) AS INTEGER) AS context, o_custkey AS cluster,
         o_totalprice / 100000.0 AS y, round(coalesce(net, 0.0) / 100000.0, 9) AS pred_a,
         c_acctbal / 10000.0 AS pred_b
  FROM orders LEFT JOIN net ON o_orderkey = l_orderkey JOIN customer ON o_custkey = c_custkey)"""
EMB = """emb AS (
  SELECT vec_id AS cell_id, 'L' || CAST(label AS VARCHAR) AS construct, CAST(vec_id % 5 AS INTEGER) AS batch,
         CAST(embedding AS DOUBLE[]) AS emb FROM embeddings),
embl AS (
  SELECT cell_id, construct, batch, d, emb[d] AS x FROM emb, (SELECT unnest(generate_series(1, 64)) AS d))"""

SCREEN = ", ".join([CELLS, COUNTS, NORM])
BULK = ", ".join([SCREEN, SIZES, PROFILE])
FULL = ", ".join([BULK, NCTRL, CTRL, DELTA])


def rd(expr: str, n: int = 6) -> str:
    """Rounded value without negative zero."""
    return f"(round({expr}, {n}) + 0.0)"


def unit(seed, *keys: str, start: int = 1) -> str:
    """Keyed uniform number, as in the Spark expression of the same name."""
    parts = ", ".join([f"'{seed}'" if not str(seed).startswith("(") else str(seed), *keys])
    return f"(CAST('0x' || substr(md5(concat_ws('|', {parts})), {start}, 8) AS BIGINT) / 4294967296.0)"


def fmix(src: str, col: str) -> str:
    """``src`` with the 32-bit column ``col`` hashed, as in ``functions.draws``."""
    return f"""(SELECT * EXCLUDE ({col}, h1_, h2_), xor(h2_, h2_ >> 16) AS {col} FROM
    (SELECT *, (xor(h1_, h1_ >> 13) * 3266489909) % 4294967296 AS h2_ FROM
    (SELECT *, (xor({col}, {col} >> 16) * 2246822507) % 4294967296 AS h1_ FROM {src})))"""


def boot_draws(seed: int, reps: int, sizes: str) -> str:
    """rep, hit and the columns of ``sizes`` (its ``n`` draws from n items in one block): every draw of every replicate."""
    first = fmix(f"(SELECT rep, (({seed} + rep * 2654435761) % 4294967296)::UBIGINT AS k FROM (SELECT unnest(range(1, {reps + 1})) AS rep))", "k")
    keys = fmix(f"(SELECT rep, xor(k, 1::UBIGINT) AS k FROM {first})", "k")
    numbers = fmix(f"(SELECT z.*, (((t + 1) * 2654435761) % 4294967296)::UBIGINT AS g FROM (SELECT *, unnest(range(n)) AS t FROM {sizes}) z)", "g")
    return f"(SELECT * EXCLUDE (h, g, k), ((h * n::UBIGINT) >> 32)::BIGINT AS hit FROM {fmix(f'(SELECT *, xor(g, k) AS h FROM {numbers} CROSS JOIN {keys})', 'h')})"


def digest(seed, *keys: str) -> str:
    return f"md5(concat_ws('|', '{seed}', {', '.join(keys)}))"


def normal(seed, *keys: str) -> str:
    return (
        f"(sqrt(-2.0 * ln(1.0 - {unit(seed, *keys)})) * cos(2.0 * pi() * {unit(seed, *keys, start=9)}))"
    )


def ridge_sql(n: str, by: list[str], alphas: list[float], center: bool = True) -> str:
    """Ridge weights of any width: elimination over the table of products, one recursion step per coordinate.

    Reads ``{n}_f`` (by, rid, d, x) with d = 1, 2, ... and ``{n}_y`` (by, rid, t, y) with t = 1, 2, ...; gives
    ``{n}_w`` (by, alpha, t, d, w), ``{n}_m`` (by, d, mx) and ``{n}_my`` (by, t, my).  Without ``center`` means are 0, and
    the caller adds a constant coordinate.  Needs WITH RECURSIVE."""
    k = "".join(f"{b}, " for b in by)
    on = f"USING ({', '.join(by)})" if by else "ON true"
    mean = "avg({c})" if center else "0.0 * avg({c})"
    return f"""{n}_m AS (SELECT {k}d, {mean.format(c='x')} AS mx FROM {n}_f GROUP BY {k}d), {n}_my AS (SELECT {k}t, {mean.format(c='y')} AS my FROM {n}_y GROUP BY {k}t),
  {n}_c AS (SELECT {k}rid, d, x - mx AS x FROM {n}_f JOIN {n}_m USING ({k}d)), {n}_yc AS (SELECT {k}rid, t, y - my AS y FROM {n}_y JOIN {n}_my USING ({k}t)),
  {n}_p AS (SELECT {k}max(d) AS p FROM {n}_f {'GROUP BY ' + ', '.join(by) if by else ''}),
  {n}_g AS (SELECT {k}a.d AS i, b.d AS j, sum(a.x * b.x) AS s FROM {n}_c a JOIN {n}_c b USING ({k}rid) GROUP BY ALL
    UNION ALL SELECT {k}d, p + t, sum(x * y) FROM {n}_c JOIN {n}_yc USING ({k}rid) JOIN {n}_p {on} GROUP BY {k}d, p + t),
  {n}_r AS (SELECT {k}alpha, i, list(s + CASE WHEN i = j THEN alpha ELSE 0 END ORDER BY j) AS r FROM {n}_g, (SELECT unnest({[float(a) for a in alphas]}::DOUBLE[]) AS alpha) GROUP BY {k}alpha, i),
  {n}_s AS (SELECT {k}alpha, 1 AS k, list(r ORDER BY i) AS m FROM {n}_r GROUP BY {k}alpha
    UNION ALL SELECT {k}alpha, k + 1, list_transform(m, lambda r, i: CASE WHEN i = k THEN list_transform(r, lambda x: x / r[k])
      ELSE list_transform(r, lambda x, j: x - r[k] * m[k][j] / m[k][k]) END) FROM {n}_s WHERE k <= len(m)),
  {n}_e AS (SELECT {k}alpha, m, unnest(range(1, len(m) + 1)) AS d FROM {n}_s WHERE k = len(m) + 1),
  {n}_w AS (SELECT {k}alpha, t, d, m[d][len(m) + t] AS w FROM (SELECT {k}alpha, m, d, unnest(range(1, len(m[d]) - len(m) + 1)) AS t FROM {n}_e))"""
