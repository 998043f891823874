"""DuckDB SQL for the operators that SQL can express over whole tables."""
from __future__ import annotations

from screenloom.llm import chat, licenses, mixing, phrases, secrets, winnow

_ANY_CASE = lambda w: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w)
_NAMES = "|".join([*map(_ANY_CASE, ("password", "passwd", "secret", "token")), _ANY_CASE("api") + "_?" + _ANY_CASE("key")])


def _op1() -> str:
    """Places from the lengths of matches and of what lies between; entropy counted anew in every window."""
    assign = rf"""({_NAMES})["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
    plain = {
        "assign": (assign, f"length(regexp_extract(hit, '{assign}', 2)) >= {secrets.LEAST['assign']}"),
        "access": (secrets.ACCESS, f"length(hit) >= {secrets.LEAST['access']}"),
        "hex": (secrets.HEX, f"length(hit) >= {secrets.LEAST['hex']}"),
    }

    def located(kind: str, pattern: str, ok: str) -> str:
        return f"""
  {kind}_cut AS (SELECT doc_id, regexp_extract_all(t, '{pattern}', 0) AS hits, string_split_regex(t, '{pattern}') AS gaps FROM d),
  {kind}_row AS (SELECT doc_id, unnest(hits) AS hit, unnest(gaps[1:len(hits)]) AS gap, unnest(range(len(hits))) AS i FROM {kind}_cut),
  {kind} AS (SELECT * FROM (SELECT doc_id, hit, sum(length(gap) + length(hit)) OVER (PARTITION BY doc_id ORDER BY i) - length(hit) AS s
             FROM {kind}_row) WHERE {ok})"""

    parts = [located(k, *v) for k, v in plain.items()]
    found = [f"SELECT doc_id, s, {i} AS k, s + length(hit) AS e FROM {k}" for i, k in enumerate(plain)]
    parts.append("\n  base AS (" + " UNION ALL ".join(found) + ")")
    earlier = "base"
    for kind, (pattern, alphabet, window, bits, needs) in secrets.CLASSES.items():
        ok = " AND ".join([f"regexp_matches(hit, '{n}')" for n in needs] + [f"NOT regexp_matches(hit, '{a}')" for a in secrets.ALLOWED])
        fold = "lower(hit)" if alphabet == alphabet.lower() else "hit"
        weights = ", ".join(str(secrets.weight(c)) for c in range(1, window + 1))
        parts.append(located(kind, pattern, ok))
        parts.append(f"""
  {kind}_win AS (SELECT doc_id, s, hit, unnest(range(length(hit) - {window} + 1)) AS o FROM {kind}),
  {kind}_chr AS (SELECT doc_id, s, o, unnest(string_split(substr({fold}, o + 1, {window}), '')) AS c FROM {kind}_win),
  {kind}_sum AS (SELECT doc_id, s, o, sum([{weights}][n]) AS w FROM
    (SELECT doc_id, s, o, c, count(*) AS n FROM {kind}_chr GROUP BY ALL) GROUP BY ALL),
  {kind}_rng AS (SELECT doc_id, s + min(o) AS s, {secrets.KINDS.index(kind)} AS k, s + max(o) + {window} AS e
    FROM {kind}_sum x WHERE w <= {secrets.most_weight(window, bits)} GROUP BY doc_id, x.s),
  {kind}_all AS (SELECT * FROM {earlier} UNION ALL SELECT doc_id, s, k, e FROM {kind}_rng r WHERE NOT EXISTS
    (SELECT 1 FROM {earlier} b WHERE b.doc_id = r.doc_id AND b.s <= r.s AND b.e >= r.e))""")
        earlier = f"{kind}_all"
    names = "[" + ", ".join(f"'{k}'" for k in secrets.KINDS) + "]"
    lst = f"string_agg({names}[k + 1] || ':' || s::BIGINT || ':' || e::BIGINT, ',' ORDER BY s, k, e)"
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),{",".join(parts)},
  n AS (SELECT doc_id, count(*) FILTER (k = 0) AS a, count(*) FILTER (k = 1) AS b, count(*) FILTER (k = 2) AS c, {lst} AS l FROM base GROUP BY 1),
  m AS (SELECT doc_id, {lst} AS l FROM {earlier} GROUP BY 1)
SELECT d.doc_id, coalesce(a, 0) AS n_assign, coalesce(b, 0) AS n_access, coalesce(c, 0) AS n_hex,
  sha256(coalesce(n.l, '')) AS base_sha256, coalesce(m.l, '') AS spans
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)"""


def _op5() -> str:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    words = f"regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '{winnow.WORD}')"
    cut = "SELECT {id}, w, n, unnest(range(len(w) - n + 1)) AS i FROM {src} WHERE len(w) >= n"
    return f"""WITH b AS (SELECT item_id, w, least(len(w), {winnow.SPAN}) AS n FROM (SELECT item_id, {words} AS w FROM benchmark) WHERE len(w) > 0),
  bw AS (SELECT DISTINCT item_id, array_to_string(w[i + 1 : i + n], ' ') AS g, n FROM ({cut.format(id="item_id", src="b")})),
  d AS (SELECT doc_id, {words} AS w FROM documents),
  dn AS (SELECT doc_id, w, n FROM d, (SELECT DISTINCT n FROM bw)),
  dw AS (SELECT doc_id, i, n, array_to_string(w[i + 1 : i + n], ' ') AS g FROM ({cut.format(id="doc_id", src="dn")})),
  hit AS (SELECT doc_id, i, dw.n, item_id FROM dw JOIN bw ON dw.g = bw.g AND dw.n = bw.n),
  pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY 1),
  it AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(x, ',' ORDER BY x)) AS h FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM hit) GROUP BY 1)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  coalesce(h, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN it USING (doc_id)"""


def _op6() -> str:
    """Shares level by level, then one running sum per leaf."""
    id_ = "coalesce(doc_id::VARCHAR, '')"
    parts, above = [], []
    for level in mixing.LEVELS:
        path = [*above, level]
        cols = ", ".join(path)
        same = " AND ".join(f"c.{c} IS NOT DISTINCT FROM p.{c}" for c in above) or "true"
        over = f"PARTITION BY {', '.join(above)}" if above else ""
        parent = f"s_{above[-1]}" if above else "s_"
        keep = ", ".join(f"c.{c}" for c in path)
        weight = " ".join(f"WHEN '{name}' THEN {w}" for name, w in mixing.WEIGHTS[level].items())
        parts.append(f"""
  c_{level} AS (SELECT {keep}, c.capacity, CASE c.{level} {weight} ELSE 1 END::BIGINT AS weight, p.share FROM (SELECT {cols}, sum(capacity)::BIGINT AS capacity FROM leaves GROUP BY ALL) c
    JOIN {parent} p ON {same}),
  o_{level} AS (SELECT *, sum(weight) OVER ({over}) AS aw, coalesce(sum(capacity) OVER e, 0) AS cb, coalesce(sum(weight) OVER e, 0) AS wb
    FROM c_{level} WINDOW e AS ({over} ORDER BY capacity / weight, {level} NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  f_{level} AS (SELECT *, cb * weight + capacity * (aw - wb) <= share * weight AS isfull FROM o_{level}),
  g_{level} AS (SELECT *, coalesce(sum(capacity) FILTER (isfull) OVER ({over}), 0) AS cf, coalesce(sum(weight) FILTER (isfull) OVER ({over}), 0) AS wf FROM f_{level}),
  s_{level} AS (SELECT {cols}, CASE WHEN isfull THEN capacity ELSE ((weight * (share - cf)) // nullif(aw - wf, 0)) END::BIGINT AS share FROM g_{level})""")
        above = path
    leaf = ", ".join(mixing.LEVELS)
    on = " AND ".join(f"l.{c} IS NOT DISTINCT FROM s.{c}" for c in mixing.LEVELS)
    on2 = " AND ".join(f"r.{c} IS NOT DISTINCT FROM q.{c}" for c in mixing.LEVELS)
    # crc32 is not in DuckDB: the bits of the polynomial, byte by byte
    crc = (
        "list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(octet_length(encode(coalesce(source, '')))), "
        "lambda i: ascii(substr(coalesce(source, ''), (i + 1)::INT, 1))::BIGINT)), lambda a, x: "
        "list_reduce([xor(a, x), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END))"
    )
    return f"""WITH named AS (SELECT doc_id, lang, source, 'd' || (xor({crc}, 4294967295) % 4) AS domain,
    len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS n_tokens, md5('{mixing.SEED}:' || {id_}) AS place FROM documents),
  r AS (SELECT * FROM named WHERE n_tokens > 0),
  leaves AS (SELECT {leaf}, sum(n_tokens)::BIGINT AS tokens, (sum(n_tokens) * {mixing.MOST_EPOCHS})::BIGINT AS capacity FROM r GROUP BY ALL),
  s_ AS (SELECT least(sum(capacity), sum(tokens) * {mixing.BUDGET_PERCENT} // 100)::BIGINT AS share FROM leaves),{",".join(parts)},
  q AS (SELECT l.*, share // tokens AS whole, share % tokens AS rest FROM leaves l JOIN s_{mixing.LEVELS[-1]} s ON {on}),
  t AS (SELECT r.doc_id, {", ".join("r." + c for c in mixing.LEVELS)}, n_tokens, whole, rest,
    sum(n_tokens) OVER (PARTITION BY {", ".join("r." + c for c in mixing.LEVELS)} ORDER BY place, {id_.replace("doc_id", "r.doc_id")}, n_tokens) AS upto,
    sum(n_tokens) OVER (PARTITION BY {", ".join("r." + c for c in mixing.LEVELS)}, place, r.doc_id, n_tokens) AS own
    FROM r JOIN q ON {on2})
SELECT doc_id, {leaf}, n_tokens::BIGINT AS n_tokens, (whole + CASE WHEN upto - own < rest THEN 1 ELSE 0 END)::INTEGER AS epochs FROM t
WHERE whole + CASE WHEN upto - own < rest THEN 1 ELSE 0 END > 0"""


def _op9() -> str:
    """Turn by turn; the tie-breaking hash is not in DuckDB, and the given tables have no ties."""
    esc = lambda x: f"regexp_replace({x}, '<(\\\\*)\\|', '<\\\\\\1|', 'g')"
    lit = lambda x: "'" + x.replace("\n", "' || chr(10) || '") + "'"
    return f"""WITH t AS (SELECT conv_id, turn, coalesce(role, '{chat.NOBODY}') AS name, coalesce(text, '') AS text FROM conversations),
  o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, name) - 1 AS pos FROM t),
  p AS (SELECT DISTINCT conv_id, name AS perspective FROM t),
  r AS (SELECT o.conv_id, perspective, pos // {chat.SEGMENT} AS segment, pos, name = perspective AS mine,
    CASE WHEN name = perspective THEN {lit(chat.ASSISTANT)} ELSE {lit(chat.USER)} || {esc("name")} || {lit(chat.CLOSE)} END AS head,
    {esc("text")} || {lit(chat.END)} AS body FROM o JOIN p ON o.conv_id IS NOT DISTINCT FROM p.conv_id),
  s AS (SELECT *, sum(length(head) + length(body)) OVER (PARTITION BY conv_id, perspective, segment ORDER BY pos) AS stop FROM r)
SELECT conv_id, perspective, segment, count(*) AS n_turns, count(*) FILTER (mine) AS n_own, string_agg(head || body, '' ORDER BY pos) AS text,
  coalesce(string_agg((stop - length(body))::BIGINT || ':' || (stop - 1)::BIGINT, ',' ORDER BY pos) FILTER (mine), '') AS mask
FROM s GROUP BY conv_id, perspective, segment"""


def _op10() -> str:
    """Every shingle of every text against every shingle of every notice."""
    k = licenses.SHINGLE
    rows = [
        f"({i}, '{name}', '{' '.join(w[j : j + k])}')" for i, (name, text) in enumerate(licenses.NOTICES)
        for w in [licenses.plain_words(text)] for j in range(len(w) - k + 1)
    ]
    return f"""WITH n(notice, license, g) AS (SELECT DISTINCT * FROM (VALUES {", ".join(rows)})),
  size AS (SELECT notice, count(*) AS m FROM n GROUP BY 1),
  d AS (SELECT doc_id, string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' ') AS w FROM documents),
  s AS (SELECT DISTINCT doc_id, array_to_string(w[i + 1 : i + {k}], ' ') AS g FROM (SELECT doc_id, w, unnest(range(len(w) - {k - 1})) AS i FROM d WHERE len(w) >= {k})),
  f AS (SELECT doc_id, license, count(*) / m AS share FROM s JOIN n USING (g) JOIN size USING (notice) GROUP BY doc_id, notice, license, m HAVING count(*) / m >= {licenses.LEAST})
SELECT d.doc_id, count(DISTINCT license) AS n_licenses, coalesce(string_agg(DISTINCT license, ',' ORDER BY license), '') AS licenses,
  coalesce(max(share), 0.0)::DOUBLE AS containment FROM d LEFT JOIN f USING (doc_id) GROUP BY d.doc_id"""


def _op13() -> str:
    return """WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  s AS (SELECT a.vec_id AS anchor_id, c.vec_id AS other, a.label = c.label AS same, list_dot_product(a.q, c.q)::BIGINT AS score
    FROM v a JOIN v c ON a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id),
  p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER w)::INTEGER AS rank, other AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other) QUALIFY row_number() OVER w <= 10"""


def _op12() -> str:
    """Every phrase of every piece counted; HUGEINT holds the products."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    grams = "SELECT lang, {k} AS k, array_to_string(w[i + 1 : i + {k}], ' ') AS phrase, count(*) AS a FROM " \
        "(SELECT lang, w, unnest(range(len(w) - {k} + 1)) AS i FROM p WHERE len(w) >= {k}) GROUP BY ALL"
    every = " UNION ALL ".join(grams.format(k=k) for k in range(1, phrases.LONGEST + 1))
    return f"""WITH t AS (SELECT coalesce(lang, '{phrases.NO_LANG}') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), '{upper}', '{lower}'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
  p AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM t),
  g AS ({every}),
  n AS (SELECT lang, sum(a)::BIGINT AS n FROM g WHERE k = 1 GROUP BY 1),
  f AS MATERIALIZED (SELECT * FROM g WHERE a >= {phrases.THRESHOLD}),
  c AS (SELECT lang, k, phrase, a, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
  i AS (SELECT lang, k - 1 AS k, unnest([array_to_string(w[1 : k - 1], ' '), array_to_string(w[2 : k], ' ')]) AS phrase, a FROM c WHERE k > 2),
  j AS (SELECT lang, phrase, max(a) AS most FROM i GROUP BY ALL),
  o AS (SELECT c.*, unnest(range(1, k)) AS cut FROM c LEFT JOIN j USING (lang, phrase) WHERE most IS NULL OR 100 * most < 100 * a),
  s AS (SELECT o.lang, o.phrase, o.a, cut, x.a AS l, y.a AS r, n, ((1000::HUGEINT * o.a * n) // (x.a::HUGEINT * y.a))::BIGINT AS score FROM o
    JOIN f x ON x.lang = o.lang AND x.phrase = array_to_string(w[1 : cut], ' ')
    JOIN f y ON y.lang = o.lang AND y.phrase = array_to_string(w[cut + 1 : o.k], ' ') JOIN n ON n.lang = o.lang),
  b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1)
SELECT lang, row_number() OVER w AS rank, phrase, a, l, r, n, score FROM b
WINDOW w AS (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) QUALIFY row_number() OVER w <= {phrases.TOP}"""


ORACLES: dict[str, str] = {
    "op12_phrase_collocations": _op12(),
    "op13_hard_negatives": _op13(),
    "op9_chat_formatting": _op9(), "op10_license_scans": _op10(),
    "op1_secret_scans": _op1(), "op5_benchmark_decontamination": _op5(), "op6_source_mixing": _op6(),
}
