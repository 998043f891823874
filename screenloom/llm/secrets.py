"""Secret scans: fixed patterns, and sliding-window Shannon entropy over candidate strings.

Everything is an expression on one text, so the scan is a single narrow stage.  A text that a pattern's plain test does not
find costs one regular-expression pass for that pattern and nothing more.
"""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

# The base patterns and the least lengths of what they find.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST = {"assign": 6, "access": 20, "hex": 24}

#: kind: candidate runs, alphabet, window, least entropy in bits, what a candidate must contain.
CLASSES = {
    "entropy_hex": (r"[0-9A-Fa-f]{24,}", "0123456789abcdef", 24, 2.9, (r"[0-9]", r"[A-Fa-f]")),
    "entropy_alnum": (r"[A-Za-z0-9]{24,}", "0123456789abcdefghijklmnopqrstuvwxyz", 24, 3.7, (r"[0-9].*[0-9]", r"[A-Za-z].*[A-Za-z]")),
    "entropy_base64": (
        r"[A-Za-z0-9+/_-]{24,}={0,2}", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_=", 24, 3.9,
        (r"[0-9]", r"[A-Z]", r"[a-z]"),
    ),
}
KINDS = ["assign", "access", "hex", *CLASSES]
#: Candidates that hold one of these are not secrets: identifiers with a public form, placeholders, counted-up alphabets.
ALLOWED = (
    r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}",
    r"(?i:example|sample|dummy|placeholder|changeme|your[_-]?(key|token|secret))",
    r"(?i:0123456789|abcdefghijkl|xxxxxx|000000)",
)
#: c * log2(c) in units of 1e-6, so that running sums are exact.
UNIT = 1_000_000
MASK = "[SECRET]"


def weight(count: int) -> int:
    return round(count * math.log2(count) * UNIT) if count else 0


def most_weight(window: int, bits: float) -> int:
    """A window has at least ``bits`` of entropy when the weights of its counts sum to no more than this."""
    return math.floor((math.log2(window) - bits) * window * UNIT)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def located(text: Column, pattern: str) -> Column:
    """Leftmost matches that do not overlap, as structs ``s, e, hit``: code points from ``s`` to before ``e``.

    The texts between the matches and the matches themselves alternate, so their lengths give the places."""
    none = F.array().cast("array<struct<s:bigint,e:bigint,hit:string>>")
    empty = F.struct(F.lit(0).cast("bigint").alias("at"), none.alias("out"))

    def step(acc, x):
        s = acc["at"] + F.length(x["gap"])
        e = s + F.length(x["hit"])
        return F.struct(e.alias("at"), F.concat(acc["out"], F.array(F.struct(s.alias("s"), e.alias("e"), x["hit"].alias("hit")))).alias("out"))

    def walk(hits):
        gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(hits))
        pairs = F.zip_with(gaps, hits, lambda g, h: F.struct(g.alias("gap"), h.alias("hit")))
        return F.aggregate(pairs, empty, step, lambda acc: acc["out"])

    found = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), walk)
    return F.when(F.rlike(text, F.lit(pattern)), found).otherwise(none)


def spans(found: Column, kind: str) -> Column:
    """Matches as structs that sort by start, then kind, then end."""
    place = F.lit(KINDS.index(kind))
    return F.transform(found, lambda m: F.struct(m["s"].alias("s"), place.alias("k"), m["e"].alias("e")))


def base_spans(text: Column) -> Column:
    value = lambda m: F.length(F.regexp_extract(m["hit"], ASSIGN, 2)) >= LEAST["assign"]
    # a run is maximal, so the least length may stand in the pattern
    at_least = lambda p, n: p.replace("+", f"{{{n},}}")
    return F.array_sort(
        F.concat(
            spans(F.filter(located(text, ASSIGN), value), "assign"),
            spans(located(text, at_least(ACCESS, LEAST["access"] - len("AKIA"))), "access"),
            spans(located(text, at_least(HEX, LEAST["hex"])), "hex"),
        )
    )


def entropy_range(run: Column, alphabet: str, window: int, bits: float) -> Column:
    """``first, last``: offsets of the first window with enough entropy and of the end of the last, or nulls.

    One pass over the characters; each step adds one count, drops one and corrects the sum of count weights by the two."""
    weights = F.array(*[F.lit(weight(c)).cast("bigint") for c in range(window + 2)])
    at = lambda counts, x: F.coalesce(F.get(counts, x), F.lit(0))
    fold = F.lower(run) if alphabet == alphabet.lower() else run
    start = F.struct(
        F.array_repeat(F.lit(0), len(alphabet)).alias("counts"), F.lit(0).cast("bigint").alias("sum"),
        F.lit(None).cast("int").alias("first"), F.lit(None).cast("int").alias("last"),
    )

    def walk(codes):
        def step(acc, i):
            new = F.get(codes, i)
            old = F.when(i >= window, F.get(codes, i - window)).otherwise(F.lit(-1))
            counts, up, down = acc["counts"], at(acc["counts"], new), at(acc["counts"], old)
            moved = F.transform(counts, lambda c, j: c + (j == new).cast("int") - (j == old).cast("int"))
            change = F.get(weights, up + 1) - F.get(weights, up)
            change = change + F.when(old >= 0, F.get(weights, down - 1) - F.get(weights, down)).otherwise(F.lit(0))
            total = acc["sum"] + F.when(new == old, F.lit(0)).otherwise(change)
            ok = (i >= window - 1) & (total <= most_weight(window, bits))
            return F.struct(
                F.when(new == old, counts).otherwise(moved).alias("counts"), total.alias("sum"),
                F.coalesce(acc["first"], F.when(ok, i - (window - 1))).alias("first"),
                F.when(ok, i + 1).otherwise(acc["last"]).alias("last"),
            )

        return F.aggregate(F.sequence(F.lit(0), F.size(codes) - 1), start, step, lambda a: F.struct(a["first"].alias("first"), a["last"].alias("last")))

    codes = F.transform(F.split(fold, ""), lambda c: F.instr(F.lit(alphabet), c) - 1)
    return let(F.filter(codes, lambda c: c >= 0), walk)


def entropy_spans(text: Column, kind: str, allow: tuple[str, ...] = ()) -> Column:
    """Runs of one character class in which some window has enough entropy, cut to those windows; allowed ones suppressed."""
    pattern, alphabet, window, bits, needs = CLASSES[kind]

    def wanted(m):
        ok = F.lit(True)
        for need in needs:
            ok = ok & F.rlike(m["hit"], F.lit(need))
        for allowed in ALLOWED:
            ok = ok & ~F.rlike(m["hit"], F.lit(allowed))
        return ok & ~m["hit"].isin(*allow) if allow else ok

    measured = F.transform(
        F.filter(located(text, pattern), wanted),
        lambda m: F.struct(m["s"].alias("s"), entropy_range(m["hit"], alphabet, window, bits).alias("r")),
    )
    passed = F.filter(measured, lambda m: m["r"]["first"].isNotNull())
    return spans(F.transform(passed, lambda m: F.struct((m["s"] + m["r"]["first"]).alias("s"), (m["s"] + m["r"]["last"]).alias("e"))), kind)


def _outside(found: Column):
    return lambda x: ~F.exists(found, lambda b: (b["s"] <= x["s"]) & (b["e"] >= x["e"]))


def with_spans(docs: DataFrame, text: str, base: str, every: str, allow: tuple[str, ...] = ()) -> DataFrame:
    """Add the base spans and all spans of column ``text``; an added span never lies inside an earlier kind's."""
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    out = docs.withColumn(base, base_spans(whole))
    found = F.col(base)
    for kind in CLASSES:
        out = out.withColumn(f"_{kind}", F.filter(entropy_spans(whole, kind, allow), _outside(found)))
        found = F.concat(found, F.col(f"_{kind}"))
    return out.withColumn(every, F.array_sort(found)).drop(*[f"_{k}" for k in CLASSES])


def listed(found: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", F.get(kinds, x["k"]), x["s"], x["e"])), ",")


def secret_scan(docs: DataFrame, allow: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id``, the number of base spans of each kind, a digest of the base spans, and all spans, for every row.

    ``docs`` needs ``doc_id`` and ``text``; other columns are ignored.  ``allow`` lists candidate strings that are never
    reported by entropy.  Null text counts as empty and has no span (the digest is that of the empty string); a null
    ``doc_id`` stays null; repeated rows are scanned each; an empty table gives no rows.
    """
    plain = docs.select(F.col("doc_id"), F.col("text"))
    scanned = with_spans(plain, "text", "_base", "_all", allow)
    count = lambda kind: F.size(F.filter("_base", lambda x: x["k"] == KINDS.index(kind))).cast("bigint")
    return scanned.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(listed(F.col("_base")), 256).alias("base_sha256"), listed(F.col("_all")).alias("spans"),
    )


def masked(text: Column, found: Column) -> Column:
    """``text`` with every stretch of overlapping spans replaced by one mask."""
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))

    def step(acc, x):
        fresh = F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), (x["s"] - acc["at"]).cast("int")), F.lit(MASK))
        out = F.when((x["s"] < acc["at"]), acc["out"]).otherwise(fresh)
        return F.struct(F.greatest(acc["at"], x["e"]).alias("at"), out.alias("out"))

    rest = lambda acc: F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), F.lit(2147483647)))
    return F.when(F.size(found) > 0, F.aggregate(found, start, step, rest)).otherwise(text)


def redact(docs: DataFrame, allow: tuple[str, ...] = ()) -> DataFrame:
    """``docs`` with every secret in ``text`` masked and ``n_chars``, where there is one, counted again.

    Every row and column stays; a text without secrets, null included, stays as it is."""
    names = [f"_c{i}" for i in range(len(docs.columns))]
    text = F.col(names[docs.columns.index("text")])
    scanned = with_spans(docs.toDF(*names), names[docs.columns.index("text")], "_base", "_all", allow)
    changed = {"text": F.when(F.size("_all") > 0, masked(text, F.col("_all"))).otherwise(text)}
    if "n_chars" in docs.columns:
        old, kind = F.col(names[docs.columns.index("n_chars")]), dict(docs.dtypes)["n_chars"]
        changed["n_chars"] = F.when(F.size("_all") > 0, F.length(masked(text, F.col("_all"))).cast(kind)).otherwise(old)
    return scanned.select(*[changed.get(c, F.col(n)).alias(c) for c, n in zip(docs.columns, names)])
