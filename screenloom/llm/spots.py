"""Document fingerprints from chains of content words behind common words (SpotSigs).

A signature is a common word (the anchor) and the next ``CHAIN`` words that are not common.  Texts are compared by the Jaccard
likeness of their signature sets; sets of very different length cannot be alike, so a search only compares sets of
neighbouring length partitions.  Only DataFrame functions are used.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from screenloom.llm.secrets import let
from screenloom.session import durable

# Common words of four languages.
ANCHORS = {
    "en": "the of and to in a is that it for on was as with be by are this at an from or have which not",
    "de": "der die das und in den von zu mit sich ist des auf für im dem nicht ein eine als auch es an",
    "fr": "le la les de des du et un une est que qui en dans pour sur au par plus ne pas ce avec il",
    "es": "el la los las de del y en un una que es se no por con para su al lo como más o",
}
CHAIN = 3
_COMMON = sorted({w for ws in ANCHORS.values() for w in ws.split()})
#: Stands between an anchor and what follows it.
_TIE = "\u0001"


def normal(text: Column) -> Column:
    """Lower-case runs of letters and digits, one space between."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def _runs(plain: Column) -> Column:
    """Hash of every ``CHAIN`` words in a row, common or not."""
    words = F.split(plain, " ")
    starts = lambda w: F.sequence(F.lit(0), F.size(w) - CHAIN)
    chain = lambda w, j: F.concat_ws(" ", *[F.get(w, j + i) for i in range(CHAIN)])
    return let(words, lambda w: F.when(F.size(w) >= CHAIN, F.transform(starts(w), lambda j: F.xxhash64(chain(w, j)))))


def _chains(plain: Column, gaps: bool = False) -> Column:
    """Hash of each anchor with its chain, in time linear in the text however the anchors lie.

    Anchors are tied to the word behind them, so a split at spaces gives one unit for each content word: the anchors
    before it, then the word.  All of them have the chain that begins with that word.  With ``gaps`` a content word that has no
    spot within ``CHAIN`` content words on either side is a spot without anchor, by its chain alone; as the rule looks at the
    neighbours only, an edit changes nothing farther off."""
    tied = F.transform(F.split(plain, " "), lambda w: F.concat(w, F.when(w.isin(*_COMMON), _TIE).otherwise(" ")))

    def of_units(units):
        def of_words(words):
            # behind the last content word there is one unit without any
            last = F.size(units) - 1 - (CHAIN - 1)
            at = F.slice(F.sequence(F.lit(0), F.greatest(last, F.lit(1)) - 1), F.lit(1), F.greatest(last, F.lit(0)))
            spot = lambda j: F.contains(F.get(units, j), F.lit(_TIE))

            def lone(flags, j):
                near = F.lit(False)
                for i in range(1, CHAIN + 1):
                    near = near | F.coalesce(F.get(flags, j - i), F.lit(False)) | F.coalesce(F.get(flags, j + i), F.lit(False))
                return ~near

            if gaps:
                spots = let(F.transform(at, spot), lambda flags: F.filter(at, lambda j: F.get(flags, j) | lone(flags, j)))
            else:
                spots = F.filter(at, spot)

            def signs(j):
                chain = F.concat_ws(" ", *[F.get(words, j + i) for i in range(CHAIN)])
                anchors = F.split(F.get(units, j), _TIE)
                anchors = F.array_distinct(F.slice(anchors, F.lit(1), F.size(anchors) - 1))
                tied_to = lambda c: F.transform(anchors, lambda a: F.xxhash64(F.concat_ws(" ", a, c)))
                if not gaps:
                    return let(chain, tied_to)
                return let(chain, lambda c: F.when(spot(j), tied_to(c)).otherwise(F.array(F.xxhash64(c))))

            return F.flatten(F.transform(spots, signs))

        return let(F.transform(units, lambda u: F.substring_index(u, _TIE, -1)), of_words)

    return let(F.split(F.array_join(tied, ""), " "), of_units)


def signatures(text: Column, gaps: bool = False) -> Column:
    """Sorted distinct 64-bit signatures.  A text without any spot has one, of all its words; one without words has none.

    With ``gaps`` stretches without spots have signatures too, a text of fewer than ``CHAIN`` content words those of all its
    runs of ``CHAIN`` words, and only a text of fewer words one of them all."""

    def of(plain):
        found = F.sort_array(F.array_distinct(_chains(plain, gaps)))
        whole = F.when(plain != "", F.array(F.xxhash64(plain))).otherwise(F.array().cast("array<bigint>"))
        if gaps:
            whole = F.coalesce(F.sort_array(F.array_distinct(_runs(plain))), whole)
        return let(found, lambda f: F.when(F.size(f) > 0, f).otherwise(whole))

    return let(normal(text), of)


def fingerprint(signs: Column) -> Column:
    return F.array_join(F.transform(signs, lambda s: F.hex(s)), " ")


def likeness(a: Column, b: Column, least: float = 0.0) -> Column:
    """Jaccard likeness of two signature sets; 0 without a look at the sets where their lengths alone put it below ``least``.

    Two empty sets are alike."""
    small, large = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    both = F.size(F.array_intersect(a, b))
    exact = F.transform(F.array(both), lambda n: n / (F.size(a) + F.size(b) - n))[0]
    return (
        F.when(large == 0, F.lit(1.0)).when((small == 0) | (small < large * F.lit(least)), F.lit(0.0)).otherwise(exact)
    )


def with_next(docs: DataFrame) -> DataFrame:
    """Add ``next_text``: the text of the next row in descending ``doc_id``, of the first row after the last.

    Rows are cut into ranges of ids; the head of each following range is added as a guest, so a window over a range sees its
    successor and no task holds more than a range.  Null ids come last; equal ids go by text, descending.
    """
    spark = docs.sparkSession
    parts = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    cuts = docs.where(F.col("doc_id").isNotNull()).approxQuantile("doc_id", [i / parts for i in range(1, parts)], 0.2 / parts)
    cuts = sorted({int(c) for c in cuts})  # fewer than ``parts`` numbers
    bounds = F.array(*[F.lit(c).cast("bigint") for c in cuts]) if cuts else F.array().cast("array<bigint>")
    below = F.aggregate(bounds, F.lit(0), lambda n, b: n + F.when(F.col("doc_id") >= b, 1).otherwise(0))
    ranged = docs.withColumn("part", below)
    # ids of the heads: one per range
    heads = ranged.groupBy("part").agg(F.max("doc_id").alias("doc_id"))
    heads = [(r["part"], r["doc_id"]) for r in heads.collect()]  # at most ``parts`` rows
    heads = sorted(heads, reverse=True)
    follows = [(heads[i - 1][0], heads[i][1]) for i in range(len(heads))]  # the range before wants this head
    guests = spark.createDataFrame(follows, "part int, doc_id bigint")
    # at most ``parts`` ids, so they go to the texts and not the texts to them
    guests = docs.join(F.broadcast(guests.withColumnRenamed("doc_id", "_id")), F.col("_id").eqNullSafe(F.col("doc_id")))
    guests = guests.groupBy("part").agg(F.max("text").alias("text"))
    every = ranged.select("part", "doc_id", "text", F.lit(0).alias("guest")).unionByName(
        guests.select("part", F.lit(None).cast("bigint").alias("doc_id"), "text", F.lit(1).alias("guest"))
    )
    order = Window.partitionBy("part").orderBy("guest", F.desc_nulls_last("doc_id"), F.desc("text"))
    return every.withColumn("next_text", F.lead("text").over(order)).where(F.col("guest") == 0).select("doc_id", "text", "next_text")


def fingerprints(docs: DataFrame, gaps: bool = False) -> DataFrame:
    """``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next`` for every row of ``docs``.

    ``docs`` needs ``doc_id`` and ``text``; other columns are ignored.  The edited text ends in the first third (rounded down)
    of as many code points of the next document by descending id.  Null text counts as empty; a single row is its own
    successor.  Rows that repeat an id follow each other by text, descending; a null id comes last.  Texts equal
    after normalisation have equal fingerprints.  An empty table gives no rows.  ``gaps`` is that of :func:`signatures`.
    """
    plain = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    n = F.length("text")
    moved = F.floor(n / 3).cast("int")
    joined = with_next(plain)
    edited = joined.select(
        "doc_id", "text", "next_text", n.cast("bigint").alias("n_chars"),
        F.concat(F.substring("text", F.lit(1), n - moved), F.substring("next_text", F.lit(1), moved)).alias("edited"),
    )
    signed = edited.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), signatures(F.col("text"), gaps).alias("own"),
        signatures(F.col("edited"), gaps).alias("changed"), signatures(F.col("next_text"), gaps).alias("following"),
    )
    return signed.select(
        "doc_id", "n_chars", "edited_sha256", fingerprint(F.col("own")).alias("fingerprint"),
        fingerprint(F.col("changed")).alias("edited_fingerprint"), likeness(F.col("own"), F.col("changed")).alias("near_edited"),
        likeness(F.col("own"), F.col("following")).alias("near_next"),
    )


def similar_pairs(docs: DataFrame, least: float = 0.8, gaps: bool = False) -> tuple[DataFrame, DataFrame]:
    """Pairs of different fingerprints with a likeness of ``least`` or more, and which document has which.

    Gives ``(a, b, likeness)`` over the smallest ``doc_id`` of each fingerprint, and ``(doc_id, representative)``.  Sets are
    dealt to length partitions whose bounds grow by 1 / ``least``, so likely partners sit in the same or the next one; there
    they meet on one of the rarest signatures, of which each set needs only so many that two alike sets share one.  Copies
    are compared once.  Texts without words, and rows without id, have no partners.  ``gaps`` is that of :func:`signatures`.
    """
    plain = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    signed = durable(plain.where(F.col("doc_id").isNotNull()).select("doc_id", signatures(F.col("text"), gaps).alias("signs")))
    signed = signed.withColumn("print", F.sha2(fingerprint(F.col("signs")), 256))
    named = durable(signed.groupBy("print").agg(F.min("doc_id").alias("representative")))
    members = signed.join(named, "print").select("doc_id", "representative")
    sets = signed.join(named, "print").where(F.col("doc_id") == F.col("representative")).dropDuplicates(["print"])
    sets = durable(sets.where(F.size("signs") > 0).select(F.col("doc_id").alias("id"), "signs", F.size("signs").alias("n")))
    part = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1 / least)) + F.lit(1e-9)).cast("int")
    items = sets.select("id", "n", part.alias("part"), F.explode("signs").alias("sign"))
    common = items.groupBy("sign").agg(F.count(F.lit(1)).alias("df"))
    rare = Window.partitionBy("id").orderBy("df", "sign")
    prefix = F.col("n") - F.ceil(F.col("n") * F.lit(least) - F.lit(1e-9)) + 1
    ranked = items.join(common, "sign").withColumn("at", F.row_number().over(rare))
    # a signature that no other set has leads nowhere, but counts as one of the rarest
    heads = durable(ranked.where((F.col("at") <= prefix) & (F.col("df") > 1)).select("id", "n", "part", "sign"))
    left = heads.select(F.col("id").alias("a"), F.col("n").alias("na"), "sign", F.explode(F.array("part", F.col("part") + 1)).alias("part"))
    right = heads.select(F.col("id").alias("b"), F.col("n").alias("nb"), "sign", "part")
    fits = (F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b")))
    met = left.join(right, ["sign", "part"]).where(fits & (F.col("na") >= F.col("nb") * F.lit(least) - F.lit(1e-9)))
    pairs = met.select("a", "b").distinct()
    one = sets.select(F.col("id").alias("a"), F.col("signs").alias("sa"))
    two = sets.select(F.col("id").alias("b"), F.col("signs").alias("sb"))
    alike = pairs.join(one, "a").join(two, "b").select("a", "b", likeness(F.col("sa"), F.col("sb"), least).alias("likeness"))
    return alike.where(F.col("likeness") >= least), members

