"""Language-model scores from a class-based bigram model.

Words fall into classes by exchange clustering.  The most frequent ones are exchanged one by one on the driver, as a start;
every other word starts in a class of its written form.  Then all training words are exchanged in Spark: each word's left and
right neighbours are summed by class, and every word moves to the class that makes them likeliest, all words of a pass
against the same class counts.  A text's probability is the product of class transitions and of word emissions within the
class.  Counts come from all training texts; what is brought to the driver is bounded by the words of the start, the words
of the history and the classes.

The class that a token is predicted from is its predecessor's class of the round before if that is one of the ``HISTORY`` most
frequent words, else the class of its form.  Words travel as 64-bit hashes.  Counts and classes of the ``HEAD`` most frequent
words go to every task; all other words meet theirs in a join, so no table that grows with the corpus is broadcast.
"""
from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from screenloom.llm.labelled import fold
from screenloom.llm.wordhash import END, SLICE_BYTES, WordHasher, first_words, lowered, row_slices, spans
from screenloom.session import durable

#: Words that the driver clusters as a start, and their classes.
CLUSTERED, CLASSES = 1500, 64
#: Words whose counts and classes are broadcast, and words that have their own class as history.
HEAD, HISTORY = 100_000, 100_000
#: Passes over the words of the start.
SWEEPS = 6
#: Rounds that count neighbours anew, and exchanges of all words in each.
ROUNDS, EXCHANGES = 2, 2
#: Neighbour counts scored at once in a task.
ENTRIES = 1 << 13
#: Neighbours that a task holds before it sends them on, and bits of a count beside its code.
HELD, COUNT_BITS = 1 << 21, 48
#: Columns of the exchanged words and of their sums.
EXCHANGED = ["word", "form", "n", "cls", "code"]
#: Added to each count of a word; pseudo-counts of the class distribution in a transition.
ADD, PRIOR = 0.1, 5.0
#: Classes by form: length (4) x ends in punctuation x holds a digit x holds bytes beyond ASCII x holds other signs.
FORMS = 64
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[0x30:0x3A] = True
_WIDE = np.arange(256) >= 0x80
_SIGN = np.zeros(256, dtype=bool)
_SIGN[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True


def tokens(texts):
    """(first row, number of rows, tokens, row of each token, form of each token); each row ends with ``END``, form 0."""
    hasher = WordHasher()
    for at, data, ends in row_slices(texts):
        data = lowered(data)
        starts, stops, rows = spans(data, ends)
        n = len(ends) - 1
        words = hasher(data, starts, stops)

        def held(mask):
            upto = np.concatenate([[0], np.cumsum(mask[data])])
            return (upto[stops] - upto[starts]) > 0 if len(starts) else np.zeros(0, bool)

        size = np.digitize(stops - starts, [4, 8, 12])
        form = size * 16 + (_SIGN[data[stops - 1]] * 8 if len(stops) else 0) + held(_DIGIT) * 4 + held(_WIDE) * 2
        if len(starts):
            inner = np.concatenate([[0], np.cumsum(_SIGN[data])])
            form = form + ((inner[stops - 1] - inner[starts]) > 0)
        first = first_words(rows, n)
        place = first[1:] + np.arange(n)  # of each end among the tokens
        out = np.empty(len(words) + n, dtype=np.uint64)
        kind = np.zeros(len(out), dtype=np.int64)
        own = np.arange(len(words)) + rows
        out[own], kind[own] = words, form
        out[place] = END
        owner = np.empty(len(out), dtype=np.int64)
        owner[own], owner[place] = rows, np.arange(n)
        yield at, n, out, owner, kind


def _counts(batches):
    import pyarrow as pa

    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def merged():
        word = np.concatenate([h[0] for h in held])
        _, first, inverse = np.unique(word, return_index=True, return_inverse=True)
        total = np.bincount(inverse, weights=np.concatenate([h[2] for h in held])).astype(np.int64)
        return word[first], np.concatenate([h[1] for h in held])[first], total

    def emit(parts):
        return pa.RecordBatch.from_arrays(
            [pa.array(parts[0].view(np.int64)), pa.array(parts[1].astype(np.int32)), pa.array(parts[2])], names=["word", "form", "n"]
        )

    for batch in batches:
        for _, _, word, _, form in tokens(batch["text"]):
            unique, first, n = np.unique(word, return_index=True, return_counts=True)
            held.append((unique, form[first], n.astype(np.int64)))
            if sum(len(h[0]) for h in held) > SLICE_BYTES:
                yield emit(merged())
                held = []
    if held:
        yield emit(merged())


def word_counts(train: DataFrame) -> DataFrame:
    """``word, form, n`` of every distinct token of the training texts."""
    parts = train.select("text").mapInArrow(_counts, "word bigint, form int, n bigint")
    return parts.groupBy("word").agg(F.min("form").alias("form"), F.sum("n").alias("n"))


class Lookup:
    """Positions of hashes in a sorted array, -1 where they are missing."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys

    def __call__(self, x: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(x), -1)
        at = np.minimum(np.searchsorted(self.keys, x), len(self.keys) - 1)
        return np.where(self.keys[at] == x, at, -1)


def _bigrams(keys: np.ndarray):
    """Arrow task: counts of neighbouring units; a unit is a clustered word, a form, or the start of a text."""
    units = len(keys) + FORMS + 1

    def run(batches):
        import pyarrow as pa

        find, total = Lookup(keys), {}
        sums = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            for _, _, word, owner, form in tokens(batch["text"]):
                at = find(word)
                unit = np.where(at >= 0, at, len(keys) + form)
                before = np.empty_like(unit)
                before[1:] = unit[:-1]
                new = np.concatenate([[True], owner[1:] != owner[:-1]]) if len(owner) else np.zeros(0, bool)
                before[new] = units - 1
                pair, n = np.unique(before * units + unit, return_counts=True)
                both, inverse = np.unique(np.concatenate([sums[0], pair]), return_inverse=True)
                sums = both, np.bincount(inverse, weights=np.concatenate([sums[1], n]), minlength=len(both)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(sums[0]), pa.array(sums[1])], names=["pair", "n"])

    return run


def exchange(counts: np.ndarray, movable: int, classes: int, fixed: np.ndarray, sweeps: int = SWEEPS) -> np.ndarray:
    """Class of each unit: the first ``movable`` units move to whichever of ``classes`` classes makes the bigrams likeliest.

    ``counts[v, w]`` are bigram counts; units from ``movable`` on keep the class in ``fixed`` (numbered from ``classes``).
    The likelihood is sum c log c over class pairs minus the same over the classes' totals on the left and on the right."""
    units = len(counts)
    cls = np.concatenate([np.arange(movable) % classes, fixed[movable:]])
    m = int(cls.max(initial=0)) + 1 if units else 0
    by_left = np.zeros((units, m))  # words on the left of v, by class
    by_right = np.zeros((units, m))
    hot = np.zeros((units, m))
    hot[np.arange(units), cls] = 1
    by_right[:] = counts @ hot
    by_left[:] = counts.T @ hot
    pairs = hot.T @ by_right
    left, right = counts.sum(axis=1), counts.sum(axis=0)
    class_left, class_right = hot.T @ left, hot.T @ right
    f = lambda x: np.where(x > 0, x * np.log(np.maximum(x, 1e-300)), 0.0)
    for _ in range(sweeps):
        moved = 0
        for v in range(movable):
            old, self_ = cls[v], counts[v, v]
            out, into = by_right[v].copy(), by_left[v].copy()
            # take v out of its class
            pairs[old] -= out
            pairs[:, old] -= into
            pairs[old, old] += self_
            out[old] -= self_
            into[old] -= self_
            class_left[old] -= left[v]
            class_right[old] -= right[v]
            # change of the likelihood when v joins class k, for all k at once
            grown = pairs[:classes] + out
            gain = (f(grown) - f(pairs[:classes])).sum(axis=1)
            column = pairs[:, :classes]
            gain += (f(column + into[:, None]) - f(column)).sum(axis=0)
            d = np.arange(classes)
            diagonal = pairs[d, d]
            gain += f(diagonal + out[:classes] + into[:classes] + self_) - f(diagonal + out[:classes]) - f(diagonal + into[:classes]) + f(diagonal)
            gain -= f(class_left[:classes] + left[v]) - f(class_left[:classes])
            gain -= f(class_right[:classes] + right[v]) - f(class_right[:classes])
            new = int(np.argmax(gain))
            if gain[new] <= gain[old] + 1e-9:
                new = old
            pairs[new] += out
            pairs[:, new] += into
            pairs[new, new] += self_
            class_left[new] += left[v]
            class_right[new] += right[v]
            if new != old:
                moved += 1
                cls[v] = new
                by_right[:, old] -= counts[:, v]
                by_right[:, new] += counts[:, v]
                by_left[:, old] -= counts[v]
                by_left[:, new] += counts[v]
        if not moved:
            break
    return cls


def _xlogx(x):
    return np.where(x > 0, x * np.log(np.maximum(x, 1e-300)), 0.0)


def _before(c: np.ndarray, owner: np.ndarray, start: int) -> np.ndarray:
    """The class before each token; ``start`` before a text's first."""
    out = np.empty_like(c)
    out[1:] = c[:-1]
    out[np.concatenate([[True], owner[1:] != owner[:-1]]) if len(owner) else np.zeros(0, bool)] = start
    return out


def _summed(word, form, code, n, m: int):
    """(word, form, code, n) with each word and code once, ordered by both."""
    unique, first, inverse = np.unique(word, return_index=True, return_inverse=True)
    pair, back = np.unique(inverse * (2 * m) + code, return_inverse=True)
    at = pair // (2 * m)
    return unique[at], form[first][at], pair % (2 * m), np.bincount(back, weights=n, minlength=len(pair)).astype(np.int64)


def _packed(word, form, code, n):
    """Arrow rows ``word, form, near`` of summed neighbours."""
    import pyarrow as pa

    cut = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]])) if len(word) else np.zeros(0, np.int64)
    ends = (np.append(cut, len(word)) * 8).astype(np.int32)
    near = pa.Array.from_buffers(pa.binary(), len(cut), [None, pa.py_buffer(ends), pa.py_buffer((code << COUNT_BITS | n).astype("<i8"))])
    return pa.RecordBatch.from_arrays(
        [pa.array(word[cut].view(np.int64)), pa.array(form[cut].astype(np.int32)), near], names=["word", "form", "near"]
    )


def unpacked(near):
    """Offsets of each row's neighbours, their codes and counts, from an Arrow column ``near``."""
    _, ends, data = near.buffers()
    if not len(near):
        return np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    ends = np.frombuffer(ends, dtype=np.int32)[near.offset : near.offset + len(near) + 1].astype(np.int64)
    flat = np.frombuffer(data, dtype="<i8", offset=int(ends[0]), count=int(ends[-1] - ends[0]) // 8)
    return (ends - ends[0]) // 8, flat >> COUNT_BITS, flat & ((1 << COUNT_BITS) - 1)


def _neighbours(keys: np.ndarray, history: np.ndarray, classes: int):
    """Arrow task: how often each word has each class on its left (codes 0 to m - 1) and on its right (m on)."""
    m = classes + FORMS + 1

    def run(batches):
        find, held = Lookup(keys), []
        for batch in batches:
            for _, _, word, owner, form in tokens(batch["text"]):
                at = find(word)
                c = np.where(at >= 0, history[np.maximum(at, 0)] if len(keys) else 0, classes + form)
                inner = owner[1:] == owner[:-1]
                unique, first, which = np.unique(word, return_index=True, return_inverse=True)
                pair, n = np.unique(
                    np.concatenate([which * (2 * m) + _before(c, owner, m - 1), which[:-1][inner] * (2 * m) + m + c[1:][inner]]), return_counts=True
                )
                row = pair // (2 * m)
                held.append((unique[row], form[first][row], pair % (2 * m), n))
                if sum(len(h[0]) for h in held) > HELD:
                    held = [_summed(*map(np.concatenate, zip(*held)), m)]
                    if len(held[0][0]) > HELD // 2:
                        yield _packed(*held[0])
                        held = []
        if held:
            yield _packed(*_summed(*map(np.concatenate, zip(*held)), m))

    return run


def _merged(m: int):
    """Arrow task over rows ordered by word: one row for each word.  Holds a batch and the sums of one word."""

    def run(batches):
        held = None
        for batch in batches:
            cut, code, n = unpacked(batch["near"])
            size = np.diff(cut)
            parts = np.repeat(batch["word"].to_numpy(), size), np.repeat(batch["form"].to_numpy(), size), code, n
            if held is not None:
                parts = tuple(map(np.concatenate, zip(held, parts)))
            word, form, code, n = _summed(*parts, m)
            last = word == parts[0][-1] if len(word) else np.zeros(0, bool)
            yield _packed(*(x[~last] for x in (word, form, code, n)))
            held = word[last], form[last], code[last], n[last]
        if held is not None:
            yield _packed(*held)

    return run


def neighbours(train: DataFrame, keys: np.ndarray, history: np.ndarray, classes: int) -> DataFrame:
    """``word, form, near``: every training word's neighbours, at most two for each class, as 8-byte integers
    ``code * 2**COUNT_BITS + n`` ordered by code.  A task sends at most one row of a word for each ``HELD`` neighbours that
    it has counted; what meets then is added up along the order of the words, so no list of rows is ever held."""
    row = "word bigint, form int, near binary"
    parts = train.select("text").mapInArrow(_neighbours(keys, history, classes), row)
    return parts.repartition("word").sortWithinPartitions("word").mapInArrow(_merged(classes + FORMS + 1), row)


def place(old: np.ndarray, cut: np.ndarray, code: np.ndarray, n: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The best class of each word, by neighbour counts ``code, n`` (word i has those from ``cut[i]`` to ``cut[i + 1]``).

    ``counts[k, code]`` are the classes' neighbour counts with every word in its old class.  The likelihood is the sum of
    c log c over counts, minus the same over the classes' totals on either side.  All words move at once, so the gain of a
    class is taken to first order: the log-probability of the word's neighbours under the class.  Hence moving all words
    never lowers the likelihood, which gains of single moves do not guarantee.  A word stays unless another class is better."""
    if not len(old):
        return old.copy()
    m = counts.shape[1] // 2
    with np.errstate(divide="ignore"):
        total = np.repeat(np.stack([counts[:, :m].sum(axis=1), counts[:, m:].sum(axis=1)], axis=1), m, axis=1)
        log_p = (np.log(counts) - np.log(np.maximum(total, 1.0))).T
    # most words occur once; those with the same two neighbours are scored together
    size = np.diff(cut)
    once = np.flatnonzero((size == 2) & (np.add.reduceat(n, cut[:-1]) == 2))
    name = np.arange(len(old)) + 4 * m * m
    name[once] = code[cut[once]] * (2 * m) + code[cut[once] + 1]
    _, first, same = np.unique(name, return_index=True, return_inverse=True)
    upto = np.concatenate([[0], np.cumsum(size[first])])
    rows = np.repeat(cut[first] - upto[:-1], size[first]) + np.arange(upto[-1])
    gain = np.empty((len(first), len(counts)))
    start = 0
    while start < len(first):
        stop = max(start + 1, int(np.searchsorted(upto, upto[start] + ENTRIES, side="right")) - 1)
        part = rows[upto[start] : upto[stop]]
        gain[start:stop] = np.add.reduceat(log_p[code[part]] * n[part][:, None], upto[start:stop] - upto[start], axis=0)
        start = stop
    best = gain.argmax(axis=1)
    return np.where(gain[np.arange(len(first)), best][same] > gain[same, old] + 1e-9, best[same], old)


def likelihood(counts: np.ndarray) -> float:
    m = counts.shape[1] // 2
    return float(_xlogx(counts).sum() - _xlogx(counts[:, :m].sum(axis=1)).sum() - _xlogx(counts[:, m:].sum(axis=1)).sum())


def _exchanged(m: int, passes: list[np.ndarray], words: bool, summed: bool):
    """Arrow task: classes after the given passes, each against its own class counts; as rows of words (no code), as the
    task's sums of each class and code (no word), or both."""

    def run(batches):
        import pyarrow as pa

        total = np.zeros((m - 1) * 2 * m)
        for batch in batches:
            cut, code, n = unpacked(batch["near"])
            cls = batch["cls"].to_numpy().astype(np.int64)
            for counts in passes:
                cls = place(cls, cut, code, n, counts)
            if words:
                tokens_of = np.add.reduceat(np.where(code < m, n, 0), cut[:-1]) if len(cls) else n
                yield pa.RecordBatch.from_arrays(
                    [batch["word"], batch["form"], pa.array(tokens_of), pa.array(cls.astype(np.int32)), pa.nulls(len(cls), pa.int32())], names=EXCHANGED
                )
            if summed:
                total += np.bincount(np.repeat(cls, np.diff(cut)) * (2 * m) + code, weights=n, minlength=len(total))
        if summed:
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.nulls(len(at), pa.int64()), pa.nulls(len(at), pa.int32()), pa.array(total[at].astype(np.int64)),
                    pa.array((at // (2 * m)).astype(np.int32)), pa.array((at % (2 * m)).astype(np.int32)),
                ],
                names=EXCHANGED,
            )

    return run


def exchange_all(near: DataFrame, classes: int, exchanges: int = EXCHANGES):
    """``word, form, n, cls`` after ``exchanges`` passes over every word of ``near`` (with ``cls``), and a function that gives
    the class counts then.  A task repeats the passes from the broadcast class counts, so nothing but the final table and its
    sums for each task are written."""
    m = classes + FORMS + 1
    kinds = ("bigint", "int", "bigint", "int", "int")
    row = ", ".join(f"{c} {k}" for c, k in zip(EXCHANGED, kinds))

    def counts_of(rows):
        t = rows.groupBy("cls", "code").agg(F.sum("n").alias("n")).toArrow()  # at most classes x 2 m rows
        out = np.zeros((m - 1, 2 * m))
        out[t["cls"].to_numpy(), t["code"].to_numpy()] = t["n"].to_numpy()
        return out

    passes = []
    for _ in range(exchanges):
        passes.append(counts_of(near.mapInArrow(_exchanged(m, passes, False, True), row)))
    both = durable(near.mapInArrow(_exchanged(m, passes, True, True), row))
    return both.where("word IS NOT NULL").drop("code"), lambda: counts_of(both.where("word IS NULL"))


def _most_frequent(words: DataFrame, n: int, *columns: str):
    """Hashes, in order, and further columns of the n most frequent words."""
    t = words.orderBy(F.desc("n"), "word").limit(n).select("word", *columns).toArrow()
    keys = t["word"].to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(keys)
    return keys[order], *[t[c].to_numpy().astype(np.int64)[order] for c in columns]


def _table(spark, **columns: np.ndarray) -> DataFrame:
    """A bounded table of numbers as a local one, which needs no job."""
    import pyarrow as pa

    return spark.createDataFrame(pa.table({name: pa.array(x) for name, x in columns.items()}))


class Model:
    """``words`` (word, form, n, cls) of every training word; ``keys``, ``history``: the classes that tokens are predicted from;
    ``step[h, c]``, ``size[c]``, ``kinds[c]``: transitions, tokens and distinct words of the classes; ``home[form]``: the class of
    unseen words, which is the one with most training words of that form that were seen once."""

    def __init__(self, train: DataFrame, clustered: int, classes: int, history: int, rounds: int = ROUNDS):
        m = self.m = classes + FORMS + 1
        counts = durable(word_counts(train))
        keys, _ = _most_frequent(counts, clustered, "n")
        units = len(keys) + FORMS + 1
        pairs = train.select("text").mapInArrow(_bigrams(keys), "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))
        pairs = pairs.toArrow()  # at most units * units rows
        bigrams = np.zeros((units, units), dtype=np.float64)
        at = pairs["pair"].to_numpy().astype(np.int64)
        bigrams[at // units, at % units] = pairs["n"].to_numpy()
        fixed = np.concatenate([np.zeros(len(keys), np.int64), classes + np.arange(FORMS + 1)])
        begun = exchange(bigrams, len(keys), classes, fixed)[: len(keys)]

        spark = train.sparkSession
        started = _table(spark, word=keys.view(np.int64), cls=begun.astype(np.int32))
        self.keys, self.history = keys, begun
        for r in range(rounds):
            if r:
                started = self.words.select("word", "cls")
                self.keys, self.history = _most_frequent(self.words, history, "cls")
            near = neighbours(train, self.keys, self.history, classes).join(started, "word", "left")
            near = durable(near.withColumn("cls", F.coalesce("cls", F.col("form") + classes)))
            self.words, seen = exchange_all(near, classes)
        steps = seen()[:, :m].T
        arrived = steps.sum(axis=0)
        overall = (arrived + 1.0) / (arrived.sum() + m - 1)
        self.step = (steps + PRIOR * overall) / (steps.sum(axis=1, keepdims=True) + PRIOR)
        self.size, self.kinds, self.home = arrived, np.zeros(m - 1), classes + np.arange(FORMS)
        best = np.zeros(FORMS)
        tally = self.words.groupBy("form", "cls").agg(F.count(F.lit(1)).alias("v"), F.count_if(F.col("n") == 1).alias("once"))
        for x in sorted(tally.collect()):  # at most forms x classes rows
            self.kinds[x.cls] += x.v
            if x.once > best[x.form]:
                best[x.form], self.home[x.form] = x.once, x.cls
        self.n, self.distinct = int(self.size.sum()), int(self.kinds.sum())
        self.log_step, self.log_class = np.log10(self.step), np.log10(self.size + ADD * (self.kinds + 1))


def _local(keys, history, home, log_step, log_class, head_word, head_n, head_cls, total):
    """Arrow task: what a text's scores owe to the words with broadcast counts, and its other words with the class before."""
    m = len(log_step)
    classes = m - 1 - FORMS

    def run(batches):
        import pyarrow as pa

        find, known = Lookup(keys), Lookup(head_word)
        for batch in batches:
            for at, n, word, owner, form in tokens(batch["text"]):
                u = find(word)
                before = _before(np.where(u >= 0, history[np.maximum(u, 0)] if len(keys) else 0, classes + form), owner, m - 1)
                h = known(word)
                seen = h >= 0
                c = head_cls[h[seen]] if len(head_word) else h[seen]
                own = np.zeros(len(word))
                own[seen] = np.log10((head_n[h[seen]] if len(head_word) else 0) + ADD)
                shared = np.bincount(owner, weights=own, minlength=n)
                own[seen] += log_step[before[seen], c] - log_class[c]
                number = np.bincount(owner, minlength=n)
                cut = np.searchsorted(owner[~seen], np.arange(n + 1))
                rest = pa.StructArray.from_arrays(
                    [pa.array(word[~seen].view(np.int64)), pa.array(before[~seen].astype(np.int32)), pa.array(home[form[~seen]].astype(np.int32))],
                    names=["word", "before", "home"],
                )
                yield pa.RecordBatch.from_arrays(
                    [
                        batch["doc_id"].slice(at, n), batch["row"].slice(at, n), pa.array(number.astype(np.int64)),
                        pa.array(np.bincount(owner, weights=seen, minlength=n).astype(np.int64)),
                        pa.array(shared - number * total), pa.array(np.bincount(owner, weights=own, minlength=n)),
                        pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), rest),
                    ],
                    names=["doc_id", "row", "n_tokens", "n_known", "base_score", "score", "rest"],
                )

    return run


def scores(
    docs: DataFrame, modulus: int = 10, held: int = 0, clustered: int = CLUSTERED, classes: int = CLASSES, head: int = HEAD, history: int = HISTORY,
) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` for every row of ``docs``.

    Words are runs of non-space bytes after A-Z is lower-cased, then one end.  The model learns from rows whose fold is not
    ``held``; ``base_score`` is the unigram score with 0.1 added, ``score`` the class model's log10 probability.  Every training
    word has an exchanged class; ``history`` words are their own class as predecessors, rarer ones the class of their form.
    A class keeps 0.1 for an unseen word; a transition falls back on the classes' own frequencies.  A null, empty or blank
    text is one end.  A null ``doc_id`` trains and is not held out.  Repeated rows train and are scored each.  With nothing
    to train on, all counts are zero.  An empty table gives no rows.
    """
    plain = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    held_out = F.coalesce(fold(modulus) == held, F.lit(False))
    model = Model(plain.where(~held_out), clustered, classes, history)
    head_word, head_n, head_cls = _most_frequent(model.words, head, "n", "cls")
    local = _local(
        model.keys, model.history, model.home, model.log_step, model.log_class, head_word, head_n, head_cls,
        float(np.log10(model.n + ADD * (model.distinct + 1))),
    )
    schema = (
        "doc_id bigint, row bigint, n_tokens bigint, n_known bigint, base_score double, score double, "
        "rest array<struct<word: bigint, before: int, home: int>>"
    )
    numbered = plain.select("doc_id", F.monotonically_increasing_id().alias("row"), "text")
    part = durable(numbered.mapInArrow(local, schema))  # stored, so a row keeps its number
    gain = model.log_step - model.log_class
    h, c = np.indices(gain.shape)  # (classes + forms) squared rows
    gains = _table(docs.sparkSession, before=h.ravel().astype(np.int32), cls=c.ravel().astype(np.int32), gain=gain.ravel())
    rare = part.select("row", F.inline("rest"))
    met = rare.join(model.words.select("word", "n", "cls"), "word", "left").withColumn("cls", F.coalesce("cls", "home"))
    met = met.join(F.broadcast(gains), ["before", "cls"])
    emitted = F.log10(F.coalesce("n", F.lit(0)) + F.lit(ADD))
    added = met.groupBy("row").agg(F.count("n").alias("more"), F.sum(emitted).alias("base"), F.sum(emitted + F.col("gain")).alias("add"))
    out = part.drop("rest").join(added, "row", "left")
    return out.select(
        "doc_id", F.coalesce(fold(modulus) == held, F.lit(False)).alias("held_out"), "n_tokens",
        (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(model.n).cast("bigint").alias("train_tokens"),
        (F.col("base_score") + F.coalesce("base", F.lit(0.0))).alias("base_score"), (F.col("score") + F.coalesce("add", F.lit(0.0))).alias("score"),
    )
