"""Language-model scores from a class-based n-gram model, its classes found by exchange clustering.

A token's probability is that of its class after the previous class, times that of the token within
its class. Every word of the training texts is moved to the class that raises the likelihood of the
class bigrams most, given the counts of classes before and after the word over the whole corpus. The
``EXCHANGED`` most frequent words are dealt to ``CLASSES`` classes and moved one after the other, in
``SWEEPS`` passes with the class bigrams following each move. All other known words, however many, then
move at once, against the class bigrams the passes left: each word's contexts meet in one task, and the
words are spread over all tasks. Until then they stand in one of ``OPEN`` classes by hash. Words without
any training token stay there; what stands around them is learnt from the words that occur once, each
counted in its open class too. The end of a text is a class of its own. Emissions are smoothed with 0.1
per word and one unknown word per class, transitions with the classes' own frequencies.

Counts are taken over all training texts and stay distributed; what reaches the driver has a fixed
size: the counts and classes of the ``FREQUENT`` most frequent words, and class counts by exchanged word.
Texts are turned into word numbers once. The tokens of rarer words meet their counts and classes in a
join on the word.

Defined cases: a null text counts as empty and holds the end token alone; rows with null ids are scored
but neither held out nor learnt from. Rows that repeat an id and a text are rows of the corpus as any
other. Only the id and text columns are read, so others may have any name. An
empty table gives no rows; a text of any length is scored whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from lendscope.llm.common import arrow_map, discard, stored, sum_counters, text_runs

ADD = 0.1
FREQUENT = 1 << 18
EXCHANGED, CLASSES, OPEN, SWEEPS = 1 << 13, 64, 16, 2
#: Weight of the classes' own frequencies in transitions.
PRIOR = 10.0
FOLDS = 10
#: White space never occurs in a word, so this cannot be one.
END = xxh3_64_intdigest(b"\n")
END_CLASS = CLASSES + OPEN
ALL = END_CLASS + 1
#: Place of words that are not among the frequent ones.
RARE = (1 << 32) - 1
#: Contexts a task gathers before it counts and sends them.
HELD = 2_000_000


def tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, an end after each; and each text's number of tokens."""
    words = [t.encode("utf-8", "surrogatepass").lower().split() for t in texts]
    sizes = np.array([len(w) + 1 for w in words], np.int64)
    ends = np.cumsum(sizes) - 1
    out = np.empty(int(sizes.sum()), np.uint64)
    inner = np.ones(len(out), bool)
    inner[ends] = False
    out[ends] = END
    out[inner] = np.fromiter((h for w in words for h in map(xxh3_64_intdigest, w)), np.uint64, int(inner.sum()))
    return out, sizes


def remainder(key: int | None) -> int:
    return -1 if key is None else crc32(str(key).encode()) % FOLDS


def word_counts(docs: DataFrame) -> DataFrame:
    """``hash``, ``n`` of every distinct training token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.empty(0, np.uint64), np.empty(0, np.int64)

        def rows():
            return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts)], names=["hash", "n"])

        for part in text_runs(batches, "text"):
            texts = [t for i, t in zip(part["doc_id"], part["text"]) if remainder(i) > 0]
            if not texts:
                continue
            new, n = np.unique(tokens(texts)[0], return_counts=True)
            merged, at = np.unique(np.concatenate([keys, new]), return_inverse=True)
            counts = np.bincount(at, np.concatenate([counts, n]), len(merged)).astype(np.int64)
            keys = merged
            if len(keys) > 1_000_000:
                yield rows()
                keys, counts = np.empty(0, np.uint64), np.empty(0, np.int64)
        yield rows()

    return arrow_map(docs, run, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n"))


class Lexicon:
    """The most frequent words: sorted hashes, counts, and word numbers.

    Numbers below EXCHANGED are exchanged words by rank, then come the open classes, then the end.
    """

    def __init__(self, hashes: np.ndarray, counts: np.ndarray):
        words = hashes != np.uint64(END)
        number = (hashes % np.uint64(OPEN)).astype(np.uint16) + EXCHANGED
        ranked = np.flatnonzero(words)[:EXCHANGED]
        number[ranked] = np.arange(len(ranked))
        number[~words] = EXCHANGED + OPEN
        #: The open class of each word that occurs once, else 0; by word number and by place.
        once = np.where(words & (counts == 1), open_class(hashes), 0).astype(np.uint8)
        self.once_numbered = np.zeros(EXCHANGED + OPEN + 1, np.uint8)
        self.once_numbered[: len(ranked)] = once[ranked]
        order = np.argsort(hashes)
        self.once = once[order]
        self.hashes, self.counts, self.number = hashes[order], counts[order], number[order]

    def look_up(self, found: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Counts (0 if not among the frequent), word numbers, and places in the lexicon (RARE if not there)."""
        number = (found % np.uint64(OPEN)).astype(np.uint16) + EXCHANGED
        number[found == np.uint64(END)] = EXCHANGED + OPEN
        if not len(self.hashes):
            return np.zeros(len(found), np.int64), number, np.full(len(found), RARE, np.uint32)
        at = np.minimum(np.searchsorted(self.hashes, found), len(self.hashes) - 1)
        known = self.hashes[at] == found
        return (
            np.where(known, self.counts[at], 0),
            np.where(known, self.number[at], number).astype(np.uint16),
            np.where(known, at, RARE).astype(np.uint32),
        )


NUMBERED = (
    "doc_id long, held_out boolean, train boolean, rid long, n_tokens long, known long, mass double, ids binary, "
    "places binary, rare array<long>"
)


def numbered(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """Per row: word numbers, the frequent words' share of the score, and its other words.

    ``places`` has the lexicon's place of each token in an open class; where that is RARE, the hash is next in ``rare``.
    """
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = shared.value
        for part in text_runs(batches, "text"):
            found, sizes = tokens(part["text"])
            counts, ids, places = lex.look_up(found)
            known = counts > 0
            mass = np.where(known, np.log10(counts + ADD), 0.0)
            is_open = in_open_class(ids)
            starts = np.cumsum(sizes) - sizes
            spans = [slice(a, a + n) for a, n in zip(starts, sizes)]
            fold = [remainder(i) for i in part["doc_id"]]
            rid = [xxh3_64_intdigest(t.encode("utf-8", "surrogatepass"), 0 if i is None else (2 * i + 1) & 0xFFFFFFFFFFFFFFFF) for i, t in zip(part["doc_id"], part["text"])]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(part["doc_id"], pa.int64()),
                    pa.array([f == 0 for f in fold]),
                    pa.array([f > 0 for f in fold]),
                    pa.array(np.array(rid, np.uint64).view(np.int64)),
                    pa.array(sizes),
                    pa.array(np.add.reduceat(known, starts, dtype=np.int64)),
                    pa.array(np.add.reduceat(mass, starts)),
                    pa.array([ids[s].tobytes() for s in spans], pa.binary()),
                    pa.array([places[s][is_open[s]].tobytes() for s in spans], pa.binary()),
                    pa.array([found[s][~known[s]].view(np.int64) for s in spans], pa.list_(pa.int64())),
                ],
                names=[c.split()[0] for c in NUMBERED.split(", ")],
            )

    return arrow_map(docs, run, NUMBERED)


def open_class(hashes: np.ndarray) -> np.ndarray:
    return (np.uint64(CLASSES) + hashes % np.uint64(OPEN)).astype(np.uint8)


def in_open_class(ids: np.ndarray) -> np.ndarray:
    return (ids >= EXCHANGED) & (ids < EXCHANGED + OPEN)


def class_contexts(texts: DataFrame, class_of: np.ndarray) -> np.ndarray:
    """Over the training texts, [0, w, c]: class c before word number w; [1, w, c]: class c after it."""
    words = EXCHANGED + OPEN + 1
    shared = texts.sparkSession.sparkContext.broadcast(class_of)

    def tally(batches: Iterator[pa.RecordBatch], total: np.ndarray) -> None:
        of = shared.value
        both = total.reshape(2, words * ALL)
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                rows = batch.slice(start, 500)["ids"].to_pylist()
                if not rows:
                    continue
                # An end precedes each text, as each has one at its end.
                ids = np.concatenate([[EXCHANGED + OPEN], *[np.frombuffer(r, np.uint16) for r in rows]]).astype(np.int64)
                c = of[ids]
                both[0] += np.bincount(ids[1:] * ALL + c[:-1], minlength=words * ALL)
                both[1] += np.bincount(ids[:-1] * ALL + c[1:], minlength=words * ALL)

    return sum_counters(texts.where("train").select("ids"), tally, 2 * words * ALL).reshape(2, words, ALL)


def starting_classes() -> np.ndarray:
    """Exchanged words by frequency rank in turn, then the open classes, then the end."""
    return np.concatenate([np.arange(EXCHANGED) % CLASSES, CLASSES + np.arange(OPEN), [END_CLASS]]).astype(np.int64)


def xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1.0))


def exchange(class_of: np.ndarray, before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Move each exchanged word, most frequent first, to its best class.

    The likelihood is the sum of n log n over class bigrams less twice that over classes. A word's own
    contexts are those counted before the sweep; the table of class bigrams follows every move.
    """
    class_of = class_of.copy()
    table = np.zeros((ALL, ALL))
    np.add.at(table, class_of, after.astype(float))
    size = table.sum(1)
    for w in range(EXCHANGED):
        left, right, n = before[w].astype(float), after[w].astype(float), float(after[w].sum())
        if not n:
            break
        old = class_of[w]
        table[old] -= right
        table[:, old] -= left
        np.maximum(table, 0, out=table)
        size[old] -= n
        gain = (
            (xlogx(table[:CLASSES] + right) - xlogx(table[:CLASSES])).sum(1)
            + (xlogx(table[:, :CLASSES] + left[:, None]) - xlogx(table[:, :CLASSES])).sum(0)
            - 2 * (xlogx(size[:CLASSES] + n) - xlogx(size[:CLASSES]))
        )
        new = int(np.argmax(gain))
        class_of[w] = new
        table[new] += right
        table[:, new] += left
        size[new] += n
    return class_of


def one_open(classes: np.ndarray) -> np.ndarray:
    return np.where((classes >= CLASSES) & (classes < END_CLASS), CLASSES, classes)


def other_contexts(texts: DataFrame, lexicon: Lexicon, class_of: np.ndarray) -> DataFrame:
    """``hash``, ``context`` (class before * ALL + class after) and ``n`` of all training tokens of words not exchanged yet."""
    shared = texts.sparkSession.sparkContext.broadcast((lexicon.hashes, class_of))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, of = shared.value
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def sent() -> pa.RecordBatch:
            word, context = (np.concatenate(x) for x in zip(*held))
            order = np.lexsort((context, word))
            word, context = word[order], context[order]
            new = np.flatnonzero(np.concatenate([[True], (word[1:] != word[:-1]) | (context[1:] != context[:-1])]))
            n = np.diff(np.append(new, len(word)))
            return pa.RecordBatch.from_arrays(
                [pa.array(word[new].view(np.int64)), pa.array(context[new].astype(np.int32)), pa.array(n.astype(np.int64))],
                names=["hash", "context", "n"],
            )

        for batch in batches:
            for ids, places, rare in zip(batch["ids"], batch["places"], batch["rare"]):
                ids = np.frombuffer(ids.as_buffer(), np.uint16)
                places = np.frombuffer(places.as_buffer(), np.uint32)
                if not len(places):
                    continue
                at = np.flatnonzero(in_open_class(ids))
                word = np.empty(len(at), np.uint64)
                frequent = places != RARE
                word[frequent] = hashes[places[frequent]]
                word[~frequent] = rare.values.to_numpy(zero_copy_only=False).view(np.uint64)
                c = of[np.concatenate([[EXCHANGED + OPEN], ids])]  # an end precedes each text and is its last token
                held.append((word, c[at] * ALL + c[at + 2]))
                size += len(at)
                if size > HELD:
                    yield sent()
                    held, size = [], 0
        if held:
            yield sent()

    return arrow_map(texts.where("train").select("ids", "places", "rare"), run, "hash long, context int, n long")


def gains(table: np.ndarray, word: np.ndarray, other: np.ndarray, n: np.ndarray, words: int) -> np.ndarray:
    """By word and exchanged class: growth of n log n over ``table`` [other, class] if the word's ``n`` contexts join it."""
    key, at = np.unique(word * ALL + other, return_inverse=True)
    n = np.bincount(at, n, len(key))
    single = xlogx(table + 1) - xlogx(table)
    out = np.zeros((words, CLASSES))
    for start in range(0, len(key), 20_000):
        part = slice(start, start + 20_000)
        w, d = np.divmod(key[part], ALL)
        each = single[d]
        more = np.flatnonzero(n[part] > 1)
        each[more] = xlogx(table[d[more]] + n[part][more, None]) - xlogx(table[d[more]])
        first = np.flatnonzero(np.diff(w, prepend=-1))
        out[w[first]] += np.add.reduceat(each, first)
    return out


def best_classes(contexts: DataFrame, table: np.ndarray) -> DataFrame:
    """``hash``, ``class``, ``n``: of all classes that exchanged words have, the one that gains most by each word.

    ``table`` [class, next class] is the same for all words; each word's contexts meet in one task.
    """
    shared = contexts.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = shared.value
        size = pairs.sum(1)[:CLASSES]
        before, after = np.ascontiguousarray(pairs[:, :CLASSES]), np.ascontiguousarray(pairs[:CLASSES].T)

        def chosen(word: np.ndarray, context: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]])[: len(word)])
            count = np.add.reduceat(n, first) if len(first) else n
            of = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(word))))
            gain = gains(before, of, context // ALL, n, len(first)) + gains(after, of, context % ALL, n, len(first))
            gain -= 2 * (xlogx(size + count[:, None]) - xlogx(size))
            best = np.argmax(gain, 1).astype(np.int32)
            return pa.RecordBatch.from_arrays([pa.array(word[first]), pa.array(best), pa.array(count)], names=["hash", "class", "n"])

        rest = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64))
        for batch in batches:
            new = (batch[k].to_numpy(zero_copy_only=False).astype(np.int64) for k in ("hash", "context", "n"))
            rows = [np.concatenate(x) for x in zip(rest, new)]
            # The last word may go on in the next batch.
            cut = int(np.searchsorted(rows[0], rows[0][-1])) if len(rows[0]) else 0
            rest = tuple(x[cut:] for x in rows)
            yield chosen(*(x[:cut] for x in rows))
        yield chosen(*rest)

    return arrow_map(contexts.repartition("hash").sortWithinPartitions("hash"), run, "hash long, class int, n long")


CLASSED = "doc_id long, held_out boolean, train boolean, n_tokens long, known long, mass double, classes binary, once binary"


def classed(texts: DataFrame, lexicon: Lexicon, class_of: np.ndarray, others: DataFrame, frequent: DataFrame) -> DataFrame:
    """Per row the class of each token, and its known words and their share of the score with the rarer ones.

    ``once`` has the open class of each token whose word occurs once in the training texts, else 0.

    ``others``: class and count of each word that was not exchanged one by one; ``frequent``: those in the lexicon.
    """
    class_at = np.zeros(len(lexicon.hashes), np.uint8)
    got = frequent.toPandas()
    if len(got):
        class_at[np.searchsorted(lexicon.hashes, got["hash"].to_numpy(np.int64).view(np.uint64))] = got["class"].to_numpy()
    shared = texts.sparkSession.sparkContext.broadcast((class_of.astype(np.uint8), class_at, lexicon.once_numbered, lexicon.once))
    # Rows that repeat an id and a text ask for the same words.
    rare = (
        texts.select("rid", F.explode(F.array_distinct("rare")).alias("hash"))
        .join(others, "hash")
        .groupBy("rid")
        .agg(F.collect_set(F.struct("hash", "class", "n")).alias("found"))
    )
    columns = ["doc_id", "held_out", "train", "n_tokens", "known", "mass"]

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, at, once_numbered, once_at = shared.value
        for batch in batches:
            out, singles = [], []
            for ids, places in zip(batch["ids"], batch["places"]):
                ids = np.frombuffer(ids.as_buffer(), np.uint16)
                places = np.frombuffer(places.as_buffer(), np.uint32)
                c, once = of[ids], once_numbered[ids]
                mine = np.flatnonzero(in_open_class(ids))[places != RARE]
                places = places[places != RARE]
                c[mine], once[mine] = at[places], once_at[places]
                out.append(c.tobytes())
                singles.append(once.tobytes())
            yield pa.RecordBatch.from_arrays(
                [*[batch[k] for k in (*columns, "rid", "rare")], pa.array(out, pa.binary()), pa.array(singles, pa.binary())],
                names=[*columns, "rid", "rare", "classes", "once"],
            )

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            classes, singles, known, mass = [], [], batch["known"].to_numpy().copy(), batch["mass"].to_numpy().copy()
            for i, (row, once, rare, found) in enumerate(zip(batch["classes"], batch["once"], batch["rare"], batch["found"])):
                c, once = (np.frombuffer(x.as_buffer(), np.uint8) for x in (row, once))
                wanted, hits = rare.values.to_numpy(zero_copy_only=False), 0
                if found.is_valid:
                    found = found.values
                    hashes = found.field("hash").to_numpy(zero_copy_only=False)
                    order = np.argsort(hashes)
                    hashes = hashes[order]
                    at = np.minimum(np.searchsorted(hashes, wanted), len(hashes) - 1)
                    hit = hashes[at] == wanted
                    at = order[at[hit]]
                    c, once = c.copy(), once.copy()
                    # The tokens still in open classes are the rare ones.
                    here = np.flatnonzero((c >= CLASSES) & (c < END_CLASS))[hit]
                    n = found.field("n").to_numpy(zero_copy_only=False)[at]
                    c[here] = found.field("class").to_numpy(zero_copy_only=False)[at]
                    once[here] = np.where(n == 1, open_class(wanted[hit].view(np.uint64)), 0)
                    hits = int(hit.sum())
                    mass[i] += np.log10(n + ADD).sum()
                known[i] += hits
                mass[i] += (len(wanted) - hits) * np.log10(ADD)
                classes.append(c.tobytes())
                singles.append(once.tobytes())
            yield pa.RecordBatch.from_arrays(
                [*[batch[k] for k in columns[:4]], pa.array(known), pa.array(mass), pa.array(classes, pa.binary()), pa.array(singles, pa.binary())],
                names=[*columns, "classes", "once"],
            )

    mapped = arrow_map(texts, first, CLASSED.replace("classes", "rid long, rare array<long>, classes"))
    return arrow_map(mapped.join(rare, "rid", "left").select(*columns, "classes", "once", "rare", "found"), second, CLASSED)


def class_pairs(classes: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """[previous, next]: class bigrams of the training texts, an end before each; and those of words that occur once, in open classes."""

    def tally(batches: Iterator[pa.RecordBatch], total: np.ndarray) -> None:
        plain, single = total.reshape(2, ALL * ALL)
        for batch in batches:
            for row, once in zip(batch["classes"], batch["once"]):
                c = np.concatenate([[END_CLASS], np.frombuffer(row.as_buffer(), np.uint8)]).astype(np.int64)
                once = np.frombuffer(once.as_buffer(), np.uint8)
                at = np.flatnonzero(once)
                new = once[at].astype(np.int64)
                plain += np.bincount(c[:-1] * ALL + c[1:], minlength=ALL * ALL)
                both = np.flatnonzero(np.diff(at) == 1)  # two of them side by side
                found = np.concatenate([c[at] * ALL + new, new * ALL + c[at + 2], new[both] * ALL + new[both + 1]])
                single += np.bincount(found, minlength=ALL * ALL)

    found = sum_counters(classes.where("train").select("classes", "once"), tally, 2 * ALL * ALL)
    return tuple(found.reshape(2, ALL, ALL).astype(float))


def score(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """Per row ``doc_id``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``, ``perplexity``."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    counts = stored(word_counts(docs))
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    most = stored(counts.orderBy(F.desc("n"), "hash").limit(FREQUENT))
    top = most.toPandas().sort_values(["n", "hash"], ascending=[False, True])
    hashes = top["hash"].to_numpy(np.int64).view(np.uint64)
    lexicon = Lexicon(hashes, top["n"].to_numpy(np.int64))
    texts = stored(numbered(docs, lexicon))
    class_of = starting_classes()
    for _ in range(SWEEPS):
        class_of = exchange(class_of, *class_contexts(texts, class_of))
    _, after = class_contexts(texts, class_of)
    # Which open class a neighbour has says nothing: as contexts they are one.
    table = np.zeros((ALL, ALL))
    np.add.at(table, one_open(class_of), after.astype(float))
    np.add.at(merged := np.zeros((ALL, ALL)), (slice(None), one_open(np.arange(ALL))), table)
    others = stored(best_classes(other_contexts(texts, lexicon, one_open(class_of)), merged))
    frequent = others.join(F.broadcast(most.select("hash")), "hash", "left_semi")
    classes = stored(classed(texts, lexicon, class_of, others, frequent))
    pairs, single = class_pairs(classes)
    size = pairs.sum(0)
    closed = np.delete(np.arange(ALL), np.arange(CLASSES, END_CLASS))
    size[CLASSES:END_CLASS] = single[closed, CLASSES:END_CLASS].sum(0)
    pairs += single
    # Distinct words by class.
    exchanged = hashes[hashes != np.uint64(END)][:EXCHANGED]
    kinds = np.bincount(class_of[: len(exchanged)], minlength=ALL)
    for number, n in others.groupBy("class").count().collect():
        kinds[number] += n
    kinds[END_CLASS] = 1
    discard(texts, counts, most, others)
    share = (size + 1) / (size.sum() + ALL)
    step = np.log10((pairs + PRIOR * share) / (pairs.sum(1, keepdims=True) + PRIOR)) - np.log10(size + ADD * (kinds + 1))
    shared = docs.sparkSession.sparkContext.broadcast(step)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        log = shared.value
        names = ["doc_id", "held_out", "n_tokens", "known", "mass"]
        for batch in batches:
            paths = []
            for row in batch["classes"]:
                c = np.concatenate([[END_CLASS], np.frombuffer(row.as_buffer(), np.uint8)])
                paths.append(float(log[c[:-1], c[1:]].sum()))
            yield pa.RecordBatch.from_arrays([*[batch[n] for n in names], pa.array(paths, pa.float64())], names=[*names, "path"])

    walked = arrow_map(
        classes.drop("train", "once"), run, "doc_id long, held_out boolean, n_tokens long, known long, mass double, path double"
    )
    base = float(np.log10(total + ADD * (distinct + 1)))
    return walked.select(
        "doc_id",
        "held_out",
        "n_tokens",
        F.col("known").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("mass") - F.col("n_tokens") * base).alias("base_score"),
        (F.col("mass") + F.col("path")).alias("score"),
    ).withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
