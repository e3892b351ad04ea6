"""Exact Jaccard self-join of documents on word shingles: a grouped prefix join.

A document's set holds the 64-bit hashes of its distinct shingles. Sets are ordered by a global order
of shingles that puts frequent ones last; two sets of Jaccard similarity 0.8 must share a shingle
within their prefixes. Documents with the same set are one node; nodes with identical prefixes and
size form one group, and only groups produce prefix rows. Group pairs are filtered by size and by
where their last common prefix shingle stands, expanded to members, filtered by an exact lower bound
on the symmetric difference (parity bitmaps), and then verified on whole sets, recomputed from the
texts of the nodes concerned.

Copies by the thousand need no pairs by the square: in a first few rounds every prefix shingle has one
node drawn as its leader, and every node is compared with the leaders it shares most shingles with.
Where many nodes share a shingle, rounds go on with other draws as long as they connect many. What they
link is connected already, so the last, complete round only takes pairs whose ends are not connected
yet. No link between components is lost: every candidate pair is either verified or lies within a
component.

The order comes from a table of 2^20 counters over the hashes of all shingles, merged per task, so its
size is fixed. Any order gives the same result; a coarse one only costs more candidates.

Defined cases: documents without words, empty or null texts have an empty set, link with nothing and
are their own component. Component ids ignore null document ids; a component of null ids only has a
null id. Rows that repeat an id or a text are rows of the same node. Only the id and text columns are
read, so others may have any name. An empty table gives no rows; a text of any length is taken whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from lendscope.llm.common import arrow_map, components, discard, small_side, stored, sum_counters, text_runs

SHINGLE = 5
#: Similarity of at least NUM / DEN links.
NUM, DEN = 80, 100
COUNTERS = 1 << 20
#: Rounds of leaders; further ones follow on shingles of over MANY heads while at least one in STILL pairs links.
STAR_ROUNDS, STILL, MANY = 2, 20, 16
#: Leaders that a node is compared with in a round.
LEADERS = 3
M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def shingle_sets(texts: list[str], size: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    words = [t.encode("utf-8", "surrogatepass").lower().split() for t in texts]
    ends = np.cumsum([len(w) for w in words], dtype=np.int64)
    hashes = np.fromiter((h for w in words for h in map(xxh3_64_intdigest, w)), np.uint64, ends[-1])
    n = max(len(hashes) - size + 1, 0)
    mixed = np.full(n, size, np.uint64)
    for k in range(size):
        mixed ^= hashes[k : k + n]
        mixed *= M1
        mixed ^= mixed >> np.uint64(29)
    mixed *= M2
    mixed ^= mixed >> np.uint64(32)
    sets, start = [], 0
    for w, end in zip(words, ends.tolist()):
        if len(w) >= size:
            sets.append(np.unique(mixed[start : end - size + 1]))
        else:
            sets.append(np.array([xxh3_64_intdigest(b" ".join(w), len(w))] if w else [], np.uint64))
        start = end
    return sets


def shingle_counts(docs: DataFrame) -> np.ndarray:
    """Occurrences over all documents by counter, ``COUNTERS`` numbers whatever the corpus."""

    def tally(batches: Iterator[pa.RecordBatch], total: np.ndarray) -> None:
        for rows in text_runs(batches, "text"):
            found = np.concatenate([np.empty(0, np.uint64), *shingle_sets(rows["text"])])
            total += np.bincount((found % np.uint64(COUNTERS)).astype(np.int64), minlength=COUNTERS)

    return sum_counters(docs.select("text"), tally, COUNTERS)


def prefix_length(n: int) -> int:
    return n - -(-NUM * n // DEN) + 1


def bitmap(found: np.ndarray) -> bytes:
    """Parity of the hashes by bit; the number of bits is a power of two, at least twice the set's size."""
    bits = 64
    while bits < 2 * len(found):
        bits *= 2
    odd = np.bincount(((found >> np.uint64(20)) % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def fold(bits: bytes, length: int) -> np.ndarray:
    """The bitmap with ``length`` bytes: positions are taken modulo the smaller size."""
    return np.bitwise_xor.reduce(np.frombuffer(bits, np.uint8).reshape(-1, length), axis=0)


def may_link(n_a: int, n_b: int, bits_a: bytes, bits_b: bytes) -> bool:
    """False only if the similarity is below the bound."""
    length = min(len(bits_a), len(bits_b))
    differing = int(np.bitwise_count(fold(bits_a, length) ^ fold(bits_b, length)).sum())
    return (DEN + NUM) * differing <= (DEN - NUM) * (n_a + n_b)


def profiles(docs: DataFrame) -> DataFrame:
    """Per row: ``doc_id``, ``n``, ``node`` (hash of the set; null if empty), ``prefix``, ``bits``."""
    counts = shingle_counts(docs)
    # Classes of frequency: 0 up to four times the mean, then one per doubling.
    rank = np.log2(np.maximum(counts / max(4 * counts.mean(), 1), 1)).astype(np.uint8)
    classes = docs.sparkSession.sparkContext.broadcast(rank)  # 1 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = classes.value
        for rows in text_runs(batches, "text"):
            sets = shingle_sets(rows["text"])
            prefixes, nodes = [], []
            for s in sets:
                k = prefix_length(len(s)) if len(s) else 0
                by = order[(s % np.uint64(COUNTERS)).astype(np.int64)]
                prefixes.append(s[np.argsort(by, kind="stable")[:k]].view(np.int64))
                nodes.append(np.uint64(xxh3_64_intdigest(s.tobytes())).astype(np.int64) if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(rows["doc_id"], pa.int64()),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(nodes, pa.int64()),
                    pa.array(prefixes, pa.list_(pa.int64())),
                    pa.array([bitmap(s) if len(s) else None for s in sets], pa.binary()),
                ],
                names=["doc_id", "n", "node", "prefix", "bits"],
            )

    return arrow_map(docs, run, "doc_id long, n long, node long, prefix array<long>, bits binary")


def filtered(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Candidate pairs (``a``, ``b``) that size and bitmaps leave, with sizes."""
    side = lambda x: nodes.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("bits").alias(f"bits_{x}"))
    joined = pairs.join(side("a"), "a").join(side("b"), "b")
    joined = joined.where((DEN * F.least("n_a", "n_b")) >= NUM * F.greatest("n_a", "n_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = {k: batch[k].to_pylist() for k in ("n_a", "n_b", "bits_a", "bits_b")}
            ok = [may_link(*x) for x in zip(c["n_a"], c["n_b"], c["bits_a"], c["bits_b"])]
            kept = batch.select(["a", "b", "n_a", "n_b"]).filter(pa.array(ok, pa.bool_()))
            yield kept

    return arrow_map(joined, run, "a long, b long, n_a long, n_b long")


def verified(pairs: DataFrame, docs: DataFrame, owners: DataFrame) -> DataFrame:
    """The pairs whose whole sets are similar enough: ``a``, ``b``. ``owners``: a document of each node."""
    wanted = stored(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(owners, "node"))
    ids = small_side(wanted.select("doc_id").distinct(), wanted.count())
    # Rows without id can't be looked up; they are all recomputed and sorted out by node.
    texts = docs.join(ids, "doc_id", "left_semi").unionByName(docs.where("doc_id is null"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in text_runs(batches, "text"):
            sets = [s for s in shingle_sets(rows["text"]) if len(s)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([np.uint64(xxh3_64_intdigest(s.tobytes())).astype(np.int64) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())],
                names=["node", "items"],
            )

    sets = arrow_map(texts.select("text"), run, "node long, items binary").join(wanted.select("node"), "node", "left_semi")
    sets = stored(sets.dropDuplicates(["node"]))
    side = lambda x: sets.select(F.col("node").alias(x), F.col("items").alias(f"items_{x}"))
    joined = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch["items_a"], batch["items_b"]):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                at = np.searchsorted(y, x)
                common = int((y[np.minimum(at, len(y) - 1)] == x).sum())
                ok.append(DEN * common >= NUM * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    out = stored(arrow_map(joined, compare, "a long, b long"))
    discard(wanted, sets)
    return out


def star_edges(docs: DataFrame, profile: DataFrame) -> tuple[DataFrame, ...]:
    """Components of the links found by comparing with leaders, and what the complete round needs."""
    full = profile.where("node is not null")
    owners = stored(full.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.min("n").alias("n")))
    # One row per node; equal sets have equal prefixes and bitmaps.
    nodes = stored(full.select("node", "n", "prefix", "bits").dropDuplicates(["node"]))
    key = F.xxhash64("prefix", "n")
    group = stored(
        nodes.select("node", "n", key.alias("key"))
        .join(nodes.groupBy(key.alias("key")).agg(F.min("node").alias("head")), "key")
        .select("node", "n", "head")
    )
    heads = nodes.join(group.where("node = head").select("node"), "node", "left_semi")
    tokens = heads.select(F.col("node").alias("head"), "n", F.posexplode("prefix").alias("pos", "token"))
    shared = tokens.groupBy("token").agg(F.count("*").alias("m")).where("m > 1").select("token")
    whole = rows = stored(tokens.join(shared, "token"))  # only shingles that meet another group
    members = group.where("node <> head").select(F.col("node").alias("a"), F.col("head").alias("b"))
    close = stored(filtered(members, nodes))
    found = verified(close, docs, owners)
    discard(close)
    at = components(found).withColumnRenamed("id", "node")
    compared, links, k = 0, 0, 0
    while k <= STAR_ROUNDS or links * STILL > compared:
        of_head = at.withColumnRenamed("node", "head")
        labelled = rows.join(of_head, "head", "left").withColumn("label", F.coalesce("label", "head"))
        # A bucket whose heads are connected already has no leader left to try. The complete round takes the
        # whole rows: members that their head did not connect can still have links in such a bucket.
        mixed = labelled.groupBy("token").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.count("*").alias("m"))
        mixed = mixed.where(F.expr("x <> y") & (F.col("m") > (0 if k < STAR_ROUNDS else MANY))).select("token")
        last, rows = rows, stored(rows.join(mixed, "token").select("token", "head", "n"))
        labelled = rows.join(of_head, "head", "left").withColumn("label", F.coalesce("label", "head"))
        draw = F.struct(F.xxhash64("token", "head", F.lit(k)).alias("order"), "label", "head")
        lead = labelled.groupBy("token").agg(F.min(draw).alias("lead"))
        star = (
            labelled.join(lead, "token")
            .where("label <> lead.label")
            .groupBy(F.col("head").alias("a"), F.col("lead.head").alias("b"))
            .agg(F.count("*").alias("shared"))
        )
        closest = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("shared"), "b"))
        best = stored(star.withColumn("place", closest).where(F.col("place") <= LEADERS).select("a", "b"))
        # Stored, so that it is filtered once and no task runs two Python workers.
        close = stored(filtered(best, nodes))
        new = verified(close, docs, owners)
        compared, links, k = best.count(), new.count(), k + 1
        old, found = found, stored(found.union(new))
        discard(best, close, new, old, *([last] if last is not whole else []))
        at = components(found).withColumnRenamed("id", "node")
        if not compared and k > STAR_ROUNDS:
            break
    return at, whole, group, nodes, owners


def live_positions(rows: DataFrame) -> DataFrame:
    """``rows`` (``token``, ``head``, ``n``, ``pos``) with ``pos`` counted as if all other prefix shingles came first.

    ``rank`` has the head's rows before it. What no row has is shared with no group that is still to be compared, so
    it stands in the order before all that may be, like any rarer shingle.
    """
    mine = Window.partitionBy("head")
    length = F.expr(f"n - ({NUM} * n + {DEN - 1}) div {DEN} + 1")
    ranked = rows.withColumns({"rank": F.row_number().over(mine.orderBy("pos")) - 1, "live": F.count("*").over(mine)})
    return ranked.withColumn("pos", length - F.col("live") + F.col("rank")).drop("live")


def rest_edges(docs, at, rows, group, nodes, owners) -> DataFrame:
    """The complete round: all pairs of groups with a common prefix shingle, where not yet connected (``at``)."""
    member = stored(group.join(at, "node", "left").withColumn("label", F.coalesce("label", "node")))
    # A group's label, or null where its members are not all connected.
    one = member.groupBy("head").agg(F.min("label").alias("x"), F.max("label").alias("y"))
    one = one.select("head", F.when(F.col("x") == F.col("y"), F.col("x")).alias("label"))
    marked = rows.join(one, "head")
    mixed = marked.groupBy("token").agg(
        F.min("label").alias("x"), F.max("label").alias("y"), F.max(F.col("label").isNull()).alias("open")
    ).where("x <> y or open or x is null").select("token")
    marked = stored(live_positions(marked.join(mixed, "token")))
    left, right = (
        marked.select("token", F.col("pos").alias(f"p{x}"), F.col("rank").alias(f"r{x}"), F.col("head").alias(f"h{x}"), F.col("n").alias(f"n{x}"), F.col("label").alias(f"l{x}"))
        for x in "ab"
    )
    # Prefixes follow the global order, so beyond the shared prefix shingles two sets can only share what comes
    # after the last of them, and before any of them only what may be shared at all. All members of a group have its prefix and size, so this holds for each pair of members.
    most = "count(*) + least(na - max(pa), nb - max(pb)) - 1"
    groups = (
        left.join(right, "token")
        .where("ha < hb and not coalesce(la = lb, false)")
        .where(f"{DEN} * least(na, nb) >= {NUM} * greatest(na, nb)")
        .where(f"{DEN + NUM} * (least(ra, rb) + least(na - pa, nb - pb)) >= {NUM} * (na + nb)")
        .groupBy("ha", "hb", "na", "nb")
        .agg(F.expr(most).alias("most"))
        .where(f"{DEN + NUM} * most >= {NUM} * (na + nb)")
        .select("ha", "hb")
    )
    ours, theirs = (member.select(F.col("head").alias(f"h{x}"), F.col("node").alias(x), F.col("label").alias(f"l{x}")) for x in "ab")
    between = groups.join(ours, "ha").join(theirs, "hb").where("la <> lb").select("a", "b")
    # Members of one group that its head did not connect.
    split = one.where("label is null").select("head")
    open_members = member.join(split, "head", "left_semi")
    x, y = (open_members.select("head", F.col("node").alias(s), F.col("label").alias(f"l{s}")) for s in "ab")
    within = x.join(y, "head").where("a < b and la <> lb").select("a", "b")
    pairs = stored(filtered(between.union(within).distinct(), nodes))
    return verified(pairs, docs, owners)


def near_duplicates(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """Per row ``doc_id``, ``n_shingles`` and ``component_id``, the smallest id that links reach."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    profile = stored(profiles(docs))
    at, rows, group, nodes, owners = star_edges(docs, profile)
    rest = rest_edges(docs, at, rows, group, nodes, owners)
    # The last links connect components: contract them to labels.
    label = lambda x: F.coalesce(f"label_{x}", x).alias(x)
    of_a, of_b = (at.select(F.col("node").alias(x), F.col("label").alias(f"label_{x}")) for x in "ab")
    last = components(rest.join(of_a, "a", "left").join(of_b, "b", "left").select(label("a"), label("b")))
    node = (
        owners.join(at, "node", "left")
        .withColumn("label", F.coalesce("label", "node"))
        .join(last.select(F.col("id").alias("label"), F.col("label").alias("last")), "label", "left")
        .select("node", "doc_id", F.coalesce("last", "label").alias("label"))
    )
    smallest = node.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    ids = node.join(smallest, "label").select("node", "component_id")
    return profile.join(ids, "node", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")
    )
