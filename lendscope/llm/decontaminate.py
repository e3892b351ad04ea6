"""Benchmark decontamination by template canonicalisation.

Words are lower-cased and stripped of outer punctuation; numbers, units after numbers and names
(capitalised words inside a sentence) become typed placeholders. Windows of canonical tokens of
the documents are hash-joined to the windows of the benchmark items. Hits on one diagonal (document
position minus item position) are checked for slot consistency: each value an item's slot holds must
always meet the same value in the document. A document leaks an item when the consistent hits of a
diagonal cover ``MIN_COVER`` of the item's windows, or ``LONG_RUN`` tokens.

Windows with fewer literal words than half their length, and all windows of items with fewer than
``MIN_LITERALS`` literal words, say too little as templates. They are searched for as they stand:
lower-cased words with their numbers and names. Such hits count together with consistent ones, and then
must cover ``MIN_COVER`` of all of the item's windows, or ``LONG_RUN`` tokens.

A Bloom filter of fixed size over the benchmark's window hashes drops almost all document windows in
the scan; what passes is joined exactly, so the benchmark may be of any size. Items shorter than a
window are one window of their own length, so every item with a word is searched for. In scripts that
put no spaces between words each character is a word.

Defined cases: null and empty texts have no windows and leak nothing; null item ids are ignored as
items; null document ids are reported under their text's hash. Repeated rows give repeated results.
Only the id and text columns are read, and those in ``keep``, whose names must differ from the results'.
Empty tables give no rows or no leaks; a text of any length is searched whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain, compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from lendscope.llm.common import arrow_map, keyed, small_side, stored, text_runs

WINDOW = 8
MIN_LITERALS = 5
MIN_COVER = 0.5
LONG_RUN = 13
BLOOM_BITS = 1 << 24
CACHE = 300_000

#: Units that follow a number.
UNITS = set(
    "kg g mg lb lbs oz t km m cm mm mi mile miles ft feet inch inches yd l ml s sec second seconds min minute minutes "
    "h hr hour hours day days week weeks month months year years usd eur gbp dollar dollars euro euros cent cents "
    "percent kmh mph w kw v a hz gb mb kb".split()
)
NUMBER = re.compile(r"[+-]?[$€£]?\d[\d.,:/]*%?")
EDGE = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())
NUM, UNIT, NAME = (xxh3_64_intdigest(x) for x in ("\0number", "\0unit", "\0name"))
#: Flags in the low bits of a word's code, below its hash.
IS_NUMBER, IS_UNIT, IS_CAPITAL, ENDS, IS_MARK, FLAGS = 1, 2, 4, 8, 16, 31
OUTER = "()[]\"',.;:!?"
#: Thai to Myanmar, Khmer, kana, and Han with its extensions.
UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
HAS_UNSPACED, SPLIT_UNSPACED = re.compile(f"[{UNSPACED}]"), re.compile(rf"[{UNSPACED}]|[^\s{UNSPACED}]+")
#: Kinds of windows.
TEMPLATE, VERBATIM = 0, 1
MIX = np.uint64(0x9E3779B97F4A7C15)


def code(word: str) -> int:
    """Hash of the canonical word, with its flags in the low bits."""
    if word.isalpha():
        core, flags = word, 0
    else:
        core = word.strip(EDGE)
        flags = ENDS * word.rstrip("\"')]").endswith((".", "!", "?", ":"))
        if NUMBER.fullmatch(word.strip(OUTER)):
            return NUM & ~FLAGS | flags | IS_NUMBER
    low = core.lower()
    flags |= IS_UNIT * (low in UNITS) | IS_CAPITAL * core[:1].isupper() | IS_MARK * (not core)
    return xxh3_64_intdigest(low.encode("utf-8", "surrogatepass")) & ~FLAGS | flags


class Codes(dict):
    """Codes of the words seen, forgotten when there are too many."""

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE:
            self.clear()
        value = self[word] = code(word)
        return value


def split(text: str) -> list[str]:
    return text.split() if text.isascii() or not HAS_UNSPACED.search(text) else SPLIT_UNSPACED.findall(text)


def verbatim(words: list[list[str]], found: np.ndarray) -> np.ndarray:
    """Hashes of the lower-cased words; numbers and marks, which share codes, by their own characters."""
    hashes, own = found & ~np.uint64(FLAGS), found & np.uint64(IS_NUMBER | IS_MARK) > 0
    shown = (w.strip(OUTER) or w for w in compress(chain.from_iterable(words), own.tolist()))
    hashes[own] = np.fromiter((xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) for w in shown), np.uint64, int(own.sum()))
    return hashes


def canonical(texts: list[str], codes: Codes) -> tuple[list[list[str]], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words by text; over all texts, canonical hashes, whether each is a slot, where texts end, and the words' codes."""
    words = [split(t) for t in texts]
    ends = np.cumsum([len(w) for w in words], dtype=np.int64)
    found = np.fromiter((c for w in words for c in map(codes.__getitem__, w)), np.uint64, ends[-1])
    flags, hashes = found & np.uint64(FLAGS), found & ~np.uint64(FLAGS)
    first = np.zeros(len(found) + 1, bool)
    first[ends] = first[0] = True
    first = first[:-1]
    before = np.concatenate([[0], flags[:-1]]).astype(np.uint64)
    number = flags & IS_NUMBER > 0
    unit = (flags & IS_UNIT > 0) & (before & IS_NUMBER > 0) & ~first
    name = (flags & IS_CAPITAL > 0) & ~unit & ~first & (before & ENDS == 0)
    hashes[unit], hashes[name] = UNIT & ~FLAGS, NAME & ~FLAGS
    return words, hashes, number | unit | name, ends, found


def windows(hashes: np.ndarray, slots: np.ndarray | None, ends: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the windows inside one text that have enough literal words; without ``slots``, of all."""
    n = len(hashes) - size + 1
    if n < 1:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    mixed = np.full(n, size if slots is not None else size + WINDOW, np.uint64)
    for k in range(size):
        mixed ^= hashes[k : k + n]
        mixed *= MIX
        mixed ^= mixed >> np.uint64(29)
    if slots is None:
        ok = np.ones(n, bool)
    else:
        literal = np.concatenate([[0], np.cumsum(~slots)])
        ok = 2 * (literal[size:] - literal[:-size]) >= size
    for k in range(1, size):
        at = ends - k
        ok[at[(at >= 0) & (at < n)]] = False
    at = np.flatnonzero(ok)
    return at, mixed[at]


def slot_values(words: list[str], slots: np.ndarray) -> list[str]:
    return [w.strip(EDGE).lower() for w, s in zip(words, slots) if s]


HIT = pa.schema([("key", pa.int64()), ("hash", pa.int64()), ("size", pa.int32()), ("kind", pa.int32()), ("pos", pa.int64()), ("slots", pa.list_(pa.string()))])
ITEM_DDL = "key long, hash long, size int, kind int, pos long, slots array<string>, n long, total long"


def _as_long(hashes: np.ndarray) -> np.ndarray:
    return hashes.view(np.int64)


def item_windows(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = Codes()
        for batch in batches:
            rows = []
            for key, text in zip(batch["key"].to_pylist(), batch["text"].to_pylist()):
                (words,), hashes, slots, ends, found = canonical([text], codes)
                if not words:
                    continue
                size = min(WINDOW, len(words))
                at, whole = windows(hashes, slots, ends, size)
                if (~slots).sum() < MIN_LITERALS:
                    at, whole = at[:0], whole[:0]
                rows += [
                    (key, h, size, TEMPLATE, p, slot_values(words[p : p + size], slots[p : p + size]), len(at))
                    for p, h in zip(at.tolist(), _as_long(whole).tolist())
                ]
                every, plain = windows(verbatim([words], found), None, ends, size)
                left = ~np.isin(every, at)
                rows += [(key, h, size, VERBATIM, p, [], len(at)) for p, h in zip(every[left].tolist(), _as_long(plain[left]).tolist())]
                rows[-len(every) :] = [(*r, len(every)) for r in rows[-len(every) :]]
            yield pa.RecordBatch.from_pylist(
                [dict(zip(("key", "hash", "size", "kind", "pos", "slots", "n", "total"), r)) for r in rows],
                schema=pa.schema([*HIT, ("n", pa.int64()), ("total", pa.int64())]),
            )

    rows = items.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return arrow_map(rows.distinct(), run, ITEM_DDL)


def bloom(hashes: np.ndarray) -> np.ndarray:
    """Bits set at two places per hash."""
    bits = np.zeros(BLOOM_BITS // 8, np.uint8)
    for shift in (0, 32):
        at = (hashes >> np.uint64(shift)) % np.uint64(BLOOM_BITS)
        np.bitwise_or.at(bits, (at >> np.uint64(3)).astype(np.int64), (1 << (at & np.uint64(7))).astype(np.uint8))
    return bits


def passes(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    ok = np.ones(len(hashes), bool)
    for shift in (0, 32):
        at = (hashes >> np.uint64(shift)) % np.uint64(BLOOM_BITS)
        ok &= (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0
    return ok


def bloom_of(table: DataFrame) -> np.ndarray:
    """The filter over column ``hash``: one of fixed size per task, merged pairwise on the way to the driver."""

    def part(rows) -> Iterator[bytes]:
        import zstandard

        bits, block = np.zeros(BLOOM_BITS // 8, np.uint8), []
        for r in rows:
            block.append(r[0] & 0xFFFFFFFFFFFFFFFF)
            if len(block) == 100_000:
                bits |= bloom(np.array(block, np.uint64))
                block = []
        yield zstandard.compress((bits | bloom(np.array(block, np.uint64))).tobytes())

    def merge(a: bytes, b: bytes) -> bytes:
        import zstandard

        x, y = (np.frombuffer(zstandard.decompress(v), np.uint8) for v in (a, b))
        return zstandard.compress((x | y).tobytes())

    import zstandard

    packed = table.select("hash").rdd.mapPartitions(part).treeReduce(merge)
    return np.frombuffer(zstandard.decompress(packed), np.uint8)


def leaks(docs: DataFrame, items: DataFrame, id_col="doc_id", text_col="text", item_id="item_id", item_text="text") -> DataFrame:
    """One row per leaked item and place: ``_id``, ``_fp``, ``item_id``, ``start`` (word), ``n_windows``, ``cover``, ``reworded``."""
    table = stored(item_windows(items, item_id, item_text))
    spark = docs.sparkSession
    families = [(r[0], r[1]) for r in table.select("kind", "size").distinct().collect()]  # at most 2 * WINDOW
    bits = spark.sparkContext.broadcast(bloom_of(table))  # BLOOM_BITS / 8 bytes, whatever the benchmark

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, have = Codes(), bits.value
        for rows in text_runs(batches, "_text"):
            words, hashes, slots, ends, found = canonical(rows["_text"], codes)
            plain = verbatim(words, found) if any(kind == VERBATIM for kind, _ in families) else None
            starts = np.concatenate([[0], ends[:-1]])
            out: list[dict] = []
            for kind, size in families:
                at, whole = windows(hashes, slots, ends, size) if kind == TEMPLATE else windows(plain, None, ends, size)
                hit = passes(have, whole)
                at, whole = at[hit], whole[hit]
                of = np.searchsorted(ends, at, "right")
                for p, h, d, q in zip(at.tolist(), _as_long(whole).tolist(), of.tolist(), (at - starts[of]).tolist()):
                    values = slot_values(words[d][q : q + size], slots[p : p + size]) if kind == TEMPLATE else []
                    out.append({"_id": rows["_id"][d], "_fp": rows["_fp"][d], "hash": h, "size": size, "kind": kind, "pos": q, "values": values})
            yield pa.RecordBatch.from_pylist(out, schema=doc_schema)

    doc_schema = pa.schema([("_id", pa.int64()), ("_fp", pa.int64()), ("hash", pa.int64()), ("size", pa.int32()), ("kind", pa.int32()), ("pos", pa.int64()), ("values", pa.list_(pa.string()))])
    hits = arrow_map(keyed(docs, id_col, text_col), run, "_id long, _fp long, hash long, size int, kind int, pos long, values array<string>").distinct()
    met = hits.join(table.select("hash", "size", "kind", F.col("key").alias("item_id"), F.col("pos").alias("at"), "slots", "n", "total"), ["hash", "size", "kind"])
    # Hits of a diagonal: at most one per window of the item.
    template = F.when(F.col("kind") == TEMPLATE, F.col("at"))
    diagonal = met.groupBy("_id", "_fp", "item_id", "n", "total", "size", (F.col("pos") - F.col("at")).alias("start")).agg(
        F.count_distinct(template).alias("templates"),
        F.count_distinct("at").alias("hits"),
        F.array_distinct(F.flatten(F.collect_list(F.arrays_zip(F.col("slots").alias("want"), F.col("values").alias("have"))))).alias("pairs"),
    )
    consistent = F.size("pairs") == F.size(F.array_distinct(F.transform("pairs", lambda p: p["want"])))
    # Inconsistent templates count for nothing, verbatim windows hold their values themselves.
    judged = diagonal.select(
        "*",
        F.when(consistent, F.col("templates")).otherwise(0).alias("fitting"),
        F.when(consistent, F.col("hits")).otherwise(F.col("hits") - F.col("templates")).alias("n_windows"),
    )
    enough = (
        ((F.col("fitting") > 0) & (F.col("fitting") >= MIN_COVER * F.col("n")))
        | ((F.col("n_windows") > 0) & (F.col("n_windows") >= MIN_COVER * F.col("total")))
        | ((F.col("n_windows") > 0) & (F.col("n_windows") + F.col("size") - 1 >= LONG_RUN))
    )
    return judged.where(enough).select(
        "_id", "_fp", "item_id", "start", "n_windows",
        (F.col("n_windows") / F.col("total")).alias("cover"),
        (consistent & F.exists("pairs", lambda p: p["want"] != p["have"])).alias("reworded"),
    )


def decontaminate(docs: DataFrame, items: DataFrame, id_col="doc_id", text_col="text", item_id="item_id", item_text="text", keep=()) -> DataFrame:
    """Per row ``doc_id``, ``n_leaks``, ``n_items``, ``reworded``, ``items`` (sorted ids, comma-joined), then ``keep``."""
    found = stored(
        leaks(docs, items, id_col, text_col, item_id, item_text)
        .groupBy(F.col("_id").alias("_leak_id"), F.col("_fp").alias("_leak_fp"))
        .agg(
            F.count("*").alias("n_leaks"),
            F.count_distinct("item_id").alias("n_items"),
            F.max("reworded").alias("reworded"),
            F.array_join(F.array_sort(F.collect_set("item_id")).cast("array<string>"), ",").alias("items"),
        )
    )
    rows = keyed(docs, id_col, text_col, *[F.col(c).alias(f"_keep_{c}") for c in keep])
    rows = rows.drop("_text")
    joined = rows.join(small_side(found, 5 * found.count()), rows._id.eqNullSafe(found._leak_id) & (rows._fp == found._leak_fp), "left")
    return joined.select(
        F.col("_id").alias("doc_id"),
        F.coalesce("n_leaks", F.lit(0)).alias("n_leaks"),
        F.coalesce("n_items", F.lit(0)).alias("n_items"),
        F.coalesce("reworded", F.lit(False)).alias("reworded"),
        F.coalesce("items", F.lit("")).alias("items"),
        *[F.col(f"_keep_{c}").alias(c) for c in keep],
    )
