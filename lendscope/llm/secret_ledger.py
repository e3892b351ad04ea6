"""Secret scan over an incremental ledger of content-addressed blobs.

Every version of a file is addressed by the SHA-256 of its text. Only pairs of blob and rule version
that the ledger does not hold yet are scanned, each blob once; findings are joined back to all rows
that hold the blob. A task drops its own repeats of a blob before the shuffle, so a blob that a third
of all rows share travels once per task, and the join back carries addresses, not texts.

Defined cases: a null text counts as empty; null ids, repeated rows and repeated ids all keep their
rows; further columns, whatever their names, are not read. Positions count code points, ends are exclusive. An
empty table gives no rows; a text of any length is scanned whole, in time that grows with its square only
where one run of token characters fills it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lendscope.llm.common import arrow_map, stored, text_runs

#: By kind, in the order of reports: version, pattern, words one of which a text must hold (in lower
#: case) to be worth searching, the group that must be long, and its least length.
RULES: dict[str, tuple[int, str, tuple[str, ...], int, int]] = {
    "assign": (
        1,
        r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        ("password", "passwd", "secret", "token", "api"),
        2,
        12,
    ),
    "access": (1, r"AKIA[A-Z0-9]+", ("akia",), 0, 18),
    # The same matches as [0-9a-f]+ with shorter ones dropped.
    "hex": (1, r"[0-9a-f]{16,}", ("",), 0, 16),
    "pem": (1, r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----", ("private key",), 0, 1),
    "jwt": (1, r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", ("eyj",), 0, 1),
    "hub": (1, r"gh[pousr]_[A-Za-z0-9]{36,}", ("gh",), 0, 1),
    "chat": (1, r"xox[abprs]-[A-Za-z0-9-]{10,}", ("xox",), 0, 1),
    "map": (1, r"AIza[A-Za-z0-9_-]{35}", ("aiza",), 0, 1),
    "login": (1, r"://[^\s/:@]{1,64}:[^\s/:@]{1,64}@", ("://",), 0, 1),
}
BASE = ("assign", "access", "hex")
EITHER_CASE = {"assign"}


def compiled(kind: str) -> re.Pattern:
    return re.compile(RULES[kind][1], re.ASCII | (re.IGNORECASE if kind in EITHER_CASE else 0))


def spans(text: str, kinds: list[str], patterns: dict[str, re.Pattern]) -> list[tuple[str, int, int]]:
    low, found = text.lower(), []
    for kind in kinds:
        _, _, words, group, least = RULES[kind]
        if any(w in low for w in words):
            found += [
                (kind, *m.span()) for m in patterns[kind].finditer(text) if m.end(group) - m.start(group) >= least
            ]
    return found


def rule_names() -> dict[str, str]:
    """``kind@version`` by kind."""
    return {kind: f"{kind}@{rule[0]}" for kind, rule in RULES.items()}


def scan_new(blobs: DataFrame, ledger: DataFrame | None) -> DataFrame:
    """Ledger rows for the pairs the ledger lacks: ``blob``, ``rules`` scanned, ``found`` spans."""
    names = rule_names()
    if ledger is None:
        todo = blobs.withColumn("todo", F.array(*map(F.lit, names)))
    else:
        seen = ledger.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("seen"))
        lacking = F.filter(
            F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(v).alias("name")) for k, v in names.items()]),
            lambda r: ~F.array_contains(F.coalesce("seen", F.array().cast("array<string>")), r["name"]),
        )
        todo = blobs.join(seen, "blob", "left").withColumn("todo", F.transform(lacking, lambda r: r["kind"])).where(F.size("todo") > 0)
    span = pa.struct([("kind", pa.string()), ("version", pa.int32()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns = {kind: compiled(kind) for kind in RULES}
        for rows in text_runs(batches, "text"):
            found = [
                [{"kind": k, "version": RULES[k][0], "start": s, "end": e} for k, s, e in spans(text, kinds, patterns)]
                for text, kinds in zip(rows["text"], rows["todo"])
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(rows["blob"], pa.binary()),
                    pa.array([[names[k] for k in kinds] for kinds in rows["todo"]], pa.list_(pa.string())),
                    pa.array(found, pa.list_(span)),
                ],
                names=["blob", "rules", "found"],
            )

    return arrow_map(
        todo.select("blob", "text", "todo"),
        run,
        "blob binary, rules array<string>, found array<struct<kind:string,version:int,start:long,end:long>>",
    )


def scan(docs: DataFrame, ledger: DataFrame | None = None, id_col="doc_id", text_col="text") -> tuple[DataFrame, DataFrame]:
    """Findings per row (``doc_id``, ``blob``, ``found``: spans by start, then kind), and the ledger's new rows."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    versions = docs.select(F.col(id_col).alias("doc_id"), F.unhex(F.sha2(text, 256)).alias("blob"), text.alias("text"))
    blobs = versions.groupBy("blob").agg(F.first("text").alias("text"))
    new = stored(scan_new(blobs, ledger))
    known = new if ledger is None else ledger.select("blob", "rules", "found").unionByName(new)
    current = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(RULES[k][0]).alias("version")) for k in RULES])
    found = known.where(F.size("found") > 0).groupBy("blob").agg(F.flatten(F.collect_list("found")).alias("found"))
    order = F.array(*map(F.lit, RULES))
    ranked = F.transform(
        F.filter("found", lambda s: F.array_contains(current, F.struct(s["kind"].alias("kind"), s["version"].alias("version")))),
        lambda s: F.struct(s["start"].alias("start"), F.array_position(order, s["kind"]).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")),
    )
    sorted_spans = F.array_sort(F.array_distinct(ranked))
    # Stored apart, so that Spark can split the join where one blob has very many rows.
    by_blob = stored(found.select("blob", sorted_spans.alias("found")))
    return versions.select("doc_id", "blob").join(by_blob, "blob", "left"), new


def report(findings: DataFrame) -> DataFrame:
    """Counts and digests per row."""
    shown = lambda spans: F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )
    of = lambda *kinds: F.filter("found", lambda s: s["kind"].isin(*kinds))
    found = F.coalesce("found", F.array().cast("array<struct<start:long,rank:long,end:long,kind:string>>"))
    some = findings.select("doc_id", found.alias("found"))
    return some.select(
        "doc_id",
        *[F.size(of(kind)).cast("long").alias(f"n_{kind}") for kind in BASE],
        F.sha2(shown(of(*BASE)), 256).alias("base_sha256"),
        shown(F.col("found")).alias("spans"),
    )
