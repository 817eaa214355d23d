"""Secret scans over an incremental ledger of blobs.

Every historical version of a file is a blob, addressed by the SHA-256 of its text, so a text that many paths or versions
share is one blob. The ledger says which blob was scanned by which version of which rule, and holds what was found. A scan
takes only the blobs, and for each only the rules, that the ledger does not have, adds to it, and joins the findings back to
all paths.

Positions come from the pieces between the matches: the lengths of pieces and matches, added up, are the starts and ends. All
of it is DataFrame expressions. Texts are shuffled once, by digest, to make one blob of equal texts; a text that a third of
all rows share is combined before the shuffle. Findings are rows; the running sum is over the findings of one blob.

Defined results: null text is the empty text; an empty text or table has no findings; positions are code points, ends
exclusive; matches of a rule are leftmost and do not overlap, and a match that is too short is dropped after it was
consumed; repeated rows get equal results; other columns are not read.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hiregrid.session import shared_folder


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    least: int  # code points that the group must have
    group: int = 0
    version: int = 1


RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2),
    # A match of these two is a whole run, so that runs too short need not be matched and then dropped.
    Rule("access", r"AKIA[A-Z0-9]{16,}", 20),
    Rule("hex", r"[0-9a-f]{24,}", 24),
)
FINDINGS = "blob string, kind string, start bigint, end bigint, version int"
SCANNED = "blob string, kind string, version int"


class Ledger:
    """Two growing tables in a folder: the pairs of blob and rule version that were scanned, and the findings."""

    def __init__(self, folder: str):
        self.folder = folder

    def read(self, spark, name: str, schema: str) -> DataFrame:
        try:
            return spark.read.schema(schema).parquet(f"{self.folder}/{name}")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return None

    def scanned(self, spark) -> DataFrame | None:
        return self.read(spark, "scanned", SCANNED)

    def findings(self, spark) -> DataFrame:
        return self.read(spark, "findings", FINDINGS)


def new_ledger(spark) -> Ledger:
    return Ledger(f"{shared_folder(spark)}/ledger-{uuid.uuid4().hex}")


def blob_id(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def matches(rule: Rule, number: int, wanted: Column) -> Column:
    """Per match, in order: lengths of the piece before it, of the match and of its group; null where nothing matches."""
    text, pattern = F.col("text"), F.lit(rule.pattern)
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    judged = found if rule.group == 0 else F.regexp_extract_all(text, pattern, F.lit(rule.group))
    zipped = F.arrays_zip(
        F.slice(F.split(text, rule.pattern, -1), F.lit(1), F.size(found)).alias("before"), found.alias("found"), judged.alias("judged")
    )
    lengths = F.transform(zipped, lambda m: F.struct(
        F.lit(number).alias("rule"), F.length(m["before"]).cast("bigint").alias("gap"),
        F.length(m["found"]).cast("bigint").alias("long"), F.length(m["judged"]).alias("judged"),
    ))
    return F.when(wanted & text.rlike(rule.pattern), lengths)


def scan(blobs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """Findings of ``blobs(blob, text, seen)``, by all rules that ``seen`` (kind:version) does not name."""
    tried = [
        F.coalesce(matches(rule, n, ~F.array_contains("seen", f"{rule.kind}:{rule.version}")), F.array())
        for n, rule in enumerate(rules)
    ]
    rows = blobs.select("blob", F.posexplode(F.concat(*tried))).select("blob", "pos", "col.*")
    so_far = Window.partitionBy("blob", "rule").orderBy("pos")
    least = F.element_at(F.array(*[F.lit(r.least) for r in rules]), F.col("rule") + 1)
    kind = F.element_at(F.array(*[F.lit(r.kind) for r in rules]), F.col("rule") + 1)
    version = F.element_at(F.array(*[F.lit(r.version) for r in rules]), F.col("rule") + 1)
    return rows.withColumn("end", F.sum(F.col("gap") + F.col("long")).over(so_far)).where(F.col("judged") >= least).select(
        "blob", kind.alias("kind"), (F.col("end") - F.col("long")).alias("start"), "end", version.alias("version")
    )


def update(docs: DataFrame, ledger: Ledger, rules: tuple[Rule, ...] = RULES) -> None:
    """Scan what the ledger has not seen of ``docs(text)`` and add it."""
    spark = docs.sparkSession
    texts = docs.select(blob_id(F.col("text")).alias("blob"), F.coalesce("text", F.lit("")).alias("text"))
    done = ledger.scanned(spark)
    none = F.array().cast("array<string>")
    names = [f"{r.kind}:{r.version}" for r in rules]
    if done is not None:
        # Only the batch's blobs are grouped; a small batch is broadcast to the ledger, which is then read but not shuffled.
        asked = done.join(texts.select("blob").distinct(), "blob", "left_semi")
        seen = asked.groupBy("blob").agg(F.collect_set(F.concat_ws(":", "kind", "version")).alias("seen"))
        texts = texts.join(seen, "blob", "left").withColumn("seen", F.coalesce("seen", none)).where(
            F.size(F.array_except(F.array(*map(F.lit, names)), F.col("seen"))) > 0
        )
    else:
        texts = texts.withColumn("seen", none)
    blobs = texts.groupBy("blob").agg(F.any_value("text").alias("text"), F.any_value("seen").alias("seen"))
    scan(blobs, rules).write.mode("append").parquet(f"{ledger.folder}/findings")
    pairs = F.filter(F.array(*[F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version")) for r in rules]),
                     lambda p: ~F.array_contains("seen", F.concat_ws(":", p["kind"], p["version"])))
    # Findings first: a pair is only marked when what it found is stored.
    texts.select("blob", "seen").distinct().select("blob", F.inline(pairs)).write.mode("append").parquet(f"{ledger.folder}/scanned")


def findings_by_path(docs: DataFrame, ledger: Ledger, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs(doc_id, text)``, one row each: spans (rule, kind, start, end) in order of start, then rule."""
    spark = docs.sparkSession
    current = F.array(*[F.lit(f"{r.kind}:{r.version}") for r in rules])
    # A finding is stored under its kind and version; its place among the rules is that of the list given now.
    number = (F.array_position(current, F.concat_ws(":", "kind", "version")) - 1).cast("int")
    found = ledger.findings(spark).withColumn("rule", number).where("rule >= 0")
    by_blob = found.groupBy("blob").agg(F.array_sort(F.collect_set(F.struct("start", "rule", "kind", "end"))).alias("spans"))
    paths = docs.select("doc_id", blob_id(F.col("text")).alias("blob"))
    empty = F.array().cast("array<struct<start:bigint,rule:int,kind:string,end:bigint>>")
    return paths.join(by_blob, "blob", "left").select("doc_id", F.coalesce("spans", empty).alias("spans"))


def scan_documents(docs: DataFrame, ledger: Ledger | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Bring the ledger up to date with ``docs`` and return the findings of every row."""
    ledger = ledger or new_ledger(docs.sparkSession)
    update(docs, ledger, rules)
    return findings_by_path(docs, ledger, rules)
