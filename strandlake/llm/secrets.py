"""Secret scans over an incremental, content-addressed blob ledger.

Every distinct text (blob) is known by its SHA-256. The ledger holds one entry for each
(blob, rule, rule version) that has been scanned, with the spans found, none included. A
run scans only what the ledger lacks and joins the findings back to every path that holds
the blob (``Ledger`` keeps both tables; a document's path is its doc_id). All of it is DataFrame functions: positions come from the lengths of the pieces
between matches, so no Python runs on the executors.

Defined results: null text is the empty text (no findings); equal texts are scanned once
and all their rows get the findings; spans count code points, end exclusive; within a rule
they are leftmost and non-overlapping; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch_path, small_side, spool, text_or_empty


@dataclass(frozen=True)
class Rule:
    """``pattern`` is a Java regular expression; a match counts if ``group`` has ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    version: int = 1


#: The base rules, in the order that breaks ties of equal starts.
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
#: Further rules of this scanner.
MORE = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
)
RULES = BASE + MORE

SPANS = "array<struct<start:int,end:int>>"
LEDGER_SCHEMA = f"blob string, rule string, version int, spans {SPANS}"


def blob_of(text: Column) -> Column:
    return F.sha2(text, 256)


def rule_spans(text: Column, rule: Rule) -> Column:
    """``array<struct<start, end>>`` of a rule's matches, in code points.

    The pieces between matches and the matches alternate, so running sums of their lengths
    are the positions; they are formed only for texts that match at all.
    """
    pattern = F.lit(rule.pattern)
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    # pieces after the last match bring nothing; zipping pads them with null lengths
    sizes = F.transform(
        F.arrays_zip(F.split(text, rule.pattern, -1).alias("piece"), found.alias("match"), F.regexp_extract_all(text, pattern, F.lit(rule.group)).alias("value")),
        lambda x: F.struct(F.length(x["piece"]).alias("gap"), F.length(x["match"]).alias("size"), F.length(x["value"]).alias("value")),
    )
    empty = F.expr(f"cast(array() as {SPANS})")
    summed = F.aggregate(
        sizes,
        F.struct(F.lit(0).alias("at"), empty.alias("out")),
        lambda acc, x: F.struct(
            (acc["at"] + x["gap"] + F.coalesce(x["size"], F.lit(0))).alias("at"),
            F.when(
                x["value"] >= rule.least,
                F.concat(acc["out"], F.array(F.struct((acc["at"] + x["gap"]).alias("start"), (acc["at"] + x["gap"] + x["size"]).alias("end")))),
            )
            .otherwise(acc["out"])
            .alias("out"),
        ),
    )["out"]
    return F.when(text.rlike(rule.pattern), summed).otherwise(empty)


def scan_blobs(docs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """New ledger entries for ``docs(text)``: one per blob and rule that ``ledger`` has not scanned in that version."""
    blobs = docs.select(text_or_empty().alias("text")).select(blob_of(F.col("text")).alias("blob"), "text").distinct()
    if ledger is None:
        seen = F.array().cast("array<string>")
    else:
        known = ledger.groupBy(F.col("blob").alias("known_blob")).agg(F.collect_set(F.concat_ws("@", "rule", "version")).alias("known"))
        blobs = blobs.join(known, blobs.blob == known.known_blob, "left")
        seen = F.coalesce(F.col("known"), F.array().cast("array<string>"))
    entries = F.array(
        *[
            F.when(
                ~F.array_contains(seen, f"{r.kind}@{r.version}"),
                F.struct(F.lit(r.kind).alias("rule"), F.lit(r.version).alias("version"), rule_spans(F.col("text"), r).alias("spans")),
            )
            for r in rules
        ]
    )
    return blobs.select("blob", F.explode(entries).alias("e")).where("e is not null").select("blob", "e.rule", "e.version", "e.spans")


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def findings(entries: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per blob with any finding under the rules' current versions: counts by base kind, base and all spans in order."""
    order = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r.kind), F.lit(i))])
    current = F.array(*[F.lit(f"{r.kind}@{r.version}") for r in rules])
    each = (
        entries.where(F.size("spans") > 0)
        .where(F.array_contains(current, F.concat_ws("@", "rule", "version")))
        .select("blob", F.col("rule").alias("kind"), order[F.col("rule")].alias("rank"), "spans")
        .groupBy("blob")
        .agg(F.collect_list(F.struct("rank", "kind", "spans")).alias("by_rule"))
    )
    spans = F.array_sort(
        F.flatten(F.transform("by_rule", lambda r: F.transform(r["spans"], lambda s: F.struct(s["start"].alias("start"), r["rank"].alias("rank"), s["end"].alias("end"), r["kind"].alias("kind")))))
    )
    return each.select("blob", spans.alias("found"))


class Ledger:
    """A stored ledger: ``entries`` (blob, rule, version, spans) and ``paths`` (path, blob) as Parquet below ``root``.

    ``record`` appends what is new: each version of a path (a version is the blob that the path
    held), and an entry for every blob and rule version not scanned before. Both are written
    by Spark's committed appends, so a run that breaks off leaves nothing behind and is
    repeated; a run that is repeated scans nothing again. Paths may be null.
    """

    ENTRIES, PATHS = LEDGER_SCHEMA, "path long, blob string"

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _table(self, name: str, schema: str) -> DataFrame:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        there = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}") if there else self.spark.createDataFrame([], schema)

    @property
    def entries(self) -> DataFrame:
        return self._table("entries", self.ENTRIES)

    @property
    def paths(self) -> DataFrame:
        return self._table("paths", self.PATHS)

    def record(self, docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> None:
        """Takes up the versions of ``docs(doc_id, text)`` and scans what is unseen of them."""
        versions = docs.select(F.col("doc_id").cast("long").alias("path"), blob_of(text_or_empty()).alias("blob")).distinct()
        old = self.paths
        if old.take(1):
            versions = versions.join(old.select(F.col("path").alias("old_path"), F.col("blob").alias("old_blob")), F.col("path").eqNullSafe(F.col("old_path")) & (F.col("blob") == F.col("old_blob")), "left_anti")
        versions.write.mode("append").parquet(f"{self.root}/paths")
        known = self.entries
        scan_blobs(docs, known if known.take(1) else None, rules).write.mode("append").parquet(f"{self.root}/entries")

    def findings(self, rules: tuple[Rule, ...] = RULES) -> DataFrame:
        """``blob, found`` of every blob with a finding under the rules' versions."""
        return findings(self.entries, rules)

    def history(self, rules: tuple[Rule, ...] = RULES) -> DataFrame:
        """``path, blob, found``: findings joined back to every path that ever held the blob."""
        return self.paths.join(small_side(spool(self.findings(rules))), "blob").select("path", "blob", "found")


def _recorded(docs: DataFrame, ledger: Ledger | None, rules: tuple[Rule, ...]) -> DataFrame:
    """``blob, found`` from the ledger after it has taken up ``docs``; without one, from a new one."""
    ledger = ledger or Ledger(docs.sparkSession, scratch_path(docs.sparkSession, "ledger"))
    ledger.record(docs, rules)
    return spool(ledger.findings(rules))


def scan_documents(docs: DataFrame, ledger: Ledger | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Findings joined back to every row: ``doc_id, n_assign, n_access, n_hex, base_sha256, spans, found``.

    The rows are recorded in ``ledger`` first (a new one if none is given); blobs that it has
    seen are not scanned again.
    """
    found = _recorded(docs, ledger, rules)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), blob_of(text_or_empty()).alias("blob"))
    base = F.filter("found", lambda x: x["rank"] < len(BASE))
    count = lambda kind: F.coalesce(F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long"), F.lit(0).cast("long"))
    digested = found.select(
        "blob",
        "found",
        *[count(r.kind).alias(f"n_{r.kind}") for r in BASE],
        F.sha2(_joined(base), 256).alias("base_sha256"),
        _joined(F.col("found")).alias("spans"),
    )
    nothing = F.sha2(F.lit(""), 256)
    return rows.join(small_side(digested), "blob", "left").select(
        "doc_id",
        *[F.coalesce(F.col(f"n_{r.kind}"), F.lit(0).cast("long")).alias(f"n_{r.kind}") for r in BASE],
        F.coalesce("base_sha256", nothing).alias("base_sha256"),
        F.coalesce("spans", F.lit("")).alias("spans"),
        F.coalesce("found", F.expr("cast(array() as array<struct<start:int,rank:int,end:int,kind:string>>)")).alias("found"),
    )


def redact(text: Column, found: Column, mark: str = "[SECRET]") -> Column:
    """The text with every found span (overlapping ones together) replaced by ``mark``."""
    state = F.aggregate(
        found,
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda acc, x: F.struct(
            F.greatest(acc["at"], x["end"]).alias("at"),
            F.when(x["end"] <= acc["at"], acc["out"])
            .when(x["start"] < acc["at"], acc["out"])
            .otherwise(F.concat(acc["out"], F.substring(text, acc["at"] + 1, x["start"] - acc["at"]), F.lit(mark)))
            .alias("out"),
        ),
    )
    return F.when(F.size(found) > 0, F.concat(state["out"], F.substring(text, state["at"] + 1, F.length(text)))).otherwise(text)


def redact_documents(docs: DataFrame, ledger: Ledger | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with the same columns and rows, secrets in ``text`` replaced; ``n_chars`` follows the new text."""
    found = small_side(_recorded(docs, ledger, rules).select(F.col("blob").alias("found_blob"), "found"))
    keyed = docs.withColumn("__blob", blob_of(text_or_empty()))
    joined = keyed.join(found, keyed["__blob"] == found["found_blob"], "left")
    text = F.when(F.col("found").isNotNull(), redact(F.col("text"), F.col("found"))).otherwise(F.col("text"))
    kept = [c for c in docs.columns if c not in ("text", "n_chars")]
    return (
        joined.withColumn("__text", text)
        .select(*kept, F.col("__text").alias("text"), *([F.when(F.col("found").isNotNull(), F.length("__text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars")] if "n_chars" in docs.columns else []))
        .select(*docs.columns)
    )
