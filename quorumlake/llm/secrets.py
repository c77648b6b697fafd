"""Secret scans through an incremental blob ledger, in DataFrame functions only.

Every version of every path is content-addressed by SHA-256. The ledger holds, for each blob that was scanned, the
rule versions with the spans found (none included), in parts by blob. A run scans only the pairs of blob and
rule version that the ledger lacks, appends them, and joins the spans back to all paths that hold the blob.
It reads the parts that its own blobs are in, and of those only its own blobs go further.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorumlake.llm.shared import fresh, scratch, table


@dataclass(frozen=True)
class Rule:
    """Matches of pattern, leftmost and not overlapping; those whose group is shorter than least drop.

    Texts without any of the literals can't match and are passed over.
    """

    kind: str
    pattern: str
    version: int = 1
    group: int = 0
    least: int = 0
    literals: tuple[str, ...] = ()

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


# The patterns of the base kinds, then those of well-known token formats.
BASE = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", group=2, least=6),
    Rule("access", r"AKIA[A-Z0-9]+", least=20, literals=("AKIA",)),
    Rule("hex", r"[0-9a-f]{24,}"),
)
MORE = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", literals=("PRIVATE KEY-----",)),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}", literals=("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", literals=("xox",)),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}", literals=("AIza",)),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", literals=("eyJ",)),
)
RULES = BASE + MORE
SPANS = "array<struct<s:int,e:int>>"


def spans(text: Column, rule: Rule) -> Column:
    """Start and exclusive end, in code points, of a rule's matches: the gaps that a split by the
    pattern leaves and the matches themselves take turns from the start of the text."""
    p = F.lit(rule.pattern)
    found = F.arrays_zip(
        F.regexp_extract_all(text, p, F.lit(0)).alias("m"),
        F.regexp_extract_all(text, p, F.lit(rule.group)).alias("g"),
        F.slice(F.split(text, rule.pattern, -1), F.lit(1), F.size(F.regexp_extract_all(text, p, F.lit(0)))).alias("gap"),
    )
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        s = acc["at"] + F.char_length(x["gap"])
        e = s + F.char_length(x["m"])
        own = F.array(F.struct(s.alias("s"), e.alias("e")))
        return F.struct(e.alias("at"), F.when(F.char_length(x["g"]) >= rule.least, F.concat(acc["out"], own)).otherwise(acc["out"]).alias("out"))

    may = F.lit(True)
    if rule.literals:
        may = F.lit(False)
        for x in rule.literals:
            may = may | text.contains(x)
    # only texts that match at all are split
    return F.when(may & text.rlike(rule.pattern), F.aggregate(found, start, step)["out"]).otherwise(F.array().cast(SPANS))


RESULT = f"array<struct<rule:string,spans:{SPANS}>>"
LEDGER = f"blob string, results {RESULT}, part int"
#: Parts of a ledger.
PARTS = 16


class Ledger:
    """What was scanned so far, by blob: a Parquet table in parts that only grows. Each run adds a row for a blob it scanned."""

    def __init__(self, spark, path: str | None = None):
        self.spark, self.path = spark, path or scratch(spark, "ledger")

    def _exists(self) -> bool:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(self.path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    def _table(self) -> DataFrame:
        return self.spark.read.schema(LEDGER).parquet(self.path) if self._exists() else self.spark.createDataFrame([], LEDGER)

    def rows(self) -> DataFrame:
        """(blob, rule, spans) of all that was scanned."""
        return self._table().select("blob", F.explode("results").alias("x")).select("blob", "x.rule", "x.spans")

    @staticmethod
    def _part() -> Column:
        return F.pmod(F.xxhash64("blob"), F.lit(PARTS)).cast("int")

    def held(self, blobs: DataFrame) -> DataFrame:
        """(blob, results) of blobs (blob) alone, from the parts that they are in."""
        if not self._exists():
            return self.spark.createDataFrame([], LEDGER).drop("part")
        parts = [r[0] for r in blobs.select(self._part()).distinct().collect()]  # PARTS numbers at most
        return self._table().where(F.col("part").isin(parts)).join(blobs.select("blob"), "blob", "left_semi").select("blob", "results")

    def unseen(self, versions: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
        """(blob, todo): the blobs of versions (blob, ...) that the ledger lacks for some rule versions, and those."""
        own = table(versions.select("blob").distinct(), "run-blobs")
        known = self.held(own).groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list(F.transform("results", lambda x: x["rule"])))).alias("known"))
        names = F.array(*[F.lit(r.name) for r in rules])
        blobs = own.join(known, "blob", "left")
        blobs = blobs.select("blob", F.array_except(names, F.coalesce("known", F.array().cast("array<string>"))).alias("todo"))
        return table(blobs.where(F.size("todo") > 0), "unseen-blobs")

    def scan(self, versions: DataFrame, rules: tuple[Rule, ...] = RULES) -> None:
        """Scans what versions (blob, body) hold and the ledger lacks, and appends it.

        Only hashes are asked of the ledger. Texts move once the pairs to scan are known, and only
        theirs, a text once for each of the partitions that hold it.
        """
        unseen = self.unseen(versions, rules)
        if unseen.isEmpty():
            return
        blobs = versions.groupBy("blob").agg(F.first("body").alias("body"))
        # as a semi join it goes below the aggregation where unseen is small enough to broadcast
        blobs = blobs.join(unseen.select("blob"), "blob", "left_semi").join(unseen, "blob")
        made = [F.when(F.array_contains("todo", r.name), F.struct(F.lit(r.name).alias("rule"), spans(F.col("body"), r).alias("spans"))) for r in rules]
        rows = blobs.select("blob", F.filter(F.array(*made), lambda x: x.isNotNull()).alias("results")).withColumn("part", self._part())
        rows.repartition("part").write.partitionBy("part").mode("append").parquet(self.path)

    def findings(self, blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
        """(blob, found): the spans of each of blobs (blob) with any, by start, then by the order of rules."""
        order = {r.name: k for k, r in enumerate(rules)}
        rank = F.create_map(*[F.lit(x) for pair in order.items() for x in pair])
        rows = self.held(blobs).select("blob", F.explode(F.filter("results", lambda x: x["rule"].isin(*order) & (F.size(x["spans"]) > 0))).alias("x"))
        rows = rows.select("blob", rank[F.col("x.rule")].alias("k"), "x.spans").dropDuplicates(["blob", "k"])
        rows = rows.select("blob", F.transform("spans", lambda x: F.struct(x["s"].alias("s"), F.col("k").alias("k"), x["e"].alias("e"))).alias("found"))
        return rows.groupBy("blob").agg(F.array_sort(F.flatten(F.collect_list("found"))).alias("found"))


def versions(docs: DataFrame) -> DataFrame:
    """(blob, body) of the texts of docs; null texts count as empty."""
    body = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.sha2(body, 256).alias("blob"), body.alias("body"))


FOUND = "array<struct<s:int,k:int,e:int>>"


def scan(docs: DataFrame, ledger: Ledger | None = None, rules: tuple[Rule, ...] = RULES, out: str = "found") -> DataFrame:
    """docs (all columns) with out, the spans of each row's text as (start, rule number, end).

    Null texts count as empty. Equal texts, of whatever paths or versions, are one blob and are scanned
    once; repeated rows stay. An empty table gives an empty result. A column of docs named as
    out is replaced.
    """
    ledger = ledger or Ledger(docs.sparkSession)
    ledger.scan(versions(docs), rules)
    own = [c for c in docs.columns if c.lower() != out.lower()]
    blob = fresh(docs.columns, "blob")
    body = F.coalesce(F.col("text").cast("string"), F.lit(""))
    spans_at = fresh(docs.columns, "blob_spans")
    found = ledger.findings(versions(docs).select("blob").distinct(), rules).select(F.col("blob").alias(blob), F.col("found").alias(spans_at))
    rows = docs.select(*own, F.sha2(body, 256).alias(blob)).join(found, blob, "left")
    return rows.select(*own, F.coalesce(spans_at, F.array().cast(FOUND)).alias(out))


def digest(found: Column, rules: tuple[Rule, ...]) -> Column:
    """kind:start:end of the spans of the first rules, comma-joined."""
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    own = F.filter(found, lambda x: x["k"] < len(rules))
    return F.array_join(F.transform(own, lambda x: F.concat_ws(":", F.element_at(kinds, x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")


def counted(found: Column, k: int) -> Column:
    return F.size(F.filter(found, lambda x: x["k"] == k)).cast("long")


def redact(docs: DataFrame, ledger: Ledger | None = None, mask: str = "[SECRET]") -> DataFrame:
    """docs, same columns, with every found span (overlapping ones together) replaced by mask.

    Texts without findings stay as they are, nulls too; n_chars, where there is one, follows the text.
    """
    text = F.col("text")
    first = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        new = F.concat(acc["out"], F.substring(text, acc["at"] + 1, x["s"] - acc["at"]), F.lit(mask))
        return F.struct(F.greatest(acc["at"], x["e"]).alias("at"), F.when(x["s"] >= acc["at"], new).otherwise(acc["out"]).alias("out"))

    found, redacted = fresh(docs.columns, "found"), fresh(docs.columns, "redacted")
    done = F.aggregate(found, first, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.char_length(text))))
    rows = scan(docs, ledger, out=found).withColumn(redacted, F.when(F.size(found) > 0, done).otherwise(text))
    kept = {c: F.col(c) for c in docs.columns}
    kept["text"] = F.col(redacted).alias("text")
    if "n_chars" in kept:
        kept["n_chars"] = F.when(F.size(found) > 0, F.char_length(redacted).cast("long")).otherwise(F.col("n_chars")).alias("n_chars")
    return rows.select(*kept.values())


def sql(table: str = "documents") -> str:
    """DuckDB SQL for doc_id, counts, base_sha256 and spans of a table."""
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    each = " union all ".join(
        f"select rid, {k} k, {quote(r.kind)} kind, {r.least} least, regexp_extract_all(t, {quote(r.pattern)}, 0) m, "
        f"regexp_extract_all(t, {quote(r.pattern)}, {r.group}) g, string_split_regex(t, {quote(r.pattern)}) gap from d"
        for k, r in enumerate(RULES)
    )
    return f"""
        with d as (select doc_id, coalesce(text, '') t, row_number() over () rid from {table}),
        m as ({each}),
        u as (select rid, k, kind, least, unnest(m) m, unnest(g) g, unnest(gap[:len(m)]) gap, generate_subscripts(m, 1) i from m),
        p as (select rid, k, kind, length(g) >= least ok, length(m) n, sum(length(gap) + length(m)) over (partition by rid, k order by i) e from u),
        f as (select rid, k, kind, kind || ':' || cast(e - n as bigint) || ':' || cast(e as bigint) x, e - n s from p where ok),
        a as (select rid, count(*) filter (k = 0) n_assign, count(*) filter (k = 1) n_access, count(*) filter (k = 2) n_hex,
              string_agg(x, ',' order by s, k) filter (k < {len(BASE)}) base, string_agg(x, ',' order by s, k) spans from f group by rid)
        select doc_id, coalesce(n_assign, 0) n_assign, coalesce(n_access, 0) n_access, coalesce(n_hex, 0) n_hex,
               sha256(coalesce(base, '')) base_sha256, coalesce(spans, '') spans
        from d left join a using (rid)"""
