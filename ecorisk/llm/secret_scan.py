"""Secret scans: candidate credentials with positions, told apart by how many owners in the corpus share them.

Candidate hashes are aggregated over the whole corpus by distinct repositories and owners: a value that many owners have
is a widely copied example, one that only few have looks live, in however many repositories these keep it. A document is
a repository, its source the owner, unless other columns are named. Only DataFrame operations run.

Base kinds (assign, access, hex) are always reported. The added kind, `owned`, is a long run of key characters with
letters and digits beside them that overlaps no base span and is specific to its owner. Positions are code points, end
exclusive. Null text counts as empty; a document without spans has zero counts, the digest of the empty string and an
empty list. Repeated rows are scanned as rows of their own. Extra columns are ignored, empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ecorisk.llm.common import join_each, materialize, table

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
OWNED = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])(?=[0-9+/_=-]*[A-Za-z])[A-Za-z0-9+/_=-]{20,}"
#: kind, pattern, group that is the credential, its least length; in the order in which kinds are listed.
KINDS = [("assign", ASSIGN, 2, 6), ("access", ACCESS, 0, 20), ("hex", HEX, 0, 24), ("owned", OWNED, 0, 20)]
BASE = 3
#: From so many distinct owners on a credential is a widely copied example.
COPIED_OWNERS = 3


def _matches(text: Column, k: int) -> Column:
    """Of kind k: the gap before each match, the match and its credential; null where there is no match.

    Matches and the pieces between them, from the same pattern, alternate through the text: running sums of their
    lengths are the positions.
    """
    _, pattern, group, least = KINDS[k]
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole

    def one(m: Column) -> Column:
        return F.struct(
            F.lit(k).alias("kind"),
            F.char_length(m["gap"]).alias("gap"),
            F.char_length(m["whole"]).alias("length"),
            (F.char_length(m["value"]) >= least).alias("valid"),
            F.xxhash64(m["value"]).alias("credential"),
        )

    found = F.transform(F.arrays_zip(F.split(text, pattern, -1).alias("gap"), whole.alias("whole"), value.alias("value")), one)
    return F.when(text.rlike(pattern), F.filter(found, lambda m: m["length"].isNotNull()))


def candidates(docs: DataFrame, repository: str = "doc_id", owner: str = "source") -> DataFrame:
    """One row per row of docs: row, doc_id, repository, owner and the matches of all kinds, from one pass over the text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    none = F.array().cast("array<struct<kind:int,gap:int,length:int,valid:boolean,credential:bigint>>")
    kinds = [F.coalesce(_matches(F.col("text"), k), none) for k in range(len(KINDS))]
    rows = docs.select("doc_id", F.col(repository).alias("repository"), F.col(owner).alias("owner"), text.alias("text"))
    return rows.select("doc_id", "repository", "owner", F.concat(*kinds).alias("found"), F.monotonically_increasing_id().alias("row"))


def located(found: DataFrame) -> DataFrame:
    """(row, repository, owner, kind, start, end, credential) of each valid match."""
    each = found.where(F.size("found") > 0).select("row", "repository", "owner", F.posexplode("found").alias("at", "m"))
    before = Window.partitionBy("row", "m.kind").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("m.gap").cast("long") + F.col("m.length")).over(before)
    spans = each.select("row", "repository", "owner", "m.kind", "m.valid", "m.credential", (end - F.col("m.length")).alias("start"), end.alias("end"))
    return spans.where("valid").drop("valid")


def ownership(spans: DataFrame) -> DataFrame:
    """(credential, repositories, owners, n): distinct ones over the corpus, nulls counting as one, and the number of spans.

    Spans are counted per credential, owner and repository first, then per owner, then over all, each time before rows are
    dealt out, so that a credential that is everywhere is a few rows of each task.
    """
    each = spans.groupBy("credential", "owner", "repository").agg(F.count(F.lit(1)).alias("n"))
    names = F.struct(F.col("repository").cast("string").alias("v"))
    repositories = each.groupBy("credential", names.alias("r")).agg(F.sum("n").alias("n")).groupBy("credential").agg(F.count(F.lit(1)).alias("repositories"), F.sum("n").alias("n"))
    owners = each.select("credential", F.struct(F.col("owner").cast("string").alias("v")).alias("o")).distinct().groupBy("credential").agg(F.count(F.lit(1)).alias("owners"))
    return repositories.join(owners, "credential").select("credential", "repositories", "owners", "n")


def secret_spans(docs: DataFrame, repository: str = "doc_id", owner: str = "source", copied_owners: int = COPIED_OWNERS) -> DataFrame:
    """One row per row of docs: doc_id and its spans, each with kind, start, end, repositories, owners, widely_copied."""
    found = materialize(candidates(docs, repository, owner))
    spans = materialize(located(found))
    known = join_each(spans, materialize(ownership(spans)), "credential", "n")
    span = F.struct("start", "kind", "end", "repositories", "owners", (F.col("owners") >= copied_owners).alias("widely_copied"))
    by_row = known.groupBy("row").agg(F.array_sort(F.collect_list(span)).alias("all"))
    base = F.filter("all", lambda s: s["kind"] < BASE)

    def fits(s: Column) -> Column:
        apart = ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
        return (s["kind"] < BASE) | (~s["widely_copied"] & apart)

    kept = by_row.select("row", "all", base.alias("base")).select("row", F.filter("all", fits).alias("spans"))
    none = F.array().cast(kept.schema["spans"].dataType)
    return found.select("row", "doc_id").join(kept, "row", "left").select("doc_id", F.coalesce("spans", none).alias("spans"))


def _named(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k[0]) for k in KINDS])
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])))


def secret_scan(docs: DataFrame, repository: str = "doc_id", owner: str = "source") -> DataFrame:
    """One row per document: doc_id, counts by base kind, base_sha256, spans, and how many of them are copied or owned."""
    base = F.filter("spans", lambda s: s["kind"] < BASE)

    def count(k: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k][0]}")

    copied = F.size(F.filter("spans", lambda s: s["widely_copied"])).cast("long")
    return secret_spans(docs, repository, owner).select(
        "doc_id",
        *[count(k) for k in range(BASE)],
        F.sha2(_named(base).cast("binary"), 256).alias("base_sha256"),
        _named(F.col("spans")).alias("spans"),
        copied.alias("n_widely_copied"),
        (F.size("spans") - copied).alias("n_owner_specific"),
    )


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(table(spark, sf_dir, "documents"))
