"""Secret scan with ownership frequency over the whole corpus.

Base kinds are found in every text by pattern. Further kinds are issued key formats, and opaque tokens: long
runs that mix lower case, upper case and digits. Every candidate's value is hashed and counted over the
corpus by distinct repositories and distinct owners; both counts come with each kept span (``holders``). The
verdict is the query's SQL rule and looks at owners alone: a value that ``COPIED_OWNERS`` owners or more hold is
a widely copied example; one that stays with fewer looks live, in however many of their repositories it is.
Opaque tokens count as secrets only when they look live; the other kinds are kept in either case, with the
verdict beside them.

In the tables at hand the owner is ``source`` and each document is a repository of its own. A null text is
empty; a null owner counts as one owner. Repeated rows of one document are one repository and each get a row.
Positions are code points of the text, the end exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dragoman.llm.common import cut, let

#: Kinds in their order, with pattern, group of the value and its least length.
KINDS = (
    (
        "assign",
        r"([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]"
        r"""|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        6,
    ),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]+", 0, 40),
    ("github", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    ("slack", r"xox[abprs]-[A-Za-z0-9-]+", 0, 15),
    ("google", r"AIza[0-9A-Za-z_-]+", 0, 39),
    ("jwt", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 30),
    ("opaque", r"[A-Za-z0-9+/_=-]{24,}", 0, 24),
)
#: Strings without which a kind cannot occur; a plain search for them is cheaper than the pattern.
NEEDS = {
    "access": ("AKIA",), "pem": ("PRIVATE KEY-----",), "slack": ("xox",), "google": ("AIza",), "jwt": ("eyJ",),
    "github": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"),
}
BASE = ("assign", "access", "hex")
#: Matches that are gathered at a time.
BLOCK = 256
SPANS = "array<struct<start:int,kind_order:int,kind:string,end:int,value:string>>"
#: A value with this many owners or more is a copied example.
COPIED_OWNERS = 3


def _spans(text: Column, order: int, kind: str, pattern: str, group: int, least: int) -> Column:
    """Array of (start, kind_order, kind, end, value): the text between the matches tells where they lie.

    Appending to an array copies it, so matches are gathered in blocks and the blocks put together.
    """

    def folded(found: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            start = acc["at"] + F.length(F.get(found["gaps"], i))
            end = start + F.length(F.get(found["whole"], i))
            value = F.get(found["value"], i)
            span = F.struct(
                start.alias("start"), F.lit(order).alias("kind_order"), F.lit(kind).alias("kind"), end.alias("end"), value.alias("value")
            )
            fits = F.length(value) >= least
            if kind == "opaque":
                fits = fits & value.rlike("[a-z]") & value.rlike("[A-Z]") & value.rlike("[0-9]")
            spans = F.when(fits, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"])
            return F.struct(end.alias("at"), spans.alias("spans"))

        def block(acc: Column, b: Column) -> Column:
            last = F.least(b * BLOCK + (BLOCK - 1), F.size(found["whole"]) - 1)
            inner = F.aggregate(F.sequence(b * BLOCK, last), F.struct(acc["at"].alias("at"), _nothing().alias("spans")), step)
            return let(inner, lambda r: F.struct(r["at"].alias("at"), F.concat(acc["parts"], F.array(r["spans"])).alias("parts")))

        blocks = F.sequence(F.lit(0), F.floor((F.size(found["whole"]) - 1) / BLOCK).cast("int"))
        start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPANS}>").alias("parts"))
        return F.flatten(F.aggregate(blocks, start, block, lambda acc: acc["parts"]))

    found = F.struct(
        F.split(text, pattern, -1).alias("gaps"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("whole"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("value"),
    )
    possible = text.rlike(pattern)
    if kind in NEEDS:
        held = F.lit(False)
        for s in NEEDS[kind]:
            held = held | F.contains(text, F.lit(s))
        possible = held & possible
    return F.when(possible, let(found, folded)).otherwise(_nothing())


def _nothing() -> Column:
    return F.array().cast(SPANS)


def candidates(docs: DataFrame, owner: str = "source", repository: str = "doc_id") -> DataFrame:
    """row_id, doc_id, owner, repository, spans (start, kind_order, kind, end, value_hash), values only as hashes."""
    text = F.coalesce(F.col("text"), F.lit(""))
    found = F.concat(*[_spans(text, order, *kind) for order, kind in enumerate(KINDS)])
    hashed = F.transform(
        found, lambda s: F.struct(s["start"].alias("start"), s["kind_order"].alias("kind_order"), s["kind"].alias("kind"), s["end"].alias("end"), F.sha2(s["value"], 256).alias("value_hash"))
    )
    return docs.select(
        F.monotonically_increasing_id().alias("row_id"), F.col("doc_id"), F.coalesce(F.col(owner).cast("string"), F.lit("")).alias("owner"),
        F.coalesce(F.col(repository).cast("string"), F.lit("")).alias("repository"), F.array_sort(hashed).alias("spans"),
    )


def ownership(found: DataFrame) -> DataFrame:
    """value_hash, repositories (of each owner), owners: distinct holders of every candidate value, counted in two steps
    so that a value held everywhere is reduced before it meets in one task."""
    held = found.filter(F.size("spans") > 0).select("owner", "repository", F.explode("spans.value_hash").alias("value_hash"))
    pairs = held.groupBy("value_hash", "owner", "repository").agg(F.lit(1).alias("one"))
    per_owner = pairs.groupBy("value_hash", "owner").agg(F.count("one").alias("in_owner"))
    return per_owner.groupBy("value_hash").agg(F.sum("in_owner").alias("repositories"), F.count("owner").alias("owners"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, owner: str = "source", repository: str = "doc_id") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_copied, holders for every row of ``docs``;
    holders has the repositories and owners of each span's value, in the order of the spans."""
    found = cut(candidates(docs, owner, repository), "secret-candidates")
    exploded = found.filter(F.size("spans") > 0).select("row_id", F.explode("spans").alias("span"))
    exploded = exploded.select("row_id", "span", F.col("span.value_hash").alias("value_hash"))
    judged = exploded.join(ownership(found), "value_hash").withColumn("copied", F.col("owners") >= COPIED_OWNERS)
    keep = (F.col("span.kind") != "opaque") | ~F.col("copied")
    per_row = judged.filter(keep).groupBy("row_id").agg(
        F.array_sort(F.collect_list(F.struct("span.start", "span.kind_order", "span.kind", "span.end", "repositories", "owners"))).alias("kept"),
        F.count(F.when(F.col("copied"), 1)).alias("n_copied"),
        F.count(F.when(~F.col("copied"), 1)).alias("n_live"),
    )
    out = found.select("row_id", "doc_id").join(per_row, "row_id", "left")
    kept = F.coalesce("kept", F.array().cast("array<struct<start:int,kind_order:int,kind:string,end:int,repositories:bigint,owners:bigint>>"))
    base = F.filter(kept, lambda s: s["kind_order"] < len(BASE))

    def count_of(kind: str) -> Column:
        return F.size(F.filter(kept, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return out.select(
        "doc_id", *[count_of(k) for k in BASE], F.sha2(_joined(base), 256).alias("base_sha256"), _joined(kept).alias("spans"),
        F.coalesce("n_live", F.lit(0)).alias("n_live"), F.coalesce("n_copied", F.lit(0)).alias("n_copied"),
        F.transform(kept, lambda s: F.struct(s["repositories"].alias("repositories"), s["owners"].alias("owners"))).alias("holders"),
    )
