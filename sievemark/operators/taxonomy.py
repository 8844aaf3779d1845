"""Categories from regulation text, and the census of terms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sievemark.contracts import TAXONOMY_LEVELS, AnalysisError
from sievemark.functions.text import count_term, count_tokens, requirement_text

#: What makes a requirement name a technology.
FULL_PATTERNS = (
    ("call system", r"call\s+system"),
    ("bed rail / side rail / bed frame", r"bed\s+rail|side\s+rail|bed\s+frame"),
    ("equipment", r"\bequipment\b"),
    ("emergency power / generator", r"emergency\s+power|\bgenerator\b"),
)
#: Technology words that may stand anywhere in a block.
PARTIAL_PATTERNS = (
    ("equipment", r"\bequipment\b"),
    ("device", r"\bdevices?\b"),
    ("alarm", r"\balarms?\b"),
    ("bed/side rail or frame", r"bed\s+rail|side\s+rail|bed\s+frame"),
    ("call system/light/bell", r"call\s+(?:system|light|bell)"),
    ("electronic record", r"electronic\s+(?:health|medical)\s+record"),
    ("electronic monitoring", r"electronic\s+monitoring"),
    ("video / camera", r"\bvideo\b|\bcameras?\b"),
    ("sensor", r"\bsensors?\b"),
    ("telehealth", r"\btelehealth\b|\btelemedicine\b"),
    ("mechanical lift", r"mechanical\s+lift"),
    ("assistive device", r"assistive\s+device"),
    ("automated / software / computer", r"\bautomated\b|\bsoftware\b|\bcomputer\b"),
    ("wander-management device", r"\bwanderguard\b"),
)
#: Tags whose level was decided by hand.
CURATED = {"F919": "full", "F700": "full", "F909": "full", "F908": "full", "F689": "partial", "F604": "partial", "F842": "partial", "F698": "partial", "F758": "none", "F773": "none", "F836": "none"}
TAG_HEADER = r"^\s*(F\d{3})\s*$"


def tag_blocks(lines: DataFrame) -> DataFrame:
    """f_tag and block of a regulation text given as line_no and line; segments of a repeated header are joined, text before the first header is dropped.

    One book is one ordered sequence, so its lines share a task; several books (column ``book``) run side by side.
    """
    by = [c for c in ("book",) if c in lines.columns]
    head = F.nullif(F.regexp_extract("line", TAG_HEADER, 1), F.lit(""))
    w = Window.partitionBy(*by).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    tagged = lines.withColumn("_head", head).withColumn("f_tag", F.last("_head", ignorenulls=True).over(w)).where("f_tag is not null and _head is null")
    return tagged.groupBy(*by, "f_tag").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("block"))


def classify_blocks(blocks: DataFrame, curated: dict[str, str] | None = None, tag: str = "f_tag", block: str = "block") -> DataFrame:
    """level, method and hits of each block: decided by hand, else full by the requirement's own text, else partial by any technology word, else none."""
    own = curated if curated is not None else CURATED
    req = requirement_text(F.col(block))
    full = F.filter(F.array(*[F.when(req.rlike("(?i)" + p), F.lit(k)) for k, p in FULL_PATTERNS]), lambda x: x.isNotNull())
    counts = [F.struct((-F.regexp_count(F.col(block), F.lit("(?i)" + p))).alias("c"), F.lit(i).alias("i"), F.lit(k).alias("label")) for i, (k, p) in enumerate(PARTIAL_PATTERNS)]
    hits = F.array_sort(F.filter(F.array(*counts), lambda x: x["c"] < 0))
    level_of = F.create_map(*[F.lit(x) for kv in own.items() for x in kv])[F.col(tag)] if own else F.lit(None).cast("string")
    b = blocks.withColumn("_full", full).withColumn("_hits", hits).withColumn("_own", level_of)
    shown = F.array_join(F.transform(F.slice("_hits", 1, 4), lambda x: F.concat(x["label"], F.lit(" ("), (-x["c"]).cast("string"), F.lit(")"))), ", ")
    return b.select(
        *[c for c in blocks.columns if c != block],
        F.coalesce("_own", F.when(F.size("_full") > 0, "full"), F.when(F.size("_hits") > 0, "partial"), F.lit("none")).alias("level"),
        F.when(F.col("_own").isNotNull(), "curated").otherwise("rule").alias("method"),
        F.when(F.col("_own").isNotNull(), "decided by hand").when(F.size("_full") > 0, F.array_join("_full", "; ")).when(F.size("_hits") > 0, shown).otherwise("no technology word").alias("justification"),
        F.regexp_replace(F.regexp_extract(req, r"§\s*483\.[\w().\-]+", 0), " ", "").alias("regulation"),
    )


def build_taxonomy(lines: DataFrame, min_blocks: int = 100) -> DataFrame:
    blocks = tag_blocks(lines)
    n = blocks.count()
    if n < min_blocks:
        raise AnalysisError(f"only {n} tag blocks; this is no full regulation text")
    return classify_blocks(blocks)


def taxonomy_meta(lines: DataFrame, taxonomy: DataFrame, source: str = "") -> DataFrame:
    """One row about a taxonomy: source, revision (the first stamp with a number), n_tags, tags of each level, n_curated."""
    stamp = F.nullif(F.regexp_extract("line", r"\(Rev\.\s*\d+[^)]*\)", 0), F.lit(""))
    revision = lines.select("line_no", stamp.alias("stamp")).where("stamp is not null").agg(F.min_by("stamp", "line_no").alias("revision"))
    counts = taxonomy.agg(F.count(F.lit(1)).alias("n_tags"), *[F.count_if(F.col("level") == k).alias(f"n_{k}") for k in TAXONOMY_LEVELS], F.count_if(F.col("method") == "curated").alias("n_curated"))
    return counts.crossJoin(revision).select(F.lit(source).alias("source"), F.coalesce("revision", F.lit("")).alias("revision"), *counts.columns)  # one row each


def level_counts(taxonomy: DataFrame, level: str = "level") -> DataFrame:
    """Every level with its number of tags, 0 included."""
    all_levels = taxonomy.sparkSession.createDataFrame([(x,) for x in TAXONOMY_LEVELS], f"{level} string")
    return all_levels.join(taxonomy.groupBy(level).agg(F.count(F.lit(1)).alias("n_tags")), level, "left").withColumn("n_tags", F.coalesce("n_tags", F.lit(0).cast("bigint")))


def term_counts(texts: DataFrame, terms: dict[str, list[str]], text: str = "narrative", by: str = "f_tag") -> DataFrame:
    """term_group, term, ``by``, n: whole-word counts of every term in every group of texts.

    All terms are counted in the row's own pass and summed as array entries, so there is no cross join
    with the terms and the shuffle carries one row for each group and task, however frequent a group is.
    """
    listed = [(g, t) for g, ts in terms.items() for t in ts]
    per_row = texts.select(F.col(by), *[count_term(F.col(text), t).alias(f"_{i}") for i, (_, t) in enumerate(listed)])
    sums = per_row.groupBy(by).agg(*[F.coalesce(F.sum(f"_{i}"), F.lit(0)).alias(f"_{i}") for i in range(len(listed))])
    rows = F.explode(F.array(*[F.struct(F.lit(g).alias("term_group"), F.lit(t).alias("term"), F.col(f"_{i}").cast("bigint").alias("n")) for i, (g, t) in enumerate(listed)]))
    return sums.select(by, rows.alias("r")).select("r.term_group", "r.term", by, "r.n")


def term_census(counts: DataFrame, by: str = "f_tag") -> DataFrame:
    """term_group, term, total and n_groups (groups that hold the term)."""
    return counts.groupBy("term_group", "term").agg(F.sum("n").alias("total"), F.count_if(F.col("n") > 0).alias("n_groups"))


def top_groups(counts: DataFrame, k: int = 5, by: str = "f_tag") -> DataFrame:
    """The ``k`` groups with the highest count of each term (ties by name), counts of 0 left out."""
    w = Window.partitionBy("term").orderBy(F.desc("n"), by)
    return counts.where(F.col("n") > 0).where(F.col(by).isNotNull()).withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def census_ratio(counts: DataFrame, numerator: str = "pre_digital", denominator: str = "digital") -> DataFrame:
    """Totals of two term groups and their ratio (null when the second is 0)."""
    of = lambda g: F.coalesce(F.sum(F.when(F.col("term_group") == g, F.col("n"))), F.lit(0)).cast("bigint")
    return counts.agg(of(numerator).alias("numerator"), of(denominator).alias("denominator")).withColumn("ratio", F.try_divide("numerator", F.nullif(F.col("denominator"), F.lit(0))))


def text_size(texts: DataFrame, text: str = "narrative", by: str = "f_tag") -> DataFrame:
    return texts.agg(F.sum(count_tokens(F.col(text))).alias("n_words"), F.countDistinct(by).alias("n_tags"))


def with_level(df: DataFrame, taxonomy: DataFrame, tag: Column | None = None, limit: int = 1_000_000) -> DataFrame:
    """Adds level (unknown tag: none) and illegible (level is not full). The taxonomy (f_tag, level) is broadcast while it has at most ``limit`` rows."""
    t = taxonomy.select(F.col("f_tag").alias("_tag"), F.col("level")).groupBy("_tag").agg(F.min("level").alias("level"))
    small = t.limit(limit + 1).count() <= limit
    out = df.drop("level").withColumn("_tag", tag if tag is not None else F.col("f_tag")).join(F.broadcast(t) if small else t, "_tag", "left").drop("_tag")
    return out.withColumn("level", F.coalesce("level", F.lit("none"))).withColumn("illegible", F.col("level") != "full")


def names_technology(level: Column, threshold: str = "full") -> Column:
    return level == "full" if threshold == "full" else level.isin("full", "partial")
