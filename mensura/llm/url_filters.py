"""URL filters by a tree of path templates, in DataFrame operations only.

Per host, path segments become a tree.  From branching to branching, variable segments (numbers, long hexadecimal
names, and the children of a node that has many rare ones) become wildcards; then branches whose
labelled rate of bad pages does not differ from their siblings' are merged into the wildcard as
well.  A template's purity is its share of good labelled pages, smoothed toward its host's, which is
smoothed toward the whole table's; templates of low purity are rejected.  Rules given by hand go
before the tree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mensura.llm.common import LOWER, UPPER, written

#: Fixed value: a segment that names nothing but a number, a date or a long hexadecimal id, with an extension or without.
VARIABLE = r"^(?:[0-9][0-9_\-]*|[0-9a-fA-F\-]{16,})(\.[A-Za-z0-9]{1,5})?$"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for a null or one without `://`."""
    whole = F.coalesce(url.cast("string"), F.lit(""))
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    return F.translate(F.regexp_extract(whole, pattern, 1), UPPER, LOWER), F.regexp_extract(whole, pattern, 2)


def matched_rule(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """The longest rule that fits, or null.  A rule is host and path in one string; its host fits subdomains too.

    Only a url's own host suffixes and path prefixes of the rules' lengths are looked up, so the
    work does not grow with the number of rules; these are a parameter, not data.
    """
    if not rules:
        return F.lit(None).cast("string")
    cut = {r: r.index("/") if "/" in r else len(r) for r in rules}
    lengths = sorted({len(r) - cut[r] for r in rules}, reverse=True)
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    heads = F.filter(F.array(*[F.when(F.length(path) >= n, F.substring(path, 1, n) if n else F.lit("")) for n in lengths]), lambda p: p.isNotNull())
    known = F.array(*[F.lit(r) for r in sorted(rules)])
    tried = F.flatten(F.transform(suffixes, lambda s: F.transform(heads, lambda p: F.concat(s, p))))
    fit = F.array_intersect(tried, known)
    # longest first; of equal length the one of the longer host
    best = F.array_sort(F.transform(fit, lambda r: F.struct((-F.length(r)).alias("n"), (-F.instr(F.concat(r, F.lit("/")), "/")).alias("h"), r.alias("r"))))
    return F.when(F.size(best) > 0, F.element_at(best, 1)["r"])


def _with(rows: DataFrame, keys: list[str], totals: DataFrame, name: str) -> DataFrame:
    """rows with totals of their keys, both sides read from tables so that a frequent key is split."""
    return rows.join(written(totals, name), keys, "left")


def templates(pages: DataFrame, children: int = 8, rare: float = 0.5, z: float = 1.96, strength: float = 8.0, least: int = 5, merges: int = 16) -> DataFrame:
    """pages (page, host, path, good: 1, 0 or null) with template and purity.

    A step takes each node of the tree to its next branching: segments that all of its pages share are one chain, whatever
    its length.  There, a node with `children` children or more, which are `rare` or more of its pages, has a wildcard
    for them all.  A branch with fewer than `least` labelled pages, or whose bad rate differs from
    its siblings' by less than z standard errors, is merged into the wildcard.  After `merges` wildcards since a branch that
    labelled pages told apart, what is left of a path is one wildcard `**`; so steps are bounded by labelled
    evidence, not by the longest path.  Pages whose path has ended leave the steps.  strength: labelled pages that a
    prior counts for.
    """
    parts = F.filter(F.split("path", "/"), lambda s: s != "")
    plain = lambda s: F.when(s.rlike(VARIABLE), F.concat(F.lit("*"), F.regexp_extract(s, VARIABLE, 1))).otherwise(s)
    rows = written(pages.withColumn("rest", F.transform(parts, plain)).withColumn("template", F.col("host")).withColumn("bad", 1 - F.col("good")).withColumn("merged", F.lit(0)), "paths")
    ended: list[DataFrame] = []

    def going_on(rows: DataFrame) -> DataFrame:
        ended.append(rows.where("size(rest) = 0").drop("rest", "merged", "bad"))
        return rows.where("size(rest) > 0")

    rows = going_on(rows)
    while rows.limit(1).count():
        # what lies between the least and the largest rest of a node begins as both of them do
        ends = rows.groupBy("template").agg(F.min("rest").alias("low"), F.max("rest").alias("high"))
        differ = F.array_position(F.zip_with("low", "high", lambda a, b: F.coalesce(a == b, F.lit(False))), F.lit(False))
        chain = F.when(differ == 0, F.size("low")).otherwise(differ - 1).cast("int")
        rows = _with(rows, ["template"], ends.select("template", chain.alias("chain")), "chains")
        head = F.array_join(F.slice("rest", F.lit(1), F.col("chain")), "/")
        rows = rows.withColumn("template", F.when(F.col("chain") > 0, F.concat_ws("/", "template", head)).otherwise(F.col("template"))).withColumn("rest", F.slice("rest", F.col("chain") + 1, F.size("rest")))
        rows = going_on(written(rows.drop("chain"), "level")).withColumn("seg", F.col("rest")[0])
        child = written(rows.groupBy("template", "seg").agg(F.count(F.lit(1)).alias("n"), F.count("bad").alias("l"), F.coalesce(F.sum("bad"), F.lit(0)).alias("b")), "children")
        parent = written(child.groupBy("template").agg(F.count(F.lit(1)).alias("kinds"), F.sum("n").alias("pages"), F.sum("l").alias("pl"), F.sum("b").alias("pb")), "parents")
        rest_l, rest_b = F.col("pl") - F.col("l"), F.col("pb") - F.col("b")
        pooled = (F.col("pb") + 1) / (F.col("pl") + 2)
        error = F.sqrt(pooled * (1 - pooled) * (1 / F.greatest("l", F.lit(1)) + 1 / F.greatest(rest_l, F.lit(1))))
        apart = F.abs(F.col("b") / F.greatest("l", F.lit(1)) - rest_b / F.greatest(rest_l, F.lit(1))) / error
        many = (F.col("kinds") >= children) & (F.col("kinds") >= rare * F.col("pages"))
        alike = (F.col("kinds") > 1) & ((F.col("l") < least) | (rest_l < least) | (apart < z))
        becomes = F.when(F.col("seg").startswith("*"), F.col("seg")).when(many | alike, F.lit("*")).otherwise(F.col("seg"))
        named = child.join(parent, "template").select("template", "seg", becomes.alias("as"), (many | alike | F.col("seg").startswith("*")).alias("joined"))
        rows = _with(rows, ["template", "seg"], named, "named")
        rows = rows.withColumn("merged", F.when(F.col("joined"), F.col("merged") + 1).otherwise(0)).withColumn("rest", F.slice("rest", F.lit(2), F.size("rest")))
        last = (F.col("merged") >= merges) & (F.size("rest") > 0)
        rows = rows.withColumn("template", F.concat_ws("/", "template", "as", F.when(last, F.lit("**")))).withColumn("rest", F.when(last, F.array().cast("array<string>")).otherwise(F.col("rest")))
        rows = going_on(written(rows.drop("seg", "as", "joined"), "level"))
    rows = ended[0]
    for more in ended[1:]:
        rows = rows.unionByName(more)
    rows = written(rows, "ended")
    whole = rows.agg(F.count("good").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("g")).first()
    prior = (whole["g"] + 1) / (whole["n"] + 2)
    counts = written(rows.groupBy("host", "template").agg(F.count("good").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("g")), "counts")
    host = written(counts.groupBy("host").agg(((F.sum("g") + prior * strength) / (F.sum("n") + strength)).alias("host_purity")), "hosts")
    purity = counts.join(host, "host").select("host", "template", ((F.col("g") + strength * F.col("host_purity")) / (F.col("n") + strength)).alias("purity"))
    return _with(rows, ["host", "template"], purity, "purity")


def judge(pages: DataFrame, labels: DataFrame | None, rules: dict[str, str], url: str = "url", key: str = "page_id", label_key: str = "doc_id", threshold: float = 0.5, **params) -> DataFrame:
    """One row per row of pages: key, host, path, rule, verdict, template, purity.

    labels: rows (label_key, quality, toxic) of some pages; a page is good if every label row of its
    key says quality 1 and toxic 0 (null counts as neither).  rules: rule -> allow or block; the
    longest that fits decides, else purity under `threshold` blocks.  Pages without any labels
    around get the table's purity, 0.5 and allow for an unlabelled table.  A null url is host ''.
    """
    host, path = split_url(F.col(f"`{url}`"))
    rows = pages.select(F.col(f"`{key}`").alias("page"), host.alias("host"), path.alias("path"))
    if labels is not None:
        ok = F.coalesce((F.col("quality") == 1) & (F.col("toxic") == 0), F.lit(False)).cast("int")
        marks = labels.where(F.col(f"`{label_key}`").isNotNull()).groupBy(F.col(f"`{label_key}`").alias("page")).agg(F.min(ok).alias("good"))
        # marks grow with the pages; their files are small for their rows, and would be broadcast for that
        rows = rows.join(written(marks, "marks").hint("merge"), "page", "left")
    else:
        rows = rows.withColumn("good", F.lit(None).cast("int"))
    found = templates(rows, **params).withColumn("rule", matched_rule(F.col("host"), F.col("path"), rules))
    given = F.create_map(*[F.lit(x) for kv in rules.items() for x in kv])[F.col("rule")] if rules else F.lit(None).cast("string")
    verdict = F.coalesce(given, F.when(F.col("purity") < threshold, "block").otherwise("allow"))
    return found.select(F.col("page").alias(key), "host", "path", "rule", verdict.alias("verdict"), "template", "purity")
