"""Profiles and failure reports as aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def profile(raw: DataFrame, group: str = "source") -> DataFrame:
    """Nulls, empties, repeats, lengths and shares of patterns, by group, in one pass."""
    name, address = (F.coalesce(c, F.lit("")) for c in ("business_name", "business_address"))

    def count(x: Column) -> Column:
        return F.count(F.when(x, 1))

    def share(x: Column) -> Column:
        return F.avg(x.cast("int"))

    counts = raw.groupBy(group, "business_name", "business_address").agg(F.count(F.lit(1)).alias("n")).groupBy(group).agg(F.sum(F.col("n") - 1).alias("repeated_rows"))
    figures = raw.groupBy(group).agg(
        F.count(F.lit(1)).alias("n_rows"), F.countDistinct("entity_id").alias("unique_ids"), count(F.col("business_name").isNull()).alias("null_names"), count(F.trim(name) == "").alias("empty_names"),
        count(F.trim(address) == "").alias("empty_addresses"), F.avg(F.length(name)).alias("mean_name_length"), F.percentile(F.length(name), F.lit(0.5)).alias("median_name_length"), F.percentile(F.length(name), F.lit(0.9)).alias("p90_name_length"),
        F.max(F.length(address)).alias("max_address_length"), share(name.rlike(r"[^\x00-\x7F]")).alias("nonascii_name_share"), share(address.rlike(r"(^|[^0-9])[0-9]{5}([^0-9]|$)")).alias("five_digit_share"), share(address.rlike(r"^\s*[0-9]+")).alias("leading_number_share"),
    )
    return figures.join(counts, group)


def rule_contribution(labelled: DataFrame, rules: tuple[str, ...]) -> DataFrame:
    """For each rule the share of all and of true candidates that it retrieved, and that only it retrieved."""
    hit = {r: F.col(r) > 0 for r in rules}
    total = sum((h.cast("int") for h in hit.values()), F.lit(0))
    rows = F.array(*[F.struct(F.lit(r).alias("rule"), F.avg(h.cast("int")).alias("share"), F.avg(F.when(F.col("label") == 1, h.cast("int"))).alias("share_of_true"), F.count(F.when(h & (total == 1), 1)).alias("only_this")) for r, h in hit.items()])
    return labelled.agg(rows.alias("r")).select(F.explode("r").alias("r")).select("r.*")


def missed_categories(missed: DataFrame) -> DataFrame:
    """Why true pairs were never candidates; ``missed`` has cores, addresses and script of both sides."""
    def words(c: str) -> Column:
        return F.filter(F.split(c, " "), lambda w: w != "")

    name, addr = (F.size(F.array_intersect(words(f"{c}_1"), words(f"{c}_2"))) for c in ("core", "addr"))
    cross, empty = F.coalesce("script_2", F.lit("latin")) != "latin", F.trim(F.coalesce("addr_2", F.lit(""))) == ""
    why = F.when(cross & empty, "non-latin name, no address").when(cross, "non-latin name").when(empty, "no address").when((name == 0) & (addr == 0), "no shared token").when(name == 0, "no shared name token").when(addr == 0, "no shared address token").otherwise("shared tokens, dropped")
    return missed.groupBy(why.alias("category")).agg(F.count(F.lit(1)).alias("n"))


def edge_cases(pairs: DataFrame, stats: DataFrame, entity: str = "s1_id") -> DataFrame:
    """Predicates over entities; each case with its entities, counts and macro F0.5.

    ``pairs`` has ``label, p, is_s2``, the similarities ``name_ratio,
    addr_ratio, name_jw, name_token_sort``, ``name_exact_normalized``,
    ``name_script_2`` (2 and above: not Latin) and the flags ``name_missing_1,
    name_missing_2, addr_missing_1, addr_missing_2``. ``stats`` is
    :func:`kinweave.operators.evaluate.score_pairs`, with ``n_true_s2`` and
    ``n_true_s3``: the true matches of each source, found or not. Missing
    similarities are weak, but noise is told from two present ones.
    """
    true = F.col("label") == 1
    name, addr, jw, sorted_name = (F.coalesce(c, F.lit(0.0)) for c in ("name_ratio", "addr_ratio", "name_jw", "name_token_sort"))
    no_name, no_addr = ((F.col(f"{f}_missing_1") == 1) | (F.col(f"{f}_missing_2") == 1) for f in ("name", "addr"))
    exact = F.col("name_exact_normalized") == 1
    by_pair = {
        "name strong, address weak": true & (name >= 0.85) & (addr < 0.5), "address strong, name weak": true & (addr >= 0.85) & (name < 0.5), "both noisy": true & (F.col("name_ratio") < 0.7) & (F.col("addr_ratio") < 0.7),
        "name collision": ~true & (name >= 0.9), "address collision": ~true & (addr >= 0.9), "missing name": true & no_name, "missing address": true & no_addr, "several fields missing": true & no_name & no_addr,
        "identical after normalisation": true & exact, "token order": true & (sorted_name >= 0.95) & (name < 0.9), "typo": true & (jw >= 0.9) & ~exact, "transliteration": true & (F.col("name_script_2") >= 2),
        "x_true": true, "x_high_false": ~true & (F.col("p") >= 0.3),
    }
    per = pairs.groupBy(entity).agg(F.sum("label").alias("true_cands"), *[F.coalesce(F.max(v.cast("int")), F.lit(0)).alias(k) for k, v in by_pair.items()])
    rows = stats.join(per, entity, "left").withColumn("true_cands", F.coalesce("true_cands", F.lit(0)))
    cases = {"true singleton": F.col("truth_size") == 0, "one match": F.col("truth_size") == 1, "several matches": F.col("truth_size") >= 2, "both sources": (F.col("n_true_s2") > 0) & (F.col("n_true_s3") > 0), "several in one source": (F.col("n_true_s2") > 1) | (F.col("n_true_s3") > 1)}
    cases |= {k: F.col(k) == 1 for k in by_pair if not k.startswith("x_")} | {"ambiguous": (F.col("x_true") == 1) & (F.col("x_high_false") == 1)}
    listed = F.filter(F.array(*[F.when(F.coalesce(v, F.lit(False)), F.lit(k)) for k, v in cases.items()]), lambda c: c.isNotNull())
    return rows.withColumn("edge_case", F.explode(listed)).groupBy("edge_case").agg(
        F.count(F.lit(1)).alias("entities"), F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum(F.col("truth_size") - F.col("true_cands")).alias("blocking_failures"), F.sum(F.col("true_cands") - F.col("tp")).alias("rejected_true"),
        F.count(F.when((F.col("truth_size") == 0) & (F.col("pred_size") > 0), 1)).alias("singleton_failures"), F.avg("f05").alias("macro_f05"),
    )


def inference_stats(kept: DataFrame, required: DataFrame, group: str, entity: str = "s1_id") -> DataFrame:
    """By group the entities, those matched, matches and matches per matched entity."""
    per = kept.groupBy(entity).agg(F.count(F.lit(1)).alias("n"))
    rows = required.join(per, entity, "left").groupBy(group).agg(F.count(F.lit(1)).alias("entities"), F.count("n").alias("matched_entities"), F.coalesce(F.sum("n"), F.lit(0)).alias("matches"))
    return rows.withColumn("matches_per_matched", F.col("matches") / F.nullif(F.col("matched_entities"), F.lit(0)))
