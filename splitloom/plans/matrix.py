"""Run one configuration, or the whole list of them from a single scan."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from splitloom.functions.order import seeded_order
from splitloom.operators.cap import first_per_group, reject_short
from splitloom.operators.folds import attach_folds, fold_cuts
from splitloom.operators.heldout import split_heldout_title, split_heldout_titles, title_plan
from splitloom.operators.joins import lookup_side
from splitloom.operators.predicates import require_values
from splitloom.plans.configs import SplitConfig, configs_frame, usable
from splitloom.plans.splits import cv_split, train_test_split

KEYS = ("config_id", "split_id")


def run_config(
    docs: DataFrame, config: SplitConfig, target: str = "author", seed: int = 42, on_short: str = "error"
) -> DataFrame:
    """The splits of one configuration over the documents of its corpus."""
    docs = usable(docs, F.lit(config.corpus))
    limits = {
        "max_targets": config.max_targets,
        "max_docs_per_target": config.max_docs_per_target,
        "seed": seed,
        "on_short": on_short,
    }
    if config.rule == "titles":
        splits = split_heldout_title(docs, config.test_language, author=target)
    elif config.rule == "folds":
        splits = cv_split(docs, target, config.n_splits, **limits)
    else:
        if config.loader == "reddit":
            require_values(docs, config.domain, config.train_values, "train")
            require_values(docs, config.domain, config.test_values, "test")
        train, test = config.side_conditions()
        splits = train_test_split(docs.where(train), docs.where(test), target, **limits)
    return splits.select(F.lit(config.config_id).alias("config_id"), "*")


def _rules(spark: SparkSession, configs: Sequence[SplitConfig]) -> DataFrame:
    """The rules on sides as a table, one row per configuration."""
    schema = (
        "_corpus STRING, config_id STRING, _domain STRING, _test_domain STRING,"
        " _train ARRAY<STRING>, _test ARRAY<STRING>, _problem STRING, cap INT"
    )
    rows = [
        (
            config.corpus, config.config_id, config.domain, config.test_domain,
            list(config.train_values or ()), list(config.test_values or ()), config.problem,
            config.max_docs_per_target or None,
        )
        for config in configs
    ]
    return spark.createDataFrame(rows, schema)


def _marked(docs: DataFrame, configs: Sequence[SplitConfig], corpus: str) -> DataFrame:
    """Each document once per configuration that uses it, with its role there."""
    domains = sorted({config.domain for config in configs})
    # As many rules as configurations were handed over: the broadcast is small.
    rules = F.broadcast(_rules(docs.sparkSession, configs))
    joined = docs.join(rules, F.col(corpus) == F.col("_corpus"))
    value = F.lit(None).cast("string")
    for domain in domains:
        value = F.when(F.col("_domain") == domain, F.col(domain)).otherwise(value)
    one_out = F.when(value.eqNullSafe(F.col("_test_domain")), F.lit("test")).otherwise(F.lit("train"))
    by_sets = F.when(F.array_contains("_train", value), F.lit("train")).when(
        F.array_contains("_test", value), F.lit("test")
    )
    role = F.when(F.col("_test_domain").isNotNull(), one_out).otherwise(by_sets)
    if any(config.problem for config in configs):
        role = F.when(F.col("_problem").isNull() | (F.col("_problem") == F.col("problem")), role)
    marked = joined.withColumn("role", role).where(F.col("role").isNotNull())
    return marked.drop("_corpus", "_domain", "_test_domain", "_train", "_test", "_problem")


def _columns_used(configs: Sequence[SplitConfig], corpus: str) -> list[str]:
    used = {config.domain for config in configs} | {corpus}
    if any(config.problem for config in configs):
        used.add("problem")
    return sorted(used)


def _of_rule(configs: Sequence[SplitConfig], rule: str) -> list[SplitConfig]:
    return [config for config in configs if config.rule == rule]


def _one_value(configs: Sequence[SplitConfig], name: str):
    values = {getattr(config, name) for config in configs}
    if len(values) != 1:
        raise ValueError(f"configurations of one matrix must share {name}")
    return values.pop()


def _no_target_limit(configs: Sequence[SplitConfig]) -> None:
    if any(config.max_targets for config in configs):
        raise ValueError("use run_config for configurations with max_targets")


def matching_documents(
    docs: DataFrame, configs: Sequence[SplitConfig], corpus: str = "corpus"
) -> DataFrame:
    """(config_id, n_train, n_test): documents that each rule puts on its sides.

    The column `corpus` says to which corpus a document belongs.
    Rows are first counted per combination of the attributes that rules read, so
    that the configurations multiply counts and not documents.
    """
    sided = _of_rule(configs, "sides")
    counts = usable(docs, F.col(corpus)).groupBy(*_columns_used(sided, corpus)).agg(F.count("*").alias("n"))
    return _marked(counts, sided, corpus).groupBy("config_id").agg(
        F.sum(F.when(F.col("role") == "train", F.col("n")).otherwise(0)).alias("n_train"),
        F.sum(F.when(F.col("role") == "test", F.col("n")).otherwise(0)).alias("n_test"),
    )


def matrix_summary(
    docs: DataFrame, configs: Sequence[SplitConfig], target: str = "author", corpus: str = "corpus"
) -> DataFrame:
    """(config_id, n_splits, n_train, n_test), both summed over the splits.

    What `run_config` would give with short targets kept, but from counts: one
    aggregation for all rules on sides, one for all folds, one for all titles.
    """
    _no_target_limit(configs)
    docs = usable(docs, F.col(corpus))
    n = F.col("n")
    parts = []
    sided = _of_rule(configs, "sides")
    if sided:
        used = _columns_used(sided, corpus)
        counts = docs.groupBy(*used, F.col(target).alias("target")).agg(F.count("*").alias("n"))
        per_target = (
            _marked(counts, sided, corpus)
            .groupBy("config_id", "cap", "target")
            .agg(
                F.sum(F.when(F.col("role") == "train", n).otherwise(0)).alias("train"),
                F.sum(F.when(F.col("role") == "test", n).otherwise(0)).alias("test"),
            )
        )
        parts.append(
            per_target.groupBy("config_id").agg(
                F.lit(1).cast("long").alias("n_splits"),
                F.sum(_capped(F.col("train"))).alias("n_train"),
                F.sum(F.when(F.col("train") > 0, F.col("test")).otherwise(0)).alias("n_test"),
            )
        )
    folded = _of_rule(configs, "folds")
    if folded:
        parts.append(_folds_summary(docs, folded, target, corpus))
    titled = _of_rule(configs, "titles")
    if titled:
        parts.append(_titles_summary(docs, titled, target, corpus))
    found = reduce(DataFrame.unionByName, parts)
    # A configuration that matches no document is reported with empty sides.
    listed = configs_frame(docs.sparkSession, configs).select("config_id")
    return listed.join(found, "config_id", "left").na.fill({"n_splits": 1, "n_train": 0, "n_test": 0})


def _capped(count: Column) -> Column:
    """Training documents that a limit leaves. Capping drops missing targets."""
    limited = F.when(F.col("target").isNull(), 0).otherwise(F.least(count, F.col("cap")))
    return F.when(F.col("cap").isNull(), count).otherwise(limited)


def _config_rows(configs: Sequence[SplitConfig]) -> Column:
    return F.inline(
        F.array(
            *[
                F.struct(
                    F.lit(config.config_id).alias("config_id"),
                    F.lit(config.max_docs_per_target or None).cast("int").alias("cap"),
                )
                for config in configs
            ]
        )
    )


def _folds_summary(
    docs: DataFrame, configs: Sequence[SplitConfig], target: str, corpus: str
) -> DataFrame:
    k = _one_value(configs, "n_splits")
    _one_value(configs, "path")
    docs = docs.where(F.col(corpus) == configs[0].corpus)
    cuts = fold_cuts(docs, target, k)
    folds = attach_folds(docs.select(F.col(target).alias("target"), "doc_id"), cuts, "target")
    per_fold = folds.groupBy("target").agg(
        *[F.count_if(F.col("fold") == i).alias(f"_{i}") for i in range(k)], F.count("*").alias("size")
    )
    sides = F.array(
        *[F.struct((F.col("size") - F.col(f"_{i}")).alias("train"), F.col(f"_{i}").alias("test")) for i in range(k)]
    )
    rows = per_fold.select("target", F.inline(sides)).select("*", _config_rows(configs))
    return rows.groupBy("config_id").agg(
        F.lit(k).cast("long").alias("n_splits"),
        F.sum(_capped(F.col("train"))).alias("n_train"),
        F.sum("test").alias("n_test"),
    )


def _titles_summary(
    docs: DataFrame, configs: Sequence[SplitConfig], target: str, corpus: str
) -> DataFrame:
    _one_value(configs, "path")
    docs = docs.where(F.col(corpus) == configs[0].corpus)
    languages = [config.test_language for config in configs]
    plan = title_plan(docs, languages, author=target).where(F.col("split_id").isNotNull())
    own = F.col("overlaps")
    planned = plan.groupBy("test_language").agg(
        F.count_if(own).alias("n_own"),
        F.sum("n_test").alias("n_test"),
        F.sum(F.when(own, F.col("n_removed")).otherwise(0)).alias("n_removed"),
    )
    totals = docs.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(config.config_id).alias("config_id"),
                        F.lit(config.test_language).alias("test_language"),
                        (~F.col("language").eqNullSafe(config.test_language)).alias("is_train"),
                    )
                    for config in configs
                ]
            )
        )
    )
    totals = totals.groupBy("config_id", "test_language").agg(F.count_if("is_train").alias("n_all"))
    joined = totals.join(planned, "test_language", "left").na.fill(0)
    # The split of the remaining titles comes on top, and trains on everything.
    n_splits = F.col("n_own") + 1
    return joined.select(
        "config_id",
        n_splits.alias("n_splits"),
        (F.col("n_all") * n_splits - F.col("n_removed")).alias("n_train"),
        "n_test",
    )


def _families(configs: Sequence[SplitConfig]) -> list[list[SplitConfig]]:
    """Configurations that differ in their limit on documents alone."""
    families: dict[SplitConfig, list[SplitConfig]] = {}
    for config in configs:
        families.setdefault(replace(config, config_id="", max_docs_per_target=None), []).append(config)
    return list(families.values())


def matrix_splits(
    docs: DataFrame,
    configs: Sequence[SplitConfig],
    target: str = "author",
    corpus: str = "corpus",
    seed: int = 42,
    on_short: str = "error",
) -> DataFrame:
    """All splits of many configurations: (config_id, split_id, role, doc_id, target, not_in_split).

    The same rows as `run_config` gives. One plan for all rules on sides, one for all
    folds, and one for the held-out titles of each corpus, whatever the number of
    configurations. `not_in_split` is set for held-out titles alone, whose training
    rows have no `split_id`: they serve all splits but that one.
    """
    _no_target_limit(configs)
    docs = usable(docs, F.col(corpus))
    parts = []
    sided = _families(_of_rule(configs, "sides"))
    if sided:
        first = [family[0] for family in sided]
        own = docs.select("doc_id", F.col(target).alias("target"), *_columns_used(first, corpus))
        rows = _marked(own, first, corpus).withColumn("split_id", F.lit("0"))
        rows = rows.select(*KEYS, "role", "doc_id", "target")
        train = rows.where(F.col("role") == "train")
        listed = lookup_side(
            train.select(F.col("config_id").alias("_c"), F.col("target").alias("_t")).distinct()
        )
        test = rows.where(F.col("role") == "test").join(
            listed,
            (F.col("config_id") == F.col("_c")) & F.col("target").eqNullSafe(F.col("_t")),
            "left_semi",
        )
        parts += _each_limit(train, test, sided, seed, on_short)
    folded = _families(_of_rule(configs, "folds"))
    if folded:
        first = [family[0] for family in folded]
        k = _one_value(first, "n_splits")
        _one_value(first, "path")
        own = docs.where(F.col(corpus) == first[0].corpus)
        cuts = fold_cuts(own, target, k)
        folds = attach_folds(own.select("doc_id", F.col(target).alias("target")), cuts, "target")
        rows = folds.select("*", _config_rows(first)).select(
            "*", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("_split")
        )
        rows = rows.withColumn("split_id", F.col("_split").cast("string"))
        tested = F.col("_split") == F.col("fold")
        train = rows.where(~tested).withColumn("role", F.lit("train"))
        test = rows.where(tested).withColumn("role", F.lit("test"))
        parts += _each_limit(train, test, folded, seed, on_short)
    parts += _title_rows(docs, _of_rule(configs, "titles"), target, corpus)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts).select(
        *KEYS, "role", "doc_id", "target", "not_in_split"
    )


def _title_rows(
    docs: DataFrame, configs: Sequence[SplitConfig], target: str, corpus: str
) -> list[DataFrame]:
    """The rows of held-out titles, in one plan per corpus."""
    parts = []
    for name in sorted({config.corpus for config in configs}):
        ids = {config.test_language: config.config_id for config in configs if config.corpus == name}
        own = docs.where(F.col(corpus) == name)
        config_id = F.lit(None).cast("string")
        for language, own_id in ids.items():
            config_id = F.when(F.col("test_language") == language, F.lit(own_id)).otherwise(config_id)
        rows = split_heldout_titles(own, list(ids), author=target).withColumn("config_id", config_id)
        parts.append(rows.drop("test_language"))
    return parts or [docs.sparkSession.createDataFrame([], "not_in_split STRING")]


def _each_limit(
    train: DataFrame, test: DataFrame, families: Sequence[Sequence[SplitConfig]], seed: int, on_short: str
) -> list[DataFrame]:
    """Rows of every family, one for each of its configurations and within its limit.

    The draw of a document depends on its split and not on the limit, so the rows of
    a limit are among those of a larger one: they are ranked once, up to the largest.
    """
    columns = [*KEYS, "role", "doc_id", "target"]
    limits = [(own[0].config_id, config.config_id, config.max_docs_per_target or None) for own in families for config in own]
    # As many rows as configurations were handed over: the broadcast is small.
    listed = F.broadcast(train.sparkSession.createDataFrame(limits, "_family STRING, _id STRING, _cap INT"))

    def each(rows: DataFrame, which: Column) -> DataFrame:
        joined = rows.join(listed.where(which), F.col("config_id") == F.col("_family"))
        if "_rank" in rows.columns:
            joined = joined.where("_rank <= _cap")
        return joined.withColumn("config_id", F.col("_id")).select(*columns)

    parts = [each(test, F.lit(True)), each(train, F.col("_cap").isNull())]
    most = {own[0].config_id: max(c.max_docs_per_target or 0 for c in own) for own in families}
    most = {name: cap for name, cap in most.items() if cap}
    if not most:
        return parts
    groups = [*KEYS, "target"]
    cap = F.lit(None).cast("int")
    for name, largest in most.items():
        cap = F.when(F.col("config_id") == name, F.lit(largest)).otherwise(cap)
    draw = seeded_order(seed, "document", F.col("split_id"), F.col("doc_id"))
    limited = train.where(F.col("config_id").isin(list(most)) & F.col("target").isNotNull())
    limited = limited.select(*columns, cap.alias("cap"), draw.alias("_draw"))
    kept = first_per_group(limited, groups, max(most.values()), own="cap")
    if on_short == "error":
        kept = reject_short(kept, groups, max(most.values()), "cap")
    rank = F.row_number().over(Window.partitionBy(*groups).orderBy("_draw", "doc_id"))
    return [*parts, each(kept.withColumn("_rank", rank), F.col("_cap").isNotNull())]
