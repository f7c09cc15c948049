"""Row preparation around training: subsets, shuffled options, digests, validity, resuming, prompts."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as E


def source_subset(df: DataFrame, groups: int, seed: int, group: str = "source_group") -> DataFrame:
    """SL-3: all rows of `groups` whole groups, picked by hash."""
    picked = df.select(group).distinct().orderBy(*E.stable_key(seed, F.col(group))).limit(groups)
    return df.join(picked, group, "left_semi")


def shuffled_order(key: Column, size: Column, seed: int) -> Column:
    """SL-7: a seeded permutation of 0..size-1; place p shows option order[p]."""
    keyed = F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.struct(F.sha2(F.concat_ws("|", F.lit(str(seed)), key, i.cast("string")).cast("binary"), 256).alias("h"), i.alias("i")))
    return F.transform(F.array_sort(keyed), lambda x: x["i"])


def permuted(values: Column, order: Column) -> Column:
    return F.transform(order, lambda i: F.element_at(values, i + 1))


def unpermuted(values: Column, order: Column) -> Column:
    """Back to the original order."""
    return F.transform(F.sequence(F.lit(0), F.size(order) - 1), lambda i: F.element_at(values, F.array_position(order, i).cast("int")))


def by_level(ids: Column, values: Column) -> Column:
    """SL-6: values in the order of the ids as numbers."""
    pairs = F.transform(F.arrays_zip(ids.alias("i"), values.alias("v")), lambda x: F.struct(x["i"].try_cast("int").alias("i"), x["v"].alias("v")))
    return F.transform(F.array_sort(pairs, lambda a, b: a["i"] - b["i"]), lambda x: x["v"])


def digest(value, compact: bool = True) -> str:
    """The sha256 of a request as JSON with sorted keys: compact (SF-35), or with the default separators (SF-36)."""
    return hashlib.sha256(json.dumps(value, sort_keys=True, ensure_ascii=False, separators=(",", ":") if compact else None).encode()).hexdigest()


def request_digests(df: DataFrame, key: str, body: str, compact: bool = True) -> DataFrame:
    """(key, request_sha256) of JSON texts; null where a text is no JSON."""

    def one(text) -> str | None:
        try:
            return digest(json.loads(text), compact)
        except (TypeError, ValueError):
            return None

    kind = df.schema[key].dataType.simpleString()

    def step(batches):
        for b in batches:
            yield pd.DataFrame({key: b[key], "request_sha256": [one(x) for x in b[body]]})

    return df.select(key, body).mapInPandas(step, f"`{key}` {kind}, request_sha256 string")


def row_error(ids: Column, texts: Column, target: Column, tolerance: float = 1e-6) -> Column:
    """EV-5 to EV-7: the first rule that a row's candidates and target break, or null."""
    return (
        F.when((F.size(ids) < 2) | (F.size(ids) > 128), "2-128 candidates are required")
        .when(F.exists(ids, lambda x: x.isNull() | (x != F.trim(x)) | (x == "") | (F.length(x) > 128)), "invalid candidate id")
        .when(F.size(F.array_distinct(ids)) != F.size(ids), "candidate ids must be unique")
        .when(F.exists(texts, lambda x: x.isNull() | (F.trim(x) == "") | (F.length(x) > 4096)), "invalid candidate text")
        .when(F.size(target) != F.size(ids), "invalid candidate/target alignment")
        .when(F.exists(target, lambda x: x.isNull() | F.isnan(x) | (x < 0) | (x == float("inf"))), "invalid target")
        .when(F.abs(E.total(target) - 1) > tolerance, "target must sum to one")
    )


def preflight(df: DataFrame, error: Column, split: str = "split", share: float = 0.001) -> DataFrame:
    """PF-16: df without bad rows of train, at most `share` of them; any other bad row raises."""
    checked = df.withColumn("_bad", error.isNotNull())
    counts = checked.groupBy(split).agg(F.count(F.lit(1)).alias("n"), F.count_if("_bad").alias("bad")).collect()  # a row for each split
    for r in counts:
        if r["bad"] > (share * r["n"] if r[split] == "train" else 0):
            raise ValueError(f"{r['bad']} of {r['n']} rows of {r[split]} are invalid")
    return checked.where(~F.col("_bad")).drop("_bad")


def labelled(df: DataFrame, *, teacher: bool = False, split: str = "split", source: str = "label_source") -> DataFrame:
    """PF-11: rows whose label_source is "none" hold a place for a label. Without a teacher they raise in train; elsewhere they go."""
    none = F.coalesce(F.col(source) == "none", F.lit(False))
    if not teacher:
        n = df.where(none & (F.col(split) == "train")).count()
        if n:
            raise ValueError(f"{n} training rows have label_source 'none' and there is no teacher")
    return df.where(~none | (F.col(split) == "train"))


def label_kept(gold: Column, quality: Column, order: Column) -> Column:
    """LB-22: whether a judge's ranked options bear a label out: first, or among the first two where sources agreed. Without a judgement it stays."""
    place = F.array_position(order, gold)
    return F.coalesce((place == 1) | ((place == 2) & (quality == "agreed")), F.lit(True))


def pending(items: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """SRC-16: what has not been scored yet."""
    return items.join(done.select(*keys), keys, "left_anti")


def asked(pages: DataFrame, labelled: DataFrame, always: tuple[str, ...] = ("page_type", "page_status")) -> DataFrame:
    """PF-15, JN-14: (page_id, decision): some decisions of every page, others only where a label exists."""
    fixed = pages.select("page_id", F.explode(F.array(*map(F.lit, always))).alias("decision"))
    return fixed.unionByName(labelled.where(~F.col("decision").isin(*always)).select("page_id", "decision"))


def prompt(page: Column, question: Column, texts: Column, chars: int = 3500) -> Column:
    """SF-41: the page's head, the question and lettered options."""
    options = F.array_join(F.transform(texts, lambda t, i: F.concat(F.char(i + 65), F.lit(". "), t)), "\n")
    return F.concat_ws("\n\n", F.substring(page, 1, chars), question, options, F.lit("Answer with one letter."))


def moving_average(df: DataFrame, keys: list[str], order: str, value: str, decay: float, bucket: Column) -> DataFrame:
    """MD-6: (keys, average), where the average starts at 0 and each value in order moves it: average * decay + value * (1 - decay).

    An average over a run of values is its number and a weighted sum, and runs put together are that again. So each key's rows are averaged in buckets, which grow with
    `order`, and the buckets' sums, a small table, are put together: no task has all rows of a key.
    """
    fall = lambda n: F.pow(F.lit(float(decay)), n)
    within = Window.partitionBy(*keys, "_bucket").orderBy(F.desc(order))
    placed = df.select(*keys, order, value, bucket.alias("_bucket")).withColumn("_after", F.row_number().over(within) - 1)
    parts = placed.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"), F.sum(F.col(value) * (1 - decay) * fall(F.col("_after"))).alias("_s"))
    later = Window.partitionBy(*keys).orderBy(F.desc("_bucket")).rowsBetween(Window.unboundedPreceding, -1)
    moved = parts.withColumn("_s", F.col("_s") * fall(F.coalesce(F.sum("_n").over(later), F.lit(0))))
    return moved.groupBy(*keys).agg(F.sum("_s").alias("average"))
