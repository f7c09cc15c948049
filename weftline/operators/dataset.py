"""Building decision datasets: splits, caps, balance, mixing, merging, manifests. Seeded shuffles are orders by a salted hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as E


def first_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row of each key, the first in order (WN-4). A minimum by struct sums up before the shuffle, so a hot key is no one task's."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*order, *rest), F.struct(*order)).alias("_x"))
    return best.select(*keys, *(F.col(f"_x.{c}").alias(c) for c in [*order, *rest])).select(*df.columns)


def cap_pages(df: DataFrame, group: str, page: str, most: int, seed: int) -> DataFrame:
    """All rows of at most `most` pages of each group, picked by hash (WN-1)."""
    pages = df.select(group, page).distinct()
    w = Window.partitionBy(group).orderBy(*E.stable_key(seed, F.col(page)))
    kept = pages.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).drop("_n")  # Spark keeps the top of each group before the shuffle
    return df.join(kept, [group, page], "left_semi")


def running_cap(df: DataFrame, group: str, order: list[str], most: int) -> DataFrame:
    """The first `most` rows of each group in arrival order (WN-5, WN-10)."""
    w = Window.partitionBy(group).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).drop("_n")


def hash_rank(df: DataFrame, keys: list[str], seed: int, key: str, out: str = "_n") -> DataFrame:
    """Each row's place from 1 in its group's seeded order, without bringing a group's rows into one task.

    Groups are dealt by the hash's first two digits, rows are numbered in their part, and the parts' counts, 256 for a group at most, say
    where each begins. df is read twice.
    """
    dealt = df.withColumn("_h", E.stable_key(seed, F.col(key))[0]).withColumn("_b", F.substring("_h", 1, 2))
    counts = dealt.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_c"))
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col("_b").alias("_kb"), F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_base"))
    ranked = dealt.withColumn("_r", F.row_number().over(Window.partitionBy(*keys, "_b").orderBy("_h", key)))
    on = [ranked[k].eqNullSafe(bases[f"_k{i}"]) for i, k in enumerate(keys)] + [ranked["_b"] == bases["_kb"]]
    return ranked.join(bases, on).withColumn(out, F.col("_r") + F.col("_base")).drop("_h", "_b", "_r", "_kb", "_base", *(f"_k{i}" for i in range(len(keys))))


def capped(df: DataFrame, keys: list[str], caps: DataFrame, seed: int, key: str) -> DataFrame:
    """At most `cap` rows of each group in its seeded order; a group without a cap keeps all. caps has a row for each group."""
    joined = hash_rank(df, keys, seed, key).join(caps, keys, "left")
    return joined.where(F.col("cap").isNull() | (F.col("_n") <= F.col("cap"))).drop("_n", "cap")


def balance_v1(df: DataFrame, *, seed: int, key: str = "case_id", split: str | None = "split", page_type_ratio: float = 3.0, ok_ratio: float = 3.0, per_language: int = 1500) -> DataFrame:
    """WN-2 on columns decision, label: page_type labels to a multiple of their median count, ok to a multiple of the errors, languages to a number."""
    by = [split] if split else []
    counts = df.groupBy(*by, "decision", "label").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*by, "decision")
    types = F.col("decision") == "page_type"
    ok = (F.col("decision") == "page_status") & (F.col("label") == "ok")
    errors = F.sum(F.when((F.col("decision") == "page_status") & (F.col("label") != "ok"), F.col("n")).otherwise(0)).over(w)
    cap = (
        F.when(types, F.greatest(F.lit(1), F.floor(F.lit(page_type_ratio) * F.percentile("n", F.lit(0.5)).over(w)).cast("long")))
        .when(ok & (errors > 0), F.greatest(F.lit(1), F.floor(F.lit(ok_ratio) * errors).cast("long")))
        .when(F.col("decision") == "language", F.lit(per_language))
    )
    caps = counts.withColumn("cap", cap.cast("long")).drop("n")
    return capped(df, [*by, "decision", "label"], caps, seed, key)


def balance_v0(df: DataFrame, *, seed: int, max_ratio: float, key: str = "case_id") -> DataFrame:
    """WN-3: page_type and in_stock labels to a multiple of the rarest label, at least one."""
    counts = df.groupBy("decision", "label").agg(F.count(F.lit(1)).alias("n"))
    rarest = F.min("n").over(Window.partitionBy("decision"))
    cap = F.when(F.col("decision").isin("page_type", "in_stock"), F.greatest(F.lit(1), F.floor(F.lit(max_ratio) * rarest).cast("long")))
    return capped(df, ["decision", "label"], counts.withColumn("cap", cap.cast("long")).drop("n"), seed, key)


def stratified_split(df: DataFrame, *, stratum: str, key: str, seed: int) -> DataFrame:
    """SL-4: a tenth of each stratum to development and to calibration, at least one each; raises if a stratum has none left."""
    # half to even, as whole numbers: n/10 is on a half only for n ending in 5
    ten = lambda n: F.greatest(F.lit(1), F.floor((n + F.when((n % 10 == 5) & (F.floor(n / 10) % 2 == 0), 4).otherwise(5)) / 10).cast("int"))
    sizes = df.groupBy(F.col(stratum).alias("_s")).agg(F.count(F.lit(1)).cast("int").alias("_k"))
    ranked = hash_rank(df, [stratum], seed, key)
    ranked = ranked.join(sizes, ranked[stratum].eqNullSafe(sizes["_s"])).drop("_s")
    tenth = ten(F.col("_k"))
    split = (
        F.when(F.col("_k") - 2 * tenth < 1, F.raise_error(F.concat(F.lit("not enough cases in "), F.col(stratum).cast("string"))).cast("string"))
        .when(F.col("_n") <= tenth, "development")
        .when(F.col("_n") <= 2 * tenth, "calibration")
        .otherwise("train")
    )
    return ranked.withColumn("split", split).drop("_n", "_k")


def sample_n(df: DataFrame, n: int, key: str, seed: int, direct: int = 10_000) -> DataFrame:
    """Exactly n rows by hash order (SL-2), or all if there are fewer.

    Few rows are a distributed top-n. More are those below a bound of the hash's first four digits, whose counts (65,536 numbers at most) are taken first, in a job that runs
    before this returns; only the rows at the bound, a 65,536th of df, are ordered. No task holds n rows. df is read three times.
    """
    order = E.stable_key(seed, F.col(key))
    if n <= direct:
        return df.orderBy(*order).limit(n)
    head = F.substring(order[0], 1, 4)
    bound, below = None, 0
    for r in df.groupBy(head.alias("head")).count().orderBy("head").collect():
        if below + r["count"] > n:
            bound = r["head"]
            break
        below += r["count"]
    if bound is None:
        return df
    at = df.where(head == bound).orderBy(*order).limit(n - below)
    return df.where(head < bound).unionAll(at)


def mix(train: DataFrame, old: DataFrame, ratio: float, *, key: str, seed: int, group: str = "source_group") -> DataFrame:
    """SO-2: rows of an old set up to a share of the whole, their groups marked."""
    n = int(train.count() * ratio / (1 - ratio))
    return train.unionByName(sample_n(old, n, key, seed).withColumn(group, F.concat(F.lit("mix::"), F.col(group))), allowMissingColumns=True)


def leaking_groups(df: DataFrame, group: str = "source_group", split: str = "split") -> DataFrame:
    """Groups in more than one split (JN-5, JN-6)."""
    return df.groupBy(group).agg(F.count_distinct(split).alias("n_splits")).where("n_splits > 1")


def merged(parts: list[DataFrame]) -> DataFrame:
    """SO-1 with JN-6: the union of datasets; raises where a group stands in two splits."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    bad = leaking_groups(out).select("source_group").limit(5).collect()
    if bad:
        raise ValueError(f"groups in more than one split: {[r[0] for r in bad]}")
    return out


def split_manifest(df: DataFrame, row_json: Column, split: str = "split", group: str = "source_group") -> DataFrame:
    """AG-14, DS-12: rows, groups and an order-free digest of each split.

    Rows' hashes are summed modulo 2**64 in two lanes, so no split is gathered in one place.
    """
    h = F.sha2(row_json.cast("binary"), 256)
    lane = lambda a: F.sum(F.conv(F.substring(h, a, 8), 16, 10).cast("decimal(20,0)"))
    return df.groupBy(split).agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(group).alias("source_groups"), lane(1).cast("decimal(38,0)").alias("a"), lane(9).cast("decimal(38,0)").alias("b")).select(
        split, "rows", "source_groups", F.sha2(F.concat_ws(":", "rows", "a", "b").cast("binary"), 256).alias("digest")
    )


def rotated_states(df: DataFrame, *, workflow: str, group: str, state: str, seed: int) -> DataFrame:
    """WN-7: each group of a workflow with the state of the next one in a seeded circle."""
    states = df.groupBy(workflow, group).agg(F.max(state).alias("_own"))
    w = Window.partitionBy(workflow).orderBy(*E.stable_key(seed, F.col(workflow), F.col(group)))
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return states.select(workflow, group, F.coalesce(F.lead("_own").over(w), F.first("_own").over(whole)).alias(state))


def state_ablations(df: DataFrame, *, workflow: str = "workflow", group: str = "source_group", state: str = "state", seed: int = 1, blank: str = "{}") -> DataFrame:
    """DS-11: every row three times, told apart by `condition`: as it is, with a blank state, and with the state of another source of its workflow.

    Raises where a workflow has one source alone. The sources' table is small beside the rows: one row for each.
    """
    alone = df.groupBy(workflow).agg(F.count_distinct(group).alias("n")).where("n < 2").limit(1).collect()
    if alone:
        raise ValueError(f"state ablation needs several sources in {alone[0][0]}")
    moved = rotated_states(df, workflow=workflow, group=group, state=state, seed=seed).select(F.col(workflow).alias("_w"), F.col(group).alias("_g"), F.col(state).alias("_other"))
    joined = df.join(moved, F.col(workflow).eqNullSafe(F.col("_w")) & F.col(group).eqNullSafe(F.col("_g")))
    conditions = F.array(
        F.struct(F.lit("original").alias("condition"), F.col(state).alias("state")),
        F.struct(F.lit("blank").alias("condition"), F.lit(blank).alias("state")),
        F.struct(F.lit("shuffled_within_workflow").alias("condition"), F.col("_other").alias("state")),
    )
    rest = [c for c in df.columns if c != state]
    return joined.select(*rest, F.explode(conditions).alias("_c")).select(*rest, F.col("_c.condition").alias("condition"), F.col("_c.state").alias(state))


def shuffled(df: DataFrame, key: str, seed: int) -> DataFrame:
    """SL-5: all rows in a seeded order, by a range-partitioned sort."""
    return df.orderBy(*E.stable_key(seed, F.col(key)))


def attach_metadata(records: DataFrame, *, file: str = "warc_file", seq: str = "seq", url: str = "url", kind: str = "rec_type", value: str = "lang3") -> DataFrame:
    """JN-1: each response with the first metadata record of its URL before the file's next response."""
    w = Window.partitionBy(file).orderBy(seq)
    run = records.withColumn("_run", F.sum((F.col(kind) == "response").cast("int")).over(w)).where("_run > 0")
    own = Window.partitionBy(file, "_run")
    target = F.max(F.when(F.col(kind) == "response", F.col(url))).over(own)
    match = (F.col(kind) == "metadata") & (F.col(url) == F.col("_target"))
    found = run.withColumn("_target", target).withColumn("detected_language", F.min_by(F.when(match, F.col(value)), F.when(match, F.col(seq))).over(own))
    return found.where(F.col(kind) == "response").drop("_run", "_target")
