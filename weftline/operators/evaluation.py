"""Reports over scored decisions and prediction ledgers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as E


def scored(df: DataFrame, temperature: Column | float = 1.0) -> DataFrame:
    """Adds p, conf, correct, ce, brier to rows with logits, target."""
    df = df.withColumn("p", E.softmax(F.col("logits"), temperature))
    return df.withColumns(
        {
            "conf": F.array_max("p"),
            "correct": (E.argmax(F.col("p")) == E.argmax(F.col("target"))).cast("int"),
            "ce": E.soft_ce(F.col("p"), F.col("target")),
            "brier": E.brier(F.col("p"), E.one_hot(F.size("p"), E.argmax(F.col("target")))),
        }
    )


def ece(df: DataFrame, keys: list[str], conf: str = "conf", correct: str = "correct", bins: int = 15) -> DataFrame:
    """AG-2: expected calibration error over equal bins, by keys."""
    place = F.least(F.lit(bins - 1), F.floor(F.col(conf) * bins).cast("int"))
    binned = df.groupBy(*keys, place.alias("_bin")).agg(F.count(F.lit(1)).alias("n"), F.sum(conf).alias("c"), F.sum(correct).alias("h"))
    return binned.groupBy(*keys).agg((F.sum(F.abs(F.col("c") - F.col("h"))) / F.sum("n")).alias("ece"))


def by_key(df: DataFrame) -> DataFrame:
    """Each row under all, its workflow and its type (AG-3)."""
    kind = F.concat(F.lit("type:"), F.coalesce("question_type", F.lit("choice")))
    return df.withColumn("key", F.explode(F.array(F.lit("all"), F.col("workflow"), kind)))


def metrics(df: DataFrame, temperature: Column | float = 1.0) -> DataFrame:
    rows = by_key(scored(df, temperature)).select("key", "conf", "correct", "ce", "brier")
    sums = rows.groupBy("key").agg(F.count(F.lit(1)).alias("decisions"), F.avg("correct").alias("accuracy"), F.avg("ce").alias("soft_ce"), F.avg("brier").alias("brier"))
    return sums.join(ece(rows, ["key"]), "key")


def selective(df: DataFrame, thresholds: tuple[float, ...] = (0.4, 0.5, 0.6, 0.7), temperature: Column | float = 1.0) -> DataFrame:
    """AG-4: one pass with a pair of conditional sums for each threshold."""
    rows = scored(df, temperature).select("conf", "correct")
    parts = [F.struct(F.lit(t).alias("threshold"), F.avg((F.col("conf") >= t).cast("double")).alias("coverage"), F.avg(F.when(F.col("conf") >= t, F.col("correct"))).alias("accepted_accuracy")) for t in thresholds]
    return rows.agg(F.array(*parts).alias("x")).select(F.explode("x").alias("x")).select("x.*")


def fit_temperature(df: DataFrame, keys: list[str] | None = None, low: int = 50, high: int = 500, step: int = 21) -> DataFrame:
    """AG-5, AG-6: the temperature of least total soft cross entropy on a grid of hundredths, the first among equals.

    The loss is convex in 1/T, so every `step`-th point comes first, and then all points between the best one's neighbours: 64 losses a row in place of 451. Where a probability
    falls below its floor at the lowest temperature the loss need not be convex; such keys take the whole grid. Rows meet the points and are summed in the same stage:
    what a task sends on is a row for each key and temperature, whatever it read. df is read twice.
    """
    keys = keys or []
    rows = df.select(*keys, "logits", "target")
    grouped = lambda d, *by: d.groupBy(*by) if by else d.groupBy()
    best = F.min(F.struct(F.round("ce", 6).alias("ce"), "t")).alias("b")

    def losses(d: DataFrame, points: Column, *extra: Column) -> DataFrame:
        loss = E.soft_ce(E.softmax(F.col("logits"), F.col("t") / F.lit(100.0)), F.col("target"))
        at = d.withColumn("t", F.explode(points))
        return grouped(at, *keys, "t").agg(F.sum(loss).alias("ce"), *extra)

    coarse_points = F.array_union(F.sequence(F.lit(low), F.lit(high), F.lit(step)), F.array(F.lit(high)))
    # the largest distance below the greatest logit of an option that counts, at the lowest temperature
    depth = F.array_max(F.zip_with("logits", "target", lambda z, y: F.when(y > 0, F.array_max("logits") - z))) / F.lit(low / 100.0) + F.ln(F.size("logits"))
    coarse = losses(rows, coarse_points, F.max(depth).alias("depth"))
    found = grouped(coarse, *keys).agg(best, F.max("depth").alias("depth"))
    whole = F.col("depth") > F.lit(27.0)  # 1e-12 is exp(-27.6)
    window = found.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.when(whole, low).otherwise(F.greatest(F.lit(low), F.col("b.t") - step)).alias("_from"), F.when(whole, high).otherwise(F.least(F.lit(high), F.col("b.t") + step)).alias("_to"))
    on = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    met = rows.join(window, on) if keys else rows.crossJoin(window)  # one row
    out = grouped(losses(met, F.sequence("_from", "_to")), *keys).agg(best)
    return out.select(*keys, (F.col("b.t") / F.lit(100.0)).alias("temperature"), F.col("b.ce").alias("total_ce"))


def order_statistics(df: DataFrame, col: str, ranks: list[int] | None = None, *, places: list[float] | None = None, few: int = 10_000) -> list[float | None]:
    """Exact values at 0-based ranks of a column's non-null values in order; or, for places between 0 and 1, by linear interpolation (AG-18).

    Found by counting: each pass counts values in 4,096 equal intervals between the least and the greatest that are left, until the interval with the rank
    holds `few` values or one value alone. No task holds more than its counts. df is read a few times.
    """
    x = df.select(F.col(col).cast("double").alias("x")).where("x IS NOT NULL")
    least, most, n = x.agg(F.min("x"), F.max("x"), F.count(F.lit(1))).first()
    if not n:
        return [None] * len(ranks if ranks is not None else places)
    if places is not None:
        at = [p * (n - 1) for p in places]
        found = dict(zip(need := sorted({int(a) for a in at} | {min(n - 1, int(a) + 1) for a in at}), order_statistics(df, col, need, few=few), strict=True))
        return [found[int(a)] + (found[min(n - 1, int(a) + 1)] - found[int(a)]) * (a - int(a)) for a in at]
    seen: dict[tuple[float, float], list] = {}

    def read(lo: float, hi: float, inside: int) -> list:
        """What is between lo and hi: its values, or (least, greatest, count) of each interval."""
        if (lo, hi) not in seen:
            part = x.where(F.col("x").between(lo, hi))
            if inside <= few:
                seen[lo, hi] = sorted(r["x"] for r in part.collect())
            else:
                place = F.least(F.lit(4095), F.floor((F.col("x") - lo) * (4096 / (hi - lo))).cast("int"))
                seen[lo, hi] = sorted((r["a"], r["b"], r["n"]) for r in part.groupBy(place.alias("p")).agg(F.min("x").alias("a"), F.max("x").alias("b"), F.count(F.lit(1)).alias("n")).collect())
        return seen[lo, hi]

    out = []
    for rank in ranks:
        lo, hi, left, inside = least, most, rank, n
        while lo < hi and inside > few:
            for a, b, k in read(lo, hi, inside):
                if left < k:
                    lo, hi, inside = a, b, k
                    break
                left -= k
        out.append(lo if lo == hi else read(lo, hi, inside)[left])
    return out


def schema_key(workflow: Column, case_id: Column, candidates: Column) -> Column:
    """HX-1: what rows that ask the same have in common: workflow, question part of the case, options by id."""
    return F.struct(workflow.alias("workflow"), E.first_key(case_id).alias("question"), F.array_sort(F.transform(candidates, lambda c: F.struct(c["id"].alias("id"), c["text"].alias("text")))).alias("options"))


def decision_table(train: DataFrame, test: DataFrame, *, key: str = "workflow", sure: float = 0.9) -> DataFrame:
    """AG-10 on (key, ids, gold) and test rows with ids, target, gold, correct, conf too: the model against the most common label of train where
    every row of a key has the same options, else against a random pick among a row's options."""
    same = train.groupBy(key).agg((F.count_distinct(F.col("ids").cast("string")) == 1).alias("same"))
    votes = train.groupBy(key, "gold").agg(F.count(F.lit(1)).alias("n")).groupBy(key).agg(F.min_by("gold", F.struct((-F.col("n")).alias("n"), "gold")).alias("majority"))
    known = same.join(votes, key).select(F.col(key).alias("_k"), F.when(F.col("same"), F.col("majority")).alias("_majority"))
    rows = test.join(known, F.col(key).eqNullSafe(F.col("_k")), "left")
    pick = F.size(F.filter("target", lambda t: t > 0)) / F.size("target")
    base = F.when(F.col("_majority").isNotNull(), (F.col("gold") == F.col("_majority")).cast("double")).otherwise(pick)
    confident = F.col("conf") >= sure
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.avg("correct").alias("model"), F.avg(base).alias("baseline"), F.max("_majority").alias("majority"), F.count_if(confident).alias("sure_n"), F.count_if(confident & (F.col("correct") == 1)).alias("sure_ok"))


def option_collisions(df: DataFrame, tokens: str, limit: int) -> DataFrame:
    """AG-13: how many rows have two options alike in their first `limit` tokens; tokens is an array of arrays."""
    cut = F.transform(F.col(tokens), lambda t: F.slice(t, 1, limit))
    return df.agg(F.count(F.lit(1)).alias("items"), F.count_if(F.size(F.array_distinct(cut)) < F.size(cut)).alias("collisions"))


def training_loss(logits: Column, target: Column, answerability: Column | None = None, answerable: Column | None = None, weight: float = 0.25) -> dict[str, Column]:
    """SF-21, the value: mean soft cross entropy over answerable rows, and with answerability logits their binary cross entropy times a weight.

    Raises in the row whose target mass does not go with its label.
    """
    if not 0 <= weight < float("inf"):
        raise ValueError("answerability_weight must be nonnegative and finite")
    mass = E.total(target)
    active = F.lit(True) if answerable is None else answerable
    bad = F.exists(target, lambda t: t.isNull() | F.isnan(t) | (t < 0) | (t == float("inf"))) | (active & (mass <= 0)) | (~active & (mass != 0))
    ce = F.when(bad, F.raise_error(F.lit("target mass must match answerability labels")).cast("double")).when(active, E.soft_ce(E.softmax(logits), F.transform(target, lambda t: t / mass)))
    choice = F.coalesce(F.avg(ce), F.lit(0.0))
    support = F.lit(0.0)
    if answerability is not None:
        # log(1 + e^a) - y a, without overflow
        support = F.avg(F.greatest(answerability, F.lit(0.0)) + F.log1p(F.exp(-F.abs(answerability))) - F.when(active, answerability).otherwise(0.0))
    return {"loss": choice + weight * support, "choice_loss": choice, "answerability_loss": support}


def summarize(ledger: DataFrame) -> DataFrame:
    """AG-1 on (case_id, source_group, expected, raw_choice, choice, probabilities, latency_ms)."""
    p = F.col("probabilities")
    ok = (F.col("raw_choice") == F.col("expected")).cast("int")
    rows = ledger.select(
        "source_group",
        "choice",
        "expected",
        "latency_ms",
        ok.alias("correct"),
        F.element_at(p, F.col("raw_choice")).alias("conf"),
        (-F.ln(F.greatest(F.element_at(p, F.col("expected")), F.lit(1e-12)))).alias("nll"),
        F.aggregate(F.map_entries(p), F.lit(0.0), lambda a, e: a + F.pow(e["value"] - F.when(e["key"] == F.col("expected"), 1.0).otherwise(0.0), F.lit(2.0))).alias("brier"),
    )
    sums = rows.agg(
        F.count(F.lit(1)).alias("cases"),
        F.count_distinct("source_group").alias("source_groups"),
        F.avg("correct").alias("accuracy"),
        F.avg(F.col("choice").isNotNull().cast("int")).alias("coverage"),
        F.avg(F.when(F.col("choice").isNotNull(), (F.col("choice") == F.col("expected")).cast("int"))).alias("accepted_accuracy"),
        F.avg("nll").alias("nll"),
        F.avg("brier").alias("brier"),
        *(F.lit(v).cast("double").alias(f"latency_p{p}_ms") for p, v in zip((50, 95), order_statistics(ledger, "latency_ms", places=[0.50, 0.95]), strict=True)),
    )
    return sums.crossJoin(ece(rows, []).withColumnRenamed("ece", "ece_15_bins"))  # two single rows


def ledger_error(row: dict[str, Column]) -> Column:
    """EV-1: the first rule a ledger row breaks, or null."""
    p = row["probabilities"]
    values = F.map_values(p)
    total = E.total(values)
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    out = None
    for name in ("case_id", "source_group", "request_sha256", "expected", "raw_choice"):
        bad = row[name].isNull() | (F.trim(row[name]) == "")
        out = F.when(bad, f"invalid {name}") if out is None else out.when(bad, f"invalid {name}")
    return (
        out.when(~row["request_sha256"].rlike("^[0-9a-f]{64}$"), "request_sha256 must be a lowercase SHA256 digest")
        .when(p.isNull() | (F.size(p) < 2), "at least two candidate probabilities are required")
        .when(F.exists(F.map_keys(p), lambda k: F.trim(k) == ""), "candidate probability keys must be nonempty strings")
        .when(F.exists(values, lambda v: ~finite(v)), "invalid probability")
        .when(F.exists(values, lambda v: (v < 0) | (v > 1)), "probabilities must be in [0, 1]")
        .when(F.abs(total - 1) > 1e-3, "candidate probabilities must sum to one")
        .when(~F.map_contains_key(p, row["expected"]) | ~F.map_contains_key(p, row["raw_choice"]), "expected and raw_choice must be candidate ids")
        .when(F.try_element_at(p, row["raw_choice"]) / total < F.array_max(values) / total - 1e-3, "raw_choice is inconsistent with probabilities")
        .when(row["choice"].isNotNull() & (row["choice"] != row["raw_choice"]), "accepted choice must equal raw_choice")
        .when(~finite(row["latency_ms"]), "invalid latency_ms")
        .when(row["latency_ms"] < 0, "latency_ms cannot be negative")
    )


def renormed(p: Column) -> Column:
    return F.transform_values(p, lambda _, v: v / E.total(F.map_values(p)))


def paired(baseline: DataFrame, candidate: DataFrame) -> DataFrame:
    """JN-2: (case_id, source_group, delta, problem) of two ledgers; problem names what keeps them from comparison."""
    side = lambda df, s: df.select(F.col("case_id").alias(f"id_{s}"), *(F.col(c).alias(f"{c}_{s}") for c in ("source_group", "request_sha256", "expected", "raw_choice", "probabilities")))
    j = side(baseline, "a").join(side(candidate, "b"), F.col("id_a") == F.col("id_b"), "full_outer")
    problem = F.when(F.col("id_a").isNull() | F.col("id_b").isNull(), "both ledgers must contain exactly the same case ids")
    for c in ("source_group", "request_sha256", "expected"):
        problem = problem.when(~F.col(f"{c}_a").eqNullSafe(F.col(f"{c}_b")), f"incompatible {c}")
    keys = lambda s: F.array_sort(F.map_keys(f"probabilities_{s}"))
    problem = problem.when(~keys("a").eqNullSafe(keys("b")), "incompatible candidate ids")
    hit = lambda s: (F.col(f"raw_choice_{s}") == F.col(f"expected_{s}")).cast("int")
    return j.select(F.coalesce("id_a", "id_b").alias("case_id"), F.col("source_group_a").alias("source_group"), (hit("b") - hit("a")).alias("delta"), problem.alias("problem"))


def bootstrap(pairs: DataFrame, samples: int = 2000, seed: int = 17) -> DataFrame:
    """AG-17: 95 % interval of the mean delta over draws of whole groups; null with fewer than two groups.

    Groups are summed first. Each draw gives each group a Poisson(1) weight from a hash, so draws need no list of groups in one place.
    """
    if not 100 <= samples <= 100_000:
        raise ValueError("samples must be between 100 and 100000")
    groups = pairs.groupBy("source_group").agg(F.sum("delta").alias("d"), F.count(F.lit(1)).alias("n"))
    draws = groups.select("source_group", "d", "n", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))).alias("s"))
    u = E.hash01(F.concat_ws("|", F.lit(str(seed)), "s", "source_group"))
    cdf, term, weight = 0.0, 2.718281828459045**-1, F.lit(0)
    for k in range(8):
        cdf += term
        weight = weight + (u > F.lit(cdf)).cast("int")
        term /= k + 1
    means = draws.withColumn("w", weight).groupBy("s").agg((F.sum(F.col("w") * F.col("d")) / F.nullif(F.sum(F.col("w") * F.col("n")), F.lit(0))).alias("m"))
    whole = groups.agg((F.sum("d") / F.sum("n")).alias("accuracy_delta"), F.count(F.lit(1)).alias("groups"))
    ends = means.agg(F.percentile("m", F.lit(0.025)).alias("low"), F.percentile("m", F.lit(0.975)).alias("high"))
    some = F.col("groups") >= 2
    return whole.crossJoin(ends).select("accuracy_delta", F.when(some, F.col("low")).alias("low"), F.when(some, F.col("high")).alias("high"))


def prior_controls(train: DataFrame, development: DataFrame) -> DataFrame:
    """AG-12 on (case_id, workflow, schema_key, ids, target): what training priors alone would score, by all and workflow."""
    options = lambda df: df.select("case_id", "workflow", "schema_key", E.gold_label(F.col("ids"), F.col("target")).alias("gold"), F.size("ids").alias("n"), F.explode(F.arrays_zip("ids", "target")).alias("o")).select("case_id", "workflow", "schema_key", "gold", "n", F.col("o.ids").alias("id"), F.col("o.target").alias("t"))
    prior = options(train).groupBy("schema_key", "id").agg(F.sum((F.col("id") == F.col("gold")).cast("int")).alias("votes"), F.sum("t").alias("mass"), F.count(F.lit(1)).alias("rows"))
    dev = options(development).join(prior, ["schema_key", "id"], "left")
    seen = F.col("rows").isNotNull()
    q = F.when(seen, F.col("mass") / F.col("rows")).otherwise(1.0 / F.col("n"))
    case = dev.withColumn("q", q).groupBy("case_id", "workflow", "gold", "n").agg(
        F.min(F.struct((-F.col("votes")).alias("v"), "id")).alias("hard"),
        F.min(F.struct((-F.round("mass", 9)).alias("m"), "id")).alias("soft"),
        F.max(seen.cast("int")).alias("seen"),
        (-F.sum(F.when(F.col("t") > 0, F.col("t") * F.ln("t")).otherwise(0.0))).alias("teacher_entropy"),
        (-F.sum(F.col("t") * F.ln(F.greatest("q", F.lit(1e-12))))).alias("soft_prior_ce"),
        F.sum((F.col("t") - F.col("q")) * (F.col("t") - F.col("q"))).alias("soft_prior_brier"),
    )
    even = 1.0 / F.col("n")
    hit = lambda c: F.when(F.col("seen") == 1, (F.col(f"{c}.id") == F.col("gold")).cast("double")).otherwise(even)
    rows = case.select(F.explode(F.array(F.lit("all"), F.col("workflow"))).alias("key"), hit("hard").alias("hard"), hit("soft").alias("soft"), even.alias("even"), "teacher_entropy", "soft_prior_ce", "soft_prior_brier")
    return rows.groupBy("key").agg(
        F.count(F.lit(1)).alias("decisions"),
        F.avg("hard").alias("hard_majority_accuracy"),
        F.avg("soft").alias("soft_prior_accuracy"),
        F.avg("even").alias("random_choice_expected_accuracy"),
        *(F.avg(c).alias(c) for c in ("teacher_entropy", "soft_prior_ce", "soft_prior_brier")),
    )
