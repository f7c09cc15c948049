"""Column builders: hashes and splits, URLs and text, distributions over options, answers and policies. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as K

Num = Column | float

# ---------------------------------------------------------------- hashes, splits, order


def hash32(text: Column) -> Column:
    """The first 32 bits of the text's sha256, as a bigint."""
    return F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("bigint")


def hash01(text: Column) -> Column:
    """A point in [0, 1] from the text's hash."""
    return hash32(text).cast("double") / F.lit(4294967295.0)


def split_of(group: Column, seed: int | str) -> Column:
    """The split of a whole group (SF-30): its salted hash against the cumulated shares."""
    point = hash01(F.concat(F.lit(f"{seed}:"), F.coalesce(group, F.lit(""))))
    total, out = 0.0, None
    for name, share in K.SPLIT_SHARES:
        total += share
        out = F.when(point <= total, name) if out is None else out.when(point <= total, name)
    return out.otherwise("test")


def keep_by_hash(url: Column, share: float, always: Column) -> Column:
    """Hash sampling that keeps some rows always (PF-6)."""
    return always | (hash01(url) < F.lit(float(share)))


def stable_key(seed: int | str, *keys: Column) -> list[Column]:
    """What a seeded shuffle orders by: a salted hash, then the keys for ties. No machine or partition changes it."""
    return [F.sha2(F.concat_ws("|", F.lit(str(seed)), *(k.cast("string") for k in keys)).cast("binary"), 256), *keys]


# ---------------------------------------------------------------- text and URLs


def host_of(url: Column) -> Column:
    """Host name, lower-cased, without port, user or one leading www. (PF-1); '' where there is none."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.regexp_replace(F.lower(host), r"^www\.", "")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)


def query_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^[^?#]*\?([^#]*)", 1)


def squeeze(text: Column) -> Column:
    """Runs of white space, Unicode's included, as one space, none at the ends (SF-31)."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def decision_of(case_id: Column) -> Column:
    """What follows the last :: (PF-7)."""
    return F.element_at(F.split(case_id, "::"), -1)


def url_of_case(case_id: Column) -> Column:
    """What stands before the last :: (PF-8)."""
    return F.regexp_replace(case_id, r"(?s)::(?!.*::).*$", "")


def first_key(case_id: Column) -> Column:
    """What follows the first :: (diagnostics split from the left)."""
    return F.regexp_replace(case_id, r"(?s)^.*?::", "")


# ---------------------------------------------------------------- distributions over options


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def softmax(logits: Column, temperature: Num = 1.0) -> Column:
    """Stable softmax at a temperature (SF-1)."""
    t = temperature if isinstance(temperature, Column) else F.lit(float(temperature))
    e = F.transform(logits, lambda x: F.exp((x - F.array_max(logits)) / t))
    return F.transform(e, lambda x: x / total(e))


def argmax(values: Column) -> Column:
    """1-based place of the greatest value, the first among equals."""
    return F.array_position(values, F.array_max(values)).cast("int")


def gold_label(ids: Column, target: Column) -> Column:
    """PF-9."""
    return F.element_at(ids, argmax(target))


def gold_set(ids: Column, target: Column) -> Column:
    """PF-10: all options with a share of the target."""
    return F.transform(F.filter(F.arrays_zip(ids.alias("i"), target.alias("t")), lambda x: x["t"] > 0), lambda x: x["i"])


def soft_ce(p: Column, target: Column) -> Column:
    """Cross entropy of a soft target (SF-3)."""
    return -total(F.zip_with(target, p, lambda t, q: t * F.ln(F.greatest(q, F.lit(1e-12)))))


def brier(p: Column, target: Column) -> Column:
    return total(F.zip_with(p, target, lambda a, b: (a - b) * (a - b)))


def one_hot(size: Column, place: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), size), lambda i: F.when(i == place, 1.0).otherwise(0.0))


def concentration(p: Column) -> Column:
    """SF-2: 0 for even options, 1 for certainty."""
    return (F.size(p) * F.array_max(p) - 1) / (F.size(p) - 1)


def expected_level(p: Column) -> Column:
    """SF-10."""
    return total(F.transform(p, lambda x, i: x * i))


def entropy(p: Column) -> Column:
    return -total(F.transform(p, lambda x: F.when(x > 0, x * F.ln(x)).otherwise(0.0)))


def ranked(p: Column, ids: Column) -> Column:
    """Options by falling probability, then id (WN-8): array of (id, p)."""
    return F.array_sort(
        F.transform(F.arrays_zip(ids.alias("i"), p.alias("p")), lambda x: F.struct(x["i"].alias("id"), x["p"].alias("p"))),
        lambda a, b: F.when(a["p"] > b["p"], -1).when(a["p"] < b["p"], 1).when(a["id"] < b["id"], -1).when(a["id"] > b["id"], 1).otherwise(0),
    )


def sharpen(target: Column, power: float) -> Column:
    """SF-20: t**power, normed."""
    x = F.transform(target, lambda t: F.pow(t, F.lit(float(power))))
    return F.transform(x, lambda t: t / total(x))


def symmetric_kl(p: Column, q: Column) -> Column:
    """SF-16."""
    floor = lambda x: F.greatest(x, F.lit(1e-8))
    return total(F.zip_with(p, q, lambda a, b: (floor(a) - floor(b)) * (F.ln(floor(a)) - F.ln(floor(b))))) * 0.5


def distillation_kl(student: Column, teacher: Column, temperature: float = 2.0) -> Column:
    """SF-17: KL of the teacher from the student at a temperature, times its square."""
    return total(F.zip_with(softmax(teacher, temperature), softmax(student, temperature), lambda q, s: q * (F.ln(q) - F.ln(s)))) * temperature**2


def ranked_probability_score(p: Column, target: Column) -> Column:
    """WN-9: squared distance of the running sums, over levels less one. Options stand in the levels' order."""
    start = F.struct(F.lit(0.0).alias("d"), F.lit(0.0).alias("s"))
    diff = F.zip_with(p, target, lambda a, b: a - b)
    return F.aggregate(diff, start, lambda a, x: F.struct((a["d"] + x).alias("d"), (a["s"] + (a["d"] + x) * (a["d"] + x)).alias("s")), lambda a: a["s"]) / F.greatest(F.size(p) - 1, F.lit(1))


def row_weight(value: Column, floor: float = 0.1) -> Column:
    """SF-15."""
    return F.when(value.isNull() | F.isnan(value) | (F.abs(value) == float("inf")), 1.0).otherwise(F.greatest(F.lit(floor), value))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: total(F.zip_with(x, y, lambda u, v: u.cast("double") * v.cast("double")))
    return dot(a, b) / F.greatest(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(1e-8))


def lr_factor(step: Column, steps: int, warmup_ratio: float, schedule: str) -> Column:
    """SF-19: linear warm-up, then constant, linear or cosine."""
    if schedule not in ("constant", "linear", "cosine"):
        raise ValueError("schedule must be constant, linear or cosine")
    warmup = int(steps * warmup_ratio)
    progress = F.least(F.lit(1.0), (step - warmup) / F.lit(float(max(1, steps - warmup))))
    after = {"constant": F.lit(1.0), "linear": 1.0 - progress, "cosine": (F.cos(progress * F.pi()) + 1.0) * 0.5}[schedule]
    return F.when(step < warmup, (step + 1) / F.lit(float(warmup))).otherwise(after) if warmup else after


# ---------------------------------------------------------------- option orders


def option_orders(count: Column, orders: int) -> Column:
    """SF-11: offsets of `orders` even rotations of the options, each once."""
    m = F.least(count, F.lit(orders))
    return F.array_distinct(F.transform(F.sequence(F.lit(0), m - 1), lambda i: F.floor(i * count / m).cast("int")))


def rotate(options: Column, offset: Column) -> Column:
    """SF-12: the options from `offset` on, then those before."""
    return F.concat(F.slice(options, offset + 1, F.size(options)), F.slice(options, F.lit(1), offset))


def unrotate(values: Column, offset: Column) -> Column:
    return rotate(values, (F.size(values) - offset) % F.size(values))


# ---------------------------------------------------------------- answers and policy


def answer(kind: Column, ids: Column, texts: Column, p: Column, abstain_below: float | None = None) -> Column:
    """SF-9: one wide struct for the three types; what a type does not have is null. Rounded to four places."""
    r = lambda x: F.round(x, 4)
    top = F.array_max(p)
    p_true = F.element_at(p, F.array_position(ids, "true").cast("int"))
    noul = kind == "noul"
    fields = {
        "type": kind,
        "choice": F.when(kind == "choice", F.element_at(ids, argmax(p))),
        "score": F.when(kind == "score", r(expected_level(p))),
        "noul": F.when(noul, r(p_true)),
        "legend": F.when(kind == "score", F.map_from_arrays(ids, texts)),
        "probabilities": F.when(~noul, F.map_from_arrays(ids, F.transform(p, r))),
        "confidence": F.when(noul, r(F.greatest(p_true, 1 - p_true))).otherwise(r(concentration(p))),
    }
    if abstain_below is not None:
        fields["abstain"] = top < abstain_below
    return F.struct(*(v.alias(k) for k, v in fields.items()))


def decide(ids: Column, logits: Column, *, trained: Column | bool = False, temperature: float = 1.0, answerability: Column | None = None, min_probability: float = 0.70, min_margin: float = 0.05, min_answerability: float = 0.50, tie_tolerance: float = 1e-7) -> Column:
    """SF-7: the selection policy. Reasons in order: untrained_model, ambiguous_tie, no_supported_candidate, low_probability, small_margin."""
    for name, v in (("min_probability", min_probability), ("min_margin", min_margin), ("min_answerability", min_answerability), ("tie_tolerance", tie_tolerance)):
        if not 0 <= v <= 1:
            raise ValueError(f"{name} must be between zero and one")
    if not temperature > 0:
        raise ValueError("temperature must be positive")
    p = softmax(logits, temperature)
    order = ranked(p, ids)
    top, margin = order[0]["p"], order[0]["p"] - order[1]["p"]
    ok = trained if isinstance(trained, Column) else F.lit(trained)
    reason = F.when(~ok, "untrained_model").when(margin <= tie_tolerance, "ambiguous_tie")
    if answerability is not None:
        reason = reason.when(answerability < min_answerability, "no_supported_candidate")
    reason = reason.when(top < min_probability, "low_probability").when(margin < min_margin, "small_margin")
    return F.struct(
        F.when(reason.isNull(), order[0]["id"]).alias("choice"),
        order[0]["id"].alias("raw_choice"),
        reason.isNotNull().alias("abstain"),
        reason.alias("reason"),
        F.map_from_arrays(ids, p).alias("probabilities"),
        top.alias("top_probability"),
        margin.alias("margin"),
        (entropy(p) / F.ln(F.size(p))).alias("normalized_entropy"),
        (answerability if answerability is not None else F.lit(None).cast("double")).alias("answerability"),
    )
