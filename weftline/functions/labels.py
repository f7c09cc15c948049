"""Weak labels from several sources, as Catalyst expressions; and their Python parts that need match spans or nested JSON."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as K
from . import exprs as E

# ---------------------------------------------------------------- votes


def schema_vote(types: Column) -> Column:
    """The first page type that one of the schema.org types speaks for (LB-2)."""
    out = None
    for label, names in K.SCHEMA_PAGE_TYPES:
        hit = F.arrays_overlap(types, F.array(*map(F.lit, names)))
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out


def og_vote(og_type: Column) -> Column:
    """The page types an og:type goes with."""
    out = None
    for kind, labels in K.OG_TYPES.items():
        hit = F.lower(og_type) == kind
        value = F.array(*map(F.lit, labels))
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out


def url_vote(url: Column) -> Column:
    """home, or the first hint in the URL."""
    out = F.when(E.path_of(url).isin("", "/") & (E.query_of(url) == ""), "home")
    for label, pattern in K.URL_HINTS:
        out = out.when(url.rlike(f"(?i){pattern}"), label)
    return out


def resolve_votes(schema: Column, og: Column, url: Column) -> Column:
    """(label, quality) of the votes: agreed, single, conflict or none (LB-3)."""
    home = url == "home"
    at_odds = F.lit(False)
    for hint, labels in K.URL_CONFLICTS.items():
        at_odds = at_odds | ((url == hint) & schema.isin(labels))
    free = ~url.isin(*K.URL_CONFLICTS)
    at_odds = at_odds | (free & (url != schema))
    quality = (
        F.when(home & schema.isNotNull() & ~schema.isin(K.HOME_COMPATIBLE), "conflict")
        .when(home, F.when(schema.isNotNull(), "agreed").otherwise("single"))
        .when(schema.isNull(), "none")
        .when(og.isNotNull() & ~F.array_contains(og, schema), "conflict")
        .when(url.isNotNull() & at_odds, "conflict")
        .when(og.isNotNull() | F.coalesce(url == schema, F.lit(False)), "agreed")
        .otherwise("single")
    )
    label = F.when(quality.isin("agreed", "single"), F.when(home, "home").otherwise(schema))
    return F.struct(label.alias("label"), quality.alias("quality"))


def _map(table: dict) -> Column:
    return F.create_map(*(F.lit(x) for pair in table.items() for x in pair))


def language_label(declared: Column, detected_iso3: Column) -> Column:
    """The declared language, where the detector agrees (LB-4)."""
    code = F.split(F.replace(F.lower(declared), F.lit("_"), F.lit("-")), "-")[0]
    return F.when(code.isin(*K.LANGUAGE_NAMES) & (F.try_element_at(_map(K.ISO3), detected_iso3) == code), code)


def status_label(status: Column) -> Column:
    """LB-7."""
    return F.try_element_at(_map(K.HTTP_STATUS), status.cast("int"))


def published_date(jsonld: Column, meta_time: Column) -> Column:
    """(date, source): the first block with a datePublished, else the article's meta time (LB-5). The date is text, checked by nobody."""
    found = F.filter(F.transform(jsonld, lambda x: F.regexp_extract(x, r'"datePublished"\s*:\s*"(\d{4}-\d{2}-\d{2})', 1)), lambda x: x != "")
    own = F.try_element_at(found, F.lit(1))
    meta = F.nullif(F.regexp_extract(F.coalesce(meta_time, F.lit("")), r"^(\d{4}-\d{2}-\d{2})", 1), F.lit(""))
    return F.struct(
        F.coalesce(own, meta).alias("date"),
        F.when(own.isNotNull(), "schema.org datePublished").when(meta.isNotNull(), "meta article:published_time").alias("source"),
    )


# ---------------------------------------------------------------- money and stock


def _plain_number(raw: Column) -> Column:
    comma, dot = F.instr(F.reverse(raw), ","), F.instr(F.reverse(raw), ".")  # from the end, 0: none
    no = lambda mark: F.replace(raw, F.lit(mark), F.lit(""))
    tail = F.substring_index(raw, ",", -1)
    only_comma = F.concat(F.replace(F.regexp_replace(raw, ",[^,]*$", ""), F.lit(","), F.lit("")), F.when(F.length(tail) <= 2, F.concat(F.lit("."), tail)).otherwise(tail))
    dots = F.length(raw) - F.length(no("."))
    plain = (
        F.when((comma > 0) & (dot > 0), F.when(comma < dot, F.replace(no("."), F.lit(","), F.lit("."))).otherwise(no(",")))
        .when(comma > 0, only_comma)
        .when((dots > 1) | ((dots == 1) & (F.length(F.substring_index(raw, ".", -1)) == 3)), no("."))
        .otherwise(raw)
    )
    return F.when(raw != "", plain.try_cast("double"))


def parse_amount(text: Column) -> Column:
    """The first number of a text, under either decimal mark (LB-12); null without one."""
    raw = F.regexp_replace(F.regexp_extract(text, f"({K.NUMBER})", 1), r"[\s\x{00a0}]", "")
    return F.transform(F.array(raw), _plain_number)[0]  # a lambda's variable, so that the match is taken once


def price_values(text: Column) -> Column:
    """All amounts with a currency in a text, each once, in order (LB-15 without contexts)."""
    found = F.regexp_extract_all(text, F.lit(f"({K.CURRENCY}\\s?(?:{K.NUMBER})|(?:{K.NUMBER})\\s?{K.CURRENCY})"), F.lit(1))
    return F.transform(F.array_distinct(found), parse_amount)


def stock(availabilities: Column) -> Column:
    """LB-14: true or false if all states agree, else null."""
    short = lambda x: F.substring_index(F.substring_index(F.regexp_replace(x, "/+$", ""), "/", -1), ":", -1)
    seen = F.array_distinct(F.transform(F.filter(availabilities, lambda x: x.isNotNull() & (x != "")), short))
    within = lambda names: F.size(F.array_except(seen, F.array(*map(F.lit, names)))) == 0
    return F.when(F.size(seen) == 0, F.lit(None).cast("boolean")).when(within(K.IN_STOCK), True).when(within(K.OUT_OF_STOCK), False)


def v0_page_type(node_types: Column) -> Column:
    """LB-10: node_types is an array of each node's types."""
    flat = F.flatten(node_types)
    products = F.size(F.filter(node_types, lambda t: F.array_contains(t, "Product") | F.array_contains(t, "ProductGroup")))
    has = lambda names: F.arrays_overlap(flat, F.array(*map(F.lit, names)))
    return F.when(F.size(flat) == 0, None).when(has(K.V0_LISTING) | (products >= 3), "listing").when(products > 0, "product").when(has(K.V0_ARTICLE), "article").otherwise("other")


# ---------------------------------------------------------------- within a parsed page (Python: nested JSON and match spans)


def _loads(text: str):
    try:
        return json.loads(text)
    except (ValueError, RecursionError):
        return None


def _each(value) -> list:
    return value if isinstance(value, list) else [value]


def schema_types(jsonld: list[str]) -> list[str]:
    """LB-1: type names in lists and below @graph, mainEntity and mainEntityOfPage, sorted."""
    names, todo = set(), [_loads(x.strip()) for x in jsonld]
    while todo:
        node = todo.pop()
        if isinstance(node, list):
            todo += node
        elif isinstance(node, dict):
            names |= {k.split("/")[-1] for k in _each(node.get("@type")) if isinstance(k, str)}
            todo += [node[k] for k in ("@graph", "mainEntity", "mainEntityOfPage") if k in node]
    return sorted(names)


def schema_nodes(jsonld: list[str]) -> list[dict]:
    """LB-8: every object at any depth but below @context, parents first."""
    out: list[dict] = []

    def visit(value) -> None:
        if isinstance(value, dict):
            out.append(value)
            value = [v for k, v in value.items() if k != "@context"]
        if isinstance(value, list):
            for v in value:
                visit(v)

    for block in jsonld:
        try:
            visit(_loads(block.strip().rstrip(";")))
        except RecursionError:
            continue
    return out


def node_types(node: dict) -> list[str]:
    """LB-9."""
    return sorted({k.split("/")[-1].split(":")[-1] for k in _each(node.get("@type")) if isinstance(k, str) and k})


_NUMBER = re.compile(K.NUMBER)
_PRICE = re.compile(f"(?:{K.CURRENCY}\\s?(?:{K.NUMBER})|(?:{K.NUMBER})\\s?{K.CURRENCY})")
_DATES = [(re.compile(p), readings) for p, readings in K.DATE_PATTERNS]


def amount(value) -> float | None:
    """parse_amount for one value."""
    m = _NUMBER.search(str(value))
    if m is None:
        return None
    digits = re.sub(r"[\s ]", "", m.group())
    last = max(digits.rfind(","), digits.rfind("."))
    marks = {c for c in digits if c in ",."}
    after = len(digits) - last - 1
    if len(marks) == 2:
        decimal = True
    elif marks == {","}:
        decimal = after <= 2
    else:
        decimal = digits.count(".") == 1 and after != 3
    whole = re.sub(r"[.,]", "", digits[:last] if marks and decimal else digits)
    return float(f"{whole}.{digits[last + 1 :]}") if marks and decimal else float(whole)


def offers(nodes: list[dict]) -> list[dict]:
    """LB-11."""
    return [o for n in nodes if "Product" in node_types(n) for o in _each(n.get("offers")) if isinstance(o, dict)]


def offer_price(nodes: list[dict]) -> float | None:
    """LB-13: the first positive amount of price, lowPrice or priceSpecification, offer by offer."""
    for o in offers(nodes):
        given = [o.get("price"), o.get("lowPrice"), *(s.get("price") for s in _each(o.get("priceSpecification")) if isinstance(s, dict))]
        for v in given:
            if v not in (None, "") and (x := amount(v)) and x > 0:
                return x
    return None


def availabilities(nodes: list[dict]) -> list[str]:
    return [a for o in offers(nodes) if isinstance(a := o.get("availability"), str) and a]


def _snippet(text: str, m: re.Match, before: int, after: int) -> str:
    a, b = m.span()
    return " ".join(f"{text[max(0, a - before) : a]}[{m.group()}]{text[b : b + after]}".split())


def _within_word(text: str, m: re.Match) -> bool:
    """Whether a letter or digit goes on before or after the match: 7BRL in a key like K7BRLX."""
    a, b = m.span()
    return any(x.isalnum() and y.isalnum() for x, y in (text[max(0, a - 1) : a + 1].ljust(2), text[b - 1 : b + 1].ljust(2)))


def price_candidates(blocks: list[str], whole_words: bool = False) -> list[dict]:
    """LB-15: each distinct price with its context, in page order; with `whole_words` none that is a part of a word, which the reference takes too."""
    out = {}
    for b in blocks:
        for m in _PRICE.finditer(b):
            if whole_words and _within_word(b, m):
                continue
            out.setdefault(_snippet(b, m, 40, 20), amount(m.group()))
    return [{"text": t, "value": v} for t, v in out.items()]


def date_candidates(texts: list[str]) -> list[dict]:
    """LB-6: each distinct date with its context and its readings as yyyy-mm-dd, in page order."""
    out: dict[str, list[str]] = {}
    for t in texts:
        for pattern, readings in _DATES:
            for m in pattern.finditer(t):
                key = _snippet(t, m, 30, 15)
                if key in out:
                    continue
                dates = []
                for groups in readings:
                    y, mo, d = (g if g.isdigit() else K.MONTH_NUMBERS.get(g.lower(), 0) for g in map(m.group, groups))
                    if 1 <= int(mo) <= 12 and 1 <= int(d) <= 31:
                        dates.append(f"{int(y):04d}-{int(mo):02d}-{int(d):02d}")
                out[key] = dates
    return [{"text": t, "dates": d} for t, d in out.items()]


def date_values(text: Column) -> Column:
    """All readings of all dates in a text as yyyy-mm-dd, sorted, each once (LB-6 without contexts)."""
    month = _map({k: str(v) for k, v in K.MONTH_NUMBERS.items()})
    two = lambda x: F.lpad(x, 2, "0")

    def groups(pattern: str):
        return lambda m: F.struct(*(F.regexp_extract(m, pattern, g).alias(f"g{g}") for g in (1, 2, 3)))

    def reading(y: int, m: int, d: int):
        def one(x: Column) -> Column:
            mo = F.coalesce(F.when(x[f"g{m}"].rlike("^[0-9]+$"), x[f"g{m}"]), F.try_element_at(month, F.lower(x[f"g{m}"])))
            fine = mo.try_cast("int").between(1, 12) & x[f"g{d}"].try_cast("int").between(1, 31)
            return F.when(fine, F.concat_ws("-", x[f"g{y}"], two(mo), two(x[f"g{d}"])))

        return one

    # what a text must hold for a pattern to match at all: most texts are spared most searches
    has = lambda *marks: F.greatest(*(F.contains(text, F.lit(m)) for m in marks)) if len(marks) > 1 else F.contains(text, F.lit(marks[0]))
    year = has("19", "20")
    needs = [year & has("-"), year & has(".", "/"), year, year, has("年")]
    found = []
    for (pattern, readings), need in zip(K.DATE_PATTERNS, needs, strict=True):
        whole = F.when(need, F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))).otherwise(F.array().cast("array<string>"))
        parts = F.transform(whole, groups(pattern))
        found += [F.transform(parts, reading(*r)) for r in readings]
    return F.array_sort(F.array_distinct(F.filter(F.concat(*found), lambda x: x.isNotNull())))
