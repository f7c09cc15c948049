"""Pages to page states and labelled decision rows, two generations."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrow
from ..functions import constants as K
from ..functions import exprs as E
from ..functions import html as H
from ..functions import labels as L

OPTION = "struct<id:string,text:string>"
ROW = f"struct<decision:string,question:string,question_type:string,candidates:array<{OPTION}>,gold:array<string>,label_source:string,label_quality:string>"


def _passed(df: DataFrame) -> tuple[list[str], str]:
    keep = [c for c in df.columns if c != "html"]
    return keep, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name != "html")


TEXT, TEXTS = pa.string(), pa.list_(pa.string())
V1 = {"title": TEXT, "page": TEXT, "n_lines": pa.int32(), "html_lang": TEXT, "jsonld": TEXTS, "og_type": TEXT, "published_meta": TEXT, "types": TEXTS, "dates": pa.list_(pa.struct({"text": TEXT, "dates": TEXTS}))}
V0 = {"title": TEXT, "text": TEXT, "link_count": pa.int32(), "node_types": pa.list_(TEXTS), "price": pa.float64(), "availabilities": TEXTS, "prices": pa.list_(pa.struct({"text": TEXT, "value": pa.float64()}))}


def parse_v1(pages: DataFrame) -> DataFrame:
    """Adds title, page, html_lang, jsonld, meta, types, dates to pages(url, html, ...) and leaves html behind; each page is read once."""
    keep, fields = _passed(pages)

    def made(b: pa.RecordBatch) -> list[list]:
        rows = [H.read_page(h or "") for h in b.column("html").to_pylist()]
        return [
            [H.squeeze(p.title)[:300] for p in rows],
            [H.outline(p) for p in rows],
            [len(p.lines) for p in rows],
            [p.html_lang for p in rows],
            [p.jsonld for p in rows],
            [p.meta.get("og:type") for p in rows],
            [p.meta.get("article:published_time") for p in rows],
            [L.schema_types(p.jsonld) for p in rows],
            [L.date_candidates([x.text for x in p.lines if x.info is None]) for p in rows],
        ]

    return pages.mapInArrow(arrow.added(keep, V1, made), f"{fields}, title string, page string, n_lines int, html_lang string, jsonld array<string>, og_type string, published_meta string, types array<string>, dates array<struct<text:string,dates:array<string>>>")


def parse_v0(pages: DataFrame, whole_words: bool = False) -> DataFrame:
    """Adds title, text, link_count, node_types, price, availabilities, prices to pages(url, html, ...); with `whole_words` no prices within words."""
    keep, fields = _passed(pages)

    def made(b: pa.RecordBatch) -> list[list]:
        rows = [H.read_text_page(h or "") for h in b.column("html").to_pylist()]
        nodes = [L.schema_nodes(p.jsonld) for p in rows]
        return [
            [H.squeeze(p.title)[:300] for p in rows],
            [H.visible_text(p.blocks) for p in rows],
            [p.links for p in rows],
            [[L.node_types(n) for n in x] for x in nodes],
            [L.offer_price(x) for x in nodes],
            [L.availabilities(x) for x in nodes],
            [L.price_candidates(p.blocks, whole_words) for p in rows],
        ]

    return pages.mapInArrow(arrow.added(keep, V0, made), f"{fields}, title string, text string, link_count int, node_types array<array<string>>, price double, availabilities array<string>, prices array<struct<text:string,value:double>>")


def options_of(table: dict[str, str]) -> Column:
    return F.array(*(F.struct(F.lit(k).alias("id"), F.lit(v).alias("text")) for k, v in table.items()))


def _by_hash(array: Column, salt: Column, text: str = "text") -> Column:
    """The array in a seeded order that depends on nothing else."""
    keyed = F.array_sort(F.transform(array, lambda x: F.struct(F.sha2(F.concat_ws("|", salt, x[text]).cast("binary"), 256).alias("k"), x.alias("x"))), lambda a, b: F.when(a["k"] < b["k"], -1).when(a["k"] > b["k"], 1).otherwise(0))
    return F.transform(keyed, lambda x: x["x"])


def _row(when: Column, decision: str, question: str, candidates: Column, gold: Column, source: Column, quality: Column | str | None, kind: str | None = None) -> Column:
    values = {
        "decision": F.lit(decision),
        "question": F.lit(question),
        "question_type": F.lit(kind).cast("string"),
        "candidates": candidates,
        "gold": gold,
        "label_source": source,
        "label_quality": quality if isinstance(quality, Column) else F.lit(quality).cast("string"),
    }
    return F.when(when, F.struct(*(v.alias(k) for k, v in values.items())).cast(ROW))


def _rows(parsed: DataFrame, state: Column, rows: list[Column], keep: tuple[str, ...] = ()) -> DataFrame:
    """One row for each decision that is not null, with the target shared evenly by the gold options, and the page's columns to keep."""
    out = parsed.select(*keep, "url", F.coalesce(E.host_of(F.col("url")), F.lit("")).alias("source_group"), state.alias("state"), F.explode(F.filter(F.array(*rows), lambda r: r.isNotNull())).alias("r"))
    share = F.lit(1.0) / F.size("r.gold")
    return out.select(
        F.concat("url", F.lit("::"), "r.decision").alias("case_id"),
        "url",
        "r.decision",
        "source_group",
        F.lit("web").alias("workflow"),
        "state",
        "r.question",
        "r.question_type",
        "r.candidates",
        F.transform("r.candidates", lambda c: F.when(F.array_contains(F.col("r.gold"), c["id"]), share).otherwise(0.0)).alias("target"),
        "r.label_source",
        "r.label_quality",
        *keep,
    )


def labels_v1(parsed: DataFrame, min_chars: int = 200) -> DataFrame:
    """Adds the label columns to parsed pages(url, http_status, detected_language, ...): votes, their outcome, and why rows are dropped."""
    votes = F.struct(L.og_vote(F.coalesce("og_type", F.lit(""))).alias("og:type"), L.schema_vote(F.col("types")).alias("schema.org"), L.url_vote(F.col("url")).alias("url"))
    df = parsed.withColumn("votes", votes)
    df = df.withColumn("resolved", L.resolve_votes(F.col("votes")["schema.org"], F.col("votes")["og:type"], F.col("votes")["url"]))
    df = df.withColumn("language", L.language_label(F.col("html_lang"), F.col("detected_language"))).withColumn("published", L.published_date(F.col("jsonld"), F.col("published_meta")))
    fine = (F.length("page") >= min_chars) & (F.col("http_status") == 200)
    return df.withColumns(
        {
            "too_little_text": F.length("page") < min_chars,
            "page_type_conflict": fine & (F.col("resolved.quality") == "conflict"),
            "language_disagreement": fine & F.col("language").isNull() & (F.coalesce("html_lang", F.lit("")) != "") & (F.coalesce("detected_language", F.lit("")) != ""),
        }
    )


def page_rows_v1(pages: DataFrame, min_chars: int = 200, keep: tuple[str, ...] = ()) -> DataFrame:
    """LB-17: at most four labelled decisions of each page(url, html, http_status, detected_language)."""
    return parsed_rows_v1(parse_v1(pages), min_chars, keep)


def parsed_rows_v1(parsed: DataFrame, min_chars: int = 200, keep: tuple[str, ...] = ()) -> DataFrame:
    """The same of pages that were parsed already."""
    df = labels_v1(parsed, min_chars).where(~F.col("too_little_text"))
    url = F.col("url")
    ok, votes, label = F.col("http_status") == 200, F.col("votes"), F.col("resolved.label")
    status = L.status_label(F.col("http_status"))
    others = F.slice(_by_hash(F.filter(options_of(K.LANGUAGE_NAMES), lambda x: x["id"] != F.col("language")), url, "id"), 1, 4)
    own = F.filter(options_of(K.LANGUAGE_NAMES), lambda x: x["id"] == F.col("language"))
    date = F.col("published.date")
    shown = _by_hash(F.slice("dates", 1, 8), url)
    options = F.transform(shown, lambda x, i: F.struct(F.concat(F.lit("d"), i.cast("string")).alias("id"), x["text"].alias("text")))
    right = F.filter(F.transform(shown, lambda x, i: F.when(F.array_contains(x["dates"], date), F.concat(F.lit("d"), i.cast("string")))), lambda x: x.isNotNull())
    rows = [
        _row(~ok & status.isNotNull(), "page_status", K.QUESTIONS["page_status"], options_of(K.PAGE_STATUS), F.array(status), F.to_json(F.struct(F.col("http_status").alias("http_status"))), "single"),
        _row(ok & label.isNotNull(), "page_type", K.QUESTIONS["page_type"], options_of(K.PAGE_TYPES), F.array(label), F.to_json(votes), F.col("resolved.quality")),
        _row(ok & label.isNotNull() & votes["schema.org"].isNotNull(), "page_status", K.QUESTIONS["page_status"], options_of(K.PAGE_STATUS), F.array(F.lit("ok")), F.to_json(F.struct(F.col("http_status").alias("http_status"), votes["schema.org"].alias("schema.org"))), "agreed"),
        _row(ok & F.col("language").isNotNull(), "language", K.QUESTIONS["language"], _by_hash(F.concat(own, others), F.concat(url, F.lit("#")), "id"), F.array("language"), F.to_json(F.struct(F.col("detected_language").alias("common crawl detector"), F.col("html_lang").alias("html lang"))), "agreed"),
        _row(ok & (F.size("dates") >= 2) & (F.size(right) > 0), "published_date", K.QUESTIONS["published_date"], options, right, F.to_json(F.map_from_arrays(F.array("published.source"), F.array(date))), "single"),
    ]
    return _rows(df, F.struct(F.substring("url", 1, 300).alias("url"), "title", "page"), rows, keep)


def page_rows_v0(pages: DataFrame, keep: tuple[str, ...] = (), whole_words: bool = False) -> DataFrame:
    """LB-18: at most three decisions of each page(url, html) that has schema.org types and enough text."""
    df = parse_v0(pages, whole_words).withColumn("label", L.v0_page_type(F.col("node_types"))).where(F.col("label").isNotNull() & (F.length("text") >= 200)).withColumn("stock", L.stock(F.col("availabilities")))
    url, product = F.col("url"), F.col("label") == "product"
    is_gold = lambda c: c["value"].isNotNull() & (F.abs(c["value"] - F.col("price")) < 0.005)
    gold, other = F.filter("prices", is_gold), F.filter("prices", lambda c: ~F.coalesce(is_gold(c), F.lit(False)))
    first = F.slice(gold, 1, 3)
    chosen = _by_hash(F.concat(first, F.slice(_by_hash(other, url), F.lit(1), F.lit(8) - F.size(first))), F.concat(url, F.lit("#")))
    options = F.transform(chosen, lambda x, i: F.struct(F.concat(F.lit("p"), i.cast("string")).alias("id"), x["text"].alias("text")))
    right = F.filter(F.transform(chosen, lambda x, i: F.when(is_gold(x), F.concat(F.lit("p"), i.cast("string")))), lambda x: x.isNotNull())
    source = F.lit("schema.org")
    rows = [
        _row(F.lit(True), "page_type", K.V0_QUESTIONS["page_type"], options_of(K.V0_PAGE_TYPES), F.array("label"), source, None),
        _row(product & F.col("price").isNotNull() & (F.size(gold) > 0) & (F.size(other) > 0), "price_field", K.V0_QUESTIONS["price_field"], options, right, source, None),
        _row(product & F.col("stock").isNotNull(), "in_stock", K.NOUL_PREFIX + K.V0_QUESTIONS["in_stock"], options_of(K.V0_STOCK), F.array(F.col("stock").cast("string")), source, None, "noul"),
    ]
    return _rows(df, F.struct(F.substring("url", 1, 300).alias("url"), "title", "text", "link_count"), rows, keep)
