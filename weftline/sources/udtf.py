"""Readers and parsers as table functions, for queries in SQL text alone.

    udtf.register(spark)
    SELECT r.url, p.title FROM warc_paths f, LATERAL warc_records(f.path, 'response') r, LATERAL page_state(r.url, r.html) p

`warc_records(path [, rec_type])` gives a WARC file's records, streamed, with the body as text where it is HTML. `page_state(url, html [, columns])` gives a page's outline and label
sources, one row; `columns` names, separated by commas, which of them are wanted: the schema is what was asked for. Arguments that a schema depends on must be constants.
A null page gives a row of empties; a file that cannot be read gives one row of rec_type "failed", as in `warc.read_warc`.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from ..functions import html as H
from . import warc

RECORDS = StructType().add("seq", LongType()).add("rec_type", StringType()).add("url", StringType()).add("status", IntegerType()).add("html", StringType()).add("lang3", StringType())
STATE = (
    StructType()
    .add("title", StringType())
    .add("page", StringType())
    .add("html_lang", StringType())
    .add("og_type", StringType())
    .add("jsonld", ArrayType(StringType()))
    .add("lines", IntegerType())
)


def _constant(arg: AnalyzeArgument, name: str) -> str:
    if not arg.isConstantExpression or not isinstance(arg.dataType, StringType):
        raise ValueError(f"{name} must be a constant string")
    return arg.value


class WarcRecords:
    @staticmethod
    def analyze(path: AnalyzeArgument, rec_type: AnalyzeArgument | None = None) -> AnalyzeResult:
        if not isinstance(path.dataType, StringType):
            raise ValueError("path must be a string")
        if rec_type is not None:
            _constant(rec_type, "rec_type")
        return AnalyzeResult(schema=RECORDS)

    def eval(self, path: str, rec_type: str | None = None) -> Iterator[tuple]:
        wanted = warc.Wanted(rec_type)
        for r in warc.streamed(path, 10**12) if path is not None else ():
            if wanted(r):
                yield r["seq"], r["rec_type"], r["url"], r["status"], warc.html_text(r["body"], r["http"]), r["lang3"]


class PageState:
    @staticmethod
    def analyze(url: AnalyzeArgument, html: AnalyzeArgument, columns: AnalyzeArgument | None = None) -> AnalyzeResult:
        if not isinstance(html.dataType, StringType):
            raise ValueError("html must be a string")
        if columns is None:
            return AnalyzeResult(schema=STATE)
        named = [c.strip() for c in _constant(columns, "columns").split(",")]
        unknown = [c for c in named if c not in STATE.fieldNames()]
        if unknown:
            raise ValueError(f"page_state has no columns {unknown}; it has {STATE.fieldNames()}")
        return AnalyzeResult(schema=StructType([STATE[c] for c in named]))

    def eval(self, url: str, html: str, columns: str | None = None) -> Iterator[tuple]:
        page = H.read_page(html or "")
        found = {"title": H.squeeze(page.title)[:300], "page": H.outline(page), "html_lang": page.html_lang, "og_type": page.meta.get("og:type", ""), "jsonld": page.jsonld, "lines": len(page.lines)}
        yield tuple(found[c.strip()] for c in columns.split(",")) if columns is not None else tuple(found[c] for c in STATE.fieldNames())


def register(spark: SparkSession) -> None:
    """Makes both functions known to the session's SQL."""
    for name, made in (("warc_records", WarcRecords), ("page_state", PageState)):
        spark.udtf.register(name, F.udtf(made, useArrow=True))
