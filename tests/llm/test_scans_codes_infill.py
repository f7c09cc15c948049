"""Licence scans, vector code compression and fill-in-middle, against brute force and DuckDB."""

import glob
import hashlib
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.llm import infill, licences, quantise, registry

OPS = ("op11_license_scans", "op12_vector_code_compression", "op13_fill_in_middle")
DOCS = "doc_id long, text string"


def rows_of(df):
    return [r.asDict() for r in df.collect()]


def by_sql(tables, name, folder=None):
    import duckdb

    con = duckdb.connect()
    for f in glob.glob(f"{folder or tables['full']}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}/*.parquet'")
    cur = con.execute(registry.ORACLE_SQL[name])
    names = [d[0] for d in cur.description]
    return [dict(zip(names, r, strict=True)) for r in cur.fetchall()]


def alike(one, two):
    key = lambda r: str(sorted(r.items()))
    return sorted(one, key=key) == sorted(two, key=key)


@pytest.mark.parametrize("name", [OPS[0], OPS[2]])
def test_sql_over_hard_tables(spark, tables, name):
    assert alike(rows_of(registry.QUERIES[name](spark, tables["full"])), by_sql(tables, name))


# ---------------------------------------------------------------- licences

NOTICE = {t.label: t for t in licences.NOTICES}


def scanned(spark, tmp_path, texts):
    spark.createDataFrame(list(enumerate(texts)), DOCS).repartition(2).write.parquet(f"{tmp_path}/documents.parquet")
    return {r["doc_id"]: r for r in rows_of(registry.QUERIES[OPS[0]](spark, str(tmp_path)))}


def test_every_place_of_a_phrase(spark, tmp_path):
    texts = [
        "Apache LICENSE, apache license; Apache-License... the MIT/License mit",
        "apache apache license license cc by cc cc by by",
        "gnu general public license gnu general gnu general public license",
        "ápache license, apache licensé, MIT licenseK, Kapache license cc\x00by CC—by",
        "mit K license mit licenseK MIT LICENSE",
        "",
        None,
        "İ mit license" * 3,
        "license " * 60_000 + "apache " * 30_000 + "license",
        "apache license " * 20_000,
        "the of to in " * 5_000,
    ]
    got = scanned(spark, tmp_path, texts)
    for i, text in enumerate(texts):
        n, places = licences.brute_force(text)
        starts = [p for p, _ in places]
        r = got[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (n, len(places), min(starts, default=None), max(starts, default=None)), text
        assert r["base_labels"] == ",".join(sorted({x for _, x in places})) and set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))
        assert r["score"] == (1.0 if places else 0.0)


def test_notices(spark, tmp_path):
    bsd = NOTICE["bsd"].text
    changed = bsd.replace("conditions", "terms").replace("permitted", "allowed")
    texts = [f"some code here {t.text} and more code" for t in licences.NOTICES]
    texts += [changed, "new words before " + bsd.replace("with or without modification", "unchanged"), "with or without modification"]
    texts += [NOTICE["gpl-or-later"].text.upper().replace(" ", " \n# ")]
    got = scanned(spark, tmp_path, texts)
    for i, t in enumerate(licences.NOTICES):
        assert t.label in got[i]["labels"].split(",") and got[i]["score"] == 1.0, t
    n = len(licences.NOTICES)
    assert got[n]["labels"] == "bsd" and got[n]["score"] == pytest.approx(1 - 2 / len(bsd.split()))
    assert got[n + 1]["labels"] == got[n + 2]["labels"] == "" and got[n + 1]["score"] == 0
    assert got[n + 3]["labels"] == "gpl,gpl-or-later"


def test_the_scan_needs_no_python_and_keeps_columns(spark, tables):
    docs = spark.read.parquet(f"{tables['full']}/documents.parquet")
    found = licences.scan(docs, licences.NOTICES, licences.BASE)
    assert found.columns == [*docs.columns, "_n_words", "_found"] and found.count() == docs.count()
    plan = registry.QUERIES[OPS[0]](spark, tables["full"])._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


# ---------------------------------------------------------------- codes


def coded(spark, folder):
    got = registry.QUERIES[OPS[1]](spark, folder).collect()
    return sorted((r["vec_id"] is None, r["vec_id"] or 0, r["code"], r["error"], r["label_error"]) for r in got), {r["codebooks_sha256"] for r in got}


def check_codes(spark, folder, emb):
    rows, digest = quantise.brute_force(emb)
    sums = {}
    for _, label, _, e in rows:
        sums[label] = sums.get(label, 0) + e
    got, digests = coded(spark, folder)
    assert got == sorted((i is None, i or 0, c, e, sums[label]) for i, label, c, e in rows) and digests == {digest}


def test_codes_over_hard_tables(spark, tables):
    # the commonest length that four parts divide is eight
    check_codes(spark, tables["full"], [(i, v, x) for i, v, x in tables["emb"] if v is None or len(v) == 8])


def save_vectors(spark, folder, emb, partitions=3):
    blank = (7, "x", 3.0, "y")
    df = spark.createDataFrame([(*r, *blank) for r in emb], "vec_id long, embedding array<float>, label int, emb int, code string, error double, bounds string")
    df.repartition(partitions).write.parquet(f"{folder}/embeddings.parquet")


@pytest.mark.parametrize("kind", ["clusters", "ties", "one", "few"])
def test_codes_against_brute_force(spark, tmp_path, kind):
    rng = np.random.default_rng(5)
    n = {"clusters": 1500, "ties": 900, "one": 300, "few": 40}[kind]
    centres = rng.normal(size=(60, 16))
    x = centres[rng.integers(0, 60, n)] + rng.normal(size=(n, 16)) * 0.05
    if kind == "ties":  # few different values: many entries are equal, and many are equally far
        x = rng.integers(-2, 3, (n, 16)) / 1024.0
    if kind == "one":
        x[:] = 0.25
    emb = [(i if i % 50 else None, [float(y) for y in np.float32(v)], None if i % 7 == 0 else i % 5) for i, v in enumerate(x)]
    # equal ids with other vectors, and equal rows
    emb += [(1, [float(y) for y in np.float32(v)], 1) for v in x[:5]] + emb[2:4]
    save_vectors(spark, tmp_path, emb)
    check_codes(spark, str(tmp_path), emb)
    if kind == "clusters":
        assert alike([{**r, "vec_id": r["vec_id"] or -1} for r in rows_of(registry.QUERIES[OPS[1]](spark, str(tmp_path))) if r["vec_id"]], [r for r in by_sql(None, OPS[1], tmp_path) if r["vec_id"]])


@pytest.mark.parametrize("scale", [1, 300, 1 << 20, 1 << 30])
def test_bounds_give_what_comparing_everything_gives(scale):
    rng = np.random.default_rng(scale)
    centres = rng.normal(size=(80, 6)) * 400
    x = np.round(centres[rng.integers(0, 80, 700)] + rng.normal(size=(700, 6)) * 9).astype(np.int64) * scale // 100
    entries = x[:64].copy()
    group = quantise.grouped(entries, 8)
    assert len(group) == 64 and set(group.tolist()) == set(range(group.max() + 1))
    entry = bounds = drift = None
    compared = []
    for _ in range(6):
        part = quantise.Part(entries, group, drift)
        entry, d, bounds = part.nearest(x if scale < 1 << 20 else x.astype(object), entry, bounds)
        compared.append(part.compared)
        table = ((x[:, None].astype(object) - entries[None].astype(object)) ** 2).sum(2)
        assert entry.tolist() == [min(range(64), key=lambda e: (row[e], e)) for row in table] and [int(v) for v in d] == table.min(1).tolist()
        # every bound is below the distance to the group's other entries
        for g in range(group.max() + 1):
            others = np.where((group == g)[None] & (np.arange(64)[None] != entry[:, None]), np.sqrt(table.astype(float)), np.inf).min(1)
            assert (bounds[:, g] <= others).all()
        new = np.stack([x[entry == e].sum(0) // (entry == e).sum() if (entry == e).any() else entries[e] for e in range(64)])
        drift = np.array([np.sqrt(((new - entries).astype(float) ** 2).sum(1))[group == g].max() * (1 + 1e-9) for g in range(group.max() + 1)])
        entries = new
    assert compared[0] == 700 * 64 and compared[-1] < compared[0] / 4


def test_large_components_are_exact(spark, tmp_path):
    rng = np.random.default_rng(1)
    emb = [(i, [float(v) for v in np.float32(rng.normal(size=8) * 90_000)], 0) for i in range(300)]
    save_vectors(spark, tmp_path, emb)
    check_codes(spark, str(tmp_path), emb)


def test_label_errors_do_not_depend_on_how_they_are_joined(spark):
    df = spark.createDataFrame([(i, "00", i, None if i % 3 == 0 else i % 40) for i in range(500)], "vec_id long, code string, error long, label int")
    one, two = (sorted(map(str, quantise.with_label_error(df, broadcast_labels=b).select("vec_id", "error", "label", "label_error").collect())) for b in (1000, 3))
    assert len(one) == 500 and one == two


# ---------------------------------------------------------------- infill


def test_rank_and_select():
    rng = np.random.default_rng(2)
    for size in (0, 1, 63, 64, 65, 511, 512, 513, 1024, 5000):
        for share in (0.0, 0.01, 0.5, 1.0):
            bits = rng.random(size) < share
            made = infill.RankSelect(bits)
            assert made.total == bits.sum()
            assert made.rank(np.arange(size + 1)).tolist() == np.r_[0, np.cumsum(bits)].tolist()
            assert made.select(np.arange(made.total)).tolist() == np.flatnonzero(bits).tolist()


def test_infill_over_hard_tables(spark, tables):
    want = sorted(str((d, *infill.brute_force(d, t)[:4], hashlib.sha256(infill.brute_force(d, t)[4].encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())) for d, t, *_ in tables["docs"])
    got = registry.QUERIES[OPS[2]](spark, tables["full"]).collect()
    assert sorted(str(tuple(r)) for r in got) == want


def test_infill_forms(spark):
    texts = ["a <P> b", "x<S>", "<M>", "< P> <p> <P", "a b" * 3, " ", "\n\n a", "a \t", "é ü ö ñ", "𝄞 𝄞x y", "\x1c \x1f", None, "one", "<S <P <M < <"]
    df = spark.createDataFrame([(i, t, "kept") for i, t in enumerate(texts * 12)], DOCS + ", _f_extra string").repartition(3)
    out = infill.fill_in_middle(df).withColumn("back", infill.restored(F.col("_f_output"), F.col("_f_form")))
    assert out.columns[:3] == df.columns
    seen = set()
    for r in out.collect():
        n, form, p, m, output = infill.brute_force(r["doc_id"], r["text"])
        assert (r["_f_n"], r["_f_form"], r["_f_prefix_chars"], r["_f_middle_chars"], r["_f_output"]) == (n, form, p, m, output)
        assert r["back"] == (r["text"] or "")
        seen.add(form)
    assert seen == {"plain", "psm", "spm"}
