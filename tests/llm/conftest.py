import numpy as np
import pytest

WORDS = {"en": "the of and to in that with from was blean thore".split(), "de": "der die und von ungen keiten schaft zwischen öfter".split(), "fr": "les des une être où ménage quoi toujours".split()}


def sentence(rng, lang, n):
    return " ".join(rng.choice(WORDS[lang]) + rng.choice(["", "a", "el", "or", "ing", "um"]) for _ in range(n))


@pytest.fixture(scope="session")
def tables(spark, tmp_path_factory):
    """Small tables with nulls in every column, empty and very long texts, ties, repeated rows, and extra columns whose names clash."""
    rng = np.random.default_rng(3)
    docs = []
    for i in range(240):
        lang = ("en", "de", "fr")[i % 3]
        text = sentence(rng, lang, 30 + i)
        if i % 12 == 5:
            text += " idiot scum moron loser you idiot"
        docs.append((i, text, lang, f"src{i % 4}", len(text)))
    near = docs[107][1].split()
    docs.append((300, " ".join(near[:20] + ["changed"] + near[21:]), "fr", "src0", 1))  # one word of many
    docs += [docs[3], docs[3], (301, docs[3][1], None, None, None), (302, None, "en", "src1", None), (303, "", "en", None, 0), (304, " \n\t ", None, "src1", 3), (305, "123 !!! ...", "fr", "src2", 11), (None, "some words without an id here", "en", "src1", 9), (None, None, None, None, None)]
    docs.append((306, sentence(rng, "en", 60_000), "en", "src0", 1))
    docs.append((307, "x" * 300_000, "en", "src0", 1))
    docs.append((308, docs[10][1][:150] + " " + docs[20][1] + " " + docs[10][1], "en", "src0", 1))
    bench = [(0, " ".join(docs[30][1].split()[3:20])), (1, "Two words"), (2, None), (3, ""), (None, " ".join(docs[40][1].split()[:10])), (0, " ".join(docs[50][1].split()[:12])), (9, "not there at all in any of the texts of this table indeed"), (10, docs[7][1].upper())]
    labels = [(i, i % 2, int(i % 12 == 5)) for i in range(0, 240)] + [(5, 1, 1), (6, None, None), (None, 1, 1), (999, 1, 0)]
    vec = rng.normal(size=(200, 8))
    emb = [(i, [float(x) for x in v], i % 3) for i, v in enumerate(vec)]
    emb += [(1000 + i, [float(x) for x in vec[3] + rng.normal(size=8) * 0.02], 0) for i in range(40)]
    emb += [(2000, [float(x) for x in vec[5]], 1), (2000, [float(x) for x in vec[5]], 1), (2001, [float(x) * 2 for x in vec[5]], None), (2002, None, 1), (2003, [], 1), (2004, [0.0] * 8, 1), (2005, [None] + [1.0] * 7, 1), (2006, [float("nan")] + [1.0] * 7, 1), (2007, [float("inf")] + [1.0] * 7, 1), (2008, [1.0, 0.0], 1), (2009, [2.0, 0.01], 1), (2010, [1e-30, 1e-30], 0), (None, [0.5, 0.5], 0)]
    convs = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (1, 1, "assistant", "b"), (2, 0, None, None), (None, 0, "user", "x")]
    extra = ", n_words int, score string, full string, ti int, rid string, tkey long, node int, shard int, features string, lang_pred string, _rank int"
    blank = (1, "s", "f", 2, "r", 3, 4, 5, "fe", "lp", 6)

    def save(folder, name, rows, schema, wide=True):
        df = spark.createDataFrame([(*r, *blank) for r in rows] if wide else rows, schema + extra * wide)
        df.repartition(3).write.parquet(f"{folder}/{name}.parquet")

    out = {}
    for kind in ("full", "empty"):
        folder = str(tmp_path_factory.mktemp(kind))
        keep = (lambda r: r) if kind == "full" else (lambda r: [])
        save(folder, "documents", keep(docs), "doc_id long, text string, lang string, source string, n_chars long")
        save(folder, "benchmark", keep(bench), "item_id long, text string", False)
        save(folder, "labels", keep(labels), "doc_id long, quality int, toxic int", False)
        save(folder, "embeddings", keep(emb), "vec_id long, embedding array<float>, label int", False)
        save(folder, "conversations", keep(convs), "conv_id long, turn long, role string, text string", False)
        out[kind] = folder
    out["docs"], out["bench"], out["emb"] = docs, bench, emb
    return out
