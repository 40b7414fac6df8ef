"""The pipeline, stage by stage on what the one before it kept."""

import random

import corpus_pipeline
from quern.llm.decontam import contaminated
from quern.llm.mixing import plan_mix
from quern.llm.simhash import groups

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def write(spark, path, rows, items):
    spark.createDataFrame(rows, COLUMNS).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_stages(spark, tmp_path):
    r = random.Random(9)
    stems = {"en": ["the", "ing", "ow", "ast"], "de": ["schu", "ver", "ung", "keit"]}
    sentence = lambda lang, n: " ".join("".join(r.choice(stems[lang]) for _ in range(r.randint(1, 4))) for _ in range(n))
    items = [(j, sentence("en", 20)) for j in range(3)]
    rows = []
    for i in range(60):
        lang = "de" if i % 3 == 0 else "en"
        text = sentence(lang, r.randint(30, 80))
        if i % 4 == 0:
            text += "\nShared footer line."
        if i % 10 == 9:
            text += "\n" + items[i % 3][1]
        rows.append((i, text, lang, f"s{i % 3}", len(text)))
    rows += [(100 + i, rows[i][1] + " extra", rows[i][2], "s0", 1) for i in (1, 2, 3)]
    rows += [(200, None, None, None, None), (201, "", "en", "s1", 0), (202, "123 456", "en", "s1", 7), rows[5]]
    d = write(spark, tmp_path / "in", rows, items)
    docs, held = spark.read.parquet(f"{d}/documents.parquet"), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, d)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        held[name] = (docs, docs := spark.read.parquet(str(tmp_path / name)))
    ids = lambda df: sorted(x.doc_id for x in df.select("doc_id").collect())
    assert ids(held["language_id"][1]) == sorted(x[0] for x in rows if x[0] not in (200, 201, 202))
    lines = held["line_dedup"][1].collect()
    assert all("footer" not in x.text and x.n_chars in (len(x.text), 1) for x in lines) and len(lines) == len(rows) - 3
    before, after = held["near_dedup"]
    assert ids(after) == sorted({x.group_id for x in groups(before).collect()})
    before, after = held["decontamination"]
    bad = {x.doc_id for x in contaminated(before, spark.read.parquet(f"{d}/benchmark.parquet")).collect()}
    assert bad and ids(after) == sorted(set(ids(before)) - bad)
    before, after = held["mixing"]
    want = {x.id: x.passes for x in plan_mix(before).collect()}
    got = {x.doc_id: x["count"] for x in after.groupBy("doc_id").count().collect()}
    assert got == {k: v for k, v in want.items() if v}


def test_empty_tables(spark, tmp_path):
    d = write(spark, tmp_path / "none", [], [])
    assert corpus_pipeline.run(spark, d).count() == 0
    d = write(spark, tmp_path / "nulls", [(None, None, None, None, None)] * 3, [(None, None)])
    assert corpus_pipeline.run(spark, d).count() == 0
