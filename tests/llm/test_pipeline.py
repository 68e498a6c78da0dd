"""The pipeline on a small corpus, stage by stage against plain Python."""

import random

import corpus_pipeline
from test_documents import bench_brute, lines_brute, near_brute


def test_pipeline(spark, tmp_path):
    rng = random.Random(8)
    vocabulary = [f"{a}{b}" for a in "bcdfgklmnp" for b in ("al", "er", "in", "os", "um")]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    line = "A licence line that very many of the documents share."
    item = text(20)
    docs = [(i, f"{text(40)}\n{line}\n{text(20)}" if i % 3 == 0 else text(60)) for i in range(150)]
    docs += [(200 + i, docs[i][1]) for i in range(10)] + [(300, docs[1][1] + " end"), (301, f"{text(15)} {item}"), (302, None)]
    docs += [(400 + i, " ".join([text(10), rng.choice(["vexal", "vexor"]), text(10)])) for i in range(60)]
    labels = [(i, 1, int(i >= 400)) for i, _ in docs]
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in docs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(7, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "line_dedup", "near_dedup", "decontamination", "mixing"]
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = now.columns

    def step(name):
        nonlocal now
        now = corpus_pipeline.table(stages[name](spark, now, str(tmp_path)))
        return [(r.doc_id, r.text) for r in now.select("doc_id", "text").collect()]

    first = step("toxicity")
    left = {i for i, _ in first}
    assert len([i for i in left if i >= 400]) <= 3 and len([i for i in left if i < 400]) >= 160
    second = step("line_dedup")
    assert dict(second) == {i: t if t is not None else None for i, t in lines_brute(first).items() if i != 302} | {302: None}
    third = step("near_dedup")
    assert {i for i, _ in third} == {i for i, (_, c) in near_brute(second, 5).items() if i == c}
    fourth = step("decontamination")
    judged = bench_brute(third, [(7, item)])
    assert {i for i, _ in fourth} == {i for i, (n, hit, _) in judged.items() if not (hit and 20 * hit >= n)} and 301 not in dict(fourth)
    assert now.columns == columns
    last = step("mixing")
    assert {i for i, _ in last} <= {i for i, _ in fourth} and "repeats" in now.columns
    assert now.where("length(text) <> n_chars").count() == 0


def test_pipeline_edges(spark, tmp_path):
    """Empty tables, and ids that repeat or are null: no stage crashes, copies leave one."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    long = " ".join(f"w{i}" for i in range(300))
    rows = [(1, long, "en", None, 1), (1, long, "en", "a", 1), (1, "another text of this id", "en", "a", 1), (None, long, None, "a", None), (None, None, None, None, None), (2, "", "en", "a", 0)]
    for name, docs in (("none", []), ("odd", rows)):
        folder = f"{tmp_path}/{name}"
        spark.createDataFrame(docs, schema).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        spark.createDataFrame([], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
        out = corpus_pipeline.run(spark, folder)
        got = [r.text for r in out.collect()]
        assert set(schema.replace(",", "").split()[::2]) <= set(out.columns)
        assert got == [] if name == "none" else set(got) <= {long, "another text of this id"} and got.count(long) <= 1


def test_pipeline_leaves_its_result_only(spark, tmp_path):
    from pathlib import Path

    from lectern.stored import shared_folder

    rows = [(i, f"text number {i} of these few words {i * 7}", "en", f"s{i % 2}", 1) for i in range(40)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "nothing")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    home = Path(shared_folder(spark).removeprefix("file://")) / "lectern"
    before = set(home.iterdir()) if home.exists() else set()
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert len(set(home.iterdir()) - before) == 1 and out.count() > 0
