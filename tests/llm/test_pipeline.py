import corpus_pipeline as cp
from tests.compare import DATA
from tests.llm.test_operators import brute_components, brute_hits, brute_spans


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, before = docs.columns, docs
    assert [n for n, _ in cp.STAGES] == ["toxicity", "near duplicates", "repeated passages", "benchmark passages", "mixing"]
    for name, stage in cp.STAGES:
        after = stage(spark, before, DATA).cache()
        rows = {r.doc_id: r.text for r in after.collect()}
        was = {r.doc_id: r.text for r in before.collect()}
        assert set(rows) <= set(was)
        if name == "near duplicates":
            want = brute_components(was.items(), 5, 80, 100)
            assert set(rows) == {i for i, (_, c) in want.items() if i == c}
        if name == "repeated passages":
            want = brute_spans(was.items(), cp.PASSAGE_BYTES, True)
            assert set(rows) == set(was) and all((n > 0) == (rows[i] != was[i]) for i, (_, n, _, _) in want.items())
        if name == "benchmark passages":
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
            want = brute_hits(was.items(), items)
            assert set(rows) == {i for i, (n, hit, *_) in want.items() if hit <= 0.5 * n}
            assert all(rows[i] == was[i] for i in rows if not want[i][1])
        if name != "mixing":
            assert after.columns == columns and all(r.n_chars == len(r.text) for r in after.collect() if r.text is not None)
        before = after


def test_run(spark):
    out = cp.run(spark, DATA)
    assert out.columns[-1] == "copy" and out.count() > 0


def _folder(spark, tmp_path, rows, schema):
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{DATA}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


ODD = "doc_id long, text string, lang string, source string, n_chars int, score double, node string, spans int, items string, copy_of int"


def test_odd_rows(spark, tmp_path):
    """Nulls in any column, empty and long texts, repeated rows, an id with two texts, columns with names that the stages use."""
    item = next(r.text for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect() if len(r.text.split()) > 30)
    own = " ".join(f"w{i}" for i in range(120))
    rows = [(None, own, None, None, None, None, None, None, None, None)] * 2
    rows += [(i, t, "en", "s", len(t) if t else None, 1.0, "n", 1, "i", 0) for i, t in [(1, None), (2, ""), (3, " \n"), (4, "one"), (5, own), (5, "another text of this id"), (6, own), (6, own), (7, f"{item} and more")]]
    rows += [(8, " ".join(f"long{i}" for i in range(60_000)), "en", None, 1, None, None, None, None, None)]
    folder = _folder(spark, tmp_path, rows, ODD)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in cp.STAGES:
        docs = stage(spark, docs, folder).cache()
        kept[name] = [(r.doc_id, r.text) for r in docs.collect()]
        assert docs.columns == columns + ["copy"] * (name == "mixing")
        assert {(r.score, r.node, r.spans, r.items, r.copy_of) for r in docs.where("doc_id < 8").collect()} == {(1.0, "n", 1, "i", 0)}
    # of the five rows with one text the one with the least id stays; texts without words are copies of nothing
    stays = [(None if t is None else t[:20]) for _, t in kept["near duplicates"]]
    assert sorted(map(str, stays)) == sorted(map(str, [None, "", " \n", "one", own[:20], "another text of this id"[:20], f"{item} and more"[:20], "long0 long1 long2 long3"[:20]]))
    assert (5, own) in kept["near duplicates"] and len(kept["repeated passages"]) == len(stays)
    assert 7 not in {i for i, _ in kept["benchmark passages"]} and len(kept["benchmark passages"]) == len(stays) - 1
    assert {i for i, _ in kept["mixing"]} <= {i for i, _ in kept["benchmark passages"]}


def test_mixed_rows_follow_the_plan(spark):
    """The last stage on the shared table: every row as often as its plan says, sources near their targets."""
    from collections import Counter

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    from cirrostrat.llm import mixing

    plan = {r.doc_id: r for r in mixing.mix_sources(docs).collect()}
    got = Counter(r.doc_id for r in cp.mix(spark, docs, DATA).collect())
    words = Counter()
    for r in plan.values():
        words[r.source] += got[r.doc_id] * r.size
    for source, n in words.items():
        of = [r for r in plan.values() if r.source == source]
        assert abs(n - of[0].target) <= max(r.size for r in of)


def test_empty_table(spark, tmp_path):
    folder = _folder(spark, tmp_path, [], ODD)
    assert cp.run(spark, folder).count() == 0
