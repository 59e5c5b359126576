import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from themeloom import session
from themeloom.functions.stopwords import stopword_list, stopword_table
from themeloom.sources import corpus, folder as folder_source


def write(folder, files):
    for name, text in files.items():
        path = folder / name
        path.parent.mkdir(exist_ok=True)
        path.write_text(text, encoding="utf-8")


def test_text_folder(spark, tmp_path):
    write(tmp_path, {"b.md": "\n uno dos\ntres  ", "a.md": "", "c+ñ %41.md": "x\n", "sub/d.md": "y"})
    rows = corpus.read_text_folder(spark, str(tmp_path)).orderBy("doc_id").collect()
    assert [tuple(r) for r in rows] == [(0, "a.md", "", 0), (1, "b.md", "uno dos\ntres", 3), (2, "c+ñ %41.md", "x", 1)]
    rows = corpus.read_text_folder(spark, str(tmp_path), keep_empty=False).orderBy("doc_id").collect()
    assert [r["name"] for r in rows] == ["b.md", "c+ñ %41.md"]


def test_text_folder_by_sparks_readers(spark, tmp_path, monkeypatch):
    """A store that Python cannot open gives the same rows."""
    write(tmp_path, {"b.md": "\n uno dos\ntres  ", "a.md": "", "c+ñ %41.md": "x\n", "_d.md": "y", ".e.md": "z"})
    ours = corpus.read_text_folder(spark, str(tmp_path)).orderBy("doc_id").collect()
    monkeypatch.setattr(folder_source, "reachable", lambda folder: False)
    theirs = corpus.read_text_folder(spark, str(tmp_path)).orderBy("doc_id").collect()
    assert [tuple(r) for r in ours] == [tuple(r) for r in theirs] and len(ours) == 3


def test_text_folder_tasks(spark, tmp_path, monkeypatch):
    """Runs of files cover the listing in order, whatever their lengths; a task numbers its own files."""
    files = [(f"f{k}", size) for k, size in enumerate([0, 5 << 20, 300 << 20, 0, 0, 1, 200 << 20, 7])]
    for tasks in (1, 2, 3, 100):
        cut = folder_source.runs(files, tasks)
        assert [p for run in cut for p in run.paths] == [p for p, _ in files]
        assert [run.first for run in cut] == [sum(len(r.paths) for r in cut[:k]) for k in range(len(cut))]
        assert all(len(run.paths) == 1 or sum(dict(files)[p] for p in run.paths) <= folder_source.SPLIT_BYTES for run in cut)
    assert folder_source.runs([], 4) == [folder_source.Run(0, [])]
    write(tmp_path, {f"{k:03d}.txt": f"text {k}" if k % 3 else "" for k in range(50)})
    read = corpus.read_text_folder(spark, f"file://{tmp_path}")
    assert read.rdd.getNumPartitions() > 1
    assert sorted(tuple(r) for r in read.collect()) == [
        (k, f"{k:03d}.txt", f"text {k}" if k % 3 else "", 2 if k % 3 else 0) for k in range(50)
    ]


def test_short_files_make_few_tasks():
    """A task of short files holds thousands of them: its start costs as much as they do."""
    files = [(f"f{k:06d}", 3_000) for k in range(100_000)]
    cut = folder_source.runs(files, 12)
    assert len(cut) <= 20 and sum(len(run.paths) for run in cut) == 100_000


def test_tasks_write_in_folders_of_their_own(tmp_path):
    made = []

    class Store:
        def __getattr__(self, name):
            return lambda *args, **options: made.append((name, *args)) or getattr(local, name)(*args, **options)

    local, path = folder_source.store(str(tmp_path))
    batch = pa.RecordBatch.from_pydict({"name": ["a.txt", "b.txt"], "value": ["uno", None]})
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(folder_source, "store", lambda folder: (Store(), path))
        folder_source.FolderWriter(str(tmp_path)).write(iter([batch]))
    opened = [args[1] for args in made if args[0] == "open_output_stream"]
    assert len(opened) == 2 and all(name.rpartition("/")[0] != path for name in opened)
    assert sorted((f.name, f.read_text()) for f in tmp_path.iterdir()) == [("a.txt", "uno"), ("b.txt", "")]


def test_text_folder_reads_once(spark, tmp_path):
    write(tmp_path, {"a.md": "x"})
    plan = corpus.read_text_folder(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan and plan.count("BatchScan") == 1


def test_empty_missing_and_undecodable_files(spark, tmp_path):
    (tmp_path / "none").mkdir()
    assert corpus.read_text_folder(spark, str(tmp_path / "none")).count() == 0
    with pytest.raises(Exception, match="(?i)path"):
        corpus.read_text_folder(spark, str(tmp_path / "missing")).count()
    (tmp_path / "some").mkdir()
    (tmp_path / "some" / "a.txt").write_bytes(b"uno \xff dos")
    assert corpus.read_text_folder(spark, str(tmp_path / "some")).head()["text"] == "uno \ufffd dos"


@pytest.mark.parametrize("pattern", ["*.{md,txt}", "[^a]*", "?.md", "a{,b}.{md,t{x,s}t}"])
def test_patterns_mean_what_sparks_readers_make_of_them(spark, tmp_path, monkeypatch, pattern):
    write(tmp_path, {name: "x" for name in ["a.md", "ab.md", "b.txt", "a.tst", "c.py"]})
    ours = [r["name"] for r in corpus.read_text_folder(spark, str(tmp_path), pattern).orderBy("doc_id").collect()]
    monkeypatch.setattr(folder_source, "reachable", lambda folder: False)
    theirs = corpus.read_text_folder(spark, str(tmp_path), pattern, keep_empty=False).orderBy("doc_id").collect()
    assert ours == [r["name"] for r in theirs] and ours


def test_no_documents_are_an_empty_folder(spark, tmp_path):
    out = str(tmp_path / "out")
    corpus.write_text_folder(spark.createDataFrame([], "name string, text string"), out, "name", "text")
    assert corpus.read_text_folder(spark, out).count() == 0


def test_written_folder_comes_back(spark, tmp_path):
    rows = [("b.txt", "uno\r\ndos ñ"), ("a b+%41.txt", None), ("c.txt", ""), ("d.txt", "x" * 100_000)]
    docs = spark.createDataFrame(rows, "name string, text string").repartition(3)
    out = str(tmp_path / "out")
    corpus.write_text_folder(docs, out, "name", "text")
    read = corpus.read_text_folder(spark, out).orderBy("doc_id").collect()
    assert [(r["name"], r["text"]) for r in read] == [("a b+%41.txt", ""), *[r for r in rows if r[1] is not None]]
    with pytest.raises(FileExistsError):
        corpus.write_text_folder(docs, out, "name", "text")
    for k, unfit in enumerate([None, "b.txt", "_x", "", "a/b"]):
        with pytest.raises(ValueError):
            corpus.write_text_folder(docs.union(spark.createDataFrame([(unfit, "y")], docs.schema)), f"{out}{k}", "name", "text")


def test_text_folder_pattern(spark, tmp_path):
    write(tmp_path, {"b.md": "x", "a.txt": "y"})
    rows = corpus.read_text_folder(spark, str(tmp_path), "*.md").collect()
    assert [tuple(r) for r in rows] == [(0, "b.md", "x", 1)]


def test_latex_folder(spark, tmp_path):
    write(tmp_path, {"m.tex": "\\begin{document}\\section{Uno} dos % no\n\\end{document}", "n.md": "x"})
    rows = corpus.read_latex_folder(spark, str(tmp_path)).collect()
    assert [(r["name"], r["n_words"], r["text"].split()) for r in rows] == [("m.tex", 2, ["Uno", "dos"])]


def test_report_sink(spark, tmp_path):
    report = spark.createDataFrame([(1, 0, "a"), (2, 1, "b")], "doc_id bigint, topic int, words string")
    path = str(tmp_path / "out")
    corpus.write_report(report, path, "topic")
    assert spark.read.parquet(path).filter("topic = 1").select("doc_id").collect()[0][0] == 2
    with pytest.raises(Exception, match="(?i)exists"):
        corpus.write_report(report, path)


def test_profile_reads_two_columns_and_no_more(spark, folder, capsys):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    corpus.corpus_profile(docs, "lang").explain("formatted")
    assert "ReadSchema: struct<text:string,lang:string>" in capsys.readouterr().out


def test_stopword_union(spark):
    table = {r["term"]: r["languages"] for r in stopword_table(spark).collect()}
    assert sorted(table) == stopword_list()
    assert table["no"] == "english spanish" and table["the"] == "english"


def test_scratch_folder_is_the_named_one(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        assert session.scratch_folder(spark).startswith(named)


def test_materialise_keeps_rows_and_schema(spark):
    df = spark.range(10).select("id", F.array(F.col("id")).alias("v"))
    stored, rows = session.materialise_counted(df, "t")
    assert rows == 10 and stored.schema.simpleString() == df.schema.simpleString()
    assert sorted(r["id"] for r in stored.collect()) == list(range(10))


def test_spread_only_small_scans(spark, folder, tmp_path):
    small = spark.read.parquet(f"{folder}/documents.parquet")
    cores = spark.sparkContext.defaultParallelism
    assert session.spread(small, "doc_id").rdd.getNumPartitions() == cores
    path = str(tmp_path / "many")
    spark.range(10_000).repartition(3 * cores).write.parquet(path)
    spark.conf.set("spark.sql.files.openCostInBytes", str(200 * 1024 * 1024))
    try:
        many = spark.read.parquet(path)
        assert session.spread(many, "id") is many
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
