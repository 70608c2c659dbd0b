"""Readers and writers on hand-made files."""

import csv
import io
import json
import os

import pytest
from pyspark.sql import functions as F

from tallywright.plans.prompts import load_prompts
from tallywright.sources import delimited, runs, sinks
from tallywright.sources.records import split_records
from tallywright.sources.store import load_or_create


def put(path, text, encoding="utf-8"):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding=encoding)
    return str(path)


def pairs(df):
    return sorted((r["text"], r["label"]) for r in df.collect())


@pytest.mark.parametrize("sep", [";", "|", "\t", ","])
def test_labelled_text(spark, tmp_path, sep):
    lines = ["Texto da Demanda;Categoria", "olá;A", "um;B;extra", "curto", "dois;B;", 'com "x";C', '"a;b\nc";D', ";E", "NA;F"]
    path = put(tmp_path / "in.csv", "\n".join(lines).replace(";", sep) + "\n")
    assert pairs(delimited.load_labelled_text(spark, path)) == [
        (f"a{sep}b\nc", "D"),
        ('com "x"', "C"),
        ("olá", "A"),
    ]


def test_labelled_text_wide(spark, tmp_path):
    path = put(tmp_path / "in.csv", "\ufeffid;demanda_texto;classificacao_real;x\n1;t;L;\n2;u;M\n3;v\n4;w;;;q\n")
    assert pairs(delimited.load_labelled_text(spark, path)) == [("t", "L"), ("u", "M")]


def test_labelled_text_by_position(spark, tmp_path):
    path = put(tmp_path / "in.csv", "a;b;c\n1;2;3\n")
    assert pairs(delimited.load_labelled_text(spark, path)) == [("1", "2")]
    with pytest.raises(ValueError, match="two columns"):
        delimited.load_labelled_text(spark, put(tmp_path / "one.csv", "text\nx\n"))


def test_tsv_discovery(spark, tmp_path):
    path = put(tmp_path / "in.tsv", "ID \tCategoria\t Meu Texto \n1\tA\t x |  y \n")
    row = delimited.load_tsv_with_discovery(spark, path).first()
    assert row.asDict() == {"ID": "1", "Categoria": "A", "Meu Texto": "x / y"}


@pytest.mark.parametrize("sep", [",", "|", ";"])
def test_sheet(spark, tmp_path, sep):
    text = '\ufeff"ID_Original";"Realismo 1 a 5 \n(1-Muito. 5-Natural)"\n"7";"4"\n'
    sheet = delimited.load_sheet_sniff_delimiter(spark, put(tmp_path / "s.csv", text.replace(";", sep)))
    assert sheet.columns == ["ID_Original", "Realismo 1 a 5  (1-Muito. 5-Natural)"]
    assert tuple(sheet.first()) == ("7", "4")


def test_results_pipe(spark, tmp_path):
    rows = [("0001", "A", "p", "m", "A", 1, 'x | "y"\nz', "linha 1\nCategoria: A ", 0.25, None, 1)]
    schema = ", ".join(f"{n} {t}" for n, t in delimited.PREDICTION_COLUMNS.items())
    path = str(tmp_path / "out")
    sinks.write_results_pipe(spark.createDataFrame(rows, schema), path)
    assert [tuple(r) for r in delimited.read_results_pipe(spark, path).collect()] == rows
    tabbed = put(tmp_path / "tab.csv", "demanda_id\tacertou\tclassificacao_raw\n12\t1\t\"a\nb\"\n")
    row = delimited.read_results_pipe(spark, tabbed).first()
    assert (row["demanda_id"], row["acertou"], row["classificacao_raw"], row["erro"]) == ("12", 1, "a\nb", None)


def test_run_results(spark, tmp_path):
    new = {"model": "LinearSVC", "algorithm": "GridSearchCV", "f1_holdout": 0.0, "accuracy_holdout": 0.5,
           "best_params": {"clf__C": 1, "tfidf__ngram_range": [1, 2]}}
    old = {"Modelo": "SVM", "Parametros": {"C": 10.0, "kernel": "linear"}, "Holdout_F1": 0.9, "runtime_seconds": 3.5}
    put(tmp_path / "gridsearch_optuna/run_1/final_LinearSVC_gridsearch.json", json.dumps(new, indent=2))
    put(tmp_path / "evolutionary/exp_1/final_evaluation_SVM.json", json.dumps(old, indent=2))
    put(tmp_path / "evolutionary/exp_1/final_results_all_models.json", json.dumps([old, new]))
    put(tmp_path / "evolutionary/exp_1/other.json", json.dumps(new))
    rows = runs.scan_run_results(spark, str(tmp_path)).orderBy("model", "source_file").collect()
    assert [(r["model"], r["origin"], r["f1"], r["accuracy"], r["recall"]) for r in rows] == [
        ("LinearSVC", "gridsearch_optuna", 0.0, 0.5, -1.0),
        ("SVM", "evolutionary", 0.9, -1.0, -1.0),
        ("SVM", "evolutionary", 0.9, -1.0, -1.0),
    ]
    assert json.loads(rows[0]["params"]) == new["best_params"]
    assert rows[1]["runtime_seconds"] == 3.5


def test_generation_logs(spark, tmp_path):
    put(tmp_path / "e/SVM/log.csv", "gen,avg,max\n1,0.5,0.6\n2,0.7,0.8\n")
    put(tmp_path / "e/NB/log_NB.csv", "gen;nevals;avg;std;min;max;time\r\n0;9;0.1;0.2;0.0;0.4;1.5\r\n")
    put(tmp_path / "e/other.csv", "gen,avg,max\n1,1,1\n")
    rows = runs.scan_generation_logs(spark, str(tmp_path)).orderBy("model", "gen").collect()
    assert [(r["model"], r["gen"], r["max"], r["min"], r["time"]) for r in rows] == [
        ("NB", 0, 0.4, 0.0, 1.5),
        ("SVM", 1, 0.6, None, None),
        ("SVM", 2, 0.8, None, None),
    ]


def test_latest_run(spark, tmp_path):
    for i, run in enumerate(["a", "b"]):
        for model in ("SVM", "NB"):
            path = put(tmp_path / run / model / "log.csv", "gen,avg,max\n")
            age = i if model == "SVM" else -i
            os.utime(path, (1_700_000_000 + age, 1_700_000_000 + age))
    newest = {r["key"]: r["path"].split("/")[-3] for r in runs.latest_run(spark, str(tmp_path), "*.csv").collect()}
    assert newest == {"SVM": "b", "NB": "a"}


def test_load_or_create(spark, tmp_path):
    built = []

    def build():
        built.append(1)
        return spark.createDataFrame([("a", "0.5"), ("b", "n/a")], "model string, score string")

    for _ in range(2):
        table = load_or_create(spark, str(tmp_path / "t"), build, ["score"])
        assert sorted(map(tuple, table.collect())) == [("a", 0.5), ("b", 0.0)]
    assert built == [1]


def test_append(spark, tmp_path):
    path = str(tmp_path / "t")
    for i in range(3):
        sinks.append_results(spark.range(i, i + 1), path)
    for _ in range(2):
        sinks.append_results(spark.range(7, 9), path, "job", "b1")
    # A batch that was cut short has rows but no entry in the manifest.
    spark.range(50).write.parquet(f"{path}/part=half")
    assert sorted(r["id"] for r in sinks.read_appended(spark, path).collect()) == [0, 1, 2, 7, 8]
    with pytest.raises(ValueError, match="name"):
        sinks.append_results(spark.range(1), path, "a/b")


@pytest.mark.parametrize("split_bytes", [40, 1 << 20])
def test_records_that_span_lines_and_splits(spark, tmp_path, split_bytes):
    cells = ["plain", "two\nlines", 'a "quoted" word', "semi; colon", "", "x\n\n\ny", '"', 'ends with "', "a\n\"b\"\nc"]
    rows = [(str(i), cells[i % len(cells)], cells[(i * 5 + 2) % len(cells)]) for i in range(120)]
    out = io.StringIO(newline="")
    csv.writer(out, delimiter=";", lineterminator="\n", quoting=csv.QUOTE_MINIMAL).writerows([("id", "t", "u"), *rows])
    path = put(tmp_path / "in.csv", out.getvalue())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split_bytes))
    try:
        found = delimited.read_rows(spark, path, ";", ["id", "t", "u"])
        records = split_records(spark, path, ";")
        got = sorted(((r["id"], r["t"] or "", r["u"] or "") for r in found.collect()), key=lambda r: int(r[0]))
        assert got == rows
        assert [r["place"] for r in records.orderBy("place").collect()] == list(range(1, 122))
        if split_bytes == 40:
            assert spark.read.text(path).rdd.getNumPartitions() > 20
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_quotes_inside_unquoted_cells(spark, tmp_path):
    path = put(tmp_path / "in.csv", 'id;t\n1;5" pipe\n2;"a\nb"\n3;x"y"z\n')
    found = delimited.read_rows(spark, path, ";", ["id", "t"]).orderBy("id").collect()
    assert [(r["id"], r["t"]) for r in found] == [("1", '5" pipe'), ("2", "a\nb"), ("3", 'x"y"z')]


def test_unfit_separators_are_refused(spark, tmp_path):
    path = put(tmp_path / "in.csv", "abc\n1\n")
    for read in (delimited.load_sheet_sniff_delimiter, delimited.read_results_pipe):
        with pytest.raises(ValueError, match="two columns"):
            read(spark, path)


def test_every_element_and_nan_scores(spark, tmp_path):
    results = [{"model": "SVM", "f1_holdout": 0.5}, {"model": "NB", "f1_holdout": "NaN"}]
    put(tmp_path / "runs/a/final_all.json", json.dumps(results))
    put(tmp_path / "runs/b/final_one.json", json.dumps({"Modelo": "LR", "Holdout_F1": 0.7}))
    found = runs.scan_run_results(spark, str(tmp_path / "runs"), every_element=True)
    assert sorted((r["model"], r["f1"]) for r in found.collect()) == [("LR", 0.7), ("NB", -1.0), ("SVM", 0.5)]
    assert sorted(r["model"] for r in runs.scan_run_results(spark, str(tmp_path / "runs")).collect()) == ["LR", "SVM"]


def test_newest_folder(spark, tmp_path):
    for run in ("run_20250101_1", "run_20250102_9", "run_20250103_2"):
        put(tmp_path / f"out/{run}/sub/log.csv", "x")
    newest = runs.newest_folder(spark, str(tmp_path / "out"), "*.csv").collect()
    assert [(r["run"], r["path"].endswith("run_20250103_2/sub/log.csv")) for r in newest] == [("run_20250103_2", True)]


def test_stored_nan_becomes_zero(spark, tmp_path):
    rows = load_or_create(
        spark, str(tmp_path / "t"), lambda: spark.createDataFrame([("NaN",), ("0.5",)], "score string"), ["score"]
    )
    assert sorted(r["score"] for r in rows.collect()) == [0.0, 0.5]


def test_load_prompts(spark, tmp_path):
    path = put(tmp_path / "p.jsonl", '{"id": "x", "template": "diga {demanda}"}\n')
    assert load_prompts(spark, path) == [{"id": "x", "template": "diga {demanda}"}]
