"""Shards of several formats as one data set."""

import gzip
import json

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from typica.sources import hub


def write_arrow(path, rows, stream=False):
    path.parent.mkdir(parents=True, exist_ok=True)
    t = pa.Table.from_pylist(rows)
    with (pa.ipc.new_stream if stream else pa.ipc.new_file)(str(path), t.schema) as w:
        for b in t.to_batches(max_chunksize=2):
            w.write_batch(b)


def test_shards_of_all_formats(spark, tmp_path):
    root = tmp_path / "set"
    root.mkdir()
    for k in range(2):
        with gzip.open(root / f"train-0000{k}-of-00002.jsonl.gz", "wt") as f:
            f.write("".join(json.dumps({"text": f"json {k} {i}", "label": i}) + "\n" for i in range(3)) + ("{broken\n" if k else ""))
    (root / "test.csv").write_text('text,label\n"a ""quoted"", line\nbreak",1\nb,2\n')
    (root / "train.csv").write_text('text,label\n"c, d",7\n')
    write_arrow(root / "train.arrow", [{"text": f"arrow {i}", "more": i} for i in range(200)])
    (root / "README.md").write_text("x")
    got = hub.scan(spark, str(root)).select("text", "label", "more").collect()
    assert sorted(r.text for r in got) == sorted([f"json {k} {i}" for k in range(2) for i in range(3)] + ["c, d"] + [f"arrow {i}" for i in range(200)])
    assert {r.label for r in got if r.text == "c, d"} == {7} and sum(r.more is not None for r in got) == 200
    assert [(r.text, r.label) for r in hub.scan(spark, str(root), "test").collect()] == [('a "quoted", line\nbreak', 1), ("b", 2)]
    with pytest.raises(FileNotFoundError, match="no shards"):
        hub.scan(spark, str(root), "validation")
    (root / "train-00001-of-00002.jsonl.gz").unlink()
    with pytest.raises(FileNotFoundError, match="1 of 2"):
        hub.scan(spark, str(root))


def test_conditions_on_folders_rule_shards_out(spark, tmp_path, monkeypatch):
    for lang in ("en", "de", "fr"):
        write_arrow(tmp_path / f"set/train/lang={lang}/part-0.arrow", [{"text": f"{lang} {i}", "n": i} for i in range(150)], stream=lang == "fr")
    rows = hub.scan(spark, str(tmp_path / "set"))
    assert rows.count() == 450 and {r.lang for r in rows.collect()} == {"en", "de", "fr"}
    assert rows.where("lang = 'de' and n < 10").count() == 10 and rows.where("lang in ('en', 'fr')").count() == 300 and rows.where("lang = 'es'").count() == 0
    paths = [f"{tmp_path}/set/train/lang={x}/part-0.arrow" for x in ("en", "de", "fr")]
    reader = hub.ArrowShardsReader(paths, f"{tmp_path}/set/train", rows.schema)
    left = list(reader.pushFilters([hub.EqualTo(("lang",), "de"), hub.In(("n",), (1, 2))]))
    assert len(left) == 1 and reader.paths == [paths[1]] and len(reader.partitions()) == -(-75 // hub.RUN)
    (tmp_path / "set/train/lang=en/part-0.arrow").write_text("not an arrow file")  # never opened
    assert rows.where(F.col("lang") == "de").count() == 150


def test_folders_of_json(spark, tmp_path, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    docs.write.partitionBy("lang").option("compression", "gzip").json(f"{tmp_path}/set/train")
    got = hub.scan(spark, f"{tmp_path}/set").where("lang = 'de'")
    assert got.count() == docs.where("lang = 'de'").count() and "PartitionFilters: [isnotnull(lang" in got._jdf.queryExecution().toString()
