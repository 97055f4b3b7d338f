"""Files are listed and read by tasks."""

import pytest
from pyspark.sql import functions as F

from docloom.sources import documents


def test_scan_equals_sparks_reader(spark, tmp_path):
    names = ["a.md", "b c.md", "d/e.md", "d/f/g%h#?[x].md", "d/é^.md", "d/k.txt", "_no/x.md", ".no/x.md", "d/_no.md", "d/.no.md", "d/big.md", "empty.md"]
    for n in names:
        (tmp_path / n).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / n).write_text("" if n == "empty.md" else f"x\ny {n}\n" * (200_000 if "big" in n else 1))
    (tmp_path / "bad.md").write_bytes(b"a\xff b")
    read = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").option("wholetext", True).format("text").load(str(tmp_path))
    want = sorted(map(tuple, read.select(F.col("_metadata.file_path").alias("p"), F.length("value").alias("n")).collect()))
    for folder in (str(tmp_path), f"file://{tmp_path}/"):
        rows = documents.scan_files(spark, folder)
        assert sorted(map(tuple, rows.select("path", F.length("content")).collect())) == want


def test_driver_lists_no_files(spark, tmp_path):
    (tmp_path / "a.md").write_text("x")
    # A scan of files would have the driver list them; what it has is a table of their names.
    assert not [f for f in documents.scan_files(spark, str(tmp_path)).inputFiles() if f.endswith("a.md")]
    with pytest.raises(FileNotFoundError):
        documents.scan_files(spark, str(tmp_path / "none"))
