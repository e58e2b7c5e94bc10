import pathlib
import re
import shutil
import subprocess
import sys

from pyspark.sql import functions as F

from strandloom.operators.table import SeqTable

ROOT = pathlib.Path(__file__).resolve().parent.parent


def test_nothing_imports_the_text_operators():
    for p in (ROOT / "strandloom").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT).parts:
            assert "strandloom.llm" not in p.read_text(), p


def test_entry_without_the_text_operators(tmp_path):
    shutil.copytree(ROOT / "strandloom", tmp_path / "strandloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 70 and set(e.oracle_sql()) <= set(q) and 'pipeline' not in q and not [x for x in q if x.startswith('op1')]"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_positions_are_pruned_below_the_explode(spark, tmp_path):
    path = str(tmp_path / "reads")
    SeqTable.from_list(spark, ["ACGT"] * 3, ["IIII"] * 3).df.write.parquet(path)
    t = SeqTable.from_packed(spark.read.parquet(path), seq_type="NT")
    p = plan(t.seq_dist([2, 3]))
    assert re.search(r"posexplode\(split\(substring\(.*, 2, 2\)", p) and "qual" not in re.search(r"ReadSchema: (.*)", p).group(1)
    assert "Exchange" not in plan(t.quality_filter(20, 50).low_bases_to_null(10).df) and "Python" not in plan(t.hamming_distance("ACGT"))
    assert plan(t.seq_dist().groupBy("position").agg(F.sum("value"))).count("Exchange") <= 2
