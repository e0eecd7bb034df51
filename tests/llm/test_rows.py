"""Rows with repeated or missing ids and clashing names; executors without the package."""

import os
import subprocess
import sys

from leaklens.llm import decontamination, mixing, near_dup, substring_dedup, toxicity

REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def text(name, n=60):
    return " ".join(f"{name}{i}" for i in range(n))


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_near_dedup_decides_by_id_and_text(spark):
    a, b, c, d = (text(x) for x in "abcd")
    near = a.replace("a59", "other")
    rows = [(1, a, "x"), (2, a, "x"), (2, b, "x"), (3, b, "x"), (4, c, "x"), (4, c, "x"), (4, c, "y"), (5, near, "x"), (6, d, "x"), (6, near, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, th string")
    kept = near_dup.drop_near_duplicates(docs)
    assert kept.columns == ["doc_id", "text", "th"]
    assert rows_of(kept, "doc_id", "text") == sorted([(1, a), (2, b), (4, c), (6, d)], key=repr)
    none = spark.createDataFrame([(None, a), (None, a), (None, b), (1, c), (None, None), (7, None)], "doc_id long, text string")
    assert sorted((i or 0, t or "") for i, t in rows_of(near_dup.drop_near_duplicates(none), "doc_id", "text")) == \
        sorted([(0, a), (0, b), (1, c), (0, ""), (7, "")])


def test_decontamination_decides_by_text(spark):
    item = text("q", 40)
    docs = spark.createDataFrame([(1, f"{text('a')} {item} {text('b')}"), (1, text("c")), (2, text("d"))], "doc_id long, text string")
    items = spark.createDataFrame([(9, item), (9, item), (10, text("z", 30))], "item_id long, text string")
    assert rows_of(decontamination.drop_contaminated(docs, items), "doc_id", "text") == [(1, text("c")), (2, text("d"))]


def test_clashing_names(spark):
    shared = text("s", 70)
    docs = spark.createDataFrame([(1, f"{text('a')} {shared}", 1, 2, 3), (2, f"{text('b')} {shared}", 4, 5, 6)],
                                 "doc_id long, text string, digests int, keepers int, __id int")
    cut = substring_dedup.drop_repeated_passages(docs)
    assert cut.columns == docs.columns
    assert rows_of(cut, "doc_id", "digests", "keepers", "__id") == [(1, 1, 2, 3), (2, 4, 5, 6)]
    assert sum("s30" in t for _, t in rows_of(cut, "doc_id", "text")) == 1
    mixed = mixing.mixed(spark.createDataFrame([(1, "a b", "s", "mine")], "doc_id long, text string, source string, copy string"))
    assert mixed.columns == ["doc_id", "text", "source", "copy", "copy_"]
    assert {r["copy"] for r in mixed.collect()} <= {"mine"}


def test_training_rows_are_bounded_by_labelled_ids(spark):
    docs = spark.createDataFrame([(i % 40, f"word{i} text") for i in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    sample = toxicity.training_sample(docs, labels).collect()
    assert len(sample) == len({r.doc_id for r in sample})
    smallest = {i: min(f"word{k} text" for k in range(i, 400, 40)) for i in range(40)}
    assert all(sorted(r.words) == sorted(smallest[r.doc_id].split(" ")) for r in sample)


def test_executors_need_no_package(tmp_path):
    """Workers that cannot import this package: they see neither its folder nor its path."""
    script = tmp_path / "job.py"
    script.write_text(f'''
import sys, tempfile
sys.path.insert(0, {REPO!r})
from pyspark.sql import SparkSession, functions as F
spark = (SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false")
         .config("spark.checkpoint.dir", tempfile.mkdtemp(dir={str(tmp_path)!r})).getOrCreate())
def lacks(batches):
    import importlib.util
    for pdf in batches:
        yield pdf.assign(found=importlib.util.find_spec("leaklens") is not None)
assert not spark.range(1).mapInPandas(lacks, "id long, found boolean").first().found
from leaklens.llm import decontamination, embedding_dedup, fill_in_middle, near_dup, spelling, substring_dedup, toxicity
words = lambda name, n=60: " ".join(f"{{name}}{{i}}" for i in range(n))
item = words("q", 40)
rows = [(i, words(f"a{{i % 30}}") + (" idiot" if i % 2 else " nice") + (" " + item if i == 7 else "")) for i in range(60)]
docs = spark.createDataFrame(rows, "doc_id long, text string")
labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
assert toxicity.score(docs, toxicity.train(docs, labels)).filter("score >= 0.5").count() > 20
found = decontamination.contaminations(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
assert [r.doc_id for r in found] == [7], found
vectors = spark.createDataFrame([(i, [1.0, float(i % 3), 0.5], 1) for i in range(20)], "vec_id long, embedding array<double>, label int")
assert embedding_dedup.near_duplicates(vectors).filter("kept").count() == 3
assert near_dup.near_duplicates(docs).count() == 60
assert substring_dedup.repeated_passages(docs).count() > 0
assert fill_in_middle.fill_in_middle(docs).count() == 60
assert spelling.variants(spark.createDataFrame([(1, "abcdef " * 9 + "abcdex " * 9)], "doc_id long, text string")).count() == 2
print("all ran")
''')
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    run = subprocess.run([sys.executable, str(script)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900)
    assert "all ran" in run.stdout, run.stderr[-3000:]
