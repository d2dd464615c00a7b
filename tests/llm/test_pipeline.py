"""The pipeline's stages on the smallest tables, and the guard around the subpackage."""

import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from test_operators import brute_components, brute_language, brute_quality
from twinfold.llm import langid, mixing
from twinfold.llm.common import pinned, table
from twinfold.llm.queries import tokenizer_path

ROOT = Path(__file__).resolve().parents[2]


def test_stages_keep_columns_and_take_effect(spark, tiny):
    docs = table(spark, tiny, "documents")
    start, columns, counts = docs.count(), docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = pinned(stage(spark, docs, tiny))
        assert docs.columns == columns
        counts[name] = docs.count()
    assert counts["language ID"] > 0.97 * start and counts["quality classifier"] < counts["language ID"]
    assert counts["MinHash near-dedup"] < counts["quality classifier"]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, tiny).toPandas()
    assert set(packed.doc_id) == {r.doc_id for r in docs.select("doc_id").collect()}
    assert (packed.groupby("sequence_id")["length"].sum() <= 2048).all()


def test_stages_equal_brute_force(spark, tiny):
    """What each stage keeps of what it got, and how tightly the last one packs, computed without Spark."""
    from tokenizers import Tokenizer

    labels = table(spark, tiny, "labels").toPandas()
    docs = table(spark, tiny, "documents")
    for name, stage in corpus_pipeline.STAGES:
        before, out = docs.toPandas(), pinned(stage(spark, docs, tiny))
        ids = [r.doc_id for r in out.select("doc_id").collect()]
        if name == "language ID":
            want = brute_language(langid.fit(docs))
            assert sorted(ids) == sorted(i for i, t in zip(before.doc_id, before.text, strict=True) if want(t)[2])
        elif name == "quality classifier":
            found = brute_quality(before, labels)
            assert sorted(ids) == sorted(found[found.keep].doc_id)
        elif name == "MinHash near-dedup":
            assert sorted(ids) == sorted(i for i, (_, c) in brute_components(list(zip(before.doc_id, before.text, strict=True)), 5, 80).items() if c == i)
        elif name == "mixing sources":
            size = {i: len(t.split()) for i, t in zip(before.doc_id, before.text, strict=True)}
            target = {r.source: r.target for r in mixing.targets(docs.select("source", F.regexp_count("text", F.lit(r"\S+")).alias("size"))).collect()}
            for source, rows in before.groupby("source"):
                assert abs(sum(size[i] * ids.count(i) for i in rows.doc_id) - target[source]) <= max(size[i] for i in rows.doc_id)
        else:
            tokenizer = Tokenizer.from_file(tokenizer_path())
            lengths, gaps = [], []
            for t in before.text:
                n = len(tokenizer.encode(t, add_special_tokens=False).ids) + 1
                lengths += [2048] * (n // 2048) + [n % 2048] * (n % 2048 > 0)
            for n in sorted(lengths, reverse=True):  # sequential best fit
                fit = min((g for g in gaps if g >= n), default=None)
                if fit is not None:
                    gaps.remove(fit)
                gaps.append((2048 if fit is None else fit) - n)
            rows = out.toPandas()
            assert sorted(rows["length"]) == sorted(lengths) and rows.sequence_id.nunique() == len(gaps)
        docs = out


@pytest.fixture(scope="module")
def odd(spark, tiny):
    """The table's rows among odd ones, with further columns of names that the stages use themselves."""
    long = " ".join(f"word{i % 701} talks." for i in range(20_000))
    rows = [(1, "the cat sat on the mat and then it slept", "en", "s1"), (-2, None, None, None), (-3, "", "en", "s1"), (-4, long, "en", "s2"), (-4, long, "en", "s2"), (None, "no id but words of a text here", "en", "s1"), (None, "no id but words of a text here", "en", "s1"), (-6, "éà ñandú\n\n\nüber", "de", None), (-7, "1234 !!", "en", "s3"), (-8, " \t\n", "en", "s3")]
    names = ("size", "kept", "number", "copies", "text_md5", "score", "accepted", "salt")
    extra = [F.lit(k).alias(c) for k, c in enumerate(names)]
    some = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return pinned(table(spark, tiny, "documents").unionByName(some).select("*", *extra))


def test_stages_carry_odd_rows(spark, tiny, odd):
    docs = odd
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = pinned(stage(spark, docs, tiny))
        assert docs.columns == odd.columns
        assert docs.agg(*(F.count_distinct(c).alias(c) for c in odd.columns[5:])).first() == tuple(1 for _ in odd.columns[5:])  # as they were
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, tiny).toPandas()
    assert (packed.groupby("sequence_id")["length"].sum() <= 2048).all() and not packed.doc_id.isin([-2, -3, -7, -8]).any()


def test_each_stage_by_itself_on_odd_and_empty_tables(spark, tiny, odd):
    few = pinned(odd.filter("doc_id is null or doc_id < 0"))
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, pinned(odd.limit(0)), tiny).count() == 0, name
        got = stage(spark, few, tiny)
        ids = [r.doc_id for r in got.select("doc_id").collect()]
        if name == "language ID":
            assert set(ids) <= {None, -4, -6}
        elif name == "quality classifier":
            assert {-2, -3, -8} <= set(ids)
        elif name == "MinHash near-dedup":
            assert sorted(map(str, ids)) == sorted(map(str, [-2, -3, -4, None, -6, -7, -8]))
        elif name == "mixing sources":
            assert not {-2, -3, -8} & set(ids) and all(ids.count(i) <= 6 for i in ids)
        else:
            assert len([i for i in ids if i == -2]) == 1 and set(ids) == {None, -2, -3, -4, -6, -7, -8}


def test_run_is_the_stages_in_order(spark, tiny):
    assert corpus_pipeline.run(spark, tiny).count() > 0
    assert [n.split()[0] for n, _ in corpus_pipeline.STAGES] == ["language", "quality", "MinHash", "mixing", "best-fit"]


def test_entry_imports_without_the_subpackage(tmp_path):
    for p in ROOT.iterdir():
        if p.name not in {"corpus_pipeline.py", ".git", "tests", "twinfold"}:
            (tmp_path / p.name).symlink_to(p)
    (tmp_path / "twinfold").mkdir()
    for p in (ROOT / "twinfold").iterdir():
        if p.name != "llm":
            (tmp_path / "twinfold" / p.name).symlink_to(p)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and 'pipeline' not in q and not any(n.startswith('op1') for n in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, check=True)
