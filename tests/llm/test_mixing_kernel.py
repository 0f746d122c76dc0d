"""The compiled loops of the language model against the numpy code of the same steps."""

import pytest

from assayer.llm import kernel
from assayer.llm import mixing as m

from .test_mixing import SMALL, held_column, texts, tongues

ODD = [(300, None), (301, ""), (302, " \n"), (None, "the of zzz"), (303, "qq qq ww"), (303, "qq qq ww"), (304, "the " * 20_000), (305, "ÿ" * 30_000), (306, "A\x00b É　x")]


@pytest.fixture
def found(docs):
    def run(rows, size=SMALL):
        got = m.scored(docs(rows).repartition(3), held_column(), size=size).collect()
        return sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.n_bytes, r.base_score, r.score) for r in got)

    return run


def assert_same(one, two):
    assert [x[:6] for x in one] == [x[:6] for x in two]
    assert [x[6] for x in one] == pytest.approx([x[6] for x in two], rel=1e-9, abs=1e-9)
    assert [x[7] for x in one] == pytest.approx([x[7] for x in two], rel=1e-3)


def test_no_step_over_texts_runs_in_python(spark, docs):
    scored = m.scored(docs(texts(50)), held_column(), size=SMALL)
    plan = scored._jdf.queryExecution().optimizedPlan().toString()
    assert "MapPartitions" in plan and "InArrow" not in plan


@pytest.mark.parametrize("rows", [texts(200) + ODD, tongues(300)], ids=["odd", "tongues"])
def test_same_scores_as_numpy(found, monkeypatch, rows):
    compiled = found(rows)
    monkeypatch.setattr(m, "kernel_of", lambda spark: None)
    assert_same(compiled, found(rows))


@pytest.mark.parametrize(
    "bounds",
    [{"MOST = 12_000_000": "MOST = 3_000"}, {"EACH = 24_576": "EACH = 600", "MOST = 1 << 20": "MOST = 4"}],
    ids=["inputs looked up again", "small pieces"],
)
def test_bounds_of_memory_do_not_change_results(found, monkeypatch, tmp_path, bounds):
    usual = found(texts(200) + ODD)
    source = kernel._SOURCE.read_text()
    for bound, less in bounds.items():
        assert source.count(bound) == 1
        source = source.replace(bound, less)
    (tmp_path / "MixingKernel.java").write_text(source)
    monkeypatch.setattr(kernel, "_SOURCE", tmp_path / "MixingKernel.java")
    monkeypatch.setattr(kernel, "_MADE", {})
    assert_same(usual, found(texts(200) + ODD))
