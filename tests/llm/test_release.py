"""Stages start with what executors hold collected."""

import corpus_pipeline
import pytest

from tagmill.llm import suffix_groups


@pytest.mark.parametrize(("name", "stage"), corpus_pipeline.STAGES)
def test_stages_collect_first(spark, name, stage):
    beans = lambda: spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    full = lambda: sum(b.getCollectionCount() for b in beans() if "Young" not in b.getName())
    before = full()
    with pytest.raises(Exception):  # no documents and no tables: it ends at their first use
        stage(spark, None, "")
    assert full() > before


def test_suffix_groups_collects_between_steps(spark, monkeypatch):
    monkeypatch.setattr(suffix_groups, "release", lambda spark: None)  # collects in the driver, which is the executor here
    beans = lambda: spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    full = lambda: sum(b.getCollectionCount() for b in beans() if "Young" not in b.getName())
    passage = "a passage of over fifty bytes that both of the texts hold, "
    before = full()
    suffix_groups.remove(spark.createDataFrame([(1, passage * 2), (2, passage)], "doc_id long, text string"))
    assert full() >= before + 3  # before the texts are cut, before spans are looked for and before what is left is written
