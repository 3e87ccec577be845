import os

from reviewloom.llm import common, exact_dedup
from reviewloom.session import checkpoint_dir, kept_results


def test_kept_files_are_deleted_with_their_owner(spark, documents):
    root = checkpoint_dir(spark).removeprefix("file:")
    before = set(os.listdir(root))
    with kept_results(spark):
        classes, kept = exact_dedup.exact_dedup(documents([(1, "a"), (2, "a"), (3, "b")]))
        assert kept.count() == 2 and len(set(os.listdir(root)) - before) > 2
    assert set(os.listdir(root)) <= before
    forgotten = common.keep(spark.range(3), "forgotten")
    common.forget(forgotten)
    assert set(os.listdir(root)) <= before
