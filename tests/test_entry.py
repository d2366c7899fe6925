import inspect

import __spark_entry__


def test_every_query_takes_session_and_folder():
    """What is registered can be called as (spark, sf_dir); helpers are not."""
    for name, f in __spark_entry__.queries().items():
        assert list(inspect.signature(f).parameters)[:2] in (["spark", "sf_dir"], ["s", "d"]), name
