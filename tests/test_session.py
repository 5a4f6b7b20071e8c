from pathlib import Path

from pairwave.session import checkpoint_folder, pin


def test_pin_uses_the_folder_the_session_names(spark):
    named = spark.conf.get("spark.checkpoint.dir")
    assert checkpoint_folder(spark) == named
    pinned = pin(spark.range(5))
    assert pinned.count() == 5 and any(Path(named).rglob("part-*"))
    assert "Scan ExistingRDD" in pinned._jdf.queryExecution().executedPlan().toString()


def test_functions_travel_with_their_tasks(spark):
    """Executors need no copy of the package: its functions are sent by value."""
    from pyspark import cloudpickle

    from pairwave.operators.design import Model, numeric

    assert b"dataclass" in cloudpickle.dumps(Model) or len(cloudpickle.dumps(Model)) > 500
    model = Model("m", numeric("id"))
    frame = spark.range(4).mapInPandas(lambda batches: (model.rows(b) for b in batches), "id long")
    assert frame.count() == 4
