import json

import pytest

from urlloom.functions.features import with_features
from urlloom.functions.urls import with_clean_urls
from urlloom.operators import experiment, split
from urlloom.operators.modelling import Fitted
from urlloom.sources.feeds import PARSED

NAMES = ["url_length", "digit_count", "uses_https"]


@pytest.fixture(scope="module")
def table(spark):
    rows = [(f"http{'s' if i % 3 else ''}://h{i % 24}.site{i % 24}.example/{'9' * (6 * (i % 2))}{i}", i % 2) for i in range(120)]
    made = with_features(with_clean_urls(spark.createDataFrame(rows, "url_raw string, label int")), NAMES).withColumnRenamed("registered_domain", "domain_group")
    return split.make_split(made, 1, 2, mode="hash").cache()


def test_curve_and_sensitivity(table):
    grid = {"max_depth": 3, "min_samples_leaf": 2}
    curve = experiment.training_size_curve(table, NAMES, "decision_tree", grid, [0.5, 1.0], 42)
    assert curve[0]["rows"] < curve[1]["rows"] and curve[1]["f1"] > 0.8
    train, test = table.filter("split = 'train'"), table.filter("split = 'test'")
    assert len({r["seed"] for r in experiment.seed_sensitivity(train, test, NAMES, "decision_tree", grid, 42, 2)}) == 2
    assert experiment.domain_overlap(table).first().shared_groups == 0


def test_save_load_predict(spark, table, tmp_path):
    fitted = Fitted(table.select("label", *NAMES), NAMES, "logistic_regression", {"C": 1.0}, 0)
    experiment.save(fitted, str(tmp_path / "m"), "own", {})
    urls = spark.createDataFrame([("http://a.example/999999",), ("nope",)], "url string")
    a, b = ({json.loads(r.line)["url"]: json.loads(r.line) for r in experiment.predict_json(urls, f).collect()} for f in (fitted, experiment.load(spark, str(tmp_path / "m"))))
    assert a == b and "error" in a["nope"] and a["http://a.example/999999"]["prediction"] in (0, 1)
    with pytest.raises(Exception, match="exist"):
        experiment.save(fitted, str(tmp_path / "m"), "own", {})


def test_freeze(spark):
    rows = spark.createDataFrame([("tranco" if i % 2 else "openphish", 1 - i % 2, i, f"http://h{i}.example/", None) for i in range(20)], PARSED)
    digest = experiment.config_sha256({"a": 1})
    kept, manifest = experiment.freeze(rows, 4, 42, True, {"a": 1}, digest)
    assert kept.count() == 8 and manifest["actual_per_label"] == 4
    for args in ((4, 42, False, {"a": 1}, digest), (4, 42, True, {"a": 2}, digest), (400, 42, True, {"a": 1}, digest)):
        with pytest.raises(ValueError):
            experiment.freeze(rows, *args)


def test_frozen_protocol():
    frozen = {"protocol": {"x": 1}, "files": {"a.csv": "1"}}
    experiment.require_frozen({"x": 1}, frozen, {"a.csv": "1"})
    for protocol, files in (({"x": 2}, {"a.csv": "1"}), ({"x": 1}, {"a.csv": "2"})):
        with pytest.raises(ValueError):
            experiment.require_frozen(protocol, frozen, files)


def test_provenance():
    assert len(experiment.provenance([__file__])["files"][__file__]) == 64
