import pytest

from nearfield.config import IndexConfig, Metric


def test_metric_names():
    assert Metric.parse("L2SQ") is Metric.parse("euclidean") is Metric.L2
    assert Metric.parse("cos") is Metric.COSINE and Metric.parse("ip") is Metric.IP
    with pytest.raises(ValueError, match="Unknown metric"):
        Metric.parse("hamming")


@pytest.mark.parametrize(
    "options",
    [{"R": 0}, {"L_INSERT": 0}, {"ALPHA": 0.9}, {"L_SEARCH": 0}, {"R": 64, "L_INSERT": 32}, {"METRIC": "hamming"}, {"BOGUS": 1}, {"METRIC": "l2", "EDGE_TYPE": "ternary"}, {"METRIC": "ip", "EDGE_TYPE": "1bit"}, {"EDGE_TYPE": "pq"}, {"ef_construction": 0}, {"ef_search": 0}, {"M": 1}, {"M0": 1}, {"M": "8"}, {"R": 1.5}],
)
def test_bad_options(options):
    with pytest.raises(ValueError):
        IndexConfig.from_options(options)


def test_options_of_either_spelling():
    assert IndexConfig.from_options({"m": 8}).r == 16
    assert IndexConfig.from_options({"M": 8, "M0": 10}).r == 10
    c = IndexConfig.from_options({"Metric": "COSINE", "r": 32, "Ef_Search": 77, "ef_construction": 90})
    assert (c.metric, c.r, c.l_search, c.l_insert) == (Metric.COSINE, 32, 77, 90)
    c = c.bound(65, "float32")
    assert IndexConfig.from_dict(c.to_dict()) == c
    assert c.node_bytes() == 65 * 4 + 32 * 12
    with pytest.raises(ValueError):
        c.bound(0, "float32")
    with pytest.raises(ValueError):
        c.bound(3, "text")
    with pytest.raises(ValueError, match="format"):
        IndexConfig.from_dict(c.to_dict() | {"format_version": 1})


def test_bytes_of_edge_codes():
    sizes = {e: IndexConfig.from_options({"METRIC": "cosine", "EDGE_TYPE": e}).bound(100, "float32").edge_bytes() for e in ("none", "ternary", "1bit", "int8", "float16")}
    assert sizes == {"none": 0, "ternary": 32, "1bit": 16, "int8": 100, "float16": 200}
    with pytest.raises(ValueError):
        IndexConfig.from_options({"METRIC": "l2", "EDGE_TYPE": "1bit"})
    with pytest.raises(ValueError):
        IndexConfig.from_options({"BUILD": "random"})
