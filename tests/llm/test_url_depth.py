"""Templates are learnt at every depth of a path."""

from latticework.llm import url_filter

SCHEMA = "page_id long, url string"


def test_templates_below_the_fourth_segment(spark):
    """Two branches that part at the sixth segment: the labels of one host's rules tell them apart."""
    rules = (("a.net/s/t/u/v/w/bad/x", "block"), ("a.net/s/t/u/v/w/good/x", "allow"))
    rows = [(k, f"http://a.net/s/t/u/v/w/{('bad', 'good')[k % 2]}/{'xy'[k // 2 % 2]}{k}") for k in range(80)]
    got = {r.page_id: r for r in url_filter.judge(spark.createDataFrame(rows, SCHEMA), rules).collect()}
    assert got[2].template == "/s/t/u/v/w/bad/*" and got[3].template == "/s/t/u/v/w/good/*"
    unlabelled = [k for k in range(80) if got[k].rule is None]
    assert len(unlabelled) == 40
    assert {got[k].verdict for k in unlabelled if k % 2 == 0} == {"block"} and {got[k].verdict for k in unlabelled if k % 2} == {"allow"}


def test_long_urls_and_repeated_rows(spark):
    long = "http://b.net/" + "x" * 200_000 + "/y"
    deep = "http://b.net/" + "/".join(f"d{k}" for k in range(9))
    rows = [(1, long), (1, long), (2, deep), (2, deep), (3, None)]
    got = url_filter.judge(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == 5 and len({tuple(r) for r in got}) == 3
    assert {r.template for r in got if r.page_id == 2} == {"/" + "/".join(f"d{k}" for k in range(9))}
