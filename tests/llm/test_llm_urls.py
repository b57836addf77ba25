"""Distrust in large and in long link graphs."""

from voxloom.llm import urls

PAGES = "page_id long, url string, html string"


def verdicts(spark, pages):
    rows = [(i, f"http://{host}/", "".join(f'<a href="http://{t}/x">' for t in to)) for i, (host, to) in enumerate(pages)]
    return {r["host"]: r["verdict"] for r in urls.judge(spark.createDataFrame(rows, PAGES)).collect()}


def test_many_linkers_of_one_blocked_host(spark):
    pages = [("bad.net", [])] + [(f"h{i}.info", ["bad.net"]) for i in range(50)]
    pages += [(f"m{i}.info", ["bad.net", "plain.info", f"h{i}.info"]) for i in range(50)] + [("plain.info", [])]
    found = verdicts(spark, pages)
    assert {h for h, v in found.items() if v == "allow"} == {"plain.info"}


def test_chain_and_cycle(spark):
    """Converged scores are 0.15 * 0.85^k on a chain: 16 links are over the threshold, 17 are not."""
    chain = ["bad.net"] + [f"c{i}.info" for i in range(1, 21)]
    pages = [("bad.net", [])] + [(b, [a]) for a, b in zip(chain, chain[1:])]
    pages += [("x.info", ["y.info"]), ("y.info", ["x.info"])]
    found = verdicts(spark, pages)
    assert [found[f"c{i}.info"] for i in range(1, 21)] == ["block"] * 16 + ["allow"] * 4
    assert found["x.info"] == found["y.info"] == "allow"


def test_scores_are_converged(spark):
    import numpy as np

    hosts = ["bad.net", "a.info", "b.info", "c.info", "org"]
    pages = [("bad.net", []), ("a.info", ["b.info", "bad.net"]), ("b.info", ["c.info", "a.info"]), ("c.info", ["a.info"])]
    rows = [(i, f"http://{h}/", "".join(f"<a href=//{t}>" for t in to)) for i, (h, to) in enumerate(pages)]
    rows += [(9, "http://org/fr/", "<a href=//c.info><a href=//a.info>")]
    m = np.zeros((5, 5))
    for h, to in [*pages, ("org", ["c.info", "a.info"])]:
        for t in to:
            m[hosts.index(h), hosts.index(t)] = 1
    along = m / np.maximum(m.sum(1, keepdims=True), 1)
    against = (m / np.maximum(m.sum(0, keepdims=True), 1)).T
    solve = lambda w, s: np.linalg.solve(np.eye(5) - 0.85 * w.T, 0.15 * np.array(s, float))
    trust, distrust = solve(along, [0, 0, 0, 0, 1]), solve(against, [1, 0, 0, 0, 0])
    for r in urls.judge(spark.createDataFrame(rows, PAGES)).collect():
        i = hosts.index(r["host"])
        assert abs(r["trust"] - trust[i]) < 1e-5 and abs(r["distrust"] - distrust[i]) < 1e-5


def test_blocked_targets_without_a_page(spark):
    found = verdicts(spark, [("a.info", ["deep.gone.net"]), ("b.info", ["gone.info"]), ("c.info", ["a.info"]), ("d.info", ["x.org"])])
    assert found == {"a.info": "block", "b.info": "allow", "c.info": "block", "d.info": "allow"}
