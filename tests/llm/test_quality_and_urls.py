from __future__ import annotations

import re
from collections import Counter

from tests.llm.conftest import EDGES, prose
from tidemart.llm import quality, urlrank


def brute(text: str | None):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    many = Counter(windows)
    repeated = {k for i, w in enumerate(windows) if many[w] > 1 for k in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (
        len(words),
        sum(map(len, words)),
        len(re.findall(r"[#*$%&|<>]", text)),
        len(lines) - len(set(lines)),
        len(repeated),
    )


def test_counts_equal_brute_force(docs):
    rows = [*EDGES, *[(i, prose(i, i, "a b c") + "\n" + prose(i % 7, 1, "a b") + "\n#$ x\n") for i in range(100, 160)]]
    got = quality.verdicts(docs(rows)).collect()
    assert len(got) == len(rows)
    found = {(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got}
    assert found == {(i, *brute(t)) for i, t in rows}
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.kept and r.base_failed)


def test_rules_reject_what_they_name(docs):
    fine = " ".join(f"the {w} of" for w in prose(60, 3).split())
    rows = [(1, fine), (2, fine.replace(" ", "### ")), (3, fine.replace(" ", "!! ")), (4, prose(60, 4, "xx yy zz qq vv ww")), (5, None)]
    assert {r.doc_id: r.kept for r in quality.verdicts(docs(rows)).collect()} == {1: True, 2: False, 3: False, 4: False, 5: False}
    passed = quality.passing(docs(rows))
    assert passed.columns == docs(rows).columns and [r.doc_id for r in passed.collect()] == [1]
    assert passed.first().n_words == "x"  # the documents' own column, not the count
    assert quality.verdicts(docs([])).count() == 0


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "page_id bigint, url string, html string, verdict string")


def judged(spark, rows):
    return {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlrank.verdicts(pages(spark, rows)).collect()}


def test_longest_rule_wins_and_hosts_are_cut_as_said(spark):
    got = judged(
        spark,
        [
            (1, "https://A.Example.COM/en/x?q=/en/", None),
            (2, "https://www.example.com/en/x", None),
            (3, "https://b.www.example.com/en/", None),
            (4, "http://notexample.com/en/", None),
            (5, "http://x.net/es/1#t", ""),
            (6, None, None),
            (7, "no scheme", "<a href='http://x.net/q'>"),
            (8, "http://?x", None),
            (9, "http://plain.org", None),
            (10, "ftp://user@É.com:80/en/", None),
        ],
    )
    assert got == {
        1: ("a.example.com", "/en/x", "example.com/en/", "block"),
        2: ("www.example.com", "/en/x", "www.example.com/en/", "allow"),
        3: ("b.www.example.com", "/en/", "www.example.com/en/", "allow"),
        4: ("notexample.com", "/en/", "com/", "allow"),
        5: ("x.net", "/es/1", "net/es/", "block"),
        6: ("", "", None, "allow"),
        7: ("", "", None, "allow"),
        8: ("", "", None, "allow"),
        9: ("plain.org", "", None, "allow"),
        10: ("user@É.com:80", "/en/", None, "allow"),
    }
    assert judged(spark, []) == {}


def test_distrust_goes_against_links_and_trust_along_them(spark):
    bad = [(i, f"http://bad.net/es/{i}", None) for i in range(5)]
    got = judged(
        spark,
        [
            *bad,
            (10, "http://friend.org/a", '<a href="http://bad.net/es/1">x</a> <A HREF=http://bad.net/q>y</A>'),
            (11, "http://neutral.org/a", '<a href="/local">x</a>'),
            (12, "http://bad.net/other", None),
        ],
    )
    assert got[10][3] == "block" and got[11][3] == "allow" and got[12][3] == "block"


def test_ranks_equal_plain_iteration(spark):
    edges = {("a", "b"): 1.0, ("b", "c"): 0.5, ("b", "a"): 0.5, ("c", "a"): 1.0, ("d", "a"): 1.0}
    frame = spark.createDataFrame([(*k, w) for k, w in edges.items()], "src string, dst string, weight double")
    seeds = spark.createDataFrame([("a", 1.0, 0.0), ("d", 0.5, 0.0), ("c", 0.0, 1.0)], "host string, allowed double, blocked double")
    got = {r.host: (r.trust, r.distrust) for r in urlrank.ranks(seeds, frame).collect()}
    flows = (edges, {(t, s): w for (s, t), w in edges.items()})
    for k, (flow, start) in enumerate(zip(flows, ({"a": 1.0, "d": 0.5}, {"c": 1.0}))):
        base = {h: 0.15 * s for h, s in start.items()}
        score = dict(base)
        for _ in range(200):
            new = Counter(base)
            for (s, t), w in flow.items():
                new[t] += 0.85 * w * score.get(s, 0)
            score = dict(new)
        for h in got:
            assert abs(got[h][k] - score.get(h, 0)) < 1e-5


def test_a_blocked_host_with_many_linkers_blocks_each(spark):
    bad = [(i, f"http://bad.net/es/{i}", None) for i in range(3)]
    linkers = [(100 + i, f"http://friend{i}.org/a", "<a href='//bad.net/q'>x</a>") for i in range(10)]
    half = [(200, "http://half.org/a", "<a href='http://bad.net/q'> <a href='http://fine.org/'> <a href='http://fine.org/2'>")]
    chain = [(300 + i, f"http://c{i}.org/", f"<a href='http://{f'c{i - 1}.org' if i else 'shop.com'}/'>") for i in range(12)]
    got = judged(spark, [*bad, *linkers, *half, *chain, (400, "http://shop.com/", None)])
    assert {got[100 + i][3] for i in range(10)} == {"block"} and got[200][3] == "allow"
    assert {got[300 + i][3] for i in range(12)} == {"allow"} and got[400][3] == "allow"


def test_scores_reach_hosts_at_any_distance(spark):
    edges = spark.createDataFrame([(f"h{i}", f"h{i + 1}", 1.0) for i in range(30)], "src string, dst string, weight double")
    seeds = spark.createDataFrame([("h0", 1.0, 0.0), ("h30", 0.0, 1.0)], "host string, allowed double, blocked double")
    got = {r.host: (r.trust, r.distrust) for r in urlrank.ranks(seeds, edges).collect()}
    for i in range(31):
        assert abs(got[f"h{i}"][0] - 0.15 * 0.85**i) < 1e-6 and abs(got[f"h{i}"][1] - 0.15 * 0.85 ** (30 - i)) < 1e-6
