"""The URL filter against a plain tree of dictionaries, and the SQL of the queries that have it."""

import math
import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest

from docquery.llm import urls
from docquery.llm.queries import ORACLES, QUERIES


def plain_tree(paths):
    """{segs: template} of one host's distinct paths with labelled counts {segs: n}, one node after the other."""
    out = {}

    def grow(node, rest, level):
        if not rest:
            return
        if level >= urls.LEVELS:
            deeper = [s for s in rest if len(s) > level]
            if not sum(paths[s] for s in deeper):
                out.update({s: [*node, "**"] if len(s) > level else node for s in rest})
                return
        deep = [s for s in rest if len(s) > urls.LEVELS]
        if len(rest) <= urls.CHILDREN and (level >= urls.LEVELS or not deep):
            out.update({s: [*node, *s[level:]] for s in rest})
            return
        if len(rest) <= urls.CHILDREN:  # short paths are done, deep ones go on under their own names
            out.update({s: [*node, *s[level:]] for s in rest if s not in deep})
            rest_now = deep
        else:
            rest_now = [s for s in rest if len(s) > level]
            out.update({s: node for s in rest if len(s) <= level})
        children = {s[level] if len(s) > level else "" for s in rest}
        below = defaultdict(list)
        for s in rest_now:
            below["*" if len(children) > urls.CHILDREN else s[level]].append(s)
        for name, group in below.items():
            grow([*node, name], group, level + 1)

    grow([], list(paths), 0)
    return {s: "/".join(t) for s, t in out.items()}


def plain_judge(rows, rules):
    parsed = []
    for key, url in rows:
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
        host, path = (m[1].lower() if m else ""), (m[2] if m else "")
        fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        rule = min(fits, key=lambda r: (-len(r.text), r.text)) if fits else None
        parsed.append((key, host, path, rule, tuple(re.sub("[0-9]+", "*", s) for s in path.split("/") if s)))
    hosts = defaultdict(Counter)
    blocked = Counter()
    for _, host, _, rule, segs in parsed:
        hosts[host][segs] += rule is not None
        blocked[host, segs] += rule is not None and rule.verdict == "block"
    shares = [sum(blocked[h, s] for s in p) / sum(p.values()) for h, p in hosts.items() if sum(p.values())]
    fair = sum(shares) / len(shares) if shares else 0.0
    total = sum(sum(p.values()) for p in hosts.values())
    prior = sum(blocked.values()) / total if total else 0.0
    told = {}
    for host, paths in hosts.items():
        tree = plain_tree(paths)
        n, b = Counter(), Counter()
        for s, t in tree.items():
            n[t] += paths[s]
            b[t] += blocked[host, s]
        hn, hb = sum(n.values()), sum(b.values())
        alike = [t for t in n if n[t] and abs(b[t] - n[t] * hb / hn) <= 1.96 * math.sqrt(n[t] * hb / hn * (1 - hb / hn)) + 0.5]
        mn, mb = sum(n[t] for t in alike), sum(b[t] for t in alike)
        nodes_n, nodes_b, kids = Counter(), Counter(), defaultdict(set)
        for t in n:
            steps = t.split("/") if t else []
            for i in range(len(steps) + 1):
                node = tuple(steps[:i])
                nodes_n[node] += n[t]
                nodes_b[node] += b[t]
                if i:
                    kids[node[:-1]].add(node)
        for t in n:
            steps = tuple(t.split("/")) if t else ()
            m, near = min(fair, 0.4), None
            for i in range(len(steps) + 1):
                node = steps[:i]
                if nodes_n[node]:
                    near = nodes_b[node] / nodes_n[node]
                if i < len(steps):
                    labelled = [k for k in kids[node] if nodes_n[k]]
                    m = (sum(nodes_b[k] / nodes_n[k] for k in labelled) + 4 * m) / (len(labelled) + 4)
            pn, pb = (mn, mb) if t in alike else (n[t], b[t])
            purity, expected = (pb + 4 * prior) / (pn + 4), (b[t] + 4 * m) / (n[t] + 4)
            reject = purity >= 0.6 and pn > 0 and pb >= 0.6 * pn or expected >= 0.6 and near is not None and near >= 0.6
            told[host, t] = purity, expected, "block" if reject else "allow"
        for s, t in tree.items():
            told[host, s, "of"] = t
    out = []
    for key, host, path, rule, segs in parsed:
        t = told[host, segs, "of"]
        purity, expected, verdict = told[host, t]
        out.append((key, host, path, rule and rule.text, rule.verdict if rule else verdict, t, round(purity, 5), round(expected, 5)))
    return out


def made_urls(seed, n=400):
    r = random.Random(seed)
    words = ["a", "b", "spam", "ok", "x1", "p22", "q", "news", "2024", "05", "é", "z", "w", "v", "u", "t", "s"]
    hosts = ["a.com", "b.a.com", "C.org", "d.net", "e.net", "f.io", ""]
    rows = [f"http://{r.choice(hosts)}/" + "/".join(r.choices(words[: r.choice([3, 17])], k=r.choice([0, 1, 1, 2, 2, 3, 5, 7]))) + r.choice(["", "/", "?q=1", "#f"]) for _ in range(n)]
    return list(enumerate([*rows, *rows[:20], None, "", "no url", "://", "x://h//a///b", "http://long.com/" + "s/" * 3000 + "end"]))


RULES = (urls.Rule.of("block", "net/"), urls.Rule.of("allow", "d.net/"), urls.Rule.of("block", "a.com/spam/"), urls.Rule.of("block", "a.com/a/"), urls.Rule.of("block", "a.com/b/"), urls.Rule.of("allow", "org/a"))


@pytest.mark.parametrize("seed", range(3))
def test_judge_is_brute_force(spark, seed):
    rows = made_urls(seed)
    df = spark.createDataFrame([(k, u, "clash", "clash", 0.0) for k, u in rows], "page_id long, url string, host string, template string, purity double")
    got = [(x.page_id, x.host, x.path, x.rule, x.verdict, x.template, round(x.purity, 5), round(x.expected, 5)) for x in urls.judge(df, RULES).collect()]
    want = plain_judge(rows, RULES)
    assert sorted(x[:6] for x in got) == sorted(x[:6] for x in want)
    assert all(abs(a - b) < 3e-5 for x, y in zip(sorted(got), sorted(want), strict=True) for a, b in zip(x[6:], y[6:], strict=True))
    assert len({x[7] for x in want if x[3] is None}) > 5


def test_several_blocked_branches_make_a_host_suspect(spark):
    def host(name, blocked):
        return [f"http://{name}.com/{c}/1" for c in "abcdef"[:blocked]] + [f"http://{name}.com/new/1"]

    rules = tuple(urls.Rule.of("block", f"{name}.com/{c}/") for name in ("one", "many") for c in ("a" if name == "one" else "abcdef")) + (urls.Rule.of("allow", "fine.com/"),)
    rows = [*host("one", 1), *host("many", 6), *host("fine", 3), "http://none.com/new/1"]
    got = {r.host: r for r in urls.judge(spark.createDataFrame(list(enumerate(rows)), "page_id long, url string"), rules).where("path = '/new/1'").collect()}
    assert {h: r.verdict for h, r in got.items()} == {"one.com": "allow", "many.com": "block", "fine.com": "allow", "none.com": "allow"}
    assert len({r.expected for r in got.values()}) == 4


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, name):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in ("documents", "benchmark", "pages", "labels", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    plain = lambda v: f"{v:.6g}" if isinstance(v, float) else v if isinstance(v, bool) or v is None else str(v)
    found, rel = QUERIES[name](spark, sf), con.sql(ORACLES[name])
    columns = sorted(rel.columns)
    assert sorted(found.columns) == columns
    got = sorted((tuple(plain(r[c]) for c in columns) for r in found.collect()), key=str)
    assert got == sorted((tuple(plain(r[rel.columns.index(c)]) for c in columns) for r in rel.fetchall()), key=str)


def test_sql_has_the_verdict_of_the_operator(spark):
    """Also where purity alone would block: blocked pages of other hosts make the unlabelled page's purity 0.98."""
    rows = [f"http://{h}.net/p{i}/{i}" for h in "xyz" for i in range(20)] + ["http://b.org/en/1", "http://example.com/de/1", "http://example.com/new/1", "http://b.org/fr/2", "http://b.org/fr/3/4", None]
    pages = spark.createDataFrame(list(enumerate(rows)), "page_id long, url string")
    con = duckdb.connect()
    con.register("pages", pages.toPandas())
    got = {r.page_id: (r.verdict, r.template, r.purity) for r in urls.judge(pages).collect()}
    assert got[60][0] == "allow" and got[60][2] > 0.9
    rel = con.sql(ORACLES["op7_url_filter"])
    at = [rel.columns.index(c) for c in ("page_id", "verdict", "template", "purity")]
    assert {r[at[0]]: tuple(r[i] for i in at[1:]) for r in rel.fetchall()} == got
