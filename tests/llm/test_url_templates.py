"""The template tree against one that is grown row by row."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

from batchline.llm import queries, url_templates
from batchline.llm.url_templates import LIKE, NEXT, PRIOR, REJECT, RULES, SHAPES

SCHEMA = "page_id long, url string, html string, host string, template string, n long, rule int"


def shape(segment):
    if segment == "":
        return ""
    return next((name for name, pattern in SHAPES.items() if re.search(pattern, segment)), "<mixed>")


def located(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), re.match(r"[^?#]*", rest[len(host):])[0]


def rule_of(host, path):
    fit = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fit, key=lambda r: (len(r.text), r.text), default=None)


def differ(k1, n1, k2, n2):
    if not n1 or not n2:
        return False
    p = (k1 + k2 + 1) / (n1 + n2 + 2)
    return abs(k1 / n1 - k2 / n2) > LIKE * math.sqrt(p * (1 - p) * (1 / n1 + 1 / n2))


def grow(urls, at, prefix, out, levels):
    """``urls``: (index, segments, label) of one node."""
    stay = [u for u in urls if len(u[1]) == at]
    for u in stay:
        out[u[0]] = prefix
    urls = [u for u in urls if len(u[1]) > at]
    if at == levels:
        for u in urls:
            out[u[0]] = prefix + "/**"
        return
    counts = Counter(u[1][at] for u in urls)
    branches = defaultdict(list)
    for u in urls:
        s = u[1][at]
        share = 0.01 if shape(s) in ("<word>", "") else 0.25
        fixed = counts[s] >= 3 and counts[s] >= share * len(urls)
        branches[(s if fixed else shape(s), not fixed)].append(u)
    facts = []
    for (name, wild), members in branches.items():
        ahead = Counter("end" if len(u[1]) == at + 1 else shape(u[1][at + 1]) for u in members)
        ahead = [ahead[kind] for kind in NEXT]
        labelled, blocked = sum(u[2] is not None for u in members), sum(u[2] == "block" for u in members)
        share = blocked / labelled if labelled else 0.0
        facts.append(((labelled > 0, share, ahead.index(max(ahead)), max(ahead) / len(members), name, wild), labelled, blocked, ahead, members))
    groups, last = [], None
    for key, labelled, blocked, ahead, members in sorted(facts, key=lambda f: f[0]):
        apart = last is None or (last[0] > 0) != (labelled > 0) or differ(blocked, labelled, last[1], last[0])
        apart = apart or any(differ(a, len(members), b, last[3]) for a, b in zip(ahead, last[2], strict=True))
        if apart:
            groups.append(([], []))
        groups[-1][0].append(key[4])
        groups[-1][1].extend(members)
        last = (labelled, blocked, ahead, len(members))
    for names, members in groups:
        name = names[0] if len(names) == 1 else "{" + "|".join(sorted(names)) + "}"
        grow(members, at + 1, f"{prefix}/{name}", out, levels)


def brute(rows, levels=url_templates.LEVELS):
    places = [located(url) for _, url in rows]
    rules = [rule_of(*place) for place in places]
    hosts = defaultdict(list)
    for i, (host, path) in enumerate(places):
        segments = [] if path == "" else re.sub("^/", "", path).split("/")
        hosts[host].append((i, segments, rules[i] and rules[i].verdict))
    out = {}
    for urls in hosts.values():
        grow(urls, 0, "", out, levels)
    tally = defaultdict(lambda: [0, 0])
    for i, rule in enumerate(rules):
        tally[places[i][0], out[i]][0] += rule is not None
        tally[places[i][0], out[i]][1] += rule is not None and rule.verdict == "block"
    result = []
    for i, (page, _) in enumerate(rows):
        labelled, blocked = tally[places[i][0], out[i]]
        purity = (blocked + PRIOR / 2) / (labelled + PRIOR)
        verdict = rules[i].verdict if rules[i] else "block" if purity >= REJECT else "allow"
        result.append((page, *places[i], rules[i] and rules[i].text, verdict, out[i], round(purity, 9)))
    return sorted(result, key=str)


def got(df):
    return sorted(((*tuple(r)[:6], round(r["purity"], 9)) for r in df.collect()), key=str)


def frame(spark, rows):
    return spark.createDataFrame([(i, u, None, "h", "t", 1, 2) for i, u in rows], SCHEMA).repartition(3)


def awkward():
    urls = [
        None, "", "no scheme", "http://", "http://A.Example.COM", "http://a.example.com/", "https://x.net/es/1", "https://x.net/es", "x://y://z/en/",
        "http://www.example.com/en/", "http://b.www.example.com/en/x", "http://example.com/en/7", "http://example.com/EN/7", "http://badexample.com/en/7",
        "http://h.org/a//b/", "http://h.org?q=/en/", "http://h.org#/x", "http://é.net/fr/ü", "http://h.net/fr/" + "d/" * 40, "http://h.net/fr/" + "x" * 50_000,
        "http://user@h.com:80/p", "ftp://com/x", "http://net/fr/\n2",
    ]
    return list(enumerate(urls)) + [(3, urls[9]), (None, urls[6]), (3, urls[9])]


def many():
    """Two hosts: on one, blocked languages also occur where no rule reads them."""
    rows = [f"http://s.net/{'es' if i % 2 else 'fr'}/{i}" for i in range(120)] + [f"http://s.net/{lang}/{i}.html" for i in range(40) for lang in ("en", "de")]
    rows += [f"http://s.net/{'es' if i % 2 else 'fr'}" for i in range(8)] + [f"http://o.org/u{i}x/photos/{i % 7}/{'raw' if i % 2 else 'small'}" for i in range(90)]
    return list(enumerate(rows))


def test_awkward_rows(spark):
    assert got(url_templates.report(frame(spark, awkward()), levels=4)) == brute(awkward(), levels=4)


def test_templates(spark):
    rows = got(url_templates.report(frame(spark, many())))
    assert rows == brute(many())
    names = {r[5] for r in rows}
    assert "/{es|fr}/<number>" in names and "/{de|en}/<file>" in names and "/<mixed>/photos/{<number>}/raw" not in names
    assert {r[4] for r in rows if r[2].startswith("/en/")} == {"allow"}


def test_rejected_templates_reach_urls_without_a_rule(spark):
    """Words that each occur once are one wildcard; those that the rule knows speak for the rest."""
    names = [a + b for a in "abc" for b in "defgh"]
    rows = list(enumerate([f"http://h.org/ad{x}/{i}" for i, x in enumerate(names)] + ["http://h.org/other/7", "http://g.org/other/7"]))
    rules = (url_templates.Rule("block", "h.org", "/ad"),)
    out = {r["page_id"]: r for r in url_templates.report(frame(spark, rows), rules).collect()}
    assert {r["verdict"] for i, r in out.items() if i < len(rows) - 1} == {"block"} and out[len(rows) - 1]["verdict"] == "allow"
    assert (out[15]["rule"], out[15]["template"], out[0]["rule"]) == (None, "/<word>/<number>", "h.org/ad")


def test_empty_table_and_no_labels(spark):
    assert url_templates.report(frame(spark, [])).collect() == []
    plain = [(i, f"http://a.org/x/{i}") for i in range(5)]
    assert {r["verdict"] for r in url_templates.report(frame(spark, plain)).collect()} == {"allow"}


def test_whole_table(spark, small):
    rows = [(r["page_id"], r["url"]) for r in spark.read.parquet(f"{small}/pages.parquet").select("page_id", "url").collect()]
    assert got(queries.op11_path_templates(spark, small)) == brute(rows)
